"""Functions that take the place of built-in ones: codecs, segmenters and steps, by name."""

from __future__ import annotations

from collections.abc import Callable

from .operators.segment import threshold_segmenter, watershed_segmenter
from .sources.codecs import CODECS

#: Segmenters by name: an image to labels. Steps by name: a frame to a frame, for ``plans.pipeline.chain``.
SEGMENTERS: dict[str, Callable] = {"threshold": threshold_segmenter, "watershed": watershed_segmenter}
STEPS: dict[str, Callable] = {}
KINDS = {"codec": CODECS, "segmenter": SEGMENTERS, "step": STEPS}


def register(kind: str, name: str, function: Callable) -> None:
    """Adds or replaces a function; codecs go by their suffix (``.xyz``)."""
    KINDS[kind][name] = function


def codec_options() -> dict[str, str]:
    """The source's option that has every worker import the codecs registered here (classes of an importable module)."""
    own = {s: f for s, f in CODECS.items() if not f.__module__.startswith("lamella.")}
    return {"codecs": ",".join(f"{s}={f.__module__}:{f.__qualname__}" for s, f in own.items())} if own else {}


def find(kind: str, name: str) -> Callable:
    if name not in KINDS[kind]:
        raise KeyError(f"no {kind} {name}; there are: {', '.join(sorted(KINDS[kind]))}")
    return KINDS[kind][name]
