"""Settings of a run: environment over arguments over file over defaults."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields, replace
from pathlib import Path

PREFIX = "LAMELLA_"


@dataclass(frozen=True)
class Settings:
    cancer_type: str = "KidneyCancer"
    tile: int = 1024
    seed: int = 42
    k: int | None = None
    qc: str = "full"
    max_tiles: int = 0
    reference: str | None = None
    nucleus_channel: int = 1


def load(path: str | None = None, environment: dict[str, str] | None = None, **given) -> Settings:
    """Settings from a YAML file at ``path``, then arguments that aren't None (0 counts), then ``LAMELLA_*`` variables."""
    kinds = {f.name: f.type for f in fields(Settings)}
    read: dict = {}
    if path:
        import yaml

        read = {k: v for k, v in (yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}).items() if k in kinds}
    own = {k: v for k, v in given.items() if k in kinds and v is not None}
    told = {k: v for k in kinds if (v := (os.environ if environment is None else environment).get(PREFIX + k.upper())) is not None}
    typed = {k: int(v) if "int" in kinds[k] and v is not None else v for k, v in {**read, **own, **told}.items()}
    return replace(Settings(), **typed)
