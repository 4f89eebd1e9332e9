"""Channel panels."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shared import small

SCHEMA = "panel string, index int, name string, marker string, biological_role string, is_dapi boolean, is_af boolean"

# The channels of both panels, by 1-based index.
KIDNEY = (
    (1, "DAPI", "-", "nucleus", True, False),
    (2, "Opal570", "FOXP3", "nucleus", False, False),
    (3, "Opal690", "CD8", "membrane", False, False),
    (4, "Opal480", "CD20", "membrane", False, False),
    (5, "Opal620", "CD23", "membrane", False, False),
    (6, "Opal780", "PAX8s", "nucleus", False, False),
    (7, "Opal520", "CD3", "membrane", False, False),
    (8, "SampleAF", "AF", "background", False, True),
)
BLADDER = (
    (1, "DAPI", "-", "nucleus", True, False),
    (2, "Opal570", "FOXP3", "nucleus", False, False),
    (3, "Opal690", "PD-L1", "membrane", False, False),
    (4, "Opal480", "PANCK", "cytoplasm", False, False),
    (5, "Opal620", "CD4", "membrane", False, False),
    (6, "Opal780", "CXCL13", "nucleus", False, False),
    (7, "Opal520", "IgM", "membrane", False, False),
    (8, "SampleAF", "AF", "background", False, True),
)
PANELS = {"KidneyCancer": KIDNEY, "BladderCancer": BLADDER}
DEFAULT = "KidneyCancer"


def panels(spark: SparkSession, more: dict[str, list[tuple]] | None = None) -> DataFrame:
    """All panels as one small table; ``more`` adds or replaces panels (malformed channels are skipped)."""
    known = {**PANELS, **{k: [c for c in v if len(c) == 6 and isinstance(c[0], int)] for k, v in (more or {}).items()}}
    return spark.createDataFrame([(k, *c) for k, v in known.items() for c in v], SCHEMA)


def config(name: str, path: str | None = None) -> list[tuple] | None:
    """The channels of a panel: from a YAML list at ``path`` if that gives any, else a known panel's; None for an unknown one.

    Entries without an index and a name are skipped.
    """
    found = []
    if path and Path(path).is_file():
        import yaml

        for c in yaml.safe_load(Path(path).read_text(encoding="utf-8")) or []:
            if isinstance(c, dict) and str(c.get("index", "")).isdigit() and c.get("name"):
                role = str(c.get("biological_role", ""))
                found.append((int(c["index"]), str(c["name"]), str(c.get("marker", "")), role, bool(c.get("is_dapi")), bool(c.get("is_af"))))
    return found or (list(PANELS[name]) if name in PANELS else None)


def reference_plane(panel: DataFrame, name: str | None = None) -> DataFrame:
    """``reference_plane`` of each panel (from 0): the first channel called ``name``, else the nuclear one."""
    plane = F.col("index") - 1
    named = F.min(F.when(F.col("name") == name, plane)) if name else F.lit(None).cast("int")
    return panel.groupBy("panel").agg(F.coalesce(named, F.min(F.when(F.col("is_dapi"), plane)), F.lit(0)).alias("reference_plane"))


def with_channels(tiles: DataFrame, panel: DataFrame) -> DataFrame:
    """Every tile with every channel of a panel, whatever their number; they ride along where they are few."""
    return tiles.crossJoin(small(panel))


def markers(panel: DataFrame) -> DataFrame:
    """Channels that carry a marker."""
    return panel.where(~F.col("is_dapi") & ~F.col("is_af"))


def in_stack(panel: DataFrame, n_channels: int) -> DataFrame:
    """Channels that a stack of ``n_channels`` planes has."""
    return panel.where(F.col("index") - 1 < n_channels)


def special_channels(panel: DataFrame) -> DataFrame:
    """Zero-based planes per panel: DAPI (0 if there is none) and AF (null if there is none)."""
    plane = F.col("index") - 1
    return panel.groupBy("panel").agg(
        F.coalesce(F.min(F.when(F.col("is_dapi"), plane)), F.lit(0)).alias("dapi_plane"),
        F.min(F.when(F.col("is_af"), plane)).alias("af_plane"),
    )
