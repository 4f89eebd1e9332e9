"""Command line: ``python -m lamella.cli MODE --input PATH --output FOLDER``."""

from __future__ import annotations

import argparse
import logging
import os
import sys

from pyspark.sql import SparkSession

from . import config
from .operators import export, segment
from .plans import flows, pipeline
from .sources import panels

log = logging.getLogger("lamella")


def framed(text: str) -> None:
    """A message between rules."""
    log.info("%s\n%s\n%s", "_" * 40, text, "_" * 40)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lamella")
    p.add_argument("mode", choices=("preprocess", "segmentation", "features", "full", "cluster", "cohort"))
    p.add_argument("--input", required=True)
    p.add_argument("--output")
    p.add_argument("--config")
    for name in ("tile", "seed", "k", "max-tiles", "nucleus-channel"):
        p.add_argument(f"--{name}", type=int)
    p.add_argument("--cancer-type")
    p.add_argument("--reference")
    p.add_argument("--qc", choices=("off", "basic", "full"))
    return p


def main(args: list[str] | None = None) -> int:
    """0, or 2 if anything went wrong."""
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(message)s")
    given = vars(parser().parse_args(args))
    try:
        s = config.load(given.pop("config"), **given)
        spec = panels.config(s.cancer_type)
        if spec is None:
            raise ValueError(f"unknown panel {s.cancer_type}")
        spark, source, folder = SparkSession.builder.getOrCreate(), given["input"], given["output"]
        if given["mode"] == "cluster":
            flows.cluster_table(spark, source, s.k, s.seed)
        elif given["mode"] == "cohort":
            flows.cluster_cohort(spark, source, folder or source, s.k, s.seed)
        else:
            if given["mode"] in ("preprocess", "full"):
                flows.write_report(flows.quality_control(spark, source, spec, s.tile, s.reference, s.max_tiles, level=s.qc), folder)
            if given["mode"] == "segmentation":
                tiles = flows.read(spark, source, layout="stack", tile=str(s.tile))
                good = segment.segment(tiles, channel=s.nucleus_channel).where("error is null").persist()
                export.write_csv(segment.cells_of_tiles(good), os.path.join(folder, "nuclei_centroids.csv"), empty=False)
                framed(f"{export.write_pngs(good, folder, 'labels').count()} label tiles")
                good.unpersist()
            if given["mode"] in ("features", "full"):
                marked = {c[0]: c[1] for c in spec if not c[4] and not c[5]}
                out = pipeline.run(flows.read(spark, source, layout="stack", tile=str(s.tile)), s.nucleus_channel, marked, k=s.k, seed=s.seed)
                out.write(folder)
                framed(str(out.totals().first().asDict()))
                out.close()
    except Exception:
        log.exception("the run failed")
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
