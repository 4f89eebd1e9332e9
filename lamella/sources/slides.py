"""Multi-channel image stacks as a data source.

    slides.register(spark)
    spark.read.format("slides").options(path="/slides", tile=512).load()

A row is a tile and channel, or with ``layout=stack`` a tile with all its
channels, so that nothing has to be brought together later. ``metadata=true``
gives the shapes only, and the error of a slide that can't be opened; such a
slide is one row of tiles, with its error and nothing else. A window that can't
be read is a row with an error and no pixels. Images are named by their path below the folder, without the suffix.

Options: ``path`` (a file or a folder), ``tile``, ``channels`` (1-based, comma
separated), ``tile_x``, ``tile_y``, ``axes`` (letters of NumPy files), ``parts``
(tasks of a slide; nothing is opened to plan them), ``halo`` (pixels around a
tile, as far as there are any: ``h`` and ``w`` count them, ``tile_y`` and
``tile_x`` don't), ``effective=true`` (half the shorter side, 64 at least, where
a side has fewer than two tiles), ``max_tiles`` (of a slide: every n-th), ``sample`` and ``seed`` (that many
tiles of a slide, by hash: the same ones on every run), ``window`` (``y,x,h,w``
or ``centre,h,w``: one tile a slide, clamped to it), ``level`` (of the pyramid,
0 is the full one) or ``downsample`` (the level whose factor is nearest; the
lower of two): sizes and positions are then those of that level. ``codecs``
(``.suffix=module:Class``, comma separated) names classes for other files,
which every worker imports. Filters on ``image_id``,
``tile_x``, ``tile_y`` and ``channel`` (equal to, one of) are applied before
anything is read.
"""

from __future__ import annotations

import hashlib
import importlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from .codecs import CODECS, open_stack

TILES = "image_id string, tile_y long, tile_x long, h int, w int, channel int, pixels array<float>, error string"
STACKS = "image_id string, tile_y long, tile_x long, h int, w int, channels array<int>, planes array<array<float>>, error string"
SHAPES = "image_id string, n_channels int, height long, width long, levels array<struct<height: long, width: long, downsample: double>>, error string"
NUMBERS = [pa.field("image_id", pa.string()), pa.field("tile_y", pa.int64()), pa.field("tile_x", pa.int64()), pa.field("h", pa.int32()), pa.field("w", pa.int32())]
TILE_FIELDS = pa.schema([*NUMBERS, pa.field("channel", pa.int32()), pa.field("pixels", pa.list_(pa.float32())), pa.field("error", pa.string())])
STACK_FIELDS = pa.schema([*NUMBERS, pa.field("channels", pa.list_(pa.int32())), pa.field("planes", pa.list_(pa.list_(pa.float32()))), pa.field("error", pa.string())])


def loaded(name: str):
    """The class at ``module:Class``."""
    module, _, attribute = name.partition(":")
    return getattr(importlib.import_module(module), attribute)


class Part(InputPartition):
    """Every ``of``-th row of tiles of a slide, from ``number`` on."""

    def __init__(self, path: str, name: str, number: int, of: int):
        self.path, self.name, self.number, self.of = path, name, number, of


class Reader(DataSourceReader):
    def __init__(self, options):
        self.o = {k.lower(): v for k, v in dict(options).items()}
        self.metadata = self.o.get("metadata", "false").lower() == "true"
        self.stacked = self.o.get("layout", "").lower() == "stack"
        self.tile = int(self.o.get("tile", 1024))
        self.halo, self.effective, self.most = int(self.o.get("halo", 0)), self.o.get("effective", "").lower() == "true", int(self.o.get("max_tiles", 0))
        self.sample, self.seed = int(self.o.get("sample", 0)), int(self.o.get("seed", 42))
        self.only: dict[str, set] = {k: {int(self.o[k])} for k in ("tile_x", "tile_y") if k in self.o}
        if "channels" in self.o:
            self.only["channel"] = {int(c) for c in self.o["channels"].split(",")}

        #: Those of other modules by name, as this runs in Spark's own processes.
        self.codecs = {**CODECS, **{s.lower(): loaded(name) for s, name in (x.split("=") for x in self.o.get("codecs", "").split(",") if x)}}

    def level_of(self, stack):
        """The level that ``level`` or ``downsample`` asks for; the stack itself without either."""
        if "level" not in self.o and "downsample" not in self.o:
            return stack
        height = stack.shape[1]
        if not hasattr(stack, "at_level"):  # one level alone, the nearest to any factor
            if int(self.o.get("level", 0)):
                raise ValueError("this file has one level")
            return stack
        if "level" in self.o:
            return stack.at_level(int(self.o["level"]))
        wanted = float(self.o["downsample"])
        return stack.at_level(min(range(len(stack.levels)), key=lambda i: abs(height / stack.levels[i][0] - wanted)))

    def files(self) -> list[tuple[str, str]]:
        root = Path(self.o["path"].removeprefix("file://"))
        if root.is_file():
            return [(str(root), root.stem)]
        found = sorted(p for p in root.rglob("*") if p.suffix.lower() in self.codecs)
        return [(str(p), p.relative_to(root).with_suffix("").as_posix()) for p in found]

    def partitions(self) -> list[Part]:
        parts = 1 if self.metadata else int(self.o.get("parts", 16))
        names = self.only.get("image_id")
        return [Part(p, n, i, parts) for p, n in self.files() if names is None or n in names for i in range(parts)] or [Part("", "", 0, 1)]

    def tiles(self, part: Part, height: int, width: int) -> Iterator[tuple[int, int, int, int]]:
        if "window" in self.o:
            *place, h, w = self.o["window"].split(",")
            h, w = min(int(h), height), min(int(w), width)
            y, x = ((height - h) // 2, (width - w) // 2) if place == ["centre"] else map(int, place)
            y, x = max(0, min(y, height - 1)), max(0, min(x, width - 1))
            if part.number == 0:
                yield y, x, min(h, height - y), min(w, width - x)
            return
        size = self.tile
        if self.effective and min(-(-height // size), -(-width // size)) < 2:
            size = max(min(height, width) // 2, 64)
        rows, columns = -(-height // size), -(-width // size)
        step = -(-rows * columns // self.most) if self.most else 1
        few = None
        if self.sample:  # every part draws the same tiles
            every = [(y * size, x * size) for y in range(rows) for x in range(columns)]
            few = set(sorted(every, key=lambda t: hashlib.md5(f"{self.seed}:{part.name}/{t[0]}_{t[1]}".encode()).digest())[: self.sample])
        for i in range(part.number, rows, part.of):
            for j in range(columns):
                y, x = i * size, j * size
                if (i * columns + j) % step == 0 and (few is None or (y, x) in few) and all(v in self.only.get(k, {v}) for k, v in (("tile_y", y), ("tile_x", x))):
                    yield y, x, min(size, height - y), min(size, width - x)

    def read(self, partition: Part) -> Iterator:
        if not partition.path:
            return
        try:
            stack = open_stack(partition.path, self.o.get("axes"), self.codecs)
            stack = self.level_of(stack)
        except Exception as e:  # one unreadable slide must not end the job
            error = f"{type(e).__name__}: {e}"[:200]
            if self.metadata:
                yield (partition.name, None, None, None, None, error)
            elif partition.number == 0:
                yield (partition.name, *[None] * (len(STACK_FIELDS) - 2), error)  # as many as those of a tile
            return
        n, height, width = map(int, stack.shape)
        if self.metadata:
            levels = [(int(h), int(w), full / h) for full, h, w in ((height, h, w) for h, w in getattr(stack, "levels", [(height, width)]))]
            yield (partition.name, n, height, width, levels, None)
            return
        channels = [c for c in range(1, n + 1) if c in self.only.get("channel", {c})]
        for y, x, h, w in self.tiles(partition, height, width):
            top, left = min(self.halo, y), min(self.halo, x)
            h, w = min(h + self.halo, height - y) + top, min(w + self.halo, width - x) + left
            try:
                planes, error = [np.asarray(stack.window(c - 1, y - top, x - left, h, w), np.float32).ravel() for c in channels], None
            except Exception as e:
                planes, error = None, f"{type(e).__name__}: {e}"[:200]
            place = [partition.name, y, x, h, w]
            if self.stacked:
                row = [*place, channels, planes, error]
                yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, STACK_FIELDS)], schema=STACK_FIELDS)
            else:
                for i, c in enumerate(channels):
                    row = [*place, c, planes[i] if planes else None, error]
                    yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, TILE_FIELDS)], schema=TILE_FIELDS)


class PrunedReader(Reader):
    """Takes filters that name tiles, channels or images."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        own = {"image_id", "tile_x", "tile_y"} | (set() if self.stacked else {"channel"})
        for f in filters:
            if isinstance(f, EqualTo | In) and f.attribute[0] in own and not self.metadata:
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                name = f.attribute[0]
                self.only[name] = self.only.get(name, values) & values
            yield f  # Spark checks again: cheap, and right for names of any case


class Slides(DataSource):
    """Options only: works whether or not Spark passes filters to Python sources."""

    @classmethod
    def name(cls) -> str:
        return "slides"

    def schema(self) -> str:
        if str(self.options.get("metadata", "false")).lower() == "true":
            return SHAPES
        return STACKS if str(self.options.get("layout", "")).lower() == "stack" else TILES

    def reader(self, schema) -> Reader:
        return Reader(self.options)


class PrunedSlides(Slides):
    def reader(self, schema) -> PrunedReader:
        return PrunedReader(self.options)


def register(spark: SparkSession) -> None:
    """Make ``slides`` a format of the session, with filters passed on to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PrunedSlides)
