"""Compressed and pyramidal TIFF files against arrays, codecs in workers, and slides that can't be opened."""

import struct
import zlib

import numpy as np
import pytest

from lamella import plugins
from lamella.plans import flows
from lamella.sources import codecs


def lzw(data):
    """By the specification: greedy strings, codes one bit wider when the encoder adds entry 511, 1023 and 2047."""
    out, table, width, codes = [], {bytes([i]): i for i in range(256)}, 9, 258
    emit = lambda c: out.append((c, width))
    emit(256)
    now = b""
    for x in data:
        both = now + bytes([x])
        if both in table:
            now = both
            continue
        emit(table[now])
        table[both] = codes
        codes += 1
        if codes == 4094:
            emit(256)
            table, width, codes = {bytes([i]): i for i in range(256)}, 9, 258
        elif codes in (512, 1024, 2048):
            width += 1
        now = bytes([x])
    if now:
        emit(table[now])
        codes += 1
        width += codes in (512, 1024, 2048)
    emit(257)
    bits = "".join(f"{c:0{w}b}" for c, w in out)
    return bytes(int(bits[i : i + 8].ljust(8, "0"), 2) for i in range(0, len(bits), 8))


def packbits(data):
    out, at = b"", 0
    while at < len(data):
        n = 1
        while at + n < len(data) and n < 128 and data[at + n] == data[at]:
            n += 1
        out += bytes([257 - n, data[at]]) if n > 1 else bytes([0, data[at]])
        at += n
    return out


PACK = {1: bytes, 5: lzw, 8: zlib.compress, 32773: packbits}


def differences(piece, predictor):
    """(rows, width, samples) as TIFF stores it before compression."""
    if predictor == 1:
        return piece.tobytes()
    if predictor == 2:
        bits = piece.view(f"{piece.dtype.byteorder}u{piece.dtype.itemsize}")
        native = bits.astype(bits.dtype.newbyteorder("="))
        return np.concatenate([native[:, :1], np.diff(native, axis=1)], axis=1).astype(bits.dtype).tobytes()
    size = piece.dtype.itemsize
    rows, width, samples = piece.shape
    high = np.ascontiguousarray(piece.astype(f">f{size}")).view(np.uint8).reshape(rows, width * samples, size)
    planes = high.transpose(0, 2, 1).reshape(rows, width * size, samples)
    return np.concatenate([planes[:, :1], np.diff(planes, axis=1)], axis=1).astype(np.uint8).tobytes()


def write(path, levels, order="<", compression=1, predictor=1, cell=None, rows=7, subs=True):
    """Classic TIFF: each level (y, x, sample) in tiles of ``cell`` or strips; levels after the first as sub-directories or pages."""
    data, directories = bytearray(struct.pack(f"{order}2sHI", b"II" if order == "<" else b"MM", 42, 0)), []
    for level in levels:
        h, w, s = level.shape
        level = level.astype(level.dtype.newbyteorder(order))
        if cell:
            pieces = [np.pad(level, ((0, cell), (0, cell), (0, 0)))[y : y + cell, x : x + cell] for y in range(0, h, cell) for x in range(0, w, cell)]
        else:
            pieces = [level[y : y + rows] for y in range(0, h, rows)]
        places, sizes = [], []
        for p in pieces:
            raw = PACK[compression](differences(np.ascontiguousarray(p), predictor))
            places.append(len(data))
            sizes.append(len(raw))
            data += raw
        kind = {"u": 1, "i": 2, "f": 3}[level.dtype.kind]
        tags = {256: (4, [w]), 257: (4, [h]), 258: (3, [level.dtype.itemsize * 8] * s), 259: (3, [compression]), 277: (3, [s]), 284: (3, [1]), 317: (3, [predictor]), 339: (3, [kind] * s)}
        tags |= {322: (4, [cell]), 323: (4, [cell]), 324: (4, places), 325: (4, sizes)} if cell else {273: (4, places), 278: (4, [rows]), 279: (4, sizes)}
        directories.append(tags)

    def put(tags, after):
        entries = b""
        for tag, (kind, values) in sorted(tags.items()):
            raw = struct.pack(f"{order}{len(values)}{'H' if kind == 3 else 'I'}", *values)
            if len(raw) > 4:
                at = len(data)
                data.extend(raw)
                raw = struct.pack(f"{order}I", at)
            entries += struct.pack(f"{order}HHI", tag, kind, len(values)) + raw.ljust(4, b"\0")
        at = len(data)
        data.extend(struct.pack(f"{order}H", len(tags)) + entries + struct.pack(f"{order}I", after))
        return at

    if subs:
        own = [put(t, 0) for t in directories[1:]]
        first = put(directories[0] | ({330: (4, own)} if own else {}), 0)
    else:
        first = 0
        for t in reversed(directories):
            first = put(t, first)
    data[4:8] = struct.pack(f"{order}I", first)
    path.write_bytes(bytes(data))


@pytest.mark.parametrize("dtype, predictor", [("u1", 1), ("u1", 2), ("u2", 2), ("i4", 2), ("u4", 1), ("f4", 1), ("f4", 2), ("f4", 3), ("f8", 3)])
@pytest.mark.parametrize("compression", sorted(PACK))
def test_windows_equal_the_array(tmp_path, dtype, predictor, compression):
    rng = np.random.default_rng(1)
    smooth = np.cumsum(rng.integers(0, 3, (45, 51, 2)), axis=1)
    image = (smooth * 1.25 - 7).astype(dtype) if dtype[0] == "f" else smooth.astype(dtype)
    for order in "<>":
        for cell in (None, 16):
            path = tmp_path / "a.tif"
            write(path, [image], order, compression, predictor, cell)
            stack = codecs.open_stack(str(path))
            assert stack.shape == (2, 45, 51)
            for y, x, h, w in ((0, 0, 45, 51), (10, 13, 20, 30), (40, 50, 9, 9)):
                assert (stack.window(1, y, x, h, w) == image[y : y + h, x : x + w, 1]).all()


def test_lzw_of_any_length():
    rng = np.random.default_rng(2)
    for n in [*range(0, 300, 7), 5000, 40_000]:
        for top in (2, 256):
            data = bytes(rng.integers(0, top, n).astype(np.uint8))
            assert codecs.lzw(lzw(data)) == data and codecs.packbits(packbits(data)) == data
    with pytest.raises(ValueError, match="broken"):
        codecs.lzw(bytes([0x80, 0x7F, 0xFF, 0xFF]))


def test_other_predictors_and_compressions_are_refused(spark, tmp_path):
    image = np.zeros((8, 8, 1), np.uint8)
    write(tmp_path / "p.tif", [image], predictor=1)
    raw = (tmp_path / "p.tif").read_bytes()
    entry = lambda tag, value: struct.pack("<HHIHH", tag, 3, 1, value, 0)
    (tmp_path / "p3.tif").write_bytes(raw.replace(entry(317, 1), entry(317, 3)))
    (tmp_path / "c7.tif").write_bytes(raw.replace(entry(259, 1), entry(259, 7)))
    got = {r["image_id"]: r["error"] for r in flows.read(spark, str(tmp_path), tile="64").collect()}
    assert got["p"] is None and "predictor 3" in got["p3"] and "compression 7" in got["c7"]


def test_levels_of_a_pyramid(spark, tmp_path):
    full = np.random.default_rng(3).integers(0, 60_000, (200, 160, 2)).astype(np.uint16)
    levels = [full, full[::2, ::2], full[::4, ::4]]
    thumbnail = np.zeros((30, 90, 2), np.uint16)  # of other proportions: no level
    write(tmp_path / "subs.tif", levels, compression=5, predictor=2, cell=64)
    write(tmp_path / "pages.tif", [*levels, thumbnail], subs=False)
    shapes = {r["image_id"]: r for r in flows.read(spark, str(tmp_path), metadata="true").collect()}
    for name in ("subs", "pages"):
        assert [tuple(x) for x in shapes[name]["levels"]] == [(200, 160, 1.0), (100, 80, 2.0), (50, 40, 4.0)]
    for options, level in (({"level": "1"}, 1), ({"downsample": "3.9"}, 2), ({"downsample": "0.1"}, 0), ({}, 0)):
        rows = flows.read(spark, str(tmp_path), tile="64", channels="2", **options).collect()
        assert len(rows) == 2 * -(-levels[level].shape[0] // 64) * -(-levels[level].shape[1] // 64)
        for r in rows:
            y, x, h, w = r["tile_y"], r["tile_x"], r["h"], r["w"]
            assert np.allclose(r["pixels"], levels[level][y : y + h, x : x + w, 1].ravel())
    window = flows.read(spark, str(tmp_path / "subs.tif"), window="10,20,30,30", level="2", channels="1").first()
    assert np.allclose(window["pixels"], levels[2][10:40, 20:40, 0].ravel())
    assert "3 levels" in flows.read(spark, str(tmp_path / "subs.tif"), level="3").first()["error"]


FLAT = '''
import numpy as np

class Flat:
    """Eight rows of bytes, one plane."""
    def __init__(self, path):
        self.array = np.fromfile(path, np.uint8).reshape(1, 8, -1)
        self.shape = self.array.shape

    def window(self, c, y, x, h, w):
        return self.array[c, y : y + h, x : x + w]
'''


def test_codecs_reach_the_workers(spark, tmp_path, monkeypatch):
    import importlib
    import os
    import sys

    (tmp_path / "flat_codec.py").write_text(FLAT)
    (tmp_path / "slides").mkdir()
    (tmp_path / "slides" / "a.flat").write_bytes(bytes(range(64)))
    spark.sparkContext.addPyFile(str(tmp_path / "flat_codec.py"))
    monkeypatch.syspath_prepend(str(tmp_path))
    monkeypatch.setenv("PYTHONPATH", f"{tmp_path}:{os.environ['PYTHONPATH']}")
    flat = importlib.import_module("flat_codec").Flat
    try:
        plugins.register("codec", ".flat", flat)
        assert plugins.codec_options() == {"codecs": ".flat=flat_codec:Flat"}
        rows = flows.read(spark, str(tmp_path / "slides"), tile="4").collect()
        assert len(rows) == 4 and sum(sum(r["pixels"]) for r in rows) == sum(range(64))
    finally:
        codecs.CODECS.pop(".flat")
        sys.modules.pop("flat_codec")
