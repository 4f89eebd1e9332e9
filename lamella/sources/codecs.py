"""Image files as arrays: window reads of TIFF pages and NumPy stacks, label PNGs, and writers of both.

The subset of TIFF that slide scanners write is read: classic and big files of
either byte order, strips or tiles, uncompressed, deflated, LZW or PackBits, with
or without horizontal differencing (of integers' and floats' bits) or the
floating-point predictor, 8 to 64 bits a sample. What is none of these is refused.
"""

from __future__ import annotations

import struct
import zlib
from pathlib import Path

import numpy as np

# TIFF tags and the struct codes of their field types; PNG's signature.
WIDTH, HEIGHT, BITS, COMPRESSION, STRIPS, SAMPLES, ROWS, STRIP_SIZES, PLANAR = 256, 257, 258, 259, 273, 277, 278, 279, 284
PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILES, TILE_SIZES, SUBIFDS, FORMAT, PHOTOMETRIC, SUBFILE = 317, 322, 323, 324, 325, 330, 339, 262, 254
KINDS = {1: "B", 2: "s", 3: "H", 4: "I", 6: "b", 7: "B", 8: "h", 9: "i", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}
PNG = b"\x89PNG\r\n\x1a\n"


def lzw(data: bytes) -> bytes:
    """TIFF's LZW: codes of 9 to 12 bits, most significant first, wider one code early; 256 clears, 257 ends."""
    first = [bytes([i]) for i in range(256)] + [b"", b""]
    table, width, held, bits, before, out = list(first), 9, 0, 0, b"", []
    for byte in data:
        held, bits = held << 8 | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code, held = held >> bits, held & ((1 << bits) - 1)
        if code == 257:
            break
        if code == 256:
            table, width, before = list(first), 9, b""
            continue
        if code > len(table) - (not before):
            raise ValueError("a broken LZW strip")
        entry = table[code] if code < len(table) else before + before[:1]
        if before:
            table.append(before + entry[:1])
            width = min(max(width, (len(table) + 1).bit_length()), 12)
        out.append(entry)
        before = entry
    return b"".join(out)


def packbits(data: bytes) -> bytes:
    """Runs: n < 128 is followed by n + 1 bytes as they are, n > 128 by one byte that stands 257 - n times."""
    out, at = [], 0
    while at < len(data):
        n = data[at]
        if n < 128:
            out.append(data[at + 1 : at + 2 + n])
            at += n + 2
        else:
            out.append(data[at + 1 : at + 2] * (257 - n) if n > 128 else b"")
            at += 1 if n == 128 else 2
    return b"".join(out)


#: What undoes each compression.
UNPACK = {1: bytes, 5: lzw, 8: zlib.decompress, 32946: zlib.decompress, 32773: packbits}


class Page:
    """One image of a TIFF file, read window by window."""

    def __init__(self, path: str, order: str, tags: dict[int, tuple]):
        self.path, self.tags = path, tags
        one = lambda tag, default: tags.get(tag, (default,))[0]
        self.width, self.height, self.samples = one(WIDTH, 0), one(HEIGHT, 0), one(SAMPLES, 1)
        kind = {1: "u", 2: "i", 3: "f"}[one(FORMAT, 1)]
        self.dtype = np.dtype(f"{order}{kind}{one(BITS, 8) // 8}")
        self.compression, self.predictor, self.apart = one(COMPRESSION, 1), one(PREDICTOR, 1), one(PLANAR, 1) == 2
        self.tiled = TILES in tags
        self.cell = (one(TILE_HEIGHT, 0), one(TILE_WIDTH, 0)) if self.tiled else (min(one(ROWS, self.height), self.height), self.width)
        self.places, self.sizes = (tags[TILES], tags[TILE_SIZES]) if self.tiled else (tags[STRIPS], tags[STRIP_SIZES])

    def refused(self) -> str | None:
        """Why this page can't be read, if so."""
        if self.compression not in UNPACK:
            return f"compression {self.compression} of {self.path} is not supported"
        if self.predictor not in (1, 2, 3) or self.predictor == 3 and self.dtype.kind != "f":
            return f"predictor {self.predictor} of {self.path} is not supported"
        return None

    def piece(self, file, index: int, rows: int) -> np.ndarray:
        file.seek(self.places[index])
        data = file.read(self.sizes[index])
        data = UNPACK[self.compression](data)
        each, wide = 1 if self.apart else self.samples, self.cell[1]
        size = self.dtype.itemsize
        if self.predictor == 3:  # differences of bytes; those of a row stand by significance, the highest first
            steps = np.frombuffer(data, np.uint8, rows * wide * each * size).reshape(rows, wide * size, each)
            parts = np.cumsum(steps, axis=1, dtype=np.uint8).reshape(rows, size, wide * each)
            return np.ascontiguousarray(parts.transpose(0, 2, 1)).view(f">f{size}").reshape(rows, wide, each)
        out = np.frombuffer(data, self.dtype, rows * wide * each).reshape(rows, wide, each)
        if self.predictor == 2:
            bits = np.dtype(f"u{size}")  # differences are those of the samples as whole numbers
            return np.cumsum(out.astype(self.dtype.newbyteorder("=")).view(bits), axis=1, dtype=bits).view(self.dtype.newbyteorder("="))
        return out

    def window(self, sample: int, y: int, x: int, h: int, w: int) -> np.ndarray:
        """A clamped window of one sample; only the strips or tiles that it meets are read."""
        y1, x1 = min(y + h, self.height), min(x + w, self.width)
        out = np.zeros((max(y1 - y, 0), max(x1 - x, 0)), self.dtype.newbyteorder("="))
        ch, cw = self.cell
        across = -(-self.width // cw)
        plane = sample * across * -(-self.height // ch) if self.apart else 0
        with open(self.path, "rb") as file:
            for r in range(y // ch, -(-y1 // ch)):
                for c in range(x // cw, -(-x1 // cw)):
                    rows = ch if self.tiled else min(ch, self.height - r * ch)
                    got = self.piece(file, plane + r * across + c, rows)[:, :, 0 if self.apart else sample]
                    a, b, d, e = max(y, r * ch), min(y1, r * ch + rows), max(x, c * cw), min(x1, (c + 1) * cw)
                    out[a - y : b - y, d - x : e - x] = got[a - r * ch : b - r * ch, d - c * cw : e - c * cw]
        return out


def tiff_pages(path: str) -> list[Page]:
    """All pages of a TIFF file in order; reduced levels in sub-directories follow their page."""
    with open(path, "rb") as f:
        head = f.read(16)
        order = {b"II": "<", b"MM": ">"}.get(head[:2])
        if not order:
            raise ValueError(f"{path} is no TIFF file")
        big = struct.unpack(order + "H", head[2:4])[0] == 43
        at = struct.unpack(order + "Q", head[8:16])[0] if big else struct.unpack(order + "I", head[4:8])[0]
        count, entry, word = ("Q", 20, "Q") if big else ("H", 12, "I")
        todo, pages, seen = [at], [], set()
        while todo:
            at = todo.pop(0)
            if not at or at in seen:
                continue
            seen.add(at)
            f.seek(at)
            n = struct.unpack(order + count, f.read(struct.calcsize(count)))[0]
            data = f.read(n * entry + struct.calcsize(word))
            tags = {}
            for i in range(n):
                tag, kind = struct.unpack_from(order + "HH", data, i * entry)
                many = struct.unpack_from(order + word, data, i * entry + 4)[0]
                code = KINDS.get(kind)
                if code is None:
                    continue
                size, field = struct.calcsize(code) * many, i * entry + 4 + struct.calcsize(word)
                if size <= struct.calcsize(word):
                    raw = data[field : field + size]
                else:
                    f.seek(struct.unpack_from(order + word, data, field)[0])
                    raw = f.read(size)
                tags[tag] = (raw,) if code == "s" else struct.unpack(f"{order}{many}{code}", raw)
            pages.append(Page(path, order, tags))
            todo[:0] = [*tags.get(SUBIFDS, ()), struct.unpack_from(order + word, data, n * entry)[0]]
        return pages


class TiffStack:
    """The pages of a TIFF file as large as the first one, each sample of them a channel; ``levels`` are their smaller versions.

    A level is pages of one size and the first one's proportions (2 % off at
    most), in sub-directories or not, as many planes as the full one has;
    ``levels`` lists the sizes, the full one first.
    """

    def __init__(self, path: str, level: int = 0):
        pages = tiff_pages(path)
        sizes: dict[tuple[int, int], list] = {}
        for p in pages:
            sizes.setdefault((p.height, p.width), []).extend((p, s) for s in range(p.samples))
        full = (pages[0].height, pages[0].width)
        alike = lambda h, w: abs(h * full[1] - w * full[0]) <= 0.02 * full[1] * full[0] * h / full[0] + max(full)
        own = [s for s, planes in sizes.items() if s[0] <= full[0] and len(planes) == len(sizes[full]) and alike(*s) and (s == full or not any(p.refused() for p, _ in planes))]
        self.path, self.levels = path, sorted(own, key=lambda s: -s[0] * s[1])
        self.planes = sizes[self.levels[level]]
        if (why := next((r for p, _ in self.planes if (r := p.refused())), None)) is not None:
            raise ValueError(why)
        self.shape = (len(self.planes), *self.levels[level])

    def at_level(self, level: int) -> TiffStack:
        if not 0 <= level < len(self.levels):
            raise ValueError(f"{self.path} has {len(self.levels)} levels, not one of number {level}")
        return TiffStack(self.path, level) if level else self

    def window(self, c: int, y: int, x: int, h: int, w: int) -> np.ndarray:
        page, sample = self.planes[c]
        return page.window(sample, y, x, h, w)


def oriented(stack: np.ndarray, axes: str | None = None) -> np.ndarray:
    """An array as (channel, y, x): by its axis letters (C or else S is the channel, other axes take their first index).

    Without letters two dimensions are one plane, and of three the last one is
    the channel if it has 2 to 16 entries and the first has more.
    """
    if axes:
        axes = axes.upper()
        channel = next((a for a in "CS" if a in axes), None)
        for i in reversed(range(len(axes))):
            if axes[i] not in ("Y", "X", channel):
                stack, axes = stack.take(0, axis=i), axes[:i] + axes[i + 1 :]
        return np.moveaxis(stack, [axes.index(a) for a in ([channel] if channel else []) + ["Y", "X"]], range(stack.ndim)).reshape(-1, *(stack.shape[axes.index(a)] for a in "YX"))
    if stack.ndim == 2:
        return stack[None]
    return np.moveaxis(stack, -1, 0) if 2 <= stack.shape[-1] <= 16 < stack.shape[0] else stack


class ArrayStack:
    """A NumPy file, mapped and not loaded; it has one level."""

    def __init__(self, path: str, axes: str | None = None):
        self.array = oriented(np.load(path, mmap_mode="r"), axes)
        self.shape = self.array.shape

    def window(self, c: int, y: int, x: int, h: int, w: int) -> np.ndarray:
        return self.array[c, y : y + h, x : x + w]


def decode_png(data: bytes) -> np.ndarray:
    """A grey, RGB or RGBA PNG of 8 or 16 bits a sample, not interlaced, as (y, x) or (y, x, sample)."""
    if data[:8] != PNG:
        raise ValueError("no PNG file")
    at, packed, head = 8, [], None
    while at < len(data):
        n, kind = struct.unpack_from(">I4s", data, at)
        if kind == b"IHDR":
            head = struct.unpack_from(">IIBBBBB", data, at + 8)
        elif kind == b"IDAT":
            packed.append(data[at + 8 : at + 8 + n])
        at += n + 12
    width, height, bits, colour, _, _, interlaced = head
    samples = {0: 1, 2: 3, 4: 2, 6: 4}.get(colour)
    if interlaced or bits not in (8, 16) or samples is None:
        raise ValueError("a PNG of this kind is not supported")
    step = samples * bits // 8
    raw = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, 1 + width * step)
    out, above = np.zeros((height, width * step), np.uint8), np.zeros(width * step, np.uint8)
    for y in range(height):
        kind, line = raw[y, 0], raw[y, 1:]
        if kind == 0:
            out[y] = line
        elif kind == 1:
            out[y] = np.cumsum(line.reshape(width, step), axis=0, dtype=np.uint8).ravel()
        elif kind == 2:
            out[y] = line + above
        else:  # average and Paeth need each sample before the next one
            now = bytearray(width * step)
            for i in range(width * step):
                left, up, corner = (now[i - step] if i >= step else 0), int(above[i]), (int(above[i - step]) if i >= step else 0)
                if kind == 3:
                    guess = (left + up) // 2
                else:
                    guess = min((left, up, corner), key=lambda v, p=left + up - corner: abs(p - v))
                now[i] = (int(line[i]) + guess) & 255
            out[y] = np.frombuffer(bytes(now), np.uint8)
        above = out[y]
    wide = out.reshape(height, width, samples, bits // 8)
    full = wide[..., 0] if bits == 8 else wide[..., 0].astype(np.uint16) << 8 | wide[..., 1]
    return full[..., 0] if samples == 1 else full


def encode_png(image: np.ndarray) -> bytes:
    """A (y, x) or (y, x, 3) array of 8- or 16-bit samples as PNG."""
    image = np.ascontiguousarray(image)
    bits, colour = image.dtype.itemsize * 8, 0 if image.ndim == 2 else 2
    rows = image.astype(image.dtype.newbyteorder(">")).reshape(image.shape[0], -1).view(np.uint8)
    packed = zlib.compress(np.column_stack([np.zeros(len(rows), np.uint8), rows]).tobytes())
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", image.shape[1], image.shape[0], bits, colour, 0, 0, 0)
    return PNG + chunk(b"IHDR", head) + chunk(b"IDAT", packed) + chunk(b"IEND", b"")


def lay_out_tiff(path: str, shapes: list[tuple[int, int]], parts: dict[str, list[tuple[int, int, int, int]]], cell: int = 512) -> dict[str, int]:
    """A big TIFF of 8-bit levels, each ``cell`` x ``cell`` tiles, deflated, but for the tiles' bytes; gives where each part's begin.

    ``parts`` are the (level, row, column, bytes) of the tiles that stand one
    after another in each. Levels after the first are the first one's
    sub-directories; a tile that is in no part is empty.
    """
    blank = zlib.compress(bytes(cell * cell))
    grids = [(-(-h // cell), -(-w // cell)) for h, w in shapes]
    where = [[None] * (r * c) for r, c in grids]
    with open(path, "wb") as f:
        f.write(struct.pack("<2sHHHQ", b"II", 43, 8, 0, 0))
        empty = (f.tell(), len(blank))
        f.write(blank)
        starts, at = {}, f.tell()
        for name, tiles in parts.items():
            starts[name] = at
            for level, r, c, size in tiles:
                where[level][r * grids[level][1] + c] = (at, size)
                at += size
        f.seek(at)

        def directory(level: int, subs: list[int]) -> int:
            h, w = shapes[level]
            cells = [p or empty for p in where[level]]
            tags = [(SUBFILE, 4, [int(level > 0)]), (WIDTH, 4, [w]), (HEIGHT, 4, [h]), (BITS, 3, [8]), (COMPRESSION, 3, [8]), (PHOTOMETRIC, 3, [1]), (SAMPLES, 3, [1]),
                    (TILE_WIDTH, 4, [cell]), (TILE_HEIGHT, 4, [cell]), (TILES, 16, [p for p, _ in cells]), (TILE_SIZES, 16, [n for _, n in cells])]
            tags += [(SUBIFDS, 18, subs)] if subs else []
            entries = b""
            for tag, kind, values in sorted(tags):
                raw = struct.pack(f"<{len(values)}{KINDS[kind]}", *values)
                if len(raw) > 8:
                    at = f.tell()
                    f.write(raw)
                    raw = struct.pack("<Q", at)
                entries += struct.pack("<HHQ", tag, kind, len(values)) + raw.ljust(8, b"\0")
            at = f.tell()
            f.write(struct.pack("<Q", len(tags)) + entries + struct.pack("<Q", 0))
            return at

        subs = [directory(i, []) for i in range(1, len(shapes))]
        main = directory(0, subs)
        f.seek(8)
        f.write(struct.pack("<Q", main))
    return starts


#: How a file is opened, by its suffix; more plug in as a class with ``shape`` and ``window``.
CODECS = {".npy": ArrayStack, **dict.fromkeys((".tif", ".tiff", ".qptif", ".qptiff"), TiffStack)}


def open_stack(path: str, axes: str | None = None, codecs: dict | None = None):
    codec = (codecs or CODECS)[Path(path).suffix.lower()]
    return codec(path, axes) if axes and codec is ArrayStack else codec(path)
