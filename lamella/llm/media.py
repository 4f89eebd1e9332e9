"""Media columns: signature sniffing, structure checks and carving of embedded media."""

from __future__ import annotations

import hashlib
import struct
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_columns, buffer_of, utf8

#: Payloads are a positive multiple of this many bytes; the fill byte.
UNIT, FILL = 576, 255
#: Samples a second of stored payloads.
RATE = 8000

class Seen:
    """What earlier checks of a blob have found out, so that many false beginnings cost one pass together."""

    def __init__(self):
        self.marks: dict[bytes, tuple[int, int]] = {}
        self.dead: set[tuple[str, int]] = set()  # (format, place) of links of chains that end nowhere

    def find(self, b: bytes, mark: bytes, at: int) -> int:
        """``b.find(mark, at)``, remembering the last gap that was searched."""
        since, place = self.marks.get(mark, (0, -2))
        if place == -2 or not (since <= at and (at <= place or place == -1)):
            place = b.find(mark, at)
            self.marks[mark] = (at, place)
        return place


# ---- Formats: each check returns the length of a well-formed item that begins at ``at``, or None.


def png(b: bytes, at: int, seen: Seen) -> int | None:
    i = at + 8
    first = True
    while i + 12 <= len(b):
        n, kind = struct.unpack_from(">I4s", b, i)
        end = i + 12 + n
        if end > len(b) or (first and kind != b"IHDR") or zlib.crc32(b[i + 4 : end - 4]) != struct.unpack_from(">I", b, end - 4)[0]:
            return None
        first, i = False, end
        if kind == b"IEND":
            return i - at
    return None


def jpeg(b: bytes, at: int, seen: Seen) -> int | None:
    i, framed = at + 2, False
    while i + 4 <= len(b) and b[i] == 0xFF:
        kind = b[i + 1]
        if kind == 0xFF:
            i += 1
            continue
        if kind == 0xD9:
            return i + 2 - at if framed else None
        n = struct.unpack_from(">H", b, i + 2)[0]
        if n < 2 or i + 2 + n > len(b):
            return None
        framed |= 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC)
        i += 2 + n
        if kind == 0xDA:  # entropy-coded: on to the next marker that is no restart or stuffed byte
            while True:
                i = b.find(b"\xff", i)
                if i < 0 or i + 1 >= len(b):
                    return None
                if b[i + 1] == 0 or 0xD0 <= b[i + 1] <= 0xD7:
                    i += 2
                    continue
                break
    return i + 2 - at if framed and b[i : i + 2] == b"\xff\xd9" else None


def gif(b: bytes, at: int, seen: Seen) -> int | None:
    def blocks(i: int) -> int:
        while i < len(b) and b[i]:
            i += b[i] + 1
        return i + 1

    if at + 13 > len(b):
        return None
    flags, i, frames = b[at + 10], at + 13, 0
    i += 3 << (flags & 7) + 1 if flags & 0x80 else 0
    while i < len(b):
        if b[i] == 0x3B:
            return i + 1 - at if frames else None
        if b[i] == 0x21:
            i = blocks(i + 2)
        elif b[i] == 0x2C and i + 10 <= len(b):
            flags = b[i + 9]
            i = blocks(i + 10 + (3 << (flags & 7) + 1 if flags & 0x80 else 0) + 1)
            frames += 1
        else:
            return None
    return None


def bmp(b: bytes, at: int, seen: Seen) -> int | None:
    if at + 30 > len(b):
        return None
    size, zero, offset, header, planes = struct.unpack_from("<IIII8xH", b, at + 2)
    return size if not zero and header in (40, 52, 56, 108, 124) and planes == 1 and 14 + header <= offset < size <= len(b) - at else None


def riff(kind: bytes, need: bytes):
    def check(b: bytes, at: int, seen: Seen) -> int | None:
        if b[at + 8 : at + 12] != kind:
            return None
        end = at + 8 + struct.unpack_from("<I", b, at + 4)[0]
        i, found = at + 12, set()
        while i + 8 <= min(end, len(b)):
            name, n = struct.unpack_from("<4sI", b, i)
            found.add(name[: len(need)])
            i += 8 + n + n % 2
        return end - at if need in found and i == end + (end - at) % 2 and end <= len(b) else None

    return check


def pdf(b: bytes, at: int, seen: Seen) -> int | None:
    end = seen.find(b, b"%%EOF", at)
    if end < 0 or not b[at + 5 : at + 6].isdigit() or not 0 <= seen.find(b, b"startxref", at) < end:
        return None
    while (more := b.find(b"%%EOF", end + 5)) >= 0 and b.find(b"%PDF-", end, more) < 0:  # later revisions
        end = more
    return end + 5 - at


def gzip(b: bytes, at: int, seen: Seen) -> int | None:
    d = zlib.decompressobj(31)
    view = memoryview(b)
    try:
        for i in range(at, len(b), 1 << 16):
            part = d.decompress(view[i : i + (1 << 16)], 1 << 20)
            while d.unconsumed_tail and not d.eof:
                part = d.decompress(d.unconsumed_tail, 1 << 20)
            if d.eof:
                return min(i + (1 << 16), len(b)) - at - len(d.unused_data)
            del part
    except zlib.error:
        pass
    return None


def zipped(b: bytes, at: int, seen: Seen) -> int | None:
    end = seen.find(b, b"PK\x05\x06", at)
    if end < 0 or end + 22 > len(b):
        return None
    _, _, _, entries, size, offset, note = struct.unpack_from("<HHHHIIH", b, end + 4)
    ok = at + offset + size == end and end + 22 + note <= len(b) and (not entries or b[end - size : end - size + 4] == b"PK\x01\x02")
    return end + 22 + note - at if ok else None


def ogg(b: bytes, at: int, seen: Seen) -> int | None:
    i, serial, pages = at, None, []
    while b[i : i + 5] == b"OggS\0" and i + 27 <= len(b) and ("ogg", i) not in seen.dead:
        flags, number, count = b[i + 5], b[i + 14 : i + 18], b[i + 26]
        end = i + 27 + count + sum(b[i + 27 : i + 27 + count])
        if end > len(b) or (serial not in (None, number)) or (serial is None and not flags & 2):
            break
        pages.append(("ogg", i))
        serial, i = number, end
        if flags & 4:
            return i - at
    seen.dead.update(pages)  # of one stream each: from none of them on does it end
    return None


def mp4(b: bytes, at: int, seen: Seen) -> int | None:
    i, kinds, boxes = at, set(), []
    while i + 8 <= len(b) and (("mp4", i) not in seen.dead or b"moov" in kinds):
        n, kind = struct.unpack_from(">I4s", b, i)
        if n == 1 and i + 16 <= len(b):
            n = struct.unpack_from(">Q", b, i + 8)[0]
        if n < 8 or i + n > len(b) or not (kind.isalnum() and kind.isascii()):
            break
        kinds.add(kind)
        boxes.append(("mp4", i))
        i += n
    if {b"ftyp", b"moov"} <= kinds:
        return i - at
    seen.dead.update(boxes)  # no moov after any of them
    return None


#: Type, magic bytes, where the magic stands in an item, and its check.
FORMATS = (
    ("image/png", b"\x89PNG\r\n\x1a\n", 0, png),
    ("image/jpeg", b"\xff\xd8\xff", 0, jpeg),
    ("image/gif", b"GIF87a", 0, gif),
    ("image/gif", b"GIF89a", 0, gif),
    ("image/bmp", b"BM", 0, bmp),
    ("audio/wav", b"RIFF", 0, riff(b"WAVE", b"fmt ")),
    ("image/webp", b"RIFF", 0, riff(b"WEBP", b"VP8")),
    ("video/avi", b"RIFF", 0, riff(b"AVI ", b"LIST")),
    ("application/pdf", b"%PDF-", 0, pdf),
    ("application/gzip", b"\x1f\x8b\x08", 0, gzip),
    ("application/zip", b"PK\x03\x04", 0, zipped),
    ("audio/ogg", b"OggS", 0, ogg),
    ("video/mp4", b"ftyp", 4, mp4),
)
OTHER = "application/octet-stream"


def automaton():
    """Aho-Corasick over all magic bytes, as Latin-1 characters."""
    import ahocorasick

    a = ahocorasick.Automaton()
    by_magic: dict[bytes, list] = {}
    for kind, magic, before, check in FORMATS:
        by_magic.setdefault(magic, []).append((kind, len(magic) + before, check))
    for magic, formats in by_magic.items():
        a.add_word(magic.decode("latin-1"), formats)
    a.make_automaton()
    return a


def scan(blob: bytes, magics) -> list[tuple[str, int, int]]:
    """(type, offset, length) of the well-formed items, from left to right and none within another but the whole.

    An item that begins the blob may hold others; those are listed too.
    """
    found: list[tuple[str, int, int]] = []
    free, seen = 0, Seen()
    hits = sorted((end + 1 - reach, kind, check) for end, formats in magics.iter(blob.decode("latin-1")) for kind, reach, check in formats)
    for at, kind, check in hits:
        if at < free or at < 0:
            continue
        n = check(blob, at, seen)
        if n:
            found.append((kind, at, n))
            free = at + n if at else 1
    return found


CARVED = T.ArrayType(
    T.StructType([T.StructField("type", T.StringType()), T.StructField("offset", T.LongType()), T.StructField("length", T.LongType())])
)


def sniff(media: DataFrame, blob: str = "media", declared: str = "declared") -> DataFrame:
    """Append ``type, structure_bytes, corrected, carved`` to every row.

    ``type`` is that of the well-formed item at the blob's beginning (else
    application/octet-stream) and ``structure_bytes`` its length by its own
    structure (else 0); ``corrected`` says that the declared type differs (or
    is null); ``carved`` lists well-formed items further on, with offset and
    length. Null blobs count as empty, which are of no type. Repeated rows get
    equal answers, an empty table gives no rows. Columns with those names are
    replaced.
    """

    def make():
        magics = automaton()

        def f(b: pa.RecordBatch) -> list[pa.Array]:
            data, at = buffer_of(b.column(0))
            kinds, sizes, carved = [], [], []
            for i in range(len(at) - 1):
                items = scan(bytes(data[at[i] : at[i + 1]]), magics)
                whole = items.pop(0) if items and items[0][1] == 0 else (OTHER, 0, 0)
                kinds.append(whole[0])
                sizes.append(whole[2])
                carved.append([{"type": k, "offset": o, "length": n} for k, o, n in items])
            wrong = [k != d for k, d in zip(kinds, b.column(1).to_pylist())]
            kind = pa.list_(pa.struct([("type", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]))
            return [pa.array(kinds, pa.string()), pa.array(sizes, pa.int64()), pa.array(wrong, pa.bool_()), pa.array(carved, kind)]

        return f

    fields = [
        T.StructField("type", T.StringType()),
        T.StructField("structure_bytes", T.LongType()),
        T.StructField("corrected", T.BooleanType()),
        T.StructField("carved", CARVED),
    ]
    return add_columns(media, {"blob": utf8(F.col(f"`{blob}`")), "declared": F.col(f"`{declared}`").cast("string")}, fields, make)


def correct(media: DataFrame, blob: str = "media", declared: str = "declared") -> DataFrame:
    """``media`` with the declared type replaced by the sniffed one, where there is one."""
    told = sniff(media, blob, declared)
    return told.withColumn(declared, F.when(F.col("structure_bytes") > 0, F.col("type")).otherwise(F.col(f"`{declared}`")))


def carve(media: DataFrame, blob: str = "media", declared: str = "declared") -> DataFrame:
    """One row for each embedded item: the columns of ``media`` but the blob, and ``type, offset, length, item``."""
    told = sniff(media, blob, declared).withColumn("__item", F.explode("carved"))
    cut = F.substring(F.col(f"`{blob}`"), (F.col("__item.offset") + 1).cast("int"), F.col("__item.length").cast("int"))
    kept = [c for c in media.columns if c.lower() not in (blob.lower(), "type", "offset", "length", "item")]
    return told.select(*[F.col(f"`{c}`") for c in kept], "__item.type", "__item.offset", "__item.length", cut.alias("item"))


def payload(text: Column) -> Column:
    """A text's UTF-8 bytes, filled up to a positive multiple of ``UNIT``; null counts as empty."""
    raw = utf8(text)
    n = F.octet_length(raw)
    whole = F.greatest(F.ceil(n / UNIT), F.lit(1)) * UNIT
    fill = F.expr(f"cast(unhex(repeat('{FILL:02X}', {UNIT})) as binary)")
    return F.concat(raw, F.substring(fill, F.lit(1), (whole - n).cast("int")))


def little_endian(n: Column, size: int) -> Column:
    """An integer as ``size`` bytes, lowest first."""
    digits = F.lpad(F.hex(n), 2 * size, "0")
    return F.unhex(F.concat(*[F.substring(digits, 2 * i + 1, 2) for i in reversed(range(size))]))


def wave(samples: Column) -> Column:
    """A mono WAV file of 8-bit samples (an even number of them)."""
    n = F.octet_length(samples).cast("long")
    head = struct.pack("<4sIHHIIHH4s", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data")
    return F.concat(
        F.lit(b"RIFF"), little_endian(n + 36, 4), F.lit(b"WAVE"), F.lit(head), little_endian(n, 4), samples
    )


def samples_of(wav: bytes | memoryview) -> memoryview | None:
    """The samples of a WAV file, found by its chunks; None if it has none."""
    b, i = memoryview(wav), 12
    while b[:4] == b"RIFF" and i + 8 <= len(b):
        name, n = struct.unpack_from("<4sI", b, i)
        if name == b"data":
            return b[i + 8 : i + 8 + n]
        i += 8 + n + n % 2
    return None


def read_back(media: DataFrame, blob: str = "media") -> DataFrame:
    """Append what the stored bytes hold: ``payload_bytes, payload_sha256, tail_crc32`` (of its last 32 bytes).

    All three are null for null and empty blobs and those that are no WAV file
    with samples. Columns with those names are replaced.
    """

    def make():
        def f(b: pa.RecordBatch) -> list[pa.Array]:
            data, at = buffer_of(b.column(0))
            rows = []
            for i in range(len(at) - 1):
                x = samples_of(data[at[i] : at[i + 1]])
                rows.append((None, None, None) if x is None else (len(x), hashlib.sha256(x).hexdigest(), zlib.crc32(x[-32:])))
            sizes, hashes, crcs = zip(*rows) if rows else ((), (), ())
            return [pa.array(sizes, pa.int64()), pa.array(hashes, pa.string()), pa.array(crcs, pa.int64())]

        return f

    fields = [
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_sha256", T.StringType()),
        T.StructField("tail_crc32", T.LongType()),
    ]
    return add_columns(media, {"blob": utf8(F.col(f"`{blob}`"))}, fields, make)
