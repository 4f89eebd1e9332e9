"""Token ids of whole texts by a public tokenizer: chunk by chunk where its pre-tokens never span white space, else plainly."""

from __future__ import annotations

import ctypes
import gc
import json
import os
import re
from collections.abc import Iterator
from functools import cache

import numpy as np

#: ASCII white space: every pre-token ends there, so what lies between is encoded on its own.
SPACE = re.compile(r"[ \t-\r]+")
#: Characters of cached chunks at most, in two generations: what the older one has and nobody meets again is forgotten.
CACHE_CHARS = 5_000_000
#: Sentence marks that form a pre-token of their own after a letter.
MARKS = (".", ",")
#: Such a mark after anything but a letter, where it may belong to a longer pre-token.
ALONE = [re.compile(rf"\{m}(?=\s)(?<![^\W\d_]\{m})") for m in MARKS]
#: Words in one call of the tokenizer.
GROUP = 1000
#: Marks that compose with the letter before them, a letter that ends in one in lower case, and controls that only
#: Python counts as white space.
ODD = re.compile("[\u0130\u0300-\u036f\x1c-\x1f]")


#: What the chunks rest on: the kinds of normalizers and pre-tokenizers (white space dropped, lower case, ends of words marked)
#: and the split between them.
SHAPE = ("NFC Replace Lowercase", "Split ByteLevel", "Removed", "</w>")
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def chunkable(path: str) -> bool:
    """Whether the tokenizer file is of the kind whose chunks between white space can be encoded apart."""
    with open(path, encoding="utf-8") as f:
        t = json.load(f)
    normalizers = (t.get("normalizer") or {}).get("normalizers", [])
    splits = (t.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
    kinds = [" ".join(x.get("type", "") for x in v) for v in (normalizers, splits)]
    own = (*kinds, splits[0].get("behavior"), t.get("model", {}).get("end_of_word_suffix"))
    return own == SHAPE and splits[0].get("pattern", {}).get("Regex") == PATTERN


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Encoder:
    """Encodes texts chunk by chunk and remembers chunks, as corpora repeat their words.

    The ids equal those of the tokenizer on the whole text (``add_special_tokens=False``),
    each as four little-endian bytes. Tokenizers of another kind encode each text
    as it is, and remember nothing.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.chunked = chunkable(path)
        #: The same model for lower-case ASCII letters, which need no normalising and no patterns.
        self.plain = Tokenizer.from_file(path)
        self.plain.normalizer = None
        self.plain.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        size = self.tokenizer.get_vocab_size()
        #: Tokens that end a word, by id.
        self.last = np.array([(self.tokenizer.id_to_token(i) or "").endswith("</w>") for i in range(size)])
        self.known: dict[str, bytes] = {"": b""}
        self.older: dict[str, bytes] = {}
        self.chars = 0

    def encode(self, texts: list[str], plain: bool = False) -> Iterator[np.ndarray]:
        for e in (self.plain if plain else self.tokenizer).encode_batch_fast(texts, add_special_tokens=False):
            yield np.array(e.ids, "<u4")

    def learn(self, chunks: set[str]) -> None:
        known = self.known
        marked = [w for w in chunks if w[-1] in MARKS and w[:-1].isalpha() and not ODD.search(w)]
        words = {w for w in chunks if w.isalpha()}
        words.update([w[:-1] for w in marked])
        for w in filter(self.older.__contains__, words):
            known[w] = self.older[w]
        words = [w for w in words if w not in known]
        rest = [w for w in chunks if w not in known]
        # Words of letters alone are one pre-token each: many fit into one call and come apart at their last tokens.
        for plain in (True, False):
            part = [w for w in words if (w.isascii() and w.islower()) == plain]
            for i in range(0, len(part), 16 * GROUP):
                groups = [part[j : j + GROUP] for j in range(i, min(i + 16 * GROUP, len(part)), GROUP)]
                for group, ids in zip(groups, self.encode([" ".join(g) for g in groups], plain)):
                    ends = ((np.flatnonzero(self.last[ids]) + 1) * 4).tolist()
                    if len(ends) == len(group):
                        data = ids.tobytes()
                        known.update(zip(group, [data[x:y] for x, y in zip([0, *ends], ends)]))
        rest += MARKS
        apart = {w for w in marked if w[:-1] in known}
        rest = [w for w in rest if w not in known and w not in apart]
        known.update(zip(rest, (ids.tobytes() for ids in self.encode(rest))))
        for w in apart:
            known[w] = known[w[:-1]] + known[w[-1]]
        self.chars += sum(map(len, chunks))

    def split(self, text: str) -> list[str]:
        # Lower case now saves chunks; not where special tokens, composing marks or separators that are no
        # white space for the tokenizer might be met.
        if "<" in text or ODD.search(text):
            return SPACE.split(text)
        text = text.encode().lower().decode()  # A-Z only
        if not any(alone.search(text) for alone in ALONE):
            for mark in MARKS:
                text = text.replace(f"{mark} ", f" {mark} ").replace(f"{mark}\n", f" {mark} ")
        return text.split()  # the tokenizer drops all other white space, too

    def known_words(self, texts: list[str]) -> list[list[str]]:
        """The runs between white space of each text, all of them known from now on."""
        if self.chars > CACHE_CHARS // 2:
            self.older, self.known, self.chars = self.known, {"": b""}, 0
        words = list(map(self.split, texts))
        fresh = set().union(*words).difference(self.known)
        again = list(filter(self.older.__contains__, fresh))  # an intersection would go through all of the older ones
        self.known.update(zip(again, map(self.older.__getitem__, again)))
        self.chars += sum(map(len, again))
        fresh.difference_update(again)
        if fresh:
            self.learn(fresh)
        return words

    def counts(self, texts: list[str]) -> list[int]:
        """The number of ids of each text."""
        return [len(x) // 4 for x in self.ids(texts)]

    def ids(self, texts: list[str]) -> list[bytes]:
        if not self.chunked:
            return [x.tobytes() for x in self.encode(texts)]
        words = self.known_words(texts)
        get = self.known.__getitem__
        return [b"".join(map(get, w)) for w in words]


@cache
def encoder(path: str) -> Encoder:
    """One encoder for each Python worker: its cache outlives a task."""
    return Encoder(path)


def forget() -> None:
    """Free what earlier stages cached in this Python worker, which Spark reuses for other operators, and give it back.

    The many small objects of a cache leave their pages with the allocator, so
    the C library is asked to return those that are free (where it can).
    """
    if encoder.cache_info().currsize:
        encoder.cache_clear()
        trim()


def trim() -> None:
    """Give what this Python worker has freed back to the system: large arrays leave holes that the allocator keeps."""
    gc.collect()
    back = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if back is not None:
        back(0)
