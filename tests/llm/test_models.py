"""Language-model scoring, lexical search and spelling variants against plain versions."""

import math
import re
import tracemalloc
import zlib
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lamella.llm import lexical, recurrent, spelling
from lamella.llm.common import letters, remainder, runs

LONG = " ".join(f"word{i % 977}" for i in range(60_000))
EDGE = [None, "", " \n\t", ".", "a", "A b", "Same text here", "Same text here", "Éa ß \U0001f600 naïveté", LONG, "don't stop; STOP 12x", "\x00\x85\xa0é", "wordzebra wordzebra wordzebrá wordzebr"]


@pytest.fixture(scope="module")
def edge(spark):
    """Nulls, empty and very long texts, repeated rows, rows without a key, and extra columns with clashing names."""
    rows = [(i, t) for i, t in enumerate(EDGE)] + [(6, EDGE[6]), (None, EDGE[5]), (None, EDGE[12])]
    extra = ["score", "rank", "word", "n", "row", "train", "units", "doc", "item", "n_tokens", "form"]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumns({c: F.lit("mine") for c in extra})


def docs_of(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def test_runs_in_pieces():
    rng = np.random.default_rng(1)
    table = letters(lambda c: c >= 128 or 97 <= c <= 122)
    for n in (0, 1, 50, 3000):
        text = bytes(rng.choice(list(b"abZ .\n\xc3\xa9"), n).astype(np.uint8))
        want = text.translate(table).split()
        assert [w for part in runs(text, table, 40) for w in part] == want
    assert [len(p) for p in runs(b"a" * 500, table, 40)] == [1]  # a run is never cut


# ---- Lexical search


def ranked(docs, items, k=10):
    own = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    terms = [(d, Counter(own(t))) for d, t in docs]
    n_docs, total = sum(1 for _, c in terms if c), sum(sum(c.values()) for _, c in terms)
    df = Counter(w for _, c in terms for w in c)
    wanted = {}
    for i, t in items:
        wanted.setdefault(i, set()).update(own(t))
    out = []
    for i, words in wanted.items():
        scores = []
        for d, c in terms:
            if n := sum(c.values()):
                m = 100 - 90 + (90 * n * n_docs) // total
                s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((1_000_000_000 * c[w]) // (1000 * c[w] + 8 * m)) for w in words if w in c)
                if s > 0:
                    scores.append((-s, d is None, d))
        out += [(i, r, d, -s) for r, (s, _, d) in enumerate(sorted(scores, key=lambda x: x[:2] + (x[2] or 0,))[:k], 1)]
    return out


def test_radix_order():
    rng = np.random.default_rng(3)
    for most in (0, 9, 1 << 16, 1 << 20, 1 << 40):
        keys = rng.integers(0, most + 1, 500)
        assert (lexical.radix(keys, most) == np.argsort(keys, kind="stable")).all()


@pytest.mark.parametrize("block, step", [(lexical.BLOCK, lexical.STEP), (3, 2)])
def test_lexical_edges(spark, edge, monkeypatch, block, step):
    monkeypatch.setattr(lexical, "BLOCK", block)
    monkeypatch.setattr(lexical, "STEP", step)
    items = [(1, "Same stop É word5"), (2, None), (3, ""), (4, "a b a A"), (None, "text"), (4, "here same"), (7, LONG)]
    table = spark.createDataFrame(items, "item_id long, text string")
    for k in (1, 10):
        got = lexical.rank(edge, table, k=k).collect()
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, ranked(docs_of(edge), items, k)))
    assert lexical.rank(edge.limit(0), table).count() == 0 and lexical.rank(edge, table.limit(0)).count() == 0
    named = spark.createDataFrame([("x", "same")], "item_id string, text string")
    assert [r["item_id"] for r in lexical.rank(edge, named, k=1).collect()] == ["x"]


# ---- Spelling variants


def within_one(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    p = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[p + (len(a) >= len(b)) :] == b[p + (len(a) <= len(b)) :]


def varied(docs, length=7, times=2):
    n = Counter()
    for d, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    words = {w: c for w, c in n.items() if len(w) >= length and c >= times}
    form, near = {}, {}
    for w in words:
        found = [x for x in words if within_one(w, x)]
        near[w] = len(found)
        best = min(found, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= 10 * words[w] else None
    out = []
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, words[w], near[w], words[form[w]] if form[w] else None))
    return out


@pytest.mark.parametrize("alphabet, size", [("ab", 5), ("abé", 6)])
def test_trie_accepts_what_is_one_edit_away(alphabet, size):
    rng = np.random.default_rng(size)
    words = sorted({"".join(rng.choice(list(alphabet), rng.integers(size - 2, size + 2))) for _ in range(200)})
    trie = spelling.Trie(words)
    for w in words + ["", "c" * size]:
        for keep in (0, len(w) // 2, len(w)):
            want = {i for i, x in enumerate(words) if within_one(w, x) and x[:keep] == w[:keep]}
            assert trie.near(w, keep) == want


@pytest.mark.parametrize("shard", [spelling.SHARD, 2])
def test_spelling_edges(spark, edge, monkeypatch, shard):
    monkeypatch.setattr(spelling, "SHARD", shard)
    rng = np.random.default_rng(5)
    base = ["wordings", "wordzebra", "lettersé", "aaaaaaa"]
    more = []
    for i in range(400):
        w = list(base[i % 4])
        for _ in range(rng.integers(0, 3) if i % 5 == 0 else 0):
            at = rng.integers(0, len(w))
            w[at : at + rng.integers(0, 2)] = rng.choice(list("abéw"), rng.integers(0, 2))
        more.append((i + 100, " ".join(["".join(w)] * int(rng.integers(1, 3)))))
    docs = edge.select("doc_id", "text", "word", "n", "form").unionByName(spark.createDataFrame(more, "doc_id long, text string"), allowMissingColumns=True)
    got = sorted(map(str, map(tuple, spelling.variants(docs).collect())))
    assert got == sorted(map(str, varied(docs_of(docs)))) and len(got) > 12
    chained = [r for r in spelling.variants(docs).collect() if r["form"]]
    assert chained
    assert spelling.variants(edge.limit(0)).count() == 0


def test_roots_of_long_chains(spark):
    forms = [(f"w{i:02}", f"w{i + 1:02}") for i in range(18)]
    got = {r["word"]: r["root"] for r in spelling.roots(spark.createDataFrame(forms, "word string, form string")).collect()}
    assert got == {w: "w18" for w, _ in forms}


# ---- Language model


def test_gradients_by_differences():
    rng = np.random.default_rng(7)
    units, width = 2 * recurrent.CLASS + recurrent.OTHERS, 5
    m = recurrent.Model.new(np.ones(2 + recurrent.OTHERS), np.ones((2, recurrent.CLASS)), units, width)
    m.values = {k: v.astype(np.float64) + rng.standard_normal(v.shape) * 0.3 for k, v in m.values.items()}
    given, told = rng.integers(0, units, (6, 3)), rng.integers(0, units, (6, 3))
    keep = np.ones((6, 3))
    keep[0], keep[3, 1] = 0, 0

    def loss():
        states, kept = m.forward(given, keep, np.zeros((3, width)))
        lp, grads, back = m.output(states.reshape(-1, width).astype(np.float64), told.ravel(), told.size)
        own, grads["state"] = m.backward(kept, keep, back.reshape(states.shape))
        grads["input"] = np.zeros_like(m.values["input"])
        np.add.at(grads["input"], given.ravel(), own.reshape(-1, 3 * width))
        return -lp.mean(), grads

    _, grads = loss()
    for name, g in grads.items():
        flat = np.argsort(-np.abs(g).ravel())[:3]
        for at in flat:
            old = m.values[name].ravel()[at]
            out = []
            for step in (1e-2, -1e-2):
                m.values[name].reshape(-1)[at] = old + step
                out.append(loss()[0])
            m.values[name].reshape(-1)[at] = old
            assert abs((out[0] - out[1]) / 2e-2 - g.ravel()[at]) < 1e-3 + 0.02 * abs(g.ravel()[at]), name


def test_texts_side_by_side_are_whole():
    """Lanes, windows and carried states give each text what it gets alone, step by step."""
    rng = np.random.default_rng(8)
    units = recurrent.CLASS + recurrent.OTHERS
    m = recurrent.Model.new(np.ones(1 + recurrent.OTHERS), np.ones((1, recurrent.CLASS)), units, 8)
    m.values = {k: v + rng.standard_normal(v.shape).astype(np.float32) * 0.3 for k, v in m.values.items()}
    texts = [np.r_[rng.integers(1, units, n), 0].astype(np.uint16) for n in (0, 1, 5, 40, 700, 3, 31, 32, 33)]
    together = recurrent.log_likelihood(m, texts, 0)
    for t, got in zip(texts, together):
        h, total, before = np.zeros((1, 8), np.float32), 0.0, 0
        for u in t:
            states, _ = m.forward(np.array([[before]]), np.ones((1, 1), np.float32), h)
            h, before = states[0], u
            total += float(m.output(h, np.array([u]).astype(np.int32))[0][0])
        assert abs(total - got) < 1e-3 + 1e-5 * abs(total)


def test_distribution_is_whole():
    """Classes and words within them add up to 1."""
    rng = np.random.default_rng(9)
    m = recurrent.Model.new(np.arange(2 + recurrent.OTHERS), rng.integers(0, 5, (2, recurrent.CLASS)), 2 * recurrent.CLASS + recurrent.OTHERS, 8)
    every = np.arange(2 * recurrent.CLASS + recurrent.OTHERS)
    h = np.repeat(rng.standard_normal((1, 8)).astype(np.float32), len(every), 0)
    assert abs(np.exp(m.output(h, every)[0].astype(float)).sum() - 1) < 1e-4


def plain_base(docs, train):
    own = [(d, re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + ["\n"]) for d, t in docs]
    c = Counter(w for d, ws in own if train(d) for w in ws)
    n, v = sum(c.values()), len(c)
    return sorted((str(d), len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), 4)) for d, ws in own)


@pytest.mark.parametrize("top", [recurrent.TOP, 40])
def test_lm_edges(spark, edge, monkeypatch, top):
    monkeypatch.setattr(recurrent, "TOP", top)
    got = recurrent.score(edge, F.col("doc_id") % 3 != 1).collect()
    want = plain_base(docs_of(edge), lambda d: d is not None and d % 3 != 1)
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in got) == want
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)
    alike = {r["score"] for r in got if r["doc_id"] in (0, 1, 2)}  # null, empty, blank: the end alone
    assert max(alike) - min(alike) < 1e-4
    untaught = recurrent.score(edge, F.lit(False)).collect()
    assert {(r["n_known"], r["train_tokens"]) for r in untaught} == {(0, 0)} and all(math.isfinite(r["score"]) for r in untaught)
    assert recurrent.score(edge.limit(0), F.lit(True)).count() == 0


def test_lm_beats_counts(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = remainder(F.col("doc_id"), 5) == 1
    scored = recurrent.score(docs, ~held)
    rows = scored.join(docs.select("doc_id", held.alias("held")), "doc_id").where("held").collect()
    bits = lambda c: -sum(r[c] for r in rows) / sum(r["n_tokens"] for r in rows) / math.log10(2)
    assert bits("score") < bits("base_score") - 0.7
    assert np.mean([r["score"] > r["base_score"] for r in rows]) > 0.85


def test_learning_tells_every_step(monkeypatch):
    """No unit of a text is left out of the losses that are learned from."""
    rng = np.random.default_rng(10)
    units = recurrent.CLASS + recurrent.OTHERS
    m = recurrent.Model.new(np.ones(1 + recurrent.OTHERS), np.ones((1, recurrent.CLASS)), units, 8)
    texts = [np.r_[rng.integers(1, units, n), 0].astype(np.uint16) for n in (0, 1, 15, 16, 17, 40, 300)]
    told, output = [], recurrent.Model.output
    monkeypatch.setattr(recurrent.Model, "output", lambda self, states, units, learn=0: told.extend(units.tolist()) or output(self, states, units, learn))
    recurrent.learn(m, texts, 0)
    assert Counter(told) == Counter(np.concatenate(texts).tolist())


def test_a_long_text_costs_its_own_units():
    """Lanes are not filled up to the longest of them, in memory or in work, and each unit is told once, where it belongs."""
    rng = np.random.default_rng(11)
    units = recurrent.CLASS + recurrent.OTHERS
    m = recurrent.Model.new(np.ones(1 + recurrent.OTHERS), np.ones((1, recurrent.CLASS)), units, 8)
    texts = [np.r_[rng.integers(1, units, n), 0].astype(np.uint16) for n in (20_000, *[3] * 2000)]
    laid = recurrent.side_by_side(texts, 1024, True)
    told = Counter()
    for given, tell, which, going, real in recurrent.windows(*laid, 0, 16):
        assert not given[going == 0].any() and real.any(axis=0).all()
        told.update(zip(which[real].tolist(), tell[real].tolist()))
    assert told == Counter((i, int(u)) for i, t in enumerate(texts) for u in t)
    tracemalloc.start()
    recurrent.log_likelihood(m, texts, 0)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 30e6  # 28,001 units


def test_logits_beyond_bounds():
    """Large weights give finite scores and gradients, and whole distributions."""
    rng = np.random.default_rng(12)
    units = 2 * recurrent.CLASS + recurrent.OTHERS
    m = recurrent.Model.new(np.ones(2 + recurrent.OTHERS), np.ones((2, recurrent.CLASS)), units, 8)
    m.values = {k: v + rng.standard_normal(v.shape).astype(np.float32) * 300 for k, v in m.values.items()}
    texts = [np.r_[rng.integers(1, units, n), 0].astype(np.uint16) for n in (5, 40)]
    with np.errstate(all="raise", under="ignore"):
        assert np.isfinite(recurrent.log_likelihood(m, texts, 0)).all()
        recurrent.learn(m, texts, 0)
    assert all(np.isfinite(v).all() for v in m.values.values())


@pytest.mark.parametrize("block", [recurrent.BLOCK, 40])
def test_words_of_blocks(monkeypatch, block):
    """All words of all texts with an end behind each, wherever blocks are cut."""
    monkeypatch.setattr(recurrent, "BLOCK", block)
    rng = np.random.default_rng(13)
    texts = [(t or "").encode() for t in EDGE[:-1]] + [bytes(rng.choice(list(b"abZ \t\n\xc3\xa9"), n).astype(np.uint8)) for n in (0, 1, 39, 40, 41, 3000)]
    want = [w for t in texts for w in [*t.translate(recurrent.TABLE).split(b" "), recurrent.END] if w]
    cut = list(recurrent.blocks(pa.array(texts, pa.binary())))
    found = [recurrent.words_of(b) for b in cut]
    assert [w.as_py() for own, _ in found for w in own] == want
    assert [h for _, heads in found for h in heads.tolist()] == [w[0] * 256 + w[1] if len(w) > 1 else 65536 + w[0] for w in want]
    assert (len(cut) == 1) == (block > 40) and [w.as_py() for w in recurrent.words_of(b" ")[0]] == []


class Caught:
    """Stands for a table and keeps the function that would run in its tasks."""

    schema = {"key": SimpleNamespace(dataType=SimpleNamespace(simpleString=lambda: "bigint"))}

    def __getattr__(self, name):
        return lambda *a: self

    def mapInArrow(self, make, schema):
        self.make = make
        return self


def test_tasks_work_in_blocks(spark, edge, monkeypatch):
    """Counts and marks are whole when few words are held and texts go through many blocks, several or parts of one in each."""
    docs = docs_of(edge)
    texts = pa.array([(t or "").encode() for _, t in docs], pa.binary())
    words = recurrent.Words(recurrent.counted(edge.where("doc_id % 3 != 1"), "text"))
    seen = []
    for block, held in ((recurrent.BLOCK, recurrent.HELD), (300, 100)):
        monkeypatch.setattr(recurrent, "BLOCK", block)
        monkeypatch.setattr(recurrent, "HELD", held)
        recurrent.counted(counts := Caught(), "text")
        recurrent.marked(marks := Caught(), "doc_id", "text", F.lit(True), words)
        told = Counter()
        for b in counts.make(iter([pa.record_batch([texts], names=["bytes"]), pa.record_batch([texts[:0]], names=["bytes"])])):
            for r in b.to_pylist():
                told[r["word"]] += r["c"]
        rows = [r for b in marks.make(iter([pa.record_batch([pa.array(range(len(docs))), texts], names=["row", "bytes"])])) for r in b.to_pylist()]
        seen.append((told, rows))
    own = [[w for w in t.as_py().translate(recurrent.TABLE).split(b" ") if w] + [recurrent.END] for t in texts]
    for told, rows in seen:
        assert told == Counter(w for ws in own for w in ws)
        for ws, r in zip(own, rows):
            strange = Counter(w for w in ws if w not in words.count)
            unit = [words.unit.get(w, words.head.get(w[: recurrent.HEAD], words.rest)) for w in ws]
            assert np.frombuffer(r["units"], "<u2").tolist() == unit and dict(zip(r["rare"], r["times"])) == strange
            assert (r["n_tokens"], r["n_top"]) == (len(ws), len(ws) - sum(strange.values()))
            known = [(math.log10(words.count[w] + 0.5), u >= words.frequent) for w, u in zip(ws, unit) if w in words.count]
            assert math.isclose(r["top_log"], sum(a for a, _ in known)) and math.isclose(r["top_rare_log"], sum(a for a, k in known if k), abs_tol=1e-9)
