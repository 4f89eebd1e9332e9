"""The training-data operators against brute force, exact round trips and held-out accuracy."""

import hashlib
import io
import math
import struct
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from lamella.llm import chat, common, counting, embeddings, langid, media, mixing, oracle, packing, queries, simhash, tokens, toxicity, urls
from lamella.llm.common import components, table

LONG = " ".join(f"word{i % 977}" for i in range(60_000))
EDGE = [None, "", " \n\t", ".", "a", "A b", "Same text here", "Same text here", "Éa ß \U0001f600", LONG]
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows and clashing extra columns."""
    rows = [(i, t, "en" if i % 2 else None, f"s{i % 3}" if i % 4 else None, None) for i, t in enumerate(EDGE)]
    rows += [rows[6], (None, "Same text here", None, None, 3)]
    extra = ["score", "predicted", "size", "lang_pred", "fingerprint", "component_id", "copies", "leaf_chars", "target", "sequence_id"]
    return spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("mine") for c in extra})


@pytest.fixture(scope="session")
def none(edge):
    return edge.limit(0)


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    return table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source")


@pytest.fixture(scope="session")
def texts(docs):
    return {r["doc_id"]: r for r in docs.collect()}


@pytest.fixture(scope="session")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.default_path())


# ---- Shared parts


def test_components(spark):
    rng = np.random.default_rng(0)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(60)] + [tuple(map(int, rng.integers(200, 300, 2))) for _ in range(60)] + [(5, 5)]
    got = {r[0]: r[1] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {x: x for e in edges for x in e}
    for _ in range(300):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: root[x] for x in linked}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_encoder_equals_tokenizer(tokenizer):
    rng = np.random.default_rng(2)
    parts = list("aB.,'s<|>é É̌Jj1९ _-\n\t\x1c\x85\xa0ßİΣς…​中") + ["<|endoftext|>", "don't", "ﬁ", "<|ENDOFTEXT|>"]
    many = ["".join(rng.choice(parts, rng.integers(0, 40))) for _ in range(3000)] + [t for t in EDGE if t]
    want = [e.ids for e in tokenizer.encode_batch(many, add_special_tokens=False)]
    small = tokens.Encoder(tokens.default_path())
    got = [x for i in range(0, len(many), 100) for x in small.ids(many[i : i + 100])]
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == want


def test_other_tokenizers_encode_plainly():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    e, plain = tokens.Encoder(path), Tokenizer.from_file(path)
    assert tokens.chunkable(tokens.default_path()) and not e.chunked
    many = ["Hello  World. don't, \n\n stop", "", "ÀB c", "x" * 300]
    assert [np.frombuffer(x, "<u4").tolist() for x in e.ids(many)] == [plain.encode(t, add_special_tokens=False).ids for t in many]


def test_encoder_forgets_and_stays_right(tokenizer, monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_CHARS", 200)
    e = tokens.Encoder(tokens.default_path())
    for i in range(50):
        t = [f"word{i} again, shared Words{i}."]
        assert np.frombuffer(e.ids(t)[0], "<u4").tolist() == tokenizer.encode(t[0], add_special_tokens=False).ids
    assert len(e.known) + len(e.older) < 100


def test_shared_folder_is_refused_on_a_cluster():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(RuntimeError, match="checkpoint.dir"):
        common.shared_folder(Session())


def test_scratch_removes_what_was_stored(spark):
    kept = common.stored(spark.range(3))
    with common.scratch(spark):
        gone = common.stored(spark.range(5))
        assert gone.count() == 5
    assert kept.count() == 3
    with pytest.raises(Exception, match="(?i)exist|not found"):
        spark.read.parquet(gone.inputFiles()[0]).count()


def test_lowest_counts_a_hash_once(spark):
    df = spark.range(40_000).select((F.col("id") % 2).alias("g"), F.when(F.col("id") % 2 == 0, F.lit(7)).otherwise(F.xxhash64("id")).alias("h"))
    got = {}
    for g, h in common.lowest(df, 10, ["g"]).collect():
        got.setdefault(g, []).append(h)
    every = sorted(r[0] for r in df.where("g = 1").select("h").collect())
    assert got[0] == [7] and sorted(got[1]) == every[:10]


# ---- 1 Packing


def check_packing(rows, ids, copies=None):
    """Every id in one piece, offsets gapless, sequences within the capacity; returns tokens of padding."""
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    for key, pieces in by_doc.items():
        want, cover = np.array(ids[key], "<u4"), np.zeros(len(ids[key]), int)
        for p in pieces:
            cover[p["start"] : p["start"] + p["length"]] += 1
            assert bytes(p["ids"]) == want[p["start"] : p["start"] + p["length"]].tobytes()
            assert p["doc_tokens"] == len(want) and len(p["ids"]) == 4 * p["length"]
        assert (cover == cover[0]).all() and cover[0] == (copies or {}).get(key, 1)
    assert set(by_doc) == set(ids)
    padding = 0
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 2048
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    return padding


def test_packing(docs, texts, tokenizer):
    want = {k: tokenizer.encode(r["text"] or "", add_special_tokens=False).ids + [1] for k, r in texts.items()}
    rows = packing.pack(docs).collect()
    assert check_packing(rows, want) <= 0.02 * sum(map(len, want.values()))


def test_packing_query(spark, sf_dir, texts, tokenizer):
    ids = {k: np.array(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids + [1], "<u4") for k, r in texts.items()}
    for r in queries.op1_packing(spark, sf_dir).collect():
        own = ids[r["doc_id"]]
        assert r["ids_crc32"] == zlib.crc32(own[r["start"] : r["start"] + r["length"]].tobytes()) and r["doc_tokens"] == len(own)


def test_packing_edges(edge, none, tokenizer):
    rows = packing.pack(edge.repartition(3)).collect()
    want = {k: tokenizer.encode(t or "", add_special_tokens=False).ids + [1] for k, t in enumerate(EDGE)}
    check_packing(rows, want | {None: want[6]}, {6: 2})
    assert packing.pack(none).count() == 0


def test_cuts_waste_little():
    for n in range(1, 5000):
        parts = packing.cuts(n)
        assert sum(parts) == n
        assert all(2048 - (2048 // p) * p <= 0.02 * 2048 for p in parts)


# ---- 2 Language identification


def test_language_held_out(spark, sf_dir, texts):
    rows = [r for r in queries.op2_language_id(spark, sf_dir).collect() if r["held_out"]]
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1 for r in rows)
    assert np.mean([r["lang_pred"] == texts[r["doc_id"]]["lang"] for r in rows]) > 0.99


def test_code_lengths_equal_a_plain_model():
    texts = {"x": [b"abracadabra", b"banana band"], "y": [b"zigzag zip", b"cadabra"]}
    model = langid.Model(texts)

    def bits(lang, text):
        total = 0.0
        for i in range(len(text)):
            for order in range(3, -2, -1):
                if order > i:
                    continue
                if order == -1:
                    total += 8
                    break
                seen = Counter(t[j] for t in texts[lang] for j in range(order, len(t)) if t[j - order : j] == text[i - order : i])
                if not seen:
                    continue
                n, kinds = sum(seen.values()), len(seen)
                if text[i] in seen:
                    total -= math.log2(seen[text[i]] / (n + kinds))
                    break
                total -= math.log2(kinds / (n + kinds))
        return total

    tests = [b"", b"a", b"abrazip", b"qqq banana", b"zag cadabra band"]
    got = model.lengths([np.frombuffer(t, np.uint8) for t in tests])
    assert np.allclose(got, [[bits(lang, t) for lang in ("x", "y")] for t in tests], atol=1e-3)


def test_language_query_equals_a_plain_model(spark):
    """All texts of the smallest tables teach, so the sample is all of them; scores are those of a plain context tree."""
    sf_dir = "/root/testdata/sf0.001"
    rows = table(spark, sf_dir, "documents", "doc_id", "text", "lang").collect()
    train: dict = {}
    for r in {(r["doc_id"], r["text"], r["lang"]): r for r in rows}.values():
        if zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1 and r["lang"] and r["text"] and len(r["text"].encode()) <= langid.LONGEST:
            train.setdefault(r["lang"], []).append(r["text"].lower().encode())
    assert max(map(len, train.values())) <= langid.SAMPLE
    counts = {k: Counter(t[i - o : i + 1] for t in texts for o in range(4) for i in range(o, len(t))) for k, texts in train.items()}
    seen = {k: {} for k in counts}
    for k, c in counts.items():
        for g, n in c.items():
            total, kinds = seen[k].get(g[:-1], (0, 0))
            seen[k][g[:-1]] = (total + n, kinds + 1)

    def bits(k, t):
        out = 0.0
        for i in range(len(t)):
            for o in range(min(3, i), -1, -1):
                if (context := t[i - o : i]) in seen[k]:
                    total, kinds = seen[k][context]
                    if n := counts[k].get(t[i - o : i + 1]):
                        out -= math.log2(n / (total + kinds))
                        break
                    out -= math.log2(kinds / (total + kinds))
            else:
                out += 8
        return out

    texts = {r["doc_id"]: r["text"] for r in rows}
    for r in queries.op2_language_id(spark, sf_dir).collect()[::4]:
        t = texts[r["doc_id"]]
        length = {k: bits(k, t.lower().encode()) for k in sorted(train)}
        best = min(length, key=length.get)
        assert r["lang_pred"] == best
        assert math.isclose(r["score"], 1 / sum(2 ** max(length[best] - x, -1000) for x in length.values()), rel_tol=1e-2)


@pytest.mark.parametrize("n", [150, 600, 6000])
@pytest.mark.parametrize("key", ["null", "1", "id"])
def test_language_sample_at_every_size(spark, n, key):
    """Rows without a key, or with one key, teach like any others, however many there are."""
    docs = spark.range(n).select(F.expr(f"cast({key} as long)").alias("doc_id"), F.concat(F.lit("some words here "), "id").alias("text"), F.lit("en").alias("lang"))
    model = langid.train(docs, sample=150)
    assert model.langs == ["en"] and {r[0] for r in langid.identify(docs, model).select("lang_pred").distinct().collect()} == {"en"}
    assert langid.train(docs.withColumn("text", F.lit("all the same")), sample=150).langs == ["en"]


def test_language_fits(spark, docs):
    model = langid.train(docs)
    rng = np.random.default_rng(4)
    odd = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz "), 400)), "это русский текст о погоде " * 9, "中文文本" * 30]
    got = langid.identify(spark.createDataFrame([(i, t) for i, t in enumerate(odd)], "doc_id long, text string"), model).collect()
    assert not any(r["fits"] for r in got)
    assert langid.identify(docs, model).where("not fits").count() == 0


def test_blocks_do_not_change_code_lengths(monkeypatch):
    model = langid.Model({"x": [b"abc abd abe"], "y": [b"xyz xyy"]})
    tests = [np.frombuffer(t, np.uint8) for t in (b"abcabcabcab", b"", b"xyzxyzxyzxyzxyz", b"a")]
    whole = model.lengths(tests)
    monkeypatch.setattr(langid, "BLOCK", 4)
    assert np.allclose(model.lengths(tests), whole, atol=1e-4)


def test_language_edges(edge, none, docs):
    model = langid.train(docs)
    rows = langid.identify(edge, model).collect()
    assert {r["doc_id"] for r in rows if r["lang_pred"] == "und"} == {0, 1, 2, 3}
    assert all(0 <= r["score"] <= 1 for r in rows) and len(rows) == len(EDGE) + 2
    assert langid.identify(none, model).count() == 0
    assert langid.train(none) is None and {r["lang_pred"] for r in langid.identify(edge, None).collect()} == {"und"}


# ---- 3 Embeddings


def vectors_table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, kept string")


def test_embeddings_against_all_pairs(spark, monkeypatch):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(60, 64))
    rows = [b + rng.normal(size=64) * s for b in base for s in (0, 0.1, 0.12, 0.15)] + [base[0]] * 40
    x = np.array(rows, np.float32)
    labels = [int(v) for v in rng.integers(0, 3, len(x))]
    data = [(i, v.tolist(), y, None) for i, (v, y) in enumerate(zip(x, labels))]
    data += [(900, None, 1, None), (901, [0.0] * 64, 1, None), (902, [float("nan")] + [1.0] * 63, 1, None), (903, x[0].tolist(), None, None), (904, [None] + [1.0] * 63, 1, None)]
    monkeypatch.setattr(embeddings, "BLOCK", 32)
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embeddings.near_duplicates(vectors_table(spark, data)).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    link = (u @ u.T >= 0.98) & (np.array(labels)[:, None] == np.array(labels)[None])
    np.fill_diagonal(link, False)
    root = np.arange(len(x))
    for _ in range(len(x)):
        root = np.minimum(root, np.where(link, root[None], len(x)).min(axis=1))
    want = {i: (int(link[i].sum()), int(root[i]), bool(root[i] == i)) for i in range(len(x))}
    assert got == want | {i: (0, i, True) for i in range(900, 905)}


def test_embeddings_of_repeated_and_missing_keys(spark):
    rng = np.random.default_rng(8)
    a, b, c = (rng.normal(size=64).tolist() for _ in range(3))
    near = (np.array(a) + rng.normal(size=64) * 0.01).tolist()
    rows = [(1, a, 5, "x"), (1, b, 5, "x"), (2, near, 5, "x"), (None, a, 5, "x"), (None, c, 5, "x"), (7, c, 6, "x"), (7, c, 6, "x")]
    got = embeddings.near_duplicates(vectors_table(spark, rows)).collect()
    seen = sorted((r["vec_id"] or 0, r["embedding"][0], r["n_links"], r["component_id"], r["kept"]) for r in got)
    f = lambda v: float(np.float32(v[0]))
    want = [(1, f(a), 2, 1, True), (1, f(b), 0, 1, True), (2, f(near), 2, 1, False), (0, f(a), 2, 1, False), (0, f(c), 0, None, False)]
    assert seen == sorted([*want, (7, f(c), 1, 7, True), (7, f(c), 1, 7, True)], key=lambda r: r[:3])


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(5)
    u = rng.normal(size=(400, 64))
    u /= np.linalg.norm(u, axis=1)[:, None]
    turn = embeddings.rotation(64)
    code, factor = embeddings.codes(u, turn)
    q = embeddings.Queries(u, turn)
    got = q.products(code, 0, len(u)) / factor[None]
    error = (got - u @ u.T)[~np.eye(len(u), dtype=bool)]
    assert abs(error.mean()) < 0.005
    bound = embeddings.EPSILON * (np.sqrt(1 - factor**2) / factor / np.sqrt(63)).mean()
    assert np.abs(error).max() < bound


def test_embeddings_empty(spark):
    assert embeddings.near_duplicates(vectors_table(spark, [])).count() == 0


# ---- 4 Token counts


def test_counts_follow_edits(spark, tokenizer):
    rng = np.random.default_rng(6)
    text = " ".join("".join(rng.choice(list("abc.'é1"), rng.integers(1, 9))) for _ in range(3000))
    cases = [text, "", "one", "  lead and trail  ", LONG]
    todo = []
    for t in cases:
        todo.append([(int(rng.integers(-2, len(t) + 9)), int(rng.integers(0, 30)), str(rng.choice(["", " ", "x", " new words here ", "é.", "w " * 400]))) for _ in range(30)])
    df = spark.createDataFrame([(i, t, e, "mine") for i, (t, e) in enumerate(zip(cases, todo))], "doc_id long, text string, edits array<struct<start:long,length:long,text:string>>, n_tokens string")
    rows = {r["doc_id"]: r for r in counting.apply_edits(counting.plant(df), F.col("edits")).collect()}
    for i, (t, edits) in enumerate(zip(cases, todo)):
        for s, n, new in edits:
            s = min(max(s, 0), len(t))
            t = t[:s] + new + t[s + n :]
        assert rows[i]["text"] == t and rows[i]["n_tokens"] == len(tokenizer.encode(t, add_special_tokens=False).ids)
        assert sum(rows[i]["leaf_chars"]) == len(t) and sum(rows[i]["leaf_tokens"]) == rows[i]["n_tokens"]
    assert rows[4]["chars_encoded"] < 0.2 * len(LONG)


def test_count_edges(edge, none):
    e = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.lit(None).cast("long").alias("length"), F.lit(None).cast("string").alias("text")))
    rows = counting.apply_edits(counting.plant(edge), F.when(F.col("doc_id") > 4, e)).collect()
    assert len(rows) == len(EDGE) + 2 and rows[0]["n_tokens"] == 0
    assert counting.plant(none).count() == 0


def test_count_query(spark, sf_dir, texts, tokenizer):
    for r in queries.op4_token_counts(spark, sf_dir).collect()[::10]:
        t = texts[r["doc_id"]]["text"]
        assert r["tokens_before"] == len(tokenizer.encode(t, add_special_tokens=False).ids)
        n = len(t)
        for s, k, new in ((n // 2, 0, " edited "), (n // 4, 5, ""), (0, 3, "New")):
            t = t[:s] + new + t[s + k :]
        assert (r["tokens_after"], r["chars_after"]) == (len(tokenizer.encode(t, add_special_tokens=False).ids), len(t))


# ---- 5 Toxicity


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_automaton_against_edit_distance():
    rng = np.random.default_rng(7)
    words, stems = ["cab", "abacus", "bacca", "abcabcabca", "aaaaa"], ["bbbb", "cacacac"]
    auto = toxicity.Automaton(words, stems)
    allow = lambda t: (len(t) >= toxicity.ONE) + (len(t) >= toxicity.TWO)
    for _ in range(4000):
        w = "".join(rng.choice(list("abcs"), rng.integers(1, 13)))
        want = [d for t in words if (d := distance(w, t)) <= allow(t)]
        want += [d for t in stems if (d := min(distance(w[:n], t) for n in range(len(w) + 1))) <= allow(t)]
        assert (auto.find(w) or (None,))[0] == min(want, default=None)


def test_toxicity_held_out(spark):
    sf_dir = "/root/testdata/sf0.1"  # the small tables have a handful of toxic documents in most languages
    labels = {r["doc_id"]: r["toxic"] for r in table(spark, sf_dir, "labels", "doc_id", "toxic").collect()}
    rows = [r for r in queries.op5_toxicity(spark, sf_dir).collect() if r["held_out"] and r["doc_id"] in labels]
    bad = [r["score"] for r in rows if labels[r["doc_id"]]]
    good = [r["score"] for r in rows if not labels[r["doc_id"]]]
    assert np.mean([(b > g) + 0.5 * (b == g) for b in bad for g in good]) > 0.9
    assert np.mean([r["predicted"] == labels[r["doc_id"]] for r in rows]) > 0.95


def test_misspelled_and_quoted_terms():
    m = toxicity.Model(["stupid", "worthless", "scum"], [])
    assert [m.lexicon.match(w) for w in ("stupid", "stup1d", "stuppid", "wrothless", "scam", "fine")] == [1, 2, 2, 3, 0, 0]
    plain, quoted = toxicity.features("you stupid thing", m.lexicon), toxicity.features('he said the word "stupid" aloud', m.lexicon)
    assert plain[0] > 0 and plain[4] == 0 and quoted[0] == 0 and quoted[4] > 0


def test_misspelled_stems(spark):
    m = toxicity.Model(["fool"], ["idiot"])
    assert [m.lexicon.match(w) for w in ("idiots", "idiiots", "id1otic", "ideas", "fool")] == [4, 5, 5, 0, 1]
    plain, bent = toxicity.features("you idiots", m.lexicon), toxicity.features("you idiiots", m.lexicon)
    assert len(bent) == toxicity.FEATURES and bent[-1] > 0 == plain[-1] and bent[3] == 0 < plain[3]
    bad = [(f"some text number x{i}y with idiot and idiots and more", 1) for i in range(40)]
    good = [(f"some text number z{i}w with nothing much and more", 0) for i in range(60)]
    words, stems = toxicity.lexicon_of(spark.createDataFrame(bad + good, "text string, toxic int"))
    assert "idio" in stems and {"idiot", "idiots"} <= set(words)
    found = toxicity.Lexicon(words, stems)
    assert all(found.match(w) > 0 for w in ("idiiot", "id1ot", "iidiot"))


def test_disguised_terms():
    m = toxicity.Model(["idiot", "stupid", "scum", "worthless"], [])
    seen = lambda t: toxicity.features(t, m.lexicon)
    for term in ("idi@t", "stup!d", "$cum", "$tupid", "st*pid", "stup_d", "w*rthl3ss", "$tup!d"):
        got = seen(f"you {term}, go")
        assert sum(x > 0 for x in got[1:3]) == 1 and got[0] == 0 and got[7] == np.log1p(1), term
    for clean in ("mail a@b.com or c$d", "snake_case *bold* words!", "hi!you", "$100 !wow"):
        assert not any(seen(clean)[:9]), clean
    assert seen("*stupid* and stupid!you")[0] == np.log1p(2) and seen("a stupid_thing")[:3] == seen("a stupid thing")[:3]
    quoted, told = seen('the "stup!d" here'), seen("someone said stup!d here")
    assert quoted[4] > 0 == quoted[1] and told[4] > 0 == told[1]


def test_words_of_any_length(spark):
    """Neither length nor the bound on what a worker remembers changes a match."""
    m = toxicity.Model(["stupid"], ["worthless"])
    for n in (0, 31, 32, 500, 100_000):
        assert m.lexicon.match("worthless" + "x" * n) == 4 and m.lexicon.match("worthlss" + "x" * n) == 5, n
    assert toxicity.features("a worthless" + "x" * 90, m.lexicon)[3] > 0
    few = toxicity.Lexicon(["stupid"], ["worthless"])
    words = ["stupid", "stuppid", "fine", "worthlessly", "stupif"] * 3
    want = [few.match(w) for w in words]
    many = toxicity.Automaton(["stupid"], ["worthless"])
    toxicity.STATES, kept = 3, toxicity.STATES
    try:
        few.automaton = many
        assert [few.match(w) for w in words] == want and len(many.states) < 60
    finally:
        toxicity.STATES = kept


def test_toxicity_of_repeated_keys(spark):
    bad = [(None if i % 2 else 1, f"text {i} with vilest word and more of {i}") for i in range(60)]
    good = [(2, f"text {i} about nothing in particular {i}") for i in range(3000)]
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    model = toxicity.train(spark.createDataFrame(bad + good, "doc_id long, text string"), labels, sample=500)
    assert model.weights is None or np.isfinite(model.weights).all()
    assert toxicity.Model(["stupid"], [], None, ["claims"]).lexicon.reports == {"claims"}


def test_toxicity_query_equals_plain_features(spark):
    """The query's scores from its lexicon and weights, with every match by edit distance and features counted plainly."""
    sf_dir = "/root/testdata/sf0.01"
    docs, labels = table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels", "doc_id", "toxic")
    model = toxicity.train(docs, labels.where(common.remainder(F.col("doc_id"), 5) != 0))
    allow = lambda t: (len(t) >= toxicity.ONE) + (len(t) >= toxicity.TWO)

    def kind(w):
        if len(w) < 3:
            return 0
        plain = w.translate(toxicity.LOOKALIKES)
        a = min((d for t in model.words if abs(len(t) - len(plain)) <= 2 and (d := distance(plain, t)) <= allow(t)), default=9)
        b = min((d for t in model.stems if (d := min(distance(plain[:n], t) for n in range(len(t) - 2, len(t) + 3))) <= allow(t)), default=9)
        if a == b == 9:
            return 0
        return max(a + 1, 1 if plain == w else 2) if a <= b else 4 if b == 0 and plain == w else 5

    got = {r["doc_id"]: r["score"] for r in queries.op5_toxicity(spark, sf_dir).collect()}
    seen = 0
    for r in docs.where("doc_id % 20 = 0").collect():
        low = (r["text"] or "").lower()
        if toxicity.SIGN.search(low):
            continue  # disguised words have a test of their own
        words = [(m.group(), m.start(), m.end()) for m in toxicity.LETTERS.finditer(low)]
        counts, bent, distinct = [0] * 5, 0, set()
        kinds = {w: kind(w) for w in {w for w, _, _ in words}}
        for i, (w, x, y) in enumerate(words):
            if k := kinds[w]:
                quoted = all(any(q in side for q in toxicity.QUOTES) for side in (low[max(x - 2, 0) : x], low[y : y + 2]))
                told = {v for v, _, _ in words[max(i - 8, 0) : i + 8]} & toxicity.REPORTS
                if quoted or told:
                    counts[4] += 1
                elif k == 5:
                    bent += 1
                else:
                    counts[k - 1] += 1
                distinct.add(w)
        n, sure = max(len(words), 1), sum(counts[:3])
        x = [*np.log1p(counts), counts[0] > 0, counts[1] + counts[2] > 0, *np.log1p([len(distinct), 1000 * sure / n, 1000 * counts[3] / n, n, bent])]
        assert math.isclose(got[r["doc_id"]], 1 / (1 + math.exp(-np.clip(np.dot(model.weights[:-1], x) + model.weights[-1], -30, 30))), rel_tol=1e-9)
        seen += 1
    assert seen > 20


def test_toxicity_edges(spark, edge, none):
    labels = spark.createDataFrame([(1, 1), (2, 0), (5, None), (6, 0), (6, 1), (None, 1)], "doc_id long, toxic int")
    for model in (toxicity.train(edge, labels), toxicity.train(edge, labels.limit(0)), toxicity.train(none, labels)):
        rows = toxicity.score(edge, model).collect()
        assert len(rows) == len(EDGE) + 2 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    assert toxicity.score(none, toxicity.Model([], [])).count() == 0


# ---- 6 Media


def samples():
    """A well-formed item of every kind that is easy to write."""
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", b"\0\0\0\1\0\0\0\1\x08\0\0\0\0") + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"")
    gif = b"GIF89a\1\0\1\0\x80\0\0" + b"\0" * 6 + b"\x2c\0\0\0\0\1\0\1\0\0\2\2\x44\1\0\x3b"
    bmp = b"BM" + struct.pack("<IIIIiiHHIIiiII", 58, 0, 54, 40, 1, 1, 1, 24, 0, 4, 0, 0, 0, 0) + b"\0\0\0\0"
    wav = b"RIFF" + struct.pack("<I", 40) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, 8000, 8000, 1, 8) + b"data\4\0\0\0abcd"
    jpeg = b"\xff\xd8\xff\xe0\0\4ab\xff\xc0\0\x0b\x08\0\1\0\1\1\1\x11\0\xff\xda\0\x08\1\1\0\0\x3f\0\x12\xff\0\x34\xff\xd9"
    import gzip
    import zipfile

    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("a.txt", "hello")
    ogg = b"OggS\0\6" + b"\0" * 8 + b"\1\0\0\0" + b"\0" * 8 + b"\1\3abc"
    mp4 = struct.pack(">I4s", 16, b"ftyp") + b"isom\0\0\0\1" + struct.pack(">I4s", 8, b"moov")
    pdf = b"%PDF-1.4\n1 0 obj\nendobj\nstartxref\n0\n%%EOF"
    return {
        "image/png": png, "image/gif": gif, "image/bmp": bmp, "audio/wav": wav, "image/jpeg": jpeg, "application/gzip": gzip.compress(b"hello" * 9),
        "application/zip": z.getvalue(), "audio/ogg": ogg, "video/mp4": mp4, "application/pdf": pdf,
    }


def test_sniffing_and_carving(spark):
    items = samples()
    rows = [(k, bytearray(v), "x/y") for k, v in items.items()] + [(f"cut {k}", bytearray(v[:-1]), k) for k, v in items.items()]
    rows += [(f"in {k}", bytearray(b"some text BM GIF89a " + v + b" tail"), None) for k, v in items.items()] + [("null", None, None), ("empty", bytearray(), "a")]
    df = spark.createDataFrame(rows, "name string, media binary, declared string")
    got = {r["name"]: r for r in media.sniff(df).collect()}
    for k, v in items.items():
        assert (got[k]["type"], got[k]["structure_bytes"], got[k]["corrected"]) == (k, len(v), True)
        assert got[f"cut {k}"]["structure_bytes"] == 0
        assert [tuple(c) for c in got[f"in {k}"]["carved"]] == [(k, 20, len(v))]
    assert got["null"]["type"] == got["empty"]["type"] == media.OTHER
    carved = {r["name"]: bytes(r["item"]) for r in media.carve(df).collect()}
    assert carved == {f"in {k}": v for k, v in items.items()}
    fixed = {r["name"]: r["declared"] for r in media.correct(df).collect()}
    assert fixed["image/png"] == "image/png" and fixed["null"] is None


def test_media_query(spark, sf_dir, texts):
    for r in queries.op6_media(spark, sf_dir).collect():
        raw = (texts[r["doc_id"]]["text"] or "").encode()
        payload = raw + b"\xff" * (max(math.ceil(len(raw) / 576), 1) * 576 - len(raw))
        assert (r["n_bytes"], r["payload_bytes"]) == (len(raw), len(payload))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-32:])
        head = b"RIFF" + struct.pack("<I", len(payload) + 36) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, 8000, 8000, 1, 8) + b"data" + struct.pack("<I", len(payload))
        assert r["media_sha256"] == hashlib.sha256(head + payload).hexdigest() and r["media_bytes"] == len(payload) + 44
        assert r["feature"].startswith(f"audio/wav;structure={len(payload) + 44};corrected=true;")


def test_false_beginnings_take_one_pass():
    import time

    for blob in (b"%PDF-1 " * 300_000, b"%PDF-1 " * 200_000 + b"%%EOF", b"PK\x03\x04" * 300_000, (b"OggS\0\2" + b"\0" * 21) * 60_000, b"\0\0\0\x08ftyp" * 200_000):
        began = time.perf_counter()
        assert media.scan(blob, media.automaton()) == []
        assert time.perf_counter() - began < 20


def test_read_back_of_no_media(spark):
    rows = [(None,), (bytearray(),), (bytearray(b"not a wave"),), (bytearray(samples()["image/png"]),), (bytearray(samples()["audio/wav"]),)]
    got = [(r["payload_bytes"], r["tail_crc32"]) for r in media.read_back(spark.createDataFrame(rows, "media binary")).collect()]
    assert got == [(None, None)] * 4 + [(4, zlib.crc32(b"abcd"))]


def test_media_edges(edge, none):
    """Nulls, empty and very long texts, repeated rows, clashing columns, an empty table."""
    stored = edge.withColumns({"media": media.wave(media.payload(F.col("text"))), "type": F.lit("mine"), "carved": F.lit("mine"), "declared": F.lit(None).cast("string")})
    rows = media.read_back(media.sniff(stored)).collect()
    assert len(rows) == len(EDGE) + 2 and all(r["type"] == "audio/wav" and r["corrected"] for r in rows)
    sizes = {r["doc_id"]: r["payload_bytes"] for r in rows}
    assert sizes[0] == sizes[1] == 576 and sizes[9] == -(-len(LONG) // 576) * 576
    assert media.read_back(media.sniff(stored.limit(0))).count() == media.sniff(none.withColumn("media", F.lit(None).cast("binary")), declared="lang").count() == 0


def test_payload_of_empty_texts(spark):
    df = spark.createDataFrame([(None,), ("",), ("x" * 576,)], "text string")
    assert [r[0] for r in df.select(F.octet_length(media.payload(F.col("text")))).collect()] == [576, 576, 576]


# ---- 7 Mixing


def fair_targets(sizes):
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, capped = float(sum(sizes.values())), {}
    while True:
        free = [s for s in order if s not in capped]
        over = [s for s in free if left * weight[s] / sum(weight[f] for f in free) > 3 * sizes[s]]
        if not over:
            return capped | {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
        for s in over:
            capped[s] = 3.0 * sizes[s]
            left -= capped[s]


@pytest.mark.parametrize("n", [1, 2, 3, 7])
def test_mixing(spark, n):
    rng = np.random.default_rng(n)
    rows = [(i, " ".join("w" * int(k) for k in rng.integers(1, 4, rng.integers(0, 60))), None if s == 3 else f"s{s}" if s % 2 else f"S{s}") for i, s in enumerate(rng.integers(0, n, 1500) ** 2 // max(n - 1, 1))]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.plan(df, spaced=True).collect()
    again = {r["doc_id"]: r["copies"] for r in mixing.plan(df.repartition(5), spaced=True).collect()}
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(t.split())
    want, taken = fair_targets(dict(sizes)), Counter()
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and math.isclose(r["target"], want[r["source"]], rel_tol=1e-9)
        assert 0 <= r["copies"] <= 3 and again[r["doc_id"]] == r["copies"]
        taken[r["source"]] += r["copies"] * r["size"]
    assert all(abs(taken[s] - t) <= 70 for s, t in want.items())
    for source in sizes:  # the number of copies is off by one at most, and larger documents have theirs as smaller ones
        own = [r for r in got if r["source"] == source]
        assert abs(sum(r["copies"] for r in own) - own[0]["rate"] * len(own)) < 1 + 1e-6 and {r["copies"] - int(r["rate"]) for r in own} <= {0, 1}
    assert mixing.mix(df, spaced=True).count() == sum(again.values())


def draws(key):
    return int(hashlib.md5(f"mix-0:{'' if key is None else key}".encode()).hexdigest()[:8], 16) / 2**32


@pytest.mark.parametrize(("cap", "weights", "few"), [(3, (5, 2, 1), 10_000), (6, (1, 9), 10_000), (3, (5, 2, 1), 0)])
def test_plain_draws(spark, monkeypatch, cap, weights, few):
    """Draws of their own; other caps and weights, and many sources, too."""
    monkeypatch.setattr(mixing, "FEW", few)
    rows = [(i, "w " * (i % 7), f"s{i % 3 if i % 5 else 0}") for i in range(400)]
    got = mixing.plan(spark.createDataFrame(rows, "doc_id long, text string, source string"), cap=cap, weights=weights).collect()
    assert len(got) == 400
    for r in got:
        rate = min(r["target"] / r["source_size"], cap)
        assert r["rate"] == rate and rate - int(rate) == r["fraction"]
        assert r["copies"] == int(rate) + (draws(r["doc_id"]) < rate - int(rate))
    sizes = {r["source"]: r["source_size"] for r in got}
    targets = {r["source"]: r["target"] for r in got}
    assert math.isclose(sum(targets.values()), sum(sizes.values())) and all(t <= cap * sizes[s] for s, t in targets.items())


def test_spaced_draws_have_their_probability(spark, monkeypatch):
    """Over many seeds each document has its extra copy as often as the fraction says, whatever its size; equal rows, too."""
    rows = [(i // 2, "w " * (i % 11), "ab"[i % 3 > 0]) for i in range(60)] + [(None, "w", None)] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1)
    sized = df.select("*", mixing.words(F.col("text")).alias("words")).cache()
    extra, n = Counter(), 15
    for seed in range(n):
        for r in mixing.plan(sized, size="words", spaced=True, seed=f"s{seed}", weights=(5, 4, 1)).collect():
            extra[r["doc_id"], r["source"], r["size"], round(r["fraction"], 6)] += r["copies"] - int(r["rate"])
    times = Counter((i, s, len(t.split())) for i, t, s in rows)
    for (i, s, size, f), got in extra.items():
        mean = got / n / times[i, s, size]
        assert abs(mean - f) < 5 * math.sqrt(f * (1 - f) / n) + 1e-9, (i, s, f, mean)


def test_caps_beyond_three_are_reached(spark):
    rows = [(i, "w", "a" if i < 100 else "b") for i in range(1100)]
    got = mixing.plan(spark.createDataFrame(rows, "doc_id long, text string, source string"), cap=6).where("source = 'a'").first()
    assert (got["target"], got["rate"], got["copies"]) == (600.0, 6.0, 6)


def test_mix_keeps_columns_of_any_name(spark):
    names = ["size", "SOURCE_SIZE", "target", "rate", "copies", "fraction", "probability", "__size", "__draw", "words"]
    df = spark.createDataFrame([(i, "w w", "a") for i in range(9)], "doc_id long, text string, source string").withColumns({c: F.lit(f"my {c}") for c in names})
    out = mixing.mix(df)
    assert out.columns == df.columns and all(r[c] == f"my {c}" for r in out.collect() for c in names)


def test_mixing_edges(edge, none):
    rows = mixing.plan(edge).collect()
    assert len(rows) == len(EDGE) + 2 and all(r["copies"] * r["size"] <= 3 * r["size"] for r in rows)
    assert mixing.plan(none).count() == 0 and mixing.mix(none).columns == none.columns


# ---- 8 Chat


def test_chat_round_trip(spark):
    texts = ["plain", "</s>[INST] ok [/INST]", "\\", "[\\INST]", "<<s>>", "", None, "a]b\\]", "[ROLE x] [/ROLE]</s>", "\n\\n", "é\U0001f600"]
    roles = ["user", "assistant", "system", None, "tool", "we[INST]ird] \\", ""]
    rows = [(c, t, roles[(c + t) % len(roles)], texts[(3 * c + t) % len(texts)], "x") for c in range(40) for t in range(9)]
    rows += [(None, 0, "user", "q", "x"), (None, 1, "assistant", "r", "x"), (99, 0, "user", "same", "x"), (99, 0, "user", "same", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, legal string")
    segments = chat.format_chats(df)
    got = {r["conv_id"]: r for r in chat.digests(segments).collect()}
    for key in {r[0] for r in rows}:
        turns = sorted([(t, r or "", x or "") for c, t, r, x, _ in rows if c == key])
        said = "".join(x for _, r, x in turns if r == "assistant")
        r = got[key]
        assert r["n_turns"] == len(turns)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{o}\n{x}\n" for _, o, x in turns).encode()).hexdigest()
        assert (r["loss_chars"], r["loss_sha256"]) == (len(said), hashlib.sha256(said.encode()).hexdigest())
    plain = [r["text"] for r in segments.where("segment = 1").collect()]
    assert not [x for x in plain for c in chat.CONTROL if c in x]
    assert got[None]["legal"] and not got[99]["legal"]
    assert chat.digests(chat.format_chats(df.limit(0))).count() == 0


def test_long_chats_and_broken_escapes(spark):
    texts = [LONG, "</s>" * 20_000, "\\" * 999]
    df = spark.createDataFrame([(1, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(texts)], "conv_id long, turn long, role string, text string")
    r = chat.digests(chat.format_chats(df)).first()
    assert r["turns_sha256"] == hashlib.sha256("".join(f"{'assistant' if i % 2 else 'user'}\n{t}\n" for i, t in enumerate(texts)).encode()).hexdigest()
    assert r["loss_sha256"] == hashlib.sha256(texts[1].encode()).hexdigest()
    broken = spark.createDataFrame([(1, "<s>[INST] ", False, True), (1, "a [/INST]</s> b", False, True), (1, " [/INST]</s>", False, True)], "conv_id long, text string, loss boolean, legal boolean")
    with pytest.raises(Exception, match="no turn"):
        chat.digests(broken.coalesce(1)).collect()


def test_turn_order(spark):
    for roles, ok in ((["system", "user", "assistant", "user"], True), (["assistant"], False), (["user", "user"], False), (["user", "assistant", "system"], False)):
        df = spark.createDataFrame([(1, i, r, "t") for i, r in enumerate(roles)], "conv_id long, turn long, role string, text string")
        assert chat.digests(chat.format_chats(df)).first()["legal"] is ok


# ---- 9 URLs


def test_urls_against_plain_rules(spark):
    rng = np.random.default_rng(9)
    hosts = ["net", "example.net", "a.example.net", "xexample.net", "EXAMPLE.com", "b.c.org", "org", "", "é.net", "ne.t"]
    paths = ["", "/", "/en/", "/en/x", "/EN/", "/de/1?x=/en/", "/fr/#a", "?q", "/d", "/de/"]
    cases = [None, "no scheme", "http://", "://net/x", "a://b://net/", *[f"http://{h}{p}" for h in hosts for p in paths]]
    cases += [f"x://{rng.choice(hosts)}{rng.choice(paths)}" for _ in range(50)]
    rules = [*queries.RULES, (None, "/", "block"), ("b.c.org", "", "block")]
    df = spark.createDataFrame([(i, u, "mine") for i, u in enumerate(cases)], "page_id long, url string, rule string")
    got = urls.judge(df, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()
    assert len(got) == len(cases)
    for r in got:
        rest = r["url"].split("://", 1)[1] if r["url"] and "://" in r["url"] else ""
        host = rest.split("/")[0].split("?")[0].split("#")[0]
        path = rest[len(host) :].split("?")[0].split("#")[0]
        host = "".join(c.lower() if c.isascii() else c for c in host)
        fit = [(h + p, v) for h, p, v in rules if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule, verdict = max(fit, key=lambda x: len(x[0]), default=(None, "allow"))
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, rule, verdict)


def test_listed_urls(spark):
    pages = spark.createDataFrame([(1, "https://www.a.com/x/?u=1#f"), (2, "http://a.com/x"), (3, "http://a.com/xy"), (4, "http://a.net/x")], "page_id long, url string")
    many = spark.range(5000).select(F.concat(F.lit("http://spam"), "id", F.lit(".com/p")).alias("url")).union(spark.createDataFrame([("http://A.com/x/",), ("http://a.net/x",), (None,)], "url string"))
    rules = spark.createDataFrame([("net", "/", "allow")], "host string, path string, verdict string")
    assert {r["page_id"]: r["verdict"] for r in urls.judge(pages, rules, many).collect()} == {1: "block", 2: "block", 3: "allow", 4: "allow"}
    assert urls.judge(pages, rules.limit(0)).where("verdict = 'allow'").count() == 4
    assert urls.judge(pages.limit(0), rules).count() == 0


def test_a_list_larger_than_an_array(spark, monkeypatch):
    """The filter grows with the list; beyond one array its blocks are rows. Either way the join decides."""
    pages = spark.range(3000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h"), F.col("id") % 50, F.lit(".com/p"), "id").alias("url"))
    listed = pages.where("page_id % 3 = 0").select("url")
    rules = spark.createDataFrame([("h7.com", "/p", "allow")], "host string, path string, verdict string")
    want = {i: "block" if i % 3 == 0 and i % 50 != 7 else "allow" for i in range(3000)}
    for most in (urls.BLOCKS, 8):
        monkeypatch.setattr(urls, "BLOCKS", most)
        assert {r["page_id"]: r["verdict"] for r in urls.judge(pages, rules, listed).collect()} == want
    keys = urls.listing(rules, listed)
    places = pages.select(F.concat(F.lit("h"), "page_id").alias("host"), F.lit("/other").alias("path"))
    passed = urls.possible(places, [urls.canonical(F.col("host"), F.col("path"))], keys).count()
    assert passed < 0.03 * 3000  # false positives


def test_url_edges(spark):
    """Repeated rows, a very long url, a host and path with most rows, clashing columns, nulls."""
    long = "http://a.net/" + "x/" * 50_000
    rows = [(1, long, "mine"), (1, long, "mine"), (2, None, "mine"), (None, "http://b.org/fr/", "mine")] + [(i, "http://hot.net/", "mine") for i in range(3, 500)]
    df = spark.createDataFrame(rows, "page_id long, url string, __answer string").withColumns({"Host": F.lit("mine"), "key": F.lit("mine")})
    rules = spark.createDataFrame(list(queries.RULES), "host string, path string, verdict string")
    got = urls.judge(df, rules, df.select("url")).collect()
    assert Counter((r["rule"], r["verdict"]) for r in got) == {("net/", "block"): 499, (None, "allow"): 1, ("org/fr/", "allow"): 1}
    assert all(r["__answer"] == r["key"] == "mine" and r["host"] != "mine" for r in got)
    assert all(r["path"] == long[12:] for r in got if r["page_id"] == 1)


# ---- 10 SimHash


def plain_print(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(max(len(words) - 2, 1))] if words else []
    h = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def brute_components(prints):
    values = sorted(set(prints.values()))
    v = np.array(values, np.uint64)
    near = np.bitwise_count(v[:, None] ^ v[None]) <= 2
    root = np.arange(len(v))
    while True:
        new = np.where(near, root[None], len(v)).min(axis=1)
        if (new == root).all():
            break
        root = new
    group = {x: int(r) for x, r in zip(values, root)}
    least = {}
    for k, x in prints.items():
        least[group[x]] = min(k, least.get(group[x], k))
    return {k: least[group[x]] for k, x in prints.items()}


def test_simhash(spark, sf_dir, texts):
    got = {r["doc_id"]: r for r in queries.op10_simhash(spark, sf_dir).collect()}
    prints = {k: plain_print(r["text"]) for k, r in texts.items()}
    assert {k: r["fingerprint"] for k, r in got.items()} == {k: f"{x:016x}" for k, x in prints.items()}
    assert {k: r["component_id"] for k, r in got.items()} == brute_components(prints)


def test_ball_links_are_whole(spark):
    rng = np.random.default_rng(10)
    base = [int(x) for x in rng.integers(-(2**63), 2**63, 30)]
    flip = lambda x, bits: int(np.int64(np.uint64(x & (2**64 - 1)) ^ np.uint64(sum(1 << int(b) for b in bits))))
    many = sorted({flip(x, rng.choice(64, k, replace=False)) for x in base for k in (0, 1, 2, 3, 4) for _ in range(4)} | {0, 1, 3, 7, -1, -(2**63)})
    df = spark.createDataFrame([(x,) for x in many], "fingerprint long")
    got = {r[0]: r[1] for r in components(simhash.links(df)).collect()}
    v = np.array(many, np.int64).view(np.uint64)
    near = np.bitwise_count(v[:, None] ^ v[None]) <= 2
    root = np.arange(len(v))
    for _ in range(len(v)):
        root = np.where(near, root[None], len(v)).min(axis=1)
    assert {x: got.get(x, x) for x in many} == {x: many[r] for x, r in zip(many, root)}


def test_simhash_edges(edge, none):
    rows = simhash.near_duplicates(edge).collect()
    assert len(rows) == len(EDGE) + 2
    by = {r["doc_id"]: r["component_id"] for r in rows}
    assert by[0] == by[1] == by[2] == 0 and by[6] == by[7] == by[None] == 6
    kept = simhash.deduplicate(edge)
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 3, 4, 5, 6, 8, 9] and kept.columns == edge.columns
    assert simhash.near_duplicates(none).count() == 0 and simhash.deduplicate(none).count() == 0


def test_deduplicate_reaches_similar_texts(spark):
    rng = np.random.default_rng(3)
    rows, want = [], set()
    for i in range(300):
        words = [f"w{x}" for x in rng.integers(0, 5000, int(rng.integers(60, 200)))]
        rows.append((2 * i, " ".join(words)))
        n, at = len(words) - 4, int(rng.integers(10, 50))
        if i % 3 == 0:  # one word changed: 5 of n shingles differ, similarity (n - 5) / (n + 5) > 0.8
            words[at] = "other"
            assert (n - 5) / (n + 5) >= 0.8
        elif i % 3 == 1:  # a piece of a fifth and more changed: less than 0.8 is left
            words[at : at + n // 5] = ["new"] * (n // 5)
            want.add(2 * i + 1)
        else:
            words = words[::-1]
            want.add(2 * i + 1)
        rows.append((2 * i + 1, " ".join(words)))
    got = {r[0] for r in simhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id").collect()}
    evens = {2 * i for i in range(300)}
    assert evens | want <= got and len(got - evens - want) <= 3


def test_deduplicate_keeps_one_row_a_group(spark):
    a, b, c = ("alpha beta gamma delta epsilon zeta", "one two three four five six", "red green blue white black grey")
    rows = [(None, a, "x"), (None, b, None), (None, b, "x"), (7, c, "x"), (7, c + " seven words more", "y"), (8, c, "x"), (9, a[::-1], "x"), (9, a[::-1], "x")]
    for parts in (1, 4):
        df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(parts)
        got = sorted(((r["doc_id"] or 0, r["text"]) for r in simhash.deduplicate(df).collect()))
        assert got == sorted([(0, a), (0, b), (7, c), (7, c + " seven words more"), (9, a[::-1])])


# ---- SQL and the pipeline


@pytest.mark.parametrize("name", sorted(oracle.SQL))
def test_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "conversations", "benchmark"):
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    other = con.execute(oracle.SQL[name]).df()
    mine = queries.QUERIES[name](spark, sf_dir).toPandas()
    value = lambda v: None if v is None or v != v else round(float(v), 6) if isinstance(v, (float, int, np.number)) else v
    key = lambda df: sorted(tuple(str(value(v)) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))
    assert sorted(mine.columns) == sorted(other.columns) and key(mine) == key(other)


def similar_components(texts):
    """The smallest key of each text's component: links are five-word shingle similarities of 0.8 and more, all pairs tried."""
    sets, least = {}, {}
    for k, t in sorted(texts.items()):
        w = (t or "").lower().split()
        s = frozenset(" ".join(w[i : i + 5]) for i in range(max(len(w) - 4, 1))) if w else frozenset()
        least[k] = sets.setdefault(s, k)
    root = {k: k for k in sets.values()}

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    items = list(sets.items())
    for i, (a, x) in enumerate(items):
        for b, y in items[i + 1 :]:
            if a and b and 0.8 <= len(a) / len(b) <= 1.25 and (n := len(a & b)) >= 0.8 * (len(a) + len(b) - n):
                p, q = sorted((top(x), top(y)))
                root[q] = p
    return {k: top(v) for k, v in least.items()}


def test_pipeline_edges(spark, edge, tmp_path):
    """Nulls in every column, empty and very long texts, repeated rows, clashing columns: every stage, and an empty table."""
    import corpus_pipeline as cp

    own = [c for c in edge.columns if c not in DOCS]
    spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    # The long text is in no learned language: it is too long to teach, and the short ones lack its letters.
    want = {"toxicity": len(EDGE) + 2, "language_id": 7, "simhash_dedup": 4}
    docs = edge
    for name, stage in cp.STAGES:
        out = cp.stored(stage(spark, docs, str(tmp_path)))
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
        if name != "packing":
            assert out.columns == edge.columns
            assert all(r[c] == "mine" for r in out.select(*own).distinct().collect() for c in own if c in ("score", "predicted", "size", "lang_pred", "target", "copies"))
            assert out.count() == want.get(name, out.count())
            docs = out
    assert docs.where("text is not null").count() <= 3 * 4


def test_run_removes_what_it_wrote(spark, tmp_path):
    import corpus_pipeline as cp

    for name in ("documents", "labels"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").write.parquet(str(tmp_path / f"{name}.parquet"))
    before = list(common.WRITTEN)
    out = cp.run(spark, str(tmp_path))
    assert out.count() > 0 and common.WRITTEN == before


def test_pipeline(spark, sf_dir, tokenizer):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = {r["doc_id"]: r["toxic"] for r in table(spark, sf_dir, "labels", "doc_id", "toxic").collect()}
    kept = {}
    for name, stage in cp.STAGES:
        out = cp.stored(stage(spark, docs, sf_dir))
        kept[name] = (docs, out)
        if name != "packing":
            assert out.columns == docs.columns
        docs = out
    ids = {n: ([r[0] for r in a.select("doc_id").collect()], [r[0] for r in b.select("doc_id").collect()]) for n, (a, b) in kept.items()}
    gone = set(ids["toxicity"][0]) - set(ids["toxicity"][1])
    assert np.mean([labels.get(k, 1) for k in gone]) > 0.9
    model = toxicity.train(kept["toxicity"][0], table(spark, sf_dir, "labels", "doc_id", "toxic"))
    assert gone == {r[0] for r in toxicity.score(kept["toxicity"][0], model).where("predicted = 1").select("doc_id").collect()}
    assert len(gone) > 0.6 * sum(labels.values())
    assert set(ids["language_id"][1]) == {r[0] for r in kept["language_id"][0].where(F.col("text").rlike(r"\p{L}")).select("doc_id").collect()}
    before = {r[0]: r[1] for r in kept["simhash_dedup"][0].select("doc_id", "text").collect()}
    assert sorted(ids["simhash_dedup"][1]) == sorted(set(similar_components(before).values()))
    plan = {r["doc_id"]: r["copies"] for r in mixing.plan(kept["mixing"][0], spaced=True).collect()}
    assert Counter(ids["mixing"][1]) == Counter({k: n for k, n in plan.items() if n})
    want = {r[0]: tokenizer.encode(r[1], add_special_tokens=False).ids + [1] for r in kept["packing"][0].select("doc_id", "text").distinct().collect()}
    check_packing(kept["packing"][1].collect(), want, Counter(ids["packing"][0]))
