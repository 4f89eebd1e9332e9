"""The near-duplicate stage on families of pages that share a template, and its parts against plain versions."""

import numpy as np
import pytest

from lamella.llm import simhash


def family(pairs, shared, changes, words=300, seed=0):
    """Twins that differ in ``changes`` words, in a family whose pages share most of their words."""
    rng = np.random.default_rng(seed)
    template, rows, own = [f"t{x}" for x in rng.integers(0, 5000, words)], [], words - int(words * shared)
    for i in range(pairs):
        page = list(template)
        page[100 : 100 + own] = [f"u{x}" for x in rng.integers(0, 10**6, own)]
        twin = list(page)
        for c in rng.choice(words - 10, changes, replace=False):
            twin[c + 5] = f"z{rng.integers(0, 10**6)}"
        rows += [(2 * i, " ".join(page)), (2 * i + 1, " ".join(twin))]
    return rows


@pytest.mark.parametrize("pairs, shared, changes, block", [(300, 0.85, 1, simhash.BLOCK), (300, 0.83, 3, 50), (1200, 0.845, 2, simhash.BLOCK)])
def test_twins_within_a_template_family(spark, monkeypatch, pairs, shared, changes, block):
    """All twins meet, whether a segment is one block or many, and no page goes with another's."""
    monkeypatch.setattr(simhash, "BLOCK", block)
    docs = spark.createDataFrame(family(pairs, shared, changes), "doc_id long, text string").repartition(8)
    kept = {r[0] for r in simhash.deduplicate(docs).select("doc_id").collect()}
    assert all(2 * i in kept for i in range(pairs))
    assert len(kept) - pairs <= pairs // 100


def test_common_hashes():
    rng = np.random.default_rng(2)
    for often in (0, 30):
        base = rng.integers(0, 2**63, often).astype(np.uint64)
        sets = [np.unique(np.r_[base, rng.integers(0, 200, int(rng.integers(0, 60))).astype(np.uint64)]) for _ in range(70)]
        got = simhash.common(sets[:40], sets[25:])
        assert got.tolist() == [[len(np.intersect1d(a, b)) for b in sets[25:]] for a in sets[:40]]
    assert simhash.common([], sets).shape == (0, 70) and simhash.common([np.zeros(0, np.uint64)], [base]).tolist() == [[0]]


def side(n, components, seed=0, size=100):
    rng = np.random.default_rng(seed)
    return simhash.Side([np.zeros(n, np.int64), np.arange(n), *rng.integers(-2, 3, (2, n)), np.full(n, size), np.sort(rng.integers(0, components, n))])


def test_candidates_are_pairs_or_crowds():
    few, many = side(30, 2), side(300, 50)
    few.first = few.first << 40
    for s, near in ((few, 3), (many, 64)):
        i, j = s.against(s, near, 0.8)
        want = {(a, b) for a in range(len(s.node)) for b in range(a + 1, len(s.node)) if s.component[a] != s.component[b]
                and sum(int(np.bitwise_count(np.uint64((int(x[a]) ^ int(x[b])) & (2**64 - 1)))) for x in (s.first, s.second)) <= near}
        assert set(zip(i.tolist(), j.tolist())) == want and len(i) == len(want)
    batches = list(simhash.compared(many, many, (7,), 64, 0.8))
    assert {k for b in batches for k in b.column(0).to_pylist()} == {simhash.CROWDED}
    assert {n for b in batches for n in b.column(1 + 1).to_pylist()} == set(range(300))
    pairs = list(simhash.compared(side(2, 1), side(2, 1, 5), (7,), 0, 0.8))
    assert [b.column(0).to_pylist() for b in pairs] in ([[]], [[simhash.PAIR]])


def test_blocks_of_long_texts():
    s = side(6, 2, size=simhash.SHINGLES // 2)
    s.size[1] = 3 * simhash.SHINGLES
    assert s.blocks().tolist() == [0, 1, 2, 2, 3, 3]
    assert side(simhash.CROWD + 1, 2).blocks().max() == 1
