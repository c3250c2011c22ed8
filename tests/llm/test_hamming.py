"""Near-duplicates by signatures against brute force, and what the index promises."""

import random

import numpy as np
import pytest
from test_operators import brute_groups

from assaykit.llm import hamming
from assaykit.llm.hamming import Index


def groups(found):
    return {r.doc_id: r.component_id for r in found if r.doc_id is not None}


@pytest.mark.parametrize(("size", "options"), [(4, {}), (5, {"list_size": 2, "tries": 1, "block": 2})])
def test_near_duplicates_equal_brute_force(docs, plain_rows, size, options):
    want = brute_groups(plain_rows, size, 80)
    found = hamming.near_duplicates(docs, size, 80, **options).collect()
    assert len(found) == len(plain_rows) and groups(found) == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in found if r.doc_id is not None)
    assert [(r.component_id, r.kept) for r in found if r.doc_id is None] == [(want[7], False)]  # an equal text has an id


def test_empty_table_and_lonely_rows(spark, none):
    assert hamming.near_duplicates(none).collect() == []
    rows = [(None, "one two three four five six", 1), (None, None, 1), (3, None, 2), (4, "\t", 3)]
    found = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in hamming.near_duplicates(spark.createDataFrame(rows, "doc_id int, text string, kept int")).collect()}
    assert found == {(None, 2, None, True), (None, 0, None, True), (3, 0, 3, True), (4, 0, 4, True)}


def test_large_families_chains_and_shared_passages(spark):
    """Hundreds of near copies of one text, a chain whose ends are far apart, and many texts that share half of their words only."""
    rng = random.Random(4)
    word = lambda: f"w{rng.randrange(10**6)}"
    base = [word() for _ in range(80)]
    texts = []
    for _ in range(150):
        w = list(base)
        for _ in range(rng.randint(0, 2)):
            w[rng.randrange(80)] = word()
        texts.append(w)
    chain = [word() for _ in range(120)]
    for k in range(40):
        chain = [*chain[3:], word(), word(), word()]
        texts.append(list(chain))
    passage = [word() for _ in range(40)]
    texts += [[*(word() for _ in range(20)), *passage, *(word() for _ in range(20))] for _ in range(150)]
    rng.shuffle(texts)
    rows = [(i, " ".join(w)) for i, w in enumerate(texts)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute_groups(rows, 4, 80)
    assert groups(hamming.near_duplicates(frame, 4, 80).collect()) == want
    assert groups(hamming.near_duplicates(frame, 4, 80, list_size=5, tries=1, block=8).collect()) == want
    assert max(np.bincount(list(want.values()))) > 100


@pytest.mark.parametrize("index", [Index(), Index(5, 3, 1), Index(4, 5, 2), Index(6, 2, 0)])
def test_index_meets_all_pairs_under_the_distance(index):
    rng = np.random.default_rng(5)
    a = rng.integers(0, 1 << 16, (400, index.positions)).astype("<u2")
    b = a.copy()
    for row in b:  # as many differences as the threshold allows, wherever they are
        at = rng.permutation(index.positions)[: index.threshold]
        row[at] ^= 1
    assert ((a != b).sum(1) == index.threshold).all()
    x, y = hamming.chunk_keys(a, index), hamming.chunk_keys(b, index)
    assert all(set(p.tolist()) & set(q.tolist()) for p, q in zip(x, y, strict=True))
    assert not any(set(p.tolist()) & set(q.tolist()) for p, q in zip(x, np.roll(y, 1, axis=0), strict=True))


def test_signatures_estimate_similarity_and_read_long_sets_in_pieces():
    rng = np.random.default_rng(6)
    both, one, other = (rng.integers(0, 1 << 63, n, dtype="u8") for n in (8000, 1000, 1000))
    a, b = np.concatenate([both, one]), np.concatenate([other, both])
    x, y = (hamming.signature(v, 2048) for v in (a, b))
    assert abs((x == y).mean() - 0.8) < 0.04
    assert (hamming.signature(a[::-1].copy(), 2048) == x).all() and len(set(x.tolist())) > 1500


def test_pairs_come_from_their_least_common_key():
    index, rng = Index(4, 3, 1), np.random.default_rng(8)
    a = {"signature": rng.integers(0, 3, (60, index.positions)).astype("<u2")}
    keys = hamming.chunk_keys(a["signature"], index).view("i8")
    i, j = (x.ravel() for x in np.meshgrid(np.arange(60), np.arange(60)))
    met = {}
    for t in np.unique(keys):
        for p, q in zip(*hamming.first_met(a, a, i, j, t, index), strict=True):
            met.setdefault((int(p), int(q)), []).append(t)
    for p, q in zip(i.tolist(), j.tolist(), strict=True):
        common = [k for k, n in zip(keys[p], keys[q], strict=True) if k == n]
        assert met.get((p, q), []) == ([min(common)] if common else [])
