"""Registered queries against their SQL, and the pipeline's stages."""

import collections

import pytest
from oracle import difference
from test_operators import ALNUM, brute_groups, brute_lines, low

import __spark_entry__
import corpus_pipeline
from assaykit.llm import linededup, quality, queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_equals_sql(spark, small, name):
    assert difference(queries.queries()[name](spark, small), queries.oracle_sql()[name], small) == ""


def test_registered():
    found = __spark_entry__.queries()
    assert [sum(n.startswith(f"op{k}_") for n in found) for k in range(1, 11)] == [1] * 10 and "pipeline" in found


def test_pipeline_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, n = docs.columns, docs.count()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    seen = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        seen = corpus_pipeline.materialize(stage(spark, seen, small), "stage")
        assert seen.columns == columns and 0 < seen.count() <= n
        n = seen.count()
        if name == "quality classifier":
            kept = {r.doc_id for r in seen.select("doc_id").collect()}
            assert all(d in kept for d, q in labels.items() if q == 1) and not any(d in kept for d, q in labels.items() if q == 0)
    packed = corpus_pipeline.STAGES[-1][1](spark, seen, small)
    assert packed.select("doc_id").distinct().count() == n


def test_pipeline_stages_equal_brute_force(spark, docs, tmp_path):
    """What each stage keeps of what it gets, against sequential models; nulls, repeated rows and empty texts included."""
    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 7 != 0), 0) for i in range(70)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    items = [(1, " ".join(texts[4].split()[5:25])), (2, texts[9]), (3, None), (4, "one")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    seen = spark.read.parquet(f"{tmp_path}/documents.parquet")
    plain = lambda df: sorted(((-1 if r.doc_id is None else r.doc_id), r.text or "", r.text is None) for r in df.collect())
    for (_, stage), model in zip(corpus_pipeline.STAGES[:-1], (_good, _without_lines, _first_of_groups, _clean), strict=True):
        want = sorted(((-1 if d is None else d), t or "", t is None) for d, t in model(spark, seen, tmp_path, items))
        seen = corpus_pipeline.materialize(stage(spark, seen, str(tmp_path)), "stage")
        assert plain(seen) == want and seen.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    packed = corpus_pipeline.STAGES[-1][1](spark, seen, str(tmp_path)).collect()
    assert collections.Counter(r.doc_id for r in packed if r.piece == 0) == collections.Counter(r.doc_id for r in seen.collect())


def _rows(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def _good(spark, seen, folder, _):
    """Scores themselves are tested against brute force with the operator."""
    judged = quality.classify(seen, spark.read.parquet(f"{folder}/labels.parquet"))
    return [(r.doc_id, r.text) for r in judged.collect() if r[quality.RESULT].score >= 0.5]


def _without_lines(spark, seen, *_):
    rows = _rows(seen)
    gone = brute_lines(rows, 50)
    out = []
    for d, t in rows:
        cut = gone.get((-(1 << 63) if d is None else d, t), ())
        new = t if t is None else linededup.delete_spans(t, [(i, i + 1) for i in sorted(cut)])[0]
        if not cut or new.strip(" "):
            out.append((d, new))
    return out


def _first_of_groups(spark, seen, *_):
    rows, kept = _rows(seen), {}
    groups = brute_groups(rows, 5, 80)
    for d, t in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or "")):
        if groups[d] == d:
            kept.setdefault(d, t)
    return [*kept.items(), *[r for r in rows if r[0] is None]]


def _clean(spark, seen, folder, items):
    wins = set()
    for _, t in items:
        w = ALNUM.findall(low(t))
        n = min(10, len(w))
        wins |= {tuple(w[k : k + n]) for k in range(len(w) - n + 1 if n else 0)}

    def hit(t):
        w = ALNUM.findall(low(t))
        return any(tuple(w[k : k + n]) in wins for n in {len(x) for x in wins} for k in range(len(w) - n + 1))

    return [r for r in _rows(seen) if not hit(r[1])]
