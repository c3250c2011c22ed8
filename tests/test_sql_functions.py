"""Functions for SQL text give what the Column functions and operators give."""

import pytest
from pyspark.sql import functions as F
from test_documents import FREE, LABS, ODD

from assaykit.functions import sql, texts, values
from assaykit.operators import documents

RANGES = ["5-10", " 5 - 10 ", "<5", "< 5.5", "≤ 7", "> 3", "≥3", "Negative (<5)", "up to 9", "over 4", "above 4", "less than 6", "5", "1 2", "1 2 3", "-5", "5-", "a-b", "3-4-5", "", " ", None,
          "greater than 3 under 5", "0.5–1.5", "it's 'quoted' \\ 4", "1.2.3", "5 to 10"]


@pytest.fixture(scope="module")
def session(spark):
    sql.register(spark)
    sql.register(spark)  # again does no harm
    return spark


def test_ranges_and_flags(session):
    session.createDataFrame([(t,) for t in RANGES], "t string").createOrReplaceTempView("ranges")
    both = session.table("ranges").select("t", values.reference_range(F.col("t")).alias("want"), F.expr("lab_range(t)").alias("got")).collect()
    for r in both:
        assert r.got == r.want, r.t
    flags = ["H", " low ", "normal", "", " ", None, "TRUE", "n"]
    rows = [(f, v, lo, hi) for f in flags for v, lo, hi in [(5.0, 1.0, 9.0), (0.5, 1.0, None), (10.0, None, 9.0), (None, 1.0, 9.0), (9.0, 1.0, 9.0)]]
    frame = session.createDataFrame(rows, "f string, v double, a double, b double")
    for r in frame.select("*", values.abnormal_flag(*map(F.col, "fvab")).alias("want"), F.expr("lab_flag(f, v, a, b)").alias("got")).collect():
        assert r.got == r.want, r


def test_confidence(session, small):
    docs = session.read.parquet(f"{small}/documents.parquet").select("text").union(session.createDataFrame([(t,) for t in [*LABS, *FREE, *ODD]], "text string")).repartition(4)
    for r in docs.select("text", texts.confidence(F.col("text")).alias("want"), F.expr("lab_confidence(text)").alias("got")).collect():
        assert abs(r.got - r.want) < 1e-12, r.text


def test_scalar_functions_run_no_python(session):
    plan = session.sql("SELECT lab_range(t).low, lab_confidence(t), lab_flag(t, 1D, 2D, 3D) FROM ranges")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


@pytest.mark.parametrize(("limit", "overlap"), [(300, 40), (40, 13), (120, 0)])
def test_chunks_as_a_table_function(session, small, limit, overlap):
    docs = session.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").union(session.createDataFrame([*((10_000 + i, t) for i, t in enumerate(ODD)), (9, None)], "doc_id long, text string"))
    docs.repartition(4).createOrReplaceTempView("docs")
    got = session.sql(f"SELECT doc_id, c.ord, c.chunk, c.estimated_tokens FROM docs, LATERAL chunk_text(text, {limit}, {overlap}) AS c")
    want = docs.select("doc_id", F.posexplode(documents.chunk_text(F.col("text"), limit, overlap)).alias("ord", "chunk")).withColumn("estimated_tokens", texts.tokens(F.col("chunk")).cast("int"))
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_loose_measurements_as_a_table_function(session):
    rows = [(i, t) for i, t in enumerate([*FREE, *LABS])]
    session.createDataFrame(rows, "id long, text string").repartition(3).createOrReplaceTempView("free")
    got = session.sql("""SELECT id, m.name, m.value, lab_range(m.reference_range).low AS low, lab_range(m.reference_range).high AS high, m.unit, m.confidence
                         FROM free, LATERAL loose_measurements(text) AS m""")
    want = documents.loose_measurements(session.table("free"), "id").select("id", "name", "value", "low", "high", F.col("original_unit").alias("unit"), "confidence")
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty() and got.count() > 10


def test_reports_as_partitions(session):
    pages = [("a", 2, "Zinc: 5 mg/L\nIron: 6 mg/L"), ("a", 1, "zinc: 4 mg/L"), ("b", 1, "Zinc: 7 mg/L"), (None, 1, "Iron: 1 mg/L"), ("c", 1, None)]
    session.createDataFrame(pages, "report string, page int, text string").repartition(3).createOrReplaceTempView("pages")
    found = session.sql("SELECT report, name, value FROM report_measurements(TABLE (SELECT report, page, text FROM pages) PARTITION BY report ORDER BY page)").collect()
    assert sorted(map(tuple, found), key=str) == sorted([("a", "zinc", 4.0), ("a", "Iron", 6.0), ("b", "Zinc", 7.0), (None, "Iron", 1.0)], key=str)
