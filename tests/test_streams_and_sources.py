"""Streams equal their batch operators; sources and sinks round-trip."""

import json

from pyspark.sql import functions as F

from assaykit.operators import metrics
from assaykit.sources import files
from assaykit.sources.tables import readings, table
from assaykit.streaming import flows


def test_usage_stream_equals_batch(spark, small, tmp_path):
    calls = readings(spark, small).select("person_id", "ts", F.col("value").cast("long").alias("tokens"), (F.col("name") == "view").alias("cached"))
    calls = calls.withColumn("ts", F.col("ts").cast("timestamp"))
    calls.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = flows.usage_daily_stream(flows.table_stream(spark, str(tmp_path / "in"), calls), ["person_id"])
    q = stream.writeStream.outputMode("complete").format("memory").queryName("usage").trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = metrics.usage_daily(calls, ["person_id"])
    assert spark.table("usage").exceptAll(want).isEmpty() and want.exceptAll(spark.table("usage")).isEmpty()


def test_ingest_writes_each_batch_once(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "id long, text string")
    rows.write.parquet(str(tmp_path / "in"))
    flows.ingest(
        flows.table_stream(spark, str(tmp_path / "in"), rows), lambda d: d, str(tmp_path / "out"), str(tmp_path / "check"), "id"
    ).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_latest_status_and_cache_age(spark):
    rows = spark.createDataFrame([(1, 1, "pending"), (1, 3, "processed"), (1, 2, "processing"), (2, 1, None)], "id long, at int, status string")
    assert {r.id: r.status for r in flows.latest_status(rows, "id", "at", "status").collect()} == {1: "processed", 2: None}
    cache = spark.sql("SELECT * FROM VALUES (1, TIMESTAMP'2024-01-01'), (2, TIMESTAMP'2023-12-31 23:59:59') AS t(id, made)")
    assert [r.id for r in flows.fresh(cache, "made", F.lit("2024-01-31").cast("timestamp"), 30).collect()] == [1]


def test_json_aliases(spark, tmp_path):
    path = tmp_path / "a.json"
    path.write_text(json.dumps({"biomarkers": [{"name": "Glucose", "aliases": ["FBS", "glucose"]}, {"name": "LDL"}]}))
    got = {(r.name, r.alias) for r in files.json_aliases(spark, str(path)).collect()}
    assert got == {("Glucose", "fbs"), ("Glucose", "glucose"), ("LDL", "ldl")}


def test_page_texts_and_uploads(spark, tmp_path):
    (tmp_path / "x.pdf").write_bytes(b"one\x0ctwo")
    (tmp_path / "y.txt").write_bytes(b"no")
    pages = files.page_texts(spark, str(tmp_path), lambda b: b.decode().split("\x0c"), "*.pdf")
    assert [(r.page_num, r.text) for r in pages.orderBy("page_num").collect()] == [(1, "one"), (2, "two")]
    found = files.valid_uploads(spark.read.format("binaryFile").load(str(tmp_path)))
    assert found.count() == 1 and files.append_new(found.select("file_id"), found).isEmpty()


def test_copy_and_state(spark, small, tmp_path):
    files.copy_tables(spark, small, str(tmp_path), ["region", "nation"])
    assert spark.read.parquet(f"{tmp_path}/nation.parquet").count() == table(spark, small, "nation").count()
    files.append_daily(spark.createDataFrame([("2024-01-01", 1)], "day string, n int"), str(tmp_path / "log"))
    files.append_daily(spark.createDataFrame([("2024-01-01", 2)], "day string, n int"), str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 2
    assert "extra" in files.with_column_if_missing(spark.range(1), "extra", "string").columns


def test_state_and_report(spark, tmp_path):
    kind, path = "name string, frequency int", str(tmp_path / "state")
    assert files.load_state(spark, path, kind).isEmpty()
    for n in (1, 2):
        files.save_state(spark.createDataFrame([("hdl", n)], kind), path)
    assert [tuple(r) for r in files.load_state(spark, path, kind).collect()] == [("hdl", 2)]
    for n in (1, 2):
        files.save_report(spark.createDataFrame([("saved", n)], "what string, n int"), str(tmp_path / "report"))
    assert [r.n for r in spark.read.json(str(tmp_path / "report")).collect()] == [2]


def test_relational_database(spark, small, tmp_path):
    """Read in ranges of a column; the embedded database that comes with Spark stands for a server."""
    url, driver = f"jdbc:derby:{tmp_path}/db;create=true", {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    nation = table(spark, small, "nation").select("n_nationkey", "n_regionkey")
    nation.coalesce(1).write.jdbc(url, "NATION", properties=driver)
    read = files.jdbc_table(spark, url, "NATION", "n_nationkey", 0, 25, 4, **driver)
    assert read.rdd.getNumPartitions() == 4 and sorted(map(tuple, read.collect())) == sorted(map(tuple, nation.collect()))


def test_first_in_period_and_healing(spark, tmp_path):
    rows = spark.sql("SELECT * FROM VALUES (1, TIMESTAMP'2024-01-01'), (1, TIMESTAMP'2024-01-01 00:00:05'), (2, TIMESTAMP'2024-01-01') AS t(id, at)")
    rows.write.parquet(str(tmp_path / "in"))
    stream = flows.first_in_period(flows.table_stream(spark, str(tmp_path / "in"), rows), ["id"], "at", "1 hour")
    q = stream.writeStream.format("memory").queryName("firsts").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r.id for r in spark.table("firsts").collect()) == [1, 2]
    status, confidence = flows.healed_status(F.lit("pending"), F.lit(20), F.lit(0.0))
    assert tuple(spark.range(1).select(status, confidence).first()) == ("processed", 0.95)


def test_page_source(spark, tmp_path):
    from assaykit.sources import pages

    pages.register(spark)
    (tmp_path / "deep").mkdir()
    texts = {"a.txt": "one\x0ctwo\x0c\n", "b.txt": "", "deep/c.txt": "three ü\n", "d.bin": "x\x0cy", "_hidden.txt": "no"}
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    load = lambda folder=tmp_path, **o: spark.read.format("pages").options(pattern="*.txt", **o).load(str(folder))
    want = [("a.txt", 1, "one"), ("a.txt", 2, "two"), ("deep/c.txt", 1, "three ü\n")]
    short = lambda df: sorted((r.path.removeprefix(f"{tmp_path}/"), r.page_num, r.text) for r in df.collect())
    assert short(load()) == want and short(load(f"file://{tmp_path}")) == want
    assert load(groupBytes=1).rdd.getNumPartitions() == 3 and load().rdd.getNumPartitions() == 1
    one = load(groupBytes=1).where(F.col("path") == f"{tmp_path}/a.txt")
    assert one.count() == 2 and one.rdd.getNumPartitions() == 1
    assert short(load().where("page_num = 1 and text like 't%'")) == want[2:]
    few = spark.read.format("pages").schema("bytes long, path string").options(pattern="*[!y]").load(str(tmp_path)).collect()
    assert sorted(r.bytes for r in few) == sorted(len(t.encode()) for n, t in texts.items() if n != "_hidden.txt")
    (tmp_path / "own_pages.py").write_text("def words(content):\n    return content.decode().split()\n")
    spark.sparkContext.addPyFile(str(tmp_path / "own_pages.py"))
    assert short(spark.read.format("pages").options(pattern="c.txt", reader="own_pages:words").load(str(tmp_path))) == [("deep/c.txt", 1, "three"), ("deep/c.txt", 2, "ü")]
    (tmp_path / "none").mkdir()
    assert load(tmp_path / "none").isEmpty()


def test_pages_of_a_long_file_are_streamed(tmp_path):
    """What a task holds doesn't grow with a file, and blocks may end within a character."""
    import io
    import random
    import tracemalloc

    from pyspark.sql.types import StructType

    from assaykit.sources import pages

    rng = random.Random(2)
    for _ in range(300):
        content = b"".join(rng.choice([b"\x0c", "é€😀".encode(), b"\xff", b"\xe2\x82", b" \n", b"ab"]) for _ in range(rng.randint(0, 12)))
        assert list(pages._streamed(io.BytesIO(content), rng.randint(1, 5))) == pages.form_feeds(content)

    with (tmp_path / "long.txt").open("w") as f:
        for k in range(30_000):
            f.write(f"page {k} " + "x" * 4000 + "\x0c")
    reader = pages.PageReader({"path": str(tmp_path)}, StructType.fromDDL("page_num int, text string"))
    tracemalloc.start()
    assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == 30_000
    assert tracemalloc.get_traced_memory()[1] < 80e6  # of a file of 120 MB
    tracemalloc.stop()


def test_small_rows_with_heavy_expressions_make_short_tasks(spark):
    from assaykit.plans import lookups
    from assaykit.sources.tables import spread

    few = spark.range(1000, numPartitions=1)
    assert spread(few, 10).rdd.getNumPartitions() == 100 and spread(few, 5000).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert lookups.range_objects(spark, "/root/testdata/sf0.1").rdd.getNumPartitions() >= 2
