"""Golden values of the Column functions, with nulls, ties and odd spellings."""

import random

import pytest
from pyspark.sql import functions as F

from assaykit.functions import texts, values
from assaykit.operators import documents, matching, relational
from assaykit.plans import catalogue


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize("text, low, high", [
    ("70-99", 70, 99), ("< 200", None, 200), ("> 40", 40, None), ("Negative (<10)", None, 10), ("Negative", None, None), ("Normal", None, None),
    ("", None, None), (None, None, None), ("1-2-3", 1, 2), ("≤ 5", None, 5), ("up to 7", None, 7), ("1 to 2", 1, 2), ("above 3", 3, None), ("1 2 3", None, None),
])
def test_reference_range(spark, text, low, high):
    r = one(spark, values.reference_range, text)
    assert (r.low, r.high) == (low, high)


@pytest.mark.parametrize("text, low, high", [("1,000-2,000", 1000, 2000), ("1 to 2", 1, 2), ("Up to 7", None, 7), ("5", None, None), (">=3", 3, None)])
def test_display_range(spark, text, low, high):
    r = one(spark, values.display_range, text)
    assert (r.low, r.high) == (low, high)


@pytest.mark.parametrize("text, low, high", [("-5-10", -5, 10), ("<5", None, 5), ("about 5", None, None)])
def test_strict_range(spark, text, low, high):
    r = one(spark, values.strict_range, text)
    assert (r.low, r.high) == (low, high)


@pytest.mark.parametrize("unit, to", [
    ("mg / dL", "mg/dL"), ("mg/deciliter", "mg/dL"), ("percent", "%"), ("pct", "%"), ("mmol / l", "mmol/L"), ("mcg/mL", "μg/mL"), ("mcg/dl", "μg/dL"),
    ("MCG/ML", "MCG/ML"), ("furlong", "furlong"), ("", "-"), (None, "-"),
])
def test_standard_unit(spark, unit, to):
    assert one(spark, values.standard_unit, unit) == to


@pytest.mark.parametrize("name, to", [
    ("LDL", "Lipid"), ("HbA1c", "Metabolic"), ("Hemoglobin A1c", "Metabolic"), ("TSH", "Hormone"), ("Folate", "Vitamin"), ("Ferritin", "Mineral"), ("WBC", "Blood"),
    ("ALP", "Liver"), ("BUN", "Kidney"), ("Cobalt", "Liver"), ("Widget", "Other"),
])
def test_category(spark, name, to):
    assert one(spark, values.category, name) == to


def test_numbers_flags_and_confidence(spark):
    assert one(spark, values.clean_number, "95 mg") == 95 and one(spark, values.clean_number, "Not a number") == 0
    assert [one(spark, values.confidence, x) for x in ("0.4", "2", "very high", "fairly high", "?", None)] == [0.4, 1.0, 0.95, 0.85, 0.7, 0.7]
    rows = spark.createDataFrame(
        [("a", "95", "mg/dl", "70-99", None), ("b", "120", "mg/dl", None, "H"), ("c", "120", "mg/dl", "70-99", None), ("d", None, None, None, None)],
        "name string, value string, unit string, reference_range string, flag string",
    )
    assert [r.is_abnormal for r in documents.normalize(rows).orderBy("name").collect()] == [False, True, True, False]


def test_trend_status_position(spark):
    r = spark.range(1).select(
        values.trend(F.lit(1.0), F.lit(1.0005)).alias("a"), values.trend(F.lit(None).cast("double"), F.lit(1.0)).alias("b"),
        values.status(F.lit(5.0), F.lit(None).cast("double"), F.lit(4.0)).alias("c"), values.range_position(F.lit(99.0), F.lit(1.0), F.lit(2.0)).alias("d"),
        values.percent_change(F.lit(0.0), F.lit(5.0)).alias("e"), values.range_position(F.lit(1.0), F.lit(1.0), F.lit(1.0)).alias("f"),
    ).first()
    assert tuple(r) == ("Stable", "Unknown", "Abnormal", 95.0, 0.0, 50.0)


def test_json(spark):
    assert one(spark, lambda c: F.try_variant_get(values.json_object(c), "$.a", "int"), 'said: {"a": 3} ok') == 3
    assert one(spark, values.json_object, "{oops") is None
    assert one(spark, values.complete_objects, '[{"a": 1}, {"b": 2}, {"c"') == ['{"a": 1}', '{"b": 2}']


def test_chunks_are_packed_in_order(spark):
    text = "\n\n".join(f"para {i} " + "x" * 40 for i in range(8)) + "\n\n" + "A long one. " * 20
    chunks = one(spark, lambda c: documents.chunk_text(c, 40, 13), text)
    assert all(any(f"para {i} " in c for c in chunks) for i in range(8))
    assert all(len(c) <= 4 * 40 + 8 for c in chunks) and chunks[1].startswith("para 2 ")
    assert one(spark, lambda c: documents.chunk_text(c, 40), "short") == ["short"]


def test_skip_fold_equals_a_loop(spark):
    rows = [(r, i, t) for r in range(3) for i, t in enumerate(
        ["glucose 95 mg/dl (70-99)"] * (12 * r) + ["plain words without any figures here"] * 12 + ["visit our street and city road office"] * 3 + ["x"])]
    df = spark.createDataFrame(rows, "report long, ord int, text string")
    s = df.select("report", "ord", texts.screen(F.col("text")).alias("s")).select(
        "report", "ord", "s", *[texts.accepts(F.col("s"), n).alias(f"k{n}") for n, _ in texts.SCREEN_LEVELS])
    want = {}
    for report in range(3):
        found, kept = s.where(F.col("report") == report).orderBy("ord").collect(), 0
        first = []
        for r in found:
            k = r[f"k{max(n for n, _ in texts.SCREEN_LEVELS if n <= kept)}"]
            kept += k
            first.append(k)
        many = 1 - kept / len(found) > 0.5
        for r, k in zip(found, first):
            want[report, r.ord] = r.s.confidence >= 0.5 or r.s.patterns >= 2 if many else k
    got = {(r.report, r.ord): r.kept for r in documents.skip_chunks(df, "report", ["ord"]).collect()}
    assert got == want


def test_ratio():
    assert matching.indel_ratio("", "") == 100 and matching.indel_ratio("abc", "") == 0
    assert matching.indel_ratio("kitten", "sitting") == 62 and matching.indel_ratio("jon smith", "john smith") == 95


def test_matching_needs_a_shared_block(spark):
    kind = "id string, name string, dob string, gender string, tenant int"
    people = spark.createDataFrame([("7", "Ann Lee", "1990-01-01", "f", 1), ("8", "Bob Ray", None, None, 1), ("9", "Ann Lee", "1990-01-01", "f", 2)], kind)
    seen = spark.createDataFrame([("7", "lee, ann", "1990-01-01", "F", 1), (None, None, None, None, 1)], kind)
    got = matching.match_people(seen.withColumn("row_id", F.lit(1)), people.withColumn("person_id", F.col("id"))).collect()
    assert [(r.person_id, round(r.score, 3)) for r in got] == [("7", 1.0)]


def test_ratios_of_many_pairs():
    rng = random.Random(3)
    texts = ["", "a\0", "é" * 64, "b" * 65, *("".join(rng.choices("abcd 01é", k=rng.choice((1, 9, 30, 63, 64, 70)))) for _ in range(60))]
    pairs = [(a, b) for a in texts for b in texts]
    assert matching.indel_ratios(*map(list, zip(*pairs))).tolist() == [matching.indel_ratio(*p) for p in pairs]


def test_all_customers_are_matched(spark, small):
    """Each one is found by its own swapped name, and as many pairs as brute force over each tenant finds."""
    rows = catalogue.people(spark, small).collect()
    tokens = lambda x: " ".join(sorted(x.lower().replace("#", " ").split()))
    want = set()
    for a in rows:
        for b in rows:
            if a.tenant_id == b.tenant_id:
                own = None if a.person_id % 3 == 0 else f"{a.person_id}1"
                got = 0.5 * matching.indel_ratio(tokens(a.name), tokens(b.name)) / 100 + 0.1 * (a.segment == b.segment)
                got = got / 0.6 if own is None else got + 0.4 * matching.indel_ratio(own, str(b.person_id)) / 100
                if got >= 0.8:
                    want.add((a.person_id, b.person_id))
    found = [(r.row_id, r.person_id) for r in catalogue.match_profiles(spark, small).collect()]
    assert sorted(found) == sorted(want) and {a for a, b in found if a == b} == {r.person_id for r in rows}


def test_matching_of_one_tenant_in_pieces(spark):
    """Pairs count without any common beginning or id: ids off by one character and no name, or other first letters."""
    kind = "row_id int, tenant int, name string, dob string, gender string, id string"
    seen = [(1, 1, None, "1990-01-01", "f", "x123456"), (2, 1, "Xnna Yee", "1990-01-01", "f", "x12345"), (3, 2, None, None, "F", None)]
    have = [(1, 1, "Anna Lee", "1990-01-01", "f", "y123456"), (2, 1, "Bob Ray", "1980-02-02", "m", "77"), (3, 2, "Eve", None, "f", None), (4, 1, "Bob Ray", "1980-02-02", "m", "77")]
    found = matching.match_people(spark.createDataFrame(seen, kind), spark.createDataFrame(have, kind).withColumnRenamed("row_id", "person_id"), side=1).collect()
    assert sorted((r.row_id, r.person_id) for r in found) == [(1, 1), (2, 1), (3, 3)]


def test_ten_times_the_rows_of_a_tenant_are_sent_ten_times(spark):
    """Not a hundred times, nor broadcast; all pairs are scored, also where a group has more blocks than one."""
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    fields = [F.lit(1).alias("tenant"), F.lit("Ann").alias("name"), F.lit(None).cast("string").alias("dob"), F.lit("f").alias("gender")]
    try:
        for n in (20, 200):
            ids = F.when(F.col("id") % 3 > 0, F.col("id").cast("string")).alias("id")
            have = spark.range(n).select(F.col("id").alias("person_id"), *fields, ids)
            seen = spark.range(n).select(F.col("id").cast("int").alias("row_id"), *fields, ids)
            sent = matching.in_pieces(seen, have, 5, 10_000)
            assert 2 * n < sent.count() <= 2 * n * 4 and "BroadcastHashJoin" not in sent._jdf.queryExecution().executedPlan().toString()
            assert matching.in_pieces(seen, have, 5, 10).groupBy("t", "i", "j").count().agg(F.max("count")).first()[0] < 60
            found = [tuple(r) for r in matching.match_people(seen, have, 0.1, side=5).collect()]
            assert len(found) == n * n and sorted((a, b) for a, b, _ in found) == [(a, b) for a in range(n) for b in range(n)]
            assert {s for a, b, s in found if a == b} == {1.0}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)


def test_all_events_are_parsed(spark, small, monkeypatch):
    """The parser, not a filter before it, refuses events of unknown names."""
    given, parse = [], documents.known_measurements
    monkeypatch.setattr(documents, "known_measurements", lambda docs, key: given.append(docs.count()) or parse(docs, key))
    events = spark.read.parquet(f"{small}/events.parquet")
    assert catalogue.extract_roundtrip(spark, small).count() == events.where("event_type = 'click'").count()
    assert given == [events.count()]


def test_lists(spark):
    r = spark.range(1).select(
        relational.first_position_removed(F.array(*map(F.lit, "abab")), F.lit("b")).alias("a"), relational.appended_if_absent(F.lit(None).cast("array<string>"), F.lit("x")).alias("b"),
        relational.moved(F.array(*map(F.lit, "abcd")), 0, 2).alias("c"),
    ).first()
    assert (r.a, r.b, r.c) == (["a", "a", "b"], ["x"], ["b", "c", "a", "d"])


def test_changes_with_nulls(spark):
    df = spark.createDataFrame([(1, None, 5.0), (2, None, 5.0), (3, "k", None), (4, "", 1.0)], "id long, key string, v double")
    assert [r.id for r in relational.keep_first(df, ["key", "v"], [F.col("id")]).orderBy("id").collect()] == [1, 3, 4]
    assert [r.key for r in relational.fill_missing(df, "key", "u", ("", "null")).orderBy("id").collect()] == ["u", "u", "k", "u"]
    assert relational.next_id(df.limit(0), "id").first().next_id == 1
    assert relational.delete_keys(df, df.where("id < 3"), "id").count() == 2
    new = relational.insert_absent(df, spark.createDataFrame([(4, "z"), (5, "y")], "id long, key string"), "id")
    assert sorted(r.id for r in new.collect()) == [1, 2, 3, 4, 5]


def test_learning_moves_success_and_takes_new_names(spark):
    from assaykit.operators import state

    known = spark.createDataFrame([("glucose", "mg/dL", 3, 0.9, 70.0, 99.0, 0.9)], "name string, unit string, frequency int, success double, low double, high double, threshold double")
    seen = spark.createDataFrame([("Glucose", "mg/dL", 90.0, 0.5, 1), ("Glucose", "mg/dL", 91.0, 1.0, 2), ("New One", "U/L", 10.0, 0.6, 3), ("New One", "U/L", 20.0, 0.8, 4),
                                  ("Weak", "U/L", 1.0, 0.1, 5)], "name string, unit string, value double, confidence double, ord int")
    got = {r.name: r for r in state.learn_patterns(known, seen).collect()}
    assert set(got) == {"glucose", "new_one"}
    assert got["glucose"].frequency == 5 and abs(got["glucose"].success - ((0.9 * 0.9 + 0.05) * 0.9 + 0.1)) < 1e-9
    assert (got["new_one"].low, got["new_one"].high, got["new_one"].frequency) == (10.0, 40.0, 1)
    assert state.learn_patterns(known, seen, 1).count() == 1


def test_text_helpers(spark):
    from assaykit.operators import state

    r = spark.range(1).select(
        state.prepared_text(F.lit("Glucose 95\n mg/dL  (70 - 99)\x00")).alias("a"), state.table_text(F.lit("x\n| a | b | c | d |\ny")).alias("b"),
        state.sections(F.lit("Overview: fine\nAdvice: walk"), ["Overview", "Advice", "Other"]).alias("c"), state.bullets(F.lit("hi\n• one\n - two\nend")).alias("d"),
        texts.shape_reply(F.lit("A sentence. " * 100)).alias("e"), state.table_text(F.lit(None).cast("string")).alias("f"),
    ).first()
    assert r.a == "Glucose 95 mg/dL (70-99)" and r.b.startswith("| a |") and tuple(r.c) == ("fine", "walk", None) and r.d == ["one", "two"]
    assert len(r.e) <= 800 and r.e.endswith(".") and r.f == ""


def test_pairs_are_scored_as_a_table():
    """A tenant's pairs cost well below a microsecond each, and score what brute force over their fields scores."""
    import time

    import pyarrow as pa

    rng = random.Random(5)
    text = lambda k: rng.choice([None, "", "é" * 70, *("".join(rng.choices("ab 1", k=k)) for _ in range(9))])
    kind = lambda f: [x or None for x in f]

    def people(n):
        names = kind(text(9) for _ in range(n))
        return pa.table({"name": pa.array(names, pa.string()), "dob": pa.array(kind(text(1) for _ in range(n)), pa.string()), "gender": pa.array(kind(text(1) for _ in range(n)), pa.string()),
                         "id": pa.array(kind(text(6) for _ in range(n)), pa.string()), "tokens": [x or "" for x in names]})

    a, b = people(150), people(90)
    want = {}
    for i, x in enumerate(a.to_pylist()):
        for j, y in enumerate(b.to_pylist()):
            got = total = 0.0
            for f, w in matching.WEIGHTS.items():
                if x[f] and y[f]:
                    got += (matching.indel_ratio(x[f], y[f]) / 100 if f in ("name", "id") else float(x[f] == y[f])) * w
                    total += w
            if total and got / total >= 0.6:
                want[i, j] = got / total
    found = {(i, j): s for p in matching.scored_pairs(a, b, 0.6) for i, j, s in zip(*(x.tolist() for x in p), strict=True)}
    assert found == want and len(want) > 100

    names = [f"{k * 7919 % 900_000:09d} customer" for k in range(1000)]
    rows = pa.table({"name": names, "dob": pa.array([None] * 1000, pa.string()), "gender": ["x"] * 1000, "id": [str(k) for k in range(1000)], "tokens": names})
    began = time.process_time()
    assert sum(len(i) for i, _, _ in matching.scored_pairs(rows, rows, 0.9)) >= 1000
    assert time.process_time() - began < 2  # CPU seconds of 1,000,000 pairs


def test_copies_of_names_are_compared_once(spark):
    """40,000 copies that share runs of characters but don't match are no 1.6 billion pairs."""
    import time

    n = 40_000
    wanted = spark.range(n).select(F.col("id").alias("wanted"), F.lit(None).cast("long").alias("id"), F.when(F.col("id") == 7, "Bcd A").otherwise("abcd").alias("name"))
    people = spark.range(n).select(F.col("id").alias("person"), F.lit(None).cast("long").alias("id"), F.when(F.col("id") < 2, "x bcd abc").otherwise("bcd abc").alias("name"))
    began = time.time()
    found = relational.two_stage_match(wanted, people, "person", "id", "name").agg(F.min("wanted"), F.max("wanted"), F.count_distinct("match"), F.count("*")).first()
    assert tuple(found) == (7, 7, n, n)
    assert time.time() - began < 20


def test_two_stage_match_in_pieces(spark):
    """Frequent names in pieces of two rows give what a loop over all pairs gives, and nothing is sent to the driver to be broadcast."""
    rng = random.Random(5)
    name = lambda n: None if rng.random() < 0.1 else "".join(rng.choices("aB c", k=rng.randint(0, n)))
    id = lambda: rng.choice([None, None, rng.randint(1, 60)])  # noqa: E731, A001
    wanted = [(k, id(), name(4)) for k in range(60)] + [(60 + k, None, "Same") for k in range(7)]
    people = [(100 + k, id(), name(7)) for k in range(80)] + [(200 + k, None, "the SAME one") for k in range(9)] + [(300, None, "same")]
    want = []
    for w, i, n in wanted:
        same = [p for p, j, _ in people if i is not None and i == j]
        want += [(w, p) for p in same or [p for p, _, m in people if n and m and n.lower() in m.lower()]]
    frames = spark.createDataFrame(wanted, "wanted int, id int, name string"), spark.createDataFrame(people, "person int, id int, name string")
    found = relational.two_stage_match(*frames, "person", "id", "name", side=2).select("wanted", "match")
    assert sorted(map(tuple, found.collect())) == sorted(want) and len(want) > 400
    found = relational.two_stage_match(*frames, "person", "id", "name").select("wanted", "match")
    assert sorted(map(tuple, found.collect())) == sorted(want)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_one_decimal_as_c_prints_it(spark):
    rng = random.Random(9)
    at = [0.0, -0.0, 0.04, -0.04, 0.05, -0.05, 0.15, 0.25, 0.35, 0.75, 109806.25, 2.675e10, 1e13 + 0.25, 99.95, 99.949999]
    numbers = at + [rng.uniform(-1, 1) * 10 ** rng.randint(-3, 12) for _ in range(2000)] + [s * k / 20 for k in range(1500) for s in (1, -1)]
    found = spark.createDataFrame([(x,) for x in numbers], "x double").select("x", values.one_decimal(F.col("x")).alias("y")).collect()
    assert [r for r in found if r.y != f"{r.x:.1f}"] == []


def test_summary_rounds_as_its_sql(spark, tmp_path):
    """Changes of 6.25 % and 6.15 % (a double below it)."""
    import duckdb
    from oracle import difference

    rows = "(1, 'click', 16.0, 1), (1, 'click', 17.0, 2), (2, 'view', 100.0, 3), (2, 'view', 106.15, 4), (3, 'view', 1000.0, 5), (3, 'view', 1000.5, 6)"
    events = "SELECT u::BIGINT AS user_id, k AS event_type, v::DOUBLE AS value, i::BIGINT AS event_id, make_timestamp(i * 90000000000) AS ts, '{}' AS props"
    duckdb.sql(f"COPY ({events} FROM (VALUES {rows}) t(u, k, v, i)) TO '{tmp_path}/events.parquet'")
    assert difference(catalogue.person_summary(spark, str(tmp_path)), catalogue.SQL["person_summary"], str(tmp_path)) == ""
