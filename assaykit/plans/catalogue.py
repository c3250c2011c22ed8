"""Named queries over the driver's tables, each with DuckDB SQL where SQL can express it.

Outputs are flat: numbers are rounded alike on both sides, arrays are joined to texts, and every order has a last key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import texts, values
from ..operators import documents, longitudinal, matching, metrics, relational, state
from ..sources.tables import SHORT_TEXTS, measurements, people, readings, reports, spread, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: Words that stand for measurement names in the invented texts, so that scores aren't all the same.
ALIASES = ["the", "and", "glucose", "cholesterol", "hemoglobin", "des", "der", "los"]


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def r6(c) -> F.Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def day(c: str) -> F.Column:
    return F.date_format(c, "yyyy-MM-dd")


_TREND = """
WITH t AS (SELECT user_id AS person_id, event_type AS name, count(*) AS n, arg_min(value, {'a': ts, 'b': event_id}) AS f, arg_max(value, {'a': ts, 'b': event_id}) AS l
           FROM events GROUP BY ALL HAVING count(*) >= 2),
     c AS (SELECT *, CASE WHEN f = 0 OR f IS NULL OR l IS NULL THEN 0.0 ELSE (l - f) / abs(f) * 100 END AS p FROM t)
SELECT person_id, name, n, f AS first_value, l AS last_value, round(p, 6) AS change_pct,
       CASE WHEN p > 5 THEN 'increasing' WHEN p < -5 THEN 'decreasing' ELSE 'stable' END AS direction FROM c"""


@query(_TREND)
def events_trend(spark, d):
    t = longitudinal.trends(readings(spark, d), ["person_id", "name"])
    return t.select("person_id", "name", "n", "first_value", "last_value", r6("change_pct").alias("change_pct"), "direction")


@query("""
SELECT user_id AS person_id, event_type AS name, value AS latest, previous,
       CASE WHEN previous IS NULL THEN 'Unknown' WHEN abs(value - previous) < 0.001 THEN 'Stable' WHEN value > previous THEN 'Up' ELSE 'Down' END AS trend
FROM (SELECT *, row_number() OVER w AS k, lead(value) OVER w AS previous FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC))
WHERE k = 1""")
def events_latest_previous(spark, d):
    return longitudinal.latest_previous(readings(spark, d), ["person_id", "name"])


@query("""
SELECT user_id AS person_id, event_type AS name, string_agg(printf('%.2f', value), ' ' ORDER BY ts, event_id) AS vals, count(*) AS n,
       round(least(min(value), 1.0) * 0.9, 6) AS axis_low, round(greatest(max(value), 50.0) * 1.1, 6) AS axis_high
FROM events GROUP BY ALL""")
def events_series(spark, d):
    s = longitudinal.series(readings(spark, d), ["person_id", "name"], low=1.0, high=50.0)
    text = F.array_join(F.transform("values", lambda v: F.format_string("%.2f", v)), " ")
    return s.select("person_id", "name", text.alias("vals"), F.size("values").cast("long").alias("n"), r6("axis_low").alias("axis_low"), r6("axis_high").alias("axis_high"))


@query("""
SELECT event_id AS reading_id, user_id AS person_id FROM (SELECT *, max(ts) OVER (PARTITION BY user_id) AS newest FROM events)
WHERE epoch_us(newest) - epoch_us(ts) < 8 * 86400000000""")
def events_recent_week(spark, d):
    return longitudinal.recent(readings(spark, d), ["person_id"]).select("reading_id", "person_id")


@query("""
SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, string_agg(DISTINCT event_type, ', ' ORDER BY event_type) AS names FROM events GROUP BY 1""")
def events_by_day_summary(spark, d):
    return longitudinal.by_day(readings(spark, d), []).select(day("day").alias("day"), "n", "names")


@query("SELECT event_id AS reading_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def events_json_props(spark, d):
    k = F.try_variant_get(values.json_object(F.col("props")), "$.k", "long")
    return readings(spark, d).select("reading_id", k.alias("k"))


_USAGE = """
SELECT user_id AS person_id, strftime(ts, '%Y-%m-%d') AS day, count(*) AS requests, count(*) FILTER (event_type <> 'view') AS calls,
       count(*) FILTER (event_type = 'view') AS cache_hits, CAST(coalesce(sum(CASE WHEN event_type <> 'view' THEN CAST(floor(value * 100) AS BIGINT) END), 0) AS BIGINT) AS tokens
FROM events GROUP BY 1, 2"""


def _usage(spark, d):
    calls = readings(spark, d).select("person_id", "ts", F.floor(F.col("value") * 100).cast("long").alias("tokens"), (F.col("name") == "view").alias("cached"))
    return metrics.usage_daily(calls, ["person_id"])


@query(f"SELECT *, round(tokens * 45.0 / 1e6, 6) AS cost, round(100.0 * cache_hits / requests, 6) AS hit_rate FROM ({_USAGE})")
def usage_daily(spark, d):
    return _usage(spark, d).select("person_id", day("day").alias("day"), "requests", "calls", "cache_hits", "tokens", r6("cost").alias("cost"), r6("hit_rate").alias("hit_rate"))


@query(f"SELECT person_id, day, tokens, concat_ws(',', CASE WHEN tokens > 10000 THEN 'tokens' END, CASE WHEN tokens * 45.0 / 1e6 > 1.0 THEN 'cost' END) AS reasons FROM ({_USAGE}) WHERE tokens > 10000 OR tokens * 45.0 / 1e6 > 1.0")
def usage_alerts(spark, d):
    return metrics.usage_alerts(_usage(spark, d)).select("person_id", day("day").alias("day"), "tokens", "reasons")


@query("""
WITH p AS (SELECT event_type AS name, CAST(ts AS DATE) AS day, round(avg(value), 6) AS v FROM events GROUP BY ALL)
SELECT name, strftime(day, '%Y-%m-%d') AS day, v, CASE WHEN count(*) OVER w < 3 THEN 'insufficient' WHEN v > first(v) OVER w * 1.1 THEN 'improving'
       WHEN v < first(v) OVER w * 0.9 THEN 'declining' ELSE 'stable' END AS trend
FROM p WINDOW w AS (PARTITION BY name ORDER BY day ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""")
def monitor_trend5(spark, d):
    points = readings(spark, d).groupBy("name", F.to_date("ts").alias("day")).agg(r6(F.avg("value")).alias("v"))
    return metrics.monitor_trend(points, ["name"], "day", "v").select("name", day("day").alias("day"), "v", "trend")


@query("""
WITH r AS (SELECT o_custkey AS person_id, count(*) AS reports FROM orders GROUP BY 1),
     m AS (SELECT o_custkey AS person_id, count(*) AS measurements FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1)
SELECT c_custkey AS person_id, coalesce(reports, 0) AS reports, coalesce(measurements, 0) AS measurements
FROM customer LEFT JOIN r ON c_custkey = r.person_id LEFT JOIN m ON c_custkey = m.person_id""")
def profile_counts(spark, d):
    r = reports(spark, d)
    m = measurements(spark, d).join(r.select("report_id", "person_id"), "report_id")
    return relational.child_counts(people(spark, d).select("person_id"), "person_id", reports=r, measurements=m)


@query("""
SELECT c_custkey AS person_id, c_name AS name, (SELECT count(*) FROM customer WHERE lower(c_name) LIKE '%1_%') AS total
FROM customer WHERE lower(c_name) LIKE '%1_%' ORDER BY c_name, c_custkey LIMIT 10 OFFSET 20""")
def profile_search_page(spark, d):
    found = relational.search(people(spark, d).select("person_id", "name"), "1_", "name")
    paged = relational.page(found, [F.col("name"), F.col("person_id")], 20, 10)
    return paged.crossJoin(found.agg(F.count("*").alias("total")))  # one row of one number


@query("""
SELECT l_orderkey AS report_id, l_linenumber AS line, l_extendedprice AS value, o_custkey AS person_id, strftime(o_orderdate, '%Y-%m-%d') AS report_day
FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey""")
def measure_with_report(spark, d):
    r = reports(spark, d).select("report_id", F.struct("person_id", "report_date").alias("report"))
    joined = measurements(spark, d).join(r, "report_id", "left")
    return joined.select("report_id", "line", "value", F.col("report.person_id").alias("person_id"), day("report.report_date").alias("report_day"))


@query("SELECT p_partkey AS item_id, p_name AS name, p_type AS category FROM part WHERE lower(p_name) LIKE '%a_e%' ORDER BY p_name, p_partkey LIMIT 100")
def measure_search(spark, d):
    items = table(spark, d, "part").select(F.col("p_partkey").alias("item_id"), F.col("p_name").alias("name"), F.col("p_type").alias("category"))
    return relational.page(relational.search(items, "A_E", "name"), [F.col("name"), F.col("item_id")])


@query("SELECT DISTINCT p_type AS category FROM part WHERE p_type IS NOT NULL AND p_type <> '' ORDER BY 1")
def category_distinct(spark, d):
    return table(spark, d, "part").select(F.col("p_type").alias("category")).where("category != ''").distinct().orderBy("category")


@query("""
WITH f(status) AS (VALUES ('pending'), ('processing'), ('processed'), ('error')),
     c AS (SELECT CASE o_orderstatus WHEN 'F' THEN 'processed' WHEN 'P' THEN 'processing' ELSE 'pending' END AS status, count(*) AS n FROM orders GROUP BY 1)
SELECT status, coalesce(n, 0) AS n FROM f FULL JOIN c USING (status)""")
def status_histogram(spark, d):
    return relational.status_histogram(reports(spark, d), "status", ["pending", "processing", "processed", "error"])


@query("""
SELECT o_orderkey AS report_id FROM orders WHERE o_orderstatus = 'P' AND
 (CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderdate END < TIMESTAMP '1997-01-01 00:00:00' - INTERVAL 10 MINUTE
  OR (o_orderkey % 3 = 0 AND o_orderdate < TIMESTAMP '1997-01-01 00:00:00' - INTERVAL 10 MINUTE))""")
def stuck_reports(spark, d):
    r = reports(spark, d).withColumn("started", F.when(F.col("report_id") % 3 != 0, F.col("report_date")))
    now = F.lit("1997-01-01").cast(r.schema["report_date"].dataType)
    return r.where(relational.stuck(r, now, "started", "report_date")).select("report_id")


@query("""
SELECT o_orderkey AS report_id, count(*) AS children, CAST(round(least(0.95, 0.5 + 0.05 * count(*)), 6) AS DOUBLE) AS confidence
FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'F' GROUP BY 1""")
def inconsistent_reports(spark, d):
    from ..streaming.flows import healed_status

    n = measurements(spark, d).groupBy("report_id").agg(F.count("*").alias("children"))
    r = reports(spark, d).where(F.col("status").isin("pending", "processing")).join(n, "report_id")
    _, guess = healed_status(F.col("status"), F.col("children"), F.lit(None).cast("double"))
    return r.select("report_id", "children", r6(guess).alias("confidence"))


@query("""
SELECT l_partkey AS item_id, l_quantity AS quantity, nullif(l_returnflag, 'N') AS flag, count(*) AS n, min(l_orderkey * 10 + l_linenumber) AS first_id
FROM lineitem GROUP BY ALL HAVING count(*) > 1""")
def dup_groups(spark, d):
    return relational.duplicate_groups(_flagged(spark, d), ["item_id", "quantity", "flag"], "row_id")


def _flagged(spark, d):
    return table(spark, d, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_id"), F.col("l_partkey").alias("item_id"), F.col("l_quantity").alias("quantity"),
        F.nullif("l_returnflag", F.lit("N")).alias("flag"),
    )


@query("SELECT min(l_orderkey * 10 + l_linenumber) AS row_id, l_partkey AS item_id, l_quantity AS quantity, nullif(l_returnflag, 'N') AS flag FROM lineitem GROUP BY ALL")
def dup_removed(spark, d):
    return relational.keep_first(_flagged(spark, d), ["item_id", "quantity", "flag"], [F.col("row_id")])


@query("""
SELECT item_id, name FROM (SELECT p_partkey AS item_id, p_name AS name, row_number() OVER (PARTITION BY lower(trim(p_name)) ORDER BY p_partkey) AS k FROM part WHERE trim(p_name) <> '') WHERE k = 1""")
def first_occurrence(spark, d):
    items = table(spark, d, "part").select(F.col("p_partkey").alias("item_id"), F.col("p_name").alias("name")).where(F.trim("name") != "")
    return relational.keep_first(items, [F.lower(F.trim("name"))], [F.col("item_id")])


@query("""
WITH fav(place, name) AS (VALUES (0, 'purchase'), (1, 'nothing'), (2, 'view')),
 newest AS (SELECT user_id, max(ts) AS newest FROM events GROUP BY 1),
 s AS (SELECT e.user_id, event_type AS name, count(DISTINCT event_id % 50) + CASE WHEN max(ts) = max(newest) THEN 3 ELSE 0 END AS score FROM events e JOIN newest n ON e.user_id = n.user_id GROUP BY 1, 2),
 o AS (SELECT user_id, place, name FROM newest, fav WHERE user_id % 2 = 0),
 b AS (SELECT coalesce(s.user_id, o.user_id) AS person_id, coalesce(s.name, o.name) AS name, place, coalesce(score, 0) AS score FROM s FULL JOIN o ON s.user_id = o.user_id AND s.name = o.name)
SELECT person_id, name, CAST(score AS BIGINT) AS score, tile FROM (SELECT *, row_number() OVER (PARTITION BY person_id ORDER BY place NULLS LAST, score DESC, name) AS tile FROM b) WHERE tile <= 4""")
def favorites_tiles(spark, d):
    e = readings(spark, d).withColumn("report", F.col("reading_id") % 50)
    fav = e.select("person_id").distinct().where("person_id % 2 = 0").withColumn("favorites", F.array(F.lit("purchase"), F.lit("nothing"), F.lit("view")))
    tiles = longitudinal.favorite_tiles(e, fav, "person_id", "name", "ts", "report", tiles=4)
    return tiles.select("person_id", "name", "score", F.col("tile").cast("long").alias("tile"))


@query("""
SELECT event_id AS reading_id, value > 30 AS abnormal, event_type = 'purchase' AS favorite FROM events ORDER BY abnormal DESC, favorite DESC, event_id LIMIT 20""")
def priority_context_top20(spark, d):
    e = readings(spark, d).select("reading_id", (F.col("value") > 30).alias("abnormal"), (F.col("name") == "purchase").alias("favorite"))
    return e.orderBy(F.col("abnormal").desc(), F.col("favorite").desc(), "reading_id").limit(20)


@query("""
SELECT event_id AS reading_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events) WHERE k <= 15 OR value > 40 OR event_type = 'purchase'""")
def context_keep15(spark, d):
    important = (F.col("value") > 40) | (F.col("name") == "purchase")
    return longitudinal.keep_context(readings(spark, d), ["person_id"], [F.col("ts"), F.col("reading_id")], important).select("reading_id")


@query("SELECT DISTINCT user_id AS person_id FROM events WHERE user_id NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def missing_ids(spark, d):
    return relational.missing(readings(spark, d), reports(spark, d).where("priority = '1-URGENT'"), "person_id")


@query("""
SELECT min(o_orderkey) AS report_id, CASE WHEN o_custkey BETWEEN 2 AND 20 THEN 1 ELSE o_custkey END AS person_id, o_orderpriority AS priority, strftime(o_orderdate, '%Y-%m-%d') AS report_day
FROM orders GROUP BY 2, 3, 4""")
def merge_reassign(spark, d):
    moves = spark.range(2, 21).select(F.col("id").alias("old"), F.lit(1).cast("long").alias("new"))
    r = reports(spark, d).select("report_id", "person_id", "priority", day("report_date").alias("report_day"))
    return relational.merge_people(people(spark, d), r, "person_id", moves, ["priority", "report_day"], "report_id")[1]


_UNITS = ["", " mg/dl ", "MG / DL", "mg per deciliter", "percent", "pct.", "mmol / l", "millimol/l", "units/l", "mcg/ml", "mcg/dl", "MCG/ML", "K/ul", "ng/ml", "g/deciliter", "foo/l"]
_UNIT_ROWS = ", ".join(f"({i}, '{u}')" for i, u in enumerate(_UNITS))


@query(f"""
WITH u(k, unit) AS (VALUES {_UNIT_ROWS}), t AS (SELECT l_orderkey * 10 + l_linenumber AS row_id, unit, trim(unit) AS t FROM lineitem JOIN u ON k = l_partkey % {len(_UNITS)})
SELECT row_id, CASE WHEN unit = '' THEN '-' WHEN lower(t) IN ('mg/dl', 'mg / dl', 'mg/deciliter', 'mg per dl', 'mg per deciliter') THEN 'mg/dL'
 WHEN lower(t) IN ('g/dl', 'g / dl', 'g/deciliter', 'g per dl', 'g per deciliter') THEN 'g/dL' WHEN lower(t) IN ('percent', 'percentage', 'pct', 'pct.') THEN '%'
 WHEN lower(t) IN ('mmol/l', 'mmol / l', 'millimol/l', 'millimoles/l') THEN 'mmol/L' WHEN lower(t) IN ('u/l', 'units/l', 'u / l', 'iu/l') THEN 'U/L'
 ELSE replace(replace(replace(CASE WHEN lower(t) IN ('mcg/ml', 'mcg/dl', 'mcg/l') THEN replace(t, 'mcg', 'μg') ELSE t END, '/dl', '/dL'), '/ml', '/mL'), '/l', '/L') END AS unit FROM t""")
def unit_standardize(spark, d):
    units = F.array(*[F.lit(u) for u in _UNITS])
    rows = table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_id"), F.element_at(units, (F.col("l_partkey") % len(_UNITS) + 1).cast("int")).alias("u"))
    return rows.select("row_id", values.standard_unit(F.col("u")).alias("unit"))


_FACTOR_ROWS = ", ".join(f"({i}, '{n}', '{u}', {f})" for i, (n, u, f) in enumerate(values.UNIT_FACTORS))


@query(f"""
WITH f(k, name, unit, factor) AS (VALUES {_FACTOR_ROWS})
SELECT l_orderkey * 10 + l_linenumber AS row_id, name, round(l_quantity * coalesce(CAST(factor AS DOUBLE), 1.0), 6) AS value FROM lineitem LEFT JOIN f ON k = l_partkey % 20""")
def unit_convert(spark, d):
    rows = [(i, n, u, f) for i, (n, u, f) in enumerate(values.UNIT_FACTORS)]
    factors = spark.createDataFrame(rows, "k long, name string, unit string, factor double")
    m = table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_id"), (F.col("l_partkey") % 20).alias("k"), "l_quantity")
    # a dimension of a dozen rows
    return m.join(F.broadcast(factors), "k", "left").select("row_id", "name", r6(F.col("l_quantity") * F.coalesce("factor", F.lit(1.0))).alias("value"))


@query("""
WITH t AS (SELECT l_orderkey * 10 + l_linenumber AS row_id, l_partkey % 8 AS kind, CAST(l_quantity AS INTEGER) AS a, CAST(l_suppkey + 60 AS INTEGER) AS b FROM lineitem)
SELECT row_id, CAST(CASE kind WHEN 0 THEN a WHEN 2 THEN a WHEN 5 THEN a WHEN 7 THEN a END AS DOUBLE) AS low, CAST(CASE kind WHEN 0 THEN b WHEN 1 THEN b WHEN 3 THEN b WHEN 4 THEN b WHEN 7 THEN b END AS DOUBLE) AS high FROM t""")
def range_parse(spark, d):
    t = table(spark, d, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_id"), (F.col("l_partkey") % 8).alias("kind"),
        F.col("l_quantity").cast("int").cast("string").alias("a"), (F.col("l_suppkey") + 60).cast("string").alias("b"),
    )
    c = F.concat
    text = (
        F.when(F.col("kind") == 0, c("a", F.lit("-"), "b")).when(F.col("kind") == 1, c(F.lit("< "), "b")).when(F.col("kind") == 2, c(F.lit("≥ "), "a"))
        .when(F.col("kind") == 3, c(F.lit("Negative (<"), "b", F.lit(")"))).when(F.col("kind") == 4, c(F.lit("up to "), "b"))
        .when(F.col("kind") == 5, c(F.lit("above "), "a")).when(F.col("kind") == 6, F.lit("Negative")).otherwise(c("a", F.lit(" to "), "b"))
    )
    r = values.reference_range(text)
    return t.select("row_id", r["low"].alias("low"), r["high"].alias("high"))


_RANGES = "CASE event_type WHEN 'click' THEN 5.0 WHEN 'view' THEN 10.0 WHEN 'purchase' THEN 0.0 END"
_HIGHS = "CASE event_type WHEN 'click' THEN 25.0 WHEN 'view' THEN 30.0 WHEN 'signup' THEN 20.0 END"


def _ranged(spark, d):
    e, n = readings(spark, d), F.col("name")
    low = F.when(n == "click", 5.0).when(n == "view", 10.0).when(n == "purchase", 0.0)
    high = F.when(n == "click", 25.0).when(n == "view", 30.0).when(n == "signup", 20.0)
    return e.withColumns({"low": low, "high": high})


@query(f"""
WITH t AS (SELECT event_id AS reading_id, value, {_RANGES} AS low, {_HIGHS} AS high FROM events),
 s AS (SELECT *, CASE WHEN low IS NULL AND high IS NULL THEN 'Unknown' WHEN coalesce(value < low, false) OR coalesce(value > high, false) THEN 'Abnormal' ELSE 'Normal' END AS status FROM t)
SELECT reading_id, status, CASE WHEN status = 'Abnormal' THEN CASE WHEN value > high THEN 'HIGH' WHEN value < low THEN 'LOW' ELSE 'ABNORMAL' END END AS tag FROM s""")
def status_flag(spark, d):
    v, low, high = F.col("value"), F.col("low"), F.col("high")
    s = values.status(v, low, high)
    return _ranged(spark, d).select("reading_id", s.alias("status"), values.abnormal_tag(s == "Abnormal", v, low, high).alias("tag"))


@query(f"""
WITH t AS (SELECT event_id AS reading_id, value, {_RANGES} AS low, {_HIGHS} AS high FROM events)
SELECT reading_id, round(CASE WHEN low IS NULL OR high IS NULL THEN 50.0 ELSE greatest(least(20 + (value - low) / (high - low) * 60, 95.0), 5.0) END, 6) AS position FROM t""")
def range_position(spark, d):
    return _ranged(spark, d).select("reading_id", r6(values.range_position(F.col("value"), F.col("low"), F.col("high"))).alias("position"))


_CATEGORY_NAMES = ["Total Cholesterol", "HbA1c", "Free T4", "Vitamin D", "IgE", "Ferritin", "Hemoglobin", "Cobalt", "ALP", "BUN", "Sodium", "Widget"]


@query("""
WITH n(k, name) AS (VALUES """ + ", ".join(f"({i}, '{n}')" for i, n in enumerate(_CATEGORY_NAMES)) + """),
 t AS (SELECT p_partkey AS item_id, lower(name || ' ' || p_name) AS s FROM part JOIN n ON k = p_partkey % 12)
SELECT item_id, CASE """ + " ".join(f"WHEN regexp_matches(s, '{'|'.join(w)}') THEN '{c}'" for c, w in values.CATEGORY_WORDS) + """ ELSE 'Other' END AS category FROM t""")
def category_rules(spark, d):
    names = F.array(*[F.lit(n) for n in _CATEGORY_NAMES])
    name = F.concat_ws(" ", F.element_at(names, (F.col("p_partkey") % 12 + 1).cast("int")), "p_name")
    return table(spark, d, "part").select(F.col("p_partkey").alias("item_id"), values.category(name).alias("category"))


def _docs(spark, d):
    return spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", texts.plain_ascii(F.col("text")).alias("text"))


_ASCII = "regexp_replace(text, '[^\\x00-\\x7F]', '?', 'g')"


def _count(column: str, pattern: str) -> str:
    return f"len(regexp_extract_all({column}, '(?i){pattern}'))"


def _sum(column: str, patterns: list[tuple[str, int]]) -> str:
    return " + ".join(f"{_count(column, p)} * {w}" for p, w in patterns)


@query("SELECT doc_id, CAST(ceil(length(text) / 4.0) AS BIGINT) AS tokens FROM documents")
def doc_tokens(spark, d):
    return table(spark, d, "documents").select("doc_id", texts.tokens(F.col("text")).alias("tokens"))


@query(f"""
WITH t AS (SELECT doc_id, {_ASCII} AS t FROM documents), l AS (SELECT *, string_split(trim(t, ' '), chr(10)) AS ls FROM t)
SELECT doc_id, CAST(10 * {_count('t', r'\b(' + '|'.join(sorted(ALIASES)) + r')\b')} + len(regexp_extract_all(t, '{texts.RELEVANT_UNITS}'))
 + CASE WHEN len(ls) > 3 AND len(list_filter(ls, lambda x: regexp_matches(x, '{texts.TABLE_LINE}'))) > 2 THEN 5 ELSE 0 END AS BIGINT) AS score FROM l""")
def doc_relevance(spark, d):
    return _docs(spark, d).select("doc_id", texts.relevance(F.col("text"), ALIASES).cast("long").alias("score"))


_STEPS = " ".join(f"WHEN den > {n} THEN {v}" for n, v in texts.SCORE_STEPS)
_BOOST = " + ".join(f"CASE WHEN {_count('t', h)} > 0 THEN 0.15 ELSE 0 END" for h in texts.SCORE_HEADERS)
_SCORE = f"""
t AS (SELECT doc_id, {_ASCII} AS t FROM documents), p AS (SELECT *, ({_sum('t', texts.SCORE_PATTERNS)}) / (length(t) / 100.0) AS den FROM t),
c AS (SELECT doc_id, CASE WHEN length(t) < 10 THEN 0.0 ELSE CASE WHEN ({_BOOST}) > 0 THEN least(0.99, CASE {_STEPS} ELSE 0.2 END + ({_BOOST})) ELSE CASE {_STEPS} ELSE 0.2 END END END AS c FROM p)"""


@query(f"WITH {_SCORE} SELECT doc_id, round(CAST(c AS DOUBLE), 6) AS confidence FROM c")
def doc_score(spark, d):
    return _docs(spark, d).select("doc_id", r6(texts.confidence(F.col("text"))).alias("confidence"))


_SCREEN = f"""
t AS (SELECT doc_id, {_ASCII} AS t FROM documents),
p AS (SELECT *, {' + '.join(_count('t', p) for p in texts.SCREEN_LAB)} AS lab, {_sum('t', texts.SCREEN_PATTERNS)} AS pat, {' + '.join(_count('t', p) for p in texts.SCREEN_ADMIN)} AS adm FROM t),
s AS (SELECT *, round(CAST(CASE WHEN length(trim(t, ' ')) < 20 THEN 0.0 WHEN lab >= 1 THEN least(0.95, 0.7 + lab * 0.1) WHEN adm >= 3 AND pat = 0 THEN 0.1
 WHEN pat / (length(t) / 100.0) >= 2 THEN 0.9 WHEN pat / (length(t) / 100.0) >= 1 THEN 0.8 WHEN pat / (length(t) / 100.0) >= 0.5 THEN 0.6
 WHEN pat >= 3 THEN 0.7 WHEN pat >= 1 THEN 0.5 WHEN adm >= 1 THEN 0.2 ELSE 0.3 END AS DOUBLE), 6) AS conf FROM p)"""


@query(f"""
WITH {_SCREEN} SELECT doc_id, CAST(CASE WHEN lab >= 1 THEN lab * 3 ELSE pat END AS BIGINT) AS patterns, CAST(adm AS BIGINT) AS admin, conf AS confidence,
 CASE WHEN length(trim(t, ' ')) < 20 OR (lab = 0 AND pat = 0 AND adm >= 3) THEN false WHEN lab >= 1 THEN true ELSE conf >= 0.2 END AS accept_first,
 CASE WHEN length(trim(t, ' ')) < 20 OR (lab = 0 AND pat = 0 AND adm >= 3) THEN false WHEN lab >= 1 THEN true ELSE conf >= 0.4 AND NOT (pat = 0 AND adm < 3) END AS accept_sixteenth
FROM s""")
def doc_screen(spark, d):
    s = _docs(spark, d).select("doc_id", texts.screen(F.col("text")).alias("s"))
    return s.select(
        "doc_id", F.col("s.patterns").cast("long").alias("patterns"), F.col("s.admin").cast("long").alias("admin"), F.col("s.confidence").alias("confidence"),
        texts.accepts(F.col("s"), 0).alias("accept_first"), texts.accepts(F.col("s"), 15).alias("accept_sixteenth"),
    )


def _replaced(column: str, patterns: list[str], to: str = "") -> str:
    for p in patterns:
        column = f"regexp_replace({column}, '(?i){p}', '{to}', 'g')"
    return column


_LEGACY = f"regexp_replace({_ASCII}, '\\s+', ' ', 'g')"
_LEGACY = _replaced(_LEGACY, texts.LEGACY_REMOVALS)
_LEGACY = f"regexp_replace(regexp_replace({_LEGACY}, '[-_*=]{{5,}}', ' ', 'g'), '\\|{{3,}}', '|', 'g')"
_LEGACY = f"regexp_replace(regexp_replace({_LEGACY}, '(\\d+),(\\d{{3}})', '\\1\\2', 'g'), '(\\d+)\\.0+\\b', '\\1', 'g')"
_LEGACY = f"trim(regexp_replace({_LEGACY}, '\\s+', ' ', 'g'), ' ')"


@query(f"""
WITH c AS (SELECT doc_id, {_ASCII} AS t, {_LEGACY} AS c FROM documents)
SELECT doc_id, sha256(CASE WHEN ceil(length(c) / 4.0) >= ceil(length(t) / 4.0) THEN t ELSE c END) AS text_sha256 FROM c""")
def doc_compress_legacy(spark, d):
    return _docs(spark, d).select("doc_id", F.sha2(texts.compress_legacy(F.col("text")), 256).alias("text_sha256"))


_BALANCED = f"trim(regexp_replace({_replaced(_ASCII, texts.BALANCED_REMOVALS)}, '\\s+', ' ', 'g'), ' ')"


@query(f"""
WITH c AS (SELECT doc_id, {_ASCII} AS t, {_BALANCED} AS c FROM documents)
SELECT doc_id, sha256(CASE WHEN ceil(length(c) / 4.0) < ceil(length(t) / 4.0) * 0.7 OR ceil(length(c) / 4.0) >= ceil(length(t) / 4.0) THEN t ELSE c END) AS text_sha256 FROM c""")
def doc_compress_balanced(spark, d):
    return _docs(spark, d).select("doc_id", F.sha2(texts.compress_balanced(F.col("text")), 256).alias("text_sha256"))


@query()
def doc_chunks(spark, d):
    pages = spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", F.lit(1).alias("page"), "text")
    return documents.chunks(pages, "doc_id", "page", limit=300, overlap=40).select("doc_id", "ord", "estimated_tokens", r6("confidence").alias("confidence"), F.sha2("text", 256).alias("text_sha256"))


_KEEPS = """CASE WHEN short OR (lab = 0 AND pat = 0 AND adm >= 3) THEN false WHEN lab >= 1 THEN true WHEN n = 0 THEN k.conf >= 0.2 WHEN n < 10 THEN k.conf >= 0.3
 WHEN n < 15 THEN k.conf >= 0.4 AND NOT (pat = 0 AND adm IN (1, 2)) WHEN n < 20 THEN k.conf >= 0.4 AND NOT (pat = 0 AND adm < 3) ELSE k.conf >= 0.5 AND NOT (pat = 0 AND adm < 3) END"""


@query(f"""
WITH RECURSIVE {_SCREEN},
 k AS MATERIALIZED (SELECT doc_id, CAST(floor(doc_id / 25) AS BIGINT) AS report_id, row_number() OVER (PARTITION BY floor(doc_id / 25) ORDER BY doc_id) AS i, conf, lab, pat, adm, length(trim(t, ' ')) < 20 AS short FROM s),
 f AS (SELECT DISTINCT report_id, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS doc_id, CAST(0 AS DOUBLE) AS conf, CAST(0 AS DOUBLE) AS found, false AS kept, CAST(0 AS BIGINT) AS n FROM k
   UNION ALL SELECT k.report_id, k.i, k.doc_id, k.conf, CAST(CASE WHEN lab >= 1 THEN lab * 3 ELSE pat END AS DOUBLE), {_KEEPS}, n + CASE WHEN {_KEEPS} THEN 1 ELSE 0 END
   FROM f JOIN k ON k.report_id = f.report_id AND k.i = f.i + 1),
 r AS (SELECT report_id, 1 - count(*) FILTER (kept) / count(*) > 0.5 AS many FROM f WHERE i > 0 GROUP BY 1)
SELECT report_id, doc_id, conf AS screen_confidence, CASE WHEN many THEN conf >= 0.5 OR found >= 2 ELSE kept END AS kept FROM f JOIN r USING (report_id) WHERE i > 0""")
def doc_skip_fold(spark, d):
    rows = _docs(spark, d).select(F.floor(F.col("doc_id") / 25).alias("report_id"), "doc_id", "text")
    return documents.skip_chunks(rows, "report_id", ["doc_id"]).select("report_id", "doc_id", "screen_confidence", "kept")


@query("""
SELECT event_id AS reading_id, 'Glucose' AS name, value, CAST(5 AS DOUBLE) AS low, CAST(30 AS DOUBLE) AS high, value < 5 OR value > 30 AS is_abnormal FROM events WHERE event_type = 'click'""")
def extract_roundtrip(spark, d):
    name = F.when(F.col("name") == "click", "Fasting Glucose").otherwise(F.col("name"))  # the others' names aren't known
    said = spread(readings(spark, d).select("reading_id", "name", "value"), SHORT_TEXTS).select("reading_id", F.format_string("Report. %s (serum): %.2f mg/dL (5-30)\nnext", name, "value").alias("text"))
    return documents.known_measurements(said, "reading_id").select("reading_id", "name", "value", "low", "high", "is_abnormal")


@query("""
SELECT event_id AS reading_id, upper(event_type[1]) || substr(event_type, 2) AS name, value, 'mg/dL' AS unit, CAST(1 AS DOUBLE) AS low, CAST(50 AS DOUBLE) AS high, 'Other' AS category
FROM events WHERE event_type IN ('click', 'purchase')""")
def extract_loose(spark, d):
    e = spread(readings(spark, d).where("name IN ('click', 'purchase')").select("reading_id", "name", "value"), SHORT_TEXTS)
    said = e.select("reading_id", F.format_string("%s: %.2f mg/dl (1-50)", F.initcap("name"), "value").alias("text"))
    found = documents.loose_measurements(said, "reading_id")
    return found.select("reading_id", "name", "value", "unit", "low", "high", "category")


@query(r"""
SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, len(regexp_extract_all(html, '(?i)<p[ >]')) AS paragraphs,
 length(regexp_replace(html, '<[^>]*>', '', 'g')) AS text_chars FROM pages""")
def html_title_text(spark, d):
    h = F.col("html")
    return table(spark, d, "pages").select(
        "page_id", F.regexp_extract(h, "<title>([^<]*)</title>", 1).alias("title"), F.regexp_count(h, F.lit("(?i)<p[ >]")).cast("long").alias("paragraphs"),
        F.length(F.regexp_replace(h, "<[^>]*>", "")).cast("long").alias("text_chars"),
    )


_VOTE = ", ".join(
    "{'v': " + " + ".join(f"CAST(regexp_matches(t, '(?i){p}') AS INTEGER)" for p in ps) + f", 'i': {-i}, 'lab': '{lab}'" + "}" for i, (lab, ps) in enumerate(texts.LAB_NAMES)
)


@query(f"""
WITH t AS (SELECT doc_id, text || CASE doc_id % 4 WHEN 0 THEN ' Quest Diagnostics Incorporated' WHEN 1 THEN ' see mayo clinic or LabCorp.com' ELSE '' END AS t FROM documents),
 b AS (SELECT doc_id, list_max([{_VOTE}]) AS b FROM t)
SELECT doc_id, CASE WHEN b.v > 0 THEN b.lab END AS lab, CAST(b.v AS BIGINT) AS votes, round(CAST(CASE WHEN b.v > 0 THEN least(0.95, 0.6 + b.v * 0.1) ELSE 0 END AS DOUBLE), 6) AS confidence FROM b""")
def lab_type_votes(spark, d):
    tail = F.when(F.col("doc_id") % 4 == 0, " Quest Diagnostics Incorporated").when(F.col("doc_id") % 4 == 1, " see mayo clinic or LabCorp.com").otherwise("")
    v = table(spark, d, "documents").select("doc_id", texts.lab_votes(F.concat("text", tail)).alias("v"))
    return v.select("doc_id", F.col("v.lab").alias("lab"), F.col("v.votes").cast("long").alias("votes"), r6("v.confidence").alias("confidence"))


@query(f"""
WITH {_SCORE}, b AS (SELECT doc_id, ceil(length({_ASCII}) / 4.0) AS before, ceil(length({_BALANCED}) / 4.0) AS bal, ceil(length({_LEGACY}) / 4.0) AS leg FROM documents),
 m AS (SELECT 'balanced' AS mode, before, CASE WHEN bal < before * 0.7 OR bal >= before THEN before ELSE bal END AS after, CAST(c AS DOUBLE) AS conf FROM b JOIN c USING (doc_id)
       UNION ALL SELECT 'legacy', before, CASE WHEN leg >= before THEN before ELSE leg END, CAST(c AS DOUBLE) FROM b JOIN c USING (doc_id))
SELECT mode, count(*) AS n, round(100.0 * (sum(before) - sum(after)) / sum(before), 6) AS reduction_pct, round(avg(conf), 6) AS mean_confidence,
 count(*) FILTER (conf >= 0.7) AS confident, round(avg(after), 6) AS mean_tokens FROM m GROUP BY mode""")
def mode_metrics(spark, d):
    t = F.col("text")
    rows = _docs(spark, d).select(texts.tokens(t).alias("before"), r6(texts.confidence(t)).alias("score"), F.explode(F.array(
        F.struct(F.lit("legacy").alias("mode"), texts.tokens(texts.compress_legacy(t)).alias("after")),
        F.struct(F.lit("balanced").alias("mode"), texts.tokens(texts.compress_balanced(t)).alias("after")))).alias("m"))
    found = metrics.mode_metrics(rows.select("before", "score", "m.*"), "mode", "before", "after", "score")
    return found.select("mode", "n", r6("reduction_pct").alias("reduction_pct"), r6("mean_confidence").alias("mean_confidence"), "confident", r6("mean_tokens").alias("mean_tokens"))


@query("""
SELECT c_custkey AS person_id, CASE WHEN c_custkey % 5 = 0 AND c_custkey % 10 <> 0 THEN 'renamed ' || c_custkey ELSE c_name END AS name,
 CASE WHEN c_custkey % 5 = 0 THEN 'UPDATED' ELSE c_mktsegment END AS segment FROM customer""")
def partial_update(spark, d):
    p = people(spark, d).select("person_id", "name", "segment")
    changes = p.where("person_id % 5 = 0").select(
        "person_id", F.when(F.col("person_id") % 10 != 0, F.concat(F.lit("renamed "), F.col("person_id").cast("string"))).alias("name"), F.lit("UPDATED").alias("segment")
    )
    return relational.partial_update(p, changes, "person_id")


@query("SELECT o_orderkey AS report_id, CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE o_custkey END AS person_id FROM orders")
def backfill_null(spark, d):
    r = reports(spark, d).select("report_id", F.when(F.col("report_id") % 7 != 0, F.col("person_id")).alias("person_id"))
    return relational.fill_missing(r, "person_id", 1)


@query("SELECT DISTINCT p_type AS name FROM part WHERE p_type NOT IN (SELECT p_type FROM part WHERE p_partkey <= 3) AND contains(lower(p_type), 'e') ORDER BY 1")
def favorite_candidates(spark, d):
    items = table(spark, d, "part").select(F.col("p_partkey").alias("item_id"), F.col("p_type").alias("name"))
    chosen = items.where("item_id <= 3").select("name")
    return items.select("name").distinct().join(chosen, "name", "left_anti").where(F.contains(F.lower("name"), F.lit("e"))).orderBy("name")


@query(f"""
WITH {_SCREEN}, j AS (SELECT conf >= 0.5 AS guess, quality = 1 AS actual, conf FROM s JOIN labels USING (doc_id)),
 k AS (SELECT count(*) FILTER (guess AND actual) AS tp, count(*) FILTER (guess AND NOT actual) AS fp, count(*) FILTER (NOT guess AND actual) AS fn, round(avg(conf), 6) AS mean_score FROM j)
SELECT tp, fp, fn, mean_score, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall FROM k""")
def quality_precision_recall(spark, d):
    s = texts.screen(F.col("text"))["confidence"]
    rows = _docs(spark, d).select("doc_id", s.alias("c")).join(table(spark, d, "labels"), "doc_id")
    m = metrics.precision_recall(rows, F.col("c") >= 0.5, F.col("quality") == 1, F.col("c"))
    return m.select("tp", "fp", "fn", r6("mean_score").alias("mean_score"), r6("precision").alias("precision"), r6("recall").alias("recall"))


@query()
def match_profiles(spark, d):
    p = people(spark, d)
    fields = [F.col("tenant_id").alias("tenant"), F.lit(None).cast("string").alias("dob"), F.col("segment").alias("gender")]
    have = p.select("person_id", *fields, "name", F.col("person_id").cast("string").alias("id"))
    swapped = F.concat_ws(" ", F.reverse(F.split("name", "#")))
    off = F.when(F.col("person_id") % 3 == 0, None).otherwise(F.concat(F.col("person_id").cast("string"), F.lit("1")))
    seen = p.select(F.col("person_id").alias("row_id"), *fields, swapped.alias("name"), off.alias("id"))
    return matching.match_people(seen, have, 0.8).withColumn("score", r6("score"))


@query("SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations) WHERE k <= 3")
def chat_last_n(spark, d):
    return longitudinal.last_n(table(spark, d, "conversations"), ["conv_id"], [F.col("turn").desc()], 3).select("conv_id", "turn", "role")


@query(r"""
SELECT conv_id, turn, CAST(greatest(floor(len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) * 0.75
 + length(text) - length(regexp_replace(text, '[.,!?]', '', 'g')) + (len(regexp_extract_all(lower(text), 'mg/dl|cholesterol|glucose'))) * 0.5), 1) AS BIGINT) AS tokens FROM conversations""")
def chat_tokens(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", texts.chat_tokens(F.col("text")).alias("tokens"))


@query("""
WITH n AS (SELECT DISTINCT lower(split_part(trim(p_name), ' ', 1)) AS name FROM part),
 w AS (SELECT DISTINCT conv_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS name FROM conversations)
SELECT conv_id, name FROM w JOIN n USING (name) UNION ALL SELECT conv_id, name FROM w WHERE name IN ('the', 'and') AND name NOT IN (SELECT name FROM n)""")
def chat_mentions(spark, d):
    names = table(spark, d, "part").select(F.lower(F.split_part(F.trim("p_name"), F.lit(" "), F.lit(1))).alias("name"))
    names = names.union(spark.createDataFrame([("the",), ("and",)], "name string")).distinct()
    words = table(spark, d, "conversations").select("conv_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("name")).distinct()
    return words.join(names, "name").select("conv_id", "name")


@query("SELECT sha256(text) AS file_id, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def content_hash_dups(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("file_id"))
    return relational.duplicate_groups(docs, ["file_id"], "doc_id")


@query(f"""
WITH s AS ({_TREND}), l AS (SELECT person_id, string_agg(line, chr(10) ORDER BY line) AS trends FROM (SELECT person_id, printf('%s: %s (%.1f%%) over %d readings', name, direction, change_pct, n) AS line FROM s) GROUP BY 1),
 p AS (SELECT user_id AS person_id, CAST(ts AS DATE) AS day, count(*) AS n, string_agg(DISTINCT event_type, ', ' ORDER BY event_type) AS names FROM events GROUP BY 1, 2),
 b AS (SELECT person_id, sum(n) AS n, max(day) AS newest, string_agg(printf('%s: %d (%s)', CAST(day AS VARCHAR), n, names), chr(10) ORDER BY day DESC) AS days FROM p GROUP BY 1)
SELECT b.person_id, printf('Readings: %d, newest on %s', CAST(n AS BIGINT), CAST(newest AS VARCHAR)) || coalesce(chr(10) || chr(10) || 'Trends' || chr(10) || trends, '') || chr(10) || chr(10) || 'By day' || chr(10) || days AS summary
FROM b LEFT JOIN l ON l.person_id = b.person_id""")
def person_summary(spark, d):
    return longitudinal.summary_text(readings(spark, d), "person_id")


@query(r"""
WITH t AS (SELECT doc_id, """ + _ASCII + r""" AS t FROM documents)
SELECT doc_id, round(CAST(least(0.99, 0.5 + CASE WHEN regexp_matches(t, '(?:\|[^|]+\|[^|]+\|)|(?:[^\t]\t[^\t]+\t[^\t])') THEN 0.1 ELSE 0 END
 + CASE WHEN regexp_matches(t, '(?i)\b(?:TEST|RESULT|REFERENCE RANGE)\b') THEN 0.05 ELSE 0 END
 + CASE WHEN regexp_matches(t, '(?i)\b(?:HIGH|LOW|ABNORMAL|NORMAL|H|L|A|N)\b') THEN 0.05 ELSE 0 END) AS DOUBLE), 6) AS confidence FROM t""")
def doc_boosters(spark, d):
    return _docs(spark, d).select("doc_id", r6(state.boosted(F.col("text"), F.lit(0.5), "legacy")).alias("confidence"))


@query("""
SELECT user_id AS person_id, event_type AS name, max(event_id) AS page, arg_max(value, event_id) AS value FROM events GROUP BY 1, 2""")
def context_merge(spark, d):
    known = readings(spark, d).withColumnRenamed("reading_id", "page")
    return state.merge_contexts(known, "person_id", "name", "page", "value")


@query("""
WITH g AS (SELECT user_id AS person_id, lag(event_id) OVER w AS before, event_id AS after FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
 b AS (SELECT *, after - before AS gap FROM g WHERE after - before > 100)
SELECT person_id, before, after, gap, row_number() OVER (PARTITION BY person_id ORDER BY gap DESC, before) = 1 AS largest FROM b""")
def gap_analysis(spark, d):
    return state.gaps(readings(spark, d), ["person_id"], "reading_id", 100)


@query("""
WITH p AS (SELECT user_id AS person_id, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1, 2)
SELECT person_id, strftime(day, '%Y-%m-%d') AS day, array_to_string(list(n) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), ' ') AS last_three,
 round(avg(n) OVER (w ROWS BETWEEN 1 PRECEDING AND CURRENT ROW), 6) AS mean_of_two, round(avg(n) OVER (w ROWS UNBOUNDED PRECEDING), 6) AS mean_so_far
FROM p WINDOW w AS (PARTITION BY person_id ORDER BY day)""")
def discovery_rates(spark, d):
    p = readings(spark, d).groupBy("person_id", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    f = state.discovery(p, ["person_id"], "day", "n")
    return f.select("person_id", day("day").alias("day"), F.array_join(F.transform("last_three", lambda x: x.cast("string")), " ").alias("last_three"),
                    r6("mean_of_two").alias("mean_of_two"), r6("mean_so_far").alias("mean_so_far"))


@query("""
SELECT event_id AS reading_id FROM (SELECT *, max(value) OVER (PARTITION BY user_id, event_type ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM events WHERE value >= 5)
WHERE b IS NULL OR value > b""")
def new_or_surer(spark, d):
    return state.new_or_surer(readings(spark, d), ["person_id"], "name", "reading_id", "value", 5).select("reading_id")


@query("""
SELECT name, frequency, round(success, 6) AS success FROM (SELECT event_type || user_id AS name, count(*) AS frequency, avg(value) / 100 AS success FROM events GROUP BY 1)
ORDER BY frequency * success DESC, name LIMIT 62""")
def pattern_eviction(spark, d):
    p = readings(spark, d).groupBy(F.concat("name", F.col("person_id").cast("string")).alias("name")).agg(F.count("*").alias("frequency"), (F.avg("value") / 100).alias("success"))
    return state.evict(p, 90).select("name", "frequency", r6("success").alias("success"))


@query("""
WITH t AS (SELECT *, lag(value) OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS k FROM events)
SELECT event_id AS reading_id, round(CAST(greatest(0.0, least(1.0, 0.7 + CASE WHEN event_type <> 'error' THEN 0.1 ELSE -0.2 END + CASE WHEN event_id % 2 = 0 THEN 0.05 ELSE 0 END
 - CASE WHEN k = value THEN 0.1 WHEN abs(k - value) / nullif(greatest(k, value), 0) > 0.5 THEN 0.15 ELSE 0 END)) AS DOUBLE), 6) AS confidence FROM t""")
def context_confidence(spark, d):
    w = Window.partitionBy("person_id", "name").orderBy("reading_id")
    e = readings(spark, d).withColumn("known", F.lag("value").over(w))
    c = state.context_confidence(F.col("name") != "error", F.col("reading_id") % 2 == 0, F.lit(False), F.col("value"), F.col("known"))
    return e.select("reading_id", r6(c).alias("confidence"))


@query("""
SELECT o_orderkey AS report_id, round(CAST(least(0.95, (sum(0.5 + CASE WHEN l_linenumber = 1 THEN 0.2 ELSE 0 END + CASE WHEN l_quantity > 25 THEN 0.1 ELSE 0 END) + 1.2) / (count(*) + 1)
 + least(0.2, sum(CASE WHEN l_linenumber = 1 THEN 1 ELSE 0 END) * 0.05)) AS DOUBLE), 6) AS confidence FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1""")
def layout_confidence(spark, d):
    pages = measurements(spark, d).select("report_id", F.when(F.col("line") == 1, 1).otherwise(0).alias("tables"), F.when(F.col("quantity") > 25, 0.8).otherwise(0.1).alias("content_confidence"), F.lit(0.6).alias("type_confidence"))
    return state.structure_confidence(pages, "report_id").select("report_id", r6("confidence").alias("confidence"))


@query()
def dense_zone_chunks(spark, d):
    docs = spread(table(spark, d, "documents").select("doc_id", "text"))
    return docs.select("doc_id", F.posexplode(state.dense_chunks(F.col("text"), 400)).alias("ord", "text")).select("doc_id", "ord", F.sha2("text", 256).alias("text_sha256"))


from . import flows, lookups, upkeep  # noqa: E402, F401  their queries register themselves
