"""Queries of table upkeep (deleting, merging, assigning, comparing), of shown tables and lists, and of figures on runs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import texts, values
from ..operators import longitudinal, metrics, relational
from ..sources.files import append_new, with_column_if_missing
from ..sources.storage import written
from ..sources.tables import measurements, people, readings, reports, table
from ..streaming import flows
from .catalogue import _SCREEN, _docs, day, query, r6

# changing tables ----------------------------------------------------------------------------------------------------------


@query("SELECT o_orderkey AS report_id, CASE WHEN o_custkey <> 7 THEN o_custkey END AS person_id FROM orders")
def unlink_person(spark, d):
    return relational.unlink(reports(spark, d), "person_id", F.col("person_id") == 7).select("report_id", "person_id")


@query("SELECT o_orderkey AS report_id FROM orders WHERE o_orderkey % 5 <> 0")
def delete_reports(spark, d):
    r = reports(spark, d).select("report_id")
    return relational.delete_keys(r, r.where("report_id % 5 = 0"), "report_id")


@query("""
SELECT o_orderkey AS report_id, count(l_orderkey) AS measurements FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderkey % 4 <> 1 GROUP BY 1""")
def delete_cascade(spark, d):
    r, m = reports(spark, d).select("report_id"), measurements(spark, d)
    parents, children = relational.cascade_delete(r, m, r.where("report_id % 4 = 1"), "report_id")
    return relational.child_counts(parents, "report_id", measurements=children)


@query("SELECT c_custkey AS person_id, CASE WHEN c_custkey % 4 < 3 THEN 'u1' ELSE 'u2' END AS owner FROM customer")
def assign_unowned(spark, d):
    owner = F.element_at(F.array(F.lit(None).cast("string"), F.lit(""), F.lit("null"), F.lit("u2")), (F.col("person_id") % 4 + 1).cast("int"))
    return relational.fill_missing(people(spark, d).select("person_id", owner.alias("owner")), "owner", "u1", ("", "null"))


@query("SELECT (SELECT max(o_orderkey) + 1 FROM orders) AS next_id")
def next_report_id(spark, d):
    return relational.next_id(reports(spark, d), "report_id")


@query("SELECT c_custkey AS person_id, c_name AS name FROM customer WHERE c_custkey % 3 <> 0 UNION ALL SELECT c_custkey, 'new ' || c_name FROM customer WHERE c_custkey % 3 = 0")
def insert_absent(spark, d):
    p = people(spark, d).select("person_id", "name")
    return relational.insert_absent(p.where("person_id % 3 != 0"), p.withColumn("name", F.concat(F.lit("new "), "name")), "person_id")


@query("""
SELECT person_id, count(o_orderkey) AS reports FROM (SELECT c_custkey AS person_id FROM customer WHERE c_custkey % 3 <> 0 UNION SELECT -1) LEFT JOIN orders ON o_custkey = person_id GROUP BY 1""")
def person_added(spark, d):
    p = people(spark, d).select("person_id").where("person_id % 3 != 0")
    added = relational.insert_absent(p, spark.createDataFrame([(-1,), (1,)], "person_id long"), "person_id")
    return relational.child_counts(added, "person_id", reports=reports(spark, d))


@query("""
SELECT o_orderkey AS report_id, CASE WHEN o_orderstatus = 'P' THEN 'pending' WHEN o_orderstatus = 'F' THEN 'processed' ELSE 'pending' END AS status FROM orders""")
def reset_stuck(spark, d):
    r = reports(spark, d)
    return relational.reset_status(r, F.col("status") == "processing").select("report_id", "status")


@query("SELECT (SELECT count(*) FROM orders) AS rows_a, (SELECT count(*) FROM orders) AS rows_b, true AS same")
def copy_verified(spark, d):
    r = reports(spark, d)
    return relational.same_rows(r, written(r.repartition(3, "person_id").select(*reversed(r.columns)), "copy"))


@query("SELECT o_orderkey AS report_id, CAST(NULL AS VARCHAR) AS started FROM orders WHERE o_orderkey < 100")
def column_added(spark, d):
    r = with_column_if_missing(reports(spark, d), "started", "string")
    return with_column_if_missing(r, "report_id", "string").where("report_id < 100").select("report_id", "started")


@query("SELECT min(doc_id) AS doc_id, sha256(text) AS file_id FROM documents GROUP BY text HAVING min(doc_id) % 2 = 1 AND count(*) FILTER (doc_id % 2 = 0) = 0")
def upload_new(spark, d):
    files = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("file_id"))
    stored, incoming = files.where("doc_id % 2 = 0"), relational.keep_first(files.where("doc_id % 2 = 1"), ["file_id"], [F.col("doc_id")])
    return append_new(stored, incoming)


@query("SELECT o_custkey AS person_id, arg_max(o_orderstatus, o_orderkey) AS status, max(o_orderkey) AS at FROM orders GROUP BY 1")
def latest_states(spark, d):
    changes = table(spark, d, "orders").select(F.col("o_custkey").alias("person_id"), F.col("o_orderkey").alias("at"), F.col("o_orderstatus").alias("status"))
    return flows.latest_status(changes, "person_id", "at", "status")


@query("SELECT event_id AS reading_id FROM events WHERE epoch_us(TIMESTAMP '2024-01-31 00:00:00') - epoch_us(ts) <= 7 * 86400000000")
def cache_fresh(spark, d):
    return flows.fresh(readings(spark, d), "ts", F.lit("2024-01-31").cast("timestamp_ntz"), 7).select("reading_id")


# finding and showing rows ------------------------------------------------------------------------------------------------


@query("SELECT c_custkey AS person_id, c_name AS name FROM customer WHERE c_custkey = 42")
def point_lookup(spark, d):
    return relational.point(people(spark, d).select("person_id", "name"), "person_id", 42)


@query("SELECT l_orderkey AS report_id, l_linenumber AS line FROM lineitem WHERE l_linestatus = 'F' AND l_partkey = 5")
def equality_filters(spark, d):
    return relational.where_equal(measurements(spark, d), unit="F", item_id=5, line=None).select("report_id", "line")


@query("SELECT c_custkey AS person_id FROM customer WHERE c_nationkey = 3 AND lower(c_name) LIKE '%1%'")
def tenant_people(spark, d):
    return relational.search(relational.of_tenant(people(spark, d), 3), "1", "name").select("person_id")


@query("""
SELECT event_id AS reading_id FROM events WHERE contains(lower(event_type), '2.5') OR contains(regexp_replace(CAST(value AS VARCHAR), '\\.0$', ''), '2.5') OR contains(lower(props), '2.5')""")
def client_search(spark, d):
    return relational.search_fields(readings(spark, d), "2.5", "name", "value", "props").select("reading_id")


@query("""
SELECT l_orderkey AS report_id, l_linenumber AS line FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'O' AND l_partkey % 3 = 0""")
def history_filtered(spark, d):
    m = measurements(spark, d).withColumns({"category": F.nullif("unit", F.lit("O")), "file_name": F.when(F.col("item_id") % 3 != 0, F.concat(F.lit("f"), F.col("item_id").cast("string")))})
    return relational.history_filter(m, "Uncategorized", True, "Unknown Report").select("report_id", "line")


@query("""
SELECT 'All' AS choice, 0 AS place UNION ALL SELECT choice, 1 FROM (SELECT p_type AS choice FROM part UNION SELECT c_mktsegment FROM customer)""")
def category_choices(spark, d):
    c = relational.choices(table(spark, d, "part").select("p_type"), people(spark, d).select("segment"))
    return c.orderBy("place", "choice")


@query("SELECT p_partkey AS item_id, p_name AS name, p_retailprice AS price FROM part ORDER BY p_retailprice DESC NULLS LAST, p_partkey LIMIT 10 OFFSET 20")
def table_page(spark, d):
    items = table(spark, d, "part").select(F.col("p_partkey").alias("item_id"), F.col("p_name").alias("name"), F.col("p_retailprice").alias("price"))
    return relational.page_number(items, relational.table_order("price", "double", False, "item_id"), 3)


@query("SELECT p_partkey AS item_id, p_name AS name FROM part ORDER BY lower(coalesce(p_name, '')), p_partkey LIMIT 25")
def table_by_name(spark, d):
    items = table(spark, d, "part").select(F.col("p_partkey").alias("item_id"), F.col("p_name").alias("name"))
    return relational.page_number(items, relational.table_order("name", "string", True, "item_id"), 1, 25)


@query("""
WITH n AS (SELECT p_partkey AS item_id, CASE WHEN p_partkey % 3 = 0 THEN replace(upper(p_name), 'A', 'Á') WHEN p_partkey % 3 = 1 THEN p_name END AS name FROM part)
SELECT item_id, name, row_number() OVER (ORDER BY strip_accents(lower(coalesce(name, ''))), lower(coalesce(name, '')), item_id) AS place FROM n
QUALIFY place <= 900""")
def table_by_accented_name(spark, d):
    key = F.col("p_partkey")
    name = F.when(key % 3 == 0, F.replace(F.upper("p_name"), F.lit("A"), F.lit("Á"))).when(key % 3 == 1, F.col("p_name"))
    items = table(spark, d, "part").select(key.alias("item_id"), name.alias("name"))
    order = relational.table_order("name", "string", True, "item_id")
    first = relational.page(items, order, 0, 900)
    return first.select("item_id", "name", F.row_number().over(Window.orderBy(*order)).cast("long").alias("place"))  # 900 rows


@query("""
WITH t AS (SELECT event_id, value, CASE event_id % 5 WHEN 0 THEN true WHEN 1 THEN false END AS flag, CASE WHEN event_id % 5 = 2 THEN 10.0 END AS low, CASE WHEN event_id % 5 IN (2, 3) THEN 40.0 END AS high FROM events)
SELECT event_id AS reading_id, CASE WHEN flag IS NOT NULL THEN flag WHEN event_id % 5 = 2 THEN value < 10 OR value > 40 WHEN event_id % 5 = 3 THEN value > 25 ELSE value < 30 END AS abnormal
FROM t ORDER BY abnormal DESC, event_id LIMIT 1000""")
def table_by_status(spark, d):
    k = F.col("reading_id") % 5
    flag, low, high = F.when(k == 0, True).when(k == 1, False), F.when(k == 2, 10.0), F.when(k.isin(2, 3), 40.0)
    said = F.when(k == 3, "<= 25").when(k == 4, " > 30 ").otherwise("1-2")
    rows = readings(spark, d).select("reading_id", values.outside_range(flag, F.col("value"), low, high, said).alias("abnormal"))
    return relational.page(rows, relational.table_order("abnormal", "boolean", False, "reading_id"), 0, 1000)


@query("""
SELECT p_type AS category, row_number() OVER (PARTITION BY p_type ORDER BY p_size, p_partkey) AS place, p_name AS text FROM part""")
def suggestions_grouped(spark, d):
    q = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("category"), F.col("p_size").alias("priority"), F.col("p_name").alias("text"))
    return relational.suggestions(q).select("category", F.col("place").cast("long").alias("place"), "text")


@query("""
SELECT conv_id, turn, concat_ws('|', CASE WHEN contains(lower(text), 'diet') OR contains(lower(text), 'nutrition') OR turn % 3 = 0 THEN 'What specific foods should I focus on?' END,
 CASE WHEN contains(lower(text), 'exercise') THEN 'What type of exercise routine would you recommend?' END,
 CASE WHEN turn > 1 THEN 'How are my abnormal biomarkers related to each other?' END) AS questions FROM conversations""")
def follow_up_questions(spark, d):
    said = F.concat("text", F.when(F.col("turn") % 3 == 0, " Nutrition").otherwise(""))
    return table(spark, d, "conversations").select("conv_id", "turn", F.concat_ws("|", relational.follow_ups(said, F.col("turn"))).alias("questions"))


@query("SELECT o_custkey AS person_id, string_agg(o_orderkey, ' ' ORDER BY o_orderkey) FILTER (o_orderkey % 10 <> 3) AS sources FROM orders GROUP BY 1")
def merge_sources(spark, d):
    chosen = reports(spark, d).groupBy("person_id").agg(F.array_sort(F.collect_list("report_id")).alias("r"))
    target = F.try_element_at(F.filter("r", lambda x: x % 10 == 3), F.lit(1))
    rest = relational.sources_without(F.filter("r", lambda x: (x % 10 != 3) | (x == target)), target)
    return chosen.select("person_id", F.when(F.size(rest) > 0, F.array_join(F.transform(rest, lambda x: x.cast("string")), " ")).alias("sources"))


@query("SELECT min(event_id) AS reading_id, event_type AS name, value FROM events GROUP BY 2, 3")
def distinct_shown(spark, d):
    e = readings(spark, d)
    both = e.unionByName(e.where("reading_id % 2 = 0"))  # the results of two files, put together
    key = F.concat_ws("_", "name", F.col("value").cast("string"))
    return relational.keep_first(both, [key], [F.col("reading_id")]).select("reading_id", "name", "value")


@query("""
SELECT c_custkey AS person_id, CASE c_custkey % 3 WHEN 0 THEN 'hdl,ldl,tsh' WHEN 1 THEN 'ldl,tsh,hdl' ELSE 'hdl,ldl' END AS appended, CASE c_custkey % 3 WHEN 0 THEN 'ldl' WHEN 1 THEN 'ldl,tsh' ELSE 'ldl' END AS removed,
 CASE c_custkey % 3 WHEN 0 THEN 'ldl,hdl' WHEN 1 THEN 'tsh,ldl' ELSE 'ldl,hdl' END AS moved FROM customer""")
def favorite_lists(spark, d):
    k, words = F.col("person_id") % 3, lambda *w: F.array(*[F.lit(x) for x in w])
    own = F.when(k == 0, words("hdl", "ldl")).when(k == 1, words("ldl", "tsh")).otherwise(words("hdl", "ldl"))
    new = F.when(k == 0, "tsh").when(k == 1, "hdl").otherwise("ldl")
    text = lambda a: F.array_join(a, ",")
    return people(spark, d).select(
        "person_id", text(relational.appended_if_absent(own, new)).alias("appended"), text(relational.first_position_removed(own, F.lit("hdl"))).alias("removed"), text(relational.moved(own, 0, 1)).alias("moved"),
    )


@query("""
WITH t AS (SELECT user_id AS person_id, event_type AS name, arg_min(value, {'a': ts, 'b': event_id}) AS f, arg_max(value, {'a': ts, 'b': event_id}) AS l FROM events GROUP BY ALL HAVING count(*) >= 2),
 c AS (SELECT *, CASE WHEN f = 0 THEN 0 ELSE (l - f) / abs(f) * 100 END AS p FROM t),
 n AS (SELECT person_id, CASE name WHEN 'click' THEN 'HDL' WHEN 'view' THEN 'ldl' WHEN 'purchase' THEN 'glucose' ELSE name END AS name, CASE WHEN p > 5 THEN 1 WHEN p < -5 THEN -1 ELSE 0 END AS s FROM c)
SELECT person_id, name, CASE name WHEN 'HDL' THEN s = 1 WHEN 'ldl' THEN s = -1 WHEN 'glucose' THEN s = 0 END AS improving FROM n""")
def improving_series(spark, d):
    name = F.when(F.col("name") == "click", "HDL").when(F.col("name") == "view", "ldl").when(F.col("name") == "purchase", "glucose").otherwise(F.col("name"))
    t = longitudinal.trends(readings(spark, d), ["person_id", "name"]).withColumn("name", name)
    return t.select("person_id", "name", longitudinal.improving(F.col("name"), F.col("direction")).alias("improving"))


@query("""
WITH e AS (SELECT *, CASE WHEN event_id % 4 <> 0 THEN CASE WHEN event_id % 3 = 0 THEN 'mg/dL' ELSE '' END END AS unit, nullif(event_id % 2, 0) AS c FROM events)
SELECT user_id AS person_id, event_type AS name, string_agg(event_id, ' ' ORDER BY ts, event_id) AS ids, coalesce(nullif(arg_min(coalesce(unit, ''), {'a': ts, 'b': event_id}), ''), 'N/A') AS unit,
 arg_min(CAST(user_id AS DOUBLE), {'a': ts, 'b': event_id}) AS low, count(DISTINCT coalesce(c, 0)) AS categories FROM e GROUP BY 1, 2""")
def chart_series(spark, d):
    k = F.col("reading_id")
    e = readings(spark, d).withColumns({
        "unit": F.when(k % 4 != 0, F.when(k % 3 == 0, "mg/dL").otherwise("")), "low": F.col("person_id").cast("double"), "high": F.lit(None).cast("double"), "category": F.when(k % 2 != 0, "odd"),
    })
    s = longitudinal.chart_series(e, ["person_id", "name"], "ts", "value", "unit", "low", "high", "category", "reading_id")
    return s.select("person_id", "name", F.array_join(F.transform("ids", lambda i: i.cast("string")), " ").alias("ids"), "unit", "low", F.size("categories").cast("long").alias("categories"))


@query("""
SELECT user_id AS person_id, count(*) AS n, count(*) FILTER (value > 30 AND ts >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 30 DAY + INTERVAL 20 DAY) AS abnormal_recent FROM events GROUP BY 1""")
def abnormal_recent(spark, d):
    e = readings(spark, d).withColumn("abnormal", F.col("value") > 30)
    return longitudinal.abnormal_recent(e, ["person_id"], "ts", "abnormal", F.lit("2024-01-31").cast("timestamp_ntz"), 10)


@query("""
SELECT o_custkey AS person_id, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS abnormal, count(DISTINCT coalesce(nullif(l_linestatus, 'O'), '?')) AS categories
FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1""")
def category_tiles(spark, d):
    m = measurements(spark, d).join(reports(spark, d).select("report_id", "person_id"), "report_id").withColumn("category", F.nullif("unit", F.lit("O")))
    return longitudinal.tiles(m, ["person_id"], "is_abnormal", "category")


# figures on runs ---------------------------------------------------------------------------------------------------------


@query("""
SELECT o_orderkey AS report_id, round(coalesce(avg(CASE WHEN l_orderkey IS NOT NULL THEN coalesce(CASE WHEN l_linenumber % 3 <> 0 THEN l_discount END, 0) END), 0), 6) AS parsing_confidence
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_linenumber > 1 GROUP BY 1""")
def report_confidence(spark, d):
    found = table(spark, d, "lineitem").where("l_linenumber > 1").select(F.col("l_orderkey").alias("report_id"), F.when(F.col("l_linenumber") % 3 != 0, F.col("l_discount")).alias("score"))
    m = metrics.mean_confidence(reports(spark, d).select("report_id"), found, "report_id", "score")
    return m.select("report_id", r6("parsing_confidence").alias("parsing_confidence"))


_KEPT = "NOT (length(trim(t, ' ')) < 20 OR (lab = 0 AND pat = 0 AND adm >= 3)) AND (lab >= 1 OR (conf >= 0.4 AND NOT (pat = 0 AND adm < 3)))"


@query(f"""
WITH {_SCREEN}, k AS (SELECT *, CAST(floor(doc_id / 100) AS BIGINT) AS report_id, {_KEPT} AS kept, CAST(ceil(length(t) / 4.0) AS BIGINT) AS tokens FROM s)
SELECT report_id, count(*) AS total_chunks, count(*) FILTER (NOT kept) AS skipped, count(*) FILTER (kept) AS processed, count(*) FILTER (conf >= 0.8) AS high, count(*) FILTER (conf >= 0.6 AND conf < 0.8) AS medium,
 count(*) FILTER (conf >= 0.4 AND conf < 0.6) AS low, count(*) FILTER (conf < 0.4) AS very_low, CAST(coalesce(sum(CASE WHEN NOT kept THEN tokens END), 0) AS BIGINT) AS token_savings FROM k GROUP BY 1""")
def skip_totals(spark, d):
    return metrics.skip_report(_screened(spark, d), ["report_id"], "kept", "reason", "confidence", "tokens")[0]


@query(f"""
WITH {_SCREEN}, k AS (SELECT *, CAST(floor(doc_id / 100) AS BIGINT) AS report_id, {_KEPT} AS kept FROM s)
SELECT report_id, CASE WHEN length(trim(t, ' ')) < 20 THEN 'empty_or_too_short' WHEN pat = 0 AND adm >= 3 THEN 'pure_administrative_content_matches_' || adm
 WHEN conf < 0.4 THEN 'below_threshold_0.4' WHEN pat > 0 THEN 'some_biomarker_patterns' END AS reason, count(*) AS n FROM k WHERE NOT kept GROUP BY 1, 2""")
def skip_reasons(spark, d):
    return metrics.skip_report(_screened(spark, d), ["report_id"], "kept", "reason", "confidence", "tokens")[1]


def _screened(spark, d):
    rows = _docs(spark, d).withColumn("s", texts.screen(F.col("text")))
    return rows.select(
        F.floor(F.col("doc_id") / 100).alias("report_id"), texts.accepts(F.col("s"), 15).alias("kept"), texts.screen_reason(F.col("s"), 15).alias("reason"), F.col("s.confidence").alias("confidence"),
        texts.tokens(F.col("text")).alias("tokens"),
    )


_RUNS = "SELECT event_id, user_id, event_type, CAST(floor(value * 100) AS BIGINT) AS before, CAST(floor(value * (50 + event_id % 40)) AS BIGINT) AS after, event_id % 3 AS found, value / 50 AS conf FROM events"


def _runs(spark, d):
    k = F.col("reading_id")
    return readings(spark, d).select(
        k, "person_id", F.col("name").alias("mode"), F.floor(F.col("value") * 100).cast("long").alias("before"), F.floor(F.col("value") * (50 + k % 40)).cast("long").alias("after"),
        (k % 3).alias("found"), (F.col("value") / 50).alias("confidence"), F.col("value").alias("seconds"),
    )


@query(f"""
SELECT event_type AS mode, CAST(sum(before) - sum(after) AS BIGINT) AS saved, round(100.0 * (sum(before) - sum(after)) / sum(before), 6) AS reduction_pct, round(sum(after) / 1000.0 * 0.008, 6) AS cost,
 round(sum(after) / count(*), 6) AS tokens_per_call, round(sum(after) / greatest(sum(found), 1), 6) AS tokens_per_measurement FROM ({_RUNS}) GROUP BY 1""")
def token_summary(spark, d):
    s = metrics.token_summary(_runs(spark, d), "before", "after", "found", ["mode"])
    return s.select("mode", "saved", *[r6(c).alias(c) for c in ("reduction_pct", "cost", "tokens_per_call", "tokens_per_measurement")])


@query("""
SELECT CASE WHEN value / 50 >= 0.9 THEN 'very_high' WHEN value / 50 >= 0.7 THEN 'high' WHEN value / 50 >= 0.5 THEN 'medium' WHEN value / 50 >= 0.3 THEN 'low' ELSE 'very_low' END AS bucket, count(*) AS n
FROM events GROUP BY 1""")
def confidence_distribution(spark, d):
    return _runs(spark, d).groupBy(metrics.confidence_buckets(F.col("confidence")).alias("bucket")).agg(F.count("*").alias("n"))


@query(f"""
WITH r AS ({_RUNS}), a AS (SELECT avg(before) AS b, avg(conf) AS c, avg(found) AS f, min(found) AS fmin, max(found) AS fmax, avg(event_id) AS s FROM r)
SELECT round(b, 6) AS before_avg, round(c, 6) AS confidence_avg, round(f, 6) AS found_avg, CAST(fmin AS BIGINT) AS found_min, CAST(fmax AS BIGINT) AS found_max,
 concat_ws('; ', CASE WHEN b < 15 THEN 'token reduction is below 15 %' END, CASE WHEN c < 0.85 THEN 'accuracy is below 0.85' END, CASE WHEN s > 300 THEN 'runs take more than 300 s' END,
 CASE WHEN f < 5 THEN 'runs find fewer than 5 measurements' END) AS advice FROM a""")
def performance_report(spark, d):
    p = metrics.performance_report(_runs(spark, d), "before", "confidence", "reading_id", "found")
    return p.select(r6("before_avg").alias("before_avg"), r6("confidence_avg").alias("confidence_avg"), r6("found_avg").alias("found_avg"), "found_min", "found_max", F.array_join("advice", "; ").alias("advice"))


@query(f"""
WITH m AS (SELECT event_type AS mode, 100.0 * (sum(before) - sum(after)) / sum(before) AS r, avg(conf) AS c FROM ({_RUNS}) GROUP BY 1)
SELECT arg_max(mode, r) AS best_reduction, arg_max(mode, c) AS best_accuracy FROM m""")
def best_modes(spark, d):
    return metrics.best_modes(metrics.mode_metrics(_runs(spark, d), "mode", "before", "after", "confidence"), "mode")


@query(f"""
WITH l AS (SELECT user_id AS lab, user_id % 7 = 0 AS failed, 100.0 * (sum(before) - sum(after)) / sum(before) AS r, avg(conf) AS c FROM ({_RUNS}) GROUP BY 1)
SELECT count(*) AS labs, count(*) FILTER (NOT failed) AS successful, count(*) FILTER (failed) AS failed, round(avg(r) FILTER (NOT failed), 6) AS mean_reduction, round(avg(c) FILTER (NOT failed), 6) AS mean_accuracy,
 arg_max(lab, r) FILTER (NOT failed) AS best_lab, arg_min(lab, r) FILTER (NOT failed) AS worst_lab FROM l""")
def lab_benchmark(spark, d):
    labs = metrics.mode_metrics(_runs(spark, d).withColumn("lab", F.col("person_id")), "lab", "before", "after", "confidence").withColumn("failed", F.col("lab") % 7 == 0)
    b = metrics.lab_benchmark(labs, "lab", "reduction_pct", "mean_confidence", "failed")
    return b.select("labs", "successful", "failed", r6("mean_reduction").alias("mean_reduction"), r6("mean_accuracy").alias("mean_accuracy"), "best_lab", "worst_lab")


@query(f"""
SELECT user_id AS person_id, count(*) AS extractions, CAST(sum(found) AS BIGINT) AS hits, count(*) FILTER (found = 0) AS misses, round(CAST(sum(found) AS DOUBLE) / count(*), 6) AS hit_rate,
 round(avg(conf), 6) AS mean_confidence FROM ({_RUNS}) GROUP BY 1""")
def cache_statistics(spark, d):
    s = metrics.cache_stats(_runs(spark, d).withColumnRenamed("found", "hit_patterns"), ["person_id"])
    return s.select("person_id", "extractions", "hits", "misses", r6("hit_rate").alias("hit_rate"), r6("mean_confidence").alias("mean_confidence"))


@query(f"""
SELECT event_id AS reading_id, before - coalesce(lag(before) OVER w, 0) AS before_delta, after - coalesce(lag(after) OVER w, 0) AS after_delta FROM ({_RUNS}) WINDOW w AS (PARTITION BY user_id ORDER BY event_id)""")
def counter_deltas(spark, d):
    c = metrics.counter_deltas(_runs(spark, d), "reading_id", "before", "after", keys=["person_id"])
    return c.select("reading_id", "before_delta", "after_delta")


@query("SELECT event_id AS reading_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events) WHERE k <= 20")
def bounded_history(spark, d):
    return metrics.bounded_history(readings(spark, d), ["person_id"], "reading_id", 20).select("reading_id")


@query("SELECT user_id % 10 AS age, count(*) AS n FROM events WHERE user_id % 10 > 0 GROUP BY 1")
def whole_years(spark, d):
    born = F.date_add(F.lit("2000-01-01").cast("date"), (F.col("person_id") % 10 * -365 - 3).cast("int"))
    e = readings(spark, d).where("person_id % 10 > 0").select(values.whole_years(born, F.lit("2000-01-01").cast("date")).cast("long").alias("age"))
    return e.groupBy("age").agg(F.count("*").alias("n"))
