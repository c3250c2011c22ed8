"""Queries of state over time, and of SQL text with the library's own functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sql, texts, values
from ..operators import state
from ..sources import pages
from ..sources.storage import new_path
from ..sources.tables import SHORT_TEXTS, readings, spread, table
from ..streaming import lifecycle
from .catalogue import SQL, query, r6

#: A report may be sent in again after its end; twelve hours are too many.
_AGAIN = lifecycle.Lifecycle({**lifecycle.FOLLOWS, "processed": ["pending"], "error": ["pending"]}, minutes=720)
_SAID = {"signup": "pending", "view": "processing", "purchase": "processed", "error": "error"}


@query(f"""
WITH RECURSIVE c AS (SELECT user_id AS report, ts AS tm, CASE event_type {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in _SAID.items())} END AS status FROM events),
 o AS (SELECT *, row_number() OVER (PARTITION BY report ORDER BY tm, coalesce(status, '')) AS k FROM c),
 n(old, new) AS (VALUES {', '.join(f"('{a}', '{b}')" for a, bs in _AGAIN.follows.items() for b in bs)}),
 f AS (SELECT DISTINCT report, CAST(0 AS BIGINT) AS k, CAST(NULL AS TIMESTAMP) AS tm, CAST(NULL AS VARCHAR) AS status, 'pending' AS was, false AS late, CAST(NULL AS TIMESTAMP) AS since0, false AS ok,
        'pending' AS st, CAST(NULL AS TIMESTAMP) AS since FROM c
   UNION ALL
   SELECT report, k, tm, status, was, late, since0, ok, CASE WHEN ok THEN status ELSE was END, CASE WHEN ok THEN tm WHEN late THEN since0 + INTERVAL 720 MINUTE ELSE since0 END
   FROM (SELECT *, EXISTS (SELECT 1 FROM n WHERE old = was AND new = status) AS ok FROM
     (SELECT o.report, o.k, o.tm, o.status, f.since AS since0, f.st = 'processing' AND o.tm - f.since > INTERVAL 720 MINUTE AS late,
             CASE WHEN f.st = 'processing' AND o.tm - f.since > INTERVAL 720 MINUTE THEN 'pending' ELSE f.st END AS was
      FROM f JOIN o ON o.report = f.report AND o.k = f.k + 1))),
 e AS (SELECT report, arg_max(st, k) AS st, arg_max(since, k) AS since FROM f GROUP BY report),
 r AS (SELECT report, tm, was AS old, status AS new, ok AS accepted, false AS timed_out FROM f WHERE k > 0
   UNION ALL SELECT report, since0 + INTERVAL 720 MINUTE, 'processing', 'pending', true, true FROM f WHERE late
   UNION ALL SELECT report, since + INTERVAL 720 MINUTE, 'processing', 'pending', true, true FROM e WHERE st = 'processing' AND TIMESTAMP '2024-02-01' - since > INTERVAL 720 MINUTE)
SELECT CAST(report AS VARCHAR) AS report, epoch_us(tm) AS "at", old, new, accepted, timed_out FROM r""")
def state_transitions(spark, d):
    status = F.lit(None).cast("string")
    for kind, said in _SAID.items():
        status = F.when(F.col("name") == kind, said).otherwise(status)
    changes = readings(spark, d).select(F.col("person_id").cast("string").alias("report"), F.col("ts").alias("at"), status.alias("status"))
    return lifecycle.state_transitions(changes, _AGAIN, "2024-02-01").withColumn("at", F.unix_micros("at"))


_EXPLAINED = """
e AS (SELECT event_id, event_type || '-' || (user_id % 40) AS name, CAST(floor(value / 20) AS BIGINT) AS value, CASE WHEN value > 40 THEN 'abnormal' ELSE 'normal' END AS status, ts FROM events),
g AS (SELECT name AS key, ts, 'about ' || name || ' ' || event_id AS text FROM e WHERE event_id % 211 = 0),
s AS (SELECT name || ':' || value || ':' || status AS key, ts, 'said ' || event_id AS text FROM e WHERE event_id % 3 = 0),
now AS (SELECT TIMESTAMP '2024-02-05 12:00:00' AS t),
fg AS (SELECT key, arg_max(text, {'a': ts, 'b': text}) AS text FROM g, now WHERE epoch_us(t) - epoch_us(ts) <= 30 * 86400000000 GROUP BY key),
fs AS (SELECT key, arg_max(text, {'a': ts, 'b': text}) AS text FROM s, now WHERE epoch_us(t) - epoch_us(ts) <= 7 * 86400000000 GROUP BY key)"""


@query(f"""
WITH {_EXPLAINED}
SELECT event_id AS reading_id, fg.text AS general, fs.text AS specific, fg.text IS NOT NULL AND fs.text IS NOT NULL AS from_cache
FROM e LEFT JOIN fg ON fg.key = e.name LEFT JOIN fs ON fs.key = e.name || ':' || e.value || ':' || e.status""")
def explanations_expiring(spark, d):
    e = readings(spark, d).select(
        "reading_id", F.concat("name", F.lit("-"), (F.col("person_id") % 40).cast("string")).alias("name"), F.floor(F.col("value") / 20).cast("string").alias("value"),
        F.when(F.col("value") > 40, "abnormal").otherwise("normal").alias("status"), F.col("ts").alias("made"),
    )
    exact = F.concat_ws(":", "name", "value", "status")
    general = e.where("reading_id % 211 = 0").select(F.col("name").alias("key"), F.format_string("about %s %d", "name", "reading_id").alias("text"), "made")
    specific = e.where("reading_id % 3 = 0").select(exact.alias("key"), F.format_string("said %d", "reading_id").alias("text"), "made")
    found = state.cached_explanations(e, general, specific, F.lit("2024-02-05 12:00:00").cast("timestamp_ntz"))
    return found.select("reading_id", "general", "specific", "from_cache")


def _session(spark, d, *names):
    sql.register(spark)
    for n in names:
        table(spark, d, n).createOrReplaceTempView(f"lab_{n}")
    return spark


@query("""
WITH t AS (SELECT l_orderkey * 10 + l_linenumber AS row_id, l_partkey % 4 AS kind, CAST(l_quantity AS INTEGER) AS a, CAST(l_suppkey + 60 AS INTEGER) AS b, CAST(l_extendedprice AS DOUBLE) / 1000 AS v FROM lineitem),
 r AS (SELECT row_id, v, CAST(CASE kind WHEN 0 THEN a WHEN 2 THEN a END AS DOUBLE) AS low, CAST(CASE kind WHEN 0 THEN b WHEN 1 THEN b WHEN 3 THEN b END AS DOUBLE) AS high FROM t)
SELECT row_id, low, high, CASE WHEN row_id % 5 = 0 THEN true WHEN row_id % 5 = 1 THEN false ELSE coalesce(v < low, false) OR coalesce(v > high, false) END AS is_abnormal FROM r""")
def sql_ranges_and_flags(spark, d):
    return _session(spark, d, "lineitem").sql("""
WITH t AS (SELECT l_orderkey * 10 + l_linenumber AS row_id, l_extendedprice / 1000 AS v, CAST(CAST(l_quantity AS int) AS string) AS a, CAST(l_suppkey + 60 AS string) AS b, l_partkey % 4 AS kind FROM lab_lineitem),
 r AS (SELECT row_id, v, lab_range(CASE kind WHEN 0 THEN a || ' - ' || b WHEN 1 THEN '< ' || b WHEN 2 THEN '≥' || a ELSE 'up to ' || b END) AS r FROM t)
SELECT row_id, r.low, r.high, lab_flag(CASE row_id % 5 WHEN 0 THEN ' high ' WHEN 1 THEN 'normal' WHEN 2 THEN '' END, v, r.low, r.high) AS is_abnormal FROM r""")


@query(SQL["doc_score"])
def sql_doc_score(spark, d):
    _session(spark, d, "documents")
    spread(spark.table("lab_documents").select("doc_id", F.regexp_replace("text", r"[^\x00-\x7F]", "?").alias("text"))).createOrReplaceTempView("lab_texts")
    return spark.sql("SELECT doc_id, round(lab_confidence(text), 6) AS confidence FROM lab_texts")


@query()
def sql_doc_chunks(spark, d):
    """What ``doc_chunks`` gives, by the table function."""
    _session(spark, d, "documents")
    spread(spark.table("lab_documents").select("doc_id", "text")).createOrReplaceTempView("lab_texts")
    found = spark.sql("SELECT doc_id, c.ord, c.chunk, CAST(c.estimated_tokens AS bigint) AS estimated_tokens FROM lab_texts, LATERAL chunk_text(text, 300, 40) AS c")
    return found.selectExpr("doc_id", "ord", "estimated_tokens", "round(lab_confidence(chunk), 6) AS confidence", "sha2(chunk, 256) AS text_sha256")


@query("""
SELECT event_id AS reading_id, upper(event_type[1]) || substr(event_type, 2) AS name, value, 'mg/dl' AS unit, CAST(1 AS DOUBLE) AS low, CAST(50 AS DOUBLE) AS high
FROM events WHERE event_type NOT IN ('error', 'view')""")
def sql_loose_measurements(spark, d):
    _session(spark, d, "events")
    said = spark.table("lab_events").select("event_id", F.format_string("%s: %.2f mg/dl (1-50)", F.initcap(F.when(F.col("event_type") == "error", "date").otherwise(F.col("event_type"))), "value").alias("text"))
    spread(said, SHORT_TEXTS).createOrReplaceTempView("lab_said")
    return spark.sql("""
SELECT event_id AS reading_id, m.name, m.value, m.unit, lab_range(m.reference_range).low AS low, lab_range(m.reference_range).high AS high FROM lab_said, LATERAL loose_measurements(text) AS m""")



@query("SELECT doc_id, sha256(replace(replace(coalesce(text, ''), chr(12), ' '), chr(13), ' ')) AS text_sha256, length(coalesce(text, '')) AS n_chars FROM documents")
def pages_from_files(spark, d):
    """All documents as pages of text files, read by the page source."""
    pages.register(spark)
    folder = new_path(spark, "pages")
    said = F.concat(F.col("doc_id").cast("string"), F.lit("|"), F.translate(F.coalesce("text", F.lit("")), "\x0c\r", "  "), F.lit("\x0c"))
    spread(table(spark, d, "documents").select(said.alias("value"))).write.text(folder)
    found = spark.read.format("pages").option("pattern", "part-*").schema("text string").load(folder)
    whole = F.regexp_replace("text", r"^\n", "")
    text = F.regexp_replace(whole, r"^[0-9]+\|", "")
    return found.select(F.substring_index(whole, "|", 1).cast("long").alias("doc_id"), F.sha2(text, 256).alias("text_sha256"), F.length(text).cast("long").alias("n_chars"))


@query("""
WITH RECURSIVE x AS (SELECT lower(event_type) || '_' || (user_id % 7) AS name, value, round((event_id * 37 % 101) / 100.0, 2) AS confidence, event_id AS ord FROM events),
 p AS (SELECT name, count(*) AS frequency FROM x WHERE ends_with(name, '_0') OR ends_with(name, '_3') GROUP BY 1),
 f AS (SELECT x.name, p.name IS NOT NULL AS own, min(CASE WHEN confidence >= 0.7 THEN ord END) AS first, arg_min(confidence, CASE WHEN confidence >= 0.7 THEN ord END) AS c0, arg_min(value, CASE WHEN confidence >= 0.7 THEN ord END) AS v0 FROM x LEFT JOIN p USING (name) GROUP BY 1, 2),
 o AS (SELECT x.name, confidence, row_number() OVER (PARTITION BY x.name ORDER BY ord) AS k FROM x JOIN f ON f.name = x.name AND (own OR ord > first)),
 m AS (SELECT name, CAST(0 AS BIGINT) AS k, CAST(CASE WHEN own THEN 0.8 ELSE c0 END AS DOUBLE) AS s FROM f WHERE own OR first IS NOT NULL
   UNION ALL SELECT m.name, o.k, m.s * 0.9 + o.confidence * 0.1 FROM m JOIN o ON o.name = m.name AND o.k = m.k + 1)
SELECT f.name, CAST(coalesce(p.frequency, 1) + max(m.k) AS BIGINT) AS frequency, round(arg_max(m.s, m.k), 6) AS success, CASE WHEN own THEN 5.0 WHEN v0 > 0 THEN v0 * 0.5 END AS low,
 round(CASE WHEN own THEN 0.6 ELSE c0 * 0.9 END, 6) AS threshold
FROM f JOIN m ON m.name = f.name LEFT JOIN p ON p.name = f.name GROUP BY f.name, p.frequency, own, v0, c0""")
def patterns_learned(spark, d):
    e = readings(spark, d)
    name = F.concat(F.initcap("name"), F.lit(" "), (F.col("person_id") % 7).cast("string"))
    confidence = F.round((F.col("reading_id") * 37 % 101) / 100, 2)
    x = e.select(name.alias("name"), F.lit("mg/dL").alias("unit"), "value", confidence.alias("confidence"), F.col("reading_id").alias("ord"))
    known = x.groupBy(F.lower(F.replace("name", F.lit(" "), F.lit("_"))).alias("name")).agg(F.count("*").alias("frequency")).where("name rlike '_[03]$'")
    known = known.select("name", F.lit("mg/dL").alias("unit"), "frequency", F.lit(0.8).alias("success"), F.lit(5.0).alias("low"), F.lit(50.0).alias("high"), F.lit(0.6).alias("threshold"))
    found = state.learn_patterns(known, x, 100_000)
    return found.select("name", F.col("frequency").cast("long").alias("frequency"), r6("success").alias("success"), "low", r6("threshold").alias("threshold"))


@query(f"""
WITH s AS (SELECT conv_id, turn, trim(repeat(replace(text, '•', '-') || '. ', 14), ' ') AS s FROM conversations),
 l AS (SELECT *, CASE WHEN regexp_matches(lower(right(s, 200)), '{"|".join(texts.IMPORTANT_ENDINGS)}') THEN least(length(s), 1000) ELSE 800 END AS most FROM s),
 c AS (SELECT *, substr(s, 1, most) AS cut, length(regexp_extract(substr(s, 1, most), '^([\\s\\S]*[.!?])', 1)) AS last FROM l)
SELECT conv_id, turn, length(s) AS said, trim(CASE WHEN length(s) <= most THEN s WHEN last - 1 > most * 0.7 THEN substr(cut, 1, last) ELSE substr(cut, 1, most - 3) || '...' END, ' ') AS reply FROM c""")
def replies_cut(spark, d):
    """Long replies, which begin with talk about themselves and are cut where a sentence ends."""
    own = F.repeat(F.concat(F.replace("text", F.lit("•"), F.lit("-")), F.lit(". ")), F.lit(14))
    c = table(spark, d, "conversations").withColumn("s", F.trim(own))
    return c.select("conv_id", "turn", F.length("s").cast("long").alias("said"), texts.shape_reply(F.concat(F.lit("Let me help you: "), "s")).alias("reply"))


@query("SELECT o_orderkey AS report_id, CAST(floor(date_diff('day', CAST(o_orderdate AS DATE), DATE '2003-07-14') / 365) AS BIGINT) AS years FROM orders")
def years_since_reports(spark, d):
    born = F.col("o_orderdate").cast("date")
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("report_id"), values.whole_years(born, F.lit("2003-07-14").cast("date")).cast("long").alias("years"))
