"""Queries of the dictionary, of ranges and names as they are shown, of extraction and page texts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import texts, values
from ..operators import dictionary, documents, matching, relational, state
from ..sources.tables import SHORT_TEXTS, people, readings, spread, table
from .catalogue import _ASCII, _BALANCED, _count, _docs, _replaced, day, query, r6


def _sql(value) -> str:
    return "NULL" if value is None else repr(value) if isinstance(value, (int, float)) else "'" + value.replace("'", "''") + "'"


def _rows(rows) -> str:
    return ", ".join("(" + ", ".join(map(_sql, r)) + ")" for r in rows)


# names, units and ranges of the dictionary -------------------------------------------------------------------------------

_SAID = ["Glucose", "glucose ", " fbs", "GLU", "hba1c", "HbA1c", "A1C", "Cholesterol", "HDL Cholesterol", "ldl-c", "tg", "HGB", "Hemoglobin", "rbc", "Leukocytes", "PLT",
         "thyrotropin", "T3 total", "thyroxine", "25(oh)d", "b12", "SGPT", "sgot", "creatinine", "Creatinine", "urea", "na", "K", "Widget", ""]
_UNITS = ["mg/dL", "MG/DL", "mmol/L", "MMOL/l", "%", "mmol/mol", "g/L", "K/uL", "k/ul", "nmol/L", "µmol/L", "umol/l", "IU/L", "iu/l", "furlong", " mg/dl "]
_GENDERS = ["male", "Female", None]
_ROW = "l_orderkey * 10 + l_linenumber AS row_id"
_DICTIONARY = f"""
said(k, name) AS (VALUES {_rows(enumerate(_SAID))}), units(k, unit) AS (VALUES {_rows(enumerate(_UNITS))}),
spelling(s, standard) AS (VALUES {_rows(sorted({(s.upper(), n) for n, _, _, many in dictionary.NAMES for s in many}))}),
entry(standard, unit, category) AS (VALUES {_rows((n, u, c) for n, u, c, _ in dictionary.NAMES)}),
t AS (SELECT {_ROW}, row_number() OVER () AS u, name, unit, l_quantity AS v, l_orderkey % 3 AS g FROM lineitem JOIN said ON said.k = l_partkey % {len(_SAID)} JOIN units ON units.k = (l_suppkey + l_linenumber) % {len(_UNITS)}),
named AS (SELECT t.*, coalesce(a.standard, s.standard, trim(t.name)) AS standard_name FROM t LEFT JOIN entry a ON a.standard = trim(t.name) LEFT JOIN spelling s ON s.s = upper(trim(t.name)))"""


def _said(spark, d):
    pick = lambda items, at: F.element_at(F.array(*[F.lit(x) for x in items]), (at + 1).cast("int"))
    return table(spark, d, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_id"), pick(_SAID, F.col("l_partkey") % len(_SAID)).alias("name"),
        pick(_UNITS, (F.col("l_suppkey") + F.col("l_linenumber")) % len(_UNITS)).alias("unit"), F.col("l_quantity").alias("v"),
        pick(_GENDERS, F.col("l_orderkey") % 3).alias("gender"), F.when(F.col("l_orderkey") % 2 == 0, "Fasting").alias("context"),
    )


@query(f"WITH {_DICTIONARY} SELECT row_id, standard_name, e.unit AS standard_unit, coalesce(category, 'Other') AS dictionary_category FROM named LEFT JOIN entry e ON e.standard = standard_name")
def dictionary_names(spark, d):
    return dictionary.standard_names(_said(spark, d)).select("row_id", "standard_name", "standard_unit", "dictionary_category")


@query(f"""
WITH {_DICTIONARY}, factor(standard, unit, f) AS (VALUES {_rows((n, u, f) for n, by in dictionary.FACTORS for u, f in by.items())}),
ci AS (SELECT standard, lower(unit) AS u, min(f) AS f FROM factor GROUP BY ALL),
r AS (SELECT row_id, v, n.unit, e.unit AS own, CASE WHEN lower(trim(n.unit)) = lower(e.unit) THEN 1.0 ELSE ci.f END AS f
      FROM named n LEFT JOIN entry e ON e.standard = standard_name LEFT JOIN ci ON ci.standard = standard_name AND ci.u = lower(n.unit))
SELECT row_id, round(v * coalesce(CAST(f AS DOUBLE), 1), 6) AS converted_value, CASE WHEN f IS NULL THEN unit ELSE own END AS converted_unit FROM r""")
def dictionary_units(spark, d):
    return dictionary.standard_values(_said(spark, d), value="v").select("row_id", r6("converted_value").alias("converted_value"), "converted_unit")


@query(f"""
WITH {_DICTIONARY}, ranges(standard, place, kind, low, high, context) AS (VALUES {_rows((n, i, k, low, high, c) for n, many in dictionary.RANGES for i, (k, low, high, c) in enumerate(many))}),
r AS (SELECT u, kind, low, high, row_number() OVER (PARTITION BY u ORDER BY CASE
        WHEN kind = CASE g WHEN 0 THEN 'male' WHEN 1 THEN 'female' END THEN 0 WHEN context = CASE WHEN ((row_id - row_id % 10) // 10) % 2 = 0 THEN 'fasting' END THEN 1
        WHEN kind = 'adult' THEN 2 WHEN kind = 'normal' THEN 3 WHEN low IS NOT NULL AND high IS NOT NULL THEN 4 END NULLS LAST, place) AS k,
      kind IN ('adult', 'normal') OR (low IS NOT NULL AND high IS NOT NULL) OR kind = CASE g WHEN 0 THEN 'male' WHEN 1 THEN 'female' END OR (context = 'fasting' AND ((row_id - row_id % 10) // 10) % 2 = 0) AS fits
      FROM named JOIN ranges ON ranges.standard = standard_name)
SELECT n.row_id, kind AS reference_kind, CAST(low AS DOUBLE) AS reference_low, CAST(high AS DOUBLE) AS reference_high
FROM named n LEFT JOIN (SELECT * FROM r WHERE k = 1 AND fits) b ON b.u = n.u""")
def dictionary_ranges(spark, d):
    return dictionary.reference_ranges(_said(spark, d), gender="gender", context="context").select("row_id", "reference_kind", "reference_low", "reference_high")


# ranges and names as they are shown --------------------------------------------------------------------------------------

_RANGE_KINDS = 9
_RANGE_TEXT = f"""
t AS (SELECT {_ROW}, l_partkey % {_RANGE_KINDS} AS kind, CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) AS a, CAST(l_suppkey + 1060 AS VARCHAR) AS b FROM lineitem)"""


def _range_texts(spark, d):
    t = table(spark, d, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_id"), (F.col("l_partkey") % _RANGE_KINDS).cast("int").alias("kind"),
        F.col("l_quantity").cast("int").cast("string").alias("a"), (F.col("l_suppkey") + 1060).cast("string").alias("b"),
    )
    said = [F.concat_ws(x, "a", "b") for x in ("-", " to ", " – ")] + [F.concat(F.lit(x), "b") for x in ("Less than ", "<= ", "Up to ", "> ", "greater than ")] + [F.col("b")]
    return t.withColumn("text", F.element_at(F.array(*said), F.col("kind") + 1))


@query(f"""
WITH {_RANGE_TEXT} SELECT row_id, CASE WHEN kind <= 2 THEN CAST(a AS DOUBLE) WHEN kind IN (6, 7) THEN CAST(b AS DOUBLE) END AS low,
 CASE WHEN kind <= 5 THEN CAST(b AS DOUBLE) END AS high FROM t""")
def range_display(spark, d):
    r = values.display_range(F.col("text"))
    return _range_texts(spark, d).select("row_id", r["low"].alias("low"), r["high"].alias("high"))


@query(f"""
WITH {_RANGE_TEXT} SELECT row_id, CASE WHEN kind = 0 THEN CAST(a AS DOUBLE) WHEN kind = 6 THEN CAST(b AS DOUBLE) END AS low,
 CASE WHEN kind IN (0, 4) THEN CAST(b AS DOUBLE) END AS high FROM t""")
def range_strict(spark, d):
    r = values.strict_range(F.col("text"))
    return _range_texts(spark, d).select("row_id", r["low"].alias("low"), r["high"].alias("high"))


@query("""
WITH t AS (SELECT event_id AS reading_id, event_id % 4 AS k, CAST(user_id AS DOUBLE) AS a, CAST(user_id + 5 AS DOUBLE) AS b FROM events)
SELECT reading_id, CASE WHEN k IN (0, 1) THEN a END AS low, CASE WHEN k IN (0, 2) THEN b END AS high,
 CASE k WHEN 0 THEN a || '-' || b || ' mg/dL' WHEN 1 THEN '> ' || a || ' mg/dL' WHEN 2 THEN '< ' || b || ' mg/dL' ELSE '{"high":"x","low":' || user_id || ',"unit":"mg/dL"}' END AS range_text
FROM t JOIN events ON event_id = reading_id""")
def range_objects(spark, d):
    k, a, b = F.col("reading_id") % 4, F.col("person_id").cast("string"), (F.col("person_id") + 5).cast("string")
    said = F.concat(
        F.lit('{"unit": "mg/dL"'), F.when(k != 2, F.concat(F.lit(', "low": '), a)).otherwise(""), F.when(k.isin(0, 2), F.concat(F.lit(', "high": "'), b, F.lit('"'))).otherwise(""),
        F.when(k == 3, ', "high": "x"').otherwise(""), F.lit("}"),
    )
    r = spread(readings(spark, d).select("reading_id", "person_id"), SHORT_TEXTS).select("reading_id", values.range_of_object(F.parse_json(said)).alias("r"))
    return r.select("reading_id", F.col("r.low").alias("low"), F.col("r.high").alias("high"), F.col("r.text").alias("range_text"))


@query("""
SELECT event_id AS reading_id, CASE event_id % 3 WHEN 0 THEN 'said' WHEN 1 THEN CAST(user_id AS VARCHAR) || '-' || CAST(user_id AS VARCHAR) || '.5' END AS range_text FROM events""")
def range_shown(spark, d):
    k, p = F.col("reading_id") % 3, F.col("person_id").cast("double")
    text = values.range_text(F.when(k == 0, "said").otherwise(""), p, F.when(k == 1, p + 0.5))
    return readings(spark, d).select("reading_id", text.alias("range_text"))


@query("""
SELECT page_id, CASE WHEN page_id % 7 = 0 THEN 'Unknown' ELSE regexp_replace(regexp_extract(split_part(url, '?', 1), '([^/]*)$', 1) || '.v1.pdf', '\\.[^.]+$', '') END AS file_name,
 CASE page_id % 2 WHEN 0 THEN 'Vitamin D' ELSE 'HDL' END AS name FROM pages""")
def shown_names(spark, d):
    path = F.concat(F.split_part("url", F.lit("?"), F.lit(1)), F.lit(".v1.pdf"))
    name = F.when(F.col("page_id") % 2 == 0, "25-Hydroxyvitamin D").otherwise("HDL")
    return table(spark, d, "pages").select("page_id", values.base_name(F.when(F.col("page_id") % 7 != 0, path)).alias("file_name"), values.canonical_name(name).alias("name"))


@query("""
SELECT o_orderkey AS report_id, strftime(CASE WHEN o_orderkey % 4 = 0 THEN o_orderdate WHEN o_orderkey % 4 = 1 THEN o_orderdate + INTERVAL 1 DAY ELSE o_orderdate + INTERVAL 2 DAY END, '%Y-%m-%d') AS day FROM orders""")
def effective_dates(spark, d):
    k, at = F.col("o_orderkey") % 4, F.col("o_orderdate")
    plus = lambda n: at + F.make_dt_interval(days=F.lit(n))
    known = values.effective_date(F.when(k == 0, at), F.when(k == 1, plus(1)), plus(2))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("report_id"), day(known).alias("day"))


@query("""
SELECT event_id AS reading_id, '2024-03-0' || (1 + event_id % 5) AS dob, CASE event_id % 3 WHEN 0 THEN 'male' WHEN 1 THEN 'female' ELSE 'x' END AS gender, 'user ' || user_id AS name,
 CASE WHEN event_id % 2 = 0 THEN CAST(user_id AS VARCHAR) END AS id FROM events""")
def metadata_standard(spark, d):
    k, n = F.col("reading_id"), (1 + F.col("reading_id") % 5).cast("string")
    said = readings(spark, d).select(
        "reading_id", F.format_string(" User %d ", "person_id").alias("name"), F.when(k % 2 == 0, F.format_string(" %d ", "person_id")).otherwise("  ").alias("id"),
        F.element_at(F.array(F.concat(F.lit("2024-03-0"), n), F.concat(F.lit("03/0"), n, F.lit("/2024")), F.concat(F.lit("2024/03/0"), n)), (k % 3 + 1).cast("int")).alias("dob"),
        F.element_at(F.array(F.lit(" M"), F.lit("Female"), F.lit("X ")), (k % 3 + 1).cast("int")).alias("gender"),
    )
    return matching.standardized(said).select("reading_id", F.date_format("dob", "yyyy-MM-dd").alias("dob"), "gender", "name", "id")


@query("""
SELECT c_custkey AS person_id, CASE c_custkey % 3 WHEN 0 THEN 'Unknown Profile' WHEN 1 THEN 'Default Profile' ELSE c_name END AS name,
 CASE WHEN c_custkey % 2 = 0 THEN '1990-01-02' END AS born, c_nationkey AS tenant_id FROM customer""")
def people_new(spark, d):
    k = F.col("person_id") % 3
    said = people(spark, d).select(
        F.when(k == 1, "  ").when(k == 2, F.col("name")).alias("patient_name"), F.when(F.col("person_id") % 2 == 0, "01/02/1990").otherwise("soon").alias("patient_dob"),
        F.lit("f").alias("patient_gender"), F.col("person_id").cast("string").alias("patient_id"), "tenant_id",
    )
    made = relational.people_from_metadata(said)
    return made.select(F.col("patient_id").cast("long").alias("person_id"), "name", F.date_format("date_of_birth", "yyyy-MM-dd").alias("born"), "tenant_id")


@query("SELECT c_custkey AS person_id, CASE c_custkey % 3 WHEN 0 THEN 'name' WHEN 1 THEN 'name,segment' ELSE '' END AS fields FROM customer")
def metadata_filled(spark, d):
    k = F.col("person_id") % 3
    fields = F.create_map(F.lit("name"), F.when(k < 2, F.col("name")), F.lit("segment"), F.when(k == 1, F.col("segment")).otherwise(""))
    return people(spark, d).select("person_id", F.array_join(F.array_sort(F.map_keys(values.filled_fields(fields))), ",").alias("fields"))


@query("SELECT event_id AS reading_id, CASE WHEN event_id % 6 = 5 THEN NULL ELSE user_id END AS k, CASE WHEN event_id % 6 = 5 THEN 0 ELSE 1 END AS found FROM events")
def json_mended(spark, d):
    p = F.col("person_id").cast("string")
    kinds = [
        F.concat(F.lit('```json\n{"biomarkers": [{"name": "A", "value": '), p, F.lit("}]}\n```")), F.concat(F.lit("{biomarkers: [{name: 'A', value: "), p, F.lit(",},],}")),
        F.concat(F.lit('Sure! {"biomarkers": [{"name": "A", "value": '), p, F.lit("}")), F.concat(F.lit('{"biomarkers": [{"name": "A" /* here */ , "value": '), p, F.lit("}]} done")),
        F.concat(F.lit('{"biomarkers": [{"name": "A", "value": '), p, F.lit('}, {"name": "B", "val')), F.lit("nothing was found"),
    ]
    said = F.element_at(F.array(*kinds), (F.col("reading_id") % 6 + 1).cast("int"))
    r = readings(spark, d).select("reading_id", F.parse_json(values.repaired_json(said)).alias("v"))
    first = F.try_variant_get("v", "$.biomarkers[0].value", "long")
    return r.select("reading_id", first.alias("k"), F.when(first.isNull(), 0).otherwise(1).cast("long").alias("found"))


@query("""
WITH w(k, word, v) AS (VALUES (0, 'very high', 0.95), (1, 'HIGH', 0.85), (2, 'about medium', 0.65), (3, '0.42', 0.42), (4, '7', 1.0), (5, '?', 0.7))
SELECT event_id AS reading_id, CAST(v AS DOUBLE) AS confidence, CASE event_id % 3 WHEN 0 THEN true WHEN 1 THEN false ELSE value > 30 END AS is_abnormal,
 round(CAST(CASE WHEN event_id % 2 = 0 THEN CASE WHEN event_id % 4 = 0 THEN 0.95 ELSE 0.9 END ELSE 0.8 END AS DOUBLE), 6) AS by_fields, CAST(floor(value) AS DOUBLE) AS number
FROM events JOIN w ON k = event_id % 6""")
def flags_and_confidence(spark, d):
    k = F.col("reading_id")
    word = F.element_at(F.array(*[F.lit(x) for x in ("very high", "HIGH", "about medium", "0.42", "7", "?")]), (k % 6 + 1).cast("int"))
    flag = F.when(k % 3 == 0, " high ").when(k % 3 == 1, "N")
    number = values.clean_number(F.concat(F.lit("~ "), F.floor("value").cast("string"), F.lit(" mg")))
    return readings(spark, d).select(
        "reading_id", values.confidence(word).alias("confidence"), values.abnormal_flag(flag, F.col("value"), F.lit(None).cast("double"), F.lit(30.0)).alias("is_abnormal"),
        r6(values.llm_confidence(k % 2 == 0, k % 4 == 0, F.lit(False))).alias("by_fields"), number.alias("number"),
    )


# extraction --------------------------------------------------------------------------------------------------------------

_SHAPED = ["Glucose: %s mg/dL", "Glucose (fasting): %s mg/dL", "%s mg/dL Glucose", "Glucose    %s    mg/dL", "Glucose (x)  %s  mg/dL  13.0 to 17.0", "Glucose: %s mg/dL (70-99)",
           "Hemoglobin (Hb) %s g/dL", "Hematocrit: %s % [36-50]", "Creatinine %s mg/dL ref value: 0.5 - 1.5", "Sugar %s mg/dL"]


@query("""
WITH t AS (SELECT event_id AS reading_id, event_id % 10 AS k, value FROM events),
 f AS (SELECT reading_id, value, CASE WHEN k <= 5 THEN 'Glucose' WHEN k = 6 THEN 'Hemoglobin' WHEN k = 7 THEN 'Hematocrit' ELSE 'Creatinine' END AS name,
  CAST(CASE WHEN k <= 5 THEN 70 WHEN k = 6 THEN 12 WHEN k = 7 THEN 36 ELSE 0.5 END AS DOUBLE) AS low, CAST(CASE WHEN k <= 5 THEN 99 WHEN k = 6 THEN 17 WHEN k = 7 THEN 50 ELSE 1.5 END AS DOUBLE) AS high FROM t WHERE k <= 8)
SELECT *, value < low OR value > high AS is_abnormal FROM f""")
def extract_shapes(spark, d):
    value = F.format_string("%.2f", "value")
    kinds = [F.concat(F.lit(a), value, F.lit(b)) for a, b in (s.split("%s") for s in _SHAPED)]
    said = spread(readings(spark, d).select("reading_id", "value"), SHORT_TEXTS).select("reading_id", F.concat(F.lit("Seen today.\n"), F.element_at(F.array(*kinds), (F.col("reading_id") % 10 + 1).cast("int")), F.lit("\nnext line")).alias("text"))
    return documents.known_measurements(said, "reading_id").select("reading_id", "name", "value", "low", "high", "is_abnormal")


@query("""
WITH t AS (SELECT event_id AS reading_id, value, unnest(CASE event_id % 3 WHEN 0 THEN ['Glucose', 'HbA1c'] WHEN 1 THEN ['Glucose'] ELSE [] END) AS name FROM events)
SELECT reading_id, name, value + CASE name WHEN 'HbA1c' THEN 1 ELSE 0 END AS value, CAST(0.7 AS DOUBLE) AS confidence FROM t""")
def extract_refused(spark, d):
    k, v, w = F.col("reading_id") % 3, F.format_string("%.2f", "value"), F.format_string("%.2f", F.col("value") + 1)
    text = F.when(k == 0, F.concat(F.lit("Glucose: "), v, F.lit(" mg/dL (70-99)\nHbA1c: "), w, F.lit(" pct.\nCholesterol: 5 mg/dL"))).when(
        k == 1, F.concat(F.lit("Glucose: "), v, F.lit(" mg/dL (70-99)) glucose: 7 mg/dL (1-2)"))).otherwise(F.lit("Patient name: 12 x (1) Page 3 of them (2) CALCIUM SERUMX: 3 mg"))
    found = documents.loose_measurements(spread(readings(spark, d).select("reading_id", "value"), SHORT_TEXTS).select("reading_id", text.alias("text")), "reading_id")
    return found.select("reading_id", "name", r6("value").alias("value"), "confidence")


@query("""
SELECT event_id AS report_id, user_id AS profile_id, CASE WHEN event_id % 2 = 0 THEN event_type ELSE 'Unknown' END AS name, CASE WHEN event_id % 3 = 0 THEN value ELSE 0 END AS value, '' AS unit, 'Other' AS category,
 coalesce(CASE WHEN event_id % 4 = 0 THEN true END, false) AS is_abnormal FROM events""")
def measurements_inserted(spark, d):
    k = F.col("reading_id")
    e = readings(spark, d).select(k, "person_id", "ts", F.when(k % 2 == 0, F.col("name")).alias("name"), F.when(k % 3 == 0, F.col("value")).alias("value"), F.when(k % 4 == 0, True).alias("is_abnormal"))
    made = documents.with_defaults(e, k, F.col("person_id"), F.col("ts"))
    return made.select("report_id", "profile_id", "name", "value", "unit", "category", "is_abnormal")


@query("""
WITH g AS (SELECT user_id, y, lag(y) OVER (PARTITION BY user_id ORDER BY y) AS b, count(*) OVER (PARTITION BY user_id) AS n FROM (SELECT user_id, value * 20 AS y FROM events)),
 f AS (SELECT *, y - b AS gap FROM g WHERE n > 10 AND y - b > 20),
 t AS (SELECT user_id, arg_min(b, {'g': -gap, 'b': b}) AS tb, arg_min(y, {'g': -gap, 'b': b}) AS ta, max(gap) AS largest, arg_min(b, {'g': -gap, 'b': b}) FILTER (b > 700) AS fb, arg_min(y, {'g': -gap, 'b': b}) FILTER (b > 700) AS fa FROM f GROUP BY 1)
SELECT user_id AS person_id, round(CASE WHEN tb < 300 THEN tb + 5 END, 6) AS header_end, round(CASE WHEN tb < 300 THEN ta - 5 END, 6) AS content_start, round(fb + 5, 6) AS content_end, round(fa - 5, 6) AS footer_start
FROM t WHERE largest > 30""")
def zone_cuts(spark, d):
    words = readings(spark, d).select("person_id", (F.col("value") * 20).alias("y"), F.lit(1000.0).alias("height"))
    c = state.zone_cuts(words, ["person_id"], "y", "height")
    return c.select("person_id", *[r6(x).alias(x) for x in ("header_end", "content_start", "content_end", "footer_start")])


# pages and their texts ---------------------------------------------------------------------------------------------------

_INDICATED = " OR ".join(f"regexp_matches(t, '(?i){p}')" for p in texts.INDICATORS)
_TAIL = "CASE doc_id % 5 WHEN 0 THEN chr(10) || chr(10) || 'Reference range 70-99 mg/dL' WHEN 1 THEN ' Glucose 95 mg/dL' ELSE '' END"


def _paged(spark, d):
    """Documents as pages, some of them with a sign of measurements."""
    k = F.col("doc_id") % 5
    tail = F.when(k == 0, "\n\nReference range 70-99 mg/dL").when(k == 1, " Glucose 95 mg/dL").otherwise("")
    return _docs(spark, d).select("doc_id", F.floor(F.col("doc_id") / 25).alias("report_id"), F.concat("text", tail).alias("text"))


@query(f"WITH t AS (SELECT doc_id, {_ASCII} || {_TAIL} AS t FROM documents) SELECT doc_id, {_INDICATED} AS indicated FROM t")
def page_signs(spark, d):
    return _paged(spark, d).select("doc_id", texts.indicates_measurements(F.col("text")).alias("indicated"))


@query(f"""
WITH t AS (SELECT doc_id, CAST(floor(doc_id / 25) AS BIGINT) AS report_id, {_ASCII} || {_TAIL} AS t FROM documents),
 s AS (SELECT *, doc_id % 9 = 0 OR {_INDICATED} AS sign, 10 * {_count('t', r'\b(glucose)\b')} + len(regexp_extract_all(t, '{texts.RELEVANT_UNITS}'))
  + CASE WHEN len(string_split(trim(t, ' '), chr(10))) > 3 AND len(list_filter(string_split(trim(t, ' '), chr(10)), lambda x: regexp_matches(x, '{texts.TABLE_LINE}'))) > 2 THEN 5 ELSE 0 END >= 1 AS relevant FROM t),
 w AS (SELECT *, bool_or(sign) OVER (PARTITION BY report_id) AS any_sign FROM s)
SELECT report_id, doc_id FROM w WHERE CASE WHEN any_sign THEN sign ELSE relevant END""")
def page_filter(spark, d):
    pages = _paged(spark, d).withColumn("tables", F.when(F.col("doc_id") % 9 == 0, 1))
    return documents.relevant_pages(pages, "report_id", ["glucose"], tables="tables").select("report_id", "doc_id")


_CLEAN = f"regexp_replace(({_ASCII} || {_TAIL} || CASE doc_id % 3 WHEN 0 THEN ' Page 3 of 4 ____________ www.example.org ' ELSE '' END), '\\n\\s*\\n\\s*\\n+', chr(10) || chr(10), 'g')"
_CLEAN = _replaced(_CLEAN, texts.FOOTERS)
for _c in "_=":
    _CLEAN = f"regexp_replace({_CLEAN}, '{_c}{{11,}}', '{_c * 3}', 'g')"
_CLEAN = f"regexp_replace(regexp_replace({_CLEAN}, '-{{11,}}', '---', 'g'), '\\n\\s*\\n\\s*\\n+', chr(10) || chr(10), 'g')"
_CLEAN = f"regexp_replace(regexp_replace({_CLEAN}, '[ \\t]+', ' ', 'g'), '^\\s+|\\s+$', '', 'g')"


@query(f"SELECT doc_id, sha256({_CLEAN}) AS text_sha256 FROM documents")
def cleanup_conservative(spark, d):
    more = F.when(F.col("doc_id") % 3 == 0, " Page 3 of 4 ____________ www.example.org ").otherwise("")
    return _paged(spark, d).select("doc_id", F.sha2(texts.conservative_cleanup(F.concat("text", more)), 256).alias("text_sha256"))


_LINES = f"list_filter(string_split({_replaced('(t)', texts.BALANCED_REMOVALS)}, chr(10)), lambda x: trim(x, ' ') <> '' AND NOT (regexp_matches(lower(trim(x, ' ')), '{'|'.join(f'(?:{p})' for p in texts.ADMIN_LINES)}') AND NOT regexp_matches(lower(trim(x, ' ')), '{'|'.join(f'(?:{p})' for p in texts.KEPT_LINES)}')))"


@query(f"""
WITH t AS (SELECT doc_id, {_ASCII} || CASE doc_id % 2 WHEN 0 THEN chr(10) || 'Printed on 5 May' || chr(10) || 'Report date: today' || chr(10) || 'Report date: 5 mg' || chr(10) || 'end' ELSE '' END AS t FROM documents),
 c AS (SELECT doc_id, t, regexp_replace(regexp_replace(array_to_string({_LINES}, chr(10)), '[ \\t\\r\\f\\v]+', ' ', 'g'), '^\\s+|\\s+$', '', 'g') AS c FROM t)
SELECT doc_id, sha256(CASE WHEN ceil(length(c) / 4.0) < ceil(length(t) / 4.0) * 0.7 OR ceil(length(c) / 4.0) >= ceil(length(t) / 4.0) THEN t ELSE c END) AS text_sha256 FROM c""")
def compress_line_aware(spark, d):
    tail = F.when(F.col("doc_id") % 2 == 0, "\nPrinted on 5 May\nReport date: today\nReport date: 5 mg\nend").otherwise("")
    t = _docs(spark, d).select("doc_id", F.concat("text", tail).alias("t"))
    return t.select("doc_id", F.sha2(texts.compress_balanced(F.col("t"), line_aware=True), 256).alias("text_sha256"))


@query("""
SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'eat well and rest.' ELSE 'no colon here at all' END AS reply FROM conversations""")
def reply_shaped(spark, d):
    said = F.when(F.col("turn") % 2 == 0, "Here is some advice: eat well and rest.").otherwise("no colon here at all")
    return table(spark, d, "conversations").select("conv_id", "turn", texts.shape_reply(said).alias("reply"))


def _boost_sql(mode: str) -> str:
    table_, units, (heading, h), (reference, r), (flag, least, f), names, steps, cap = state.BOOSTS[mode]
    cased = f"len(regexp_extract_all(t, '{state.UNIT_VALUE.replace('μ', 'u')}'))"
    named = " + ".join(f"CAST(contains(lower(t), '{n}') AS INTEGER)" for n in names)
    stepped = lambda c, s: "CASE " + " ".join(f"WHEN {c} >= {n} THEN {v}" for n, v in s) + " ELSE 0 END"
    return f"""least({cap}, 0.5 + CASE WHEN regexp_matches(t, '{state.TABLE_CELLS}') THEN {table_} ELSE 0 END + {stepped(cased, units)}
 + CASE WHEN {_count('t', heading)} > 0 THEN {h} ELSE 0 END + CASE WHEN {_count('t', reference)} > 0 THEN {r} ELSE 0 END
 + CASE WHEN {_count('t', flag)} >= {least} THEN {f} ELSE 0 END + {stepped(f'({named})', steps)})"""


@query(f"""
WITH t AS (SELECT doc_id, {_ASCII} || CASE doc_id % 4 WHEN 0 THEN ' LIPID PANEL hdl 40 mg/dL, ldl 100 mg/dL, glucose 5 mmol/L (normal, HIGH) | a | b |' WHEN 1 THEN ' tsh 3 % low' ELSE '' END AS t FROM documents)
SELECT doc_id, round(CAST({_boost_sql('accuracy')} AS DOUBLE), 6) AS accuracy, round(CAST({_boost_sql('balanced')} AS DOUBLE), 6) AS balanced FROM t""")
def boosters_by_mode(spark, d):
    k = F.col("doc_id") % 4
    tail = F.when(k == 0, " LIPID PANEL hdl 40 mg/dL, ldl 100 mg/dL, glucose 5 mmol/L (normal, HIGH) | a | b |").when(k == 1, " tsh 3 % low").otherwise("")
    t = _docs(spark, d).select("doc_id", F.concat("text", tail).alias("t"))
    return t.select("doc_id", *[r6(state.boosted(F.col("t"), F.lit(0.5), m)).alias(m) for m in ("accuracy", "balanced")])


@query(f"""
WITH c AS (SELECT doc_id, ceil(length({_ASCII}) / 4.0) AS t, ceil(length({_BALANCED}) / 4.0) AS b FROM documents)
SELECT doc_id, CAST(CASE WHEN b < t * 0.7 OR b >= t THEN t ELSE b END AS BIGINT) AS tokens FROM c WHERE t > 100""")
def mode_pages(spark, d):
    """Pages of the balanced mode that fit one chunk: each has one, whatever its confidence, as it keeps more than 50 tokens."""
    pages = _docs(spark, d).withColumn("page", F.lit(1)).where(texts.tokens(F.col("text")) > 100)
    return documents.mode_chunks(pages, "doc_id", "page", "balanced", limit=1_000_000).select("doc_id", F.col("estimated_tokens").alias("tokens"))


@query()
def mode_chunks(spark, d):
    """Accuracy chunks of documents whose tail holds measurements."""
    pages = _paged(spark, d).withColumn("page", F.lit(1))
    found = documents.mode_chunks(pages, "doc_id", "page", "accuracy", limit=120, overlap=20)
    return found.select("doc_id", "ord", "estimated_tokens", r6("confidence").alias("confidence"), "region", F.sha2("text", 256).alias("text_sha256"))


@query("""
SELECT doc_id, row_number() OVER (PARTITION BY CAST(floor(doc_id / 25) AS BIGINT) ORDER BY doc_id % 4, (doc_id * 7 % 10) / 10.0 DESC, doc_id) AS place FROM documents""")
def chunk_order(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.floor(F.col("doc_id") / 25).alias("report_id"), (F.col("doc_id") % 4).alias("page"), ((F.col("doc_id") * 7 % 10) / 10).alias("confidence"))
    return documents.reading_order(rows, "report_id", "page", order="doc_id").select("doc_id", F.col("place").cast("long").alias("place"))


@query("""
SELECT event_id AS reading_id FROM (SELECT *, coalesce(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM events)
WHERE value / 50 >= 0.3 OR b = 0""")
def unlikely_skipped(spark, d):
    c = readings(spark, d).withColumns({"found": (F.col("name") == "purchase").cast("int"), "confidence": F.col("value") / 50})
    return documents.without_unlikely(c, "person_id", ["reading_id"], "found", "confidence").select("reading_id")


@query("""
WITH c AS (SELECT event_id, user_id, CASE WHEN event_id % 40 < 4 THEN 20 ELSE 0 END AS found, 0.5 AS conf FROM events),
 s AS (SELECT *, sum(found) OVER w AS total, count(*) OVER w AS n, avg(found) OVER w AS mean, coalesce(max(conf) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) AS ahead
       FROM c WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)),
 t AS (SELECT *, coalesce(max(CASE WHEN total >= 30 AND n >= 3 AND found = 0 AND mean < 1 AND ahead <= 0.9 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stopped FROM s)
SELECT event_id AS reading_id FROM t WHERE stopped = 0""")
def stop_early(spark, d):
    c = readings(spark, d).withColumns({"found": F.when(F.col("reading_id") % 40 < 4, 20).otherwise(0), "confidence": F.lit(0.5)})
    return documents.stop_early(c, "person_id", "reading_id", "found", "confidence").select("reading_id")


# names in texts, persons by id or name ---------------------------------------------------------------------------------

_MENTION = ["the", "tion", "er th", "ou", "x"]


@query(f"""
WITH n(name) AS (SELECT DISTINCT lower(split_part(p_name, ' ', 1)) FROM part UNION SELECT * FROM (VALUES {_rows((m,) for m in _MENTION)}))
SELECT conv_id, turn, name FROM conversations, n WHERE contains(lower(text), name)""")
def text_mentions(spark, d):
    names = table(spark, d, "part").select(F.lower(F.split_part("p_name", F.lit(" "), F.lit(1))).alias("name"))
    names = names.union(spark.createDataFrame([(m,) for m in _MENTION], "name string"))
    return relational.mentioned(table(spark, d, "conversations"), names, ["conv_id", "turn"])


@query("""
WITH w AS (SELECT c_custkey AS wanted, CASE WHEN c_custkey % 3 = 0 THEN c_custkey END AS id, CASE WHEN c_custkey % 5 <> 0 THEN upper(substr(c_name, 11, 7)) END AS name FROM customer),
 a AS (SELECT wanted, c_custkey AS match FROM w JOIN customer ON id = c_custkey AND c_custkey % 2 = 0)
SELECT * FROM a UNION ALL SELECT wanted, c_custkey FROM w JOIN customer ON contains(lower(c_name), lower(name)) WHERE wanted NOT IN (SELECT wanted FROM a)""")
def two_stage_match(spark, d):
    p = people(spark, d).select("person_id", F.when(F.col("person_id") % 2 == 0, F.col("person_id")).alias("id"), "name")
    k = F.col("person_id")
    w = people(spark, d).select(k.alias("wanted"), F.when(k % 3 == 0, k).alias("id"), F.when(k % 5 != 0, F.upper(F.substring("name", 11, 7))).alias("name"))
    return relational.two_stage_match(w, p, "person_id", "id", "name").select("wanted", "match")


@query("""
SELECT c_nationkey AS row_id, c_custkey AS person_id, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey % 7 / 10.0 DESC, c_custkey) AS place FROM customer WHERE c_custkey % 7 >= 4""")
def matches_ranked(spark, d):
    m = people(spark, d).where("person_id % 7 >= 4").select(F.col("tenant_id").alias("row_id"), "person_id", (F.col("person_id") % 7 / 10).alias("score"))
    return matching.best_first(m).select("row_id", "person_id", F.col("place").cast("long").alias("place"))


@query("""
WITH s AS (SELECT doc_id, CAST(floor(doc_id / 25) AS BIGINT) AS report_id, count(*) OVER (PARTITION BY floor(doc_id / 25) ORDER BY doc_id) AS n FROM documents)
SELECT report_id, max(n) AS calls, CAST(2 * sum(doc_id % 3) AS BIGINT) AS input_tokens, CAST(sum(doc_id % 5) AS BIGINT) AS output_tokens, string_agg(DISTINCT CAST(doc_id % 3 AS VARCHAR), ' ' ORDER BY CAST(doc_id % 3 AS VARCHAR)) AS patterns FROM s GROUP BY 1""")
def context_counters(spark, d):
    k = F.col("doc_id")
    rows = table(spark, d, "documents").select(
        F.floor(k / 25).alias("report_id"), k.alias("at"), F.lit(1).alias("calls"), (k % 3 * 2).alias("input_tokens"), (k % 5).alias("output_tokens"), F.array((k % 3).cast("string")).alias("patterns"),
    )
    m = state.merge_counters(rows, "report_id", "at")
    return m.select("report_id", "calls", "input_tokens", "output_tokens", F.array_join(F.array_sort("patterns"), " ").alias("patterns"))


@query("""
SELECT event_id AS reading_id, CASE WHEN event_type = 'click' AND value > 25 THEN 'click is high' WHEN event_type IN ('click', 'view') THEN event_type || ' in general' END AS explanation FROM events""")
def explanations(spark, d):
    rows = readings(spark, d).select("reading_id", F.initcap("name").alias("name"), F.when(F.col("value") > 25, 1).otherwise(0).alias("value"), F.when(F.col("value") > 25, "high").otherwise("ok").alias("status"))
    cache = spark.createDataFrame([("click:1:high", "click is high"), ("click", "click in general"), ("view", "view in general")], "key string, text string")
    return state.explanations(rows, cache).select("reading_id", "explanation")


@query("SELECT name, frequency FROM (SELECT event_type || (user_id % 20) AS name, count(*) AS frequency FROM events GROUP BY 1) ORDER BY frequency DESC, name LIMIT 10")
def top_patterns(spark, d):
    p = readings(spark, d).groupBy(F.concat("name", (F.col("person_id") % 20).cast("string")).alias("name")).agg(F.count("*").alias("frequency"))
    return state.top_patterns(p)


@query("""
SELECT CAST(floor(doc_id / 25) AS BIGINT) AS report_id, doc_id FROM documents WHERE least(1.0, 0.7 + CASE WHEN doc_id % 2 = 0 THEN 0.1 ELSE -0.2 END + CASE WHEN doc_id % 3 = 0 THEN 0.05 ELSE 0 END) >= 0.6""")
def context_filter(spark, d):
    k, none = F.col("doc_id"), F.lit(None).cast("double")
    rows = table(spark, d, "documents").select(F.floor(k / 25).alias("report_id"), "doc_id", F.lit(5.0).alias("value"))
    return state.confident(rows, state.context_confidence(k % 2 == 0, k % 3 == 0, F.lit(False), F.col("value"), none)).select("report_id", "doc_id")


@query("""
SELECT user_id AS person_id, count(*) AS calls, CASE WHEN count(*) >= 7 THEN 3 WHEN count(*) >= 3 THEN 2 ELSE 1 END + CASE WHEN sum(value) / count(DISTINCT event_type) > 400 AND count(*) < 7 THEN 1 ELSE 0 END AS level FROM events GROUP BY 1""")
def prompt_levels(spark, d):
    c = readings(spark, d).groupBy("person_id").agg(F.count("*").alias("calls"), F.sum("value").alias("tokens"), F.count_distinct("name").alias("names"))
    return c.select("person_id", "calls", state.prompt_level(F.col("calls"), F.col("tokens"), F.col("names")).cast("long").alias("level"))
