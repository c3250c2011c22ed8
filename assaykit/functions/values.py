"""Values, reference ranges, units, names and flags of measurements, as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .bind import bind

# Spellings of units and their standard form.
UNIT_SPELLINGS = {
    "mg/dL": ["mg/dl", "mg / dl", "mg/deciliter", "mg per dl", "mg per deciliter"],
    "g/dL": ["g/dl", "g / dl", "g/deciliter", "g per dl", "g per deciliter"],
    "%": ["percent", "percentage", "pct", "pct."],
    "mmol/L": ["mmol/l", "mmol / l", "millimol/l", "millimoles/l"],
    "U/L": ["u/l", "units/l", "u / l", "iu/l"],
}
MICRO_UNITS = ["mcg/ml", "mcg/dl", "mcg/l"]

# Categories in order, with the words that put a name there.
CATEGORY_WORDS = [
    ("Lipid", ["cholesterol", "ldl", "hdl", "triglyceride"]),
    ("Metabolic", ["glucose", "a1c", "insulin", "hba1c"]),
    ("Hormone", ["tsh", "t3", "t4", "thyroid"]),
    ("Vitamin", ["vitamin", "folate", "b12"]),
    ("Immunology", ["ige", "immunoglobulin", "antibody", "antigen"]),
    ("Mineral", ["iron", "ferritin", "magnesium", "calcium", "sodium", "potassium"]),
    ("Blood", ["hemoglobin", "hematocrit", "wbc", "rbc", "platelet"]),
    ("Liver", ["alt", "ast", "alp", "bilirubin", "albumin"]),
    ("Kidney", ["creatinine", "egfr", "bun"]),
]

# Factors to the standard unit, by name and unit.
UNIT_FACTORS = [
    ("glucose", "mmol/L", 18.0182), ("hba1c", "mmol/mol", 0.09148), ("total cholesterol", "mmol/L", 38.67),
    ("hdl", "mmol/L", 38.67), ("ldl", "mmol/L", 38.67), ("triglycerides", "mmol/L", 88.57), ("hemoglobin", "g/L", 0.1),
    ("t3", "nmol/L", 65.1), ("t4", "nmol/L", 12.87), ("vitamin d", "nmol/L", 0.4), ("vitamin b12", "pmol/L", 0.738),
    ("creatinine", "µmol/L", 0.0113), ("bun", "mmol/L", 2.8),
]

# Words for confidence, and the value of each.
CONFIDENCE_WORDS = [
    ("very_high", 0.95), ("very high", 0.95), ("high", 0.85), ("medium_high", 0.75), ("medium high", 0.75), ("medium", 0.65),
    ("med", 0.65), ("medium_low", 0.55), ("medium low", 0.55), ("low", 0.45), ("very_low", 0.35), ("very low", 0.35),
    ("uncertain", 0.5), ("unknown", 0.5),
]


def number(text: Column) -> Column:
    return text.try_cast("double")


def clean_number(text: Column) -> Column:
    """Digits, dots and dashes of a text as a number; 0 where that isn't one."""
    return F.coalesce(number(F.regexp_replace(text, r"[^0-9.\-]", "")), F.lit(0.0))


def standard_unit(unit: Column) -> Column:
    trimmed = F.trim(unit)
    lower = F.lower(trimmed)
    suffixes = lambda c: F.replace(F.replace(F.replace(c, F.lit("/dl"), F.lit("/dL")), F.lit("/ml"), F.lit("/mL")), F.lit("/l"), F.lit("/L"))
    out = F.when(unit.isNull() | (unit == ""), "-")
    for to, spellings in UNIT_SPELLINGS.items():
        out = out.when(lower.isin(spellings), to)
    return out.when(lower.isin(MICRO_UNITS), suffixes(F.replace(trimmed, F.lit("mcg"), F.lit("μg")))).otherwise(suffixes(trimmed))


def category(name: Column) -> Column:
    """First category one of whose words stands anywhere in the name."""
    lower, out = F.lower(name), None
    for label, words in CATEGORY_WORDS:
        hit = lower.rlike("|".join(words))
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise("Other")


def reference_range(text: Column) -> Column:
    """struct(low, high) of a range text: ``a-b``, ``< a``, ``> a``, one number (high, unless words say above), two numbers."""
    t = F.trim(text)
    parts = F.split(t, "-")
    low, high = number(F.trim(F.try_element_at(parts, F.lit(1)))), number(F.trim(F.try_element_at(parts, F.lit(2))))
    dash = t.contains("-") & ~t.contains("<") & ~t.contains(">") & low.isNotNull() & high.isNotNull()
    below, above = F.regexp_extract(t, r"[<≤]\s*([0-9]+\.?[0-9]*)", 1), F.regexp_extract(t, r"[>≥]\s*([0-9]+\.?[0-9]*)", 1)
    found = F.regexp_extract_all(t, F.lit(r"([0-9]+\.?[0-9]*)"), F.lit(1))
    first, second = number(F.try_element_at(found, F.lit(1))), number(F.try_element_at(found, F.lit(2)))
    lower = F.lower(t)
    says_below, says_above = lower.rlike("<|less than|under|below"), lower.rlike(">|greater than|above|over")
    none = F.lit(None).cast("double")
    pair = lambda a, b: F.struct(a.alias("low"), b.alias("high"))
    return (
        F.when(t.isNull() | (t == ""), pair(none, none))
        .when(dash, pair(low, high))
        .when(below != "", pair(none, number(below)))
        .when(above != "", pair(number(above), none))
        .when((F.size(found) == 1) & says_above & ~says_below, pair(first, none))
        .when(F.size(found) == 1, pair(none, first))
        .when(F.size(found) == 2, pair(first, second))
        .otherwise(pair(none, none))
    )


def display_range(text: Column) -> Column:
    """struct(low, high) as dashboards read a range: thousands commas go; ``a-b`` or ``a to b``, ``<`` or ``less than``, ``>`` or
    ``greater than``, ``up to``; a lone number says nothing."""
    t = F.regexp_replace(F.trim(text), ",", "")
    num = r"([0-9]+(?:\.[0-9]+)?)"
    both = rf"{num}\s*[-–—to]+\s*{num}"
    below, above = rf"(?i)(?:[<≤]\s*=?|less than)\s*{num}", rf"(?i)(?:[>≥]\s*=?|greater than)\s*{num}"
    none = F.lit(None).cast("double")
    pick = lambda p, g=1: number(F.nullif(F.regexp_extract(t, p, g), F.lit("")))
    pair = lambda a, b: F.struct(a.alias("low"), b.alias("high"))
    return (
        F.when(t.rlike(both), pair(pick(both), pick(both, 2)))
        .when(t.rlike(below), pair(none, pick(below)))
        .when(t.rlike(above), pair(pick(above), none))
        .when(t.rlike(rf"(?i)up to\s*{num}"), pair(none, pick(rf"(?i)up to\s*{num}")))
        .otherwise(pair(none, none))
    )


def strict_range(text: Column) -> Column:
    """struct(low, high) where the whole text is ``a-b``, ``<a``, ``<=a``, ``>a`` or ``>=a``; else nulls."""
    t, num = F.trim(text), r"(-?[0-9]+(?:\.[0-9]+)?)"
    none = F.lit(None).cast("double")
    pick = lambda p, g=1: number(F.nullif(F.regexp_extract(t, p, g), F.lit("")))
    pair = lambda a, b: F.struct(a.alias("low"), b.alias("high"))
    both = rf"^{num}\s*-\s*{num}$"
    return (
        F.when(t.rlike(both), pair(pick(both), pick(both, 2)))
        .when(t.rlike(rf"^[<≤]\s*=?\s*{num}$"), pair(none, pick(rf"^[<≤]\s*=?\s*{num}$")))
        .when(t.rlike(rf"^[>≥]\s*=?\s*{num}$"), pair(pick(rf"^[>≥]\s*=?\s*{num}$"), none))
        .otherwise(pair(none, none))
    )


def outside_range(is_abnormal: Column, value: Column, low: Column, high: Column, text: Column) -> Column:
    """What a shown table sorts as its status: the flag where there is one, else the numeric range if it has both ends, else the range
    text as ``strict_range`` reads it; false where nothing tells."""
    read = strict_range(text)
    beyond = lambda a, b: F.coalesce(value < a, F.lit(False)) | F.coalesce(value > b, F.lit(False))
    return F.coalesce(is_abnormal, F.when(low.isNotNull() & high.isNotNull(), beyond(low, high)).otherwise(beyond(read["low"], read["high"])), F.lit(False))


def status(value: Column, low: Column, high: Column) -> Column:
    known = value.isNotNull() & (low.isNotNull() | high.isNotNull())
    outside = F.coalesce(value < low, F.lit(False)) | F.coalesce(value > high, F.lit(False))
    return F.when(~known, "Unknown").when(outside, "Abnormal").otherwise("Normal")


def trend(latest: Column, previous: Column, tolerance: float = 0.001) -> Column:
    return (
        F.when(latest.isNull() | previous.isNull(), "Unknown").when(F.abs(latest - previous) < tolerance, "Stable")
        .when(latest > previous, "Up").otherwise("Down")
    )


def abnormal_tag(is_abnormal: Column, value: Column, low: Column, high: Column) -> Column:
    return F.when(is_abnormal, F.when(value > high, "HIGH").when(value < low, "LOW").otherwise("ABNORMAL"))


def abnormal_flag(flag: Column, value: Column, low: Column, high: Column) -> Column:
    """A flag text decides where there is one, else the range."""
    said = F.upper(F.trim(flag)).isin("H", "L", "A", "HIGH", "LOW", "ABNORMAL", "TRUE")
    outside = F.coalesce(value < low, F.lit(False)) | F.coalesce(value > high, F.lit(False))
    return F.when(F.coalesce(F.trim(flag), F.lit("")) != "", said).otherwise(outside)


def range_position(value: Column, low: Column, high: Column) -> Column:
    """Place on a bar whose range covers 20 to 80 per cent, held within 5 and 95; 50 if a bound is missing."""
    at = 20 + (value - low) / F.nullif(high - low, F.lit(0.0)) * 60
    return F.when(low.isNull() | high.isNull() | value.isNull(), 50.0).otherwise(F.greatest(F.least(F.coalesce(at, F.lit(50.0)), F.lit(95.0)), F.lit(5.0)))


def shown(n: Column) -> Column:
    """A number as dashboards print it: without ``.0``."""
    return F.regexp_replace(n.cast("string"), r"\.0$", "")


def range_text(text: Column, low: Column, high: Column) -> Column:
    """The text, else ``low-high`` where both are known."""
    return F.coalesce(F.nullif(text, F.lit("")), F.when(low.isNotNull() & high.isNotNull(), F.concat(shown(low), F.lit("-"), shown(high))))


def range_of_object(v: Column) -> Column:
    """struct(low, high, text) of a variant ``{low, high, unit}``. A bound that is no number takes the other with it; the text is
    ``low-high unit``, ``> low``, ``< high``, or the object itself where there is no bound."""
    def shown(v: Column) -> Column:
        raw = F.struct(*[F.try_variant_get(v, f"$.{k}", "string").alias(k) for k in ("low", "high", "unit")])
        return bind(raw, lambda raw: bind(F.struct(*[number(raw[k]).alias(k) for k in ("low", "high")]), lambda read: bounded(v, raw, read)))

    def bounded(v: Column, raw: Column, read: Column) -> Column:
        bad = (raw["low"].isNotNull() & read["low"].isNull()) | (raw["high"].isNotNull() & read["high"].isNull())
        return bind(F.struct(*[F.when(~bad, read[k]).alias(k) for k in ("low", "high")]), lambda r: said(v, raw["unit"], r["low"], r["high"]))

    def said(v: Column, unit: Column, low: Column, high: Column) -> Column:
        bounds = (
            F.when(low.isNotNull() & high.isNotNull(), F.concat(low.cast("string"), F.lit("-"), high.cast("string")))
            .when(low.isNotNull(), F.concat(F.lit("> "), low.cast("string"))).when(high.isNotNull(), F.concat(F.lit("< "), high.cast("string")))
        )
        text = F.coalesce(F.concat_ws(" ", F.nullif(bounds, F.lit("")), F.when(bounds.isNotNull(), F.nullif(unit, F.lit("")))), F.lit(""))
        return F.when(v.isNotNull(), F.struct(low.alias("low"), high.alias("high"), F.when(text != "", text).otherwise(F.to_json(v)).alias("text")))

    return bind(v, shown)


def effective_date(*dates: Column) -> Column:
    """The first date that is known: of the report, else of its upload, else of the row."""
    return F.coalesce(*dates)


def base_name(path: Column) -> Column:
    """File name without folder and extension; ``Unknown`` for a missing path."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.when(F.coalesce(path, F.lit("")) == "", "Unknown").otherwise(F.regexp_replace(name, r"\.[^.]+$", ""))


#: Names that dashboards show under another one.
SYNONYMS = {"25-Hydroxyvitamin D": "Vitamin D"}


def canonical_name(name: Column, synonyms: dict[str, str] | None = None) -> Column:
    """The name under which synonyms are shown; others stay."""
    known = SYNONYMS if synonyms is None else synonyms
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in known.items() for x in kv]), name), name) if known else name


def confidence(text: Column) -> Column:
    """Confidence from a number in 0 to 1 or a word; 0.7 if it is neither."""
    t = F.lower(F.trim(text))
    words = F.create_map(*[F.lit(x) for pair in CONFIDENCE_WORDS for x in pair])
    partial = None
    for w, v in CONFIDENCE_WORDS:
        partial = F.when(t.contains(w), v) if partial is None else partial.when(t.contains(w), v)
    n = number(t)
    return F.when(text.isNull(), 0.7).when(n.isNotNull(), F.greatest(F.least(n, F.lit(1.0)), F.lit(0.0))).otherwise(
        F.coalesce(F.try_element_at(words, t), partial.otherwise(0.7))
    )


def llm_confidence(has_unit: Column, has_range: Column, has_category: Column) -> Column:
    """Default confidence of an extracted measurement, by the fields that it has."""
    score = F.lit(0.8) + F.when(has_unit, 0.1).otherwise(0.0) + F.when(has_range, 0.05).otherwise(0.0) + F.when(has_category, 0.05).otherwise(0.0)
    return F.least(score, F.lit(0.99))


def percent_change(first: Column, last: Column) -> Column:
    return F.when(first.isNull() | last.isNull() | (first == 0), 0.0).otherwise((last - first) / F.abs(first) * 100)


def one_decimal(x: Column) -> Column:
    """A number with one decimal as C prints it: the nearest to the double's exact value, of two as near the even one.
    ``format_string`` rounds the shortest decimal that reads as the double, and halves up."""
    size = F.abs(x)
    below = F.floor(size * 10)
    half = 2 * below + 1  # twentieths: midway to the next tenth
    beyond = (size * 16 - half) + size * 4  # without any rounding near the middle
    tenths = below + F.when((beyond > 0) | ((beyond == 0) & (below % 2 == 1)), 1).otherwise(0)
    sign = F.when(F.startswith(x.cast("string"), F.lit("-")), "-").otherwise("")
    plain = F.concat(sign, F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"))
    return F.when(size < 1e14, plain).otherwise(F.format_string("%.1f", x))  # doubles beyond have few decimals or none


def date_of(text: Column) -> Column:
    """First of the known date formats that fits."""
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in ("yyyy-MM-dd", "MM/dd/yyyy", "dd/MM/yyyy", "yyyy/MM/dd")]).cast("date")


def gender(text: Column) -> Column:
    t = F.lower(F.trim(text))
    return F.when(t.isin("m", "male"), "male").when(t.isin("f", "female"), "female").otherwise(t)


def whole_years(born: Column, at: Column) -> Column:
    return F.floor(F.datediff(at, born) / 365)


def json_object(text: Column) -> Column:
    """The outermost ``{...}`` of a text, parsed; null where that isn't JSON."""
    return F.try_parse_json(F.regexp_extract(text, r"(\{[\s\S]*\})", 1))


def filled_fields(fields: Column) -> Column:
    """A map without its null and empty values."""
    return F.map_filter(fields, lambda k, v: v.isNotNull() & (v != ""))


def _closed(text: Column) -> Column:
    """The text with the brackets appended that it leaves open, innermost first."""

    def step(still: Column, c: Column) -> Column:
        done = F.substring(still, F.lit(1), F.lit(1)) == c
        return F.when(c == "{", F.concat(F.lit("}"), still)).when(c == "[", F.concat(F.lit("]"), still)).when(
            done, F.substring(still, F.lit(2), F.length(still))
        ).otherwise(still)

    marks = F.regexp_extract_all(F.regexp_replace(text, r'"(?:\\.|[^"\\])*"', ""), F.lit(r"([\[\]{}])"), F.lit(1))
    return F.concat(text, F.aggregate(marks, F.lit(""), step))


def repaired_json(text: Column) -> Column:
    """A language model's JSON object, mended: fences and words around it, comments, control characters, bare names, single
    quotes, missing and trailing commas, open brackets. Where that isn't JSON yet, the complete named objects alone, and
    without any an empty list: the result always parses."""
    t = F.regexp_replace(text, "```json|```", "")
    t = F.coalesce(F.nullif(F.regexp_extract(t, r"(\{[\s\S]*\})", 1), F.lit("")), F.nullif(F.regexp_extract(t, r"(\{[\s\S]*)", 1), F.lit("")), t)
    for pattern, to in (
        (r"(?<![:\"'])//[^\n]*\n", ""), (r"/\*[\s\S]*?\*/", ""), (r"[\x00-\x08\x0B\x0C\x0E-\x1F]", ""),
        (r"([{,]\s*)([a-zA-Z_][a-zA-Z0-9_]*)(\s*:)", '$1"$2"$3'), (r"(?<!\\)'((?:\\.|[^\\'])*)'(?=\s*[,:}\]]|$)", '"$1"'),
        (r"\}\s*\{", "},{"), (r'(true|false|null|"[^"]*"|\d|\}|\])\s+("[\w\s]+"\s*:)', "$1, $2"), (r",\s*([}\]])", "$1"),
    ):
        t = F.regexp_replace(t, pattern, to)
    parses = lambda s: F.try_parse_json(s).isNotNull()
    named = F.filter(F.regexp_extract_all(t, F.lit(r'(\{\s*"name"\s*:[^{}]*\})'), F.lit(1)), parses)
    rest = F.concat(F.lit('{"biomarkers": ['), F.array_join(named, ","), F.lit('], "metadata": {}}'))
    return bind(t, lambda s: F.when(parses(s), s).when(parses(_closed(s)), _closed(s)).otherwise(rest))


def complete_objects(text: Column) -> Column:
    """The innermost complete ``{...}`` objects of a text that may be cut off."""
    return F.filter(F.regexp_extract_all(text, F.lit(r"(\{[^{}]*\})"), F.lit(1)), lambda s: F.try_parse_json(s).isNotNull())
