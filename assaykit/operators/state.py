"""What extraction carries from chunk to chunk: boosted confidence, contexts, learned patterns, layout gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bind import bind
from ..functions.texts import confidence, hits, tokens
from ..sources.storage import written
from .documents import pack
from .ordered import moving_average

#: Cells between bars, or between tabs; a single character on either side is enough, which keeps matching linear.
TABLE_CELLS = r"(?:\|[^|]+\|[^|]+\|)|(?:[^\t]\t[^\t]+\t[^\t])"
# A value with its unit, and names that raise a chunk's confidence.
UNIT_VALUE = r"\b\d+[\.,]?\d*\s*(?:mg/[dD][lL]|g/[dD][lL]|mmol/L|U/L|IU/L|ng/m[lL]|pg/m[lL]|μg/[dD][lL]|mcg/[dD][lL]|%)"
_NAMES = ["glucose", "cholesterol", "triglycerides", "hdl", "ldl", "hemoglobin", "hematocrit", "tsh", "creatinine", "albumin", "sodium", "potassium"]

# What a table looks like in a page's text.
TABLE_SHAPES = [
    r"(\+[-+]+\+[\s\S]*?\+[-+]+\+)", r"(\|[^|]*\|[^|]*\|[\s\S]*?\|[^|]*\|)", r"((?:(?:TEST|RESULT|REFERENCE|UNITS|VALUE)(?:\s*\|\s*|\s{2,})){2,}[\s\S]*?(?:\n\s*\n|$))",
]
# What is rewritten before a page is read: units below their values, white space, ranges, methods behind names.
PREPARATIONS = [
    (r"(\d+\.?\d*)\s*\n\s*([a-zA-Z/%]+)", "$1 $2"), (r"\s+", " "), (r"\((\d+\.?\d*)\s*-\s*(\d+\.?\d*)\)", "($1-$2)"),
    *[(rf"\)\s+([\w\s]+{method})", ") [METHOD: $1]") for method in ("Kinetic", "Substrate", "Photometry")],
]
# Fixed values of each mode: table, units (least, boost), headings, reference words, flags (least, boost), names (least, boost), cap.
BOOSTS = {
    "accuracy": (
        0.15, [(3, 0.2), (2, 0.1)], (r"\b(?:QUEST|LABCORP|LABORATORY|CLINICAL CHEMISTRY|HEMATOLOGY|LIPID PANEL|METABOLIC PANEL)\b", 0.1),
        (r"\b(?:reference|normal|ref\.?\s*range|ref\.?\s*interval)\b", 0.1), (r"\b(?:HIGH|LOW|ABNORMAL|NORMAL|H|L|A|N)\b", 2, 0.1),
        [*_NAMES, "calcium", "vitamin d", "b12", "iron", "ferritin"], [(3, 0.15), (1, 0.05)], 0.98,
    ),
    "balanced": (
        0.1, [(4, 0.15), (2, 0.08)], (r"\b(?:LABORATORY|CLINICAL CHEMISTRY|HEMATOLOGY|LIPID PANEL|METABOLIC PANEL)\b", 0.08),
        (r"\b(?:reference|normal|ref\.?\s*range)\b", 0.08), (r"\b(?:HIGH|LOW|ABNORMAL|NORMAL|H|L)\b", 3, 0.08), _NAMES, [(3, 0.1), (1, 0.04)], 0.95,
    ),
    "legacy": (
        0.1, [], (r"\b(?:TEST|RESULT|REFERENCE RANGE)\b", 0.05), (r"$^", 0.0), (r"\b(?:HIGH|LOW|ABNORMAL|NORMAL|H|L|A|N)\b", 1, 0.05), [], [], 0.99,
    ),
}


def _stepped(count: Column, steps: list[tuple[int, float]]) -> Column:
    out = None
    for least, boost in steps:
        out = F.when(count >= least, boost) if out is None else out.when(count >= least, boost)
    return F.lit(0.0) if out is None else out.otherwise(0.0)


def boosted(text: Column, base: Column, mode: str = "balanced") -> Column:
    """A chunk's confidence raised for tables, units, headings, reference words, flags and names, up to the mode's cap."""
    table, units, (heading, h), (reference, r), (flag, least, f), names, name_steps, cap = BOOSTS[mode]
    lower = F.lower(text)
    named = sum((F.contains(lower, F.lit(n)).cast("int") for n in names), F.lit(0))
    case_hits = F.coalesce(F.regexp_count(text, F.lit(UNIT_VALUE)), F.lit(0))
    boost = (
        F.when(text.rlike(TABLE_CELLS), table).otherwise(0.0) + _stepped(case_hits, units) + F.when(hits(text, heading) > 0, h).otherwise(0.0)
        + F.when(hits(text, reference) > 0, r).otherwise(0.0) + F.when(hits(text, flag) >= least, f).otherwise(0.0) + _stepped(named, name_steps)
    )
    return F.least(F.lit(cap), base + boost)


def context_confidence(complete: Column, has_range: Column, in_table: Column, value: Column, known: Column) -> Column:
    """Confidence of an extraction: fields, range and table count for it; a repeated or very different known value against."""
    far = F.abs(known - value) / F.nullif(F.greatest(known, value), F.lit(0.0)) > 0.5
    score = (
        F.lit(0.7) + F.when(complete, 0.1).otherwise(-0.2) + F.when(has_range, 0.05).otherwise(0.0) + F.when(in_table, 0.05).otherwise(0.0)
        - F.when(known == value, 0.1).when(F.coalesce(far, F.lit(False)), 0.15).otherwise(0.0)
    )
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


def confident(rows: DataFrame, score: Column, least: float = 0.6) -> DataFrame:
    """Measurements with ``confidence``, of those that are sure enough in their context."""
    return rows.withColumn("confidence", score).where(F.col("confidence") >= least)


def prompt_level(calls: Column, tokens: Column, names: Column) -> Column:
    """How terse the extractor's request is: 1, 2 from the third call, 3 from the seventh; one more where a name costs over 400 tokens."""
    level = F.when(calls >= 7, 3).when(calls >= 3, 2).otherwise(1)
    dear = F.coalesce(F.try_divide(tokens, names) > 400, F.lit(False))
    return F.least(F.lit(3), level + dear.cast("int"))


def merge_contexts(known: DataFrame, report: str, name: str, page: str, *fields: str) -> DataFrame:
    """What is known of each name in a report: the fields of its last page."""
    return known.groupBy(report, name).agg(F.max(page).alias(page), *[F.max_by(f, page).alias(f) for f in fields])


def merge_counters(contexts: DataFrame, report: str, order: str) -> DataFrame:
    """Calls and tokens added up, patterns once each in the order in which they came."""
    return contexts.groupBy(report).agg(
        F.sum("calls").alias("calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"),
        F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(order, "patterns"))), lambda c: c["patterns"]))).alias("patterns"),
    )


#: Spellings that stand for a name which has this word.
SPELLINGS = [("cholesterol", ["chol", "cholest"]), ("hemoglobin", ["hb", "hgb", "haemoglobin"]), ("glucose", ["glu", "blood glucose"])]


def name_variations(name: Column) -> Column:
    """Sorted spellings of a name: itself in lower case, and those of the words it has."""
    lower = F.lower(name)
    known = [F.when(F.contains(lower, F.lit(w)), F.array(*map(F.lit, spelled))).otherwise(F.array().cast("array<string>")) for w, spelled in SPELLINGS]
    return F.array_sort(F.array_distinct(F.concat(F.array(lower), *known)))


def learn_patterns(patterns: DataFrame, extractions: DataFrame, capacity: int = 1000) -> DataFrame:
    """Patterns (name, unit, frequency, success, low, high, threshold, variations) after extractions (name, unit, value, confidence, ord).

    A known name's success moves a tenth of the way to each confidence, in order; a new name needs a confidence of 0.7,
    starts from its first such extraction, and is taken while there is room, in order of first appearance. No name's extractions
    are gathered: averages of pieces are added up with their weights.
    """
    seen = extractions.select(F.lower(F.replace("name", F.lit(" "), F.lit("_"))).alias("name"), F.col("name").alias("said"), "unit", "value", "confidence", "ord")
    sure = F.when(F.col("confidence") >= 0.7, F.col("ord"))
    starts = seen.groupBy("name").agg(F.min(sure).alias("first"), F.min_by(F.struct("unit", "value", "confidence", "said"), sure).alias("start"))
    known = patterns.select("name", *[F.col(c).alias(f"p_{c}") for c in ("unit", "frequency", "success", "low", "high", "threshold")])
    joined = written(starts.join(known, "name", "full").where(F.col("p_frequency").isNotNull() | F.col("first").isNotNull()), "patterns")
    own = F.col("p_frequency").isNotNull()
    counted = seen.join(joined.select("name", F.when(own, F.lit(None)).otherwise(F.col("first")).alias("from")), "name")
    moved = moving_average(counted.where(F.col("from").isNull() | (F.col("ord") > F.col("from"))), "name", "ord", "confidence")
    all_ = joined.join(moved, "name", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    start, begun = F.col("start"), F.coalesce("p_success", F.col("start.confidence")).cast("double")
    sized = (start["unit"] != "") & (start["value"] > 0)
    made = all_.select(
        "name", F.when(own, F.col("p_unit")).otherwise(start["unit"]).alias("unit"), (F.coalesce("p_frequency", F.lit(1)) + F.col("n")).alias("frequency"),
        (begun * F.pow(F.lit(0.9), F.col("n")) + F.coalesce("moved", F.lit(0.0))).alias("success"),
        F.when(own, F.col("p_low")).when(sized, start["value"] * 0.5).alias("low"), F.when(own, F.col("p_high")).when(sized, start["value"] * 2.0).alias("high"),
        F.when(own, F.col("p_threshold")).otherwise(start["confidence"] * 0.9).alias("threshold"),
        name_variations(F.when(own, F.translate("name", "_", " ")).otherwise(start["said"])).alias("variations"), F.when(own, -1).otherwise(F.col("first")).alias("__first"),
    )
    return made.orderBy("__first", "name").limit(capacity).drop("__first")


def evict(patterns: DataFrame, capacity: int) -> DataFrame:
    """Above 80 per cent of the capacity, the best 70 per cent stay, by frequency times success."""
    size = patterns.agg(F.count("*").alias("__n"))  # a row, which goes along with each pattern
    best = patterns.orderBy((F.col("frequency") * F.col("success")).desc(), "name").limit(int(capacity * 0.7))
    few, many = patterns.crossJoin(size).where(F.col("__n") <= capacity * 0.8), best.crossJoin(size).where(F.col("__n") > capacity * 0.8)
    return few.unionByName(many).drop("__n")


def top_patterns(patterns: DataFrame, n: int = 10) -> DataFrame:
    return patterns.orderBy(F.col("frequency").desc(), "name").limit(n)


def gaps(rows: DataFrame, keys: list[str], at: str, least: float) -> DataFrame:
    """Differences of successive places above ``least``, and whether one is its group's largest (the first of equals)."""
    w = Window.partitionBy(*keys).orderBy(at)
    found = rows.select(*keys, F.lag(at).over(w).alias("before"), F.col(at).alias("after")).withColumn("gap", F.col("after") - F.col("before")).where(F.col("gap") > least)
    best = Window.partitionBy(*keys).orderBy(F.col("gap").desc(), "before")
    return found.withColumn("largest", F.row_number().over(best) == 1)


def zone_cuts(words: DataFrame, keys: list[str], at: str, height: str) -> DataFrame:
    """Where a page's header ends and its footer begins, by gaps in the places of its words: keys, header_end, content_start,
    content_end, footer_start; null where a page has no such gap.

    Gaps above 20 count, on pages of more than 10 words whose largest gap is above 30: the largest one if it begins in the top
    three tenths ends the header, the largest one that begins in the bottom three tenths ends the content.
    """
    page = Window.partitionBy(*keys)
    spaced = words.withColumns({"__n": F.count("*").over(page), "__before": F.lag(at).over(page.orderBy(at))})
    found = spaced.where("__n > 10").withColumn("__gap", F.col(at) - F.col("__before")).where("__gap > 20")
    order = F.struct(-F.col("__gap"), F.col("__before"))
    edge = lambda when: F.min_by(F.when(when, F.struct("__gap", F.col("__before").alias("b"), F.col(at).alias("a"))), F.when(when, order))
    low = F.col("__before") > F.col(height) * 0.7
    page_cuts = found.groupBy(*keys).agg(edge(F.lit(True)).alias("top"), edge(low).alias("foot"), F.max(height).alias("__h")).where("top.__gap > 30")
    head = F.col("top.b") < F.col("__h") * 0.3
    return page_cuts.select(
        *keys, F.when(head, F.col("top.b") + 5).alias("header_end"), F.when(head, F.col("top.a") - 5).alias("content_start"),
        (F.col("foot.b") + 5).alias("content_end"), (F.col("foot.a") - 5).alias("footer_start"),
    )


def discovery(chunks: DataFrame, keys: list[str], order: str, found: str) -> DataFrame:
    """The last three counts, the mean of the last two, and the mean so far, for each chunk."""
    w = Window.partitionBy(*keys).orderBy(order)
    return chunks.withColumns({
        "last_three": F.collect_list(found).over(w.rowsBetween(-2, 0)), "mean_of_two": F.avg(found).over(w.rowsBetween(-1, 0)),
        "mean_so_far": F.avg(found).over(w.rowsBetween(Window.unboundedPreceding, 0)),
    })


def new_or_surer(rows: DataFrame, keys: list[str], name: str, order: str, score: str, least: float = 0.5) -> DataFrame:
    """Measurements of enough confidence whose name hasn't been found before with at least as much."""
    w = Window.partitionBy(*keys, F.lower(name)).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    before = F.max(score).over(w)
    good = rows.where(F.col(score) >= least)
    return good.withColumn("__b", before).where(F.col("__b").isNull() | (F.col(score) > F.col("__b"))).drop("__b")


def dense_chunks(text: Column, limit: int = 4000, confident: float = 0.7) -> Column:
    """Chunks of a zone: paragraphs of high confidence first, surest first, then the others; long ones of little are left out."""
    paragraphs = F.filter(F.split(text, r"\n\s*\n"), lambda p: F.trim(p) != "")
    scored = F.transform(paragraphs, lambda p, i: F.struct((-confidence(p)).alias("c"), i.alias("i"), p.alias("p")))
    ordered = F.array_sort(F.filter(scored, lambda s: (s["c"] <= -0.3) | (tokens(s["p"]) <= 100)))
    part = lambda rows, test: pack(F.transform(F.filter(rows, test), lambda s: s["p"]), limit, "\n\n")
    return bind(ordered, lambda rows: F.concat(part(rows, lambda s: s["c"] <= -confident), part(rows, lambda s: s["c"] > -confident)))


def zone_chunks(pages: DataFrame, report: str, page: str, text: str = "text", limit: int = 4000) -> DataFrame:
    """The ``dense_chunks`` of each page: report, page, ord, text, estimated_tokens, confidence. Blank pages have none."""
    parts = pages.select(report, page, F.posexplode(dense_chunks(F.col(text), limit)).alias("ord", "text"))
    return parts.withColumns({"estimated_tokens": tokens(F.col("text")), "confidence": confidence(F.col("text"))})


def table_text(text: Column) -> Column:
    """The part of a page that looks like a table, else its first 1000 characters."""
    found = [F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in TABLE_SHAPES]
    return F.coalesce(*found, F.substring(text, 1, 1000), F.lit(""))


def prepared_text(text: Column) -> Column:
    """A page as the extractor reads it: no NULs, values and units on one line, single blanks, tight ranges, methods marked."""
    t = F.replace(text, F.lit("\0"), F.lit(""))
    for pattern, to in PREPARATIONS:
        t = F.regexp_replace(t, pattern, to)
    return t


def structure_confidence(pages: DataFrame, report: str) -> DataFrame:
    """Confidence in a report's layout from its pages (tables int, content_confidence double, type_confidence double)."""
    page = F.lit(0.5) + F.when(F.col("tables") > 0, 0.2).otherwise(0.0) + F.when(F.col("content_confidence") > 0.7, 0.1).otherwise(0.0)
    kind = F.max("type_confidence")
    bonus = F.when(F.sum("tables") > 0, F.least(F.lit(0.2), F.sum("tables") * 0.05)).otherwise(0.0)
    return pages.groupBy(report).agg(F.least(F.lit(0.95), (F.sum(page) + 2 * kind) / (F.count("*") + 1) + bonus).alias("confidence"))


def sections(text: Column, markers: list[str]) -> Column:
    """The parts of a text behind each marker line, up to the next one; null where a marker is missing."""
    any_marker = "|".join(markers)
    return F.struct(*[
        F.nullif(F.regexp_extract(text, rf"(?s){m}\s*:?\s*(.*?)\s*(?=(?:{any_marker})\s*:|$)", 1), F.lit("")).alias(m.lower().replace(" ", "_")) for m in markers
    ])


def bullets(text: Column) -> Column:
    """Bullet lines of a summary, without their marks."""
    lines = F.transform(F.split(text, "\n"), lambda s: F.trim(s))
    return F.transform(F.filter(lines, lambda s: s.rlike("^[•*-]")), lambda s: F.trim(F.regexp_replace(s, "^[•*-]+", "")))


def explanations(rows: DataFrame, cache: DataFrame) -> DataFrame:
    """Explanations by name, value and status, else by name alone, from a cache (key, text) that holds fresh entries only."""
    c = cache.select("key", F.col("text").alias("t"))
    exact = F.concat_ws(":", F.lower("name"), F.col("value").cast("string"), F.col("status"))
    one = rows.withColumns({"__exact": exact, "__name": F.lower("name")}).join(c.withColumnsRenamed({"key": "__exact", "t": "a"}), "__exact", "left")
    both = one.join(c.withColumnsRenamed({"key": "__name", "t": "b"}), "__name", "left")
    return both.select(*rows.columns, F.coalesce("a", "b").alias("explanation"))


def cached_explanations(rows: DataFrame, general: DataFrame, specific: DataFrame, now: Column, general_days: int = 30, specific_days: int = 7) -> DataFrame:
    """``rows`` (name, value, status) with general, specific and from_cache: the newest entries of two caches (key, text, made) that aren't
    older than their days at ``now``, by name and by name, value and status. An answer is from the cache where both are there.

    Each cache has one row a key before it is joined, so that hot names are joined, not multiplied. Null names have nothing.
    """

    def newest(cache: DataFrame, days: int, key: str, to: str) -> DataFrame:
        age = F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("made").cast("timestamp"))
        return cache.where(age <= days * 86_400_000_000).groupBy(F.col("key").alias(key)).agg(F.max_by("text", F.struct("made", "text")).alias(to))

    exact = F.concat(F.col("name"), F.lit(":"), F.col("value").cast("string"), F.lit(":"), F.col("status"))
    asked = rows.withColumns({"__name": F.col("name"), "__exact": exact})
    both = asked.join(newest(general, general_days, "__name", "general"), "__name", "left").join(newest(specific, specific_days, "__exact", "specific"), "__exact", "left")
    return both.withColumn("from_cache", F.col("general").isNotNull() & F.col("specific").isNotNull()).drop("__name", "__exact")


def prompt(strategy: Column, name_count: Column, text: Column) -> Column:
    """The extractor's request: terse once much is known."""
    return F.format_string(
        "Extract measurements as JSON (%s; %d names known).\n%s", strategy, F.coalesce(name_count, F.lit(0)).cast("int"), F.coalesce(text, F.lit(""))
    )
