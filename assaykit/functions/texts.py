"""Scores, screens, token counts and compression of report texts, as Column functions.

Patterns read ASCII word boundaries alike on all engines; pass texts through ``plain_ascii`` to get equal results.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .bind import bind

#: A digit, among the words of which a pattern needs one.
DIGIT = "0-9"

# Patterns of measurements and their weights, for the confidence of a text.
SCORE_PATTERNS = [
    (r"\b\d+[\.,]?\d*\s*(?:mg/[dD][lL]|g/[dD][lL]|mmol/L|U/L|IU/L|ng/m[lL]|pg/m[lL]|μg/[dD][lL]|mcg/[dD][lL]|%|mEq/L)", 2),
    (r"\b[A-Za-z\s]+:\s*\d+[\.,]?\d*\s*[a-zA-Z/%]+", 2),
    (r"\b[A-Za-z\s]+\s+\d+[\.,]?\d*\s*[a-zA-Z/%]+\s*\(.*?\)", 2),
    (r"\b(?:high|low|normal|positive|negative|abnormal)\b", 1),
    (r"\b(?:reference\s*range|normal\s*range|ref[.]?\s*range)\b", 1),
    (r"(?:\d+\s*[\-–]\s*\d+)", 1),
    (r"\b(?:glucose|cholesterol|triglycerides|hdl|ldl|alt|ast|tsh|t4|hemoglobin|a1c|creatinine|sodium|potassium|calcium|vitamin\s+[a-d])\b.{0,30}?\d+[\.,]?\d*", 1),
]
SCORE_HEADERS = [
    r"\b(?:laboratory\s+results|lab\s+results|test\s+results)\b",
    r"\b(?:clinical\s+chemistry|chemistry\s+panel|chemistry\s+results)\b",
    r"\b(?:hematology\s+panel|hematology\s+results|blood\s+panel)\b",
    r"\b(?:lipid\s+panel|metabolic\s+panel|liver\s+panel|kidney\s+panel)\b",
]
# What a text needs to have, in lower case, for a pattern to match: one word of each group. Looking for words is much cheaper
# than matching, and most texts lack them.
_LAB_NAMES = "glucose cholesterol triglycerides hdl ldl alt ast tsh t4 hemoglobin a1c creatinine sodium potassium calcium vitamin".split()
SCORE_NEEDS = [
    [[DIGIT]], [[DIGIT], [":"]], [[DIGIT], ["("]], [["high", "low", "normal", "positive", "negative"]], [["range"]], [[DIGIT]], [[DIGIT], _LAB_NAMES],
]
HEADER_NEEDS = [[["results"]], [["chemistry"]], [["hematology", "panel"]], [["panel"]]]
# Density steps of the confidence.
SCORE_STEPS = [(5, 0.95), (2, 0.85), (1, 0.75), (0.5, 0.6), (0.2, 0.4)]

# Patterns of the quick screen.
SCREEN_LAB = [
    r"\b(?:laboratory\s+report|diagnostic\s+report|clinical\s+pathology|test\s+report|lab\s+results)\b",
    r"\b(?:redcliffe\s+labs|pharmeasy\s+labs|orange\s+health\s+labs|agilus\s+diagnostics)\b",
    r"\b(?:quest\s+diagnostics|labcorp|thyrocare|dr\s+lal\s+path\s+labs)\b",
    r"\b(?:hematology|clinical\s+chemistry|biochemistry|immunology|microbiology)\b",
    r"\b(?:complete\s+blood\s+count|cbc|lipid\s+profile|liver\s+function|kidney\s+function)\b",
    r"\b(?:final\s+report|report\s+status|biological\s+reference|reference\s+interval)\b",
]
SCREEN_PATTERNS = [
    (r"\d+[\.,]?\d*\s*(?:mg/dl|mg/l|g/dl|mmol/l|u/l|iu/l|ng/ml|pg/ml|mcg/dl|%|mil/μl|thou/μl)", 3),
    (r"(?:glucose|cholesterol|triglycerides|hdl|ldl|hemoglobin|hematocrit|tsh|alt|ast|creatinine|sodium|potassium|vitamin).*?\d+", 2),
    (r"\d+.*?(?:glucose|cholesterol|triglycerides|hdl|ldl|hemoglobin|hematocrit|tsh|alt|ast|creatinine|sodium|potassium|vitamin)", 2),
    (r"(?:hemoglobin|hb|rbc|wbc|platelet).*?\d+[\.,]?\d*", 2),
    (r"\d+[\.,]?\d*.*?(?:hemoglobin|hb|rbc|wbc|platelet)", 2),
    (r"\b(?:high|low|abnormal|normal)\s*(?:\*|\#|h|l)\b", 2),
    (r"\b\d+[\.,]?\d*\s*[a-z/μ]+\s*(?:high|low|h|l|\*)\b", 2),
    (r"\b\d+[\.,]?\d*\s*[-–]\s*\d+[\.,]?\d*", 1),
    (r"\(.*?\d+[\.,]?\d*\s*[-–]\s*\d+[\.,]?\d*.*?\)", 1),
    (r"(?:\|[^|]*\d+[^|]*\|)|(?:\s+\d+[\.,]?\d*\s+[a-z/μ]+\s+)", 1),
    (r"\b(?:clinical\s+chemistry|hematology|lipid\s+panel|metabolic\s+panel)\b", 1),
]
SCREEN_ADMIN = [
    r"\b(?:fax|phone|tel|email|website|www\.|\.com|\.org|\.edu)\b",
    r"\b(?:street|avenue|road|suite|building|floor|zip|zipcode|state|city)\b",
    r"\b\d{5}(?:-\d{4})?\b",
    r"\bpage\s+\d+\s+of\s+\d+\b",
    r"\bcontinued\s+on\s+next\s+page\b",
    r"\bprinted\s+on\b",
    r"\breport\s+generated\b",
    r"\bbilling|invoice|payment|insurance|copay|deductible\b",
    r"\blegal|disclaimer|confidential|hipaa|privacy\b",
]
_SCREEN_NAMES = "glucose cholesterol triglycerides hdl ldl hemoglobin hematocrit tsh alt ast creatinine sodium potassium vitamin".split()
_BLOOD_NAMES = ["hemoglobin", "hb", "rbc", "wbc", "platelet"]
SCREEN_LAB_NEEDS = [
    [["report", "pathology", "results"]], [["labs", "diagnostics"]], [["diagnostics", "labcorp", "thyrocare", "path"]], [["ology", "chemistry"]],
    [["count", "cbc", "profile", "function"]], [["report", "reference"]],
]
SCREEN_NEEDS = [
    [[DIGIT]], [[DIGIT], _SCREEN_NAMES], [[DIGIT], _SCREEN_NAMES], [[DIGIT], _BLOOD_NAMES], [[DIGIT], _BLOOD_NAMES], [["high", "low", "normal"]], [[DIGIT]], [[DIGIT]],
    [[DIGIT], ["("]], [[DIGIT]], [["chemistry", "hematology", "panel"]],
]
SCREEN_ADMIN_NEEDS = [
    [["fax", "phone", "tel", "email", "website", "www.", ".com", ".org", ".edu"]], [["street", "avenue", "road", "suite", "building", "floor", "zip", "state", "city"]],
    [[DIGIT]], [["page"], [DIGIT]], [["continued"]], [["printed"]], [["generated"]],
    [["billing", "invoice", "payment", "insurance", "copay", "deductible"]], [["legal", "disclaimer", "confidential", "hipaa", "privacy"]],
]
# Thresholds of the screen once so many chunks are kept.
SCREEN_LEVELS = [(0, 0.3), (1, 0.3), (10, 0.4), (15, 0.4), (20, 0.5)]

# What compression takes out, for either mode.
LEGACY_REMOVALS = [
    r"Page \d+ of \d+", r"http[s]?://[^\s]+", r"www\.[^\s]+", r"Email\s*:\s*[^\s]+@[^\s]+", r"Tel\s*:\s*[\d\s\-\+\(\)]{10,}",
    r"Fax\s*:\s*[\d\s\-\+\(\)]{10,}", r"CIN\s*[-:]?\s*[A-Z0-9]{15,}", r"GSTIN\s*[-:]?\s*[A-Z0-9]{15,}", r"©\s*\d{4}[^.]*\.?",
]
BALANCED_REMOVALS = [
    r"http[s]?://[^\s]+", r"www\.[^\s]+", r"\b\d{3}[-.\s]?\d{3}[-.\s]?\d{4}\b", r"\([0-9]{3}\)\s*[0-9]{3}[-.\s]?[0-9]{4}",
    r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b", r"©.*?(?:\d{4}).*?(?:\.|$)", r"copyright.*?(?:\d{4}).*?(?:\.|$)",
    r"all rights reserved.*?(?:\.|$)", r"confidential.*?(?:\.|$)", r"proprietary.*?(?:\.|$)", r"page \d+ of \d+", r"page \d+/\d+",
    r"pg\. \d+", r"version \d+\.\d+[\.\d]*", r"v\d+\.\d+[\.\d]*", r"ver\. \d+\.\d+", r"[-=_*]{5,}", r"\.{5,}", r"\|{3,}",
]

# What legacy compression rewrites: rules, empty cells, thousands commas, trailing zeros.
LEGACY_REPLACEMENTS = [(r"[-_*=]{5,}", " "), (r"\|{3,}", "|"), (r"(\d+),(\d{3})", "$1$2"), (r"(\d+)\.0+\b", "$1")]
# What the conservative cleanup takes out.
FOOTERS = [
    r"Page \d+ of \d+", r"©\s*\d{4}.*?(?:\n|$)", r"All rights reserved.*?(?:\n|$)", r"Confidential.*?(?:\n|$)", r"www\.[a-zA-Z0-9.-]+\.[a-zA-Z]{2,4}", r"http[s]?://[^\s]+",
]
# Lines about a report's handling, and what makes a line worth keeping all the same.
ADMIN_LINES = [
    r"^printed\s+on\s+\d", r"^generated\s+on\s+\d", r"^report\s+date\s*:", r"^specimen\s+received\s*:", r"^collected\s+on\s*:",
    r"^accession\s*(number|#|id)\s*:", r"^lab\s+(id|code|number)\s*:", r"^order\s+(id|number)\s*:", r"^requisition\s*#?\s*:", r"^client\s+(id|code)\s*:",
    r"^\s*for\s+questions", r"^\s*please\s+contact", r"^\s*reference\s+ranges?\s+may\s+vary", r"^\s*normal\s+values?\s+may\s+vary",
]
KEPT_LINES = [
    r"\d+[\.,]?\d*\s*(?:mg|g|dl|ml|l|mmol|mol|iu|u|pg|ng|μg|mcg|%|mEq)", r"\d+[\.,]?\d*\s*/\s*(?:dl|ml|l|min|m2|kg)",
    r"(?:high|low|normal|abnormal|positive|negative|elevated|decreased)\b", r"reference\s+range", r"normal\s+range", r"\breference\s*:", r"\bnormal\s*:",
]
# Signs of measurements on a page.
INDICATORS = [
    r"\b\d+\.?\d*\s*(?:mg/dL|g/dL|mmol/L|mol/L|U/L|IU/L|ng/mL|pg/mL|mIU/L|μIU/mL|μg/dL|mcg/dL|%|mEq/L)", r"\bnormal\s*range", r"\breference\s*range", r"\brange",
    r"\bvalue", r"\bresult", r"\blow\b|\bhigh\b", r"\bpositive\b|\bnegative\b", r"\bchemistry\b", r"\bhematology\b", r"\btest\b|\btests\b",
]
# Endings of a reply that are worth keeping, and beginnings that talk about the reply.
IMPORTANT_ENDINGS = ["note:", "consult", "healthcare provider", "medical advice"]
META_PHRASES = ["Here is a concise response", "Here is some advice", "This is a response", "I'll provide", "Let me help you"]

# Units behind a number that make a page relevant.
RELEVANT_UNITS = r"(?i)\b\d+(\.\d+)?\s*(mg/dL|g/dL|%|mmol/L|U/L|IU/L|ng/mL|pg/mL|mIU/L|μIU/mL|μg/dL|ug/dL|mEq/L|meq/L|K/μL|K/uL|M/μL|M/uL|fL|pg|mm/hr)\b"
# A line that looks like a table's row.
TABLE_LINE = r"^\s*[\w\s\(\)\-\+,/]+(\s{2,}|\t)[\d\.<>\-\s]+"

# Patterns that name a laboratory.
LAB_NAMES = [
    ("quest_diagnostics", [r"quest\s*diagnostics", r"questdiagnostics\.com", r"quest\s*diagnostics\s*incorporated"]),
    ("labcorp", [r"lab(?:oratory\s*)?corp(?:oration)?", r"labcorp\.com"]),
    ("mayo_clinic", [r"mayo\s*clinic", r"mayo\s*medical\s*laboratories"]),
    ("cleveland_clinic", [r"cleveland\s*clinic", r"clevelandclinic\.org"]),
    ("arup", [r"arup\s*laboratories", r"aruplab(?:s)?\.com"]),
]


def plain_ascii(text: Column) -> Column:
    """Characters beyond ASCII as ``?``: lengths stay, and word boundaries read alike everywhere."""
    return F.regexp_replace(text, r"[^\x00-\x7F]", "?")


def hits(text: Column, pattern: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(f"(?i){pattern}")), F.lit(0))


def _seen(text: Column) -> Column:
    """struct(lower, digit): what ``_hits_where`` looks at."""
    return F.struct(F.lower(text).alias("lower"), text.rlike("[0-9]").alias("digit"))


def _hits_where(text: Column, seen: Column, pattern: str, needs: list[list[str]]) -> Column:
    """``hits``, counted only in a text that has what the pattern needs."""
    has = lambda w: seen["digit"] if w == DIGIT else F.contains(seen["lower"], F.lit(w))
    groups = [reduce(lambda a, b: a | b, [has(w) for w in g]) for g in needs]
    return F.when(reduce(lambda a, b: a & b, groups), hits(text, pattern)).otherwise(0)


def _total(counts: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, counts)


def tokens(text: Column) -> Column:
    """Estimated tokens: a quarter of the characters, rounded up."""
    return F.coalesce(F.ceil(F.length(text) / 4), F.lit(0)).cast("long")


def chat_tokens(text: Column) -> Column:
    """Estimated tokens of a reply: words, punctuation and subject words; at least 1."""
    words = F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
    marks = F.length(text) - F.length(F.translate(text, ".,!?", ""))
    lower = F.lower(text)
    terms = _total([hits(lower, w) for w in ("mg/dl", "cholesterol", "glucose")])
    return F.greatest(F.floor(words * 0.75 + marks + terms * 0.5), F.lit(1)).cast("long")


def confidence(text: Column) -> Column:
    """Confidence that a text holds measurements, from weighted pattern hits per 100 characters and section headers."""
    def counted(seen: Column) -> Column:
        density = _total([_hits_where(text, seen, p, n) * w for (p, w), n in zip(SCORE_PATTERNS, SCORE_NEEDS)]) / (F.length(text) / 100)
        headers = _total([F.when(_hits_where(text, seen, h, n) > 0, 1).otherwise(0) for h, n in zip(SCORE_HEADERS, HEADER_NEEDS)])
        return F.struct(density.alias("d"), headers.alias("h"))

    def stepped(d: Column) -> Column:
        base = F.when(d > SCORE_STEPS[0][0], SCORE_STEPS[0][1])
        for least, value in SCORE_STEPS[1:]:
            base = base.when(d > least, value)
        return base.otherwise(0.2)

    score = bind(bind(_seen(text), counted), lambda s: F.when(s["h"] > 0, F.least(F.lit(0.99), stepped(s["d"]) + 0.15 * s["h"])).otherwise(stepped(s["d"])))
    return F.when(F.coalesce(F.length(text), F.lit(0)) < 10, 0.0).otherwise(score)


def relevance(text: Column, aliases: list[str]) -> Column:
    """10 for each alias, 1 for each number with unit, 5 for a table-like layout."""
    names = sorted({a for a in aliases if 2 < len(a) < 50})
    named = hits(text, rf"\b({'|'.join(_escape(a) for a in names)})\b") if names else F.lit(0)
    lines = F.split(F.trim(text), "\n")
    rows = F.size(F.filter(lines, lambda s: s.rlike(TABLE_LINE)))
    table = F.when((F.size(lines) > 3) & (rows > 2), 5).otherwise(0)
    return F.when(F.coalesce(text, F.lit("")) == "", 0).otherwise(10 * named + F.coalesce(F.regexp_count(text, F.lit(RELEVANT_UNITS)), F.lit(0)) + table)


def _escape(word: str) -> str:
    return "".join(c if c.isalnum() or c == " " else "\\" + c for c in word)


def screen(text: Column) -> Column:
    """What the quick screen finds, whatever has been kept before: struct(short, lab, patterns, admin, confidence)."""
    def counted(seen: Column) -> Column:
        lower = seen["lower"]
        return F.struct(
            _total([_hits_where(lower, seen, p, n) for p, n in zip(SCREEN_LAB, SCREEN_LAB_NEEDS)]).alias("lab"),
            _total([_hits_where(text, seen, p, n) * w for (p, w), n in zip(SCREEN_PATTERNS, SCREEN_NEEDS)]).alias("patterns"),
            _total([_hits_where(lower, seen, p, n) for p, n in zip(SCREEN_ADMIN, SCREEN_ADMIN_NEEDS)]).alias("admin"), F.length(text).alias("size"),
            (F.coalesce(F.length(F.trim(text)), F.lit(0)) < 20).alias("short"),
        )

    return bind(bind(_seen(text), counted), _screened)


def _screened(c: Column) -> Column:
    lab, patterns, admin, short = c["lab"], c["patterns"], c["admin"], c["short"]
    density = patterns / (c["size"] / 100)
    score = (
        F.when(short, 0.0).when(lab >= 1, F.least(F.lit(0.95), 0.7 + lab * 0.1)).when((admin >= 3) & (patterns == 0), 0.1)
        .when(density >= 2, 0.9).when(density >= 1, 0.8).when(density >= 0.5, 0.6).when(patterns >= 3, 0.7).when(patterns >= 1, 0.5)
        .when(admin >= 1, 0.2).otherwise(0.3)
    )
    return F.struct(
        short.alias("short"), lab.alias("lab"), F.when(lab >= 1, lab * 3).otherwise(patterns).alias("patterns"), admin.alias("admin"),
        F.round(score, 6).alias("confidence"),
    )


def accepts(s: Column, kept: int) -> Column:
    """Whether a screened text is processed once ``kept`` others are: thresholds rise with what has been kept."""
    threshold = max(v for n, v in SCREEN_LEVELS if n <= kept)
    c, lab, patterns, admin = s.getField("confidence"), s.getField("lab"), s.getField("patterns"), s.getField("admin")
    alone = (lab == 0) & (patterns == 0)
    refused = s.getField("short") | (alone & (admin >= 3))
    only_admin, nothing = alone & (admin.isin(1, 2)), alone & (admin == 0)
    passed = c >= threshold
    if kept >= 10:
        passed = passed & ~only_admin
    if kept >= 15:
        passed = passed & ~nothing
    if kept == 0:
        passed = passed | (c >= 0.2)
    return F.when(refused, False).when(lab >= 1, True).otherwise(passed)


def screen_reason(s: Column, kept: int) -> Column:
    """Why a screened text is processed or skipped once ``kept`` others are."""
    lab, patterns, admin, c = s.getField("lab"), s.getField("patterns"), s.getField("admin"), s.getField("confidence")
    threshold = max(v for n, v in SCREEN_LEVELS if n <= kept)
    by_density = F.when(c == 0.9, "high_biomarker_density").when(c == 0.8, "medium_biomarker_density").when(c == 0.6, "low_biomarker_density").when(
        c == 0.7, "multiple_biomarker_patterns").otherwise("some_biomarker_patterns")
    alone = F.when(admin >= 1, F.lit("administrative_content_with_sufficient_biomarkers" if kept >= 10 else "administrative_content_detected")).otherwise(
        F.lit("minimal_indicators_with_many_biomarkers" if kept >= 15 else "minimal_biomarker_indicators"))
    reason = F.when(c < threshold, f"below_threshold_{threshold}").when(patterns > 0, by_density).otherwise(alone)
    if kept == 0:
        reason = F.when(c >= 0.2, "safety_fallback_no_biomarkers_found").otherwise(reason)
    return (
        F.when(s.getField("short"), "empty_or_too_short").when(lab >= 1, F.concat(F.lit("lab_report_indicators_found_"), lab.cast("string")))
        .when((admin >= 3) & (patterns == 0), F.concat(F.lit("pure_administrative_content_matches_"), admin.cast("string"))).otherwise(reason)
    )


def indicates_measurements(text: Column) -> Column:
    """Whether a page has any sign of measurements: a value with unit, or a word that results come with."""
    return F.coalesce(reduce(lambda a, b: a | b, [text.rlike(f"(?i){p}") for p in INDICATORS]), F.lit(False))


def conservative_cleanup(text: Column) -> Column:
    """Page footers, notices, addresses and long rules out, white space reduced; paragraphs stay."""
    t = F.regexp_replace(text, r"\n\s*\n\s*\n+", "\n\n")
    for p in FOOTERS:
        t = F.regexp_replace(t, f"(?i){p}", "")
    t = F.regexp_replace(t, r"([_=\-])\1{10,}", "$1$1$1")
    t = F.regexp_replace(F.regexp_replace(t, r"\n\s*\n\s*\n+", "\n\n"), r"[ \t]+", " ")
    return F.coalesce(F.regexp_replace(t, r"^\s+|\s+$", ""), F.lit(""))


def compress_legacy(text: Column) -> Column:
    """White space, boilerplate, separators and number spellings reduced; the original where that saves no tokens."""
    t = F.regexp_replace(text, r"\s+", " ")
    for p in LEGACY_REMOVALS:
        t = F.regexp_replace(t, f"(?i){p}", "")
    for p, to in LEGACY_REPLACEMENTS:
        t = F.regexp_replace(t, p, to)
    t = F.trim(F.regexp_replace(t, r"\s+", " "))
    return bind(t, lambda s: F.when(F.coalesce(text, F.lit("")) == "", "").when(tokens(s) >= tokens(text), text).otherwise(s))


def _administrative(line: Column) -> Column:
    """Whether a line is about the report's handling, and holds nothing that looks like a measurement."""
    lower = F.lower(F.trim(line))
    return lower.rlike("|".join(f"(?:{p})" for p in ADMIN_LINES)) & ~lower.rlike("|".join(f"(?:{p})" for p in KEPT_LINES))


def compress_balanced(text: Column, line_aware: bool = False) -> Column:
    """Boilerplate out and white space collapsed; the original where that saves nothing, or more than 30 per cent.

    White space is collapsed before administrative lines are looked for, so a text is one line then, and goes as a whole or
    not at all (and as a whole is more than 30 per cent). ``line_aware`` keeps lines apart and drops each administrative one.
    """
    t = text
    for p in BALANCED_REMOVALS:
        t = F.regexp_replace(t, f"(?i){p}", "")
    if line_aware:
        lines = F.filter(F.split(t, "\n"), lambda s: (F.trim(s) != "") & ~_administrative(s))
        t = F.regexp_replace(F.array_join(lines, "\n"), r"[^\S\n]+", " ")
        t = F.regexp_replace(t, r"^\s+|\s+$", "")
    else:
        t = F.trim(F.regexp_replace(t, r"\s+", " "))
        t = bind(t, lambda s: F.when(_administrative(s), "").otherwise(s))
    spoiled = lambda s: (tokens(s) < tokens(text) * 0.7) | (tokens(s) >= tokens(text))
    return bind(t, lambda s: F.when(F.coalesce(text, F.lit("")) == "", "").when(spoiled(s), text).otherwise(s))


def lab_votes(text: Column) -> Column:
    """struct(lab, votes, confidence): the laboratory that most of its patterns name; the first of equals."""
    votes = F.array(*[
        F.struct(_total([(hits(text, p) > 0).cast("int") for p in ps]).alias("votes"), F.lit(-i).alias("place"), F.lit(lab).alias("lab"))
        for i, (lab, ps) in enumerate(LAB_NAMES)
    ])
    return bind(F.array_max(votes), lambda b: F.struct(
        F.when(b["votes"] > 0, b["lab"]).alias("lab"), b["votes"].alias("votes"),
        F.when(b["votes"] > 0, F.least(F.lit(0.95), 0.6 + b["votes"] * 0.1)).otherwise(0.0).alias("confidence")))


def shape_reply(text: Column, most: int = 800) -> Column:
    """A reply cut at the last end of a sentence in its first ``most`` characters, or with an ellipsis."""
    t = F.trim(text)
    for phrase in META_PHRASES:
        t = bind(t, lambda s, phrase=phrase: _without_meta(s, phrase))
    return bind(t, lambda s: _cut_reply(s, most))


def _without_meta(t: Column, phrase: str) -> Column:
    """A reply without its talk about itself, up to the first colon or period."""
    after = F.regexp_extract(t, r"^.[^:.]*[:.]([\s\S]*)$", 1)
    has = F.substring(t, F.lit(2), F.length(t)).rlike("[:.]")
    rest = F.when(has, after).otherwise(F.substring(t, F.lit(len(phrase) + 2), F.length(t)))
    return F.when(F.startswith(F.lower(t), F.lit(phrase.lower())), F.trim(rest)).otherwise(t)


def _cut_reply(t: Column, most: int) -> Column:
    bullets = F.when(t.contains("•") & ~t.contains("\n"), F.replace(t, F.lit("•"), F.lit("\n•"))).otherwise(t)
    end = F.lower(F.right(bullets, F.lit(200)))
    limit = F.when(end.rlike("|".join(IMPORTANT_ENDINGS)), F.least(F.length(bullets), F.lit(1000))).otherwise(most)
    cut = F.substring(bullets, F.lit(1), limit)
    last = F.length(F.regexp_extract(cut, r"^([\s\S]*[.!?])", 1))
    shaped = F.when(last - 1 > limit * 0.7, F.substring(cut, F.lit(1), last)).otherwise(F.concat(F.substring(cut, F.lit(1), limit - 3), F.lit("...")))
    return F.trim(F.when(F.length(bullets) > limit, shaped).otherwise(bullets))
