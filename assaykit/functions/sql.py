"""The library's functions for SQL text: ``register`` adds them to a session as temporary functions.

Scalar functions are SQL expressions, so no Python runs for them:

* ``lab_range(text)``: struct(low, high) of a range text;
* ``lab_flag(flag, value, low, high)``: whether a measurement is abnormal, by its flag, else by its range;
* ``lab_confidence(text)``: confidence that a text holds measurements.

Table functions run in Python, for ``LATERAL`` and for ``TABLE (...) PARTITION BY ...``:

* ``chunk_text(text, most, overlap)``: (ord, chunk, estimated_tokens);
* ``loose_measurements(text)``: (name, value, unit, reference_range, confidence) of each text by itself;
* ``report_measurements(TABLE (SELECT report, page, text ...) PARTITION BY report ORDER BY page)``: the same with the report, each name
  once for all pages of a report.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf

from . import texts


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _bound(value: str, name: str, use: str) -> str:
    """``use``, an expression in ``name``, with ``value`` evaluated once."""
    return f"element_at(transform(array({value}), {name} -> {use}), 1)"


def range_sql(text: str) -> str:
    """The expression of ``lab_range``."""
    num = "([0-9]+\\.?[0-9]*)"
    pair = lambda a, b: f"named_struct('low', {a}, 'high', {b})"
    at = lambda k: f"try_cast(try_element_at(found, {k}) AS double)"
    side = lambda signs: f"regexp_extract(t, {_quoted(f'[{signs}]' + r'\s*' + num)}, 1)"
    part = lambda k: f"try_cast(trim(try_element_at(split(t, '-'), {k})) AS double)"
    none = "CAST(NULL AS double)"
    lone = f"""CASE WHEN size(found) = 1 AND rlike(lower(t), '>|greater than|above|over') AND NOT rlike(lower(t), '<|less than|under|below') THEN {pair(at(1), none)}
      WHEN size(found) = 1 THEN {pair(none, at(1))} WHEN size(found) = 2 THEN {pair(at(1), at(2))} ELSE {pair(none, none)} END"""
    whole = f"""CASE WHEN t IS NULL OR t = '' THEN {pair(none, none)}
     WHEN NOT rlike(t, '[<>]') AND contains(t, '-') AND {part(1)} IS NOT NULL AND {part(2)} IS NOT NULL THEN {pair(part(1), part(2))}
     WHEN {side('<≤')} <> '' THEN {pair(none, f"try_cast({side('<≤')} AS double)")} WHEN {side('>≥')} <> '' THEN {pair(f"try_cast({side('>≥')} AS double)", none)}
     ELSE {_bound(f"regexp_extract_all(t, {_quoted(num)}, 1)", 'found', lone)} END"""
    return _bound(f"trim({text})", "t", whole)


def flag_sql(flag: str, value: str, low: str, high: str) -> str:
    """The expression of ``lab_flag``."""
    return f"""CASE WHEN coalesce(trim({flag}), '') <> '' THEN upper(trim({flag})) IN ('H', 'L', 'A', 'HIGH', 'LOW', 'ABNORMAL', 'TRUE')
 ELSE coalesce({value} < {low}, false) OR coalesce({value} > {high}, false) END"""


def confidence_sql(text: str) -> str:
    """The expression of ``lab_confidence``: a pattern is counted in texts only that have a word it needs."""
    has = lambda w: f"rlike(t, '[0-9]')" if w == texts.DIGIT else f"contains(lower(t), {_quoted(w)})"  # noqa: E731, F541
    guard = lambda needs: " AND ".join("(" + " OR ".join(has(w) for w in g) + ")" for g in needs)
    count = lambda p, needs: f"CASE WHEN {guard(needs)} THEN regexp_count(t, {_quoted('(?i)' + p)}) ELSE 0 END"
    density = " + ".join(f"({count(p, n)}) * {w}D" for (p, w), n in zip(texts.SCORE_PATTERNS, texts.SCORE_NEEDS, strict=True))
    headers = " + ".join(f"CASE WHEN {count(p, n)} > 0 THEN 1 ELSE 0 END" for p, n in zip(texts.SCORE_HEADERS, texts.HEADER_NEEDS, strict=True))
    steps = "CASE " + " ".join(f"WHEN s.d > {least}D THEN {value}D" for least, value in texts.SCORE_STEPS) + " ELSE 0.2D END"
    score = _bound(f"named_struct('d', ({density}) / (length(t) / 100), 'h', {headers})", "s", f"CASE WHEN s.h > 0 THEN least(0.99D, {steps} + 0.15D * s.h) ELSE {steps} END")
    return f"CASE WHEN coalesce(length({text}), 0) < 10 THEN 0D ELSE {_bound(text, 't', score)} END"


SCALARS = {
    "lab_range": ("text string", "struct<low: double, high: double>", range_sql("text")),
    "lab_flag": ("flag string, value double, low double, high double", "boolean", flag_sql("flag", "value", "low", "high")),
    "lab_confidence": ("text string", "double", confidence_sql("text")),
}


# table functions ---------------------------------------------------------------------------------------------------------


def _tokens(text: str) -> int:
    return -(-len(text) // 4)


def _packed(parts: list[str], most: int, glue: str, overlap: int = 0) -> Iterator[str]:
    """Texts in order, as many together as fit; what fits the overlap is said again."""
    held: list[str] = []
    size = 0
    for p in parts:
        n = _tokens(p)
        if held and size + n > most:
            yield glue.join(held)
            first, size = len(held), 0
            while overlap and first and size + _tokens(held[first - 1]) <= overlap:
                first -= 1
                size += _tokens(held[first])
            held = held[first:]
        held.append(p)
        size += n
    if held:
        yield glue.join(held)


def chunks_of(text: str, most: int, overlap: int) -> Iterator[str]:
    """A text's chunks, as ``documents.chunk_text`` has them."""
    from ..operators.documents import PARAGRAPH, SECTION, SENTENCE

    if _tokens(text) <= most:
        yield text
        return
    sections = re.split(SECTION, text)
    if max(map(_tokens, sections)) < most * 0.8:
        yield from _packed([s for s in sections if s.strip()], most, "\n")
        return
    run: list[str] = []
    for p in re.split(PARAGRAPH, text):
        if not p.strip():
            continue
        if _tokens(p) > most:
            yield from _packed(run, most, "\n\n", overlap)
            yield from _packed(re.split(SENTENCE, p), most, " ")
            run = []
        else:
            run.append(p)
    yield from _packed(run, most, "\n\n", overlap)


@udtf(returnType="ord int, chunk string, estimated_tokens int", useArrow=False)
class ChunkText:
    """A null text has one chunk, a null one."""

    def eval(self, text: str, most: int, overlap: int):
        if text is None:
            yield 0, None, 0
            return
        for k, chunk in enumerate(chunks_of(text, most, overlap)):
            yield k, chunk, _tokens(chunk)


class Loose:
    """The fallback parser over one text after the other, as one document: each name once, and the looser form where few were found."""

    def __init__(self):
        from ..operators import documents

        self.d, self.found, self.seen, self.later = documents, [], set(), []

    def _refused(self, name: str, value: str) -> bool:
        d, low = self.d, name.lower()
        digits = sum("0" <= c <= "9" for c in name)
        return bool(
            any(w in low for w in d.NOT_NAMES) or re.search(rf"\b(?:{'|'.join(d.NOT_WORDS)})\b", low) or re.search(r"\b[0-9]{6}\b", name)
            or len(name.split()) > 6 or name.endswith(("NO", "LTD")) or digits > len(name) / 2
            or (name.upper() == name and name.lower() != name and len(name) > 10) or sum("0" <= c <= "9" for c in value) > 6
        )

    def read(self, text: str | None) -> None:
        for m in re.finditer(self.d.LOOSE, text or "", re.ASCII):
            name = m[1].strip()
            if 2 <= len(name) <= 40 and name.lower() not in self.seen and not self._refused(name, m[2]):
                self._take(name, m[2], m[3], m[4] or None, 0.7)
        for m in re.finditer(self.d.LOOSER, text or "", re.ASCII):
            if 2 <= len(m[1].strip()) <= 40 and not any(w in m[1].strip().lower() for w in self.d.NOT_NAMES):
                self.later.append((m[1].strip(), m[2], m[3]))

    def _take(self, name: str, value: str, unit: str, range_: str | None, confidence: float) -> None:
        self.seen.add(name.lower())
        shown = f"{name.split(')')[0].strip()})" if re.search(self.d.METHOD, name) else name
        self.found.append((shown, float(value), unit, range_, confidence))

    def all(self) -> list[tuple]:
        if len(self.found) < self.d.FEW:
            for name, value, unit in self.later:
                if name.lower() not in self.seen:
                    self._take(name, value, unit, None, 0.5)
        return self.found


_FOUND = "name string, value double, unit string, reference_range string, confidence double"


@udtf(returnType=_FOUND, useArrow=False)
class LooseMeasurements:
    """A null text has none."""

    def eval(self, text: str):
        one = Loose()
        one.read(text)
        yield from one.all()


@udtf(returnType=f"report string, {_FOUND}", useArrow=False)
class ReportMeasurements:
    """Pages of a report come in order, a report at a time; what is kept of them is what was found."""

    def __init__(self):
        self.report, self.pages = None, Loose()

    def eval(self, page: Row):
        self.report = page["report"]
        self.pages.read(page["text"])

    def terminate(self):
        for row in self.pages.all():
            yield None if self.report is None else str(self.report), *row


def register(spark: SparkSession) -> None:
    """Add all functions to a session, or put them in the place of older ones."""
    for name, (parameters, kind, body) in SCALARS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
    for name, function in (("chunk_text", ChunkText), ("loose_measurements", LooseMeasurements), ("report_measurements", ReportMeasurements)):
        spark.udtf.register(name, function)
