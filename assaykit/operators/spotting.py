"""Many names in many texts at once: one automaton over all spellings, one pass over each text."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.batches import over_batches

#: Characters that ignoring case makes equal, though lower case keeps them apart.
_ALIKE = str.maketrans("ſµς", "sμσ")


def folded(text: str) -> str:
    """Lower case, character by character, so that places stay what they are."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    return low.translate(_ALIKE)


def automaton(words: Iterable[str]) -> ahocorasick.Automaton:
    """A machine that finds all places of all ``words``; a hit has the word itself as its value."""
    found = ahocorasick.Automaton()
    for w in words:
        found.add_word(w, w)
    found.make_automaton()
    return found


def places(machine: ahocorasick.Automaton, text: str) -> dict[str, list[int]]:
    """word -> where it begins, in order, overlapping hits included."""
    found: dict[str, list[int]] = {}
    for end, word in machine.iter(text) if len(machine) else ():
        found.setdefault(word, []).append(end + 1 - len(word))
    return found


def spotted(texts: DataFrame, names: list[str], key: list[str], text: str = "text") -> DataFrame:
    """(key, name) of the ``names`` that a text contains, each once: a name is a run of characters, equal as it stands.

    Names go out once, and a text goes through their automaton in one pass, however many they are. Null and empty texts and
    names meet nothing; repeated rows are repeated.
    """
    held = texts.sparkSession.sparkContext.broadcast([n for n in dict.fromkeys(names) if n])
    kinds = ", ".join(f"`{c}` {texts.schema[c].dataType.simpleString()}" for c in key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton(held.value)
        for b in batches:
            rows, found = [], []
            for i, t in enumerate(b.column(len(key)).to_pylist()):
                hits = {word for _, word in machine.iter(t)} if t and len(machine) else ()
                rows += [i] * len(hits)
                found += hits
            at = pa.array(rows, pa.int32())
            yield pa.RecordBatch.from_arrays([*(b.column(k).take(at) for k in range(len(key))), pa.array(found, pa.string())], [*key, "name"])

    return over_batches(texts.select(*key, text), run, f"{kinds}, name string")


def _expression(shape: str, spelling: str, unit: str) -> str:
    """The expression of a shape for a spelling (V) and a unit (U), both taken literally; N is a number."""
    pieces = {"V": re.escape(spelling), "U": re.escape(unit), "N": r"(\d+(?:\.\d+)?)"}
    return "".join(pieces.get(x, x) for x in re.split("([VNU](?![a-z]))", shape))


class Measurements:
    """Finds values of known names: spellings by the automaton, shapes by expressions that are tried where a spelling is, and nowhere else."""

    def __init__(self, patterns: list[tuple], shapes: list[str], ranges: list[str], near: int):
        self.of: dict[str, list[tuple]] = {}  # folded spelling -> its patterns
        for place, (name, spellings, unit, low, high) in enumerate(patterns):
            for i, s in enumerate(spellings):
                self.of.setdefault(folded(s), []).append((i, place, s, name, unit, folded(unit), low, high))
        self.machine = automaton(self.of)
        self.shapes, self.near, self.known = shapes, near, {}
        self.ranges = [re.compile(r, re.IGNORECASE) for r in ranges]

    def _compiled(self, shape: str, spelling: str, unit: str) -> re.Pattern:
        at = (shape, spelling, unit)
        if at not in self.known:
            self.known[at] = re.compile(_expression(*at), re.IGNORECASE)
        return self.known[at]

    @staticmethod
    def _from_name(rx: re.Pattern, text: str, starts: list[int]) -> Iterator[re.Match]:
        """Matches that begin with the spelling: in order, none within another."""
        end = 0
        for at in starts:
            if at >= end and (m := rx.match(text, at)):
                yield m
                end = m.end()

    @staticmethod
    def _to_name(rx: re.Pattern, text: str, low: str, starts: list[int], unit: str) -> Iterator[re.Match]:
        """Matches of number, unit and spelling in this order: from a spelling back over the unit to where the number may begin."""
        end = 0
        for at in starts:
            s = at
            while s and text[s - 1].isspace():
                s -= 1
            s -= len(unit)
            if s < 0 or not low.startswith(unit, s):
                continue
            while s and text[s - 1].isspace():
                s -= 1
            first = s
            while first and (text[first - 1].isdigit() or text[first - 1] == "."):
                first -= 1
            m = rx.search(text, max(first, end)) if first < s else None
            if m and m.start() < s:
                yield m
                end = m.end()

    def __call__(self, text: str | None) -> list[tuple]:
        """(name, value, unit, low, high): each name, value and unit once; of equal ones the first by spelling, unit, shape and place."""
        if not text or not any(c.isdigit() for c in text):
            return []
        low, best = folded(text), {}
        for word, starts in places(self.machine, low).items():
            for i, place, spelling, name, unit, unit_low, least, most in self.of[word]:
                if unit_low not in low:
                    continue
                for k, shape in enumerate(self.shapes):
                    rx = self._compiled(shape, spelling, unit)
                    found = self._from_name(rx, text, starts) if shape.startswith(r"\bV") else self._to_name(rx, text, low, starts, unit_low)
                    for m in found:
                        key, order = (name, float(m[1]), unit), (i, place, k, m.start())
                        if key not in best or order < best[key][0]:
                            best[key] = order, m.end(), least, most
        return [(*key, *self._range(text, order[3], end, least, most)) for key, (order, end, least, most) in best.items()]

    def _range(self, text: str, start: int, end: int, least: float, most: float) -> tuple[float, float]:
        """The first kind of range that the neighbourhood has, else the typical one."""
        around = text[max(0, start - self.near) : end + self.near]
        for rx in self.ranges:
            if m := rx.search(around):
                return float(m[1]), float(m[2])
        return least, most


def measured(docs: DataFrame, key: str, text: str, patterns: list[tuple], shapes: list[str], ranges: list[str], near: int) -> DataFrame:
    """(key, name, value, unit, low, high) of what ``Measurements`` finds in each text, within the row."""
    held = docs.sparkSession.sparkContext.broadcast((patterns, shapes, ranges, near))
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = Measurements(*held.value)
        for b in batches:
            found = [(i, *row) for i, t in enumerate(b.column(1).to_pylist()) for row in find(t)]
            columns = list(zip(*found, strict=True)) or [()] * 6
            kinds = [pa.string(), pa.float64(), pa.string(), pa.float64(), pa.float64()]
            values = [pa.array(c, k) for c, k in zip(columns[1:], kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(columns[0], pa.int32())), *values], [key, "name", "value", "unit", "low", "high"])

    # texts without a digit have no value: they needn't leave the JVM
    asked = docs.select(key, F.col(text).alias("__t")).where(F.col("__t").rlike(r"(?U)\d"))
    return over_batches(asked, run, f"`{key}` {kind}, name string, value double, unit string, low double, high double")
