"""Names in texts by one automaton, against scanning for each of them."""

import random
import re

import pytest
from test_documents import LABS, model_known

from assaykit.operators import documents, relational, spotting

WORDS = ["a", "ab", "aba", "bab", "glucose", "glu", "GLU", "İx", "ß", "x y", "\n", "日本", "", None]


def texts(n=120):
    rng = random.Random(9)
    rows = [(i, i % 7, "".join(rng.choice(["a", "b", "A", "glucose", " ", "x", "y", "İ", "ß", "日", "本", "\n"]) for _ in range(rng.randint(0, 60)))) for i in range(n)]
    return [*rows, (500, 1, None), (501, 1, ""), (3, 3, rows[3][2]), (502, 2, "ab" * 50_000)]


@pytest.mark.parametrize("most", [1 << 20, 0])  # the automaton, and the join for more names than fit it
def test_mentions_equal_a_scan(spark, most):
    rows = texts()
    frame = spark.createDataFrame(rows, "id long, turn int, text string").repartition(3)
    names = spark.createDataFrame([(w,) for w in WORDS], "word string")
    lower = dict(zip(names.collect(), names.selectExpr("lower(word) l").collect(), strict=True))
    want = sorted({(i, w.word) for i, _, t in rows for w, low in lower.items() if t and w.word and low.l in t.lower()})
    found = relational.mentioned(frame, names, ["id", "turn"], name="word", most_bytes=most).collect()
    assert sorted({(r.id, r.name) for r in found}) == want and {"GLU", "glu", "İx"} <= {n for _, n in want}
    assert sum(r.id == 3 for r in found) == 2 * len({n for i, n in want if i == 3})  # a repeated row is repeated
    assert relational.mentioned(frame, names.limit(0), ["id"], name="word").isEmpty() and relational.mentioned(frame.limit(0), names, ["id"], name="word").isEmpty()


def test_places_overlap_and_keep_their_order():
    machine = spotting.automaton(["aba", "ab", "b"])
    assert spotting.places(machine, "ababa") == {"ab": [0, 2], "aba": [0, 2], "b": [1, 3]}
    assert spotting.places(spotting.automaton([]), "abc") == {}
    assert spotting.folded("İSTANBUL ſ µ") == "İstanbul s μ" and len(spotting.folded("İß")) == 2


def pieces(rng):
    name, units = rng.choice([(["Glucose", "glu", "xglux"], ["mg/dL", "MG/DL", "mmol/L"]), (["HDL-C", "hdl chol"], ["mg/dl", "mmol/L"]), (["Hb", "hgb"], ["g/dl", "g/L"]),
                              (["hct%", "pcv"], ["%", "ratio", "percent"]), (["CR", "creat"], ["mg/dL", "µmol/L", "umol/L", "%"])])
    name, unit, value = rng.choice(name), rng.choice(units), rng.choice(["5", "12.5", "1.2.5", "007", "99", ".5", "-3"])
    gap = lambda: rng.choice(["", " ", "  ", "\t", "\n", ":", " : ", " (x) ", "(", ")", "(Hb)", ", ", "\xa0"])
    order = rng.choice([[name, value, unit], [value, unit, name], [name, value, unit, "(70-99)"], [name, unit, value], [name, name, value, unit]])
    return "".join(x + gap() for x in order) + rng.choice(["", "\n", " ref: 1 - 9 ", " [3–4]", " normal range: 2-8", "z" * 120])


def test_measurements_equal_a_sequential_model_on_random_texts(spark):
    rng = random.Random(7)
    rows = [(i, "".join(pieces(rng) for _ in range(rng.randint(1, 6)))) for i in range(400)] + [(1000 + i, t) for i, t in enumerate(LABS)]
    found = {}
    for r in documents.known_measurements(spark.createDataFrame(rows, "id long, text string").repartition(4), "id").collect():
        found.setdefault(r.id, set()).add((r.name, r.value, r.unit, r.low, r.high, r.is_abnormal))
    for i, t in rows:
        assert found.get(i, set()) == model_known(t or ""), t
    assert sum(map(len, found.values())) > 500


def test_no_text_leaves_the_row_twice(spark):
    frame = spark.createDataFrame([(1, "Glucose 95 mg/dL")], "id long, text string")
    plan = documents.known_measurements(frame, "id")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Generate" not in plan and len(re.findall("MapInArrow", plan)) == 1
