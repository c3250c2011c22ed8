"""Document operators against sequential models in plain Python, over whole texts with all their characters."""

import re

import pytest
from pyspark.sql import functions as F

from assaykit.functions import texts
from assaykit.operators import documents
from assaykit.plans import catalogue, lookups


def tokens(s):
    return -(-len(s) // 4)


def packed(parts, limit, glue, overlap=0):
    out, held = [], []
    for p in parts:
        if held and sum(map(tokens, held)) + tokens(p) > limit:
            out.append(glue.join(held))
            kept, size = [], 0
            for q in reversed(held) if overlap else []:
                if size + tokens(q) > overlap:
                    break
                kept.insert(0, q)
                size += tokens(q)
            held = kept
        held.append(p)
    return out + ([glue.join(held)] if held else [])


def model_chunks(text, limit, overlap):
    if tokens(text) <= limit:
        return [text]
    sections = re.split(documents.SECTION, text)
    if max(map(tokens, sections)) < limit * 0.8:
        return packed([s for s in sections if s.strip()], limit, "\n")
    out, run = [], []
    for p in [p for p in re.split(documents.PARAGRAPH, text) if p.strip()]:
        if tokens(p) > limit:
            out += packed(run, limit, "\n\n", overlap) + packed(re.split(documents.SENTENCE, p), limit, " ")
            run = []
        else:
            run.append(p)
    return out + packed(run, limit, "\n\n", overlap)


ODD = [
    "", "short", "\n\n".join(f"para {i} " + "x" * 40 for i in range(8)) + "\n\n" + "A long one. " * 20 + "\n\nlast\n\n \n\nvery last", "x" * 3000, "é ü ß. " * 300,
    "\nHEAD ONE:\n" + "a b c. " * 40 + "\nHEAD TWO:\n" + "d e f. " * 40 + "\n# X more\n" + "g. " * 90, "Big. " * 200 + "\n\n" + "Big! " * 200, "\n\n".join(["tiny"] * 700),
]


@pytest.mark.parametrize("limit, overlap", [(300, 40), (40, 13), (120, 0)])
def test_chunks_equal_a_sequential_model(spark, small, limit, overlap):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    docs = docs.union(spark.createDataFrame([(10_000 + i, t) for i, t in enumerate(ODD)], docs.schema)).repartition(4)
    got = docs.select("doc_id", "text", documents.chunk_text(F.col("text"), limit, overlap).alias("c")).collect()
    for r in got:
        assert r.c == model_chunks(r.text, limit, overlap), r.doc_id
    assert docs.limit(1).select(documents.chunk_text(F.lit(None).cast("string")).alias("c")).first().c == [None]


def test_guards_change_no_count(spark, small):
    """Confidence and screen of whole texts, with and without looking for words first; also with \u03bc, \u2013 and \u00a9."""
    said = ["Glucose 95 mg/dL (70\u201399) HIGH", "TSH 3 \u03bcIU/mL; 12 \u03bcg/dL low \u00a9 2020 Lab", "Clinical Chemistry\nlaboratory results page 1 of 2", "www.x.org 12345-6789 printed on 3", "RBC 5.1 mil/\u03bcL normal *",
            "a | 5 | b", "continued on next page, state of the city", None, "", "tiny"]
    docs = spark.read.parquet(f"{small}/documents.parquet").select("text").union(spark.createDataFrame([(t,) for t in said], "text string")).repartition(4)
    t = F.col("text")
    total = lambda ps: sum((texts.hits(t, p) * w for p, w in ps), F.lit(0))
    plain = lambda ps: sum((texts.hits(F.lower(t), p) for p in ps), F.lit(0))
    s = texts.screen(t)
    rows = docs.select(
        "text", texts.confidence(t).alias("c"), s.alias("s"), total(texts.SCORE_PATTERNS).alias("score"), total(texts.SCREEN_PATTERNS).alias("found"), plain(texts.SCREEN_LAB).alias("lab"),
        plain(texts.SCREEN_ADMIN).alias("admin"), sum((F.when(texts.hits(t, h) > 0, 1).otherwise(0) for h in texts.SCORE_HEADERS), F.lit(0)).alias("heads"),
    ).collect()
    for r in rows:
        if r.text is None:
            assert r.c == 0
            continue
        density = r.score / (len(r.text) / 100) if r.text else 0
        base = next((v for n, v in texts.SCORE_STEPS if density > n), 0.2)
        want = 0.0 if len(r.text) < 10 else min(0.99, base + 0.15 * r.heads) if r.heads else base
        assert abs(r.c - want) < 1e-9, r.text
        assert (r.s.lab, r.s.admin, r.s.patterns) == (r.lab, r.admin, r.lab * 3 if r.lab else r.found), r.text


def test_dense_chunks_equal_a_sequential_model(spark):
    from assaykit.operators import state

    many = ["Glucose 95 mg/dL (70-99) HDL 40 mg/dL high", "plain words", "w " * 300, "LDL: 100 mg/dL low, TSH: 2 mIU/L", "1-2 and 3-4", "Sodium 140 mmol/L (135-145)"]
    rows = [(0, ""), (1, None), (2, "\n\n".join(many)), (3, "\n\n".join(many * 3)), (4, "\n \n")]
    pages = spark.createDataFrame([(i, 1, t) for i, t in rows], "report long, page int, text string")
    scores = {p: c for p, c in spark.createDataFrame([(p,) for p in many], "p string").select("p", texts.confidence(F.col("p"))).collect()}
    got = {i: [] for i, _ in rows}
    for r in state.zone_chunks(pages, "report", "page", limit=25).orderBy("report", "ord").collect():
        got[r.report].append(r.text)
    for i, t in rows:
        parts = sorted([p for p in (t or "").split("\n\n") if p.strip()], key=lambda p: -scores[p])
        parts = [p for p in parts if scores[p] >= 0.3 or tokens(p) <= 100]
        sure, rest = [p for p in parts if scores[p] >= 0.7], [p for p in parts if scores[p] < 0.7]
        assert got[i] == packed(sure, 25, "\n\n") + packed(rest, 25, "\n\n"), i


def model_known(text):
    """All spellings, units and shapes one after the other; the first of equal measurements counts."""
    found = {}
    for name, spellings, units in documents.KNOWN_NAMES:
        for spelled in spellings:
            for unit, low, high in units:
                for shape in documents.SHAPES:
                    rx = "".join({"V": re.escape(spelled), "U": re.escape(unit), "N": r"(\d+(?:\.\d+)?)"}.get(x, x) for x in re.split("([VNU](?![a-z]))", shape))
                    for m in re.finditer(rx, text, re.IGNORECASE):
                        key = name, float(m[1]), unit
                        if key not in found:
                            near = text[max(0, m.start() - 100) : m.end() + 100]
                            hit = next((h for p in documents.NEAR_RANGES if (h := re.search(p, near, re.IGNORECASE))), None)
                            a, b = (float(hit[1]), float(hit[2])) if hit else (low, high)
                            found[key] = a, b, key[1] < a or key[1] > b
    return {(*k, *v) for k, v in found.items()}


LABS = [
    "Glucose: 105 mg/dL (70-99)", "Fasting Glucose (serum): 5.2 mmol/L [3.9 - 5.5]", "105 mg/dL Glucose", "Hemoglobin (Hb)   15.2   g/dL   13.0-17.0\nHCT 45 % then 46%x and HCT 47%.",
    "HDL Cholesterol 55 mg/dL\nLDL 110 mg/dL ref range: 0-100\n" + "z" * 150 + "\nTriglycerides 95 mg/dL normal: 10 \u2013 150", "Creatinine: 80 \u03bcmol/L, creat 0.9 mg/dL; CR 0.9 mg/dL (0.6-1.2)",
    "glucose 95 mg/dL " + "y" * 300 + " glucose 95 mg/dL (1-2)", "no names 5 mg/dL", "Glucose pending", None, "", "mg/dL glucose 7", "Total Cholesterol (fasting) : 210 mg/dL high", "hct% 45 %",
]


def test_known_measurements_equal_a_sequential_model(spark):
    docs = spark.createDataFrame([*enumerate(LABS)], "id long, text string").repartition(3)
    got = {i: set() for i in range(len(LABS))}
    for r in documents.known_measurements(docs, "id").collect():
        got[r.id].add((r.name, r.value, r.unit, r.low, r.high, r.is_abnormal))
    for i, t in enumerate(LABS):
        assert got[i] == model_known(t or ""), t


def model_loose(text):
    seen, out = set(), []
    for form, score, groups in ((documents.LOOSE, 0.7, 4), (documents.LOOSER, 0.5, 3)):
        if groups == 3 and len(out) >= documents.FEW:
            break
        for m in re.finditer(form, text):
            name, value = m[1].strip(), m[2]
            key = name.lower()
            bad = any(w in key for w in documents.NOT_NAMES)
            if groups == 4:
                bad = bad or re.search(rf"\b(?:{'|'.join(documents.NOT_WORDS)})\b", key) or re.search(r"\b\d{6}\b", name) or len(name.split()) > 6 or name.endswith(("NO", "LTD"))
                bad = bad or len(re.findall(r"\d", name)) > len(name) / 2 or (name.isupper() and len(name) > 10) or len(re.sub(r"\D", "", value)) > 6
            if bad or key in seen or not 2 <= len(name) <= 40:
                continue
            seen.add(key)
            if re.search(documents.METHOD, name):
                name = name.split(")")[0].strip() + ")"
            out.append((name, float(value), m[3], score))
    return sorted(out)


FREE = [
    "Lipid Panel:\nTotal Cholesterol: 185 mg/dL (125-200)\nTriglycerides: 95 mg/dL (<150)\nGlucose: 92 mg/dL (70-99)\nCalcium: 9.5 mg/dL (8-10)", "Glucose 95 mg/dL\nGLUCOSE 96 mg/dL\nSodium 140 mmol/L; Urea 5 mmol/L (2-7)",
    "Urea (serum) Foo Kinetic 12 mg/dL", "ABCDEFGHIJKLM: 5 mg/dL", "Zinc 12345678 mg/L", "a b c d e f g: 5 mg/L", None, "", "Cobalt: 5 ug/L Zinc: 6 ug/L Copper: 7 ug/L Lead: 8 ug/L Boron: 9 ug/L Neon 5 ug/L",
]


def test_loose_measurements_equal_a_sequential_model(spark):
    docs = spark.createDataFrame([*enumerate(FREE)], "id long, text string")
    got = {i: [] for i in range(len(FREE))}
    for r in documents.loose_measurements(docs, "id").collect():
        got[r.id].append((r.name, r.value, r.original_unit, r.confidence))
    for i, t in enumerate(FREE):
        assert sorted(got[i]) == model_loose(t or ""), t
    glucose = next(r for r in documents.loose_measurements(docs, "id").where("id = 0 and name = 'Glucose'").collect())
    assert (glucose.low, glucose.high, glucose.unit) == (70, 99, "mg/dL")


def test_modes_keep_what_they_should(spark):
    rows = [(1, 1, "Glucose 95 mg/dL (70-99)\n\nHDL 40 mg/dL (30-60)"), (1, 2, "plain words only " * 20), (1, 3, "tiny page"), (1, 4, "  \n"), (2, 1, None), (2, 2, "words of no use. " * 60)]
    pages = spark.createDataFrame(rows, "report long, page int, text string")
    kept = lambda mode, **k: sorted((r.report, r.page, r.region) for r in documents.mode_chunks(pages, "report", "page", mode, **k).collect())
    assert kept("accuracy") == [(1, 1, "accuracy_optimized_page")]
    assert kept("balanced") == [(1, 1, "balanced_optimized_page"), (1, 2, "balanced_optimized_page_fallback"), (2, 2, "balanced_optimized_page_fallback")]
    assert [k[:2] for k in kept("legacy")] == [(1, 1), (1, 2), (1, 3), (2, 2)]
    assert kept("balanced", limit=100)[2:] == [] or kept("balanced", limit=100)[-1][2] != "balanced_optimized_chunk"


def test_shapes_of_new_names(spark):
    found = documents.known_measurements(spark.createDataFrame([(1, "Zinc+ (x): 12 u+L")], "id long, text string"), "id", patterns=[("Zinc", ["zinc+"], "u+L", 1.0, 9.0)])
    assert [tuple(r) for r in found.collect()] == [(1, "Zinc", 12.0, "u+L", 1.0, 9.0, True)]


@pytest.mark.parametrize("text, low, high", [("Less than 5", None, 5), ("Greater than 3", 3, None), ("less THAN 5.5", None, 5.5), ("1,000 – 2,000", 1000, 2000)])
def test_display_words(spark, text, low, high):
    from assaykit.functions import values

    r = spark.createDataFrame([(text,)], "x string").select(values.display_range(F.col("x")).alias("y")).first().y
    assert (r.low, r.high) == (low, high)


@pytest.mark.parametrize("text, low, high", [("<= 5", None, 5), (">=5", 5, None), ("> = 2.5", 2.5, None), ("5", None, None)])
def test_strict_signs(spark, text, low, high):
    from assaykit.functions import values

    r = spark.createDataFrame([(text,)], "x string").select(values.strict_range(F.col("x")).alias("y")).first().y
    assert (r.low, r.high) == (low, high)


def test_more_queries_are_registered():
    own = [n for n, f in catalogue.QUERIES.items() if f.__module__ == lookups.__name__]
    assert len(own) > 30 and set(own) - set(catalogue.SQL) == {"mode_chunks"}


def test_texts_are_screened_once(spark, capsys):
    """What is kept is worked out from written screens, not from the texts again."""
    rows = spark.createDataFrame([(1, k, "Glucose: 90 mg/dL (70-99) and more words" if k % 2 else "Page 1 of 2, no such thing here") for k in range(8)], "report int, ord int, text string")
    out = documents.skip_chunks(rows, "report", ["ord"])
    out.explain()
    plan = capsys.readouterr().out.lower()
    assert "regexp" not in plan and "rlike" not in plan
    assert [r.kept for r in out.orderBy("ord").collect()] and out.columns == ["report", "ord", "text", "screen_confidence", "screen_patterns", "kept"]


def test_mode_chunks_shuffle_no_texts(spark, capsys):
    """Whether a page has one chunk is known from the page."""
    rows = spark.createDataFrame([(1, 1, "word " * 300), (1, 2, "few words"), (2, 1, " \n"), (2, 2, None), (3, 1, "a b c. " * 20)], "report int, page int, text string")
    out = documents.mode_chunks(rows, "report", "page", "balanced", limit=100)
    out.explain()
    assert "Exchange" not in capsys.readouterr().out
    assert {(1, 1)} <= {(r.report, r.page) for r in out.collect()} <= {(1, 1), (1, 2), (3, 1)}
