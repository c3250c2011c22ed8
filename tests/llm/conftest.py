import random

import pytest

KIND = "doc_id long, text string, lang string, source string, n_chars long, score string, contamination string, quality_evidence int, line_dedup int, n string, v long"


def words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def corpus():
    """Nulls, empty and very long texts, exact and near copies, repeated rows, a null doc_id, other scripts."""
    rng = random.Random(5)
    texts = {}
    for i in range(40):
        lines = [" ".join(words(rng, rng.randint(3, 40))) for _ in range(rng.randint(1, 8))]
        texts[i] = "\n".join(lines).capitalize() + "."
    base = " ".join(words(rng, 120, 5000))
    for i in range(40, 60):  # a family of near copies, of copies
        w = base.split()
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(99999)}"
        texts[i] = " ".join(w)
        if rng.random() < 0.5:
            base = texts[i]
    passage = "\n".join(" ".join(words(rng, 30, 900)) for _ in range(3))
    for i in range(60, 70):
        texts[i] = f"{' '.join(words(rng, 12))}\n{passage}\n\n{' '.join(words(rng, 9))}"
    texts |= {70: None, 71: "", 72: " \n\t ", 73: "one", 74: "one two", 75: texts[3], 76: texts[3], 77: "Ünï ß İ 日本語 テスト €", 78: "a\x00b\x1cc <|endoftext|>",
              79: " ".join(words(rng, 40_000, 30_000)), 80: "x" * 100_000, 81: "Released under the MIT License.", 82: "CC BY\ncc  by cc by"}
    rows = [(i, t, ("en", "de", None)[i % 3], f"s{i % 4}" if i % 11 else None) for i, t in texts.items()]
    rows += [(5, texts[5], "en", "s1"), (None, texts[7], "en", "s1")]
    return [(*r, len(r[1] or ""), "s", "c", 1, 2, "n", 3) for r in rows]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(corpus(), KIND).repartition(3)


@pytest.fixture(scope="session")
def plain_rows():
    return [(r[0], r[1]) for r in corpus()]


@pytest.fixture(scope="session")
def none(docs):
    return docs.limit(0)
