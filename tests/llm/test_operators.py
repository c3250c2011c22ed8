"""Each operator against brute force on a corpus of awkward documents."""

import collections
import dataclasses
import hashlib
import math
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from assaykit.llm import components, decontam, fingerprints, jaccard, licenses, linededup, lm, packing, quality, tokens, tokenstore, urlfilter

ALNUM, BLANK = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), re.compile("[^\x20\x09-\x0D]+")
BYTES, WORDS = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))


def low(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s or "")


def ids_of(path, text, end):
    t = Tokenizer.from_file(path)
    return [*t.encode(text or "", add_special_tokens=False).ids, end]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def by_row(rows, *names):
    return sorted((tuple(str(r[n]) for n in names) for r in rows))


# quality -------------------------------------------------------------------------------------------------------------


def test_quality_separates_and_shrinks(spark, docs, small):
    d, labels = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet")
    found = quality.classify(d, labels).join(labels, "doc_id").select("quality", F.col("quality_evidence.keep").alias("keep")).collect()
    assert sum(r.keep == (r.quality == 1) for r in found) / len(found) > 0.97
    held_out = quality.classify(d, labels.where("doc_id % 2 = 0")).join(labels.where("doc_id % 2 = 1"), "doc_id").select("quality", "quality_evidence.keep").collect()
    assert sum(r.keep == (r.quality == 1) for r in held_out) / len(held_out) > 0.9


def test_quality_posteriors_are_shrunk_sums(spark):
    rows = [("a", "x", 3.0)] * 50 + [("a", "y", 3.0)] + [("b", "x", -3.0)] * 40 + [(None, None, -3.0)]
    e = spark.createDataFrame(rows, "h string, p string, __logit double")
    sites, prior = quality.site_posteriors(e, "h", "p")
    got = {(r.host, r.path): r for r in sites.collect()}
    assert math.isclose(prior, sum(1 / (1 + math.exp(-r[2])) for r in rows) / len(rows), rel_tol=1e-9)
    assert got["a", "y"].path_posterior > prior > got["b", "x"].path_posterior
    assert abs(got["a", "y"].path_posterior - got["a", "y"].host_posterior) < 1e-3
    assert got[None, None].host_posterior > got["b", "x"].host_posterior  # one document says less than forty


def test_quality_score_equals_brute_force(spark):
    """Scores from logits, posteriors by site and host without the document itself, and the prior, worked out in plain Python by the
    method of moments."""
    rng = np.random.default_rng(3)
    model = quality.QualityModel((0.0,) * 12, (1.0,) * 12, (3.0, 0.0, 0.0, 0.0, 0.0, 0.0, -4.0, *([0.0] * 18)))
    rows = []
    for i in range(400):
        host, path = ("a", "b", "c", None)[i % 4], ("x", "y", None)[i % 3] if i % 50 else "rare"
        noise = "#%" * 9 if rng.random() < {"a": 0.7, "b": 0.3, "c": 0.05, None: 0.5}[host] + 0.2 * (path == "x") else ""
        rows.append((i, " ".join(["word"] + ["Other Words"] * int(rng.integers(0, 4)) + [noise]), host, path))
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").repartition(3)
    got = {r.doc_id: r for r in quality.classify(docs, None, model=model).select("doc_id", "quality_evidence.*").collect()}
    logit = {i: float(model.logits(np.array([quality.features(t.encode())]))[0]) for i, t, _, _ in rows}
    p = {i: 1 / (1 + math.exp(-x)) for i, x in logit.items()}

    def grouped(key):
        out = collections.defaultdict(list)
        for r in rows:
            out[key(r)].append(p[r[0]])
        return {k: (len(v), sum(v)) for k, v in out.items()}

    def strength(sites, prior_of):
        n = sum(k for k, _ in sites.values())
        noise = sum(k * prior_of(s) * (1 - prior_of(s)) for s, (k, _) in sites.items()) / n
        between = sum(k * (g / k - prior_of(s)) ** 2 for s, (k, g) in sites.items())
        spread = (between - (len(sites) - 1) * noise) / (n - sum(k * k for k, _ in sites.values()) / n)
        return 1e6 if spread <= 0 else min(1e6, max(1.0, noise / spread - 1))

    hosts, paths, prior = grouped(lambda r: r[2]), grouped(lambda r: (r[2], r[3])), sum(p.values()) / len(p)
    kh = strength(hosts, lambda s: prior)
    all_host = {h: (g + kh * prior) / (n + kh) for h, (n, g) in hosts.items()}
    kp = strength(paths, lambda s: all_host[s[0]])
    odds = lambda x: math.log(x / (1 - x))
    seen = set()
    for i, _, h, lang in rows:
        (n, g), (m, f) = hosts[h], paths[h, lang]
        host = (g - p[i] + kh * prior) / (n - 1 + kh)
        path = (f - p[i] + kp * host) / (m - 1 + kp)
        want = 1 / (1 + math.exp(-(logit[i] + odds(path) - odds(prior))))
        assert math.isclose(got[i].score, want, rel_tol=1e-6) and got[i].keep == (got[i].score >= 0.5), i
        assert math.isclose(got[i].host_posterior, host, rel_tol=1e-6) and math.isclose(got[i].path_posterior, path, rel_tol=1e-6)
        seen.add(round(path, 3))
    assert len(seen) > 3


def test_a_lonely_document_says_nothing_about_itself(spark):
    """The only document of a site has the prior, whatever its own text says."""
    docs = spark.createDataFrame([(i, "Good words. " * 20, "big", "en") for i in range(30)] + [(99, "Good words. " * 20, "lonely", "xx")], "doc_id long, text string, source string, lang string")
    model = quality.QualityModel((0.0,) * 12, (1.0,) * 12, (2.0, *([0.0] * 24)))
    got = {r.doc_id: r for r in quality.classify(docs, None, model=model).select("doc_id", "quality_evidence.*").collect()}
    assert math.isclose(got[99].score, 1 / (1 + math.exp(-2.0)), rel_tol=1e-6) and math.isclose(got[99].path_posterior, 1 / (1 + math.exp(-2.0)), rel_tol=1e-6)


def test_quality_keeps_rows_and_columns(docs, none, spark):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(20)] + [(None, 1, 0), (3, None, 0), (999, 1, 0)], "doc_id long, quality int, toxic int")
    q = quality.classify(docs, labels)
    assert set(q.columns) == set(docs.columns) and q.count() == docs.count()
    assert by_row(q.select("doc_id", "text").collect(), "doc_id", "text") == by_row(docs.collect(), "doc_id", "text")
    assert quality.classify(none, labels).count() == 0
    assert quality.classify(docs, labels.limit(0)).where("quality_evidence.score is null").count() == 0
    assert quality.keep_good(docs, labels).columns == [c for c in docs.columns if c != quality.RESULT]


# licenses ------------------------------------------------------------------------------------------------------------


def test_license_template_regions():
    a = licenses.compile_template("x", "<<optional>> the <<end>> work of <<var max=2>> is <<one free|open>>")
    said = lambda s: a.longest(s.encode().split(), 0)
    assert said("the work of a b is free") == 7 and said("work of is open now") == 4
    assert said("work of a b c is free") == -1 and said("work of a is closed") == -1 and said("the the work of is free") == -1
    with pytest.raises(ValueError):
        licenses.compile_template("x", "<<optional>> all <<end>>")
    with pytest.raises(ValueError):
        licenses.parse("<<optional>> open")


def test_license_full_text_and_notice(spark, docs, none, plain_rows):
    mit = next(t for k, t in licenses.TEMPLATES if k == "mit" and "granted" in t)
    text = re.sub("<<.*?>>", " ", mit)
    rows = [(1, f"Copyright 2020 me.\n\n{text.upper()}"), (2, text.replace("sublicense", "sell")), (3, "This work is licensed under the GNU General Public License, version 3.")]
    got = {r.doc_id: r for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[1].labels, got[1].score) == ("mit", 1.0) and got[2].labels == "" and (got[3].base_labels, got[3].labels) == ("gpl", "gpl,gpl-3.0")
    scanned = licenses.scan_licenses(docs).collect()
    assert sorted(r.n_words for r in scanned) == sorted(len(ALNUM.findall(low(t))) for _, t in plain_rows)
    cc = next(r for r in scanned if r.doc_id == 82)
    assert (cc.n_base, cc.first_word, cc.last_word, cc.labels) == (3, 0, 4, "cc-by")
    assert licenses.scan_licenses(none).count() == 0


# packing -------------------------------------------------------------------------------------------------------------


def test_packing_places_every_token(docs, none, plain_rows):
    got = packing.pack(docs, WORDS, capacity=512, block_items=64).toPandas()
    want = []
    for d, t in plain_rows:
        ids = ids_of(WORDS, t, 1)
        want += [(str(d), k, s, len(ids[s : s + 512]), crc(ids[s : s + 512])) for k, s in enumerate(range(0, len(ids), 512))]
    seen = [(str(None if r.doc_id != r.doc_id else int(r.doc_id)), r.piece, r.start, r.length, r.ids_crc32) for r in got.itertuples()]
    assert sorted(seen) == sorted(want)
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert s.length.sum() <= 512 and (s.offset == s.length.cumsum() - s.length).all()
    assert got.sequence_id.nunique() <= math.ceil(got.length.sum() / 512) + 3
    assert packing.pack(none, WORDS).count() == 0


def test_crossover_keeps_items():
    import random

    rng = random.Random(3)
    lengths = [rng.randint(1, 100) for _ in range(200)]
    flat, best, bins, fit = packing.evolve(lengths, None, None, 1, 100, 4, 10)
    again, best2, bins2, fit2 = packing.evolve(lengths, flat, best, 2, 100, 4, 10)
    for b in packing._read(again, 200):
        assert sorted(i for x in b for i in x) == list(range(200)) and all(sum(lengths[i] for i in x) <= 100 for x in b)
    assert bins2 <= bins and math.ceil(sum(lengths) / 100) <= bins2
    assert packing.evolve([5], None, None, 1, 100, 4, 3)[2] == 1


def test_evolution_saves_bins():
    """Items of which three fill a bin, where best-fit decreasing leaves gaps; and a block that best-fit packs best already."""
    import random

    rng, lengths = random.Random(1), []
    for _ in range(200):
        a = rng.randint(1100, 1600)
        b = rng.randint(1100, 4096 - a - 1100)
        lengths += [a, b, 4096 - a - b]
    start: list[list[int]] = []
    packing.best_fit(start, [], sorted(range(600), key=lambda i: (-lengths[i], i)), lengths, 4096)
    state, elite = [None] * 3, [None] * 3
    for k in range(2):
        found = [packing.evolve(lengths, state[i], elite[i], 1009 * i + k, 4096, 4, 6) for i in range(3)]
        state, elite = [f[0] for f in found], [found[i - 1][1] for i in range(3)]
    bins = min(f[2] for f in found)
    assert 200 <= bins <= len(start) - 10
    packed = packing._read(found[0][1], 600)[0]
    assert sorted(i for x in packed for i in x) == list(range(600)) and all(sum(lengths[i] for i in x) <= 4096 for x in packed)
    assert packing.evolve([1000] * 8, None, None, 1, 4000, 4, 6)[2] == 2


# line dedup ----------------------------------------------------------------------------------------------------------


def brute_lines(rows, least):
    """Texts in order, without lines of any stretch of the shortest kind that stood before."""
    docs = sorted({(-(1 << 63) if d is None else d, t) for d, t in rows if t is not None})
    seen, gone = {}, collections.defaultdict(set)
    for doc in docs:
        units = [" ".join(BLANK.findall(low(x))) for x in doc[1].split("\n") if BLANK.findall(x)]
        sizes = [len(u.split(" ")) for u in units]
        for s, e in sorted({w for p in range(len(units)) for w in linededup.windows_at(sizes, least, p)}):
            key = tuple(units[s:e])
            if seen.setdefault(key, (doc, s)) != (doc, s):
                gone[doc] |= set(range(s, e))
    return gone


@pytest.mark.parametrize("least", [50, 8])
def test_line_dedup_equals_brute_force(docs, plain_rows, least):
    gone = brute_lines(plain_rows, least)
    got = linededup.dedup_lines(docs, least).select("doc_id", "text", "line_dedup.*").toPandas()
    assert len(got) == len(plain_rows)
    for d, old, new in zip(got.iloc[:, 0], got.iloc[:, 1], got.iloc[:, 2]):
        key = (-(1 << 63) if d != d else int(d), old)
        if old is None:
            assert new is None
            continue
        cut = sorted(gone.get(key, ()))
        assert new == linededup.delete_spans(old, [(i, i + 1) for i in cut])[0]


def test_line_windows():
    assert linededup.forward_windows([30, 30, 5], 50) == [(0, 2)] and linededup.windows_at([30, 30, 5], 50, 2) == {(0, 3)} - {(0, 3)} | linededup.windows_at([30, 30, 5], 50, 2)
    assert linededup.forward_windows([], 5) == [] and linededup.forward_windows([9], 5) == [(0, 1)]


def test_line_dedup_drops_emptied_and_counts(docs, none):
    out = linededup.replace_text(linededup.dedup_lines(docs, 8))
    assert out.where("n_chars != length(text) and text is not null").where("doc_id not in (5)").count() == 0
    assert out.where("doc_id in (75, 76)").count() == 0 and out.where("doc_id in (70, 71, 72)").count() == 3
    assert linededup.dedup_lines(none).count() == 0


# jaccard join --------------------------------------------------------------------------------------------------------


def brute_groups(rows, size, percent):
    sets = collections.defaultdict(set)
    for d, t in rows:
        w = tuple(BLANK.findall(low(t)))
        sets[d].add(frozenset(w[i : i + size] for i in range(max(1, len(w) - size + 1))) if w else frozenset())
    root = {d: d for d in sets if d is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(root)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                r = sorted((find(a), find(b)))
                root[r[1]] = r[0]
    return {d: find(d) for d in root}


@pytest.mark.parametrize("size, percent", [(4, 85), (5, 80), (2, 40)])
def test_groups_equal_brute_force(docs, plain_rows, size, percent):
    want = brute_groups(plain_rows, size, percent)
    got = jaccard.link_groups(docs, size, percent, list_size=2, tries=1).collect()
    assert len(got) == len(plain_rows)
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == want
    assert next(r.component_id for r in got if r.doc_id is None) == want[7]


def test_keep_first_of_each_group(docs, plain_rows, none):
    want = brute_groups(plain_rows, 5, 80)
    kept = [r.doc_id for r in jaccard.keep_first(docs).select("doc_id").collect()]
    assert sorted(d for d in kept if d is not None) == sorted(d for d, c in want.items() if d == c) and None in kept
    assert jaccard.keep_first(none).count() == 0


def test_members_of_one_prefix_group(spark):
    """Equal prefix and size, other shingles differ: the group is expanded."""
    base = [f"c{i}" for i in range(60)]
    rows = [(i, " ".join(base[:30] + ([f"r{i}"] if i else []) + base[30 + bool(i) :])) for i in range(12)]
    got = jaccard.link_groups(spark.createDataFrame(rows, "doc_id long, text string"), 1, 60)
    assert {r.component_id for r in got.collect()} == {0}


def test_different_texts_of_one_doc_id(spark):
    a, b = ([f"{x}{i}" for i in range(30)] for x in "ab")
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, " ".join([*a[:29], "z"])), (3, " ".join(["y", *b[1:]])), (4, " ".join(a[15:] + b[15:]))]
    got = jaccard.link_groups(spark.createDataFrame(rows, "doc_id long, text string"), 1, 80).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(1, 1), (2, 1), (3, 1), (4, 4)}


def test_bounds_lose_nothing():
    rng = np.random.default_rng(1)
    for _ in range(300):
        a = np.unique(rng.integers(0, 1 << 63, rng.integers(1, 80)).astype("u8"))
        b = np.unique(np.r_[a[rng.random(len(a)) < 0.95], rng.integers(0, 1 << 63, rng.integers(0, 6)).astype("u8")])
        same = len(np.intersect1d(a, b))
        if not len(b) or 100 * same < 85 * len(np.union1d(a, b)):
            continue
        table = np.zeros(1 << jaccard._TABLE_BITS, "<u2")
        p, q = jaccard.prefix(a, table, 85), jaccard.prefix(b, table, 85)
        assert len(np.intersect1d(p, q)) and same >= jaccard.least_overlap(len(a), len(b), 85)
        bits = sum(int(x).bit_count() for x in (jaccard.parity_sketch(a) ^ jaccard.parity_sketch(b)).view("u8"))
        assert bits <= len(a) + len(b) - 2 * jaccard.least_overlap(len(a), len(b), 85)


@pytest.mark.parametrize("one_task", [0, 100, 10_000])
def test_components_of_chains_stars_and_loops(spark, one_task):
    links = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5000, 5000), (None, 1), (7, 6), (7, 6)]
    got = {r.v: r.component for r in components.connected_components(spark.createDataFrame(links, "u long, v long"), one_task=one_task).collect()}
    assert got == {**dict.fromkeys(range(301), 0), **dict.fromkeys(range(1000, 1200), 1000)}
    assert components.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_forests_of_few_vertices_at_a_time(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(components, "_MOST_VERTICES", 3)
    links = [(i, i + 1) for i in range(20)] + [(3, 30), (40, 41)]
    batches = [pa.RecordBatch.from_arrays([pa.array([x[k] for x in links[at : at + 4]], pa.int64()) for k in (0, 1)], ["u", "v"]) for at in range(0, len(links), 4)]
    kept = [(u, v) for b in components._forest(iter(batches)) for u, v in zip(*(c.to_pylist() for c in b.columns))]
    root = {x: x for link in links for x in link}
    for _ in range(60):
        for u, v in kept:
            root[u] = root[v] = min(root[u], root[v])
    assert root == {**dict.fromkeys([*range(21), 30], 0), 40: 40, 41: 40} and len(kept) < len(links) + 8


# fingerprints --------------------------------------------------------------------------------------------------------


def test_edits_and_next_documents(docs, plain_rows):
    order = sorted(((-(1 << 63) if d is None else d, t or "", d) for d, t in plain_rows), key=lambda x: (-x[0], x[1].encode()))
    want = []
    for i, (_, t, d) in enumerate(order):
        after = order[(i + 1) % len(order)][1]
        e = t[: len(t) - len(t) // 3] + after[: len(t) // 3]
        a, b, c = (fingerprints.fingerprint(x.encode()) for x in (t, e, after))
        want.append((str(d), len(t), hashlib.sha256(e.encode()).hexdigest(), fingerprints.render(a), fingerprints.likeness(a, b), fingerprints.likeness(a, c)))
    got = [(str(r.doc_id), r.n_chars, r.edited_sha256, r.fingerprint, r.near_edited, r.near_next) for r in fingerprints.compare_edits(docs).collect()]
    assert sorted(got) == sorted(want)


def test_boundaries_equal_a_rolling_hash():
    """The hash of the last 16 bytes, one byte after the other, as a gear hash shifts them in by two bits."""
    rng = np.random.default_rng(5)
    for size in (1, 5, 11, 12, 31, 40, 200, 5000):
        data = bytes(rng.integers(97, 103 if size % 2 else 123, size).astype("u1"))
        ends, start = [], 0
        for i in range(size):
            h = 0
            for b in data[max(0, i - 15) : i + 1]:
                h = ((h << 2) + int(fingerprints._GEAR[b])) & 0xFFFFFFFF
            long = i + 1 - start
            if long > fingerprints.MOST:
                ends.append(start + fingerprints.MOST)
                start += fingerprints.MOST
                long = i + 1 - start
            if long >= fingerprints.NORMAL and h < int(fingerprints._LOOSE) or long >= fingerprints.LEAST and h < int(fingerprints._STRICT):
                ends.append(i + 1)
                start = i + 1
        while size - start > fingerprints.MOST:
            start += fingerprints.MOST
            ends.append(start)
        assert fingerprints.boundaries(data) == (ends + [size] if start < size else ends), size


def test_ranges_of_doc_ids(spark):
    from assaykit.llm import common

    rows = spark.createDataFrame([(i,) for i in [None, *range(-5, 40)]], "doc_id long")
    for splits in ([], [3], [0, 7, 8, 20, 33], list(range(0, 38, 2))):
        got = {r.doc_id: r.b for r in rows.select("doc_id", common.id_range(splits).alias("b")).collect()}
        assert got == {d: 0 if d is None else sum(d >= s for s in splits) for d in [None, *range(-5, 40)]}


def test_chunks_resist_shifts():
    rng = np.random.default_rng(2)
    text = bytes(rng.integers(97, 123, 20_000).astype("u1"))
    a, b = fingerprints.fingerprint(text), fingerprints.fingerprint(b"some words first " + text)
    assert fingerprints.likeness(a, b) > 0.98 and fingerprints.likeness(a, fingerprints.fingerprint(text[::-1])) < 0.02
    ends = fingerprints.boundaries(text)
    sizes = np.diff([0, *ends])
    assert ends[-1] == len(text) and sizes.max() <= fingerprints.MOST and (sizes[:-1] >= fingerprints.LEAST).all()
    assert fingerprints.parse(fingerprints.render(a)) == a
    assert fingerprints.likeness({}, {}) == 1 and fingerprints.likeness({}, a) == 0 and fingerprints.boundaries(b"") == []


def test_fingerprints_of_few_rows(docs, none):
    assert fingerprints.compare_edits(none).count() == 0 and fingerprints.compare_edits(docs.where("doc_id = 1")).first().near_next == 1
    assert fingerprints.fingerprints(docs).count() == docs.count()


# language model ------------------------------------------------------------------------------------------------------


def test_scores_equal_counts(docs, plain_rows, none):
    count = collections.Counter()
    toks = [(d, [*BLANK.findall(low(t)), "\n"]) for d, t in plain_rows]
    for d, w in toks:
        if d is None or zlib.crc32(str(d).encode()) % 7 != 2:
            count.update(w)
    n, v = sum(count.values()), len(count)
    want = sorted((str(d), len(w), sum(x in count for x in w), n, round(sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w), 4)) for d, w in toks)
    got = lm.score_documents(docs, lm.Settings(hot=50, least_buckets=4)).collect()
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == want
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 2) for r in got)
    train = [r for r in got if not r.held_out]
    assert sum(r.score for r in train) > sum(r.base_score for r in train)
    assert lm.score_documents(none).count() == 0


def test_model_beats_base_on_held_out_texts(spark, small):
    got = lm.score_documents(spark.read.parquet(f"{small}/documents.parquet")).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > got[1]


def test_rare_words_are_contexts(spark):
    """Rare words of one ending keep their own followers, and the table of frequent words is a fast path only."""
    rng = np.random.default_rng(4)
    pairs = [(f"first{i}xy", f"second{i}") for i in range(30)]
    texts = [" ".join(w for _ in range(20) for w in ("the", *pairs[rng.integers(30)])) for _ in range(300)]
    right, wrong = " ".join(f"the {a} {b}" for a, b in pairs), " ".join(f"the {a} {pairs[i - 1][1]}" for i, (a, _) in enumerate(pairs))
    held = [i for i in range(1000, 1100) if lm.is_held_out(i)][:2]
    docs = spark.createDataFrame([*enumerate(texts), (held[0], right), (held[1], wrong)], "doc_id long, text string").repartition(3)
    few, many = ({r.doc_id: r for r in lm.score_documents(docs, lm.Settings(hot=h, least_buckets=4)).collect()} for h in (2, 100))
    assert few[held[0]].score > few[held[1]].score + 30  # more than a digit a pair
    assert all(abs(few[i].score - many[i].score) < 0.1 * abs(many[i].score) for i in few)  # by sampling; pairs never seen differ most
    assert all(math.isclose(few[i].base_score, many[i].base_score) and few[i].n_known == many[i].n_known for i in few)


@pytest.mark.parametrize("words, contexts", [(20, 2), (300, 60)])
def test_predictions_sum_to_one(words, contexts):
    """Over all words and the unknown one (the last), in every context, for the mean of the samples."""
    s = lm.Settings(hot=1)
    rng = np.random.default_rng(1)
    word, ctx = np.divmod(np.arange((words + 1) * contexts), contexts)
    counts = rng.poisson(0.3, len(word)) * rng.integers(1, 9, len(word)) * (word < words)
    by_ctx, seen = np.bincount(ctx, weights=counts), np.bincount(word, weights=counts) > 0
    types = float((counts > 0).sum())
    start = lm.Totals(by_ctx, np.bincount(ctx, weights=counts > 0), types, float(seen.sum()), int(seen.sum()), 0.6, 0.5)
    found = list(lm.sample(word, ctx, counts, start, s, 3))
    again = list(lm.sample(word, ctx, counts, start, s, 3))
    assert len(found) == s.samples and all((x == y).all() for a, b in zip(found, again) for x, y in zip(a, b))  # the same seats again
    totals = []
    for tables, customers, root_tables in found:
        assert (tables[counts > 0] >= 1).all() and (tables <= counts).all() and (root_tables <= customers).all()
        totals.append(dataclasses.replace(start, context_tables=np.bincount(ctx, weights=tables), root_customers=customers.sum(), root_tables=root_tables.sum()))
    p = 10 ** lm.predict(found, word, ctx, counts, totals, s)
    known = seen.copy()
    known[words] = True
    assert np.allclose(np.bincount(ctx, weights=p * known[word]), 1, atol=1e-9)
    parents = [t.root(c, k, s)[word] for t, (_, c, k) in zip(totals, found)]
    assert np.allclose(10 ** lm.predict_below([x[0] for x in found], parents, ctx, counts, totals, s), p)


def test_seating_grows_like_the_process():
    """Mean tables against customers seated one by one."""
    rng = np.random.default_rng(4)
    got = lm.seat(np.full(4000, 300), np.full(4000, 2.0), 0.4, rng).mean()
    want = []
    for _ in range(400):
        t = 1
        for i in range(1, 300):
            t += rng.random() * (2.0 + i - 0.4 * t) < 2.0
        want.append(t)
    assert abs(got - np.mean(want)) < 0.05 * np.mean(want) + 0.3
    assert lm.seat(np.array([0, 1]), np.array([1.0, 1.0]), 0.4, rng).tolist() == [0, 1]


# url filter ----------------------------------------------------------------------------------------------------------


def test_url_filter_equals_brute_force(spark):
    events = [("bad.org", "add", "2024-01-10"), ("bad.org", "remove", "2024-02-01"), ("BAD.org.", "add", "2024-03-01"), ("x.com/a/b", "add", "2024-01-01"),
              ("x.com", "remove", "2024-01-05"), ("y.net", "add", "2024-01-05"), ("y.net", "remove", "2024-01-05"), (None, "add", "2024-01-01"), ("z.io", None, "2024-01-01"),
              ("z.io", "add", None), ("org", "add", "2024-06-01")]
    urls = ["http://bad.org/", "https://u:p@sub.Bad.org:8080/x?q#f", "http://notbad.org", "https://x.com/a/b/c", "https://x.com/a/bc", "x.com/a//b?z", "http://y.net", "http://z.io", "", None]
    days = ["2024-01-09", "2024-01-10", "2024-01-31", "2024-02-01", "2024-03-01", "2024-07-01", None]
    caps = spark.createDataFrame([(i, u, d, "x") for i, (u, d) in enumerate((u, d) for u in urls for d in days)] + [(0, urls[0], days[0], "x")],
                                 "page_id long, url string, fetched string, entry string").withColumn("fetched", F.col("fetched").cast("timestamp"))
    listed = spark.createDataFrame(events, "entry string, action string, on string").withColumn("on", F.col("on").cast("timestamp"))
    spans = [("bad.org", "", "2024-01-10", "2024-02-01"), ("bad.org", "", "2024-03-01", None), ("x.com", "a/b", "2024-01-01", None), ("org", "", "2024-06-01", None)]

    def expect(url, d):
        if not url or not d:
            return 0, None
        host, _, path = re.sub(r"^[a-z]+://", "", url.split("?")[0].split("#")[0]).partition("/")
        host = host.split("@")[-1].split(":")[0].lower().rstrip(".")
        path = "/".join(x for x in path.split("/") if x)
        hits = [(len(h.split(".")), len(p), f"{h}/{p}".strip("/")) for h, p, a, b in spans
                if (host == h or host.endswith("." + h)) and (not p or (path + "/").startswith(p + "/")) and a <= d and (b is None or d < b)]
        return len(hits), max(hits)[2] if hits else None

    for limit in (100_000, 0):
        got = urlfilter.filter_urls(caps, listed, broadcast_sites=limit).collect()
        assert len(got) == len(urls) * len(days) + 1
        for r in got:
            url, d = urls[r.page_id // len(days)], days[r.page_id % len(days)]
            assert (r.n_active, r.entry) == expect(url, d) and r.blocked == (r.n_active > 0), (url, d)
    assert urlfilter.filter_urls(caps, listed.limit(0)).where("blocked").count() == 0 and urlfilter.filter_urls(caps.limit(0), listed).count() == 0


# decontamination -----------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("slices", [200_000, 7])
def test_contamination_equals_brute_force(spark, docs, plain_rows, none, slices):
    texts = dict(plain_rows)
    items = [(1, texts[2]), (2, "One"), (3, None), (4, ""), (5, " ".join(texts[8].split()[3:15])), (None, texts[1]), (2, texts[9]), (6, "Ünï ß"), (1, texts[2])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    wins = collections.defaultdict(set)
    for i, t in items:
        w = ALNUM.findall(low(t))
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if n and i is not None else 0):
            wins[tuple(w[k : k + n])].add(str(i))
    want = []
    for d, t in plain_rows:
        w, hit, ids = ALNUM.findall(low(t)), set(), set()
        for n in {len(k) for k in wins}:
            for k in range(len(w) - n + 1):
                if found := wins.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    ids |= found
        want.append((str(d), len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    got = [tuple([str(r[0]), *r[1:]]) for r in decontam.contamination_digest(decontam.mark_contamination(docs, bench, slice_windows=slices)).collect()]
    assert sorted(got) == sorted(want)
    assert decontam.mark_contamination(none, bench).count() == 0
    assert decontam.mark_contamination(docs, bench.limit(0)).where("contamination.n_hit > 0").count() == 0


# tokens --------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_cached_encoding_equals_the_library(path, plain_rows):
    import random

    rng = random.Random(1)
    texts = [t or "" for _, t in plain_rows] + ["".join(rng.choice("ab's t'\n\t .,12é²<|!! ") for _ in range(30)) for _ in range(2000)]
    marks = "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>"
    texts += [t for m in marks for t in (m, f"alpha {m} beta", f"alpha{m}beta", f"{m}{m}", f"a {m} \n {m}", f" {m} ", f"x <|{m}", f"ende {m} é")]
    e, plain = tokens.Encoder(path), Tokenizer.from_file(path)
    want = [np.array(x.ids, "<u4").tobytes() for x in plain.encode_batch(texts, add_special_tokens=False)]
    assert e.encode(texts) == want and e.encode(texts[::-1]) == want[::-1]


@pytest.mark.parametrize("plane", ["byte", "bit"])
def test_token_store_round_trip(spark, docs, plain_rows, tmp_path, plane):
    path = str(tmp_path / "store")
    tokenstore.write_token_store(docs, path, BYTES, 2, block_ids=100, segment_ids=3000, plane=plane)
    order = sorted(((d is not None, d or 0), (t or "").encode(), d) for d, t in plain_rows)
    got = {r.start: r for r in tokenstore.read_token_store(spark, path).collect()}
    start = 0
    for _, t, d in order:
        ids = ids_of(BYTES, t.decode(), 2)
        r = got[start]
        assert (r.doc_id, r.n_tokens, r.ids_crc32, r.ids) == (d, len(ids), crc(ids), ids)
        start += len(ids)
    index = tokenstore.read_chunk_index(spark, path)
    assert index.agg(F.sum("n")).first()[0] == start and index.where("n > 100").count() == 0


def test_planes_are_transposed():
    block = np.arange(1000, dtype="<u4").tobytes()
    for plane in ("byte", "bit"):
        assert tokenstore.join_planes(tokenstore.split_planes(block, plane), 1000, plane) == block
    assert tokenstore.split_planes(block, "byte")[3] == bytes(1000)


def test_empty_store(spark, none, tmp_path):
    tokenstore.write_token_store(none, str(tmp_path / "s"), BYTES, 2)
    assert tokenstore.read_token_store(spark, str(tmp_path / "s")).count() == 0
