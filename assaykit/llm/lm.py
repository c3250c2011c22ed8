"""LM scoring with a hierarchical Pitman-Yor model.

Every context has a restaurant, whose dishes are the words seen after it; all contexts share one parent, the restaurant
of words without context, and that one falls back on the uniform distribution over the training words and one unknown
word. Every training word is a context, and so is the start of a text; a word that no training text has leaves the parent.
Seatings are sampled by Gibbs, a dish of a restaurant at a time; predictive probabilities are averaged over samples. Each
sample is scored with its own totals: the sweeps are run once to add up what they seat, and again, with the same seeds and so
the same seats, to score. So the probabilities of a sample add up to one in every context.

How the work is spread: frequent words after frequent words are counted in a table of fixed size. Rare words (all others)
are dealt by their hash into buckets, so all counts of a word are in one place; frequent words after rare ones are dealt
by the hash of the rare one. Totals of frequent contexts and frequent words are of fixed size. Totals of a rare context
are added up in the bucket of its hash: the buckets that meet it tell their share and are told the sum.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blank_words, map_batches, materialize, text_frame, text_partitions

_SLICE = 1 << 14
_ROW = "part int, kind int, slice int, data binary"
_RARE, _TABLE, _STATS, _AFTER, _AFTER_STATS, _SHARE, _TOLD, _OWN = range(8)
#: Seeds of the frequent words' table, and of a bucket's words after rare contexts.
_TABLE_SEED, _AFTER_SEED = 1, 250_007


@dataclass(frozen=True)
class Settings:
    hot: int = 1000
    bucket_tokens: int = 2_000_000
    least_buckets: int = 64
    burn_in: int = 3
    samples: int = 3
    strength: float = 1.0
    root_strength: float = 1.0
    seed: int = 7

    @property
    def contexts(self) -> int:
        """The start and the frequent words; rare words are contexts too, numbered from here on in each bucket."""
        return 1 + self.hot


def is_held_out(doc_id) -> bool:
    """crc32 of the doc_id as text, modulo 7, is 2; null is never held out."""
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


def _pack(*arrays: np.ndarray) -> bytes:
    """Compressed byte plane by byte plane: high bytes of small numbers take next to nothing."""
    import zstandard

    head = np.array([len(arrays), *[len(a) * a.itemsize for a in arrays]], "<i8")
    planes = [np.ascontiguousarray(a).view("u1").reshape(len(a), a.itemsize).T.tobytes() for a in arrays]
    return zstandard.ZstdCompressor(level=1).compress(b"".join([head.tobytes(), *planes]))


def _unpack(data: bytes, *kinds: str) -> list[np.ndarray]:
    import zstandard

    data = zstandard.ZstdDecompressor().decompress(data)
    n = int(np.frombuffer(data, "<i8", 1)[0])
    at, out = 8 * (n + 1), []
    for size, kind in zip(np.frombuffer(data, "<i8", n, 8).tolist(), kinds):
        width = np.dtype(kind).itemsize
        planes = np.frombuffer(data, "u1", size, at).reshape(width, size // width)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(kind))
        at += size
    return out


def _steps(ascending: np.ndarray) -> np.ndarray:
    """Differences of ascending hashes; ``np.cumsum`` gives the hashes back."""
    return np.diff(ascending, prepend=np.zeros(1, ascending.dtype))


def frequent_words(docs: DataFrame, most: int) -> tuple[list[bytes], int]:
    """About the ``most`` most frequent words of the training texts, and the number of tokens of all texts.

    A task tells the words that make up one in 5 * most of its tokens, so it sends a bounded number. Which words are
    called frequent only says where they are counted, not how.
    """

    def run(batches):
        count, n = Counter(), 0
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                words = blank_words(text)
                n += len(words) + 1
                if not is_held_out(doc):
                    count.update(words)
                if len(count) > 2_000_000:  # words that can't become frequent any more
                    count = Counter({w: k for w, k in count.items() if k > 1})
        told = [(w, k) for w, k in count.items() if k * 5 * most >= n]
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in told] + [None], pa.binary()), pa.array([k for _, k in told] + [n], pa.int64())], ["w", "n"])

    found = map_batches(text_frame(docs), run, "w binary, n long").groupBy("w").agg(F.sum("n").alias("n"))
    found = found.orderBy(F.col("w").isNull().desc(), F.col("n").desc(), "w").limit(most + 1).collect()
    return [bytes(r.w) for r in found if r.w is not None], sum(r.n for r in found if r.w is None)


class Reader:
    """Texts to numbers: contexts of all tokens, places of frequent words and the end; the rare words."""

    def __init__(self, hot: list[bytes], s: Settings):
        self.hot, self.s = {w: i for i, w in enumerate(hot)}, s

    def tokens(self, text: bytes | None) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """(word number or -1 for rare, context or -1 for rare) of each token, the end being number ``hot``; the rare words."""
        words = blank_words(text)
        get = self.hot.get
        w = np.array([get(x, -1) for x in words] + [self.s.hot], "i4")
        rare = [x for x, k in zip(words, w.tolist()) if k < 0]
        own = w[:-1]
        return w, np.r_[np.zeros(1, "i4"), np.where(own < 0, -1, own + 1)].astype("i4"), rare


def _count(docs: DataFrame, hot: list[bytes], buckets: int, s: Settings) -> DataFrame:
    """Rows for each bucket of rare tokens, each bucket of frequent tokens after rare words, their statistics, and the
    table's slices."""
    width = (s.hot + 2) * s.contexts
    slices = -(-width // _SLICE)
    held = docs.sparkSession.sparkContext.broadcast(Reader(hot, s))

    def split(batches):
        import xxhash

        reader, digest = held.value, xxhash.xxh3_64_intdigest
        table = np.zeros(slices * _SLICE, "i8")
        docs_, hashes, words, ctxs, cells, n = [], [], [], [], [], 0

        def dealt(kind, h, d, other, docs_of, pack_other):
            part = (h % np.uint64(buckets)).astype("i4")
            order = np.lexsort((h, part))
            h, d, other, part = h[order], d[order], [x[order] for x in other], part[order]
            for k, i, j in _runs(part):  # the buckets that occur, however many there are
                who, local = np.unique(d[i:j], return_inverse=True)
                yield k, kind, 0, _pack(*[x[who] for x in docs_of], _steps(h[i:j]), local.astype("<u4"), *pack_other(*[x[i:j] for x in other]))

        def contexts_of(c, before):
            seen, own = np.unique(before[c < 0], return_inverse=True)
            c = c.astype("<u4")
            c[c == np.uint32(0xFFFFFFFF)] = s.contexts + own
            return c, _steps(seen)

        def rows():
            nonlocal docs_, hashes, words, ctxs, cells, n
            if cells:
                table[:width] += np.bincount(np.concatenate(cells), minlength=width)
            out = []
            if words:
                w, c = np.concatenate(words), np.concatenate(ctxs)
                d = np.repeat(np.arange(len(words), dtype="u4"), [len(x) for x in words])
                h = np.zeros(len(w), "u8")
                h[w < 0] = np.array(hashes, "u8")
                before = np.r_[np.zeros(1, "u8"), h[:-1]]
                of = [np.array([x[k] for x in docs_], t) for k, t in enumerate(("<i8", "<u4", "u1"))]
                i = np.flatnonzero(w < 0)
                out += dealt(_RARE, h[i], d[i], [c[i], before[i]], of, contexts_of)
                i = np.flatnonzero((w >= 0) & (c < 0))
                out += dealt(_AFTER, before[i], d[i], [w[i].astype("<u4")], of, lambda x: (x, np.zeros(0, "<u8")))
            docs_, hashes, words, ctxs, cells, n = [], [], [], [], [], 0
            return out

        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                w, ctx, rare = reader.tokens(text)
                train = not is_held_out(doc)
                if train:
                    near = ctx >= 0
                    own = near & (w >= 0)
                    cells += [w[own] * s.contexts + ctx[own], (s.hot + 1) * s.contexts + ctx[near]]
                if rare:
                    hashes += map(digest, rare)
                    docs_.append((_doc_number(doc), zlib.crc32(text or b""), train))
                    words.append(w)
                    ctxs.append(ctx)
                    n += len(rare)
                if n >= 2_000_000 or len(cells) >= 100_000:
                    yield _batch(rows())
        yield _batch(rows())
        yield _batch([(k % buckets, _TABLE, k, _pack(table[k * _SLICE : (k + 1) * _SLICE])) for k in range(slices)])

    def merge(batches):
        table, parts, bucket = {}, {_RARE: [], _AFTER: []}, None
        for b in batches:
            for row in b.to_pylist():
                if row["kind"] == _TABLE:
                    found = _unpack(row["data"], "<i8")[0]
                    table[row["slice"]] = table[row["slice"]] + found if row["slice"] in table else found
                else:
                    bucket = row["part"]
                    parts[row["kind"]].append(_unpack(row["data"], "<i8", "<u4", "u1", "<u8", "<u4", "<u4", "<u8"))
        yield _batch([(0, _TABLE, k, _pack(t)) for k, t in table.items()])
        for kind in (_RARE, _AFTER):
            if parts[kind]:
                yield _batch(grouped(kind, bucket, parts.pop(kind)))

    def grouped(kind, bucket, parts):
        """Tokens sorted by what they were dealt by (key) and the other word, and what the bucket adds to the totals."""
        ends = np.cumsum([0] + [len(p[0]) for p in parts])
        ids, texts, train = (np.concatenate([p[k] for p in parts]) for k in range(3))
        h = np.concatenate([np.cumsum(p[3], dtype="u8") for p in parts])
        d = np.concatenate([p[4].astype("i8") + e for p, e in zip(parts, ends)])
        rare, place = np.unique(np.concatenate([np.cumsum(p[6], dtype="u8") for p in parts]), return_inverse=True)
        starts = np.cumsum([0] + [len(p[6]) for p in parts])
        c = []
        for p, e in zip(parts, starts):
            x = p[5].astype("i8")
            if len(p[6]):
                far = x >= s.contexts
                x[far] = s.contexts + place[e + x[far] - s.contexts]
            c.append(x)
        c = np.concatenate(c)
        del parts
        order = np.lexsort((c, h))
        h, d, c = h[order], d[order], c[order]
        new = np.r_[True, h[1:] != h[:-1]]
        key = np.cumsum(new) - 1
        pair_new = new | np.r_[True, c[1:] != c[:-1]]
        pair = np.cumsum(pair_new) - 1
        counts = np.bincount(pair[train[d] > 0], minlength=pair[-1] + 1)
        first = np.flatnonzero(pair_new)
        kept = rare if kind == _RARE else h[new]  # the rare contexts' hashes
        data = _pack(ids, texts, key[first].astype("<u4"), c[first].astype("<u4"), counts.astype("<i8"), _steps(pair).astype("<u4"), d.astype("<u4"), _steps(kept))
        by_key, own = np.bincount(key[first], weights=counts), c[first]
        if kind == _RARE:
            stats = np.array([(by_key > 0).sum(), (counts == 1).sum(), (counts == 2).sum(), (by_key == 1).sum(), (by_key == 2).sum(), counts.sum(), (counts > 0).sum()], "i8")
            seen = np.bincount(own[(counts > 0) & (own < s.contexts)], minlength=s.contexts)
            return [(bucket, _RARE, 0, data), (bucket, _STATS, 0, _pack(stats, seen.astype("i8")))]
        stats = np.array([(counts == 1).sum(), (counts == 2).sum()], "i8")
        seen, total = (np.bincount(own, weights=x, minlength=s.hot + 1).astype("i8") for x in (counts > 0, counts))
        return [(bucket, _AFTER, 0, data), (bucket, _AFTER_STATS, 0, _pack(stats, seen, total))]

    rows = map_batches(text_frame(docs), split, _ROW)
    return materialize(map_batches(rows.repartitionById(buckets, F.col("part")), merge, _ROW), "counts", "kind").select("part", "kind", "slice", "data")


def _doc_number(doc_id) -> int:
    return -(1 << 63) if doc_id is None else int(doc_id)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["part", "kind", "slice", "data"])


def seat(counts: np.ndarray, new: np.ndarray, discount: float, rng: np.random.Generator, own: np.ndarray | float = 0.0) -> np.ndarray:
    """Tables of each dish after all its customers have taken their seats again, one after the other.

    ``new`` is the weight of a new table as far as other dishes make it (mass of the parent for this dish), ``own`` what each
    table of the dish itself adds to it. Customer i joins a table with weight i - 1 - discount * tables. The first 32 customers
    are drawn one by one, those after them in groups of an eighth of the seated: how many of a group open tables is drawn at
    once. So the work grows with the logarithm of a dish's customers.
    """
    tables = (counts > 0).astype("f8")
    own = np.broadcast_to(own, counts.shape)
    live = np.flatnonzero(counts > 1)
    for i in range(1, 32):
        if not len(live):
            return tables
        t = tables[live]
        a = new[live] + own[live] * t
        tables[live] += rng.random(len(live)) * (a + i - discount * t) < a
        live = live[counts[live] > i + 1]
    seated = 32
    while len(live):
        t, group = tables[live], np.minimum(counts[live] - seated, seated // 8).astype("i8")
        a = new[live] + own[live] * t
        joined = seated - discount * t
        mean = a * np.log1p(group / (a + joined))  # the chance of a new table, added up over the group
        tables[live] += rng.binomial(group, np.minimum(1.0, mean / group))
        seated += seated // 8
        live = live[counts[live] > seated]
    return tables


@dataclass(frozen=True)
class Totals:
    """What all restaurants share: fixed in size."""

    context_counts: np.ndarray
    context_tables: np.ndarray
    root_customers: float
    root_tables: float
    vocabulary: int
    discount: float
    root_discount: float

    def root(self, customers: np.ndarray, tables: np.ndarray, s: Settings) -> np.ndarray:
        """Predictive probability of words in the parent restaurant."""
        fall_back = (s.root_strength + self.root_discount * self.root_tables) / (self.vocabulary + 1)
        return (customers - self.root_discount * tables + fall_back) / (s.root_strength + self.root_customers)


def _grown(ctx: np.ndarray, counts: np.ndarray, t: Totals):
    """A function of the tables of the pairs here: mass that each pair's context sends to its parent, but for the pair's own
    tables. A context's tables elsewhere are taken to grow as they do here."""
    m = len(t.context_tables)
    types = np.bincount(ctx, weights=counts > 0, minlength=m)

    def back(tables: np.ndarray, s: Settings) -> np.ndarray:
        growth = np.divide(np.bincount(ctx, weights=tables, minlength=m), types, out=np.ones(m), where=types > 0)
        return s.strength + t.discount * np.maximum(0.0, (t.context_tables * growth)[ctx] - tables)

    return back


def sample(word: np.ndarray, ctx: np.ndarray, counts: np.ndarray, t: Totals, s: Settings, seed: int, more: list[np.ndarray] | None = None, met: float = 0.0, still: float = 0.0):
    """Gibbs sweeps over all dishes here: yields (tables of each pair, root customers, root tables of each word) of each sample
    after the burn-in. The same arguments give the same seats again. A dish is seated given the tables of all others: its own
    count neither in its context nor in the parent.

    ``t``: totals before the first sweep, when each dish has one table; what is elsewhere is taken to grow as it does here, but
    for ``still`` root customers more. ``more``: for each sample, root customers of each word that come from pairs elsewhere, of
    which there are ``met``.
    """
    rng = np.random.default_rng(seed)
    n = len(more[0]) if more else int(word.max()) + 1 if len(word) else 0
    other = lambda k: more[max(0, k - s.burn_in)] if more else np.zeros(n)
    tables = (counts > 0).astype("f8")
    back = _grown(ctx, counts, t)
    first = max(1.0, tables.sum() + met)
    customers = np.bincount(word, weights=tables, minlength=n) + other(0)
    root_tables = (customers > 0).astype("f8")
    dishes, unseen = max(1.0, root_tables.sum()), t.vocabulary + 1
    for k in range(s.burn_in + s.samples):
        all_customers, all_tables = still + t.root_customers * customers.sum() / first, t.root_tables * root_tables.sum() / dishes
        fall_back = (s.root_strength + t.root_discount * all_tables) / unseen
        rest = customers[word] - tables
        kept = root_tables[word] * rest / np.maximum(customers[word], 1.0)
        p = (rest - t.root_discount * kept + fall_back) / (s.root_strength + np.maximum(rest, all_customers - tables))
        tables = seat(counts, back(tables, s) * p, t.discount, rng, t.discount * p)
        customers = np.bincount(word, weights=tables, minlength=n) + other(k)
        root_tables = seat(customers, np.full(n, fall_back), t.root_discount, rng)
        if k >= s.burn_in:
            yield tables, customers, root_tables


def sample_below(p: np.ndarray, ctx: np.ndarray, counts: np.ndarray, t: Totals, s: Settings, seed: int):
    """The same where the parent's probability ``p`` of each pair's word is known: yields the tables of each pair."""
    rng = np.random.default_rng(seed)
    tables, back = (counts > 0).astype("f8"), _grown(ctx, counts, t)
    for k in range(s.burn_in + s.samples):
        tables = seat(counts, back(tables, s) * p, t.discount, rng, t.discount * p)
        if k >= s.burn_in:
            yield tables


def predict(found, word: np.ndarray, ctx: np.ndarray, counts: np.ndarray, totals: list[Totals], s: Settings) -> np.ndarray:
    """log10 of the probability of each (word, context) pair, averaged over samples. ``found``: what ``sample`` yields; ``totals``:
    those of each sample."""
    total = np.zeros(len(counts))
    for (tables, customers, root_tables), t in zip(found, totals, strict=True):
        total += _predicted(tables, t.root(customers, root_tables, s)[word], ctx, counts, t, s)
    return np.log10(total / len(totals))


def _predicted(tables, p, ctx, counts, t: Totals, s: Settings) -> np.ndarray:
    """Probability of each pair in one sample: what its tables say, and the parent's probability for the rest."""
    back = s.strength + t.discount * t.context_tables[ctx]
    return (counts - t.discount * tables + back * p) / (s.strength + t.context_counts[ctx])


def predict_below(found, p: list[np.ndarray], ctx: np.ndarray, counts: np.ndarray, totals: list[Totals], s: Settings) -> np.ndarray:
    """The same where the parent's probabilities of each pair's word are known for each sample."""
    total = np.zeros(len(counts))
    for tables, q, t in zip(found, p, totals, strict=True):
        total += _predicted(tables, q, ctx, counts, t, s)
    return np.log10(total / len(totals))


def _with_rare(t: Totals, counts: np.ndarray, tables: np.ndarray) -> Totals:
    """The totals with those of a bucket's rare contexts behind the frequent ones."""
    return replace(t, context_counts=np.r_[t.context_counts, counts], context_tables=np.r_[t.context_tables, tables])


_BUCKET = ("<i8", "<u4", "<u4", "<u4", "<i8", "<u4", "<u4", "<u8")


def _bucket(data: bytes) -> list[np.ndarray]:
    """Of a bucket: doc_ids, text hashes, (key, other word, count) of each pair, (pair, text) of each token, rare contexts."""
    *head, pair, d, rare = _unpack(data, *_BUCKET)
    return [*head, np.cumsum(pair), d, np.cumsum(rare, dtype="u8")]


def _runs(part: np.ndarray):
    """(value, from, to) of the runs of equal values."""
    at = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else part
    return zip(part[at].tolist(), at.tolist(), [*at[1:].tolist(), len(part)])


def _by_bucket(rare: np.ndarray, buckets: int):
    """(bucket, places in ``rare``) of rare contexts, dealt by their hash."""
    part = (rare % np.uint64(buckets)).astype("i8")
    order = np.argsort(part, kind="stable")
    at = np.flatnonzero(np.r_[True, np.diff(part[order]) != 0]) if len(order) else order
    return zip(part[order[at]].tolist(), np.split(order, at[1:]) if len(order) else [])


def _settled(word, ctx, counts, after_seen, after_count, t: Totals, rare_types: float, s: Settings) -> tuple[np.ndarray, float]:
    """Root probabilities of frequent words, and their root customers, once the sweeps have come to rest.

    Rare contexts aren't known here, only how many of them a word follows and how often: it is taken to follow each as often.
    """
    rng, n, tries = np.random.default_rng(s.seed), len(after_seen), 32
    mean = np.maximum(1, np.round(after_count / np.maximum(after_seen, 1))).astype("i8")
    tables, far, back = (counts > 0).astype("f8"), np.ones(n), _grown(ctx, counts, t)
    root_tables = (np.bincount(word, weights=tables, minlength=n) + after_seen > 0).astype("f8")
    for _ in range(s.burn_in + s.samples):
        customers = np.bincount(word, weights=tables, minlength=n) + after_seen * far
        p = replace(t, root_customers=customers.sum() + rare_types).root(customers, root_tables, s)
        tables = seat(counts, back(tables, s) * p[word], t.discount, rng, t.discount * p[word])
        q = np.tile(p, tries)
        far = seat(np.tile(mean, tries), s.strength * q, t.discount, rng, t.discount * q).reshape(tries, n).mean(0)
        fall_back = np.full(n, (s.root_strength + t.root_discount * t.root_tables) / (t.vocabulary + 1))
        root_tables = seat(np.round(customers).astype("i8"), fall_back, t.root_discount, rng)
    return p, float(customers.sum())


def _bucket_seed(s: Settings, bucket: int) -> int:
    return s.seed * 1_000_003 + bucket


def _own_start(c: np.ndarray, n: np.ndarray, contexts: int, rare: int) -> list[np.ndarray]:
    """Customers and distinct words of a bucket's rare contexts, as far as the bucket sees them."""
    return [np.bincount(c, weights=x, minlength=contexts + rare)[contexts:] for x in (n, n > 0)]


def _sweep(counted: DataFrame, buckets: int, start: Totals, hot_p: np.ndarray, still: float, s: Settings) -> DataFrame:
    """The sweeps of all buckets, and rare contexts' totals of each sample, told to each bucket that meets them."""
    held = counted.sparkSession.sparkContext.broadcast((start, hot_p, still))

    def shares(batches):
        t, _, still = held.value
        for b in batches:
            for r in b.to_pylist():
                w, c, n, _, _, rare = _bucket(r["data"])[2:]
                # a rare context starts with the tables that this bucket sees itself
                here = _own_start(c, n, s.contexts, len(rare))
                by_context, root = [], []
                for tables, customers, root_tables in sample(w.astype("i8"), c, n, _with_rare(t, *here), s, _bucket_seed(s, r["part"]), still=still):
                    by_context.append(np.bincount(c, weights=tables, minlength=s.contexts + len(rare)))
                    root += [customers.sum(), root_tables.sum()]
                rows = [(r["part"], _STATS, 0, _pack(np.concatenate([x[: s.contexts] for x in by_context]), np.array(root)))]
                own = [x[s.contexts :].astype("<u4") for x in by_context]
                for k, i in _by_bucket(rare, buckets):
                    rows.append((k, _SHARE, r["part"], _pack(_steps(rare[i]), here[0][i].astype("<u8"), here[1][i].astype("<u4"), *[x[i] for x in own])))
                yield _batch(rows)

    def totals(batches):
        t, p, _ = held.value
        told, after, bucket = [], None, None
        for b in batches:
            for r in b.to_pylist():
                if r["kind"] == _STATS:
                    yield _batch([(r["part"], _STATS, 0, r["data"])])
                    continue
                bucket = r["part"]
                if r["kind"] == _SHARE:
                    share, *sums = _unpack(r["data"], "<u8", "<u8", "<u4", *["<u4"] * s.samples)
                    told.append((r["slice"], np.cumsum(share, dtype="u8"), *sums))
                else:
                    after = _bucket(r["data"])
        if bucket is None:
            return
        mine = after[7] if after else np.zeros(0, "<u8")
        all_ = np.unique(np.concatenate([mine, *[x[1] for x in told]]))
        counts, types, tables = np.zeros(len(all_)), np.zeros(len(all_)), np.zeros((s.samples, len(all_)))
        places = [np.searchsorted(all_, x[1]) for x in told]
        for at, (_, _, n, k, *sums) in zip(places, told):
            counts[at] += n
            types[at] += k
            for j, x in enumerate(sums):
                tables[j, at] += x
        if after:
            at = np.searchsorted(all_, mine)
            c, w, n = after[2:5]
            for total, x in ((counts, n), (types, n > 0)):
                total[at] += np.bincount(c, weights=x, minlength=len(mine))
            by_word = []
            found = sample_below(p[w], c, n, replace(t, context_tables=types[at]), s, _bucket_seed(s, bucket) + _AFTER_SEED)
            for j, x in enumerate(found):
                tables[j, at] += np.bincount(c, weights=x, minlength=len(mine))
                by_word.append(np.bincount(w, weights=x, minlength=s.hot + 1))
            yield _batch([(bucket, _OWN, 0, _pack(counts[at], types[at], *tables[:, at])), (bucket, _AFTER_STATS, 0, _pack(np.concatenate(by_word)))])
        yield _batch([(to, _TOLD, bucket, _pack(counts[at].astype("<u8"), *tables[:, at].astype("<u8"))) for at, (to, *_) in zip(places, told)])

    rows = map_batches(counted.where(F.col("kind") == _RARE), shares, _ROW).unionByName(counted.where(F.col("kind") == _AFTER))
    return materialize(map_batches(rows.repartitionById(buckets, F.col("part")), totals, _ROW), "totals", "kind").select("part", "kind", "slice", "data")


def _summed(rows: DataFrame, kind: int, *types: str) -> list[np.ndarray]:
    """Sums of the arrays of all rows of a kind. They are added up where they lie, so the driver gets one row for each file
    partition that is read; all have one (fixed) size."""

    def add(batches):
        total = None
        for b in batches:
            for data in b.column("data").to_pylist():
                found = _unpack(data, *types)
                total = found if total is None else [a + f for a, f in zip(total, found)]
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([_pack(*total)], pa.binary())], ["data"])

    found = [_unpack(r.data, *types) for r in map_batches(rows.where(F.col("kind") == kind).select("data"), add, "data binary").collect()]
    return [sum(x) for x in zip(*found)]


def score_documents(docs: DataFrame, settings: Settings | None = None) -> DataFrame:
    """Score every whole text: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Training texts are those that aren't held out (see ``is_held_out``). Tokens: lower-cased words between blanks, then
    one end. base_score: add-one unigram; score: log10 probability of the text under the Pitman-Yor model.

    Null and empty texts have the end token only. Null doc_ids train. Repeated rows are counted and scored each; rows
    of one doc_id with different texts are told apart. An empty table gives an empty one, and without training texts
    all words are unknown. Passes over the texts: frequent words, counts, scores. Tokens that are rare or follow a rare
    word are shuffled twice, bucket by bucket of about ``bucket_tokens``; frequent words after frequent ones never are.
    """
    s = settings or Settings()
    spark = docs.sparkSession
    hot, n_all = frequent_words(docs, s.hot)
    buckets = max(s.least_buckets, -(-n_all // s.bucket_tokens))
    counted = _count(docs, hot, buckets, s)

    width = (s.hot + 2) * s.contexts
    table = np.zeros(-(-width // _SLICE) * _SLICE, "i8")
    for r in counted.where(F.col("kind") == _TABLE).select("slice", "data").collect():  # a table of fixed size
        table[r.slice * _SLICE : (r.slice + 1) * _SLICE] += _unpack(r.data, "<i8")[0]
    table = table[:width].reshape(s.hot + 2, s.contexts)
    context_counts, table = table[-1], table[:-1]
    stats, seen = np.zeros(7, "i8"), (table > 0).sum(0)
    after, after_seen, after_count = np.zeros(2, "i8"), np.zeros(s.hot + 1, "i8"), np.zeros(s.hot + 1, "i8")
    if found := _summed(counted, _STATS, "<i8", "<i8"):
        stats, seen = found[0], seen + found[1]
    if found := _summed(counted, _AFTER_STATS, "<i8", "<i8", "<i8"):
        after, after_seen, after_count = found
    by_word = table.sum(1) + after_count
    vocabulary = int(stats[0] + (by_word > 0).sum())
    n_train = int(by_word.sum() + stats[5])
    ones, twos = stats[1] + after[0] + (table == 1).sum(), stats[2] + after[1] + (table == 2).sum()
    types = float((table > 0).sum() + after_seen.sum() + stats[6])
    share = lambda a, b: float(min(0.95, max(0.05, a / (a + 2 * b)))) if a else 0.5
    start = Totals(
        context_counts.astype("f8"), seen.astype("f8"), types, float(vocabulary), vocabulary,
        share(ones, twos), share(stats[3], stats[4]),
    )
    word, ctx = np.nonzero(table)
    counts = table[word, ctx]
    word_c, ctx_c = np.divmod(np.arange(table.size), s.contexts)

    # frequent words' root customers are estimated first; rare words', of which each bucket has a share, grow from one for each pair
    rare_types = float(stats[6])
    start_p, still = _settled(word, ctx, counts, after_seen, after_count, start, rare_types, s)
    of_rare, of_hot = replace(start, root_customers=rare_types), replace(start, root_customers=types - rare_types)
    told = _sweep(counted, buckets, of_rare, start_p, still, s)
    by_context, root = np.zeros((s.samples, s.contexts)), np.zeros((s.samples, 2))
    if found := _summed(told, _STATS, "<f8", "<f8"):
        by_context, root = found[0].reshape(s.samples, -1), found[1].reshape(s.samples, 2)
    found = _summed(told, _AFTER_STATS, "<f8")
    after_tables = list(found[0].reshape(s.samples, -1)) if found else [np.zeros(s.hot + 1)] * s.samples
    totals, hot_p, seats = [], [], []
    for k, (own, customers, root_tables) in enumerate(sample(word, ctx, counts, of_hot, s, s.seed + _TABLE_SEED, after_tables, float(after_seen.sum()), rare_types)):
        totals.append(replace(
            start, context_tables=by_context[k] + np.bincount(ctx, weights=own, minlength=s.contexts),
            root_customers=root[k, 0] + customers.sum(), root_tables=root[k, 1] + root_tables.sum(),
        ))
        hot_p.append(totals[-1].root(customers, root_tables, s))
        full = np.zeros(table.shape)
        full[word, ctx] = own
        seats.append((full.ravel(), customers, root_tables))
    hot_scores = predict(seats, word_c, ctx_c, table.ravel(), totals, s).reshape(table.shape)
    buckets_rows = counted.where(F.col("kind").isin(_RARE, _AFTER)).unionByName(told.where(F.col("kind").isin(_TOLD, _OWN)))
    return _scores(docs, buckets_rows.repartitionById(buckets, F.col("part")), buckets, hot, hot_scores, (of_rare, start_p, still), hot_p, by_word, totals, n_train, s)


_SUM = [("doc", "<i8"), ("text", "<u4"), ("rows", "<i4"), ("tokens", "<i8"), ("known", "<i8"), ("ones", "<f8"), ("score", "<f8")]


def _scores(docs, rare, buckets: int, hot, hot_scores, begun, hot_p, by_word, totals: list[Totals], n_train: int, s: Settings) -> DataFrame:
    """Sums of frequent and rare tokens for each document, dealt by document and added up."""
    parts = text_partitions(docs)
    sc = docs.sparkSession.sparkContext
    shared = sc.broadcast((Reader(hot, s), hot_scores, np.log10(by_word + 1.0), by_word > 0))
    held = sc.broadcast((*begun, totals, hot_p))

    def deal(sums: dict[str, np.ndarray]):
        part = ((sums["doc"].astype("u8") * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)) % np.uint64(parts)
        order = np.argsort(part, kind="stable")
        return _batch([(k, 0, 0, _pack(*[sums[n][order[i:j]].astype(t) for n, t in _SUM])) for k, i, j in _runs(part[order])])

    def from_texts(batches):
        reader, scores, log_counts, is_known = shared.value
        for b in batches:
            out = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                w, ctx, _ = reader.tokens(text)
                k = w[w >= 0]
                own = (w >= 0) & (ctx >= 0)
                out.append((_doc_number(doc), zlib.crc32(text or b""), 1, len(w), is_known[k].sum(), log_counts[k].sum(), scores[w[own], ctx[own]].sum()))
            if out:
                yield deal({n: np.array([r[i] for r in out], t) for i, (n, t) in enumerate(_SUM)})

    def from_rare(batches):
        t, p, still, each, hot = held.value
        of, told, own, bucket = {}, {}, None, None
        for b in batches:
            for r in b.to_pylist():
                bucket = r["part"]
                if r["kind"] == _TOLD:
                    told[r["slice"]] = _unpack(r["data"], *["<u8"] * (1 + s.samples))
                elif r["kind"] == _OWN:
                    own = _unpack(r["data"], *["<f8"] * (2 + s.samples))
                else:
                    of[r["kind"]] = r["data"]
        for kind, data in of.items():
            ids, texts, key, other, n, pair, d, rare = _bucket(data)
            seed, size = _bucket_seed(s, bucket), len(ids)
            add = lambda x: np.bincount(d, weights=x[pair], minlength=size)  # noqa: B023, E731
            zero = np.zeros(size, "i8")
            if kind == _RARE:
                counts, tables = np.zeros(len(rare)), np.zeros((s.samples, len(rare)))
                for k, at in _by_bucket(rare, buckets):
                    counts[at], *sums = told[k]
                    tables[:, at] = sums
                w = key.astype("i8")
                by = np.bincount(w, weights=n)[w]
                seats = sample(w, other, n, _with_rare(t, *_own_start(other, n, s.contexts, len(rare))), s, seed, still=still)
                score = add(predict(seats, w, other, n, [_with_rare(x, counts, tables[k]) for k, x in enumerate(each)], s))
                known, ones = add((by > 0) * 1.0), add(np.log10(by + 1))
            else:
                counts, types, *tables = own
                seats = sample_below(p[other], key, n, replace(t, context_tables=types), s, seed + _AFTER_SEED)
                score = add(predict_below(seats, [x[other] for x in hot], key, n, [replace(x, context_tables=k, context_counts=counts) for x, k in zip(each, tables)], s))
                known = ones = zero
            yield deal({"doc": ids, "text": texts, "rows": zero, "tokens": zero, "known": known, "ones": ones, "score": score})

    norm = np.log10(n_train + begun[0].vocabulary + 1.0)

    def total(batches):
        parts_ = [_unpack(x, *[t for _, t in _SUM]) for b in batches for x in b.column(3).to_pylist()]
        if not parts_:
            return
        sums = {n: np.concatenate([p[i] for p in parts_]) for i, (n, _) in enumerate(_SUM)}
        order = np.lexsort((sums["text"], sums["doc"]))
        sums = {n: x[order] for n, x in sums.items()}
        at = np.flatnonzero(np.r_[True, (np.diff(sums["doc"]) != 0) | (np.diff(sums["text"].astype("i8")) != 0)])
        rows = np.add.reduceat(sums["rows"], at)
        doc, text_rows = sums["doc"][at], np.maximum(rows, 1)
        tokens, known = (np.add.reduceat(sums[n], at) for n in ("tokens", "known"))
        ones, score = (np.add.reduceat(sums[n], at) / text_rows for n in ("ones", "score"))
        tokens, known = tokens // text_rows, known // text_rows
        base = ones - tokens * norm
        again = np.repeat(np.arange(len(doc)), rows)  # equal rows have equal scores
        none = doc[again] == -(1 << 63)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(doc[again], pa.int64(), mask=none), pa.array([not n and is_held_out(x) for x, n in zip(doc[again].tolist(), none.tolist())], pa.bool_()),
                pa.array(tokens[again]), pa.array(known[again]), pa.array(np.full(len(again), n_train)), pa.array(base[again]), pa.array(score[again]),
            ],
            ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    texts = map_batches(text_frame(docs), from_texts, _ROW)
    dealt = texts.unionByName(map_batches(rare, from_rare, _ROW)).repartitionById(parts, F.col("part"))
    return map_batches(
        dealt, total, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )
