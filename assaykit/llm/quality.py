"""Quality classifier with hierarchical empirical Bayes over hosts and paths."""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import FOLD, map_batches, materialize, small_batches

#: The operator's struct column.
RESULT = "quality_evidence"
_LETTERS = bytes(range(65, 91)) + bytes(range(97, 123))
_UPPERS = bytes(range(65, 91))
_NOISE = b"#$%&*=~^<>{}[]\\+@_"


def features(text: bytes | None) -> list[float]:
    """Shares that tell prose from noise, over the whole text; all 0 for null and empty texts but the last."""
    text = text or b""
    words = text.translate(FOLD).split()
    n, size = len(words), max(1, len(text))
    if not n:
        return [0.0] * 11 + [1.0]
    count = Counter(words)
    left = [size - len(text.translate(None, drop)) for drop in (_LETTERS, _UPPERS, _NOISE, b"|", b"!", b".,;:?", b"0123456789")]
    runs = sum(map(bytes.__eq__, words, words[1:]))
    # distinct words against what prose of this length has, so that long texts aren't blamed for their length
    variety = len(count) / n**0.86
    top = count.most_common(1)[0][1] / (n + 10)
    return [
        math.log1p(n) / 8, variety, runs / n, top, left[1] / max(1, left[0]), left[2] / size * 10, left[3] / n,
        left[4] / n, left[5] / n, left[6] / size * 5, (size - n) / n / 10, 0.0,
    ]


@dataclass(frozen=True)
class QualityModel:
    """Weights of a logistic regression on standardised ``features`` and their pairwise squares."""

    mean: tuple
    scale: tuple
    weights: tuple

    def logits(self, rows: np.ndarray) -> np.ndarray:
        x = np.clip((rows - self.mean) / self.scale, -8, 8)
        return np.clip(_expand(x) @ np.array(self.weights), -12, 12)


def _expand(x: np.ndarray) -> np.ndarray:
    return np.concatenate([np.ones((len(x), 1)), x, x**2 / 4], axis=1)


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, ridge: float = 1.0) -> QualityModel:
    """Fit the document classifier on at most ``max_rows`` labelled documents (quality 1 or 0).

    The sample is the labels with the smallest hashes of doc_id: bounded, repeatable, free of any order in the table.
    Labels without quality or document are left out; without any rows the classifier knows nothing (logit 0).
    """
    sample = (
        labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
        .select("doc_id", F.col("quality").alias("y"))
        .distinct()
        .orderBy(F.xxhash64("doc_id"), "doc_id", "y")
        .limit(max_rows)
    )

    def run(batches):
        for b in batches:
            rows = [features(t) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), b.column(1)], ["x", "y"])

    # the sample has max_rows rows at most, so sending it to all executors is bounded
    texts = small_batches(docs).join(F.broadcast(sample), "doc_id").select(F.col("text").cast("binary").alias("text"), F.col("y").cast("int").alias("y"))
    found = map_batches(texts, run, "x array<double>, y int").limit(2 * max_rows).toPandas()
    width = len(features(None))
    if not len(found):
        return QualityModel((0.0,) * width, (1.0,) * width, (0.0,) * (2 * width + 1))
    x, y = np.array(found.x.tolist()), found.y.to_numpy(float)
    order = np.lexsort([*x.T, y])  # rows arrive in any order; sums shouldn't depend on it
    x, y = x[order], y[order]
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-3)
    z = _expand(np.clip((x - mean) / scale, -8, 8))
    w, penalty = np.zeros(z.shape[1]), np.r_[0.0, np.full(z.shape[1] - 1, ridge)]
    for _ in range(30):  # Newton steps
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z * (p * (1 - p) + 1e-6)[:, None]).T @ z + np.diag(penalty + 1e-9)
        step = np.linalg.solve(h, z.T @ (y - p) - penalty * w)
        w += step * min(1.0, 4 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return QualityModel(tuple(mean.tolist()), tuple(scale.tolist()), tuple(w.tolist()))


def _evidence(docs: DataFrame, model: QualityModel, carried: list[str]) -> DataFrame:
    """The ``carried`` columns of ``docs`` with ``__logit``, the classifier's log odds."""
    own = [c for c in carried if c != "text"]

    def run(batches):
        for b in batches:
            texts = b.column("text").cast(pa.binary()).to_pylist()
            made = model.logits(np.array([features(t) for t in texts])) if texts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in carried], pa.array(made, pa.float64())], [*carried, "__logit"])

    schema = T.StructType([*[docs.schema[c] for c in carried], T.StructField("__logit", T.DoubleType())])
    return map_batches(small_batches(docs).select(*own, "text"), run, schema)


def _strength(sites: DataFrame, prior: F.Column) -> float:
    """Strength (in documents) of the prior, by the method of moments: sites that differ little are shrunk a lot.

    sites: n and good (expected good documents) of each site. One row of sums comes to the driver.
    """
    r = sites.select("n", (F.col("good") / F.col("n")).alias("rate"), prior.alias("m")).agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("nn"), F.count("*").alias("sites"),
        F.sum(F.col("n") * (F.col("rate") - F.col("m")) ** 2).alias("between"), F.sum(F.col("n") * F.col("m") * (1 - F.col("m"))).alias("within"),
    ).first()
    if not r.n or r.sites < 2 or r.n <= r.nn / r.n:
        return 1e6
    noise = r.within / r.n
    spread = (r.between - (r.sites - 1) * noise) / (r.n - r.nn / r.n)
    return 1e6 if spread <= 0 else float(min(1e6, max(1.0, noise / spread - 1)))


def site_posteriors(evidence: DataFrame, host: str, path: str) -> tuple[DataFrame, float]:
    """host, path, host_posterior and path_posterior for each site, the sums behind them (n, good, host_n, host_good) with the strengths of
    the priors (k_host, k_path), and the global prior.

    Paths shrink towards their host, hosts towards the global rate. Grouped sums with map-side combining, so a host with
    a third of all rows costs one row from each task.
    """
    paths = materialize(
        evidence.groupBy(F.col(host).alias("host"), F.col(path).alias("path")).agg(
            F.count("*").cast("double").alias("n"), F.sum(1 / (1 + F.exp(-F.col("__logit")))).alias("good")
        ),
        "paths",
    )
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    total = paths.agg(F.sum("n").alias("n"), F.sum("good").alias("good")).first()
    prior = min(1 - 1e-4, max(1e-4, total.good / total.n)) if total.n else 0.5
    k_host = _strength(hosts, F.lit(prior))
    hosts = hosts.select(
        F.col("host").alias("h"), F.col("n").alias("host_n"), F.col("good").alias("host_good"),
        ((F.col("good") + k_host * prior) / (F.col("n") + k_host)).alias("host_posterior"), F.lit(k_host).alias("k_host"),
    )
    both = paths.join(hosts, F.col("host").eqNullSafe(F.col("h"))).drop("h")
    k_path = _strength(both, F.col("host_posterior"))
    posterior = (F.col("good") + k_path * F.col("host_posterior")) / (F.col("n") + k_path)
    sums = ["n", "good", "host_n", "host_good", "k_host", F.lit(k_path).alias("k_path")]
    return materialize(both.select("host", "path", "host_posterior", posterior.alias("path_posterior"), *sums), "sites"), prior


def _without(p: F.Column, prior: float) -> tuple[F.Column, F.Column]:
    """Posteriors of a document's host and path as the other documents there make them: its own probability ``p`` is taken out."""
    site = F.col("__site")
    host = (site["host_good"] - p + site["k_host"] * prior) / (site["host_n"] - 1 + site["k_host"])
    return host, (site["good"] - p + site["k_path"] * host) / (site["n"] - 1 + site["k_path"])


def classify(
    docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", threshold: float = 0.5,
    max_rows: int = 20_000, broadcast_sites: int = 100_000, model: QualityModel | None = None, carried: list[str] | None = None,
) -> DataFrame:
    """``docs`` (or its columns ``carried``) with a struct column ``quality_evidence``: logit, host_posterior, path_posterior,
    score, keep. Texts are judged once: the rows and their log odds are written, then summed by site and joined with the sums.

    score: the classifier's log odds plus the site's log odds against the global rate, as a probability; keep: score of
    ``threshold`` or more. A site without much evidence has its host's rate, a host without much the global one. What a
    document says itself is taken out of its site's and its host's evidence, so that it counts once.

    Null text and empty text have the same features and are judged like others. Null hosts and paths are sites of their
    own. Rows are judged one by one, so repeated rows get equal scores; documents without labels are judged too; an
    empty table gives an empty one. Another column named ``quality_evidence`` is replaced. Sites are broadcast up to
    ``broadcast_sites`` rows; beyond that they are joined by shuffling, where AQE splits hot sites.
    """
    docs = docs.drop(RESULT)
    model = model or fit(docs, labels, max_rows)
    kept = [c for c in docs.columns if carried is None or c in carried]
    seen = docs.withColumns({"__host": F.col(host), "__path": F.col(path)})
    scored = materialize(_evidence(seen, model, [*kept, "__host", "__path"]), "evidence")
    sites, prior = site_posteriors(scored, "__host", "__path")
    sums = ["n", "good", "host_n", "host_good", "k_host", "k_path"]
    sites = sites.select(F.col("host").alias("__h"), F.col("path").alias("__p"), F.struct(*sums).alias("__site"))
    if sites.count() <= broadcast_sites:
        sites = F.broadcast(sites)
    scored = scored.join(sites, F.col("__host").eqNullSafe(F.col("__h")) & F.col("__path").eqNullSafe(F.col("__p")), "left")
    hp, pp = _without(1 / (1 + F.exp(-F.col("__logit"))), prior)
    scored = scored.withColumn("__hp", hp).withColumn("__pp", pp)
    odds = F.col("__logit") + F.log(F.col("__pp") / (1 - F.col("__pp"))) - F.lit(math.log(prior / (1 - prior)))
    score = 1 / (1 + F.exp(-odds))
    return scored.withColumn(
        RESULT,
        F.struct(
            F.col("__logit").alias("logit"), F.col("__hp").alias("host_posterior"), F.col("__pp").alias("path_posterior"),
            score.alias("score"), (score >= threshold).alias("keep"),
        ),
    ).select(*kept, RESULT)


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The documents that ``classify`` keeps, with their own columns."""
    return classify(docs, labels, **options).where(F.col(f"{RESULT}.keep")).select(*[c for c in docs.columns if c != RESULT])
