"""The queries ``opN_<name>``: each operator over its whole table, and its DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, fingerprints, hamming, jaccard, licenses, linededup, lm, negatives, oracles, packing, quality, tokenstore, urlfilter, zonecluster
from .common import shared_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), carried=["doc_id", "source", "lang"])
    r = F.col(quality.RESULT)
    return q.select("doc_id", "source", "lang", r.logit.alias("logit"), r.host_posterior.alias("host_posterior"),
                    r.path_posterior.alias("path_posterior"), r.score.alias("score"), r.keep.alias("keep"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents")).drop("matches")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = F.col(linededup.RESULT)
    return linededup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", r.n_lines.alias("n_lines"), r.n_deleted.alias("n_deleted"), F.sha2(r.text, 256).alias("kept_sha256"),
        (r.n_deleted > 0).alias("changed"),
    )


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link_groups(table(spark, sf_dir, "documents"), size=4, percent=85)


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_edits(table(spark, sf_dir, "documents"))


def op7_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(table(spark, sf_dir, "documents"))


#: The query's list: (entry, action, day of the event, in days from ``EPOCH``). The pages table has no fetch times, so a
#: page is taken to be fetched ``page_id mod 366`` days after ``EPOCH``.
EPOCH = "2024-01-01"
LIST_EVENTS = [
    ("spam-farm.example.org", "add", 10), ("spam-farm.example.org", "remove", 90), ("spam-farm.example.org", "add", 200),
    ("cheap-pills.example.com", "add", 45), ("casino-win.example.com", "add", 0), ("casino-win.example.com", "remove", 300),
    ("free-bets.example.com", "add", 120), ("free-bets.example.com", "remove", 121), ("tionsh.example.com/en", "add", 60),
    ("tionble.example.org/en", "add", 30), ("tionble.example.org", "add", 150), ("tionble.example.org", "remove", 250),
    ("tionsh.example.net/de", "add", 5), ("tionsh.example.net/de", "remove", 200), ("example.net/es", "add", 330),
]


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.date_add(F.lit(EPOCH).cast("date"), F.pmod(F.col("page_id"), F.lit(366)).cast("int"))
    captures = table(spark, sf_dir, "pages").select("page_id", "url", day.cast("timestamp").alias("fetched"))
    events = spark.createDataFrame(LIST_EVENTS, "entry string, action string, day int").select(
        "entry", "action", F.date_add(F.lit(EPOCH).cast("date"), F.col("day")).cast("timestamp").alias("on")
    )
    text = lambda c: F.date_format(c, "yyyy-MM-dd")
    found = urlfilter.filter_urls(captures, events)
    return found.select("page_id", "host", text("fetched").alias("fetched"), "n_active", "entry", text("since").alias("since"), "blocked")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontam.contamination_digest(decontam.mark_contamination(docs, table(spark, sf_dir, "benchmark")))


def op10_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "tokens")
    tokenstore.write_token_store(table(spark, sf_dir, "documents"), path, vocabulary("byte_bpe_50k.json"), end_id=2)
    return tokenstore.read_token_store(spark, path, with_ids=False)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.col("label").cast("long")
    vectors = table(spark, sf_dir, "embeddings").withColumn("label", F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label))
    return negatives.mine_negatives(vectors)


def op12_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hamming.near_duplicates(table(spark, sf_dir, "documents"), size=4, percent=80)


def op13_zone_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zonecluster.cluster(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_quality_classifier, op2_license_scan, op3_best_fit_packing, op4_line_dedup, op5_jaccard_join, op6_fingerprints, op7_pitman_yor,
        op8_url_filter, op9_decontamination, op10_token_planes, op11_hard_negatives, op12_minhash_dedup, op13_zone_clusters,
    )}


def oracle_sql() -> dict[str, str]:
    """The others have none: a fitted classifier, a genetic algorithm, graph components, chunk digests, sampling and
    tokenizers aren't expressible in SQL, and are tested against brute force, round trips or held-out texts."""
    return {
        "op2_license_scan": oracles.license_sql(),
        "op4_line_dedup": oracles.LINE_DEDUP,
        "op8_url_filter": oracles.url_filter_sql(EPOCH, LIST_EVENTS),
        "op9_decontamination": oracles.DECONTAMINATION,
        "op11_hard_negatives": oracles.HARD_NEGATIVES,
        "op13_zone_clusters": oracles.zone_clusters_sql(),
    }
