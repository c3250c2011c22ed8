"""Usage, cost, quality and monitoring figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Dollars for a million tokens of chat, and for a thousand of extraction.
CHAT_COST_PER_MILLION, COST_PER_THOUSAND = 45.0, 0.008
TOKEN_ALERT, COST_ALERT = 10_000, 1.0


def usage_daily(calls: DataFrame, keys: list[str], at: str = "ts", tokens: str = "tokens", cached: str = "cached") -> DataFrame:
    """Requests, calls, tokens, cache hits, cost and hit rate of each group and day."""
    paid = ~F.col(cached)
    return usage_columns(calls.groupBy(*keys, F.to_date(at).alias("day")).agg(
        F.count("*").alias("requests"), F.count_if(paid).alias("calls"), F.count_if(F.col(cached)).alias("cache_hits"),
        F.coalesce(F.sum(F.when(paid, F.col(tokens))), F.lit(0)).cast("long").alias("tokens"),
    ))


def usage_columns(daily: DataFrame) -> DataFrame:
    return daily.withColumns({
        "cost": F.col("tokens") * CHAT_COST_PER_MILLION / 1e6,
        "hit_rate": F.coalesce(F.try_divide(100.0 * F.col("cache_hits"), F.col("requests")), F.lit(0.0)),
    })


def usage_alerts(daily: DataFrame) -> DataFrame:
    reason = F.concat_ws(",", F.when(F.col("tokens") > TOKEN_ALERT, "tokens"), F.when(F.col("cost") > COST_ALERT, "cost"))
    return daily.withColumn("reasons", reason).where("reasons != ''")


def token_summary(calls: DataFrame, before: str, after: str, found: str, keys: list[str] | None = None) -> DataFrame:
    """Token reduction, its cost, and means for a call and a measurement."""
    b, a, n, m = F.sum(before), F.sum(after), F.count("*"), F.coalesce(F.sum(found), F.lit(0))
    return calls.groupBy(*(keys or [])).agg(
        (b - a).alias("saved"), F.coalesce(F.try_divide(100.0 * (b - a), b), F.lit(0.0)).alias("reduction_pct"), (a / 1000 * COST_PER_THOUSAND).alias("cost"),
        (a / F.greatest(n, F.lit(1))).alias("tokens_per_call"), (a / F.greatest(m, F.lit(1))).alias("tokens_per_measurement"),
    )


def precision_recall(df: DataFrame, predicted: Column, actual: Column, score: Column) -> DataFrame:
    """True and false positives, false negatives, precision, recall, F1 and mean score; 0 where there is nothing to divide."""
    t = df.agg(
        F.count_if(predicted & actual).alias("tp"), F.count_if(predicted & ~actual).alias("fp"), F.count_if(~predicted & actual).alias("fn"),
        F.coalesce(F.avg(score), F.lit(0.0)).alias("mean_score"),
    )
    ratio = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), b), F.lit(0.0))
    t = t.withColumns({"precision": ratio("tp", F.col("tp") + F.col("fp")), "recall": ratio("tp", F.col("tp") + F.col("fn"))})
    return t.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))


def confidence_buckets(score: Column) -> Column:
    """very_high from 0.9, high from 0.7, medium from 0.5, low from 0.3, else very_low."""
    return F.when(score >= 0.9, "very_high").when(score >= 0.7, "high").when(score >= 0.5, "medium").when(score >= 0.3, "low").otherwise("very_low")


def monitor_trend(points: DataFrame, keys: list[str], order: str, value: str, width: int = 5, least: int = 3) -> DataFrame:
    """Direction over the last ``width`` points: 10 per cent above the first of them improves, below declines."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(1 - width, 0)
    first, n = F.first(value).over(w), F.count("*").over(w)
    verdict = F.when(n < least, "insufficient").when(F.col(value) > first * 1.1, "improving").when(F.col(value) < first * 0.9, "declining").otherwise("stable")
    return points.withColumn("trend", verdict)


def performance_report(runs: DataFrame, reduction: str, accuracy: str, seconds: str, found: str) -> DataFrame:
    """Means and extremes of runs, and what to look at."""
    figures = [f(c).alias(f"{c}_{n}") for c in (reduction, accuracy, seconds, found) for n, f in (("avg", F.avg), ("min", F.min), ("max", F.max))]
    advice = F.array_compact(F.array(
        F.when(F.col(f"{reduction}_avg") < 15, "token reduction is below 15 %"), F.when(F.col(f"{accuracy}_avg") < 0.85, "accuracy is below 0.85"),
        F.when(F.col(f"{seconds}_avg") > 300, "runs take more than 300 s"), F.when(F.col(f"{found}_avg") < 5, "runs find fewer than 5 measurements"),
    ))
    return runs.agg(*figures).withColumn("advice", advice)


def mode_metrics(chunks: DataFrame, mode: str, before: str, after: str, score: str) -> DataFrame:
    """Token reduction, mean confidence, confident chunks and mean size for each mode."""
    return chunks.groupBy(mode).agg(
        F.count("*").alias("n"), F.coalesce(F.try_divide(100.0 * (F.sum(before) - F.sum(after)), F.sum(before)), F.lit(0.0)).alias("reduction_pct"),
        F.avg(score).alias("mean_confidence"), F.count_if(F.col(score) >= 0.7).alias("confident"), F.avg(after).alias("mean_tokens"),
    )


def best_modes(modes: DataFrame, mode: str) -> DataFrame:
    return modes.agg(
        F.max_by(mode, F.struct("reduction_pct", mode)).alias("best_reduction"), F.max_by(mode, F.struct("mean_confidence", mode)).alias("best_accuracy")
    )


def counter_deltas(snapshots: DataFrame, order: str, *counters: str, keys: list[str]) -> DataFrame:
    """What each counter gained since the snapshot before, within ``keys`` (a cache, a run): series are told apart, and no task
    gets all snapshots."""
    w = Window.partitionBy(*keys).orderBy(order)
    return snapshots.withColumns({f"{c}_delta": F.col(c) - F.coalesce(F.lag(c).over(w), F.lit(0)) for c in counters})


def mean_confidence(reports: DataFrame, found: DataFrame, report: str, score: str) -> DataFrame:
    """Reports with parsing_confidence: the mean of their measurements' scores, of which a missing one counts 0; 0 without any."""
    mean = found.groupBy(report).agg(F.avg(F.coalesce(score, F.lit(0.0))).alias("parsing_confidence"))
    return reports.join(mean, report, "left").withColumn("parsing_confidence", F.coalesce("parsing_confidence", F.lit(0.0)))


def skip_report(chunks: DataFrame, keys: list[str], kept: str, reason: str, score: str, tokens: str) -> tuple[DataFrame, DataFrame]:
    """What a screen did: (totals and a histogram of scores for each group, skipped chunks of each reason)."""
    gone = ~F.col(kept)
    bucket = F.when(F.col(score) >= 0.8, "high").when(F.col(score) >= 0.6, "medium").when(F.col(score) >= 0.4, "low").otherwise("very_low")
    totals = chunks.groupBy(*keys).agg(
        F.count("*").alias("total_chunks"), F.count_if(gone).alias("skipped"), F.count_if(~gone).alias("processed"),
        *[F.count_if(bucket == b).alias(b) for b in ("high", "medium", "low", "very_low")], F.coalesce(F.sum(F.when(gone, F.col(tokens))), F.lit(0)).cast("long").alias("token_savings"),
    )
    return totals, chunks.where(gone).groupBy(*keys, reason).agg(F.count("*").alias("n"))


def lab_benchmark(runs: DataFrame, lab: str, reduction: str, accuracy: str, failed: str) -> DataFrame:
    """Labs tested, failed, means of the others, and the labs of most and least reduction (the first of equals by name)."""
    ok = ~F.col(failed)
    good = lambda c: F.when(ok, F.col(c))
    pick = lambda order: F.min_by(F.when(ok, F.col(lab)), F.when(ok, order))
    return runs.agg(
        F.count("*").alias("labs"), F.count_if(ok).alias("successful"), F.count_if(~ok).alias("failed"), F.coalesce(F.avg(good(reduction)), F.lit(0.0)).alias("mean_reduction"),
        F.coalesce(F.avg(good(accuracy)), F.lit(0.0)).alias("mean_accuracy"), pick(F.struct(-F.col(reduction), F.col(lab))).alias("best_lab"), pick(F.struct(F.col(reduction), F.col(lab))).alias("worst_lab"),
    )


def bounded_history(points: DataFrame, keys: list[str], order: str, most: int = 1000) -> DataFrame:
    """The newest ``most`` points of each series."""
    w = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    return points.withColumn("__k", F.row_number().over(w)).where(F.col("__k") <= most).drop("__k")


def cache_stats(log: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Hits count found patterns, so the hit rate of extractions (hit_patterns long, confidence double) may exceed 1."""
    hits = F.coalesce(F.sum("hit_patterns"), F.lit(0))
    return log.groupBy(*(keys or [])).agg(
        F.count("*").alias("extractions"), hits.alias("hits"), F.count_if(F.col("hit_patterns") == 0).alias("misses"),
        F.coalesce(F.try_divide(hits.cast("double"), F.count("*")), F.lit(0.0)).alias("hit_rate"), F.avg("confidence").alias("mean_confidence"),
    )
