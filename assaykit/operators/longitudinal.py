"""Series over time: trends, latest and previous values, daily summaries, tiles, summaries in words."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import one_decimal, percent_change, trend

# In which direction a named series improves.
RISING_IS_BETTER = ["hdl"]
FALLING_IS_BETTER = ["ldl", "triglycerides", "total cholesterol"]


def trends(readings: DataFrame, keys: list[str], at: str = "ts", value: str = "value", tie: str = "reading_id", least: int = 2, band: float = 5.0) -> DataFrame:
    """First and last value of each series, its change in per cent and direction. One grouped pass with map-side combining;
    equal times are told apart by ``tie``."""
    when = F.struct(at, tie)
    found = readings.groupBy(*keys).agg(
        F.count("*").alias("n"), F.min_by(value, when).alias("first_value"), F.max_by(value, when).alias("last_value"),
        F.min(at).alias("first_at"), F.max(at).alias("last_at"),
    )
    change = percent_change(F.col("first_value"), F.col("last_value"))
    return (
        found.where(F.col("n") >= least)
        .withColumn("change_pct", change)
        .withColumn("direction", F.when(F.col("change_pct") > band, "increasing").when(F.col("change_pct") < -band, "decreasing").otherwise("stable"))
    )


def improving(name: F.Column, direction: F.Column) -> F.Column:
    lower = F.lower(name)
    return F.when(lower.isin(RISING_IS_BETTER), direction == "increasing").when(lower.isin(FALLING_IS_BETTER), direction == "decreasing").when(
        lower == "glucose", direction == "stable"
    )


def latest_previous(readings: DataFrame, keys: list[str], at: str = "ts", value: str = "value", tie: str = "reading_id") -> DataFrame:
    """Latest and previous value of each series, and the trend between them."""
    w = Window.partitionBy(*keys).orderBy(F.col(at).desc(), F.col(tie).desc())
    two = readings.withColumns({"k": F.row_number().over(w), "previous": F.lead(value).over(w)}).where("k = 1")
    return two.select(*keys, F.col(value).alias("latest"), "previous", trend(F.col(value), F.col("previous")).alias("trend"))


def abnormal_recent(readings: DataFrame, keys: list[str], at: str, abnormal: str, now: F.Column, days: int = 30) -> DataFrame:
    """Measurements of each group, and how many abnormal ones there are of the last ``days`` days before ``now``."""
    since = now - F.make_dt_interval(days=F.lit(days))
    return readings.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(F.col(abnormal) & (F.col(at) >= since)).alias("abnormal_recent"))


def tiles(readings: DataFrame, keys: list[str], abnormal: str, category: str) -> DataFrame:
    """Measurements, abnormal ones and categories of each group; missing categories are one."""
    named = F.count_distinct(category) + F.max(F.col(category).isNull().cast("int"))
    return readings.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(abnormal).alias("abnormal"), named.alias("categories"))


def chart_series(readings: DataFrame, keys: list[str], at: str, value: str, unit: str, low: str, high: str, category: str, row_id: str) -> DataFrame:
    """What a chart of each series needs: times, values and ids in order, unit and range of the earliest row, the distinct
    categories in order of appearance (a missing one reads Uncategorized, a missing unit N/A). Missing times come first."""
    points = F.array_sort(F.collect_list(F.struct(F.coalesce(F.col(at).isNotNull(), F.lit(False)).alias("known"), F.col(at).alias("at"), F.col(row_id).alias("id"), F.col(value).alias("value"),
                                                  F.col(unit).alias("unit"), F.col(low).alias("low"), F.col(high).alias("high"), F.col(category).alias("category"))))
    one = readings.groupBy(*keys).agg(points.alias("p"))
    first = F.element_at("p", 1)
    return one.select(
        *keys, F.transform("p", lambda p: p["at"]).alias("times"), F.transform("p", lambda p: p["value"]).alias("values"), F.transform("p", lambda p: p["id"]).alias("ids"),
        F.coalesce(F.nullif(first["unit"], F.lit("")), F.lit("N/A")).alias("unit"), first["low"].alias("low"), first["high"].alias("high"),
        F.array_distinct(F.transform("p", lambda p: F.coalesce(F.nullif(p["category"], F.lit("")), F.lit("Uncategorized")))).alias("categories"),
    )


def series(readings: DataFrame, keys: list[str], at: str = "ts", value: str = "value", tie: str = "reading_id", low: float = 0.0, high: float = 0.0) -> DataFrame:
    """Ordered values of each series, and the axis that shows them with their range."""
    points = F.array_sort(F.collect_list(F.struct(at, tie, value)))
    found = readings.groupBy(*keys).agg(points.alias("points"), F.min(value).alias("least"), F.max(value).alias("most"))
    return found.select(
        *keys, F.transform("points", lambda p: p[value]).alias("values"), F.transform("points", lambda p: p[at]).alias("times"),
        (F.least("least", F.lit(low)) * 0.9).alias("axis_low"), (F.greatest("most", F.lit(high)) * 1.1).alias("axis_high"),
    )


def recent(readings: DataFrame, keys: list[str], at: str = "ts", days: int = 7) -> DataFrame:
    """Rows of at most ``days`` whole days before the newest of their group."""
    newest = F.max(at).over(Window.partitionBy(*keys))
    age = (F.unix_micros(newest.cast("timestamp")) - F.unix_micros(F.col(at).cast("timestamp"))) / 86_400_000_000
    return readings.where(age < days + 1) if not keys else readings.withColumn("__age", age).where(F.col("__age") < days + 1).drop("__age")


def by_day(readings: DataFrame, keys: list[str], at: str = "ts", name: str = "name") -> DataFrame:
    """Readings of each day, and their distinct names in ascending order."""
    return readings.groupBy(*keys, F.to_date(at).alias("day")).agg(
        F.count("*").alias("n"), F.concat_ws(", ", F.array_sort(F.collect_set(name))).alias("names")
    )


def favorite_tiles(readings: DataFrame, favorites: DataFrame, person: str, name: str, at: str, report: str, tiles: int = 8, boost: int = 3) -> DataFrame:
    """``tiles`` names of each person: favourites first, in their order, then names by distinct reports, with a boost
    where the person's newest reading is theirs."""
    newest = readings.groupBy(person).agg(F.max(at).alias("newest"))
    score = readings.join(newest, person).groupBy(person, name).agg(
        (F.count_distinct(report) + F.when(F.max(at) == F.max("newest"), boost).otherwise(0)).alias("score")
    )
    own = favorites.select(person, F.posexplode("favorites").alias("place", name))
    own = own.groupBy(person, name).agg(F.min("place").alias("place"))
    both = score.join(own, [person, name], "full").select(person, name, "place", F.coalesce("score", F.lit(0)).cast("long").alias("score"))
    w = Window.partitionBy(person).orderBy(F.col("place").asc_nulls_last(), F.col("score").desc(), F.col(name))
    return both.withColumn("tile", F.row_number().over(w)).where(F.col("tile") <= tiles)


def keep_context(readings: DataFrame, keys: list[str], order: list[F.Column], important: F.Column, most: int = 15) -> DataFrame:
    """Important rows, and others while fewer than ``most`` are kept: row k is kept if it is important or k <= most."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return readings.withColumn("__k", F.row_number().over(w)).where(important | (F.col("__k") <= most)).drop("__k")


def last_n(df: DataFrame, keys: list[str], order: list[F.Column], n: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__k", F.row_number().over(w)).where(F.col("__k") <= n).drop("__k")


def summary_text(readings: DataFrame, person: str, at: str = "ts", name: str = "name", value: str = "value", tie: str = "reading_id") -> DataFrame:
    """A person's history in words: size and span, trends by name, the newest day, readings by day."""
    t = trends(readings, [person, name], at, value, tie).withColumn(
        "line", F.format_string("%s: %s (%s%%) over %d readings", name, "direction", one_decimal(F.round("change_pct", 6)), "n")
    )
    lines = t.groupBy(person).agg(F.concat_ws("\n", F.array_sort(F.collect_list("line"))).alias("trend_lines"))
    days = by_day(readings, [person], at, name)
    day_lines = days.groupBy(person).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("day", "n", "names")), asc=False), lambda d: F.format_string("%s: %d (%s)", d["day"].cast("string"), d["n"], d["names"])).alias("d"),
        F.max("day").alias("newest"), F.sum("n").alias("n"),
    )
    return day_lines.join(lines, person, "left").select(
        person,
        F.concat_ws(
            "\n\n", F.format_string("Readings: %d, newest on %s", "n", F.col("newest").cast("string")),
            F.concat(F.lit("Trends\n"), "trend_lines"), F.concat(F.lit("By day\n"), F.concat_ws("\n", "d")),
        ).alias("summary"),
    )
