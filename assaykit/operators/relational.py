"""Searching, paging, counting, de-duplicating and changing tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import date_of, shown
from ..sources.tables import spread
from .spotting import spotted


def search(df: DataFrame, term: str | None, *columns: str) -> DataFrame:
    """Rows where any column holds the term, case aside; ``%`` and ``_`` in the term are wildcards."""
    if not term:
        return df
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.col(c).ilike(f"%{term.lower()}%"), F.lit(False))
    return df.where(hit)


def where_equal(df: DataFrame, **values) -> DataFrame:
    """Equality filters; a filter whose value is None is left out."""
    for c, v in values.items():
        if v is not None:
            df = df.where(F.col(c) == v)
    return df


def point(df: DataFrame, key: str, value) -> DataFrame:
    """The row of a key, or none. Files sorted by the key are pruned by their statistics."""
    return df.where(F.col(key) == F.lit(value)).limit(1)


def of_tenant(df: DataFrame, tenant, column: str = "tenant_id") -> DataFrame:
    """What a tenant may see: its own rows; none without a tenant."""
    return df.where(F.col(column) == F.lit(tenant)) if tenant is not None else df.limit(0)


def search_fields(df: DataFrame, term: str, *columns: str) -> DataFrame:
    """Rows where the term stands in any column, case aside and taken literally; numbers are read as they are shown."""
    numeric = {c for c, kind in df.dtypes if kind in ("double", "float")}
    texts = [shown(F.col(c)) if c in numeric else F.col(c).cast("string") for c in columns]
    return df.where(F.exists(F.array(*texts), lambda t: F.coalesce(F.contains(F.lower(t), F.lit(term.lower())), F.lit(False))))


def history_filter(df: DataFrame, category: str = "All", abnormal: bool | None = None, report: str = "All") -> DataFrame:
    """Rows of a category, a status and a report; a row without category is Uncategorized, without file of Unknown Report."""
    if category != "All":
        df = df.where(F.coalesce(F.nullif("category", F.lit("")), F.lit("Uncategorized")) == category)
    if abnormal is not None:
        df = df.where(F.col("is_abnormal").eqNullSafe(F.lit(abnormal)))
    return df.where(F.coalesce(F.nullif("file_name", F.lit("")), F.lit("Unknown Report")) == report) if report != "All" else df


def choices(*columns: DataFrame) -> DataFrame:
    """choice, place: All, then the distinct values of all one-column tables; null and empty ones go."""
    found = columns[0].toDF("choice")
    for c in columns[1:]:
        found = found.union(c.toDF("choice"))
    found = found.where("choice != ''").distinct().select("choice", F.lit(1).alias("place"))
    return found.sparkSession.range(1).select(F.lit("All").alias("choice"), F.lit(0).alias("place")).union(found.where("choice != 'All'"))


def table_order(column: str, kind: str, ascending: bool = True, tie: str = "id") -> list[Column]:
    """Order of a shown table: numbers by value, booleans false first, texts by their lower case in Unicode's collation (so that accented
    letters stand by their plain ones), with missing ones as ''."""
    c = F.col(column) if kind in ("double", "float", "int", "bigint") else F.coalesce(F.col(column), F.lit(False)) if kind == "boolean" else F.collate(F.lower(F.coalesce(F.col(column).cast("string"), F.lit(""))), "UNICODE")
    return [c.asc_nulls_first() if ascending else c.desc_nulls_last(), F.col(tie)]


def page_number(df: DataFrame, order: list[Column], number: int, size: int = 10) -> DataFrame:
    """The page of a 1-based number."""
    return page(df, order, (max(1, number) - 1) * size, size)


def page(df: DataFrame, order: list[Column], offset: int = 0, limit: int = 100) -> DataFrame:
    """Rows ``offset`` to ``offset + limit`` of an order that the caller makes total; limit is held within 1 and 1000."""
    return df.orderBy(*order).offset(max(0, offset)).limit(min(1000, max(1, limit)))


def child_counts(parents: DataFrame, key: str, **children: DataFrame) -> DataFrame:
    """Parents with a column for each child table, its rows of the same key: children are counted before they are joined."""
    for name, child in children.items():
        n = child.groupBy(key).agg(F.count("*").alias(name))
        parents = parents.join(n, key, "left").withColumn(name, F.coalesce(name, F.lit(0).cast("long")))
    return parents


def status_histogram(df: DataFrame, column: str, fixed: list[str]) -> DataFrame:
    """status, n: the fixed ones at least with 0, others as they come."""
    spark = df.sparkSession
    known = spark.createDataFrame([(s,) for s in fixed], f"{column} string").withColumn("n", F.lit(0).cast("long"))
    found = df.groupBy(column).agg(F.count("*").alias("n"))
    return known.unionByName(found).groupBy(column).agg(F.sum("n").alias("n"))


def duplicate_groups(df: DataFrame, keys: list[str], row_id: str) -> DataFrame:
    """Groups of more than one row: keys, count and first id. Nulls are equal keys."""
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.min(row_id).alias("first_id")).where("n > 1")


def keep_first(df: DataFrame, keys: list[Column | str], order: list[Column]) -> DataFrame:
    """The first row of each group, nulls being equal keys."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def missing(wanted: DataFrame, present: DataFrame, key: str) -> DataFrame:
    return wanted.select(key).distinct().join(present.select(key), key, "left_anti")


def reassign(df: DataFrame, key: str, moves: DataFrame) -> DataFrame:
    """Rows of ``moves.old`` go to ``moves.new``; moves have one row for each old key."""
    return df.join(moves.withColumnsRenamed({"old": key, "new": "__new"}), key, "left").withColumn(key, F.coalesce("__new", key)).drop("__new").select(df.columns)


def merge_people(people: DataFrame, children: DataFrame, key: str, moves: DataFrame, same: list[str], row_id: str) -> tuple[DataFrame, DataFrame]:
    """Merge persons: their rows move, rows that then equal another one (``same``) go but for the first, sources go."""
    moved = reassign(children, key, moves)
    return people.join(moves.select(F.col("old").alias(key)), key, "left_anti"), keep_first(moved, [key, *same], [F.col(row_id)])


def unlink(df: DataFrame, column: str, when: Column) -> DataFrame:
    return df.withColumn(column, F.when(~F.coalesce(when, F.lit(False)), F.col(column)))


def fill_missing(df: DataFrame, column: str, value, empty: tuple[str, ...] = ()) -> DataFrame:
    """Null (and the texts of ``empty``) become ``value``."""
    gone = F.col(column).isNull() | (F.col(column).cast("string").isin(*empty) if empty else F.lit(False))
    return df.withColumn(column, F.when(gone, F.lit(value)).otherwise(F.col(column)))


def cascade_delete(parents: DataFrame, children: DataFrame, keys: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Parents and children without those of the keys."""
    return delete_keys(parents, keys, key), delete_keys(children, keys, key)


def reset_status(df: DataFrame, when: Column, to: str = "pending", column: str = "status") -> DataFrame:
    """Rows that got stuck start again."""
    return df.withColumn(column, F.when(F.coalesce(when, F.lit(False)), to).otherwise(F.col(column)))


def people_from_metadata(metadata: DataFrame) -> DataFrame:
    """New persons from report metadata (patient_name, patient_dob, patient_gender, patient_id, tenant_id): a missing name reads
    Unknown Profile, a blank one Default Profile; a birth date that fits no known format is left out."""
    name = F.when(F.col("patient_name").isNull(), "Unknown Profile").when(F.trim("patient_name") == "", "Default Profile").otherwise(F.col("patient_name"))
    return metadata.select(
        name.alias("name"), date_of(F.col("patient_dob")).alias("date_of_birth"), F.col("patient_gender").alias("gender"), "patient_id", "tenant_id"
    )


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """rows_a, rows_b, same: whether two tables hold the same rows, repeats included, by one pass over each: counts and sums of
    row hashes, in any order of rows."""
    digest = lambda df: df.select(F.xxhash64(*[F.col(c) for c in a.columns]).cast("decimal(38,0)").alias("h")).agg(F.count("*").alias("n"), F.sum("h").alias("s"))
    x, y = digest(a).withColumnsRenamed({"n": "rows_a", "s": "sa"}), digest(b).withColumnsRenamed({"n": "rows_b", "s": "sb"})
    return x.crossJoin(y).select("rows_a", "rows_b", ((F.col("rows_a") == F.col("rows_b")) & F.col("sa").eqNullSafe(F.col("sb"))).alias("same"))  # one row each


def delete_keys(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return df.join(keys.select(key).distinct(), key, "left_anti")


def partial_update(df: DataFrame, updates: DataFrame, key: str, stamp: Column | None = None, stamp_column: str = "last_modified") -> DataFrame:
    """Fields that an update gives (not null) replace the row's; updates have one row for each key."""
    changed = [c for c in updates.columns if c != key]
    u = updates.select(F.col(key).alias("__key"), *[F.col(c).alias(f"__{c}") for c in changed])
    out = df.join(u, F.col(key) == F.col("__key"), "left").withColumns({c: F.coalesce(f"__{c}", c) for c in changed})
    if stamp is not None:
        out = out.withColumn(stamp_column, F.when(F.col("__key").isNotNull(), stamp).otherwise(F.col(stamp_column)))
    return out.select(df.columns)


def insert_absent(df: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    return df.unionByName(rows.dropDuplicates([key]).join(df.select(key), key, "left_anti"), allowMissingColumns=True)


def next_id(df: DataFrame, column: str) -> DataFrame:
    return df.agg((F.coalesce(F.max(column), F.lit(0)) + 1).alias("next_id"))


def stuck(df: DataFrame, now: Column, started: str, uploaded: str, minutes: int = 10) -> Column:
    """Processing since more than ``minutes``: by its start, or where there is none by its upload."""
    cutoff = now - F.make_dt_interval(mins=F.lit(minutes))
    return (F.col("status") == "processing") & F.coalesce(F.col(started) < cutoff, F.col(started).isNull() & (F.col(uploaded) < cutoff), F.lit(False))


def first_position_removed(items: Column, item: Column) -> Column:
    """The list without the first occurrence of an item."""
    at = F.array_position(items, item).cast("int")
    rest = F.concat(F.slice(items, F.lit(1), at - 1), F.slice(items, at + 1, F.size(items)))
    return F.when(at > 0, rest).otherwise(items)


def appended_if_absent(items: Column, item: Column) -> Column:
    known = F.coalesce(items, F.array().cast("array<string>"))
    return F.when(F.array_contains(known, item), known).otherwise(F.array_append(known, item))


def moved(items: Column, from_: int, to: int) -> Column:
    """The list with the element at 0-based ``from_`` at ``to``."""
    item = F.element_at(items, from_ + 1)
    rest = F.concat(F.slice(items, 1, from_), F.slice(items, F.lit(from_ + 2), F.size(items)))
    return F.concat(F.slice(rest, 1, to), F.array(item), F.slice(rest, F.lit(to + 1), F.size(items)))


def _grams(text: Column, size: int) -> Column:
    """The distinct runs of ``size`` characters; the whole text where it is shorter."""
    n = F.length(text)
    return F.array_distinct(F.when(n <= size, F.array(text)).otherwise(F.transform(F.sequence(F.lit(1), n - size + 1), lambda i: F.substring(text, i, F.lit(size)))))


def two_stage_match(wanted: DataFrame, people: DataFrame, key: str, id_col: str, name_col: str, gram: int = 3, side: int = 1000) -> DataFrame:
    """Matches by equal id; rows (wanted: their key) without any match by names that contain the wanted one, case aside.

    A name that contains another has all its runs of ``gram`` characters, so the two meet by equality of the wanted name's rarest
    run, and only those pairs are compared. Names shorter than a run meet all shorter runs of the people's names. Each distinct name is
    compared once, and rows are joined to the pairs of names that were found. Null and empty names match by id only.

    All sides grow with the input, so none is broadcast: they compress too well for Spark to tell their size. The rows of a wanted name and
    the persons it finds are cut into pieces of about ``side`` rows, and each pair of pieces is one key, so a frequent name is spread.
    """
    p = people.select(F.col(key).alias("match"), F.col(id_col).alias("__id"), F.lower(name_col).alias("__name"))
    by_id = wanted.join(p.hint("merge"), F.col(id_col) == F.col("__id")).select(*wanted.columns, "match")
    left = wanted.join(by_id.select("wanted").distinct().hint("merge"), "wanted", "left_anti").withColumn("__w", F.lower(name_col)).where("__w != ''")
    sizes = range(1, gram + 1)
    names = p.where("__name != ''").groupBy("__name").agg(F.count("*").alias("__n"))
    runs = names.select("__name", "__n", F.explode(F.array_distinct(F.flatten(F.array(*[_grams(F.col("__name"), k) for k in sizes])))).alias("__g"))
    counts = runs.groupBy("__g").agg(F.count("*").alias("__k"))
    asked = left.groupBy("__w").agg(F.count("*").alias("__m")).select("__w", "__m", F.explode(_grams(F.col("__w"), gram)).alias("__g")).join(counts.hint("merge"), "__g", "left")
    rarest = asked.groupBy("__w", "__m").agg(F.min_by("__g", F.struct(F.coalesce("__k", F.lit(0)), "__g")).alias("__g"))
    met = rarest.join(runs.hint("merge"), "__g").where(F.contains("__name", F.col("__w"))).select("__w", "__m", "__name", "__n")
    pieces = lambda rows: F.ceil(rows / side).cast("int")
    grid = met.groupBy("__w").agg(pieces(F.max("__m")).alias("__is"), pieces(F.sum("__n")).alias("__js"))
    piece = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = left.join(grid.hint("merge"), "__w").select(*wanted.columns, "__w", piece("wanted", "__is").alias("__i"), every("__js").alias("__j"))
    found = met.select("__w", "__name").join(grid.hint("merge"), "__w").join(p.select("match", "__name").hint("merge"), "__name")
    found = found.select("match", "__w", every("__is").alias("__i"), piece("match", "__js").alias("__j"))
    parts = int(wanted.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # small inputs make many rows: not to be coalesced
    found, left = (df.repartition(parts, "__w", "__i", "__j") for df in (found, left))
    return by_id.unionByName(found.join(left.hint("merge"), ["__w", "__i", "__j"]).select(*wanted.columns, "match"))


def suggestions(df: DataFrame, category: str = "category", priority: str = "priority", text: str = "text", tie: str = "id") -> DataFrame:
    """Questions of each category, by priority: category, place (1 first), text."""
    w = Window.partitionBy(category).orderBy(priority, tie)
    return df.select(category, F.row_number().over(w).alias("place"), text)


def follow_ups(reply: Column, abnormal: Column, most: int = 3) -> Column:
    """At most ``most`` follow-up questions to a reply: on food, on exercise, on how several abnormal values relate."""
    lower = F.lower(reply)
    return F.slice(F.array_compact(F.array(
        F.when(lower.rlike("diet|nutrition"), "What specific foods should I focus on?"), F.when(lower.rlike("exercise"), "What type of exercise routine would you recommend?"),
        F.when(abnormal > 1, "How are my abnormal biomarkers related to each other?"),
    )), 1, most)


def mentioned(texts: DataFrame, names: DataFrame, key: list[str], text: str = "text", name: str = "name", most_bytes: int = 32 << 20) -> DataFrame:
    """(key, name) of the names that a text contains, case aside. Null and empty names and texts meet nothing; a name counts once,
    repeated texts are repeated.

    Up to ``most_bytes`` of names are sent out, and a text goes through one automaton of all of them; more are joined.
    """
    named = names.select(F.col(name).alias("name"), F.lower(name).alias("__n")).where("__n != ''").distinct()
    if (named.agg(F.sum(F.octet_length("__n") + 100)).first()[0] or 0) > most_bytes:
        return _mentioned_by_runs(texts, named, key, text)
    of = named.groupBy("__n").agg(F.collect_set("name").alias("names")).collect()
    lower = spread(texts.where(F.col(text) != "").select(*key, F.lower(text).alias("__t")))
    found = spotted(lower, [r["__n"] for r in of], key, "__t")
    if all(r.names == [r["__n"]] for r in of):
        return found
    same = texts.sparkSession.createDataFrame([(r["__n"], r.names) for r in of], "name string, names array<string>")
    return found.join(F.broadcast(same), "name").select(*key, F.explode("names").alias("name"))


def _mentioned_by_runs(texts: DataFrame, named: DataFrame, key: list[str], text: str, gram: int = 3) -> DataFrame:
    """A text meets the names whose rarest run of ``gram`` characters it has, by equality, and only those pairs are compared."""
    sizes = range(1, gram + 1)
    asked = named.select("name", "__n", F.explode(_grams(F.col("__n"), gram)).alias("__g"))
    # rarity among the names: a run that few names have
    few = asked.groupBy("__g").agg(F.count("*").alias("__k"))
    best = asked.join(few, "__g").groupBy("name", "__n").agg(F.min_by("__g", F.struct("__k", "__g")).alias("__g"))
    runs = texts.where(F.col(text) != "").select(*key, F.lower(text).alias("__t"))
    lists = runs.select(*key, "__t", F.explode(F.array_distinct(F.flatten(F.array(*[_grams(F.col("__t"), k) for k in sizes])))).alias("__g"))
    return lists.join(best, "__g").where(F.contains("__t", F.col("__n"))).select(*key, "name")


def sources_without(chosen: Column, target: Column) -> Column:
    """The persons to merge: those chosen but for the one that they go to, in their order."""
    return F.filter(chosen, lambda c: ~c.eqNullSafe(target))
