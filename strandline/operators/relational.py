"""Reusable relational patterns. All are lazy, deterministic under any partitioning, and free of Python code in the plan.

Ties are always broken by an explicit order, never by the order rows arrive in. Aggregates are written as max_by / min_by of
structs rather than windows where one row per key is wanted, so that they combine on the map side.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType


def _cols(names: str | Sequence[str]) -> list[str]:
    return [names] if isinstance(names, str) else list(names)


def latest_by(df: DataFrame, keys: str | Sequence[str], newest: str, first: str) -> DataFrame:
    """The row of each key with the largest ``newest`` (null loses); of equals the one with the smallest ``first``."""
    keys = _cols(keys)
    order = F.struct(F.col(newest).isNotNull().cast("int").alias("a"), F.col(newest).alias("b"), (-F.col(first)).alias("c"))
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*df.columns), order).alias("best"))
    return best.select("best.*")


def argmax_by(df: DataFrame, keys: str | Sequence[str], order: Sequence[Column], also: Mapping[str, Column] | None = None) -> DataFrame:
    """The row of each key for which the tuple ``order`` is largest; ``also``: further aggregates of the key in the same pass."""
    keys, more = _cols(keys), also or {}
    named = F.struct(*(c.alias(f"o{k}") for k, c in enumerate(order)))
    return df.groupBy(*keys).agg(F.max_by(F.struct(*df.columns), named).alias("best"), *(c.alias(n) for n, c in more.items())).select("best.*", *more)


def mode_first_seen(df: DataFrame, keys: str | Sequence[str], value: str, ordinal: str) -> DataFrame:
    """keys, value: the most frequent value that isn't null or blank; of equals the one seen first. null if there is none."""
    keys = _cols(keys)
    counted = df.groupBy(*keys, value).agg(F.count("*").alias("n"), F.min(ordinal).alias("o"))
    usable = F.col(value).isNotNull() & (F.trim(F.col(value).cast("string")) != "")
    return counted.groupBy(*keys).agg(F.max_by(F.when(usable, F.col(value)), F.when(usable, F.struct("n", (-F.col("o")).alias("o")))).alias(value))


def range_expand(df: DataFrame, start: str, count: str, out: str) -> DataFrame:
    """One row per number of each range; ranges without numbers give none."""
    return df.where(F.col(count) >= 1).withColumn(out, F.explode(F.sequence(F.col(start), F.col(start) + F.col(count) - 1)))


#: Ordinals in a run of rows whose order is looked at together; runs are then put together by their ends.
RUN = 1 << 16


def upsert_conflicts(df: DataFrame, key: str, holder: str, ordinal: str, run: int = RUN) -> DataFrame:
    """key, holder (the last one), conflicts: how often the holder changed in order.

    Changes are counted within runs of ordinals and between the last and first rows of neighbouring runs, so a key with a large
    share of the rows isn't sorted in one task.
    """
    rows = df.where(F.col(holder).isNotNull()).select(key, holder, ordinal, F.floor(F.col(ordinal) / run).alias("__run"))
    before = F.lag(holder).over(Window.partitionBy(key, "__run").orderBy(ordinal))
    marked = rows.withColumn("__change", (before.isNotNull() & (before != F.col(holder))).cast("long"))
    runs = marked.groupBy(key, "__run").agg(F.min_by(holder, ordinal).alias("__first"), F.max_by(holder, ordinal).alias("__last"), F.max(ordinal).alias("__at"), F.sum("__change").alias("__inside"))
    between = F.lag("__last").over(Window.partitionBy(key).orderBy("__run"))
    met = runs.withColumn("__between", (between.isNotNull() & (between != F.col("__first"))).cast("long"))
    return met.groupBy(key).agg(F.max_by("__last", "__at").alias(holder), F.sum(F.col("__inside") + F.col("__between")).alias("conflicts"))


def ordered_distinct(df: DataFrame, keys: str | Sequence[str], value: str, ordinal: str, out: str) -> DataFrame:
    """keys and an array of a key's distinct values in the order of their first appearance; it holds distinct values only."""
    keys = _cols(keys)
    first = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.min(ordinal).alias("__o"))
    return first.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col("__o").alias("o"), F.col(value).alias("v")))), lambda x: x["v"]).alias(out))


def suffix_join(names: DataFrame, name: str, targets: DataFrame, target: str, suffixes: Callable[[Column], Column]) -> DataFrame:
    """Each name with its longest suffix among ``targets``: an equi-join on exploded suffixes, not a theta join."""
    exploded = names.select(name).distinct().withColumn("__s", F.explode(suffixes(F.col(name))))
    met = exploded.join(targets.select(F.col(target).alias("__t")).distinct(), F.col("__s") == F.col("__t"))
    best = met.groupBy(name).agg(F.max_by("__t", F.length("__t")).alias(target))
    return names.join(best, name, "left")


def fallback_lookup(df: DataFrame, lookups: Sequence[tuple[Column, DataFrame, str, str]], out: str, default: str) -> DataFrame:
    """First hit of several (key of ``df``, table, key column, value column); tables are made unique on their key (least value)."""
    found = []
    for k, (key, table, on, value) in enumerate(lookups):
        unique = table.groupBy(F.col(on).alias(f"__k{k}")).agg(F.min(value).alias(f"__v{k}"))
        df = df.join(unique, key == F.col(f"__k{k}"), "left").drop(f"__k{k}")
        found.append(f"__v{k}")
    return df.withColumn(out, F.coalesce(*found, F.lit(default))).drop(*found)


def precedence_merge(parts: Sequence[DataFrame], key: str, blend: bool = False) -> DataFrame:
    """Parts from lowest to highest priority. Whole rows override; with ``blend`` the highest non-null value of each column."""
    ranked = [p.withColumn("__rank", F.lit(k)) for k, p in enumerate(parts)]
    union = ranked[0]
    for p in ranked[1:]:
        union = union.unionByName(p)
    values = [c for c in parts[0].columns if c != key]
    if blend:
        return union.groupBy(key).agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), F.col("__rank"))).alias(c) for c in values))
    return union.groupBy(key).agg(F.max_by(F.struct(*values), "__rank").alias("v")).select(key, "v.*")


def additive_merge(base: DataFrame, more: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``base`` and those rows of ``more`` whose keys it lacks."""
    return base.unionByName(more.join(base.select(*keys).distinct(), list(keys), "left_anti"))


def dedup_apply(df: DataFrame, key: str, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Run an expensive ``compute`` once per distinct key and join its columns back."""
    return df.join(compute(df.select(key).where(F.col(key).isNotNull()).distinct()), key, "left")


def budget_prefix(df: DataFrame, key: str, order: Sequence[Column], cost: str, budget: int, out: str, run: Column | None = None) -> DataFrame:
    """Running budget per key: rows are charged in order, the row that crosses the budget in part, those after it nothing.

    ``run``: a number that doesn't decrease in that order, for keys with very many rows. Sums are then taken within runs and over
    the sums of earlier runs, so no task sorts all rows of a key.
    """
    earlier = lambda *keys: Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    granted = lambda before: F.greatest(F.lit(0), F.least(F.col(cost), F.lit(budget) - before))
    if run is None:
        return df.withColumn(out, granted(F.coalesce(F.sum(cost).over(earlier(key)), F.lit(0))))
    rows = df.withColumn("__run", run)
    sums = rows.groupBy(key, "__run").agg(F.sum(cost).alias("__sum"))
    first = sums.select(F.col(key).alias("__k"), F.col("__run").alias("__r"), F.coalesce(F.sum("__sum").over(Window.partitionBy(key).orderBy("__run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    met = rows.join(first, F.col(key).eqNullSafe(F.col("__k")) & (F.col("__run") == F.col("__r")))
    before = F.col("__before") + F.coalesce(F.sum(cost).over(earlier(key, "__run")), F.lit(0))
    return met.withColumn(out, granted(before)).drop("__run", "__k", "__r", "__before")


def first_by_class(df: DataFrame, key: str, rank: Column, position: str) -> DataFrame:
    """Per key the row of the best class (least rank, null: never), then the first by position."""
    marked = df.withColumn("__r", rank).where("__r is not null")
    best = marked.groupBy(key).agg(F.min_by(F.struct(*df.columns), F.struct("__r", position)).alias("best"))
    return best.select("best.*")


def top_k_by(df: DataFrame, keys: str | Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    keys = _cols(keys)
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= k)


def best_with_ties(df: DataFrame, keys: str | Sequence[str], score: str) -> DataFrame:
    """All rows that reach the largest score of their key."""
    keys = _cols(keys)
    top = df.groupBy(*keys).agg(F.max(score).alias("__top"))
    return df.join(top, keys).where(F.col(score) == F.col("__top")).drop("__top")


#: Bytes of notes in one piece of the result of ``inherit_within_group``.
NOTE_BYTES = 1 << 29


def inherit_within_group(held: DataFrame, member: str, group: str, label: str, note_bytes: int = NOTE_BYTES) -> DataFrame:
    """Labels that other members of a group hold and the member lacks: member, label, note ("Inherit from a, b", as text order).

    What is missing is found on keys alone. A note is made once for each label and set of groups that offer it, and meets the
    rows in the last step, so it is never moved once a row; the result itself has it in each row. Rows of a note fall into pieces
    of about ``note_bytes``, so no task writes all of a large group. Rows of a piece lie together, so a file in columns keeps
    their note about once.
    """
    tasks = int(held.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = held.select(member, group, label).distinct()
    offered = rows.select(member, group).distinct().join(rows.select(group, label).distinct(), group)
    missing = offered.join(rows.select(member, label).distinct(), [member, label], "left_anti")
    of = F.struct(F.array_sort(F.collect_set(group)).alias("groups"), F.first(label, ignorenulls=False).alias("label"))
    lacking = missing.groupBy(member, label).agg(of.alias("__of"))
    wanted = lacking.groupBy("__of").agg(F.count("*").alias("__n")).select("__of", "__n", F.explode("__of.groups").alias("__g"))
    met = wanted.join(rows, (F.col("__g") == F.col(group)) & F.col("__of.label").eqNullSafe(F.col(label)))
    holders = met.groupBy("__of", "__n").agg(F.array_sort(F.collect_set(F.col(member).cast("string"))).alias("__h"))
    notes = holders.select(F.col("__of").alias("__for"), "__n", F.concat(F.lit("Inherit from "), F.array_join("__h", ", ")).alias("note"))
    notes = notes.select("__for", "note", F.ceil(F.col("__n") * F.octet_length("note") / note_bytes).alias("__pieces"))
    place = lambda of, piece: F.struct(F.col(of).alias("of"), piece.alias("piece")).alias("__at")
    dealt = lacking.join(notes.select("__for", "__pieces"), F.col("__of") == F.col("__for")).select(member, label, place("__of", F.pmod(F.xxhash64(member), "__pieces")))
    pieces = notes.select("__for", "note", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__pieces") - 1)).alias("__piece")).select(place("__for", F.col("__piece")), "note")
    return dealt.repartition(tasks, "__at").join(pieces.repartition(tasks, "__at").hint("merge"), "__at").select(member, label, "note")


def identity_reuse(before: DataFrame, now: DataFrame, key: str, identity: Sequence[str]) -> DataFrame:
    """key, outcome: same, changed, new or gone. Identities with a null never count as the same."""
    a = before.select(key, F.struct(*identity).alias("a"), F.lit(True).alias("was"))
    b = now.select(key, F.struct(*identity).alias("b"), F.lit(True).alias("is"))
    whole = F.lit(True)
    for c in identity:
        whole = whole & F.col(f"a.{c}").isNotNull() & F.col(f"b.{c}").isNotNull() & (F.col(f"a.{c}") == F.col(f"b.{c}"))
    outcome = F.when(F.col("was").isNull(), "new").when(F.col("is").isNull(), "gone").when(F.coalesce(whole, F.lit(False)), "same").otherwise("changed")
    return a.join(b, key, "full_outer").select(key, outcome.alias("outcome"))


def reconcile(expected: DataFrame, got: DataFrame, key: str) -> DataFrame:
    """key, state: both, missing (expected only) or unknown (received only)."""
    a = expected.select(key).distinct().withColumn("e", F.lit(True))
    b = got.select(key).distinct().withColumn("g", F.lit(True))
    return a.join(b, key, "full_outer").select(key, F.when(F.col("g").isNull(), "missing").when(F.col("e").isNull(), "unknown").otherwise("both").alias("state"))


def id_set_fingerprints(df: DataFrame, keys: str | Sequence[str], ids: str, out: str = "ids_sha256") -> DataFrame:
    """keys, n, and the SHA-256 of a key's sorted identifiers, one per line. The hash is sequential by definition: a set streams
    through one task in the order of the shuffle's sort, which spills, and nothing of it is held."""
    import hashlib

    keys = _cols(keys)
    rows = df.select(*keys, F.col(ids).cast("string").alias("__id")).where("__id is not null")
    schema = StructType([*(rows.schema[k] for k in keys), StructField("n", LongType()), StructField(out, StringType())])

    def work(batches):
        import pyarrow as pa

        last, digest, n = None, None, 0
        names, kinds = schema.names, None

        def row():
            return pa.RecordBatch.from_arrays([*(pa.array([v], t) for v, t in zip(last, kinds)), pa.array([n], pa.int64()), pa.array([digest.hexdigest()])], names)

        for batch in batches:
            kinds = [c.type for c in batch.columns[:-1]]
            for *key, one in zip(*(c.to_pylist() for c in batch.columns)):
                if key != last:
                    if last is not None:
                        yield row()
                    last, digest, n = key, hashlib.sha256(), 0
                digest.update(("\n" if n else "").encode() + one.encode())
                n += 1
        if last is not None:
            yield row()

    return rows.repartition(*keys).sortWithinPartitions(*keys, "__id").mapInArrow(work, schema)


#: Days of a directory listing that are gathered into one array.
MOST_DAYS = 100_000


def nearest_snapshot(wanted: DataFrame, day: str, snapshots: DataFrame, snapshot: str) -> DataFrame:
    """Each wanted day with the nearest snapshot: of the same month if there is one, else of any; of equals the earlier.

    Only distinct wanted days meet the snapshots, whose distinct days may be ``MOST_DAYS``, by two binary searches each: the last
    snapshot up to the day and the first from it on are the nearest of all, and of the same month if any is.
    """
    days = snapshots.select(F.col(snapshot).alias("d")).where("d is not null").distinct()
    if (n := days.limit(MOST_DAYS + 1).count()) > MOST_DAYS:
        raise ValueError(f"at most {MOST_DAYS} snapshot days, not {n}")
    ask = wanted.select(F.col(day).alias("d")).where("d is not null").distinct()
    both = ask.select("d", F.lit(None).cast("date").alias("s")).union(days.select("d", F.col("d").cast("date").alias("s")))
    order = Window.orderBy("d")  # distinct days only, bounded by the calendar
    near = both.select("d", "s", F.last("s", True).over(order.rangeBetween(Window.unboundedPreceding, 0)).alias("a"), F.first("s", True).over(order.rangeBetween(0, Window.unboundedFollowing)).alias("b")).where("s is null")
    cost = lambda c: F.when(F.col(c).isNotNull(), F.struct((F.trunc(c, "month") != F.trunc("d", "month")).alias("other"), F.abs(F.date_diff(c, F.col("d"))).alias("far"), F.col(c).alias("s")))
    best = near.select(F.col("d").alias("__d"), F.least(cost("a"), cost("b"))["s"].alias(snapshot)).distinct()
    return wanted.join(best, F.col(day) == F.col("__d"), "left").drop("__d")


def overlap_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, words: str, least: float) -> DataFrame:
    """left_key, right_key, jaccard of pairs whose sets of words have a Jaccard similarity of ``least`` or more (above 0).

    Words are ordered by how many rows of the right side have them, rare ones first. Sets of size a and b with that similarity
    share one of the first a - ceil(least * a) + 1 words of the one and of the first words of the other, so the equi-join on these
    finds all pairs without joining on common words; pairs found are verified by their whole sets.
    """
    counts = right.select(F.explode(words).alias("word")).groupBy("word").agg(F.count("*").alias("n"))

    def first_words(df: DataFrame, key: str, name: str) -> DataFrame:
        rows = df.select(F.col(key).alias(name), F.explode(words).alias("word")).join(counts, "word", "left")
        own = rows.groupBy(name).agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word"))).alias("w"))
        many = (F.size("w") - F.ceil(F.size("w") * least - 1e-9) + 1).cast("int")
        return own.select(name, F.explode(F.transform(F.slice("w", F.lit(1), many), lambda x: x["word"])).alias("word"))

    found = first_words(left, left_key, "l").join(first_words(right, right_key, "r"), "word").select("l", "r").distinct()
    met = found.join(left.select(F.col(left_key).alias("l"), F.col(words).alias("a")), "l").join(right.select(F.col(right_key).alias("r"), F.col(words).alias("b")), "r")
    shared = F.size(F.array_intersect("a", "b"))
    jaccard = shared / (F.size("a") + F.size("b") - shared)
    return met.select(F.col("l").alias(left_key), F.col("r").alias(right_key), jaccard.alias("jaccard")).where(F.col("jaccard") >= least)
