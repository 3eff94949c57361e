"""Positions inside large groups without gathering a group into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from groundline import session


def running_offset(df: DataFrame, group: list[str], bucket: Column, order: list[str],
                   weight: Column, out: str) -> DataFrame:
    """Add the exclusive running sum of ``weight`` over ``order`` within ``group``.

    ``bucket`` must grow with ``order``. Rows are ordered only inside one
    (group, bucket); the bucket totals, far fewer rows, carry the offset from
    bucket to bucket. A group holding a third of the table is therefore spread
    over all of its buckets.
    """
    tagged = df.withColumn("_bucket", bucket).withColumn("_w", weight.cast("long"))
    totals = tagged.groupBy(*group, "_bucket").agg(F.sum("_w").alias("_total"))
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(*group, "_bucket", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(*group, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        tagged.withColumn("_local", F.coalesce(F.sum("_w").over(inside), F.lit(0)))
        .join(bases, [*group, "_bucket"])
        .withColumn(out, F.col("_base") + F.col("_local"))
        .drop("_bucket", "_w", "_local", "_base")
    )


def position(df: DataFrame, group: list[str], bucket: Column, order: list[str], out: str, start: int = 0) -> DataFrame:
    """Consecutive numbers from ``start`` within ``group`` in ``order``."""
    return running_offset(df, group, bucket, order, F.lit(1), out).withColumn(out, F.col(out) + start)


def split_lookup(rows: DataFrame, values: DataFrame, key: list[str], count: str, hot_rows: int = 100_000) -> DataFrame:
    """Left join of ``rows`` to one-row-per-key ``values`` that a hot key cannot stall.

    ``values`` carries in ``count`` how many of ``rows`` have its key. Keys above
    ``hot_rows`` are at most (number of rows / hot_rows) many, so they are
    broadcast and their rows never shuffle; the others join by shuffle.
    """
    extra = [c for c in values.columns if c not in key and c != count]
    hot = values.filter(F.col(count) > hot_rows).withColumn("_hot", F.lit(True)).drop(count)
    cold = values.filter(F.col(count) <= hot_rows).drop(count)
    tagged = rows.join(F.broadcast(hot), key, "left")
    done = tagged.filter("_hot").drop("_hot")
    rest = tagged.filter(F.col("_hot").isNull()).drop("_hot", *extra).join(cold, key, "left")
    return done.unionByName(rest)


def lookup(rows: DataFrame, values: DataFrame, key: list[str], hot_rows: int = 100_000) -> DataFrame:
    """Left join to a large one-row-per-key table; keys many ``rows`` share are broadcast.

    Counting the keys combines before its shuffle; keys without a value are kept
    in the counted side, so a hot key without one does not shuffle either.
    """
    counts = rows.groupBy(*key).agg(F.count("*").alias("_n"))
    return split_lookup(rows, counts.join(values, key, "left"), key, "_n", hot_rows)


def join_per_key(rows: DataFrame, values: DataFrame, key: list[str], how: str, spread_by: str,
                 row_bytes: int = 200, salts: int = 32) -> DataFrame:
    """Join ``rows`` to a small table per source, document or run (``how`` as in ``join``).

    The small side is written once and counted: under the limit it is broadcast.
    Beyond it both sides get a salt, the small side one copy per salt, so the rows
    of one hot key spread over ``salts`` tasks.
    """
    stored = session.materialize(values, "keys")
    if stored.count() * row_bytes <= session.BROADCAST_LIMIT:
        return rows.join(F.broadcast(stored), key, how)
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(spread_by), F.lit(salts)).cast("int"))
    copies = stored.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(copies, [*key, "_salt"], how).drop("_salt")


def first_per_key(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """First row per key in ``order`` plus ``n_rows``, by partial aggregation.

    Unlike a window over the key this combines before the shuffle, so a key with
    a third of all rows sends one row per task.
    """
    rest = [c for c in rows.columns if c not in order and c not in key]
    packed = F.struct(*order, *rest)
    best = rows.groupBy(*key).agg(F.min_by(packed, F.struct(*order)).alias("_best"), F.count("*").alias("n_rows"))
    return best.select(*key, *[F.col(f"_best.{c}").alias(c) for c in [*order, *rest]], "n_rows")
