"""Building blocks that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitrine.session import checkpointed

HASH_BUCKETS = 65_536
HOT_ROWS = 200_000


def latest(df: DataFrame, keys: list[str], order: list[str], last: bool = True) -> DataFrame:
    """One row per key: the last (or first) by ``order``.

    An aggregate, not a window: each map task sends at most one row per key, so a hot key is
    never gathered in one task. The row itself is compared, ``order`` first, so the shuffle has each
    column once; rows with a map, which has no order, are picked by ``order`` beside them.
    """
    rest = [c for c in df.columns if c not in keys]
    if any("map<" in df.schema[c].dataType.simpleString() for c in rest) or set(order) & set(keys):
        pick = F.max_by if last else F.min_by
        row = pick(F.struct(*rest), F.struct(*order)).alias("_row")
    else:
        first = list(dict.fromkeys(order))
        pick = F.max if last else F.min
        row = pick(F.struct(*first, *[c for c in rest if c not in first])).alias("_row")
    return df.groupBy(*keys).agg(row).select(*keys, "_row.*").select(*df.columns)


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], limit: int) -> DataFrame:
    """At most ``limit`` rows per key, in ``order``.

    Spark cuts each map task to ``limit`` rows per key before the shuffle (its window group limit)
    as long as ``limit`` is below spark.sql.optimizer.windowGroupLimitThreshold.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(window)).filter(F.col("_rn") <= limit).drop("_rn")


def hash_bucket(*values: Column) -> Column:
    return F.pmod(F.xxhash64(*values), F.lit(HASH_BUCKETS)).cast("int")


def bucket_counts(rows: DataFrame, bucket: Column) -> dict[int, int]:
    """Rows by hash bucket: at most ``HASH_BUCKETS`` numbers reach the driver, however many rows there are."""
    return dict(rows.groupBy(bucket.alias("b")).agg(F.count(F.lit(1)).alias("n")).collect())


def lag_in_buckets(
    df: DataFrame, key: str, bucket: Column, order: list[str], values: list[str], hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Adds ``prev_<value>``: the value of the key's previous row by ``order``, null on its first.

    ``bucket`` must not decrease along ``order``; rows without key or bucket are left out. Keys are counted by
    a hash; those whose hash has more than ``hot_rows`` rows are windowed per (key, bucket), so a hot key is
    spread over its buckets. All others are sent once and windowed per key.
    """
    counts = bucket_counts(df, hash_bucket(F.col(key)))
    hot = [b for b, n in counts.items() if n > hot_rows]
    if len(hot) > HASH_BUCKETS // 8:  # so many rows that hashes say nothing
        return _lag_over_buckets(df, key, bucket, order, values)
    plain = (
        df.withColumn("_prev", F.lag(F.struct(*values)).over(Window.partitionBy(key).orderBy(*order)))
        .filter(F.col(key).isNotNull() & bucket.isNotNull())
        .withColumns({f"prev_{v}": F.col(f"_prev.{v}") for v in values})
        .withColumn("is_first", F.col("_prev").isNull())
        .drop("_prev")
    )
    if not hot:
        return plain
    is_hot = hash_bucket(F.col(key)).isin(hot)
    spread = _lag_over_buckets(df.filter(is_hot), key, bucket, order, values)
    return plain.filter(~is_hot).unionByName(spread)


def _lag_over_buckets(
    df: DataFrame, key: str, bucket: Column, order: list[str], values: list[str]
) -> DataFrame:
    """A bucket's first row takes the last row of the key's previous bucket from an aggregate that has one row
    per (key, bucket)."""
    bucketed = df.withColumn("_bucket", bucket)
    inside = Window.partitionBy(key, "_bucket").orderBy(*order)
    edges = (
        bucketed.groupBy(key, "_bucket")
        .agg(F.max_by(F.struct(*values), F.struct(*order)).alias("_last"))
        .withColumn("_carried", F.lag("_last").over(Window.partitionBy(key).orderBy("_bucket")))
        .select(key, "_bucket", "_carried")
    )
    return (
        bucketed.withColumn("_near", F.lag(F.struct(*values)).over(inside))
        .join(edges, [key, "_bucket"])
        .withColumn("_prev", F.coalesce("_near", "_carried"))
        .withColumns({f"prev_{v}": F.col(f"_prev.{v}") for v in values})
        .withColumn("is_first", F.col("_prev").isNull())
        .drop("_bucket", "_near", "_carried", "_prev")
    )


def with_global_rank(df: DataFrame, order: list[str], out: str = "rank") -> DataFrame:
    """Adds a dense 0-based rank over the whole of ``df`` without a single-partition window.

    Range-partition and sort, number the rows inside each partition, then add the sizes of the
    partitions before. The sorted rows are checkpointed first, because range bounds are sampled
    and a recomputed partition could otherwise get other rows than were counted.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = checkpointed(
        df.repartitionByRange(parts, *order)
        .sortWithinPartitions(*order)
        .withColumn("_id", F.monotonically_increasing_id())
    )
    numbered = placed.withColumn("_part", F.shiftright("_id", 33)).withColumn(
        "_pos", F.col("_id").bitwiseAND((1 << 33) - 1)
    )
    # One row per partition: the running sum below is over `parts` rows, not over the data.
    sizes = numbered.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")
    )
    return (
        numbered.join(F.broadcast(offsets), "_part")
        .withColumn(out, F.col("_offset") + F.col("_pos"))
        .drop("_part", "_pos", "_offset", "_id")
    )


def with_new_ids(df: DataFrame, order: list[str], stored: DataFrame, out: str = "id") -> DataFrame:
    """Consecutive ids after the highest stored one, in ``order``."""
    top = stored.agg(F.coalesce(F.max(out), F.lit(0)).alias("_top"))
    ranked = with_global_rank(df, order, "_rank")
    # a one-row aggregate, attached to every row
    return (
        ranked.withColumn("_one", F.lit(1))
        .join(F.broadcast(top.withColumn("_one", F.lit(1))), "_one")
        .withColumn(out, F.col("_top") + F.col("_rank") + 1)
        .drop("_one", "_top", "_rank")
    )
