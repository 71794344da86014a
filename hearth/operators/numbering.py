"""Dense numbers over whole tables without a window that one task would have to sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearth.functions.numbers import keyed_uniform
from hearth.session import stored

#: Low bits of monotonically_increasing_id that hold a row's place in its partition.
PLACE_BITS = 33


def numbered(rows: DataFrame, order: list[Column], name: str = "seq", parts: int | None = None) -> DataFrame:
    """The rows with their place in the order (from 1, without gaps).

    Two passes: rows are dealt over ranges of the order and sorted inside each,
    which is stored with each row's range and place; then the ranges' counts,
    one row each, give every range its offset.  Rows that tie in the order are
    numbered among themselves in no stated way, so it should end in a key.
    """
    parts = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    mark = f"_{name}_place"
    placed = stored(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn(mark, F.monotonically_increasing_id()), "numbered")
    range_of = F.shiftright(F.col(mark), PLACE_BITS)
    counts = placed.groupBy(range_of.alias("_range")).agg(F.count("*").alias("_n"))  # one row for each range
    before = F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("_range", F.coalesce(before, F.lit(0)).alias("_before"))
    numbers = placed.join(F.broadcast(offsets), range_of == F.col("_range"))
    place = F.col(mark).bitwiseAND(F.lit((1 << PLACE_BITS) - 1))
    return numbers.withColumn(name, F.col("_before") + place + 1).select(*rows.columns, name)


def hash_ranked(rows: DataFrame, key: str, within: list[str], name: str = "rank", seed: int = 42, buckets: int = 4096) -> DataFrame:
    """Each row's place (from 1) among the rows of its classes by a keyed hash.

    The hash is even, so buckets of equal width are of equal size; rows are ranked
    inside a bucket and moved on by the counts of the buckets before.
    """
    u = keyed_uniform(F.col(key), seed=seed)
    dealt = rows.withColumn("_u", u).withColumn("_bucket", F.floor(F.col("_u") * buckets).cast("int"))
    inside = F.row_number().over(Window.partitionBy(*within, "_bucket").orderBy("_u", key))
    names = [F.col(c).alias(f"_k{i}") for i, c in enumerate(within)]
    counts = dealt.groupBy(*names, F.col("_bucket").alias("_b")).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*[f"_k{i}" for i in range(len(within))]).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    on = F.col("_bucket") == F.col("_b")
    for i, c in enumerate(within):
        on = on & F.col(c).eqNullSafe(F.col(f"_k{i}"))
    ranked = dealt.withColumn("_place", inside).join(offsets, on)
    return ranked.withColumn(name, F.col("_place") + F.col("_before")).select(*rows.columns, name)
