"""Places in an order over a whole table: counts per partition and their prefix sums, without a window over all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausewright.sources.tables import stored

_BITS = 33  # monotonically_increasing_id() keeps the partition above these bits and the row's place in it below


def number_rows(rows: DataFrame, order: Sequence[Column], name: str, partitions: int | None = None) -> DataFrame:
    """``rows`` with a long column ``name``: 1, 2, 3, ... in the order given; rows that tie are numbered in any order.

    Rows are written with a tie-breaker, dealt into ranges of the order, sorted within each and written again with their places, so that a
    task that runs again deals and numbers as before. Many rows that tie share no range. Only one count for each partition passes through the
    driver. A column of that name is replaced; an empty table gives an empty one.
    """
    spark = rows.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    first = stored(rows.drop(name).withColumn("__tie", F.monotonically_increasing_id()), "unnumbered")
    keys = [*order, F.col("__tie")]
    ranged = first.repartitionByRange(n, *keys).sortWithinPartitions(*keys).drop("__tie")
    written = stored(ranged.withColumn("__place", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("__place", _BITS).cast("int")
    total, before = 0, []
    for r in sorted(written.groupBy(part.alias("part")).count().collect()):
        before.append((r["part"], total))
        total += r["count"]
    offsets = spark.createDataFrame(before, "__part int, __before long")  # one row for each partition
    within = F.col("__place").bitwiseAND(F.lit((1 << _BITS) - 1))
    joined = written.withColumn("__part", part).join(F.broadcast(offsets), "__part", "left")
    return joined.withColumn(name, F.col("__before") + within + 1).drop("__place", "__part", "__before")
