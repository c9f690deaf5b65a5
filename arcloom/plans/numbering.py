"""Numbering rows through in an order, without bringing them into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import stored

#: monotonically_increasing_id() counts rows within a partition in its low 33 bits.
_WITHIN = (1 << 33) - 1


def numbered(df: DataFrame, *order: str, name: str = "n", start: int = 0) -> DataFrame:
    """``df`` with the place of each row in the order of some columns, from ``start`` on.

    Rows are dealt out by range and sorted where they lie; only one count for each partition comes to the driver. Rows
    that are equal in the order columns get places in any order among themselves.
    """
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = stored(dealt.withColumns({"_p": F.spark_partition_id(), "_k": F.monotonically_increasing_id().bitwiseAND(F.lit(_WITHIN))}), "numbered")
    total, before = start, []
    for part, n in sorted(tuple(r) for r in placed.groupBy("_p").count().collect()):
        before.append((part, total))
        total += n
    bases = df.sparkSession.createDataFrame(before, "_p int, _base long")
    return placed.join(F.broadcast(bases), "_p").withColumn(name, F.col("_base") + F.col("_k")).drop("_p", "_k", "_base")  # one row a partition
