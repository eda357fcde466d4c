"""Row numbers within groups of any size, without a task that holds a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut


def _same(left: list[str], right: list[str]) -> Column:
    """Equal keys, null like any other value."""
    found = F.lit(True)
    for a, b in zip(left, right, strict=True):
        found = found & F.col(a).eqNullSafe(F.col(b))
    return found


def ranked(df: DataFrame, by: list[str], order: list[Column | str], n: str = "__n", total: str = "__all") -> DataFrame:
    """df with n, the place of each row in its group from 0, and total, the rows of the group.

    by may be empty (one group: all rows); a null key is a group like any other. Rows equal in
    `order` stand in the order of a hash of all their columns, so only equal rows are
    interchangeable. An empty table gives an empty one.

    Rows are dealt by ranges of (by, order), so a group lies in as many partitions as its size
    needs, and are written as they lie: a rank is then the place in the partition, plus the rows
    of the group in earlier partitions. Only the counts of (partition, group) meet in windows: a
    group has at most one of them a partition.
    """
    tie = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns if not dict(df.dtypes)[c].startswith("map")])
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    sort = [*[F.col(c) for c in by], *order, tie]
    dealt = df.repartitionByRange(*sort).sortWithinPartitions(*sort)
    # the number of a row in its partition is in the lower 33 bits
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    rows = cut(dealt.withColumns({"__part": F.spark_partition_id(), "__at": place}))
    counts = rows.groupBy("__part", *by).agg(F.min("__at").alias("__first"), F.count("*").alias("__rows"))
    group = Window.partitionBy(*by)
    before = F.coalesce(F.sum("__rows").over(group.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.withColumns({"__before": before, total: F.sum("__rows").over(group)})
    c = counts.select(F.col("__part").alias("__p"), *[F.col(k).alias(f"__b{i}") for i, k in enumerate(by)], "__first", "__before", total)
    same = _same(by, [f"__b{i}" for i in range(len(by))])
    found = rows.join(c, (F.col("__part") == F.col("__p")) & same).withColumn(n, F.col("__at") - F.col("__first") + F.col("__before"))
    return found.select(*[f"`{x}`" for x in df.columns], n, total)


#: Standard deviations by which a threshold is set too high, so that too few rows pass once in some 30,000 groups.
SPARE = 4


def threshold(n: Column | int, total: Column) -> Column:
    """The number of [0, 1) under which somewhat more than n of `total` uniform ones lie."""
    n = F.lit(n) if isinstance(n, int) else n
    return (n + SPARE * F.sqrt(n) + SPARE * SPARE) / total


def first_by_hash(df: DataFrame, by: list[str], n: int, order: Column, ties: list[str]) -> DataFrame:
    """The n rows of each group that come first by `order`, a hex digest, then `ties`; all rows of a smaller group.

    No group is sorted: the group's count gives a threshold on the digest under which about n rows
    lie, and only those are ranked. A group in which fewer than n pass gets twice the threshold,
    and again, so the result is exact. A null key is a group; an empty table gives an empty one.
    """
    uniform = F.conv(F.substring("__h", 1, 8), 16, 10).cast("bigint") / 4294967296.0
    rows, columns, keys = df.withColumn("__h", order), df.columns, [f"__b{i}" for i in range(len(by))]
    counts = df.groupBy(*by).agg(F.count("*").alias("__all"))
    open_ = cut(counts.select(*[F.col(k).alias(b) for k, b in zip(by, keys, strict=True)], "__all", threshold(n, F.col("__all")).alias("__p")))
    found = None
    while True:
        passed = cut(rows.join(open_, _same(by, keys)).where(uniform < F.col("__p")).select(*columns, "__h"))
        place = F.row_number().over(Window.partitionBy(*by).orderBy("__h", *ties))
        # groups that are still short are taken out below
        enough = passed.groupBy(*by).agg(F.count("*").alias("__passed"))
        enough = enough.select(*[F.col(k).alias(f"{k}__e") for k in by], "__passed")
        state = open_.join(enough, _same(keys, [f"{k}__e" for k in by]), "left")
        short = state.where(F.coalesce("__passed", F.lit(0)) < F.least(F.lit(n), "__all")).select(*keys, "__all", (2 * F.col("__p")).alias("__p"))
        none_short = short.isEmpty()
        if not none_short:
            short = cut(short)
            passed = passed.join(short, _same(by, keys), "left_anti")
        done = passed.withColumn("__n", place).where(F.col("__n") <= n).select(*columns)
        found = done if found is None else found.unionAll(done)
        if none_short:
            return found
        open_ = short
