"""Places within groups, when one group may hold a third of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def rank_within(df: DataFrame, group: Sequence[str], part: Column, order: Sequence[Column | str], weight: Column | None = None, name: str = "place") -> DataFrame:
    """``df`` with each row's place (from 1) in its group.

    ``part`` must rise with ``order``. Rows are ranked within (group, part) and parts start
    after one another, so a large group is spread over as many tasks as it has parts; only a
    count a part meets in one task. ``weight`` makes some rows count alone (0 or 1), or sums sizes.
    """
    counted = F.lit(1).cast("long") if weight is None else weight.cast("long")
    dealt = df.withColumns({"rank_part": part, "rank_weight": counted})
    held = dealt.groupBy(*group, "rank_part").agg(F.sum("rank_weight").alias("rank_held"))
    before = Window.partitionBy(*group).orderBy("rank_part").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("rank_held").over(before), F.lit(0)).alias("rank_start")
    keys = [*group, "rank_part"]
    starts = held.select(*[F.col(k).alias(f"rank_key{i}") for i, k in enumerate(keys)], start)
    inside = F.sum("rank_weight").over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    same = F.lit(True)
    for i, key in enumerate(keys):
        same = same & F.col(key).eqNullSafe(F.col(f"rank_key{i}"))
    return dealt.withColumn("rank_inside", inside).join(starts, same).select(*df.columns, (F.col("rank_start") + F.col("rank_inside")).alias(name))
