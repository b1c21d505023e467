"""Running values along groups that may be larger than a task.

Rows are cut into slices of one order (group, then the given order), so a large group lies in many slices and a small one in one. Each
slice has a running value of its own; what a slice takes over from those before it in its group is a row for each slice
at most, since only a slice's first group goes on from before. That table is broadcast and put on top.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracepath.plans.session import cut

#: How values of two stretches become that of both.
JOINED = {"max": F.greatest, "min": F.least, "sum": lambda a, b: a + b}


def scan(df: DataFrame, group: tuple[str, ...], order: list[Column], slices: int | None = None, **running: tuple[str, Column]) -> DataFrame:
    """Adds for each name the running maximum, minimum or sum ("max", "min", "sum", and of what) of a row and those before it in its
    group. Null values are passed over; group columns hold no nulls. Rows that are equal in the order stand in any order, so it should tell all rows apart that matter."""
    slices = slices or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    values = {f"_{name}": value for name, (_, value) in running.items()}
    cuts = cut(df.withColumns(values).repartitionByRange(slices, *map(F.col, group), *order).withColumn("_slice", F.spark_partition_id()))
    folds = {name: getattr(F, how)(f"_{name}") for name, (how, _) in running.items()}
    whole = cuts.groupBy(*group, "_slice").agg(*[f.alias(name) for name, f in folds.items()])
    before = Window.partitionBy(*group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    over = whole.select(*group, "_slice", F.count(F.lit(1)).over(before).alias("_n"), *[getattr(F, how)(name).over(before).alias(f"_{name}_before") for name, (how, _) in running.items()])
    over = over.where("_n > 0").drop("_n")  # a row for each slice at most
    here = Window.partitionBy(*group, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = cuts.join(F.broadcast(over), [*group, "_slice"], "left").withColumns({name: f.over(here) for name, f in folds.items()})
    for name, (how, _) in running.items():
        b, h = F.col(f"_{name}_before"), F.col(name)
        out = out.withColumn(name, F.when(b.isNull(), h).when(h.isNull(), b).otherwise(JOINED[how](b, h)))
    return out.select(*df.columns, *running)
