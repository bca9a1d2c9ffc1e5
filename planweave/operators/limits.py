"""Measures of elements against limits: lookup of the measure, equi join on what a limit is about, comparison by its kind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def holds(value: Column, comparator: Column, lo: Column, hi: Column) -> Column:
    """Whether a value meets a limit; a range includes both ends; an unknown comparator is not met, a null value is null."""
    return (
        F.when(comparator == ">=", value >= lo).when(comparator == "<=", value <= lo).when(comparator == ">", value > lo).when(comparator == "<", value < lo)
        .when(comparator == "range", value.between(lo, hi)).otherwise(F.lit(False))
    )


def room_measures(rooms: DataFrame) -> DataFrame:
    """(plan_id, element_id, category, property, value) of each room: area in m², shorter and longer side in m."""
    kinds = {"area": F.col("area_m2"), "min_side": F.col("width_mm") / 1000, "max_side": F.col("length_mm") / 1000}
    each = F.array(*[F.struct(F.lit(k).alias("property"), v.alias("value")) for k, v in kinds.items()])
    return rooms.select("plan_id", F.col("room_id").alias("element_id"), "category", F.explode(each).alias("m")).select("plan_id", "element_id", "category", "m.*")


def checked(limits: DataFrame, measured: DataFrame, on: tuple[str, ...] = ("category", "property")) -> DataFrame:
    """Each limit beside each measure it is about, with ``ok``; an equi join, the limits being the smaller side."""
    return measured.join(limits, list(on)).withColumn("ok", holds(*(F.col(c) for c in ("value", "comparator", "lo", "hi"))))


def states(plans: DataFrame, limits: DataFrame, measured: DataFrame) -> DataFrame:
    """(plan_id, category, property, measured, held, state) of each limit in each plan, also where the plan has nothing it is about.

    Measures are counted per plan first; the limits, a list that a caller writes, are set beside each plan as an array.
    """
    per = checked(limits, measured).groupBy("plan_id", "category", "property").agg(
        F.count("*").alias("n"), F.count("value").alias("measured"), F.count_if("ok").alias("held"), F.count_if(~F.col("ok")).alias("broken")
    )
    listed = [F.struct(F.lit(r["category"]).alias("category"), F.lit(r["property"]).alias("property")) for r in limits.select("category", "property").distinct().collect()]
    all_ = plans.select("plan_id", F.explode(F.array(*listed)).alias("l")).select("plan_id", "l.*")
    out = all_.join(per, ["plan_id", "category", "property"], "left")
    state = F.when(F.col("n").isNull(), "absent").when(F.col("measured") == 0, "unmeasured").when(F.col("broken") > 0, "broken").otherwise("held")
    return out.select("plan_id", "category", "property", F.coalesce("measured", F.lit(0)).alias("measured"), F.coalesce("held", F.lit(0)).alias("held"), state.alias("state"))
