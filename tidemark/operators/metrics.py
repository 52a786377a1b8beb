"""Operation counters and latency percentiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .sizes import small

QUANTILES = (0.5, 0.95, 0.99)
BINS = 4096


def op_summary(ops: DataFrame, by: str = "op") -> DataFrame:
    """Total, errors and mean latency of each operation."""
    return ops.groupBy(by).agg(F.count("*").alias("total"), F.count_if("error").alias("errors"), F.round(F.avg("latency_ms"), 6).alias("mean_ms"))


def floor_percentiles(ops: DataFrame, by: str = "op", value: str = "latency_ms", quantiles=QUANTILES) -> DataFrame:
    """(by, p50, p95, p99): exact order statistics, the value at index floor(n * q) of the sorted values.

    Groups, which are few next to the rows, are counted and broadcast, so that a
    hot group's rows stay where they are. Nothing is gathered whole: values are counted in bins between each group's
    least and largest, the bin that holds each index is found from the counts,
    and only that bin's distinct values, each with its count, are put in order.
    The two small tables, spans and wanted bins, are kept, so that the rows are
    read three times. Null values don't count; a group without any has 0.
    """
    rows = ops.select(by, F.col(value).alias("v")).filter("v is not null")
    span = ops.groupBy(by).agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.count(value).alias("n")).persist()
    width = (F.col("hi") - F.col("lo")) / BINS
    binned = rows.join(small(span), by).withColumn("bin", F.when(width > 0, F.least(F.floor((F.col("v") - F.col("lo")) / width), F.lit(BINS - 1))).otherwise(0))
    upto = Window.partitionBy(by).orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counts = binned.groupBy(by, "bin").agg(F.count("*").alias("c"), F.first("n").alias("n")).withColumn("upto", F.sum("c").over(upto))
    wanted = F.explode(F.array(*[F.struct(F.lit(f"p{round(q * 100)}").alias("name"), F.least(F.floor(F.col("n") * F.lit(q)), F.col("n") - 1).alias("at")) for q in quantiles])).alias("w")
    target = counts.select(by, "bin", "c", "upto", wanted).filter((F.col("w.at") < F.col("upto")) & (F.col("w.at") >= F.col("upto") - F.col("c")))
    target = target.select(by, "bin", F.col("w.name").alias("name"), (F.col("w.at") - (F.col("upto") - F.col("c"))).alias("place")).persist()
    inside = binned.join(small(target.select(by, "bin").distinct()), [by, "bin"], "left_semi").groupBy(by, "bin", "v").agg(F.count("*").alias("c"))
    ranked = inside.withColumn("end", F.sum("c").over(Window.partitionBy(by, "bin").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    hits = ranked.join(target, [by, "bin"]).filter((F.col("place") < F.col("end")) & (F.col("place") >= F.col("end") - F.col("c")))
    hits = hits.groupBy(by).pivot("name", [f"p{round(q * 100)}" for q in quantiles]).agg(F.first("v"))
    return span.select(by).join(hits, by, "left").select(by, *[F.coalesce(f"p{round(q * 100)}", F.lit(0.0)).alias(f"p{round(q * 100)}") for q in quantiles])


def gauges(ops: DataFrame) -> DataFrame:
    """(name, value) of the five gauges over all operations: total, errors and three percentiles."""
    every = ops.withColumn("op", F.lit("all"))
    total = every.agg(F.count("*").cast("double").alias("ops_total"), F.count_if("error").cast("double").alias("ops_errors"))
    p = floor_percentiles(every)
    wide = total.join(p.drop("op"), how="left")
    names = ("ops_total", "ops_errors", "p50", "p95", "p99")
    pairs = F.array(*[F.struct(F.lit(n if n.startswith("ops") else f"latency_ms_{n}").alias("name"), F.coalesce(n, F.lit(0.0)).alias("value")) for n in names])
    return wide.select(F.explode(pairs).alias("g")).select("g.name", "g.value")


def exposition(ops: DataFrame) -> str:
    """The gauges as text, a line each."""
    return "".join(f"{r['name']} {r['value']:g}\n" for r in gauges(ops).collect())
