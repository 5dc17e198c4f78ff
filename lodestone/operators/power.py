"""Power samples to energy."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numbers

PARTS = ("cpu", "gpu", "ram")


def since_start(samples: DataFrame, run: str, ts: str, joules: str) -> DataFrame:
    """watts of each sample: the mean since its run began; null at the start."""
    own = Window.partitionBy(run).orderBy(ts, joules)
    return samples.withColumn("watts", numbers.watts_since(F.col(joules), F.first(joules).over(own), F.col(ts), F.first(ts).over(own)))


def medians(samples: DataFrame, by: str) -> DataFrame:
    """The median watts of each part, null for none."""
    return samples.groupBy(by).agg(*[F.median(f"{p}_watts").alias(f"{p}_watts") for p in PARTS])


def energy(measured: DataFrame, seconds: str) -> DataFrame:
    """kWh of each part and in total over the time in column seconds."""
    total = sum((F.col(f"{p}_watts") for p in PARTS[1:]), F.col("cpu_watts"))
    parts = {f"{p}_kWh": numbers.kwh(F.col(f"{p}_watts"), F.col(seconds)) for p in PARTS}
    return measured.withColumns({**parts, "total_kWh": numbers.kwh(total, F.col(seconds)), "duration": F.col(seconds)})


def totals(events: DataFrame, by: str) -> DataFrame:
    """Over events (name, cpu_kWh, ..., duration): what a query took, which leaves out the index, and sums of everything."""
    sums = [F.sum(c).alias(c) for c in ("cpu_kWh", "gpu_kWh", "ram_kWh", "total_kWh", "duration")]
    return events.groupBy(by).agg(F.coalesce(F.sum(F.when(F.col("name") != "power_index", F.col("total_kWh"))), F.lit(0.0)).alias("per_query_kWh"), *sums)


def last_of_index(records: DataFrame) -> DataFrame:
    """The record that the last data set left, as there is one file for all."""
    return records.orderBy(F.desc("written")).limit(1)
