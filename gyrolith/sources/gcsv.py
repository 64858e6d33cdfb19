"""Motion logs as text: a header of ``name,value`` lines, then ``t,gx,gy,gz`` rows (ms, rad/s)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: fixed values: first line and default fields of the log format
TITLE = "GYROFLOW IMU LOG"
FIELDS = (("version", "1.3"), ("tscale", "0.001"), ("gscale", "1.0"), ("ascale", "1.0"))


def rate_lines(df: DataFrame, keep: Sequence[str], time: str, rates: Sequence[str]) -> DataFrame:
    """Body lines of rates in deg/s at times in seconds."""
    line = F.format_string("%.3f,%.6f,%.6f,%.6f", F.col(time) * 1000, *[F.radians(r) for r in rates])
    return df.select(*keep, line.alias("line"))


def header(readout_ms: float | None = None, **fields: str) -> list[str]:
    lines = [TITLE, *[f"{k},{fields.pop(k, v)}" for k, v in FIELDS], *[f"{k},{v}" for k, v in fields.items()]]
    if readout_ms is not None:
        lines.append(f"frame_readout_time,{readout_ms:.6f}")
    return [*lines, "t,gx,gy,gz"]


def write_gcsv(df: DataFrame, path: str, time: str, rates: Sequence[str], readout_ms: float | None = None, keys: Sequence[str] = (), **fields: str) -> None:
    """Rates (deg/s) as logs in order of time: one log, or one a series (``keys``) in a folder named by its keys.

    A log is one text file, as the format asks, so its sort is one task; different logs are written
    by different tasks, and lines are made in parallel.
    """
    spark, keys = df.sparkSession, list(keys)
    lines = F.array(*[F.struct(F.lit(0).alias("part"), F.lit(float(k)).alias("at"), F.lit(line).alias("line")) for k, line in enumerate(header(readout_ms, **fields))])
    heads = (df.select(*keys).distinct() if keys else spark.range(1)).select(*keys, F.inline(lines))
    body = rate_lines(df, [*keys, time], time, rates).select(*keys, F.lit(1).alias("part"), F.col(time).alias("at"), "line")
    rows = heads.unionByName(body)
    rows = (rows.repartition(*keys) if keys else rows.repartition(1)).sortWithinPartitions(*keys, "part", "at").drop("part", "at")
    out = rows.write.mode("overwrite").option("lineSep", "\n")
    (out.partitionBy(*keys) if keys else out).text(path)


def read_gcsv(spark: SparkSession, path: str) -> DataFrame:
    """(path, t, gx, gy, gz) in seconds and deg/s, of any number of logs; header lines are dropped.

    A body line is four numbers; what comes before the ``t,`` line never is.
    """
    text = spark.read.text(path).select(F.input_file_name().alias("path"), F.split("value", ",").alias("p"))
    body = text.where((F.size("p") >= 4) & F.col("p")[0].rlike(r"^\s*-?[0-9.]+(?:[eE][-+]?\d+)?\s*$"))
    num = lambda k: F.col("p")[k].cast("double")
    return body.select("path", (num(0) / 1000).alias("t"), *[F.degrees(num(k)).alias(n) for k, n in ((1, "gx"), (2, "gy"), (3, "gz"))])


def write_flat(df: DataFrame, path: str, order: Sequence[str], columns: Sequence[str], keys: Sequence[str] = ()) -> None:
    """Rows as text, a number each with all its digits, in order; one file, or one a series (``keys``)."""
    keys = list(keys)
    line = F.format_string(",".join(["%.17e"] * len(columns)), *[F.col(c).cast("double") for c in columns])
    rows = df.select(*keys, *[F.col(c).alias(f"__o{k}") for k, c in enumerate(order)], line.alias("line"))
    rows = (rows.repartition(*keys) if keys else rows.repartition(1)).sortWithinPartitions(*keys, *[f"__o{k}" for k in range(len(order))]).select(*keys, "line")
    out = rows.write.mode("overwrite").option("lineSep", "\n")
    (out.partitionBy(*keys) if keys else out).text(path)
