"""Registered queries of the general problems over their whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gyrolith.operators.grid import missing_periods, regular_grid
from gyrolith.operators.outliers import clean_outliers, telemetry_outliers
from gyrolith.operators.periods import micros, periods_and_gaps
from gyrolith.plans.bank import nan
from gyrolith.session import table

CLIP = ["series_id", "clip_no"]
GRID_US = 100_000


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Continuous burst periods of each clip and the gaps between them."""
    rows = table(spark, sf_dir, "burst_stat").select(*CLIP, "start_s", "end_s")
    rows = rows.where(~F.isnan("start_s") & ~F.isnan("end_s") & (F.col("end_s") > F.col("start_s")))
    return periods_and_gaps(rows, CLIP, micros(F.col("start_s")), micros(F.col("end_s")))


def _readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    tele = table(spark, sf_dir, "telemetry").where(F.col("t").isNotNull() & ~F.isnan("t"))
    tele = tele.select(F.lit("telemetry").alias("tbl"), *CLIP, micros(F.col("t")).alias("us"))
    scan = table(spark, sf_dir, "scan_sample").where(F.col("frame_ts") != 0)
    return tele.unionByName(scan.select(F.lit("scan_sample").alias("tbl"), *CLIP, F.col("frame_ts").alias("us")))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periods of 100 ms of a clip's series that no reading has."""
    return missing_periods(_readings(spark, sf_dir), ["tbl", *CLIP], F.col("us"), GRID_US)


def p4_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole regular series of frame times: each period's last frame size, carried over gaps."""
    scan = table(spark, sf_dir, "scan_sample").where(F.col("frame_ts") != 0)
    grid = regular_grid(scan, CLIP, F.col("frame_ts"), GRID_US, F.col("sample_bytes"), record=["idx"])
    return grid.select(*CLIP, "bin_no", "n_readings", F.round("value", 6).alias("value"), "is_filled")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings that spike, stick or cannot be."""
    tele = telemetry_outliers(table(spark, sf_dir, "telemetry")).select(F.lit("telemetry").alias("tbl"), *CLIP, "idx", "field")
    clean = clean_outliers(table(spark, sf_dir, "clean_diag")).select(F.lit("clean_diag").alias("tbl"), *CLIP, "idx", "field")
    return tele.unionByName(clean).distinct()


P2_SQL = f"""
with v as (
  select distinct series_id, clip_no, cast(round(start_s * 1e6) as bigint) a, cast(round(end_s * 1e6) as bigint) b
  from burst_stat where not {nan('start_s')} and not {nan('end_s')} and end_s > start_s),
m as (select *, max(b) over (partition by series_id, clip_no order by a, b rows between unbounded preceding and 1 preceding) pr from v),
k as (select *, sum(case when pr is null or a > pr then 1 else 0 end) over (partition by series_id, clip_no order by a, b) g from m),
r as (select series_id, clip_no, g, min(a) a, max(b) b from k group by all),
x as (select *, lead(a) over (partition by series_id, clip_no order by a) na from r)
select series_id, clip_no, 'period' as what, a as start_us, b as end_us from r
union all select series_id, clip_no, 'gap', b, na from x where na is not null
"""

P4_SQL = f"""
with u as (
  select 'telemetry' tbl, series_id, clip_no, cast(round(t * 1e6) as bigint) us from telemetry where t is not null and not {nan('t')}
  union all select 'scan_sample', series_id, clip_no, frame_ts from scan_sample where frame_ts <> 0),
b as (select distinct tbl, series_id, clip_no, cast(floor(us / 100000) as bigint) bin_no from u),
r as (select tbl, series_id, clip_no, min(bin_no) lo, max(bin_no) hi from b group by all),
e as (select tbl, series_id, clip_no, unnest(range(lo, hi + 1)) bin_no from r)
select tbl, series_id, clip_no, bin_no from e anti join b using (tbl, series_id, clip_no, bin_no)
"""

P4_GRID_SQL = """
with s as (select distinct series_id, clip_no, idx, frame_ts, sample_bytes from scan_sample where frame_ts <> 0),
b as (
  select series_id, clip_no, cast(floor(frame_ts / 100000) as bigint) bin_no, count(*) n, cast(arg_max(sample_bytes, (frame_ts, sample_bytes)) as double) v
  from s group by all),
r as (select series_id, clip_no, min(bin_no) lo, max(bin_no) hi from b group by all),
e as (select series_id, clip_no, unnest(range(lo, hi + 1)) bin_no from r)
select series_id, clip_no, bin_no, cast(coalesce(n, 0) as bigint) n_readings,
  round(last_value(v ignore nulls) over (partition by series_id, clip_no order by bin_no), 6) as value, n is null as is_filled
from e left join b using (series_id, clip_no, bin_no)
"""

QUERIES = {"p2_found": p2_found, "p4_found": p4_found, "p4_grid": p4_grid, "p5_found": p5_found}
ORACLE = {"p2_found": P2_SQL, "p4_found": P4_SQL, "p4_grid": P4_GRID_SQL}
