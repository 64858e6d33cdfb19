"""Registered queries of the training-data problems over their whole tables, and their SQL."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gyrolith.llm.bpe import encode_corpus
from gyrolith.llm.leaks import leaked_spans
from gyrolith.llm.nearest import match_nearest
from gyrolith.llm.residue import find_residue
from gyrolith.llm.runs import collapse_runs
from gyrolith.plans.bank import nan
from gyrolith.session import table

CLIP = ["series_id", "clip_no"]
TOLERANCE_S = 0.006


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each optical record, moved by its clip's shift, with the telemetry record nearest in time."""
    shift = table(spark, sf_dir, "alignment").where(F.col("shift").isNotNull() & ~F.isnan("shift"))
    shift = shift.groupBy(*CLIP).agg(F.min("shift").alias("shift"))
    optical = table(spark, sf_dir, "optical_rates").where(F.col("t").isNotNull()).select(*CLIP, F.col("idx").alias("opt_idx"), "t")
    optical = optical.join(shift, CLIP).select(*CLIP, "opt_idx", (F.col("t") + F.col("shift")).alias("t"))
    tele = table(spark, sf_dir, "telemetry").select(*CLIP, F.col("idx").alias("tele_idx"), "t")
    return match_nearest(optical, tele, CLIP, "t", "opt_idx", "t", "tele_idx", TOLERANCE_S).select(*CLIP, "opt_idx", "tele_idx")


def _orientation_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    tele = table(spark, sf_dir, "telemetry").select(F.lit("telemetry").alias("tbl"), *CLIP, "idx", "t", "w", "x", "y", "z")
    slot = table(spark, sf_dir, "slot_table").select(
        F.lit("slot_table").alias("tbl"), *CLIP, "idx", F.col("ts_ms").alias("t"), *[F.get("q_ref", F.lit(k)).alias(c) for k, c in enumerate("wxyz")]
    )
    return collapse_runs(tele.unionByName(slot), ["tbl", *CLIP], "t", "idx", ["w", "x", "y", "z"], shard=F.when(F.col("tbl") == "telemetry", 16.0).otherwise(16000.0))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of two or more records that say the same orientation."""
    return _orientation_runs(spark, sf_dir).where("n >= 2").select("tbl", *CLIP, "first_idx", "last_idx")


def p3_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per clip of the slot table the events left after collapsing, against what the writer reported."""
    left = _orientation_runs(spark, sf_dir).where("tbl = 'slot_table'").groupBy(*CLIP).agg(F.count(F.lit(1)).alias("n_events"))
    told = table(spark, sf_dir, "slot_table").groupBy(*CLIP).agg(F.max("n_dedup").alias("n_dedup"))
    both = told.join(left, CLIP, "left").withColumn("n_events", F.coalesce("n_events", F.lit(0)))
    return both.select(*CLIP, "n_events", F.col("n_dedup").cast("double").alias("n_dedup"), F.col("n_events").eqNullSafe(F.col("n_dedup")).alias("agrees"))


#: Where the vocabulary files lie; they are read from there and never copied.
TOKENIZERS = os.environ.get("GYROLITH_TOKENIZERS", "/opt/tokenizers")


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    return encode_corpus(table(spark, sf_dir, "documents"), f"{TOKENIZERS}/byte_bpe_50k.json")


def p7_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages to remove: document, leaked item, and the words it covers."""
    return leaked_spans(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the items they leak.  A document lies in one shard, so this needs no shuffle
    beyond putting together several spans of one item."""
    return p7_spans(spark, sf_dir).select("doc_id", "item_id").distinct()


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents to leave out: template residue, filler, error pages, script notices."""
    return find_residue(table(spark, sf_dir, "documents")).select("doc_id")


P1_SQL = f"""
with s as (select series_id, clip_no, min(shift) shift from alignment where shift is not null and not {nan('shift')} group by all),
o as (select distinct series_id, clip_no, idx opt_idx, t + shift as t from optical_rates join s using (series_id, clip_no) where t is not null),
e as (select distinct series_id, clip_no, idx tele_idx, t from telemetry where t is not null),
c as (select o.series_id, o.clip_no, opt_idx, tele_idx, abs(e.t - o.t) d from o join e on o.series_id = e.series_id and o.clip_no = e.clip_no and e.t between o.t - 0.0061 and o.t + 0.0061),
r as (select *, row_number() over (partition by series_id, clip_no, opt_idx order by d, tele_idx) k from c where d <= 0.006)
select series_id, clip_no, opt_idx, tele_idx from r where k = 1
"""

_RUNS_SQL = f"""
with u as (
  select 'telemetry' tbl, series_id, clip_no, idx, t, w, x, y, z from telemetry
  union all select 'slot_table', series_id, clip_no, idx, ts_ms, q_ref[1], q_ref[2], q_ref[3], q_ref[4] from slot_table),
v as (select distinct * from u where t is not null and not {nan('t')} and w + x + y + z is not null
  and not {nan('w')} and not {nan('x')} and not {nan('y')} and not {nan('z')} and not (w = 0 and x = 0 and y = 0 and z = 0)),
l as (select *, lag(w) over o pw, lag(x) over o px, lag(y) over o py, lag(z) over o pz from v window o as (partition by tbl, series_id, clip_no order by t, idx)),
b as (select *, case when pw is not null and (
    greatest(abs(w - pw), abs(x - px), abs(y - py), abs(z - pz)) <= 1e-6 or greatest(abs(w + pw), abs(x + px), abs(y + py), abs(z + pz)) <= 1e-6) then 0 else 1 end st from l),
g as (select *, sum(st) over (partition by tbl, series_id, clip_no order by t, idx) run from b),
runs as (select tbl, series_id, clip_no, run, count(*) n, arg_min(idx, (t, idx)) first_idx, arg_max(idx, (t, idx)) last_idx from g group by all)
"""

P3_SQL = _RUNS_SQL + "select tbl, series_id, clip_no, first_idx, last_idx from runs where n >= 2"

P3_DEDUP_SQL = (
    _RUNS_SQL
    + """, e as (select series_id, clip_no, count(*) n_events from runs where tbl = 'slot_table' group by all),
d as (select series_id, clip_no, max(n_dedup) n_dedup from slot_table group by all)
select series_id, clip_no, cast(coalesce(n_events, 0) as bigint) n_events, cast(n_dedup as double) n_dedup, coalesce(n_events, 0) is not distinct from n_dedup as agrees
from d left join e using (series_id, clip_no)"""
)

QUERIES = {"p1_found": p1_found, "p3_found": p3_found, "p3_dedup": p3_dedup, "p6_ids": p6_ids, "p7_found": p7_found, "p7_spans": p7_spans, "p8_found": p8_found}
ORACLE = {"p1_found": P1_SQL, "p3_found": P3_SQL, "p3_dedup": P3_DEDUP_SQL}
