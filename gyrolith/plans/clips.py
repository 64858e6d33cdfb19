"""Registered queries of the container: files built from the whole slot table, read, patched and read again.

Each clip of ``slot_table`` becomes a container in the shared folder, four slots a sample, its stored
components (``q_file``) as float32.  The SQL looks at the table alone.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gyrolith.plans import bank
from gyrolith.plans import container as C
from gyrolith.plans.series import _r, rounded
from gyrolith.session import durable, scratch, table
from gyrolith.sources import container as S

PER_SAMPLE = 4


def _built(s, d) -> str:
    """Pattern of the files built; they lie in the session's shared folder, which executors see as a mounted path."""
    folder = re.sub("^file:/+", "/", scratch(s))
    x = table(s, d, "slot_table").where("q_file is not null").select("series_id", "clip_no", "idx", "q_file").dropDuplicates(["series_id", "clip_no", "idx"])
    x = x.withColumn("name", F.concat_ws("-", "series_id", "clip_no")).withColumn("sample", F.floor(F.col("idx") / PER_SAMPLE).cast("long"))
    x = x.groupBy("name", "sample").agg(F.sort_array(F.collect_list(F.struct("idx", "q_file"))).alias("q"))  # at most PER_SAMPLE each
    x = x.select("name", "sample", (1_000_000 + F.col("sample") * 10_000).alias("frame_ts"), F.lit(0.0).alias("att_offset"), F.col("q.q_file").alias("quats"))
    done = S.write_containers(x, folder)
    done.agg(F.sum("n_samples")).first()  # one number: the files are there
    return f"{folder}/*.mp4"


def _named(df: DataFrame) -> DataFrame:
    name = F.regexp_extract("path", r"([^/]+)\.mp4$", 1)
    return df.withColumn("series_id", F.regexp_extract(name, r"^(.*)-(-?\d+)$", 1)).withColumn("clip_no", F.regexp_extract(name, r"-(-?\d+)$", 1).cast("long"))


def _slots(s, pattern: str) -> DataFrame:
    return C.slots(S.read_containers(s, pattern, parts=2))


def container_slots(s, d):
    """Every stored orientation as read from the files: file and output frame, and time."""
    x = _named(_slots(s, _built(s, d)))
    return rounded(x.select("series_id", "clip_no", "sample", F.col("j").cast("long").alias("j"), *[f"f{k}" for k in range(4)], *"wxyz", "t_ms"), *[f"f{k}" for k in range(4)], *"wxyz", "t_ms")


def container_probe(s, d):
    """Number of samples per file, and how many carry orientations."""
    return _named(C.probe(S.read_containers(s, _built(s, d)))).select("series_id", "clip_no", "n", "n_with")


def _rewritten(s, d, change: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    pattern = _built(s, d)
    rows = C.numbered_slots(_slots(s, pattern))
    target = None
    if change:
        stream = C.extract(rows.drop("pos", "n", "t"), C.FILE, F.col("t_ms") / 1000, ["sample", "j"])
        # every fifth orientation turned a little
        target = stream.select("path", "dedup_idx", "w", F.when(F.col("dedup_idx") % 5 == 2, F.col("x") + 0.25).otherwise(F.col("x")).alias("x"), "y", "z")
    plan = durable(C.patch_plan(rows, target))
    folder = pattern.rpartition("/")[0]
    out = F.concat(F.lit(folder + "/out-"), F.substring_index("path", "/", -1))
    old = lambda c: F.concat(F.lit(folder + "/"), F.substring(F.substring_index(c, "/", -1), 5, 1 << 30))
    done = durable(S.write_slots(plan.withColumn("out_path", out)))
    again = _slots(s, f"{folder}/out-*.mp4").withColumn("path", old("path"))
    again = durable(again.select("path", "sample", "j", "t_ms", "offs", *[f"f{k}" for k in range(4)]))  # read twice below
    return rows, plan, done.select("n_written", "error", old("out_path").alias("path")).join(C.round_trip(plan, again, rows), "path")


def container_round_trip(s, d):
    """A patch written and read back: components written and wrong, slots and wrong times."""
    return _named(_rewritten(s, d, True)[2]).select("series_id", "clip_no", "n_written", "n", "n_wrong", "n_slots", "n_time_wrong")


def container_null_patch(s, d):
    """A patch without a target leaves every component as it is, and every byte."""
    rows, plan, done = _rewritten(s, d, False)
    folder = F.regexp_extract("path", r"^(.*)/[^/]+$", 1)
    old = plan.groupBy("path").agg(F.count(F.lit(1)).alias("components"))
    data = s.read.format("binaryFile").load(shared_pattern(s, rows)).select(F.regexp_replace("path", "^file:/*", "/").alias("p"), F.sha2("content", 256).alias("sha"))
    new = data.where(F.col("p").contains("/out-")).select(F.regexp_replace("p", "/out-", "/").alias("path"), F.col("sha").alias("after"))
    was = data.where(~F.col("p").contains("/out-")).select(F.col("p").alias("path"), F.col("sha").alias("before"))
    x = done.join(old, "path").join(was, "path").join(new, "path")
    return _named(x).select("series_id", "clip_no", "components", (F.col("before") == F.col("after")).alias("same_bytes"))


def shared_pattern(s, rows: DataFrame) -> str:
    """Pattern of the folder the rows' files lie in."""
    return rows.agg(F.min(F.regexp_extract("path", r"^(.*)/[^/]+$", 1))).first()[0] + "/*.mp4"


def decode_agreement(s, d):
    """Orientation series read from a file and from the table it was made of: counts, largest differences, verdict."""
    keys = ["series_id", "clip_no"]
    x = _named(_slots(s, _built(s, d)))
    mine = C.extract(x.select(*keys, "sample", "j", "t_ms", *"wxyz"), keys, F.col("t_ms") / 1000, ["sample", "j"])
    t = table(s, d, "slot_table").where("q_file is not null").select(*keys, "idx", "q_file").dropDuplicates([*keys, "idx"])
    q = C.Qn.file_to_out(tuple(F.get("q_file", F.lit(k)).cast("float").cast("double") for k in range(4)))
    t = t.select(*keys, F.floor(F.col("idx") / PER_SAMPLE).cast("long").alias("sample"), "idx", *[c.alias(n) for c, n in zip(q, "wxyz")])
    size = F.greatest(*[F.abs(F.col(c)) for c in "wxyz"])
    t = t.withColumns({"n": F.count(F.lit(1)).over(C.Window.partitionBy(*keys, "sample")), "j": F.row_number().over(C.Window.partitionBy(*keys, "sample").orderBy("idx")) - 1})
    first = t.groupBy(*keys).agg(F.min("sample").alias("s0"))
    t = t.join(first, keys).withColumn("t_ms", (F.col("sample") - F.col("s0")) * 10.0 + F.col("j") / F.col("n") * 10.0).where(~F.isnan(size) & (size > 0))
    other = C.extract(t.select(*keys, "sample", "j", "t_ms", *"wxyz"), keys, F.col("t_ms") / 1000, ["sample", "j"])
    return C.decode_check(mine, other, keys).select(*keys, "n_left", "n_right", "ok")


_SL = f"""sl as (select distinct series_id, clip_no, idx, q_file from slot_table where q_file is not null),
st as (select series_id, clip_no, idx // {PER_SAMPLE} sample, row_number() over (partition by series_id, clip_no, idx // {PER_SAMPLE} order by idx) - 1 j, count(*) over (partition by series_id, clip_no, idx // {PER_SAMPLE}) n,
  q_file[1]::float::double a, q_file[2]::float::double b, q_file[3]::float::double c, q_file[4]::float::double d from sl),
sx as (select *, min(sample) over (partition by series_id, clip_no) s0 from st),
ss as (select * from sx where not {bank.nan('a+b+c+d')} and not (a = 0 and b = 0 and c = 0 and d = 0))"""
# half turn about y, times the change of axes (1, -1, -1, 1) / 2
SLOTS_SQL = f"""with {_SL}, h as (select *, -c hw, d hx, a hy, -b hz from ss)
select series_id, clip_no, sample, j, {_r('a f0', 'b f1', 'c f2', 'd f3', '(hw*0.5+hx*0.5+hy*0.5-hz*0.5) w', '(-hw*0.5+hx*0.5+hy*0.5+hz*0.5) x', '(-hw*0.5-hx*0.5+hy*0.5-hz*0.5) y', '(hw*0.5-hx*0.5+hy*0.5+hz*0.5) z', '((sample-s0)*10.0+j/n*10.0) t_ms')} from h"""
PROBE_SQL = f"with {_SL} select series_id, clip_no, count(distinct sample) n, count(distinct sample) n_with from st group by all"
TRIP_SQL = f"with {_SL} select series_id, clip_no, count(*) * 4 n_written, count(*) * 4 n, 0::bigint n_wrong, count(*) n_slots, 0::bigint n_time_wrong from ss group by all"
NULL_SQL = f"with {_SL} select series_id, clip_no, count(*) * 4 components, true as same_bytes from ss group by all"
AGREE_SQL = f"""with {_SL}, o as (select *, row_number() over (partition by series_id, clip_no order by sample, j) rn from ss),
p as (select *, lag(a) over w pa, lag(b) over w pb, lag(c) over w pc, lag(d) over w pd from o window w as (partition by series_id, clip_no order by rn)),
k as (select series_id, clip_no, count(*) m from p where pa is null or not (a = pa and b = pb and c = pc and d = pd) group by all)
select series_id, clip_no, m n_left, m n_right, true as ok from k"""

QUERIES = {f.__name__: f for f in (container_slots, container_probe, container_round_trip, container_null_patch, decode_agreement)}
ORACLE = {"container_slots": SLOTS_SQL, "container_probe": PROBE_SQL, "container_round_trip": TRIP_SQL, "container_null_patch": NULL_SQL, "decode_agreement": AGREE_SQL}
