from __future__ import annotations

import numpy as np
import pandas as pd

from gyrolith.functions.design import low_pass, steady
from gyrolith.operators.filters import lfilter
from gyrolith.streaming.causal import stream_bursts, stream_grid_counts, stream_low_pass


def run(spark, stream, name, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return spark.table(name).toPandas()


def files(spark, tmp_path, frames):
    for k, f in enumerate(frames):
        f.to_parquet(tmp_path / f"{k}.parquet", index=False, coerce_timestamps="us")
    schema = spark.read.parquet(str(tmp_path / "0.parquet")).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path))


def test_low_pass_over_batches_equals_one_pass(spark, tmp_path):
    rng = np.random.default_rng(0)
    n = 120
    pdf = pd.DataFrame({"g": np.repeat(["a", "b"], n), "i": np.tile(np.arange(n), 2), "v": rng.normal(size=2 * n)})
    stream = files(spark, tmp_path, [pdf[(pdf.i >= a) & (pdf.i < a + 40)] for a in (0, 40, 80)])
    f = low_pass(2, 0.1)
    got = run(spark, stream_low_pass(stream, ["g"], "i", "v", f, "y"), "low").sort_values(["g", "i"])
    x = pdf[pdf.g == "b"].v.to_numpy()
    assert np.allclose(got[got.g == "b"].y.to_numpy(), lfilter(f, x, steady(f) * x[0])[0])


def test_bursts_and_counts_close_by_watermark(spark, tmp_path):
    ts = pd.to_datetime("2024-01-01") + pd.to_timedelta([0, 1, 2, 30, 31, 300, 301], unit="s")
    pdf = pd.DataFrame({"g": "a", "ts": ts.tz_localize("UTC"), "v": [9.0, 9, 1, 9, 9, 1, 1]})
    late = pdf.assign(ts=pdf.ts + pd.to_timedelta(1000, unit="s"), v=1.0)
    got = run(spark, stream_bursts(files(spark, tmp_path, [pdf, late]), ["g"], "ts", "v", 5.0, "10 seconds", "5 seconds"), "bursts")
    assert got.n.tolist() == [2]  # the later session stays open: only loud readings move the watermark
    counts = run(spark, stream_grid_counts(files(spark, tmp_path, [pdf, late]), ["g"], "ts", "1 minute", "5 seconds"), "counts")
    assert counts.n.sum() >= 7
