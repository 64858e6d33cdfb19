"""Lens tags (JSON) to typed columns; a wrong shape is null, never an error."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TAG = "fisheye_params struct<camera_matrix: array<array<double>>, distortion_coeffs: array<double>>, calib_dimension struct<w: double, h: double>"


def lens_columns(df: DataFrame, tag: str) -> DataFrame:
    """Add camera_matrix (3x3), distortion (four), calib_w, calib_h from a JSON column."""
    j = F.from_json(F.col(tag), TAG)
    m = j["fisheye_params"]["camera_matrix"]
    good = (F.size(m) >= 3) & F.forall(F.slice(m, 1, 3), lambda r: F.size(r) >= 3)
    d = j["fisheye_params"]["distortion_coeffs"]
    return df.withColumns(
        {
            "camera_matrix": F.when(good, F.transform(F.slice(m, 1, 3), lambda r: F.slice(r, 1, 3))),
            "distortion": F.when(F.size(d) >= 4, F.slice(d, 1, 4)),
            "calib_w": j["calib_dimension"]["w"],
            "calib_h": j["calib_dimension"]["h"],
        }
    )


def read_camera_path(spark: SparkSession, path: str) -> DataFrame:
    """(path, frame, w, x, y, z, fov_scale) of exported camera paths: a JSON array of stab_quat, fov_scale
    a file, frames numbered by their place in it.  A file that isn't such an array gives no rows."""
    item = "array<struct<stab_quat: array<double>, fov_scale: double>>"
    text = spark.read.option("wholetext", True).text(path).select(F.input_file_name().alias("path"), F.from_json("value", item).alias("items"))
    rows = text.select("path", F.posexplode("items").alias("frame", "f"))
    return rows.select("path", F.col("frame").cast("long").alias("frame"), *[F.get("f.stab_quat", F.lit(k)).alias(c) for k, c in enumerate("wxyz")], "f.fov_scale")
