"""Readers: label files, page states, manifests, inventories, assets."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.functions.geometry import polygon_area
from foliospark.functions.score import finite

_BOXES = "ARRAY<STRUCT<transcription: STRING, points: ARRAY<ARRAY<DOUBLE>>, difficult: BOOLEAN>>"


def label_file(spark: SparkSession, path: str) -> DataFrame:
    """(image_key, box_index, transcription, points, difficult, problem) of lines ``image TAB JSON boxes``.

    problem names what is wrong with a box or line (tabs, json, points, area), else null; a line that can't be parsed
    gives one row. Blank lines are skipped.
    """
    lines = spark.read.text(path).where("trim(value) <> ''")
    parts = F.split("value", "\t")
    rows = lines.select(parts[0].alias("image_key"), F.size(parts).alias("n"), F.from_json(F.get(parts, F.lit(1)), _BOXES).alias("boxes"))
    boxes = rows.select("image_key", "n", "boxes", F.posexplode_outer("boxes").alias("box_index", "b"))
    points = F.transform("b.points", lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))
    out = boxes.select("image_key", "n", "boxes", "box_index", "b.transcription", points.alias("points"), "b.difficult")
    four = (F.size("points") == 4) & F.forall("points", lambda p: finite(p["x"]) & finite(p["y"]))
    problem = (
        F.when(F.col("n") != 2, "tabs")
        .when(F.col("boxes").isNull(), "json")
        .when(F.col("box_index").isNull(), None)
        .when(~F.coalesce(four, F.lit(False)), "points")
        .when(polygon_area(F.col("points")) <= 0, "area")
    )
    return out.withColumn("problem", problem).drop("n", "boxes")


def page_states(spark: SparkSession, path: str) -> DataFrame:
    """(image_key, confirmed) of lines ``image TAB 1``; any other state is not confirmed."""
    parts = F.split("value", "\t")
    return spark.read.text(path).where("trim(value) <> ''").select(parts[0].alias("image_key"), (F.get(parts, F.lit(1)) == "1").alias("confirmed"))


def _no_repeats(pairs: list[tuple[str, object]]) -> dict:
    out = dict(pairs)
    if len(out) != len(pairs):
        raise ValueError("a JSON object names a key twice")
    return out


def manifest(path: str, groups: list[str]) -> dict[str, list[dict]]:
    """Record groups of one manifest file, on the driver: keys named twice, a root that is no object and NaN are errors."""
    data = json.loads(
        Path(path).read_text(encoding="utf-8"),
        object_pairs_hook=_no_repeats,
        parse_constant=lambda x: (_ for _ in ()).throw(ValueError(f"{x} is no number")),
    )
    if not isinstance(data, dict):
        raise ValueError("the manifest is no object")
    return {g: list(data.get(g, [])) for g in groups}


def manifest_tables(spark: SparkSession, path: str, schemas: dict[str, str]) -> dict[str, DataFrame]:
    """A table for each record group of manifest files (one, a folder or a pattern), read by Spark with fixed schemas."""
    schema = ", ".join(f"{g} ARRAY<STRUCT<{s}>>" for g, s in schemas.items())
    df = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)
    return {g: df.select(F.explode(g).alias("r")).select("r.*") for g in schemas}


def png_assets(spark: SparkSession, folder: str) -> DataFrame:
    """(path, byte_size, sha256, is_png, width, height) of binary files, from their bytes without decoding."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    head = F.hex(F.substring("content", 1, 24))
    png = F.startswith(head, F.lit("89504E470D0A1A0A"))
    return df.select(
        "path",
        F.col("length").alias("byte_size"),
        F.sha2("content", 256).alias("sha256"),
        png.alias("is_png"),
        F.when(png, F.conv(F.substring(head, 33, 8), 16, 10).cast("int")).alias("width"),
        F.when(png, F.conv(F.substring(head, 41, 8), 16, 10).cast("int")).alias("height"),
    )


def asset_problems(assets: DataFrame, files: DataFrame, most_bytes: int = 20 * 1024 * 1024) -> DataFrame:
    """(asset_id, problem) of manifest assets against files: missing, size, type, dimensions or hash. ``assets``: asset_id,
    relative_path, sha256, width, height; ``files``: as png_assets, with relative_path."""
    f = files.select("relative_path", F.col("byte_size"), "is_png", *[F.col(c).alias(f"f_{c}") for c in ("sha256", "width", "height")])
    problem = (
        F.when(F.col("byte_size").isNull(), "missing")
        .when(F.col("byte_size") > most_bytes, "size")
        .when(~F.col("is_png"), "type")
        .when((F.col("width") != F.col("f_width")) | (F.col("height") != F.col("f_height")), "dimensions")
        .when(F.lower("sha256") != F.col("f_sha256"), "hash")
    )
    return assets.join(f, "relative_path", "left").select("asset_id", problem.alias("problem")).where("problem is not null")


def pending(done: DataFrame, work: DataFrame, keys: list[str]) -> DataFrame:
    """Work that has not been done yet by the same keys (page and model, say): what a resumed run still has to do."""
    return work.join(done.select(*keys).distinct(), keys, "left_anti")
