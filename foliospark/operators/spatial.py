"""What of a figure lies within a crop: located texts, assertions and relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.functions.geometry import bbox_valid, contains_box
from foliospark.functions.score import finite

_BOX = "STRUCT<x: DOUBLE, y: DOUBLE, width: DOUBLE, height: DOUBLE>"
_POINTER = f"STRUCT<page_id: STRING, bbox: {_BOX}, supports: ARRAY<STRUCT<page_id: STRING, bbox: {_BOX}>>>"


def located(pointer: Column, crop: Column, page_id: Column) -> Column:
    """Whether a JSON pointer lies in a crop of a page: all of its supports, or its one box. False for text that is no
    JSON object, for another page, and for a pointer without boxes."""
    p = F.from_json(pointer, _POINTER)
    same_page = p["page_id"].isNull() | (p["page_id"] == page_id)
    inside = F.when(
        p["supports"].isNotNull(),
        (F.size(p["supports"]) > 0)
        & F.forall(p["supports"], lambda s: (s["page_id"].isNull() | (s["page_id"] == page_id)) & contains_box(crop, s["bbox"])),
    ).otherwise(contains_box(crop, p["bbox"]))
    return F.coalesce(same_page & inside, F.lit(False))


def within(df: DataFrame, crop: str = "crop", box: str = "bbox") -> DataFrame:
    """Rows whose box lies in the crop; rows with an invalid box or crop are left out."""
    return df.where(contains_box(F.col(crop), F.col(box)))


def regions_in_crop(regions: DataFrame, crops: DataFrame) -> DataFrame:
    """(query_id, region_id): regions of a query's figure that lie within its crop. ``crops``: query_id, figure_id, crop."""
    return within(regions.join(crops, "figure_id")).select("query_id", "region_id")


def whole_figure(crop: Column, figure: Column) -> Column:
    """Whether a crop holds the whole figure, so that its relations count as located."""
    return contains_box(crop, figure)


def scoped_functions(functions: DataFrame, boxes: DataFrame, crops: DataFrame | None = None) -> DataFrame:
    """(figure_key, slot, concept, n_supports): known draft functions; with ``crops`` (figure_key, crop) those whose
    supports all lie inside, functions without supports passing. ``boxes``: reference_id, bbox."""
    rows = functions.select("figure_key", F.posexplode("functions").alias("no", "f")).where("f.concept <> 'unknown'")
    flat = rows.select("figure_key", "no", "f.slot", "f.concept", F.explode_outer("f.supports").alias("s"))
    joined = flat.select("figure_key", "no", "slot", "concept", F.col("s.reference_id").alias("reference_id")).join(boxes, "reference_id", "left")
    if crops is None:
        inside = F.lit(True)
    else:
        joined = joined.join(crops, "figure_key")
        inside = F.col("reference_id").isNull() | contains_box(F.col("crop"), F.col("bbox"))
    return (
        joined.groupBy("figure_key", "no", "slot", "concept")
        .agg(F.every(inside).alias("inside"), F.count("reference_id").alias("n_supports"))
        .where("inside")
        .select("figure_key", "slot", "concept", "n_supports")
    )


def box_problems(df: DataFrame, id_: str, box: str = "bbox") -> DataFrame:
    """(id, problem) of invalid boxes: missing, not_finite or outside."""
    b = F.col(box)
    fine = F.lit(True)
    for k in ("x", "y", "width", "height"):
        fine = fine & finite(b[k])
    return (
        df.where(~bbox_valid(b))
        .select(F.col(id_).alias("id"), F.when(b.isNull(), "missing").when(~F.coalesce(fine, F.lit(False)), "not_finite").otherwise("outside").alias("problem"))
        .distinct()
    )
