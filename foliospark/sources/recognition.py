"""Output of text recognisers, brought to one table of lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_BLOCK = "rec_texts: ARRAY<STRING>, rec_scores: ARRAY<DOUBLE>, rec_boxes: ARRAY<STRING>"
_OBJECT = f"STRUCT<res: STRUCT<{_BLOCK}>, {_BLOCK}>"


def _corners(points: Column) -> Column:
    """ARRAY (left, top, right, bottom) of four numbers or of a polygon, as JSON; zeros for anything else."""
    flat = F.from_json(points, "ARRAY<DOUBLE>")
    poly = F.filter(F.from_json(points, "ARRAY<ARRAY<DOUBLE>>"), lambda p: (F.size(p) >= 2) & p[0].isNotNull() & p[1].isNotNull())
    xs, ys = F.transform(poly, lambda p: p[0]), F.transform(poly, lambda p: p[1])
    return (
        F.when(F.size(poly) >= 4, F.array(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)))
        .when((F.size(flat) == 4) & F.forall(flat, lambda x: x.isNotNull()), flat)
        .otherwise(F.array(*[F.lit(0.0)] * 4))
    )


def recognised_lines(results: DataFrame, payload: str = "payload") -> DataFrame:
    """The other columns, and reading_order, text, bbox and confidence of each line of a recogniser's JSON.

    Two layouts are read: an object of parallel arrays (rec_texts, rec_scores, rec_boxes, below ``res`` or not), and a list of
    [points, [text, score]]. Blank lines are dropped, orders keep their gaps; confidence is clipped to [0, 1] and 0 where
    it is missing. Null, broken and empty JSON gives no lines.
    """
    keep = [c for c in results.columns if c != payload]
    p = F.col(payload)
    o = F.from_json(p, _OBJECT)
    block = F.coalesce(o["res"], F.struct(o["rec_texts"].alias("rec_texts"), o["rec_scores"].alias("rec_scores"), o["rec_boxes"].alias("rec_boxes")))

    def of_arrays(t: Column, i: Column) -> Column:
        return F.struct(t.alias("text"), F.get(block["rec_scores"], i).alias("score"), F.get(block["rec_boxes"], i).alias("points"))

    def of_rows(r: Column) -> Column:
        said = F.from_json(F.get(r, F.lit(1)), "ARRAY<STRING>")
        return F.struct(F.get(said, F.lit(0)).alias("text"), F.get(said, F.lit(1)).try_cast("double").alias("score"), F.get(r, F.lit(0)).alias("points"))

    is_list = F.startswith(F.ltrim(p), F.lit("["))
    rows = F.when(is_list, F.transform(F.from_json(p, "ARRAY<ARRAY<STRING>>"), of_rows)).otherwise(F.transform(block["rec_texts"], of_arrays))
    score = F.coalesce(F.col("l.score"), F.lit(0.0))
    return (
        results.select(*keep, F.posexplode(rows).alias("reading_order", "l"))
        .where("trim(l.text) <> ''")
        .select(*keep, "reading_order", "l.text", _corners(F.col("l.points")).alias("bbox"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)).alias("confidence"))
    )
