"""Drafts and the evidence they cite: rules of drafts, binding of supports, attachments of figures, watermarks, layers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.functions.geometry import contains_box
from foliospark.operators.skew import join_by_size
from foliospark.operators.spatial import located
from foliospark.session import bounded_broadcast, checkpoint

# The kinds of support; one of the scan has no quote, the others need one.
SCAN_KIND = "scan_region"
TEXT_KINDS = ("ai_visual_description", "ai_visual_transcription", "raw_ocr")
SLOTS = ("power_source", "motion", "transmission", "action", "object", "purpose")


def flat_supports(drafts: DataFrame, owner: str, functions: str = "functions") -> DataFrame:
    """(owner, no, slot, concept, support): the supports of each function, functions without any included (support null).
    Null functions, and null arrays of them, give no rows."""
    rows = drafts.select(owner, F.posexplode(functions).alias("no", "f")).where("f is not null")
    return rows.select(owner, "no", "f.slot", "f.concept", F.explode_outer("f.supports").alias("support"))


def draft_problems(drafts: DataFrame, owner: str, functions: str = "functions", unresolved: str | None = "unresolved") -> DataFrame:
    """(owner, problem) of drafts that break a rule: a slot that is unknown to the vocabulary or is used twice, a known
    concept without support, an unknown one with, a scan that is quoted, a text that is not, nothing left unresolved."""
    flat = flat_supports(drafts, owner, functions)
    quote, kind = F.col("support.quote"), F.col("support.kind")
    none = F.col("support").isNull()
    each = F.array(
        F.when(~F.coalesce(F.col("slot").isin(*SLOTS), F.lit(False)), "slot"),
        F.when((F.col("concept") != "unknown") & none, "known_without_support"),
        F.when((F.col("concept") == "unknown") & ~none, "unknown_with_support"),
        F.when((kind == SCAN_KIND) & quote.isNotNull(), "scan_with_quote"),
        F.when(~none & ((kind != SCAN_KIND) & (F.trim(F.coalesce(quote, F.lit(""))) == "")), "text_without_quote"),
    )
    rows = flat.select(owner, F.explode(F.array_compact(each)).alias("problem"))
    # A row may be sent twice: slots are counted within a row.
    twice = drafts.where(F.size(F.array_distinct(F.transform(functions, lambda f: f["slot"]))) < F.size(functions)).select(owner, F.lit("slot_twice").alias("problem"))
    out = rows.unionByName(twice)
    if unresolved:
        out = out.unionByName(drafts.where(F.coalesce(F.size(unresolved), F.lit(0)) <= 0).select(owner, F.lit("nothing_unresolved").alias("problem")))
    return out.distinct()


def query_problems(queries: DataFrame) -> DataFrame:
    """(query_id, problem) of fixed queries: text queries have a text alone; pictures a source, and a box if it is a region;
    ids are unique. ``queries``: query_id, kind, text, source_id, bbox."""
    text, kind = F.trim(F.coalesce("text", F.lit(""))) != "", F.col("kind")
    source, box = F.col("source_id").isNotNull(), F.col("bbox").isNotNull()
    each = F.array(
        F.when(~F.coalesce(kind.isin("text", "image", "region"), F.lit(False)), "kind"),
        F.when((kind == "text") & (~text | source | box), "text_alone"),
        F.when((kind != "text") & (text | ~source), "source_alone"),
        F.when((kind != "text") & ((kind == "region") != box), "box_of_region"),
    )
    rows = queries.select("query_id", F.explode(F.array_compact(each)).alias("problem"))
    twice = queries.groupBy("query_id").agg(F.count("*").alias("n")).where("n > 1").select("query_id", F.lit("id_twice").alias("problem"))
    return rows.unionByName(twice).distinct()


def bound_supports(supports: DataFrame, targets: DataFrame) -> DataFrame:
    """``supports`` (support_id, owner, kind, reference_id, quote) with ``binding``: missing (no target of that kind and id),
    foreign (all of them belong to another owner), absent (the quote stands in none of the owner's, word for word), bound;
    and the number of targets and those that bind.

    ``targets``: kind, reference_id, owner, content (null where nothing is quoted); an id may have several rows, as the runs
    of a box have. Supports without an id are missing. Targets are those asked for only; an id cited by a third of all
    supports is split.
    """
    keys = ["kind", "reference_id"]
    asked = checkpoint(supports.where("reference_id <> ''").groupBy(*keys).agg(F.count("*").alias("n")))
    wanted = targets.join(bounded_broadcast(asked.select(*keys)), keys, "left_semi").select(*keys, F.col("owner").alias("target_owner"), "content").distinct()
    held = wanted.groupBy(*keys).agg(F.collect_list(F.struct("target_owner", "content")).alias("held"))
    sized = checkpoint(held.join(asked, keys))
    joined = join_by_size(supports.where("reference_id <> ''"), sized, keys)
    mine = F.filter("held", lambda t: t["target_owner"] == F.col("owner"))
    quoted = F.filter(mine, lambda t: F.col("quote").isNull() | F.coalesce(F.contains(t["content"], F.col("quote")), F.lit(False)))
    judged = joined.select(
        *supports.columns,
        F.when(F.size(quoted) > 0, "bound").when(F.size(mine) > 0, "absent").otherwise("foreign").alias("binding"),
        F.size("held").alias("n_targets"),
        F.size(quoted).alias("n_binding"),
    )
    lost = supports.join(bounded_broadcast(sized.select(*keys)), keys, "left_anti")
    return judged.unionByName(lost.select("*", F.lit("missing").alias("binding"), F.lit(0).alias("n_targets"), F.lit(0).alias("n_binding")))


def attachment_problems(plans: DataFrame, items: DataFrame, expected: DataFrame | None = None) -> DataFrame:
    """(figure_id, item_id, problem) of evidence attached to figures: unknown items, titles and labels of another page, items
    attached twice, supports that are not attached, quotes that the item's texts do not hold; figures linked twice or, of
    ``expected`` (figure_id), not at all.

    ``plans``: figure_id, page_id, title_id, label_ids, context_ids (flat), supports ARRAY<STRUCT<item_id, quote>>; ``items``:
    item_id, page_id, text (an item may have several texts).
    """
    flat = plans.select(
        "figure_id", "page_id",
        F.explode(
            F.concat(
                F.array(F.struct(F.lit("title").alias("part"), F.col("title_id").alias("item_id"))),
                F.transform(F.coalesce("label_ids", F.array().cast("array<string>")), lambda x: F.struct(F.lit("label").alias("part"), x.alias("item_id"))),
                F.transform(F.coalesce("context_ids", F.array().cast("array<string>")), lambda x: F.struct(F.lit("context").alias("part"), x.alias("item_id"))),
            )
        ).alias("a"),
    ).select("figure_id", "page_id", "a.*").where("item_id <> ''")
    attached = checkpoint(flat)
    cited = plans.select("figure_id", F.explode("supports").alias("s")).select("figure_id", "s.item_id", "s.quote").where("item_id <> ''")
    cited = checkpoint(cited)
    asked = attached.select("item_id").unionByName(cited.select("item_id")).groupBy("item_id").agg(F.count("*").alias("n"))
    of = items.groupBy("item_id").agg(F.collect_set("page_id").alias("pages"), F.collect_set("text").alias("texts"))
    known = checkpoint(of.join(asked, "item_id"))
    placed = join_by_size(attached, known.select("item_id", "pages", "n"), ["item_id"])
    elsewhere = placed.where((F.col("part") != "context") & ~F.array_contains("pages", F.col("page_id"))).select("figure_id", "item_id", F.lit("other_page").alias("problem"))
    unknown = attached.join(bounded_broadcast(known.select("item_id")), "item_id", "left_anti").select("figure_id", "item_id", F.lit("unknown").alias("problem"))
    twice = attached.groupBy("figure_id", "item_id").agg(F.count("*").alias("n")).where("n > 1").select("figure_id", "item_id", F.lit("attached_twice").alias("problem"))
    loose = cited.join(attached.select("figure_id", "item_id").distinct(), ["figure_id", "item_id"], "left_anti").select("figure_id", "item_id", F.lit("not_attached").alias("problem"))
    said = join_by_size(cited, known.select("item_id", "texts", "n"), ["item_id"])
    absent = said.where(~F.exists("texts", lambda t: F.contains(t, F.col("quote")))).select("figure_id", "item_id", F.lit("quote_absent").alias("problem"))
    linked = plans.groupBy("figure_id").agg(F.count("*").alias("n")).where("n > 1").select("figure_id", F.lit(None).cast("string").alias("item_id"), F.lit("linked_twice").alias("problem"))
    out = unknown.unionByName(elsewhere).unionByName(twice).unionByName(loose).unionByName(absent).unionByName(linked)
    if expected is not None:
        lacking = expected.select("figure_id").distinct().join(plans.select("figure_id").distinct(), "figure_id", "left_anti")
        out = out.unionByName(lacking.select("figure_id", F.lit(None).cast("string").alias("item_id"), F.lit("not_linked").alias("problem")))
    return out.distinct()


def first_trace(traces: Column, text_id: Column) -> Column:
    """The first of a figure's traces (ARRAY<STRUCT<text_id, …>>) with a text id; null if there is none."""
    return F.get(F.filter(traces, lambda t: t["text_id"] == text_id), F.lit(0))


def located_by_trace(pointer: Column, crop: Column, page_id: Column, traces: Column) -> Column:
    """spatial.located of a pointer, or of the trace that it names: a pointer that is no JSON object is the id of one."""
    trace = F.to_json(first_trace(traces, pointer))
    is_object = F.startswith(F.ltrim(pointer), F.lit("{")) & F.try_parse_json(pointer).isNotNull()
    return located(F.when(is_object, pointer).otherwise(trace), crop, page_id)


def scoped_context(crops: DataFrame, texts: DataFrame, functions: DataFrame, relations: DataFrame) -> DataFrame:
    """(query_id, texts, n_texts, n_functions, n_relations): what of a figure lies within a query's crop. ``crops``: query_id,
    figure_id, crop, figure_box; ``texts``: figure_id, place, text, bbox; ``functions``: figure_id, no, concept, boxes (of its
    supports); ``relations``: figure_id. Functions need a support, and all of them inside; relations have no place, so that
    only a crop of the whole figure has them. Texts are joined in their order."""
    inside = texts.join(crops, "figure_id").where(contains_box(F.col("crop"), F.col("bbox")) & (F.trim("text") != ""))
    said = inside.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("place", "text"))).alias("t"))
    known = functions.where("concept <> 'unknown'").join(crops, "figure_id")
    known = known.where((F.size("boxes") > 0) & F.forall("boxes", lambda b: contains_box(F.col("crop"), b)))
    n_known = known.groupBy("query_id").agg(F.count("*").alias("n_functions"))
    edges = relations.join(crops.where(contains_box(F.col("crop"), F.col("figure_box"))), "figure_id").groupBy("query_id").agg(F.count("*").alias("n_relations"))
    return (
        crops.select("query_id").distinct()
        .join(said, "query_id", "left").join(n_known, "query_id", "left").join(edges, "query_id", "left")
        .select(
            "query_id",
            F.coalesce(F.array_join(F.transform("t", lambda x: x["text"]), " "), F.lit("")).alias("texts"),
            F.coalesce(F.size("t"), F.lit(0)).alias("n_texts"),
            F.coalesce("n_functions", F.lit(0)).alias("n_functions"),
            F.coalesce("n_relations", F.lit(0)).alias("n_relations"),
        )
        .withColumn("n_texts", F.greatest("n_texts", F.lit(0)))
    )


# Texts of a digitisation's mark, and the corner of a page in which they may be removed.
WATERMARKS = ("国立公文書館", "National Archives of Japan")
CORNER_X, CORNER_Y = 0.85, 0.9


def watermarks(boxes: DataFrame, texts: tuple[str, ...] = WATERMARKS) -> DataFrame:
    """``boxes`` whose text is a mark's, with ``corner``: whether they lie in the corner in which it is removed. ``boxes``:
    page_id, text, x_min, y_min, x_max, y_max, page_width, page_height."""
    corner = (
        (F.col("x_min") >= F.col("page_width") * CORNER_X) & (F.col("y_min") >= F.col("page_height") * CORNER_Y)
        & (F.col("x_max") <= F.col("page_width")) & (F.col("y_max") <= F.col("page_height"))
    )
    return boxes.where(F.col("text").isin(*texts)).withColumn("corner", F.coalesce(corner, F.lit(False)))


def without_watermarks(boxes: DataFrame, texts: tuple[str, ...] = WATERMARKS) -> tuple[DataFrame, DataFrame]:
    """(boxes without those of the mark in its corner; (page_id, problem) of pages that must not be changed: left_over, the
    text stands elsewhere too, or partial, some of the mark's texts are missing)."""
    found = watermarks(boxes, texts)
    pages = found.groupBy("page_id").agg(F.every("corner").alias("all_there"), F.count_distinct(F.when(F.col("corner"), F.col("text"))).alias("n"))
    problem = F.when(~F.col("all_there"), "left_over").when(F.col("n") < len(texts), "partial")
    kept = boxes.join(found.where("corner").select("page_id", "box_id"), ["page_id", "box_id"], "left_anti")
    return kept, pages.select("page_id", problem.alias("problem")).where("problem is not null")


def layered(lines: DataFrame, confirmed: DataFrame) -> DataFrame:
    """(page_id, layer, n_lines, text): the layer that stands for a page, labels before cached lines before labels that
    nobody has confirmed, and its text in order. ``lines``: page_id, layer (label, cache), position, text; ``confirmed``: page_id."""
    done = confirmed.select("page_id").distinct().withColumn("done", F.lit(True))
    name = F.when((F.col("layer") == "label") & F.col("done"), "label").when(F.col("layer") == "cache", "cache").otherwise("unconfirmed_label")
    rank = F.when(F.col("name") == "label", 0).when(F.col("name") == "cache", 1).otherwise(2)
    of = (
        lines.join(done, "page_id", "left").withColumn("name", name)
        .groupBy("page_id", "name")
        .agg(F.array_sort(F.collect_list(F.struct("position", "text"))).alias("t"))
    )
    first = of.groupBy("page_id").agg(F.min_by(F.struct("name", "t"), rank).alias("r"))
    return first.select("page_id", F.col("r.name").alias("layer"), F.size("r.t").alias("n_lines"), F.array_join(F.transform("r.t", lambda x: F.coalesce(x["text"], F.lit(""))), "\n").alias("text"))


def asset_refs(assets: DataFrame, prefix: str = "/assets/") -> DataFrame:
    """``assets`` (asset_id, license_status, allow_redistribution) with ref: STRUCT<asset_id, url, license_status,
    allow_redistribution>, null without an id; the url is null where the file may not be passed on."""
    url = F.when(F.coalesce("allow_redistribution", F.lit(False)), F.concat(F.lit(prefix), "asset_id"))
    return assets.withColumn("ref", F.when(F.col("asset_id").isNotNull(), F.struct("asset_id", url.alias("url"), "license_status", F.coalesce("allow_redistribution", F.lit(False)).alias("allow_redistribution"))))


def evidence_rows(evidence: DataFrame) -> DataFrame:
    """(figure_id, status, claim_id, supports, text): evidence in the form in which claims are matched; its pointer is claim
    and support alike. ``evidence``: figure_id, state, pointer, excerpt."""
    return evidence.select(
        "figure_id", F.col("state").alias("status"), F.col("pointer").alias("claim_id"),
        F.when(F.col("pointer").isNotNull(), F.array("pointer")).otherwise(F.array().cast("array<string>")).alias("supports"), F.col("excerpt").alias("text"),
    )


def provenance(rows: DataFrame, source: list[str], overrides: list[str]) -> Column:
    """MAP<STRING, STRING> of a row's source fields with its own fields (not null) on top."""
    base = F.map_from_arrays(F.array(*map(F.lit, source)), F.array(*[F.col(c).cast("string") for c in source]))
    own = F.map_filter(F.map_from_arrays(F.array(*map(F.lit, overrides)), F.array(*[F.col(f"own_{c}").cast("string") for c in overrides])), lambda _, v: v.isNotNull())
    return F.map_concat(F.map_filter(base, lambda k, v: v.isNotNull() & ~F.map_contains_key(own, k)), own)


def scope_statistics(pages: DataFrame, boxes: DataFrame, figures: DataFrame, by: str) -> DataFrame:
    """(by, n_pages, retained_boxes, supplements, figures, missing_captions). ``boxes``: by, supplement BOOLEAN; ``figures``:
    by, captioned BOOLEAN. Each is aggregated before it is joined; what a group lacks counts 0."""
    return (
        pages.groupBy(by).agg(F.count("*").alias("n_pages"))
        .join(boxes.groupBy(by).agg(F.count_if(~F.col("supplement")).alias("retained_boxes"), F.count_if("supplement").alias("supplements")), by, "left")
        .join(figures.groupBy(by).agg(F.count("*").alias("figures"), F.count_if(~F.col("captioned")).alias("missing_captions")), by, "left")
        .fillna(0, ["retained_boxes", "supplements", "figures", "missing_captions"])
    )
