"""Review of recognised boxes: candidates that agree, reasons to look again, corrections put on top."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.functions.text import cjk_only, has_known_noise, sequence_ratio

#: Similarity from which three readings agree, and from which two do.
ALL_AGREE, PAIR_AGREES = 0.9, 0.82


def consensus(raw: Column, server: Column, reference: Column, ratio=sequence_ratio, role: Column | None = None, controlled: Column | None = None) -> Column:
    """STRUCT<text, basis>: the controlled title of a heading or figure title; else what two readings with the same CJK
    characters say, the reference before others; else the reference if all three are alike; else none. Readings without
    CJK characters don't count."""
    values = {"raw": raw, "server": server, "reference": reference}
    keys = {k: cjk_only(F.coalesce(v, F.lit(""))) for k, v in values.items()}

    def same(a: str, b: str) -> Column:
        return (keys[a] != "") & (keys[a] == keys[b])

    def pick(text: Column, basis: str) -> Column:
        return F.struct(text.cast("string").alias("text"), F.lit(basis).alias("basis"))

    alike = F.least(ratio(keys["raw"], keys["server"]), ratio(keys["raw"], keys["reference"]), ratio(keys["server"], keys["reference"]))
    every = (keys["raw"] != "") & (keys["server"] != "") & (keys["reference"] != "")
    is_title = F.lit(False) if role is None else F.coalesce(role.isin("section_heading", "figure_title") & (controlled != ""), F.lit(False))
    return (
        F.when(is_title, pick(F.lit(None) if controlled is None else controlled, "controlled_title_candidate"))
        .when(same("raw", "server") & same("raw", "reference"), pick(reference, "exact_pair:raw+reference+server"))
        .when(same("raw", "server"), pick(raw, "exact_pair:raw+server"))
        .when(same("raw", "reference"), pick(reference, "exact_pair:raw+reference"))
        .when(same("server", "reference"), pick(reference, "exact_pair:reference+server"))
        .when(every & (alike >= ALL_AGREE), pick(reference, "three_way_high_similarity"))
        .otherwise(pick(F.lit(None), "no_consensus"))
    )


def agreement(values: Column, ratio_of_pairs: Column) -> Column:
    """Best similarity of a reading to the others: 1 if there is no other."""
    return F.when(F.size(values) <= 1, 1.0).otherwise(F.coalesce(F.array_max(ratio_of_pairs), F.lit(0.0)))


# Confidences below which a box's role, its second reading and its place in the reference are doubtful.
ROLE_SURE, SERVER_SURE, PLACE_SURE = 0.8, 0.6, 0.5


def best_of_pairs(readings: list[Column], ratio=sequence_ratio) -> tuple[Column, Column]:
    """(how many readings have ideographs, the greatest similarity of two of them; 0 if there are no two)."""
    keys = [cjk_only(F.coalesce(r, F.lit(""))) for r in readings]
    n = sum((F.when(k != "", 1).otherwise(0) for k in keys), F.lit(0))
    scores = [F.when((a != "") & (b != ""), ratio(a, b)).otherwise(0.0) for i, a in enumerate(keys) for b in keys[i + 1 :]]
    return n, F.greatest(*scores)


def review_reasons(category: Column, role: Column, role_confidence: Column, server_confidence: Column, place_confidence: Column, n_readings: Column, best_pair: Column) -> Column:
    """Reasons to look at a box again, in a fixed order. ``server_confidence`` and ``place_confidence`` are null where there
    is no second reading, or no reference; a null role_confidence counts as 0."""
    read = F.coalesce(category.isin("text", "caption"), F.lit(False))
    reasons = F.array(
        F.when(category == "caption", "figure_title_or_component_label"),
        F.when(role == "section_heading", "section_heading"),
        F.when(role == "recognition_fragment", "recognition_fragment"),
        F.when(F.coalesce(role_confidence, F.lit(0.0)) < ROLE_SURE, "low_category_confidence"),
        F.when(read & (server_confidence < SERVER_SURE), "low_server_confidence"),
        F.when(place_confidence < PLACE_SURE, "low_reference_alignment"),
        F.when((n_readings >= 3) & (best_pair < ALL_AGREE), "three_way_text_conflict"),
        F.when((n_readings == 2) & (best_pair < PAIR_AGREES), "no_high_agreement_pair"),
        F.when(read & (n_readings < 2), "missing_secondary_candidate"),
    )
    return F.filter(reasons, lambda r: r.isNotNull())


# Reasons that make a box critical.
CRITICAL = ("three_way_text_conflict", "low_server_confidence", "low_reference_alignment", "section_heading", "missing_caption_box")


def priority(reasons: Column) -> Column:
    """critical, review, or deferred for a box without reasons."""
    return (
        F.when(F.arrays_overlap(reasons, F.array(*map(F.lit, CRITICAL))), "critical").when(F.size(reasons) > 0, "review").otherwise("deferred")
    )


#: Where items without a place of their own stand in a page's queue.
LAST_PLACE = 10_000


def review_queue(boxes: DataFrame, figures: DataFrame) -> DataFrame:
    """(page_id, item_id, kind, reasons, priority, place): boxes, figures and captions that are missing, each page's in
    order. ``boxes``: page_id, item_id, reading_order, reasons; ``figures``: page_id, item_id, captioned."""
    order = F.lit(None).cast("int").alias("reading_order")

    def items(df: DataFrame, kind: str, suffix: str, reason: str) -> DataFrame:
        return df.select("page_id", F.concat("item_id", F.lit(suffix)).alias("item_id"), F.lit(kind).alias("kind"), order, F.array(F.lit(reason)).alias("reasons"))

    rows = (
        boxes.select("page_id", "item_id", F.lit("box").alias("kind"), F.col("reading_order").cast("int"), "reasons")
        .unionByName(items(figures, "figure", "", "technical_figure_region"))
        .unionByName(items(figures.where("not captioned"), "caption", "-title", "missing_caption_box"))
    )
    w = Window.partitionBy("page_id").orderBy(F.coalesce("reading_order", F.lit(LAST_PLACE)), "item_id")
    return rows.select("page_id", "item_id", "kind", "reasons", priority(F.col("reasons")).alias("priority"), F.row_number().over(w).alias("place"))


def review_candidates(boxes: DataFrame, ratio=sequence_ratio) -> DataFrame:
    """``boxes`` with candidate_texts, agreement, consensus and needs_review: what a reviewer sees of a box. ``boxes``:
    raw_text, server_text, server_confidence, reference_text, category, role, role_confidence, candidate.

    needs_review: a doubtful role (below 0.95), a reading that differs from the raw one, or a second reading below 0.9.
    """
    raw = F.coalesce("raw_text", F.lit(""))
    others = F.array_distinct(F.filter(F.array("server_text", "reference_text", "candidate"), lambda x: x.isNotNull() & (x != "") & (x != raw)))
    every = F.concat(F.array(raw), others)
    key = cjk_only(raw)
    scores = [F.when(cjk_only(F.col(c)) != "", ratio(key, cjk_only(F.col(c)))) for c in ("server_text", "reference_text", "candidate")]
    differs = [F.when(F.col(c) != raw, s) for c, s in zip(("server_text", "reference_text", "candidate"), scores, strict=True)]
    best = F.array_max(F.array(*differs))
    doubtful = (F.coalesce("role_confidence", F.lit(0.0)) < 0.95) | (F.size(others) > 0) | F.coalesce(F.col("server_confidence") < 0.9, F.lit(False))
    return boxes.withColumns(
        {
            "candidate_texts": every,
            "agreement": F.when(F.size(others) == 0, 1.0).otherwise(F.coalesce(best, F.lit(0.0))),
            "consensus": consensus(F.col("raw_text"), F.col("server_text"), F.col("reference_text"), ratio, F.col("role"), F.col("candidate")),
            "needs_review": doubtful,
        }
    )


def override_problems(base: DataFrame, overrides: DataFrame, key: str, same: list[str], digest: str | None = None, longest: int = 2000) -> DataFrame:
    """(key, problem) of overrides that must not be applied: unknown, duplicate, mismatch (of the columns ``same``), stale
    (``digest``, a column of both sides), damaged (a corrected_text that is blank, too long or has replacement characters).
    If there are any, none is to be applied."""
    given = overrides.groupBy(key).agg(F.count("*").alias("times"))
    there = base.select(key, *[F.col(c).alias(f"base_{c}") for c in [*same, *([digest] if digest else [])]], F.lit(True).alias("there"))
    rows = overrides.join(given, key, "left").join(there, key, "left")
    known, text = F.coalesce("there", F.lit(False)), F.col("corrected_text") if "corrected_text" in overrides.columns else F.lit(None).cast("string")
    differs = [~F.col(c).eqNullSafe(F.col(f"base_{c}")) for c in same]
    problems = F.array(
        F.when(~known, "unknown"),
        F.when(F.coalesce("times", F.lit(2)) > 1, "duplicate"),
        *([F.when(known & F.array_contains(F.array(*differs), True), "mismatch")] if same else []),
        *([F.when(known & ~F.col(digest).eqNullSafe(F.col(f"base_{digest}")), "stale")] if digest else []),
        F.when((F.trim(text) == "") | (F.length(text) > longest) | F.contains(text, F.lit("\ufffd")), "damaged"),
    )
    return rows.select(key, F.explode(F.array_compact(problems)).alias("problem")).distinct()


def with_overrides(base: DataFrame, overrides: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``base`` with the values that overrides give (null: unchanged), and ``changed``: the names of columns whose value
    differs. Each key once on either side; overrides of unknown keys are left out."""
    o = overrides.select(key, *[F.col(c).alias(f"new_{c}") for c in columns])
    out = base.join(o, key, "left")
    differs = [F.when(F.col(f"new_{c}").isNotNull() & ~F.col(f"new_{c}").eqNullSafe(F.col(c)), F.lit(c)) for c in columns]
    out = out.withColumn("changed", F.array_compact(F.array(*differs)))
    return out.withColumns({c: F.coalesce(f"new_{c}", c) for c in columns}).drop(*[f"new_{c}" for c in columns])


def label_audit(labels: DataFrame, cache: DataFrame, page: str = "page_id") -> DataFrame:
    """Per page: boxes that kept geometry and text, whose text changed, that are new, and how many fewer there are than in
    the cache; whether kept boxes changed their order; boxes with replacement characters and with known noise. Both sides:
    page, points (comparable), text, position; a cached box serves by geometry, the first of equals."""
    first = cache.groupBy(page, "points").agg(F.min_by("text", "position").alias("old"), F.min("position").alias("old_position"))
    joined = labels.join(first.withColumn("there", F.lit(True)), [page, "points"], "left")
    there = F.coalesce("there", F.lit(False))
    # A kept box that stands before the one kept ahead of it.
    before = F.last("old_position", ignorenulls=True).over(Window.partitionBy(page).orderBy("position").rowsBetween(Window.unboundedPreceding, -1))
    per_page = joined.withColumn("back", F.col("old_position") < before).groupBy(page).agg(
        F.count("*").alias("n_labels"),
        F.count_if(there & F.col("text").eqNullSafe(F.col("old"))).alias("kept"),
        F.count_if(there & ~F.col("text").eqNullSafe(F.col("old"))).alias("text_changed"),
        F.count_if(~there).alias("new"),
        F.count_if("back").alias("n_back"),
        F.count_if(F.contains(F.col("text"), F.lit("\ufffd"))).alias("replacement_characters"),
        F.count_if(has_known_noise(F.col("text")) & ~F.contains(F.col("text"), F.lit("\ufffd"))).alias("noise"),
    )
    old = cache.groupBy(page).agg(F.count("*").alias("n_cached"))
    return per_page.join(old, page, "full").fillna(0).withColumn("net_removed", F.col("n_cached") - F.col("n_labels"))


def audit_totals(audit: DataFrame) -> DataFrame:
    """One row: the sums of label_audit over all pages, pages that changed, and the share of boxes kept as they were."""
    sums = ["n_labels", "n_cached", "kept", "text_changed", "new", "replacement_characters", "noise", "net_removed"]
    changed = (F.col("text_changed") > 0) | (F.col("new") > 0) | (F.col("net_removed") != 0)
    out = audit.agg(F.count("*").alias("n_pages"), F.count_if(changed).alias("n_changed"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sums])
    return out.withColumn("kept_share", F.try_divide("kept", "n_labels"))
