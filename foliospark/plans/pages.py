"""Queries on pages: boxes, reading order, sections, recognition runs against each other, reviews, streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliospark.functions import geometry as G
from foliospark.functions.text import CJK, NOISE_TERMS, clean_markup, has_known_noise
from foliospark.operators import evidence, layout, metrics, review, spatial
from foliospark.operators.integrity import first_of
from foliospark.plans.lexical import EVERY, FIGURE_NO
from foliospark.session import _shared_folder, table
from foliospark.sources.storage import read_table
from foliospark.streaming import state


def _r(x, n: int = 6):
    return F.round(x, n)


def _lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines once each, with the corners of their boxes."""
    corners = {c: F.col("bbox")[i] for i, c in enumerate(("x_min", "y_min", "x_max", "y_max"))}
    return table(spark, d, "ocr_lines").dropDuplicates(["line_id"]).withColumns(corners)


def _figures(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "domestic_ai_selection").select("figure_id", "page_id", "bbox", "arrived_at")
    return first_of(f.withColumnRenamed("bbox", "figure_box"), ["figure_id"], ["arrived_at"])


def q_bbox_problems(spark: SparkSession, d: str) -> DataFrame:
    """Invalid boxes of figures, and of regions of which some are moved, stretched or taken away."""
    n = F.length("region_id") + F.coalesce(F.length("label"), F.lit(0))
    x, y, w, h = (F.col(f"bbox.{k}") for k in ("x", "y", "width", "height"))
    moved = (
        F.when(n % 5 == 0, F.struct((x + 0.7).alias("x"), y.alias("y"), w.alias("width"), h.alias("height")))
        .when(n % 5 == 1, F.struct(x.alias("x"), F.lit(float("nan")).alias("y"), w.alias("width"), h.alias("height")))
        .when(n % 5 == 2, F.struct(x.alias("x"), y.alias("y"), F.lit(0.0).alias("width"), h.alias("height")))
        .when(n % 5 == 3, F.col("bbox"))
    )
    a = spatial.box_problems(table(spark, d, "regions").withColumn("bbox", moved), "region_id")
    return a.unionByName(spatial.box_problems(table(spark, d, "domestic_ai_selection"), "figure_id"))


def q_contained(spark: SparkSession, d: str) -> DataFrame:
    """Regions within their figure's box, and how far both overlap."""
    r = table(spark, d, "regions").select("region_id", "figure_id", "bbox").distinct().join(_figures(spark, d), "figure_id")
    inside, over = G.contains_box(F.col("figure_box"), F.col("bbox")), G.iou(F.col("figure_box"), F.col("bbox"))
    return r.select("region_id", F.round("bbox.x", 6).alias("x"), inside.alias("inside"), _r(over).alias("iou"))


def q_pixel_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Boxes of lines in parts of their page, and the pixels of figures."""
    pages = first_of(table(spark, d, "page_inventory").select("page_id", "width", "height", "arrived_at"), ["page_id"], ["arrived_at"])
    lines = _lines(spark, d).select("line_id", "page_id", "bbox").join(pages, "page_id")
    b = G.pixel_to_unit(F.col("bbox"), F.col("width"), F.col("height"))
    return lines.select("line_id", *[_r(b[k]).alias(k) for k in ("x", "y", "width", "height")])


def q_crop_pixels(spark: SparkSession, d: str) -> DataFrame:
    pages = first_of(table(spark, d, "page_inventory").select("page_id", "width", "height", "arrived_at"), ["page_id"], ["arrived_at"])
    return _figures(spark, d).join(pages, "page_id").select("figure_id", G.crop_pixels(F.col("figure_box"), F.col("width"), F.col("height")).alias("c")).select("figure_id", "c.*")


def q_located(spark: SparkSession, d: str) -> DataFrame:
    """JSON pointers to regions, tested against the upper half of their page."""
    r = table(spark, d, "regions").select("region_id", "figure_id", "bbox").distinct().join(_figures(spark, d), "figure_id")
    crop = F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(1.0).alias("width"), F.lit(0.5).alias("height"))
    pointer = F.to_json(F.struct("page_id", "bbox"))
    return r.select("region_id", F.round("bbox.y", 6).alias("y"), spatial.located(pointer, crop, F.col("page_id")).alias("located"))


def q_regions_in_crop(spark: SparkSession, d: str) -> DataFrame:
    """Regions of the query figures that lie in the left three quarters of the page."""
    crop = F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(0.75).alias("width"), F.lit(1.0).alias("height"))
    no = F.regexp_extract("figure_id", FIGURE_NO, 1).try_cast("bigint")
    crops = _figures(spark, d).where(no % EVERY == 0).select(F.col("figure_id").alias("query_id"), "figure_id", crop.alias("crop"))
    return spatial.regions_in_crop(table(spark, d, "regions").select("region_id", "figure_id", "bbox").distinct(), crops)


def q_scoped_functions(spark: SparkSession, d: str) -> DataFrame:
    """Known functions of figures whose supports all lie in the left three fifths of the page."""
    f = table(spark, d, "domestic_functions")
    f = first_of(f.select("figure_key", "functions", "arrived_at"), ["figure_key"], ["arrived_at"])
    boxes = first_of(table(spark, d, "regions").select(F.col("region_id").alias("reference_id"), "bbox", "arrived_at"), ["reference_id"], ["arrived_at"]).drop("arrived_at")
    crop = F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(0.6).alias("width"), F.lit(1.0).alias("height"))
    crops = _figures(spark, d).select(F.col("figure_id").alias("figure_key"), crop.alias("crop"))
    return spatial.scoped_functions(f, boxes, crops)


def q_reading_order(spark: SparkSession, d: str) -> DataFrame:
    """Boxes of each run in the order in which an opening is read."""
    pages = first_of(table(spark, d, "page_inventory").select("page_id", F.col("width").alias("page_width"), "arrived_at"), ["page_id"], ["arrived_at"]).drop("arrived_at")
    boxes = _lines(spark, d).select("line_id", "result_id", "page_id", "box_id", "x_min", "x_max", "y_min").join(pages, "page_id")
    return layout.reading_order(boxes, page="result_id").select("line_id", "result_id", "position")


def _boxes(spark: SparkSession, d: str) -> DataFrame:
    """Lines with their page's size and number, and their place on it."""
    pages = first_of(table(spark, d, "page_inventory").select("page_id", F.col("width").alias("page_width"), F.col("height").alias("page_height"), "arrived_at"), ["page_id"], ["arrived_at"]).drop("arrived_at")
    number = F.regexp_extract("page_id", r"-p(\d+)$", 1).try_cast("int")
    return _lines(spark, d).join(pages, "page_id").withColumns({"page_no": number, "box_index": F.col("reading_order")})


def _roles(spark: SparkSession, d: str) -> DataFrame:
    """Roles of lines; known headings and titles are those of a small list, pages 7 and 11 show figures."""
    given = spark.createDataFrame([(2, 0, "乃服第二"), (3, 1, "蠶浴"), (5, 0, "葉料")], "page_no int, box_index int, candidate string")
    return layout.roles(_boxes(spark, d), [7, 11], given, given.select(F.col("page_no") + 6, "box_index", "candidate").toDF("page_no", "box_index", "candidate"), [])


def q_layout_roles(spark: SparkSession, d: str) -> DataFrame:
    """Roles of boxes by known places, their own place, size and letters."""
    return _roles(spark, d).select("line_id", "category", "role", "role_confidence", "candidate")


def q_section_headings(spark: SparkSession, d: str) -> DataFrame:
    """Short lines that resemble the heading of a section."""
    return _lines(spark, d).select("line_id", layout.section_of(F.col("text")).alias("section")).where("section is not null")


def q_section_fill(spark: SparkSession, d: str) -> DataFrame:
    """Lines by the section they stand in, over all pages of a source: the last line that ends by an exclamation or question
    mark, at or before them."""
    anchor = F.when(F.col("text").rlike("[!?]$"), F.col("line_id"))
    lines = _lines(spark, d).withColumn("anchor", anchor)
    return layout.filled_sections(lines, "source_id", ["page_id", "result_id"], "reading_order", "anchor").select("line_id", "section")


def q_order_monotonic(spark: SparkSession, d: str) -> DataFrame:
    """Runs by how often a line ends further left than the one before."""
    return layout.not_monotonic(_lines(spark, d), "result_id", "reading_order", "x_max")


def q_permutation(spark: SparkSession, d: str) -> DataFrame:
    """Runs whose order has gaps or repeats once deleted lines are gone."""
    return layout.not_permutations(_lines(spark, d).where("deleted_at is null"), "result_id", "reading_order", first=0)


def q_inserted(spark: SparkSession, d: str) -> DataFrame:
    """A supplement put behind the third line of each run, and the numbers after that."""
    items = _lines(spark, d).select("result_id", F.col("line_id").cast("string").alias("item_id"), F.col("reading_order").alias("position"))
    added = items.where("position = 2").select("result_id", F.concat(F.lit("s-"), "item_id").alias("item_id"), F.col("item_id").alias("insert_after"), F.lit(0).alias("seq"))
    return layout.inserted(items, added, page="result_id").select("result_id", "item_id", "new_position", "moved")


def _runs(spark: SparkSession, d: str) -> DataFrame:
    """(page_id, result_id, raw_text, run): runs of each page that read something, by arrival."""
    r = table(spark, d, "ocr_results").where("raw_text <> ''").dropDuplicates(["result_id"])
    w = Window.partitionBy("page_id").orderBy("arrived_at", "result_id")
    return r.select("page_id", "source_id", "result_id", "raw_text", F.row_number().over(w).alias("run"))


def q_alignment(spark: SparkSession, d: str) -> DataFrame:
    """Lines of each run aligned with the text of the page's first run."""
    runs = _runs(spark, d)
    reference = runs.where("run = 1").select("page_id", "raw_text")
    sections = runs.drop("raw_text").join(reference, "page_id").select("result_id", F.col("raw_text").alias("reference"))
    lines = _lines(spark, d).join(sections, "result_id").select(F.col("result_id").alias("section"), "line_id", F.col("reading_order").alias("position"), "text", "reference")
    return layout.greedy_alignment(lines)


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    """(page_id, source_id, box_id, position, truth, prediction, run): each later run of a page against the first, box by box."""
    runs = _runs(spark, d).select("result_id", "run")
    lines = _lines(spark, d).join(runs, "result_id")
    a = lines.where("run = 1").select("page_id", "source_id", "box_id", F.col("reading_order").alias("position"), F.col("text").alias("truth"))
    b = lines.where("run > 1").select("page_id", "box_id", "run", F.col("text").alias("prediction"), F.col("confidence").alias("server_confidence"))
    return a.join(b, ["page_id", "box_id"])


def q_error_rates(spark: SparkSession, d: str) -> DataFrame:
    """Character and token error rates of later runs against first ones, per source."""
    e = metrics.error_rates(_pairs(spark, d), ["source_id"])
    return e.select("source_id", "n_pairs", "char_edits", "char_total", "token_edits", "token_total", _r("cer").alias("cer"), _r("ter").alias("ter"))


def q_corpus_error_rate(spark: SparkSession, d: str) -> DataFrame:
    """The same over the whole text of each page and run."""
    pairs = _pairs(spark, d).withColumn("page_run", F.concat_ws("/", "page_id", "run"))
    return metrics.corpus_error_rate(pairs, "page_run", "position").select("page_run", "edits", "total", _r("cer").alias("cer"))


def q_box_recall(spark: SparkSession, d: str) -> DataFrame:
    """Regions of a figure that find a box of their own among boxes found, which are the regions moved by a little, two
    thirds of them, so that some must go without."""
    truth = table(spark, d, "regions").where("deleted_at is null").select(F.col("figure_id").alias("page_id"), F.col("region_id").alias("id"), "bbox").distinct()
    moved = F.struct((F.col("bbox.x") + F.col("bbox.width") / 10).alias("x"), "bbox.y", "bbox.width", "bbox.height")
    found = truth.where(F.pmod(F.xxhash64("id"), F.lit(3)) > 0).select("page_id", "id", moved.alias("bbox"))
    return metrics.box_recall(truth, found)


def _readings(spark: SparkSession, d: str) -> DataFrame:
    """Lines of first runs with their role, the reading of the second run of their box, and their first candidate as a
    reference, placed as surely as the line itself was read."""
    runs = _runs(spark, d).select("result_id", "run").where("run <= 2")
    second = _lines(spark, d).join(runs.where("run = 2"), "result_id")
    second = first_of(second.select("page_id", "box_id", F.col("text").alias("server_text"), F.col("confidence").alias("server_confidence"), "line_id"), ["page_id", "box_id"], ["line_id"]).drop("line_id")
    first = _roles(spark, d).join(runs.where("run = 1").select("result_id"), "result_id")
    reference = F.get("candidates", F.lit(0))
    return first.join(second, ["page_id", "box_id"], "left").select(
        "line_id", "page_id", "box_id", "reading_order", F.col("text").alias("raw_text"), "server_text", "server_confidence", reference.alias("reference_text"),
        F.when(reference.isNotNull(), F.col("confidence")).alias("place_confidence"), "category", "role", "role_confidence", "candidate",
    )


def q_consensus(spark: SparkSession, d: str) -> DataFrame:
    """What a line, its second reading and its reference agree on; headings and titles have theirs."""
    c = review.consensus(F.col("raw_text"), F.col("server_text"), F.col("reference_text"), role=F.col("role"), controlled=F.col("candidate"))
    return _readings(spark, d).select("line_id", c.alias("c")).select("line_id", "c.*")


def q_review_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Lines with all their readings, how far they agree, what they agree on and whether somebody should look."""
    r = review.review_candidates(_readings(spark, d))
    return r.select("line_id", F.array_join("candidate_texts", "|").alias("candidates"), _r("agreement").alias("agreement"), F.col("consensus.basis").alias("basis"), "needs_review")


def _equal(a, b):
    """1 for equal texts, else a half: a similarity that SQL can say, too."""
    return F.when(a == b, 1.0).otherwise(0.5)


def _reasons(spark: SparkSession, d: str) -> DataFrame:
    n, best = review.best_of_pairs([F.col("raw_text"), F.col("server_text"), F.col("reference_text")], _equal)
    reasons = review.review_reasons(*[F.col(c) for c in ("category", "role", "role_confidence", "server_confidence", "place_confidence")], n, best)
    return _readings(spark, d).withColumn("reasons", reasons)


def q_review_reasons(spark: SparkSession, d: str) -> DataFrame:
    """Reasons to look at a line again, by its role, its readings and how sure they are."""
    return _reasons(spark, d).select("line_id", F.array_join("reasons", ",").alias("reasons"), review.priority(F.col("reasons")).alias("priority"))


def q_review_queue(spark: SparkSession, d: str) -> DataFrame:
    """Boxes, figures and captions that are missing, in the order in which they are looked at."""
    f = table(spark, d, "domestic_ai_selection").where("page_id <> ''").select("figure_id", "page_id", "title", "arrived_at")
    figures = first_of(f, ["figure_id"], ["arrived_at", "page_id", "title"]).select("page_id", F.col("figure_id").alias("item_id"), F.col("title").isNotNull().alias("captioned"))
    boxes = _reasons(spark, d).select("page_id", F.concat_ws("#", "box_id", "line_id").alias("item_id"), "reading_order", "reasons")
    return review.review_queue(boxes, figures).withColumn("reasons", F.array_join("reasons", ","))


def q_overrides(spark: SparkSession, d: str) -> DataFrame:
    """Corrections on top of regions: roles of every seventh, labels of those of another list."""
    base = first_of(table(spark, d, "regions").select("region_id", "label", "role", "arrived_at"), ["region_id"], ["arrived_at", "label", "role"]).drop("arrived_at")
    n = F.length("region_id") + F.coalesce(F.length("label"), F.lit(0))
    o = base.where(n % 3 == 0).select("region_id", F.lower("label").alias("label"), F.when(n % 2 == 0, "tool").alias("role"))
    return review.with_overrides(base, o, "region_id", ["label", "role"]).select("region_id", "label", "role", F.array_join("changed", ",").alias("changed"))


def _audit(spark: SparkSession, d: str) -> DataFrame:
    points = F.to_json("bbox")
    lines = _lines(spark, d).join(_runs(spark, d).select("result_id", "run"), "result_id").select("page_id", points.alias("points"), "text", F.col("reading_order").alias("position"), "run", "line_id")
    # The second run as labels over the first one's cache; a page of one run is all cache.
    return review.label_audit(lines.where("run = 2"), lines.where("run = 1"))


def q_label_audit(spark: SparkSession, d: str) -> DataFrame:
    """The second run of each page against the first, by exact geometry: boxes kept, changed, new and out of order."""
    return _audit(spark, d)


def q_audit_totals(spark: SparkSession, d: str) -> DataFrame:
    return review.audit_totals(_audit(spark, d)).withColumn("kept_share", _r("kept_share"))


def q_override_problems(spark: SparkSession, d: str) -> DataFrame:
    """Corrections that must not be applied: of unknown regions, twice, of another figure, of another label, damaged."""
    base = first_of(table(spark, d, "regions").select("region_id", "figure_id", "label", "arrived_at"), ["region_id"], ["arrived_at", "label"]).drop("arrived_at").withColumn("digest", F.length("label"))
    n = F.length("region_id") + F.coalesce(F.length("label"), F.lit(0))
    o = base.where(n % 3 == 0).select(
        F.when(n % 2 == 0, F.col("region_id")).otherwise(F.concat("region_id", F.lit("x"))).alias("region_id"),
        F.when(n % 4 == 0, F.lit("other")).otherwise(F.col("figure_id")).alias("figure_id"),
        (F.col("digest") + F.when(n % 9 == 0, 1).otherwise(0)).alias("digest"),
        F.when(n % 5 == 0, F.lit(" ")).otherwise(F.col("label")).alias("corrected_text"),
    )
    return review.override_problems(base, o.unionByName(o.where("length(region_id) % 2 = 0")), "region_id", ["figure_id"], "digest")


def q_watermarks(spark: SparkSession, d: str) -> DataFrame:
    """Lines that hold a page number of two digits and where they stand, as marks of a scan are told from text."""
    texts = tuple(str(k) for k in range(10, 100))
    return evidence.watermarks(_boxes(spark, d), texts).select("line_id", "text", "corner")


def q_quality_gates(spark: SparkSession, d: str) -> DataFrame:
    """Sources all of whose runs are reviewed and read; error measures stay null until then."""
    runs = table(spark, d, "ocr_results").dropDuplicates(["result_id"])
    ok = F.coalesce((F.col("review_state") == "reviewed") & (F.col("status") != "failed"), F.lit(False))
    g = runs.groupBy("source_id").agg(F.count("*").alias("n_runs"), F.count_if(ok).alias("n_ready"), F.every(ok).alias("ready"))
    return g.withColumn("share", F.when(F.col("ready"), _r(F.col("n_ready") / F.col("n_runs"))))


def q_markup(spark: SparkSession, d: str) -> DataFrame:
    """Titles and descriptions wrapped in wiki markup and freed from it."""
    f = first_of(table(spark, d, "domestic_ai_selection").select("figure_id", "title", "description", "arrived_at"), ["figure_id"], ["arrived_at", "title"])
    wrapped = F.concat(F.lit("<!-- note -->'''"), F.coalesce("title", F.lit("")), F.lit("'''{{cite|{{inner}}}}\n[[Page|"), F.col("description"), F.lit("]]<ref>x</ref>&amp;<br/>"))
    return f.select("figure_id", clean_markup(wrapped).alias("text"))


def q_noise_terms(spark: SparkSession, d: str) -> DataFrame:
    """Lines with a known noise term or a replacement character; some get one here."""
    own = F.when(F.col("line_id") % 50 == 0, F.concat("text", F.lit(" Gray Scale"))).when(F.col("line_id") % 50 == 1, F.concat(F.lit("番號"), "text")).otherwise(F.col("text"))
    return _lines(spark, d).select("line_id", F.coalesce(has_known_noise(own), F.lit(False)).alias("noise"))


def _drained(df: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a stream until its files are read and gives what it wrote to the shared folder."""
    spark = df.sparkSession
    path = f"{_shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    q = df.writeStream.format("parquet").option("checkpointLocation", f"{path}/state").outputMode(mode).trigger(availableNow=True).start(f"{path}/out")
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{path}/out")


def q_stream_windows(spark: SparkSession, d: str) -> DataFrame:
    """Events a day and type, from a stream of files; a window is written once the watermark has passed it."""
    events = state.file_stream(spark, f"{d}/events.parquet*", "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string")
    out = _drained(state.windowed_counts(events.select("ts", "event_type"), "ts", "event_type"))
    return out.select(F.col("start").cast("string").alias("start"), "event_type", "n")


def q_stream_latest(spark: SparkSession, d: str) -> DataFrame:
    """The latest run of each page, upserted batch by batch from a stream of files."""
    path = f"{_shared_folder(spark)}/latest-{uuid.uuid4().hex}"
    schema = "page_id string, result_id bigint, status string, arrived_at timestamp_ntz"
    log = state.file_stream(spark, f"{d}/ocr_results.parquet*", schema, files_a_trigger=2)
    q = log.writeStream.foreachBatch(state.upsert_batches(f"{path}/out", ["page_id"], ["arrived_at", "result_id"])).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return read_table(spark, f"{path}/out").select("page_id", "result_id", "status")


QUERIES = {f.__name__: f for f in (
    q_bbox_problems, q_contained, q_pixel_boxes, q_crop_pixels, q_located, q_regions_in_crop, q_scoped_functions, q_reading_order, q_layout_roles, q_section_headings, q_section_fill, q_order_monotonic,
    q_permutation, q_inserted, q_alignment, q_error_rates, q_corpus_error_rate, q_box_recall, q_consensus, q_review_candidates, q_review_reasons, q_review_queue, q_overrides, q_override_problems, q_label_audit, q_audit_totals, q_watermarks, q_quality_gates,
    q_markup, q_noise_terms, q_stream_windows, q_stream_latest,
)}

_VALID = "({0}.x between 0 and 1 and {0}.y between 0 and 1 and {0}.width > 0 and {0}.width <= 1 and {0}.height > 0 and {0}.height <= 1 and {0}.x + {0}.width <= 1 + 1e-9::double and {0}.y + {0}.height <= 1 + 1e-9::double)"
_INSIDE = "(" + _VALID.format("{1}") + " and " + _VALID.format("{0}") + " and {0}.x >= {1}.x - 1e-9::double and {0}.y >= {1}.y - 1e-9::double and {0}.x + {0}.width <= {1}.x + {1}.width + 1e-9::double and {0}.y + {0}.height <= {1}.y + {1}.height + 1e-9::double)"
_FIGURES = "fig as (select figure_id, arg_min(page_id, arrived_at) page_id, arg_min(bbox, arrived_at) fb from domestic_ai_selection group by 1)"
_PAGES = "pg as (select page_id, arg_min(width, arrived_at) w, arg_min(height, arrived_at) h from page_inventory group by 1)"
_ONCE = "li as (select * from (select *, row_number() over (partition by line_id order by arrived_at) r from ocr_lines) where r = 1)"
_RUNS = "ru as (select page_id, source_id, result_id, raw_text, row_number() over (partition by page_id order by arrived_at, result_id) run from (select * from (select *, row_number() over (partition by result_id order by arrived_at) r from ocr_results where raw_text <> '') where r = 1))"
_REG = "reg as (select distinct region_id, figure_id, bbox from regions)"

_ROLES = f"""ro as (select line_id, result_id, page_id, box_id, reading_order, "text", confidence, candidates, t.* from (select *, bbox[3] - bbox[1] bw, (bbox[4] - bbox[2]) / h part, length(regexp_replace(coalesce("text", ''), '[^{CJK}]', '', 'g')) nc, trim(coalesce("text", '')) tt, cast(nullif(regexp_extract(page_id, '-p(\\d+)$', 1), '') as int) no from li join pg using (page_id)) b,
  lateral (select unnest(case
    when (no, reading_order) in ((2, 0), (3, 1), (5, 0)) then struct_pack(category := 'text', "role" := 'section_heading', role_confidence := 0.99::double, candidate := case no when 2 then '乃服第二' when 3 then '蠶浴' else '葉料' end)
    when no = 1 then struct_pack(category := 'annotation', "role" := 'book_title', role_confidence := 0.96::double, candidate := null::varchar)
    when tt = '十三号' then struct_pack(category := 'annotation', "role" := 'repository_mark', role_confidence := 0.96::double, candidate := null::varchar)
    when bbox[1] / w < 0.115::double and part < 0.32::double and contains(tt, '天') and contains(tt, '物') then struct_pack(category := 'annotation', "role" := 'running_title', role_confidence := 0.96::double, candidate := null::varchar)
    when bbox[1] / w < 0.115::double and part < 0.32::double then struct_pack(category := 'annotation', "role" := 'folio_mark', role_confidence := 0.96::double, candidate := null::varchar)
    when regexp_matches(tt, '[\\x{{3040}}-\\x{{30ff}}A-Za-z\\p{{Nd}}²³¹⁰-⁹₀-₉]') and (nc < 8 or part < 0.28::double) then struct_pack(category := 'annotation', "role" := 'interlinear_annotation', role_confidence := 0.96::double, candidate := null::varchar)
    when bw < 25 and part * h < 80 then struct_pack(category := 'annotation', "role" := 'recognition_fragment', role_confidence := 0.96::double, candidate := null::varchar)
    when (no, reading_order) in ((8, 0), (9, 1), (11, 0)) then struct_pack(category := 'caption', "role" := 'figure_title', role_confidence := 0.93::double, candidate := case no when 8 then '乃服第二' when 9 then '蠶浴' else '葉料' end)
    when no in (7, 11) then struct_pack(category := 'caption', "role" := 'component_label', role_confidence := 0.86::double, candidate := null::varchar)
    when nc >= 10 or part >= 0.28::double then struct_pack(category := 'text', "role" := 'body', role_confidence := 0.92::double, candidate := null::varchar)
    else struct_pack(category := 'annotation', "role" := 'interlinear_annotation', role_confidence := 0.72::double, candidate := null::varchar) end)) t)"""


def _ck(x: str) -> str:
    return f"regexp_replace(coalesce({x}, ''), '[^{CJK}]', '', 'g')"


_REASONS = f"""r2 as (select page_id, box_id, arg_min("text", line_id) st, arg_min(confidence, line_id) sc from li where result_id in (select result_id from ru where run = 2) group by 1, 2),
  rd as (select ro.*, st, sc, candidates[1] rt, case when candidates[1] is not null then confidence end pc, {_ck('ro."text"')} a, {_ck('st')} b, {_ck('candidates[1]')} c from ro left join r2 using (page_id, box_id) where result_id in (select result_id from ru where run = 1)),
  rn as (select *, (a <> '')::int + (b <> '')::int + (c <> '')::int n, greatest(case when a <> '' and b <> '' then case when a = b then 1.0 else 0.5 end else 0.0 end, case when a <> '' and c <> '' then case when a = c then 1.0 else 0.5 end else 0.0 end, case when b <> '' and c <> '' then case when b = c then 1.0 else 0.5 end else 0.0 end) best from rd),
  rs as (select *, list_filter([case when category = 'caption' then 'figure_title_or_component_label' end, case when "role" = 'section_heading' then 'section_heading' end, case when "role" = 'recognition_fragment' then 'recognition_fragment' end,
    case when role_confidence < 0.8 then 'low_category_confidence' end, case when category in ('text', 'caption') and sc < 0.6 then 'low_server_confidence' end, case when pc < 0.5 then 'low_reference_alignment' end,
    case when n >= 3 and best < 0.9 then 'three_way_text_conflict' end, case when n = 2 and best < 0.82 then 'no_high_agreement_pair' end, case when category in ('text', 'caption') and n < 2 then 'missing_secondary_candidate' end], lambda x: x is not null) r from rn)"""
_PRIORITY = "case when list_has_any(r, ['three_way_text_conflict', 'low_server_confidence', 'low_reference_alignment', 'section_heading', 'missing_caption_box']) then 'critical' when len(r) > 0 then 'review' else 'deferred' end"
_AUDIT = f"""al as (select li.page_id, bbox, "text", reading_order, run from li join ru using (result_id)), ac as (select page_id, bbox, arg_min("text", reading_order) old, min(reading_order) op from al where run = 1 group by 1, 2),
  aj as (select al.page_id, al."text" t, ac.old, ac.op, ac.page_id is not null there, al.reading_order ro from al left join ac on ac.page_id = al.page_id and ac.bbox = al.bbox where run = 2),
  ak as (select *, op < last_value(op ignore nulls) over (partition by page_id order by ro rows between unbounded preceding and 1 preceding) back from aj),
  ap as (select page_id, count(*) n_labels, count_if(there and t is not distinct from old) kept, count_if(there and t is distinct from old) text_changed, count_if(not there) "new", count_if(back) n_back, count_if(contains(t, '\ufffd')) replacement_characters,
    count_if(({' or '.join(f"contains(lower(t), '{x}')" for x in NOISE_TERMS)}) and not contains(t, '\ufffd')) noise from ak group by 1),
  ad as (select page_id, count(*) n_cached from al where run = 1 group by 1),
  au as (select coalesce(ap.page_id, ad.page_id) page_id, coalesce(n_labels, 0) n_labels, coalesce(kept, 0) kept, coalesce(text_changed, 0) text_changed, coalesce("new", 0) "new", coalesce(n_back, 0) n_back, coalesce(replacement_characters, 0) replacement_characters, coalesce(noise, 0) noise, coalesce(n_cached, 0) n_cached, coalesce(n_cached, 0) - coalesce(n_labels, 0) net_removed from ap full join ad on ad.page_id = ap.page_id)"""

SQL = {
    "q_bbox_problems": f"""with g as (select region_id, length(region_id) + coalesce(length("label"), 0) n, bbox b from regions),
      r as (select region_id, case n % 5 when 0 then struct_pack(x := b.x + 0.7, y := b.y, width := b.width, height := b.height) when 1 then struct_pack(x := b.x, y := 'nan'::double, width := b.width, height := b.height)
        when 2 then struct_pack(x := b.x, y := b.y, width := 0.0::double, height := b.height) when 3 then b end bbox from g)
      select distinct region_id id, case when bbox is null then 'missing' when not (isfinite(bbox.x) and isfinite(bbox.y) and isfinite(bbox.width) and isfinite(bbox.height)) then 'not_finite' else 'outside' end problem from r where not coalesce({_VALID.format('bbox')}, false) or not isfinite(bbox.y)
      union all select distinct figure_id, case when bbox is null then 'missing' when not (isfinite(bbox.x) and isfinite(bbox.y) and isfinite(bbox.width) and isfinite(bbox.height)) then 'not_finite' else 'outside' end from domestic_ai_selection where not coalesce({_VALID.format('bbox')}, false)""",
    "q_contained": f"""with {_REG}, {_FIGURES}, b as (select *, greatest(least(bbox.x + bbox.width, fb.x + fb.width) - greatest(bbox.x, fb.x), 0) * greatest(least(bbox.y + bbox.height, fb.y + fb.height) - greatest(bbox.y, fb.y), 0) i from reg join fig using (figure_id))
      select region_id, round(bbox.x, 6) x, coalesce({_INSIDE.format('bbox', 'fb')}, false) inside, round(i / (bbox.width * bbox.height + fb.width * fb.height - i), 6) iou from b""",
    "q_pixel_boxes": f"""with {_ONCE}, {_PAGES} select line_id, round(bbox[1] / w, 6) x, round(bbox[2] / h, 6) y, round((bbox[3] - bbox[1]) / w, 6) width, round((bbox[4] - bbox[2]) / h, 6) height from li join pg using (page_id)""",
    "q_crop_pixels": f"""with {_FIGURES}, {_PAGES}, c as (select figure_id, w, h, greatest(0, least(w - 1, trunc(fb.x * w)::int)) "left", greatest(0, least(h - 1, trunc(fb.y * h)::int)) top, trunc((fb.x + fb.width) * w)::int r, trunc((fb.y + fb.height) * h)::int b from fig join pg using (page_id))
      select figure_id, "left", top, greatest("left" + 1, least(w, r)) "right", greatest(top + 1, least(h, b)) bottom from c""",
    "q_located": f"""with {_REG}, {_FIGURES}, c as (select *, struct_pack(x := 0.0::double, y := 0.0::double, width := 1.0::double, height := 0.5::double) crop from reg join fig using (figure_id))
      select region_id, round(bbox.y, 6) y, coalesce({_INSIDE.format('bbox', 'crop')}, false) located from c""",
    "q_regions_in_crop": f"""with {_REG}, {_FIGURES}, c as (select *, struct_pack(x := 0.0::double, y := 0.0::double, width := 0.75::double, height := 1.0::double) crop from reg join fig using (figure_id) where cast(nullif(regexp_extract(figure_id, '{FIGURE_NO}', 1), '') as bigint) % {EVERY} = 0)
      select figure_id query_id, region_id from c where {_INSIDE.format('bbox', 'crop')}""",
    "q_scoped_functions": f"""with {_FIGURES}, f as (select figure_key, arg_min(functions, arrived_at) fs from domestic_functions group by 1),
      g as (select figure_key, generate_subscripts(fs, 1) no, unnest(fs) f from f), k as (select figure_key, no, f.slot slot, f.concept concept, f.supports s from g where f.concept <> 'unknown'),
      s as (select figure_key, no, unnest(s).reference_id ref from k), bx as (select region_id, arg_min(bbox, arrived_at) bbox from regions group by 1),
      j as (select s.*, ref is null or coalesce({_INSIDE.format('bx.bbox', 'unit')}, false) ok from s join fig on fig.figure_id = s.figure_key left join bx on bx.region_id = ref cross join (select struct_pack(x := 0.0::double, y := 0.0::double, width := 0.6::double, height := 1.0::double) unit))
      select k.figure_key, slot, concept, (select count(ref) from s where s.figure_key = k.figure_key and s.no = k.no) n_supports from k join fig on fig.figure_id = k.figure_key
      where not exists (select 1 from j where j.figure_key = k.figure_key and j.no = k.no and not ok)""",
    "q_reading_order": f"""with {_ONCE}, {_PAGES}, c as (select *, (bbox[1] + bbox[3]) / 2 m from li join pg using (page_id))
      select line_id, result_id, row_number() over (partition by result_id order by case when m >= w / 2 then 0 else 1 end, -round_even((m / 40)::double, 0), bbox[2], -m, box_id) "position" from c""",
    "q_layout_roles": f"""with {_ONCE}, {_PAGES}, {_ROLES} select line_id, category, "role", role_confidence, candidate from ro""",
    "q_section_fill": f"""with {_ONCE} select line_id, last_value(case when regexp_matches("text", '[!?]$') then line_id end ignore nulls) over (partition by source_id order by page_id, result_id, reading_order rows between unbounded preceding and current row) section from li""",
    "q_order_monotonic": f"""with {_ONCE}, l as (select result_id, bbox[3] y, lag(bbox[3]) over (partition by result_id order by reading_order) p from li) select result_id, count(*) n_back from l where y < p group by 1""",
    "q_permutation": f"""with {_ONCE} select * from (select result_id, count(reading_order) n, count(distinct reading_order) n_distinct, min(reading_order) lowest, max(reading_order) highest from li where deleted_at is null group by 1)
      where n <> n_distinct or lowest <> 0 or highest <> n - 1""",
    "q_inserted": f"""with {_ONCE}, i as (select result_id, line_id::varchar item_id, reading_order "position", reading_order a, -1 s from li union all select result_id, 's-' || line_id, null, reading_order, 0 from li where reading_order = 2),
      n as (select *, row_number() over (partition by result_id order by a, s, item_id) new_position from i) select result_id, item_id, new_position, coalesce("position" <> new_position, true) moved from n""",
    "q_review_reasons": f"""with {_ONCE}, {_PAGES}, {_RUNS}, {_ROLES}, {_REASONS} select line_id, array_to_string(r, ',') reasons, {_PRIORITY} priority from rs""",
    "q_review_queue": f"""with {_ONCE}, {_PAGES}, {_RUNS}, {_ROLES}, {_REASONS},
      f as (select page_id, figure_id, title is not null captioned from (select *, row_number() over (partition by figure_id order by arrived_at, page_id nulls first, title nulls first) k from domestic_ai_selection where page_id <> '') where k = 1),
      i as (select page_id, box_id || '#' || line_id item_id, 'box' kind, reading_order o, r from rs union all select page_id, figure_id, 'figure', null, ['technical_figure_region'] from f union all select page_id, figure_id || '-title', 'caption', null, ['missing_caption_box'] from f where not captioned)
      select page_id, item_id, kind, array_to_string(r, ',') reasons, {_PRIORITY} priority, row_number() over (partition by page_id order by coalesce(o, 10000), item_id) place from i""",
    "q_overrides": """with b as (select region_id, "label", "role" from (select *, row_number() over (partition by region_id order by arrived_at, "label" nulls first, "role" nulls first) r from regions) where r = 1),
      o as (select *, lower("label") nl, case when (length(region_id) + coalesce(length("label"), 0)) % 2 = 0 then 'tool' end nr from b where (length(region_id) + coalesce(length("label"), 0)) % 3 = 0)
      select b.region_id, coalesce(nl, b."label") "label", coalesce(nr, b."role") "role", concat_ws(',', case when nl is not null and nl is distinct from b."label" then 'label' end, case when nr is not null and nr is distinct from b."role" then 'role' end) changed from b left join o using (region_id)""",
    "q_label_audit": f"with {_ONCE}, {_RUNS}, {_AUDIT} select * from au",
    "q_audit_totals": f"""with {_ONCE}, {_RUNS}, {_AUDIT} select count(*) n_pages, count_if(text_changed > 0 or "new" > 0 or net_removed <> 0) n_changed, sum(n_labels)::bigint n_labels, sum(n_cached)::bigint n_cached, sum(kept)::bigint kept, sum(text_changed)::bigint text_changed,
      sum("new")::bigint "new", sum(replacement_characters)::bigint replacement_characters, sum(noise)::bigint noise, sum(net_removed)::bigint net_removed, round(sum(kept) / sum(n_labels), 6) kept_share from au""",
    "q_override_problems": """with b as (select region_id, figure_id, "label", length("label") digest, length(region_id) + coalesce(length("label"), 0) n from (select *, row_number() over (partition by region_id order by arrived_at, "label" nulls first) r from regions) where r = 1),
      o1 as (select case when n % 2 = 0 then region_id else region_id || 'x' end region_id, case when n % 4 = 0 then 'other' else figure_id end figure_id, digest + case when n % 9 = 0 then 1 else 0 end digest, case when n % 5 = 0 then ' ' else "label" end t from b where n % 3 = 0),
      o as (select * from o1 union all select * from o1 where length(region_id) % 2 = 0), c as (select region_id, count(*) k from o group by 1),
      j as (select o.*, c.k, b.region_id is not null known, b.figure_id bf, b.digest bd from o join c using (region_id) left join b using (region_id)),
      p as (select region_id, unnest(list_filter([case when not known then 'unknown' end, case when k > 1 then 'duplicate' end, case when known and figure_id is distinct from bf then 'mismatch' end, case when known and digest is distinct from bd then 'stale' end, case when trim(t) = '' or length(t) > 2000 or contains(t, '\ufffd') then 'damaged' end], lambda x: x is not null)) problem from j)
      select distinct region_id, problem from p""",
    "q_watermarks": f"""with {_ONCE}, {_PAGES} select line_id, "text", bbox[1] >= w * 0.85::double and bbox[2] >= h * 0.9::double and bbox[3] <= w and bbox[4] <= h corner from li join pg using (page_id) where regexp_full_match("text", '[1-9][0-9]')""",
    "q_quality_gates": """with r as (select result_id, any_value(source_id) source_id, coalesce(any_value(review_state) = 'reviewed' and any_value(status) <> 'failed', false) ok from ocr_results group by 1)
      select source_id, count(*) n_runs, count_if(ok) n_ready, bool_and(ok) ready, case when bool_and(ok) then round(count_if(ok) / count(*), 6) end "share" from r group by 1""",
    "q_markup": """with f as (select figure_id, coalesce(title, '') t, description from (select *, row_number() over (partition by figure_id order by arrived_at, title nulls first) r from domestic_ai_selection) where r = 1)
      select figure_id, case when trim(t, ' ') = '' then '' else trim(t, ' ') || chr(10) end || trim(description || '&', ' ') "text" from f""",
    "q_noise_terms": f"""with {_ONCE}, t as (select line_id, case when line_id % 50 = 0 then "text" || ' Gray Scale' when line_id % 50 = 1 then '番號' || "text" else "text" end t from li)
      select line_id, coalesce({' or '.join(f"contains(lower(t), '{x}')" for x in NOISE_TERMS)} or contains(t, '\ufffd'), false) noise from t""",
    "q_stream_windows": """select date_trunc('day', ts)::date || ' 00:00:00' "start", event_type, count(*) n from events where date_trunc('day', ts) + interval 1 day <= (select max(ts) - interval 7 day from events) group by 1, 2""",
    "q_stream_latest": """select page_id, result_id, status from (select *, row_number() over (partition by page_id order by arrived_at desc, result_id desc) r from ocr_results) where r = 1""",
}
