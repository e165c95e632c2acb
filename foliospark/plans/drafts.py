"""Queries on drafts, the evidence they cite, attachments, contexts, reports and lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.functions import geometry as G
from foliospark.functions import text as X
from foliospark.functions.ids import NAMESPACE, stable_id
from foliospark.functions.score import norm_within
from foliospark.operators import evidence, layout
from foliospark.operators.integrity import first_of
from foliospark.plans.lexical import EVERY, FIGURE_NO
from foliospark.session import table


def q_draft_problems(spark: SparkSession, d: str) -> DataFrame:
    """Drafts of functions that break a rule."""
    return evidence.draft_problems(table(spark, d, "domestic_functions"), "figure_key")


def q_query_problems(spark: SparkSession, d: str) -> DataFrame:
    """Fixed queries made of documents, some of them with too much or too little."""
    q = table(spark, d, "documents").select(
        (F.col("doc_id") - F.when(F.col("doc_id") % 40 == 0, 1).otherwise(0)).alias("query_id"),
        F.when(F.col("doc_id") % 3 == 0, "image").when(F.col("doc_id") % 3 == 1, "text").when(F.col("doc_id") % 7 != 0, "region").alias("kind"),
        F.when(F.col("doc_id") % 3 == 1, F.col("text")).alias("text"),
        F.when(F.col("doc_id") % 3 != 1, F.col("source_id")).alias("source_id"),
        F.when(F.col("doc_id") % 5 == 0, F.struct(F.lit(0.1).alias("x"), F.lit(0.1).alias("y"), F.lit(0.5).alias("width"), F.lit(0.5).alias("height"))).alias("bbox"),
    )
    return evidence.query_problems(q)


def _supports(spark: SparkSession, d: str) -> DataFrame:
    f = first_of(table(spark, d, "domestic_functions").select("figure_key", "functions", "arrived_at"), ["figure_key"], ["arrived_at"])
    flat = evidence.flat_supports(f, "figure_key").where("support is not null")
    return flat.select("support.support_id", F.col("figure_key").alias("figure_id"), "support.kind", "support.reference_id", "support.quote")


def _owned(spark: SparkSession, d: str) -> DataFrame:
    """Figures with the page that they are on: supports by text belong to a page, those of the scan to a figure."""
    f = table(spark, d, "domestic_ai_selection").select("figure_id", "page_id", "bbox", "description", "arrived_at")
    return first_of(f, ["figure_id"], ["arrived_at", "page_id"]).drop("arrived_at")


def q_support_binding(spark: SparkSession, d: str) -> DataFrame:
    """Whether each support's target is there, is its figure's or its page's own, and holds the quote word for word."""
    figures = _owned(spark, d)
    s = _supports(spark, d).join(figures.select("figure_id", "page_id"), "figure_id", "left")
    owner = F.when(F.col("kind") == "raw_ocr", F.coalesce("page_id", F.lit(""))).otherwise(F.col("figure_id"))
    supports = s.select("support_id", owner.alias("owner"), "kind", "reference_id", F.when(F.col("kind") != "scan_region", F.col("quote")).alias("quote"))
    none = F.lit(None).cast("string")
    targets = (
        table(spark, d, "regions").select(F.lit("scan_region").alias("kind"), F.col("region_id").alias("reference_id"), F.col("figure_id").alias("owner"), none.alias("content"))
        .unionByName(figures.select(F.lit("ai_visual_description").alias("kind"), F.col("figure_id").alias("reference_id"), F.col("figure_id").alias("owner"), F.col("description").alias("content")))
        .unionByName(table(spark, d, "ocr_lines").select(F.lit("raw_ocr").alias("kind"), F.col("box_id").alias("reference_id"), F.col("page_id").alias("owner"), F.col("text").alias("content")))
    )
    return evidence.bound_supports(supports, targets).select("support_id", "kind", "binding", "n_targets", "n_binding").distinct()


def q_attachment_problems(spark: SparkSession, d: str) -> DataFrame:
    """Evidence attached to figures that is unknown, of another page, attached twice, or does not hold what is quoted."""
    links = table(spark, d, "competition_evidence_links").select("figure_id", "title_id", "label_ids", "contexts", "functional_drafts", "arrived_at")
    links = first_of(links, ["figure_id"], ["arrived_at"])
    figures = _owned(spark, d)
    flat = F.flatten(F.transform("contexts", lambda c: F.coalesce(c["item_ids"], F.array().cast("array<string>"))))
    supports = F.flatten(F.transform("functional_drafts", lambda f: F.transform(F.coalesce(f["supports"], F.array().cast("array<struct<support_id: bigint, item_id: string, quote: string>>")), lambda s: F.struct(s["item_id"].alias("item_id"), s["quote"].alias("quote")))))
    plans = links.join(figures.select("figure_id", "page_id"), "figure_id").select("figure_id", "page_id", "title_id", "label_ids", flat.alias("context_ids"), supports.alias("supports"))
    items = table(spark, d, "ocr_lines").select(F.col("box_id").alias("item_id"), "page_id", "text")
    return evidence.attachment_problems(plans, items, figures.where("page_id <> ''").select("figure_id"))


def q_region_context(spark: SparkSession, d: str) -> DataFrame:
    """What of the query figures lies in the left half of their page, and in all of it: lines, functions and relations."""
    figures = _owned(spark, d).where("page_id <> ''")
    no = F.regexp_extract("figure_id", FIGURE_NO, 1).try_cast("bigint")
    asked = figures.where(no % EVERY == 0)

    def crop(width: float, name: str):
        box = F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(width).alias("width"), F.lit(1.0).alias("height"))
        return asked.select(F.concat("figure_id", F.lit(name)).alias("query_id"), "figure_id", box.alias("crop"), F.col("bbox").alias("figure_box"))

    crops = crop(0.5, "/half").unionByName(crop(1.0, "/all"))
    pages = first_of(table(spark, d, "page_inventory").select("page_id", "width", "height", "arrived_at"), ["page_id"], ["arrived_at"]).drop("arrived_at")
    lines = table(spark, d, "ocr_lines").dropDuplicates(["line_id"]).select("line_id", "page_id", "text", F.col("bbox").alias("corners"))
    place = lines.join(asked.select("figure_id", "page_id"), "page_id").join(pages, "page_id")
    texts = place.select("figure_id", F.col("line_id").alias("place"), "text", G.pixel_to_unit(F.col("corners"), F.col("width"), F.col("height")).alias("bbox"))
    f = first_of(table(spark, d, "domestic_functions").select(F.col("figure_key").alias("figure_id"), "functions", "relations", "arrived_at"), ["figure_id"], ["arrived_at"])
    boxes = first_of(table(spark, d, "regions").select(F.col("region_id").alias("reference_id"), "bbox", "arrived_at"), ["reference_id"], ["arrived_at"]).drop("arrived_at")
    flat = evidence.flat_supports(f, "figure_id").withColumn("reference_id", F.col("support.reference_id")).join(boxes, "reference_id", "left")
    held = F.collect_list(F.when(F.col("support").isNotNull(), F.coalesce("bbox", F.struct(*[F.lit(-1.0).alias(k) for k in ("x", "y", "width", "height")]))))
    functions = flat.groupBy("figure_id", "no", "concept").agg(held.alias("boxes"))
    relations = f.select("figure_id", F.explode("relations").alias("r")).select("figure_id")
    return evidence.scoped_context(crops, texts, functions, relations).select("query_id", "n_texts", F.md5("texts").alias("texts"), "n_functions", "n_relations")


def q_scope_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Pages, boxes without those of later runs, figures and missing captions of each source."""
    pages = table(spark, d, "page_inventory").select("source_id", "page_id").distinct()
    later = F.col("reading_order") > 20
    boxes = table(spark, d, "ocr_lines").where("deleted_at is null").select("source_id", "line_id", later.alias("supplement")).distinct()
    f = _owned_titles(spark, d).join(pages, "page_id").select("source_id", "figure_id", F.col("title").isNotNull().alias("captioned"))
    return evidence.scope_statistics(pages, boxes, f, "source_id")


def _owned_titles(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "domestic_ai_selection").select("figure_id", "page_id", "title", "arrived_at")
    return first_of(f, ["figure_id"], ["arrived_at", "page_id", "title"]).drop("arrived_at")


def q_catalogue_order(spark: SparkSession, d: str) -> DataFrame:
    """Customers by nation's name and key over the whole catalogue, and within their segment by name."""
    c = table(spark, d, "customer").join(F.broadcast(table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).select("n_name", "c_custkey", "c_name", "c_mktsegment")
    whole = layout.catalogue_order(c, ["n_name", "c_custkey"]).withColumnRenamed("position", "place")
    return layout.catalogue_order(whole, ["c_name"], ["c_mktsegment"]).select("c_custkey", "place", "position")


def q_asset_refs(spark: SparkSession, d: str) -> DataFrame:
    """References to pages' pictures by stable id, without an address where they may not be passed on."""
    p = first_of(table(spark, d, "page_inventory").select("page_id", "image_path", "provenance", "arrived_at"), ["page_id"], ["arrived_at", "image_path", "provenance"])
    assets = p.select("page_id", F.when(F.col("image_path").isNotNull(), stable_id("asset", F.col("page_id"))).alias("asset_id"), F.coalesce("provenance", F.lit("unknown")).alias("license_status"), (F.col("provenance") == "supplement").alias("allow_redistribution"))
    return evidence.asset_refs(assets).select("page_id", "ref.asset_id", "ref.url", "ref.license_status", "ref.allow_redistribution")


def q_report_rows(spark: SparkSession, d: str) -> DataFrame:
    """A row of a Markdown table for each region, and what of a figure's description a model may see."""
    r = table(spark, d, "regions").select("region_id", "figure_id", "label", "role").distinct()
    f = _owned(spark, d).select("figure_id", X.truncated(F.col("description"), 60).alias("excerpt"))
    cells = [X.table_cell(c) for c in (F.col("region_id"), X.label_with_role(F.concat(F.col("label"), F.lit(" | ")), F.col("role")), F.col("excerpt"))]
    return r.join(f, "figure_id").select("region_id", F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("row")).distinct()


def q_layers(spark: SparkSession, d: str) -> DataFrame:
    """Of each page the text that stands for it: its second run as a label where a review has confirmed it, else its first."""
    r = table(spark, d, "ocr_results").where("raw_text <> ''").dropDuplicates(["result_id"])
    first = r.groupBy("page_id").agg(F.min("result_id").alias("first_id"))
    runs = r.join(first, "page_id").select("result_id", F.when(F.col("result_id") == F.col("first_id"), "cache").otherwise("label").alias("layer"))
    lines = table(spark, d, "ocr_lines").dropDuplicates(["line_id"]).join(runs, "result_id").select("page_id", "layer", F.col("line_id").alias("position"), "text")
    confirmed = r.where("review_state = 'reviewed'").select("page_id")
    return evidence.layered(lines, confirmed).select("page_id", "layer", "n_lines", F.md5("text").alias("text"))


def q_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Rows by primary key: pushed down to the files."""
    page = table(spark, d, "page_inventory").where("page_id = 'scan-looms-and-mills-v01-p00001'").select(F.lit("page").alias("kind"), F.col("page_id").alias("id"))
    order = table(spark, d, "orders").where("o_orderkey = 7").select(F.lit("order").alias("kind"), F.col("o_orderkey").cast("string").alias("id"))
    none = table(spark, d, "documents").where("doc_id = -1").select(F.lit("document").alias("kind"), F.col("doc_id").cast("string").alias("id"))
    return page.unionByName(order).unionByName(none).distinct()


def q_vector_norms(spark: SparkSession, d: str) -> DataFrame:
    """Vectors by whether their squared length is near one."""
    v = table(spark, d, "vector_results")
    return v.groupBy("entity_type", "modality", "provider", norm_within(F.col("vector")).alias("unit")).agg(F.count("*").alias("n"))


def q_evidence_rows(spark: SparkSession, d: str) -> DataFrame:
    """Regions as evidence in the form in which claims are matched."""
    r = table(spark, d, "regions").select("figure_id", F.col("evidence_state").alias("state"), F.col("region_id").alias("pointer"), F.col("label").alias("excerpt")).distinct()
    return evidence.evidence_rows(r).select("figure_id", "status", "claim_id", F.array_join("supports", ",").alias("supports"), "text")


QUERIES = {f.__name__: f for f in (
    q_draft_problems, q_query_problems, q_support_binding, q_attachment_problems, q_region_context, q_scope_statistics, q_catalogue_order, q_asset_refs, q_report_rows, q_layers,
    q_lookup, q_vector_norms, q_evidence_rows,
)}

_OWNED = "ow as (select figure_id, page_id, bbox, description, title from (select *, row_number() over (partition by figure_id order by arrived_at, page_id nulls first) r from domestic_ai_selection) where r = 1)"
_LINES = "li as (select * from (select *, row_number() over (partition by line_id order by arrived_at) r from ocr_lines) where r = 1)"

SQL = {
    "q_draft_problems": """with f as (select figure_key, functions, unresolved from domestic_functions), g as (select figure_key, unnest(functions) f from f), s as (select figure_key, f.slot slot, f.concept concept, len(f.supports) n, f.supports ss from g),
      u as (select figure_key, unnest(ss) s from s)
      select distinct figure_key, 'slot' problem from s where slot is null or slot not in ('power_source', 'motion', 'transmission', 'action', 'object', 'purpose')
      union select figure_key, 'known_without_support' from s where concept <> 'unknown' and coalesce(n, 0) = 0 union select figure_key, 'unknown_with_support' from s where concept = 'unknown' and n > 0
      union select figure_key, 'scan_with_quote' from u where s.kind = 'scan_region' and s.quote is not null union select figure_key, 'text_without_quote' from u where s.kind <> 'scan_region' and trim(coalesce(s.quote, '')) = ''
      union select figure_key, 'slot_twice' from f where len(list_distinct(list_transform(functions, lambda x: x.slot))) < len(functions) union select figure_key, 'nothing_unresolved' from f where coalesce(len(unresolved), 0) = 0""",
    "q_query_problems": """with q as (select doc_id - case when doc_id % 40 = 0 then 1 else 0 end query_id, case when doc_id % 3 = 0 then 'image' when doc_id % 3 = 1 then 'text' when doc_id % 7 <> 0 then 'region' end kind,
        doc_id % 3 = 1 and trim(coalesce("text", ''), ' ') <> '' t, doc_id % 3 <> 1 and source_id is not null s, doc_id % 5 = 0 b from documents)
      select distinct query_id, 'kind' problem from q where kind is null union select query_id, 'text_alone' from q where kind = 'text' and (not t or s or b) union select query_id, 'source_alone' from q where kind <> 'text' and (t or not s)
      union select query_id, 'box_of_region' from q where kind <> 'text' and ((kind = 'region') <> b) union select query_id, 'id_twice' from q group by 1 having count(*) > 1""",
    "q_support_binding": f"""with {_OWNED}, f as (select figure_key, arg_min(functions, arrived_at) fs from domestic_functions group by 1), g as (select figure_key, unnest(fs) f from f), h as (select figure_key, unnest(f.supports) s from g),
      su as (select s.support_id support_id, case when s.kind = 'raw_ocr' then coalesce(page_id, '') else figure_key end "owner", s.kind kind, s.reference_id reference_id, case when s.kind <> 'scan_region' then s.quote end quote from h left join ow on ow.figure_id = figure_key),
      tg as (select distinct 'scan_region' kind, region_id reference_id, figure_id "owner", null::varchar content from regions union select 'ai_visual_description', figure_id, figure_id, description from ow union select 'raw_ocr', box_id, page_id, "text" from ocr_lines),
      j as (select su.support_id, su.kind, su.reference_id, count(tg.kind) n_targets, count_if(tg."owner" = su."owner") mine, coalesce(count_if(tg."owner" = su."owner" and (su.quote is null or coalesce(contains(content, su.quote), false))), 0) n_binding from su left join tg on tg.kind = su.kind and tg.reference_id = su.reference_id and su.reference_id <> '' group by all)
      select distinct support_id, kind, case when n_targets = 0 then 'missing' when n_binding > 0 then 'bound' when mine > 0 then 'absent' else 'foreign' end binding, n_targets, n_binding from j""",
    "q_attachment_problems": f"""with {_OWNED}, l as (select figure_id, arg_min(title_id, arrived_at) title_id, arg_min(label_ids, arrived_at) label_ids, arg_min(contexts, arrived_at) contexts, arg_min(functional_drafts, arrived_at) fd from competition_evidence_links group by 1),
      p as (select l.*, page_id from l join ow using (figure_id)),
      a0 as (select figure_id, page_id, 'title' part, title_id item_id from p union all select figure_id, page_id, 'label', unnest(label_ids) from p union all select figure_id, page_id, 'context', unnest(flatten(list_transform(contexts, lambda c: coalesce(c.item_ids, [])))) from p),
      a as (select * from a0 where item_id <> ''), c0 as (select figure_id, unnest(flatten(list_transform(fd, lambda f: coalesce(f.supports, [])))) s from p), c as (select figure_id, s.item_id item_id, s.quote quote from c0 where s.item_id <> '')
      select distinct figure_id, item_id, 'unknown' problem from a where item_id not in (select box_id from ocr_lines)
      union select figure_id, item_id, 'other_page' from a where part <> 'context' and item_id in (select box_id from ocr_lines) and not exists (select 1 from ocr_lines o where o.box_id = a.item_id and o.page_id = a.page_id) and page_id is not null
      union select figure_id, item_id, 'attached_twice' from a group by 1, 2 having count(*) > 1 union select figure_id, item_id, 'not_attached' from c where (figure_id, item_id) not in (select (figure_id, item_id) from a)
      union select figure_id, item_id, 'quote_absent' from c where item_id in (select box_id from ocr_lines) and not exists (select 1 from ocr_lines o where o.box_id = c.item_id and contains(o."text", c.quote))
      union select figure_id, null, 'not_linked' from ow where page_id <> '' and figure_id not in (select figure_id from p)""",
    "q_region_context": f"""with {_OWNED}, {_LINES}, pg as (select page_id, arg_min(width, arrived_at) w, arg_min(height, arrived_at) h from page_inventory group by 1),
      q as (select * from ow where page_id <> '' and cast(nullif(regexp_extract(figure_id, '{FIGURE_NO}', 1), '') as bigint) % {EVERY} = 0),
      cr as (select figure_id || '/half' query_id, figure_id, page_id, bbox, 0.5::double cw from q union all select figure_id || '/all', figure_id, page_id, bbox, 1.0::double from q),
      ln as (select line_id, li.page_id, "text", bbox[1] / w x, bbox[2] / h y, (bbox[3] - bbox[1]) / w bw, (bbox[4] - bbox[2]) / h bh from li join pg using (page_id)),
      tx as (select query_id, count(*) n, string_agg("text", ' ' order by line_id) t from cr join ln on ln.page_id = cr.page_id where trim("text", ' ') <> '' and x between 0 and 1 and y between 0 and 1 and bw > 0 and bw <= 1 and bh > 0 and bh <= 1 and x + bw <= 1 + 1e-9 and y + bh <= 1 + 1e-9 and x + bw <= cw + 1e-9 group by 1),
      f as (select figure_key, arg_min(functions, arrived_at) fs, arg_min(relations, arrived_at) rs from domestic_functions group by 1), g as (select figure_key, generate_subscripts(fs, 1) no, unnest(fs) f from f), s as (select figure_key, no, f.concept concept, unnest(f.supports) s from g),
      bx as (select region_id, arg_min(bbox, arrived_at) b from regions group by 1),
      j as (select query_id, no, b.x between 0 and 1 and b.y between 0 and 1 and b.width > 0 and b.width <= 1 and b.height > 0 and b.height <= 1 and b.x + b.width <= 1 + 1e-9 and b.y + b.height <= 1 + 1e-9 and b.x + b.width <= cw + 1e-9 ok from cr join s on s.figure_key = cr.figure_id left join bx on region_id = s.s.reference_id where concept <> 'unknown'),
      k as (select query_id, count(*) n from (select query_id, no from j group by 1, 2 having bool_and(coalesce(ok, false))) group by 1),
      rl as (select query_id, len(rs) n from cr join f on f.figure_key = cr.figure_id where bbox.x + bbox.width <= cw + 1e-9 and bbox.x between 0 and 1 and bbox.y between 0 and 1 and bbox.width > 0 and bbox.height > 0 and bbox.y + bbox.height <= 1 + 1e-9 and len(rs) > 0)
      select query_id, coalesce(tx.n, 0) n_texts, md5(coalesce(t, '')) texts, coalesce(k.n, 0) n_functions, coalesce(rl.n, 0) n_relations from cr left join tx using (query_id) left join k using (query_id) left join rl using (query_id)""",
    "q_scope_statistics": """with p as (select distinct source_id, page_id from page_inventory), b as (select distinct source_id, line_id, reading_order > 20 s from ocr_lines where deleted_at is null),
      f as (select source_id, figure_id, title from (select *, row_number() over (partition by figure_id order by arrived_at, page_id nulls first, title nulls first) r from domestic_ai_selection) t join p using (page_id) where r = 1)
      select p.source_id, count(*) n_pages, (select coalesce(count_if(not s), 0) from b where b.source_id = p.source_id) retained_boxes, (select coalesce(count_if(s), 0) from b where b.source_id = p.source_id) supplements, (select count(*) from f where f.source_id = p.source_id) figures, (select coalesce(count_if(title is null), 0) from f where f.source_id = p.source_id) missing_captions from p group by 1""",
    "q_catalogue_order": """select c_custkey, row_number() over (order by n_name, c_custkey) place, row_number() over (partition by c_mktsegment order by c_name) "position" from customer join nation on c_nationkey = n_nationkey""",
    "q_asset_refs": f"""with p as (select page_id, image_path, provenance from (select *, row_number() over (partition by page_id order by arrived_at, image_path nulls first, provenance nulls first) r from page_inventory) where r = 1),
      h as (select *, sha1(unhex('{NAMESPACE.hex}') || encode('asset:' || page_id)) h from p),
      i as (select *, case when image_path is not null then substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', 1 + (strpos('0123456789abcdef', substr(h, 17, 1)) - 1) % 4, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) end id from h)
      select page_id, id asset_id, case when provenance = 'supplement' then '/assets/' || id end url, case when id is not null then coalesce(provenance, 'unknown') end license_status, case when id is not null then coalesce(provenance = 'supplement', false) end allow_redistribution from i""",
    "q_report_rows": f"""with {_OWNED}, r as (select distinct region_id, figure_id, "label" || ' | ' || case when trim("role") <> '' then '（' || "role" || '）' else '' end l, left(description, 60) e from regions join ow using (figure_id))
      select distinct region_id, '| ' || replace(region_id, '|', '\\|') || ' | ' || replace(coalesce(l, ''), '|', '\\|') || ' | ' || replace(regexp_replace(e, '\\s*\\n\\s*', ' ', 'g'), '|', '\\|') || ' |' "row" from r""",
    "q_layers": f"""with {_LINES}, r as (select page_id, result_id, bool_or(review_state = 'reviewed') done from ocr_results where raw_text <> '' group by 1, 2), m as (select page_id, min(result_id) first_id, bool_or(done) done from r group by 1),
      l as (select li.page_id, case when li.result_id <> first_id and coalesce(m.done, false) then 0 when li.result_id = first_id then 1 else 2 end k, line_id, "text" from li join r on r.result_id = li.result_id join m on m.page_id = r.page_id),
      b as (select page_id, min(k) k from l group by 1)
      select page_id, case k when 0 then 'label' when 1 then 'cache' else 'unconfirmed_label' end layer, count(*) n_lines, md5(string_agg(coalesce("text", ''), chr(10) order by line_id)) "text" from l join b using (page_id, k) group by 1, 2""",
    "q_lookup": """select distinct 'page' kind, page_id id from page_inventory where page_id = 'scan-looms-and-mills-v01-p00001' union select 'order', o_orderkey::varchar from orders where o_orderkey = 7""",
    "q_vector_norms": """select entity_type, modality, provider, coalesce(len(vector) > 0 and len(list_filter(vector, lambda x: x is null or not isfinite(x))) = 0 and list_sum(list_transform(vector, lambda x: x::double * x::double)) between 0.98 and 1.02, false) unit, count(*) n from vector_results group by 1, 2, 3, 4""",
    "q_evidence_rows": """select distinct figure_id, evidence_state status, region_id claim_id, region_id supports, "label" "text" from regions""",
}
