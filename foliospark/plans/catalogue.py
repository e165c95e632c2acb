"""Queries on the catalogue: chains of parents, attached children, integrity, upserts, states, ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.functions.ids import NAMESPACE, fingerprint, stable_id
from foliospark.functions.text import clean_path
from foliospark.operators import integrity as I
from foliospark.operators.search import search_filters
from foliospark.session import table
from foliospark.sources.files import pending
from foliospark.sources.storage import upserted

TABLES = ["page_inventory", "ocr_results", "ocr_lines", "domestic_ai_selection", "regions", "domestic_functions", "competition_evidence_links", "vector_results", "documents"]


def q_catalog_chain(spark: SparkSession, d: str) -> DataFrame:
    """Parents of parents: orders to customer, nation and region, counted by the top."""
    t = lambda n: table(spark, d, n)
    chain = (
        t("orders")
        .join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    )
    return chain.groupBy("r_name", "n_name").agg(
        F.count("*").alias("n_orders"), F.countDistinct("o_custkey").alias("n_customers"), F.round(F.sum("o_totalprice"), 2).alias("total")
    )


def q_figure_children(spark: SparkSession, d: str) -> DataFrame:
    """Figures with their regions, each child aggregated before it is joined."""
    figures = I.first_of(table(spark, d, "domestic_ai_selection").select("figure_id", "page_id", "title", "recorded_at", "arrived_at"), ["figure_id"], ["arrived_at", "recorded_at", "page_id", "title"])
    regions = table(spark, d, "regions").where("deleted_at is null").select("figure_id", "region_id", "label").distinct()
    out = I.attached(figures.select("figure_id"), "figure_id", {"regions": regions.select("figure_id", "region_id", "label")})
    return out.select("figure_id", F.size("regions").alias("n_regions"), F.array_join(F.transform("regions", lambda r: r["region_id"]), ",").alias("region_ids"))


def q_filters(spark: SparkSession, d: str) -> DataFrame:
    """Documents by source and language; empty lists filter nothing."""
    docs = search_filters(table(spark, d, "documents"), source=["transcription", "glossary"], lang=["en", "de", "zh"], kind=[])
    return docs.groupBy("source", "lang").agg(F.count("*").alias("n"))


def q_data_status(spark: SparkSession, d: str) -> DataFrame:
    """Kinds of documents by a fixed map, anything else unclassified."""
    origin = F.create_map(*[F.lit(x) for p in (("transcription", "human"), ("translation", "human"), ("ai_description", "ai")) for x in p])
    status = F.coalesce(F.try_element_at(origin, F.coalesce("source", F.lit(""))), F.lit("unclassified"))
    return table(spark, d, "documents").groupBy(status.alias("origin")).agg(F.count("*").alias("n"))


def _checks(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    t = lambda n: table(spark, d, n)
    figures, regions, lines, results, pages = t("domestic_ai_selection"), t("regions"), t("ocr_lines"), t("ocr_results"), t("page_inventory")
    return {
        "region_without_figure": I.missing_targets(regions, "figure_id", figures, "figure_id"),
        "line_without_result": I.missing_targets(lines, "result_id", results, "result_id"),
        "line_without_page": I.missing_targets(lines, "page_id", pages, "page_id"),
        "line_of_another_page": I.foreign_owners(lines, "result_id", "page_id", results, "result_id", "page_id"),
        "region_id_twice": I.duplicates(regions, ["region_id"]),
        "line_id_twice": I.duplicates(lines, ["line_id"]),
        "vector_id_twice": I.duplicates(t("vector_results"), ["vec_id"]),
        "figure_without_region": I.uncovered(figures, "figure_id", {"n_regions": regions}),
        "label_pair_twice": I.unordered_duplicates(regions.where("label is not null and role is not null"), "label", "role"),
    }


def q_integrity(spark: SparkSession, d: str) -> DataFrame:
    return I.rule_counts(_checks(spark, d))


def q_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Children of each figure by table."""
    t = lambda n: table(spark, d, n)
    children = {
        "n_regions": t("regions"),
        "n_functions": t("domestic_functions").withColumnRenamed("figure_key", "figure_id"),
        "n_links": t("competition_evidence_links"),
    }
    return I.coverage(t("domestic_ai_selection"), "figure_id", children)


def q_exact_diff(spark: SparkSession, d: str) -> DataFrame:
    """What two versions of a table differ in, as bags of rows."""
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    changed = o.select("o_orderkey", F.when(F.col("o_orderkey") % 97 == 0, "X").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"))
    return I.difference(o, changed)


def q_upsert(spark: SparkSession, d: str) -> DataFrame:
    old = table(spark, d, "supplier")
    changed = old.where("s_suppkey % 7 = 0").withColumn("s_acctbal", F.round(F.col("s_acctbal") + 1, 2))
    new = old.where("s_suppkey % 11 = 0").withColumns({"s_suppkey": F.col("s_suppkey") + 1_000_000, "s_name": F.concat(F.lit("New "), "s_name")})
    return upserted(old, changed.unionByName(new), ["s_suppkey"])


def q_latest_state(spark: SparkSession, d: str) -> DataFrame:
    """The last run of each page."""
    runs = table(spark, d, "ocr_results").select("page_id", "result_id", "status", "review_state", "arrived_at")
    return I.latest(runs, ["page_id"], ["arrived_at", "result_id"]).select("page_id", "result_id", "status", "review_state")


def q_first_match(spark: SparkSession, d: str) -> DataFrame:
    """The first figure of each page, by id."""
    f = table(spark, d, "domestic_ai_selection").where("page_id <> ''").select("page_id", "figure_id")
    return I.first_of(f, ["page_id"], ["figure_id"])


def q_pending(spark: SparkSession, d: str) -> DataFrame:
    """Pages that no run has read well."""
    done = table(spark, d, "ocr_results").where("status <> 'failed' and raw_text <> ''")
    return pending(done, table(spark, d, "page_inventory").where("deleted_at is null").select("page_id", "source_id").distinct(), ["page_id"])


def q_row_counts(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for n in TABLES:
        part = table(spark, d, n).agg(F.count("*").alias("n")).select(F.lit(n).alias("table_name"), "n")
        out = part if out is None else out.unionByName(part)
    return out


def q_key_sets(spark: SparkSession, d: str) -> DataFrame:
    """Union, intersection and differences of the figures of two tables."""
    a = table(spark, d, "domestic_functions").select(F.col("figure_key").alias("id")).distinct()
    b = table(spark, d, "competition_evidence_links").select(F.col("figure_id").alias("id")).distinct()
    parts = {"union": a.union(b).distinct(), "both": a.intersect(b), "only_functions": a.subtract(b), "only_links": b.subtract(a)}
    return I.rule_counts(parts).withColumnRenamed("rule", "name").withColumnRenamed("violations", "n")


def q_stable_id(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "domestic_ai_selection").select("figure_id", stable_id("figure", F.col("figure_id")).alias("id")).distinct()


def q_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", fingerprint(F.col("source"), F.col("lang"), F.col("text")).alias("fingerprint"))


def q_paths(spark: SparkSession, d: str) -> DataFrame:
    """Image paths in their clean form, with the page number of the page's id."""
    p = table(spark, d, "page_inventory").where("image_path is not null")
    return p.select("page_id", clean_path(F.col("image_path")).alias("path"), F.regexp_extract("page_id", r"-p(\d+)$", 1).cast("int").alias("page_no")).distinct()


_NS = NAMESPACE.hex

QUERIES = {f.__name__: f for f in (
    q_catalog_chain, q_figure_children, q_filters, q_data_status, q_integrity, q_coverage, q_exact_diff, q_upsert, q_latest_state,
    q_first_match, q_pending, q_row_counts, q_key_sets, q_stable_id, q_fingerprint, q_paths,
)}

SQL = {
    "q_catalog_chain": """select r_name, n_name, count(*) n_orders, count(distinct o_custkey) n_customers, round(sum(o_totalprice), 2) total
        from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by 1, 2""",
    "q_figure_children": """with f as (select distinct figure_id from domestic_ai_selection),
        r as (select distinct figure_id, region_id, label from regions where deleted_at is null)
        select f.figure_id, count(r.region_id) n_regions, coalesce(string_agg(r.region_id, ',' order by r.region_id, r.label), '') region_ids
        from f left join r on r.figure_id = f.figure_id group by 1""",
    "q_filters": "select source, lang, count(*) n from documents where source in ('transcription', 'glossary') and lang in ('en', 'de', 'zh') group by 1, 2",
    "q_data_status": """select case source when 'transcription' then 'human' when 'translation' then 'human' when 'ai_description' then 'ai' else 'unclassified' end origin, count(*) n
        from documents group by 1""",
    "q_integrity": """
        select 'region_without_figure' "rule", count(*) violations from regions where figure_id not in (select figure_id from domestic_ai_selection)
        union all select 'line_without_result', count(*) from ocr_lines where result_id not in (select result_id from ocr_results)
        union all select 'line_without_page', count(*) from ocr_lines where page_id not in (select page_id from page_inventory)
        union all select 'line_of_another_page', count(*) from ocr_lines l where result_id in (select result_id from ocr_results)
            and not exists (select 1 from ocr_results r where r.result_id = l.result_id and r.page_id = l.page_id)
        union all select 'region_id_twice', count(*) from (select 1 from regions group by region_id having count(*) > 1)
        union all select 'line_id_twice', count(*) from (select 1 from ocr_lines group by line_id having count(*) > 1)
        union all select 'vector_id_twice', count(*) from (select 1 from vector_results group by vec_id having count(*) > 1)
        union all select 'figure_without_region', count(*) from (select distinct figure_id from domestic_ai_selection where figure_id not in (select figure_id from regions))
        union all select 'label_pair_twice', count(*) from (select 1 from regions where label is not null and role is not null group by least(label, role), greatest(label, role) having count(*) > 1)""",
    "q_coverage": """select f.figure_id, (select count(*) from regions r where r.figure_id = f.figure_id) n_regions,
        (select count(*) from domestic_functions r where r.figure_key = f.figure_id) n_functions,
        (select count(*) from competition_evidence_links r where r.figure_id = f.figure_id) n_links
        from (select distinct figure_id from domestic_ai_selection) f""",
    "q_exact_diff": """with a as (select o_orderkey, o_orderstatus from orders),
        b as (select o_orderkey, case when o_orderkey % 97 = 0 then 'X' else o_orderstatus end o_orderstatus from orders)
        select *, 'left' side from (select * from a except all select * from b) union all select *, 'right' from (select * from b except all select * from a)""",
    "q_upsert": """select * from supplier where s_suppkey % 7 <> 0 union all
        select s_suppkey, s_name, s_nationkey, round(s_acctbal + 1, 2) from supplier where s_suppkey % 7 = 0 union all
        select s_suppkey + 1000000, 'New ' || s_name, s_nationkey, s_acctbal from supplier where s_suppkey % 11 = 0""",
    "q_latest_state": """select page_id, result_id, status, review_state from
        (select *, row_number() over (partition by page_id order by arrived_at desc, result_id desc) r from ocr_results) where r = 1""",
    "q_first_match": "select page_id, min(figure_id) figure_id from domestic_ai_selection where page_id <> '' group by 1",
    "q_pending": """select distinct page_id, source_id from page_inventory where deleted_at is null
        and page_id not in (select page_id from ocr_results where status <> 'failed' and raw_text <> '')""",
    "q_row_counts": " union all ".join(f"select '{n}' table_name, count(*) n from {n}" for n in TABLES),
    "q_key_sets": """with a as (select distinct figure_key id from domestic_functions), b as (select distinct figure_id id from competition_evidence_links)
        select 'union' as name, count(*) n from (select * from a union select * from b) union all select 'both', count(*) from (select * from a intersect select * from b)
        union all select 'only_functions', count(*) from (select * from a except select * from b) union all select 'only_links', count(*) from (select * from b except select * from a)""",
    "q_stable_id": f"""with h as (select distinct figure_id, sha1(unhex('{_NS}') || encode('figure:' || figure_id)) h from domestic_ai_selection)
        select figure_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', 1 + (strpos('0123456789abcdef', substr(h, 17, 1)) - 1) % 4, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) id from h""",
    "q_fingerprint": "select doc_id, sha256(coalesce(source, '') || '|' || coalesce(lang, '') || '|' || coalesce(text, '')) fingerprint from documents",
    "q_paths": r"""select distinct page_id, case when regexp_matches(replace(image_path, '\', '/'), '(^|/)(\.{0,2})(/|$)') or contains(image_path, ':') then null else replace(image_path, '\', '/') end path,
        cast(nullif(regexp_extract(page_id, '-p(\d+)$', 1), '') as int) page_no from page_inventory where image_path is not null""",
}
