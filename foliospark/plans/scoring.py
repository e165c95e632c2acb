"""Queries on vectors and scores: spaces, exact neighbours, set similarities, evidence, uncertainty, fusion, methods."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.functions import score as S
from foliospark.operators import bm25, metrics, search, similarity, vectors
from foliospark.operators.integrity import first_of
from foliospark.plans.lexical import _BM25, EVERY, FIGURE_NO, query_figures
from foliospark.session import checkpoint, table


def _r(x, n: int = 6):
    return F.round(x, n)


def q_vector_states(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "vector_results")
    return v.groupBy("entity_type", "modality", vectors.vector_state(F.col("vector"), F.col("dimension")).alias("state")).agg(F.count("*").alias("n"))


def q_space_filter(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of the largest space of each modality, the last of each entity."""
    v = vectors.latest_vectors(table(spark, d, "vector_results").where("vector is not null"))
    sizes = v.groupBy("modality", *vectors.SPACE).agg(F.count("*").alias("n"))
    active = first_of(sizes, ["modality"], [-F.col("n"), F.col("preprocessing_hash")])
    return vectors.in_active_space(v, active).select("vec_id", "entity_id", "modality")


def _unit(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", F.lit(0).alias("space"), F.col("embedding").alias("vector"), "label")


def q_cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    """Exact neighbours of every vector whose id is divisible by EVERY, against all rows."""
    v = _unit(spark, d)
    near = vectors.exact_top_k(v.where(F.col("vec_id") % EVERY == 0), v, 10)
    return near.select("query_id", "vec_id", "rank", _r("cosine").alias("cosine"))


def q_cosine_pairs(spark: SparkSession, d: str) -> DataFrame:
    """The cosine function on pairs of rows: each vector and the next by id."""
    v = _unit(spark, d)
    nxt = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("vector").alias("other"))
    c = S.cosine(F.col("vector"), F.col("other"))
    return v.join(nxt, "vec_id").select("vec_id", _r(c).alias("cosine"), _r(S.cosine_to_unit(c)).alias("unit"))


def q_best_regions(spark: SparkSession, d: str) -> DataFrame:
    """Labels as figures, vectors as their regions: the best three of each figure for every query."""
    v = _unit(spark, d)
    q = v.where(F.col("vec_id") % EVERY == 0)
    near = vectors.exact_top_k(q, v, 3, group="label").select("query_id", F.col("group").alias("figure_id"), F.col("vec_id").alias("region_id"), _r("cosine").alias("score"))
    return vectors.best_regions(near).select("query_id", "figure_id", "sr", F.array_join(F.transform("regions", lambda x: x.cast("string")), ",").alias("regions"))


def q_rank_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Recall, reciprocal rank and nDCG of the neighbours, those of the same label being relevant."""
    v = _unit(spark, d)
    q = v.where(F.col("vec_id") % EVERY == 0)
    near = vectors.exact_top_k(q, v, 10).select("query_id", F.col("vec_id").alias("doc_id"), "rank")
    relevant = q.select(F.col("vec_id").alias("query_id"), "label").join(v.select(F.col("vec_id").alias("doc_id"), "label"), "label").where("query_id <> doc_id").select("query_id", "doc_id")
    m = metrics.rank_metrics(near, relevant)
    return m.select("query_id", "n_relevant", *[_r(c).alias(c) for c in ("recall", "rr", "ndcg")])


def q_hashed_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Signed feature hashing of every document."""
    return vectors.hashed_text_vectors(table(spark, d, "documents"))


def _number(c: str = "figure_key"):
    return F.regexp_extract(c, FIGURE_NO, 1).try_cast("bigint")


def function_rows(spark: SparkSession, d: str) -> DataFrame:
    """(figure_key, slot, concept, weight): 0.5 and 0.1 for each support, of known concepts."""
    f = table(spark, d, "domestic_functions").select("figure_key", F.explode("functions").alias("f"))
    return f.where("f.concept <> 'unknown'").select("figure_key", "f.slot", "f.concept", (0.5 + 0.1 * F.size("f.supports")).alias("weight"))


def q_function_jaccard(spark: SparkSession, d: str) -> DataFrame:
    """Figures of the query set against all figures by weighted functions, the ten best."""
    keys = ["slot", "concept"]
    rows = similarity.key_weights(function_rows(spark, d), "figure_key", keys, "weight")
    q = rows.where(_number() % EVERY == 0).withColumnRenamed("figure_key", "query_id")
    pairs = similarity.weighted_jaccard(q, rows.withColumnRenamed("figure_key", "doc_id"), keys).where("query_id <> doc_id")
    return bm25.top_k(pairs, 10).select("query_id", "doc_id", _r("score").alias("score"), "n_matched", "rank")


def q_graph_jaccard(spark: SparkSession, d: str) -> DataFrame:
    """Relations of confidence 0.7 or more: suppliers as figures, their items as edges, less sure the larger the discount.
    Suppliers divisible by EVERY against all, the ten best."""
    keys = ["subject", "predicate", "object"]
    rows = table(spark, d, "lineitem").select("l_suppkey", F.col("l_returnflag").alias("subject"), F.col("l_linenumber").alias("predicate"), F.col("l_quantity").alias("object"), (1 - 4 * F.col("l_discount")).alias("c"))
    w = similarity.key_weights(rows, "l_suppkey", keys, "c", at_least=0.7)
    q = w.where(F.col("l_suppkey") % EVERY == 0).withColumnRenamed("l_suppkey", "query_id")
    best = similarity.best_jaccard(q, w.withColumnRenamed("l_suppkey", "doc_id"), keys, 10)
    return best.select("query_id", "doc_id", _r("score").alias("score"), "n_query", "n_candidate", "n_matched", "rank")


def q_set_jaccard(spark: SparkSession, d: str) -> DataFrame:
    """Functions of a figure in both tables as plain sets, and how far drafts with support cover the functions."""
    key = lambda c: F.transform(c, lambda x: F.concat_ws("/", x["slot"], x["concept"]))
    known = lambda c: F.filter(c, lambda x: x["concept"] != "unknown")
    a = first_of(table(spark, d, "domestic_functions").select("figure_key", "functions", "arrived_at"), ["figure_key"], ["arrived_at"])
    b = first_of(table(spark, d, "competition_evidence_links").select("figure_id", "functional_drafts", "arrived_at"), ["figure_id"], ["arrived_at"])
    pairs = a.join(b, a["figure_key"] == b["figure_id"]).select("figure_key", key(known("functions")).alias("x"), key(known("functional_drafts")).alias("y"), key(F.filter("functional_drafts", lambda f: F.size(f["supports"]) > 0)).alias("z"))
    return pairs.select("figure_key", _r(similarity.set_jaccard(F.col("x"), F.col("y"))).alias("jaccard"), _r(similarity.function_coverage(F.col("x"), F.col("z"))).alias("covered"))


def q_evidence_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Labels of the query figures' functions as claims, labels of regions as evidence."""
    f = table(spark, d, "domestic_functions").where(_number() % EVERY == 0).select(F.col("figure_key").alias("query_id"), F.explode(F.array_compact("functions.label")).alias("label"))
    f = f.select("query_id", F.explode(F.split("label", " ")).alias("claim"))
    regions = table(spark, d, "regions").select(F.col("figure_id").alias("doc_id"), F.col("label").alias("value"), F.col("evidence_state").alias("state"))
    return similarity.evidence_coverage(f, regions).select("query_id", "doc_id", _r("coverage").alias("coverage"))


def q_uncertainty(spark: SparkSession, d: str) -> DataFrame:
    """Entropy and model uncertainty of each user's values."""
    values = table(spark, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_list("value")).alias("v"))
    return values.select("user_id", _r(S.entropy(F.col("v"))).alias("entropy"), _r(S.model_uncertainty(F.transform("v", lambda x: x / 100))).alias("uncertainty"))


def q_missingness(spark: SparkSession, d: str) -> DataFrame:
    """Share of a figure's materials that are missing: title, regions, functions."""
    figures = table(spark, d, "domestic_ai_selection").groupBy("figure_id").agg(F.max(F.col("title").isNotNull()).alias("titled"))
    regions = table(spark, d, "regions").select("figure_id").distinct().withColumn("r", F.lit(True))
    functions = table(spark, d, "domestic_functions").select(F.col("figure_key").alias("figure_id")).distinct().withColumn("f", F.lit(True))
    lacks = (~F.col("titled")).cast("int") + F.col("r").isNull().cast("int") + F.col("f").isNull().cast("int")
    return figures.join(regions, "figure_id", "left").join(functions, "figure_id", "left").select("figure_id", _r(lacks / 3).alias("missing"))


def _components() -> dict:
    return {
        "sv": F.when(F.col("l_returnflag") != "R", F.col("l_discount") * 12),
        "st": F.col("l_tax") * 10,
        "sr": F.when(F.col("l_linestatus") == "F", F.col("l_quantity") / 50),
        "sf": F.when(F.col("l_tax") > 0, F.col("l_discount") * 8),
        "se": F.when(F.col("l_linenumber") > 1, F.col("l_tax") * 8),
        "u": F.when(F.col("l_discount") > 0, F.col("l_discount") * 10),
    }


def q_fusion(spark: SparkSession, d: str) -> DataFrame:
    """Fused score of every line item, its columns being components of which some are missing."""
    f = S.fuse(_components(), reliability={"sf": F.lit(0.5)}, available={"st": F.col("l_tax") != 0.01})
    out = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", f.alias("f"))
    return out.select("l_orderkey", "l_linenumber", _r("f.score").alias("score"), F.array_join("f.missing", ",").alias("missing"))


def _latest(spark: SparkSession, d: str, entity: str, modality: str) -> DataFrame:
    """(entity_id, v) of the neural space: the last usable vector of each entity."""
    v = table(spark, d, "vector_results").where((F.col("entity_type") == entity) & (F.col("modality") == modality) & (F.col("provider") == "neural"))
    v = v.where(vectors.vector_state(F.col("vector"), F.col("dimension")) == "usable")
    return vectors.latest_vectors(v).select("entity_id", F.col("vector").alias("v"))


def _relations(spark: SparkSession, d: str) -> DataFrame:
    """(figure_key, subject, predicate, object, c): edges of a figure, less sure without a rationale."""
    r = table(spark, d, "domestic_functions").select("figure_key", F.explode("relations").alias("r"))
    return r.select("figure_key", *[F.lower(F.trim(f"r.{x}")).alias(x) for x in ("subject", "predicate", "object")], F.when(F.col("r.rationale").isNotNull(), 1.0).otherwise(0.7).alias("c"))


def _search(spark: SparkSession, d: str, kinds: bool, methods=None, reliability=None) -> DataFrame:
    """Titles and pictures of the query figures against all figures, by every component; a figure doesn't find itself.
    ``kinds``: every second query is of a picture alone."""
    figures = table(spark, d, "domestic_ai_selection").groupBy(F.col("figure_id").alias("doc_id")).agg(F.min(F.concat_ws(" ", "title", "description")).alias("text"))
    is_text = (F.regexp_extract("query_id", FIGURE_NO, 1).try_cast("bigint") / EVERY) % 2 == 0 if kinds else F.lit(True)
    q = checkpoint(query_figures(spark, d).withColumn("kind", F.when(is_text, "text").otherwise("image")))
    said, asked = q.where("kind = 'text'").select("query_id", "text"), F.broadcast(q.select("query_id"))

    def both(rows: DataFrame, key: str = "figure_key") -> tuple[DataFrame, DataFrame]:
        return rows.withColumnRenamed(key, "query_id").join(asked, "query_id", "left_semi"), rows.withColumnRenamed(key, "doc_id")

    functions = checkpoint(similarity.key_weights(function_rows(spark, d), "figure_key", ["slot", "concept"], "weight"))
    edges = checkpoint(similarity.key_weights(_relations(spark, d), "figure_key", ["subject", "predicate", "object"], "c", at_least=0.7))
    links = first_of(table(spark, d, "competition_evidence_links").select("figure_id", "functional_drafts", "arrived_at"), ["figure_id"], ["arrived_at"])
    drafts = links.select("figure_id", F.explode("functional_drafts").alias("f")).where("f.concept <> 'unknown'")
    drafts = checkpoint(drafts.groupBy("figure_id", "f.slot", "f.concept").agg(F.max(F.size("f.supports") > 0).alias("supported")))
    regions = table(spark, d, "regions").select(F.col("figure_id").alias("doc_id"), F.col("label").alias("value"), F.col("evidence_state").alias("state"))
    parts = {
        "lexical": search.lexical_component(figures, said, 10, normalise=False, own=False).select("query_id", "doc_id", F.col("normalised").alias("value")),
        "sf": similarity.weighted_jaccard(*both(functions), ["slot", "concept"]).select("query_id", "doc_id", F.col("score").alias("value")),
        "sg": similarity.weighted_jaccard(*both(edges), ["subject", "predicate", "object"]).select("query_id", "doc_id", F.col("score").alias("value")),
        "se": similarity.evidence_coverage(said.withColumnRenamed("text", "claim"), regions).withColumnRenamed("coverage", "value"),
    }
    overlap = checkpoint(similarity.draft_overlap(*both(drafts, "figure_id")))
    parts |= {"draft_sf": overlap.select("query_id", "doc_id", F.col("jaccard").alias("value")), "draft_se": overlap.select("query_id", "doc_id", F.col("covered").alias("value"))}
    pairs = reduce(DataFrame.unionByName, [v.select("query_id", "doc_id", F.lit(k).alias("part"), "value") for k, v in parts.items()])

    def has(df: DataFrame, key: str, name: str) -> DataFrame:
        return df.select(F.col(key).alias("doc_id")).distinct().withColumn(name, F.lit(True))

    known = figures.select("doc_id")
    for df, key, name in ((functions, "figure_key", "f"), (edges, "figure_key", "g"), (drafts, "figure_id", "d")):
        known = known.join(has(df, key, name), "doc_id", "left")
    texts, images = (_latest(spark, d, "figure", m).select(F.col("entity_id").alias("doc_id"), F.col("v").alias(f"{m}_vector")) for m in ("text", "image"))
    parts_of = table(spark, d, "regions").select("region_id", F.col("figure_id").alias("doc_id")).distinct()
    parts_of = parts_of.join(_latest(spark, d, "region", "image").withColumnRenamed("entity_id", "region_id"), "region_id", "left")
    parts_of = parts_of.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("region_id", F.col("v").alias("vector")))).alias("regions"))
    unsure = function_rows(spark, d).groupBy(F.col("figure_key").alias("doc_id")).agg(S.model_uncertainty(F.array_sort(F.collect_list("weight"))).alias("u"))
    yes = {n: F.coalesce(n, F.lit(False)) for n in "fgd"}
    mine = F.create_map(F.lit("sf"), yes["f"], F.lit("sg"), yes["g"], F.lit("draft_sf"), yes["d"], F.lit("draft_se"), yes["d"])
    all_ = known.select("doc_id", mine.alias("has")).join(texts, "doc_id", "left").join(images, "doc_id", "left")
    all_ = checkpoint(all_.join(parts_of, "doc_id", "left").join(unsure, "doc_id", "left"))
    spoken = F.col("kind") == "text"
    words = F.create_map(F.lit("lexical"), spoken, F.lit("se"), spoken & (F.trim("text") != ""))
    queries = q.join(all_.select(F.col("doc_id").alias("query_id"), "has", "text_vector", "image_vector"), "query_id", "left").select(
        "query_id", "kind", F.col("query_id").alias("source_id"), F.when(spoken, F.col("text_vector")).alias("text_vector"), "image_vector",
        F.map_concat(words, F.coalesce("has", F.create_map().cast("map<string, boolean>"))).alias("has"),
    )
    return search.ranked_candidates(queries, all_, pairs, 10, methods, reliability)


def q_search_e2e(spark: SparkSession, d: str) -> DataFrame:
    """The ten best figures for every query figure: words and text vectors, pictures, regions, functions, relations,
    evidence and uncertainty, fused; what is missing; and the regions that match best."""
    top = _search(spark, d, False)
    return top.select(
        "query_id", "doc_id", "rank", _r("score").alias("score"), *[_r(c).alias(c) for c in ("sv", "st", "sr", "sf", "sg", "se", "u")],
        F.array_join(search.missing_parts(), ",").alias("missing"), F.array_join("regions", ",").alias("regions"),
    )


def q_methods_grid(spark: SparkSession, d: str) -> DataFrame:
    """The ten best of each query by every method that is applicable to its kind, over the same features."""
    top = _search(spark, d, True, search.METHODS, search.RELIABILITY)
    return top.select("query_id", "method", "doc_id", "rank", _r("score").alias("score"), "has_signal")


def q_rank_changes(spark: SparkSession, d: str) -> DataFrame:
    some = {m: search.METHODS[m] for m in ("hybrid", "eafr_drafts")}
    return metrics.rank_changes(_search(spark, d, True, some, search.RELIABILITY), "hybrid", "eafr_drafts")


def q_method_summary(spark: SparkSession, d: str) -> DataFrame:
    """Runs of each recogniser by status, and their latencies."""
    status = F.when(F.col("status") == "failed", "failed").when(F.col("raw_text") == "", "not_applicable").otherwise("completed")
    runs = table(spark, d, "ocr_results").select(F.concat_ws("/", "model", "version").alias("method"), status.alias("status"), (F.col("review_state") == "reviewed").alias("repeat_stable"), F.array("latency_ms").alias("latencies"))
    m = metrics.method_summary(runs)
    return m.select("method", "completed", "failed", "not_applicable", "stable", *[_r(c).alias(c) for c in ("median_ms", "min_ms", "max_ms")])


QUERIES = {f.__name__: f for f in (
    q_vector_states, q_space_filter, q_cosine_topk, q_cosine_pairs, q_best_regions, q_rank_metrics, q_hashed_vectors, q_function_jaccard, q_graph_jaccard,
    q_set_jaccard, q_evidence_coverage, q_uncertainty, q_missingness, q_fusion, q_methods_grid, q_rank_changes, q_method_summary, q_search_e2e,
)}

_NO = "cast(nullif(regexp_extract({}, '" + FIGURE_NO + "', 1), '') as bigint)"
_SPACES = "provider, model, version, dimension, preprocessing_hash"
_COS = f"""e as (select vec_id, label, list_transform(embedding, lambda x: x::double) v from embeddings),
near as (select q.vec_id query_id, e.vec_id, e.label, round(list_cosine_similarity(q.v, e.v), 9) c from e q cross join e where q.vec_id % {EVERY} = 0 and q.vec_id <> e.vec_id),
top as (select *, row_number() over (partition by query_id order by c desc, vec_id) "rank" from near)"""
_FUNCTIONS = """f as (select figure_key, unnest(functions) f from domestic_functions),
w as (select figure_key, f.slot slot, f.concept concept, max(least(1.0, 0.5 + 0.1 * len(f.supports)))::double w from f where f.concept <> 'unknown' group by 1, 2, 3)"""


def _jaccard(keys: str, query: str, pick: str) -> str:
    return f"""s as (select figure_key, sum(w) s, count(*) n from w group by 1),
    m as (select q.figure_key query_id, c.figure_key doc_id, sum(least(q.w, c.w)) low, count(*) n_matched from w q join w c using ({keys}) where {query} group by 1, 2),
    j as (select query_id, doc_id, low / (a.s + b.s - low) score, a.n n_query, b.n n_candidate, n_matched from m join s a on a.figure_key = query_id join s b on b.figure_key = doc_id)
    {pick}"""


_PARTS = """c as (select *, case when l_returnflag <> 'R' then l_discount * 12 end sv, l_tax * 10 st, case when l_linestatus = 'F' then l_quantity / 50 end sr,
  case when l_tax > 0 then l_discount * 8 end sf, case when l_linenumber > 1 then l_tax * 8 end se, case when l_discount > 0 then l_discount * 10 end u from lineitem)"""
_CLIP = "case when {0} is not null then greatest(0.0, least(1.0, {0})) end"
_SPOKEN = "cast(nullif(regexp_extract(query_id, '" + FIGURE_NO + f"', 1), '') as bigint) // {EVERY} % 2 = 0"
_VECTORS = """lv as (select * from (select *, row_number() over (partition by entity_type, entity_id, modality, preprocessing_hash order by arrived_at desc, vec_id desc) r from vector_results
  where provider = 'neural' and len(vector) = dimension and len(list_filter(vector, lambda x: not isfinite(x))) = 0 and len(list_filter(vector, lambda x: x <> 0)) > 0) where r = 1),
tv as (select entity_id, list_transform(vector, lambda x: x::double) v from lv where entity_type = 'figure' and modality = 'text'),
iv as (select entity_id, list_transform(vector, lambda x: x::double) v from lv where entity_type = 'figure' and modality = 'image'),
rv as (select distinct region_id, figure_id from regions),
rr as (select region_id, figure_id, list_transform(vector, lambda x: x::double) v from rv left join lv on entity_type = 'region' and modality = 'image' and entity_id = region_id)"""


def _features(spoken: str) -> str:
    """The components of every query and candidate."""
    unit = "case when {0} is not null and {1} is not null then (greatest(-1.0, least(1.0, list_cosine_similarity({0}, {1}))) + 1) / 2 end"
    return (
        _BM25.replace("{docs}", "select figure_id doc_id, min(concat_ws(' ', title, description)) \"text\" from domestic_ai_selection group by 1").rstrip()
        + f""", lx as (select query_id, doc_id, raw / max(raw) over (partition by query_id) v from (select *, row_number() over (partition by query_id order by score desc, doc_id) k from top where query_id <> doc_id) where k <= 50 and {spoken}),
  {_FUNCTIONS}, fs as (select figure_key, sum(w) s from w group by 1),
  fm as (select a.figure_key query_id, b.figure_key doc_id, sum(least(a.w, b.w)) low from w a join w b using (slot, concept) where a.figure_key in (select query_id from q) group by 1, 2),
  sf as (select query_id, doc_id, low / (a.s + b.s - low) v from fm join fs a on a.figure_key = query_id join fs b on b.figure_key = doc_id),
  rl as (select figure_key, unnest(relations) r from domestic_functions),
  gw as (select figure_key, lower(trim(r.subject)) s1, lower(trim(r.predicate)) p1, lower(trim(r.object)) o1, max(case when r.rationale is null then 0.7 else 1.0 end)::double w from rl group by 1, 2, 3, 4),
  gs as (select figure_key, sum(w) s from gw group by 1),
  gm as (select a.figure_key query_id, b.figure_key doc_id, sum(least(a.w, b.w)) low from gw a join gw b using (s1, p1, o1) where a.figure_key in (select query_id from q) group by 1, 2),
  sg as (select query_id, doc_id, low / (a.s + b.s - low) v from gm join gs a on a.figure_key = query_id join gs b on b.figure_key = doc_id),
  ev as (select figure_id doc_id, lower(trim("label")) "value", max(case lower(evidence_state) when 'verified' then 1.0 when 'documented' then 0.9 when 'observed' then 0.8 else 0.5 end)::double w from regions where trim("label") <> '' group by 1, 2),
  cl as (select query_id, lower(trim("text")) claim from q where trim("text") <> '' and {spoken}),
  se as (select query_id, doc_id, max(w) v from cl join ev on contains("value", claim) or contains(claim, "value") group by 1, 2),
  dl as (select figure_id, arg_min(functional_drafts, arrived_at) g from competition_evidence_links group by 1), du as (select figure_id, unnest(g) t from dl),
  dk as (select figure_id, t.slot slot, t.concept concept, max(len(t.supports) > 0) supported from du where t.concept <> 'unknown' group by 1, 2, 3), dn as (select figure_id, count(*) n from dk group by 1),
  dm as (select a.figure_id query_id, b.figure_id doc_id, count(*) both_, count_if(b.supported) held from dk a join dk b using (slot, concept) where a.figure_id in (select query_id from q) group by 1, 2),
  {_VECTORS},
  ul as (select figure_key, 0.5 + 0.1 * len(f.supports) w from f where f.concept <> 'unknown'), um as (select figure_key, max(w) m, count(*) n from ul group by 1),
  uz as (select figure_key, any_value(n) n, any_value(m) m, sum(exp(greatest(-60, least(60, w - m)))) z from ul join um using (figure_key) group by 1),
  uu as (select figure_key, case when any_value(n) <= 1 then 0.0 else greatest(0, least(1, -sum(exp(w - m) / z * ln(exp(w - m) / z)) / ln(any_value(n)))) end u from ul join uz using (figure_key) group by 1),
  fig as (select distinct figure_id doc_id from domestic_ai_selection),
  base as (select q.query_id, fig.doc_id, {spoken} spoken from q cross join fig where q.query_id <> fig.doc_id),
  reg as (select b.query_id, b.doc_id, region_id, {unit.format('qi.v', 'rr.v')} s from base b join rr on rr.figure_id = b.doc_id left join iv qi on qi.entity_id = b.query_id),
  rk as (select *, row_number() over (partition by query_id, doc_id order by s desc nulls last, region_id) k from reg),
  rg as (select query_id, doc_id, max(s) sr, string_agg(region_id, ',' order by k) regions from rk where k <= 3 and (s is not null or (query_id, doc_id) not in (select (query_id, doc_id) from rk where s is not null)) group by 1, 2),
  ft as (select b.*, case when spoken then coalesce(lx.v, 0.0) end lexical, case when spoken then {unit.format('qt.v', 'ct.v')} end semantic, {unit.format('qi.v', 'ci.v')} sv, rg.sr, coalesce(rg.regions, '') regions,
    case when fa.s is not null and fb.s is not null then coalesce(sf.v, 0.0) end sf, case when ga.s is not null and gb.s is not null then coalesce(sg.v, 0.0) end sg, case when cl.claim is not null then coalesce(se.v, 0.0) end se,
    case when da.n is not null and db.n is not null then coalesce(both_ / (da.n + db.n - both_), 0.0) end draft_sf, case when da.n is not null then coalesce(0.5::double * held / da.n, 0.0) end draft_se, uu.u
    from base b left join lx using (query_id, doc_id) left join tv qt on qt.entity_id = b.query_id left join tv ct on ct.entity_id = b.doc_id left join iv qi on qi.entity_id = b.query_id left join iv ci on ci.entity_id = b.doc_id
    left join rg using (query_id, doc_id) left join sf using (query_id, doc_id) left join sg using (query_id, doc_id) left join se using (query_id, doc_id) left join cl on cl.query_id = b.query_id
    left join fs fa on fa.figure_key = b.query_id left join fs fb on fb.figure_key = b.doc_id left join gs ga on ga.figure_key = b.query_id left join gs gb on gb.figure_key = b.doc_id
    left join dm using (query_id, doc_id) left join dn da on da.figure_id = b.query_id left join dn db on db.figure_id = b.doc_id left join uu on uu.figure_key = b.doc_id),
  fx as (select *, 0.7::double * semantic + 0.3::double * coalesce(lexical, 0.0) st from ft)"""
    )


def _sum(weights: dict[str, float], reliability: dict[str, float]) -> str:
    return " + ".join(f"{w}::double * greatest(0.0, least(1.0, coalesce({c}, 0.0))) * {reliability.get(c, 1.0)}::double" for c, w in weights.items())


def _ranked(methods: dict[str, dict[str, float]]) -> str:
    rows = " union all ".join(
        f"select query_id, '{m}' \"method\", doc_id, {_sum(w, search.RELIABILITY)} score, {' or '.join(f'coalesce({c} > 0, false)' for c in w)} has_signal from fx" + (" where spoken" if m in search.TEXT_METHODS else "")
        for m, w in methods.items()
    )
    return _features(_SPOKEN) + f', g as ({rows}), r as (select *, row_number() over (partition by query_id, "method" order by round(score, 6) desc, doc_id) "rank" from g)'


_MISSING = ", ".join(f"case when {c} is null then '{n}' end" for c, n in S.NAMES.items())

SQL = {
    "q_vector_states": """select entity_type, modality, case when vector is null then 'missing' when len(vector) = 0 then 'empty' when len(vector) <> dimension then 'cut'
      when len(list_filter(vector, lambda x: x is null or not isfinite(x))) > 0 then 'not_finite' when len(list_filter(vector, lambda x: x <> 0)) = 0 then 'zero' else 'usable' end state, count(*) n
      from vector_results group by 1, 2, 3""",
    "q_space_filter": f"""with v as (select * from (select *, row_number() over (partition by entity_type, entity_id, modality, {_SPACES} order by arrived_at desc, vec_id desc) r from vector_results where vector is not null) where r = 1),
      a as (select * from (select modality, {_SPACES}, row_number() over (partition by modality order by count(*) desc, preprocessing_hash) r from v group by modality, {_SPACES}) where r = 1)
      select vec_id, entity_id, v.modality from v join a using (modality, {_SPACES}) where len(vector) = dimension""",
    "q_cosine_topk": f'with {_COS} select query_id, vec_id, "rank", round(c, 6) cosine from top where "rank" <= 10',
    "q_cosine_pairs": """with e as (select vec_id, list_transform(embedding, lambda x: x::double) v from embeddings)
      select a.vec_id, round(list_cosine_similarity(a.v, b.v), 6) cosine, round((list_cosine_similarity(a.v, b.v) + 1) / 2, 6) unit from e a join e b on b.vec_id = a.vec_id + 1""",
    "q_best_regions": f"""with {_COS}, r as (select query_id, label figure_id, vec_id, round(c, 6) score, row_number() over (partition by query_id, label order by round(c, 6) desc, vec_id) k from near)
      select query_id, figure_id, max(score) sr, string_agg(vec_id::varchar, ',' order by k) regions from r where k <= 3 group by 1, 2""",
    "q_rank_metrics": f"""with {_COS}, q as (select vec_id, label from e where vec_id % {EVERY} = 0),
      n as (select query_id, count(*) n_relevant from near join q on q.vec_id = query_id where near.label = q.label group by 1),
      h as (select query_id, count(*) hits, min("rank") fst, sum(1 / log2("rank" + 1)) dcg from top join q on q.vec_id = query_id where top.label = q.label and "rank" <= 10 group by 1)
      select q.vec_id query_id, coalesce(n_relevant, 0) n_relevant, round(case when n_relevant > 0 then coalesce(hits, 0) / n_relevant end, 6) recall, round(case when n_relevant > 0 then coalesce(1 / fst, 0) end, 6) rr,
      round(case when n_relevant > 0 then coalesce(dcg, 0) / (select sum(1 / log2(i + 1)) from range(1, 11) t(i) where i <= n_relevant) end, 6) ndcg
      from q left join n on n.query_id = q.vec_id left join h on h.query_id = q.vec_id""",
    "q_function_jaccard": f"with {_FUNCTIONS}, " + _jaccard("slot, concept", f"{_NO.format('q.figure_key')} % {EVERY} = 0 and q.figure_key <> c.figure_key",
      'select query_id, doc_id, round(score, 6) score, n_matched, "rank" from (select *, row_number() over (partition by query_id order by round(score, 6) desc, doc_id) "rank" from j) where "rank" <= 10'),
    "q_graph_jaccard": f"""with w as (select l_suppkey figure_key, l_returnflag s1, l_linenumber p1, l_quantity o1, max(greatest(0, least(1, 1 - 4 * l_discount)))::double w from lineitem where 1 - 4 * l_discount >= 0.7 group by 1, 2, 3, 4), """
    + _jaccard("s1, p1, o1", f"q.figure_key % {EVERY} = 0 and q.figure_key <> c.figure_key",
      'select query_id, doc_id, round(score, 6) score, n_query, n_candidate, n_matched, "rank" from (select *, row_number() over (partition by query_id order by round(score, 6) desc, doc_id) "rank" from j) where "rank" <= 10'),
    "q_set_jaccard": """with a as (select figure_key, arg_min(functions, arrived_at) f from domestic_functions group by 1), b as (select figure_id, arg_min(functional_drafts, arrived_at) g from competition_evidence_links group by 1),
      x as (select distinct figure_key, t.slot || '/' || t.concept k from (select figure_key, unnest(f) t from a) where t.concept <> 'unknown'),
      y as (select distinct figure_id figure_key, t.slot || '/' || t.concept k from (select figure_id, unnest(g) t from b) where t.concept <> 'unknown'),
      z as (select distinct figure_id figure_key, t.slot || '/' || t.concept k from (select figure_id, unnest(g) t from b) where len(t.supports) > 0),
      p as (select figure_key, (select count(*) from x where x.figure_key = a.figure_key) nx, (select count(*) from y where y.figure_key = a.figure_key) ny,
        (select count(*) from x join y using (figure_key, k) where figure_key = a.figure_key) xy, (select count(*) from x join z using (figure_key, k) where figure_key = a.figure_key) xz from a join b on b.figure_id = a.figure_key)
      select figure_key, round(case when nx > 0 and ny > 0 then xy / (nx + ny - xy) end, 6) jaccard, round(case when nx > 0 then 0.5::double * xz / nx end, 6) covered from p""",
    "q_evidence_coverage": f"""with c as (select distinct query_id, lower(trim(claim)) claim from (select figure_key query_id, unnest(flatten(list_transform(list_filter(functions, lambda f: f.label is not null), lambda f: string_split(f.label, ' ')))) claim from domestic_functions where {_NO.format('figure_key')} % {EVERY} = 0) where trim(claim) <> ''),
      v as (select figure_id doc_id, lower(trim(label)) "value", max(case lower(evidence_state) when 'verified' then 1.0 when 'documented' then 0.9 when 'observed' then 0.8 else 0.5 end)::double w from regions where trim(label) <> '' group by 1, 2),
      m as (select query_id, doc_id, claim, max(w) w from c join v on contains("value", claim) or contains(claim, "value") group by 1, 2, 3)
      select query_id, doc_id, round(sum(w) / (select count(*) from c where c.query_id = m.query_id), 6) coverage from m group by 1, 2""",
    "q_uncertainty": """with t as (select user_id, sum(greatest("value", 0)) s, count(*) n, max("value" / 100) m from events group by 1),
      x as (select e.user_id, any_value(n) n, -sum(case when "value" > 0 then "value" / s * ln("value" / s) else 0 end) h, sum(exp(greatest(-60, least(60, "value" / 100 - m)))) z from events e join t using (user_id) group by 1),
      y as (select e.user_id, -sum(exp("value" / 100 - m) / z * ln(exp("value" / 100 - m) / z)) h2 from events e join t using (user_id) join x using (user_id) group by 1)
      select user_id, round(case when n <= 1 then 0.0 else greatest(0, least(1, h / ln(n))) end, 6) entropy, round(case when n <= 1 then 0.0 else greatest(0, least(1, h2 / ln(n))) end, 6) uncertainty from x join y using (user_id)""",
    "q_missingness": """select figure_id, round(((count(title) = 0)::int + (figure_id not in (select figure_id from regions))::int + (figure_id not in (select figure_key from domestic_functions))::int) / 3, 6) "missing"
      from domestic_ai_selection group by 1""",
    "q_fusion": "with " + _PARTS + f""", d as (select *, case when l_tax = 0.01 then null else st end st2 from c)
      select l_orderkey, l_linenumber, round(coalesce(0.25::double * {_CLIP.format('sv')}, 0) + coalesce(0.25::double * {_CLIP.format('st2')}, 0) + coalesce(0.2::double * {_CLIP.format('sr')}, 0) + coalesce(0.2::double * {_CLIP.format('sf')} * 0.5::double, 0)
      + coalesce(0.1::double * {_CLIP.format('se')}, 0) - coalesce(0.05::double * {_CLIP.format('u')}, 0), 6) score,
      concat_ws(',', case when sv is null then 'visual' end, case when st2 is null then 'text' end, case when sr is null then 'region' end, case when sf is null then 'function' end, 'graph', case when se is null then 'evidence' end, case when u is null then 'model_uncertainty' end) "missing" from d""",
    "q_methods_grid": _ranked(search.METHODS) + 'select query_id, "method", doc_id, "rank", round(score, 6) score, has_signal from r where "rank" <= 10',
    "q_rank_changes": _ranked({m: search.METHODS[m] for m in ("hybrid", "eafr_drafts")}) + """, l as (select query_id, "method", list(doc_id order by "rank") docs from r where "rank" <= 10 group by 1, 2)
      select a.query_id, a.docs[1] <> b.docs[1] top1_changed, a.docs <> b.docs order_changed from l a join l b on a.query_id = b.query_id where a."method" = 'hybrid' and b."method" = 'eafr_drafts'""",
    "q_search_e2e": _features("true") + f""", g as (select *, {_sum(search.METHODS['eafr_current'], {})} score from fx), r as (select *, row_number() over (partition by query_id order by round(score, 6) desc, doc_id) "rank" from g)
      select query_id, doc_id, "rank", round(score, 6) score, round(sv, 6) sv, round(st, 6) st, round(sr, 6) sr, round(sf, 6) sf, round(sg, 6) sg, round(se, 6) se, round(u, 6) u, concat_ws(',', {_MISSING}) "missing", regions from r where "rank" <= 10""",
    "q_method_summary": """select model || '/' || version "method", count_if(status <> 'failed' and (raw_text is null or raw_text <> '')) completed, count_if(status = 'failed') failed, count_if(status <> 'failed' and raw_text = '') not_applicable,
      count_if(review_state = 'reviewed') stable, round(median(latency_ms), 6) median_ms, round(min(latency_ms), 6) min_ms, round(max(latency_ms), 6) max_ms from ocr_results group by 1""",
}
