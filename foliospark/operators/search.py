"""Batch search: a table of queries against the catalogue, components fused and ranked in one plan."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.functions.geometry import bbox_valid
from foliospark.functions.score import NAMES, clip, cosine_to_unit
from foliospark.operators.bm25 import bm25_scores, max_normalised, top_k
from foliospark.session import bounded_broadcast, checkpoint

#: Scores of text: the share of the vectors' similarity, the rest being that of words.
VECTOR_SHARE = 0.7


def figure_text(figures: DataFrame, chunks: DataFrame) -> DataFrame:
    """(figure_id, text): title and each chunk's corrected text, or else its text, in order, joined by a space. Empty
    parts are left out. ``figures``: figure_id, title; ``chunks``: figure_id, ordinal, text, corrected_text."""
    part = F.coalesce(F.nullif(F.trim("corrected_text"), F.lit("")), F.nullif(F.trim("text"), F.lit("")))
    parts = chunks.groupBy("figure_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", part.alias("t")))).alias("p"))
    title = F.nullif(F.trim("title"), F.lit(""))
    return figures.join(parts, "figure_id", "left").select(
        "figure_id", F.trim(F.array_join(F.array_compact(F.concat(F.array(title), F.coalesce(F.transform("p", lambda x: x["t"]), F.array().cast("array<string>")))), " ")).alias("text")
    )


def search_filters(df: DataFrame, defaults: dict[str, str] | None = None, **lists: list[str] | None) -> DataFrame:
    """Rows whose columns are among the given values; an empty or missing list filters nothing. ``defaults``: what a null
    of a column counts as."""
    names = defaults or {}

    def column(k: str) -> Column:
        return F.coalesce(F.col(k), F.lit(names[k])) if k in names else F.col(k)

    return df.where(reduce(lambda a, b: a & b, [column(k).isin(*v) for k, v in lists.items() if v], F.lit(True)))


def among(df: DataFrame, column: str, wanted: DataFrame) -> DataFrame:
    """Rows whose ``column`` is among the one of ``wanted`` of that name: unlike search_filters, an empty list keeps no row."""
    return df.join(bounded_broadcast(wanted.select(column).distinct()), column, "left_semi")


#: Bounds of a request: characters of a query's text, results asked for, entries of a filter list.
QUERY_CHARS, MOST_RESULTS, FILTER_ENTRIES = 1000, 50, 50


def request_problems(requests: DataFrame) -> DataFrame:
    """(query_id, problem) of requests that break a bound. ``requests``: query_id, kind (text, image, region), text, top_k,
    page_id, figure_id, bbox, filters ARRAY<ARRAY<STRING>>. Text requests have a text and no place; region requests have a
    box and a page or a figure, not both; image requests have neither text nor box."""
    kind, text = F.col("kind"), F.trim(F.coalesce("text", F.lit("")))
    placed = F.col("page_id").isNotNull().cast("int") + F.col("figure_id").isNotNull().cast("int")
    problems = F.array(
        F.when(~kind.isin("text", "image", "region") | kind.isNull(), "kind"),
        F.when((kind == "text") & ((text == "") | (F.length("text") > QUERY_CHARS)), "text"),
        F.when((kind != "text") & (text != ""), "text_with_picture"),
        F.when(F.col("top_k").isNull() | ~F.col("top_k").between(1, MOST_RESULTS), "top_k"),
        F.when((kind == "region") & (placed != 1), "place"),
        F.when((kind == "region") & ~bbox_valid(F.col("bbox")), "bbox"),
        F.when((kind != "region") & F.col("bbox").isNotNull(), "bbox_without_region"),
        F.when(F.exists(F.coalesce("filters", F.array().cast("array<array<string>>")), lambda x: F.size(x) > FILTER_ENTRIES), "filters"),
    )
    return requests.select("query_id", F.explode(F.array_compact(problems)).alias("problem"))


def text_score(vector_cosine: Column, lexical: Column, cross_cosine: Column | None = None) -> Column:
    """Text component: vectors and words where there is a text vector; else the similarity of the query's image to the
    text; else null. ``lexical`` is a normalised score, null as 0."""
    own = VECTOR_SHARE * cosine_to_unit(vector_cosine) + (1 - VECTOR_SHARE) * clip(lexical)
    other = F.lit(None).cast("double") if cross_cosine is None else F.when(cross_cosine.isNotNull(), cosine_to_unit(cross_cosine))
    return F.when(vector_cosine.isNotNull(), own).otherwise(other)


def visual_score(image_cosine: Column, text_to_image_cosine: Column | None = None) -> Column:
    """Visual component: image against image, else the query's text against the image, else null."""
    other = F.lit(None).cast("double") if text_to_image_cosine is None else F.when(text_to_image_cosine.isNotNull(), cosine_to_unit(text_to_image_cosine))
    return F.when(image_cosine.isNotNull(), cosine_to_unit(image_cosine)).otherwise(other)


def lexical_component(docs: DataFrame, queries: DataFrame, k: int, id_: str = "doc_id", normalise: bool = True, own: bool = True) -> DataFrame:
    """(query_id, doc_id, normalised) of the best max(5 k, 50) documents of each query, over the query's best. ``own``
    False leaves out the document that has the query's own id."""
    scores = bm25_scores(docs, queries, id_=id_, normalise=normalise)
    scores = scores if own else scores.where("query_id <> doc_id")
    return max_normalised(top_k(scores, max(5 * k, 50))).select("query_id", "doc_id", "normalised")


# The compared methods and their coefficients; a component that is not named does not count. The three
# that stand alone are the normalised word score, the text vectors' and the images' similarity.
METHODS = {
    "bm25": {"lexical": 1.0},
    "bge": {"semantic": 1.0},
    "chinese_clip": {"sv": 1.0},
    "hybrid": {"sv": 0.25, "st": 0.25, "sr": 0.20},
    "hybrid_no_region": {"sv": 0.25, "st": 0.25},
    "eafr_current": {"sv": 0.25, "st": 0.25, "sr": 0.20, "sf": 0.20, "sg": 0.05, "se": 0.10, "u": -0.05},
    "eafr_drafts": {"sv": 0.25, "st": 0.25, "sr": 0.20, "draft_sf": 0.20, "draft_se": 0.10},
    "eafr_drafts_no_evidence": {"sv": 0.25, "st": 0.25, "sr": 0.20, "draft_sf": 0.20},
}
# Methods that need a text in the query, and the reliability of functions when methods are compared.
TEXT_METHODS = ("bm25", "bge")
RELIABILITY = {"sf": 0.5, "draft_sf": 0.5}


def applicable(method: Column, kind: Column) -> Column:
    """Whether a method can answer a query of a kind (text, image, region)."""
    return (kind == "text") | ~method.isin(*TEXT_METHODS)


#: Components that come from pairs (query_id, doc_id, part, value); a pair that is not there scores 0 where both sides
#: have what the part compares, and is missing where one lacks it.
PAIR_PARTS = ("lexical", "sf", "sg", "se", "draft_sf", "draft_se")
_COMPONENTS = ("lexical", "semantic", "sv", "st", "sr", "sf", "sg", "se", "draft_sf", "draft_se", "u")
#: Values of the query side that are sent to all executors at once, and cells of a product that are held at a time.
QUERY_VALUES, CELLS = 20_000_000, 500_000


def _unit_rows(vectors: list, dims: int) -> np.ndarray:
    """Vectors of unit length as rows; NaN for those that are missing, of another length, not finite or zero."""
    out = np.full((len(vectors), dims), np.nan)
    for i, v in enumerate(vectors):
        if v is not None and len(v) == dims:
            x = np.asarray(v, np.float64)
            if np.isfinite(x).all() and x.any():
                x = x / np.abs(x).max()
                out[i] = x / np.linalg.norm(x)
    return out


def _similar(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Cosines moved to [0, 1]; NaN where a side is missing."""
    s = np.nan_to_num(q) @ np.nan_to_num(c).T
    s[np.isnan(q[:, :1]).ravel()] = np.nan
    s[:, np.isnan(c[:, :1]).ravel()] = np.nan
    return (np.clip(s, -1, 1) + 1) / 2


def _scored(shared, k: int, methods: dict[str, dict[str, float]], reliability: dict[str, float], fields: list[str]):
    """Of each Arrow batch of candidates the k best for every query and method, the queries in slices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        queries, at, text_q, image_q = shared.value
        ids = np.array([q["query_id"] for q in queries], dtype=object)
        own = np.array([q["source_id"] for q in queries], dtype=object)
        is_text = np.array([q["kind"] == "text" for q in queries])
        for batch in batches:
            b = sorted(batch.to_pylist(), key=lambda r: str(r["doc_id"]))
            docs = np.array([r["doc_id"] for r in b], dtype=object)
            text_c, image_c = _unit_rows([r["text_vector"] for r in b], text_q.shape[1]), _unit_rows([r["image_vector"] for r in b], image_q.shape[1])
            regions = [(i, x["region_id"]) for i, r in enumerate(b) for x in r["regions"] or ()]
            region_c = _unit_rows([x["vector"] for r in b for x in r["regions"] or ()], image_q.shape[1])
            holds = np.array([i for i, _ in regions], int)
            # Places of the pair parts, as (part, query, candidate, value).
            sparse = [(x["part"], at[x["query_id"]], j, x["value"]) for j, r in enumerate(b) for x in r["pairs"] or () if x["query_id"] in at]
            u = np.array([np.nan if r["u"] is None else r["u"] for r in b], float)
            step = max(1, CELLS // max(len(b), len(regions), 1))
            for lo in range(0, len(queries), step):
                some = slice(lo, min(lo + step, len(queries)))
                n = some.stop - lo
                f = {}
                for part in PAIR_PARTS:
                    has_q = np.array([bool(q["has"].get(part)) for q in queries[some]])
                    has_c = np.ones(len(b), bool) if part in ("lexical", "se", "draft_se") else np.array([bool(dict(r["has"] or ()).get(part)) for r in b])
                    f[part] = np.where(has_q[:, None] & has_c[None, :], 0.0, np.nan)
                for part, i, j, value in sparse:
                    if lo <= i < some.stop and value is not None and not np.isnan(f[part][i - lo, j]):
                        f[part][i - lo, j] = value
                f["semantic"], f["sv"] = _similar(text_q[some], text_c), _similar(image_q[some], image_c)
                f["st"] = VECTOR_SHARE * f["semantic"] + (1 - VECTOR_SHARE) * np.nan_to_num(f["lexical"])
                f["sr"] = np.full((n, len(b)), np.nan)
                if len(regions):
                    near = _similar(image_q[some], region_c)
                    first = np.flatnonzero(np.append(True, holds[1:] != holds[:-1]))
                    best = np.fmax.reduceat(near, first, axis=1)
                    f["sr"][:, holds[first]] = best
                f["u"] = np.broadcast_to(u, (n, len(b)))
                others = docs[None, :] != own[some, None]
                for name, weights in methods.items():
                    score = np.zeros((n, len(b)))
                    for part, w in weights.items():
                        score += w * np.clip(np.nan_to_num(f[part]), 0, 1) * reliability.get(part, 1.0)
                    signal = np.zeros((n, len(b)), bool)
                    for part in weights:
                        signal |= np.nan_to_num(f[part]) > 0
                    asks = others & (is_text[some, None] | (name not in TEXT_METHODS))
                    order = np.argsort(np.where(asks, -np.round(score, 6), np.inf), axis=1, kind="stable")[:, :k]
                    i = np.repeat(np.arange(n), order.shape[1])
                    j = order.ravel()
                    keep = asks[i, j]
                    i, j = i[keep], j[keep]
                    if not len(i):
                        continue
                    out = {"query_id": ids[some][i], "doc_id": docs[j], "method": name, "score": score[i, j], "has_signal": signal[i, j]}
                    out |= {c: f[c][i, j] for c in _COMPONENTS}
                    if len(regions):
                        begin = dict(zip(holds[first].tolist(), zip(first.tolist(), [*first[1:].tolist(), len(holds)], strict=True), strict=True))
                        out["regions"] = [_best_regions(near[x], regions, *begin[y]) if y in begin else [] for x, y in zip(i.tolist(), j.tolist(), strict=True)]
                    else:
                        out["regions"] = [[]] * len(i)
                    yield pa.RecordBatch.from_pandas(pd.DataFrame(out)[fields], preserve_index=False)

    return run


def _best_regions(near: np.ndarray, regions: list, begin: int, end: int) -> list[str]:
    """The three regions of a candidate that are most similar; the first three by id where none can be compared."""
    mine = sorted((0.0 if np.isnan(near[x]) else -near[x], str(regions[x][1])) for x in range(begin, end) if not np.isnan(near[x]) or np.isnan(near[begin:end]).all())
    return [r for _, r in mine[:3]]


def ranked_candidates(
    queries: DataFrame,
    candidates: DataFrame,
    pairs: DataFrame,
    k: int,
    methods: dict[str, dict[str, float]] | None = None,
    reliability: dict[str, float] | None = None,
) -> DataFrame:
    """The k best candidates of every query by each method: query_id, doc_id, method, rank, score, has_signal, the
    components (null where missing) and the best regions' ids. Every candidate is scored for every query.

    ``queries``: query_id, kind (text, image), source_id (a candidate that is left out; null: none), text_vector,
    image_vector ARRAY<FLOAT>, has MAP<STRING, BOOLEAN> (pair parts that the query has anything for). ``candidates``: doc_id
    (unique), text_vector, image_vector, regions ARRAY<STRUCT<region_id, vector>>, has, u DOUBLE. Vectors of a column should be
    of one model space. ``pairs``: query_id, doc_id, part, value, each once. Ties (six places) go by doc_id as text.

    Queries, a stated set, go out in blocks of bounded size, each compared with all candidates as matrices; what pairs
    there are is grouped by candidate (at most a block's queries each). A batch of candidates hands on k rows a query and
    method, so that the product is never shuffled.
    """
    methods = methods or {"eafr_current": METHODS["eafr_current"]}
    spark, id_type = candidates.sparkSession, candidates.schema["doc_id"].dataType.simpleString()
    q_type = queries.schema["query_id"].dataType.simpleString()
    schema = f"query_id {q_type}, doc_id {id_type}, method string, score double, has_signal boolean, " + ", ".join(f"{c} double" for c in _COMPONENTS) + ", regions array<string>"
    fields = [x.split()[0] for x in schema.split(", ")]
    pairs, candidates = checkpoint(pairs.select("query_id", "doc_id", "part", "value")), checkpoint(candidates)

    def dims(df: DataFrame, column: str) -> int:
        row = df.where(F.size(column) > 0).select(F.size(column).alias("n")).first()
        return row["n"] if row else 1

    asked = checkpoint(queries)
    n_text, n_image = (dims(asked, c) for c in ("text_vector", "image_vector"))

    def search(block: list[dict]) -> DataFrame:
        text_q, image_q = (_unit_rows([q[c] for q in block], n) for c, n in (("text_vector", n_text), ("image_vector", n_image)))
        slim = [{c: q[c] for c in ("query_id", "kind", "source_id", "has")} for q in block]
        shared = spark.sparkContext.broadcast((slim, {q["query_id"]: i for i, q in enumerate(slim)}, text_q, image_q))
        of = pairs.join(F.broadcast(spark.createDataFrame([(q["query_id"],) for q in slim], f"query_id {q_type}")), "query_id", "left_semi")
        of = of.groupBy("doc_id").agg(F.collect_list(F.struct("query_id", "part", "value")).alias("pairs"))
        rows = candidates.select("doc_id", "text_vector", "image_vector", "regions", "has", "u").join(of, "doc_id", "left")
        return rows.mapInArrow(_scored(shared, k, methods, reliability or {}, fields), schema)

    found, block, size = [], [], 0
    for r in asked.orderBy("query_id").toLocalIterator():
        block.append(r.asDict(recursive=True) | {"has": dict(r["has"] or {})})
        size += n_text + n_image
        if size >= QUERY_VALUES:
            found.append(search(block))
            block, size = [], 0
    if block or not found:
        found.append(search(block))
    rows = reduce(DataFrame.unionByName, found)
    order = Window.partitionBy("query_id", "method").orderBy(F.desc(F.round("score", 6)), F.col("doc_id").cast("string"))
    rows = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return rows.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in _COMPONENTS})


def missing_parts() -> Column:
    """The names of a ranked candidate's missing components, in order."""
    return F.filter(F.array(*[F.when(F.col(c).isNull(), F.lit(n)) for c, n in NAMES.items()]), lambda x: x.isNotNull())
