"""Error rates of recognised text, recall of boxes, rank metrics, comparison of methods."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliospark.functions.geometry import iou
from foliospark.functions.text import as_code_points, without_space, word_tokens


def error_rates(pairs: DataFrame, group: list[str] | None = None) -> DataFrame:
    """(…, n_pairs, char_edits, char_total, cer, token_edits, token_total, ter): summed edits over summed length of the
    truth; null where that is 0. ``pairs``: truth, prediction; null counts as empty. White space doesn't count in characters."""
    empty = F.lit("")
    t, p = without_space(F.coalesce("truth", empty)), without_space(F.coalesce("prediction", empty))
    tt, pt = word_tokens(F.coalesce("truth", empty)), word_tokens(F.coalesce("prediction", empty))
    words = F.array_union(tt, pt)
    rows = pairs.select(
        *(group or []),
        F.levenshtein(t, p).alias("ce"),
        F.length(t).alias("cn"),
        F.levenshtein(as_code_points(tt, words), as_code_points(pt, words)).alias("te"),
        F.size(tt).alias("tn"),
    )
    sums = rows.groupBy(*(group or [])).agg(
        F.count("*").alias("n_pairs"),
        F.sum("ce").alias("char_edits"), F.sum("cn").alias("char_total"),
        F.sum("te").alias("token_edits"), F.sum("tn").alias("token_total"),
    )
    return sums.withColumns({"cer": F.try_divide("char_edits", "char_total"), "ter": F.try_divide("token_edits", "token_total")})


def corpus_error_rate(lines: DataFrame, group: str, order: str) -> DataFrame:
    """(group, edits, total, cer): one edit distance between the concatenated truth and prediction of each group, in
    order. Quadratic in a group's length, so that a group should be a page or chapter."""
    joined = lines.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(order, "truth", "prediction"))).alias("r"))

    def side(name: str):
        return without_space(F.array_join(F.transform("r", lambda x: F.coalesce(x[name], F.lit(""))), ""))

    t, p = side("truth"), side("prediction")
    return joined.select(group, F.levenshtein(t, p).alias("edits"), F.length(t).alias("total")).withColumn("cer", F.try_divide("edits", "total"))


def matched_pairs(edges: dict[object, list]) -> int:
    """Size of a maximum matching. In every round a breadth-first search goes out from all unmatched left nodes at once,
    over edges forth and matched pairs back, layer by layer; each tree that reaches an unmatched right node changes its
    path. A round that changes nothing is the last."""
    left_of: dict[object, object] = {}
    right_of: dict[object, object] = {}
    while True:
        came_from: dict[object, object] = {}
        tree = {t: t for t in edges if t not in right_of}
        layer, ends = list(tree), {}
        while layer:
            following = []
            for t in layer:
                if tree[t] in ends:
                    continue
                for f in edges[t]:
                    if f in came_from:
                        continue
                    came_from[f] = t
                    owner = left_of.get(f)
                    if owner is None:
                        ends[tree[t]] = f
                        break
                    tree[owner] = tree[t]
                    following.append(owner)
            layer = following
        if not ends:
            return len(left_of)
        for f in ends.values():
            while f is not None:
                t = came_from[f]
                before = right_of.get(t)
                left_of[f], right_of[t] = t, f
                f = before


def _maximum_matching(pdf: pd.DataFrame) -> pd.DataFrame:
    edges = {t: sorted(g["found_id"]) for t, g in pdf.groupby("truth_id")}
    return pd.DataFrame({"page_id": [pdf["page_id"].iloc[0]], "matched": [matched_pairs(edges)]})


def box_recall(truth: DataFrame, found: DataFrame, at_least: float = 0.5) -> DataFrame:
    """(page_id, matched, total): boxes of the truth that find a box of their own, no box serving two. Both sides:
    page_id, id, bbox. Pages without truth are not listed; edges of a page meet in one task."""
    t = truth.select("page_id", F.col("id").alias("truth_id"), F.col("bbox").alias("a"))
    f = found.select("page_id", F.col("id").alias("found_id"), F.col("bbox").alias("b"))
    edges = t.join(f, "page_id").where(iou(F.col("a"), F.col("b")) >= at_least).select("page_id", "truth_id", "found_id")
    matched = edges.groupBy("page_id").applyInPandas(_maximum_matching, "page_id string, matched long")
    total = t.groupBy("page_id").agg(F.count("*").alias("total"))
    return total.join(matched, "page_id", "left").select("page_id", F.coalesce("matched", F.lit(0)).alias("matched"), "total")


def rank_metrics(ranking: DataFrame, relevant: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, n_relevant, recall, rr, ndcg) at k. ``ranking``: query_id, doc_id, rank; ``relevant``: query_id, doc_id.
    Queries without relevant documents have null metrics."""
    asked = ranking.select("query_id").distinct()
    total = relevant.groupBy("query_id").agg(F.count("*").alias("n_relevant"))
    hits = ranking.where(F.col("rank") <= k).join(relevant, ["query_id", "doc_id"], "left_semi")
    got = hits.groupBy("query_id").agg(F.count("*").alias("hits"), F.min("rank").alias("first"), F.sum(1 / F.log2(F.col("rank") + 1)).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n_relevant"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    n = F.col("n_relevant") > 0
    return (
        asked.join(total, "query_id", "left")
        .join(got, "query_id", "left")
        .fillna(0, ["n_relevant", "hits"])
        .select(
            "query_id", "n_relevant",
            F.when(n, F.col("hits") / F.col("n_relevant")).alias("recall"),
            F.when(n, F.coalesce(1 / F.col("first"), F.lit(0.0))).alias("rr"),
            F.when(n, F.coalesce(F.col("dcg"), F.lit(0.0)) / ideal).alias("ndcg"),
        )
    )


def method_summary(runs: DataFrame) -> DataFrame:
    """Per method: runs by status, stable runs, and median, least and greatest latency. ``runs``: method, status,
    repeat_stable, latencies ARRAY<DOUBLE>; medians of an even number lie between the middle ones."""
    counts = runs.groupBy("method").agg(
        F.count_if(F.col("status") == "completed").alias("completed"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        F.count_if(F.col("status") == "not_applicable").alias("not_applicable"),
        F.count_if(F.col("repeat_stable")).alias("stable"),
    )
    warm = (
        runs.select("method", F.explode("latencies").alias("ms"))
        .groupBy("method")
        .agg(F.median("ms").alias("median_ms"), F.min("ms").alias("min_ms"), F.max("ms").alias("max_ms"))
    )
    return counts.join(warm, "method", "left")


def rank_changes(results: DataFrame, a: str, b: str) -> DataFrame:
    """(query_id, top1_changed, order_changed) between two methods. ``results``: query_id, method, doc_id, rank."""
    order = F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))), lambda x: x["doc_id"])
    lists = results.where(F.col("method").isin(a, b)).groupBy("query_id", "method").agg(order.alias("docs"))
    left = lists.where(F.col("method") == a).select("query_id", F.col("docs").alias("x"))
    right = lists.where(F.col("method") == b).select("query_id", F.col("docs").alias("y"))
    return left.join(right, "query_id").select(
        "query_id", (F.col("x")[0] != F.col("y")[0]).alias("top1_changed"), (F.col("x") != F.col("y")).alias("order_changed")
    )


def ranking_signature(ranking: DataFrame, places: int = 6) -> DataFrame:
    """(query_id, signature): digest of a whole ranking with all its numbers, the same for equal rankings. ``ranking``:
    query_id, doc_id, rank, score; other columns of type double are components and belong to it."""
    parts = sorted(c for c, t in ranking.dtypes if t == "double" and c != "score")
    row = F.concat_ws(":", F.col("rank"), F.col("doc_id"), *[F.coalesce(F.format_number(c, places), F.lit("none")) for c in ("score", *parts)])
    return ranking.groupBy("query_id").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.struct("rank", row.alias("t"))))["t"], "|"), 256).alias("signature"))


def ranked(scores: DataFrame, group: str = "query_id") -> DataFrame:
    """``scores`` with rank by falling score; ties by doc_id as text."""
    w = Window.partitionBy(group).orderBy(F.desc("score"), F.col("doc_id").cast("string"))
    return scores.withColumn("rank", F.row_number().over(w))
