"""Vectors of model spaces: which are comparable, exact ranking of a stated query set, feature hashing."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliospark.functions.score import l2_normalize, vector_valid
from foliospark.functions.text import lexical_tokens, nfkc
from foliospark.session import bounded_broadcast

SPACE = ["provider", "model", "version", "dimension", "preprocessing_hash"]


def in_active_space(vectors: DataFrame, active: DataFrame) -> DataFrame:
    """Vectors whose modality and model space are active and whose length is their dimension. ``active``: modality and
    the columns of a space. Null fields match null."""
    keys = ["modality", *SPACE]
    a = bounded_broadcast(active.select(*[F.col(k).alias(f"a_{k}") for k in keys]).distinct())
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"a_{k}"))
    return vectors.join(a, same, "left_semi").where(F.size("vector") == F.col("dimension"))


def latest_vectors(vectors: DataFrame) -> DataFrame:
    """One vector for each entity, modality and space: the last to arrive; ties: the greatest vec_id."""
    keys = ["entity_type", "entity_id", "modality", *SPACE]
    rest = [c for c in vectors.columns if c not in keys]
    return vectors.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("arrived_at", "vec_id")).alias("r")).select(*keys, "r.*")


#: Queries that are compared with a batch of rows at a time.
BLOCK = 2048


def _block_top(shared, k: int):
    """Best k rows of each Arrow batch, or of each group in it, for every query of its space: products of matrices,
    nothing kept between."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        spaces = shared.value
        for b in batches:
            out = []
            for (space, group), part in b.groupby(["space", "group"]):
                if space not in spaces:
                    continue
                qid, q = spaces[space]
                ids = part["vec_id"].to_numpy()
                order = np.argsort(ids, kind="stable")
                ids = ids[order]
                x = np.stack(part["v"].to_numpy())[order].astype(np.float64)
                for at in range(0, len(qid), BLOCK):
                    s = np.round(q[at : at + BLOCK] @ x.T, 9)
                    best = np.argsort(-s, axis=1, kind="stable")[:, : k + 1]
                    r = np.repeat(np.arange(len(best)), best.shape[1])
                    out.append(pd.DataFrame({"query_id": qid[at + r], "group": group, "vec_id": ids[best.ravel()], "cosine": s[r, best.ravel()]}))
            if out:
                yield pd.concat(out)

    return run


#: Values of the query side that are sent to all executors at once, at most.
QUERY_VALUES = 20_000_000


def exact_top_k(queries: DataFrame, vectors: DataFrame, k: int, group: str | None = None) -> DataFrame:
    """(query_id, vec_id, cosine, rank) of the k most similar vectors of each query within its space, itself left out;
    with ``group`` (a column of vectors that is a number) the k of each group, and the group.

    Both sides: vec_id, space, vector. Vectors that are null, non-finite or zero take no part. Queries go out in blocks of a bounded
    size, each compared with all rows; a partition hands on k rows a query, so that no pairs are shuffled.
    """
    ok = vector_valid(F.col("vector"))
    of = F.lit(0).cast("long") if group is None else F.col(group).cast("long")
    rows = vectors.where(ok & of.isNotNull()).select("vec_id", "space", of.alias("group"), l2_normalize(F.col("vector")).alias("v"))
    asked = queries.where(ok).select("vec_id", "space", l2_normalize(F.col("vector")).alias("v"))
    found, block, size = None, {}, 0
    context = vectors.sparkSession.sparkContext

    def search(block: dict[object, list]) -> DataFrame:
        ready = {s: (np.array([i for i, _ in rows_]), np.array([v for _, v in rows_])) for s, rows_ in block.items()}
        part = rows.mapInPandas(_block_top(context.broadcast(ready), k), "query_id long, group long, vec_id long, cosine double")
        return part

    for r in asked.orderBy("vec_id").toLocalIterator():
        block.setdefault(r["space"], []).append((r["vec_id"], r["v"]))
        size += len(r["v"])
        if size >= QUERY_VALUES:
            found = search(block) if found is None else found.unionByName(search(block))
            block, size = {}, 0
    if block or found is None:
        found = search(block) if found is None else found.unionByName(search(block))
    order = Window.partitionBy("query_id", "group").orderBy(F.desc("cosine"), "vec_id")
    top = found.where("query_id <> vec_id").distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return top.drop("group") if group is None else top


def best_regions(scores: DataFrame, most: int = 3) -> DataFrame:
    """(query_id, figure_id, sr, regions): of each figure the score of its best region, and its ``most`` best regions in
    order. ``scores``: query_id, figure_id, region_id, score (null: not scored; such regions come last, by id)."""
    order = Window.partitionBy("query_id", "figure_id").orderBy(F.col("score").desc_nulls_last(), "region_id")
    return (
        scores.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= most)
        .groupBy("query_id", "figure_id")
        .agg(F.max("score").alias("sr"), F.transform(F.array_sort(F.collect_list(F.struct("rank", "region_id"))), lambda x: x["region_id"]).alias("regions"))
    )




def hashed_text_vectors(docs: DataFrame, dims: int = 256, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, vector): signed feature hashing of lexical tokens, weight 1 + ln count, unit length. Only distinct tokens
    pass through Python. Texts without tokens give zeros."""

    @F.pandas_udf(T.IntegerType())
    def signed_place(tokens: pd.Series) -> pd.Series:
        out = []
        for t in tokens:
            d = hashlib.blake2b(t.encode(), digest_size=16).digest()
            at = int.from_bytes(d[:8], "big") % dims
            out.append(at + 1 if d[8] & 1 else -at - 1)
        return pd.Series(out, dtype="int32")

    counts = (
        docs.select(F.col(id_).alias("doc_id"), F.explode(lexical_tokens(nfkc(F.col(text)))).alias("term"))
        .groupBy("doc_id", "term")
        .agg((1 + F.log(F.count("*"))).alias("w"))
    )
    places = bounded_broadcast(counts.select("term").distinct().withColumn("place", signed_place("term")))
    cells = (
        counts.join(places, "term")
        .groupBy("doc_id", (F.abs("place") - 1).alias("at"))
        .agg(F.sum(F.col("w") * F.signum("place")).alias("w"))
        .groupBy("doc_id")
        .agg(F.map_from_entries(F.collect_list(F.struct("at", "w"))).alias("cells"))
    )
    vector = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.coalesce(F.try_element_at("cells", i), F.lit(0.0)))
    return docs.select(F.col(id_).alias("doc_id")).distinct().join(cells, "doc_id", "left").select(
        "doc_id", l2_normalize(F.when(F.col("cells").isNull(), F.array_repeat(F.lit(0.0), dims)).otherwise(vector)).alias("vector")
    )


def vector_state(v: Column, dimension: Column) -> Column:
    """Why a vector can't be used: missing, empty, cut, not_finite, zero; else usable."""
    return (
        F.when(v.isNull(), "missing")
        .when(F.size(v) == 0, "empty")
        .when(F.size(v) != dimension, "cut")
        .when(F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), "not_finite")
        .when(~F.exists(v, lambda x: x != 0), "zero")
        .otherwise("usable")
    )
