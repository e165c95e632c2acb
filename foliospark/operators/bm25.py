"""Lexical ranking: BM25 over a filtered corpus for a whole table of queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.functions.text import lexical_tokens, nfkc
from foliospark.session import bounded_broadcast, checkpoint, spread, written

K1, B = 1.5, 0.75


def postings(docs: DataFrame, id_: str = "doc_id", text: str = "text", normalise: bool = True) -> DataFrame:
    """(doc_id, term, tf). Null texts have no terms. A doc_id given twice is one document of both texts' terms."""
    x = nfkc(F.col(text)) if normalise else F.col(text)
    return (
        docs.select(F.col(id_).alias("doc_id"), F.explode(lexical_tokens(x)).alias("term"))
        .groupBy("doc_id", "term")
        .agg(F.count("*").alias("tf"))
    )


def bm25_scores(docs: DataFrame, queries: DataFrame, id_: str = "doc_id", text: str = "text", k1: float = K1, b: float = B, normalise: bool = True) -> DataFrame:
    """(query_id, doc_id, score) of every pair with a common term. ``queries``: query_id, text.

    Statistics are those of ``docs`` as given, so filter first; texts without terms are documents of length 0. doc_ids
    should be unique: of a repeated one terms add up and the longest text gives the length. A query term of frequency f
    weighs 1 + ln f.

    Texts are tokenised once. The queries' terms, counted before they are broadcast, keep all other terms out before the
    shuffle; an empty term in each document carries its length for the statistics.
    """
    x, q = (nfkc(F.col(c)) if normalise else F.col(c) for c in (text, "text"))
    asked = (
        queries.select("query_id", F.explode(lexical_tokens(q)).alias("term")).groupBy("query_id", "term").agg((1 + F.log(F.count("*"))).alias("boost"))
    )
    asked = checkpoint(asked)
    mark = F.array(F.lit(""))
    wanted = asked.select("term").unionByName(docs.sparkSession.createDataFrame([("",)], "term string")).distinct()
    tokens = spread(docs.select(F.col(id_).alias("doc_id"), F.col(text))).select("doc_id", F.coalesce(lexical_tokens(x), F.array().cast("array<string>")).alias("t"))
    used = (
        tokens.select("doc_id", F.size("t").alias("len"), F.explode(F.concat("t", mark)).alias("term"))
        .join(bounded_broadcast(wanted), "term", "left_semi")
        .groupBy("doc_id", "term")
        .agg(F.count("*").alias("tf"), F.max("len").alias("len"))
    )
    used = written(used)
    stats = used.where("term = ''").agg(F.count("*").alias("n_docs"), F.avg("len").alias("avg_len"))
    stats = F.broadcast(stats.select("n_docs", F.coalesce(F.nullif("avg_len", F.lit(0.0)), F.lit(1.0)).alias("avg_len")))
    used = used.where("term <> ''")
    df = used.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg_len")))
    return (
        used.join(bounded_broadcast(df), "term")
        .join(stats)
        .select("term", "doc_id", weight.alias("weight"))
        .join(bounded_broadcast(asked), "term")
        .groupBy("query_id", "doc_id")
        .agg(F.sum(F.col("weight") * F.col("boost")).alias("score"))
        .where("score > 0")
    )


def top_k(scores: DataFrame, k: int, by: str = "score", group: str = "query_id", tie: Column | str = "doc_id", places: int = 6) -> DataFrame:
    """The k best rows of each group with their rank; equal scores (rounded) in order of ``tie``."""
    order = Window.partitionBy(group).orderBy(F.desc(F.round(by, places)), tie)
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def max_normalised(scores: DataFrame, group: str = "query_id", by: str = "score") -> DataFrame:
    """``scores`` with ``normalised``: the score over the greatest of its group."""
    best = scores.groupBy(group).agg(F.max(by).alias("best"))
    return scores.join(bounded_broadcast(best), group).withColumn("normalised", F.col(by) / F.col("best")).drop("best")
