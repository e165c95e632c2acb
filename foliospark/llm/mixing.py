"""Mixing sources to target shares of the size in tokens.

Method: cube sampling. A source that must give the size q of itself repeats every document floor(q) times; which
documents are used once more is drawn with the probability q - floor(q), balanced on the tokens and on the number of
documents. The flight moves a few open probabilities at a time along the null space of the two constraints, until each
is 0 or 1; it runs in blocks, and what a block leaves open (at most two documents) flies again with that of other
blocks, until a landing problem of a few documents a source remains.

A large document moves least in each step and so stays open longest. Some documents of each source, LANDING or so drawn by
their ids, are therefore kept for the landing, where they make up for it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm.tokens import VOCABULARY, token_count
from foliospark.session import checkpoint, spread

#: Documents that fly together. A block is one task's group; of a hot source there are as many blocks as it needs.
BLOCK = 20_000

#: Documents of each source that are kept for the landing, on average.
LANDING = 48

_EPS = 1e-9


def _null(a: list[tuple[float, float]]) -> tuple[float, float, float]:
    """A direction that changes neither the sum nor the weighted sum of three values: the cross product of the rows."""
    (x0, y0), (x1, y1), (x2, y2) = a
    u = (x1 * y2 - x2 * y1, x2 * y0 - x0 * y2, x0 * y1 - x1 * y0)
    if abs(u[0]) + abs(u[1]) + abs(u[2]) > 0:
        return u
    # The rows are proportional: one constraint is left.
    return (x1, -x0, 0.0) if x0 or x1 else (1.0, 0.0, 0.0)


def flight(p: np.ndarray, tokens: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Probabilities after the flight: all but at most two are 0 or 1; sums of p and of p * tokens stay as they are."""
    p = p.astype(float).copy()
    scale = float(tokens.max()) or 1.0
    rows = [(1.0, float(t) / scale) for t in tokens]
    coins = iter(rng.random(len(p) + 8))
    open_: list[int] = []
    for i in rng.permutation(len(p)):
        if _EPS < p[i] < 1 - _EPS:
            open_.append(int(i))
        while len(open_) == 3:
            u = _null([rows[k] for k in open_])
            up = down = np.inf
            for k, d in zip(open_, u, strict=True):
                if d > 0:
                    up, down = min(up, (1 - p[k]) / d), min(down, p[k] / d)
                elif d < 0:
                    up, down = min(up, p[k] / -d), min(down, (1 - p[k]) / -d)
            step = up if next(coins, 0.5) * (up + down) < down else -down
            for k, d in zip(open_, u, strict=True):
                p[k] += step * d
            still = [k for k in open_ if _EPS < p[k] < 1 - _EPS]
            if len(still) == 3:  # rounding: the nearest to an end has reached it
                still.remove(min(still, key=lambda k: min(p[k], 1 - p[k])))
            for k in set(open_) - set(still):
                p[k] = round(p[k])
            open_ = still
    return p


def _fly(seed: int):
    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("doc_id", ignore_index=True)
        rng = np.random.default_rng([seed, int(pdf["block"].iloc[0]), len(pdf)])
        return pdf.assign(p=flight(pdf["p"].to_numpy(), pdf["n_tokens"].to_numpy(), rng))

    return block


def _land(pdf: pd.DataFrame) -> pd.DataFrame:
    """Decides the documents of a source that are still open: about as many as are due, and so that their tokens come as
    near as swaps and single changes bring them to what is due. In the order of doc_id, so that it can be repeated."""
    pdf = pdf.sort_values("doc_id", ignore_index=True)
    p, t = pdf["p"].to_numpy(), pdf["n_tokens"].to_numpy().astype(float)
    due, n = float((p * t).sum()), len(pdf)
    chosen = np.zeros(n, bool)
    chosen[np.random.default_rng(n).permutation(n)[: round(float(p.sum()))]] = True
    for _ in range(4 * n):
        off = due - t[chosen].sum()
        # What each single change adds, and what each swap of one in for one out adds.
        single = np.where(chosen, -t, t)
        swap = np.where(chosen[None, :] & ~chosen[:, None], t[:, None] - t[None, :], np.inf)
        one, two = int(np.abs(off - single).argmin()), np.unravel_index(int(np.abs(off - swap).argmin()), swap.shape)
        best = min((abs(off - swap[two]), 1), (abs(off - single[one]), 0))
        if best[0] >= abs(off) - 1e-9:
            break
        changed = list(two) if best[1] else [one]
        chosen[changed] = ~chosen[changed]
    return pdf.assign(p=chosen.astype(float))


def source_needs(sizes: DataFrame, targets: DataFrame, total_tokens: float | None = None) -> DataFrame:
    """What each source of ``targets`` has, must give and how often: one row per source.

    Without ``total_tokens`` the mixture is the largest in which each source that has tokens reaches its share within
    max_passes. Sources without tokens give nothing; their share is divided among the others in proportion. With
    ``total_tokens``, a source that can't give its part gives all it may, max_passes times.
    """
    have = sizes.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("tokens"))
    rows = targets.groupBy("source").agg(F.sum("target_share").alias("target_share"), F.max("max_passes").alias("max_passes"))
    one = rows.join(have, "source", "left").fillna(0, ["n_docs", "tokens"])
    able = (F.col("tokens") > 0) & (F.col("target_share") > 0) & (F.col("max_passes") > 0)
    limits = one.where(able).agg(
        F.min(F.col("max_passes") * F.col("tokens") / F.col("target_share")).alias("reach"), F.sum("target_share").alias("shares")
    )
    total = F.lit(float(total_tokens)) / F.col("shares") if total_tokens else F.col("reach")
    return one.join(F.broadcast(limits)).select(
        *one.columns,
        F.when(able, F.least(F.col("target_share") * total / F.col("tokens"), F.col("max_passes").cast("double")))
        .otherwise(0.0)
        .alias("passes"),
    )


def mix(documents: DataFrame, targets: DataFrame, total_tokens: float | None = None, seed: int = 7, block: int = BLOCK, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, source, n_tokens, times) of every document that is used, ``times`` at most max_passes.

    Documents of sources that are not in ``targets``, or of none, take no part; nor do texts without tokens (null and
    empty), or rows without doc_id. Of rows with the same doc_id one counts, that of the least source and size. The draw depends on ``seed`` and the ids alone.
    """
    wanted = targets.groupBy("source").agg(F.max("max_passes").alias("most"))
    # Texts are counted where they are; only ids and sizes move.
    sizes = (
        spread(documents.select("doc_id", "source", "text").where("doc_id is not null and length(text) > 0").join(F.broadcast(wanted), "source", "left_semi"))
        .select("doc_id", "source", token_count(F.col("text"), vocabulary).alias("n_tokens"))
        .where("n_tokens > 0")
        .groupBy("doc_id")
        .agg(F.min(F.struct("source", "n_tokens")).alias("r"))
        .select("doc_id", "r.*")
    )
    sizes = checkpoint(sizes)
    needs = source_needs(sizes, targets, total_tokens).select("source", "n_docs", "passes")
    drawn = sizes.join(F.broadcast(needs), "source").select(
        "doc_id",
        "source",
        "n_tokens",
        F.floor("passes").alias("whole"),
        (F.col("passes") - F.floor("passes")).alias("p"),
        F.floor(F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.ceil(F.col("n_docs") / block))).cast("long").alias("block"),
        "n_docs",
    )
    schema = drawn.drop("n_docs").schema
    kept = F.pmod(F.xxhash64(F.lit(seed), F.lit("land"), "doc_id"), F.lit(1_000_000_007)) < LANDING * 1_000_000_007 / F.col("n_docs")
    drawn = checkpoint(drawn.withColumn("kept", kept).select(*schema.names, "kept"))
    held, drawn = drawn.where("kept").drop("kept"), drawn.where("not kept").drop("kept")
    flown = checkpoint(drawn.groupBy("source", "block").applyInPandas(_fly(seed), schema))
    done, still_open = [], flown
    is_open = (F.col("p") > _EPS) & (F.col("p") < 1 - _EPS)
    # A block leaves at most two documents open, so that a round divides their number by block / 2.
    while True:
        done.append(still_open.where(~is_open))
        still_open = still_open.where(is_open)
        counts = still_open.groupBy("source").count()
        largest = counts.agg(F.max("count")).first()[0] or 0
        if largest <= 2:
            break
        again = still_open.join(F.broadcast(counts), "source").withColumn(
            "block", F.pmod(F.xxhash64(F.lit(seed + len(done)), "doc_id"), F.ceil(F.col("count") / block)).cast("long")
        )
        still_open = checkpoint(again.select(*schema.names).groupBy("source", "block").applyInPandas(_fly(seed + len(done)), schema))
    done.append(held.where(~is_open))
    landed = still_open.unionByName(held.where(is_open)).groupBy("source").applyInPandas(_land, schema)
    for part in done:
        landed = landed.unionByName(part)
    return landed.select("doc_id", "source", "n_tokens", (F.col("whole") + F.round("p")).cast("int").alias("times")).where("times > 0")


def shares(mixture: DataFrame, targets: DataFrame) -> DataFrame:
    """Shares reached: source, target_share, n_docs, tokens, share and what it differs, one row per source of targets."""
    rows = targets.groupBy("source").agg(F.sum("target_share").alias("target_share"), F.max("max_passes").alias("max_passes"))
    got = mixture.groupBy("source").agg(
        F.count("*").alias("n_docs"),
        F.sum(F.col("n_tokens") * F.col("times")).alias("tokens"),
        F.max("times").alias("most_passes"),
    )
    all_ = got.agg(F.sum("tokens").alias("all_tokens"))
    share = F.coalesce(F.col("tokens") / F.col("all_tokens"), F.lit(0.0))
    return (
        rows.join(got, "source", "left")
        .join(F.broadcast(all_))
        .fillna(0, ["n_docs", "tokens", "most_passes"])
        .select(*rows.columns, "n_docs", "tokens", "most_passes", share.alias("share"), (share - F.col("target_share")).alias("off"))
    )
