"""The most similar vectors of every vector.

Method: adaptive scan of dimensions in an inverted file. Vectors of a model space are made unit length, turned by a
random rotation and put into lists around centroids, of two levels in a large space, so that a list stays as long as it
is in a small one. Within a probed list, distances grow over blocks of columns; after
each block a hypothesis test compares the partial distance, scaled to all dimensions, with the query's tenth-best
distance so far and abandons candidates that are too far off with high probability. Survivors are compared in full.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.operators.skew import join_by_size
from foliospark.session import bounded_broadcast, by_key, checkpoint, spread, written

SPACE = ["entity_type", "modality", "provider", "model", "version", "dimension", "preprocessing_hash"]

K = 10
#: Vectors of a space, and of each of its first lists, on which centroids are fitted, at most. Every vector is indexed.
SAMPLE = 20_000
#: Vectors that a centroid is fitted on, at least.
FIT_ROWS = 8
#: First lists whose parts a vector is compared with, where a space has lists of two levels.
FIRST_PROBES = 16
#: Values of all centroids together that are sent to all workers, at most: beyond, lists grow longer than LIST_ROWS.
CENTROID_VALUES = 64_000_000
#: Rows that a list should have.
LIST_ROWS = 200
#: Lists that a query looks into.
PROBES = 80
#: Members, and queries, of one task's block of lists.
CELL_ROWS = 25_000
#: Strictness of the test: a candidate is abandoned if its scaled partial distance exceeds (1 + EPS0 / sqrt(dims)) times
#: the bound.
EPS0 = 2.1
#: Distances are compared after rounding to so many places, for equal vectors to tie.
PLACES = 6


def rotation(dims: int) -> np.ndarray:
    """The orthogonal matrix used for all vectors of so many dimensions."""
    q, r = np.linalg.qr(np.random.default_rng(dims).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def _prepare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Usable vectors, of unit length and rotated, as bytes of float32."""
    for b in batches:
        out = []
        for dims, part in b.groupby("dimension"):
            x = np.stack([np.asarray(v, np.float64) for v in part["vector"]])
            top = np.abs(x).max(axis=1, keepdims=True)
            x = x / top
            x = x / np.linalg.norm(x, axis=1, keepdims=True) @ rotation(int(dims))
            out.append(pd.DataFrame({"space": part["space"].to_numpy(), "vec_id": part["vec_id"].to_numpy(), "v": [r.tobytes() for r in x.astype(np.float32)]}))
        yield pd.concat(out) if out else pd.DataFrame({"space": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "v": []})


def usable_vectors(vectors: DataFrame) -> DataFrame:
    """(space, vec_id, v): each vec_id once (the earliest row), without null, cut, non-finite and all-zero vectors."""
    x = F.col("vector")
    fit = (
        x.isNotNull()
        & F.col("vec_id").isNotNull()
        & (F.col("dimension") > 0)
        & (F.size(x) == F.col("dimension"))
        & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
        & F.exists(x, lambda v: v != 0)
    )
    space = F.xxhash64(F.to_json(F.struct(*SPACE), {"ignoreNullFields": "false"}))
    return (
        spread(vectors).where(F.coalesce(fit, F.lit(False)))
        .select("vec_id", "dimension", "vector", space.alias("space"), "arrived_at")
        .groupBy("vec_id")
        .agg(F.min_by(F.struct("space", "dimension", "vector"), "arrived_at").alias("first"), F.min(F.struct("space", "dimension", "vector")).alias("any"))
        .select("vec_id", F.explode(F.array(F.coalesce("first", "any"))).alias("r"))
        .select("r.space", "vec_id", "r.dimension", "r.vector")
        .mapInPandas(_prepare, "space long, vec_id long, v binary")
    )


def _matrix(values) -> np.ndarray:
    values = list(values)
    return np.frombuffer(b"".join(values), np.float32).reshape(len(values), -1)


def _k_means(x: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means; a centroid that loses all its rows stays as it was."""
    c = x[np.random.default_rng(k).permutation(len(x))[:k]]
    for _ in range(8):
        near = np.concatenate([(part @ c.T).argmax(axis=1) for part in np.array_split(x, len(x) // 2000 + 1)])
        order = np.argsort(near, kind="stable")
        starts = np.searchsorted(near[order], np.arange(k))
        full = np.diff(np.append(starts, len(x))) > 0
        sums = c.copy()
        sums[full] = np.add.reduceat(x[order], starts[full], axis=0)
        c = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return c.astype(np.float32)


def _fit(list_rows: float):
    def centroids(pdf: pd.DataFrame) -> pd.DataFrame:
        """Centroids on a bounded sample of a space, or of one of its first lists; n: the rows that it stands for."""
        pdf = pdf.sort_values("vec_id", ignore_index=True)
        x = _matrix(pdf["v"])
        k = int(max(1, min(pdf["n"].iloc[0] // list_rows, len(x) // FIT_ROWS)))
        c = _k_means(x, k)
        return pd.DataFrame({"space": pdf["space"].iloc[0], "first": pdf["first"].iloc[0], "list": np.arange(k, dtype=np.int32), "c": [r.tobytes() for r in c]})

    return centroids


class Lists:
    """The lists of a space: first centroids, and parts of each first list where there are two levels."""

    def __init__(self, first: np.ndarray, parts: list[np.ndarray] | None = None):
        self.first, self.parts = first, parts
        self.offsets = np.cumsum([0, *map(len, parts)]) if parts else np.arange(len(first) + 1)
        self.centroids = np.concatenate(parts) if parts else first

    def nearest(self, x: np.ndarray, probes: int) -> np.ndarray:
        """The ``probes`` nearest lists of each vector, the nearest first; of two levels those in the nearest first lists.
        -1 where a vector has fewer."""
        s = x @ self.first.T
        if not self.parts:
            return _top(s, min(probes, s.shape[1]))
        firsts = _top(s, min(FIRST_PROBES, s.shape[1]))
        rows, lists, scores = [], [], []
        for f in np.unique(firsts):
            mine = np.flatnonzero((firsts == f).any(axis=1))
            score = x[mine] @ self.parts[f].T
            best = _top(score, min(probes, score.shape[1]))
            rows.append(np.repeat(mine, best.shape[1])), lists.append((best + self.offsets[f]).ravel())
            scores.append(np.take_along_axis(score, best, axis=1).ravel())
        rows, lists, scores = map(np.concatenate, (rows, lists, scores))
        order = np.lexsort((lists, -scores, rows))
        rows, lists = rows[order], lists[order]
        rank = np.arange(len(rows)) - np.searchsorted(rows, np.arange(len(x)))[rows]
        out = np.full((len(x), probes), -1, np.int64)
        keep = rank < probes
        out[rows[keep], rank[keep]] = lists[keep]
        return out


def _top(s: np.ndarray, m: int) -> np.ndarray:
    """The places of the m greatest values of each row, the greatest first."""
    near = np.argpartition(-s, m - 1, axis=1)[:, :m]
    return np.take_along_axis(near, np.argsort(-np.take_along_axis(s, near, axis=1), axis=1, kind="stable"), axis=1)


def _assign(shared, probes: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        spaces = shared.value
        for b in batches:
            out = []
            for space, part in b.groupby("space"):
                near = spaces[int(space)].nearest(_matrix(part["v"]), probes)
                out.append(part.assign(list=near[:, 0].astype(np.int32), probes=[r[r >= 0] for r in near.astype(np.int32)]))
            yield pd.concat(out) if out else b.assign(list=np.int32(0), probes=None)

    return run


def fitted_lists(kept: DataFrame, counts: DataFrame, sample: int = SAMPLE, list_rows: int = LIST_ROWS) -> dict[int, Lists]:
    """The lists of each space, so many that one has about ``list_rows`` rows.

    One level of centroids is fitted on at most ``sample`` vectors of a space, which gives sample / FIT_ROWS lists. A space
    that needs more gets a second level: each first list's parts are fitted on at most as many of its own vectors, each
    list in a task of its own, so that the number of lists grows with the space. All centroids are sent to all workers,
    CENTROID_VALUES values at most."""
    spark = kept.sparkSession
    sizes = {r["space"]: (r["n"], r["dims"]) for r in counts.collect()}  # a row a space

    def share(name: str) -> Column:
        return F.pmod(F.xxhash64(F.lit(3), "vec_id"), F.lit(1_000_000)) < F.lit(0.95 * sample * 1_000_000) / F.col(name)

    shape = "space long, first int, list int, c binary"
    drawn = kept.select("space", "vec_id", "v", F.lit(0).alias("first")).join(F.broadcast(counts), "space").where(share("n"))
    found = drawn.groupBy("space").applyInPandas(_fit(list_rows), shape).toPandas()  # sample / FIT_ROWS rows a space
    spaces = {int(s): Lists(_matrix(p.sort_values("list")["c"])) for s, p in found.groupby("space")}
    for space, (_, dims) in sizes.items():
        # A space so small that the draw missed it has one list around its first axis.
        spaces.setdefault(space, Lists(np.eye(1, dims, dtype=np.float32)))
    large = [s for s, (n, _) in sizes.items() if n > 2 * list_rows * len(spaces[s].first)]
    if not large:
        return spaces
    wanted = sum(sizes[s][0] / list_rows * sizes[s][1] for s in large)
    longer = list_rows * max(1.0, wanted / CENTROID_VALUES)
    shared = spark.sparkContext.broadcast({s: spaces[s] for s in large})
    rows = spread(kept.where(F.col("space").isin(*large)).select("space", "vec_id", "v")).mapInPandas(_assign(shared, 1), "space long, vec_id long, v binary, list int, probes array<int>")
    rows = checkpoint(rows.select("space", "vec_id", "v", F.col("list").alias("first")))
    members = checkpoint(rows.groupBy("space", "first").agg(F.count("*").alias("n")))
    # FIT_ROWS vectors a centroid are enough, and no more than a sample of a list.
    some = F.least(F.lit(0.95 * sample) / F.col("n"), F.lit(4.0 * FIT_ROWS / longer))
    chosen = rows.join(F.broadcast(members), ["space", "first"]).where(F.pmod(F.xxhash64(F.lit(7), "vec_id"), F.lit(1_000_000)) < F.lit(1_000_000) * some)
    parts = chosen.groupBy("space", "first").applyInPandas(_fit(longer), shape).toPandas()
    for space in large:
        mine = {int(f): _matrix(p.sort_values("list")["c"]) for f, p in parts[parts["space"] == space].groupby("first")}
        first = spaces[space].first
        spaces[space] = Lists(first, [mine.get(f, first[f : f + 1]) for f in range(len(first))])
    return spaces


def _blocks_of_lists(c: np.ndarray, weight: np.ndarray, rows: int) -> np.ndarray:
    """Splits lists into blocks of neighbours that have about ``rows`` rows: halves along the widest direction, again and again."""
    block, todo, n = np.zeros(len(c), np.int32), [np.arange(len(c))], 0
    while todo:
        part = todo.pop()
        if len(part) < 2 or weight[part].sum() <= rows:
            block[part] = n
            n += 1
            continue
        centred = c[part] - c[part].mean(axis=0)
        along = centred @ np.linalg.svd(centred, full_matrices=False)[2][0]
        order = part[np.argsort(along, kind="stable")]
        total = np.cumsum(weight[order])
        cut = int(np.clip(np.searchsorted(total, total[-1] / 2) + 1, 1, len(part) - 1))
        todo += [order[:cut], order[cut:]]
    return block


def _by_block(probes: list, block_of: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(vector, block, its probes in that block, the nearest first) of every block that a vector asks."""
    lists = np.concatenate([np.asarray(p, np.int32) for p in probes])
    rows = np.repeat(np.arange(len(probes)), [len(p) for p in probes])
    blocks = block_of[lists]
    order = np.lexsort((np.arange(len(rows)), blocks, rows))
    rows, blocks, lists = rows[order], blocks[order], lists[order]
    cuts = np.flatnonzero((np.diff(rows) != 0) | (np.diff(blocks) != 0)) + 1
    firsts = np.concatenate([[0], cuts])
    return rows[firsts], blocks[firsts], np.split(lists, cuts)


def _asking(shared):
    """Rows of vectors once for every block that they ask."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for space, part in b.groupby("space"):
                rows, blocks, probes = _by_block(part["probes"].tolist(), shared.value[int(space)])
                yield part.drop(columns="probes").iloc[rows].assign(block=blocks.astype(np.int32), probes=probes)

    return run


def _asked_counts(shared):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for space, part in b.groupby("space"):
                _, blocks, _ = _by_block(part["probes"].tolist(), shared.value[int(space)])
                block, n = np.unique(blocks, return_counts=True)
                yield pd.DataFrame({"space": space, "block": block.astype(np.int32), "q": n})

    return run


class _Best:
    """The k nearest so far of each query of a block."""

    def __init__(self, n: int, k: int):
        self.k, self.d, self.id = k, np.full((n, k), np.inf, np.float32), np.full((n, k), -1, np.int64)

    def add(self, q: np.ndarray, ids: np.ndarray, d: np.ndarray) -> None:
        """New pairs (query, candidate, distance)."""
        order = np.lexsort((ids, d, q))
        q, ids, d = q[order], ids[order], d[order]
        first = np.flatnonzero(np.append(True, q[1:] != q[:-1]))
        rank = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
        keep = rank < self.k
        q, ids, d, rank = q[keep], ids[keep], d[keep], rank[keep]
        rows = np.unique(q)
        at = np.searchsorted(rows, q)
        nd, ni = np.full((len(rows), self.k), np.inf, np.float32), np.full((len(rows), self.k), -1, np.int64)
        nd[at, rank], ni[at, rank] = d, ids
        nd, ni = np.concatenate([self.d[rows], nd], axis=1), np.concatenate([self.id[rows], ni], axis=1)
        order = np.lexsort((ni, nd), axis=1)[:, : self.k]
        self.d[rows], self.id[rows] = np.take_along_axis(nd, order, 1), np.take_along_axis(ni, order, 1)


def scan_list(q: np.ndarray, members: np.ndarray, bound: np.ndarray, eps0: float = EPS0) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Pairs (query, member, squared distance) not farther than ``bound`` of the query, and how many column values were
    read. Candidates may be lost with the small probability that the test allows."""
    dims = q.shape[1]
    ends = sorted({min(dims, x) for x in (16, 32, 48)} | {dims})
    rows = cols = None
    part, begin, read = None, 0, 0
    limit = bound + np.float32(1e-5)
    for end in ends:
        a, b = q[:, begin:end], members[:, begin:end]
        if rows is None:
            step = np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T), 0)
            part = step if part is None else part + step
            read += part.size * (end - begin)
            far = 1.0 if end == dims else (1 + eps0 / np.sqrt(end)) ** 2 * end / dims
            alive = part <= (limit * far)[:, None]
            if end == dims or alive.mean() < 0.25:
                rows, cols = np.nonzero(alive)
                part = part[rows, cols]
        else:
            for at in range(0, len(rows), 200_000):
                s = slice(at, at + 200_000)
                diff = a[rows[s]] - b[cols[s]]
                part[s] += np.einsum("ij,ij->i", diff, diff)
            read += len(rows) * (end - begin)
            far = 1.0 if end == dims else (1 + eps0 / np.sqrt(end)) ** 2 * end / dims
            alive = part <= limit[rows] * far
            rows, cols, part = rows[alive], cols[alive], part[alive]
        begin = end
    return rows, cols, part, read


def _search(k: int):
    def cell(pdf: pd.DataFrame) -> pd.DataFrame:
        member, query = pdf[~pdf["asks"]].sort_values("vec_id"), pdf[pdf["asks"]].sort_values("vec_id")
        if not len(member) or not len(query):
            return pd.DataFrame({"vec_id": np.zeros(0, np.int64), "other": np.zeros(0, np.int64), "d": np.zeros(0, np.float64)})
        m, mid, mlist = _matrix(member["v"]), member["vec_id"].to_numpy(), member["list"].to_numpy()
        q, qid = _matrix(query["v"]), query["vec_id"].to_numpy()
        best = _Best(len(q), k + 1)
        of = {int(x): np.flatnonzero(mlist == x) for x in np.unique(mlist)}
        # Each query's nearest lists first: the bounds are tight when the farther ones are scanned.
        many = np.array([len(p) for p in query["probes"]])
        lists = np.concatenate([np.asarray(p, np.int32) for p in query["probes"]])
        asks = np.repeat(np.arange(len(query)), many)
        order = np.arange(len(asks)) - np.repeat(np.cumsum(many) - many, many)
        here = np.isin(lists, np.array(list(of), np.int32))
        lists, asks, order = lists[here], asks[here], order[here]
        at = np.lexsort((asks, lists, order))
        lists, asks, order = lists[at], asks[at], order[at]
        cuts = np.flatnonzero((np.diff(lists) != 0) | (np.diff(order) != 0)) + 1
        for asking in np.split(np.arange(len(asks)), cuts) if len(asks) else ():
            mine = of[int(lists[asking[0]])]
            asking = asks[asking]
            for part in np.array_split(mine, len(mine) // 2000 + 1):
                for some in np.array_split(asking, len(asking) // 2000 + 1):
                    r, c, d, _ = scan_list(q[some], m[part], best.d[some, k])
                    if len(r):
                        best.add(some[r], mid[part[c]], np.round(d, PLACES))
        ok = (best.id >= 0) & (best.id != qid[:, None])
        r, c = np.nonzero(ok)
        return pd.DataFrame({"vec_id": qid[r], "other": best.id[r, c], "d": best.d[r, c].astype(np.float64)})

    return cell


def nearest(vectors: DataFrame, k: int = K, probes: int = PROBES, sample: int = SAMPLE, list_rows: int = LIST_ROWS, cell_rows: int = CELL_ROWS) -> DataFrame:
    """(vec_id, other, d): of every usable vector the k others of its model space of the greatest cosine.

    d is the squared distance of the unit vectors, 2 - 2 cos, rounded; ties go to the smaller vec_id. Vectors that are
    null, of another length than ``dimension``, not finite or all zero take no part; a row sent twice counts once. A
    space of fewer than k + 1 vectors gives as many as it has.

    Of vectors equal in every value the k + 1 of the smallest ids go into the index, all others have the k smallest ids
    as neighbours, so that no group of copies, however large, is compared with itself. A few neighbours may be missed.
    """
    spark = vectors.sparkSession
    same = ["space", "copy_a", "copy_b"]
    digests = {"copy_a": F.xxhash64("v"), "copy_b": F.xxhash64(F.lit(1), F.reverse(F.hex("v")))}
    rows = written(usable_vectors(vectors).withColumns(digests))
    ids = rows.select(*same, "vec_id")
    many = checkpoint(ids.groupBy(*same).agg(F.count("*").alias("n")).where(F.col("n") > k + 1))
    none = spark.createDataFrame([], "vec_id long, other long, d double")
    if many.isEmpty():
        kept, copies = rows.select("space", "vec_id", "v"), none
    else:
        alike = checkpoint(join_by_size(ids, many, same, how="left_semi"))
        # The first of each group: a partition hands on as many as are kept, however large the group.
        first = alike.withColumn("rank", F.row_number().over(Window.partitionBy(*same).orderBy("vec_id"))).where(F.col("rank") <= k + 1)
        first = checkpoint(first)
        surplus = checkpoint(alike.join(first.select("vec_id"), "vec_id", "left_anti"))
        lists_of = first.where(F.col("rank") <= k).groupBy(*same).agg(F.collect_list("vec_id").alias("others"))
        copies = (
            join_by_size(surplus, checkpoint(lists_of.join(many, same)), same)
            .select("vec_id", F.explode("others").alias("other"), F.lit(0.0).alias("d"))
        )
        kept = rows.select("space", "vec_id", "v").join(bounded_broadcast(surplus.select("vec_id")), "vec_id", "left_anti").select("space", "vec_id", "v")

    counts = checkpoint(kept.groupBy("space").agg(F.count("*").alias("n"), F.max(F.length("v") / 4).cast("int").alias("dims")))
    spaces = fitted_lists(kept, counts, sample, list_rows)
    shared = spark.sparkContext.broadcast(spaces)
    indexed = written(
        spread(kept.select("space", "vec_id", "v")).mapInPandas(_assign(shared, probes), "space long, vec_id long, v binary, list int, probes array<int>")
    )
    weight: dict[int, np.ndarray] = {s: np.zeros(len(c.centroids)) for s, c in spaces.items()}
    for r in indexed.groupBy("space", "list").count().collect():  # a row a list
        weight[r["space"]][r["list"]] = r["count"]
    blocks = {s: _blocks_of_lists(c.centroids, weight[s], cell_rows) for s, c in spaces.items()}
    if not blocks:
        return copies
    rows_of = spark.createDataFrame([(s, int(b), int(weight[s][of == b].sum())) for s, of in blocks.items() for b in np.unique(of)], "space long, block int, m long")
    of_lists = spark.sparkContext.broadcast(blocks)  # a number a list
    q = indexed.select("space", "probes").mapInPandas(_asked_counts(of_lists), "space long, block int, q long").groupBy("space", "block").agg(F.sum("q").alias("q"))
    loads = rows_of.join(q, ["space", "block"]).select("space", "block", F.ceil(F.col("m") / cell_rows).alias("m_parts"), F.ceil(F.col("q") / (2 * cell_rows)).alias("q_parts"))
    loads = F.broadcast(checkpoint(loads))  # a row a block, a block being some thousands of rows
    block_of = F.broadcast(spark.createDataFrame([(s, x, int(b)) for s, of in blocks.items() for x, b in enumerate(of)], "space long, list int, block int"))
    members = indexed.join(block_of, ["space", "list"])
    # A vector goes to each block that it asks with its lists there; nothing else of it moves.
    asks = indexed.mapInPandas(_asking(of_lists), "space long, vec_id long, v binary, list int, block int, probes array<int>")
    part = F.xxhash64(F.lit(5), "vec_id")
    cells = (
        members.join(loads, ["space", "block"])
        .select(
            "space", "block", F.pmod(part, "m_parts").alias("mp"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("q_parts") - 1)).alias("qp"),
            F.lit(False).alias("asks"), "vec_id", "v", "list", F.lit(None).cast("array<int>").alias("probes"),
        )
        .unionByName(
            asks.join(loads, ["space", "block"])
            .select(
                "space", "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m_parts") - 1)).alias("mp"), F.pmod(part, "q_parts").alias("qp"),
                F.lit(True).alias("asks"), "vec_id", "v", "list", "probes",
            )
        )
    )
    near = by_key(cells, "space", "block", "mp", "qp").groupBy("space", "block", "mp", "qp").applyInPandas(_search(k), "vec_id long, other long, d double")
    top = Window.partitionBy("vec_id").orderBy("d", "other")
    return near.withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= k).drop("rank").unionByName(copies)


def neighbour_pairs(near: DataFrame) -> DataFrame:
    """Pairs (vec_a < vec_b) of which at least one has the other among its neighbours."""
    return near.select(F.least("vec_id", "other").alias("vec_a"), F.greatest("vec_id", "other").alias("vec_b")).distinct()
