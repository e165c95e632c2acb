"""Passages that several documents have word for word.

Method: hashing of lines and paragraphs. Whole documents, and then lines and paragraphs long enough, are digested; digests are grouped globally; of
each the earliest occurrence is kept and the rest is removed with its offsets, being settled as shared (equal_units).
What is left, and what is kept, is searched for passages that begin and end inside a line, by windows on units that the
content itself delimits: of every 101 neighbouring windows of 50 characters the one of the least hash. A passage of 150
characters holds at least one such unit, and the same one in every document. Digests of units are grouped globally;
around those that several texts have, cells of neighbouring windows are judged at once by the text that all of them
share and by the text that they cover together, and only in the cells in which a passage begins or ends the windows
themselves. That gives the exact stretches with their offsets. No pairs of documents are made at any point.

What decides that a stretch is shared has 128 bits; 64 bits serve only to leave out what can't be.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliospark.operators.skew import join_by_size
from foliospark.session import bounded_broadcast, by_key, checkpoint, spread, written

SPAN = 150
UNIT = 50
#: Windows that are judged at once.
CELL = 16
#: Rows of a list of documents or hashes that is broadcast, after it has been counted; beyond, it is joined by a shuffle.
LISTED = 500_000

_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


def _scatter(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits (the finaliser of SplitMix64)."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=8)
def _powers(n: int, which: int) -> tuple[np.ndarray, np.ndarray]:
    one = np.ones(1, np.uint64)
    base, back = (np.uint64(x) for x in (_BASES[which], pow(_BASES[which], -1, 1 << 64)))
    with np.errstate(over="ignore"):
        return tuple(np.concatenate([one, np.cumprod(np.full(n, x, np.uint64), dtype=np.uint64)]) for x in (base, back))


def prefix_hashes(text: str, which: int = 0) -> np.ndarray:
    """Running polynomial hash of a text's characters (code points), from which that of any window follows. ``which``: one
    of two hashes that have nothing to do with each other."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = len(codes)
    up, _ = _powers(1 << max(12, n.bit_length()), which)
    with np.errstate(over="ignore"):
        spread = _scatter(codes + np.uint64(which << 32))
        return np.concatenate([np.zeros(1, np.uint64), np.cumsum(spread * up[:n], dtype=np.uint64)])


def window_hashes(prefix: np.ndarray, width: int | np.ndarray, starts: np.ndarray | None = None, which: int = 0) -> np.ndarray:
    """Hashes of the windows of ``width`` characters that begin at ``starts`` (all)."""
    n = len(prefix) - 1
    starts = np.arange(n - width + 1) if starts is None else starts
    _, down = _powers(1 << max(12, n.bit_length()), which)
    with np.errstate(over="ignore"):
        return _scatter((prefix[starts + width] - prefix[starts]) * down[starts])


def anchors(hashes: np.ndarray, among: int) -> np.ndarray:
    """Of every ``among`` neighbouring windows the first of the least hash: the unit of the passage that they make up.

    Least ones of 1, 2, 4, … neighbours come from those of half as many, the last step from two that overlap."""
    if len(hashes) < among:
        return np.zeros(0, np.int64)
    value, at, size = hashes, np.arange(len(hashes)), 1
    while size < among:
        step = min(size, among - size)
        left, right = value[: len(value) - step], value[step:]
        later = right < left
        value, at = np.where(later, right, left), np.where(later, at[step:], at[: len(at) - step])
        size += step
    return at


def unit_starts(hashes: np.ndarray, among: int) -> np.ndarray:
    """The different anchors."""
    return np.unique(anchors(hashes, among))


def _batch(parts: list[tuple], names: str) -> pa.RecordBatch | None:
    """A record batch of (rep, columns of equal length …) for each text."""
    if not parts:
        return None
    columns = {"rep": np.repeat(np.array([p[0] for p in parts], np.int64), [len(p[1]) for p in parts])}
    for k, name in enumerate(names.split(), 1):
        x = np.concatenate([p[k] for p in parts])
        columns[name] = x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int32) if x.dtype == np.int64 else x
    return pa.RecordBatch.from_pydict(columns)


def _intervals(settled, kept: bool | None = None) -> list[tuple[int, int]]:
    return [(x["start"], x["end"]) for x in settled or () if kept is None or x["kept"] == kept]


def open_starts(n: int, span: int, removed: list[tuple[int, int]]) -> np.ndarray:
    """Whether a window of ``span`` characters at each place of a text is still to be judged: it lies in no removed unit."""
    out = np.ones(max(0, n - span + 1), bool)
    for start, end in removed:
        out[start : max(start, end - span + 1)] = False
    return out


def _runs(mask: np.ndarray) -> list[tuple[int, int]]:
    """First and behind the last of each run of true values."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8)))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def _inside(starts: np.ndarray, width: int | np.ndarray, intervals: list[tuple[int, int]]) -> np.ndarray:
    """Whether the windows at starts lie in one of the intervals."""
    out = np.zeros(len(starts), bool)
    for a, b in intervals:
        out |= (starts >= a) & (starts + width <= b)
    return out


def _units(span: int, unit: int):
    """(rep, h, pos, kept) of each text's content-defined units outside of what is removed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = []
            for rep, text, settled in zip(*(b.column(x).to_pylist() for x in ("rep", "text", "settled")), strict=True):
                all_ = window_hashes(prefix_hashes(text), unit)
                found = [unit_starts(all_[a : end + span - unit], span - unit + 1) + a for a, end in _runs(open_starts(len(all_) + unit - 1, span, _intervals(settled, False)))]
                at = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
                parts.append((rep, all_[at], at, _inside(at, unit, _intervals(settled, True))))
            if (out := _batch(parts, "h pos kept")) is not None:
                yield out

    return run


def cells_of(prefix: np.ndarray, removed: list[tuple[int, int]], units: list[int], span: int, unit: int, size: int) -> tuple[np.ndarray, ...]:
    """The windows of a text that are to be judged, as (start, cell), and the cells' ids, first and last starts: windows
    whose own unit is among the common ones ``units``. Cells are counted back from that unit, so that equal windows lie in
    equal cells of any text: a window's unit depends on the window alone."""
    all_, reach = window_hashes(prefix, unit), span - unit
    starts, own = [], []
    # Only what begins up to ``reach`` before a common unit can have it as its own.
    asks = open_starts(len(prefix) - 1, span, removed)
    near = np.zeros(len(asks) + 1, np.int32)
    at = np.array(units, np.int64)
    np.add.at(near, np.minimum(np.maximum(at - reach, 0), len(asks)), 1)
    np.add.at(near, np.minimum(at + 1, len(asks)), -1)
    for a, end in _runs(asks & (np.cumsum(near)[:-1] > 0)):
        starts.append(np.arange(a, end)), own.append(anchors(all_[a : end + reach], reach + 1) + a)
    if not starts:
        none = np.zeros(0, np.int64)
        return none, none, none, none, none
    start, u = np.concatenate(starts), np.concatenate(own)
    some = np.isin(u, at)
    start, u = start[some], u[some]
    many = reach // size + 1
    id_, cell = np.unique(u * many + (u - start) // size, return_inverse=True)
    of, back = id_ // many, id_ % many
    last = of - back * size
    return start, cell, id_, np.maximum(last - size + 1, of - reach), last


def _cells(span: int, unit: int, size: int):
    """(rep, core, h, g, id, first, last, core_kept, kept) of cells: the digest of the text that all of its windows share, and
    that of the text that they cover (0 where that does not lie within the text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = []
            for rep, text, settled, units in zip(*(b.column(x).to_pylist() for x in ("rep", "text", "settled", "units")), strict=True):
                prefix, other = prefix_hashes(text), prefix_hashes(text, 1)
                n, kept = len(prefix) - 1, _intervals(settled, True)
                _, _, id_, first, last = cells_of(prefix, _intervals(settled, False), units, span, unit, size)
                width = first + span - last  # from the last start to the first end
                whole = (first >= 0) & (last + span <= n)
                a, w = first[whole], last[whole] + span - first[whole]
                h, g = np.zeros(len(first), np.uint64), np.zeros(len(first), np.uint64)
                h[whole], g[whole] = window_hashes(prefix, w, a), window_hashes(other, w, a, 1)
                in_kept = np.zeros(len(first), bool)
                in_kept[whole] = _inside(a, w, kept)
                parts.append((rep, window_hashes(prefix, width, last), h, g, id_, first, last, _inside(last, width, kept), in_kept))
            if (out := _batch(parts, "core h g id first last core_kept kept")) is not None:
                yield out

    return run


def _windows(span: int, unit: int, size: int):
    """(rep, h, g, pos, kept) of the windows of the cells that are asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = []
            for rep, text, settled, units, asked in zip(*(b.column(x).to_pylist() for x in ("rep", "text", "settled", "units", "asked")), strict=True):
                prefix, other = prefix_hashes(text), prefix_hashes(text, 1)
                start, cell, id_, _, _ = cells_of(prefix, _intervals(settled, False), units, span, unit, size)
                wanted = {x["id"]: x["kept"] for x in asked}
                some = np.array([x in wanted for x in id_.tolist()], bool)
                known = np.array([wanted.get(x, False) for x in id_.tolist()], bool)
                mine = some[cell]
                at = start[mine]
                kept = known[cell][mine] | _inside(at, span, _intervals(settled, True))
                parts.append((rep, window_hashes(prefix, span, at), window_hashes(other, span, at, 1), at, kept))
            if (out := _batch(parts, "h g pos kept")) is not None:
                yield out

    return run


def _judged(cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cells that are covered wholly by what several texts have, with the first text of each; and (rep, asked) of the cells
    whose windows decide: those whose texts agree in part, and of wholly covered ones that share their core with such
    a cell the first, which stands for the rest."""
    cores = checkpoint(_in_several(cells.select("rep", F.col("core").alias("h"), F.col("core_kept").alias("kept")), "h").withColumnRenamed("h", "core"))
    likely = checkpoint(_found(cells, cores, ["core"]))
    wholes = likely.where("h <> 0 or g <> 0")
    shared = checkpoint(_in_several(wholes, "h", "g", first=True))
    covered = checkpoint(join_by_size(wholes, shared, ["h", "g"]))
    mixed = likely.join(covered.select("rep", "id"), ["rep", "id"], "left_anti").select("rep", "core", "id")
    mixed = checkpoint(mixed)
    firsts = covered.where("rep = first_rep").join(mixed.select("core").distinct(), "core", "left_semi")
    asked = mixed.select("rep", F.struct("id", F.lit(False).alias("kept")).alias("c")).unionByName(firsts.select("rep", F.struct("id", F.lit(True).alias("kept")).alias("c")))
    return covered.select("rep", "first", "last"), asked.groupBy("rep").agg(F.collect_list("c").alias("asked"))


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("start_char", T.LongType()), T.StructField("end_char", T.LongType())])))
def _merged(stretches: pd.Series) -> pd.Series:
    """Stretches as few as possible, in order; overlapping and touching ones are one."""
    out = []
    for rows in stretches:
        merged: list[list[int]] = []
        for start, end in sorted((x["start"], x["end"]) for x in rows):
            if merged and start <= merged[-1][1]:
                merged[-1][1] = max(end, merged[-1][1])
            else:
                merged.append([start, end])
        out.append([{"start_char": a, "end_char": b} for a, b in merged])
    return pd.Series(out, dtype=object)


def _in_several(rows: DataFrame, *keys: str, first: bool = False) -> DataFrame:
    """Digests that several texts have, with how many rows have them (and ``first``: the least of the texts): those with
    two reps, or in a unit that stands for several. Texts are told apart by the least and the greatest only, which
    combines before the shuffle: a digest of a third of all rows costs a row a task."""
    several = (F.col("first_rep") != F.col("last_rep")) | F.col("kept")
    groups = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min("rep").alias("first_rep"), F.max("rep").alias("last_rep"), F.max("kept").alias("kept"))
    return groups.where(several).select(*keys, "n", *(["first_rep"] if first else []))


def _found(rows: DataFrame, shared: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` whose keys are among those of ``shared`` (with n)."""
    small = bounded_broadcast(shared.select(*keys), LISTED)
    return rows.join(small, keys, "left_semi") if shared.limit(LISTED + 1).count() <= LISTED else join_by_size(rows, shared, keys, how="left_semi")


def _with(texts: DataFrame, rows: DataFrame) -> DataFrame:
    """``texts`` joined with ``rows`` of some of them by rep: no text moves if those are few."""
    small = bounded_broadcast(rows, LISTED // 10)
    return texts.join(small, "rep") if small is not rows else by_key(texts, "rep").join(rows, "rep")


def _lines(least: int):
    """(rep, start, end, h, g) of the lines and paragraphs of texts, with their digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for rep, text in zip(b.column("rep").to_pylist(), b.column("text").to_pylist(), strict=True):
                for gap in ("\n", "\n\n") if "\n\n" in text else ("\n",):
                    at = 0
                    for part in text.split(gap):
                        if len(part) >= least and (gap == "\n" or "\n" in part):
                            digest = hashlib.blake2b(part.encode("utf-8", "surrogatepass"), digest_size=16).digest()
                            out.append((rep, at, at + len(part), *(int.from_bytes(digest[k : k + 8], "big", signed=True) for k in (0, 8))))
                        at += len(part) + len(gap)
            if out:
                rows = zip(*out, strict=True)
                yield pa.RecordBatch.from_pydict({n: pa.array(c, t) for n, c, t in zip(("rep", "start", "end", "h", "g"), rows, (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()), strict=True)})

    return run


def equal_units(texts: DataFrame, least: int = SPAN) -> DataFrame:
    """(rep, start, end, kept) of lines and paragraphs of ``least`` characters or more that several texts have: of each digest the
    earliest occurrence by (rep, start) is kept, all others are to be removed. A unit that one text alone repeats is
    not listed. ``texts``: rep, text.

    Paragraphs are what blank lines part; one that is a single line counts as that. Within a paragraph that several
    texts have its lines are listed, too; the earliest occurrence of a line is never in a removed paragraph, as the
    earliest occurrence of that would hold an earlier one.
    """
    rows = written(texts.mapInArrow(_lines(least), "rep long, start int, end int, h long, g long"))
    groups = rows.groupBy("h", "g").agg(F.count("*").alias("n"), F.min(F.struct("rep", "start")).alias("first"), F.max("rep").alias("last"))
    groups = checkpoint(groups.where(F.col("first.rep") != F.col("last")).select("h", "g", "n", "first"))
    is_first = (F.col("rep") == F.col("first.rep")) & (F.col("start") == F.col("first.start"))
    return join_by_size(rows, groups, ["h", "g"]).select("rep", "start", "end", is_first.alias("kept"))


def _texts(documents: DataFrame, span: int) -> tuple[DataFrame, DataFrame]:
    """(rep, text) of each distinct text, and the ids of documents whose whole text another document has: the earliest
    document of equal ones is kept, the rest removed. Texts do not move for that, their digests do."""
    docs = spread(documents.select("doc_id", "text")).where(F.col("doc_id").isNotNull() & (F.length("text") >= span))
    keys = checkpoint(docs.select("doc_id", F.xxhash64("text").alias("h"), F.xxhash64(F.lit(1), F.reverse("text")).alias("g"), F.length("text").cast("long").alias("n_chars")))
    groups = keys.groupBy("h", "g").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last"), F.count("*").alias("n"))
    copies = checkpoint(groups.where("rep <> last").select("h", "g", "rep", "n"))
    copied = checkpoint(join_by_size(keys, copies, ["h", "g"]).select("doc_id", "n_chars", "rep", "h").distinct())
    removed = copied.where("doc_id <> rep").select("doc_id", "h")
    # A doc_id may have two texts: it is its text, by the hash, that is removed.
    known = docs.withColumn("h", F.xxhash64("text")) if not removed.isEmpty() else docs
    left = known.join(bounded_broadcast(removed, LISTED), ["doc_id", "h"], "left_anti") if known is not docs else docs
    return left.select(F.col("doc_id").alias("rep"), "text"), copied.select("doc_id", "n_chars").distinct()


def shared_spans(documents: DataFrame, span: int = SPAN, unit: int = UNIT, cell: int = CELL) -> DataFrame:
    """(doc_id, start_char, end_char): maximal stretches covered by passages of ``span`` or more characters that occur
    unchanged in a text of another doc_id. Offsets count code points, end_char is exclusive.

    Null, empty and shorter texts, and rows without doc_id, have none. A passage repeated within one document alone is not shared. A row sent
    twice (same doc_id) counts once; a doc_id with two texts counts as one document that has both stretches.
    """
    texts, copied = _texts(documents, span)
    settled = checkpoint(equal_units(texts, span))
    lists = settled.groupBy("rep").agg(F.array_sort(F.collect_set(F.struct("start", "end", "kept"))).alias("settled"))
    lists = checkpoint(lists)
    small = bounded_broadcast(lists, LISTED // 10)
    texts = texts.join(small, "rep", "left")
    # A kept unit stands for those that are removed: what lies in it several texts have.
    units = written(texts.mapInArrow(_units(span, unit), "rep long, h long, pos int, kept boolean"))
    near = checkpoint(_found(units, checkpoint(_in_several(units, "h")), ["h"]).groupBy("rep").agg(F.collect_set("pos").alias("units")))
    around = _with(texts, near)
    cells = written(around.mapInArrow(_cells(span, unit, cell), "rep long, core long, h long, g long, id int, first int, last int, core_kept boolean, kept boolean"))
    covered, asked = _judged(cells)
    windows = written(_with(texts, checkpoint(near.join(asked, "rep"))).mapInArrow(_windows(span, unit, cell), "rep long, h long, g long, pos int, kept boolean"))
    single = _found(windows, checkpoint(_in_several(windows, "h", "g")), ["h", "g"]).select("rep", F.col("pos").alias("start"), (F.col("pos") + span).alias("end"))
    covered = covered.select("rep", F.col("first").alias("start"), (F.col("last") + span).alias("end"))
    found = (
        single.unionByName(covered)
        .unionByName(settled.select("rep", "start", "end"))
        .groupBy("rep")
        .agg(F.collect_list(F.struct("start", "end")).alias("s"))
        .select(F.col("rep").alias("doc_id"), F.explode(_merged("s")).alias("s"))
        .select("doc_id", "s.*")
    )
    whole = copied.select("doc_id", F.lit(0).cast("long").alias("start_char"), F.col("n_chars").alias("end_char"))
    # A copied text is covered wholly; stretches of its representative are then parts of that.
    return whole.unionByName(found.join(whole.select("doc_id").distinct(), "doc_id", "left_anti"))


def shared_share(documents: DataFrame, spans: DataFrame) -> DataFrame:
    """(doc_id, n_chars, shared_chars, share) of every document; null and empty texts share nothing (share 0)."""
    chars = spans.groupBy("doc_id").agg(F.sum(F.col("end_char") - F.col("start_char")).alias("shared_chars"))
    return (
        documents.groupBy("doc_id")
        .agg(F.max(F.coalesce(F.length("text"), F.lit(0)).cast("long")).alias("n_chars"))
        .join(chars, "doc_id", "left")
        .fillna(0, ["shared_chars"])
        .select("doc_id", "n_chars", "shared_chars", F.coalesce(F.try_divide("shared_chars", "n_chars"), F.lit(0.0)).alias("share"))
    )


def line_repeats(documents: DataFrame, least: int = SPAN) -> DataFrame:
    """(doc_id, start_char, end_char, kept_doc_id): lines that an earlier document has and that may be removed.

    Lines (of ``least`` or more characters after their white space is made even) are digested; of each digest the
    occurrence of the lowest (doc_id, start_char) stays, all others are listed with their offsets in the text as it is.
    A line repeated within its own document is listed as well. Null and empty texts have no lines. A row sent twice
    counts once.
    """
    lines = (
        documents.where(F.length("text") > 0)
        .select("doc_id", "text")
        .distinct()
        .select("doc_id", F.xxhash64("text").alias("which"), F.posexplode(F.split("text", "\n")).alias("no", "line"))
        .withColumn(
            "start_char",
            F.coalesce(
                F.sum(F.length("line") + 1).over(Window.partitionBy("doc_id", "which").orderBy("no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
            ),
        )
        .withColumn("unit", F.trim(F.regexp_replace("line", "\\s+", " ")))
        .where(F.length("unit") >= least)
        .select("doc_id", "start_char", (F.col("start_char") + F.length("line")).alias("end_char"), F.sha2("unit", 256).alias("digest"))
        .distinct()
    )
    lines = checkpoint(lines)
    first = checkpoint(
        lines.groupBy("digest").agg(F.min(F.struct("doc_id", "start_char")).alias("kept"), F.count("*").alias("n")).where("n > 1")
    )
    return (
        join_by_size(lines, first, ["digest"])
        .where((F.col("doc_id") != F.col("kept.doc_id")) | (F.col("start_char") != F.col("kept.start_char")))
        .select("doc_id", "start_char", "end_char", F.col("kept.doc_id").alias("kept_doc_id"))
    )
