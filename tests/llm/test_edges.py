"""Every operator: nulls in any column, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from foliospark.llm import mixing, neighbours, reading, scans, sentences, spans, tokens

LINES = "line_id long, result_id long, source_id string, page_id string, box_id string, reading_order int, text string"
RESULTS = "result_id long, source_id string, page_id string, raw_text string"
DOCS = "doc_id long, text string, source string"
VECTORS = "vec_id long, entity_type string, modality string, provider string, model string, version string, dimension int, preprocessing_hash string, vector array<float>, arrived_at timestamp"
FUNCTIONS = "functions array<struct<supports: array<struct<support_id: long, kind: string, reference_id: string, quote: string>>>>"
LINKS = "functional_drafts array<struct<supports: array<struct<support_id: long, item_id: string, quote: string>>>>"
T0 = datetime(2025, 1, 1)


def extra(df):
    """Columns whose names an operator uses itself."""
    names = ["h", "rep", "pos", "n", "block", "rank", "kept", "digest", "title", "key", "space", "v", "at", "head", "word", "p", "form"]
    return df.withColumns({x: F.lit("x") for x in names if x not in df.columns})


def nulled(df):
    """The rows, and each again with one column null."""
    out = df
    for c in df.columns:
        out = out.unionByName(df.withColumn(c, F.lit(None).cast(df.schema[c].dataType)))
    return out


def lines(spark, rows):
    return spark.createDataFrame(rows, LINES)


SOME_LINES = [
    (1, 1, "s", "p1", "b1", 0, "THE BOOK OF MILLS"),
    (2, 1, "s", "p1", "b2", 1, "The weaver turns the water-"),
    (3, 1, "s", "p1", "b3", 2, "wheel. " + "long " * 20_000),
    (4, 1, "s", "p1", "b4", 3, ""),
    (5, 1, "s", "p1", "b5", 4, "- 12 -"),
    (5, 1, "s", "p1", "b5", 4, "- 12 -"),
    (6, 2, "s", "p2", "b2", 0, "​ \t"),
]


def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS)


def texts():
    long = "".join(chr(0x4E00 + i * 7919 % 20000) for i in range(30_000))
    return [(1, "a" * 100 + "b" * 100, "x"), (2, "zz" + "a" * 100 + "b" * 100, "x"), (3, None, "x"), (4, "", None), (5, long, "y"), (6, long, "y"), (6, long, "y"), (7, " \n", "y")]


def vectors(spark):
    base = ("figure", "text", "p", "m", "1", 4, "h")
    rows = [(i, *base, [float(i % 5), 1.0, 0.5, float(i % 3)], T0) for i in range(40)]
    rows += [(100, *base, None, T0), (101, *base, [], T0), (102, *base, [0.0] * 4, T0), (103, *base, [1.0], T0), (104, *base, [float("nan")] * 4, T0), (0, *base, [0.0, 1.0, 0.5, 0.0], T0)]
    return spark.createDataFrame(rows, VECTORS)


def quotes(spark):
    f = spark.createDataFrame([([([(1, "raw_ocr", "b1", "ТHЕ BOOK"), (2, "raw_ocr", None, "x"), (3, None, "b1", None)],)],), (None,), ([(None,)],)], FUNCTIONS)
    k = spark.createDataFrame([([([(1, "b1", "THE ВOOK"), (None, "b1", "q")],)],), (None,)], LINKS)
    return f, k


CASES = {
    "noise": lambda s, w: scans.page_noise(w(lines(s, SOME_LINES))),
    "sentences": lambda s, w: sentences.sentences(w(s.createDataFrame([(1, "s", "p", "One. Two"), (1, "s", "p", "One. Two"), (2, "s", "p", ""), (3, "s", "p", "w " * 50_000)], RESULTS))),
    "same reading": lambda s, w: reading.same_reading(w(lines(s, SOME_LINES)), *map(w, quotes(s))),
    "neighbours": lambda s, w: neighbours.nearest(w(vectors(s))),
    "ids": lambda s, w: tokens.encode_documents(w(docs(s, texts()))),
    "mixture": lambda s, w: mixing.mix(w(docs(s, texts())), s.createDataFrame([("x", 0.5, 2), ("y", 0.5, 1), ("z", 0.1, 3)], "source string, target_share double, max_passes int")),
    "spans": lambda s, w: spans.shared_spans(w(docs(s, texts()))),
    "lines of texts": lambda s, w: spans.line_repeats(w(docs(s, texts()))),
}


@pytest.mark.parametrize("name", CASES)
def test_extra_columns_change_nothing(spark, name):
    plain, more = (sorted(map(str, CASES[name](spark, w).collect())) for w in (lambda df: df, extra))
    assert plain == more


@pytest.mark.parametrize("name", CASES)
def test_nulls_in_any_column(spark, name):
    CASES[name](spark, nulled).collect()


@pytest.mark.parametrize("name", CASES)
def test_empty_tables(spark, name):
    assert CASES[name](spark, lambda df: df.limit(0)).collect() == []


@pytest.mark.parametrize("name", [x for x in CASES if x not in ("ids",)])
def test_repeated_rows_change_nothing(spark, name):
    once, twice = (sorted(map(str, CASES[name](spark, w).collect())) for w in (lambda df: df, lambda df: df.unionByName(df)))
    assert once == twice
