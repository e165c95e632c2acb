"""Core operators against small cases with known results."""

import hashlib
import json
import math
import random
import struct
import zlib
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliospark.functions import geometry as G
from foliospark.functions import ids, score, text
from foliospark.operators import bm25, cfr, evidence, integrity, layout, metrics, orphans, review, search, similarity, skew, spatial, vectors
from foliospark import plans, session
from foliospark.sources import files, recognition, storage


def value(spark, column, schema="a int", row=(1,)):
    return spark.createDataFrame([row], schema).select(column.alias("x")).first()["x"]


def arr(*xs):
    return F.array(*[F.lit(float(x)) for x in xs])


# -- scores


def test_cosine_guards(spark):
    cases = [([1e308, 1e308], [1e308, -1e308], 0.0), ([], [], 0.0), ([0, 0], [1, 1], 0.0), ([1], [1, 1], 0.0), ([math.nan, 1], [1, 1], 0.0), ([3, 4], [3, 4], 1.0)]
    for a, b, want in cases:
        got = value(spark, score.cosine(F.col("p"), F.col("q")), "p array<double>, q array<double>", ([float(x) for x in a], [float(x) for x in b]))
        assert got == pytest.approx(want, abs=1e-12)
    assert value(spark, score.cosine(F.col("p"), F.col("q")), "p array<double>, q array<double>", (None, [1.0])) == 0.0


def test_scaling(spark):
    assert value(spark, score.clip(F.lit(2.0))) == 1.0
    assert value(spark, score.clip(F.lit(float("nan")))) == 0.0
    assert value(spark, score.clip(F.lit(None).cast("double"))) == 0.0
    assert value(spark, score.normalize_score(F.lit(7.0), F.lit(3.0), F.lit(3.0))) == 0.5
    assert value(spark, score.l2_normalize(arr(0, 0))) == [0.0, 0.0]
    assert value(spark, score.l2_normalize(arr(3, 4))) == [0.6, 0.8]


def test_entropy(spark):
    for xs, want in [([1], 0.0), ([1, 1], 1.0), ([1, 0], 0.0), ([0, 0], 1.0)]:
        assert value(spark, score.entropy(arr(*xs))) == pytest.approx(want)
    assert value(spark, score.model_uncertainty(F.lit(None).cast("array<double>"))) is None
    assert value(spark, score.model_uncertainty(arr(0.9))) == 0.0
    assert value(spark, score.model_uncertainty(arr(0.5, 0.5))) == pytest.approx(1.0)


def test_fusion(spark):
    only = value(spark, score.fuse({"sv": F.lit(1.0)}, {"sv": 0.5}))
    assert only["score"] == 0.5 and set(only["missing"]) == {"text", "region", "function", "graph", "evidence", "model_uncertainty"}
    every = {k: F.lit(1.0) for k in score.NAMES}
    assert value(spark, score.fuse(every))["score"] == pytest.approx(sum(score.WEIGHTS.values()))
    assert value(spark, score.fuse(every, available={"st": F.lit(False)}))["score"] == pytest.approx(sum(score.WEIGHTS.values()) - 0.25)
    assert value(spark, score.fuse(every, reliability={"sf": F.lit(0.5)}))["score"] == pytest.approx(sum(score.WEIGHTS.values()) - 0.1)


# -- words


def test_lexical_tokens(spark):
    get = lambda t: value(spark, text.lexical_tokens(F.lit(t)))
    assert get("水轮提水 Gear-Drive") == ["水", "轮", "提", "水", "水轮", "轮提", "提水", "gear-drive"]
    assert get("水") == ["水"] and get("") == []
    assert value(spark, text.lexical_tokens(F.lit(None).cast("string"))) is None


def test_word_tokens_and_error_rates(spark):
    assert len(value(spark, text.word_tokens(F.lit("治絲圖 PP-OCR 5")))) == 7
    one = metrics.error_rates(spark.createDataFrame([("中", "中國中國")], "truth string, prediction string")).first()
    assert one["cer"] == 3.0 and one["ter"] == 3.0
    both = metrics.error_rates(spark.createDataFrame([("中", "中國中國"), ("文書", "文書")], "truth string, prediction string")).first()
    assert both["cer"] == 1.0
    none = metrics.error_rates(spark.createDataFrame([], "truth string, prediction string")).first()
    assert none["cer"] is None
    odd = metrics.error_rates(spark.createDataFrame([(None, "a"), ("a b", None)], "truth string, prediction string")).first()
    assert odd["char_edits"] == 3 and odd["char_total"] == 2


def test_bm25_against_the_formula(spark):
    docs = spark.createDataFrame([(1, "mill mill wheel"), (2, "wheel"), (3, None), (4, "")], "doc_id long, text string")
    q = spark.createDataFrame([("q", "mill wheel wheel")], "query_id string, text string")
    got = {r["doc_id"]: r["score"] for r in bm25.bm25_scores(docs, q).collect()}

    def term(tf, df, length, boost):
        avg = 4 / 4
        return boost * math.log(1 + (4 - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / avg))

    assert got[1] == pytest.approx(term(2, 1, 3, 1) + term(1, 2, 3, 1 + math.log(2)))
    assert got[2] == pytest.approx(term(1, 2, 1, 1 + math.log(2))) and set(got) == {1, 2}
    ties = spark.createDataFrame([("q", 2, 1.0), ("q", 1, 1.0), ("q", 3, 2.0)], "query_id string, doc_id long, score double")
    assert [r["doc_id"] for r in bm25.top_k(ties, 2).orderBy("rank").collect()] == [3, 1]


def test_concepts(spark):
    docs = spark.createDataFrame([(1, "水轮 GEAR gear 齿轮"), (2, None), (3, "nothing")], "doc_id long, text string")
    rows = cfr.extract(docs, cfr.vocabulary(spark)).collect()
    got = {(r["doc_id"], r["slot"], r["concept"]): (round(r["confidence"], 6), r["terms"]) for r in rows}
    assert got[1, "transmission", "gear"] == (0.8, ["齿轮", "gear"])
    assert got[1, "power_source", "water_power"][0] == 0.7
    assert {k[2] for k in got if k[0] == 2} == {"unknown"} and len([k for k in got if k[0] == 3]) == 6
    over = cfr.overlaid(cfr.vocabulary_rows(), [("action", "grinding", ["pound"], True), ("action", "weaving", ["loom"], False)])
    assert [t for s, c, t, _ in over if c == "grinding"] == ["pound"] and "loom" in [t for s, c, t, _ in over if c == "weaving"]


def test_markup_paths_and_times(spark):
    assert value(spark, text.clean_markup(F.lit("'''a''' {{x|{{y}}}}[[p|b]]<ref>r</ref>&amp;<br/>\n  c "))) == "a b&\nc"
    assert value(spark, text.clean_path(F.lit("a\\b/c"))) == "a/b/c"
    assert value(spark, text.clean_path(F.lit("a/../c"))) is None
    assert value(spark, text.zoned_timestamp(F.lit("2025-01-01T00:00:00"))) is None
    assert value(spark, text.zoned_timestamp(F.lit("2025-01-01T00:00:00Z"))) is not None
    assert value(spark, text.folded_key(F.lit(" ＳTRAßE "))) == "strasse"


# -- sets and evidence


def test_weighted_jaccard(spark):
    s = "doc_id string, k string, w double"
    q = spark.createDataFrame([("q", "a", 0.8), ("q", "b", 0.1)], s).withColumnRenamed("doc_id", "query_id")
    c = spark.createDataFrame([("c", "a", 0.9), ("c", "d", 1.0), ("x", "z", 1.0)], s)
    rows = similarity.weighted_jaccard(q, c, ["k"]).collect()
    assert len(rows) == 1 and rows[0]["score"] == pytest.approx(0.8 / (0.9 + 0.1 + 1.0)) and rows[0]["n_matched"] == 1
    w = similarity.key_weights(spark.createDataFrame([("o", "k", 0.9), ("o", "k", 0.7), ("o", "n", math.nan), ("o", "l", 0.2)], s).withColumnRenamed("doc_id", "o"), "o", ["k"], "w", at_least=0.7)
    assert [tuple(r) for r in w.collect()] == [("o", "k", 0.9)]


def sets(rng, owners, keys, have):
    return [(f"o{o}", None if k == 0 else f"k{k}", k % 3, round(rng.choice([0.0, 0.3, 0.7, 0.72, 1.0]), 2)) for o in owners for k in rng.sample(range(keys), have)]


@pytest.mark.parametrize("have", [2, 8])
def test_best_jaccard(spark, monkeypatch, have):
    """As the join of all pairs, with keys that few or most queries have, null keys, weights of 0, ties and several blocks."""
    rng = random.Random(have)
    s = "doc_id string, k string, l int, w double"
    rows = spark.createDataFrame(sets(rng, range(60), 12 if have == 8 else 40, have) + [("o9x", "elsewhere", 1, 0.5), (None, "k1", 1, 0.9)], s).repartition(3)
    q = rows.where("doc_id like 'o%0' or doc_id = 'o9x' or doc_id = 'o7'").withColumnRenamed("doc_id", "query_id")
    columns = ["query_id", "doc_id", "n_query", "n_candidate", "n_matched", "rank"]
    want = bm25.top_k(similarity.weighted_jaccard(q, rows, ["k", "l"]).where("query_id <> doc_id"), 4).orderBy("query_id", "rank").collect()
    for values in (similarity.QUERY_VALUES, 5):
        monkeypatch.setattr(similarity, "QUERY_VALUES", values)
        got = similarity.best_jaccard(q, rows, ["k", "l"], 4).orderBy("query_id", "rank").collect()
        assert [[r[c] for c in columns] for r in got] == [[r[c] for c in columns] for r in want]
        assert [r["score"] for r in got] == pytest.approx([r["score"] for r in want], abs=1e-11)
    assert similarity.best_jaccard(q.limit(0), rows, ["k", "l"], 4).count() == 0 and similarity.best_jaccard(q, rows.limit(0), ["k", "l"], 4).count() == 0


def test_best_sets_by_lists_and_by_table():
    rng = np.random.default_rng(1)
    size, terms = 7, 40
    at = np.sort(rng.permutation(size * terms)[:120])
    of, weight, begins = at % size, rng.random(120), np.searchsorted(at, np.arange(terms + 1) * size)
    rows = np.sort(rng.permutation(5 * terms)[:130])
    mine = (rows % terms, rng.random(130), rows // terms, 5)
    for a, b in zip(similarity._listed(begins, of, weight, size)(*mine), similarity._tabled(begins, of, weight, size)(*mine), strict=True):
        assert a == pytest.approx(b, abs=1e-12) and a.shape == (5, size) and a.sum() > 0


def test_graph_jaccard_shuffles_no_pairs(spark, tmp_path):
    """60 queries and 3 000 suppliers have the same 10 edges, so that all 180 000 pairs have common keys."""
    items = spark.range(3_000).selectExpr("id as l_suppkey", "explode(sequence(1, 10)) as l_linenumber").selectExpr("*", "'A' as l_returnflag", "cast(l_linenumber as double) as l_quantity", "(l_suppkey + l_linenumber) % 7 / 100.0D as l_discount")
    items.write.parquet(str(tmp_path / "lineitem.parquet"))
    context = spark.sparkContext

    def stages():
        context._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        found = context._jsc.sc().statusStore().stageList(None, False, False, context._gateway.new_array(context._jvm.double, 0), None)
        return {found.apply(i).stageId(): found.apply(i).shuffleWriteRecords() for i in range(found.size())}

    last = max(stages(), default=-1)
    rows = plans.QUERIES["q_graph_jaccard"](spark, str(tmp_path)).collect()
    assert len(rows) == 600 and 0 < sum(n for k, n in stages().items() if k > last) < 180_000


def test_evidence_coverage(spark):
    claims = spark.createDataFrame([("q", "gear"), ("q", "Wheel"), ("q", " "), ("q", None)], "query_id string, claim string")
    ev = spark.createDataFrame([("d", "the gear box", "Verified"), ("d", "wheel", "documented"), ("e", "long unrelated text", "verified"), ("f", "x", None), ("f", None, "verified")], "doc_id string, value string, state string")
    assert [(r["doc_id"], round(r["coverage"], 6)) for r in similarity.evidence_coverage(claims, ev).collect()] == [("d", 0.95)]
    one = similarity.evidence_coverage(spark.createDataFrame([("q", "ab")], "query_id string, claim string"), spark.createDataFrame([("d", "b", "verified")], "doc_id string, value string, state string"))
    assert one.first()["coverage"] == 1.0


def test_sets(spark):
    a, b = F.array(F.lit("x"), F.lit("y")), F.array(F.lit("y"))
    assert value(spark, similarity.set_jaccard(a, b)) == 0.5
    assert value(spark, similarity.set_jaccard(a, F.array().cast("array<string>"))) is None
    assert value(spark, similarity.function_coverage(a, b)) == 0.25


# -- boxes


def box(x, y, w, h):
    return F.struct(F.lit(x).cast("double").alias("x"), F.lit(y).cast("double").alias("y"), F.lit(w).cast("double").alias("width"), F.lit(h).cast("double").alias("height"))


def test_boxes(spark):
    assert value(spark, G.bbox_valid(box(0, 0, 1, 1))) is True
    assert value(spark, G.bbox_valid(box(0.5, 0, 0.6, 1))) is False
    assert value(spark, G.bbox_valid(box(math.nan, 0, 0.5, 0.5))) is False
    assert value(spark, G.bbox_valid(box(None, 0, 0.5, 0.5))) is False
    assert value(spark, G.contains_box(box(0, 0, 1, 1), box(0.1, 0.1, 0.5, 0.5))) is True
    assert value(spark, G.iou(box(0, 0, 0.5, 1), box(0.25, 0, 0.5, 1))) == pytest.approx(1 / 3)
    square = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in [(0, 0), (2, 0), (2, 2), (0, 2)]])
    assert value(spark, G.polygon_area(square)) == 4.0 and value(spark, G.polygon_bounds(square))["x_max"] == 2.0
    assert tuple(value(spark, G.crop_pixels(box(0.999, 0, 0.001, 0.5), F.lit(100), F.lit(10)))) == (99, 0, 100, 5)
    assert value(spark, G.pixel_to_unit(arr(1, 2), F.lit(10), F.lit(10))) is None


def test_located(spark):
    crop, page = box(0, 0, 0.5, 0.5), F.lit("p")
    inside = '{"page_id":"p","bbox":{"x":0.1,"y":0.1,"width":0.1,"height":0.1}}'
    for pointer, want in [(inside, True), (inside.replace('"p"', '"q"'), False), ("no json", False), ("[]", False), ('{"supports":[]}', False), (None, False)]:
        assert value(spark, spatial.located(F.lit(pointer).cast("string"), crop, page)) is want


def test_recall_gives_each_box_once(spark):
    s = "page_id string, id string, bbox struct<x: double, y: double, width: double, height: double>"
    b = (0.1, 0.1, 0.2, 0.2)
    truth = spark.createDataFrame([("p", "t1", b), ("p", "t2", b), ("q", "t3", b)], s)
    found = spark.createDataFrame([("p", "f1", b)], s)
    assert {tuple(r) for r in metrics.box_recall(truth, found).collect()} == {("p", 1, 2), ("q", 0, 1)}


# -- order


def test_reading_order_goes_from_right_to_left(spark):
    boxes = [("0", 100.0, 120.0, 10.0), ("1", 300.0, 320.0, 10.0), ("2", 900.0, 920.0, 10.0), ("3", 900.0, 920.0, 90.0), ("4", 20.0, 40.0, 5.0)]
    df = spark.createDataFrame([("p", *b, 1000) for b in boxes], "page_id string, box_id string, x_min double, x_max double, y_min double, page_width int")
    assert [r["box_id"] for r in layout.reading_order(df).orderBy("position").collect()] == ["2", "3", "1", "0", "4"]


def brute_alignment(lines, reference):
    """Every start and length in order, the first of the greatest score."""
    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    at, begun, out = 0, False, []
    for line in lines:
        n, best = len(line), None
        for s in (range(max(0, at - 4), min(len(reference), at + 80) + 1) if begun else range(len(reference) + 1)) if n else ():
            for length in range(max(1, n - 8), n + 11):
                part = reference[s : s + length]
                if part:
                    alike = 1 - edits(line, part) / max(n, len(part))
                    score = alike - (0.003 * abs(s - at) if begun else 0)
                    if best is None or score > best[0] + 1e-12:
                        best = (score, s, s + len(part), alike)
        if best is None:
            out.append((at, at, 0.0))
        else:
            at, begun = best[2], True
            out.append((best[1], best[2], max(0.0, min(1.0, best[3]))))
    return out


def test_alignment_is_that_of_brute_force(spark):
    rng = random.Random(8)
    rows, want = [], {}
    for section in range(6):
        reference = "".join(rng.choice("水車木軸磨輪竹絲") for _ in range(rng.choice([0, 5, 160])))
        at, lines = rng.randint(0, 30), []
        while at < len(reference) and len(lines) < 9:
            n = rng.randint(3, 14)
            lines.append("".join(c if rng.random() < 0.85 else rng.choice("水鐵") for c in reference[at : at + n]))
            at += n + rng.choice([0, 0, 0, 4])
        lines.insert(1, "")
        lines.append("鐵鐵鐵")
        rows += [(section, 100 * section + k, k, f"a {x}!", f"x{reference}\n") for k, x in enumerate(lines)]
        want |= {100 * section + k: r for k, r in enumerate(brute_alignment(lines, reference))}
    df = spark.createDataFrame(rows, "section long, line_id long, position int, text string, reference string")
    got = {r["line_id"]: (r["start"], r["stop"], r["similarity"]) for r in layout.greedy_alignment(df).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_alignment_may_start_anywhere_and_goes_on(spark):
    ref = "the oiled wheel turns the crude hammer before the harvest begins"
    df = spark.createDataFrame([(1, 10, 0, "turns tho crude", ref), (1, 11, 1, "hammer bef0re the", ref), (1, 12, 2, "", ref), (2, 13, 0, "x", ""), (3, 14, 0, None, None)], "section long, line_id long, position int, text string, reference string")
    got = {r["line_id"]: (r["start"], r["stop"]) for r in layout.greedy_alignment(df, None).collect()}
    assert ref[slice(*got[10])] == "turns the crude" and ref[slice(*got[11])].strip() == "hammer before the" and got[12] == (got[11][1],) * 2 and got[13] == got[14] == (0, 0)


def test_sections_go_on_over_pages(spark):
    rows = [("s", 1, 1, "a"), ("s", 1, 2, None), ("s", 2, 1, None), ("s", 3, 1, None), ("s", 3, 2, "b"), ("s", 3, 3, None), ("t", 1, 1, None)]
    df = layout.filled_sections(spark.createDataFrame(rows, "source string, page int, n int, anchor string"), "source", ["page"], "n", "anchor")
    got = {(r["source"], r["page"], r["n"]): r["section"] for r in df.collect()}
    assert got == {("s", 1, 1): "a", ("s", 1, 2): "a", ("s", 2, 1): "a", ("s", 3, 1): "a", ("s", 3, 2): "b", ("s", 3, 3): "b", ("t", 1, 1): None}
    assert [r["source"] for r in layout.unanchored(df, F.lit(True)).collect()] == ["t"]


def test_matchings_are_maximal():
    def brute(edges):
        best = 0
        order = list(edges)

        def go(i, used):
            nonlocal best
            best = max(best, len(used))
            for k in range(i, len(order)):
                for f in edges[order[k]]:
                    if f not in used:
                        go(k + 1, used | {f})

        go(0, frozenset())
        return best

    rng = random.Random(2)
    for _ in range(200):
        edges = {t: sorted({rng.randint(0, 5) for _ in range(rng.randint(1, 3))}) for t in range(rng.randint(0, 6))}
        assert metrics.matched_pairs(edges) == brute(edges)
    n = 5000  # a path that a recursion could not follow
    assert metrics.matched_pairs({t: [f for f in (t, t + 1) if f < n] for t in range(n, -1, -1) if t < n}) == n


def test_roles_of_boxes(spark):
    rows = [
        (1, 0, 500, 10, 600, 500, "x", "book_title"), (2, 0, 500, 10, 600, 500, "十三号", "repository_mark"), (2, 1, 10, 10, 60, 200, "天工開物", "running_title"), (2, 2, 10, 10, 60, 200, "三", "folio_mark"),
        (2, 3, 500, 10, 560, 200, "水 7", "interlinear_annotation"), (2, 4, 500, 10, 520, 60, "水", "recognition_fragment"), (7, 0, 500, 10, 560, 200, "水輪", "component_label"), (9, 1, 500, 10, 560, 200, "圖", "figure_title"),
        (2, 5, 500, 10, 560, 200, "蠶浴", "section_heading"), (2, 6, 500, 10, 560, 500, "水", "body"), (2, 7, 500, 10, 560, 200, None, "interlinear_annotation"), (3, 1, 10, 10, 60, 200, "x", "section_heading"),
    ]
    df = spark.createDataFrame([(*r[:6], 1000, 1000, *r[6:]) for r in rows], "page_no int, box_index int, x_min int, y_min int, x_max int, y_max int, page_width int, page_height int, text string, want string")
    known = spark.createDataFrame([(3, 1, "蠶種")], "page_no int, box_index int, candidate string")
    titles = spark.createDataFrame([(9, 1, "水車圖")], "page_no int, box_index int, candidate string")
    out = layout.roles(df, [7], known, titles).collect()
    assert [r["role"] for r in out] == [r["want"] for r in out]
    assert {(r["box_index"], r["candidate"]) for r in out if r["candidate"]} == {(1, "蠶種"), (1, "水車圖"), (5, "蠶浴")}


def test_review_of_boxes(spark):
    schema = "raw_text string, server_text string, server_confidence double, reference_text string, category string, role string, role_confidence double, candidate string"
    rows = [("水車", "水車", 0.95, None, "text", "body", 0.96, None), ("水車", "木車", 0.95, "石磨", "text", "body", 0.96, None), ("x", None, None, None, "text", "body", 0.96, None), ("蠶洛", None, None, None, "text", "section_heading", 0.9, "蠶浴")]
    got = review.review_candidates(spark.createDataFrame(rows, schema)).collect()
    assert [r["candidate_texts"] for r in got] == [["水車"], ["水車", "木車", "石磨"], ["x"], ["蠶洛", "蠶浴"]]
    assert [r["agreement"] for r in got] == pytest.approx([1.0, 0.5, 1.0, 0.5]) and [r["needs_review"] for r in got] == [False, True, False, True]
    assert got[3]["consensus"]["basis"] == "controlled_title_candidate" and got[3]["consensus"]["text"] == "蠶浴"

    def reasons(*values):
        names = ("category", "role", "role_confidence", "server_confidence", "place_confidence", "n", "best")
        df = spark.createDataFrame([values], "category string, role string, role_confidence double, server_confidence double, place_confidence double, n int, best double")
        return df.select(review.review_reasons(*[F.col(c) for c in names]).alias("r")).first()["r"]

    assert reasons("caption", "figure_title", 0.93, 0.5, 0.4, 3, 0.85) == ["figure_title_or_component_label", "low_server_confidence", "low_reference_alignment", "three_way_text_conflict"]
    assert reasons("annotation", "recognition_fragment", None, 0.5, None, 1, 0.0) == ["recognition_fragment", "low_category_confidence"]
    assert reasons("text", "body", 0.92, None, None, 2, 0.8) == ["no_high_agreement_pair"] and reasons("text", "body", 0.92, None, None, 3, 0.9) == []
    assert reasons("text", "section_heading", 0.9, None, None, 1, 0.0) == ["section_heading", "missing_secondary_candidate"]


def test_supports_and_attachments(spark):
    s = spark.createDataFrame([(1, "f", "raw_ocr", "b", "oiled"), (2, "f", "raw_ocr", "b", "Oiled"), (3, "g", "raw_ocr", "b", "oiled"), (4, "f", "raw_ocr", "c", "x"), (5, "f", "scan_region", "r", None), (6, "f", "raw_ocr", None, "x")], "support_id long, owner string, kind string, reference_id string, quote string")
    t = spark.createDataFrame([("raw_ocr", "b", "f", "the oiled wheel"), ("raw_ocr", "b", "f", "the oi1ed wheel"), ("scan_region", "r", "f", None)], "kind string, reference_id string, owner string, content string")
    got = {r["support_id"]: (r["binding"], r["n_targets"]) for r in evidence.bound_supports(s, t).collect() if r["reference_id"]}
    assert got == {1: ("bound", 2), 2: ("absent", 2), 3: ("foreign", 2), 4: ("missing", 0), 5: ("bound", 1)}
    p = spark.createDataFrame([("f", "p", "t", ["l", "l"], ["x"], [("t", "mill"), ("z", "q")])], "figure_id string, page_id string, title_id string, label_ids array<string>, context_ids array<string>, supports array<struct<item_id: string, quote: string>>")
    i = spark.createDataFrame([("t", "p", "The mi11"), ("l", "o", "x"), ("z", "p", "q")], "item_id string, page_id string, text string")
    got = {tuple(r) for r in evidence.attachment_problems(p, i, spark.createDataFrame([("f",), ("g",)], "figure_id string")).collect()}
    assert got == {("f", "x", "unknown"), ("f", "l", "other_page"), ("f", "l", "attached_twice"), ("f", "z", "not_attached"), ("f", "t", "quote_absent"), ("g", None, "not_linked")}


def test_traces_and_marks(spark):
    box = {"x": 0.1, "y": 0.1, "width": 0.2, "height": 0.2}
    traces = f"array(named_struct('text_id', 't', 'page_id', 'p', 'bbox', named_struct('x', 0.1d, 'y', 0.1d, 'width', 0.2d, 'height', 0.2d)), named_struct('text_id', 't', 'page_id', 'q', 'bbox', named_struct('x', 0.8d, 'y', 0.1d, 'width', 0.2d, 'height', 0.2d)))"
    crop = F.struct(*[F.lit(v).alias(k) for k, v in {"x": 0.0, "y": 0.0, "width": 0.5, "height": 0.5}.items()])
    for pointer, want in [("t", True), ("u", False), (json.dumps({"page_id": "p", "bbox": box}), True), (json.dumps({"page_id": "q", "bbox": box}), False), (None, False), ("{broken", False)]:
        assert value(spark, evidence.located_by_trace(F.lit(pointer).cast("string"), crop, F.lit("p"), F.expr(traces))) is want, pointer
    marks = [("p", 1, evidence.WATERMARKS[0], 900, 950, 990, 990), ("p", 2, evidence.WATERMARKS[1], 900, 950, 990, 990), ("q", 3, evidence.WATERMARKS[0], 900, 950, 990, 990), ("r", 4, evidence.WATERMARKS[0], 10, 10, 20, 20), ("p", 5, "x", 900, 950, 990, 990)]
    df = spark.createDataFrame([(*m, 1000, 1000) for m in marks], "page_id string, box_id int, text string, x_min int, y_min int, x_max int, y_max int, page_width int, page_height int")
    kept, problems = evidence.without_watermarks(df)
    assert {r["box_id"] for r in kept.collect()} == {4, 5} and {tuple(r) for r in problems.collect()} == {("q", "partial"), ("r", "left_over")}


def test_tokens_beyond_the_plane(spark):
    rows = [(" ".join(f"w{i}" for i in range(n)), " ".join(f"w{i}" for i in range(n) if i != 7)) for n in (40, 60_000)]
    one = spark.createDataFrame(rows[:1], "truth string, prediction string")
    assert metrics.error_rates(one).first()["token_edits"] == 1
    wide = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(60_000)), lambda i: i.cast("string")).alias("v"))
    code = wide.select(text.as_code_points(F.array(F.lit("35600"), F.lit("60000")), F.col("v")).alias("c")).first()["c"]
    assert len(code) == 2 and not any(0xD800 <= ord(c) < 0xE000 for c in code)


def test_markup_of_any_depth(spark):
    deep = "{{a|" * 9 + "x" + "}}" * 9
    assert value(spark, text.clean_markup(F.lit(f"a{deep}b &eacute;&#x6c34;"))) == "ab é水"
    assert value(spark, text.clean_markup(F.lit("no<onlyinclude>yes [[p|q]]<REF name=x/></onlyinclude>no"))) == "yes q"


def test_similar_sections():
    assert layout.similar_section("水車圖", ["水車", "磨坊"]) == "水車" and layout.similar_section("", ["x"]) is None


def test_consensus(spark):
    def get(a, b, c):
        lit = lambda x: F.lit(x).cast("string")
        return tuple(value(spark, review.consensus(lit(a), lit(b), lit(c))))

    assert get("水車", "水車", "x") == ("水車", "exact_pair:raw+server")
    assert get("水車", "木車", "水車!") == ("水車!", "exact_pair:raw+reference")
    assert get("a", None, "") == (None, "no_consensus")
    long = "水車木車石車竹車鐵車大車小車"
    assert get(long, long[:-1] + "舟", long[:-1] + "馬")[1] == "three_way_high_similarity"


# -- tables


def test_stable_ids_are_uuid5(spark):
    import uuid

    for key in ("fig-1", "水車", ""):
        assert value(spark, ids.stable_id("figure", F.lit(key))) == str(uuid.uuid5(ids.NAMESPACE, f"figure:{key}"))
    assert value(spark, ids.stable_id("figure", F.lit(None).cast("string"))) is None


def test_partitions_follow_the_files_alone(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(2000).write.parquet(path)
    files = spark.read.parquet(path)
    n = session._file_bytes(files)
    assert 0 < n < 1 << 20
    # A checkpoint of a product carries an estimate that no table has.
    product = session.checkpoint(files.crossJoin(files.toDF("b")).crossJoin(files.toDF("c")).where("id = b and b = c"))
    assert session._file_bytes(product.join(files, "id")) == n and session.by_key(product, "id").rdd.getNumPartitions() == 4


def test_blob_digests(spark):
    df = spark.createDataFrame([(bytearray(b"wheel"),), (bytearray(),)], "b binary")
    assert [r["h"] for r in df.select(ids.blob_sha1(F.col("b")).alias("h")).collect()] == [hashlib.sha1(f"blob {len(b)}\0".encode() + b).hexdigest() for b in (b"wheel", b"")]


def test_upserts_are_idempotent(spark, tmp_path):
    path = str(tmp_path / "t")
    a = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    storage.upsert(spark, path, a, ["k"])
    b = spark.createDataFrame([(2, "c"), (3, "d")], "k long, v string")
    for _ in range(2):
        storage.upsert(spark, path, b, ["k"])
    assert {tuple(r) for r in storage.read_table(spark, path).collect()} == {(1, "a"), (2, "c"), (3, "d")}
    assert storage.write_once(a, str(tmp_path / "o")) and not storage.write_once(a.orderBy(F.desc("k")), str(tmp_path / "o"))
    with pytest.raises(FileExistsError):
        storage.write_once(b, str(tmp_path / "o"))
    assert storage.freeze(a, str(tmp_path)) == storage.freeze(a.repartition(3), str(tmp_path))


def test_bags_and_owners(spark):
    a = spark.createDataFrame([(1,), (1,), (2,)], "x int")
    b = spark.createDataFrame([(1,), (2,)], "x int")
    assert [tuple(r) for r in integrity.difference(a, b).collect()] == [(1, "left")]
    c = spark.createDataFrame([("e1", "f1"), ("e2", "f2"), ("e9", "f1")], "e string, f string")
    t = spark.createDataFrame([("e1", "f1"), ("e2", "f1")], "id string, owner string")
    assert [tuple(r)[0] for r in integrity.foreign_owners(c, "e", "f", t, "id", "owner").collect()] == ["e2"]


@pytest.mark.parametrize("hot", [1, 3, 10**9])
def test_joins_by_size_lose_nothing(spark, hot):
    left = spark.createDataFrame([("a", i) for i in range(20)] + [("b", 1), ("c", 2), (None, 3)], "k string, v int")
    keys = spark.createDataFrame([("a", 20), ("b", 1), ("z", 9)], "k string, n int")
    assert skew.join_by_size(left, keys, ["k"], hot=hot).count() == 21
    assert skew.join_by_size(left, keys, ["k"], how="left_semi", hot=hot).count() == 21


def test_salted_joins_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(skew, "bounded_broadcast", lambda df: df)
    left = spark.createDataFrame([("a", i) for i in range(50)] + [("b", 1)], "k string, v int")
    keys = spark.createDataFrame([("a", 50), ("b", 1)], "k string, n int")
    assert skew.join_by_size(left, keys, ["k"], hot=5).count() == 51


def day(n):
    return datetime(2025, 1, n)


@pytest.mark.parametrize("heavy", [1, 4, 10**6])
def test_orphans(spark, heavy):
    refs = [
        ("t", "f", "r1", "s", "gone", day(1), day(10)),  # deleted before
        ("t", "f", "r2", "s", "late", day(1), day(10)),  # arrives later
        ("t", "f", "r3", "s", "none", day(1), day(10)),  # nowhere
        ("t", "f", "r4", "s", "here", day(1), day(10)),
        ("t", "f", "r4", "s", "here", day(1), day(10)),
        ("t", "f", "r5", "s", "", day(1), day(10)),
        ("t", "f", "r6", "s", None, day(1), day(10)),
        ("t", "f", "r7", "s", "here", day(1), None),  # can't be judged: nothing is there
        ("t", "f", "r8", "s", "again", day(1), day(10)),
        ("t", "f", "r8", "s", "again", day(1), day(5)),  # between two lives
        ("t", "f", None, "s", "none", None, day(10)),
    ] + [("t", "f", f"h{i}", "s", "hot", day(1), day(i)) for i in range(1, 29)]
    targets = [
        ("s", "gone", day(2), day(9)),
        ("s", "late", day(20), None),
        ("s", "here", day(3), None),
        ("s", "here", None, None),
        ("s", "again", day(1), day(4)),
        ("s", "again", day(8), None),
        ("s", None, day(1), None),
        ("s", "hot", day(5), day(10)),
        ("s", "hot", day(7), day(12)),
        ("s", "hot", day(20), day(20)),
        ("s", "hot", day(25), None),
    ]
    r = spark.createDataFrame(refs, "ref_table string, ref_field string, record_id string, space string, target_id string, recorded_at timestamp, arrived_at timestamp").withColumn("n", F.lit(1))
    t = spark.createDataFrame(targets, "space string, target_id string, arrived_at timestamp, deleted_at timestamp").withColumn("lives", F.lit(1))
    got = {(x["record_id"], x["target_id"], x["state"], x["period"]) for x in orphans.orphan_references(r, t, heavy_rows=heavy).collect()}
    m = "2025-01"
    want = {("r1", "gone", "deleted", m), ("r2", "late", "late", m), ("r3", "none", "missing", m), ("r7", "here", "late", m), ("r8", "again", "deleted", m), (None, "none", "missing", None)}
    want |= {(f"h{i}", "hot", "late" if i < 5 else "deleted", m) for i in range(1, 29) if not (5 <= i < 12 or i >= 25)}
    assert got == want
    assert orphans.orphan_references(r.limit(0), t).count() == 0
    assert orphans.orphan_references(r, t.limit(0)).where("state <> 'missing'").count() == 0


# -- ranking


def test_rank_metrics(spark):
    ranking = spark.createDataFrame([("q", 1, 1), ("q", 2, 2), ("p", 1, 1)], "query_id string, doc_id long, rank int")
    relevant = spark.createDataFrame([("q", 2), ("q", 9)], "query_id string, doc_id long")
    got = {r["query_id"]: r for r in metrics.rank_metrics(ranking, relevant, 10).collect()}
    assert got["q"]["recall"] == 0.5 and got["q"]["rr"] == 0.5 and got["p"]["recall"] is None
    assert got["q"]["ndcg"] == pytest.approx((1 / math.log2(3)) / (1 + 1 / math.log2(3)))
    s = spark.createDataFrame([("q", 1, 0.5, 1), ("q", 2, 0.25, 2)], "query_id string, doc_id long, score double, rank int")
    assert metrics.ranking_signature(s).first()["signature"] == metrics.ranking_signature(s.orderBy("rank")).first()["signature"]


def ranked(spark, queries, candidates, pairs, k=5, **more):
    v = "array<float>"
    q = spark.createDataFrame(queries, f"query_id string, kind string, source_id string, text_vector {v}, image_vector {v}, has map<string, boolean>")
    c = spark.createDataFrame(candidates, f"doc_id string, text_vector {v}, image_vector {v}, regions array<struct<region_id: string, vector: {v}>>, has map<string, boolean>, u double")
    p = spark.createDataFrame(pairs, "query_id string, doc_id string, part string, value double")
    return search.ranked_candidates(q, c, p, k, **more).orderBy("query_id", "method", "rank").collect()


def test_every_candidate_is_ranked(spark):
    has = {"lexical": True, "sf": True}
    x, y = [1.0, 0.0], [0.0, 1.0]
    some = [("a", x, None, None, {"sf": True}, None), ("b", y, None, None, {"sf": True}, 1.0), ("c", None, None, None, {}, None), ("d", [1.0], None, [], None, math.nan), ("q", x, None, None, None, None)]
    got = ranked(spark, [("q", "text", "q", x, None, has)], some, [("q", "b", "sf", 1.0), ("q", "a", "lexical", 0.5), ("other", "a", "sf", 1.0)])
    # a: words and vectors, b: half similar, functions, uncertain; c and d have no signal and are there all the same.
    assert [r["doc_id"] for r in got] == ["b", "a", "c", "d"]
    assert got[1]["score"] == pytest.approx(0.25 * (0.7 + 0.15)) and got[0]["score"] == pytest.approx(0.25 * 0.7 * 0.5 + 0.2 - 0.05)
    assert got[1]["sf"] == 0.0 and got[2]["sf"] is None and got[2]["st"] is None and got[3]["u"] is None
    # Without signal, an uncertain candidate comes behind one of which nothing is known.
    quiet = ranked(spark, [("q", "text", None, None, None, {})], [("a", None, None, None, {}, 1.0), ("b", None, None, None, {}, None)], [])
    assert [(r["doc_id"], r["score"]) for r in quiet] == [("b", 0.0), ("a", -0.05)]
    assert ranked(spark, [], some, []) == [] and ranked(spark, [("q", "text", None, x, None, has)], [], []) == []


def test_regions_and_methods(spark):
    x, y, z = [1.0, 0.0], [0.0, 1.0], [1.0, 1.0]
    some = [("a", None, y, [("r2", z), ("r1", x), ("r3", None), ("r0", z)], {}, None), ("b", None, x, [("s2", None), ("s1", None)], {}, None)]
    got = ranked(spark, [("p", "image", None, None, x, {})], some, [], methods=search.METHODS, reliability=search.RELIABILITY)
    assert {r["method"] for r in got} == set(search.METHODS) - set(search.TEXT_METHODS)
    first = {(r["method"], r["doc_id"]): r for r in got}
    assert first["hybrid", "a"]["sr"] == 1.0 and first["hybrid", "a"]["regions"] == ["r1", "r0", "r2"] and first["hybrid", "b"]["sr"] is None and first["hybrid", "b"]["regions"] == ["s1", "s2"]
    assert first["hybrid_no_region", "a"]["score"] == pytest.approx(0.25 * 0.5) and first["chinese_clip", "b"]["score"] == 1.0


def test_requests(spark):
    rows = [("a", "text", "mill", 10, None, None, None, None), ("b", "text", " ", 0, None, None, None, [["x"] * 51]), ("c", "region", None, 5, "p", "f", (0.1, 0.1, 0.2, 0.2), None), ("d", "image", "t", None, None, None, (0.1, 0.1, 0.2, 0.2), None), ("e", None, None, 1, None, None, None, None)]
    df = spark.createDataFrame(rows, "query_id string, kind string, text string, top_k int, page_id string, figure_id string, bbox struct<x: double, y: double, width: double, height: double>, filters array<array<string>>")
    assert {tuple(r) for r in search.request_problems(df).collect()} == {("b", "text"), ("b", "top_k"), ("b", "filters"), ("c", "place"), ("d", "text_with_picture"), ("d", "top_k"), ("d", "bbox_without_region"), ("e", "kind")}


def test_lists_filter_in_two_ways(spark):
    df = spark.createDataFrame([("a", None), ("b", "x")], "id string, kind string")
    assert search.search_filters(df, id=[]).count() == 2 and search.search_filters(df, {"kind": "none"}, kind=["none"]).count() == 1
    assert search.among(df, "id", df.limit(0)).count() == 0 and search.among(df, "id", df.where("id = 'b'")).count() == 1


def test_figure_text(spark):
    figures = spark.createDataFrame([("f", " T "), ("g", None)], "figure_id string, title string")
    chunks = spark.createDataFrame([("f", 2, "two", None), ("f", 1, "x", "one"), ("f", 3, "", " ")], "figure_id string, ordinal int, text string, corrected_text string")
    assert {tuple(r) for r in search.figure_text(figures, chunks).collect()} == {("f", "T one two"), ("g", "")}


def test_best_regions(spark):
    rows = [("q", "f", "r1", 0.2), ("q", "f", "r2", 0.9), ("q", "f", "r3", None), ("q", "f", "r0", 0.2)]
    got = vectors.best_regions(spark.createDataFrame(rows, "query_id string, figure_id string, region_id string, score double")).first()
    assert got["sr"] == 0.9 and got["regions"] == ["r2", "r0", "r1"]


def test_hashed_vectors(spark):
    df = spark.createDataFrame([(1, "mill wheel"), (2, ""), (3, None), (4, "wheel mill")], "doc_id long, text string")
    got = {r["doc_id"]: r["vector"] for r in vectors.hashed_text_vectors(df).collect()}
    assert got[1] == got[4] and got[2] == [0.0] * 256 == got[3] and sum(x * x for x in got[1]) == pytest.approx(1)


# -- files


def png(w, h):
    body = struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + b"IHDR" + body + struct.pack(">I", zlib.crc32(b"IHDR" + body))


def test_readers(spark, tmp_path):
    square = "[[0,0],[2,0],[2,2],[0,2]]"
    (tmp_path / "Label.txt").write_text(
        f'a.png\t[{{"transcription":"水","points":{square},"difficult":false}}]\nb.png\tnot json\nc.png\nd.png\t[{{"transcription":"x","points":[[0,0],[0,0],[0,0],[0,0]],"difficult":false}}]\n\ne.png\t[]\n'
    )
    got = {r["image_key"]: r["problem"] for r in files.label_file(spark, str(tmp_path / "Label.txt")).collect()}
    assert got == {"a.png": None, "b.png": "json", "c.png": "tabs", "d.png": "area", "e.png": None}
    (tmp_path / "state.txt").write_text("a.png\t1\nb.png\t2\n")
    assert {tuple(r) for r in files.page_states(spark, str(tmp_path / "state.txt")).collect()} == {("a.png", True), ("b.png", False)}
    (tmp_path / "m.json").write_text('{"pages":[{"id":"p"}]}')
    assert files.manifest(str(tmp_path / "m.json"), ["pages", "figures"]) == {"pages": [{"id": "p"}], "figures": []}
    assert files.manifest_tables(spark, str(tmp_path / "m.json"), {"pages": "id: STRING"})["pages"].first()["id"] == "p"
    for bad in ('{"a":1,"a":2}', "[1]", '{"a":NaN}'):
        (tmp_path / "bad.json").write_text(bad)
        with pytest.raises(ValueError):
            files.manifest(str(tmp_path / "bad.json"), [])
    (tmp_path / "img").mkdir()
    (tmp_path / "img" / "x.png").write_bytes(png(30, 20))
    (tmp_path / "img" / "y.png").write_bytes(b"no image")
    rows = {r["path"].split("/")[-1]: r for r in files.png_assets(spark, str(tmp_path / "img")).collect()}
    assert (rows["x.png"]["width"], rows["x.png"]["height"]) == (30, 20) and not rows["y.png"]["is_png"]


def test_exact_top_k_with_unusable_vectors(spark):
    rows = [(1, 0, [1.0, 0.0]), (2, 0, [1.0, 0.1]), (3, 0, [0.0, 1.0]), (4, 0, [0.0, 0.0]), (5, 0, None), (6, 1, [1.0, 0.0]), (7, 0, [math.nan, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, space int, vector array<double>")
    got = vectors.exact_top_k(df.where("vec_id = 1"), df, 5).orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == [2, 3]
    assert vectors.exact_top_k(df.limit(0), df, 5).count() == 0


def test_recognised_lines_of_both_layouts(spark):
    square = "[[0,0],[4,0],[4,2],[0,2]]"
    rows = [
        ("a", f'{{"res":{{"rec_texts":["x"," ","z"],"rec_scores":[1.5,0.2],"rec_boxes":[[1,2,3,4],[0,0,1,1],{square}]}}}}'),
        ("b", '{"rec_texts":["y"],"rec_scores":[0.5]}'),
        ("c", f'[[{square},["t",-1]],[[1],["u"]],["v"],[{square},[" ",1]]]'),
        ("d", None),
        ("e", "no json"),
        ("f", "[]"),
    ]
    got = {(r["page"], r["reading_order"]): (r["text"], r["bbox"], r["confidence"]) for r in recognition.recognised_lines(spark.createDataFrame(rows, "page string, payload string")).collect()}
    assert got == {
        ("a", 0): ("x", [1.0, 2.0, 3.0, 4.0], 1.0),
        ("a", 2): ("z", [0.0, 0.0, 4.0, 2.0], 0.0),
        ("b", 0): ("y", [0.0] * 4, 0.5),
        ("c", 0): ("t", [0.0, 0.0, 4.0, 2.0], 0.0),
        ("c", 1): ("u", [0.0] * 4, 0.0),
    }
