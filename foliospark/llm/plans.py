"""Registered queries of this package and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from foliospark.llm import mixing, neighbours, reading, scans, sentences, spans, tokens
from foliospark.session import table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return scans.page_noise(table(spark, folder, "ocr_lines"))


def p1_paragraphs(spark: SparkSession, folder: str) -> DataFrame:
    """Every run's body as continuous paragraphs."""
    return scans.repaired_pages(table(spark, folder, "ocr_lines"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return sentences.sentences(table(spark, folder, "ocr_results")).select("result_id", "end_char").distinct()


def p2_sentences(spark: SparkSession, folder: str) -> DataFrame:
    """Every sentence with its place and its text."""
    results = table(spark, folder, "ocr_results")
    texts = results.select("result_id", "raw_text").dropDuplicates(["result_id"])
    return (
        sentences.sentences(results)
        .join(texts, "result_id")
        .selectExpr("result_id", "no", "start_char", "end_char", "substring(raw_text, start_char + 1, end_char - start_char) sentence")
    )


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return reading.same_reading(*(table(spark, folder, x) for x in ("ocr_lines", "domestic_functions", "competition_evidence_links")))


def p4_forms(spark: SparkSession, folder: str) -> DataFrame:
    """Every line and quote in its canonical form."""
    lines, cited = reading.lines_and_quotes(*(table(spark, folder, x) for x in ("ocr_lines", "domestic_functions", "competition_evidence_links")))
    return lines.selectExpr("'line' place", "line_id text_id", "box_id", "form", "reading").unionByName(cited.drop("text"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.neighbour_pairs(neighbours.nearest(table(spark, folder, "vector_results")))


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.encode_documents(table(spark, folder, "documents"))


def p7_mixture(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))


def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.shares(p7_mixture(spark, folder), table(spark, folder, "mix_targets"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return spans.shared_spans(table(spark, folder, "documents"))


def p8_shared(spark: SparkSession, folder: str) -> DataFrame:
    return spans.shared_share(table(spark, folder, "documents"), p8_found(spark, folder))


def p8_lines(spark: SparkSession, folder: str) -> DataFrame:
    return spans.line_repeats(table(spark, folder, "documents"))


QUERIES = {
    "p1_found": p1_found,
    "p1_paragraphs": p1_paragraphs,
    "p2_found": p2_found,
    "p2_sentences": p2_sentences,
    "p4_found": p4_found,
    "p4_forms": p4_forms,
    "p5_found": p5_found,
    "p6_ids": p6_ids,
    "p7_mixture": p7_mixture,
    "p7_shares": p7_shares,
    "p8_found": p8_found,
    "p8_shared": p8_shared,
    "p8_lines": p8_lines,
}
_SPANS = """
w as (select doc_id, unnest(generate_series(1, length(text) - 149)) i, text from documents where length(text) >= 150),
h as (select distinct doc_id, i - 1 s, substr(text, i, 150) k from w),
m as (select k from h group by k having count(distinct doc_id) > 1),
c as (select distinct doc_id, s from h join m using (k)),
g as (select doc_id, s, case when s - lag(s) over (partition by doc_id order by s) <= 150 then 0 else 1 end fresh from c),
n as (select doc_id, s, sum(fresh) over (partition by doc_id order by s) no from g),
f as (select doc_id, min(s) start_char, max(s) + 150 end_char from n group by doc_id, no)
"""

SQL: dict[str, str] = {
    "p8_found": f"with {_SPANS} select doc_id, start_char, end_char from f",
    "p8_shared": f"""with {_SPANS}, t as (select doc_id, max(coalesce(length(text), 0))::bigint n_chars from documents group by 1), s as (select doc_id, sum(end_char - start_char)::bigint c from f group by 1)
select t.doc_id, n_chars, coalesce(c, 0) shared_chars, case when n_chars > 0 then coalesce(c, 0) / n_chars else 0.0 end "share" from t left join s using (doc_id)""",
    "p8_lines": r"""
with t as (select doc_id, text, unnest(string_split(text, chr(10))) line, generate_subscripts(string_split(text, chr(10)), 1) no from documents where length(text) > 0),
l as (select doc_id, line, coalesce(sum(length(line) + 1) over (partition by doc_id order by no rows between unbounded preceding and 1 preceding), 0)::bigint start_char from t),
u as (select distinct doc_id, start_char, start_char + length(line) end_char, trim(regexp_replace(line, '[ \t\r\f\v]+', ' ', 'g')) unit from l),
k as (select *, first_value(doc_id) over w kept_doc_id, row_number() over w r from u where length(unit) >= 150 window w as (partition by unit order by doc_id, start_char))
select doc_id, start_char, end_char, kept_doc_id from k where r > 1
""",
}
