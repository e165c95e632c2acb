"""Queries on words: tokens, BM25, concepts of a vocabulary, claims."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.functions.text import CJK, LATIN_WORD, lexical_tokens, word_tokens
from foliospark.operators import bm25, cfr
from foliospark.session import table

#: Of the figures, those whose number is divisible by this are queries; every row is searched.
EVERY = 50
FIGURE_NO = r"-f(\d+)$"


def query_figures(spark: SparkSession, d: str) -> DataFrame:
    """(query_id, text): titles of the figures whose number is divisible by EVERY."""
    f = table(spark, d, "domestic_ai_selection").where("title is not null")
    no = F.regexp_extract("figure_id", FIGURE_NO, 1).try_cast("bigint")
    return f.where(no % EVERY == 0).groupBy(F.col("figure_id").alias("query_id")).agg(F.min("title").alias("text"))


def english_terms(spark: SparkSession) -> DataFrame:
    """A small vocabulary in the words of the test documents, beside the controlled one."""
    rows = [
        ("power_source", "water_power", ["water wheel", "mill-race", "水輪", "water-ladder"]),
        ("power_source", "human_power", ["treadle", "踏板", "crank"]),
        ("transmission", "gear", ["cogwheel", "lantern-pinion", "棘輪", "zahnrad"]),
        ("transmission", "belt", ["belt", "seil", "繩索"]),
        ("action", "weaving", ["loom", "weaver", "織機", "webstuhl"]),
        ("action", "grinding", ["millstone", "磨盤", "meule"]),
        ("object", "textile_yarn", ["spindle", "bobbin", "經線", "spule"]),
        ("object", "grain", ["millet", "rice", "hirse"]),
    ]
    flat = [(s, c, t) for s, c, ts in rows for t in ts]
    return cfr.vocabulary(spark, [(s, c, t, i) for i, (s, c, t) in enumerate(flat)])


def q_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Frequencies of lexical tokens of all documents, as stored."""
    p = bm25.postings(table(spark, d, "documents"), normalise=False)
    return p.groupBy("term").agg(F.sum("tf").alias("tf"), F.count("*").alias("df"))


def q_tokens_nfkc(spark: SparkSession, d: str) -> DataFrame:
    """The same with texts in NFKC form first."""
    p = bm25.postings(table(spark, d, "documents"))
    return p.groupBy("term").agg(F.sum("tf").alias("tf"), F.count("*").alias("df"))


def q_word_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Tokens by which token error rates count, for each line."""
    return table(spark, d, "ocr_lines").select("line_id", F.size(word_tokens(F.col("text"))).alias("n_tokens")).distinct()


def q_bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    scores = bm25.bm25_scores(table(spark, d, "documents"), query_figures(spark, d), normalise=False)
    return bm25.top_k(scores, 10).select("query_id", "doc_id", "rank", F.round("score", 6).alias("score"))


def q_bm25_filtered(spark: SparkSession, d: str) -> DataFrame:
    """Statistics and ranking of the documents of one source alone, scores over the best of the query."""
    docs = table(spark, d, "documents").where("source = 'transcription'")
    best = bm25.max_normalised(bm25.top_k(bm25.bm25_scores(docs, query_figures(spark, d), normalise=False), 10))
    return best.select("query_id", "doc_id", "rank", F.round("normalised", 6).alias("normalised"))


def q_cfr_extract(spark: SparkSession, d: str) -> DataFrame:
    found = cfr.extract(table(spark, d, "documents"), english_terms(spark), fold=F.lower)
    return found.select("doc_id", "slot", "concept", F.round("confidence", 6).alias("confidence"), F.array_join("terms", "|").alias("terms"))


def q_cfr_controlled(spark: SparkSession, d: str) -> DataFrame:
    """Concepts of the controlled vocabulary, texts in NFKC form and case folded."""
    found = cfr.extract(table(spark, d, "documents"), cfr.vocabulary(spark))
    return found.groupBy("slot", "concept").agg(F.count("*").alias("n_docs"))


def q_concept_canon(spark: SparkSession, d: str) -> DataFrame:
    """Concepts of functions by their canonical ids."""
    f = table(spark, d, "domestic_functions").select(F.explode("functions").alias("f")).select("f.slot", F.coalesce("f.label", "f.concept").alias("concept"))
    return cfr.canonical_concepts(f, english_terms(spark), fold=lambda x: F.lower(F.trim(x))).groupBy("slot", "canonical").agg(F.count("*").alias("n"))


def q_claims(spark: SparkSession, d: str) -> DataFrame:
    """Known concepts of a document, then its first words."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    concepts = cfr.extract(docs, english_terms(spark), fold=F.lower)
    return cfr.claims(docs, concepts, lexical_tokens).select("doc_id", F.array_join("claims", "|").alias("claims"))


_CJK = CJK
_TOKENS = f"""
runs as (select doc_id, unnest(regexp_extract_all(lower(text), '[{_CJK}]+')) run from {{docs}}),
toks as (
  select doc_id, unnest(string_split(run, '')) term from runs
  union all select doc_id, unnest(list_transform(generate_series(1, length(run) - 1), lambda i: substr(run, i, 2))) from runs where length(run) > 1
  union all select doc_id, unnest(regexp_extract_all(lower(text), '{LATIN_WORD}')) from {{docs}}
),
posts as (select doc_id, term, count(*) tf from toks group by 1, 2)"""

_BM25 = """with docs as ({docs}), """ + _TOKENS.replace("{docs}", "docs") + f""",
q as (select figure_id query_id, min(title) "text" from domestic_ai_selection where title is not null and cast(nullif(regexp_extract(figure_id, '{FIGURE_NO}', 1), '') as bigint) % {EVERY} = 0 group by 1),
qruns as (select query_id, unnest(regexp_extract_all(lower("text"), '[{_CJK}]+')) run from q),
qtoks as (
  select query_id, unnest(string_split(run, '')) term from qruns
  union all select query_id, unnest(list_transform(generate_series(1, length(run) - 1), lambda i: substr(run, i, 2))) from qruns where length(run) > 1
  union all select query_id, unnest(regexp_extract_all(lower("text"), '{LATIN_WORD}')) from q
),
qt as (select query_id, term, 1 + ln(count(*)) boost from qtoks group by 1, 2),
n as (select (select count(distinct doc_id) from docs) n_docs, (select sum(tf) from posts) tokens),
len as (select doc_id, sum(tf) len from posts group by 1),
dfs as (select term, count(*) df from posts group by 1),
scores as (
  select query_id, p.doc_id, sum(boost * ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * len / (tokens / n_docs)))) score
  from qt join posts p using (term) join dfs using (term) join len using (doc_id) cross join n group by 1, 2
),
top as (select query_id, doc_id, round(score, 6) score, score raw, row_number() over (partition by query_id order by round(score, 6) desc, doc_id) "rank" from scores where score > 0)
"""

_VOCAB = """vocab(slot, concept, term, ord) as (values
 ('power_source', 'water_power', 'water wheel', 0), ('power_source', 'water_power', 'mill-race', 1), ('power_source', 'water_power', '水輪', 2), ('power_source', 'water_power', 'water-ladder', 3),
 ('power_source', 'human_power', 'treadle', 4), ('power_source', 'human_power', '踏板', 5), ('power_source', 'human_power', 'crank', 6),
 ('transmission', 'gear', 'cogwheel', 7), ('transmission', 'gear', 'lantern-pinion', 8), ('transmission', 'gear', '棘輪', 9), ('transmission', 'gear', 'zahnrad', 10),
 ('transmission', 'belt', 'belt', 11), ('transmission', 'belt', 'seil', 12), ('transmission', 'belt', '繩索', 13),
 ('action', 'weaving', 'loom', 14), ('action', 'weaving', 'weaver', 15), ('action', 'weaving', '織機', 16), ('action', 'weaving', 'webstuhl', 17),
 ('action', 'grinding', 'millstone', 18), ('action', 'grinding', '磨盤', 19), ('action', 'grinding', 'meule', 20),
 ('object', 'textile_yarn', 'spindle', 21), ('object', 'textile_yarn', 'bobbin', 22), ('object', 'textile_yarn', '經線', 23), ('object', 'textile_yarn', 'spule', 24),
 ('object', 'grain', 'millet', 25), ('object', 'grain', 'rice', 26), ('object', 'grain', 'hirse', 27)),
found as (select doc_id, slot, concept, least(0.95, 0.6 + 0.1 * count(*)) confidence, string_agg(term, '|' order by ord) terms
  from documents join vocab on contains(lower(text), term) group by 1, 2, 3),
cfr as (select doc_id, slot, concept, round(confidence::double, 6) confidence, terms from found
  union all select doc_id, slot, 'unknown', 0.0::double, '' from documents cross join (select distinct slot from vocab) s
  where not exists (select 1 from found f where f.doc_id = documents.doc_id and f.slot = s.slot))"""

QUERIES = {f.__name__: f for f in (
    q_tokens, q_tokens_nfkc, q_word_tokens, q_bm25_topk, q_bm25_filtered, q_cfr_extract, q_cfr_controlled, q_concept_canon, q_claims,
)}

_LIST = f"""list_concat(flatten(list_transform(regexp_extract_all(lower(text), '[{_CJK}]+'), lambda r: list_concat(string_split(r, ''), list_transform(generate_series(1, length(r) - 1), lambda i: substr(r, i, 2))))), regexp_extract_all(lower(text), '{LATIN_WORD}'))"""

SQL = {
    "q_claims": f"""with {_VOCAB}, k as (select doc_id, list_sort(list_distinct(list(concept))) known from found group by 1),
      t as (select doc_id, list_slice(list_filter({_LIST}, lambda x: length(x) >= 2), 1, 12) w from documents),
      l as (select doc_id, list_concat(coalesce(known, []), coalesce(w, [])) l from t left join k using (doc_id))
      select doc_id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), '|') claims from l""",
    "q_word_tokens": r"""select distinct line_id, coalesce(len(regexp_extract_all("text", '[\x{3400}-\x{9FFF}\x{20000}-\x{3134F}]|[A-Za-z0-9]+|[^\s\v\x{85}\p{Z}]')), -1) n_tokens from ocr_lines""",
    "q_tokens": "with " + _TOKENS.replace("{docs}", "documents") + " select term, sum(tf)::bigint tf, count(*) df from posts group by 1",
    "q_bm25_topk": _BM25.replace("{docs}", "select * from documents") + 'select query_id, doc_id, "rank", score from top where "rank" <= 10',
    "q_bm25_filtered": _BM25.replace("{docs}", "select * from documents where source = 'transcription'")
    + 'select query_id, doc_id, "rank", round(raw / max(raw) over (partition by query_id), 6) normalised from top where "rank" <= 10',
    "q_cfr_extract": f"with {_VOCAB} select * from cfr",
    "q_concept_canon": f"""with {_VOCAB},
      names as (select slot, term as "name", concept, ord from vocab union all select slot, lower(concept), concept, min(ord) from vocab group by slot, concept),
      firsts as (select slot, "name", arg_min(concept, ord) known from names group by 1, 2),
      f as (select unnest(functions) f from domestic_functions),
      g as (select f.slot slot, lower(trim(coalesce(f.label, f.concept))) "name" from f)
      select g.slot, coalesce(known, g."name") canonical, count(*) n from g left join firsts using (slot, "name") group by 1, 2""",
}
