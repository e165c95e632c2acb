"""Functional concepts of a text by a controlled vocabulary: slots, concepts and the terms that name them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.functions.text import folded_key
from foliospark.session import bounded_broadcast

# The vocabulary, one concept a line: slot, concept and its terms in order.
VOCABULARY = """
power_source | human_power | 人力, 手摇, 脚踏, 踏板, hand powered
power_source | water_power | 流水, 水力, 水轮, 水车, 水动力, hydraulic power
power_source | animal_power | 畜力, 牛力, 马力, animal power
power_source | wind_power | 风力, 风车, wind power
motion | rotary | 旋转, 回转, 转动, 轮转, rotary
motion | reciprocating | 往复, 来回, 升降, reciprocating
motion | linear | 直线, 平移, linear motion
motion | cyclic | 循环, 连续运动, cyclic motion
transmission | gear | 齿轮, 轮齿, gear
transmission | belt | 带传动, 带轮传动, 皮带, belt drive
transmission | chain | 链传动, 链条, 链板传动, chain drive
transmission | shaft | 轮轴, 转轴, 轴传动, 轮轴传动, 轮轴承载, shaft
transmission | cam | 凸轮, 凸轮传动, cam
transmission | linkage | 杆件联动, 杠杆传动, 杆件, 杠杆, linkage
transmission | wheel_support | 轮周承载, 轮周承托, wheel support
action | lifting | 提水, 汲水, 提升, 提灌, lifting
action | grinding | 磨粉, 碾磨, 舂米, grinding
action | weaving | 纺织, 织布, 纺纱, 织造, weaving
action | irrigation | 灌溉, 引水, irrigation
action | cutting | 切割, 锯, cutting
action | shooting | 发射, 远射, shooting
action | mobility | 机动, 调节方向, mobility
object | water | 水流, 流水, 河水, 渠水, 灌渠, 农田水面, 提水, 灌溉, water
object | grain | 谷物, 稻谷, 麦, 碾磨, 舂捣, grain
object | fiber | 丝, 棉, 麻, 纤维, 纤维束, fiber
object | textile_yarn | 经纬纱线, 经线, 纱线, 纬线, textile yarn
object | arrow | 箭矢, 箭, arrow
object | cannon | 炮身, 火炮, cannon
object | wood | 木料, 木材, wood
object | soil | 土壤, 泥土, soil
purpose | water_lifting_irrigation | 提水灌溉, 提灌, water lifting irrigation
purpose | textile_production | 纺纱, 织造布帛, 织造纹样, textile production
purpose | grain_processing | 谷物加工, grain processing
purpose | long_range_shooting | 远程发射, 远射, long-range shooting
purpose | firearm_mobility | 火器机动, firearm mobility
"""


def vocabulary_rows(text: str = VOCABULARY) -> list[tuple[str, str, str, int]]:
    """(slot, concept, term, ord), ord being the term's place in the whole vocabulary."""
    rows, n = [], 0
    for line in text.strip().splitlines():
        slot, concept, terms = (x.strip() for x in line.split("|"))
        for term in terms.split(","):
            rows.append((slot, concept, term.strip().casefold(), n))
            n += 1
    return rows


def vocabulary(spark: SparkSession, rows: list[tuple[str, str, str, int]] | None = None) -> DataFrame:
    return spark.createDataFrame(rows or vocabulary_rows(), "slot string, concept string, term string, ord int")


def overlaid(base: list[tuple[str, str, str, int]], changes: list[tuple[str, str, list[str], bool]]) -> list[tuple[str, str, str, int]]:
    """A vocabulary with changed concepts; a change is (slot, concept, terms, whether they replace the old ones)."""
    out = list(base)
    for slot, concept, terms, replace in changes:
        if replace:
            out = [r for r in out if r[:2] != (slot, concept)]
        have = {r[2] for r in out if r[:2] == (slot, concept)}
        n = max((r[3] for r in out), default=-1) + 1
        out += [(slot, concept, t.casefold(), n + i) for i, t in enumerate(x for x in terms if x.casefold() not in have)]
    return out


def extract(docs: DataFrame, vocab: DataFrame, id_: str = "doc_id", text: str = "text", fold=folded_key) -> DataFrame:
    """(doc_id, slot, concept, confidence, terms): every concept with a term in the text, confidence 0.6 + 0.1 a term, at
    most 0.95; a slot without any gives ``unknown`` with 0. ``fold`` brings texts to the vocabulary's form.

    The vocabulary, a bounded list, becomes one array that each text is tested against: no join, no shuffle of texts.
    Null texts have unknown slots only. doc_ids should be unique.
    """
    terms = vocab.agg(F.array_sort(F.collect_list(F.struct("ord", "slot", "concept", "term"))).alias("vocabulary"))
    slots = vocab.agg(F.array_sort(F.collect_set("slot")).alias("slots"))
    folded = docs.select(F.col(id_).alias("doc_id"), fold(F.col(text)).alias("folded")).join(F.broadcast(terms)).join(F.broadcast(slots))
    hits = F.filter("vocabulary", lambda v: F.coalesce(F.contains(F.col("folded"), v["term"]), F.lit(False)))
    found = folded.select("doc_id", "slots", hits.alias("hits"))
    known = (
        found.select("doc_id", F.explode("hits").alias("h"))
        .groupBy("doc_id", "h.slot", "h.concept")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("h.ord", "h.term"))), lambda x: x["term"]).alias("terms"))
        .select("doc_id", "slot", "concept", F.least(F.lit(0.95), 0.6 + 0.1 * F.size("terms")).alias("confidence"), "terms")
    )
    unknown = found.select(
        "doc_id", F.explode(F.array_except("slots", F.transform("hits", lambda h: h["slot"]))).alias("slot")
    ).select("doc_id", "slot", F.lit("unknown").alias("concept"), F.lit(0.0).alias("confidence"), F.array().cast("array<string>").alias("terms"))
    return known.unionByName(unknown)


def canonical_concepts(rows: DataFrame, vocab: DataFrame, fold=folded_key) -> DataFrame:
    """``rows`` (slot, concept, …) with ``canonical``: the concept of the slot whose id or term is the folded text, the
    first in the vocabulary's order, else the folded text itself. Null stays null."""
    names = vocab.select("slot", F.col("term").alias("name"), "concept", "ord").unionByName(
        vocab.groupBy("slot", "concept").agg(F.min("ord").alias("ord")).select("slot", F.lower("concept").alias("name"), "concept", "ord")
    )
    first = names.groupBy("slot", "name").agg(F.min_by("concept", "ord").alias("known"))
    return (
        rows.withColumn("name", fold(F.col("concept")))
        .join(bounded_broadcast(first), ["slot", "name"], "left")
        .withColumn("canonical", F.coalesce("known", "name"))
        .drop("known", "name")
    )


def claims(docs: DataFrame, concepts: DataFrame, tokens, most: int = 12) -> DataFrame:
    """(doc_id, claims): known concepts, then the first ``most`` tokens of two letters or more, each once. ``docs``:
    doc_id, text; ``concepts``: doc_id, concept (slot order by name); ``tokens``: Column to its tokens."""
    known = concepts.where("concept <> 'unknown'").groupBy("doc_id").agg(F.array_sort(F.collect_set("concept")).alias("known"))
    words = F.slice(F.filter(tokens(F.col("text")), lambda t: F.length(t) >= 2), 1, most)
    empty = F.array().cast("array<string>")
    return docs.join(known, "doc_id", "left").select(
        "doc_id", F.array_distinct(F.concat(F.coalesce("known", empty), F.coalesce(words, empty))).alias("claims")
    )
