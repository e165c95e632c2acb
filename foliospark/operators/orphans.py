"""References to records that are not there, when the referring row arrives.

Method: skew-aware split. References are aggregated per key and instant before anything is joined. Keys with many rows
on either side go one way (their list is counted and broadcast only within a bound), all other keys are joined by a
plain shuffle on the key, and both sets of orphans are united.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliospark.operators.skew import join_by_size
from foliospark.session import bounded_broadcast, checkpoint

#: Rows of one key, references and targets together, from which the key goes the way for heavy keys.
HEAVY_ROWS = 5_000

KEY = ["space", "target_id"]


def _light(requests: DataFrame, targets: DataFrame) -> DataFrame:
    """Judges keys of few rows: a key's lifetimes fit into one array (less than HEAVY_ROWS entries)."""
    lives = targets.groupBy(*KEY).agg(
        F.collect_set(F.when(F.col("arrived_at").isNotNull(), F.struct("arrived_at", "deleted_at"))).alias("lives")
    )
    there = F.exists(
        "lives",
        lambda x: (x["arrived_at"] <= F.col("at")) & (x["deleted_at"].isNull() | (x["deleted_at"] > F.col("at"))),
    )
    came = F.exists("lives", lambda x: x["arrived_at"] <= F.col("at"))
    return requests.join(lives, KEY, "left").select(
        *KEY,
        "at",
        F.coalesce(there, F.lit(False)).alias("there"),
        F.col("lives").isNotNull().alias("known"),
        F.coalesce(came, F.lit(False)).alias("came"),
    )


def _heavy(requests: DataFrame, targets: DataFrame) -> DataFrame:
    """Judges keys of many rows by running counts, in groups of one key and day, never of a whole key.

    A target is there at t if more of its rows have arrived than gone. Counts of a day are aggregated first; the running
    sum over a key sees one row a day, the running sum within a day starts from it.
    """
    lasting = F.col("deleted_at").isNull() | (F.col("deleted_at") > F.col("arrived_at"))
    moves = (
        targets.where("arrived_at is not null")
        .select(
            *KEY,
            F.explode(
                F.array(
                    F.struct(F.col("arrived_at").alias("at"), F.when(lasting, 1).otherwise(0).alias("live"), F.lit(1).alias("came")),
                    F.struct(F.col("deleted_at").alias("at"), F.when(lasting, -1).otherwise(0).alias("live"), F.lit(0).alias("came")),
                )
            ).alias("m"),
        )
        .select(*KEY, "m.*")
        .where("at is not null")
        .groupBy(*KEY, "at")
        .agg(F.sum("live").alias("live"), F.sum("came").alias("came"))
        .withColumn("asks", F.lit(0))
    )
    asks = requests.where("at is not null").select(*KEY, "at", F.lit(0).alias("live"), F.lit(0).alias("came"), F.lit(1).alias("asks"))
    events = (
        moves.unionByName(asks)
        .groupBy(*KEY, "at")
        .agg(F.sum("live").alias("live"), F.sum("came").alias("came"), F.sum("asks").alias("asks"))
        .withColumn("day", F.to_date("at"))
    )
    before = Window.partitionBy(*KEY).orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    days = (
        events.groupBy(*KEY, "day")
        .agg(F.sum("live").alias("live"), F.sum("came").alias("came"))
        .select(*KEY, "day", F.sum("live").over(before).alias("live0"), F.sum("came").over(before).alias("came0"))
    )
    so_far = Window.partitionBy(*KEY, "day").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    judged = (
        events.join(days, [*KEY, "day"])
        .withColumn("live", F.sum("live").over(so_far) + F.coalesce("live0", F.lit(0)))
        .withColumn("came", F.sum("came").over(so_far) + F.coalesce("came0", F.lit(0)))
        .where("asks > 0")
        .select(*KEY, "at", (F.col("live") > 0).alias("there"), (F.col("came") > 0).alias("came"))
    )
    undated = requests.where("at is null").select(*KEY, "at", F.lit(False).alias("there"), F.lit(False).alias("came"))
    known = targets.select(*KEY).distinct().withColumn("known", F.lit(True))
    return (
        judged.unionByName(undated)
        .join(known, KEY, "left")
        .select(*KEY, "at", "there", F.coalesce("known", F.lit(False)).alias("known"), "came")
    )


def orphan_references(references: DataFrame, targets: DataFrame, heavy_rows: int = HEAVY_ROWS) -> DataFrame:
    """The distinct orphan references.

    ``references``: ref_table, ref_field, record_id, space, target_id, recorded_at, arrived_at.
    ``targets``: space, target_id, arrived_at, deleted_at. Other columns are ignored.

    A target row is there at t if it arrived by t and is not deleted by t. Null and empty target ids are no references.
    A referring row without arrived_at finds nothing there. A target row without arrived_at is never there, but makes
    the id known. Ids are compared as stored. period is null where recorded_at is. Repeated rows change nothing.
    """
    fields = ["ref_table", "ref_field", "record_id", "period"]
    uses = (
        references.where("target_id is not null and target_id <> ''")
        .select(
            "ref_table",
            "ref_field",
            "record_id",
            *KEY,
            F.date_format("recorded_at", "yyyy-MM").alias("period"),
            F.col("arrived_at").alias("at"),
        )
        .distinct()
    )
    uses = checkpoint(uses)
    rows = targets.where("target_id is not null").select(*KEY, "arrived_at", "deleted_at").distinct()
    # Every key's rows are counted, which combines before the shuffle; no row moves by its key before heavy keys are apart.
    asked = checkpoint(uses.groupBy(*KEY, "at").agg(F.count("*").alias("n")))
    requests = asked.drop("n")
    sizes = (
        requests.groupBy(*KEY).agg(F.count("*").alias("n"), F.lit(True).alias("asked"))
        .unionByName(rows.groupBy(*KEY).agg(F.count("*").alias("n"), F.lit(False).alias("asked")))
        .groupBy(*KEY)
        .agg(F.sum("n").alias("n"), F.max("asked").alias("asked"))
        .where("asked")
    )
    heavy = checkpoint(sizes.where(F.col("n") >= heavy_rows).select(*KEY, "n"))
    if heavy.isEmpty():
        rows = checkpoint(rows.join(requests.select(*KEY).distinct(), KEY, "left_semi"))
        judged = _light(requests, rows)
    else:
        some = bounded_broadcast(heavy.select(*KEY))
        light = requests.join(some, KEY, "left_anti")
        few = checkpoint(rows.join(some, KEY, "left_anti").join(light.select(*KEY).distinct(), KEY, "left_semi"))
        many = checkpoint(join_by_size(rows, heavy, KEY, how="left_semi", hot=heavy_rows))
        judged = _light(light, few).unionByName(_heavy(requests.join(some, KEY, "left_semi"), many))
    # References to a key in one load may be a third of all: the way back to them is split by how many there are.
    lost = judged.where(~F.col("there")).select(
        *KEY,
        F.struct("at").alias("when"),
        F.when(~F.col("known"), "missing").when(F.col("came"), "deleted").otherwise("late").alias("state"),
    )
    lost = checkpoint(lost.join(asked.select(*KEY, F.struct("at").alias("when"), "n"), [*KEY, "when"]))
    orphans = join_by_size(uses.withColumn("when", F.struct("at")), lost, [*KEY, "when"], hot=max(heavy_rows, 2))
    return orphans.select(*fields[:3], "target_id", "state", "period").distinct()


def orphan_counts(orphans: DataFrame) -> DataFrame:
    """Orphans per table, field, state and month."""
    return orphans.groupBy("ref_table", "ref_field", "state", "period").agg(
        F.count("*").alias("n_orphans"), F.countDistinct("target_id").alias("n_targets")
    )


#: The kinds of support and the table and column they point to.
KIND_TARGETS = {
    "scan_region": ("regions", "region_id"),
    "ai_visual_description": ("domestic_ai_selection", "figure_id"),
    "raw_ocr": ("ocr_lines", "box_id"),
}


def catalogue_references(tables) -> tuple[DataFrame, DataFrame]:
    """References and targets of the catalogue's tables; ``tables`` gives a table by name.

    A support of a kind without target table is no reference.
    """
    when = ["recorded_at", "arrived_at"]
    selection, functions, links = (tables(x) for x in ("domestic_ai_selection", "domestic_functions", "competition_evidence_links"))

    def of(df: DataFrame, name: str, field: str, record: str, space, target) -> DataFrame:
        return df.select(
            F.lit(name).alias("ref_table"),
            F.lit(field).alias("ref_field"),
            F.col(record).alias("record_id"),
            space.alias("space"),
            target.alias("target_id"),
            *when,
        )

    supports = (
        functions.select("figure_key", *when, F.explode("functions.supports").alias("s"))
        .select("figure_key", *when, F.explode("s").alias("s"))
        .where(F.col("s.kind").isin(*KIND_TARGETS))
    )
    kinds = F.create_map(*[F.lit(x) for k, (t, _) in KIND_TARGETS.items() for x in (k, t)])
    references = (
        of(selection, "domestic_ai_selection", "page_id", "figure_id", F.lit("page_inventory"), F.col("page_id"))
        .unionByName(
            of(supports, "domestic_functions", "functions.supports.reference_id", "figure_key", kinds[F.col("s.kind")], F.col("s.reference_id"))
        )
        .unionByName(
            of(
                links.select("figure_id", *when, F.explode("label_ids").alias("x")),
                "competition_evidence_links", "label_ids", "figure_id", F.lit("ocr_lines"), F.col("x"),
            )
        )
        .unionByName(
            of(
                links.select("figure_id", *when, F.explode("contexts.item_ids").alias("y")).select("figure_id", *when, F.explode("y").alias("x")),
                "competition_evidence_links", "contexts.item_ids", "figure_id", F.lit("ocr_lines"), F.col("x"),
            )
        )
    )
    targets = None
    for name, column in [("page_inventory", "page_id"), *KIND_TARGETS.values()]:
        part = tables(name).select(F.lit(name).alias("space"), F.col(column).alias("target_id"), "arrived_at", "deleted_at")
        targets = part if targets is None else targets.unionByName(part)
    return references, targets
