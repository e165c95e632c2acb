"""Queries on references between the catalogue's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from foliospark.operators.orphans import catalogue_references, orphan_counts, orphan_references
from foliospark.session import table


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return orphan_references(*catalogue_references(lambda name: table(spark, folder, name)))


def p3_counts(spark: SparkSession, folder: str) -> DataFrame:
    return orphan_counts(p3_found(spark, folder))


_ORPHANS = """
with refs as (
  select 'domestic_ai_selection' ref_table, 'page_id' ref_field, figure_id record_id, 'page_inventory' space, page_id target_id, recorded_at, arrived_at
  from domestic_ai_selection
  union all
  select 'domestic_functions', 'functions.supports.reference_id', figure_key,
    case s.kind when 'scan_region' then 'regions' when 'ai_visual_description' then 'domestic_ai_selection' when 'raw_ocr' then 'ocr_lines' end,
    s.reference_id, recorded_at, arrived_at
  from (select figure_key, recorded_at, arrived_at, unnest(f.supports) s
        from (select figure_key, recorded_at, arrived_at, unnest(functions) f from domestic_functions))
  union all
  select 'competition_evidence_links', 'label_ids', figure_id, 'ocr_lines', unnest(label_ids), recorded_at, arrived_at from competition_evidence_links
  union all
  select 'competition_evidence_links', 'contexts.item_ids', figure_id, 'ocr_lines', unnest(c.item_ids), recorded_at, arrived_at
  from (select figure_id, recorded_at, arrived_at, unnest(contexts) c from competition_evidence_links)
), targets as (
  select 'page_inventory' space, page_id target_id, arrived_at, deleted_at from page_inventory
  union all select 'regions', region_id, arrived_at, deleted_at from regions
  union all select 'domestic_ai_selection', figure_id, arrived_at, deleted_at from domestic_ai_selection
  union all select 'ocr_lines', box_id, arrived_at, deleted_at from ocr_lines
), judged as (
  select r.ref_table, r.ref_field, r.record_id, r.target_id, r.recorded_at, r.arrived_at,
    count(t.space) known, count(t.space) filter (where t.arrived_at <= r.arrived_at) came,
    count(t.space) filter (where t.arrived_at <= r.arrived_at and (t.deleted_at is null or t.deleted_at > r.arrived_at)) there
  from refs r left join targets t on t.space = r.space and t.target_id = r.target_id
  where r.space is not null and r.target_id is not null and r.target_id <> ''
  group by all
), orphans as (
  select distinct ref_table, ref_field, record_id, target_id,
    case when known = 0 then 'missing' when came > 0 then 'deleted' else 'late' end state, strftime(recorded_at, '%Y-%m') period
  from judged where there = 0
)
"""

QUERIES = {"p3_found": p3_found, "p3_counts": p3_counts}
SQL = {
    "p3_found": _ORPHANS + "select * from orphans",
    "p3_counts": _ORPHANS
    + "select ref_table, ref_field, state, period, count(*) n_orphans, count(distinct target_id) n_targets from orphans group by 1, 2, 3, 4",
}
