"""All registered queries of the governance operators: name -> (builder, oracle SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarrylens.plans import alter_plans, catalog_plans, document_plans, graph_plans, history_plans, lineage_plans, metadata_plans, naming_plans, parts_catalog, quality_plans, report_plans, rule_plans, sample_plans, source_plans, storage_plans, text_plans

MODULES = (quality_plans, history_plans, lineage_plans, metadata_plans, naming_plans, text_plans, document_plans, catalog_plans, rule_plans, report_plans, source_plans, graph_plans, sample_plans, storage_plans, alter_plans, parts_catalog)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: build for m in MODULES for name, (build, _) in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, (_, sql) in m.QUERIES.items() if sql}
