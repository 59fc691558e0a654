"""Report counts and orders: menus, warnings, excluded screens, probes, run sizes, and the orders in which reports list their rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed order of the kinds of programs that have no screen.
EXCLUDED_ORDER = ("json", "redirect", "forward", "class")
#: Fixed order of a probe's outcomes.
STATUS_ORDER = ("ERROR", "PASS", "SKIP_DYNAMIC", "SKIP_DOLLAR", "SKIP_UNRESOLVED", "SKIP_REFUSED", "SKIP_NO_DIALECT_FILE")
#: Fixed shape of a statement's id; the tails name registers beside the mappers.
STATEMENT_ID = r"^[\p{L}\p{N}_.$-]{1,300}(?:#(?:jdbc|em|qdsl))?$"


def menu_info(menus: DataFrame) -> DataFrame:
    """menus, with_url, loaded_at of menu rows (url, loaded_at): one row, also of no menus."""
    return menus.agg(F.count("*").alias("menus"), F.count("url").alias("with_url"), F.max("loaded_at").alias("loaded_at"))


def warning_counts(warnings: DataFrame) -> DataFrame:
    """kind, sqlstate, code, cnt: a missing state counts as empty, a missing code as 0."""
    return warnings.groupBy("kind", F.coalesce("sqlstate", F.lit("")).alias("sqlstate"), F.coalesce("code", F.lit(0)).alias("code")).agg(F.count("*").alias("cnt"))


def excluded_kind(kind: Column, view_kinds: Column) -> Column:
    """Why a program has no screen: it answers with data, or with views none of which is a page (then the first one's kind); null for programs that have one, or no views at all."""
    return F.when(kind == "json", "json").when((F.size(view_kinds) > 0) & ~F.array_contains(view_kinds, "view"), F.get(view_kinds, F.lit(0)))


def excluded_views(programs: DataFrame) -> DataFrame:
    """place, kind, cnt of programs (kind, view_kinds) without a screen, in the fixed order; kinds that do not occur have no row."""
    found = programs.select(excluded_kind(F.col("kind"), F.col("view_kinds")).alias("kind")).where("kind is not null").groupBy("kind").agg(F.count("*").alias("cnt"))
    place = F.array_position(F.array(*map(F.lit, EXCLUDED_ORDER)), F.col("kind"))
    return found.select(F.when(place > 0, place).otherwise(len(EXCLUDED_ORDER) + 1).cast("int").alias("place"), "kind", "cnt")


def probe_totals(outcomes: DataFrame) -> DataFrame:
    """One row of total, passed, failed and skipped outcomes (status)."""
    passed, failed = F.count_if(F.col("status") == "PASS"), F.count_if(F.col("status") == "ERROR")
    return outcomes.agg(F.count("*").alias("total"), passed.alias("passed"), failed.alias("failed"), (F.count("*") - passed - failed).alias("skipped"))


def probe_skips(outcomes: DataFrame) -> DataFrame:
    """place, status, cnt of the outcomes that are neither passed nor failed."""
    place = F.array_position(F.array(*map(F.lit, STATUS_ORDER)), F.col("status")).cast("int")
    return outcomes.where(~F.col("status").isin("PASS", "ERROR")).groupBy("status").agg(F.count("*").alias("cnt")).select(place.alias("place"), "status", "cnt")


def with_sizes(parents: DataFrame, children: DataFrame, key: str) -> DataFrame:
    """parents with `size`, the number of their children: grouped before the join, 0 for those without."""
    sizes = children.groupBy(key).agg(F.count("*").alias("size"))
    return parents.join(sizes, key, "left").withColumn("size", F.coalesce("size", F.lit(0)))


def finding_order(findings: DataFrame, rules: list[str], *ties: str) -> DataFrame:
    """Findings (rule, schema_name, table_name, column) by the rule's place in the list, schema, table and column, then the columns of
    ties, which leave no order open if they are a key; a missing column counts as empty, rules not in the list and other missing values come last."""
    place = F.nullif(F.array_position(F.array(*map(F.lit, rules)), F.col("rule")), F.lit(0))
    order = (place, F.col("schema_name"), F.col("table_name"), F.coalesce("column", F.lit("")), *map(F.col, ties))
    return findings.orderBy(*(x.asc_nulls_last() for x in order))


def screen_order(screens: DataFrame) -> DataFrame:
    """Screens by module, then by url and file (missing ones first) and line."""
    return screens.orderBy("module", F.asc_nulls_first("url"), F.asc_nulls_first("file"), "line")


def recent(visits: DataFrame, key: str, at: str, most: int = 20) -> DataFrame:
    """The `most` keys that were last used, the latest first: a key counts once, at its last use."""
    return visits.groupBy(key).agg(F.max(at).alias(at)).orderBy(F.desc(at), key).limit(most)


def sound_statements(statements: DataFrame) -> DataFrame:
    """The rows whose ns_id has the shape of a statement id."""
    return statements.where(F.col("ns_id").rlike(STATEMENT_ID))


def parent_values(rows: DataFrame, columns: list[str], most: int) -> DataFrame:
    """The distinct values of a foreign key's parent columns in order, `most` at most: what a form offers to choose from."""
    return rows.select(*columns).distinct().orderBy(*columns).limit(most)


def code_rows(codes: DataFrame, columns: list[str], group: str, order: str, most: int = 20_000) -> DataFrame:
    """The named columns of a code table in order of group and sort key, `most` at most: what a document holds."""
    return codes.orderBy(group, order).select(*columns).limit(most)
