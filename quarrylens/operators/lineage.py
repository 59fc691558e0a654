"""Lineage between programs, statements, tables and screens, as joins over fact tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LETTERS = "CRUD"


def letters(c: Column) -> Column:
    """The union of CRUD letters over a group, in the order C, R, U, D."""
    return F.concat(*(F.max(F.when(c.contains(x), x).otherwise("")) for x in LETTERS))


def crud_long(crud: DataFrame) -> DataFrame:
    return crud.groupBy("program_id", "table_name").agg(letters(F.col("crud")).alias("crud"))


def module_matrix(crud: DataFrame, programs: DataFrame) -> DataFrame:
    """table_name, module, crud: letters over all programs of a module. Letters are merged per program first."""
    return crud_long(crud).join(programs.select("program_id", "module"), "program_id").groupBy("table_name", "module").agg(letters(F.col("crud")).alias("crud"))


def crud_matrix(crud: DataFrame, key: str, tables: list[str] | None = None, most: int = 10_000) -> DataFrame:
    """One row for each key, one column for each table in order of name, with the letters or an empty text.

    Without `tables` they are those of the rows; more than `most` of them are refused, as columns cannot be that many."""
    if tables is None:
        tables = sorted(r[0] for r in crud.select("table_name").distinct().limit(most + 1).collect())
        if len(tables) > most:
            raise ValueError(f"over {most} tables cannot be columns")
    merged = crud.groupBy(key, "table_name").agg(letters(F.col("crud")).alias("crud"))  # one row for each cell
    return merged.groupBy(key).agg(*(F.coalesce(F.max(F.when(F.col("table_name") == t, F.col("crud"))), F.lit("")).alias(t.lower().replace("#", "_")) for t in tables))


def program_counts(crud: DataFrame) -> DataFrame:
    return crud.groupBy("table_name").agg(F.countDistinct("program_id").alias("programs"))


def impact(crud: DataFrame, programs: DataFrame, links: DataFrame) -> DataFrame:
    """table_name, program_id, screen: tables to the programs that touch them to the screens that call those."""
    touched = crud.select("table_name", "program_id").distinct()
    return touched.join(programs.select("program_id", "url"), "program_id").join(links.select("url", "screen").distinct(), "url", "left").select("table_name", "program_id", "screen").distinct()


def touching(programs: DataFrame, crud: DataFrame, table_name: str) -> DataFrame:
    return programs.join(crud.where(F.col("table_name") == table_name), "program_id", "left_semi")


def consistency(code: DataFrame, db: DataFrame, excluded: Column, other_schema: Column | None = None) -> DataFrame:
    """table_name, side, reason: tables in code that the database lacks and the other way round; names compare without case.

    db: table_name, row_count (null: unknown); `excluded` and `other_schema` (tables of schemas that the code does not use)
    are conditions on db's rows."""
    in_code = code.select(F.upper("table_name").alias("table_name")).distinct()
    in_db = db.select(F.upper("table_name").alias("table_name"), "row_count", excluded.alias("out_of_scope"), (F.lit(False) if other_schema is None else other_schema).alias("elsewhere"))
    missing = in_code.join(in_db, "table_name", "left_anti").select("table_name", F.lit("missing_in_db").alias("side"), F.lit("none").alias("reason"))
    reason = F.when(F.col("out_of_scope"), "scope").when(F.col("elsewhere"), "schema").when(F.col("row_count") == 0, "empty").otherwise("none")
    unused = in_db.join(in_code, "table_name", "left_anti").select("table_name", F.lit("unused_in_code").alias("side"), reason.alias("reason"))
    return missing.union(unused)


def orphan_statements(statements: DataFrame, called: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Statements that no program calls by name, nor by a prefix of the name. The prefix test is an equi-join on every prefix length that occurs (a bounded list)."""
    named = statements.join(called, "ns_id", "left_anti")
    return named.join(_prefix_hits(named, prefixes), "ns_id", "left_anti")


def _prefix_hits(statements: DataFrame, prefixes: DataFrame) -> DataFrame:
    return prefix_expand(statements, prefixes).select("ns_id").distinct()


def prefix_expand(statements: DataFrame, prefixes: DataFrame) -> DataFrame:
    """prefix, ns_id: every statement for each prefix of its name that is called; all prefixes of a name are exploded and equi-joined, so there is no nested loop."""
    every = statements.select("ns_id", F.explode(F.sequence(F.lit(1), F.length("ns_id"))).alias("n")).select("ns_id", F.expr("left(ns_id, n)").alias("prefix"))
    return every.join(prefixes.select("prefix").distinct(), "prefix").select("prefix", "ns_id")


def suffix_match(views: DataFrame, files: DataFrame) -> DataFrame:
    """view, path: files whose path is the view's name or ends in '/' and it; path suffixes are exploded and equi-joined."""
    parts = F.split("path", "/")
    tails = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
    return files.select("path", F.explode(tails).alias("view")).join(views.select("view").distinct(), "view").select("view", "path").distinct()


def reached_risks(risks: DataFrame, programs: DataFrame) -> DataFrame:
    """Risks with the number of programs that reach them (0 if none does), those that most reach first."""
    return risks.join(programs.select("ns_id", "program_id"), "ns_id", "left").groupBy("risk_id", "ns_id").agg(F.count("program_id").alias("reached")).orderBy(F.desc("reached"), "risk_id")


def menu_overlay(programs: DataFrame, menus: DataFrame, links: DataFrame) -> DataFrame:
    """program_id, menu, basis: by the program's own url, else by a screen that calls it, else none."""
    own = menus.groupBy("url").agg(F.min("menu").alias("own_menu"))
    via = links.join(menus.withColumnRenamed("url", "screen"), "screen").groupBy("url").agg(F.min("menu").alias("via_menu"))
    out = programs.select("program_id", "url").join(own, "url", "left").join(via, "url", "left")
    basis = F.when(F.col("own_menu").isNotNull(), "url").when(F.col("via_menu").isNotNull(), "screen").otherwise("none")
    return out.select("program_id", F.coalesce("own_menu", "via_menu").alias("menu"), basis.alias("basis"))


def reachable(edges: DataFrame, depth: int) -> DataFrame:
    """a, b: pairs joined by a path of 1 to `depth` edges; each round joins the frontier only and keeps distinct pairs."""
    edges = edges.select("a", "b").distinct()
    out = frontier = edges
    for _ in range(depth - 1):
        step = frontier.alias("f").join(edges.alias("e"), F.col("f.b") == F.col("e.a")).select("f.a", "e.b").distinct()
        frontier = step.join(out, ["a", "b"], "left_anti")
        out = out.union(frontier)
    return out
