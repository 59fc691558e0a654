"""Column inputs of a naming run, from lists that people keep or from a snapshot; snapshots read back as nested rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylens.functions.text import js_trim

#: Fixed lists: header words by which a list's columns are known, and values that mean a key.
HEADERS = {
    "owner": ("OWNER", "스키마", "DB명"),
    "table_name": ("TABLE_NAME", "테이블"),
    "name": ("COLUMN_NAME", "컬럼"),
    "pk": ("PK", "기본키"),
    "ordinal": ("COLUMN_ID", "ORDINAL_POSITION", "컬럼순서", "순서"),
    "native_type": ("DATA_TYPE", "타입", "데이터타입"),
    "length": ("DATA_LENGTH", "LENGTH", "길이"),
    "scale": ("DATA_SCALE", "SCALE", "소수점"),
    "not_null": ("NULLABLE", "IS_NULLABLE", "NOT_NULL", "NOTNULL", "NOT NULL", "널여부"),
}
PK_YES = ("Y", "1", "P", "PK", "TRUE", "T", "YES", "예")
YES, NO = ("Y", "YES", "TRUE", "T", "1"), ("N", "NO", "FALSE", "F", "0")


def guess(headers: list[str], words: tuple[str, ...]) -> str | None:
    """The first header that is one of the words, else the first that holds one; the words in their order."""
    up = [h.strip().upper() for h in headers]
    for test in (lambda h, w: h == w, lambda h, w: w in h):
        for w in words:
            for header, h in zip(headers, up):
                if test(h, w.upper()):
                    return header
    return None


def not_null(value: Column, header: str) -> Column:
    """Y or N for NOT NULL: a NULLABLE header turns yes and no round; empty for anything else."""
    v, turned = F.upper(js_trim(value)), "NULLABLE" in header.upper()
    yes, no = (NO, YES) if turned else (YES, NO)
    return F.when(v.isin("NOT NULL", "NOTNULL", *yes), "Y").when(v.isin("NULL", *no), "N").otherwise("")


def column_inputs(rows: DataFrame, owner: str = "", order: str | None = None) -> DataFrame:
    """owner, table_name, name, native_type, length, scale, pk, not_null, ordinal of a column list, whose columns are known by their headers.

    A list without a column for names is refused; one without a column for tables is read with null tables. `order` names
    a column of row numbers that stands in for missing ordinals."""
    found = {k: guess([c for c in rows.columns if c != order], words) for k, words in HEADERS.items()}
    if found["name"] is None:
        raise ValueError(f"no column of names: one header must be among {', '.join(HEADERS['name'])}")
    cell = lambda k, missing: F.coalesce(F.col(f"`{found[k]}`").cast("string"), F.lit("")) if found[k] else missing
    trimmed = lambda k: js_trim(cell(k, F.lit("")))
    pk = F.when(F.upper(trimmed("pk")).isin(*PK_YES), "Y").otherwise("N") if found["pk"] else F.lit("")
    ordinal = trimmed("ordinal") if found["ordinal"] else F.col(order).cast("string") if order else F.lit("")
    return rows.select(
        cell("owner", F.lit(owner)).alias("owner"), cell("table_name", F.lit(None).cast("string")).alias("table_name"), cell("name", F.lit("")).alias("name"), trimmed("native_type").alias("native_type"),
        trimmed("length").alias("length"), trimmed("scale").alias("scale"), pk.alias("pk"), (not_null(cell("not_null", F.lit("")), found["not_null"]) if found["not_null"] else F.lit("")).alias("not_null"), ordinal.alias("ordinal"),
    )


def snapshot_inputs(columns: DataFrame, pks: DataFrame) -> DataFrame:
    """The same rows from a snapshot: columns (owner, table_name, name, ordinal, native_type, length, precision, scale, nullable) and pks (owner, table_name, columns)."""
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    keys = pks.select("owner", "table_name", F.explode("columns").alias("name"), F.lit("Y").alias("pk")).distinct()
    joined = columns.join(keys, ["owner", "table_name", "name"], "left")
    return joined.select(
        "owner", "table_name", "name", text(F.col("native_type")).alias("native_type"), text(F.coalesce("length", "precision")).alias("length"), text(F.col("scale")).alias("scale"),
        F.coalesce("pk", F.lit("N")).alias("pk"), F.when(F.col("nullable"), "N").otherwise("Y").alias("not_null"), text(F.col("ordinal")).alias("ordinal"),
    )


def nested_tables(tables: DataFrame, columns: DataFrame, constraints: DataFrame, schema: str | None = None, name: str | None = None) -> DataFrame:
    """schema_name, table_name, columns and constraints (arrays of structs in order) of a snapshot's tables; schema and name are optional conditions.

    With a name but no schema, the table of the first schema by name is read."""
    own = tables.where(F.lit(True) if schema is None else F.col("schema_name") == schema).where(F.lit(True) if name is None else F.col("table_name") == name).select("schema_name", "table_name")
    if name is not None and schema is None:
        own = own.groupBy("table_name").agg(F.min("schema_name").alias("schema_name")).select("schema_name", "table_name")
    keys = ["schema_name", "table_name"]
    cols = columns.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("ordinal", "name", "native_type"))).alias("columns"))
    cons = constraints.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("kind", "name", "columns"))).alias("constraints"))
    return own.join(cols, keys, "left").join(cons, keys, "left")


def scope_summary(scope) -> str:
    """A scope's conditions as one line; empty if it filters nothing."""
    parts = [f"{label} {', '.join(values)}" for label, values in (("schemas", scope.schemas), ("prefix", scope.prefixes), ("suffix", scope.suffixes), ("without", scope.excluded)) if values]
    parts += [f"pattern {scope.pattern}"] if scope.pattern else []
    parts += ["without empty tables"] if scope.skip_empty else []
    return "; ".join(parts)


def is_filtered(scope) -> bool:
    return bool(scope_summary(scope))


def in_scope(tables: DataFrame, scope) -> DataFrame:
    """The tables (schema_name, table_name, row_count) that a scope leaves in; schemas without any table left have no row."""
    return tables.where(scope.reason(F.col("schema_name"), F.col("table_name"), F.col("row_count")) == "")
