"""Catalog rows to metadata relations: the shapes of driver and dictionary queries, vendor overlays, dictionaries, menus.

Inputs are rows as a JDBC driver or a vendor's dictionary view gives them; outputs are the relations of metadata.py.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrylens.functions.text import url_normalise

#: Fixed set: schemas that belong to the system.
SYSTEM = ("INFORMATION_SCHEMA", "PG_CATALOG", "SYS", "SYSTEM", "MYSQL", "PERFORMANCE_SCHEMA", "XDB", "CTXSYS", "MDSYS", "OUTLN", "DBSNMP")


def user_schemas(schemas: DataFrame) -> DataFrame:
    up = F.upper("schema_name")
    return schemas.where(~up.isin(*SYSTEM) & ~up.startswith("PG_TEMP") & ~up.startswith("PG_TOAST"))


def first_columns(rows: DataFrame) -> DataFrame:
    """Columns in order, the first of a repeated name; a table's columns are few, so its window is small."""
    w = Window.partitionBy("table_name", "name").orderBy("ordinal")
    return rows.withColumn("k__", F.row_number().over(w)).where("k__ = 1").drop("k__")


def _ordered(*what: str):
    return F.transform(F.array_sort(F.collect_list(F.struct("seq", *what))), lambda x: x[what[0]])


def primary_keys(rows: DataFrame) -> DataFrame:
    """table_name, name, columns in key order. rows: table_name, name, column, seq."""
    return rows.groupBy("table_name", "name").agg(_ordered("column").alias("columns"))


def foreign_keys(rows: DataFrame) -> DataFrame:
    """Foreign keys by name with both column lists; a reference within the schema has a null schema."""
    grouped = rows.groupBy("schema_name", "table_name", "name", "ref_schema", "ref_table").agg(_ordered("column").alias("columns"), _ordered("ref_column").alias("ref_columns"))
    return grouped.select("table_name", "name", "columns", F.nullif("ref_schema", "schema_name").alias("ref_schema"), "ref_table", "ref_columns")


def indexes(rows: DataFrame, pks: DataFrame) -> DataFrame:
    """Indexes with their columns; statistics rows (no name) and those named as the primary key are left out."""
    named = rows.where(F.col("name").isNotNull()).join(pks.select("table_name", "name"), ["table_name", "name"], "left_anti")
    return named.groupBy("table_name", "name", "is_unique").agg(_ordered("column").alias("columns"))


def unique_keys(rows: DataFrame, pks: DataFrame) -> DataFrame:
    """Unique indexes whose columns are not those of the primary key."""
    found = indexes(rows, pks).where("is_unique")
    return found.join(pks.select("table_name", "columns"), ["table_name", "columns"], "left_anti").select("table_name", "name", "columns")


def overlay(base: DataFrame, vendor: DataFrame, *fields: str) -> DataFrame:
    """base with the vendor's values of the fields where it has them; names compare without case."""
    key = F.upper("table_name").alias("key__")
    extra = vendor.select(key, *(F.col(f).alias(f"v_{f}__") for f in fields))
    joined = base.withColumn("key__", F.upper("table_name")).join(extra, "key__", "left")
    return joined.withColumns({f: F.coalesce(f"v_{f}__", f) for f in fields}).select(*base.columns)


def known_rows(stats: DataFrame) -> DataFrame:
    """Row estimates of a planner: zero or less means unknown."""
    return stats.withColumn("row_count", F.when(F.col("row_count") > 0, F.col("row_count")))


def partition_rows(partitions: DataFrame) -> DataFrame:
    """Rows of heaps and clustered indexes, summed over partitions."""
    return partitions.where(F.col("index_id").isin(0, 1)).groupBy("table_name").agg(F.sum("rows").alias("row_count"))


def key_positions(keys: DataFrame, attributes: DataFrame) -> DataFrame:
    """table_name, name, place, column: numbered attribute arrays of keys resolved to names."""
    each = keys.select("table_name", "name", F.posexplode("numbers").alias("at", "number"))
    return each.join(attributes, ["table_name", "number"]).select("table_name", "name", (F.col("at") + 1).alias("place"), "column")


def allocated(units: DataFrame, partitions: DataFrame) -> DataFrame:
    """table_name, pages: units of kinds 1 and 3 belong to a partition's hobt, of kind 2 to its id: two equi-joins, no nested loop."""
    a = units.where(F.col("kind").isin(1, 3)).join(partitions.select("table_name", F.col("hobt").alias("container")), "container")
    b = units.where(F.col("kind") == 2).join(partitions.select("table_name", F.col("id").alias("container")), "container")
    return a.select("table_name", "pages").union(b.select("table_name", "pages")).groupBy("table_name").agg(F.sum("pages").alias("pages"))


def own_checks(checks: DataFrame) -> DataFrame:
    """Checks that somebody wrote, without the system's own NOT NULL conditions."""
    return checks.where(~F.col("condition").rlike(r'(?i)^\s*"?[\w$#]+"?\s+IS\s+NOT\s+NULL\s*$'))


def upsert(current: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """current with the rows of new put in or put over those of the same keys."""
    return current.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new)


def domains_by_word(words: DataFrame) -> DataFrame:
    """word_ko, domain: the first entry's domain that is not empty, by id."""
    return words.groupBy("word_ko").agg(F.min_by("domain", F.struct(F.coalesce(F.col("domain"), F.lit("")) == "", "id")).alias("domain"))


def menus(rows: DataFrame) -> DataFrame:
    """path, menu, url, use of menu rows (path, url, use): paths split at > and joined evenly, urls cut at the query, uses as Y or N where they mean that; rows without a path are left out."""
    parts = F.filter(F.transform(F.split("path", "[>＞]"), lambda x: F.trim(x)), lambda x: x != "")
    up = F.upper(F.trim("use"))
    use = F.when(up.isin("Y", "YES", "TRUE", "1", "사용"), "Y").when(up.isin("N", "NO", "FALSE", "0", "미사용"), "N").otherwise(F.nullif(F.trim("use"), F.lit("")))
    out = rows.select(parts.alias("p"), url_normalise(F.col("url")).alias("url"), use.alias("use")).where("size(p) > 0")
    return out.select(F.array_join("p", " > ").alias("path"), F.element_at("p", -1).alias("menu"), "url", "use")


def derived_crud(methods: DataFrame) -> DataFrame:
    """method, crud of repository methods by their name's first word; null (unresolved) if it says nothing."""
    word = lambda *xs: F.col("method").rlike(f"^(?:{'|'.join(xs)})(?![a-z])")
    crud = F.when(word("find", "get", "read", "query", "search", "stream", "count", "exists"), "R").when(word("saveAll", "save", "saveAndFlush"), "CU").when(word("delete", "deleteAll", "remove"), "D")
    return methods.select("method", crud.alias("crud"))


def insert_warnings(rows: DataFrame, columns: DataFrame) -> DataFrame:
    """row, name, warning of values to insert: rows (row, name, value) against columns (name, native_type, length, nullable, has_default).

    Unknown headers, missing values of required columns, texts too long, and what is no number or date; values are kept."""
    joined = rows.join(columns, "name", "left")
    up, value = F.upper("native_type"), F.nullif("value", F.lit(""))
    warning = (
        F.when(up.isNull(), "unknown column")
        .when(value.isNull() & ~F.col("nullable") & ~F.col("has_default"), "required")
        .when(up.contains("CHAR") & (F.length(value) > F.col("length")), "too long")
        .when(up.rlike("NUM|INT|DEC") & ~value.rlike(r"^[+-]?[0-9]+(\.[0-9]+)?$"), "no number")
        .when(up.rlike("NUM|INT|DEC") & (F.length(F.regexp_extract(value, r"^[+-]?([0-9]+)", 1)) > F.col("length")), "too many digits")
        .when(up.startswith("DATE") & ~value.rlike(r"^([0-9]{8}|[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}/[0-9]{2}/[0-9]{2})"), "no date")
    )
    return joined.select("row", "name", warning.alias("warning")).where("warning is not null")


def restricted(findings: DataFrame, changed: DataFrame) -> DataFrame:
    """Findings of changed files only; unchanged ones have been seen for whatever spans files before."""
    return findings.join(changed.select("path").distinct(), "path", "left_semi")


def missing_screens(views: DataFrame, files: DataFrame) -> DataFrame:
    """view, programs: views without any file, with the number of programs that name them."""
    return views.join(files.select("view").distinct(), "view", "left_anti").groupBy("view").agg(F.countDistinct("program_id").alias("programs"))


def examples(missing: DataFrame, most: int = 3) -> DataFrame:
    """token, samples: up to `most` distinct table.column examples of a token, the least first; only as many are kept while grouping."""
    distinct = missing.select("token", F.concat_ws(".", "table_name", "name").alias("at")).distinct()
    w = Window.partitionBy("token").orderBy("at")
    ranked = distinct.withColumn("k", F.row_number().over(w)).where(F.col("k") <= most)
    return ranked.groupBy("token").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "at"))), lambda x: x["at"]), ", ").alias("samples"))


def index_columns(columns: DataFrame, expressions: DataFrame) -> DataFrame:
    """columns (owner, name, place, column, descending) with the expression in place of the generated column of an expression index."""
    own = expressions.select("owner", "name", "place", "expression")
    return columns.join(own, ["owner", "name", "place"], "left").select("owner", "name", "place", F.coalesce("expression", "column").alias("column"), "descending")


def described_columns(classes: DataFrame, namespaces: DataFrame, attributes: DataFrame, descriptions: DataFrame, schema: str) -> DataFrame:
    """table_name, column, comment of the living columns (number above 0, not dropped) of a schema's tables and views; number 0 in descriptions is the table itself."""
    own = classes.where(F.col("kind").isin("r", "p", "v")).join(namespaces.where(F.col("schema_name") == schema), "namespace").select("class", "table_name")
    living = attributes.where("number > 0 and not dropped").select("class", "number", "column")
    rows = own.join(living, "class").select("class", "table_name", "number", "column").union(own.select("class", "table_name", F.lit(0), F.lit("")))
    return rows.join(descriptions, ["class", "number"]).select("table_name", "column", "comment")


def extended_comments(objects: DataFrame, schemas: DataFrame, columns: DataFrame, properties: DataFrame, schema: str) -> DataFrame:
    """table_name, column, comment from the description properties of a schema's tables and views and of their columns."""
    own = objects.where(F.col("type").isin("U", "V")).join(schemas.where(F.col("schema_name") == schema), "schema_id").select("object_id", "table_name")
    said = properties.where("class = 1 and property = 'MS_Description'").select(F.col("major").alias("object_id"), F.col("minor").alias("column_id"), F.col("value").alias("comment"))
    parts = own.join(columns, "object_id").select("object_id", "column_id", "table_name", "column").union(own.select("object_id", F.lit(0), "table_name", F.lit("")))
    return parts.join(said, ["object_id", "column_id"]).select("table_name", "column", "comment")


def table_info(rows: DataFrame, schema: str) -> DataFrame:
    """table_name, comment, row_count, is_view of a schema: empty comments and a view's placeholder comment are none, views have no row count."""
    view = F.upper("type").contains("VIEW")
    comment = F.nullif(F.when(view & (F.upper("comment") == "VIEW"), F.lit("")).otherwise(F.trim("comment")), F.lit(""))
    return rows.where(F.col("schema_name") == schema).select("table_name", comment.alias("comment"), F.when(~view, F.col("row_count")).alias("row_count"), view.alias("is_view"))


def named_checks(checks: DataFrame, constraints: DataFrame) -> DataFrame:
    """table_name, name, condition of checks that carry no table: it comes from the constraint of that schema, name and kind."""
    own = constraints.where("type = 'CHECK'").select("schema_name", "name", "table_name")
    return checks.join(own, ["schema_name", "name"]).select("table_name", "name", "condition")


def schema_bytes(rows: DataFrame, schema: str) -> DataFrame:
    """One row: the bytes of a schema's data and indexes; a table that lacks either does not count, as a sum with null is null."""
    return rows.where(F.col("schema_name") == schema).agg(F.sum(F.col("data_bytes") + F.col("index_bytes")).alias("bytes"))


def listed_types(columns: DataFrame, types: DataFrame) -> DataFrame:
    """columns with the full type text of enum and set columns, which drivers give without their values."""
    full = types.where(F.lower("data_type").isin("enum", "set")).select("table_name", "name", "column_type")
    return columns.join(full, ["table_name", "name"], "left").withColumn("native_type", F.coalesce("column_type", "native_type")).drop("column_type")


def tables_of(rows: DataFrame, schema: str) -> DataFrame:
    """Tables and views of exactly one schema, whatever signs its name holds: plain equality, so nothing is to be escaped."""
    return rows.where((F.col("schema_name") == schema) & F.col("type").isin("TABLE", "VIEW"))


#: Fixed table: native types to the driver's type codes.
JDBC_CODES = {
    "CHAR": 1, "NUMBER": 2, "NUMERIC": 2, "DECIMAL": 3, "INTEGER": 4, "INT": 4, "SMALLINT": 5, "FLOAT": 6, "REAL": 7, "DOUBLE": 8, "BINARY_FLOAT": 6, "BINARY_DOUBLE": 8, "VARCHAR": 12, "VARCHAR2": 12,
    "NCHAR": -15, "NVARCHAR": -9, "NVARCHAR2": -9, "LONG": -1, "RAW": -3, "LONG RAW": -4, "DATE": 93, "TIMESTAMP": 93, "BLOB": 2004, "CLOB": 2005, "NCLOB": 2011,
}


def dictionary_columns(rows: DataFrame, owner: str) -> DataFrame:
    """table_name, name, ordinal, native_type, jdbc_type, length, nullable of an owner's dictionary rows: texts count in characters, numbers in digits; unknown types are OTHER (1111)."""
    plain = F.trim(F.regexp_replace(F.upper("data_type"), r"\(.*?\)", ""))
    code = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in JDBC_CODES.items() for x in kv)), plain), F.lit(1111))
    length = F.when(plain.contains("CHAR"), F.col("char_length")).otherwise(F.coalesce("data_precision", "data_length"))
    return rows.where(F.col("owner") == owner).select("table_name", F.col("column").alias("name"), F.col("column_id").alias("ordinal"), F.col("data_type").alias("native_type"), code.alias("jdbc_type"), length.alias("length"), (F.col("nullable") == "Y").alias("nullable"))
