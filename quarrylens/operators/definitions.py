"""Definition documents over metadata relations: key participation, lengths, constraint texts, comment fill, sizes,
business classes, and candidates for code tables and interface tables. All are expressions and groupings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylens.functions.text import JS_SPACE


def filled(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), JS_SPACE, "") != ""


def comment_fill(tables: DataFrame, columns: DataFrame) -> DataFrame:
    """level, with_comment, total for tables and for columns."""
    one = lambda df, level: df.agg(F.count_if(filled(F.col("comment"))).alias("with_comment"), F.count("*").alias("total")).select(F.lit(level).alias("level"), "with_comment", "total")
    return one(tables, "table").union(one(columns, "column"))


def size_text(total: Column) -> Column:
    """Bytes as MB below one GB, as GB from there on, with one decimal; empty if unknown."""
    mb = total / F.lit(1024.0 * 1024.0)
    return F.when(total.isNull(), "").when(mb < 1024, F.format_string("%.1f MB", mb)).otherwise(F.format_string("%.1f GB", mb / 1024))


def mb_text(total: Column) -> Column:
    """Bytes as MB of any size with one decimal, halves to the even one; null if unknown."""
    mb = F.bround(total / F.lit(1024.0 * 1024.0), 1)
    return F.when(mb.isNotNull(), F.format_string("%.1f MB", mb))


def schema_size(schemas: DataFrame) -> DataFrame:
    """The sum of the sizes that are known; null, not zero, if none is."""
    return schemas.agg(size_text(F.sum("size_bytes")).alias("size"))


def length_text(length: Column, precision: Column, scale: Column) -> Column:
    number = F.concat(precision.cast("string"), F.when(scale > 0, F.concat(F.lit(","), scale.cast("string"))).otherwise(""))
    return F.coalesce(length.cast("string"), number, F.lit(""))


def key_info(columns: DataFrame, constraints: DataFrame) -> DataFrame:
    """table_name, name, pk, ak, fk: PK01 by place in the primary key, AK_1-01 by unique key and place, referenced columns (the table alone where a key names none)."""
    each = constraints.select("table_name", "kind", F.col("name").alias("constraint"), "ref_table", "ref_columns", F.posexplode("columns").alias("at", "column"))
    numbered = each.where("kind = 'UQ'").select("table_name", "constraint").distinct().withColumn("k", F.row_number().over(Window.partitionBy("table_name").orderBy("constraint")))
    each = each.join(numbered, ["table_name", "constraint"], "left").withColumn("key", F.upper("column"))
    text = (
        F.when(F.col("kind") == "PK", F.format_string("PK%02d", F.col("at") + 1))
        .when(F.col("kind") == "UQ", F.format_string("AK_%d-%02d", "k", F.col("at") + 1))
        .when(F.col("kind") == "FK", F.concat_ws(".", "ref_table", F.get("ref_columns", F.col("at"))))
    )
    each = each.where("kind in ('PK', 'UQ', 'FK')").select("table_name", "key", "kind", "constraint", text.alias("text"))
    joined = lambda kind: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("constraint", "text")))), lambda x: x["text"]), ", ")
    found = each.groupBy("table_name", "key").agg(joined("PK").alias("pk"), joined("UQ").alias("ak"), joined("FK").alias("fk"))
    out = columns.select("table_name", "name", F.upper("name").alias("key")).join(found, ["table_name", "key"], "left")
    return out.select("table_name", "name", *(F.coalesce(c, F.lit("")).alias(c) for c in ("pk", "ak", "fk")))


def constraint_text(columns: DataFrame, checks: DataFrame) -> DataFrame:
    """table_name, name, text: a column's default, and the checks that name it outside of quoted text. checks: table_name, condition."""
    bare = F.regexp_replace("condition", r"'(?:[^']|'')*+'", "''")
    words = F.transform(F.regexp_extract_all(bare, F.lit(r"([\p{L}_][\p{L}\p{N}_$#]*)"), F.lit(1)), lambda x: F.upper(x))
    named = checks.select("table_name", "condition", F.explode(F.array_distinct(words)).alias("key"))
    found = named.groupBy("table_name", "key").agg(F.array_sort(F.collect_list(F.concat(F.lit("CHECK ("), "condition", F.lit(")")))).alias("checks"))
    out = columns.select("table_name", "name", F.upper("name").alias("key"), "default_value").join(found, ["table_name", "key"], "left")
    default = F.when(filled(F.col("default_value")), F.concat(F.lit("DEFAULT "), F.trim("default_value")))
    return out.select("table_name", "name", F.concat_ws("; ", default, F.array_join("checks", "; ")).alias("text")).withColumn("text", F.regexp_replace("text", "; $", ""))


def classified(table_name: Column, business: dict[str, list[str]]) -> Column:
    """The first class with a prefix or, if written /.../, a whole-name pattern that fits, without case; else empty."""
    fits = lambda item: table_name.rlike(f"(?i)^(?:{item[1:-1]})$") if item.startswith("/") and item.endswith("/") else F.upper(table_name).startswith(item.upper())
    arms = [F.when(reduce(lambda a, b: a | b, [fits(i) for i in items if i.strip()]), name) for name, items in business.items() if any(i.strip() for i in items)]
    return F.coalesce(*arms, F.lit(""))


def interface_candidates(tables: DataFrame) -> DataFrame:
    """table_name, why: names with IF, RCV or SND, comments that speak of interfaces, and views."""
    up, comment = F.upper("table_name"), F.coalesce("comment", F.lit(""))
    why = F.concat_ws(
        ", ",
        F.when(up.startswith("IF") | up.contains("_IF_"), "name IF"),
        *(F.when(up.contains(x), f"name {x}") for x in ("RCV", "SND")),
        *(F.when(comment.contains(x), f"comment {x}") for x in ("연계", "수신", "송신")),
        F.when(F.upper("table_type").contains("VIEW"), "view"),
    )
    return tables.select("table_name", why.alias("why")).where("why <> ''")


def code_candidates(tables: DataFrame, columns: DataFrame) -> DataFrame:
    """table_name, grp, code, name: tables that look like code tables by name or comment, and hold a code and a name column; of several codes one may be the group."""
    up = F.upper("name")
    role = (
        F.when(up.endswith("_YN") | up.startswith("USE"), "use").when(up.endswith("CD") | up.endswith("CODE"), "code").when(up.endswith("NM") | up.endswith("NAME"), "name")
    )
    looks = F.upper("table_name").rlike("CD|CODE|COMM") | F.coalesce("comment", F.lit("")).contains("코드")
    roles = columns.select("table_name", "name", "ordinal", role.alias("role")).where("role in ('code', 'name')")
    rows = roles.groupBy("table_name").agg(
        F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == "code", F.struct("ordinal", "name")))), lambda x: x["name"]).alias("codes"),
        F.min_by("name", F.when(F.col("role") == "name", F.col("ordinal"))).alias("name"),
        F.count_if(F.col("role") == "name").alias("names"),
    )
    group = F.coalesce(F.get(F.filter("codes", lambda x: F.upper(x).rlike("GROUP|GRP|UPPER|UP_|PARENT|PRNT")), F.lit(0)), F.get("codes", F.lit(0)))
    rows = rows.where("size(codes) > 0 and names > 0").withColumn("grp", F.when(F.size("codes") > 1, group))
    rest = F.filter("codes", lambda x: ~x.eqNullSafe(F.col("grp")))
    code = F.coalesce(F.element_at(F.when(F.size(rest) > 0, rest), -1), F.element_at("codes", -1))
    return rows.join(tables.where(looks).select("table_name"), "table_name", "left_semi").select("table_name", "grp", code.alias("code"), "name")


def document_rows(rows: DataFrame, *order: str) -> DataFrame:
    """Rows numbered from 1 in the order of a document; a document is one schema's metadata, so its single window is small."""
    return rows.withColumn("no", F.row_number().over(Window.orderBy(*order)))
