"""The plan that turns one snapshot of tables into another: one row for each statement, those that lose data as comments."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylens.functions.names import java_type, quoted
from quarrylens.session import scratch

#: Fixed order of the plan's sections.
SECTIONS = ("drop foreign keys", "drop indexes", "new tables", "changed tables", "add indexes", "add foreign keys", "drop tables")
ADD = {"oracle": " ADD (", "tibero": " ADD (", "mssql": " ADD "}


def _type(prefix: str) -> Column:
    """A column's native type with its sizes."""
    size = F.when(F.col(f"{prefix}length").isNotNull(), F.concat(F.lit("("), F.col(f"{prefix}length").cast("string"), F.when(F.col(f"{prefix}scale") > 0, F.concat(F.lit(","), F.col(f"{prefix}scale").cast("string"))).otherwise(""), F.lit(")")))
    return F.concat(F.col(f"{prefix}native_type"), F.coalesce(size, F.lit("")))


def _row(section: str, what: Column, text: Column, tag: Column | None = None) -> Column:
    return F.struct(F.lit(SECTIONS.index(section) + 1).alias("section"), what.alias("name"), text.alias("text"), (F.lit("") if tag is None else tag).alias("tag"))


def alter_plan(old: DataFrame, new: DataFrame, old_keys: DataFrame, new_keys: DataFrame, dialect: str = "postgresql") -> DataFrame:
    """section, table_name, name, text, tag of the statements that make `new` of `old`; names compare without case, views are left out before.

    Columns: table_name, name, native_type, length, scale, nullable, default_value. Keys: table_name, name, kind (PK, UQ, IX,
    FK, CK), columns, ref_table, ref_columns and, for CK, condition; one that differs is dropped and added again. Tags: `delete`
    (what loses data; its text is a comment), `data` (what fails or changes values where rows stand against it), `hand` (what no
    statement can do without a name that is not known; a comment), `rename` (a table both loses and gains columns)."""
    name = lambda c: quoted(F.col(c), dialect)
    fields = ("name", "native_type", "length", "scale", "nullable", "default_value")
    side = lambda df, p: df.select(F.upper("table_name").alias("t"), F.upper("name").alias("c"), F.col("table_name").alias(f"{p}table"), *(F.col(f).alias(f"{p}{f}") for f in fields))
    both = scratch(old.sparkSession, side(old, "o_").join(side(new, "n_"), ["t", "c"], "full_outer"), "alter-columns")  # five kinds of statements read it
    tables = both.groupBy("t").agg(F.max("o_table").alias("before"), F.max("n_table").alias("after"))
    default = F.when(F.col("n_default_value").isNotNull(), F.concat(F.lit(" DEFAULT "), F.col("n_default_value"))).otherwise("")
    shrinks = (F.col("n_length") < F.col("o_length")) | (F.col("n_scale") < F.col("o_scale"))
    family = lambda p: java_type(F.col(f"{p}native_type"), F.col(f"{p}length"), F.col(f"{p}scale"))
    risky = F.coalesce(shrinks, F.lit(False)) | ~family("o_").eqNullSafe(family("n_"))
    parts = {
        "x_risky": risky, "x_table": F.concat(F.lit("ALTER TABLE "), quoted(F.coalesce("before", "after"), dialect)), "x_new": name("n_name"), "x_old": name("o_name"), "x_type": _type("n_"),
        "x_defined": F.concat(name("n_name"), F.lit(" "), _type("n_"), default, F.when(F.col("n_nullable"), "").otherwise(" NOT NULL")),
    }
    both = scratch(old.sparkSession, both.join(tables, "t").withColumns(parts), "alter-texts")  # pieces that many statements use
    table, defined, risky = F.col("x_table"), F.col("x_defined"), F.col("x_risky")
    opening, closing = ADD.get(dialect, " ADD COLUMN "), ")" if dialect in ("oracle", "tibero") else ""
    needs_value = ~F.col("n_nullable") & F.col("n_default_value").isNull()
    added = F.when(F.col("o_name").isNull(), _row("changed tables", F.col("n_name"), F.concat(table, F.lit(opening), defined, F.lit(closing)), F.when(needs_value, "data").otherwise("")))
    dropped = F.when(F.col("n_name").isNull(), _row("changed tables", F.col("o_name"), F.concat(F.lit("-- "), table, F.lit(" DROP COLUMN "), F.col("x_old")), F.lit("delete")))
    kept = F.col("o_name").isNotNull() & F.col("n_name").isNotNull()
    differ = lambda *fs: ~_same(fs)
    retyped, redefault, renull = _column_changes(dialect, table, F.col("x_new"), defined, kept, differ, risky)
    changed = both.where("before is not null and after is not null")
    rows = changed.select("t", F.explode(F.array_compact(F.array(added, retyped, redefault, renull, dropped))).alias("r")).select("t", "r.*")
    moved = changed.groupBy("t").agg(F.max(F.col("o_name").isNull()).alias("gains"), F.max(F.col("n_name").isNull()).alias("loses")).where("gains and loses")
    rename = moved.select("t", F.lit(SECTIONS.index("changed tables") + 1).alias("section"), F.lit("").alias("name"), F.lit("-- columns are both dropped and added: RENAME if a name changed").alias("text"), F.lit("rename").alias("tag"))
    created = both.where("before is null").groupBy("t", "after").agg(F.array_join(F.array_sort(F.collect_list(defined)), ", ").alias("columns"))
    created = created.select("t", F.lit(SECTIONS.index("new tables") + 1).alias("section"), F.lit("").alias("name"), F.concat(F.lit("CREATE TABLE "), name("after"), F.lit(" ("), F.col("columns"), F.lit(")")).alias("text"), F.lit("").alias("tag"))
    gone = tables.where("after is null").select("t", F.lit(SECTIONS.index("drop tables") + 1).alias("section"), F.lit("").alias("name"), F.concat(F.lit("-- DROP TABLE "), name("before")).alias("text"), F.lit("delete").alias("tag"))
    out = rows.unionByName(rename).unionByName(created).unionByName(gone).unionByName(_key_rows(old_keys, new_keys, tables, dialect))
    return out.select(F.element_at(F.array(*map(F.lit, SECTIONS)), F.col("section")).alias("section"), F.col("t").alias("table_name"), "name", "text", "tag")


def _column_changes(dialect: str, table: Column, column: Column, defined: Column, kept: Column, differ, risky: Column) -> tuple[Column, Column, Column]:
    """The statements for a changed type, default and nullability, as each dialect has them; a column may need one, two or three.

    MariaDB and MySQL define the whole column anew, SQL Server its type with its nullability; its defaults are constraints, of
    which one that stands can only be dropped by the name that the server gave it, so that is left to a hand (a comment)."""
    name, type_, default = F.col("n_name"), F.col("x_type"), F.col("n_default_value")
    typed, nulled, defaulted = kept & differ("native_type", "length", "scale"), kept & differ("nullable"), kept & differ("default_value")
    row = lambda when, text, tag=None: F.when(when, _row("changed tables", name, F.concat(table, *text), tag))
    tightens = nulled & ~F.col("n_nullable")
    data = F.when(typed & risky | tightens, "data").otherwise("")
    null, set_default = F.when(F.col("n_nullable"), " NULL").otherwise(" NOT NULL"), F.concat(F.lit(" SET DEFAULT "), default)
    if dialect in ("mariadb", "mysql"):
        whole = typed | nulled
        return row(whole, (F.lit(" MODIFY COLUMN "), defined), data), row(defaulted & ~whole, (F.lit(" ALTER COLUMN "), column, F.coalesce(set_default, F.lit(" DROP DEFAULT")))), F.lit(None).cast("struct<section:int,name:string,text:string,tag:string>")
    if dialect == "mssql":
        fresh = F.concat(F.lit(" ADD CONSTRAINT "), quoted(F.concat(F.lit("DF_"), F.coalesce("before", "after"), F.lit("_"), name), dialect), F.lit(" DEFAULT "), default, F.lit(" FOR "), column)
        by_hand = F.concat(F.lit("-- the default of "), column, F.lit(" is a constraint: DROP it by its name"), F.coalesce(F.concat(F.lit(", then ADD CONSTRAINT ... DEFAULT "), default, F.lit(" FOR "), column), F.lit("")))
        plain = F.col("o_default_value").isNull() & default.isNotNull()
        default_row = F.when(defaulted, _row("changed tables", name, F.when(plain, F.concat(table, fresh)).otherwise(by_hand), F.when(plain, "").otherwise("hand")))
        return row(typed | nulled, (F.lit(" ALTER COLUMN "), column, F.lit(" "), type_, null), data), default_row, F.lit(None).cast("struct<section:int,name:string,text:string,tag:string>")
    if dialect in ("oracle", "tibero"):
        modify = lambda what: (F.lit(" MODIFY ("), column, *what, F.lit(")"))
        return row(typed, modify((F.lit(" "), type_)), F.when(risky, "data").otherwise("")), row(defaulted, modify((F.lit(" DEFAULT "), F.coalesce(default, F.lit("NULL"))))), row(nulled, modify((null,)), F.when(tightens, "data").otherwise(""))
    alter = lambda *what: (F.lit(" ALTER COLUMN "), column, *what)
    return (
        row(typed, alter(F.lit(" TYPE "), type_), F.when(risky, "data").otherwise("")),
        row(defaulted, alter(F.coalesce(set_default, F.lit(" DROP DEFAULT")))),
        row(nulled, alter(F.when(F.col("n_nullable"), " DROP NOT NULL").otherwise(" SET NOT NULL")), F.when(tightens, "data").otherwise("")),
    )


def _same(fields: tuple[str, ...]) -> Column:
    out = F.lit(True)
    for f in fields:
        out = out & F.col(f"o_{f}").eqNullSafe(F.col(f"n_{f}"))
    return out


def _key_rows(old: DataFrame, new: DataFrame, tables: DataFrame, dialect: str) -> DataFrame:
    """Keys that only one side has, or that differ: dropped by name and added again. Keys of dropped tables go with them.

    Primary keys are matched by their columns alone, CHECK conditions (column `condition`, if there is one) by their words; a
    key without a name can only be dropped by hand."""
    mysql, squeezed = dialect in ("mariadb", "mysql"), F.trim(F.regexp_replace("condition", r"\s+", " "))
    upper = lambda c: F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.upper(x))

    def shaped(df: DataFrame) -> DataFrame:
        df = df if "condition" in df.columns else df.withColumn("condition", F.lit(None).cast("string"))
        df = df.withColumns({"columns": upper(F.col("columns")), "ref_columns": upper(F.col("ref_columns")), "condition": F.when(F.col("kind") == "CK", squeezed)})
        by = F.when(F.col("kind").isin("PK", "CK"), "").otherwise(F.upper("name"))
        return df.select(F.upper("table_name").alias("t"), by.alias("k"), "name", "kind", "columns", F.upper("ref_table").alias("ref_table"), "ref_columns", "condition")

    a, b = shaped(old).join(tables.where("after is not null").select("t"), "t", "left_semi"), shaped(new)
    on = ["t", "k", "kind", "columns", "ref_table", "ref_columns", "condition"]
    match = lambda x, y: reduce(lambda p, q: p & q, [x[c].eqNullSafe(y[c]) for c in on])
    listed = lambda c: F.array_join(F.transform(c, lambda x: quoted(x, dialect)), ", ")
    kind = F.col("kind")
    texts = {"q_name": quoted(F.col("name"), dialect), "q_table": quoted(F.col("t"), dialect), "q_named": quoted(F.coalesce("name", F.concat(kind, F.lit("_"), "t")), dialect), "q_columns": listed("columns"), "q_ref": quoted(F.col("ref_table"), dialect), "q_refs": listed("ref_columns")}
    of = lambda df, side: df.withColumns(texts).withColumn("side", F.lit(side))
    both = scratch(old.sparkSession, of(a.join(b, match(a, b), "left_anti"), "lost").union(of(b.join(a, match(b, a), "left_anti"), "gained")), "alter-keys")
    lost, gained = both.where("side = 'lost'"), both.where("side = 'gained'")
    name, table = F.col("q_name"), F.concat(F.lit("ALTER TABLE "), F.col("q_table"))
    on_table = F.concat(F.lit(" ON "), "q_table") if mysql or dialect == "mssql" else F.lit("")
    by_name = F.concat(table, F.lit(" DROP CONSTRAINT "), name)
    dropped = F.when(kind == "IX", F.concat(F.lit("DROP INDEX "), name, on_table))
    if mysql:
        dropped = dropped.when(kind == "PK", F.concat(table, F.lit(" DROP PRIMARY KEY"))).when(kind == "UQ", F.concat(table, F.lit(" DROP INDEX "), name)).when(kind == "FK", F.concat(table, F.lit(" DROP FOREIGN KEY "), name))
    dropped = dropped.otherwise(by_name)
    shape = F.concat(kind, F.lit("("), F.coalesce("condition", F.array_join("columns", ",")), F.lit(")"))
    unnamed = F.col("name").isNull() & ~((kind == "PK") & F.lit(mysql))
    drop = F.when(unnamed, F.concat(F.lit("-- the name of "), shape, F.lit(" on "), "q_table", F.lit(" is not known: DROP it by hand"))).otherwise(dropped)
    named = F.col("q_named")
    body = F.when(kind == "FK", F.concat(F.lit("FOREIGN KEY ("), F.col("q_columns"), F.lit(") REFERENCES "), F.col("q_ref"), F.lit(" ("), F.col("q_refs"), F.lit(")")))
    body = body.when(kind == "CK", F.concat(F.lit("CHECK ("), "condition", F.lit(")"))).when(kind == "PK", F.concat(F.lit("PRIMARY KEY ("), F.col("q_columns"), F.lit(")"))).otherwise(F.concat(F.lit("UNIQUE ("), F.col("q_columns"), F.lit(")")))
    made = F.concat(table, F.lit(" ADD "), F.when((kind == "PK") & F.lit(mysql), "").otherwise(F.concat(F.lit("CONSTRAINT "), named, F.lit(" "))), body)
    make = F.when(kind == "IX", F.concat(F.lit("CREATE INDEX "), named, F.lit(" ON "), F.col("q_table"), F.lit(" ("), F.col("q_columns"), F.lit(")"))).otherwise(made)
    place = lambda x: SECTIONS.index(x) + 1
    section = lambda fk, other: F.when(kind == "FK", place(fk)).when(kind.isin("PK", "CK"), place("changed tables")).otherwise(place(other)).alias("section")
    shown = F.coalesce("name", kind).alias("name")
    gone = lost.select("t", section("drop foreign keys", "drop indexes"), shown, drop.alias("text"), F.when(unnamed, "hand").otherwise("").alias("tag"))
    return gone.union(gained.select("t", section("add foreign keys", "add indexes"), shown, make.alias("text"), F.lit("").alias("tag")))
