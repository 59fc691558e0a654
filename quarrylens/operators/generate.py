"""Row producers and SQL texts made from schemas: sample rows, upserts, DDL, comments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def sample_rows(spark: SparkSession, schema: T.StructType, n: int) -> DataFrame:
    """n rows by rule: row i (from 1) has i in integers, i / 2 in fractions, name_i in texts, days from 2024-01-01, i odd in booleans."""
    i = F.col("id") + 1

    def value(f: T.StructField):
        d = f.dataType
        if isinstance(d, (T.IntegerType, T.LongType, T.ShortType)):
            return i.cast(d)
        if isinstance(d, (T.DoubleType, T.FloatType, T.DecimalType)):
            return (i / 2).cast(d)
        if isinstance(d, T.BooleanType):
            return i % 2 == 1
        if isinstance(d, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            return F.date_add(F.lit("2024-01-01").cast("date"), (i - 1).cast("int")).cast(d)
        return F.concat(F.lit(f"{f.name}_"), i.cast("string"))

    return spark.range(n).select(*(value(f).alias(f.name) for f in schema.fields))


def overlap_warning(domains: list[int], rows: int) -> bool:
    """Whether keys made of cycling domains repeat within so many rows: their least common multiple is less."""
    from math import lcm

    return lcm(*domains) < rows if domains else rows > 1


QUOTES = {"postgresql": '""', "oracle": '""', "mariadb": "``", "mysql": "``", "mssql": "[]"}
TYPES = {
    "postgresql": {"string": "text", "int": "integer", "bigint": "bigint", "double": "double precision", "boolean": "boolean", "date": "date", "timestamp": "timestamp", "binary": "bytea"},
    "oracle": {"string": "VARCHAR2(4000)", "int": "NUMBER(10)", "bigint": "NUMBER(19)", "double": "BINARY_DOUBLE", "boolean": "NUMBER(1)", "date": "DATE", "timestamp": "TIMESTAMP", "binary": "BLOB"},
    "mariadb": {"string": "LONGTEXT", "int": "INT", "bigint": "BIGINT", "double": "DOUBLE", "boolean": "TINYINT(1)", "date": "DATE", "timestamp": "DATETIME(6)", "binary": "LONGBLOB"},
    "mssql": {"string": "NVARCHAR(MAX)", "int": "INT", "bigint": "BIGINT", "double": "FLOAT", "boolean": "BIT", "date": "DATE", "timestamp": "DATETIME2", "binary": "VARBINARY(MAX)"},
}


def quoted(name: str, dialect: str) -> str:
    a, b = QUOTES[dialect]
    return f"{a}{name.replace(b, b * 2)}{b}"


def ddl(name: str, schema: T.StructType, dialect: str, keys: list[str]) -> str:
    kinds = TYPES[dialect]
    lines = []
    for f in schema.fields:
        base = f.dataType.simpleString().replace("_ntz", "")
        kind = f"DECIMAL({f.dataType.precision},{f.dataType.scale})" if isinstance(f.dataType, T.DecimalType) else kinds.get(base, kinds["string"])
        lines.append(f"  {quoted(f.name, dialect)} {kind}" + ("" if f.nullable and f.name not in keys else " NOT NULL"))
    if keys:
        lines.append(f"  PRIMARY KEY ({', '.join(quoted(k, dialect) for k in keys)})")
    return f"CREATE TABLE {quoted(name, dialect)} (\n" + ",\n".join(lines) + "\n);"


def upsert(name: str, columns: list[str], keys: list[str], dialect: str) -> str:
    """An upsert with binds; without a key the first column counts as one; with keys only nothing is updated."""
    keys = keys or columns[:1]
    rest = [c for c in columns if c not in keys]
    q = lambda c: quoted(c, dialect)
    into = f"INSERT INTO {q(name)} ({', '.join(map(q, columns))}) VALUES ({', '.join('?' * len(columns))})"
    if dialect == "postgresql":
        return into + f" ON CONFLICT ({', '.join(map(q, keys))}) " + (f"DO UPDATE SET {', '.join(f'{q(c)} = EXCLUDED.{q(c)}' for c in rest)}" if rest else "DO NOTHING")
    if dialect in ("mariadb", "mysql"):
        return into + " ON DUPLICATE KEY UPDATE " + ", ".join(f"{q(c)} = VALUES({q(c)})" for c in rest or keys[:1])
    source = ", ".join(f"? AS {q(c)}" for c in columns) + (" FROM DUAL" if dialect == "oracle" else "")
    on = " AND ".join(f"t.{q(c)} = s.{q(c)}" for c in keys)
    matched = f" WHEN MATCHED THEN UPDATE SET {', '.join(f't.{q(c)} = s.{q(c)}' for c in rest)}" if rest else ""
    return f"MERGE INTO {q(name)} t USING (SELECT {source}) s ON ({on}){matched} WHEN NOT MATCHED THEN INSERT ({', '.join(map(q, columns))}) VALUES ({', '.join(f's.{q(c)}' for c in columns)})" + (";" if dialect == "mssql" else "")


def comment_ddl(columns: DataFrame) -> DataFrame:
    """table_name, name, sql: COMMENT statements; names that were not found whole (source none or mix) come commented out."""
    text = F.concat(F.lit("COMMENT ON COLUMN "), "table_name", F.lit("."), "name", F.lit(" IS '"), F.replace("logical", F.lit("'"), F.lit("''")), F.lit("';"))
    return columns.select("table_name", "name", F.when(F.col("source").isin("none", "mix"), F.concat(F.lit("-- "), text)).otherwise(text).alias("sql"))
