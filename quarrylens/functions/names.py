"""Names and types of databases and programs: identifiers, quoting, camel case, paths, type maps, display values, SQL pieces by dialect."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrylens.functions.text import type_normalise

IDENTIFIER = r"^[\p{L}_][\p{L}\p{N}_$#@]*$"
#: Fixed list: words that some dialect reserves.
RESERVED = frozenset(
    "ACCESS ADD ALL ALTER ANALYZE AND ANY ARRAY AS ASC AUDIT BACKUP BEGIN BETWEEN BINARY BOTH BREAK BY CASE CAST CHANGE CHAR CHARACTER CHECK CLOSE CLUSTER COLLATE COLUMN COMMENT COMMIT COMPRESS CONDITION "
    "CONNECT CONSTRAINT CONVERT CREATE CROSS CURRENT CURSOR DATABASE DATE DECIMAL DECLARE DEFAULT DELETE DESC DISTINCT DO DOUBLE DROP ELSE END ESCAPE EXCEPT EXCLUSIVE EXEC EXECUTE EXISTS EXIT EXPLAIN FALSE FETCH "
    "FILE FLOAT FOR FOREIGN FROM FULL FUNCTION GRANT GROUP HAVING IDENTIFIED IF IMMEDIATE IN INCREMENT INDEX INITIAL INNER INSERT INT INTEGER INTERSECT INTERVAL INTO IS JOIN KEY KEYS KILL LATERAL LEADING LEFT LEVEL "
    "LIKE LIMIT LOCK LONG MERGE MINUS MODE MODIFY NATURAL NOT NOWAIT NULL NUMBER NUMERIC OF OFFLINE OFFSET ON ONLINE ONLY OPEN OPTION OR ORDER OUTER OVER PARTITION PCTFREE PERCENT PLAN PRIMARY PRINT PRIOR PROC "
    "PROCEDURE RANGE RAW READ REAL REFERENCES RENAME REPEAT REQUIRE RESOURCE RETURN RETURNING REVOKE RIGHT ROLLBACK ROW ROWID ROWNUM ROWS RULE SAVE SCHEMA SELECT SEPARATOR SESSION SET SHARE SHOW SIZE "
    "SMALLINT SOME SSL START SYNONYM SYSDATE TABLE THEN TO TOP TRAILING TRAN TRIGGER TRUE TRUNCATE UID UNION UNIQUE UPDATE USE USER USING VALIDATE VALUE VALUES VARCHAR VIEW WHEN WHERE WHILE WINDOW WITH".split()
)
#: Fixed list: words that Java keeps for itself.
JAVA_WORDS = frozenset(
    "abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if implements import instanceof int interface long native new package "
    "private protected public return short static strictfp super switch synchronized this throw throws transient try void volatile while true false null".split()
)
#: Fixed table: native types to Java types, the first that fits; a dialect's own rules hold for it only.
JAVA_TYPES = (
    (("DATE",), ("oracle", "tibero"), "java.time.LocalDateTime"),
    (("NUMBER", "NUMERIC", "DECIMAL", "DEC", "MONEY", "SMALLMONEY"), (), "decimal"),
    (tuple("VARCHAR,VARCHAR2,NVARCHAR,NVARCHAR2,CHARACTER VARYING,CHAR,NCHAR,CHARACTER,BPCHAR,TEXT,NTEXT,TINYTEXT,MEDIUMTEXT,LONGTEXT,CLOB,NCLOB,LONG,UUID,UNIQUEIDENTIFIER,JSON,JSONB,XML,ENUM,SET,UNIVARCHAR,UNICHAR,SYSNAME,CITEXT".split(",")), (), "String"),
    (("BIGINT", "INT8", "BIGSERIAL"), (), "Long"),
    (tuple("INT INTEGER INT4 SMALLINT INT2 TINYINT MEDIUMINT SERIAL SMALLSERIAL PLS_INTEGER BINARY_INTEGER".split()), (), "Integer"),
    (("FLOAT", "FLOAT4", "FLOAT8", "REAL", "DOUBLE", "DOUBLE PRECISION", "BINARY_FLOAT", "BINARY_DOUBLE"), (), "Double"),
    (("DATE",), (), "java.time.LocalDate"),
    (("TIMESTAMP", "TIMESTAMPTZ", "DATETIME", "DATETIME2", "SMALLDATETIME", "DATETIMEOFFSET"), (), "java.time.LocalDateTime"),
    (("TIME", "TIMETZ"), (), "java.time.LocalTime"),
    (("BIT", "BOOLEAN", "BOOL"), (), "Boolean"),
    (tuple("BLOB,BYTEA,BINARY,VARBINARY,RAW,LONG RAW,IMAGE,TINYBLOB,MEDIUMBLOB,LONGBLOB".split(",")), (), "byte[]"),
)
#: Fixed table: Java types to the types of the dialects that DDL is made for; n is the length, p and s precision and scale.
TARGET_TYPES = {
    "String": {"oracle": "VARCHAR2({n})", "tibero": "VARCHAR2({n})", "postgresql": "VARCHAR({n})", "mariadb": "VARCHAR({n})", "mssql": "NVARCHAR({n})"},
    "String.fixed": {"oracle": "CHAR({n})", "tibero": "CHAR({n})", "postgresql": "CHAR({n})", "mariadb": "CHAR({n})", "mssql": "NCHAR({n})"},
    "String.long": {"oracle": "CLOB", "tibero": "CLOB", "postgresql": "TEXT", "mariadb": "LONGTEXT", "mssql": "NVARCHAR(MAX)"},
    "Integer": {"oracle": "NUMBER({p})", "tibero": "NUMBER({p})", "postgresql": "INTEGER", "mariadb": "INT", "mssql": "INT"},
    "Long": {"oracle": "NUMBER(19)", "tibero": "NUMBER(19)", "postgresql": "BIGINT", "mariadb": "BIGINT", "mssql": "BIGINT"},
    "java.math.BigDecimal": {"oracle": "NUMBER({p},{s})", "tibero": "NUMBER({p},{s})", "postgresql": "NUMERIC({p},{s})", "mariadb": "DECIMAL({p},{s})", "mssql": "DECIMAL({p},{s})"},
    "Double": {"oracle": "BINARY_DOUBLE", "tibero": "BINARY_DOUBLE", "postgresql": "DOUBLE PRECISION", "mariadb": "DOUBLE", "mssql": "FLOAT"},
    "java.time.LocalDate": {"oracle": "DATE", "tibero": "DATE", "postgresql": "DATE", "mariadb": "DATE", "mssql": "DATE"},
    "java.time.LocalDateTime": {"oracle": "TIMESTAMP", "tibero": "TIMESTAMP", "postgresql": "TIMESTAMP", "mariadb": "DATETIME", "mssql": "DATETIME2"},
    "java.time.LocalTime": {"oracle": "VARCHAR2(8)", "tibero": "VARCHAR2(8)", "postgresql": "TIME", "mariadb": "TIME", "mssql": "TIME"},
    "Boolean": {"oracle": "NUMBER(1)", "tibero": "NUMBER(1)", "postgresql": "BOOLEAN", "mariadb": "TINYINT(1)", "mssql": "BIT"},
    "byte[]": {"oracle": "BLOB", "tibero": "BLOB", "postgresql": "BYTEA", "mariadb": "LONGBLOB", "mssql": "VARBINARY(MAX)"},
}


def is_identifier(c: Column) -> Column:
    """Whether a trimmed text may stand in SQL as a name; null is none."""
    return F.coalesce(F.trim(c).rlike(IDENTIFIER), F.lit(False))


def quoted(c: Column, dialect: str) -> Column:
    """A name as it may stand in SQL: reserved words are quoted as the dialect does, folded to its case; null for what is no name."""
    name = F.trim(c)
    if dialect in ("mysql", "mariadb"):
        own = F.concat(F.lit("`"), name, F.lit("`"))
    elif dialect in ("mssql", "sybase"):
        own = F.concat(F.lit("["), name, F.lit("]"))
    else:
        own = F.concat(F.lit('"'), (F.upper if dialect in ("oracle", "tibero") else F.lower)(name), F.lit('"'))
    return F.when(is_identifier(c), F.when(F.upper(name).rlike(f"^(?:{'|'.join(sorted(RESERVED))})$"), own).otherwise(name))


def camel(c: Column) -> Column:
    """A column's name as a property's: a sign after an underscore in upper case, what no identifier may hold as an underscore."""
    pieces = F.regexp_extract_all(F.lower(F.trim(c)), F.lit("_[_a-z0-9]|[^_]+|_"), F.lit(0))
    joined = F.array_join(F.transform(pieces, lambda x: F.when(x.rlike("^_[_a-z0-9]$"), F.upper(F.substring(x, 2, 1))).otherwise(x)), "")
    begun = F.when(joined == "", "_").when(joined.rlike(r"^[\p{L}\p{Nl}\p{Sc}\p{Pc}]"), joined).otherwise(F.concat(F.lit("_"), joined))
    return F.regexp_replace(begun, r"[^\p{L}\p{Nl}\p{Nd}\p{Mn}\p{Mc}\p{Sc}\p{Pc}]", "_")


def field_name(c: Column) -> Column:
    """camel, with an underscore after Java's own words."""
    name = camel(c)
    return F.when(name.isin(*sorted(JAVA_WORDS)), F.concat(name, F.lit("_"))).otherwise(name)


def class_name(c: Column, skipped: list[str]) -> Column:
    """A table's name as a class's: leading parts of `skipped` left out, but never the last part."""
    parts = F.split(F.trim(c), "_")
    skip = F.array(*(F.lit(s.strip().upper()) for s in skipped)) if skipped else F.array().cast("array<string>")
    kept = F.array_position(F.transform(parts, lambda p, i: ~F.array_contains(skip, F.upper(p)) | (i == F.size(parts) - 1)), True)
    name = F.regexp_replace(field_name(F.array_join(F.slice(parts, kept.cast("int"), F.size(parts)), "_")), "_+$", "")
    name = F.when(name == "", "T").when(name.startswith("_"), F.concat(F.lit("T"), name)).otherwise(name)
    return F.concat(F.upper(F.substring(name, 1, 1)), F.substring(name, 2, 1 << 20))


def path_normalise(c: Column) -> Column:
    """An absolute path for comparison: forward slashes, lower case, no '.', '..', doubled or closing slashes."""
    parts = F.split(F.lower(F.replace(F.trim(c), F.lit("\\"), F.lit("/"))), "/")
    up = lambda done: F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))
    step = lambda done, p: F.when(p.isin("", "."), done).when(p == "..", up(done)).otherwise(F.concat(done, F.array(p)))
    return F.concat(F.lit("/"), F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/"))


def java_type(native: Column, precision: Column, scale: Column, dialect: str = "") -> Column:
    """The Java type of a native type; a decimal without places is an Integer to 9 digits, a Long to 19. Null if none fits."""
    plain = type_normalise(native)
    decimal = F.when(scale > 0, "java.math.BigDecimal").when(precision <= 9, "Integer").when(precision <= 19, "Long").otherwise("java.math.BigDecimal")
    out = F.lit(None).cast("string")
    for names, dialects, java in reversed(JAVA_TYPES):
        if not dialects or dialect in dialects:
            fits = plain.isin(*names)
            for n in names:
                fits = fits | plain.startswith(n + " ")
            out = F.when(fits, decimal if java == "decimal" else java).otherwise(out)
    return out


def target_type(java: Column, length: Column, precision: Column, scale: Column, dialect: str) -> Column:
    """A dialect's type for a Java type; null for one that has none."""
    text = F.element_at(F.create_map(*(F.lit(x) for kind, of in TARGET_TYPES.items() for x in (kind, of[dialect]))), java)
    for place, value in (("{n}", length), ("{p}", precision), ("{s}", scale)):
        text = F.replace(text, F.lit(place), F.coalesce(value.cast("string"), F.lit("")))
    return text


def filled(comment: Column, logical: Column | None = None, mark: str = "") -> Column:
    """A comment, else the logical name, else the mark."""
    return F.coalesce(F.nullif(F.trim(comment), F.lit("")), *([logical] if logical is not None else []), F.lit(mark))


def display(df: DataFrame) -> DataFrame:
    """df with values that a table can show: days and times as ISO texts without idle seconds, binaries as their size; numbers, texts and booleans as they are."""

    def shown(f: T.StructField) -> Column:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            micros = F.date_format(c, "SSSSSS")
            part = F.when(micros == "000000", "").when(micros.endswith("000"), F.concat(F.lit("."), F.substring(micros, 1, 3))).otherwise(F.concat(F.lit("."), micros))
            seconds = F.when((F.second(c) == 0) & (micros == "000000"), "").otherwise(F.concat(F.date_format(c, ":ss"), part))
            return F.concat(F.date_format(c, "yyyy-MM-dd'T'HH:mm"), seconds)
        if isinstance(f.dataType, T.BinaryType):
            return F.concat(F.lit("(BLOB "), F.octet_length(c).cast("string"), F.lit(" bytes)"))
        if isinstance(f.dataType, (T.NumericType, T.BooleanType, T.StringType)):
            return c
        return c.cast("string")

    return df.select(*(shown(f).alias(f.name) for f in df.schema.fields))


def optional_equal(c: Column, value) -> Column:
    """A condition that a parameter may leave out: true for all rows if value is None."""
    return F.lit(True) if value is None else c == value


#: Fixed table: pieces of SQL by dialect.
LENGTH = {"oracle": "LENGTH({c})", "tibero": "LENGTH({c})", "postgresql": "CHAR_LENGTH({c})", "mariadb": "CHAR_LENGTH({c})", "mssql": "LEN({c})"}
STARS = {"oracle": "RPAD('*', {n}, '*')", "tibero": "RPAD('*', {n}, '*')", "postgresql": "REPEAT('*', {n})", "mariadb": "REPEAT('*', {n})", "mssql": "REPLICATE('*', {n})"}
LEFT = {"oracle": "SUBSTR({c}, 1, {n})", "tibero": "SUBSTR({c}, 1, {n})", "postgresql": "LEFT({c}, {n})", "mariadb": "LEFT({c}, {n})", "mssql": "LEFT({c}, {n})"}
RIGHT = {"oracle": "SUBSTR({c}, -{n})", "tibero": "SUBSTR({c}, -{n})", "postgresql": "RIGHT({c}, {n})", "mariadb": "RIGHT({c}, {n})", "mssql": "RIGHT({c}, {n})"}
PLACE_OF_AT = {"oracle": "INSTR({c}, '@')", "tibero": "INSTR({c}, '@')", "postgresql": "STRPOS({c}, '@')", "mariadb": "LOCATE('@', {c})", "mssql": "CHARINDEX('@', {c})"}
FROM_AT = {"oracle": "SUBSTR({c}, {n})", "tibero": "SUBSTR({c}, {n})", "postgresql": "SUBSTR({c}, {n})", "mariadb": "SUBSTRING({c}, {n})", "mssql": "SUBSTRING({c}, {n}, LEN({c}))"}


def joined_sql(parts: list[str], dialect: str) -> str:
    return f"CONCAT({', '.join(parts)})" if dialect == "mariadb" else (" + " if dialect == "mssql" else " || ").join(parts)


def mask_sql(c: str, head: int, tail: int, dialect: str) -> str:
    """The masking expression of a column (or of an expression) as SQL text."""
    size = LENGTH[dialect].format(c=c)
    whole = STARS[dialect].format(n=size)
    if not head + tail:
        return whole
    parts = [LEFT[dialect].format(c=c, n=head)] if head else []
    parts.append(STARS[dialect].format(n=f"{size} - {head + tail}"))
    if tail:
        parts.append(RIGHT[dialect].format(c=c, n=tail))
    return f"CASE WHEN {size} <= {head + tail} THEN {whole} ELSE {joined_sql(parts, dialect)} END"


def mask_email_sql(c: str, head: int, tail: int, dialect: str) -> str:
    at = PLACE_OF_AT[dialect].format(c=c)
    local = LEFT[dialect].format(c=c, n=f"{at} - 1")
    domain = FROM_AT[dialect].format(c=c, n=at)
    return f"CASE WHEN {at} > 1 THEN {joined_sql([mask_sql(local, head, tail, dialect), domain], dialect)} ELSE {mask_sql(c, head, tail, dialect)} END"
