"""Mapper XML as statements: namespace.id, tag, text with its included fragments, and what tables each touches how.

A file is one row of text and is parsed once, in Arrow batches; its statements are a written table. Fragments may lie in other
files, so includes are resolved by joins on the fragment's full name: each round puts in one depth of nesting, and only
statements that still hold an include go on to the next. Includes of no fragment, and those nested deeper than MOST_DEPTH or
in themselves, stay out of the text and are noted.
"""

from __future__ import annotations

import xml.sax
from collections.abc import Iterator
from io import StringIO

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylens.operators.sqltext import table_refs
from quarrylens.session import scratch

STATEMENTS = frozenset(("select", "insert", "update", "delete", "sql"))
#: Tags that make a statement's text depend on its parameters.
DYNAMIC = frozenset(("if", "choose", "when", "otherwise", "foreach", "where", "set", "trim", "bind"))
MOST_DEPTH = 5
OPEN, CLOSE = "\u0002", "\u0003"


class _Handler(xml.sax.ContentHandler):
    def __init__(self):
        super().__init__()
        self.rows, self.namespace, self.now = [], "", None

    def startElement(self, name, attributes):  # noqa: N802
        if name == "mapper":
            self.namespace = attributes.get("namespace", "")
        elif name in STATEMENTS and self.now is None and "id" in attributes:
            self.now = {"namespace": self.namespace, "id": attributes["id"], "tag": name, "dynamic": False, "line": self._locator.getLineNumber(), "parts": []}
        elif self.now is not None:
            self.now["dynamic"] |= name in DYNAMIC
            if name == "include":
                ref = attributes.get("refid", "")
                self.now["parts"].append(f" {OPEN}{ref}{CLOSE} ")
            elif name in ("where", "set"):
                self.now["parts"].append(f" {name.upper()} ")
            elif name == "selectKey":
                self.now["parts"].append(" ")

    def endElement(self, name):  # noqa: N802
        if self.now is not None and name == self.now["tag"]:
            self.rows.append(self.now | {"text": "".join(self.now.pop("parts"))})
            self.now = None

    def characters(self, content):
        if self.now is not None:
            self.now["parts"].append(content)


def read_mapper(text: str | None) -> tuple[list[dict], bool]:
    """The statements of a mapper file, and whether it could be parsed; a text without <mapper holds none."""
    if "<mapper" not in (text or ""):
        return [], True
    handler, parser = _Handler(), xml.sax.make_parser()
    parser.setFeature(xml.sax.handler.feature_external_ges, False)
    parser.setContentHandler(handler)
    parser.setEntityResolver(type("Nothing", (xml.sax.handler.EntityResolver,), {"resolveEntity": lambda self, public, system: StringIO("")})())
    try:
        parser.parse(StringIO(text))
    except xml.sax.SAXException:
        return [], False
    return handler.rows, True


def raw_statements(corpus: DataFrame) -> DataFrame:
    """path, ns_id, tag, dynamic, line, text, namespace of every statement and fragment; a file that cannot be parsed gives one row of tag `parse`."""
    schema = "path string, ns_id string, tag string, dynamic boolean, line int, text string, namespace string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found, sound = read_mapper(text)
                rows += [(path, f"{r['namespace']}.{r['id']}", r["tag"], r["dynamic"], r["line"], r["text"], r["namespace"]) for r in found] + ([] if sound else [(path, "", "parse", False, 1, "", "")])
            columns = list(zip(*rows)) or [()] * 7
            kinds = (pa.string(), pa.string(), pa.string(), pa.bool_(), pa.int32(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["path", "ns_id", "tag", "dynamic", "line", "text", "namespace"])

    return corpus.select("path", "text").mapInArrow(run, schema)


def resolved(corpus: DataFrame) -> tuple[DataFrame, DataFrame]:
    """path, ns_id, tag, dynamic, line, sql of every statement with its includes put in; and notes (path, ns_id, line, kind, ref) of
    includes that were not: `missing` fragments, and those beyond MOST_DEPTH (`depth`).

    A name without a dot belongs to the statement's namespace; a fragment of the statement's own file comes first, else of
    those of one name the first by path."""
    spark = corpus.sparkSession
    raw = scratch(spark, raw_statements(corpus), "mapper-raw")
    parts = raw.where("tag = 'sql'").groupBy("path", F.col("ns_id").alias("ref")).agg(F.min_by(F.struct("text", "dynamic"), "line").alias("f"))
    near = parts.select("path", "ref", F.col("f").alias("own"))
    far = parts.groupBy("ref").agg(F.min_by("f", "path").alias("other"))
    mark = f"{OPEN}([^{CLOSE}]*){CLOSE}"
    going = raw.where("tag not in ('sql', 'parse')").withColumn("key", F.xxhash64("path", "ns_id", "line", "text"))
    columns = ["path", "ns_id", "tag", "dynamic", "line", "text"]
    done, notes = going.where(~F.col("text").contains(OPEN)).select(*columns), None
    going = going.where(F.col("text").contains(OPEN))
    for depth in range(MOST_DEPTH + 2):
        named = F.when(F.col("name").contains("."), F.col("name")).otherwise(F.concat_ws(".", "namespace", "name"))
        refs = going.select("key", "path", "ns_id", "line", "namespace", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(mark), F.lit(1)))).alias("name")).withColumn("ref", named)
        found = refs.join(near, ["path", "ref"], "left").join(far, "ref", "left").withColumn("f", F.coalesce("own", "other"))
        last = depth > MOST_DEPTH
        missed = found if last else found.where("f is null")
        note = missed.select("path", "ns_id", "line", F.when(F.col("f").isNull(), "missing").otherwise("depth").alias("kind"), "ref").distinct()
        notes = note if notes is None else notes.union(note)
        text = F.lit("") if last else F.coalesce("f.text", F.lit(""))
        texts = found.groupBy("key", "path", "ns_id", "line").agg(F.map_from_entries(F.collect_list(F.struct("name", text))).alias("texts"), F.max("f.dynamic").alias("d"))
        pieces = F.split("text", f"[{OPEN}{CLOSE}]")  # texts and names in turn
        filled = F.array_join(F.transform(pieces, lambda p, i: F.when(i % 2 == 1, F.element_at("texts", p)).otherwise(p)), "")
        joined = going.join(texts, ["key", "path", "ns_id", "line"])
        dynamic = F.col("dynamic") if last else F.col("dynamic") | F.coalesce("d", F.lit(False))
        put = scratch(spark, joined.select("path", "ns_id", "tag", dynamic.alias("dynamic"), "line", filled.alias("text"), "namespace", "key"), f"mapper-{depth}")
        done = done.union(put.where(~F.col("text").contains(OPEN)).select(*columns))
        going = put.where(F.col("text").contains(OPEN))
        if going.isEmpty():
            break
    sql = F.trim(F.regexp_replace("text", r"\s+", " "))
    return done.withColumn("sql", sql).drop("text"), notes.distinct()


def statements(corpus: DataFrame) -> DataFrame:
    """The statements of resolved, without the notes."""
    return resolved(corpus)[0]


def statement_tables(corpus: DataFrame) -> DataFrame:
    """ns_id, table_name, crud: the letters of each statement's tables, those of all files that define it joined."""
    found = table_refs(statements(corpus), "sql", "ns_id")
    letters = F.concat(*(F.max(F.when(F.col("crud").contains(x), x).otherwise("")) for x in "CRUD"))
    return found.groupBy("ns_id", "table_name").agg(letters.alias("crud"))


def without_where(corpus: DataFrame) -> DataFrame:
    """path, line, rule of UPDATE and DELETE statements that no WHERE limits."""
    rows = statements(corpus).where(F.col("tag").isin("update", "delete") & F.col("sql").rlike(r"(?i)^(update|delete)\b") & ~F.col("sql").rlike(r"(?i)\bwhere\b"))
    return rows.select("path", "line", F.lit("mybatis.noWhere").alias("rule"))


def repeated_ids(corpus: DataFrame) -> DataFrame:
    """path, line, rule of statements whose id an earlier statement of their file has."""
    rows = raw_statements(corpus).where("tag <> 'parse'")
    first = rows.groupBy("path", "ns_id").agg(F.min("line").alias("first"), F.count("*").alias("n")).where("n > 1")
    return rows.join(first, ["path", "ns_id"]).where("line > first").select("path", "line", F.lit("mybatis.dupId").alias("rule"))
