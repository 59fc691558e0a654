"""Comments blanked out of source texts, line ends and places kept. Quotes have to be followed, so a scanner reads
each text in Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TEXT = r"""(?P<text>"(?:\\.|[^"\\\n])*"?|'(?:\\.|[^'\\\n])*'?)"""
#: By language: what is a comment, and what is quoted text that a comment cannot begin in.
LANGUAGES = {
    "java": re.compile(TEXT + r"|(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))", re.S),
    "sql": re.compile(r"""(?P<text>'(?:[^']|'')*'?|"[^"]*"?)|(?P<comment>--[^\n]*|/\*.*?(?:\*/|\Z))""", re.S),
    "xml": re.compile(r"(?P<text><!\[CDATA\[.*?(?:\]\]>|\Z))|(?P<comment><!--.*?(?:-->|\Z))", re.S),
    "jsp": re.compile(r"(?P<text>(?!))|(?P<comment><%--.*?(?:--%>|\Z)|<!--.*?(?:-->|\Z))", re.S),
    "properties": re.compile(r"(?P<text>(?!))|(?P<comment>^[ \t]*[#!][^\n]*)", re.M),
    "yaml": re.compile(r"""(?P<text>"(?:\\.|[^"\\\n])*"?|'[^'\n]*'?)|(?P<comment>(?:^|(?<=\s))#[^\n]*)""", re.M),
}
LANGUAGES |= {"js": LANGUAGES["java"], "ts": LANGUAGES["java"], "html": LANGUAGES["xml"]}


def blanked(text: str | None, lang: str | None) -> str | None:
    """The text with every comment's signs as spaces; texts of other languages as they are."""
    pattern = LANGUAGES.get((lang or "").lower())
    if text is None or pattern is None:
        return text
    return pattern.sub(lambda m: m[0] if m["text"] is not None else re.sub(r"[^\n]", " ", m[0]), text)


def without_comments(corpus: DataFrame, lang: str = "lang") -> DataFrame:
    """path and text of corpus rows (path, text, lang) without their comments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [blanked(t.as_py(), g.as_py()) for t, g in zip(batch.column(1), batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["path", "text"])

    return corpus.select("path", "text", F.col(lang)).mapInArrow(run, "path string, text string")
