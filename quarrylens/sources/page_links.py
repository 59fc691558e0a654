"""Links in page texts, as table functions over rows."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylens.operators.comments import blanked

#: Fixed cues before a link, and the kinds they mean; the last one counts.
CUES = (
    ("other", r"c:url\s+var"), ("popup", r"window\.open\s*\(|\.open\("), ("form", r"\baction\s*="), ("script", r"location\.(?:href|replace)|location\s*="), ("link", r"\bhref\s*="),
    ("include", r"(?i:c:import|jsp:include|<iframe\b)"), ("ajax", r"url\s*:|\$\.(?:get|post|ajax)\(|\.load\(|\bajax\b"),
)
CUE = re.compile("|".join(f"(?P<{kind}>{cue})" for kind, cue in CUES))
#: Fixed: the address of the application itself, which is cut off an address.
CONTEXT_PATH = "${pageContext.request.contextPath}"
ACTION = re.compile(r"(?<![\w$./-])(?:\$\{[^}]*\}|[\w$./-])+?\.do(?![\w.])", re.A)


def hrefs(pages: DataFrame, key: str, html: str) -> DataFrame:
    """key, target, n: link targets of each page with their number."""
    return pages.select(key, F.explode(F.regexp_extract_all(html, F.lit(r'href="([^"]*)"'), F.lit(1))).alias("target")).groupBy(key, "target").agg(F.count("*").alias("n"))


def link_kind(text: str, start: int) -> str:
    """The kind of the last cue in the 200 characters before a link."""
    kind = "other"
    for m in CUE.finditer(text, max(0, start - 200), start):
        kind = m.lastgroup
    return kind


def view_links(pages: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Links (key, url, kind) to `.do` addresses of JSP texts, each once, and addresses that are not known (key, line, shape).

    Comments do not count. An address begins with `/` or an expression; the application's own path before it is cut off. One
    that still holds an expression, or does not begin with `/` then, is not known: its shape has `${}` for each expression."""
    kind_of = pages.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, raw in enumerate(batch.column(1)):
                body = blanked(raw.as_py(), "jsp") or ""
                for m in ACTION.finditer(body):
                    if not m[0].startswith(("/", "${")):
                        continue
                    url = m[0].removeprefix(CONTEXT_PATH)
                    if url.startswith("/") and "${" not in url:
                        rows.append((i, url, link_kind(body, m.start()), None))
                    else:
                        rows.append((i, re.sub(r"\$\{[^}]*\}", "${}", m[0])[:300], None, body.count("\n", 0, m.start()) + 1))
            columns = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(columns[0], pa.int64())), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.string()), pa.array(columns[3], pa.int32())], ["key", "url", "kind", "line"])

    found = pages.select(F.col(key).alias("key"), F.col(text)).mapInArrow(run, f"key {kind_of}, url string, kind string, line int").withColumnRenamed("key", key)
    return found.where("line is null").select(key, "url", "kind").distinct(), found.where("line is not null").select(key, "line", F.col("url").alias("shape")).distinct()


def action_links(pages: DataFrame, key: str, text: str) -> DataFrame:
    """key, url, kind of every `.do` address in a page's text."""
    kind_of = pages.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(i, m[1], link_kind(t or "", m.start(1))) for i, t in enumerate(batch.column(1).to_pylist()) for m in re.finditer(r"""["']((?:/|\$\{)[^"'?\s]*\.do)\b""", t or "")]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([f[0] for f in found], pa.int64())), pa.array([f[1] for f in found], pa.string()), pa.array([f[2] for f in found], pa.string())], ["key", "url", "kind"])

    return pages.select(F.col(key).alias("key"), F.col(text)).mapInArrow(run, f"key {kind_of}, url string, kind string").withColumnRenamed("key", key)
