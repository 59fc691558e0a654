"""What the operators of this subpackage share: tables, the shared scratch folder, grouping of texts."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylens.session import scratch, shared_dir, table

__all__ = ["crc32_mod", "fresh", "scratch", "shared_dir", "table", "text_groups"]

def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken or name.lower() + "_" in taken:
        name += "_"
    return name


def crc32_mod(column: str, n: int):
    """crc32 of a column's text form, modulo n; null stays null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def text_groups(texts, most: int = 1 << 20) -> Iterator[tuple[int, list[str]]]:
    """Runs of consecutive texts of an Arrow column of about `most` bytes, as (first row, texts); a longer text is a run alone; null becomes empty."""
    lengths = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    begin, size = 0, 0
    for i, n in enumerate(lengths.tolist()):
        if i > begin and size + n > most:
            yield begin, [t or "" for t in texts.slice(begin, i - begin).to_pylist()]
            begin, size = i, 0
        size += n
    if begin < len(lengths):
        yield begin, [t or "" for t in texts.slice(begin).to_pylist()]
