"""Operator 7, embedding near-duplicates by a subspace pigeonhole join.

Unit vectors with cosine >= c lie within squared distance 2 - 2c. The vectors are rotated to principal axes, fitted
on a bounded sample (SAMPLE vectors in the order of a hash; any rotation keeps distances, so the sample touches only
the speed), and the axes are dealt to BLOCKS blocks in turn, so that each block leads with axes of great variance; in
at least one block a near pair's squared distance is at most its proportional share of the budget. Each block is
range-joined in a grid over its first GRID coordinates: a vector goes to its own cell, and to the next cells that its
range reaches (a pair meets in the cell that holds both, and is taken only there where the cells' least common corner
is, so once). A pair is taken only in its first block within budget, and the union of the candidates is verified
exactly, by cosine in double precision. No link is lost: the budget carries a small slack for rounding.

Equal vectors of a label are one class first, so copies of any number cost one row. A crowded cell (over CHUNK
vectors) is dealt out as pairs of chunks, so that no task holds more than two chunks of it. Tasks emit, for each
vector, its number of links and a spanning forest of its links, not all pairs. Vectors travel in their own type.
How far the cells narrow the search depends on the vectors: with a few strong axes most cells hold few of them, while
for vectors spread alike over all axes a cell holds a fixed share of a label, and the work within a label is quadratic.

Results for odd input: vectors that are null, empty, zero, or hold null or non-finite components, and vectors with
a null label, link with nothing (n_links 0, their own component); vectors of different lengths never link; a null
id takes part in counts, and its own component is null unless it has links to others; ties of cosine with the bound are links; repeated rows are copies that link with each other (unless
invalid); an empty table gives an empty result. Columns beyond those named are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylens.llm.common import scratch, table
from quarrylens.llm.components import components
from quarrylens.llm.simhash import merge

BLOCKS = 4
GRID = 2
CHUNK = 8192
SAMPLE = 10_000
#: Principal axes are fitted for the most frequent vector lengths; other lengths are not rotated.
LENGTHS = 4
SLACK = 1e-9
#: Pairs of vectors whose block distance is taken at once.
TILE = 1 << 18


def principal_axes(sample: np.ndarray) -> np.ndarray:
    """An orthogonal matrix of the sample's principal axes, the strongest dealt to the blocks in turn."""
    _, axes = np.linalg.eigh(sample.T @ sample)
    axes = axes[:, ::-1]  # by falling variance
    n = axes.shape[0]
    sizes = [hi - lo for lo, hi in block_bounds(n)]
    columns = np.empty(n, np.int64)
    for rank, (k, x) in enumerate((k, x) for k in range(max(sizes)) for x in range(len(sizes)) if sizes[x] > k):
        columns[block_bounds(n)[x][0] + k] = rank
    return axes[:, columns]


def unit_of(vectors: np.ndarray) -> np.ndarray:
    unit = vectors.astype(np.float64)
    unit = unit / np.abs(unit).max(axis=1, keepdims=True)
    return unit / np.sqrt((unit**2).sum(axis=1, keepdims=True))


def block_bounds(n: int) -> list[tuple[int, int]]:
    blocks = min(BLOCKS, n)
    return [(n * k // blocks, n * (k + 1) // blocks) for k in range(blocks)]


def cells_of(unit: np.ndarray, turn: np.ndarray, budget: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each block: its number, and per vector and cell the vector's row and the cell's coordinates, own cells first."""
    rotated = unit @ turn
    bounds = block_bounds(unit.shape[1])
    reach = np.sqrt(budget / len(bounds)) * (1 + SLACK) + SLACK
    for b, (lo, hi) in enumerate(bounds):
        part = rotated[:, lo : min(hi, lo + GRID)]
        own = np.floor(part / (2 * reach)).astype(np.int64)
        rows, cells = np.arange(len(unit)), own
        for axis in range(part.shape[1]):  # also the next cell, if the range reaches it
            over = np.flatnonzero(np.floor((part[rows, axis] + reach) / (2 * reach)) > cells[:, axis])
            more = cells[over].copy()
            more[:, axis] += 1
            rows, cells = np.concatenate([rows, rows[over]]), np.concatenate([cells, more])
        yield b, rows, cells


def turn_of(turns: dict[int, np.ndarray], n: int) -> np.ndarray:
    """The rotation for vectors of n components: fitted for the most frequent lengths, none for others."""
    return turns[n] if n in turns else np.eye(n)


def near_pairs(a: np.ndarray, b: np.ndarray, turn: np.ndarray, same: bool, block: int, cell: np.ndarray, budget: float, cosine: float, cells: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of unit vectors a and b that this block and cell have to answer for, verified exactly."""
    bounds = block_bounds(a.shape[1])
    ra, rb = a @ turn, b @ turn
    share = (budget + SLACK) / len(bounds)
    lo, hi = bounds[block]
    out_i, out_j = [], []
    step = max(1, TILE // max(1, len(b)))
    for at in range(0, len(a), step):
        part = ra[at : at + step]
        d = ((part[:, lo:hi] ** 2).sum(1)[:, None] + (rb[:, lo:hi] ** 2).sum(1)[None, :]) - 2 * part[:, lo:hi] @ rb[:, lo:hi].T
        i, j = np.nonzero(d <= share + 1e-7)
        i += at
        if same:
            i, j = i[i < j], j[i < j]
        # a pair meets in each cell that holds both; the one at the greater of their own cells answers for it
        mine = (np.maximum(cells[0][i], cells[1][j]) == cell).all(axis=1)
        i, j = i[mine], j[mine]
        gap = (ra[i] - rb[j]) ** 2
        first = np.ones(len(i), bool)
        for k, (x, y) in enumerate(bounds[: block + 1]):
            within = gap[:, x:y].sum(axis=1) <= share
            first &= within if k == block else ~within
        i, j = i[first], j[first]
        close = np.einsum("ij,ij->i", a[i], b[j]) >= cosine
        out_i.append(i[close])
        out_j.append(j[close])
    return np.concatenate(out_i or [np.zeros(0, np.int64)]), np.concatenate(out_j or [np.zeros(0, np.int64)])


def near_duplicate_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = 0.93) -> DataFrame:
    """id, n_links, component_id, kept of every row."""
    spark = df.sparkSession
    budget = 2 - 2 * cosine
    narrow = df.schema[vector_col].dataType.simpleString() == "array<float>"
    inner, size_of = ("float", np.float32) if narrow else ("double", np.float64)
    vector = F.col(vector_col).cast(f"array<{inner}>")
    sound = (F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))) & F.exists("v", lambda x: x != 0) & F.col("label").isNotNull()
    rows = df.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), vector.alias("v")).withColumn("sound", F.coalesce(sound, F.lit(False)))
    rows = scratch(spark, rows.withColumn("class", F.when(F.col("sound"), F.sha2(F.concat_ws("|", F.col("label").cast("string"), F.to_json("v")), 256))).drop("sound"), "vectors")
    classes = rows.where(F.col("class").isNotNull()).groupBy("class").agg(F.count("*").alias("copies"), F.min("id").alias("least_id"), F.first("label").alias("label"), F.first("v").alias("v"))
    classes = scratch(spark, classes.withColumn("cid", F.xxhash64("class")), "vector-classes")

    lengths = [r[0] for r in classes.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(LENGTHS).collect()]
    turns = {}
    for n in lengths:
        sample = classes.where(F.size("v") == n).orderBy("cid").select("v").limit(SAMPLE).toArrow()["v"]
        turns[n] = principal_axes(unit_of(np.stack(sample.to_numpy())))
    turns = spark.sparkContext.broadcast(turns)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels, cids, copies = batch.column(0).to_pylist(), batch.column(1).to_numpy(), batch.column(2).to_numpy()
            vectors = batch.column(3).to_numpy(zero_copy_only=False)
            sizes = np.fromiter(map(len, vectors), np.int64, len(vectors))
            for n in np.unique(sizes):
                at = np.flatnonzero(sizes == n)
                raw = np.stack(vectors[at])
                for b, of, cells in cells_of(unit_of(raw), turn_of(turns.value, n), budget):
                    keys = ["/".join(map(str, c)) for c in cells.tolist()]
                    own = np.array(keys, object)[: len(at)]
                    which = at[of]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([f"{labels[w]}/{n}/{b}/{k}" for w, k in zip(which.tolist(), keys)]),
                            pa.array(own[of].tolist(), pa.string()),
                            pa.array(cids[which]),
                            pa.array(copies[which]),
                            pa.ListArray.from_arrays(np.arange(len(of) + 1, dtype=np.int32) * n, pa.array(raw[of].ravel().astype(size_of))),
                        ],
                        ["cell", "own", "cid", "copies", "v"],
                    )

    entries = scratch(spark, classes.select("label", "cid", "copies", "v").mapInArrow(spread, f"cell string, own string, cid long, copies long, v array<{inner}>"), "vector-cells")
    sizes = entries.groupBy("cell").count().select("cell", F.ceil(F.col("count") / CHUNK).cast("int").alias("chunks"))
    dealt = entries.join(sizes, "cell").withColumn("chunk", F.pmod(F.xxhash64("cid"), F.col("chunks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    dealt = dealt.select("cell", F.least("chunk", "other").alias("x"), F.greatest("chunk", "other").alias("y"), "chunk", "own", "cid", "copies", "v")

    def link(table_: pa.Table) -> pa.Table:
        if table_.num_rows < 2:
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
        table_ = table_.sort_by("cid")
        own = np.array([s.split("/") for s in table_["own"].to_pylist()], np.int64)
        block, *cell = table_["cell"][0].as_py().split("/")[-(1 + own.shape[1]) :]
        cell = np.array(cell, np.int64)
        x, y = table_["x"][0].as_py(), table_["y"][0].as_py()
        chunk, cid, copies = table_["chunk"].to_numpy(), table_["cid"].to_numpy(), table_["copies"].to_numpy()
        unit = unit_of(np.stack(table_["v"].to_numpy()))
        i, j = np.flatnonzero(chunk == x), np.flatnonzero(chunk == y)
        p, q = near_pairs(unit[i], unit[j], turn_of(turns.value, unit.shape[1]), x == y, int(block), cell, budget, cosine, (own[i], own[j]))
        p, q = i[p], j[q]
        n = np.bincount(p, copies[q], len(cid)) + np.bincount(q, copies[p], len(cid))
        labels = merge(np.arange(len(cid)), p, q)
        some = np.flatnonzero(n > 0)
        return pa.table({"a": cid[some], "b": cid[labels[some]], "n": n[some].astype(np.int64)})

    links = scratch(spark, dealt.groupBy("cell", "x", "y").applyInArrow(link, "a long, b long, n long"), "vector-links")
    roots = components(links.where("a <> b").select("a", "b")).select(F.col("a").alias("cid"), F.col("b").alias("root"))
    rooted = classes.select("class", "cid", "copies", "least_id").join(roots, "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    least = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    counts = links.groupBy(F.col("a").alias("cid")).agg(F.sum("n").alias("n"))
    found = rooted.join(least, "root").join(counts, "cid", "left").select("class", "component_id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    sound_rows = rows.where(F.col("class").isNotNull()).select("id", "class").join(found, "class")
    out = sound_rows.select("id", "n_links", "component_id").union(rows.where(F.col("class").isNull()).select("id", F.lit(0), "id"))
    kept = F.coalesce(F.col("id") == F.col("component_id"), F.lit(False))
    return out.select(F.col("id").alias(id_col), F.col("n_links").cast("long").alias("n_links"), F.col("component_id"), kept.alias("kept"))


def op7_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


ORACLE_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
s AS (SELECT * FROM v WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM s a JOIN s b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
r AS (SELECT vec_id AS x, vec_id AS y FROM v UNION SELECT r.x, p.b FROM r JOIN p ON r.y = p.a),
c AS (SELECT x, min(y) AS component_id FROM r GROUP BY x), n AS (SELECT a, count(*) AS n_links FROM p GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept FROM v JOIN c ON x = vec_id LEFT JOIN n ON a = vec_id
"""
