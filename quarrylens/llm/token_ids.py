"""Operator 6, token-ID output: fixed-width bit packing of token ids, in blocks that unpack and seek by offset.

Format. A dataset is a folder of Parquet files in ascending document order; a row is a block: `shard` (the
writer's partition, in document order), `block` (its place in the shard), `bits` (the width of an id: the least
that holds the vocabulary), `first_id` (ids of the shard before the block), `n_ids`, `doc_ids` and `doc_offsets`
(where each document begins in the block; one more entry gives the end), and `payload`: the ids, least significant
bit first, `bits` bits each, so id i stands at bit i * bits and any range unpacks by itself. A block holds whole
documents, BLOCK_IDS ids or one longer document. Spark's own writer commits the files, so a lost executor's task
is redone without a trace, and any store that Spark writes will do.

Texts are encoded by the tokenizers library; as its BPE never crosses a pre-token, each distinct pre-token goes
through the library's model once while it is in a worker's cache, and texts are put together from those by numpy.

Results for odd input: null text counts as empty (its only id is the end id); null document ids come first;
integer ids of any width are ordered as numbers, other ids as text; repeated ids are all written, next to each other (by a hash of the text between partitions, by the text within one); texts of any length are written whole; an empty table gives an
empty dataset. Columns beyond the id and the text are not read, so their names cannot clash.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrylens.llm.common import shared_dir, table, text_groups
from quarrylens.llm.pretokenizer import compile_classes
from quarrylens.llm.token_counts import byte_letters, pieces_of, read_bpe, sums_of

BLOCK_IDS = 1 << 16
#: Distinct pre-tokens of a generation of a worker's cache.
CACHE = 1 << 18
#: Bytes of text taken up at once, and ids packed or unpacked at once.
GROUP = 1 << 20
PACKED = 1 << 20


def width(vocabulary: int) -> int:
    """The least bits that hold every id below `vocabulary`."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    ids = np.ascontiguousarray(ids, dtype="<u4")
    if ids.size and int(ids.max()) >> bits:
        raise ValueError(f"an id does not fit in {bits} bits")
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    parts = (ids[at : at + PACKED] for at in range(0, len(ids), PACKED))  # PACKED ids end at a whole byte
    return b"".join(np.packbits(np.unpackbits(x.view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :bits], bitorder="little").tobytes() for x in parts)


def unpack(payload: bytes, bits: int, start: int = 0, n: int | None = None) -> np.ndarray:
    """Ids start .. start + n of a payload, without touching the others."""
    n = len(payload) * 8 // bits - start if n is None else n
    if bits in (8, 16, 32):
        return np.frombuffer(payload, f"<u{bits // 8}", n, start * bits // 8).astype(np.uint32)
    out = np.empty(n, np.uint32)
    for done in range(0, n, PACKED):
        some = min(PACKED, n - done)
        at = np.arange(start + done, start + done + some, dtype=np.int64) * bits
        first = int(at[0] >> 3)
        raw = np.frombuffer(payload[first : (start + done + some) * bits // 8 + 1] + bytes(8), np.uint8)
        words = np.lib.stride_tricks.sliding_window_view(raw, 8)[(at >> 3) - first]
        values = np.ascontiguousarray(words).view("<u8").ravel() >> (at & 7).astype(np.uint64)
        out[done : done + some] = values & np.uint64((1 << bits) - 1)
    return out


class PieceEncoder:
    """Encodes texts with the tokenizers library: its model reads each distinct pre-token once while it is in the cache.

    The cache has two generations: when the younger is full it becomes the elder, and what is asked for again moves
    to the new one, so frequent pre-tokens stay and memory is bounded."""

    def __init__(self, tokenizer_json: str, classes: np.ndarray, special: list[str]):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a worker has one core; threads would only hold memory
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(tokenizer_json)
        self.letters = {b: c for c, b in byte_letters().items()}
        self.classes, self.special = classes, special
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.fixed = {s: np.array([self.library.token_to_id(s)], "<u4").tobytes() for s in special}

    def ids_of(self, pieces: list[str]) -> list[bytes]:
        """Each piece's ids as little-endian 32-bit integers."""
        if len(self.young) > CACHE:
            self.young, self.old = {}, self.young
        young, old = self.young, self.old
        young.update(self.fixed)
        new = []
        for p in pieces:
            if p not in young:
                known = old.get(p)
                if known is None:
                    new.append(p)
                else:
                    young[p] = known
        if new:
            tokenize, spelt = self.library.model.tokenize, "".join(new).encode().decode("latin-1").translate(self.letters)
            ids, ends, at = [], [], 0
            for n in map(len, [p.encode() for p in new]):
                ids += [t.id for t in tokenize(spelt[at : at + n])]
                ends.append(len(ids))
                at += n
            raw, begin = np.array(ids, "<u4").tobytes(), 0
            for p, end in zip(new, ends):
                young[p] = raw[4 * begin : 4 * end]
                begin = end
        return [young[p] for p in pieces]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of all texts in order, and how many each text has."""
        distinct, index, per_text = pieces_of(texts, self.classes, self.special)
        if not len(index):
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        found = self.ids_of(distinct)
        pool = np.frombuffer(b"".join(found), "<u4")
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        starts, lengths = (np.cumsum(sizes) - sizes)[index], sizes[index]
        before = np.cumsum(lengths) - lengths
        return pool[np.repeat(starts - before, lengths) + np.arange(int(lengths.sum()))], sums_of(lengths, per_text)


def write_token_ids(df: DataFrame, path: str, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every text, append end_id, and write the packed dataset to path in ascending id order."""
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path)
    bits = width(max(library.get_vocab_size(with_added_tokens=True), end_id + 1))
    compiled = df.sparkSession.sparkContext.broadcast((library.to_str(), compile_classes(library), read_bpe(tokenizer_path)[2]))
    whole = df.schema[id_col].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")
    inner, key = ("bigint", F.col(id_col).cast("long")) if whole else ("string", F.col(id_col).cast("string"))
    schema = pa.schema([("shard", pa.int32()), ("block", pa.int64()), ("bits", pa.int32()), ("first_id", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64() if whole else pa.string())), ("doc_offsets", pa.list_(pa.int64())), ("payload", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, block, first, encoder = TaskContext.get().partitionId(), 0, 0, None
        docs, offsets, held = [], [0], []
        end = np.array([end_id], np.uint32)

        def flush() -> pa.RecordBatch:
            nonlocal block, first, docs, offsets, held
            row = {"shard": shard, "block": block, "bits": bits, "first_id": first, "n_ids": offsets[-1], "doc_ids": docs, "doc_offsets": offsets, "payload": pack(np.concatenate(held), bits)}
            block, first, docs, offsets, held = block + 1, first + offsets[-1], [], [0], []
            return pa.RecordBatch.from_pylist([row], schema=schema)

        for batch in batches:
            encoder = encoder or PieceEncoder(*compiled.value)
            names = batch.column(0).to_pylist()
            for begin, texts in text_groups(batch.column(1), GROUP):
                ids, per_text = encoder.encode(texts)
                at = 0
                for name, n in zip(names[begin : begin + len(texts)], per_text.tolist()):
                    if docs and offsets[-1] + n + 1 > BLOCK_IDS:
                        yield flush()
                    docs.append(name)
                    offsets.append(offsets[-1] + n + 1)
                    held += [ids[at : at + n], end]
                    at += n
        if docs:
            yield flush()

    ordered = (
        df.select(key.alias("id"), F.col(text_col).alias("text"))
        .repartitionByRange("id", F.xxhash64("text"))
        .sortWithinPartitions("id", "text")
    )
    ordered.mapInArrow(run, f"shard int, block long, bits int, first_id long, n_ids long, doc_ids array<{inner}>, doc_offsets array<long>, payload binary").write.parquet(path)


def read_token_ids(spark, path: str) -> DataFrame:
    """The dataset's blocks with `start`, the ids of all blocks before each: cumulative over the shards, of which there are as many as write tasks."""
    blocks = spark.read.parquet(path)
    totals = blocks.groupBy("shard").agg(F.sum("n_ids").alias("ids"))
    starts = totals.select("shard", (F.sum("ids").over(Window.orderBy("shard")) - F.col("ids")).alias("shard_start"))
    return blocks.join(F.broadcast(starts), "shard").withColumn("start", F.col("shard_start") + F.col("first_id"))


def documents_of(blocks: DataFrame, id_col: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """One row per stored document: id, start, n_tokens, ids_crc32 and, if asked for, the ids themselves."""
    inner = blocks.schema["doc_ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                ids = unpack(row["payload"], row["bits"], 0, row["n_ids"]).astype("<u4")
                cuts = row["doc_offsets"]
                own = [ids[a:b] for a, b in zip(cuts, cuts[1:])]
                columns = [
                    pa.array(row["doc_ids"], pa.int64() if inner == "bigint" else pa.string()),
                    pa.array(np.array(cuts[:-1], np.int64) + row["start"]),
                    pa.array(np.diff(cuts).astype(np.int64)),
                    pa.array([zlib.crc32(x.tobytes()) for x in own], pa.int64()),
                ]
                names = ["id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(ids.astype(np.int64))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    read = blocks.select("bits", "n_ids", "doc_ids", "doc_offsets", "payload", "start")
    out = read.mapInArrow(run, f"id {inner}, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else ""))
    return out.withColumnRenamed("id", id_col)


def op6_token_ids(spark, sf_dir: str, tokenizer_path: str | None = None, end_id: int = 2) -> DataFrame:
    import uuid

    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path("byte_bpe_50k.json")
    path = f"{shared_dir(spark)}/token-ids-{uuid.uuid4().hex}"
    write_token_ids(table(spark, sf_dir, "documents"), path, tokenizer_path, end_id)
    return documents_of(read_token_ids(spark, path))
