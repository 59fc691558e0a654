"""Operator 3, SentencePiece encoding and decoding by weighted finite-state transducers.

Three transducers are compiled from a model file: the normaliser (space to U+2581, with the dummy prefix), the
pieces (a trie; an arc for each piece), and the byte fallback (a sign outside the pieces' alphabet goes to its
UTF-8 bytes' pieces, or to the unknown piece). They are composed lazily with an input, and the shortest path in the
tropical semiring is taken. For a unigram model a piece's weight is minus its log-probability. For a BPE model a
fourth machine is composed, an acceptor over pairs of neighbouring pieces, which lets two pieces stand side by
side exactly if BPE of their joined text gives back the two; one path is then left at each position, so all weights
may be one, and the path is the library's encoding.

Signs that occur in no piece of several signs, the borders before a run of U+2581 after another sign, and those of
neighbours that no piece holds side by side are never crossed by a piece; the input is cut there, and each distinct cut
is solved once while it is in a worker's cache of two generations (what is asked for again moves to the younger).

Decoding composes the inverse: pieces to text, byte pieces to UTF-8 (malformed bytes become U+FFFD), U+2581 to
space, without the dummy prefix.

Results for odd input: null text counts as empty, and empty text has no pieces; texts of any length are encoded
whole; U+2581 in a text decodes as a space, as in the library; repeated rows and null ids each give their row; an
empty table gives an empty result. Columns beyond those named are not read, or are kept as they are in the pipeline.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrylens.llm.common import table, text_groups
from quarrylens.llm.pretokenizer import SENTINEL
from quarrylens.llm.token_counts import sums_of

SPACE = "▁"
#: Distinct cuts of a generation of a worker's cache, and pairs of pieces that it keeps before it starts anew.
CACHE = 1 << 18
PAIRS = 1 << 20
NEVER = float("-inf")


class Model:
    """What a model file says: pieces, scores and kinds."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        spec = proto.normalizer_spec
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces or proto.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only models with the identity normaliser can be compiled")
        kinds = proto.SentencePiece
        self.bpe = proto.trainer_spec.model_type == proto.trainer_spec.BPE
        self.prefix = spec.add_dummy_prefix
        self.pieces = {p.piece: i for i, p in enumerate(proto.pieces) if p.type in (kinds.NORMAL, kinds.USER_DEFINED)}
        self.scores = [p.score for p in proto.pieces]
        self.texts = [p.piece if p.type in (kinds.NORMAL, kinds.USER_DEFINED) else "" for p in proto.pieces]
        self.byte_ids = [-1] * 256
        for i, p in enumerate(proto.pieces):
            if p.type == kinds.BYTE:
                self.byte_ids[int(p.piece[3:5], 16)] = i
        self.byte_of = {i: b for b, i in enumerate(self.byte_ids) if i >= 0}
        self.unknown = proto.trainer_spec.unk_id
        self.unknown_surface = proto.trainer_spec.unk_surface
        if any(p.type == kinds.USER_DEFINED for p in proto.pieces):
            raise ValueError("user-defined pieces are not compiled")


class Transducer:
    """The composed machine: encode() and decode() of whole texts."""

    def __init__(self, model: Model):
        self.m = model
        self.arcs = {p[:n]: -1 for p in model.pieces for n in range(1, len(p))} | model.pieces  # the trie, by prefix
        inside = [p for p in model.pieces if len(p) > 1]
        self.alone = np.ones(SENTINEL + 1, bool)  # signs that no piece of several signs holds
        self.alone[[ord(c) for p in inside for c in p]] = False
        self.apart = np.ones((128, 128), bool)  # neighbours that stand side by side in no piece
        for p in inside:
            for x, y in zip(p, p[1:]):
                if x < "\x80" and y < "\x80":
                    self.apart[ord(x), ord(y)] = False
        self.spaces_join = any(re.search(f"[^{SPACE}]{SPACE}", p) for p in model.pieces)
        self.young: dict[str, tuple[bytes, str]] = {}
        self.old: dict[str, tuple[bytes, str]] = {}
        self.pairs: dict[int, bool] = {}
        self.histories: dict[int, tuple[list[tuple[float, str, str]], bool]] = {}

    def fallback(self, sign: str) -> list[int]:
        """The byte-fallback transducer's output for a sign."""
        out = [self.m.byte_ids[b] for b in sign.encode()]
        return [self.m.unknown] if min(out) < 0 else out

    def merge(self, text: str) -> list[str]:
        """BPE by definition: join the neighbours whose piece scores highest, the leftmost of equals."""
        parts, pieces, scores = list(text), self.m.pieces, self.m.scores
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                k = pieces.get(parts[i] + parts[i + 1])
                if k is not None and (best is None or scores[k] > best):
                    best, at = scores[k], i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def history(self, k: int) -> tuple[list[tuple[float, str, str]], bool]:
        """A piece's own BPE: for each merge its score and the parts at both edges before it; and whether it ends as the piece."""
        found = self.histories.get(k)
        if found is None:
            text, steps = self.m.texts[k], []
            parts, pieces, scores = list(text), self.m.pieces, self.m.scores
            while len(parts) > 1:
                joins = [(scores[j], -i) for i in range(len(parts) - 1) if (j := pieces.get(parts[i] + parts[i + 1])) is not None]
                if not joins:
                    break
                best, at = max(joins)
                steps.append((best, parts[0], parts[-1]))
                parts[-at : 2 - at] = [parts[-at] + parts[1 - at]]
            steps.append((NEVER, parts[0], parts[-1]))
            found = self.histories[k] = (steps, len(parts) == 1)
        return found

    def side_by_side(self, a: int, b: int) -> bool:
        """The acceptor over neighbouring pieces: no merge across their border comes before those inside. a = -1 is the start."""
        key = (a + 1) << 32 | b
        ok = self.pairs.get(key)
        if ok is None:
            if len(self.pairs) > PAIRS:
                self.pairs.clear()
            right, ok = self.history(b)
            if ok and a >= 0:
                left, pieces, scores = self.history(a)[0], self.m.pieces, self.m.scores
                i = j = 0
                while True:
                    (next_a, _, x), (next_b, y, _) = left[i], right[j]
                    across = pieces.get(x + y)
                    if across is not None and scores[across] > next_a and scores[across] >= next_b:
                        ok = False
                        break
                    if next_a == NEVER and next_b == NEVER:
                        break
                    if next_a >= next_b:
                        i += 1
                    else:
                        j += 1
            self.pairs[key] = ok
        return ok

    def shortest_path(self, text: str) -> list[int]:
        """Piece ids of the shortest path through pieces composed with a cut, starts taken from left to right."""
        n = len(text)
        last, begin = [-2] * (n + 1), [0] * (n + 1)  # -2: not reached, -1: the start
        last[0] = -1
        (self.only_paths if self.m.bpe else self.least_paths)(text, last, begin)
        if last[n] == -2:
            return self.with_unknown(text)
        out = []
        while n:
            out.append(last[n])
            n = begin[n]
        return out[::-1]

    def only_paths(self, text: str, last: list[int], begin: list[int]) -> None:
        """With the acceptor of neighbours one path at most reaches a place, so the first is the shortest."""
        arc, pair, n = self.arcs.get, self.pairs.get, len(text)
        for start in range(n):
            before = last[start]
            if before == -2:
                continue
            high = (before + 1) << 32
            for end in range(start + 1, n + 1):
                k = arc(text[start:end])
                if k is None:  # no piece begins like this
                    break
                if k >= 0 and last[end] == -2:
                    ok = pair(high | k)
                    if self.side_by_side(before, k) if ok is None else ok:
                        last[end], begin[end] = k, start

    def least_paths(self, text: str, last: list[int], begin: list[int]) -> None:
        """Relaxation over the tropical semiring: a piece weighs minus its log-probability."""
        arc, scores, n = self.arcs.get, self.m.scores, len(text)
        weight = [0.0] + [float("inf")] * n
        for start in range(n):
            if last[start] == -2:
                continue
            for end in range(start + 1, n + 1):
                k = arc(text[start:end])
                if k is None:
                    break
                if k >= 0 and weight[start] - scores[k] < weight[end]:
                    weight[end], last[end], begin[end] = weight[start] - scores[k], k, start

    def with_unknown(self, text: str) -> list[int]:
        """A cut with a sign that is no piece by itself: BPE by definition, then fallback for what is no piece."""
        parts = self.merge(text) if self.m.bpe else list(text)
        return [i for p in parts for i in ([self.m.pieces[p]] if p in self.m.pieces else [b for c in p for b in self.fallback(c)])]

    def solve(self, cuts: list[str]) -> list[tuple[bytes, str]]:
        """Each cut's piece ids as little-endian 32-bit integers, and the text that they decode to (with its spaces as U+2581)."""
        if len(self.young) > CACHE:
            self.young, self.old = {}, self.young
        young, old = self.young, self.old
        out = []
        for cut in cuts:
            found = young.get(cut)
            if found is None:
                found = old.get(cut)
                if found is None:
                    ids = self.shortest_path(cut) if len(cut) > 1 or cut in self.m.pieces else self.fallback(cut)
                    found = (array("i", ids).tobytes(), self.surface(ids))
                young[cut] = found
            out.append(found)
        return out

    def cut(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The distinct cuts of the normalised texts, all cuts in order as places among them, and how many each text has."""
        normal = [((SPACE if self.m.prefix else "") + t.replace(" ", SPACE)) if t else "" for t in texts]
        joined = "\n".join(normal)
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32).astype(np.int64)
        if not len(points):
            return [], np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
        ends = np.cumsum(np.fromiter(map(len, normal), np.int64, len(normal)) + 1) - 1  # where the joiner after each text stands
        after = np.ones(len(points), np.uint8)
        for least in (0x80, 0x800, 0x10000):
            after += points >= least
        after = np.cumsum(after, dtype=np.int64)
        points[ends[:-1]] = SENTINEL
        single = self.alone[points]
        starts = single.copy()
        starts[0] = True
        starts[1:] |= single[:-1]
        if not self.spaces_join:
            space = points == ord(SPACE)
            starts[1:] |= space[1:] & ~space[:-1]
        plain = np.flatnonzero((points[1:] < 128) & (points[:-1] < 128)) + 1
        starts[plain] |= self.apart[points[plain - 1], points[plain]]
        cuts = np.flatnonzero(starts)
        places = np.append(np.where(cuts > 0, after[cuts - 1], 0), after[-1])
        coded = pa.LargeStringArray.from_buffers(len(cuts), pa.py_buffer(places), pa.py_buffer(joined.encode())).dictionary_encode()
        keep = points[cuts] != SENTINEL
        return coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()[keep].astype(np.int64), np.diff(np.searchsorted(cuts[keep], ends), prepend=0)

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """All ids in order, how many each text has, and what each text's ids decode to."""
        distinct, index, per_text = self.cut(texts)
        solved = self.solve(distinct)
        sizes = np.fromiter((len(x[0]) for x in solved), np.int64, len(solved)) // 4
        pool = np.frombuffer(b"".join([x[0] for x in solved]), "<i4")
        starts, lengths = (np.cumsum(sizes) - sizes)[index], sizes[index]
        before = np.cumsum(lengths) - lengths
        ids = pool[np.repeat(starts - before, lengths) + np.arange(int(lengths.sum()))] if len(index) else np.zeros(0, np.int32)
        surfaces = [x[1] for x in solved]
        decoded, at, places = [], 0, index.tolist()
        for n in per_text.tolist():
            text = "".join([surfaces[i] for i in places[at : at + n]]).replace(SPACE, " ")
            decoded.append(text[1:] if self.m.prefix and text.startswith(" ") else text)
            at += n
        return ids, sums_of(lengths, per_text), decoded

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0].tolist()

    def surface(self, ids) -> str:
        """The inverse transducer on pieces that begin and end at whole signs: pieces as they are, byte pieces joined to signs."""
        out: list[str] = []
        pending = bytearray()
        for i in ids:
            b = self.m.byte_of.get(i)
            if b is not None:
                pending.append(b)
                continue
            if pending:
                out.append(pending.decode("utf-8", "replace"))
                pending.clear()
            out.append(self.m.unknown_surface if i == self.m.unknown else self.m.texts[i])
        if pending:
            out.append(pending.decode("utf-8", "replace"))
        return "".join(out)

    def decode(self, ids) -> str:
        text = self.surface(ids).replace(SPACE, " ")
        return text[1:] if self.m.prefix and text.startswith(" ") else text


def sentencepiece_encode(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ids (array<int>) and decoded (the text that the ids decode to) of every row."""
    model = df.sparkSession.sparkContext.broadcast(Model(model_path))
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = None
        for batch in batches:
            machine = machine or Transducer(model.value)
            for a, texts in text_groups(batch.column(1)):
                flat, lengths, decoded = machine.encode_all(texts)
                offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, len(texts)), pa.ListArray.from_arrays(offsets, pa.array(flat, pa.int32())), pa.array(decoded, pa.string())], ["id", "ids", "decoded"])

    out = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, ids array<int>, decoded string")
    return out.withColumnRenamed("id", id_col)


def with_pieces(df: DataFrame, model_path: str, text_col: str = "text") -> DataFrame:
    """All columns but the text (and any of the new columns' names), with ids (array<int>), n_pieces and round_trip (the ids decode to the text; null counts as empty)."""
    model = df.sparkSession.sparkContext.broadcast(Model(model_path))
    other = [c for c in df.columns if c not in (text_col, "ids", "n_pieces", "round_trip")]
    read = df.select(*other, F.col(text_col).alias("text"))
    schema = df.select(*other).schema.add("ids", T.ArrayType(T.IntegerType())).add("n_pieces", "long").add("round_trip", "boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = None
        for batch in batches:
            machine = machine or Transducer(model.value)
            for a, texts in text_groups(batch.column(len(other))):
                part = batch.slice(a, len(texts))
                flat, lengths, decoded = machine.encode_all(texts)
                lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32), pa.array(flat, pa.int32()))
                back = pa.array([x == t for x, t in zip(decoded, texts)], pa.bool_())
                yield pa.RecordBatch.from_arrays([*part.columns[: len(other)], lists, pa.array(lengths), back], [*other, "ids", "n_pieces", "round_trip"])

    return read.mapInArrow(run, schema)


def sentencepiece_digest(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_pieces, ids_crc32 (of the ids as little-endian unsigned 32-bit integers), decoded_crc32 (of the decoded UTF-8) and round_trip (decoded = text) of every row."""
    model = df.sparkSession.sparkContext.broadcast(Model(model_path))
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = None
        for batch in batches:
            machine = machine or Transducer(model.value)
            for a, texts in text_groups(batch.column(1)):
                flat, lengths, decoded = machine.encode_all(texts)
                ends = np.cumsum(lengths)
                rows = [(n, zlib.crc32(flat[e - n : e].astype("<u4").tobytes()), zlib.crc32(d.encode()), d == t) for n, e, d, t in zip(lengths.tolist(), ends.tolist(), decoded, texts)]
                columns = [pa.array(x, k) for x, k in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.bool_()))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, len(texts)), *columns], ["id", "n_pieces", "ids_crc32", "decoded_crc32", "round_trip"])

    out = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, n_pieces long, ids_crc32 long, decoded_crc32 long, round_trip boolean")
    return out.withColumnRenamed("id", id_col)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op3_sentencepiece(spark, sf_dir: str, model_path: str | None = None) -> DataFrame:
    return sentencepiece_digest(table(spark, sf_dir, "documents"), model_path or default_model())
