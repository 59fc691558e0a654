"""Operator 5, token counts: a byte-level BPE tokenizer compiled into finite-state transducers.

Two transducers are composed. The first (pretokenizer.py) marks where pre-tokens begin; chunk state maps compose
by a parallel prefix scan. The second reads a pre-token's bytes; each transition is annotated with the number of
tokens that it emits (which may be negative, when a byte lets earlier tokens merge), so that the sum along a path
is the token count. It is determinised lazily: a state is the set of token starts still open, each with its trie
node, the last token before it, and its count relative to the current one. Two tokens may stand side by side only
if BPE of their joined bytes gives back the two; then exactly one path reaches each prefix, which makes the
machine deterministic. Token lengths are bounded, so the states are finitely many.

Results for odd input: null text counts as empty; empty text has 0 tokens; texts of any length are read whole, in
bounded memory beyond the text itself; repeated rows and null ids each give their row; an empty table gives an
empty result. A special token's string inside a text counts as one token, as the library does by default.
Columns beyond the id and the text are not read, so their names cannot clash.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylens.llm.common import table, text_groups
from quarrylens.llm.pretokenizer import compile_classes, split_texts

#: Counts of distinct pre-tokens kept by a worker, and states of the lazy machine, before it starts anew.
CACHE = 1 << 19
STATES = 1 << 17


NEVER = 1 << 60


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabularies: printable bytes as they are, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class BpeMachine:
    """The byte transducer of a BPE vocabulary, with emitted-token counts on its transitions."""

    def __init__(self, vocab: dict[bytes, int], ranks: dict[tuple[bytes, bytes], int]):
        self.ranks = ranks
        self.made: dict[bytes, tuple[bytes, bytes, int] | None] = {}
        self.ends: dict[bytes, list] = {}
        self.begins: dict[bytes, list] = {}
        self.children: list[dict[int, int]] = [{}]
        self.token: list[bytes | None] = [None]
        for t in vocab:
            if self.merge(t) != [t]:
                continue  # no text ever ends up as this token
            node = 0
            for b in t:
                after = self.children[node].get(b)
                if after is None:
                    after = len(self.children)
                    self.children[node][b] = after
                    self.children.append({})
                    self.token.append(None)
                node = after
            self.token[node] = t
        self.pairs: dict[tuple[bytes, bytes], bool] = {}
        self.reset()

    def reset(self) -> None:
        start = ((0, b"", 0),)
        self.configs = [start]
        self.ids = {start: 0}
        self.next: list[dict[int, tuple[int, int]]] = [{}]

    def merge(self, text: bytes) -> list[bytes]:
        """Plain BPE: the pair of lowest rank first, the leftmost of equals."""
        parts = [text[i : i + 1] for i in range(len(text))]
        while len(parts) > 1:
            best = min(((self.ranks.get(p, NEVER), i) for i, p in enumerate(zip(parts, parts[1:]))))
            if best[0] == NEVER:
                break
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def parts(self, t: bytes) -> tuple[bytes, bytes, int] | None:
        """The last merge that makes a token: its two parts and the merge's rank; None for a byte."""
        found = self.made.get(t, 0)
        if found == 0:
            if len(t) == 1:
                found = None
            else:
                cut = next(i for i in range(1, len(t)) if (t[:i], t[i:]) in self.ranks and self.merge(t[:i]) == [t[:i]] and self.merge(t[i:]) == [t[i:]] and self.adjacent_before(t[:i], t[i:]))
                found = (t[:cut], t[cut:], self.ranks[t[:cut], t[cut:]])
            self.made[t] = found
        return found

    def adjacent_before(self, a: bytes, b: bytes) -> bool:
        """Whether a and b both come to stand whole, side by side, before they merge with each other."""
        parts = [(a + b)[i : i + 1] for i in range(len(a + b))]
        while len(parts) > 2:
            i = min(((self.ranks.get(p, NEVER), i) for i, p in enumerate(zip(parts, parts[1:]))))[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts == [a, b]

    def spine(self, t: bytes, right: bool) -> list[tuple[bytes, int]]:
        """From the outermost byte up to the token: each part at that edge, with the rank of the merge that takes it up."""
        out, rank = [(t, NEVER)], NEVER
        while (found := self.parts(t)) is not None:
            t, rank = found[1 if right else 0], found[2]
            out.append((t, rank))
        return out[::-1]

    def adjacent(self, a: bytes, b: bytes) -> bool:
        """Whether BPE of the joined bytes gives the two tokens: no merge across the border comes before those inside."""
        if not a:
            return True
        ok = self.pairs.get((a, b))
        if ok is None:
            if len(self.pairs) >= STATES * 4:
                self.pairs.clear()
            ends = self.ends.get(a) or self.ends.setdefault(a, self.spine(a, True))
            begins = self.begins.get(b) or self.begins.setdefault(b, self.spine(b, False))
            i = j = 0
            ok = True
            while ok:
                (x, until_x), (y, until_y) = ends[i], begins[j]
                across = self.ranks.get((x, y), NEVER)
                ok = not (across < until_x and across <= until_y)
                if until_x == NEVER and until_y == NEVER:
                    break
                if until_x <= until_y:
                    i += 1
                else:
                    j += 1
            self.pairs[a, b] = ok
        return ok

    def step(self, state: int, byte: int) -> tuple[int, int]:
        """The transition, built when it is first asked for."""
        open_, last, emitted = [], None, None
        for node, before, count in self.configs[state]:
            node = self.children[node].get(byte)
            if node is None:
                continue
            open_.append((node, before, count))
            t = self.token[node]
            if last is None and t is not None and self.adjacent(before, t):
                last, emitted = t, count + 1
        if last is None:
            raise ValueError("the vocabulary has no token for a byte")
        config = tuple((n, b, c - emitted) for n, b, c in open_ if self.children[n]) + ((0, last, 0),)
        to = self.ids.get(config)
        if to is None:
            to = self.ids[config] = len(self.configs)
            self.configs.append(config)
            self.next.append({})
        self.next[state][byte] = (to, emitted)
        return to, emitted

    def count(self, text: bytes) -> int:
        state = total = 0
        for b in text:
            found = self.next[state].get(b)
            if found is None:
                if len(self.configs) > STATES:  # start the table anew from where this text stands
                    here = self.configs[state]
                    self.reset()
                    state = self.ids.setdefault(here, len(self.configs))
                    if state == len(self.configs):
                        self.configs.append(here)
                        self.next.append({})
                found = self.step(state, b)
            state, n = found
            total += n
        return total


def read_bpe(path: str) -> tuple[dict[bytes, int], dict[tuple[bytes, bytes], int], list[str]]:
    """Vocabulary, merge ranks and special strings of a byte-level BPE file of the tokenizers library."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre, model = spec["pre_tokenizer"], spec["model"]
    if spec["normalizer"] or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"] or model["ignore_merges"]:
        raise ValueError("only plain byte-level BPE files can be compiled")
    letters = byte_letters()
    raw = lambda s: bytes(letters[c] for c in s)
    special = [t["content"] for t in spec["added_tokens"]]
    vocab = {raw(t): i for t, i in model["vocab"].items() if t not in special}
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    return vocab, {(raw(a), raw(b)): i for i, (a, b) in enumerate(merges)}, special


def pieces_of(texts: list[str], classes: np.ndarray, special: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """split_texts, a special token's string in a text being a piece of its own."""
    if not any(s in t for s in special for t in texts):
        return split_texts(texts, classes)
    any_special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True))))
    parts, after, per_text = [], [], []
    for t in texts:
        before, at = len(parts), 0
        for found in any_special.finditer(t):
            parts.append(t[at : found.start()])
            after.append(special.index(found[0]))
            at = found.end()
        parts.append(t[at:])
        after.append(-1)
        per_text.append(len(parts) - before)
    distinct, index, per_part = split_texts(parts, classes)
    marks = np.array(after)
    index = np.insert(index, np.cumsum(per_part)[marks >= 0], len(distinct) + marks[marks >= 0])
    return distinct + special, index, np.add.reduceat(per_part + (marks >= 0), np.cumsum([0, *per_text[:-1]]))


def sums_of(values: np.ndarray, per_text: np.ndarray) -> np.ndarray:
    """The sum of each text's run of values; a text may have none."""
    total = np.concatenate([[0], np.cumsum(values)])
    ends = np.cumsum(per_text)
    return total[ends] - total[ends - per_text]


def token_counts(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512) -> DataFrame:
    """id, n_bytes, n_tokens and over_limit (n_tokens > limit) of every whole text."""
    from tokenizers import Tokenizer

    spark = df.sparkSession
    compiled = spark.sparkContext.broadcast((compile_classes(Tokenizer.from_file(tokenizer_path)), read_bpe(tokenizer_path)))
    kind = df.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, (vocab, ranks, special) = compiled.value
        machine, cache = None, {}
        for batch in batches:
            machine = machine or BpeMachine(vocab, ranks)
            n_tokens = np.zeros(batch.num_rows, np.int64)
            for begin, texts in text_groups(batch.column(1)):
                distinct, index, per_text = pieces_of(texts, classes, special)
                if len(cache) > CACHE:
                    cache.clear()
                cache.update(dict.fromkeys(special, 1))
                for p in distinct:
                    if p not in cache:
                        cache[p] = machine.count(p.encode())
                counts = np.fromiter(map(cache.__getitem__, distinct), np.int64, len(distinct))
                n_tokens[begin : begin + len(texts)] = sums_of(counts[index], per_text)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n_tokens), pa.array(n_tokens > limit)], ["id", "n_bytes", "n_tokens", "over_limit"])

    read = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"))
    out = read.mapInArrow(run, f"id {kind.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")
    return out.withColumnRenamed("id", id_col)


def op5_token_counts(spark, sf_dir: str, tokenizer_path: str | None = None) -> DataFrame:
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path("byte_bpe_50k.json")
    return token_counts(table(spark, sf_dir, "documents"), tokenizer_path)
