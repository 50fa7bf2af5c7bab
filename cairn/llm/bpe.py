"""Byte-level BPE as an automaton over tokens, made from the merges by merge gadgets.

The automaton starts with one state and an arc for each byte. A merge (u, v)
puts in a gadget: the state that u leads to is split, the copy that only u
reaches loses its arc for v, and whatever state had the path u, v gets an arc
for uv to where v leads. All arcs of a token lead to one state, so after the
last merge a word has exactly one path whose labels spell it, which is its
encoding. Arcs aren't stored one by one: a state has an arc for a token unless
a gadget took it away, or took away the arc of the token's left part before the
token was made. Workers fill the transition table as words need it.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, in_arrow, slices
from .pretokens import Splitter

#: Words whose path a worker remembers before it starts anew.
MEMORY_WORDS = 150_000
#: Transitions that the table remembers before it starts anew.
MEMORY_ARCS = 200_000


def byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write for bytes: printable Latin-1 as itself, others from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


class Automaton:
    """Deterministic automaton over tokens; ``path`` encodes a word, ``labels`` decode ids."""

    def __init__(self, n_bytes_ids: dict[int, int], merges: list[tuple[int, int, int]], labels: dict[int, bytes]):
        """n_bytes_ids: byte to token id; merges: (left, right, merged) ids in order; labels: id to bytes."""
        self.labels = labels
        self.parts: dict[int, tuple[int, int]] = {}  # merged token: left part, time
        self.target: dict[int, int] = dict.fromkeys(n_bytes_ids.values(), 0)
        self.parent: list[tuple[int, int]] = [(-1, 0)]  # the state a copy was made of, time
        self.gone: dict[int, int] = {}  # state and token: when its arc was taken away
        sharing = [len(self.target)]  # tokens that lead to each state
        for time, (u, v, uv) in enumerate(merges, 1):
            if uv in self.target:
                raise ValueError(f"token {uv} is made by two merges")
            if u not in self.target or v not in self.target or not self.has_arc(self.target[u], v, time):
                continue  # no word has u before v by now, so none has uv
            end, middle = self.target[v], self.target[u]
            if sharing[middle] > 1 or middle == 0 or u == v:
                sharing[middle] -= 1
                self.parent.append((middle, time))
                sharing.append(1)
                middle = self.target[u] = len(self.parent) - 1
            self.gone[middle << 20 | v] = time
            self.parts[uv] = (u, time)
            self.target[uv] = end
            sharing[end] += 1
        self.table: dict[int, int] = {}  # state and token: next state, or -1
        self.root: dict = {}
        self.size = [len(labels.get(t, b"")) for t in range(max(labels) + 1)]
        self.longest = max(self.size)
        self.shorter = [-1] * len(self.size)  # the longest token that begins a token
        for token in sorted(self.target, key=self.size.__getitem__):
            node, best = self.root, -1
            for b in labels[token]:
                node = node.setdefault(b, {})
                best = node.get(-1, best)
            node[-1], self.shorter[token] = token, best

    def has_arc(self, state: int, token: int, until: int) -> bool:
        """Whether the state has an arc for the token at the given time."""
        gone, parent, parts = self.gone, self.parent, self.parts
        while True:
            at, limit = state, until
            while at >= 0:
                when = gone.get(at << 20 | token)
                if when is not None and when <= limit:
                    return False
                at, made = parent[at]
                if made < limit:
                    limit = made
            part = parts.get(token)
            if part is None:
                return True
            token, until = part

    def path(self, word: bytes) -> list[int]:
        """The labels of the one path that spells the word.

        A prefix has one path, too, so a place that was left in vain is never
        entered again; longest arcs are tried first.
        """
        n, table, size, shorter, root = len(word), self.table, self.size, self.shorter, self.root
        dead, longest = None, self.longest
        ids: list[int] = []
        i = state = 0
        while i < n:
            node = root
            for b in word[i : i + longest]:
                node = node.get(b)
                if node is None:
                    break
                if -1 in node:
                    token = node[-1]
            while True:
                end = i + size[token]
                if dead is None or not dead[end]:
                    key = state << 20 | token
                    to = table.get(key)
                    if to is None:
                        to = table[key] = self.target[token] if self.has_arc(state, token, 1 << 40) else -1
                    if to >= 0:
                        ids.append(token)
                        i, state = end, to
                        break
                token = shorter[token]
                while token < 0:
                    dead = dead or bytearray(n + 1)
                    dead[i] = 1
                    token = ids.pop()
                    i -= size[token]
                    state = self.target[ids[-1]] if ids else 0
                    token = shorter[token]
        return ids


class Encoder:
    """Texts to ids and back for a byte-level BPE file, by the automaton."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        letters = byte_letters()
        vocab = made["model"]["vocab"]
        spell = lambda token: bytes(letters[c] for c in token)
        split = [m.split(" ") if isinstance(m, str) else m for m in made["model"]["merges"]]
        merges = [(vocab[a], vocab[b], vocab[a + b]) for a, b in split]
        self.special = {t["content"]: t["id"] for t in made["added_tokens"]}
        labels = {i: spell(t) for t, i in vocab.items() if t not in self.special}
        self.automaton = Automaton({b: vocab[c] for c, b in letters.items()}, merges, labels)
        self.labels = labels | {i: t.encode() for t, i in self.special.items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.sizes = np.array([len(self.labels.get(i, b"")) for i in range(max(self.labels) + 1)])
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.blob = np.frombuffer(b"".join(self.labels.get(i, b"") for i in range(len(self.sizes))), np.uint8)
        self.words = Splitter().words
        self.known: dict[str, bytes] = {}

    def _plain(self, text: str) -> bytes:
        known = self.known
        words = self.words(text)
        if len(self.automaton.table) > MEMORY_ARCS:
            self.automaton.table.clear()
        try:
            return b"".join([known[w] for w in words])
        except KeyError:
            pass
        if len(known) > MEMORY_WORDS:
            known.clear()
        for w in words:
            if w not in known:
                known[w] = _packed(self.automaton.path(w.encode()))
        return b"".join([known[w] for w in words])

    def encode(self, text: str) -> bytes:
        """The ids as packed 32-bit integers."""
        if self.cut is None or not self.cut.search(text):
            return self._plain(text)
        return b"".join(_packed([self.special[x]]) if k % 2 else self._plain(x) for k, x in enumerate(self.cut.split(text)) if x)

    def decode(self, ids: np.ndarray) -> str:
        """The labels of the ids, one after another, as text."""
        if not len(ids):
            return ""
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        return self.blob[np.arange(ends[-1]) + np.repeat(self.starts[ids] - ends + sizes, sizes)].tobytes().decode("utf-8", "replace")


def _packed(ids: list[int]) -> bytes:
    from array import array

    return array("i", ids).tobytes()


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def encode(docs: DataFrame, tokenizer_path: str, text_col: str = "text", ids_col: str = "ids", decoded_col: str | None = None) -> DataFrame:
    """Add the ids of every whole text as an array of integers; the text column stays as it is.

    With ``decoded_col``, the ids are decoded again in the same pass, into a
    column of that name. Ids are those of the tokenizers library without added
    special tokens; the strings of special tokens inside a text give their ids,
    as by default there. A null or empty text has an empty array. Repeated rows
    are encoded alike, an empty table stays empty, and other columns pass
    unchanged (those named like the new columns are replaced).
    """
    base = docs.drop(ids_col, *([decoded_col] if decoded_col else []))
    more = [T.StructField(decoded_col, T.StringType())] if decoded_col else []
    schema = T.StructType([*base.schema.fields, T.StructField(ids_col, T.ArrayType(T.IntegerType())), *more])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = encoder(tokenizer_path)
        for big in batches:
            for batch in slices(big):
                texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
                packed = [made.encode(x) if x else b"" for x in texts]
                ends = np.concatenate([[0], np.cumsum([len(p) // 4 for p in packed])]).astype(np.int32)
                ids = np.frombuffer(b"".join(packed), np.int32)
                columns = [pa.ListArray.from_arrays(pa.array(ends), pa.array(ids))]
                if decoded_col:
                    columns.append(pa.array([made.decode(ids[a:b]) for a, b in zip(ends, ends[1:], strict=False)], pa.string()))
                yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=schema.names)

    return in_arrow(base, run, schema)


def decode(encoded: DataFrame, tokenizer_path: str, ids_col: str = "ids", decoded_col: str = "decoded") -> DataFrame:
    """Add the text that the arc labels of the ids spell; special tokens are written out.

    Null ids decode like none, to an empty text. A column named like
    ``decoded_col`` is replaced.
    """
    base = encoded.drop(decoded_col)
    schema = T.StructType([*base.schema.fields, T.StructField(decoded_col, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = encoder(tokenizer_path)
        for big in batches:
            for batch in slices(big):
                ids = batch.column(batch.schema.get_field_index(ids_col))
                texts = pa.array([made.decode(x.values.to_numpy(zero_copy_only=False) if x.is_valid else ()) for x in ids], pa.string())
                yield pa.RecordBatch.from_arrays([*batch.columns, texts], names=[*batch.schema.names, decoded_col])

    return in_arrow(base, run, schema)


def digests(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and of the text decoded again."""
    done = encode(docs.select("doc_id", "text"), tokenizer_path, decoded_col="decoded")
    return done.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op8_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document through the automaton of byte_bpe_50k.json and back."""
    import public_tokenizers

    return digests(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
