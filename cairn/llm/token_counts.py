"""Token counts: Arrow functions that return the lengths of encodings only."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, in_arrow, slices
from .pretokens import Splitter

#: Bytes of text that one call of the library gets; bounds its memory, whatever the lengths of the texts.
BATCH_BYTES = 1 << 20
#: Pieces whose length a worker remembers before it starts anew.
MEMORY_PIECES = 500_000

def balanced(texts: Iterable[str], limit: int = BATCH_BYTES) -> Iterator[list[str]]:
    """Batches of about ``limit`` bytes; a longer text is a batch of its own."""
    batch, held = [], 0
    for text in texts:
        n = len(text.encode())
        if batch and held + n > limit:
            yield batch
            batch, held = [], 0
        batch.append(text)
        held += n
    if batch:
        yield batch


class Counter:
    """Token counts of texts by the library's batch encoding; one for each file in a worker."""

    def __init__(self, path: str):
        self.free, self.cut = False, None
        if path.endswith(".json"):
            os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
            from tokenizers import Tokenizer

            self.tokenizer = Tokenizer.from_file(path)
            self.tokenizer.no_truncation()
            self.tokenizer.no_padding()
            self._whole = lambda texts: [len(e) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            self._inspect(path)
        else:
            from sentencepiece import SentencePieceProcessor

            model = SentencePieceProcessor(model_file=path)
            self._whole = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
        self.words = Splitter().words
        self.known: dict[str, int] = {}

    def _inspect(self, path: str) -> None:
        """Texts may be cut at pre-tokens where byte-level BPE does without normalizer and post-processor."""
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        pre = made.get("pre_tokenizer") or {}
        special = sorted((t["content"] for t in made["added_tokens"]), key=len, reverse=True)
        self.cut = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
        plain = not any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in made["added_tokens"])
        self.free = bool(plain and not made.get("normalizer") and not made.get("post_processor") and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space"))

    def whole(self, texts: Iterable[str]) -> list[int]:
        return [n for batch in balanced(texts) for n in self._whole(batch)]

    def learn(self, pieces: set[str]) -> None:
        """Lengths of pre-tokens. A blank and letters: strung together they are cut apart again, so they travel in long texts."""
        chain = [p for p in pieces if p[0] == " " and p[1:].isalpha()]
        rest = [p for p in pieces if not (p[0] == " " and p[1:].isalpha())]
        self.known.update(zip(rest, self.whole(rest), strict=True))
        for group in balanced(chain, BATCH_BYTES >> 3):
            found = np.bincount(self.tokenizer.encode("".join(group), add_special_tokens=False).word_ids, minlength=len(group))
            if len(found) != len(group):
                found = self.whole(group)
            self.known.update(zip(group, map(int, found), strict=True))

    def count(self, texts: list[str]) -> list[int]:
        if not self.free:
            return self.whole(texts)
        split = [self.pieces(x) for x in texts]
        fresh = {p for _, ps in split for p in ps if p not in self.known}
        if len(self.known) + len(fresh) > MEMORY_PIECES:
            self.known.clear()
            fresh = {p for _, ps in split for p in ps}
        self.learn(fresh)
        get = self.known.__getitem__
        return [n + sum(map(get, ps)) for n, ps in split]

    def pieces(self, text: str) -> tuple[int, list[str]]:
        """How many special strings a text holds, a token each, and the pre-tokens of what stands between them."""
        if not self.cut or not self.cut.search(text):
            return 0, self.words(text)
        parts = self.cut.split(text)
        return len(parts) // 2, [w for x in parts[::2] if x for w in self.words(x)]


_COUNTERS: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(path)
    return _COUNTERS[path]


def count_tokens(docs: DataFrame, tokenizer_path: str, text_col: str = "text") -> DataFrame:
    """Add ``n_bytes`` and ``n_tokens`` (long) to ``docs``, whose text column is left out.

    Counts are those of the library for the file, without begin, end or added
    special tokens; special strings inside a text count as the library's default
    has it. A null or empty text has 0 of both. Rows are independent: repeated
    rows are counted again, an empty table gives an empty table, and the other
    columns pass unchanged (columns named n_bytes or n_tokens are replaced).

    Where the file allows it, a worker cuts texts at special strings and at the
    boundaries that no token crosses, however long they are, sends the pieces it hasn't met to the library
    in batches balanced by bytes, and keeps lengths, never encodings.
    """
    keep = [c for c in docs.columns if c not in (text_col, "n_bytes", "n_tokens")]
    shaped = docs.select(*keep, F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    out = shaped.drop("_text").withColumn("n_bytes", F.lit(0).cast("long")).withColumn("n_tokens", F.lit(0).cast("long")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(tokenizer_path).count
        for big in batches:
            for batch in slices(big):
                texts = batch.column(batch.schema.get_field_index("_text")).to_pylist()
                n_tokens = count(texts)
                names = [n for n in batch.schema.names if n != "_text"]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(batch.schema.get_field_index(n)) for n in names] + [pa.array([len(x.encode()) for x in texts], pa.int64()), pa.array(n_tokens, pa.int64())],
                    names=[*names, "n_bytes", "n_tokens"],
                )

    return in_arrow(shaped, run, out)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document under byte_bpe_50k.json."""
    import public_tokenizers

    counted = count_tokens(documents(spark, sf_dir).select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))
