"""Encoding of a corpus with a public byte-level tokenizer, and its exact inverse.

Texts go through the tokenizers library in Arrow batches.  Byte offsets of tokens are the running sums
of their byte lengths; a byte-to-character map turns them into character offsets, where a token that
holds only some bytes of a character covers the whole character.  Decoding reverses the byte table.

Defined results: null and empty texts have the empty list; blank texts have the ids of their spaces;
strings of special tokens in a text are ordinary text.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.tokens import byte_table, tokenizer_file
from marginalia.tables import spread

DEFAULT = "byte_bpe_50k.json"


@lru_cache(2)
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the tasks of an executor are the parallelism
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t


def encode(texts: list[str | None], path: str, budget: int = 2_000_000) -> Iterator[list[list[int]]]:
    """Ids of the texts, in runs of at most `budget` characters (a longer text is a run of its own)."""
    t = tokenizer(path)
    run, size = [], 0
    for x in [*(x or "" for x in texts), None]:
        if run and (x is None or size + len(x) > budget):
            yield [e.ids for e in t.encode_batch_fast(run, add_special_tokens=False)]
            run, size = [], 0
        if x is not None:
            run.append(x)
            size += len(x)


@lru_cache(2)
def token_bytes(path: str) -> list[bytes]:
    """The bytes of each id, by the reversed byte table."""
    import json

    table, vocab = byte_table(), tokenizer(path).get_vocab(with_added_tokens=False)
    added = {x["id"]: x["content"].encode() for x in json.load(open(path, encoding="utf-8")).get("added_tokens", [])}
    out = [b""] * (max([*vocab.values(), *added], default=-1) + 1)
    for word, i in vocab.items():
        out[i] = added[i] if i in added else bytes(table[c] for c in word)
    for i, b in added.items():
        out[i] = b
    return out


def decode(ids: list[int], path: str) -> str:
    """The text of the ids; bytes that are no whole character (cut sequences) become U+FFFD."""
    table = token_bytes(path)
    return b"".join(table[i] for i in ids).decode("utf-8", "replace")


def offsets(ids: list[int], text: str, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Start and end, in characters, of each token of a text."""
    table = token_bytes(path)
    ends = np.cumsum([len(table[i]) for i in ids], dtype=np.int64) if ids else np.zeros(0, np.int64)
    raw = np.frombuffer(text.encode(), np.uint8)
    char = np.cumsum((raw & 0xC0) != 0x80) - 1  # of each byte
    starts = np.concatenate(([0], ends[:-1])) if len(ends) else ends
    return char[starts], char[ends - 1] + 1


def _arrow(df: DataFrame, fn, schema: str) -> DataFrame:
    return spread(df).mapInArrow(fn, schema)


def encoded(docs: DataFrame, key: str = "doc_id", text: str = "text", name: str = DEFAULT) -> DataFrame:
    """key and ids of every row."""
    path = tokenizer_file(name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, at = b.column(0), 0
            for part in encode(b.column(1).to_pylist(), path):
                lens = np.fromiter((len(x) for x in part), np.int64, len(part))
                flat = np.fromiter((i for x in part for i in x), np.int32, int(lens.sum()))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(lens))), pa.int32()), pa.array(flat))
                yield pa.RecordBatch.from_arrays([keys.slice(at, len(part)), lists], ["k", "ids"])
                at += len(part)

    kind = docs.schema[key].dataType.simpleString()
    return _arrow(docs.select(F.col(key).alias("k"), F.col(text).alias("t")), run, f"k {kind}, ids array<int>").withColumnRenamed("k", key)


def encoded_offsets(docs: DataFrame, key: str = "doc_id", text: str = "text", name: str = DEFAULT) -> DataFrame:
    """key, n_tokens, token_starts and token_ends (characters), n_split (tokens that begin inside a
    character), and whether decoding gives the text again (an empty text for null)."""
    path = tokenizer_file(name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, texts, at = b.column(0), b.column(1).to_pylist(), 0
            for part in encode(texts, path, 500_000):
                rows: list[tuple] = []
                for ids, t in zip(part, texts[at : at + len(part)]):
                    s, e = offsets(ids, t or "", path)
                    split = int((s[1:] < e[:-1]).sum()) if len(ids) > 1 else 0
                    rows.append((len(ids), s.astype(np.int32), e.astype(np.int32), split, decode(ids, path) == (t or "")))
                n, s, e, split, ok = zip(*rows)
                ints = pa.list_(pa.int32())
                cols = [keys.slice(at, len(part)), pa.array(n, pa.int32()), pa.array(list(s), ints), pa.array(list(e), ints), pa.array(split, pa.int32()), pa.array(ok)]
                yield pa.RecordBatch.from_arrays(cols, ["k", "n_tokens", "token_starts", "token_ends", "n_split", "round_trip"])
                at += len(part)

    kind = docs.schema[key].dataType.simpleString()
    out = _arrow(docs.select(F.col(key).alias("k"), F.col(text).alias("t")), run, f"k {kind}, n_tokens int, token_starts array<int>, token_ends array<int>, n_split int, round_trip boolean")
    return out.withColumnRenamed("k", key)


def token_lengths(docs: DataFrame, keep: list[str], text: str = "text", name: str = DEFAULT) -> DataFrame:
    """The columns `keep` and n_tokens of every row; 0 for null and empty texts."""
    path = tokenizer_file(name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = [len(x) for part in encode(b.column(len(keep)).to_pylist(), path) for x in part]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(len(keep))), pa.array(n, pa.int64())], [*keep, "n_tokens"])

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return _arrow(docs.select(*keep, F.col(text).alias("__text")), run, f"{schema}, n_tokens bigint")
