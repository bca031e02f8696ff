"""Packing by power-of-two decomposition: no sequence crosses documents and none is padded.

A document of L tokens is cut into floor(L / max_len) pieces of ``max_len`` and, for the rest, one piece per set bit of
the remainder, longest first.  Each piece is a sequence of its own; equal lengths share a bucket, and ``sequence_id``
numbers the sequences bucket after bucket (longest first), gapless from 0, so a bucket is one range of ids.

Tokenising needs Python (Arrow batches, bytes-level joins); the pieces are written once to the shared folder, and the
numbers follow from counts per (bucket, partition): nothing is sorted or shuffled but those counts.

Defined cases: null and empty texts are documents of the end token alone; repeated rows are packed each; a null id is
kept; an empty table gives no pieces; other columns of the input aren't read; special-token strings in a text are
ordinary text.  Very long texts are tokenised whole.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpoint, col, read

MAX_LEN = 2048
END_ID = 1
#: Entries of a worker's word cache; when full it starts anew.
CACHE_WORDS = 300_000
#: Text around a space that a split at single spaces would not keep apart as the tokenizer does.
_RUNS = re.compile(r"\s | \s")


def _bytes_of_unicode() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use, back to bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class _Words(dict):
    """Ids (little-endian uint32 bytes) of a word after a space."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        ids = self[word] = np.array(self.encode(" " + word), dtype="<u4").tobytes()
        return ids


class FastTokenizer:
    """Ids of a byte-level BPE ``tokenizers`` file, with words cached.

    Pre-tokens of this family never span a single space between non-spaces, so such texts are split there and each
    word's ids looked up; a new word, or a text with runs of white space, is encoded in full.
    """

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        back = _bytes_of_unicode()
        special = {a["content"] for a in spec.get("added_tokens", []) if a.get("special")}
        ranks = {bytes(back[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
        self.full = tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.words = _Words(self.full)

    def ids(self, text: str) -> bytes:
        if _RUNS.search(text):
            return np.array(self.full(text), dtype="<u4").tobytes()
        if len(self.words) > CACHE_WORDS:
            self.words.clear()
        first, *rest = text.split(" ")
        return np.array(self.full(first), dtype="<u4").tobytes() + b"".join(map(self.words.__getitem__, rest))


_tokenizers: dict[str, FastTokenizer] = {}


def tokenizer(path: str) -> FastTokenizer:
    """One tokenizer a worker."""
    if path not in _tokenizers:
        _tokenizers[path] = FastTokenizer(path)
    return _tokenizers[path]


def cut(n: int, max_len: int = MAX_LEN) -> list[int]:
    """Lengths of the pieces of a document of n tokens."""
    full, rest = divmod(n, max_len)
    return [max_len] * full + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def pack_documents(docs: DataFrame, tokenizer_path: str, max_len: int = MAX_LEN, with_ids: bool = False, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, bucket, sequence_id, offset (and ``ids``)."""
    if max_len & (max_len - 1):
        raise ValueError("max_len must be a power of two")
    src = docs.select(col(doc_id).alias("doc_id"), col(text).cast("string").alias("text"))
    fields = [src.schema["doc_id"]] + [T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32", "doc_tokens")] + [T.StructField("bucket", T.IntegerType()), T.StructField("part", T.IntegerType()), T.StructField("nth", T.LongType())]
    if with_ids:
        fields.append(T.StructField("ids", T.BinaryType()))
    end = np.array([END_ID], dtype="<u4").tobytes()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, part = tokenizer(tokenizer_path), TaskContext.get().partitionId()
        seen = [0] * (max_len.bit_length())
        for batch in batches:
            take, rows, raw = [], [], []
            for i, t in enumerate(batch.column(1)):
                ids = tok.ids(t.as_py() or "") + end
                n, start = len(ids) // 4, 0
                for k in cut(n, max_len):
                    b = k.bit_length() - 1
                    piece = ids[4 * start : 4 * (start + k)]
                    take.append(i)
                    rows.append((start, k, zlib.crc32(piece), n, b, part, seen[b]))
                    if with_ids:
                        raw.append(piece)
                    seen[b] += 1
                    start += k
            a = np.array(rows, dtype=np.int64).reshape(-1, 7)
            arrays = [batch.column(0).take(pa.array(take, pa.int64())), *(pa.array(a[:, j]) for j in range(4)), pa.array(a[:, 4].astype(np.int32)), pa.array(a[:, 5].astype(np.int32)), pa.array(a[:, 6])]
            yield pa.RecordBatch.from_arrays(arrays + ([pa.array(raw, pa.binary())] if with_ids else []), names=[f.name for f in fields])

    done = checkpoint(src.mapInArrow(pieces, T.StructType(fields)))
    # one row per (bucket, partition): at most 12 a partition
    counts = done.groupBy("bucket", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy(F.col("bucket").desc(), "part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("bucket", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    out = done.join(base, ["bucket", "part"])
    extra = ["ids"] if with_ids else []
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("base") + F.col("nth")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), "bucket", *extra)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
