"""Packing by power-of-two decomposition.

A document of n tokens is cut into floor(n / size) pieces of ``size`` tokens and, for what is left, one piece for each
binary digit of its length, longest first. A piece is a sequence of its own, so no sequence crosses documents and none
is padded; sequences of equal length form a bucket and their ids are consecutive ranges by bucket and task, so that a
trainer reads batches of one length in order.

Results for odd input: a null or empty text is the closing id alone, hence one piece of length 1; repeated rows are
packed once each; long texts are cut like any other, with nothing dropped; an empty table gives an empty result. The
result has columns of its own and the id; other columns of ``docs``, whatever their names, are not looked at.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leverframe.llm.bpe import WORD_PATTERN, Specials, batches, byte_alphabet

#: A sequence id has 4 bits for the bucket, 26 for the task and 33 for the number in the task.
TASK_BITS, NUMBER_BITS = 26, 33


def decompose(n: int, size: int) -> list[int]:
    """Lengths of the pieces of n tokens: ``size`` (a power of two) as often as it fits, then the binary digits of the rest."""
    rest = n % size
    return [size] * (n // size) + [1 << k for k in range(size.bit_length() - 2, -1, -1) if rest >> k & 1]


class Tokens(Specials):
    """Token ids of whole texts, as the tokenizers library gives them for a vocabulary file."""

    def __init__(self, spec: str):
        data, alphabet = json.loads(spec), byte_alphabet()
        super().__init__(data)
        ranks = {bytes(map(alphabet.__getitem__, token)): i for token, i in data["model"]["vocab"].items() if token not in self.special}
        self.plain = tiktoken.Encoding("own", pat_str=WORD_PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def __call__(self, text: str) -> list[int]:
        out: list[int] = []
        for part in self.segments(text):
            if isinstance(part, int):
                out.append(part)
            else:
                out += self.plain(part)
        return out


_TOKENS: dict[int, Tokens] = {}


def pack(docs: DataFrame, vocabulary: str, size: int = 1024, closing_id: int = 0, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset, bucket (log2 of the length), and the ids if asked for.

    One pass without a shuffle: sequence ids come from the task's number and a counter for each bucket.
    """
    if size & (size - 1) or not 1 <= size <= 1 << 15:
        raise ValueError("size must be a power of two, at most 2^15, so that a sequence id has room for its bucket")
    spec = docs.sparkSession.sparkContext.broadcast(open(vocabulary, encoding="utf-8").read())
    kind = dict(docs.dtypes)[id_col]
    schema = f"k {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, bucket int" + ", ids array<int>" * with_ids

    def run(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = hash(spec.value)
        tokens = _TOKENS.get(key) or _TOKENS.setdefault(key, Tokens(spec.value))
        task = TaskContext.get().partitionId()
        counts = [0] * size.bit_length()
        names = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "bucket"]
        for batch in given:
            at = 0
            for texts in batches(batch.column(1), 300_000):
                rows, ids_out, owners = [], [], []
                for i, text in enumerate(texts):
                    ids = np.array([*tokens(text), closing_id], dtype="<u4")
                    raw, start = memoryview(ids.tobytes()), 0
                    for length in decompose(len(ids), size):
                        bucket = length.bit_length() - 1
                        number = (bucket << TASK_BITS | task) << NUMBER_BITS | counts[bucket]
                        counts[bucket] += 1
                        rows.append((start, length, zlib.crc32(raw[4 * start : 4 * (start + length)]), len(ids), number, 0, bucket))
                        owners.append(at + i)
                        if with_ids:
                            ids_out.append(ids[start : start + length].astype("int32"))
                        start += length
                figures = dict(zip(names, zip(*rows, strict=True), strict=True))
                out = {"k": batch.column(0).take(pa.array(owners)), **{c: pa.array(v, pa.int32() if c == "bucket" else pa.int64()) for c, v in figures.items()}}
                if with_ids:
                    out["ids"] = pa.array(ids_out, pa.list_(pa.int32()))
                yield pa.RecordBatch.from_pydict(out)
                at += len(texts)

    return docs.select(F.col(id_col).alias("k"), F.col(text_col).alias("t")).mapInArrow(run, schema).withColumnRenamed("k", id_col)


def bucket_sizes(pieces: DataFrame) -> DataFrame:
    """Sequences and tokens of each bucket, for planning batches."""
    return pieces.groupBy("bucket").agg(F.count(F.lit(1)).alias("n_sequences"), F.sum("length").alias("n_tokens"))
