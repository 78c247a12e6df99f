"""Exact dedup with a sharded cuckoo-filter index of text digests.

Digests are dealt to shards by their value. A shard is one task that holds a cuckoo filter: short fingerprints in
buckets of four slots, two candidate buckets for each digest, and beside each slot the stored key (the whole digest
with its representative and count). A lookup that hits a fingerprint is verified against the keys stored in that
bucket; an insertion that runs out of kicks doubles the table and re-inserts the stored keys. Keys can be deleted, so
that the index can follow a changing corpus (``apply_changes``).

Copies are counted before the shuffle, per digest and salt, so a text that makes up a third of all rows reaches its
shard as at most ``SALTS`` rows. There are as many shards as keep them at ``SHARD`` rows, and at least one for each
shuffle partition, so a task's index is bounded however large the table.

Results for odd input: null text counts as empty; of equal texts the row with the largest id stays, null ids last; if
rows repeat one id, each of them is marked kept when that id is the one that stays; very long texts are hashed whole; an
empty table gives an empty result. ``groups`` has columns of its own only; ``dedup`` keeps one row of each text with the
columns of ``docs`` whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice
from math import ceil

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leverframe.llm.common import brought_back, cut, drop, join_grouped, keep_decided, partitions, set_aside

SALTS = 16
#: Most rows that a shard gets on average, whatever the number of shuffle partitions.
SHARD = 250_000
NO_ID = -(2**63)
INDEX = "digest binary, keep_id long, group_size long"
SLOTS = 4
MAX_KICKS = 64


class CuckooIndex:
    """A cuckoo filter whose slots also hold the stored keys: digest -> [largest id, count]."""

    def __init__(self, buckets: int = 1024):
        self.resize_to(buckets)
        self.resizes = 0

    def resize_to(self, buckets: int) -> None:
        self.mask = buckets - 1
        self.prints: list[list[int]] = [[] for _ in range(buckets)]
        self.keys: list[list[list]] = [[] for _ in range(buckets)]

    def places(self, digest: bytes) -> tuple[int, int, int]:
        """Fingerprint and the two candidate buckets; the second depends on the first and the fingerprint only."""
        print_ = int.from_bytes(digest[:2], "little") | 1
        first = int.from_bytes(digest[2:10], "little") & self.mask
        return print_, first, self.other(first, print_)

    def other(self, bucket: int, print_: int) -> int:
        return (bucket ^ print_ * 0x5BD1E995) & self.mask

    def find(self, digest: bytes) -> tuple[int, int] | None:
        """Bucket and slot of a digest: a fingerprint hit, verified against the bucket's stored keys."""
        print_, a, b = self.places(digest)
        for bucket in (a, b):
            if print_ in self.prints[bucket]:
                for slot, key in enumerate(self.keys[bucket]):
                    if key[0] == digest:
                        return bucket, slot
        return None

    def get(self, digest: bytes) -> list | None:
        at = self.find(digest)
        return self.keys[at[0]][at[1]] if at else None

    def insert(self, digest: bytes, doc_id, count: int = 1) -> bool:
        """Adds copies of a digest; true if it was not there."""
        key = self.get(digest)
        if key is not None:
            key[1] = max(key[1], doc_id)
            key[2] += count
            return False
        self.place([digest, doc_id, count])
        return True

    def place(self, key: list) -> None:
        print_, bucket, other = self.places(key[0])
        if len(self.keys[bucket]) >= SLOTS and len(self.keys[other]) < SLOTS:
            bucket = other
        for kick in range(MAX_KICKS):
            if len(self.keys[bucket]) < SLOTS:
                self.prints[bucket].append(print_)
                self.keys[bucket].append(key)
                return
            slot = (print_ + kick) % SLOTS
            self.prints[bucket][slot], print_ = print_, self.prints[bucket][slot]
            self.keys[bucket][slot], key = key, self.keys[bucket][slot]
            bucket = self.other(bucket, print_)
        stored = [k for keys in self.keys for k in keys] + [key]
        self.resize_to(2 * (self.mask + 1))
        self.resizes += 1
        for k in stored:
            self.place(k)

    def delete(self, digest: bytes) -> bool:
        at = self.find(digest)
        if at is None:
            return False
        self.prints[at[0]].pop(at[1])
        self.keys[at[0]].pop(at[1])
        return True

    def items(self) -> Iterator[list]:
        for keys in self.keys:
            yield from keys


def build_index(digests: DataFrame) -> DataFrame:
    """(digest, doc_id, n) rows, n copies each, to one row per live digest: digest, keep_id, group_size."""
    salted = _whole_ids(digests).withColumn("_salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))).groupBy("digest", "_salt").agg(F.max("doc_id").alias("doc_id"), F.sum("n").alias("n"))

    def shard(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = CuckooIndex()
        for frame in frames:
            for digest, doc_id, n in zip(frame["digest"], frame["doc_id"], frame["n"], strict=True):
                index.insert(bytes(digest), doc_id, n)
        yield from _frames(index)

    return _null_ids(salted.select("digest", "doc_id", "n").repartition(shards(digests), "digest").mapInPandas(shard, INDEX))


def shards(rows: DataFrame) -> int:
    """How many shards an index of these rows gets."""
    return max(partitions(rows.sparkSession), ceil(rows.count() / SHARD))


def _frames(index: CuckooIndex, rows: int = 20_000) -> Iterator[pd.DataFrame]:
    """The stored keys in frames of bounded size."""
    keys = index.items()
    while block := list(islice(keys, rows)):
        yield _frame(block)


def _frame(keys: list[list]) -> pd.DataFrame:
    return pd.DataFrame(keys, columns=["digest", "keep_id", "group_size"])


def _whole_ids(rows: DataFrame) -> DataFrame:
    """Null ids as the least integer, so that ids stay integers in pandas."""
    return rows.withColumn("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID).cast("long")))


def _null_ids(index: DataFrame) -> DataFrame:
    return index.withColumn("keep_id", F.when(F.col("keep_id") != F.lit(NO_ID).cast("long"), F.col("keep_id")))


def apply_changes(index: DataFrame, inserts: DataFrame, deletes: DataFrame) -> DataFrame:
    """A stored index (digest, keep_id, group_size) after deleting the digests in ``deletes`` and inserting (digest, doc_id, n) rows.

    A digest in both is deleted first. Each shard rebuilds its filter from the stored keys.
    """
    rows = _whole_ids(
        index.select("digest", F.col("keep_id").alias("doc_id"), F.col("group_size").alias("n"), F.lit(0).alias("op"))
        .unionByName(deletes.select("digest").distinct().select("digest", F.lit(None).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("n"), F.lit(1).alias("op")))
        .unionByName(inserts.groupBy("digest").agg(F.max("doc_id").alias("doc_id"), F.sum("n").alias("n")).withColumn("op", F.lit(2)))
    )

    def shard(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        live = CuckooIndex()
        for frame in frames:
            for digest, doc_id, n, op in zip(frame["digest"], frame["doc_id"], frame["n"], frame["op"], strict=True):
                if op == 1:
                    live.delete(bytes(digest))
                else:
                    live.insert(bytes(digest), doc_id, n)
        yield from _frames(live)

    return _null_ids(rows.repartition(shards(rows), "digest").sortWithinPartitions("op").mapInPandas(shard, INDEX))


def groups(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = cut(docs.select("doc_id", F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("digest")))
    index = cut(build_index(rows.withColumn("n", F.lit(1).cast("long"))))
    total = rows.count()
    out = join_grouped(rows.withColumn("digest", F.lower(F.hex("digest"))), index.withColumn("digest", F.lower(F.hex("digest"))), "digest", "group_size", total)
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("digest").alias("text_sha256"))


def dedup(docs: DataFrame) -> DataFrame:
    """The documents that stay, with all their columns; texts are only shuffled where ``keep_decided`` must."""
    rows = cut(docs.select("doc_id", F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("digest")))
    index = cut(build_index(rows.withColumn("n", F.lit(1).cast("long"))).where("group_size > 1").select("digest", "keep_id"))
    drop(rows)
    aside = set_aside(docs, "doc_id", "text")
    keyed = aside.withColumn("_digest", F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)))
    kept = keep_decided(keyed, index.select(F.col("digest").alias("_digest"), F.col("keep_id").alias("_keep"), F.lit(True).alias("_stays")))
    return brought_back(kept, aside, docs)
