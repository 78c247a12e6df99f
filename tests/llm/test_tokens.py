"""Encoding, decoding and packing against the tokenizers library."""

import gc
import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from leverframe.llm import bpe, packing
from leverframe.llm.queries import VOCABULARY

PATH = public_tokenizers.path(VOCABULARY)
ODD = ["", " ", "\n", "  hello   world \n\n x", "it's we'll\t\tx y", "<|endoftext|>a<|endoftext|>", "日本語 テスト 🙂🙂", "x" * 3000, "1234567 ½ ²", "don't\r\nstop\x00\x01", "a \n b", "trail ", " " * 40 + "x", "\x1c\x85\xa0\u3000 y", "…"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def encoder():
    return bpe.TrieEncoder(open(PATH, encoding="utf-8").read(), max_words=50)


@pytest.mark.parametrize("text", ODD)
def test_odd_texts(library, encoder, text):
    want = library.encode(text, add_special_tokens=False).ids
    assert encoder.encode(text) == want
    assert encoder.decode(want) == library.decode(want, skip_special_tokens=False)


def test_random_texts(library, encoder):
    rng = random.Random(3)
    for _ in range(1500):
        text = "".join(rng.choice("abcdethe THE  \n\t'sdlvr.,!éñ日½19🙂\xa0") for _ in range(rng.randint(1, 60)))
        assert encoder.encode(text) == library.encode(text, add_special_tokens=False).ids


def test_decoding_broken_bytes(library, encoder):
    ids = encoder.encode("🙂")[:1]
    assert encoder.decode(ids) == library.decode(ids, skip_special_tokens=False)


def docs(spark):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(98, None), (99, None), (3, ODD[3])]
    return spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "'clash' AS ids", "1 AS k")


def test_digests(spark, library):
    for r in bpe.digests(docs(spark), PATH).collect():
        text = ODD[r["doc_id"]] if r["doc_id"] < 90 else ""
        ids = library.encode(text, add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    whole = {r["doc_id"]: r["decoded"] for r in bpe.encode_decode(docs(spark), PATH).collect()}
    assert whole[3] == ODD[3] and whole[98] == ""


def test_no_collection_of_cycles_while_encoding(library):
    encoder = bpe.encoder(open(PATH, encoding="utf-8").read(), "digest")
    rng, runs = random.Random(5), []
    texts = [*ODD, *(" ".join("".join(rng.choices("abcdefgh", k=8)) for _ in range(2000)) for _ in range(4))]
    note = lambda phase, _: runs.append(phase)
    gc.collect()
    gc.callbacks.append(note)
    try:
        got = bpe.digest(encoder, texts)
    finally:
        gc.callbacks.remove(note)
    assert gc.isenabled() and len(runs) <= 2  # at most one, when the collector is on again
    for text, n, ids, _ in zip(texts, *got, strict=True):
        want = library.encode(text, add_special_tokens=False).ids
        assert (n, ids) == (len(want), hashlib.sha256(",".join(map(str, want)).encode()).hexdigest())


@pytest.mark.parametrize("n", [1, 2, 3, 1023, 1024, 1025, 5000])
def test_decompose(n):
    parts = packing.decompose(n, 1024)
    assert sum(parts) == n and all(p & (p - 1) == 0 and p <= 1024 for p in parts) and parts == sorted(parts, reverse=True)
    assert len([p for p in parts if p < 1024]) == bin(n % 1024).count("1")


def test_pack(spark, library):
    rows = packing.pack(docs(spark), PATH, with_ids=True).collect()
    assert len({r["sequence_id"] for r in rows}) == len(rows)
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        assert r["offset"] == 0 and r["length"] == 1 << r["bucket"] == len(r["ids"])
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
    for doc, parts in by_doc.items():
        want = [*library.encode(ODD[doc] if doc < 90 else "", add_special_tokens=False).ids, 0]
        times = 2 if doc == 3 else 1
        assert sum(p["length"] for p in parts) == times * len(want) and {p["doc_tokens"] for p in parts} == {len(want)}
        if times == 1:
            assert [i for p in sorted(parts, key=lambda p: p["start"]) for i in p["ids"]] == want


def test_sizes_without_room_for_their_bucket(spark):
    for size in (0, 3, 1 << 16):
        with pytest.raises(ValueError, match="power of two"):
            packing.pack(docs(spark), PATH, size=size)
    assert packing.pack(docs(spark), PATH, size=1 << 15).count() > 0


def test_ids_stay_as_they_are_beside_nulls_and_clashing_columns(spark, library):
    big = (1 << 53) + 1
    df = spark.createDataFrame([(big, "a b"), (None, "c"), (big + 2, None)], "doc_id long, text string").coalesce(1).selectExpr("doc_id", "text", "1 AS k", "2 AS ids", "3 AS `T`")
    want = Counter([big, None, big + 2])
    for out in (packing.pack(df, PATH), bpe.digests(df, PATH), bpe.encode_decode(df, PATH)):
        assert Counter({r["doc_id"] for r in out.collect()}) == want
    names = df.selectExpr("cast(doc_id AS string) AS doc_id", "text")
    assert {r["doc_id"] for r in packing.pack(names, PATH, with_ids=True).collect()} == {str(big), None, str(big + 2)}


def test_long_text(spark, library):
    text = "the then thentien 12,345 \n" * 40_000
    row = bpe.digests(spark.createDataFrame([(1, text)], "doc_id long, text string"), PATH).first()
    ids = library.encode(text, add_special_tokens=False).ids
    assert row["n_tokens"] == len(ids) and row["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def test_empty_table(spark):
    none = docs(spark).where("false")
    assert packing.pack(none, PATH).count() == 0 and bpe.digests(none, PATH).count() == 0
