"""Cross-tokenizer alignment: byte-level links between the tokens of two vocabularies, with corpus-wide counts of linked pairs.

A: byte-level BPE (a tokenizers file) on space + text; B: a sentencepiece model on the text. Both cut the same bytes, so a
token pair is linked where its byte ranges overlap, and byte offsets at which both end a token cut the text into groups.

Batches are Arrow tables throughout:

1. Texts are cut into chunks at a space after a character that is no white space, where neither vocabulary has a token
   that crosses. The distinct chunks of a batch are encoded once each; ``take`` on their list arrays, flattened, with
   parent indices, gives the token columns of all of the batch's documents.
2. Token lengths come by ``take``, token ends by segmented cumulative sums (the batch's sum less that at the document's
   start). A hash join of the two columns of (document, end) keys, in order of the key, with ids filled backwards, is the
   list of links; a key on both sides ends a group.
3. ``group_by`` counts the pairs of a batch. Documents (with their links as numbers of the batch's pairs) and these counts
   are written to one table; Spark sums the counts over all batches, finds each B id's greatest one, and hands each batch
   its pairs' figures back, where they are summed for each document.

What is shuffled is each batch's distinct pairs, not links, and the documents once by batch: a batch has about
``CHARS`` characters (one document at least), so no group grows with the corpus and no vocabulary of pairs is broadcast.

Results for odd input: null and empty texts, and texts whose tokens don't give back their bytes in one of the vocabularies
(for example with U+2581), have no tokens: zeros and an empty ``groups_sha256``; special strings in texts are plain text;
very long texts are one batch; repeated rows each count and get a row; ties for a B id's highest count all count as best;
an empty table gives an empty result. The result has columns of its own and the id; other columns of ``docs``, whatever
their names, are not looked at.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leverframe.llm.bpe import WORD_PATTERN, byte_alphabet
from leverframe.llm.common import partitions, scratch, small_batches

#: Characters of a batch, and distinct chunks that a worker remembers.
CHARS, REMEMBERED = 2_000_000, 400_000
END_BITS, B_BITS = 34, 24


class Vocabularies:
    """Encoders of chunks, and each id's bytes."""

    def __init__(self, spec: str, model: bytes):
        alphabet = byte_alphabet()
        vocab = json.loads(spec)["model"]["vocab"]
        ranks = {bytes(alphabet[c] for c in token): i for token, i in vocab.items() if all(c in alphabet for c in token)}
        self.a = tiktoken.Encoding("own", pat_str=WORD_PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        pieces = [self.sp.id_to_piece(i) for i in range(self.sp.vocab_size())]
        self.space = self.sp.piece_to_id("▁")
        self.bytes_a = table_of({i: b for b, i in ranks.items()})
        self.bytes_b = table_of(dict(enumerate(map(piece_bytes, pieces))))
        #: Whether a space after another character always begins a piece, so that chunks can be encoded apart.
        self.by_chunk = not any("▁" in p.lstrip("▁") for p in pieces) and not self.sp.is_unknown(self.space) and self.sp.encode("a") == self.sp.encode("a b")[:1] and self.sp.encode(" ") == [*self.sp.encode("  ")][:1]
        self.known: dict[str, int] = {}
        self.lists: tuple[list[list[int]], list[list[int]]] = ([], [])

    def b(self, chunk: str) -> list[int]:
        """Ids of space + ``chunk``, which may be empty."""
        return self.sp.encode(chunk) if chunk else [self.space]

    def of(self, chunks: list[str]) -> tuple[pa.ListArray, pa.ListArray]:
        """A's and B's ids of space + chunk for each chunk, encoding those not met before."""
        out: tuple[list, list] = ([], [])
        for c in chunks:
            i = self.known.get(c)
            if i is None:
                i = self.known[c] = len(self.lists[0])
                self.lists[0].append(np.array(self.a(" " + c), np.int32))
                self.lists[1].append(np.array(self.b(c), np.int32))
            out[0].append(self.lists[0][i])
            out[1].append(self.lists[1][i])
        if len(self.known) > REMEMBERED:
            self.known, self.lists = {}, ([], [])
        return lists_of(out[0]), lists_of(out[1])


def piece_bytes(piece: str) -> bytes:
    hexed = re.fullmatch(r"<0x([0-9A-Fa-f]{2})>", piece)
    return bytes([int(hexed[1], 16)]) if hexed else piece.replace("▁", " ").encode()


def table_of(by_id: dict[int, bytes]) -> pa.BinaryArray:
    return pa.array([by_id.get(i, b"") for i in range(max(by_id) + 1)], pa.binary())


def lists_of(ids: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, ids)], dtype=np.int64)
    return pa.LargeListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids) if ids else np.empty(0, np.int32), pa.int32()))


_ODD = re.compile(r"\s ")
_CUT = re.compile(r"(?<=\S) ")


def chunks_of(text: str) -> list[str]:
    """``text`` without the single spaces at which it is cut: those after a character that is no white space."""
    return _CUT.split(text) if text[0] == " " or _ODD.search(text) else text.split(" ")


def tokens(v: Vocabularies, texts: list[str]) -> tuple[pa.Table, pa.Table]:
    """doc and id of each token of A and of B, in order."""
    chunks = pa.array([chunks_of(t) if v.by_chunk else [t] for t in texts], pa.list_(pa.large_string()))
    words, doc = pc.list_flatten(chunks).dictionary_encode(), pc.list_parent_indices(chunks)
    out = []
    for lists in v.of(words.dictionary.to_pylist()):
        mine = lists.take(words.indices)
        out.append(pa.table({"doc": doc.take(pc.list_parent_indices(mine)), "id": pc.list_flatten(mine)}))
    return out[0], out[1]


def with_ends(rows: pa.Table, names: pa.BinaryArray, n: int) -> tuple[pa.Table, list[bytes]]:
    """``rows`` with each token's end in its document (segmented cumulative sums), and each document's bytes."""
    raw = pc.take(names, rows["id"].combine_chunks())
    doc = rows["doc"].to_numpy()
    ends = pc.cumulative_sum(pc.cast(pc.binary_length(raw), pa.int64())).to_numpy(zero_copy_only=False)
    last = np.searchsorted(doc, np.arange(n), "right")
    totals = np.concatenate([[0], ends])[last]
    starts = np.concatenate([[0], totals[:-1]])
    whole = b"".join(raw.to_pylist()) if len(raw) and raw.offset else bytes(raw.buffers()[2] or b"")[: int(totals[-1]) if n else 0]
    return rows.append_column("end", pa.array(ends - starts[doc])), [whole[s:e] for s, e in zip(starts.tolist(), totals.tolist(), strict=True)]


def only(rows: pa.Table, good: np.ndarray) -> pa.Table:
    return rows.filter(pa.array(good[rows["doc"].to_numpy()]))


def links_of(a: pa.Table, b: pa.Table) -> pa.Table:
    """doc, a, b and last (whether both end there) of each link, in order: the hash join on (doc, end), ids filled backwards."""
    key = lambda t, name: pa.table({"key": pc.add(pc.shift_left(pc.cast(t["doc"], pa.int64()), pa.scalar(END_BITS, pa.int64())), t["end"]), name: t["id"]})
    met = key(a, "a").join(key(b, "b"), "key", join_type="full outer", use_threads=False).sort_by("key")
    last = pc.and_(pc.is_valid(met["a"]), pc.is_valid(met["b"]))
    doc = pc.cast(pc.shift_right(met["key"], pa.scalar(END_BITS, pa.int64())), pa.int32())
    ends_a, ends_b = pc.is_valid(met["a"]), pc.is_valid(met["b"])
    return pa.table({"doc": doc, "a": pc.fill_null_backward(met["a"]), "b": pc.fill_null_backward(met["b"]), "last": last, "ends_a": ends_a, "ends_b": ends_b})


class Printer:
    """Decimal ids with what follows them, as one binary array to take from: id, then id + n, of two separators."""

    def __init__(self, n: int, inner: str, outer: str):
        self.n = n
        self.said = pa.array([f"{i}{sep}".encode() for sep in (inner, outer) for i in range(n)], pa.large_binary())


def groups_hashes(links: pa.Table, n: int, prints: tuple[Printer, Printer]) -> list[str]:
    """SHA-256 of each document's ``a1,a2|b1;a3|b2,b3``."""
    if not links.num_rows:
        return [""] * n
    doc, last = links["doc"].to_numpy(), links["last"].to_numpy()
    group = np.cumsum(last) - last
    out_key, out_at, said = [], [], []
    for side, name in enumerate("ab"):
        at = np.flatnonzero(links[f"ends_{name}"].to_numpy())
        ids = links[name].to_numpy()[at].astype(np.int64)
        closes = np.append(group[at][1:] != group[at][:-1], True)  # the group's last token of this side
        out_key.append(group[at] * 2 + side)
        out_at.append(doc[at])
        said.append((ids + closes * prints[side].n) + side * 2 * prints[0].n)
    order = np.argsort(np.concatenate(out_key), kind="stable")
    both = pa.chunked_array([prints[0].said, prints[1].said]).combine_chunks()
    text = both.take(pa.array(np.concatenate(said)[order]))
    owner = np.concatenate(out_at)[order]
    ends = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    whole = memoryview(text.buffers()[2])
    first, last_at = np.searchsorted(owner, np.arange(n)), np.searchsorted(owner, np.arange(n), "right")
    return [hashlib.sha256(whole[s : e - 1]).hexdigest() if e > s else "" for s, e in zip(ends[first].tolist(), ends[last_at].tolist(), strict=True)]


_READY: dict[int, tuple[Vocabularies, tuple[Printer, Printer]]] = {}
KINDS = "batch string, doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links array<int>, pair int, code long, n long"


def aligned(texts: list[str | None], v: Vocabularies, prints: tuple[Printer, Printer]) -> tuple[dict[str, pa.Array], pa.Array, pa.Table]:
    """Of a batch: the documents' own figures, their links as lists of pair numbers, and pair, code (A id, B id) and n of its pairs."""
    plain = [t or "" for t in texts]
    some = np.array([bool(t) for t in plain])
    a, b = tokens(v, [t or " " for t in plain])
    n = len(plain)
    (a, of_a), (b, of_b) = with_ends(a, v.bytes_a, n), with_ends(b, v.bytes_b, n)
    want = [b" " + t.encode("utf-8", "surrogatepass") for t in plain]
    good = some & np.array([x == w and y == w for x, y, w in zip(of_a, of_b, want, strict=True)], bool)
    a, b = only(a, good), only(b, good)
    links = links_of(a, b)
    per = lambda column, weights=None: pa.array(np.bincount(column.to_numpy(), weights=weights, minlength=n).astype(np.int64))
    figures = {"n_a": per(a["doc"]), "n_b": per(b["doc"]), "n_groups": per(links["doc"], links["last"].to_numpy().astype(float)), "n_links": per(links["doc"])}
    figures["groups_sha256"] = pa.array(groups_hashes(links, n, prints), pa.string())
    code = pc.add(pc.shift_left(pc.cast(links["a"], pa.int64()), pa.scalar(B_BITS, pa.int64())), pc.cast(links["b"], pa.int64()))
    coded = code.combine_chunks().dictionary_encode()
    counts = pa.table({"pair": coded.indices}).group_by("pair", use_threads=False).aggregate([("pair", "count")])
    pairs = pa.table({"pair": counts["pair"], "code": coded.dictionary.take(counts["pair"].combine_chunks()), "n": counts["pair_count"]})
    ends = np.concatenate([[0], np.cumsum(figures["n_links"].to_numpy())])
    return figures, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), coded.indices), pairs


def encoded(docs: DataFrame, spec: str, model: str, id_col: str, text_col: str) -> DataFrame:
    """Rows of documents and rows of pairs, with the batch they are of (``KINDS``)."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast((open(spec, encoding="utf-8").read(), open(model, "rb").read()))
    kind = dict(docs.dtypes)[id_col]

    def batches(given: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[str | None]]]:
        for batch in given:
            texts, begin, size = batch.column(1), 0, 0
            lengths = pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False)
            for i, length in enumerate(lengths):
                if size and size + length > CHARS:
                    yield batch.column(0)[begin:i], texts[begin:i].to_pylist()
                    begin, size = i, 0
                size += int(length)
            if batch.num_rows:
                yield batch.column(0)[begin:], texts[begin:].to_pylist()

    def run(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = hash(sent.value)
        if key not in _READY:
            v = Vocabularies(*sent.value)
            _READY[key] = (v, (Printer(len(v.bytes_a), ",", "|"), Printer(len(v.bytes_b), ",", ";")))
        v, prints = _READY[key]
        schema, task = None, TaskContext.get()
        for number, (ids, texts) in enumerate(batches(given)):
            figures, links, pairs = aligned(texts, v, prints)
            batch = f"{task.partitionId()}-{number}"
            schema = schema or pa.schema([("batch", pa.string()), ("doc_id", ids.type), *[(c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")], ("groups_sha256", pa.string()), ("links", pa.list_(pa.int32())), ("pair", pa.int32()), ("code", pa.int64()), ("n", pa.int64())])
            for have in ({"doc_id": ids, "links": links, **figures}, {c: pairs[c].combine_chunks() for c in pairs.column_names}):
                rows = len(next(iter(have.values())))
                yield from pa.table([have.get(f.name, pa.nulls(rows, f.type)) if f.name != "batch" else pa.array([batch] * rows, pa.string()) for f in schema], schema).to_batches()

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, KINDS.format(kind=kind))


def align(docs: DataFrame, spec: str, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id_col, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    spark, path = docs.sparkSession, scratch(docs.sparkSession, "aligned")
    rows = encoded(docs, spec, model, id_col, text_col)
    with small_batches(spark):
        rows.write.option("compression", "zstd").parquet(path)
    rows = spark.read.schema(rows.schema).parquet(path)
    pairs = rows.where("code IS NOT NULL").select("batch", "pair", "code", "n")
    total = pairs.groupBy("code").agg(F.sum("n").alias("total"))
    best = total.groupBy((F.col("code") % (1 << B_BITS)).alias("b")).agg(F.max("total").alias("best"))
    judged = total.join(best, total["code"] % (1 << B_BITS) == best["b"]).select("code", "total", (F.col("total") == F.col("best")).alias("is_best"))
    back = pairs.select("batch", "pair", "code").join(judged, "code").select("batch", "pair", "total", "is_best")
    own = rows.where("code IS NULL").select("batch", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links")
    kind = dict(docs.dtypes)[id_col]

    def summed(mine: pa.Table, figures: pa.Table) -> pa.Table:
        """Counts of a batch's pairs summed for each of its documents."""
        lists = mine["links"].combine_chunks()
        pair, doc = pc.list_flatten(lists).to_numpy(zero_copy_only=False), pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
        count, good = np.zeros(figures.num_rows, np.int64), np.zeros(figures.num_rows, bool)
        at = figures["pair"].to_numpy()
        count[at], good[at] = figures["total"].to_numpy(), figures["is_best"].to_numpy()
        out = {}
        for name, each in (("n_best", good.astype(np.int64)), ("count_sum", count)):
            ends = np.concatenate([[0], np.cumsum(each[pair])])
            last = np.searchsorted(doc, np.arange(mine.num_rows), "right")
            out[name] = pa.array(np.diff(np.concatenate([[0], ends[last]])))
        return pa.table({"doc_id": mine["doc_id"], **{c: mine[c] for c in ("n_a", "n_b", "n_groups", "n_links")}, **out, "groups_sha256": mine["groups_sha256"]})

    p = partitions(spark)
    theirs = back.withColumnRenamed("batch", "of")
    out = own.repartition(p, "batch").groupBy("batch").cogroup(theirs.repartition(p, "of").groupBy("of")).applyInArrow(summed, f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
    return out.withColumnRenamed("doc_id", id_col)
