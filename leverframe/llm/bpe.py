"""Byte-level BPE encoding and decoding by prefix-sharing trie traversal.

The encoder never merges pairs step by step. For the prefixes of a word it keeps the *last token* of the prefix's
encoding; the encoding of the prefix of length d is the encoding of the prefix of length d - len(last token), then that
token. A suffix token is the last token of a prefix exactly if BPE would keep the pair (last token before it, it)
apart, which the merge table decides without encoding anything. The distinct words of a batch go into a trie, whose
depth-first traversal carries these last-token states down, so that a prefix which many words share is computed once.
Which tokens end a prefix at all is a second state, the longest suffix that begins a token; its few steps and the tokens
that end it are remembered as they are met.

Special strings of the vocabulary (``added_tokens``) are cut out of a text first, as the tokenizers library does.

Results for odd input: null and empty texts have no token (``n_tokens`` 0, hash of the empty string); repeated rows
each get their row; any text length works, as a text is handled word by word; an empty table gives an empty result.
The results have columns of their own and the id; other columns of ``docs``, whatever their names, are not looked at.
"""

from __future__ import annotations

import gc
import hashlib
import json
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: How byte-level BPE cuts a text into words before merging.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Unicode's White_Space, which is what the pattern's ``\s`` means.
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte: Latin-1's visible ones stand for themselves, the rest follow from U+0100."""
    visible = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Specials:
    """The special strings of a tokenizers file, which are cut out of a text before anything else."""

    def __init__(self, data: dict):
        self.special = {t["content"]: t["id"] for t in data.get("added_tokens") or []}
        self.cut_special = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None

    def segments(self, text: str) -> Iterator[str | int]:
        """Ordinary text and the ids of special strings, in turn."""
        at = 0
        for m in self.cut_special.finditer(text) if self.cut_special else ():
            if m.start() > at:
                yield text[at : m.start()]
            yield self.special[m[0]]
            at = m.end()
        if at < len(text):
            yield text[at:]


class TrieEncoder(Specials):
    """Encodes and decodes texts for one vocabulary, given as the JSON text of a tokenizers file.

    ``max_words`` bounds what a worker process remembers: beyond so many chunks a new generation begins, which takes
    over what it needs from the one before; older ones are forgotten.
    """

    def __init__(self, spec: str, max_words: int = 250_000):
        data = json.loads(spec)
        super().__init__(data)
        model, alphabet = data["model"], byte_alphabet()
        raw = lambda token: bytes(alphabet[c] for c in token)
        vocab, pairs = model["vocab"], [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        rank_of = {c: i for i, c in enumerate(sorted(alphabet, key=lambda c: vocab[c]))}
        self.parts: list[tuple[int, int]] = [(i, i) for i in range(len(rank_of))]
        self.merged: dict[tuple[int, int], int] = {}
        names = sorted(rank_of, key=rank_of.get)
        for left, right in pairs:
            pair = (rank_of[left], rank_of[right])
            if left + right not in rank_of:
                rank_of[left + right] = len(names)
                names.append(left + right)
                self.parts.append(pair)
            self.merged.setdefault(pair, rank_of[left + right])
        self.id_of = [vocab[name] for name in names]
        self.bytes_of = [raw(name) for name in names]
        self.rank_of = {b: i for i, b in enumerate(self.bytes_of)}
        self.begins: set[bytes] = set()
        self.nodes: dict[bytes, tuple[bytes, dict[int, tuple], list[tuple[int, int]]]] = {}
        self.id_bytes = dict(zip(self.id_of, self.bytes_of, strict=True))
        self.id_bytes |= {i: s.encode() for s, i in self.special.items()}
        self.decimal = {i: str(i) for i in self.id_bytes}
        self.find_words = regex.compile(WORD_PATTERN.replace(r"[^\s", f"[^{WHITE}").replace(r"\s", f"[{WHITE}]").replace(r"\S", f"[^{WHITE}]")).findall
        self.apart_memo: dict[tuple[int, int], bool] = {}
        self.whole_memo: dict[int, bool] = {}
        self.max_words, self.cache, self.older = max_words, {}, {}

    def apart(self, a: int, b: int) -> bool:
        """Whether BPE leaves neighbours a, b unmerged: undo their merges from the latest on, looking for an earlier merge across the border."""
        key = (a, b)
        known = self.apart_memo.get(key)
        if known is not None:
            return known
        limit, parts, merged = len(self.parts), self.parts, self.merged
        while True:
            if merged.get((a, b), limit) < limit:
                out = False
                break
            if a > b:
                limit, (left, right) = a, parts[a]
                a = right
                if left == right == limit:
                    limit, (b2, _) = b + 1, parts[b]
                    if b2 == b:
                        out = True
                        break
                    b = b2
            else:
                limit, (b2, _) = b + 1, parts[b]
                if b2 == b:
                    limit, (left, right) = a, parts[a]
                    if left == right == a:
                        out = True
                        break
                    a = right
                else:
                    b = b2
        if len(self.apart_memo) >= 1_000_000:
            self.apart_memo.clear()
        self.apart_memo[key] = out
        return out

    def whole(self, token: int) -> bool:
        """Whether a token's own bytes encode to it alone."""
        known = self.whole_memo.get(token)
        if known is None:
            seq = [self.rank_of[bytes([b])] for b in self.bytes_of[token]]
            while len(seq) > 1:
                best = min(((self.merged[p], i) for i, p in enumerate(zip(seq, seq[1:], strict=False)) if p in self.merged), default=None)
                if best is None:
                    break
                seq[best[1] : best[1] + 2] = [best[0]]
            known = self.whole_memo[token] = seq == [token]
        return known

    def node(self, suffix: bytes) -> tuple[bytes, dict[int, tuple], list[tuple[int, int]]]:
        """A suffix that begins a token, the steps on from it, and the tokens that end it, longest first, each with its length."""
        if suffix not in self.nodes:
            n = len(suffix)
            ends = [(n - i, self.rank_of[suffix[i:]]) for i in range(n) if suffix[i:] in self.rank_of]
            self.nodes[suffix] = (suffix, {}, ends)
        return self.nodes[suffix]

    def step(self, node: tuple[bytes, dict[int, tuple], list[tuple[int, int]]], byte: int) -> tuple:
        """The node after one more byte."""
        suffix = node[0] + bytes([byte])
        while suffix not in self.begins:
            suffix = suffix[1:]
        node[1][byte] = out = self.node(suffix)
        return out

    def encode_words(self, words: set[str]) -> dict[str, list[int]]:
        """The ids of distinct words: one depth-first traversal of their trie.

        The trie lies in the sorted list of the words, whose order is the depth-first one; ``states`` is the path from
        the root: states[d] is the last token of the first d bytes, nodes[d] the node of their longest suffix that begins a
        token. Going to the next word pops what the two don't share.
        """
        if not self.begins:
            self.begins = {b[:i] for b in self.bytes_of for i in range(1, len(b) + 1)}
        memo, id_of, bytes_of = self.apart_memo.get, self.id_of, self.bytes_of
        out: dict[str, list[int]] = {}
        states, nodes, last, token = [-1], [self.node(b"")], b"", -1
        for word in sorted(words, key=str.encode):
            path = word.encode()
            shared, n = 0, min(len(last), len(path))
            while shared < n and last[shared] == path[shared]:
                shared += 1
            del states[shared + 1 :], nodes[shared + 1 :]
            node = nodes[-1]
            for d in range(shared + 1, len(path) + 1):
                node = node[1].get(path[d - 1]) or self.step(node, path[d - 1])
                for size, token in node[2]:
                    if size == d:
                        fits = self.whole(token)
                    else:
                        fits = memo((states[d - size], token))
                        if fits is None:
                            fits = self.apart(states[d - size], token)
                    if fits:
                        break
                states.append(token)
                nodes.append(node)
            ids, d = [], len(path)
            while d:
                ids.append(id_of[states[d]])
                d -= len(bytes_of[states[d]])
            ids.reverse()
            out[word] = ids
            last = path
        return out

    def chunks(self, text: str) -> list[str]:
        """``text`` cut where no word of the pattern crosses: before each single space and around each single line end."""
        plain = text.count(" ") + text.count("\n") + sum(map(len, text.split())) == len(text)
        if not plain or text[0] in " \n" or text[-1] in " \n" or any(x in text for x in ("  ", " \n", "\n ", "\n\n")):
            return self.find_words(text)
        out: list[str] = []
        for i, line in enumerate(text.split("\n")):
            if i:
                out.append("\n")
            first, *rest = line.split(" ")
            out.append(first)
            out += [" " + x for x in rest]
        return out

    def words(self, chunk: str) -> list[str]:
        """The pattern's words of a chunk; the two commonest shapes need no pattern."""
        body = chunk[1:] if chunk[:1] == " " else chunk
        if body.isalpha():
            return [chunk]
        if body[:-1].isalpha() and body[-1] in ".,":
            return [chunk[:-1], chunk[-1]]
        return self.find_words(chunk)

    def texts(self, texts: list[str], pack) -> list[list]:
        """For each text its chunks' packed ids, in order; ``pack`` turns the ids of a chunk into what is remembered of it."""
        cut = [[s if isinstance(s, int) else self.chunks(s) for s in self.segments(t or "")] for t in texts]
        seen = set()
        for t in cut:
            for s in t:
                if not isinstance(s, int):
                    seen.update(s)
        if len(self.cache) > self.max_words:
            self.cache, self.older = {}, self.cache
        new = seen.difference(self.cache)
        if self.older:
            kept = new.intersection(self.older)
            self.cache.update(zip(kept, map(self.older.__getitem__, kept), strict=True))
            new -= kept
        if new:
            parts = {c: self.words(c) for c in new}
            ids = self.encode_words(set().union(*parts.values()))
            for c, p in parts.items():
                self.cache[c] = pack(ids[p[0]] if len(p) == 1 else [i for w in p for i in ids[w]])
        get = self.cache.__getitem__
        return [[x for s in t for x in ([pack([s])] if isinstance(s, int) else map(get, s))] for t in cut]

    def encode(self, text: str) -> list[int]:
        return [i for part in TrieEncoder.texts(self, [text], list)[0] for i in part]

    def decode(self, ids: list[int]) -> str:
        """The text of ``ids``; bytes that are not UTF-8 become U+FFFD; ids outside the vocabulary have no bytes."""
        return b"".join(self.id_bytes.get(i, b"") for i in ids).decode("utf-8", "replace")


_ENCODERS: dict[tuple[int, str], TrieEncoder] = {}


def encoder(spec: str, use: str) -> TrieEncoder:
    """This process's encoder for a vocabulary; one for each ``use``, as each remembers another packed form."""
    key = (hash(spec), use)
    if key not in _ENCODERS:
        _ENCODERS[key] = TrieEncoder(spec)
    return _ENCODERS[key]


def batches(text: pa.Array, chars: int = 2_000_000) -> Iterator[list[str]]:
    """Slices of a column of about ``chars`` characters, so that a worker never holds the words of many long texts."""
    out, n = [], 0
    for t in text:
        out.append(t.as_py() or "")
        n += len(out[-1])
        if n >= chars:
            yield out
            out, n = [], 0
    if out:
        yield out


@contextmanager
def uncollected() -> Iterator[None]:
    """Without Python's collector of reference cycles, which would go through the remembered chunks again and again; encoding makes no cycles."""
    on = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if on:
            gc.enable()


def digest(enc: TrieEncoder, texts: list[str]) -> tuple[list[int], list[str], list[str]]:
    """Of each text the number of its ids, the hash of these in decimal, joined by commas, and the hash of the text that they decode to."""
    number, raw_of = enc.decimal, enc.id_bytes
    pack = lambda ids: (",".join([number[i] for i in ids]), b"".join([raw_of[i] for i in ids]))
    counts, ids, decoded = [], [], []
    with uncollected():
        for parts in enc.texts(texts, pack):
            said, raw = zip(*parts, strict=True) if parts else ((), ())
            line = ",".join(filter(None, said))
            counts.append(line.count(",") + 1 if line else 0)
            ids.append(hashlib.sha256(line.encode()).hexdigest())
            decoded.append(hashlib.sha256(b"".join(raw).decode("utf-8", "replace").encode()).hexdigest())
    return counts, ids, decoded


def encode_decode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's id, its token ids and the text that these decode to (columns id_col, ids, decoded)."""
    spec = docs.sparkSession.sparkContext.broadcast(open(vocabulary, encoding="utf-8").read())

    def run(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(spec.value, "list")
        for batch in given:
            at = 0
            for texts in batches(batch.column(1)):
                with uncollected():
                    ids = [[i for part in parts for i in part] for parts in enc.texts(texts, list)]
                own = batch.column(0).slice(at, len(texts))
                yield pa.RecordBatch.from_arrays([own, pa.array(ids, pa.list_(pa.int32())), pa.array([enc.decode(x) for x in ids], pa.string())], ["k", "ids", "decoded"])
                at += len(texts)

    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col).alias("k"), F.col(text_col).alias("t")).mapInArrow(run, f"k {kind}, ids array<int>, decoded string").withColumnRenamed("k", id_col)


def digests(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """n_tokens, ids_sha256 (of the decimal ids, joined by commas) and decoded_sha256 of each row.

    The same encoder as ``encode_decode``; a chunk is remembered as its decimal ids and decoded from these once, so
    that token lists never leave the worker.
    """
    spec = docs.sparkSession.sparkContext.broadcast(open(vocabulary, encoding="utf-8").read())

    def run(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(spec.value, "digest")
        for batch in given:
            rows: tuple[list, list, list] = ([], [], [])
            for texts in batches(batch.column(1)):
                for all_rows, own in zip(rows, digest(enc, texts), strict=True):
                    all_rows += own
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.string()), pa.array(rows[2], pa.string())], ["k", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col).alias("k"), F.col(text_col).alias("t")).mapInArrow(run, f"k {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("k", id_col)
