"""Hard negatives by coordinate pruning over length buckets.

Rows are integer vectors with a label; anchors are a stated part of them. Scores are inner products, which come out as
exact integers.

1. Rows are sorted by length and cut into buckets of at most ``ROWS``. A bucket has its vectors, its greatest length and,
   for each coordinate, the list of its rows sorted by that coordinate of their direction.
2. Anchors are cut into blocks of at most ``ANCHORS``. Blocks of anchors and buckets meet in cells of bounded size, once
   each: a stated set of queries against all rows, in blocks.
3. In a cell, buckets go from the longest vectors to the shortest. A partner that is still wanted must score t at least
   (its place's running value, or the lower end of the window): so its cosine is at least t / (|anchor| x greatest length
   of the bucket). If that is above 1 the bucket is passed over. Else each of the anchor's ``FOCUS`` largest coordinates
   confines the same coordinate of the partner's direction to a range, which is an interval of the sorted list; rows that
   are in all of the intervals are verified by their exact products. Where the narrowest interval still holds more than
   half of the bucket, the whole bucket is verified by one matrix product.
4. A cell sends the best partners it has found for each anchor and window; their best over all cells are the result.

Two searches of this kind make hard negatives: the best rows of the anchor's label (in buckets of that label only), then,
for the window that each positive's score opens, the best rows of other labels.

Results for odd input: rows without id or label, with a null vector or a null or non-finite component take no part; of
rows that repeat an id, that with the greatest (label, vector) counts; vectors of different lengths meet as if padded
with zeros; components and scores saturate at 64 bits; ties go to the lesser id; a positive without a row in its window
(always so below a score of 0) gives no row; equal vectors and zero vectors are rows like any other; an empty table gives
an empty result. The result has columns of its own; other columns of the input, whatever their names, are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leverframe.llm.common import cut, drop, join_grouped, partitions

#: Rows of a bucket, anchors of a block, focus coordinates of an anchor, and most buckets or blocks on a side of a cell.
ROWS, ANCHORS, FOCUS, SIDE = 2048, 512, 4, 16
#: Greatest size of a score for which doubles, and numbers made of a score and a place in a bucket, are exact.
EXACT = 1 << 50
#: The score of no partner: one more than the least long, so that its negative is a long too.
LEAST = np.iinfo(np.int64).min + 1


def quantised(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component as a long; null for a null vector or one with a null or non-finite component."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.when(vector.isNotNull() & ~bad, F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))))


def usable(rows: DataFrame) -> DataFrame:
    """id, label, v, len of the rows that take part, one for each id. ``rows``: id, label, v (longs)."""
    one = rows.where("id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL").groupBy("id").agg(F.max(F.struct("label", "v")).alias("r")).select("id", "r.*")
    return one.withColumn("len", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))))


PACKED = "grp long, number string, n int, longest double, ids binary, labels binary, lows binary, highs binary, vectors binary, width int"


def matrix(vectors: pd.Series) -> np.ndarray:
    """A column of arrays as rows of longs, padded with zeros."""
    width = max(1, max(map(len, vectors)))
    if min(map(len, vectors)) == width:
        return np.stack(vectors.to_numpy()).astype(np.int64)
    out = np.zeros((len(vectors), width), np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def packed(rows: DataFrame, size: int) -> DataFrame:
    """``rows`` (grp, id, label, v, len and, of anchors, wins: windows as array<struct<low, high>>) as one row for each ``size`` of a group, sorted by length."""
    windows = "wins" in rows.columns

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, k = TaskContext.get().partitionId(), 0
        for frame in frames:
            for group, mine in frame.groupby("grp", sort=False):
                for begin in range(0, len(mine), size):
                    part = mine.iloc[begin : begin + size].sort_values("id")
                    vectors = matrix(part["v"])
                    low, high = (np.array([[w[e] for w in ws] for ws in part["wins"]], np.int64) if windows else np.empty((0, 0)) for e in ("low", "high"))
                    yield pd.DataFrame({
                        "grp": [group], "number": f"{task}-{k}", "n": len(part), "longest": part["len"].max(), "ids": [part["id"].to_numpy("int64").tobytes()], "labels": [part["label"].to_numpy("int64").tobytes()],
                        "lows": [low.tobytes()], "highs": [high.tobytes()], "vectors": [vectors.tobytes()], "width": vectors.shape[1],
                    })
                    k += 1

    p = partitions(rows.sparkSession)
    return rows.repartitionByRange(p, "grp", F.desc("len"), "id").sortWithinPartitions("grp", F.desc("len"), "id").mapInPandas(run, PACKED)


class Side:
    """A packed block: ids, labels, vectors and, of anchors, windows."""

    def __init__(self, row):
        self.ids, self.labels = (np.frombuffer(x, np.int64) for x in (row.ids, row.labels))
        self.v = np.frombuffer(row.vectors, np.int64).reshape(row.n, row.width)
        self.low, self.high = (np.frombuffer(x, np.int64).reshape(row.n, -1) for x in (row.lows, row.highs))
        self.longest, self.most = row.longest, int(np.abs(self.v.astype(float)).max())
        self.real = self.v.astype(float)
        self.lengths = np.sqrt((self.real * self.real).sum(axis=1))
        self.direction = self.real / np.maximum(self.lengths, 1e-300)[:, None]

    def lists(self) -> None:
        """The sorted coordinate lists: for each coordinate the rows in order, the values in order, and each row's place."""
        self.order = np.argsort(self.direction, axis=0, kind="stable").T.copy()
        self.sorted = np.take_along_axis(self.direction.T, self.order, axis=1)
        self.place = np.empty_like(self.order)
        np.put_along_axis(self.place, self.order, np.arange(len(self.ids))[None, :].repeat(len(self.order), 0), axis=1)


def products(a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Exact inner products of the rows of ``a`` and ``b`` (longs); ``most`` bounds their size."""
    d = min(a.shape[1], b.shape[1])
    if most < EXACT:
        return (a[:, :d].astype(float) @ b[:, :d].T.astype(float)).astype(np.int64)
    whole = a[:, :d].astype(object) @ b[:, :d].T.astype(object)
    return np.clip(whole, LEAST + 1, np.iinfo(np.int64).max).astype(np.int64)


def intervals(anchors: Side, bucket: Side, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Which anchors can find a score of ``least`` in the bucket at all, and their focus coordinates with the feasible intervals of these lists."""
    bound = least / np.maximum(anchors.lengths * bucket.longest, 1e-300)
    alive = np.flatnonzero((bound <= 1 + 1e-9) | (least <= 0))
    d = min(anchors.v.shape[1], bucket.v.shape[1])
    k = min(FOCUS, d)
    focus = np.argsort(-np.abs(anchors.direction[alive, :d]), axis=1, kind="stable")[:, :k]
    q = np.take_along_axis(anchors.direction[alive, :d], focus, axis=1)
    t = np.clip(bound[alive], 0, 1)[:, None]
    off = np.sqrt((1 - t * t) * np.maximum(0, 1 - q * q))
    low = np.where((q <= -t) | (t <= 0), -2, q * t - off - 1e-6)
    high = np.where((q >= t) | (t <= 0), 2, q * t + off + 1e-6)
    first, last = np.zeros(focus.shape, np.int64), np.full(focus.shape, len(bucket.ids))
    for f in np.unique(focus):
        i, j = np.nonzero(focus == f)
        first[i, j] = np.searchsorted(bucket.sorted[f], low[i, j], "left")
        last[i, j] = np.searchsorted(bucket.sorted[f], high[i, j], "right")
    return alive, focus, first, last


class Best:
    """The ``k`` best partners so far of each anchor in each of its windows."""

    def __init__(self, anchors: Side, k: int, windows: int):
        self.k = k
        self.score = np.full((windows, len(anchors.ids), k), LEAST)
        self.id = np.zeros((windows, len(anchors.ids), k), np.int64)

    def least(self, anchors: Side) -> np.ndarray:
        """What a partner must score to be wanted in any window."""
        worst = self.score[:, :, -1].T.astype(float)
        return (np.maximum(worst, anchors.low) if anchors.low.size else worst).min(axis=1)

    def take(self, window: int, at: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """Merges partners of the anchors ``at`` (rows of ``score`` and ``ids``; LEAST: none)."""
        score, ids = np.concatenate([self.score[window, at], score], axis=1), np.concatenate([self.id[window, at], ids], axis=1)
        order = np.lexsort((ids, -score), axis=1)[:, : self.k]
        self.score[window, at], self.id[window, at] = np.take_along_axis(score, order, 1), np.take_along_axis(ids, order, 1)


def offer(best: Best, anchors: Side, at: np.ndarray, score: np.ndarray, bucket: Side, columns: np.ndarray, same: bool) -> None:
    """Scores of the anchors ``at`` with the bucket's rows ``columns``, of which the best go to each window. Rows of a bucket are in order of id."""
    equal = anchors.labels[at][:, None] == bucket.labels[columns][None, :]
    fits = equal & (anchors.ids[at][:, None] != bucket.ids[columns][None, :]) if same else ~equal
    k = min(best.k, len(columns))
    for w in range(len(best.score)):
        mine = fits & (score >= anchors.low[at, w][:, None]) & (score <= anchors.high[at, w][:, None]) if anchors.low.size else fits
        mine = mine & (score >= best.score[w, at, -1][:, None])
        rows = np.flatnonzero(mine.any(axis=1))
        if not len(rows):
            continue
        sub = np.where(mine[rows], score[rows], LEAST)
        if len(columns) > k:  # the k-th score cuts what is sorted; of its ties those with the least ids stay
            kth = -np.partition(-np.maximum(sub, LEAST + 1), k - 1, axis=1)[:, k - 1]
            above = sub > kth[:, None]
            tie = (sub == kth[:, None]) & mine[rows]
            tie &= np.cumsum(tie, axis=1) <= (k - above.sum(axis=1))[:, None]
            keep = above | tie
            width = int(keep.sum(axis=1).max())
            found = np.argsort(~keep, axis=1, kind="stable")[:, :width]
            there = np.take_along_axis(keep, found, 1)
            best.take(w, at[rows], np.where(there, np.take_along_axis(sub, found, 1), LEAST), np.where(there, bucket.ids[columns][found], 0))
        else:
            best.take(w, at[rows], sub, np.broadcast_to(bucket.ids[columns], sub.shape))


def probe(anchors: Side, bucket: Side, best: Best, same: bool) -> tuple[int, int]:
    """One block of anchors through one bucket; how many products were made, of how many."""
    alive, focus, first, last = intervals(anchors, bucket, best.least(anchors))
    if not len(alive):
        return 0, len(anchors.ids) * len(bucket.ids)
    n, most = len(bucket.ids), anchors.most * bucket.most * min(anchors.v.shape[1], bucket.v.shape[1])
    narrow = (last - first).min(axis=1)
    whole = narrow > n // 2
    made, everything = 0, np.arange(n)
    if whole.any():
        at = alive[whole]
        offer(best, anchors, at, products(anchors.v[at], bucket.v, most), bucket, everything, same)
        made += len(at) * n
    for i in np.flatnonzero(~whole):
        f = np.argsort(last[i] - first[i])
        cand = bucket.order[focus[i, f[0]], first[i, f[0]] : last[i, f[0]]]
        for j in f[1:]:
            place = bucket.place[focus[i, j], cand]
            cand = cand[(place >= first[i, j]) & (place < last[i, j])]
        if len(cand):
            cand, at = np.sort(cand), alive[i : i + 1]
            offer(best, anchors, at, products(anchors.v[at], bucket.v[cand], most), bucket, cand, same)
            made += len(cand)
    return made, len(anchors.ids) * n


def met(buckets: DataFrame, blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Buckets and blocks of anchors, each once for every cell (grp, r, c) of its group's grid that it is in.

    A cell has about SIDE of either; where there are buckets enough, there are at least as many cells as partitions.
    """
    p = partitions(buckets.sparkSession)
    count = lambda side, name: side.groupBy("grp").agg(F.count(F.lit(1)).alias(name))
    rows = F.ceil(F.col("n_blocks") / SIDE).cast("int").alias("rows")
    columns = F.greatest(F.ceil(F.col("n_buckets") / SIDE), F.least(F.lit(p), "n_buckets")).cast("int").alias("columns")
    grid = cut(count(buckets, "n_buckets").join(count(blocks, "n_blocks"), "grp").select("grp", "n_buckets", "n_blocks", rows, columns))

    def placed(side: DataFrame, size: str, own: str, own_n: str, other: str, other_n: str) -> DataFrame:
        out = join_grouped(side, grid, "grp", size, side.count()).where("rows IS NOT NULL")
        out = out.withColumn(own, F.pmod(F.xxhash64("number"), F.col(own_n)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.col(other_n) - 1)))
        return out.select(*side.columns, "r", "c").repartition(p, "grp", "r", "c").groupBy("grp", "r", "c")

    return placed(buckets, "n_buckets", "c", "columns", "r", "rows"), placed(blocks, "n_blocks", "r", "rows", "c", "columns")


def best_partners(anchors: DataFrame, rows: DataFrame, k: int, same: bool) -> DataFrame:
    """anchor_id, window, partner_id, score: the ``k`` best rows for each anchor and window.

    ``rows`` and ``anchors``: grp (only rows of an anchor's group are looked at), id, label, v, len; anchors may have wins,
    the windows (all of one number) that scores must lie in. Rows must have the anchor's label (``same``) or another.
    """
    kind = "anchor_id long, window int, partner_id long, score long"
    buckets, blocks = cut(packed(rows, ROWS)), cut(packed(anchors, ANCHORS))

    def run(mine: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(mine) and len(theirs):
            asked = [Side(a) for a in theirs.itertuples()]
            best = [Best(a, k, max(1, a.low.shape[1])) for a in asked]
            for row in mine.sort_values("longest", ascending=False).itertuples():
                bucket = Side(row)
                bucket.lists()
                for a, b in zip(asked, best, strict=True):
                    probe(a, bucket, b, same)
            for a, b in zip(asked, best, strict=True):
                w, i, j = np.nonzero(b.score > LEAST)
                out.append(pd.DataFrame({"anchor_id": a.ids[i], "window": w, "partner_id": b.id[w, i, j], "score": b.score[w, i, j]}))
        return pd.concat(out) if out else pd.DataFrame({c.split()[0]: [] for c in kind.split(", ")})

    left, right = met(buckets, blocks)
    found = left.cogroup(right).applyInPandas(run, kind)
    top = found.groupBy("anchor_id", "window").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "partner_id"))), 1, k).alias("t"))
    return top.select("anchor_id", "window", F.explode("t").alias("t")).select("anchor_id", "window", F.col("t.partner_id").alias("partner_id"), (-F.col("t.s")).alias("score"))


def mine(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, low_pct: int = 50, high_pct: int = 95) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``rows``: id, label, v (array of longs). An anchor's positives are its best other rows of the same label; for each, its
    negatives are the best rows of other labels with low_pct % to high_pct % of the positive's score.
    """
    whole = cut(usable(rows.select("id", "label", "v")))
    anchors = cut(whole.where(is_anchor))
    by_label = F.col("label").cast("long").alias("grp")
    pos = cut(best_partners(anchors.select(by_label, "*"), whole.select(by_label, "*"), positives, True).select("anchor_id", F.col("partner_id").alias("positive_id"), F.col("score").alias("positive_score")))
    # The window low_pct * p <= 100 * n <= high_pct * p in whole numbers; lists of windows are filled up to one length with empty ones.
    low, high = (F.expr(f"positive_score div 100 * {pct} + (positive_score % 100 * {pct} + {up}) div 100") for pct, up in ((low_pct, 99), (high_pct, 0)))
    window = pos.where("positive_score >= 0").select("anchor_id", "positive_score", F.struct(low.alias("low"), high.alias("high")).alias("w")).dropDuplicates(["anchor_id", "positive_score"])
    lists = cut(window.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("positive_score", "w"))).alias("ws")))
    most = F.lit((1 << 63) - 1)
    none = F.struct(most.alias("low"), F.lit(0).cast("long").alias("high"))
    wins = F.concat(F.transform("ws", lambda x: x["w"]), F.array_repeat(none, F.lit(positives) - F.size("ws"))).alias("wins")
    asked = anchors.join(lists.select(F.col("anchor_id").alias("id"), wins), "id").select(F.lit(0).cast("long").alias("grp"), "id", "label", "v", "len", "wins")
    found = cut(best_partners(asked, whole.select(F.lit(0).cast("long").alias("grp"), "*"), negatives, False))
    drop(whole, anchors)
    neg = found.groupBy("anchor_id", "window").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col("partner_id").alias("negative_id")))).alias("ns"))
    neg = neg.join(lists, "anchor_id").select("anchor_id", F.get("ws", F.col("window"))["positive_score"].alias("positive_score"), F.posexplode("ns").alias("i", "x"))
    out = pos.join(neg, ["anchor_id", "positive_score"])
    return out.select("anchor_id", "positive_id", (F.col("i") + 1).alias("rank"), F.col("x.negative_id").alias("negative_id"), "positive_score", (-F.col("x.s")).alias("negative_score"))
