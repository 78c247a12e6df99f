"""Quality classifier: document evidence with hierarchical empirical Bayes over sites and paths.

Evidence. Words, word pairs and byte trigrams are hashed into ``DIMS`` features, weighted by log(1 + count) and brought
to unit length; a few measures of a text's shape (distinct words and lines, runs, word length, length) go beside them. A
logistic regression with ridge penalty, fitted by AdaGrad on at most ``labelled`` labelled ids (those with the least hash,
one row of each), gives each document a log likelihood ratio of good to bad. The features are worked out where the texts
lie; the fit is one task over that bounded sample.

Hierarchy. Grouped aggregation over all documents gives each host and each path below it the sum of its documents'
probabilities under the global prior. A host's rate is shrunk to the global one and a path's to its host's, with
strengths estimated by moments from how much the rates differ beyond chance; so sparse sites stay near the prior. A
document's posterior is its evidence with its path's shrunk rate as prior odds. It is kept from a half on.

``documents`` has no url: by default the column source stands in for the host and lang for the path, so a 'path' is a
source's documents in one language. Clean documents in a language with few rows at a bad source get a prior near that
source's.

Results for odd input: null and empty texts count as one text without n-grams; null hosts or paths form a group named
''; very long texts are read whole; without labels of both kinds the evidence is 0 and all are kept; of rows that repeat a
labelled id the one with the least text hash is learned from; a posterior of exactly a half is kept; repeated rows each
count and get a row; an empty table gives an empty result. ``classify`` has columns of its own only; ``keep`` keeps those of ``docs`` whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import pickle

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leverframe.llm.common import brought_back, cut, join_grouped, set_aside, small_batches
from leverframe.llm.near_dedup import GOLDEN, U, mix, word_hashes

LABELLED = 5_000
DIMS = 1 << 13
#: Passes over the rows: at least EPOCHS, and as many as make UPDATES steps.
EPOCHS, UPDATES, RATE, RIDGE = 3, 20_000, 0.3, 1e-4


def shape(text: str) -> list[float]:
    """Shares of distinct words, of runs and of distinct lines, mean word length and log length, each about 0 to 1."""
    words, lines = text.split(), [x for x in text.split("\n") if x]
    k = max(1, len(words))
    runs = sum(map(str.__eq__, words, words[1:])) / k
    return [len(set(words)) / k, runs, len(set(lines)) / max(1, len(lines)), min(20.0, len(text) / k) / 20, np.log1p(len(words)) / 10]


SHAPE = len(shape(""))


def features(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text its feature numbers and weights: hashed n-grams from 0, shape from DIMS, a constant last."""
    words, at = word_hashes(texts)
    pairs = mix(words[:-1] * GOLDEN + words[1:])
    bits = U(64 - DIMS.bit_length() + 1)
    out = []
    for text, a, b in zip(texts, at[:-1], at[1:], strict=True):
        raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8).astype(U)
        threes = mix((raw[:-2] << U(16) | raw[1:-1] << U(8) | raw[2:]) * GOLDEN + U(1)) if len(raw) > 2 else raw[:0]
        grams = np.concatenate([mix(words[a:b]), pairs[a : max(a, b - 1)], threes]) >> bits
        counts = np.bincount(grams.astype(np.int64), minlength=DIMS)
        found = np.flatnonzero(counts)
        weight = np.log1p(counts[found])
        weight /= max(1e-9, np.sqrt(weight @ weight))
        out.append((np.concatenate([found, np.arange(DIMS, DIMS + SHAPE + 1)]), np.concatenate([weight, shape(text), [1.0]])))
    return out


def fit(rows: list[bytes], y: np.ndarray) -> dict | None:
    """Weights of a logistic regression and the share of good rows, from packed features; None unless both labels occur."""
    if len(set(y.tolist())) < 2:
        return None
    w, past = np.zeros(DIMS + SHAPE + 1), np.full(DIMS + SHAPE + 1, 1e-6)
    rng = np.random.default_rng(0)
    for _ in range(max(EPOCHS, UPDATES // len(rows))):
        for i in rng.permutation(len(rows)):
            at, x = _unpacked(rows[i])
            mine = w[at]
            g = (1 / (1 + np.exp(-(mine @ x))) - y[i]) * x
            g[:-1] += RIDGE * mine[:-1]
            past[at] += g * g
            w[at] = mine - RATE * g / np.sqrt(past[at])
    return {"w": w, "rate": float(y.mean())}


def _packed(texts: list[str]) -> list[bytes]:
    return [at.astype("<u2").tobytes() + x.astype("<f4").tobytes() for at, x in features(texts)]


def _unpacked(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(raw) // 6
    return np.frombuffer(raw, "<u2", n).astype(np.int64), np.frombuffer(raw, "<f4", n, 2 * n).astype(float)


def slices(texts: pd.Series, chars: int = 500_000) -> Iterator[list[str]]:
    """A column's texts in lists of about ``chars`` characters; null counts as empty."""
    whole = texts.fillna("")
    for _, part in whole.groupby((whole.str.len().cumsum() // chars).to_numpy(), sort=False):
        yield list(part)


def train(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED) -> dict | None:
    """The document classifier of the labelled ids; an id with differing labels counts as bad."""
    known = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("_y"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled)
    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("doc_id", "text", F.xxhash64("text").alias("h"), F.col("_y").cast("double").alias("y"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame[["doc_id", "h", "y"]].assign(x=[x for part in slices(frame["text"]) for x in _packed(part)])

    def learn(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["h", "doc_id"])
        return pd.DataFrame({"model": [pickle.dumps(fit(list(frame["x"]), frame["y"].to_numpy()))]})

    seen = rows.mapInPandas(run, f"doc_id {dict(docs.dtypes)['doc_id']}, h long, y double, x binary")
    one = seen.groupBy("doc_id").agg(F.min("h").alias("h"), F.first("y").alias("y"), F.min_by("x", "h").alias("x"))
    got = one.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(learn, "model binary").collect()
    return pickle.loads(bytes(got[0][0])) if got else None


def evidence(docs: DataFrame, text: Column, model: dict | None) -> Column:
    """Log likelihood ratio of good to bad for a text column.

    Marked as not deterministic so that Spark keeps it in one place of a plan: a filter on it would otherwise be repeated
    below, as "is not null", with a second Python worker for each task.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = shared.value
        for texts in batches:
            if known is None:
                yield pd.Series(np.zeros(len(texts)))
            else:
                base = np.log(known["rate"] / (1 - known["rate"]))
                yield pd.Series([known["w"][at] @ x - base for part in slices(texts) for at, x in features(part)], dtype=float)

    return run.asNondeterministic()(text)


def logit(p: Column) -> Column:
    p = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    return F.log(p / (1 - p))


def strength(groups: DataFrame, mean: Column) -> float:
    """Pseudo-count of the prior: by moments, from the variance of the groups' rates beyond what their sizes explain."""
    got = groups.select(F.col("n"), (F.col("good") / F.col("n")).alias("r"), mean.alias("m")).agg(
        F.sum(F.col("n") * (F.col("r") - F.col("m")) ** 2).alias("ss"), F.sum(F.col("m") * (1 - F.col("m"))).alias("within"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("m") * (1 - F.col("m"))).alias("mm")
    ).first()
    if not got["n"] or not got["mm"]:
        return 10.0
    between = max(1e-9, (got["ss"] - got["within"]) / got["n"])
    return float(min(1e4, max(1.0, got["mm"] / got["n"] / between - 1)))


def site_rates(rows: DataFrame, rate: float) -> DataFrame:
    """host, path, n and prior: the shrunk rate of each path. ``rows``: host, path, evidence."""
    p = 1 / (1 + F.exp(-(F.col("evidence") + logit(F.lit(rate)))))
    paths = cut(rows.groupBy("host", "path").agg(F.sum(p).alias("good"), F.count(F.lit(1)).alias("n")))
    hosts = cut(paths.groupBy("host").agg(F.sum("good").alias("good"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_paths")))
    k_host = strength(hosts, F.lit(rate))
    shrunk = hosts.select(F.col("host"), ((F.col("good") + k_host * rate) / (F.col("n") + k_host)).alias("host_rate"), "n_paths")
    both = cut(join_grouped(paths.withColumnRenamed("path", "_path"), shrunk, "host", "n_paths", paths.count()))
    k_path = strength(both, F.col("host_rate"))
    return both.select("host", F.col("_path").alias("path"), "n", ((F.col("good") + k_path * F.col("host_rate")) / (F.col("n") + k_path)).alias("prior"))


def site_columns(docs: DataFrame, host: str, path: str) -> DataFrame:
    named = F.coalesce(F.col(host), F.lit(""))
    return docs.withColumns({"_host": named, "_path": F.concat(named, F.lit("/"), F.coalesce(F.col(path), F.lit("")))})


def classify(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", labelled: int = LABELLED) -> DataFrame:
    """One row per document: doc_id, evidence, prior, posterior, kept."""
    with small_batches(docs.sparkSession):
        model = train(docs, labels, labelled)
    rows = cut(site_columns(docs, host, path).select("doc_id", F.col("_host").alias("host"), F.col("_path").alias("path"), evidence(docs, F.col("text"), model).alias("evidence")))
    rates = site_rates(rows, model["rate"] if model else 1 - 1e-6)
    out = join_grouped(rows, rates.select("path", "n", "prior"), "path", "n", rows.count())
    posterior = 1 / (1 + F.exp(-(F.col("evidence") + logit(F.col("prior")))))
    return out.select("doc_id", "evidence", "prior", posterior.alias("posterior"), (posterior >= 0.5).alias("kept"))


def keep(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", labelled: int = LABELLED, bound: int = 100_000) -> DataFrame:
    """The documents that are kept, with their own columns only.

    Evidence is worked out once for the sites and once more where each text lies, so that texts are not shuffled; the
    paths' rates are broadcast if a count shows at most ``bound`` of them, else joined by path.
    """
    with small_batches(docs.sparkSession):
        model = train(docs, labels, labelled)
    own = set_aside(docs, "doc_id", "text", host, path)
    marked = site_columns(own, host, path).withColumn("_evidence", evidence(docs, F.col("text"), model))
    rows = marked.select(F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_evidence").alias("evidence"))
    with small_batches(docs.sparkSession):
        rates = site_rates(rows, model["rate"] if model else 1 - 1e-6)
    rates = cut(rates.select(F.col("path").alias("_path"), "n", F.col("prior").alias("_prior")))
    if rates.limit(bound + 1).count() <= bound:
        out = marked.join(F.broadcast(rates.drop("n")), "_path", "left")
    else:
        out = join_grouped(marked, rates, "_path", "n", docs.count())
    out = out.where(F.col("_evidence") + logit(F.col("_prior")) >= 0)
    return brought_back(out, own, docs)
