"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Letters are lower-cased, everything else separates; the n-grams of one to three characters are hashed into ``DIMS``
features, weighted by (1 + log tf) x idf and brought to unit length. Weights are learned by follow-the-regularised-
leader (proximal, per-coordinate rates) with an elastic net, whose L1 part leaves most of them at exactly 0; then a
temperature is fitted on rows that the weights have not seen, so that scores are calibrated probabilities. The fit's
targets are smoothed by as much as so few rows can tell (a right label counts (n + 1) / (n + 2) on n rows), so that rows
which the weights tell apart without error don't sharpen the scores without end.

The model is fitted in one task on a sample of at most ``per_language`` learnable rows for each language (those with the
least hash of their id); it is a few hundred kB and is broadcast. Whole texts are scored, wherever they lie.

Results for odd input: a null text or one without letters is ``und`` with score 0; so is every text if nothing can be
learned; with one learned language all other texts get it; very long texts are read whole; repeated rows each get a row;
of languages with the same score the first by name is predicted, of equal hashes of ids the lesser id is learned from; an
empty table gives an empty result. Columns of ``docs`` called lang_pred or score are replaced by the results.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIMS = 1 << 14
PER_LANGUAGE = 1500
EPOCHS, RATE, BETA, L1, L2 = 3, 0.5, 1.0, 0.01, 0.01

_TABLE: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """For each code point its lower-case letter, or 0 if it is no letter."""
    if not _TABLE:
        table = np.zeros(0x110000, np.uint32)
        for c in range(0x110000):
            s = chr(c)
            if s.isalpha():
                low = s.lower()
                table[c] = ord(low) if len(low) == 1 else c
        _TABLE.append(table)
    return _TABLE[0]


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers and counts of a text's n-grams; empty if it has no letter."""
    codes = _letters()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    if not codes.any():
        return np.empty(0, np.int64), np.empty(0)
    codes = np.concatenate([[0], codes, [0]]).astype(np.uint32)
    one = codes * np.uint32(0x9E3779B1)
    two = (one[:-1] ^ (one[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA6B) + one[1:]
    three = (two[:-1] ^ (two[:-1] >> np.uint32(13))) * np.uint32(0xC2B2AE35) + one[2:]
    shift = np.uint32(32 - DIMS.bit_length() + 1)
    counts = np.zeros(DIMS, np.int64)
    for grams in (one, two, three):
        counts += np.bincount((grams * np.uint32(0x27D4EB2F)) >> shift, minlength=DIMS)
    at = np.flatnonzero(counts)
    return at, counts[at].astype(float)


def weighted(at: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = (1 + np.log(counts)) * idf[at]
    norm = np.sqrt(x @ x)
    return x / norm if norm else x


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max())
    return e / e.sum()


def fit(texts: list[str], langs: list[str]) -> dict | None:
    """The model of labelled texts: languages, idf, weights, bias and temperature; None if no text has a letter."""
    rows = [(f, lang) for f, lang in ((features(t), lang) for t, lang in zip(texts, langs, strict=True)) if len(f[0])]
    if not rows:
        return None
    names = sorted({lang for _, lang in rows})
    df = np.zeros(DIMS)
    for (at, _), _ in rows:
        df[at] += 1
    idf = np.log((1 + len(rows)) / (1 + df)) + 1
    data = [(np.append(at, DIMS), np.append(weighted(at, c, idf), 1.0), names.index(lang)) for (at, c), lang in rows]
    held, seen = data[::5], [d for i, d in enumerate(data) if i % 5]
    z, n = np.zeros((DIMS + 1, len(names))), np.zeros((DIMS + 1, len(names)))

    def weights(at: np.ndarray) -> np.ndarray:
        far = np.abs(z[at]) > L1
        return np.where(far, -(z[at] - np.sign(z[at]) * L1) / ((BETA + np.sqrt(n[at])) / RATE + L2), 0.0)

    rng = np.random.default_rng(0)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(seen)):
            at, x, y = seen[i]
            w = weights(at)
            p = softmax(x @ w)
            p[y] -= 1
            g = x[:, None] * p[None, :]
            root = np.sqrt(n[at])
            n[at] += g * g
            z[at] += g - (np.sqrt(n[at]) - root) / RATE * w
    final = weights(np.arange(DIMS + 1))
    return {"names": names, "idf": idf, "weights": final[:DIMS], "bias": final[DIMS], "temperature": temperature([x @ final[at] for at, x, _ in held], [y for _, _, y in held])}


def temperature(logits: list[np.ndarray], labels: list[int]) -> float:
    """The temperature of least log loss on held rows with smoothed targets, from a fine grid of powers."""
    if not logits or len(logits[0]) < 2:
        return 1.0
    z, y = np.array(logits), np.array(labels)
    target = np.full(z.shape, 1 / (len(y) + 2) / (z.shape[1] - 1))
    target[np.arange(len(y)), y] = (len(y) + 1) / (len(y) + 2)

    def loss(t: float) -> float:
        s = z / t
        top = s.max(axis=1, keepdims=True)
        return float(np.mean((target * (top + np.log(np.exp(s - top).sum(axis=1, keepdims=True)) - s)).sum(axis=1)))

    return float(min((2.0 ** (k / 8) for k in range(-64, 65)), key=loss))


def predict(model: dict | None, text: str | None) -> tuple[str, float]:
    at, counts = features(text) if model and isinstance(text, str) else ((), ())
    if not len(at):
        return "und", 0.0
    p = softmax((weighted(at, counts, model["idf"]) @ model["weights"][at] + model["bias"]) / model["temperature"])
    k = int(p.argmax())
    return model["names"][k], float(p[k])


def train(rows: DataFrame, per_language: int = PER_LANGUAGE, id_col: str = "doc_id") -> dict | None:
    """The model of labelled rows (id_col, text, lang), from at most ``per_language`` of each language."""
    rows = rows.where("lang IS NOT NULL AND text IS NOT NULL").select("text", "lang", F.xxhash64(id_col).alias("h"))
    counts = rows.groupBy("lang").count()
    scale = 1 << 20
    quota = counts.select("lang", F.least(F.lit(scale), F.ceil(F.lit(1.2 * per_language * scale) / F.col("count"))).alias("quota"))
    sample = rows.join(F.broadcast(quota), "lang").where(F.pmod("h", F.lit(scale)) < F.col("quota"))

    def learn(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["h", "text"]).groupby("lang", sort=True).head(per_language)
        model = fit(list(frame["text"]), list(frame["lang"]))
        return pd.DataFrame({"model": [pickle.dumps(model)]})

    got = sample.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(learn, "model binary").collect()
    return pickle.loads(bytes(got[0][0])) if got else None


def identify(docs: DataFrame, model: dict | None) -> DataFrame:
    """``docs`` with lang_pred and score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([predict(shared.value, t) for t in texts], columns=["lang_pred", "score"])

    out = docs.withColumn("_lang", run(F.col("text")))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("lang_pred", "score")], "_lang.lang_pred", "_lang.score")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))
