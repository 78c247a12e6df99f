"""Character n-gram metrics of answers: clipped matches, BLEU, longest common subsequence, with bonuses for labels and entities.

A question is one row with its answer and all its references, so that everything is counted inside the row and only
sums are shuffled.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def normalize(text: Column) -> Column:
    """Text without white space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", "")


def char_ngrams(text: Column, n: int) -> Column:
    """All substrings of ``n`` characters, in order; none for shorter texts."""
    last = F.length(text) - n + 1
    return F.when(last >= 1, F.transform(F.sequence(F.lit(1), last), lambda i: F.substr(text, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def ngram_counts(df: DataFrame, keys: Sequence[str], text: str, orders: Sequence[int] = (1, 2, 3, 4)) -> DataFrame:
    """keys, n, gram and count of the n-grams of each order."""

    def marked(n: int) -> Column:
        return F.transform(char_ngrams(F.col(text), n), lambda g: F.struct(F.lit(n).alias("n"), g.alias("gram")))

    grams = F.explode(F.flatten(F.array(*map(marked, orders))))
    return df.select(*keys, grams.alias("_g")).select(*keys, "_g.*").groupBy(*keys, "n", "gram").agg(F.count(F.lit(1)).alias("c"))


ORDERS = (1, 2, 3, 4)


def grams(text: str, n: int) -> Counter:
    return Counter(text[i : i + n] for i in range(len(text) - n + 1))


def clipped(cand: str, refs: Sequence[str], n: int) -> tuple[int, int]:
    """n-grams of the answer that occur in a reference, each at most as often as in the reference with most of it; and all of its n-grams."""
    have, most = grams(cand, n), Counter()
    for ref in refs:
        most |= grams(ref, n)
    return (have & most).total(), max(0, len(cand) - n + 1)


def closest_length(cand: str, refs: Sequence[str]) -> int:
    """Length of the reference that is closest in length to the answer; the shorter of two."""
    return min((abs(len(cand) - len(r)), len(r)) for r in refs)[1]


def rouge_of(cand: str, refs: Sequence[str], label: str | None, labels: Sequence[str], entities: Sequence[str] | None, gamma: float, alpha: float, beta: float) -> float:
    """F measure of the best precision and the best recall; a bonus counts above and below the line."""
    best_p = best_r = 0.0
    for i, ref in enumerate(refs):
        common = lcs_length(cand, ref)
        if label is not None:
            extra = alpha * common if i < len(labels) and labels[i] == label else 0.0
        else:
            extra = beta * sum(len(e) for e in entities if e in cand) if entities else 0.0
        p, r = len(cand) + extra, len(ref) + extra
        best_p = max(best_p, (common + extra) / p if p > 0 else 0.0)
        best_r = max(best_r, (common + extra) / r if r > 0 else 0.0)
    g = gamma * gamma
    return (1 + g) * best_p * best_r / (best_r + g * best_p) if best_p and best_r else 0.0


SCORES = "matched array<long>, total array<long>, bonus array<double>, cand_len long, ref_len long, rouge double"


def answer_scores(alpha: float = 1.0, beta: float = 1.0, gamma: float = 1.2):
    """A function of columns (answer, references, label, labels, entities) that gives ``SCORES`` of each row.

    The bonus of an order is the n-grams that the answer shares with the references that have its label, or with the
    entities where there is no label.
    """

    @F.pandas_udf(SCORES)
    def run(cand: pd.Series, refs: pd.Series, label: pd.Series, labels: pd.Series, entities: pd.Series) -> pd.DataFrame:
        out = []
        for c, rs, y, ys, es in zip(cand, refs, label, labels, entities, strict=True):
            c, rs = c or "", list(rs)
            ys, es = list(ys) if ys is not None else [], list(es) if es is not None else []
            pairs = [clipped(c, rs, n) for n in ORDERS]
            if y is not None:
                weight, extra = alpha, [r for r, own in zip(rs, ys, strict=False) if own == y]
            else:
                weight, extra = beta, es
            bonus = [weight * clipped(c, extra, n)[0] if extra else 0.0 for n in ORDERS]
            out.append(([m for m, _ in pairs], [t for _, t in pairs], bonus, len(c), closest_length(c, rs), rouge_of(c, rs, y, ys, es, gamma, alpha, beta)))
        return pd.DataFrame(out, columns=["matched", "total", "bonus", "cand_len", "ref_len", "rouge"])

    return run


def questions_scored(preds: DataFrame, refs: DataFrame, alpha: float = 1.0, beta: float = 1.0, gamma: float = 1.2) -> DataFrame:
    """id and ``SCORES`` of each question that has references.

    ``preds``: id, answers, yesno_answers (arrays, the first counts); a question without one is answered by the empty
    text. ``refs``: id, question_type, answers, yesno_answers, entity_answers (array of arrays). Only YES_NO questions
    have a label, only ENTITY ones entities.
    """
    both = refs.where(F.size("answers") > 0).select("id", "question_type", F.transform("answers", normalize).alias("refs"), F.col("yesno_answers").alias("labels"), F.array_distinct(F.transform(F.flatten("entity_answers"), normalize)).alias("entities"))
    mine = preds.select("id", normalize(F.get("answers", 0)).alias("cand"), F.get("yesno_answers", 0).alias("label"))
    both = both.join(mine, "id", "left").withColumn("cand", F.coalesce("cand", F.lit("")))
    label = F.when(F.col("question_type") == "YES_NO", F.col("label"))
    entities = F.when((F.col("question_type") == "ENTITY") & (F.size("entities") > 0), F.col("entities"))
    return both.select("id", answer_scores(alpha, beta, gamma)("cand", "refs", label, "labels", entities).alias("s")).select("id", "s.*")


def repeated_ids(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """n_repeated: the keys that more than one row has."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").agg(F.count(F.lit(1)).alias("n_repeated"))


def clipped_matches(scored: DataFrame) -> DataFrame:
    """id, n, matched, total, one row for each order; none where the answer is shorter."""
    long = scored.select("id", F.posexplode(F.arrays_zip("matched", "total")).alias("i", "m"))
    return long.select("id", (F.col("i") + 1).alias("n"), "m.matched", "m.total").where("total > 0")


def bleu(scored: DataFrame, bonus: bool = False) -> DataFrame:
    """bleu_1 .. bleu_4 of a corpus, null for orders that no answer reaches; bonuses count in numerators and denominators."""
    extra = lambda n: F.sum(F.get("bonus", n - 1)) if bonus else F.lit(0.0)
    rate = lambda n: F.try_divide(F.sum(F.get("matched", n - 1)) + extra(n), F.sum(F.get("total", n - 1)) + extra(n))
    sums = scored.agg(*[rate(n).alias(f"p{n}") for n in ORDERS], F.exp(F.least(1 - F.try_divide(F.sum("ref_len"), F.sum("cand_len")), F.lit(0.0))).alias("bp"))
    product, out = F.lit(1.0), []
    for n in ORDERS:
        product = product * F.col(f"p{n}")
        out.append((F.pow(product, F.lit(1.0 / n)) * F.col("bp")).alias(f"bleu_{n}"))
    return sums.select(*out)


def rouge(scored: DataFrame) -> DataFrame:
    """Mean over questions."""
    return scored.agg(F.avg("rouge").alias("rouge_l"), F.count(F.lit(1)).alias("n_questions"))


def report(scored: DataFrame) -> DataFrame:
    """ROUGE-L and BLEU-4 with their bonuses, times 100, in two digits."""
    both = bleu(scored, bonus=True).select("bleu_4").withColumn("_one", F.lit(1)).join(rouge(scored).withColumn("_one", F.lit(1)), "_one")
    return both.select(F.round(F.col("rouge_l") * 100, 2).alias("rouge_l"), F.round(F.col("bleu_4") * 100, 2).alias("bleu_4"))


def lcs_length(a: str, b: str) -> int:
    """Length of the longest common subsequence: one pass over the longer text with the shorter one's characters as bits."""
    if len(a) < len(b):
        a, b = b, a
    places: dict[str, int] = {}
    for i, c in enumerate(b):
        places[c] = places.get(c, 0) | 1 << i
    full = (1 << len(b)) - 1
    row = full
    for c in a:
        hit = row & places.get(c, 0)
        row = (row + hit | row - hit) & full
    return len(b) - row.bit_count()
