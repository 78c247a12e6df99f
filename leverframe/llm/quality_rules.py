"""Quality rules: base counts of a text, and a hashed n-gram log-likelihood ratio.

Words and word pairs are hashed into ``BUCKETS`` buckets. The trusted texts are all that are labelled good and not
toxic, the raw corpus is every document. Of n n-grams in trusted texts, n * p_raw are expected in a bucket; its ratio is
log((trusted count + ``EVIDENCE``) / (expected + ``EVIDENCE``)), so a bucket in which few are expected says about 0 at
every size of the table, and a well filled one says log p_trusted - log p_raw. A document's score is the mean over its
n-grams. A trusted document is scored against the other trusted ones: its own n-grams are taken out of the trusted
counts first. A fixed threshold on the score decides every document.

Everything is DataFrame functions: the counts are one grouped aggregation; they are two small tables (``BUCKETS``
numbers whatever the input) in the scoring expression.

Results for odd input: null text has no words, so its counts are 0, base_failed holds and its score is null; with no
trusted text or no documents the ratio is 0 for all, and only the base rules reject; very long texts are counted whole;
repeated rows each count and get a row; an empty table gives an empty result. Columns of ``docs`` that have the name of a
result of ``judged`` are replaced by it, all others stay; ``keep`` keeps the columns of ``docs`` whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leverframe.llm.common import brought_back, set_aside, words_of

BUCKETS = 1 << 15
#: Pseudo-count that draws a bucket's ratio to 0.
EVIDENCE = 8.0
#: Most trusted ids that are broadcast; beyond, documents and ids are shuffled.
BROADCAST = 1_000_000
#: Least mean log ratio of a text that is kept: below the least labelled-good text that was scored against the others
#: (-0.10 on 293 texts of sf0.01, -0.05 on 2,927 of sf0.1), above 89 and 96 % of the labelled-bad ones.
LEAST = -0.12
#: Results of ``judged``.
RESULTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "llr", "kept"]
WINDOW = 8
#: The characters that count as symbols, and the base limits.
SYMBOLS = "[#*$%&|<>]"
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30


def _pairwise(values: str, gap: int) -> Column:
    """Hash of each element with the one ``gap`` places on."""
    v = F.col(values)
    n = F.greatest(F.size(v) - gap, F.lit(0))
    return F.zip_with(F.slice(v, 1, n), F.slice(v, gap + 1, n), lambda a, b: F.xxhash64(a, b))


def hashed(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with _words, their hashes _w1 and the hashes of neighbouring pairs _w2."""
    out = docs.withColumn("_words", words_of(F.col(text)))
    out = out.withColumn("_w1", F.transform("_words", lambda w: F.xxhash64(w)))
    return out.withColumn("_w2", _pairwise("_w1", 1))


def repeated_words() -> Column:
    """From _w8, the hashes of all windows: how many words lie in windows that the text has twice or more.

    Windows are sorted by hash, so equal ones are neighbours; the places of those that have an equal neighbour,
    in order, each add the words that the one before did not cover.
    """
    pick = lambda s: F.filter(s, lambda x, i: (x["h"] == F.get(s, i - 1)["h"]) | (x["h"] == F.get(s, i + 1)["h"]))
    ordered = F.sort_array(F.transform("_w8", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    places = F.sort_array(F.transform(F.transform(F.array(ordered), pick)[0], lambda x: x["i"]))
    start = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
    total = F.aggregate(places, start, lambda a, p: F.struct((a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n"), p.alias("last")), lambda a: a["n"])
    return F.when(F.size(F.array_distinct("_w8")) < F.size("_w8"), total).otherwise(0)


def base_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with _words, _w1, _w2 and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    whole = F.coalesce(F.col(text), F.lit(""))
    out = hashed(docs, text).withColumn("_w4", _pairwise("_w2", 2)).withColumn("_w8", _pairwise("_w4", 4))
    out = out.withColumn("_lines", F.filter(F.split(whole, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    out = out.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.length(F.array_join("_words", "")).cast("long"),
            "n_symbols": (F.length(whole) - F.length(F.regexp_replace(whole, SYMBOLS, ""))).cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_repeat_words": repeated_words().cast("long"),
        }
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return out.drop("_w4", "_w8", "_lines").withColumn("base_failed", failed)


def with_trust(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` with _good, whether the document is labelled good and not toxic."""
    good = labels.groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("toxic").alias("t")).where("q = 1 AND t = 0").select("doc_id", F.lit(True).alias("_good"))
    n = good.limit(BROADCAST + 1).count()
    out = docs.join(F.broadcast(good) if n <= BROADCAST else good, "doc_id", "left")
    return out.withColumn("_good", F.coalesce("_good", F.lit(False)))


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` with the base columns, llr (mean log ratio to the other documents; null without words) and kept."""
    aside = set_aside(docs, "doc_id", "text")
    marked = with_trust(aside, labels)
    grams = hashed(marked.select("_good", "text")).select("_good", F.explode(F.concat("_w1", "_w2")).alias("h"))
    counts = grams.groupBy(F.pmod("h", F.lit(BUCKETS)).alias("bucket")).agg(F.count(F.lit(1)).alias("raw"), F.count_if("_good").alias("good"))
    raw, best = [0] * BUCKETS, [0] * BUCKETS
    for row in counts.collect():  # at most BUCKETS rows
        raw[row["bucket"]], best[row["bucket"]] = row["raw"], row["good"]
    n_raw, n_best = max(1, sum(raw)), sum(best)
    # Whole numbers in one literal each, which ``scored`` binds once: ratios are worked out where they are used.
    table = lambda values: F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")
    others = F.lit(float(n_best)) - F.size("_grams")

    def scored(t: Column) -> Column:
        """The sum of a document's log ratios by the two tables ``t``."""
        ratio = lambda b: F.log((F.get(t["good"], b) + EVIDENCE) / (F.get(t["raw"], b) * (n_best / n_raw) + EVIDENCE))

        def run(a: Column) -> Column:
            """The sum with the run of ``k`` equal buckets that ends."""
            shrunk = F.log((F.get(t["good"], a["b"]) - a["k"] + EVIDENCE) / (others * (F.get(t["raw"], a["b"]) / n_raw) + EVIDENCE))
            return a["total"] + F.when(a["k"] > 0, a["k"] * shrunk).otherwise(0.0)

        def step(a: Column, b: Column) -> Column:
            same = a["b"] == b
            return F.struct(b.alias("b"), F.when(same, a["k"] + 1).otherwise(1).alias("k"), F.when(same, a["total"]).otherwise(run(a)).alias("total"))

        start = F.struct(F.lit(-1).alias("b"), F.lit(0).alias("k"), F.lit(0.0).alias("total"))
        left_out = F.aggregate(F.sort_array("_grams"), start, step, run)
        plain = F.aggregate("_grams", F.lit(0.0), lambda s, b: s + ratio(b))
        return F.when(F.col("_good") & (others > 0), left_out).when(F.col("_good"), 0.0).otherwise(plain)

    out = base_counts(marked).withColumn("_grams", F.transform(F.concat("_w1", "_w2"), lambda h: F.pmod(h, F.lit(BUCKETS)).cast("int")))
    total = F.transform(F.array(F.struct(table(best).alias("good"), table(raw).alias("raw"))), scored)[0]
    out = out.withColumn("llr", F.when(F.size("_grams") > 0, total / F.size("_grams")))
    out = out.withColumn("kept", ~F.col("base_failed") & (F.coalesce("llr", F.lit(0.0)) >= LEAST))
    return brought_back(out, aside, docs, *RESULTS)


def keep(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are kept, with their own columns only.

    The row number keeps the filter above the projections: pushed below them, the verdict's expression would be written
    out again for each use of each step, which grows beyond any plan.
    """
    aside = set_aside(docs, "doc_id", "text")
    decided = judged(aside, labels).withColumn("_row", F.monotonically_increasing_id())
    return brought_back(decided.where("kept AND _row >= 0"), aside, docs)
