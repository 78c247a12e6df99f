"""Designs, candidate sets, decisions and their parsing."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from leverframe.codebook import FACTORS, TOP
from leverframe.functions.text import marker_count

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: The offline decider's weight of each content marker, and its position decay.
MARKER_WEIGHTS = {"%": 6.0, "机构": 5.0, "核心优势": 7.0, "但是": 3.0, "局限": 3.0, "机制": 4.0, "(证据:": 5.0, "\n- ": 3.0, "##": 2.5, "结论先行": 2.5}
POSITION_DECAY, POSITION_WEIGHT = 0.85, 40.0
#: Fixed values of the cost estimate.
TOKENS_PER_CHAR, OUTPUT_TOKENS, PRICE_IN, PRICE_OUT = 0.7, 16, 2.0, 6.0


def ofat_design(spark: SparkSession) -> DataFrame:
    """Control and treatment of each factor; evidence proximity (O4) is tried on top of full evidence (S1)."""
    base = spark.range(1).select(F.posexplode(F.array(*map(F.lit, FACTORS))).alias("no", "target_dim"))
    both = base.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("t"))
    level = lambda f: F.when(F.col("target_dim") == f, F.col("t") * TOP[f]).otherwise(F.when(F.col("target_dim") == "O4", TOP["S1"]).otherwise(0) if f == "S1" else 0)
    return both.select(F.concat(F.lit("pair_"), "target_dim").alias("label"), F.when(F.col("t") == 1, "treatment").otherwise("control").alias("role"), "target_dim", *[level(f).cast("int").alias(f) for f in FACTORS])


def full_factorial(spark: SparkSession, factors: list[str]) -> DataFrame:
    """Every combination of all levels of the factors, the others at 0."""
    out = spark.range(1).select()
    for f in factors:
        out = out.select("*", F.explode(F.sequence(F.lit(0), F.lit(TOP[f]))).alias(f))
    return out.select(*[F.col(f) if f in factors else F.lit(0).alias(f) for f in FACTORS])


def fractional_design(spark: SparkSession, factors: list[str] | None = None, n_points: int | None = None) -> DataFrame:
    """Two-level points of the factors, the others at 0.

    With ``n_points``, that many of the full grid in the order of a hash; else the full grid of up to four factors, and of
    more the sixteen points in which four are free and the others products of three of them (resolution IV).
    """
    chosen = list(factors or FACTORS)
    k = len(chosen)
    if n_points is None and k > 4:
        base = spark.range(16).select(*[F.shiftright("id", i).bitwiseAND(1).cast("int").alias(f"b{i}") for i in range(4)])
        b = [F.col(f"b{i}") for i in range(4)]
        codes = [*b, b[0].bitwiseXOR(b[1]).bitwiseXOR(b[2]), b[0].bitwiseXOR(b[1]).bitwiseXOR(b[3]), b[0].bitwiseXOR(b[2]).bitwiseXOR(b[3]), b[1].bitwiseXOR(b[2]).bitwiseXOR(b[3])]
    else:
        base = spark.range(1 << k)
        if n_points is not None:
            base = base.orderBy(F.sha1(F.col("id").cast("string").cast("binary"))).limit(n_points)
        codes = [F.shiftright("id", i).bitwiseAND(1).cast("int") for i in range(k)]
    level = {f: (c * TOP[f]).cast("int") for f, c in zip(chosen, codes, strict=False)}
    return base.select(*[level.get(f, F.lit(0)).alias(f) for f in FACTORS])


def candidate_sets(targets: DataFrame, size: int, all_positions: bool = True) -> DataFrame:
    """One set for each position of the target among its query's first ``size`` - 1 competitors, or one at a hashed position.

    ``targets``: query_id, target_id, competitors (array). Too few competitors are an error.
    """
    if size < 2:
        raise ValueError("a candidate set has at least two members")
    few = F.concat(F.lit("too few competitors for a set: "), F.col("query_id").cast("string"))
    chosen = F.when(F.size("competitors") >= size - 1, F.slice("competitors", 1, size - 1)).otherwise(F.raise_error(few))
    places = F.sequence(F.lit(0), F.lit(size - 1)) if all_positions else F.array(F.pmod(F.conv(F.substring(F.sha1(F.col("target_id").cast("string").cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(size)).cast("int"))
    rows = targets.select("query_id", "target_id", F.explode(places).alias("target_position"), chosen.alias("_c"))
    return rows.select("query_id", "target_id", "target_position", F.array_insert("_c", F.col("target_position") + 1, F.col("target_id")).alias("ordered_ids"))


def permutations(ids: Column, most: int | None = None) -> Column:
    """All orders of an array's members, or ``most`` of them in the order of a hash."""
    grown = lambda perms, x: F.flatten(F.transform(perms, lambda p: F.transform(F.sequence(F.lit(0), F.size(p)), lambda j: F.array_insert(p, j + 1, x))))
    empty = F.array(F.array().cast("array<string>"))
    out = F.aggregate(ids, empty, grown)
    if most is None:
        return out
    keyed = F.array_sort(F.transform(out, lambda p: F.struct(F.sha1(F.array_join(p, "|").cast("binary")).alias("h"), p.alias("p"))))
    return F.transform(F.slice(keyed, 1, most), lambda x: x["p"])


def shared_competitors(pool: DataFrame, n: int) -> DataFrame:
    """query_id and its first ``n`` pool members in the order of a hash: one draw that all the query's targets share.

    Only the n least hashes of each group leave a task before the shuffle's final step (a bounded aggregate).
    """
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.sha1(F.concat_ws("|", "query_id", F.col("doc_id").cast("string")))))
    kept = pool.withColumn("r", rank).where(F.col("r") <= n)
    return kept.groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("r", "doc_id"))), lambda x: x["doc_id"].cast("string")).alias("competitors"))


def spread_map(rows: DataFrame, column: str, keys: list[str] | None = None) -> DataFrame:
    """``rows`` with a column for each key of a map column, in its place; without ``keys`` for all that occur. A column of that name is replaced, as the map is the later word."""
    if keys is None:
        keys = sorted(r[0] for r in rows.select(F.explode(F.map_keys(column))).distinct().collect())  # names of columns
    rest = [c for c in rows.columns if c != column and c not in keys]
    return rows.select(*rest, *[F.try_element_at(F.col(column), F.lit(k)).alias(k) for k in keys])


def content_score(text: Column) -> Column:
    out = F.lit(0.0)
    for m, w in MARKER_WEIGHTS.items():
        out = out + w * marker_count(text, [m])
    return out


def decide(sets: DataFrame, contents: DataFrame) -> DataFrame:
    """The offline decider without noise: the candidate with the best sum of position and content wins, the earlier of equals.

    ``sets`` has ordered_ids; ``contents``: id, content (``content_score`` of each article, worked out once). Adds chosen_id.
    """
    keys = [c for c in sets.columns]
    long = sets.select(F.struct(*keys).alias("_s"), F.posexplode("ordered_ids").alias("pos", "id")).join(contents, "id")
    score = F.greatest(F.lit(1.0), POSITION_WEIGHT * F.pow(F.lit(POSITION_DECAY), F.col("pos")) + F.col("content"))
    return long.groupBy("_s").agg(F.max_by("id", F.struct(F.round(score, 6), -F.col("pos"))).alias("chosen_id")).select("_s.*", "chosen_id")


def flat_json(text: Column) -> Column:
    """The last flat {...} of a text, from a fence or from prose; null if there is none."""
    return F.element_at(F.nullif(F.regexp_extract_all(text, F.lit(r"(\{[^{}]*\})"), F.lit(1)), F.array().cast("array<string>")), -1)


def parse_decision(found: Column, ordered_ids: Column) -> Column:
    """Struct of an answer's JSON object (``extract_json`` of it): chosen_ids, scores, ranks (maps by id) and parse_ok.

    A ``cited`` list names several candidates (none is fine, none that can be told is not), else ``choice`` names one;
    letters stand for places. Scores that are no numbers are left out; of a letter that is ranked twice the later place counts.
    """
    data = F.from_json(found, "choice STRING, cited ARRAY<STRING>, scores MAP<STRING, STRING>, ranking ARRAY<STRING>")
    place = lambda c: F.when(F.length(F.trim(c)) > 0, F.instr(F.lit(LETTERS), F.upper(F.substring(F.trim(c), 1, 1))))
    known = lambda p: (p >= 1) & (p <= F.size(ordered_ids))
    named = lambda c: F.get(ordered_ids, place(c) - 1)
    cited = F.array_distinct(F.transform(F.filter(data["cited"], lambda c: known(place(c))), named))
    none = F.array().cast("array<string>")
    choice = F.when(known(place(data["choice"])), F.array(named(data["choice"]))).otherwise(none)
    chosen = F.coalesce(F.when(data["cited"].isNotNull(), cited).otherwise(choice), none)
    ok = F.when(data.isNull(), False).when(data["cited"].isNotNull(), (F.size(data["cited"]) == 0) | (F.size(cited) > 0)).otherwise(F.size(choice) > 0)
    entries = F.filter(F.map_entries(data["scores"]), lambda e: known(place(e["key"])) & e["value"].try_cast("double").isNotNull())
    scores = F.map_from_entries(F.transform(entries, lambda e: F.struct(named(e["key"]), e["value"].cast("double"))))
    ranked = F.filter(F.transform(data["ranking"], lambda c, i: F.struct(place(c).alias("p"), i.alias("i"))), lambda r: known(r["p"]))
    last = F.filter(ranked, lambda r: ~F.exists(ranked, lambda s: (s["p"] == r["p"]) & (s["i"] > r["i"])))
    ranks = F.map_from_entries(F.transform(last, lambda r: F.struct(F.get(ordered_ids, r["p"] - 1), r["i"])))
    empty = lambda t: F.map_from_entries(F.array().cast(f"array<struct<k:string,v:{t}>>"))
    return F.struct(chosen.alias("chosen_ids"), F.coalesce(scores, empty("double")).alias("scores"), F.coalesce(ranks, empty("int")).alias("ranks"), ok.alias("parse_ok"))


def parse_rewrite(found: Column, question: Column, most: int = 8) -> Column:
    """Struct of queries (stripped, distinct, at most ``most``; the question if none) and parse_ok, from an answer's JSON object (``extract_json`` of it)."""
    got = F.from_json(found, "queries ARRAY<STRING>")["queries"]
    clean = F.slice(F.array_distinct(F.filter(F.transform(got, lambda q: F.trim(q)), lambda q: q != "")), 1, most)
    ok = F.coalesce(F.size(clean) > 0, F.lit(False))
    return F.struct(F.when(ok, clean).otherwise(F.array(question)).alias("queries"), ok.alias("parse_ok"))


def fenced(text: str) -> list[str]:
    """The contents of the text's code fences, without a language name."""
    parts = text.split("```")[1::2] if text.count("```") > 1 else []
    return [p[4:].strip() if p[:4].lower() == "json" else p.strip() for p in parts]


def first_object(text: str | None) -> str | None:
    """JSON of the first object among: the whole text, fenced blocks, balanced braces from the last on."""
    if not text:
        return None
    tries = [text.strip(), *fenced(text)]
    decoder, at, found = json.JSONDecoder(), 0, []
    while (at := text.find("{", at)) >= 0:
        try:
            _, end = decoder.raw_decode(text, at)
            found.append(text[at:end])
            at = end
        except ValueError:
            at += 1
    for t in [*tries, *reversed(found)]:
        try:
            if isinstance(data := json.loads(t), dict):
                return json.dumps(data, ensure_ascii=False, sort_keys=True)
        except ValueError:
            continue
    return None


@F.pandas_udf(StringType())
def extract_json(text: pd.Series) -> pd.Series:
    return text.map(first_object)


def call_plan(sets: DataFrame, prompts: DataFrame, n_models: int, n_styles: int, n_seeds: int) -> DataFrame:
    """Calls, tokens and cost of a study, from the mean prompt length of all its sets. ``prompts``: n_chars."""
    n = sets.agg(F.count(F.lit(1)).alias("n_sets")).withColumn("_one", F.lit(1))
    mean = prompts.agg(F.floor(F.avg("n_chars") * TOKENS_PER_CHAR).cast("long").alias("avg_input_tokens")).withColumn("_one", F.lit(1))
    both = n.join(mean, "_one").withColumn("n_calls", F.col("n_sets") * (n_models * n_styles * n_seeds))
    both = both.withColumns({"est_input_tokens": F.col("avg_input_tokens") * F.col("n_calls"), "est_output_tokens": F.col("n_calls") * OUTPUT_TOKENS})
    return both.drop("_one").withColumn("est_cost_usd", F.col("est_input_tokens") / 1e6 * PRICE_IN + F.col("est_output_tokens") / 1e6 * PRICE_OUT)


def n_for_power(p1: Column, p2: Column, z_alpha: float = 1.959963984540054, z_beta: float = 0.8416212335729143) -> Column:
    """Trials in each group to tell two rates apart (two-sided 5 %, power 0.8)."""
    mean = (p1 + p2) / 2
    top = z_alpha * F.sqrt(2 * mean * (1 - mean)) + z_beta * F.sqrt(p1 * (1 - p1) + p2 * (1 - p2))
    return F.ceil(top * top / ((p1 - p2) * (p1 - p2))).cast("long")
