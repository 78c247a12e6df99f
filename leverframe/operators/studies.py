"""The six studies: articles assembled from a design, candidate sets, trials by the offline decider, and their tables.

A study is a chain of frames: questions, articles (targets of the design and the distractors they share), candidate
sets, trials, tables. Every random choice is a hash of what it is for, so that a study is the same wherever and however
often it runs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leverframe.codebook import FACTORS, TOP
from leverframe.functions import text as T
from leverframe.operators import effects as E
from leverframe.operators import information as I
from leverframe.operators import models as M
from leverframe.operators import retrieval as R
from leverframe.operators import trials as D
from leverframe.operators.prompts import CITED_SHARE

#: Wordings of each part of an article; {core} is the question's topic. A caller may give its own.
PHRASES = {
    "opener": ["谈到{core}，先看基本情况。", "{core}是下文的话题。"],
    "S1.vague": ["大家说这样可行。", "据说做过的人都满意。"],
    "S1.solid": ["某机构测了 N=640 例，好转 21%。", "公开来源: 样本 N=815，评分 4.4。"],
    "S1.fake": ["某机构内测 N=70,000，好转 300%。", "来源未名: N=55,555，评分 9.9。"],
    "S2": ["但是条件变了就难说。", "然而小样本下有风险。"],
    "S3": ["这背后的机制很清楚。", "放在通行的框架里也说得通。"],
    "S3.fake": ["范式即机制，机制即范式。", "框架之上另有框架。"],
    "S4": ["核心优势明显，选择理由就是{core}。", "选{core}，选择理由见此，核心优势在先。"],
    "lead": ["摘要:先说判断。", "结论先行:可取。"],
    "tail": ["说到这里才下判断。", "判断放在末尾。"],
    "bound": ["(证据:实测吻合)。", "(证据:记录在案)。"],
    "adjacent": ["，紧邻处有实测。", "，紧邻的记录可查。"],
}
# The headings of a text with explicit structure, which factors a distractor may show, and how often.
HEADINGS = ("## 适用场景\n", "\n## 分析\n", "\n## 结论\n见上。")
FLIPS, FLIP_SHARE = ["S2", "S3", "S4", "O1", "O3"], 0.4
FAKEABLE = ["S1", "S3"]
PRIORITY = [("S1", "O4")]


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) that is a hash of the parts."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts).cast("binary")), 1, 8), 16, 10).cast("double") / 4294967296.0


def choose(options: Sequence[str], seed: Column, family: str) -> Column:
    """One of the options, by a hash of seed and family."""
    n = F.conv(F.substring(F.sha1(F.concat(seed, F.lit(f"|{family}")).cast("binary")), 1, 8), 16, 10).cast("long") % len(options)
    return F.element_at(F.array(*map(F.lit, options)), (n + 1).cast("int"))


def article_text(core: Column, seed: Column, fake: Column, phrases: dict[str, Sequence[str]] = PHRASES) -> Column:
    """The text that shows the levels of the columns S1..O4: claim, evidence, caveats, in the asked order and form."""
    said = lambda family: F.replace(choose(phrases[family], seed, family), F.lit("{core}"), core)
    real_or_fake = lambda f, g: F.when(fake, said(g)).otherwise(said(f))
    parts = F.array_compact(
        F.array(
            said("opener"), F.when(F.col("S4") > 0, said("S4")),
            F.when(F.col("S1") == 1, said("S1.vague")).when(F.col("S1") > 1, real_or_fake("S1.solid", "S1.fake")),
            F.when(F.col("S3") > 0, real_or_fake("S3", "S3.fake")), F.when(F.col("S2") > 0, said("S2")),
        )
    )
    first, rest = F.get(parts, 0), F.slice(parts, 2, 10)
    bound = F.when(F.col("O4") == 2, said("bound")).otherwise(said("adjacent"))
    near = F.concat(F.array(F.concat(F.regexp_replace(first, "。+$", ""), bound)), rest)
    apart = F.concat(F.array(first), F.slice(parts, 3, 10), F.slice(parts, 2, 1))
    body = F.when(F.col("O4") > 0, near).otherwise(apart)
    body = F.when(F.col("O2") == 1, F.concat(F.array(said("lead")), body)).otherwise(F.concat(body, F.array(said("tail"))))
    shown = F.when(F.col("O1") == 1, F.array_join(F.transform(body, lambda s: F.concat(F.lit("- "), s)), "\n")).otherwise(F.array_join(body, ""))
    return F.when(F.col("O3") == 1, F.concat(F.lit(HEADINGS[0]), core, F.lit(HEADINGS[1]), shown, F.lit(HEADINGS[2]))).otherwise(shown)


def profile_json() -> Column:
    return F.concat(F.lit("{"), F.concat_ws(", ", *[F.concat(F.lit(f'"{f}": '), F.col(f).cast("string")) for f in sorted(FACTORS)]), F.lit("}"))


def article_id(suffix: Column, authenticity: Column) -> Column:
    """Names an article by question, levels, authenticity and place in the design, not by how its text was made."""
    return T.stable_id(F.lit('"art"'), T.json_text(F.col("query_id")), profile_json(), T.json_text(authenticity), T.json_text(suffix))


def with_points(queries: DataFrame, points: DataFrame) -> DataFrame:
    """Every question with every point of a design, whose few rows go into the plan."""
    rows = points.collect()
    one = lambda i, r: F.struct(F.lit(i).alias("point"), *[F.lit(r[c]).cast(t).alias(c) for c, t in points.dtypes])
    return queries.select("*", F.explode(F.array(*[one(i, r) for i, r in enumerate(rows)])).alias("_p")).select("*", "_p.*").drop("_p")


def build_targets(queries: DataFrame, points: DataFrame) -> DataFrame:
    """One article for each question (query_id, domain, core) and point (label, role, target_dim, S1..O4, perhaps fakeable_dim, variant, authenticity)."""
    rows = with_points(queries, points)
    has = lambda c, default: F.col(c) if c in points.columns else F.lit(default).cast("string").alias(c)
    rows = rows.withColumn("authenticity", has("authenticity", "genuine"))
    suffix = F.concat_ws("-", "label", "role", F.col("point").cast("string"))
    return rows.select(
        article_id(suffix, F.col("authenticity")).alias("article_id"), "query_id", "domain", "label", "role", "target_dim", F.concat_ws("|", "query_id", "label").alias("pair_id"), has("fakeable_dim", None), has("variant", None), "authenticity",
        *FACTORS, article_text(F.col("core"), F.col("query_id"), F.col("authenticity") == "fake").alias("text"),
    )


def distractor_pool(queries: DataFrame, n: int = 4, passages: DataFrame | None = None) -> DataFrame:
    """``n`` competitors of each question: passages (query_id, text) in the order of a hash, then assembled articles with a few factors on."""
    made = queries.select("query_id", "core", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i"))
    seed = F.concat(F.col("query_id"), F.lit("|distract"), F.col("i").cast("string"))
    level = lambda f: F.when(uniform(seed, F.lit(f)) < FLIP_SHARE, TOP[f]).otherwise(0) if f in FLIPS else F.lit(0)
    made = made.withColumns({f: level(f).cast("int") for f in FACTORS})
    made = made.select(article_id(F.concat(F.lit("distract"), F.col("i").cast("string")), F.lit("genuine")).alias("article_id"), "query_id", "i", article_text(F.col("core"), seed, F.lit(False)).alias("text"))
    if passages is None:
        return made.drop("i")
    order = F.row_number().over(Window.partitionBy("query_id").orderBy(F.sha1(F.concat_ws("|", "query_id", "text").cast("binary")), "text"))
    real = passages.select("query_id", "text", order.alias("r")).where(F.col("r") <= n)
    short = real.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_real"))
    real = real.select(T.stable_id(F.lit('"real"'), T.json_text(F.col("query_id")), T.json_text(F.col("text"))).alias("article_id"), "query_id", "text")
    rest = made.join(short, "query_id", "left").where(F.col("i") >= F.coalesce("n_real", F.lit(0))).select("article_id", "query_id", "text")
    return real.unionByName(rest)


def assemble(queries: DataFrame, targets: DataFrame, size: int = 3, passages: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Texts (article_id, text) and candidate sets: each target at each position among the competitors that all targets of its question share."""
    pool = distractor_pool(queries, passages=passages)
    shared = D.shared_competitors(pool.select("query_id", F.col("article_id").alias("doc_id")), size - 1)
    sets = D.candidate_sets(targets.select("query_id", F.col("article_id").alias("target_id")).join(shared, "query_id"), size)
    return targets.select("article_id", "text").unionByName(pool.select("article_id", "text")), sets


def run_trials(sets: DataFrame, texts: DataFrame, targets: DataFrame, models: Sequence[str], styles: Sequence[str] = ("neutral",), seeds: Sequence[int] = (0,), noise: float = 16.0, cite: float | None = None) -> DataFrame:
    """The trial frame: every set for every model, style and seed, decided by position, content markers and hashed noise.

    One candidate is chosen, or with ``cite`` all are cited that score at least that share of the best one's score.

    A part of the answers is refused or can't be read, again by a hash, so that the frames' filters have work to do.
    """
    lists = {"model": models, "prompt_style": styles, "seed": seeds}
    grid = sets
    for name, values in lists.items():
        grid = grid.withColumn(name, F.explode(F.array(*map(F.lit, values))))
    key = ["model", "prompt_style", "seed", "target_id", "target_position"]
    said = [F.col(c).cast("string") for c in key]
    long = grid.select("query_id", *key, F.posexplode("ordered_ids").alias("pos", "article_id"))
    long = long.join(texts.select("article_id", D.content_score(F.col("text")).alias("content")).dropDuplicates(["article_id"]), "article_id")
    score = D.POSITION_WEIGHT * F.pow(F.lit(D.POSITION_DECAY), F.col("pos")) + F.col("content") + noise * (uniform(*said, F.col("pos").cast("string")) - 0.5)
    scored = F.round(F.greatest(F.lit(1.0), score), 6)
    best = F.max_by("article_id", F.struct(scored, -F.col("pos"))) if cite is None else F.max(F.when(F.col("article_id") == F.col("target_id"), scored)) >= cite * F.max(scored)
    chosen = long.groupBy("query_id", *key).agg(best.alias("chosen_id"))
    bad, refused = uniform(*said, F.lit("parse")) < 0.05, uniform(*said, F.lit("api")) < 0.04
    frame = chosen.join(targets.drop("text", "query_id").withColumnRenamed("article_id", "target_id"), "target_id")
    return frame.select(
        *[c for c in frame.columns if c != "chosen_id"], F.when(bad | refused, 0).otherwise(1).alias("parse_ok"), F.when(refused, "content_filter").otherwise("").alias("api_error"),
        F.when((F.col("chosen_id") == F.col("target_id") if cite is None else F.coalesce("chosen_id", F.lit(False))) & ~bad & ~refused, 1).otherwise(0).alias("y"),
    )


def parsed_only(frame: DataFrame) -> DataFrame:
    """Trials whose answer could be read; refused ones are not looked at."""
    return frame.where("parse_ok = 1")


#: What a control and its treatment have in common, in the studies with and without fixed positions.
PAIR = ("query_id", "model", "prompt_style", "target_position", "seed", "pair_id")
PAIR_ANYWHERE = ("query_id", "model", "prompt_style", "seed", "pair_id")


def ate_and_ei(frame: DataFrame, by: Sequence[str] = (), pair: Sequence[str] = PAIR) -> tuple[DataFrame, DataFrame]:
    """Paired effects and leverage of each factor, each within its own trials."""
    long = E.scoped(frame)
    return E.ate_table(long, [*by, "factor"], pair), I.leverage(long, by)


def study1_tables(frame: DataFrame, by: Sequence[str] = ("model",)) -> dict[str, DataFrame]:
    ate, ei = ate_and_ei(E.analysis_frame(frame), by)
    return {"ate": ate, "ei": ei}


def study2_tables(frame: DataFrame) -> dict[str, DataFrame]:
    """No filter: unread answers count as not chosen here."""
    return {"coefficients": M.logit_with_clusters(frame, FACTORS, PRIORITY), "ei": I.effective_information(I.backdoor_do(frame))}


def study3_tables(frame: DataFrame) -> dict[str, DataFrame]:
    work = E.scoped(E.analysis_frame(frame))
    by_model = I.leverage(work, ["model"])
    ranks = I.common_factors(I.ranked(by_model.select("model", "factor", "EI_norm")))
    return {"ei_by_model": by_model, "ei_by_domain": I.leverage(work, ["domain"]), "consistency": I.kendall_w(ranks), "rates": E.position_adjusted(E.analysis_frame(frame), ["model"])}


def study4_tables(frame: DataFrame) -> dict[str, DataFrame]:
    """No filter, as in study 2."""
    return {"deception": I.deception_gain(frame), "delta_ei": I.delta_ei(frame)}


def study5_tables(retrieved: DataFrame, frame: DataFrame, by: Sequence[str] = ("model",)) -> dict[str, DataFrame]:
    """Effects on being cited, and both channels together; the latter takes every trial, also unread ones."""
    ate, ei = ate_and_ei(E.analysis_frame(frame), by)
    return {"ate_cite": ate, "ei": ei, "e2e": E.two_channels(retrieved, frame)}


def study6_tables(retrieved: DataFrame, frame: DataFrame, by: Sequence[str] = ("model",)) -> dict[str, DataFrame]:
    """Effects on being retrieved and on being cited in the end; positions follow from retrieval, so pairs don't hold them fixed."""
    ate, ei = ate_and_ei(E.analysis_frame(frame), by, PAIR_ANYWHERE)
    return {"ate_retrieved": E.paired_ate(E.scoped(retrieved), ("factor",), ("query_id", "pair_id"), "retrieved"), "ate_e2e": ate, "ei": ei}


def run_study1(queries: DataFrame, models: Sequence[str], size: int = 3, **grid) -> tuple[DataFrame, dict[str, DataFrame]]:
    """One factor at a time, control against treatment."""
    targets = build_targets(queries, D.ofat_design(queries.sparkSession))
    texts, sets = assemble(queries, targets, size)
    frame = run_trials(sets, texts, targets, models, **grid)
    return frame, study1_tables(frame)


def study2_frame(queries: DataFrame, models: Sequence[str], size: int = 3, n_points: int | None = None, **grid) -> DataFrame:
    """Trials of all factors at once, on a part of the factorial."""
    points = D.fractional_design(queries.sparkSession, n_points=n_points)
    points = points.select(F.concat(F.lit("p"), F.conv(F.substring(F.sha1(profile_json().cast("binary")), 1, 6), 16, 10)).alias("label"), F.lit("point").alias("role"), F.lit(None).cast("string").alias("target_dim"), *FACTORS)
    targets = build_targets(queries, points)
    texts, sets = assemble(queries, targets, size)
    return run_trials(sets, texts, targets, models, **grid)


def run_study2(queries: DataFrame, models: Sequence[str], size: int = 3, n_points: int | None = None, **grid) -> tuple[DataFrame, dict[str, DataFrame]]:
    """All factors at once, on a part of the factorial."""
    frame = study2_frame(queries, models, size, n_points, **grid)
    return frame, study2_tables(frame)


def run_study3(queries: DataFrame, models: Sequence[str], size: int = 3, styles: Sequence[str] = ("neutral", "cite_source"), **grid) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Study 1's design over models, styles and domains."""
    targets = build_targets(queries, D.ofat_design(queries.sparkSession))
    texts, sets = assemble(queries, targets, size)
    frame = run_trials(sets, texts, targets, models, styles, **grid)
    return frame, study3_tables(frame)


def adversarial_design(spark) -> DataFrame:
    """None, genuine and fake of each factor that can be faked."""
    rows = [(f"{f}-{v}", v, f, f, v, "fake" if v == "fake" else "genuine", *[TOP[g] if g == f and v != "none" else 0 for g in FACTORS]) for f in FAKEABLE for v in ("none", "genuine", "fake")]
    return spark.createDataFrame(rows, "label string, role string, target_dim string, fakeable_dim string, variant string, authenticity string, " + ", ".join(f"{f} int" for f in FACTORS))


def run_study4(queries: DataFrame, models: Sequence[str], size: int = 3, styles: Sequence[str] = ("neutral", "critical_eval"), **grid) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Genuine against faked features."""
    targets = build_targets(queries, adversarial_design(queries.sparkSession))
    texts, sets = assemble(queries, targets, size)
    frame = run_trials(sets, texts, targets, models, styles, **grid)
    return frame, study4_tables(frame)


def audit_sheet(queries: DataFrame) -> DataFrame:
    """Study 4's articles for review: none, genuine and fake of each question and factor side by side, with empty reviewer columns."""
    rows = build_targets(queries, adversarial_design(queries.sparkSession))
    place = F.when(F.col("variant") == "none", 0).when(F.col("variant") == "genuine", 1).otherwise(2)
    empty = F.lit("")
    return rows.select("domain", "query_id", F.col("fakeable_dim").alias("dim"), "variant", place.alias("place"), "article_id", "text", F.length("text").alias("n_chars"), empty.alias("reviewer_verdict"), empty.alias("reviewer_note")).orderBy("domain", "query_id", "dim", "place").drop("place")


def _retrieval_frame(found: DataFrame, targets: DataFrame) -> DataFrame:
    meta = targets.select(F.xxhash64("article_id").alias("target_id"), "article_id", "query_id", "target_dim", "role", "pair_id", *FACTORS)
    return found.join(meta, "target_id").drop("target_id")


def _search_targets(targets: DataFrame, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Queries and targets with numbers for names, as a search wants them."""
    asked = queries.select(F.xxhash64("query_id").alias("query_id"), "domain", F.col("core").alias("text"))
    return asked, targets.select(F.xxhash64("article_id").alias("target_id"), F.array(F.xxhash64("query_id")).alias("query_ids"), "text")


def run_study5(queries: DataFrame, corpus: DataFrame, models: Sequence[str], k: int = 8, cite: float = CITED_SHARE, **grid) -> tuple[DataFrame, DataFrame, dict[str, DataFrame]]:
    """Is a target retrieved from its domain, and is it cited among its competitors wherever it stands? ``corpus``: doc_id, domain, text."""
    targets = build_targets(queries, D.ofat_design(queries.sparkSession))
    asked, own = _search_targets(targets, queries)
    found = _retrieval_frame(R.search(R.Index(corpus), asked, own, k=k), targets)
    sets = D.candidate_sets(found.select("query_id", F.col("article_id").alias("target_id"), F.col("competitor_ids").alias("competitors")), k)
    texts = targets.select("article_id", "text").unionByName(corpus.select(F.col("doc_id").cast("string").alias("article_id"), "text"))
    frame = run_trials(sets, texts, targets, models, cite=cite, **grid)
    return found, frame, study5_tables(found, frame)


def run_study6(queries: DataFrame, corpus: DataFrame, rewrites: DataFrame, models: Sequence[str], k: int = 8, pool: str = "max", cite: float = CITED_SHARE, **grid) -> tuple[DataFrame, DataFrame, dict[str, DataFrame]]:
    """Retrieval by rewritten queries (query_id, texts), then citation within the natural window: a target outside it can't be cited."""
    targets = build_targets(queries, D.ofat_design(queries.sparkSession))
    asked = rewrites.join(queries.select("query_id", "domain"), "query_id").select("query_id", F.explode(F.transform("texts", lambda t: F.struct(F.xxhash64("domain", t).alias("query_id"), t.alias("text"), F.lit(None).cast("array<float>").alias("embedding")))).alias("r"))
    asked = asked.groupBy("query_id").agg(F.collect_list("r").alias("rewrites"))  # as many as a question has rewrites
    mine = targets.join(asked, "query_id", "left").select(F.xxhash64("article_id").alias("target_id"), "domain", "text", F.lit(None).cast("array<float>").alias("embedding"), F.coalesce("rewrites", F.array().cast("array<struct<query_id:bigint,text:string,embedding:array<float>>>")).alias("rewrites"))
    searched, own = R.queries_of_targets(mine)
    found = _retrieval_frame(R.search(R.Index(corpus), searched.select("query_id", "domain", "text"), own, k=k, pool=pool), targets)
    rank = F.col("target_rank").cast("int")
    window = F.when(rank < k, F.concat(F.slice("top_k_ids", F.lit(1), rank), F.array("article_id"), F.slice("top_k_ids", rank + 1, F.greatest(k - 1 - rank, F.lit(0))))).otherwise(F.col("top_k_ids"))
    sets = found.select("query_id", F.col("article_id").alias("target_id"), (F.array_position(window, F.col("article_id")) - 1).cast("int").alias("target_position"), window.alias("ordered_ids")).where(F.size("ordered_ids") >= 2)
    texts = targets.select("article_id", "text").unionByName(corpus.select(F.col("doc_id").cast("string").alias("article_id"), "text"))
    frame = run_trials(sets, texts, targets, models, cite=cite, **grid)
    return found, frame, study6_tables(found, frame)
