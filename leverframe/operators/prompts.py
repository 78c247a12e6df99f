"""Prompts, requests and answers as column expressions, and the chain from candidate sets to trials through stored answers.

A request is the JSON text of model, messages, seed and token limit; its SHA-256 names the answer. Answers are kept in a
table of their own: before anything is decided, requests are held against it by an anti-join, so that a chain that runs
again decides only what it has not decided before. The offline decider answers in the same JSON that a prompt's contract
asks for, and the same parsers read it, so that another decider can fill the table in its place.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leverframe.functions import text as T
from leverframe.operators import trials as D
from leverframe.sources.files import exists

MODES = ("minimal", "full", "cite")
#: Most tokens of an answer in each mode.
MAX_TOKENS = {"minimal": 32, "full": 800, "cite": 800, "rewrite": 300}
#: Wordings; a caller may give others with the same keys.
ROLES = {
    "select": "你负责从候选材料里挑一篇作答题依据。",
    "cite": "你负责根据候选材料作答，并写明引用了哪几篇。",
    "rewrite": "你负责把问题改成检索词，不作答，也不添加事实。",
}
STYLES = {
    "neutral": "读完候选材料再定。",
    "cite_source": "读完候选材料再定，来源可查的优先。",
    "critical_eval": "先看每篇的可信度与局限，再定。",
    "persona": "以本领域专家的眼光读完再定。",
}
CONTRACTS = {
    "minimal": '只输出 JSON: {"choice": "字母"}',
    "full": '只输出 JSON: {"choice": "字母", "ranking": ["字母"], "scores": {"字母": 数}, "reason": "一句话"}',
    "cite": '只输出 JSON: {"answer": "一段话", "cited": ["字母"]}',
    "rewrite": '只输出 JSON: {"queries": ["检索词"]}',
}
#: A candidate is cited if it scores at least this share of the best one's score.
CITED_SHARE = 0.8


def letter(i: Column) -> Column:
    return F.char(i + 65)


def candidate_block(texts: Column) -> Column:
    """The candidates in order, each under its letter."""
    return F.array_join(F.transform(texts, lambda t, i: F.concat(F.lit("【候选 "), letter(i), F.lit("】\n"), t)), "\n\n")


def message_json(role: str, content: Column) -> Column:
    return F.concat(F.lit('{"content": '), T.json_text(content), F.lit(f', "role": "{role}"}}'))


def _messages(system: str, user: Column) -> Column:
    return F.concat(F.lit("["), message_json("system", F.lit(system)), F.lit(", "), message_json("user", user), F.lit("]"))


def decision_messages(question: Column, domain: Column, texts: Column, style: Column, mode: str, styles: dict[str, str] = STYLES, contracts: dict[str, str] = CONTRACTS) -> Column:
    """JSON list of a system and a user message: role and contract; question, requirement of the style, candidates and the contract again. Unknown styles are an error."""
    if mode not in MODES:
        raise ValueError(f"no such mode: {mode}")
    said = F.try_element_at(F.create_map(*[F.lit(x) for pair in styles.items() for x in pair]), style)
    said = F.coalesce(said, F.raise_error(F.concat(F.lit("no such style: "), style)).cast("string"))
    hint = F.when(F.coalesce(domain, F.lit("")) != "", F.concat(F.lit("("), domain, F.lit(")"))).otherwise("")
    user = F.concat(F.lit("问题"), hint, F.lit(":\n"), question, F.lit("\n\n"), said, F.lit("\n\n"), candidate_block(texts), F.lit("\n\n" + contracts[mode]))
    return _messages(ROLES["cite" if mode == "cite" else "select"] + contracts[mode], user)


def rewrite_messages(question: Column, domain: Column, most: int = 3) -> Column:
    """JSON list of messages that ask for up to ``most`` search queries from the question alone."""
    hint = F.when(F.coalesce(domain, F.lit("")) != "", F.concat(F.lit("("), domain, F.lit(")"))).otherwise("")
    return _messages(ROLES["rewrite"] + CONTRACTS["rewrite"], F.concat(F.lit("问题"), hint, F.lit(":\n"), question, F.lit(f"\n\n至多 {max(1, most)} 条。" + CONTRACTS["rewrite"])))


def request_json(model: Column, messages: Column, seed: Column, mode: str) -> Column:
    """The request with its keys in order."""
    return F.concat(F.lit(f'{{"max_tokens": {MAX_TOKENS[mode]}, "messages": '), messages, F.lit(', "model": '), T.json_text(model), F.lit(', "seed": '), seed.cast("string"), F.lit("}"))


def candidate_scores(contents: Column) -> Column:
    """The offline decider's score of each candidate from its content score and place."""
    return F.transform(contents, lambda c, i: F.round(F.greatest(F.lit(1.0), D.POSITION_WEIGHT * F.pow(F.lit(D.POSITION_DECAY), i) + c), 6))


def decision_reply(scores: Column, mode: str, share: float = CITED_SHARE) -> Column:
    """The offline decider's answer as the mode's contract asks: the best candidate (the earlier of equals), the ranking and scores, or all that are near the best."""
    if mode not in MODES:
        raise ValueError(f"no such mode: {mode}")
    quoted = lambda i: F.concat(F.lit('"'), letter(i), F.lit('"'))
    ranked = F.array_sort(F.transform(scores, lambda s, i: F.struct((-s).alias("s"), i.alias("i"))))
    choice = quoted(F.get(ranked, 0)["i"])
    if mode == "minimal":
        return F.concat(F.lit('{"choice": '), choice, F.lit("}"))
    if mode == "cite":
        near = F.filter(ranked, lambda r: -r["s"] >= share * F.array_max(scores))
        return F.concat(F.lit('{"answer": "", "cited": ['), F.array_join(F.transform(near, lambda r: quoted(r["i"])), ", "), F.lit("]}"))
    order = F.array_join(F.transform(ranked, lambda r: quoted(r["i"])), ", ")
    each = F.array_join(F.transform(scores, lambda s, i: F.concat(quoted(i), F.lit(": "), F.round(s, 1).cast("string"))), ", ")
    return F.concat(F.lit('{"choice": '), choice, F.lit(', "ranking": ['), order, F.lit('], "scores": {'), each, F.lit('}, "reason": ""}'))


def rewrite_reply(question: Column, most: int = 3) -> Column:
    """The offline decider's queries: the question without white space at its ends, then its words in up to ``most`` - 1 even parts."""
    words = F.filter(F.split(question, r"\s+"), lambda w: w != "")
    parts = max(0, most - 1)
    length = F.greatest(F.lit(1), F.ceil(F.size(words) / max(1, parts)).cast("int"))
    pieces = [F.array_join(F.slice(words, F.lit(i) * length + 1, length), " ") for i in range(parts)]
    return F.concat(F.lit('{"queries": ['), F.array_join(F.transform(F.array(F.regexp_replace(question, r"^\s+|\s+$", ""), *pieces), T.json_text), ", "), F.lit("]}"))


class Answers:
    """A table of stored answers (request_hash, reply) in a shared folder, filled batch by batch."""

    KIND = "request_hash string, reply string"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        if not exists(spark, path):
            spark.createDataFrame([], self.KIND).write.parquet(path)

    def table(self) -> DataFrame:
        return self.spark.read.schema(self.KIND).parquet(self.path)

    def fill(self, requests: DataFrame) -> int:
        """Decides the requests (request_hash, reply: what the decider answers) that have no stored answer; how many these were.

        The stored hashes are read before the new files are added, and a request that stands in many trials is decided once.
        """
        before = self.table().count()
        new = requests.select("request_hash", "reply").dropDuplicates(["request_hash"]).join(self.table().select("request_hash"), "request_hash", "left_anti")
        new.write.mode("append").parquet(self.path)
        return self.table().count() - before


def requests_of(sets: DataFrame, texts: DataFrame, questions: DataFrame, models: Sequence[str], styles: Sequence[str] = ("neutral",), seeds: Sequence[int] = (0,), mode: str = "minimal") -> DataFrame:
    """Every set for every model, style and seed with request_hash and the offline decider's reply.

    ``sets``: query_id, target_id, target_position, ordered_ids; ``texts``: id, text; ``questions``: query_id, question, domain.
    """
    keys = ["query_id", "target_id", "target_position", "ordered_ids"]
    long = sets.select(*keys, F.posexplode("ordered_ids").alias("pos", "id")).join(texts.select("id", "text", D.content_score(F.col("text")).alias("content")), "id")
    whole = long.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("pos", "text", "content"))).alias("c"))  # as many as a set has members
    grid = whole.join(questions, "query_id")
    for name, values in (("model", models), ("prompt_style", styles), ("seed", seeds)):
        grid = grid.withColumn(name, F.explode(F.array(*map(F.lit, values))))
    messages = decision_messages(F.col("question"), F.col("domain"), F.transform("c", lambda c: c["text"]), F.col("prompt_style"), mode)
    body = request_json(F.col("model"), messages, F.col("seed"), mode)
    return grid.select(*keys, "model", "prompt_style", "seed", F.sha2(body, 256).alias("request_hash"), decision_reply(candidate_scores(F.transform("c", lambda c: c["content"])), mode).alias("reply"))


def trials_of(requests: DataFrame, answers: DataFrame) -> DataFrame:
    """The trials: each request with its stored answer parsed; y (was the target chosen or cited), n_chosen, target_score, target_rank, parse_ok."""
    found = requests.drop("reply").join(answers, "request_hash").withColumn("o", D.extract_json(T.strip_thinking(F.col("reply"))))
    d = found.withColumn("d", D.parse_decision(F.col("o"), F.col("ordered_ids")))
    at = lambda m, default: F.coalesce(F.try_element_at(F.col(f"d.{m}"), F.col("target_id")), F.lit(default))
    return d.select(
        "query_id", "target_id", "target_position", "model", "prompt_style", "seed", "request_hash", F.array_contains("d.chosen_ids", F.col("target_id")).cast("int").alias("y"), F.size("d.chosen_ids").alias("n_chosen"),
        at("scores", None).alias("target_score"), at("ranks", -1).alias("target_rank"), F.col("d.parse_ok").cast("int").alias("parse_ok"),
    )


def run_chain(answers: Answers, requests: DataFrame) -> tuple[DataFrame, int]:
    """Trials of the requests, and how many of them had to be decided."""
    decided = answers.fill(requests)
    return trials_of(requests, answers.table()), decided


def rewritten(questions: DataFrame, answers: Answers, models: Sequence[str], most: int = 3) -> tuple[DataFrame, int]:
    """model, query_id, queries, parse_ok of every model and question (query_id, question, domain), and how many had to be decided."""
    grid = questions.withColumn("model", F.explode(F.array(*map(F.lit, models))))
    body = request_json(F.col("model"), rewrite_messages(F.col("question"), F.col("domain"), most), F.lit(0), "rewrite")
    asked = grid.select("model", "query_id", "question", F.sha2(body, 256).alias("request_hash"), rewrite_reply(F.col("question"), most).alias("reply"))
    decided = answers.fill(asked)
    found = asked.drop("reply").join(answers.table(), "request_hash").withColumn("o", D.extract_json(T.strip_thinking(F.col("reply"))))
    parsed = found.withColumn("d", D.parse_rewrite(F.col("o"), F.col("question"), most))
    return parsed.select("model", "query_id", "d.queries", "d.parse_ok"), decided
