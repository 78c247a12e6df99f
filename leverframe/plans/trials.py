"""Queries on designs, candidate sets, decisions and parsing, and on n-gram metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leverframe.codebook import FACTORS, TOP
from leverframe.functions import text as T
from leverframe.functions import textsim as S
from leverframe.operators import prompts as P
from leverframe.operators import trials as D
from leverframe.operators.studies import with_points
from leverframe.plans.registry import query, rounded
from leverframe.sources.articles import ARTICLES_SQL, articles
from leverframe.sources.files import read_answer_files, scratch, stored, write_zipped_lines
from leverframe.sources.tables import spread, table

A = f"WITH {ARTICLES_SQL}"
DIMS_SQL = "dims AS (SELECT unnest(" + str(FACTORS) + ") AS d)"


def _questions(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.concat(F.lit("q"), F.col("item_id").cast("string")).alias("query_id"), "item_id", "text")


def _top_sql(f: str) -> str:
    return f"CASE WHEN {f} IN ('S1', 'O4') THEN 2 ELSE 1 END"


OFAT_POINTS_SQL = f"""WITH {DIMS_SQL}, pts AS (SELECT 'pair_' || d AS label, CASE t WHEN 1 THEN 'treatment' ELSE 'control' END AS role, d AS target_dim,
 {', '.join(f"CAST(CASE WHEN d = '{f}' THEN t * {TOP[f]} {'WHEN d = ' + chr(39) + 'O4' + chr(39) + ' THEN 2' if f == 'S1' else ''} ELSE 0 END AS INTEGER) AS {f}" for f in FACTORS)} FROM dims, (SELECT unnest([0, 1]) AS t))"""


@query("ofat_design", f"{OFAT_POINTS_SQL} SELECT 'q' || CAST(item_id AS VARCHAR) AS query_id, pts.* FROM benchmark, pts")
def ofat_design(spark, sf_dir):
    """Every question with every design point."""
    return with_points(_questions(spark, sf_dir).select("query_id"), D.ofat_design(spark)).drop("point")


@query("full_factorial", "SELECT 'q' || CAST(item_id AS VARCHAR) AS query_id, CAST(a AS INTEGER) AS S1, CAST(b AS INTEGER) AS S2, 0 AS S3, 0 AS S4, 0 AS O1, 0 AS O2, 0 AS O3, CAST(c AS INTEGER) AS O4 FROM benchmark, (SELECT unnest([0, 1, 2]) AS a), (SELECT unnest([0, 1]) AS b), (SELECT unnest([0, 1, 2]) AS c)")
def full_factorial(spark, sf_dir):
    return with_points(_questions(spark, sf_dir).select("query_id"), D.full_factorial(spark, ["S1", "S2", "O4"])).drop("point")


@query("fractional_design", """WITH b AS (SELECT i & 1 AS a, (i >> 1) & 1 AS b, (i >> 2) & 1 AS c, (i >> 3) & 1 AS d FROM (SELECT unnest(range(16)) AS i))
SELECT 'q' || CAST(item_id AS VARCHAR) AS query_id, CAST(2 * a AS INTEGER) AS S1, CAST(b AS INTEGER) AS S2, CAST(c AS INTEGER) AS S3, CAST(d AS INTEGER) AS S4, CAST((a + b + c) % 2 AS INTEGER) AS O1, CAST((a + b + d) % 2 AS INTEGER) AS O2, CAST((a + c + d) % 2 AS INTEGER) AS O3, CAST(2 * ((b + c + d) % 2) AS INTEGER) AS O4 FROM benchmark, b""")
def fractional_design(spark, sf_dir):
    return with_points(_questions(spark, sf_dir).select("query_id"), D.fractional_design(spark)).drop("point")


# The built-in topics of each domain, and the prompt styles.
TOPICS = {
    "consumer_product": ["选购千元价位无线耳机", "挑选家用扫地机器人", "选择入门级单反相机"],
    "health": ["改善轻度失眠的非药物方法", "成年人补充维生素D的方案", "久坐人群的护腰锻炼"],
    "finance": ["指数基金定投策略", "应急备用金的配置", "信用卡分期是否划算"],
    "academic_qa": ["Transformer 推理加速方法", "因果推断中的后门调整", "对比学习的负样本选择"],
    "travel": ["雨季去云南的行程安排", "带老人出行的航班选择", "高原旅行的准备清单"],
}
STYLES = ["neutral", "cite_source", "critical_eval", "persona"]
TOPICS_SQL = "(VALUES " + ", ".join(f"('{d}', {i}, '{t}')" for d, ts in TOPICS.items() for i, t in enumerate(ts)) + ") AS t(domain, i, topic)"


@query("builtin_queries", f"SELECT item_id, domain, substr(sha1('[\"q\", \"' || domain || '\", \"' || topic || '\", ' || CAST(item_id AS VARCHAR) || ']'), 1, 12) AS id, '请就「' || topic || '」给出最值得参考的依据。' AS text FROM benchmark JOIN {TOPICS_SQL} ON i = item_id % 3")
def builtin_queries(spark, sf_dir):
    """Questions from the topic list, reused in turn."""
    topics = F.array(*[F.struct(F.lit(d).alias("domain"), F.lit(i).alias("i"), F.lit(t).alias("topic")) for d, ts in TOPICS.items() for i, t in enumerate(ts)])
    rows = table(spark, sf_dir, "benchmark").select("item_id", F.explode(topics).alias("t")).where(F.col("t.i") == F.col("item_id") % 3)
    return rows.select("item_id", "t.domain", T.stable_id(F.lit('"q"'), T.json_text(F.col("t.domain")), T.json_text(F.col("t.topic")), F.col("item_id").cast("string")).alias("id"), F.concat(F.lit("请就「"), "t.topic", F.lit("」给出最值得参考的依据。")).alias("text"))


COMPETITORS_SQL = f"{A}, cp AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY sha1(concat_ws('|', query_id, CAST(doc_id AS VARCHAR)))) AS r FROM articles), cs AS (SELECT query_id, list(CAST(doc_id AS VARCHAR) ORDER BY r) AS competitors FROM cp WHERE r <= 2 GROUP BY query_id)"


def _competitors(spark, sf_dir) -> DataFrame:
    return D.shared_competitors(articles(spark, sf_dir).select("query_id", "doc_id"), 2)


@query("shared_competitors", f"{COMPETITORS_SQL} SELECT query_id, array_to_string(competitors, ',') AS competitors FROM cs")
def shared_competitors(spark, sf_dir):
    return _competitors(spark, sf_dir).select("query_id", F.array_join("competitors", ",").alias("competitors"))


SETS_SQL = f"""{COMPETITORS_SQL}, st AS (SELECT a.query_id, CAST(a.doc_id AS VARCHAR) AS target_id, pos AS target_position, list_concat(list_concat(competitors[1:pos], [CAST(a.doc_id AS VARCHAR)]), competitors[pos + 1:2]) AS ids
 FROM articles a JOIN cs USING (query_id), (SELECT unnest([0, 1, 2]) AS pos) WHERE len(competitors) >= 2)"""


def _sets(spark, sf_dir) -> DataFrame:
    t = articles(spark, sf_dir).select("query_id", F.col("doc_id").cast("string").alias("target_id")).join(_competitors(spark, sf_dir), "query_id")
    return D.candidate_sets(t, 3)


@query("candidate_sets", f"{SETS_SQL} SELECT query_id, target_id, CAST(target_position AS INTEGER) AS target_position, array_to_string(ids, ',') AS ordered_ids FROM st")
def candidate_sets(spark, sf_dir):
    return _sets(spark, sf_dir).select("query_id", "target_id", "target_position", F.array_join("ordered_ids", ",").alias("ordered_ids"))


CONTENT_SQL = " + ".join("{w} * ((length(text) - length(replace(text, {m}, ''))) // {n})".format(w=w, m="chr(10) || '- '" if m == "\n- " else f"'{m}'", n=len(m)) for m, w in D.MARKER_WEIGHTS.items())
CHOICE_SQL = f"""{SETS_SQL}, ct AS (SELECT CAST(doc_id AS VARCHAR) AS id, {CONTENT_SQL} AS content FROM articles),
lg AS (SELECT query_id, target_id, target_position, generate_subscripts(ids, 1) - 1 AS pos, unnest(ids) AS id FROM st),
ch AS (SELECT query_id, target_id, target_position, id AS chosen_id FROM lg JOIN ct USING (id) QUALIFY row_number() OVER (PARTITION BY query_id, target_id, target_position ORDER BY round(greatest(1.0, 40.0 * pow(0.85, pos) + content), 6) DESC, pos) = 1)"""


def _chosen(spark, sf_dir) -> DataFrame:
    contents = articles(spark, sf_dir).select(F.col("doc_id").cast("string").alias("id"), D.content_score(F.col("text")).alias("content"))
    return D.decide(_sets(spark, sf_dir), contents)


@query("mock_select", f"{CHOICE_SQL} SELECT query_id, target_id, CAST(target_position AS INTEGER) AS target_position, chosen_id FROM ch")
def mock_select(spark, sf_dir):
    return _chosen(spark, sf_dir).select("query_id", "target_id", "target_position", "chosen_id")


@query("run_trials", f"{CHOICE_SQL} SELECT target_position, doc_id % 8 AS phrase, count(*) AS n, CAST(sum(CASE WHEN chosen_id = target_id THEN 1 ELSE 0 END) AS BIGINT) AS n_selected FROM ch JOIN articles ON CAST(doc_id AS VARCHAR) = target_id GROUP BY ALL")
def run_trials(spark, sf_dir):
    """Trials of every set, and how often each kind of target is chosen at each position."""
    rows = _chosen(spark, sf_dir)
    return rows.groupBy("target_position", (F.col("target_id").cast("long") % 8).alias("phrase")).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("chosen_id") == F.col("target_id"), 1)).alias("n_selected"))


@query("trial_grid", f"{SETS_SQL} SELECT query_id, style, seed, count(*) AS n_trials FROM st, (SELECT unnest({STYLES}) AS style), (SELECT unnest([0, 1]) AS seed) GROUP BY ALL")
def trial_grid(spark, sf_dir):
    """Sets x styles x seeds; the small sides are literal lists."""
    grid = _sets(spark, sf_dir).select("query_id", F.explode(F.array(*map(F.lit, STYLES))).alias("style")).select("query_id", "style", F.explode(F.array(F.lit(0), F.lit(1))).alias("seed"))
    return grid.groupBy("query_id", "style", "seed").agg(F.count(F.lit(1)).alias("n_trials"))


@query("trial_id", f"{SETS_SQL} SELECT query_id, target_id, CAST(target_position AS INTEGER) AS target_position, substr(sha1('[\"' || query_id || '\", [' || array_to_string(list_transform(ids, lambda x: '\"' || x || '\"'), ', ') || '], \"' || target_id || '\", \"m\", \"neutral\", 0, 0.0]'), 1, 12) AS trial_id FROM st")
def trial_id(spark, sf_dir):
    ids = F.concat(F.lit("["), F.array_join(F.transform("ordered_ids", T.json_text), ", "), F.lit("]"))
    return _sets(spark, sf_dir).select("query_id", "target_id", "target_position", T.stable_id(T.json_text(F.col("query_id")), ids, T.json_text(F.col("target_id")), F.lit('"m"'), F.lit('"neutral"'), F.lit("0"), F.lit("0.0")).alias("trial_id"))


@query("build_messages", f"""{SETS_SQL}, lg AS (SELECT query_id, target_id, target_position, generate_subscripts(ids, 1) - 1 AS pos, unnest(ids) AS id FROM st WHERE target_position = 0)
SELECT l.query_id, target_id, sha256(string_agg('【候选 ' || chr(CAST(65 + pos AS INTEGER)) || '】' || a.text, chr(10) ORDER BY pos)) AS prompt_hash FROM lg l JOIN articles a ON CAST(a.doc_id AS VARCHAR) = id GROUP BY 1, 2""")
def build_messages(spark, sf_dir):
    """Prompt of each set, from its candidates' texts in order."""
    texts = articles(spark, sf_dir).select(F.col("doc_id").cast("string").alias("id"), "text")
    long = _sets(spark, sf_dir).where("target_position = 0").select("query_id", "target_id", F.posexplode("ordered_ids").alias("pos", "id")).join(texts, "id")
    part = F.concat(F.lit("【候选 "), F.char(F.col("pos") + 65), F.lit("】"), "text")
    parts = F.transform(F.sort_array(F.collect_list(F.struct("pos", part.alias("t")))), lambda x: x["t"])  # as many as a set has members
    return long.groupBy("query_id", "target_id").agg(F.sha2(F.array_join(parts, "\n"), 256).alias("prompt_hash"))


def _json(x: str) -> str:
    for raw, said in (("'\\'", "'\\\\'"), ("'\"'", "'\\\"'"), ("chr(10)", "'\\n'"), ("chr(13)", "'\\r'"), ("chr(9)", "'\\t'")):
        x = f"replace({x}, {raw}, {said})"
    return f"'\"' || {x} || '\"'"


def _text(x: str) -> str:
    return " || chr(10) || ".join("'" + part.replace("'", "''") + "'" for part in x.split("\n"))


CHAIN_STYLES = ["neutral", "critical_eval"]
SAID_SQL = "CASE style " + " ".join(f"WHEN '{k}' THEN {_text(P.STYLES[k])}" for k in CHAIN_STYLES) + " END"
CHAIN_SQL = f"""{CHOICE_SQL}, tx AS (SELECT CAST(doc_id AS VARCHAR) AS id, text FROM articles), sc AS (SELECT lg.*, text, round(greatest(1.0, 40.0 * pow(0.85, pos) + content), 6) AS s FROM lg JOIN ct USING (id) JOIN tx USING (id)),
pm AS (SELECT query_id, target_id, target_position, string_agg('【候选 ' || chr(CAST(65 + pos AS INTEGER)) || '】' || chr(10) || text, chr(10) || chr(10) ORDER BY pos) AS block, count(DISTINCT id) FILTER (s >= {P.CITED_SHARE} * top) AS n_chosen, bool_or(id = target_id AND s >= {P.CITED_SHARE} * top) AS y
 FROM (SELECT *, max(s) OVER (PARTITION BY query_id, target_id, target_position) AS top FROM sc) GROUP BY 1, 2, 3),
us AS (SELECT *, {_text("问题(d):")} || chr(10) || 'about ' || query_id || chr(10) || chr(10) || {SAID_SQL} || chr(10) || chr(10) || block || chr(10) || chr(10) || {_text(P.CONTRACTS["cite"])} AS said FROM pm, (SELECT unnest({CHAIN_STYLES}) AS style)),
rq AS (SELECT *, sha256('{{"max_tokens": {P.MAX_TOKENS["cite"]}, "messages": [{{"content": ' || {_json(_text(P.ROLES["cite"] + P.CONTRACTS["cite"]))} || ', "role": "system"}}, {{"content": ' || {_json("said")} || ', "role": "user"}}], "model": "m", "seed": 0}}') AS request_hash FROM us)"""


@query("answer_chain", f"{CHAIN_SQL} SELECT query_id, target_id, CAST(target_position AS INTEGER) AS target_position, style AS prompt_style, request_hash, CAST(y AS INTEGER) AS y, CAST(n_chosen AS INTEGER) AS n_chosen, 1 AS parse_ok, true AS all_decided_first, CAST(0 AS BIGINT) AS decided_again FROM rq")
def answer_chain(spark, sf_dir):
    """Prompts of all sets, answers by citing, parsed; run a second time, when every answer is stored already."""
    questions = articles(spark, sf_dir).select("query_id").distinct().select("query_id", F.concat(F.lit("about "), "query_id").alias("question"), F.lit("d").alias("domain"))
    requests = P.requests_of(_sets(spark, sf_dir), articles(spark, sf_dir).select(F.col("doc_id").cast("string").alias("id"), "text"), questions, ["m"], CHAIN_STYLES, (0,), "cite")
    requests = stored(requests, "requests")
    answers = P.Answers(spark, scratch(spark, "answers"))
    _, first = P.run_chain(answers, requests)
    trials, again = P.run_chain(answers, requests)
    n = requests.select("request_hash").distinct().count()
    return trials.select("query_id", "target_id", "target_position", "prompt_style", "request_hash", "y", "n_chosen", "parse_ok", F.lit(first == n).alias("all_decided_first"), F.lit(again).cast("long").alias("decided_again"))


@query("rewrite_chain", f"""WITH q AS (SELECT item_id, text AS question, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS whole, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM benchmark),
p AS (SELECT *, greatest(1, CAST(ceil(len(w) / 2.0) AS BIGINT)) AS n FROM q), l AS (SELECT *, list_filter([whole, array_to_string(w[1:n], ' '), array_to_string(w[n + 1:2 * n], ' ')], lambda x: trim(x) <> '') AS qs FROM p)
SELECT 'm' AS model, item_id, array_to_string(list_filter(qs, lambda x, i: list_position(qs, x) = i), ';') AS queries, len(qs) > 0 AS parse_ok FROM l""")
def rewrite_chain(spark, sf_dir):
    """Every question rewritten to search queries by prompt, stored answer and parser."""
    questions = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"), F.lit("").alias("domain"))
    found, _ = P.rewritten(questions, P.Answers(spark, scratch(spark, "rewrites")), ["m"])
    return found.select("model", F.col("query_id").alias("item_id"), F.array_join("queries", ";").alias("queries"), "parse_ok")


@query("call_plan", f"{SETS_SQL}, m AS (SELECT CAST(floor(avg(length(text)) * 0.7) AS BIGINT) AS t FROM articles), n AS (SELECT count(*) AS n FROM st) SELECT n AS n_sets, t AS avg_input_tokens, n * 48 AS n_calls, t * n * 48 AS est_input_tokens, n * 48 * 16 AS est_output_tokens, round(t * n * 48 / 1e6 * 2 + n * 48 * 16 / 1e6 * 6, 6) AS est_cost_usd FROM m, n")
def call_plan(spark, sf_dir):
    return rounded(D.call_plan(_sets(spark, sf_dir), articles(spark, sf_dir).select("n_chars"), 6, 4, 2))


@query("trial_enrich_join", f"{CHOICE_SQL} SELECT c.query_id, target_id, CAST(target_position AS INTEGER) AS target_position, a.domain, a.dim, a.generator, a.variant, CASE WHEN chosen_id = target_id THEN 1 ELSE 0 END AS y FROM ch c JOIN articles a ON CAST(a.doc_id AS VARCHAR) = target_id")
def trial_enrich_join(spark, sf_dir):
    """Trials with their target's columns and the entries of its map of further ones."""
    meta = F.create_map(F.lit("generator"), "generator", F.lit("variant"), "variant")
    a = articles(spark, sf_dir).select(F.col("doc_id").cast("string").alias("target_id"), "domain", "dim", meta.alias("meta"))
    rows = D.spread_map(_chosen(spark, sf_dir).join(a, "target_id"), "meta")
    return rows.select("query_id", "target_id", "target_position", "domain", "dim", "generator", "variant", F.when(F.col("chosen_id") == F.col("target_id"), 1).otherwise(0).alias("y"))


@query("trial_flatten", f"{CHOICE_SQL} SELECT query_id, target_id, CAST(target_position AS INTEGER) AS target_position, CASE WHEN chosen_id = target_id THEN 1 ELSE 0 END AS y, CASE WHEN chosen_id = target_id THEN 0 ELSE -1 END AS target_rank FROM ch")
def trial_flatten(spark, sf_dir):
    """Maps of a trial (y, rank) looked up at the target, with defaults."""
    nested = _chosen(spark, sf_dir).select("query_id", "target_id", "target_position", F.create_map("chosen_id", F.lit(1)).alias("y"), F.create_map("chosen_id", F.lit(0)).alias("rank"))
    at = lambda m, d: F.coalesce(F.try_element_at(F.col(m), F.col("target_id")), F.lit(d))
    return nested.select("query_id", "target_id", "target_position", at("y", 0).alias("y"), at("rank", -1).alias("target_rank"))


def _replies(spark, sf_dir) -> DataFrame:
    """Conversation turns wrapped as answers in every form that the parsers know: id, ids (three candidates), reply, question."""
    k = F.col("conv_id") * 8 + F.col("turn")
    prose = F.translate(F.coalesce("text", F.lit("")), '{}`"\\', "")
    words = F.filter(F.split(prose, r"\s+"), lambda w: w != "")
    q1, q2 = F.array_join(F.slice(words, 1, 3), " "), F.array_join(F.slice(words, 4, 2), " ")
    with_prose = lambda before, after: F.concat(F.lit(before), prose, F.lit(after))
    forms = [
        F.lit('{"choice": "A"}'),
        F.concat(prose, F.lit('\n{"choice": " b", "scores": {"A": 0.25, "B": "x", "C": 7}, "ranking": ["C", "A", "C"]}')),
        F.concat(F.lit('{"choice": "Z"} '), prose),
        F.concat(F.lit('I would say:\n{"choice": "C", "reason": "'), q1, F.lit('"} as it is best. '), prose),
        F.concat(F.lit('```json\n{"cited": ["A", "C", "A"]}\n```\n'), prose),
        prose,
        F.lit('{"cited": [], "scores": {"c": "1.5", "D": 2}}'),
        with_prose("<think>", ' {"choice": "B"}</think>\n{"choice": "A"}'),
        F.concat(F.lit('{"queries": ["'), q1, F.lit('", " '), q2, F.lit(' ", "'), q1, F.lit('", ""]}')),
        F.concat(prose, F.lit('\n{"cited": ["Q"]}')),
    ]
    ids = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.concat(F.lit("c"), (k + i).cast("string")))
    rows = table(spark, sf_dir, "conversations")
    return rows.select(k.alias("id"), ids.alias("ids"), F.element_at(F.array(*forms), (k % 10 + 1).cast("int")).alias("reply"), F.concat(F.lit("question "), k.cast("string")).alias("question"))


REPLIES_SQL = """WITH w AS (SELECT conv_id * 8 + turn AS id, translate(coalesce(text, ''), '{}`"\\', '') AS prose FROM conversations),
v AS (SELECT *, list_filter(regexp_split_to_array(prose, '\\s+'), lambda x: x <> '') AS ws, chr(10) AS nl FROM w), q AS (SELECT *, array_to_string(ws[1:3], ' ') AS q1, array_to_string(ws[4:5], ' ') AS q2 FROM v),
e AS (SELECT id, 'question ' || CAST(id AS VARCHAR) AS question, ['c' || CAST(id AS VARCHAR), 'c' || CAST(id + 1 AS VARCHAR), 'c' || CAST(id + 2 AS VARCHAR)] AS ids, CASE id % 10 WHEN 0 THEN '{"choice": "A"}'
 WHEN 1 THEN prose || nl || '{"choice": " b", "scores": {"A": 0.25, "B": "x", "C": 7}, "ranking": ["C", "A", "C"]}' WHEN 2 THEN '{"choice": "Z"} ' || prose WHEN 3 THEN 'I would say:' || nl || '{"choice": "C", "reason": "' || q1 || '"} as it is best. ' || prose
 WHEN 4 THEN '```json' || nl || '{"cited": ["A", "C", "A"]}' || nl || '```' || nl || prose WHEN 5 THEN prose WHEN 6 THEN '{"cited": [], "scores": {"c": "1.5", "D": 2}}' WHEN 7 THEN '<think>' || prose || ' {"choice": "B"}</think>' || nl || '{"choice": "A"}'
 WHEN 8 THEN '{"queries": ["' || q1 || '", " ' || q2 || ' ", "' || q1 || '", ""]}' ELSE prose || nl || '{"cited": ["Q"]}' END AS reply FROM q),
sr AS (SELECT id, ids, question, regexp_replace(regexp_replace(reply, '<think>.*?</think>\\s*', '', 'gs'), '^\\s+|\\s+$', '', 'g') AS r FROM e),
js AS (SELECT *, nullif(regexp_extract(r, '(?s)(\\{"(?:choice|cited|queries)".*\\})', 1), '') AS j FROM sr)"""


@query("strip_thinking", f"{REPLIES_SQL} SELECT id, r AS reply FROM sr")
def strip_thinking(spark, sf_dir):
    return _replies(spark, sf_dir).select("id", T.strip_thinking(F.col("reply")).alias("reply"))


FLAT_SQL = "list_extract(regexp_extract_all({}, '(\\{{[^{{}}]*\\}})', 1), -1)"


@query("extract_json_flat", f"{REPLIES_SQL} SELECT id, {FLAT_SQL.format('reply')} AS flat FROM e")
def extract_json_flat(spark, sf_dir):
    return _replies(spark, sf_dir).select("id", D.flat_json(F.col("reply")).alias("flat"))


@query("extract_json", f"{REPLIES_SQL} SELECT id, coalesce(json_extract_string(j, '$.choice'), '') AS choice, coalesce(CAST(json_array_length(j, '$.cited') AS INTEGER), -1) AS n_cited, j IS NOT NULL AS found FROM js")
def extract_json(spark, sf_dir):
    """Any nested object, by the brace scanner; shown by two of its fields."""
    got = _replies(spark, sf_dir).select("id", D.extract_json(T.strip_thinking(F.col("reply"))).alias("o"))
    data = F.from_json("o", "choice STRING, cited ARRAY<STRING>")
    return got.select("id", F.coalesce(data["choice"], F.lit("")).alias("choice"), F.coalesce(F.size(data["cited"]), F.lit(-1)).alias("n_cited"), F.col("o").isNotNull().alias("found"))


@query("parse_decision", f"""{REPLIES_SQL}, p AS (SELECT *, json_type(j, '$.cited') = 'ARRAY' AS many, json_extract_string(j, '$.cited[*]') AS cited, upper(substr(trim(json_extract_string(j, '$.choice')), 1, 1)) AS choice, coalesce(json_keys(j, '$.scores'), []) AS ks, json_extract_string(j, '$.ranking[*]') AS rk FROM js),
n AS (SELECT *, list_filter(list_distinct(cited), lambda x: x IN ('A', 'B', 'C')) AS named, list_filter(list_transform(ks, lambda k: struct_pack(p := ascii(upper(k)) - 64, v := TRY_CAST(json_extract_string(j, '$.scores.' || k) AS DOUBLE))), lambda z: z.p <= 3 AND z.v IS NOT NULL) AS sc FROM p)
SELECT id, array_to_string(list_sort(CASE WHEN many THEN list_transform(named, lambda x: ids[ascii(x) - 64]) WHEN choice IN ('A', 'B', 'C') THEN [ids[ascii(choice) - 64]] ELSE [] END), ',') AS chosen_ids,
 array_to_string(list_sort(list_transform(sc, lambda z: ids[z.p] || '=' || CAST(z.v AS VARCHAR))), ',') AS scores,
 array_to_string(list_sort(list_transform(list_filter(['A', 'B', 'C'], lambda x: list_contains(rk, x)), lambda x: ids[ascii(x) - 64] || '=' || CAST(len(rk) - list_position(list_reverse(rk), x) AS VARCHAR))), ',') AS ranks,
 j IS NOT NULL AND CASE WHEN many THEN len(cited) = 0 OR len(named) > 0 ELSE coalesce(choice IN ('A', 'B', 'C'), false) END AS parse_ok FROM n""")
def parse_decision(spark, sf_dir):
    found = _replies(spark, sf_dir).select("id", "ids", D.extract_json(T.strip_thinking(F.col("reply"))).alias("o"))
    d = found.select("id", D.parse_decision(F.col("o"), F.col("ids")).alias("d"))
    shown = lambda m: F.array_join(F.array_sort(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))), ",")
    return d.select("id", F.array_join(F.array_sort("d.chosen_ids"), ",").alias("chosen_ids"), shown("d.scores").alias("scores"), shown("d.ranks").alias("ranks"), F.col("d.parse_ok").alias("parse_ok"))


@query("parse_rewrite", f"""{REPLIES_SQL}, p AS (SELECT id, question, list_filter(list_transform(json_extract_string(j, '$.queries[*]'), lambda x: trim(x)), lambda x: x <> '') AS qs FROM js),
d AS (SELECT id, question, list_filter(qs, lambda x, i: list_position(qs, x) = i)[1:8] AS qs FROM p) SELECT id, CASE WHEN len(qs) > 0 THEN array_to_string(qs, ';') ELSE question END AS queries, coalesce(len(qs) > 0, false) AS parse_ok FROM d""")
def parse_rewrite(spark, sf_dir):
    found = _replies(spark, sf_dir).select("id", "question", D.extract_json(T.strip_thinking(F.col("reply"))).alias("o"))
    got = found.select("id", D.parse_rewrite(F.col("o"), F.col("question")).alias("d"))
    return got.select("id", F.array_join("d.queries", ";").alias("queries"), F.col("d.parse_ok").alias("parse_ok"))


@query("rewrite_reuse", "WITH w AS (SELECT DISTINCT user_id, event_type FROM events), d AS (SELECT DISTINCT user_id, event_type FROM events WHERE value > 90) SELECT user_id, event_type, CASE WHEN EXISTS (SELECT 1 FROM d WHERE d.user_id = w.user_id AND d.event_type = w.event_type) THEN 'reuse' ELSE 'send' END AS action FROM w")
def rewrite_reuse(spark, sf_dir):
    """Jobs whose answer is stored are reused, the others sent."""
    events = table(spark, sf_dir, "events").select("user_id", "event_type", "value")
    want, done = events.select("user_id", "event_type").distinct(), events.where("value > 90").select("user_id", "event_type").distinct()
    reuse = want.join(done, ["user_id", "event_type"], "left_semi").withColumn("action", F.lit("reuse"))
    return reuse.unionByName(want.join(done, ["user_id", "event_type"], "left_anti").withColumn("action", F.lit("send")))


@query("power_n", f"""WITH r AS (SELECT o_orderpriority AS model, avg(CASE WHEN l_quantity > 30 THEN 1.0 ELSE 0 END) AS p1 FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1), q AS (SELECT model, p1, p1 / (1 - p1) * 1.5 / (1 + p1 / (1 - p1) * 1.5) AS p2 FROM r)
SELECT model, round(p1, 6) AS p1, round(p2, 6) AS p2, CAST(ceil(pow(1.959963984540054 * sqrt(2 * (p1 + p2) / 2 * (1 - (p1 + p2) / 2)) + 0.8416212335729143 * sqrt(p1 * (1 - p1) + p2 * (1 - p2)), 2) / pow(p1 - p2, 2)) AS BIGINT) AS n FROM q""")
def power_n(spark, sf_dir):
    """Trials for each model to find an odds ratio of 1.5 on top of its own selection rate."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity").join(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), F.col("l_orderkey") == F.col("o_orderkey"))
    rate = line.groupBy(F.col("o_orderpriority").alias("model")).agg(F.avg(F.when(F.col("l_quantity") > 30, 1.0).otherwise(0.0)).alias("p1"))
    odds = F.col("p1") / (1 - F.col("p1")) * 1.5
    return rounded(rate.withColumn("p2", odds / (1 + odds)).withColumn("n", D.n_for_power(F.col("p1"), F.col("p2"))))


# n-gram metrics -----------------------------------------------------------------------------------------------------

CANDS_SQL = "cd AS (SELECT conv_id * 1000 + turn AS id, conv_id, turn, CASE WHEN conv_id % 5 = 0 THEN '' ELSE regexp_replace(coalesce(text, ''), '\\s+', '', 'g') END AS text FROM conversations WHERE role = 'assistant'), rf AS (SELECT c.id, CASE WHEN u.turn < c.turn THEN 0 ELSE 1 END AS ref_no, regexp_replace(coalesce(u.text, ''), '\\s+', '', 'g') AS text FROM cd c JOIN conversations u ON u.conv_id = c.conv_id AND u.role = 'user' AND (u.turn = c.turn - 1 OR u.turn = c.turn + 1)), ca AS (SELECT * FROM cd WHERE id IN (SELECT id FROM rf))"
NG_SQL = "nc AS (SELECT id, n, gram, count(*) AS c FROM (SELECT id, n, unnest(list_transform(range(1, length(text) - n + 2), lambda i: substr(text, i, n))) AS gram FROM ca, (SELECT unnest([1, 2, 3, 4]) AS n)) GROUP BY 1, 2, 3), nr AS (SELECT id, n, gram, max(c) AS most FROM (SELECT id, ref_no, n, gram, count(*) AS c FROM (SELECT id, ref_no, n, unnest(list_transform(range(1, length(text) - n + 2), lambda i: substr(text, i, n))) AS gram FROM rf, (SELECT unnest([1, 2, 3, 4]) AS n)) GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3), mt AS (SELECT id, n, CAST(sum(least(c, coalesce(most, 0))) AS BIGINT) AS matched, CAST(sum(c) AS BIGINT) AS total FROM nc LEFT JOIN nr USING (id, n, gram) GROUP BY id, n)"
MRC_SQL = f"WITH {CANDS_SQL}, {NG_SQL}"


def _answers(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Assistant turns as answers, the user turns before and after as references; a fifth of the conversations have no answer.

    The question's type goes by its id; labels by the parity of a text's length; entities are a reference's first words.
    """
    turns = spread(table(spark, sf_dir, "conversations")).select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    label = lambda t: F.when(F.length(S.normalize(t)) % 2 == 0, "Yes").otherwise("No")
    i = F.col("conv_id") * 1000 + F.col("turn")
    said = turns.where("role = 'assistant'").select(i.alias("id"), "conv_id", "turn", "text")
    preds = said.where("conv_id % 5 <> 0").select("id", F.array("text").alias("answers"), F.array(label(F.col("text"))).alias("yesno_answers"))
    near = said.select("id", "conv_id", F.explode(F.array(F.struct(F.lit(0).alias("ref_no"), (F.col("turn") - 1).alias("turn")), F.struct(F.lit(1).alias("ref_no"), (F.col("turn") + 1).alias("turn")))).alias("r")).select("id", "conv_id", "r.*")
    near = near.join(turns.where("role = 'user'").select("conv_id", "turn", "text"), ["conv_id", "turn"])
    refs = near.groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("ref_no", "text"))), lambda x: x["text"]).alias("answers"))  # at most two
    kind = F.element_at(F.array(F.lit("ENTITY"), F.lit("YES_NO"), F.lit("DESCRIPTION")), (F.floor(F.col("id") / 1000) % 3 + 1).cast("int"))
    words = lambda t: F.slice(F.filter(F.split(t, r"\s+"), lambda w: w != ""), 1, 3)
    return preds, refs.select("id", kind.alias("question_type"), "answers", F.transform("answers", label).alias("yesno_answers"), F.transform("answers", words).alias("entity_answers"))


def _scored(spark, sf_dir) -> DataFrame:
    return S.questions_scored(*_answers(spark, sf_dir))


@query("mrc_normalize", "SELECT conv_id, turn, regexp_replace(coalesce(text, ''), '\\s+', '', 'g') AS answer, count(*) OVER (PARTITION BY conv_id, turn) > 1 AS repeated FROM conversations")
def mrc_normalize(spark, sf_dir):
    from pyspark.sql import Window

    rows = table(spark, sf_dir, "conversations")
    return rows.select("conv_id", "turn", S.normalize(F.col("text")).alias("answer"), (F.count(F.lit(1)).over(Window.partitionBy("conv_id", "turn")) > 1).alias("repeated"))


@query("mrc_files", "SELECT CAST(conv_id * 1000 + turn AS VARCHAR) AS question_id, role AS question_type, regexp_replace(coalesce(text, ''), '\\s+', '', 'g') AS answer, CAST(CASE WHEN turn % 2 = 0 THEN 1 ELSE 0 END AS INTEGER) AS n_yesno FROM conversations")
def mrc_files(spark, sf_dir):
    """Answers written as JSON lines, every third turn's in zip archives, and read back."""
    rows = table(spark, sf_dir, "conversations")
    yesno = F.when(F.col("turn") % 2 == 0, F.array(F.lit("Yes"))).otherwise(F.array().cast("array<string>"))
    said = rows.select("turn", (F.col("conv_id") * 1000 + F.col("turn")).cast("string").alias("question_id"), F.col("role").alias("question_type"), F.array(F.coalesce("text", F.lit(""))).alias("answers"), yesno.alias("yesno_answers"))
    path = scratch(spark, "answer-files")
    said.where("turn % 3 <> 0").drop("turn").write.json(f"{path}/plain")
    write_zipped_lines(said.where("turn % 3 = 0").drop("turn"), f"{path}/zipped")
    got = read_answer_files(spark, path)
    return got.select("question_id", "question_type", S.normalize(F.get("answers", 0)).alias("answer"), F.size("yesno_answers").alias("n_yesno"))


@query("char_ngrams", "SELECT n, gram, count(*) AS c FROM (SELECT n, unnest(list_transform(range(1, length(text) - n + 2), lambda i: substr(text, i, n))) AS gram FROM (SELECT regexp_replace(coalesce(text, ''), '\\s+', '', 'g') AS text FROM benchmark), (SELECT unnest([1, 2, 3, 4]) AS n)) GROUP BY 1, 2")
def char_ngrams(spark, sf_dir):
    return S.ngram_counts(table(spark, sf_dir, "benchmark").select(S.normalize(F.col("text")).alias("text")), [], "text")


@query("clipped_match", f"{MRC_SQL} SELECT id, n, matched, total FROM mt")
def clipped_match(spark, sf_dir):
    return S.clipped_matches(_scored(spark, sf_dir))


LEN_SQL = "ln AS (SELECT ca.id, any_value(length(ca.text)) AS c, arg_min(length(rf.text), (abs(length(ca.text) - length(rf.text)), length(rf.text))) AS r FROM ca JOIN rf USING (id) GROUP BY ca.id), bp AS (SELECT exp(least(1 - sum(r) / sum(c), 0)) AS bp FROM ln)"


def _bleu_sql(source: str) -> str:
    return f"pv AS (SELECT {', '.join(f'sum(matched) FILTER (n = {n}) / sum(total) FILTER (n = {n}) AS p{n}' for n in range(1, 5))} FROM {source}) SELECT " + ", ".join(f"round(pow({' * '.join(f'p{i}' for i in range(1, n + 1))}, 1.0 / {n}) * bp, 6) AS bleu_{n}" for n in range(1, 5)) + " FROM pv, bp"


@query("bleu4", f"{MRC_SQL}, {LEN_SQL}, {_bleu_sql('mt')}")
def bleu4(spark, sf_dir):
    return rounded(S.bleu(_scored(spark, sf_dir)))


#: Bonus references: those with the answer's label for YES_NO questions, the entities for ENTITY ones.
BONUS_SQL = """yb AS (SELECT ca.id, rf.ref_no, rf.text FROM ca JOIN rf USING (id) WHERE ca.id // 1000 % 3 = 1 AND ca.conv_id % 5 <> 0 AND length(ca.text) % 2 = length(rf.text) % 2
 UNION ALL SELECT id, 10 * ref_no + pos, word FROM (SELECT c.id, CASE WHEN u.turn < c.turn THEN 0 ELSE 1 END AS ref_no, generate_subscripts(w, 1) AS pos, unnest(w) AS word
  FROM ca c JOIN (SELECT conv_id, turn, list_filter(regexp_split_to_array(coalesce(text, ''), '\\s+'), lambda x: x <> '')[1:3] AS w FROM conversations WHERE role = 'user') u ON u.conv_id = c.conv_id AND (u.turn = c.turn - 1 OR u.turn = c.turn + 1) WHERE c.id // 1000 % 3 = 0)),
br AS (SELECT id, n, gram, max(c) AS most FROM (SELECT id, ref_no, n, gram, count(*) AS c FROM (SELECT id, ref_no, n, unnest(list_transform(range(1, length(text) - n + 2), lambda i: substr(text, i, n))) AS gram FROM yb, (SELECT unnest([1, 2, 3, 4]) AS n)) GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3),
bt AS (SELECT id, n, CAST(sum(least(c, most)) AS BIGINT) AS matched FROM nc JOIN br USING (id, n, gram) GROUP BY id, n)"""


@query("bleu4_bonus", f"{MRC_SQL}, {LEN_SQL}, {BONUS_SQL}, mb AS (SELECT n, matched, total FROM mt UNION ALL SELECT n, matched, matched FROM bt), {_bleu_sql('mb')}")
def bleu4_bonus(spark, sf_dir):
    """BLEU with bonuses: n-grams shared with references of the answer's label, or with entities, count again above and below the line."""
    return rounded(S.bleu(_scored(spark, sf_dir), bonus=True))


@query("rouge_l")
def rouge_l(spark, sf_dir):
    """ROUGE-L with label and entity bonuses."""
    return rounded(S.rouge(_scored(spark, sf_dir)))


@query("mrc_report")
def mrc_report(spark, sf_dir):
    return S.report(_scored(spark, sf_dir))


@query("mrc_unique", "SELECT CAST(count(*) AS BIGINT) AS n_repeated FROM (SELECT conv_id, turn FROM conversations GROUP BY ALL HAVING count(*) > 1)")
def mrc_unique(spark, sf_dir):
    """How many question ids occur more than once: a file of answers must have none."""
    return S.repeated_ids(table(spark, sf_dir, "conversations"), ["conv_id", "turn"])
