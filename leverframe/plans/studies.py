"""Queries on whole studies: articles assembled from designs, sets, trials and tables, with the same chain as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leverframe.codebook import DOMAINS, FACTORS, TOP
from leverframe.functions import text as T
from leverframe.operators import information as I
from leverframe.operators import models as M
from leverframe.operators import prompts as P
from leverframe.operators import studies as S
from leverframe.operators import trials as D
from leverframe.plans.effects import BD_EI, KL, _strata_sql, ate_sql, ei_sql, pate_sql
from leverframe.plans.registry import query, rounded
from leverframe.sources.files import scratch
from leverframe.sources.tables import spread, table

MODELS = ["model-a", "model-b"]


def questions(spark, sf_dir) -> DataFrame:
    """The benchmark's items as questions: query_id, domain, core (their whole text)."""
    i = F.col("item_id")
    domain = F.element_at(F.array(*map(F.lit, DOMAINS)), (i % 5 + 1).cast("int"))
    return table(spark, sf_dir, "benchmark").select(F.concat(F.lit("q"), i.cast("string")).alias("query_id"), domain.alias("domain"), F.col("text").alias("core"))


def _list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _said(seed: str, family: str) -> str:
    pick = f"1 + CAST('0x' || substr(sha1({seed} || '|{family}'), 1, 8) AS BIGINT) % {len(S.PHRASES[family])}"
    return f"replace(list_extract({_list(S.PHRASES[family])}, {pick}), '{{core}}', core)"


def text_ctes(source: str, seed: str, fake: str, out: str) -> str:
    """CTEs from ``source`` (with core and S1..O4) to ``out``, the same with text."""
    said = lambda family: _said(seed, family)
    nl = "chr(10)"
    return f"""{out}_p AS (SELECT *, list_filter([{said('opener')}, CASE WHEN S4 > 0 THEN {said('S4')} END, CASE WHEN S1 = 1 THEN {said('S1.vague')} WHEN S1 > 1 THEN CASE WHEN {fake} THEN {said('S1.fake')} ELSE {said('S1.solid')} END END,
 CASE WHEN S3 > 0 THEN CASE WHEN {fake} THEN {said('S3.fake')} ELSE {said('S3')} END END, CASE WHEN S2 > 0 THEN {said('S2')} END], lambda x: x IS NOT NULL) AS ps FROM {source}),
{out}_b AS (SELECT *, CASE WHEN O4 > 0 THEN list_concat([regexp_replace(ps[1], '。+$', '') || CASE WHEN O4 = 2 THEN {said('bound')} ELSE {said('adjacent')} END], ps[2:]) ELSE list_concat(list_concat(ps[1:1], ps[3:]), ps[2:2]) END AS b1 FROM {out}_p),
{out}_c AS (SELECT *, CASE WHEN O2 = 1 THEN list_concat([{said('lead')}], b1) ELSE list_concat(b1, [{said('tail')}]) END AS b2 FROM {out}_b),
{out}_d AS (SELECT *, CASE WHEN O1 = 1 THEN array_to_string(list_transform(b2, lambda x: '- ' || x), {nl}) ELSE array_to_string(b2, '') END AS b3 FROM {out}_c),
{out} AS (SELECT *, CASE WHEN O3 = 1 THEN '## 适用场景' || {nl} || core || {nl} || '## 分析' || {nl} || b3 || {nl} || '## 结论' || {nl} || '见上。' ELSE b3 END AS text FROM {out}_d)"""


def _id(suffix: str, authenticity: str) -> str:
    profile = "'{' || " + " || ', ' || ".join(f"'\"{f}\": ' || CAST({f} AS VARCHAR)" for f in sorted(FACTORS)) + " || '}'"
    return f"substr(sha1('[\"art\", \"' || query_id || '\", ' || {profile} || ', \"' || {authenticity} || '\", \"' || {suffix} || '\"]'), 1, 12)"


def _uniform(*parts: str) -> str:
    return f"(CAST('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 8) AS BIGINT) / 4294967296.0)"


def _points(rows: list[tuple]) -> str:
    """VALUES of (point, label, role, target_dim, variant, authenticity, S1..O4)."""
    sql = lambda v: "NULL" if v is None else str(v) if isinstance(v, int) else f"'{v}'"
    return "(VALUES " + ", ".join("(" + ", ".join(map(sql, (i, *r))) + ")" for i, r in enumerate(rows)) + f") AS t(point, label, role, target_dim, variant, authenticity, {', '.join(FACTORS)})"


OFAT_POINTS = [(f"pair_{f}", role, f, None, "genuine", *[(t * TOP[f] if g == f else TOP["S1"] if f == "O4" and g == "S1" else 0) for g in FACTORS]) for f in FACTORS for t, role in ((0, "control"), (1, "treatment"))]
FAKE_POINTS = [(f"{f}-{v}", v, f, v, "fake" if v == "fake" else "genuine", *[TOP[g] if g == f and v != "none" else 0 for g in FACTORS]) for f in S.FAKEABLE for v in ("none", "genuine", "fake")]


def frame_sql(points: list[tuple], styles=("neutral",), models=MODELS) -> str:
    """CTEs from the benchmark to ``fr``, the trial frame of a study."""
    key = "model, prompt_style, CAST(seed AS VARCHAR), target_id, CAST(target_position AS VARCHAR)"
    content = " + ".join("{w} * ((length(text) - length(replace(text, {m}, ''))) // {n})".format(w=w, m="chr(10) || '- '" if m == "\n- " else f"'{m}'", n=len(m)) for m, w in D.MARKER_WEIGHTS.items())
    flips = ", ".join(f"CAST(CASE WHEN {_uniform('seed', chr(39) + f + chr(39))} < {S.FLIP_SHARE} THEN {TOP[f]} ELSE 0 END AS INTEGER) AS {f}" if f in S.FLIPS else f"0 AS {f}" for f in FACTORS)
    suffix = "label || '-' || role || '-' || CAST(point AS VARCHAR)"
    distract = "'distract' || CAST(i AS VARCHAR)"
    genuine = "'genuine'"
    return f"""WITH qs AS (SELECT 'q' || CAST(item_id AS VARCHAR) AS query_id, list_extract({_list(DOMAINS)}, item_id % 5 + 1) AS domain, text AS core FROM benchmark),
tg0 AS (SELECT qs.*, t.* FROM qs, {_points(points)}), {text_ctes('tg0', 'query_id', "authenticity = 'fake'", 'tgt')},
tg AS (SELECT *, {_id(suffix, 'authenticity')} AS target_id, query_id || '|' || label AS pair_id FROM tgt),
ds0 AS (SELECT *, query_id || '|distract' || CAST(i AS VARCHAR) AS seed FROM qs, (SELECT unnest([0, 1, 2, 3]) AS i)), ds1 AS (SELECT *, {flips} FROM ds0), {text_ctes('ds1', 'seed', 'false', 'dst')},
ds AS (SELECT *, {_id(distract, genuine)} AS id FROM dst),
sh AS (SELECT query_id, list(id ORDER BY r) AS comp FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY sha1(query_id || '|' || id)) AS r FROM ds) WHERE r <= 2 GROUP BY query_id),
st AS (SELECT query_id, target_id, pos AS target_position, list_concat(list_concat(comp[1:pos], [target_id]), comp[pos + 1:2]) AS ids FROM tg JOIN sh USING (query_id), (SELECT unnest([0, 1, 2]) AS pos)),
gr AS (SELECT *, 0 AS seed FROM st, (SELECT unnest({_list(models)}) AS model), (SELECT unnest({_list(styles)}) AS prompt_style)),
tx AS (SELECT target_id AS id, any_value({content}) AS content FROM tg GROUP BY target_id UNION SELECT id, {content} FROM ds),
lg AS (SELECT *, generate_subscripts(ids, 1) - 1 AS p, unnest(ids) AS id FROM gr),
sc0 AS (SELECT lg.*, round(greatest(1.0, 40.0 * pow(0.85, p) + content + 16.0 * ({_uniform(key, 'CAST(p AS VARCHAR)')} - 0.5)), 6) AS s FROM lg JOIN tx USING (id)),
ch AS (SELECT query_id, model, prompt_style, seed, target_id, target_position, arg_max(id, (s, -p)) AS chosen_id, {_uniform(key, "'parse'")} < 0.05 AS bad, {_uniform(key, "'api'")} < 0.04 AS refused FROM sc0 GROUP BY ALL),
fr AS (SELECT ch.query_id, domain, model, prompt_style, seed, target_id, target_position, label, role, target_dim, variant, authenticity, pair_id, {', '.join(FACTORS)},
 CASE WHEN bad OR refused THEN 0 ELSE 1 END AS parse_ok, CASE WHEN refused THEN 'content_filter' ELSE '' END AS api_error, CASE WHEN chosen_id = target_id AND NOT bad AND NOT refused THEN 1 ELSE 0 END AS y FROM ch JOIN (SELECT DISTINCT ON (target_id) * FROM tg) USING (target_id)),
sc AS (SELECT *, target_dim AS factor, CASE target_dim {' '.join(f"WHEN '{f}' THEN {f}" for f in FACTORS)} END AS level, CASE WHEN target_dim IN ('S1', 'O4') THEN 2 ELSE 1 END AS top,
 concat_ws('|', query_id, model, prompt_style, CAST(target_position AS VARCHAR), CAST(seed AS VARCHAR), pair_id) AS pair_key FROM fr WHERE api_error = '' AND parse_ok = 1)"""


@query("build_targets", f"{frame_sql(OFAT_POINTS)} SELECT query_id, target_id, role, target_dim, pair_id, sha256(text) AS text_hash, length(text) AS n_chars FROM tg")
def build_targets(spark, sf_dir):
    t = S.build_targets(questions(spark, sf_dir), D.ofat_design(spark))
    return t.select("query_id", F.col("article_id").alias("target_id"), "role", "target_dim", "pair_id", F.sha2("text", 256).alias("text_hash"), F.length("text").cast("long").alias("n_chars"))


@query("distractor_pool", f"{frame_sql(OFAT_POINTS)} SELECT query_id, id AS article_id, sha256(text) AS text_hash FROM ds")
def distractor_pool(spark, sf_dir):
    return S.distractor_pool(questions(spark, sf_dir)).select("query_id", "article_id", F.sha2("text", 256).alias("text_hash"))


@query("study_trials", f"{frame_sql(OFAT_POINTS)} SELECT model, target_dim, role, CAST(target_position AS INTEGER) AS target_position, count(*) AS n, CAST(sum(y) AS BIGINT) AS n_selected, CAST(sum(parse_ok) AS BIGINT) AS n_read FROM fr GROUP BY ALL")
def study_trials(spark, sf_dir):
    frame, _ = S.run_study1(questions(spark, sf_dir), MODELS)
    return frame.groupBy("model", "target_dim", "role", "target_position").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("n_selected"), F.sum("parse_ok").cast("long").alias("n_read"))


@query("study1", f"""{frame_sql(OFAT_POINTS)}, {pate_sql('model, factor')}, {ate_sql('sc', 'model, factor')}, {ei_sql('sc', 'model')}
SELECT model, factor, round(p.ATE, 6) AS paired_ate, round(m.ATE, 6) AS marginal_ate, n_pairs, round(EI, 6) AS EI, round(coalesce(EI / nullif(sum(EI) OVER (PARTITION BY model), 0), 0), 6) AS EI_share FROM pate p JOIN mate m USING (model, factor) JOIN ei USING (model, factor)""")
def study1(spark, sf_dir):
    """Paired effects and leverage of each factor, for each model."""
    _, tables = S.run_study1(questions(spark, sf_dir), MODELS)
    return rounded(tables["ate"].select("model", "factor", "paired_ate", "marginal_ate", "n_pairs").join(tables["ei"].select("model", "factor", "EI", "EI_share"), ["model", "factor"]))


def _study2(spark, sf_dir) -> DataFrame:
    return S.study2_frame(questions(spark, sf_dir), MODELS)


@query("study2_coefficients")
def study2_coefficients(spark, sf_dir):
    return rounded(M.logit_with_clusters(_study2(spark, sf_dir), FACTORS, S.PRIORITY))


def _fractional() -> list[tuple]:
    from hashlib import sha1
    from json import dumps

    out = []
    for i in range(16):
        a, b, c, d = (i >> k & 1 for k in range(4))
        levels = dict(zip(FACTORS, (a, b, c, d, a ^ b ^ c, a ^ b ^ d, a ^ c ^ d, b ^ c ^ d), strict=True))
        levels = {f: v * TOP[f] for f, v in levels.items()}
        label = "p" + str(int(sha1(dumps(levels, sort_keys=True).encode()).hexdigest()[:6], 16))
        out.append((label, "point", None, None, "genuine", *levels.values()))
    return out


@query("study2_leverage", f"{frame_sql(_fractional())}, {_strata_sql().replace('FROM obs', 'FROM fr')}, {BD_EI} SELECT factor, round(b, 6) AS EI FROM bei")
def study2_leverage(spark, sf_dir):
    """Leverage by adjustment on the factorial's trials, unread ones included."""
    return rounded(I.effective_information(I.backdoor_do(_study2(spark, sf_dir))).select("factor", "EI"))


STYLES3 = ("neutral", "cite_source")


@query("study3", f"{frame_sql(OFAT_POINTS, STYLES3)}, {ei_sql('sc', 'domain')}, {ate_sql('sc', 'domain, factor')} SELECT domain, factor, round(EI, 6) AS EI, round(ATE, 6) AS ATE FROM ei JOIN mate USING (domain, factor)")
def study3(spark, sf_dir):
    """Leverage in each domain, over models and styles."""
    return rounded(S.run_study3(questions(spark, sf_dir), MODELS)[1]["ei_by_domain"].select("domain", "factor", "EI", "ATE"))


@query("study3_rates", f"{frame_sql(OFAT_POINTS, STYLES3)} SELECT model, round(avg(r), 6) AS adj_rate FROM (SELECT model, target_position, avg(y) AS r FROM sc GROUP BY ALL) GROUP BY model")
def study3_rates(spark, sf_dir):
    return rounded(S.run_study3(questions(spark, sf_dir), MODELS)[1]["rates"])


@query("study4", f"""{frame_sql(FAKE_POINTS, ('neutral', 'critical_eval'))}, g AS (SELECT target_dim AS factor, avg(y) FILTER (variant = 'none') AS a, avg(y) FILTER (variant = 'genuine') AS g, avg(y) FILTER (variant = 'fake') AS f FROM fr GROUP BY 1)
SELECT factor, round(a, 6) AS p_none, round(g, 6) AS p_genuine, round(f, 6) AS p_fake, round(f - a, 6) AS deception_gain, round(f / nullif(g, 0), 6) AS vulnerability,
 round(({KL('a', '((a + f) / 2)')} + {KL('f', '((a + f) / 2)')}) / 2 - ({KL('a', '((a + g) / 2)')} + {KL('g', '((a + g) / 2)')}) / 2, 6) AS delta_EI FROM g""")
def study4(spark, sf_dir):
    """What faked features gain, and their leverage beside genuine ones."""
    t = S.run_study4(questions(spark, sf_dir), MODELS)[1]
    return rounded(t["deception"].select("factor", "p_none", "p_genuine", "p_fake", "deception_gain", "vulnerability").join(t["delta_ei"].select("factor", "delta_EI"), "factor"))


@query("audit_sheet", f"{frame_sql(FAKE_POINTS)} SELECT domain, query_id, target_dim AS dim, variant, target_id AS article_id, length(text) AS n_chars, '' AS reviewer_verdict, '' AS reviewer_note FROM tg")
def audit_sheet(spark, sf_dir):
    return S.audit_sheet(questions(spark, sf_dir)).drop("text").withColumn("n_chars", F.col("n_chars").cast("long"))


def _corpus(spark, sf_dir) -> DataFrame:
    """The documents, dealt to the questions' domains by id."""
    domain = F.element_at(F.array(*map(F.lit, DOMAINS)), (F.col("doc_id") % 5 + 1).cast("int"))
    return spread(table(spark, sf_dir, "documents")).select("doc_id", domain.alias("domain"), "text")


@query("study5")
def study5(spark, sf_dir):
    """Retrieval and citation of each factor's targets, and both together."""
    return rounded(S.run_study5(questions(spark, sf_dir), _corpus(spark, sf_dir), MODELS)[2]["e2e"])


@query("study6")
def study6(spark, sf_dir):
    """Effects on retrieval by rewritten queries and on being cited in the end."""
    q = questions(spark, sf_dir)
    asked = q.select("query_id", F.col("core").alias("question"), "domain")
    rewrites = P.rewritten(asked, P.Answers(spark, scratch(spark, "rewrites")), MODELS[:1])[0].select("query_id", F.col("queries").alias("texts"))
    t = S.run_study6(q, _corpus(spark, sf_dir), rewrites, MODELS)[2]
    return rounded(t["ate_e2e"].select("model", "factor", F.col("paired_ate").alias("ate_e2e"), "n_pairs").join(t["ate_retrieved"].select("factor", F.col("ATE").alias("ate_retrieved")), "factor"))


@query("request_hash", """SELECT item_id, sha256('{"max_tokens": 32, "messages": [{"content": "' || replace(text, chr(10), '\\n') || '", "role": "user"}], "model": "model-a", "seed": ' || CAST(item_id AS VARCHAR) || '}') AS request_hash FROM benchmark""")
def request_hash(spark, sf_dir):
    """Name of a stored answer: SHA-256 of the request as JSON with sorted keys."""
    body = F.concat(F.lit('{"max_tokens": 32, "messages": [{"content": '), T.json_text(F.col("text")), F.lit(', "role": "user"}], "model": "model-a", "seed": '), F.col("item_id").cast("string"), F.lit("}"))
    return table(spark, sf_dir, "benchmark").select("item_id", F.sha2(body, 256).alias("request_hash"))


@query("position_permutations", f"""{frame_sql(OFAT_POINTS)}, p AS (SELECT query_id, comp[1] AS a, comp[2] AS b, 'x' AS c FROM sh)
SELECT query_id, array_to_string(o, ',') AS ordered_ids FROM (SELECT query_id, unnest([[a, b, c], [a, c, b], [b, a, c], [b, c, a], [c, a, b], [c, b, a]]) AS o FROM p)""")
def position_permutations(spark, sf_dir):
    """All orders of each question's shared competitors and one more."""
    pool = S.distractor_pool(questions(spark, sf_dir)).select("query_id", F.col("article_id").alias("doc_id"))
    shared = D.shared_competitors(pool, 2).withColumn("ids", F.concat("competitors", F.array(F.lit("x"))))
    return shared.select("query_id", F.explode(D.permutations(F.col("ids"))).alias("o")).select("query_id", F.array_join("o", ",").alias("ordered_ids"))
