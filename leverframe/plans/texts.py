"""Queries on texts: detector, checks, audit, variant store, identifiers, passage pool."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leverframe.codebook import DOMAINS, FACTORS
from leverframe.functions import text as T
from leverframe.operators.effects import dedup_keep_first
from leverframe.operators.numbering import numbered
from leverframe.plans.registry import query, rounded
from leverframe.sources.articles import ARTICLES_SQL, articles
from leverframe.sources.files import jsonl_round_trip, parse_records, read_csv, read_lines, scan_records, scratch, write_csv
from leverframe.sources.tables import table

A = f"WITH {ARTICLES_SQL}"


def _any(col: str, markers) -> str:
    return "(" + " OR ".join(f"contains({col}, '{m}')" for m in markers) + ")"


def profile_sql(t: str) -> dict[str, str]:
    nl = "chr(10)"
    return {
        "S1": f"CASE WHEN regexp_matches({t}, '[0-9]') AND {_any(t, T.NUMBER_SIGNS)} AND {_any(t, T.SOURCES)} THEN 2 WHEN {_any(t, T.VAGUE)} THEN 1 ELSE 0 END",
        "S2": f"CASE WHEN {_any(t, T.BALANCE)} THEN 1 ELSE 0 END",
        "S3": f"CASE WHEN {_any(t, T.EXPERTISE)} THEN 1 ELSE 0 END",
        "S4": f"CASE WHEN {_any(t, T.CLAIMS)} THEN 1 ELSE 0 END",
        "O1": f"CASE WHEN contains({t}, {nl} || '- ') OR contains({t}, {nl} || '* ') OR contains({t}, '|') OR regexp_matches({t}, '^\\s*- ') THEN 1 ELSE 0 END",
        "O2": f"CASE WHEN {_any(t, T.LEADS)} THEN 1 ELSE 0 END",
        "O3": f"CASE WHEN {_any(t, T.HEADINGS)} THEN 1 ELSE 0 END",
        "O4": f"CASE WHEN {_any(t, T.BOUND)} THEN 2 WHEN contains({t}, '紧邻') THEN 1 ELSE 0 END",
    }


def _profiles_sql(col: str, prefix: str = "") -> str:
    return ", ".join(f"{e} AS {prefix}{f}" for f, e in profile_sql(col).items())


@query("detect_profile", f"{A} SELECT doc_id, {_profiles_sql('text')} FROM articles")
def detect_profile(spark, sf_dir):
    return articles(spark, sf_dir).select("doc_id", T.detect_profile(F.col("text")).alias("p")).select("doc_id", "p.*")


@query("profile_key", f"{A}, p AS (SELECT doc_id, {_profiles_sql('text')} FROM articles) SELECT concat_ws('|', {', '.join(chr(39) + f + '=' + chr(39) + ' || CAST(' + f + ' AS VARCHAR)' for f in FACTORS)}) AS profile_key, count(*) AS n FROM p GROUP BY 1")
def profile_key(spark, sf_dir):
    return articles(spark, sf_dir).select(T.profile_key(T.detect_profile(F.col("text"))).alias("profile_key")).groupBy("profile_key").agg(F.count(F.lit(1)).alias("n"))


@query("marker_count", f"{A} SELECT doc_id, CAST({' + '.join(f'(length(text) - length(replace(text, {chr(39)}{m}{chr(39)}, {chr(39)*2}))) // {len(m)}' for m in ['%', '机构', '|', 'the', 'et al'])} AS BIGINT) AS n_markers FROM articles")
def marker_count(spark, sf_dir):
    return articles(spark, sf_dir).select("doc_id", T.marker_count(F.col("text"), ["%", "机构", "|", "the", "et al"]).alias("n_markers"))


PAIR_SQL = f"{A}, p AS (SELECT doc_id, dim, length(base_text) AS la, length(text) AS lb, {_profiles_sql('base_text', 'a_')}, {_profiles_sql('text', 'b_')} FROM articles)"


def _checked(spark, sf_dir) -> DataFrame:
    pairs = articles(spark, sf_dir).select("doc_id", "dim", T.detect_profile(F.col("base_text")).alias("a"), T.detect_profile(F.col("text")).alias("b"), T.length_ok(F.col("base_text"), F.col("text")).alias("length_ok"))
    changed = F.when(F.col("dim") == "S1", F.col("a.S1") != F.col("b.S1")).otherwise(F.col("a.S3") != F.col("b.S3"))
    return pairs.select("doc_id", "dim", changed.alias("target_changed"), T.drift(F.col("a"), F.col("b"), F.col("dim")).alias("off_target_drift"), "length_ok")


@query("check_pair", f"""{PAIR_SQL}, c AS (SELECT doc_id, CASE WHEN dim = 'S1' THEN a_S1 <> b_S1 ELSE a_S3 <> b_S3 END AS target_changed,
 array_to_string(list_filter([{', '.join(f"CASE WHEN dim <> '{f}' AND a_{f} <> b_{f} THEN '{f}' END" for f in FACTORS)}], lambda x: x IS NOT NULL), ',') AS off_target_drift,
 CASE WHEN la = 0 THEN lb = 0 ELSE abs(la - lb) / la <= 0.1 END AS length_ok FROM p)
SELECT *, target_changed AND off_target_drift = '' AND length_ok AS ok FROM c""")
def check_pair(spark, sf_dir):
    return _checked(spark, sf_dir).select("doc_id", "target_changed", "off_target_drift", "length_ok", (F.col("target_changed") & (F.col("off_target_drift") == "") & F.col("length_ok")).alias("ok"))


@query("batch_check", f"""{PAIR_SQL}, c AS (SELECT dim, ({' AND '.join(f"(dim = '{f}' OR a_{f} = b_{f})" for f in FACTORS)}) AS ok FROM p)
SELECT dim, count(*) AS n, count(*) FILTER (ok) AS n_ok, round(count(*) FILTER (ok) / count(*), 6) AS pass_rate FROM c GROUP BY dim""")
def batch_check(spark, sf_dir):
    ok = F.col("off_target_drift") == ""
    return rounded(_checked(spark, sf_dir).groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(ok, 1)).alias("n_ok"), (F.count(F.when(ok, 1)) / F.count(F.lit(1))).alias("pass_rate")))


@query("validate_base", f"""{A}, p AS (SELECT doc_id, trim(text, ' ') AS t, {_profiles_sql('text')} FROM articles)
SELECT doc_id, array_to_string(list_filter([CASE WHEN length(t) < 100 THEN 'short' END, CASE WHEN starts_with(t, '{{') OR starts_with(t, '[') THEN 'json' END, {', '.join(f"CASE WHEN {f} <> 0 THEN '{f}' END" for f in FACTORS)}], lambda x: x IS NOT NULL), ',') AS problems FROM p""")
def validate_base(spark, sf_dir):
    return articles(spark, sf_dir).select("doc_id", F.array_join(T.base_problems(F.col("text"), T.detect_profile(F.col("text"))), ",").alias("problems"))


TITLE_LIST = "regexp_extract_all(text, '《([^》]{3,120})》', 1)"


@query("extract_titles", f"{A} SELECT doc_id, array_to_string({TITLE_LIST}, '; ') AS titles FROM articles")
def extract_titles(spark, sf_dir):
    return articles(spark, sf_dir).select("doc_id", F.array_join(T.titles(F.col("text")), "; ").alias("titles"))


def _quoted(values) -> str:
    return ", ".join("'" + v + "'" for v in values)


def verify_sql(t: str) -> str:
    return f"""CASE WHEN trim({t}) = '' THEN 'no_title' WHEN trim({t}) IN ({_quoted(T.REAL_TITLES)}) THEN 'verified_real' WHEN trim({t}) IN ({_quoted(T.FABRICATED_TITLES)}) OR regexp_matches({t}, '{T.GAME_PATTERN}') THEN 'likely_fabricated'
 WHEN regexp_matches({t}, '{T.REPORT_PATTERN}|{T.GUIDE_PATTERN}') THEN 'partial_real_type' WHEN regexp_matches(lower({t}), '{T.ACADEMIC_PATTERN}') THEN 'unverified_academic_like' ELSE 'unverified_generic' END"""


@query("verify_title", f"{A}, t AS (SELECT unnest({TITLE_LIST}) AS title FROM articles), s AS (SELECT title, {verify_sql('title')} AS status, count(*) AS n FROM t GROUP BY 1, 2) SELECT *, CASE status {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in T.REASONS.items())} END AS reason FROM s")
def verify_title(spark, sf_dir):
    named = articles(spark, sf_dir).select(F.explode(T.titles(F.col("text"))).alias("title"))
    found = named.groupBy("title").agg(F.count(F.lit(1)).alias("n")).select("title", T.verify_title(F.col("title")).alias("status"), "n")
    return found.withColumn("reason", T.title_reason(F.col("status")))


AUDIT_SQL = f"""{A}, g AS (SELECT article_id, query_id, domain, dim, generator, n_chars, text, {TITLE_LIST} AS ts FROM articles WHERE variant = 'genuine'),
s AS (SELECT article_id, min(list_position([{_quoted(T.STATUS_ORDER)}], {verify_sql('title')})) AS worst, count(*) FILTER ({verify_sql('title')} = 'likely_fabricated') AS n_fake FROM (SELECT article_id, unnest(ts) AS title FROM g) GROUP BY 1),
f AS (SELECT g.*, array_to_string(list_filter([CASE WHEN generator = 'template_fallback' THEN 'template_fallback' END, CASE WHEN n_chars < 80 THEN 'too_short' END, {', '.join(f"CASE WHEN contains(text, '{w}') THEN 'leak_word:{w}' END" for w in T.LEAKS)}], lambda x: x IS NOT NULL), ', ') AS flags,
 CASE WHEN len(ts) = 0 THEN CASE WHEN dim = 'S3' THEN 'expertise_only' ELSE 'no_citable_source' END WHEN dim = 'S3' THEN CASE WHEN n_fake > 0 THEN 'likely_fabricated' ELSE {verify_sql('ts[1]')} END ELSE list_extract([{_quoted(T.STATUS_ORDER)}], worst) END AS st
 FROM g LEFT JOIN s USING (article_id)),
audit AS (SELECT article_id, query_id, domain, dim, CASE WHEN flags <> '' THEN 'reject_quality' ELSE st END AS verification_status, coalesce(ts[1], '') AS primary_title, array_to_string(ts, ' | ') AS all_titles, flags,
 CASE WHEN dim = 'S3' AND len(ts) = 0 THEN 'manual_expertise_review' WHEN flags <> '' OR len(ts) = 0 OR st = 'likely_fabricated' THEN 'reject_regen' WHEN dim <> 'S3' AND st IN ('verified_real', 'partial_real_type') THEN 'manual_number_check' ELSE 'manual_review' END AS recommended_verdict FROM f)"""


def _audit(spark, sf_dir) -> DataFrame:
    rows = articles(spark, sf_dir).where("variant = 'genuine'")
    return rows.select("article_id", "query_id", "domain", "dim", T.audit(F.col("dim"), F.col("text"), F.col("n_chars"), F.col("generator")).alias("v")).select("article_id", "query_id", "domain", "dim", "v.*")


@query("genuine_audit", f"{AUDIT_SQL} SELECT * FROM audit")
def genuine_audit(spark, sf_dir):
    return _audit(spark, sf_dir)


@query("verification_summary", f"{AUDIT_SQL} SELECT dim, verification_status, recommended_verdict, count(*) AS n FROM audit GROUP BY 1, 2, 3")
def verification_summary(spark, sf_dir):
    return _audit(spark, sf_dir).groupBy("dim", "verification_status", "recommended_verdict").agg(F.count(F.lit(1)).alias("n")).orderBy("dim", F.desc("n"))


@query("audit_join", f"{AUDIT_SQL} SELECT a.article_id, a.query_id, a.dim, a.variant, v.verification_status, v.recommended_verdict, v.dim AS dim_ver FROM articles a LEFT JOIN audit v USING (article_id)")
def audit_join(spark, sf_dir):
    ver = _audit(spark, sf_dir).select("article_id", "verification_status", "recommended_verdict", F.col("dim").alias("dim_ver"))
    return articles(spark, sf_dir).select("article_id", "query_id", "dim", "variant").join(ver, "article_id", "left")


@query("audit_group_no", f"{A}, g AS (SELECT DISTINCT domain, query_id FROM articles), n AS (SELECT *, row_number() OVER (ORDER BY domain, query_id) AS group_no FROM g) SELECT a.article_id, CAST(n.group_no AS INTEGER) AS group_no FROM articles a JOIN n USING (domain, query_id)")
def audit_group_no(spark, sf_dir):
    rows = articles(spark, sf_dir).select("article_id", "domain", "query_id")
    groups = numbered(rows.select("domain", "query_id").distinct(), [], ["domain", "query_id"], "group_no")
    return rows.join(groups, ["domain", "query_id"]).select("article_id", "group_no")


@query("audit_sort", f"""{A}, o AS (SELECT article_id, domain, query_id, CASE dim WHEN 'S1' THEN 0 WHEN 'S3' THEN 1 ELSE 9 END AS d, CASE variant WHEN 'none' THEN 0 WHEN 'genuine' THEN 1 WHEN 'fake' THEN 2 ELSE 9 END AS v FROM articles)
SELECT article_id, query_id, CAST(row_number() OVER (PARTITION BY domain, query_id ORDER BY d, v, article_id) AS INTEGER) AS place FROM o""")
def audit_sort(spark, sf_dir):
    d = F.when(F.col("dim") == "S1", 0).when(F.col("dim") == "S3", 1).otherwise(9)
    v = F.when(F.col("variant") == "none", 0).when(F.col("variant") == "genuine", 1).when(F.col("variant") == "fake", 2).otherwise(9)
    w = Window.partitionBy("domain", "query_id").orderBy(d, v, "article_id")
    return articles(spark, sf_dir).select("article_id", "query_id", "domain", "dim", "variant").select("article_id", "query_id", F.row_number().over(w).alias("place"))


REASON_SQL = """CASE WHEN generator <> 'llm' THEN 'generator=' || generator WHEN length(t) = 0 THEN 'empty' WHEN length(t) < 300 THEN 'short(' || length(t) || '<300)' WHEN nb > 0 AND length(t) < floor(nb * 0.15) THEN 'truncated(' || length(t) || '/' || nb || ')' END"""


@query("variant_classify", f"{A}, v AS (SELECT article_id, generator, trim(text, ' ') AS t, 4 * length(base_text) AS nb FROM articles) SELECT article_id, {REASON_SQL} AS reason, length(t) AS n_chars FROM v WHERE {REASON_SQL} IS NOT NULL")
def variant_classify(spark, sf_dir):
    v = articles(spark, sf_dir).select("article_id", F.trim("text").alias("t"), T.variant_reason(F.col("generator"), F.col("text"), F.repeat("base_text", F.lit(4)), least=300).alias("reason"))
    return v.where("reason IS NOT NULL").select("article_id", "reason", F.length("t").cast("long").alias("n_chars"))


def _store(spark, sf_dir) -> DataFrame:
    """A variant store: lines of files, where later lines replace earlier ones of the same key."""
    return articles(spark, sf_dir).select(F.concat(F.lit("v"), (F.col("doc_id") % 97).cast("string"), F.lit("_"), "domain").alias("key"), F.concat(F.lit("f"), (F.col("doc_id") % 7).cast("string")).alias("file"), F.col("doc_id").alias("line"), "generator", "n_chars")


STORE_SQL = f"{A}, store AS (SELECT concat('v', CAST(doc_id % 97 AS VARCHAR), '_', domain) AS key, concat('f', CAST(doc_id % 7 AS VARCHAR)) AS file, doc_id AS line, generator, n_chars FROM articles)"


@query("variant_latest_wins", f"{STORE_SQL} SELECT key, file, line, generator, n_chars FROM store QUALIFY row_number() OVER (PARTITION BY key ORDER BY file DESC, line DESC) = 1")
def variant_latest_wins(spark, sf_dir):
    return _store(spark, sf_dir).groupBy("key").agg(F.max_by(F.struct("file", "line", "generator", "n_chars"), F.struct("file", "line")).alias("r")).select("key", "r.*")


@query("variant_upsert", f"""{STORE_SQL}, old AS (SELECT key, max(line) AS line FROM store WHERE file < 'f4' GROUP BY key), new AS (SELECT key, max(line) AS line FROM store WHERE file >= 'f3' GROUP BY key)
SELECT coalesce(n.key, o.key) AS key, coalesce(n.line, o.line) AS line, n.key IS NOT NULL AS replaced FROM old o FULL JOIN new n USING (key)""")
def variant_upsert(spark, sf_dir):
    store = _store(spark, sf_dir)
    old = store.where("file < 'f4'").groupBy("key").agg(F.max("line").alias("line"))
    new = store.where("file >= 'f3'").groupBy("key").agg(F.max("line").alias("line"))
    return new.withColumn("replaced", F.lit(True)).unionByName(old.join(new, "key", "left_anti").withColumn("replaced", F.lit(False)))


@query("variant_cache_miss", f"{A} SELECT j.article_id FROM articles j WHERE NOT EXISTS (SELECT 1 FROM articles s WHERE s.generator = 'llm' AND s.variant <> 'fake' AND s.article_id = j.article_id AND sha256(s.base_text) = sha256(j.base_text))")
def variant_cache_miss(spark, sf_dir):
    jobs = articles(spark, sf_dir).select("article_id", F.sha2("base_text", 256).alias("base_hash"))
    stored = articles(spark, sf_dir).where("generator = 'llm' AND variant <> 'fake'").select("article_id", F.sha2("base_text", 256).alias("base_hash"))
    return jobs.join(stored, ["article_id", "base_hash"], "left_anti").select("article_id")


@query("variant_manifest", f"""{A} SELECT domain, count(*) AS n_total, count(*) FILTER (variant = 'none') AS n_reused, count(*) FILTER (variant <> 'none') AS n_new, count(*) FILTER (generator = 'template_fallback') AS n_fallback,
 min(n_chars) FILTER (generator = 'llm') AS min_chars, median(n_chars) FILTER (generator = 'llm') AS median_chars, max(n_chars) FILTER (generator = 'llm') AS max_chars FROM articles GROUP BY domain""")
def variant_manifest(spark, sf_dir):
    llm = F.when(F.col("generator") == "llm", F.col("n_chars"))
    n = lambda c: F.count(F.when(c, 1))
    return articles(spark, sf_dir).groupBy("domain").agg(F.count(F.lit(1)).alias("n_total"), n(F.col("variant") == "none").alias("n_reused"), n(F.col("variant") != "none").alias("n_new"), n(F.col("generator") == "template_fallback").alias("n_fallback"), F.min(llm).alias("min_chars"), F.median(llm).alias("median_chars"), F.max(llm).alias("max_chars"))


@query("shortest_variants_topk", f"{A} SELECT article_id, n_chars FROM articles ORDER BY n_chars, article_id LIMIT 20")
def shortest_variants_topk(spark, sf_dir):
    return articles(spark, sf_dir).select("article_id", "n_chars").orderBy("n_chars", "article_id").limit(20)


@query("frozen_overlay", f"{A}, frozen AS (SELECT article_id, text FROM articles WHERE generator = 'llm') SELECT a.article_id, sha256(coalesce(f.text, a.base_text)) AS text_hash, CASE WHEN f.article_id IS NULL THEN 'template_fallback' ELSE 'reused' END AS source FROM articles a LEFT JOIN frozen f USING (article_id)")
def frozen_overlay(spark, sf_dir):
    rows = articles(spark, sf_dir)
    frozen = rows.where("generator = 'llm'").select("article_id", F.sha2("text", 256).alias("frozen_hash"))
    base = rows.select("article_id", F.sha2("base_text", 256).alias("base_hash"))
    return base.join(frozen, "article_id", "left").select("article_id", F.coalesce("frozen_hash", "base_hash").alias("text_hash"), F.when(F.col("frozen_hash").isNull(), "template_fallback").otherwise("reused").alias("source"))


@query("base_hash", "SELECT doc_id, sha256(coalesce(text, '')) AS base_hash FROM documents")
def base_hash(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("base_hash"))


@query("seed_offset", f"{A} SELECT article_id, CAST(10000 + CAST('0x' || substr(sha256(article_id), 1, 8) AS BIGINT) % 90000 AS BIGINT) AS seed_offset FROM articles")
def seed_offset(spark, sf_dir):
    return articles(spark, sf_dir).select("article_id", T.seed_offset(F.col("article_id")).alias("seed_offset"))


@query("stable_id", "SELECT doc_id, substr(sha1('[\"q\", \"' || lang || '\", \"' || source || '\", ' || CAST(doc_id % 3 AS VARCHAR) || ', ' || CAST(doc_id AS VARCHAR) || ']'), 1, 12) AS id FROM documents")
def stable_id(spark, sf_dir):
    d = F.col("doc_id")
    return table(spark, sf_dir, "documents").select("doc_id", T.stable_id(F.lit('"q"'), T.json_text(F.col("lang")), T.json_text(F.col("source")), (d % 3).cast("string"), d.cast("string")).alias("id"))


MODELS = ["deepseek/chat", "qwen3-flash", "Doubao/seed 2", "kimi-k2", "moonshot-v1:8k", "minimax-m3", "minimaxi", "abab6.5s", "gpt-5"]


def _models(spark, sf_dir) -> DataFrame:
    names = F.array(*map(F.lit, MODELS))
    return table(spark, sf_dir, "orders").select(F.element_at(names, (F.col("o_orderkey") % len(MODELS) + 1).cast("int")).alias("model"), "o_orderkey")


MODELS_SQL = f"WITH m AS (SELECT list_extract([{_quoted(MODELS)}], CAST(o_orderkey % {len(MODELS)} + 1 AS BIGINT)) AS model FROM orders)"


@query("model_slug", f"{MODELS_SQL} SELECT model, trim(regexp_replace(replace(model, '/', '__'), '[: ]', '_', 'g')) AS slug, count(*) AS n FROM m GROUP BY 1, 2")
def model_slug(spark, sf_dir):
    return _models(spark, sf_dir).groupBy("model").agg(F.count(F.lit(1)).alias("n")).select("model", T.model_slug(F.col("model")).alias("slug"), "n")


@query("provider_route", f"""{MODELS_SQL}, p AS (SELECT model, CASE WHEN model LIKE 'deepseek/%' OR model LIKE 'deepseek-%' THEN 'deepseek' WHEN lower(model) LIKE 'qwen%' THEN 'qwen' WHEN lower(model) LIKE 'doubao%' THEN 'doubao'
 WHEN lower(model) LIKE 'kimi%' OR lower(model) LIKE 'moonshot/%' OR lower(model) LIKE 'moonshot-%' THEN 'kimi' WHEN regexp_matches(lower(model), '^(minimax(/|[-_.]|$)|abab)') THEN 'minimax' ELSE 'default' END AS provider, count(*) AS n FROM m GROUP BY 1, 2),
r AS (SELECT *, CASE WHEN starts_with(model, 'deepseek/') OR regexp_matches(lower(model), '^(qwen|doubao|kimi|moonshot|minimax)/') THEN substr(model, instr(model, '/') + 1) ELSE model END AS service_model FROM p), l AS (SELECT *, lower(service_model) AS i FROM r)
SELECT model, provider, service_model, CASE provider WHEN 'kimi' THEN NOT contains(i, 'k2.7-code') AND (contains(i, 'k2.6') OR contains(i, 'k2.5') OR starts_with(i, 'kimi-k2')) WHEN 'minimax' THEN contains(i, 'm3') ELSE false END AS thinking_can_stop,
 provider = 'kimi' AND (contains(i, 'k2.7-code') OR contains(i, 'k2.6') OR contains(i, 'k2.5') OR starts_with(i, 'kimi-k2')) AS temperature_is_fixed, n FROM l""")
def provider_route(spark, sf_dir):
    """The service of each model, its name there, and what it can't be asked for."""
    rows = _models(spark, sf_dir).groupBy("model").agg(F.count(F.lit(1)).alias("n")).select("model", T.provider(F.col("model")).alias("provider"), T.service_model(F.col("model")).alias("service_model"), "n")
    p, m = F.col("provider"), F.col("service_model")
    return rows.select("model", "provider", "service_model", T.thinking_can_stop(p, m).alias("thinking_can_stop"), T.temperature_is_fixed(p, m).alias("temperature_is_fixed"), "n")


@query("api_error_classify", """WITH e AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'Content Filter hit' WHEN 1 THEN 'the request is HIGH RISK' WHEN 2 THEN 'data_inspection_failed: x' WHEN 3 THEN 'bad thing' WHEN 4 THEN 'timeout' ELSE 'content_filter' END AS msg, CASE WHEN event_id % 6 = 3 THEN 400 ELSE 500 END AS status FROM events)
SELECT event_id, CASE WHEN contains(lower(msg), 'content_filter') OR contains(lower(msg), 'content filter') THEN 'content_filter' WHEN contains(lower(msg), 'high risk') THEN 'high_risk' WHEN contains(lower(msg), 'data_inspection_failed') THEN 'data_inspection_failed' WHEN status = 400 THEN 'bad_request' END AS marker FROM e""")
def api_error_classify(spark, sf_dir):
    said = F.array(*map(F.lit, ["Content Filter hit", "the request is HIGH RISK", "data_inspection_failed: x", "bad thing", "timeout", "content_filter"]))
    k = (F.col("event_id") % 6).cast("int")
    return table(spark, sf_dir, "events").select("event_id", T.permanent_error(F.element_at(said, k + 1), F.when(k == 3, 400).otherwise(500)).alias("marker"))


# passage pool -------------------------------------------------------------------------------------------------------

CLEAN_SQL = "regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '<[^>]+>', '', 'g'), '\\s+', ' ', 'g'), '^ | $', '', 'g')"
@query("clean_passage", f"SELECT page_id, {CLEAN_SQL} AS passage FROM pages")
def clean_passage(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.clean_passage(F.col("html")).alias("passage"))


TRUNC_SQL = "CASE WHEN length(t) <= 500 THEN t WHEN regexp_extract(substr(t, 1, 500), '(?s)^(.+[。！？])', 1) <> '' THEN regexp_extract(substr(t, 1, 500), '(?s)^(.+[。！？])', 1) ELSE substr(t, 1, 500) END"


@query("truncate_sentence", f"WITH b AS (SELECT page_id, {CLEAN_SQL} AS t FROM pages), c AS (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN replace(t, '.', '。') ELSE t END AS t FROM b) SELECT page_id, {TRUNC_SQL} AS passage FROM c")
def truncate_sentence(spark, sf_dir):
    """Every other page with the full-width marks at which a passage may end."""
    cleaned = table(spark, sf_dir, "pages").select("page_id", T.clean_passage(F.col("html")).alias("t"))
    cleaned = cleaned.withColumn("t", F.when(F.col("page_id") % 2 == 0, F.replace("t", F.lit("."), F.lit("。"))).otherwise(F.col("t")))
    return cleaned.select("page_id", T.truncate_sentence(F.col("t"), 500).alias("passage"))


@query("dedup_key", "SELECT doc_id, substr(regexp_replace(text, '\\s+', '', 'g'), 1, 60) AS dedup_key FROM documents")
def dedup_key(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.dedup_key(F.col("text")).alias("dedup_key"))


def _passages(spark, sf_dir) -> DataFrame:
    """Paragraphs of pages as raw passages with their place, grouped by the page's host."""
    raw = table(spark, sf_dir, "pages").select(F.col("page_id"), F.regexp_extract("url", "://([^/?#]*)", 1).alias("query_id"), F.posexplode(F.split("html", "</p>")).alias("pos", "raw"))
    cleaned = raw.select("query_id", "page_id", "pos", T.truncate_sentence(T.clean_passage(F.col("raw")), 500).alias("passage"))
    return cleaned.where(F.length("passage") >= 120).withColumn("key", T.dedup_key(F.col("passage")))


PASSAGES_SQL = f"""WITH r AS (SELECT page_id, regexp_extract(url, '://([^/?#]*)', 1) AS query_id, string_split(html, '</p>') AS ps FROM pages),
e AS (SELECT page_id, query_id, generate_subscripts(ps, 1) - 1 AS pos, unnest(ps) AS html FROM r), c AS (SELECT page_id, query_id, CAST(pos AS INTEGER) AS pos, {CLEAN_SQL} AS t FROM e),
p AS (SELECT page_id, query_id, pos, {TRUNC_SQL} AS passage FROM c), k AS (SELECT *, substr(regexp_replace(passage, '\\s+', '', 'g'), 1, 60) AS key FROM p WHERE length(passage) >= 120),
d AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY query_id, key ORDER BY page_id, pos) = 1)"""


@query("usable_passages", f"{PASSAGES_SQL} SELECT query_id, page_id, pos, passage FROM d QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY page_id, pos) <= 8")
def usable_passages(spark, sf_dir):
    first = dedup_keep_first(_passages(spark, sf_dir), ["query_id", "key"], ["page_id", "pos"])
    n = F.row_number().over(Window.partitionBy("query_id").orderBy("page_id", "pos"))
    return first.withColumn("n", n).where("n <= 8").select("query_id", "page_id", "pos", "passage")


@query("build_corpus", f"{PASSAGES_SQL} SELECT query_id AS domain, count(*) AS n_docs, CAST(sum(length(passage)) AS BIGINT) AS n_chars FROM d GROUP BY query_id")
def build_corpus(spark, sf_dir):
    first = dedup_keep_first(_passages(spark, sf_dir), ["query_id", "key"], ["page_id", "pos"])
    return first.groupBy(F.col("query_id").alias("domain")).agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.length("passage")).alias("n_chars"))


#: Questions of every domain and of none; a second one beside every third makes ties.
ASKED = ["耳机和音箱怎么选购", "失眠怎么锻炼", "基金定投的收益", "因果推断的数学原理", "高原自驾的行程", "随便问问", "手机分期值得买吗"]
HITS_SQL = ", ".join("(" + " + ".join(f"CAST(contains(asked, '{k}') AS INTEGER)" for k in ks) + f") AS {d}" for d, ks in T.DOMAIN_KEYWORDS.items())


@query("classify_domain", f"WITH q AS (SELECT doc_id, list_extract([{_quoted(ASKED)}], CAST(doc_id % {len(ASKED)} + 1 AS BIGINT)) || CASE WHEN doc_id % 3 = 0 THEN list_extract([{_quoted(ASKED)}], CAST((doc_id // 3) % {len(ASKED)} + 1 AS BIGINT)) ELSE '' END || coalesce(text, '') AS asked FROM documents), h AS (SELECT doc_id, {HITS_SQL} FROM q), b AS (SELECT *, greatest({', '.join(DOMAINS)}) AS best FROM h) SELECT doc_id, CASE WHEN best = 0 OR {' + '.join(f'CAST({d} = best AS INTEGER)' for d in DOMAINS)} > 1 THEN NULL {' '.join(f'WHEN {d} = best THEN {chr(39)}{d}{chr(39)}' for d in DOMAINS)} END AS domain FROM b")
def classify_domain(spark, sf_dir):
    one = lambda i: F.element_at(F.array(*map(F.lit, ASKED)), (i % len(ASKED) + 1).cast("int"))
    d = F.col("doc_id")
    asked = F.concat(one(d), F.when(d % 3 == 0, one(F.floor(d / 3))).otherwise(""), F.coalesce("text", F.lit("")))
    return table(spark, sf_dir, "documents").select("doc_id", T.classify_domain(asked, T.DOMAIN_KEYWORDS).alias("domain"))


def _records(spark, sf_dir) -> DataFrame:
    """Lines of a dataset in both schemas: documents of paragraphs, passages as texts or objects, both at once, neither, and lines that are no JSON."""
    turn = F.struct("turn", "text")
    said = lambda role: F.transform(F.sort_array(F.collect_list(F.when(F.col("role") == role, turn))), lambda x: x["text"])
    conv = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(said("user"), " ").alias("question"), said("assistant").alias("a"))  # a conversation's few turns
    paragraphs = F.transform("a", lambda t: F.struct(F.split(t, "\n").alias("paragraphs")))
    objects = F.to_json(F.struct("conv_id", "question", F.transform("a", lambda t: F.struct(t.alias("text"))).alias("passages")))
    texts = F.to_json(F.struct("conv_id", "question", F.col("a").alias("passages")))
    both = F.to_json(F.struct("conv_id", "question", paragraphs.alias("documents"), F.array(F.lit("not this")).alias("passages")))
    neither = F.to_json(F.struct("conv_id", "question"))
    k = F.col("conv_id") % 5
    return conv.select("conv_id", F.when(k == 0, objects).when(k == 1, texts).when(k == 2, both).when(k == 3, neither).otherwise(F.concat(F.lit("oops "), texts)).alias("line"))


POOL_SQL = """c AS (SELECT conv_id, coalesce(string_agg(text, ' ' ORDER BY turn) FILTER (role = 'user'), '') AS question, list(text ORDER BY turn) FILTER (role = 'assistant') AS a FROM conversations GROUP BY conv_id),
pr AS (SELECT conv_id, question, CASE conv_id % 5 WHEN 2 THEN flatten(list_transform(a, lambda t: string_split(t, chr(10)))) ELSE a END AS passages FROM c WHERE conv_id % 5 < 3 AND question <> '' AND len(a) > 0)"""


def _pool(spark, sf_dir) -> DataFrame:
    """Parsed records: conv_id, question, passages."""
    return parse_records(_records(spark, sf_dir).select("line"), "conv_id LONG")


@query("pool_parse_record", f"WITH {POOL_SQL} SELECT conv_id, length(question) AS question_chars, len(passages) AS n_passages, sha256(array_to_string(passages, '|')) AS passages_hash FROM pr")
def pool_parse_record(spark, sf_dir):
    return _pool(spark, sf_dir).select("conv_id", F.length("question").cast("long").alias("question_chars"), F.size("passages").cast("long").alias("n_passages"), F.sha2(F.array_join("passages", "|"), 256).alias("passages_hash"))


def _stored_pool(spark, sf_dir) -> DataFrame:
    """The pool written as JSON by domain, among records without id or question, and scanned again."""
    rows = _pool(spark, sf_dir).select(F.when(F.col("conv_id") % 7 != 0, F.concat(F.lit("q"), F.col("conv_id").cast("string"))).alias("id"), (F.col("conv_id") % 5 == 0).alias("validated"), "question", "passages", F.concat(F.lit("d"), (F.col("conv_id") % 3).cast("string")).alias("domain"))
    path = scratch(spark, "pool")
    rows.write.partitionBy("domain").json(path)
    return scan_records(spark, path, "id STRING, question STRING, validated BOOLEAN, passages ARRAY<STRING>, domain STRING")


STORED_SQL = f"{POOL_SQL}, sp AS (SELECT 'q' || CAST(conv_id AS VARCHAR) AS id, conv_id % 5 = 0 AS validated, question, passages, 'd' || CAST(conv_id % 3 AS VARCHAR) AS domain FROM pr WHERE conv_id % 7 <> 0)"


@query("pool_scan", f"WITH {STORED_SQL} SELECT id, domain, length(question) AS question_chars FROM sp")
def pool_scan(spark, sf_dir):
    return _stored_pool(spark, sf_dir).select("id", "domain", F.length("question").cast("long").alias("question_chars"))


@query("pool_passages", f"WITH {STORED_SQL} SELECT id AS query_id, CAST(generate_subscripts(passages, 1) - 1 AS INTEGER) AS pos, sha256(unnest(passages)) AS passage_hash FROM sp")
def pool_passages(spark, sf_dir):
    return _stored_pool(spark, sf_dir).select(F.col("id").alias("query_id"), F.posexplode("passages").alias("pos", "p")).select("query_id", "pos", F.sha2("p", 256).alias("passage_hash"))


@query("base_articles_validated", f"WITH {STORED_SQL} SELECT id, domain FROM sp WHERE validated")
def base_articles_validated(spark, sf_dir):
    return _stored_pool(spark, sf_dir).where("validated").select("id", "domain")


@query("src_json_array", "SELECT conv_id, turn, role, length(text) AS n_chars FROM conversations")
def src_json_array(spark, sf_dir):
    """Lines that are one JSON array each, among lines that are one record."""
    rows = table(spark, sf_dir, "conversations")
    fields = F.struct("conv_id", "turn", "role", "text")
    whole = rows.where("conv_id % 2 = 0").groupBy("conv_id").agg(F.to_json(F.collect_list(fields)).alias("line")).select("line")  # a conversation's few turns
    back = read_lines(whole.unionByName(rows.where("conv_id % 2 <> 0").select(F.to_json(fields).alias("line"))), "conv_id LONG, turn LONG, role STRING, text STRING")
    return back.select("conv_id", "turn", "role", F.length("text").cast("long").alias("n_chars"))


SLUG_SQL = "trim(regexp_replace(replace(model, '/', '__'), '[: ]', '_', 'g'))"


@query("persist_per_model", f"{MODELS_SQL} SELECT {SLUG_SQL} AS model_dir, model, count(*) AS n FROM m GROUP BY 1, 2")
def persist_per_model(spark, sf_dir):
    """A folder of CSV files for each model, read again as text with the model from its folder's name."""
    rows = _models(spark, sf_dir).withColumn("model_dir", T.model_slug(F.col("model")))
    path = scratch(spark, "by-model")
    write_csv(rows, path, "model_dir")
    return read_csv(spark, path, "model STRING, o_orderkey STRING, model_dir STRING").groupBy("model_dir", "model").agg(F.count(F.lit(1)).alias("n"))


@query("coerce_number", "SELECT event_id, TRY_CAST(CASE WHEN event_id % 3 = 0 THEN props ELSE regexp_replace(props, '[^0-9]', '', 'g') END AS DOUBLE) AS number FROM events")
def coerce_number(spark, sf_dir):
    """Numbers out of texts; what is none becomes null."""
    raw = F.when(F.col("event_id") % 3 == 0, F.col("props")).otherwise(F.regexp_replace("props", "[^0-9]", ""))
    return table(spark, sf_dir, "events").select("event_id", raw.try_cast("double").alias("number"))


@query("truthy", "SELECT o_orderkey, coalesce(lower(trim(CASE o_orderkey % 6 WHEN 0 THEN ' Yes' WHEN 1 THEN '1.0' WHEN 2 THEN 'TRUE ' WHEN 3 THEN o_orderstatus WHEN 4 THEN '0' END)) IN ('1', '1.0', 'true', 'yes'), false) AS said FROM orders")
def truthy(spark, sf_dir):
    k = F.col("o_orderkey") % 6
    value = F.when(k == 0, " Yes").when(k == 1, "1.0").when(k == 2, "TRUE ").when(k == 3, F.col("o_orderstatus")).when(k == 4, "0")
    return table(spark, sf_dir, "orders").select("o_orderkey", T.truthy(value).alias("said"))


@query("institutions", "WITH t AS (SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN '据中国营养学会和北京大学，' WHEN 1 THEN '国家统计局；某某研究所。' ELSE '' END || coalesce(text, '') AS t FROM conversations) SELECT conv_id, turn, array_to_string(regexp_extract_all(t, '([^，。；\\n]{2,30}(?:协会|学会|大学|研究院|研究所|中心|统计局|委员会|教育部|卫健委|人民银行|知网|CNNIC|出版社))', 1)[1:5], '; ') AS institutions FROM t")
def institutions(spark, sf_dir):
    k = F.col("turn") % 3
    said = F.concat(F.when(k == 0, "据中国营养学会和北京大学，").when(k == 1, "国家统计局；某某研究所。").otherwise(""), F.coalesce("text", F.lit("")))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(T.institutions(said), "; ").alias("institutions"))


@query("abnormal_scan", f"{A}, v AS (SELECT article_id, generator, trim(text, ' ') AS t, length(base_text) AS nb FROM articles), r AS (SELECT article_id, length(t) AS n_chars, {{REASON}} AS reason FROM v) SELECT article_id, reason, n_chars, CAST(row_number() OVER (PARTITION BY reason ORDER BY n_chars, article_id) AS INTEGER) AS place FROM r WHERE reason IS NOT NULL".replace("{REASON}", """CASE WHEN generator <> 'llm' THEN 'generator=' || generator WHEN length(t) = 0 THEN 'empty' WHEN length(t) < 50 THEN 'short(' || length(t) || '<50)' WHEN nb > 0 AND length(t) < floor(nb * 0.15) THEN 'truncated(' || length(t) || '/' || nb || ')' END"""))
def abnormal_scan(spark, sf_dir):
    """Abnormal variants by the default limits, the shortest of each kind first."""
    v = articles(spark, sf_dir).select("article_id", F.length(F.trim("text")).cast("long").alias("n_chars"), T.variant_reason(F.col("generator"), F.col("text"), F.col("base_text")).alias("reason")).where("reason IS NOT NULL")
    return numbered(v.select("article_id", "reason", "n_chars"), ["reason"], ["n_chars", "article_id"], "place")


@query("pool_topn_per_domain", "SELECT lang AS domain, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY doc_id) <= 100")
def pool_topn_per_domain(spark, sf_dir):
    n = F.row_number().over(Window.partitionBy("lang").orderBy("doc_id"))
    return table(spark, sf_dir, "documents").select("doc_id", "lang").withColumn("n", n).where("n <= 100").select(F.col("lang").alias("domain"), "doc_id")


@query("cap_per_domain", "SELECT source AS domain, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 20 * 2")
def cap_per_domain(spark, sf_dir):
    n = F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))
    return table(spark, sf_dir, "documents").select("doc_id", "source").withColumn("n", n).where("n <= 40").select(F.col("source").alias("domain"), "doc_id")


@query("import_stats", "SELECT source AS domain, count(*) AS n_candidates, least(count(*), 30) AS n_sampled FROM documents GROUP BY source")
def import_stats(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(F.col("source").alias("domain")).agg(F.count(F.lit(1)).alias("n_candidates")).withColumn("n_sampled", F.least("n_candidates", F.lit(30).cast("long")))


@query("src_jsonl_scan", "SELECT conv_id, turn, role, length(text) AS n_chars FROM conversations")
def src_jsonl_scan(spark, sf_dir):
    """Records written as JSON lines among malformed ones, and scanned again."""
    back = jsonl_round_trip(table(spark, sf_dir, "conversations"), "conv_id LONG, turn LONG, role STRING, text STRING")
    return back.select("conv_id", "turn", "role", F.length("text").cast("long").alias("n_chars"))


@query("corpus_scan", "SELECT doc_id, lang AS domain, length(text) AS n_chars FROM documents")
def corpus_scan(spark, sf_dir):
    """A corpus kept as JSON lines by domain, with n_chars filled in where it is 0."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("domain"), "text", F.when(F.col("doc_id") % 2 == 0, F.col("n_chars")).otherwise(0).alias("n_chars"))
    back = jsonl_round_trip(docs, "doc_id LONG, text STRING, n_chars LONG, domain STRING", by="domain")
    return back.select("doc_id", "domain", F.when(F.col("n_chars") == 0, F.length("text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


@query("json_null_records", "SELECT vec_id, '{\"vec_id\":' || CAST(vec_id AS VARCHAR) || CASE WHEN label % 2 = 0 THEN ',\"label\":' || CAST(label AS VARCHAR) ELSE ',\"label\":null' END || '}' AS record FROM embeddings")
def json_null_records(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.when(F.col("label") % 2 == 0, F.col("label")).alias("label"))
    return rows.select("vec_id", F.to_json(F.struct("vec_id", "label"), {"ignoreNullFields": "false"}).alias("record"))


@query("embedding_fingerprint", "WITH b AS (SELECT label, vec_id // 1000 AS part, sha256(string_agg(CAST(vec_id AS VARCHAR), ',' ORDER BY vec_id)) AS h, count(*) AS n FROM embeddings GROUP BY ALL) SELECT label, sha256('model-a|' || string_agg(h, ',' ORDER BY part)) AS fingerprint, CAST(sum(n) AS BIGINT) AS n FROM b GROUP BY label")
def embedding_fingerprint(spark, sf_dir):
    """In two levels: a digest of each range of a thousand ids, then one of these in order, so that no task holds all ids of a label."""
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("vec_id")), lambda x: x.cast("string")), ",")
    parts = table(spark, sf_dir, "embeddings").groupBy("label", F.floor(F.col("vec_id") / 1000).alias("part")).agg(F.sha2(ids, 256).alias("h"), F.count(F.lit(1)).alias("n"))
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "h"))), lambda x: x["h"]), ",")
    return parts.groupBy("label").agg(F.sha2(F.concat(F.lit("model-a|"), whole), 256).alias("fingerprint"), F.sum("n").alias("n"))
