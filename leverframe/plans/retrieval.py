"""Queries on retrieval: BM25, dense, hybrid, injected targets, and what follows from their ranks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leverframe.codebook import FACTORS
from leverframe.operators import effects as E
from leverframe.operators import information as I
from leverframe.operators import retrieval as R
from leverframe.plans.effects import B1, BY_MODEL_SQL, _by_model, counted, ei_sql
from leverframe.plans.registry import query, rounded
from leverframe.sources.articles import ARTICLES_SQL, articles
from leverframe.sources.tables import spread, table

K, ALPHA = 8, 0.5
MODELS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


#: The domains that the questions are put to, in turn: the documents' languages.
LANGS = ["en", "de", "fr", "es"]


def corpus(spark, sf_dir) -> DataFrame:
    """Documents in the domain of their language."""
    return spread(table(spark, sf_dir, "documents").select("doc_id", F.coalesce("lang", F.lit("")).alias("domain"), "text"))


def dense_corpus(spark, sf_dir) -> DataFrame:
    """The documents that have a vector; a vector without a document is in the domain that its id gives."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    return vectors.join(corpus(spark, sf_dir), "doc_id", "left").withColumn("domain", F.coalesce("domain", _lang("doc_id")))


def _lang(number: str) -> F.Column:
    return F.element_at(F.array(*map(F.lit, LANGS)), (F.col(number) % len(LANGS) + 1).cast("int"))


def questions(spark, sf_dir) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), "embedding")
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), _lang("item_id").alias("domain"), "text").join(vectors, "query_id", "left")


def targets(spark, sf_dir) -> DataFrame:
    """The injected targets are conversation turns, each put to a benchmark question: target_id, query_id, query_ids, text, embedding and its place in the design."""
    t = table(spark, sf_dir, "conversations").withColumn("_one", F.lit(1))
    items = table(spark, sf_dir, "benchmark").agg(F.count(F.lit(1)).alias("items")).withColumn("_one", F.lit(1))
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("conv_id"), "embedding")
    t = t.join(F.broadcast(items), "_one").join(vectors, "conv_id", "left")
    c = F.col("conv_id")
    return t.select(
        (c * 1000 + F.col("turn")).alias("target_id"), (c % F.col("items")).alias("query_id"), F.element_at(F.array(*map(F.lit, LANGS)), ((c % F.col("items")) % len(LANGS) + 1).cast("int")).alias("domain"), F.array(c % F.col("items")).alias("query_ids"), "text", "embedding", "conv_id", "items",
        F.element_at(F.array(*map(F.lit, FACTORS)), (c % 8 + 1).cast("int")).alias("target_dim"),
        F.when(F.col("turn") % 2 == 1, "treatment").otherwise("control").alias("role"),
        F.concat_ws("|", c.cast("string"), F.floor(F.col("turn") / 2).cast("string")).alias("pair_key"),
        F.element_at(F.array(*map(F.lit, MODELS)), (c % 5 + 1).cast("int")).alias("model"),
    )


TOK = "list_filter(regexp_split_to_array({}, '\\s+'), lambda x: x <> '')"
DOM = f"list_extract({LANGS}, CAST({{}} % {len(LANGS)} + 1 AS BIGINT))"
BM25_SQL = f"""WITH docs AS (SELECT doc_id, coalesce(lang, '') AS domain, text FROM documents), dw AS (SELECT doc_id, domain, {TOK.format("coalesce(text, '')")} AS w FROM docs), sz AS (SELECT domain, count(*) AS n_docs, avg(len(w)) AS avgdl FROM dw GROUP BY domain),
post AS (SELECT domain, doc_id, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT domain, doc_id, len(w) AS dl, unnest(w) AS term FROM dw) GROUP BY domain, doc_id, term),
dfs AS (SELECT domain, term, count(*) AS df FROM post GROUP BY domain, term), raw AS (SELECT domain, term, df, ln(n_docs - df + 0.5) - ln(df + 0.5) AS raw FROM dfs JOIN sz USING (domain)),
idf AS (SELECT domain, term, df, CASE WHEN raw < 0 THEN 0.25 * avg(raw) OVER (PARTITION BY domain) ELSE raw END AS idf FROM raw),
bq AS (SELECT item_id AS query_id, {DOM.format("item_id")} AS domain, text FROM benchmark), qt AS (SELECT query_id, domain, term, count(*) AS qtf FROM (SELECT query_id, domain, unnest({TOK.format('text')}) AS term FROM bq) GROUP BY 1, 2, 3),
bm AS (SELECT query_id, doc_id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM qt JOIN post USING (domain, term) JOIN idf USING (domain, term) JOIN sz USING (domain) GROUP BY 1, 2),
tw AS (SELECT conv_id * 1000 + turn AS target_id, conv_id % (SELECT count(*) FROM benchmark) AS query_id, {TOK.format("coalesce(text, '')")} AS w FROM conversations),
tp AS (SELECT target_id, query_id, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT target_id, query_id, len(w) AS dl, unnest(w) AS term FROM tw) GROUP BY 1, 2, 3),
tm AS (SELECT tp.query_id, target_id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS target_score FROM tp JOIN qt ON tp.query_id = qt.query_id AND tp.term = qt.term JOIN idf ON tp.term = idf.term AND qt.domain = idf.domain JOIN sz ON sz.domain = qt.domain GROUP BY 1, 2),
ts AS (SELECT tw.target_id, tw.query_id, coalesce(tm.target_score, 0) AS target_score FROM tw JOIN (SELECT DISTINCT query_id FROM qt) USING (query_id) LEFT JOIN tm ON tm.target_id = tw.target_id AND tm.query_id = tw.query_id),
tr AS (SELECT target_id, ts.query_id, target_score, count(bm.doc_id) AS target_rank FROM ts LEFT JOIN bm ON bm.query_id = ts.query_id AND bm.score > target_score GROUP BY ALL),
tt AS (SELECT *, CASE WHEN target_rank < {K} THEN 1 ELSE 0 END AS retrieved, (target_id // 1000) AS conv, target_id % 1000 AS turn FROM tr),
rf AS (SELECT *, list_extract({FACTORS}, CAST(conv % 8 + 1 AS BIGINT)) AS factor, CASE WHEN turn % 2 = 1 THEN 'treatment' ELSE 'control' END AS role, concat_ws('|', CAST(conv AS VARCHAR), CAST(turn // 2 AS VARCHAR)) AS pair_key, list_extract({MODELS}, CAST(conv % 5 + 1 AS BIGINT)) AS model FROM tt)"""


def _scores(spark, sf_dir, k: int | None = None) -> DataFrame:
    return R.ranked_scores(R.Index(corpus(spark, sf_dir)), questions(spark, sf_dir).select("query_id", "domain", "text"), k=k)


def _found(spark, sf_dir) -> DataFrame:
    """Every target's rank among all documents, by BM25."""
    own = targets(spark, sf_dir).select("target_id", "query_ids", "text")
    found = R.search(R.Index(corpus(spark, sf_dir)), questions(spark, sf_dir).select("query_id", "domain", "text"), own, k=K)
    return found.join(targets(spark, sf_dir).select("target_id", "query_id"), "target_id")


def _ranked_targets(spark, sf_dir) -> DataFrame:
    """The retrieval frame: targets with their rank, factor, role, pair and model."""
    ranks = _found(spark, sf_dir).select("target_id", "query_id", "target_rank", "retrieved")
    t = targets(spark, sf_dir).select("target_id", F.col("target_dim").alias("factor"), "role", "pair_key", "model")
    return ranks.join(t, "target_id")


@query("bm25_index", f"{BM25_SQL} SELECT domain, df, count(*) AS n_terms, round(max(idf), 6) AS idf, CAST(sum(CAST('0x' || substr(md5(term), 1, 8) AS BIGINT)) AS BIGINT) AS terms FROM idf GROUP BY domain, df")
def bm25_index(spark, sf_dir):
    """By domain and document frequency: how many terms have it, their idf, and a sum over their hashes that tells the sets of terms apart."""
    terms = R.Index(corpus(spark, sf_dir)).terms
    number = F.conv(F.substring(F.md5(F.col("term").cast("binary")), 1, 8), 16, 10).cast("long")
    return rounded(terms.groupBy("domain", "df").agg(F.count(F.lit(1)).alias("n_terms"), F.max("idf").alias("idf"), F.sum(number).alias("terms")))


@query("tokenize", """WITH a AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM articles),
t AS (SELECT doc_id, flatten(list_transform(w, lambda x: CASE WHEN length(x) > 1 AND regexp_matches(x, '[㐀-鿿]') THEN list_transform(range(1, length(x)), lambda i: substr(x, i, 2)) ELSE [x] END)) AS t FROM a)
SELECT doc_id, len(t) AS n_tokens, sha256(array_to_string(t, ' ')) AS tokens_hash FROM t""".replace("WITH ", f"WITH {ARTICLES_SQL}, ", 1))
def tokenize(spark, sf_dir):
    """Words, and character pairs of Han words, of every article."""
    t = articles(spark, sf_dir).select("doc_id", R.tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.sha2(F.array_join("t", " "), 256).alias("tokens_hash"))


@query("bm25_scores", f"{BM25_SQL} SELECT domain, query_id, doc_id, score FROM bm JOIN bq USING (query_id)")
def bm25_scores(spark, sf_dir):
    return _scores(spark, sf_dir).join(questions(spark, sf_dir).select("query_id", "domain"), "query_id").select("domain", "query_id", "doc_id", "score")


@query("bm25_topk", f"{BM25_SQL} SELECT query_id, doc_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM bm QUALIFY rank <= {K}")
def bm25_topk(spark, sf_dir):
    return R.top_k(_scores(spark, sf_dir, K), K)


@query("bm25_injected", f"{BM25_SQL} SELECT query_id, target_id, target_score FROM ts")
def bm25_injected(spark, sf_dir):
    own = targets(spark, sf_dir).select("target_id", "query_ids", "text")
    got = R.target_scores(R.Index(corpus(spark, sf_dir)), questions(spark, sf_dir).select("query_id", "domain", "text"), own)
    return got.select("query_id", "target_id", F.col("score").alias("target_score"))


@query("target_rank", f"{BM25_SQL} SELECT query_id, target_id, target_rank, retrieved FROM tt")
def target_rank(spark, sf_dir):
    return _found(spark, sf_dir).select("query_id", "target_id", "target_rank", "retrieved")


#: Ranges over all documents (0 without a common term) and the target, for each target.
SPAN_SQL = """mb AS (SELECT query_id, min(score) AS lo, max(score) AS hi, sum(score) AS total, count(*) AS n FROM bm GROUP BY query_id),
sp AS (SELECT query_id, CASE WHEN coalesce(n, 0) < n_docs THEN least(coalesce(lo, 0), 0) ELSE lo END AS lo, CASE WHEN coalesce(n, 0) < n_docs THEN greatest(coalesce(hi, 0), 0) ELSE hi END AS hi, coalesce(total, 0) AS total, n_docs FROM bq JOIN sz USING (domain) LEFT JOIN mb USING (query_id)),
tn AS (SELECT ts.*, least(lo, target_score) AS low, greatest(hi, target_score) AS high, total, n_docs AS n FROM ts JOIN sp USING (query_id))"""


@query("minmax_norm", f"""{BM25_SQL}, {SPAN_SQL}
SELECT query_id, target_id, round(low, 6) AS low, round(high, 6) AS high, round(CASE WHEN high - low <= 1e-12 THEN 0 ELSE (target_score - low) / (high - low) END, 6) AS target_norm,
 round(CASE WHEN high - low <= 1e-12 THEN 0 ELSE (total / n - low) / (high - low) END, 6) AS corpus_mean_norm FROM tn""")
def minmax_norm(spark, sf_dir):
    """Each target's range over all documents of its domain and itself, its normalised score, and the mean normalised score of the documents."""
    index = R.Index(corpus(spark, sf_dir))
    q = questions(spark, sf_dir).select("query_id", "domain", "text")
    own = R.target_scores(index, q, targets(spark, sf_dir).select("target_id", "query_ids", "text")).select("query_id", "target_id", "score")
    both = own.join(R.ranges(index, q, ("bm25",)), "query_id").withColumns({"low": F.least("low", "score"), "high": F.greatest("high", "score")})
    norm = lambda x: R.scaled(x, F.col("low"), F.col("high"))
    return rounded(both.select("query_id", "target_id", "low", "high", norm(F.col("score")).alias("target_norm"), norm(F.col("total") / F.col("n")).alias("corpus_mean_norm")))


def _cos(a: str, b: str) -> str:
    dot = lambda x, y: f"list_sum(list_transform(list_zip({x}, {y}), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE)))"
    return f"round({dot(a, b)} / (sqrt({dot(a, a)}) * sqrt({dot(b, b)})), 6)"


VECTORS = f"(SELECT vec_id AS doc_id, coalesce(domain, {DOM.format('vec_id')}) AS domain, text, embedding FROM embeddings LEFT JOIN (SELECT doc_id, coalesce(lang, '') AS domain, text FROM documents) ON doc_id = vec_id)"
DENSE_SQL = f"""WITH dq AS (SELECT item_id AS query_id, {DOM.format('item_id')} AS domain, embedding AS q FROM benchmark JOIN embeddings ON vec_id = item_id), dv AS {VECTORS},
de AS (SELECT query_id, doc_id, {_cos('embedding', 'q')} AS score FROM dv JOIN dq USING (domain))"""


def _dense_index(spark, sf_dir) -> R.Index:
    return R.Index(dense_corpus(spark, sf_dir))


#: Every question against every vector, whatever their domains.
ALL_DENSE_SQL = f"""WITH dq AS (SELECT item_id AS query_id, embedding AS q FROM benchmark JOIN embeddings ON vec_id = item_id),
de AS (SELECT query_id, vec_id AS doc_id, {_cos('embedding', 'q')} AS score FROM embeddings, dq)"""


@query("dense_topk", f"{ALL_DENSE_SQL} SELECT query_id, doc_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM de QUALIFY rank <= {K}")
def dense_topk(spark, sf_dir):
    """The best vectors of each question that has one, among all of the table."""
    vectors = spread(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding"))
    asked = questions(spark, sf_dir).where("embedding IS NOT NULL")
    return R.top_k(R.ranked_scores(R.Index(vectors), asked, "dense", K), K)


def _norm(c: str) -> str:
    return f"CASE WHEN max({c}) OVER w - min({c}) OVER w <= 1e-12 THEN 0 ELSE ({c} - min({c}) OVER w) / (max({c}) OVER w - min({c}) OVER w) END"


#: The hybrid corpus is the documents with a vector: both channels' statistics come from these alone.
HYBRID_SQL = BM25_SQL.replace("SELECT doc_id, coalesce(lang, '') AS domain, text FROM documents", f"SELECT * FROM {VECTORS}", 1) + ", " + DENSE_SQL[5:] + ", hb AS (SELECT de.query_id, de.doc_id, de.score AS dense, coalesce(bm.score, 0) AS bm25 FROM de LEFT JOIN bm USING (query_id, doc_id))"


#: The same by both channels, whatever the domains.
ALL_HYBRID_SQL = f"""WITH dw AS (SELECT doc_id, {TOK.format("coalesce(text, '')")} AS w FROM (SELECT vec_id AS doc_id, text FROM embeddings LEFT JOIN documents ON doc_id = vec_id)), sz AS (SELECT count(*) AS n_docs, avg(len(w)) AS avgdl FROM dw),
post AS (SELECT doc_id, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT doc_id, len(w) AS dl, unnest(w) AS term FROM dw) GROUP BY doc_id, term),
dfs AS (SELECT term, count(*) AS df FROM post GROUP BY term), raw AS (SELECT term, df, ln(n_docs - df + 0.5) - ln(df + 0.5) AS raw FROM dfs, sz),
idf AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw),
qt AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT item_id AS query_id, unnest({TOK.format('text')}) AS term FROM benchmark) GROUP BY 1, 2),
bm AS (SELECT query_id, doc_id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM qt JOIN post USING (term) JOIN idf USING (term), sz GROUP BY 1, 2),
{ALL_DENSE_SQL[5:]}, hb AS (SELECT de.query_id, de.doc_id, de.score AS dense, coalesce(bm.score, 0) AS bm25 FROM de LEFT JOIN bm USING (query_id, doc_id))"""


@query("hybrid_fuse", f"""{ALL_HYBRID_SQL}, hf AS (SELECT query_id, doc_id, {ALPHA} * {_norm('dense')} + (1 - {ALPHA}) * {_norm('bm25')} AS score FROM hb WINDOW w AS (PARTITION BY query_id))
SELECT query_id, doc_id, round(score + 1e-9, 6) AS score FROM hf""")
def hybrid_fuse(spark, sf_dir):
    """Each question that has a vector with every document that has one, by both channels."""
    asked = questions(spark, sf_dir).where("embedding IS NOT NULL")
    return R.fused_scores(R.Index(dense_corpus(spark, sf_dir).drop("domain")), asked, ALPHA)


def _fused(source: str) -> str:
    one = lambda c: f"CASE WHEN {c}_hi - {c}_lo <= 1e-12 THEN 0 ELSE ({source}{c} - {c}_lo) / ({c}_hi - {c}_lo) END"
    return f"({ALPHA} * {one('dense')} + (1 - {ALPHA}) * {one('bm25')})"


def _hybrid_ranks(pairs: str, documents: str, own: str, pool: str) -> str:
    """CTEs from ``pairs`` (target_id, query_id), ``documents`` (query_id, doc_id, dense, bm25) and ``own`` (target_id, query_id, t_dense, t_bm25) to ``hr``."""
    return f"""hs AS (SELECT query_id, min(dense) AS dl, max(dense) AS dh, min(bm25) AS bl, max(bm25) AS bh FROM {documents} GROUP BY query_id),
hfr AS (SELECT o.*, least(dl, t_dense) AS dense_lo, greatest(dh, t_dense) AS dense_hi, least(bl, t_bm25) AS bm25_lo, greatest(bh, t_bm25) AS bm25_hi FROM {pairs} JOIN {own} o USING (target_id, query_id) JOIN hs USING (query_id)),
hdoc AS (SELECT target_id, doc_id, round({pool}({_fused('')}), 9) AS s FROM hfr JOIN {documents} USING (query_id) GROUP BY target_id, doc_id),
hown AS (SELECT target_id, round({pool}({_fused('t_')}), 9) AS t FROM hfr GROUP BY target_id),
hr AS (SELECT target_id, any_value(t) AS t, count(*) FILTER (s > t) AS target_rank, list(doc_id ORDER BY s DESC, doc_id)[1:{K}] AS ids FROM hdoc JOIN hown USING (target_id) GROUP BY target_id)"""


TARGET_DENSE_SQL = f"td AS (SELECT conv_id * 1000 + turn AS target_id, q.query_id, {_cos('e.embedding', 'q.q')} AS t_dense FROM conversations JOIN embeddings e ON vec_id = conv_id JOIN dq q ON q.query_id = conv_id % (SELECT count(*) FROM benchmark))"


def _listed(found: DataFrame, *more: str) -> DataFrame:
    ids = {c: F.array_join(c, ",") for c in ("top_k_ids", "competitor_ids")}
    return found.select(*more, "target_id", F.round("target_score", 6).alias("target_score"), "target_rank", "retrieved", *[e.alias(c) for c, e in ids.items()])


LISTED_SQL = f"target_id, round(t, 6) AS target_score, target_rank, CASE WHEN target_rank < {K} THEN 1 ELSE 0 END AS retrieved, array_to_string(ids, ',') AS top_k_ids, array_to_string(ids[1:{K - 1}], ',') AS competitor_ids"


@query("retrieve", f"""{HYBRID_SQL}, {TARGET_DENSE_SQL}, ow AS (SELECT ts.target_id, ts.query_id, t_dense, target_score AS t_bm25 FROM ts JOIN td USING (target_id, query_id)), pr AS (SELECT target_id, query_id FROM ow),
{_hybrid_ranks('pr', 'hb', 'ow', 'max')} SELECT {LISTED_SQL} FROM hr""")
def retrieve(spark, sf_dir):
    """Targets among the documents with a vector, by both channels, normalised over documents and target."""
    own = targets(spark, sf_dir).select("target_id", "query_ids", "text", "embedding")
    return _listed(R.search(_dense_index(spark, sf_dir), questions(spark, sf_dir), own, "hybrid", K, ALPHA))


@query("retrieve_dense", f"""{DENSE_SQL}, {TARGET_DENSE_SQL}, tl AS (SELECT query_id, list(doc_id ORDER BY score DESC, doc_id)[1:{K}] AS ids FROM de GROUP BY query_id)
SELECT target_id, CAST(count(*) FILTER (de.score > t_dense) AS BIGINT) AS target_rank, array_to_string(any_value(ids), ',') AS top_k_ids FROM td JOIN de USING (query_id) JOIN tl USING (query_id) GROUP BY target_id""")
def retrieve_dense(spark, sf_dir):
    own = targets(spark, sf_dir).select("target_id", "query_ids", "text", "embedding")
    return _listed(R.search(_dense_index(spark, sf_dir), questions(spark, sf_dir), own, "dense", K)).select("target_id", "target_rank", "top_k_ids")


@query("natural_topk", f"""{BM25_SQL}, al AS (SELECT query_id, doc_id, coalesce(score, 0) AS score FROM (SELECT query_id, domain FROM bq WHERE query_id IN (SELECT query_id FROM ts)) JOIN dw USING (domain) LEFT JOIN bm USING (query_id, doc_id)),
tl AS (SELECT query_id, list(CAST(doc_id AS VARCHAR) ORDER BY score DESC, doc_id)[1:{K}] AS ids FROM al GROUP BY query_id)
SELECT target_id, array_to_string(CASE WHEN target_rank < {K} THEN list_concat(list_concat(ids[1:target_rank], [CAST(target_id AS VARCHAR)]), ids[target_rank + 1:{K} - 1]) ELSE ids[1:{K}] END, ',') AS window_ids FROM tt JOIN tl USING (query_id)""")
def natural_topk(spark, sf_dir):
    return R.natural_topk(_found(spark, sf_dir), K).select("target_id", F.array_join("window_ids", ",").alias("window_ids"))


def _rewritten(spark, sf_dir) -> DataFrame:
    """Targets with rewritten queries: their own question and the next one of its domain; a third of the conversations have a blank instead of the second, some have blanks only."""
    t, q = targets(spark, sf_dir), questions(spark, sf_dir)
    c = F.col("conv_id")
    said = [c % 7 != 0, (c % 7 != 0) & (c % 3 != 0)]
    t = t.withColumns({"_0": c % F.col("items"), "_1": (c + len(LANGS)) % F.col("items")})
    for i, told in enumerate(said):
        one = q.select(F.col("query_id").alias(f"_{i}"), F.struct("query_id", "text", "embedding").alias(f"_q{i}"))
        r = F.col(f"_q{i}")
        t = R.with_small(t, one, f"_{i}", "left").withColumn(f"_r{i}", F.when(r.isNotNull(), F.struct(r["query_id"].alias("query_id"), F.when(told, r["text"]).otherwise(" ").alias("text"), r["embedding"].alias("embedding"))))
    return t.select("target_id", "domain", "text", "embedding", F.filter(F.array("_r0", "_r1"), lambda x: x.isNotNull()).alias("rewrites")).where("size(rewrites) > 0")  # two each


@query("retrieve_multi", HYBRID_SQL + f""", items AS (SELECT count(*) AS m FROM benchmark),
ms AS (SELECT conv_id * 1000 + turn AS target_id, conv_id, text, m FROM conversations, items WHERE conv_id IN (SELECT vec_id FROM embeddings)),
pr AS (SELECT target_id, conv_id % m AS query_id FROM ms WHERE conv_id % 7 <> 0 UNION ALL SELECT target_id, (conv_id + 4) % m FROM ms WHERE conv_id % 7 <> 0 AND conv_id % 3 <> 0 UNION ALL SELECT target_id, -target_id - 1 FROM ms WHERE conv_id % 7 = 0),
oq AS (SELECT DISTINCT -target_id - 1 AS query_id, {DOM.format('(conv_id % m)')} AS domain, text, conv_id FROM ms WHERE conv_id % 7 = 0),
q2 AS (SELECT query_id, domain, term, count(*) AS qtf FROM (SELECT query_id, domain, unnest({TOK.format("coalesce(text, '')")}) AS term FROM oq) GROUP BY 1, 2, 3 UNION ALL SELECT * FROM qt),
v2 AS (SELECT oq.query_id, oq.domain, embedding AS q FROM oq JOIN embeddings ON vec_id = conv_id UNION ALL SELECT * FROM dq),
g2 AS (SELECT domain, term, doc_id, idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl)) AS w FROM post JOIN idf USING (domain, term) JOIN sz USING (domain)), b2 AS (SELECT query_id, doc_id, round(sum(qtf * w), 6) AS score FROM q2 JOIN g2 USING (domain, term) GROUP BY 1, 2),
d2 AS (SELECT query_id, doc_id, {_cos('embedding', 'q')} AS dense FROM dv JOIN v2 USING (domain)), h2 AS (SELECT d2.*, coalesce(score, 0) AS bm25 FROM d2 LEFT JOIN b2 USING (query_id, doc_id)),
ot AS (SELECT pr.target_id, pr.query_id, tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl)) * qtf * idf AS w FROM pr JOIN tp USING (target_id) JOIN q2 ON q2.query_id = pr.query_id AND q2.term = tp.term JOIN idf ON idf.term = tp.term AND idf.domain = q2.domain JOIN sz ON sz.domain = q2.domain),
ob AS (SELECT target_id, query_id, round(sum(w), 6) AS t_bm25 FROM ot GROUP BY 1, 2),
ow AS (SELECT pr.target_id, pr.query_id, {_cos('e.embedding', 'v2.q')} AS t_dense, coalesce(t_bm25, 0) AS t_bm25 FROM pr JOIN embeddings e ON e.vec_id = pr.target_id // 1000 JOIN v2 ON v2.query_id = pr.query_id LEFT JOIN ob ON ob.target_id = pr.target_id AND ob.query_id = pr.query_id),
{_hybrid_ranks('pr', 'h2', 'ow', 'max')}, {_hybrid_ranks('pr', 'h2', 'ow', 'avg').replace('hs AS', 'hs2 AS').replace('JOIN hs USING', 'JOIN hs2 USING').replace('hfr', 'hfr2').replace('hdoc', 'hdoc2').replace('hown', 'hown2').replace('hr AS', 'hr2 AS')}
SELECT 'max' AS pool, {LISTED_SQL} FROM hr UNION ALL SELECT 'mean', {LISTED_SQL} FROM hr2""")
def retrieve_multi(spark, sf_dir):
    """Several rewritten queries of a target, their normalised scores pooled for each document and the target."""
    queries, own = R.queries_of_targets(_rewritten(spark, sf_dir))
    return _listed(R.searches(_dense_index(spark, sf_dir), queries, own, "hybrid", K, ALPHA), "pool")


@query("rank_ecdf", f"""{BM25_SQL}, rs AS (SELECT unnest(range(1, {K} + 1)) AS r)
SELECT CAST(r AS INTEGER) AS r, role, round(avg(CASE WHEN retrieved = 1 AND target_rank <= r - 1 THEN 1.0 ELSE 0 END), 6) AS share FROM rf, rs GROUP BY r, role""")
def rank_ecdf(spark, sf_dir):
    r = F.explode(F.sequence(F.lit(1), F.lit(K)))
    long = _ranked_targets(spark, sf_dir).select("role", "retrieved", "target_rank", r.alias("r"))
    return rounded(long.groupBy("r", "role").agg(F.avg(F.when((F.col("retrieved") == 1) & (F.col("target_rank") <= F.col("r") - 1), 1.0).otherwise(0.0)).alias("share")))


RATES_SQL = "rr AS (SELECT factor, avg(retrieved) FILTER (role = 'control') AS rc, avg(retrieved) FILTER (role = 'treatment') AS rt FROM rf GROUP BY factor)"


@query("e2e_decomposition", f"""{BM25_SQL}, {RATES_SQL}, {B1[5:]}, gg AS (SELECT factor, avg(y) FILTER (role = 'control') AS cc, avg(y) FILTER (role = 'treatment') AS ct FROM (SELECT target_dim AS factor, role, y FROM ofat) GROUP BY factor)
SELECT factor, round(rc, 6) AS P_retrieve_control, round(rt, 6) AS P_retrieve_treated, round(rt - rc, 6) AS ATE_retrieve, round(cc, 6) AS P_cite_ctx_control, round(ct, 6) AS P_cite_ctx_treated, round(ct - cc, 6) AS ATE_cite,
 round(rc * cc, 6) AS P_e2e_control, round(rt * ct, 6) AS P_e2e_treated, round(rt * ct - rc * cc, 6) AS ATE_e2e FROM rr JOIN gg USING (factor)""")
def e2e_decomposition(spark, sf_dir):
    from leverframe.sources.bindings import ofat

    return rounded(E.two_channels(_ranked_targets(spark, sf_dir).withColumnRenamed("factor", "target_dim"), ofat(spark, sf_dir)))


@query("rank_ecdf_gap", f"""{BM25_SQL}, rs AS (SELECT unnest(range(1, {K} + 1)) AS r), e AS (SELECT factor, r, role, avg(CASE WHEN retrieved = 1 AND target_rank <= r - 1 THEN 1.0 ELSE 0 END) AS s FROM rf, rs GROUP BY ALL)
SELECT factor, round(avg(t.s - c.s), 6) AS mean_gap FROM e t JOIN e c USING (factor, r) WHERE t.role = 'treatment' AND c.role = 'control' GROUP BY factor""")
def rank_ecdf_gap(spark, sf_dir):
    """How much more of the treated targets lie within the first r places, averaged over r."""
    r = F.explode(F.sequence(F.lit(1), F.lit(K)))
    share = lambda role: F.avg(F.when(F.col("role") == role, F.when((F.col("retrieved") == 1) & (F.col("target_rank") <= F.col("r") - 1), 1.0).otherwise(0.0)))
    by = _ranked_targets(spark, sf_dir).select("factor", "role", "retrieved", "target_rank", r.alias("r")).groupBy("factor", "r").agg((share("treatment") - share("control")).alias("gap"))
    return rounded(by.where("gap IS NOT NULL").groupBy("factor").agg(F.avg("gap").alias("mean_gap")))


@query("retrieval_by_model", f"""{BM25_SQL}, pp AS (SELECT model, factor, pair_key, avg(retrieved) FILTER (role = 'treatment') - avg(retrieved) FILTER (role = 'control') AS diff FROM rf GROUP BY 1, 2, 3)
SELECT model, factor, round(avg(diff), 6) AS ATE, count(diff) AS n_pairs, (SELECT round(avg(retrieved), 6) FROM rf WHERE rf.model = pp.model) AS recall FROM pp GROUP BY model, factor""")
def retrieval_by_model(spark, sf_dir):
    rows = _ranked_targets(spark, sf_dir).withColumns({"level": F.when(F.col("role") == "treatment", E.top_of(F.col("factor"))).otherwise(0), "top": E.top_of(F.col("factor"))})
    ate = E.paired_ate(rows, ["model", "factor"], ["pair_key"], "retrieved").select("model", "factor", "ATE", "n_pairs")
    recall = rows.groupBy("model").agg(F.avg("retrieved").alias("recall"))
    return rounded(ate.join(F.broadcast(recall), "model"))


FUNNEL_SQL = "fy AS (SELECT *, CASE WHEN retrieved = 1 AND target_id % 3 <> 0 THEN 1 ELSE 0 END AS cited FROM rf)"


def _cited(spark, sf_dir) -> DataFrame:
    return _ranked_targets(spark, sf_dir).withColumn("cited", F.when((F.col("retrieved") == 1) & (F.col("target_id") % 3 != 0), 1).otherwise(0))


@query("pipeline_funnel", f"{BM25_SQL}, {FUNNEL_SQL} SELECT model, role, count(*) AS n, round(avg(retrieved), 6) AS p_retrieved, round(avg(cited) FILTER (retrieved = 1), 6) AS p_cited_given_retrieved, round(avg(cited), 6) AS p_cited FROM fy GROUP BY model, role")
def pipeline_funnel(spark, sf_dir):
    return rounded(_cited(spark, sf_dir).groupBy("model", "role").agg(F.count(F.lit(1)).alias("n"), F.avg("retrieved").alias("p_retrieved"), F.avg(F.when(F.col("retrieved") == 1, F.col("cited"))).alias("p_cited_given_retrieved"), F.avg("cited").alias("p_cited")))


@query("channel_join", f"""{BM25_SQL}, {FUNNEL_SQL} SELECT model, factor, round(avg(cited) FILTER (role = 'treatment') - avg(cited) FILTER (role = 'control'), 6) AS ate_e2e, round(avg(retrieved) FILTER (role = 'treatment') - avg(retrieved) FILTER (role = 'control'), 6) AS ate_retrieved FROM fy GROUP BY model, factor""")
def channel_join(spark, sf_dir):
    rows = _cited(spark, sf_dir)
    effect = lambda y, name: rows.groupBy("model", "factor").agg((F.avg(F.when(F.col("role") == "treatment", F.col(y))) - F.avg(F.when(F.col("role") == "control", F.col(y)))).alias(name))
    return rounded(effect("cited", "ate_e2e").join(effect("retrieved", "ate_retrieved"), ["model", "factor"]))


@query("cross_study_join", f"""{BM25_SQL}, {BY_MODEL_SQL[5:]}, s6 AS (SELECT model, factor, avg(retrieved) FILTER (role = 'treatment') - avg(retrieved) FILTER (role = 'control') AS d FROM rf GROUP BY model, factor)
SELECT model, factor, round(ATE, 6) AS ate_study1, round(d, 6) AS ate_study6 FROM bm2 JOIN s6 USING (model, factor)""".replace(", bm AS (SELECT model", ", bm2 AS (SELECT model"))
def cross_study_join(spark, sf_dir):
    six = _ranked_targets(spark, sf_dir).groupBy("model", "factor").agg((F.avg(F.when(F.col("role") == "treatment", F.col("retrieved"))) - F.avg(F.when(F.col("role") == "control", F.col("retrieved")))).alias("ate_study6"))
    return rounded(_by_model(spark, sf_dir).select("model", "factor", F.col("ATE").alias("ate_study1")).join(six, ["model", "factor"]))


@query("ate_ei_join", f"{B1}, {ei_sql('sc', 'model')}, a AS (SELECT model, factor, avg(y) FILTER (level = top) - avg(y) FILTER (level = 0) AS ATE FROM sc GROUP BY model, factor) SELECT model, factor, round(ATE, 6) AS ATE, round(coalesce(CASE WHEN factor < 'S' THEN EI / sum(EI) OVER (PARTITION BY model) END, 0), 6) AS EI_share FROM a LEFT JOIN ei USING (model, factor)")
def ate_ei_join(spark, sf_dir):
    long = counted(spark, sf_dir)
    ei = I.effective_information(I.experimental_do(long, ["model", "factor"]), ["model", "factor"]).withColumn("EI_share", E.share("EI", ["model"])).where("factor < 'S'").select("model", "factor", "EI_share")
    ate = E.marginal_ate(long, ["model", "factor"]).select("model", "factor", "ATE")
    return rounded(ate.join(ei, ["model", "factor"], "left").withColumn("EI_share", F.coalesce("EI_share", F.lit(0.0))))
