"""URL filter rules by a sort-merge range join.

A rule (host, path, verdict) fits its host and all subdomains where the url's path starts with the rule's. The canonical
key of a host is its labels reversed, each ended by a NUL, then the path, as bytes; so all paths under a rule's path are
the interval from the rule's key to that key followed by 0xFF, a byte that UTF-8 never has. A url has one key for each
of its host's ancestors that is no deeper than the deepest rule, and each key is looked up at its own host only.

The lookup sorts rule starts, rule ends and url keys together. Intervals of prefixes are nested or apart, so they form
a stack: a running sum of +1 and -1 is the stack's depth, and the innermost rule that is active at a key is the latest
one that opened to the depth of that key. Both are window functions over one shuffle. The longest of a url's rules wins
(host and path together; then the longer host; then the greater rule).

Keys and rules are dealt out by ancestor host and the head of the path: a rule whose path has n bytes goes by the first
2^k of them, the greatest power of two that n reaches, and a url is looked up at each power that rules have and its own
path reaches. So the rules of one host are spread too, and only rules that share such a head meet. A host and head with
more than 1 / (8 P) of the keys (P: shuffle partitions) is hot; there are at most 8 P of these. Its keys get as many
salts as its share of 8 P says, but no more than it has keys for each of its rules, and its rules go to each salt, so
that repeated rules are never more than the keys themselves. Each distinct url is looked up once; rows find its verdict
by host and path, never by a row number, so that a stage that runs again changes nothing.

Results for odd input: a null url or one without "://" has empty host and path, no rule, and is allowed; an empty rule
table allows all; of rules with equal host and path a block wins; very long urls are judged whole; repeated rows each get
a row; an empty table gives an empty result. Columns of ``pages`` called host, path, rule or verdict are replaced by the
results; all others stay, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leverframe.llm.common import brought_back, cut, join_grouped, partitions, set_aside


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to / ? # or the end, A-Z lower-cased; path: from there up to ? or #."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + F.lit(3))).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(lower, F.lit("")), F.coalesce(path, F.lit(""))


def reversed_key(host: Column) -> Column:
    """The labels of a host in reverse, each followed by NUL."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "\x00"), F.lit("\x00"))


def path_level(n: Column) -> Column:
    """0 for an empty path, else 1 + k where 2^k is the greatest power of two up to ``n`` bytes."""
    return F.when(n > 0, F.length(F.bin(n))).otherwise(0)


def bucket(host_key: Column, path: Column, level: Column) -> Column:
    """Where a host and the head of a path at a level are looked up."""
    head = F.substring(path.cast("binary"), F.lit(1), F.when(level > 0, F.pow(F.lit(2), level - 1).cast("int")).otherwise(0))
    return F.concat(host_key.cast("binary"), F.lpad(level.cast("string"), 2, "0").cast("binary"), head)


def judge(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with host, path, rule and verdict. ``rules``: host, path (with its leading slash), verdict."""
    p = partitions(pages.sparkSession)
    rules = rules.groupBy("host", "path").agg(F.max("verdict").alias("verdict")).withColumn("rule", F.concat("host", "path"))
    rules = rules.withColumns({"host_key": reversed_key(F.col("host")), "level": path_level(F.octet_length("path"))})
    deepest, levels = rules.agg(F.max(F.size(F.split("host", r"\."))), F.sort_array(F.collect_set("level"))).first()  # at most 32 levels

    aside = set_aside(pages)
    host, path = host_and_path(F.col(aside.columns[pages.columns.index(url_col)]))
    rows = aside.withColumns({"_host": host, "_path": path}).withColumn("_id", F.md5(F.concat("_host", "_path").cast("binary")))
    urls = cut(rows.groupBy("_id", "_host", "_path").agg(F.count(F.lit(1)).alias("n")))

    labels = F.reverse(F.split("_host", r"\."))
    ancestors = F.when(F.col("_host") != "", F.sequence(F.lit(1), F.least(F.size(labels), F.lit(max(1, deepest or 0)))))
    keys = urls.select("_id", "n", F.col("_path").alias("path"), labels.alias("labels"), F.explode_outer(ancestors).alias("depth"))
    keys = keys.select("_id", "n", "path", F.concat(F.array_join(F.slice("labels", 1, F.coalesce("depth", F.lit(1))), "\x00"), F.lit("\x00")).alias("host_key"))
    reached = F.filter(F.array(*map(F.lit, levels or [0])), lambda x: x <= path_level(F.octet_length("path")))
    keys = keys.select("_id", "n", "path", "host_key", F.explode(reached).alias("level")).withColumn("anchor", bucket(F.col("host_key"), F.col("path"), F.col("level")))

    anchored = rules.withColumn("anchor", bucket(F.col("host_key"), F.col("path"), F.col("level")))
    per_anchor = anchored.groupBy("anchor").agg(F.count(F.lit(1)).alias("n_rules"))
    counts = keys.groupBy("anchor").agg(F.count(F.lit(1)).alias("n_keys"))
    n_all = counts.agg(F.sum("n_keys")).first()[0] or 0
    share = F.ceil(F.col("n_keys") * (8 * p) / F.lit(max(1, n_all)))
    hot = counts.where(F.col("n_keys") * (8 * p) > n_all).join(per_anchor, "anchor", "left")
    hot = cut(hot.select("anchor", F.least(share, F.greatest(F.lit(1), F.floor(F.col("n_keys") / F.coalesce("n_rules", F.lit(1))))).cast("int").alias("salts")))

    rule = "struct<rule:string,verdict:string,depth:int>"
    empty = lambda kind, name: F.lit(None).cast(kind).alias(name)
    salted_keys = keys.join(F.broadcast(hot), "anchor", "left").select(
        "anchor", F.pmod(F.xxhash64("_id"), F.coalesce("salts", F.lit(1))).cast("int").alias("salt"), F.col("path").cast("binary").alias("sort_key"), F.lit(1).alias("kind"), F.lit(0).alias("step"), "_id", "n", empty(rule, "opened")
    )
    salted_rules = anchored.join(F.broadcast(hot), "anchor", "left").select(
        "anchor", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)).alias("salt"), F.col("path").cast("binary").alias("start"), F.struct("rule", "verdict", F.length("host_key").alias("depth")).alias("opened")
    )
    none = [empty("string", "_id"), empty("long", "n")]
    starts = salted_rules.select("anchor", "salt", F.col("start").alias("sort_key"), F.lit(0).alias("kind"), F.lit(1).alias("step"), *none, "opened")
    ends = salted_rules.select("anchor", "salt", F.concat("start", F.lit(b"\xff")).alias("sort_key"), F.lit(2).alias("kind"), F.lit(-1).alias("step"), *none, empty(rule, "opened"))
    events = salted_keys.unionByName(starts).unionByName(ends)

    order = Window.partitionBy("anchor", "salt").orderBy("sort_key", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = events.withColumn("open", F.sum("step").over(order))
    layer = Window.partitionBy("anchor", "salt", "open").orderBy("sort_key", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = swept.withColumn("active", F.when(F.col("open") > 0, F.last("opened", ignorenulls=True).over(layer)))
    found = swept.where("kind = 1 AND active IS NOT NULL").select("_id", "n", "active")
    longest = F.max(F.struct(F.length("active.rule"), "active.depth", F.col("active.rule").alias("rule"), F.col("active.verdict").alias("verdict")))
    best = cut(found.groupBy("_id").agg(longest.alias("best"), F.max("n").alias("n")).select("_id", "best.rule", "best.verdict", "n"))
    total = urls.agg(F.sum("n")).first()[0] or 0
    out = join_grouped(rows, best, "_id", "n", total)
    out = out.withColumns({"host": F.col("_host"), "path": F.col("_path"), "verdict": F.coalesce("verdict", F.lit(default))})
    return brought_back(out, aside, pages, "host", "path", "rule", "verdict")
