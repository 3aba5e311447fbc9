"""Queries on statistics and features, with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilmark.functions.metrics import confidence_gap, detectability_state, residual_entropy, resolvable_auc
from veilmark.operators import features, stats
from veilmark.operators.stats import rounded
from veilmark.sources.tables import read

SQL: dict[str, str] = {}


def length_stats(spark: SparkSession, d: str) -> DataFrame:
    return features.length_stats(read(spark, d, "documents"), ["lang", "source"], "n_chars").select("lang", "source", rounded("length_mean"), rounded("length_cv"), "n")


SQL["length_stats"] = """
SELECT lang, source, round(avg(n_chars), 6) AS length_mean, round(CASE WHEN avg(n_chars) > 0 AND count(n_chars) > 1 THEN stddev_pop(n_chars) / avg(n_chars) ELSE 0 END, 6) AS length_cv, count(n_chars) AS n
FROM documents GROUP BY lang, source"""


def semantic_diversity(spark: SparkSession, d: str) -> DataFrame:
    turns = read(spark, d, "conversations").withColumn("text", F.coalesce("text", F.lit("")))
    return features.semantic_diversity(turns, "conv_id", "turn", "text").select("conv_id", rounded("semantic_diversity"), F.col("n_samples").cast("bigint").alias("n_samples"))


SQL["semantic_diversity"] = """
WITH s AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9'']+')) AS w, trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) AS t FROM conversations),
g AS (SELECT conv_id, turn, w, CASE WHEN length(t) < 3 THEN [] ELSE list_distinct(list_transform(range(1, length(t) - 1), lambda i: substr(t, i, 3))) END AS g FROM s),
p AS (SELECT a.conv_id, CASE WHEN len(list_distinct(list_concat(a.w, b.w))) = 0 THEN 1.0 ELSE len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))) END AS j,
  CASE WHEN len(a.g) > 0 AND len(b.g) > 0 THEN len(list_intersect(a.g, b.g)) / sqrt(len(a.g) * len(b.g)) WHEN len(a.g) = 0 AND len(b.g) = 0 THEN 1.0 ELSE 0.0 END AS c
  FROM g a JOIN g b ON a.conv_id = b.conv_id AND a.turn < b.turn),
m AS (SELECT conv_id, avg(((1 - j) + (1 - c)) / 2) AS x FROM p GROUP BY conv_id)
SELECT conv_id, round(coalesce(any_value(x), 0), 6) AS semantic_diversity, count(*) AS n_samples FROM g LEFT JOIN m USING (conv_id) GROUP BY conv_id"""


def trace_features(spark: SparkSession, d: str) -> DataFrame:
    """Embeddings as log-probabilities: rows of five are the likeliest tokens of a position; labels are probes."""
    lp = F.transform("embedding", lambda x: -F.abs(x.cast("double")) - 1)
    rows = F.transform(F.sequence(F.lit(0), F.ceil(F.size("lp") / 5).cast("int") - 1), lambda i: F.slice("lp", i * 5 + 1, F.lit(5)))
    e = read(spark, d, "embeddings").select("label", lp.alias("lp")).select("label", "lp", F.filter(F.transform(rows, residual_entropy), lambda x: x.isNotNull()).alias("h"))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    return e.groupBy("label").agg(
        rounded(F.sum(total("h")) / F.sum(F.size("h")), "token_entropy"), rounded(-F.sum(total("lp")) / F.sum(F.size("lp")), "mean_neg_logprob"), rounded(F.avg(confidence_gap(F.col("lp"))), "confidence_gap")
    )


SQL["trace_features"] = """
WITH e AS (SELECT label, list_transform(embedding, lambda x: -abs(CAST(x AS DOUBLE)) - 1) AS lp FROM embeddings),
r AS (SELECT label, list_transform(range(0, (len(lp) + 4) // 5), lambda i: list_transform(lp[i * 5 + 1 : i * 5 + 5], lambda x: exp(x))) AS rows, lp FROM e),
q AS (SELECT label, unnest(rows) AS p FROM r),
h AS (SELECT label, list_sum(list_transform(p, lambda x: CASE WHEN x > 1e-12 THEN -x * ln(x) ELSE 0 END)) + CASE WHEN 1 - list_sum(p) > 1e-9 THEN -(1 - list_sum(p)) * ln(1 - list_sum(p)) ELSE 0 END AS h FROM q),
a AS (SELECT label, avg(h) AS h FROM h GROUP BY label),
b AS (SELECT label, -sum(list_sum(lp)) / sum(len(lp)) AS m, avg(list_avg(lp[len(lp) // 2 + 1 :]) - list_avg(lp[1 : len(lp) // 2])) AS g FROM e GROUP BY label)
SELECT label, round(h, 6) AS token_entropy, round(m, 6) AS mean_neg_logprob, round(g, 6) AS confidence_gap FROM a JOIN b USING (label)"""


def toolcall_features(spark: SparkSession, d: str) -> DataFrame:
    events = read(spark, d, "events")
    calls = features.tool_entropy(events.where("event_type is not null"), "user_id", "event_type")
    counts = events.groupBy("user_id").agg(F.count("event_type").alias("n_calls"), rounded(F.avg((F.col("event_type") == "view").cast("double")), "view_share"))
    return counts.join(calls, "user_id").select("user_id", "n_calls", "view_share", rounded("toolcall_entropy"))


SQL["toolcall_features"] = """
WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events WHERE event_type IS NOT NULL GROUP BY 1, 2), t AS (SELECT user_id, sum(n) AS m FROM c GROUP BY 1),
h AS (SELECT user_id, -sum(n / m * ln(n / m)) AS h FROM c JOIN t USING (user_id) GROUP BY 1)
SELECT user_id, count(event_type) AS n_calls, round(avg(CASE WHEN event_type = 'view' THEN 1.0 ELSE 0.0 END), 6) AS view_share, round(greatest(0.0, any_value(h)), 6) AS toolcall_entropy
FROM events JOIN h USING (user_id) GROUP BY user_id"""


def latency_trusted(spark: SparkSession, d: str) -> DataFrame:
    trusted = F.col("event_id") % 3 != 0
    return read(spark, d, "events").groupBy("event_type").agg(rounded(F.avg(F.when(trusted, F.col("value"))), "latency_mean"), rounded(F.avg(trusted.cast("double")), "trusted_share"))


SQL["latency_trusted"] = "SELECT event_type, round(avg(value) FILTER (event_id % 3 <> 0), 6) AS latency_mean, round(avg(CASE WHEN event_id % 3 <> 0 THEN 1.0 ELSE 0.0 END), 6) AS trusted_share FROM events GROUP BY event_type"

_F = ("length_mean", "length_cv", "toolcall_count")
_T = ("1", "2", "3", "4")


def _rows(spark: SparkSession, d: str) -> DataFrame:
    """Users are entities, quarters of the year templates."""
    e = read(spark, d, "events").withColumn("quarter", F.quarter("ts").cast("string"))
    cv = F.when((F.avg("value") > 0) & (F.count("value") > 1), F.stddev_pop("value") / F.avg("value")).otherwise(0.0)
    return e.groupBy("user_id", "quarter").agg(F.avg("value").alias("length_mean"), cv.alias("length_cv"), F.count("*").cast("double").alias("toolcall_count"))


ROWS = """r AS (SELECT user_id, CAST(quarter(ts) AS VARCHAR) AS q, avg(value) AS length_mean, CASE WHEN avg(value) > 0 AND count(value) > 1 THEN stddev_pop(value) / avg(value) ELSE 0 END AS length_cv,
  CAST(count(*) AS DOUBLE) AS toolcall_count FROM events GROUP BY 1, 2)"""


def entity_vector_primary(spark: SparkSession, d: str) -> DataFrame:
    v = features.primary_vectors(_rows(spark, d), ["user_id"], _F)
    return v.select("user_id", *(rounded(f) for f in _F))


SQL["entity_vector_primary"] = f"WITH {ROWS} SELECT user_id, " + ", ".join(f"round(avg({f}), 6) AS {f}" for f in _F) + " FROM r GROUP BY user_id"


def entity_vector_secondary(spark: SparkSession, d: str) -> DataFrame:
    v = features.secondary_vectors(_rows(spark, d), ["user_id"], "quarter", list(_T), _F)
    return v.select("user_id", *(rounded(c) for c in v.columns if c != "user_id"))


SQL["entity_vector_secondary"] = (
    f"WITH {ROWS} SELECT user_id, " + ", ".join(f"round(avg({f}), 6) AS {f}__mean, round(stddev_pop({f}), 6) AS {f}__std, round(max({f}), 6) AS {f}__max" for f in _F)
    + ", " + ", ".join(f"round(max({f}) FILTER (q = '{t}'), 6) AS {f}__t_{t}" for f in _F for t in _T) + " FROM r GROUP BY user_id"
)

AUC = """SELECT {by} sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS p, sum(CASE WHEN label = 0 THEN 1 ELSE 0 END) AS q, sum(CASE WHEN label = 1 THEN r ELSE 0 END) AS s
FROM (SELECT *, rank() OVER ({part} ORDER BY score) + (count(*) OVER ({partc} score) - 1) / 2.0 AS r FROM ({src})) {group}"""
_SCORED = "SELECT doc_id, lang, n_chars AS score, {label} AS label FROM labels JOIN documents USING (doc_id)"


def _scored(spark: SparkSession, d: str, label: str) -> DataFrame:
    return read(spark, d, "labels").join(read(spark, d, "documents").select("doc_id", "lang", F.col("n_chars").cast("double").alias("score")), "doc_id").withColumn("label", F.col(label))


def auc_quality(spark: SparkSession, d: str) -> DataFrame:
    return stats.auc(_scored(spark, d, "quality")).select("n_pos", "n_neg", rounded("auc"))


def auc_toxic(spark: SparkSession, d: str) -> DataFrame:
    return stats.auc(_scored(spark, d, "toxic")).select("n_pos", "n_neg", rounded("auc"))


def _auc_sql(label: str) -> str:
    inner = AUC.format(by="", part="", partc="PARTITION BY", src=_SCORED.format(label=label), group="")
    return f"SELECT CAST(p AS BIGINT) AS n_pos, CAST(q AS BIGINT) AS n_neg, round((s - p * (p + 1) / 2.0) / (p * q), 6) AS auc FROM ({inner})"


SQL["auc_quality"], SQL["auc_toxic"] = _auc_sql("quality"), _auc_sql("toxic")


def auc_by_group(spark: SparkSession, d: str) -> DataFrame:
    return stats.auc(_scored(spark, d, "quality"), by="lang").select("lang", "n_pos", "n_neg", rounded("auc"))


SQL["auc_by_group"] = (
    "SELECT lang, CAST(p AS BIGINT) AS n_pos, CAST(q AS BIGINT) AS n_neg, round((s - p * (p + 1) / 2.0) / nullif(p * q, 0), 6) AS auc FROM ("
    + AUC.format(by="lang,", part="PARTITION BY lang", partc="PARTITION BY lang,", src=_SCORED.format(label="quality"), group="GROUP BY lang") + ")"
)


def midranks(spark: SparkSession, d: str) -> DataFrame:
    return stats.midranks(read(spark, d, "lineitem"), "l_quantity").select("l_quantity", "n", "midrank")


SQL["midranks"] = "SELECT DISTINCT l_quantity, count(*) OVER (PARTITION BY l_quantity) AS n, rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS midrank FROM lineitem"


def _p_values(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"), F.avg("n_chars").alias("m"))
    return docs.select(F.col("source").alias("name"), F.round((F.col("m") % 97) / 970, 9).alias("p"))


def bh_adjust(spark: SparkSession, d: str) -> DataFrame:
    return stats.benjamini_hochberg(_p_values(spark, d), q=0.1).select("name", rounded("p"), rounded("p_adjusted"), "rejected")


SQL["bh_adjust"] = """
WITH t AS (SELECT source AS name, round((avg(n_chars) % 97) / 970, 9) AS p FROM documents GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY p, name) AS k, count(*) OVER () AS m FROM t),
a AS (SELECT name, p, least(1.0, greatest(0.0, min(p * m / k) OVER (ORDER BY p, name ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))) AS a FROM r)
SELECT name, round(p, 6) AS p, round(a, 6) AS p_adjusted, a <= 0.1 AS rejected FROM a"""


def power_note_by_n(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "customer").groupBy("c_mktsegment").agg(F.count("*").alias("n_pairs")).select("c_mktsegment", "n_pairs", rounded(resolvable_auc(F.col("n_pairs")), "resolvable"))


SQL["power_note_by_n"] = "SELECT c_mktsegment, count(*) AS n_pairs, round(0.5 + 1.96 * sqrt(2.0 / 12 / count(*)), 6) AS resolvable FROM customer GROUP BY 1"
DRAW = "('0x' || substr(sha256({seed} || '|' || {a} || '|' || {b}), 1, 8))::BIGINT % {n}"


POISSON = "(" + " + ".join(f"CASE WHEN {{u}} >= {t} THEN 1 ELSE 0 END" for t in stats.POISSON) + ")"


def poisson(seed: str, draw: str, cluster: str) -> str:
    """SQL of `stats.poisson_weight`."""
    return POISSON.replace("{u}", f"CAST('0x' || substr(sha256('{seed}|' || {draw} || '|' || {cluster}), 1, 8) AS BIGINT)")


def bootstrap_mean_ci(spark: SparkSession, d: str) -> DataFrame:
    out = stats.bootstrap_mean(read(spark, d, "orders"), "o_custkey", "o_totalprice", draws=200)
    return out.select(rounded("point"), rounded("lo"), rounded("hi"), "n_clusters")


SQL["bootstrap_mean_ci"] = f"""
WITH c AS (SELECT o_custkey, sum(o_totalprice) AS s, count(o_totalprice) AS k FROM orders GROUP BY 1),
w AS (SELECT d, s, k, {poisson('boot', 'd', 'o_custkey')} AS w FROM c, (SELECT unnest(range(0, 200)) AS d)), m AS (SELECT d, sum(w * s) / sum(w * k) AS m FROM w GROUP BY 1)
SELECT round((SELECT sum(s) / sum(k) FROM c), 6) AS point, round(quantile_cont(m, 0.025), 6) AS lo, round(quantile_cont(m, 0.975), 6) AS hi, (SELECT count(*) FROM c) AS n_clusters FROM m"""


def paired_difference_ci(spark: SparkSession, d: str) -> DataFrame:
    """Extended price against a flat price, by order: two measurements of the same cluster."""
    rows = read(spark, d, "lineitem").select("l_orderkey", F.col("l_extendedprice").alias("a"), (F.col("l_quantity") * 1500).alias("b"))
    return stats.paired_bootstrap(rows, "l_orderkey", "a", "b", draws=50).select(rounded("point"), rounded("lo"), rounded("hi"), "n_clusters")


SQL["paired_difference_ci"] = f"""
WITH c AS (SELECT l_orderkey, sum(l_extendedprice - l_quantity * 1500) AS s, count(l_extendedprice - l_quantity * 1500) AS k FROM lineitem GROUP BY 1),
w AS (SELECT d, s, k, {poisson('paired', 'd', 'l_orderkey')} AS w FROM c, (SELECT unnest(range(0, 50)) AS d)), m AS (SELECT d, sum(w * s) / sum(w * k) AS m FROM w GROUP BY 1)
SELECT round((SELECT sum(s) / sum(k) FROM c), 6) AS point, round(quantile_cont(m, 0.025), 6) AS lo, round(quantile_cont(m, 0.975), 6) AS hi, (SELECT count(*) FROM c) AS n_clusters FROM m"""


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    """All labelled documents; two neighbours by doc_id are a pair, and the score is the length."""
    return _scored(spark, d, "quality").select("doc_id", "label", "score", F.floor(F.col("doc_id") / 2).cast("bigint").alias("pair_id"))


PAIRS = """x AS (SELECT doc_id, quality AS label, CAST(n_chars AS DOUBLE) AS score, CAST(floor(doc_id / 2) AS BIGINT) AS pair_id FROM labels JOIN documents USING (doc_id)),
o AS (SELECT *, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS r FROM x),
p AS (SELECT (sum(r) FILTER (label = 1) - count(*) FILTER (label = 1) * (count(*) FILTER (label = 1) + 1) / 2.0) / (count(*) FILTER (label = 1) * count(*) FILTER (label = 0)) AS auc FROM o)"""
WINS = """c AS (SELECT d, score, sum(pos) AS pos, sum(neg) AS neg FROM v GROUP BY 1, 2), u AS (SELECT *, sum(neg) OVER (PARTITION BY d ORDER BY score) AS upto FROM c),
a AS (SELECT d, sum(pos * (upto - neg / 2.0)) / (sum(pos) * sum(neg)) AS a FROM u GROUP BY d HAVING sum(pos) > 0 AND sum(neg) > 0)"""


def auc_bootstrap_ci(spark: SparkSession, d: str) -> DataFrame:
    return stats.auc_bootstrap(_pairs(spark, d), draws=50).select("n_pos", "n_neg", rounded("auc"), rounded("lo"), rounded("hi"), "n_draws")


SQL["auc_bootstrap_ci"] = f"""
WITH {PAIRS}, w AS (SELECT d, pair_id, {poisson('auc', 'd', 'pair_id')} AS w FROM (SELECT DISTINCT pair_id FROM x), (SELECT unnest(range(0, 50)) AS d)),
v AS (SELECT d, score, CASE WHEN label = 1 THEN w ELSE 0 END AS pos, CASE WHEN label = 0 THEN w ELSE 0 END AS neg FROM x JOIN w USING (pair_id)), {WINS}
SELECT (SELECT count(*) FROM x WHERE label = 1) AS n_pos, (SELECT count(*) FROM x WHERE label = 0) AS n_neg, round((SELECT auc FROM p), 6) AS auc,
  round(quantile_cont(a, 0.025), 6) AS lo, round(quantile_cont(a, 0.975), 6) AS hi, count(*) AS n_draws FROM a"""


def permutation_p(spark: SparkSession, d: str) -> DataFrame:
    return stats.permutation_p(_pairs(spark, d), draws=100).select(rounded("observed"), rounded("p"), "n_draws")


SQL["permutation_p"] = f"""
WITH {PAIRS}, y AS (SELECT d, score, CASE WHEN {DRAW.format(seed="'perm'", a="d", b="pair_id", n="2")} = 1 THEN 1 - label ELSE label END AS label FROM x, (SELECT unnest(range(0, 100)) AS d)),
v AS (SELECT d, score, CASE WHEN label = 1 THEN 1 ELSE 0 END AS pos, CASE WHEN label = 0 THEN 1 ELSE 0 END AS neg FROM y), {WINS}
SELECT round(any_value(auc), 6) AS observed, round((count(*) FILTER (a >= auc - 1e-12) + 1) / (count(*) + 1), 6) AS p, count(*) AS n_draws FROM a, p"""


def pair_split(spark: SparkSession, d: str) -> DataFrame:
    return stats.pair_split(read(spark, d, "customer").select("c_custkey"), "c_custkey", 0.3, "split").select("c_custkey", "split")


SQL["pair_split"] = """
WITH h AS (SELECT c_custkey, row_number() OVER (ORDER BY sha256('split|' || c_custkey)) AS r, count(*) OVER () AS n FROM customer)
SELECT c_custkey, CASE WHEN r <= greatest(1, least(n - 1, CAST(round_even(n * 0.3, 0) AS BIGINT))) THEN 'dev' ELSE 'eval' END AS split FROM h"""


def size_bands(spark: SparkSession, d: str) -> DataFrame:
    return stats.size_bands(read(spark, d, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", "c_custkey", 5).select("c_custkey", "band")


SQL["size_bands"] = """
WITH r AS (SELECT c_custkey, row_number() OVER (ORDER BY ln(1 + greatest(0.0, c_acctbal)), c_custkey) - 1 AS r, count(*) OVER () AS n FROM customer)
SELECT c_custkey, CAST(least(4, r * 5 // n) AS INTEGER) AS band FROM r"""


def verdict_states(spark: SparkSession, d: str) -> DataFrame:
    g = read(spark, d, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"), F.avg("n_chars").alias("m"))
    lo, hi = F.round((F.col("m") % 100) / 150, 9), F.round((F.col("m") % 100) / 150 + F.sqrt(1.0 / F.col("n")) / 4, 9)
    s = g.select("lang", "source", lo.alias("lo"), hi.alias("hi"))
    return s.groupBy("lang", detectability_state(F.col("lo"), F.col("hi")).alias("state")).agg(F.count("*").alias("n"))


SQL["verdict_states"] = """
WITH g AS (SELECT lang, source, round((avg(n_chars) % 100) / 150, 9) AS lo, round((avg(n_chars) % 100) / 150 + sqrt(1.0 / count(*)) / 4, 9) AS hi FROM documents GROUP BY 1, 2)
SELECT lang, CASE WHEN lo > 0.5 THEN 'detectable' WHEN hi <= 0.6 THEN 'undetectable' ELSE 'inconclusive' END AS state, count(*) AS n FROM g GROUP BY 1, 2"""

QUERIES = {
    f.__name__: f
    for f in (length_stats, semantic_diversity, trace_features, toolcall_features, latency_trusted, entity_vector_primary, entity_vector_secondary, auc_quality, auc_toxic, auc_by_group, midranks, bh_adjust, power_note_by_n,
              bootstrap_mean_ci, paired_difference_ci, auc_bootstrap_ci, permutation_p, pair_split, size_bands, verdict_states)
}
