"""Queries on text: numbers, containment, leak@k, refusals and hedges, diversity, markup, redaction; with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilmark.functions import text as T
from veilmark.operators import containment, leaks
from veilmark.operators.stats import rounded
from veilmark.plans.stats_queries import poisson
from veilmark.sources.tables import read


def _sql_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


NUMBERS = f"""list_filter(list_transform(regexp_extract_all(%s, '{T.NUMBER}'), lambda m: try_cast(regexp_replace(m, '[^0-9.\\-+]', '', 'g') AS DOUBLE)), lambda x: x IS NOT NULL)"""
SAID = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(lower(%s), '(^|[^\\p{{L}}\\p{{N}}_]){w}([^\\p{{L}}\\p{{N}}_]|$)') THEN CAST({i} AS DOUBLE) END" for i, w in enumerate(T.WORD_NUMBERS)) + "], lambda x: x IS NOT NULL)"


def _said(c: str) -> str:
    return SAID.replace("%s", c)


def numeric_candidates(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "documents").select("doc_id", T.numeric_candidates(F.coalesce("text", F.lit(""))).alias("c"))
    return c.select("doc_id", F.size("c").cast("bigint").alias("n_candidates"), F.array_max("c").alias("largest")).where("n_candidates > 0")


SQL = {}
SQL["numeric_candidates"] = f"""
WITH c AS (SELECT doc_id, list_concat({NUMBERS % "coalesce(text, '')"}, {_said("coalesce(text, '')")}) AS c FROM documents)
SELECT doc_id, CAST(len(c) AS BIGINT) AS n_candidates, list_max(c) AS largest FROM c WHERE len(c) > 0"""


def leak_soft_containment(spark: SparkSession, d: str) -> DataFrame:
    return leaks.contained(read(spark, d, "documents"), "doc_id", "text", read(spark, d, "benchmark"), "item_id", "text")


SOFT = "trim(regexp_replace(lower(%s), '[^a-z0-9]+', ' ', 'g'))"
HITS = f"SELECT doc_id, item_id FROM documents d JOIN benchmark b ON {SOFT % 'b.text'} <> '' AND contains({SOFT % 'd.text'}, {SOFT % 'b.text'})"
SQL["leak_soft_containment"] = HITS


def leak_short_values(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold a short value, whole words or not: the first word, the first three and the last two of each benchmark item, without the first letter."""
    words = F.split(F.trim(F.col("text")), " +")
    items = read(spark, d, "benchmark").select("item_id", F.posexplode(F.array(F.slice(words, 1, 1), F.slice(words, 1, 3), F.slice(words, -2, 2))).alias("part", "w"))
    values = items.select((F.col("item_id") * 3 + F.col("part")).alias("value_id"), F.substr(F.array_join("w", " "), F.lit(2)).alias("value"))
    return leaks.contained(read(spark, d, "documents"), "doc_id", "text", values, "value_id", "value")


SQL["leak_short_values"] = f"""
WITH w AS (SELECT item_id, regexp_split_to_array(trim(text), ' +') AS w FROM benchmark),
v AS (SELECT item_id * 3 + part AS value_id, {SOFT % "substr(array_to_string(CASE part WHEN 0 THEN w[1:1] WHEN 1 THEN w[1:3] ELSE w[-2:] END, ' '), 2)"} AS v FROM w, (SELECT unnest([0, 1, 2]) AS part)),
t AS (SELECT doc_id, {SOFT % "text"} AS t FROM documents)
SELECT doc_id, value_id FROM t JOIN v ON v <> '' AND contains(t, v)"""


def _carriers(spark: SparkSession, d: str) -> DataFrame:
    """Prices written in four ways, two of them another price."""
    p = read(spark, d, "part").withColumn("cents", F.round(F.col("p_retailprice") * 100).cast("bigint"))
    p = p.withColumns({"whole": F.expr("cents div 100"), "frac": F.lpad((F.col("cents") % 100).cast("string"), 2, "0"), "variant": (F.col("p_partkey") % 4).cast("int")})
    comma = F.when(F.col("whole") >= 1000, F.concat(F.expr("whole div 1000").cast("string"), F.lit(","), F.lpad((F.col("whole") % 1000).cast("string"), 3, "0"))).otherwise(F.col("whole").cast("string"))
    text = (
        F.when(F.col("variant") == 0, F.concat(F.lit("They pay $"), comma, F.lit("."), "frac", F.lit(" per share"))).when(F.col("variant") == 1, F.concat(F.lit("price: "), F.col("whole").cast("string"), F.lit("."), "frac"))
        .when(F.col("variant") == 2, F.concat((F.col("whole") + 1).cast("string"), F.lit("."), "frac", F.lit(" seven"))).otherwise(F.concat(F.lit("ref "), (F.col("whole") - 1).cast("string"), F.lit(" then "), comma, F.lit("."), "frac"))
    )
    return p.select("p_partkey", "variant", text.alias("text"), F.concat(F.lit("$"), F.col("whole").cast("string"), F.lit("."), "frac").alias("value"))


def leak_numeric_hits(spark: SparkSession, d: str) -> DataFrame:
    hit = T.reveals(F.col("text"), F.col("value"))
    return _carriers(spark, d).groupBy("variant").agg(F.count("*").alias("n"), F.count_if(hit).alias("hits"))


SQL["leak_numeric_hits"] = f"""
WITH p AS (SELECT p_partkey, CAST(round(p_retailprice * 100) AS BIGINT) AS cents FROM part),
q AS (SELECT *, cents // 100 AS whole, lpad(CAST(cents % 100 AS VARCHAR), 2, '0') AS frac, CAST(p_partkey % 4 AS INTEGER) AS variant FROM p),
r AS (SELECT *, CASE WHEN whole >= 1000 THEN (whole // 1000) || ',' || lpad(CAST(whole % 1000 AS VARCHAR), 3, '0') ELSE CAST(whole AS VARCHAR) END AS comma FROM q),
t AS (SELECT variant, CAST(whole || '.' || frac AS DOUBLE) AS v, CASE variant WHEN 0 THEN 'They pay $' || comma || '.' || frac || ' per share' WHEN 1 THEN 'price: ' || whole || '.' || frac
  WHEN 2 THEN (whole + 1) || '.' || frac || ' seven' ELSE 'ref ' || (whole - 1) || ' then ' || comma || '.' || frac END AS text FROM r),
c AS (SELECT variant, v, list_concat({NUMBERS % "text"}, {_said("text")}) AS c FROM t)
SELECT variant, count(*) AS n, CAST(count(*) FILTER (len(list_filter(c, lambda x: x = v OR abs(x - v) / abs(v) <= 1e-6)) > 0) AS BIGINT) AS hits FROM c GROUP BY variant"""


def _verdicts(spark: SparkSession, d: str) -> DataFrame:
    """A document is a sample, its language the probe, its source the family; it leaks if it holds a benchmark item."""
    docs = read(spark, d, "documents")
    hit = leak_soft_containment(spark, d).select("doc_id").distinct().withColumn("hit", F.lit(1))
    return docs.select("doc_id", "source", "lang").join(hit, "doc_id", "left").groupBy("source", "lang").agg(F.count("*").cast("int").alias("n"), F.count("hit").cast("int").alias("c"))


def leak_at_k_family(spark: SparkSession, d: str) -> DataFrame:
    out = leaks.leak_results(_verdicts(spark, d), "source", k=8)
    return out.select(F.col("source").alias("family"), F.col("k").cast("bigint").alias("k"), rounded("leak_at_1"), rounded("leak_at_k"), "n_probes")


VERDICTS = f"verdicts AS (SELECT d.source, d.lang, count(*) AS n, count(h.doc_id) AS c FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM ({HITS})) h USING (doc_id) GROUP BY 1, 2)"
LEAK = "CASE WHEN c = 0 THEN 0.0 WHEN n - c < {k} THEN 1.0 ELSE 1 - exp(lgamma(n - c + 1) - lgamma(n - c - {k} + 1) - lgamma(n + 1) + lgamma(n - {k} + 1)) END"
SQL["leak_at_k_family"] = f"""
WITH {VERDICTS}, f AS (SELECT source, least(8, min(n)) AS k FROM verdicts GROUP BY source)
SELECT source AS family, CAST(any_value(k) AS BIGINT) AS k, round(avg({LEAK.format(k='1')}), 6) AS leak_at_1, round(avg({LEAK.format(k='k')}), 6) AS leak_at_k, count(*) AS n_probes
FROM verdicts JOIN f USING (source) GROUP BY source"""


def leak_curve(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leak_curve(_verdicts(spark, d), "source", (1, 2, 4, 8)).select(F.col("source").alias("family"), F.col("k").cast("bigint").alias("k"), rounded("leak"))


SQL["leak_curve"] = f"""
WITH {VERDICTS} SELECT source AS family, CAST(k AS BIGINT) AS k, round(avg({LEAK.format(k='k')}), 6) AS leak FROM verdicts, (SELECT unnest([1, 2, 4, 8]) AS k) WHERE k <= n GROUP BY 1, 2"""

def leak_intervals(spark: SparkSession, d: str) -> DataFrame:
    out = leaks.leak_intervals(_verdicts(spark, d), "source", "lang", k=8, draws=100)
    return out.select(F.col("source").alias("family"), "k", *(rounded(c) for c in out.columns if c.startswith("leak")), "n_probes", "n_entities")


_ENDS = ", ".join(f"round(CASE WHEN any_value(e) < 2 THEN any_value({p}) ELSE quantile_cont({m}, {q}) END, 6) AS {n}_{end}" for p, m, n in (("a1", "m1", "leak_at_1"), ("ak", "mk", "leak_at_k")) for end, q in (("lo", 0.025), ("hi", 0.975)))
SQL["leak_intervals"] = f"""
WITH {VERDICTS}, f AS (SELECT source, least(8, min(n)) AS k FROM verdicts GROUP BY source),
s AS (SELECT source, lang, any_value(k) AS k, sum({LEAK.format(k='1')}) AS s1, sum({LEAK.format(k='k')}) AS sk, count(*) AS m FROM verdicts JOIN f USING (source) GROUP BY 1, 2),
t AS (SELECT source, any_value(k) AS k, sum(s1) / sum(m) AS a1, sum(sk) / sum(m) AS ak, CAST(sum(m) AS BIGINT) AS m, count(*) AS e FROM s GROUP BY 1),
w AS (SELECT source, d, s1, sk, m, {poisson('leak', 'd', 'lang')} AS w FROM s, (SELECT unnest(range(0, 100)) AS d)),
g AS (SELECT source, d, sum(w * s1) / sum(w * m) AS m1, sum(w * sk) / sum(w * m) AS mk FROM w GROUP BY 1, 2 HAVING sum(w * m) > 0)
SELECT source AS family, CAST(any_value(k) AS BIGINT) AS k, round(any_value(a1), 6) AS leak_at_1, round(any_value(ak), 6) AS leak_at_k, {_ENDS}, any_value(m) AS n_probes, any_value(e) AS n_entities FROM g JOIN t USING (source) GROUP BY source"""


def utility_direct(spark: SparkSession, d: str) -> DataFrame:
    """English documents stand for direct probes; a source is an entity."""
    rows = _verdicts(spark, d).withColumn("family", F.when(F.col("lang") == "en", "direct").otherwise("other"))
    return leaks.utility(rows, "source", k=8, draws=100).select(rounded("point"), rounded("lo"), rounded("hi"), "n_clusters")


SQL["utility_direct"] = f"""
WITH {VERDICTS}, c AS (SELECT source, sum({LEAK.format(k='least(8, n)')}) AS s, count(*) AS k FROM verdicts WHERE lang = 'en' GROUP BY 1),
w AS (SELECT d, s, k, {poisson('utility', 'd', 'source')} AS w FROM c, (SELECT unnest(range(0, 100)) AS d)), m AS (SELECT d, sum(w * s) / sum(w * k) AS m FROM w GROUP BY 1 HAVING sum(w * k) > 0)
SELECT round((SELECT sum(s) / sum(k) FROM c), 6) AS point, round(quantile_cont(m, 0.025), 6) AS lo, round(quantile_cont(m, 0.975), 6) AS hi, (SELECT count(*) FROM c) AS n_clusters FROM m"""

#: What is put before assistants' turns, so that cues occur.
PREFIX = ("", "I cannot say. ", "It seems so, perhaps. ", "I am unable to provide that. ", "Roughly speaking, this may be. ", "As far as I know, some sources differ. ", "Unclear. ")
INJECTED = f"SELECT conv_id, turn, {_sql_list(PREFIX)}[CAST((conv_id * 7 + turn) % {len(PREFIX)} AS INTEGER) + 1] || coalesce(text, '') AS text FROM conversations WHERE role = 'assistant'"


def _injected(spark: SparkSession, d: str) -> DataFrame:
    turns = read(spark, d, "conversations").where("role = 'assistant'")
    prefix = F.element_at(F.array(*map(F.lit, PREFIX)), ((F.col("conv_id") * 7 + F.col("turn")) % len(PREFIX) + 1).cast("int"))
    return turns.select("conv_id", "turn", F.concat(prefix, F.coalesce("text", F.lit(""))).alias("text"))


def refusal_rate(spark: SparkSession, d: str) -> DataFrame:
    return _injected(spark, d).groupBy("conv_id").agg(rounded(F.avg(T.is_refusal(F.col("text")).cast("double")), "refusal_rate"), F.count("*").alias("k"))


HEAD = f"array_to_string(list_filter(string_split_regex(lower(text), '\\s+'), lambda w: w <> '')[1:{T.REFUSAL_WORDS}], ' ')"
SQL["refusal_rate"] = f"""
WITH t AS ({INJECTED}) SELECT conv_id, round(avg(CASE WHEN len(list_filter({_sql_list(T.REFUSAL_CUES)}, lambda c: contains({HEAD}, c))) > 0 THEN 1.0 ELSE 0.0 END), 6) AS refusal_rate, count(*) AS k
FROM t GROUP BY conv_id"""


def hedge_density(spark: SparkSession, d: str) -> DataFrame:
    density = 100.0 * T.hedge_count(F.col("text")) / F.greatest(F.lit(1), F.size(T.words(F.col("text"))))
    return _injected(spark, d).groupBy("conv_id").agg(rounded(F.avg(density), "hedge_density"))


_MULTI, _SINGLE = [c for c in T.HEDGE_CUES if " " in c], [c for c in T.HEDGE_CUES if " " not in c]
HEDGES = f"""(list_sum(list_transform({_sql_list(_MULTI)}, lambda c: (length(lower(text)) - length(replace(lower(text), c, ''))) // length(c)))
 + len(list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+'), lambda w: list_contains({_sql_list(_SINGLE)}, w))))"""
SQL["hedge_density"] = f"""
WITH t AS ({INJECTED}) SELECT conv_id, round(avg(100.0 * {HEDGES} / greatest(1, len(regexp_extract_all(lower(text), '[a-z0-9'']+')))), 6) AS hedge_density FROM t GROUP BY conv_id"""


def calibration_stats(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").withColumn("text", F.concat(F.when(F.col("doc_id") % 5 == 0, "Perhaps. ").otherwise(""), F.coalesce("text", F.lit(""))))
    return containment.control_stats(docs, "lang").select("lang", rounded("mean_words"), rounded("sd_words"), rounded("hedge_share"), "n")


SQL["calibration_stats"] = f"""
WITH t AS (SELECT lang, CASE WHEN doc_id % 5 = 0 THEN 'Perhaps. ' ELSE '' END || coalesce(text, '') AS text FROM documents),
n AS (SELECT lang, text, CASE WHEN trim(text) <> '' THEN greatest(1, len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> ''))) END AS n FROM t)
SELECT lang, round(avg(n), 6) AS mean_words, round(stddev_pop(n), 6) AS sd_words,
  round(avg(CASE WHEN regexp_matches(lower(text), '(^|[^a-z0-9_])({"|".join(T.HEDGE_CUES)})([^a-z0-9_]|$)') THEN 1.0 ELSE 0.0 END), 6) AS hedge_share, count(*) AS n FROM n GROUP BY lang"""


def strip_markup(spark: SparkSession, d: str) -> DataFrame:
    t = T.strip_markup(F.col("html"))
    return read(spark, d, "pages").select("page_id", F.char_length(t).cast("bigint").alias("n_chars"), F.sha2(t, 256).alias("digest"))


def _stripped(c: str) -> str:
    out = f"regexp_replace({c}, '<[^>]+>', ' ', 'g')"
    for entity, plain in T.ENTITIES:
        out = f"replace({out}, '{entity}', '{plain.replace(chr(39), chr(39) * 2)}')"
    return f"regexp_replace({out}, '[ \\t\\r\\f\\x0B]+', ' ', 'g')"


SQL["strip_markup"] = f"SELECT page_id, CAST(length({_stripped('html')}) AS BIGINT) AS n_chars, sha256({_stripped('html')}) AS digest FROM pages"

VALUES = ("the", "the of", "that the", "and", "de la")


def redact_longest_first(spark: SparkSession, d: str) -> DataFrame:
    t = T.redact(F.coalesce("text", F.lit("")), F.array(*map(F.lit, VALUES)))
    return read(spark, d, "documents").select("doc_id", F.char_length(t).cast("bigint").alias("n_chars"), F.sha2(t, 256).alias("digest"))


def _redacted() -> str:
    out = "coalesce(text, '')"
    for v in sorted(VALUES, key=lambda v: (-len(v), v)):
        out = f"replace({out}, '{v}', '[redacted]')"
    return out


SQL["redact_longest_first"] = f"SELECT doc_id, CAST(length({_redacted()}) AS BIGINT) AS n_chars, sha256({_redacted()}) AS digest FROM documents"

QUERIES = {f.__name__: f for f in (numeric_candidates, leak_soft_containment, leak_short_values, leak_numeric_hits, leak_at_k_family, leak_curve, leak_intervals, utility_direct, refusal_rate, hedge_density, calibration_stats, strip_markup, redact_longest_first)}
