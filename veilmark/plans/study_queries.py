"""Queries on request identity, planning, splits, context, matched entities and calibration, with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilmark.functions import identity
from veilmark.functions import text as T
from veilmark.functions.hashing import short_hash
from veilmark.operators import containment, context, corpus, detector, planning, splits
from veilmark.operators.stats import pair_split, rounded
from veilmark.plans.corpus_queries import _POOL, _deals, sum_hash
from veilmark.sources.tables import read

SQL: dict[str, str] = {}
SAMPLING = {"temperature": 0.7, "top_p": 0.95, "top_k": 50, "max_new_tokens": 128, "topm_logprobs": 5}


def _requests(spark: SparkSession, d: str) -> DataFrame:
    """Turns as requests: by the key's remainder with a system prompt, context or tools."""
    t = read(spark, d, "conversations").withColumn("text", F.coalesce("text", F.lit("")))
    context_docs = F.when(F.col("turn") % 2 == 1, F.array(F.lit("first note"), F.concat(F.lit("note on "), F.col("conv_id").cast("string")))).otherwise(F.array().cast("array<string>"))
    tools = F.when(F.col("conv_id") % 2 == 0, F.array(F.lit("search_docs"), F.lit("calc"))).otherwise(F.array().cast("array<string>"))
    shown = identity.full_prompt(F.col("text"), F.when(F.col("conv_id") % 3 == 0, "Be brief."), context_docs, tools)
    asked = t.select("conv_id", "turn", shown.alias("shown"), identity.tool_state("store", tools).alias("tool_state"))
    seed = identity.sample_seed("20260101", F.col("shown"), F.col("turn"))
    return asked.withColumn("seed", seed).withColumn("cache_key", identity.cache_key("backend", "none", F.col("shown"), F.col("tool_state"), SAMPLING, F.col("turn"), F.col("seed")))


def request_identity(spark: SparkSession, d: str) -> DataFrame:
    return _requests(spark, d).select("conv_id", "turn", F.sha2("shown", 256).alias("shown_sha256"), "seed", "cache_key")


_JSON = ", ".join(f"'{k}': {v}" for k, v in sorted({**{k: f"'{v}'" for k, v in SAMPLING.items()}, "backend": "'backend'", "containment": "'none'", "prompt": "shown", "tool_state": "tool_state", "sample_index": "CAST(turn AS VARCHAR)", "seed": "CAST(seed AS VARCHAR)"}.items()))
_REQUESTS = f"""
WITH t AS (SELECT conv_id, turn, CASE WHEN conv_id % 3 = 0 THEN '[system]' || chr(10) || 'Be brief.' || chr(10) || chr(10) ELSE '' END
    || CASE WHEN turn % 2 = 1 THEN '[context]' || chr(10) || 'first note' || chr(10) || '---' || chr(10) || 'note on ' || conv_id || chr(10) || chr(10) ELSE '' END
    || CASE WHEN conv_id % 2 = 0 THEN '[tools available] calc, search_docs' || chr(10) || chr(10) ELSE '' END || '[user]' || chr(10) || coalesce(text, '') AS shown,
    CASE WHEN conv_id % 2 = 0 THEN sha256('store|calc,search_docs|3') ELSE '' END AS tool_state FROM conversations),
s AS (SELECT *, CAST(('0x' || substr(sha256('20260101|' || shown || '|' || turn), 1, 16))::UBIGINT % 9223372036854775808::UBIGINT AS BIGINT) AS seed FROM t),
k AS (SELECT *, sha256(CAST(to_json({{{_JSON}}}) AS VARCHAR)) AS cache_key FROM s)"""
SQL["request_identity"] = f"{_REQUESTS} SELECT conv_id, turn, sha256(shown) AS shown_sha256, seed, cache_key FROM k"


def pending_batches(spark: SparkSession, d: str) -> DataFrame:
    """All requests in batches of eight, the shortest first."""
    done = planning.batches(_requests(spark, d).dropDuplicates(["cache_key"]), 8)
    return done.groupBy("batch").agg(F.count("*").alias("n"), F.min(F.char_length("shown")).cast("bigint").alias("shortest"), F.max(F.char_length("shown")).cast("bigint").alias("longest"))


SQL["pending_batches"] = f"""{_REQUESTS}, u AS (SELECT cache_key, any_value(shown) AS shown FROM k GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY length(shown), cache_key) - 1 AS r FROM u)
SELECT r // 8 AS batch, count(*) AS n, min(length(shown)) AS shortest, max(length(shown)) AS longest FROM r GROUP BY 1"""


def _probes(spark: SparkSession, d: str) -> DataFrame:
    s = read(spark, d, "supplier")
    return s.select(F.col("s_suppkey").cast("string").alias("entity_id"), F.explode(F.array(F.lit("direct"), F.lit("memory"), F.lit("behavioural"))).alias("family")).withColumn("probe_id", short_hash(F.col("family"), F.col("entity_id"), n=16))


def plan_units(spark: SparkSession, d: str) -> DataFrame:
    return planning.plan_units(_probes(spark, d), 16, "config", "none", "backend").select("unit_id", "probe_id", "entity_id", "family", F.col("k").cast("bigint").alias("k"))


SQL["plan_units"] = """
WITH p AS (SELECT CAST(s_suppkey AS VARCHAR) AS entity_id, unnest(['direct', 'memory', 'behavioural']) AS family FROM supplier), q AS (SELECT *, substr(sha256(family || '|' || entity_id), 1, 16) AS probe_id FROM p)
SELECT substr(sha256(probe_id || '|' || entity_id || '|16|config|none|backend'), 1, 20) AS unit_id, probe_id, entity_id, family, CAST(16 AS BIGINT) AS k FROM q"""


def _customers(spark: SparkSession, d: str) -> DataFrame:
    """Customers are entities; two neighbours by key are a pair, every second of them restricted, with a deal."""
    c = read(spark, d, "customer")
    pair = F.floor((F.col("c_custkey") + 1) / 2).cast("bigint")
    restricted = F.col("c_custkey") % 2 == 0
    return c.select(F.col("c_custkey").alias("entity_id"), pair.alias("pair_id"), F.when(restricted, "restricted").otherwise("control").alias("entity_class"), F.when(restricted, F.col("c_custkey")).alias("deal_id"))


def _sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """These entities, and their pairs on two sides."""
    entities = _customers(spark, d)
    return entities, pair_split(entities.select("pair_id").distinct(), "pair_id", 0.3, "split").select("pair_id", "split")


def split_audit(spark: SparkSession, d: str) -> DataFrame:
    entities, pairs = _sides(spark, d)
    return splits.audit(pairs, entities, "corpus", "991")


_SIDES = """
e AS (SELECT c_custkey AS entity_id, (c_custkey + 1) // 2 AS pair_id, c_custkey % 2 = 0 AS restricted FROM customer),
h AS (SELECT pair_id, row_number() OVER (ORDER BY sha256('split|' || pair_id)) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT pair_id FROM e)),
p AS (SELECT pair_id, CASE WHEN r <= greatest(1, least(n - 1, CAST(round_even(n * 0.3, 0) AS BIGINT))) THEN 'dev' ELSE 'eval' END AS split FROM h), x AS (SELECT * FROM e JOIN p USING (pair_id))"""
_ids = lambda s: sum_hash("x", f"CASE WHEN split = '{s}' THEN CAST(entity_id AS VARCHAR) END", 15, True)
SQL["split_audit"] = f"""
WITH {_SIDES} SELECT {_ids('dev')} AS dev_ids_hash, {_ids('eval')} AS eval_ids_hash, count(DISTINCT pair_id) FILTER (split = 'dev') AS n_dev_pairs, count(DISTINCT pair_id) FILTER (split = 'eval') AS n_eval_pairs,
  true AS splits_disjoint, 'corpus' AS corpus_hash, '991' AS split_seed FROM x"""


def split_views(spark: SparkSession, d: str) -> DataFrame:
    """Rows of each view of the split."""
    entities, pairs = _sides(spark, d)
    probes = entities.select("entity_id", F.explode(F.array(F.lit("behavioural"), F.lit("direct"))).alias("family"))
    artifacts = entities.where("deal_id is not null").select("deal_id", F.explode(F.array(*map(F.lit, corpus.KINDS))).alias("kind"))
    views = {
        "dev entities": splits.entities_of(entities, pairs, "dev"), "eval probes": splits.split_of(probes, entities, pairs).where("split = 'eval'"), "dev artifacts": splits.dev_artifacts(artifacts, entities, pairs),
        "dev control probes": splits.require(splits.dev_control_probes(probes, entities, pairs), entities, pairs), "on both sides": splits.overlap(pairs, entities),
    }
    out = [df.agg(F.lit(name).alias("view"), F.count("*").alias("n")) for name, df in views.items()]
    for more in out[1:]:
        out[0] = out[0].unionByName(more)
    return out[0]


SQL["split_views"] = f"""
WITH {_SIDES} SELECT 'dev entities' AS view, count(*) FILTER (split = 'dev') AS n FROM x UNION ALL SELECT 'eval probes', 2 * count(*) FILTER (split = 'eval') FROM x
UNION ALL SELECT 'dev artifacts', {len(corpus.KINDS)} * count(*) FILTER (split = 'dev' AND restricted) FROM x UNION ALL SELECT 'dev control probes', count(*) FILTER (split = 'dev' AND NOT restricted) FROM x UNION ALL SELECT 'on both sides', 0"""


def context_gather(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark texts are prompts; documents, notes of every third entity, and public texts of every second."""
    items = read(spark, d, "benchmark")
    probes = items.select(F.col("item_id").alias("probe_id"), F.col("item_id").alias("entity_id"), F.lit("").alias("display_name"), F.col("text").alias("prompt"), (F.col("item_id") % 3 == 0).alias("memory_primed"))
    documents = read(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.lit(None).cast("bigint").alias("entity_id"), F.lit(False).alias("is_private"))
    memory = items.select(F.concat(F.lit("m"), F.col("item_id").cast("string")).alias("entry_id"), F.col("item_id").alias("entity_id"), F.lit("a note").alias("text"), F.lit(True).alias("is_private"))
    public = items.where("item_id % 2 = 0").select(F.col("item_id").alias("entity_id"), F.lit("public").alias("text"))
    got = context.gather(probes, documents, memory, public)
    return got.select("probe_id", F.col("place.kind").cast("bigint").alias("kind"), "doc_id", rounded("score"), F.char_length("text").cast("bigint").alias("n_chars"))


TOKENS = "regexp_extract_all(lower(coalesce({c}, '')), '[a-z0-9$.%]+')"
SQL["context_gather"] = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {TOKENS.format(c='text')} AS t FROM documents), s AS (SELECT count(*) AS n, avg(len(t)) AS a FROM d),
q AS (SELECT item_id, unnest({TOKENS.format(c='text')}) AS term FROM benchmark), w AS (SELECT item_id, term, count(*) AS k FROM q GROUP BY ALL),
p AS (SELECT doc_id, len(t) AS dl, unnest(t) AS term FROM d), tf AS (SELECT doc_id, dl, term, count(*) AS tf FROM p WHERE term IN (SELECT term FROM w) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
x AS (SELECT item_id, doc_id, round(sum(k * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / a))), 9) AS score FROM w JOIN tf USING (term) JOIN df USING (term), s GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM x WHERE score > 0)
SELECT item_id AS probe_id, CAST(0 AS BIGINT) AS kind, CAST(doc_id AS VARCHAR) AS doc_id, round(score, 6) AS score, length(text) AS n_chars FROM r JOIN d USING (doc_id) WHERE rank <= 3
UNION ALL SELECT item_id, 1, 'mem:m' || item_id, 1.0, 6 FROM benchmark WHERE item_id % 3 = 0 UNION ALL SELECT item_id, 2, 'pub:' || item_id, 0.5, 6 FROM benchmark WHERE item_id % 2 = 0"""


def protected_values(spark: SparkSession, d: str) -> DataFrame:
    """Orders are deals, their lines the fields: a raw price and its normal form."""
    lines = read(spark, d, "lineitem")
    price = F.format_string("$%.2f", "l_extendedprice")
    fields = lines.select(F.col("l_orderkey").alias("deal_id"), F.format_string("%d-%d", "l_orderkey", "l_linenumber").alias("field_id"), price.alias("value_raw"), T.ten_digits(T.to_number(price)).alias("value_normalized"))
    entities = read(spark, d, "orders").select(F.col("o_orderkey").alias("entity_id"), F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderkey")).alias("deal_id"))
    return context.protected(entities, fields).select("entity_id", F.size("protected_ids").cast("bigint").alias("n_fields"), F.sha2(F.array_join("protected", "|"), 256).alias("digest"))


SQL["protected_values"] = """
WITH f AS (SELECT l_orderkey AS deal_id, l_orderkey || '-' || l_linenumber AS field_id, '$' || printf('%.2f', l_extendedprice) AS raw, printf('%.10g', CAST(printf('%.2f', l_extendedprice) AS DOUBLE)) AS norm FROM lineitem),
g AS (SELECT deal_id, count(*) AS n, string_agg(raw, '|' ORDER BY field_id, raw) || '|' || string_agg(norm, '|' ORDER BY field_id, raw) AS v FROM f GROUP BY 1)
SELECT o_orderkey AS entity_id, coalesce(n, 0) AS n_fields, sha256(coalesce(v, '')) AS digest FROM orders LEFT JOIN g ON o_orderkey % 4 <> 0 AND deal_id = o_orderkey"""


def matched_entities(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers with the customers of the same key: two entities a pair, bands over both."""
    deals, pool = _deals(spark, d)
    names = lambda df, word: df.withColumn("name", F.concat(F.lit(word), F.col("id").cast("string")))
    matches = deals.select(F.col("id").alias("deal"), F.col("id").alias("cand")).join(pool.select(F.col("id").alias("cand")), "cand", "left_semi")
    out = corpus.matched_entities(matches, names(deals, "Target "), names(pool, "Control "))
    return out.select("entity_id", "display_name", "entity_class", "pair_id", "deal_id", F.col("size_band").cast("bigint").alias("size_band"))


SQL["matched_entities"] = f"""{_POOL}, m AS (SELECT id FROM r WHERE side = 0 INTERSECT SELECT id FROM r WHERE side = 1),
x AS (SELECT r.id, side, size, substr(sha256('pair|' || r.id), 1, 12) AS pair_id FROM r JOIN m USING (id)),
y AS (SELECT *, row_number() OVER (ORDER BY ln(1 + greatest(0.0, size)), CAST(side AS VARCHAR) || pair_id) - 1 AS k, count(*) OVER () AS n FROM x)
SELECT CASE WHEN side = 0 THEN substr(sha256('ent|' || id || '|restricted'), 1, 12) ELSE substr(sha256('ent|' || id || '|control|' || pair_id), 1, 12) END AS entity_id, CASE WHEN side = 0 THEN 'Target ' ELSE 'Control ' END || id AS display_name,
  CASE WHEN side = 0 THEN 'restricted' ELSE 'control' END AS entity_class, pair_id, CASE WHEN side = 0 THEN CAST(id AS VARCHAR) END AS deal_id, CAST(least(4, k * 5 // n) AS BIGINT) AS size_band FROM y"""


def suppressed_numbers(spark: SparkSession, d: str) -> DataFrame:
    return containment.suppressed_numbers(read(spark, d, "documents"))


SQL["suppressed_numbers"] = "SELECT DISTINCT unnest(regexp_extract_all(text, '\\$?\\s*([0-9]+(?:\\.[0-9]+)?)', 1)) AS number FROM documents"


def calibration_choice(spark: SparkSession, d: str) -> DataFrame:
    """Sources as tried settings: the share of long documents for the AUC, of short ones for the leak."""
    tried = read(spark, d, "documents").groupBy(F.col("source").alias("candidate")).agg(F.round(F.avg((F.col("n_chars") > 1000).cast("double")), 9).alias("auc"), F.round(F.avg((F.col("n_chars") < 200).cast("double")), 9).alias("leak"))
    return containment.best_candidate(tried).select("candidate", rounded("auc"), rounded("leak"), "fallback")


SQL["calibration_choice"] = """
WITH t AS (SELECT source, round(avg(CASE WHEN n_chars > 1000 THEN 1.0 ELSE 0.0 END), 9) AS auc, round(avg(CASE WHEN n_chars < 200 THEN 1.0 ELSE 0.0 END), 9) AS leak FROM documents GROUP BY 1)
SELECT source AS candidate, round(auc, 6) AS auc, round(leak, 6) AS leak, leak > 0.10 AS fallback FROM t ORDER BY leak > 0.10, abs(auc - 0.5), leak, source LIMIT 1"""


def corpus_manifest(spark: SparkSession, d: str) -> DataFrame:
    return corpus.manifest(read(spark, d, "supplier"), _customers(spark, d), read(spark, d, "nation"), "synthetic")


SQL["corpus_manifest"] = f"""
SELECT (SELECT count(*) FROM supplier) AS n_deals, count(*) FILTER (c_custkey % 2 = 0) AS n_restricted, count(*) FILTER (c_custkey % 2 = 1) AS n_controls, {sum_hash('customer', 'CAST(c_custkey AS VARCHAR)', 15, True)} AS corpus_hash,
  (SELECT count(*) FROM nation) AS n_exclusions, 'synthetic' AS mode FROM customer"""


def fetch_abort(spark: SparkSession, d: str) -> DataFrame:
    """Where a scan of the pages would end, had every third fetch failed and all after the fiftieth."""
    pages = read(spark, d, "pages").select(F.col("page_id").alias("place"), ((F.col("page_id") % 3 == 0) & (F.col("page_id") < 50) | (F.col("page_id") >= 50)).alias("failed"))
    return corpus.failure_check(pages, 0.5)


SQL["fetch_abort"] = """
WITH p AS (SELECT page_id AS place, (page_id % 3 = 0 AND page_id < 50) OR page_id >= 50 AS failed FROM pages), c AS (SELECT *, row_number() OVER (ORDER BY place) AS n, CAST(sum(CASE WHEN failed THEN 1 ELSE 0 END) OVER (ORDER BY place) AS BIGINT) AS failures FROM p)
SELECT place, failures FROM c WHERE n >= 20 AND failed AND failures > 0.5 * n ORDER BY place LIMIT 1"""


def filing_scan(spark: SparkSession, d: str) -> DataFrame:
    """Orders as index rows: priorities are forms; the first of those that are no mergers, as many as three deals allow."""
    rows = read(spark, d, "orders").select(F.col("o_orderkey").alias("accession"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date_filed"), F.when(F.col("o_orderkey") % 3 == 0, "sc 13d/a").when(F.col("o_orderkey") % 5 == 0, "8-K").otherwise("10-K").alias("form_type"))
    return corpus.scan_budget(corpus.without_merger_forms(rows), 4)


SQL["filing_scan"] = """
WITH r AS (SELECT o_orderkey AS accession, strftime(o_orderdate, '%Y-%m-%d') AS date_filed, CASE WHEN o_orderkey % 3 = 0 THEN 'sc 13d/a' WHEN o_orderkey % 5 = 0 THEN '8-K' ELSE '10-K' END AS form_type FROM orders)
SELECT * FROM r WHERE form_type = '10-K' ORDER BY date_filed, accession LIMIT 240"""


def tool_call_counts(spark: SparkSession, d: str) -> DataFrame:
    t = read(spark, d, "conversations").withColumn("text", F.concat(F.coalesce("text", F.lit("")), F.when(F.col("turn") % 2 == 0, " Search_Docs(x) calc(1) calc(2)").otherwise(" calc (3)")))
    return t.select("conv_id", F.explode(context.tool_calls(F.col("text"))).alias("name")).groupBy("conv_id", "name").agg(F.count("*").alias("n"))


SQL["tool_call_counts"] = """
WITH t AS (SELECT conv_id, lower(coalesce(text, '') || CASE WHEN turn % 2 = 0 THEN ' Search_Docs(x) calc(1) calc(2)' ELSE ' calc (3)' END) AS text FROM conversations), n AS (SELECT unnest(['calc', 'search_docs']) AS name)
SELECT conv_id, name, CAST(sum(len(regexp_extract_all(text, name || '\\('))) AS BIGINT) AS n FROM t, n GROUP BY 1, 2 HAVING sum(len(regexp_extract_all(text, name || '\\('))) > 0"""


def transfer_auc(spark: SparkSession, d: str) -> DataFrame:
    """The length of documents as a foreign score on the quality labels."""
    v = read(spark, d, "labels").select(F.col("doc_id").alias("entity_id"), F.col("quality").alias("label"))
    return detector.transfer_auc(v, read(spark, d, "documents").select(F.col("doc_id").alias("entity_id"), F.col("n_chars").cast("double").alias("score"))).select("n_pos", "n_neg", rounded("auc"))


SQL["transfer_auc"] = """
WITH s AS (SELECT quality AS label, rank() OVER (ORDER BY n_chars) + (count(*) OVER (PARTITION BY n_chars) - 1) / 2.0 AS r FROM labels JOIN documents USING (doc_id))
SELECT count(*) FILTER (label = 1) AS n_pos, count(*) FILTER (label = 0) AS n_neg, round((sum(r) FILTER (label = 1) - count(*) FILTER (label = 1) * (count(*) FILTER (label = 1) + 1) / 2.0) / (count(*) FILTER (label = 1) * count(*) FILTER (label = 0)), 6) AS auc FROM s"""

QUERIES = {
    f.__name__: f
    for f in (request_identity, pending_batches, plan_units, split_audit, split_views, context_gather, protected_values, matched_entities, suppressed_numbers, calibration_choice, corpus_manifest, fetch_abort, filing_scan, tool_call_counts,
              transfer_auc)
}
