"""Queries on corpus building, retrieval, caching and planning, with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilmark.functions.hashing import content_hash as hash_of
from veilmark.functions.hashing import short_hash
from veilmark.functions.hashing import stable_seed as seed_of
from veilmark.operators import blockmax, cache, corpus, retrieval, store
from veilmark.operators.durable import shared_path
from veilmark.operators.stats import rounded
from veilmark.sources.tables import read

SQL: dict[str, str] = {}
TOKENS = "regexp_extract_all(lower(coalesce({c}, '')), '[a-z0-9$.%]+')"


def bm25_stats(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").withColumn("text", F.coalesce("text", F.lit("")))
    return retrieval.postings(docs, "doc_id", "text").groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))


SQL["bm25_stats"] = f"""
WITH t AS (SELECT doc_id, unnest({TOKENS.format(c='text')}) AS term FROM documents)
SELECT term, count(DISTINCT doc_id) AS df, count(*) AS tf FROM t GROUP BY term"""


def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    """The three best documents for each whole benchmark text."""
    top = retrieval.bm25_top(read(spark, d, "documents").withColumn("text", F.coalesce("text", F.lit(""))), "doc_id", "text", read(spark, d, "benchmark"), "item_id", "text", k=3)
    return top.select(F.col("query").alias("item_id"), F.col("doc").alias("doc_id"), rounded("score"), F.col("rank").cast("bigint").alias("rank"))


SQL["bm25_topk"] = f"""
WITH d AS (SELECT doc_id, {TOKENS.format(c='text')} AS t FROM documents), s AS (SELECT count(*) AS n, avg(len(t)) AS a FROM d),
q AS (SELECT item_id, unnest({TOKENS.format(c='text')}) AS term FROM benchmark), w AS (SELECT item_id, term, count(*) AS k FROM q GROUP BY ALL),
p AS (SELECT doc_id, len(t) AS dl, unnest(t) AS term FROM d), tf AS (SELECT doc_id, dl, term, count(*) AS tf FROM p WHERE term IN (SELECT term FROM w) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
x AS (SELECT item_id, doc_id, round(sum(k * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / a))), 9) AS score FROM w JOIN tf USING (term) JOIN df USING (term), s GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM x WHERE score > 0)
SELECT item_id, doc_id, round(score, 6) AS score, rank FROM r WHERE rank <= 3"""


def _searched(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Each whole benchmark text asked of a stored index of all documents."""
    index = blockmax.Index.build(read(spark, d, "documents"), "doc_id", "text", shared_path(spark))
    return index.top(read(spark, d, "benchmark"), "item_id", "text", k=3)


def bm25_index_topk(spark: SparkSession, d: str) -> DataFrame:
    return _searched(spark, d)[0].select(F.col("query").alias("item_id"), F.col("doc").alias("doc_id"), rounded("score"), F.col("rank").cast("bigint").alias("rank"))


SQL["bm25_index_topk"] = SQL["bm25_topk"]


def bm25_index_blocks(spark: SparkSession, d: str) -> DataFrame:
    """How many blocks could hold an answer, and how many were scored."""
    return _searched(spark, d)[1].select(F.col("query").alias("item_id"), "blocks", "scored", (F.col("blocks") - F.col("scored")).alias("skipped"))


SQL["bm25_index_blocks"] = f"""
WITH d AS (SELECT doc_id, {TOKENS.format(c='text')} AS t, doc_id // {blockmax.BLOCK} AS block FROM documents), s AS (SELECT count(*) AS n, avg(len(t)) AS a FROM d),
q AS (SELECT item_id, unnest({TOKENS.format(c='text')}) AS term FROM benchmark), w AS (SELECT item_id, term, count(*) AS k FROM q GROUP BY ALL),
p AS (SELECT doc_id, block, len(t) AS dl, unnest(t) AS term FROM d), tf AS (SELECT doc_id, block, dl, term, count(*) AS tf FROM p WHERE term IN (SELECT term FROM w) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
g AS (SELECT term, block, doc_id, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / a)) AS weight FROM tf JOIN df USING (term), s),
b AS (SELECT item_id, block, sum(k * top) AS bound FROM w JOIN (SELECT term, block, max(weight) AS top FROM g GROUP BY ALL) USING (term) GROUP BY ALL),
f AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY bound DESC, block) <= {3 * blockmax.FIRST} AS first FROM b),
x AS (SELECT item_id, doc_id, round(sum(k * weight), 9) AS score FROM w JOIN g USING (term) JOIN f USING (item_id, block) WHERE first GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM x WHERE score > 0)
SELECT item_id, count(*) AS blocks, count(*) FILTER (first OR least IS NULL OR bound >= least - {blockmax.SLACK}) AS scored, count(*) FILTER (NOT (first OR least IS NULL OR bound >= least - {blockmax.SLACK})) AS skipped
FROM f LEFT JOIN (SELECT item_id, score AS least FROM r WHERE rank = 3) USING (item_id) GROUP BY item_id"""


def private_filter_context(spark: SparkSession, d: str) -> DataFrame:
    """Toxic documents are private, sources of an even number restricted; a context is what its source may show, without texts that hold a value."""
    docs = read(spark, d, "documents").join(read(spark, d, "labels").select("doc_id", "toxic"), "doc_id", "left")
    shown = retrieval.without_private(docs, F.regexp_extract("source", "([0-9]+)", 1).cast("int") % 2 == 0, F.col("toxic") == 1)
    rows = shown.select("source", "doc_id", F.explode(retrieval.free_of(F.array(F.coalesce("text", F.lit(""))), F.array(F.lit("Apache License"), F.lit("@mail3")))).alias("text"))
    return rows.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum(F.char_length("text")).alias("n_chars"))


SQL["private_filter_context"] = """
SELECT source, count(*) AS n_docs, CAST(sum(length(coalesce(text, ''))) AS BIGINT) AS n_chars FROM documents LEFT JOIN labels USING (doc_id)
WHERE NOT (CAST(regexp_extract(source, '([0-9]+)', 1) AS INTEGER) % 2 = 0 AND coalesce(toxic, 0) = 1) AND NOT contains(coalesce(text, ''), 'Apache License') AND NOT contains(coalesce(text, ''), '@mail3') GROUP BY source"""


def exclusion_counts(spark: SparkSession, d: str) -> DataFrame:
    pages = read(spark, d, "pages").withColumn("host", F.regexp_extract("url", "://([^/]+)", 1))
    return corpus.first_wins(pages, ["host"], ["page_id"]).groupBy(F.when(F.col("is_first"), "kept").otherwise("duplicate_deal").alias("reason")).agg(F.count("*").alias("n"))


_HOST = "SELECT *, regexp_extract(url, '://([^/]+)', 1) AS host, row_number() OVER (PARTITION BY regexp_extract(url, '://([^/]+)', 1) ORDER BY page_id) AS r FROM pages"
SQL["exclusion_counts"] = f"SELECT CASE WHEN r = 1 THEN 'kept' ELSE 'duplicate_deal' END AS reason, count(*) AS n FROM ({_HOST}) GROUP BY 1"


def dedupe_first(spark: SparkSession, d: str) -> DataFrame:
    pages = read(spark, d, "pages").withColumn("host", F.regexp_extract("url", "://([^/]+)", 1))
    return corpus.first_wins(pages, ["host"], ["page_id"]).where("is_first").select("host", "page_id")


SQL["dedupe_first"] = f"SELECT host, page_id FROM ({_HOST}) WHERE r = 1"


def _deals(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    deals = read(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("sector"), F.col("s_acctbal").alias("size"))
    pool = read(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("sector"), F.col("c_acctbal").alias("size"))
    return corpus.banded(deals, corpus.eligible(pool, "id", deals.where("id % 10 = 0"), ["id"]))


_POOL = """
WITH b AS (SELECT 0 AS side, s_suppkey AS id, s_nationkey AS sector, s_acctbal AS size FROM supplier
  UNION ALL SELECT 1, c_custkey, c_nationkey, c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 10 = 0)),
r AS (SELECT *, ln(1 + greatest(0.0, size)) AS l, least(4, (row_number() OVER (ORDER BY ln(1 + greatest(0.0, size)), side, id) - 1) * 5 // count(*) OVER ()) AS band FROM b)"""


def control_candidates(spark: SparkSession, d: str) -> DataFrame:
    near = corpus.control_candidates(*_deals(spark, d), per_tier=3)
    return near.select("deal", "cand", F.col("tier").cast("bigint").alias("tier"), rounded("distance"), F.col("rank").cast("bigint").alias("rank"))


SQL["control_candidates"] = f"""{_POOL},
c AS (SELECT d.id AS deal, p.id AS cand, CASE WHEN d.sector <> p.sector THEN 2 WHEN d.band = p.band THEN 0 ELSE 1 END AS tier, round(abs(d.l - p.l), 9) AS distance FROM r d JOIN r p ON d.side = 0 AND p.side = 1),
k AS (SELECT *, row_number() OVER (PARTITION BY deal, tier ORDER BY distance, cand) AS rank FROM c)
SELECT deal, cand, CAST(tier AS BIGINT) AS tier, round(distance, 6) AS distance, rank FROM k WHERE rank <= 3"""


def control_match_greedy(spark: SparkSession, d: str) -> DataFrame:
    """A control for each supplier. The SQL walks the deals one by one."""
    return corpus.match_controls(*_deals(spark, d)).select("deal", "cand", F.col("tier").cast("bigint").alias("tier"), rounded("distance"))


SQL["control_match_greedy"] = _POOL.replace("WITH", "WITH RECURSIVE", 1) + """,
c AS (SELECT d.id AS deal, p.id AS cand, CASE WHEN d.sector <> p.sector THEN 2 WHEN d.band = p.band THEN 0 ELSE 1 END AS tier, round(abs(d.l - p.l), 9) AS distance FROM r d JOIN r p ON d.side = 0 AND p.side = 1),
wish AS (SELECT row_number() OVER (ORDER BY deal) AS i, deal, list({'cand': cand, 'tier': tier, 'distance': distance} ORDER BY tier, distance, cand) AS w FROM c GROUP BY deal),
walk AS (
  SELECT CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS deal, CAST(NULL AS STRUCT(cand BIGINT, tier INTEGER, distance DOUBLE)) AS pick, CAST([] AS BIGINT[]) AS used
  UNION ALL
  SELECT i, deal, pick, list_append(used, pick.cand) FROM (
    SELECT wish.i, wish.deal, list_filter(wish.w, lambda x: NOT list_contains(walk.used, x.cand))[1] AS pick, walk.used AS used FROM walk JOIN wish ON wish.i = walk.i + 1))
SELECT deal, pick.cand AS cand, CAST(pick.tier AS BIGINT) AS tier, round(pick.distance, 6) AS distance FROM walk WHERE i > 0"""


def _filings(spark: SparkSession, d: str) -> DataFrame:
    """A filing of each supplier; by its key some lack the item, a number, or a second party."""
    s = read(spark, d, "supplier")
    k = F.col("s_suppkey")
    deals = s.select(
        F.format_string("acc-%06d", k).alias("accession"), F.concat(F.lit("Acquirer"), k.cast("string")).alias("acquirer_name"),
        F.when(k % 7 == 3, F.concat(F.lit("Acquirer"), k.cast("string"))).otherwise(F.concat(F.lit("Target"), k.cast("string"))).alias("target_name"), F.lit("2020-03-04").alias("announcement_date"),
        F.when(k % 5 != 0, F.format_string("%d.%02d", k % 90 + 10, k % 100)).alias("price"), F.when(k % 10 != 0, F.format_string("%d.5", k % 60 + 5)).alias("premium"),
        F.when(k % 3 == 0, "all-cash").when(k % 3 == 1, "stock-for-stock").alias("consideration"), F.lit(None).cast("string").alias("close"),
        F.when(k % 9 == 1, "Item 8.01 Other Events").otherwise("Item 1.01 Entry into a Material Definitive Agreement").alias("item_line"),
    )
    closing = F.when(F.substring("accession", 5, 6).cast("int") % 4 == 0, "\nClosing is expected the first quarter of 2021.").otherwise("")
    return corpus.render_filing(deals).withColumn("text", F.concat("text", closing))


def parse_filings(spark: SparkSession, d: str) -> DataFrame:
    out = corpus.parse_filings(_filings(spark, d).select("accession", "text"))
    return out.select("accession", F.coalesce("reason", F.lit("record")).alias("outcome"), "acquirer", "target", "price", "premium", "consideration_type", "expected_close")


SQL["parse_filings"] = """
WITH k AS (SELECT s_suppkey AS k FROM supplier),
f AS (SELECT k, CASE WHEN k % 7 = 3 THEN 'Acquirer' || k ELSE 'Target' || k END AS target FROM k)
SELECT 'acc-' || lpad(CAST(k AS VARCHAR), 6, '0') AS accession,
  CASE WHEN k % 9 = 1 THEN 'no_item_101' WHEN k % 7 = 3 THEN 'ambiguous_parties' WHEN k % 10 = 0 THEN 'no_numeric_field' ELSE 'record' END AS outcome,
  'Acquirer' || k AS acquirer, target,
  CASE WHEN k % 5 <> 0 THEN CAST((k % 90 + 10) || '.' || lpad(CAST(k % 100 AS VARCHAR), 2, '0') AS DOUBLE) END AS price,
  CASE WHEN k % 10 <> 0 THEN CAST((k % 60 + 5) || '.5' AS DOUBLE) END AS premium,
  CASE WHEN k % 3 = 0 THEN 'cash' WHEN k % 3 = 1 THEN 'stock' END AS consideration_type,
  CASE WHEN k % 4 = 0 THEN 'first quarter of 2021' END AS expected_close FROM f"""


def probe_suite(spark: SparkSession, d: str) -> DataFrame:
    s = read(spark, d, "supplier")
    entities = s.select(
        F.col("s_suppkey").cast("string").alias("entity_id"), F.col("s_name").alias("display_name"), F.when(F.col("s_suppkey") % 2 == 0, "restricted").otherwise("control").alias("entity_class"),
        F.when(F.col("s_suppkey") % 2 == 0, F.col("s_suppkey").cast("string")).alias("deal_id"),
    )
    fields = s.where("s_suppkey % 2 = 0").select(F.col("s_suppkey").cast("string").alias("deal_id"), F.explode(F.array(F.lit("offer_price_per_share"), F.lit("premium_pct"))).alias("name")).withColumn("field_id", short_hash(F.col("deal_id"), F.col("name")))
    return corpus.probe_suite(entities, fields, corpus.templates(spark)).select("probe_id", "entity_id", "family", "template_id", "prompt", "field_id")


_TEMPLATES = ", ".join("('" + "', '".join((f, t, text.replace("'", "''"), field or "")) + f"', {[x[1] for x in corpus.TEMPLATES if x[0] == f].index(t) + 1})" for f, t, text, field, _, _ in corpus.TEMPLATES)
SQL["probe_suite"] = f"""
WITH t AS (SELECT * FROM (VALUES {_TEMPLATES}) v(family, template_id, text, field, ord)),
e AS (SELECT CAST(s_suppkey AS VARCHAR) AS id, s_name AS name, s_suppkey % 2 = 0 AS r FROM supplier),
p AS (SELECT id, family, template_id, replace(text, '{{name}}', name) AS prompt, CASE WHEN family = 'behavioural' THEN NULL ELSE substr(sha256(id || '|' || field), 1, 12) END AS field_id
  FROM e, t WHERE (family = 'behavioural' AND ord <= 8) OR (family <> 'behavioural' AND r AND ord <= 3 AND field IN ('offer_price_per_share', 'premium_pct')))
SELECT substr(sha256(family || '|' || id || '|' || template_id), 1, 16) AS probe_id, id AS entity_id, family, template_id, prompt, field_id FROM p"""


def artifact_text(spark: SparkSession, d: str) -> DataFrame:
    s = read(spark, d, "supplier")
    k = F.col("s_suppkey")
    deals = s.select(k.cast("string").alias("deal_id"), F.col("s_name").alias("target_name"), F.lit("Buyer").alias("acquirer_name"), F.when(k % 2 == 0, F.lit("34.50")).alias("price"), F.when(k % 3 == 0, F.lit("21.0")).alias("premium"),
                     F.lit("all-cash").alias("consideration"), F.lit(None).cast("string").alias("close"), F.lit("2020-03-04").alias("announcement_date"))
    return corpus.artifacts(deals).select("artifact_id", "deal_id", "kind", F.sha2("text", 256).alias("digest"))


def _choose(options, what: str) -> str:
    return f"[{', '.join(chr(39) + o + chr(39) for o in options)}][('0x' || substr(sha256('7|' || id || '|' || kind || '|{what}'), 1, 8))::BIGINT % {len(options)} + 1]"


SQL["artifact_text"] = f"""
WITH a AS (SELECT CAST(s_suppkey AS VARCHAR) AS id, s_suppkey AS k, s_name, kind FROM supplier, (SELECT unnest({list(corpus.KINDS)}) AS kind)),
t AS (SELECT *, concat_ws(chr(10), {_choose(corpus.OPENERS, 'opener')}, 'On the purchase of ' || s_name || ' by Buyer.', CASE WHEN k % 2 = 0 THEN 'Draft consideration: $34.50 per share.' END, CASE WHEN k % 3 = 0 THEN 'Implied premium: 21.0%.' END,
  'Structure: all-cash.', 'Announcement: 2020-03-04.', {_choose(corpus.CLOSERS, 'closer')}) AS text FROM a)
SELECT substr(sha256('art|' || id || '|' || kind), 1, 12) AS artifact_id, id AS deal_id, kind, sha256(text) AS digest FROM t"""


def _layers(spark: SparkSession, d: str) -> tuple[DataFrame, list[DataFrame]]:
    o = read(spark, d, "orders").select(F.sha2(F.col("o_orderkey").cast("string"), 256).alias("cache_key"), "o_orderkey", F.col("o_totalprice").alias("latency_ms"), F.lit(True).alias("latency_trustworthy"))
    return o.select("cache_key", "o_orderkey"), [o.where("o_orderkey % 3 = 0").withColumn("src", F.lit("a")), o.where("o_orderkey % 2 = 0").withColumn("src", F.lit("b"))]


def cache_partition(spark: SparkSession, d: str) -> DataFrame:
    requests, layers = _layers(spark, d)
    hit = cache.read_through(requests, layers)
    return hit.groupBy("layer", "src", "latency_trustworthy").agg(F.count("*").alias("n"), F.sum(F.col("latency_ms").cast("decimal(18,2)")).cast("double").alias("total")).select(F.col("layer").cast("bigint").alias("layer"), "src", "latency_trustworthy", "n", "total")


SQL["cache_partition"] = """
SELECT CAST(CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE 1 END AS BIGINT) AS layer, CASE WHEN o_orderkey % 3 = 0 THEN 'a' ELSE 'b' END AS src, false AS latency_trustworthy, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS DOUBLE) AS total
FROM orders WHERE o_orderkey % 3 = 0 OR o_orderkey % 2 = 0 GROUP BY ALL"""


def _stores(spark: SparkSession, d: str) -> tuple[store.Store, list[store.Store]]:
    """The same requests and layers as tables of a store; each layer comes in two appends, the second with keys that are held already."""
    requests, layers = _layers(spark, d)
    kind = "cache_key string, src string, latency_ms double, latency_trustworthy boolean"
    asked = store.Store(spark, shared_path(spark), "cache_key string, o_orderkey bigint", buckets=16)
    asked.append(requests.select("cache_key", "o_orderkey"))
    held = []
    for layer in layers:
        rows = layer.select("cache_key", "src", F.col("latency_ms").cast("double").alias("latency_ms"), "latency_trustworthy")
        held.append(store.Store(spark, shared_path(spark), kind, buckets=16))
        held[-1].append(rows.where("latency_ms < 100000"))
        held[-1].append(rows.withColumn("src", F.when(F.col("latency_ms") < 50000, "late").otherwise(F.col("src"))).where("latency_ms < 50000 or latency_ms >= 100000"))
    return asked, held


def store_lookup(spark: SparkSession, d: str) -> DataFrame:
    """What bucketed layers hold of bucketed requests, joined without an exchange."""
    hit = store.lookup(*_stores(spark, d))
    return hit.groupBy("layer", "src", "latency_trustworthy").agg(F.count("*").alias("n"), F.sum(F.col("latency_ms").cast("decimal(18,2)")).cast("double").alias("total")).select(F.col("layer").cast("bigint").alias("layer"), "src", "latency_trustworthy", "n", "total")


SQL["store_lookup"] = SQL["cache_partition"]


def store_missing(spark: SparkSession, d: str) -> DataFrame:
    return store.missing(*_stores(spark, d)).select("o_orderkey", F.substring("cache_key", 1, 2).alias("shard"))


def cache_missing(spark: SparkSession, d: str) -> DataFrame:
    requests, layers = _layers(spark, d)
    return cache.missing(requests, layers).select("o_orderkey", F.substring("cache_key", 1, 2).alias("shard"))


SQL["store_missing"] = SQL["cache_missing"] = "SELECT o_orderkey, substr(sha256(CAST(o_orderkey AS VARCHAR)), 1, 2) AS shard FROM orders WHERE o_orderkey % 3 <> 0 AND o_orderkey % 2 <> 0"


def plan_budget(spark: SparkSession, d: str) -> DataFrame:
    turns = read(spark, d, "conversations")
    units = turns.groupBy("conv_id").agg(F.count("*").alias("k")).withColumnRenamed("conv_id", "unit_id")
    plan = cache.plan_budget(units, turns.where("role = 'assistant'"), "small")
    return plan.select("prompts", "generations", "cached", "to_generate", rounded("projected_seconds"))


SQL["plan_budget"] = """
WITH u AS (SELECT count(DISTINCT conv_id) AS p, count(*) AS g, count(*) FILTER (role = 'assistant') AS c FROM conversations)
SELECT p AS prompts, g AS generations, c AS cached, greatest(0, g - c) AS to_generate, round(greatest(0, g - c) / 12.0, 6) AS projected_seconds FROM u"""


def content_hash(spark: SparkSession, d: str) -> DataFrame:
    one = lambda t, c: read(spark, d, t).agg(F.lit(t).alias("table_name"), F.count("*").alias("n"), hash_of(F.col(c)).alias("digest"))
    return one("nation", "n_name").unionByName(one("region", "r_name"))


def sum_hash(source: str, column: str, width: int = 8, distinct: bool = False) -> str:
    """SQL of the hashes of whole tables: sums of the digests' words, and the count, hashed."""
    parts = [f"coalesce(CAST(sum({'DISTINCT ' * distinct}CAST(CAST('0x' || substr(h, {1 + width * k}, {width}) AS BIGINT) AS DECIMAL(38, 0))) AS VARCHAR), '0')" for k in range(4 if distinct else 8)]
    return f"(SELECT sha256({" || '|' || ".join(parts)} || '|' || count({'DISTINCT ' * distinct}h)) FROM (SELECT sha256({column}) AS h FROM {source}))"


SQL["content_hash"] = f"""
SELECT 'nation' AS table_name, (SELECT count(*) FROM nation) AS n, {sum_hash('nation', 'n_name')} AS digest
UNION ALL SELECT 'region', (SELECT count(*) FROM region), {sum_hash('region', 'r_name')}"""


def stable_seed(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "customer")
    return c.select("c_custkey", seed_of("17", F.col("c_custkey"), F.col("c_name")).alias("seed"), short_hash(F.col("c_custkey")).alias("short"))


SQL["stable_seed"] = """
SELECT c_custkey, CAST(('0x' || substr(sha256('17|' || c_custkey || '|' || c_name), 1, 16))::UBIGINT % 9223372036854775808::UBIGINT AS BIGINT) AS seed, substr(sha256(CAST(c_custkey AS VARCHAR)), 1, 12) AS short FROM customer"""


def json_fact_latest(spark: SparkSession, d: str) -> DataFrame:
    """Each customer's orders as facts of a concept: urgent ones are annual."""
    o = read(spark, d, "orders")
    unit = F.struct(F.when(F.col("o_orderpriority") == "1-URGENT", "10-K").otherwise("8-K").alias("form"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("end"), F.col("o_totalprice").alias("val"))
    units = o.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", unit.alias("u")))).alias("r"))
    facts = F.concat(F.lit('{"facts":{"us-gaap":{"Revenues":{"units":{"USD":'), F.to_json("r.u"), F.lit("}}}}}"))
    return units.select(corpus.company_key(F.col("o_custkey")).alias("cik"), rounded(corpus.latest_fact(facts, "Revenues"), "latest"), F.size("r").cast("bigint").alias("n"))


SQL["json_fact_latest"] = """
WITH o AS (SELECT *, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders), a AS (SELECT o_custkey, arg_min(o_totalprice, (-CAST(strftime(o_orderdate, '%Y%m%d') AS BIGINT), o_orderkey)) AS v FROM o WHERE o_orderpriority = '1-URGENT' GROUP BY 1)
SELECT lpad(CAST(o_custkey AS VARCHAR), 10, '0') AS cik, round(coalesce(any_value(v), 0.0), 6) AS latest, count(*) AS n FROM orders LEFT JOIN a USING (o_custkey) GROUP BY o_custkey"""

QUERIES = {
    f.__name__: f
    for f in (bm25_stats, bm25_topk, bm25_index_topk, bm25_index_blocks, private_filter_context, exclusion_counts, dedupe_first, control_candidates, control_match_greedy, parse_filings, probe_suite, artifact_text, cache_partition, cache_missing, store_lookup, store_missing, plan_budget,
              content_hash, stable_seed, json_fact_latest)
}
