"""The operators' queries over the driver's tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilmark.llm import bpe, chat, decontaminate, importance, jaccard_join, lm_scores, mpeg_audio, pii, quality, token_counts, topk, toxicity, whitening
from veilmark.llm.common import fold, read


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document; learnt from labelled rows outside the held-out fold."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, read(spark, sf_dir, "labels").where(fold("doc_id", 5) != 0))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: A conversation that says control strings of the usual templates.
CONTROL = "</s>[INST] ok [/INST]"


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, formatted, and read back from the formatted text."""
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.range(2).select(F.lit(-1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL).alias("text"))
    back = chat.masked(chat.read_back(chat.format_conversations(turns.unionByName(more))))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return back.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.char_length(loss).cast("bigint").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), F.char_length("formatted").cast("bigint").alias("formatted_chars"),
    )


OP2_SQL = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{CONTROL}' UNION ALL SELECT -1, 1, 'assistant', '{CONTROL}'),
sized AS (
  SELECT *, length(role) + length(text) + 24
    + (length(role || text) - length(replace(role || text, chr(92), '')))
    + (length(role || text) - length(replace(role || text, '<', ''))) AS size FROM turns)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(size) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 3-word shingle sets have a similarity of 0.9 or more."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return jaccard_join.components(docs, n=3, num=90, den=100).select("doc_id", "n_shingles", "component_id")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole text, and the text decoded from them, as digests."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.encode(docs, tokenizer_path("word_bpe_49k.json"), ids=False, decoded=False)
    return coded.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op5_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log10 probability of every whole text under interpolated n-grams; fold 2 of 7 is held out, fold 3 sets the weights."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    part = fold("doc_id", 7)
    scored = lm_scores.score(docs, train=part != 2, tune=part == 3)
    return scored.select("doc_id", (part == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op6_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text stored as an MPEG stream, and what reading the stream back gives."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    back = mpeg_audio.digests(mpeg_audio.store(docs))
    return back.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "seconds_num", "seconds_den", "frame_offsets")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that overlap with benchmark items: one row per document and item."""
    return decontaminate.overlaps(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document from co-trained views; learnt from labelled rows outside the held-out fold."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    model = quality.fit(docs, read(spark, sf_dir, "labels").where(fold("doc_id", 5) != 0))
    scored = quality.score(docs, model)
    return scored.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "text_score", "meta_score", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every whole text: the rules' spans, and all spans."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.find(docs, pii.fit(spark))
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [(F.size("base") - F.size(F.array_remove(kinds, k))).cast("bigint").alias(f"n_{k}") for k in pii.RULES]
    return found.select("doc_id", *counts, F.sha2(pii.joined(F.col("base")), 256).alias("base_sha256"), pii.joined(F.col("spans")).alias("spans"), F.size("spans").cast("bigint").alias("n_spans"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every whole text."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.count_tokens(docs, tokenizer_path("word_bpe_49k.json")).select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's weight and score towards the benchmark's texts, and its rank if it is drawn."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    drawn = importance.resample(docs, read(spark, sf_dir, "benchmark"), share=(5, 100), least_words=20, seed=42)
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


OP11_SQL = r"""
WITH RECURSIVE docs AS (
  SELECT row_number() OVER () AS r, 0 AS side, doc_id, coalesce(text, '') AS text FROM documents
  UNION ALL SELECT row_number() OVER () + 1000000000000, 1, NULL, coalesce(text, '') FROM benchmark),
worded AS (
  SELECT r, side, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM docs),
placed AS (SELECT r, side, generate_subscripts(w, 1) AS i, unnest(w) AS w FROM worded),
runs AS (
  SELECT r, side, w AS f, lead(w) OVER o AS b, lead(w, 2) OVER o AS c FROM placed WINDOW o AS (PARTITION BY r ORDER BY i)),
features AS (
  SELECT r, side, f FROM runs UNION ALL SELECT r, side, f || ' ' || b FROM runs WHERE b IS NOT NULL
  UNION ALL SELECT r, side, f || ' ' || b || ' ' || c FROM runs WHERE c IS NOT NULL),
counted AS (SELECT r, side, f, count(*) AS n FROM features GROUP BY ALL),
bits AS (SELECT i, CAST(i AS UBIGINT) AS v, 0 AS k FROM range(256) t(i) UNION ALL SELECT i, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END, k + 1 FROM bits WHERE k < 8),
crc AS (SELECT list(v ORDER BY i) AS t FROM bits WHERE k = 8),
kinds AS (SELECT DISTINCT f, hex(encode(f)) AS h FROM counted),
hashed AS (
  SELECT f, xor(list_reduce(list_transform(range(length(h) // 2), lambda i: CAST(('0x' || substr(h, CAST(2 * i + 1 AS BIGINT), 2)) AS UBIGINT)),
    lambda s, b: xor(s // 256, t[CAST(xor(s, b) % 256 AS BIGINT) + 1]), CAST(4294967295 AS UBIGINT)), CAST(4294967295 AS UBIGINT)) % 10000 AS bucket FROM kinds, crc),
known AS (SELECT r, side, bucket, n FROM counted JOIN hashed USING (f)),
tally AS (SELECT side, bucket, sum(n) AS n FROM known GROUP BY ALL),
totals AS (SELECT coalesce(sum(n) FILTER (side = 0), 0) AS s, coalesce(sum(n) FILTER (side = 1), 0) AS t FROM tally),
gains AS (
  SELECT bucket, CAST(floor(1000 * ln((CAST(coalesce(b.n, 0) AS DOUBLE) + 1) * (CAST(s AS DOUBLE) + 10000) / ((CAST(a.n AS DOUBLE) + 1) * (CAST(t AS DOUBLE) + 10000)))) AS BIGINT) AS gain
  FROM (SELECT * FROM tally WHERE side = 0) a LEFT JOIN (SELECT * FROM tally WHERE side = 1) b USING (bucket), totals),
weighed AS (SELECT r, sum(n) AS n_features, sum(n * gain) AS weight FROM known JOIN gains USING (bucket) WHERE side = 0 GROUP BY r),
scored AS (
  SELECT doc_id, len(w) AS n_words, CAST(coalesce(n_features, 0) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
    CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST(CAST('0x' || substr(sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS UBIGINT) AS DOUBLE) + 0.5) / 4294967296))) AS BIGINT) AS score
  FROM worded LEFT JOIN weighed USING (r) WHERE side = 0),
able AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id NULLS LAST, n_features, weight) AS place, count(*) FILTER (n_words >= 20) OVER () * 5 // 100 AS k FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND place <= k THEN place END AS rank FROM able
"""


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding on the first 16 components, with variance one."""
    vectors = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    white, model = whitening.whiten(vectors, "embedding", scale=64, offset=1_000_000, components=16)
    n, explained, error = (model.n, model.explained.tolist(), model.identity_error) if model else (0, [], 0.0)
    out = white.select("vec_id", F.expr("try_cast(deviation AS bigint)").alias("deviation"), F.posexplode("whitened").alias("at", "whitened"))
    share = F.element_at(F.array(*map(F.lit, explained)).cast("array<double>"), F.col("at") + 1)
    return out.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(n).cast("bigint").alias("n"), "deviation", "whitened", share.alias("explained"), F.lit(error).alias("identity_error"))


def op13_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 highest inner products of every 50th embedding with all others."""
    return topk.search(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, scale=256, k=5)


OP13_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda c: floor(256 * CAST(c AS DOUBLE))) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
scored AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.x, c.x) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score FROM scored
WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 5
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_toxicity": op1_toxicity, "op2_chat_format": op2_chat_format, "op3_jaccard_join": op3_jaccard_join, "op4_bpe": op4_bpe, "op5_lm_scores": op5_lm_scores, "op6_mpeg_audio": op6_mpeg_audio, "op7_decontamination": op7_decontamination, "op8_quality": op8_quality, "op9_pii": op9_pii, "op10_token_counts": op10_token_counts, "op11_importance": op11_importance, "op12_whitening": op12_whitening, "op13_topk": op13_topk}


def oracle_sql() -> dict[str, str]:
    return {"op2_chat_format": OP2_SQL, "op11_importance": OP11_SQL, "op13_topk": OP13_SQL}
