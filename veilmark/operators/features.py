"""Behavioural features of groups of generations, and vectors of entities.

A missing trace gives a missing feature (null), never zero.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilmark.functions import text as T
from veilmark.functions.metrics import confidence_gap, residual_entropy
from veilmark.operators.durable import spread

# The features, and those of the primary set (all but latency).
FEATURES = ("refusal_rate", "hedge_density", "length_mean", "length_cv", "token_entropy", "mean_neg_logprob", "semantic_diversity", "toolcall_count", "toolcall_abstain_rate", "toolcall_entropy", "latency_ms_mean", "confidence_gap")
PRIMARY = tuple(f for f in FEATURES if f != "latency_ms_mean")
#: Samples of a group, and bytes of their texts, up to which they meet in one row.
TOGETHER, TOGETHER_BYTES = 32, 1 << 20


def length_stats(df: DataFrame, keys: list[str], length: str) -> DataFrame:
    cv = F.when((F.avg(length) > 0) & (F.count(length) > 1), F.stddev_pop(length) / F.avg(length)).otherwise(0.0)
    return df.groupBy(*keys).agg(F.avg(length).alias("length_mean"), cv.alias("length_cv"), F.count(length).alias("n"))


def semantic_diversity(df: DataFrame, key: str, index: str, text: str) -> DataFrame:
    """Mean over a group's sample pairs of half of (1 - Jaccard of words) + (1 - cosine of character trigrams); 0 for fewer than two samples.

    Where all groups are small (counted first), a group's texts are one row, and its pairs are compared there. Else words and trigrams
    meet by their hashes, so only pairs that share one are formed; all other pairs are of distance 1 in that part, or 0 if both samples
    have none, and are counted, not formed.
    """
    texts = df.select(F.col(key).alias("__key"), F.col(index).alias("i"), F.col(text).alias("t"))
    sizes = texts.groupBy("__key").agg(F.count("*").alias("n"), F.sum(F.octet_length("t")).alias("b")).agg(F.max("n").alias("n"), F.max("b").alias("b")).first()
    found = _together(texts) if (sizes["n"] or 0) <= TOGETHER and (sizes["b"] or 0) <= TOGETHER_BYTES else _meeting(texts)
    pairs = F.col("k") * (F.col("k") - 1) / 2
    return found.select(F.col("__key").alias(key), F.when(F.col("k") > 1, 1 - F.col("alike") / (2 * pairs)).otherwise(0.0).alias("semantic_diversity"), F.col("k").cast("int").alias("n_samples"))


def _hashed(text: Column) -> tuple[Column, Column]:
    """Hashes of a text's distinct words and trigrams."""
    return F.array_distinct(F.transform(T.words(text), lambda w: F.xxhash64(w))).alias("w"), T.trigram_hashes(text).alias("g")


def _together(texts: DataFrame) -> DataFrame:
    """(__key, k, alike: the sum of both likenesses over pairs), with a group's samples in one row."""
    held = spread(texts, "__key").groupBy("__key").agg(F.array_sort(F.collect_list(F.struct("i", "t"))).alias("s"))

    def alike(x: Column, y: Column) -> Column:
        size = lambda c: F.array_size(c).cast("double")
        both = lambda c: size(F.array_intersect(x[c], y[c]))
        part = lambda c, share: F.when((size(x[c]) == 0) & (size(y[c]) == 0), 1.0).otherwise(F.coalesce(share, F.lit(0.0)))
        one = part("w", F.transform(F.array(both("w")), lambda n: n / F.nullif(size(x["w"]) + size(y["w"]) - n, F.lit(0.0)))[0])
        return F.when(x["i"] < y["i"], one + part("g", both("g") / F.nullif(F.sqrt(size(x["g"]) * size(y["g"])), F.lit(0.0)))).otherwise(0.0)

    total = lambda c, f: F.aggregate(c, F.lit(0.0), lambda a, x: a + f(x))
    rest = lambda s, j: F.slice(s, j + 2, F.size(s))
    # Lambdas' arguments are computed once: the hashes of a group's samples.
    hashes = F.transform("s", lambda x: F.struct(x["i"].alias("i"), *_hashed(x["t"])))
    sums = F.transform(F.array(hashes), lambda s: total(F.sequence(F.lit(0), F.size(s) - 1), lambda j: total(rest(s, j), lambda y: alike(F.get(s, j), y))))
    return held.select("__key", F.size("s").alias("k"), sums[0].alias("alike"))


def _meeting(texts: DataFrame) -> DataFrame:
    """The same by what samples share."""
    each = texts.select("__key", "i", *_hashed(F.col("t")))
    part = lambda c, kind: each.select("__key", "i", F.lit(kind).alias("kind"), F.size(c).alias("n"), F.explode(c).alias("h"))
    tokens = part("w", 0).unionByName(part("g", 1))
    sized = each.groupBy("__key").agg(F.count("*").alias("k"), F.count_if(F.size("w") == 0).alias("ew"), F.count_if(F.size("g") == 0).alias("eg"))
    a, b = (tokens.select("__key", "kind", "h", F.col("i").alias(f"i{s}"), F.col("n").alias(f"n{s}")) for s in "ab")
    shared = a.join(b, ["__key", "kind", "h"]).where("ia < ib").groupBy("__key", "kind", "ia", "ib", "na", "nb").agg(F.count("*").alias("both"))
    alike = F.when(F.col("kind") == 0, F.col("both") / (F.col("na") + F.col("nb") - F.col("both"))).otherwise(F.col("both") / F.sqrt(F.col("na").cast("double") * F.col("nb")))
    near = shared.groupBy("__key").agg(F.sum(alike).alias("alike"))
    pairs = lambda c: F.col(c) * (F.col(c) - 1) / 2
    return sized.join(near, "__key", "left").select("__key", "k", (F.coalesce("alike", F.lit(0.0)) + pairs("ew") + pairs("eg")).alias("alike"))


def feature_rows(generations: DataFrame, probes: DataFrame) -> DataFrame:
    """One row for each behavioural probe with its twelve features.

    generations: probe_id, sample_index, text, n_tokens, trace, tool_calls, latency_ms, latency_trustworthy.
    probes: probe_id, entity_id, template_id, tools_exposed; a probe without generations has all features missing.
    """
    g = generations.withColumns({
        "__refused": T.is_refusal(F.col("text")).cast("double"), "__hedges": 100.0 * T.hedge_count(F.col("text")) / F.greatest(F.lit(1), F.size(T.words(F.col("text")))),
        "__entropies": F.filter(F.transform(F.coalesce("trace.topm_logprobs", F.array().cast("array<array<double>>")), residual_entropy), lambda x: x.isNotNull()),
        "__chosen": F.coalesce("trace.chosen_logprobs", F.array().cast("array<double>")), "__calls": F.size("tool_calls"),
    })
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    base = g.groupBy("probe_id").agg(
        F.avg("__refused").alias("refusal_rate"), F.avg("__hedges").alias("hedge_density"), F.avg("n_tokens").alias("length_mean"),
        F.when((F.avg("n_tokens") > 0) & (F.count("*") > 1), F.stddev_pop("n_tokens") / F.avg("n_tokens")).otherwise(0.0).alias("length_cv"),
        (F.sum(total("__entropies")) / F.nullif(F.sum(F.size("__entropies")), F.lit(0))).alias("token_entropy"),
        (-F.sum(total("__chosen")) / F.nullif(F.sum(F.size("__chosen")), F.lit(0))).alias("mean_neg_logprob"),
        F.avg("__calls").alias("toolcall_count"), F.avg((F.col("__calls") == 0).cast("double")).alias("__abstain"),
        F.avg(F.when(F.col("latency_trustworthy"), F.col("latency_ms"))).alias("latency_ms_mean"), F.avg(confidence_gap(F.col("__chosen"))).alias("confidence_gap"),
    )
    calls = tool_entropy(generations.select("probe_id", F.explode("tool_calls").alias("name")), "probe_id", "name")
    out = probes.join(base, "probe_id", "left").join(semantic_diversity(generations, "probe_id", "sample_index", "text").drop("n_samples"), "probe_id", "left").join(calls, "probe_id", "left")
    return out.withColumns({
        "toolcall_entropy": F.when(F.col("length_mean").isNotNull(), F.coalesce("toolcall_entropy", F.lit(0.0))),
        "toolcall_abstain_rate": F.when(F.col("length_mean").isNotNull(), F.when(F.size("tools_exposed") > 0, F.col("__abstain")).otherwise(0.0)),
    }).drop("__abstain")


def tool_entropy(calls: DataFrame, key: str, name: str) -> DataFrame:
    """Shannon entropy, in nats, of the names called under each key: counted by name first, so a frequent name is one row."""
    counts = calls.groupBy(key, name).agg(F.count("*").alias("n"))
    return counts.groupBy(key).agg(F.greatest(F.lit(0.0), F.ln(F.sum("n").cast("double")) - F.sum(F.col("n") * F.ln(F.col("n").cast("double"))) / F.sum("n")).alias("toolcall_entropy"))


def primary_vectors(rows: DataFrame, entity: list[str], features: tuple[str, ...] = PRIMARY) -> DataFrame:
    """Mean of each feature over an entity's templates, missing ones left out."""
    return rows.groupBy(*entity).agg(*(F.avg(f).alias(f) for f in features))


def secondary_vectors(rows: DataFrame, entity: list[str], template: str, templates: list[str], features: tuple[str, ...] = PRIMARY) -> DataFrame:
    """Mean, population deviation (0 for one template) and maximum of each feature, and its value under each template, in one aggregate."""
    spread = [x for f in features for x in (F.avg(f).alias(f"{f}__mean"), F.stddev_pop(f).alias(f"{f}__std"), F.max(f).alias(f"{f}__max"))]
    single = [F.max(F.when(F.col(template) == t, F.col(f))).alias(f"{f}__t_{t}") for f in features for t in templates]
    return rows.groupBy(*entity).agg(*spread, *single)
