"""Identity, planning, splits, context, matching, defences, detectors, sources and reports against plain Python."""

import hashlib
import json
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from veilmark import config
from veilmark.errors import BudgetExceeded, ConfigError, DeferredError, FetchError, MatchingError, SplitError, VeilmarkError
from veilmark.functions import identity
from veilmark.functions import text as T
from veilmark.operators import boosting, containment, context, corpus, detector, features, leaks, planning, report, splits, stats
from veilmark.operators.backend import stand_in
from veilmark.sources import fetch


def value(spark, column):
    return spark.range(1).select(column).first()[0]


# ---- configuration


def test_config_defaults_overrides_and_hash(tmp_path):
    path = tmp_path / "c.yaml"
    path.write_text("corpus:\n  synthetic: true\nmethods: [none, system_prompt]\n")
    a = config.load(path, {"sampling.k": "4", "stats.leak_curve_k": "[1, 2]", "cache_layers": "x, y", "profile": "none"})
    assert a["sampling.k"] == 4 and a["stats.leak_curve_k"] == (1, 2) and a["cache_layers"] == ("x", "y") and a["profile"] is None and a["split.dev_fraction"] == 0.5
    assert config.load(path, {"cache_layers": "z", "methods": "system_prompt,none"}).hash() == config.load(path).hash() != a.hash()
    for bad in ({"sampling.k": 0}, {"sampling.temperature": 5}, {"nothing": 1}, {"corpus.nothing": 1}, {"split.dev_fraction": 1}, {"methods": ","}, {"tier": "huge"}, {"corpus.synthetic": False}, {"stats": 3}):
        with pytest.raises(ConfigError):
            config.load(path, bad)
    for text in ("- 1", "a: [", "x: 1"):
        path.write_text(text)
        with pytest.raises(ConfigError):
            config.load(path)
    with pytest.raises(ConfigError):
        config.load(tmp_path / "none.yaml")


def test_canonical_form():
    assert config.canonical({"b": {3, 1}, "a": (1.0, None, True), "c": b"x"}) == config.canonical({"c": b"x", "a": [1.0, None, True], "b": {1, 3}})
    assert config.digest({"a": 1.0}) != config.digest({"a": 1}) and config.canonical({"a": 0.1}) == '{"a":"0.1"}'
    with pytest.raises(TypeError):
        config.canonical(object())
    assert all(issubclass(e, VeilmarkError) for e in (BudgetExceeded, ConfigError, DeferredError, FetchError, MatchingError, SplitError))


# ---- requests


def prompt(prompt, system="", docs=(), tools=()):
    parts = [f"[system]\n{system}"] * bool(system) + ["[context]\n" + "\n---\n".join(docs)] * bool(docs) + ["[tools available] " + ", ".join(sorted(tools))] * bool(tools)
    return "\n\n".join([*parts, f"[user]\n{prompt}"])


@pytest.mark.parametrize(("system", "docs", "tools"), [("", [], []), ("s", [], ["b", "a"]), (None, ["x", "y"], None), ("s", ["x"], ["a"])])
def test_full_prompt(spark, system, docs, tools):
    row = spark.createDataFrame([("q", system, docs, tools)], "p string, s string, d array<string>, t array<string>")
    assert row.select(identity.full_prompt(*(F.col(c) for c in "psdt"))).first()[0] == prompt("q", system or "", docs or (), tools or ())


def test_cache_key_follows_all_that_matters(spark):
    def key(shown="q", tools="", temperature=0.7, sample=0, seed=1, backend="b", containment="c"):
        return value(spark, identity.cache_key(backend, containment, F.lit(shown), F.lit(tools), {"temperature": temperature, "k": sample + 3, "base_seed": 9}, F.lit(sample), F.lit(seed)))

    base = key()
    assert base == key() and len({base, key("r"), key(tools="t"), key(temperature=0.8), key(sample=1), key(seed=2), key(backend="x"), key(containment="x")}) == 8


def test_units_and_batches(spark):
    probes = spark.createDataFrame([(f"p{i}", f"e{i % 3}", "direct") for i in range(9)], "probe_id string, entity_id string, family string")
    plan = planning.plan_units(probes, 4, "c", "n", "b").collect()
    assert [(r.entity_id, r.probe_id) for r in plan] == sorted((r.entity_id, r.probe_id) for r in plan) and len({r.unit_id for r in plan}) == 9 and all(len(r.unit_id) == 20 for r in plan)
    assert plan[0].unit_id == hashlib.sha256(f"{plan[0].probe_id}|{plan[0].entity_id}|4|c|n|b".encode()).hexdigest()[:20]
    assert "about 2.0 h on tiny" in planning.estimate_text(8640, 0, "tiny") and "0 of 5" in planning.estimate_text(5, 9)


def test_execution_reads_caches_defers_and_applies_the_hook_to_all(spark):
    requests = spark.createDataFrame([(f"k{i}", f"u{i // 2}", "x" * (i + 1)) for i in range(10)], "cache_key string, unit_id string, shown string")
    layer = spark.createDataFrame([("k0", "cached", True), ("k9", "cached", True)], "cache_key string, text string, latency_trustworthy boolean")

    def generate(frame):
        if (frame["shown"].str.len() > 6).any():
            raise DeferredError("no memory")
        return frame.assign(text="made " + frame["shown"], latency_trustworthy=True)

    written = []
    got, off = planning.execute(requests, [layer], generate, "cache_key string, text string, latency_trustworthy boolean", 3, lambda df: written.append(df.count()), lambda df: df.withColumn("text", F.upper("text")))
    rows = {r.cache_key: (r.text, r.latency_trustworthy) for r in got.collect()}
    # Batches by length: k1 k2 k3 | k4 k5 k6 (too long) | k7 k8 (too long).
    assert rows == {"k0": ("CACHED", False), "k9": ("CACHED", False), **{f"k{i}": ("MADE " + "X" * (i + 1), True) for i in (1, 2, 3)}}
    assert {r.unit_id for r in off.collect()} == {"u2", "u3", "u4"} and written == [3]


# ---- splits


def test_split_guards(spark):
    entities = spark.createDataFrame([(i, i // 2, "restricted" if i % 2 else "control", i if i % 2 else None) for i in range(8)], "entity_id int, pair_id int, entity_class string, deal_id int")
    pairs = spark.createDataFrame([(0, "dev"), (1, "dev"), (2, "eval"), (3, "eval")], "pair_id int, split string")
    splits.check(pairs, entities)
    assert {r.entity_id for r in splits.require(splits.entities_of(entities, pairs, "dev"), entities, pairs).collect()} == {0, 1, 2, 3}
    with pytest.raises(SplitError, match="not in the dev split"):
        splits.require(entities, entities, pairs)
    with pytest.raises(SplitError, match="both"):
        splits.check(pairs.union(spark.createDataFrame([(0, "eval")], "pair_id int, split string")), entities)
    one = splits.audit(pairs, entities).first()
    assert one.splits_disjoint and one.n_dev_pairs == 2 and one.dev_ids_hash != one.eval_ids_hash == splits.audit(pairs, entities.orderBy(F.desc("entity_id"))).first().eval_ids_hash
    art = spark.createDataFrame([(1, "a"), (5, "b")], "deal_id int, text string")
    assert [r.text for r in splits.dev_artifacts(art, entities, pairs).collect()] == ["a"]


# ---- context and tools


def test_gather_order_and_protected(spark):
    probes = spark.createDataFrame([("p", "e", "Acme", "price of tea", True), ("q", "f", "Zed", "nothing here", False)], "probe_id string, entity_id string, display_name string, prompt string, memory_primed boolean")
    docs = spark.createDataFrame([("d1", "acme tea price", "e", True), ("d2", "tea", "f", False), ("d3", "unrelated words", None, False), ("d4", "price", None, False), ("d5", "tea price", None, False)], "doc_id string, text string, entity_id string, is_private boolean")
    memory = spark.createDataFrame([("2", "e", "note two", True), ("1", "e", "note one", True), ("3", "f", "other", True)], "entry_id string, entity_id string, text string, is_private boolean")
    public = spark.createDataFrame([("e", "public"), ("f", "")], "entity_id string, text string")
    got = {r.probe_id: r.context_docs for r in context.context_docs(context.gather(probes, docs, memory, public)).collect()}
    assert got == {"p": ["acme tea price", "tea price", "price", "note one", "note two", "public"]} or got["p"][0] == "acme tea price" and got["p"][3:] == ["note one", "note two", "public"]
    fields = spark.createDataFrame([(1, "b", "$2", "2"), (1, "a", "$1", "1")], "deal_id int, field_id string, value_raw string, value_normalized string")
    seen = {r.entity_id: r.protected for r in context.protected(spark.createDataFrame([("x", 1), ("y", None)], "entity_id string, deal_id int"), fields).collect()}
    assert seen == {"x": ["$1", "$2", "1", "2"], "y": []}


@pytest.mark.parametrize(("said", "want"), [("1 + 2 * 3", 7), ("-(2 ** 8) / 4", -64), ("7 // 2 % 2", 1), ("+1.5", 1.5)])
def test_safe_calc(said, want):
    assert context.safe_calc(said) == want


@pytest.mark.parametrize("said", ["2 ** 9", "1e7 ** 2", "True", "'a'", "f(1)", "x", "1 if 1 else 2", "(", "1" * 201, "[1]"])
def test_safe_calc_refuses(said):
    with pytest.raises(ValueError, match="."):
        context.safe_calc(said)


def test_tools(spark):
    docs = spark.createDataFrame([("d1", "tea " * 300), ("d2", "tea price")], "doc_id string, text string")
    calls = spark.createDataFrame([(1, "calc", "2/3"), (2, "calc", "1/0"), (3, "search_docs", "price"), (4, "search_docs", "zzz"), (5, "run", "x"), (6, "search_docs", "tea")], "call_id int, name string, arg string")
    got = {r.call_id: (r.answer, r.logged) for r in context.dispatch(calls, docs).collect()}
    assert got[1] == ("0.666667", "calc") and got[2][0].startswith("error") and got[3][0] == "[d2] tea price" and got[4][0] == "no documents found" and got[5] == ("error: no tool named run", "unknown:run")
    assert max(len(line) for line in got[6][0].split("\n")) <= 400 + 5
    assert value(spark, context.tool_calls(F.lit("Calc(1) then search_docs(x) calc(2) recalc (3)"))) == ["calc", "calc", "search_docs"]


# ---- text


@pytest.mark.parametrize("x", [34.5, 1200.0, 0.1, 123456789012.0, -7.25, 3.14159265358979, 100.0, 1e-3])
def test_ten_digits(spark, x):
    assert float(value(spark, T.ten_digits(F.lit(x)))) == float(f"{x:.10g}")
    if 1e-3 < abs(x) < 1e9:
        assert value(spark, T.ten_digits(F.lit(x))) == f"{x:.10g}"


def test_values_are_compared_by_what_they_show(spark):
    reveals = lambda t, v: value(spark, T.reveals(F.lit(t), F.lit(v)))
    assert reveals("closing in 2020", "the second quarter of 2020") and not reveals("the second quarter of 2021", "the second quarter of 2020")
    assert reveals("An ALL-cash deal", "all cash") and not reveals("", "x") and not reveals("x", "")
    span = value(spark, T.first_span(F.lit("a premium of 12.5 % to it"), (r"nothing ([0-9]+)", r"premium of ([0-9.]+) *%")))
    assert (span.value, span.start, span.end) == ("12.5", 13, 17) and value(spark, T.first_span(F.lit("none"), (r"x([0-9])",))) is None


def test_diversity_against_sets(spark):
    texts = ["a b c", "a b c", "", "  ", "x y", "tea tea 😀 é", "abc", "b"]
    groups = {0: texts, 1: ["same words"] * 4, 2: ["one"], 3: ["ab", "cd"]}

    def sets(t):
        import re

        s = re.sub(r"\s+", " ", t).strip()
        return set(re.findall(r"[a-z0-9']+", t.lower())), {s[i : i + 3] for i in range(len(s) - 2)}

    def distance(a, b):
        (w, g), (v, h) = sets(a), sets(b)
        jac = len(w & v) / len(w | v) if w | v else 1.0
        cos = len(g & h) / math.sqrt(len(g) * len(h)) if g and h else float(not g and not h)
        return ((1 - jac) + (1 - cos)) / 2

    rows = [(k, i, t) for k, ts in groups.items() for i, t in enumerate(ts)]
    got = {r.k: r.semantic_diversity for r in features.semantic_diversity(spark.createDataFrame(rows, "k int, i int, t string"), "k", "i", "t").collect()}
    for k, ts in groups.items():
        d = [distance(a, b) for i, a in enumerate(ts) for b in ts[i + 1 :]]
        assert got[k] == pytest.approx(sum(d) / len(d) if d else 0.0)


# ---- statistics


def test_bootstraps(spark):
    rows = [(i % 20, float(i % 7), float(i % 5)) for i in range(200)]
    df = spark.createDataFrame(rows, "c int, a double, b double")
    ci = stats.paired_bootstrap(df, "c", "a", "b", 200).first()
    assert ci.lo <= ci.point <= ci.hi and ci.point == pytest.approx(sum(a - b for _, a, b in rows) / 200)
    top = stats.cluster_bootstrap(df, "c", lambda total: total(F.col("a") * F.col("a")) / total(F.lit(1.0)), 50).first()
    assert top.lo <= top.point <= top.hi
    none = stats.bootstrap_mean(df.limit(0), "c", "a", 10).first()
    assert (none.point, none.lo, none.hi, none.n_clusters) == (0, 0, 0, 0)
    weights = spark.range(20_000).select(stats.poisson_weight("s", F.lit(3), F.col("id")).alias("w")).agg(F.avg("w"), F.var_pop("w")).first()
    assert abs(weights[0] - 1) < 0.03 and abs(weights[1] - 1) < 0.06


def test_permutation_and_auc_interval(spark):
    r = random.Random(3)
    rows = [(p, y, y + r.gauss(0, 0.3)) for p in range(30) for y in (0, 1)]
    df = spark.createDataFrame(rows, "pair_id int, label int, score double")
    p, null = stats.permutation_p(df, draws=60).first(), stats.permutation_p(df.withColumn("score", F.lit(1.0)), draws=60).first()
    assert p.p == pytest.approx(1 / 61) and null.p == 1.0 and stats.permutation_p(df.limit(2), draws=5).first().p is None
    ci = stats.auc_bootstrap(df, draws=60).first()
    assert 0.9 < ci.lo <= ci.auc <= ci.hi <= 1.0 and ci.n_draws == 60


def test_leak_intervals_and_utility(spark):
    rows = [("direct", e, 4, c) for e in range(10) for c in (0, e % 5)] + [("tool", 0, 2, 1)]
    df = spark.createDataFrame(rows, "family string, entity int, n int, c int")
    got = {r.family: r for r in leaks.leak_intervals(df, "family", "entity", 4, draws=100).collect()}
    assert got["direct"].leak_at_1_lo <= got["direct"].leak_at_1 <= got["direct"].leak_at_1_hi and got["direct"].n_entities == 10 and got["direct"].n_probes == 20
    assert got["tool"].k == 2 and got["tool"].leak_at_k == got["tool"].leak_at_k_lo == got["tool"].leak_at_k_hi == 1.0
    assert leaks.utility(df, "entity", 4).first().point == pytest.approx(got["direct"].leak_at_k)


# ---- matching and corpus


def brute_candidates(deals, pool, per):
    log = lambda v: math.log1p(max(0.0, v))
    out = set()
    for d in deals:
        for tier in (0, 1, 2):
            mine = [c for c in pool if (0 if c.sector == d.sector and c.band == d.band else 1 if c.sector == d.sector else 2) == tier]
            out |= {(d.id, c.id, tier, k) for k, c in enumerate(sorted(mine, key=lambda c: (round(abs(log(c.size) - log(d.size)), 9), c.id))[:per], 1)}
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_candidates_of_each_tier(spark, seed):
    r = random.Random(seed)
    make = lambda n, at: spark.createDataFrame([(at + i, r.randrange(4) if at else r.randrange(6), float(r.choice([-5, 0, 0, 7, r.uniform(0, 1e4)]))) for i in range(n)], "id bigint, sector int, size double")
    deals, pool = corpus.banded(make(10, 0), make(60, 100))
    deals, pool = spark.createDataFrame(deals.collect(), deals.schema), spark.createDataFrame(pool.collect(), pool.schema)
    got = {(r.deal, r.cand, r.tier, r["rank"]) for r in corpus.control_candidates(deals, pool, 3).collect()}
    assert got == brute_candidates(deals.collect(), pool.collect(), 3)


def test_matching_fetches_more_when_all_are_taken(spark):
    deals = spark.createDataFrame([(i, 1, 0, 5.0) for i in range(12)], "id bigint, sector int, band int, size double")
    pool = spark.createDataFrame([(100 + i, 1, 0, 5.0 + i) for i in range(14)], "id bigint, sector int, band int, size double")
    assert {r.deal: r.cand for r in corpus.match_controls(deals, pool, at_once=2).collect()} == {i: 100 + i for i in range(12)}


def test_corpus_pieces(spark):
    names = corpus.unique_names(spark.createDataFrame([(1, "A"), (2, "A"), (3, "B")], "i int, n string"), "n", "i").orderBy("i").collect()
    assert [r.n for r in names] == ["A", "A 2", "B"]
    assert "software" in value(spark, corpus.background(F.lit("X"), F.lit("73"))) and value(spark, corpus.company_key(F.lit("00123"))) == "0000000123"
    units = [{"form": "10-K", "end": "2019", "val": 1.0}, {"form": "10-K", "end": "2020", "val": 2.0}, {"form": "8-K", "end": "2021", "val": 3.0}, {"form": "20-F", "end": "2022"}]
    facts = json.dumps({"facts": {"us-gaap": {"Revenues": {"units": {"USD": units}}}}})
    assert value(spark, corpus.latest_fact(F.lit(facts), "Revenues")) == 2.0 and value(spark, corpus.latest_fact(F.lit("{}"), "Revenues")) == 0.0


# ---- methods


def test_numbers_are_suppressed_from_dev_artifacts(spark):
    method = containment.build("lora_ga").fit(spark.createDataFrame([("worth $34.50 or 12",)], "text string"))
    rows = [("p", 0, "it is 34.50 and 99", True, ["$34.50", "99"], 4), ("q", 0, "it is 34.50", False, ["$34.50"], 3)]
    df = spark.createDataFrame(rows, "probe_id string, sample_index int, text string, is_restricted boolean, protected array<string>, n_tokens int")
    got = {r.probe_id: r.text for r in method.post_generate(df, stand_in).collect()}
    assert got == {"p": "it is undisclosed and 99", "q": "it is 34.50"}
    assert method.fingerprint() != containment.build("lora_ga").fingerprint() and containment.build("none").post_generate(df, stand_in) is df


def test_public_answers_are_like_the_controls(spark):
    df = spark.range(600).select(containment.public_answer(F.col("id").cast("string"), F.when(F.col("id") % 2 == 0, F.lit("Acme makes tea. It sells tea.")), 25.0, 4.0, 0.3).alias("text"))
    stats_ = containment.control_stats(df).first()
    assert abs(stats_.mean_words - 25) < 5 and 1 < stats_.sd_words < 9 and 0.2 < stats_.hedge_share < 0.5
    texts = [r.text for r in df.collect()]
    assert len(set(texts)) > 300 and sum("tea" in t for t in texts) > 200 and df.collect()[0].text == texts[0]


def test_calibration_search_picks_by_auc_among_the_tight(spark):
    results = {"a": (0.9, 0.0), "b": (0.45, 0.05), "c": (0.5, 0.5)}
    assert containment.calibration_search([{"n": n} for n in results], lambda c: results[c["n"]], spark) == {"n": "b"}
    assert containment.calibration_search([{"n": "a"}, {"n": "c"}], lambda c: (results[c["n"]][0], 0.5), spark) == {"n": "c"}


# ---- detectors


def vectors(spark, gap, n=24):
    r = random.Random(4)
    rows = [(2 * p + y, p, y, y * gap + r.gauss(0, 0.5), r.gauss(0, 1) if p % 9 else None) for p in range(n) for y in (0, 1)]
    return spark.createDataFrame(rows, "entity_id bigint, pair_id bigint, label int, x double, z double")


def test_both_detectors(spark):
    rows = {r.detector: r for r in detector.detectors(vectors(spark, 2.0), ["x", "z"], ["x", "z"], repeats=2, draws=50, permutations=50).collect()}
    assert rows["logreg_primary"].auc > 0.9 and rows["gbt_secondary"].auc > 0.85 and rows["logreg_primary"].state == "detectable" and not rows["logreg_primary"].undetectable
    assert all(r.p == pytest.approx(1 / 51) for r in rows.values()) and rows["gbt_secondary"].p_adjusted >= rows["gbt_secondary"].p
    flat = detector.detect(vectors(spark, 0.0), ["z"], repeats=1, draws=30, permutations=30).first()
    assert flat.state != "detectable" and flat.p > 0.02
    alone = detector.detect(vectors(spark, 2.0).where("label = 1"), ["x"]).first()
    assert (alone.auc, alone.lo, alone.hi, alone.p, alone.undetectable) == (0.5, 0.5, 0.5, None, False)


def test_folds_are_stratified(spark):
    """Pairs of unlike make-up are spread over the folds."""
    r = random.Random(7)
    rows = [(i, i, int(i < 10), r.random()) for i in range(40)]
    df = spark.createDataFrame(rows, "entity_id bigint, pair_id bigint, label int, x double")
    assert detector.out_of_fold(df, ["x"], repeats=3, folds=5).count() == 120


def test_boosting_learns_what_no_line_can(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(300, 2))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(int)
    df = spark.createDataFrame([(i, float(a), float(b), int(v), [int(i < 200)], [0]) for i, ((a, b), v) in enumerate(zip(x, y, strict=True))], "id int, a double, b double, y int, w array<int>, m array<int>")
    f = np.array([row.scores[0] for row in boosting.decide(df, ["a", "b"], boosting.fit(df, ["a", "b"], "y", "w", trees=60), "m").orderBy("id").collect()])
    assert ((f[200:] > 0) == (y[200:] == 1)).mean() > 0.85
    flat = df.selectExpr("id", "0.0 AS a", "id % 2 AS y", "array(1) AS w", "m")
    assert {row.scores[0] for row in boosting.decide(flat, ["a"], boosting.fit(flat, ["a"], "y", "w", trees=3), "m").collect()} == {0.0}


def test_adversary_and_ranking(spark):
    dev, other = vectors(spark, 2.0), vectors(spark, 2.0, 12)
    adversary = detector.Adversary(dev, ["x", "z"])
    assert adversary.auc(other).first().auc > 0.9 and adversary.auc(other.where("label = 1")).first().auc == 0.5
    with pytest.raises(ValueError, match="both classes"):
        detector.Adversary(dev.where("label = 0"), ["x"])
    c = spark.createDataFrame([("a", 0.1, 0.0, 0.2), ("b", -2.0, -3.0, -1.0), ("c", 0.1, 0.0, 0.2)], "feature string, point double, lo double, hi double")
    assert [r.feature for r in detector.strongest(c, 2).orderBy("place").collect()] == ["b", "a"]


# ---- sources and reports


def test_client_waits_retries_and_caches(tmp_path):
    answers = [(503, {}, b""), (429, {"Retry-After": "2"}, b""), (200, {}, b"body")]
    slept, asked = [], []

    def transport(url):
        asked.append(url)
        return answers[len(asked) - 1]

    client = fetch.Client("me me@example.org", fetch.DiskCache(str(tmp_path)), transport, rate=1000, sleep=slept.append)
    assert client.fetch("u") == client.fetch("u") == b"body" and len(asked) == 3 and slept[1] == 2.0 and 0.5 <= slept[0] <= 1.0
    for transport, why in ((lambda u: (404, {}, b""), "404"), (lambda u: (500, {}, b""), "after 2 tries")):
        with pytest.raises(FetchError, match=why):
            fetch.Client("me", fetch.MemoryCache(), transport, tries=2, sleep=slept.append).fetch("v")
    with pytest.raises(ConfigError):
        fetch.Client(" ", fetch.MemoryCache(), transport)
    assert fetch.Client("me", fetch.MemoryCache(), lambda u: (404, {}, b"")).facts("12", "b") == "{}"
    now = [0.0]
    bucket = fetch.Bucket(2.0, lambda: now[0], lambda s: now.__setitem__(0, now[0] + s))
    for _ in range(6):
        bucket.take()
    assert now[0] == pytest.approx(2.0)


def test_disk_cache_as_a_table(spark, tmp_path):
    cache = fetch.DiskCache(str(tmp_path))
    cache.put("http://a", b"x")
    row = cache.table(spark).first()
    assert row.key == hashlib.sha256(b"http://a").hexdigest() and bytes(row.content) == b"x" and cache.get("http://b") is None


def test_live_corpus_stops_at_its_target(spark):
    deals = corpus.render_filing(corpus.synthetic_deals(spark, 6)).collect()
    texts = {f"b/f{i}": r.text for i, r in enumerate(deals)} | {"b/junk": "nothing", "b/again": deals[0].text}
    names = ["f0", "junk", "gone", "again", "f1", "f2", "f3", "f4", "f5"]
    index = spark.createDataFrame([(f"a{i}", f"2020-01-{i + 1:02d}", n) for i, n in enumerate(names)], "accession string, date_filed string, file_name string")
    client = fetch.Client("me", fetch.MemoryCache(), lambda u: (200, {}, texts[u].encode("latin-1")) if u in texts else (404, {}, b""))
    got, out = fetch.live_corpus(spark, client, index, "b", 3, at_once=4)
    assert [r.accession for r in got.orderBy("place").collect()] == ["a0", "a4", "a5"]
    assert {(r.accession, r.reason) for r in out.collect()} == {("a1", "no_item_101"), ("a2", "fetch_failed"), ("a3", "duplicate_deal")}
    with pytest.raises(MatchingError):
        fetch.live_corpus(spark, client, index, "b", 7)
    bad = fetch.Client("me", fetch.MemoryCache(), lambda u: (404, {}, b""))
    with pytest.raises(FetchError, match="could not be fetched"):
        list(fetch.filings(bad, [{"accession": str(i), "file_name": str(i)} for i in range(40)], "b", 0.25))
    assert fetch.routed(True, lambda: 1, lambda: 2) == 1


def test_reports(spark, tmp_path):
    table = spark.createDataFrame([("none", 0.5, 0.6, 0.5, 0.7, "inconclusive", "leaks", None)], "method string, worst_leak double, auc double, lo double, hi double, state string, verdict string, retries int")
    tests = spark.createDataFrame([("gbt", 0.02), ("logreg_primary", 0.5)], "name string, p double")
    js, md = report.write_comparison(str(tmp_path), table, tests)
    assert json.loads(js.read_text())["secondary_adjusted_p"] == {"gbt": 0.02} and "not resolved" in md.read_text()
    js, md = report.write_curve(str(tmp_path), table)
    assert "| none |  | 0.500 |" in md.read_text()
    leak = spark.createDataFrame([("direct", 4, 0.1, 0.0, 0.2, 0.3, 0.1, 0.4, 9)], "family string, k int, leak_at_1 double, leak_at_1_lo double, leak_at_1_hi double, leak_at_k double, leak_at_k_lo double, leak_at_k_hi double, n_probes int")
    point = spark.createDataFrame([("logreg_primary", 0.6, [0.5, 0.7], 0.4, 0.8, 0.03, "inconclusive")], "detector string, auc double, auc_by_repeat array<double>, lo double, hi double, p double, state string")
    text = report.audit("none", leak, point, 9, utility=spark.createDataFrame([(0.5, 0.4, 0.6)], "point double, lo double, hi double"), run={"id": 1}, limitations=report.limitations("stub", True, 9, "lora_ga", 0.5))
    assert all(x in text for x in ("0.100 [0.000, 0.200]", "p 0.0300", "moves by 0.200", "## Utility", "50% of the generations", "9 pairs resolve"))
    assert report.versions(("pyspark", "no-such-package"))["no-such-package"] == "none"
    one = spark.createDataFrame([("h", True)], "dev_ids_hash string, splits_disjoint boolean")
    assert report.run_record("r", "c", one, 10, 4, 1.26)["elapsed_seconds"] == 1.3
    report.write_workspace(str(tmp_path / "ws"), {"deals": table}, one, one)
    assert spark.read.json(str(tmp_path / "ws/deals")).count() == 1 and json.loads(spark.read.text(str(tmp_path / "ws/manifest")).first()[0])["dev_ids_hash"] == "h"
    report.write_quarantine(spark.createDataFrame([("x" * 5000,)], "payload string"), str(tmp_path / "q"))
    assert len(spark.read.json(str(tmp_path / "q")).first().payload) == 4000


def test_deferred_frames_have_the_schema(spark):
    requests = spark.createDataFrame([("a", 0, "u")], "cache_key string, batch bigint, unit_id string")

    def fail(frame: pd.DataFrame) -> pd.DataFrame:
        raise DeferredError("no memory")

    made, off = planning.run_batches(requests, fail, "cache_key string, text string, n int")
    assert made.count() == 0 and off.first().unit_id == "u"


@pytest.mark.parametrize("k", [1, 3])
def test_stored_index_gives_the_best_of_all(spark, monkeypatch, tmp_path, k):
    """Skewed terms, ties, equal texts, empty and null ones; blocks are skipped, answers are not."""
    from veilmark.operators import blockmax, retrieval

    monkeypatch.setattr(blockmax, "BLOCK", 2)
    monkeypatch.setattr(blockmax, "FIRST", 1)
    r = random.Random(k)
    word = lambda: f"w{min(int(r.expovariate(0.15)), 40)}"
    texts = [(i, " ".join(word() for _ in range(r.randrange(12)))) for i in range(80)] + [(100, None), (101, ""), (102, "w1 w2 w3"), (103, "w1 w2 w3")]
    queries = spark.createDataFrame([(i, " ".join(word() for _ in range(4))) for i in range(12)] + [(50, None), (51, "none of these"), (52, "w1 w1 w2")], "q int, s string")
    docs = spark.createDataFrame(texts, "d int, t string").repartition(3)
    index = blockmax.Index.build(docs, "d", "t", str(tmp_path / "index"))
    found, work = blockmax.Index.open(spark, str(tmp_path / "index")).top(queries, "q", "s", k)
    want = retrieval.bm25_top(docs.fillna("", "t"), "d", "t", queries, "q", "s", k)
    assert sorted(tuple(x) for x in found.select("query", "doc", "score", "rank").collect()) == sorted(tuple(x) for x in want.select("query", "doc", "score", "rank").collect())
    rows = work.collect()
    assert all(0 < x.scored <= x.blocks for x in rows) and sum(x.scored for x in rows) < 0.9 * sum(x.blocks for x in rows) and not {50, 51} & {x["query"] for x in rows}
    assert {x.term for x in index.postings.select("term").distinct().collect()} == {x.term for x in index.tops.select("term").distinct().collect()}
