"""Columns and operators against plain Python, known answers and algebraic properties; queries against SQL."""

import math
import os
import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from veilmark.functions import metrics
from veilmark.functions import text as T
from veilmark.operators import cache, containment, corpus, detector, leaks, ordering, stats
from veilmark.plans import catalogue

SF = "/root/testdata/sf0.001"


def one(spark, column, **values):
    return spark.range(1).select(column(*(F.lit(v) for v in values.values()))).first()[0]


@pytest.mark.parametrize(("n", "c", "k"), [(n, c, k) for n in (1, 4, 8) for c in range(n + 1) for k in range(1, n + 1)])
def test_leak_at_k_is_enumeration(spark, n, c, k):
    draws = list(combinations(range(n), k))
    want = sum(any(i < c for i in d) for d in draws) / len(draws)
    assert one(spark, metrics.leak_at_k, n=n, c=c, k=k) == pytest.approx(want)


@pytest.mark.parametrize(("text", "hit"), [("$1,200", True), ("$1200.00", True), ("1200", True), ("1201", False), ("", False), ("twelve hundred", False), ("a price of 1,200.0009", True)])
def test_formatting_cannot_hide_a_number(spark, text, hit):
    assert spark.range(1).select(T.reveals(F.lit(text), F.lit("1200.00"))).first()[0] == hit


def test_text_columns(spark):
    rows = [("I cannot provide that, perhaps.",), ("",), ("  It seems fine; as far as I know may be. ",), (" ".join(["x"] * 41) + " i cannot",)]
    got = spark.createDataFrame(rows, "t string").select(T.is_refusal(F.col("t")), T.hedge_count(F.col("t")), T.word_count(F.col("t")), F.size(T.char_trigrams(F.col("t")))).collect()
    assert [r[0] for r in got] == [True, False, False, False] and [r[1] for r in got] == [1, 0, 3, 0] and got[1][2] == 1 and got[1][3] == 0
    assert one(spark, T.clean_name, n="  Acme,  Holdings Inc. ") == "Acme, Holdings"
    assert spark.range(1).select(T.redact(F.lit("ab abc"), F.array(F.lit("ab"), F.lit("abc"), F.lit("")))).first()[0] == "[redacted] [redacted]"


def brute_auc(rows):
    pos, neg = [s for s, y in rows if y == 1], [s for s, y in rows if y == 0]
    return sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / (len(pos) * len(neg))


def test_auc(spark):
    r = random.Random(1)
    rows = [(round(r.uniform(-3, 3), 1), r.randrange(2)) for _ in range(80)]
    auc = lambda rs: stats.auc(spark.createDataFrame(rs, "score double, label int")).first()["auc"]
    assert auc(rows) == pytest.approx(brute_auc(rows))
    assert auc([(-s, y) for s, y in rows]) == pytest.approx(1 - brute_auc(rows))
    assert auc([(1.0, 0), (1.0, 1)]) == 0.5 and auc([(0.0, 0), (1.0, 1)]) == 1.0 and auc([(1.0, 1)]) is None


def test_benjamini_hochberg(spark):
    df = spark.createDataFrame([(n, p) for n, p in zip("abcde", (0.01, 0.02, 0.03, 0.04, 0.05), strict=True)], "name string, p double")
    assert all(r.p_adjusted == pytest.approx(0.05) and r.rejected for r in stats.benjamini_hochberg(df).collect())


def test_running_order_over_ranges(spark):
    r = random.Random(2)
    rows = [(i, float(r.randrange(9))) for i in range(300)]
    got = ordering.row_number(spark.createDataFrame(rows, "id int, v double"), "v", "id").orderBy("rank").collect()
    assert [g.id for g in got] == [i for i, _ in sorted(rows, key=lambda x: (x[1], x[0]))] and [g.rank for g in got] == list(range(1, 301))
    assert ordering.row_number(spark.createDataFrame([], "id int, v double"), "v", "id").count() == 0


def test_bands_split_and_bootstrap(spark):
    values = [0.0, 5.0, 5.0, 100.0, 1e9, -3.0, 7.0]
    got = stats.size_bands(spark.createDataFrame(list(enumerate(values)), "id int, size double"), "size", "id", 5)
    order = sorted(range(7), key=lambda i: (math.log1p(max(0.0, values[i])), i))
    assert {r.id: r.band for r in got.collect()} == {i: min(4, k * 5 // 7) for k, i in enumerate(order)}
    pairs = spark.range(10).withColumnRenamed("id", "p")
    assert stats.pair_split(pairs, "p", 0.25, "s").where("split = 'dev'").count() == 2
    df = spark.createDataFrame([(i % 6, float(i % 4)) for i in range(40)], "c int, v double")
    ci = stats.bootstrap_mean(df, "c", "v", 50).first()
    assert ci.lo <= ci.point <= ci.hi and ci.point == pytest.approx(1.5)
    alone = stats.bootstrap_mean(df.where("c = 0"), "c", "v", 50).first()
    assert alone.lo == alone.hi == alone.point


def test_filings_round_trip_and_exclusions(spark):
    deals = corpus.synthetic_deals(spark, 8)
    got = corpus.parse_filings(corpus.render_filing(deals.withColumn("accession", F.col("deal_id"))).select("accession", "text", F.col("price").alias("p"), F.col("premium").alias("q"), "target_name")).collect()
    assert all(r.reason is None and r.deal_id and r.price == float(r.p) and r.premium == float(r.q) and r.target == r.target_name for r in got)
    junk = spark.createDataFrame([("a", "x"), ("b", "Item 1.01"), ("c", "")], "accession string, text string")
    assert [(r.reason, r.deal_id) for r in corpus.parse_filings(junk).orderBy("accession").collect()] == [("no_item_101", None), ("no_acquirer", None), ("no_item_101", None)]


def brute_match(deals, pool):
    used, out = set(), {}
    for d in sorted(deals, key=lambda d: d.id):
        tiers = ([c for c in pool if c.sector == d.sector and c.band == d.band], [c for c in pool if c.sector == d.sector], pool)
        for t in tiers:
            free = [c for c in t if c.id not in used]
            if free:
                c = min(free, key=lambda c: (round(abs(math.log1p(max(0, c.size)) - math.log1p(max(0, d.size))), 9), c.id))
                break
        used.add(c.id)
        out[d.id] = c.id
    return out


def test_greedy_matching(spark):
    r = random.Random(3)
    make = lambda n, at: spark.createDataFrame([(at + i, r.randrange(4), r.uniform(-5, 1e4)) for i in range(n)], "id bigint, sector int, size double")
    deals, pool = corpus.banded(make(12, 0), make(20, 100))
    deals, pool = spark.createDataFrame(deals.collect(), deals.schema), spark.createDataFrame(pool.collect(), pool.schema)
    got = {m.deal: m.cand for m in corpus.match_controls(deals, pool).collect()}
    assert got == brute_match(deals.collect(), pool.collect()) and len(set(got.values())) == 12
    with pytest.raises(ValueError, match="controls"):
        corpus.match_controls(deals, pool.limit(3))


def test_cache_layers(spark):
    req = spark.createDataFrame([("a",), ("b",), ("c",)], "cache_key string")
    layer = lambda rows: spark.createDataFrame(rows, "cache_key string, text string, latency_trustworthy boolean")
    layers = [layer([("a", "1", True)]), layer([("a", "2", True), ("b", "2", True), ("z", "2", True)])]
    got = {r.cache_key: (r.text, r.layer, r.latency_trustworthy) for r in cache.read_through(req, layers).collect()}
    assert got == {"a": ("1", 0, False), "b": ("2", 1, False)} and [r.cache_key for r in cache.missing(req, layers).collect()] == ["c"]
    plan = cache.plan_budget(spark.createDataFrame([(1, 4), (2, 4)], "unit_id int, k int"))
    cache.check_budget(plan, 8)
    with pytest.raises(cache.BudgetExceeded):
        cache.check_budget(plan, 7)


def test_containment_short_and_long_values(spark):
    docs = spark.createDataFrame([(1, "The quick BROWN fox jumps over a lazy dog, twice."), (2, None), (3, "foxes")], "d int, t string")
    values = spark.createDataFrame([(1, "quick brown fox jumps over a"), (2, "fox"), (3, ""), (4, "brown fox jumps over a lazy cat")], "v int, s string")
    assert {(r.d, r.v) for r in leaks.contained(docs, "d", "t", values, "v", "s").collect()} == {(1, 1), (1, 2), (3, 2)}


def test_registry():
    assert {"none", "clean_reference", "system_prompt", "retrieval_filter", "refusal_classifier", "lora_ga", "silent_substitution"} == set(containment.REGISTRY)
    with pytest.raises(ValueError, match="named"):
        containment.register(type("Again", (containment.Method,), {}))


def test_detector_separates_and_does_not(spark):
    r = random.Random(4)
    rows = [(2 * p + y, p, y, y * 2 + r.gauss(0, 0.5), r.gauss(0, 1) if p % 9 else None) for p in range(30) for y in (0, 1)]
    df = spark.createDataFrame(rows, "entity_id bigint, pair_id bigint, label int, x double, z double")
    assert detector.cv_auc(detector.out_of_fold(df, ["x", "z"], repeats=2)).first()["auc"] > 0.9
    assert 0.2 < detector.cv_auc(detector.out_of_fold(df, ["z"], repeats=2)).first()["auc"] < 0.8
    top = {r.feature: r for r in detector.importance(df, ["x", "z"], draws=8).collect()}
    assert top["x"].lo > 0 and abs(top["z"].point) < top["x"].point


def test_audits_are_ordered(spark):
    """A clean agent leaks nothing, an undefended one does, one that refuses leaks nothing and is visible."""
    from veilmark.operators import audit

    rows = {r.method: r for r in audit.sweep(spark, 8, 4, ["none", "clean_reference", "refusal_classifier", "silent_substitution"]).collect()}
    assert rows["clean_reference"].worst_leak == rows["refusal_classifier"].worst_leak == 0 and rows["none"].worst_leak > 0.3
    assert rows["silent_substitution"].worst_leak <= 0.1 and rows["refusal_classifier"].auc > 0.95


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_is_its_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    got, want = catalogue.QUERIES[name](spark, SF), con.execute(catalogue.SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    show = lambda v: f"{v:.6g}" if isinstance(v, float) else str(v)
    assert sorted([show(r[c]) for c in names] for r in got.collect()) == sorted([show(v) for v in r] for r in want.fetchall())


@pytest.mark.parametrize("part", [12, 2_000_000])
def test_short_values_against_brute_force(spark, monkeypatch, part):
    """Values that overlap, hold or begin one another, in one part and in many; inside words, too."""
    from veilmark.functions.text import soft
    from veilmark.operators import automaton

    monkeypatch.setattr(automaton, "PART", part)
    r = random.Random(part)
    word = lambda: "".join(r.choice("abc") for _ in range(r.randrange(1, 5)))
    texts = [(i, " ".join(word() for _ in range(r.randrange(30)))) for i in range(40)] + [(90, None), (91, ""), (92, "x" * 50_000 + " abca, CAB!")]
    values = [(i, " ".join(word() for _ in range(r.randrange(1, 6)))) for i in range(40)] + [(80, ""), (81, None), (82, "ABCA  cab"), (83, "abca cab"), (84, "--")]
    docs, held = spark.createDataFrame(texts, "d int, t string").repartition(3), spark.createDataFrame(values, "v int, s string")
    plain = {row.v: row.s for row in held.select("v", soft(F.col("s")).alias("s")).collect()}
    softened = {row.d: row.t for row in docs.select("d", soft(F.col("t")).alias("t")).collect()}
    want = {(d, v) for d, t in softened.items() for v, s in plain.items() if t and s and s in t}
    got = [(row.d, row.v) for row in leaks.contained(docs, "d", "t", held, "v", "s").collect()]
    assert set(got) == want and len(got) == len(want) and (92, 82) in want
    assert leaks.contained(docs, "d", "t", held.limit(0), "v", "s").count() == 0
