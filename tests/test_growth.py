"""Steps whose work must grow no faster than their input."""

from __future__ import annotations

import random

from pyspark.sql import functions as F


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_manifest_tells_ids_apart_once(spark):
    """Distinct sums of several expressions would copy each row for each of them."""
    from veilmark.operators import corpus, splits

    rows = [("a", "restricted"), ("b", "control"), ("b", "control"), (None, "control")]
    entities = spark.createDataFrame(rows, "entity_id string, entity_class string")
    made = corpus.manifest(spark.range(3), entities, spark.range(2), "m")
    assert "Expand" not in plan_of(made)
    got, once = made.first(), corpus.manifest(spark.range(3), entities.distinct(), spark.range(2), "m").first()
    assert (got.n_deals, got.n_restricted, got.n_controls, got.n_exclusions) == (3, 1, 3, 2) and got.corpus_hash == once.corpus_hash
    sides = spark.createDataFrame([("p", "dev"), ("q", "eval")], "pair_id string, split string")
    members = spark.createDataFrame([("a", "p"), ("b", "p"), ("c", "q"), ("c", "q")], "entity_id string, pair_id string")
    audit = splits.audit(sides, members)
    assert "Expand" not in plan_of(audit.select("dev_ids_hash", "eval_ids_hash", "n_dev_pairs", "n_eval_pairs"))
    assert audit.select("n_dev_pairs", "n_eval_pairs", "splits_disjoint").first() == (1, 1, True)


def test_pair_split_selects_without_ranking(spark, monkeypatch):
    """The same as ranks of the hashes, at any size; no window over the pairs."""
    import hashlib

    from veilmark.operators import stats

    for n, share in ((1, 0.3), (2, 0.9), (7, 0.0), (500, 0.3), (500, 1.0)):
        for digits in (1, 4):
            monkeypatch.setattr(stats, "DIGITS", digits)
            made = stats.pair_split(spark.range(n), "id", share, "s")
            order = sorted(range(n), key=lambda i: hashlib.sha256(f"s|{i}".encode()).hexdigest())
            n_dev = max(1, min(n - 1, round(n * share)))
            assert {r.id for r in made.where("split = 'dev'").collect()} == set(order[:n_dev]) and made.count() == n
            assert "Window" not in plan_of(made) and "SortMergeJoin" not in plan_of(made)
    assert stats.pair_split(spark.range(0), "id", 0.3, "s").count() == 0


def test_bootstrap_reads_clusters_once(spark):
    """Point, draws and number of clusters come from one pass: one scan, and no second telling apart of clusters."""
    from veilmark.operators import stats

    rows = spark.createDataFrame([(i % 40, float(i), float(i % 7)) for i in range(400)], "c int, a double, b double")
    made = stats.paired_bootstrap(rows, "c", "a", "b", draws=20)
    assert plan_of(made).count("Scan ExistingRDD") == 1 and "Expand" not in plan_of(made)
    got, several = made.first(), stats.cluster_bootstrap(rows.withColumn("d", F.col("a") - F.col("b")), "c", lambda total: total(F.col("d")) / total(F.lit(1.0)), 20, seed="paired").first()
    assert got.n_clusters == 40 and all(abs(got[x] - several[x]) < 1e-9 for x in ("point", "lo", "hi")) and got.lo < got.point < got.hi


def test_bm25_scores_where_documents_are(spark, monkeypatch):
    """Few queries: no exchange of documents' postings; many ties and tasks; the same as by the shuffle."""
    import random

    from veilmark.operators import retrieval

    r = random.Random(5)
    texts = [(i, " ".join(f"w{r.randrange(12)}" for _ in range(r.randrange(9)))) for i in range(300)] + [(i, "w1 w2 w3") for i in range(300, 360)] + [(400, None)]
    docs = spark.createDataFrame(texts, "d bigint, t string").repartition(5).fillna("", "t")
    queries = spark.createDataFrame([(1, "w1 w1 w2"), (2, "w3 w11 none"), (3, ""), (4, None), (5, "W5")], "q int, s string")
    read = lambda: [tuple(x) for x in retrieval.bm25_top(docs, "d", "t", queries, "q", "s", 4).orderBy("query", "rank").collect()]
    quick = retrieval.bm25_top(docs, "d", "t", queries, "q", "s", 4)
    assert "SortMergeJoin" not in plan_of(quick) and "MapInArrow" in plan_of(quick)
    here = read()
    monkeypatch.setattr(retrieval, "BROADCAST_TERMS", 1)
    there = read()
    assert len(here) == len(there) > 8 and all(a[:2] + a[3:] == b[:2] + b[3:] and abs(a[2] - b[2]) < 1e-8 for a, b in zip(here, there, strict=True))


def test_context_leaves_documents_in_place(spark):
    """What was found goes to the documents; only notes and public texts are joined by a shuffle where nothing is broadcast by size."""
    from veilmark.operators import context

    probes = spark.createDataFrame([(1, 1, "", "alpha beta", True)], "probe_id int, entity_id int, display_name string, prompt string, memory_primed boolean")
    documents = spark.createDataFrame([(i, f"alpha {i}", 1, False) for i in range(5)], "doc_id int, text string, entity_id int, is_private boolean")
    memory = spark.createDataFrame([("m", 1, "note", True)], "entry_id string, entity_id int, text string, is_private boolean")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = context.gather(probes, documents, memory, memory.select("entity_id", "text"), k=2)
        assert plan_of(got).count("SortMergeJoin") == 2 and got.count() == 4
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def moved(spark) -> int:
    """Records that this session's stages have written to shuffles so far."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    jvm, store = sc._jvm, sc._jsc.sc().statusStore()
    stages = store.stageList(jvm.java.util.ArrayList(), False, False, sc._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_stored_index_moves_texts_once(spark, monkeypatch, tmp_path):
    """No posting is shuffled, neither where the index is made nor where it is asked; queries asked in turn have the same answers."""
    import random

    from veilmark.operators import blockmax, retrieval

    r = random.Random(3)
    texts = [(i, " ".join(f"w{r.randrange(400)}" for _ in range(300))) for i in range(400)] + [(i, "w1 w2 w3") for i in range(400, 440)] + [(990, None), (-5, "w1 W2 w2")]
    docs = spark.createDataFrame(texts, "d bigint, t string").repartition(3).fillna("", "t")
    queries = spark.createDataFrame([(f"q{i}", " ".join(f"w{r.randrange(450)}" for _ in range(20))) for i in range(10)] + [("copies", "w1 w2 w3"), ("none", "x y"), ("null", None)], "q string, s string")
    start = moved(spark)
    index = blockmax.Index.build(docs, "d", "t", str(tmp_path / "index"))
    read = lambda top: sorted(tuple(x) for x in top.select("query", "doc", "score", "rank").collect())
    found, work = index.top(queries, "q", "s", 3)
    here, counts = read(found), sorted(tuple(x) for x in work.collect())
    postings = sum(len(set(t.lower().split())) for _, t in texts if t)
    assert index.postings.selectExpr("sum(size(entries))").first()[0] == postings and moved(spark) - start < postings / 5
    assert here == read(retrieval.bm25_top(docs, "d", "t", queries, "q", "s", 3)) and len(here) == 33
    monkeypatch.setattr(blockmax, "ASKED", 50)
    found, work = index.top(queries, "q", "s", 3)
    assert read(found) == here and sorted(tuple(x) for x in work.collect()) == counts and len(counts) == 11


def test_stored_index_of_nothing(spark, tmp_path):
    from veilmark.operators import blockmax

    for n, said in ((0, "a"), (2, "")):
        index = blockmax.Index.build(spark.createDataFrame([(i, "") for i in range(n)], "d int, t string"), "d", "t", str(tmp_path / f"i{n}"))
        found, work = index.top(spark.createDataFrame([(1, said)], "q int, s string"), "q", "s", 3)
        assert found.count() == work.count() == index.postings.count() == 0 and index.size[0] == n


def test_stored_index_keeps_a_document_without_id(spark, tmp_path):
    from veilmark.operators import blockmax

    docs = spark.createDataFrame([(None, "a b"), (1, "a c"), (2**62, "c")], "d bigint, t string")
    found, work = blockmax.Index.build(docs, "d", "t", str(tmp_path / "i")).top(spark.createDataFrame([(1, "a"), (2, "c")], "q int, s string"), "q", "s", 3)
    assert [(x["query"], x["doc"], x["rank"]) for x in found.orderBy("query", "rank").collect()] == [(1, 1, 1), (1, None, 2), (2, 2**62, 1), (2, 1, 2)]
    assert sorted(tuple(x) for x in work.collect()) == [(1, 2, 2), (2, 2, 2)]


def test_sample_diversity_is_the_same_both_ways(spark, monkeypatch):
    """Small groups are compared in one row each, as samples that meet by what they share."""
    from veilmark.operators import features

    r = random.Random(5)
    texts = [(k, i, r.choice([None, "", "a b", "ab", "alpha beta  gamma", " ".join(r.choice(["alpha", "beta", "x"]) for _ in range(5))])) for k in range(9) for i in range(k)]
    df = spark.createDataFrame(texts, "k int, i int, t string")
    found = lambda: {x.k: (round(x.semantic_diversity, 12), x.n_samples) for x in features.semantic_diversity(df, "k", "i", "t").collect()}
    small = found()
    monkeypatch.setattr(features, "TOGETHER", 0)
    assert small == found() and small[1] == (0.0, 1)


def test_auc_intervals_are_those_of_each_group(spark):
    """Ties, a missing score, a group of one class and one of three rows."""
    from veilmark.operators import stats

    r = random.Random(6)
    rows = [(g, i // 2, r.choice([round(r.gauss(i % 2, 1), 1), 0.0, None]), 1 if g == "one" else i % 2) for g, n in (("a", 60), ("one", 10), ("few", 3)) for i in range(n)]
    df = spark.createDataFrame(rows, "m string, pair_id int, score double, label int").repartition(3)
    got = {x.m: x for x in stats.auc_intervals(df, "m", draws=20, seed="s", permute="t").collect()}
    own = df.where("m = 'a'")
    want, p = stats.auc_bootstrap(own, draws=20, seed="s").first(), stats.permutation_p(own, draws=20, seed="t").first()["p"]
    assert abs(got["a"].lo - want.lo) < 1e-12 and abs(got["a"].hi - want.hi) < 1e-12 and abs(got["a"].p - p) < 1e-12
    assert got["one"].lo is None and got["one"].p is None and ("few" not in got or got["few"].p is None)
