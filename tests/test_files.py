"""Sources, sinks and reports."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from veilmark.operators import cache, corpus, report
from veilmark.sources import files


def test_index_scan(spark):
    lines = ["Form Type   Company Name   CIK   Date Filed   File Name", "-" * 60, "8-K         ACME HOLDINGS INC       1000012   2019-02-03  edgar/data/1000012/0001-19-000001.txt", "SC 13D      BETA & CO       77   2019-02-04  edgar/data/77/0002-19-000002.txt", "", "8-K  broken"]
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    got = files.index_rows(df).orderBy("date_filed").collect()
    assert [(r.form_type, r.company_name, r.cik, str(r.date_filed), r.accession) for r in got] == [("8-K", "ACME HOLDINGS INC", "1000012", "2019-02-03", "0001-19-000001"), ("SC 13D", "BETA & CO", "77", "2019-02-04", "0002-19-000002")]
    assert files.index_rows(df, ["SC 13D"]).count() == 1
    assert files.parse_quarter("2019Q1") == (2019, 1)
    for bad in ("2019", "19Q1", "2019Q5"):
        with pytest.raises(ValueError, match="quarter"):
            files.parse_quarter(bad)
    assert spark.range(1).select(files.pad_cik(F.lit("0042"))).first()[0] == "0000000042"


def test_shards_and_quarantine(spark, tmp_path):
    path = str(tmp_path / "cache")
    rows = spark.createDataFrame([("ab1", "p", "x"), ("ab2", "p", "y"), ("cd3", "q", "z")], "cache_key string, probe_id string, text string")
    files.write_generations(rows, path)
    with gzip.open(tmp_path / "cache" / "shard=ab" / "torn.json.gz", "wt") as f:
        f.write(json.dumps({"cache_key": "ab9", "text": "w"}) + "\n" + '{"cache_key": "ab8", "te' + "\n" + '{"text": "no key"}\n')
    good, bad = files.read_generations(spark, path)
    assert sorted(r.cache_key for r in good.collect()) == ["ab1", "ab2", "ab9", "cd3"]
    assert sorted(r.payload for r in bad.collect()) == ['{"cache_key": "ab8", "te', '{"text": "no key"}']


def test_checkpoint_and_notes(spark, tmp_path):
    units = spark.createDataFrame([("a",), ("b",), ("c",)], "unit_id string")
    done = str(tmp_path / "done")
    files.mark_done(units.limit(1), done)
    files.mark_done(units.limit(1), done)
    assert {r.unit_id for r in cache.pending(units, files.read_done(spark, done)).collect()} == {"b", "c"}
    deals = corpus.synthetic_deals(spark, 2)
    entities = deals.select("deal_id", F.concat(F.lit("e"), "deal_id").alias("entity_id"))
    notes = files.prime_memory(corpus.artifacts(deals), entities)
    files.write_notes(notes, str(tmp_path / "notes"))
    read = files.read_notes(spark, str(tmp_path / "notes"))
    assert read.count() == 8 and read.where("text like '%per share%'").count() == 8
    first = read.first()
    assert files.read_notes(spark, str(tmp_path / "notes"), first.entity_id).count() == 4
    files.write_workspace({"deals": deals}, str(tmp_path / "ws"))
    assert spark.read.json(str(tmp_path / "ws/deals")).count() == 2


def test_reports(spark):
    table = spark.createDataFrame([("none", 0.5, 0.8, 0.7, 0.9, "detectable", "leaks")], "method string, worst_leak double, auc double, lo double, hi double, state string, verdict string")
    assert "| none | 0.500 | 0.800 | [0.700, 0.900] | detectable | leaks |" in report.comparison(table)
    leak = spark.createDataFrame([("direct", 4, 0.25, 0.5, 3)], "family string, k int, leak_at_1 double, leak_at_k double, n_probes int")
    point = spark.createDataFrame([(0.8, [0.7, 0.9], 0.6, 0.95, "detectable")], "auc double, auc_by_repeat array<double>, lo double, hi double, state string")
    assert "| direct | 4 | 0.250 | 0.500 | 3 |" in report.audit("none", leak, point, 42) and "0.200" in report.audit("none", leak, point, 42)
    tests = spark.createDataFrame([("logreg_primary", 0.01), ("gbt", 0.04), ("x", float("nan"))], "name string, p double")
    assert [(r.name, r.p_adjusted) for r in report.adjust_secondary(tests).collect()] == [("gbt", 0.04)]
