"""Queries that fit models or run the whole measurement. The SQL of the logistic ones takes the same Newton steps, with a Cholesky solve spelt out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilmark.operators import audit, boosting, corpus, detector
from veilmark.operators.durable import durable
from veilmark.operators.stats import auc, rounded
from veilmark.plans.stats_queries import poisson
from veilmark.sources.tables import read

_FEATURES = ["n_chars", "lines", "bars"]


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    """All labelled documents, two neighbours by doc_id a pair; features are counts of their text."""
    text = F.coalesce("text", F.lit(""))
    counted = read(spark, d, "documents").select(
        "doc_id", F.col("n_chars").cast("double").alias("n_chars"), F.size(F.split(text, "\n")).cast("double").alias("lines"),
        (F.char_length(text) - F.char_length(F.replace(text, F.lit("|"), F.lit("")))).cast("double").alias("bars"),
    )
    marked = read(spark, d, "labels").select("doc_id", F.col("quality").alias("label"), F.floor(F.col("doc_id") / 2).cast("bigint").alias("pair_id"))
    return marked.join(counted, "doc_id").withColumnRenamed("doc_id", "entity_id")


_ROWS = """e AS (SELECT doc_id, CAST(floor(doc_id / 2) AS BIGINT) AS pair_id, CAST(quality AS DOUBLE) AS y, CAST(n_chars AS DOUBLE) AS x1,
  length(coalesce(text, '')) - length(replace(coalesce(text, ''), chr(10), '')) + 1.0 AS x2, length(coalesce(text, '')) - length(replace(coalesce(text, ''), '|', '')) + 0.0 AS x3 FROM labels JOIN documents USING (doc_id))"""

#: From t (m: model, w: weight, y, x1 to x3) to fit (i: step, m, a1.. means, d1.. deviations, b1 to b3 and the bias b4).
_NEWTON = """
s1 AS (SELECT m, sum(w * x1) / sum(w) AS a1, sum(w * x2) / sum(w) AS a2, sum(w * x3) / sum(w) AS a3 FROM t GROUP BY m HAVING sum(w * y) > 0 AND sum(w * y) < sum(w)),
s2 AS (SELECT m, a1, a2, a3, sqrt(sum(w * (x1 - a1) ** 2) / sum(w)) AS e1, sqrt(sum(w * (x2 - a2) ** 2) / sum(w)) AS e2, sqrt(sum(w * (x3 - a3) ** 2) / sum(w)) AS e3 FROM t JOIN s1 USING (m) GROUP BY ALL),
s AS (SELECT m, a1, a2, a3, CASE WHEN e1 < 1e-12 THEN 1 ELSE e1 END AS d1, CASE WHEN e2 < 1e-12 THEN 1 ELSE e2 END AS d2, CASE WHEN e3 < 1e-12 THEN 1 ELSE e3 END AS d3 FROM s2),
z AS (SELECT m, w, y, (x1 - a1) / d1 AS z1, (x2 - a2) / d2 AS z2, (x3 - a3) / d3 AS z3 FROM t JOIN s USING (m)),
steps AS (
  SELECT 0 AS i, m, 0.0::DOUBLE AS b1, 0.0::DOUBLE AS b2, 0.0::DOUBLE AS b3, 0.0::DOUBLE AS b4 FROM s
  UNION ALL
  SELECT i + 1, m, b1 - f * c1, b2 - f * c2, b3 - f * c3, b4 - f * c4 FROM (
    SELECT *, sqrt(h11) AS l11, h12 / l11 AS l21, h13 / l11 AS l31, h14 / l11 AS l41, sqrt(h22 - l21 ** 2) AS l22, (h23 - l31 * l21) / l22 AS l32, (h24 - l41 * l21) / l22 AS l42,
      sqrt(h33 - l31 ** 2 - l32 ** 2) AS l33, (h34 - l41 * l31 - l42 * l32) / l33 AS l43, sqrt(h44 - l41 ** 2 - l42 ** 2 - l43 ** 2) AS l44,
      g1 / l11 AS y1, (g2 - l21 * y1) / l22 AS y2, (g3 - l31 * y1 - l32 * y2) / l33 AS y3, (g4 - l41 * y1 - l42 * y2 - l43 * y3) / l44 AS y4,
      y4 / l44 AS c4, (y3 - l43 * c4) / l33 AS c3, (y2 - l32 * c3 - l42 * c4) / l22 AS c2, (y1 - l21 * c2 - l31 * c3 - l41 * c4) / l11 AS c1,
      least(1.0, 5.0 / greatest(abs(c1), abs(c2), abs(c3), abs(c4), 1e-12)) AS f
    FROM (
      SELECT i, m, b1, b2, b3, b4, sum(v * z1 * z1) + 1 AS h11, sum(v * z1 * z2) AS h12, sum(v * z1 * z3) AS h13, sum(v * z1) AS h14, sum(v * z2 * z2) + 1 AS h22, sum(v * z2 * z3) AS h23, sum(v * z2) AS h24,
        sum(v * z3 * z3) + 1 AS h33, sum(v * z3) AS h34, sum(v) + 1e-9 AS h44, sum(r * z1) + b1 AS g1, sum(r * z2) + b2 AS g2, sum(r * z3) + b3 AS g3, sum(r) + 1e-9 * b4 AS g4
      FROM (SELECT *, 1 / (1 + exp(-(b1 * z1 + b2 * z2 + b3 * z3 + b4))) AS p, w * p * (1 - p) AS v, w * (p - y) AS r FROM steps JOIN z USING (m) WHERE i < 30) GROUP BY i, m, b1, b2, b3, b4))),
fit AS (SELECT * FROM steps JOIN s USING (m) WHERE i = 30)"""


def detector_oof(spark: SparkSession, d: str) -> DataFrame:
    """AUC of scores from folds that a document's pair was not in, by repeat."""
    scores = detector.out_of_fold(_vectors(spark, d), _FEATURES, repeats=3)
    return auc(scores, by="repeat").select(F.col("repeat").cast("bigint").alias("repeat"), "n_pos", "n_neg", rounded("auc"))


_SQL_OOF = f"""
WITH RECURSIVE {_ROWS},
u AS (SELECT pair_id, count(*) FILTER (y = 1) AS up, count(*) FILTER (y = 0) AS down FROM e GROUP BY 1), k AS (SELECT greatest(2, least(5, min(n))) AS k FROM (SELECT count(*) AS n FROM e GROUP BY y)),
f AS (SELECT r, pair_id, (row_number() OVER (PARTITION BY r, up, down ORDER BY sha256('17|' || r || '|' || pair_id), pair_id) - 1) % k AS fold FROM u, k, (SELECT unnest(range(0, 3)) AS r)),
g AS (SELECT e.*, f.r, f.fold, f.r * k + f.fold AS own FROM e JOIN f USING (pair_id), k),
t AS (SELECT g.r * k + j AS m, 1.0 AS w, y, x1, x2, x3 FROM g, k, (SELECT unnest(range(0, 5)) AS j) WHERE j < k AND j <> g.fold),{_NEWTON},
c AS (SELECT r, y, b4 + b1 * (x1 - a1) / d1 + b2 * (x2 - a2) / d2 + b3 * (x3 - a3) / d3 AS score FROM g JOIN fit ON fit.m = g.own),
o AS (SELECT *, rank() OVER (PARTITION BY r ORDER BY round(score, 9)) + (count(*) OVER (PARTITION BY r, round(score, 9)) - 1) / 2.0 AS k FROM c),
a AS (SELECT r, count(*) FILTER (y = 1) AS n1, count(*) FILTER (y = 0) AS n0, sum(k) FILTER (y = 1) AS k1 FROM o GROUP BY r)
SELECT r AS repeat, n1 AS n_pos, n0 AS n_neg, round((k1 - n1 * (n1 + 1) / 2.0) / (n1 * n0), 6) AS auc FROM a"""


def detector_importance(spark: SparkSession, d: str) -> DataFrame:
    """Mean coefficients over resampled pairs, and their intervals."""
    found = detector.importance(_vectors(spark, d), _FEATURES, draws=20)
    return found.select("feature", rounded("point"), rounded("lo"), rounded("hi"))


_SQL_IMPORTANCE = f"""
WITH RECURSIVE {_ROWS}, p AS (SELECT pair_id, d AS m, {poisson('19', 'd', 'pair_id')} AS w FROM (SELECT DISTINCT pair_id FROM e), (SELECT unnest(range(0, 20)) AS d)),
t AS (SELECT m, CAST(w AS DOUBLE) AS w, y, x1, x2, x3 FROM e JOIN p USING (pair_id) WHERE w > 0),{_NEWTON},
c AS (SELECT unnest(['n_chars', 'lines', 'bars']) AS feature, unnest([b1, b2, b3]) AS b FROM fit)
SELECT feature, round(avg(b), 6) AS point, round(quantile_cont(b, 0.025), 6) AS lo, round(quantile_cont(b, 0.975), 6) AS hi FROM c GROUP BY 1"""


def detector_boosting(spark: SparkSession, d: str) -> DataFrame:
    """AUC of boosted trees on folds that a document's pair was not in, by repeat."""
    rows, k = detector.dealt(_vectors(spark, d), repeats=2, seed="23")
    rows = durable(rows)
    trees = boosting.fit(rows.withColumn("w", detector.fold_weights(k)), _FEATURES, "label", "w", trees=10, depth=2, bins=16)
    asked = rows.withColumn("models", F.transform("folds", lambda f, repeat: repeat * k + f))
    scores = boosting.decide(asked, _FEATURES, trees, "models").select("label", F.posexplode("scores").alias("repeat", "score"))
    return auc(scores.withColumn("score", F.round("score", 9)), by="repeat").select(F.col("repeat").cast("bigint").alias("repeat"), "n_pos", "n_neg", rounded("auc"))


def _level(name: str, rows: str, by: str) -> str:
    """SQL: histograms of rows (by, bins x, w, g) to the best cut (feature j, last bin v) of each node."""
    return f"""{name}h AS (SELECT {by}, j, x[j] AS v, sum(w) AS n, sum(w * g) AS s FROM {rows}, (SELECT unnest(range(1, 4)) AS j) GROUP BY {by}, j, x[j]),
  {name}c AS (SELECT *, sum(n) OVER o AS nl, sum(s) OVER o AS sl, sum(n) OVER q AS nt, sum(s) OVER q AS tt FROM {name}h WINDOW o AS (PARTITION BY {by}, j ORDER BY v), q AS (PARTITION BY {by}, j)),
  {name}g AS (SELECT *, round(sl ** 2 / nl + (tt - sl) ** 2 / (nt - nl) - tt ** 2 / nt, 9) AS gain FROM {name}c WHERE nl > 0 AND nl < nt),
  {name}s AS (SELECT {by}, j, v FROM {name}g WHERE gain > 1e-9 QUALIFY row_number() OVER (PARTITION BY {by} ORDER BY gain DESC, j, v) = 1)"""


_SIXTEENTHS = [i / 16 for i in range(1, 16)]
_SQL_BOOSTING = f"""
WITH RECURSIVE {_ROWS},
u AS (SELECT pair_id, count(*) FILTER (y = 1) AS up, count(*) FILTER (y = 0) AS down FROM e GROUP BY 1), k AS (SELECT greatest(2, least(5, min(n))) AS k FROM (SELECT count(*) AS n FROM e GROUP BY y)),
f AS (SELECT r, pair_id, (row_number() OVER (PARTITION BY r, up, down ORDER BY sha256('23|' || r || '|' || pair_id), pair_id) - 1) % k AS fold FROM u, k, (SELECT unnest(range(0, 2)) AS r)),
ends AS (SELECT quantile_disc(x1, {_SIXTEENTHS}) AS q1, quantile_disc(x2, {_SIXTEENTHS}) AS q2, quantile_disc(x3, {_SIXTEENTHS}) AS q3 FROM e),
b AS (SELECT doc_id, pair_id, y, [len(list_filter(list_distinct(q1), lambda c: c < x1)), len(list_filter(list_distinct(q2), lambda c: c < x2)), len(list_filter(list_distinct(q3), lambda c: c < x3))] AS x FROM e, ends),
rows AS (SELECT f.r * k + j AS m, f.r, f.fold = j AS out, doc_id, CAST(f.fold <> j AS INTEGER) AS w, y, x FROM b JOIN f USING (pair_id), k, (SELECT unnest(range(0, 5)) AS j) WHERE j < k),
start AS (SELECT m, ln(sum(w * y) / sum(w) / (1 - sum(w * y) / sum(w))) AS f FROM rows GROUP BY m HAVING sum(w * y) > 0 AND sum(w * y) < sum(w)),
state AS (
  SELECT 0 AS i, m, r, out, doc_id, w, y, x, f FROM rows JOIN start USING (m)
  UNION ALL (
  WITH d AS (SELECT *, 1 / (1 + exp(-f)) AS p, y - p AS g, p * (1 - p) AS h FROM state WHERE i < 10),
  {_level('r', 'd', 'm')},
  a AS (SELECT d.*, coalesce(d.x[rs.j] > rs.v, false) AS side FROM d LEFT JOIN rs USING (m)),
  {_level('t', 'a', 'm, side')},
  l AS (SELECT a.*, coalesce(a.x[ts.j] > ts.v, false) AS leaf FROM a LEFT JOIN ts USING (m, side)),
  step AS (SELECT m, side, leaf, CASE WHEN sum(w * h) > 1e-12 THEN 0.1 * sum(w * g) / sum(w * h) ELSE 0 END AS step FROM l GROUP BY m, side, leaf)
  SELECT i + 1, m, r, out, doc_id, w, y, x, f + step FROM l JOIN step USING (m, side, leaf))),
c AS (SELECT r, y, round(f, 9) AS score FROM state WHERE i = 10 AND out),
o AS (SELECT *, rank() OVER (PARTITION BY r ORDER BY score) + (count(*) OVER (PARTITION BY r, score) - 1) / 2.0 AS k FROM c),
n AS (SELECT r, count(*) FILTER (y = 1) AS n1, count(*) FILTER (y = 0) AS n0, sum(k) FILTER (y = 1) AS k1 FROM o GROUP BY r)
SELECT r AS repeat, n1 AS n_pos, n0 AS n_neg, round((k1 - n1 * (n1 + 1) / 2.0) / (n1 * n0), 6) AS auc FROM n"""


def _workspace(spark: SparkSession, d: str) -> audit.Workspace:
    """A deal of each supplier."""
    deals = corpus.seeded_deals(read(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), "s_name"))
    return audit.prepare(spark, 0, deals=deals)


def sweep_comparison(spark: SparkSession, d: str) -> DataFrame:
    """All methods on deals of all suppliers, measured together."""
    return audit.sweep(spark, k=4, ws=_workspace(spark, d))


QUERIES = {f.__name__: f for f in (detector_oof, detector_importance, detector_boosting, sweep_comparison)}
SQL: dict[str, str] = {"detector_oof": _SQL_OOF, "detector_importance": _SQL_IMPORTANCE, "detector_boosting": _SQL_BOOSTING}
