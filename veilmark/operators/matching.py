"""Controls for deals: the nearest candidates of each tier, and the greedy choice among them in rounds.

The greedy choice gives each deal, in order of id, its nearest free candidate of
its first tier that has one. That is the only matching in which no deal and
candidate would both rather have each other, if every candidate prefers the
smaller id; so it is reached by tentative rounds in any order: deals propose, a
candidate keeps its smallest deal, the others go on to those candidates that no
smaller deal holds. A task walks its share of the proposing deals at once, which
are dealt by their first wish, so that rivals meet and rounds stay few.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilmark.errors import MatchingError
from veilmark.operators.durable import Scratch, durable
from veilmark.operators.ordering import cuts, running

#: Deals that a task walks at once, whatever their wishes.
WALK = 1_000_000


def _sized(df: DataFrame, name: str) -> DataFrame:
    """name (the id), sector, band and l (log1p of the size; negative and missing ones count as 0). A missing sector or band is one of its own."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    return df.select(F.col("id").alias(name), text("sector"), text("band"), F.log1p(F.greatest(F.lit(0.0), F.col("size").cast("double"))).alias("l"))


def _both_ways(df: DataFrame) -> DataFrame:
    """Each row looking up, to larger sizes, and down, to equal and smaller ones; `at` grows with the distance either way."""
    return df.withColumn("up", F.explode(F.array(F.lit(True), F.lit(False)))).withColumn("at", F.when(F.col("up"), F.col("l")).otherwise(-F.col("l")))


class Pool:
    """Candidates on the line of sizes, ready for questions of any tier."""

    def __init__(self, scratch: Scratch, pool: DataFrame):
        self.rows = scratch.put(_sized(pool, "cand"))
        edges = cuts(self.rows, "l")
        self.edges = sorted({*edges, *(-e for e in edges)})
        self.scratch, self.ranked = scratch, None

    def tiers(self, deals: DataFrame, asked: tuple[int, ...], reach: int) -> DataFrame:
        """The nearest `reach` candidates of each deal (deal, sector, band, l) in each tier: deal, cand, tier, distance, rank."""
        own = deals.withColumn("own", F.col("sector"))
        found = []
        if 0 in asked or 1 in asked:
            line = self.rows.select("cand", "sector", F.col("band").alias("there"), "l")
            tier = F.when(F.col("there") == F.col("band"), 0).otherwise(1)
            places = own.join(line.select("sector", "there").distinct(), "sector").withColumn("tier", tier).where(F.col("tier").isin(*asked))
            found.append(self._ahead(places.drop("band"), _both_ways(line), ("up", "sector", "there"), reach))
        if 2 in asked:
            places = own.drop("sector", "band").withColumn("tier", F.lit(2))
            # The rest of the row of candidates that the place is in, and the beginnings of those after it.
            found.append(self._ahead(places, self._placed().select("up", "at", "cand", "sector", "l"), ("up",), reach).where(F.col("sector") != F.col("own")))
            found.append(self._ahead(places, self._thinned(reach), ("up",), reach * (reach + 1)).where(F.col("sector") != F.col("own")))
        near = found[0].select("deal", "cand", "tier", "distance")
        for more in found[1:]:
            near = near.unionByName(more.select("deal", "cand", "tier", "distance"))
        near = near.distinct() if 2 in asked else near
        first = Window.partitionBy("deal", "tier").orderBy("distance", "cand")  # of some multiples of reach
        return near.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= reach)

    def _placed(self) -> DataFrame:
        """Both ways, numbered: n among all, s within the sector."""
        if self.ranked is None:
            one = F.lit(1).cast("bigint")
            placed = running(_both_ways(self.rows), "at", [F.col("cand")], {"n": one}, ("up",), self.edges)
            self.ranked = self.scratch.put(running(placed, "at", [F.col("cand")], {"s": one}, ("up", "sector"), self.edges))
        return self.ranked

    def _thinned(self, reach: int) -> DataFrame:
        """Both ways, but of candidates in a row that share a sector only the first `reach`: others can't be among the nearest of a place before the row. A deal's own sector's rows are each followed by another's, so what it needs is among the next reach * (reach + 1)."""
        placed = self._placed()
        later = placed.select("up", "sector", (F.col("n") + reach).alias("n"), (F.col("s") + reach).alias("s"))
        return placed.join(later, ["up", "sector", "n", "s"], "left_anti").select("up", "at", "cand", "sector", "l")

    def _ahead(self, places: DataFrame, line: DataFrame, by: tuple[str, ...], reach: int) -> DataFrame:
        """Each place with the next candidates of the line, either way; both are numbered in one order, and an equi-join on numbers fetches the next ones, so no deal meets a whole group. Among equal sizes the smaller id comes first."""
        one = lambda n: F.lit(n).alias("one")
        asked = _both_ways(places).select(*by, "deal", "own", "tier", F.col("l").alias("ld"), "at", one(0))
        both = asked.unionByName(line.select(*{*by, "sector"}, "cand", "l", "at", one(1)), allowMissingColumns=True)
        numbered = running(both, "at", [F.when(F.col("up"), -F.col("one")).otherwise(F.col("one")), F.col("cand")], {"n": F.col("one")}, by, self.edges)
        found = numbered.where("one = 1").select(*{*by, "sector"}, "cand", "l", "n")
        wanted = numbered.where("one = 0").select(*by, "deal", "own", "tier", "ld", F.col("n").alias("n0"), F.explode(F.sequence(F.lit(1), F.lit(reach))).alias("k")).withColumn("n", F.col("n0") + F.col("k"))
        return wanted.drop("n0", "k").join(found, [*by, "n"]).withColumn("distance", F.round(F.abs(F.col("l") - F.col("ld")), 9))


def control_candidates(deals: DataFrame, pool: DataFrame, per_tier: int = 5) -> DataFrame:
    """The nearest candidates of each deal in each tier: (0) same sector and band, (1) same sector, another band, (2) another sector; distance is between log1p sizes, ties by id.

    deals, pool: id, sector, band, size. Rows: deal, cand, tier, distance, rank.
    """
    with Scratch(deals.sparkSession) as scratch:
        line, asked = Pool(scratch, pool), scratch.put(_sized(deals, "deal"))
        return durable(line.tiers(asked, (0, 1, 2), per_tier))


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Deals in order of id take the first of their wishes that no earlier one of this task has taken."""
    taken: set = set()
    for batch in batches:
        picks = []
        for wishes in batch.column("wishes").to_pylist():
            pick = next((i for i, w in enumerate(wishes) if w["cand"] not in taken), None)
            taken.add(None if pick is None else wishes[pick]["cand"])
            picks.append(pick)
        yield pa.record_batch([batch.column("deal"), pa.array(picks, pa.int32())], ["deal", "pick"])


def match_controls(deals: DataFrame, pool: DataFrame, at_once: int = 8) -> DataFrame:
    """One control for each deal, none used twice: as if deals in order of id took the nearest free candidate of their first tier that has one.

    deals, pool: id, sector, band, size; ids are unique. Rows: deal, cand, tier, distance. A deal begins with its `at_once` nearest
    candidates of the first tier; when smaller deals hold all of them it asks for four times as many, or for the next tier where there are no
    more. Deals of one sector and one and the same size have the same wishes, so n of them ask for lists of n. Raises MatchingError if
    candidates are fewer than deals.
    """
    spark = deals.sparkSession
    n, there = deals.count(), pool.count()
    if there < n:
        raise MatchingError(f"{n} controls are needed, the pool has fewer")
    deal, cand = (df.schema["id"].dataType.simpleString() for df in (deals, pool))
    with Scratch(spark) as scratch:
        line, asked = Pool(scratch, pool), scratch.put(_sized(deals, "deal"))
        scopes = asked.select("deal", F.lit(0).alias("tier"), F.lit(at_once).alias("reach"))  # what each deal has asked for
        lists = scratch.put(line.tiers(asked, (0,), at_once))
        held = spark.createDataFrame([], f"deal {deal}, cand {cand}, tier int, distance double")
        while True:
            # Wishes of deals that hold nothing: candidates that no smaller deal holds. Those passed over never come back, for holders only get smaller.
            open_ = lists.join(held.select("cand", F.col("deal").alias("holder")), "cand", "left").where(F.col("holder").isNull() | (F.col("holder") > F.col("deal")))
            wishes = open_.groupBy("deal").agg(F.sort_array(F.collect_list(F.struct("tier", "distance", "cand"))).alias("wishes"))  # of bounded lists
            free = scratch.put(scopes.join(held.select("deal"), "deal", "left_anti").join(wishes, "deal", "left"))
            waiting, stuck = free.agg(F.count(F.lit(1)), F.count_if(F.col("wishes").isNull())).first()
            if not waiting:
                return durable(held)
            if stuck:
                scopes, lists = _longer(scratch, line, asked, scopes, lists, free.where(F.col("wishes").isNull()).select("deal", "tier", "reach"))
            if waiting > stuck:
                held = scratch.put(_kept(held, free.where(F.col("wishes").isNotNull()), waiting - stuck))


def _kept(held: DataFrame, free: DataFrame, proposing: int) -> DataFrame:
    """What is held after each task's walk: every candidate keeps its smallest deal."""
    kind = f"deal {dict(free.dtypes)['deal']}, pick int"
    salt = F.pmod(F.xxhash64("deal"), F.lit(1 + proposing // WALK))
    ordered = free.select("deal", "wishes").repartition(F.element_at("wishes", 1)["cand"], salt).sortWithinPartitions("deal")
    picks = ordered.mapInArrow(_walk, kind).where(F.col("pick").isNotNull()).join(free.select("deal", "wishes"), "deal")
    wish = F.get("wishes", "pick")
    proposed = picks.select("deal", wish["cand"].alias("cand"), wish["tier"].alias("tier"), wish["distance"].alias("distance"))
    smallest = held.unionByName(proposed).groupBy("cand").agg(F.min(F.struct("deal", "tier", "distance")).alias("m"))
    return smallest.select("m.deal", "cand", "m.tier", "m.distance")


def _longer(scratch: Scratch, line: Pool, asked: DataFrame, scopes: DataFrame, lists: DataFrame, stuck: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Scopes and lists in which the stuck deals (deal, tier, reach) have longer ones."""
    got = lists.groupBy("deal", "tier").agg(F.count(F.lit(1)).alias("got"))
    more = F.coalesce(F.col("got"), F.lit(0)) == F.col("reach")
    last: Column = F.col("tier") == 2
    asks = stuck.join(got, ["deal", "tier"], "left").select("deal", F.when(more | last, F.col("tier")).otherwise(F.col("tier") + 1).alias("tier"), F.when(more | last, F.col("reach") * 4).otherwise(F.lit(None)).alias("longer"), "reach")
    start = scopes.agg(F.min("reach")).first()[0]
    asks = scratch.put(asks.select("deal", "tier", F.coalesce("longer", F.lit(start)).alias("reach")))
    found = [line.tiers(asked.join(asks.where((F.col("tier") == t) & (F.col("reach") == r)).select("deal"), "deal"), (t,), r) for t, r in asks.select("tier", "reach").distinct().collect()]  # three tiers, few lengths
    kept = lists.join(asks.select("deal"), "deal", "left_anti")
    for rows in found:
        kept = kept.unionByName(rows)
    return scratch.put(scopes.join(asks.select("deal"), "deal", "left_anti").unionByName(asks)), scratch.put(kept)
