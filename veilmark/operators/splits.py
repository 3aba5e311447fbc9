"""Dev and eval: views of a split, the guard around the dev side, and a record that lets a reader check both."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilmark.errors import SplitError
from veilmark.functions.hashing import set_hash


def entities_of(entities: DataFrame, pairs: DataFrame, split: str) -> DataFrame:
    """entities of one split. pairs: pair_id, split. Entities without a pair in it are left out."""
    return entities.join(pairs.where(F.col("split") == split).select("pair_id"), "pair_id", "left_semi")


def split_of(rows: DataFrame, entities: DataFrame, pairs: DataFrame) -> DataFrame:
    """rows (entity_id) with their split; rows of unknown entities are left out."""
    return rows.join(entities.select("entity_id", "pair_id").join(pairs, "pair_id").select("entity_id", "split"), "entity_id")


def dev_artifacts(artifacts: DataFrame, entities: DataFrame, pairs: DataFrame) -> DataFrame:
    """Artifacts of the dev side's deals: all that a method may fit on."""
    return artifacts.join(entities_of(entities, pairs, "dev").where("deal_id is not null").select("deal_id"), "deal_id", "left_semi")


def dev_control_probes(probes: DataFrame, entities: DataFrame, pairs: DataFrame) -> DataFrame:
    """Behavioural probes of the dev side's controls, on which a method is calibrated."""
    controls = entities_of(entities, pairs, "dev").where("entity_class = 'control'").select("entity_id")
    return probes.where("family = 'behavioural'").join(controls, "entity_id", "left_semi")


def require(rows: DataFrame, entities: DataFrame, pairs: DataFrame, split: str = "dev") -> DataFrame:
    """rows, if all their entities are in the split; else an error that names one."""
    out = rows.select("entity_id").join(entities_of(entities, pairs, split).select("entity_id"), "entity_id", "left_anti").first()
    if out is not None:
        raise SplitError(f"entity {out['entity_id']} is not in the {split} split")
    return rows


def overlap(pairs: DataFrame, entities: DataFrame) -> DataFrame:
    """What is on both sides: kind (pair or entity), id."""
    both = lambda df, c: df.groupBy(c).agg(F.count_distinct("split").alias("n")).where("n > 1")
    of_pairs = both(pairs, "pair_id").select(F.lit("pair").alias("kind"), F.col("pair_id").cast("string").alias("id"))
    of_entities = both(entities.join(pairs, "pair_id"), "entity_id").select(F.lit("entity").alias("kind"), F.col("entity_id").cast("string").alias("id"))
    return of_pairs.unionByName(of_entities)


def audit(pairs: DataFrame, entities: DataFrame, corpus_hash: str = "", seed: str = "") -> DataFrame:
    """One row: hashes of both sides' entity ids, their numbers of pairs, and whether they are disjoint."""
    placed = entities.join(pairs, "pair_id")
    side = lambda s, c: F.when(F.col("split") == s, F.col(c))
    distinct = lambda c: placed.select("split", c).distinct()
    ids = distinct("entity_id").agg(set_hash(side("dev", "entity_id")).alias("dev_ids_hash"), set_hash(side("eval", "entity_id")).alias("eval_ids_hash"))
    counts = distinct("pair_id").agg(F.count(side("dev", "pair_id")).alias("n_dev_pairs"), F.count(side("eval", "pair_id")).alias("n_eval_pairs"))
    one = ids.crossJoin(F.broadcast(counts))  # one row each
    shared = overlap(pairs, entities).agg((F.count("*") == 0).alias("splits_disjoint"))
    return one.crossJoin(F.broadcast(shared)).withColumns({"corpus_hash": F.lit(corpus_hash), "split_seed": F.lit(seed)})


def check(pairs: DataFrame, entities: DataFrame) -> None:
    """Raises if anything is on both sides."""
    bad = overlap(pairs, entities).first()
    if bad is not None:
        raise SplitError(f"{bad['kind']} {bad['id']} is in both splits")
