"""Sources and sinks in files: form index, generation shards with a quarantine, checkpoints, memory notes, workspaces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A generation as it is stored.
GENERATION = (
    "cache_key string, probe_id string, entity_id string, sample_index int, seed string, text string, n_tokens int, backend_fp string, containment_fp string, "
    "trace struct<token_ids:array<int>,chosen_logprobs:array<double>,topm_logprobs:array<array<double>>>, tool_calls array<string>, latency_ms double, latency_trustworthy boolean"
)
NOTE = "entry_id string, entity_id string, text string, written_by string, is_private boolean"
#: Characters of a corrupt row that the quarantine keeps.
QUARANTINE_CHARS = 4000


def parse_quarter(quarter: str) -> tuple[int, int]:
    """'2019Q1' as year and quarter; anything else raises."""
    year, _, q = quarter.partition("Q")
    if len(year) != 4 or not year.isdigit() or q not in ("1", "2", "3", "4"):
        raise ValueError(f"{quarter!r} is no quarter such as 2019Q1")
    return int(year), int(q)


def index_rows(lines: DataFrame, forms: list[str] | None = None) -> DataFrame:
    """lines (value) of a form index to form_type, company_name, cik, date_filed, file_name, accession.

    The last three blank-separated words are the path, the date and the number of the company; what two blanks or more part from
    the rest, at the start, is the form, so forms of several words keep them. Lines that do not end so, such as the heading and
    its rule, are no rows.
    """
    w = F.filter(F.split("value", r"\s+"), lambda x: x != "")
    seen = lines.select(F.col("value"), w.alias("w")).where(F.size("w") >= 5).select(
        F.trim(F.regexp_extract("value", r"^(\S+(?: \S+)*?)(?:\s{2,}|\t)", 1)).alias("form_type"), F.element_at("w", -3).alias("cik"), F.to_date(F.when(F.element_at("w", -2).rlike(r"^\d{4}-\d{2}-\d{2}$"), F.element_at("w", -2))).alias("date_filed"),
        F.element_at("w", -1).alias("file_name"), F.regexp_extract("value", r"^\S+(?: \S+)*?\s{2,}(.*?)\s+\S+\s+\S+\s+\S+\s*$", 1).alias("company_name"),
    )
    rows = seen.where(F.col("cik").rlike(r"^\d+$") & F.col("date_filed").isNotNull() & (F.col("form_type") != "")).withColumn("accession", F.regexp_extract("file_name", r"([^/]+?)(?:\.txt)?$", 1))
    return rows.where(F.col("form_type").isin(forms)) if forms else rows


def read_index(spark: SparkSession, path: str, forms: list[str] | None = None) -> DataFrame:
    return index_rows(spark.read.text(path), forms)


def pad_cik(cik: Column) -> Column:
    return F.lpad(F.regexp_replace(cik, "^0+", ""), 10, "0")


def write_generations(generations: DataFrame, path: str) -> None:
    """Appends rows to gzip JSON-lines shards by the first two characters of the key; a task's commit makes them durable."""
    shards = generations.withColumn("shard", F.substring("cache_key", 1, 2))
    shards.repartition("shard").write.mode("append").partitionBy("shard").option("compression", "gzip").json(path)


def read_generations(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(generations, quarantine): rows that do not parse, or lack a key, go to the quarantine as the start of their line."""
    every = spark.read.schema(f"{GENERATION}, shard string, _corrupt string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    lines = spark.read.text(path, recursiveFileLookup=True).select("value")
    parsed = lines.select("value", F.from_json("value", f"{GENERATION}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("g"))
    bad = parsed.where(F.col("g._corrupt").isNotNull() | F.col("g.cache_key").isNull()).select(F.substring("value", 1, QUARANTINE_CHARS).alias("payload"))
    return every.where(F.col("cache_key").isNotNull()).drop("_corrupt", "shard"), bad


def mark_done(units: DataFrame, path: str) -> None:
    """Appends ids to a checkpoint, one a line."""
    units.select(F.col("unit_id").cast("string").alias("value")).write.mode("append").text(path)


def read_done(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).where(F.trim("value") != "").select(F.trim("value").alias("unit_id")).distinct()


def write_notes(notes: DataFrame, path: str) -> None:
    """Appends memory notes; a note's id is the hash of what it says."""
    key = F.substring(F.sha2(F.concat_ws("|", "entity_id", "text", "written_by", F.col("is_private").cast("string")), 256), 1, 12)
    notes.withColumn("entry_id", key).select("entry_id", "entity_id", "text", "written_by", "is_private").write.mode("append").json(path)


def read_notes(spark: SparkSession, path: str, entity_id: str | None = None) -> DataFrame:
    notes = spark.read.schema(NOTE).json(path)
    return notes.where(F.col("entity_id") == entity_id) if entity_id is not None else notes


def summary(text: Column) -> Column:
    """What a note keeps of an artifact: the lines on price or premium, else the first line that isn't blank."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    told = F.filter(lines, lambda x: F.lower(x).rlike("per share|premium"))
    return F.when(F.size(told) > 0, F.array_join(told, " ")).otherwise(F.coalesce(F.try_element_at(lines, F.lit(1)), F.lit("")))


def prime_memory(artifacts: DataFrame, entities: DataFrame) -> DataFrame:
    """Notes that a working group would have left: one for each artifact of an entity's deal."""
    return artifacts.join(entities.where("deal_id is not null").select("deal_id", "entity_id"), "deal_id").select("entity_id", summary(F.col("text")).alias("text"), F.lit("working group").alias("written_by"), F.lit(True).alias("is_private"))


def write_workspace(tables: dict[str, DataFrame], path: str) -> None:
    """Each table as JSON lines with sorted columns, in a folder of its name."""
    for name, df in tables.items():
        df.select(*sorted(df.columns)).write.mode("overwrite").json(f"{path}/{name}")
