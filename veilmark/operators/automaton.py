"""Which of many short strings a text holds, by one walk over the text.

The strings of a part make an Aho-Corasick automaton: a trie with links from each
place to the longest other beginning that ends there. Parts are ranges of the
strings in the order of their first words, so that what shares a beginning shares
the trie, and hold no more than `PART` characters; each is a broadcast of that
size and one walk over the texts, whatever the number of strings.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilmark.operators.durable import Scratch, durable

#: Characters of a part's strings: a task's trie has no more places.
PART = 2_000_000


def _walk(doc: str, strings: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for i, s in enumerate(strings.value):
            trie.add_word(s, i)
        trie.make_automaton()
        for batch in batches:
            rows: list[int] = []
            found: list[int] = []
            for i, text in enumerate(batch.column("text").to_pylist()):
                held = {s for _, s in trie.iter(text)} if text else set()
                rows += [i] * len(held)
                found += held
            yield pa.record_batch([batch.column(doc).take(pa.array(rows, pa.int64())), pa.array(found, pa.int32())], [doc, "place"])

    return walk


def holding(docs: DataFrame, doc: str, text: str, strings: DataFrame, string: str) -> DataFrame:
    """Distinct pairs (doc, string) of texts and strings they hold, anywhere, whole words or not. Empty and null ones are held by none."""
    spark = docs.sparkSession
    each = strings.select(F.col(string).alias("string")).where("string <> ''").distinct()
    texts = docs.select(F.col(doc).alias("__doc"), F.col(text).alias("text"))
    kind = dict(texts.dtypes)["__doc"]
    with Scratch(spark) as scratch:
        size = each.agg(F.sum(F.char_length("string"))).first()[0] or 0
        parts = 1 + size // (PART // 2)
        ranged = scratch.put(each.repartitionByRange(parts, F.substring_index("string", " ", 1), "string").sortWithinPartitions("string").withColumn("part", F.spark_partition_id()))
        out = spark.createDataFrame([], f"__doc {kind}, string string")
        for part in range(parts):
            listed = sorted(r.string for r in ranged.where(F.col("part") == part).select("string").collect())  # of PART characters or so
            if listed:
                found = texts.mapInArrow(_walk("__doc", spark.sparkContext.broadcast(listed)), f"__doc {kind}, place int")
                names = spark.createDataFrame(list(enumerate(listed)), "place int, string string")
                out = out.unionByName(found.join(names, "place").select("__doc", "string"))
        return durable(out.select(F.col("__doc").alias(doc), F.col("string").alias(string)).distinct())
