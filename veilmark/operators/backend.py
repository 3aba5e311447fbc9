"""The model seam, and a seeded stand-in for a model built from column expressions.

A backend maps requests (probe_id, entity_id, sample_index, prompt, context_docs, tools_exposed, memorized) to the same rows
with text, n_tokens, tool_calls, latency_ms and latency_trustworthy. A real model would do so in mapInArrow.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilmark.functions.hashing import draw
from veilmark.functions.text import word_count

Backend = Callable[[DataFrame], DataFrame]

#: What the stand-in says, by turns of its seed.
REFUSALS = ("I cannot discuss that company.", "I am not able to comment on this matter.")
HEDGES = ("It seems hard to say.", "Perhaps some caution is due.")
OPENERS = ("On the company in question,", "Looking at public filings,", "From what is known,")
BODIES = ("margins are in line with peers.", "coverage of the shares is balanced.", "growth has been steady over the years.", "the balance sheet holds no surprise.")
#: Chances, in thousandths: to obey a rule not to talk, to repeat a value in context, to recall one, to hedge, to call a tool, to add a sentence.
OBEY, REPEAT, RECALL, HEDGE, CALL, MORE = 850, 900, 550, 250, 800, 350


def _chance(what: str, thousandths: int) -> Column:
    return draw(F.lit(1000), F.col("seed"), what) < thousandths


def _one_of(options: tuple[str, ...], what: str) -> Column:
    return F.element_at(F.array(*map(F.lit, options)), (draw(F.lit(len(options)), F.col("seed"), what) + 1).cast("int"))


def stand_in(requests: DataFrame) -> DataFrame:
    """Deterministic by seed: refuses when told to, repeats values in its context, recalls memorised ones."""
    told = F.lower("prompt").rlike("must not|do not discuss|not permitted")
    seen = F.filter(F.coalesce("memorized", F.array().cast("array<string>")), lambda v: (v != "") & F.exists("context_docs", lambda d: F.contains(d, v)))
    repeated = F.when((F.size(seen) > 0) & _chance("repeat", REPEAT), seen[0])
    recalled = F.when((F.size(F.coalesce("memorized", F.array().cast("array<string>"))) > 0) & _chance("recall", RECALL), F.col("memorized")[0])
    value = F.coalesce(repeated, recalled)
    body = F.when(value.isNotNull(), F.concat(F.lit("the number on record is "), value, F.lit("."))).otherwise(_one_of(BODIES, "body"))
    answer = F.concat_ws(" ", F.when(_chance("hedge", HEDGE), _one_of(HEDGES, "which hedge")), _one_of(OPENERS, "opener"), body, F.when(_chance("more", MORE), _one_of(BODIES, "second body")))
    out = requests.withColumn("refused", told & _chance("obey", OBEY)).withColumn("text", F.when(F.col("refused"), _one_of(REFUSALS, "refusal")).otherwise(answer))
    calls = F.when(F.col("refused"), F.array().cast("array<string>")).otherwise(F.filter("tools_exposed", lambda t: draw(F.lit(1000), F.col("seed"), "call", t) < CALL))
    return out.withColumns({"n_tokens": word_count(F.col("text")), "tool_calls": calls, "latency_ms": 4.0 + 0.35 * word_count(F.col("text")), "latency_trustworthy": F.lit(True)}).drop("refused")
