"""What a generation request is, as Columns: the text a model sees, its seed, and the key it is cached under."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilmark.functions.hashing import digest, short_hash, stable_seed


def canonical_json(**parts: Column) -> Column:
    """JSON of the parts with sorted keys and all values as texts; nulls are kept."""
    return F.to_json(F.struct(*(parts[k].cast("string").alias(k) for k in sorted(parts))), {"ignoreNullFields": "false"})


def full_prompt(prompt: Column, system: Column, context: Column, tools: Column) -> Column:
    """The exact text that a model sees: blocks for the system prompt, context and tools where there are any, then the user's."""
    block = lambda c, shown: F.when(F.coalesce(F.size(c), F.lit(0)) > 0, shown)
    return F.concat_ws(
        "\n\n", F.when(F.coalesce(system, F.lit("")) != "", F.concat(F.lit("[system]\n"), system)), block(context, F.concat(F.lit("[context]\n"), F.array_join(context, "\n---\n"))),
        block(tools, F.concat(F.lit("[tools available] "), F.array_join(F.array_sort(tools), ", "))), F.concat(F.lit("[user]\n"), prompt),
    )


def sample_seed(base: str, shown: Column, sample: Column) -> Column:
    """The seed of a sample, by what is asked and not by the order of calls."""
    return stable_seed(base, shown, sample)


def cache_key(backend: str, containment: str, shown: Column, tool_state: Column, sampling: dict[str, object], sample: Column, seed: Column) -> Column:
    """SHA-256 over all that can change a generation and nothing else."""
    fixed = {k: F.lit(str(v)) for k, v in sampling.items() if k not in ("k", "base_seed")}
    return F.sha2(canonical_json(backend=F.lit(backend), containment=F.lit(containment), prompt=shown, tool_state=tool_state, sample_index=sample, seed=seed, **fixed), 256)


def unit_id(probe: Column, entity: Column, k: int, config: str, containment: str, backend: str) -> Column:
    return short_hash(probe, entity, str(k), config, containment, backend, n=20)


def tool_state(store: str, tools: Column, top_k: int = 3) -> Column:
    """Of the store's fingerprint and the tools exposed; empty where there are none."""
    return F.when(F.coalesce(F.size(tools), F.lit(0)) > 0, digest(store, F.array_join(F.array_sort(tools), ","), str(top_k))).otherwise("")
