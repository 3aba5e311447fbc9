"""N-gram Jaccard join by PartEnum signatures, and the components its links make.

A document's set holds fingerprints (64 bits) of its distinct n-word shingles;
with fewer words, of the whole sequence; without words, it is empty and linked
with nothing. Equal sets are one node. Two sets with Jaccard similarity of at
least num/den differ in at most (den-num)/(den+num) of their joint size.

Signatures. Sizes fall into bands whose ends differ by the factor den/num, so
that similar sets lie in one band or in neighbours; a set signs at its own
band's level and at the next one's. At a level where sets differ in at most k
elements, the domain of fingerprints is parted, by their high bits, into
n1 = k div 2 + 1 + z first-level parts and each of these into three second-level
ones. In all but k div 2 first-level parts similar sets differ in one element at
most, hence agree on two of the three second-level parts: every such subset of
two signs. So similar sets share at least one signature for each such part,
less those in which a subset is empty (empty ones sign only if nothing else is
sure to). How many they must share follows from a set's own size and its empty
subsets; a set that shares fewer has no partner. z keeps that number above the
one or two that a common passage makes two unlike texts share.

A task signs about `CHUNK` signatures at once; a signature that several of its
sets share is told to the others by two rows, whatever their number, so a common
signature comes twice a chunk, and no key gathers all rows of a group of copies.

Pairs. A bucket may hold many sets, and all its pairs are never formed. The
elements of all sets that share enough signatures are counted, and each set's
elements ordered by that count, then by value, the same order for all. Two
similar sets have their first common element among the first elements of both,
so far from the end that enough can follow (`_fits`). A set whose own words
differ too much has its own elements first and meets nobody. The sets that have
a common first element make a group; each meets its representative, the set with
the fewest elements before it in proportion, and pairs are verified on whole
sets. What links connect needs no more tests. Of the sets outside of a group's
largest component, further representatives (`REPS`, then eight times more, and
so on) meet the group's other sets until every one of them has been one or joined. So no
link between different components is missed, and none is added.

Nulls: a null text is empty; a null doc_id counts in no component's smallest
id. Copies and repeated rows are one node each and come back row by row; ties in
any order are broken by fingerprint. A very long text is one set in one task.
Other columns pass through `components` by name, but `n_shingles` and
`component_id` are overwritten. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilmark.llm.common import Tables, bitmap, by_bytes, durable, passes, schema_of, small_batches, spare
from veilmark.llm.components import connected_components
from veilmark.llm.tokens import grams, mix, word_hashes

BATCH_BYTES = 1 << 20
#: Signatures, or elements, that a task combines at once.
CHUNK = 1 << 18
#: Bits at most of the filters that keep sets and elements which nothing needs in their tasks.
FILTER_BITS = 1 << 26
#: Representatives of a group in the first round after the stars, then so many times more.
REPS = 8
#: Nodes a task remembers to have dealt with.
SEEN = 500_000

_U = np.uint64
#: The subsets of two of three second-level parts.
_PAIRS = np.array([[0, 1], [0, 2], [1, 2]])


def shingle_sets(texts: list[bytes | None], n: int) -> list[np.ndarray]:
    """The sorted distinct shingle fingerprints of each text."""
    words, first = word_hashes(texts)
    runs, begin = grams(words, first, n)
    out = []
    for i in range(len(texts)):
        a, b = begin[i], begin[i + 1]
        if b > a:
            out.append(np.unique(runs[a:b]))
        else:
            few = words[first[i] : first[i + 1]]
            whole = np.full(min(len(few), 1), len(few), _U)
            for k in range(len(few)):
                whole = mix(whole + few[k : k + 1])
            out.append(whole)
    return out


def node_of(found: np.ndarray) -> int:
    """A fingerprint of a whole set."""
    with np.errstate(over="ignore"):
        return int(mix(np.array([mix(found).sum(dtype=_U) * _U(0x9E3779B97F4A7C15) + _U(len(found))]))[0].astype(np.int64))


class Levels:
    """Bands of sizes, and how the sets of each level sign."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.ends: list[int] = []
        end = 0
        while end < 1 << 26:
            end = max(end + 1, (end + 1) * den // num)
            self.ends.append(end)

    def differ(self, a: int, b: int) -> int:
        """Elements in which similar sets of these sizes differ at most."""
        return (self.den - self.num) * (a + b) // (self.den + self.num)

    @cache
    def scheme(self, level: int) -> tuple[int, int]:
        """(k, first-level parts) of a level."""
        k = self.differ(self.ends[level], self.ends[level])
        parts = k // 2 + 1
        return k, parts + parts // 20 + (parts > 2)

    def sign(self, found: np.ndarray) -> Iterator[tuple[np.ndarray, int]]:
        """The signatures of a sorted set that isn't empty, at its own band's level and at the next, each with the number of them that a similar set shares."""
        band = int(np.searchsorted(self.ends, len(found)))
        widest = len(found) * self.den // self.num
        for level in (band, band + 1):
            k, parts = self.scheme(level)
            if k:  # else only equal sets are similar
                yield self._at(level, parts, found, self.differ(len(found), min(widest, self.ends[level])))

    def _at(self, level: int, parts: int, found: np.ndarray, k: int) -> tuple[np.ndarray, int]:
        part = ((found >> _U(32)) * _U(3 * parts) >> _U(32)).astype(np.int64)  # rises with the fingerprint
        cut = np.searchsorted(part, np.arange(3 * parts + 1))
        sums = np.concatenate(([_U(0)], np.cumsum(mix(found), dtype=_U)))
        body = mix(sums[cut[1:]] - sums[cut[:-1]] + np.arange(3 * parts).astype(_U)).reshape(parts, 3)
        filled = np.diff(cut).reshape(parts, 3)[:, _PAIRS].sum(2) > 0
        sigs = mix(mix(body[:, _PAIRS[:, 0]] + (_U(level) << _U(40)) + _PAIRS[:, 0].astype(_U)) + body[:, _PAIRS[:, 1]])
        need = parts - k // 2 - int((~filled).any(1).sum())
        return (sigs[filled], need) if need > 0 else (sigs.ravel(), 1)


def _sets(batches: Iterator[pa.RecordBatch], column: str, n: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for batch in by_bytes(batches, column, BATCH_BYTES):
        yield batch, shingle_sets(batch.column(batch.schema.get_field_index(column)).to_pylist(), n)


def _new_sets(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[list[tuple[int, np.ndarray]]]:
    """(node, set) of each set that a task meets first."""
    seen: set[int] = set()
    for _, sets in _sets(batches, "raw", n):
        if len(seen) > SEEN:
            seen.clear()
        new = []
        for s in sets:
            if len(s) and (node := node_of(s)) not in seen:
                seen.add(node)
                new.append((node, s))
        yield new


def _raw(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("text").cast("binary").alias("raw"))


def nodes(docs: DataFrame, n: int, name: str = "node") -> DataFrame:
    """docs without text, with n_shingles and the set's node under this name (null for an empty set)."""
    plain = docs.drop(name, "n_shingles", "text")
    raw = spare(plain, "raw")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, sets in _sets(batches, raw, n):
            i = batch.schema.get_field_index(raw)
            out = [pa.array([node_of(s) if len(s) else None for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64())]
            yield pa.RecordBatch.from_arrays([*(c for k, c in enumerate(batch.columns) if k != i), *out], [*(c for c in batch.schema.names if c != raw), name, "n_shingles"])

    return docs.select(*plain.columns, F.col("text").cast("binary").alias(raw)).mapInArrow(run, schema_of(plain, (name, "bigint"), ("n_shingles", "bigint")))


def _told(signed: list[tuple[int, int, np.ndarray]]) -> pa.RecordBatch:
    """Rows (sig, node, mark, local) of a chunk's (node, mark, signatures). local: 0 for a signature that one set of the chunk has; -1 for two of those that share one; else how many a node shares inside of the chunk."""
    sigs = np.concatenate([s for _, _, s in signed])
    sizes = [len(s) for _, _, s in signed]
    node, mark = np.array([x[0] for x in signed], np.int64), np.array([x[1] for x in signed], np.int32)
    own = np.repeat(np.arange(len(signed)), sizes)
    order = np.argsort(sigs, kind="stable")
    begin = np.flatnonzero(np.concatenate(([True], np.diff(sigs[order]) != 0)))
    count = np.diff(np.concatenate((begin, [len(order)])))
    alone, first = np.sort(order[begin[count == 1]]), begin[count > 1]  # a node's rows stay together, which compresses well
    shared = np.bincount(own[order[np.repeat(count > 1, count)]], minlength=len(signed))
    has = np.flatnonzero(shared)
    told = np.concatenate([alone, order[first], order[first + 1]])
    away = mix(node[has].view(_U) + np.arange(len(has)).astype(_U))  # keys of no signature, spread over all tasks
    rows = [
        np.concatenate([sigs[told], away]).view(np.int64), np.concatenate([node[own[told]], node[has]]), np.concatenate([mark[own[told]], mark[has]]),
        np.concatenate([np.repeat([0, -1], [len(alone), 2 * len(first)]), shared[has]]).astype(np.int32),
    ]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in rows], ["sig", "node", "mark", "local"])


def signatures(docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """(sig, node, mark, local), see `_told`; mark: twice the number of signatures that a similar set shares, and one for the level above the set's own band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels, held, size = Levels(num, den), [], 0
        for new in _new_sets(batches, n):
            for node, s in new:
                for up, (sigs, need) in enumerate(levels.sign(s)):
                    held.append((node, 2 * need + up, sigs))
                    size += len(sigs)
            if size > CHUNK:
                yield _told(held)
                held, size = [], 0
        if held:
            yield _told(held)

    return _raw(docs).mapInArrow(run, "sig bigint, node bigint, mark int, local int")


def candidates(docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """(node): the sets that share as many signatures with others as a similar one would."""
    bucket = Window.partitionBy("sig")
    told = signatures(docs, n, num, den).withColumn("low", F.min("node").over(bucket)).withColumn("high", F.max("node").over(bucket))
    shares = told.select("node", "mark", F.when(F.col("local") > 0, F.col("local")).when((F.col("local") == 0) & (F.col("low") != F.col("high")), 1).otherwise(0).alias("shared")).where("shared > 0")
    return shares.groupBy("node", "mark").agg(F.sum("shared").alias("shared")).where("shared >= mark div 2").select("node").distinct()


def whole_sets(docs: DataFrame, n: int, wanted: DataFrame) -> DataFrame:
    """(node, found): the sets of the wanted nodes, once each, as bytes."""
    words = docs.sparkSession.sparkContext.broadcast(bitmap(wanted, wanted.count(), FILTER_BITS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for new in _new_sets(batches, n):
            keep = passes(words.value, np.array([node for node, _ in new], np.int64).view(_U))
            rows = [x for x, k in zip(new, keep, strict=True) if k]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows], pa.int64()), pa.array([x[1].tobytes() for x in rows], pa.binary())], ["node", "found"])

    sets = _raw(docs).mapInArrow(run, "node bigint, found binary")
    return sets.join(wanted, "node", "left_semi").groupBy("node").agg(F.first("found").alias("found"))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(elem, k): a chunk's distinct elements and in how many of its sets each is."""
    for batch in by_bytes(batches, "found", 8 * CHUNK):
        elem, k = np.unique(np.frombuffer(b"".join(batch.column("found").to_pylist()), _U), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(elem.view(np.int64)), pa.array(k)], ["elem", "k"])


def first_elements(sets: DataFrame, num: int, den: int, tables: Tables) -> DataFrame:
    """(elem, node, n, rank): of each set the elements, by their count in all sets, at which its first common one with a similar set can be. rank counts from 0."""
    common = tables.put(sets.mapInArrow(_counted, "elem bigint, k bigint").groupBy("elem").agg(F.sum("k").alias("df")).where("df > 1"))
    words = sets.sparkSession.sparkContext.broadcast(bitmap(common.select("elem"), common.count(), FILTER_BITS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "found", 8 * CHUNK):
            found = batch.column("found").to_pylist()
            elem = np.frombuffer(b"".join(found), _U)
            size = np.array([len(x) // 8 for x in found])
            keep = passes(words.value, elem)
            own = np.repeat(np.arange(len(found)), size)[keep]
            yield pa.RecordBatch.from_arrays([pa.array(elem[keep].view(np.int64)), batch.column("node").take(pa.array(own)), pa.array(size[own])], ["elem", "node", "n"])

    own = Window.partitionBy("node")
    rows = sets.mapInArrow(run, "elem bigint, node bigint, n bigint").join(common, "elem")
    # Elements that no other set has come first; the rest follows by its count.
    ranked = rows.withColumn("rank", F.col("n") - F.count("*").over(own) + F.row_number().over(own.orderBy("df", "elem")) - 1)
    return ranked.where(f"rank <= n - (({num}L * n + {den - 1}) div {den})").select("elem", "node", "n", "rank")


def _fits(num: int, den: int, a: str, b: str) -> Column:
    """Whether sets of these sizes can be similar when their first common element has these ranks (columns n and rank with these endings)."""
    na, nb, ra, rb = (F.col(f"{c}{e}") for c in ("n", "rank") for e in (a, b))
    return (den * F.least(na, nb) >= num * F.greatest(na, nb)) & ((den + num) * F.least(na - ra, nb - rb) >= num * (na + nb))


def verified(sets: DataFrame, pairs: DataFrame, num: int, den: int) -> DataFrame:
    """Of the pairs (a, b) of nodes, those whose sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("fa").to_pylist(), batch.column("fb").to_pylist(), strict=True):
                both = np.sort(np.concatenate([np.frombuffer(x, _U), np.frombuffer(y, _U)]))
                shared = int((both[1:] == both[:-1]).sum())
                keep.append(den * shared >= num * (len(both) - shared))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    with_b = pairs.join(sets.select(F.col("node").alias("b"), F.col("found").alias("fb")), "b")
    both = with_b.join(sets.select(F.col("node").alias("a"), F.col("found").alias("fa")), "a").select("a", "b", "fa", "fb")
    return both.mapInArrow(run, "a bigint, b bigint")


def _pairs(meet: DataFrame, x: str, y: str) -> DataFrame:
    return meet.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).distinct()


def links(docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """Component of each node that has a link: node, component."""
    with Tables(docs.sparkSession) as tables:
        hot = tables.put(candidates(docs, n, num, den))
        sets = tables.put(whole_sets(docs, n, hot))
        first = tables.put(first_elements(sets, num, den, tables))
        order = F.struct((F.col("rank") / F.col("n")).alias("share"), F.col("node"))
        centre = first.groupBy("elem").agg(F.min_by(F.struct("node", "n", "rank"), order).alias("c"), F.count("*").alias("k")).where("k > 1").select("elem", *(F.col(f"c.{c}").alias(f"{c}_c") for c in ("node", "n", "rank")))
        stars = first.join(centre, "elem").where(F.col("node") != F.col("node_c")).where(_fits(num, den, "", "_c"))
        tested = tables.put(_pairs(stars, "node", "node_c"))
        edges = tables.put(verified(sets, tested, num, den))
        done, reps = None, REPS
        while True:
            found = connected_components(edges)
            placed = tables.put(first.join(found, "node", "left").withColumn("component", F.coalesce("component", "node")))
            groups = placed.groupBy("elem", "component").agg(F.count("*").alias("k"), F.min("n").alias("least")).groupBy("elem").agg(F.max_by("component", F.struct("k", "component")).alias("major"), F.sum("k").alias("all"), F.max("k").alias("most"), F.min("least").alias("least")).where("all > most")
            # A set that cannot be similar to the group's smallest, nor lead a pair with a larger one, has no partner here.
            outside = placed.join(groups.select("elem", "major", "least"), "elem").where(F.col("component") != F.col("major")).where(f"{den + num} * (n - rank) >= {num} * (n + least)")
            if done is not None:
                outside = outside.join(done, ["elem", "node"], "left_anti")
            turn = outside.withColumn("at", F.row_number().over(Window.partitionBy("elem").orderBy(order)))
            turn = tables.put(turn.select("elem", "node", "n", "rank", "component", "at"))
            last = turn.agg(F.max("at")).first()[0]
            if last is None:
                return found
            now = turn.where(F.col("at") <= reps)
            x, y = (t.select("elem", *(F.col(c).alias(f"{c}_{k}") for c in ("node", "component", "n", "rank"))) for t, k in ((now, "x"), (placed, "y")))
            meet = x.join(y, "elem").where(F.col("component_x") != F.col("component_y")).where(_fits(num, den, "_x", "_y"))
            pairs = tables.put(_pairs(meet, "node_x", "node_y").join(tested, ["a", "b"], "left_anti"))
            new = tables.put(verified(sets, pairs, num, den))
            edges = edges.unionByName(new)
            if last <= reps:
                return connected_components(edges) if new.limit(1).count() else found
            tested = tested.unionByName(pairs)
            done = now.select("elem", "node") if done is None else done.unionByName(now.select("elem", "node"))
            reps *= 8


def components(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """All columns of docs but text, with n_shingles and component_id: the smallest doc_id that links reach, itself included."""
    small_batches(docs.sparkSession)
    docs = docs.drop("n_shingles", "component_id")
    node, of = spare(docs, "node"), spare(docs, "of")
    placed = durable(nodes(docs, n, node))
    found = links(docs.select("text"), n, num, den)
    own = placed.where(F.col(node).isNotNull()).groupBy(F.col(node).alias("node")).agg(F.min("doc_id").alias("least"))
    member = own.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    first = member.groupBy("component").agg(F.min("least").alias("component_id"))
    of_node = durable(member.join(first, "component").select(F.col("node").alias(of), "component_id"))
    kept = [F.col(c) for c in placed.columns if c != node]
    return placed.join(of_node, F.col(node) == F.col(of), "left").select(*kept, F.when(F.col(node).isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
