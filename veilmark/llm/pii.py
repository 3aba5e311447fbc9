"""Personal data by candidate gradient boosting, in DataFrame functions only.

Rules find emails, IP addresses, payment cards and phone numbers (`RULES`):
leftmost matches of each kind that do not overlap, kept if their check holds.
Their patterns are written so that no text, however long or uniform, makes the
matcher retry (possessive runs, and starts only where a run starts or the last
match ended); they find what the plain patterns find.

Beyond the rules, high-recall generators (`GENERATORS`) propose spans that may
overlap each other and the rules'. Boosted trees (`pyspark.ml`) judge them by
format (length, digits, letters, separators, groups, variety) and context (the
text before, the characters around). There are no labelled spans to learn from,
so the trees learn from planted ones: `planted` writes a fixed number of short
texts (`PLANTED`), half of them with a secret, number or contact in one of the
formats of `PRIVATE`, the others with look-alikes of `PLAIN` (long words,
identifiers, paths, counts, dates), each with and without a telling word before
it. So no label is a feature, a format or a word alone decides nothing, and the
same document gets the same spans whatever table it is in. Every fourth planted
text is held out; on these the lowest threshold whose precision is `precision`
or more is calibrated for each generator (`FLOOR` rows at least, else it selects
nothing). The trees are then written as one SQL expression, so
scoring is part of the documents' scan.

Spans are (kind, start, end) in code points, end exclusive. Base spans stay;
selected ones are added unless a base span covers them. Ties in start go by kind
as listed, then by end.

Nulls: a null text is an empty one, without spans; it stays null in `redact`.
Very long texts are searched whole: offsets are summed in blocks of `BLOCK`
matches, so that many matches cost little more than few. Rows are handled one by
one, so copies, repeated rows and ids and further columns pass through; `base`
and `spans` are overwritten by `find`. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilmark.llm.common import spare

PLANTED = 6000
PRECISION, FLOOR = 0.95, 30
TREES, DEPTH = 12, 4
BLOCK = 64
SPAN = "array<struct<kind:string,rank:int,start:int,end:int>>"
_BEFORE = 24


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _is_ip(m: Column) -> Column:
    return F.forall(F.split(m, r"\."), lambda p: (F.char_length(F.regexp_replace(p, "^0+", "")) <= 3) & (F.coalesce(F.regexp_replace(p, "^0+", "").try_cast("int"), F.lit(0)) <= 255))


def luhn(digits: Column) -> Column:
    """Whether the digits' check sum is right."""
    backwards = F.reverse(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(backwards, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return total + d - F.when(d > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(1), F.char_length(digits)), F.lit(0), add) % 10 == 0


def _is_card(m: Column) -> Column:
    d = _digits(m)
    return F.when(F.char_length(d).between(12, 19), luhn(d)).otherwise(False)


#: Kind: (what a text must hold, pattern, check).
RULES: dict[str, tuple[str, str, Callable[[Column], Column]]] = {
    "email": ("@", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", lambda m: F.lit(True)),
    "ip": (r"[0-9]\.[0-9]", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", _is_ip),
    "card": ("[0-9]", r"[0-9]++(?:[ -][0-9]++)*+", _is_card),
    "phone": (r"\+[0-9]", r"\+[0-9][ ().0-9-]+[0-9]", lambda m: F.char_length(_digits(m)).between(9, 15)),
}
#: Kind: (what a text must hold, pattern). The first only saves time: whatever the pattern matches holds it.
GENERATORS: dict[str, tuple[str, str]] = {
    "secret": ("[A-Za-z0-9+/_-]{16}", r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+={0,2}"),
    "number": ("[0-9]", r"(?:\+|(?<![0-9]))[0-9(](?:[ ()./-]{0,2}[0-9]){6,}+"),
    "contact": (r"(?i)@|\(at\)|\[at\]", r"(?i)(?:\G|(?<![a-z0-9._%+-]))[a-z0-9._%+-]++ ?(?:@|\(at\)|\[at\]) ?[a-z0-9-]++(?: ?(?:\.|\(dot\)|\[dot\]) ?[a-z0-9-]++)++"),
}
FEATURES = ("length", "digits", "letters", "upper", "separators", "groups", "variety", "hex", "at", "plus", "named", "equals", "quote_before", "quote_after", "letter_before", "letter_after", "dots")
_NAMED = r"(token|key|secret|passw(?:or[dt])?|pwd|auth|mail|phone|tel|card|iban|account|ssn|id)\W*$"


def matches(text: Column, pattern: str, keep: Callable[[Column], Column], gate: str) -> Column:
    """Array of (found, start, end) of the pattern's matches that are kept: the pieces between matches give the offsets."""
    kind = "array<struct<found:string,start:int,end:int>>"
    parts = F.zip_with(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1), lambda m, gap: F.struct(m.alias("m"), F.char_length(gap).alias("gap"), F.coalesce(F.char_length(m), F.lit(0)).alias("size")))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / BLOCK).cast("int")), lambda i: F.slice(parts, i * BLOCK + 1, BLOCK))

    def step(s: Column, x: Column) -> Column:
        start = s["at"] + x["gap"]
        end = start + x["size"]
        return F.struct(end.alias("at"), F.when(x["m"].isNotNull() & keep(x["m"]), F.concat(s["out"], F.array(F.struct(x["m"].alias("found"), start.alias("start"), end.alias("end"))))).otherwise(s["out"]).alias("out"))

    def ahead(s: Column, block: Column) -> Column:
        """Adds a block with its offset."""
        size = F.aggregate(block, F.lit(0), lambda n, x: n + x["gap"] + x["size"])
        found = F.aggregate(block, F.struct(s["at"].alias("at"), F.array().cast(kind).alias("out")), step, lambda r: r["out"])
        return F.struct((s["at"] + size).alias("at"), F.when(F.size(found) > 0, F.concat(s["out"], F.array(found))).otherwise(s["out"]).alias("out"))

    found = F.flatten(F.aggregate(blocks, F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{kind}>").alias("out")), ahead, lambda s: s["out"]))
    return F.when(text.rlike(gate), found).otherwise(F.array().cast(kind))


def base_spans(text: Column) -> Column:
    """The rules' spans by start, then kind as listed."""
    return _sorted(F.concat(*(F.transform(matches(text, p, check, gate), _named(kind, rank)) for rank, (kind, (gate, p, check)) in enumerate(RULES.items()))))


def _named(kind: str, rank: int) -> Callable[[Column], Column]:
    return lambda s: F.struct(F.lit(kind).alias("kind"), F.lit(rank).alias("rank"), s["start"].alias("start"), s["end"].alias("end"))


def _sorted(spans: Column) -> Column:
    order = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))
    return F.transform(F.array_sort(order), lambda s: F.struct(s["kind"].alias("kind"), s["rank"].alias("rank"), s["start"].alias("start"), s["end"].alias("end")))


def _count(text: Column, pattern: str) -> Column:
    return F.char_length(F.regexp_replace(text, pattern, "")).cast("double")


def _features(text: Column, s: Column) -> Column:
    """What `FEATURES` names, of one proposal."""
    m = s["found"]
    before = F.substring(text, F.greatest(s["start"] - _BEFORE + 1, F.lit(1)), F.least(s["start"], F.lit(_BEFORE)))
    after = F.substring(text, s["end"] + 1, F.lit(1))
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    return F.array(
        F.char_length(m).cast("double"), _count(m, "[^0-9]"), _count(m, "[^A-Za-z]"), _count(m, "[^A-Z]"), _count(m, r"[^ ()./\-]"),
        F.size(F.split(m, r"[ ()./\-]+")).cast("double"), F.size(F.array_distinct(F.split(m, ""))) / F.greatest(F.char_length(m), F.lit(1)), flag(m.rlike("^[0-9a-f]+$")),
        flag(F.contains(m, F.lit("@"))), flag(F.startswith(m, F.lit("+"))), flag(F.lower(before).rlike(_NAMED)), flag(before.rlike(r"[=:]\W*$")), flag(before.rlike("[\"'`]$")), flag(after.rlike("[\"'`]")),
        flag(before.rlike(r"\p{L}$")), flag(after.rlike(r"\p{L}")), _count(m, r"[^.]"),
    )


def proposals(text: Column, base: Column) -> Column:
    """All generators' spans, with features f and whether a base span covers them."""
    every = []
    for rank, (kind, (gate, pattern)) in enumerate(GENERATORS.items()):
        found = matches(text, pattern, lambda m: F.lit(True), gate)
        every.append(F.transform(found, _judged(text, base, kind, len(RULES) + rank)))
    return F.concat(*every)


def _judged(text: Column, base: Column, kind: str, rank: int) -> Callable[[Column], Column]:
    def made(s: Column) -> Column:
        covered = F.exists(base, lambda b: (b["start"] <= s["start"]) & (b["end"] >= s["end"]))
        return F.struct(F.lit(kind).alias("kind"), F.lit(rank).alias("rank"), s["start"].alias("start"), s["end"].alias("end"), _features(text, s).alias("f"), covered.alias("covered"))

    return made


def _drawn(salt: str, n: int) -> Column:
    """A number from 0 to n - 1 that the row's id and the salt decide."""
    return F.pmod(F.xxhash64(F.lit(salt), F.col("id")), F.lit(n))


def _hex(salt: str) -> Column:
    """64 hexadecimal digits."""
    return F.sha2(F.concat(F.col("id").cast("string"), F.lit(salt)), 256)


def _number(salt: str, n: int) -> Column:
    """n decimal digits, the first not 0."""
    return F.substring(F.translate(F.translate(_hex(salt), "abcdef", "123456"), "0", "7"), 1, n)


def _word(salt: str, least: int, most: int) -> Column:
    """Small letters, vowels between consonants."""
    pair = F.regexp_replace(F.translate(_hex(salt), "0123456789abcdef", "bcdfghlmnprstvwz"), "(.)(.)", "$1a$2e")
    vowels = F.translate(pair, "ae", "ao") if least % 2 else F.regexp_replace(pair, "a(.)e(.)", "i$1u$2")
    return F.substring(vowels, F.lit(1), (_drawn(salt + "size", most - least + 1) + least).cast("int"))


def _base64(salt: str, n: int) -> Column:
    return F.substring(F.base64(F.unhex(_hex(salt))), 1, n)


def _formats() -> tuple[list[Column], list[Column]]:
    """What the planted texts hold: private formats, and plain look-alikes."""
    letters = F.upper(F.regexp_replace(_base64("key", 40), "[+/]", "Q"))
    private = [
        F.substring(_hex("h"), 1, 32), F.substring(_hex("h"), 1, 40), F.substring(_hex("h"), 1, 18), _hex("h"), _base64("b", 24), _base64("b", 40), F.concat(F.lit("AKIA"), F.substring(letters, 1, 16)),
        F.concat(F.lit("sk_"), F.substring(_hex("h"), 1, 24)),
        F.concat(F.lit("("), _number("a", 3), F.lit(") "), _number("b", 3), F.lit("-"), _number("c", 4)), F.concat_ws("-", _number("a", 3), _number("b", 3), _number("c", 4)), F.concat_ws("-", _number("a", 3), _number("b", 2), _number("c", 4)),
        *(F.concat(_word("n", 3, 9), F.lit(at), _word("m", 4, 10), F.lit(dot), F.element_at(F.array(*map(F.lit, ("org", "com", "net"))), (_drawn("end", 3) + 1).cast("int"))) for at, dot in ((" (at) ", " (dot) "), ("[at]", "[dot]"), ("(at)", "."), (" @ ", "."))),
    ]
    plain = [
        _word("w", 16, 30), _word("v", 17, 24), F.upper(_word("w", 16, 24)), F.concat(F.lit("ö"), _word("v", 16, 24)), F.concat_ws(" ", _number("a", 16), _number("b", 16)), F.initcap(_word("w", 16, 22)), F.concat_ws("_", _word("p", 4, 9), _word("q", 5, 8), _word("r", 4, 8)), F.concat_ws("-", _word("p", 6, 9), _word("q", 5, 8), _word("r", 4, 8)),
        F.concat_ws("/", _word("p", 3, 6), _word("q", 5, 8), _word("r", 6, 12)), F.concat(_word("p", 5, 9), F.initcap(_word("q", 5, 8)), F.initcap(_word("r", 5, 8))), F.concat(_word("w", 16, 20), _number("a", 1)),
        F.repeat(F.lit("="), 3), F.concat(_word("w", 16, 22), F.lit("-"), _number("a", 2)), F.repeat(F.lit("-"), 24), F.repeat(F.lit("_"), 18),
        _number("a", 7), _number("a", 8), _number("a", 10), _number("a", 13), _number("a", 16), F.concat_ws("-", F.lit("2019"), F.lpad((_drawn("month", 12) + 1).cast("string"), 2, "0"), F.lpad((_drawn("day", 28) + 1).cast("string"), 2, "0")),
        F.concat_ws("/", F.lpad((_drawn("day", 28) + 1).cast("string"), 2, "0"), F.lpad((_drawn("month", 12) + 1).cast("string"), 2, "0"), F.lit("2021")), F.concat_ws(".", _number("a", 3), _number("b", 4), _number("c", 3)), F.concat_ws(" ", _number("a", 1), _number("b", 2), _number("c", 1), _number("d", 2), _number("e", 3)),
        F.concat(F.lit("sold (at) "), _number("a", 1), F.lit(".5 each")), F.concat(_word("n", 3, 9), F.lit(" @ "), _number("a", 1), F.lit(" . "), _number("b", 1)),
    ]
    return private, plain


#: Words before a planted span; after the first few it need not be told what it is.
TELLING = ('token = "', 'secret="', "password=", 'api_key: "')
LEADS = ("", "", "", "the ", "id ", "phone ", "mail: ", "was ", "=", *TELLING)


def planted(spark: SparkSession, rows: int = PLANTED) -> DataFrame:
    """id, text, start, end, y: short texts with a private span (y = 1) or a plain one, the same whenever they are made. Every tenth has letters at random, a secret if a word tells so."""
    private, plain = _formats()
    pick = lambda every, salt: F.element_at(F.array(*every), (_drawn(salt, len(every)) + 1).cast("int"))
    said = lambda words, salt: pick([F.lit(w) for w in words], salt)
    y = (F.col("id") % 2).cast("int")
    letters = F.col("id") % 10 >= 8
    span = F.when(letters, F.translate(F.substring(_hex("x"), F.lit(1), (_drawn("letters", 14) + 17).cast("int")), "0123456789abcdef", "bcdfghjklmnpqrst")).when(y == 1, pick(private, "private")).otherwise(pick(plain, "plain"))
    lead = F.when(letters, F.when(y == 1, said(TELLING, "lead")).otherwise(said(LEADS[:4], "lead"))).otherwise(said(LEADS, "lead"))
    before = F.concat(_word("before", 2, 9), F.lit(" "), lead)
    after = F.concat(F.when(lead.endswith('"'), '"').otherwise(""), said([" ", " ", ". ", ", "], "close"), _word("after", 2, 9))
    made = spark.range(rows).select("id", y.alias("y"), before.alias("before"), span.alias("span"), after.alias("after"))
    start = F.char_length("before")
    return made.select("id", "y", F.concat("before", "span", "after").alias("text"), start.alias("start"), (start + F.char_length("span")).alias("end"))


class Trees:
    """Boosted trees as an expression, and a threshold for each generator."""

    def __init__(self, trees: list[tuple[float, dict]], thresholds: dict[str, float]):
        self.trees, self.thresholds = trees, thresholds

    def probability(self, f: Column) -> Column:
        def value(node: dict) -> Column:
            if "value" in node:
                return F.lit(node["value"])
            return F.when(f[node["feature"]] <= node["at"], value(node["low"])).otherwise(value(node["high"]))

        margin = sum((value(t) * w for w, t in self.trees), F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(margin * -2.0))

    def selects(self, c: Column) -> Column:
        least = F.lit(2.0)
        for kind, t in self.thresholds.items():
            least = F.when(c["kind"] == kind, t).otherwise(least)
        return self.probability(c["f"]) >= least


def _tree(node) -> dict:
    if node.getClass().getSimpleName() == "LeafNode":
        return {"value": float(node.prediction())}
    return {"feature": int(node.split().featureIndex()), "at": float(node.split().threshold()), "low": _tree(node.leftChild()), "high": _tree(node.rightChild())}


def fit(spark: SparkSession, rows: int = PLANTED, precision: float = PRECISION) -> Trees:
    """Trees for the planted texts' proposals, and the generators' thresholds."""
    text = F.col("text")
    seen = planted(spark, rows).withColumn("base", base_spans(text)).select("*", F.explode(proposals(text, F.col("base"))).alias("c"))
    whole = (F.col("c.start") <= F.col("start")) & (F.col("c.end") >= F.col("end"))  # not a few digits of a longer span
    # A planted number of rows, whatever the tables: one partition keeps the trees the same.
    seen = seen.where("not c.covered").select("id", F.when(whole, F.col("y")).otherwise(0).alias("y"), "c.kind", "c.start", "c.f").coalesce(1).sortWithinPartitions("id", "kind", "start").cache()
    apart = F.pmod(F.xxhash64(F.lit("apart"), F.col("id")), F.lit(4)) == 0
    model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=7).fit(seen.where(~apart).select(array_to_vector("f").alias("features"), F.col("y").cast("double").alias("label")))
    trees = Trees([(float(w), _tree(t._call_java("rootNode"))) for w, t in zip(model.treeWeights, model.trees, strict=True)], {})
    bins = seen.where(apart).select("kind", F.floor(trees.probability(F.col("f")) * 50).alias("bin"), "y").groupBy("kind", "bin").agg(F.sum("y").alias("right"), F.count("*").alias("n")).collect()
    seen.unpersist()
    for kind in GENERATORS:
        mine = sorted((b for b in bins if b["kind"] == kind), key=lambda b: -b["bin"])
        right = n = 0
        for b in mine if sum(b["n"] for b in mine) >= FLOOR else []:
            right, n = right + b["right"], n + b["n"]
            if right >= precision * n and b["right"]:
                trees.thresholds[kind] = b["bin"] / 50
    return trees


def find(docs: DataFrame, trees: Trees | None) -> DataFrame:
    """docs with `base` and `spans`: all spans, by start, then kind as listed, generators' kinds last."""
    text = F.coalesce("text", F.lit(""))
    out = docs.withColumn("base", F.when(F.col("text").rlike("[0-9@]"), base_spans(text)).otherwise(F.array().cast(SPAN)))
    if trees is None or not trees.thresholds:
        return out.withColumn("spans", F.col("base"))
    added = F.transform(F.filter(proposals(text, F.col("base")), lambda c: ~c["covered"] & trees.selects(c)), lambda c: F.struct(c["kind"].alias("kind"), c["rank"].alias("rank"), c["start"].alias("start"), c["end"].alias("end")))
    return out.withColumn("spans", _sorted(F.concat("base", added)))


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, trees: Trees | None) -> DataFrame:
    """docs, each span of text (overlapping ones as one) replaced by its first kind in capitals, in brackets."""
    text, spans = F.col("text"), spare(docs, "spans_")
    begun = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        gap = F.substring(text, s["at"] + 1, F.greatest(x["start"] - s["at"], F.lit(0)))
        piece = F.concat(gap, F.lit("["), F.upper(x["kind"]), F.lit("]"))
        return F.struct(F.greatest(s["at"], x["end"]).alias("at"), F.when(x["start"] >= s["at"], F.concat(s["out"], F.array(piece))).otherwise(s["out"]).alias("out"))

    whole = F.aggregate(spans, begun, step, lambda s: F.concat(F.array_join(s["out"], ""), F.substring(text, s["at"] + 1, F.char_length(text))))
    # find() overwrites columns; only its spans are taken.
    found = find(docs.select("*", F.struct(*docs.columns).alias(spans)), trees).select(F.col(spans).alias("own"), F.col("spans").alias(spans))
    return found.select("own.*", spans).withColumn("text", F.when(F.size(spans) > 0, whole).otherwise(text)).select(*docs.columns)
