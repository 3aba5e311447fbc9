r"""Chat formatting with typed content parts, in DataFrame functions only.

A turn's content is an array of parts (`PART`): text, image, audio, document.
A visitor flattens the parts in order: text is escaped and kept, any other part
becomes a placeholder `<|kind:n|>`, n counting the conversation's attachments
from 0, and is recorded as (n, kind, ref, tokens). `tokens` is what the
placeholder expands to: an image's tiles of `TILE` pixels times `PER_TILE` and
one more tile, an audio's seconds times `PER_SECOND` rounded up, a document's
pages times `PER_PAGE`; unknown sizes count as one tile, second or page.

A turn is written as `<|turn|>role<|says|>content<|done|>`. Escaping is
reversible: in roles, kinds and texts `\` becomes `\b` and `<` becomes `\l`, so
that none of them, nor several in a row, can hold a marker, whatever control
strings of this or other templates they say. The loss mask covers the
assistants' contents, as spans of code points of the formatted text, markers
excluded.

`read_back` parses a formatted text into turns again and unescapes them.

A plain text is a content of one text part and takes the same way through the
visitor. A conversation is one value of its format, so its turns meet in one row,
in order of turn (ties: by role, then content, unescaped; repeated rows are
repeated turns). Positions are summed by blocks, so that long conversations and
contents cost little more than short ones. Nulls: a null text or role is an
empty one, a null content has no parts, a null conv_id is a conversation of its
own. Very long texts pass whole. Tables without rows give none. Other columns
are not carried, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilmark.llm.common import running

TILE, PER_TILE, PER_SECOND, PER_PAGE = 512, 170, 25, 800
TURN, SAYS, DONE = "<|turn|>", "<|says|>", "<|done|>"
PART = "struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
ATTACHMENT = "struct<n:int,kind:string,ref:string,tokens:bigint>"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("\\"))


def text_part(text: Column) -> Column:
    """One text part."""
    none = F.lit(None)
    return F.array(F.struct(F.lit("text").alias("kind"), F.coalesce(text, F.lit("")).alias("text"), none.cast("string").alias("ref"), none.cast("int").alias("width"), none.cast("int").alias("height"), none.cast("double").alias("seconds"), none.cast("int").alias("pages")))


def expanded(part: Column) -> Column:
    """Tokens that an attachment's placeholder stands for."""
    tiles = F.ceil(F.coalesce(part["width"], F.lit(TILE)) / F.lit(TILE)) * F.ceil(F.coalesce(part["height"], F.lit(TILE)) / F.lit(TILE))
    return (
        F.when(part["kind"] == "image", (tiles + 1) * PER_TILE)
        .when(part["kind"] == "audio", F.ceil(F.coalesce(part["seconds"], F.lit(1.0)) * PER_SECOND))
        .when(part["kind"] == "document", F.coalesce(part["pages"], F.lit(1)) * PER_PAGE)
        .otherwise(0).cast("bigint")
    )


def placeholder(kind: Column, n: Column) -> Column:
    return F.concat(F.lit("<|"), escape(kind), F.lit(":"), n.cast("string"), F.lit("|>"))


def _is_text(part: Column) -> Column:
    return F.coalesce(part["kind"], F.lit("text")) == "text"


def visit(content: Column, offset: Column) -> Column:
    """Struct of `flat`, the content as one escaped string, and `attachments`, counted from offset."""
    at = F.filter(F.transform(content, lambda p, i: F.when(~_is_text(p), i)), lambda i: i.isNotNull())
    flat = F.transform(content, lambda p, i: F.when(_is_text(p), escape(F.coalesce(p["text"], F.lit("")))).otherwise(placeholder(p["kind"], (offset + F.array_position(at, i) - 1).cast("int"))))
    noted = F.transform(F.filter(content, lambda p: ~_is_text(p)), lambda p, i: F.struct((offset + i).cast("int").alias("n"), p["kind"].alias("kind"), p["ref"].alias("ref"), expanded(p).alias("tokens")))
    return F.struct(F.array_join(flat, "").alias("flat"), noted.cast(f"array<{ATTACHMENT}>").alias("attachments"))


def format_conversations(turns: DataFrame) -> DataFrame:
    """turns: conv_id, turn, role, and content (array of parts) or text. Returns conv_id, formatted, loss (spans), attachments, n_expanded."""
    content = F.coalesce("content", F.array().cast(f"array<{PART}>")) if "content" in turns.columns else text_part(F.col("text"))
    rows = turns.select("conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), content.cast(f"array<{PART}>").alias("content")).alias("row"))
    rows = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("row")).alias("rows"))
    counts = F.transform("rows", lambda r: F.size(F.filter(r["content"], lambda p: ~_is_text(p))))
    seen = F.zip_with("rows", running(counts), lambda r, offset: F.struct(escape(r["role"]).alias("role"), visit(r["content"], offset).alias("v")))
    rows = rows.select("conv_id", seen.alias("seen"))
    lead = len(TURN) + len(SAYS)
    starts = running(F.transform("seen", lambda r: F.char_length(r["role"]) + F.char_length(r["v"]["flat"]) + lead + len(DONE)))

    def span(r: Column, at: Column) -> Column:
        first = at + lead + F.char_length(r["role"])
        return F.when(r["role"] == "assistant", F.struct(first.alias("start"), (first + F.char_length(r["v"]["flat"])).alias("end")))

    written = F.transform("seen", lambda r: F.concat(F.lit(TURN), r["role"], F.lit(SAYS), r["v"]["flat"], F.lit(DONE)))
    attachments = F.flatten(F.transform("seen", lambda r: r["v"]["attachments"]))
    return rows.select("conv_id", F.array_join(written, "").alias("formatted"), F.filter(F.zip_with("seen", starts, span), lambda s: s.isNotNull()).alias("loss"), attachments.alias("attachments")).withColumn("n_expanded", F.aggregate("attachments", F.lit(0).cast("bigint"), lambda s, a: s + a["tokens"]))


def _blocks() -> Column:
    """The formatted text, turn by turn, without the turns' opening marker."""
    return F.filter(F.split("formatted", r"<\|turn\|>", -1), lambda b: b != "")


def read_back(formatted: DataFrame) -> DataFrame:
    """formatted with `turns` (array of role and text), parsed from the formatted text alone; placeholders stay in the texts."""
    pair = F.transform(_blocks(), lambda b: F.split(F.substring(b, F.lit(1), F.char_length(b) - len(DONE)), r"<\|says\|>", 2))
    return formatted.withColumn("turns", F.transform(pair, lambda p: F.struct(unescape(p[0]).alias("role"), unescape(p[1]).alias("text"))))


def masked(formatted: DataFrame) -> DataFrame:
    """formatted with `loss_texts`: what stands under the loss mask, unescaped, span by span."""
    sized = formatted.withColumns({"blocks": _blocks()}).withColumn("starts", running(F.transform("blocks", lambda b: F.char_length(b) + len(TURN))))

    def cut(block: Column, start: Column) -> Column:
        first = start + len(TURN)  # code point of the block's start
        inside = F.filter("loss", lambda s: (s["start"] >= first) & (s["end"] <= first + F.char_length(block)))
        return F.transform(inside, lambda s: unescape(F.substring(block, (s["start"] - first + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))

    return sized.withColumn("loss_texts", F.flatten(F.zip_with("blocks", "starts", cut))).drop("blocks", "starts")
