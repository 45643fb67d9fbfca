"""Chat formatting: typed content parts become one string per conversation, with a loss mask and attachment references.

A turn reads ``<|turn|>role\\nbody<|end|>\\n``. The body is the turn's content parts in order: text is escaped, an
image, audio clip or document becomes a placeholder ``<|kind n|>`` that numbers the conversation's attachments. In
texts, roles and kinds ``&``, ``<`` and ``[`` are escaped, so no control string of this or another template survives
there, and `read_back` restores them exactly; in kinds ``|`` is escaped as well, so none ends its placeholder early.

Defined cases: a null text or role counts as empty; a part of null kind is text; one of a kind not in PER_TOKEN is an
attachment of no tokens; turns sort by turn (null last), then role, then body; rows that
repeat are repeated turns; very long texts are formatted whole, and a conversation is one string; a null conv_id is a conversation of its own; no rows give no rows; other columns are ignored.
Only built-in functions run here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

TURN, END = "<|turn|>", "<|end|>\n"
#: In this order to escape, in reverse to restore.
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&#91;"))
#: Escaped besides in a kind, and in a role.
BAR, LINE = ("|", "&#124;"), ("\n", "&#10;")
#: Amount of an attachment that one token stands for: pixels, milliseconds, characters.
PER_TOKEN = {"image": 784, "audio": 40, "document": 4}


def escape(text: Column) -> Column:
    for plain, safe in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(safe))
    return text


def unescape(text: Column) -> Column:
    for plain, safe in (BAR, LINE, *reversed(ESCAPES)):
        text = F.replace(text, F.lit(safe), F.lit(plain))
    return text


def text_parts(text: Column) -> Column:
    """The content of a turn that holds just a text."""
    return F.array(F.struct(F.lit("text").alias("kind"), text.alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("long").alias("amount")))


def format_chat(turns: DataFrame) -> DataFrame:
    """turns: conv_id, turn, role, parts array<struct<kind, text, ref, amount>>. Returns a row per conversation:
    conv_id, formatted, loss_spans (start and end of assistant bodies in code points), attachments (kind, ref, tokens),
    expanded_tokens (that the attachments' placeholders stand for)."""

    def tokens(p: Column) -> Column:
        each = F.coalesce(*(F.when(p["kind"] == k, F.ceil(F.greatest(p["amount"], F.lit(0)) / n)) for k, n in PER_TOKEN.items()), F.lit(0))
        return each.cast("long")

    is_text = lambda p: F.coalesce(p["kind"], F.lit("text")) == "text"
    role = F.coalesce("role", F.lit(""))
    rows = turns.select(
        "conv_id", "turn", role.alias("role"), F.coalesce("parts", F.array().cast(turns.schema["parts"].dataType)).alias("parts"),
    ).withColumn("files", F.filter("parts", lambda p: ~is_text(p)))
    order = W.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_last(), "role", F.transform("parts", lambda p: F.coalesce(p["text"], p["ref"], F.lit(""))))
    before = order.rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("i", F.row_number().over(order)).withColumn("n_before", F.coalesce(F.sum(F.size("files")).over(before), F.lit(0)))
    # a placeholder's number: those of the turns before, and those of this turn up to here
    body = F.transform("parts", lambda p, k: F.when(is_text(p), escape(F.coalesce(p["text"], F.lit("")))).otherwise(F.concat(F.lit("<|"), F.replace(escape(p["kind"]), *map(F.lit, BAR)), F.lit(" "), (F.col("n_before") + F.size(F.filter(F.slice("parts", F.lit(1), k + 1), lambda q: ~is_text(q)))).cast("string"), F.lit("|>"))))
    head = F.concat(F.lit(TURN), F.replace(escape(F.col("role")), *map(F.lit, LINE)), F.lit("\n"))
    rows = rows.select("conv_id", "i", "role", "files", head.alias("head"), F.concat_ws("", body).alias("body"))
    rows = rows.withColumn("start", F.coalesce(F.sum(F.length("head") + F.length("body") + len(END)).over(W.partitionBy("conv_id").orderBy("i").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) + F.length("head"))
    got = rows.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("i", F.concat("head", "body", F.lit(END)).alias("piece"), (F.col("role") == "assistant").alias("loss"), "start", (F.col("start") + F.length("body")).alias("end"), "files"))).alias("t"),
    )
    return got.select(
        "conv_id",
        F.concat_ws("", F.col("t.piece")).alias("formatted"),
        F.transform(F.filter("t", lambda x: x["loss"]), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))).alias("loss_spans"),
        F.transform(F.flatten("t.files"), lambda p: F.struct(p["kind"].alias("kind"), p["ref"].alias("ref"), tokens(p).alias("tokens"))).alias("attachments"),
    ).withColumn("expanded_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda a, x: a + x["tokens"]))


def read_back(formatted: Column) -> Column:
    """The turns of a formatted conversation: array<struct<role, text>>, placeholders as they stand."""
    pieces = F.slice(F.split(formatted, r"<\|turn\|>"), 2, 2_147_483_646)

    def turn(p: Column) -> Column:
        at = F.locate("\n", p)
        role = unescape(F.substring(p, F.lit(1), at - 1))
        text = unescape(F.substring(p, at + 1, F.length(p) - at - len(END)))
        return F.struct(role.alias("role"), text.alias("text"))

    return F.transform(pieces, turn)


def under_mask(formatted: Column, loss_spans: Column) -> Column:
    """All text under the loss mask, restored, in order, nothing between."""
    return unescape(F.concat_ws("", F.transform(loss_spans, lambda s: F.substring(formatted, s["start"] + 1, s["end"] - s["start"]))))
