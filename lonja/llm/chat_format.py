"""Conversations as one training text each, from typed content parts.

A turn's content is a list of parts: text, image, audio, document.  A visitor turns each part into what stands in the
text, a placeholder for all but text, with the attachment it refers to and the number of tokens it will take up; the
parts of a turn, then the turns of a conversation are flattened in order.  Each turn stands as

    <|im_start|>role
    content<|im_end|>

Control strings in texts are escaped: ``<``, any number of backslashes, ``|`` gets one backslash more, so that no text
holds ``<|`` and taking one backslash off gives the text back.  In roles also line breaks (``%0A``) and ``%`` (``%25``).
Beside the text stand the places of every turn's content, which of them count for the loss (those of assistants),
the attachments with their places, and the tokens that they expand to.  ``read_back`` parses the text alone.

Only built-in functions are used.  Parts are visited and escaped row by row before the shuffle by conversation; places are
running sums over its rows, and only finished pieces are gathered.  A conversation is one record of the
output, so its rows meet in one row.  Null texts count as empty, null roles too; rows with equal turn numbers (null first) go by role,
then content; rows that repeat are turns of their own; a null ``conv_id`` is a conversation like any other; an empty
table gives no rows.  Adjoining text parts read back as one; a part of unknown or null kind gives ``<|file|>``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
#: A content part; fields that its kind does not need are null.
PART = "struct<kind: string, text: string, ref: string, width: int, height: int, seconds: double, pages: int>"
PARTS = f"array<{PART}>"
#: Pixels of an image token's side, audio tokens a second, tokens of a page.
PATCH, AUDIO_TOKENS, PAGE_TOKENS = 28, 25, 512


def escaped(text: Column) -> Column:
    # most texts hold no such string, and a search for one is cheaper than a replacement
    return F.when(F.contains(text, F.lit("|")), F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")).otherwise(text)


def unescaped(text: Column) -> Column:
    return F.when(F.contains(text, F.lit("|")), F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")).otherwise(text)


def escaped_role(role: Column) -> Column:
    return escaped(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def unescaped_role(role: Column) -> Column:
    return F.replace(F.replace(unescaped(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


class Visitor:
    """What each kind of part becomes: ``shown``, ``kind``, ``ref`` and ``tokens``; derive from it for other templates."""

    kinds = ("text", "image", "audio", "document")

    def visit(self, part: Column) -> Column:
        out = self.other(part)
        for kind in self.kinds:
            out = F.when(part["kind"] == kind, getattr(self, kind)(part)).otherwise(out)
        return out

    def made(self, shown: Column, kind: str | None, ref: Column, tokens: Column) -> Column:
        return F.struct(shown.alias("shown"), F.lit(kind).cast("string").alias("kind"), ref.cast("string").alias("ref"), tokens.cast("long").alias("tokens"))

    def text(self, part: Column) -> Column:
        return self.made(escaped(F.coalesce(part["text"], F.lit(""))), None, F.lit(None), F.lit(0))

    def image(self, part: Column) -> Column:
        side = lambda x: F.greatest(F.lit(1), F.ceil(F.coalesce(x, F.lit(0)) / PATCH))
        return self.made(F.lit("<|image|>"), "image", part["ref"], side(part["width"]) * side(part["height"]))

    def audio(self, part: Column) -> Column:
        return self.made(F.lit("<|audio|>"), "audio", part["ref"], F.greatest(F.lit(1), F.ceil(F.coalesce(part["seconds"], F.lit(0)) * AUDIO_TOKENS)))

    def document(self, part: Column) -> Column:
        return self.made(F.lit("<|document|>"), "document", part["ref"], F.greatest(F.lit(1), F.coalesce(part["pages"], F.lit(0))) * PAGE_TOKENS)

    def other(self, part: Column) -> Column:
        return self.made(F.lit("<|file|>"), "file", part["ref"], F.lit(1))


def text_parts(text: Column) -> Column:
    """A plain text as content: one text part."""
    fields = [F.lit("text").alias("kind"), text.alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("int").alias("width"),
              F.lit(None).cast("int").alias("height"), F.lit(None).cast("double").alias("seconds"), F.lit(None).cast("int").alias("pages")]
    return F.array(F.struct(*fields))


def json_parts(content: Column) -> Column:
    """Content given as a JSON array of parts."""
    return F.from_json(content, PARTS)


def flattened(rows: DataFrame, visitor: Visitor) -> DataFrame:
    """Each row's ``header``, ``body`` and attachments with their place in the body."""
    seen = F.transform(F.coalesce("parts", F.array().cast(PARTS)), visitor.visit)
    rows = rows.select("conv_id", "turn", "role", seen.alias("seen"))
    places = F.aggregate("seen", F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<at: long, kind: string, ref: string, tokens: long>>").alias("found")),
                         lambda acc, x: F.struct((acc["at"] + F.length(x["shown"])).alias("at"),
                                                 F.when(x["kind"].isNull(), acc["found"]).otherwise(F.concat(acc["found"], F.array(F.struct(
                                                     acc["at"].alias("at"), x["kind"].alias("kind"), x["ref"].alias("ref"), x["tokens"].alias("tokens"))))).alias("found")))["found"]
    # a turn of text alone, by far the most common, has no places to sum up
    plain = F.forall("seen", lambda x: x["kind"].isNull())
    return rows.select("conv_id", "turn", "role",
                       F.concat(F.lit(START), escaped_role(F.coalesce("role", F.lit(""))), F.lit("\n")).alias("header"),
                       F.array_join(F.transform("seen", lambda x: x["shown"]), "").alias("body"),
                       F.when(~plain, places).alias("attached"))


def format_chats(conversations: DataFrame, visitor: Visitor | None = None, loss_role: str = "assistant") -> DataFrame:
    """One row per conversation from ``conv_id, turn, role`` and ``parts`` (``PARTS``) or, without that column, ``text``.

    ``formatted``; ``turns``: start of the turn, start and length of its content in code points and whether it counts
    for the loss; ``attachments``: place in ``formatted``, kind, reference and tokens; ``expanded_tokens``: their sum.
    """
    parts = F.col("parts") if "parts" in conversations.columns else text_parts(F.col("text"))
    rows = flattened(conversations.select("conv_id", "turn", "role", parts.alias("parts")), visitor or Visitor())
    rows = rows.withColumn("piece", F.concat("header", "body", F.lit(END + "\n")))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "body", "attached")
    before = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.select("conv_id", "role", "header", "body", "piece", "attached", F.row_number().over(order).alias("i"),
                       (F.sum(F.length("piece").cast("long")).over(before) - F.length("piece")).alias("at"))
    body = F.col("at") + F.length("header")
    turn = F.struct(F.col("at").alias("start"), body.alias("body"), F.length("body").cast("long").alias("length"),
                    F.coalesce(F.col("role") == loss_role, F.lit(False)).alias("loss"))
    attached = F.transform(F.coalesce("attached", F.array().cast("array<struct<at: long, kind: string, ref: string, tokens: long>>")),
                           lambda x: F.struct((x["at"] + body).alias("at"), x["kind"].alias("kind"), x["ref"].alias("ref"), x["tokens"].alias("tokens")))
    gathered = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("i", "piece", turn.alias("turn"), attached.alias("attached")))).alias("rows"))
    attachments = F.flatten(F.transform("rows", lambda x: x["attached"]))
    return gathered.select("conv_id", F.array_join(F.transform("rows", lambda x: x["piece"]), "").alias("formatted"),
                           F.transform("rows", lambda x: x["turn"]).alias("turns"), attachments.alias("attachments"),
                           F.aggregate(attachments, F.lit(0).cast("long"), lambda acc, x: acc + x["tokens"]).alias("expanded_tokens"))


def pieces_of(formatted: Column) -> Column:
    """The turns of a formatted text, without their start marks."""
    return F.filter(F.split(formatted, r"<\|im_start\|>"), lambda x, i: i > 0)


def read_back(formatted: Column) -> Column:
    """Roles and contents (placeholders stand as they are) of a formatted text, unescaped."""
    def turn(piece: Column) -> Column:
        header = F.length(F.substring_index(piece, "\n", 1))
        return F.struct(unescaped_role(F.substr(piece, F.lit(1), header)).alias("role"),
                        unescaped(F.substr(piece, header + 2, F.length(piece) - header - 2 - len(END))).alias("text"))

    return F.transform(pieces_of(formatted), turn)


def under_loss(formatted: Column, turns: Column) -> Column:
    """The texts at the places that count for the loss, unescaped, in order."""
    cut = F.zip_with(pieces_of(formatted), turns, lambda p, t: F.when(t["loss"], unescaped(F.substr(p, (t["body"] - t["start"] - len(START) + 1).cast("int"), t["length"].cast("int")))))
    return F.filter(cut, lambda x: x.isNotNull())
