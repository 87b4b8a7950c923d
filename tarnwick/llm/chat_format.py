"""Chat formatting: conversations of typed content parts as one marked-up text each with a loss mask, and the way back."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: One part of a turn's content. Text parts use `text`; the others `ref` and what their size is measured by.
PART = "struct<kind string, text string, ref string, width int, height int, seconds double, pages int>"
CLOSE = "</turn>\n"
_NAMES = "/?(?:turn|part|image|audio|document)"
_MARK = r"<(?:part|(?:image|audio|document) [0-9]+)>"


def text_content(text: Column) -> Column:
    """A content of one text part; null text is empty."""
    return F.array(_part(F.lit("text"), F.coalesce(text, F.lit(""))))


def _part(kind: Column, text: Column) -> Column:
    empty = {"ref": "string", "width": "int", "height": "int", "seconds": "double", "pages": "int"}
    return F.struct(kind.alias("kind"), text.alias("text"), *[F.lit(None).cast(t).alias(c) for c, t in empty.items()])


def escaped(text: Column) -> Column:
    """Each control string of the template gets one more backslash behind its `<`; other text stays as it is."""
    return F.regexp_replace(text, rf"<(\\*+)({_NAMES})", r"<\\$1$2")


def unescaped(text: Column) -> Column:
    """The inverse of escaped()."""
    return F.regexp_replace(text, rf"<\\(\\*+)({_NAMES})", "<$1$2")


def _kind(part: Column) -> Column:
    """text (also for null), image, audio; any other kind is a document."""
    kind = F.coalesce(part["kind"], F.lit("text"))
    return F.when(kind.isin("text", "image", "audio"), kind).otherwise(F.lit("document"))


def flattened(content: Column) -> Column:
    """Visits the parts in order: texts are escaped, with <part> between neighbouring ones, others become `<kind n>`, n being the part's place."""

    def visit(part: Column, i: Column) -> Column:
        after_text = (i > 0) & (_kind(F.get(content, i - 1)) == "text")
        text = F.concat(F.when(after_text, F.lit("<part>")).otherwise(F.lit("")), escaped(F.coalesce(part["text"], F.lit(""))))
        return F.when(_kind(part) == "text", text).otherwise(F.concat(F.lit("<"), _kind(part), F.lit(" "), (i + 1).cast("string"), F.lit(">")))

    return F.array_join(F.transform(content, visit), "")


def attachments(content: Column, patch: int = 14, per_second: float = 25.0, per_page: int = 600) -> Column:
    """(part, kind, ref, tokens) of each part but texts: what its placeholder expands to.

    An image costs a token for each begun patch, audio per_second tokens a second (rounded up), a document per_page a page;
    unknown sizes cost none.
    """

    def visit(part: Column, i: Column) -> Column:
        tiles = F.ceil(part["width"] / patch) * F.ceil(part["height"] / patch)
        tokens = F.when(_kind(part) == "image", tiles).when(_kind(part) == "audio", F.ceil(part["seconds"] * per_second)).otherwise(part["pages"].cast("long") * per_page)
        return F.struct((i + 1).alias("part"), _kind(part).alias("kind"), part["ref"].alias("ref"), F.coalesce(tokens, F.lit(0)).cast("long").alias("tokens"))

    return F.filter(F.transform(content, visit), lambda x: x["kind"] != "text")


def format_chats(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", content: str = "content", loss_roles: Sequence[str] = ("assistant",), **sizes: float) -> DataFrame:
    """(conv, formatted, spans, attached, attached_tokens) for each conversation of df, whose content is an array of PART.

    A turn is `<turn role>`, a line feed, its flattened parts and `</turn>` with a line feed; roles are URL-encoded. spans holds
    (start, stop, loss) of each turn's body in code points of the formatted text: the loss mask is the spans whose loss is true, those of loss_roles.
    attached lists (turn, part, kind, ref, tokens) in order, with the turn's number from 1; sizes goes to attachments().

    Turns are ordered by `turn` (nulls first), ties by role and flattened text; repeated rows are repeated turns. A null role is empty, null
    content has no parts, a null conversation id is one conversation. An empty table gives an empty result. Columns other
    than the four are not looked at. A conversation is one value of Spark, so its formatted text must stay below 2 GB.
    """
    body = F.coalesce(flattened(F.col("content_")), F.lit(""))
    rows = df.select(F.col(conv).alias("conv_"), F.col(turn).alias("turn_"), F.coalesce(F.col(role), F.lit("")).alias("role_"), F.col(content).alias("content_"))
    rows = rows.select("conv_", "turn_", "role_", body.alias("body_"), F.coalesce(attachments(F.col("content_"), **sizes), F.array()).alias("attached_"))
    rows = rows.withColumn("head_", F.concat(F.lit("<turn "), F.url_encode("role_"), F.lit(">\n")))
    order = Window.partitionBy("conv_").orderBy(F.asc_nulls_first("turn_"), "role_", "body_")
    length = F.char_length("head_") + F.char_length("body_") + len(CLOSE)
    stop = F.sum(length.cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)) - len(CLOSE)
    rows = rows.withColumns({"no_": F.row_number().over(order), "stop_": stop}).withColumn("start_", F.col("stop_") - F.char_length("body_"))
    one = F.struct(
        F.col("no_").alias("no"), F.concat("head_", "body_").alias("piece"), F.col("start_").alias("start"), F.col("stop_").alias("stop"),
        F.col("role_").isin(*loss_roles).alias("loss"), F.col("attached_").alias("attached"),
    )
    turns = rows.groupBy("conv_").agg(F.sort_array(F.collect_list(one)).alias("turns_"))
    listed = F.flatten(F.transform("turns_", lambda t: F.transform(t["attached"], lambda a: F.struct(t["no"].alias("turn"), *[a[c].alias(c) for c in ("part", "kind", "ref", "tokens")]))))
    return turns.select(
        F.col("conv_").alias(conv),
        F.concat(F.array_join(F.transform("turns_", lambda t: t["piece"]), CLOSE), F.lit(CLOSE)).alias("formatted"),
        F.transform("turns_", lambda t: F.struct(t["start"].alias("start"), t["stop"].alias("stop"), t["loss"].alias("loss"))).alias("spans"),
        listed.alias("attached"),
    ).withColumn("attached_tokens", F.aggregate("attached", F.lit(0).cast("long"), lambda n, a: n + a["tokens"]))


def text_of(body: Column) -> Column:
    """The texts of a body, unescaped each by itself and joined, without placeholders."""
    return F.array_join(F.transform(F.split(body, _MARK, -1), unescaped), "")


def read_chats(df: DataFrame) -> DataFrame:
    """df of format_chats() with `turns` (role, text, marks) as found in its formatted text alone, and `trained`, the text under the loss mask.

    A body can't hold the closing mark, so splitting there finds the turns. Spans are taken from the piece that they lie in,
    which begins where the one before closed, so that the text is passed over once.
    """
    pieces = F.split("formatted", CLOSE, -1)
    df = df.withColumn("pieces_", F.slice(pieces, F.lit(1), F.size(pieces) - 1))

    def turn(piece: Column) -> Column:
        head = F.substring_index(piece, "\n", 1)
        body = F.substring(piece, F.char_length(head) + 2, F.char_length(piece))
        name = F.url_decode(F.substring(head, F.lit(7), F.char_length(head) - 7))
        return F.struct(name.alias("role"), text_of(body).alias("text"), F.regexp_extract_all(body, F.lit(_MARK), F.lit(0)).alias("marks"))

    def masked(piece: Column, i: Column) -> Column:
        span = F.get("spans", i)
        begins = F.when(i == 0, F.lit(0)).otherwise(F.get("spans", i - 1)["stop"] + len(CLOSE))
        own = F.substring(piece, (span["start"] - begins + 1).cast("int"), (span["stop"] - span["start"]).cast("int"))
        return F.when(span["loss"], text_of(own)).otherwise(F.lit(""))

    return df.withColumns({"turns": F.transform("pieces_", turn), "trained": F.array_join(F.transform("pieces_", masked), "")}).drop("pieces_")
