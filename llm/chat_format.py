"""Chat formatting with typed content parts, in DataFrame functions only.

A turn is a role and a list of parts: text, image, audio or document.  A visitor turns
each part into what stands in the formatted text: a text into itself, escaped, any other
part into a placeholder, ``<|image|>``, ``<|audio|>`` or ``<|document|>``.  For each
placeholder, in order, an attachment keeps its kind, its reference, the turn and the
character where it stands, and the number of tokens into which it is to be expanded:

* image: one for each PATCH x PATCH square of its width and height, begun ones counted;
* audio: AUDIO_RATE for each second, the sum rounded up;
* document: PAGE_TOKENS for each page.

A turn reads ``<|im_start|>`` role ``<|im_sep|>`` content ``<|im_end|>`` and a line feed.  All control strings open with
``<|``, and inside roles and texts every ``<``, any backslashes and ``|`` get one backslash
more, so none opens there; taking one away gives the text back, whatever it was.

``turns`` works row by row.  ``conversations`` gathers the rows of a conversation in order
of turn (null first; ties by role, then content), the one exchange there is, and gives the
formatted text with the spans of characters under the loss mask: the content of each
assistant turn.  ``read`` takes roles, contents, loss text and attachments from such rows again.

Defined results.  Null roles and texts are empty; a null or empty list of parts is an empty
content; an unknown kind of part raises; missing sizes expand into no token.  Repeated rows
are turns each.  A null conv_id is a conversation of its own.  An empty table
gives an empty one.  Other columns, whatever their names, are not read.  A conversation is one row
of the result and so at most 2 GB; a digest of its whole text asks for it in one place in any case.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PATCH = 28
AUDIO_RATE = 25
PAGE_TOKENS = 768
KINDS = ("image", "audio", "document")
START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
PART = "struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def text_part(text: Column) -> Column:
    return F.struct(F.lit("text").alias("kind"), F.coalesce(text.cast("string"), F.lit("")).alias("text"), *[F.lit(None).cast(t).alias(n) for n, t in (("ref", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))])


def expanded(part: Column) -> Column:
    """The number of tokens that a part's placeholder is expanded into."""
    squares = F.ceil(part["width"] / PATCH) * F.ceil(part["height"] / PATCH)
    n = F.when(part["kind"] == "image", squares).when(part["kind"] == "audio", F.ceil(part["seconds"] * AUDIO_RATE)).when(part["kind"] == "document", part["pages"].cast("long") * PAGE_TOKENS)
    return F.coalesce(n.cast("long"), F.lit(0).cast("long"))


def visited(part: Column) -> Column:
    """What a part becomes in the formatted text."""
    text = F.when(part["kind"] == "text", escaped(F.coalesce(part["text"], F.lit(""))))
    for kind in KINDS:
        text = text.when(part["kind"] == kind, F.lit(f"<|{kind}|>"))
    return text.otherwise(F.raise_error(F.concat(F.lit("unknown kind of part: "), F.coalesce(part["kind"], F.lit("null")))).cast("string"))


def turns(rows: DataFrame, parts: str = "parts") -> DataFrame:
    """(conv_id, turn, role, segment, head, chars, attachments) for rows (conv_id, turn, role, parts).

    head is the number of characters before the content, chars that of the whole segment; an
    attachment's at is the character of the segment where its placeholder starts.
    """
    role = F.coalesce(rows["role"].cast("string"), F.lit(""))
    given = F.coalesce(rows[parts], F.array().cast(f"array<{PART}>"))
    cols = rows.select(rows["conv_id"].cast("long").alias("conv_id"), rows["turn"].cast("long").alias("turn"), role.alias("role"), given.alias("_parts"), F.concat(F.lit(START), escaped(role), F.lit(SEP)).alias("_open"))
    seen = cols.withColumn("_seen", F.transform("_parts", visited)).withColumn("head", F.length("_open").cast("long"))
    at = lambda i: F.col("head") + F.aggregate(F.slice("_seen", 1, i), F.lit(0).cast("long"), lambda n, x: n + F.length(x))
    placed = F.filter(
        F.transform("_parts", lambda p, i: F.when(p["kind"] != "text", F.struct(p["kind"].alias("kind"), p["ref"].alias("ref"), at(i).alias("at"), expanded(p).alias("tokens")))),
        lambda x: x.isNotNull(),
    )
    segment = F.concat(F.col("_open"), F.array_join("_seen", ""), F.lit(END + "\n"))
    return seen.select("conv_id", "turn", "role", segment.alias("segment"), "head", placed.alias("attachments")).select("conv_id", "turn", "role", "segment", "head", F.length("segment").cast("long").alias("chars"), "attachments")


def conversations(formatted: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """(conv_id, formatted, loss, attachments, expanded_tokens) of rows from turns.

    loss is the list of (start, chars, turn_no, head) under the mask: start counts from the start of
    formatted, head from that of the turn.  attachments is the list of (turn_no, kind, ref, at,
    tokens) in the order of the placeholders, with at counted from the start of formatted.
    """
    # dealt out first, so that the contents by which ties are ordered do not travel
    dealt = formatted.repartition("conv_id").withColumn("_said", unescaped(F.expr(f"substring(segment, cast(head + 1 as int), cast(chars - head - {len(END) + 1} as int))")))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "_said")
    before = F.coalesce(F.sum("chars").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = dealt.withColumn("_no", (F.row_number().over(order) - 1).cast("long")).withColumn("_start", before)
    masked = F.when(F.col("role") == loss_role, F.struct((F.col("_start") + F.col("head")).alias("start"), (F.col("chars") - F.col("head") - len(END) - 1).alias("chars"), F.col("_no").alias("turn_no"), "head"))
    held = F.transform("attachments", lambda x: F.struct(F.col("_no").alias("turn_no"), x["kind"].alias("kind"), x["ref"].alias("ref"), (F.col("_start") + x["at"]).alias("at"), x["tokens"].alias("tokens")))
    row = F.struct("_no", "segment", masked.alias("loss"), held.alias("attachments"))
    rows = placed.groupBy("conv_id").agg(F.array_sort(F.collect_list(row)).alias("_rows"))
    out = rows.select(
        "conv_id", F.array_join(F.transform("_rows", lambda r: r["segment"]), "").alias("formatted"),
        F.filter(F.transform("_rows", lambda r: r["loss"]), lambda x: x.isNotNull()).alias("loss"), F.flatten(F.transform("_rows", lambda r: r["attachments"])).alias("attachments"),
    )
    return out.withColumn("expanded_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda n, x: n + x["tokens"]))


def read(formatted: DataFrame) -> DataFrame:
    """The columns of formatted rows beside turns and loss_text: what their texts say.

    turns is the list of (role, content, placeholders), content unescaped and without its
    placeholders, which are listed by kind; the k-th placeholder of all turns is that of
    the k-th attachment.  loss_text is the text under the mask, without placeholders.
    """
    marks = r"<\|(?:image|audio|document)\|>"
    opening = F.lit(len(START))
    segments = formatted.withColumn("_segments", F.slice(F.split("formatted", r"<\|im_start\|>"), 2, 2**31 - 1)).withColumn("_open", F.transform("_segments", lambda s: F.split(s, r"<\|im_sep\|>", 2)))
    body = lambda s: F.substring(s[1], F.lit(1), F.length(s[1]) - len(END) - 1)
    plain = lambda x: F.array_join(F.transform(F.split(x, marks), unescaped), "")
    turn = lambda s: F.struct(unescaped(s[0]).alias("role"), plain(body(s)).alias("content"), F.regexp_extract_all(body(s), F.lit(r"<\|(image|audio|document)\|>"), F.lit(1)).alias("placeholders"))
    under = lambda x: plain(F.substring(F.get("_segments", x["turn_no"].cast("int")), (x["head"] - opening + 1).cast("int"), x["chars"].cast("int")))
    return segments.withColumn("turns", F.transform("_open", turn)).withColumn("loss_text", F.array_join(F.transform("loss", under), "")).drop("_segments", "_open")


def round_trip(rows: DataFrame) -> DataFrame:
    """Digests of conversations (conv_id, turn, role, text), each a single text part, as read back from their formatted text."""
    parts = rows.select("conv_id", "turn", "role", F.array(text_part(rows["text"])).alias("parts"))
    back = read(conversations(turns(parts)))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["content"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"), F.size("attachments").cast("long").alias("n_attachments"), "expanded_tokens",
    )


def with_control_turns(rows: DataFrame) -> DataFrame:
    """rows and a conversation -1 whose two turns say what would end a turn and open another."""
    said = rows.sparkSession.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(f"{END}{START}assistant ok").alias("text"))
    return rows.select(rows["conv_id"].cast("long").alias("conv_id"), rows["turn"].cast("long").alias("turn"), rows["role"].cast("string").alias("role"), rows["text"].cast("string").alias("text")).union(said)
