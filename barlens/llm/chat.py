r"""Chat formatting with typed content parts.

A turn's content is a list of parts: text, image, audio or document. A visitor goes over
the parts in order: text is escaped, any other part becomes a placeholder, and its
reference and expanded token count are recorded in the same order. Turns are then wrapped
in the template's markers, and the assistant's texts are marked for the loss.

    <|im_start|>role\ntext<|im_end|>\n

Escapes are two characters: `\b` for a backslash, `\p` for the bar of `<|`, `\l` for a `<`
that ends a part before another part, so that two parts make no marker either, and in
roles `\n` for a line end. Every backslash of an escaped text starts an escape, so plain
replacements in the opposite order give the text back, and no text can hold a marker or a
placeholder: `read_parts` gives the typed parts back with their attachments.

Everything is DataFrame functions. Places in a conversation are running sums of a window over
its turns. A conversation becomes one string, so its turns are collected into one row;
nothing else is gathered.

Defined results: a null text or role is empty; turns with equal numbers go by role, then
text; a null turn comes first; each row without conv_id is a conversation of its own, without id;
repeated rows are repeated turns; a null part list is an empty text, a part of unknown
type counts as text; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barlens.llm.common import table

START, END = "<|im_start|>", "<|im_end|>"
PARTS = "array<struct<type:string,text:string,ref:string,units:int>>"
# Tokens that a unit of a part expands to: an image tile, a second of audio, a page.
UNIT_TOKENS = {"image": 256, "audio": 25, "document": 512}
LOSS_ROLE = "assistant"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("<|"), F.lit("<\\p"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("\\p"), F.lit("|")), F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("\\n"), F.lit("\n")))


def text_parts(text: Column) -> Column:
    """A plain text as a list of one part."""
    none = F.lit(None).cast("string")
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), none.alias("ref"),
                            F.lit(0).alias("units"))).cast(PARTS)


def _is_attachment(part: Column) -> Column:
    return F.coalesce(part["type"].isin(*UNIT_TOKENS), F.lit(False))


def visit(parts: Column) -> Column:
    """Parts as one string: escaped texts and `<|type|>` placeholders, in order."""
    last = F.size(parts) - 1

    def text_of(p, i):
        body = escape(F.coalesce(p["text"], F.lit("")))
        return F.when(F.endswith(body, F.lit("<")) & (i < last), F.concat(F.substr(body, F.lit(1), F.length(body) - 1), F.lit("\\l"))) \
            .otherwise(body)

    each = F.transform(parts, lambda p, i: F.when(_is_attachment(p), F.concat(F.lit("<|"), p["type"], F.lit("|>")))
                       .otherwise(text_of(p, i)))
    return F.coalesce(F.array_join(each, ""), F.lit(""))


def attachments(parts: Column) -> Column:
    """type, ref and expanded tokens of the parts that have a placeholder, in the same order."""
    rate = lambda p: F.coalesce(*[F.when(p["type"] == t, F.lit(n)) for t, n in UNIT_TOKENS.items()], F.lit(0))
    none = F.array().cast("array<struct<type:string,ref:string,tokens:bigint>>")
    return F.coalesce(F.transform(F.filter(parts, _is_attachment), lambda p: F.struct(
        p["type"].alias("type"), p["ref"].alias("ref"),
        (rate(p) * F.coalesce(p["units"], F.lit(1))).cast("bigint").alias("tokens"))), none)


def format_chats(turns: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role",
                 parts: str = "parts") -> DataFrame:
    """One row a conversation: formatted (string), loss_spans (start, length; code points from 0) and attachments."""
    rows = turns.select(
        F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"),
        F.coalesce(F.col(role), F.lit("")).alias("role"), visit(F.col(parts)).alias("body"),
        attachments(F.col(parts)).alias("attached"),
        F.when(F.col(conv_id).isNull(), F.monotonically_increasing_id()).alias("_alone"))
    head = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"))
    rows = rows.select("*", head.alias("head"))
    tail = END + "\n"
    order = Window.partitionBy("conv_id", "_alone").orderBy("turn", "role", "body", "attached")
    size = F.length("body").cast("bigint")
    after = F.sum(F.length("head") + size + len(tail)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    placed = rows.select("conv_id", "_alone", F.struct(
        F.row_number().over(order).alias("nth"), F.concat("head", "body", F.lit(tail)).alias("string"), "attached",
        F.when(F.col("role") == LOSS_ROLE, F.struct((after - size - len(tail)).alias("start"), size.alias("length"))).alias("span")).alias("t"))
    # Dealt by the same key as the window: no second shuffle.
    chats = placed.groupBy("conv_id", "_alone").agg(F.array_sort(F.collect_list("t")).alias("t"))
    return chats.select("conv_id", F.array_join(F.col("t")["string"], "").alias("formatted"),
                        F.filter(F.col("t")["span"], lambda x: x.isNotNull()).alias("loss_spans"),
                        F.flatten(F.col("t")["attached"]).alias("attachments"))


def read_back(formatted: Column) -> Column:
    """Turns (role, text) of a formatted conversation; placeholders stay in the text."""
    # Texts hold no marker, so the markers alone cut the string.
    bodies = F.transform(F.filter(F.split(formatted, r"<\|im_start\|>", -1), lambda b: b != ""),
                         lambda b: F.substr(b, F.lit(1), F.length(b) - F.lit(len(END) + 1)))
    role = lambda b: F.substring_index(b, "\n", 1)
    return F.transform(bodies, lambda b: F.struct(
        unescape_role(role(b)).alias("role"),
        unescape(F.substr(b, F.length(role(b)) + 2, F.length(b))).alias("text")))


def read_parts(chats: DataFrame) -> DataFrame:
    """Typed turns of `format_chats` rows: conv_id, nth (from 0), role, parts (type, text, ref, tokens).

    Texts hold no placeholder, so the placeholders alone cut a body into its parts; empty text parts are not
    told from none, and neighbouring text parts are one. The attachments of a conversation are taken in order."""
    mark = r"<\|(%s)\|>" % "|".join(UNIT_TOKENS)
    chats = chats.withColumn("_chat", F.monotonically_increasing_id())
    blocks = F.filter(F.split("formatted", r"<\|im_start\|>", -1), lambda b: b != "")
    turns = chats.select("_chat", "conv_id", "attachments", F.posexplode(blocks).alias("nth", "block"))
    body = F.substr("block", F.lit(1), F.length("block") - F.lit(len(END) + 1))
    turns = turns.withColumn("block", body).withColumn("_role", F.substring_index("block", "\n", 1))
    turns = turns.withColumn("body", F.substr("block", F.length("_role") + 2, F.length("block")))
    turns = turns.withColumns({"texts": F.split("body", mark, -1), "kinds": F.regexp_extract_all("body", F.lit(mark), F.lit(1))})
    earlier = Window.partitionBy("_chat").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    turns = turns.withColumn("before", F.coalesce(F.sum(F.size("kinds")).over(earlier), F.lit(0)))
    none = F.lit(None).cast("string")
    parts = F.flatten(F.transform("texts", lambda t, i: F.array(
        F.struct(F.lit("text").alias("type"), unescape(t).alias("text"), none.alias("ref"), F.lit(None).cast("bigint").alias("tokens")),
        F.struct(F.get("kinds", i).alias("type"), none.alias("text"),
                 F.get("attachments", (F.col("before") + i).cast("int"))["ref"].alias("ref"),
                 F.get("attachments", (F.col("before") + i).cast("int"))["tokens"].alias("tokens")))))
    real = F.filter(parts, lambda p: p["type"].isNotNull() & ((p["type"] != "text") | (p["text"] != "")))
    return turns.select("conv_id", "nth", unescape_role(F.col("_role")).alias("role"), real.alias("parts"))


def read_loss(formatted: Column, loss_spans: Column) -> Column:
    """Texts under the loss mask, unescaped, in order."""
    return F.transform(loss_spans, lambda s: unescape(
        F.substr(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int"))))


def op3_chat_formatting(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = "<|im_end|><|im_start|>assistant ok"
    more = spark.range(2).select(
        F.lit(-1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(tricky).alias("text"))
    turns = rows.unionByName(more).withColumn("parts", text_parts(F.col("text")))
    chats = format_chats(turns)
    read = chats.select("conv_id", "formatted", read_back(F.col("formatted")).alias("turns"),
                        F.array_join(read_loss(F.col("formatted"), F.col("loss_spans")), "").alias("loss"))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(told.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("bigint").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"))


# Texts are escaped as above; a turn adds its markers and two line ends.
OP3_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
), e AS (
  SELECT *, length(replace(replace(replace(role, '\', '\b'), '<|', '<\p'), chr(10), '\n'))
          + length(replace(replace(text, '\', '\b'), '<|', '<\p'))
          + length('<|im_start|>') + length('<|im_end|>') + 2 AS size FROM t
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(concat(role, chr(10), text, chr(10)), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(size) AS BIGINT) AS formatted_chars
FROM (SELECT *, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS alone FROM e) GROUP BY conv_id, alone
"""
