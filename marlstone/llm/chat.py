"""Chat formatting: typed content parts become one string with a loss mask.

Each turn is a list of typed parts.  A visitor over the parts flattens text,
image, audio and document parts into text with placeholders in order, and
records what each placeholder stands for and how many tokens it expands to.
Turns are marked by control strings; the same strings inside texts are escaped
and can be read back.  Places come from a running sum over the sorted turns, so
cost is linear in the length of a conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from marlstone.llm.common import sha256_hex, table

START, END = "<|im_start|>", "<|im_end|>"
PLACEHOLDERS = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}

PART = T.StructType([
    T.StructField("type", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("ref", T.StringType()),
    T.StructField("width", T.IntegerType()),
    T.StructField("height", T.IntegerType()),
    T.StructField("seconds", T.DoubleType()),
    T.StructField("pages", T.IntegerType()),
])


def escape(text: Column) -> Column:
    """``<`` + n backslashes + ``|`` gets one more backslash, so no control string is left."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    """The inverse of :func:`escape`."""
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def _role_out(role: Column) -> Column:
    plain = F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A"))
    return escape(plain)


def _role_in(role: Column) -> Column:
    plain = unescape(role)
    return F.replace(F.replace(plain, F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def text_part(text: Column) -> Column:
    """One text part; null text is an empty one."""
    fields = {"type": F.lit("text"), "text": F.coalesce(text, F.lit(""))}
    return F.array(F.struct(*[fields.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in PART]))


def _body(p: Column) -> Column:
    kind = p.getField("type")
    out = escape(F.coalesce(p.getField("text"), F.lit("")))
    for name, mark in PLACEHOLDERS.items():
        out = F.when(kind == name, F.lit(mark)).otherwise(out)
    return out


def _tokens(p: Column, patch: int, audio_rate: int, page_tokens: int) -> Column:
    n = lambda c: F.coalesce(p.getField(c), F.lit(0))
    return (
        F.when(p.getField("type") == "image", F.ceil(n("width") / patch) * F.ceil(n("height") / patch))
        .when(p.getField("type") == "audio", F.ceil(n("seconds") * audio_rate))
        .otherwise(n("pages") * page_tokens)
        .cast("long")
    )


def format_chat(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", parts_col: str | None = None, loss_role: str = "assistant", patch: int = 28, audio_rate: int = 25, page_tokens: int = 512) -> DataFrame:
    """One row per conversation: ``conv_col, formatted, turns, attachments``.

    ``formatted`` is every turn as ``<|im_start|>role\\nbody<|im_end|>\\n``.
    ``turns`` is an array of (start, end, loss_start, loss_end): code-point
    places of each turn in ``formatted`` and of its body if its role is under
    the loss mask, else null.  ``attachments`` is an array of (turn, kind, ref,
    tokens) in the order of the placeholders.

    With ``parts_col`` (an array of :data:`PART`) the content is that; a null
    array is an empty body, and a part of unknown type is text.  Else the
    content is ``text_col``.  Null text and null role are empty strings.  Turns
    are ordered by ``turn_col`` (nulls first); ties and repeated rows by role,
    then body, and all of them stay.  Rows whose conversation is null make one
    conversation.  Other columns are ignored.  No rows, no conversations.
    """
    parts = F.coalesce(F.col(parts_col), F.array().cast(T.ArrayType(PART))) if parts_col else text_part(F.col(text_col))
    df = turns.select(
        F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col), F.lit("")).alias("role"), parts.alias("parts"),
    )
    body = F.array_join(F.transform("parts", _body), "")
    known = F.filter("parts", lambda p: p.getField("type").isin(*PLACEHOLDERS))
    df = df.select(
        "conv", "turn", "role", body.alias("body"), _role_out(F.col("role")).alias("head"),
        F.transform(known, lambda p: F.struct(p.getField("type").alias("kind"), p.getField("ref").alias("ref"), _tokens(p, patch, audio_rate, page_tokens).alias("tokens"))).alias("found"),
    ).withColumn("piece", F.concat(F.lit(START), "head", F.lit("\n"), "body", F.lit(END + "\n")))
    order = Window.partitionBy("conv").orderBy("turn", "role", "body")
    df = df.withColumns({"no": F.row_number().over(order), "end": F.sum(F.length("piece")).over(order.rowsBetween(Window.unboundedPreceding, 0))})
    start = F.col("end") - F.length("piece")
    first = start + len(START) + F.length("head") + 1
    under = F.col("role") == loss_role
    turn = F.struct(
        "no", "piece", start.alias("start"), "end",
        F.when(under, first).alias("loss_start"), F.when(under, first + F.length("body")).alias("loss_end"), "found",
    )
    grouped = df.groupBy("conv").agg(F.array_sort(F.collect_list(turn)).alias("all"))
    return grouped.select(
        F.col("conv").alias(conv_col),
        F.array_join(F.col("all.piece"), "").alias("formatted"),
        F.transform("all", lambda t: F.struct(*[t.getField(c).alias(c) for c in ("start", "end", "loss_start", "loss_end")])).alias("turns"),
        F.flatten(F.transform("all", lambda t: F.transform(t.getField("found"), lambda a: F.struct(
            t.getField("no").alias("turn"), a.getField("kind").alias("kind"), a.getField("ref").alias("ref"), a.getField("tokens").alias("tokens"))))).alias("attachments"),
    )


def read_chat(formatted: DataFrame) -> DataFrame:
    """Add ``read``: an array of (role, text, loss), parsed from the output alone.

    ``loss`` is the unescaped text that the mask covers in that turn, or null.
    """
    df = formatted.withColumn("__c_all", F.split("formatted", r"<\|im_end\|>\n", -1))
    pieces = F.slice("__c_all", 1, F.size("__c_all") - 1)

    def read(piece: Column, t: Column) -> Column:
        head = F.substring_index(piece, "\n", 1)
        body = F.substring(piece, F.length(head) + 2, F.length(piece))
        masked = F.substring(piece, (t.getField("loss_start") - t.getField("start") + 1).cast("int"), (t.getField("loss_end") - t.getField("loss_start")).cast("int"))
        return F.struct(
            _role_in(F.substring(head, len(START) + 1, F.length(head))).alias("role"),
            unescape(body).alias("text"),
            F.when(t.getField("loss_start").isNotNull(), unescape(masked)).alias("loss"),
        )

    return df.withColumn("read", F.zip_with(pieces, F.col("turns"), read)).drop("__c_all")


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``conversations`` and one with control strings, formatted and read back."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = f"{END}{START}assistant ok"
    extra = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(hard).alias("text"),
    )
    out = read_chat(format_chat(rows.unionByName(extra)))
    said = F.array_join(F.transform("read", lambda t: F.concat(t.getField("role"), F.lit("\n"), t.getField("text"), F.lit("\n"))), "")
    out = out.select("conv_id", F.size("read").cast("long").alias("n_turns"), said.alias("said"), F.array_join(F.col("read.loss"), "").alias("loss"), "formatted")
    return out.select(
        "conv_id", "n_turns", sha256_hex(F.col("said")).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), sha256_hex(F.col("loss")).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


ORACLE = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(24 + length(role) + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g'))) AS BIGINT) AS formatted_chars
FROM rows GROUP BY conv_id
"""
