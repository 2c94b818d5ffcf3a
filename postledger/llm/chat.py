"""Chat formatting with Spark expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# The template. Texts and roles never hold "<" or "[" once escaped, so every
# control string of this or another chat template found in a text is plain text.
OPEN, BODY, NEXT, CLOSE = "<|turn|>", "<|text|>", "<|and|>", "<|end|>"
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&lb;"))


def escape(text: Column) -> Column:
    for plain, coded in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text


def unescape(text: Column) -> Column:
    for plain, coded in reversed(ESCAPES):
        text = F.replace(text, F.lit(coded), F.lit(plain))
    return text


def format_chats(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: ``conv_id, formatted``.

    The turns of a conversation are collected as structs, sorted by turn, role and
    text, and joined to one string. Adjacent turns of one role share a header:
    ``<|turn|>role<|text|>first<|and|>second<|end|>``. Each turn looks at the one
    before it only, so the work is linear in the conversation.

    NULL text and NULL role count as empty. A NULL turn sorts first; equal turn
    numbers order by role, then text; repeated rows stay. Rows with NULL conv_id
    form one conversation. An empty table gives no conversation. One conversation
    is one output string, so its turns do meet in one task; nothing larger does.
    """
    turn = F.struct(
        F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    chats = rows.groupBy(F.col(conv_col).alias("conv_id")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    header = lambda role: F.concat(F.lit(OPEN), escape(role), F.lit(BODY))

    def piece(t: Column, i: Column) -> Column:
        before = F.get(F.col("turns"), i - 1)["role"]
        lead = (
            F.when(i == 0, header(t["role"]))
            .when(before == t["role"], F.lit(NEXT))
            .otherwise(F.concat(F.lit(CLOSE), header(t["role"])))
        )
        return F.concat(lead, escape(t["text"]))

    body = F.array_join(F.transform("turns", piece), "")
    return chats.select("conv_id", F.concat(body, F.lit(CLOSE)).alias("formatted"))


def read_chats(formatted: DataFrame, column: str = "formatted") -> DataFrame:
    """The rows with ``turns``: array of ``role, text``, read back from the string."""
    block = lambda b: F.transform(
        F.split(F.get(F.split(b, r"<\|text\|>", 2), F.lit(1)), r"<\|and\|>"),
        lambda text: F.struct(unescape(F.get(F.split(b, r"<\|text\|>", 2), F.lit(0))).alias("role"), unescape(text).alias("text")),
    )
    # Every block ends with CLOSE, so the last item of the split is empty.
    blocks = F.transform(
        F.filter(F.split(F.col(column), r"<\|end\|>"), lambda b: b != ""),
        lambda b: F.substring(b, len(OPEN) + 1, 2_147_483_647),
    )
    return formatted.withColumn("turns", F.flatten(F.transform(blocks, block)))


def chat_digests(formatted: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """Digests read back from ``conv_id, formatted``; the loss covers the texts of one role."""
    rows = read_chats(formatted)
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("turns", lambda t: t["role"] == trained_role), lambda t: t["text"]), "")
    rows = rows.select("conv_id", F.size("turns").cast("long").alias("n_turns"), told.alias("told"), loss.alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"))
    return rows.select(
        "conv_id",
        "n_turns",
        F.sha2(F.col("told").cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )
