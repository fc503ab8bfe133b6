r"""Chat formatting: one training string per conversation, with a loss mask.

Everything here is a Spark expression. A conversation is collected as one sorted
array of (turn, role, text); runs of one role are merged into one block each, by array
functions over slices of it; the blocks are concatenated. Template, control strings in angle brackets:

    <|turn|>ROLE<|text|>TEXT<|next|>TEXT ...<|end|>

``<|next|>`` parts the texts of one merged block. Inside roles and texts ``\``
becomes ``\b`` and each control string a code of ``\`` and one letter, so that a
control string in the output is always one of the template's, and the escape can
be undone: no code's letter is ``\``, hence a code never straddles two others.

Defined cases: a null text or role is empty; a null turn sorts first; equal turns
sort by role, then text, and repeated rows are kept each; a null conv_id is a
conversation of its own; an empty table gives an empty result; columns besides
conv_id, turn, role and text are ignored. A conversation has to fit in one row,
since the output is one string.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The template's control strings and the codes that stand for them in texts.
TURN, TEXT, NEXT, END = "<|turn|>", "<|text|>", "<|next|>", "<|end|>"
CODES = ((TURN, "\\t"), (TEXT, "\\x"), (NEXT, "\\n"), (END, "\\e"))

#: The byte order mark that a decoder takes away, so that one which begins a text stays.
MARK = "0000FEFF"
#: Lengths that are summed in one group.
GROUP = 256


def escape(text: Column) -> Column:
    """Text without control strings; ``unescape`` gives back the same text."""
    out = F.replace(text, F.lit("\\"), F.lit("\\b"))
    for control, code in CODES:
        out = F.replace(out, F.lit(control), F.lit(code))
    return out


def unescape(text: Column) -> Column:
    out = text
    for control, code in CODES:
        out = F.replace(out, F.lit(code), F.lit(control))
    return F.replace(out, F.lit("\\b"), F.lit("\\"))


def format_chats(conversations: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_runs): the string and its loss mask.

    ``loss_runs`` lists (n_chars, loss) in order, n_chars in code points of
    ``formatted``; the n_chars sum to its length. Under loss are exactly the
    escaped texts of role ``assistant``.
    """
    turn = F.struct(F.col("turn").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    chats = conversations.select("conv_id", turn.alias("t")).groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))

    at = F.sequence(F.lit(1), F.size("turns"))
    firsts = F.filter(at, lambda i: (i == 1) | (F.get("turns", i - 2)["role"] != F.get("turns", i - 1)["role"]))

    def block(first: Column, k: Column) -> Column:
        """One run of turns of a role: what stands before each text, and the text."""
        own = F.slice("turns", first, F.coalesce(F.get("firsts", k + 1), F.size("turns") + 1) - first)
        start = F.concat(F.when(k > 0, F.lit(END)).otherwise(F.lit("")), F.lit(TURN), escape(own[0]["role"]), F.lit(TEXT))
        return F.transform(own, lambda t, j: F.struct(F.when(j > 0, F.lit(NEXT)).otherwise(start).alias("head"), escape(t["text"]).alias("body"), (t["role"] == "assistant").alias("loss")))

    blocks = chats.withColumn("firsts", firsts).select("conv_id", F.transform("firsts", block).alias("blocks"))
    merged = F.transform("blocks", lambda b: F.array_join(F.transform(b, lambda p: F.concat(p["head"], p["body"])), ""))
    runs = F.flatten(F.transform(F.flatten("blocks"), lambda p: F.array(
        F.struct(F.length(p["head"]).alias("n_chars"), F.lit(False).alias("loss")),
        F.struct(F.length(p["body"]).alias("n_chars"), p["loss"].alias("loss")),
    )))
    return blocks.select(
        "conv_id",
        F.concat(F.array_join(merged, ""), F.lit(END)).alias("formatted"),
        F.concat(runs, F.array(F.struct(F.lit(len(END)).alias("n_chars"), F.lit(False).alias("loss")))).alias("loss_runs"),
    )


def starts(lengths: Column) -> Column:
    """For each of an array of lengths the sum of those before it; sums run within groups, then over groups."""
    none = F.array().cast("array<long>")

    def before(xs: Column) -> Column:
        """As ``starts``, and the sum of all as last element."""
        return F.aggregate(xs, F.array(F.lit(0).cast("long")), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))

    groups = F.when(F.size(lengths) > 0, F.transform(F.sequence(F.lit(1), F.size(lengths), F.lit(GROUP)), lambda i: before(F.slice(lengths, i, F.lit(GROUP)))))

    def joined(g: Column) -> Column:
        totals = before(F.transform(g, lambda x: F.element_at(x, -1)))
        return F.flatten(F.zip_with(g, F.slice(totals, F.lit(1), F.size(g)), lambda xs, first: F.transform(F.slice(xs, F.lit(1), F.size(xs) - 1), lambda x: x + first)))

    return F.coalesce(F.transform(F.array(groups), joined)[0], none)


def loss_texts(formatted: DataFrame) -> DataFrame:
    """``formatted`` with ``loss``: the runs under the loss mask, cut from the string and unescaped, in order."""
    placed = formatted.withColumn("_starts", starts(F.transform("loss_runs", lambda r: r["n_chars"].cast("long"))))
    runs = F.filter(F.zip_with("loss_runs", "_starts", lambda r, s: F.struct(r["loss"].alias("loss"), r["n_chars"].alias("n"), s.alias("at"))), lambda r: r["loss"])

    def cut(code: Column) -> Column:  # four bytes a code point, so that a run is found without a search from the start
        return F.transform(runs, lambda r: unescape(F.decode(F.concat(F.unhex(F.lit(MARK)), F.substring(code, (r["at"] * 4 + 1).cast("int"), r["n"] * 4)), "UTF-32")))

    return placed.withColumn("loss", F.transform(F.array(F.encode("formatted", "UTF-32")), cut)[0]).drop("_starts")


def parse_chats(formatted: DataFrame) -> DataFrame:
    """``formatted`` with ``turns``, the (role, text) array read back from the string."""
    blocks = F.slice(F.split("formatted", r"<\|end\|>", -1), 1, F.size(F.split("formatted", r"<\|end\|>", -1)) - 1)

    def block(b: Column) -> Column:
        role = unescape(F.substring_index(F.substring(b, len(TURN) + 1, 2**31 - 1), TEXT, 1))
        texts = F.split(F.split(b, r"<\|text\|>", 2)[1], r"<\|next\|>", -1)
        return F.transform(texts, lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    return formatted.withColumn("turns", F.flatten(F.transform(blocks, block)))


def digests(parsed: DataFrame) -> DataFrame:
    """Counts and hashes of what was read back, one row per conversation: turns by the template, loss by the mask."""
    per_turn = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss", "")
    return loss_texts(parsed).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(per_turn, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
