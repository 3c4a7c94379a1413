"""Chat formatting with prefix-target expansion, as DataFrame operations alone.

Template: `### <role>: <text></turn>` and a line feed a turn. Role and text are escaped so that neither a backslash of the
original nor a control string can be mistaken: `\\` -> `\\b`, `<` -> `\\l`, `#` -> `\\h`, and in a role also `:` -> `\\c`. An escaped
string thus has no `<` or `#`, and unescaping in the reverse order is exact.

Every assistant turn is an example of its own: all the turns before it are context, only the reply is trainable (`expand`). Turns
after the last reply form one more example with nothing to train on, so that the output holds the whole conversation.

Turns are rows: a window sums up where each one ends. The examples of a conversation are prefixes of one string, and writing them
out takes the square of a conversation's length, which is the method's own. That work is dealt: a conversation's examples are cut
into blocks of about BLOCK characters to write, each block gets the turns up to its last example as rows, and each is written by
its own task. So a conversation with many turns is shared by many tasks, and one of usual length is one block.

Defined results: null role or text is the empty string; null conv_id is one conversation of its own; turns that tie are ordered
by role, then text, repeated rows stay; very long texts are copied once for each example that holds them; an empty table gives
only what is passed besides; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import let

HEAD, SEP, TAIL = "### ", ": ", "</turn>\n"
CODES = [("\\", "\\b"), ("<", "\\l"), ("#", "\\h")]
ROLE_CODES = [*CODES, (":", "\\c")]
ASSISTANT = "assistant"
BLOCK = 64_000_000
TURN = ["k", "piece", "end", "end_byte", "loss_chars", "loss_bytes", "example", "last"]


def escaped(text: Column, codes=CODES) -> Column:
    for raw, code in codes:
        text = F.replace(text, F.lit(raw), F.lit(code))
    return text


def unescaped(text: Column, codes=CODES) -> Column:
    for raw, code in reversed(codes):
        text = F.replace(text, F.lit(code), F.lit(raw))
    return text


def rendered(turns: DataFrame) -> DataFrame:
    """One row a turn: conv_id, k (its place), piece (its part of the output), end and end_byte (code points and bytes up to its
    end), loss_chars and loss_bytes (of its escaped text, 0 but for replies), example (number of the example that ends here, else
    null), last, and before (code points of all examples that end before)."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = turns.select(
        "conv_id", "turn", role.alias("role"), text.alias("text"), escaped(text).alias("body"), F.concat(F.lit(HEAD), escaped(role, ROLE_CODES), F.lit(SEP)).alias("head")
    )
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    size = (F.char_length("head") + F.char_length("body") + len(TAIL)).cast("bigint")
    reply, last = F.col("role") == ASSISTANT, F.lead(F.lit(1)).over(order).isNull()
    rows = rows.select(
        "conv_id", "turn", "role", "text", (F.row_number().over(order) - 1).alias("k"), F.concat("head", "body", F.lit(TAIL)).alias("piece"), F.sum(size).over(upto).alias("end"),
        F.sum(F.octet_length("head") + F.octet_length("body") + len(TAIL)).over(upto).alias("end_byte"),
        *[F.when(reply, size_of("body")).otherwise(0).cast("bigint").alias(name) for name, size_of in (("loss_chars", F.char_length), ("loss_bytes", F.octet_length))], (reply | last).alias("ends"), last.alias("last"),
    )
    number = F.sum(F.col("ends").cast("bigint")).over(upto) - 1
    before = F.coalesce(F.sum(F.when(F.col("ends"), F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.select("conv_id", "k", "piece", "end", "end_byte", "loss_chars", "loss_bytes", F.when(F.col("ends"), number).alias("example"), "last", before.alias("before"))


def dealt(turns: DataFrame, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """The turns of conversations of one block, and those of the others once for each block that needs them, dealt by block."""
    rows = rendered(turns).withColumn("block", F.floor(F.col("before") / F.lit(block)).cast("int"))
    rows = rows.withColumn("most", F.max("block").over(Window.partitionBy("conv_id")))
    many = rows.filter("most > 0").withColumn("own", F.col("block")).withColumn("block", F.explode(F.sequence("own", "most")))
    many = many.withColumn("example", F.when(F.col("own") == F.col("block"), F.col("example")))
    return tuple(t.select("conv_id", "block", *TURN) for t in (rows.filter("most = 0"), many.repartition("conv_id", "block")))


def joined(rows: DataFrame) -> DataFrame:
    """The examples of each block: the block's turns become one string, and each example is cut from it."""
    held = rows.groupBy("conv_id", "block").agg(F.sort_array(F.collect_list(F.struct(*TURN))).alias("turns"))

    def example(whole, t):
        text = F.substring(whole, F.lit(1), t["end_byte"].cast("int")).cast("string")  # by bytes: nothing walks the string
        start = t["end"] - len(TAIL) - t["loss_chars"]
        return F.struct(t["example"].alias("example"), text.alias("text"), start.alias("loss_start"), t["loss_chars"].alias("loss_chars"), t["loss_bytes"].alias("loss_bytes"), t["last"].alias("last"))

    ends = F.filter("turns", lambda t: t["example"].isNotNull())
    whole = F.array_join(F.transform("turns", lambda t: t["piece"]), "").cast("binary")
    return held.select("conv_id", F.explode(let(whole, lambda w: F.transform(ends, lambda t: example(w, t)))).alias("s")).select("conv_id", "s.*")


def expand(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """The examples, one row each: conv_id, example (0, 1, ...), text, loss_start and loss_chars (code points from 0: what of the
    text is trainable), loss_bytes (the same in bytes), last (whether the text is the whole conversation)."""
    few, many = dealt(turns, block)
    return joined(few).unionByName(joined(many))


def parsed(formatted: Column) -> Column:
    """The turns of a formatted text: array of (role, text)."""

    def turn(part):
        body = F.substr(part, F.lit(len(HEAD) + 1))
        at = F.instr(body, SEP)
        return F.struct(unescaped(F.substr(body, F.lit(1), at - 1), ROLE_CODES).alias("role"), unescaped(F.substr(body, at + len(SEP))).alias("text"))

    parts = F.split(formatted, TAIL)
    return F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), turn)


def digests(examples: DataFrame) -> DataFrame:
    """One row a conversation, read back from its examples' texts and masks. formatted_chars: all examples together."""
    said = let(parsed(F.col("text")), lambda t: F.struct(
        F.size(t).cast("bigint").alias("n_turns"),
        F.sha2(F.array_join(F.transform(t, lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
    ))
    # what is trainable stands right before the end of its turn; by bytes, as a mask over long contexts is cut out then in no time
    start = F.octet_length("text") - len(TAIL) - F.col("loss_bytes")
    reply = F.when(F.col("loss_bytes") > 0, unescaped(F.substring(F.col("text").cast("binary"), (start + 1).cast("int"), F.col("loss_bytes").cast("int")).cast("string"))).otherwise(F.lit(""))
    rows = examples.select("conv_id", F.struct("example", reply.alias("reply")).alias("loss"), F.char_length("text").cast("bigint").alias("chars"), F.when(F.col("last"), said).alias("t"))
    out = rows.groupBy("conv_id").agg(F.max("t").alias("t"), F.sort_array(F.collect_list("loss")).alias("loss"), F.sum("chars").alias("formatted_chars"))
    loss = F.array_join(F.transform("loss", lambda x: x["reply"]), "")
    out = out.select("conv_id", "t.n_turns", "t.turns_sha256", let(loss, lambda x: F.struct(F.char_length(x).cast("bigint").alias("c"), F.sha2(x, 256).alias("h"))).alias("l"), "formatted_chars")
    return out.select("conv_id", "n_turns", "turns_sha256", F.col("l.c").alias("loss_chars"), F.col("l.h").alias("loss_sha256"), "formatted_chars")


def query(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """A conversation is of one of the two parts; those of one block need no further shuffle."""
    few, many = dealt(turns, block)
    return digests(joined(few)).unionByName(digests(joined(many)))


def with_planted(turns: DataFrame) -> DataFrame:
    """The given turns plus conversation -7, whose texts hold the template's control strings."""
    said = F.lit("\\### Assistant: </turn> ok")
    role = F.when(F.col("id") == 0, "user").otherwise(ASSISTANT)
    extra = turns.sparkSession.range(0, 2, 1, 1).select(F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), said.alias("text"))
    return turns.select("conv_id", "turn", "role", "text").unionByName(extra)


ORACLE = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
n AS (
  SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY conv_id) AS turns,
         sum(14 + length(role) + length(regexp_replace(role, '[^\\<#:]', '', 'g')) + length(text) + length(regexp_replace(text, '[^\\<#]', '', 'g'))) OVER w AS upto
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(coalesce(sum(upto) FILTER (role = 'assistant' OR k = turns), 0) AS BIGINT) AS formatted_chars
FROM n GROUP BY conv_id
"""
