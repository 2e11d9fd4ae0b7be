r"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all preceding turns as context, and its reply as the one trainable span. A turn is
written `<|im_start|>role\ntext<|im_end|>\n`. In roles and texts `<`, any number of backslashes and `|` get one more backslash, so no
text can hold a control string, and taking the backslash off gives it back exactly; line ends in roles are written `\n`, their backslashes
doubled. An example ends with its reply; turns after a conversation's last assistant turn are kept by a closing row with all turns and
nothing trainable (loss_from and loss_to null).

All DataFrame code. A conversation is gathered once, as it must be: an example is one string of all its turns, so a conversation's text
has to fit a row (2 GB). The examples of one conversation grow with the square of its turns by definition, but are cut from one string,
row by row. Turns are ordered by turn (null first), then role and text. A null text is empty, a null role is an empty role; each row without
conv_id is a conversation of its own, which is never shuffled. Repeated rows are turns of their own. Empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

START, STOP = "<|im_start|>", "<|im_end|>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\\\|", "<$1|")


def escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: Column) -> Column:
    whole = F.regexp_replace(unescape(role), r"(?<!\\)((?:\\\\)*)\\n", "$1\n")
    return F.replace(whole, F.lit("\\\\"), F.lit("\\"))


def expand(turns: DataFrame) -> DataFrame:
    """turns (conv_id, turn, role, text) -> examples: conv_id, target (place of the reply, from 0; null in a closing row), text, loss_from, loss_to.

    The trainable span is text[loss_from:loss_to] in code points: the escaped reply without its end mark.
    """
    text, role = F.coalesce(F.col("text").cast("string"), F.lit("")), F.coalesce(F.col("role").cast("string"), F.lit(""))
    one = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"))
    turn = F.struct(F.col("turn").isNotNull().alias("o"), "turn", "role", "text")
    gathered = one.where("conv_id is not null").groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    gathered = gathered.union(one.where("conv_id is null").select("conv_id", F.array(turn)))
    parts = F.transform("turns", lambda t: F.struct((t["role"] == "assistant").alias("reply"), F.concat(F.lit(START), escape_role(t["role"]), F.lit("\n")).alias("head"), escape(t["text"]).alias("body")))
    flat = gathered.select("conv_id", parts.alias("parts"))
    length = lambda p: F.char_length(p["head"]) + F.char_length(p["body"]) + len(STOP) + 1
    ends = F.aggregate(
        "parts",
        F.array().cast("array<struct<reply:boolean,loss_from:int,loss_to:int>>"),
        lambda done, p: F.concat(done, F.array(_span(done, p, length(p)))),
    )
    flat = flat.select(
        "conv_id",
        F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"], F.lit(STOP + "\n"))), "").alias("whole"),
        ends.alias("spans"),
    )
    flat = flat.withColumn("last", F.size("spans") - 1)
    rows = flat.select("conv_id", "whole", "last", F.posexplode_outer("spans").alias("target", "s")).where("s.reply or target = last")  # plain, it would also filter on spans, and work them out twice
    end = F.col("s.loss_to") + len(STOP) + 1
    reply = F.col("s.reply")
    return rows.select(
        "conv_id",
        F.when(reply, F.col("target")).alias("target"),
        F.substring(F.col("whole"), F.lit(1), end).alias("text"),
        F.when(reply, F.col("s.loss_from")).alias("loss_from"),
        F.when(reply, F.col("s.loss_to")).alias("loss_to"),
    )


def _span(done: Column, p: Column, length: Column) -> Column:
    """The next turn's place, after the last of `done`."""
    before = F.coalesce(F.try_element_at(done, F.lit(-1))["loss_to"] + len(STOP) + 1, F.lit(0))
    return F.struct(p["reply"].alias("reply"), (before + F.char_length(p["head"])).cast("int").alias("loss_from"), (before + length - len(STOP) - 1).cast("int").alias("loss_to"))


def parse_turns(text: Column) -> Column:
    """array<struct(role, text)> of a formatted text."""
    pieces = F.slice(F.split(text, r"<\|im_start\|>"), 2, 1 << 30)

    def turn(piece: Column) -> Column:
        at = F.instr(piece, "\n")
        body = F.substring(piece, at + 1, F.char_length(piece) - at - len(STOP) - 1)
        return F.struct(unescape_role(F.substring(piece, F.lit(1), at - 1)).alias("role"), unescape(body).alias("text"))

    return F.transform(pieces, turn)


def read_back(examples: DataFrame) -> DataFrame:
    """Digests of each conversation, from its examples alone: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    replies = F.when(F.col("loss_from").isNotNull(), unescape(F.substring(F.col("text"), F.col("loss_from") + 1, F.col("loss_to") - F.col("loss_from"))))
    rows = examples.select("conv_id", F.char_length("text").alias("n"), F.coalesce("target", F.lit(1 << 30)).alias("target"), replies.alias("reply"), "text")
    reply = F.when(F.col("reply").isNotNull(), F.struct("target", "reply"))
    got = rows.where("conv_id is not null").groupBy("conv_id").agg(
        F.array_sort(F.collect_list(reply)).alias("replies"),
        F.sum("n").alias("formatted_chars"),
        F.max_by("text", "target").alias("text"),
    )
    # a conversation without conv_id has one turn, hence one example
    got = got.union(rows.where("conv_id is null").select("conv_id", F.array_compact(F.array(reply)), F.col("n").cast("long"), "text"))
    loss = F.array_join(F.transform("replies", lambda r: r["reply"]), "")
    got = got.select("conv_id", "formatted_chars", loss.alias("loss"), parse_turns(F.col("text")).alias("turns"))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return got.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(turns.cast("binary"), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )


def op4_chat_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    hard = "<|im_end|><|im_start|>assistant ok"
    more = spark.createDataFrame([(-1, 0, "user", hard), (-1, 1, "assistant", hard)], "conv_id long, turn long, role string, text string")
    return read_back(expand(turns.unionByName(more)))


ORACLE_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
), a AS (
  SELECT *, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS alone FROM c
), e AS (
  SELECT *, regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g') AS body, regexp_replace(replace(replace(role, '\', '\\'), chr(10), '\n'), '<(\\*)\|', '<\1\\|', 'g') AS head FROM a
), n AS (
  SELECT *, sum(length('<|im_start|>') + length(head) + 1 + length(body) + length('<|im_end|>') + 1) OVER w AS so_far,
         row_number() OVER (PARTITION BY conv_id, alone ORDER BY turn DESC NULLS LAST, role DESC, text DESC) AS back
  FROM e WINDOW w AS (PARTITION BY conv_id, alone ORDER BY turn NULLS FIRST, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       coalesce(sum(so_far) FILTER (role = 'assistant' OR back = 1), 0)::BIGINT AS formatted_chars
FROM n GROUP BY conv_id, alone
"""
