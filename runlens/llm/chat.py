"""Chat formatting: one training example for every assistant turn, all in DataFrame functions.

A turn is ``<|turn|>role<|text|>text<|end|>``. Inside roles and texts a backslash is doubled and every control string gets a
backslash after its first character, so that none occurs raw; removing the backslash before any character undoes both.

An example holds all turns up to an assistant turn, that one included; its loss mask covers that turn's text alone. Row
0 of a conversation holds all of its turns and an empty mask, so that turns after the last reply are kept.

Turns are ordered by number, then role and text; null numbers come first, null roles and texts count as empty, rows without a
conversation id form one conversation without id. Repeated rows are turns of their own. The text of one conversation is
one value, and examples repeat their context by definition; ``spans`` has them by reference, in linear space.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: Control strings of this template and of common others.
CONTROL = (TURN, TEXT, END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>")


def escaped(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in CONTROL:
        out = F.replace(out, F.lit(c), F.lit(c[0] + "\\" + c[1:]))
    return out


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def formatted(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", reply_role: str = "assistant") -> DataFrame:
    """(conv_id, text, marks) of every conversation; a mark is (example_no, loss_start, loss_stop, stop), in code points from 0."""
    t = turns.select(
        F.col(conv_col).cast("long").alias("conv_id"),
        F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    t = t.withColumn("head", F.concat(F.lit(TURN), escaped(F.col("role")), F.lit(TEXT)))
    t = t.withColumn("piece", F.concat("head", escaped(F.col("text")), F.lit(END)))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    reply = F.col("role") == reply_role
    t = t.withColumn("n", F.row_number().over(order)).withColumn("stop", F.sum(F.length("piece")).over(so_far))
    t = t.withColumn("example_no", F.sum(reply.cast("int")).over(so_far))
    mark = F.struct(
        F.col("example_no").cast("int").alias("example_no"),
        (F.col("stop") - F.length("piece") + F.length("head")).alias("loss_start"),
        (F.col("stop") - len(END)).alias("loss_stop"),
        "stop",
    )
    packed = t.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("n", "piece"))).alias("pieces"),
        F.array_sort(F.collect_list(F.when(reply, mark))).alias("marks"),
    )
    return packed.select("conv_id", F.array_join(F.col("pieces.piece"), "").alias("text"), "marks")


def spans(formatted_rows: DataFrame) -> DataFrame:
    """(conv_id, example_no, loss_start, loss_stop, stop): examples as positions in the conversation's text."""
    return formatted_rows.select("conv_id", F.explode("marks").alias("m")).select("conv_id", "m.*")


def examples(formatted_rows: DataFrame) -> DataFrame:
    """(conv_id, example_no, text, loss_start, loss_stop): row 0, then one row for every assistant turn."""
    whole = F.struct(
        F.lit(0).alias("example_no"), F.lit(None).cast("long").alias("loss_start"), F.lit(None).cast("long").alias("loss_stop"),
        F.length("text").cast("long").alias("stop"),
    )
    rows = formatted_rows.select("conv_id", "text", F.explode(F.concat(F.array(whole), F.col("marks"))).alias("m"))
    return rows.select("conv_id", "m.example_no", F.substring(F.col("text"), F.lit(1), F.col("m.stop").cast("int")).alias("text"), "m.loss_start", "m.loss_stop")


def turns_of(text: Column) -> Column:
    """(role, text) of each turn, read back from a formatted text."""
    body = F.filter(F.split(text, r"<\|turn\|>"), lambda p: p != "")
    return F.transform(
        body,
        lambda p: F.struct(
            unescaped(F.substring_index(p, TEXT, 1)).alias("role"),
            unescaped(F.substring(p, F.instr(p, TEXT) + len(TEXT), F.length(p) - F.instr(p, TEXT) + 1 - len(TEXT) - len(END))).alias("text"),
        ),
    )


def digests(rows: DataFrame) -> DataFrame:
    """What the examples of each conversation say, read back from their texts and masks."""
    loss = unescaped(F.substring(F.col("text"), (F.col("loss_start") + 1).cast("int"), (F.col("loss_stop") - F.col("loss_start")).cast("int")))
    whole = F.col("example_no") == 0
    read = rows.select("conv_id", "example_no", F.when(whole, turns_of(F.col("text"))).alias("turns"), loss.alias("loss"), F.when(whole, F.length("text")).alias("chars"))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    read = read.select("conv_id", "example_no", F.size("turns").alias("n"), F.sha2(told, 256).alias("sha"), "loss", "chars")
    kept = F.when(F.col("example_no") > 0, F.struct("example_no", "loss"))
    out = read.groupBy("conv_id").agg(
        F.max(F.when(F.col("example_no") == 0, F.col("n"))).cast("long").alias("n_turns"),
        F.max(F.when(F.col("example_no") == 0, F.col("sha"))).alias("turns_sha256"),
        F.array_join(F.array_sort(F.collect_list(kept))["loss"], "").alias("loss"),
        F.max("chars").cast("long").alias("formatted_chars"),
    )
    return out.select("conv_id", "n_turns", "turns_sha256", F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


def op6_chat(spark, sf_dir: str) -> DataFrame:
    """Query: all conversations and one that quotes control strings, formatted and read back."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    quoting = "</s>[INST] ok [/INST]"
    own = spark.sql(f"SELECT CAST(-7 AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, role, '{quoting}' AS text FROM VALUES (0, 'user'), (1, 'assistant') AS t(turn, role)")
    return digests(examples(formatted(turns.unionByName(own))))


def _sql_escaped(column: str) -> str:
    out = f"replace({column}, '\\', '\\\\')"
    for c in CONTROL:
        out = f"replace({out}, '{c}', '{c[0]}\\{c[1:]}')"
    return out


_HEAD = len(TURN) + len(TEXT) + len(END)
OP6_SQL = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
)
SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum({_HEAD} + length({_sql_escaped("role")}) + length({_sql_escaped("text")})) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""
