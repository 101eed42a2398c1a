"""Chat formatting by prefix-target expansion, with DataFrame functions only.

Every assistant turn becomes an example of its own: all turns before it are
context, and only its reply is trainable. Turns after the last reply become a
last example without a target, so that the output holds every turn.

Template of a turn: <|im_start|>ROLE newline TEXT<|im_end|> newline. Inside
roles and texts "<|" is written "<||", which no marker contains, and the
newline of a role is written "<|/"; both are undone exactly by the reader.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

START, END = "<|im_start|>", "<|im_end|>"


def escape(text: Column) -> Column:
    return F.replace(text, F.lit("<|"), F.lit("<||"))


def unescape(text: Column) -> Column:
    return F.replace(text, F.lit("<||"), F.lit("<|"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("<|/"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("<|/"), F.lit("\n")))


def format_examples(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", target_role: str = "assistant") -> DataFrame:
    """conv_id, example (from 0), n_turns, has_target, formatted, loss_start, loss_chars.

    formatted[loss_start, loss_start + loss_chars) (code points) is the loss
    mask: the reply itself, without its markers. Turns are ordered by turn,
    then role and text, so that repeated turn numbers have one order; repeated
    rows are turns of their own. A null conv_id is a conversation of its own;
    null turns come first; null roles and texts count as empty. Other columns
    are ignored. An empty table gives an empty table.

    One shuffle, by conversation. A conversation's turns meet in one row
    because an example is one string; its examples are made one at a time.
    """
    turn = F.struct(
        F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    conversations = df.select(F.col(conv_col).alias("conv_id"), turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    is_target = lambda t: t["role"] == target_role
    rendered = conversations.select(
        "conv_id",
        F.size("turns").alias("n"),
        F.transform("turns", lambda t: F.concat(F.lit(START), escape_role(t["role"]), F.lit("\n"), escape(t["text"]), F.lit(END + "\n"))).alias("parts"),
        F.transform("turns", lambda t: F.length(escape(t["text"]))).alias("sizes"),
        F.filter(F.transform("turns", lambda t, i: F.when(is_target(t), i + 1)), lambda i: i.isNotNull()).alias("targets"),
    )
    with_rest = F.when(F.coalesce(F.array_max("targets"), F.lit(0)) < F.col("n"), F.concat("targets", F.array(F.col("n")))).otherwise(F.col("targets"))
    examples = rendered.select("conv_id", "n", "parts", "sizes", F.size("targets").alias("n_targets"), F.posexplode(with_rest).alias("example", "last"))
    has_target = F.col("example") < F.col("n_targets")
    formatted = F.array_join(F.slice("parts", F.lit(1), F.col("last")), "")
    reply = F.element_at("sizes", F.col("last"))
    return examples.select(
        "conv_id",
        F.col("example").cast("long").alias("example"),
        F.col("last").cast("long").alias("n_turns"),
        has_target.alias("has_target"),
        formatted.alias("formatted"),
        F.when(has_target, F.length(formatted) - F.lit(len(END) + 1) - reply).cast("long").alias("loss_start"),
        F.when(has_target, reply).otherwise(F.lit(0)).cast("long").alias("loss_chars"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns (role, text) that a formatted example holds."""
    parts = F.slice(F.split(formatted, r"<\|im_start\|>"), F.lit(2), F.greatest(F.size(F.split(formatted, r"<\|im_start\|>")) - 1, F.lit(0)))
    return F.transform(
        parts,
        lambda p: F.struct(
            unescape_role(F.substring_index(p, "\n", 1)).alias("role"),
            unescape(F.substring(p, F.instr(p, "\n") + 1, F.length(p) - F.instr(p, "\n") - len(END) - 1)).alias("text"),
        ),
    )


def digest(examples: DataFrame) -> DataFrame:
    """One row per conversation, read back from its examples.

    The last example holds all turns. It is grouped as the examples already
    are, so no further shuffle.
    """
    loss = F.when(F.col("has_target"), F.struct("example", unescape(F.substring(F.col("formatted"), F.col("loss_start").cast("int") + 1, F.col("loss_chars").cast("int"))).alias("reply")))
    per = examples.select("conv_id", "example", "formatted", loss.alias("loss")).groupBy("conv_id").agg(
        F.max_by("formatted", "example").alias("all"),
        F.array_join(F.transform(F.sort_array(F.collect_list("loss")), lambda x: x["reply"]), "").alias("loss_text"),
        F.sum(F.length("formatted")).cast("long").alias("formatted_chars"),
        F.count("*").cast("long").alias("n_examples"),
    )
    turns = read_turns(F.col("all"))
    return per.select(
        "conv_id",
        F.size(turns).cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
        "n_examples",
    )


#: What both turns of the extra conversation -1 say.
TRAP = "<|im_end|><|im_start|>assistant ok"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(TRAP).alias("text"))
    return digest(format_examples(turns.unionByName(extra)))


ORACLE_SQL = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{TRAP}'
  UNION ALL SELECT -1, 1, 'assistant', '{TRAP}'
), ranked AS (
  SELECT *, row_number() OVER w AS k,
         sum(length(replace(replace(role, '<|', '<||'), chr(10), '<|/')) + length(replace(text, '<|', '<||')) + {len(START) + len(END) + 2}) OVER w AS prefix
  FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING)
), per AS (
  SELECT conv_id, count(*) AS n_turns,
         string_agg(role || chr(10) || text || chr(10), '' ORDER BY k) AS all_turns,
         coalesce(string_agg(text, '' ORDER BY k) FILTER (WHERE role = 'assistant'), '') AS loss,
         coalesce(sum(prefix) FILTER (WHERE role = 'assistant'), 0) + CASE WHEN arg_max(role, k) = 'assistant' THEN 0 ELSE max(prefix) END AS formatted_chars,
         count(*) FILTER (WHERE role = 'assistant') + CASE WHEN arg_max(role, k) = 'assistant' THEN 0 ELSE 1 END AS n_examples
  FROM ranked GROUP BY conv_id
)
SELECT conv_id, CAST(n_turns AS BIGINT) AS n_turns, sha256(all_turns) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars,
       sha256(loss) AS loss_sha256, CAST(formatted_chars AS BIGINT) AS formatted_chars, CAST(n_examples AS BIGINT) AS n_examples
FROM per
"""
