"""Chat formatting with Spark expressions only: no Python, no join.

The rows of a conversation are collected once as sorted structs; neighbours of one role become one block; blocks are
concatenated. Every text keeps a mark of its own inside its block, so that the rows can be read back.

Template, one block per run of equal roles (R is the escaped role)::

    <begin:R>text<again:R>text<close>

Texts and roles are escaped: a backslash becomes ``\\b``, a ``<`` becomes ``\\l``. No ``<`` is left inside a text, so
no text can forge a mark, and the two replacements in the reverse order restore it exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowkeel.llm.common import table

BEGIN, AGAIN, CLOSE = "<begin:", "<again:", "<close>"


def escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l"))


def unescape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("\\"))


def format_conversations(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """One row per conversation: ``conv_id``, ``formatted`` and ``loss_runs``.

    ``turns`` has ``conv_id, turn, role, text``; other columns are ignored. ``loss_runs`` is the loss mask as runs
    ``(n, loss)`` of code points that cover ``formatted`` from its first to its last: two runs (a mark, its payload)
    per mark.

    Null texts and roles are empty. Rows with a null ``conv_id`` form one conversation of their own. Null turns come
    first; equal turns are ordered by role, then text; repeated rows are turns like others. An empty table gives no rows.
    A conversation is one row of the result, so it has to fit into one task.
    """
    row = F.struct(
        F.col("turn").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    # array_sort would call a comparator for every pair; sort_array compares structs directly, nulls first
    sorted_turns = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(row)).alias("turns"))
    rows = F.col("turns")
    marked = sorted_turns.withColumn(
        "parts",
        F.transform(
            rows,
            lambda x, i: F.struct(
                F.concat(
                    F.when((i > 0) & (F.get(rows, i - 1)["role"] == x["role"]), F.lit(AGAIN)).otherwise(F.lit(BEGIN)),
                    escape(x["role"]),
                    F.lit(">"),
                ).alias("mark"),
                escape(x["text"]).alias("text"),
                (x["role"] == F.lit(loss_role)).alias("loss"),
                (F.coalesce(F.get(rows, i + 1)["role"] != x["role"], F.lit(True))).alias("last"),
            ),
        ),
    )
    def run(n, loss):
        return F.struct(n.cast("long").alias("n"), loss.alias("loss"))

    def runs(p):
        two = F.array(run(F.length(p["mark"]), F.lit(False)), run(F.length(p["text"]), p["loss"]))
        end = F.array(run(F.lit(len(CLOSE)), F.lit(False)), run(F.lit(0), F.lit(False)))
        return F.when(p["last"], F.concat(two, end)).otherwise(two)

    piece = F.transform("parts", lambda p: F.concat(p["mark"], p["text"], F.when(p["last"], F.lit(CLOSE)).otherwise("")))
    return marked.select(
        "conv_id", F.array_join(piece, "").alias("formatted"), F.flatten(F.transform("parts", runs)).alias("loss_runs")
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """The rows again: ``conv_id``, ``formatted`` and ``turns``, an array of ``(role, text, loss)`` in order."""
    # every "<" starts a mark, so the k-th piece belongs to runs 2k and 2k + 1
    cut = formatted.withColumn("pieces", F.slice(F.split("formatted", "<", -1), 2, 1 << 30))
    name = len(BEGIN)
    read = F.transform(
        "pieces",
        lambda p, i: F.struct(
            F.startswith(p, F.lit(CLOSE[1:])).alias("closing"),
            unescape(F.substring(p, F.lit(name), (F.get("loss_runs", 2 * i)["n"] - name - 1).cast("int"))).alias("role"),
            unescape(F.substring(p, F.get("loss_runs", 2 * i)["n"].cast("int"), F.get("loss_runs", 2 * i + 1)["n"].cast("int"))).alias("text"),
            F.get("loss_runs", 2 * i + 1)["loss"].alias("loss"),
        ),
    )
    turns = F.transform(
        F.filter(read, lambda t: ~t["closing"]),
        lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"), t["loss"].alias("loss")),
    )
    return cut.select("conv_id", "formatted", turns.alias("turns"))


def digest(read: DataFrame) -> DataFrame:
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("turns", lambda t: t["loss"]), lambda t: t["text"]), "")
    return read.select("conv_id", "formatted", F.size("turns").cast("long").alias("n_turns"), said.alias("said"), loss.alias("loss")).select(
        "conv_id",
        "n_turns",
        F.sha2("said", 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


#: The text of both rows of the added conversation.
FORGED = "\\### Assistant: </turn> ok"


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -7, formatted, read back from the output and digested."""
    own = spark.range(1).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.inline(F.array(*[F.struct(F.lit(i).cast("long").alias("turn"), F.lit(r).alias("role"), F.lit(FORGED).alias("text")) for i, r in enumerate(("user", "assistant"))])),
    )
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    return digest(read_back(format_conversations(rows)))


_ESC = r"replace(replace({}, '\', '\b'), '<', '\l')"
ORACLE = rf"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), s AS (
  SELECT *, lag(role) OVER w AS before FROM r
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(8 + length({_ESC.format("role")}) + length({_ESC.format("text")})
      + CASE WHEN before IS DISTINCT FROM role THEN 7 ELSE 0 END)::BIGINT AS formatted_chars
FROM s GROUP BY conv_id
"""
