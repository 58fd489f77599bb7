r"""Operator 10: chat formatting of reply trees.

Messages form trees by (tree, node, parent). Ancestor jumps of 1, 2, 4, ... steps come
from iterative self-joins; with them the chosen leaves are joined to all nodes above them,
so that a path of n turns takes about log2(n) joins. Leaves are ranked per tree by the sum
of the scores on their path, then by length, then by node; the first ``branches`` paths of
a tree are formatted, each as one conversation.

Format: every turn is ``<turn ROLE>\nTEXT\n</turn>\n``. In texts and roles a backslash
becomes ``\\`` and ``<`` becomes ``\<``, so no control string can arise from a text, and
the change can be undone. The loss mask is a list of spans (code points, end exclusive) of
the texts of turns of the role ``assistant``.

Defined results: a null text or role is empty; a null score counts 0; a node whose parent
is null or is no node of its tree is a root; repeated rows of a conversation table are
turns of their own, in the order of turn, role and text, nulls first; in ``messages`` node
ids must be distinct within a tree, and cycles are reported as an error; a null tree id is
a tree; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from encore.llm.common import table, written

ASSISTANT = "assistant"
MAX_DOUBLINGS = 40
TURN = re.compile(r"<turn ((?:[^\\<>\n]++|\\.)*+)>\n((?:[^\\<]++|\\.)*+)</turn>\n", re.S)
ESCAPED = re.compile(r"\\(.)", re.S)


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<", "\\<")


def escape_role(role: str) -> str:
    return escape(role).replace(">", "\\>").replace("\n", "\\n")


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1", text)


def unescape_role(role: str) -> str:
    return ESCAPED.sub(lambda m: "\n" if m[1] == "n" else m[1], role)


def format_turns(turns: list[tuple[str, str]]) -> tuple[str, list[int], list[int]]:
    """The formatted text, and the starts and ends of its loss spans."""
    parts, starts, ends, at = [], [], [], 0
    for role, text in turns:
        head, body = f"<turn {escape_role(role)}>\n", escape(text)
        if role == ASSISTANT:
            starts.append(at + len(head))
            ends.append(at + len(head) + len(body))
        parts += (head, body, "\n</turn>\n")
        at += len(head) + len(body) + 9
    return "".join(parts), starts, ends


def parse_turns(formatted: str) -> list[tuple[str, str]]:
    turns, at = [], 0
    while at < len(formatted):
        m = TURN.match(formatted, at)
        if not m or not m[2].endswith("\n"):
            raise ValueError(f"no turn at {at}")
        turns.append((unescape_role(m[1]), unescape(m[2][:-1])))
        at = m.end()
    return turns


def chain(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Linear conversations as trees: each row replies to the row before it."""
    order = Window.partitionBy("tree").orderBy(F.col("_turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    rows = conversations.select(F.col(conv).alias("tree"), F.col(turn).alias("_turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    rows = rows.withColumn("node", F.row_number().over(order).cast("long"))
    return rows.select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def paths(messages: DataFrame, branches: int = 1) -> DataFrame:
    """tree, leaf, rank, distance and node of every node on the chosen root-to-leaf paths."""
    links = messages.select("tree", "node", "parent", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    known = links.select(F.col("tree").alias("_t"), F.col("node").alias("_n"))
    same_tree = F.col("tree").eqNullSafe(F.col("_t"))
    # A jump over 2^i steps: where it leads (null: past the root), the steps to there or to
    # past the root, and the scores on them. Only nodes whose jump stays in the tree are
    # joined again, so that a few deep trees don't make all others go round with them.
    first = links.join(known, same_tree & (F.col("parent") == F.col("_n")), "left")
    last = written(first.select("tree", "node", F.col("_n").alias("to"), F.lit(1).cast("long").alias("steps"), F.col("score").alias("sum")))
    total, jumps = last.where("to IS NULL"), [last.where("to IS NOT NULL")]
    while jumps[-1].limit(1).count():
        if len(jumps) > MAX_DOUBLINGS:
            raise ValueError("the reply links hold a cycle")
        there = total.unionByName(jumps[-1]).select(F.col("tree").alias("_t"), F.col("node").alias("_n"), F.col("to").alias("_to"), F.col("steps").alias("_steps"), F.col("sum").alias("_sum"))
        last = written(
            jumps[-1].join(there, same_tree & (F.col("to") == F.col("_n"))).select("tree", "node", F.col("_to").alias("to"), (F.col("steps") + F.col("_steps")).alias("steps"), (F.col("sum") + F.col("_sum")).alias("sum"))
        )
        total = total.unionByName(last.where("to IS NULL"))
        jumps.append(last.where("to IS NOT NULL"))
    jumps.pop()
    parents = links.where("parent IS NOT NULL").select(F.col("tree").alias("_t"), F.col("parent").alias("_n")).distinct()
    leaves = total.join(parents, same_tree & (F.col("node") == F.col("_n")), "left_anti")
    best = Window.partitionBy("tree").orderBy(F.desc("sum"), F.desc("steps"), F.asc("node"))
    on_path = leaves.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= branches)
    on_path = on_path.select("tree", F.col("node").alias("leaf"), "rank", F.lit(0).cast("long").alias("distance"), "node")
    # Every distance is a sum of distinct powers of two: from the longest jump to the shortest.
    for i in reversed(range(len(jumps))):
        jump = jumps[i].where("to IS NOT NULL").select(F.col("tree").alias("_t"), F.col("node").alias("_n"), "to")
        further = on_path.join(jump, same_tree & (F.col("node") == F.col("_n"))).select("tree", "leaf", "rank", (F.col("distance") + 2**i).alias("distance"), F.col("to").alias("node"))
        # Each step reads the one before twice: written at once, it is made once.
        on_path = written(on_path.unionByName(further))
    return on_path


def format_trees(messages: DataFrame, branches: int = 1) -> DataFrame:
    """tree, leaf, rank, formatted, loss_starts and loss_ends of each chosen path."""
    on_path = paths(messages, branches)
    texts = messages.select(F.col("tree").alias("_t"), F.col("node").alias("_n"), "role", "text")
    joined = on_path.join(texts, F.col("tree").eqNullSafe(F.col("_t")) & (F.col("node") == F.col("_n")))
    turn = F.struct((-F.col("distance")).alias("at"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    grouped = joined.groupBy("tree", "leaf", "rank").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    schema = grouped.select("tree", "leaf", "rank").schema.add("formatted", "string").add("loss_starts", ArrayType(LongType())).add("loss_ends", ArrayType(LongType()))

    def format_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 500):
                part = b.slice(i, 500)
                done = [format_turns([(t["role"], t["text"]) for t in turns]) for turns in part.column("turns").to_pylist()]
                columns = [part.column(c) for c in ("tree", "leaf", "rank")]
                columns += [pa.array([x[0] for x in done], pa.string()), *(pa.array([x[k] for x in done], pa.list_(pa.int64())) for k in (1, 2))]
                yield pa.RecordBatch.from_arrays(columns, ["tree", "leaf", "rank", "formatted", "loss_starts", "loss_ends"])

    return grouped.mapInArrow(format_rows, schema)


def digests(formatted: DataFrame) -> DataFrame:
    """What the formatted conversations say, read from their text and mask alone."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha = lambda text: hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()
        for b in batches:
            rows = []
            for text, starts, ends in zip(*(b.column(c).to_pylist() for c in ("formatted", "loss_starts", "loss_ends")), strict=True):
                turns = parse_turns(text)
                loss = "".join(unescape(text[s:e]) for s, e in zip(starts, ends, strict=True))
                rows.append((len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss), len(text)))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([b.column("tree"), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    kind = formatted.schema["tree"].dataType.simpleString()
    return formatted.mapInArrow(read, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


TRICKY = r"\### Assistant: </turn> ok"


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    rows = rows.unionByName(spark.createDataFrame([(-7, 0, "user", TRICKY), (-7, 1, "assistant", TRICKY)], kinds))
    return digests(written(format_trees(written(chain(rows)))))


ORACLE = rf"""
WITH c AS (
  SELECT conv_id, turn, COALESCE(role, '') AS role, COALESCE(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{TRICKY}' UNION ALL SELECT -7, 1, 'assistant', '{TRICKY}'
), e AS (
  SELECT *, replace(replace(text, '\', '\\'), '<', '\<') AS escaped FROM c
)
SELECT conv_id, COUNT(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  SUM(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(COALESCE(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  SUM(length('<turn >') + length(role) + 1 + length(escaped) + 9)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
