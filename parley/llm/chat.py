r"""Chat formatting with a prefix tree.

Conversations that begin with the same turns share those turns' nodes: a node is a path of
turns from the start, named by a chained hash. Nodes are laid out depth first in one stream
(a node's subtree follows it at once), each emitted once, with

* ``seq_start``: where its tokens stand in the stream,
* ``pos_start``: position id of its first token, the length of its ancestors (ids go on by one), and
* ``attends``: stream intervals of its ancestors, adjacent ones merged; a token sees those and
  its own node up to itself.

Template: ``[INST]role\ntext[/INST]``, for the assistant ``<s>role\ntext</s>``, whose text is under
the loss mask. Inside roles and texts a backslash goes before every backslash and control
string (and before a role's line break), so ``unescape`` restores any text. Tokens are code
points, or ids of a public tokenizer's file if one is given to ``tokens``.

The depth-first order is the order of the paths (a fixed-width hash a level), so a range
partitioning with sums per partition gives offsets; no tree is sorted in one task.

Defined results: null texts and roles are empty strings; rows of one conversation go by turn
(null last), then role and text, and repeated rows are repeated turns; the null conversation
id is one conversation; an empty table gives only what the caller adds; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.llm._shared import materialise

#: Control strings, fixed: those of the template and those other templates would read.
CONTROL = ("[INST]", "[/INST]", "<s>", "</s>", "<<SYS>>", "<</SYS>>", "<|", "|>")
SPECIAL = re.compile(r"\\|" + "|".join(map(re.escape, CONTROL)))
OPEN, CLOSE = {True: "<s>", False: "[INST]"}, {True: "</s>", False: "[/INST]"}
PARSE = re.compile(r"\\.|\[INST\]|\[/INST\]|<s>|</s>|\n", re.S)
LEVEL = 32  # hex digits of the hash that a level adds to a path


def escape(text: str) -> str:
    return SPECIAL.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def turn(role: str, text: str) -> tuple[str, int]:
    """A formatted turn, and where its loss begins (-1: nowhere); the loss ends before the closing mark."""
    own = role == "assistant"
    head = OPEN[own] + escape(role).replace("\n", "\\\n") + "\n"
    return head + escape(text) + CLOSE[own], len(head) if own else -1


def read_back(text: str) -> list[tuple[str, str, str]]:
    """Turns of a formatted conversation: (role, text, text under the loss mask)."""
    out, at, role, own, begin = [], 0, None, False, 0
    for m in PARSE.finditer(text):
        mark = m[0]
        if mark in ("[INST]", "<s>"):
            own, begin, role = mark == "<s>", m.end(), None
        elif mark == "\n" and role is None:
            role, begin = unescape(text[begin : m.start()]), m.end()
        elif mark in ("[/INST]", "</s>"):
            body = unescape(text[begin : m.start()])
            out.append((role, body, body if own else ""))
            at = m.end()
    if at != len(text):
        raise ValueError("text after the last turn")
    return out


def tokens(text: str, tokenizer=None) -> list[int]:
    """Token ids of a node's text: code points, or what ``tokenizer`` (of the tokenizers library) gives."""
    return list(map(ord, text)) if tokenizer is None else tokenizer.encode(text, add_special_tokens=False).ids


PATHS = "conv_id long, path string, depth int, text string, loss int"


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for conv, turns in zip(batch.column("conv_id").to_pylist(), batch.column("turns").to_pylist(), strict=True):
            path = []
            for depth, t in enumerate(turns):
                text, loss = turn(t["role"], t["text"])
                path.append(hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()[:LEVEL])
                rows.append((conv, "".join(path), depth, text, loss))
        cols = list(zip(*rows, strict=True)) or [[]] * 5
        kinds = (pa.int64(), pa.string(), pa.int32(), pa.string(), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["conv_id", "path", "depth", "text", "loss"])


def prefix_tree(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, leaves): the tree's nodes with layout, and each conversation's last node.

    nodes: path, depth, text, loss, size, seq_start, pos_start, attends array<struct<from,to>>.
    leaves: conv_id, path. Two different turns share a level's hash with a chance of 2**-128 a pair.
    """
    spark = conversations.sparkSession
    rows = conversations.select("conv_id", F.struct(F.col("turn").isNull().alias("late"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("row"))
    whole = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("row")).alias("turns"))
    paths = materialise(whole.select("conv_id", "turns").mapInArrow(_paths, PATHS), "paths")
    leaves = paths.groupBy("conv_id").agg(F.max_by("path", "depth").alias("path"))
    # A hot node's rows meet after one row per task and node is left; text and loss hang on the path.
    nodes = paths.groupBy("path", "depth").agg(F.first("text").alias("text"), F.first("loss").alias("loss")).withColumn("size", F.length("text").cast("long"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    laid = materialise(nodes.repartitionByRange(parts, "path").sortWithinPartitions("path").withColumn("part", F.spark_partition_id()).withColumn("nth", F.monotonically_increasing_id()), "layout")
    # One number a partition comes to the driver; offsets inside a partition follow its order.
    sums = {r["part"]: r["n"] for r in laid.groupBy("part").agg(F.sum("size").alias("n")).collect()}
    start, offsets = 0, {}
    for p in sorted(sums):
        offsets[p], start = start, start + sums[p]
    table = spark.createDataFrame(list(offsets.items()), "part int, base long")
    inside = F.sum("size").over(_order())
    placed = laid.join(F.broadcast(table), "part").withColumn("seq_start", F.col("base") + inside - F.col("size")).drop("base", "part", "nth")
    placed = materialise(placed, "placed")
    # Ancestors are the prefixes of the path.
    up = placed.where("depth > 0").select(F.col("path").alias("node"), F.explode(F.sequence(F.lit(1), F.col("depth"))).alias("k"), F.col("path").alias("p")).select("node", F.substring("p", F.lit(1), F.col("k") * LEVEL).alias("path"))
    seen = up.join(placed.select("path", "depth", "seq_start", "size"), "path").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("depth", "seq_start", "size"))).alias("up"))
    merged = F.aggregate(
        "up",
        F.array().cast("array<struct<from:long,to:long>>"),
        lambda acc, x: F.when(
            (F.size(acc) > 0) & (F.element_at(acc, -1)["to"] == x["seq_start"]),
            F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["from"].alias("from"), (x["seq_start"] + x["size"]).alias("to")))),
        ).otherwise(F.concat(acc, F.array(F.struct(x["seq_start"].alias("from"), (x["seq_start"] + x["size"]).alias("to"))))),
    )
    seen = seen.select(F.col("node").alias("path"), F.aggregate("up", F.lit(0).cast("long"), lambda a, x: a + x["size"]).alias("pos_start"), F.when(F.size("up") > 0, merged).alias("attends"))
    out = placed.join(seen, "path", "left").withColumn("pos_start", F.coalesce("pos_start", F.lit(0))).withColumn("attends", F.coalesce("attends", F.array().cast("array<struct<from:long,to:long>>")))
    return out, leaves


def _order():
    from pyspark.sql import Window

    return Window.partitionBy("part").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hexed = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
    for batch in batches:
        rows = []
        for conv, nodes in zip(batch.column("conv_id").to_pylist(), batch.column("nodes").to_pylist(), strict=True):
            text = "".join(x["text"] for x in nodes)
            turns = read_back(text)
            # The mask's intervals, taken from the nodes, not from the template.
            masked = "".join(unescape(x["text"][x["loss"] : -len(CLOSE[True])]) for x in nodes if x["loss"] >= 0)
            rows.append((conv, len(turns), hexed("".join(f"{r}\n{t}\n" for r, t, _ in turns)), len(masked), hexed(masked), len(text)))
        cols = list(zip(*rows, strict=True)) or [[]] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()), strict=True)], names=[x.split()[0] for x in DIGESTS.split(", ")])


def digests(nodes: DataFrame, leaves: DataFrame) -> DataFrame:
    """Each conversation read back from the tree's nodes."""
    steps = leaves.select("conv_id", F.explode(F.sequence(F.lit(LEVEL), F.length("path"), F.lit(LEVEL))).alias("k"), F.col("path").alias("p")).select("conv_id", F.substring("p", F.lit(1), F.col("k")).alias("path"))
    got = steps.join(nodes.select("path", "depth", "text", "loss"), "path").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("depth", "text", "loss"))).alias("nodes"))
    return got.select("conv_id", "nodes").mapInArrow(_digests, DIGESTS)


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one of control strings, through the tree and back."""
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")], table.schema)
    return digests(*prefix_tree(table.union(probe)))


_ESC = "replace({0}, chr(92), chr(92) || chr(92))"
for _c in CONTROL:
    _ESC = f"replace({_ESC}, '{_c}', chr(92) || '{_c}')"
OP2_SQL = f"""
WITH c AS (SELECT conv_id, turn, COALESCE(role, '') AS role, COALESCE(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS LAST, role, text)) AS turns_sha256,
  COALESCE(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(COALESCE(string_agg(text, '' ORDER BY turn NULLS LAST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(CASE WHEN role = 'assistant' THEN 7 ELSE 13 END + 1 + length({_ESC.format("role")}) + length(role) - length(replace(role, chr(10), '')) + length({_ESC.format("text")}))::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""
