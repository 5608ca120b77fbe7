"""Reply trees to training conversations.

Messages point to their parents.  Self-joins that double the distance they reach
(node -> parent -> ... ) give every message its root, depth and the sum of the
scores on its way, so a path of d turns takes log2(d) joins.  Branches, one per
leaf, are ranked by that score; the members of the chosen branch come from the
same joins read back, and each chosen path is formatted as one conversation with
a loss mask over the assistant's texts.

Defined cases: a null or empty text is an empty turn; a null role is the role "";
a message whose parent is missing is a root; messages on a cycle have no root and
are not formatted; repeated rows are turns of their own, in the order of turn,
role, text; of equal branches the longer and then the first is taken; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kestrel.llm.common import cut

# the template's control strings; inside a text a backslash follows their first character
BEGIN, END = "<s>", "</s>"
USER, USER_END = "[INST]", "[/INST]"
SYSTEM, SYSTEM_END = "<<SYS>>", "<</SYS>>"
OTHER, OTHER_TEXT, OTHER_END = "[ROLE]", "[TEXT]", "[/ROLE]"
CONTROL = (BEGIN, END, USER, USER_END, SYSTEM, SYSTEM_END, OTHER, OTHER_TEXT, OTHER_END)
_CONTROL = re.compile("|".join(map(re.escape, CONTROL)))


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: f"{m[0][0]}\\{m[0][1:]}", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The conversation as one text, and the code-point spans under the loss mask."""
    out, mask, size = [BEGIN], [], len(BEGIN)
    for role, text in turns:
        body = escape(text)
        head, tail = {"user": (f"{USER} ", f" {USER_END}"), "system": (f"{SYSTEM}\n", f"\n{SYSTEM_END}"), "assistant": (" ", f" {END}")}.get(
            role, (f"{OTHER} {escape(role)} {OTHER_TEXT} ", f" {OTHER_END}"))
        size += len(head)
        if role == "assistant":
            mask.append((size, size + len(body)))
        size += len(body) + len(tail)
        out += [head, body, tail]
    return "".join(out), mask


def parse(text: str) -> list[tuple[str, str]]:
    """The turns of a rendered conversation."""
    at, turns = len(BEGIN), []
    while at < len(text):
        for mark, role, stop in ((USER, "user", f" {USER_END}"), (SYSTEM, "system", f"\n{SYSTEM_END}"), (OTHER, None, f" {OTHER_END}"), ("", "assistant", f" {END}")):
            if text.startswith(mark, at):
                break
        start = at + len(mark) + 1
        if role is None:
            middle = text.index(f" {OTHER_TEXT} ", start)
            role, start = unescape(text[start:middle]), middle + len(OTHER_TEXT) + 2
        stop_at = text.index(stop[1:], start) - 1
        turns.append((role, unescape(text[start:stop_at])))
        at = stop_at + len(stop)
    return turns


def climbs(messages: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """``messages``: tree, node, parent, score.  Returns for k = 0, 1, ... the
    written tables (tree, node, up: the ancestor 2^k above), and all messages that
    reach a root with their depth and path score."""
    here = messages.select("tree", "node", "score", F.col("parent").alias("up"))
    parents = messages.select(F.col("tree").alias("t"), F.col("node").alias("p"))
    # a parent that is not there counts as none
    real = here.join(parents, F.col("tree").eqNullSafe(F.col("t")) & (F.col("up") == F.col("p")), "left").select(
        "tree", "node", F.col("p").alias("up"), F.coalesce("score", F.lit(0.0)).cast("double").alias("total"), F.lit(1).cast("long").alias("depth"))
    state = cut(real, "climb")
    levels, most = [], None
    while True:
        open_ = state.where(F.col("up").isNotNull())
        count = open_.count()
        if not count:
            return levels, state.drop("up")
        most = most or state.groupBy("tree").count().agg(F.max("count")).first()[0]
        if 1 << len(levels) > most:  # only cycles are left
            return levels, state.where(F.col("up").isNull()).drop("up")
        levels.append(open_.select("tree", "node", "up"))
        above = state.select(F.col("tree").alias("t"), F.col("node").alias("p"), F.col("up").alias("next"),
                             F.col("total").alias("more"), F.col("depth").alias("steps"))
        state = cut(state.join(above, F.col("tree").eqNullSafe(F.col("t")) & (F.col("up") == F.col("p")), "left").select(
            "tree", "node", F.col("next").alias("up"), (F.col("total") + F.coalesce("more", F.lit(0.0))).alias("total"),
            (F.col("depth") + F.coalesce("steps", F.lit(0))).alias("depth")), "climb")


def best_branches(messages: DataFrame) -> DataFrame:
    """(tree, node, depth) of the messages on each tree's best branch."""
    levels, reached = climbs(messages)
    inner = messages.where(F.col("parent").isNotNull()).select(F.col("tree").alias("t"), F.col("parent").alias("p")).distinct()
    leaves = reached.join(inner, F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("p")), "left_anti")
    best = leaves.groupBy("tree").agg(F.min(F.struct(-F.col("total"), -F.col("depth"), F.col("node").alias("node")))["node"].alias("node"))
    path = cut(best, "path")
    for level in levels:
        up = level.select(F.col("tree").alias("t"), F.col("node").alias("n"), "up")
        more = path.join(up, F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("n"))).select("tree", F.col("up").alias("node"))
        path = cut(path.unionByName(more), "path")
    at = reached.select(F.col("tree").alias("t"), F.col("node").alias("n"), "depth")
    return path.join(at, F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("n"))).select("tree", "node", "depth")


def conversations(messages: DataFrame) -> DataFrame:
    """``messages``: tree, node, parent, score, role, text -> one row per tree:
    tree, formatted, mask (array of start, stop).  A conversation is one row of
    the result, so its turns meet in one task; trees are spread."""
    chosen = cut(best_branches(messages.select("tree", "node", "parent", "score")), "chosen").select(
        F.col("tree").alias("t"), F.col("node").alias("n"), "depth")
    turns = messages.join(chosen, F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("n")))
    one = turns.groupBy("tree").agg(F.array_sort(F.collect_list(F.struct(
        "depth", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")))).alias("turns"))
    schema = f"tree {one.schema['tree'].dataType.simpleString()}, formatted string, mask array<struct<start:bigint,stop:bigint>>"
    spans = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [render([(t["role"], t["text"]) for t in turns]) for turns in batch.column(1).to_pylist()]
            masks = [[{"start": a, "stop": b} for a, b in m] for _, m in made]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([t for t, _ in made], pa.string()), pa.array(masks, spans)],
                                             names=["tree", "formatted", "mask"])

    return one.mapInArrow(run, schema)


def threads(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as trees in which each turn answers the one before."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    node = rows.select(F.col("conv_id").alias("tree"), "role", "text", F.row_number().over(order).cast("long").alias("node"))
    return node.withColumn("parent", F.when(F.col("node") > 1, F.col("node") - 1)).withColumn("score", F.lit(0.0))


def digest(rows: DataFrame) -> DataFrame:
    """The contract's columns, read back from the formatted conversations."""
    odd = "</s>[INST] ok [/INST]"
    spark = rows.sparkSession
    extra = spark.sql(f"SELECT * FROM VALUES (-7L, 0L, 'user', '{odd}'), (-7L, 1L, 'assistant', '{odd}') AS t(conv_id, turn, role, text)")
    every = rows.select("conv_id", "turn", "role", "text").unionByName(extra)
    made = conversations(cut(threads(every), "threads"))
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    schema = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in names[1:]]
            for text, mask in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                turns = parse(text)
                loss = "".join(unescape(text[s["start"]:s["stop"]]) for s in mask)
                said = "".join(f"{role}\n{body}\n" for role, body in turns)
                for column, value in zip(out, (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss),
                                               hashlib.sha256(loss.encode()).hexdigest(), len(text))):
                    column.append(value)
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(out, kinds))], names=names)

    return made.mapInArrow(run, schema)
