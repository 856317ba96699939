"""Chat formatting of reply trees.

Messages point at the message they answer. Self-joins that double the distance in each
round find root, depth and summed score of every message, and keep the table of
ancestors 1, 2, 4, ... steps above; messages that have met their root leave the rounds. Leaves are ranked within their tree by the score of
their branch; the jump tables, from the longest to the shortest, then enumerate the
messages of the chosen branches. Only keys and scores take part in the joins. Each
message becomes one formatted segment; the segments of a path in order are its text, so
a conversation of any length streams through sorted rows and never has to be one value.

Template: ``<|turn|>role`` newline, text, ``<|end|>`` newline. Control strings inside
roles and texts get one more backslash behind their first character, which ``unescape``
takes away again.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlight.llm.common import mapped, stored

OPEN, CLOSE = "<|turn|>", "<|end|>"
# Strings that some chat template or tokenizer reads as a control mark.
CONTROL = (
    OPEN, CLOSE, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>",
    "<|endoftext|>", "<|startoftext|>", "<|eot_id|>", "<|begin_of_text|>", "<|end_of_text|>",
    "<|start_header_id|>", "<|end_header_id|>", "<|system|>", "<|user|>", "<|assistant|>",
)
_RESTS = "|".join(sorted({re.escape(c[0]) + r"\\*(?=" + re.escape(c[1:]) + ")" for c in CONTROL}))
MARKED = f"({_RESTS.replace(chr(92) + '/', '/')})"
_ESCAPED = re.compile("(" + "|".join(re.escape(c[0]) + r"\\*" + r"\\(?=" + re.escape(c[1:]) + ")" for c in CONTROL) + ")")


def escape(text: Column) -> Column:
    """Null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), MARKED, r"$1\\")


def escape_role(role: Column) -> Column:
    """Roles stand on one line: backslashes and line ends are written out first."""
    plain = F.coalesce(role, F.lit(""))
    line = F.replace(F.replace(plain, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))
    return escape(line)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m.group(1)[:-1], text)


def unescape_role(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m.group(1) == "n" else m.group(1), unescape(text))


def _joined(left: DataFrame, right: DataFrame, node: str, how: str = "inner") -> DataFrame:
    """Equi join on ``tree``, where null is a tree like any other, and ``node``; keeps the left keys."""
    other = right.withColumnsRenamed({"tree": "_tree", node: "_node"})
    same = left["tree"].eqNullSafe(other["_tree"]) & (left[node] == other["_node"])
    return left.join(other, same, how).drop("_tree", "_node")


def jumps(messages: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Root, depth and branch score of the messages ``(tree, node, parent, score)``, and the jump tables.

    ``parent`` is null at a root; a parent that is missing in the tree makes a root too.
    Messages on or below a cycle never reach a root and are left out. Table k holds the
    pairs ``(tree, node, above)`` that are 2**k steps apart.
    """
    base = messages.select("tree", "node", "parent", F.coalesce("score", F.lit(0.0)).cast("double").alias("score"))
    known = base.select("tree", F.col("node").alias("parent"), F.lit(True).alias("known"))
    state = stored(
        _joined(base, known, "parent", "left").select(
            "tree", "node", F.when(F.col("known"), F.col("parent")).alias("above"), F.lit(0).cast("long").alias("depth"),
            "score", F.col("node").alias("root"),
        )
    )
    settled, live = state.where("above is null"), state.where("above is not null")
    tables, left, before = [], live.count(), None
    while left and left != before:  # only messages below a cycle stay as many as they were
        tables.append(live.select("tree", "node", "above"))
        up = settled.unionByName(live).select(
            "tree", F.col("node").alias("above"), F.col("above").alias("next"), F.col("depth").alias("up_depth"),
            F.col("score").alias("up_score"), F.col("root").alias("up_root"),
        )
        moved = stored(
            _joined(live, up, "above").select(
                "tree", "node", F.col("next").alias("above"), (F.lit(1 << (len(tables) - 1)) + F.col("up_depth")).alias("depth"),
                (F.col("score") + F.col("up_score")).alias("score"), F.col("up_root").alias("root"),
            )
        )
        settled, live = settled.unionByName(moved.where("above is null")), moved.where("above is not null")
        left, before = live.count(), left
    return settled.select("tree", "node", "root", "depth", "score"), tables


def best_branches(reached: DataFrame, messages: DataFrame, per_tree: int = 1) -> DataFrame:
    """The ``per_tree`` best leaves ``(tree, leaf, rank, depth)`` of each tree.

    Higher branch scores come first, then longer branches, then the smaller leaf.
    Spark keeps the best of each task before the exchange.
    """
    parents = messages.select("tree", F.col("parent").alias("node")).where("node is not null").distinct()
    leaves = _joined(reached, parents, "node", "left_anti")
    order = F.struct((-F.col("score")).alias("s"), (-F.col("depth")).alias("d"), F.col("node").alias("leaf"))
    if per_tree == 1:
        best = leaves.groupBy("tree").agg(F.min(order).alias("o"))
        return best.select("tree", F.col("o.leaf").alias("leaf"), F.lit(1).alias("rank"), (-F.col("o.d")).alias("depth"))
    from pyspark.sql import Window

    spot = F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("score"), F.desc("depth"), "node"))
    ranked = leaves.withColumn("rank", spot).where(F.col("rank") <= per_tree)
    return ranked.select("tree", F.col("node").alias("leaf"), "rank", "depth")


def paths(branches: DataFrame, tables: list[DataFrame]) -> DataFrame:
    """Every message of the chosen branches: ``(tree, leaf, rank, node, turn)``, turn 0 at the root."""
    found = stored(branches.select("tree", "leaf", "rank", F.col("depth").alias("turn"), F.col("leaf").alias("node")))
    for k in reversed(range(len(tables))):
        far = _joined(found, tables[k], "node").select(
            "tree", "leaf", "rank", (F.col("turn") - (1 << k)).alias("turn"), F.col("above").alias("node")
        )
        found = stored(found.unionByName(far))
    return found


def format_trees(messages: DataFrame, per_tree: int = 1) -> DataFrame:
    """Formatted segments of the best branches of ``messages (tree, node, parent, role, text, score)``.

    Rows ``(tree, leaf, rank, turn, segment, loss_start, loss_chars)``: the segment of one
    turn, and where in it the loss mask lies (assistant texts; else null and 0). The
    segments of (tree, leaf) by turn, joined without anything between, are the text of
    the conversation. ``(tree, node)`` is unique, and a null tree is one
    tree; null roles and texts are empty, a null
    score is 0. A tree without messages that reach a root gives nothing, as does an empty
    table; extra columns are ignored.
    """
    keys = messages.select("tree", "node", "parent", "score")
    reached, tables = jumps(keys)
    chosen = paths(best_branches(stored(reached), keys, per_tree), tables)
    head = F.concat(F.lit(OPEN), escape_role(F.col("role")), F.lit("\n"))
    body = escape(F.col("text"))
    loss = F.col("role") == "assistant"
    return _joined(chosen, messages.select("tree", "node", "role", "text"), "node").select(
        "tree", "leaf", "rank", "turn", F.concat(head, body, F.lit(CLOSE + "\n")).alias("segment"),
        F.when(loss, F.length(head).cast("long")).alias("loss_start"),
        F.when(loss, F.length(body)).otherwise(0).cast("long").alias("loss_chars"),
    )


SEGMENT = re.compile(re.escape(OPEN) + r"([^\n]*)\n(.*)" + re.escape(CLOSE) + r"\n", re.DOTALL)
DIGEST = (
    "tree long, leaf long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
)


def read_back(segments: DataFrame) -> DataFrame:
    """Digests of every formatted conversation, from its text and its loss mask alone.

    Segments are dealt by conversation and sorted by turn; each streams through, so a
    conversation costs its rows of one task's time and no memory.
    """
    dealt = segments.select("tree", "leaf", "turn", "segment", "loss_start", "loss_chars")
    dealt = dealt.repartition("tree", "leaf").sortWithinPartitions("tree", "leaf", "turn")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, done = None, None, []
        for batch in batches:
            for tree, leaf, _, segment, start, size in zip(*(c.to_pylist() for c in batch.columns)):
                if (tree, leaf) != key:
                    if key is not None:
                        done.append((*key, *_closed(state)))
                    key, state = (tree, leaf), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                m = SEGMENT.fullmatch(segment)
                turn = f"{unescape_role(m.group(1))}\n{unescape(m.group(2))}\n"
                state[0] += 1
                state[1].update(turn.encode())
                if start is not None:
                    learned = unescape(segment[start : start + size])
                    state[2] += len(learned)
                    state[3].update(learned.encode())
                state[4] += len(segment)
            if len(done) >= 5_000:
                yield _digests(done)
                done = []
        if key is not None:
            done.append((*key, *_closed(state)))
        if done:
            yield _digests(done)

    return mapped(dealt, run, DIGEST)


def _closed(state: list) -> tuple:
    return state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    names = [c.split()[0] for c in DIGEST.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
