"""Chat formatting: reply trees into conversations with a loss mask."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sleuthframe.plans.lineage import materialise

# The template's control strings, and what stands for their first characters inside texts.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]")
ESCAPES = {"\\": "\\\\", "<": "\\l", "[": "\\b", "\n": "\\n"}

#: Where no tree has more nodes, a tree's texts are dealt to one task; else they are dealt by node and only chosen paths meet.
TOGETHER = 10_000

_HIDE_TEXT = re.compile(r"\\|<(?=/?s>)|\[(?=/?INST\])")
_HIDE_ROLE = re.compile(r"[\\\n]|<(?=/?s>)|\[(?=/?INST\])")
_SHOW = re.compile(r"\\([\\lbn])")
_TURN = re.compile(r"\[INST\](.*?)\[/INST\]|<s>(.*?)\n(.*?)</s>", re.DOTALL)
_BACK = {v[1]: k for k, v in ESCAPES.items()}


def escape(text: str, role: bool = False) -> str:
    """A text without control strings, from which ``unescape`` gets it back."""
    return (_HIDE_ROLE if role else _HIDE_TEXT).sub(lambda m: ESCAPES[m[0]], text)


def unescape(text: str) -> str:
    return _SHOW.sub(lambda m: _BACK[m[1]], text)


def format_turns(turns: list[tuple[str, str]], trained: str = "assistant") -> tuple[str, list[tuple[int, int]]]:
    """One string of all turns, and the spans (start, end; code points) of the trained role's texts.

    A user's turn is ``[INST]text[/INST]``, any other ``<s>role``, a line end and ``text</s>``.
    """
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, tail = ("[INST]", "[/INST]") if role == "user" else (f"<s>{escape(role, True)}\n", "</s>")
        body = escape(text)
        if role == trained:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, tail]
        at += len(head) + len(body) + len(tail)
    return "".join(parts), spans


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted string."""
    return [("user", unescape(m[1])) if m[1] is not None else (unescape(m[2]), unescape(m[3])) for m in _TURN.finditer(formatted)]


FORMATTED = "tree long, leaf long, n_turns long, path_score double, formatted string, loss_spans array<struct<start:long,end:long>>"


def reply_paths(messages: DataFrame, best: int | None = 1) -> DataFrame:
    """Root-to-leaf paths of reply trees: ``tree, leaf, path_score, place, node``.

    ``messages`` has ``tree, node, parent, score``, one row per node. The path
    of a leaf is scored by the mean of its nodes' scores (null: 0); the ``best``
    paths of each tree are kept, ties by the smaller leaf, all if it is None.
    A parent that isn't in the tree makes a root. Nodes on a cycle have no root
    and so no path.

    Ancestors at distances 1, 2, 4 ... come from joining the table of jumps with
    itself; a kept leaf then walks up by doubling. A tree of depth d takes log d
    joins, and texts stay out of all of them.
    """
    same = lambda a, b: a["tree"].eqNullSafe(b["tree"])
    nodes = messages.select("tree", "node", "parent", F.coalesce("score", F.lit(0.0)).alias("score"))
    known = nodes.select("tree", F.col("node").alias("parent"))
    linked = nodes.alias("n").join(known.alias("k"), F.col("n.tree").eqNullSafe(F.col("k.tree")) & (F.col("n.parent") == F.col("k.parent")), "left")
    jumps = materialise(linked.select("n.tree", "n.node", F.col("k.parent").alias("up"), "n.score", F.lit(1).cast("long").alias("n_nodes")))
    deepest = largest_tree(messages)
    levels = [jumps.select("tree", "node", "up")]
    inner = jumps.where("up is not null").select("tree", F.col("up").alias("node")).distinct()
    for _ in range(max(0, deepest - 1).bit_length()):
        j, k = jumps.where("up is not null").alias("j"), jumps.alias("k")
        longer = j.join(k, F.col("j.tree").eqNullSafe(F.col("k.tree")) & (F.col("j.up") == F.col("k.node"))).select(
            "j.tree", "j.node", F.col("k.up").alias("up"), (F.col("j.score") + F.col("k.score")).alias("score"), (F.col("j.n_nodes") + F.col("k.n_nodes")).alias("n_nodes")
        )
        jumps = materialise(longer.unionByName(jumps.where("up is null")))  # nodes that have reached their root stay as they are
        if jumps.where("up is not null").isEmpty():
            break
        levels.append(jumps.select("tree", "node", "up"))
    leaves = jumps.where("up is null").join(inner, jumps["tree"].eqNullSafe(inner["tree"]) & (jumps["node"] == inner["node"]), "left_anti")
    leaves = leaves.select("tree", F.col("node").alias("leaf"), (F.col("score") / F.col("n_nodes")).alias("path_score"), "n_nodes")
    if best is not None:
        order = Window.partitionBy("tree").orderBy(F.desc("path_score"), "leaf")
        leaves = leaves.withColumn("at", F.row_number().over(order)).where(F.col("at") <= best).drop("at")
    walked = materialise(leaves.select("tree", "leaf", "path_score", F.col("leaf").alias("node"), F.col("n_nodes").alias("place")))
    for k, level in reversed(list(enumerate(levels))):
        w, u = walked.alias("w"), level.where("up is not null").alias("u")
        higher = w.join(u, F.col("w.tree").eqNullSafe(F.col("u.tree")) & (F.col("w.node") == F.col("u.node"))).select(
            "w.tree", "w.leaf", "w.path_score", F.col("u.up").alias("node"), (F.col("w.place") - (1 << k)).alias("place")
        )
        walked = materialise(walked.unionByName(higher))
    return walked


def largest_tree(nodes: DataFrame) -> int:
    return nodes.groupBy("tree").count().agg(F.max("count")).first()[0] or 0


def path_turns(messages: DataFrame, paths: DataFrame, together: bool) -> DataFrame:
    """``tree, turns, paths``: chosen paths (leaf, path_score, place, node), and the role and text of each of their nodes.

    ``together``: a row per tree. Texts are shuffled once, by tree; the rows of a
    repeated node are next to each other there. Else a row per path: texts are
    shuffled by node, and those on a path once more.
    """
    turn = F.struct("node", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    step = F.struct("leaf", "path_score", "place", "node")
    if together:
        order = Window.partitionBy("tree").orderBy("node", "role", "text")
        texts = messages.select("tree", "node", "role", "text", F.lag("node").over(order).alias("last")).where("last is null or last != node")
        texts = texts.groupBy("tree").agg(F.collect_list(turn).alias("turns"))
        return texts.join(paths.groupBy("tree").agg(F.collect_list(step).alias("paths")), "tree")
    texts = messages.groupBy("tree", "node").agg(F.min(F.struct("role", "text")).alias("m")).select("tree", "node", "m.*")
    return texts.join(paths, ["tree", "node"]).groupBy("tree", "leaf").agg(F.collect_list(turn).alias("turns"), F.collect_list(step).alias("paths")).drop("leaf")


def format_conversations(messages: DataFrame, best: int | None = 1, links: DataFrame | None = None) -> DataFrame:
    """The chosen paths of reply trees, each as one formatted conversation.

    ``messages`` has ``tree, node, parent, role, text, score``; other columns are
    ignored. ``links`` are the ``tree, node, parent, score`` of the same rows, where
    they can be had without reading texts. Repeated nodes count once: the least
    parent with its least score, the least role with its least text. Null roles and
    texts are empty, a null ``tree`` is a tree of its own, rows with a null ``node``
    are left out. Returns ``tree, leaf, n_turns, path_score, formatted,
    loss_spans``; a conversation is one row, however long. An empty table gives an
    empty table.

    Paths are found by the links alone; texts are fetched once they are known.
    """
    messages = messages.where("node is not null")
    links = (messages if links is None else links.where("node is not null")).select("tree", "node", "parent", F.col("score").cast("double").alias("score"))
    links = materialise(links.groupBy("tree", "node").agg(F.min(F.struct("parent", "score")).alias("m")).select("tree", "node", "m.*"))
    paths = reply_paths(links, best)
    together = best is not None and largest_tree(links) <= TOGETHER
    whole = path_turns(messages, paths, together)
    if not links.where("tree is null").isEmpty():  # a join leaves these out; -1 stands for the tree that has none
        alone = lambda df: df.where("tree is null").withColumn("tree", F.lit(-1).cast("long"))
        whole = whole.unionByName(path_turns(alone(messages), alone(paths), together).withColumn("tree", F.lit(None).cast("long")))

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for tree, turns, steps in zip(frame["tree"], frame["turns"], frame["paths"], strict=True):
                said, chosen = {t["node"]: (t["role"], t["text"]) for t in turns}, {}
                for step in sorted(steps, key=lambda p: p["place"]):
                    chosen.setdefault((step["leaf"], step["path_score"]), []).append(said[step["node"]])
                for (leaf, score), path in chosen.items():
                    text, spans = format_turns(path)
                    rows.append((tree, leaf, len(path), score, text, [{"start": a, "end": b} for a, b in spans]))
            yield pd.DataFrame(rows, columns=["tree", "leaf", "n_turns", "path_score", "formatted", "loss_spans"]).astype({"tree": "Int64", "leaf": "Int64"})

    return whole.mapInPandas(write, FORMATTED)


def turns_as_trees(rows: DataFrame) -> DataFrame:
    """Linear conversations (``conv_id, turn, role, text``) as trees of one branch.

    A conversation's rows are taken by turn (then role and text, nulls first); a
    repeated row is a turn of its own.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    at = rows.withColumn("node", F.row_number().over(order).cast("long"))
    return at.select(F.col("conv_id").cast("long").alias("tree"), "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(1.0).alias("score"))


def turn_links(rows: DataFrame) -> DataFrame:
    """``tree, node, parent, score`` of ``turns_as_trees(rows)``, from the conversations' numbers of rows alone."""
    counts = rows.groupBy(F.col("conv_id").cast("long").alias("tree")).agg(F.count(F.lit(1)).alias("n"))
    nodes = counts.select("tree", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("node"))
    return nodes.select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), F.lit(1.0).alias("score"))
