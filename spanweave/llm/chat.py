"""Chat formatting of reply trees: ranked root-to-leaf paths, each as one conversation.

Messages are nodes with a parent. Iterative self-joins double the reach of every node's ancestor: after k rounds a node
knows its ancestor 2^k steps up, the path's length and its summed score, so a tree of depth d takes log2(d) joins.
Leaves (a root's path ends in each) are ranked by score within their tree; for the chosen ones the ancestor tables are
walked again, from each leaf up by all powers of two, which lists every node of its path once. Each path is then
formatted as one text and can be read back.

The joins know nothing of texts. A tree's messages meet its paths in one shuffle, which is the only one that texts take;
trees of more than HOT messages are joined by node instead, and then grouped by path.

Template: a turn is a line ``### role:``, its text, and a line ``</turn>``. Inside roles and texts a backslash goes
before each backslash and control string, so the format is reversible whatever the texts say. Assistant texts lie under
the loss mask.

Defined cases: null texts and roles count as empty; a parent that is missing makes its child a root; nodes in a cycle
belong to no path; rows that repeat a node (tree and id) are several messages of one step, in the order of role and
text; ties of score go to the lesser leaf; empty tables give no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, map_arrow, stage

#: Messages of a tree that one task takes together.
HOT = 10_000
#: The marks of the template.
OPEN, CLOSE = "### ", "\n</turn>\n"
_CONTROL = re.compile(r"\\|###|</turn>")
_ESCAPED = re.compile(r"\\(n|\\|###|</turn>)")
_TURN = re.compile(r"### ((?:[^\\#<\n]++|#(?!##)|<(?!/turn>)|\\(?:n|\\|###|</turn>))*+)\n((?:[^\\#<]++|#(?!##)|<(?!/turn>)|\\(?:\\|###|</turn>))*+)</turn>\n")


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: "\n" if m[1] == "n" else m[1], text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The text of a conversation and the spans of it under the loss mask."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{OPEN}{escape(role).replace(chr(10), chr(92) + 'n')}:\n", escape(text)
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, CLOSE]
        at += len(head) + len(body) + len(CLOSE)
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation; anything else is an error."""
    out, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if m is None or m[1][-1:] != ":" or m[2][-1:] != "\n":
            raise ValueError(f"no turn at character {at}")
        out.append((unescape(m[1][:-1]), unescape(m[2][:-1])))
        at = m.end()
    return out


def paths(nodes: DataFrame, best: int | None = 1) -> DataFrame:
    """tree, leaf, rank, score, step (0 at the root), node: the best paths of each tree (None: all of them).

    nodes: tree, node, parent (null at a root), score; one row for each node.
    """
    known = nodes.select("tree", F.col("node").alias("up"))
    n, k = nodes.alias("n"), known.alias("k")
    jump = n.join(k, F.col("n.tree").eqNullSafe(F.col("k.tree")) & (F.col("n.parent") == F.col("k.up")), "left")
    score = F.coalesce("n.score", F.lit(0.0)).cast("double").alias("score")
    jump = stage(jump.select("n.tree", "n.node", "k.up", score, F.lit(1).cast("bigint").alias("steps")), "jump0")
    # Nodes whose ancestor is past the root are done and leave the doubling; only longer paths go on.
    own, tables, total = jump, [], nodes.count()
    done = jump.where("up is null")
    live = jump.where("up is not null")
    while (1 << len(tables)) <= 2 * total and not live.isEmpty():
        tables.append(live)
        a, b = live.alias("a"), live.unionByName(done).alias("b")
        twice = a.join(b, F.col("a.tree").eqNullSafe(F.col("b.tree")) & (F.col("a.up") == F.col("b.node")))
        twice = twice.select("a.tree", "a.node", "b.up", (F.col("a.score") + F.col("b.score")).alias("score"), (F.col("a.steps") + F.col("b.steps")).alias("steps"))
        twice = stage(twice, f"jump{len(tables)}")
        done, live = done.unionByName(twice.where("up is null")), twice.where("up is not null")
    inner = own.where("up is not null").select("tree", F.col("up").alias("node")).distinct()
    c, d = done.alias("c"), inner.alias("d")  # what still has an ancestor is in a cycle
    leaves = c.join(d, F.col("c.tree").eqNullSafe(F.col("d.tree")) & (F.col("c.node") == F.col("d.node")), "left_anti").select("tree", F.col("node").alias("leaf"), "score", "steps")
    ranked = leaves.withColumn("rank", F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("score"), "leaf")))
    if best is not None:
        ranked = ranked.where(F.col("rank") <= best)
    ranked = stage(ranked, "leaves")
    on = ranked.select("tree", "leaf", F.col("leaf").alias("node"), (F.col("steps") - 1).alias("step"))
    for k, table in enumerate(tables):
        e, f = on.alias("e"), table.alias("f")
        more = e.join(f, F.col("e.tree").eqNullSafe(F.col("f.tree")) & (F.col("e.node") == F.col("f.node"))).select("e.tree", "leaf", F.col("up").alias("node"), (F.col("step") - (1 << k)).alias("step"))
        on = stage(on.unionByName(more), f"on{k}")
    g, h = on.alias("g"), ranked.alias("h")
    return g.join(h, F.col("g.tree").eqNullSafe(F.col("h.tree")) & (F.col("g.leaf") == F.col("h.leaf"))).select("g.tree", "g.leaf", "rank", "score", "step", "node")


def format_paths(messages: DataFrame, best: int | None = 1, nodes: DataFrame | None = None) -> DataFrame:
    """tree, leaf, rank, score, formatted and loss_spans of each chosen path.

    messages: tree, node, role, text, and, where no nodes are given, parent and score; several rows of one node follow
    each other in its step. nodes: tree, node, parent, score, one row for each node.
    """
    if nodes is None:
        nodes = messages.groupBy("tree", "node").agg(F.min("parent").alias("parent"), F.sum("score").alias("score"))
    chosen = paths(stage(nodes, "nodes"), best)
    kinds = {c: chosen.schema[c].dataType.simpleString() for c in ("tree", "leaf")}
    said = messages.select("tree", "node", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    hot = bounded(said.groupBy(F.col("tree").alias("hot")).count().where(F.col("count") > HOT).select("hot"), "hot")
    schema = f"tree {kinds['tree']}, leaf {kinds['leaf']}, rank int, score double, formatted string, loss_spans array<struct<start:int,end:int>>"
    place = f"struct<leaf:{kinds['leaf']},rank:int,score:double,step:bigint>"

    def side(df: DataFrame, how: str) -> DataFrame:
        return df.join(hot, F.col("tree").eqNullSafe(F.col("hot")), how)

    def written(rows: list[tuple]) -> dict:
        """rows: tree, leaf, rank, score and turns of each path."""
        done = [render(r[4]) for r in rows]
        return {n: [r[i] for r in rows] for i, n in enumerate(("tree", "leaf", "rank", "score"))} | {"formatted": [d[0] for d in done], "loss_spans": [[{"start": a, "end": b} for a, b in d[1]] for d in done]}

    def of_trees(batch: pa.RecordBatch) -> dict:
        rows = []
        for tree, entries in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            turns: dict = {}
            steps: dict[tuple, list] = {}
            for e in entries.as_py():
                if (p := e["place"]) is None:
                    turns.setdefault(e["node"], []).append((e["role"], e["text"]))
                else:
                    steps.setdefault((p["leaf"], p["rank"], p["score"]), []).append((p["step"], e["node"]))
            for path, on in steps.items():
                rows.append((tree, *path, [t for _, node in sorted(on) for t in sorted(turns.get(node, ()))]))
        return written(rows)

    def of_paths(batch: pa.RecordBatch) -> dict:
        columns = [batch.column(i).to_pylist() for i in range(4)]
        return written([(*row, [(t["role"], t["text"]) for t in turns.as_py()]) for *row, turns in zip(*columns, batch.column(4), strict=True)])

    both = side(said, "left_anti").select("tree", "node", "role", "text", F.lit(None).cast(place).alias("place"))
    none = F.lit(None).cast("string")
    both = both.unionByName(side(chosen, "left_anti").select("tree", "node", none.alias("role"), none.alias("text"), F.struct("leaf", "rank", "score", "step").cast(place).alias("place")))
    trees = both.groupBy("tree").agg(F.collect_list(F.struct("node", "role", "text", "place")).alias("entries"))
    out = map_arrow(trees, of_trees, schema)
    if hot.isEmpty():
        return out
    g, m = side(chosen, "left_semi").alias("g"), side(said, "left_semi").alias("m")
    rows = g.join(m, F.col("g.tree").eqNullSafe(F.col("m.tree")) & F.col("g.node").eqNullSafe(F.col("m.node"))).drop(F.col("m.tree"), F.col("m.node"))
    each = rows.groupBy("tree", "leaf", "rank", "score").agg(F.array_sort(F.collect_list(F.struct("step", "role", "text"))).alias("turns"))
    return out.unionByName(map_arrow(each.select("tree", "leaf", "rank", "score", "turns"), of_paths, schema))


def digests(formatted: DataFrame) -> DataFrame:
    """What reading the formatted texts back gives: tree, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""

    def of(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {k: [] for k in ("n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")}
        for text, spans in zip(batch.column(1), batch.column(2), strict=True):
            text = text.as_py()
            turns = parse(text)
            loss = "".join(unescape(text[s["start"] : s["end"]]) for s in spans.as_py())
            values = (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text))
            for k, v in zip(out, values, strict=True):
                out[k].append(v)
        return {"tree": batch.column(0)} | out

    kind = formatted.schema["tree"].dataType.simpleString()
    return map_arrow(formatted.select("tree", "formatted", "loss_spans"), of, f"tree {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
