"""Chat formatting: reply trees to root-to-leaf conversations, with a reversible template and a loss mask.

Native throughout: joins, windows and string functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import Scratch

START, END = "<|im_start|>", "<|im_end|>"


def escape(text: Column) -> Column:
    r"""\ becomes \\ and <| becomes <\|, so that no control string is left; unescape() reverses it."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\\|])", "$1")


def _key(tree: str, node: str) -> Column:
    return F.concat(F.coalesce(F.concat(F.lit("t"), F.col(tree).cast("string")), F.lit("n")), F.lit("\u0001"), F.col(node).cast("string"))


def reply_paths(nodes: DataFrame, scratch: Scratch, best: int | None = None) -> DataFrame:
    """Root-to-leaf paths (tree, leaf, rank, score, key, pos) of nodes (tree, node, parent, score).

    The joins double their reach: round k joins each node's 2^k-th ancestor to that one's own, so a chain of
    depth d takes log2(d) rounds, and depth and path score add up on the way. Paths are ranked within their
    tree by score, high first, ties to the smaller leaf; best keeps so many of each tree. Only the chosen
    paths are expanded, again by doubling: the rows made are the rows returned.

    A node whose parent is null or not in its tree is a root. Nodes on or below a cycle hang from no root and are
    left out. Null node ids are left out; a null tree is a tree of its own; null scores count as 0. Of rows
    that repeat a node, that with the smallest parent counts.
    """
    base = nodes.where("node is not null").withColumn("key", _key("tree", "node")).withColumn("up", F.when(F.col("parent").isNotNull(), _key("tree", "parent")))
    base = base.groupBy("key").agg(F.min(F.struct(F.col("up").isNull(), "up", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"), "tree", "node")).alias("m"))
    base = base.select("key", "m.tree", "m.node", "m.up", "m.score")
    present = base.select(F.col("key").alias("up"), F.lit(True).alias("there"))
    base = scratch.put(base.join(present, "up", "left").select("key", "tree", "node", F.when(F.col("there"), F.col("up")).alias("up"), "score"), "nodes")
    jumps: list[DataFrame] = []
    state = base.select("key", "up", "score", F.lit(1).cast("bigint").alias("depth"))
    open_before = -1
    while True:
        state = scratch.put(state, "reach")
        left = state.where("up is not null").count()
        if left in (0, open_before):
            break
        open_before = left
        jumps.append(state.where("up is not null").select("key", "up"))
        on = state.select(F.col("key").alias("up"), F.col("up").alias("up2"), F.col("score").alias("s2"), F.col("depth").alias("d2"))
        further = state.where("up is not null").join(on, "up").select(
            "key", F.col("up2").alias("up"), (F.col("score") + F.col("s2")).alias("score"), (F.col("depth") + F.col("d2")).alias("depth")
        )
        state = state.where("up is null").unionByName(further)  # what has reached its root is not joined again
    rooted = state.where("up is null").select("key", "score", "depth")
    parents = base.where("up is not null").select(F.col("up").alias("key")).distinct()
    leaves = base.select("key", "tree", "node").join(parents, "key", "left_anti").join(rooted, "key")
    order = Window.partitionBy("tree").orderBy(F.desc("score"), "node")
    leaves = leaves.withColumn("rank", F.row_number().over(order))
    if best is not None:
        leaves = leaves.where(F.col("rank") <= best)
    paths = leaves.select("tree", F.col("node").alias("leaf"), "rank", "score", "key", F.col("depth").alias("pos"))
    for k, jump in reversed(list(enumerate(jumps))):
        paths = scratch.put(paths, "paths")
        up = paths.join(jump, "key").select("tree", "leaf", "rank", "score", F.col("up").alias("key"), (F.col("pos") - (1 << k)).alias("pos"))
        paths = paths.unionByName(up)
    return paths


def format_trees(nodes: DataFrame, best: int | None = None, learn: str = "assistant") -> DataFrame:
    """One formatted conversation for each chosen path of nodes (tree, node, parent, role, text, score).

    Columns: tree, leaf, rank, score, formatted, loss_spans (half-open code point ranges of the escaped texts of
    role learn). Null texts and roles are empty. Extra columns are not read; an empty table gives no rows. A
    path is one row, so a task holds the longest conversation. Of rows that repeat a node, that with the smallest parent,
    score, role and text counts. See reply_paths() for trees.
    """
    scratch = Scratch(nodes.sparkSession, "chat")
    paths = reply_paths(nodes.select("tree", "node", "parent", "score"), scratch, best)
    # Of rows that repeat a node, the one whose parent counts in reply_paths().
    up = F.when(F.col("parent").isNotNull(), _key("tree", "parent"))
    own = F.struct(up.isNull(), up, F.coalesce(F.col("score").cast("double"), F.lit(0.0)), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    said = nodes.where("node is not null").groupBy(_key("tree", "node").alias("key")).agg(F.min(own).alias("x")).select("key", "x.role", "x.text")
    head = F.concat(F.lit(START), F.url_encode("role"), F.lit("\n"))
    rows = paths.join(said, "key").select(
        "tree", "leaf", "rank", "score", "pos", "role", head.alias("head"), escape(F.col("text")).alias("body")
    ).withColumn("piece", F.concat("head", "body", F.lit(END + "\n")))
    before = Window.partitionBy("tree", "leaf").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    at = F.coalesce(F.sum(F.length("piece").cast("bigint")).over(before), F.lit(0)) + F.length("head")
    rows = rows.withColumn("at", at).select(
        "tree", "leaf", "rank", "score",
        F.struct("pos", "piece", F.when(F.col("role") == learn, F.struct(F.col("at").alias("start"), (F.col("at") + F.length("body")).alias("end"))).alias("span")).alias("x"),
    )
    grouped = rows.groupBy("tree", "leaf", "rank", "score").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    return grouped.select(
        "tree", "leaf", "rank", "score", F.array_join(F.transform("xs", lambda x: x["piece"]), "").alias("formatted"),
        F.filter(F.transform("xs", lambda x: x["span"]), lambda s: s.isNotNull()).alias("loss_spans"),
    )


def read_back(formatted: Column, loss_spans: Column) -> tuple[Column, Column]:
    """(turns: array of role and text, text under the loss mask), both unescaped, from the formatted output alone."""
    pieces = F.slice(F.split(formatted, r"<\|im_start\|>"), 2, F.greatest(F.size(F.split(formatted, r"<\|im_start\|>")) - 1, F.lit(0)))
    turn = lambda p: F.struct(
        F.url_decode(F.substring_index(p, "\n", 1)).alias("role"),
        unescape(F.substring_index(F.substring(p, F.instr(p, "\n") + 1, F.length(p)), END, 1)).alias("text"),
    )
    masked = F.transform(loss_spans, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))
    return F.transform(pieces, turn), F.array_join(masked, "")


def linear_trees(turns: DataFrame, tree_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """A table of turns as reply trees: each row answers the one before it; ties are ordered by role, then text."""
    base = turns.select(F.col(tree_col).alias("tree"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    n = F.row_number().over(Window.partitionBy("tree").orderBy("turn", "role", "text"))
    return base.withColumn("node", n).select(
        "tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.length("text").cast("double").alias("score")
    )


ORACLE = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
e AS (SELECT *, replace(replace(text, '\\', '\\\\'), '<|', '<\\|') AS body FROM t)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum({len(START)} + length(role) + 1 + length(body) + {len(END)} + 1)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
