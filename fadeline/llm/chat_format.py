"""Chat formatting: reply trees to root-to-leaf paths, paths to marked-up conversations. JVM only.

A tree is a set of messages with parents. Iterative self-joins double every message's jump to its
ancestors, so depth and path score of all leaves are known after log2(depth) joins; leaves are ranked by
score, and the chosen ones' ancestors are gathered by the same jumps, largest number of messages once each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fadeline.llm._common import delete, discard, settle

OPEN, END = "### ", "</turn>"


def escape(text: Column) -> Column:
    r"""Reversibly take control strings apart: ``\`` -> ``\\``, ``#`` -> ``\#``, ``</`` -> ``<\/``.

    No escaped text holds ``###`` or ``</``, so the template's own marks are the only ones."""
    return F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("#"), F.lit("\\#")), F.lit("</"), F.lit("<\\/"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def best_paths(messages: DataFrame, branches: int = 1) -> DataFrame:
    """Messages of the ``branches`` best root-to-leaf paths of every tree, once for each path.

    ``messages(tree, node, parent, score, ...)``; the result has ``branch`` (1 is best) and ``depth``
    (1 is the root) as well. A path's score is the mean of its messages' scores (null counts 0);
    equal scores: the longer path, then the smaller leaf. A parent that doesn't occur makes its
    child a root. Of rows that repeat (tree, node), the smallest is taken. Messages that hang on a
    cycle are on no root-to-leaf path and are left out. A null tree or node is left out as well.
    """
    once = messages.filter("tree IS NOT NULL AND node IS NOT NULL")
    rest = [c for c in once.columns if c not in ("tree", "node")]
    once = settle(once.groupBy("tree", "node").agg(F.min(F.struct(*rest)).alias("x")).select("tree", "node", "x.*"))
    key = once.select("tree", F.col("node").alias("up"))
    at = (once.select("tree", "node", F.col("parent").alias("up"), F.coalesce("score", F.lit(0.0)).cast("double").alias("total"))
          .join(key.withColumn("real", F.lit(True)), ["tree", "up"], "left")
          .select("tree", "node", F.when(F.col("real"), F.col("up")).alias("up"), F.lit(1).cast("bigint").alias("depth"), "total"))
    jumps, tables, left = [], [once], None
    while True:
        at = settle(at)
        tables.append(at)
        jumps.append(at.select("tree", "node", "up"))
        now = at.filter("up IS NOT NULL").count()
        if not now or now == left:  # all have arrived, or what is left goes round in circles
            break
        left = now
        far = at.select("tree", F.col("node").alias("up"), F.col("up").alias("far"), F.col("depth").alias("d"), F.col("total").alias("t"))
        going = at.filter("up IS NOT NULL").join(far, ["tree", "up"]).select("tree", "node", F.col("far").alias("up"), (F.col("depth") + F.col("d")).alias("depth"), (F.col("total") + F.col("t")).alias("total"))
        at = at.filter("up IS NULL").unionByName(going)  # messages that have reached their root wait
    leaves = at.filter("up IS NULL").join(once.select("tree", F.col("parent").alias("node")).distinct(), ["tree", "node"], "left_anti")
    rank = F.row_number().over(Window.partitionBy("tree").orderBy(F.desc(F.col("total") / F.col("depth")), F.desc("depth"), "node"))
    path = leaves.withColumn("branch", rank).filter(F.col("branch") <= branches).select("tree", "branch", "node")
    for jump in jumps[:-1]:
        path = settle(path.unionByName(path.join(jump.filter("up IS NOT NULL"), ["tree", "node"]).select("tree", "branch", F.col("up").alias("node"))).distinct())
        tables.append(path)
    path = settle(path.join(at.select("tree", "node", "depth"), ["tree", "node"]).join(once, ["tree", "node"]))
    delete(*tables)
    return path


def format_turns(turns: DataFrame, key: list[str], order: list[str], loss_role: str = "assistant") -> DataFrame:
    """One row for each ``key``: ``formatted`` and ``loss_spans`` (array of start, end in characters).

    ``turns`` has role and text; nulls count as empty. A turn is ``### Role: text</turn>`` and a line
    feed; its mask covers the (escaped) text alone, for roles equal to ``loss_role``.
    """
    role = escape(F.coalesce("role", F.lit("")))
    head = F.concat(F.lit(OPEN), F.replace(role, F.lit(":"), F.lit("\\:")), F.lit(": "))
    body = escape(F.coalesce("text", F.lit("")))
    parts = turns.select(*key, *order, "role", head.alias("head"), body.alias("body"))
    parts = parts.select(*key, F.struct(*order, F.col("head"), F.col("body"), (F.coalesce("role", F.lit("")) == loss_role).alias("loss"),
                                        (F.length("head") + F.length("body") + len(END) + 1).cast("bigint").alias("size")).alias("turn"))
    w = Window.partitionBy(*key).orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("at", F.coalesce(F.sum("turn.size").over(w), F.lit(0)))
    rows = parts.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("at", "turn"))).alias("turns"))
    shown = F.transform("turns", lambda x: F.concat(x["turn"]["head"], x["turn"]["body"], F.lit(END + "\n")))
    spans = F.transform(F.filter("turns", lambda x: x["turn"]["loss"]),
                        lambda x: F.struct((x["at"] + F.length(x["turn"]["head"])).alias("start"), (x["at"] + F.length(x["turn"]["head"]) + F.length(x["turn"]["body"])).alias("end")))
    return rows.select(*key, F.array_join(shown, "").alias("formatted"), spans.alias("loss_spans"))


def parse(formatted: Column) -> Column:
    """Turns (array of role, text) read back from a formatted conversation; roles and texts may be of any length."""
    turns = F.filter(F.split(formatted, END + "\n", -1), lambda x: x != "")
    # a colon within a role stands behind a backslash of its own; blanked out in pairs, only the mark's colon is left
    plain = lambda x: F.replace(F.replace(x, F.lit("\\\\"), F.lit("\0\0")), F.lit("\\:"), F.lit("\0\0"))
    cuts = F.transform(turns, lambda x: F.struct(x.alias("x"), F.instr(plain(x), ": ").alias("colon")))
    part = lambda c, at, size: F.substring(c["x"], at, size)
    return F.transform(cuts, lambda c: F.struct(unescape(part(c, F.lit(len(OPEN) + 1), c["colon"] - len(OPEN) - 1)).alias("role"), unescape(part(c, c["colon"] + 2, F.length(c["x"]))).alias("text")))


def under_mask(formatted: Column, spans: Column) -> Column:
    """The unescaped text under the loss mask, in order, nothing between."""
    cut = F.transform(spans, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))
    return F.array_join(cut, "")


def format_conversations(rows: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_spans) of ``rows(conv_id, turn, role, text)``.

    A conversation is a reply tree in which each row answers the one before it, by turn; equal turns
    go by role and text, null turns first. Repeated rows stay turns of their own. Null ids form one conversation.
    An empty table gives an empty one; other columns are ignored. Paths are found among messages without their
    texts; these are shuffled for their places only, where those of a conversation come together anyway, twice in all.
    """
    tree = F.coalesce(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.lit("null"))
    place = F.row_number().over(Window.partitionBy("tree").orderBy("turn", "role", "text")).cast("bigint")
    messages = rows.select(tree.alias("tree"), "conv_id", "turn", "role", "text").withColumn("node", place)
    slim = settle(messages.select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), F.lit(0.0).alias("score")))
    path = best_paths(slim)
    left_out = settle(slim.join(path.select("tree", "node"), ["tree", "node"], "left_anti").select("tree", "node"))
    discard(slim, path)  # the places' shuffle goes as well
    chosen = messages if left_out.isEmpty() else messages.join(left_out, ["tree", "node"], "left_anti")
    return format_turns(chosen.select("tree", "conv_id", "node", "role", "text"), ["tree", "conv_id"], ["node"]).drop("tree")
