"""Chat formatting: reply trees become root-to-leaf conversations with a reversible template and a loss mask.

Messages form trees. Pointer-doubling self-joins enumerate the path from every leaf to its root in
log2(depth) rounds over ids alone; branches are ranked by mean score, and only the chosen paths fetch texts.

Defined results. Null text counts as empty, null role as an empty role. A parent that does not exist makes its
child a root; messages on a parent cycle have no root and are left out. Repeated (tree, message) ids keep the
smallest (role, text). Ties between branches fall to the longer path, then the smaller leaf id. A null tree id
is a tree of its own. An empty table gives no rows. Columns other than those named are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import materialize, running_sum

OPEN, SEP, CLOSE = "### ", ": ", "</turn>\n"
#: A backslash goes in front of every backslash, of the slash in a closing mark and of inner hashes of a run of three.
ESCAPED = r"(\\|(?<=<)/(?=turn>)|(?<=#)#(?=#))"


def escape(text: Column) -> Column:
    """No escaped text holds the closing mark or three hashes in a row; unescape gives the text back exactly."""
    return F.regexp_replace(text, ESCAPED, r"\\$1")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def escape_role(role: Column) -> Column:
    """As escape, and a colon becomes backslash-c, so the first colon of a turn ends its role."""
    return F.replace(escape(role), F.lit(":"), F.lit("\\c"))


def unescape_role(role: Column) -> Column:
    parts = F.split(role, r"\\\\", -1)
    return F.array_join(F.transform(parts, lambda p: F.replace(F.replace(p, F.lit("\\c"), F.lit(":")), F.lit("\\"), F.lit(""))), "\\")


def reply_paths(messages: DataFrame) -> DataFrame:
    """All root-to-leaf paths of messages(tree, msg, parent): rows (tree, leaf, node, up), up = steps above the leaf.

    Round k knows every ancestor 2**k steps up and doubles the known part of each path, so a chain of n messages
    takes log2(n) joins. Rows are ids only and their number is the total length of all paths.
    """
    nodes = materialize(messages.select("tree", "msg", "parent").dropDuplicates(["tree", "msg"]), "reply-nodes")
    have = nodes.select("tree", F.col("msg").alias("parent"))
    jump = nodes.where("parent is not null").join(have, ["tree", "parent"], "left_semi").select("tree", "msg", F.col("parent").alias("anc"))
    leaves = nodes.join(jump.select("tree", F.col("anc").alias("msg")), ["tree", "msg"], "left_anti")
    paths = leaves.select("tree", F.col("msg").alias("leaf"), F.col("msg").alias("node"), F.lit(0).cast("long").alias("up"))
    paths, jump, step, limit = materialize(paths, "reply-paths"), materialize(jump, "reply-jump"), 1, None
    while (left := jump.count()) > 0:
        limit = limit or 2 * left  # no tree is deeper than its messages; pointers left beyond that lie on cycles
        if step > limit:
            cyclic = jump.select("tree", F.col("msg").alias("node")).distinct()
            bad = paths.join(cyclic, ["tree", "node"], "left_semi").select("tree", "leaf").distinct()
            return paths.join(bad, ["tree", "leaf"], "left_anti")
        far = jump.select("tree", F.col("msg").alias("node"), "anc")
        more = paths.join(far, ["tree", "node"]).select("tree", "leaf", F.col("anc").alias("node"), (F.col("up") + step).alias("up"))
        paths = materialize(paths.unionByName(more), "reply-paths")
        onward = jump.select("tree", F.col("msg").alias("anc"), F.col("anc").alias("anc2"))
        jump = materialize(jump.join(onward, ["tree", "anc"]).select("tree", "msg", F.col("anc2").alias("anc")), "reply-jump")
        step *= 2
    return paths


def format_conversations(messages: DataFrame, per_tree: int = 1) -> DataFrame:
    """One row per chosen path: tree, leaf, path_rank, path_score, formatted, loss_spans.

    messages(tree, msg, parent, role, text, score). loss_spans holds [start, end) code-point offsets of the
    escaped assistant texts inside formatted.
    """
    text = F.coalesce("text", F.lit(""))
    once = messages.groupBy("tree", "msg").agg(F.min(F.struct(F.coalesce("role", F.lit("")).alias("role"), text.alias("text"), "parent", "score")).alias("x"))
    once = once.select("tree", "msg", "x.*")
    paths = reply_paths(once)
    scored = paths.join(once.select("tree", F.col("msg").alias("node"), "score"), ["tree", "node"])
    best = scored.groupBy("tree", "leaf").agg(F.avg(F.coalesce("score", F.lit(0.0))).alias("path_score"), F.count("*").alias("n"))
    order = Window.partitionBy("tree").orderBy(F.desc("path_score"), F.desc("n"), "leaf")
    best = best.withColumn("path_rank", F.row_number().over(order)).where(F.col("path_rank") <= per_tree)
    chosen = paths.join(best, ["tree", "leaf"]).join(once.select("tree", F.col("msg").alias("node"), "role", "text"), ["tree", "node"])
    turns = chosen.groupBy("tree", "leaf", "path_rank", "path_score").agg(F.array_sort(F.collect_list(F.struct((-F.col("up")).alias("pos"), "role", "text"))).alias("turns"))
    turns = turns.withColumn("parts", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), F.concat(F.lit(OPEN), escape_role(t["role"]), F.lit(SEP)).alias("head"), escape(t["text"]).alias("body"))))
    formatted = F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"], F.lit(CLOSE))), "")
    turns = turns.withColumn("starts", running_sum(F.transform("parts", lambda p: (F.length(p["head"]) + F.length(p["body"]) + len(CLOSE)).cast("long"))))
    spans = F.zip_with("parts", "starts", lambda p, at: F.struct(p["role"].alias("role"), (at + F.length(p["head"])).alias("start"), (at + F.length(p["head"]) + F.length(p["body"])).alias("end")))
    spans = F.transform(F.filter(spans, lambda s: s["role"] == "assistant"), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    return turns.select("tree", "leaf", "path_rank", "path_score", formatted.alias("formatted"), spans.alias("loss_spans"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Adds turns (array of role, text), parsed from formatted alone, and loss_texts, cut out by loss_spans alone."""
    pieces = F.filter(F.split("formatted", CLOSE, -1), lambda p: p != "")
    body = lambda p: F.substring(p, len(OPEN) + 1, 2**31 - 1)
    colon = lambda p: F.instr(body(p), SEP[0])
    turns = F.transform(pieces, lambda p: F.struct(unescape_role(F.substring(body(p), F.lit(1), colon(p) - 1)).alias("role"), unescape(F.substring(body(p), colon(p) + len(SEP), F.lit(2**31 - 1))).alias("text")))
    cut = F.transform("loss_spans", lambda s: unescape(F.substring("formatted", (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))
    return formatted.withColumns({"turns": turns, "loss_texts": cut})


def conversation_messages(conversations: DataFrame) -> DataFrame:
    """Flat conversations as trees of one branch: rows ordered by turn (nulls first), ties by role, then text."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    return conversations.select(
        F.to_json(F.struct("conv_id")).alias("tree"), "conv_id", F.row_number().over(order).cast("long").alias("msg"), "role", "text"
    ).select("tree", "conv_id", "msg", F.when(F.col("msg") > 1, F.col("msg") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))
