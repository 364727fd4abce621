"""Reply trees as conversations: root-to-leaf paths by iterative self-joins, ranked, formatted with a loss mask.

Built-in expressions only. Every node's ancestor 1, 2, 4, ... replies up is found by joining the previous step with
itself, and each leaf collects its path in as many rounds as the depth has binary digits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from subweave.llm.shared import dropped, written

START, END = "<|im_start|>", "<|im_end|>\n"
# fixed values: strings that mean something to common chat templates; inside a text each gets a backslash after its first character
CONTROL = ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")


def escaped(text: Column) -> Column:
    """Doubles backslashes, then breaks every control string with a single one, so a lone backslash inside one says that it was broken."""
    out = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    for c in CONTROL:
        out = F.replace(out, F.lit(c), F.lit(c[0] + "\\" + c[1:]))
    return out


def unescaped(text: Column) -> Column:
    out = text
    for c in reversed(CONTROL):
        out = F.replace(out, F.lit(c[0] + "\\" + c[1:]), F.lit(c))
    return F.replace(out, F.lit("\\\\"), F.lit("\\"))


def escaped_role(role: Column) -> Column:
    """As for texts; a line feed, which ends the role in the template, becomes a mark of its own."""
    return F.replace(escaped(role), F.lit("\n"), F.lit("[\\nl]"))


def unescaped_role(role: Column) -> Column:
    return unescaped(F.replace(role, F.lit("[\\nl]"), F.lit("\n")))


def reply_paths(nodes: DataFrame) -> DataFrame:
    """All root-to-leaf paths of trees of replies.

    nodes: conv (any type), node long (unique in its conv), parent long (null for roots). A parent that isn't there makes
    its replies roots. Returns conv, leaf, node, up (0 for the leaf, growing to the root). Null conv is a tree like any
    other. Replies that go round in a circle are an error.
    """
    n = nodes.select("conv", "node", "parent")
    own = n.select(F.col("conv").alias("pc"), F.col("node").alias("pn"))
    jump = n.join(own, F.col("conv").eqNullSafe(F.col("pc")) & (F.col("parent") == F.col("pn")), "left_semi").select("conv", "node", F.col("parent").alias("above"))
    jump = written(jump, "replies")
    inner = jump.select(F.col("conv").alias("pc"), F.col("above").alias("pn")).distinct()
    leaves = n.join(inner, F.col("conv").eqNullSafe(F.col("pc")) & (F.col("node") == F.col("pn")), "left_anti")
    paths = written(leaves.select("conv", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("up")), "paths")
    step, total = 1, nodes.count()
    while not jump.isEmpty():
        if step > max(total, 1):
            raise ValueError("replies go round in a circle")
        link = jump.select(F.col("conv").alias("jc"), F.col("node").alias("jn"), "above")
        further = paths.join(link, F.col("conv").eqNullSafe(F.col("jc")) & (F.col("node") == F.col("jn"))).select("conv", "leaf", F.col("above").alias("node"), (F.col("up") + step).alias("up"))
        more = written(paths.union(further), "paths")
        twice = jump.join(link.withColumnRenamed("above", "top"), F.col("conv").eqNullSafe(F.col("jc")) & (F.col("above") == F.col("jn"))).select("conv", "node", F.col("top").alias("above"))
        twice = written(twice, "replies")
        dropped(paths, jump)
        paths, jump, step = more, twice, 2 * step
    return paths


def format_conversations(nodes: DataFrame, best: int | None = None) -> DataFrame:
    """Formats the best paths of each tree of replies.

    nodes: conv, node long, parent long, role string, text string, score double; other columns are ignored. A path's score is the mean of
    its nodes' scores (null counts as 0); paths are ranked by it, ties to the smaller leaf; best: so many of each conv
    are kept (None: all). Null texts and roles are as empty.
    Returns conv, leaf long, rank int, score double, formatted string, loss array<struct<start long, length long>>: where
    the assistants' texts stand in formatted, in code points from 0. An empty table gives an empty result.
    """
    paths = reply_paths(nodes)
    said = nodes.select(F.col("conv").alias("nc"), F.col("node").alias("nn"), "role", "text", F.coalesce("score", F.lit(0.0)).alias("score"))
    match = F.col("conv").eqNullSafe(F.col("nc")) & (F.col("node") == F.col("nn"))
    best_first = F.row_number().over(Window.partitionBy("conv").orderBy(F.col("path_score").desc(), "leaf"))
    if best is not None:  # the texts of the other paths are not read
        scores = paths.join(said.select("nc", "nn", "score"), match).groupBy("conv", "leaf").agg(F.array_sort(F.collect_list(F.struct((-F.col("up")).alias("at"), "score"))).alias("turns"))
        kept = scores.select("conv", "leaf", _path_score("turns").alias("path_score")).withColumn("rank", best_first).where(F.col("rank") <= best)
        kept = kept.select(F.col("conv").alias("kc"), F.col("leaf").alias("kl"))
        paths = paths.join(kept, F.col("conv").eqNullSafe(F.col("kc")) & (F.col("leaf") == F.col("kl")), "left_semi")
    role, body = escaped_role(F.col("role")), escaped(F.col("text"))
    turns = paths.join(said, match).select("conv", "leaf", "up", "score", F.coalesce(F.col("role") == "assistant", F.lit(False)).alias("learn"), F.concat(F.lit(START), role, F.lit("\n")).alias("head"), body.alias("body"))
    turns = turns.withColumn("size", (F.length("head") + F.length("body") + len(END)).cast("long"))
    before = Window.partitionBy("conv", "leaf").orderBy(F.col("up").desc()).rowsBetween(Window.unboundedPreceding, -1)
    turns = turns.withColumn("at", F.coalesce(F.sum("size").over(before), F.lit(0).cast("long")))
    turn = F.struct("at", F.concat("head", "body", F.lit(END)).alias("piece"), "learn", (F.col("at") + F.length("head")).alias("start"), F.length("body").cast("long").alias("length"), "score")
    whole = turns.groupBy("conv", "leaf").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    whole = whole.select(
        "conv",
        "leaf",
        _path_score("turns").alias("path_score"),
        F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("formatted"),
        F.transform(F.filter("turns", lambda t: t["learn"]), lambda t: F.struct(t["start"].alias("start"), t["length"].alias("length"))).alias("loss"),
    )
    return whole.withColumn("rank", best_first).select("conv", "leaf", "rank", F.col("path_score").alias("score"), "formatted", "loss")


def _path_score(turns: str) -> Column:
    """Mean score of a path's turns, added from the root on, so that it doesn't vary with the order in which rows arrive."""
    return F.aggregate(turns, F.lit(0.0), lambda sum_, t: sum_ + t["score"]) / F.size(turns)


def read_back(formatted: Column) -> Column:
    """array<struct<role, text>> of a formatted conversation."""
    pieces = F.slice(F.split(formatted, r"<\|im_start\|>"), 2, 1 << 30)

    def turn(piece: Column) -> Column:
        role = F.substring_index(piece, "\n", 1)
        text = F.substr(piece, F.length(role) + 2, F.length(piece) - F.length(role) - 1 - len(END))
        return F.struct(unescaped_role(role).alias("role"), unescaped(text).alias("text"))

    return F.transform(pieces, turn)


def masked_text(formatted: Column, loss: Column) -> Column:
    """The unescaped texts under the loss mask, one after the other."""
    return F.array_join(F.transform(loss, lambda s: unescaped(F.substr(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")


def linear_replies(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Conversations without branches as trees: each turn replies to the one before.

    Turns are ordered by number, null first; equal numbers by role and text, so repeated rows are turns of their own.
    """
    t = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"))
    node = F.row_number().over(Window.partitionBy("conv").orderBy("turn", "role", "text")).cast("long")
    t = t.withColumn("node", node)
    return t.select("conv", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))
