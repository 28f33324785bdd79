"""Chat formatting of reply trees.

Messages form trees by parent ids. Iterative self-joins enumerate the root-to-leaf paths by doubling: every message
knows its ancestor at a distance of 1, 2, 4 and so on, and every leaf, with the ancestors it has found so far, asks each
of them for the one that much further up. Rounds thus grow with the logarithm of the depth, and rows with the length of
the paths. Paths are ranked in their conversation by score and the chosen ones are formatted as one text each, with the
spans that carry loss.

Template: a turn is ``### Role: text </turn>`` and a line feed. Texts are escaped so that neither mark can appear in
them: a backslash is doubled, ``##`` becomes ``#\\#`` and ``</`` becomes ``<\\/``; taking every backslash away that is
not itself escaped gives the text back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracelake.session import cut

HEAD, COLON, END = "### ", ": ", " </turn>\n"
LOSS_ROLE = "assistant"


def escape(text: Column) -> Column:
    """A text in which no control string of the template can be found."""
    t = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(t, F.lit("##"), F.lit("#\\#")), F.lit("</"), F.lit("<\\/"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\\#/])", "$1")


def escape_role(role: Column) -> Column:
    """Roles also hide the mark that ends them."""
    return F.replace(escape(role), F.lit(": "), F.lit(":\\/ "))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit(":\\/ "), F.lit(": ")))


def chain_by_turn(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Reply trees (conv, node, parent, role, text, score) of conversations whose rows follow each other by turn.

    Rows with equal turns follow by role, then text; repeated rows each stay a turn. Rows with a null conversation id
    make a conversation of their own. Scores are 0.
    """
    order = W.partitionBy("conv").orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    rows = messages.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    rows = rows.withColumn("node", F.row_number().over(order).cast("long"))
    return rows.select("conv", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def _key(col: str) -> Column:
    """Null conversations meet each other in joins too."""
    return F.coalesce(F.col(col).cast("string"), F.lit("\0"))


def paths(tree: DataFrame) -> DataFrame:
    """(ck, conv, leaf, node, up): every message of every root-to-leaf path, with its distance from the leaf.

    A message whose parent is missing is a root. A cycle of parents that leads to a leaf raises; one without a leaf
    gives no path.
    """
    slim = cut(tree.select(_key("conv").alias("ck"), "conv", "node", "parent"))
    there = slim.select("ck", F.col("node").alias("above"))
    links = slim.where(F.col("parent").isNotNull())
    far = cut(links.join(there, (links["ck"] == there["ck"]) & (F.col("parent") == F.col("above"))).select(links["ck"], "node", "above"))
    leaves = slim.join(links.select("ck", F.col("parent").alias("node")).distinct(), ["ck", "node"], "left_anti")
    steps = leaves.select("ck", "conv", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("up"))
    size, most = 1, slim.count()
    while not far.isEmpty():
        if size > most:  # no path is as long
            if steps.where(F.col("up") >= most).isEmpty():
                break
            raise ValueError("a reply tree has a cycle")
        step = far.select(F.col("ck").alias("ck2"), F.col("node").alias("n2"), "above")
        more = steps.join(step, (F.col("ck") == F.col("ck2")) & (F.col("node") == F.col("n2")))
        steps = cut(steps.unionByName(more.select("ck", "conv", "leaf", F.col("above").alias("node"), (F.col("up") + size).alias("up"))))
        on = far.select("ck", "node", F.col("above").alias("mid"))
        far = cut(on.join(step, (F.col("ck") == F.col("ck2")) & (F.col("mid") == F.col("n2"))).select("ck", "node", "above"))
        size *= 2
    return steps


def format_conversations(tree: DataFrame, top: int = 1, loss_role: str = LOSS_ROLE) -> DataFrame:
    """(conv, leaf, rank, formatted, loss_spans): the top paths of every conversation, best score first.

    tree: conv, node, parent, role, text, score; (conv, node) is unique. Ties go to the smaller leaf. loss_spans are
    (start, length) in code points of formatted, one a loss-role turn, around its escaped text. Null texts and roles
    are empty. An empty table gives an empty result.
    """
    rank = F.row_number().over(W.partitionBy("ck").orderBy(F.col("score").desc(), "leaf"))
    words = tree.select(_key("conv").alias("ck"), "node", escape_role(F.col("role")).alias("r"), escape(F.col("text")).alias("t"), (F.col("role") == loss_role).alias("loss"))
    steps = paths(tree)
    worth = tree.select(_key("conv").alias("ck"), "node", F.coalesce("score", F.lit(0.0)).alias("s"))
    scores = steps.join(worth, ["ck", "node"]).groupBy("ck", "leaf").agg(F.sum("s").alias("score"))
    chosen = scores.withColumn("rank", rank).where(F.col("rank") <= top).select("ck", "leaf", "rank")
    turns = steps.join(chosen, ["ck", "leaf"]).withColumn("at", -F.col("up")).join(words, ["ck", "node"])
    mark = F.concat(F.lit(HEAD), F.col("r"), F.lit(COLON))
    turns = turns.select("ck", "leaf", "rank", "conv", "at", F.coalesce("loss", F.lit(False)).alias("loss"), F.length(mark).alias("before"), F.length("t").alias("size"), F.concat(mark, F.col("t"), F.lit(END)).alias("part"))
    # where a turn's text begins: the lengths of all turns before it, added up row by row
    path = W.partitionBy("ck", "leaf").orderBy("at")
    sums = F.coalesce(F.sum(F.length("part")).over(path.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    turns = turns.withColumn("span", F.when(F.col("loss"), F.struct((sums + F.col("before")).cast("int").alias("start"), F.col("size").alias("length"))))
    lines = turns.groupBy("ck", "leaf").agg(F.first("rank").alias("rank"), F.first("conv").alias("conv"), F.array_sort(F.collect_list(F.struct("at", "part", "span"))).alias("turns"))
    spans = F.filter(F.transform("turns", lambda x: x["span"]), lambda s: s.isNotNull())
    return lines.select("conv", "leaf", "rank", F.array_join(F.transform("turns", lambda x: x["part"]), "").alias("formatted"), spans.alias("loss_spans"))


def read_back(formatted: Column) -> Column:
    """The turns, as an array of (role, text), of a formatted conversation."""
    parts = F.filter(F.split(formatted, END, -1), lambda p: p != "")
    body = lambda p: F.substr(p, F.lit(len(HEAD) + 1))
    role = lambda p: F.substring_index(body(p), COLON, 1)
    text = lambda p: F.substr(body(p), F.length(role(p)) + 1 + len(COLON))
    return F.transform(parts, lambda p: F.struct(unescape_role(role(p)).alias("role"), unescape(text(p)).alias("text")))


def conversation_digests(formatted: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), read back from the output alone."""
    df = formatted.withColumn("_turns", read_back(F.col("formatted")))
    told = F.array_join(F.transform("_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    # in four bytes a code point a span is found without counting from the start; the outer array holds the one conversion
    cut_out = lambda b: F.transform("loss_spans", lambda s: unescape(F.decode(F.substring(b, 4 * s["start"] + 1, 4 * s["length"]), "UTF-32")))
    lost = F.array_join(F.flatten(F.transform(F.array(F.encode("formatted", "UTF-32")), cut_out)), "")
    df = df.withColumn("_loss", lost)
    return df.select(
        F.col("conv").alias("conv_id"),
        F.size("_turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length("_loss").cast("long").alias("loss_chars"),
        F.sha2("_loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
