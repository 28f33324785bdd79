"""Facts and rules: node tables folded to facts, and a table of predicates evaluated over facts in one scan."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracelake.session import cut


@dataclass(frozen=True)
class Rule:
    """A predicate over a fact row, as SQL text, and what to do about rows that meet it."""

    rule_id: str
    predicate: str
    decision: str = "context"
    message: str = ""
    base: str | None = None


def json_nodes(df: DataFrame, id_col: str, json: str) -> DataFrame:
    """(id, path, key, kind, value): the nodes of a JSON column, level by level until none is left."""
    start = df.select(F.col(id_col).alias("id"), F.lit("$").alias("path"), F.lit(None).cast("string").alias("key"), F.try_parse_json(json).alias("v")).where(F.col("v").isNotNull())
    levels, cur = [start], start
    while True:
        cur = cut(_deeper(cur))
        if cur.isEmpty():
            break
        levels.append(cur)
    every = levels[0]
    for level in levels[1:]:
        every = every.unionByName(level)
    kind = F.regexp_extract(F.schema_of_variant("v"), r"^(\w+)", 1)
    return every.select("id", "path", "key", kind.alias("kind"), F.when(~kind.isin("OBJECT", "ARRAY"), F.try_variant_get("v", "$", "string")).alias("value"))


def _deeper(level: DataFrame) -> DataFrame:
    """The members of objects and the elements of arrays, one level down."""
    as_map = F.try_variant_get("v", "$", "map<string,variant>")
    as_list = F.try_variant_get("v", "$", "array<variant>")
    members = level.select("id", "path", F.explode(as_map).alias("key", "nv")).select("id", F.concat("path", F.lit("."), "key").alias("path"), "key", F.col("nv").alias("v"))
    elements = level.select("id", "path", F.posexplode(as_list).alias("i", "nv")).select("id", F.concat("path", F.lit("["), "i", F.lit("]")).alias("path"), F.col("i").cast("string").alias("key"), F.col("nv").alias("v"))
    return members.unionByName(elements)


def ancestors(nodes: DataFrame) -> DataFrame:
    """(tree_id, node_id, anc_id, anc_tag, up): every ancestor of every node, up levels above it.

    Found by doubling: rows are as many as the nodes' depths together, and rounds grow with the logarithm of the depth.
    """
    far = cut(nodes.where(F.col("parent_id").isNotNull()).select("tree_id", "node_id", F.col("parent_id").alias("anc_id")))
    every, size = far.withColumn("up", F.lit(1)), 1
    while not far.isEmpty():
        step = far.select("tree_id", F.col("node_id").alias("anc_id"), F.col("anc_id").alias("above"))
        on = every.join(step, ["tree_id", "anc_id"]).select("tree_id", "node_id", F.col("above").alias("anc_id"), (F.col("up") + size).alias("up"))
        every = cut(every.unionByName(on))
        far = cut(far.join(step, ["tree_id", "anc_id"]).select("tree_id", "node_id", F.col("above").alias("anc_id")))
        size *= 2
    return every.join(nodes.select("tree_id", F.col("node_id").alias("anc_id"), F.col("tag").alias("anc_tag")), ["tree_id", "anc_id"]).select("tree_id", "node_id", "anc_id", "anc_tag", "up")


def node_context(nodes: DataFrame) -> DataFrame:
    """nodes' ids with the tags above them, outermost first."""
    a = ancestors(nodes).groupBy("tree_id", "node_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("up")).alias("at"), "anc_tag"))), lambda x: x["anc_tag"]), "/").alias("above"))
    return nodes.select("tree_id", "node_id", "tag").join(a, ["tree_id", "node_id"], "left").withColumn("above", F.coalesce("above", F.lit("")))


def statement_facts(nodes: DataFrame) -> DataFrame:
    """Per statement (id) over json_nodes: its nodes, leaves and deepest level, the distinct keys, and whether it holds a null or a list."""
    level = F.size(F.split("path", r"[.\[]"))
    leaf = ~F.col("kind").isin("OBJECT", "ARRAY")
    return nodes.groupBy("id").agg(
        F.count("*").alias("nodes"), F.count_if(leaf).alias("leaves"), F.max(level).cast("long").alias("depth"),
        F.array_join(F.array_sort(F.collect_set("key")), ",").alias("keys"), F.bool_or(F.col("kind").isin("VOID")).alias("has_null"), F.bool_or(F.col("kind") == "ARRAY").alias("has_list"),
    )


def call_facts(statements: DataFrame, call: Sequence[str], lists: Sequence[str] = (), flags: Sequence[str] = (), largest: Sequence[str] = ()) -> DataFrame:
    """Statement facts folded to one row a call: lists joined and flattened to their distinct values, in order, flags or-ed, and the largest of the rest."""
    flat = lambda c: F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))), ",").alias(c)
    return statements.groupBy(*call).agg(*[flat(c) for c in lists], *[F.bool_or(c).alias(c) for c in flags], *[F.max(c).alias(c) for c in largest])


def tree_shape(nodes: DataFrame) -> DataFrame:
    """Per tree: nodes, depth, links, headings, and the most children of one node."""
    kids = nodes.where(F.col("parent_id").isNotNull()).groupBy("tree_id", "parent_id").agg(F.count("*").alias("_k")).groupBy("tree_id").agg(F.max("_k").alias("widest"))
    g = nodes.groupBy("tree_id").agg(F.count("*").alias("nodes"), F.max("depth").alias("depth"), F.count_if(F.col("tag") == "a").alias("links"), F.count_if(F.col("tag").rlike("^h[1-6]$")).alias("headings"))
    return g.join(kids, "tree_id", "left")


def chain_max(nodes: DataFrame, tag: str) -> DataFrame:
    """Per tree the most elements of one tag on a path from the root."""
    same = nodes.where(F.col("tag") == tag)
    over = ancestors(nodes).where(F.col("anc_tag") == tag).groupBy("tree_id", "node_id").agg(F.count("*").alias("_n"))
    own = same.select("tree_id", "node_id").join(over, ["tree_id", "node_id"], "left")
    return own.groupBy("tree_id").agg((F.max(F.coalesce("_n", F.lit(0))) + 1).alias("longest"))


def owners(nodes: DataFrame, tags: Sequence[str], holders: Sequence[str]) -> DataFrame:
    """Elements of tags with the nearest enclosing holder, or else the sibling before them."""
    a = ancestors(nodes).where(F.col("anc_tag").isin(*holders)).groupBy("tree_id", "node_id").agg(F.min_by("anc_id", "up").alias("holder"))
    before = nodes.withColumn("sibling", F.lag("node_id").over(W.partitionBy("tree_id", "parent_id").orderBy("node_id")))
    return before.where(F.col("tag").isin(*tags)).join(a, ["tree_id", "node_id"], "left").select("tree_id", "node_id", "tag", F.coalesce("holder", "sibling").alias("owner"))


def classify_words(words: DataFrame, value_flags: DataFrame) -> DataFrame:
    """words (call_id, command, pos, word) told apart: command, flag, flag value or positional, positionals numbered.

    value_flags: (command, flag) that take the next word as their value.
    """
    w = W.partitionBy("call_id").orderBy("pos")
    takes = value_flags.select("command", F.col("flag").alias("_before"), F.lit(True).alias("_takes"))
    t = words.withColumns({"_before": F.lag("word").over(w), "_first": F.row_number().over(w) == 1}).join(takes, ["command", "_before"], "left")
    is_flag = F.col("word").startswith("-")
    kind = F.when(F.col("_first"), "command").when(F.coalesce(F.col("_takes"), F.lit(False)), "flag_value").when(is_flag, "flag").otherwise("positional")
    t = t.withColumn("kind", kind)
    number = F.count_if(F.col("kind") == "positional").over(w.rowsBetween(W.unboundedPreceding, 0))
    return t.select("call_id", "command", "pos", "word", "kind", F.when(F.col("kind") == "positional", number).alias("number"))


def rule_catalog(rules: Sequence[Rule]) -> list[Rule]:
    """Rules with their aliases filled from the rule they are based on; an unknown base is an error."""
    by = {r.rule_id: r for r in rules}
    out = []
    for r in rules:
        if r.base is None:
            out.append(r)
        else:
            b = by[r.base]
            out.append(Rule(r.rule_id, r.predicate or b.predicate, r.decision or b.decision, r.message or b.message))
    return out


def _met(rules: Sequence[Rule]) -> Column:
    return F.array_compact(F.array(*[F.when(F.expr(r.predicate), F.struct(F.lit(i).alias("ord"), F.lit(r.rule_id).alias("rule_id"), F.lit(r.decision).alias("decision"), F.lit(r.message).alias("message"))) for i, r in enumerate(rules)]))


def evaluate_rules(facts: DataFrame, rules: Sequence[Rule], keys: Sequence[str]) -> DataFrame:
    """(keys, ord, rule_id, decision, message): one row a rule that a fact row meets; all rules in one scan, no shuffle."""
    return facts.select(*keys, F.explode(_met(rules)).alias("_h")).select(*keys, "_h.*")


def verdict_columns(facts: DataFrame, rules: Sequence[Rule], keys: Sequence[str]) -> DataFrame:
    """Per fact row the verdict of all rules without a shuffle; rows that meet none are left out. Works on streams."""
    t = facts.select(*keys, _met(rules).alias("_h")).where(F.size("_h") > 0)
    has = lambda d: F.exists("_h", lambda x: x["decision"] == d)
    return t.select(*keys, F.when(has("deny"), "deny").when(has("ask"), "ask").otherwise("context").alias("verdict"), F.array_join(F.transform("_h", lambda x: x["rule_id"]), ",").alias("reasons"))


def verdicts(hits: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row a call: deny before ask before context, with the reasons in rule order."""
    is_a = lambda d: F.bool_or(F.col("decision") == d)
    g = hits.groupBy(*keys).agg(is_a("deny").alias("_d"), is_a("ask").alias("_a"), F.array_sort(F.collect_list(F.struct("ord", "rule_id"))).alias("_r"))
    return g.select(*keys, F.when(F.col("_d"), "deny").when(F.col("_a"), "ask").otherwise("context").alias("verdict"), F.array_join(F.transform("_r", lambda x: x["rule_id"]), ",").alias("reasons"))


def gate(head: DataFrame, base: DataFrame, keys: Sequence[str], blocking: Sequence[str]) -> DataFrame:
    """Violations at head, new or existing against base, and whether they block."""
    j = head.join(base.select(*keys, F.lit(True).alias("_old")).distinct(), list(keys), "left")
    new = F.col("_old").isNull()
    return j.select(*head.columns, F.when(new, "new").otherwise("existing").alias("state"), (new & F.col("rule_id").isin(*blocking)).alias("blocked"))


def rule_precision(hits: DataFrame, corrected: str) -> DataFrame:
    """Per rule its hits and the share that the next prompt corrects."""
    return hits.groupBy("rule_id").agg(F.count("*").alias("n"), F.round(F.avg(F.col(corrected).cast("double")), 6).alias("corrected"))
