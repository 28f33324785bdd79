"""Conversation and activity analytics: blocks, pairing, sessions, turns and what is drawn from them."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracelake.operators.relational import contains_all, join_in_blocks
from tracelake.session import cut, share_code


def transcript_entries(files: DataFrame, kinds: DataFrame, path: str = "path") -> DataFrame:
    """files with the session id and the reader kind of each path; kinds: (prefix, kind), the longest prefix wins.

    A rule may be as deep as it likes: paths meet rules by an equi-join on their own folder prefixes.
    """
    parts = F.split(F.col(path), "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    spread = files.withColumn("_prefix", F.explode(prefixes)).join(kinds.withColumnRenamed("prefix", "_prefix"), "_prefix")
    best = spread.groupBy(path).agg(F.max_by("kind", F.length("_prefix")).alias("kind"))
    name = F.element_at(parts, -1)
    return files.join(best, path).withColumn("session_id", F.regexp_replace(name, r"\.[^.]*$", ""))


def stale_sessions(entries: DataFrame, stored: DataFrame) -> DataFrame:
    """Sessions of which a source file is newer than the stored copy, or that have none; entries: (session_id, mtime)."""
    j = entries.join(stored.select("session_id", F.col("stored_at")), "session_id", "left")
    newer = F.bool_or(F.col("stored_at").isNull() | (F.col("mtime") > F.col("stored_at")))
    return j.groupBy("session_id").agg(newer.alias("stale"), F.max("mtime").alias("newest")).where("stale").drop("stale")


def message_blocks(lines: DataFrame) -> DataFrame:
    """One row a content block of landed JSON lines (file_path, line, body).

    Two dialects are read: message.content as text or as an array of typed blocks, and payload.content alike; the first
    meta record of a file gives its session and folder to all its lines. A line that is no JSON has no block.
    """
    v = lines.withColumn("v", F.try_parse_json("body")).where(F.col("v").isNotNull())
    get = lambda p, t="string": F.try_variant_get("v", p, t)
    meta = F.min_by(F.struct(get("$.payload.id").alias("session"), get("$.payload.cwd").alias("cwd")), F.when(get("$.type") == "session_meta", F.col("line"))).over(W.partitionBy("file_path"))
    v = v.withColumns({"_meta": meta, "role": F.coalesce(get("$.message.role"), get("$.payload.role")), "ts": get("$.timestamp")})
    as_list = F.coalesce(F.try_variant_get("v", "$.message.content", "array<variant>"), F.try_variant_get("v", "$.payload.content", "array<variant>"))
    as_text = F.coalesce(get("$.message.content"), get("$.payload.content"))
    one = F.array(F.to_variant_object(F.struct(F.lit("text").alias("type"), as_text.alias("text"))))
    listed = v.where(F.col("role").isNotNull()).withColumn("_blocks", F.when(as_list.isNotNull(), as_list).otherwise(one))
    b = listed.select("file_path", "line", "role", "ts", F.coalesce(get("$.sessionId"), F.col("_meta.session")).alias("session_id"), F.coalesce(get("$.cwd"), F.col("_meta.cwd")).alias("cwd"), F.posexplode("_blocks").alias("block_index", "b"))
    part = lambda p: F.try_variant_get("b", p, "string")
    return b.select(
        "file_path", "line", "block_index", F.concat_ws(":", "file_path", "line", "block_index").alias("block_key"), "session_id", "cwd", "role", "ts",
        part("$.type").alias("block_type"), F.coalesce(part("$.text"), part("$.content"), part("$.thinking")).alias("content"),
        F.coalesce(part("$.id"), part("$.tool_use_id")).alias("tool_use_id"), part("$.name").alias("tool_name"),
    )


def is_prompt(role: Column, block_type: Column, text: Column, prefixes: Sequence[str]) -> Column:
    """A typed prompt: a user's text block that starts with none of the harness prefixes."""
    by_machine = F.lit(False)
    for p in prefixes:
        by_machine = by_machine | text.startswith(p)
    return F.coalesce((role == "user") & (block_type == "text") & ~by_machine, F.lit(False))


def mark_repeats(df: DataFrame, id_col: str, order: Sequence[str]) -> DataFrame:
    """df with is_repeat: copies of an id that are not the earliest; a null id never repeats."""
    first = F.min(F.struct(*order)).over(W.partitionBy(id_col))
    return df.withColumn("is_repeat", F.col(id_col).isNotNull() & (F.struct(*order) != first))


def pair_calls(blocks: DataFrame, session: str, call: str, kind: str, ts: str, carry: Sequence[str]) -> DataFrame:
    """Calls (kind call) with their results (kind result) by session and call id: one row a call and one an orphan result.

    paired tells whether both are there; returned_ms is the time between; the result's columns come as result_*.
    """
    calls = blocks.where(F.col(kind) == "call").select(session, call, F.col(ts).alias("called_at"), *carry)
    results = blocks.where(F.col(kind) == "result").select(session, call, F.col(ts).alias("returned_at"), *[F.col(c).alias(f"result_{c}") for c in carry])
    j = calls.join(results, [session, call], "full_outer")
    ms = lambda c: F.unix_millis(F.col(c).cast("timestamp"))
    return j.withColumns({"paired": F.col("called_at").isNotNull() & F.col("returned_at").isNotNull(), "returned_ms": ms("returned_at") - ms("called_at")})


def previews(df: DataFrame, text: str, head: int = 80, tail: int = 40) -> DataFrame:
    """df with the head and tail of a long text in place of the text."""
    return df.withColumns({"head": F.left(F.col(text), F.lit(head)), "tail": F.when(F.length(text) > head, F.right(F.col(text), F.lit(tail))), "n_chars": F.length(text)}).drop(text)


def _ratio(a: str, b: str) -> float:
    """Indel ratio: 200 * LCS / (len a + len b), by bit-parallel rows."""
    if not a and not b:
        return 100.0
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    s = full
    for c in b:
        u = s & masks.get(c, 0)
        s = (s + u | s - u) & full
    return 200.0 * (len(a) - s.bit_count()) / (len(a) + len(b))


def near_repeats(df: DataFrame, key: str, order: str, text: str, at_least: float = 90.0, chars: int = 100) -> DataFrame:
    """Rows whose text nearly repeats the one before it in the key: similarity, of the first chars, at_least or more."""
    share_code(df.sparkSession)

    @F.pandas_udf("double")
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else _ratio(x[:chars], y[:chars]) for x, y in zip(a, b, strict=True)], dtype="float64")

    before = F.lag(F.left(F.col(text), F.lit(chars))).over(W.partitionBy(key).orderBy(order))
    return df.withColumn("_before", before).withColumn("similarity", ratio("_before", F.left(F.col(text), F.lit(chars)))).where(F.col("similarity") >= at_least).drop("_before")


def sessions(blocks: DataFrame, key: str, ts: str, order: str) -> DataFrame:
    """One row a session of events or blocks: span, counts, latest state, what was used, ordered ids."""
    return blocks.groupBy(key).agg(
        F.min(ts).alias("started"), F.max(ts).alias("last"), F.count("*").alias("n_blocks"), F.max_by("event_type", F.struct(ts, order)).alias("latest_type"),
        F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("types"), F.array_sort(F.collect_list(F.struct(ts, order))).getField(order).alias("keys"),
    )


def turns(prompts: DataFrame, replies: DataFrame, key: str, ts: str, take: Sequence[str]) -> DataFrame:
    """Each prompt with the last reply before the next prompt of its key, null when there is none.

    Prompts and replies are put in one order a key; a running count of prompts numbers the turns, and the last reply of
    each number is its close. At one time a prompt comes before replies.
    """
    p = prompts.select(key, F.col(ts).alias("_t"), F.lit(0).alias("_tag"), F.struct("*").alias("_p"), F.lit(None).cast(replies.select(F.struct(*take).alias("r")).schema["r"].dataType).alias("_r"))
    r = replies.select(key, F.col(ts).alias("_t"), F.lit(1).alias("_tag"), F.lit(None).cast(p.schema["_p"].dataType).alias("_p"), F.struct(*take).alias("_r"))
    both = p.unionByName(r)
    number = F.count("_p").over(W.partitionBy(key).orderBy("_t", "_tag").rowsBetween(W.unboundedPreceding, 0))
    return both.withColumn("_n", number).where("_n > 0").groupBy(key, "_n").agg(F.first("_p", True).alias("_p"), F.max_by("_r", F.when(F.col("_r").isNotNull(), F.struct("_t", "_r"))).alias("_r")).select("_p.*", *[F.col(f"_r.{c}").alias(c) for c in take])


def live_sessions(last_seen: DataFrame, now: Column, minutes: int, exempt: Sequence[str]) -> DataFrame:
    """(session, branch, idle, n_others, others): sessions (session, branch, last) active in the last minutes, with idle minutes and the other live sessions of their branch in order.

    Exempt branches have no others. The sessions of a branch are listed once and meet its rows in blocks, so that a busy
    branch costs no pairs beyond the lists that its rows hold.
    """
    idle = F.floor((F.unix_seconds(now) - F.unix_seconds(F.col("last").cast("timestamp"))) / 60)
    live = last_seen.withColumn("idle", idle).where(F.col("idle").between(0, minutes)).select("session", "branch", "idle")
    shares = F.coalesce(F.col("branch").isNotNull() & ~F.col("branch").isin(*exempt), F.lit(False))
    lists = live.where(shares).groupBy("branch").agg(F.sort_array(F.collect_list("session")).alias("_all"), (F.count("*") - 1).alias("n_others"))
    none = F.array().cast(live.select(F.array("session")).schema[0].dataType)
    others = F.when(F.col("session").isNull(), F.col("_all")).otherwise(F.array_remove("_all", F.col("session")))
    met = join_in_blocks(live.where(shares), lists, ["branch"], 1024, 256).select("session", "branch", "idle", "n_others", others.alias("others"))
    return met.unionByName(live.where(~shares).withColumns({"n_others": F.lit(0).cast("long"), "others": none}))


def external_actions(calls: DataFrame, rules: DataFrame, text: str) -> DataFrame:
    """Calls whose words hold all words of a rule (rule, words); punctuation counts as blanks."""
    clean = F.translate(F.lower(F.col(text)), ".,;:|!?()", " " * 9)
    return contains_all(calls.withColumn("_tokens", F.split(clean, " +")), rules, "_tokens", "words").drop("_tokens")


def attachment_fields(lines: DataFrame, json: str) -> DataFrame:
    """Fields of a JSON object column as (key, value) rows."""
    fields = F.from_json(F.col(json), "map<string,string>")
    return lines.select("*", F.explode(fields).alias("key", "val"))


def threads(edges: DataFrame) -> DataFrame:
    """(node, root, depth) of (child, parent) rows, by doubling: every round asks each node's present root for its own. A circle raises."""
    cur = cut(edges.select(F.col("child").alias("node"), F.col("parent").alias("root"), F.lit(1).alias("depth")))
    reach, most = 1, cur.count()
    while True:
        up = cur.select(F.col("node").alias("root"), F.col("root").alias("_p"), F.col("depth").alias("_d"))
        step = cur.join(up, "root", "left")
        if step.where("_p is not null").isEmpty():
            return cur
        if reach > most:
            raise ValueError("threads run in a circle")
        cur = cut(step.select("node", F.coalesce("_p", "root").alias("root"), (F.col("depth") + F.coalesce("_d", F.lit(0))).alias("depth")))
        reach *= 2


def retro(calls: DataFrame, session: str, text: str, phrase: str, flags: dict[str, Column]) -> DataFrame:
    """Sessions that hold a phrase, with the number of their calls under every flag."""
    having = calls.where(F.contains(F.col(text), F.lit(phrase))).select(session).distinct()
    return calls.join(having, session, "left_semi").groupBy(session).agg(F.count("*").alias("n_calls"), *[F.count_if(c).alias(k) for k, c in flags.items()])


def recall(messages: DataFrame, text: str, word: str, order: Sequence[str], n: int) -> DataFrame:
    """The first n messages that hold a word, in any case."""
    return messages.where(F.contains(F.lower(F.col(text)), F.lit(word.lower()))).orderBy(*order).limit(n)


def claim_guard(blocks: DataFrame, session: str, turn: str, role: str, text: str, terms: Sequence[str], evidence: DataFrame) -> DataFrame:
    """Sessions whose last reply claims a term without an evidence row for the session."""
    last = blocks.where(F.col(role) == "assistant").groupBy(session).agg(F.max_by(text, turn).alias("_last"))
    claims = F.array_compact(F.array(*[F.when(F.contains(F.lower("_last"), F.lit(t)), F.lit(t)) for t in terms]))
    return last.select(session, F.explode(claims).alias("term")).join(evidence.select(session).distinct(), session, "left_anti")


def author_hygiene(items: DataFrame, author: str, outcome: str, flag: Column) -> DataFrame:
    """Per author the outcomes, their counts and the share of flagged items."""
    return items.groupBy(author).agg(
        F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set(outcome)), ",").alias("outcomes"), F.count_if(flag).alias("flagged"), F.round(100.0 * F.count_if(flag) / F.count("*"), 2).alias("percent"),
    )


def contributors(log: DataFrame, who: str, ts: str, since: Column, n: int) -> DataFrame:
    """The n most active days with the number of distinct contributors behind each; identities stay behind the count."""
    day = F.date_format(ts, "yyyy-MM-dd").alias("day")
    return log.where(F.col(ts) >= since).groupBy(day).agg(F.countDistinct(who).alias("people"), F.count("*").alias("n")).orderBy(F.desc("n"), "day").limit(n)


