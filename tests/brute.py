"""Plain Python readings of the queries that have no SQL: name -> rows of the query, as tuples in the order of its columns."""

from __future__ import annotations

import datetime
import hashlib
import json
import re
from collections import Counter, defaultdict
from html import unescape

import pandas as pd

def _table(sf: str, name: str) -> pd.DataFrame:
    return pd.read_parquet(f"{sf}/{name}.parquet")


_ENDLESS = {"meta", "br", "img", "hr", "input", "link"}
_LINE = {"a", "b", "i", "em", "strong", "span", "code", "sub", "sup"}
_TAG = re.compile(r"<!--.*?-->|<!DOCTYPE[^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)


def _elements(html: str) -> list[dict]:
    """The elements of a page of the given template, each with the pieces of text and the elements in it, in order.

    An element ends at its end tag, at that of an element around it, and a paragraph also where the next block begins.
    """
    out: list[dict] = []
    path: list[dict] = []
    at = 0
    while at < len(html):
        m = _TAG.search(html, at)
        if text := html[at : m.start() if m else len(html)]:
            if path:
                path[-1]["parts"].append(unescape(text))
        if not m:
            break
        at = m.end()
        tag = (m[2] or "").lower()
        if tag and m[1]:
            names = [e["tag"] for e in path]
            if tag in names:
                k = len(names) - 1 - names[::-1].index(tag)
                if not (tag in _LINE and any(n not in _LINE for n in names[k + 1 :])):
                    del path[k:]
        elif tag:
            names = [e["tag"] for e in path]
            if tag not in _LINE and tag not in _ENDLESS and "p" in names:
                del path[names.index("p") :]
            e = {"id": len(out), "up": path[-1]["id"] if path else None, "tag": tag, "chain": [x["tag"] for x in path], "above": [x["id"] for x in path], "parts": []}
            if path:
                path[-1]["parts"].append(e)
            out.append(e)
            if tag in ("script", "style"):
                end = html.find(f"</{tag}", at)
                e["parts"].append(html[at : end if end >= 0 else len(html)])
                at = html.find(">", end) + 1 if end >= 0 else len(html)
            elif tag not in _ENDLESS:
                path.append(e)
    return out


def _pages(sf: str) -> list[tuple[int, list[dict]]]:
    return [(int(r.page_id), _elements(r.html)) for r in _table(sf, "pages").itertuples()]


def _below(nodes: list[dict], i: int) -> int:
    return sum(i in n["above"] for n in nodes)


def f1_page_blocks(sf: str) -> list[tuple]:
    kinds = {"p": "paragraph", "pre": "code", "li": "item", "title": "title", "td": "cell", "th": "cell"} | {f"h{i}": "heading" for i in range(1, 7)}
    fold = lambda t: " ".join(t.split())

    def told(e: dict, whole: bool) -> str:
        """The text in an element but for that of blocks in it."""
        return "".join(p if isinstance(p, str) else " " if p["tag"] in kinds or p["tag"] in ("script", "style") else told(p, True) if p["tag"] in _LINE else f" {told(p, True)} " for p in e["parts"])

    out = []
    for page, nodes in _pages(sf):
        found = []

        def walk(e: dict) -> None:
            if e["tag"] in kinds:
                found.append((e["id"], kinds[e["tag"]], int(e["tag"][1]) if kinds[e["tag"]] == "heading" else None, fold(told(e, True))))
            loose = ""
            for p in [*e["parts"], None]:
                line = p is not None and (isinstance(p, str) or p["tag"] in _LINE)
                if line:
                    loose += p if isinstance(p, str) else told(p, True)
                elif fold(loose):
                    if e["tag"] not in kinds and e["tag"] not in _LINE and e["tag"] not in ("script", "style"):
                        found.append((e["id"], "text", None, fold(loose)))
                    loose = ""
                if isinstance(p, dict):
                    walk(p)

        for n in nodes:
            if n["up"] is None:
                walk(n)
        out += [(page, i, *b) for i, b in enumerate(found)]
    return out


def f5_page_nodes(sf: str) -> list[tuple]:
    return [(p, n["id"], n["up"], len(n["chain"]), n["tag"], "/".join([*n["chain"], n["tag"]]), _below(nodes, n["id"])) for p, nodes in _pages(sf) for n in nodes]


def g13_find_definitions(sf: str) -> list[tuple]:
    return [(p, n["tag"], n["id"], n["id"] + _below(nodes, n["id"])) for p, nodes in _pages(sf) for n in nodes if n["tag"] in ("article", "nav", "footer")]


def h6_node_context(sf: str) -> list[tuple]:
    return [(p, n["id"], n["tag"], "/".join(n["chain"])) for p, nodes in _pages(sf) for n in nodes]


def h8_owners(sf: str) -> list[tuple]:
    out = []
    for p, nodes in _pages(sf):
        last: dict = {}
        for n in nodes:
            holders = [i for i in n["above"] if nodes[i]["tag"] in ("article", "nav", "footer")]
            if n["tag"] in ("a", "p", "b"):
                out.append((p, n["id"], n["tag"], holders[-1] if holders else last.get(n["up"])))
            last[n["up"]] = n["id"]
    return out


def f23_judge(sf: str) -> list[tuple]:
    key = lambda t: hashlib.sha256(json.dumps({"q": "is it long?", "m": "length-1", "t": t}, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()
    return [(key(t), "yes" if len(t) > 1000 else "no", None) for t in set(_table(sf, "documents").text)]


def a22_fake_rows(sf: str) -> int:
    """Made-up rows are told by their kinds alone; see test_operators."""
    return len(_table(sf, "orders"))


def a23_semantic_types(sf: str) -> list[tuple]:
    patterns = [("url", r"https?://\S+"), ("email", r"[^@\s]+@[^@\s]+\.[a-z]+"), ("timestamp", r"\d{4}-\d\d-\d\d[ T]\d\d:\d\d.*"), ("date", r"\d{4}-\d\d-\d\d"), ("integer", r"-?\d+"), ("number", r"-?\d+\.\d+"), ("json", r"[\[{].*[\]}]"), ("word", r"\S+")]
    out = []
    for name, columns in (("pages", ("page_id", "url", "html")), ("events", ("event_id", "user_id", "event_type", "value", "ts", "props"))):
        t = _table(sf, name)
        for c in columns:
            votes: Counter = Counter()
            for v in t[c].dropna():
                s = v.strftime("%Y-%m-%d %H:%M:%S") if isinstance(v, (pd.Timestamp, datetime.datetime)) else str(v)
                votes[next((k for k, p in patterns if re.fullmatch(p, s, re.A)), "text")] += 1
            if votes:
                kind, n = max(votes.items(), key=lambda x: (x[1], x[0]))
                out.append((c, kind, n))
    return out


def _longest_common(a: str, b: str) -> int:
    row = [0] * (len(b) + 1)
    for x in a:
        left = 0
        for j, y in enumerate(b):
            left, row[j + 1], = row[j + 1], max(left + 1 if x == y else 0, row[j], row[j + 1])
    return row[-1]


def d9_near_repeats(sf: str) -> list[tuple]:
    heads = defaultdict(list)
    for r in _table(sf, "documents").sort_values("doc_id").itertuples():
        heads[r.text[:20]].append((r.doc_id, r.text[:100]))
    out = []
    for rows in heads.values():
        for (_, a), (i, b) in zip(rows, rows[1:], strict=False):
            share = 100 * 2 * _longest_common(a, b) / (len(a) + len(b)) if a or b else 100.0
            if share >= 90:
                out.append((i, round(share, 4)))
    return out


BRUTE = {f.__name__: f for f in (a22_fake_rows, a23_semantic_types, d9_near_repeats, f1_page_blocks, f5_page_nodes, f23_judge, g13_find_definitions, h6_node_context, h8_owners)}
