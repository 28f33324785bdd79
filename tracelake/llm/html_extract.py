"""Main text of web pages by tree scoring.

A page becomes a tree. Every paragraph earns points for its length and commas and passes them to its ancestors: all to
the parent, half to the grandparent, less further up. A container's points are discounted by its link density. The best
container is kept, with those of its siblings that score well enough or read like paragraphs; parts that are no
article by their element, role or class (menus, adverts, forms, notices, reader comments) are cut out before. A class
or id tells such a part if a whole token says so (``cookie-banner``, ``related-posts``); a token that holds such a word
beside others (``related-work``) does only for containers that are mostly links or ask for input. Paragraphs go by
their class only as adverts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.session import share_code

# Element names of HTML by role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - frozenset("body dd dt head html legend li option tbody td tfoot th thead tr".split()) | frozenset(["li", "dd", "dt"])
DROPPED = frozenset("head nav header footer aside form script style noscript template iframe select button textarea dialog menu datalist".split())
SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}), "option": ({"option"}, {"select"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr"}), "th": ({"td", "th"}, {"tr"}), "tbody": ({"tbody", "thead", "tfoot"}, {"table"}), "tfoot": ({"tbody", "thead"}, {"table"})}
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form toolbar status".split())
#: Words of class and id values that mark no article; among them those of adverts and of reader comments.
ADVERTS = frozenset("ad ads advert adverts advertisement advertising adsense adslot sponsor sponsored sponsors promo promoted promotion cookie cookies consent gdpr".split())
COMMENTS = frozenset("comment comments commentlist disqus respond reply replies".split())
MARKS = ADVERTS | COMMENTS | frozenset(
    "banner notice notices notification notifications alert newsletter subscribe subscription signup popup modal overlay paywall sidebar sidebars aside rail menu menus nav navbar navigation breadcrumb breadcrumbs pagination pager footer masthead topbar toolbar disclaimer share sharing social related recommended recommendations widget widgets login search skip hidden".split()
)
#: Words that may stand beside them in a token without changing what it says.
NEUTRAL = frozenset("area article articles bar block body bottom box button buttons card cards col column container content entries entry form global group header holder icons inner item items js left link links list main message module news outer page pane panel placeholder popup post posts primary region right row secondary section site slot sticky stories story text thread title top unit view wrap wrapper zone".split())
#: Elements that hold article text themselves; their class never says that they are menus or comments.
PLAIN = frozenset("html body article main p pre blockquote li dd dt td th tr tbody thead tfoot caption figcaption h1 h2 h3 h4 h5 h6 a abbr b bdi bdo cite code data del dfn em font i ins kbd label mark math q rp rt ruby s samp small span strong sub sup svg text time tspan tt u var xmp".split())
ASKS = frozenset("input select textarea button form".split())
PARAGRAPHS = frozenset("p pre blockquote td dd li h1 h2 h3 h4 h5 h6".split())
#: What attributes say of an element: nothing, perhaps no article, no article, an advert, reader comments.
NOTHING, PERHAPS, PART, ADVERT, COMMENT, HIDDEN = range(6)

_TOKEN = re.compile(r"<!--.*?(?:--!?>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)([^>\"']*(?:\"[^\"]*\"[^>\"']*|'[^']*'[^>\"']*)*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|</?[a-zA-Z][^>]*\Z", re.S)
_ATTR = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_MARK_WORD = re.compile(r"[a-z]+|[A-Z][a-z]*|[A-Z]+")


def _token(token: str, in_article: bool) -> int:
    """What one class or id says."""
    words = [w.lower() for w in _MARK_WORD.findall(token)]
    for whole in (words, [w for w in re.split(r"[^a-z]+", token.lower()) if w]):
        told = MARKS.intersection(whole)
        if "header" in whole and not in_article:
            told |= {"header"}
        if told:
            if not (told | NEUTRAL).issuperset(whole):
                return PERHAPS
            return COMMENT if told & COMMENTS else ADVERT if told & ADVERTS else PART
    return NOTHING


def _mark(attrs: str, in_article: bool, ids: bool) -> int:
    """What an element's attributes say, with or without its id; an article's header holds its title."""
    if not attrs or attrs.isspace():
        return NOTHING
    told = NOTHING
    for name, x, y, z in _ATTR.findall(attrs):
        value, name = x or y or z, name.lower()
        if name == "class" or ids and name == "id":
            told = max([told, *(_token(t, in_article) for t in value.split())])
        elif name == "role":
            if value.strip().lower() in ROLES:
                told = max(told, PART)
        elif name == "aria-hidden" and value.strip().lower() == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            told = HIDDEN
    if re.search(r"(?:^|\s)hidden(?:\s|/|$)", _ATTR.sub(" ", attrs)):
        told = HIDDEN
    return told


class Tree:
    """Nodes in page order with their parents, the text under each and whether it is cut out."""

    def __init__(self, html: str):
        self.tag, self.parent, self.end, self.cut = ["#"], [-1], [0], [False]
        marked: list[int] = [NOTHING]
        self.asks: list[int] = []
        self.chunks: list[tuple[int, str]] = []
        stack, at, size = [0], 0, len(html)
        counts: dict[str, int] = {}

        def pop_to(depth: int) -> None:
            while len(stack) > depth:
                i = stack.pop()
                counts[self.tag[i]] -= 1
                self.end[i] = len(self.tag)
                if self.tag[i] in BLOCK:
                    self.chunks.append((self.parent[i], " "))

        def depth_of(tags: frozenset | set, stop: frozenset | set) -> int:
            for d in range(len(stack) - 1, 0, -1):
                t = self.tag[stack[d]]
                if t in tags:
                    return d
                if t in stop:
                    return 0
            return 0

        while at < size:
            m = _TOKEN.search(html, at)
            if m is None:
                self.chunks.append((stack[-1], html[at:]))
                break
            if m.start() > at:
                self.chunks.append((stack[-1], html[at : m.start()]))
            at = m.end()
            name = m[2] or m[5]
            if not name:
                continue
            name, attrs = name.lower(), m[3] if m[2] else m[6]
            if m[1] or m[4]:
                if not counts.get(name):
                    continue
                d = depth_of({name}, frozenset(["td", "th", "table"]) - {name} if name not in ("table", "tr", "tbody", "thead", "tfoot", "body", "html", "article", "main", "div", "section") else frozenset())
                if d and (name in BLOCK or not any(self.tag[i] in BLOCK for i in stack[d + 1 :])):
                    pop_to(d)
                continue
            if name in CLOSES_P and counts.get("p"):
                d = depth_of({"p"}, {"table", "td", "th", "button", "object"})
                if d:
                    pop_to(d)
            if name in SIBLINGS:
                same, within = SIBLINGS[name]
                d = depth_of(same, within)
                if d:
                    pop_to(d)
            if name in BLOCK or name in ("br", "xmp"):
                self.chunks.append((stack[-1], " "))
            if name in ASKS:
                self.asks.append(stack[-1])
            if name in VOID:
                continue
            top = stack[-1]
            i = len(self.tag)
            in_article = bool(counts.get("article") or counts.get("main"))
            self.tag.append(name)
            self.parent.append(top)
            self.end.append(i + 1)
            self.cut.append(name in DROPPED and not (name == "header" and in_article))
            # an id on a paragraph is where links go, as to a section about cookies
            found = _mark(attrs, in_article, name not in PLAIN)
            if name in PLAIN and not (found == COMMENT and name == "article" or found == ADVERT and name in PARAGRAPHS):
                found = NOTHING
            marked.append(found)
            if name in RAW or name == "xmp":
                close = re.compile(rf"</{name}[\s/>]", re.I).search(html, at)
                if name == "xmp":  # its text is no markup
                    self.chunks += [(i, html[at : close.start() if close else size].replace("&", "&amp;")), (top, " ")]
                if close is None:
                    at = size
                else:
                    at = html.find(">", close.start()) + 1 or size
                continue
            if attrs.endswith("/") and name not in BLOCK and name not in ("a", "b", "i", "em", "strong", "span"):
                continue
            stack.append(i)
            counts[name] = counts.get(name, 0) + 1
        pop_to(1)
        self.end[0] = len(self.tag)
        # whatever its class says, what is around the largest article is kept, unless it is a comment
        articles = [i for i, tag in enumerate(self.tag) if tag in ("article", "main") and marked[i] < PART]
        up = max(articles, key=lambda i: (self.end[i] - i, -i), default=0)
        around = []
        while up > 0:
            around.append(up)
            up = self.parent[up]
        if not any(marked[i] == COMMENT for i in around):
            for i in around:
                marked[i] = NOTHING
        if PERHAPS in marked:
            self._decide(marked)
        if not articles:
            self._spare(marked)
        for i in range(1, len(self.tag)):
            self.cut[i] = self.cut[self.parent[i]] or self.cut[i] or marked[i] > NOTHING

    def _spare(self, marked: list[int]) -> None:
        """Of a page without an article, what holds most of the text of its paragraphs is not cut for what its class or id says."""
        n = len(self.tag)
        size, within = [0] * n, [False] * n
        out = [False] * n
        for i in range(1, n):
            within[i] = self.tag[i] in PARAGRAPHS or within[self.parent[i]]
            out[i] = self.cut[i] or self.tag[i] == "a" or marked[i] in (COMMENT, HIDDEN) or out[self.parent[i]]
        for i, t in self.chunks:
            size[i] += len(t.strip()) if within[i] and not out[i] else 0
        for i in range(n - 1, 0, -1):
            size[self.parent[i]] += size[i]
        for i in range(1, n):
            if marked[i] in (PART, ADVERT) and 2 * size[i] > size[0]:
                marked[i] = NOTHING

    def _decide(self, marked: list[int]) -> None:
        """Of elements that are perhaps no article, those that are mostly links or ask for input are none."""
        n = len(self.tag)
        size, links, forms, in_link = [0] * n, [0] * n, [0] * n, [False] * n
        for i in range(1, n):
            in_link[i] = self.tag[i] == "a" or in_link[self.parent[i]]
        for i, t in self.chunks:
            size[i] += len(t.strip())
            links[i] += len(t.strip()) if in_link[i] else 0
        for i in self.asks:
            forms[i] += 1
        for i in range(n - 1, 0, -1):
            for total in (size, links, forms):
                total[self.parent[i]] += total[i]
        for i in range(1, n):
            if marked[i] == PERHAPS:
                marked[i] = PART if 2 * links[i] > size[i] or forms[i] and size[i] < 500 else NOTHING


def _scores(tree: Tree, words: list[int], links: list[int], commas: list[int]) -> list[float]:
    """Points of every node; paragraphs give, ancestors get, link density takes off."""
    n = len(tree.tag)
    score = [0.0] * n
    for i in range(1, n):
        if tree.tag[i] in PARAGRAPHS and not tree.cut[i] and words[i]:
            density = min(1.0, links[i] / words[i])
            points = (1 + commas[i] + min(words[i] / 100, 3.0)) * (1 - density)
            up, level = tree.parent[i], 0
            while up > 0 and level < 6:
                score[up] += points / (1, 2, 4, 8, 16, 32)[level]
                up, level = tree.parent[up], level + 1
    for i in range(1, n):
        if tree.tag[i] in ("article", "main"):
            score[i] = score[i] * 2 + 5
        elif tree.tag[i] in PARAGRAPHS:
            score[i] = 0.0
        if words[i]:
            score[i] *= 1 - min(1.0, links[i] / words[i])
        else:
            score[i] = 0.0
    return score


def _article_of(tree: Tree, best: int, words: list[int]) -> int:
    """The article that holds the best container; a section of an article is not the article.

    The outermost article above it, else the main element, and of that the one article that holds most of its text.
    """
    up, article, main = best, 0, 0
    while up > 0:
        if tree.tag[up] == "article":
            article = up
        elif tree.tag[up] == "main":
            main = up
        up = tree.parent[up]
    if article:
        return article
    if main:
        inner = [i for i in range(main + 1, tree.end[main]) if tree.tag[i] == "article" and not tree.cut[i] and 2 * words[i] > words[main]]
        return inner[0] if inner else main
    return best


def extract(html: str | None) -> str:
    """Main text of one whole page; empty for null, and if nothing is left."""
    if not html:
        return ""
    tree = Tree(html)
    n = len(tree.tag)
    chunks = [(i, unescape(t) if "&" in t else t) for i, t in tree.chunks if not tree.cut[i]]
    words, links, commas = [0] * n, [0] * n, [0] * n
    in_link = [False] * n
    for i in range(1, n):
        in_link[i] = tree.tag[i] == "a" or in_link[tree.parent[i]]
    for i, t in chunks:
        size = len(t.strip())
        if size:
            words[i] += size
            commas[i] += t.count(",")
            if in_link[i]:
                links[i] += size
    for i in range(n - 1, 0, -1):
        up = tree.parent[i]
        words[up] += words[i]
        links[up] += links[i]
        commas[up] += commas[i]
    if not words[0]:
        return ""
    score = _scores(tree, words, links, commas)
    best = max(range(n), key=lambda i: (score[i] if not tree.cut[i] else -1.0, -i))
    if score[best] <= 0:
        best = next((i for i in range(n) if tree.tag[i] in ("article", "main") and words[i] and not tree.cut[i]), next((i for i in range(n) if tree.tag[i] == "body"), 0))
    best = _article_of(tree, best, words)
    keep = [(best, tree.end[best])]
    if tree.parent[best] >= 0 and tree.tag[best] not in ("article", "main"):
        # text beside the best container that is no list of links and asks for nothing: a title, an intro, further parts
        asks = [0] * n
        for i in tree.asks:
            asks[i] += 1
        for i in range(n - 1, 0, -1):
            asks[tree.parent[i]] += asks[i]
        for i in range(1, n):
            if tree.parent[i] == tree.parent[best] and i != best and not tree.cut[i] and words[i]:
                reads = tree.tag[i] in PARAGRAPHS or score[i] > 0
                if reads and 4 * links[i] < words[i] and not asks[i]:
                    keep.append((i, tree.end[i]))
    if len(keep) == 1:
        lo, hi = keep[0]
        return " ".join("".join([t for i, t in chunks if lo <= i < hi or t == " "]).split())
    return " ".join("".join([t for i, t in chunks if t == " " or any(lo <= i < hi for lo, hi in keep)]).split())


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars): one row per row of pages.

    text: character references decoded, white space runs as one space, blocks joined in page order by one space; empty
    for null or empty html and for pages with no article. n_chars: its code points. Broken markup is read as browsers
    do (implied end tags, unclosed elements, cut-off pages). Repeated rows each come back; null ids and urls are
    carried; other columns are not read; an empty table gives an empty result.
    """
    share_code(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(x.as_py()) for x in batch.column(2)]
            cols = [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=["page_id", "url", "text", "n_chars"])

    kind, url = pages.schema[id_col].dataType.simpleString(), pages.schema[url_col].dataType.simpleString()
    narrow = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return narrow.mapInArrow(run, f"page_id {kind}, url {url}, text string, n_chars long")
