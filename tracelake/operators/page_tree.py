"""Element trees of pages, built as browsers do for the markup that authors write: end tags may be left out."""

from __future__ import annotations

from html.parser import HTMLParser

#: Fixed values of HTML: elements without content, elements within a line of text, elements whose text is no prose.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
SILENT = frozenset("script style template noscript".split())
#: Fixed values of HTML: which start tags end an open paragraph.
_ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split())
#: Fixed values of HTML: a start tag ends the open elements named first, unless one of those named then lies between.
_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "rt": ({"rt", "rp"}, {"ruby"}),
    "rp": ({"rt", "rp"}, {"ruby"}),
    "body": ({"head"}, {"html"}),
}
#: Fixed values of HTML: what lies in one of these ends with it, and no end tag inside reaches beyond.
_SCOPE = frozenset("html table td th caption button object marquee applet template".split())
#: The blocks of text that elements make.
KINDS = {"p": "paragraph", "pre": "code", "li": "item", "dt": "item", "dd": "item", "blockquote": "paragraph", "title": "title", "td": "cell", "th": "cell", "caption": "title", **{f"h{i}": "heading" for i in range(1, 7)}}


class Tree(HTMLParser):
    """The elements of a page in pre-order, and its blocks of text.

    rows: [id, parent, depth, tag, path, attributes, own text, elements below]. blocks: [id, kind, level, content], in
    page order: one for each element that makes a block, with all text in it that no block inside has, whatever inline
    elements it lies in; text elsewhere makes blocks of the kind text, by the element that holds it. Text of scripts,
    styles and templates is in no block. White space is one blank, but as it stands in preformatted text.
    """

    def __init__(self, html: str | None) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[list] = []
        self.blocks: list[list] = []
        self._open: list[int] = []
        self._block_of: dict[int, list] = {}
        self._loose: list | None = None
        self.feed(html or "")
        self.close()
        for row in reversed(self.rows):
            if row[1] is not None:
                self.rows[row[1]][7] += row[7] + 1
        for b in self.blocks:
            text = "".join(b[3])
            b[3] = text.removeprefix("\n").rstrip() if b[1] == "code" else " ".join(text.split())
        self.blocks = [b for b in self.blocks if b[3] or b[1] != "text"]

    def _tag(self, i: int) -> str:
        return self.rows[i][3]

    def _end_open(self, tags: frozenset | set, barrier: frozenset | set) -> None:
        """Close the innermost open element of tags, with all in it, unless one of barrier is met first; again, as long as there is one."""
        d = len(self._open) - 1
        while d >= 0 and self._tag(self._open[d]) not in barrier:
            if self._tag(self._open[d]) in tags:
                del self._open[d:]
            d -= 1

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in _ENDS_P:
            self._end_open({"p"}, _SCOPE)
        if tag in _ENDS:
            self._end_open(*_ENDS[tag])
        if tag == "a":
            self._end_open({"a"}, _SCOPE)
        self._gap(tag)
        parent = self._open[-1] if self._open else None
        path = f"{self.rows[parent][4]}/{tag}" if parent is not None else tag
        told: dict[str, str] = {}
        for k, v in attrs:
            told.setdefault(k, v or "")
        self.rows.append([len(self.rows), parent, len(self._open), tag, path, told, "", 0])
        if tag in KINDS:
            block = [len(self.rows) - 1, KINDS[tag], int(tag[1]) if KINDS[tag] == "heading" else None, []]
            self.blocks.append(block)
            self._block_of[block[0]] = block
        if tag not in VOID:
            self._open.append(len(self.rows) - 1)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        """A slash ends an element in drawings and formulas only."""
        self.handle_starttag(tag, attrs)
        if tag not in VOID and any(self._tag(i) in ("svg", "math") for i in self._open):
            self._open.pop()

    def handle_endtag(self, tag: str) -> None:
        self._gap(tag)
        for d in range(len(self._open) - 1, -1, -1):
            own = self._tag(self._open[d])
            if own == tag:
                del self._open[d:]
                return
            if own in _SCOPE and tag not in _SCOPE and tag not in ("tr", "tbody", "thead", "tfoot", "body"):
                return
            if tag in INLINE and own not in INLINE:
                return  # a stray end within a line of text ends no block

    def _gap(self, tag: str) -> None:
        """Text on both sides of what is no part of a line is apart."""
        if tag not in INLINE:
            self._loose = None
            for i in reversed(self._open):
                if i in self._block_of:
                    self._block_of[i][3].append("\n" if tag == "br" and self._block_of[i][1] == "code" else " ")
                    break

    def handle_data(self, data: str) -> None:
        if not self._open:
            return
        self.rows[self._open[-1]][6] += data
        holder = self._open[0]
        for i in reversed(self._open):
            tag = self._tag(i)
            if tag in SILENT:
                return
            if i in self._block_of:
                self._block_of[i][3].append(data)
                return
            if tag not in INLINE:
                holder = i
                break
        if self._loose is None or self._loose[0] != holder:
            self._loose = [holder, "text", None, []]
            self.blocks.append(self._loose)
        self._loose[3].append(data)
