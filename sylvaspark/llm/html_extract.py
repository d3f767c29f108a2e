"""HTML extraction [operator 3]: composite text density.

A page is read once into a flat node table (a lenient tag scanner, implied ends,
raw script and style text).  Each node gets its characters C, link characters LC,
tags T and link tags LT, and from them the composite density of Sun, Song and
Liao (2011): C/T, times the logarithm of (C/LC * T/LT) to a base that grows with
the node's link share.  The main text is in the subtree whose children's densities
have the largest sum.  The threshold is the least density on the path from that
subtree to the body; siblings along this path that reach it are text as well.

Menus, notices, forms and the like (by tag, role, or a whole word of a class or id) are cut before densities
are taken, unless such an element holds an article, the main heading or nearly all of the page's
characters: then it is the page's frame, and only what is marked inside it is cut.

Nulls and the like: a null or empty page has no text, as has one of markup only; equal pages have equal texts; pages of any
length and depth are read whole; an empty table gives an empty result; no column but those named is read, so names cannot
clash.  Markup may be broken in any way: what cannot be parsed is text, and an unclosed script runs to the end of the page.
"""

from __future__ import annotations

import html
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices


_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*"[^"]*"|=\s*'[^']*'|[^>])*+)>|<[!?/][^>]*>""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_RAW = {t: re.compile(rf"</{t}\s*>|</{t}\s[^>]*>", re.I) for t in ("script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "xmp")}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul caption".split())
_CUT_TAGS = frozenset("nav footer aside form button select input menu dialog head object embed audio video canvas label fieldset".split())
#: Words of classes, ids and roles that mark what is not main text; those of a heading only outside an article.
_CUT_WORDS = frozenset(
    "ad ads advert adverts advertisement advertisements adsense banner sponsor sponsored promo promos promotion promotions cookie cookies consent gdpr notice notices alert alerts "
    "popup popups modal overlay sidebar aside widget widgets menu nav navbar navigation topbar toolbar breadcrumb breadcrumbs footer foot comment comments commentlist respond replies disqus "
    "share sharing social related recommended newsletter subscribe subscription signup login searchform searchbox pagination pager skip skiplink complementary contentinfo".split()
)
_CUT_HEADS = frozenset("header masthead".split())
#: Words that turn the meaning of the next one round.
_TURNS = frozenset("no not non has have with without is hide disable".split())
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
#: A marked element of more than this share of the page's characters is its frame.
FRAME = 0.9
_HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: An open element of these ends when one of these begins, up to the fence.
_ENDS = {
    "p": (frozenset(("p",)), frozenset(("article", "section", "div", "td", "li", "body", "blockquote"))),
    "li": (frozenset(("li", "p")), frozenset(("ul", "ol", "menu"))),
    "dd": (frozenset(("dd", "dt", "p")), frozenset(("dl",))),
    "dt": (frozenset(("dd", "dt", "p")), frozenset(("dl",))),
    "tr": (frozenset(("tr", "td", "th", "p")), frozenset(("table",))),
    "td": (frozenset(("td", "th", "p")), frozenset(("table", "tr"))),
    "th": (frozenset(("td", "th", "p")), frozenset(("table", "tr"))),
    "option": (frozenset(("option",)), frozenset(("select",))),
}


class Page:
    """The node table of one page: parents stand before their children."""

    def __init__(self, source: str):
        self.tag, self.parent, self.marked = ["#root"], [0], [False]
        self.chars, self.link_chars = [0], [0]
        self.text: list[tuple[int, str]] = []  # (node, run); a run of "" with node -1 ends a block
        self._scan(source)
        n = len(self.tag)
        self.cut = self._cuts()
        for i in range(n):
            if self.cut[i]:
                self.chars[i] = self.link_chars[i] = 0
        self.tags, self.link_tags = [0] * n, [0] * n
        for i in range(n - 1, 0, -1):
            up = self.parent[i]
            self.chars[up] += self.chars[i]
            self.link_chars[up] += self.link_chars[i]
            self.tags[up] += self.tags[i] + (not self.cut[i])
            self.link_tags[up] += self.link_tags[i] + (self.tag[i] == "a" and not self.cut[i])

    def _cuts(self) -> list[bool]:
        """What is marked and not a frame, with all below it."""
        n = len(self.tag)
        held = [t in ("article", "main", "h1") for t in self.tag]
        chars = list(self.chars)
        for i in range(n - 1, 0, -1):
            chars[self.parent[i]] += chars[i]
            held[self.parent[i]] |= held[i]
        cut = [False] * n
        for i in range(1, n):
            frame = chars[i] > FRAME * chars[0] or (held[i] and self.tag[i] != "h1")
            cut[i] = cut[self.parent[i]] or (self.marked[i] and not frame)
        return cut

    def _scan(self, source: str) -> None:
        stack, links, at = [0], 0, 0
        open_tags: dict[str, int] = {}

        def leave() -> None:
            nonlocal links
            tag = self.tag[stack.pop()]
            open_tags[tag] -= 1
            links -= tag == "a"
            if tag in _BLOCK:
                self.text.append((-1, ""))

        def run(raw: str) -> None:
            if raw:
                node = stack[-1]
                self.text.append((node, words := html.unescape(raw)))
                n = len(words) if words.strip() else 0
                self.chars[node] += n
                self.link_chars[node] += n * (links > 0)

        length = len(source)
        while at < length:
            m = _TOKEN.search(source, at)
            if m is None:
                run(source[at:])
                break
            run(source[at : m.start()])
            at = m.end()
            name = m[2]
            if not name:
                continue
            name, attributes = name.lower(), m[3] or ""
            if m[1]:
                if name in _BLOCK:
                    self.text.append((-1, ""))
                if open_tags.get(name):
                    while self.tag[stack[-1]] != name:
                        leave()
                    leave()
                continue
            if name in _ENDS or name in _BLOCK:
                ends, fence = _ENDS.get(name, _ENDS["p"])
                if any(open_tags.get(t) for t in ends):
                    for depth in range(len(stack) - 1, 0, -1):
                        t = self.tag[stack[depth]]
                        if t in ends:
                            while len(stack) > depth:
                                leave()
                        elif t in fence:
                            break
            if name in _BLOCK:
                self.text.append((-1, ""))
            if name in _RAW:
                end = None if attributes.endswith("/") else _RAW[name].search(source, at)
                if not attributes.endswith("/"):
                    at = end.end() if end else length
                continue
            if name in _VOID or attributes.endswith("/"):
                run(" ")
                if name == "hr":
                    self.text.append((-1, ""))
                continue
            if name in ("td", "th"):
                run(" ")
            self.tag.append(name)
            self.parent.append(stack[-1])
            self.marked.append(self._never(name, attributes, open_tags))
            self.chars.append(0)
            self.link_chars.append(0)
            stack.append(len(self.tag) - 1)
            open_tags[name] = open_tags.get(name, 0) + 1
            links += name == "a"

    @staticmethod
    def _never(name: str, attributes: str, open_tags: dict[str, int]) -> bool:
        """Whether an element is marked as something else than main text."""
        if name in _CUT_TAGS:
            return True
        inside = bool(open_tags.get("article") or open_tags.get("main"))
        if name == "header":
            return not inside
        if not attributes or name in ("html", "body", "main", "article") or name in _HEADINGS:
            return False
        values = {}
        for key, *value in _ATTRIBUTE.findall(attributes):
            values.setdefault(key.lower(), "".join(value))
        if "hidden" in values or values.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", values.get("style", ""), re.I):
            return True
        for token in " ".join(values.get(k, "") for k in ("class", "id", "role")).split():
            words = [w.lower() for w in _WORD.findall(token)]
            for before, word in zip(["", *words], words):
                if before not in _TURNS and (word in _CUT_WORDS or (word in _CUT_HEADS and not inside)):
                    return True
        return False

    def density(self, i: int, body: int) -> float:
        c, t = self.chars[i], max(1, self.tags[i])
        if not c:
            return 0.0
        lc, lt = self.link_chars[i], self.link_tags[i]
        share = self.link_chars[body] / max(1, self.chars[body])
        base = math.log(c / max(1, c - lc) * lc + share * c + math.e)  # at least 1
        return c / t * math.log(max(1.0, c / max(1, lc) * t / max(1, lt)) + 1e-9) / math.log(base + 1e-3)

    def main(self) -> set[int]:
        """The nodes that carry main text, as roots of their subtrees."""
        n = len(self.tag)
        body = next((i for i in range(n) if self.tag[i] == "body"), 0)
        dense = [0.0 if self.cut[i] else self.density(i, body) for i in range(n)]
        total = [0.0] * n
        for i in range(1, n):
            total[self.parent[i]] += dense[i]
        best = max((i for i in range(n) if not self.cut[i] and self.chars[i]), key=lambda i: (total[i], dense[i], -i), default=None)
        if best is None:
            return set()
        path = [best]
        while path[-1] not in (body, 0):
            path.append(self.parent[path[-1]])
        threshold = min(dense[i] for i in path)
        chosen, steps, on = {best}, set(path[1:]), set(path)
        for i in range(1, n):
            if self.parent[i] in steps and i not in on and not self.cut[i] and self.chars[i] and dense[i] >= threshold:
                chosen.add(i)
        return chosen

    def blocks(self) -> list[str]:
        roots = self.main()
        inside = [False] * len(self.tag)
        for i in range(len(self.tag)):
            inside[i] = i in roots or (i > 0 and inside[self.parent[i]])
        out, now = [], []
        for node, words in [*self.text, (-1, "")]:
            if node >= 0:
                if inside[node] and not self.cut[node]:
                    now.append(words)
            elif now:
                if block := " ".join("".join(now).split()):
                    out.append(block)
                now = []
        return out


def extract(source: str | None) -> str:
    """The main text of one page."""
    return "\n".join(Page(source).blocks()) if source else ""


def extract_pages(pages: DataFrame, key: str = "page_id", url: str = "url", column: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars): one row for each row of ``pages``."""

    def run(batches):
        for batch in slices(batches):
            texts = [extract(x) for x in batch.column(2).to_pylist()]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(column).cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
