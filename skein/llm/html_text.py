"""Main text of web pages: consensus host paths.

A page is read into a tree of its blocks; inline tags leave no trace. Every page scores its
containers by their text outside of links and names the best one; the generalised path to
it, tags with their classes and numbers blotted out, is its vote. Spark adds up the votes of a
host: a path wins by the number of different texts that it leads to, so what repeats from
page to page counts once. Each page is then read again with its host's winning path; where that
path leads to no text, the page's own container counts.

Navigation, notices, adverts, forms, comments and the like do not count as text. A name of a class or
an id only lowers a score: a wrapper that holds the page's article, or most of its text where
little else is left, is never set aside for its name. Outside of the container any word of a name counts; within it
only names that can mean nothing but such a part, as ``ad`` or ``share-buttons`` do and ``share-price`` does not.

Reading takes time and memory in proportion to the page: open elements are found by tag,
scopes are carried along, and paths are built for the chosen container only.
"""

from __future__ import annotations

import hashlib
import html as _html
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions.shared import bound_batches, broadcast_if_small, checkpointed, table
from skein.llm.urls import url_host

#: A quote opens a string only behind an equals sign; elsewhere it is part of a name.
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*+(?:\"[^\"]*\"|'[^']*')|=)*+)(?:>|\Z)")
_OTHER = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(?:[!?]|/(?=[^a-zA-Z]))[^>]*(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/>][^\s=/>]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
# Tag names of HTML.
_RAW = frozenset("script style title textarea iframe xmp noembed noframes".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var nobr output math mi mn mo mtext mrow mfrac msqrt mroot msub msup msubsup mover munder munderover mstyle semantics".split())
_UNSEEN = frozenset("head noscript template select svg annotation annotation-xml object canvas audio video".split())
_APART = frozenset("nav footer aside button dialog menu legend datalist".split())
_CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_LEAF = frozenset("p li dt dd td th h1 h2 h3 h4 h5 h6 pre blockquote caption figcaption summary address".split())
_CELLS = frozenset("td th caption".split())
_TABLE = frozenset("table thead tbody tfoot tr td th caption".split())
#: Elements that end an open one of their kind, and the elements that shelter that one.
_KINDS = {"p": "p", "li": "li", "dt": "dt", "dd": "dt", "tr": "tr", "td": "td", "th": "td", "option": "option"}
_SHELTERS = {
    "p": frozenset("div article section main td th li blockquote table button caption body".split()), "li": frozenset("ul ol menu".split()), "dt": frozenset(["dl"]),
    "tr": frozenset(["table"]), "td": frozenset("tr table".split()), "option": frozenset(["select"]),
}
#: The kinds that an element shelters.
_SHELTERED = {tag: tuple(k for k, tags in _SHELTERS.items() if tag in tags) for tag in frozenset().union(*_SHELTERS.values())}
#: Characters of a start tag beyond which its reading is not kept.
_LONG = 500
#: What an element stands for: text, a part that is set aside unless the text is in it, readers' comments, a head line, or what is never text.
TEXT, SOFT, COMMENT, HEADER, HARD = range(5)
#: Words of class names, ids and roles that mark an element as no part of the article.
_MARKS = frozenset(
    "ad ads adv advert advertisement advertising adsense banner breadcrumb breadcrumbs cookie cookies consent contentinfo complementary "
    "dialog footer gdpr login menu modal nav navbar navigation newsletter notice notices notification pager pagination popup promo "
    "promotion promoted related search share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar widget alert".split()
)
_COMMENTS = frozenset("comment comments disqus reply replies respond".split())
_HEADERS = frozenset("header masthead".split())
#: Of these, what may mark an article element, by a name's first word, and an inline element.
_TEASERS = frozenset("ad advert advertisement promo promoted related sponsored".split())
_WITHIN_TEXT = frozenset("ad ads adv advert advertisement adsense promo share sharing skip social sponsor sponsored".split())
#: First words of names that tell what a page has, not what the element is.
_ABOUT = frozenset("has have no not non with without is can hide show enable disable".split())
#: Words that a name of a part may have besides: with any other word it may as well tell what a section is about.
_PARTS = frozenset(
    "a area article articles author avatar bar bars block blocks body bottom box boxes button buttons card cards center content container count col column desktop div embed entry feed footer form frame global group head header "
    "heading holder icon icons in inline inner input item items label labels left link links list lists main media message meta mid middle mobile nav next of outer overlay page panel panels post posts prev previous right row rail section sections slot site sticky "
    "stories story strip text thread threads title to top unit units ul wrap wrapper wrappers zone".split()
)
#: Of the marks, those that an id may set within an article: other ids there are places to link to.
_IDS = frozenset("ad ads advert advertisement adsense comments disqus respond newsletter sidebar sponsored promo breadcrumb breadcrumbs cookie cookies".split())
_WORDS = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[0-9])")
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
#: A container is entered while one child holds this share of its text.
_SHARE = 0.7
#: The host's path counts where it leads to this share of the text in the page's own container.
_FAIR = 0.04
#: An article element counts from this share of the text that no mark sets aside.
_LEAST_ARTICLE = 0.2


class Node:
    __slots__ = ("tag", "label", "parent", "children", "inner", "own", "mark", "vague", "out", "all", "plain", "heading", "size", "score", "links", "left_out", "scope", "nested", "article")

    def __init__(self, tag: str, label: str, parent: Node | None, mark: int, scope: dict, vague: bool = False):
        self.tag, self.label, self.parent, self.mark, self.scope, self.vague = tag, label, parent, mark, scope, vague
        self.out = False  # set aside itself, also where the container is around it
        self.children: list = []  # nodes and texts
        self.inner: list[Node] = []  # the nodes of these
        self.own = self.all = self.plain = self.size = self.score = self.links = self.nested = 0
        self.heading = self.left_out = False
        self.article: Node | None = None  # of the root: what _article finds


def _attributes(source: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, value in _ATTRIBUTE.findall(source):
        out.setdefault(name.lower(), _html.unescape(value.strip("\"'")) if value else "")
    return out


@lru_cache(maxsize=1024)
def _opening(tag: str, source: str) -> tuple[int, bool, str]:
    """The mark of a start tag, whether it is vague, and the label. Pages of a host repeat theirs, so the last ones are kept."""
    attributes = _attributes(source) if source.strip(" /\n\t") else {}
    label = tag
    if names := attributes.get("class"):
        label = ".".join([tag, *sorted(re.sub(r"\d+", "#", c).replace("/", "#") for c in names.split())])
    return *_mark(tag, attributes), label


def _mark(tag: str, attributes: dict[str, str]) -> tuple[int, bool]:
    """The mark of an element and whether it is vague: whether its names may as well tell what a section of the article is about."""
    if tag in _UNSEEN or tag in _APART:
        return HARD, False
    if attributes and ("hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true" or _HIDDEN.search(attributes.get("style", ""))):
        return SOFT, False
    own = SOFT if tag in ("form", "fieldset") else HEADER if tag == "header" else TEXT
    if not attributes or tag in ("html", "body", "main") or tag in _HEADINGS:
        return own, False
    found: set[str] = set()
    sure: set[str] = set()  # words of names that can only mean a part of the page
    for attribute in ("class", "id", "role"):
        for name in _CAMEL.sub("-", attributes.get(attribute, "")).lower().split():
            words = [w for w in _WORDS.split(name) if w]
            if words and words[0] not in _ABOUT:
                words = words[:1] if tag == "article" else words
                found.update(words)
                marks = _MARKS | _COMMENTS if attribute != "id" else _IDS
                if all(w in marks or w in _PARTS or w.isdigit() for w in words):
                    sure.update(words)
    if not found:
        return own, False
    for words, vague in ((sure, False), (found, True)):
        if tag in _INLINE:
            if not words.isdisjoint(_WITHIN_TEXT):
                return SOFT, vague
        elif not words.isdisjoint(_COMMENTS):
            return COMMENT, vague
        elif not words.isdisjoint(_TEASERS if tag == "article" else _MARKS):
            return SOFT, vague
    if tag in _INLINE:
        return TEXT, False
    return (own if own or tag == "article" or found.isdisjoint(_HEADERS) else HEADER), False


class _Reader:
    """Reads tokens into a tree; every step takes the same time however deep or long the page is."""

    def __init__(self):
        self.root = Node("", "", None, TEXT, {})
        self.stack = [self.root]
        self.open: dict[str, list[int]] = {}  # by tag: places on the stack
        self.inline: list[int] = []  # places of inline elements that are on the stack
        self.in_link = False

    def text(self, text: str) -> None:
        text = _html.unescape(text) if "&" in text else text
        top = self.stack[-1]
        top.children.append(text)
        weight = _weight(text)
        top.own += weight
        if self.in_link:
            top.links += weight

    def push(self, tag: str, label: str, mark: int, vague: bool = False, inline: bool = False) -> None:
        parent = self.stack[-1]
        scope, at = parent.scope, len(self.stack)
        changed = {k: -1 for k in _SHELTERED.get(tag, ()) if scope.get(k, -1) >= 0}
        if tag in _KINDS:
            changed[_KINDS[tag]] = at
        if tag in _CELLS:
            changed["cell"] = at
        node = Node(tag, label, parent, mark, {**scope, **changed} if changed else scope, vague)
        parent.children.append(node)
        parent.inner.append(node)
        self.stack.append(node)
        self.open.setdefault(tag, []).append(at)
        if inline:
            self.inline.append(at)

    def cut(self, at: int) -> None:
        """Ends the elements from place ``at`` on."""
        for node in reversed(self.stack[at:]):
            self.open[node.tag].pop()
        del self.stack[at:]
        while self.inline and self.inline[-1] >= at:
            self.inline.pop()

    def start(self, tag: str, source: str) -> None:
        top = self.stack[-1]
        if tag in _VOID:
            if tag == "br":
                top.children.append(" ")
            elif tag == "hr":
                self.start_block("hr", "hr", TEXT)
                self.cut(len(self.stack) - 1)
            return
        mark, vague, label = _opening(tag, source) if len(source) <= _LONG else _opening.__wrapped__(tag, source)
        if tag not in _INLINE:
            self.start_block(tag, label, mark, vague)
            return
        if tag == "a":
            self.in_link = True
        if mark:
            self.push(tag, label, mark, vague, inline=True)
        elif self.inline and self.stack[self.inline[-1]].tag == tag:
            self.stack[self.inline[-1]].nested += 1

    def start_block(self, tag: str, label: str, mark: int, vague: bool = False) -> None:
        self.in_link = False
        if tag in _CLOSES_P and (at := self.stack[-1].scope.get("p", -1)) >= 0:
            self.cut(at)
        if tag in _KINDS and tag != "p" and (at := self.stack[-1].scope.get(_KINDS[tag], -1)) >= 0:
            self.cut(at)
        if tag == "tr" and (at := self.stack[-1].scope.get("td", -1)) >= 0:
            self.cut(at)
        if self.stack[-1].tag == "head" and tag in _CLOSES_P or tag == "body" and self.open.get("head"):
            self.cut(self.open["head"][-1])  # a head without an end ends where the content begins
        if tag in ("html", "body") and self.open.get(tag):
            return  # a second one adds nothing
        self.push(tag, label, mark, vague)

    def end(self, tag: str) -> None:
        if tag in _INLINE:
            if tag == "a":
                self.in_link = False
            if self.inline and self.stack[self.inline[-1]].tag == tag:
                if self.stack[self.inline[-1]].nested:
                    self.stack[self.inline[-1]].nested -= 1
                else:
                    self.cut(self.inline[-1])
            return
        self.in_link = False
        places = self.open.get(tag)
        if not places:
            if tag in ("br", "p"):
                self.stack[-1].children.append("\n")
            return
        if tag in _TABLE or places[-1] > self.stack[-1].scope.get("cell", -1):
            self.cut(places[-1])


def _weight(text: str) -> int:
    """Characters that are not white space."""
    return 0 if text.isspace() else len("".join(text.split()))


def read_page(source: str | None) -> Node:
    """The tree of a page's blocks with what counts as text. Unclosed, crossed and cut-off tags are put up with."""
    reader, data, at = _Reader(), source or "", 0
    while at < len(data):
        begin = data.find("<", at)
        while begin >= 0:
            m = _TAG.match(data, begin) or _OTHER.match(data, begin)
            if m:
                break
            begin = data.find("<", begin + 1)
        stop = begin if begin >= 0 else len(data)
        if stop > at:
            reader.text(data[at:stop])
        if begin < 0:
            break
        at = m.end()
        if m.re is _OTHER:
            continue
        tag = m[2].lower()
        if m[1]:
            reader.end(tag)
        elif tag in _RAW:
            end = re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(data, at)
            at = end.end() if end else len(data)
            reader.stack[-1].children.append(" ")
        else:
            reader.start(tag, m[3])
    _judge(reader.root)
    return reader.root


def _below(root: Node, enter=lambda n: True) -> list[Node]:
    """The node and those below it, parents first; ``enter`` says whether to go below one."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        if enter(node):
            todo += reversed(node.inner)
    return order


def _judge(root: Node) -> None:
    """Decides which marked elements are left out, and sums up the text of what remains."""
    order = _below(root)
    for node in reversed(order):
        node.all += node.own
        node.plain += node.own
        for c in node.inner:
            node.all += c.all
            node.plain += 0 if c.mark else c.plain
            node.heading |= c.heading or (c.tag in _HEADINGS and c.all > 0)
    article = root.article = _article(root)
    kept = article
    if article is None:
        # where little is left, the marked element that holds most of the text is no mere part of the page
        for node in _below(root, lambda n: n.mark != HARD):
            left = root.plain if node.mark == COMMENT else root.plain // 4
            if node.mark and node.mark != HARD and 2 * node.plain >= root.all and left < node.plain and (kept is None or node.plain > kept.plain):
                if node.mark != COMMENT or not root.plain:
                    kept = node
    holders = set()
    while kept is not None:
        holders.add(id(kept))
        kept = kept.parent
    for node in order:
        parent = node.parent
        if parent is not None and parent.left_out:
            node.left_out = True
        elif node.mark and id(node) not in holders:
            node.left_out = not (node.mark == HEADER and node.heading and _in_article(node))
        if node.mark and not node.vague and id(node) not in holders:
            node.out = not (node.mark == HEADER and node.heading and _in_article(node))
    for node in reversed(order):
        if not node.left_out:
            node.size = node.own
            node.score = node.own - node.links
            for c in node.inner:  # what is left out has neither
                node.size += c.size
                node.score += c.score


def _in_article(node: Node) -> bool:
    """Whether the element that a head line belongs to is an article or the main part."""
    while (node := node.parent) is not None and node.tag not in ("body", "section", "nav", "aside"):
        if node.tag in ("article", "main"):
            return True
    return False


def _article(root: Node) -> Node | None:
    """The article or main element with the most text, if that is more than a teaser."""
    best = None
    for node in _below(root, lambda n: n.mark not in (HARD, COMMENT)):
        if node.tag in ("article", "main") and not node.mark and node.plain and (best is None or node.plain > best.plain):
            best = node
    return best if best is not None and best.plain >= _LEAST_ARTICLE * root.plain else None


def best_container(root: Node) -> Node:
    """The page's article or main element, else the innermost container with most of the text outside of links."""
    article = root.article
    node = article or root
    while True:
        held = [c for c in node.inner if not c.left_out and c.tag not in _LEAF]
        inner = max(held, key=lambda c: (c.score, c.size), default=None)
        if inner is None or not inner.size or (article is not None and inner.tag not in ("article", "main")):
            return node
        if inner.score < _SHARE * node.score or inner.size < _SHARE * node.size:
            return node
        node = inner


def path_of(node: Node) -> str:
    labels = []
    while node.parent is not None:
        labels.append(node.label)
        node = node.parent
    return "".join(f"/{x}" for x in reversed(labels))


def on_path(root: Node, path: str) -> list[Node]:
    """The elements that a path leads to; of several articles the one with the most text."""
    found = [root]
    for label in path.split("/")[1:]:
        found = [c for n in found for c in n.inner if c.label == label and c.size]
        if not found:
            return []
    if found[0].tag in ("article", "main", ""):
        return [max(found, key=lambda n: n.size)]
    return found


def block_texts(node: Node) -> list[str]:
    """The texts of the container's blocks in page order; white space becomes one space, empty blocks go. Within it vague marks do not count."""
    out: list[str] = []
    run: list[str] = []

    def flush() -> None:
        if text := " ".join("".join(run).split()):
            out.append(text)
        run.clear()

    todo: list = [node]
    while todo:
        x = todo.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            run.append(x)
        elif x.tag in _INLINE:
            if not x.out:
                todo += reversed(x.children)
        elif x.out:
            if x.tag not in ("svg", "select", "annotation", "annotation-xml"):  # these stand within a line
                flush()
        else:
            flush()
            todo += [None, *reversed(x.children)]
    flush()
    return out


def vote(source: str | None) -> tuple[str, int, int]:
    """The path that a page votes for, the size of its container's text, and a digest of that text."""
    best = best_container(read_page(source))
    text = "\n".join(block_texts(best)) if best.size else ""
    digest = hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).digest()
    return path_of(best), best.size, int.from_bytes(digest, "big", signed=True)


def extract(source: str | None, path: str | None) -> str:
    """The text of the elements on the path, or of the page's own container where they hold next to nothing of what that holds."""
    root = read_page(source)
    own = best_container(root)
    found = on_path(root, path) if path else []
    if not found or sum(x.size for x in found) < _FAIR * own.size:
        found = [own]
    return "\n".join(t for x in found for t in block_texts(x))


def extract_text(pages: DataFrame, *, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``pages`` with text and n_chars.

    A null or empty html has an empty text. Pages without a host vote together. Every page with text has one vote. A host's winner
    is the path that leads to the most different texts, then the one of the most pages, then the one with the most text, then the first
    by name. Repeated rows vote as often and all get the same text. Very long and very deep pages take time in proportion to
    their length. Input columns named like a result column give way to it. An empty table gives an empty one.
    """
    bound_batches(pages.sparkSession)

    @F.pandas_udf("path string, weight long, digest long")
    def votes(sources: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in sources:
            yield pd.DataFrame([vote(x) for x in batch], columns=["path", "weight", "digest"])

    @F.pandas_udf("string")
    def texts(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for sources, paths in parts:
            yield pd.Series([extract(x, p) for x, p in zip(sources, paths)], dtype=object)

    kept = [c for c in pages.columns if c not in ("text", "n_chars")]
    rows = pages.select(*[F.col(c).alias(f"_in_{c}") for c in kept], url_host(F.col(url_col)).alias("_host"), F.col(html_col).alias("_html"))
    cast = rows.select("_host", votes("_html").alias("_v")).where("_v.weight > 0")
    # a hot host is split by text before its paths are counted
    sums = cast.groupBy("_host", F.col("_v.path").alias("path"), F.col("_v.digest").alias("digest")).agg(F.count("*").alias("pages"), F.sum("_v.weight").alias("weight"))
    sums = sums.groupBy("_host", "path").agg(F.count("*").alias("different"), F.sum("pages").alias("pages"), F.sum("weight").alias("weight"))
    rank = F.struct((-F.col("different")).alias("d"), (-F.col("pages")).alias("p"), (-F.col("weight")).alias("w"), "path")
    winners = checkpointed(sums.groupBy("_host").agg(F.min(rank).alias("_w")).select("_host", F.col("_w.path").alias("_path")))
    out = rows.join(broadcast_if_small(winners), "_host", "left").withColumn("text", texts("_html", "_path"))
    return out.select(*[F.col(f"_in_{c}").alias(c) for c in kept], "text", F.length("text").cast("long").alias("n_chars"))


def op7_html_text(spark, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract_text(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")
