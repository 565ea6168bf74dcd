"""Main text of web pages by composite text density.

A page becomes a tree of elements.  Every node knows, for all that lies below it, its
characters of text C, tags T, characters inside links LC and link tags LT.  Its density
is characters per tag, made smaller where much of the text is link text:

    C/T                                                     without links
    C/T * ln(max(C/LC * T/LT, 1)) / ln(C/(C-LC)*LC + LCb/Cb*C + e)   with links

(Cb and LCb are the body's).  A node's density sum adds the densities of its children.
The node of the largest sum leads to the main text; the threshold is the smallest
density on the path from the body to that node, and what stands beside the path joins
the text unless it is below the threshold and mostly links.  Elements that are never
main text (scripts, menus, forms ...) are left out of the tree by tag, role or hidden state
before anything is counted.  A word of a class or id value only marks an element (adverts,
comments by readers ...): a marked element is left out unless it holds most of the page's
text outside links, as a wrapper around the article does.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grove.llm.common import free_names, slices

# Element names of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark "
    "q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section "
    "summary table ul dd dt".split())
#: An opening tag ends an open element of these names, up to the given boundary.
ENDS = {"li": ("li", {"ul", "ol", "menu"}), "dt": ("dt dd", {"dl"}), "dd": ("dt dd", {"dl"}),
        "tr": ("tr td th", {"table"}), "td": ("td th", {"tr", "table"}),
        "th": ("td th", {"tr", "table"}), "option": ("option", {"select"}),
        "tbody": ("thead tbody tr td th", {"table"}), "tfoot": ("tbody thead tr td th", {"table"}),
        "thead": ("tbody tr td th", {"table"})}
#: Elements that never hold main text.
BOILER_TAGS = frozenset(
    "head script style noscript template nav header footer aside form button select input "
    "textarea option label iframe object embed svg canvas audio video dialog menu title meta "
    "link noembed noframes fieldset".split())
BOILER_ROLES = frozenset(
    "navigation banner contentinfo complementary search form menu menubar toolbar alert dialog "
    "alertdialog status note".split())
#: Words of class and id values that mark what is not main text.
BOILER_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense adbox banner sponsor sponsored promo "
    "promotion nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager sidebar "
    "side aside rail widget widgets footer foot header masthead topbar toolbar notice notices "
    "cookie cookies consent gdpr popup modal overlay alert newsletter subscribe subscription "
    "signup login share sharing social related recommended recommendations comment comments "
    "commentlist reply replies disqus respond discussion copyright legal disclaimer skip "
    "hidden search form tags".split())
COMMENT_WORDS = frozenset(
    "comment comments commentlist reply replies disqus respond discussion".split())
ARTICLES = frozenset("article main".split())
#: Reasons that a class or id value gives; they mark an element and do not cut it at once.
MARKS = frozenset(["boiler", "comments"])
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: Elements whose parts are judged one by one inside an article.
CONTAINERS = frozenset("article main div section center".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
#: Start of the closing tag of each raw element; ASCII letters only match each other.
_RAW_END = {t: re.compile(f"</{t}", re.I | re.A) for t in RAW}
_ATTR = re.compile(r"""(?<![\w-])(class|id|role|hidden|aria-hidden|style)(?![\w-])(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""",
                   re.I)
_WORDS = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def _boiler(tag: str, attrs: str) -> str:
    """Why an element is left out of the tree by its tag or attributes; empty if it is not."""
    if tag in BOILER_TAGS:
        return tag
    if not attrs or tag in ("html", "body") or "=" not in attrs and "hidden" not in attrs:
        return ""
    for name, value in _ATTR.findall(attrs):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return "hidden"
        if name == "role" and value in BOILER_ROLES:
            return value
        if name == "style" and _HIDDEN.search(value):
            return "hidden"
        if name in ("class", "id"):
            words = _WORDS.findall(value)
            if not COMMENT_WORDS.isdisjoint(words):
                return "comments"
            if tag not in ARTICLES and not BOILER_WORDS.isdisjoint(words):
                return "boiler"
    return ""


class Node:
    __slots__ = ("tag", "parent", "mark", "kids", "own", "chars", "tags", "link_chars",
                 "link_tags", "density", "total")

    def __init__(self, tag: str, parent: "Node | None", mark: str = ""):
        self.tag, self.parent, self.mark = tag, parent, mark
        self.kids: list = []          # nodes and strings, in page order
        self.own: int | None = None   # characters of the strings among them, once counted
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0


BREAK = Node("", None)


def parse(page: str) -> Node:
    """Tree of the page without boilerplate elements; the root stands for the body.

    Elements that only a class or id value calls boilerplate are in the tree, marked.
    """
    root = node = Node("body", None)
    skip: list[str] = []              # open elements of a left-out subtree
    why = ""
    at = 0
    find = _TOKEN.search
    while True:
        m = find(page, at)
        if m is None:
            break
        if m.start() > at and not skip:
            node.kids.append(page[at:m.start()])
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            if skip:
                if tag in skip:
                    while skip.pop() != tag:
                        pass
                elif tag in ("body", "html") and why != "head":
                    skip.clear()
                continue
            if tag in ("html", "body"):
                continue
            up = node
            while up is not root and up.tag != tag:
                up = up.parent
            if up is not root:
                node = up.parent
            continue
        attrs = m[3]
        closed = tag in VOID
        if tag in RAW:                # its content is not markup
            end = _RAW_END[tag].search(page, at)
            # an element that is never closed takes the rest of the page
            at = len(page) if end is None else end.start()
            why = why if skip else tag
            skip.append(tag)
            continue
        if skip:
            # an element left open must not swallow the article behind it
            if tag == "body" or tag in ARTICLES and not _boiler(tag, attrs):
                skip.clear()
            else:
                if not closed and not (tag == "p" and skip[-1] == "p") \
                        and not (tag == "li" and skip[-1] == "li"):
                    skip.append(tag)
                continue
        if tag in ("html", "body"):
            continue
        if tag in CLOSES_P:
            up = node
            while up is not root and (up.tag in INLINE or up.tag == "p"):
                up = up.parent
            # close the open paragraph, with what it still has open
            probe, has_p = node, False
            while probe is not up:
                has_p |= probe.tag == "p"
                probe = probe.parent
            if has_p:
                node = up
        ends = ENDS.get(tag)
        if ends is not None:
            names, stop = ends
            names = names.split()
            up, last = node, None
            while up is not root and up.tag not in stop:
                if up.tag in names:
                    last = up
                up = up.parent
            if last is not None:
                node = last.parent
        reason = _boiler(tag, attrs)
        if reason and reason not in MARKS:
            if not closed and not attrs.endswith("/"):
                skip.append(tag)
                why = reason
            continue
        child = Node(tag, node, reason)
        node.kids.append(child)
        if not closed and not (reason and attrs.endswith("/")):
            node = child
    if at < len(page) and not skip:
        node.kids.append(page[at:])
    return root


def _clean(text: str) -> str:
    """Character references decoded, white space to one space, trimmed."""
    if "&" in text:
        text = html.unescape(text)
    return " ".join(_SPACE.split(text)).strip()


def _count(root: Node) -> list[Node]:
    """Fill the counts of every node, children first; returns nodes in page order."""
    order, stack = [], [root]
    while stack:
        n = stack.pop()
        order.append(n)
        stack += [k for k in reversed(n.kids) if isinstance(k, Node)]
    for n in reversed(order):
        if n.own is None:
            n.own = sum(len(_clean(k)) for k in n.kids if isinstance(k, str))
        n.chars, n.tags, n.link_chars, n.link_tags = n.own, 0, 0, 0
        for k in n.kids:
            if isinstance(k, Node):
                n.chars += k.chars
                n.link_chars += k.link_chars
                n.tags += k.tags + 1
                n.link_tags += k.link_tags + (k.tag == "a")
        if n.tag == "a":
            n.link_chars = n.chars
    return order


def _prune(root: Node, order: list[Node]) -> None:
    """Leave marked elements out of the counted tree, but not what wraps the main text.

    A marked element stays if it holds more than half of the text outside links; readers'
    comments do not count as text here.  What is marked as comments, which often are longer
    than the article, stays only with nine tenths of all text outside links, or with more
    than half and an h1 inside.  The parts of an element that stays are
    judged in turn.  Unmarked articles inside a left-out element that is not comments are
    kept in its place.
    """
    leads: set[int] = set()
    for n in order:
        if n.tag == "h1":
            while n is not None and id(n) not in leads:
                leads.add(id(n))
                n = n.parent
    whole = root.chars - root.link_chars
    for n in order:
        held = n.chars - n.link_chars
        if n.mark == "comments" and (10 * held > 9 * whole
                                     or id(n) in leads and 2 * held > whole):
            n.mark = ""
    plain: dict[int, int] = {}        # text outside links and outside comments
    for n in reversed(order):
        held = n.own
        for k in n.kids:
            if isinstance(k, Node) and k.mark != "comments":
                held += plain[id(k)]
        plain[id(n)] = 0 if n.tag == "a" else held
    stack = [root]
    while stack:
        n = stack.pop()
        kids: list = []
        for k in n.kids:
            if isinstance(k, str):
                kids.append(k)
            elif not k.mark or k.mark != "comments" and 2 * plain[id(k)] > plain[id(root)]:
                kids.append(k)
                stack.append(k)
            elif k.mark != "comments":
                inner = [k]
                while inner:
                    x = inner.pop()
                    if x.tag in ARTICLES and not x.mark:
                        x.parent = n
                        kids.append(x)
                        stack.append(x)
                    else:
                        inner += [y for y in reversed(x.kids)
                                  if isinstance(y, Node) and y.mark != "comments"]
        n.kids = kids


def _densities(root: Node, order: list[Node]) -> None:
    share = root.link_chars / root.chars if root.chars else 0.0
    for n in order:
        if not n.chars:
            continue
        tags = max(n.tags, 1)
        if not n.link_chars:
            n.density = n.chars / tags
            continue
        other = max(n.chars - n.link_chars, 1)
        base = math.log(n.chars / other * n.link_chars + share * n.chars + math.e)
        inner = max(n.chars * tags / (n.link_chars * max(n.link_tags, 1)), 1.0)
        n.density = n.chars / tags * math.log(inner) / max(base, 1.0)
    for n in order:
        n.total = sum(k.density for k in n.kids if isinstance(k, Node))


def _trimmed(article: Node, threshold: float) -> Node:
    """The article without its link lists: blocks of several links that are mostly links and
    below the threshold.  Inline elements, headings and parts of other blocks stay."""
    stack = [article]
    while stack:
        n = stack.pop()
        n.kids = [k for k in n.kids if isinstance(k, str) or k.tag in INLINE or k.tag in HEADINGS
                  or k.density >= threshold or k.link_tags < 2 or 2 * k.link_chars <= k.chars]
        stack += [k for k in n.kids if isinstance(k, Node) and k.tag in CONTAINERS]
    return article


def choose(root: Node) -> list[Node | str]:
    """Parts of the main text in page order; none for a page without text.

    The node of the largest density sum is sought inside the page's articles, if it
    marks any.  Then every outermost article is taken, without the link lists inside it,
    unless it is itself below the threshold and mostly links.  Without an article, the node
    is taken whole together with what stands beside the path from the body to it, unless
    that is below the path's threshold and mostly links.
    """
    order = _count(root)
    if any(n.mark for n in order):
        _prune(root, order)
        order = _count(root)
    if not root.chars:
        return []
    _densities(root, order)
    inside: set[int] = set()
    for n in order:
        if n.chars and (n.tag in ARTICLES or id(n.parent) in inside):
            inside.add(id(n))
    found = [n for n in order if id(n) in inside] or order
    best = max(found, key=lambda n: (n.total, n.density))
    path = [best]
    while path[-1].parent is not None:
        path.append(path[-1].parent)
    threshold = min(n.density for n in path)
    if inside:
        outer = [n for n in order if id(n) in inside and id(n.parent) not in inside]
        return [_trimmed(n, threshold) for n in outer
                if n in path or n.density >= threshold or 2 * n.link_chars <= n.chars]

    def stays(k) -> bool:
        return isinstance(k, str) or k.density >= threshold or 2 * k.link_chars <= k.chars

    # one kid of every node of the path lies on it, so the walk needs no recursion
    before: list = []
    after: list[list] = []
    for n, step in zip(path[:0:-1], path[-2::-1]):
        at = next(i for i, k in enumerate(n.kids) if k is step)
        edge = [] if step is best else [BREAK]
        before += [*filter(stays, n.kids[:at]), *edge]
        after.append([*edge, *filter(stays, n.kids[at + 1:])])
    return [*before, best, *(k for rest in reversed(after) for k in rest)]


def blocks(parts: list) -> list[str]:
    """Texts of the blocks of some subtrees in page order; inline elements run on,
    <br> is white space."""
    out: list[str] = []
    run: list[str] = []

    def end():
        if run:
            text = _clean("".join(run))
            if text:
                out.append(text)
            run.clear()

    stack: list = [(p, False) for p in reversed(parts)]
    while stack:
        n, left = stack.pop()
        if isinstance(n, str):
            run.append(n)
        elif left or n is BREAK:
            end()
        else:
            if n.tag == "br":
                run.append(" ")
            elif n.tag not in INLINE:
                end()
                stack.append((n, True))
            stack += [(k, False) for k in reversed(n.kids)]
    end()
    return out


def main_text(page: str | None) -> str:
    """Blocks of the main text, joined by line ends; empty for null or no text."""
    if not page:
        return ""
    return "\n".join(blocks(choose(parse(page))))


def extract_main_text(pages: DataFrame, page: str = "html", keep: tuple[str, ...] | None = None
                      ) -> DataFrame:
    """``keep`` columns of ``pages`` (default: all) plus text and n_chars (code points).

    Null, empty and textless pages have an empty text.  One narrow pass, page by page;
    a column that clashes with a result column is replaced by it.
    """
    names = [c for c in (keep if keep is not None else pages.columns)
             if c not in ("text", "n_chars")]
    (inner,) = free_names(names, "_page")
    frame = pages.select(*[F.col(c) for c in names], F.col(page).cast("string").alias(inner))
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, "
                     for f in frame.select(*names).schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw in slices(batches, inner):
            text = [main_text(None if r is None else r.decode()) for r in raw]
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index(c)) for c in names]
                + [pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())],
                names=names + ["text", "n_chars"])

    return frame.mapInArrow(run, fields + "text string, n_chars long")
