"""Main text of web pages by scoring the tree of their elements.

Each paragraph passes points for its length and commas to its parent and, halved, to its grandparent; a container's
points are discounted by the share of its text that stands in links. The best container is kept, with those of its
siblings that score well or read like running text. Menus, forms, scripts and hidden elements are cut beforehand. Class names and
ids only raise a suspicion: what decides is how much of the page's running text the element holds and how much of it is links.
The best container is widened while what stands beside it is text rather than links.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from subweave.llm.shared import column

# fixed values: names of elements
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
_DROP = frozenset("script style noscript template iframe object svg math canvas head title nav aside footer form button select textarea input fieldset dialog menu noembed noframes video audio map".split())
_BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
_CLOSES_P = _BLOCK - {"html", "body", "td", "th", "tr", "tbody", "thead", "tfoot", "caption"}
_SCORED = frozenset("p pre td blockquote li dd h1 h2 h3 h4 h5 h6 figcaption".split())
_SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_STOP = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "tbody", "thead", "tfoot"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
# words of class names and ids of what is never the article, and of what often isn't; names like `has-sidebar` and `nav-closed` only say what a wrapper holds or how it stands
_NEVER = re.compile(r"(?:ads?|advert\w*|sponsor\w*|popup|cookies?|consent|gdpr|newsletter|subscribe|signup|comments?|disqus|replies|respond)", re.I)
_OFTEN = re.compile(r"(?:banner|promo\w*|modal|notice|sidebar|side|related|recommend\w*|share|sharing|social|menu|nav\w*|breadcrumbs?|footer|masthead|topbar|toolbar|pagination|pager|widgets?|login|search|skip|hidden|tags?)", re.I)
_SAYS_ONLY = frozenset("has have with without no not hide is open opened closed active inactive enabled disabled visible collapsed expanded toggled".split())
_GENERIC = frozenset("wrap wrapper container area section block list box inner outer items item group row bar panel holder region posts links link icons icon buttons button form message slot stories articles left right top bottom primary secondary unit".split())
_SITE_HEADER = re.compile(r"(?:(?:site|page|top|global|main|blog|web)[-_]?)?header", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z0-9]+|[A-Z]+")
_GOOD = re.compile(r"article|body|content|entry|hentry|main|page|post|story|text|blog", re.I)
_KEEP_NAMES = frozenset(("html", "body", "article", "main"))

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]|=(?>\s*(?:\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z)))?)*+)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role|hidden|aria-hidden|style|itemprop)(?![\w-])\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)


class _Node:
    __slots__ = ("name", "attributes", "parent", "children", "score", "size", "linked", "prose", "links", "holds")

    def __init__(self, name: str, attributes: str, parent: _Node | None) -> None:
        self.name, self.attributes, self.parent = name, attributes, parent
        self.children: list[_Node | str] = []
        self.score = 0.0
        self.size = self.linked = self.prose = self.links = 0  # characters of text, of it in links, of it in running text; number of links
        self.holds = name in ("article", "main", "h1")  # the node or one below it is such an element


def suspicion(name: str) -> int:
    """What a class name or id says: 3 never the article, 2 hardly, 1 its first word alone might say so, 0 nothing.

    The last word that isn't generic says what an element is (`post-comments`, `sidebar-left`), the first what it is about.
    """
    if _SITE_HEADER.fullmatch(name):
        return 2
    words = _WORDS.findall(name)
    if any(w.lower() in _SAYS_ONLY for w in words):
        return 0
    while len(words) > 1 and (words[-1].lower() in _GENERIC or words[-1].isdigit()):
        words.pop()
    if not words:
        return 0
    if _NEVER.fullmatch(words[-1]):
        return 3
    if _OFTEN.fullmatch(words[-1]) or re.fullmatch("comments?", words[0], re.I):
        return 2
    return 1 if _NEVER.fullmatch(words[0]) or _OFTEN.fullmatch(words[0]) else 0


def _suspicion(x: _Node) -> int:
    if not x.attributes or x.name in _KEEP_NAMES:
        return 0
    names = [n for key, *v in _ATTRIBUTE.findall(x.attributes) if key.lower() in ("class", "id") for n in (v[0] or v[1] or v[2]).split()]
    return max(map(suspicion, names), default=0)


def _unwanted(name: str, attributes: str) -> bool:
    """Elements that are left out whatever they hold: by their name, their role, or because they are hidden."""
    if name in _DROP:
        return True
    if not attributes or name in _KEEP_NAMES:
        return False
    for key, *values in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), values[0] or values[1] or values[2]
        if key == "role" and value.lower() in ("navigation", "banner", "contentinfo", "complementary", "search", "alert", "dialog", "form", "menu"):
            return True
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
    return False


class _Tree:
    """The element that is open, and how often each name is open around it, so that most questions need no walk."""

    def __init__(self) -> None:
        self.top = _Node("html", "", None)
        self.nodes = [self.top]  # parents before children
        self.open: Counter = Counter()

    def add(self, name: str, attributes: str, stay: bool = True) -> None:
        node = _Node(name, attributes, self.top)
        self.top.children.append(node)
        self.nodes.append(node)
        if stay:
            self.top = node
            self.open[name] += 1

    def find(self, names: frozenset | set, stop: frozenset | set = frozenset()) -> _Node | None:
        """The innermost open element of these names, if none of the stops is nearer."""
        if not any(self.open[n] for n in names):
            return None
        node: _Node | None = self.top
        while node is not None:
            if node.name in names:
                return node
            if node.name in stop:
                return None
            node = node.parent
        return None

    def close(self, node: _Node | None) -> bool:
        """Ends a node and all that is open in it."""
        if node is None or node.parent is None:
            return False
        while True:
            top = self.top
            self.open[top.name] -= 1
            self.top = top.parent
            if top is node:
                return True


def parse(page: str, forms: bool = False) -> list[_Node]:
    """A tolerant tree, its nodes with the root first and parents before children.

    Unclosed paragraphs, items and cells end where the next begins, stray end tags are skipped, unwanted elements are left
    out. forms: keep forms and what they hold, for pages that are one form as a whole.
    """
    tree = _Tree()
    skip: list[str] = []  # open elements below an unwanted one
    skipped: Counter = Counter()
    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        text = page[at : m.start() if m else n]
        if text and not skip:
            tree.top.children.append(html.unescape(text) if "&" in text else text)
        if not m:
            break
        at = m.end()
        name = m[2]
        if name is None:
            continue
        name = name.lower()
        if m[1]:
            if skip:
                if skipped[name]:
                    while True:
                        gone = skip.pop()
                        skipped[gone] -= 1
                        if gone == name:
                            break
                    continue
                # the end of something around the unwanted element also ends that one, unless it is inline
                if name in _BLOCK and tree.open[name]:
                    skip.clear()
                    skipped.clear()
                else:
                    continue
            if not tree.close(tree.find({name})) and name in ("p", "br"):
                tree.add(name, "", False)
            continue
        attributes = m[3] or ""
        void = name in _VOID or attributes.endswith("/") and name in ("svg", "path", "use")
        if name in _RAW and not void:
            end = re.compile(rf"</{name}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else n
            continue
        if skip:
            if not void and not (name == skip[-1] and name in ("p", "li")):
                skip.append(name)
                skipped[name] += 1
            continue
        if name in ("html", "body"):
            if name == "body" and not tree.open["body"]:
                tree.add("body", attributes)
            continue
        if name in _CLOSES_P:
            tree.close(tree.find({"p"}, _STOP_P))
        if name in _SAME:
            tree.close(tree.find(_SAME[name], _STOP[name]))
        site_header = name == "header" and not tree.open["article"] and not tree.open["main"]
        if site_header or _unwanted(name, attributes) and not (forms and name == "form"):
            if not void:
                skip.append(name)
                skipped[name] += 1
            elif name in _BLOCK:
                tree.add(name, "", False)
            continue
        tree.add(name, attributes, not void)
    return tree.nodes


_STOP_P = frozenset(("table", "td", "th", "caption", "button", "object"))


def blocks(node: _Node) -> list[tuple[_Node, str, int]]:
    """The text blocks below a node in page order: innermost block element, text, length of its links."""
    out: list[tuple[_Node, str, int]] = []
    parts: list[str] = []
    linked = spoken = 0

    def end(owner: _Node) -> None:
        nonlocal linked, spoken
        text = " ".join("".join(parts).split())
        if text and spoken:  # the labels of controls alone are none of the text
            out.append((owner, text, min(linked, len(text))))
        parts.clear()
        linked = spoken = 0

    # an explicit stack, so that deep pages don't exhaust Python's
    stack: list[tuple[_Node, int, _Node, bool]] = [(node, 0, node, False)]
    while stack:
        x, k, owner, link = stack.pop()
        if k == len(x.children):
            if x.name in _BLOCK:
                end(x)
            continue
        stack.append((x, k + 1, owner, link))
        child = x.children[k]
        if isinstance(child, str):
            parts.append(child)
            if x.name != "label":
                spoken += len(child.strip())
            if link:
                linked += len(child.strip())
        elif child.name == "br":
            end(owner)
        elif child.name in _BLOCK:
            end(owner)
            stack.append((child, 0, child, link))
        else:
            stack.append((child, 0, owner, link or child.name == "a"))
    end(node)
    return out


def main_text(page: str | None) -> str:
    """The article of a page, one line for each block. Null, empty and pages without text give ''.

    Where no text is left, the page is read again by what is never the article alone, then with its forms, if one as a whole holds
    running text.
    """
    if not page:
        return ""
    text = _best(parse(page), 2) or _best(parse(page), 3)
    if not text and _FORM.search(page):
        nodes = parse(page, forms=True)
        text = _best(nodes, 3)
        text = text if nodes[0].prose else ""
    return text


_FORM = re.compile(r"<form[\s>]", re.I)
_LEGAL = re.compile(r"©|\(c\)\s*\d{4}|copyright|all rights reserved|powered by", re.I)
_HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))


def _dense(x: _Node) -> float:
    return x.linked / max(x.size, 1)


def _runs_on(text: str, linked: int) -> bool:
    """Whether a block reads like running text."""
    return 4 * linked < len(text) and (len(text) > 80 or text.count(" ") >= 11)


def _measured(nodes: list[_Node]) -> list[tuple[_Node, str, int]]:
    """The page's blocks; sets what each node holds."""
    for x in nodes:
        x.score, x.size, x.linked, x.prose, x.links = 0.0, 0, 0, 0, int(x.name == "a")
    found = blocks(nodes[0])
    for owner, text, linked in found:
        owner.size += len(text)
        owner.linked += linked
        owner.prose += len(text) * _runs_on(text, linked)
    for x in reversed(nodes):
        if x.parent is not None:
            for part in ("size", "linked", "prose", "links"):
                setattr(x.parent, part, getattr(x.parent, part) + getattr(x, part))
            x.parent.holds |= x.holds
    return found


def _pruned(nodes: list[_Node], least: int) -> list[_Node]:
    """The nodes without those that their names and what they hold make out not to be the article. least: the suspicion from which names count."""
    total = nodes[0].prose
    gone: set[int] = set()
    out = []
    for x in nodes:
        if x.parent is not None and id(x.parent) in gone:
            gone.add(id(x))
            continue
        level = _suspicion(x)
        if level == 3:
            drop = not (x.holds and 2 * x.prose > total)
        elif level == 2:
            drop = least <= 2 and (2 * x.linked >= x.size or not (x.holds or 5 * x.prose > 3 * total))
        else:
            drop = level == 1 and least <= 2 and (5 * x.linked >= 2 * x.size or not x.prose) and not (x.holds and x.prose)
        if drop and x.parent is not None:
            gone.add(id(x))
            continue
        out.append(x)
    for x in out:
        x.children = [c for c in x.children if isinstance(c, str) or id(c) not in gone]
    return out


def _best(nodes: list[_Node], least: int) -> str:
    _measured(nodes)
    nodes = _pruned(nodes, least)
    found = _measured(nodes)
    if not found:
        return ""
    scored: dict[int, _Node] = {}
    for owner, text, _ in found:
        points = 1 + text.count(",") + text.count("，") + text.count("、") + min(len(text) / 100, 3)
        container = owner.parent if owner.name in _SCORED and owner.parent is not None else owner
        for k, up in ((1.0, container), (0.5, container.parent)):
            if up is not None:
                if id(up) not in scored:
                    scored[id(up)] = up
                    up.score += _prior(up)
                up.score += points * k
    for x in scored.values():
        x.score *= 1 - _dense(x)
    best = max(scored.values(), key=lambda x: x.score)
    article = [x for x in _ancestors(best) if x.name == "article"]
    best = _widened(article[-1] if article else best)
    if best.parent is None or best.name in ("html", "body"):
        return "\n".join(t for _, t, _ in blocks(best))
    return "\n".join(t for x in _with_siblings(best) for _, t, _ in blocks(x))


def _widened(best: _Node) -> _Node:
    """The outermost element around the best container in which what stands beside it is text: titles, further sections, closing lines."""
    x = best
    while (up := x.parent) is not None and up.name not in ("html", "body") and x.name not in ("article", "main"):
        size, linked = up.size - x.size, up.linked - x.linked
        if size and not (10 * linked < 3 * size or up.name == "main") or up.name in ("td", "tr", "table", "tbody", "ul", "ol"):
            break
        x = up
    return x


def _with_siblings(best: _Node) -> list[_Node]:
    """The best container and those of its siblings that go with it, in page order."""
    least = max(10.0, 0.2 * best.score)
    near = [c for c in best.parent.children if isinstance(c, _Node)]
    scored = [x is best or x.score >= least or bool(x.prose) and 5 * x.linked < x.size for x in near]
    first, last = scored.index(True), len(scored) - 1 - scored[::-1].index(True)
    out = []
    for k, (x, good) in enumerate(zip(near, scored, strict=True)):
        text = x.size and 4 * x.linked < x.size
        between = first < k < last and text
        title = k < first and x.name in _HEADINGS and text
        closing = k > last and text and x.name in ("p", "section", "blockquote", "pre") and not (x.size < 300 and any(_LEGAL.search(t) for _, t, _ in blocks(x)))
        if good or between or title or closing:
            out.append(x)
    return out


def _prior(x: _Node) -> float:
    base = {"article": 10.0, "main": 8.0, "div": 5.0, "section": 3.0, "td": 3.0, "blockquote": 3.0, "ul": -3.0, "ol": -3.0, "dl": -3.0, "header": -5.0, "html": -10.0}.get(x.name, 0.0)
    return base + (5.0 if x.attributes and x.name not in ("html", "body") and any(k.lower() in ("class", "id") and _GOOD.search(v[0] or v[1] or v[2]) for k, *v in _ATTRIBUTE.findall(x.attributes)) else 0.0)


def _ancestors(x: _Node | None) -> Iterator[_Node]:
    while x is not None:
        yield x
        x = x.parent


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for lo in range(0, whole.num_rows, 500):
            batch = whole.slice(lo, 500)
            texts = [main_text(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["id", "url", "text"])


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Main text of every page: id, url, text, n_chars long (code points).

    Character references are decoded, white space inside a block becomes one blank, blocks are trimmed and joined in page
    order by one line feed. Null and empty pages and pages without an article give ''. Null ids and urls are kept;
    repeated rows give repeated results; other columns are ignored; an empty table gives an empty result.
    """
    rows = pages.select(column(id_col).cast("long").alias("id"), column(url_col).alias("url"), column(html_col).alias("html"))
    out = rows.mapInArrow(_extract, "id long, url string, text string")
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", F.length("text").cast("long").alias("n_chars"))
