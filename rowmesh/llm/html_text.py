"""Main text of raw pages by tree scoring.

Each paragraph passes points for its length and commas to the elements around it,
fewer the further out they are; what an element gathers is discounted by the share
of its text that lies in links. The element with most points is the article, with
those of its siblings that look like more of it.
"""

from __future__ import annotations

import html as references
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small

# Element names of HTML by how they are treated.
VOID = frozenset("area base basefont bgsound br col embed frame hr img input keygen link meta param source track wbr".split())
RAW = frozenset("script style title textarea iframe noembed noframes xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html "
    "legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
DROPPED = frozenset("script style title textarea iframe noembed noframes xmp noscript template object embed svg math canvas video audio button select".split())
#: Dropped unless they turn out to hold the article.
FRAME = frozenset("nav footer aside form menu dialog search".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PARAGRAPHS = frozenset("p pre blockquote td li dd figcaption center".split())
TAG_POINTS = {"article": 25, "main": 15, "section": 3, "div": 5, "pre": 3, "td": 3, "blockquote": 3, "ol": -3, "ul": -3, "dl": -3, "dd": -3, "dt": -3, "li": -3, "address": -3, "th": -5}
# Words of class, id and role that name what isn't the article, and what is.
#: Foreign where such a word begins or ends a name (main-navigation, sidebar-left).
STRONG = frozenset(
    "ad ads advert adverts advertisement advertisements advertising sponsor sponsored promo promotion menu nav navbar navigation navigations breadcrumb breadcrumbs sidebar footer masthead "
    "cookie cookies consent gdpr popup modal overlay newsletter subscribe subscription login signup toolbar pagination pager contentinfo complementary".split()
)
#: Foreign only where a name has no other words (alert-box, but not elementor-widget or side-by-side).
WEAK = frozenset("banner side rail widget widgets foot notice notices share sharing social search skip hidden header alert dialog".split())
#: Words that say where or how an element is, not what.
NEUTRAL = frozenset(
    "container wrapper wrap box block area section inner outer bar list item items link links button buttons icon icons left right top bottom row col column columns group slot unit form panel "
    "region module active open closed mobile desktop sticky fixed title label site js sm md lg xl".split()
)
OWN = frozenset("article articles post entry content contents body text main story page blog hentry".split())
#: Foreign wherever the word stands: what readers wrote, and other articles.
OTHERS = frozenset("respond discussion disqus reply replies related recommended recommendations".split())
_COMMENTS = re.compile(r"(?!no)[a-z]*comments?(?:list|area|box|form|block|section|wrapper|thread|feed)?")
#: A class that begins with one of these says what a page has or lacks, not what the element is.
STATES = frozenset("has have no with without not show hide supports enable enabled disable disabled".split())
#: What a start of each of these ends, and where the search for it stops.
CLOSES = {
    "li": ("li", "ul ol menu dir"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"),
    "option": ("option", "select"), "thead": ("thead tbody tfoot tr td th", "table"), "tbody": ("thead tbody tfoot tr td th caption", "table"), "tfoot": ("thead tbody tfoot tr td th", "table"),
}
CLOSES = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in CLOSES.items()}

# A quote only opens a value right after "="; one that never closes is an ordinary character. So a tag fails to match only if no ">" follows.
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)>")
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
_INTERESTING = re.compile(r"class|id|role|hidden|style", re.IGNORECASE)
_NO_DISPLAY = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)


#: What puts an element in doubt, from what is undone first to last.
BY_WEAK, BY_STRONG, BY_OTHERS, BY_FRAME = 1, 2, 3, 4


@lru_cache(maxsize=1 << 16)
def _named(name: str) -> tuple[frozenset[str], int]:
    """The words of one class, id or role, and the doubt that the name as a whole raises."""
    words = re.findall(r"[a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", name).lower())
    if not words or len(words) > 1 and words[0] in STATES:
        return frozenset(), 0
    if any(w in OTHERS or _COMMENTS.fullmatch(w) for w in words):
        return frozenset(words), BY_OTHERS
    core = [w for w in words if w not in NEUTRAL]
    if core and (core[0] in STRONG or core[-1] in STRONG):
        return frozenset(words), BY_STRONG
    return frozenset(words), BY_WEAK if core and all(w in WEAK for w in core) else 0


class Element:
    """An element; `gone` if it is dropped, `doubt` (why) if it is dropped unless it turns out to hold the article."""

    __slots__ = ("tag", "parent", "names", "gone", "doubt", "depth", "within", "kids", "link", "number", "last", "points", "chars", "linked", "own", "weight", "cores", "cut")

    def __init__(self, tag: str, parent: Element | None, attributes: str = ""):
        self.tag, self.parent, self.kids = tag, parent, []
        self.names: frozenset[str] = frozenset()
        self.depth = parent.depth + 1 if parent is not None else 0
        self.gone, self.doubt = tag in DROPPED, BY_FRAME if tag in FRAME else 0
        self.link = tag == "a" or parent is not None and parent.link
        #: Whether an article or main element lies around this one.
        self.within = parent is not None and (parent.within or parent.tag in ("article", "main"))
        self.points, self.chars, self.linked, self.own, self.weight, self.cores, self.cut = 0.0, 0, 0, 0, 0, 0, False
        if attributes and _INTERESTING.search(attributes):
            self._read(attributes)
        if tag == "header" and not self.within:
            self.doubt = BY_FRAME

    def _read(self, attributes: str) -> None:
        doubts = [self.doubt]
        for name, value in _ATTRIBUTE.findall(attributes):
            name, value = name.lower(), value.strip("\"'")
            if name in ("class", "id", "role"):
                for whole in value.split():
                    words, doubt = _named(whole)
                    self.names |= words
                    doubts.append(doubt)
            elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and _NO_DISPLAY.search(value):
                doubts.append(BY_STRONG)
        worst = max(doubts)
        if self.tag not in ("html", "body", "article", "main") or worst == BY_OTHERS and self.tag == "article":
            # A weak or strong word says little beside one that names content.
            self.doubt = 0 if worst == BY_WEAK and self.names & OWN else worst

    @property
    def readers(self) -> bool:
        """Whether the name is that of what readers wrote or of other articles."""
        return self.doubt == BY_OTHERS or any(w in OTHERS or _COMMENTS.fullmatch(w) for w in self.names)


def parse(page: str) -> Element:
    """The page as a tree; text lies in kids as strings, character references still in it. Any input gives a tree."""
    root = top = Element("html", None)
    #: Depths of the open elements of each tag.
    open_tags: dict[str, list[int]] = {"html": [0]}
    at, n, last_end = 0, len(page), page.rfind(">")
    deepest = lambda tags: max((d[-1] for t in tags if (d := open_tags.get(t))), default=-1)

    def leave() -> None:
        nonlocal top
        open_tags[top.tag].pop()
        top = top.parent

    def close(tags: frozenset[str], stop: frozenset[str]) -> None:
        """End the open elements of these tags that lie within the innermost of `stop`."""
        least = deepest(stop)
        while (depth := deepest(tags)) > least:
            while top.depth >= depth:
                leave()

    while at < n:
        lt = page.find("<", at)
        if lt < 0 or lt > last_end:
            top.kids.append(page[at:])
            break
        if lt > at:
            top.kids.append(page[at:lt])
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = n if end < 0 else end + 3
            continue
        if page[lt + 1 : lt + 2] in ("!", "?"):
            at = page.find(">", lt) + 1 or n
            continue
        m = _TAG.match(page, lt)
        if m is None:
            nxt = page[lt + 1 : lt + 3]
            if nxt[:1].isalpha() and nxt.isascii() or nxt[:1] == "/":
                at = page.find(">", lt) + 1 or n
            else:
                top.kids.append("<")
                at = lt + 1
            continue
        at = m.end()
        tag = m[2].lower()
        if m[1]:
            if tag in ("html", "body", "head") or not open_tags.get(tag):
                if tag == "br":
                    top.kids.append(" ")
                continue
            while top.tag != tag:
                leave()
            leave()
            continue
        if tag in ("html", "head"):
            continue
        if tag in VOID:
            if tag == "hr":
                close(frozenset({"p"}), frozenset({"table", "td", "th"}))
                top.kids.append(Element("hr", top))
            elif tag == "br":
                top.kids.append(" ")
            continue
        if tag in RAW:
            found = re.compile(f"</{tag}", re.IGNORECASE).search(page, at)
            at = (page.find(">", found.end()) + 1 or n) if found else n
            continue
        if tag in BLOCK and open_tags.get("p"):
            close(frozenset({"p"}), frozenset({"table", "td", "th", "button", "object"}))
        if tag in HEADINGS and top.tag in HEADINGS:
            close(HEADINGS, frozenset({"div", "body"}))
        if tag in CLOSES:
            close(*CLOSES[tag])
        if m[3].endswith("/") and tag in ("svg", "path", "use"):
            continue
        top = _under(top, tag, m[3])
        open_tags.setdefault(tag, []).append(top.depth)
    return root


def _under(parent: Element, tag: str, attributes: str) -> Element:
    kid = Element(tag, parent, attributes)
    parent.kids.append(kid)
    return kid


def settle(root: Element) -> None:
    """Decide every doubtful element by what it holds, and mark those that go.

    The weight of an element is its text outside links and dropped elements. A
    doubtful one stays if it holds half of the page's weight and, unless it is a form or
    its own name says content, also every article and main element of the page (or,
    on a page without these, its first-level headings). Then names are doubted where
    they leave too little: elements with weak names stay if without them less than half
    would be left, those with strong names if less than a tenth would, and of these
    only such as hold, with their doubtful siblings, half of the text. If nothing is left
    so, those with half of the weight stay, but no menus, footers and the like.
    """
    order = [root]
    for node in order:
        order += [k for k in node.kids if isinstance(k, Element) and not k.gone]
    marks = ("article", "main")
    if not any(x.tag in marks and not x.doubt for x in order):
        marks = ("h1",)
    for node in order:
        node.own = 0 if node.link else sum(len(k) - k.count(" ") for k in node.kids if isinstance(k, str) and not k.isspace())
    for node in reversed(order):
        node.weight += node.own
        node.cores += node.tag in marks and not node.doubt
        if node.parent is not None:
            node.parent.weight += node.weight
            node.parent.cores += node.cores
    unsure = [x for x in order if x.doubt]
    for x in unsure:
        large = 2 * x.weight >= root.weight and x.weight > 0
        named = x.tag == "form" or x.names & OWN and not x.readers and x.tag not in FRAME
        x.gone = not (large and (named or 0 < x.cores == root.cores))
    if not root.weight or not any(x.gone for x in unsure):
        return
    for most, share in ((BY_WEAK, 2), (BY_STRONG, 10)):
        whole = _weight(order, most)
        if share * _weight(order, 0) < whole:
            together: dict[int, int] = {}
            for x in unsure:
                if x.gone and x.doubt <= most:
                    together[id(x.parent)] = together.get(id(x.parent), 0) + x.weight
            for x in unsure:
                if x.gone and x.doubt <= most and (most == BY_WEAK or 2 * together[id(x.parent)] >= whole):
                    x.gone = False
    if not _left(root):
        for x in unsure:
            x.gone = x.gone and (2 * x.weight < root.weight or x.tag in FRAME and x.tag != "form")


def _weight(order: list[Element], undone: int) -> int:
    """The text that is left if doubts up to `undone` don't count; parents come before their kids."""
    for x in order:
        x.cut = x.gone and x.doubt > undone or x.parent is not None and x.parent.cut
    return sum(x.own for x in order if not x.cut)


def _left(root: Element) -> bool:
    """Whether any text is left outside what goes."""
    nodes = [root]
    while nodes:
        node = nodes.pop()
        for k in node.kids:
            if isinstance(k, str):
                if not k.isspace() and k:
                    return True
            elif not k.gone:
                nodes.append(k)
    return False


def blocks(root: Element) -> tuple[list[tuple[Element, str]], list[Element]]:
    """(block element, its text) in page order, white space made one and ends trimmed, and all kept elements in page order."""
    out: list[tuple[Element, str]] = []
    order: list[Element] = []
    held: list[str] = []
    owner = root

    def flush() -> None:
        if held:
            text = "".join(held)
            held.clear()
            text = " ".join((references.unescape(text) if "&" in text else text).split())
            if text:
                out.append((owner, text))

    stack: list[tuple[Element, int, Element]] = []
    root.number, node, k, around = 0, root, 0, root
    order.append(root)
    while True:
        if k < len(node.kids):
            kid = node.kids[k]
            k += 1
            if isinstance(kid, str):
                held.append(kid)
                if node.link and (size := len(kid.strip())):
                    around.linked += size
            elif not kid.gone:
                stack.append((node, k, around))
                kid.number = len(order)
                order.append(kid)
                if kid.tag in BLOCK:
                    flush()
                    owner = around = kid
                node, k = kid, 0
            elif kid.tag in BLOCK:
                flush()
            continue
        if node.tag in BLOCK:
            flush()
        node.last = len(order)
        if not stack:
            return out, order
        node, k, around = stack.pop()
        owner = around


def main_text(page: str | None) -> str:
    """The article of a page: its blocks in page order, joined by line ends; empty for a null or empty page."""
    if not page:
        return ""
    root = parse(page)
    settle(root)
    found, order = blocks(root)
    if not found:
        return ""
    for node in order:
        node.points = TAG_POINTS.get(node.tag, 0) + (25 if node.names & OWN else 0)
    for node, text in found:
        node.chars += len(text)
        if node.tag in HEADINGS:
            continue
        points = min(1.0, len(text) / 25) + text.count(",") + text.count("，") + min(len(text) / 100, 3.0)
        up, level = (node.parent if node.tag in PARAGRAPHS and node.parent is not None else node), 0
        while up is not None and level < 5:
            up.points += points / (1 if level == 0 else 2 if level == 1 else 3 * level)
            up, level = up.parent, level + 1
    for node in reversed(order):
        if node.parent is not None:
            node.parent.chars += node.chars
            node.parent.linked += node.linked

    def score(node: Element) -> float:
        return node.points * (1 - min(1.0, node.linked / node.chars)) if node.chars else 0.0

    best = max((x for x in order if x.chars and x.tag in BLOCK), key=lambda x: (score(x), -x.number))
    best = up = _spread(best)
    while up is not None:
        if up.tag == "article" or up.tag == "main" and best.tag not in ("article", "main"):
            best = up
        up = up.parent
    chosen = [best]
    if best.parent is not None:
        chosen += _siblings(best, score)
    # Siblings don't overlap, so the last one that begins before a block decides.
    chosen.sort(key=lambda x: x.number)
    begins = [x.number for x in chosen]
    return "\n".join(text for node, text in found if (k := bisect_right(begins, node.number)) and node.number < chosen[k - 1].last)


def _spread(best: Element) -> Element:
    """The element over which the article is spread: one with several kids of one kind (tag and names), few links in them, of which the one that holds `best` has the lesser part of the text."""
    node, found = best, best
    while node.parent is not None and node.parent.tag not in ("body", "html"):
        up = node.parent
        alike = [k.chars - k.linked for k in up.kids if isinstance(k, Element) and not k.gone and k.chars and k.tag == node.tag and k.names == node.names and 4 * k.linked < k.chars]
        text = sum(alike)
        if len(alike) > 1 and 5 * (node.chars - node.linked) <= 3 * text and 2 * text >= up.chars - up.linked:
            found = up
        node = up
    return found


def _siblings(best: Element, score) -> list[Element]:
    """Siblings that belong to the article. Beside an article element these are only other articles; else what scores or reads like paragraphs, and headings right before."""
    least = max(10.0, 0.2 * score(best))
    kids = [x for x in best.parent.kids if isinstance(x, Element) and not x.gone and x.chars]
    kept = []
    for x in kids:
        if x is best:
            continue
        links = x.linked / x.chars
        if best.tag in ("article", "main"):
            good = x.tag == best.tag and score(x) >= least
        elif x.tag == "p":
            good = links < 0.25 and x.chars > 80 or links == 0
        else:
            good = score(x) >= least
        if good:
            kept.append(x)
    mine = {id(x) for x in kept} | {id(best)}
    for x, after in zip(reversed(kids[:-1]), reversed(kids[1:])):
        if best.tag not in ("article", "main") and x.tag in HEADINGS and id(after) in mine and id(x) not in mine:
            kept.append(x)
            mine.add(id(x))
    return kept


TEXTS = "page_id long, url string, text string, n_chars long"


def extracted(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of each page: the main text of the whole html (null as empty) and its code points.

    Pages are read one by one, so equal rows give equal results, also those that
    share a page_id or have none; other columns don't matter. A page without an
    article, and a null or empty html, give an empty text; no pages give no rows.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            texts = [main_text(h) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(each, TEXTS)
