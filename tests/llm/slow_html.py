"""A second, slow version of the extraction: the standard library's parser, and points by their definition over every pair of paragraph and ancestor."""

from html.parser import HTMLParser

BLOCKS = set("article aside blockquote body dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table tbody td th tr ul".split())
GONE = set("script style title textarea iframe noscript button select nav footer aside form".split())
NAMES = set("sidebar comments comment related share cookie-notice newsletter ad banner breadcrumb menu advert promo".split())
OWN = set("article articles post entry content contents body text main story page blog hentry".split())
BASE = {"article": 25, "main": 15, "section": 3, "div": 5, "pre": 3, "td": 3, "blockquote": 3, "ol": -3, "ul": -3, "dl": -3, "dd": -3, "dt": -3, "li": -3, "th": -5}


class Reader(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.path, self.blocks, self.text, self.nodes = [("html", frozenset(), 0)], [], [], 1

    def flush(self):
        """A block is (path of elements, text, text in links)."""
        words = " ".join("".join(t for t, _ in self.text).split())
        if words and not any(tag in GONE or names & NAMES or tag == "header" and not any(t in ("article", "main") for t, *_ in self.path[:k]) for k, (tag, names, _) in enumerate(self.path)):
            at = max(k for k, x in enumerate(self.path) if x[0] in BLOCKS or k == 0)
            self.blocks.append((tuple(self.path[: at + 1]), words, sum(len(t.strip()) for t, link in self.text if link)))
        self.text = []

    def handle_starttag(self, tag, attrs):
        if tag in ("html", "head", "meta", "link", "br", "img", "input"):
            self.text += [(" ", False)] * (tag == "br")
            return
        if tag in BLOCKS:
            self.flush()
            if self.path[-1][0] == "p":
                self.path.pop()
        self.path.append((tag, frozenset(w for k, v in attrs if k in ("class", "id", "role") for w in (v or "").lower().split()), self.nodes))
        self.nodes += 1

    def handle_endtag(self, tag):
        if any(x[0] == tag for x in self.path[1:]):
            if tag in BLOCKS or tag in GONE:
                self.flush()
            while self.path.pop()[0] != tag:
                pass

    def handle_data(self, data):
        if not any(x[0] in ("script", "style", "title") for x in self.path):
            self.text.append((data, any(x[0] == "a" for x in self.path)))


def slow_text(page):
    reader = Reader()
    reader.feed(page or "")
    reader.flush()
    if not reader.blocks:
        return ""
    points, chars, linked, nodes = {}, {}, {}, {}
    for path, text, links in reader.blocks:
        for node in path:
            nodes[node[2]] = path[: path.index(node) + 1]
            points.setdefault(node[2], BASE.get(node[0], 0) + (25 if any(w in OWN for n in node[1] for w in n.split("-")) else 0))
            chars[node[2]] = chars.get(node[2], 0) + len(text)
            linked[node[2]] = linked.get(node[2], 0) + links
    for path, text, _ in reader.blocks:
        if path[-1][0] in ("h1", "h2", "h3", "h4", "h5", "h6"):
            continue
        worth = min(1.0, len(text) / 25) + text.count(",") + min(len(text) / 100, 3.0)
        outer = list(reversed(path))[path[-1][0] in ("p", "pre", "blockquote", "td", "li", "dd") and len(path) > 1 :]
        for level, node in enumerate(outer[:5]):
            points[node[2]] += worth / (1, 2, 6, 9, 12)[level]
    score = {k: points[k] * (1 - min(1.0, linked[k] / chars[k])) for k in points}
    best = nodes[max((k for k in points if nodes[k][-1][0] in BLOCKS or k == 0), key=lambda k: (score[k], -k))]
    best = next((best[: k + 1] for k, x in enumerate(best) if x[0] == "article"), best)
    return "\n".join(text for path, text, _ in reader.blocks if path[: len(best)] == best)
