"""Articles in many frames, whose text is known because the page was built around it."""

import random
import time

import pytest

from rowmesh.llm.html_text import main_text
from tests.llm.slow_html import slow_text

WORDS = "river stone market harvest letter window winter bridge garden captain silver morning road village engine paper".split()


def sentence(rng, n=18):
    return " ".join(rng.choice(WORDS) for _ in range(n)).capitalize() + ", " + " ".join(rng.choice(WORDS) for _ in range(n)) + "."


def article(rng, n=5):
    parts = ["A title of some words", *(sentence(rng) for _ in range(n))]
    return parts, f"<h1>{parts[0]}</h1>" + "".join(f"<p>{x}</p>" for x in parts[1:])


def noise(rng, n=2):
    return "".join(f"<p>{sentence(rng, 8)}</p>" for _ in range(n))


MENU = "<nav><ul>" + "".join(f"<li><a href='/{k}'>Item {k}</a></li>" for k in range(9)) + "</ul></nav>"
FRAMES = {
    "form around the page": "<body><form id=aspnetForm action=/x>{menu}<div id=wrap><div>{a}</div></div><footer>{n}</footer></form></body>",
    "form around the article": "<body>{menu}<form><div>{a}</div><input><button>Go</button></form><footer>{n}</footer></body>",
    "form below the article": "<body><div><div>{a}</div><form><p>{s}</p><input></form></div></body>",
    "has-sidebar": "<body>{menu}<div class='site-content has-sidebar'>{a}</div><div class=sidebar>{n}</div></body>",
    "no-sidebar": "<body><div class='post-content no-sidebar'>{a}</div></body>",
    "no-comments": "<body>{menu}<article class='post no-comments'>{a}</article><footer>{n}</footer></body>",
    "has-share-buttons": "<body><div class='entry has-share-buttons'>{a}</div><div class=share>Share this</div></body>",
    "with-comments": "<body><div id=page class='with-comments'>{a}<div class=comments>{n}</div></div></body>",
    "name of the layout": "<body><div class='layout-sidebar-right'><main>{a}</main><div class=sidebar>{n}</div></div></body>",
    "share in the article's name": "<body><div class='article-body share-enabled'>{a}</div><div class=related>{n}</div></body>",
    "many comments": "<body><div class=text>{a}</div><section id=comments>{many}</section></body>",
    "comments as articles": "<body><article>{a}</article><div class=replies><article class=comment>{many}</article></div></body>",
    "long attribute": "<body><div>{a}</div><div class=sidebar data-x='{long}'>{n}</div></body>",
    "quote without an end": "<body><div title=\"x>{a}</div><div class=sidebar>{n}</div></body>",
    "cookie notice": "<body><div class='cookie-notice'>{n}</div><div>{a}</div></body>",
    "advert inside": "<body><div>{a}<div class='ad banner'>{n}</div></div></body>",
    "header of the site": "<body><header class=masthead><p>{s}</p></header><main>{a}</main></body>",
    "header that never ends": "<body><header><div>logo</div><article>{a}</article></body>",
    "related stories": "<body><article>{a}</article><div class=related>{n}{n}</div></body>",
    "newsletter box": "<body><main>{a}</main><aside>{n}</aside><div id=newsletter-signup><p>{s}</p></div></body>",
    "old table layout": "<body><table><tr><td>{menu}</td><td>{a}</td></tr></table></body>",
    "hidden notice": "<body><div style='display:none'>{n}</div><div>{a}</div></body>",
}

#: Names that say little: each around every paragraph ({p}) of an article, or around all of it ({a}).
NAMES = {
    "site builder": "<body>{menu}<div class='elementor-widget-wrap'>{each}</div><footer>{n}</footer></body>|<div class='elementor-element elementor-widget'><div class='elementor-widget-container'>{p}</div></div>",
    "alert boxes": "<body>{menu}{each}<footer>{n}</footer></body>|<section class=alert-box>{p}</section>",
    "paragraphs of speech": "<body><main>{each}</main><aside>{n}</aside></body>|<p class=dialog>{x}</p>",
    "drop caps": "<body><main>{each}</main></body>|<p class=skip-dropcap>{x}</p>",
    "boxes side by side": "<body><main>{each}</main></body>|<div class=side-by-side>{p}</div>",
    "issues": "<body><main>{each}</main></body>|<div class=social-issues>{p}</div>",
    "overflow": "<body><article>{each}</article></body>|<div class=overflow-hidden>{p}</div>",
    "left side": "<body>{menu}<h1>{t}</h1><div class=left-side>{ps}</div><footer>{n}</footer></body>|",
    "share text": "<body><h1>{t}</h1>{each1}</body>|<p class='paragraph share-text'>{x}</p>",
    "boxes in a column": "<body><div class=col>{each}</div><div class=sidebar>{n}</div></body>|<div class='notice box'>{p}</div>",
    "comment list": "<body><div id=wrap>{a}</div><ol class=commentlist><li>{n}</li><li>{n}</li></ol></body>|",
    "user comments": "<body><article>{a}<div class=usercomments>{n}</div></article></body>|",
    "commentary": "<body><div class=commentary>{a}</div><div class=readerComments>{n}{n}{n}{n}{n}{n}</div></body>|",
    "names of a theme": "<body><div class=site-header><p>{s}</p></div><div class=main-navigation><p>{s}</p></div><div class=site-main>{a}</div><div class=widget-area>{n}</div><div class=site-footer>{n}</div></body>|",
    "short article, long sidebar": "<body><div class=col><h1>{t}</h1><p>{x1}</p></div><div class=sidebar>{n}{n}</div></body>|short",
}


@pytest.mark.parametrize("name", NAMES)
def test_names_that_say_little(name):
    for seed in range(5):
        rng = random.Random(seed)
        parts, a = article(rng, 4)
        outer, _, each = NAMES[name].partition("|")
        wrap = lambda x: each.format(p=f"<p>{x}</p>", x=x)
        heading = each.format(p=f"<h1>{parts[0]}</h1>", x=parts[0])
        ps = "".join(f"<p>{x}</p>" for x in parts[1:])
        one = each == "short"
        page = outer.format(a=a, t=parts[0], ps=ps, x1=parts[1], menu=MENU, n=noise(rng), s=sentence(rng, 6), each="" if one else heading + "".join(map(wrap, parts[1:])), each1="" if one else "".join(map(wrap, parts[1:])))
        assert main_text(f"<!DOCTYPE html><html>{page}</html>").split("\n") == (parts[:2] if one else parts)


@pytest.mark.parametrize("name", FRAMES)
def test_article_in_a_frame(name):
    for seed in range(5):
        rng = random.Random(seed)
        parts, a = article(rng, 4 + seed)
        page = FRAMES[name].format(a=a, menu=MENU, n=noise(rng), s=sentence(rng, 6), many=noise(rng, 30), long="x" * 70_000)
        assert main_text(f"<!DOCTYPE html><html>{page}</html>").split("\n") == parts


def test_nested_tags_take_linear_time():
    for unit, tail in (("<header>", ""), ("<p><object>" + "<i>" * 40_000, "<div></div>" * 40_000), ("<a ", '"' + ">"), ('<a ="', ">"), ("<form><div class=sidebar>", ""), ("<li><ul>", "</ul>" * 9)):
        began = time.process_time()
        main_text(unit * (1 if len(unit) > 1000 else 40_000) + tail)
        assert time.process_time() - began < 8


def test_only_frames_give_nothing():
    assert main_text("<nav>x</nav><footer>y</footer>") == "" == main_text("<form><input><button>Go</button></form>")


def test_against_a_slow_version():
    """Random nests of plain boxes, lists and quotes around paragraphs and links: the same text from points by their definition."""
    rng = random.Random(8)

    def box(depth):
        if depth == 0 or rng.random() < 0.3:
            return f"<p>{sentence(rng, rng.randrange(1, 25))}</p>" if rng.random() < 0.7 else f"<p><a href=/x>{sentence(rng, 9)}</a></p>"
        tag = rng.choice(["div", "section", "div class=content", "ul"])
        inner = "".join(box(depth - 1) for _ in range(rng.randrange(1, 4)))
        return f"<{tag}>{f'<li>{inner}</li>' if tag == 'ul' else inner}</{tag.split()[0]}>"

    for _ in range(300):
        page = f"<html><body><nav><p>{sentence(rng)}</p></nav><article><p>{sentence(rng)}</p>{box(3)}{box(3)}</article><div class=sidebar>{box(1)}</div></body></html>"
        assert main_text(page) == slow_text(page), page
