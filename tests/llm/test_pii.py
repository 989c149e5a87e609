import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from rowmesh.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain(text):
    """The contract's patterns, read literally."""
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = [int(c) for c in m[0] if c in "0123456789"]
        odd = sum(digits[-1::-2]) + sum(sum(divmod(2 * d, 10)) for d in digits[-2::-2])
        if 12 <= len(digits) <= 19 and odd % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(re.findall("[0-9]", m[0])) <= 15]
    return sorted(out)


def test_base_against_the_patterns():
    rng = random.Random(7)
    parts = ["a", "b.c", "@", "x@y.z", ".", "1", "25", "256", "1.2.3.4", "+", "+1 (23", ") 4-5", " ", "-", "4111111111111111", "0" * 13, "é", "%", "\n", "a@b", "@@", "..", "+49 30 1234567"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(14)))
        assert pii.detect(text) == plain(text), text


def test_long_runs_take_linear_time():
    for text in ("9" * 200_000, "a" * 200_000, "1." * 100_000, "a@" * 100_000, "+1" * 100_000, "(" * 200_000, "one " * 50_000, "a dot " * 40_000, "a " * 100_000, "1o" * 100_000, "x at y dot " * 20_000, "@ " * 100_000):
        pii.find(text)


@pytest.mark.parametrize(
    "text, kind, source",
    [
        ("mail bob [at] mail.example [dot] com now", "email", "bob [at] mail.example [dot] com"),
        ("mail bob at example dot co dot uk now", "email", "bob at example dot co dot uk"),
        ("bob(at)example.com", "email", "bob(at)example.com"),
        ("write to bob dot smith at mail dot example dot org today", "email", "bob dot smith at mail dot example dot org"),
        ("so bob @ example . com it is", "email", "bob @ example . com"),
        ("bob@example dot com", "email", "bob@example dot com"),
        ("host 10 dot 0 dot 0 dot 17 is up", "ip", "10 dot 0 dot 0 dot 17"),
        ("host 10[.]0[.]0[.]17", "ip", "10[.]0[.]0[.]17"),
        ("card 4lll 1111 1I11 1111 ok", "card", "4lll 1111 1I11 1111"),
        ("call +1 2O2 555 Ol47 now", "phone", "+1 2O2 555 Ol47"),
        ("schreib an bob＠exаmple．com, ja", "email", "bob＠exаmple．com"),
        ("b​ob@ex​ample.com", "email", "b​ob@ex​ample.com"),
        ("ip １２７.0.0.1 here", "ip", "１２７.0.0.1"),
        ("at ten dot zero: one nine two dot one six eight dot one dot one end", "ip", "one nine two dot one six eight dot one dot one"),
        ("card four one one one, " + "one one one one " * 3 + "ok", "card", None),
        ("call plus one two zero two five five five oh one four seven please", "phone", "plus one two zero two five five five oh one four seven"),
    ],
)
def test_disguises(text, kind, source):
    base, spans = pii.find(text)
    new = [(text[s:e], pii.KINDS[k]) for s, k, e in spans if (s, k, e) not in base]
    assert any(k == kind and (source is None or t == source) for t, k in new), (spans, new)


def test_base_stays_and_clean_text_gets_nothing():
    text = "x é bob@example.com 10.0.0.1 [dot] one two"
    base, spans = pii.find(text)
    assert base == plain(text) and set(base) <= set(spans)
    for clean in ("meet me at the dot of six one day", "un deux trois nous irons", "(at) home [dot]", "five or six at one", "Éau ünd ñ", "a (b) c <d>", "look at example.com. It is", "mail 34@mail.example.com. It rains", "Sold 10 lo 5 oil 3", "in 1990 lo and behold", "a @ b"):
        assert pii.find(clean)[1] == pii.find(clean)[0] == plain(clean)


def test_layers_map_back():
    rng = random.Random(9)
    for _ in range(500):
        source = "".join(rng.choice("abcdef") for _ in range(30))
        cuts = sorted(rng.sample(range(31), 6))
        layer = pii.Layer(source, [(cuts[0], cuts[1], rng.choice(["", "X", "XYZ"])), (cuts[2], cuts[3], ""), (cuts[4], cuts[5], "QQ")])
        s = rng.randrange(len(layer.text))
        e = rng.randrange(s + 1, len(layer.text) + 1)
        a, b, edited = layer.back(s, e)
        assert 0 <= a <= b <= 30
        if not edited:
            assert source[a:b] == layer.text[s:e]


def test_query_rows(spark):
    rows = [(1, "bob@example.com and 4111 1111 1111 1111"), (1, "bob@example.com and 4111 1111 1111 1111"), (2, None), (None, ""), (3, "z" * 50_000 + " +1 (017) 555-7713")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("spans", F.lit(5))
    got = pii.personal_data(df).collect()
    assert sorted((r.doc_id or 0, r.n_email, r.n_ip, r.n_card, r.n_phone) for r in got) == [(0, 0, 0, 0, 0), (1, 1, 0, 1, 0), (1, 1, 0, 1, 0), (2, 0, 0, 0, 0), (3, 0, 0, 0, 1)]
    one = next(r for r in got if r.doc_id == 1)
    assert one.spans == "email:0:15,card:20:39" and one.base_sha256 == hashlib.sha256(one.spans.encode()).hexdigest()
    assert pii.personal_data(df.limit(0)).count() == 0


def test_redaction(spark):
    rows = [(1, "a bob [at] example [dot] com b", 29), (2, None, None), (3, "", 0), (4, "nothing", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in pii.redacted(df).collect()}
    assert got == {1: ("a [EMAIL] b", 11), 2: (None, None), 3: ("", 0), 4: ("nothing", 7)}


@pytest.mark.parametrize(
    "text, kind, source",
    [
        ("dns eight dot eight dot eight dot eight here", "ip", "eight dot eight dot eight dot eight"),
        ("call +1 five 55 zero 123 four 567 now", "phone", "+1 five 55 zero 123 four 567"),
        ("call +1 (2O2) 555-Ol47 now", "phone", "+1 (2O2) 555-Ol47"),
        ("host l92.168.O.1 is up", "ip", "l92.168.O.1"),
        ("host 1O.O.O.1, up", "ip", "1O.O.O.1"),
        ("so I 4lll 1111 1I11 1111 I paid", "card", "4lll 1111 1I11 1111"),
        ("mail bob at mail dot shop now", "email", "bob at mail dot shop"),
        ("mail bob arroba correo punto tienda", "email", "bob arroba correo punto tienda"),
    ],
)
def test_disguises_without_narrow_gates(text, kind, source):
    base, spans = pii.find(text)
    assert [(text[s:e], pii.KINDS[k]) for s, k, e in spans if (s, k, e) not in base] == [(source, kind)]


def test_prose_gets_nothing():
    for clean in ("we arrive at some point during the day", "look at this point there", "meet me at the dot of noon", "I saw 10 or 2 of them", "a @ b . then", "1 of 5 or 6 (I think) - 7"):
        assert pii.find(clean)[1] == []


def test_new_patterns_take_linear_time():
    for text in ("one 1 " * 50_000, "one " + "1 " * 100_000, "o. (" * 60_000, "1 " + "(" * 200_000, "l.1 " * 60_000, "o " * 100_000 + "1"):
        pii.find(text)


# Ways of hiding an address that are in common use, whatever the patterns are.
HIDDEN = [
    "john(a)gmail.com", "john[a]gmail.com", "john AT gmail.com", "jane.doe at company.io", "john[ät]web[punkt]de", "john (ät) web.de", "john&#64;gmail&#46;com", "john&commat;gmail&period;com", "john&#x40;gmail.com",
    "john%40gmail.com", "john%40gmail%2Ecom", "j o h n @ g m a i l . c o m", "john{at}gmail{dot}com", "john<at>gmail<dot>com", "john -at- gmail -dot- com", "john_at_gmail_dot_com", "john*at*gmail*dot*com",
    "john|at|gmail|dot|com", "john /at/ gmail /dot/ com", "johnATgmailDOTcom", "john [at sign] gmail [period] com", "john [[at]] gmail [[dot]] com", "john ( at ) gmail ( dot ) com", "john[@]gmail[.]com", "john @ gmail dot com", "john@gmail (dot) com", "j.smith AT mail.example.org", "john (AT) gmail (DOT) com",
]


@pytest.mark.parametrize("hidden", HIDDEN)
def test_common_ways_to_hide_an_address(hidden):
    for before, after in (("", ""), ("Write to ", " today."), ("x: ", ", please"), ("mail\n", "\nthanks")):
        base, spans = pii.find(before + hidden + after)
        assert [(s, k, e) for s, k, e in spans if (s, k, e) not in base] == [(len(before), 0, len(before) + len(hidden))], before


@pytest.mark.parametrize(
    "text, kind",
    [
        ("plus one two one two double five five zero one nine nine", "phone"), ("+1 212 double five 5 01 ninety-two", "phone"), ("plus forty-nine thirty twelve thirty-four fifty-six", "phone"),
        ("ninety-two dot sixteen dot ten dot one", "ip"), ("four triple one double one double one one one double one double one double one", "card"),
    ],
)
def test_words_for_several_digits(text, kind):
    base, spans = pii.find(f"say {text}, ok")
    assert [(s, pii.KINDS[k], e) for s, k, e in spans if (s, k, e) not in base] == [(4, kind, 4 + len(text))]


@pytest.mark.parametrize(
    "text",
    [
        "he was seven at three dot com", "book at www dot example dot com", "see us @ example . com", "see index.html at example.com", "MEET AT GMAIL.COM", "look at example.com", "rule 3 (a) and (b) apply. So", "he said &amp; left", "a %40 b", "a b c @ d e f",
        "double trouble at ninety-two dot", "twenty one people met twenty-two others", "either/at/or and/or", "clause (a) of it. com", "I a m @ h o m e", "AT the DOT", "5 * at * 6",
    ],
)
def test_what_is_no_address(text):
    assert pii.find(text)[1] == pii.find(text)[0] == plain(text)


def test_later_patterns_take_linear_time():
    for text in ("a " * 100_000 + "@ " + "b " * 100_000, "a @ " * 60_000, "&#64;" * 60_000, "%40" * 90_000, "aAT" * 70_000, "xATyDOT" * 40_000, "*at*" * 60_000, "a (a)" * 60_000, "double " * 50_000, "twenty-" * 50_000, "ab.cd at ab.cd " * 20_000, "[[[" * 90_000, "x AT y.com " * 20_000):
        pii.find(text)
