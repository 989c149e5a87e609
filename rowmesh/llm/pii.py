"""Personal data in plain and in disguised form, with spans that count code points of the source text.

Three transducers rewrite a text in turn: characters (homoglyphs, full-width and
other digits, invisible characters), spelled digits, at/dot disguises. Each keeps
the list of its edits, so that a span found in the rewritten text can be mapped
back through all of them. What the plain patterns find in the source itself
always stays; the rewritten text only adds spans that contain an edit.
"""

from __future__ import annotations

import hashlib
import html
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small

KINDS = ("email", "ip", "card", "phone")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match can only begin where a run of digits does, so later places in the run need no try.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

# Letters of other scripts that look like the Latin letter beside them.
LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "І": "I", "Ѕ": "S", "Ј": "J",
    "α": "a", "ο": "o", "ρ": "p", "ν": "v", "ι": "i", "κ": "k", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M",
    "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "ı": "i", "ɡ": "g", "ⅼ": "l",
    "。": ".", "｡": ".", "․": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "−": "-", " ": " ", " ": " ", " ": " ",
    "​": "", "‌": "", "‍": "", "⁠": "", "﻿": "", "­": "",
}
# Digits as words in the languages of the corpus.
DIGIT_WORDS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
# Numbers of two digits as words, words for repeated digits, and names of the signs.
TEENS = {w: str(10 + k) for k, w in enumerate("ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split())}
TENS = {w: str(2 + k) for k, w in enumerate("twenty thirty forty fifty sixty seventy eighty ninety".split())}
TIMES = {"double": 2, "triple": 3}
_DOTS = "dot|punkt|punto|point"
_ATS = "at|arroba|chez|klammeraffe"

_DIGIT = "(?:" + "|".join(sorted(DIGIT_WORDS, key=len, reverse=True)) + ")"
_LONG = rf"(?:(?:{'|'.join(TIMES)})[ -]{_DIGIT}|(?:{'|'.join(TENS)})(?:[ -](?:one|two|three|four|five|six|seven|eight|nine)(?![^\W_]))?|{'|'.join(TEENS)})"
_WORD = rf"(?:{_LONG}|{_DIGIT})(?![^\W_])"
_ITEM = rf"(?:{_WORD}|[0-9]++|(?:{_DOTS})(?![^\W_]))"
_GAP = "[ ,.()-]++"
_SPELLED = re.compile(rf"(?<![^\W_])(?:plus ++)?{_WORD}(?:{_GAP}{_ITEM})++|(?<![^\W_])(?:\+|plus ++)?[0-9]++(?:{_GAP}{_ITEM})++", re.IGNORECASE)
_SPELLED_ITEM = re.compile(rf"{_WORD}|[0-9]+|(?:{_DOTS})(?![^\W_])|plus|\+|[.]", re.IGNORECASE)
#: Cheap test before _SPELLED: a word for two digits, or two spelled digits with at most numbers and dots between them.
_TWO_WORDS = re.compile(rf"(?<![^\W_]){_LONG}(?![^\W_])|(?<![^\W_]){_WORD}(?:{_GAP}(?:[0-9]++|(?:{_DOTS})(?![^\W_])))*+{_GAP}{_WORD}", re.IGNORECASE)
# A run of blanks is only tried from its begin. Signs in brackets, and signs joined to the words around them.
_IN_BRACKETS = tuple(
    re.compile(pattern, re.IGNORECASE)
    for pattern in (
        rf"(?<! ) *+(?<![\[({{<])[\[({{<]++ *+(?:{_ATS}|@|ät|at[ -]sign) *+[\])}}>]++ *+|(?<=[A-Za-z0-9])[(\[][aä][)\]](?=[A-Za-z0-9-]++(?:\.|[ (\[]))",
        rf"(?<! ) *+(?<![\[({{<])[\[({{<]++ *+(?:{_DOTS}|\.|period) *+[\])}}>]++ *+",
    )
)
_JOINED = tuple(re.compile(rf"(?<=[A-Za-z0-9]) ?[_*|/~-]++(?:{word})[_*|/~-]++ ?(?=[A-Za-z0-9])", re.IGNORECASE) for word in ("at", "dot"))
_JOINED_HINT = re.compile(r"[_*|/~-](?:at|dot)[_*|/~-]")
#: Signs in capitals within a word of small letters.
_CAPITALS = re.compile(r"(?<![A-Za-z0-9._-])[a-z0-9._-]++(?P<at>AT)[a-z0-9-]++(?P<rest>(?:DOT[a-z0-9-]++)++)(?![A-Za-z0-9])")
#: Characters written as references of HTML or as bytes of a url.
_REFERENCE = re.compile(r"&(?:#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|commat|period|lowbar|hyphen|plus);|%(?:40|2[BbDdEe]|5[Ff])")
#: Bare words count only as a whole address: an at, after it a domain with bare or plain dots and a known end, before it a local part, of which one at least is disguised.
_BARE_AT = re.compile(rf"(?<! ) ++(?:{_ATS}|@) ++|@", re.IGNORECASE)
_BARE_DOMAIN = re.compile(rf"(?P<host>[A-Za-z0-9-]++)(?P<rest>(?:(?: ++(?:{_DOTS}|\.) ++|\.)[A-Za-z0-9-]++)++)", re.IGNORECASE)
#: Numbers with bare dots between them, as many as an address has.
_BARE_IP = re.compile(rf"(?<![A-Za-z0-9])[0-9]{{1,3}}(?: ++(?:{_DOTS}) ++[0-9]{{1,3}}){{3}}(?![A-Za-z0-9])", re.IGNORECASE)
#: Letters that pass for digits, and a run in which they may stand for them.
_LETTER_DIGITS = {"O": "0", "o": "0", "l": "1", "I": "1"}
_MIXED_HINT = re.compile(r"[0-9][ ().-]*+[OolI]|[OolI][ ().-]*+[0-9]")
_MIXED = re.compile(r"(?<![^\W_])[0-9OolI]++(?![^\W_])(?:[ ().-]++[0-9OolI]++(?![^\W_]))*+")
#: A letter by itself at the begin of a run of longer groups is a word, as one at its end is (see _without_last()).
_LONE_FIRST, _LONG_GROUP = re.compile(r"[OolI] ++(?=[0-9OolI]{2})"), re.compile(r"[0-9OolI]{2}")
# Words of prose that neither begin nor end a domain of bare words.
_PROSE = frozenset("a an the this that these those which what one each every any some my your his her its our their of and or to on by for from with as if when where while but than then so we he she they you who is was are were be will would has had have".split())
# Ends of an address that are known by themselves; others count where both at and dot are disguised.
_ENDS = frozenset("com org net edu gov mil int info biz name io co dev app ai eu uk de fr es pt it nl be at ch us ca mx br ar ru pl se no dk fi ie au nz jp cn in kr example test".split())
# Words that stand before a place ("sat at", "here at") and are no local part of a bare address.
_BEFORE_PLACE = frozenset(
    "sat sit sits sitting stay stays stayed staying look looks looked looking stare stared meet meets met meeting arrive arrives arrived arriving live lives lived living work works worked working "
    "stand stands stood standing stop stops stopped start starts started begin began begins end ends ended be is are was were am been being here there home available hosted visit visited shop "
    "found find posted read seen saw see us me him her them it you not now then only just also all one held based again still aim aimed laugh laughed smile smiled point pointed knock knocked".split()
)
#: File names end so, and stand before a place: "index.html at example.com".
_FILES = frozenset("html htm txt pdf py js php exe zip doc docx jpg jpeg png gif csv json xml com org net".split())
#: A local part that can't be an ordinary word.
_DOTTED_NAME = re.compile(r"[A-Za-z]{2,}(?:[._][A-Za-z0-9]{2,})+")
_NO_NAMES = _BEFORE_PLACE | _PROSE | frozenset(f"{_ATS}|{_DOTS}".split("|"))
_BARE_DOT = re.compile(rf" ++(?:{_DOTS}|\.) ++", re.IGNORECASE)
_DOT_WORDS = frozenset(_DOTS.split("|"))
_SIGNS = frozenset(f"{_ATS}|{_DOTS}".split("|"))
#: One of these is in every text with bare words that make an address.
_BARE_HINTS = (" @ ", *(f" {w} " for w in _SIGNS))
_NUMBER_WORDS = frozenset({*DIGIT_WORDS, *TEENS, *TENS, *TIMES})
_LETTERS = re.compile(r"[^\W\d_]+")

_PLAIN = re.compile(r"[A-Za-z0-9]")

Span = tuple[int, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for place, c in enumerate(reversed(digits)):
        d = int(c) << (place & 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    # Leftmost match for each "@": the whole run of local characters before it, back to the last match.
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def detect(text: str) -> list[Span]:
    """(start, kind, end) of the plain patterns, in order; kind counts through KINDS. Each kind is sought on its own."""
    found: list[Span] = [(s, 0, e) for s, e in _emails(text)]
    found += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end()))
    if "+" in text:
        found += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(found)


class Layer:
    """A text after edits (start, end, replacement), and the way back to where it came from."""

    def __init__(self, source: str, edits: list[tuple[int, int, str]]):
        parts, self.new, self.old = [], [], []
        at = now = 0
        for s, e, put in edits:
            for piece, old in ((source[at:s], (at, None)), (put, (s, e))):
                if piece:
                    self.new.append(now)
                    self.old.append(old)
                    parts.append(piece)
                    now += len(piece)
            at = e
        self.new.append(now)
        self.old.append((at, None))
        self.text = "".join([*parts, source[at:]])

    def back(self, start: int, end: int) -> tuple[int, int, bool]:
        """The span in the source, and whether it holds an edit."""
        i, j = bisect_right(self.new, start) - 1, bisect_right(self.new, end - 1) - 1
        s = self.old[i][0] + (0 if self.old[i][1] is not None else start - self.new[i])
        e = self.old[j][1] if self.old[j][1] is not None else self.old[j][0] + end - self.new[j]
        return s, e, i != j or self.old[i][1] is not None


@lru_cache(maxsize=4096)
def _plain(c: str) -> str | None:
    """What a character stands for in ASCII, or None if for itself."""
    if c in LOOKALIKES:
        return LOOKALIKES[c]
    if c.isdecimal():
        return str(unicodedata.decimal(c))
    folded = unicodedata.normalize("NFKC", c)
    return folded if folded != c and folded.isascii() and folded.isprintable() else None


def _characters(text: str) -> list[tuple[int, int, str]]:
    edits = []
    if _MIXED_HINT.search(text):
        for m in _MIXED.finditer(text):
            run = m[0]
            # Detection judges what comes out, so a run of any length may be read as a number.
            if any("0" <= c <= "9" for c in run) and any(c in _LETTER_DIGITS for c in run):
                lo = first.end() if (first := _LONE_FIRST.match(run)) else 0
                hi = _without_last(run)
                edits += [(m.start() + k, m.start() + k + 1, _LETTER_DIGITS[c]) for k, c in enumerate(run[:hi]) if k >= lo and c in _LETTER_DIGITS]
    return _apart(edits + _foreign(text) + _references(text))


def _apart(edits: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """The edits in order, without those that begin within an earlier one."""
    out: list[tuple[int, int, str]] = []
    for edit in sorted(edits):
        if not out or edit[0] >= out[-1][1]:
            out.append(edit)
    return out


def _references(text: str) -> list[tuple[int, int, str]]:
    """References and url bytes that stand for one printable ASCII character."""
    if "&" not in text and "%" not in text:
        return []
    found = []
    for m in _REFERENCE.finditer(text):
        put = chr(int(m[0][1:], 16)) if m[0][0] == "%" else html.unescape(m[0])
        if len(put) == 1 and " " < put <= "~":
            found.append((m.start(), m.end(), put))
    return found


def _without_last(run: str) -> int:
    """Where a run ends, without a letter that stands by itself after a longer group."""
    rest = run[:-1].rstrip(" ")
    return len(rest) if run[-1] in _LETTER_DIGITS and len(rest) < len(run) - 1 and _LONG_GROUP.match(rest, max(0, len(rest) - 2)) else len(run)


def _foreign(text: str) -> list[tuple[int, int, str]]:
    if text.isascii():
        return []
    known = {c: p for c in set(text) if c > "\x7f" and (p := _plain(c)) is not None}
    if not known:
        return []
    return [(m.start(), m.end(), known[m[0]]) for m in re.finditer("[" + "".join(map(re.escape, known)) + "]", text)]


def _digits(item: str) -> str:
    """What an item of a spelled number stands for."""
    words = re.split("[ -]", item.lower())
    if words[0] in TIMES:
        return DIGIT_WORDS[words[1]] * TIMES[words[0]]
    if words[0] in TENS:
        return TENS[words[0]] + (DIGIT_WORDS[words[1]] if len(words) > 1 else "0")
    if words[0] in ("plus", "+"):
        return "+"
    return TEENS.get(words[0]) or DIGIT_WORDS.get(words[0]) or (item if item[0].isdigit() else ".")


def _numbers(text: str) -> list[tuple[int, int, str]]:
    if _NUMBER_WORDS.isdisjoint(_LETTERS.findall(text.lower())) or not _TWO_WORDS.search(text):
        return []
    edits = []
    for m in _SPELLED.finditer(text):
        items = [i[0] for i in _SPELLED_ITEM.finditer(m[0])]
        plain = [_digits(i) for i in items]
        if sum(len(p) for i, p in zip(items, plain) if i[0].isalpha() and p.isdigit()) >= 2:
            edits.append((m.start(), m.end(), "".join(plain).rstrip(".")))
    return edits


def _ends_address(at: str, host: str, rest: str, dotted: bool) -> bool:
    """Whether the end of a bare address is one: a known one, or any letters where at and dot are both disguised and it doesn't read as prose."""
    last = re.split(r"[ .]", rest)[-1].lower()
    if host.lower() in DIGIT_WORDS or at and host.lower() == "www":
        return False
    if last in _ENDS:
        return True
    if not (last.isalpha() and len(last) >= 2 and dotted and at) or last in _PROSE or last in DIGIT_WORDS or last in _SIGNS:
        return False
    # "at some point" is ordinary prose.
    return host.lower() not in _PROSE and not (at == "at" and re.search(r" point ", rest, re.IGNORECASE)) and (at != "@" or " . " not in rest)


def _local_part(text: str, floor: int, end: int) -> tuple[int, list[tuple[int, int]]]:
    """Where the local part that ends at a place begins, not before `floor`, and its spelled dots; its begin is the end if there is none."""
    dots: list[tuple[int, int]] = []
    begin = end
    while begin > floor and text[begin - 1] in _LOCAL:
        begin -= 1
    while begin < end:
        word_end = begin
        while word_end > floor and text[word_end - 1] == " ":
            word_end -= 1
        word = word_end
        while word > floor and text[word - 1].isalpha():
            word -= 1
        before = word
        while before > floor and text[before - 1] == " ":
            before -= 1
        first = before
        while first > floor and text[first - 1] in _LOCAL:
            first -= 1
        if word_end == begin or text[word:word_end].lower() not in _DOT_WORDS or before == word or first == before:
            break
        dots.append((before, begin))
        begin = first
    return begin, dots


def _bare_addresses(text: str) -> Iterator[tuple[int, int, str]]:
    """Edits that turn bare words into addresses. A domain is sought after each at first, so that prose is left at once."""
    floor = 0
    for m in _BARE_AT.finditer(text):
        domain = _BARE_DOMAIN.match(text, m.end()) if m.start() >= floor else None
        if domain is None:
            continue
        at = m[0].strip().lower() if m[0] != "@" else ""
        dots = [(domain.start("rest") + d.start(), domain.start("rest") + d.end()) for d in _BARE_DOT.finditer(domain["rest"])]
        if not _ends_address(at, domain["host"], domain["rest"], bool(dots)):
            continue
        begin, lead = _local_part(text, floor, m.start())
        name = text[begin : m.start()]
        # " at " before a plain domain is ordinary prose, but for a shouted one, or after what can be no word; " @ " isn't.
        shouted = m[0].strip() == "AT" and not name.isupper()
        if not (dots or at == "@" or shouted or lead or _DOTTED_NAME.fullmatch(name) and name.rsplit(".", 1)[-1].lower() not in _FILES):
            continue
        if not name or at and not lead and (name.lower() in _NO_NAMES or name.lower() in DIGIT_WORDS):
            continue
        yield from ((s, e, ".") for s, e in [*lead, *dots])
        if at:
            yield m.start(), m.end(), "@"
        floor = domain.end()


def _addresses(text: str) -> list[tuple[int, int, str]]:
    lower = text.lower()
    edits = _capitals(text) if "AT" in text and "DOT" in text else []
    for patterns, there in ((_IN_BRACKETS, any(c in text for c in "[({<")), (_JOINED, _JOINED_HINT.search(lower))):
        if there:
            edits += [(m.start(), m.end(), put) for pattern, put in zip(patterns, "@.") for m in pattern.finditer(text)]
    if " @ " in text:
        edits += _spaced(text)
    if not edits and not any(h in lower for h in _BARE_HINTS):
        return []
    taken = _apart(edits)
    view = Layer(text, taken)
    # Bare words are read in the text as the brackets have left it.
    more = list(_bare_addresses(view.text))
    more += [(m.start() + d.start(), m.start() + d.end(), ".") for m in _BARE_IP.finditer(view.text) for d in _BARE_DOT.finditer(m[0])]
    return _apart(taken + [(s, e, put) for a, b, put in more for s, e, _ in [view.back(a, b)]])


def _capitals(text: str) -> list[tuple[int, int, str]]:
    found = []
    for m in _CAPITALS.finditer(text):
        found.append((m.start("at"), m.end("at"), "@"))
        found += [(m.start("rest") + d.start(), m.start("rest") + d.end(), ".") for d in re.finditer("DOT", m["rest"])]
    return found


def _spaced(text: str) -> list[tuple[int, int, str]]:
    """Edits that close up an address of single characters with a blank between each two."""
    found, floor, n = [], 0, len(text)
    at = text.find(" @ ")
    while at >= 0:
        begin, end = at, at + 3
        while begin - 1 >= floor and text[begin - 1] in _LOCAL and (begin == 1 or text[begin - 2].isspace()):
            begin = max(begin - 2, 0)
        # `begin` lies at the blank before the first character, or at the text's begin.
        first = begin + (begin > 0 or text[:1].isspace())
        while end < n and (text[end].isalnum() and text[end].isascii() or text[end] in ".-") and (end + 1 == n or not text[end + 1].isalnum()):
            end += 2
            if end - 1 >= n or text[end - 1] != " ":
                break
        letters = text[at + 3 : end - 1].split(" ")
        last = "".join(letters).rsplit(".", 1)
        # A single letter behind a known end is a word.
        if len(last) == 2 and last[1] not in _ENDS and last[1][:-1] in _ENDS and last[1][-1] in "aAI":
            letters.pop()
            end -= 2
        if at - first >= 3 and len(letters) >= 4 and len(last) == 2 and last[0] and len(last[1]) >= 2:
            found += [(k, k + 1, "") for k in range(first, end - 1) if text[k] == " "]
            floor = end
        at = text.find(" @ ", at + 2)
    return found


def added(text: str, base: list[Span]) -> list[Span]:
    """Spans, in the source, that only the rewritten text shows.

    None that lies within a base span of its kind, or goes beyond one only by
    characters that are no ASCII letters or digits: that is the same find.
    """
    layers = []
    for rewrite in (_characters, _numbers, _addresses):
        if edits := sorted(rewrite(layers[-1].text if layers else text)):
            layers.append(Layer(layers[-1].text if layers else text, edits))
    if not layers:
        return []
    found = []
    for s, kind, e in detect(layers[-1].text):
        edited = False
        for layer in reversed(layers):
            s, e, here = layer.back(s, e)
            edited |= here
        if edited and not any(k == kind and (a <= s and e <= b or s <= a and b <= e and not _PLAIN.search(text[s:a] + text[b:e])) for a, k, b in base):
            found.append((s, kind, e))
    return found


def find(text: str | None) -> tuple[list[Span], list[Span]]:
    """Base spans and all spans of a whole text (null as empty), each in order of start and kind."""
    text = text or ""
    base = detect(text)
    return base, sorted({*base, *added(text, base)})


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def redact(text: str | None) -> str | None:
    """The text with each span replaced by its kind in brackets; of spans that overlap, the first names the whole stretch."""
    _, spans = find(text)
    if not spans:
        return text
    stretches: list[list[int]] = []
    for s, kind, e in spans:
        if stretches and s < stretches[-1][2]:
            stretches[-1][2] = max(stretches[-1][2], e)
        else:
            stretches.append([s, kind, e])
    return Layer(text, [(s, e, f"[{KINDS[k].upper()}]") for s, k, e in stretches]).text


SPANS = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"


def personal_data(docs: DataFrame) -> DataFrame:
    """A row for each document: how many base spans of each kind, their SHA-256, all spans, and how many the disguises add.

    Rows are judged one by one, so equal rows give equal results and other columns
    don't matter. A null text counts as empty: no spans, and the hash of nothing. Of
    spans with one start the kinds come in their order. No documents give no rows.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            rows = []
            for text in batch.column(1).to_pylist():
                base, spans = find(text)
                counts = [sum(k == n for _, k, _ in base) for n in range(4)]
                rows.append((*counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), len(spans) - len(base)))
            columns = list(zip(*rows))
            types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types))], [x.split()[0] for x in SPANS.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(each, SPANS)


def redacted(docs: DataFrame) -> DataFrame:
    """docs with personal data in `text` replaced by [EMAIL], [IP], [CARD] or [PHONE], and `n_chars`, where there is one, brought up to date.

    A null text stays null and its n_chars as it is; texts without personal data, also
    empty ones, stay as they are. Rows are judged one by one, so repeated rows give
    equal results. No documents give no rows.
    """
    place = docs.columns.index("text")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            texts = pa.array([redact(t) for t in batch.column(place).to_pylist()], batch.schema.field(place).type)
            yield batch.set_column(place, batch.schema.field(place), texts)

    out = docs.mapInArrow(each, docs.schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.coalesce(F.char_length("text").cast(docs.schema["n_chars"].dataType), "n_chars"))
    return out
