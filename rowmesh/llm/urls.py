"""URL verdicts: host and path rules, and a weighted vocabulary for what no rule decides."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (verdict, rule): the rule fits its host and all subdomains of it, if the url's path starts with the rule's.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
#: One of these is enough; English, German, French and Spanish.
STRICT = (
    "casino", "casinos", "porn", "porno", "xxx", "viagra", "cialis", "pills", "spam", "warez", "phishing", "malware", "hentai", "escorts", "betting",
    "sexshop", "nudes", "camgirls", "camsex", "jackpot", "gluecksspiel", "spielbank", "wetten", "potenzmittel", "casinospiele", "paris-sportifs", "pornographie", "apuestas", "tragaperras", "pornografia", "putas", "keygen", "crackz", "botnet",
)
#: Of these it takes SOFT_HITS different ones.
SOFT = (
    "adult", "x", "ads", "ad", "track", "tracker", "free", "cheap", "win", "bets", "bet", "bonus", "deals", "promo", "farm", "clicks", "popup", "sex", "slots", "poker", "loans", "crypto",
    "gratis", "kostenlos", "billig", "gewinn", "gewinnspiel", "kredit", "rabatt", "erotik", "gratuit", "pas-cher", "gagner", "credit-rapide", "rencontres", "erotique", "barato", "ganar", "premio", "sorteo", "prestamos", "citas", "erotica", "coupon", "lottery", "bitcoin",
)
SOFT_HITS = 2

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty for null or where there is no "://"."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, or nulls. The rules are a short list that travels with the plan."""
    rule = verdict = None
    for says, text in sorted(rules, key=lambda r: -len(r[1])):
        name, _, start = text.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit("/" + start))
        rule = F.when(fits, text) if rule is None else rule.when(fits, text)
        verdict = F.when(fits, says) if verdict is None else verdict.when(fits, says)
    return (rule, verdict) if rules else (F.lit(None).cast("string"),) * 2


@lru_cache(maxsize=4)
def automaton(strict: tuple[str, ...], soft: tuple[str, ...]) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for weight, terms in ((1, soft), (2, strict)):
        for t in terms:
            found.add_word(t, (weight, t))
    found.make_automaton()
    return found


def _word(c: str) -> bool:
    return "a" <= c <= "z" or "0" <= c <= "9"


def hits(text: str, terms: ahocorasick.Automaton) -> tuple[int, int]:
    """How many different strict and soft terms stand in a lower-cased text with no letter or digit right before or after."""
    seen = set()
    for last, (weight, term) in terms.iter(text):
        first = last + 1 - len(term)
        if not (first and _word(text[first - 1])) and not (last + 1 < len(text) and _word(text[last + 1])):
            seen.add((weight, term))
    strict = sum(w == 2 for w, _ in seen)
    return strict, len(seen) - strict


def terms_of(path: str) -> tuple[str, ...]:
    """Terms from a file that the driver reads, one to a line, in lower case; empty lines and those that begin with # don't count."""
    with open(path, encoding="utf-8") as f:
        return tuple(dict.fromkeys(t for line in f if (t := line.strip().lower()) and not t.startswith("#")))


VERDICTS = "page_id long, host string, path string, rule string, verdict string, n_strict int, n_soft int"


def url_verdicts(pages: DataFrame, rules=RULES, strict=STRICT, soft=SOFT, soft_hits: int = SOFT_HITS, whole: bool = False) -> DataFrame:
    """A row for each page: host, path, the rule that decides or null, the verdict, and how many terms of each kind stand in host and path or, with `whole`, in all of the url but its scheme.

    Without a rule, one strict term or soft_hits different soft ones block. A null
    or odd url has an empty host and path, so no rule fits; its terms count only with
    `whole`, none in a null one. Rows are judged one by one, so repeated rows get equal
    verdicts; only page_id and url are read; no pages give no rows.
    """
    host, path = host_and_path(F.col("url"))
    at = F.instr("url", "://")
    seen = F.when(at > 0, F.substring(F.col("url"), at + 3, F.length("url"))).otherwise(F.coalesce("url", F.lit(""))) if whole else F.concat(host, path)
    slim = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"), seen.alias("seen"))
    rule, says = matching_rule(F.col("host"), F.col("path"), rules)
    slim = slim.select("page_id", "host", "path", rule.alias("rule"), says.alias("verdict"), "seen")
    strict, soft = tuple(strict), tuple(soft)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = automaton(strict, soft)
        lower = str.maketrans(_UPPER, _LOWER)
        for batch in batches:
            counts = [hits(text.translate(lower), terms) for text in batch.column(5).to_pylist()]
            verdicts = [v or ("block" if a or b >= soft_hits else "allow") for v, (a, b) in zip(batch.column(4).to_pylist(), counts)]
            columns = [*batch.columns[:4], pa.array(verdicts, pa.string()), *(pa.array([c[k] for c in counts], pa.int32()) for k in (0, 1))]
            yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in VERDICTS.split(", ")])

    return slim.mapInArrow(each, VERDICTS)


def oracle(whole: bool = False) -> str:
    """DuckDB SQL for url_verdicts() of `pages` with the default rules and terms."""
    read = "CASE WHEN instr(url, '://') > 0 THEN rest ELSE coalesce(url, '') END" if whole else "host || path"

    def term(t):
        return f"regexp_matches(seen, '(^|[^a-z0-9]){t}([^a-z0-9]|$)')::INT"

    ranked = sorted(RULES, key=lambda r: -len(r[1]))
    cases = {"rule": "", "says": ""}
    for says, text in ranked:
        name, _, start = text.partition("/")
        for k, value in (("rule", text), ("says", says)):
            cases[k] += f" WHEN (host = '{name}' OR ends_with(host, '.{name}')) AND starts_with(path, '/{start}') THEN '{value}'"
    return f"""
WITH cut AS (SELECT page_id, url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, url, rest, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
scanned AS (SELECT *, translate({read}, '{_UPPER}', '{_LOWER}') AS seen, CASE{cases['rule']} END AS rule, CASE{cases['says']} END AS says FROM parts),
counted AS (SELECT *, ({' + '.join(map(term, STRICT))})::INT AS n_strict, ({' + '.join(map(term, SOFT))})::INT AS n_soft FROM scanned)
SELECT page_id, host, path, rule, coalesce(says, CASE WHEN n_strict > 0 OR n_soft >= {SOFT_HITS} THEN 'block' ELSE 'allow' END) AS verdict, n_strict, n_soft FROM counted
"""
