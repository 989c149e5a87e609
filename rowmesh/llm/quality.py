"""Quality rules: repetition counts, and the fertility of a public tokenizer with rejection bands per language or script."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vocabularies
from .common import small, text_bytes

MIN_WORDS, WINDOW, MAX_REPEATED_PERCENT = 10, 5, 20
_SYMBOLS, _SPACES = b"#*$%&|<>", b" \t\n\v\f\r"
#: Windows are counted as tuples up to this many words, and as packed numbers beyond.
_MANY_WORDS = 50_000


@dataclass(frozen=True)
class Band:
    """What a text of a language may measure under each vocabulary.

    chars_per_token lies low where words are broken up (noise, another script) and
    high where a few long tokens repeat. byte_share is the share of tokens that are
    no text by themselves, for the byte vocabulary, and of byte pieces for the other.
    evenness is the entropy of the tokens over the most that as many tokens, or
    ENTROPY_TOKENS of them, can have. max_top bounds the share of the most frequent
    token (the min-entropy), of which TOP_MORE are free: a list of items between one
    mark lies beyond. Scripts that fall back to bytes share the first of these.
    """

    min_chars: float
    max_chars: float
    max_byte_share: float
    min_evenness: float
    min_piece_chars: float
    max_piece_bytes: float
    max_top: float = 0.12


#: Bands by language, and by script where the language is unknown.
BANDS = {
    "en": Band(2.2, 6.5, 0.08, 0.65, 1.5, 0.12),
    "de": Band(1.9, 6.5, 0.15, 0.64, 1.4, 0.15),
    "fr": Band(2.0, 6.5, 0.15, 0.63, 1.5, 0.15),
    "es": Band(1.9, 6.5, 0.15, 0.64, 1.4, 0.15),
    "latin": Band(1.4, 6.5, 0.20, 0.58, 1.2, 0.25),
    "other": Band(0.3, 6.5, 0.70, 0.45, 0.25, 0.95, 0.4),
}
#: Past as many tokens the most entropy that a text can have is taken not to grow further.
ENTROPY_TOKENS = 1024
TOP_MORE = 3


def repeated_words(words: list[bytes]) -> int:
    """How many words lie in a window of five words that occurs twice or more in the text."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    if len(words) <= _MANY_WORDS:
        windows = list(zip(*(words[k:] for k in range(WINDOW))))
        if len(set(windows)) == n:
            return 0
        counts = Counter(windows)
        twice = np.fromiter((counts[w] > 1 for w in windows), bool, n)
    else:
        numbers: dict[bytes, int] = {}
        ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
        packed = ids[:n]
        for k in range(1, WINDOW):
            packed = np.unique(packed * len(numbers) + ids[k : k + n], return_inverse=True)[1]
        twice = np.bincount(packed)[packed] > 1
    covered = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(covered, at, 1)
    np.add.at(covered, at + WINDOW, -1)
    return int((np.cumsum(covered)[:-1] > 0).sum())


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    data = text_bytes(text)
    words = data.split()
    lines = [line for line in data.split(b"\n") if line.strip(_SPACES)]
    chars = len(text or "") - (len(data) - len(data.translate(None, _SPACES)))
    return len(words), chars, len(data) - len(data.translate(None, _SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words)


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < MIN_WORDS or 100 * n_repeat_words > MAX_REPEATED_PERCENT * n_words


_GAP = re.compile(r"\s")


def pieces(text: str, size: int = 1 << 18) -> Iterator[str]:
    """The text in stretches of about `size` characters, cut before white space."""
    at = 0
    while at < len(text):
        cut = _GAP.search(text, at + size) if len(text) - at > size else None
        end = cut.start() if cut else len(text)
        yield text[at:end]
        at = end


class Fertility(tuple):
    """n_tokens, characters per token, byte-fallback share and token entropy (bits) of a text under a vocabulary; `top` is how often its most frequent token comes, `pieces` the same under the piece vocabulary."""

    top: int = 0
    pieces: Fertility | None = None


def _fertility(text: str, ids: np.ndarray, fallback: np.ndarray) -> Fertility:
    if not len(ids):
        return Fertility((0, 0.0, 0.0, 0.0))
    counts = np.unique(ids, return_counts=True)[1]
    entropy = math.log2(len(ids)) - float((counts * np.log2(counts)).sum()) / len(ids)
    found = Fertility((len(ids), len(text) / len(ids), float(fallback[ids].mean()), max(0.0, entropy)))
    found.top = int(counts.max())
    return found


def fertility(text: str, folder: str = vocabularies.FOLDER, name: str = vocabularies.BYTE_BPE, piece_name: str = vocabularies.PIECE_BPE) -> Fertility:
    """The fertility of a whole text under a byte vocabulary and, in `pieces`, under a piece vocabulary; zeros for an empty one."""
    encoding, fallback = vocabularies.byte_bpe(folder, name)
    model, byte_pieces = vocabularies.piece_bpe(folder, piece_name)
    none, parts = np.zeros(0, np.int64), list(pieces(text))
    found = _fertility(text, np.concatenate([none, *(np.array(encoding.encode_ordinary(p), np.int64) for p in parts)]), fallback)
    found.pieces = _fertility(text, np.concatenate([none, *(np.array(model.encode(p), np.int64) for p in parts)]), byte_pieces)
    return found


def band_of(lang: str | None, text: str) -> Band:
    """The band of the language, or that of the script if the language has none."""
    if (lang or "").lower() in BANDS and lang.lower() not in ("latin", "other"):
        return BANDS[lang.lower()]
    foreign = len(re.findall(r"[^\W\d_\x00-ɏ]", text))
    return BANDS["other" if 2 * foreign > len(re.findall(r"[^\W\d_]", text)) else "latin"]


def in_band(band: Band, measured: Fertility) -> bool:
    """Whether both vocabularies find a text within its band; one of no tokens is in none, of one token in every."""
    if measured[0] < 2:
        return measured[0] > 0
    for (n, chars, byte_share, entropy), least, most_bytes, top in (
        (measured, band.min_chars, band.max_byte_share, measured.top),
        (measured.pieces, band.min_piece_chars, band.max_piece_bytes, measured.pieces.top),
    ):
        evenness = entropy / math.log2(min(max(n, 2), ENTROPY_TOKENS))
        if not (least <= chars <= band.max_chars and byte_share <= most_bytes and evenness >= band.min_evenness and top <= band.max_top * n + TOP_MORE):
            return False
    return True


RULES = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, "
    "n_tokens long, chars_per_token double, byte_share double, token_entropy double, top_token long, "
    "n_pieces long, chars_per_piece double, byte_piece_share double, piece_entropy double, top_piece long"
)


def quality(docs: DataFrame, folder: str = vocabularies.FOLDER, name: str = vocabularies.BYTE_BPE) -> DataFrame:
    """A row for each document: the base counts, whether they fail, the verdict `kept`, and what both vocabularies measure.

    A null or empty text has no words and fails; its measures are zero. `lang` may be
    missing, null or unknown: the script then picks the band. Rows are judged one by
    one, so repeated rows get equal verdicts and other columns don't matter. No
    documents give no rows.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            rows = []
            for text, lang in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                counts, measured = base_counts(text), fertility(text or "", folder, name)
                failed = base_failed(counts[0], counts[4])
                rows.append((*counts, failed, not failed and in_band(band_of(lang, text), measured), *measured, measured.top, *measured.pieces, measured.pieces.top))
            columns = list(zip(*rows))
            types = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.int64(), *[pa.float64()] * 3, pa.int64()] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types))], [x.split()[0] for x in RULES.split(", ")])

    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", lang.alias("lang")).mapInArrow(each, RULES)


def keep_good(docs: DataFrame, folder: str = vocabularies.FOLDER, name: str = vocabularies.BYTE_BPE) -> DataFrame:
    """The rows of docs, all columns, that quality() keeps; equal rows stay or go together, and null and empty texts go."""
    place, lang = docs.columns.index("text"), docs.columns.index("lang") if "lang" in docs.columns else None

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            langs = batch.column(lang).to_pylist() if lang is not None else [None] * batch.num_rows
            good = []
            for text, code in zip(batch.column(place).to_pylist(), langs):
                counts = base_counts(text)
                good.append(not base_failed(counts[0], counts[4]) and in_band(band_of(code, text), fertility(text, folder, name)))
            yield batch.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(each, docs.schema)
