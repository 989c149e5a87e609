"""SentencePiece encoding with seeded merge-dropout, and lossless decoding.

Merges are taken from an agenda, best score first and leftmost of equal ones, as
the vocabulary's own encoder does. When a candidate comes up, a keyed hash of its
place, under the document's key and the stretch's place in the document, decides
whether it is skipped for good. Without dropout the result is that of the library;
with it, other segmentations of the same text come out, which differ by key, variant
and place but are the same on every run and machine.
"""

from __future__ import annotations

import heapq
import os
import re
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, count

import numpy as np
import pyarrow as pa
import sentencepiece
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vocabularies
from .common import small

#: Share of candidate merges that are skipped, and among how many keys a document's id chooses: all that the variant's type holds.
DROPOUT, VARIANTS = 0.1, 1 << 31
#: Documents that are encoded together; many of their stretches are the same.
ROWS = 640
#: Segmentations that a worker remembers at most (about 200 bytes each), and the longest stretch worth remembering.
REMEMBERED, LONGEST_REMEMBERED = 200_000, 48

_BLANK = "▁"
_BLANK_BYTES = _BLANK.encode()
_LAST = np.int32(2**31 - 1)


def _hashes(keys: np.ndarray, buckets: int, shift: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each key, and its slot before the bucket's displacement."""
    x = keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x & np.uint64(buckets - 1), x >> shift


class Vocabulary:
    """Pieces of a SentencePiece BPE model with byte fallback, and the way from ids to bytes."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        normal = [i for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        #: Piece, with its blanks as blanks, to id and to its place in the order of merges (best score first).
        self.ids = {model.id_to_piece(i).replace(_BLANK, " "): i for i in normal}
        scores = sorted({model.get_score(i) for i in normal}, reverse=True)
        place = {s: k for k, s in enumerate(scores)}
        self.order = {model.id_to_piece(i).replace(_BLANK, " "): place[model.get_score(i)] for i in normal}
        self.longest = max(map(len, self.ids))
        self.bytes_ids = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.bytes = [b""] * len(ids)
        for piece, i in self.ids.items():
            self.bytes[i] = piece.encode()
        for b, i in enumerate(self.bytes_ids):
            self.bytes[i] = bytes([b])
        self._tables()
        # No piece goes on across a blank, nor across a line end where none holds one: what lies between is encoded by itself.
        if any(" " in piece.lstrip(" ") for piece in self.ids):
            raise ValueError("the vocabulary has pieces with blanks inside")
        lines = "" if any("\n" in piece for piece in self.ids) else "\n"
        self.stretch = re.compile(rf" +[^ {lines}]*|[^ {lines}]+" + ("|\n" if lines else ""))

    def _tables(self) -> None:
        """Symbols as numbers: pieces, then characters of pieces that are none themselves; what each two make, and in which order."""
        pieces = list(self.ids)
        symbols = {x: k for k, x in enumerate(dict.fromkeys([*pieces, *(c for x in pieces for c in x)]))}
        self.symbol_id = np.full(len(symbols), -1, np.int32)
        self.symbol_id[: len(pieces)] = list(self.ids.values())
        self.of_char = np.full(0x110000, -1, np.int32)
        for x, k in symbols.items():
            if len(x) == 1:
                self.of_char[ord(x)] = k
        made = {}
        for x in pieces:
            for cut in range(1, len(x)):
                a, b = symbols.get(x[:cut]), symbols.get(x[cut:])
                if a is not None and b is not None:
                    made[a << 32 | b] = (symbols[x], self.order[x])
        keys = np.array(sorted(made), np.int64)
        self.shift, at = self._slots(keys)
        # No pair of symbols, be they unknown, has the key -2.
        self.pairs = np.full(1 << 64 - int(self.shift), -2, np.int64)
        self.made, self.made_order = np.full((2, len(self.pairs)), -1, np.int32)
        self.pairs[at] = keys
        self.made[at], self.made_order[at] = np.array([made[k] for k in keys.tolist()], np.int32).reshape(-1, 2).T

    def _slots(self, keys: np.ndarray) -> tuple[np.uint64, np.ndarray]:
        """A table with a slot for each key, found without a search: keys fall into buckets, each with a displacement that leads all its keys to free slots."""
        bits = max(4, (2 * len(keys)).bit_length())
        while True:
            shift = np.uint64(64 - bits)
            self.displaced = np.zeros(1 << bits - 3, np.uint64)
            bucket, slot = _hashes(keys, len(self.displaced), shift)
            order = np.argsort(bucket, kind="stable")
            members = np.split(order, np.cumsum(np.bincount(bucket, minlength=len(self.displaced)))[:-1])
            taken, at, slots = bytearray(1 << bits), np.zeros(len(keys), np.int64), slot.tolist()
            for k in sorted(range(len(members)), key=lambda k: -len(members[k])):
                mine = members[k].tolist()
                if not mine:
                    break
                for d in range(1 << bits):
                    found = [slots[i] ^ d for i in mine]
                    if len(set(found)) == len(found) and not any(map(taken.__getitem__, found)):
                        break
                else:
                    break
                self.displaced[k] = d
                at[mine] = found
                for x in found:
                    taken[x] = 1
            if sum(taken) == len(keys):
                return shift, at
            bits += 1

    def meet(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What symbols a and b make, and its place in the order of merges (_LAST where they make nothing)."""
        key = a.astype(np.int64) << 32 | b
        bucket, slot = _hashes(key, len(self.displaced), self.shift)
        at = slot ^ self.displaced[bucket]
        fits = self.pairs[at] == key
        return np.where(fits, self.made[at], -1), np.where(fits, self.made_order[at], _LAST)

    def fallback(self, text: str) -> list[int]:
        return [self.bytes_ids[b] for b in text.encode()]


@lru_cache(maxsize=2)
def vocabulary(folder: str = vocabularies.FOLDER, name: str = vocabularies.PIECE_BPE) -> Vocabulary:
    return Vocabulary(os.path.join(folder, name))


def _skipped(base: int, start: int, mid: int, end: int, skip: int) -> bool:
    """Whether the hash of a candidate's place, under the stretch's own hash, is among the lowest `skip` of 2**32."""
    x = (base + start * 0x9E3779B1 + mid * 0x85EBCA77 + end * 0xC2B2AE3D) & 0xFFFFFFFF
    x = (x ^ x >> 15) * 0x2C1B3C6D & 0xFFFFFFFF
    x = (x ^ x >> 12) * 0x297A2D39 & 0xFFFFFFFF
    return x ^ x >> 15 < skip


def _lowest(x: np.ndarray, skip: int) -> np.ndarray:
    """The test of _skipped() for many sums of base and place."""
    x = (x ^ x >> 15) * np.uint32(0x2C1B3C6D)
    x = (x ^ x >> 12) * np.uint32(0x297A2D39)
    return (x ^ x >> 15) < skip


def _bases(own: np.ndarray, keys: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Hash bases of stretches from their own hashes, their documents' keys and their places there."""
    x = (own ^ keys << np.uint64(32)) + at.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return (x ^ x >> np.uint64(31)) & np.uint64(0xFFFFFFFF)


def _merged(v: Vocabulary, s: str, base: int, skip: int) -> list[int]:
    """Ids of one stretch of any length; `base` is its own hash."""
    out: list[int] = []
    start = 0
    for end in _by_heap(v, s, base, skip):
        piece = s[start:end]
        if (found := v.ids.get(piece)) is not None:
            out.append(found)
        else:
            out += v.fallback(piece)
        start = end
    return out


def _by_heap(v: Vocabulary, s: str, base: int, skip: int) -> list[int]:
    """Where the pieces of a stretch end."""
    n = len(s)
    order, longest = v.order, v.longest
    end = list(range(1, n + 1))
    before = list(range(-1, n))
    agenda = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := order.get(s[i : i + 2])) is not None]
    heapq.heapify(agenda)
    while agenda:
        _, i, mid, e = heapq.heappop(agenda)
        if end[i] != mid or end[mid] != e or skip and _skipped(base, i, mid, e, skip):
            continue
        end[i], end[mid] = e, 0
        if e < n:
            before[e] = i
            far = end[e]
            if far - i <= longest and (r := order.get(s[i:far])) is not None:
                heapq.heappush(agenda, (r, i, e, far))
        left = before[i]
        if left >= 0 and e - left <= longest and (r := order.get(s[left:e])) is not None:
            heapq.heappush(agenda, (r, left, i, e))
    return [e for e in end if e]


def merged_together(v: Vocabulary, stretches: list[str], bases: np.ndarray, skip: int) -> list[bytes | None]:
    """Ids of many short stretches (2 bytes each, native order), merged in step; None where one has a character that no piece holds."""
    ids, counts, known = merged_in_step(v, stretches, bases, skip)
    data, ends = ids.tobytes(), np.cumsum(counts * 2).tolist()
    return [data[e - 2 * n : e] if ok else None for e, n, ok in zip(ends, counts.tolist(), known.tolist())]


def merged_in_step(
    v: Vocabulary, stretches: list[str], bases: np.ndarray, skip: int, trace: list[tuple[np.ndarray, np.ndarray]] | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of many short stretches (uint16), one after the other, how many each has, and whether they hold: not where one has a character that no piece holds.

    Into `trace` goes, step by step, which stretches had a candidate and what its place adds to the base.

    Each stretch is a row of symbols linked by the places of their neighbours. In
    each step every row takes its best candidate, the leftmost of equal ones, and
    merges or skips it.
    """
    sizes = np.fromiter(map(len, stretches), np.int64, len(stretches))
    rows, width = len(stretches), int(sizes.max()) + 1
    place = np.arange(width)
    inside = place < sizes[:, None]
    symbol = np.full((rows, width), -1, np.int32)
    symbol[inside] = v.of_char[np.frombuffer("".join(stretches).encode("utf-32-le"), np.uint32)]
    known = (symbol >= 0).sum(axis=1) == sizes
    after = np.where(inside, place + 1, width - 1).astype(np.int64)
    before = np.broadcast_to(place - 1, (rows, width)).copy()
    worth, makes = np.full((rows, width), _LAST, np.int32), np.full((rows, width), -1, np.int32)
    if width > 1:
        makes[:, :-1], worth[:, :-1] = v.meet(symbol[:, :-1], symbol[:, 1:])
    alive = inside.copy()
    S, A, B, G, W, M = symbol.ravel(), after.ravel(), before.ravel(), alive.ravel(), worth.ravel(), makes.ravel()
    live = np.flatnonzero(known)
    while len(live):
        k = worth[live].argmin(axis=1)
        row = live * width
        at = row + k
        open_ = W[at] < _LAST
        if not open_.all():
            live, k, row, at = live[open_], k[open_], row[open_], at[open_]
        mid = A[at]
        end = A[row + mid]
        if skip or trace is not None:
            spot = k.astype(np.uint64) * 0x9E3779B1 + mid.astype(np.uint64) * 0x85EBCA77 + end.astype(np.uint64) * 0xC2B2AE3D
        if trace is not None:
            trace.append((live, spot.astype(np.uint32)))
        if skip:
            over = _lowest((bases[live] + spot).astype(np.uint32), skip)
            W[at[over]] = _LAST
            go = ~over
            row, at, mid, end = row[go], at[go], mid[go], end[go]
            k = k[go]
        gone = row + mid
        now = S[at] = M[at]
        G[gone], W[gone] = False, _LAST
        A[at] = end
        # The place past a row's end holds no symbol, so nothing is made with it.
        B[row + end] = k
        M[at], W[at] = v.meet(now, S[row + end])
        left = B[at]
        has = left >= 0
        back = (row + left)[has]
        M[back], W[back] = v.meet(S[back], now[has])
    which = v.symbol_id[symbol[alive]]
    counts = alive.sum(axis=1)
    # A character of pieces that is no piece itself needs the byte pieces.
    known &= np.bincount(np.repeat(np.arange(rows), counts), which < 0, rows) == 0
    return which.astype(np.uint16), counts, known


def _spread(firsts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of runs, one after the other: each from its first on, as many as its size."""
    ends = np.cumsum(sizes)
    return np.repeat(firsts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


#: Stretches up to this length are merged together, so many at a time.
_SHORT, _TOGETHER = (8, 16, 40), 16_384
#: What a worker remembers of a stretch, in numbers of 2 bytes: its own hash (2), how many ids it has where nothing is
#: skipped (_NO_IDS where it must be merged by itself), how many candidates lie on the way there, the ids, and what each
#: candidate's place adds to the base (2 each).
_HEAD, _NO_IDS = 4, 0xFFFF


class Encoder:
    """Encodes whole texts under one key.

    A worker remembers, up to a bound, what stretches give where nothing is
    skipped, and the candidates on the way there. Where a document's hashes skip
    none of these, that is the result; else the stretch is merged anew.
    """

    def __init__(self, v: Vocabulary, dropout: float = DROPOUT, key: int = 0):
        if not 0 <= dropout <= 1:
            raise ValueError("dropout lies between 0 and 1")
        if max(v.ids.values()) >= 1 << 16:
            raise ValueError("ids go into two bytes")
        self.v, self.key, self.skip = v, key, round(dropout * 2**32)
        # Two generations: what is met again moves to the younger; the older goes when the younger is full.
        # An entry is one string of bytes, which the garbage collector passes by.
        self.young: dict[int, dict[str, bytes]] = {0: {}}
        self.old: dict[int, dict[str, bytes]] = {0: {}}

    def _stretch(self, s: str, base: int) -> bytes:
        # A blank sign of the source is no blank: it goes through the byte pieces, so that decoding gives it back.
        out = array("H")
        for k, part in enumerate(s.split(_BLANK)):
            if k:
                out.extend(self.v.bytes_ids[b] for b in _BLANK_BYTES)
            if part:
                out.extend(_merged(self.v, part, base + k * 0x9E3779B1 & 0xFFFFFFFF, self.skip))
        return out.tobytes()

    def _new(self, stretches: list[str]) -> list[bytes]:
        """An entry for each stretch, see _HEAD; one without ids where it must be merged by itself."""
        own = np.fromiter(map(xxhash.xxh32_intdigest, stretches), np.uint32, len(stretches))
        head = np.empty((len(stretches), _HEAD), np.uint16)
        head[:, :2], head[:, 2], head[:, 3] = own.view(np.uint16).reshape(-1, 2), _NO_IDS, 0
        found = [head[k].tobytes() for k in range(len(stretches))]
        sizes = np.fromiter(map(len, stretches), np.int64, len(stretches))
        least = 0
        for most in _SHORT:
            some = np.flatnonzero((sizes > least) & (sizes <= most))
            least = most
            for at in range(0, len(some), _TOGETHER):
                part, trace = some[at : at + _TOGETHER], []
                ids, n_ids, known = merged_in_step(self.v, [stretches[i] for i in part.tolist()], np.zeros(len(part), np.uint64), 0, trace)
                rows = np.concatenate([r for r, _ in trace] or [np.zeros(0, np.int64)])
                spots = np.concatenate([x for _, x in trace] or [np.zeros(0, np.uint32)])[np.argsort(rows.astype(np.uint16), kind="stable")]
                n_spots = np.bincount(rows, minlength=len(part))
                lengths = _HEAD + n_ids + 2 * n_spots
                ends = np.cumsum(lengths)
                begins, data = ends - lengths, np.empty(lengths.sum(), np.uint16)
                data[begins], data[begins + 1], data[begins + 2], data[begins + 3] = head[part, 0], head[part, 1], n_ids, n_spots
                data[_spread(begins + _HEAD, n_ids)] = ids
                data[_spread(begins + _HEAD + n_ids, 2 * n_spots)] = spots.view(np.uint16)
                data = data.tobytes()
                for i, a, b, ok in zip(part.tolist(), (2 * begins).tolist(), (2 * ends).tolist(), known.tolist()):
                    if ok:
                        found[i] = data[a:b]
        return found

    def encode_all(self, texts: list[str | None], variants: list[int]) -> list[np.ndarray]:
        """Ids (uint16) of each whole text; none for an empty or null one. A blank is put before a text, as the model has it."""
        out = [bytearray() for _ in texts]
        parts = [(k, part) for k, text in enumerate(texts) if text for part in _parts(" " + text)]
        # Where each part begins in its text.
        sizes = np.array([len(part) for _, part in parts], np.int64)
        upto = np.cumsum(sizes) - sizes
        of = np.array([k for k, _ in parts], np.int64)
        begins = upto - upto[np.searchsorted(of, of)] if len(of) else upto
        keys = [xxhash.xxh32_intdigest(b"%d %d" % (self.key, variant)) for variant in variants]
        at = 0
        while at < len(parts):
            # A group of parts holds a few million characters at most, whatever the texts' lengths.
            size, to = 0, at
            while to < len(parts) and (to == at or size + len(parts[to][1]) <= 2 * PART):
                size += len(parts[to][1])
                to += 1
            self._group(parts[at:to], begins[at:to], keys, out)
            at = to
        return [np.frombuffer(bytes(x), np.uint16) for x in out]

    def _group(self, parts: list[tuple[int, str]], begins: np.ndarray, keys: list[int], out: list[bytearray]) -> None:
        cut = [self.v.stretch.findall(part) for _, part in parts]
        counts = np.array(list(map(len, cut)), np.int64)
        all_ = list(chain.from_iterable(cut))
        # Stretches are numbered as they are met.
        number: dict[str, int] = defaultdict(count().__next__)
        which = np.fromiter(map(number.__getitem__, all_), np.int64, len(all_))
        entries = self._table(list(number))
        # The ids of each stretch are a run in one of the pools, which are laid end to end; the entries are the first.
        pools = [b"".join(entries)]
        data = np.frombuffer(pools[0], np.uint16)
        upto, lengths = len(data), np.fromiter(map(len, entries), np.int64, len(entries)) // 2
        heads = np.cumsum(lengths) - lengths
        n_ids, n_spots = data[heads + 2].astype(np.int64), data[heads + 3].astype(np.int64)
        alone = n_ids == _NO_IDS
        n_ids[alone] = 0
        first, n, alone = (heads + _HEAD)[which], n_ids[which], alone[which]
        if self.skip:
            sizes = np.fromiter(map(len, all_), np.int64, len(all_))
            ends = np.cumsum(sizes)
            firsts = np.cumsum(counts) - counts
            part_begin = begins - (ends - sizes)[np.minimum(firsts, len(all_) - 1)]
            at = ends - sizes + np.repeat(part_begin, counts)
            own = data[heads].astype(np.uint64) | data[heads + 1].astype(np.uint64) << np.uint64(16)
            bases = _bases(own[which], np.repeat(np.array([keys[k] for k, _ in parts], np.uint64), counts), at)
            spots, mine = data[_spread(heads + _HEAD + n_ids, 2 * n_spots)].view(np.uint32), n_spots[which]
            over = _lowest(np.repeat(bases.astype(np.uint32), mine) + spots[_spread((np.cumsum(n_spots) - n_spots)[which], mine)], self.skip)
            hit = np.zeros(len(all_), bool)
            hit[np.repeat(np.arange(len(all_)), mine)[over]] = True
            changed = np.flatnonzero(hit)
            least = 0
            for most in _SHORT:
                some = changed[(sizes[changed] > least) & (sizes[changed] <= most)]
                least = most
                for k in range(0, len(some), _TOGETHER):
                    part = some[k : k + _TOGETHER]
                    ids, made, known = merged_in_step(self.v, [all_[i] for i in part.tolist()], bases[part], self.skip)
                    first[part], n[part], alone[part] = upto + np.cumsum(made) - made, made, ~known
                    pools.append(ids.tobytes())
                    upto += len(ids)
        met: dict[tuple[str, int], tuple[int, int]] = {}
        for i in np.flatnonzero(alone).tolist():
            base = int(bases[i]) if self.skip else 0
            if (found := met.get((all_[i], base))) is None:
                pools.append(self._stretch(all_[i], base))
                found = met[all_[i], base] = upto, len(pools[-1]) // 2
                upto += found[1]
            first[i], n[i] = found
        ids = np.frombuffer(b"".join(pools), np.uint16)[_spread(first, n)].tobytes()
        ends = np.concatenate([[0], np.cumsum(n)])[np.cumsum(counts)].tolist()
        for (k, _), a, b in zip(parts, [0, *ends], ends):
            out[k] += ids[2 * a : 2 * b]

    def _table(self, seen: list[str]) -> list[bytes]:
        """What is remembered, or found now, of each of these different stretches."""
        young, old = self.young[0], self.old[0]
        table, rest, new = [], [], []
        for k, s in enumerate(seen):
            if (known := young.get(s)) is None:
                rest.append(k)
                if (known := old.get(s)) is None:
                    new.append(k)
            table.append(known)
        for k, known in zip(new, self._new([seen[k] for k in new])):
            table[k] = known
        for k in rest:
            s = seen[k]
            if len(s) <= LONGEST_REMEMBERED:
                if len(young) >= REMEMBERED // 2:
                    self.old[0], self.young[0] = young, {}
                    young = self.young[0]
                young[s] = table[k]
        return table

    def encode(self, text: str | None, variant: int = 0) -> list[int]:
        """Ids of one whole text."""
        return self.encode_all([text], [variant])[0].tolist()


#: Characters of a text that are cut into stretches at a time.
PART = 1 << 20
_BEFORE_BLANK = re.compile(r"[^ ](?= )")


def _parts(text: str, size: int = PART) -> Iterator[str]:
    """The text in parts of about `size` characters, cut where a run of blanks begins."""
    at = 0
    while at < len(text):
        cut = _BEFORE_BLANK.search(text, at + size) if len(text) - at > size else None
        end = cut.end() if cut else len(text)
        yield text[at:end]
        at = end


def decode(v: Vocabulary, ids) -> str:
    """The text that was encoded: the bytes of the pieces, without the blank put before it."""
    data = b"".join(map(v.bytes.__getitem__, ids))
    return (data[1:] if data[:1] == b" " else data).decode()


@lru_cache(maxsize=2)
def _encoder(folder: str, name: str, dropout: float, key: int) -> Encoder:
    return Encoder(vocabulary(folder, name), dropout, key)


def variant_of(doc_id: int | None, variants: int) -> int:
    """Which of the segmentations a document has; 0 for a null id."""
    return 0 if doc_id is None else xxhash.xxh64_intdigest(b"%d" % doc_id) % variants


def encoded(
    docs: DataFrame, keep: tuple[str, ...] = (), dropout: float = DROPOUT, key: int = 0, variants: int = VARIANTS, folder: str = vocabularies.FOLDER, name: str = vocabularies.PIECE_BPE
) -> DataFrame:
    """(doc_id, *keep, variant, ids) of each document.

    A null text gives no ids, as an empty one does; a null doc_id has variant 0. Rows
    with equal doc_id and text get equal ids. Texts of any length are encoded whole, in
    parts cut where none can meet. No documents give no rows, and columns that are not
    kept don't matter.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *keep, "text")
    out = slim.drop("text").withColumns({"variant": F.lit(0), "ids": F.array().cast("array<int>")}).schema

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(folder, name, dropout, key)
        for batch in small(batches, ROWS):
            chosen = [variant_of(i, variants) for i in batch.column(0).to_pylist()]
            ids = encoder.encode_all(batch.column(batch.num_columns - 1).to_pylist(), chosen)
            ends = np.cumsum([0, *map(len, ids)])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*ids, np.zeros(0, np.uint16)]).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(chosen, pa.int32()), lists], out.names)

    return slim.mapInArrow(each, out)


def decoded(tokens: DataFrame, folder: str = vocabularies.FOLDER, name: str = vocabularies.PIECE_BPE) -> DataFrame:
    """tokens(doc_id, ids): (doc_id, text) of each row, whatever the variant; null and empty ids give an empty text, no rows give none."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(folder, name)
        for batch in small(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([decode(v, x or []) for x in batch.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return tokens.select("doc_id", "ids").mapInArrow(each, "doc_id long, text string")


DIGEST = "doc_id long, variant int, n_tokens long, n_bytes long, ids_crc32 long, lossless boolean"


def encoded_digests(
    docs: DataFrame, dropout: float = DROPOUT, key: int = 0, variants: int = VARIANTS, folder: str = vocabularies.FOLDER, name: str = vocabularies.PIECE_BPE
) -> DataFrame:
    """For each document the variant, how many tokens and byte pieces it has, the CRC-32 of its ids (4 bytes each, low byte first), and whether decoding gives the text back.

    A null text counts as empty, with no tokens; a null doc_id has variant 0. Repeated
    rows get equal results, no documents give no rows, other columns don't matter.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(folder, name, dropout, key)
        low, high = min(encoder.v.bytes_ids), max(encoder.v.bytes_ids)
        for batch in small(batches, ROWS):
            rows = []
            texts, chosen = batch.column(1).to_pylist(), [variant_of(i, variants) for i in batch.column(0).to_pylist()]
            for text, variant, ids in zip(texts, chosen, encoder.encode_all(texts, chosen)):
                n_bytes = int(((ids >= low) & (ids <= high)).sum())
                rows.append((variant, len(ids), n_bytes, zlib.crc32(ids.astype("<i4").tobytes()), decode(encoder.v, ids.tolist()) == (text or "")))
            columns = list(zip(*rows))
            types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types))], [x.split()[0] for x in DIGEST.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(each, DIGEST)
