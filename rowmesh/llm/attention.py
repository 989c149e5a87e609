"""A small causal self-attention model over subword ids, in numpy: forward, backward and windowed scoring.

The model predicts the class of the next subword, then, by two-way choices down the
class's Huffman tree, the subword within it; each choice starts from the corpus
counts. One layer of attention looks back over a window with a learned bias for each
distance.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np

#: Width of the vectors, classes of next subwords, rows of the embedding where none are asked for (a lexicon has one for each subword), window, and how many new tokens a window scores.
WIDTH, CLASSES, ROWS, WINDOW, STRIDE = 16, 64, 4096, 32, 16
#: Windows in a training step and in a scoring step.
STEP_WINDOWS, SCORE_WINDOWS = 64, 512
_FAR = np.float32(-1e9)
#: Exponentials of numbers up to this size stay within float32.
_SAFE = 60.0

Params = dict[str, np.ndarray]


#: More than any subword has choices.
_MOST = np.uint16(65535)


def shapes(rows: int = ROWS) -> dict[str, tuple[int, ...]]:
    d = WIDTH
    whole = {"q": (d, d), "k": (d, d), "v": (d, d), "o": (d, CLASSES), "r": (d, CLASSES), "b": (CLASSES,), "far": (WINDOW,), "w": (d, d), "u": (d, d)}
    return {"E": (rows, d), **whole, "t": (rows, d), "d": (rows,)}


def initial(class_share: np.ndarray, seed: int = 7, rows: int = ROWS) -> Params:
    """Seeded start: classes, and subwords within them, as frequent as in the corpus, near distances a little favoured."""
    rng = np.random.default_rng(seed)
    p = {k: (rng.standard_normal(s) * (0.5 if k == "E" else 0.5 / np.sqrt(s[0]))).astype(np.float32) for k, s in shapes(rows).items() if k not in ("t", "d")}
    p["b"] = np.log(class_share).astype(np.float32)
    p["far"] = (-0.1 * np.arange(WINDOW)).astype(np.float32)
    p["t"], p["d"] = np.zeros((rows, WIDTH), np.float32), np.zeros(rows, np.float32)
    return p


def flat(p: Params) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in shapes()])


def unflat(values: np.ndarray) -> Params:
    out, at = {}, 0
    a_row = sum(int(np.prod(s)) for s in shapes(1).values()) - (fixed := sum(int(np.prod(s)) for s in shapes(0).values()))
    for k, s in shapes((len(values) - fixed) // a_row).items():
        n = int(np.prod(s))
        out[k] = values[at : at + n].reshape(s)
        at += n
    return out


def _softmax(x: np.ndarray, times: np.ndarray | None = None) -> None:
    """In place, over the last axis; each row times a number, if there are any."""
    ones = np.ones(x.shape[-1], x.dtype)
    # One maximum for all rows does, unless some row lies far below it.
    e = x - x.max()
    total = np.exp(e, out=e) @ ones
    if total.min() < 1e-25:
        np.subtract(x, x.max(axis=-1, keepdims=True), out=e)
        total = np.exp(e, out=e) @ ones
    np.multiply(e, ((1 if times is None else times) / total)[..., None], out=x)


@dataclass
class Choices:
    """The two-way choices that lead to the targets: at which place, at which node, which way (1 or -1), and the node's log odds.

    First come the first choices of all targets, then the second ones of those that have one, and so on: the
    targets with more choices stand before those with fewer, so each level is that of the one before it, cut short to its size.
    """

    place: np.ndarray
    node: np.ndarray
    way: np.ndarray
    odds: np.ndarray
    sizes: list[int]


def _gathered(at: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of the rows of `values` by their place among n."""
    out, columns = np.empty((n, values.shape[1]), values.dtype), np.ascontiguousarray(values.T, np.float64)
    for k, column in enumerate(columns):
        out[:, k] = np.bincount(at, column, n)
    return out


def loss_and_gradient(p: Params, rows: np.ndarray, target: np.ndarray, real: np.ndarray, choices: Choices | None = None, with_loss: bool = True) -> tuple[float, Params]:
    """Mean cross-entropy (0 without with_loss) of the target classes (windows x places) where `real`, with that of the choices within them, and its gradient; rows are embedding rows."""
    n, w = rows.shape
    scale = 1 / np.sqrt(WIDTH)
    lag = np.arange(w)[:, None] - np.arange(w)
    far = p["far"][np.maximum(lag, 0)] + np.where(lag < 0, _FAR, 0).astype(p["E"].dtype)
    # Two-dimensional where a product runs over all places, three-dimensional where it stays within a window.
    flat2 = lambda x: x.reshape(n * w, -1)
    deep = lambda x: x.reshape(n, w, -1)
    # What the attention gathers and the subword itself go through one product.
    both = np.empty((n * w, 2 * WIDTH), p["E"].dtype)
    e = p["E"].take(rows.ravel(), axis=0)
    qkv = np.hstack([p["q"] * e.dtype.type(scale), p["k"], p["v"]])
    q, k, v = (deep(e @ np.ascontiguousarray(x)) for x in np.split(qkv, 3, axis=1))
    a = q @ k.transpose(0, 2, 1)
    a += far
    _softmax(a)
    both[:, :WIDTH], both[:, WIDTH:] = flat2(a @ v), e
    out = np.vstack([p["o"], p["r"]])
    y = both @ out
    y += p["b"]
    real, each, goal = real.ravel(), np.arange(n * w), target.ravel()
    count = max(1, int(real.sum()))
    part = (real / y.dtype.type(count)).astype(y.dtype)
    if with_loss:
        _softmax(y)
        loss = float(-(np.log(np.maximum(y[each, goal], 1e-30)) * real).sum() / count)
        y *= part[:, None]
    else:
        loss = 0.0
        _softmax(y, part)
    dy = y
    dy[each, goal] -= part
    g_out, d_both = both.T @ dy, dy @ out.T
    g = {"o": g_out[:WIDTH], "r": g_out[WIDTH:], "b": np.ones(len(dy), dy.dtype) @ dy}
    if choices is not None and len(choices.place):
        wu = np.vstack([p["w"], p["u"]])
        h = (both @ wu).take(choices.place, axis=0)
        t = p["t"].take(choices.node, axis=0)
        z = choices.way * (np.einsum("ij,ij->i", h, t) + p["d"].take(choices.node) + choices.odds.astype(h.dtype))
        if with_loss:
            loss += float(np.logaddexp(0, -z).sum() / count)
        dz = (-choices.way / (1 + np.exp(np.clip(z, -_SAFE, _SAFE))) / h.dtype.type(count)).astype(h.dtype)
        g["d"] = np.bincount(choices.node, dz, len(p["d"])).astype(h.dtype)
        h *= dz[:, None]
        g["t"] = _gathered(choices.node, h, len(p["t"]))
        t *= dz[:, None]
        # Each level adds to the first places of the one before it.
        at = upto = choices.sizes[0]
        for size in choices.sizes[1:]:
            t[:size] += t[upto : upto + size]
            upto += size
        dh = np.zeros((n * w, WIDTH), h.dtype)
        dh[choices.place[:at]] = t[:at]
        g_wu = both.T @ dh
        d_both += dh @ wu.T
        g["w"], g["u"] = g_wu[:WIDTH], g_wu[WIDTH:]
    else:
        for name in ("w", "u", "t", "d"):
            g[name] = np.zeros_like(p[name])
    dc, de = deep(np.ascontiguousarray(d_both[:, :WIDTH])), d_both[:, WIDTH:]
    ds = dc @ v.transpose(0, 2, 1)
    ds -= np.einsum("nij,nij->ni", ds, a)[..., None]
    ds *= a
    by_lag = np.ones(n, ds.dtype) @ ds.reshape(n, w * w)
    g["far"] = np.bincount(np.maximum(lag, 0).ravel(), by_lag * (lag >= 0).ravel(), WINDOW).astype(p["E"].dtype)
    d_qkv = np.empty((n * w, 3 * WIDTH), ds.dtype)
    d_qkv[:, :WIDTH] = flat2(ds @ k)
    # The queries hold the scale already.
    d_qkv[:, WIDTH : 2 * WIDTH] = flat2(ds.transpose(0, 2, 1) @ q)
    d_qkv[:, 2 * WIDTH :] = flat2(a.transpose(0, 2, 1) @ dc)
    g_qkv = e.T @ d_qkv
    g["q"], g["k"], g["v"] = g_qkv[:, :WIDTH] * g_qkv.dtype.type(scale), g_qkv[:, WIDTH : 2 * WIDTH], g_qkv[:, 2 * WIDTH :]
    de = de + d_qkv @ qkv.T
    g["E"] = _gathered(rows.ravel(), de, len(p["E"]))
    return loss, g


def _some(values: np.ndarray, lookup: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different numbers among the values in order, and which of them each value is; lookup is scratch space."""
    flags = np.zeros(len(lookup), bool)
    flags[values] = True
    found = np.flatnonzero(flags)
    lookup[found] = np.arange(len(found))
    return found, lookup[values]


#: Parameters without rows, and the tables that go by subword and by node.
_WHOLE, _BY_ROW, _BY_NODE = ("q", "k", "v", "o", "r", "b", "far", "w", "u"), ("E",), ("t", "d")


class Trainer:
    """Adam from given parameters, which stay as they are; of the tables with a row for each subword or node, a step changes only the rows it meets."""

    def __init__(self, start: Params, lex: Lexicon, rate: float, seed: int = 3):
        # Side by side: parameters, their first and their second moments.
        self.whole = np.stack([np.concatenate([start[k].ravel() for k in _WHOLE]), *np.zeros((2, sum(start[k].size for k in _WHOLE)), np.float32)])
        n = len(start["E"])
        self.by_row, self.by_node = np.zeros((n, 3, WIDTH), np.float32), np.zeros((n, 3, WIDTH + 1), np.float32)
        self.by_row[:, 0], self.by_node[:, 0, :WIDTH], self.by_node[:, 0, WIDTH] = start["E"], start["t"], start["d"]
        self.p, at = {"E": self.by_row[:, 0], "t": self.by_node[:, 0, :WIDTH], "d": self.by_node[:, 0, WIDTH]}, 0
        for k in _WHOLE:
            self.p[k] = self.whole[0, at : at + start[k].size].reshape(start[k].shape)
            at += start[k].size
        self.lex, self.rate, self.steps = lex, rate, 0
        self.lookup, self.rng = np.zeros(n, np.int64), np.random.default_rng(seed)

    def learn(self, ids: np.ndarray, real: np.ndarray) -> None:
        """Once over the windows (rows of ids, each the target of the one before it, where `real`) in seeded order."""
        order = self.rng.permutation(len(ids))
        for at in range(0, len(order), STEP_WINDOWS):
            self._step(ids[order[at : at + STEP_WINDOWS]], real[order[at : at + STEP_WINDOWS]])

    def _step(self, ids: np.ndarray, real: np.ndarray) -> None:
        lex, goal = self.lex, ids[:, 1:]
        met, rows = _some(lex.row[ids[:, :-1]], self.lookup)
        place = np.flatnonzero(real.ravel())
        choices = lex.choices(place, goal.ravel()[place])
        nodes, choices.node = _some(choices.node, self.lookup)
        row, node = self.by_row.take(met, axis=0), self.by_node.take(nodes, axis=0)
        p = self.p | {"E": row[:, 0], "t": np.ascontiguousarray(node[:, 0, :WIDTH]), "d": node[:, 0, WIDTH]}
        _, g = loss_and_gradient(p, rows, lex.cls[goal].astype(np.int64), real, choices, with_loss=False)
        self.steps += 1
        self._adam(self.whole, np.concatenate([g[k].ravel() for k in _WHOLE]))
        self._adam(row.transpose(1, 0, 2), g["E"])
        self._adam(node.transpose(1, 0, 2), np.hstack([g["t"], g["d"][:, None]]))
        self.by_row[met], self.by_node[nodes] = row, node

    def _adam(self, state: np.ndarray, g: np.ndarray) -> None:
        """One step of parameters and their moments, in place."""
        size, scale = np.float32(self.rate / (1 - 0.9**self.steps)), np.float32(1 / (1 - 0.99**self.steps))
        p, m, s = state
        m += np.float32(0.1) * (g - m)
        g = g * g
        g -= s
        g *= np.float32(0.01)
        s += g
        by = np.sqrt(scale * s)
        by += np.float32(1e-8)
        np.divide(m, by, out=by)
        by *= size
        p -= by


def train(start: Params, lex: Lexicon, ids: np.ndarray, real: np.ndarray, passes: int, rate: float, seed: int = 3) -> Params:
    """`passes` times over the windows, see Trainer."""
    trainer = Trainer(start, lex, rate, seed)
    for _ in range(passes):
        trainer.learn(ids, real)
    return trainer.p


@dataclass
class Lexicon:
    """What the corpus counts say of each subword id: embedding row, class, log share within the class, and its way down the class's tree. The last id ends a text.

    The choices of id i are those from begins[i] to begins[i + 1]: a node and which way to go there. odds has the log odds of each node.
    """

    row: np.ndarray
    cls: np.ndarray
    share: np.ndarray
    class_share: np.ndarray
    begins: np.ndarray
    nodes: np.ndarray
    ways: np.ndarray
    odds: np.ndarray

    def __post_init__(self):
        self.lengths = np.diff(self.begins).astype(np.uint16)

    def choices(self, place: np.ndarray, ids: np.ndarray) -> Choices:
        """The choices that lead to the ids, each at its place."""
        lo, n = self.begins.take(ids), self.lengths.take(ids)
        order = np.argsort(_MOST - n, kind="stable")
        lo, place = lo.take(order), place.take(order)
        # How many have a first choice, a second one, and so on.
        sizes = len(ids) - np.cumsum(np.bincount(n))[:-1]
        within = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        at = lo.take(within)
        at += np.repeat(np.arange(len(sizes)), sizes)
        node = self.nodes.take(at)
        return Choices(place.take(within), node, self.ways.take(at), self.odds.take(node), sizes.tolist())

    @property
    def end(self) -> int:
        return len(self.row) - 1


def lexicon(counts: np.ndarray, pieces: list[bytes]) -> Lexicon:
    """counts and bytes of each subword id; the last id is the end.

    Every id has an embedding row of its own. Classes are stretches of the alphabet of about equal frequency,
    with the end a class of its own; every id has one count more than seen.
    """
    n = len(counts)
    row = np.empty(n, np.int32)
    row[np.lexsort((np.arange(n), -counts))] = np.arange(n)
    plus = counts + 1.0
    order = np.array(sorted(range(n - 1), key=pieces.__getitem__))
    upto = np.cumsum(plus[order])
    cls = np.zeros(n, np.int32)
    cls[order] = 1 + np.minimum(CLASSES - 2, ((upto - plus[order] / 2) / upto[-1] * (CLASSES - 1)).astype(np.int32))
    total = np.bincount(cls, plus, CLASSES)
    share = np.log(plus) - np.log(total[cls])
    smooth = (total + 1) / (total + 1).sum()
    return Lexicon(row, cls, share.astype(np.float64), smooth, *_trees(plus, cls))


def _trees(plus: np.ndarray, cls: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """begins, nodes, ways and odds of a Huffman tree over the ids of each class."""
    n, made, odds = len(plus), 0, np.zeros(len(plus), np.float32)
    up: dict[int, tuple[int, int]] = {}
    for c in range(CLASSES):
        # Ids are leaves; a node is n and its number.
        heap = [(float(plus[i]), int(i)) for i in np.flatnonzero(cls == c)]
        heapq.heapify(heap)
        while len(heap) > 1:
            (a, x), (b, y) = heapq.heappop(heap), heapq.heappop(heap)
            up[x], up[y] = (made, -1), (made, 1)
            odds[made] = np.log(b / a)
            heapq.heappush(heap, (a + b, n + made))
            made += 1
    begins, nodes, ways = [0], [], []
    for i in range(n):
        at = i
        while at in up:
            node, way = up[at]
            nodes.append(node)
            ways.append(way)
            at = n + node
        begins.append(len(nodes))
    return np.array(begins, np.int64), np.array(nodes, np.int32), np.array(ways, np.int8), odds


class Scorer:
    """log10 probabilities of subword sequences. Every token is scored once, in the window whose last STRIDE places hold it."""

    def __init__(self, p: Params, lex: Lexicon):
        self.lex, self.blank = lex, len(p["E"])
        one = np.ones((self.blank + 1, 1), np.float32)
        blank = np.zeros((1, WIDTH), np.float32)
        # A last column of queries and keys hides the places before a text begins.
        self.q = np.hstack([np.vstack([p["E"] @ p["q"], blank]) / np.float32(np.sqrt(WIDTH)), one]).astype(np.float32)
        self.k = np.hstack([np.vstack([p["E"] @ p["k"], blank]), np.where(np.arange(self.blank + 1) == self.blank, _FAR, 0)[:, None]]).astype(np.float32)
        # A last column of values adds up the weights.
        self.v = np.hstack([np.vstack([p["E"] @ p["v"], blank]), one]).astype(np.float32)
        self.o = p["o"]
        self.r = np.vstack([p["E"] @ p["r"] + p["b"], np.zeros((1, CLASSES), np.float32)]).astype(np.float32)
        self.w, self.t, self.d = (np.ascontiguousarray(p[k]) for k in ("w", "t", "d"))
        self.u = np.vstack([p["E"] @ p["u"], blank]).astype(np.float32)
        lag = np.arange(WINDOW - STRIDE, WINDOW)[:, None] - np.arange(WINDOW)
        self.far = np.where(lag < 0, _FAR, p["far"][np.maximum(lag, 0)]).astype(np.float32)
        # Where no score can be large, exponentials need no maximum taken off.
        norm = lambda x, axis: float(np.sqrt((x.astype(np.float64) ** 2).sum(axis=axis)).max())
        self.near = norm(self.q[:, :-1], 1) * norm(self.k[:, :-1], 1) + float(np.abs(p["far"]).max()) < _SAFE
        self.calm = norm(self.v[:, :-1], 1) * norm(self.o, 0) + float(np.abs(self.r).max()) < _SAFE
        self.ones = np.ones(CLASSES, np.float32)

    def score(self, texts: list[np.ndarray]) -> np.ndarray:
        """One log10 probability for each text of ids: its subwords, then the end."""
        end, lead = self.lex.end, WINDOW - STRIDE
        sizes = np.array([len(x) + 1 for x in texts], np.int64)
        windows = -(-sizes // STRIDE)
        lengths = lead + windows * STRIDE
        begins = np.r_[0, np.cumsum(lengths)]
        rows = np.full(begins[-1], self.blank, np.int32)
        target = np.full(begins[-1], end, np.int64)
        real = np.zeros(begins[-1], bool)
        for x, b in zip(texts, begins):
            at = b + lead
            rows[at] = self.lex.row[end]
            rows[at + 1 : at + 1 + len(x)] = self.lex.row[x]
            target[at : at + len(x)] = x
            real[at : at + len(x) + 1] = True
        of = np.repeat(np.arange(len(texts)), windows)
        starts = np.repeat(begins[:-1] - np.r_[0, np.cumsum(windows)[:-1]] * STRIDE, windows) + np.arange(len(of)) * STRIDE
        out = np.zeros(len(texts))
        for at in range(0, len(starts), SCORE_WINDOWS):
            places = starts[at : at + SCORE_WINDOWS, None] + np.arange(WINDOW)
            seen, now = rows.take(places), places[:, lead:]
            mine = np.ascontiguousarray(seen[:, lead:])
            a = self.q.take(mine, axis=0) @ self.k.take(seen, axis=0).transpose(0, 2, 1)
            a += self.far
            if not self.near:
                a -= a.max(axis=-1, keepdims=True)
            np.exp(a, out=a)
            c = (a @ self.v.take(seen, axis=0)).reshape(-1, WIDTH + 1)
            c = c[:, :-1] / c[:, -1:]
            y = c @ self.o
            y += self.r.take(mine.ravel(), axis=0)
            goal = target.take(now.ravel())
            picked = y[np.arange(len(goal)), self.lex.cls.take(goal)].astype(np.float64)
            if not self.calm:
                top = y.max(axis=-1)
                y -= top[:, None]
                picked -= top
            np.exp(y, out=y)
            log = picked - np.log(y @ self.ones)
            place = np.flatnonzero(real.take(now.ravel()))
            way = self.lex.choices(place, goal[place])
            h = c @ self.w
            h += self.u.take(mine.ravel(), axis=0)
            z = np.einsum("ij,ij->i", h.take(way.place, axis=0), self.t.take(way.node, axis=0))
            z = way.way * (z + self.d.take(way.node) + way.odds)
            log += np.bincount(way.place, np.minimum(z, 0) - np.log1p(np.exp(-np.abs(z))), len(log))
            log = log.reshape(now.shape)
            out += np.bincount(of[at : at + SCORE_WINDOWS], (log * real.take(now)).sum(axis=1), len(texts))
        return out / np.log(10)
