"""A small gated recurrent network with a class-factored softmax, in numpy: training and scoring of documents.

Tokens are numbers: `head` words have a place of their own, all others only the number of their tail
class. The next token's class comes from a softmax over the state, a head word from a softmax within
its class. A tail word's probability within its class is left to the caller.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

F32 = np.float32


@dataclass
class Shape:
    """head_class: class of each head word, in ascending order of words, so that a class is a run of them; tails: number of tail classes, which come after the head's."""

    head_class: np.ndarray
    tails: int
    hidden: int

    @property
    def head(self) -> int:
        return len(self.head_class)

    @property
    def head_classes(self) -> int:
        return int(self.head_class[-1]) + 1 if len(self.head_class) else 0

    @property
    def classes(self) -> int:
        return self.head_classes + self.tails

    def class_of(self, token: np.ndarray) -> np.ndarray:
        """Tokens from head on are tail classes."""
        own = np.concatenate([self.head_class, np.arange(self.head_classes, self.classes)])
        return own[token]

    def runs(self) -> np.ndarray:
        return np.searchsorted(self.head_class, np.arange(self.head_classes + 1))


def new_weights(shape: Shape, counts: np.ndarray, seed: int = 3) -> dict[str, np.ndarray]:
    """Small random weights, and biases that make the untrained network the unigram model of `counts` (head words, then tail classes)."""
    rng = np.random.default_rng(seed)
    h = shape.hidden
    of_class = np.bincount(shape.class_of(np.arange(shape.head + shape.tails)), weights=counts, minlength=shape.classes)
    return {
        "E": rng.normal(0, 0.1, (shape.head + shape.tails + 1, 3 * h)).astype(F32),
        "U": rng.normal(0, 1 / np.sqrt(h), (h, 3 * h)).astype(F32) * F32(0.5),
        "Wc": np.zeros((h, shape.classes), F32),
        "bc": np.log((of_class + 0.5) / (of_class.sum() + 0.5 * shape.classes)).astype(F32),
        "Wo": np.zeros((shape.head, h), F32),
        "bo": np.log(counts[: shape.head] + 0.5).astype(F32),
    }


def order_of(x: np.ndarray) -> np.ndarray:
    """A stable order of small numbers; 16 bits are sorted by digits."""
    return np.argsort(x.astype(np.uint16) if len(x) and x.max() < 1 << 16 else x, kind="stable")


def sigmoid(x: np.ndarray) -> np.ndarray:
    return F32(1) / (F32(1) + np.exp(-x))


def lanes(lengths: np.ndarray, n: int) -> list[list[int]]:
    """Documents dealt to n lanes, the longest first, each to the shortest lane; lanes by falling length."""
    import heapq

    heap = [(0, k) for k in range(n)]
    out: list[list[int]] = [[] for _ in range(n)]
    for d in np.argsort(-lengths, kind="stable").tolist():
        size, k = heapq.heappop(heap)
        out[k].append(d)
        heapq.heappush(heap, (size + int(lengths[d]), k))
    total = [int(lengths[x].sum()) if x else 0 for x in out]
    return [out[k] for k in sorted(range(n), key=lambda k: -total[k]) if total[k]]


class Streams:
    """Documents laid out in lanes: at each step, for the lanes still running, the token before, the token to come, and whether a document begins."""

    def __init__(self, tokens: np.ndarray, first: np.ndarray, shape: Shape, width: int, segment: int | None = None):
        starts = first[:-1][np.diff(first) > 0]
        if segment:  # long documents in segments, each in a lane of its own, that go on from the token before but not from its state
            first = np.unique(np.concatenate([first, *[np.arange(a, b, segment) for a, b in zip(first[:-1], first[1:]) if b - a > segment]]))
        self.docs = lanes(np.diff(first), width)
        rows = [np.concatenate([np.arange(first[d], first[d + 1]) for d in own]) for own in self.docs]
        self.sizes = np.array([len(x) for x in rows])
        steps = int(self.sizes.max()) if len(rows) else 0
        self.at = np.full((steps, len(rows)), -1, np.int64)
        for k, x in enumerate(rows):
            self.at[: len(x), k] = x
        begins = np.zeros(len(tokens), bool)
        begins[first[:-1][np.diff(first) > 0]] = True
        self.begins = begins
        self.before = np.empty(len(tokens), np.int64)
        self.before[1:] = tokens[:-1]
        self.before[starts] = shape.head + shape.tails
        self.tokens = tokens

    def windows(self, size: int):
        for a in range(0, len(self.at), size):
            yield self.at[a : a + size]


def run(w: dict[str, np.ndarray], s: Streams, at: np.ndarray, h: np.ndarray, keep: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """One window: states before each token, (steps, lanes, hidden), and the state after it. keep: gets what the backward pass needs."""
    k = h.shape[1]
    states = np.empty((len(at), len(h), k), F32)
    for t, row in enumerate(at):
        n = int((row >= 0).sum())  # lanes are sorted by length
        row = row[:n]
        own = h[:n]
        new = s.begins[row]
        if new.any():
            own = own * ~new[:, None]
        e = w["E"][s.before[row]]
        u = own @ w["U"]
        g = sigmoid(e[:, : 2 * k] + u[:, : 2 * k])
        r, z = g[:, :k], g[:, k:]
        c = np.tanh(e[:, 2 * k :] + r * u[:, 2 * k :])
        after = c + z * (own - c)
        states[t, :n] = after
        h = h.copy() if keep is not None else h
        h[:n] = after
        if keep is not None:
            keep.append((row, own, new, r, z, c, u[:, 2 * k :]))
    return states, h


def output(w: dict[str, np.ndarray], shape: Shape, x: np.ndarray, token: np.ndarray, gradient: dict[str, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """Natural logs of the probabilities of tokens (a tail word's: of its class) from states, and the states' gradient."""
    # classes and words are rows and states columns, so that sums over classes run along memory
    cls = shape.class_of(token)
    cols = np.arange(len(token))
    z = w["Wc"].T @ x.T
    z += w["bc"][:, None]
    z -= z.max(axis=0)
    logp = z[cls, cols]
    np.exp(z, out=z)
    total = z.sum(axis=0)
    logp -= np.log(total)
    back = None
    if gradient is not None:
        z /= total
        z[cls, cols] -= 1
        back = z.T @ w["Wc"].T
        gradient["Wc"] += (z @ x).T
        gradient["bc"] += z.sum(axis=1)
    runs = shape.runs()
    order = order_of(cls)
    cut = np.searchsorted(cls[order], np.arange(shape.head_classes + 1))
    order = order[: cut[-1]]  # the head's words, class by class
    xs, hit, lp = x[order], token[order], np.zeros(len(order), F32)
    more = None if gradient is None else np.zeros_like(xs)
    for c in range(shape.head_classes):
        a, b = runs[c], runs[c + 1]
        own = slice(cut[c], cut[c + 1])
        if cut[c] == cut[c + 1] or b - a < 2:
            continue
        y = w["Wo"][a:b] @ xs[own].T
        y += w["bo"][a:b, None]
        y -= y.max(axis=0)
        at, some = hit[own] - a, np.arange(y.shape[1])
        first = y[at, some]
        np.exp(y, out=y)
        total = y.sum(axis=0)
        lp[own] = first - np.log(total)
        if gradient is not None:
            y /= total
            y[at, some] -= 1
            more[own] = y.T @ w["Wo"][a:b]
            gradient["Wo"][a:b] += y @ xs[own]
            gradient["bo"][a:b] += y.sum(axis=1)
    logp[order] += lp
    if back is not None:
        back[order] += more
    return logp, back


def log_probability(w: dict[str, np.ndarray], shape: Shape, tokens: np.ndarray, first: np.ndarray, width: int = 768, window: int = 48) -> np.ndarray:
    """Natural log of each document's probability, tail words by their classes; the state is carried through whole documents."""
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    logp = np.zeros(len(tokens), F32)
    if not len(tokens):
        return np.zeros(len(first) - 1)
    s = Streams(tokens, first, shape, width)
    h = np.zeros((len(s.docs), shape.hidden), F32)
    for at in s.windows(window):
        states, h = run(w, s, at, h)
        real = at >= 0
        where = at[real]
        logp[where] = output(w, shape, states[real], tokens[where])[0]
    return np.bincount(doc, weights=logp, minlength=len(first) - 1)


def train(w: dict[str, np.ndarray], shape: Shape, tokens: np.ndarray, first: np.ndarray, width: int = 384, window: int = 16, rate: float = 0.03, segment: int = 256) -> dict[str, np.ndarray]:
    """One pass of truncated backpropagation through time over documents, by Adam, in segments of long ones."""
    w = {k: x.copy() for k, x in w.items()}
    if not len(tokens):
        return w
    m, v = ({k: np.zeros_like(x) for k, x in w.items()} for _ in range(2))
    s = Streams(tokens, first, shape, width, segment)
    h = np.zeros((len(s.docs), shape.hidden), F32)
    k, step = shape.hidden, 0
    for at in s.windows(window):
        kept: list = []
        states, h = run(w, s, at, h, kept)
        real = at >= 0
        g = {name: np.zeros_like(x) for name, x in w.items()}
        _, back = output(w, shape, states[real], tokens[at[real]], g)
        full = np.zeros_like(states)
        full[real] = back
        later = np.zeros((len(h), k), F32)
        owns, zs, cs, rs, uns = (np.concatenate([x[j] for x in kept]) for j in (1, 4, 5, 3, 6))
        of_c, of_z, of_r = (1 - zs) * (1 - cs * cs), (owns - cs) * zs * (1 - zs), uns * rs * (1 - rs)  # what each step's gradient is multiplied by
        ends = np.cumsum([len(x[0]) for x in kept])
        change, du = np.empty((len(zs), 3 * k), F32), np.empty((len(zs), 3 * k), F32)
        back_u = np.ascontiguousarray(w["U"].T)
        for t in range(len(at) - 1, -1, -1):
            row, new = kept[t][0], kept[t][2]
            n = len(row)
            own = slice(ends[t] - n, ends[t])
            d = full[t, :n] + later[:n]
            dc = d * of_c[own]
            du[own, :k] = dc * of_r[own]
            du[own, k : 2 * k] = d * of_z[own]
            du[own, 2 * k :] = dc * rs[own]
            change[own, 2 * k :] = dc
            prev = d * zs[own] + du[own] @ back_u
            if new.any():
                prev[new] = 0
            later[:n] = prev
        change[:, : 2 * k] = du[:, : 2 * k]
        g["U"] += owns.T @ du
        inputs, changes = [s.before[x[0]] for x in kept], [change]
        x, dx = np.concatenate(inputs), np.concatenate(changes)
        order = order_of(x)
        x = x[order]
        begin = np.flatnonzero(np.r_[True, x[1:] != x[:-1]])
        g["E"][x[begin]] = np.add.reduceat(dx[order], begin, axis=0)
        step += 1
        scale = F32(1 / max(1, int(real.sum())))
        for name in w:
            grad = g[name] * scale
            m[name] += F32(0.1) * (grad - m[name])
            v[name] += F32(0.005) * (grad * grad - v[name])
            w[name] -= F32(rate / (1 - 0.9**step)) * m[name] / (np.sqrt(v[name] / F32(1 - 0.995**step)) + F32(1e-7))
    return w
