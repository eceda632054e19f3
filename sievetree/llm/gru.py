"""A gated recurrent language model in numpy with a class-factored softmax.

P(word | state) = P(class | state) * P(word | class, state). The commonest words form the learned part: classes of CLASS words by
frequency, each with a learned softmax inside. All other words belong to tail classes by their form; inside a tail class a word
has its share of the training counts, one more for all words never seen. Biases start at the log shares of the counts, so the
untrained model is the unigram model and training only adds what the state tells.

Gates: z, r = sigmoid(x + U h), n = tanh(x_n + r * (U_n h)), h' = (1-z) n + z h; x is a learned row per input word.
Training is truncated backpropagation through windows of WINDOW tokens; the state, without gradient, goes from window to window, through
the whole text. Every token is learned from. A run lays SEGMENT tokens of a text into a lane at most, so that one long text does not leave
the other lanes empty; what follows is laid into the next run, with the state that the run before left and its real previous word.
"""

from __future__ import annotations

import numpy as np

HIDDEN, CLASS, WINDOW, LANES, SEGMENT = 16, 64, 16, 256, 2048
RATE, CLIP, LIMIT = 0.2, 5.0, 60.0
#: Names and order of the parameters.
PARTS = ("x", "u", "uc", "bc", "uw", "bw")


def _sigmoid(a: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-a))


def start(counts: np.ndarray, tails: np.ndarray, seed: int = 11) -> dict[str, np.ndarray]:
    """Parameters from the counts of the learned words (the commonest first, a multiple of CLASS places) and of the tail classes."""
    rng = np.random.default_rng(seed)
    classes = len(counts) // CLASS
    inside = counts.reshape(classes, CLASS) + 1.0
    every = np.r_[inside.sum(1), tails + 1.0]
    small = lambda *shape: rng.normal(0, 0.3 / np.sqrt(HIDDEN), shape).astype(np.float32)
    return {
        "x": small(len(counts) + len(tails) + 1, 3 * HIDDEN),
        "u": small(HIDDEN, 3 * HIDDEN),
        "uc": np.zeros((HIDDEN, classes + len(tails)), np.float32),
        "bc": np.log(every / every.sum()).astype(np.float32),
        "uw": np.zeros((classes, HIDDEN, CLASS), np.float32),
        "bw": np.log(inside / inside.sum(1, keepdims=True)).astype(np.float32),
    }


def flatten(model: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([model[p].ravel() for p in PARTS]).astype("<f4")


def restore(flat: np.ndarray, words: int, tails: int) -> dict[str, np.ndarray]:
    classes = words // CLASS
    shapes = {"x": (words + tails + 1, 3 * HIDDEN), "u": (HIDDEN, 3 * HIDDEN), "uc": (HIDDEN, classes + tails), "bc": (classes + tails,), "uw": (classes, HIDDEN, CLASS), "bw": (classes, CLASS)}
    out, at = {}, 0
    for p in PARTS:
        n = int(np.prod(shapes[p]))
        out[p] = flat[at : at + n].reshape(shapes[p]).astype(np.float32)
        at += n
    return out


def lanes(lengths: np.ndarray, width: int) -> list[list[int]]:
    """Sequences dealt to lanes, each to the lane that is shortest so far, longest sequence first; lanes come longest first."""
    import heapq

    heap = [(0, k) for k in range(width)]
    rows: list[list[int]] = [[] for _ in range(width)]
    loads = [0] * width
    for i in np.argsort(-lengths, kind="stable").tolist():
        load, k = heapq.heappop(heap)
        rows[k].append(i)
        loads[k] = load + int(lengths[i])
        heapq.heappush(heap, (loads[k], k))
    return [rows[k] for k in sorted(range(width), key=lambda k: -loads[k]) if rows[k]]


def segments(sequences: list[np.ndarray], length: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The sequences cut at every `length` tokens, and the token before each piece (-1 at a text's start)."""
    pieces = [(s[a : a + length], s[a - 1] if a else -1) for s in sequences for a in range(0, len(s), length)]
    return [p for p, _ in pieces], np.array([before for _, before in pieces], np.int32)


def _lay(sequences: list[np.ndarray], width: int, previous: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(tokens by time and lane, -1 behind the end; input tokens, -1 or `previous` at a sequence's start; number of the sequence; whether it starts)."""
    lengths = np.fromiter(map(len, sequences), np.int64, len(sequences))
    dealt = lanes(lengths, width)
    steps = max(int(lengths[rows].sum()) for rows in dealt)
    token = np.full((len(dealt), steps), -1, np.int32)
    before = np.full((len(dealt), steps), -1, np.int32)
    owner = np.zeros((len(dealt), steps), np.int32)
    fresh = np.zeros((len(dealt), steps), bool)
    for k, rows in enumerate(dealt):
        flat = np.concatenate([sequences[i] for i in rows])
        token[k, : len(flat)] = flat
        before[k, 1 : len(flat)] = flat[:-1]
        starts = np.cumsum(lengths[rows]) - lengths[rows]
        before[k, starts] = -1 if previous is None else previous[rows]
        fresh[k, starts] = True
        owner[k, : len(flat)] = np.repeat(rows, lengths[rows])
    return token.T, before.T, owner.T, fresh.T


def _step(model, h: np.ndarray, x: np.ndarray):
    g = h @ model["u"]
    zr = _sigmoid(x[:, : 2 * HIDDEN] + g[:, : 2 * HIDDEN])
    z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
    gn = g[:, 2 * HIDDEN :]
    n = np.tanh(x[:, 2 * HIDDEN :] + r * gn)
    return n + z * (h - n), z, r, n, gn


def _softmax(logits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(logits, their exponentials, row sums), in place. Logits are bounded by LIMIT, so no row can overflow or vanish."""
    np.clip(logits, -LIMIT, LIMIT, out=logits)
    e = np.exp(logits)
    return logits, e, e @ np.ones(e.shape[1], np.float32)


def _classes(model, h: np.ndarray):
    return _softmax(h @ model["uc"] + model["bc"])


def _inside(model, h: np.ndarray, cls: np.ndarray, classes: int):
    """Logits inside the learned classes: (rows, sorted by class; their states; [(class, from, to)]; logits, one row for each)."""
    order = np.argsort(cls.astype(np.uint16), kind="stable")
    bounds = np.searchsorted(cls[order], np.arange(classes + 1))
    rows = order[: bounds[-1]]
    some = h[rows]
    logits = np.empty((len(rows), CLASS), np.float32)
    spans = [(c, a, b) for c, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)) if b > a]
    for c, a, b in spans:
        np.matmul(some[a:b], model["uw"][c], out=logits[a:b])
        logits[a:b] += model["bw"][c]
    return rows, some, spans, logits


def log_likelihood(model, sequences: list[np.ndarray], words: int, width: int = 512, window: int = 32) -> np.ndarray:
    """Natural log probability of each sequence of tokens; a token of words or more is tail class token - words, and counts as that class. The state starts at zero with each sequence and is carried through all of its windows."""
    out = np.zeros(len(sequences))
    if not sequences:
        return out
    token, before, owner, fresh = _lay(sequences, width)
    h = np.zeros((token.shape[1], HIDDEN), np.float32)
    active = (token >= 0).sum(1)
    for at in range(0, len(token), window):
        stop = min(len(token), at + window)
        ends = np.cumsum(active[at:stop])
        tokens = np.concatenate([token[t, : active[t]] for t in range(at, stop)])
        owners = np.concatenate([owner[t, : active[t]] for t in range(at, stop)])
        carry = np.concatenate([~fresh[t, : active[t]] for t in range(at, stop)])[:, None].astype(np.float32)
        gathered = model["x"][np.concatenate([before[t, : active[t]] for t in range(at, stop)])]
        states = np.empty((len(tokens), HIDDEN), np.float32)
        a = 0
        for b in ends.tolist():
            h = states[a:b] = _step(model, h[: b - a] * carry[a:b], gathered[a:b])[0]
            a = b
        out += np.bincount(owners, token_scores(model, states, tokens, words), len(out))
    return out


def _class_of(tokens: np.ndarray, words: int) -> np.ndarray:
    return np.where(tokens < words, tokens // CLASS, tokens - words + words // CLASS)


def token_scores(model, h: np.ndarray, tokens: np.ndarray, words: int) -> np.ndarray:
    cls = _class_of(tokens, words)
    logits, _, total = _classes(model, h)
    score = (logits[np.arange(len(tokens)), cls] - np.log(total)).astype(np.float64)
    rows, _, _, inner = _inside(model, h, cls, words // CLASS)
    inner, _, total = _softmax(inner)
    score[rows] += inner[np.arange(len(rows)), tokens[rows] % CLASS] - np.log(total)
    return score


def train(model, sequences: list[np.ndarray], words: int, width: int = LANES, window: int = WINDOW, rate: float = RATE, segment: int = SEGMENT) -> int:
    """One pass of truncated backpropagation over whole texts, in place, with Adagrad steps; returns the tokens learned from."""
    trainer = Trainer(model, words, width, window, rate, segment)
    return trainer.run(sequences) + trainer.finish()


class Trainer:
    """Texts come in runs. `waiting` has what is left of texts over `segment` tokens: (pieces, the token before each, the state); each run takes the next piece of every one."""

    def __init__(self, model, words: int, width: int = LANES, window: int = WINDOW, rate: float = RATE, segment: int = SEGMENT):
        self.model, self.words, self.width, self.window, self.rate, self.segment = model, words, width, window, rate, segment
        self.waiting: list[tuple[list[np.ndarray], np.ndarray, np.ndarray]] = []

    @property
    def waits(self) -> int:
        """Tokens of waiting texts that the next run takes."""
        return sum(len(pieces[0]) for pieces, _, _ in self.waiting)

    def run(self, sequences: list[np.ndarray]) -> int:
        """Learns from the first piece of each text and the next one of each that waits; returns the tokens learned from."""
        blank = np.zeros(HIDDEN, np.float32)
        todo = [(*segments([s], self.segment), blank) for s in sequences if len(s)] + self.waiting
        self.waiting = []
        if not todo:
            return 0
        states = np.array([state for _, _, state in todo])
        more = np.array([len(pieces) > 1 for pieces, _, _ in todo])
        learned, states = self._learn([pieces[0] for pieces, _, _ in todo], np.array([before[0] for _, before, _ in todo], np.int32), states, more)
        self.waiting = [(pieces[1:], before[1:], states[i]) for i, (pieces, before, _) in enumerate(todo) if more[i]]
        return learned

    def finish(self) -> int:
        learned = 0
        while self.waiting:
            learned += self.run([])
        return learned

    def _learn(self, sequences: list[np.ndarray], previous: np.ndarray, begin: np.ndarray, wanted: np.ndarray) -> tuple[int, np.ndarray]:
        """(tokens learned from, the state behind each sequence that is wanted), from the state before each."""
        return _learn(self.model, sequences, previous, begin, wanted, self.words, self.width, self.window, self.rate)


def _learn(model, sequences: list[np.ndarray], previous: np.ndarray, begin: np.ndarray, wanted: np.ndarray, words: int, width: int, window: int, rate: float) -> tuple[int, np.ndarray]:
    token, before, owner, fresh = _lay(sequences, min(width, len(sequences)), previous)
    # Where a sequence starts that has a state, and where one ends whose state is wanted: (time, lane, sequence).
    at_time, at_lane = np.nonzero(fresh)
    at_owner = owner[at_time, at_lane]
    held_over = begin.any(1)[at_owner]
    starts = (at_time[held_over], at_lane[held_over], at_owner[held_over])
    lengths = np.fromiter(map(len, sequences), np.int64, len(sequences))
    ending = wanted[at_owner]
    ends_at = (at_time[ending] + lengths[at_owner[ending]] - 1, at_lane[ending], at_owner[ending])
    behind = np.zeros((len(sequences), HIDDEN), np.float32)
    squares = {p: np.full(model[p].shape, 1e-2, np.float32) for p in PARTS}
    carried = np.zeros((token.shape[1], HIDDEN), np.float32)
    active = (token >= 0).sum(1)
    learned = 0

    def move(part: str, grad: np.ndarray, rows=slice(None)) -> None:
        square = squares[part][rows] + grad * grad
        squares[part][rows] = square
        model[part][rows] -= rate * grad / np.sqrt(square)

    for at in range(0, len(token), window):
        span = range(at, min(len(token), at + window))
        ends = np.cumsum(active[at : span.stop])
        n_all = int(ends[-1])
        inputs = np.concatenate([before[t, : active[t]] for t in span])
        tokens = np.concatenate([token[t, : active[t]] for t in span])
        carry = np.concatenate([~fresh[t, : active[t]] for t in span])[:, None].astype(np.float32)
        gathered = model["x"][inputs]
        first = ends - active[at : span.stop]
        held, z, r, cand, gn, states = (np.empty((n_all, HIDDEN), np.float32) for _ in range(6))
        given = None
        if len(own := np.flatnonzero((starts[0] >= at) & (starts[0] < span.stop))):
            given = np.zeros((n_all, HIDDEN), np.float32)
            given[first[starts[0][own] - at] + starts[1][own]] = begin[starts[2][own]]
        h, a = carried, 0
        for b in ends.tolist():
            np.multiply(h[: b - a], carry[a:b], out=held[a:b])
            if given is not None:
                held[a:b] += given[a:b]
            states[a:b], z[a:b], r[a:b], cand[a:b], gn[a:b] = _step(model, held[a:b], gathered[a:b])
            h, a = states[a:b], b
        carried = h
        if len(own := np.flatnonzero((ends_at[0] >= at) & (ends_at[0] < span.stop))):
            behind[ends_at[2][own]] = states[first[ends_at[0][own] - at] + ends_at[1][own]]
        learned += n_all
        cls = _class_of(tokens, words)
        _, e, total = _classes(model, states)
        d_class = e / total[:, None]
        d_class[np.arange(n_all), cls] -= 1
        d_class /= np.float32(width)
        d_state = d_class @ model["uc"].T
        rows, some, spans, inner = _inside(model, states, cls, words // CLASS)
        _, p, total = _softmax(inner)
        p /= total[:, None]
        p[np.arange(len(rows)), tokens[rows] % CLASS] -= 1
        p /= np.float32(width)
        d_some = np.empty_like(some)
        d_w = np.empty((len(spans), HIDDEN, CLASS), np.float32)
        d_b = np.empty((len(spans), CLASS), np.float32)
        for i, (c, a, b) in enumerate(spans):
            np.matmul(p[a:b], model["uw"][c].T, out=d_some[a:b])
            np.matmul(some[a:b].T, p[a:b], out=d_w[i])
            p[a:b].sum(0, out=d_b[i])
        d_state[rows] += d_some
        # What a step's gradient is multiplied by does not depend on later steps, so it is taken for the whole window at once.
        by_cand = (1 - z) * (1 - cand * cand)
        by_z = (held - cand) * z * (1 - z)
        by_r = gn * r * (1 - r)
        d_x = np.empty((n_all, 3 * HIDDEN), np.float32)
        d_g = np.empty((n_all, 3 * HIDDEN), np.float32)
        back = np.zeros((0, HIDDEN), np.float32)
        u_t = model["u"].T
        for a, b in zip([0, *ends[:-1].tolist()][::-1], ends.tolist()[::-1], strict=True):
            d_h = d_state[a:b]
            d_h[: len(back)] += back
            d_cand, g = d_x[a:b, 2 * HIDDEN :], d_g[a:b]
            np.multiply(d_h, by_cand[a:b], out=d_cand)
            np.multiply(d_h, by_z[a:b], out=g[:, :HIDDEN])
            np.multiply(d_cand, by_r[a:b], out=g[:, HIDDEN : 2 * HIDDEN])
            np.multiply(d_cand, r[a:b], out=g[:, 2 * HIDDEN :])
            back = g @ u_t
            back += d_h * z[a:b]
            back *= carry[a:b]
        d_x[:, : 2 * HIDDEN] = d_g[:, : 2 * HIDDEN]
        d_u = held.T @ d_g
        size = np.sqrt(float((d_u * d_u).sum()))
        move("u", d_u * np.float32(min(1.0, CLIP / (size + 1e-9))))
        move("uc", states.T @ d_class)
        move("bc", d_class.sum(0))
        present = [c for c, _, _ in spans]
        move("uw", d_w, present)
        move("bw", d_b, present)
        rows = inputs % len(model["x"])
        order = np.argsort(rows.astype(np.uint16) if len(model["x"]) <= 65536 else rows, kind="stable")
        rows = rows[order]
        firsts = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
        move("x", np.add.reduceat(d_x[order], firsts), rows[firsts])
    return learned, behind
