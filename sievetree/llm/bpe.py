"""Byte-level BPE: pre-tokenisation with code-point class arrays and an associative scan, cached pair merging, decoding.

Pre-tokenisation of `'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+` without a regex engine:

1. every code point gets a class from a table (letters by what a contraction can hold, numbers, blank, other space, apostrophe, rest);
2. a small automaton reads classes; a class is a function from state to state. The finite set of functions closed under
   composition is found once, with its composition table, so a function is one byte and composing two is one look-up. That is
   associative, so the state after every code point comes from a blocked prefix scan over whole arrays;
3. a piece starts where the states before and at a code point say so, with one code point of look-ahead: white space gives its last
   character to the piece behind it, and `'r`, `'v`, `'l` are contractions only if the next letter completes them.

Texts of a batch are scanned as one array; a reset class between them sends any state to the start.
Pieces are sliced from the text and looked up in a bounded cache of token tuples; a piece not yet there is merged pair by pair,
lowest rank first, with a heap, so that a piece of n bytes takes n log n steps.
"""

from __future__ import annotations

import base64
import heapq
from functools import lru_cache
from itertools import chain

import numpy as np
import regex

#: Unicode White_Space.
WHITE_SPACE = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
#: Classes of code points.
BLANK, SPACE, LETTER, NUMBER, OTHER, QUOTE, ONE, R, V, E, LL, RESET = range(12)
#: States: the automaton has just read ...
START, AT_BLANK, IN_LETTERS, IN_NUMBERS, IN_OTHER, AT_QUOTE, SHORT, AT_R, AT_V, AT_L = range(10)
_LETTERS = (LETTER, ONE, R, V, E, LL)
_CACHE_ENTRIES, _CACHE_PIECE = 200_000, 48


@lru_cache(1)
def class_table() -> np.ndarray:
    """Class of each code point. Letters and numbers are Unicode's general categories L and N."""
    every = "".join(map(chr, chain(range(0xD800), range(0xE000, 0x110000))))
    spans = [(regex.compile(r"\p{L}+"), LETTER), (regex.compile(r"\p{N}+"), NUMBER)]
    table = np.full(0x110000, OTHER, np.uint8)
    for pattern, cls in spans:
        for m in pattern.finditer(every):
            for at, end in [(m.start(), min(m.end(), 0xD800)), (max(m.start(), 0xD800), m.end())]:
                shift = 0x800 if at >= 0xD800 else 0
                table[at + shift : max(at, end) + shift] = cls
    table[list(WHITE_SPACE)] = SPACE
    table[0x20], table[0x27] = BLANK, QUOTE
    for chars, cls in (("stmd", ONE), ("r", R), ("v", V), ("e", E), ("l", LL)):
        table[[ord(c) for c in chars]] = cls
    return table


def _next_state(state: int, cls: int) -> int:
    if cls in (SPACE, RESET):
        return START
    if cls == BLANK:
        return AT_BLANK
    if cls == NUMBER:
        return IN_NUMBERS
    if cls == OTHER:
        return IN_OTHER
    if cls == QUOTE:
        return IN_OTHER if state in (AT_BLANK, IN_OTHER, AT_QUOTE) else AT_QUOTE
    if state == AT_QUOTE and cls in (ONE, R, V, LL):
        return {ONE: SHORT, R: AT_R, V: AT_V, LL: AT_L}[cls]
    if (state in (AT_R, AT_V) and cls == E) or (state == AT_L and cls == LL):
        return SHORT
    return IN_LETTERS


@lru_cache(1)
def monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of each class's function, composition table: first then second, functions by number)."""
    identity = tuple(range(10))
    basic = [tuple(_next_state(s, c) for s in range(10)) for c in range(12)]
    seen = {identity: 0}
    queue = [identity]
    while queue:
        f = queue.pop()
        for g in basic:
            h = tuple(g[x] for x in f)
            if h not in seen:
                seen[h] = len(seen)
                queue.append(h)
    functions = list(seen)
    table = np.array([[seen[tuple(g[x] for x in f)] for g in functions] for f in functions], np.uint8)
    assert len(functions) <= 256
    return np.array([seen[g] for g in basic], np.uint8), table, np.array(functions, np.uint8)


def scan(elements: np.ndarray, table: np.ndarray, width: int = 64) -> np.ndarray:
    """Inclusive prefix compositions: blocks side by side, then the blocks' totals by the same scan, then both joined."""
    n = len(elements)
    if n <= width:
        out = elements.copy()
        for i in range(1, n):
            out[i] = table[out[i - 1], out[i]]
        return out
    rows = -(-n // width)
    grid = np.zeros((width, rows), np.uint8)
    padded = np.zeros(rows * width, np.uint8)
    padded[:n] = elements
    grid[:] = padded.reshape(rows, width).T
    flat, size = table.ravel(), np.intp(len(table))
    for i in range(1, width):
        grid[i] = flat[grid[i - 1] * size + grid[i]]
    before = np.zeros(rows, np.uint8)
    before[1:] = scan(grid[-1], table, width)[:-1]
    joined = flat[before[None, :] * size + grid]
    return joined.T.reshape(-1)[:n]


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def starts(points: np.ndarray, resets: np.ndarray) -> np.ndarray:
    """Offsets where pieces start. At each offset in resets stands a separator that belongs to no text; it starts a piece of its own."""
    cls = class_table()[points]
    cls[resets] = RESET
    of_class, table, functions = monoid()
    state = functions[:, START][scan(of_class[cls], table)]
    n = len(cls)
    before = np.empty(n, np.uint8)
    before[:1], before[1:] = START, state[:-1]
    last = np.full(n, RESET, np.uint8)
    last[:-1] = cls[1:]
    gap = cls <= SPACE
    gap_before = np.empty(n, bool)
    gap_before[:1], gap_before[1:] = False, gap[:-1]
    after = np.empty(n, np.uint8)
    after[-1:], after[:-1] = START, state[1:]
    ends_gap = gap & ~((last <= SPACE) | (last == RESET))
    letters = (cls >= LETTER) & (cls != NUMBER) & (cls != OTHER) & (cls != QUOTE) & (cls != RESET)
    kind = np.array([0, 0, 1, 2, 3, 3, 1, 1, 1, 1, 1, 4], np.uint8)[cls]
    kind_before = np.empty(n, np.uint8)
    kind_before[:1], kind_before[1:] = 4, kind[:-1]
    new = kind != kind_before
    # White space: the first of a run, and the last of a longer run if something follows in the text.
    out = np.where(gap, new | ends_gap, new & ~(before == AT_BLANK))
    # Letters: none starts inside a contraction, one starts behind it.
    done = state == SHORT
    pending = (state == AT_R) | (state == AT_V) | (state == AT_L)
    completes = pending & (after == SHORT)
    out[letters & (done | completes)] = False
    out[letters & (before == SHORT)] = True
    out[cls == RESET] = True
    follows = np.zeros(n, bool)
    follows[1:] = cls[:-1] == RESET
    out |= follows
    out[:1] = True
    return np.flatnonzero(out)


def pieces(texts: list[str]) -> list[list[bytes]]:
    """The pieces of each text as UTF-8, in order."""
    flat, where = _flat_pieces(texts)
    return [flat[a:b] for a, b in zip([0, *(w + 1 for w in where[:-1])], where, strict=True)] if texts else []


def _flat_pieces(texts: list[str]) -> tuple[list[bytes], list[int]]:
    """All pieces of a batch, with a separator behind each text, and the places of the separators."""
    joined = "\n".join(texts) + "\n"
    resets = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1) - 1
    points = _points(joined)
    at = starts(points, resets)
    where = np.searchsorted(at, resets).tolist()
    raw = np.frombuffer(joined.encode("utf-8", "surrogatepass"), np.uint8)
    if len(raw) != len(points):
        width = 1 + (points >= 0x80).view(np.int8) + (points >= 0x800).view(np.int8) + (points >= 0x10000).view(np.int8)
        ends = np.cumsum(width, dtype=np.int64)
        at = ends[at] - width[at]
    # 0xFF is in no UTF-8 text, so it can mark the cuts.
    marked = np.full(len(raw) + len(at) - 1, 0xFF, np.uint8)
    body = np.ones(len(marked), bool)
    body[at[1:] + np.arange(len(at) - 1)] = False
    marked[body] = raw
    return marked.tobytes().split(b"\xff"), where


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """Token ids of a piece: the adjacent pair of lowest rank, leftmost first, is merged until no pair has a rank."""
    if piece in ranks:
        return (ranks[piece],)
    n = len(piece)
    end = list(range(1, n + 1))  # of the part that starts here; 0 once merged into the one before
    prev = list(range(-1, n - 1))
    get = ranks.get
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, to = heapq.heappop(heap)
        mid = end[i]
        if not mid or mid >= n or end[mid] != to:
            continue
        end[i], end[mid] = to, 0
        if to < n:
            prev[to] = i
            if (r := get(piece[i : end[to]])) is not None:
                heapq.heappush(heap, (r, i, end[to]))
        if (p := prev[i]) >= 0 and (r := get(piece[p:to])) is not None:
            heapq.heappush(heap, (r, p, to))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return tuple(out)


class Pairs:
    """Which two tokens merge into which: every split of every token into two tokens, in a table that is searched by arrays."""

    NONE = np.int32(2**31 - 1)

    def __init__(self, ranks: dict[bytes, int]):
        get = ranks.get
        rows = [(x << 32 | y, r) for token, r in ranks.items() for i in range(1, len(token)) if (x := get(token[:i])) is not None and (y := get(token[i:])) is not None]
        keys, values = np.array([k for k, _ in rows], np.int64), np.array([v for _, v in rows], np.int32)
        self.bits = max(10, int(len(rows)).bit_length() + 1)
        slot = self._slot(keys)
        order = np.argsort(slot, kind="stable")
        self.keys, self.values = np.r_[keys[order], -1], np.r_[values[order], self.NONE]
        self.first = np.searchsorted(slot[order], np.arange((1 << self.bits) + 1)).astype(np.int32)
        self.longest = int(np.diff(self.first).max(initial=0))
        self.of_byte = np.array([get(bytes([i]), -1) for i in range(256)], np.int64)
        self.of_bytes = self.find(np.repeat(self.of_byte, 256), np.tile(self.of_byte, 256))

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.int64) << 32 | right
        slot = self._slot(keys)
        at, stop = self.first[slot], self.first[slot + np.uint64(1)]
        out = np.full(len(keys), self.NONE, np.int32)
        todo = np.flatnonzero(at < stop)
        for step in range(self.longest):
            here = at[todo] + step
            hit = self.keys[here] == keys[todo]
            out[todo[hit]] = self.values[here[hit]]
            todo = todo[~hit & (here + 1 < stop[todo])]
            if not len(todo):
                break
        return out

    def merge_many(self, some: list[bytes], width: int) -> list[bytes]:
        """merge() of many pieces of 2 to `width` bytes side by side: each round merges the lowest pair, leftmost first, of every piece."""
        n = len(some)
        lengths = np.fromiter(map(len, some), np.int64, n)
        raw = np.frombuffer(b"".join(x.ljust(width + 1, b"\0") for x in some), np.uint8).reshape(n, width + 1)
        columns = np.arange(width + 1)
        tokens = self.of_byte[raw].astype(np.int32)
        ranks = self.of_bytes[raw[:, :-1].astype(np.int64) * 256 + raw[:, 1:]]
        ranks[columns[None, :-1] + 1 >= lengths[:, None]] = self.NONE
        done_tokens, done_lengths = np.zeros((n, width + 1), np.int32), np.zeros(n, np.int64)
        rows = np.arange(n)
        while len(rows):
            j = ranks.argmin(axis=1)
            i = np.arange(len(rows))
            new = ranks[i, j]
            over = new == self.NONE
            if over.any():
                done_tokens[rows[over]], done_lengths[rows[over]] = tokens[over], lengths[over]
                keep = ~over
                rows, tokens, ranks, lengths, j, new = rows[keep], tokens[keep], ranks[keep], lengths[keep], j[keep], new[keep]
                i = np.arange(len(rows))
                if not len(rows):
                    break
            behind = columns[None, :-1] > j[:, None]
            tokens[:, :-1] = np.where(behind, tokens[:, 1:], tokens[:, :-1])
            ranks[:, :-1] = np.where(behind[:, :-1], ranks[:, 1:], ranks[:, :-1])
            ranks[:, -1] = self.NONE
            tokens[i, j] = new
            lengths = lengths - 1
            ranks[i, j] = self.NONE
            right = np.flatnonzero(j + 1 < lengths)
            ranks[right, j[right]] = self.find(new[right], tokens[right, j[right] + 1])
            left = np.flatnonzero(j > 0)
            ranks[left, j[left] - 1] = self.find(tokens[left, j[left] - 1], new[left])
        row, flat = 4 * (width + 1), done_tokens.astype("<u4").tobytes()
        begins = np.arange(n) * row
        return list(map(flat.__getitem__, map(slice, begins.tolist(), (begins + 4 * done_lengths).tolist())))


class Encoder:
    """Encodes and decodes with the ranks of a file. Pieces seen before come from the cache, which is emptied at its bound; pieces of over _CACHE_PIECE bytes are merged each time."""

    def __init__(self, path: str, entries: int = _CACHE_ENTRIES):
        self.ranks, self.entries = load_ranks(path), entries
        self.pairs = Pairs(self.ranks)
        self.cache: dict[bytes, bytes] = {}  # a piece's ids, little-endian unsigned 32-bit
        self.bytes_of = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.bytes_of[rank] = token

    def _one(self, piece: bytes) -> bytes:
        return np.array(merge(piece, self.ranks), "<u4").tobytes()

    def _learn(self, new: list[bytes]) -> dict[bytes, bytes]:
        """Ids of pieces that the cache lacks, merged with pieces of like length; all but the longest join the cache."""
        new = sorted(set(new), key=len)
        cuts = np.searchsorted(np.fromiter(map(len, new), np.int64, len(new)), [1, 6, 9, 12, 16, 24, _CACHE_PIECE], "right").tolist()
        found = {x: self._one(x) for x in new[: cuts[0]]}
        for width, low, high in zip((6, 9, 12, 16, 24, _CACHE_PIECE), cuts, cuts[1:], strict=False):
            for at in range(low, high, 20_000):
                part = new[at : min(high, at + 20_000)]
                found.update(zip(part, self.pairs.merge_many(part, width), strict=True))
        if len(self.cache) + len(found) > self.entries:
            self.cache.clear()
        self.cache.update(found)
        found.update((x, self._one(x)) for x in new[cuts[-1] :])
        return found

    def _ids(self, texts: list[str]) -> tuple[list[bytes], list[int]]:
        flat, where = _flat_pieces(texts)
        got = list(map(self.cache.get, flat))
        missing = [i for i, x in enumerate(got) if x is None]
        if missing:
            found = self._learn([flat[i] for i in missing])
            for i in missing:
                got[i] = found[flat[i]]
        return got, where

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, unsigned 32-bit."""
        if not texts:
            return []
        got, where = self._ids(texts)
        begins = [0, *(w + 1 for w in where[:-1])]  # the separators are left out
        return [np.frombuffer(b"".join(got[a:b]), "<u4") for a, b in zip(begins, where, strict=True)]

    def count(self, texts: list[str]) -> list[int]:
        return [len(x) for x in self.encode(texts)]

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))

    def offsets(self, ids: np.ndarray) -> np.ndarray:
        """Byte offset where each token starts in the decoded text."""
        lengths = np.fromiter((len(self.bytes_of[i]) for i in ids.tolist()), np.int64, len(ids))
        return np.cumsum(lengths) - lengths


@lru_cache(2)
def encoder(path: str) -> Encoder:
    """One per worker process."""
    return Encoder(path)


def groups(texts: list[str], chars: int = 1_000_000):
    """Runs of texts of about so many code points together, which bounds the arrays of one scan; a longer text is a run of its own."""
    run, size = [], 0
    for t in texts:
        if run and size + len(t) > chars:
            yield run
            run, size = [], 0
        run.append(t)
        size += len(t)
    if run:
        yield run
