"""Pre-tokenisation without regular expressions.

Each code point gets a class; the class and its neighbours give a symbol; each symbol is a function from the states
of a small automaton to states. Functions compose associatively, so blocks of the text are scanned side by side: the
running products of every block come from one table of products, a short scan over the blocks carries the state in,
and a token starts where (state before, symbol) says so. The language is that of the pattern of the byte-level
vocabularies: contractions, then runs of letters, numbers or other signs with at most one space before, then white
space, of which the last one before a word is left to the word.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

OTHER, LETTER, NUMBER, BLANK, SPACE = range(5)
# Symbols: white space that white space or the end follows; a last space; another last white space; letter; number; other; an apostrophe that begins a contraction of two or three signs.
S_MID, S_SPACE, S_LAST, S_L, S_N, S_O, S_Q2, S_Q3 = range(8)
# States: nothing open; white space; one space; letters; numbers; others; one or two more letters of a contraction.
CLOSED, WS, LEAD, LET, NUM, OTH, ONE, TWO = range(8)
WIDTH = 128


def step(state: int, symbol: int) -> tuple[int, bool]:
    """Next state, and whether a token starts here."""
    if symbol == S_MID:
        return WS, state != WS
    if symbol == S_SPACE:
        return LEAD, True
    if symbol == S_LAST:
        return CLOSED, True
    if symbol == S_L:
        if state in (ONE, TWO):
            return (CLOSED if state == ONE else ONE), False
        return LET, state not in (LET, LEAD)
    if symbol == S_N:
        return NUM, state not in (NUM, LEAD)
    if state in (OTH, LEAD):
        return OTH, False
    return {S_O: OTH, S_Q2: ONE, S_Q3: TWO}[symbol], True


@lru_cache(1)
def monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Table of products, values of each function, functions of the 8 symbols then of the 8 that first reset, and starts[state, symbol]."""
    funcs = [tuple(step(s, y)[0] for s in range(8)) for y in range(8)]
    funcs += [tuple([step(CLOSED, y)[0]] * 8) for y in range(8)]
    known: dict[tuple, int] = {tuple(range(8)): 0}
    todo = [tuple(range(8))]
    while todo:
        f = todo.pop()
        for g in funcs:
            fg = tuple(g[f[s]] for s in range(8))
            if fg not in known:
                known[fg] = len(known)
                todo.append(fg)
    assert len(known) < 256
    values = np.array(list(known), np.uint8)
    product = np.zeros((len(known), len(known)), np.uint8)
    for f, i in known.items():
        for g, j in known.items():
            product[i, j] = known[tuple(g[f[s]] for s in range(8))]
    starts = np.array([[step(s, y)[1] for y in range(8)] for s in range(8)])
    return product.ravel(), values, np.array([known[f] for f in funcs], np.uint8), starts


def scan(elements: np.ndarray) -> np.ndarray:
    """State before each element, CLOSED before the first: two-level associative scan."""
    product, values, _, _ = monoid()
    size = len(values)
    n = len(elements)
    if n <= 4 * WIDTH:
        out, s = np.empty(n, np.uint8), CLOSED
        for i, e in enumerate(elements.tolist()):
            out[i] = s
            s = values[e, s]
        return out
    rows = -(-n // WIDTH)
    grid = np.zeros(rows * WIDTH, np.uint8)
    grid[:n] = elements
    grid = np.ascontiguousarray(grid.reshape(rows, WIDTH).T)  # one column a block
    run = np.empty((WIDTH + 1, rows), np.uint8)
    run[0] = 0
    for k in range(WIDTH):
        run[k + 1] = product[run[k].astype(np.int32) * size + grid[k]]
    carry = scan(run[WIDTH])  # the state before each block, by the same scan over the products of blocks
    before = values.ravel()[run[:WIDTH].astype(np.int32) * 8 + carry]
    return np.ascontiguousarray(before.T).ravel()[:n]


def class_table(is_letter: np.ndarray, is_number: np.ndarray, is_blank: np.ndarray) -> np.ndarray:
    table = np.zeros(0x110000, np.uint8)
    table[is_letter], table[is_number], table[is_blank] = LETTER, NUMBER, BLANK
    table[0x20] = SPACE
    return table


def boundaries(points: np.ndarray, first: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Places (code points) at which a pre-token starts. points: code points of all rows; first: where each row starts, one entry more than rows."""
    n = len(points)
    if n == 0:
        return np.zeros(0, np.int64)
    _, _, element, starts = monoid()
    cls = table[points]
    begin = np.zeros(n, bool)
    begin[first[:-1][np.diff(first) > 0]] = True
    blank = cls >= BLANK
    word_next = np.zeros(n, bool)  # a sign of the same row that is not white space follows
    word_next[:-1] = ~blank[1:] & ~begin[1:]
    symbol = np.array([S_O, S_L, S_N, S_MID, S_MID], np.uint8)[cls]
    symbol[blank & word_next] = S_LAST
    symbol[(cls == SPACE) & word_next] = S_SPACE
    quote = np.flatnonzero(points == 0x27)
    if len(quote):
        row_end = first[np.searchsorted(first, quote, "right")]
        at = lambda i: np.where(quote + i < row_end, points[np.minimum(quote + i, n - 1)], 0)
        a, b = at(1), at(2)
        symbol[quote[np.isin(a, [0x73, 0x74, 0x6D, 0x64])]] = S_Q2  # s t m d
        symbol[quote[((a == 0x72) & (b == 0x65)) | ((a == 0x76) & (b == 0x65)) | ((a == 0x6C) & (b == 0x6C))]] = S_Q3  # re ve ll
    state = scan(element[symbol + np.uint8(8) * begin])
    return np.flatnonzero(starts[state, symbol] | begin)


def pretokens(data: np.ndarray, off: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets at which pre-tokens start (and the end, last), and the first pre-token of each row (one entry more than rows)."""
    lead = (data & 0xC0) != 0x80  # the first byte of each code point
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    if len(points) == len(data):
        place, first = None, off
    else:
        place = np.flatnonzero(lead)
        first = np.searchsorted(place, off)
    cut = boundaries(points, first, table)
    cut = cut if place is None else place[cut]
    return np.append(cut, len(data)), np.searchsorted(cut, off)


PLAIN = np.zeros(256, bool)
PLAIN[[*b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"]] = True


def sections(data: np.ndarray, limit: int) -> Iterator[np.ndarray]:
    """A text in sections of about `limit` bytes that can be cut into pre-tokens one by one: each ends before a space
    between two plain letters or digits, where a pre-token starts whatever came before. Without such a place it is whole."""
    place = np.flatnonzero((data[1:-1] == 0x20) & PLAIN[data[:-2]] & PLAIN[data[2:]]) + 1
    begin = 0
    while begin < len(data):
        k = np.searchsorted(place, begin + limit)
        end = int(place[k]) if k < len(place) else len(data)
        yield data[begin:end]
        begin = end
