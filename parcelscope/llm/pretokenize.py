"""Pre-tokenisation without regular expressions: boundaries from code-point classes and a scan of transition functions.

The split pattern of the public byte-level vocabularies is run as a small automaton. Every code point gets a class (with the
little look-ahead the pattern needs); a class is a function from states to states. Composition of such functions is
associative and closed over a small set, so a prefix scan over one byte per code point gives the state everywhere, and a
table of (state, class) says where a token begins.
"""

from __future__ import annotations

import re
import unicodedata
from functools import cache

import numpy as np
import regex

#: Classes of code points; the last four depend on what follows.
LETTER, NUMBER, OTHER, SPACE, BLANK, SEPARATOR = 0, 1, 2, 3, 4, 8
SHORT, LONG = 3, 4  # an apostrophe that may open a contraction of one or two more letters
SPACE_LAST, BLANK_LAST, BLANK_INSIDE = 5, 6, 7  # white space before a visible character, or before more white space or the end
CLASSES = 9
#: States: nothing open, in a run of letters, numbers or others, after a joining space, in white space, in a contraction.
START, LETTERS, NUMBERS, OTHERS, JOINING, BLANKS, LAST_OF, TWO_OF = range(8)
STATES = 8
#: White space of the pattern (fixed values: the Unicode property White_Space).
WHITE = (0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
#: Letters and numbers that Unicode 16 added (fixed values: block ranges).
ADDED = ((0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105FF), (0x10D40, 0x10D8F), (0x10EC2, 0x10EC4),
         (0x11380, 0x113FF), (0x116D0, 0x116FF), (0x11BC0, 0x11BFF), (0x13460, 0x143FF), (0x16100, 0x1613F), (0x16D40, 0x16D7F),
         (0x1CC00, 0x1CCFF), (0x1E5D0, 0x1E5FF))
#: The class of a code point by 2 * its own class + whether a visible one follows.
FOLLOWED = np.array([LETTER, LETTER, NUMBER, NUMBER, OTHER, OTHER, BLANK_INSIDE, SPACE_LAST, BLANK_INSIDE, BLANK_LAST,
                     0, 0, 0, 0, 0, 0, SEPARATOR, SEPARATOR], np.uint8)
SCAN_WIDTH = 512
SEGMENT = 1 << 20


@cache
def code_point_classes() -> np.ndarray:
    """The class of every code point by Unicode 16: what the interpreter's older tables hold, and the blocks added since."""
    added = {c for a, b in ADDED for c in range(a, b + 1)}
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (unicodedata.category(chr(c)) != "Cn" or c in added))
    classes = np.full(0x110000, OTHER, np.uint8)
    for kind, name in ((LETTER, "L"), (NUMBER, "N")):
        members = "".join(regex.findall(rf"\p{{{name}}}+", every))
        classes[np.frombuffer(members.encode("utf-32-le"), np.uint32)] = kind
    classes[list(WHITE)] = BLANK
    classes[0x20] = SPACE
    return classes


def _step(state: int, kind: int) -> tuple[int, bool]:
    """The next state, and whether a token begins at this code point."""
    if kind == SEPARATOR:
        return START, True
    if kind == LETTER and state in (TWO_OF, LAST_OF):
        return (LAST_OF if state == TWO_OF else START), False
    if kind in (LETTER, NUMBER, OTHER):
        own = {LETTER: LETTERS, NUMBER: NUMBERS, OTHER: OTHERS}[kind]
        return own, state not in (own, JOINING)
    if kind in (SHORT, LONG):
        if state in (OTHERS, JOINING):
            return OTHERS, False
        return (LAST_OF if kind == SHORT else TWO_OF), True
    if kind == SPACE_LAST:
        return JOINING, True
    if kind == BLANK_LAST:
        return START, True
    return BLANKS, state != BLANKS


@cache
def machine() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For classes: their function; for two functions: their composition; a function's value; whether a token begins."""
    steps = [[_step(s, k) for s in range(STATES)] for k in range(CLASSES)]
    found: dict[tuple[int, ...], int] = {tuple(range(STATES)): 0}
    generators = [tuple(n for n, _ in row) for row in steps]
    queue = list(found)
    for f in queue:
        for g in generators:
            h = tuple(g[x] for x in f)
            if h not in found:
                found[h] = len(found)
                queue.append(h)
    functions = list(found)
    if len(functions) > 256:
        raise AssertionError(f"{len(functions)} functions do not fit a byte")
    compose = np.array([[found[tuple(g[x] for x in f)] for g in functions] for f in functions], np.uint8)
    begins = np.array([[b for _, b in row] for row in steps], bool).T
    return np.array([found[g] for g in generators], np.uint8), compose, np.array(functions, np.uint8), begins


def states_before(classes: np.ndarray) -> np.ndarray:
    """The automaton's state before every code point: a scan in blocks, over the blocks, and back into them."""
    of_class, compose, values, _ = machine()
    flat, k = compose.ravel(), np.uint16(len(compose))
    n = len(classes)
    rows = -(-n // SCAN_WIDTH)
    grid = np.zeros((rows, SCAN_WIDTH), np.uint8)  # 0 is the identity
    grid.ravel()[:n] = of_class[classes]
    grid = np.ascontiguousarray(grid.T)
    for j in range(1, SCAN_WIDTH):
        grid[j] = flat[grid[j - 1] * k + grid[j]]
    starts, state, table = np.empty(rows, np.uint8), START, values.tolist()
    for r, f in enumerate(grid[-1].tolist()):
        starts[r] = state
        state = table[f][state]
    after = values.ravel()[grid * np.uint16(STATES) + starts].T.ravel()[:n]
    before = np.empty(n, np.uint8)
    before[0], before[1:] = START, after[:-1]
    return before


def classify(points: np.ndarray, separators: np.ndarray) -> np.ndarray:
    base = code_point_classes()[points]
    base[separators] = SEPARATOR
    visible = np.append(base[1:] <= OTHER, False)
    classes = FOLLOWED[base * np.uint8(2) + visible]
    quotes = np.flatnonzero(points == ord("'"))
    quotes = quotes[classes[quotes] == OTHER]
    if len(quotes):
        padded = np.append(points, [0, 0])
        first, second = padded[quotes + 1], padded[quotes + 2]
        short = np.isin(first, [ord(c) for c in "stmd"])
        long = ((np.isin(first, [ord("r"), ord("v")])) & (second == ord("e"))) | ((first == ord("l")) & (second == ord("l")))
        classes[quotes[short]], classes[quotes[long]] = SHORT, LONG
    return classes


def pieces(texts: list[str]) -> list[list[bytes]]:
    """The UTF-8 slices of every text at the boundaries, in order; joined they give the text back."""
    if not texts:
        return []
    joined = "\0".join(texts)
    if not joined:
        return [[] for _ in texts]
    data = joined.encode()
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    ends = np.cumsum([len(t) + 1 for t in texts]) - 1
    classes = classify(points, ends[:-1])
    begins = np.flatnonzero(machine()[3].ravel()[states_before(classes) * np.uint8(CLASSES) + classes])
    if len(data) == len(points):
        at = begins
    else:
        width = 1 + (points >= 0x80).astype(np.uint8) + (points >= 0x800) + (points >= 0x10000)
        at = np.cumsum(width, dtype=np.int64)[begins] - width[begins]
    at = at.tolist()
    slices = [data[i:j] for i, j in zip(at, [*at[1:], len(data)], strict=True)]
    edges = np.searchsorted(begins, ends).tolist()  # of the separators, each of which is a slice of its own
    return [slices[i:j] for i, j in zip([0, *(e + 1 for e in edges[:-1])], edges, strict=True)]


def segments(text: str, limit: int = SEGMENT) -> list[str]:
    """Cuts of a very long text before white space that follows a visible character, where a token begins anyway."""
    if len(text) <= limit:
        return [text]
    out, start = [], 0
    cut = re.compile(r"(?<=[^\s])[ \n]")
    while len(text) - start > limit:
        found = cut.search(text, start + limit)
        if not found:
            break
        out.append(text[start:found.start()])
        start = found.start()
    return [*out, text[start:]]
