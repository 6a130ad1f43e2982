"""How like a query some stretch of a text is, by edits.

The stretch of a text that takes the fewest edits (characters put in, left out or replaced) to become the query is found by dynamic programming
over columns held in bits (Myers' bit vectors): 64 characters of the query are one word, and one step advances all texts of a batch by a character.
"""

from __future__ import annotations

import numpy as np

WORD = 64
LONG = 1 << 15  # longer texts, and texts of few, go one by one


def _fewest(pattern: str, text: str) -> int:
    """The fewest edits between ``pattern`` (not empty) and any stretch of ``text``; bits in one Python integer."""
    m = len(pattern)
    all_, last = (1 << m) - 1, 1 << (m - 1)
    places: dict[str, int] = {}
    for k, c in enumerate(pattern):
        places[c] = places.get(c, 0) | 1 << k
    up, down, edits, best = all_, 0, m, m  # which rows of the column rise and fall
    for c in text:
        same = places.get(c, 0)
        diagonal = (((same & up) + up) ^ up) | same | down
        rise, fall = (down | ~(diagonal | up)) & all_, up & diagonal
        if rise & last:
            edits += 1
        elif fall & last:
            edits -= 1
            best = min(best, edits)
        rise, fall = rise << 1 & all_, fall << 1 & all_
        up, down = (fall | ~(same | down | rise)) & all_, rise & (same | down)
    return best


def fewest_edits(pattern: str, texts: list[str]) -> np.ndarray:
    """_fewest() of every text; patterns of up to 64 characters take all texts at once."""
    m, out = len(pattern), np.zeros(len(texts), np.int64)
    order = sorted(range(len(texts)), key=lambda k: -len(texts[k]))
    sizes = np.array([len(texts[k]) for k in order], np.int64)
    alone = len(order) if m > WORD or len(order) < 8 else int((sizes > LONG).sum())
    for k in order[:alone]:
        out[k] = _fewest(pattern, texts[k])
    order, sizes = order[alone:], sizes[alone:]
    if not order:
        return out
    letters = np.array(sorted(set(map(ord, pattern))), np.uint32)
    places = np.zeros(len(letters) + 1, np.uint64)
    for k, c in enumerate(pattern):
        places[np.searchsorted(letters, ord(c))] |= np.uint64(1 << k)
    flat = np.frombuffer("".join(texts[k] for k in order).encode("utf-32-le", "surrogatepass"), np.uint32)
    at = np.minimum(np.searchsorted(letters, flat), len(letters) - 1)
    same_of = places[np.where(letters[at] == flat, at, len(letters))]
    first = np.cumsum(sizes) - sizes
    all_, last, one = np.uint64((1 << m) - 1), np.uint64(1 << (m - 1)), np.uint64(1)
    n = len(order)
    up, down = np.full(n, all_), np.zeros(n, np.uint64)
    edits, best = np.full(n, m, np.int64), np.full(n, m, np.int64)
    for step in range(int(sizes[0])):
        n = int(np.searchsorted(-sizes, -step, "left"))  # texts that have a character here
        up, down = up[:n], down[:n]
        same = same_of[first[:n] + step]
        diagonal = (((same & up) + up) ^ up) | same | down
        rise, fall = down | ~(diagonal | up), up & diagonal
        edits = edits[:n] + ((rise & last) != 0) - ((fall & last) != 0)
        np.minimum(best[:n], edits, out=best[:n])
        rise, fall = rise << one, fall << one
        up, down = fall | ~(same | down | rise), rise & (same | down)
    out[order] = best
    return out


def likeness(query: str, texts: list[str]) -> np.ndarray:
    """1 - edits / length of the query, for the stretch of each text that is likest; a text shorter than the query is looked for in it instead. 0 where either is empty."""
    out = np.zeros(len(texts))
    if not query:
        return out
    whole = [k for k, t in enumerate(texts) if len(t) >= len(query)]
    out[whole] = 1 - fewest_edits(query, [texts[k] for k in whole]) / len(query)
    for k, t in enumerate(texts):
        if 0 < len(t) < len(query):
            out[k] = 1 - _fewest(t, query) / len(t)
    return out
