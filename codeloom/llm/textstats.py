"""Per-text measurements shared by the quality rules and the quality classifier."""

from __future__ import annotations

import re
from collections import Counter
from itertools import islice
from operator import eq

import numpy as np

from .common import SPACES

#: Symbols counted by the base rules. Fixed values.
SYMBOLS = "#*$%&|<>"
SYMBOL_WORD = re.compile(r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D#*$%&|<>]*[#*$%&|<>][^\x20\x09-\x0D]*")


def repeated_words(words: list[bytes], n: int = 3) -> int:
    """Words inside n-word windows that the text holds at least twice (first ones included)."""
    m = len(words) - n + 1
    if m < 2:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    key = ids[:m]
    for i in range(1, n):
        if (int(key.max()) + 1) * len(seen) >= 2**62:
            key = np.unique(key, return_inverse=True)[1]
        key = key * len(seen) + ids[i : m + i]
    s = np.sort(key)
    twice = s[1:][s[1:] == s[:-1]]
    if not len(twice):
        return 0
    hit = np.isin(key, twice)
    covered = np.zeros(len(words), bool)
    for i in range(n):
        covered[i : m + i] |= hit
    return int(covered.sum())


def top_and_run(words: list[bytes]) -> tuple[int, int]:
    """How often the commonest word comes, and the most times in a row that one word comes."""
    if not words:
        return 0, 0
    longest = run = 1
    for same in map(eq, words, islice(words, 1, None)):
        if same:
            run += 1
            if run > longest:
                longest = run
        else:
            run = 1
    return max(Counter(words).values()), longest


def measure(text: str) -> dict:
    """Counts over one whole text; an empty text gives zeros."""
    words = text.encode().split()
    n, chars = len(words), len(text) - sum(map(text.count, SPACES))
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    distinct = set(words)
    top, longest = top_and_run(words)
    raw = text.encode()
    letters = np.frombuffer(raw, np.uint8) if raw else np.zeros(1, np.uint8)
    table = np.bincount(letters, minlength=256)
    up, low = int(table[65:91].sum()), int(table[97:123].sum())
    return {
        "n_words": n,
        "word_chars": chars,
        "n_symbols": sum(map(text.count, SYMBOLS)),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": repeated_words(words),
        "n_lines": len(lines),
        "n_distinct": len(distinct),
        "n_top": top,
        "n_run": longest,
        "n_upper": up,
        "n_lower": low,
        "n_digits": int(table[48:58].sum()),
        "n_marks": int(table[33] + table[63]),
        "n_stops": int(table[46] + table[44]),
        "n_symbol_words": len(SYMBOL_WORD.findall(text)) if any(x in text for x in SYMBOLS) else 0,
        "n_short": int(sum(1 for w in words if len(w) <= 3)),
    }


FIELDS = list(measure(""))
