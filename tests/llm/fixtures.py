"""A small corpus with the odd cases every operator must handle, and plain helpers for brute-force twins."""

from __future__ import annotations

import random
import re

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, word string, line string, part int"


def sentences(rng: random.Random, n: int, vocabulary: int = 400) -> str:
    return " ".join(f"w{rng.randrange(vocabulary)}" + rng.choice(["", "", "", ".", ",\n"]) for _ in range(n))


def corpus(seed: int = 3) -> list[tuple]:
    rng = random.Random(seed)
    texts: list = [sentences(rng, rng.randrange(20, 160)) for _ in range(40)]
    texts += [texts[0], texts[0], texts[1].upper()]  # exact copies
    for base in (2, 2, 2, 3, 4):  # near copies
        words = texts[base].split(" ")
        words[rng.randrange(len(words))] = "changed"
        texts.append(" ".join(words))
    texts += [None, "", "   \n\t ", "one two", "One  two", "ñandú é.\n\nñandú é.", "12 34 !!", sentences(rng, 6000)]
    rows = [(i, t, rng.choice(["en", "fr", None]), "s", 0, "x", "y", 7) for i, t in enumerate(texts)]
    return [*rows, rows[5], (None, "no id here", None, None, None, None, None, None)]


def words(text: str | None) -> list[str]:
    lower = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return re.findall(r"[^\x20\x09-\x0D]+", lower)


class Union:
    def __init__(self):
        self.up: dict = {}

    def find(self, x):
        while self.up.setdefault(x, x) != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)
