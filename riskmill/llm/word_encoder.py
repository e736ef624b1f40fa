"""Token ids of whole texts by a word-level BPE tokenizer, each distinct word encoded once.

The tokenizer normalises (NFC, lower case, white space to blanks) and splits at white space and
between letters and signs, and no merge crosses such a split. So a text's ids are the ids of its
white-space words one after the other, and a word may also be cut between an ASCII letter and an
ASCII sign other than the apostrophe (which belongs to contractions). Texts are a Zipf draw of
words, so the library encodes the distinct words of a chunk that are not in the task's memo, and
the rest is array work. A text that contains the opening of a special token is cut at white space
only and not lower-cased first, so special strings are found as the library finds them.
"""

from __future__ import annotations

import functools

import numpy as np

from riskmill.llm.textbytes import LOWER, SPACE, hash_spans

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_SIGN = np.zeros(256, bool)
_SIGN[33:127] = True
_SIGN[48:58] = _SIGN[65:91] = _SIGN[97:123] = False
_SIGN[39] = False
MEMO = 400_000


class WordEncoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.closing = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closing[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.forget()

    def forget(self) -> None:
        self.memo: dict[int, int] = {}
        self.first = np.zeros(1 << 16, np.int64)
        self.size = np.zeros(1 << 16, np.int32)
        self.pool = np.zeros(1 << 18, np.uint32)
        self.used = 0

    def encode(self, docs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in order, and the number of ids of each text."""
        special = [b"<|" in d for d in docs]
        if not any(special):
            return self._encode(docs, True)
        ids, counts, i = [], [], 0
        while i < len(docs):
            j = i
            while j < len(docs) and special[j] == special[i]:
                j += 1
            part, count = self._encode(docs[i:j], not special[i])
            ids.append(part)
            counts.append(count)
            i = j
        return np.concatenate(ids), np.concatenate(counts)

    def _encode(self, docs: list[bytes], plain: bool) -> tuple[np.ndarray, np.ndarray]:
        buf = np.frombuffer(b" ".join(docs), np.uint8)
        if plain:
            buf = LOWER[buf]
        inside = ~SPACE[buf]
        before = np.concatenate([[False], inside[:-1]]) if len(inside) else inside
        begin = inside & ~before
        if plain and len(buf):
            begin[1:] |= _LETTER[buf[:-1]] & _SIGN[buf[1:]]
        stop = np.concatenate([begin[1:] | ~inside[1:], [True]]) & inside if len(inside) else inside
        starts, ends = np.flatnonzero(begin), np.flatnonzero(stop) + 1
        bounds = np.concatenate([[0], np.cumsum(np.fromiter((len(d) + 1 for d in docs), np.int64, len(docs)))])
        at = np.searchsorted(starts, bounds)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(docs), np.int64)
        hashes = hash_spans(buf, starts, ends) ^ np.uint64(0 if plain else 0x5555555555555555)
        distinct, where, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        rows = self._rows(distinct, buf, starts[where], ends[where])[inverse]
        size = self.size[rows].astype(np.int64)
        total = np.concatenate([[0], np.cumsum(size)])
        place = np.repeat(self.first[rows] - total[:-1], size) + np.arange(total[-1])
        return self.pool[place], np.diff(total[at])

    def _rows(self, hashes: np.ndarray, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if len(self.memo) > MEMO:
            self.forget()
        keys = hashes.tolist()
        rows = np.fromiter(map(self.memo.get, keys, [-1] * len(keys)), np.int64, len(keys))
        new = np.flatnonzero(rows < 0)
        raw = buf.tobytes() if len(new) else b""
        for lo in range(0, len(new), 20_000):
            part = new[lo : lo + 20_000]
            spans = zip(starts[part].tolist(), ends[part].tolist())
            strings = [raw[i:j].decode("utf-8", "replace") for i, j in spans]
            ids, sizes = self._words(strings)
            at = len(self.memo) + np.arange(len(part))
            self._keep(ids, sizes, at)
            rows[part] = at
            self.memo.update(zip([keys[i] for i in part.tolist()], at.tolist()))
        return rows

    def _words(self, strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words one after the other, and the number for each word.

        Runs of letters are encoded as one text in one call: each ends with one token that closes a
        word, and the count of those proves the split. Other words are encoded one by one.
        """
        letters = [i for i, s in enumerate(strings) if s.isalpha()]
        text = " ".join([strings[i] for i in letters])
        ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
        ends = np.flatnonzero(self.closing[ids]) + 1
        if len(ends) != len(letters):
            letters, ids, ends = [], ids[:0], ends[:0]
        sizes = np.zeros(len(strings), np.int64)
        sizes[letters] = np.diff(ends, prepend=0)
        rest = np.flatnonzero(sizes == 0).tolist()
        single = [x.ids for x in self.tokenizer.encode_batch_fast([strings[i] for i in rest], add_special_tokens=False)]
        sizes[rest] = [len(x) for x in single]
        out = np.empty(sizes.sum(), np.uint32)
        of_letters = np.zeros(len(strings), bool)
        of_letters[letters] = True
        mask = np.repeat(of_letters, sizes)
        out[mask] = ids
        out[~mask] = np.array([i for x in single for i in x], np.uint32)
        return out, sizes

    def _keep(self, ids: np.ndarray, sizes: np.ndarray, rows: np.ndarray) -> None:
        while rows[-1] >= len(self.first):
            self.first, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.first, self.size))
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.used : self.used + len(ids)] = ids
        self.first[rows], self.size[rows] = self.used + np.cumsum(sizes) - sizes, sizes
        self.used += len(ids)


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    """One encoder for each file and Python worker; its memo lasts over tasks."""
    return WordEncoder(path)
