"""Packing, coded ids and token counts against the libraries themselves."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from riskmill.llm.huffman_ids import CodeBook, canonical, code_lengths, read_ids, write_ids
from riskmill.llm.packing import OpenBins, pack
from riskmill.llm.token_counts import Counter, count_tokens
from riskmill.llm.word_encoder import encoder
from riskmill.session import scratch_path
from tokenizers import Tokenizer

WORD, PIECE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    "don't it's. a<|endoftext|>B.c <|ENDOFTEXT|> x",
    "ΟΔΟΣ.α",
    "",
    " \t ",
    "\x01 a\x01b",
    "é.é x$%&'s 12.3 'S ①",
    "á.b áb ≠ ≠ cd\x85e\x1cf",
    "日本語 текст а.б",
    "Ab!!cd''e 'll'LL",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(WORD)


def expected(library, rows):
    return [(d, library.encode(t or "", add_special_tokens=False).ids + [1]) for d, t, *_ in rows]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_words_encoded_once_equal_the_library(library):
    rng = random.Random(5)
    signs = ["a", "B", "é", "́", ".", "'", "s", " ", "\n", "1", "<|endoftext|>", "ß", "Σ", "$", "日"]
    texts = ODD + ["".join(rng.choice(signs) for _ in range(rng.randrange(60))) for _ in range(400)]
    ids, counts = encoder(WORD).encode([t.encode() for t in texts])
    ends = np.cumsum(counts).tolist()
    for text, a, b in zip(texts, [0, *ends], ends):
        assert ids[a:b].tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_best_fit_takes_the_tightest_and_closes_the_fullest():
    bins = OpenBins(10, 2)
    assert bins.place(6) == (0, 0)
    assert bins.place(5) == (1, 0)
    assert bins.place(4) == (0, 6)  # fits both, leaves least in the first
    assert bins.place(7) == (2, 0)
    assert bins.place(8) == (3, 0)  # bins 1 and 2 are open: the fuller one, 2, closes
    assert bins.place(3) == (1, 5)
    assert bins.place(10) == (4, 0)
    assert bins.open == 2


def test_pieces_cover_all_documents_without_gaps(docs, rows, library):
    found = pack(docs, WORD, capacity=64, open_bins=4).collect()
    want = sorted(
        (-1 if d is None else d, s, len(ids[s : s + 64]), crc(ids[s : s + 64]), s // 64)
        for d, ids in expected(library, rows)
        for s in range(0, len(ids), 64)
    )
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.start, r.length, r.ids_crc32, r.piece) for r in found) == want
    for r in found:
        assert zlib.crc32(r.ids) == r.ids_crc32
    bins: dict = {}
    for r in found:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64


def test_code_lengths_are_optimal_and_limited():
    rng = np.random.default_rng(1)
    counts = rng.integers(1, 1000, 300) ** 3
    lengths = code_lengths(counts, 20)
    assert np.sum(2.0 ** -lengths) == 1.0
    entropy = -(counts / counts.sum()) @ np.log2(counts / counts.sum())
    assert entropy <= lengths @ counts / counts.sum() < entropy + 1
    tight = code_lengths(2 ** np.arange(30), 6)
    assert tight.max() <= 6 and np.sum(2.0 ** -tight) <= 1
    assert code_lengths(np.array([5])).tolist() == [1]
    codes = {format(int(c), f"0{n}b") for c, n in zip(canonical(lengths), lengths)}
    assert len(codes) == 300 and not any(a != b and b.startswith(a) for a in codes for b in codes)


@pytest.mark.parametrize("n", [1, 127, 128, 129, 5000])
def test_blocks_decode_to_what_was_coded(n):
    rng = np.random.default_rng(n)
    counts = np.maximum(1, 10**6 // np.arange(1, 400) ** 2)
    book = CodeBook(list(range(3, 402)), code_lengths(counts).tolist())
    ids = rng.integers(3, 402, n).astype(np.uint32)
    bits, marks = book.encode(ids)
    assert book.decode(bits, marks, n).tolist() == ids.tolist()


def test_files_give_back_all_ids_in_order(spark, docs, rows, nothing, library):
    path = scratch_path(spark, "huffman-test")
    write_ids(docs, WORD, path)
    found = read_ids(spark, path).collect()
    want, start = [], 0
    for d, ids in sorted(expected(library, rows), key=lambda r: (-1 if r[0] is None else r[0])):
        want.append((d, start, len(ids), crc(ids)))
        start += len(ids)
    got = sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in found), key=lambda r: r[1])
    assert got == want
    path = scratch_path(spark, "huffman-test")
    write_ids(nothing, WORD, path)
    assert read_ids(spark, path).count() == 0


def test_overlapping_chunks_count_as_the_whole():
    tool = Counter(PIECE)
    rng = random.Random(1)
    signs = ["the ", "of", "  ", "\n", "é", "日本", "x\ty", "▁", " ▁a", "\r\n", "12 ", "      ", "</s>", "hello ", "​ "]
    for _ in range(60):
        text = "".join(rng.choice(signs) for _ in range(rng.randrange(50, 4000)))
        assert tool.count(text, 300, 20) == len(tool.model.encode(text))
    text = "a" * 5000 + " b" * 1000 + "c" * 4000
    assert tool.count(text, 300, 20) == len(tool.model.encode(text))


def test_counts_equal_the_library(docs, rows, nothing):
    model = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    found = count_tokens(docs, PIECE, limit=100, chunk=2000, overlap=64).collect()
    want = sorted((-1 if d is None else d, len((t or "").encode()), len(model.encode(t or ""))) for d, t, *_ in rows)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_tokens) for r in found) == want
    assert all(r.over_limit == (r.n_tokens > 100) for r in found)
    assert count_tokens(nothing, PIECE).count() == 0 and pack(nothing, WORD).count() == 0
