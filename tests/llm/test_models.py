"""Language, quality and language-model scores against brute force or held-out labels."""

import math
import random
from collections import Counter

import numpy as np
from fixtures import DOCS, words
from riskmill.llm import language_id, ngram_trie, quality

WORDS = {"en": "the of and to in is that for it with".split(), "fr": "le la de et les des est que dans pour".split()}


def languages(spark, n=120):
    rng = random.Random(2)
    rows = []
    for i in range(n):
        lang = rng.choice(sorted(WORDS))
        text = " ".join(rng.choice(WORDS[lang]) for _ in range(rng.randrange(4, 30)))
        rows.append((i, text, lang, "s", 0, "x", "y", 1))
    return spark.createDataFrame([*rows, (900, None, "en", *[None] * 5), (901, "12 !", "fr", *[None] * 5), (902, "", None, *[None] * 5)], DOCS)


def test_code_lengths_are_those_of_ppm_and_sum_to_one():
    size = language_id.ALPHABET
    text = np.array([1, 2, 3, 1, 2, 3, 1, 2, 4, 1, 5, 2, 3], np.int32)
    code, n = np.unique(language_id._context_codes(text, size), return_counts=True)
    bits = language_id.code_lengths(code, n).reshape(-1, size).astype(np.float64)
    assert np.allclose((2.0**-bits).sum(axis=1), 1, atol=1e-4)

    seen: dict = {}
    padded = [0, 0, 0, *text.tolist()]
    for i in range(3, len(padded)):
        for order in range(4):
            seen.setdefault((order, tuple(padded[i - order : i])), Counter())[padded[i]] += 1

    def probability(context, sign, order=3, refused=frozenset()):
        if order < 0:
            return 1 / (size - len(refused)) if refused else 1 / size
        counts = seen.get((order, context[3 - order :]), Counter())
        if not counts:
            return probability(context, sign, order - 1, refused)
        total = sum(counts.values()) + len(counts)
        if sign in counts:
            return counts[sign] / total
        lower = {s: probability(context, s, order - 1) for s in range(size)}
        return len(counts) / total * lower[sign] / sum(v for s, v in lower.items() if s not in counts)

    for context in ((1, 2, 3), (0, 0, 0), (3, 1, 2), (9, 9, 1), (7, 7, 7)):
        row = (context[0] * size + context[1]) * size + context[2]
        for sign in (1, 2, 3, 4, 9):
            assert math.isclose(2.0 ** -bits[row, sign], probability(context, sign), rel_tol=1e-4)


def test_languages_are_told_apart_and_others_are_undetermined(spark, nothing):
    docs = languages(spark)
    found = {r.doc_id: r for r in language_id.predict(docs, language_id.learn(language_id.sample(docs.where("doc_id % 2 = 0")))).collect()}
    held = [r for r in docs.collect() if r.doc_id < 900 and r.doc_id % 2]
    assert all(found[r.doc_id].lang_pred == r.lang for r in held)
    assert [found[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3
    assert all(0 <= r.score <= 1 for r in found.values())
    empty = language_id.learn(language_id.sample(nothing))
    assert {r.lang_pred for r in language_id.predict(docs, empty).collect()} == {"und"}
    kept = language_id.stage_language_id(spark, docs, "")
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == set(found) - {900, 901, 902}


def test_quality_is_learned_and_kept_rows_are_ranked(spark, docs, nothing):
    rng = random.Random(4)
    clean = [(i, " ".join(rng.choice(WORDS["en"]) for _ in range(30))) for i in range(0, 200, 2)]
    junk = [(i, " ".join(rng.choice(WORDS["en"]).upper() + "!!" for _ in range(30))) for i in range(1, 200, 2)]
    frame = spark.createDataFrame([*clean, *junk, (500, None), (501, "")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(100)] + [(150, None), (501, 1)], "doc_id bigint, quality int")
    model = quality.learn(quality.sample(frame, labels))
    found = {r.doc_id: r.score for r in quality.score(frame, model).collect()}
    assert min(found[i] for i, _ in clean) > 0.7 > 0.3 > max(found[i] for i, _ in junk)
    assert found[500] == found[501] and 0 <= found[500] <= 1
    single = quality.learn(quality.sample(frame, labels.where("quality = 1")))
    assert len({r.score for r in quality.score(frame, single).collect()}) == 1
    assert quality.score(nothing, quality.learn(quality.sample(nothing, labels))).count() == 0


def test_indicators_are_the_distinct_byte_runs():
    text = "Abc abc! é".encode()
    want = {(n, text[i : i + n]) for n in (1, 2, 3) for i in range(len(text) - n + 1)}
    places = {int(quality._place(np.array([int.from_bytes(g, "big")], np.uint32), n)[0]) for n, g in want}
    assert set(quality.indicators(text).tolist()) == places
    long = bytes(random.Random(1).randrange(97, 123) for _ in range(3000))
    assert set(quality.indicators(long * 400).tolist()) >= set(quality.indicators(long).tolist())


def brute_scores(train, texts):
    sequences = [[*words(t), "</e>"] for t in train]
    c = Counter(w for s in sequences for w in s)
    total, size = sum(c.values()), len(c)
    two, three = Counter(), Counter()
    for s in sequences:
        s = ["<s>", *s]
        two.update(zip(s, s[1:]))
        three.update(zip(s, s[1:], s[2:]))
    contexts = {**c, "<s>": len(sequences)}
    two = {k: n for k, n in two.items() if n >= 2}
    three = {k: n for k, n in three.items() if n >= 2}
    kept2, kept3 = Counter(), Counter()
    for (a, _), n in two.items():
        kept2[a] += (n - 0.75) / contexts[a]
    for (a, b, _), n in three.items():
        kept3[a, b] += (n - 0.75) / two[a, b]

    def p1(w):
        return (c.get(w, 0) + 1) / (total + size + 1)

    def p2(a, b):
        return max(two.get((a, b), 0.75) - 0.75, 0) / contexts.get(a, 1) + (1 - kept2[a]) * p1(b)

    def p3(a, b, w):
        if (a, b) not in two:
            return p2(b, w)
        return max(three.get((a, b, w), 0.75) - 0.75, 0) / two[a, b] + (1 - kept3[a, b]) * p2(b, w)

    out = []
    for t in texts:
        s = ["<s>", *words(t), "</e>"]
        p = [p2("<s>", s[1]), *(p3(*s[i - 2 : i + 1]) for i in range(2, len(s)))]
        base = sum(math.log10(p1(w)) for w in s[1:])
        out.append((len(s) - 1, sum(w in c for w in s[1:]), base, sum(map(math.log10, p))))
    return out


def test_scores_equal_brute_force_up_to_quantisation(spark, docs, rows, nothing):
    train = [t for d, t, *_ in rows if d is not None and d % 3]
    model = ngram_trie.build(docs.where("doc_id % 3 <> 0"))
    found = {(-1 if r.doc_id is None else r.doc_id): r for r in ngram_trie.score(docs, model).collect()}
    for (d, *_), (n, known, base, score) in zip(rows, brute_scores(train, [r[1] for r in rows])):
        r = found[-1 if d is None else d]
        assert (r.n_tokens, r.n_known) == (n, known)
        assert math.isclose(r.base_score, base, rel_tol=1e-9)
        assert abs(r.score - score) <= 0.05 * n
    empty = ngram_trie.build(nothing)
    assert {r.score for r in ngram_trie.score(docs, empty).collect()} == {0.0}
    assert ngram_trie.score(nothing, model).count() == 0


def test_elias_fano_gives_back_monotone_values():
    rng = np.random.default_rng(1)
    for n, top in ((1, 0), (5, 3), (1000, 50), (1000, 10**7), (3, 2**40), (70, 70)):
        values = np.sort(rng.integers(0, top + 1, n))
        coded = ngram_trie.EliasFano(ngram_trie.EliasFano.encode(values))
        assert coded.get(np.arange(n)).tolist() == values.tolist()
    keys = np.unique(rng.integers(0, 2**63, 1000).astype(np.uint64))
    assert (ngram_trie._from_planes(ngram_trie._planes(keys)) == keys).all()
