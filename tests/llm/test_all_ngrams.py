"""op3_lm_scores rests on every n-gram of its training texts, also those seen once."""

import math
import random
import zlib
from collections import Counter

from fixtures import words
from riskmill.llm import ngram_trie


def scores_of_all(train, texts):
    c, two, three = Counter(), Counter(), Counter()
    for t in train:
        s = ["<s>", *words(t), "</e>"]
        c.update(s)
        two.update(zip(s, s[1:]))
        three.update(zip(s, s[1:], s[2:]))
    total, size = sum(c.values()) - c["<s>"], len(c) - 1
    kinds2, kinds3 = Counter(a for a, _ in two), Counter((a, b) for a, b, _ in three)

    def p1(w):
        return (c.get(w, 0) + 1) / (total + size + 1)

    def p2(a, b):
        if not kinds2[a]:
            return p1(b)
        return (max(two[a, b] - 0.75, 0) + 0.75 * kinds2[a] * p1(b)) / c[a]

    def p3(a, b, w):
        if not kinds3[a, b]:
            return p2(b, w)
        return (max(three[a, b, w] - 0.75, 0) + 0.75 * kinds3[a, b] * p2(b, w)) / two[a, b]

    out = []
    for t in texts:
        s = ["<s>", *words(t), "</e>"]
        out.append(sum(math.log10(p) for p in (p2("<s>", s[1]), *(p3(*s[i - 2 : i + 1]) for i in range(2, len(s))))))
    return out


def test_ngrams_seen_once_count(spark, tmp_path):
    rng = random.Random(14)
    rows = [(i, " ".join(f"w{rng.randrange(60)}" for _ in range(25)), None) for i in range(60)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.doc_id: r for r in ngram_trie.op3_lm_scores(spark, str(tmp_path)).collect()}
    train = [t for i, t, _ in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    for (i, *_), score in zip(rows, scores_of_all(train, [t for _, t, _ in rows])):
        assert abs(found[i].score - score) <= 0.05 * found[i].n_tokens, (i, found[i].score, score)
