"""Line dedup finds similar lines without blanks and of few words, which differ near their start."""

import random

from riskmill.llm import line_dedup


def alike(rng, kind):
    """Two lines of a Jaccard similarity of 0.75 or more over their shingles of nine characters."""
    cjk = lambda n: "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(n))
    letters = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    if kind == "cjk":
        rest = cjk(70)
        return cjk(1) + rest, cjk(1) + rest
    if kind == "url":
        rest = "://" + letters(70) + "/x"
        return "http" + rest, "https" + rest
    if kind == "one word":
        rest = letters(90)
        return letters(4) + rest, letters(4) + rest
    if kind == "line separators":
        rest = " ".join(letters(5) for _ in range(10))
        return "x" + rest, "y" + rest
    rest = " ".join(letters(20) for _ in range(int(kind[0]) - 1))
    return f"{rng.randrange(1, 5)}. {rest}", f"{rng.randrange(5, 10)}. {rest}"


def test_lines_without_blanks_and_of_few_words_meet(spark):
    rng = random.Random(12)
    for kind in ("cjk", "url", "one word", "line separators", "3 words", "4 words"):
        rows = [(2 * i + k, line) for i in range(60) for k, line in enumerate(alike(rng, kind))]
        sets = [{t[i : i + 9] for i in range(len(t) - 8)} for _, t in rows]
        true = {2 * i + 1 for i in range(60) if 1.75 * len(sets[2 * i] & sets[2 * i + 1]) >= 0.75 * (len(sets[2 * i]) + len(sets[2 * i + 1]))}
        assert len(true) >= 50, kind
        found = {r.doc_id for r in line_dedup.removed_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
        assert found <= true and len(found) >= 0.97 * len(true), (kind, len(found), len(true))
