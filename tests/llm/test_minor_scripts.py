"""Two languages of one minor script are told apart although Latin texts fill most of the sample."""

import random

from fixtures import DOCS
from riskmill.llm import language_id

LETTERS = {"ru": "абвгдежз", "bg": "иклмнопр"}  # words of equal lengths, so only the letters tell


def test_two_languages_of_a_minor_script(spark):
    rng = random.Random(5)
    rows = []
    for i in range(240):
        lang = "en" if i % 6 else ("ru", "bg")[i // 6 % 2]
        letters = LETTERS.get(lang, "abcdefghijklmnopqrstuvwxyz0123456789.,:;!?()-'")
        words = ["".join(rng.choice(letters) for _ in range(4)) for _ in range(600 if lang == "en" else 8)]
        rows.append((i, " ".join(words), lang, *[None] * 5))
    docs = spark.createDataFrame(rows, DOCS)
    train = docs.where("doc_id % 24 >= 12")
    found = {r.doc_id: r.lang_pred for r in language_id.predict(docs, language_id.learn(language_id.sample(train))).collect()}
    assert found == {i: lang for i, _, lang, *_ in rows}
    few = language_id.learn(language_id.sample(train), nodes=50)
    assert all(0 < len(codes) <= 60 for codes, _ in few[1])
