"""Postings are made in their ranges: one row for a term of a range, not one for each of its documents."""

from collections import Counter

from riskmill.operators import retrieval as R


def test_postings_are_one_row_for_each_term_of_a_range(spark):
    texts = [f"alpha Beta b{i % 7} alpha" for i in range(300)] + ["", None, "--", "gamma " * 40]
    rows = [(i, ["A", "B", None][i % 3], t) for i, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "id bigint, defect_class string, text string").repartition(5)
    postings, seen, n_docs, mean_length = R._counts(frame)
    got, found = postings.collect(), {}
    assert len(got) == len({(r.term, r.defect_class, r.part) for r in got})
    assert len(got) < 50  # 904 pairs of a term and a document
    for r in got:
        for id_, length, tf in zip(r.ids, r.lengths, r.tfs, strict=True):
            assert (r.term, id_) not in found
            found[r.term, id_] = (r.defect_class, length, tf)
    plain = {}
    for id_, name, text in rows:
        words = R._TERM.findall((text or "").lower().encode())
        for term, tf in Counter(words).items():
            plain[term.decode(), id_] = (name, len(words), tf)
    assert found == plain
    assert n_docs == len(rows) and mean_length == sum(tf for _, _, tf in plain.values()) / len(rows)
    assert {r.term: r.df for r in seen.collect()} == Counter(t for t, _ in plain)


def test_no_documents(spark):
    frame = spark.createDataFrame([], "id string, defect_class string, text string")
    postings, seen, n_docs, mean_length = R._counts(frame)
    assert postings.count() == seen.count() == n_docs == 0 and mean_length == 0


def test_postings_are_not_shuffled_for_the_asked_terms(spark, monkeypatch):
    plans = []

    def kept(df, eager=True):
        if df.columns == ["term", "defect_class", "part", "ids", "parts"]:
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return checkpoint(df, eager)

    checkpoint = R.reliable_checkpoint
    monkeypatch.setattr(R, "reliable_checkpoint", kept)
    docs = spark.createDataFrame([(i, "A", f"one w{i}") for i in range(30)], "id bigint, defect_class string, text string")
    queries = spark.createDataFrame([(1, "w3 one"), (2, "none")], "query_id bigint, text string")
    best = {(r.query_id, r.id) for r in R.bm25_best(queries, docs, ["A"], 40).collect()}
    assert best == {(1, i) for i in range(30)}
    assert len(plans) == 1 and "BroadcastHashJoin" in plans[0] and "SortMergeJoin" not in plans[0]
