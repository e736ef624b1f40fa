"""Near-duplicates, lines, decontamination, neighbours, components and the pipeline against brute force."""

import random
from collections import Counter

import numpy as np
from fixtures import DOCS, Union, words
from pyspark.sql import functions as F
from riskmill.llm import ann, decontaminate, line_dedup, near_dup
from riskmill.llm.common import components, linked


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def near_brute(rows):
    sets = {d: shingles(t) for d, t, *_ in rows if d is not None}
    union = Union()
    for a in sets:
        for b in sets:
            common = len(sets[a] & sets[b])
            if a < b and common and 100 * common >= 75 * (len(sets[a]) + len(sets[b]) - common):
                union.join(a, b)
    return {d: (len(s), union.find(d)) for d, s in sets.items()}


def test_components_are_the_smallest_ids_reachable(spark):
    rng = random.Random(6)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1200)]
    union = Union()
    for a, b in edges:
        union.join(a, b)
    found = {r.id: r.component for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert found == {x: union.find(x) for a, b in edges if a != b for x in (a, b)}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_no_link_inside_a_bucket_is_lost_to_its_centre(spark):
    # a chain: every member is only linked with the next, so most are not linked with any one centre
    buckets = spark.createDataFrame([(77, i) for i in range(40)], "bucket bigint, id bigint")

    def prepare(ids):
        return lambda pairs: pairs.where("abs(a - b) = 1"), lambda some: some, F.lit(True)

    found = linked(buckets, prepare, "chain").collect()
    assert {(r.id, r.component) for r in found} == {(i, 0) for i in range(40)}


def test_near_duplicates_equal_brute_force(spark, docs, rows, nothing):
    found = near_dup.near_duplicates(docs).collect()
    want = near_brute(rows)
    for r in found:
        if r.doc_id is not None:
            assert (r.n_shingles, r.component_id) == want[r.doc_id], r
            assert r.kept == (r.doc_id == r.component_id)
    assert len(found) == len(rows)
    assert near_dup.near_duplicates(nothing).count() == 0
    kept = near_dup.stage_near_dedup(spark, docs, "")
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.where("doc_id is not null").collect()]
    assert set(ids) == {d for d, (_, c) in want.items() if d == c}


def lines_brute(rows):
    places: dict = {}
    for d, t, *_ in rows:
        for k, line in enumerate((t or "").split("\n")):
            if norm := line.lower().strip(" \t\x0b\x0c\r"):
                places.setdefault(norm, []).append((-1 if d is None else d, k))
    names = list(places)
    sets = [{n[i : i + 9] for i in range(len(n) - 8)} if len(n) >= 9 else {n} for n in names]
    union = Union()
    for i, a in enumerate(sets):
        for j in range(i):
            common = len(a & sets[j])
            if common >= 0.75 * (len(a) + len(sets[j]) - common):
                union.join(i, j)
    groups: dict = {}
    for i, n in enumerate(names):
        groups.setdefault(union.find(i), []).extend(places[n])
    return {p for g in groups.values() for p in sorted(g)[1:]}


def test_removed_lines_equal_brute_force(spark, docs, rows, nothing):
    unique = [r for i, r in enumerate(rows) if i == [x[0] for x in rows].index(r[0])]
    frame = spark.createDataFrame(unique, DOCS)
    found = line_dedup.removed_lines(frame).collect()
    got = {(-1 if r.doc_id is None else r.doc_id, r.line_no) for r in found}
    assert len(got) == len(found)
    assert got == lines_brute(unique)
    assert line_dedup.removed_lines(nothing).count() == 0
    cut = line_dedup.stage_line_dedup(spark, frame.where("doc_id is not null"), "")
    assert cut.columns == frame.columns
    texts = {r.doc_id: r.text for r in cut.collect()}
    gone = lines_brute([r for r in unique if r[0] is not None])
    for d, t, *_ in unique[:-1]:
        kept = [line for k, line in enumerate((t or "").split("\n")) if (d, k) not in gone]
        if len(kept) == len((t or "").split("\n")):
            assert texts[d] == t
        else:
            assert texts.get(d, "") == ("\n".join(kept) if "".join(kept).strip() else "")
    assert 40 not in texts
    blank = {d for d, t, *_ in unique if d is not None and not words(t)}
    assert blank <= set(texts)


def test_lines_of_repeated_ids_and_identical_rows(spark):
    rows = [(0, "the same line here"), (1, "a unique first line\nsecond of its own"), (1, "the same line here\nother words"), (7, "twice\nover it"), (7, "twice\nover it")]
    rows += [(None, "no id at all"), (None, "quite another text")]
    frame = spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], "doc_id bigint, text string, row int, gone int, cut int, id int")
    for parts in (1, 3):
        cut = line_dedup.stage_line_dedup(spark, frame.repartition(parts), "")
        assert cut.columns == frame.columns
        got = sorted((r.doc_id if r.doc_id is not None else -1, r.text) for r in cut.collect())
        want = [(-1, "no id at all"), (-1, "quite another text"), (0, "the same line here"), (1, "a unique first line\nsecond of its own"), (1, "other words"), (7, "twice\nover it")]
        assert got == want
    removed = sorted((r.doc_id, r.line_no) for r in line_dedup.removed_lines(frame).collect())
    assert removed == [(1, 0), (7, 0), (7, 1)]


def test_shingles_in_pieces_are_all_shingles(spark):
    texts = ["a", "é" * 8, "日本語" * 3, "abcdefghi", "x" * 17] + ["".join(chr(97 + (i * i) % 23) for i in range(n)) for n in range(9, 60)]
    frame = spark.createDataFrame([(t,) for t in texts], "norm string")
    for r in frame.select("norm", F.size(line_dedup._shingles("norm")).alias("n")).collect():
        assert r.n == len({r.norm[i : i + 9] for i in range(max(len(r.norm) - 8, 1))})


def test_a_crowded_bucket_is_linked_by_further_centres(spark):
    # two members are linked if their numbers are near on a ring, so a centre meets a part of the others only
    n = 120
    buckets = spark.createDataFrame([(b, i) for b in (5, 9) for i in range(n)] + [(7, i) for i in range(n, n + 40)], "bucket bigint, id bigint")
    met = []

    def prepare(ids):
        def verify(pairs):
            met.append(pairs.count())
            return pairs.where(f"b < {n} and pmod(a - b, {n}) in (1, 2, 3, {n - 1}, {n - 2}, {n - 3})")

        return verify, lambda some: some, F.lit(True)

    found = linked(buckets, prepare, "ring").collect()
    assert {(r.id, r.component) for r in found} == {(i, 0) for i in range(n)}
    assert all(pairs <= 2 * 4 * (n + 40) for pairs in met[:-1])


def test_refused_pairs_of_a_crowded_bucket_never_become_rows(spark):
    # members of one residue are linked; the bucket is crowded, and all other pairs are refused by their residue
    n = 90
    buckets = spark.createDataFrame([(b, i) for b in (5, 9) for i in range(n)], "bucket bigint, id bigint")
    met = []

    def prepare(ids):
        def verify(pairs):
            met.append((pairs.count(), pairs.where("pmod(a, 30) = pmod(b, 30)").count()))
            return pairs.where("pmod(a, 30) = pmod(b, 30)")

        return verify, lambda some: some.select("id", F.pmod("id", F.lit(30)).alias("r")), F.col("r") == F.col("other_r")

    found = linked(buckets, prepare, "residues").collect()
    assert {(r.id, r.component) for r in found} == {(i, i % 30) for i in range(n)}
    assert all(pairs == likely for pairs, likely in met[1:])  # the first round's centre meets every member


def test_signatures_of_lines_are_shuffled_as_ints_and_tell_lines_apart(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice("abcdefgh ") for _ in range(60)).strip() for _ in range(60)]
    near = [t[:-2] + "zz" for t in texts]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts + near)], "id bigint, norm string")
    signed = line_dedup.buckets_of(frame)
    plan = signed._jdf.queryExecution().optimizedPlan().toString()
    assert "m35" in plan and {f.dataType.typeName() for f in signed.schema} == {"long"}
    sizes = signed._jdf.queryExecution().analyzed().toString()
    assert "cast(shiftright" in sizes  # minima are taken of ints
    met: dict = {}
    for r in signed.collect():
        met.setdefault(r.bucket, set()).add(r.id)
    pairs = {(a, b) for g in met.values() for a in g for b in g if a < b}
    assert {(i, i + 60) for i in range(60)} <= pairs
    assert len(pairs) < 80


def leaks_brute(docs, items):
    known = {}
    for i, t, *_ in items:
        if words(t):
            n = len(words(t))
            runs = [tuple(words(t)[k : k + 5]) for k in range(max(n - 4, 1))]
            known[i] = (max(n - 4, 1), n, Counter(runs))
    found = set()
    for d, t, *_ in docs:
        w = words(t)
        for i, (m, n, own) in known.items():
            runs = [tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))] if w else []
            best = 0
            for s in range(max(len(runs) - m, 0) + 1):
                window = Counter(runs[s : s + m])
                common = sum((window & own).values())
                best = max(best, common / (sum(window.values()) + sum(own.values()) - common))
            if best >= 0.75:
                found.add((d, i))
    return found


def test_leaks_equal_brute_force(spark, docs, rows, nothing):
    rng = random.Random(9)
    plain = [r for r in rows if r[0] is not None]
    items = []
    for i, (d, t, *_) in enumerate(plain[:30:3]):
        w = (t or "").split()
        at = rng.randrange(max(len(w) - 20, 1))
        items.append((i, " ".join(w[at : at + 20])))
    w = items[0][1].split()
    items += [(50, " ".join([*w[:10], "other", *w[10:]])), (51, None), (52, ""), (53, "one TWO"), (54, "a a a a a a a a a"), (None, "x y"), (3, items[3][1])]
    longer = [(1000, " ".join(["z"] * 30 + w + ["z"] * 5)), (1001, "a " * 40), (1002, " ".join(w[:-2])), (1003, " ".join(w[:8]))]
    frame = spark.createDataFrame([(d, t) for d, t, *_ in rows] + longer, "doc_id bigint, text string")
    found = decontaminate.contaminated(frame, spark.createDataFrame(items, "item_id bigint, text string")).collect()
    got = {(r.doc_id, r.item_id) for r in found}
    assert got == leaks_brute([*plain, *longer], [i for i in items if i[0] is not None])
    assert len(got) == len(found)
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert decontaminate.contaminated(frame, none).count() == 0
    assert decontaminate.contaminated(nothing, spark.createDataFrame(items, "item_id bigint, text string")).count() == 0


def vectors(n=3000, width=16):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((n, width)) * rng.uniform(0.5, 2, (n, 1))
    rows = [(i, [float(v) for v in x[i]], 1) for i in range(n)]
    rows += [(n, None, 1), (n + 1, [0.0] * width, 1), (n + 2, [float("nan")] * width, 1), (n + 3, [1.0], 1), (n + 4, rows[0][1], 1)]
    return rows, x


def test_neighbours_are_found_scored_and_ordered(spark):
    rows, x = vectors()
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int").repartition(3)
    usable = ann.usable(frame, "vec_id", "embedding")
    found = ann.nearest(usable, usable.where("id % 20 = 0"), k=20).collect()
    by_query: dict = {}
    for r in found:
        by_query.setdefault(r.query_id, []).append(r)
    full = np.vstack([x, x[:1]])
    ids = [*range(len(x)), len(x) + 4]
    hits = 0
    for q, got in by_query.items():
        got.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in got] == list(range(1, 21))
        query = full[ids.index(q)]
        assert all(abs(r.score - full[ids.index(r.vec_id)] @ query) < 1e-9 for r in got)
        assert [(-r.score, r.vec_id) for r in got] == sorted((-r.score, r.vec_id) for r in got)
        order = sorted((-(full[k] @ query), i) for k, i in enumerate(ids) if i != q)
        hits += len({i for _, i in order[:20]} & {r.vec_id for r in got})
    assert set(by_query) == {i for i in ids if i % 20 == 0}
    assert hits / (20 * len(by_query)) >= 0.9
    few = usable.where("id < 5")
    assert ann.nearest(few, few.where("id = 0")).count() == 4
    assert ann.nearest(usable.where("false"), usable.where("false")).count() == 0


def test_every_stage_of_the_pipeline_takes_effect(spark, tmp_path):
    import corpus_pipeline

    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "language_id", "line_dedup", "near_dedup", "decontamination", "best_fit_packing"
    ]
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    current, steps = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, current, "/root/testdata/sf0.001")
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        if name != "best_fit_packing":
            assert out.columns == docs.columns
        steps[name] = (current.toPandas(), out.toPandas())
        current = out

    before, after = steps["line_dedup"]
    gone = lines_brute(list(before.itertuples(index=False)))
    texts = dict(zip(after.doc_id, after.text))
    for d, text in zip(before.doc_id, before.text):
        lines = text.split("\n")
        kept = [line for k, line in enumerate(lines) if (d, k) not in gone]
        if len(kept) == len(lines) or "".join(kept).strip():
            assert texts[d] == "\n".join(kept)
        else:
            assert d not in texts
    before, after = steps["near_dedup"]
    want = near_brute(list(before[["doc_id", "text"]].itertuples(index=False)))
    assert set(after.doc_id) == {d for d, (_, c) in want.items() if d == c}
    before, after = steps["decontamination"]
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").toPandas()
    leaks = leaks_brute(list(before[["doc_id", "text"]].itertuples(index=False)), list(items[["item_id", "text"]].itertuples(index=False)))
    assert set(before.doc_id) - set(after.doc_id) == {d for d, _ in leaks}
    before, after = steps["best_fit_packing"]
    assert set(after.doc_id) == set(before.doc_id)
