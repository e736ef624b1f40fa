"""Metrics against published counts, and data set jobs."""

import pytest
from pyspark.sql import functions as F

from riskmill import config as C
from riskmill.operators import dataset, evaluation
from riskmill.sources import tables

DP, WI, AC = C.EVAL_CLASSES


def counts(spark, rows):
    cells = [(s, c, 0.45, *v) for s, per in rows.items() for c, v in zip(C.EVAL_CLASSES, per)]
    return spark.createDataFrame(cells, "system string, defect_class string, tau double, tp bigint, fp bigint, fn bigint, tn bigint")


def test_published_macro_numbers(spark):
    c = counts(spark, {
        "A": [(3, 0, 0, 8), (2, 1, 0, 8), (3, 0, 0, 8)],
        "B": [(1, 0, 2, 8), (2, 9, 0, 0), (3, 8, 0, 0)],
        "C": [(3, 0, 0, 8), (2, 9, 0, 0), (3, 8, 0, 0)],
    })
    got = {r.system: (r.precision, r.recall, r.f1, r.total_fp) for r in evaluation.macro_metrics(c).collect()}
    assert got["A"] == (0.8889, 1.0, 0.9412, 1)
    assert got["B"][1:] == (0.7778, got["B"][2], 17)
    cmp = evaluation.compare_systems(evaluation.macro_metrics(c), "C", "A").first()
    assert (cmp.fp_before, cmp.fp_after, cmp.fp_cost_before) == (17, 1, 17.0)
    costs = {r.system: (r.fp_review_usd, r.fn_loss_inr) for r in evaluation.error_costs(c).collect()}
    assert costs["A"] == (16.67, 0) and costs["B"] == (283.33, 3000)


def test_conventions_on_empty_classes(spark):
    c = counts(spark, {"A": [(1, 0, 0, 1), (0, 0, 0, 2), (0, 0, 0, 2)]})
    assert tuple(evaluation.macro_metrics(c).first())[2:5] == (1.0, 1.0, 1.0)
    assert tuple(evaluation.macro_metrics(c, evaluation.ONE).first())[2:5] == (1.0, 1.0, 1.0)
    c = counts(spark, {"A": [(0, 1, 0, 1), (0, 0, 0, 2), (0, 0, 0, 2)]})
    assert tuple(evaluation.macro_metrics(c).first())[2:5] == (0.0, 0.0, 0.0)
    assert tuple(evaluation.macro_metrics(c, evaluation.ONE).first())[2:5] == (0.6667, 1.0, 0.6667)


def test_confusion_is_the_full_grid(spark):
    predictions = [("A", 1, DP, 0.45), ("A", 1, DP, 0.2), ("A", 2, WI, 0.9), ("B", 3, AC, 0.5), ("A", 99, DP, 0.9), ("A", 2, "SUSPICIOUS_CONTENT", 1.0)]
    truth = [(1, DP), (1, DP), (3, AC), (98, WI)]
    p = spark.createDataFrame(predictions, "system string, sample_id int, defect_class string, confidence double")
    t = spark.createDataFrame(truth, "sample_id int, defect_class string")
    s = spark.createDataFrame([(i,) for i in (1, 2, 3, 4)], "sample_id int")
    systems = evaluation.verified_system(evaluation.union_systems(p, ["A", "B"], "C"), "C", spark.createDataFrame([(3, AC)], "sample_id int, defect_class string"), "D")
    got = {(r.system, r.defect_class, r.tau): (r.tp, r.fp, r.fn, r.tn) for r in evaluation.confusion(systems, t, s, ["A", "B", "C", "D"], [0.45, 0.6]).collect()}
    assert len(got) == 4 * 3 * 2
    assert got["A", DP, 0.45] == (1, 0, 0, 3) and got["A", DP, 0.6] == (0, 0, 1, 3)
    assert got["A", WI, 0.6] == (0, 1, 0, 3) and got["B", AC, 0.45] == (1, 0, 0, 3)
    assert got["C", AC, 0.45] == (1, 0, 0, 3) and got["C", WI, 0.45] == (0, 1, 0, 3)
    assert got["D", WI, 0.45] == (0, 0, 0, 4) and got["D", AC, 0.45] == (1, 0, 0, 3)


def samples(spark, n=200):
    return spark.range(n).select(
        F.when(F.col("id") % 20 == 0, F.concat(F.lit("ex-"), F.col("id").cast("string"))).otherwise(F.concat(F.lit("s"), F.col("id").cast("string"))).alias("sample_id"),
        F.concat(F.lit("g"), (F.col("id") % 50).cast("string")).alias("repo_id"),
        F.concat(F.lit("c"), (F.col("id") % 90).cast("string")).alias("content"), F.array().cast("array<string>").alias("labels"),
    )


def test_split_keeps_groups_whole(spark):
    split = dataset.group_split(samples(spark)).cache()
    free = split.filter("sample_id NOT LIKE 'ex-%'")
    assert free.groupBy("repo_id").agg(F.count_distinct("split").alias("n")).filter("n > 1").count() == 0
    sizes = {r.split: r.n for r in free.groupBy("split").agg(F.count_distinct("repo_id").alias("n")).collect()}
    assert sizes == {"train": 30, "val": 10, "test": 10}
    assert split.filter("sample_id LIKE 'ex-%' AND split <> 'train'").count() == 0
    again = dataset.group_split(samples(spark).repartition(7))
    assert again.exceptAll(split).isEmpty()


def test_merging_identical_content_stops_leakage(spark):
    # A chain of groups linked one to the next, and separate ones.
    rows = [(f"s{i}", f"g{i:02d}", f"h{i}") for i in range(30)] + [(f"t{i}", f"g{i:02d}", f"h{i + 1}") for i in range(11)]
    df = spark.createDataFrame(rows, "sample_id string, repo_id string, content_hash string")
    roots = {r.repo_id: r.root for r in dataset.merge_groups_by_content(df, "repo_id").collect()}
    assert all(roots[f"g{i:02d}"] == "g00" for i in range(12)) and roots["g12"] == "g12"
    assert dataset.content_leakage(dataset.group_split(df, merge_identical=True)).isEmpty()


def test_manifest(spark, tmp_path):
    split = dataset.group_split(dataset.with_content_hash(samples(spark)))
    manifest = dataset.test_manifest(split)
    path = str(tmp_path / "m")
    tables.freeze_manifest(manifest, path)
    with pytest.raises(Exception, match="(?i)exists"):
        tables.freeze_manifest(manifest, path)
    frozen = spark.read.parquet(path)
    assert dataset.manifest_report(dataset.manifest_diff(manifest, frozen)).first().valid
    changed = frozen.withColumn("content_hash", F.lit("x"))
    assert dataset.manifest_report(dataset.manifest_diff(manifest, changed)).first().reason == "CONTENT_CHANGED"
    one_less = manifest.filter(F.col("sample_id") != manifest.first().sample_id)
    report = dataset.manifest_report(dataset.manifest_diff(one_less, frozen)).first()
    assert (report.valid, report.reason, report.removed) == (False, "SET_CHANGED", 1)


def test_sinks(spark, tmp_path):
    from riskmill.operators.retrieval import example_chunks

    train = spark.createDataFrame([(f"s{i}", "code é", [DP], False) for i in range(20)], "sample_id string, content string, classes array<string>, hard_negative boolean")
    tables.write_chunk_manifest(example_chunks(train), str(tmp_path / "chunks"))
    back = tables.read_chunk_manifest(spark, str(tmp_path / "chunks"))
    assert back.exceptAll(example_chunks(train)).isEmpty() and back.count() == 20
    assert tuple(tables.chunk_summary(back).first()) == ("EXAMPLE", 20, 20)

    reports = [("C", "test", 1, 0.5), ("C", "test", 2, 0.6), ("C+RAG", "test", 3, 0.7), ("C", "val", 9, 0.1)]
    tables.write_report(spark.createDataFrame(reports, "system string, split string, generated_at int, f1 double"), str(tmp_path / "reports"))
    assert {r.system: r.f1 for r in tables.latest_report(spark, str(tmp_path / "reports")).collect()} == {"C": 0.6, "C+RAG": 0.7}

    runs = spark.createDataFrame([("A", "OK", 0.1, 0.2, 0.3), ("B", "UNAVAILABLE", 0.1, 0.2, 0.3)], "system string, llm_status string, macro_precision double, macro_recall double, macro_f1 double")
    tables.append_run(runs, str(tmp_path / "runs"))
    tables.append_run(runs, str(tmp_path / "runs"))
    got = spark.read.json(str(tmp_path / "runs"))
    assert got.count() == 4 and got.filter("system = 'B' AND macro_f1 IS NOT NULL").isEmpty()

    calls = spark.createDataFrame([("2024-01-01 10:00:00", "m", True), ("2024-01-02 10:00:00", "m", False)], "ts string, model string, cached boolean")
    tables.append_call_ledger(calls.withColumn("ts", F.to_timestamp("ts")), str(tmp_path / "ledger"))
    assert [str(r.day) for r in spark.read.parquet(str(tmp_path / "ledger")).collect()] == ["2024-01-02"]
