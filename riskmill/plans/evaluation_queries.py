"""Queries on detector evaluation and labelled data sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskmill import config as C
from riskmill.operators import dataset, evaluation, retrieval
from riskmill.plans import derived as D
from riskmill.plans.registry import query, table
from riskmill.session import scratch_path
from riskmill.sources import tables

SYSTEMS = ["A", "B", "C", "D"]
TAUS = [0.3, 0.45, 0.6, 0.75, 0.9]


def systems_of(inputs):
    """C = A or B; D = C where verified."""
    both = evaluation.union_systems(inputs["predictions"], ["A", "B"], "C")
    return evaluation.verified_system(both, "C", inputs["verified"], "D")


def _counts(spark, sf, taus):
    inputs = D.evaluation_inputs(spark, sf)
    return evaluation.confusion(systems_of(inputs), inputs["truth"], inputs["samples"], SYSTEMS, taus)


def _grid(taus, empty="0.0", scope="samples"):
    return f"WITH {D.EVALUATION}, {D.cells_sql(taus, scope).format(empty=empty)}"


@query(
    "eval_metrics",
    _grid([0.45]) + """ SELECT system, defect_class, tau, tp, fp, fn, tn, round(p, 4) AS precision, round(r, 4) AS recall,
      round(f, 4) AS f1, 'OK' AS llm_status FROM scored""",
)
def eval_metrics(spark, sf):
    inputs = D.evaluation_inputs(spark, sf)
    metrics = evaluation.evaluate(systems_of(inputs), inputs["truth"], inputs["samples"], SYSTEMS)
    return metrics.drop("convention")


@query(
    "eval_unavailable_model",
    _grid([0.45]) + """ SELECT system, defect_class, CASE WHEN system IN ('A') THEN tp END AS tp, CASE WHEN system IN ('A') THEN round(p, 4) END AS precision,
      CASE WHEN system IN ('A') THEN 'OK' ELSE 'UNAVAILABLE' END AS llm_status FROM scored""",
)
def eval_unavailable_model(spark, sf):
    """Systems that need a model which did not run are reported without numbers."""
    inputs = D.evaluation_inputs(spark, sf)
    metrics = evaluation.evaluate(systems_of(inputs), inputs["truth"], inputs["samples"], SYSTEMS, unavailable=["B", "C", "D"])
    return metrics.select("system", "defect_class", "tp", "precision", "llm_status")


_MACRO_ACTIVE = """, m AS (SELECT system, tau, coalesce(avg(p) FILTER (tp + fn > 0), avg(p)) AS mp, coalesce(avg(r) FILTER (tp + fn > 0), avg(r)) AS mr,
    CAST(sum(fp) AS BIGINT) AS total_fp FROM scored GROUP BY ALL),
  macro AS (SELECT system, tau, round(mp, 4) AS precision, round(mr, 4) AS recall,
    round(CASE WHEN mp + mr > 0 THEN 2 * mp * mr / (mp + mr) ELSE 0.0 END, 4) AS f1, total_fp FROM m)"""


@query("eval_macro_active", _grid([0.45]) + _MACRO_ACTIVE + " SELECT * FROM macro")
def eval_macro_active(spark, sf):
    return evaluation.macro_metrics(_counts(spark, sf, [0.45]))


@query(
    "eval_macro_all",
    _grid([0.45], "1.0") + """ SELECT system, tau, round(avg(p), 4) AS precision, round(avg(r), 4) AS recall, round(avg(f), 4) AS f1,
      CAST(sum(fp) AS BIGINT) AS total_fp FROM scored GROUP BY ALL""",
)
def eval_macro_all(spark, sf):
    return evaluation.macro_metrics(_counts(spark, sf, [0.45]), evaluation.ONE)


@query("tau_sweep", _grid(TAUS) + _MACRO_ACTIVE + " SELECT * FROM macro")
def tau_sweep(spark, sf):
    return evaluation.macro_metrics(_counts(spark, sf, TAUS))


@query(
    "system_compare",
    _grid([0.45]) + _MACRO_ACTIVE + """ SELECT tau, max(precision) FILTER (system = 'C') AS precision_before, max(precision) FILTER (system = 'D') AS precision_after,
      max(recall) FILTER (system = 'C') AS recall_before, max(recall) FILTER (system = 'D') AS recall_after,
      max(f1) FILTER (system = 'C') AS f1_before, max(f1) FILTER (system = 'D') AS f1_after,
      max(total_fp) FILTER (system = 'C') AS fp_before, max(total_fp) FILTER (system = 'D') AS fp_after,
      1.0::DOUBLE * max(total_fp) FILTER (system = 'C') AS fp_cost_before, 1.0::DOUBLE * max(total_fp) FILTER (system = 'D') AS fp_cost_after,
      1.0::DOUBLE AS fp_cost_weight FROM macro GROUP BY tau""",
)
def system_compare(spark, sf):
    return evaluation.compare_systems(evaluation.macro_metrics(_counts(spark, sf, [0.45])), "C", "D")


@query(
    "error_costs",
    _grid([0.45]) + f""" SELECT system, tau, round(sum(fp * {C.REVIEW_MINUTES_PER_FP / 60.0 * C.HOURLY_COST_USD!r}::DOUBLE), 2) AS fp_review_usd,
      CAST(sum(fn * CASE defect_class WHEN '{C.AMOUNT_CURRENCY}' THEN 75000 ELSE 1500 END) AS BIGINT) AS fn_loss_inr, 'ESTIMATED' AS kind FROM scored GROUP BY ALL""",
)
def error_costs(spark, sf):
    return evaluation.error_costs(_counts(spark, sf, [0.45]))


@query(
    "static_blind_recall",
    f"""WITH {D.EVALUATION} SELECT b.system, count(*) FILTER (b.confidence >= 0.45) AS found, any_value(n) AS positives, round(count(*) FILTER (b.confidence >= 0.45) / any_value(n)::DOUBLE, 4) AS recall
      FROM (SELECT DISTINCT sample_id, defect_class FROM truth JOIN samples USING (sample_id) WHERE NOT static_detectable) t JOIN best b USING (sample_id, defect_class),
        (SELECT count(*) AS n FROM (SELECT DISTINCT sample_id, defect_class FROM truth JOIN samples USING (sample_id) WHERE NOT static_detectable)) GROUP BY 1""",
)
def static_blind_recall(spark, sf):
    inputs = D.evaluation_inputs(spark, sf)
    blind = evaluation.restrict_truth(inputs["truth"], inputs["samples"], static_detectable=False)
    counts = evaluation.confusion(systems_of(inputs), blind, inputs["samples"], SYSTEMS)
    total = counts.groupBy("system").agg(F.sum("tp").alias("found"), F.sum(F.col("tp") + F.col("fn")).alias("positives"))
    return total.withColumn("recall", F.round(F.col("found") / F.col("positives"), 4))


@query(
    "verified_predictions",
    f"""WITH {D.EVALUATION} SELECT system, defect_class, count(*) AS predictions, count(DISTINCT sample_id) AS samples FROM best GROUP BY ALL""",
)
def verified_predictions(spark, sf):
    inputs = D.evaluation_inputs(spark, sf)
    return evaluation.class_predictions(systems_of(inputs)).groupBy("system", "defect_class").agg(
        F.count(F.lit(1)).alias("predictions"), F.count_distinct("sample_id").alias("samples")
    )


@query(
    "first_samples",
    f"""WITH {D.LABELLED} SELECT sample_id FROM split WHERE split = 'val' ORDER BY sample_id LIMIT 50""",
)
def first_samples(spark, sf):
    split = dataset.group_split(D.labelled_samples(spark, sf))
    return evaluation.first_samples(split.filter("split = 'val'").select("sample_id"), 50)


@query(
    "latest_reports",
    """SELECT system, run, generated_at FROM (SELECT event_type AS system, event_id AS run, epoch_us(ts) AS generated_at,
         row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1""",
)
def latest_reports(spark, sf):
    reports = D.keyed_events(spark, sf).select(F.col("event_type").alias("system"), F.col("event_id").alias("run"), F.col("ts_us").alias("generated_at"))
    return evaluation.latest_reports(reports)


@query(
    "report_table",
    _grid([0.45]) + """ SELECT system, '| Class | TP | FP | FN | TN | Precision | Recall | F1 |' || chr(10) || '|---|---|---|---|---|---|---|---|' || chr(10) ||
       string_agg('| ' || defect_class || ' | ' || tp || ' | ' || fp || ' | ' || fn || ' | ' || tn || ' | ' || printf('%.4f', round(p, 4)) || ' | ' || printf('%.4f', round(r, 4)) || ' | ' || printf('%.4f', round(f, 4)) || ' |', chr(10)
         ORDER BY defect_class) AS markdown FROM scored GROUP BY system""",
)
def report_table(spark, sf):
    return tables.render_report(evaluation.class_metrics(_counts(spark, sf, [0.45]))).select("system", "markdown")


# --- data set ------------------------------------------------------------------------------


@query("group_split", f"WITH {D.LABELLED} SELECT sample_id, repo_id, split FROM split")
def group_split(spark, sf):
    return dataset.group_split(D.labelled_samples(spark, sf)).select("sample_id", "repo_id", "split")


@query("group_positions", f"WITH {D.LABELLED} SELECT repo_id, position FROM ranked")
def group_positions(spark, sf):
    samples = D.labelled_samples(spark, sf).filter("sample_id NOT LIKE 'ex-%'")
    return dataset.dense_rank_by_hash(samples, "repo_id")


@query(
    "group_split_merged",
    f"""WITH RECURSIVE {D.LABELLED}, pairs AS (SELECT DISTINCT a.repo_id AS x, b.repo_id AS y FROM labelled a JOIN labelled b USING (content_hash)),
      reach AS (SELECT x, y FROM pairs UNION SELECT r.x, p.y FROM reach r JOIN pairs p ON p.x = r.y),
      roots AS (SELECT x AS repo_id, min(y) AS root FROM reach GROUP BY 1),
      mranked AS (SELECT root, row_number() OVER (ORDER BY sha256('42|' || root), root) - 1 AS position, count(*) OVER () AS total FROM
        (SELECT DISTINCT root FROM labelled JOIN roots USING (repo_id) WHERE sample_id NOT LIKE 'ex-%'))
      SELECT sample_id, CASE WHEN sample_id LIKE 'ex-%' THEN 'train' WHEN position < floor(total * 0.6::DOUBLE) THEN 'train'
         WHEN position < floor(total * 0.6::DOUBLE) + floor(total * 0.2::DOUBLE) THEN 'val' ELSE 'test' END AS split
      FROM labelled JOIN roots USING (repo_id) LEFT JOIN mranked USING (root)""",
)
def group_split_merged(spark, sf):
    """Groups that share a text go to the same split."""
    samples = dataset.with_content_hash(D.labelled_samples(spark, sf))
    return dataset.group_split(samples, merge_identical=True).select("sample_id", "split")


@query(
    "split_statistics",
    f"""WITH {D.LABELLED} SELECT coalesce(split, 'all') AS split, count(*) AS n, count(*) FILTER (NOT unsafe) AS safe, count(*) FILTER (unsafe) AS vulnerable
        FROM split GROUP BY ROLLUP (split)""",
)
def split_statistics(spark, sf):
    return dataset.split_statistics(dataset.group_split(D.labelled_samples(spark, sf)), ~F.col("unsafe"))


@query(
    "content_leakage",
    f"""WITH {D.LABELLED} SELECT content_hash, count(*) AS copies, array_to_string(list_sort(list_distinct(list(split))), '|') AS splits
        FROM split GROUP BY 1 HAVING count(DISTINCT split) > 1""",
)
def content_leakage(spark, sf):
    split = dataset.group_split(dataset.with_content_hash(D.labelled_samples(spark, sf)))
    return dataset.content_leakage(split).withColumn("splits", F.array_join("splits", "|"))


def _manifests(spark, sf):
    """Now: the test split. Frozen: the same without some samples, with others and other contents."""
    split = dataset.group_split(dataset.with_content_hash(D.labelled_samples(spark, sf)))
    now = dataset.test_manifest(split)
    frozen = split.filter("split = 'test' AND doc_id % 9 <> 1 OR split = 'val' AND doc_id % 9 = 2").select(
        "sample_id", "repo_id", F.when(F.col("doc_id") % 9 == 3, F.lit("0" * 16)).otherwise(F.col("content_hash")).alias("content_hash"), "labels"
    )
    return now, frozen


_MANIFESTS = f"""{D.LABELLED}, now AS (SELECT * FROM split WHERE split = 'test'),
  frozen AS (SELECT sample_id, CASE WHEN doc_id % 9 = 3 THEN repeat('0', 16) ELSE content_hash END AS content_hash
             FROM split WHERE (split = 'test' AND doc_id % 9 <> 1) OR (split = 'val' AND doc_id % 9 = 2)),
  diff AS (SELECT coalesce(n.sample_id, f.sample_id) AS sample_id, n.content_hash AS current_hash, f.content_hash AS frozen_hash,
      CASE WHEN f.sample_id IS NULL THEN 'ADDED' WHEN n.sample_id IS NULL THEN 'REMOVED' WHEN n.content_hash <> f.content_hash THEN 'CHANGED' ELSE 'OK' END AS status
    FROM now n FULL JOIN frozen f ON n.sample_id = f.sample_id)"""


@query("manifest_diff", f"WITH {_MANIFESTS} SELECT * FROM diff")
def manifest_diff(spark, sf):
    """The frozen manifest makes the round trip through its file."""
    now, frozen = _manifests(spark, sf)
    path = scratch_path(spark, "manifest")
    tables.freeze_manifest(frozen, path)
    return dataset.manifest_diff(now, spark.read.parquet(path))


@query(
    "manifest_report",
    f"""WITH {_MANIFESTS} SELECT count(*) FILTER (status = 'ADDED') AS added, count(*) FILTER (status = 'REMOVED') AS removed, count(*) FILTER (status = 'CHANGED') AS changed,
        count(*) FILTER (status = 'OK') AS ok, false AS valid, 'SET_CHANGED' AS reason FROM diff""",
)
def manifest_report(spark, sf):
    return dataset.manifest_report(dataset.manifest_diff(*_manifests(spark, sf)))


@query(
    "id_changes",
    f"""WITH {_MANIFESTS} SELECT sample_id, status AS change FROM diff WHERE status IN ('ADDED', 'REMOVED')""",
)
def id_changes(spark, sf):
    now, frozen = _manifests(spark, sf)
    return dataset.id_changes(frozen, now)


_CHUNKS_SQL = f"""{D.LABELLED}, exploded AS (
    SELECT sample_id, split, content, unsafe, cls FROM split, LATERAL (SELECT unnest(
      CASE WHEN unsafe THEN list_concat(CASE WHEN quality = 0 THEN ['{C.DUPLICATE_PAYMENT}'] ELSE [] END, CASE WHEN toxic = 1 THEN ['{C.WEBHOOK_INTEGRITY}'] ELSE [] END)
           WHEN sample_id LIKE 'hn-dp-%' THEN ['{C.DUPLICATE_PAYMENT}'] WHEN sample_id LIKE 'sb-wi-%' THEN ['{C.WEBHOOK_INTEGRITY}']
           WHEN sample_id LIKE 'gen-amount-%' THEN ['{C.AMOUNT_CURRENCY}'] ELSE ['{C.DUPLICATE_PAYMENT}', '{C.WEBHOOK_INTEGRITY}', '{C.AMOUNT_CURRENCY}'] END) AS cls)
    WHERE split = 'train'),
  chunks AS (SELECT 'ex:' || sample_id || ':' || cls || CASE WHEN unsafe THEN '' ELSE ':safe' END AS id,
      CASE WHEN unsafe THEN 'UNSAFE ' || cls || ' example:' ELSE 'SAFE ' || cls || ' example (correct handling):' END || chr(10) || substr(content, 1, 1600) AS text,
      cls AS defect_class, CASE WHEN unsafe THEN 'UNSAFE_PATTERN' ELSE 'SAFE_PATTERN' END AS kind,
      sample_id LIKE 'hn-%' OR sample_id LIKE 'sb-%' AS hard_negative, sample_id FROM exploded)"""


def _chunks(spark, sf):
    train = dataset.group_split(D.labelled_samples(spark, sf)).filter("split = 'train'")
    return retrieval.example_chunks(
        train.select("sample_id", "content", F.col("labels").alias("classes"), F.lit(False).alias("hard_negative")),
        max_chars=C.EXAMPLE_CHARS,
    )


@query("example_chunks", f"WITH {_CHUNKS_SQL} SELECT id, sha256(text) AS digest, defect_class, kind, hard_negative FROM chunks")
def example_chunks(spark, sf):
    return _chunks(spark, sf).select("id", F.sha2("text", 256).alias("digest"), "defect_class", "kind", "hard_negative")


@query(
    "knowledge_base_summary",
    f"""WITH {_CHUNKS_SQL} SELECT 'EXAMPLE' AS tier, count(*) AS n_chunks, count(DISTINCT sample_id) AS n_samples FROM chunks
        UNION ALL SELECT 'RULE', count(*), 0 FROM documents""",
)
def knowledge_base_summary(spark, sf):
    """Rules and examples, written as a chunk manifest and read back."""
    from riskmill.sources.corpus import rule_chunks

    doc = F.col("doc_id").cast("string")
    books = table(spark, sf, "documents").select(
        F.lit("/b.md").alias("path"),
        F.concat(F.lit("### RULE X-"), doc, F.lit(" — T\nclass: AMOUNT_CURRENCY\n"), "text").alias("text"),
    )
    path = scratch_path(spark, "chunks")
    tables.write_chunk_manifest(retrieval.knowledge_base(rule_chunks(books), _chunks(spark, sf)), path)
    return tables.chunk_summary(tables.read_chunk_manifest(spark, path))


@query(
    "leakage_guard",
    f"""WITH {_CHUNKS_SQL}, indexed AS (SELECT sample_id FROM chunks UNION SELECT sample_id FROM split WHERE split = 'val' AND length(repo_id) % 2 = 0)
        SELECT DISTINCT s.sample_id FROM split s WHERE split <> 'train' AND sample_id IN (SELECT sample_id FROM indexed)""",
)
def leakage_guard(spark, sf):
    """An index that wrongly holds part of the val split: exactly those samples are reported."""
    split = dataset.group_split(D.labelled_samples(spark, sf))
    wrong = split.filter("split = 'val' AND length(repo_id) % 2 = 0").select("sample_id")
    indexed = _chunks(spark, sf).select("sample_id").unionByName(wrong)
    return dataset.leaked_ids(indexed, split.filter("split <> 'train'"))
