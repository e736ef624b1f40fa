"""Queries on lists, pages and counts, and on the accounting of model calls."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskmill import config as C
from riskmill.functions import textops as T
from riskmill.operators import model_calls, serving
from riskmill.plans import derived as D
from riskmill.plans.ledger_queries import outcomes
from riskmill.plans.registry import query, sql_text, table

# --- lists and pages -----------------------------------------------------------------------


@query(
    "findings_page",
    f"""WITH {D.SCAN_TABLES} SELECT finding_id, scan_id, title, severity, state, created_at, (SELECT count(*) FROM findings WHERE state = 'ADVISORY' AND severity = 'HIGH') AS total
        FROM findings WHERE state = 'ADVISORY' AND severity = 'HIGH' ORDER BY created_at DESC, finding_id LIMIT 50 OFFSET 100""",
)
def findings_page(spark, sf):
    findings = D.scan_tables(spark, sf)["findings"]
    rows = serving.findings_page(findings, 50, 100, state="ADVISORY", severity="HIGH", scan_id="", defect_class=None)
    return rows.select("finding_id", "scan_id", "title", "severity", "state", "created_at", "total")


@query(
    "finding_titles",
    f"WITH {D.SCAN_TABLES} SELECT defect_class, title, count(*) AS n FROM findings GROUP BY ALL",
)
def finding_titles(spark, sf):
    findings = D.scan_tables(spark, sf)["findings"]
    titled = findings.withColumn("title", T.title_for(F.col("rule_ids"), F.col("defect_class")))
    return titled.groupBy("defect_class", "title").agg(F.count(F.lit(1)).alias("n"))


@query(
    "scan_list",
    f"""WITH {D.SCAN_TABLES} SELECT s.scan_id, s.state, r.locator, s.started_at, coalesce(n, 0) AS n_findings FROM scans s JOIN repositories r ON r.repository_id = s.repository_id
        LEFT JOIN (SELECT scan_id, count(*) AS n FROM findings GROUP BY 1) f ON f.scan_id = s.scan_id""",
)
def scan_list(spark, sf):
    t = D.scan_tables(spark, sf)
    return serving.list_scans(t["scans"], t["repositories"], t["findings"]).select("scan_id", "state", "locator", "started_at", "n_findings")


@query(
    "recent_scans",
    f"WITH {D.SCAN_TABLES} SELECT scan_id, state, started_at FROM scans ORDER BY started_at DESC, scan_id LIMIT 10",
)
def recent_scans(spark, sf):
    scans = D.scan_tables(spark, sf)["scans"]
    return serving.recent(scans, [F.desc("started_at"), F.col("scan_id")]).select("scan_id", "state", "started_at")


_SUMMARY = """SELECT f.scan_id, any_value(n) AS n_findings, count(*) FILTER (state = 'ADVISORY') AS n_advisory, count(*) FILTER (state = 'VERIFIED') AS n_verified,
    count(*) FILTER (state = 'EXCEPTION') AS n_exception FROM {src} f JOIN (SELECT scan_id, count(*) AS n FROM {all} GROUP BY 1) t ON t.scan_id = f.scan_id GROUP BY 1"""


@query("scan_summary", f"WITH {D.SCAN_TABLES} " + _SUMMARY.format(src="findings", all="findings"))
def scan_summary(spark, sf):
    return serving.scan_summary(D.scan_tables(spark, sf)["findings"])


@query(
    "scan_summary_first_50",
    f"""WITH {D.SCAN_TABLES}, byrepo AS (SELECT f.*, s.repository_id FROM findings f JOIN scans s ON s.scan_id = f.scan_id),
        g AS (SELECT repository_id AS scan_id, state, row_number() OVER (PARTITION BY repository_id ORDER BY created_at, finding_id) AS rn FROM byrepo),
        head AS (SELECT * FROM g WHERE rn <= 50) """ + _SUMMARY.format(src="head", all="g"),
)
def scan_summary_first_50(spark, sf):
    """State counts over the 50 oldest findings only, per repository so that the cut bites."""
    t = D.scan_tables(spark, sf)
    by_repository = t["findings"].join(t["scans"].select("scan_id", "repository_id"), "scan_id").drop("scan_id")
    return serving.scan_summary(by_repository.withColumnRenamed("repository_id", "scan_id"), first_n=50)


@query(
    "scan_kpis",
    f"""WITH {D.SCAN_TABLES} SELECT count(*) AS total_scans, count(*) FILTER (state NOT IN ('DONE', 'FAILED')) AS active_scans, count(*) FILTER (state = 'DONE') AS done_scans,
        (SELECT count(*) FROM findings) AS total_findings FROM scans""",
)
def scan_kpis(spark, sf):
    t = D.scan_tables(spark, sf)
    return serving.scan_kpis(t["scans"], t["findings"])


@query(
    "queue_status",
    f"""WITH {D.SCAN_TABLES} SELECT count(*) FILTER (priority = '1-URGENT') AS pending_jobs, max(started_at) FILTER (priority = '5-LOW') AS last_job_at FROM scans""",
)
def queue_status(spark, sf):
    jobs = D.scan_tables(spark, sf)["scans"].select(
        F.when(F.col("priority") == "1-URGENT", "PENDING").when(F.col("priority") == "5-LOW", "DONE").otherwise("RUNNING").alias("status"),
        F.col("started_at").alias("created_at"),
    )
    return serving.queue_status(jobs)


@query(
    "exception_queue",
    f"""WITH {D.SCAN_TABLES} SELECT finding_id, state, CASE state WHEN 'EXCEPTION' THEN 0 ELSE 1 END AS queue_rank FROM findings WHERE state IN ('EXCEPTION', 'ADVISORY')""",
)
def exception_queue(spark, sf):
    return serving.exception_queue(D.scan_tables(spark, sf)["findings"]).select("finding_id", "state", "queue_rank")


@query(
    "worst_findings",
    f"WITH {D.SCAN_TABLES} SELECT finding_id, severity, confidence FROM findings",
)
def worst_findings(spark, sf):
    """All findings, the most severe and most confident first; a caller takes as many as it wants."""
    return serving.by_severity(D.scan_tables(spark, sf)["findings"]).select("finding_id", "severity", "confidence")


@query(
    "finding_detail",
    f"""WITH {D.SCAN_TABLES}, records AS (
          SELECT finding_id, 'verification' AS section, 'v' || finding_id AS record_id, CASE part % 4 WHEN 0 THEN 'VERIFIED' WHEN 1 THEN 'NOT_REPRODUCED' WHEN 2 THEN 'ERROR' ELSE 'INCONCLUSIVE' END AS record_status,
                 CASE WHEN part % 4 = 0 THEN paise END AS measured_impact_paise FROM findings WHERE state <> 'ADVISORY'
          UNION ALL SELECT finding_id, 'remediation', 'r' || finding_id, 'PROPOSED', NULL FROM findings WHERE state = 'VERIFIED')
        SELECT f.finding_id, locator, title, scenario, coalesce(section, 'none') AS section, record_id, record_status, measured_impact_paise
        FROM findings f JOIN scans s ON s.scan_id = f.scan_id LEFT JOIN repositories r ON r.repository_id = s.repository_id LEFT JOIN records x ON x.finding_id = f.finding_id""",
)
def finding_detail(spark, sf):
    from riskmill.operators.verdicts import scrub_outcomes

    t = D.scan_tables(spark, sf)
    findings = t["findings"].join(t["scans"].select("scan_id", "repository_id"), "scan_id")
    name = F.col("finding_id").cast("string")
    verifications = scrub_outcomes(outcomes(findings.filter("state <> 'ADVISORY'"))).withColumn("verification_id", F.concat(F.lit("v"), name))
    remediations = findings.filter("state = 'VERIFIED'").select("finding_id", F.concat(F.lit("r"), name).alias("remediation_id"), F.lit("PROPOSED").alias("status"))
    detail = serving.finding_detail(findings, t["repositories"], verifications, remediations)
    return detail.select("finding_id", "locator", "title", "scenario", "section", "record_id", "record_status", "measured_impact_paise")


@query(
    "model_status",
    f"""WITH {D.SCAN_TABLES}, c AS (SELECT scan_id, bool_or(part % 5 = 0) AS failed, CAST(sum(part % 3) AS BIGINT) AS n FROM findings GROUP BY 1)
        SELECT c.scan_id, n AS n_llm_findings, CASE WHEN c.scan_id % 4 = 0 THEN 'OFF' WHEN failed AND n = 0 THEN 'FAILED' WHEN failed THEN 'DEGRADED' ELSE 'OK' END AS llm_status FROM c""",
)
def model_status(spark, sf):
    calls = D.scan_tables(spark, sf)["findings"].select(
        "scan_id", (F.col("part") % 5 == 0).alias("failed"), (F.col("part") % 3).alias("n_findings")
    )
    return serving.model_status(calls, F.col("scan_id") % 4 != 0)


@query(
    "state_changes",
    f"""WITH {D.KEYED_EVENTS} SELECT user_id, event_id, event_type, prev AS prev_event_type FROM (
          SELECT user_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts_us, event_id) AS prev FROM keyed) WHERE prev IS NULL OR prev <> event_type""",
)
def state_changes(spark, sf):
    day = F.expr("ts_us DIV 86400000000")
    changes = serving.state_changes(D.keyed_events(spark, sf), "user_id", "event_type", ["ts_us", "event_id"], day)
    return changes.select("user_id", "event_id", "event_type", "prev_event_type")


@query(
    "state_changes_until_terminal",
    f"""WITH {D.KEYED_EVENTS}, e AS (SELECT *, event_type = 'error' AND k > 90 AS last FROM keyed),
        ends AS (SELECT user_id, min((ts_us, event_id)) AS pos FROM e WHERE last GROUP BY 1),
        s AS (SELECT e.user_id, event_id, ts_us, CASE WHEN last THEN 'FAILED' ELSE event_type END AS state FROM e LEFT JOIN ends ON ends.user_id = e.user_id WHERE pos IS NULL OR (ts_us, event_id) <= pos)
        SELECT user_id, event_id, state, prev AS prev_state FROM (SELECT *, lag(state) OVER (PARTITION BY user_id ORDER BY ts_us, event_id) AS prev FROM s) WHERE prev IS NULL OR prev <> state""",
)
def state_changes_until_terminal(spark, sf):
    log = D.keyed_events(spark, sf).withColumn(
        "state", F.when((F.col("event_type") == "error") & (F.col("k") > 90), F.lit("FAILED")).otherwise(F.col("event_type"))
    )
    day = F.expr("ts_us DIV 86400000000")
    changes = serving.state_changes(log, "user_id", "state", ["ts_us", "event_id"], day, C.SCAN_TERMINAL_STATES)
    return changes.select("user_id", "event_id", "state", "prev_state")


# --- model calls ---------------------------------------------------------------------------

_CLASSES = [*C.EVAL_CLASSES, "OTHER_CLASS"]


def _answers(spark, sf):
    """Events as model answers: some fenced, some with a bad class, confidence or broken JSON."""
    k = F.col("k")
    name = F.element_at(F.array(*[F.lit(c) for c in _CLASSES]), F.when(k % 10 == 0, 4).otherwise(k % 3 + 1))
    conf = F.when(k % 11 == 0, F.lit("1.5")).otherwise(F.concat(F.lit("0."), F.lpad(k.cast("string"), 2, "0")))
    body = F.concat(
        F.lit('{"findings": [{"defect_class": "'), name, F.lit('", "confidence": '), conf,
        F.lit(', "explanation": "e'), F.col("event_id").cast("string"), F.lit('", "evidence_lines": ['), k.cast("string"), F.lit("]}]}"),
    )
    text = (
        F.when(k % 7 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
        .when(k % 7 == 1, F.lit('{"findings": [{"defect_class": '))
        .when(k % 7 == 2, F.lit('{"findings": [], "analysis_notes": "clean"}'))
        .otherwise(body)
    )
    return D.keyed_events(spark, sf).select("event_id", text.alias("response"))


_ANSWERS = f"""{D.KEYED_EVENTS}, answers AS (SELECT event_id, k, k % 7 NOT IN (1, 2) AND k % 10 <> 0 AND k % 11 <> 0 AS one, k % 7 = 2 AS none FROM keyed)"""


@query(
    "answer_validation",
    f"""WITH {_ANSWERS} SELECT event_id, one OR none AS valid, CASE WHEN one THEN 1 ELSE 0 END AS n_findings,
          CASE WHEN none THEN 'clean' WHEN one THEN '' ELSE 'PARSE_ERROR' END AS analysis_notes FROM answers""",
)
def answer_validation(spark, sf):
    return model_calls.parse_analyses(_answers(spark, sf)).select("event_id", "valid", F.size("findings").alias("n_findings"), "analysis_notes")


@query(
    "answer_findings",
    f"""WITH {_ANSWERS} SELECT event_id, 0 AS finding_pos, list_extract(['{"', '".join(C.EVAL_CLASSES)}'], k % 3 + 1) AS defect_class, k / 100.0::DOUBLE AS confidence, 'e' || event_id AS explanation,
          k::VARCHAR AS evidence_lines, '' AS scenario_ids FROM answers WHERE one""",
)
def answer_findings(spark, sf):
    found = model_calls.explode_findings(model_calls.parse_analyses(_answers(spark, sf)), "event_id")
    return found.withColumns(
        {"evidence_lines": F.array_join(F.col("evidence_lines").cast("array<string>"), "|"), "scenario_ids": F.array_join("scenario_ids", "|")}
    )


_MODELS = [*C.PRICES_USD_PER_1M, "unknown-model"]
_MODEL_SQL = "list_extract([" + ", ".join(sql_text(m) for m in _MODELS) + "], (conv_id % 6 + 1)::INT)"


def requests(spark, sf):
    """Conversation turns as requests; the request id orders them."""
    model = F.element_at(F.array(*[F.lit(m) for m in _MODELS]), (F.col("conv_id") % 6 + 1).cast("int"))
    return table(spark, sf, "conversations").select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("request_id"), "role",
        F.concat(F.lit("p"), (F.col("conv_id") % 3).cast("string")).alias("provider"), F.lit("http://model").alias("base_url"),
        model.alias("model"), F.lit("0.0").alias("temperature"), F.lit("v1").alias("prompt_version"),
        # Short prompts repeat, so that the cache and the merging of equal requests have work.
        F.when(F.length("text") % 4 == 0, F.col("role")).otherwise(F.col("text")).alias("user_prompt"), "text",
    )


_REQUESTS = f"""requests AS (SELECT conv_id * 100 + turn AS request_id, role, 'p' || (conv_id % 3) AS provider, {_MODEL_SQL} AS model, text,
    sha256('p' || (conv_id % 3) || '|http://model|' || {_MODEL_SQL} || '|0.0|v1|' || CASE WHEN length(text) % 4 = 0 THEN role ELSE text END) AS cache_key FROM conversations),
  cache AS (SELECT DISTINCT cache_key FROM requests WHERE role = 'user')"""


def _keyed_requests(spark, sf):
    keyed = model_calls.with_request_key(requests(spark, sf))
    return keyed, keyed.filter("role = 'user'").select("cache_key").distinct()


@query(
    "cache_split",
    f"WITH {_REQUESTS} SELECT request_id, r.cache_key, c.cache_key IS NOT NULL AS hit FROM requests r LEFT JOIN cache c ON c.cache_key = r.cache_key",
)
def cache_split(spark, sf):
    return model_calls.split_cached(*_keyed_requests(spark, sf)).select("request_id", "cache_key", "hit")


@query(
    "calls_to_make",
    f"WITH {_REQUESTS} SELECT cache_key, min(request_id) AS request_id, count(*) AS n_requests FROM requests WHERE cache_key NOT IN (SELECT cache_key FROM cache) GROUP BY 1",
)
def calls_to_make(spark, sf):
    return model_calls.calls_to_make(*_keyed_requests(spark, sf))


_PRICE = "CASE model " + " ".join(
    f"WHEN {sql_text(m)} THEN length(text) * {i!r}::DOUBLE + (length(text) // 4) * {o!r}::DOUBLE" for m, (i, o) in C.PRICES_USD_PER_1M.items()
) + " ELSE 0.0 END"


@query(
    "cost_rollup",
    f"""WITH {_REQUESTS} SELECT provider, model, count(*) AS calls, CAST(sum(length(text)) AS BIGINT) AS input_tokens, CAST(sum(length(text) // 4) AS BIGINT) AS output_tokens,
          round(sum(round({_PRICE} / 1000000.0::DOUBLE, 6)), 4) AS cost_usd, count(*) FILTER (role = 'system') AS cache_hits,
          round(avg(CASE WHEN role = 'assistant' THEN 0.0 ELSE 1.0 END::DOUBLE), 4) AS success_rate FROM requests GROUP BY ALL""",
)
def cost_rollup(spark, sf):
    ledger = requests(spark, sf).select(
        "provider", "model", F.length("text").alias("input_tokens"), F.expr("length(text) DIV 4").alias("output_tokens"),
        (F.col("role") == "system").alias("cached"), (F.col("role") != "assistant").alias("success"),
    )
    return model_calls.call_costs(ledger)


_QUOTA = f"""{D.KEYED_EVENTS}, used AS (SELECT event_id, event_type AS provider, ts_us,
    count(*) OVER w AS requests, CAST(sum(k * 10) OVER w AS BIGINT) AS tokens_used FROM keyed
    WINDOW w AS (PARTITION BY event_type ORDER BY ts_us RANGE BETWEEN 59999999 PRECEDING AND CURRENT ROW))"""


def _calls(spark, sf):
    return D.keyed_events(spark, sf).select("event_id", F.col("event_type").alias("provider"), "ts_us", (F.col("k") * 10).alias("tokens"))


@query("quota_window", f"WITH {_QUOTA} SELECT event_id, provider, requests, tokens_used FROM used")
def quota_window(spark, sf):
    return model_calls.quota_usage(_calls(spark, sf)).select("event_id", "provider", "requests", "tokens_used")


@query("quota_breaches", f"WITH {_QUOTA} SELECT event_id, provider, requests, tokens_used FROM used WHERE requests > 1 OR tokens_used > 900")
def quota_breaches(spark, sf):
    return model_calls.quota_breaches(_calls(spark, sf), rpm=1, tpm=900).select("event_id", "provider", "requests", "tokens_used")
