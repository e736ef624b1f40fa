"""Queries on the code corpus: sources, text functions, units, rules, fusion, scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskmill import config as C
from riskmill.functions import hashing as H
from riskmill.functions import scoring as S
from riskmill.functions import textops as T
from riskmill.operators import fusion, rules, serving, units
from riskmill.plans import derived as D
from riskmill.plans.registry import query, sql_text, table
from riskmill.sources import corpus


def _joined(column: str, sep: str = "|"):
    return F.array_join(column, sep).alias(column)


# --- sources -------------------------------------------------------------------------------


@query(
    "source_files_kept",
    f"""WITH {D.SOURCE_FILES}
    SELECT repo_id, count(*) AS files, CAST(sum(length(content)) AS BIGINT) AS chars FROM source_files GROUP BY 1""",
)
def source_files_kept(spark, sf):
    raw = D.code_files(spark, sf).withColumn("content", F.encode("content", "UTF-8"))
    files = corpus.keep_source_files(raw).withColumn("content", corpus.decode_text(F.col("content")))
    return files.groupBy("repo_id").agg(
        F.count(F.lit(1)).alias("files"), F.sum(F.length("content")).cast("long").alias("chars")
    )


@query(
    "sample_defaults",
    """SELECT doc_id::VARCHAR AS sample_id, 2 AS difficulty, 'MIT' AS license,
         CASE WHEN doc_id % 3 = 0 THEN false ELSE true END AS static_detectable,
         CASE WHEN doc_id % 2 = 0 THEN lang ELSE '1-999' END AS lines, 'app.py' AS file
       FROM documents WHERE doc_id % 7 <> 0""",
)
def sample_defaults(spark, sf):
    """Documents as sparse ``sample.json`` texts, parsed and filled."""
    doc = F.col("doc_id").cast("string")
    span = F.when(F.col("doc_id") % 2 == 0, F.lit(',"lines":[[3,4]]')).otherwise(F.lit(""))
    detectable = F.when(F.col("doc_id") % 3 == 0, F.lit(',"static_detectable":false')).otherwise(F.lit(""))
    # Samples without a repository are unusable and must be dropped.
    repo = F.when(F.col("doc_id") % 7 != 0, F.concat(F.lit(',"repo_id":"'), "source", F.lit('"'))).otherwise(F.lit(""))
    text = F.concat(
        F.lit('{"sample_id":"'), doc, F.lit('","framework":"flask","language":"'), "lang", F.lit('"'),
        repo, detectable, F.lit(',"labels":[{"defect_class":"DUPLICATE_PAYMENT"'), span, F.lit("}]}"),
    )
    from riskmill.schemas import SAMPLES_JSON

    rows = table(spark, sf, "documents").select("lang", F.from_json(text, SAMPLES_JSON).alias("s")).select("lang", "s.*")
    lines = F.col("labels")[0]["lines"][0]
    return corpus.sample_defaults(rows.drop("_bad")).select(
        "sample_id", "difficulty", "license", "static_detectable",
        F.when(lines[0] == 3, F.col("lang")).otherwise(F.concat(lines[0].cast("string"), F.lit("-"), lines[1].cast("string"))).alias("lines"),
        "file",
    )


@query(
    "rule_book_chunks",
    """SELECT 'rule:X-' || doc_id AS id, 'AMOUNT_CURRENCY' AS defect_class, 'Title ' || doc_id AS title,
         'Title ' || doc_id || chr(10) || array_to_string(list_filter(list_transform(string_split(text, chr(10)),
           lambda l: regexp_replace(l, '^\\s+|\\s+$', '', 'g')), lambda l: l <> ''), ' ') AS text
       FROM documents WHERE doc_id % 4 <> 1""",
)
def rule_book_chunks(spark, sf):
    """Documents as rule books of one rule each; every fourth names no class and is dropped."""
    doc = F.col("doc_id").cast("string")
    name = F.when(F.col("doc_id") % 4 != 1, F.lit("class: AMOUNT_CURRENCY\n")).otherwise(F.lit("no class\n"))
    books = table(spark, sf, "documents").select(
        F.concat(F.lit("/books/b"), doc, F.lit(".md")).alias("path"),
        F.concat(F.lit("# Rules\n\n### RULE X-"), doc, F.lit(" — Title "), doc, F.lit("\n"), name, "text").alias("text"),
    )
    return corpus.rule_chunks(books).select("id", "defect_class", "title", "text")


# --- text functions ------------------------------------------------------------------------


@query(
    "strip_comments_pages",
    r"""WITH s AS (SELECT page_id, html, regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
          '(?s)\"\"\".*?\"\"\"|''''''.*?''''''', '', 'g'), '(?m)#.*$', '', 'g'), '(?m)//.*$', '', 'g'), '(?s)/\*.*?\*/', '', 'g') AS code FROM pages)
        SELECT page_id, length(html)::INT AS chars, length(code)::INT AS kept, sha256(code) AS digest FROM s""".replace('\\"', '"'),
)
def strip_comments_pages(spark, sf):
    code = T.strip_comments(F.col("html"))
    return table(spark, sf, "pages").select("page_id", "html", code.alias("code")).select(
        "page_id", F.length("html").alias("chars"), F.length("code").alias("kept"), F.sha2("code", 256).alias("digest")
    )


@query(
    "token_statistics",
    """SELECT doc_id, len(t)::INT AS n_tokens, len(list_distinct(t))::INT AS n_terms, sha256(array_to_string(t, ' ')) AS digest
       FROM (SELECT doc_id, list_transform(regexp_extract_all(text, '[A-Za-z0-9_]+'), lambda x: lower(x)) AS t FROM documents)""",
)
def token_statistics(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", T.tokens(F.col("text")).alias("t"))
    return docs.select(
        "doc_id", F.size("t").alias("n_tokens"), F.size(F.array_distinct("t")).alias("n_terms"),
        F.sha2(F.array_join("t", " "), 256).alias("digest"),
    )


_LINES = "string_split(rtrim(text, chr(10)), chr(10))"


@query(
    "numbered_prompts",
    f"""SELECT doc_id, sha256('Analyze this payment code unit for defects.' || chr(10) || chr(10) || 'File: ' || source || chr(10) ||
          'Function: f' || doc_id || ' (kind=OTHER)' || chr(10) || chr(10) || '```python' || chr(10) ||
          array_to_string(list_transform(l, lambda x, i: lpad(i::VARCHAR, greatest(4, length(i::VARCHAR))::INT, ' ') || ': ' || x), chr(10)) ||
          chr(10) || '```' || chr(10) || chr(10) || 'Return JSON only.') AS digest, len(l)::INT AS n_lines
        FROM (SELECT *, CASE WHEN text LIKE '%' || chr(10) THEN string_split(text[:-2], chr(10)) ELSE string_split(text, chr(10)) END AS l FROM documents)""",
)
def numbered_prompts(spark, sf):
    docs = table(spark, sf, "documents")
    symbol = F.concat(F.lit("f"), F.col("doc_id").cast("string"))
    return docs.select(
        "doc_id",
        F.sha2(T.analysis_prompt(F.col("source"), symbol, F.lit("OTHER"), F.col("text")), 256).alias("digest"),
        F.size(T.split_lines(F.col("text"))).alias("n_lines"),
    )


@query(
    "code_context_documents",
    """SELECT doc_id, (s - f)::INT AS highlight_start, (e - f)::INT AS highlight_end,
          sha256(array_to_string(list_slice(l, f + 1, least(n, e + 15)), chr(10))) AS digest
       FROM (SELECT doc_id, l, len(l) AS n, doc_id % 40 + 1 AS s, doc_id % 40 + 3 AS e, greatest(0, doc_id % 40 - 15) AS f
             FROM (SELECT doc_id, CASE WHEN text LIKE '%' || chr(10) THEN string_split(text[:-2], chr(10)) ELSE string_split(text, chr(10)) END AS l FROM documents))""",
)
def code_context_documents(spark, sf):
    start = (F.col("doc_id") % 40 + 1).cast("int")
    around = T.code_context(F.col("text"), start, start + 2)
    return table(spark, sf, "documents").select("doc_id", around.alias("c")).select(
        "doc_id", "c.highlight_start", "c.highlight_end", F.sha2(F.array_join("c.lines", "\n"), 256).alias("digest")
    )


@query(
    "json_in_answers",
    """SELECT conv_id, turn, sha256('{"a":' || to_json(text)::VARCHAR || '}') AS digest FROM conversations""",
)
def json_in_answers(spark, sf):
    """The same JSON object bare, fenced and inside prose must come out equal, whatever its text holds."""
    body = F.to_json(F.struct(F.col("text").alias("a")))
    shape = F.col("turn") % 3
    answer = (
        F.when(shape == 0, F.concat(F.lit("  "), body))
        .when(shape == 1, F.concat(F.lit("Sure.\n```json\n"), body, F.lit("\n```\nDone")))
        .otherwise(F.concat(F.lit("I found: "), body, F.lit(" as asked")))
    )
    return table(spark, sf, "conversations").select("conv_id", "turn", F.sha2(T.extract_json(answer), 256).alias("digest"))


@query(
    "safe_class_attribution",
    f"""WITH {D.LABELLED}
    SELECT sample_id, CASE WHEN sample_id LIKE 'hn-dp-%' THEN '{C.DUPLICATE_PAYMENT}' WHEN sample_id LIKE 'sb-wi-%' THEN '{C.WEBHOOK_INTEGRITY}'
      WHEN sample_id LIKE 'gen-amount-%' THEN '{C.AMOUNT_CURRENCY}' ELSE '{"|".join(C.EVAL_CLASSES)}' END AS classes FROM labelled""",
)
def safe_class_attribution(spark, sf):
    ids = D.labelled_samples(spark, sf)
    return ids.select("sample_id", F.array_join(T.infer_safe_classes(F.col("sample_id")), "|").alias("classes"))


# --- units and rules -----------------------------------------------------------------------


@query(
    "code_units",
    f"""WITH {D.CODE_UNITS}
    SELECT repo_id, file, symbol, start_line, end_line, kind, imports, sha256(source) AS digest FROM units""",
)
def code_units(spark, sf):
    files = corpus.keep_source_files(D.code_files(spark, sf))
    return units.extract_code_units(files).select(
        "repo_id", "file", "symbol", "start_line", "end_line", "kind", _joined("imports"), F.sha2("source", 256).alias("digest")
    )


@query(
    "code_units_in_sql",
    f"""WITH {D.CODE_UNITS}
    SELECT repo_id, file, symbol, start_line, end_line, kind, imports, sha256(source) AS digest FROM units""",
)
def code_units_in_sql(spark, sf):
    """The same units through the SQL table function."""
    from riskmill.functions.table_functions import register_table_functions

    register_table_functions(spark)
    corpus.keep_source_files(D.code_files(spark, sf)).createOrReplaceTempView("files_to_cut")
    return spark.sql(
        "SELECT repo_id, file, symbol, start_line, end_line, kind, array_join(imports, '|') AS imports, sha2(source, 256) AS digest "
        "FROM code_units_of(TABLE(files_to_cut))"
    )


def _match(text: str, pattern: str, cased: bool) -> str:
    flag = "" if cased else "(?i)"
    return f"regexp_matches({text}, {sql_text(flag + pattern)})"


def _rule_sql(rule: rules.Rule) -> str:
    text = "code" if rule.on_code else "source"
    conds = [f"kind = '{rule.kind}'"] if rule.kind else []
    conds += [_match(text, p, p in rule.cased) for p in rule.all_of]
    conds += ["NOT " + _match(text, p, p in rule.cased) for p in rule.none_of]
    trim = r"regexp_replace(x, '^\s+|\s+$', '', 'g')"
    if rule.allowed_values is not None:
        allowed = ", ".join(sql_text(v) for v in rule.allowed_values)
        every = f"list_filter(regexp_extract_all(source, {sql_text('(?i)' + rule.all_of[0])}, 1), lambda v: upper(v) NOT IN ({allowed}))"
        evidence = f"list_transform({every}[1:{rule.cap}], lambda v: 'currency: ''' || v || '''')"
        conds.append(f"len({every}) > 0")
    elif rule.evidence:
        parts = []
        for p in rule.evidence:
            lines = f"list_transform(list_filter(lines, lambda x: {_match('x', p, p in rule.cased)}), lambda x: {trim})"
            if rule.evidence_also:
                lines = f"list_filter({lines}, lambda x: {_match('x', rule.evidence_also, False)})"
            parts.append(lines)
        every = parts[0] if len(parts) == 1 else f"list_concat({', '.join(parts)})"
        evidence = f"({every})[1:{rule.cap}]"
        if rule.evidence_also:
            conds.append(f"len({every}) > 0")
    else:
        evidence = "[]::VARCHAR[]"
    scenarios = "|".join(rule.scenarios)
    return (
        f"SELECT repo_id, file, symbol, '{rule.rule_id}' AS rule_id, '{rule.defect_class}' AS defect_class, "
        f"'{rule.severity}' AS severity, {rule.confidence}::DOUBLE AS confidence, '{scenarios}' AS scenario_ids, "
        f"array_to_string({evidence}, '|') AS evidence_lines FROM stripped WHERE {' AND '.join(conds) or 'true'}"
    )


_STRIPPED = r"""stripped AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(source,
    '(?s)\"\"\".*?\"\"\"|''''''.*?''''''', '', 'g'), '(?m)#.*$', '', 'g'), '(?m)//.*$', '', 'g'), '(?s)/\*.*?\*/', '', 'g') AS code,
    CASE WHEN source LIKE '%' || chr(10) THEN string_split(source[:-2], chr(10)) ELSE string_split(source, chr(10)) END AS lines
  FROM units)""".replace('\\"', '"')

RULE_HITS_SQL = f"WITH {D.CODE_UNITS}, {_STRIPPED}, hits AS (" + " UNION ALL ".join(
    _rule_sql(r) for r in rules.SHOWN_RULES
) + ")"


def corpus_hits(spark, sf):
    files = corpus.keep_source_files(D.code_files(spark, sf))
    return rules.apply_rules(units.extract_code_units(files), rules.SHOWN_RULES)


def _flat_hits(hits):
    return hits.select(
        "repo_id", "file", "symbol", "rule_id", "defect_class", "severity", "confidence", _joined("scenario_ids"), _joined("evidence_lines")
    )


@query("rule_hits", RULE_HITS_SQL + " SELECT * FROM hits")
def rule_hits(spark, sf):
    return _flat_hits(corpus_hits(spark, sf))


@query(
    "rule_hit_counts",
    RULE_HITS_SQL + " SELECT rule_id, severity, count(*) AS hits, count(DISTINCT file) AS files FROM hits GROUP BY ALL",
)
def rule_hit_counts(spark, sf):
    return corpus_hits(spark, sf).groupBy("rule_id", "severity").agg(
        F.count(F.lit(1)).alias("hits"), F.count_distinct("file").alias("files")
    )


DOCUMENT_RULES = [
    rules.Rule("LIC", C.SUSPICIOUS_CONTENT, "LOW", 0.5, "Licence line", all_of=[r"licen[sc]e|copyright"], evidence=[r"licen[sc]e|copyright"], cap=3),
    rules.Rule("SEC", C.SUSPICIOUS_CONTENT, "HIGH", 0.9, "Secret", all_of=[r'(token|secret|key) = "'], none_of=["example"], evidence=[r'(token|secret|key) = "'], cap=3),
    rules.Rule("NUM", C.SUSPICIOUS_CONTENT, "MEDIUM", 0.6, "Long number", all_of=[r"[0-9]{10,}"], evidence=[r"[0-9]{10,}"], cap=3),
]
_DOC_LINES = "CASE WHEN text LIKE '%' || chr(10) THEN string_split(text[:-2], chr(10)) ELSE string_split(text, chr(10)) END"


@query(
    "rule_hits_docs",
    "SELECT source, rule_id, count(*) AS hits, CAST(sum(n) AS BIGINT) AS lines FROM ("
    + " UNION ALL ".join(
        f"SELECT source, '{r.rule_id}' AS rule_id, least(3, len(list_filter({_DOC_LINES}, lambda x: {_match('x', r.evidence[0], False)}))) AS n "
        f"FROM documents WHERE {_match('text', r.all_of[0], False)}" + "".join(f" AND NOT {_match('text', p, False)}" for p in r.none_of)
        for r in DOCUMENT_RULES
    )
    + ") GROUP BY ALL",
)
def rule_hits_docs(spark, sf):
    """User-defined rules over the documents as they are."""
    docs = table(spark, sf, "documents").select(F.col("text").alias("source"), F.lit("OTHER").alias("kind"), F.col("source").alias("src"))
    return rules.apply_rules(docs, DOCUMENT_RULES).groupBy(F.col("src").alias("source"), "rule_id").agg(
        F.count(F.lit(1)).alias("hits"), F.sum(F.size("evidence_lines")).cast("long").alias("lines")
    )


@query(
    "hits_by_severity",
    RULE_HITS_SQL + """ SELECT file, rule_id, severity, confidence,
      CASE severity WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 ELSE 3 END::BIGINT AS severity_rank
      FROM hits WHERE confidence >= 0.6""",
)
def hits_by_severity(spark, sf):
    """All hits of at least 0.6 confidence, the most severe and most confident first."""
    hits = corpus_hits(spark, sf).filter(F.col("confidence") >= 0.6)
    rank = S.severity_rank(F.col("severity")).cast("long").alias("severity_rank")
    rows = hits.select("file", "rule_id", "severity", "confidence", rank)
    return rows.orderBy("severity_rank", F.desc("confidence"), "file", "rule_id")


@query(
    "preflight_repositories",
    f"""WITH {D.CODE_FILES}
    SELECT repo_id, coalesce(bool_or(path LIKE '%.py' AND contains(lower(content), 'razorpay')), false) AS manifest_present,
           count(*) FILTER (path LIKE '%.py') AS file_count,
           2 * count(*) FILTER (path LIKE '%.py' AND contains(lower(content), 'razorpay')) AS payment_units_estimated
    FROM code_files GROUP BY 1""",
)
def preflight_repositories(spark, sf):
    return serving.preflight(D.code_files(spark, sf))


# --- fusion --------------------------------------------------------------------------------

_FUSED = f"""{D.DETECTIONS}, agg AS (
  SELECT repo_id, file, defect_class,
         bool_or(src = 0) AS static_hit, coalesce(max(confidence) FILTER (src = 0), 0.0) AS static_conf,
         count(DISTINCT rule_id) AS n_rules, bool_or(src = 1) AS llm_hit,
         coalesce(max(confidence) FILTER (src = 1), 0.0) AS llm_conf, count(*) FILTER (src = 1) AS n_llm,
         min(rank) AS rank, min(low) AS low, max(high) AS high,
         array_to_string(list_sort(list_distinct(list(rule_id) FILTER (rule_id IS NOT NULL))), '|') AS rule_ids
  FROM tagged GROUP BY ALL),
static_best AS (SELECT repo_id, file, defect_class, explanation FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, file, defect_class ORDER BY confidence DESC, a, b) AS rn FROM tagged WHERE src = 0) WHERE rn = 1),
model_best AS (SELECT repo_id, file, defect_class, explanation FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, file, defect_class ORDER BY confidence DESC, a, b) AS rn FROM tagged WHERE src = 1) WHERE rn = 1),
model_first AS (SELECT repo_id, file, defect_class, explanation FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, file, defect_class ORDER BY a, b) AS rn FROM tagged WHERE src = 1) WHERE rn = 1),
items AS (SELECT repo_id, file, defect_class, v, min((src, a, b, i)) AS pos FROM (
    SELECT *, ev0 AS v, 0 AS i FROM tagged UNION ALL SELECT *, ev1 AS v, 1 AS i FROM tagged) GROUP BY repo_id, file, defect_class, v),
evidence AS (SELECT repo_id, file, defect_class, string_agg(v, '|' ORDER BY pos) AS evidence_lines FROM (
    SELECT *, row_number() OVER (PARTITION BY repo_id, file, defect_class ORDER BY pos) AS rn FROM items) WHERE rn <= 20 GROUP BY ALL),
scen AS (SELECT repo_id, file, defect_class, string_agg(scenario, '|' ORDER BY pos) AS scenario_ids FROM (
    SELECT repo_id, file, defect_class, scenario, min((src, a, b)) AS pos FROM tagged GROUP BY repo_id, file, defect_class, scenario) GROUP BY ALL),
fused AS (
  SELECT repo_id, file, defect_class,
    CASE WHEN static_hit AND llm_hit THEN 'BOTH' WHEN static_hit THEN 'STATIC' ELSE 'LLM' END AS detector_source,
    round(greatest(static_conf, llm_conf), 4) AS confidence,
    coalesce(CASE rank WHEN 0 THEN 'CRITICAL' WHEN 1 THEN 'HIGH' WHEN 2 THEN 'MEDIUM' WHEN 3 THEN 'LOW' END,
      CASE defect_class WHEN '{C.WEBHOOK_INTEGRITY}' THEN 'CRITICAL' WHEN '{C.SUSPICIOUS_CONTENT}' THEN 'MEDIUM' ELSE 'HIGH' END) AS severity,
    evidence_lines, coalesce(rule_ids, '') AS rule_ids, scenario_ids,
    CASE WHEN static_hit AND static_conf >= llm_conf THEN sb.explanation ELSE mb.explanation END AS explanation,
    CASE WHEN static_hit AND static_conf >= llm_conf THEN mf.explanation ELSE mb.explanation END AS llm_reasoning,
    CASE WHEN NOT static_hit AND low IS NOT NULL THEN low ELSE 1 END AS start_line,
    CASE WHEN NOT static_hit AND low IS NOT NULL THEN high ELSE 1 END AS end_line,
    CASE defect_class WHEN '{C.DUPLICATE_PAYMENT}' THEN 15000 WHEN '{C.WEBHOOK_INTEGRITY}' THEN 50000 WHEN '{C.AMOUNT_CURRENCY}' THEN 9900 ELSE 10000 END::BIGINT AS exposure_estimated_paise,
    static_hit, llm_hit, n_rules, n_llm, static_conf, llm_conf,
    round(least(1.0, CASE WHEN static_hit THEN 0.55 + 0.2 * static_conf + 0.05 * least(greatest(n_rules - 1, 0), 2) ELSE 0 END
      + CASE WHEN llm_hit THEN 0.25 + 0.15 * llm_conf + 0.03 * least(greatest(n_llm - 1, 0), 3) + 0.05 ELSE 0 END
      + CASE WHEN static_hit AND llm_hit THEN 0.15 ELSE 0 END)::DOUBLE, 4) AS score
  FROM agg LEFT JOIN static_best sb USING (repo_id, file, defect_class) LEFT JOIN model_best mb USING (repo_id, file, defect_class)
    LEFT JOIN model_first mf USING (repo_id, file, defect_class) JOIN evidence USING (repo_id, file, defect_class) JOIN scen USING (repo_id, file, defect_class))"""


def fused_findings(spark, sf):
    hits, model = D.detections(spark, sf)
    return fusion.score_findings(fusion.merge_findings(hits, model, evidence_cap=C.EVIDENCE_CAP))


@query(
    "findings_merge",
    f"""WITH {_FUSED} SELECT repo_id, file, defect_class, detector_source, confidence, severity, evidence_lines, rule_ids, scenario_ids,
      explanation, llm_reasoning, start_line, end_line, exposure_estimated_paise, score FROM fused""",
)
def findings_merge(spark, sf):
    return fused_findings(spark, sf).select(
        "repo_id", "file", "defect_class", "detector_source", "confidence", "severity", _joined("evidence_lines"),
        _joined("rule_ids"), _joined("scenario_ids"), "explanation", "llm_reasoning", "start_line", "end_line",
        "exposure_estimated_paise", "score",
    )


@query(
    "risk_records",
    f"""WITH {_FUSED} SELECT repo_id, file, defect_class, score, 'ESTIMATED' AS exposure_kind, 'heuristic-v1' AS scorer_version, false AS calibrated,
      greatest(static_conf, llm_conf) AS risk_confidence,
      concat_ws('|', CASE WHEN static_hit THEN 'static:' || defect_class || ':n_rules=' || n_rules END,
        CASE WHEN llm_hit THEN 'llm:' || defect_class || ':n_findings=' || n_llm END) AS risk_evidence,
      score >= 0.45 AS above_threshold FROM fused""",
)
def risk_records(spark, sf):
    hits, model = D.detections(spark, sf)
    features = fusion.feature_vectors(fusion.tag_detections(hits, model))
    return fusion.risk_records(features).select(
        "repo_id", "file", "defect_class", "score", "exposure_kind", "scorer_version", "calibrated", "risk_confidence",
        _joined("risk_evidence"), (F.col("score") >= S.threshold_for(F.col("defect_class"))).alias("above_threshold"),
    )


@query(
    "highest_risk_per_file",
    f"""WITH {_FUSED} SELECT repo_id, file, defect_class, score FROM (
      SELECT *, row_number() OVER (PARTITION BY repo_id, file ORDER BY score DESC, CASE defect_class WHEN '{C.DUPLICATE_PAYMENT}' THEN 0
        WHEN '{C.WEBHOOK_INTEGRITY}' THEN 1 WHEN '{C.AMOUNT_CURRENCY}' THEN 2 ELSE 3 END) AS rn FROM fused) WHERE rn = 1""",
)
def highest_risk_per_file(spark, sf):
    hits, model = D.detections(spark, sf)
    records = fusion.risk_records(fusion.feature_vectors(fusion.tag_detections(hits, model)))
    return fusion.highest_risk(records, ["repo_id", "file"])


@query(
    "expected_loss_by_class",
    f"""WITH {_FUSED} SELECT defect_class, count(*) AS n, round(sum(CASE defect_class WHEN '{C.DUPLICATE_PAYMENT}' THEN 0.2 * 0.05 WHEN '{C.WEBHOOK_INTEGRITY}' THEN 0.1 * 0.02
       WHEN '{C.AMOUNT_CURRENCY}' THEN 0.3 * 1.0 ELSE 0.15 END::DOUBLE * 3000 * exposure_estimated_paise), 2) AS expected_loss_paise, 'ESTIMATED' AS kind FROM fused GROUP BY 1""",
)
def expected_loss_by_class(spark, sf):
    loss = S.expected_loss(F.col("defect_class"), F.col("exposure_estimated_paise"))
    return fused_findings(spark, sf).groupBy("defect_class").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum(loss), 2).alias("expected_loss_paise"), F.lit("ESTIMATED").alias("kind")
    )


@query(
    "corpus_findings",
    RULE_HITS_SQL + """, f AS (SELECT repo_id, file, defect_class, count(DISTINCT rule_id) AS n_rules, max(confidence) AS c FROM hits GROUP BY ALL),
     last AS (SELECT repo_id, file, start_line, end_line FROM units)
     SELECT f.repo_id, f.file, f.defect_class, n_rules, round(c, 4) AS confidence, start_line, end_line,
       round(least(1.0, 0.55 + 0.2 * c + 0.05 * least(n_rules - 1, 2))::DOUBLE, 4) AS score
     FROM f JOIN last ON last.repo_id = f.repo_id AND last.file = f.file""",
)
def corpus_findings(spark, sf):
    """The whole scan: files, units, rules, merge, score."""
    from riskmill.plans.scan import scan_corpus

    found = scan_corpus(D.code_files(spark, sf), evidence_cap=C.EVIDENCE_CAP)["findings"]
    return found.select(
        "repo_id", "file", "defect_class", F.col("static_n_rules").cast("long").alias("n_rules"), "confidence", "start_line", "end_line", "score"
    )


@query(
    "scan_statistics",
    RULE_HITS_SQL + """, f AS (SELECT repo_id, count(*) AS n FROM (SELECT DISTINCT repo_id, file, defect_class FROM hits) GROUP BY 1)
     SELECT s.repo_id, count(*) FILTER (path LIKE '%.py') AS py_files, count(*) FILTER (path NOT LIKE '%.py') AS js_files,
       coalesce(any_value(u.n), 0) AS n_units, coalesce(any_value(h.n), 0) AS n_static_hits, coalesce(any_value(f.n), 0) AS n_findings
     FROM source_files s LEFT JOIN (SELECT repo_id, count(*) AS n FROM units GROUP BY 1) u ON u.repo_id = s.repo_id
       LEFT JOIN (SELECT repo_id, count(*) AS n FROM hits GROUP BY 1) h ON h.repo_id = s.repo_id LEFT JOIN f ON f.repo_id = s.repo_id GROUP BY 1""",
)
def scan_statistics(spark, sf):
    from riskmill.plans.scan import scan_corpus

    stages = scan_corpus(D.code_files(spark, sf), evidence_cap=C.EVIDENCE_CAP)
    stats = serving.scan_statistics(stages["files"], stages["units"], stages["hits"], stages["model"], stages["findings"])
    return stats.filter("py_files + js_files > 0").drop("n_llm_findings")


# --- hashing -------------------------------------------------------------------------------

_KEY = "whsec_demo"
_IPAD = "".join(f"{b ^ 0x36:02x}" for b in _KEY.encode().ljust(64, b"\0"))
_OPAD = "".join(f"{b ^ 0x5C:02x}" for b in _KEY.encode().ljust(64, b"\0"))


def hmac_sql(body: str) -> str:
    return f"sha256(unhex('{_OPAD}') || unhex(sha256(unhex('{_IPAD}') || encode({body}))))"


@query("hmac_docs", f"SELECT doc_id, {hmac_sql('text')} AS signature FROM documents")
def hmac_docs(spark, sf):
    return table(spark, sf, "documents").select("doc_id", H.hmac_sha256(F.col("text"), _KEY).alias("signature"))


@query("checkout_signatures", f"SELECT o_orderkey, {hmac_sql('o_orderkey || $$|$$ || o_custkey')} AS signature FROM orders")
def checkout_signatures(spark, sf):
    signature = H.checkout_signature(F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string"), _KEY)
    return table(spark, sf, "orders").select("o_orderkey", signature.alias("signature"))


@query("canonical_metadata", "SELECT event_id, replace(props, ' ', '') AS canonical FROM events")
def canonical_metadata(spark, sf):
    return table(spark, sf, "events").select("event_id", H.canonical_json("props").alias("canonical"))
