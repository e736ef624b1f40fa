"""The merge against a plain walk over the lists, and the score's properties."""

import random

from pyspark.sql import functions as F

from riskmill import config as C
from riskmill.functions import scoring as S
from riskmill.operators import fusion
from riskmill.schemas import HITS, MODEL_FINDINGS


def expected(hits, model):
    out = {}
    for key in {h[:2] + (h[5],) for h in hits} | {m[:2] + (m[4],) for m in model}:
        s = sorted((h for h in hits if h[:2] + (h[5],) == key), key=lambda h: (h[2], h[3]))
        m = sorted((x for x in model if x[:2] + (x[4],) == key), key=lambda x: (x[2], x[3]))
        evidence = list(dict.fromkeys([e for h in s for e in h[8]] + [str(e) for x in m for e in x[7]]))[:20]
        scenarios = list(dict.fromkeys([e for h in s for e in h[10]] + [e for x in m for e in x[8]]))
        sc, mc = max((h[7] for h in s), default=0.0), max((x[5] for x in m), default=0.0)
        best_m = max(m, key=lambda x: x[5])[6] if m else None
        if s and sc >= mc:
            text, reason = max(s, key=lambda h: h[7])[9], (m[0][6] if m else None)
        else:
            text, reason = best_m, best_m
        ranks = [C.SEVERITY_ORDER.index(h[6]) for h in s]
        severity = C.SEVERITY_ORDER[min(ranks)] if ranks else C.CLASS_SEVERITY.get(key[2], "MEDIUM")
        lines = [n for x in m for n in x[7] if n > 0]
        span = (min(lines), max(lines)) if not s and lines else (1, 1)
        default = C.CLASS_DEFAULT_SCENARIO.get(key[2])
        out[key] = (
            "BOTH" if s and m else "STATIC" if s else "LLM", max(sc, mc), severity, evidence, sorted({h[4] for h in s}),
            scenarios or ([default] if default else []), text, reason, span, len(m), any(x[7] for x in m),
        )
    return out


def test_merge_is_the_plain_walk(spark):
    rng = random.Random(7)
    classes = [*C.EVAL_CLASSES, C.SUSPICIOUS_CONTENT]
    hits, model = [], []
    for i in range(300):
        file = rng.choice(["hot"] * 5 + ["a", "b", "c"])
        if rng.random() < 0.6:
            hits.append((
                "r", file, i, rng.randrange(13), f"R{rng.randrange(5)}", rng.choice(classes), rng.choice(C.SEVERITY_ORDER), rng.randrange(10) / 10,
                [f"l{rng.randrange(60)}" for _ in range(rng.randrange(4))], f"s{i}", [f"S{rng.randrange(4)}"][: rng.randrange(2)],
            ))
        else:
            model.append((
                "r", file, i, rng.randrange(3), rng.choice(C.EVAL_CLASSES), rng.randrange(10) / 10, f"m{i}",
                [rng.randrange(-2, 60) for _ in range(rng.randrange(3))], [f"S{rng.randrange(4)}"][: rng.randrange(2)],
            ))
    want = expected(hits, model)
    for parts in (1, 7):
        h = spark.createDataFrame(hits, HITS).repartition(parts)
        m = spark.createDataFrame(model, MODEL_FINDINGS).repartition(parts)
        rows = fusion.merge_findings(h, m, evidence_cap=20).collect()
        got = {
            (r.repo_id, r.file, r.defect_class): (
                r.detector_source, r.confidence, r.severity, r.evidence_lines, r.rule_ids, r.scenario_ids, r.explanation, r.llm_reasoning,
                (r.start_line, r.end_line), r.llm_n_findings, r.llm_has_evidence_lines,
            )
            for r in rows
        }
        assert got == want


def test_score_is_capped_and_monotone(spark):
    rows = [(s, sc / 10, n, m, mc / 10, k, e) for s in (True, False) for sc in (0, 5, 10) for n in (1, 2, 9) for m in (True, False) for mc in (0, 10) for k in (1, 9) for e in (True, False)]
    df = spark.createDataFrame(rows, "s boolean, sc double, n int, m boolean, mc double, k int, e boolean")
    scored = df.withColumn("score", S.heuristic_score(*[F.col(c) for c in ("s", "sc", "n", "m", "mc", "k", "e")])).collect()
    assert all(0 <= r.score <= 1 for r in scored)
    by = {tuple(r)[:-1]: r.score for r in scored}
    for (s, sc, n, m, mc, k, e), score in by.items():
        if s and m:
            assert score >= by[s, sc, n, False, mc, k, e] and score >= by[False, sc, n, m, mc, k, e]
        if s and sc == 0.0:
            assert by[s, 1.0, n, m, mc, k, e] >= score
    assert by[True, 0.5, 1, False, 0.0, 1, False] > by[False, 0.5, 1, True, 1.0, 1, True]


def test_missing_lists_count_as_empty(spark):
    m = spark.createDataFrame([("r", "f", 0, 0, C.AMOUNT_CURRENCY, 0.5, "m", None, None)], MODEL_FINDINGS)
    row = fusion.merge_findings(spark.createDataFrame([], HITS), m).first()
    assert (row.evidence_lines, row.scenario_ids, row.llm_has_evidence_lines, row.detector_source) == ([], ["AC-1"], False, "LLM")
