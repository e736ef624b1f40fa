"""Conversation repair against a search over all edits, and against its SQL."""

import hashlib
import heapq
import itertools
import random
import re
import zlib

import duckdb
import pytest
from riskmill.llm import conversations as op
from riskmill.llm.sql import CONVERSATION_REPAIR

ROWS = "conv_id bigint, turn bigint, role string, text string, n int, signs string, audit string"


def search(rows):
    """Least (cost, audit, repaired rows) by uniform-cost search; rows are (role, text, fault)."""
    heap = [(0, "", 0, ())]
    while True:
        cost, audit, at, out = heapq.heappop(heap)
        line = "".join(role[:1] or "x" for role, _ in out)
        if at == len(rows) and re.fullmatch("(s?(ua)+)?", line):
            return cost, audit, out
        if not any(re.fullmatch("(s?(ua)+)?", line + rest) for rest in ("", "a", "ua")):
            continue
        if not audit.endswith("III"):
            for role in ("user", "assistant"):
                heapq.heappush(heap, (cost + 5, audit + "I", at, (*out, (role, ""))))
        if at < len(rows):
            role, text, fault = rows[at]
            heapq.heappush(heap, (cost + 2, audit + "D", at + 1, out))
            if fault in ("", "truncated"):
                stay = 5 if fault else 0
                heapq.heappush(heap, (cost + stay, audit + "K", at + 1, (*out, (role, text))))
                for new in ("user", "assistant"):
                    heapq.heappush(heap, (cost + stay + 1, audit + "R", at + 1, (*out, (new, text))))


def brute(rows):
    order, out = {}, []
    for conv, turn, role, text, *_ in rows:
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        hit = zlib.crc32(key.encode()) % 20
        text = "" if hit == 1 else re.sub("[.!?]", "", text) if hit == 2 else text
        role = "user" if hit == 4 else role
        order.setdefault(conv, []).extend([(turn, role, text)] * {0: 0, 3: 2}.get(hit, 1))
    for conv, group in order.items():
        group.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, marked = set(), []
        for _, role, text in group:
            inner = text.strip("\x20\x09\x0a\x0b\x0c\x0d")
            fault = "blank" if not inner else "duplicate" if (role, text) in seen else "" if inner[-1] in ".!?" else "truncated"
            seen.add((role, text))
            marked.append((role, text, fault))
        turns = [t for t, *_ in group if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        faults = [sum(f == kind for *_, f in marked) for kind in ("blank", "duplicate", "truncated")]
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(marked, marked[1:]))
        cost, audit, rows_out = search(marked)
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in rows_out).encode()).hexdigest()
        out.append((conv is None, conv or 0, gaps, *faults, illegal, cost, audit, sha))
    return sorted(out)


def table(seed=4, n=220, top=6):
    rng = random.Random(seed)
    rows = []
    for conv in range(n):
        roles = itertools.cycle(["user", "assistant"])
        for turn in range(rng.randrange(1, top)):
            role = next(roles) if rng.random() < 0.8 else rng.choice(["system", "user", "assistant", "tool", "", "User", None])
            if turn == 0 and rng.random() < 0.3:
                role = "system"
            text = rng.choice(["Yes.", "No!", "well", "é?", "", " \n", None, "same.", "a b. \t", "...", f"t{rng.random()}."])
            rows.append((conv, None if rng.random() < 0.05 else turn * rng.choice([1, 1, 2]), role, text, 1, "x", "y"))
            if rng.random() < 0.1:
                rows.append(rows[-1])
    rows += [(None, 1, "user", "Hi.", 0, "", ""), (None, None, None, None, 0, "", ""), (None, 2, "assistant", "Yo.", 0, "", "")]
    dropped = next(c for c in itertools.count(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    return [*rows, (dropped, 0, "user", "Gone.", 0, "", "")]


def answer(rows):
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    return sorted((r["conv_id"] is None, r["conv_id"] or 0, *(r[n] for n in names)) for r in rows)


@pytest.fixture(scope="module")
def found(spark):
    return answer(op.repaired_rows(spark.createDataFrame(table(), ROWS).repartition(4)).collect())


def test_repairs_are_the_cheapest_and_least(found):
    assert found == brute(table())


def test_sql_agrees(found):
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", [r[:4] for r in table()])
    rel = con.sql(CONVERSATION_REPAIR)
    assert answer([dict(zip(rel.columns, r)) for r in rel.fetchall()]) == found


def test_nodes_are_shared_by_equal_suffixes_and_states_agree_with_the_search():
    rng = random.Random(9)
    lines = {"".join(rng.choice("suaxUAbd") for _ in range(rng.randrange(0, 7))) for _ in range(300)}
    dawg = op.SuffixDawg()
    for back in sorted(s[::-1] for s in lines):
        dawg.add(back)
        rows = [(f"{s.lower()}role", "t", {"b": "blank", "d": "duplicate"}.get(s, "truncated" if s.isupper() else "")) for s in back[::-1]]
        assert dawg.best() == search(rows)[:2]
    assert dawg.made == len({s[i:] for s in lines for i in range(len(s))})


def test_long_conversations_and_empty_tables(spark):
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", f"{i}.", 0, "", "") for i in range(20000)]
    rows += [(2, 0, "user", "same.", 0, "", "")] * 3000
    long, hot = op.repaired_rows(spark.createDataFrame(rows, ROWS)).orderBy("conv_id").collect()
    hits = [zlib.crc32(f"1:{i}".encode()) % 20 for i in range(20000)]
    assert len(long.audit.replace("I", "")) == 20000 - hits.count(0) + hits.count(3)
    assert hot.audit.count("D") >= 2998
    assert op.repaired_rows(spark.createDataFrame([], ROWS)).collect() == []
