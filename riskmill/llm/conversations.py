"""Operator 11: conversation structure repair on a suffix-shared DAWG.

Method: every row of a conversation becomes one sign, its role's initial and its fault, and a conversation
the string of its signs. Least edits depend on that string alone, so each distinct string is repaired
once. The strings are sorted from their ends over all conversations; read in that order they build
an automaton whose node stands for a suffix and is shared by every string that ends in it. When a node is made,
its cost-to-go and the first edit of its best audit are computed once for each of the four
grammar states from the node behind it; a string's audit is then read off along its nodes. Nodes that no
later string can share are dropped, so memory is one path.

Faults, the first that holds: blank (no sign but white space), duplicate (same role and text in an earlier row),
truncated (the last sign that is not white space is none of ``.!?``). Edits: Keep 0, Rerole to user or
assistant 1, Delete 2 (a must for blank and duplicate rows), Insert an empty user or assistant row 5; a truncated
row that stays adds 5. The repaired roles match ``(s?(ua)+)?`` by initial; among cheapest audits the
ASCII-least is taken, which with the grammar fixes every role.

Rows pass through tasks as sorted streams. What is held of a conversation is its signs or its
audit (a byte a row); identical rows of a turn are one row with a count, duplicates are found by a partial
aggregate. A text digest is sequential by definition, so one conversation's rows end in one task, as a stream.

Defined cases: null role and text are one space, as is a null number in the damage key; a null conv_id is a
conversation of its own, null turns come first. Rows of one turn come in order of role and text (bytes).
A conversation without rows has zeros, an empty audit and the digest of an empty text. Roles of
other initials fit nowhere and must be reroled or deleted. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskmill.llm.common import stored
from riskmill.session import task_width

INSERT, REROLE, DELETE, TRUNCATED = 5, 1, 2, 5
#: Grammar states: nothing yet, after system, after user, after assistant; a repaired conversation ends in 0 or 3.
START, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (START, ASSISTANT)
#: What each state asks for next, and the state after it.
NEXT = {START: ("user", USER), SYSTEM: ("user", USER), USER: ("assistant", ASSISTANT), ASSISTANT: ("user", USER)}
NEVER = 1 << 60

#: Signs of rows that must go; the others are their initial (x: any but s, u and a), in upper case if truncated.
BLANK, DUPLICATE = "b", "d"


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, n: identical rows of a turn once, with their count (0: dropped)."""
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    hit = F.crc32(key.cast("binary")) % 20
    text = F.coalesce("text", F.lit(" "))
    text = F.when(hit == 1, "").when(hit == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    role = F.when(hit == 4, "user").otherwise(F.coalesce("role", F.lit(" ")))
    times = F.when(hit == 0, 0).when(hit == 3, 2).otherwise(1)
    rows = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), times.alias("times"))
    return rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("times").alias("n"))


def signed(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, n and what a row is: initial, fault of its first copy (blank, truncated or none), fresh."""
    name = F.sha2(F.concat_ws(":", F.length("role").cast("string"), "role", "text"), 256)
    some = rows.where("n > 0").withColumn("name", name)
    first = some.groupBy("conv_id", "name").agg(F.min(F.struct(F.col("turn").isNotNull(), "turn")).alias("first"))
    first = first.select(F.col("conv_id").alias("c"), F.col("name").alias("m"), F.col("first.turn").alias("first_turn"))
    joined = some.join(first, (F.col("name") == F.col("m")) & F.col("conv_id").eqNullSafe(F.col("c")))
    last = F.right(F.rtrim("text", F.lit("\x20\x09\x0a\x0b\x0c\x0d")), F.lit(1))
    return joined.select(
        "conv_id",
        "turn",
        "role",
        "text",
        "n",
        F.coalesce(F.nullif(F.regexp_extract("role", "^[sua]", 0), F.lit("")), F.lit("x")).alias("initial"),
        (last == "").alias("blank"),
        (~last.isin(".", "!", "?")).alias("cut"),
        F.col("turn").eqNullSafe(F.col("first_turn")).alias("fresh"),
    )


def signs(initial: str, blank: bool, cut: bool, fresh: bool, n: int) -> str:
    """The signs of ``n`` identical rows of a turn."""
    if blank:
        return BLANK * n
    own = initial.upper() if cut else initial
    return own + DUPLICATE * (n - 1) if fresh else DUPLICATE * n


class SuffixDawg:
    """Nodes of the suffixes of strings that are added in order of their reversal.

    Node ``k`` of the current path stands for the last ``k`` signs. ``cost[k][g]`` is the least cost from grammar
    state ``g`` over these signs to an end, ``edit[k][g]`` the first edit of the least audit.
    """

    def __init__(self):
        self.path = ""
        self.cost: list[tuple] = []
        self.edit: list[tuple] = []
        self.made = 0
        self._node(None, [0 if g in ENDS else NEVER for g in range(4)], ["" if g in ENDS else "Z" for g in range(4)])

    def _node(self, sign: str | None, cost: list, edit: list) -> None:
        # inserting keeps the node and changes the state; two rounds reach every state from every other
        for _ in range(2):
            for g in range(4):
                price = INSERT + cost[NEXT[g][1]]
                if price < cost[g] or (price == cost[g] and "I" < edit[g]):
                    cost[g], edit[g] = price, "I"
        self.cost.append(tuple(cost))
        self.edit.append(tuple(edit))
        self.made += sign is not None

    def _push(self, sign: str) -> None:
        after = self.cost[-1]
        cost = [DELETE + after[g] for g in range(4)]
        edit = ["D"] * 4
        if sign not in (BLANK, DUPLICATE):
            stay = TRUNCATED if sign.isupper() else 0
            initial = sign.lower()
            for g in range(4):
                role, then = NEXT[g]
                for price, to, name in ((0, kept_state(g, initial), "K"), (REROLE, then, "R")):
                    if to is not None and price + stay + after[to] < cost[g]:
                        cost[g], edit[g] = price + stay + after[to], name
        self._node(sign, cost, edit)

    def add(self, reversed_signs: str) -> None:
        common = 0
        for a, b in zip(self.path, reversed_signs):
            if a != b:
                break
            common += 1
        del self.cost[common + 1 :], self.edit[common + 1 :]
        for sign in reversed_signs[common:]:
            self._push(sign)
        self.path = reversed_signs

    def best(self) -> tuple[int, str]:
        """Cost and audit of the string added last."""
        k, g, out = len(self.path), START, []
        while (edit := self.edit[k][g]) != "":
            out.append(edit)
            if edit == "K":
                g = kept_state(g, self.path[k - 1].lower())
            elif edit != "D":
                g = NEXT[g][1]
            k -= edit != "I"
        return self.cost[-1][START], "".join(out)


def kept_state(state: int, initial: str) -> int | None:
    """The grammar state after a row of this initial is kept, None if it may not be."""
    if initial == "s":
        return SYSTEM if state == START else None
    return NEXT[state][1] if initial == NEXT[state][0][0] else None


def illegal_pairs(initials: str) -> int:
    return sum(pair not in ("su", "ua", "au") for pair in map("".join, zip(initials, initials[1:])))


def signatures(rows: DataFrame) -> DataFrame:
    """conv_id, signs, blank, duplicate, truncated, illegal, gaps of every conversation that has rows."""
    number = rows.schema["conv_id"].dataType.simpleString()
    columns = ["conv_id", "initial", "blank", "cut", "fresh", "n", "turn"]
    dealt = rows.repartition(task_width(rows.sparkSession), "conv_id")
    dealt = dealt.sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text").select(columns)
    kind = f"conv_id {number}, signs string, blank bigint, duplicate bigint, truncated bigint, illegal bigint, gaps bigint"

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for conv, group in _runs(batches, columns):
            parts, illegal, last, low, high, distinct = [], 0, "", None, None, 0
            for initial, blank, cut, fresh, n, turn in group:
                parts.append(signs(initial, blank, cut, fresh, n))
                illegal += illegal_pairs(last + initial * n)
                last = initial
                if turn is not None:
                    low = turn if low is None else low
                    distinct += turn != high
                    high = turn
            whole = "".join(parts)
            cut_rows = sum(map(str.isupper, whole))
            gaps = 0 if low is None else high - low + 1 - distinct
            out.append((conv, whole, whole.count(BLANK), whole.count(DUPLICATE), cut_rows, illegal, gaps))
            if len(out) == 4096:
                yield _batch(out, kind)
                out = []
        if out:
            yield _batch(out, kind)

    return dealt.mapInArrow(summed, kind)


def audits(signatures: DataFrame) -> DataFrame:
    """signs, cost, audit of every distinct string of signs; nodes are shared inside ranges of reversed strings."""
    distinct = signatures.groupBy("signs").agg(F.lit(0).alias("_"))
    backwards = distinct.select(F.reverse("signs").alias("back"))
    sorted_back = backwards.repartitionByRange(task_width(signatures.sparkSession), "back").sortWithinPartitions("back")
    kind = "signs string, cost bigint, audit string"

    def repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dawg = SuffixDawg()
        for batch in batches:
            out = []
            for back in batch.column(0).to_pylist():
                dawg.add(back)
                out.append((back[::-1], *dawg.best()))
            yield _batch(out, kind)

    return sorted_back.mapInArrow(repaired, kind)


def edited(rows: Iterable[tuple[str, str]], signs: str, audit: str) -> Iterator[tuple[str, str]]:
    """The repaired (role, text) rows of one conversation."""
    state, at, rows = START, 0, iter(rows)
    for edit in audit:
        if edit == "I":
            role, state = NEXT[state]
            yield role, ""
            continue
        role, text = next(rows)
        if edit == "K":
            state = kept_state(state, signs[at].lower())
            yield role, text
        elif edit == "R":
            role, state = NEXT[state]
            yield role, text
        at += 1


def digests(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """conv_id, repaired_sha256: every conversation's rows streamed behind its plan (conv_id, signs, audit)."""
    number = rows.schema["conv_id"].dataType.simpleString()
    turn = rows.schema["turn"].dataType.simpleString()
    head = plans.select(
        "conv_id",
        F.lit(0).alias("kind"),
        F.lit(None).cast(turn).alias("turn"),
        F.col("signs").alias("role"),
        F.col("audit").alias("text"),
        F.lit(1).cast("bigint").alias("n"),
    )
    both = head.unionByName(rows.select("conv_id", F.lit(1).alias("kind"), "turn", "role", "text", "n"))
    columns = ["conv_id", "kind", "role", "text", "n"]
    dealt = both.repartition(task_width(rows.sparkSession), "conv_id")
    dealt = dealt.sortWithinPartitions("conv_id", "kind", F.col("turn").asc_nulls_first(), "role", "text").select(columns)
    kind = f"conv_id {number}, repaired_sha256 string"

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for conv, group in _runs(batches, columns):
            _, signs, audit, _ = next(group)
            copies = ((role, text) for _, role, text, n in group for _ in range(n))
            digest, between = hashlib.sha256(), b""
            for role, text in edited(copies, signs, audit):
                digest.update(between + f"{role}:{text}".encode())
                between = b"\n"
            out.append((conv, digest.hexdigest()))
            if len(out) == 4096:
                yield _batch(out, kind)
                out = []
        if out:
            yield _batch(out, kind)

    return dealt.mapInArrow(hashed, kind)


def _runs(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple]:
    """(conv_id, iterator over the other columns) of every run of one conv_id in sorted batches."""
    rows = (row for batch in batches for row in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in columns)))
    row = next(rows, None)
    while row is not None:
        conv, held = row[0], [row]

        def group():
            while held[0] is not None and held[0][0] == conv:
                yield held[0][1:]
                held[0] = next(rows, None)

        own = group()
        yield conv, own
        for _ in own:  # what the caller left unread
            pass
        row = held[0]


_TYPES = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}


def _batch(rows: list[tuple], kind: str) -> pa.RecordBatch:
    fields = [f.split() for f in kind.split(", ")]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, _TYPES[t]) for c, (_, t) in zip(zip(*rows), fields)], names=[n for n, _ in fields]
    )


def repaired_rows(conversations: DataFrame) -> DataFrame:
    """One row per original conv_id; see the module's docstring."""
    rows = stored(damaged(conversations.select("conv_id", "turn", "role", "text")), "turns")
    marked = stored(signed(rows), "signed-turns")
    found = stored(signatures(marked), "conversation-signs")
    plans = found.join(stored(audits(found), "audits"), "signs")
    plans = stored(plans, "plans")
    hashes = digests(marked, plans.select("conv_id", "signs", "audit"))
    hashes = hashes.withColumnRenamed("conv_id", "h")
    done = plans.join(hashes, F.col("conv_id").eqNullSafe(F.col("h")))
    everyone = rows.select(F.col("conv_id").alias("c")).distinct()
    joined = everyone.join(done, F.col("c").eqNullSafe(F.col("conv_id")), "left")
    zero = [F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return joined.select(
        F.col("c").alias("conv_id"),
        *zero,
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"),
    )


def op11_conversation_repair(spark, sf_dir: str) -> DataFrame:
    return repaired_rows(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
