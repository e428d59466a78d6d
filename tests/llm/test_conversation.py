"""Conversation repair against a search over all edits by recursion from the end."""

import hashlib
import random
import re
import zlib
from functools import cache

import pytest
from pyspark.sql import types as T

from pagemill.llm import conversation
from pagemill.llm.conversation import parse, repair_conversations
from pagemill.llm.queries import QUERIES

ROW = T.StructType([
    T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()),
    T.StructField("text", T.StringType()), T.StructField("audit", T.StringType()),
])
WHITE = " \t\n\x0b\x0c\r"
EMPTY = hashlib.sha256(b"").hexdigest()


def repair(rows, insert=5):
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, repaired lines) of rows (turn, role, text) in order."""
    faults, seen = [], set()
    for _, role, text in rows:
        body = text.rstrip(WHITE)
        faults.append("b" if not body else "d" if (role, text) in seen else "t" if body[-1] not in ".!?" else "-")
        seen.add((role, text))

    @cache
    def best(at, last, inserts):
        """Cheapest (cost, audit) of the rest, after ``last`` and so many inserts in a row."""
        out = [(0, "")] if at == len(rows) and last in ("", "a") else []
        due = "a" if last == "u" else "u"
        if inserts < 2:
            cost, audit = best(at, due, inserts + 1)
            out.append((cost + insert, "I" + audit))
        if at < len(rows):
            cost, audit = best(at + 1, last, 0)
            out.append((cost + 2, "D" + audit))
            if faults[at] in "-t":
                more = 5 * (faults[at] == "t")
                i = rows[at][1][:1]
                if i == due or (i == "s" and last == ""):
                    cost, audit = best(at + 1, i, 0)
                    out.append((cost + more, "K" + audit))
                cost, audit = best(at + 1, due, 0)
                out.append((cost + more + 1, "R" + audit))
        return min(out, default=(10**9, ""))

    cost, audit = best(0, "", 0)
    lines, at, last = [], 0, ""
    for edit in audit:
        due = "a" if last == "u" else "u"
        if edit == "K":
            due = rows[at][1][:1]
        if edit != "D":
            role = rows[at][1] if edit == "K" else {"u": "user", "a": "assistant"}[due]
            lines.append(f"{role}:{'' if edit == 'I' else rows[at][2]}")
            last = due
        at += edit != "I"
    assert re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in lines))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    return gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit, lines


def by_conversation(rows, damage=False):
    out = {}
    for conv, turn, role, text in rows:
        role, text, times = " " if role is None else role, " " if text is None else text, 1
        kept = out.setdefault(conv, [])
        if damage:
            key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
            kind = zlib.crc32(key.encode()) % 20
            times = {0: 0, 3: 2}.get(kind, 1)
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            role = "user" if kind == 4 else role
        kept.extend([(turn, role, text)] * times)
    for kept in out.values():
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    return out


def some_rows(seed, conversations, most):
    r = random.Random(seed)
    rows = []
    for conv in range(conversations):
        for k in range(r.randint(1, most)):
            role = r.choice(["user", "assistant"] * 4 + ["system", "tool", None, "", "u2"]) if k else r.choice(["system", "user"])
            text = r.choice(["Yes.", "No?", "cut", "Say more. \n", "", " \t", None, f"Number {r.random()}.", f"é {r.random()}!"])
            rows.append((conv if conv % 17 else None, r.choice([k, k, k, k, k + 2, None]), role, text))
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], ROW)


@pytest.mark.parametrize("insert", [1, 5])
def test_charts_of_slices_make_the_chart_of_the_whole(monkeypatch, insert):
    """At a cost of 5 no insertion is worth it, as a deletion costs 2; at 1 they are."""
    monkeypatch.setattr(conversation, "INSERT", insert)
    r, edits = random.Random(insert), set()
    for _ in range(400):
        rows = tuple((k, r.choice(["user", "assistant", "system", "tool"]), r.choice(["", "cut", f"{k}."])) for k in range(r.randint(0, 7)))
        cost, audit = repair(rows, insert)[5:7]
        seen, kinds = set(), []
        for _, role, text in rows:
            fault = conversation.BLANK if not text else conversation.DUPLICATE if (role, text) in seen else conversation.CUT_SHORT if text == "cut" else conversation.CLEAN
            kinds.append((role[:1], fault, 1))
            seen.add((role, text))
        whole = parse(kinds, "E")
        assert min(v for s, v in whole.items() if s in "EA") == (cost, audit)
        at = r.randint(0, len(kinds))
        parts = {}
        for x, (c1, a1) in parse(kinds[:at], "E").items():
            for y, (c2, a2) in parse(kinds[at:], x).items():
                parts[y] = min(parts.get(y, (10**9, "")), (c1 + c2, a1 + a2))
        assert parts == whole
        edits |= set(audit)
    assert ("I" in edits) == (insert == 1)


@pytest.mark.parametrize(("slice_rows", "partitions"), [(512, 4), (1, 3), (3, 7)])
def test_against_recursion(spark, slice_rows, partitions):
    rows = some_rows(slice_rows, 120, 9) + some_rows(5, 1, 2) * 3 + [(900, k, ("user", "assistant", "system")[k * k % 3], f"Turn {k // 2}.") for k in range(300)]
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        reports, repaired = repair_conversations(frame(spark, rows), slice_rows=slice_rows)
        lines = {}
        for r in repaired.orderBy("conv", "slice", "place").collect():
            lines.setdefault(r.conv, []).append(f"{r.role}:{r.text}")
        got = {r.conv: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, lines.get(r.conv, [])) for r in reports.collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    want = {c: repair(tuple(kept)) for c, kept in by_conversation(rows).items()}
    assert got == want
    assert {"K", "R", "D"} <= set("".join(w[6] for w in want.values()))


def test_empty_table_and_long_texts(spark):
    reports, repaired = repair_conversations(frame(spark, []))
    assert reports.count() == repaired.count() == 0
    long = "word " * 1_000_000 + "end."
    reports, repaired = repair_conversations(frame(spark, [(1, 0, "user", long), (1, 1, "user", long), (1, 2, "assistant", long)]))
    assert [r.audit for r in reports.collect()] == ["KDK"]
    assert [len(r.text) for r in repaired.collect()] == [len(long)] * 2


def test_repeated_rows(spark):
    rows = [(1, 0, "user", "Hi.")] * 2000 + [(1, 1, "assistant", "Hello.")]
    reports, repaired = repair_conversations(frame(spark, rows))
    (r,) = reports.collect()
    assert (r.duplicate, r.illegal, r.cost, r.audit) == (1999, 1999, 3998, "K" + "D" * 1999 + "K")
    assert [(x.role, x.edit) for x in repaired.orderBy("slice", "place").collect()] == [("user", "K"), ("assistant", "K")]


def query_rows(spark, folder):
    return {
        r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256)
        for r in QUERIES["op12_earley_conversation_repair"](spark, str(folder)).collect()
    }


def wanted(rows):
    out = {}
    for conv, kept in by_conversation(rows, damage=True).items():
        *counts, lines = repair(tuple(kept))
        out[conv] = (*counts, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def test_query_against_recursion(spark, tmp_path):
    rows = some_rows(11, 200, 8) + [(5000 + k, 0, "user", None) for k in range(60)]
    frame(spark, rows).write.parquet(str(tmp_path / "conversations.parquet"))
    want = wanted(rows)
    assert query_rows(spark, tmp_path) == want
    assert any(w == (0, 0, 0, 0, 0, 0, "", EMPTY) for w in want.values()), "no conversation lost all rows"


def test_query_on_the_tables(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert query_rows(spark, "/root/testdata/sf0.01") == wanted(rows)
