"""Conversation structure repair by error-correcting Earley parsing.

The roles of a conversation shall read ``(s?(ua)+)?`` by their initials. The grammar is left-linear, so every Earley item
starts at the first row: a chart column is a few items, and each keeps the least (cost, audit) by which it is reached. A
row is kept, reroled or deleted, and a row may be inserted, each at its cost; the audit is the edits' initials.

1. Equal rows of one conversation and turn become one with a count; the first turn of each (role, text) is joined to its
   rows, which tells the later ones.
2. Rows are sorted by range over (conversation, turn), so that a long conversation lies in several tasks, and cut into
   slices of bounded size. A slice is parsed from each nonterminal that may stand before it: its chart's last column
   then says at what (cost, audit) each nonterminal stands after it. Of two audits of one cost over the same rows neither
   begins the other, so the least audits of the parts make the least of the whole.
3. Slices are composed in order, without their texts, and the goal is traced back: each slice learns where it is entered
   and left, and its own part of the completed chart yields the repaired rows.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, read_table

#: The grammar: terminals are initials of roles, nonterminals are capitals, ``C`` is the conversation.
RULES = (
    ("S", ("s",)), ("U", ("u",)), ("U", ("S", "u")), ("U", ("A", "u")), ("A", ("U", "a")), ("C", ()), ("C", ("A",)),
)
#: Roles that a row may be given or inserted with, by their initials.
ROLES = {"u": "user", "a": "assistant"}
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Nonterminals that may stand before a slice; ``E``: nothing yet.
STATES = "ESUA"
#: Faults of a row.
CLEAN, BLANK, DUPLICATE, CUT_SHORT = range(4)
#: Most rows of a slice, and characters after which it ends.
SLICE_ROWS, SLICE_CHARS = 512, 1 << 20

WHITE = "\x20\x09\x0a\x0b\x0c\x0d"

Value = tuple[int, str]
Item = tuple[int, int]


def close(column: dict[Item, Value]) -> dict[Item, Value]:
    """Complete and insert until no item of the column gets less: cheapest first, as no step lowers a value."""
    agenda = [(value, item) for item, value in column.items()]
    heapq.heapify(agenda)
    while agenda:
        value, item = heapq.heappop(agenda)
        if column[item] < value:
            continue
        lhs, rhs = RULES[item[0]]
        if item[1] == len(rhs):
            reached = [((k, 1), value) for k, (_, r) in enumerate(RULES) if r[:1] == (lhs,)]
        elif rhs[item[1]] in ROLES:
            reached = [((item[0], item[1] + 1), (value[0] + INSERT, value[1] + "I"))]
        else:
            reached = []
        for to, new in reached:
            if to not in column or new < column[to]:
                column[to] = new
                heapq.heappush(agenda, (new, to))
    return column


def scan(column: dict[Item, Value], initial: str, fault: int, copies: int) -> dict[Item, Value]:
    """The column after a row, and after its further copies, which can only be deleted."""
    after: dict[Item, Value] = {}

    def reach(item: Item, cost: int, audit: str) -> None:
        new = (cost + DELETE * (copies - 1), audit + "D" * (copies - 1))
        if item not in after or new < after[item]:
            after[item] = new

    for (rule, dot), (cost, audit) in column.items():
        reach((rule, dot), cost + DELETE, audit + "D")
        rhs = RULES[rule][1]
        if fault in (BLANK, DUPLICATE) or dot == len(rhs) or rhs[dot].isupper():
            continue
        cost += TRUNCATED * (fault == CUT_SHORT)
        if rhs[dot] == initial:
            reach((rule, dot + 1), cost, audit + "K")
        if rhs[dot] in ROLES:
            reach((rule, dot + 1), cost + REROLE, audit + "R")
    return close(after)


def opened(state: str) -> dict[Item, Value]:
    """The first column of a chart before which ``state`` stands."""
    if state == "E":
        return close({(k, 0): (0, "") for k, (_, rhs) in enumerate(RULES) if not rhs or rhs[0].islower()})
    return close({(k, 1): (0, "") for k, (_, rhs) in enumerate(RULES) if rhs[:1] == (state,)})


def standing(column: dict[Item, Value], entry: str) -> dict[str, Value]:
    """The nonterminals that may stand at the end of a chart; the entry itself does so where nothing was added."""
    out: dict[str, Value] = {}
    for (rule, dot), value in column.items():
        lhs, rhs = RULES[rule]
        if dot == len(rhs) and lhs != "C":
            state = lhs
        elif dot == 0 and rhs:
            state = "E"
        elif dot == 1 and rhs[0] == entry:
            state = entry  # waits behind it, as at the start
        else:
            continue
        if state not in out or value < out[state]:
            out[state] = value
    return out


def parse(rows: list[tuple[str, int, int]], entry: str) -> dict[str, Value]:
    """The least (cost, audit) of each nonterminal after ``rows`` (initial, fault, copies) when ``entry`` stands before them."""
    column = opened(entry)
    for initial, fault, copies in rows:
        column = scan(column, initial, fault, copies)
    return standing(column, entry)


def _slices(batches: Iterator[pa.RecordBatch], slice_rows: int, conv_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Rows (conv, turn, role, text, n, fault) in order to one row a slice."""
    part, at = TaskContext.get().partitionId() << 36, 0
    rows: list[tuple] = []
    chars, begun, known = 0, None, False  # the conversation of ``rows``; whether it starts in this task

    def cut(starts: bool) -> pa.RecordBatch:
        nonlocal at
        initials = [role[:1] for _, role, _, _, _ in rows]
        turns = [t for t, *_ in rows]
        faults = [f for *_, f in rows]
        copies = [n for *_, n, _ in rows]
        kinds = list(zip(initials, faults, copies, strict=True))
        matrix = [
            {"entry": x, "exit": y, "cost": cost, "audit": audit}
            for x in (STATES[:1] if starts else STATES) for y, (cost, audit) in parse(kinds, x).items()
        ]
        more = [n - 1 for n in copies]
        row = {
            "conv": begun[0], "slice": part + at, "roles": [r for _, r, _, _, _ in rows], "texts": [x for _, _, x, _, _ in rows],
            "copies": copies, "matrix": matrix,
            "blank": sum(n for n, f in zip(copies, faults, strict=True) if f == BLANK),
            "duplicate": sum((n - 1) * (f != BLANK) + (f == DUPLICATE) for n, f in zip(copies, faults, strict=True)),
            "truncated": faults.count(CUT_SHORT),
            "illegal": sum(more) + sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False)),
            "head": initials[0], "tail": initials[-1], "first_turn": turns[0], "last_turn": turns[-1],
            "turns": len({t for t in turns if t is not None}), "low": next((t for t in turns if t is not None), None),
        }
        at += 1
        return pa.RecordBatch.from_pylist([row], schema=_slice_schema(conv_type))

    for batch in batches:
        for conv, turn, role, text, n, fault in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            other = begun is None or conv != begun[0]
            if rows and (other or len(rows) >= slice_rows or chars >= SLICE_CHARS):
                yield cut(known)
                rows, chars, known = [], 0, False
            if other:
                known, begun = begun is not None, (conv,)
            rows.append((turn, role, text, n, fault))
            chars += len(text)
    if rows:
        yield cut(known)


def _slice_schema(conv_type: pa.DataType) -> pa.Schema:
    link = pa.struct([("entry", pa.string()), ("exit", pa.string()), ("cost", pa.int64()), ("audit", pa.string())])
    longs = ("blank", "duplicate", "truncated", "illegal")
    return pa.schema([
        ("conv", conv_type), ("slice", pa.int64()), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string())),
        ("copies", pa.list_(pa.int64())), ("matrix", pa.list_(link)), *((k, pa.int64()) for k in longs),
        ("head", pa.string()), ("tail", pa.string()), ("first_turn", pa.int64()), ("last_turn", pa.int64()),
        ("turns", pa.int64()), ("low", pa.int64()),
    ])


SLICE = (
    "slice bigint, roles array<string>, texts array<string>, copies array<bigint>, "
    "matrix array<struct<entry:string,exit:string,cost:bigint,audit:string>>, blank bigint, duplicate bigint, "
    "truncated bigint, illegal bigint, head string, tail string, first_turn bigint, last_turn bigint, turns bigint, low bigint"
)
REPORT = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"


def _compose(batches: Iterator[pa.RecordBatch], conv_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Slices in order, without texts, to where each is entered and left; the last of a conversation has its report."""
    longs = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    schema = pa.schema([
        ("conv", conv_type), ("slice", pa.int64()), ("entry", pa.string()), ("exit", pa.string()),
        *((k, pa.int64()) for k in longs), ("audit", pa.string()),
    ])
    path: list[tuple[int, dict[str, str]]] = []  # of each slice: by which entry a nonterminal after it is reached
    best: dict[str, Value] = {}
    last: dict | None = None
    sums: dict = {}

    def finish() -> pa.RecordBatch:
        state = min((s for s in best if s in "EA"), key=best.get)
        cost, audit = best[state]
        low, high = sums["low"], last["last_turn"]
        report = {k: sums[k] for k in longs[1:-1]} | {"cost": cost, "audit": audit}
        report["gaps"] = 0 if low is None else high - low + 1 - sums["turns"]
        out: list[dict] = []
        for at, back in reversed(path):
            out.append({"conv": last["conv"], "slice": at, "entry": back[state], "exit": state} | report)
            state, report = back[state], dict.fromkeys((*longs, "audit"))
        return pa.RecordBatch.from_pylist(out, schema=schema)

    for batch in batches:
        for row in batch.to_pylist():
            if last is None or row["conv"] != last["conv"]:
                if last is not None:
                    yield finish()
                best, path, last = {"E": (0, "")}, [], None
                sums = dict.fromkeys((*longs, "turns"), 0) | {"low": None}
            back, new = {}, {}
            for link in row["matrix"]:
                x, y = link["entry"], link["exit"]
                if x in best:
                    value = (best[x][0] + link["cost"], best[x][1] + link["audit"])
                    if y not in new or value < new[y]:
                        new[y], back[y] = value, x
            best = new
            path.append((row["slice"], back))
            for k in ("blank", "duplicate", "truncated", "illegal", "turns"):
                sums[k] += row[k]
            sums["low"] = row["low"] if sums["low"] is None else sums["low"]
            if last is not None:
                sums["illegal"] += last["tail"] + row["head"] not in ("su", "ua", "au")
                sums["turns"] -= row["first_turn"] is not None and row["first_turn"] == last["last_turn"]
            last = row
    if last is not None:
        yield finish()


def _repaired(batches: Iterator[pa.RecordBatch], conv_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Slices (conv, slice, roles, texts, copies, entry, audit) to their repaired rows."""
    schema = pa.schema([
        ("conv", conv_type), ("slice", pa.int64()), ("place", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string()),
    ])
    for batch in batches:
        for s in batch.to_pylist():
            out, at, left, state = [], 0, s["copies"][0], s["entry"]
            for edit in s["audit"]:
                if edit != "D":
                    due = "a" if state == "U" else "u"
                    role, text = ROLES[due], ""
                    if edit != "I":
                        text = s["texts"][at]
                    if edit == "K":
                        role = s["roles"][at]
                        due = role[0]
                    state = due.upper()
                    out.append({"conv": s["conv"], "slice": s["slice"], "place": len(out), "edit": edit, "role": role, "text": text})
                if edit != "I":
                    left -= 1
                    if not left:
                        at += 1
                        left = s["copies"][at] if at < len(s["copies"]) else 0
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=schema)


def _arrow_type(df: DataFrame, column: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[column].dataType)


def faulty_rows(df: DataFrame, conv: Column, turn: Column, role: Column, text: Column) -> DataFrame:
    """(conv, turn, role, text, n, fault): equal rows of a turn as one of ``n``, with the first fault of the first of them."""
    space = F.lit(" ")
    rows = (
        df.select(conv.alias("conv"), turn.cast("bigint").alias("turn"), F.coalesce(role, space).alias("role"), F.coalesce(text, space).alias("text"))
        .groupBy("conv", "turn", "role", "text").agg(F.count("*").alias("n")).withColumn("sha", F.sha2("text", 256))
    )
    when = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    first = rows.groupBy("conv", "role", "sha").agg(F.min(when).alias("first"))
    seen = first.select(F.col("conv").alias("c"), F.col("role").alias("r"), F.col("sha").alias("s"), "first")
    joined = rows.join(seen, F.col("conv").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("sha") == F.col("s")))
    end = F.right(F.rtrim(F.col("text"), F.lit(WHITE)), F.lit(1))
    fault = (
        F.when(end == "", BLANK).when(when > F.col("first"), DUPLICATE).when(~end.isin(".", "!", "?"), CUT_SHORT).otherwise(CLEAN)
    )
    return joined.select("conv", "turn", "role", "text", "n", fault.alias("fault"))


def repair_conversations(
    df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
    slice_rows: int = SLICE_ROWS,
) -> tuple[DataFrame, DataFrame]:
    """(reports, rows): one report a conversation, and its rows as repaired.

    Reports: conv, gaps, blank, duplicate, truncated, illegal, cost, audit. Rows: conv, slice, place, edit, role, text, in the
    order of (slice, place). Rows are taken by turn, null turns first, ties by role and text in code-point order. A null
    role or text is one space; a null conversation is one of its own. A role is known by its first character; one that is
    empty or begins otherwise than s, u or a can only be reroled or deleted. Repeated rows are duplicates. Of the cheapest
    repairs the one with the least audit (ASCII) counts. A conversation of any length is parsed in slices; an empty frame
    gives empty ones. Other columns are not read.
    """
    conv_type = _arrow_type(df, conv_col)
    kind = df.schema[conv_col].dataType.simpleString()
    rows = faulty_rows(df, *(F.col(f"`{c}`") for c in (conv_col, turn_col, role_col, text_col)))
    # a beginning of the text is a coarser key than the text, so ranges keep the order and the driver's sample stays small
    dealt = rows.repartitionByRange("conv", "turn", F.substring("role", 1, 32), F.substring("text", 1, 32))
    slices = materialize(
        dealt.sortWithinPartitions("conv", "turn", "role", "text")
        .mapInArrow(lambda b: _slices(b, slice_rows, conv_type), f"conv {kind}, {SLICE}"),
        "slices",
    )
    states = materialize(
        slices.drop("roles", "texts", "copies").repartition("conv").sortWithinPartitions("conv", "slice")
        .mapInArrow(lambda b: _compose(b, conv_type), f"conv {kind}, slice bigint, entry string, exit string, {REPORT}"),
        "states",
    )
    own = F.filter("matrix", lambda x: (x["entry"] == F.col("entry")) & (x["exit"] == F.col("exit")))[0]["audit"]
    repaired = (
        slices.join(states.select("slice", "entry", "exit"), "slice")
        .select("conv", "slice", "roles", "texts", "copies", "entry", own.alias("audit"))
        .mapInArrow(lambda b: _repaired(b, conv_type), f"conv {kind}, slice bigint, place bigint, edit string, role string, text string")
    )
    reports = states.filter("audit is not null").drop("slice", "entry", "exit")
    return reports, repaired


def digests(repaired: DataFrame) -> DataFrame:
    """(conv, sha) of the lines ``role:text`` of each conversation. The rows of one are hashed as they stream past, not held."""
    conv_type, kind = _arrow_type(repaired, "conv"), repaired.schema["conv"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, sha = None, None
        out: list[dict] = []
        schema = pa.schema([("conv", conv_type), ("sha", pa.string())])
        for batch in batches:
            for conv, role, text in zip(*(batch.column(k).to_pylist() for k in ("conv", "role", "text")), strict=True):
                if last is None or last[0] != conv:
                    if last is not None:
                        out.append({"conv": last[0], "sha": sha.hexdigest()})
                    last, sha = (conv,), hashlib.sha256()
                else:
                    sha.update(b"\n")
                sha.update(f"{role}:{text}".encode())
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
                out = []
        if last is not None:
            yield pa.RecordBatch.from_pylist([{"conv": last[0], "sha": sha.hexdigest()}], schema=schema)

    ordered = repaired.repartition("conv").sortWithinPartitions("conv", "slice", "place")
    return ordered.mapInArrow(run, f"conv {kind}, sha string")


def damaged(df: DataFrame) -> DataFrame:
    """The rows as the query's contract damages them: dropped, emptied, without stops, repeated, of role user."""
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    chance = F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn"))) % 20
    text = F.when(chance == 1, F.lit("")).when(chance == 2, F.regexp_replace(text_of("text"), "[.!?]", "")).otherwise(text_of("text"))
    role = F.when(chance == 4, F.lit("user")).otherwise(text_of("role"))
    copies = F.when(chance == 0, 0).when(chance == 3, 2).otherwise(1)
    return df.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), copies)).alias("copy")).drop("copy")


def op12_earley_conversation_repair(spark, sf_dir):
    source = read_table(spark, sf_dir, "conversations")
    reports, repaired = repair_conversations(damaged(source))
    longs = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    nothing = hashlib.sha256(b"").hexdigest()
    every = (
        source.select(F.col("conv_id").alias("conv")).distinct().unionByName(reports, allowMissingColumns=True)
        .unionByName(digests(repaired), allowMissingColumns=True)
    )
    # one row at most has a value: grouping joins them, null conversations too
    return every.groupBy(F.col("conv").alias("conv_id")).agg(
        *[F.coalesce(F.max(k), F.lit(0).cast("bigint")).alias(k) for k in longs],
        F.coalesce(F.max("audit"), F.lit("")).alias("audit"), F.coalesce(F.max("sha"), F.lit(nothing)).alias("repaired_sha256"),
    )
