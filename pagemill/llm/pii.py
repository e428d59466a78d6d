"""Personal data: exact shapes as a base, and bootstrapped contextual extraction on top.

1. Seeds: the base spans of each kind, and strings in the shape of a key for the kind ``secret``, which has no base.
2. Induction: the context of a seed is lexical, the two or three words or marks before it and the one after it. Contexts of
   enough different seeds of a kind are its patterns.
3. Extraction: each pattern is looked for in all texts. What stands between its two sides is an instance, a seed or
   not, of whatever shape.
4. Scoring: patterns and instances form a bipartite graph with one edge for each instance that a pattern extracts,
   however often. In each round a pattern is trusted by the share of its instances that are held to be of the kind, if
   enough of them are, so that a context which also surrounds common words is worth nothing; an instance scores by its
   patterns together (noisy or), and one over the threshold is held in the next round. In prose almost all contexts surround
   common words, and have the more instances the more text there is; such a pattern is dropped by a task once its instances
   in that task alone outnumber what could be of the kind, so that they are never written or counted over all tasks.
5. Instances held after the last round are added to the base spans wherever a pattern has extracted them.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, discard, materialize, read_table, row_uid
from .shingles import Characters

#: The kinds of the base; ``SECRET`` comes after them and is only ever added.
KINDS = ("email", "ip", "card", "phone")
SECRET = len(KINDS)
ALL_KINDS = (*KINDS, "secret")
#: Different seeds of a kind that make a context a pattern, and held instances that a trusted pattern needs.
MIN_INSTANCES = 5
#: Least share of a trusted pattern's instances that are held, and least score of an instance that is held.
MIN_SHARE, MIN_SCORE = 0.6, 0.8
#: Rounds of scoring.
ROUNDS = 3
#: Most words and marks of an instance, which lies within a line.
SLOT = 32
#: Patterns that are broadcast at once; more go over the texts in several blocks.
BLOCK_PATTERNS = 200_000
#: Instances that a task holds at once, and texts whose seeds it holds: a hot pattern extracts any number.
FOUND_ROWS, SEED_TEXTS = 16_384, 512
#: Different instances that a task holds of all patterns, to count them.
EDGE_ROWS = 400_000
#: Instances held beyond the seeds that are allowed for when a pattern is dropped; if there are more, it is looked at again.
SLACK = 128
#: Last words of patterns up to which a text is searched for them before it is taken apart.
FEW_WORDS = 16

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A match can only start where a run of digits starts, so the look-behind changes no match and spares retries.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

#: The shape of a key: 32 hexadecimal digits or more.
_KEY = re.compile(r"(?<![\w])[0-9a-fA-F]{32,}(?![\w])")
_TOKEN = re.compile(r"\w+|[^\w\s]")
#: What every seed has, and every string of the same :func:`_instance`: a digit, or the sign of an address.
_MARK = re.compile("[0-9@]")
_DIGITS, _PARTS = re.compile("[0-9]+"), re.compile("[0-9.]+")


def luhn(digits: str) -> bool:
    total = 0
    for place, c in enumerate(reversed(digits)):
        d = int(c)
        if place % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """As leftmost non-overlapping matches, found from each at sign, so that runs of letters cost nothing."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, (end := m.end())
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base shapes, by kind and start."""
    out = [(0, s, e) for s, e in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((1, *m.span()))
    for m in _CARD.finditer(text):
        digits = re.sub("[ -]", "", m[0])
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append((2, *m.span()))
    for m in _PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append((3, *m.span()))
    return out


def seed_spans(text: str) -> list[tuple[int, int, int]]:
    """The base spans, then those in the shape of a key with letters and digits."""
    out = base_spans(text)
    for m in _KEY.finditer(text):
        if not m[0].isdigit() and not m[0].isalpha() and not any(s < m.end() and m.start() < e for _, s, e in out):
            out.append((SECRET, *m.span()))
    return out


def context(text: str, start: int, end: int) -> tuple[list[str], str | None]:
    """The left sides of a span's patterns, of two and three words or marks, and the right side."""
    before: list[str] = []
    reach = 64
    while start:  # the first of four may be cut, the last three are whole
        before = _TOKEN.findall(text[max(0, start - reach) : start].lower())
        if len(before) > 3 or reach >= start:
            break
        reach *= 4
    reach, after = 64, None
    while m := _TOKEN.search(text, end, end + reach):
        if m.end() < end + reach or m.end() == len(text):
            after = m[0].lower()
            break
        reach *= 4
    return [" ".join(before[-n:]) for n in (2, 3) if len(before) >= n], after


def _plain(kind: int, surface: str) -> str:
    """What two spellings of an identifier have in common."""
    return surface.lower() if kind in (0, SECRET) else "".join((_PARTS if kind == 1 else _DIGITS).findall(surface)) or surface.lower()


def _digest(plain: str) -> int:
    return int.from_bytes(hashlib.blake2b(plain.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _instance(kind: int, surface: str) -> int:
    """A digest that tells identifiers apart without keeping them."""
    return _digest(_plain(kind, surface))


_characters: list[Characters] = []


def words_and_marks(low: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, number) of all words and marks at once, as ``_TOKEN`` finds them; equal ones have equal numbers."""
    if not _characters:
        _characters.append(Characters(marks=True))
    return _characters[0].tokens(low)


class Patterns:
    """An index of patterns (number, kind, left, right) that finds their instances in a text."""

    def __init__(self, patterns: list[tuple[int, int, str, str]]):
        words = sorted({w for _, _, left, right in patterns for w in (*left.split(" "), right)})
        numbers = words_and_marks(" ".join(words))[2]
        order = np.argsort(numbers)
        self.numbers, self.words = numbers[order], ["", *(words[k] for k in order)]  # 0 stands for all other words
        ids = {w: k for k, w in enumerate(self.words)}
        self.base = len(self.words)
        self.by_left: dict[int, dict[int, list[tuple[int, int]]]] = {}
        self.place: dict[int, tuple[int, int]] = {}
        for number, kind, left, right in patterns:
            code = sum(ids[w] * self.base**k for k, w in enumerate(reversed(left.split(" "))))
            self.by_left.setdefault(code, {}).setdefault(ids[right], []).append((number, kind))
            self.place[number] = code, ids[right]
        self._index()

    def _index(self) -> None:
        """What tells the places where a left side ends, and where a right side may be."""
        self.codes = np.sort(np.fromiter(self.by_left, np.int64, len(self.by_left)))
        lasts = np.unique(self.codes % self.base)
        self.lasts = [self.words[k] for k in lasts]
        self.ends, self.rights = np.zeros(self.base, bool), np.zeros(self.base, bool)
        self.ends[lasts] = True
        self.rights[list({right for rights in self.by_left.values() for right in rights})] = True

    def drop(self, number: int) -> None:
        """Look for this pattern no longer."""
        code, right = self.place.pop(number)
        rights = self.by_left[code]
        rights[right] = [x for x in rights[right] if x[0] != number]
        if not rights[right]:
            del rights[right]
        if not rights:
            del self.by_left[code]

    def find(self, text: str, mark: re.Pattern | None = None) -> Iterator[tuple[int, int, int, int]]:
        """(pattern, kind, start, end) of each instance: from the left side to the first right side after it.

        With ``mark``, which is in a word or is one, only of left sides that it follows soon: any instance with it is among these.
        """
        if len(self.by_left) < len(self.codes) * 7 // 8:
            self._index()
        if not self.by_left or (mark and not mark.search(text)):
            return
        low = text.lower()
        if len(low) != len(text):  # a few letters grow when they are lower-cased
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        if len(self.lasts) <= FEW_WORDS and not any(last in low for last in self.lasts):
            return
        starts, stops, numbers = words_and_marks(low)
        place = np.minimum(np.searchsorted(self.numbers, numbers), len(self.numbers) - 1)
        ids = np.where(self.numbers[place] == numbers, place + 1, 0)
        ends, at, codes = np.flatnonzero(self.ends[ids]), [], []
        for n in (2, 3):
            ends = ends[ends >= n - 1]
            ends = ends[ids[ends - n + 1] > 0]
            code = sum(ids[ends - k] * self.base**k for k in range(n))
            known = self.codes[np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)] == code
            at.append(ends[known])
            codes.append(code[known])
        at, codes = np.concatenate(at), np.concatenate(codes)
        if mark and len(at):
            marked = np.searchsorted(starts, [m.start() for m in mark.finditer(text)], "right") - 1
            soon = np.append(marked, len(ids) + SLOT)[np.searchsorted(marked, at + 1)] <= at + SLOT
            at, codes = at[soon], codes[soon]
        if not len(at):
            return
        rights = np.flatnonzero(self.rights[ids])
        lines = [*(m.start() for m in re.finditer("\n", text)), len(text)]
        line = np.array(lines)[np.searchsorted(lines, stops[at])]  # where the line ends in which the left side does
        firsts = np.searchsorted(rights, at + 2)
        lasts = np.minimum(np.searchsorted(rights, at + 2 + SLOT), np.searchsorted(starts[rights], line))
        near = np.flatnonzero(firsts < lasts)
        begins, befores, words = starts[at[near] + 1].tolist(), stops[rights - 1].tolist(), ids[rights].tolist()
        for code, begin, first, last in zip(codes[near].tolist(), begins, firsts[near].tolist(), lasts[near].tolist(), strict=True):
            sides = self.by_left.get(code, ())
            for k in _first_of(words, first, last, sides):
                for number, kind in sides[words[k]]:
                    yield number, kind, begin, befores[k]


def _first_of(words: list[int], first: int, last: int, asked) -> Iterator[int]:
    """The first place of each asked word among those from ``first`` up to ``last``."""
    if len(asked) <= 4:
        for word in tuple(asked):
            try:
                yield words.index(word, first, last)
            except ValueError:
                pass
        return
    seen: set[int] = set()
    for k in range(first, last):
        if words[k] in asked and words[k] not in seen:
            seen.add(words[k])
            yield k


_SPAN = "struct<kind: int, start: bigint, end: bigint>"
_FOUND = "__uid bigint, pattern bigint, kind int, start bigint, end bigint, instance bigint"


def scan_seeds(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(__id, __text, base, contexts) of every row; contexts has kind, instance, left and right of every seed."""
    span = pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64())])
    seed = pa.struct([("kind", pa.int32()), ("instance", pa.int64()), ("left", pa.string()), ("right", pa.string())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, SEED_TEXTS) for b in batches for at in range(0, b.num_rows, SEED_TEXTS)):
            base, contexts = [], []
            for text in batch.column(1):
                text = text.as_py() or ""
                found = seed_spans(text)
                base.append([{"kind": k, "start": s, "end": e} for k, s, e in found if k != SECRET])
                own = []
                for k, s, e in found:
                    lefts, right = context(text, s, e)
                    own += [{"kind": k, "instance": _instance(k, text[s:e]), "left": x, "right": right} for x in lefts if right]
                contexts.append(own)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(base, pa.list_(span)), pa.array(contexts, pa.list_(seed))],
                names=["__id", "__text", "base", "contexts"],
            )

    lean = df.select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{text_col}`").alias("__text"))
    kind = lean.schema[0].dataType.simpleString()
    context_type = "struct<kind: int, instance: bigint, `left`: string, `right`: string>"
    return lean.mapInArrow(scan, f"__id {kind}, __text string, base array<{_SPAN}>, contexts array<{context_type}>")


def induce(seeds: DataFrame, min_instances: int) -> DataFrame:
    """Materialised (pattern, kind, left, right): the contexts of ``min_instances`` different seeds of a kind.

    ``seeds``: distinct kind, instance, left, right.
    """
    often = seeds.groupBy("kind", "left", "right").agg(F.count("*").alias("n")).filter(F.col("n") >= min_instances)
    return materialize(often.select(row_uid().alias("pattern"), "kind", "left", "right"), "pii-patterns")


def _blocks(patterns: DataFrame, size: int) -> Iterator[list[tuple]]:
    """Patterns in blocks of bounded size, one partition at a time on the driver."""
    held: list[tuple] = []
    for row in patterns.toLocalIterator():
        held.append(tuple(row))
        if len(held) >= size:
            yield held
            held = []
    if held:
        yield held


def _over_blocks(rows: DataFrame, patterns: DataFrame, block_patterns: int, scan, schema: str) -> DataFrame | None:
    """What ``scan(patterns, batches)`` gives for each block of ``patterns``; None without patterns. ``rows``: __uid, __text."""
    out = None
    for block in _blocks(patterns, block_patterns):
        shared = rows.sparkSession.sparkContext.broadcast(block)
        part = rows.select("__uid", "__text").mapInArrow(lambda batches, shared=shared: scan(shared.value, batches), schema)
        out = part if out is None else out.unionByName(part)
    return out


def _wanted(instances: DataFrame):
    """A test of arrays of kinds and instances, by a broadcast table of ``instances`` (kind, instance); None if it is too large."""
    if instances.count() > BROADCAST_ROWS:
        return None
    rows = instances.select("kind", "instance").toArrow()
    kinds, values = rows.column(0).to_numpy(), rows.column(1).to_numpy()
    shared = instances.sparkSession.sparkContext.broadcast({int(k): np.sort(values[kinds == k]) for k in np.unique(kinds)})

    def among(kind: np.ndarray, instance: np.ndarray) -> np.ndarray:
        out = np.zeros(len(kind), bool)
        for k, known in shared.value.items():
            own = np.flatnonzero(kind == k)
            place = np.minimum(np.searchsorted(known, instance[own]), len(known) - 1)
            out[own] = known[place] == instance[own]
        return out

    return among


def extract(
    rows: DataFrame, patterns: DataFrame, block_patterns: int = BLOCK_PATTERNS, batch_rows: int = FOUND_ROWS, wanted: DataFrame | None = None,
    mark: re.Pattern | None = None,
) -> DataFrame | None:
    """Materialised (__uid, pattern, kind, start, end, instance) of what the patterns extract; None without patterns.

    ``rows``: __uid, __text. A task holds ``batch_rows`` instances at a time, also of one text. ``wanted`` (kind, instance): only
    of these, which all have a ``mark``, if that is given; with ``chars``, the length of their plain form, few others are digested.
    """
    types = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
    names = ["__uid", "pattern", "kind", "start", "end", "instance"]
    among, sizes = None if wanted is None else _wanted(wanted), None
    if among and "chars" in wanted.columns:
        sizes = {(r["kind"], r["chars"]) for r in wanted.select("kind", "chars").distinct().collect()}

    def find(block: list[tuple], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Patterns(block)
        found: list[tuple] = []

        def made() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), types, strict=True)], names=names)
            return batch.filter(pa.array(among(batch.column(2).to_numpy(), batch.column(5).to_numpy()))) if among else batch

        for batch in batches:
            for uid, text in zip(batch.column(0), batch.column(1), strict=True):
                uid, text = uid.as_py(), text.as_py() or ""
                for n, k, s, e in index.find(text, mark):
                    if mark and not mark.search(text, s, e):
                        continue
                    plain = _plain(k, text[s:e])
                    if sizes and (k, len(plain)) not in sizes:
                        continue
                    found.append((uid, n, k, s, e, _digest(plain)))
                    if len(found) >= batch_rows:
                        yield made()
                        found.clear()
        if found:
            yield made()

    out = _over_blocks(rows, patterns.select("pattern", "kind", "left", "right"), block_patterns, find, _FOUND)
    if out is not None and wanted is not None and among is None:
        out = out.join(wanted.select("kind", "instance"), ["kind", "instance"], "left_semi").select(*names)
    return None if out is None else materialize(out, "pii-found")


def _edges(rows: DataFrame, patterns: DataFrame, block_patterns: int, edge_rows: int = EDGE_ROWS, batch_rows: int = FOUND_ROWS) -> DataFrame | None:
    """Materialised distinct (pattern, kind, instance, chars) of what ``patterns`` (pattern, kind, left, right, most) extract.

    ``chars`` is the length of the instance's plain form.
    A pattern of which a task has met over ``most`` different instances has a row whose instance is null, and that task drops
    it; its other instances need not be there. None without patterns.
    """

    def meet(block: list[tuple], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, most = Patterns([x[:4] for x in block]), {x[0]: x[4] for x in block}
        kinds = {x[0]: x[1] for x in block}
        held: dict[int, dict[int, int]] = {}
        size, full = 0, []

        def made() -> Iterator[pa.RecordBatch]:
            numbers = [n for n, own in held.items() for _ in own] + full
            values = [x for own in held.values() for x in own] + [None] * len(full)
            chars = [x for own in held.values() for x in own.values()] + [None] * len(full)
            for at in range(0, len(numbers), batch_rows):
                part = numbers[at : at + batch_rows]
                columns = [part, [kinds[n] for n in part], values[at : at + batch_rows], chars[at : at + batch_rows]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int32()), strict=True)],
                    names=["pattern", "kind", "instance", "chars"],
                )
            held.clear()
            full.clear()

        for batch in batches:
            for text in batch.column(1):
                text = text.as_py() or ""
                for n, k, s, e in index.find(text):
                    if n not in most:
                        continue
                    own, plain = held.setdefault(n, {}), _plain(k, text[s:e])
                    before = len(own)
                    own[_digest(plain)] = len(plain)
                    size += len(own) - before
                    if len(own) > most[n]:
                        size -= len(held.pop(n))
                        del most[n]
                        index.drop(n)
                        full.append(n)
                    elif size >= edge_rows:
                        yield from made()
                        size = 0
        yield from made()

    out = _over_blocks(rows, patterns.select("pattern", "kind", "left", "right", "most"), block_patterns, meet, "pattern bigint, kind int, instance bigint, chars int")
    return None if out is None else materialize(out.distinct(), "pii-edges")


def score_instances(
    edges: DataFrame, seeds: DataFrame, rounds: int = ROUNDS, min_instances: int = MIN_INSTANCES,
    min_share: float = MIN_SHARE, min_score: float = MIN_SCORE,
) -> DataFrame:
    """Materialised (kind, instance) that the graph holds to be of their kind, seeds among them.

    ``edges``: distinct pattern, kind, instance; ``seeds``: distinct kind, instance. ``min_instances``: held instances a trusted
    pattern needs; ``min_share``: the least share of its instances that are held; ``min_score``: of a held instance.
    """
    edges = materialize(
        edges.join(seeds.withColumn("seed", F.lit(True)), ["kind", "instance"], "left")
        .select("pattern", "kind", "instance", F.coalesce("seed", F.lit(False)).alias("seed")),
        "pii-edges",
    )
    held = edges.filter("false").select("kind", "instance")
    for _ in range(rounds):
        known = edges.join(held.withColumn("held", F.lit(True)), ["kind", "instance"], "left")
        good = F.count_if(F.col("seed") | F.coalesce("held", F.lit(False)))
        trusted = materialize(
            known.groupBy("pattern").agg(good.alias("good"), F.count("*").alias("n"))
            .filter((F.col("good") >= min_instances) & (F.col("good") >= min_share * F.col("n")))
            .select("pattern", (F.col("good") / (F.col("n") + 1)).alias("trust")),
            "pii-trusted",
        )
        held = materialize(
            edges.join(trusted, "pattern").groupBy("kind", "instance")
            .agg((1 - F.exp(F.sum(F.log(1 - F.col("trust"))))).alias("score")).filter(F.col("score") >= min_score)
            .select("kind", "instance"),
            "pii-held",
        )
    return held


def held_instances(
    rows: DataFrame, patterns: DataFrame, seeds: DataFrame, block_patterns: int = BLOCK_PATTERNS, slack: int = SLACK, **limits
) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """Materialised (kind, instance) that the graph of all ``patterns`` and what they extract holds to be of their kind.

    With what was seen on the way: all that the patterns extract of ``seeds``, as :func:`extract` gives it; and the instances
    held beyond them (kind, instance, chars). Both None without patterns.

    As :func:`score_instances` over every edge, and exact: how many seeds each pattern extracts is counted first. One that in
    one task already has more different instances than would leave those seeds, and ``slack`` more, the least share of a
    trusted one, is never trusted as long as no more than ``slack`` are held beyond the seeds of its kind. If there are more,
    all is done again with a larger allowance. ``seeds``: distinct kind, instance.
    """
    none, share = seeds.filter("false"), limits.get("min_share", MIN_SHARE)
    caught = extract(rows, patterns, block_patterns, wanted=seeds, mark=_MARK)
    if caught is None:
        return none, None, None
    good = caught.select("pattern", "instance").distinct().groupBy("pattern").agg(F.count("*").alias("good"))
    good = materialize(patterns.join(good, "pattern", "left").fillna(0, ["good"]), "pii-good")
    while True:
        most = F.floor((F.col("good") + slack) / share) + 1 if share > 0 else F.lit(1 << 62)
        met = _edges(rows, good.select("pattern", "kind", "left", "right", most.cast("bigint").alias("most")), block_patterns)
        full = met.filter("instance is null").select("pattern", "kind")
        edges = met.join(full.select("pattern"), "pattern", "left_anti").select("pattern", "kind", "instance")
        held = score_instances(edges, seeds, **limits)
        more = held.join(seeds, ["kind", "instance"], "left_anti")
        more = materialize(more.join(met.select("kind", "instance", "chars").distinct(), ["kind", "instance"]), "pii-more")
        n = more.join(full.select("kind").distinct(), "kind", "left_semi").groupBy("kind").agg(F.count("*").alias("n"))
        over = n.agg(F.max("n")).first()[0] or 0
        discard(met)
        if over <= slack:
            discard(good)
            return held, caught, more
        discard(more)
        slack = 4 * over


def find_personal_data(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_patterns: int = BLOCK_PATTERNS, **limits
) -> DataFrame:
    """(id, base, added) of every row: arrays of (kind, start, end) in code points, ends exclusive.

    ``added`` spans overlap no base span and not each other; of overlapping ones the first, then the longest stays.
    A null or empty text has no spans. Repeated rows are scanned each by itself. Without seeds nothing is added. An
    empty frame gives an empty one. Other columns are not read. A text of any length is read whole. Keywords:
    ``rounds``, ``min_instances``, ``min_share``, ``min_score`` of :func:`score_instances`.
    """
    rows = materialize(scan_seeds(df, id_col, text_col).withColumn("__uid", row_uid()), "pii")
    seeds = materialize(rows.select(F.explode("contexts").alias("c")).select("c.*").distinct(), "pii-seeds")
    patterns = induce(seeds, limits.get("min_instances", MIN_INSTANCES))
    held, found, more = held_instances(rows, patterns, seeds.select("kind", "instance").distinct(), block_patterns, **limits)
    bases = rows.select(F.col("__id").alias(id_col), F.array_sort("base").alias("base"), "__uid")
    none = F.array().cast(f"array<{_SPAN}>")
    if found is None:
        return bases.select(F.col(f"`{id_col}`"), "base", none.alias("added"))
    found = found.join(held, ["kind", "instance"], "left_semi").select("__uid", "kind", "start", "end")
    kinds = [r["kind"] for r in more.select("kind").distinct().collect()]
    if kinds:
        others = extract(rows, patterns.filter(F.col("kind").isin(*kinds)), block_patterns, wanted=more)
        found = found.unionByName(others.select("__uid", "kind", "start", "end"))
    span = F.struct("kind", "start", "end")
    added = found.groupBy("__uid").agg(F.collect_set(span).alias("__found"))
    return bases.join(added, "__uid", "left").select(
        F.col(f"`{id_col}`"), "base", F.array_sort(apart("base", F.coalesce("__found", none))).alias("added")
    )


def held_out_recovery(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_patterns: int = BLOCK_PATTERNS, **limits) -> DataFrame:
    """(kind, hidden, recovered, added, wrong): a quarter of each kind's seeds is hidden, and looked for by the others' patterns.

    Hidden are the seeds whose digest 4 divides; ``recovered`` counts those that the patterns find and hold; ``added`` counts all
    instances held beyond the seeds given, and ``wrong`` those of them that are no seed at all: other identifiers, or
    mistakes. Kinds without a seed have no row. Keywords as in :func:`find_personal_data`.
    """
    rows = materialize(scan_seeds(df, id_col, text_col).withColumn("__uid", row_uid()), "pii")
    seeds = materialize(rows.select(F.explode("contexts").alias("c")).select("c.*").distinct(), "pii-seeds")
    hidden = F.col("instance") % 4 == 0
    given, every = seeds.filter(~hidden), seeds.select("kind", "instance").distinct()
    patterns = induce(given, limits.get("min_instances", MIN_INSTANCES))
    held, _, _ = held_instances(rows, patterns, given.select("kind", "instance").distinct(), block_patterns, **limits)
    both = every.withColumn("seed", F.lit(True)).join(held.withColumn("held", F.lit(True)), ["kind", "instance"], "full")
    seed, got = F.coalesce("seed", F.lit(False)), F.coalesce("held", F.lit(False))
    names = F.array(*[F.lit(k) for k in ALL_KINDS])
    return both.groupBy(F.element_at(names, F.col("kind") + 1).alias("kind")).agg(
        F.count_if(seed & hidden).alias("hidden"), F.count_if(seed & hidden & got).alias("recovered"),
        F.count_if(got & (hidden | ~seed)).alias("added"), F.count_if(got & ~seed).alias("wrong"),
    )


def pii_held_out(spark, sf_dir):
    return held_out_recovery(read_table(spark, sf_dir, "documents"))


def apart(base, found):
    """The spans of ``found`` that overlap none of ``base`` nor an earlier one; the longer of two that start together."""
    span = f"array<{_SPAN}>"
    by_start = F.array_sort(F.transform(found, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["kind"].alias("kind"))))
    free = F.filter(by_start, lambda s: ~F.exists(base, lambda b: (b["start"] < -s["back"]) & (s["start"] < b["end"])))
    taken = F.aggregate(
        free, F.array().cast(span),
        lambda kept, s: F.when(
            (F.size(kept) > 0) & (F.element_at(kept, -1)["end"] > s["start"]), kept
        ).otherwise(F.concat(kept, F.array(F.struct(s["kind"].alias("kind"), s["start"].alias("start"), (-s["back"]).alias("end")))))
    )
    return taken


def _joined(spans):
    names = F.array(*[F.lit(k) for k in ALL_KINDS])
    return F.array_join(
        F.transform(
            spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))
        ),
        ",",
    )


def op4_bootstrapped_pii(spark, sf_dir):
    """Every document with its spans; ``n_all`` counts the base ones and those that the patterns added."""
    found = find_personal_data(read_table(spark, sf_dir, "documents"))

    def count(spans, kind):
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint")

    return found.select(
        "doc_id", *[count("base", k).alias(f"n_{name}") for k, name in enumerate(KINDS)],
        F.sha2(_joined(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        _joined(F.array_sort(F.concat("base", "added"))).alias("spans"),
        F.size("added").cast("bigint").alias("n_added"), count("added", SECRET).alias("n_secret"),
        (F.size("base") + F.size("added")).cast("bigint").alias("n_all"),
    )
