"""Spelling variants by Aho-Corasick over the halves of words.

1. Words are counted over all documents, each document's distinct words once.
2. Every word is cut into two halves. One edit leaves one of them whole: the left half stands at the start of a near word,
   or the right half at its end. Halves are dealt to shards of about ``SHARD`` halves by their hash; a half that very
   many words share is dealt over as many shards as it needs.
3. A word can only hold halves that start or end it, and whose words differ from it by at most one in length: at most four
   (side, length) cuts of the word itself. It is scanned by the automata of the shards that hold these.
4. A match counts if its offset fits its side and the lengths fit; the rest of both words, beside the half, is then verified
   to differ by exactly one edit. A right half is left to the left one where both match, so each pair is met once.
5. A shard sends back one row a scanned word: how many near words it holds and the most frequent of them.
6. Forms are followed to their roots by doubling: a form is ``RATIO`` times as frequent as its word, so chains are short.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, read_table

MIN_LENGTH, MIN_COUNT, RATIO = 6, 5, 5
#: Halves of a shard's automaton.
SHARD = 16384
#: Distinct words that a task counts before it reports them.
HELD_WORDS = 400_000
#: Characters from which on the words of a text are not listed at once.
LONG_TEXT = 1 << 22

_RUN = re.compile("[a-zÀ-ÿ]+")


def runs(text: str | None) -> Counter:
    """How often each maximal run of letters occurs, A-Z in lower case."""
    low = (text or "").encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
    return Counter(_RUN.findall(low) if len(low) < LONG_TEXT else (m.group() for m in _RUN.finditer(low)))


def with_slips(found: Counter, doc_id: int | None) -> Iterator[tuple[str, int]]:
    """The runs of one document with one code point deleted from those whose checksum 199 divides."""
    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for run, n in found.items():
        h = zlib.crc32(run.encode(), start)
        if h % 199 == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
        yield run, n


def count_words(df: DataFrame, id_col: str, text_col: str, min_length: int, min_count: int, slips: bool) -> DataFrame:
    """(word, n) of the words of ``min_length`` code points or more that occur ``min_count`` times or more."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def report() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held)), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = runs(text.as_py())
                for word, n in with_slips(found, doc_id) if slips else found.items():
                    if len(word) >= min_length:
                        held[word] += n
                if len(held) >= HELD_WORDS:
                    yield report()
                    held.clear()
        if held:
            yield report()

    source = df.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"))
    counted = source.mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return materialize(counted.filter(F.col("n") >= min_count), "words")


def one_edit(a: str, b: str) -> bool:
    """Whether exactly one inserted, deleted or replaced code point makes ``a`` into ``b``."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    at = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[at + (len(a) == len(b)) :] == b[at + 1 :]


class Rests:
    """What stands beside one half in the words of a shard, to be asked for rests that differ by one edit."""

    __slots__ = ("whole", "cut")

    def __init__(self):
        self.whole: dict[str, tuple[str, int]] = {}
        self.cut: dict[str, list[str]] = {}

    def add(self, rest: str, word: str, n: int) -> None:
        self.whole[rest] = (word, n)
        for i in range(len(rest)):
            self.cut.setdefault(rest[:i] + rest[i + 1 :], []).append(rest)

    def near(self, rest: str) -> Iterator[tuple[str, int]]:
        """The words whose rest differs from ``rest`` by one edit: candidates share a form with one deletion."""
        seen = set(self.cut.get(rest, ()))
        for i in range(len(rest)):
            short = rest[:i] + rest[i + 1 :]
            if short in self.whole:
                seen.add(short)
            seen.update(self.cut.get(short, ()))
        for other in seen:
            if one_edit(rest, other):
                yield self.whole[other]


class HalfAutomaton:
    """Aho-Corasick over the halves of a shard; each half has the rests of its words on either side."""

    def __init__(self):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        self.halves: dict[str, tuple[str, Rests, Rests]] = {}

    def add(self, side: int, word: str, n: int) -> None:
        middle = len(word) // 2
        half, rest = (word[:middle], word[middle:]) if side == 0 else (word[middle:], word[:middle])
        if half not in self.halves:
            self.halves[half] = (half, Rests(), Rests())
            self.automaton.add_word(half, self.halves[half])
        self.halves[half][1 + side].add(rest, word, n)

    def near(self, word: str) -> Iterator[tuple[str, int]]:
        for end, (half, after, before) in self.automaton.iter(word):
            if end + 1 == len(half):
                yield from after.near(word[len(half) :])
            if end + 1 == len(word):
                for other, n in before.near(word[: len(word) - len(half)]):
                    if not word.startswith(other[: len(other) // 2]):  # else its left half has found it
                        yield other, n


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (shard, scanned, side, word, n) in the order of shard and scanned: halves to index come first."""
    automaton, shard, ready = None, None, False
    for batch in batches:
        out: list[tuple] = []
        for at, scanned, side, word, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if at != shard:
                automaton, shard, ready = HalfAutomaton(), at, False
            if not scanned:
                automaton.add(side, word, n)
                continue
            if not ready:
                if automaton.halves:
                    automaton.automaton.make_automaton()
                ready = True
            if not automaton.halves:
                continue
            near, best = 0, None
            for other, m in automaton.near(word):
                near += 1
                if best is None or (-m, other) < best:
                    best = (-m, other)
            if near:
                out.append((word, near, -best[0], best[1]))
        columns = list(zip(*out, strict=True)) or [(), (), (), ()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.string())],
            names=["word", "near", "best_n", "best"],
        )


def near_words(words: DataFrame, shard: int = SHARD) -> DataFrame:
    """(word, n_near, form, form_n) of the words of ``words`` (word, n) that have near ones; form is the most frequent."""
    shards = max(1, -(-2 * words.count() // shard))
    size = F.length("word")
    half = (size / 2).cast("int")
    # SQL substring counts code points, as the automaton does
    left = lambda k: F.struct(F.lit(0).alias("side"), F.expr("word").substr(F.lit(1), k).alias("half"))
    right = lambda k: F.struct(F.lit(1).alias("side"), F.expr("word").substr(size - k + 1, k).alias("half"))
    index = words.select("word", "n", F.explode(F.array(left(half), right(size - half))).alias("h")).select("word", "n", "h.*")
    # of words longer or shorter by one, halves are as long as these
    cuts = F.array_distinct(F.array(*[c for d in (-1, 0, 1) for c in (
        left(((size + d) / 2).cast("int")), right(size + d - ((size + d) / 2).cast("int")),
    )]))
    asked = words.select("word", "n", F.explode(cuts).alias("h")).select("word", "n", "h.*")
    hot = materialize(
        index.groupBy("side", "half").agg(F.count("*").alias("c")).filter(F.col("c") > shard // 2)
        .select("side", "half", F.ceil(F.col("c") / F.lit(shard // 2)).alias("salts")),
        "halves",
    )
    place = F.pmod(F.xxhash64("side", "half"), F.lit(shards))
    salted = lambda salt: F.when(F.col("salts").isNull(), place).otherwise(-1 - F.pmod(F.xxhash64("side", "half", salt), F.lit(1 << 62)))
    dealt = index.join(hot, ["side", "half"], "left").withColumn("shard", salted(F.pmod(F.xxhash64("word"), F.col("salts"))))
    sought = (
        asked.join(hot, ["side", "half"], "left")
        .withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce("salts", F.lit(1)) - 1)))
        .withColumn("shard", salted(F.col("salt"))).select("shard", "word", "n").distinct()
    )
    rows = dealt.select("shard", F.lit(0).alias("scanned"), "side", "word", "n").unionByName(
        sought.select("shard", F.lit(1).alias("scanned"), F.lit(0).alias("side"), "word", "n")
    )
    found = rows.repartition("shard").sortWithinPartitions("shard", "scanned").mapInArrow(_scan, "word string, near bigint, best_n bigint, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("best")))
    return found.groupBy("word").agg(F.sum("near").alias("n_near"), best.alias("b")).select(
        "word", "n_near", F.col("b.best").alias("form"), (-F.col("b.less")).alias("form_n")
    )


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for (word, form): forms followed to the last. Each round doubles the way that is followed."""
    links = materialize(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        step = materialize(
            links.join(links.select(F.col("word").alias("root"), F.col("root").alias("far")), "root", "left")
            .select("word", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved")),
            "forms",
        )
        discard(links)
        links = step
        if step.filter("moved").isEmpty():
            return links.select("word", "root")
        links = step.select("word", "root")
        links._pagemill_path = step._pagemill_path


def spelling_variants(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT,
    ratio: int = RATIO, shard: int = SHARD, slips: bool = False,
) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n.

    Words are runs of the letters A-Z, a-z and U+00C0 to U+00FF, A-Z in lower case, of ``min_length`` code points and
    ``min_count`` occurrences or more. ``n_near`` counts the words that one inserted, deleted or replaced code point makes of
    it. ``form`` is the most frequent of them (ties: the least in code-point order) if it is ``ratio`` (over 1) times as frequent,
    else null, with ``form_n`` then null too; ``root`` follows forms to the last. ``slips`` deletes a code point from some
    runs, as the query's contract says; a null id counts as an empty one there. Null and empty texts have no words;
    repeated rows count again; an empty frame gives an empty one. Texts of any length are read whole. Other columns are
    not read.
    """
    if min_length < 2:
        raise ValueError("words need two halves: min_length is 2 at least")
    words = count_words(df, id_col, text_col, min_length, min_count, slips)
    near = near_words(words, shard)
    joined = words.join(near, "word", "left")
    fits = F.col("form_n") >= ratio * F.col("n")
    table = materialize(
        joined.select(
            "word", F.when(fits, F.col("form")).alias("form"), "n",
            F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"), F.when(fits, F.col("form_n")).alias("form_n"),
        ),
        "variants",
    )
    discard(words)
    last = roots(table.filter("form is not null"))
    return table.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling_variants(spark, sf_dir):
    return spelling_variants(read_table(spark, sf_dir, "documents"), slips=True)
