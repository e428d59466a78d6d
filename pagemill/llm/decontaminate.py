"""Benchmark decontamination by greedy string tiling."""

from __future__ import annotations

import re
import uuid
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, read_table

#: Words of a seed and of the shortest tile.
TILE_WORDS = 5
#: Least share of a test item's words that tiles cover in a contaminated document.
COVERAGE = 0.8
#: Words of test items broadcast at once; a larger test set goes over the documents in several blocks.
BLOCK_WORDS = 4_000_000

_WORD = re.compile(r"\w+")
_MOD, _BASE = (1 << 61) - 1, 1_000_003


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def _window_hashes(seq: list[int], length: int) -> list[int]:
    """Karp-Rabin hashes of all windows of ``length``."""
    if len(seq) < length:
        return []
    top, h = pow(_BASE, length - 1, _MOD), 0
    for x in seq[:length]:
        h = (h * _BASE + x + 1) % _MOD
    out = [h]
    for gone, come in zip(seq, seq[length:], strict=False):
        h = ((h - (gone + 1) * top) * _BASE + come + 1) % _MOD
        out.append(h)
    return out


def tiles(test: list[int], doc: list[int], shortest: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (start in test, start in doc, length), longest first, none overlapping another.

    The search length starts at the whole test and is halved down to ``shortest``; at each length windows of unmarked
    words are matched by running Karp-Rabin hashes and checked word by word, matches are extended as far as they go,
    and the longest are marked first.
    """
    in_test, in_doc = [False] * len(test), [False] * len(doc)
    out: list[tuple[int, int, int]] = []
    length = len(test)
    while length >= shortest:
        places = defaultdict(list)
        for i, h in enumerate(_window_hashes(test, length)):
            if not any(in_test[i : i + length]):
                places[h].append(i)
        matches, longest = [], 0
        if places:
            for j, h in enumerate(_window_hashes(doc, length)):
                for i in places.get(h, ()):
                    if in_doc[j] or in_doc[j + length - 1] or test[i : i + length] != doc[j : j + length]:
                        continue
                    n = length
                    while i + n < len(test) and j + n < len(doc) and test[i + n] == doc[j + n] and not (in_test[i + n] or in_doc[j + n]):
                        n += 1
                    if not any(in_doc[j : j + n]):
                        matches.append((-n, i, j))
                        longest = max(longest, n)
        if longest > 2 * length:
            length = longest  # search again from the longest, so that it is marked first
            continue
        for n, i, j in sorted(matches):
            if not (any(in_test[i : i - n]) or any(in_doc[j : j - n])):
                in_test[i : i - n] = in_doc[j : j - n] = [True] * -n
                out.append((i, j, -n))
        length = shortest if shortest < length < 2 * shortest else length // 2
    return out


class TestItems:
    """An index of some test items: their words as numbers and the places of their seeds."""

    def __init__(self, items: list[tuple[int, str | None]], tile: int):
        self.tile = tile
        self.number: dict[str, int] = {}
        self.seqs: dict[int, list[int]] = {}
        seeds = defaultdict(set)
        self.short: dict[tuple[int, ...], list[int]] = defaultdict(list)
        for key, (_, text) in enumerate(items):
            seq = [self.number.setdefault(w, len(self.number)) for w in words(text)]
            if not seq:
                continue  # nothing to find
            self.seqs[key] = seq
            if len(seq) < tile:
                self.short[tuple(seq)].append(key)
            for i in range(len(seq) - tile + 1):
                seeds[tuple(seq[i : i + tile])].add(key)
        self.seeds = dict(seeds)
        self.ids = [i for i, _ in items]
        self.short_sizes = sorted({len(s) for s in self.short})

    def find(self, text: str | None, coverage: float) -> list[tuple[int, float, list[tuple[int, int, int]]]]:
        """(item, covered share, tiles) of the items that the text covers."""
        number = self.number
        doc = [number.get(w, -1) for w in words(text)]
        known = np.array(doc, dtype=np.int64) >= 0
        sizes = [self.tile] if self.seeds else []
        keys: dict[int, list[int]] = defaultdict(list)  # of a candidate: where its seeds stand
        for size in {*sizes, *self.short_sizes}:
            if len(doc) < size:
                continue
            run = np.convolve(known, np.ones(size, dtype=np.int64), "valid") == size
            for j in np.flatnonzero(run).tolist():
                gram = tuple(doc[j : j + size])
                if size == self.tile:
                    for key in self.seeds.get(gram, ()):
                        keys[key].append(j)
                for key in self.short.get(gram, ()) if size < self.tile else ():
                    keys[key].append(j)
        out = []
        for key, at in keys.items():
            seq = self.seqs[key]
            size = min(self.tile, len(seq))
            # only words that a seed covers can be in a tile; the rest is cut out, with a mark that equals nothing
            near, back, end = [], [], 0
            for j in at:
                if j > end:
                    near.append(-1)
                    back.append(-1)
                for k in range(max(j, end), j + size):
                    near.append(doc[k])
                    back.append(k)
                end = max(end, j + size)
            found = tiles(seq, near, size)
            covered = sum(n for _, _, n in found) / len(seq)
            if covered >= coverage:
                out.append((key, covered, [(i, back[j], n) for i, j, n in found]))
        return out


_kept: dict[str, TestItems] = {}


def _index(block: str, items: list[tuple[int, str | None]], tile: int) -> TestItems:
    """The index of a block of test items, kept in a Python worker from task to task; one block at a time."""
    if block not in _kept:
        _kept.clear()
        _kept[block] = TestItems(items, tile)
    return _kept[block]


def _blocks(test: DataFrame, id_col: str, text_col: str, block_words: int) -> Iterator[list[tuple[int, str | None]]]:
    """Test items in blocks of bounded size, one partition at a time on the driver."""
    held: list[tuple[int, str | None]] = []
    size = 0
    for row in test.select(id_col, text_col).toLocalIterator():
        held.append((row[0], row[1]))
        size += 1 + len(row[1] or "") // 4
        if size >= block_words:
            yield held
            held, size = [], 0
    if held:
        yield held


def contaminated(
    df: DataFrame, test: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    tile_words: int = TILE_WORDS, coverage: float = COVERAGE, block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """(doc_id, item_id, coverage, tiles) of each pair of a document and a test item that it covers.

    ``tiles``: (item_word, doc_word, words). Items shorter than a seed count if they occur whole; items without words
    and null texts cover nothing. Repeated rows are reported each. The test set is broadcast in blocks of at most
    ``block_words`` words, each going over all documents, so its size bounds no task. An empty frame on either side
    gives an empty one. Other columns are not read.
    """
    spark = df.sparkSession
    lean = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    kinds = [f.dataType.simpleString() for f in (lean.schema[0], test.select(item_col).schema[0])]
    tile = pa.struct([("item_word", pa.int64()), ("doc_word", pa.int64()), ("words", pa.int64())])
    schema = (
        f"doc_id {kinds[0]}, item_id {kinds[1]}, coverage double, "
        "tiles array<struct<item_word: bigint, doc_word: bigint, words: bigint>>"
    )
    out = None
    for block in _blocks(test, item_col, text_col, block_words):
        shared, name = spark.sparkContext.broadcast(block), uuid.uuid4().hex

        def search(batches: Iterator[pa.RecordBatch], shared=shared, name=name) -> Iterator[pa.RecordBatch]:
            index = _index(name, shared.value, tile_words)
            kind = pa.array([i for i in index.ids if i is not None][:1] or [0]).type
            for batch in batches:
                rows = []
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    for key, share, found in index.find(text.as_py(), coverage):
                        spans = [{"item_word": i, "doc_word": j, "words": n} for i, j, n in sorted(found)]
                        rows.append((doc, index.ids[key], share, spans))
                columns = list(zip(*rows, strict=True)) if rows else [()] * 4
                types = (batch.schema.field(0).type, kind, pa.float64(), pa.list_(tile))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, types, strict=True)],
                    names=["doc_id", "item_id", "coverage", "tiles"],
                )

        part = lean.mapInArrow(search, schema)
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], schema) if out is None else out


def drop_contaminated(df: DataFrame, test: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """The rows of ``df`` that cover no test item, with all their columns as they were."""
    spark = df.sparkSession
    out = df
    for block in _blocks(test, "item_id", "text", BLOCK_WORDS):
        shared, name = spark.sparkContext.broadcast(block), uuid.uuid4().hex

        def clean(batches: Iterator[pa.RecordBatch], shared=shared, name=name) -> Iterator[pa.RecordBatch]:
            index = _index(name, shared.value, TILE_WORDS)
            for batch in batches:
                at = batch.schema.get_field_index("text")
                yield batch.filter(pa.array([not index.find(t.as_py(), coverage) for t in batch.column(at)], pa.bool_()))

        out = out.mapInArrow(clean, df.schema)
    return out


def op8_string_tiling_decontamination(spark, sf_dir):
    return contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
