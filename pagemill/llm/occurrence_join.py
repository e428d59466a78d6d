"""Jaccard self-join of word shingle sets by T-occurrence search with DivideSkip.

A set of n shingles reaches the similarity with none that shares fewer than T = ceil(s n) with it. Of its inverted lists
T - 1 at most are set aside as long; a partner stands in one of the others, so only those are sent and grouped.

1. Each text becomes its sorted 64-bit shingles in one pass, which keeps the lowest of them and a sketch. Equal sets are
   one from here on. Texts are read again only for the sets that a step asks for.
2. Sets that agree in their lowest shingle, then those that agree in their highest, are searched in blocks of at most
   about ``BLOCK`` sets. A block is an inverted index; every set is a query against it. A group of near copies becomes a few
   components here, however large it is.
3. Short lists: the first n - T + 1 shingles of each set, in an order that puts frequent shingles last. Lists that lie in
   one component join nothing. The others are cut into chunks of bounded size; pairs of sets of different components
   that length, place and sketch allow are candidates. Sketches are parities: what two sets differ by is at least what
   their sketches do.
4. Candidates of a set are searched in blocks again. A search merges the short lists of a block by a heap and skips what
   cannot occur often enough; what has occurred is probed for in the long ones by binary search, and kept if it reaches
   the overlap that the similarity asks of both sizes. Only such occurrences become links.
"""

from __future__ import annotations

import hashlib
import heapq
import math
from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, few, materialize, read_table, row_uid
from .components import connected_components
from .shingles import shingles

WORDS, PERCENT = 3, 90
#: Sets of a block that is searched, and entries of a chunk of a list.
BLOCK, CHUNK = 128, 256
#: Occurrences from which on a shingle is put last, and most such shingles, which are broadcast.
FREQUENT, MOST_FREQUENT = 32, 1 << 17
#: Weight of a long list's probe against a merge step, by which DivideSkip parts short from long lists.
PROBE = 0.01
#: Bits of the sketch in a list's entries; a set's own has up to ``MOST_BITS``, two at least for each shingle.
SKETCH, MOST_BITS = 512, 1 << 16
#: Lists up to this length are paired many at a time, longer ones each as a matrix.
SHORT = 12


def shingle_set(text: str | None) -> np.ndarray:
    """The sorted distinct shingles of ``text``: words are parted by ASCII white space, A-Z in lower case."""
    return shingles((text or "").encode("utf-8", "surrogatepass").lower().split(), WORDS)[0]


def least_overlap(n: int, percent: int) -> int:
    """T: what a set of n shingles shares with any partner at least."""
    return -(-percent * n // 100)


def needed(n: int, m: int, percent: int) -> int:
    """The overlap by which sets of n and m shingles reach the similarity."""
    return -(-percent * (n + m) // (100 + percent))


class Block:
    """An inverted index of some sets: for each shingle the ascending places of the sets that hold it."""

    def __init__(self, sets: list[np.ndarray]):
        self.sets = sets
        tokens = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        order = np.argsort(tokens, kind="stable")
        self.holders: list[int] = np.repeat(np.arange(len(sets)), [len(s) for s in sets])[order].tolist()
        self.tokens, starts = np.unique(tokens[order], return_index=True)
        self.bounds = np.append(starts, len(tokens))

    def search(self, query: np.ndarray, percent: int, after: int = -1, wanted: Callable[[int], bool] = lambda _: True) -> Iterator[int]:
        """Places over ``after`` of the sets that ``query`` reaches ``percent`` with; unwanted ones aren't probed."""
        at = np.searchsorted(self.tokens, query)
        known = at < len(self.tokens)
        known[known] = self.tokens[at[known]] == query[known]
        at = at[known]
        lengths = self.bounds[at + 1] - self.bounds[at]
        absent = len(query) - len(at)
        most = least_overlap(len(query), percent)
        longest = int(lengths.max(initial=1))
        aside = min(most - 1, int(most / (PROBE * math.log2(longest + 1) + 1)))
        order = np.argsort(lengths, kind="stable")
        merged = max(0, len(query) - aside - absent)  # lists without entries are the shortest
        short, long = at[order[:merged]], query[known][order[merged:]]
        long.sort()
        for place, occurred in self._merge(short, most - (len(query) - absent - merged), after):
            other = self.sets[place]
            overlap = needed(len(query), len(other), percent)
            if overlap > min(len(query), len(other)) or occurred + len(long) < overlap or not wanted(place):
                continue
            probe = np.searchsorted(other, long)
            probe[probe == len(other)] = 0
            if occurred + int((other[probe] == long).sum()) >= overlap:
                yield place

    def _merge(self, lists: np.ndarray, least: int, after: int) -> Iterator[tuple[int, int]]:
        """(place, occurrences) of the places over ``after`` that occur ``least`` times in ``lists``: MergeSkip."""
        holders, least = self.holders, max(1, least)
        heap = []
        for start, end in zip(self.bounds[lists].tolist(), self.bounds[lists + 1].tolist(), strict=True):
            start = bisect_left(holders, after + 1, start, end)
            if start < end:
                heap.append((holders[start], start, end))
        heapq.heapify(heap)
        while len(heap) >= least:
            top, out = heap[0][0], []
            while heap and heap[0][0] == top:
                out.append(heapq.heappop(heap))
            if len(out) >= least:
                yield top, len(out)
                ahead = top + 1
            else:
                while heap and len(out) < least - 1:
                    out.append(heapq.heappop(heap))
                if not heap:
                    return
                ahead = heap[0][0]  # nothing before it can occur often enough
            for _, start, end in out:
                start = bisect_left(holders, ahead, start, end)
                if start < end:
                    heapq.heappush(heap, (holders[start], start, end))


def sketch(items: np.ndarray) -> bytes:
    """Parities of the shingles by their last bits, two bits at least for each shingle up to ``MOST_BITS``."""
    bits = min(MOST_BITS, max(SKETCH, 1 << (2 * len(items) - 1).bit_length())) if len(items) else SKETCH
    return np.packbits((np.bincount((items & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)).tobytes()


def folded(own: bytes, size: int) -> np.ndarray:
    """A sketch of ``size`` bytes: of a larger one, parities of what falls together."""
    whole = np.frombuffer(own, np.uint8)
    return np.bitwise_xor.reduce(whole.reshape(-1, size), axis=0)


def _sets(df: DataFrame, id_col: str, text_col: str, percent: int) -> DataFrame:
    """Materialised rows: id, text, n, digest of the set, lows (more than the prefix), high, sketch, uid."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, digests, lows, highs, sketches = [], [], [], [], []
            for text in batch.column(1):
                items = shingle_set(text.as_py())
                n.append(len(items))
                digests.append(hashlib.blake2b(items.tobytes(), digest_size=16).digest())
                prefix = len(items) - least_overlap(len(items), percent)
                lows.append(items[: prefix + prefix // 2 + 2].view(np.int64))
                highs.append(int(items[-1:].view(np.int64).sum()))
                sketches.append(sketch(items))
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns, pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(lows, pa.list_(pa.int64())),
                    pa.array(highs, pa.int64()), pa.array(sketches, pa.binary()),
                ],
                names=["id", "text", "n", "digest", "lows", "high", "sketch"],
            )

    source = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    schema = f"id {kind}, text string, n bigint, digest binary, lows array<bigint>, high bigint, sketch binary"
    return materialize(source.mapInArrow(read, schema).withColumn("uid", row_uid()), "sets")


def _in_blocks(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Rows (block, uid, component, text) in the order of blocks: links (a, b) that connect what a block holds."""
    held: list[tuple[int, int, np.ndarray]] = []
    block = None

    def links() -> pa.RecordBatch:
        parent = {c: c for _, c, _ in held}

        def find(c: int) -> int:
            while parent[c] != c:
                parent[c] = c = parent[parent[c]]
            return c

        index, a, b = Block([s for *_, s in held]), [], []
        for k, (uid, component, items) in enumerate(held):
            own = find(component)
            if all(find(c) == own for _, c, _ in held[k + 1 :]):
                continue
            for place in index.search(items, percent, k, lambda p: find(held[p][1]) != find(component)):  # noqa: B023
                parent[find(held[place][1])] = find(component)
                a.append(uid)
                b.append(held[place][0])
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    for batch in batches:
        for at, uid, component, text in zip(*(c.to_pylist() for c in batch.columns[:3]), batch.column(3), strict=True):
            if at != block:
                if len(held) > 1:
                    yield links()
                held, block = [], at
            held.append((uid, component, shingle_set(text.as_py())))
    if len(held) > 1:
        yield links()


def _block_links(sets: DataFrame, placed: DataFrame, percent: int) -> DataFrame:
    """Links found in blocks of the sets of ``placed`` (key, uid, component) that share a key."""
    keys = materialize(
        placed.groupBy("key").agg(F.count("*").alias("c"), F.min("component").alias("c1"), F.max("component").alias("c2"))
        .filter("c1 < c2").select("key", F.ceil(F.col("c") / F.lit(BLOCK)).alias("blocks")),
        "keys",
    )
    # a group larger than a block is dealt by the key's own hash of its members, so that the next key mixes it anew
    block = F.xxhash64("key", F.pmod(F.xxhash64("key", "uid"), F.col("blocks")))
    dealt = materialize(placed.join(keys, "key").select(block.alias("block"), "uid", "component"), "dealt")
    rows = sets.select("uid", "text").join(few(dealt), "uid").select("block", "uid", "component", "text")
    found = materialize(
        rows.repartition("block").sortWithinPartitions("block", "uid").mapInArrow(lambda b: _in_blocks(b, percent), "a bigint, b bigint"),
        "links",
    )
    discard(keys, dealt)
    return found


def _counted(sets: DataFrame) -> tuple[DataFrame, tuple[np.ndarray, np.ndarray]]:
    """Shingles that occur twice or more among the lowest ones of all sets, materialised; and the frequent of them.

    Those are at most ``MOST_FREQUENT`` (shingles, occurrences); whichever are put last, results are the same.
    """
    often = materialize(
        sets.select(F.explode("lows").alias("item")).groupBy("item").agg(F.count("*").alias("c")).filter("c > 1"), "often"
    )
    found = often.filter(F.col("c") >= FREQUENT).orderBy(F.desc("c"), "item").limit(MOST_FREQUENT).toPandas()
    items = found["item"].to_numpy(dtype=np.int64).view(np.uint64)
    order = np.argsort(items)
    return often, (items[order], found["c"].to_numpy(dtype=np.int64)[order])


def _short_lists(sets: DataFrame, texts: DataFrame, frequent: tuple[np.ndarray, np.ndarray], percent: int) -> tuple[DataFrame, DataFrame]:
    """(item, uid, place): entries of the short lists of ``sets`` (uid, n, lows); and those read from ``texts`` (uid, text), materialised.

    The lowest shingles do for most sets. A set that has too few beside frequent ones is read again from its text, and
    frequent ones come last, the rarest of them first.
    """
    shared = sets.sparkSession.sparkContext.broadcast(frequent)

    def occurrences(items: np.ndarray) -> np.ndarray:
        often, counts = shared.value
        if not len(often):
            return np.zeros(len(items), np.int64)
        at = np.minimum(np.searchsorted(often, items), len(often) - 1)
        return np.where(often[at] == items, counts[at], 0)

    def entries(found: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
        uids = np.repeat([uid for uid, _ in found], [len(x) for _, x in found]).astype(np.int64)
        items = np.concatenate([x for _, x in found]) if found else np.zeros(0, np.uint64)
        places = np.concatenate([np.arange(len(x)) for _, x in found]) if found else np.zeros(0, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(items.view(np.int64)), pa.array(uids), pa.array(places)], names=["item", "uid", "place"])

    def lowest(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray]]:
        for uid, n, lows in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            items = np.asarray(lows.values, dtype=np.int64).view(np.uint64)
            yield uid, n - least_overlap(n, percent) + 1, items[occurrences(items) == 0]

    def from_lows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield entries([(uid, rare[:length]) for uid, length, rare in lowest(batch) if len(rare) >= length])

    def lacking(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([uid for uid, length, rare in lowest(batch) if len(rare) < length], pa.int64())], names=["uid"])

    def from_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for uid, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                items = shingle_set(text.as_py())
                order = np.lexsort((items, occurrences(items)))
                found.append((uid, items[order[: len(items) - least_overlap(len(items), percent) + 1]]))
            yield entries(found)

    entry = "item bigint, uid bigint, place bigint"
    low = sets.select("uid", "n", "lows")
    asked = materialize(low.mapInArrow(lacking, "uid bigint"), "lacking")
    read = materialize(texts.join(few(asked), "uid").mapInArrow(from_text, entry), "entries")
    discard(asked)
    return low.mapInArrow(from_lows, entry), read


def _pairs_of(lengths: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all pairs within lists of up to ``SHORT`` entries."""
    left, right = [], []
    for c in range(2, SHORT + 1):
        at = starts[lengths == c]
        i, j = np.triu_indices(c, 1)
        left.append((at[:, None] + i).ravel())
        right.append((at[:, None] + j).ravel())
    return np.concatenate(left), np.concatenate(right)


def _paired(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Chunks (one, other) of lists to the pairs (a, b) that may reach the similarity; other: null for those within one."""

    def columns(lists: pa.Array) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
        flat = lists.flatten()
        numbers = [flat.field(k).to_numpy(zero_copy_only=False) for k in range(4)]
        bits = np.frombuffer(b"".join(flat.field(4).to_pylist()), np.uint64).reshape(len(flat), -1) if len(flat) else np.zeros((0, SKETCH // 64), np.uint64)
        lengths = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        return lengths, numbers, bits

    def fitting(x: list[np.ndarray], sx: np.ndarray, i: np.ndarray, y: list[np.ndarray], sy: np.ndarray, j: np.ndarray) -> set[tuple[int, int]]:
        (uid, c, n, p), (uid2, c2, n2, p2) = x, y
        need = -(-percent * (n[i] + n2[j]) // (100 + percent))
        ok = (c[i] != c2[j]) & (np.minimum(n[i] - p[i], n2[j] - p2[j]) >= need)
        i, j, need = i[ok], j[ok], need[ok]
        ok = n[i] + n2[j] - 2 * need >= np.bitwise_count(sx[i] ^ sy[j]).sum(axis=1, dtype=np.int64)
        a, b = uid[i[ok]], uid2[j[ok]]
        return set(zip(np.minimum(a, b).tolist(), np.maximum(a, b).tolist(), strict=True))

    for batch in batches:
        lengths, x, sx = columns(batch.column(0))
        lengths2, y, sy = columns(batch.column(1))
        starts, starts2 = np.cumsum(lengths) - lengths, np.cumsum(lengths2) - lengths2
        alone = lengths2 == 0
        i, j = _pairs_of(np.where(alone, lengths, 0), starts)
        found = fitting(x, sx, i, x, sx, j)
        for k in np.flatnonzero(~alone | (lengths > SHORT)):
            if alone[k]:
                i, j = np.triu_indices(lengths[k], 1)
                found |= fitting(x, sx, i + starts[k], x, sx, j + starts[k])
            else:
                i, j = np.divmod(np.arange(lengths[k] * lengths2[k]), lengths2[k])
                found |= fitting(x, sx, i + starts[k], y, sy, j + starts2[k])
        a, b = zip(*found, strict=True) if found else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _sketched(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b, n, m, sketch, other) to those whose whole sketches allow the similarity."""
    for batch in batches:
        ok = []
        for n, m, one, other in zip(*(batch.column(k).to_pylist() for k in range(2, 6)), strict=True):
            size = min(len(one), len(other))
            apart = int(np.bitwise_count(folded(one, size) ^ folded(other, size)).sum(dtype=np.int64))
            ok.append(n + m - 2 * needed(n, m, percent) >= apart)
        yield batch.select([0, 1]).filter(pa.array(ok, pa.bool_()))


def _candidates(sets: DataFrame, singles: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of sets of different components that share a short list and may reach the similarity, materialised."""
    often, frequent = _counted(sets)
    mine = sets.select("uid", "n", "lows").join(few(singles), "uid")
    low, read = _short_lists(mine, sets.select("uid", "text"), frequent, percent)
    # an item of one set's lowest only joins nothing, unless a set that was read from its text has it
    joining = often.select("item").unionByName(read.select("item")).distinct()
    shared = materialize(low.unionByName(read).join(joining, "item"), "shared")
    lists = shared.join(singles, "uid")
    mixed = materialize(
        lists.groupBy("item").agg(F.count("*").alias("c"), F.min("component").alias("c1"), F.max("component").alias("c2"))
        .filter("c1 < c2").select("item", F.ceil(F.col("c") / F.lit(CHUNK)).alias("chunks")),
        "lists",
    )
    entries = materialize(lists.join(mixed, "item"), "entries")
    fold = F.udf(lambda own: folded(own, SKETCH // 8).tobytes(), "binary", useArrow=True)
    involved = materialize(entries.select("uid").distinct(), "involved")
    own = materialize(sets.select("uid", "n", "sketch").join(few(involved), "uid"), "sketches")
    entry = F.struct("uid", "component", "n", "place", "sketch")
    chunks = materialize(
        entries.join(own.withColumn("sketch", fold("sketch")), "uid").withColumn("chunk", F.pmod(F.xxhash64("uid"), F.col("chunks")))
        .groupBy("item", "chunks", "chunk").agg(F.collect_list(entry).alias("list")),
        "chunks",
    )
    cut = chunks.filter("chunks > 1")
    across = cut.join(cut.select("item", F.col("chunk").alias("next"), F.col("list").alias("other")), "item").filter("chunk < next")
    within = chunks.withColumn("other", F.lit(None).cast(chunks.schema["list"].dataType)).filter(F.size("list") > 1)
    paired = within.select("list", "other").unionByName(across.select("list", "other"))
    found = materialize(paired.mapInArrow(lambda b: _paired(b, percent), "a bigint, b bigint").distinct(), "pairs")
    one, other = (own.select(F.col("uid").alias(k), F.col("n").alias(f"n_{k}"), F.col("sketch").alias(f"s_{k}")) for k in "ab")
    both = found.join(one, "a").join(other, "b").select("a", "b", "n_a", "n_b", "s_a", "s_b")
    kept = materialize(both.mapInArrow(lambda b: _sketched(b, percent), "a bigint, b bigint"), "pairs")
    discard(often, read, shared, mixed, entries, involved, chunks, found, own)
    return kept


def _searched(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Rows (a, part, b, text), the query (null b) before its candidates: links (a, b)."""
    a, query, held = None, None, []

    def links() -> pa.RecordBatch:
        index = Block([s for _, s in held])
        near = [held[place][0] for place in index.search(query, percent)]
        return pa.RecordBatch.from_arrays([pa.array([a[0]] * len(near), pa.int64()), pa.array(near, pa.int64())], names=["a", "b"])

    for batch in batches:
        for one, part, b, text in zip(*(c.to_pylist() for c in batch.columns[:3]), batch.column(3), strict=True):
            items = shingle_set(text.as_py())
            if (one, part) != a:
                if held:
                    yield links()
                a, query, held = (one, part), items, []
            else:
                held.append((b, items))
    if held:
        yield links()


def _search(sets: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sets reach the similarity, materialised: a is the query, blocks of its b's are indexed."""
    parts = materialize(pairs.groupBy("a").agg(F.ceil(F.count("*") / F.lit(BLOCK)).alias("parts")), "queries")
    asked = materialize(pairs.select("a").union(pairs.select("b")).distinct().withColumnRenamed("a", "uid"), "asked")
    texts = materialize(sets.select("uid", "text").join(few(asked), "uid"), "texts")
    part = F.pmod(F.xxhash64("b"), F.col("parts"))
    indexed = pairs.join(parts, "a").select("a", part.alias("part"), "b").join(texts.withColumnRenamed("uid", "b"), "b")
    queries = parts.select("a", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("part")).join(
        texts.withColumnRenamed("uid", "a"), "a"
    )
    rows = queries.select("a", "part", F.lit(None).cast("bigint").alias("b"), "text").unionByName(indexed.select("a", "part", "b", "text"))
    found = materialize(
        rows.repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())
        .mapInArrow(lambda b: _searched(b, percent), "a bigint, b bigint"),
        "links",
    )
    discard(parts, asked, texts)
    return found


def _labelled(df: DataFrame, links: DataFrame | None) -> DataFrame:
    """``df`` with the component of its ``uid``, itself where nothing links it."""
    if links is None:
        return df.withColumn("component", F.col("uid"))
    labels = connected_components(links).select(F.col("node").alias("uid"), F.col("component").alias("label"))
    return df.join(labels, "uid", "left").withColumn("component", F.coalesce("label", "uid")).drop("label")


def shingle_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id.

    A document's set holds its distinct shingles of three words (fewer words: one shingle of all of them); words are parted
    by ASCII white space, A-Z in lower case. Two sets link when their Jaccard similarity is ``percent`` hundredths or more, and
    component_id is the least id that links reach, the document's own included; ids that are null come last. Null texts
    and those without words have empty sets and link with nothing. Repeated rows are equal sets. Texts of any length are
    read whole. An empty frame gives an empty one. Other columns are not read. Shingles are told apart by 64 bits.
    """
    sets = _sets(df, id_col, text_col, percent)
    ids = sets.select("uid", "id", "n", "digest")
    first: Column = F.min("uid").alias("first")
    firsts = materialize(ids.filter("n > 0").groupBy("digest").agg(first), "firsts")
    members = materialize(
        ids.filter("n > 0").join(firsts, "digest").select("uid", "id", "n", "first")
        .unionByName(ids.filter("n = 0").select("uid", "id", "n", F.col("uid").alias("first"))),
        "members",
    )
    discard(firsts)
    one_each = members.filter("uid = first and n > 0").select("uid")
    keys = sets.select("uid", F.element_at("lows", 1).alias("low"), "high", "n").filter("n > 0").join(one_each, "uid")
    links: DataFrame | None = None
    for key in ("low", "high"):
        placed = materialize(_labelled(keys.select("uid", F.col(key).alias("key")), links), "placed")
        found = _block_links(sets, placed, percent)
        links = found if links is None else links.unionByName(found)
        discard(placed)
    singles = materialize(_labelled(one_each, links), "singles")
    pairs = _candidates(sets, singles, percent)
    links = links.unionByName(_search(sets, pairs, percent))
    discard(pairs, singles)
    labelled = materialize(_labelled(members.withColumnRenamed("uid", "own").withColumnRenamed("first", "uid"), links), "labelled")
    least = materialize(labelled.groupBy("component").agg(F.min("id").alias("least")), "components")
    return labelled.join(least, "component").select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("least").alias("component_id")
    )


def op13_occurrence_jaccard_join(spark, sf_dir):
    return shingle_components(read_table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), sets AS MATERIALIZED (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM words
), shingles AS MATERIALIZED (
  SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets
), links AS MATERIALIZED (
  SELECT a.doc_id AS a, b.doc_id AS b FROM shingles a JOIN shingles b ON a.x = b.x AND a.doc_id <> b.doc_id
    AND 10 * a.n >= 9 * b.n AND 10 * b.n >= 9 * a.n
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))
), reached AS (
  SELECT a AS doc_id, a AS other FROM links
  UNION
  SELECT r.doc_id, l.b FROM reached r JOIN links l ON r.other = l.a
)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, coalesce(c.component_id, s.doc_id) AS component_id
FROM sets s LEFT JOIN (SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id) c ON s.doc_id = c.doc_id
"""
