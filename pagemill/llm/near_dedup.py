"""Near duplicates by improved consistent weighted sampling over TF-IDF shingles.

1. Document frequencies, exact: a slice of documents counts its own shingles, ranges of shingles add up the slices'
   counts and send each slice those of its shingles that several documents hold. All others have a frequency of 1. A
   shingle weighs tf * ln(1 + N / df), whatever its frequency.
2. Texts with the same words are collapsed to one representative.
3. Each representative is sampled ``BANDS * ROWS`` times in proportion to the weights; equal bands share a bucket.
   A pair of similarity 0.8 shares one with probability 1 - (1 - 0.8**4)**16 > 0.9997.
4. In every bucket each member is paired with the bucket's first member, and the pairs are verified by weighted
   Jaccard similarity on the whole texts. Linked members are connected.
5. Where a bucket still holds several components, its largest one is kept as one row with some drawn members. Rounds
   pair each stray, a member outside it, with one of these and with one of the strays, as long as that links many. A
   round reads the strays alone, however large the component is.
6. The rest, exactly: what buckets then still hold unconnected is joined by prefix filtering, and the pairs that may
   be similar are verified too, so no bucket is capped and no link is lost for its size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, few, free_shuffles, materialize, read_table, row_uid, whole_row
from .components import connected_components
from .shingles import digest, shingles, text_numbers

SIMILARITY = 0.8
BANDS, ROWS = 16, 4
#: Most shingles, and share of the documents, up to which frequencies are not told apart: none, so this is plain TF-IDF.
HEAVY, RARE_SHARE = float("inf"), 0.0
#: Documents of a slice are two to this power; shingles of a range, about.
SLICE_BITS, RANGE_SHINGLES = 9, 2_000_000
#: Least idf of a shingle that a text's sketch shows: one that up to a hundredth of the documents hold.
SKETCHED = float(np.log1p(100))
#: Rows of random variates; shingles share a row by their leading bits.
VARIATES = 1 << 16
#: Shingles sampled at once.
CHUNK = 8192
#: Shingles of a text that may be a sample, about; a sample that is none of these is found among all.
CANDIDATES = 8
#: Most further rounds, and pairs for each link of a round after which another is worth it; the exact rest follows.
ROUNDS, PAIRS_A_LINK = 12, 50
#: Words of 64 bits in a text's sketch of its rarer shingles.
SKETCH = 8


class Sampler:
    """ICWS (Ioffe 2010): the k-th sample of a weighted set is (shingle, t) with the least ln a."""

    def __init__(self, unit: float, seed: int = 1):
        rng = np.random.default_rng(seed)
        shape = (VARIATES, BANDS * ROWS)
        self.r = rng.gamma(2, 1, shape).astype(np.float32)
        self.log_c = np.log(rng.gamma(2, 1, shape)).astype(np.float32)
        self.beta = rng.random(shape).astype(np.float32)
        self.unit = unit  # the weight of a shingle that occurs once, in one document: most have it
        self.log_unit = np.float32(np.log(unit))
        # ln a is least for the greatest weight. For shares of 1/4, 1/8, ... of all variates: those of the least ln a for the unit, by row.
        places, values = np.arange(VARIATES * BANDS * ROWS, dtype=np.int32), np.empty(VARIATES * BANDS * ROWS, np.float32)
        for at in range(0, len(places), CHUNK * BANDS * ROWS):
            part = places[at : at + CHUNK * BANDS * ROWS]
            values[part] = self._log_a(part, self.log_unit)
        self.levels = []
        for share in (4, *[2] * 11):
            most = np.partition(values, len(values) // share)[len(values) // share]
            places, values = places[values <= most], values[values <= most]
            self.levels.append((most, np.searchsorted(places, np.arange(VARIATES + 1) * BANDS * ROWS), places, values))

    def _t(self, places, log_w):
        return np.floor(log_w / self.r.ravel()[places] + self.beta.ravel()[places])

    def _log_a(self, places, log_w):
        """ln a for weights of logarithm ``log_w`` by the variates at ``places``, row after row."""
        return self.log_c.ravel()[places] - self.r.ravel()[places] * (self._t(places, log_w) - self.beta.ravel()[places] + 1)

    def _candidates(self, rows: np.ndarray, log_w: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(which of ``rows``, sample, ln a): a level's for weights up to the unit, all for heavier ones."""
        _, starts, places, values = self.levels[level]
        n = starts[rows + 1] - starts[rows]
        heavy = np.flatnonzero(log_w > self.log_unit)
        n[heavy] = 0
        ends = np.cumsum(n)
        at = np.arange(ends[-1]) + np.repeat(starts[rows] - ends + n, n)
        which, place, value = np.repeat(np.arange(len(rows)), n), places[at], values[at]
        less = np.flatnonzero(log_w[which] != self.log_unit)
        value[less] = self._log_a(place[less], log_w[which[less]])
        if len(heavy):
            every = (rows[heavy, None] * (BANDS * ROWS) + np.arange(BANDS * ROWS)).ravel()
            of = np.repeat(heavy, BANDS * ROWS)
            which, place, value = np.append(which, of), np.append(place, every), np.append(value, self._log_a(every, log_w[of]))
        return which, (place % (BANDS * ROWS)).astype(np.intp), value

    def bands(self, items: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """A 64-bit number for each band."""
        k = np.arange(BANDS * ROWS)
        least, which = np.full(len(k), np.inf, dtype=np.float32), np.zeros(len(k), dtype=np.int64)
        rows, log_w = (items >> np.uint64(48)).astype(np.int64), np.log(weights).astype(np.float32)

        def keep(at: int, which_row: np.ndarray, sample: np.ndarray, value: np.ndarray) -> None:
            """Keep the least values; of equal ones the first row's."""
            found = np.full(len(k), np.inf, dtype=np.float32)
            np.minimum.at(found, sample, value)
            equal = value == found[sample]
            row = np.full(len(k), len(items))
            np.minimum.at(row, sample[equal], at + which_row[equal])
            less = found < least
            least[less], which[less] = found[less], row[less]

        level = int(np.log2(max(1, len(items) / CANDIDATES))) - 2
        open_samples = k
        if level >= 0:
            level = min(level, len(self.levels) - 1)
            for at in range(0, len(items), CHUNK):
                keep(at, *self._candidates(rows[at : at + CHUNK], log_w[at : at + CHUNK], level))
            # what is no candidate has an ln a over the level's
            open_samples = np.flatnonzero(least > self.levels[level][0])
            least[open_samples] = np.inf
        for at in range(0, len(items) if len(open_samples) else 0, CHUNK):
            part = log_w[at : at + CHUNK]
            log_a = self._log_a(rows[at : at + CHUNK, None] * len(k) + open_samples, part[:, None])
            best = log_a.argmin(axis=0)
            value = log_a[best, np.arange(len(open_samples))]
            less = value < least[open_samples]
            least[open_samples[less]], which[open_samples[less]] = value[less], at + best[less]
        t = self._t(rows[which] * len(k) + k, log_w[which]).astype(np.int64).astype(np.uint64)
        sample = (items[which] ^ (t * np.uint64(0xD6E8FEB86659FD93))).reshape(BANDS, ROWS)
        out = np.arange(BANDS, dtype=np.uint64)
        for row in range(ROWS):
            out = (out * np.uint64(0x9E3779B97F4A7C15)) ^ sample[:, row]
            out ^= out >> np.uint64(31)
            out *= np.uint64(0xBF58476D1CE4E5B9)
        return out


class Weights:
    """TF-IDF weights of the shingles of a text among ``documents``."""

    def __init__(self, documents: int):
        self.documents = documents

    def idf(self, df: np.ndarray) -> np.ndarray:
        return np.log1p(self.documents / df)

    def of(self, text: str | None, df: pa.BinaryScalar) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(shingles, tf, idf), by the document frequencies of the text's shingles in their order."""
        items, tf = shingles(text_numbers(text))
        return items, tf, self.idf(np.frombuffer(df.as_py(), np.int32)) if len(items) else np.zeros(0)


_samplers: dict[float, Sampler] = {}


def _cut(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """``values`` as binaries, cut at ``ends`` (from 0 to their number)."""
    offsets = (ends * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def _values(cuts: pa.ChunkedArray, kind: type) -> np.ndarray:
    """The values of a column of binaries, one after the other."""
    whole = b"".join(cuts.to_pylist())
    return np.frombuffer(whole, kind) if whole else np.zeros(0, kind)


def document_frequencies(texts: DataFrame) -> DataFrame:
    """(slice, items, df): the shingles of each slice of ``texts`` (slice, text) that several documents hold, materialised.

    ``items`` are numbers of 64 bits, ``df`` of 32. Exact. What a range holds at once follows from the number of slices and of its shingles, not from how often one occurs.
    """
    size = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    bits = max(3, (size // 6 // RANGE_SHINGLES).bit_length())  # about six characters a word

    def report(key: int, held: list[np.ndarray]) -> pa.RecordBatch:
        items, n = np.unique(np.concatenate(held), return_counts=True)
        ranges, starts = np.unique(items >> np.uint64(64 - bits), return_index=True)
        cuts = [_cut(x, np.append(starts, len(items))) for x in (items, n.astype(np.int32))]
        columns = [pa.array(np.full(len(ranges), key, np.int64)), pa.array(ranges.astype(np.int32)), *cuts]
        return pa.RecordBatch.from_arrays(columns, names=["slice", "range", "items", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            for k, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if k != key and held:
                    yield report(key, held)
                    held = []
                key = k
                held.append(shingles(text_numbers(text.as_py()))[0])
        if held:
            yield report(key, held)

    def add(counts: pa.Table) -> pa.Table:
        items, sizes = _values(counts.column("items"), np.uint64), pc.binary_length(counts.column("items")).to_numpy() // 8
        _, which = np.unique(items, return_inverse=True)
        df = np.bincount(which, _values(counts.column("n"), np.int32))[which].astype(np.int32)
        often = df > 1
        left = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[often], minlength=len(sizes))
        cuts = [_cut(x[often], np.append(0, np.cumsum(left))) for x in (items, df)]
        return pa.table([counts.column("slice"), *cuts], names=["slice", "items", "df"]).filter(pa.array(left > 0))

    counted = texts.select("slice", "text").mapInArrow(count, "slice bigint, range int, items binary, n binary")
    return materialize(counted.groupBy("range").applyInArrow(add, "slice bigint, items binary, df binary"), "frequencies")


def _signatures(texts: DataFrame, frequencies: DataFrame, documents: int) -> DataFrame:
    """Materialised rows for ``texts`` (__uid, slice, text): ``__uid``, ``__digest``, ``__df``, ``__bands``.

    ``__df`` has the document frequency of each distinct shingle, in their order, in 32 bits each. The rows of a slice meet its frequencies.
    """

    def sign(held: pa.Table, known: pa.Table) -> pa.Table:
        weights = Weights(documents)
        unit = float(weights.idf(np.ones(1))[0])
        if unit not in _samplers:
            _samplers.clear()
            _samplers[unit] = Sampler(unit)
        sampler = _samplers[unit]
        often, n = _values(known.column("items"), np.uint64), _values(known.column("df"), np.int32)
        order = np.argsort(often)
        often, n = often[order], n[order]
        digests, frequent, bands = [], [], []
        for text in held.column("text"):
            numbers = text_numbers(text.as_py())
            digests.append(digest(numbers))
            items, tf = shingles(numbers)
            df = np.ones(len(items), np.int32)
            if len(often):
                place = np.minimum(np.searchsorted(often, items), len(often) - 1)
                df = np.where(often[place] == items, n[place], df)
            frequent.append(df.astype(np.int32).tobytes())
            bands.append(sampler.bands(items, tf * weights.idf(df)).view(np.int64) if len(items) else [])
        return pa.table(
            [
                held.column("__uid"), pa.array(digests, pa.binary()), pa.array(frequent, pa.binary()),
                pa.array(bands, pa.list_(pa.int64())),
            ],
            names=["__uid", "__digest", "__df", "__bands"],
        )

    schema = "__uid bigint, __digest binary, __df binary, __bands array<bigint>"
    return materialize(texts.groupBy("slice").cogroup(frequencies.groupBy("slice")).applyInArrow(sign, schema), "signatures")


def _verify(pairs: DataFrame, texts: DataFrame, documents: int, similarity: float) -> DataFrame:
    """The pairs (a, b) whose weighted Jaccard similarity reaches ``similarity``, materialised."""
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = Weights(documents)
        last: tuple = (None, None)  # rows of the same b often follow each other
        for batch in batches:
            ok = []
            for b, text_a, df_a, text_b, df_b in zip(batch.column(1).to_pylist(), *batch.columns[2:], strict=True):
                if last[0] != b:
                    last = (b, weights.of(text_b.as_py(), df_b))
                (x, tf_x, w_x), (y, tf_y, w_y) = weights.of(text_a.as_py(), df_a), last[1]
                _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
                shared_weight = float((np.minimum(tf_x[i], tf_y[j]) * w_x[i]).sum())
                union = float((tf_x * w_x).sum() + (tf_y * w_y).sum()) - shared_weight
                ok.append(union > 0 and shared_weight >= similarity * union * (1 - 1e-12))
            yield batch.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    sides = (
        pairs.join(texts.select(F.col("__uid").alias("a"), F.col("__text").alias("text_a"), F.col("__df").alias("df_a")), "a")
        .join(texts.select(F.col("__uid").alias("b"), F.col("__text").alias("text_b"), F.col("__df").alias("df_b")), "b")
        .select("a", "b", "text_a", "df_a", "text_b", "df_b")
    )
    return materialize(sides.mapInArrow(compare, "a bigint, b bigint"), "edges")


def _rest_pairs(members: DataFrame, documents: int, similarity: float) -> DataFrame:
    """Pairs (a, b) of members (uid, component, __text, __df) of different components that may reach ``similarity``.

    Prefix filtering: in an order that all texts share, rarest shingles first, let z be the first shingle that two
    texts of similarity t have in common. Their overlap is at least t / (1 + t) of both weights together, and all of
    it lies at z and after. So before z stand at most 1 - 2t / (1 + t) of the lighter text's weight and at most 1 - t
    of the heavier one's, and the lighter weighs at least t times the heavier. Pairs are joined on such z.
    Shingles of one component only join nothing; they come first in the order and are not sent back. At z, what stands
    before it in both texts bounds the overlap, and so do the sketches: a bit that only one text has stands for a
    shingle of at least the weight ``SKETCHED`` that the other lacks.
    """

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = Weights(documents)
        for batch in batches:
            for uid, component, text, df in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), *batch.columns[2:], strict=True):
                items, tf, idf = weights.of(text.as_py(), df)
                w = tf * idf
                rare = idf >= SKETCHED
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(items), uid, np.int64)), pa.array(np.full(len(items), component, np.int64)),
                        pa.array(items.view(np.int64)), pa.array(w), pa.array(np.full(len(items), w.sum())), pa.array(rare),
                    ],
                    names=["uid", "component", "item", "w", "weight", "rare"],
                )

    rows = materialize(
        members.mapInArrow(weigh, "uid bigint, component bigint, item bigint, w double, weight double, rare boolean"), "shingles"
    )
    bits = [
        F.coalesce(F.bit_or(F.expr(f"if(rare and (item >> 6 & {SKETCH - 1}) = {k}, 1L << cast(item & 63 as int), 0L)")), F.lit(0))
        .alias(f"s{k}") for k in range(SKETCH)
    ]
    sketches = rows.groupBy("uid").agg(*bits).select("uid", F.array(*[f"s{k}" for k in range(SKETCH)]).alias("sketch"))
    mixed = (
        rows.groupBy("item").agg(F.count("*").alias("df"), F.min("component").alias("c1"), F.max("component").alias("c2"))
        .filter("c1 < c2").select("item", "df")
    )
    order = Window.partitionBy("uid").orderBy("df", "item")
    running = F.sum("w").over(order.rowsBetween(Window.unboundedPreceding, -1))
    joining = F.sum("w").over(Window.partitionBy("uid"))
    before = (F.col("weight") - joining + F.coalesce(running, F.lit(0.0))) / F.col("weight")
    prefix = materialize(
        rows.join(mixed, "item").withColumn("before", before).filter(F.col("before") <= 1 - similarity + 1e-9)
        .select("item", "uid", "component", "weight", "before").join(sketches, "uid"),
        "prefixes",
    )
    light = prefix.filter(F.col("before") <= 1 - 2 * similarity / (1 + similarity) + 1e-9).select(
        "item", F.col("uid").alias("a"), F.col("component").alias("ca"), F.col("weight").alias("wa"),
        F.col("before").alias("pa"), F.col("sketch").alias("sa"),
    )
    heavy = prefix.select(
        "item", F.col("uid").alias("b"), F.col("component").alias("cb"), F.col("weight").alias("wb"),
        F.col("before").alias("pb"), F.col("sketch").alias("sb"),
    )
    fits = (F.col("ca") != F.col("cb")) & (F.col("wa") <= F.col("wb")) & (F.col("wa") >= similarity * F.col("wb") * (1 - 1e-9))
    need = similarity / (1 + similarity) * (F.col("wa") + F.col("wb")) * (1 - 1e-9)
    fits &= (F.col("wa") * (1 - F.col("pa")) >= need) & (F.col("wb") * (1 - F.col("pb")) >= need)
    for own, other, weight in (("sa", "sb", "wa"), ("sb", "sa", "wb")):
        lacking = " + ".join(f"bit_count({own}[{k}] & ~{other}[{k}])" for k in range(SKETCH))
        fits &= F.col(weight) - F.lit(SKETCHED) * F.expr(lacking) >= need
    return light.join(heavy, "item").filter(fits).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _open_buckets(placed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The buckets of several components in ``placed`` (bucket, uid, component), materialised.

    (bucket, main, draws): the bucket's largest component and one of its members for each round; and the strays
    (bucket, uid, component), the members outside it. The one pair of a bucket of two is verified already.
    """
    draws = [F.min_by("uid", F.xxhash64("uid", F.lit(turn))) for turn in range(ROUNDS)]
    parts = placed.groupBy("bucket", "component").agg(F.count("*").alias("n"), F.array(*draws).alias("draws"))
    mains = materialize(
        parts.groupBy("bucket").agg(
            F.max_by(F.struct("component", "draws"), F.struct("n", "component")).alias("main"),
            F.count("*").alias("kinds"), F.sum("n").alias("n"),
        )
        .filter("kinds > 1 and n > 2").select("bucket", F.col("main.component").alias("main"), "main.draws"),
        "mains",
    )
    strays = placed.join(mains.select("bucket", "main"), "bucket").filter("component <> main").drop("main")
    return mains, materialize(strays, "strays")


def _relabel(df: DataFrame, column: str, merged: DataFrame) -> DataFrame:
    """``df`` with the components of ``column`` that were ``merged`` (node, component) by their new names."""
    new = merged.select(F.col("node").alias(column), F.col("component").alias("__new"))
    return df.join(new, column, "left").withColumn(column, F.coalesce("__new", column)).drop("__new")


def _link_rest(placed: DataFrame, known: DataFrame, texts: DataFrame, documents: int, similarity: float) -> DataFrame | None:
    """Links (a, b) between the components of ``placed`` (bucket, uid, component), beyond the pairs ``known``."""
    mains, strays = _open_buckets(placed)
    if strays.isEmpty():
        discard(mains, strays)
        return None
    asked: list[DataFrame] = []
    wanted = strays.select("uid").union(mains.select(F.explode("draws"))).distinct()
    wanted = materialize(wanted.withColumnRenamed("uid", "__uid"), "wanted")
    own = materialize(texts.join(few(wanted), "__uid"), "texts")
    discard(wanted)
    links = merges = None
    for turn in range(ROUNDS):
        drawn = materialize(
            strays.groupBy("bucket").agg(F.max_by(F.struct("uid", "component"), F.xxhash64("uid", F.lit(turn))).alias("drawn"))
            .join(mains.select("bucket", "main", F.col("draws")[turn].alias("draw")), "bucket"),
            "drawn",
        )
        others = F.array(F.struct(F.col("draw").alias("uid"), F.col("main").alias("component")), F.col("drawn"))
        pairs = materialize(
            strays.join(drawn, "bucket").select("uid", "component", F.explode(others).alias("o")).filter("component <> o.component")
            .select(
                F.least("uid", "o.uid").alias("a"), F.greatest("uid", "o.uid").alias("b"),
                F.least("component", "o.component").alias("ca"), F.greatest("component", "o.component").alias("cb"),
            )
            .distinct().join(known, ["a", "b"], "left_anti"),
            "pairs",
        )
        found = _verify(pairs.select("a", "b"), own, documents, similarity)
        asked.append(pairs)
        known = known.unionByName(pairs.select("a", "b"))
        n, n_pairs = found.count(), pairs.count()
        if n:
            merge = found.join(pairs, ["a", "b"]).select(F.col("ca").alias("a"), F.col("cb").alias("b"))
            links = found if links is None else links.unionByName(found)
            merges = merge if merges is None else merges.unionByName(merge)
            merged = connected_components(merge)
            before = mains, strays
            mains = materialize(_relabel(mains, "main", merged), "mains")
            strays = materialize(
                _relabel(strays, "component", merged).join(mains.select("bucket", "main"), "bucket")
                .filter("component <> main").drop("main"),
                "strays",
            )
            discard(*before)
        discard(drawn)
        if n * PAIRS_A_LINK < n_pairs or strays.isEmpty():
            break
    discard(own)
    if strays.isEmpty():
        discard(mains, strays, *asked)
        return links
    members = placed.join(strays.select("bucket").distinct(), "bucket", "left_semi").select("uid", "component").distinct()
    if merges is not None:
        members = _relabel(members, "component", connected_components(merges))
    own = materialize(members.join(texts.withColumnRenamed("__uid", "uid"), "uid"), "texts")
    rest = materialize(
        _rest_pairs(own.select("uid", "component", "__text", "__df"), documents, similarity).join(known, ["a", "b"], "left_anti"), "rest"
    )
    found = _verify(rest, own.select(F.col("uid").alias("__uid"), "__text", "__df"), documents, similarity)
    discard(own, rest, mains, strays, *asked)
    return found if links is None else links.unionByName(found)


def near_duplicate_classes(
    df: DataFrame, id_col: str, text_col: str, similarity: float = SIMILARITY, carry: bool = False
) -> tuple[DataFrame, DataFrame]:
    """The materialised rows (``__row`` if ``carry``, ``__id``, ``__uid``); and (``__id``, ``__uid``, ``__class``), the uid of a member."""
    held = whole_row(df if carry else df.select(f"`{id_col}`", f"`{text_col}`"))
    rows = materialize(df.select(held.alias("__row")).withColumn("__uid", row_uid()), "rows")
    documents = rows.count()
    given = F.col("__row").getField(text_col).alias("text")
    parts = rows.select("__uid", F.shiftright("__uid", SLICE_BITS).alias("slice"), given)
    frequencies = document_frequencies(parts)
    free_shuffles(df.sparkSession)
    signed = _signatures(parts, frequencies, documents)
    rows = rows.select("__row", F.col("__row").getField(id_col).alias("__id"), "__uid")
    discard(frequencies)
    free_shuffles(df.sparkSession)
    # sides that hold one row for each key are written before they are joined: Spark can then split a hot key
    first = materialize(signed.groupBy("__digest").agg(F.min("__uid").alias("__first")), "firsts")
    members = materialize(signed.select("__uid", "__digest").join(first, "__digest").select("__uid", "__first"), "copies")
    discard(first)
    one_each = members.filter("__uid = __first").select("__uid")
    buckets = materialize(
        signed.select("__uid", "__bands").join(one_each, "__uid")
        .select("__uid", F.posexplode("__bands").alias("band", "value"))
        .select(F.xxhash64("band", "value").alias("bucket"), F.col("__uid").alias("uid")),
        "buckets",
    )
    centres = materialize(
        buckets.groupBy("bucket").agg(F.min("uid").alias("centre"), F.count("*").alias("n")).filter("n > 1")
        .select("bucket", "centre"),
        "centres",
    )
    shared = materialize(buckets.join(centres, "bucket"), "buckets")
    discard(buckets, centres)
    pairs = materialize(
        shared.filter("uid <> centre").select(F.col("uid").alias("a"), F.col("centre").alias("b")).distinct(), "pairs"
    )
    involved = materialize(shared.select(F.col("uid").alias("__uid")).distinct(), "involved")
    texts = parts.select("__uid", F.col("text").alias("__text")).join(few(involved), "__uid")
    texts = materialize(texts.join(signed.select("__uid", "__df").join(few(involved), "__uid"), "__uid"), "texts")
    discard(involved)
    edges = _verify(pairs, texts, documents, similarity)
    labels = connected_components(edges)
    placed = materialize(
        shared.select("bucket", "uid").join(labels.withColumnRenamed("node", "uid"), "uid", "left")
        .select("bucket", "uid", F.coalesce("component", "uid").alias("component")),
        "placed",
    )
    known = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    more = _link_rest(placed, known, texts, documents, similarity)
    discard(signed, texts, placed, pairs, shared)
    free_shuffles(df.sparkSession)
    if more is not None and not more.isEmpty():
        labels = connected_components(edges.unionByName(more))
    discard(edges)
    classes = members.join(labels.withColumnRenamed("node", "__first"), "__first", "left").select(
        "__uid", F.coalesce("component", "__first").alias("__class")
    )
    return rows, rows.select("__id", "__uid").join(classes, "__uid")


def _least_of_class():
    return F.min(F.struct(F.col("__id").isNull(), F.col("__id").alias("id"), F.col("__uid").alias("uid")))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """One row per document: doc_id, class_id (the least doc_id of its class), class_size.

    Classes are the connected components of the links of similarity ``similarity`` or more. Texts with the same words
    (case and punctuation aside) are one class, texts without words, null ones among them, another. Ids that are null
    come last; a class of only such ids has a negative class_id. An empty frame gives an empty one. Texts of any
    length are compared whole. Other columns are not read.
    """
    _, rows = near_duplicate_classes(df, id_col, text_col, similarity)
    classes = materialize(
        rows.groupBy("__class").agg(F.count("*").alias("class_size"), _least_of_class().alias("least")), "classes"
    )
    return rows.join(classes, "__class").select(
        F.col("__id").alias("doc_id"),
        F.coalesce("least.id", -1 - F.col("__class")).alias("class_id"),
        "class_size",
    )


def drop_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``df`` with the least id of their class, with all their columns as they were."""
    rows, classed = near_duplicate_classes(df, id_col, text_col, similarity, carry=True)
    least = materialize(classed.groupBy("__class").agg(_least_of_class().alias("least")), "classes")
    gone = classed.join(least, "__class").filter("__uid <> least.uid").select("__uid")
    return rows.join(few(materialize(gone, "copies")), "__uid", "left_anti").select("__row.*")


def op10_weighted_minhash(spark, sf_dir):
    return near_duplicates(read_table(spark, sf_dir, "documents"))
