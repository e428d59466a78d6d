"""Best-two-fit packing of token pieces into sequences of bounded length."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, read_table
from .tokens import encoder, tokenizer_path

#: Pieces of one packing task, about. Each task leaves at most a few sequences that are not full.
PIECES_A_TASK = 1 << 14


def best_two_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of positions into ``lengths`` (all from 1 to ``capacity``).

    A bin is filled greedily: the longest piece left, then again and again the longest that fits the gap. Then the
    bin's smallest piece is taken out if two unpacked pieces together fit the widened gap more tightly.
    """
    order = np.argsort(-lengths, kind="stable")
    of_length: dict[int, list[int]] = {}
    for i in order.tolist()[::-1]:
        of_length.setdefault(int(lengths[i]), []).append(i)
    left = np.zeros(capacity + 2, dtype=np.int64)  # pieces left of each length
    for k, v in of_length.items():
        left[k] = len(v)
    # best[g]: the greatest length at most g of which a piece is left; kept lazily, as lengths only run out
    best = np.maximum.accumulate(np.where(left > 0, np.arange(capacity + 2), 0))

    def longest(gap: int) -> int:
        path = []
        k = int(best[gap])
        while k and not left[k]:
            path.append(k)
            k = int(best[k - 1])
        best[gap] = k
        for p in path:
            best[p] = k
        return k

    def take(k: int) -> int:
        left[k] -= 1
        return of_length[k].pop()

    def two(gap: int, over: int) -> tuple[int, int] | None:
        """The pair of lengths with the greatest sum in (over, gap]."""
        found, most = None, over
        a = longest(gap - 1) if gap > 1 else 0
        while a and 2 * a > most:
            # the second may be as long as the first only if two such pieces are left
            b = longest(min(gap - a, a if left[a] > 1 else a - 1))
            if b and a + b > most:
                found, most = (a, b), a + b
                if most == gap:
                    break
            a = longest(a - 1) if a > 1 else 0
        return found

    bins = []
    while k := longest(capacity):
        content = [(take(k), k)]
        gap = capacity - k
        while gap and (k := longest(gap)):
            content.append((take(k), k))
            gap -= k
        if gap:
            item, small = content[-1]
            if pair := two(gap + small, small):
                content.pop()
                of_length[small].append(item)
                left[small] += 1
                if left[small] == 1:
                    best[small:] = np.maximum(best[small:], small)
                content += [(take(n), n) for n in pair]
        bins.append([i for i, _ in content])
    return bins


def token_pieces(
    df: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = 4096, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every piece; only documents over ``capacity`` ids are cut."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, end = encoder(tokenizer), np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            rows: list[tuple] = []
            texts = (t.as_py() for t in batch.column(1))
            for doc, ids in zip(batch.column(0).to_pylist(), code.encode_all(texts), strict=True):
                ids += end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((doc, piece, at // 4, len(part) // 4, zlib.crc32(part)))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 5
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types, strict=True)],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    texts = df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return texts.mapInArrow(cut, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")


def pack_pieces(pieces: DataFrame, capacity: int = 4096, pieces_a_task: int = PIECES_A_TASK) -> DataFrame:
    """``pieces`` with (sequence_id, offset): which sequence each goes to and where in it.

    ``length`` must be from 1 to ``capacity``. The pieces are dealt round-robin into tasks of about ``pieces_a_task``,
    whatever their keys, and each task packs its own, so no key is hot and no group is unbounded. Repeated rows are
    packed as often as they occur; null ids are ids like others; an empty frame gives an empty one. Columns called
    ``sequence_id`` or ``offset`` are replaced.
    """
    pieces = pieces.drop(*[c for c in pieces.columns if c.lower() in ("sequence_id", "offset")])
    table = materialize(pieces, "pieces")
    tasks = max(1, math.ceil(table.count() / pieces_a_task))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held = [b for b in batches if b.num_rows]
        if not held:
            return
        whole = pa.Table.from_batches(held).combine_chunks()
        lengths = whole.column("length").to_numpy()
        sequence, offset = np.full(len(lengths), -1, np.int64), np.zeros(len(lengths), np.int64)
        for number, content in enumerate(best_two_fit(lengths, capacity)):
            sequence[content] = (TaskContext.get().partitionId() << 32) + number
            offset[content] = np.cumsum(lengths[content]) - lengths[content]
        if (sequence < 0).any():
            raise RuntimeError(f"{(sequence < 0).sum()} pieces have no sequence")
        out = whole.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))
        yield from out.to_batches()

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return table.repartition(tasks).mapInArrow(assign, schema + ", sequence_id bigint, offset bigint")


def op6_best_two_fit(spark, sf_dir):
    """All documents packed into sequences of at most 4096 tokens; a null text is empty."""
    pieces = token_pieces(read_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), 1, 4096)
    return pack_pieces(pieces, 4096).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )
