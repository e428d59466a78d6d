"""Token ids in fixed-width bit-packed files with block offsets.

A dataset is a folder of Parquet files whose rows are segments: some whole documents, in order, with

* ``part``, ``segment``: place of the segment; parts and segments ascend with the documents;
* ``bits``: bits of an id, the least that hold the vocabulary; ``n_ids``: ids of the segment;
* ``doc_ids``, ``doc_starts``: the documents and where each starts among the segment's ids;
* ``block_offsets``: where each block of ``BLOCK_IDS`` ids starts in ``payload`` (bytes), so any block can be unpacked
  by itself; ``payload``: the blocks, each padded to a multiple of 64 ids' bits.

A small table beside it (``base``) holds how many ids stand before each part. Parquet is the container, so the files
go through Spark's committer to any store and a segment is found by its columns' statistics.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, read_table
from .tokens import encoder, tokenizer_path

#: Ids of a block, a multiple of 64.
BLOCK_IDS = 4096
#: A segment is closed once it holds as many ids.
SEGMENT_IDS = 1 << 18

SEGMENT_SCHEMA = (
    "part int, segment int, bits int, n_ids bigint, doc_ids array<bigint>, doc_starts array<bigint>, "
    "block_offsets array<bigint>, payload binary"
)


def bits_for(vocab: int) -> int:
    """Least bits that tell ``vocab`` ids apart."""
    return max(1, (vocab - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids under 2**bits to bytes: id i takes bits [i*bits, (i+1)*bits), little-endian, padded to 64 ids."""
    lanes = np.zeros((math.ceil(len(ids) / 64), 64), dtype="<u8")
    lanes.reshape(-1)[: len(ids)] = ids
    words = np.zeros((len(lanes), bits), dtype="<u8")
    for lane in range(64):
        word, shift = divmod(lane * bits, 64)
        words[:, word] |= lanes[:, lane] << np.uint64(shift)
        if shift + bits > 64:
            words[:, word + 1] |= lanes[:, lane] >> np.uint64(64 - shift)
    return words.tobytes()


def unpack(payload: bytes, bits: int, n: int) -> np.ndarray:
    """The first ``n`` ids of packed bytes, as unsigned 32-bit integers."""
    words = np.frombuffer(payload, dtype="<u8").reshape(-1, bits)
    lanes = np.empty((len(words), 64), dtype="<u4")
    mask = np.uint64((1 << bits) - 1)
    for lane in range(64):
        word, shift = divmod(lane * bits, 64)
        value = words[:, word] >> np.uint64(shift)
        if shift + bits > 64:
            value = value | (words[:, word + 1] << np.uint64(64 - shift))
        lanes[:, lane] = value & mask
    return lanes.reshape(-1)[:n]


def read_ids(segment: dict, start: int, n: int) -> np.ndarray:
    """Random access: ids [start, start + n) of a segment; unpacks only the blocks that hold them."""
    first, last = start // BLOCK_IDS, -(-(start + n) // BLOCK_IDS)
    offsets = [*segment["block_offsets"], len(segment["payload"])]
    held = min(last * BLOCK_IDS, segment["n_ids"]) - first * BLOCK_IDS
    part = segment["payload"][offsets[first] : offsets[last]]
    return unpack(part, segment["bits"], held)[start - first * BLOCK_IDS :][:n]


def _segment(part: int, number: int, bits: int, docs: list[tuple[int | None, bytes]]) -> dict:
    ids = np.frombuffer(b"".join(b for _, b in docs), dtype="<u4")
    blocks = [pack(ids[k : k + BLOCK_IDS], bits) for k in range(0, len(ids), BLOCK_IDS)]
    sizes = np.cumsum([0, *map(len, blocks)])[:-1]
    starts = np.cumsum([0, *(len(b) // 4 for _, b in docs)])[:-1]
    return {
        "part": part, "segment": number, "bits": bits, "n_ids": len(ids), "doc_ids": [d for d, _ in docs],
        "doc_starts": starts.tolist(), "block_offsets": sizes.tolist() if blocks else [], "payload": b"".join(blocks),
    }


def _arrow_schema() -> pa.Schema:
    many = pa.list_(pa.int64())
    return pa.schema([
        ("part", pa.int32()), ("segment", pa.int32()), ("bits", pa.int32()), ("n_ids", pa.int64()),
        ("doc_ids", many), ("doc_starts", many), ("block_offsets", many), ("payload", pa.binary()),
    ])


def write_tokens(
    df: DataFrame, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text"
) -> tuple[DataFrame, DataFrame]:
    """Encode all texts, in ascending id order, into a bit-packed dataset; returns (segments, base).

    A null text is empty: it holds the end id alone. Rows with a null id come first, rows of the same id follow each
    other in any order; neither is dropped, and a hot id is spread over parts by a second sort key. Very long texts make one longer
    segment. Other columns are not read. An empty frame gives no segments.
    """

    def to_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        code, end = encoder(tokenizer), np.array([end_id], dtype="<u4").tobytes()
        part, bits, number = TaskContext.get().partitionId(), bits_for(max(code.vocab, end_id + 1)), 0
        docs: list[tuple[int | None, bytes]] = []
        held = 0
        for batch in batches:
            texts = (t.as_py() for t in batch.column(1))
            for doc, ids in zip(batch.column(0).to_pylist(), code.encode_all(texts), strict=True):
                ids += end
                docs.append((doc, ids))
                held += len(ids) // 4
                if held >= SEGMENT_IDS:
                    yield pa.RecordBatch.from_pylist([_segment(part, number, bits, docs)], _arrow_schema())
                    docs, held, number = [], 0, number + 1
        if docs:
            yield pa.RecordBatch.from_pylist([_segment(part, number, bits, docs)], _arrow_schema())

    tie = F.monotonically_increasing_id()
    ordered = (
        df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"), tie.alias("tie"))
        .repartitionByRange("doc_id", "tie")
        .sortWithinPartitions("doc_id", "tie")
        .select("doc_id", "text")
    )
    segments = materialize(ordered.mapInArrow(to_segments, SEGMENT_SCHEMA), "tokens")
    # one row a part: their number is that of the files, not of the documents
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = segments.groupBy("part").agg(F.sum("n_ids").alias("n"))
    base = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return segments, base


def read_documents(segments: DataFrame, base: DataFrame) -> DataFrame:
    """Unpack the files: (doc_id, start, n_tokens, ids_crc32) of every document."""
    own = Window.partitionBy("part").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        segments.select("part", "segment", "n_ids")
        .join(base, "part")
        .select("part", "segment", (F.col("base") + F.coalesce(F.sum("n_ids").over(own), F.lit(0))).alias("start"))
    )

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                s = batch.slice(k, 1).to_pylist()[0]
                ids = unpack(s["payload"], s["bits"], s["n_ids"]) if s["n_ids"] else np.zeros(0, "<u4")
                ends = [*s["doc_starts"][1:], s["n_ids"]]
                spans = list(zip(s["doc_starts"], ends, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([s["part"]] * len(spans), pa.int32()),
                        pa.array([s["segment"]] * len(spans), pa.int32()),
                        pa.array(s["doc_ids"], pa.int64()),
                        pa.array([a for a, _ in spans], pa.int64()),
                        pa.array([b - a for a, b in spans], pa.int64()),
                        pa.array([zlib.crc32(ids[a:b].tobytes()) for a, b in spans], pa.int64()),
                    ],
                    names=["part", "segment", "doc_id", "at", "n_tokens", "ids_crc32"],
                )

    docs = segments.mapInArrow(
        digest, "part int, segment int, doc_id bigint, at bigint, n_tokens bigint, ids_crc32 bigint"
    )
    return docs.join(starts, ["part", "segment"]).select(
        "doc_id", (F.col("start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32"
    )


def op2_bit_packed_tokens(spark, sf_dir):
    """Write every document's ids bit-packed, then read the files back."""
    documents = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return read_documents(*write_tokens(documents, tokenizer_path("word_bpe_49k.json"), end_id=2))
