import zlib

import numpy as np
import pytest
from pyspark.sql import Row

from pagemill.llm.packing import best_two_fit, pack_pieces, token_pieces
from pagemill.llm.token_files import bits_for, pack, read_documents, read_ids, unpack, write_tokens
from pagemill.llm.tokens import WordEncoder, tokenizer_path

WORDS = tokenizer_path("word_bpe_49k.json")
TEXTS = [
    "One, two's THREE naïve\tÅ ΣΑΣ. 12345 <|endoftext|>q", "", None, "   ", "日本語 テスト\x85z\x1cq Łódź’s 'Re",
    "word " * 9000 + "end", "same", "same",
]


def plain(text, end):
    from tokenizers import Tokenizer

    return [*Tokenizer.from_file(WORDS).encode(text or "", add_special_tokens=False).ids, end]


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


@pytest.fixture(scope="module")
def docs(spark):
    rows = [Row(doc_id=i * 3 if i != 6 else None, text=t, part="x", length=1) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, part string, length int").repartition(3)


def test_word_encoder_equals_whole_texts():
    code = WordEncoder(WORDS)
    for t in TEXTS:
        assert np.frombuffer(code.encode(t), "<u4").tolist() == plain(t, 2)[:-1]


def test_word_encoder_equals_every_document(monkeypatch):
    """Every text of a table both ways, also with a cache that is always full."""
    import pyarrow.parquet as pq
    from tokenizers import Tokenizer

    from pagemill.llm import tokens

    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"]).column("text").to_pylist()
    whole = [e.ids for e in Tokenizer.from_file(WORDS).encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert [np.frombuffer(b, "<u4").tolist() for b in WordEncoder(WORDS).encode_all(texts)] == whole
    monkeypatch.setattr(tokens, "CACHE_BYTES", 0)
    small = WordEncoder(WORDS)
    assert [np.frombuffer(b, "<u4").tolist() for b in small.encode_all(texts[:100])] == whole[:100]


@pytest.mark.parametrize("bits", [1, 5, 16, 17, 32])
def test_pack_round_trip(bits):
    rng = np.random.default_rng(bits)
    for n in (0, 1, 63, 64, 65, 4097):
        ids = rng.integers(0, 2**bits, n)
        assert (unpack(pack(ids, bits), bits, n) == ids).all()
    assert bits_for(2**bits) == bits


def test_files_round_trip(spark, docs):
    segments, base = write_tokens(docs, WORDS, 2)
    got = {r.doc_id: r for r in read_documents(segments, base).collect()}
    order = sorted((None if i == 6 else i * 3, t) for i, t in enumerate(TEXTS) if i != 6)
    order = [(None, TEXTS[6]), *order]
    start = 0
    for doc, text in order:
        ids = plain(text, 2)
        assert (got[doc].start, got[doc].n_tokens, got[doc].ids_crc32) == (start, len(ids), crc(ids))
        start += len(ids)
    for s in segments.collect():
        for doc, at in zip(s.doc_ids, s.doc_starts, strict=True):
            want = plain(dict(order)[doc], 2)
            part = slice(len(want) // 3, len(want) // 3 + 5)
            assert read_ids(s.asDict(), at + part.start, len(want[part])).tolist() == want[part]


def test_empty_token_files(spark, docs):
    assert read_documents(*write_tokens(docs.limit(0), WORDS)).count() == 0


def test_best_two_fit_by_hand():
    # greedy takes 7 + 2 (gap 1); the 2 goes back for 1 + 2, or two that fill the gap of 3
    lengths = np.array([7, 2, 2, 1])
    bins = best_two_fit(lengths, 10)
    assert sorted(sorted(lengths[b].tolist()) for b in bins) == [[1, 2, 7], [2]]


def test_best_two_fit_places_every_piece_once():
    assert best_two_fit(np.array([8, 7]), 14) == [[0], [1]]
    rng = np.random.default_rng(11)
    for _ in range(3000):
        capacity = int(rng.integers(1, 60))
        lengths = rng.integers(1, capacity + 1, rng.integers(0, 40))
        bins = best_two_fit(lengths, capacity)
        assert sorted(i for b in bins for i in b) == list(range(len(lengths)))
        assert all(lengths[b].sum() <= capacity for b in bins)
        assert len(bins) <= 2 * lengths.sum() / capacity + 1  # no two bins would fit into one
    lengths = np.clip(rng.lognormal(6.5, 1.2, 16384).astype(int), 1, 4096)
    assert sorted(i for b in best_two_fit(lengths, 4096) for i in b) == list(range(16384))


def test_packing_ignores_clashing_columns(spark):
    rows = [(None, 0, 0, 4, 1, "x", 9), (3, 0, 0, 6, 2, "y", 9), (3, 0, 0, 6, 2, "y", 9), (4, 0, 0, 10, 3, None, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, Sequence_ID string, offset int")
    out = pack_pieces(df, 10).collect()
    assert sorted((r.length, r.offset) for r in out) == [(4, 6), (6, 0), (6, 0), (10, 0)]
    assert len({r.sequence_id for r in out}) == 3 and set(out[0].asDict()) == {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"}


def test_best_two_fit_is_tight():
    rng = np.random.default_rng(3)
    lengths = np.clip(rng.lognormal(6, 1, 4000).astype(int), 1, 4096)
    bins = best_two_fit(lengths, 4096)
    assert sorted(i for b in bins for i in b) == list(range(4000))
    assert max(lengths[b].sum() for b in bins) <= 4096
    assert len(bins) <= lengths.sum() / 4096 + 2


def test_packing_query(spark, tmp_path):
    """The registered query over a whole table: its pieces are those of plain encoding, its sequences have no gap."""
    from pagemill.llm.packing import op6_best_two_fit

    rows = [(i, t) for i, t in enumerate([*TEXTS, *(f"text {k} " * (k * 7 % 900) for k in range(120))])]
    spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = op6_best_two_fit(spark, f"file://{tmp_path}").collect()
    want = []
    for i, t in rows:
        ids = plain(t, 1)
        want += [(i, k, at, len(ids[at : at + 4096]), crc(ids[at : at + 4096])) for k, at in enumerate(range(0, len(ids), 4096))]
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    ends = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 4096 and len(ends) <= sum(ends.values()) / 4096 + 2


def test_packing_of_documents(spark, docs):
    out = pack_pieces(token_pieces(docs, WORDS, 1, 4096), 4096).collect()
    for i, t in enumerate(TEXTS):
        ids = plain(t, 1)
        own = sorted((r for r in out if r.doc_id == (None if i == 6 else i * 3)), key=lambda r: r.piece)
        assert [r.start for r in own] == list(range(0, len(ids), 4096))
        assert all(r.ids_crc32 == crc(ids[r.start : r.start + r.length]) for r in own)
        assert sum(r.length for r in own) == len(ids)
    for s in {r.sequence_id for r in out}:
        at = 0
        for r in sorted((r for r in out if r.sequence_id == s), key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096
    assert pack_pieces(token_pieces(docs.limit(0), WORDS)).count() == 0


def test_a_word_is_looked_up_once(monkeypatch):
    """A known word costs one look into the cache, not one to see whether it is new and one for its ids."""
    looked = []

    class Word(str):
        __slots__ = ()

        def __hash__(self):
            looked.append(1)
            return str.__hash__(self)

    monkeypatch.setattr(WordEncoder, "_words", staticmethod(lambda text: [Word(w) for w in text.split()]))
    code = WordEncoder(WORDS)
    text = "one two three four " * 500
    ids = code.encode(text)
    assert len(looked) <= 2000 + 3 * 4
    assert ids == code.encode("one two three four") * 500
