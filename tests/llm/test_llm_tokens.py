import hashlib
import zlib

import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from recordloom.llm import bpe, common, records


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_vocabulary())


def _ids(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


def test_encoding_equals_the_library_on_hard_documents(spark, tokenizer):
    docs = brute.hard_documents(spark)
    shared = "Passages that many documents share, word by word, " * 100
    more = spark.createDataFrame([(20 + i, f"{'pre ' * i}{shared}{'post' * i}", "en", "a", 1) for i in range(6)], brute.SCHEMA)
    docs = docs.unionByName(more, allowMissingColumns=True)
    want = sorted(repr((r[0], _ids(tokenizer, r[1]), tokenizer.decode(_ids(tokenizer, r[1]), skip_special_tokens=False))) for r in docs.select("doc_id", "text").collect())
    found = sorted(repr((r[0], list(r[1]), r[2])) for r in bpe.encoded(docs).collect())
    assert found == want


def test_encoding_equals_the_library_on_the_table(spark, sf, tokenizer):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = {r[0]: _ids(tokenizer, r[1]) for r in docs.select("doc_id", "text").collect()}
    assert {r[0]: list(r[1]) for r in bpe.encoded(docs).collect()} == want


def test_empty_table(spark):
    none = spark.createDataFrame([], brute.SCHEMA)
    assert bpe.encoded(none).count() == 0
    folder = common.work_folder(spark, "records")
    index = records.write_records(none, folder)
    assert index.count() == 0
    assert records.read_records(spark, folder).count() == 0


def test_chunks_join_to_the_text_and_move_with_it():
    rng = np.random.default_rng(3)
    text = "".join(rng.choice(list("abc é 日\n"), size=50_000))
    parts = [c for _, c in bpe.chunks(text)]
    assert "".join(parts) == text and len(parts) > 5
    assert set(parts[2:]) & {c for _, c in bpe.chunks("something in front " + text)}


def test_joints_are_repaired_for_any_cut(tokenizer):
    codec = bpe.Codec(bpe.default_vocabulary())
    rng = np.random.default_rng(4)
    for _ in range(300):
        text = "".join(rng.choice(["a", "the", " ", "  ", "\n", "é", "'s", "12", "!", "word ", "日", "<|endoftext|>"], size=40))
        at = sorted(rng.integers(0, len(text) + 1, size=3).tolist())
        parts = [text[a:b] for a, b in zip([0, *at], [*at, len(text)], strict=True)]
        known = {i: bpe.encode_chunk(codec, p) for i, p in enumerate(parts)}
        ids = np.frombuffer(bpe.assemble(codec, parts, known), dtype="<u4").tolist()
        assert ids == _ids(tokenizer, text)


def test_crc32c_check_value_and_lengths():
    assert int(records.crc32c([b"123456789"])[0]) == 0xE3069283

    def slow(data):
        state = 0xFFFFFFFF
        for octet in data:
            state = int(records.TABLES[0][(state ^ octet) & 255]) ^ (state >> 8)
        return state ^ 0xFFFFFFFF

    data = [bytes(range(n % 256)) * 9 + b"tail" for n in (0, 1, 57, 128, 255)] + [b"\0" * 512, b"x" * 513]
    assert records.crc32c(data).tolist() == [slow(d) for d in data]


def test_damage_is_found():
    frames = records.frame([records.pack(7, np.arange(10, dtype="<u4"))])
    assert records.unpack(records.unframe(frames)[0])[0] == 7
    with pytest.raises(ValueError, match="damaged"):
        records.unframe([frames[0][:20] + b"\xff" + frames[0][21:]])


def test_records_read_back_in_order(spark, tokenizer):
    docs = brute.hard_documents(spark)
    folder = common.work_folder(spark, "records")
    index = records.write_records(docs, folder)
    rows = sorted(((r[0] if r[0] is not None else -1, r[1] or "") for r in docs.select("doc_id", "text").collect()))
    found = records.crc32_of_ids(records.read_records(spark, folder, index.orderBy(F.rand(1))))
    found = found.join(records.document_starts(index), ["file_number", "record"]).orderBy("start").collect()
    start = 0
    assert len(found) == len(rows)
    for row, (doc_id, text) in zip(found, rows, strict=True):
        ids = [*_ids(tokenizer, text), 0]
        assert (row["doc_id"] if row["doc_id"] is not None else -1) == doc_id
        assert (row["start"], row["n_tokens"]) == (start, len(ids))
        assert row["ids_crc32"] == zlib.crc32(np.array(ids, dtype="<u4").tobytes())
        start += len(ids)


def test_negative_ids_survive_packing():
    doc_id, ids = records.unpack(records.pack(-5, np.array([70_000, 1], dtype="<u4")))
    assert doc_id == -5 and ids.tolist() == [70_000, 1]


def test_query_digests(spark, sf, tokenizer):
    from recordloom.llm.queries import op5_bpe

    texts = {r[0]: r[1] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    for row in op5_bpe(spark, sf).collect():
        ids = _ids(tokenizer, texts[row["doc_id"]])
        assert row["n_tokens"] == len(ids)
        assert row["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        decoded = tokenizer.decode(ids, skip_special_tokens=False)
        assert row["decoded_sha256"] == hashlib.sha256(decoded.encode()).hexdigest()


def _column(codec, texts):
    bounds, ids = codec.encode_column(pa.array(texts, pa.string()))
    return [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def test_columns_are_encoded_as_the_library_does(tokenizer):
    rng = np.random.default_rng(5)
    signs = ["a", "the", " ", "  ", "\n", "\t", "\r\n", "é", "'s", "'", ",", ".", "(", "12", "!", "word ", "½", "²", "_", "ÿ", "þ", "日", "\u00a0", "\0", "\1", "<|endoftext|>"]
    plain = signs[:-6]
    texts = ["", " ", "\n", "it's, we'LL 'tis", "end ", " \n start", "a<|endoftext|> b", "x" * 3000, ""]
    texts += ["".join(rng.choice(plain if n % 4 else signs, size=rng.integers(0, 40))) for n in range(4_000)]
    want = [_ids(tokenizer, t) for t in texts]
    for kept in (10, 100_000):  # words are forgotten and learned again
        codec, found = bpe.ColumnCodec(bpe.default_vocabulary(), kept), []
        assert codec.cutting
        for low in range(0, len(texts), 500):
            found += _column(codec, texts[low : low + 500])
        assert found == want
    codec.cutting = False
    assert _column(codec, texts[:50]) == want[:50]
    assert _column(codec, []) == [] and _column(codec, ["", ""]) == [[], []]
    whole = pa.array(texts, pa.string())
    bounds, ids = codec.encode_column(whole[20:60])
    assert ids.tolist() == [i for w in want[20:60] for i in w] and len(bounds) == 41


def test_marks_and_line_breaks_make_no_new_words(tokenizer):
    codec = bpe.ColumnCodec(bpe.default_vocabulary())
    words = [f"w{chr(97 + i)}rd" for i in range(26)]
    texts = [f"It {word}{mark} {word}." for word in words for mark in (",", ";", "?", ".\nSo", ")")]
    assert _column(codec, texts) == [_ids(tokenizer, t) for t in texts]
    # one for each word, "It", "\nSo" and the marks, however they meet
    assert len(codec.known) <= len(words) + 10


def test_slices_hold_bounded_text():
    part = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(["a" * 4, "", "b" * 5, "c" * 30, "é" * 3, "", "d"])], ["n", "text"])
    slices = [s.column(0).to_pylist() for s in records.sized(part, 1, 10)]
    assert slices == [[0, 1, 2], [3], [4, 5, 6]]
