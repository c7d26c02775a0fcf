"""Token sequences in length-delimited binary records with an offset index.

A record is a frame as TFRecord readers know it: the payload's length (unsigned 64 bits),
the masked CRC-32C of that length, the payload and the payload's masked CRC-32C, all
little-endian.  A payload starts with one byte of flags and the document id (signed 64
bits); the ids follow in 2 or 4 bytes each.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from recordloom.llm.bpe import ColumnCodec, codec_for, default_vocabulary
from recordloom.llm.common import file_system, stable, text_batches

HEAD = struct.Struct("<BQ")
NO_ID, WIDE = 1, 2
#: Fixed values of the format: the Castagnoli polynomial (reflected) and the mask's constant.
POLYNOMIAL, MASK_DELTA = 0x82F63B78, 0xA282EAD8
BLOCK = 512
#: Words whose ids a writing task keeps: it holds little else.
RECORD_WORDS = 150_000
#: Bytes of text encoded together.
ENCODED_TOGETHER = 1_000_000
#: Payload bytes framed at a time, and documents in a batch of the index.
FRAME_BYTES, INDEX_ROWS = 4_000_000, 4096
INDEX = "file string, file_number int, record long, doc_id long, offset long, length long, start_in_file long, n_tokens long"


def _tables() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(POLYNOMIAL), table >> 1)
    out = [table]
    for _ in range(7):
        out.append((out[-1] >> 8) ^ table[out[-1] & 0xFF])
    return np.stack(out)


TABLES = _tables()


def _advance(state: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The register after 8 more bytes (as a little-endian word) for each lane."""
    word = words ^ state
    out = np.zeros(len(words), dtype=np.uint32)
    for k in range(8):
        out ^= TABLES[7 - k][(word >> np.uint64(8 * k)) & np.uint64(0xFF)]
    return out


def _block_shift() -> np.ndarray:
    """What BLOCK zero bytes do to each of the register's four bytes."""
    state = (np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]).ravel()
    zero = np.zeros(len(state), dtype=np.uint64)
    for _ in range(BLOCK // 8):
        state = _advance(state, zero)
    return state.reshape(4, 256)


SHIFT = _block_shift()


def crc32c(payloads: list[bytes]) -> np.ndarray:
    """CRC-32C of many byte strings of 4 bytes or more, all blocks side by side.

    Zeros in front leave a register of zero as it is, so each string is filled up to
    whole blocks in front; the usual start value is the same as inverting its first four
    bytes.  Blocks are folded by what a block of zeros does to the register.
    """
    sizes = np.array([len(p) for p in payloads], dtype=np.int64)
    held = -(-sizes // BLOCK)
    ends = np.cumsum(held)
    data = np.zeros(int(ends[-1]) * BLOCK if len(ends) else 0, dtype=np.uint8)
    for payload, size, end in zip(payloads, sizes.tolist(), ends.tolist(), strict=True):
        at = end * BLOCK - size
        data[at : end * BLOCK] = np.frombuffer(payload, dtype=np.uint8)
        data[at : at + 4] ^= 0xFF
    lanes = np.ascontiguousarray(data.view("<u8").reshape(-1, BLOCK // 8).T)
    state = np.zeros(lanes.shape[1], dtype=np.uint32)
    for words in lanes:
        state = _advance(state, words)
    out = np.zeros(len(payloads), dtype=np.uint32)
    order = np.argsort(-held, kind="stable")
    first, counts = (ends - held)[order], held[order]
    for j in range(int(counts[0]) if len(counts) else 0):
        live = int(np.searchsorted(-counts, -j, side="left"))
        at = order[:live]
        old = out[at]
        moved = SHIFT[0][old & 0xFF] ^ SHIFT[1][old >> 8 & 0xFF] ^ SHIFT[2][old >> 16 & 0xFF] ^ SHIFT[3][old >> 24]
        out[at] = moved ^ state[first[:live] + j]
    return out ^ np.uint32(0xFFFFFFFF)


def masked(crc: np.ndarray) -> np.ndarray:
    return (crc >> np.uint32(15) | crc << np.uint32(17)) + np.uint32(MASK_DELTA)


def frame(payloads: list[bytes]) -> list[bytes]:
    lengths = [struct.pack("<Q", len(p)) for p in payloads]
    sums = masked(crc32c(lengths + payloads)).astype("<u4")
    n = len(payloads)
    return [b"".join((a, sums[i].tobytes(), p, sums[n + i].tobytes())) for i, (a, p) in enumerate(zip(lengths, payloads, strict=True))]


def unframe(frames: list[bytes]) -> list[bytes]:
    """Payloads of whole frames; a wrong length or checksum is an error."""
    lengths, payloads = [f[:8] for f in frames], [f[12:-4] for f in frames]
    sums = masked(crc32c(lengths + payloads)).astype("<u4")
    n = len(frames)
    for i, f in enumerate(frames):
        if struct.unpack("<Q", lengths[i])[0] != len(payloads[i]) or f[8:12] != sums[i].tobytes() or f[-4:] != sums[n + i].tobytes():
            raise ValueError(f"damaged record {i} of a batch")
    return payloads


def pack(doc_id: int | None, ids: np.ndarray) -> bytes:
    wide = bool(len(ids)) and int(ids.max()) > 0xFFFF
    head = HEAD.pack((NO_ID if doc_id is None else 0) | (WIDE if wide else 0), (doc_id or 0) & 0xFFFFFFFFFFFFFFFF)
    return head + ids.astype("<u4" if wide else "<u2").tobytes()


def unpack(payload: bytes) -> tuple[int | None, np.ndarray]:
    flags, number = HEAD.unpack_from(payload)
    ids = np.frombuffer(payload, dtype="<u4" if flags & WIDE else "<u2", offset=HEAD.size)
    return None if flags & NO_ID else number - (number >> 63 << 64), ids.astype("<u4")


def sized(part: pa.RecordBatch, column: int, most: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch, each with ``most`` bytes in a column of text or with one row."""
    ends = np.cumsum(pc.binary_length(part.column(column)).to_numpy(zero_copy_only=False), dtype=np.int64)
    low = 0
    while low < part.num_rows:
        before = int(ends[low - 1]) if low else 0
        high = max(low + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield part.slice(low, high - low)
        low = high


def write_records(
    docs: DataFrame,
    folder: str,
    id_column: str = "doc_id",
    text_column: str = "text",
    vocabulary: str | None = None,
    end_id: int = 0,
) -> DataFrame:
    """Write every text's ids and ``end_id`` in ascending id order; returns the index.

    Rows are dealt to ranges of ids, so files follow one another in order.  A task
    writes one file under a name of its own and puts it in place when it is whole; the
    index, written by Spark below ``folder``, names the files of the tasks that
    counted, so a file of a lost or repeated task is never read.  Null texts are empty
    (their record holds ``end_id`` alone), null ids come first, rows with equal ids are
    ordered by their text; no rows give an empty index; other columns are not read.
    """
    vocabulary = vocabulary or default_vocabulary()
    rows = text_batches(docs).select(
        F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text")
    )
    ordered = rows.repartitionByRange(F.col("doc_id")).sortWithinPartitions("doc_id", "text")

    def write(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId()
        system, base = file_system(folder)
        system.create_dir(base, recursive=True)
        path = f"{base}/records-{number:06d}-{uuid.uuid4().hex}.tfrecord"
        codec, end = codec_for(vocabulary, RECORD_WORDS, ColumnCodec), np.array([end_id], dtype="<u4")
        offset = start = count = 0
        payloads: list[bytes] = []
        entries: list[tuple] = []
        out = None

        def flush() -> None:
            if payloads:
                out.write(b"".join(frame(payloads)))
                payloads.clear()

        def index() -> pa.RecordBatch:
            columns = list(zip(*entries, strict=True))
            entries.clear()
            kinds = [pa.string(), pa.int32(), *[pa.int64()] * 6]
            names = [c.split()[0] for c in INDEX.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

        held = 0
        for part in parts:
            for some in sized(part, 1, ENCODED_TOGETHER):
                out = out or system.open_output_stream(path + ".part")
                bounds, numbers = codec.encode_column(some.column(1))
                bounds = bounds.tolist()
                for doc_id, low, high in zip(some.column(0).to_pylist(), bounds[:-1], bounds[1:], strict=True):
                    ids = np.append(numbers[low:high], end)
                    payload = pack(doc_id, ids)
                    size = len(payload) + 16
                    entries.append((path.rpartition("/")[2], number, count, doc_id, offset, size, start, len(ids)))
                    payloads.append(payload)
                    offset, start, count, held = offset + size, start + len(ids), count + 1, held + size
                    if held >= FRAME_BYTES:
                        flush()
                        held = 0
                if len(entries) >= INDEX_ROWS:
                    yield index()
        if out is None:
            return
        flush()
        out.close()
        system.move(path + ".part", path)
        if entries:
            yield index()

    index = ordered.mapInArrow(write, INDEX)
    index.write.parquet(f"{folder}/index")
    return docs.sparkSession.read.parquet(f"{folder}/index")


def read_records(spark: SparkSession, folder: str, index: DataFrame | None = None) -> DataFrame:
    """(file_number, record, doc_id, ids) of the records an index names, in any order.

    Each row is one ranged read at its offset, so an index that was filtered or
    shuffled serves as well; frames are checked.
    """
    index = index if index is not None else spark.read.parquet(f"{folder}/index")

    def fetch(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = file_system(folder)
        name, source = None, None

        def batch(places: list[tuple], frames: list[bytes]) -> pa.RecordBatch:
            found = [unpack(p) for p in unframe(frames)]
            files, numbers = zip(*places, strict=True)
            offsets = np.concatenate([[0], np.cumsum([len(i) for _, i in found])]).astype("i4")
            ids = np.concatenate([i for _, i in found]).astype("<i4")
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(files, pa.int32()),
                    pa.array(numbers, pa.int64()),
                    pa.array([d for d, _ in found], pa.int64()),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids)),
                ],
                ["file_number", "record", "doc_id", "ids"],
            )

        for part in parts:
            places, frames, size = [], [], 0
            for row in part.to_pylist():
                if row["file"] != name:
                    name = row["file"]
                    source = system.open_input_file(f"{base}/{name}")
                frames.append(source.read_at(row["length"], row["offset"]))
                places.append((row["file_number"], row["record"]))
                size += row["length"]
                if size >= FRAME_BYTES:
                    yield batch(places, frames)
                    places, frames, size = [], [], 0
            if frames:
                yield batch(places, frames)

    rows = index.select("file", "file_number", "record", "offset", "length")
    return rows.mapInArrow(fetch, "file_number int, record long, doc_id long, ids array<int>")


def document_starts(index: DataFrame) -> DataFrame:
    """(file_number, record, start): the ids of all documents before each one."""
    files = index.groupBy("file_number").agg(F.sum("n_tokens").alias("tokens"))
    before = Window.orderBy("file_number").rowsBetween(Window.unboundedPreceding, -1)
    bases = files.select("file_number", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("base"))
    return index.join(stable(bases), "file_number").select(
        "file_number", "record", (F.col("base") + F.col("start_in_file")).alias("start")
    )


def crc32_of_ids(records: DataFrame) -> DataFrame:
    """Adds ``n_tokens`` and ``ids_crc32`` to read records, from the ids in them."""

    def apply(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            ids, offsets = part.column(3).values.to_numpy(zero_copy_only=False).astype("<u4"), part.column(3).offsets.to_numpy()
            sums = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), part.column(2), pa.array(np.diff(offsets).astype("i8")), pa.array(sums, pa.int64())],
                ["file_number", "record", "doc_id", "n_tokens", "ids_crc32"],
            )

    return records.mapInArrow(apply, "file_number int, record long, doc_id long, n_tokens long, ids_crc32 long")
