"""BPE encoding with reuse of content-defined chunks, and decoding.

Texts are cut by a rolling hash of their bytes, so passages that documents share give the
same chunks.  A chunk found more than once is encoded once.  Inside a chunk some positions
are word starts in any context (a space between two other characters); between the first
and the last of them a chunk's ids are those of the whole text.  What lies around a joint
of two chunks is encoded again from the last such position before it to the first after
it, where both encodings agree.
"""

from __future__ import annotations

import codecs
import contextlib
import hashlib
import os
import re
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.llm.common import attach, stable, text_batches

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Bytes of the rolling window; a cut comes on average every 2^MASK_BITS bytes, CHUNK_MIN apart at least.
WINDOW, MASK_BITS, CHUNK_MIN = 32, 11, 256
#: Chunks longer than this are cut here, so that a text without cuts stays in pieces.
CHUNK_MAX = 65_536
#: Words whose ids a task keeps.
WORDS_KEPT = 50_000
#: Bits of the table that tells texts without shared chunks from others (8 MB).
TABLE_BITS = 26
#: Texts encoded together.
GROUP = 128
#: Characters of text in a result batch.
BATCH_CHARS = 1_000_000
#: The pre-tokenizer's pattern, a fixed value of byte-level BPE.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Texts of these characters are cut into words here; on them every engine's classes agree.
PLAIN = re.compile("[\t\n\r\x20-\x7e¡-ɏͰ-ͳЀ-ҁ‐-‧€]*")
BLANK = "\t\n\r "
BLANKS = frozenset(BLANK)
#: A space that starts a word in any context.
START = re.compile(r"(?<=[!-~]) (?=[!-~])")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_marks() -> dict[int, str]:
    """How byte-level BPE writes each byte: printable ones as they are, others from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    marks = {b: chr(b) for b in shown}
    return marks | {b: chr(0x100 + n) for n, b in enumerate(b for b in range(0x100) if b not in marks)}


MARKS = byte_marks()
PIECE_MARKS = {**MARKS, 0: " "}
#: Marks of two bytes that UTF-8 doesn't have: between pieces, and between words.
PIECE_END, WORD_END = MARKS[0xFF], MARKS[0xFE]
#: Marks by byte; texts of PLAIN have no bytes 0 and 1, which stand for the two ends.
BYTE_MARKS = PIECE_END + WORD_END + "".join(MARKS[b] for b in range(2, 256))
#: Words that the library encodes as one, and words in one call of it.
LEARNED_TOGETHER, LEARNED_PER_CALL = 32, 8_192
#: Kinds of bytes where a column is cut into words.
OTHER, GAP, LETTER, POINT = range(4)


def _byte_kinds() -> np.ndarray:
    kinds = np.full(256, OTHER, dtype=np.uint8)
    for b in range(0x21, 0x7F):
        char = chr(b)
        if char.isalpha():
            kinds[b] = LETTER
        elif not char.isdigit() and char != "'":
            kinds[b] = POINT
    kinds[[ord(b) for b in BLANK]] = GAP
    return kinds


BYTE_KINDS = _byte_kinds()


def _plain_pieces() -> re.Pattern:
    """PIECES for texts of PLAIN, with their letters and numbers written out."""
    plain = [c for c in map(chr, range(0x2100)) if PLAIN.fullmatch(c)]
    letters, numbers = (re.escape("".join(c for c in plain if unicodedata.category(c)[0] == k)) for k in "LN")
    return re.compile(
        rf"'(?:s|t|re|ve|m|ll|d)| ?(?:[{letters}]+|[{numbers}]+|[^\s{letters}{numbers}]+)|\s+(?!\S)|\s+"
    )


PLAIN_PIECES = _plain_pieces()


class Codec:
    """A tokenizer file with a bounded memory of words, for use inside tasks."""

    def __init__(self, vocabulary: str, words_kept: int = WORDS_KEPT) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        # the same model on pieces that are cut already, in byte marks with spaces between them
        self.pieces = Tokenizer(self.tokenizer.model)
        self.pieces.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        octets = {mark: bytes([b]) for b, mark in MARKS.items()}
        vocab = self.tokenizer.get_vocab()
        self.begins = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.octets: dict[int, bytes] = {}
        for token, number in vocab.items():
            self.begins[number] = token.startswith(MARKS[0x20])
            self.octets[number] = token.encode() if token in self.special else b"".join(map(octets.__getitem__, token))
        self.split = regex.compile(PIECES).findall
        self.words_kept = words_kept
        self.known: dict[str, bytes | None] = {}
        self.before: dict[str, bytes | None] = {}

    def _direct(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return np.array(ids, dtype="<u4").tobytes()

    def _first(self, word: str) -> bytes:
        """Ids of a word at the start of a text, without a space before it."""
        got = self.tokenizer.encode_batch_fast([word], add_special_tokens=False)[0].ids
        return np.array(got, dtype="<u4").tobytes()

    def _learn(self, words: list[str]) -> None:
        """Encode new words together; each starts with the only space in it."""
        known, new = self.known, []
        for word in words:
            if not word or word[0] in BLANK or word[-1] in BLANK:
                known[word] = None  # its space is no sure start of a word
            else:
                new.append(word)
        if not new:
            return
        # no text that gets here has a zero character, so it can stand between the pieces
        pieces = "\0".join(self.split(" " + " ".join(new))).encode().decode("latin-1").translate(PIECE_MARKS)
        got = self.pieces.encode_batch_fast([pieces], add_special_tokens=False)[0].ids
        numbers = np.array(got, dtype="<u4")
        starts = np.flatnonzero(self.begins[numbers])
        if len(starts) != len(new):
            raise ValueError("the vocabulary isn't byte-level: a space is not the start of one token")
        ids, lows = numbers.tobytes(), (starts * 4).tolist()
        for word, low, high in zip(new, lows, [*lows[1:], len(ids)], strict=True):
            known[word] = ids[low:high]

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts as little-endian 32-bit numbers.

        The library's own ids.  A space between two other characters starts a word in
        any context, so a text is cut at its spaces: words seen before are looked up,
        and the library encodes the new ones.  A text with other runs of white space, a
        special token or a character outside PLAIN goes to it whole.
        """
        known = self.known
        cut = [
            t.split(" ") if PLAIN.fullmatch(t) and not any(s in t for s in self.special) else None for t in texts
        ]
        new: set[str] = set()
        for words in cut:
            if words is not None:
                new.update(words[1:])
        if len(known) > self.words_kept:  # words that come again are carried over
            self.before, self.known = known, {}
            known = self.known
        before, unseen = self.before, []
        for word in new.difference(known):
            if word in before:
                known[word] = before[word]
            else:
                unseen.append(word)
        self._learn(unseen)
        out = []
        for text, words in zip(texts, cut, strict=True):
            ids = None
            if words is not None and words[0][-1:] not in BLANKS:
                first = words.pop(0)
                with contextlib.suppress(TypeError):  # a word that is None
                    ids = b"".join(map(known.__getitem__, words))
                    ids = self._first(first) + ids if first else ids
            out.append(self._direct(text) if ids is None else ids)
        return out

    def encode(self, text: str) -> bytes:
        return self.encode_many([text])[0]

    def decode(self, ids: bytes) -> str:
        """The library's text of the ids, special tokens written out."""
        numbers = np.frombuffer(ids, dtype="<u4").tolist()
        try:
            return b"".join(map(self.octets.__getitem__, numbers)).decode()
        except (UnicodeDecodeError, KeyError):
            return self.tokenizer.decode(numbers, skip_special_tokens=False)


class ColumnCodec(Codec):
    """A codec for Arrow columns of whole texts; its words are bytes, with what precedes them.

    A text is cut before every blank that stands alone between two other characters, and
    between a letter and a mark after it (apostrophes aside): in any context a piece of
    the pre-tokenizer starts there.  So a word's ids are those of the word as a text of
    its own.  Arrow numbers the different words of a column; words not seen before go to
    the library, many to a call, with marks between them that no merge crosses.
    """

    def __init__(self, vocabulary: str, words_kept: int = WORDS_KEPT) -> None:
        from tokenizers import Tokenizer, models, pre_tokenizers

        super().__init__(vocabulary, words_kept)
        self.known: dict[bytes, bytes] = {}  # no ids: a word that isn't plain
        self.before: dict[bytes, bytes] = {}
        self.joined = Tokenizer(self.tokenizer.model)
        model, split, vocab = self.tokenizer.model, self.tokenizer.pre_tokenizer, self.tokenizer.get_vocab()
        #: Whether texts may be cut; with another kind of vocabulary the library gets them whole.
        self.cutting = (
            isinstance(model, models.BPE)
            and not (model.dropout or model.ignore_merges or model.continuing_subword_prefix or model.end_of_word_suffix)
            and isinstance(split, pre_tokenizers.ByteLevel)
            and split.use_regex
            and not split.add_prefix_space
            and self.tokenizer.normalizer is None
            and vocab.keys() >= set(MARKS.values())
            and not any(len(token) > 1 and (PIECE_END in token or WORD_END in token) for token in vocab if token not in self.special)
        )
        self.piece_end, self.word_end = vocab.get(PIECE_END), vocab.get(WORD_END)

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")

    def _learn_words(self, words: list[bytes]) -> None:
        texts = [w.decode() for w in words]
        plain = [t for t in texts if PLAIN.fullmatch(t)]
        if len(plain) < len(texts):
            self.known.update((w, b"") for w, t in zip(words, texts, strict=True) if not PLAIN.fullmatch(t))
            words = [t.encode() for t in plain]
        if not words:
            return
        cut = ["\0".join(PLAIN_PIECES.findall(t)) for t in plain]
        groups = ["\1".join(cut[i : i + LEARNED_TOGETHER]) + "\1" for i in range(0, len(cut), LEARNED_TOGETHER)]
        marks = [codecs.charmap_decode(g.encode(), "strict", BYTE_MARKS)[0] for g in groups]
        got = self.joined.encode_batch_fast(marks, add_special_tokens=False)
        numbers = np.array(list(chain.from_iterable(g.ids for g in got)), dtype="<u4")
        numbers = numbers[numbers != self.piece_end]
        ends = np.flatnonzero(numbers == self.word_end) * 4
        ids = numbers.tobytes()
        for word, low, high in zip(words, [0, *(ends[:-1] + 4).tolist()], ends.tolist(), strict=True):
            self.known[word] = ids[low:high]

    def _codes(self, words: list[bytes]) -> list[bytes]:
        if len(self.known) > self.words_kept:  # words that come again are carried over
            self.before, self.known = self.known, {}
        known, before, unseen = self.known, self.before, []
        for word, code in zip(words, map(known.get, words), strict=True):
            if code is None:
                code = before.get(word)
                if code is None:
                    unseen.append(word)
                else:
                    known[word] = code
        for low in range(0, len(unseen), LEARNED_PER_CALL):
            self._learn_words(unseen[low : low + LEARNED_PER_CALL])
        return list(map(known.__getitem__, words))

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids): the library's ids of the texts (no nulls), one text after the other."""
        n = len(texts)
        if not self.cutting:
            return self._spliced([self._whole(t) for t in texts.to_pylist()])
        special = np.zeros(n, dtype=bool)
        for token in self.special:
            special |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        binary = texts.cast(pa.large_binary())
        _, places, data = binary.buffers()
        offsets = np.frombuffer(places, dtype="<i8", count=binary.offset + n + 1)[binary.offset :] if n else np.zeros(1, dtype="<i8")
        low, high = int(offsets[0]), int(offsets[-1])
        if low == high:
            return np.zeros(n + 1, dtype="<i8"), np.zeros(0, dtype="<u4")
        kinds = BYTE_KINDS[np.frombuffer(data, dtype=np.uint8)[low:high]]
        gaps = kinds == GAP
        cut = np.zeros(high - low, dtype=bool)
        cut[1:-1] = gaps[1:-1] & ~gaps[:-2] & ~gaps[2:]
        cut[1:] |= (kinds[1:] == POINT) & (kinds[:-1] == LETTER)
        cut[offsets[:-1][offsets[:-1] < offsets[1:]] - low] = True
        starts = np.flatnonzero(cut) + low
        bounds = pa.py_buffer(np.append(starts, high).astype("<i8"))
        words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, bounds, data]).dictionary_encode()
        codes = self._codes(words.dictionary.to_numpy(zero_copy_only=False).tolist())
        sizes = np.fromiter(map(len, codes), dtype=np.int64, count=len(codes)) // 4
        numbers = words.indices.to_numpy()
        lengths = sizes[numbers]
        ends = np.cumsum(lengths)
        at = np.repeat((np.cumsum(sizes) - sizes)[numbers] - ends + lengths, lengths)
        at += np.arange(len(at))
        ids = np.frombuffer(b"".join(codes), dtype="<u4")[at]
        first = np.searchsorted(starts, offsets)  # each text's first word
        bad = np.concatenate([[0], np.cumsum(lengths == 0)])[first]
        bounds = np.concatenate([[0], ends])[first]
        whole = special | (np.diff(bad) > 0)
        if not whole.any():
            return bounds, ids
        parts = zip(whole.tolist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)
        return self._spliced([self._whole(texts[i].as_py()) if w else ids[a:b] for i, (w, a, b) in enumerate(parts)])

    @staticmethod
    def _spliced(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype("<i8")
        return offsets, np.concatenate([np.zeros(0, dtype="<u4"), *parts])


_CODECS: dict[tuple[str, int, type], Codec] = {}


def codec_for(vocabulary: str, words_kept: int = WORDS_KEPT, kind: type[Codec] = Codec) -> Codec:
    """The worker's codec; its words stay for the next task."""
    key = (vocabulary, words_kept, kind)
    if key not in _CODECS:
        _CODECS[key] = kind(vocabulary, words_kept)
    return _CODECS[key]


def _gear() -> np.ndarray:
    return np.random.default_rng(2_024).integers(0, 2**32, size=256, dtype=np.uint32)


GEAR = _gear()


def cuts(data: bytes) -> list[int]:
    """Ends of the chunks of UTF-8 bytes, always between two characters."""
    size = len(data)
    if size <= CHUNK_MIN:
        return [size] if size else []
    octets = np.frombuffer(data, dtype=np.uint8)
    found = []
    step = 1 << 20
    for start in range(0, size, step):  # a long text is hashed in slabs that overlap by a window
        low = max(0, start - WINDOW)
        rolling, span = GEAR[octets[low : start + step]], 1
        while span < WINDOW:
            rolling[span:] += rolling[:-span] << np.uint32(span)
            span *= 2
        ends = np.flatnonzero(rolling >> np.uint32(32 - MASK_BITS) == 0) + low + 1
        found.append(ends[ends > start])
    ends, last = [], 0
    for end in chain(np.concatenate(found).tolist(), [size]):
        while end - last > CHUNK_MAX:
            last = _between(data, last + CHUNK_MAX)
            ends.append(last)
        end = _between(data, end)
        if end - last >= CHUNK_MIN or end == size > last:
            ends.append(end)
            last = end
    return ends


def _between(data: bytes, at: int) -> int:
    while at < len(data) and data[at] & 0xC0 == 0x80:
        at += 1
    return at


def chunks(text: str) -> list[tuple[bytes, str]]:
    """(digest, chunk) of a text's chunks in order."""
    data = text.encode("utf-8", "surrogatepass")
    out, last = [], 0
    for end in cuts(data):
        part = data[last:end]
        out.append((hashlib.blake2b(part, digest_size=16).digest(), part.decode("utf-8", "surrogatepass")))
        last = end
    return out


def encode_chunk(codec: Codec, chunk: str) -> tuple[int, int, bytes]:
    """(start, end, ids between): the part whose ids don't depend on the chunk's neighbours.

    Equal start and end mean that there is none.
    """
    first = START.search(chunk)
    if first is None:
        return 0, 0, b""
    last = first.start()
    at = len(chunk)
    while at > last:
        at = chunk.rfind(" ", 0, at)
        if at <= last:
            break
        if START.match(chunk, at):
            last = at
            break
    return first.start(), last, codec.encode(chunk[first.start() : last])


def assemble(codec: Codec, parts: list[str], known: dict[int, tuple[int, int, bytes]]) -> bytes:
    """Ids of the text made of ``parts``; ``known`` has the encodings of some by position."""
    out, open_text = [], []
    for i, part in enumerate(parts):
        start, end, ids = known.get(i, (0, 0, b""))
        if start == end:
            open_text.append(part)
            continue
        open_text.append(part[:start])
        out.append(codec.encode("".join(open_text)))
        out.append(ids)
        open_text = [part[end:]]
    out.append(codec.encode("".join(open_text)))
    return b"".join(out)


def _ids_array(encoded: list[bytes]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(e) // 4 for e in encoded])]).astype("i4")
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(encoded), dtype="<i4")))


class _Results:
    """Batches of results, cut by the characters they hold."""

    def __init__(self, names: list[str]) -> None:
        self.names, self.rows, self.chars = names, [], 0

    def add(self, key: object, ids: bytes, text: str) -> None:
        self.rows.append((key, ids, text))
        self.chars += len(text)

    def full(self) -> bool:
        return self.chars >= BATCH_CHARS

    def take(self, kind: pa.DataType) -> pa.RecordBatch:
        keys, ids, texts = zip(*self.rows, strict=True)
        self.rows, self.chars = [], 0
        return pa.RecordBatch.from_arrays(
            [pa.array(keys, type=kind), _ids_array(list(ids)), pa.array(texts, type=pa.string())], self.names
        )


def encoded(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", vocabulary: str | None = None
) -> DataFrame:
    """For every row: id, ``ids`` (array of int) and ``decoded``, the text made from them.

    The ids are exactly the library's for the whole text without added special tokens; a
    null text counts as empty and has no ids.  A text that occurs once and shares no chunk
    with another is encoded where it lies.  Of the others, each chunk that different
    texts share is encoded in one place, its ids are joined to the texts that hold it,
    and joints are repaired; equal texts are encoded once and their rows meet the ids by
    :func:`attach`.  Repeated rows and null ids give a row each; extra columns are not
    read.
    """
    spark = docs.sparkSession
    vocabulary = vocabulary or default_vocabulary()
    texts = text_batches(docs).select(
        F.col(id_column).cast("long").alias("id"), F.coalesce(F.col(text_column), F.lit("")).alias("text")
    ).select("id", "text", F.unhex(F.sha2("text", 256)).alias("key"))

    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            rows = []
            for key, text in zip(part.column(0), part.column(1), strict=True):
                key = key.as_py()
                rows += [(key, n, digest) for n, (digest, _) in enumerate(chunks(text.as_py()))]
            keys, numbers, digests = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.binary()), pa.array(numbers, pa.int32()), pa.array(digests, pa.binary())],
                ["key", "n", "chunk"],
            )

    refs = texts.select("key", "text").mapInArrow(cut, "key binary, n int, chunk binary")
    refs = stable(refs.groupBy("key", "n", "chunk").agg(F.count(F.lit(1)).alias("copies")))
    uses = refs.groupBy("chunk").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("key", "n")).alias("owner"))
    uses = stable(uses.filter("n > 1"))
    counts = uses.select("chunk", "n")
    total = uses.agg(F.sum("n")).first()[0] or 0
    shared = attach(refs.drop("copies"), uses.select("chunk", "owner"), "chunk", counts, total)
    shared = stable(shared.select("key", "n", "chunk", (F.col("owner") == F.struct("key", "n")).alias("owned")))

    slot = F.pmod(F.xxhash64("key"), F.lit(1 << TABLE_BITS))
    # what can't be settled in place: texts with a shared chunk, and equal texts
    linked = shared.select("key").unionByName(refs.filter("copies > 1").select("key"))
    filled = (
        linked.select(slot.alias("slot"))
        .groupBy((F.col("slot") / 64).cast("int").alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(slot % 64 as int))")).alias("bits"))
        .toArrow()
    )  # at most 2^TABLE_BITS / 64 rows
    words = np.zeros(1 << (TABLE_BITS - 6), dtype=np.int64)
    words[filled["word"].to_numpy()] = filled["bits"].to_numpy()
    table = spark.sparkContext.broadcast(words)

    def holds(part: pa.RecordBatch, column: int) -> np.ndarray:
        at = part.column(column).to_numpy(zero_copy_only=False)
        return (table.value[at // 64] >> (at % 64)) & 1 == 1

    def alone(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, results = codec_for(vocabulary), _Results(["id", "ids", "decoded"])
        for part in parts:
            rows = np.flatnonzero(~holds(part, 2))
            for low in range(0, len(rows), GROUP):
                some = part.take(pa.array(rows[low : low + GROUP]))
                for key, ids in zip(some.column(0).to_pylist(), codec.encode_many(some.column(1).to_pylist()), strict=True):
                    results.add(key, ids, codec.decode(ids))
                    if results.full():
                        yield results.take(pa.int64())
        if results.rows:
            yield results.take(pa.int64())

    def sharing(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            yield part.filter(pa.array(holds(part, 2))).select(["key", "text"])

    def owning(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            yield part.filter(pa.array(holds(part, 2))).select(["id", "key"])

    marked = texts.withColumn("slot", slot)
    single = marked.select("id", "text", "slot").mapInArrow(alone, "id long, ids array<int>, decoded string")
    some = (
        marked.select("key", "text", "slot")
        .mapInArrow(sharing, "key binary, text string")
        .groupBy("key")
        .agg(F.first("text").alias("text"))
    )
    owned = shared.filter("owned").groupBy("key").agg(F.collect_list("n").alias("own"))

    def encode_owned(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_for(vocabulary)
        for part in parts:
            rows = []
            for text, own in zip(part.column(0), part.column(1), strict=True):
                found = chunks(text.as_py())
                rows += [(found[n][0], *encode_chunk(codec, found[n][1])) for n in own.as_py()]
            digests, starts, ends, ids = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(digests, pa.binary()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), pa.array(ids, pa.binary())],
                ["chunk", "start", "end", "part_ids"],
            )

    once = some.join(owned, "key").select("text", "own").mapInArrow(
        encode_owned, "chunk binary, start int, end int, part_ids binary"
    )
    held = attach(shared.select("key", "n", "chunk"), once, "chunk", counts, total)
    held = held.groupBy("key").agg(F.collect_list(F.struct("n", "start", "end", "part_ids")).alias("held"))

    def join(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_for(vocabulary)
        for part in parts:
            for low in range(0, part.num_rows, GROUP):
                some = part.slice(low, GROUP)
                keys, encodings = [], []
                for key, text, held in zip(*(some.column(i) for i in range(3)), strict=True):
                    known = {h["n"]: (h["start"], h["end"], h["part_ids"]) for h in held.as_py() or []}
                    keys.append(key.as_py())
                    encodings.append(assemble(codec, [c for _, c in chunks(text.as_py())], known))
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), _ids_array(encodings)], ["key", "ids"])

    def decode(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, results = codec_for(vocabulary), _Results(["id", "ids", "decoded"])
        for part in parts:
            values, offsets = part.column(1).values.to_numpy().astype("<u4"), part.column(1).offsets.to_numpy()
            for key, low, high in zip(part.column(0).to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                ids = values[low:high].tobytes()
                results.add(key, ids, codec.decode(ids))
                if results.full():
                    yield results.take(pa.int64())
        if results.rows:
            yield results.take(pa.int64())

    joined = some.join(held, "key", "left").select("key", "text", "held")
    joined = joined.mapInArrow(join, "key binary, ids array<int>")
    owners = stable(marked.select("id", "key", "slot").mapInArrow(owning, "id long, key binary"))
    number = stable(owners.groupBy("key").agg(F.count(F.lit(1)).alias("n")))
    copies = attach(owners, joined, "key", number, owners.count()).select("id", "ids")
    copies = copies.mapInArrow(decode, "id long, ids array<int>, decoded string")
    return single.unionByName(copies).withColumnRenamed("id", id_column)
