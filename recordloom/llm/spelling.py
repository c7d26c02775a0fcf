"""Spelling variants by permuterm rotations: near words, the form of each word, its root."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordloom.llm.common import stable

#: A letter, and the letters whose case is folded.
LETTER = r"A-Za-zÀ-ÿ"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Code points of a text that are taken apart at once (and the rest of the last run).
PIECE = 1 << 16
#: One run in so many loses a code point.
DAMAGE = 199
#: A word has at least so many code points and occurrences; a form has FORM times as many.
LENGTH, OCCURRENCES, FORM = 6, 5, 5
#: Ends a word; no letter, and before all of them in code-point order.
END = "$"
#: Longer words stand in the order at checksums of their rotations, of four lanes each.
SPELLED = 64
PRIME, BASES = 2**31 - 1, (911_382_323, 972_663_749, 1_284_865_837, 1_678_543_219)
#: Starts of one batch.
STARTS = 1 << 16
PLACED = "start string, edited string, single boolean, rank long, n long"


def occurrences(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(word) for every run of letters in every text, damaged where its checksum says so.

    A text is cut into pieces that end where a run does, so that a long one is never a
    single list of runs.  A null id is written as the empty string.
    """
    pieces = docs.select(
        F.coalesce(F.col(id_column).cast("string"), F.lit("")).alias("id"),
        F.explode(F.regexp_extract_all(text_column, F.lit(f"(?s).{{1,{PIECE}}}[{LETTER}]*"), F.lit(0))).alias("piece"),
    )
    runs = pieces.select("id", F.explode(F.regexp_extract_all("piece", F.lit(f"[{LETTER}]+"), F.lit(0))).alias("run"))
    runs = runs.select("id", F.translate("run", UPPER, LOWER).alias("run"))
    hashed = runs.select("run", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")).alias("h"))
    at = F.pmod("h", F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    return hashed.select(F.when(F.col("h") % DAMAGE == 0, cut).otherwise(F.col("run")).alias("word"))


def vocabulary(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(word, n): the words that are long and frequent enough; counted where they lie first."""
    words = occurrences(docs, id_column, text_column).filter(F.length("word") >= LENGTH)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= OCCURRENCES)


def rotations(words: DataFrame) -> DataFrame:
    """(start, edited, single, rank, n): where the rotations of each marked word stand in the order.

    A rotation of word + ``END`` stands at itself, and there are no more of those than
    code points and one.  A rotation that ends in a letter also stands at what is left
    without this letter, its ``edited`` one: all rotations that start so and go on for one
    letter are words that differ there by a replacement, and the rotation that is nothing
    else lacks the letter.  Of a run of equal letters, each of which leaves the same word,
    the first is ``single``.

    ``words`` are (rank, word, n); the rank stands for the word, so that a row is as long as
    its start.  A word of more than ``SPELLED`` code points has :func:`_checksums` as starts; one of
    just as many has its own rotations there too, where longer words look for them.
    """
    marked = F.concat("word", F.lit(END))

    def turned(i: Column) -> Column:
        return F.concat(F.substring(marked, i + 1, F.length(marked)), F.substring(marked, F.lit(1), i))

    def whole(i: Column) -> Column:
        return F.struct(turned(i).alias("start"), F.lit("").alias("edited"), F.lit(True).alias("single"))

    def skipped(i: Column) -> Column:
        letter = F.substring("word", i, 1)
        left = F.concat(F.substring(marked, i + 1, F.length(marked)), F.substring(marked, F.lit(1), i - 1))
        first = (i == 1) | (letter != F.substring("word", i - 1, 1))
        return F.struct(left.alias("start"), letter.alias("edited"), first.alias("single"))

    every = F.concat(
        F.transform(F.sequence(F.lit(0), F.length("word")), whole),
        F.transform(F.sequence(F.lit(1), F.length("word")), skipped),
    )
    short = words.filter(F.length("word") <= SPELLED)
    spelled = short.select(F.explode(every).alias("r"), "rank", "n").select("r.*", "rank", "n")
    long = words.filter(F.length("word") >= SPELLED).select("rank", "n", "word")
    return spelled.unionByName(long.mapInArrow(_checksums(SPELLED), PLACED))


def _powers(base: int, count: int) -> np.ndarray:
    found = np.ones(1, dtype=np.uint64)
    while len(found) < count:
        found = np.concatenate([found, found * np.uint64(pow(base, len(found), PRIME)) % np.uint64(PRIME)])
    return found[:count]


def _lanes(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Checksums of all rotations of a marked word, and of those that lack a letter.

    A lane of the sequence s is the sum of s[j] * base**j modulo ``PRIME``, so each is made
    from sums over the word's beginning: the work grows with the length, not its square.
    """
    p, size = np.uint64(PRIME), len(codes)
    whole, skipped = [], []
    for base in BASES:
        up, down = _powers(base, size + 2), _powers(pow(base, -1, PRIME), size + 2)
        sums = np.concatenate([[np.uint64(0)], np.cumsum(codes * up[:size] % p, dtype=np.uint64) % p])
        i = np.arange(size + 1)  # the rotation that begins at i
        tail = (sums[size] + p - sums) % p * down[: size + 1] % p
        mark = np.uint64(ord(END)) * up[size - i] % p
        whole.append((tail + mark + sums * up[size - i + 1] % p) % p)
        # the rotation after letter i ends in it
        skipped.append((tail[1:] + mark[1:] + sums[:-1] * up[size - i[1:] + 1] % p) % p)
    return np.stack(whole, axis=1), np.stack(skipped, axis=1)


def _checksums(spelled: int):  # noqa: ANN202
    """A mapInArrow function from (rank, n, word) to starts made of checksums."""

    def apply(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for rank, n, word in zip(*(c.to_pylist() for c in part.columns), strict=True):
                codes = np.frombuffer(word.encode("utf-32-le"), dtype="<u4").astype(np.uint64)
                whole, skipped = _lanes(codes)
                first = np.concatenate([[True], codes[1:] != codes[:-1]])
                # starts are length and checksums, after a mark that no rotation holds
                rows = [(whole, len(codes) + 1, [""] * len(whole), np.ones(len(whole), dtype=bool))]
                if len(codes) > spelled:
                    rows.append((skipped, len(codes), list(word), first))
                for lanes, size, edited, single in rows:
                    for low in range(0, len(lanes), STARTS):
                        some = slice(low, low + STARTS)
                        octets = np.ascontiguousarray(lanes[some], dtype="<u4").view("S16").ravel()
                        starts = [f"#{size}:{octet.ljust(16, bytes(1)).hex()}" for octet in octets.tolist()]
                        count = len(starts)
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(starts, pa.string()),
                                pa.array(edited[some], pa.string()),
                                pa.array(single[some]),
                                pa.array(np.full(count, rank)),
                                pa.array(np.full(count, n)),
                            ],
                            ["start", "edited", "single", "rank", "n"],
                        )

    return apply


def neighbours(words: DataFrame) -> DataFrame:
    """(rank, n_near, near): how many words are near to each, and the best of them.

    ``words`` are (rank, word, n), ranks in the order of words; ``near`` holds ``minus_n``
    and ``rank``.  Rotations are sorted by ranges of their start; a group, the rotations of one start, is
    a run of them that one scan reads.  It holds at most one word for each letter of the
    alphabet and the one that lacks it, so no group is large.  Members aren't paired: each
    takes the group's best, or the second where it is the best itself.  Two words
    meet once: those of equal length at the letter that differs, others at the first of
    the equal letters of which one is left out.
    """
    sorted_runs = rotations(words).repartitionByRange("start").sortWithinPartitions("start", "edited")
    group = Window.partitionBy("start")
    longer = F.col("edited") != ""
    entry = F.struct((-F.col("n")).alias("minus_n"), "rank")
    replaced = F.slice(F.sort_array(F.collect_list(F.when(longer, entry)).over(group)), 1, 2)
    scanned = sorted_runs.select(
        "rank",
        "single",
        entry.alias("own"),
        longer.alias("longer"),
        replaced.alias("best"),
        F.count(F.when(longer, 1)).over(group).alias("n_longer"),
        F.count(F.when(longer & F.col("single"), 1)).over(group).alias("n_single"),
        F.min(F.when(longer & F.col("single"), entry)).over(group).alias("best_single"),
        F.min(F.when(~longer, entry)).over(group).alias("shorter"),
    )
    lacking = F.col("single") & F.col("shorter").isNotNull()
    other = F.when(F.col("best")[0] == F.col("own"), F.get("best", F.lit(1))).otherwise(F.col("best")[0])
    of_longer = F.least(other, F.when(lacking, F.col("shorter")))
    met = scanned.select(
        "rank",
        F.when(F.col("longer"), F.col("n_longer") - 1 + lacking.cast("long")).otherwise(F.col("n_single")).alias("n_near"),
        F.when(F.col("longer"), of_longer).otherwise(F.col("best_single")).alias("near"),
    ).filter("n_near > 0")
    return met.groupBy("rank").agg(F.sum("n_near").alias("n_near"), F.min("near").alias("near"))


def roots(forms: DataFrame) -> DataFrame:
    """(rank, root) for every word with a form, from (rank, form).

    Each round doubles the way that a pointer has gone.  A form has FORM times the
    occurrences of its word, so there are no cycles and few rounds.
    """
    pointers = stable(forms.select("rank", F.col("form").alias("root")))
    while True:
        onward = pointers.select(F.col("rank").alias("root"), F.col("root").alias("next"))
        moved = stable(pointers.join(onward, "root", "left").select("rank", F.coalesce("next", "root").alias("root"), "next"))
        pointers = moved.select("rank", "root")
        if moved.filter(F.col("next").isNotNull()).isEmpty():
            return pointers


def variants(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """For every word: ``word``, ``n``, ``n_near``, ``form``, ``form_n`` and ``root``.

    Words are runs of Latin letters with A-Z in lower case, a part of them with a letter
    left out (see :func:`occurrences`), that have enough code points and occurrences.
    Near words differ by one code point.  The form of a word is its near word of
    largest ``n`` (ties: the smallest word) if that has FORM times as many occurrences; the root
    is the last of its forms, or the word itself.

    Null texts have no words, nor do empty ones; a null id hashes as an empty one; rows
    that repeat count each time; an empty table has no words; other columns aren't read.
    """
    counted = vocabulary(docs, id_column, text_column).orderBy("word")
    words = stable(counted.select(F.monotonically_increasing_id().alias("rank"), "word", "n"))
    near = neighbours(words)
    best = F.when(-F.col("near.minus_n") >= FORM * F.col("n"), F.col("near"))
    found = words.join(near, "rank", "left").withColumn("best", best)
    found = found.select(
        "rank",
        "word",
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.col("best.rank").alias("form"),
        (-F.col("best.minus_n")).alias("form_n"),
    )
    found = stable(found)
    formed = found.filter(F.col("form").isNotNull())
    pointed = formed.select("rank", "form").join(roots(formed), "rank")
    named = words.select(F.col("rank").alias("form"), F.col("word").alias("form_word"))
    last = words.select(F.col("rank").alias("root"), F.col("word").alias("root_word"))
    spelled = pointed.join(named, "form").join(last, "root").select("rank", "form_word", "root_word")
    return found.join(spelled, "rank", "left").select(
        "word", "n", "n_near", F.col("form_word").alias("form"), "form_n", F.coalesce("root_word", "word").alias("root")
    )
