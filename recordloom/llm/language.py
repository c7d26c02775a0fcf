"""Language identification: family first, then one-versus-one support vector machines."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from recordloom.llm.common import fresh, stable, text_batches

#: Rows learned from at most, over all languages; SNIPPET characters of each are learned too.
SAMPLE_ROWS, SNIPPET = 2_000, 80
#: Parts of a language's texts that are cut to the smallest hashes side by side.
SLICES = 64
DIMENSIONS = 4_096
SLAB = 1 << 20
UNKNOWN = "und"
#: Families of language codes, fixed values; any other code is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da nb nn no is fy af lb yi",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk",
    "baltic": "lt lv",
    "uralic": "fi et hu",
    "celtic": "ga gd cy br",
    "turkic": "tr az kk ky uz tk",
    "indo-aryan": "hi ur bn pa mr ne gu",
    "sinitic": "zh yue",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}


def family_of(language: str) -> str:
    return FAMILY_OF.get(language.lower().replace("_", "-").split("-")[0], language)


def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x10000)])


LETTER = _letters()
MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], dtype=np.uint32)


def grams(text: str) -> np.ndarray | None:
    """Unit vector of hashed runs of 1 to 3 letters of a whole text; None without letters.

    Anything but letters counts as a space.  Entries are square roots of shares.
    """
    total, seen = np.zeros(DIMENSIONS), False
    for start in range(0, len(text), SLAB):
        codes = np.frombuffer(text[start : start + SLAB].lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
        wide = codes > 0xFFFF
        letter = LETTER[np.where(wide, 0, codes)]
        if wide.any():
            letter |= np.array([w and chr(c).isalpha() for c, w in zip(codes.tolist(), wide.tolist(), strict=True)])
        if not letter.any():
            continue
        seen = True
        spaced = np.where(letter, codes, 32).astype(np.uint32)
        spaced = spaced[np.concatenate([[True], letter[1:] | letter[:-1]])]
        padded = np.concatenate([[32], spaced, [32]]).astype(np.uint32)
        mixed = padded * MULTIPLIERS[0]
        for size in range(1, 4):
            if size > 1:
                mixed = (mixed[:-1] ^ (mixed[:-1] >> np.uint32(15))) * MULTIPLIERS[size - 1] + padded[size - 1 :]
            slots = (mixed * MULTIPLIERS[0] + np.uint32(size)) >> np.uint32(20)
            total += np.bincount(slots, minlength=DIMENSIONS)
    if not seen:
        return None
    vector = np.sqrt(total)
    return (vector / np.linalg.norm(vector)).astype(np.float32)


def support_vectors(x: np.ndarray, y: np.ndarray, cost: float = 8.0, rounds: int = 30, seed: int = 7) -> np.ndarray:
    """Weights (the last is the bias) of a linear machine with squared hinge loss.

    Dual coordinate descent; ``y`` holds +1 and -1, the two sides weigh alike.  Rows are
    read one at a time and never copied as a whole.
    """
    positive = max(1, int((y > 0).sum()))
    negative = max(1, len(y) - positive)
    each = cost * len(y) / 2 / np.where(y > 0, positive, negative)
    loose = 1 / (2 * each)
    norms = np.einsum("ij,ij->i", x, x) + 1.0 + loose
    alpha, weights, bias = np.zeros(len(y)), np.zeros(x.shape[1]), 0.0
    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        moved = 0.0
        for i in rng.permutation(len(y)):
            row = x[i].astype(np.float64)
            slope = y[i] * (weights @ row + bias) - 1 + loose[i] * alpha[i]
            new = max(0.0, alpha[i] - slope / norms[i])
            if new != alpha[i]:
                weights += (new - alpha[i]) * y[i] * row
                bias += (new - alpha[i]) * y[i]
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-3:
            break
    return np.append(weights, bias)


@dataclass(frozen=True)
class Model:
    """Weights of one machine per family and per pair of languages in a family."""

    languages: tuple[str, ...]
    families: tuple[str, ...]
    members: tuple[tuple[int, ...], ...]
    pairs: tuple[tuple[int, int], ...]
    weights: np.ndarray

    def predict(self, text: str | None) -> tuple[str, float]:
        vector = grams(text or "") if self.languages else None
        if vector is None:
            return UNKNOWN, 0.0
        margins = vector @ self.weights[:-1] + self.weights[-1]
        lead = margins[: len(self.families)]
        family = int(np.argmax(lead))
        odds = np.exp(np.minimum(4.0 * (lead - lead[family]), 0.0))
        sure = 1.0 / odds.sum() if len(lead) > 1 else 1.0
        members = self.members[family]
        votes = dict.fromkeys(members, 0.0)
        for k, (a, b) in enumerate(self.pairs):
            if a in votes and b in votes:
                chance = 1.0 / (1.0 + np.exp(-np.clip(4.0 * margins[len(self.families) + k], -30, 30)))
                votes[a] += float(chance)
                votes[b] += float(1.0 - chance)
        best = max(members, key=lambda m: (votes[m], -m))
        if len(members) > 1:
            sure *= votes[best] / (len(members) - 1)
        return self.languages[best], float(min(1.0, max(0.0, sure)))


def sampled(known: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(lang, mark, text): as many different texts of each language, those with the smallest hashes.

    ``known`` has columns ``text`` and ``lang`` without nulls.  All languages give
    ``sample_rows`` divided by their number, or one text each if they are more.  Copies
    count once, so neither sizes nor copies change which texts are taken.  Smallest
    hashes are cut in ``SLICES`` of each language first, so no task gets a language whole.
    """
    known = known.withColumn("mark", F.xxhash64(F.lit(11), "text"))
    marks = stable(known.select("lang", "mark").distinct())
    languages = marks.select("lang").distinct().count()
    most = max(1, sample_rows // max(1, languages))
    row, part = F.row_number(), F.pmod("mark", F.lit(SLICES))
    for window in (Window.partitionBy("lang", part), Window.partitionBy("lang")):
        marks = marks.withColumn("row", row.over(window.orderBy("mark"))).filter(F.col("row") <= most).drop("row")
    chosen = known.join(F.broadcast(marks), ["lang", "mark"])
    return chosen.groupBy("lang", "mark").agg(F.first("text").alias("text"))  # a text once, however often it is copied


def fit(labelled: DataFrame, text_column: str = "text", label_column: str = "lang", sample_rows: int = SAMPLE_ROWS) -> Model:
    """Learn from a sample of labelled rows, at most ``sample_rows`` of them or one for each language.

    Each language gives the same number of different texts at most, those with the
    smallest hashes; each is learned whole and as a snippet.
    """
    known = text_batches(labelled).filter(F.col(label_column).isNotNull() & F.col(text_column).isNotNull()).select(
        F.col(text_column).alias("text"), F.col(label_column).cast("string").alias("lang")
    )
    chosen = sampled(known, sample_rows)

    def features(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            rows = []
            for lang, text, mark in zip(*(part.column(i) for i in range(3)), strict=True):
                text = text.as_py()
                start = mark.as_py() % max(1, len(text) - SNIPPET)
                for piece in (text, text[start : start + SNIPPET]):
                    vector = grams(piece)
                    if vector is not None:
                        rows.append((lang.as_py(), vector.astype("<f2").tobytes()))
            langs, vectors = zip(*rows, strict=True) if rows else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(vectors, pa.binary())], ["lang", "vector"])

    table = chosen.select("lang", "text", "mark").mapInArrow(features, "lang string, vector binary").toArrow()
    if not table.num_rows:
        return Model((), (), (), (), np.zeros((DIMENSIONS + 1, 0)))
    x = np.empty((table.num_rows, DIMENSIONS), dtype=np.float32)
    for row, vector in enumerate(table["vector"]):
        x[row] = np.frombuffer(vector.as_py(), dtype="<f2")
    names = np.array(table["lang"].to_pylist())
    order = np.lexsort([x.sum(axis=1), names])  # rows come in any order; learning must not depend on it
    x, names = x[order], names[order]
    languages = tuple(sorted(set(names.tolist())))
    families = tuple(sorted({family_of(n) for n in languages}))
    members = tuple(tuple(i for i, n in enumerate(languages) if family_of(n) == f) for f in families)
    pairs = tuple(p for m in members for p in combinations(m, 2))
    where = np.array([languages.index(n) for n in names.tolist()])
    family = np.array([families.index(family_of(languages[i])) for i in where])
    columns = []
    for f in range(len(families)):
        columns.append(support_vectors(x, np.where(family == f, 1, -1)) if len(families) > 1 else np.zeros(DIMENSIONS + 1))
    for a, b in pairs:
        both = (where == a) | (where == b)
        columns.append(support_vectors(x[both], np.where(where[both] == a, 1, -1)))
    return Model(languages, families, members, pairs, np.stack(columns, axis=1).astype(np.float32))


def predicted(docs: DataFrame, model: Model, name: str, text_column: str = "text") -> DataFrame:
    """Every row with a column ``name`` of ``lang_pred`` and ``score`` added.

    ``und`` with score 0 for a text that is null or has no letter.  A prediction sees the
    whole text and nothing else, so equal texts agree.
    """
    shared = text_batches(docs).sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts):  # noqa: ANN001, ANN202
        import pandas as pd

        found = [shared.value.predict(t) for t in texts]
        return pd.DataFrame(found, columns=["lang_pred", "score"])

    return docs.withColumn(name, predict(F.col(text_column)))


def predictions(docs: DataFrame, model: Model, text_column: str = "text") -> DataFrame:
    """Every row with ``lang_pred`` and ``score``; columns of these names are replaced."""
    mark = fresh(docs, "_found")
    return predicted(docs, model, mark, text_column).select(
        *[F.col(f"`{c}`") for c in docs.columns if c not in ("lang_pred", "score")], f"{mark}.lang_pred", f"{mark}.score"
    )


def held_out(id_column: str = "doc_id") -> Column:
    """Rows never learned from: crc32 of the id as text leaves 1 when divided by 3."""
    text = F.coalesce(F.col(id_column).cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % 3 == 1
