"""Personal data: fixed patterns plus a semi-Markov conditional random field.

The patterns give the base spans.  The field looks at windows of words around digits
and at-signs, scores whole candidate spans of up to ``MAX_WORDS`` words for each type and
chooses boundaries and types jointly; spans it finds beside the base ones are added.  It
is trained on windows of the corpus whose labels are the base spans, and on variants of
them that the patterns miss.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.llm.common import text_batches

KINDS = ("email", "ip", "card", "phone")
OTHER = len(KINDS)
#: Words of a candidate span and characters of a word in one, at most; both bound an entity.
MAX_WORDS, MAX_WORD = 5, 64
#: Words of a window; a longer run is cut into windows that share MAX_WORDS - 1 words.
WINDOW_WORDS = 64
#: Windows learned from at most, and rounds over them.
SAMPLE_WINDOWS, ROUNDS = 1_200, 6
#: A span is added if its segmentation beats the one without it by this log-odds.
MARGIN = 3.0

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOTTED = re.compile(r"[0-9.]+")
ADDRESS = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
#: The class holds the space and the hyphen.
WIDE_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
CLUE = re.compile(r"[0-9@]")
GAP = re.compile(r"[\x20\t-\r]")
SPAN = re.compile(r"[^\x20\t-\r]+")
EDGES = ".,;:!?\"'<>[]{}"


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the address pattern, found from the at-signs in linear time."""
    last = floor = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            last = found.end()
        floor = max(last, at + 1)
        at = text.find("@", floor)


def addresses(text: str) -> Iterator[tuple[int, int]]:
    for run in DOTTED.finditer(text):
        if run.group().count(".") < 3:
            continue
        # no dotted part is tried twice: runs of digits are cut once
        parts = [(m.start(), m.end()) for m in re.finditer(r"[0-9]+", run.group())]
        i = 0
        while i + 3 < len(parts):
            four = parts[i : i + 4]
            if all(b[0] == a[1] + 1 for a, b in zip(four, four[1:], strict=False)):
                values = [run.group()[s:e].lstrip("0") for s, e in four]
                if all(len(v) <= 3 and int(v or 0) <= 255 for v in values):
                    yield run.start() + four[0][0], run.start() + four[3][1]
                i += 4
            else:
                i += 1


def cards(text: str) -> Iterator[tuple[int, int]]:
    for found in WIDE_CARD.finditer(text):
        if found.end() - found.start() >= 16:
            digits = re.sub(r"[^0-9]", "", found.group())
            if 16 <= len(digits) <= 19 and luhn(digits):
                yield found.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    for found in PHONE.finditer(text):
        if 8 <= sum(c in "0123456789" for c in found.group()) <= 15:
            yield found.span()


FINDERS = (emails, addresses, cards, phones)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind, then start; offsets in code points."""
    if not CLUE.search(text):
        return []
    return [(k, *span) for k, find in enumerate(FINDERS) for span in find(text)]


@dataclass(frozen=True)
class Window:
    """Neighbouring words with a clue in them; spans that start from ``core`` on are left
    to the next window of the run."""

    words: tuple[tuple[int, int], ...]
    core: int


def windows(text: str) -> list[Window]:
    """Runs of words near a digit or at-sign; a very long word is no candidate."""
    out: list[Window] = []
    run: list[tuple[int, int]] = []
    done = 0

    def close() -> None:
        step = WINDOW_WORDS - MAX_WORDS + 1
        for low in range(0, len(run), step):
            last = low + WINDOW_WORDS >= len(run)
            words = tuple(run[low : low + WINDOW_WORDS])
            out.append(Window(words, len(words) if last else step))
            if last:
                break

    for clue in CLUE.finditer(text):
        at = clue.start()
        if at < done:
            continue
        start = at
        while start > done and at - start <= MAX_WORD and not GAP.match(text, start - 1):
            start -= 1
        gap = GAP.search(text, at, at + MAX_WORD + 1)
        end = gap.start() if gap else min(len(text), at + MAX_WORD + 1)
        word = SPAN.match(text, at)
        done = word.end() if word else at + 1
        if end - start > MAX_WORD or done != end:
            close()
            run = []
            continue
        if run and not (start - run[-1][1] == 1 and text[run[-1][1]] == " "):
            close()
            run = []
        run.append((start, end))
    close()
    return out


def trimmed(text: str, start: int, end: int) -> tuple[int, int]:
    while start < end and text[start] in EDGES:
        start += 1
    while end > start and text[end - 1] in EDGES:
        end -= 1
    return start, end


def span_features(span: str) -> list[float]:
    """What a whole candidate span looks like."""
    digits = re.sub(r"[^0-9]", "", span)
    n, size = len(digits), max(1, len(span))
    octets = span.split(".")
    quads = len(octets) == 4 and all(o.isdigit() and len(o) <= 3 and int(o) <= 255 for o in octets if o.isascii())
    letters = sum(c.isalpha() for c in span)
    signs = span.count("@")
    groups = re.findall(r"[0-9]+", span)
    tail = span.rpartition("@")[2]
    return [
        1.0,
        float(signs == 1),
        float(signs > 1),
        float(signs == 1 and "." in tail.strip(".") and " " not in span),
        float(quads and " " not in span),
        float(len(octets) == 4),
        float(16 <= n <= 19),
        float(16 <= n <= 19 and letters == 0 and luhn(digits)),
        float(8 <= n <= 15),
        float(9 <= n <= 12),
        float(n < 7),
        float(n > 19),
        float(n == 0),
        float(span.startswith("+")),
        float(span[:1] == "("),
        float("(" in span and ")" in span),
        float(span.count("(") != span.count(")")),
        float(letters == 0),
        min(letters / size, 1.0),
        min(n / size, 1.0),
        float(len(groups) == 1),
        float(len(groups) in (3, 4)),
        float(bool(groups) and len(groups[-1]) == 4),
        float(bool(re.fullmatch(r"[0-9]{4}(?:[ -][0-9]{4}){3}", span))),
        float(bool(re.fullmatch(r"\+?[0-9() .-]+", span))),
        float(bool(re.search(r"[0-9]{3}[ .-][0-9]{4}$", span))),
        float("/" in span or "_" in span or "=" in span),
        float(" " in span),
        span.count(" ") / MAX_WORDS,
        float(span[-1:].isdigit()),
    ]


FEATURES = len(span_features("a"))


def candidates(text: str, window: Window) -> list[tuple[int, int, int, int]]:
    """(first word, word after the last, start, end) of all candidate spans of a window."""
    words = window.words
    out = []
    for i in range(len(words)):
        for j in range(i + 1, min(len(words), i + MAX_WORDS) + 1):
            start, end = trimmed(text, words[i][0], words[j - 1][1])
            if start < end:
                out.append((i, j, start, end))
    return out


@dataclass(frozen=True)
class Field:
    """Weights of the span features for each type and of neighbouring types."""

    spans: np.ndarray  # (types, FEATURES), the last type is "other", of single words
    steps: np.ndarray  # (types, types)


def _scores(field: Field, text: str, window: Window) -> tuple[list[tuple[int, int, int, int]], np.ndarray, np.ndarray]:
    found = candidates(text, window)
    features = np.array([span_features(text[s:e]) for _, _, s, e in found]).reshape(-1, FEATURES)
    scores = features @ field.spans.T
    single = np.array([j - i == 1 for i, j, _, _ in found], dtype=bool)
    scores[~single, OTHER] = -np.inf
    return found, features, scores


def best_segments(field: Field, text: str, window: Window) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the best segmentation where it beats none by ``MARGIN``."""
    found, _, scores = _scores(field, text, window)
    n = len(window.words)
    ending: list[list[int]] = [[] for _ in range(n + 1)]
    for c, (_, j, _, _) in enumerate(found):
        ending[j].append(c)
    best = np.full((n + 1, OTHER + 1), -np.inf)
    best[0, OTHER] = 0.0
    back: dict[tuple[int, int], tuple[int, int]] = {}
    for j in range(1, n + 1):
        if not any(found[c][1] - found[c][0] == 1 for c in ending[j]):  # a word of punctuation alone
            best[j] = best[j - 1]
            for y in range(OTHER + 1):
                back[j, y] = (-1, y)
        for c in ending[j]:
            into = best[found[c][0]][:, None] + field.steps
            before = into.argmax(axis=0)
            value = into.max(axis=0) + scores[c]
            for y in np.flatnonzero(value > best[j]).tolist():
                best[j, y] = value[y]
                back[j, y] = (c, int(before[y]))
    alone = np.zeros(n + 1)
    for c, (i, j, _, _) in enumerate(found):
        if j - i == 1:
            alone[j] = scores[c, OTHER]
    plain = np.cumsum(alone)
    out, j, y = [], n, int(best[n].argmax())
    while j > 0:
        c, before = back[j, y]
        if c < 0:
            j -= 1
            continue
        i, _, start, end = found[c]
        if y != OTHER and i < window.core and scores[c, y] - (plain[j] - plain[i]) >= MARGIN:
            out.append((y, start, end))
        j, y = i, before
    return out[::-1]


def gradient(field: Field, text: str, window: Window, gold: dict[tuple[int, int], int]) -> tuple[np.ndarray, np.ndarray]:
    """Of the log-likelihood: features and steps of the right segmentation less expected ones."""
    found, features, scores = _scores(field, text, window)
    n, types = len(window.words), OTHER + 1
    forward = np.full((n + 1, types), -np.inf)
    backward = np.full((n + 1, types), -np.inf)
    forward[0, OTHER], backward[n] = 0.0, 0.0

    def reach(row: np.ndarray) -> np.ndarray:
        return np.logaddexp.reduce(row[:, None] + field.steps, axis=0)

    for j in range(1, n + 1):
        for c, (i, end, _, _) in enumerate(found):
            if end == j:
                forward[j] = np.logaddexp(forward[j], reach(forward[i]) + scores[c])
    for i in range(n - 1, -1, -1):
        for c, (start, j, _, _) in enumerate(found):
            if start == i:
                after = field.steps + (scores[c] + backward[j])[None, :]
                backward[i] = np.logaddexp(backward[i], np.logaddexp.reduce(after, axis=1))
    total = np.logaddexp.reduce(forward[n])
    spans, steps = np.zeros_like(field.spans), np.zeros_like(field.steps)
    if not np.isfinite(total):
        return spans, steps
    for c, (i, j, _, _) in enumerate(found):
        joint = forward[i][:, None] + field.steps + (scores[c] + backward[j])[None, :] - total
        joint = np.exp(joint)
        steps -= joint
        spans -= np.outer(joint.sum(axis=0), features[c])
    place = {f[:2]: c for c, f in enumerate(found)}
    at, before = 0, OTHER
    while at < n:
        ends = [j for (i, j) in gold if i == at]
        j = ends[0] if ends else at + 1
        y = gold.get((at, j), OTHER)
        steps[before, y] += 1
        if (at, j) in place:
            spans[y] += features[place[at, j]]
        at, before = j, y
    return spans, steps


def labelled(text: str, base: list[tuple[int, int, int]]) -> Iterator[tuple[str, list[list[int]], list[list[int]]]]:
    """(text, words, segments) of the windows whose base spans fall on words.

    For each window with a number that starts with a plus, a variant without the plus and
    country digits keeps its label.
    """
    for window in windows(text):
        low, high = window.words[0][0], window.words[-1][1]
        piece = text[low:high]
        words = [[s - low, e - low] for s, e in window.words]
        if len(words) > 24:
            continue
        starts, ends = {}, {}
        for i, (s, e) in enumerate(words):
            s, e = trimmed(piece, s, e)
            starts[s], ends[e] = i, i + 1
        inside = [(k, s - low, e - low) for k, s, e in base if s >= low and e <= high]
        segments, clear, last = [], True, 0
        for k, s, e in sorted(inside, key=lambda x: (x[1], x[0])):
            i, j = starts.get(s), ends.get(e)
            if i is None or j is None or i < last or j - i > MAX_WORDS:
                clear = False
                break
            segments.append([i, j, k])
            last = j
        if not clear:
            continue
        yield piece, words, segments
        if len(segments) == 1 and segments[0][2] == 3 and segments[0][0] == 0 and segments[0][1] - segments[0][0] > 1:
            cut = words[1][0]
            yield piece[cut:], [[s - cut, e - cut] for s, e in words[1:]], [[0, segments[0][1] - 1, 3]]


def train(docs: DataFrame, text_column: str = "text", sample: int = SAMPLE_WINDOWS, rounds: int = ROUNDS) -> Field:
    """Fit the field on at most ``sample`` windows for each set of types in a window.

    Windows are chosen by a hash of their text from all rows, copies once.
    """
    def gather(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            rows = []
            for text in part.column(0).to_pylist():
                if text and CLUE.search(text):
                    for piece, words, segments in labelled(text, base_spans(text)):
                        kind = "".join(sorted({str(k) for _, _, k in segments}))
                        rows.append((kind, piece, words, segments))
            kinds, pieces, words, segments = zip(*rows, strict=True) if rows else ((), (), (), ())
            nested = pa.list_(pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(kinds, pa.string()), pa.array(pieces, pa.string()), pa.array(words, nested), pa.array(segments, nested)],
                ["kind", "piece", "words", "segments"],
            )

    found = text_batches(docs).select(F.col(text_column).alias("text")).filter(F.col("text").rlike("[0-9@]")).mapInArrow(
        gather, "kind string, piece string, words array<array<int>>, segments array<array<int>>"
    )
    order = F.struct(F.xxhash64("piece").alias("h"), "piece", "words", "segments")
    slots = F.pmod(F.xxhash64(F.lit(3), "piece"), F.lit(sample))
    chosen = found.groupBy("kind", slots.alias("slot")).agg(F.min(order).alias("w")).filter(F.length("kind") <= len(KINDS))
    rows = sorted(chosen.select("kind", "w.*").toArrow().to_pylist(), key=lambda r: (r["h"], r["piece"]))
    spans, steps = np.zeros((OTHER + 1, FEATURES)), np.zeros((OTHER + 1, OTHER + 1))
    squares = [np.full_like(spans, 1e-2), np.full_like(steps, 1e-2)]
    for _ in range(rounds):
        for row in rows:
            window = Window(tuple(map(tuple, row["words"])), len(row["words"]))
            gold = {(i, j): k for i, j, k in row["segments"]}
            grads = gradient(Field(spans, steps), row["piece"], window, gold)
            for weight, grad, square in zip((spans, steps), grads, squares, strict=True):
                grad = grad - 1e-3 * weight
                square += grad * grad
                weight += 0.3 * grad / np.sqrt(square)
    return Field(spans, steps)


def find(text: str | None, field: Field) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and all spans: base ones and those the field adds beside them."""
    if not text or not CLUE.search(text):
        return [], []
    base = base_spans(text)
    taken = sorted((s, e) for _, s, e in base)
    starts = np.array([s for s, _ in taken])
    reach = np.maximum.accumulate([e for _, e in taken]) if taken else np.array([])
    added = []
    for window in windows(text):
        low, high = window.words[0][0], window.words[-1][1]
        if len(window.words) == 1 and _covered(starts, reach, *trimmed(text, low, high)):
            continue
        for k, s, e in best_segments(field, text, window):
            if not _covered(starts, reach, s, e) and (not added or s >= added[-1][2]):
                added.append((k, s, e))
    return base, sorted(base + added)


def _covered(starts: np.ndarray, reach: np.ndarray, start: int, end: int) -> bool:
    before = int(np.searchsorted(starts, end, side="left"))
    return before > 0 and reach[before - 1] > start


def private_spans(docs: DataFrame, field: Field, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """For every row: id, ``base`` and ``spans``, arrays of (kind, start, end).

    Offsets count code points, ends are exclusive; order is by kind as in ``KINDS``, then
    start.  Null and empty texts have none; repeated rows and null ids give a row each;
    other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(field)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def apply(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            base, spans = [], []
            for text in part.column(1):
                found = find(text.as_py(), shared.value)
                for out, some in zip((base, spans), found, strict=True):
                    out.append([{"kind": KINDS[k], "start": s, "end": e} for k, s, e in some])
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(base, kind), pa.array(spans, kind)], [id_column, "base", "spans"]
            )

    rows = text_batches(docs).select(F.col(id_column).cast("long").alias(id_column), F.col(text_column))
    array = "array<struct<kind:string,start:int,end:int>>"
    return rows.mapInArrow(apply, f"`{id_column}` long, base {array}, spans {array}")
