"""Plain versions of the operators, and tables with hard cases."""

from __future__ import annotations

import re

import numpy as np
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names the operators use themselves.
CLASHES = "id key n part slot chunk size mix word text_sha256 keep_id kept fingerprint component_id ids decoded lang_pred score spans base _mix_key _mix_size _found _salt".split()


def hard_documents(spark, extra: bool = True):
    long_text = "wort und the la " * 20_000
    rows = [
        (1, None, "en", "a", None),
        (2, "", None, "a", 0),
        (3, " \t\n ", "en", None, 3),
        (4, "The same text here and there", "en", "b", 1),
        (5, "The same text here and there", "en", "b", 1),
        (5, "The same text here and there", "en", "b", 1),
        (None, "The same text here and there", "fr", "b", 1),
        (None, None, None, None, None),
        (6, long_text, "de", "a", 1),
        (7, "x" * 200_000, "de", "c", 1),
        (8, "12345 !!! 678", "de", "c", 1),
        (9, "mail joe@example.com or +1 (132) 555-1352 now", "en", "c", 1),
        (10, "日本語のテキスト <|endoftext|> fin", "xx", "é", 1),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    if extra:
        from pyspark.sql import functions as F

        for name in CLASHES:
            df = df.withColumn(name, F.lit("x"))
    return df


def fingerprint(text: str | None) -> int:
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(lower)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(nodes: dict, linked) -> dict:
    """Smallest key reachable from each key, over links between values."""
    parent = {k: k for k in nodes}

    def find(k):
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    keys = sorted(nodes)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            if linked(nodes[a], nodes[b]):
                a_root, b_root = find(a), find(b)
                parent[max(a_root, b_root)] = min(a_root, b_root)
    return {k: find(k) for k in keys}


def nearest(ids: np.ndarray, vectors: np.ndarray, query: int, k: int) -> list[int]:
    at = int(np.flatnonzero(ids == query)[0])
    distance = np.sqrt(((vectors - vectors[at]) ** 2).sum(axis=1))
    distance[at] = np.inf
    return ids[np.lexsort([ids, distance])[: min(k, len(ids) - 1)]].tolist()


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(map(int, str(2 * int(d)))) for d in even)) % 10 == 0


PATTERNS = (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    out = []
    for kind, pattern in enumerate(PATTERNS):
        for match in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", match[0])
            good = (
                True,
                kind == 1 and all(int(p) <= 255 for p in match[0].split(".")),
                16 <= len(digits) <= 19 and luhn(digits),
                8 <= len(digits) <= 15,
            )[kind]
            if good:
                out.append((kind, *match.span()))
    return out
