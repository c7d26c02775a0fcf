"""Term search over memories.

A memory matches a term when its rendered, lower-cased record contains the
term anywhere, inside words and in field names too.  The score is the share of
query terms found, repeats counted.  A memory without any match is no result.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom import constants as K
from recordloom.functions import text as X
from recordloom.functions.sizing import stable
from recordloom.operators.memories import ID
from recordloom.operators.postings import TermIndex, build_index, search_index
from recordloom.operators.threads import json_map

# Word characters plus marks: lower-casing a letter may leave a mark behind it.
_RUN = r"[\p{L}\p{M}\p{N}_]+"


def haystack() -> Column:
    """The record as searched: canonical JSON, lower-cased."""
    record = X.json_object(
        {
            "id": X.json_string(F.col(ID)),
            "content": X.json_string(F.col("content")),
            "metadata": json_map(F.col("metadata")),
            "provenance": F.coalesce("provenance", F.lit("{}")),
            "temporal": F.coalesce("temporal", F.lit("{}")),
            "verification": F.coalesce("verification", F.lit("{}")),
            "relations": F.coalesce("relations", F.lit("{}")),
        }
    )
    return F.lower(record)


def query_terms(query: str) -> list[str]:
    import re

    return [t.lower() for t in re.findall(r"\w+", query)]


def term_search(memories: DataFrame, query: str, limit: int = K.DEFAULT_MEMORY_LIMIT) -> DataFrame:
    """Best memories for one query: one scan and a top-k, no join."""
    terms = query_terms(query)
    searched = memories.withColumn("_hay", haystack())
    if terms:
        found = reduce(
            add, [F.when(F.contains("_hay", F.lit(t)), F.lit(1)).otherwise(F.lit(0)) for t in terms]
        )
    else:
        found = F.lit(0)
    return (
        searched.withColumn("matches", found)
        .filter(F.col("matches") > 0)
        .withColumn("score", F.col("matches") / F.lit(float(max(1, len(terms)))))
        .drop("_hay")
        .orderBy(F.col("score").desc(), X.file_order(F.col(ID)))
        .limit(max(1, limit))
    )


def memory_index(memories: DataFrame) -> TermIndex:
    """The inverted index of memories as they are searched; ``write`` keeps it for later batches."""
    return build_index(memories, haystack(), _RUN)


def term_search_batch(memories: DataFrame, queries: DataFrame, limit: int = K.DEFAULT_MEMORY_LIMIT) -> DataFrame:
    """Best memories for many queries (query_id, query)."""
    return indexed_search(memory_index(memories), queries, limit)


def indexed_search(index: TermIndex, queries: DataFrame, limit: int = K.DEFAULT_MEMORY_LIMIT) -> DataFrame:
    """Best memories for many queries (query_id, query) from an index.

    A term lies inside one run of word characters, so terms are matched once with the distinct
    runs of the corpus, and only the postings of these are opened.
    """
    limit = max(1, limit)
    asked = queries.select("query_id", F.explode(X.words(F.col("query"))).alias("term"))
    counted = stable(asked.groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("weight")))
    names = counted.groupBy("query_id").agg(F.sum("weight").alias("n_terms"))
    names = stable(names.withColumn("query", F.monotonically_increasing_id()))
    weights = counted.join(names, "query_id").select("query", "term", "weight")
    best = search_index(index, weights, limit)
    return best.join(index.records, "doc").join(names, "query").select(
        "query_id", F.col("row").alias("rank"), ID, (F.col("matches") / F.col("n_terms")).alias("score")
    )
