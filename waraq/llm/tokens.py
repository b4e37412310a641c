"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rank file of the tokenizer; every worker reads it from this path.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: the pattern that splits text before the merges of the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Distinct words kept per worker before the cache is emptied.
CACHE_WORDS = 300_000


def encoding(vocabulary: str = VOCABULARY):
    """The tokenizer of a rank file."""
    import tiktoken

    with open(vocabulary, "rb") as lines:
        ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


class Counter(dict):
    """Tokens per pre-split word; merges never cross such words, so a text's count is the sum."""

    def __init__(self, vocabulary: str = VOCABULARY):
        import regex

        self._encode = encoding(vocabulary).encode_ordinary
        self._words = regex.compile(PATTERN).findall

    def __missing__(self, word: str) -> int:
        n = len(self._encode(word))
        if len(word) <= 64:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = n
        return n

    def count(self, text: str) -> int:
        return sum(map(self.__getitem__, self._words(text)))


def with_tokens(df: DataFrame, text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """``df`` with the column ``text`` replaced by ``n_tokens``; a null or empty text has 0 tokens."""
    kept = [f for f in df.schema.fields if f.name != text]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + ["n_tokens bigint"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counter = Counter(vocabulary)
        for batch in batches:
            sizes = [counter.count(t) if t else 0 for t in batch[text]]
            yield batch.drop(columns=[text]).assign(n_tokens=pd.Series(sizes, index=batch.index, dtype="int64"))

    return df.mapInPandas(run, schema)


def spread_rank(df: DataFrame, group: list[str], by: list[str], parts: Column):
    """``df`` with ``rank``, 0-based and dense within ``group``; no group is ever in one task.

    Rows of a group are dealt to its number of ``parts`` by the hash of the first column of ``by`` and ordered by all of them; ranks within a part start at the number of rows in the parts before.
    """
    from pyspark.sql import Window

    rows = df.withColumn("_part", F.pmod(F.xxhash64(by[0]), parts))
    sizes = rows.groupBy(*group, "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(*group, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inner = Window.partitionBy(*group, "_part").orderBy(*by)
    rows = rows.withColumn("_r", F.row_number().over(inner) - 1)
    return rows.join(sizes, [*group, "_part"]).withColumn("rank", F.col("_before") + F.col("_r")).drop("_part", "_before", "_r")
