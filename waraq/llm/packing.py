"""Filling fixed-capacity sequences with documents (problem 6).

Shortest-pack-first over the length histogram.  Documents are counted per length, lengths are placed longest first,
and each goes into the packing pattern with the most space left, all copies of a pattern at once; so the
planning works on at most ``capacity`` histogram bins whatever the number of documents.  Documents then
find their sequence by their rank among the documents of their length.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waraq.llm.tokens import VOCABULARY, spread_rank, with_tokens
from waraq.shared import written

#: Rows that a part of a length's documents should hold at most.
ROWS_PER_PART = 100_000


class Plan:
    """Where the pieces of every length go: piece ``rank`` of a length is in sequence ``first + rank - low``."""

    def __init__(self):
        self.low: dict[int, list[int]] = defaultdict(list)
        self.first: dict[int, list[int]] = defaultdict(list)
        self.sequences = 0

    def add(self, pattern: tuple | None, copies: int, given: dict[int, int]) -> None:
        """A finished pattern, as linked (length, rest), of ``copies`` sequences."""
        while pattern is not None:
            length, pattern = pattern
            self.low[length].append(given[length])
            self.first[length].append(self.sequences)
            given[length] += copies
        self.sequences += copies


def shortest_pack_first(histogram: dict[int, int], capacity: int) -> Plan:
    """Plan for ``histogram`` (length -> pieces, lengths 1 to ``capacity``)."""
    packs: dict[int, list[tuple[int, tuple | None]]] = defaultdict(list)  # space left -> [(copies, pattern)]
    spaces: list[int] = []  # heap of the keys of packs, most space first
    plan, given = Plan(), defaultdict(int)

    def put(space: int, copies: int, pattern: tuple) -> None:
        if space == 0:
            plan.add(pattern, copies, given)
            return
        if not packs[space]:
            heapq.heappush(spaces, -space)
        packs[space].append((copies, pattern))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left > 0:
            if spaces and -spaces[0] >= length:
                space = -spaces[0]
                copies, pattern = packs[space].pop()
                if not packs[space]:
                    heapq.heappop(spaces)
                n = min(copies, left)
                if copies > n:
                    put(space, copies - n, pattern)
                put(space - length, n, (length, pattern))
            else:
                n, fits = left, capacity // length
                # so many new sequences that the copies of this length fill them evenly, the shortest pack being always a new one
                whole = n // fits
                pattern = None
                for _ in range(fits):
                    pattern = (length, pattern)
                if whole:
                    put(capacity - fits * length, whole, pattern)
                if rest := n - whole * fits:
                    pattern = None
                    for _ in range(rest):
                        pattern = (length, pattern)
                    put(capacity - rest * length, 1, pattern)
            left -= n
    for space in sorted(packs):
        for copies, pattern in packs[space]:
            plan.add(pattern, copies, given)
    return plan


class Packing:
    """Sequences of the capacities in ``sizes`` (pack_kind, capacity_tokens) made of documents.

    A document longer than the capacity is cut into whole sequences and a remainder that is packed with the others; no other
    document is split.  A document without tokens (null or empty text) takes no room and is noted in sequence 0.
    Rows with equal doc_id are documents of their own, told apart by nothing but order.  A kind with null capacity or one below 1 is left out; of
    a kind named twice the larger capacity counts.  No documents: no rows.  Other columns are ignored.
    """

    def __init__(self, documents: DataFrame, sizes: DataFrame, vocabulary: str = VOCABULARY):
        kinds = sizes.where("capacity_tokens >= 1").groupBy("pack_kind").agg(F.max("capacity_tokens").alias("capacity_tokens"))
        self.capacity = {r["pack_kind"]: r["capacity_tokens"] for r in kinds.collect()}
        self.lengths = written(with_tokens(documents.select("doc_id", F.xxhash64("doc_id", "text").alias("own"), "text"), "text", vocabulary), "document-tokens")

    def _pieces(self) -> DataFrame:
        """(pack_kind, capacity, doc_id, own, part, piece) with every document once per kind, cut where it exceeds the capacity."""
        kinds = F.array(*[F.struct(F.lit(k).alias("pack_kind"), F.lit(c).cast("bigint").alias("capacity")) for k, c in self.capacity.items()])
        rows = self.lengths.select("doc_id", "own", "n_tokens", F.explode(kinds).alias("k")).select("k.*", "doc_id", "own", "n_tokens")
        last = F.floor(F.greatest(F.col("n_tokens") - 1, F.lit(0)) / F.col("capacity"))
        rows = rows.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("part"))
        return rows.select("pack_kind", "capacity", "doc_id", "own", F.col("part").cast("int").alias("part"), F.least("capacity", F.col("n_tokens") - F.col("part") * F.col("capacity")).alias("piece"))

    def sequences(self) -> DataFrame:
        """(pack_kind, sequence_id, doc_id, part, n_tokens) of every piece of every document."""
        schema = "pack_kind string, sequence_id bigint, doc_id bigint, part int, n_tokens bigint"
        if not self.capacity:
            return self.lengths.sparkSession.createDataFrame([], schema)
        pieces = self._pieces()
        counted = written(pieces.groupBy("pack_kind", "piece").agg(F.count("*").alias("n")), "piece-lengths")  # at most the sum of the capacities
        bins = counted.where("piece > 0").collect()
        histograms: dict[str, dict[int, int]] = defaultdict(dict)
        for r in bins:
            histograms[r["pack_kind"]][r["piece"]] = r["n"]
        table = {}
        for kind, histogram in histograms.items():
            plan = shortest_pack_first(histogram, self.capacity[kind])
            for length in histogram:
                table[kind, length] = (np.array(plan.low[length]), np.array(plan.first[length]))
        parts = counted.select("pack_kind", "piece", F.ceil(F.col("n") / ROWS_PER_PART).alias("parts"))
        pieces = pieces.join(F.broadcast(parts), ["pack_kind", "piece"])  # a row a length, as above
        ranked = spread_rank(pieces, ["pack_kind", "piece"], ["own", "doc_id", "part"], F.col("parts")).select("pack_kind", "doc_id", "part", "piece", "rank")

        def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                at = np.zeros(len(batch), dtype=np.int64)
                for key, own in batch.groupby(["pack_kind", "piece"]).indices.items():
                    if key[1] > 0:
                        low, first = table[key]
                        rank = batch["rank"].to_numpy()[own]
                        k = np.searchsorted(low, rank, side="right") - 1
                        at[own] = first[k] + rank - low[k]
                yield pd.DataFrame({"pack_kind": batch["pack_kind"], "sequence_id": at, "doc_id": batch["doc_id"], "part": batch["part"], "n_tokens": batch["piece"]})

        return ranked.mapInPandas(place, schema)

    def fill(self) -> DataFrame:
        """(pack_kind, sequence_id, capacity_tokens, used_tokens, n_pieces) of every sequence."""
        of = F.create_map(*[F.lit(x) for kv in self.capacity.items() for x in kv]) if self.capacity else F.create_map(F.lit(""), F.lit(0))
        return self.sequences().groupBy("pack_kind", "sequence_id").agg(F.sum("n_tokens").alias("used_tokens"), F.count("*").alias("n_pieces")).select(
            "pack_kind", "sequence_id", of[F.col("pack_kind")].alias("capacity_tokens"), "used_tokens", "n_pieces")


def summary(fill: DataFrame) -> DataFrame:
    """(pack_kind, n_sequences, used_tokens, fill_permille) of each kind."""
    return fill.groupBy("pack_kind").agg(F.count("*").alias("n_sequences"), F.sum("used_tokens").alias("used_tokens"),
        F.round(1000 * F.sum("used_tokens") / F.sum("capacity_tokens")).cast("int").alias("fill_permille"))
