"""Mixing sources to target weights (problem 7).

Weighted fair queueing.  The documents of a source stand in shuffled order; a document's virtual finish time is the number of
tokens of its source up to and including itself, divided by the source's weight.  Documents of all sources are sorted by
that time and taken until the token budget is reached.  A source that runs out is queued again, in another order, at most
``max_repeats`` times in all.

Running sums are made in two steps, over hash buckets and within each bucket, and the global order in ranges of virtual
time, so a source that holds most of the rows is spread over as many tasks as its size asks for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waraq.llm.tokens import VOCABULARY, with_tokens
from waraq.shared import written

#: Rows that one bucket of a running sum should hold.
ROWS_PER_BUCKET = 50_000


def running_sum(df: DataFrame, group: list[str], bucket: str, order: list[Column], value: str, out: str) -> DataFrame:
    """``df`` with ``out``: sum of ``value`` up to and including the row, in the order of (bucket, order) within ``group``."""
    sums = df.groupBy(*group, bucket).agg(F.sum(value).alias("_s"))
    before = (Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*group, bucket, F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy(*group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = df.withColumn("_in", F.sum(value).over(within)).join(sums, [*group, bucket])
    return rows.withColumn(out, F.col("_before") + F.col("_in")).drop("_before", "_in")


class Mixture:
    """A corpus of ``budget`` tokens in which each source has its target share.

    ``targets``: (source, target_share, max_repeats).  Shares are scaled to a sum of 1 over the sources that have tokens; null or
    non-positive shares count as 0, null max_repeats as 1; of a source named twice shares add up and the smaller limit holds.  Documents of no
    targeted source, null included, aren't used.  Without ``budget`` it is the largest one at which every source can
    deliver its share within its limit.  Repeated rows are documents of their own; null or empty texts have 0 tokens and come along at
    the place where they stand.  Without documents or usable targets the result is empty.
    """

    def __init__(self, documents: DataFrame, targets: DataFrame, budget: int | None = None, seed: int = 1, vocabulary: str = VOCABULARY):
        self.spark, self.seed = documents.sparkSession, seed
        self.sized = written(with_tokens(documents.select("doc_id", "source", F.xxhash64("doc_id", "text").alias("own"), "text"), "text", vocabulary), "source-tokens")
        share = F.when(F.col("target_share") > 0, F.col("target_share")).otherwise(0.0)
        self.targets = targets.where("source IS NOT NULL").groupBy("source").agg(F.sum(share).alias("target_share"), F.min(F.coalesce("max_repeats", F.lit(1))).alias("max_repeats"))
        self.totals = self.sized.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("rows"), F.max("n_tokens").alias("longest"))
        # One row a targeted source: the targets are a small table of settings.
        self.sources = {r["source"]: r.asDict() for r in self.totals.join(self.targets, "source").where("target_share > 0 AND max_repeats >= 1 AND tokens > 0").collect()}
        total = sum(s["target_share"] for s in self.sources.values())
        for s in self.sources.values():
            s["weight"] = s["target_share"] / total
        self.budget = budget if budget is not None else int(min((s["max_repeats"] * s["tokens"] / s["weight"] for s in self.sources.values()), default=0))

    def horizon(self) -> float:
        """Virtual time by which the budget is surely used up, or all that may be used is.

        Until virtual time v a source has given its weight times v, or all it has, less at most one document.
        """
        have = [(s["weight"], s["max_repeats"] * s["tokens"]) for s in self.sources.values()]
        enough = self.budget + sum(s["longest"] for s in self.sources.values())
        low, high = 0.0, max(cap / w for w, cap in have)
        for _ in range(60):
            v = (low + high) / 2
            low, high = (low, v) if sum(min(w * v, cap) for w, cap in have) >= enough else (v, high)
        return high

    def documents(self) -> DataFrame:
        """(doc_id, source, copy, n_tokens, virtual_finish, tokens_through): the documents taken, copy counting from 0.

        A source is repeated no further than the horizon, past which nothing can be taken.
        """
        schema = "doc_id bigint, source string, copy int, n_tokens bigint, virtual_finish double, tokens_through bigint"
        if not self.sources or self.budget <= 0:
            return self.spark.createDataFrame([], schema)
        horizon = self.horizon()
        for s in self.sources.values():
            s["passes"] = min(s["max_repeats"], int(horizon * s["weight"] / s["tokens"]) + 1)
        of = lambda k, kind: F.create_map(*[x for n, s in self.sources.items() for x in (F.lit(n), F.lit(s[k]).cast(kind))])[F.col("source")]
        rows = self.sized.where(F.col("source").isin(*self.sources))
        rows = rows.select("*", F.explode(F.sequence(F.lit(0), of("passes", "int") - 1)).alias("copy"))
        n = max(s["rows"] for s in self.sources.values())
        rows = rows.withColumn("_u", F.xxhash64(F.lit(self.seed), "copy", "own")).withColumn("_bucket", F.pmod("_u", F.lit(max(1, n // ROWS_PER_BUCKET))))
        rows = running_sum(rows, ["source", "copy"], "_bucket", [F.col("_u"), F.col("doc_id"), F.col("n_tokens")], "n_tokens", "_sum")
        rows = rows.withColumn("virtual_finish", (F.col("_sum") + F.col("copy") * of("tokens", "bigint")) / of("weight", "double")).where(F.col("virtual_finish") <= horizon)
        ranges = max(1, sum(s["rows"] * s["passes"] for s in self.sources.values()) // ROWS_PER_BUCKET)
        rows = rows.drop("_bucket", "_u", "_sum").withColumn("_range", F.least(F.lit(ranges - 1), F.floor(F.col("virtual_finish") / F.lit(horizon) * ranges)).cast("bigint"))
        rows = running_sum(rows, [], "_range", [F.col("virtual_finish"), F.col("source"), F.col("copy"), F.col("doc_id"), F.col("n_tokens")], "n_tokens", "tokens_through")
        return rows.where(F.col("tokens_through") <= self.budget).select("doc_id", "source", "copy", "n_tokens", "virtual_finish", "tokens_through")

    def shares(self) -> DataFrame:
        """(source, target_share, max_repeats, available_tokens, used_tokens, n_documents, copies, actual_share) of every source of documents or targets."""
        used = self.documents().groupBy("source").agg(F.sum("n_tokens").alias("used_tokens"), F.count("*").alias("n_documents"), (F.max("copy") + 1).alias("copies"))
        used = written(used, "source-shares")  # a row a targeted source
        whole = used.agg(F.sum("used_tokens").alias("whole")).first()["whole"]
        rows = self.totals.join(self.targets, "source", "full").join(used, "source", "left")
        return rows.select(
            "source", F.coalesce("target_share", F.lit(0.0)).alias("target_share"), F.coalesce("max_repeats", F.lit(0)).alias("max_repeats"), F.coalesce("tokens", F.lit(0)).alias("available_tokens"),
            F.coalesce("used_tokens", F.lit(0)).alias("used_tokens"), F.coalesce("n_documents", F.lit(0)).alias("n_documents"), F.coalesce("copies", F.lit(0)).alias("copies"),
            F.coalesce(F.try_divide(F.col("used_tokens"), F.lit(whole or 0)), F.lit(0.0)).alias("actual_share"))
