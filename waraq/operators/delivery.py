"""Messages delivered more than once (problem 2).

A log is a folder:

* ``settings.json``: number of shards and identifier columns, fixed when the first batch comes,
* ``data/<draft>/dict``: exact dictionary identifier -> (shard, code), codes dense within their shard, bucketed and sorted by the identifiers' hash,
* ``data/<draft>/bits``: seen-bitmaps of 32,768 codes each, one row per place (shard, range of codes), bucketed by place,
* ``commits/<n>``: a file that names the draft of version n and the next code of each shard.

A batch is folded to one candidate per identifier before anything is joined, so copies of one
identifier never meet in one task.  Candidates are encoded, the bits of their codes are probed,
candidates of unset bits are selected, and the new dictionary entries and bits are written as a draft beside
the log.  Creating the commit file, which only one writer can, makes the draft a version; a batch that dies before has changed nothing.
As dictionary and bitmaps lie bucketed by what they are joined on, only the batch is shuffled, however long the log.
"""

from __future__ import annotations

import json
import uuid
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from waraq.shared import children, fresh_path, publish, read_bucketed, read_text, remove, write_bucketed

#: Identifiers that a shard should hold at most when the number of shards is derived from the first batch.
IDS_PER_SHARD = 1_000_000
#: Shards of a log for which none are named.
SHARDS = 64
#: Versions after which the log is compacted before it takes another batch.
COMPACT_AFTER = 8


def bit_is_set(bitmap: Column, position: Column) -> Column:
    """Whether bit ``position`` (0-based, least significant bit first) of a binary column is set."""
    byte = F.conv(F.hex(F.substring(bitmap, (F.floor(position / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.floor(byte / F.pow(F.lit(2), F.pmod(position, F.lit(8)))).cast("int").bitwiseAND(1) == 1, F.lit(False))


class SeenLog:
    """Durable record of the identifiers seen so far.

    ``shards`` counts for a new log only: it is stored, and a log opened with another number is refused.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, shards: int | None = None):
        self.spark, self._shards = spark, shards
        self.path = path or fresh_path(spark, "seen-log")
        self.settings()

    def settings(self) -> dict | None:
        """Settings of the log; None before its first batch."""
        text = read_text(self.spark, f"{self.path}/settings.json")
        found = json.loads(text) if text else None
        if found and self._shards not in (None, found["shards"]):
            raise ValueError(f"{self.path} has {found['shards']} shards, not {self._shards}")
        return found

    def _settle(self, ids: list[str], batch: DataFrame) -> dict:
        """Settings for a batch; those of a new log are made by its first writer."""
        own = {"shards": self._shards or SHARDS, "ids": [[c, batch.schema[c].dataType.simpleString()] for c in ids]}
        found = self.settings()
        if found is None:
            publish(self.spark, f"{self.path}/settings.json", json.dumps(own))
            found = self.settings()
        if found["ids"] != own["ids"]:
            raise ValueError(f"{self.path} holds identifiers {found['ids']}, not {own['ids']}")
        return found

    def version(self) -> int:
        """Number of the last commit."""
        return max((int(n) for n in children(self.spark, f"{self.path}/commits") if n.isdigit()), default=0)

    def _versions(self) -> list[dict]:
        """Commits that readers need, the last one first: back to one that holds everything before it."""
        found: list[dict] = []
        for n in range(self.version(), 0, -1):
            found.append(json.loads(read_text(self.spark, f"{self.path}/commits/{n}")))
            if found[-1]["base"]:
                break
        return found

    def _read(self, version: dict, part: str) -> DataFrame:
        settings = self.settings()
        ids = ", ".join(f"`{c}` {kind}" for c, kind in settings["ids"])
        schema, key = {"dict": (f"{ids}, h bigint, shard int, code bigint", "h"), "bits": ("place bigint, bits binary", "place")}[part]
        return read_bucketed(self.spark, f"{self.path}/data/{version['data']}/{part}", schema, key, settings["shards"])

    def _whole(self, part: str) -> DataFrame:
        """A part of all versions, as plain files: what is folded as a whole moves anyway."""
        versions = self._versions()
        return self.spark.read.schema(self._read(versions[0], part).schema).parquet(*[f"{self.path}/data/{v['data']}/{part}" for v in versions])

    def _write(self, draft: str, dictionary: DataFrame, bits: DataFrame, shards: int) -> None:
        parts = [(dictionary, f"{draft}/dict", "h"), (bits, f"{draft}/bits", "place")]
        with ThreadPoolExecutor(2) as pool:  # two jobs side by side
            list(pool.map(lambda p: write_bucketed(*p, shards), parts))

    def _commit(self, number: int, draft: str, following: list[int], base: bool) -> None:
        if not publish(self.spark, f"{self.path}/commits/{number}", json.dumps({"data": draft.rpartition("/")[2], "base": base, "next": following})):
            remove(self.spark, draft)
            raise RuntimeError(f"version {number} of {self.path} was committed by another writer; try again")

    def _draft(self) -> str:
        return f"{self.path}/data/{uuid.uuid4().hex}"

    def compact(self) -> None:
        """Commit a version that holds dictionary and bitmaps as a whole, so that readers need none before it."""
        versions = self._versions()
        if not versions:
            return
        number, draft = self.version() + 1, self._draft()
        bits = self._whole("bits").groupBy("place").agg(F.bitmap_or_agg("bits").alias("bits"))
        self._write(draft, self._whole("dict"), bits, self.settings()["shards"])
        self._commit(number, draft, versions[0]["next"], True)

    def dictionary(self) -> DataFrame:
        """(identifier..., shard, code) of every identifier met so far."""
        return self._whole("dict").drop("h")

    def bitmaps(self) -> DataFrame:
        """(shard, bucket, bits): union over all versions."""
        return self._whole("bits").groupBy(F.shiftright("place", 32).cast("int").alias("shard"), F.col("place").bitwiseAND(2**32 - 1).alias("bucket")).agg(F.bitmap_or_agg("bits").alias("bits"))

    def ingest(self, batch: DataFrame, ids: list[str], order: list[Column], arrival: str) -> DataFrame:
        """Commit a batch; returns (identifier..., arrival) of the arrivals selected from it.

        Identifiers compare null-safe as a whole but a batch row with any null in ``ids`` must be filtered by the
        caller if null means unknown.  Of several arrivals of one unseen identifier the least by ``order`` wins,
        null order values last; equal in everything, they are one arrival.  An empty batch commits an empty version.
        Another writer's commit in the meantime raises RuntimeError, and nothing of the batch is in the log.  After ``COMPACT_AFTER`` versions the
        log is compacted first.
        """
        settings = self._settle(ids, batch)
        shards = settings["shards"]
        if len(self._versions()) > COMPACT_AFTER:
            self.compact()
        versions, number = self._versions(), self.version() + 1
        following = versions[0]["next"] if versions else [0] * shards
        ranked = [x for c in [*order, F.col(arrival)] for x in (c.isNull(), c)]
        key = F.struct(*[x.alias(f"o{i}") for i, x in enumerate(ranked)])
        hashed = F.xxhash64(*ids)
        first = batch.groupBy(*ids).agg(F.min(key).alias("_first"))
        new = first.select(*ids, F.col(f"_first.o{len(ranked) - 1}").alias(arrival), hashed.alias("h"), F.pmod(hashed, F.lit(shards)).cast("int").alias("shard"), F.lit(None).cast("bigint").alias("code"))
        for v in versions:  # each identifier is in one version
            known = self._read(v, "dict").select(F.col("h").alias("_h"), *[F.col(c).alias(f"_{c}") for c in ids], F.col("code").alias("_code")).hint("merge")
            same = [F.coalesce(F.col(c) == F.col(f"_{c}"), F.col(c).isNull() & F.col(f"_{c}").isNull()) for c in ids]  # beside the hash, so that the buckets fit the join
            found = new.join(known, reduce(lambda a, b: a & b, same, F.col("h") == F.col("_h")), "left")
            new = found.select(*ids, arrival, "h", "shard", F.coalesce("code", "_code").alias("code"))
        if versions:
            place = F.shiftleft(F.col("shard").cast("bigint"), 32) + F.bitmap_bucket_number(F.col("code") + 1)
            new = new.withColumn("place", F.coalesce(place, -1 - F.pmod("h", F.lit(1 << 30)))).withColumn("seen", F.lit(False))
            for v in versions:
                bits = self._read(v, "bits").select(F.col("place").alias("_place"), F.col("bits").alias("_bits")).hint("merge")
                new = new.join(bits, F.col("place") == F.col("_place"), "left").withColumn("seen", F.col("seen") | bit_is_set(F.col("_bits"), F.bitmap_bit_position(F.col("code") + 1))).drop("_place", "_bits")
            new = new.where("NOT seen").drop("place", "seen")
        w = Window.partitionBy("shard").orderBy(F.col("code").isNotNull(), *ids)
        base = F.element_at(F.lit(following).cast("array<bigint>"), F.col("shard") + 1)
        new = new.withColumn("fresh", F.col("code").isNull()).withColumn("code", F.coalesce("code", base + F.row_number().over(w) - 1))
        draft = self._draft()
        new.write.option("compression", "zstd").parquet(f"{draft}/selected")
        selected = self.spark.read.schema(new.schema).parquet(f"{draft}/selected")
        added = {r["shard"]: r["n"] for r in selected.where("fresh").groupBy("shard").agg(F.count("*").alias("n")).collect()}  # a row a shard
        place = F.shiftleft(F.col("shard").cast("bigint"), 32) + F.bitmap_bucket_number(F.col("code") + 1)
        bits = selected.groupBy(place.alias("place")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("code") + 1)).alias("bits"))
        self._write(draft, selected.where("fresh").select(*ids, "h", "shard", "code"), bits, shards)
        self._commit(number, draft, [n + added.get(k, 0) for k, n in enumerate(following)], False)
        return selected.select(*ids, arrival)


def numbered(pages: DataFrame) -> DataFrame:
    """Deliveries that carry a page number: (delivery_id, book_id, number, sub_idx, received_at)."""
    return pages.select("delivery_id", "book_id", F.coalesce("page_id", "url_page_id").alias("number"), "sub_idx", "received_at").where(F.col("number").isNotNull())


def keep_one(pages: DataFrame, rounds: int = 2, shards: int | None = None) -> DataFrame:
    """One delivery of each page: (book_id, number, sub_idx, delivery_id), the earliest by received_at, then delivery_id.

    The table is replayed in ``rounds`` batches cut at quantiles of received_at, so a batch never holds an arrival
    older than one committed before; any number of rounds gives the same result.  Rows without received_at come last.
    Null book_id or sub_idx is a value of its own.  Rows without a number are no page and not in the result.  Repeated rows with
    the same delivery_id are one delivery; a delivery_id that is null is kept if nothing else delivers its page.
    """
    spark = pages.sparkSession
    rows = numbered(pages)
    kind = rows.schema["received_at"].dataType
    wanted = [i / rounds for i in range(1, rounds)]
    size = rows.agg(F.count("*").alias("n"), *([F.percentile_approx("received_at", wanted).cast("array<string>").alias("c")] if wanted else [])).first()
    cuts = [F.lit(c).cast(kind) for c in sorted(set(size["c"] or []))] if wanted else []
    log = SeenLog(spark, shards=shards or max(4, -(-size["n"] // IDS_PER_SHARD)))
    kept = None
    for i in range(len(cuts) + 1):
        part = rows
        at = F.col("received_at")
        if i > 0:
            part = part.where((at > cuts[i - 1]) | at.isNull() if i == len(cuts) else at > cuts[i - 1])
        if i < len(cuts):
            part = part.where(at <= cuts[i])
        chosen = log.ingest(part, ["book_id", "number", "sub_idx"], [F.col("received_at")], "delivery_id")
        kept = chosen if kept is None else kept.unionByName(chosen)
    return kept


def superfluous(pages: DataFrame, rounds: int = 2) -> DataFrame:
    """delivery_id of every numbered delivery that ``keep_one`` left out, each once; null delivery_ids are not reported."""
    kept = keep_one(pages, rounds).select(F.col("delivery_id").alias("kept_id")).where(F.col("kept_id").isNotNull())
    rows = numbered(pages).select("delivery_id").where(F.col("delivery_id").isNotNull())
    return rows.join(kept.hint("merge"), F.col("delivery_id") == F.col("kept_id"), "left_anti").distinct()
