"""Long exact spans shared between records (problem 4).

Fixed-block anchors.  Every line is cut into non-overlapping reference blocks and probed at every
rolling window of that size; a hit is extended to the maximal exact repeats on its diagonal.  Sizes follow from the least span (``Sizes``); for 120
code points blocks have 43.

*Which windows travel.*  A block may only start where the window is a closed syncmer: the least hash of its
7-grams is that of its first or its last one.  That is a property of the window's own characters, so a rolling
window without it can't equal any block and is dropped where it is read (about 17 of 18).  At least one of any 36
consecutive windows has it, so blocks placed greedily, each at the first such window after the one before,
start at most 43 + 35 apart, and every stretch of 2 * 43 + 36 - 2 = 120 code points holds a whole block.

*What a block is compared by.*  A span of 120 around a block of 43 leaves 77 code points beside it, so at least 39 on its left or
on its right.  Blocks and windows are therefore keyed twice, with the 39 code points before and after
them; phrases that merely share a block fall apart.  Keys are folded to (least id, greatest id, members) map-side, so a key of any number
of members is a row a task; the windows of keys that two lines have are found again by a join that splits hot keys.

*Hot phrases.*  Members of groups of over ``LARGE_GROUP`` are keyed anew, by windows of 108 around the block, and where those are still
large groups by all windows of 120.  A group of the last kind holds lines that truly share a span: it is a *hub*, and its lines are listed as members of the hub,
not pair by pair.  So the work is linear in the lines, however many have a phrase; pairs are made only where the result is pairs.

*Links.*  Which windows of 120 of a text another class has too follows from repeats and hubs alike, so it doesn't depend on the size of groups.  Every such window
lies in one *stretch*: two windows that follow each other are in the same stretch if they do so wherever one of them occurs.  That is a property of the texts alone.
A stretch is cut where the code points beside a window vary (or a text ends) among its places.  Any two places of a window in two texts are in a repeat
or in its hub.  So, if they differ there, the repeat begins or ends at both, or the members of the hub vary; what is left are other places of the window in one of the
two texts, found in the text itself.  The windows of repeats aren't shuffled for that.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waraq.operators.skew import HOT_SHARE, SALTS
from waraq.shared import written

MIN_SPAN = 120
#: Groups of more members than this are keyed anew, by windows longer by the next step.
LARGE_GROUP = 24
#: Code points hashed at once; arrays of this size stay in the processor's cache.
CHUNK = 1 << 17
#: A table of ids or keys is broadcast up to so many rows (16 bytes each), else joined by shuffle.
BROADCAST_ROWS = 500_000


class Sizes:
    """Window sizes for a least span: every stretch of ``span`` code points holds a whole block, and ``side`` more on its left or right."""

    def __init__(self, span: int = MIN_SPAN):
        if span < 8:
            raise ValueError("spans have at least 8 code points")
        self.span = span
        self.gram = min(7, span // 6)
        self.block = (span + self.gram + 2) // 3
        self.side = (span - self.block + 1) // 2
        self.steps = (max(2, span // 9), 1)


_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)
_FOLD = np.uint64(29)


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = a * _MULTIPLY
    out += b
    out ^= out >> _FOLD
    out *= np.uint64(0xD6E8FEB86659FD93)
    return out


class Rolling:
    """Hashes of all windows of an array of code points, for any window size, from shared powers of two."""

    def __init__(self, codes: np.ndarray):
        first = (codes.astype(np.uint64) + np.uint64(1)) * _MULTIPLY
        self._levels = [first ^ (first >> np.uint64(32))]

    def windows(self, size: int) -> np.ndarray:
        """Hash of ``codes[i:i + size]`` for every i that has so many; depends on those code points only."""
        while 1 << len(self._levels) <= size:
            last, step = self._levels[-1], 1 << (len(self._levels) - 1)
            n = max(0, len(last) - step)
            self._levels.append(_mix(last[:n], last[step : step + n]))
        out, covered = None, 0
        for level in range(size.bit_length() - 1, -1, -1):
            if size >> level & 1:
                part = self._levels[level][covered:]
                out = part if out is None else _mix(out[: len(part)], part[: len(out)])
                covered += 1 << level
        return out


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` consecutive values."""
    out, have = values, 1
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:]) if len(out) > have else out[:0]
        have *= 2
    rest = width - have
    return np.minimum(out[:-rest], out[rest:]) if rest and len(out) > rest else out if not rest else out[:0]


def anchors(texts: list[str], sizes: Sizes) -> tuple[np.ndarray, ...]:
    """(text index, start, key, is a reference block) of every keyed window of ``texts``."""
    block, gram, side = sizes.block, sizes.gram, sizes.side
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    starts = np.cumsum(lengths) - lengths
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    none = np.zeros(0, dtype=np.int64)
    if len(codes) < block:
        return none, none, none, none.astype(bool)
    rolling = Rolling(codes)
    grams = rolling.windows(gram)
    per_block = block - gram + 1
    least = sliding_min(grams, per_block)
    at = np.flatnonzero((least == grams[: len(least)]) | (least == grams[per_block - 1 : per_block - 1 + len(least)]))
    text = np.searchsorted(starts, at, side="right") - 1
    inside = at + block <= starts[text] + lengths[text]
    at, text = at[inside], text[inside]
    if not len(at):
        return none, none, none, none.astype(bool)
    following = np.searchsorted(at, at + block)
    is_block = np.zeros(len(at), dtype=bool)
    current = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
    while len(current):
        is_block[current] = True
        after = following[current]
        ok = after < len(at)
        ok[ok] = text[after[ok]] == text[current[ok]]
        current = after[ok]
    body, beside = rolling.windows(block), rolling.windows(side)
    left, right = at - side >= starts[text], at + block + side <= starts[text] + lengths[text]
    key_left = _mix(beside[at[left] - side], body[at[left]])
    key_right = _mix(body[at[right]] ^ np.uint64(0x5851F42D4C957F2D), beside[at[right] + block])
    which = np.concatenate([np.flatnonzero(left), np.flatnonzero(right)])
    key = np.concatenate([key_left, key_right]).view(np.int64)
    return text[which], (at - starts[text])[which], key, is_block[which]


def common_runs(a: np.ndarray, b: np.ndarray, shift: int, least: int) -> Iterator[tuple[int, int]]:
    """(start in a, length) of the maximal runs with a[i] == b[i + shift] that are at least ``least`` long."""
    lo, hi = max(0, -shift), min(len(a), len(b) - shift)
    if hi - lo < least:
        return
    differ = np.flatnonzero(a[lo:hi] != b[lo + shift : hi + shift])
    edges = np.concatenate([[-1], differ, [hi - lo]])
    for k in np.flatnonzero(np.diff(edges) > least):
        yield int(lo + edges[k] + 1), int(edges[k + 1] - edges[k] - 1)


class SharedSpans:
    """Exact repeats of at least ``min_span`` code points between the texts of a table.

    Texts equal as a whole are one class: the least id stands for it, ``copies`` links the others, and only classes
    are compared, so a text that a third of the rows repeat costs as much as one.  Null ids and null texts take no part;
    texts shorter than the span have none; repeated rows with one id are one row; other columns are ignored.
    An empty table gives empty results.
    """

    def __init__(self, df: DataFrame, row_id: str = "line_id", text: str = "html", min_span: int = MIN_SPAN):
        self.sizes = Sizes(min_span)
        self.all = df.select(F.col(row_id).cast("bigint").alias("id"), F.col(text).alias("text")).where(F.col("id").isNotNull())
        self.spark = df.sparkSession
        self._long = self.all.where(F.length("text") >= min_span)
        self._copies = self._found = self._repeats = self._stretches = None

    def _held(self, df: DataFrame, label: str) -> tuple[DataFrame, bool]:
        """A written table, and whether it has few enough rows to be broadcast."""
        rows = written(df, label)
        return rows, rows.count() <= BROADCAST_ROWS

    def copies(self) -> DataFrame:
        """(id, rep) of the rows whose text an earlier id has too."""
        if self._copies is None:
            keyed = self._long.select("id", F.sha2("text", 256).alias("digest"))
            groups = keyed.groupBy("digest").agg(F.min("id").alias("rep"), F.max("id").alias("last")).where("rep <> last").select("digest", "rep")
            groups, small = self._held(groups, "text-classes")
            found = keyed.join(F.broadcast(groups) if small else groups, "digest").where("id <> rep").select("id", "rep").distinct()
            self._copies = self._held(found, "text-copies")
        return self._copies[0]

    def _reps(self) -> DataFrame:
        copies = self.copies()
        return self._long.join(F.broadcast(copies) if self._copies[1] else copies, "id", "left_anti")

    def _met(self, keyed: DataFrame, keys: list[str]) -> DataFrame:
        """Windows whose key two texts have, with ``members`` of the key."""
        groups = keyed.groupBy(*keys).agg(F.min("id").alias("_lo"), F.max("id").alias("_hi"), F.count("*").alias("members")).where("_lo <> _hi").select(*keys, "members")
        return self._of(keyed, groups, keys)

    def _of(self, keyed: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
        """Windows whose key is in ``groups``, with the columns of that; ``members`` is the number of windows of a key."""
        groups, small = self._held(groups, "span-keys")
        if small:
            return keyed.join(F.broadcast(groups), keys)
        total = groups.agg(F.sum("members").alias("n")).first()["n"]
        least = max(LARGE_GROUP, int(total * HOT_SHARE))
        hot = F.broadcast(groups.where(F.col("members") > least).select(*keys, F.lit(True).alias("_hot")))  # under 1 / HOT_SHARE rows
        salt = F.when(F.col("_hot"), F.pmod(F.xxhash64("id", "start"), F.lit(SALTS))).otherwise(F.lit(0))
        every = F.explode(F.when(F.col("members") > least, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))
        rows = keyed.join(hot, keys, "left").withColumn("_salt", salt.cast("int")).drop("_hot")
        return rows.join(groups.withColumn("_salt", every).hint("merge"), [*keys, "_salt"]).drop("_salt")

    def _search(self) -> tuple[DataFrame, DataFrame]:
        """(id_a, id_b, shifts) of pairs of texts that meet in small groups, and (key, key2, id, start, before, after) of the members of hubs."""
        if self._found is not None:
            return self._found
        sizes = self.sizes
        met = written(self._met(self._reps().mapInPandas(_keyed(sizes), KEYED), ["key"]).withColumn("block", F.col("start")), "span-anchors")
        hits = [_hits(met.where(F.col("members") <= LARGE_GROUP))]
        hubs = None
        for step in sizes.steps:
            large = met.where(F.col("members") > LARGE_GROUP).groupBy("id").agg(F.collect_set(F.struct(F.col("block"), "is_block")).alias("blocks"))  # of one text
            large = written(large, "span-large")
            if not large.take(1):
                break
            texts = self._long.join(large, "id").dropDuplicates(["id"])
            met = written(self._met(texts.mapInPandas(_rekeyed(sizes, step), REKEYED), ["key", "key2"]), "span-anchors")
            hits.append(_hits(met.where(F.col("members") <= LARGE_GROUP)))
            if step == 1:
                hubs = met.where(F.col("members") > LARGE_GROUP).select("key", "key2", "id", "start", "before", "after")
        hits = reduce(DataFrame.unionByName, hits)
        hits = hits.groupBy("id_a", "id_b").agg(F.array_distinct(F.flatten(F.collect_list("shifts"))).alias("shifts"))
        if hubs is None:
            hubs = self.spark.createDataFrame([], "key bigint, key2 bigint, id bigint, start int, before int, after int")
        self._found = written(hits, "span-hits"), hubs
        return self._found

    def repeats(self) -> DataFrame:
        """(id_a, id_b, start_a, start_b, n_chars), id_a < id_b, of every maximal repeat between two classes that meet in a group of at most LARGE_GROUP windows."""
        if self._repeats is None:
            hits = self._search()[0]
            ids, small = self._held(hits.select(F.col("id_a").alias("id")).union(hits.select("id_b")).distinct(), "span-ids")
            texts = self._long.join(F.broadcast(ids) if small else ids, "id", "left_semi").dropDuplicates(["id"])
            pairs = hits.join(texts.select(F.col("id").alias("id_a"), F.col("text").alias("text_a")), "id_a").join(texts.select(F.col("id").alias("id_b"), F.col("text").alias("text_b")), "id_b")
            self._repeats = written(pairs.mapInPandas(_extended(self.sizes.span), "id_a bigint, id_b bigint, start_a int, start_b int, n_chars int"), "span-repeats")
        return self._repeats

    def hubs(self) -> DataFrame:
        """(hub, id, start) of stretches of ``min_span`` that over LARGE_GROUP windows have; of hubs with the same lines one stays."""
        members = self._search()[1]
        each = members.select("key", "key2", "id").distinct().withColumn("_h", F.xxhash64("id"))
        same = each.groupBy("key", "key2").agg(F.count("*").alias("n"), F.sum(F.shiftright("_h", 40)).alias("sum"), F.bit_xor("_h").alias("mix"))
        kept = written(same.groupBy("n", "sum", "mix").agg(F.min(F.struct("key", "key2")).alias("hub")).select("hub.*"), "span-hubs")
        return members.groupBy("key", "key2", "id").agg(F.min("start").alias("start")).join(kept, ["key", "key2"]).select(F.struct("key", "key2").alias("hub"), "id", "start")

    def _places(self) -> DataFrame:
        """(id, s, e) of the places whose windows of ``min_span`` another class has too, the longest of each start; they may overlap."""
        span, r = self.sizes.span, self.repeats()
        ends = r.select(F.col("id_a").alias("id"), F.col("start_a").alias("s"), (F.col("start_a") + F.col("n_chars")).alias("e")).union(
            r.select(F.col("id_b"), F.col("start_b"), F.col("start_b") + F.col("n_chars"))).union(
            self._search()[1].select("id", F.col("start").alias("s"), (F.col("start") + span).alias("e")))
        return ends.groupBy("id", "s").agg(F.max("e").alias("e"))

    def stretches(self) -> DataFrame:
        """(key, key2, id, start, n_chars) of every place of every stretch: the longest runs of windows that occur at the same places, so each window that two classes have is in one. The keys are those of its first window."""
        if self._stretches is None:
            span, keys, r, hubs = self.sizes.span, ["key", "key2"], self.repeats(), self._search()[1]
            varies = lambda c: (F.min(c) < 0) | (F.min(c) != F.max(c))
            varied = hubs.groupBy(*keys).agg(F.count("*").alias("members"), varies("before").alias("first"), varies("after").alias("last")).where(F.col("first") | F.col("last"))
            cuts = self._of(hubs, varied, keys).select("id", F.when(F.col("first"), F.col("start")).alias("first"), F.when(F.col("last"), F.col("start") + span).alias("last"))
            for x in "ab":
                cuts = cuts.union(r.select(f"id_{x}", f"start_{x}", F.col(f"start_{x}") + F.col("n_chars")))
            places = self._places().select("id", (F.col("s") * F.lit(1 << 32) + F.col("e")).alias("place")).unionByName(cuts, allowMissingColumns=True)
            places = places.groupBy("id").agg(F.collect_list("place").alias("places"), F.collect_set("first").alias("firsts"), F.collect_set("last").alias("lasts"))  # of one text
            places = written(places, "span-places")
            ids = places.select("id")
            texts = self._long.join(F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids, "id", "left_semi").dropDuplicates(["id"]).join(places, "id")
            self._stretches = written(texts.mapInPandas(_stretches(span), "key bigint, key2 bigint, id bigint, start int, n_chars int"), "span-stretches")
        return self._stretches

    def links(self) -> DataFrame:
        """(link, kind, line_id, start, n_chars): any two lines of one link have that stretch in common, and all classes that share a span are in the links of its windows together.

        Kinds: ``copy`` (equal texts; the link is their class) and ``stretch`` (of ``stretches``; the least id stands for a class). A line has a row for each place
        of a stretch. A repeat of two lines is the union of their stretches on its diagonal, each of which begins ``min_span`` - 1 before the one before it ends.
        As many rows as there are lines and places of stretches, at most one for each window; nothing is expanded into pairs of lines.
        """
        sized = self._long.select("id", F.length("text").alias("n")).dropDuplicates(["id"])
        copies = self.copies()
        of_class = copies.select("rep", "id").union(copies.select("rep", F.col("rep").alias("id")).distinct()).join(sized, "id")
        copy = of_class.select(F.concat(F.lit("c"), F.col("rep")).alias("link"), F.lit("copy").alias("kind"), F.col("id").alias("line_id"), F.lit(0).alias("start"), F.col("n").alias("n_chars"))
        name = F.concat_ws("-", F.lit("s"), F.hex("key"), F.hex("key2"))
        return copy.unionByName(self.stretches().select(name.alias("link"), F.lit("stretch").alias("kind"), F.col("id").alias("line_id"), "start", "n_chars"))

    def pairs(self) -> DataFrame:
        """(line_a, line_b), line_a < line_b, of all rows that share a span, each once; copies included."""
        hubs = self.hubs().select("hub", "id")
        classes = written(self.repeats().select("id_a", "id_b").union(_within(hubs, "hub")).distinct(), "span-pairs")
        copies = self.copies()
        ends = classes.select(F.col("id_a").alias("rep")).union(classes.select("id_b")).distinct()
        members = copies.select("rep", "id").union(ends.select("rep", F.col("rep").alias("id")))
        a, b = members.toDF("id_a", "x"), members.toDF("id_b", "y")
        between = classes.join(a, "id_a").join(b, "id_b").select(F.least("x", "y").alias("line_a"), F.greatest("x", "y").alias("line_b"))
        own = copies.select("rep", "id").union(copies.select("rep", F.col("rep").alias("id")).distinct())
        return between.union(_within(own, "rep").toDF("line_a", "line_b"))

    def shared(self) -> DataFrame:
        """(line_id, n_chars, shared_chars) of every row: code points of it, and those inside spans that another row has too.

        Linear in rows, repeats and members of hubs.  A null text has 0 of both.
        """
        ends, copies = self._places(), self.copies()
        before = Window.partitionBy("id").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)  # the places of one text
        covered = ends.withColumn("reached", F.coalesce(F.max("e").over(before), F.lit(0))).groupBy("id").agg(
            F.sum(F.greatest(F.lit(0), F.col("e") - F.greatest("s", "reached"))).alias("covered"))
        whole = copies.select("id").union(copies.select("rep")).distinct().withColumn("whole", F.lit(True))
        rows = self.all.select("id", F.coalesce(F.length("text"), F.lit(0)).alias("n_chars")).dropDuplicates(["id"])
        rows = rows.join(whole, "id", "left").join(covered, "id", "left")
        return rows.select(F.col("id").alias("line_id"), "n_chars", F.when(F.col("whole"), F.col("n_chars")).otherwise(F.coalesce("covered", F.lit(0))).cast("bigint").alias("shared_chars"))


KEYED = "key bigint, id bigint, start int, is_block boolean"
REKEYED = "key bigint, key2 bigint, id bigint, start int, is_block boolean, block int, before int, after int"


def _within(members: DataFrame, group: str) -> DataFrame:
    """(id_a, id_b), id_a < id_b, of the members (``group``, id) of each group; the members of a group are dealt to SALTS tasks, each of which meets all."""
    a = members.select(group, F.col("id").alias("id_a"), F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int").alias("_salt"))
    b = members.select(group, F.col("id").alias("id_b"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    return a.join(b, [group, "_salt"]).where("id_a < id_b").select("id_a", "id_b")


def _hits(met: DataFrame) -> DataFrame:
    """(id_a, id_b, shifts): diagonals on which a block of the lesser id meets a window of the other."""
    keys = [c for c in ("key", "key2") if c in met.columns]
    block = met.where("is_block").select(*keys, F.col("id").alias("id_a"), F.col("start").alias("_a"))
    probe = met.select(*keys, F.col("id").alias("id_b"), F.col("start").alias("_b"))
    both = block.join(probe, keys).where("id_a < id_b")
    return both.groupBy("id_a", "id_b").agg(F.collect_set(F.col("_b") - F.col("_a")).alias("shifts"))


def _hashed(texts: list[str], size: int) -> tuple[np.ndarray, ...]:
    """(lengths, starts, code points) of the texts one after the other, and two hashes of every window of ``size``."""
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return lengths, np.cumsum(lengths) - lengths, codes, Rolling(codes).windows(size), Rolling(codes ^ np.uint32(0x2A5F31C7)).windows(size)


def _stretches(span: int):
    """Stretches of a text, from the ``places`` whose windows other classes have and the beginnings and ends of those (``firsts``, ``lasts``) where the code points beside vary."""

    def one(ids: list[int], texts: list[str], *marks: list) -> pd.DataFrame:
        lengths, starts, codes, windows, others = _hashed(texts, span)

        def flat(lists: list, ends) -> tuple[np.ndarray, np.ndarray]:
            text, values = np.repeat(np.arange(len(texts)), [len(x) for x in lists]), np.concatenate(lists).astype(np.int64)
            ok = ends(values) <= lengths[text]  # of rows that differ but have one id another may have come
            return starts[text[ok]], values[ok]

        offset, place = flat(marks[0], lambda v: v & 0xFFFFFFFF)
        depth, first, last = np.zeros(len(codes) + 1, dtype=np.int64), np.zeros(len(codes) + 1, dtype=bool), np.zeros(len(codes) + 1, dtype=bool)
        np.add.at(depth, offset + (place >> 32), 1)
        np.add.at(depth, offset + (place & 0xFFFFFFFF) - span + 1, -1)
        first[np.add(*flat(marks[1], lambda v: v + span))] = True
        last[np.add(*flat(marks[2], lambda v: v)) - span] = True
        at = np.flatnonzero(np.cumsum(depth) > 0)
        text = np.searchsorted(starts, at, side="right") - 1
        _, same = np.unique(_mix(_mix(windows[at], others[at]), text.astype(np.uint64)), return_inverse=True)
        first, last = (np.bincount(same, weights=x[at])[same] > 0 for x in (first, last))  # equal windows of a text are cut alike
        begin = np.flatnonzero(first | np.concatenate([[True], last[:-1] | (np.diff(at) > 1)])[: len(at)])
        n = np.diff(np.append(begin, len(at)))
        at, text = at[begin], text[begin]
        return pd.DataFrame({"key": windows[at].view(np.int64), "key2": others[at].view(np.int64), "id": np.array(ids, dtype=np.int64)[text], "start": (at - starts[text]).astype(np.int32),
                             "n_chars": (n + span - 1).astype(np.int32)})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in chunked(batch, "id", "text", "places", "firsts", "lasts"):
                yield one(*part)

    return run


def _rekeyed(sizes: Sizes, step: int):
    """Windows of ``span`` + 1 - ``step`` code points around the blocks of a text, ``step`` apart, by two hashes, with the code points beside them (-1 where the text ends).

    A span around a block has x code points before and at least span - block - x after it; the window that begins at the
    multiple of ``step`` just below x before the block lies inside the span, so no span is lost.
    """
    size = sizes.span + 1 - step
    before = np.arange(0, sizes.span - sizes.block + 1, step)

    def one(ids: list[int], texts: list[str], blocks: list) -> pd.DataFrame:
        lengths, starts, codes, windows, others = _hashed(texts, size)
        text = np.repeat(np.arange(len(texts)), [len(b) for b in blocks])
        block, is_block = np.array([x["block"] for b in blocks for x in b], dtype=np.int64), np.array([x["is_block"] for b in blocks for x in b], dtype=bool)
        start = (block[:, None] - before).ravel()
        text, block, is_block = (np.repeat(x, len(before)) for x in (text, block, is_block))
        ok = (start >= 0) & (start + size <= lengths[text])
        start, text = start[ok], text[ok]
        at, padded = starts[text] + start, np.append(codes, 0).astype(np.int32)
        return pd.DataFrame({"key": windows[at].view(np.int64), "key2": others[at].view(np.int64), "id": np.array(ids, dtype=np.int64)[text], "start": start.astype(np.int32),
                             "is_block": is_block[ok], "block": block[ok].astype(np.int32), "before": np.where(start > 0, padded[at - 1], -1).astype(np.int32),
                             "after": np.where(start + size < lengths[text], padded[at + size], -1).astype(np.int32)})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in chunked(batch, "id", "text", "blocks"):
                yield one(*part)

    return run


def chunked(batch: pd.DataFrame, *columns: str) -> Iterator[list[list]]:
    """Lists of the columns' values, cut where their second column, a text, adds up to CHUNK code points."""
    rows, size = [], 0
    for row in zip(*(batch[c] for c in columns)):
        rows.append(row)
        size += len(row[1])
        if size >= CHUNK:
            yield [list(c) for c in zip(*rows)]
            rows, size = [], 0
    if rows:
        yield [list(c) for c in zip(*rows)]


def _keyed(sizes: Sizes):
    """Anchor keys of lines, in chunks of about CHUNK code points."""

    def one(ids: list[int], texts: list[str]) -> pd.DataFrame:
        text, start, key, is_block = anchors(texts, sizes)
        return pd.DataFrame({"key": key, "id": np.array(ids, dtype=np.int64)[text], "start": start.astype(np.int32), "is_block": is_block})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in chunked(batch, "id", "text"):
                yield one(*part)

    return run


def _extended(span: int):
    """Maximal repeats on every diagonal that had a hit."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for id_a, id_b, shifts, text_a, text_b in zip(*(batch[c] for c in ("id_a", "id_b", "shifts", "text_a", "text_b"))):
                a, b = (np.frombuffer(t.encode("utf-32-le", "surrogatepass"), dtype=np.uint32) for t in (text_a, text_b))
                for shift in shifts:
                    out += [(id_a, id_b, start, start + int(shift), n) for start, n in common_runs(a, b, int(shift), span)]
            yield pd.DataFrame(out, columns=["id_a", "id_b", "start_a", "start_b", "n_chars"])

    return run
