"""Subject areas of documents (problem 8).

Complement naive Bayes over sentences.  A word's weight for a subject is the log of how much rarer it is outside the subject than in all text (``complement``), or
that and how much more frequent it is inside (``odds``); shrunk towards no weight for rare words and taken within the word's own script, so that a
subject written about mostly in one language doesn't claim that language's function words.

1. Documents are read once into hashed word features per sentence and written.
2. First weights: word counts of the labelled documents, split over the labels a document has.
3. Expectation-maximization over all documents: a sentence's posterior under the weights and under the mixture of its own
   document is its share in the counts of the next round.  Labels of a document hold softly, as some are mistakes.
4. A document's subjects are those of at least a quarter of its sentences with specialist matter.  For each subject on its
   own, the share is calibrated to the posterior that annotators give the label, on labelled documents under weights learned without their labels:
   documents are dealt to ``FOLDS`` by the hash of their id, and each fold is judged by a model to which its labels were hidden.

Only the counts of the fixed feature space reach the driver: at most FEATURES rows, whatever the corpus.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waraq.shared import written

#: Size of the feature space; its lower half holds words of Latin script, its upper half all others.
FEATURES = 1 << 19
ROUNDS = 2
#: Pseudo-count that shrinks the odds of a word.
SHRINK = 4.0
#: Words whose best log odds are below this say nothing.
LEAST_WEIGHT = 0.7
#: Log charge on a sentence of a labelled document for a subject the document isn't labelled with.
OFF_LABEL = -3.0
#: Pseudo-sentences of each subject in the mixture of a document.
MIXTURE_PRIOR = 0.3
#: A document has a subject from this share of its specialist sentences.
LEAST_SHARE = 0.25
GENERAL = "general"
CALIBRATION_BINS = 16
#: Labels are broadcast up to so many labelled documents, else joined by shuffle.
BROADCAST_ROWS = 250_000
FOLDS = 2
FORM = "odds"
CHUNK_WORDS = 1 << 18
CACHE_WORDS = 400_000

_PIECE = re.compile(r"[^\W\d_]+|[.؛;!?؟\n،]+|,(?=\s+[A-ZÀ-ÖØ-ÞĀĪŪḌḤṢṬẒ])")
_DIRT = re.compile("[ً-ٰٟـ­​-‏‪-‮⁠-⁩﻿]")
_NEEDS_CLEANING = re.compile("[ً-ٰٟـ­​-‏‪-‮⁠-⁩ﭐ-﻿！-￯̀-ͯ]")
_SAME = str.maketrans("یکەۀ", "يكهه")


def clean(text: str) -> str:
    """Text without vowel signs, stretching and shapeless characters, compatibility forms resolved."""
    return _DIRT.sub("", unicodedata.normalize("NFKC", text)) if _NEEDS_CLEANING.search(text) else text


def stem(word: str) -> str:
    """Lower case, one form of yeh, kaf and heh; a plural s of Latin words is dropped."""
    word = word.lower().translate(_SAME)
    return word[:-1] if len(word) > 3 and word[-1] == "s" and word[-2] != "s" else word


def feature(word: str) -> int:
    """Feature of a stemmed word."""
    half = FEATURES // 2
    return zlib.crc32(word.encode("utf-8", "replace")) % half + (0 if word[0] < "ɐ" or "Ḁ" <= word[0] <= "ỿ" else half)


class Reader(dict):
    """Features of pieces of text; a boundary between sentences is -1."""

    def __missing__(self, piece: str) -> int:
        value = feature(stem(piece)) if piece[0].isalpha() else -1
        if len(piece) <= 64:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[piece] = value
        return value

    def sentences(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """(features of all words, words per sentence); sentences without words don't count."""
        found = np.array([self[p] for p in _PIECE.findall(clean(text))] if text else [], dtype=np.int32)
        ends = np.flatnonzero(found == -1)
        sizes = np.diff(np.concatenate([[-1], ends, [len(found)]])) - 1
        return found[found >= 0], sizes[sizes > 0].astype(np.int32)


def _encoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    reader = Reader()
    for batch in batches:
        both = [reader.sentences(t) for t in batch["text"]]
        yield pd.DataFrame({"doc_id": batch["doc_id"], "words": [w.tobytes() for w, _ in both], "sizes": [s.tobytes() for _, s in both]})


class Weights:
    """Log odds of features for subjects; sparse, as only features met have any."""

    def __init__(self, features: np.ndarray, counts: np.ndarray, form: str = FORM):
        n_subjects = counts.shape[1]
        self.index = np.zeros(FEATURES, dtype=np.int32)
        self.index[features] = np.arange(1, len(features) + 1)
        self.values = np.zeros((len(features) + 1, n_subjects), dtype=np.float32)
        for of_script in (features < FEATURES // 2, features >= FEATURES // 2):
            n = counts[of_script]
            if not n.sum():
                continue
            prior = np.clip(n.sum(axis=0) / n.sum(), 1e-4, 1 - 1e-4)
            p = np.clip((n + SHRINK * prior) / (n.sum(axis=1, keepdims=True) + SHRINK), 1e-9, 1 - 1e-9)
            w = np.log(1 - prior) - np.log(1 - p)
            if form == "odds":
                w += np.log(p) - np.log(prior)
            w[w.max(axis=1) < LEAST_WEIGHT] = 0
            self.values[1:][of_script] = w

    def __reduce__(self):
        at = np.flatnonzero(self.index)
        return _weights, (at.astype(np.int32), self.index[at], self.values)

    def scores(self, words: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Sum of weights of each sentence."""
        return np.add.reduceat(self.values[self.index[words]], starts, axis=0) if len(starts) else np.zeros((0, self.values.shape[1]), dtype=np.float32)


def _weights(features: np.ndarray, rows: np.ndarray, values: np.ndarray) -> Weights:
    out = Weights.__new__(Weights)
    out.index = np.zeros(FEATURES, dtype=np.int32)
    out.index[features] = rows
    out.values = values
    return out


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _chunks(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
    """(rows, words, sentence starts, words per sentence, document of each sentence) of about CHUNK_WORDS words."""
    for batch in batches:
        rows, words, sizes, n = [], [], [], 0
        for row in batch.itertuples(index=False):
            w, s = np.frombuffer(row.words, dtype=np.int32), np.frombuffer(row.sizes, dtype=np.int32)
            rows.append(row)
            words.append(w)
            sizes.append(s)
            n += len(w)
            if n >= CHUNK_WORDS:
                yield _joined(rows, words, sizes)
                rows, words, sizes, n = [], [], [], 0
        if rows:
            yield _joined(rows, words, sizes)


def _joined(rows: list, words: list, sizes: list) -> tuple:
    lengths = np.concatenate(sizes)
    return rows, np.concatenate(words), np.cumsum(lengths) - lengths, lengths, np.repeat(np.arange(len(rows)), [len(s) for s in sizes])


def _posteriors(weights: Weights, general: int, words, starts, document, n_docs: int, allowed: np.ndarray | None = None) -> np.ndarray:
    """Posterior of each sentence, under its own words and the mixture of its document; one whose words say nothing is general."""
    scores = weights.scores(words, starts)
    if not len(scores):
        return scores
    silent, only_general = ~scores.any(axis=1), np.eye(scores.shape[1])[general]
    first = _softmax(scores)
    first[silent] = only_general
    mixture = np.full((n_docs, scores.shape[1]), MIXTURE_PRIOR)
    for k in range(scores.shape[1]):
        mixture[:, k] += np.bincount(document, weights=first[:, k], minlength=n_docs)
    scores = scores + np.log(mixture / mixture.sum(axis=1, keepdims=True))[document]
    out = _softmax(scores if allowed is None else scores + np.where(allowed, 0.0, OFF_LABEL)[document])
    out[silent] = only_general
    return out


class _Counts:
    """Word counts per subject of one task, over the features it meets."""

    def __init__(self, n_subjects: int):
        self.place = np.full(FEATURES, -1, dtype=np.int32)
        self.features = np.zeros(0, dtype=np.int32)
        self.values = np.zeros((0, n_subjects))

    def add(self, words: np.ndarray, of_word: np.ndarray, share: np.ndarray) -> None:
        """Count each word with the shares of row ``of_word`` of ``share``."""
        if not len(words):
            return
        new = np.unique(words[self.place[words] < 0])
        if len(new):
            self.place[new] = np.arange(len(self.features), len(self.features) + len(new))
            self.features = np.concatenate([self.features, new])
            self.values = np.concatenate([self.values, np.zeros((len(new), self.values.shape[1]))])
        at = self.place[words]
        for k in range(self.values.shape[1]):
            self.values[:, k] += np.bincount(at, weights=share[of_word, k], minlength=len(self.features))

    def frame(self) -> pd.DataFrame:
        return pd.DataFrame({"feature": self.features, **{f"c{k}": self.values[:, k] for k in range(self.values.shape[1])}})


def _marked(rows: list, n: int) -> np.ndarray:
    """Labels of documents as rows of flags."""
    out = np.zeros((len(rows), n), dtype=bool)
    for k, r in enumerate(rows):
        out[k, np.asarray(r.labels, dtype=np.int64)] = True
    return out


class SubjectModel:
    """Subjects of documents, learned from labels of some of them.

    ``subjects`` lists the codes; ``labels`` holds (doc_id, subject), where case and blanks of the code don't matter,
    repeats count once and unknown or null codes, null doc_ids and ids of no document are left out.  A null or empty text, or one without
    any specialist sentence, has the one subject ``general``; so has every document where there are no labels.  Texts are read
    whole.  Rows with equal doc_id are classified each for itself.  An empty table gives an empty result; other columns are ignored.
    """

    def __init__(self, documents: DataFrame, labels: DataFrame, subjects: DataFrame, rounds: int = ROUNDS, form: str = FORM):
        self.spark = documents.sparkSession
        codes = sorted({r["subject"] for r in subjects.select("subject").distinct().collect() if r["subject"]} | {GENERAL})  # the table of codes, a dozen rows
        self.codes, self.general = codes, codes.index(GENERAL)
        self.rounds, self.form = rounds, form
        self._held_out = None
        self.read = self._encode(documents, labels)
        self.weights = self._train()

    def _encode(self, documents: DataFrame, labels: DataFrame) -> DataFrame:
        code = F.create_map(*[x for k, c in enumerate(self.codes) for x in (F.lit(c), F.lit(k))])[F.lower(F.trim("subject"))]
        marks = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), code.alias("code")).where("doc_id IS NOT NULL AND code IS NOT NULL").groupBy("doc_id").agg(F.collect_set("code").alias("labels"))  # at most one a code
        marks = written(marks, "subject-labels")
        encoded = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInPandas(_encoded, "doc_id bigint, words binary, sizes binary")
        small = marks.count() <= BROADCAST_ROWS
        joined = encoded.join(F.broadcast(marks) if small else marks, "doc_id", "left")
        return written(joined.select("doc_id", "words", "sizes", F.coalesce("labels", F.array().cast("array<int>")).alias("labels"), F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).cast("int").alias("fold")), "subject-features")

    def _counted(self, df: DataFrame, weights: Weights | None) -> Weights:
        """Weights from the counts under the labels (no weights) or under the posteriors."""
        n, general = len(self.codes), self.general

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            counts = _Counts(n)
            for rows, words, starts, lengths, document in _chunks(batches):
                marked = _marked(rows, n)
                if weights is None:
                    share = marked / np.maximum(1, marked.sum(axis=1, keepdims=True))
                    counts.add(words, np.repeat(document, lengths), share)
                else:
                    allowed = marked | ~marked.any(axis=1, keepdims=True)
                    allowed[:, general] = True
                    share = _posteriors(weights, general, words, starts, document, len(rows), allowed)
                    counts.add(words, np.repeat(np.arange(len(lengths)), lengths), share)
            yield counts.frame()

        columns = [f"c{k}" for k in range(n)]
        partial = df.mapInPandas(run, "feature int, " + ", ".join(f"{c} double" for c in columns))
        rows = partial.groupBy("feature").agg(*[F.sum(c).alias(c) for c in columns]).orderBy("feature").toPandas()
        return Weights(rows["feature"].to_numpy(dtype=np.int64), rows[columns].to_numpy(dtype=np.float64), self.form)

    def _train(self, hidden: int | None = None) -> Weights:
        """Weights after expectation-maximization over all documents, the labels of fold ``hidden`` kept back."""
        read = self.read if hidden is None else self.read.withColumn("labels", F.when(F.col("fold") != hidden, F.col("labels")).otherwise(F.array().cast("array<int>")))
        weights = self._counted(read.where(F.size("labels") > 0), None)
        for _ in range(self.rounds):
            weights = self._counted(read, weights)
        return weights

    def sentence_counts(self, read: DataFrame | None = None, weights: Weights | None = None) -> DataFrame:
        """(doc_id, labels, s0, s1, ...): sentences of each document per subject, in the order of ``codes``."""
        n, weights, general = len(self.codes), weights or self.weights, self.general
        columns = [f"s{k}" for k in range(n)]

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for rows, words, starts, _, document in _chunks(batches):
                best = _posteriors(weights, general, words, starts, document, len(rows)).argmax(axis=1) if len(starts) else np.zeros(0, dtype=np.int64)
                table = np.bincount(document * n + best, minlength=len(rows) * n).reshape(len(rows), n)
                yield pd.DataFrame({"doc_id": pd.array([r.doc_id for r in rows], dtype="Int64"), "labels": [r.labels for r in rows], **{c: table[:, k] for k, c in enumerate(columns)}})

        return (self.read if read is None else read).mapInPandas(run, "doc_id bigint, labels array<int>, " + ", ".join(f"{c} int" for c in columns))

    def held_out_counts(self) -> DataFrame:
        """``sentence_counts`` of the labelled documents, each under the weights learned without the labels of its fold."""
        if self._held_out is None:
            parts = [self.sentence_counts(self.read.where((F.size("labels") > 0) & (F.col("fold") == k)), self._train(k)) for k in range(FOLDS)]
            self._held_out = written(reduce(DataFrame.unionByName, parts), "subject-held-out")
        return self._held_out

    def _shares(self, counts: DataFrame) -> DataFrame:
        """(doc_id, labels, subject, has, share) of every document and code; general has share 1 where no sentence is specialist, else 0."""
        counts = counts.withColumn("n", sum((F.col(f"s{k}") for k in range(len(self.codes)) if k != self.general), F.lit(0)))
        share = lambda k: F.when(F.col("n") > 0, F.col(f"s{k}") / F.col("n")).otherwise(0.0) if k != self.general else (F.col("n") == 0).cast("double")
        each = F.array(*[F.struct(F.lit(c).alias("subject"), F.array_contains("labels", k).alias("has"), share(k).alias("share")) for k, c in enumerate(self.codes)])
        return counts.select("doc_id", F.explode(each).alias("x")).select("doc_id", "x.*")

    def agreement(self) -> DataFrame:
        """(subject, n_labelled, n_found, n_both): hand labels of the labelled documents, and what is found there without knowing them."""
        found = F.col("share") >= LEAST_SHARE
        return self._shares(self.held_out_counts()).groupBy("subject").agg(F.count_if("has").alias("n_labelled"), F.count_if(found).alias("n_found"), F.count_if(F.col("has") & found).alias("n_both"))

    def shares(self) -> DataFrame:
        """(doc_id, labels, subject, n_sentences, n_specialist) of every document and specialist subject with any sentence, and (general, 0, 0) of those without."""
        special = [k for k in range(len(self.codes)) if k != self.general]
        counts = self.sentence_counts().withColumn("n_specialist", sum((F.col(f"s{k}") for k in special), F.lit(0)))
        pairs = F.array(*[F.struct(F.lit(self.codes[k]).alias("subject"), F.col(f"s{k}").alias("n_sentences")) for k in special])
        some = F.filter(pairs, lambda p: p["n_sentences"] > 0)
        none = F.array(F.struct(F.lit(GENERAL).alias("subject"), F.lit(0).alias("n_sentences")))
        return counts.select("doc_id", "labels", "n_specialist", F.explode(F.when(F.col("n_specialist") > 0, some).otherwise(none)).alias("p")).select("doc_id", "labels", "p.*", "n_specialist")

    def found(self) -> DataFrame:
        """(doc_id, subject): the subjects of every document."""
        rows = self.shares()
        return rows.where((F.col("n_specialist") == 0) | (F.col("n_sentences") >= LEAST_SHARE * F.col("n_specialist"))).select("doc_id", "subject").distinct()

    def calibration(self) -> dict[str, list[float]]:
        """Of each subject, the posterior of its label per bin of its share, rising with the share.

        Bin 0 is a share of 0.  From counts per bin over all labelled documents as ``held_out_counts`` has them, smoothed and made monotone by pooling.
        """
        rows = self._shares(self.held_out_counts()).groupBy("subject", F.ceil(F.col("share") * CALIBRATION_BINS).alias("bin")).agg(
            F.count("*").alias("n"), F.sum(F.col("has").cast("int")).alias("has")).collect()  # subjects x bins
        out = {}
        for code in self.codes:
            n, has = np.zeros(CALIBRATION_BINS + 1), np.zeros(CALIBRATION_BINS + 1)
            for r in rows:
                if r["subject"] == code:
                    n[r["bin"]], has[r["bin"]] = r["n"], r["has"]
            out[code] = monotone(has + 0.5 * (np.arange(CALIBRATION_BINS + 1) / CALIBRATION_BINS), n + 0.5)
        return out

    def all_posteriors(self) -> DataFrame:
        """``posteriors`` of every document and every code, general and shares of 0 included."""
        return self._calibrated(self._shares(self.sentence_counts()).select("doc_id", "subject", "share"))

    def posteriors(self) -> DataFrame:
        """(doc_id, subject, share_permille, posterior_permille) of every document and subject with a sentence."""
        share = F.when(F.col("n_specialist") > 0, F.col("n_sentences") / F.col("n_specialist")).otherwise(1.0)
        return self._calibrated(self.shares().withColumn("share", share))

    def _calibrated(self, rows: DataFrame) -> DataFrame:
        curves = self.calibration()
        curve = F.create_map(*[x for c, values in curves.items() for x in (F.lit(c), F.array(*[F.lit(v) for v in values]))])[F.col("subject")]
        return rows.select(
            "doc_id", "subject", F.round(F.col("share") * 1000).cast("int").alias("share_permille"),
            F.round(F.element_at(curve, F.ceil(F.col("share") * CALIBRATION_BINS).cast("int") + 1) * 1000).cast("int").alias("posterior_permille"))

    def composition(self) -> DataFrame:
        """(subject, n_documents, document_permille) of the corpus; a document with several subjects counts for each."""
        counted = self.found().groupBy("subject").agg(F.count("*").alias("n_documents"))
        return counted.withColumn("document_permille", F.round(1000 * F.try_divide(F.col("n_documents"), F.lit(self.read.count()))).cast("int"))


def monotone(successes: np.ndarray, trials: np.ndarray) -> list[float]:
    """Rates that never fall, by pooling adjacent violators."""
    pools: list[list[float]] = []
    for s, t in zip(successes, trials):
        pools.append([float(s), float(t), 1])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] > pools[-1][0] * pools[-2][1]:
            s2, t2, k2 = pools.pop()
            pools[-1] = [pools[-1][0] + s2, pools[-1][1] + t2, pools[-1][2] + k2]
    return [s / t for s, t, k in pools for _ in range(int(k))]
