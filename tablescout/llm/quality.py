"""Quality classifier: supervised subword embeddings, averaged and trained by stochastic gradient descent."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablescout.llm.byte_words import Eights, flat, mixed, spans, split
from tablescout.llm.common import in_batches, query, remainder, settle, table

#: Bound of the training sample: labelled documents of each class.
SAMPLE_ROWS = 1_200
#: Hash buckets (as bits), numbers in a vector, passes over the sample and first step of the descent.
BUCKET_BITS, VECTOR, EPOCHS, STEP = 17, 16, 12, 4.0
THRESHOLD, FOLDS = 0.3, 5
IN_WORD = np.ones(256, bool)
IN_WORD[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
SHIFT = np.uint64(64 - BUCKET_BITS)
#: Odd factors that spread byte runs of three and four, words, and pairs of words.
FACTORS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def features(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Families of hashed features of texts: the buckets of all, and where those of each text start and end.

    Runs of three and of four bytes, words with their punctuation, and neighbouring words by the difference of their
    hashes, by which a word that repeats itself is one feature whatever the word is.
    """
    eights = Eights(data)
    for n, factor in ((3, FACTORS[0]), (4, FACTORS[1])):
        grams = eights.view[: len(data)] & np.uint64((1 << 8 * n) - 1)
        yield (grams * factor) >> SHIFT, offsets[:-1], np.maximum(offsets[1:] - n + 1, offsets[:-1])
    starts, ends = spans(IN_WORD[data], offsets)
    lengths = ends - starts
    words = mixed(eights.head(starts, lengths), eights.tail(ends, lengths), lengths)
    first = np.searchsorted(starts, offsets)
    yield (words * FACTORS[2]) >> SHIFT, first[:-1], first[1:]
    pairs = np.append(words[1:] - words[:-1], np.uint64(1)) if len(words) else words
    yield (pairs * FACTORS[3]) >> SHIFT, first[:-1], np.maximum(first[1:] - 1, first[:-1])


def counted(data: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct buckets of each text with their share of its features."""
    families = list(features(data, offsets))
    out = []
    for i in range(len(offsets) - 1):
        buckets, counts = np.unique(np.concatenate([b[lo[i] : hi[i]] for b, lo, hi in families]), return_counts=True)
        out.append((buckets.astype("<i4"), (counts / max(1, counts.sum())).astype("<f4")))
    return out


def scores(data: np.ndarray, offsets: np.ndarray, worth: np.ndarray) -> np.ndarray:
    """Mean worth of the features of each text; 0 without features."""
    total, number = np.zeros(len(offsets) - 1), np.zeros(len(offsets) - 1, np.int64)
    for buckets, low, high in features(data, offsets):
        sums = np.zeros(len(buckets) + 1)
        np.cumsum(worth[buckets], out=sums[1:])
        total += sums[high] - sums[low]
        number += high - low
    return total / np.maximum(number, 1)


def train(rows: list[tuple[int, np.ndarray, np.ndarray]], seed: int = 7) -> np.ndarray:
    """Worth of each bucket for label 1 against 0, from (label, buckets, shares) by gradient descent.

    A text is the mean of its features' vectors; a softmax layer turns it into two probabilities. As the mean and the
    layer are both linear, a bucket's vector times the layer is all that scoring needs.
    """
    draw = np.random.default_rng(seed)
    vectors = draw.uniform(-1 / VECTOR, 1 / VECTOR, (1 << BUCKET_BITS, VECTOR)).astype(np.float32)
    layer = draw.uniform(-1 / VECTOR, 1 / VECTOR, (VECTOR, 2)).astype(np.float32)
    steps, done = EPOCHS * len(rows), 0
    for _ in range(EPOCHS):
        for i in draw.permutation(len(rows)):
            label, buckets, shares = rows[i]
            step = STEP * (1 - done / steps)
            done += 1
            mean = shares @ vectors[buckets]
            logits = mean @ layer
            error = np.exp(logits - logits.max())
            error /= error.sum()
            error[label] -= 1
            back = layer @ error
            layer -= step * 0.1 * np.outer(mean, error)
            vectors[buckets] -= step * np.outer(shares, back)
    return vectors @ (layer[:, 1] - layer[:, 0])


def training_sample(docs: DataFrame, labels: DataFrame, label: str, learn, most: int | dict) -> tuple[DataFrame, dict[int, int]]:
    """Labelled texts to learn from, at most ``most`` of each class in the order of a hash, and all labels by class."""
    usable = labels.where(learn & F.col(label).isin(0, 1)).select("doc_id", F.col(label).cast("int").alias("label"))
    usable = settle(usable.distinct())
    numbers = {r["label"]: r["count"] for r in usable.groupBy("label").count().collect()}
    bound = most if isinstance(most, dict) else {0: most, 1: most}
    parts = [
        usable.where(F.col("label") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound[c]) for c in (0, 1)
    ]
    chosen = F.broadcast(parts[0].union(parts[1]))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(chosen, "doc_id")
    return settle(rows.groupBy("doc_id", "label").agg(F.min("text").alias("text"))), numbers


def learn_worth(docs: DataFrame, labels: DataFrame, label: str, learn, sample_rows: int = SAMPLE_ROWS) -> tuple[np.ndarray, float]:
    """Worth of the buckets and the log odds of the classes among all labels less those in the sample."""
    sample, numbers = training_sample(docs, labels, label, learn, sample_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in split(whole, 2):
                vectors = counted(*flat(batch.column(2)))
                columns = [pa.array([v[i].tobytes() for v in vectors], pa.binary()) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["doc_id", "label", "buckets", "shares"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    columns = sample.select("doc_id", "label", F.col("text").cast("binary"))
    found = columns.mapInArrow(in_batches(run), f"doc_id {kind}, label int, buckets binary, shares binary").toPandas()
    found = found.sort_values(["label", "doc_id"])
    rows = [
        (int(y), np.frombuffer(b, "<i4"), np.frombuffer(s, "<f4")) for y, b, s in zip(found.label, found.buckets, found.shares)
    ]
    here = [sum(1 for r in rows if r[0] == c) for c in (0, 1)]
    odds = np.log((numbers.get(1, 0) + 1) / (numbers.get(0, 0) + 1)) - np.log((here[1] + 1) / (here[0] + 1))
    return (train(rows) if rows else np.zeros(1 << BUCKET_BITS)).astype(np.float32), float(odds)


def quality_scores(docs: DataFrame, labels: DataFrame, keep: list[str], label: str = "quality", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Columns ``keep`` of all ``docs`` with ``score``, the probability that the text is of quality.

    The model learns from labelled documents whose crc32 of the doc_id is not divisible by 5, at most ``sample_rows``
    of each class, drawn by a hash; the classes' sizes among all those labels set its odds. The sample's features are
    counted by Spark, the descent runs in numpy on the driver, and one number for each of 131,072 buckets goes to the
    tasks, which score whole texts where they are read. The text alone is scored; labels, sources and identifiers are
    no inputs.

    Null, empty and blank texts have no or few features and get the odds of the classes. Without labels of both
    classes the score says no more than that. Labels other than 0 and 1, and those without a document, are left out;
    a document labelled both ways counts for both; repeated documents are scored each. Columns not in ``keep`` are
    not read, whatever their names.
    """
    worth, odds = learn_worth(docs, labels, label, remainder("doc_id", FOLDS) != 0, sample_rows)
    shared = docs.sparkSession.sparkContext.broadcast(worth)
    kept = docs.select(*keep, F.coalesce("text", F.lit("")).cast("binary").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in split(whole, whole.num_columns - 1):
                logit = scores(*flat(batch.column(batch.num_columns - 1)), shared.value) + odds
                score = pa.array(1 / (1 + np.exp(-np.clip(logit, -500, 500))))
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], score], [*batch.schema.names[:-1], "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.select(*keep).schema)
    return kept.mapInArrow(in_batches(run), f"{schema}, score double" if schema else "score double")


def good_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of ``docs`` that the classifier does not reject."""
    names = list(docs.columns)
    inner = docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)), "doc_id", "text")
    found = quality_scores(inner, labels, [f"c{i}" for i in range(len(names))])
    return found.where(F.col("score") >= THRESHOLD).select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(names)))


@query("op4_quality")
def op4_quality(spark: SparkSession, folder: str) -> DataFrame:
    found = quality_scores(table(spark, folder, "documents"), table(spark, folder, "labels"), ["doc_id"])
    held_out = (remainder("doc_id", FOLDS) == 0).alias("held_out")
    return found.select("doc_id", held_out, "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
