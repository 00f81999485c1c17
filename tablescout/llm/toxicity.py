"""Toxicity by a weighted lexicon, matched with Aho-Corasick over folded texts."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablescout.llm.common import in_batches, query, remainder, table
from tablescout.llm.quality import training_sample

#: Bounds of the training sample by class, and of the lexicon.
SAMPLE_ROWS, ENTRIES = {0: 6_000, 1: 3_000}, 5_000
#: Letters of a stem; an entry is a stem at the start of a word, or a whole word.
STEM = range(4, 9)
#: Documents that an entry needs, of all toxic ones in the sample, and its least weight.
SUPPORT, LEAST_DOCS, LEAST_WEIGHT = 0.01, 4, 2.5
THRESHOLD, FOLDS, HELD_OUT = 0.3, 4, 2
#: Letters of other scripts that look like Latin ones, and digits and signs that stand for letters.
LOOKALIKES = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x",
    "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ɡ": "g", "ӏ": "l", "ѵ": "v", "ԝ": "w", "ո": "n", "ս": "u",
    "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i",
}
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
#: Phrases in which a match means no harm, folded.
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "trash collection", "clown fish", "class clown", "scum line", "pond scum")


def _folding() -> dict[int, str | None]:
    table_: dict[int, str | None] = {c: " " for c in range(128) if not chr(c).isalnum()}
    table_ |= {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
    # Full-width letters and digits stand as far from ASCII as each other.
    table_ |= {c + 0xFEE0: chr(c).lower() for c in range(0x21, 0x7F)}
    table_ |= {ord(k): v for k, v in LOOKALIKES.items()} | {ord(k.upper()): v for k, v in LOOKALIKES.items() if len(k.upper()) == 1}
    table_[ord("I")] = "i"
    table_ |= {ord(k): v for k, v in SUBSTITUTES.items()}
    table_ |= {c: None for c in (0x00AD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF)}
    table_ |= {c: " " for c in (0x00A0, 0x00AB, 0x00BB, 0x00B7, *range(0x2010, 0x2028), *range(0x2030, 0x205F), 0x3000)}
    return table_


FOLDED = str.maketrans(_folding())


def fold(text: str) -> str:
    """Lower case, look-alikes and substitutes as the letters they stand for, one space for other signs."""
    return f" {text.translate(FOLDED).lower()} "


def entries_of(words: set[str]) -> set[str]:
    """Entries that could stand for words: stems and whole words, with the boundary before and after."""
    return {f" {w[:n]}" for w in words for n in STEM if len(w) >= n} | {f" {w} " for w in words if len(w) > 2}


def lexicon(sample: DataFrame, entries: int = ENTRIES) -> dict[str, float]:
    """Weights of entries: the log odds of an entry's documents among toxic ones against others.

    Documents are counted per entry by Spark, first within batches; the entries that most toxic documents support,
    a bounded number, are collected. A longer entry stays beside a shorter one it starts with only if it says more.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: tuple[Counter, Counter] = (Counter(), Counter())
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts[label].update(entries_of(set(fold(text).split())))
            names = [*counts[1], *(e for e in counts[0] if e not in counts[1])]
            columns = [pa.array([c[e] for e in names], pa.int64()) for c in counts]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *columns], ["entry", "others", "toxic"])

    # Copies of one text would make all of its words telling.
    texts = sample.select("label", "text").distinct()
    sizes = {r["label"]: r["count"] for r in texts.groupBy("label").count().collect()}
    others, toxic = sizes.get(0, 0), sizes.get(1, 0)
    counted = texts.mapInArrow(in_batches(run), "entry string, others long, toxic long").groupBy("entry")
    counted = counted.agg(F.sum("others").alias("others"), F.sum("toxic").alias("toxic"))
    odds = F.log((F.col("toxic") + 0.5) / (toxic + 1.0)) - F.log((F.col("others") + 0.5) / (others + 1.0))
    chosen = counted.where(F.col("toxic") >= max(LEAST_DOCS, SUPPORT * toxic)).withColumn("weight", odds)
    chosen = chosen.where(F.col("weight") >= LEAST_WEIGHT).orderBy(F.desc("toxic"), "entry").limit(entries)
    kept: dict[str, float] = {}
    for entry, weight in sorted((r["entry"], r["weight"]) for r in chosen.collect()):
        shorter = max((kept[entry[:n]] for n in range(2, len(entry)) if entry[:n] in kept), default=-np.inf)
        if weight > shorter + 0.7:
            kept[entry] = weight
    return kept


class Matcher:
    """Sum of weights and number of words of texts."""

    def __init__(self, weights: dict[str, float], exceptions: tuple[str, ...] = EXCEPTIONS):
        self.automaton = ahocorasick.Automaton()
        for entry, weight in weights.items():
            self.automaton.add_word(entry, (len(entry), weight))
        for phrase in exceptions:
            self.automaton.add_word(f" {phrase}", (len(phrase) + 1, None))
        self.empty = not len(self.automaton)
        self.automaton.make_automaton()

    def __call__(self, text: str) -> tuple[float, int]:
        text = fold(text)
        at_start: dict[int, float] = {}
        excused: list[tuple[int, int]] = []
        if not self.empty:
            for end, (length, weight) in self.automaton.iter(text):
                start = end - length + 1
                if weight is None:
                    excused.append((start, end))
                else:
                    at_start[start] = max(weight, at_start.get(start, 0.0))
        for first, last in excused:
            for start in [s for s in at_start if first <= s < last]:
                del at_start[start]
        return sum(at_start.values()), len(text.split())


def measures(weight: np.ndarray, words: np.ndarray) -> np.ndarray:
    """What the score is made of: all weight, and weight for the length of the text."""
    return np.stack([np.ones(len(weight)), np.log1p(weight), np.sqrt(100 * weight / (words + 100.0))], axis=1)


def fit(x: np.ndarray, y: np.ndarray, share: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Logistic regression with a little shrinkage, by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (share * (p - y)) + 0.05 * w
        curve = (x * (share * p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(len(w))
        w = w - np.linalg.solve(curve, gradient)
    return w


def matched(rows: DataFrame, keep: list[str], weights: dict[str, float], finish=None) -> DataFrame:
    """Columns ``keep`` with the weight and words of ``text``, or with the score that ``finish`` makes of them."""
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(weights)
    kept = rows.select(*keep, F.coalesce("text", F.lit("")).alias("__text"))
    names = ["weight", "words"] if finish is None else ["score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(shared.value)
        for batch in batches:
            found = np.array([matcher(t) for t in batch.column(batch.num_columns - 1).to_pylist()], float).reshape(-1, 2)
            columns = [found[:, 0], found[:, 1]] if finish is None else [finish(found[:, 0], found[:, 1])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *map(pa.array, columns)], [*batch.schema.names[:-1], *names])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept.select(*keep).schema]
    return kept.mapInArrow(in_batches(run), ", ".join([*fields, *(f"{n} double" for n in names)]))


def toxicity_scores(docs: DataFrame, labels: DataFrame, keep: list[str], label: str = "toxic") -> DataFrame:
    """Columns ``keep`` of all ``docs`` with ``score``, the probability that the text is toxic.

    The lexicon and the two weights of the score are learned from labelled documents whose crc32 of the doc_id leaves
    a remainder other than 2 by 4: at most 3,000 toxic and 6,000 others, drawn by a hash. Entries are stems and words
    whose documents are far more often toxic. Texts are folded, matched in one pass whatever the number of entries,
    and scored by the weight of what they contain, as such and for their length; matches inside an exception phrase
    do not count. The text alone is scored.

    Null, empty and blank texts contain nothing and get the score of such texts. Without toxic labels nothing is
    learned and all scores are alike. Labels other than 0 and 1, and those without a document, are left out; repeated
    documents are scored each; columns not in ``keep`` are not read.
    """
    sample, numbers = training_sample(docs, labels, label, remainder("doc_id", FOLDS) != HELD_OUT, SAMPLE_ROWS)
    weights = lexicon(sample)
    found = matched(sample, ["doc_id", "label"], weights).toPandas().sort_values(["label", "doc_id"])
    y = found.label.to_numpy(float)
    here = {c: max(1, int((y == c).sum())) for c in (0, 1)}
    share = np.where(y == 1, numbers.get(1, 0) / here[1], numbers.get(0, 0) / here[0])
    w = fit(measures(found.weight.to_numpy(float), found.words.to_numpy(float)), y, share / max(1e-9, share.mean()) if len(share) else share)

    def finish(weight: np.ndarray, words: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(measures(weight, words) @ w, -500, 500)))

    return matched(docs, keep, weights, finish)


@query("op10_toxicity")
def op10_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    found = toxicity_scores(table(spark, folder, "documents"), table(spark, folder, "labels"), ["doc_id"])
    held_out = (remainder("doc_id", FOLDS) == HELD_OUT).alias("held_out")
    return found.select("doc_id", held_out, "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
