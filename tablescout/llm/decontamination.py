"""Benchmark decontamination with an FM-index for each training shard."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablescout.llm.byte_words import Eights, flat, mixed, spans, split
from tablescout.llm.common import in_batches, query, settle, table
from tablescout.llm.fm_index import FMIndex

#: Words in a window of a benchmark item.
WINDOW_WORDS = 10
#: Words of a shard, and bytes of benchmark text that one pass over the documents searches for.
SHARD_WORDS, SLICE_BYTES = 3_000_000, 16_000_000
#: A word is a run of characters outside these ranges, after A-Z are lower-cased.
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IN_WORD = np.ones(256, bool)
IN_WORD[:0x30] = IN_WORD[0x3A:0x61] = IN_WORD[0x7B:0x80] = False
#: Slots of the table that most words outside the benchmark fail.
SLOT_BITS = 22

RESULT = "n_words long, spans array<struct<first:long,last:long>>, items array<string>"


def words_of(text: str | None) -> list[str]:
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


@dataclass
class Phrases:
    """Distinct windows of benchmark items as rows of word numbers, and which items have them."""

    words: list[bytes]
    rows: np.ndarray
    lengths: np.ndarray
    items: list[list[str]]

    @classmethod
    def of(cls, items: list[tuple[str, str | None]]) -> Phrases:
        numbers: dict[str, int] = {}
        windows: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            found = words_of(text)
            # 0 ends the text and 1 stands for all words outside the benchmark.
            ids = [numbers.setdefault(w, len(numbers) + 2) for w in found]
            for at in range(max(1, len(ids) - WINDOW_WORDS + 1) if ids else 0):
                windows.setdefault(tuple(ids[at : at + WINDOW_WORDS]), set()).add(item)
        rows = np.zeros((len(windows), WINDOW_WORDS), np.int64)
        for i, w in enumerate(windows):
            rows[i, WINDOW_WORDS - len(w) :] = w
        lengths = np.array([len(w) for w in windows], np.int64)
        return cls([w.encode() for w in numbers], rows, lengths, [sorted(x) for x in windows.values()])


class Vocabulary:
    """Numbers of the benchmark's words for many words at once."""

    def __init__(self, words: list[bytes]):
        data = np.frombuffer(b"".join(words), np.uint8)
        self.lengths = np.array([len(w) for w in words], np.int64)
        ends = np.cumsum(self.lengths)
        eights = Eights(data)
        self.head, self.tail = eights.head(ends - self.lengths, self.lengths), eights.tail(ends, self.lengths)
        keys = mixed(self.head, self.tail, self.lengths)
        self.order = np.argsort(keys)
        self.keys, self.words = keys[self.order], words
        self.slots = np.zeros(1 << SLOT_BITS, bool)
        self.slots[keys >> np.uint64(64 - SLOT_BITS)] = True

    def numbers(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Number of each word from 2 on, or 1. Up to 16 bytes head, tail and length are the word; longer ones are
        compared byte by byte."""
        eights, lengths = Eights(data), ends - starts
        head, tail = eights.head(starts, lengths), eights.tail(ends, lengths)
        keys = mixed(head, tail, lengths)
        out = np.ones(len(starts), np.int64)
        maybe = np.flatnonzero(self.slots[keys >> np.uint64(64 - SLOT_BITS)])
        low = np.searchsorted(self.keys, keys[maybe])
        # Words with one key stand together, and there is hardly ever a second; the loop looks at each in turn.
        while len(maybe):
            inside = low < len(self.keys)
            maybe, low = maybe[inside], low[inside]
            same = self.keys[low] == keys[maybe]
            maybe, low = maybe[same], low[same]
            word = self.order[low]
            equal = (self.head[word] == head[maybe]) & (self.tail[word] == tail[maybe]) & (self.lengths[word] == lengths[maybe])
            for i in np.flatnonzero(equal & (lengths[maybe] > 16)):
                at = maybe[i]
                equal[i] = data[starts[at] : ends[at]].tobytes() == self.words[word[i]]
            out[maybe[equal]] = word[equal] + 2
            maybe, low = maybe[~equal], low[~equal] + 1
        return out


class Shard:
    """Documents whose words are searched together."""

    def __init__(self, phrases: Phrases, vocabulary: Vocabulary):
        self.phrases, self.vocabulary = phrases, vocabulary
        self.shortest = int(phrases.lengths.min()) if len(phrases.lengths) else 0
        self.batches: list[pa.RecordBatch] = []
        self.counts: list[np.ndarray] = []
        self.symbols: list[np.ndarray] = []
        self.places: list[np.ndarray] = []
        self.n_words = 0

    def add(self, batch: pa.RecordBatch, texts: pa.Array) -> None:
        data, offsets = flat(texts)
        data = LOWER[data]
        starts, ends = spans(IN_WORD[data], offsets)
        first = np.searchsorted(starts, offsets)
        self.batches.append(batch)
        self.counts.append(np.diff(first))
        if self.shortest and len(starts):
            numbers = self.vocabulary.numbers(data, starts, ends)
            # Stretches of benchmark words inside a document; shorter ones than any window hold none.
            begin, end = spans(numbers > 1, first)
            long = end - begin >= self.shortest
            begin, sizes = begin[long], (end - begin)[long]
            # Each stretch is followed by a 1, at the place of no word.
            at = np.repeat(begin - np.concatenate([[0], np.cumsum(sizes + 1)[:-1]]), sizes + 1) + np.arange(np.sum(sizes + 1))
            stop = np.cumsum(sizes + 1) - 1
            at[stop] = begin
            symbols = numbers[at]
            symbols[stop] = 1
            self.symbols.append(symbols)
            self.places.append(at + self.n_words)
        self.n_words += len(starts)

    def results(self) -> Iterator[tuple[pa.RecordBatch, np.ndarray, list, list]]:
        """Each batch with words, merged spans and items of its documents."""
        ends = np.cumsum(np.concatenate(self.counts)) if self.counts else np.zeros(0, np.int64)
        begins = np.concatenate([[0], ends])
        hit = np.zeros(self.n_words + 1, np.int64)
        found: dict[int, set[str]] = {}
        text = np.concatenate(self.symbols) if self.symbols else np.zeros(0, np.int64)
        if len(text):
            place, p = np.concatenate(self.places), self.phrases
            index = FMIndex(text, len(p.words) + 2)
            low, high = index.search(p.rows, p.lengths)
            times = high - low
            which = np.repeat(np.arange(len(times)), times)
            rows = np.arange(len(which)) + np.repeat(low - np.concatenate([[0], np.cumsum(times)[:-1]]), times)
            at = place[index.locate(rows)]
            np.add.at(hit, at, 1)
            np.add.at(hit, at + p.lengths[which], -1)
            doc = np.searchsorted(begins, at, side="right") - 1
            for pair in np.unique(doc * len(times) + which).tolist():
                found.setdefault(pair // len(times), set()).update(p.items[pair % len(times)])
        first, last = spans(np.cumsum(hit)[:-1] > 0, begins)
        of = np.searchsorted(begins, first, side="right") - 1
        merged: dict[int, list] = {}
        for doc, a, b in zip(of.tolist(), first.tolist(), last.tolist()):
            merged.setdefault(doc, []).append({"first": a - int(begins[doc]), "last": b - int(begins[doc])})
        at = 0
        for batch, counts in zip(self.batches, self.counts):
            docs = range(at, at + len(counts))
            yield batch, counts, [merged.get(d, []) for d in docs], [sorted(found.get(d, ())) for d in docs]
            at += len(counts)


def search(docs: DataFrame, items: list[tuple[str, str | None]], keep: list[str]) -> DataFrame:
    """Columns ``keep`` of ``docs``, whose text is the column ``text``, with n_words, spans and items."""
    phrases = docs.sparkSession.sparkContext.broadcast(Phrases.of(items))
    kept = docs.select(*keep, F.col("text").cast("binary").alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.select(*keep).schema)
    result = pa.struct(
        [("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))), ("items", pa.list_(pa.string()))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(phrases.value.words) if phrases.value.words else None

        def out(shard: Shard) -> Iterator[pa.RecordBatch]:
            for batch, counts, merged, found in shard.results():
                columns = [batch.column(i) for i in range(batch.num_columns - 1)]
                columns += [pa.array(x, field.type) for x, field in zip((counts, merged, found), result)]
                yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-1], *(f.name for f in result)])

        shard = Shard(phrases.value, vocabulary)
        for whole in batches:
            for batch in split(whole, whole.num_columns - 1):
                shard.add(batch, batch.column(batch.num_columns - 1))
                if shard.n_words >= SHARD_WORDS:
                    yield from out(shard)
                    shard = Shard(phrases.value, vocabulary)
        yield from out(shard)

    return kept.mapInArrow(in_batches(run), f"{schema}, {RESULT}" if schema else RESULT)


def contamination(docs: DataFrame, benchmark: DataFrame, keep: list[str], slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """Find windows of benchmark items in whole documents.

    A window is 10 consecutive words of an item; an item of fewer words, but not none, is one window. Each task cuts
    its documents into shards of about 3 million words and indexes each: words are numbers, all words that no item
    has are one number, and stretches of benchmark words too short for any window are left out, as none can lie in
    them. All windows are searched backwards at once through the wavelet ranks of the shard's transform; occurrences
    are located by sampled suffix positions and merged to spans of words. No document leaves its task.

    The benchmark goes to all tasks while its texts have at most ``slice_bytes``. A larger one is searched for in
    slices of that size, in as many passes over the documents, and the spans and items of each row are put together.

    Null and empty texts have no words; items without words occur nowhere; an item_id that is missing is named by the
    empty string; rows of one item_id count as one item. Repeated documents are returned each. ``keep`` names the
    columns to hand on; others are not read, whatever their names.

    Returns them with n_words, spans (first and last word, last exclusive, merged) and items (identifiers as text).
    """
    spark = docs.sparkSession
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.col("text"))
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    slices = max(1, -(-size // slice_bytes))
    if slices == 1:
        return search(docs, [tuple(r) for r in items.collect()], keep)
    numbered = settle(docs.select(*keep, "text").withColumn("__row", F.monotonically_increasing_id()))
    items = settle(items.withColumn("__slice", F.pmod(F.xxhash64("item", "text"), F.lit(slices))))
    parts = None
    for i in range(slices):
        chosen = [tuple(r) for r in items.where(F.col("__slice") == i).select("item", "text").collect()]
        part = search(numbered, chosen, ["__row"])
        parts = part if parts is None else parts.union(part)
    rows = parts.groupBy("__row").agg(
        F.first("n_words").alias("n_words"),
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    ends = F.col("spans")
    joined = F.aggregate(
        ends,
        F.array().cast("array<struct<first:bigint,last:bigint>>"),
        lambda done, s: F.when(
            (F.size(done) > 0) & (F.element_at(done, -1)["last"] >= s["first"]),
            F.concat(
                F.slice(done, 1, F.size(done) - 1),
                F.array(
                    F.struct(
                        F.element_at(done, -1)["first"].alias("first"),
                        F.greatest(F.element_at(done, -1)["last"], s["last"]).alias("last"),
                    )
                ),
            ),
        ).otherwise(F.concat(done, F.array(s))),
    )
    rows = rows.withColumn("spans", F.when(F.size("spans") > 0, joined).otherwise(ends))
    return numbered.select(*keep, "__row").join(rows, "__row").select(*keep, "n_words", "spans", "items")


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows of ``docs`` in which no window of the benchmark occurs."""
    names = list(docs.columns)
    # The text is read as bytes for the search and handed on as it is; results cannot clash with names of ``docs``.
    inner = docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)), F.col("text"))
    found = contamination(inner, benchmark, [f"c{i}" for i in range(len(names))])
    return found.where(F.size("items") == 0).select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(names)))


@query("op2_decontamination")
def op2_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"), ["doc_id"])
    words = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"])
    return found.select(
        "doc_id",
        "n_words",
        words.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("items") > 0).alias("contaminated"),
        "spans",
        "items",
    )
