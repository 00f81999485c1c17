"""Ranked lexical search of many items at once, by trees over items and documents that are descended together."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructField

from tablescout.llm.byte_words import flat, spans, split
from tablescout.llm.common import in_batches, query, settle, table
from tablescout.llm.decontamination import IN_WORD, LOWER, Vocabulary, words_of

#: Documents that an item gets.
BEST = 10
#: Bytes of item texts that one pass over the documents searches for, and distinct terms of the items of one tree.
SLICE_BYTES, TREE_TERMS = 2_000_000, 6_000
#: Children of a node in both trees; documents of a tree, fewer where CELLS numbers would not hold their coordinates.
FAN, TREE_DOCS, CELLS = 4, 512, 4_000_000
#: Parts into which the finds of tasks are dealt before those of an item meet.
SALTS = 64


@dataclass
class Node:
    """Items first to last (exclusive): for each column that one of them has, the most that any of them asks for."""

    columns: np.ndarray
    most: np.ndarray
    first: int
    last: int
    kids: list[Node] = field(default_factory=list)


def _above(kids: list[Node]) -> Node:
    columns = np.unique(np.concatenate([k.columns for k in kids]))
    most = np.zeros(len(columns), np.int64)
    for k in kids:
        at = np.searchsorted(columns, k.columns)
        most[at] = np.maximum(most[at], k.most)
    return Node(columns, most, kids[0].first, kids[-1].last, kids)


def hierarchy(leaves: list[Node]) -> Node:
    """A tree of FAN kids a node over leaves in their order."""
    while len(leaves) > 1:
        leaves = [_above(leaves[i : i + FAN]) for i in range(0, len(leaves), FAN)]
    return leaves[0]


@dataclass
class Items:
    """Items as counts of numbered terms, and trees over them; the columns of a tree are the terms of its items."""

    words: list[bytes]
    trees: list[tuple[np.ndarray, Node]]
    #: Place of each item of the trees among those given.
    order: list[int]

    @classmethod
    def of(cls, texts: list[str | None]) -> Items:
        numbers: dict[str, int] = {}
        counts: list[tuple[int, dict[int, int]]] = []
        for i, text in enumerate(texts):
            found = Counter(numbers.setdefault(w, len(numbers)) for w in words_of(text))
            if found:
                counts.append((i, dict(sorted(found.items()))))
        # Items whose rarest terms are the same stand together; terms of later numbers occur in fewer items.
        counts.sort(key=lambda x: (max(x[1]), x[0]))
        groups: list[list[tuple[int, dict[int, int]]]] = []
        terms: set[int] = set()
        for one in counts:
            terms |= one[1].keys()
            if not groups or len(terms) > TREE_TERMS:
                groups.append([])
                terms = set(one[1])
            groups[-1].append(one)
        trees, at = [], 0
        for group in groups:
            columns = np.array(sorted({t for _, c in group for t in c}), np.int64)
            leaves = []
            for _, c in group:
                leaves.append(Node(np.searchsorted(columns, list(c)), np.array(list(c.values()), np.int64), at, at + 1))
                at += 1
            trees.append((columns, hierarchy(leaves)))
        return cls([w.encode() for w in numbers], trees, [i for group in groups for i, _ in group])


def terms_of(texts: pa.Array, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Terms of each text with repeats; then text, term and occurrences of all terms that items have, by text."""
    data, offsets = flat(texts)
    data = LOWER[data]
    starts, ends = spans(IN_WORD[data], offsets)
    first = np.searchsorted(starts, offsets)
    numbers = vocabulary.numbers(data, starts, ends) - 2 if len(starts) else np.zeros(0, np.int64)
    doc = np.repeat(np.arange(len(texts)), np.diff(first))
    known = numbers >= 0
    size = max(1, len(vocabulary.words))
    pairs, tf = np.unique(doc[known] * size + numbers[known], return_counts=True)
    return np.diff(first), pairs // size, pairs % size, tf.astype(np.int64)


class Search:
    """The best documents of all items among those seen so far."""

    def __init__(self, items: Items, weights: np.ndarray, n_docs: int, n_terms: int, best: int = BEST):
        self.items, self.weights, self.n_docs, self.n_terms, self.best = items, weights, n_docs, max(1, n_terms), best
        #: By item (score negated, identifier missing, identifier), and the score that a document must reach.
        self.found: list[list[tuple]] = [[] for _ in items.order]
        self.weakest = np.ones(len(items.order), np.int64)
        #: Exact scores, and pairs of an item and a document.
        self.scored = self.pairs = 0

    def add(self, ids: pa.Array, lengths: np.ndarray, doc: np.ndarray, term: np.ndarray, tf: np.ndarray) -> None:
        m = 25 + 75 * lengths[doc] * self.n_docs // self.n_terms
        value = self.weights[term] * (1_000_000_000 * tf // (1000 * tf + 8 * m))
        for columns, root in self.items.trees:
            step = max(1, min(TREE_DOCS, CELLS // len(columns)))
            inside = np.isin(term, columns) if len(self.items.trees) > 1 else np.ones(len(term), bool)
            own, column, score = doc[inside], np.searchsorted(columns, term[inside]), value[inside]
            for at in range(0, len(ids), step):
                low, high = np.searchsorted(own, [at, at + step])
                self.tree(ids, at, min(step, len(ids) - at), own[low:high] - at, column[low:high], score[low:high], len(columns), root)

    def tree(self, ids, at: int, n: int, doc: np.ndarray, column: np.ndarray, value: np.ndarray, width: int, root: Node) -> None:
        """Search ``n`` documents from ``at`` on for the items below ``root``."""
        points = np.zeros((width, n), np.int64)
        points[column, doc] = value
        # Documents whose greatest coordinate is the same one stand together.
        order = np.lexsort((points.max(axis=0, initial=0), points.argmax(axis=0)))
        levels = [points[:, order]]
        while levels[-1].shape[1] > 1:
            levels.append(np.maximum.reduceat(levels[-1], np.arange(0, levels[-1].shape[1], FAN), axis=1))
        self.pairs += n * (root.last - root.first)
        todo = [(root, len(levels) - 1, np.zeros(1, np.int64))]
        while todo:
            node, level, docs = todo.pop()
            bound = node.most @ levels[level][node.columns[:, None], docs]
            passed = bound >= self.weakest[node.first : node.last].min()
            docs = docs[passed]
            if not len(docs):
                continue
            if level:
                kids = (docs[:, None] * FAN + np.arange(FAN)).ravel()
                below = kids[kids < levels[level - 1].shape[1]]
                todo += [(kid, level - 1, below) for kid in node.kids or [node]]
            elif node.kids:
                todo += [(kid, 0, docs) for kid in node.kids]
            else:
                self.take(node.first, bound[passed], order[docs] + at, ids)

    def take(self, item: int, scores: np.ndarray, docs: np.ndarray, ids: pa.Array) -> None:
        self.scored += len(scores)
        if len(scores) > self.best:
            enough = scores >= np.partition(scores, -self.best)[-self.best]
            scores, docs = scores[enough], docs[enough]
        new = [(-s, i is None, 0 if i is None else i) for s, i in zip(scores.tolist(), ids.take(pa.array(docs)).to_pylist())]
        best = self.found[item] = sorted(self.found[item] + new)[: self.best]
        if len(best) == self.best:
            self.weakest[item] = -best[-1][0]

    def rows(self) -> Iterator[tuple]:
        """Item, identifier and score."""
        for item, found in zip(self.items.order, self.found):
            for score, missing, doc_id in found:
                yield item, None if missing else doc_id, -score


def _statistics(docs: DataFrame, words) -> tuple[int, int, np.ndarray]:
    """Documents with terms, terms of all documents, and documents that hold each word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(words.value)
        held = np.zeros(len(words.value) + 2, np.int64)
        for whole in batches:
            for batch in split(whole, 0):
                lengths, _, term, _ = terms_of(batch.column(0), vocabulary)
                held[:-2] += np.bincount(term, minlength=len(words.value))
                held[-2:] += [np.count_nonzero(lengths), lengths.sum()]
        which = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(which.astype(np.int32)), pa.array(held[which])], ["term", "n"])

    texts = docs.select(F.col("text").cast("binary").alias("text"))
    found = texts.mapInArrow(in_batches(run), "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    held = np.zeros(len(words.value) + 2, np.int64)
    held[found["term"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
    return int(held[-2]), int(held[-1]), held[:-2]


def _finds(docs: DataFrame, items: list[tuple], item_field: StructField, best: int) -> DataFrame:
    """The best documents of each item in each task: item (its place in ``items``), item_id, doc_id and score."""
    context = docs.sparkSession.sparkContext
    asked = Items.of([text for _, text in items])
    n_docs, n_terms, held = _statistics(docs, context.broadcast(asked.words))
    weights = np.floor(1000 * np.log((2 * n_docs + 2) / (2 * held + 1))).astype(np.int64)
    shared = context.broadcast((asked, weights, [item_id for item_id, _ in items]))
    item_kind = to_arrow_type(item_field.dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, weights, names = shared.value
        search, vocabulary, kind = Search(asked, weights, n_docs, n_terms, best), Vocabulary(asked.words), None
        for whole in batches:
            kind = whole.schema.field(0).type
            for batch in split(whole, 1):
                search.add(batch.column(0), *terms_of(batch.column(1), vocabulary))
        if rows := list(search.rows()):
            item, doc_id, score = zip(*rows)
            columns = [pa.array(item, pa.int64()), pa.array([names[i] for i in item], item_kind), pa.array(doc_id, kind), pa.array(score, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["item", "item_id", "doc_id", "score"])

    texts = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    kinds = [x.dataType.simpleString() for x in (item_field, docs.schema["doc_id"])]
    return texts.mapInArrow(in_batches(run), f"item long, item_id {kinds[0]}, doc_id {kinds[1]}, score long")


def ranked_documents(docs: DataFrame, items: DataFrame, best: int = BEST, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """The ``best`` documents of each item by lexical score: item_id, rank from 1, doc_id, score.

    Terms are runs of digits, letters and characters outside ASCII, only A-Z lower-cased. A term's weight is
    floor(1000 ln((2 N + 2) / (2 df + 1))) with N documents that have terms and df that hold it; a document of n terms
    has m = 25 + 75 n N div L, L being all terms; a term that occurs tf times gives weight * (10^9 tf div (1000 tf +
    8 m)), and a document's score sums that over the terms of an item, repeats included. Documents that score nothing
    are left out; equal scores stand by doc_id, missing ones last.

    A first pass counts. In the second, each task puts documents by some hundreds into a tree whose nodes hold the
    greatest coordinate of their documents, and descends it together with a tree of items whose nodes hold the most
    that their items ask for. The product of the two is a bound of all scores below; a pair of nodes is left out if
    that does not reach the weakest score among the items' best so far, so no document of the result is missed. Each
    task hands on the best of its items; those meet in two steps, so no group has more than best x SALTS rows.

    Items go to all tasks while their texts have ``slice_bytes``; more are searched for in as many passes. Rows of
    items with equal item_id and text are one item, other rows with an item_id have ranks of their own. Null and
    empty texts have no terms; such documents do not count and such items have no rows. Repeated documents are ranked
    each. Empty tables have no rows. Further columns are not looked at.
    """
    kind = items.schema["item_id"]
    asked = items.select("item_id", "text").distinct()
    size = asked.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    slices = max(1, -(-size // slice_bytes))
    if slices > 1:
        asked = settle(asked.withColumn("slice", F.pmod(F.xxhash64("item_id", "text"), F.lit(slices))))
    parts = []
    for i in range(slices):
        chosen = asked if slices == 1 else asked.where(F.col("slice") == i)
        found = _finds(docs, [tuple(r) for r in chosen.select("item_id", "text").collect()], kind, best)
        parts.append(found.withColumns({"item": F.lit(i).cast("long") * (1 << 32) + F.col("item"), "salt": F.spark_partition_id() % SALTS}))
    found = reduce(DataFrame.union, parts)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    for keys in (["item", "salt"], ["item"]):
        found = found.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= best)
    return found.select("item_id", "rank", "doc_id", "score")


LEXICAL_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
c AS (SELECT count(*)::BIGINT AS n, sum(len(t))::BIGINT AS l FROM d WHERE len(t) > 0),
i AS (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
q AS (SELECT item_id, term, count(*) AS times FROM i GROUP BY item_id, term),
o AS (SELECT k, doc_id, len(t)::BIGINT AS n, unnest(t) AS term FROM d),
f AS (SELECT k, doc_id, n, term, count(*)::BIGINT AS tf FROM o WHERE term IN (SELECT term FROM q) GROUP BY k, doc_id, n, term),
w AS (SELECT term, floor(1000 * ln((2 * c.n + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM f, c GROUP BY term, c.n),
s AS (SELECT q.item_id, f.doc_id, f.k,
    sum(q.times * w.w * ((1000000000 * f.tf) // (1000 * f.tf + 8 * (25 + (75 * f.n * c.n) // c.l))))::BIGINT AS score
    FROM q JOIN f USING (term) JOIN w USING (term), c GROUP BY q.item_id, f.doc_id, f.k),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10
"""


@query("op12_lexical", LEXICAL_SQL)
def op12_lexical(spark: SparkSession, folder: str) -> DataFrame:
    return ranked_documents(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
