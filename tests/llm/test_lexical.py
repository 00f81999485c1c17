"""Ranked search against scores of all pairs."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from tablescout.llm import lexical as L

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in TERM.findall(text or "")]


def brute(docs, items, best=10):
    found = [(doc_id, terms(text)) for doc_id, text in docs]
    n_docs, n_terms = sum(1 for _, t in found if t), sum(len(t) for _, t in found)
    out = []
    for item_id, text in set(items):
        asked, ranks = terms(text), []
        held = {t: sum(t in d for _, d in found) for t in set(asked)}
        for doc_id, own in found:
            if own:
                m = 100 - 75 + 75 * len(own) * n_docs // n_terms
                part = lambda t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * held[t] + 1))) * (10**9 * own.count(t) // (1000 * own.count(t) + 8 * m))
                ranks.append((-sum(part(t) for t in asked), doc_id is None, doc_id or 0))
        ranks = sorted(r for r in ranks if r[0] < 0)[:best]
        out += [(item_id, i + 1, None if r[1] else r[2], -r[0]) for i, r in enumerate(ranks)]
    return sorted(out, key=str)


def tables():
    draw = random.Random(5)
    words = [f"w{i}" for i in range(60)] + ["Été", "été", "X1"]
    text = lambda n: " ".join(draw.choice(words) for _ in range(n))
    docs = [(i, text(draw.choice([0, 1, 3, 10, 200]))) for i in range(150)]
    docs += [(i, docs[20][1]) for i in range(200, 240)] + [(7, docs[7][1]), (None, docs[20][1]), (None, None), (300, "!?"), (301, "w1 " * 5000)]
    items = [(i, text(draw.choice([1, 5, 20]))) for i in range(30)] + [(30, docs[20][1]), (31, ""), (32, None), (33, "nowhere"), (None, "w3 w3"), (5, "w5"), (5, "w5")]
    return docs, items


@pytest.mark.parametrize("tree_docs, tree_terms, slice_bytes", [(512, 6000, 10**6), (3, 10, 10**6), (16, 30, 400)])
def test_is_brute_force_ranking(spark, monkeypatch, tree_docs, tree_terms, slice_bytes):
    monkeypatch.setattr(L, "TREE_DOCS", tree_docs)
    monkeypatch.setattr(L, "TREE_TERMS", tree_terms)
    docs, items = tables()
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.lit("own")).repartition(3)
    asked = spark.createDataFrame(items, "item_id long, text string").withColumn("rank", F.lit(1))
    got = [(r.item_id, r["rank"], r.doc_id, r.score) for r in L.ranked_documents(df, asked, slice_bytes=slice_bytes).collect()]
    assert sorted(got, key=str) == brute(docs, items)


def test_trees_leave_pairs_out():
    import numpy as np
    import pyarrow as pa

    docs, items = tables()
    asked = L.Items.of([t for _, t in items])
    vocabulary = L.Vocabulary(asked.words)
    texts = pa.array([(t or "").encode() for _, t in docs * 5], pa.binary())
    found = L.terms_of(texts, vocabulary)
    held = np.bincount(found[2], minlength=len(asked.words))
    weights = np.floor(1000 * np.log((2 * len(texts) + 2) / (2 * held + 1))).astype(np.int64)
    search = L.Search(asked, weights, len(texts), int(found[0].sum()))
    search.add(pa.array(range(len(texts))), *found)
    assert 0 < search.scored < search.pairs * 0.8


def test_empty_tables_and_text_identifiers(spark):
    docs = spark.createDataFrame([("b", "x y"), ("a", "x y"), (None, "x")], "doc_id string, text string")
    items = spark.createDataFrame([("i", "x y")], "item_id string, text string")
    got = [(r.item_id, r["rank"], r.doc_id) for r in L.ranked_documents(docs, items).orderBy("rank").collect()]
    assert [g[1] for g in got] == [1, 2, 3][: len(got)] and got[:2] == [("i", 1, "a"), ("i", 2, "b")]
    assert L.ranked_documents(docs.limit(0), items).count() == 0
    assert L.ranked_documents(docs, items.limit(0)).count() == 0
