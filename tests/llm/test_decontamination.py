"""FM-index and decontamination against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablescout.llm import decontamination as D
from tablescout.llm.fm_index import FMIndex, suffix_array


def test_suffix_array_and_search():
    draw = np.random.default_rng(3)
    for size, alphabet in ((1, 3), (50, 3), (400, 5), (3000, 40), (500, 2)):
        text = draw.integers(1, alphabet, size)
        ended = np.append(text, 0)
        order = suffix_array(ended)
        assert order.tolist() == sorted(range(len(ended)), key=lambda i: ended[i:].tolist())
        index = FMIndex(text, alphabet)
        phrases = [text[i : i + n].tolist() for i in range(0, size, 7) for n in (1, 2, 5) if i + n <= size] + [[alphabet - 1] * 4]
        rows = np.zeros((len(phrases), 5), np.int64)
        for i, p in enumerate(phrases):
            rows[i, 5 - len(p) :] = p
        low, high = index.search(rows, np.array([len(p) for p in phrases]))
        for p, a, b in zip(phrases, low, high):
            want = [i for i in range(size - len(p) + 1) if text[i : i + len(p)].tolist() == p]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def brute(docs, items):
    windows = []
    for item, text in items:
        words = D.words_of(text)
        windows += [(tuple(words[i : i + 10]), item) for i in range(max(1, len(words) - 9) if words else 0)]
    out = {}
    for doc_id, text in docs:
        words, hit, found = D.words_of(text), set(), set()
        for w, item in windows:
            for i in range(len(words) - len(w) + 1):
                if tuple(words[i : i + len(w)]) == w:
                    hit.update(range(i, i + len(w)))
                    found.add(item)
        out[doc_id] = (len(words), len(hit), sorted(found))
    return out


def corpus():
    draw = random.Random(11)
    words = [f"w{i}" for i in range(30)] + ["É", "ünï", "x" * 20, "x" * 19 + "y", "ab", "a", "日本語日本語日本語"]
    text = lambda n: " ".join(draw.choice(words) for _ in range(n))
    items = [(str(i), text(draw.choice([12, 25, 40]))) for i in range(12)]
    items += [("short", "Alpha beta w1"), ("one", "x" * 20), ("none", " ... "), ("null", None), ("0", items[0][1])]
    docs = []
    for i in range(60):
        parts = [text(draw.choice([0, 3, 30]))]
        if i % 2:
            item = draw.choice(items)[1] or ""
            piece = item.split()
            at = draw.randrange(max(1, len(piece) - 11))
            parts += [", ".join(piece[at : at + draw.choice([9, 10, 14])]).upper() if i % 4 == 1 else item, text(5)]
        docs.append((i, "\n".join(parts)))
    docs += [(100, None), (101, ""), (102, "x" * 20), (103, "w1 w2 " * 3000), (104, items[3][1]), (105, "...")]
    return docs, items


@pytest.mark.parametrize("slice_bytes,shard_words", [(10**6, 10**6), (400, 50)])
def test_contamination_is_brute_force(spark, monkeypatch, slice_bytes, shard_words):
    monkeypatch.setattr(D, "SHARD_WORDS", shard_words)
    docs, items = corpus()
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("spans", F.lit(1)).repartition(3)
    bench = spark.createDataFrame(items, "item_id string, text string").withColumn("words", F.lit(1))
    got = {r.doc_id: r for r in D.contamination(df, bench, ["doc_id"], slice_bytes).collect()}
    for doc_id, (n_words, n_hit, found) in brute(docs, items).items():
        r = got[doc_id]
        assert (r.n_words, sum(s.last - s.first for s in r.spans), sorted(r["items"])) == (n_words, n_hit, found), doc_id
        assert all(a.last < b.first for a, b in zip(r.spans, r.spans[1:]))


def test_empty_tables_and_filter(spark):
    docs, items = corpus()
    df = spark.createDataFrame(docs + [(None, "fine"), (None, None)], "doc_id long, text string")
    df = df.withColumn("items", F.lit("x")).withColumn("c0", F.lit(2))
    bench = spark.createDataFrame(items, "item_id string, text string")
    assert D.contamination(df.limit(0), bench, ["doc_id"]).count() == 0
    none = D.contamination(df, bench.limit(0), ["doc_id"]).collect()
    assert len(none) == len(docs) + 2 and not any(r["items"] for r in none)
    kept = D.clean_documents(df, bench)
    assert kept.columns == df.columns
    want = [d for d, (_, _, found) in brute(docs, items).items() if not found]
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(want)
    assert kept.where("doc_id IS NULL").count() == 2


