"""Quality and toxicity: accuracy on rows that were not learned from, and edge cases."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablescout.llm import quality as Q
from tablescout.llm import toxicity as T

# The smaller tables have 50 toxic labels, several of them wrong.
FOLDER = "/root/testdata/sf0.1"
needs_tables = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables are not here")


def auc(score, label):
    order = np.argsort(score)
    ranks = np.empty(len(score))
    ranks[order] = np.arange(1, len(score) + 1)
    good = label == 1
    return (ranks[good].sum() - good.sum() * (good.sum() + 1) / 2) / (good.sum() * (~good).sum())


def held_out(spark, query, label):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    found = query(spark, FOLDER)
    assert found.count() == spark.read.parquet(f"{FOLDER}/documents.parquet").count()
    pdf = found.join(labels, "doc_id").where("held_out").toPandas()
    return pdf, auc(pdf.score.to_numpy(), pdf[label].to_numpy())


@needs_tables
def test_quality_on_held_out_documents(spark):
    pdf, area = held_out(spark, Q.op4_quality, "quality")
    assert area > 0.99 and pdf[pdf.quality == 1].predicted.mean() > 0.98


@needs_tables
def test_toxicity_on_held_out_documents(spark):
    pdf, area = held_out(spark, T.op10_toxicity, "toxic")
    assert area > 0.95 and pdf[pdf.toxic == 0].predicted.mean() < 0.03


def small(spark):
    draw = random.Random(1)
    good = lambda: " ".join(draw.choice(["river", "house", "walks", "green", "with", "the"]) for _ in range(30))
    rows = [(i, good() if i % 3 else good().replace(" ", " ## ")) for i in range(120)]
    rows += [(500, None), (501, ""), (502, " \n"), (None, "no name"), (503, "word " * 60_000), (1, "twice")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("x")).withColumn("label", F.lit(3))
    labels = [(i, int(i % 3 > 0), int(i % 3 == 0)) for i in range(120)] + [(7, 0, 1), (900, 1, 0), (None, 1, 1), (8, None, None), (9, 5, 5)]
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("score,name", [(Q.quality_scores, "quality"), (T.toxicity_scores, "toxic")])
def test_edge_cases(spark, score, name):
    docs, labels = small(spark)
    inner = docs.select("doc_id", "text", F.col("score").alias("extra"), "label")
    got = score(inner, labels, ["doc_id", "extra"]).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    assert score(inner.limit(0), labels, ["doc_id"]).count() == 0
    assert len({r.score for r in score(inner, labels.limit(0), ["doc_id"]).collect()}) == 1
    again = score(inner.repartition(5), labels, ["doc_id", "extra"]).collect()
    key = lambda r: (str(r.doc_id), r.score)
    assert [round(r.score, 6) for r in sorted(got, key=key)] == [round(r.score, 6) for r in sorted(again, key=key)]


def test_quality_learns_and_filters(spark):
    docs, labels = small(spark)
    by = {r.doc_id: r.score for r in Q.quality_scores(docs.drop("label"), labels, ["doc_id"]).collect()}
    assert min(by[i] for i in range(2, 120) if i % 3) > max(by[i] for i in range(0, 120, 3))
    kept = Q.good_documents(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} >= {i for i in range(120) if i % 3}


def test_features_are_those_of_each_text():
    texts = [b"", b"a", b"abcd ef", " é  ü ".encode(), b"x x x x", b"abc" * 50]
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.cumsum([0] + [len(t) for t in texts])
    together = Q.counted(data, offsets)
    worth = np.random.default_rng(0).normal(size=1 << Q.BUCKET_BITS).astype(np.float32)
    whole = Q.scores(data, offsets, worth)
    for i, t in enumerate(texts):
        (alone,) = Q.counted(np.frombuffer(t, np.uint8), np.array([0, len(t)]))
        assert (alone[0] == together[i][0]).all() and np.allclose(alone[1], together[i][1])
        assert whole[i] == pytest.approx(float(worth[alone[0]] @ alone[1]), abs=1e-5)


def test_folding_and_exceptions():
    matcher = T.Matcher({" idiot": 2.0, " trash": 1.0, " trash ": 1.5})
    assert T.fold("1D!0T, ｉｄіοt​") == " id ot  idiot "
    assert matcher("What an ID10T, IDIOTS")[0] == 4.0
    assert matcher("trash can and trash") == (1.5, 4)
    assert matcher("midiot") == (0, 1) and matcher("") == (0, 0)
