"""The stages one after the other."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tablescout.llm import packing, simhash
from tablescout.llm.common import settle
from tablescout.llm.decontamination import contamination
from tablescout.llm.quality import quality_scores

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables are not here")


def test_every_stage_takes_effect(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels, benchmark = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("labels", "benchmark"))
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        seen.append(settle(stage(spark, seen[-1], FOLDER)))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert seen[-1].schema == docs.schema
    good, apart, clean, mixed, packed = seen[1:]
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    scores = {r.doc_id: r.score for r in quality_scores(docs, labels, ["doc_id"]).collect()}
    assert ids(good) == {i for i, s in scores.items() if s >= 0.3}
    assert ids(apart) < ids(good) and apart.count() == len(ids(apart))
    leaked = contamination(apart, benchmark, ["doc_id"]).where(F.size("items") > 0)
    assert ids(clean) == ids(apart) - ids(leaked)
    assert ids(mixed) <= ids(clean)
    count = lambda df: df.agg(F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")))).first()[0]
    assert count(mixed) == pytest.approx(1.5 * count(clean), rel=0.01)
    whole = mixed.join(clean.select("doc_id", F.col("text").alias("t")), "doc_id").where("NOT startswith(t, text)")
    assert whole.count() == 0 and mixed.where("n_chars <> char_length(text)").count() == 0
    decode = packing.Encoder(packing.VOCABULARY).encoding.decode
    tokens = 0
    for r in packed.collect():
        for a, b in zip(r.cu_seqlens, r.cu_seqlens[1:]):
            assert decode(np.frombuffer(r.input_ids, "<u2")[a : b - 1].tolist()) is not None
        tokens += r.n_tokens
    encode = packing.Encoder(packing.VOCABULARY)
    assert tokens == sum(len(encode(r.text)) // 2 + 1 for r in mixed.collect())


def test_stages_on_odd_tables(spark):
    docs = spark.createDataFrame(
        [(1, "a b c", "en", None, None), (None, None, None, None, None), (1, "a b c", "en", None, None), (2, "", None, "s", 0)],
        "doc_id long, text string, lang string, source string, n_chars long",
    )
    taken = "size position pass words whole takes start target place order block cell __key __k k node set n first sketch r label of goes kept shard".split()
    docs = docs.withColumns({c: F.lit(f"own {c}") for c in taken})
    for table in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, table, FOLDER)
            rows = out.collect()
            if name != corpus_pipeline.STAGES[-1][0]:
                assert out.dtypes == docs.dtypes
                assert all(r[c] == f"own {c}" for r in rows for c in taken)


def test_near_copies_go_by_fingerprints_and_then_by_shingles(spark):
    words = [f"w{i}" for i in range(400)]
    changed = " ".join([*words[:200], "else", *words[201:]])
    rows = [
        (4, "x x x"),
        (1, "x x x x x x x"),
        (3, "some other words here"),
        (7, " ".join(words)),
        (6, changed),
        (None, "X x x"),
        (9, ""),
        (8, None),
        (1, "some other words here"),
        (12, "alone"),
        (12, "alone"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    marks = [simhash.fingerprint((t or "").encode()) for _, t in rows]
    first = simhash.keep_one_of_near_fingerprints(docs)
    # The texts of x have one shingle of three words, and none of five in common.
    linked = lambda i, j: (marks[i] ^ marks[j]).bit_count() <= 2
    assert linked(0, 1) and linked(0, 5) and linked(6, 7) and linked(2, 8) and not linked(0, 2)
    copies = [] if linked(3, 4) else [(7, " ".join(words))]
    want = [(1, "some other words here"), (1, "x x x x x x x"), (6, changed), (8, None), (12, "alone"), (12, "alone")]
    assert sorted(map(tuple, first.collect()), key=str) == sorted([*want, *copies], key=str)
    out = corpus_pipeline.near_dedup(spark, docs, FOLDER)
    assert sorted(map(tuple, out.collect()), key=str) == sorted(want[:-1], key=str)


def test_first_shards_hold_the_early_sources(spark, monkeypatch):
    monkeypatch.setattr(packing.pack, "__defaults__", (*packing.pack.__defaults__[:2], 3000, None, None))
    docs = spark.createDataFrame(
        [(i, f"{'abc'[i % 3]}{i} " * (20 + i % 50), "abc"[i % 3]) for i in range(900)], "doc_id long, text string, source string"
    )
    mixed = settle(corpus_pipeline.mixing(spark, docs.repartition(3), FOLDER))
    shards = {}
    for r in corpus_pipeline.packing(spark, mixed, FOLDER).collect():
        shards.setdefault(r.shard, []).extend("abc"[d % 3] for d in r.doc_ids)
    ordered = [shards[s] for s in sorted(shards)]
    tenth = len(ordered) // 10
    share = lambda some, source: sum(s.count(source) for s in some) / sum(map(len, some))
    early, late = ordered[:tenth], ordered[-tenth:]
    assert share(early, "a") > 1.5 * share(late, "a") and share(late, "c") > 1.5 * share(early, "c")
