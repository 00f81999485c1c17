"""Mixing against a plain walk over each source."""

import hashlib
import math
import re

import pytest
from pyspark.sql import functions as F

from tablescout.llm import mixing as M


def brute_targets(sizes, weights=(5.0, 2.0, 1.0)):
    """Reshare by weight until no source is above its limit."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    left, fixed = 1.5 * sum(sizes.values()), {}
    while True:
        open_ = [s for s in order if s not in fixed]
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if weight[s] * left / total > 2 * sizes[s] * (1 + 1e-12)]
        if not over:
            return fixed | {s: weight[s] * left / total for s in open_}
        for s in over:
            fixed[s] = 2.0 * sizes[s]
            left -= fixed[s]


def brute_taken(docs):
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, (_, _, t) in enumerate(docs)}
    sizes = {}
    for i, (_, s, _) in enumerate(docs):
        sizes[s] = sizes.get(s, 0) + size[i]
    targets, taken = brute_targets(sizes), [0] * len(docs)
    for s, target in targets.items():
        order = sorted(
            (i for i, d in enumerate(docs) if d[1] == s),
            key=lambda i: (hashlib.md5(("" if docs[i][0] is None else str(docs[i][0])).encode()).hexdigest(), size[i]),
        )
        left = math.floor(target + 1e-9)
        for i in order * 2:
            take = min(left, size[i])
            taken[i] += take
            left -= take
    return targets, sizes, size, taken


def docs_of(n=400):
    out = []
    for i in range(n):
        source = ["hot", "b", "c", "é", None, "tiny", "z"][0 if i % 3 == 0 else i % 7]
        out.append((i, source, "\n".join(f"w{i} x\ty" for _ in range(i % 40 if source != "tiny" else 1))))
    out += [(900, "empty", ""), (901, "empty", None), (None, "b", "no name here"), (5, "b", "again the same"), (5, "b", "again the same")]
    return out + [(902, "long", "word " * 30_000)]


def frame(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    return df.withColumn("size", F.lit("s")).withColumn("start", F.lit(1)).withColumn("position", F.lit(1))


def test_mix_is_brute_force(spark):
    docs = docs_of()
    targets, sizes, size, taken = brute_taken(docs)
    mixed = M.mix(frame(spark, docs)).collect()
    by_doc, by_source = {}, {}
    for r in mixed:
        assert len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) == r.words and 0 <= r.position <= 1
        by_doc[r.doc_id] = by_doc.get(r.doc_id, 0) + r.words
        by_source[r.source] = by_source.get(r.source, 0) + r.words
    want = {}
    for (i, _, _), t in zip(docs, taken):
        want[i] = want.get(i, 0) + t
    assert by_doc == {i: t for i, t in want.items() if t}
    for s, target in targets.items():
        assert abs(by_source.get(s, 0) - target) <= 1 and target <= 2 * sizes[s] + 1e-6
    positions = [r.position for r in mixed]
    assert positions == sorted(positions)
    # The first source falls from 1.5 to 0.5 of its mean share: it has given five eighths of its words by half time.
    early = sum(r.words for r in mixed if r.source == "b" and r.position < 0.5)
    assert early / by_source["b"] == pytest.approx(0.625, abs=0.05)


def test_empty_and_wordless_tables(spark):
    df = frame(spark, docs_of())
    assert M.mix(df.limit(0)).count() == 0
    assert M.mix(df.where("source = 'empty'")).count() == 0


def test_first_words(spark):
    df = spark.createDataFrame([(" a\tb\n\nc  d ", 3)], "text string, n int")
    assert df.select(M.first_words("text", "n")).first()[0] == " a\tb\n\nc"
