"""Packing: exact round trip, tokens as the whole text gives them, rows filled as a plain best fit fills them."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablescout.llm import packing as P

SPACES = ["a  b", "a\n b", "a \nb", "a \n \n b", " a", "a ", "a\n ", "\t\ta", "a  b", "don't  stop", "x  y", "1 234  5", "", " ", "\n", "a b\n\nc d"]


def test_tokens_are_those_of_the_vocabulary():
    encode = P.Encoder(P.VOCABULARY)
    draw = random.Random(2)
    texts = SPACES + ["".join(draw.choice("ab 1é,.\n\t '") for _ in range(60)) for _ in range(3000)]
    for text in texts:
        ids = np.frombuffer(encode(text), "<u2").tolist()
        assert encode.encoding.decode(ids) == text and max(ids, default=0) < P.END


def plain_best_fit(lengths, length):
    rooms, rows = [], []
    for piece in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        fits = [r for r in range(len(rows)) if rooms[r] >= lengths[piece]]
        if fits:
            row = min(fits, key=lambda r: rooms[r])
        else:
            row = len(rows)
            rows.append([])
            rooms.append(length)
        rows[row].append(piece)
        rooms[row] -= lengths[piece]
    return sorted(rooms)


def test_best_fit_decreasing():
    draw = random.Random(4)
    for length in (1, 7, 64, 100):
        lengths = np.array([draw.randint(1, length) for _ in range(300)])
        rows = P.best_fit(lengths, length)
        assert sorted(p for r in rows for p in r) == list(range(300))
        assert sorted(length - int(lengths[r].sum()) for r in rows) == plain_best_fit(lengths.tolist(), length)


@pytest.mark.parametrize("shard_tokens", [10**6, 200])
def test_round_trip(spark, shard_tokens):
    draw = random.Random(9)
    texts = [" ".join(draw.choice(["the", "Ünï", "of\n", "  x", "9"]) for _ in range(draw.choice([0, 3, 40, 700]))) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(100, None), (None, "no name"), (101, "word " * 20_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.lit("x")).withColumn("part", F.lit("y"))
    encode, pieces = P.Encoder(P.VOCABULARY), {}
    for r in P.pack(df.repartition(3), length=256, shard_tokens=shard_tokens).collect():
        ids = np.frombuffer(r.input_ids, "<u2")
        assert len(ids) == 256 and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens <= 256
        assert r.position_resets == r.cu_seqlens[:-1] and (ids[r.n_tokens :] == P.END).all()
        positions = P.position_ids(r.cu_seqlens, 256)
        assert all(positions[i] == 0 for i in r.position_resets)
        for doc, start, a, b in zip(r.doc_ids, r.piece_starts, r.cu_seqlens, r.cu_seqlens[1:]):
            assert positions[b - 1] == b - a - 1
            pieces.setdefault(doc, []).append((start, ids[a:b]))
    assert set(pieces) == {i for i, _ in rows}
    for i, text in rows:
        got = np.concatenate([p for _, p in sorted(pieces[i], key=lambda x: x[0])])
        assert got[-1] == P.END and encode.encoding.decode(got[:-1].tolist()) == (text or "")


def test_written_rows_are_a_matrix(spark, tmp_path):
    df = spark.createDataFrame([(i, "some words " * i) for i in range(40)], "doc_id long, text string")
    P.write_packed(P.pack(df, length=64), str(tmp_path / "packed"))
    rows = spark.read.parquet(str(tmp_path / "packed")).orderBy("shard", "row").collect()
    matrix = P.id_matrix(rows, 64)
    assert matrix.shape == (len(rows), 64) and (matrix == P.END).sum() == 40 + sum(64 - r.n_tokens for r in rows)


def test_empty_table(spark):
    assert P.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_shards_follow_the_written_order(spark, tmp_path):
    rows = [(i, "word " * (70 + i % 9)) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartitionByRange(4, "doc_id").sortWithinPartitions("doc_id")
    df.write.parquet(str(tmp_path / "docs"))
    read = spark.read.parquet(str(tmp_path / "docs"))
    shards = {}
    for r in P.pack(read, length=256, shard_tokens=500, place=P.written_place(read)).collect():
        shards.setdefault(r.shard, set()).update(r.doc_ids)
    ordered = [shards[s] for s in sorted(shards)]
    assert len(ordered) > 8 and sum(map(len, ordered)) == 200
    assert all(max(a) < min(b) for a, b in zip(ordered, ordered[1:]))


def test_any_frame_packs_as_well_as_a_scan(spark, tmp_path):
    """Shards end by size alone: shuffled, sorted and dealt over many files, rows are filled as in a scan."""
    draw = random.Random(1)
    rows = [(i, "word " * draw.choice([3, 30, 100, 200])) for i in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    df.coalesce(1).write.parquet(str(tmp_path / "one"))
    df.repartition(300).write.parquet(str(tmp_path / "many"))
    one, many = (spark.read.parquet(str(tmp_path / n)) for n in ("one", "many"))
    count = lambda frame, **more: P.pack(frame, length=256, shard_tokens=20_000, **more).count()
    least = count(one)
    for frame in (one.repartition(3), one.orderBy("doc_id"), many):
        assert count(frame) <= 1.05 * least
        assert count(frame, place=P.written_place(frame)) <= 1.1 * least
    assert count(many, order=["doc_id"]) <= 1.05 * least
    shards = {}
    for r in P.pack(one.orderBy(F.desc("doc_id")), length=256, shard_tokens=20_000).collect():
        shards.setdefault(r.shard, set()).update(r.doc_ids)
    ordered = [shards[s] for s in sorted(shards)]
    assert len(ordered) > 4 and all(min(a) > max(b) for a, b in zip(ordered, ordered[1:]))
