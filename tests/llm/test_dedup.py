"""Exact and near copies, and the graph below them, against brute force."""

import random

import pytest
import xxhash
from pyspark.sql import functions as F

from tablescout.llm import exact_dedup, simhash
from tablescout.llm.components import representatives
from tablescout.llm.exact_dedup import exact_groups


def brute_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\v", " ").replace("\f", " ")
    words = [w for w in words.replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(marks):
    """Smallest identifier reachable over pairs within two bits; marks: id -> fingerprint."""
    ids, root = sorted(marks), {i: i for i in marks}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in ids:
        for j in ids:
            if j < i and (marks[i] ^ marks[j]).bit_count() <= 2:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in ids}


TEXTS = ["", None, "one", "One  two", "a b c", "A\tB\nc", "a b c d e f g", "x " * 5000, "é ñ ß über DAS", " a b c d"]


def test_fingerprint_is_brute_force():
    for text in TEXTS:
        assert simhash.fingerprint((text or "").encode()) == brute_fingerprint(text)


@pytest.mark.parametrize("limit", [1, 16])
def test_components_over_dense_and_sparse_fingerprints(spark, monkeypatch, limit):
    monkeypatch.setattr(simhash, "SEGMENT_ROWS", limit)
    draw = random.Random(5)
    centres = [draw.getrandbits(64) for _ in range(12)]
    marks = set()
    for centre in centres:
        for _ in range(60):
            flips = draw.sample(range(64), draw.choice([0, 1, 2, 3, 4]))
            marks.add(centre ^ sum(1 << b for b in flips))
    marks |= {draw.getrandbits(64) for _ in range(50)} | {0, 1, 3, 1 << 63, (1 << 64) - 1}
    marks = {i: m for i, m in enumerate(sorted(marks, key=lambda m: draw.random()))}
    nodes = spark.createDataFrame([(simhash.signed(m),) for m in marks.values()], "fp long")
    labels = {r.node: r.label for r in representatives(simhash.linked_pairs(nodes)).collect()}
    want = brute_components(marks)
    got = {}
    for i, m in sorted(marks.items()):
        got.setdefault(labels.get(simhash.signed(m), simhash.signed(m)), []).append(i)
    assert {tuple(v) for v in got.values()} == {tuple(i for i in want if want[i] == r) for r in set(want.values())}


def test_components_of_paths_and_stars(spark):
    path = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 400)] + [(7000, 7001), (7001, 7000), (9, 9)]
    found = {r.node: r.label for r in representatives(spark.createDataFrame(path, "a long, b long")).collect()}
    assert len({found[i] for i in range(301)}) == 1 and len({found[1000 + i] for i in range(400)}) == 1
    assert len(set(found.values())) == 3
    assert representatives(spark.createDataFrame([], "a long, b long")).count() == 0


def test_stars_are_one_node_after_a_round(spark, monkeypatch):
    from tablescout.llm import components

    written, whole = [], components.settle
    monkeypatch.setattr(components, "settle", lambda df: written.append(1) or whole(df))
    stars = [(1000 * c + i, 1000 * c) for c in range(1, 40) for i in range(1, 60)]
    found = {r.node: r.label for r in representatives(spark.createDataFrame(stars, "a long, b long")).collect()}
    assert len(found) == 39 * 60 and len(set(found.values())) == 39
    assert all(found[a] == found[b] for a, b in stars)
    # Links, their numbers, the nodes joined and the links that are left: none.
    assert len(written) == 4


def test_written_tables_know_their_rows(spark):
    """Each job leaves something in the driver's memory, so rows are counted by the job that writes them."""
    from tablescout.llm.common import if_small, settle

    tables = [settle(spark.range(1000).where("id % 3 = 0")), settle(spark.range(9).where("id > 9")), settle(spark.range(5).limit(0))]
    spark.sparkContext.setJobGroup("known", "")
    hints = [if_small(t, 100) for t in tables]
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("known")
    assert [t.settled_rows for t in tables] == [t.count() for t in tables] == [334, 0, 0]
    assert ["broadcast" in t._jdf.queryExecution().logical().toString().lower() for t in hints] == [False, True, True]


ROWS = [
    (5, "a b"), (3, "ab"), (9, "a  b"), (4, "a\tb "), (7, None), (8, ""), (6, " \n"), (None, "ab"), (None, None),
    (9, "a  b"), (11, "long " * 30_000), (12, "long " * 30_000), (13, "A b"),
]


def test_exact_groups_edge_cases(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string").withColumn("run", F.lit("x")).withColumn("kept", F.lit(1))
    got = exact_groups(df).collect()
    assert len(got) == len(ROWS)
    by = {}
    for r in got:
        by.setdefault(r.text_sha256, []).append(r)
    for rows in by.values():
        assert sum(r.kept for r in rows) == 1 and {r.group_size for r in rows} == {len(rows)}
        assert len({r.keep_id for r in rows}) == 1
    keep = {r.doc_id: r.keep_id for r in got}
    assert keep[5] == keep[3] == keep[4] == keep[9] == 4 or keep[3] == 9
    assert {keep[i] for i in (3, 4, 5, 9)} == {4}  # four code points; 9 has four too, but a larger identifier
    assert keep[7] == keep[8] == keep[6] == 6 and keep[12] == 11 and keep[13] == 13
    assert exact_groups(df.limit(0)).count() == 0


@pytest.mark.parametrize("partitions", [1, 2, 40])
def test_runs_are_partitions_merged_in_rounds(spark, monkeypatch, partitions):
    monkeypatch.setattr(exact_dedup, "FAN_IN", 4)
    merges = []
    whole = exact_dedup.merge_runs
    monkeypatch.setattr(exact_dedup, "merge_runs", lambda runs, fan_in: merges.append(whole(runs, fan_in)) or merges[-1])
    rows = [(i, f"text {i % 50}") for i in range(400)] + [(i, "hot") for i in range(400, 600)]
    got = exact_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(partitions)).collect()
    assert {r.doc_id: r.keep_id for r in got} == {i: i % 50 if i < 400 else 400 for i, _ in rows}
    assert len(merges) == {1: 0, 2: 1, 40: 3}[partitions]
    for merged, runs in zip(merges, (10, 3, 1)):
        plan = merged._jdf.queryExecution().executedPlan().toString()
        # The merge is the exchange by range and run, and nothing is exchanged again to aggregate.
        assert plan.count("REPARTITION_BY_COL") == merges.index(merged) + 1 and "ENSURE_REQUIREMENTS" not in plan
        if partitions == 40:
            assert merged.select("run").distinct().count() == runs and merged.select("cut").distinct().count() > 20


def test_near_groups_edge_cases(spark):
    rows = [(i + 1, t) for i, t in enumerate(TEXTS)] + [(None, "a b c"), (2, None), (40, "a b c d e f g")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("x"))
    got = simhash.near_groups(df).collect()
    assert len(got) == len(rows)
    want = brute_components({i: brute_fingerprint(t) for i, t in rows if i is not None})
    assert all(r.component_id == want[r.doc_id] for r in got if r.doc_id is not None)
    assert simhash.near_groups(df.limit(0)).count() == 0
    kept = simhash.keep_one_of_each_group(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id) == sorted(set(want.values()))
