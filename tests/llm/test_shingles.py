"""Near copies by shingles against brute-force Jaccard similarity."""

import random

import pytest

import corpus_pipeline
from tablescout.llm import shingles as S


def brute_set(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_kept(rows):
    sets = [brute_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both, either = len(sets[i] & sets[j]), len(sets[i] | sets[j])
            if 5 * both >= 4 * either:
                root[find(i)] = find(j)
    groups = {}
    for i, (doc_id, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(doc_id)
    return sorted(min(ids) for ids in groups.values())


@pytest.mark.parametrize("common, many", [(2, 2), (3, 16), (1000, 3)])
def test_stage_is_brute_force_jaccard(spark, monkeypatch, common, many):
    monkeypatch.setattr(S, "COMMON", common)
    monkeypatch.setattr(S, "SHOWN", 1)
    monkeypatch.setattr(S, "MANY", many)
    draw = random.Random(3)
    line = [f"l{i}" for i in range(12)]
    texts = [None, "", " ", "a b", "A  b", "one two three four five", "one two three four five six"]
    for _ in range(25):
        words = [f"w{draw.randrange(400)}" for _ in range(draw.choice([8, 40, 150]))] + line * draw.choice([0, 0, 1])
        texts.append(" ".join(words))
        for _ in range(draw.choice([0, 1, 2, 20])):
            for _ in range(draw.choice([0, 1, 1, 2])):
                words[draw.randrange(len(words))] = f"v{draw.randrange(10**6)}"
            texts.append(" ".join(words))
    draw.shuffle(texts)
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, df, "").collect())
    assert got == brute_kept(rows)


def test_near_copies_edge_cases(spark):
    base = " ".join(f"w{i}" for i in range(100))
    other = " ".join(f"x{i}" for i in range(100))
    rows = [(3, base), (5, other), (5, base + " z"), (5, other), (None, base), (None, "alone"), (None, "alone"), (9, None), (8, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = S.keep_one_of_near_copies(df)
    assert kept.columns == df.columns
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    assert got == sorted([(3, base), (5, other), (None, "alone"), (8, "")], key=str)
    assert S.keep_one_of_near_copies(df.limit(0)).count() == 0


def test_differences_find_every_near_pair():
    """Near sets in different groups of a pivot share a leading difference from it, where both are not far from it."""
    draw = random.Random(11)
    found = 0
    for _ in range(400):
        base = draw.sample(range(10**6), draw.randrange(10, 80))
        change = [draw.randrange(10**6, 10**6 + 30) for _ in range(30)]

        def variant(much, base=base, change=change):
            out = set(base)
            for _ in range(draw.randrange(much)):
                out.discard(draw.choice(base))
                out.add(draw.choice(change))
            return out

        sets = [variant(len(base) // 2) for _ in range(8)] + [set(base)]
        sets += [s ^ set(draw.sample(sorted(s), 2)) | {draw.randrange(10**7, 10**8)} for s in sets[:4]]
        pivot = S.np.array(sorted(sets[draw.randrange(len(sets))]), S.np.uint64)
        arrays = [S.np.array(sorted(s), S.np.uint64) for s in sets]
        noted = draw.sample(base, draw.randrange(len(base)))
        common = lambda a, noted=noted: S.np.isin(a, S.np.array(noted, S.np.uint64))
        leads = [S.leading_differences(pivot, a, common) for a in arrays]
        near_pivot = [S.near(pivot, a) for a in arrays]
        for i in range(len(sets)):
            for j in range(i):
                if S.near(arrays[i], arrays[j]) and not (near_pivot[i] and near_pivot[j]):
                    found += 1
                    shared = [(k, m) for k, e in enumerate(leads[i][1]) for m, f in enumerate(leads[j][1]) if e == f]
                    (x, y), both = (leads[i][0], leads[j][0]), len(sets[i]) + len(sets[j])
                    assert any(18 * min(x - k, y - m) >= 9 * (x + y) - both for k, m in shared)
    assert found > 200


def test_variants_of_one_text_are_no_pairs(spark, monkeypatch):
    """Hundreds of texts made from one in different ways, too far from each other: nothing near the square is compared."""
    draw = random.Random(5)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(300):
        words = list(base)
        for at in draw.sample(range(150), draw.choice([1, 2, 4, 9, 12])):
            words[at] = f"v{i}_{at}"
        rows.append((i, " ".join(words)))
    monkeypatch.setattr(S, "SHOWN", 1)
    pairs = []
    whole = S._verified
    monkeypatch.setattr(S, "_verified", lambda docs, nodes, some: pairs.append(some.count()) or whole(docs, nodes, some))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in S.keep_one_of_near_copies(df).collect()) == brute_kept(rows)
    assert pairs[1] < 3000  # of 44,850


def test_common_shingles_are_noted(spark, monkeypatch):
    monkeypatch.setattr(S, "SHOWN", 1)
    line = "a passage of seven words in all"
    df = spark.createDataFrame([(i, f"{line} w{i}") for i in range(3)] + [(9, "other words that are only here")], "doc_id long, text string")
    common = S._shown(df)
    assert common(S.shingles(line.encode())).all() and not common(S.shingles(b"other words that are only here")).any()
    assert S.np.unpackbits(common.bits).sum() == 3
