"""Licence scans against plain searches and naive matching statistics."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tablescout.llm import licences as L
from tablescout.llm.decontamination import words_of


def longest_suffix(symbols, sequences):
    for n in range(len(symbols), 0, -1):
        tail = symbols[len(symbols) - n :]
        if any(s[i : i + n] == tail for s in sequences for i in range(len(s) - n + 1)):
            return n
    return 0


@pytest.mark.parametrize("seed", range(6))
def test_matching_statistics_and_places(seed):
    draw = random.Random(seed)
    sequences = [[draw.randrange(3) for _ in range(draw.randrange(2, 14))] for _ in range(draw.randrange(1, 5))]
    sequences += sequences[:1]
    automaton = L.Automaton(sequences)
    text = [draw.randrange(4) for _ in range(80)]
    for at, (state, length) in enumerate(automaton.statistics(text), 1):
        assert length == longest_suffix(text[:at], sequences)
        part = text[at - length : at]
        if length:
            ends = {(w, i + length) for w, s in enumerate(sequences) for i in range(len(s) - length + 1) if s[i : i + length] == part}
            assert automaton.ends[state] == ends


def naive_segments(words, licence):
    """All longest common runs of LEAST words or more, as (first, at, words)."""
    out = set()
    for i in range(len(words)):
        for j in range(len(licence)):
            if words[i] == licence[j] and (not i or not j or words[i - 1] != licence[j - 1]):
                n = 0
                while i + n < len(words) and j + n < len(licence) and words[i + n] == licence[j + n]:
                    n += 1
                if n >= L.LEAST:
                    out.add((i, j, n))
    return out


def naive_best(segments):
    """Most covered words of any chain, over all chains by recursion."""

    def after(prev, covered):
        most = covered
        for s in segments:
            if prev[0] < s[0] <= prev[0] + prev[2] + L.GAP and prev[1] < s[1]:
                new = s[2] - max(0, prev[0] + prev[2] - s[0], prev[1] + prev[2] - s[1])
                if new > 0:
                    most = max(most, after(s, covered + new))
        return most

    return max((after(s, s[2]) for s in segments), default=0)


@pytest.mark.parametrize("seed", range(8))
def test_segments_and_score_of_changed_notices(seed):
    draw = random.Random(seed)
    scanner = L.Scanner(L.LICENCES, L.BASE)
    numbers = {w.decode(): i for i, w in enumerate(scanner.words)}
    words = [draw.choice(["the", "of", "software", "x", "license"]) for _ in range(30)]
    for _ in range(2):
        notice = words_of(draw.choice(L.LICENCES)[1])
        for _ in range(draw.randrange(4)):
            notice[draw.randrange(len(notice))] = draw.choice(["x", "the", "copy"])
        words += notice + ["x"] * draw.randrange(3)
    found = {}
    stretch = [numbers.get(w, -1) for w in words]
    _, segments = scanner.matches(stretch, 0)
    best = 0.0
    for which in range(scanner.n_base, len(scanner.sequences)):
        licence = scanner.sequences[which]
        if len(licence) >= L.LEAST:
            want = naive_segments(stretch, licence)
            assert {(s.first, s.at, s.words) for s in segments.get(which, [])} == want
            found[which] = naive_best(want) / len(licence)
            best = max(best, found[which])
    whole, _ = scanner.matches(stretch, 0)
    import pyarrow as pa

    (n,), _, _, (score,) = L.scan_batch(scanner, L.Vocabulary(scanner.words), pa.array([" ".join(words).encode()]))
    assert n == len(words) and score == pytest.approx(1.0 if whole else best)


def brute_base(text):
    words = words_of(text)
    return sorted((i, label) for label, phrase in L.BASE for p in [phrase.split()] for i in range(len(words)) if words[i : i + len(p)] == p)


def test_base_phrases_are_plain_search(spark):
    draw = random.Random(1)
    parts = ["cc", "by", "CC-BY", "All rights", "reserved", "rights", "general", "Public License", "GNU general public", "license", "é", "x", "4.0", "\n"]
    texts = [" ".join(draw.choice(parts) for _ in range(draw.choice([1, 4, 40, 3000]))) for _ in range(60)] + [None, "", "--", "cc", "by"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (None, "cc by")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("spans", F.lit("own"))
    for r, t in zip(sorted(L.scan(df).collect(), key=lambda r: (r.doc_id is None, r.doc_id)), [t for _, t in sorted(rows, key=lambda r: (r[0] is None, r[0]))]):
        assert r.n_words == len(words_of(t))
        assert [(b.first, b.label) for b in r.base] == brute_base(t)
        assert 0 <= r.score <= 1 and (r.score == 1 or not r.base)
    assert L.scan(df.limit(0)).count() == 0


def labels(spark, text):
    (r,) = L.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    return sorted({s.label for s in r.spans}), r


def test_notices_are_named(spark):
    filler = "and the of it was in that with " * 40
    notice = dict(reversed([(a, b) for a, b in L.LICENCES]))  # the first of each label
    cases = {
        "Licensed under CC BY-NC 4.0.": ["cc-by-nc"],
        "Licensed under CC BY-NC-SA 4.0.": ["cc-by-nc-sa"],
        "Released under the MIT License.": ["mit"],
        "Licensed under the Apache License, Version 2.0.": ["apache-2.0"],
        "This work is licensed under the GNU General Public License, version 3.": ["gpl-3.0"],
        "This work is licensed under the GNU General Public License, version 2.": ["gpl-2.0"],
        "All rights reserved.": [],
        notice["unlicense"]: ["unlicense"],
    }
    for text, want in cases.items():
        assert labels(spark, filler + text + "\n" + filler)[0] == want, text
    long = [t for label, t in L.LICENCES if label == "mit"][-1]
    changed = re.sub(r"without restriction, including", "with no restriction whatsoever, and including", long).replace("furnished", "given")
    found, r = labels(spark, filler + changed + filler)
    assert found == ["mit"] and 0.8 <= r.score < 1
    assert r.spans[0].first == len(words_of(filler)) and r.spans[0].last == len(words_of(filler + changed))
    assert labels(spark, filler + long[: len(long) // 2])[0] == []
    three = [t for label, t in L.LICENCES if label == "gpl-3.0"][-1]
    assert labels(spark, three)[0] == ["gpl-3.0"] and labels(spark, three + filler + long)[0] == ["gpl-3.0", "mit"]
    assert labels(spark, (long + " ") * 50)[1].spans[-1].share == 1 and len(labels(spark, (long + " ") * 50)[1].spans) == 50
