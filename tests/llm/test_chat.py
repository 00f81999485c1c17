"""Perspectives of dialogues against a plain rendering."""

import pytest
from pyspark.sql import functions as F

from tablescout.llm import chat as C

ROWS = [
    (1, 0, "system", "Be kind."), (1, 1, "ann", "Hi <|im_end|> there"), (1, 2, "bob", "é\nü"), (1, 3, "cat", None), (1, 4, "ann", "Bye"),
    (1, 3, "cat", None), (2, 0, "user", "x"), (2, 700, "assistant", "late"), (2, 5, None, "who"), (3, 0, "system", "alone"),
    (None, 0, "user", "no id"), (4, None, "user", "no turn"), (4, 9, "user", "z" * 100_000), (4, 9, "user", ""),
]


def brute(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        mine = [(r[1] is None, r[1] or 0, r[2] or "unknown", (r[3] or "").replace("<|im_", "<| im_")) for r in rows if r[0] == conv]
        for who in {m[2] for m in mine} - {"system"}:
            out[conv, who] = []
            for _, _, speaker, text in sorted(mine):
                role = "system" if speaker == "system" else "assistant" if speaker == who else f"user name={speaker}"
                out[conv, who].append((f"<|im_start|>{role}\n", f"{text}<|im_end|>", speaker == who))
    return out


@pytest.mark.parametrize("crowd", [2_048, 2])
def test_every_participant_is_the_assistant_once(spark, monkeypatch, crowd):
    monkeypatch.setattr(C, "CROWD", crowd)
    df = spark.createDataFrame(ROWS, "conv_id long, turn int, role string, text string").withColumn("part", F.lit("x"))
    got, spans = {}, {}
    for r in sorted(C.rotate(df.repartition(3)).collect(), key=lambda r: (r.part, r.piece)):
        key = (r.conv_id, r.perspective)
        got[key] = got.get(key, "") + r.text
        spans.setdefault(key, []).extend(r.text[s.start : s.end] for s in r.own_spans)
        assert r.n_messages == r.text.count(C.OPEN)
    want = brute(ROWS)
    assert set(got) == set(want)
    for key, lines in want.items():
        if crowd > 2:
            assert got[key] == "".join(f"{h}{b}\n" for h, b, _ in lines)
            assert spans[key] == [b for _, b, own in lines if own]
        assert sorted(spans[key]) == sorted(b for _, b, own in lines if own) and len(got[key]) == sum(len(h) + len(b) + 1 for h, b, _ in lines)


def test_empty_table(spark):
    assert C.rotate(spark.createDataFrame([], "conv_id long, turn int, role string, text string")).count() == 0
