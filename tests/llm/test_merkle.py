"""Merkle manifest against a hash tree written as plain loops."""

import hashlib

import pytest
from pyspark.sql import functions as F

from tablescout.llm import merkle as M

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute_leaf(row):
    values = (row[0], row[3], row[2], row[4], row[1])
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def brute_tree(digests, arity):
    """The root, and for each digest its steps (left, right) up to it."""
    paths, at, level = [[] for _ in digests], list(range(len(digests))), list(digests)
    while len(level) > 1:
        runs = [level[i : i + arity] for i in range(0, len(level), arity)]
        for k, own in enumerate(at):
            run, nth = runs[own // arity], own % arity
            paths[k].append(("".join(run[:nth]), "".join(run[nth + 1 :])))
            at[k] = own // arity
        level = [sha("".join(r)) for r in runs]
    return level[0], paths


def brute(rows, arity):
    langs = {}
    for r in rows:
        langs.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, brute_leaf(r), r[0]))
    order = sorted(langs, key=lambda lang: (lang is not None, (lang or "").encode()))
    trees = [brute_tree([x[2] for x in sorted(langs[lang])], arity) for lang in order]
    root, tops = brute_tree([t[0] for t in trees], arity)
    return sorted(
        (str(x[3]), x[2], path + tops[i], trees[i][0], root)
        for i, lang in enumerate(order)
        for x, path in zip(sorted(langs[lang]), trees[i][1])
    )


def got(df):
    return sorted((str(r.doc_id), r.leaf, [tuple(s) for s in r.path], r.subroot, r.root) for r in df.collect())


@pytest.mark.parametrize("tree", [M.Tree(2, 1, 2), M.Tree(2, 2, 1), M.Tree(3, 2, 1)])
def test_is_brute_force_tree(spark, tree):
    rows = [(i * 7 % 61, f"text {i} ä", ["en", "de", None, "", "ö", "z"][min(i % 9, 5)], None if i % 5 == 0 else "s", i) for i in range(61)]
    rows += [rows[3], rows[3], (None, None, None, None, None), (None, "", "en", "", 0), (4, "x" * 100_000, "only", "s", 1)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("leaf", F.lit("own")).repartition(5)
    assert got(M.manifest(df, tree=tree)) == brute(rows, tree.arity)


def test_small_tables(spark):
    one = spark.createDataFrame([(1, "a", "en", "s", 1)], SCHEMA)
    (row,) = M.manifest(one).collect()
    assert row.path == [] and row.leaf == row.subroot == row.root
    assert M.manifest(one.limit(0)).count() == 0


def test_proofs_find_what_was_changed(spark):
    rows = [(i, f"t{i}", "en" if i % 3 else "de", "s", i) for i in range(40)]
    df = spark.createDataFrame(rows, SCHEMA)
    bad = F.when(F.col("doc_id") == 17, M.leaf(text=F.lit("other")))
    out = M.manifest(df, {"bad": bad}).withColumn("folded", M.folded(F.coalesce("bad", "leaf"), "path"))
    assert [r.doc_id for r in out.where("folded <> root").collect()] == [17]


def test_blocks_take_one_shuffle_and_no_join(spark):
    rows = spark.range(10).selectExpr("string(id % 2) AS of", "id DIV 2 AS rank", "id % 2 + 5 AS count", "string(id) AS digest", "id AS body")
    plan = M.Tree().nested(rows)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan, plan
