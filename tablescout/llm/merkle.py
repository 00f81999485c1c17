"""Merkle manifest of a dataset: a hash tree by ordered rows and groups, and a proof for each row."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tablescout.llm.common import field, query, settle, table

#: Consecutive nodes that become one, levels of the tree that a digit of the rank stands for, and digits in a block: a
#: block holds ARITY ** (WIDTH * DIGITS) = 256 nodes at most.
ARITY, WIDTH, DIGITS = 2, 4, 2
#: Columns of a document that its leaf covers, in this order.
COVERED = ("doc_id", "source", "lang", "n_chars", "text")
#: Steps from a leaf up: the digests before and after it in its run, each as one text.
PATH = "array<struct<left:string,right:string>>"
#: Every how manieth document by crc32 of its identifier is tampered with in the query's check.
TAMPERED = 7


def digest(*parts: str | Column) -> Column:
    """Lower-case hex sha256 of texts one after the other."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def leaf(**changed: Column) -> Column:
    """The leaf of a document; ``changed`` gives other values for some of its columns."""
    return digest(*(field(changed.get(c, F.col(c))) for c in COVERED))


def ranked(nodes: DataFrame, order: list[str]) -> DataFrame:
    """Add ``rank``, the place of a node in its group ``of`` from 0 in that order, and ``count``, the group's nodes.

    Nodes are range-sorted by group and order and written once, so a group that holds most rows lies in many
    partitions. Its nodes before a partition are a running total over one row per group and partition.
    """
    split = nodes.repartitionByRange("of", *order).sortWithinPartitions("of", *order)
    placed = settle(split.withColumn("place", F.monotonically_increasing_id()))
    part = F.shiftright("place", 33)
    runs = placed.groupBy("of", part.alias("part")).agg(F.min("place").alias("start"), F.count(F.lit(1)).alias("n"))
    earlier = W.partitionBy("of").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    runs = runs.select(
        "of", "part", (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("start")).alias("offset"), F.sum("n").over(W.partitionBy("of")).alias("count")
    )
    joined = placed.withColumn("part", part).join(runs, ["of", "part"])
    return joined.withColumn("rank", F.col("place") + F.col("offset")).drop("place", "part", "offset")


@dataclass(frozen=True)
class Tree:
    """Blocks of nodes: rows of ``of, block, count, digest`` and ``own``, the nodes of the block nested by digits of their rank."""

    arity: int = ARITY
    width: int = WIDTH
    digits: int = DIGITS

    @property
    def base(self) -> int:
        return self.arity**self.width

    @property
    def size(self) -> int:
        return self.base**self.digits

    def several(self, digit: int, level: int) -> Column:
        """Whether a group of ``count`` nodes still has more than one at this level of this digit."""
        return F.col("count") > self.base**digit * self.arity**level

    def nested(self, nodes: DataFrame) -> DataFrame:
        """One row for each block of ``of, rank, count, digest, body``.

        The digits of a node's rank within its block are grouped away one after the other, the last one first; each
        time the structs of the nodes that differ in it become the array ``kids`` of their parent, next to the digests
        of the levels between. All is in one stage behind one shuffle by group and block. A group with one node left
        hands it on unchanged.
        """
        within = F.col("rank") % self.size
        places = {f"d{i}": (F.floor(within / self.base**i) % self.base).cast("int") for i in range(self.digits)}
        rows = nodes.select(
            "of", F.floor(F.col("rank") / self.size).alias("block"), "count", "digest", F.struct("body").alias("own"), *(c.alias(k) for k, c in places.items())
        ).repartition("of", "block")
        for digit in range(self.digits):
            keys = ["of", "block", "count", *(f"d{i}" for i in range(digit + 1, self.digits))]
            rows = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(f"d{digit}").alias("digit"), "digest", "own"))).alias("kids"))
            rows = rows.withColumn("level0", F.col("kids.digest"))
            for level in range(self.width):
                runs = F.sequence(F.lit(0), F.floor((F.size(f"level{level}") - 1) / self.arity).cast("int"))
                joined = F.transform(runs, self._run(f"level{level}"))
                rows = rows.withColumn(f"level{level + 1}", F.when(self.several(digit, level), joined).otherwise(F.col(f"level{level}")))
            levels = [f"level{i}" for i in range(self.width)]
            own = F.struct(F.transform("kids", lambda k: k["own"]).alias("kids"), F.array(*levels).alias("levels"))
            rows = rows.select(*keys, F.element_at(f"level{self.width}", 1).alias("digest"), own.alias("own"))
        return rows

    def _run(self, level: str):
        return lambda i: digest(F.array_join(F.slice(level, i * self.arity + 1, F.lit(self.arity)), ""))

    def unfolded(self, blocks: DataFrame, above: list[str]) -> DataFrame:
        """One row for each node of blocks that have their own ``path``, and the columns ``above`` of all blocks.

        From the top of a block down, every kid gets the digests of its runs before and after it, in front of its
        parent's path; then nodes are exploded.
        """
        rows = blocks.select("of", "block", "count", *above, F.array(F.struct("digest", "own", "path")).alias("nodes"))
        for digit in reversed(range(self.digits)):
            rows = rows.withColumn("nodes", F.flatten(F.transform("nodes", self._kids(digit))))
        rows = rows.select("of", *above, F.explode("nodes").alias("node"))
        return rows.select("of", F.col("node.own.body").alias("body"), F.col("node.digest").alias("digest"), F.col("node.path").alias("path"), *above)

    def _kids(self, digit: int):
        """From a node with its path to its kids with theirs; a level that the group does not have adds no step."""

        def kids(node: Column) -> Column:
            levels = node["own"]["levels"]

            def step(level: int, i: Column) -> Column:
                place = F.floor(i / self.arity**level).cast("int")
                nth, digests = place % self.arity, levels[level]
                left, right = F.slice(digests, place - nth + 1, nth), F.slice(digests, place + 2, self.arity - 1 - nth)
                found = F.array(F.struct(F.array_join(left, "").alias("left"), F.array_join(right, "").alias("right")))
                return F.when(self.several(digit, level), found).otherwise(F.array().cast(PATH))

            def kid(own: Column, i: Column) -> Column:
                path = F.concat(*(step(level, i) for level in range(self.width)), node["path"])
                return F.struct(levels[0][i].alias("digest"), own.alias("own"), path.alias("path"))

            return F.transform(node["own"]["kids"], kid)

        return kids


def _rounds(nodes: DataFrame, tree: Tree) -> list[DataFrame]:
    """Written blocks of nodes, blocks of those blocks and so on, until each group is one block."""
    rounds = [settle(tree.nested(nodes))]
    while not rounds[-1].where("block > 0").isEmpty():
        upper = rounds[-1].select(
            "of", F.col("block").alias("rank"), F.ceil(F.col("count") / tree.size).alias("count"), "digest", F.col("block").alias("body")
        )
        rounds.append(settle(tree.nested(upper)))
    return rounds


def _with_paths(blocks: DataFrame, paths: DataFrame, above: list[str]) -> DataFrame:
    """Blocks with the path of their own digest; both sides meet by one grouping, in which a block is one row."""
    kinds = {f.name: f.dataType for f in blocks.schema}
    given = {f.name: f.dataType for f in paths.schema}
    sides = [
        blocks.select("of", "block", "count", "digest", "own", *(F.lit(None).cast(given[c]).alias(c) for c in ("path", *above))),
        paths.select("of", "block", *(F.lit(None).cast(kinds[c]).alias(c) for c in ("count", "digest", "own")), "path", *above),
    ]
    own = [F.first(c, ignorenulls=True).alias(c) for c in ("count", "digest", "own", "path", *above)]
    return sides[0].union(sides[1]).groupBy("of", "block").agg(*own)


def manifest(docs: DataFrame, extra: dict[str, Column] | None = None, tree: Tree = Tree()) -> DataFrame:
    """Hash tree of all rows of ``docs``: one row each with its leaf, its path to the root and the digests on top.

    A leaf is the sha256 of doc_id, source, lang, n_chars and text, missing ones as ``-``. The leaves of a lang stand
    by doc_id; in every level runs of ``tree.arity`` become the sha256 of their digests, the last run may be shorter,
    until one is left: the ``subroot``. The subroots by lang, missing first, give the ``root`` in the same way.

    Rows are ranked in their lang by a range sort. Blocks of 256 ranks are nested to one struct each, blocks of blocks
    go on with their digests alone, so rounds grow with the logarithm of the rows and no block holds more than 256
    nodes. Paths are handed down from the root in the opposite order, and unfolded from the nested blocks.

    Returns doc_id, the columns of ``extra`` (computed where the documents are read), leaf, path (steps from the leaf
    up, with the digests to the left and right in the run, one after the other), subroot and root.

    Missing doc_ids come first in their lang, repeated ones are ordered by their leaf; repeated rows are leaves of
    their own. Texts may be of any length, empty ones are not missing. An empty table has no rows. Further columns
    are not read.
    """
    extra = extra or {}
    given = docs.select(*COVERED).select("*", *(c.alias(f"x_{k}") for k, c in extra.items()))
    body = F.struct("doc_id", *(f"x_{k}" for k in extra))
    group = F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit("-"))
    leaves = given.select(group.alias("of"), "doc_id", leaf().alias("digest"), body.alias("body"))
    langs = _rounds(ranked(leaves, ["doc_id", "digest"]).drop("doc_id"), tree)

    tops = langs[-1].select(F.lit("").alias("of"), F.col("of").alias("name"), "digest", F.col("of").alias("body"))
    top = _rounds(ranked(tops, ["name"]).drop("name"), tree)
    paths = top[-1].select("of", F.lit(0).cast("long").alias("block"), F.array().cast(PATH).alias("path"), F.col("digest").alias("root"))
    for blocks in reversed(top):
        found = tree.unfolded(_with_paths(blocks, paths, ["root"]), ["root"])
        paths = found.select("of", F.col("body").alias("block"), "path", "root", "digest")
    paths = paths.select(F.col("block").alias("of"), F.lit(0).cast("long").alias("block"), "path", F.col("digest").alias("subroot"), "root")
    above = ["subroot", "root"]
    for i, blocks in enumerate(reversed(langs)):
        found = tree.unfolded(_with_paths(blocks, paths, above), above)
        if i < len(langs) - 1:
            paths = settle(found.select("of", F.col("body").alias("block"), "path", *above))
    rows = found.select("body.doc_id", *(F.col(f"body.x_{k}").alias(k) for k in extra), F.col("digest").alias("leaf"), "path", *above)
    return rows


def folded(start: str | Column, path: str | Column) -> Column:
    """The root that a leaf gives with the digests of a path."""
    return F.aggregate(path, start if isinstance(start, Column) else F.col(start), lambda own, step: digest(step["left"], own, step["right"]))


def siblings(path: str | Column) -> Column:
    """All digests of a path, level by level, left to right."""
    return F.array_join(F.transform(path, lambda step: F.concat(step["left"], step["right"])), "")


MERKLE_SQL = """
WITH RECURSIVE tab AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)),
    lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
d AS (SELECT documents.*, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1),
      lambda i: CAST(ascii(substr(CAST(doc_id AS VARCHAR), i, 1)) AS BIGINT))),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS crc FROM documents, tab),
s AS (SELECT *, coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
    || coalesce(strlen(lang) || ':' || lang, '-') AS head, coalesce(strlen(text) || ':' || text, '-') AS tail FROM d),
l AS (SELECT *, sha256(head || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') || tail) AS leaf,
    CASE WHEN crc % 7 = 0 AND n_chars IS NOT NULL
      THEN sha256(head || strlen(CAST(n_chars + 1 AS VARCHAR)) || ':' || (n_chars + 1) || tail) END AS bad FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM l),
t(lang, level, i, h, n) AS (SELECT lang, 0, i, leaf, n FROM r
  UNION ALL SELECT lang, level + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (n + 1) // 2 FROM t WHERE n > 1 GROUP BY lang, level, i // 2, n),
g AS (SELECT lang, h AS subroot, level AS height, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM t WHERE n = 1),
u(level, i, h, n) AS (SELECT 0, i, subroot, n FROM g
  UNION ALL SELECT level + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (n + 1) // 2 FROM u WHERE n > 1 GROUP BY level, i // 2, n),
p AS (SELECT r.doc_id, r.leaf, r.bad, g.subroot, g.height, g.i AS gi, r.i, r.lang, row_number() OVER () AS k,
    (SELECT h FROM u WHERE n = 1) AS root, (SELECT level FROM u WHERE n = 1) AS top FROM r JOIN g ON r.lang IS NOT DISTINCT FROM g.lang),
steps AS (
  SELECT p.k, x.step, (p.i >> x.step) & 1 AS odd, t.h FROM p, LATERAL (SELECT unnest(range(p.height)) AS step) x
    LEFT JOIN t ON t.lang IS NOT DISTINCT FROM p.lang AND t.level = x.step AND t.i = xor(p.i >> x.step, 1)
  UNION ALL SELECT p.k, p.height + x.step, (p.gi >> x.step) & 1, u.h FROM p, LATERAL (SELECT unnest(range(p.top)) AS step) x
    LEFT JOIN u ON u.level = x.step AND u.i = xor(p.gi >> x.step, 1)),
proofs AS (SELECT k, sha256(coalesce(string_agg(h, '' ORDER BY step), '')) AS proof FROM p LEFT JOIN steps USING (k) GROUP BY k),
f(k, step, h) AS (SELECT k, 0, coalesce(bad, leaf) FROM p UNION ALL
  SELECT f.k, f.step + 1, sha256(CASE WHEN s.h IS NULL THEN f.h WHEN s.odd = 1 THEN s.h || f.h ELSE f.h || s.h END)
  FROM f JOIN steps s ON f.k = s.k AND f.step = s.step)
SELECT p.doc_id, p.leaf, p.subroot, p.root, proofs.proof AS proof_sha256, f.h AS folded_root, f.h = p.root AS verified
FROM p JOIN proofs USING (k) JOIN f ON f.k = p.k AND f.step = p.height + p.top
"""


@query("op13_merkle", MERKLE_SQL)
def op13_merkle(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    changed = F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPERED == 0
    tampered = F.when(changed & F.col("n_chars").isNotNull(), leaf(n_chars=F.col("n_chars") + 1))
    rows = manifest(docs, {"tampered": tampered})
    rows = rows.select(
        "doc_id",
        "leaf",
        "subroot",
        "root",
        digest(siblings("path")).alias("proof_sha256"),
        folded(F.coalesce("tampered", "leaf"), "path").alias("folded_root"),
    )
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))
