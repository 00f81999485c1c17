"""Near copies by the Jaccard similarity of their word shingles, exact for every pair."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescout.llm.common import forget, if_small, in_batches, row_key, settle
from tablescout.llm.components import representatives

#: Words of a shingle, and the similarity from which two texts are near copies: NUMBER / OF.
SHINGLE_WORDS, NUMBER, OF = 5, 4, 5
SEED = 42
#: One text of how many shows which shingles are common, and the number of those that a common shingle is in. This sets
#: only the order in which shingles are looked at and how they are dealt to tasks; any order finds all pairs.
SHOWN, COMMON = 8, 3
#: Bits that note common shingles by their last bits, eight million bytes; a shingle noted by chance does no harm.
NOTED = 1 << 26
#: A text that is in more pairs than this is spread over SALTS tasks, and so are the texts that share a common shingle;
#: up to so many texts that share a shingle are compared pair by pair.
MANY, SALTS = 16, 32
#: Bits of a sketch for each shingle, at least; a sketch has a power of two of them.
SKETCH = 1
#: Sets that a task remembers while it compares pairs.
REMEMBERED = 64


def shingles(text: bytes) -> np.ndarray:
    """Digests of the distinct shingles of a text in UTF-8, sorted; words and case as for fingerprints.

    A text of fewer words is one shingle, one without words has none.
    """
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    plain, n = b" ".join(words), min(SHINGLE_WORDS, len(words))
    starts = np.zeros(len(words) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1, out=starts[1:])
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[:-n].tolist(), (starts[n:] - 1).tolist())
    return np.unique(np.fromiter((digest(plain[i:j], SEED) for i, j in spans), np.uint64))


class Common:
    """Which shingles are common, as a bit for each of NOTED remainders."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    def __call__(self, found: np.ndarray) -> np.ndarray:
        at = (found & np.uint64(NOTED - 1)).astype(np.int64)
        return (self.bits[at >> 3] >> (at & 7)).astype(np.uint8) & 1 == 1


def leading(found: np.ndarray, common: Common) -> tuple[np.ndarray, np.ndarray]:
    """The first shingles in the order of all texts, rare ones first: two near copies share one of them at least. Those
    that are rare and those that are common.

    With n shingles, a near copy shares NUMBER / OF of them or more, so one is among any n - that + 1.
    """
    n = len(found) - -(-NUMBER * len(found) // OF) + 1 if len(found) else 0
    late = common(found)
    first = found[~late][:n]
    return first, found[late][: n - len(first)]


def rare(found: np.ndarray, common: Common) -> int:
    """How many of a thousand shingles are not common; a text that many others are made from has the fewest."""
    return 1000 - 1000 * int(common(found).sum()) // max(1, len(found))


def sketch(found: np.ndarray) -> bytes:
    """For each bit, whether an odd number of shingles has its number; SKETCH bits a shingle or more."""
    size = 8 << max(0, (SKETCH * len(found) - 1).bit_length() - 3)
    odd = np.bincount((found & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def maybe_near(n: int, x: bytes, m: int, y: bytes) -> bool:
    """False only if sets of n and m shingles are not near, going by their sizes and sketches.

    Near sets differ in (OF - NUMBER) / (OF + NUMBER) of both sizes at most, and each difference changes one bit. A
    larger sketch is folded to the size of the smaller one.
    """
    if min(n, m) * OF < max(n, m) * NUMBER:
        return False
    if len(x) > len(y):
        x, y = y, x
    a, b = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    b = np.bitwise_xor.reduce(b.reshape(-1, len(a)), axis=0)
    return int(np.bitwise_count(a ^ b).sum()) * (OF + NUMBER) <= (OF - NUMBER) * (n + m)


def near(x: np.ndarray, y: np.ndarray) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return OF * both >= NUMBER * (len(x) + len(y) - both)


def _shown(docs: DataFrame) -> Common:
    """Shingles that are common among one of SHOWN texts, drawn by a hash; counted by Spark, and a bit each goes out."""
    rows = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(SHOWN)) == 0).select(F.col("text").cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [shingles(t or b"") for t in batch.column(0).to_pylist()]
            every = np.concatenate([*kept, np.zeros(0, np.uint64)]).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(every)], ["s"])

    found = rows.mapInArrow(in_batches(run), "s long").groupBy("s").count().where(F.col("count") >= COMMON)
    at = found.select(F.col("s").bitwiseAND(F.lit(NOTED - 1)).alias("at"))
    parts = at.groupBy(F.shiftright("at", 15).alias("part")).agg(F.bitmap_construct_agg(F.col("at") % (1 << 15)).alias("bits"))
    bits = np.zeros(NOTED >> 3, np.uint8)
    for r in parts.collect():
        bits[r["part"] << 12 : (r["part"] + 1) << 12] = np.frombuffer(r["bits"], np.uint8)
    return Common(bits)


def _members(docs: DataFrame, common: Common) -> DataFrame:
    """Row by row, written: ``r`` (a number of the row), doc_id, row key k, digest of the shingle set, its size n, its
    leading shingles (rare first, common ``late``), sketch and share of rare ones."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(t or b"") for t in batch.column(2).to_pylist()]
            leads = [leading(f, shared.value) for f in found]
            out = [
                pa.array([xxhash.xxh128_digest(f.tobytes(), SEED) for f in found], pa.binary()),
                pa.array([len(f) for f in found], pa.int32()),
                *(pa.array([x[i].view(np.int64) for x in leads], pa.list_(pa.int64())) for i in (0, 1)),
                pa.array([sketch(f) for f in found], pa.binary()),
                pa.array([rare(f, shared.value) for f in found], pa.int32()),
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *out], ["doc_id", "k", "set", "n", "first", "late", "sketch", "rare"])

    rows = docs.select("doc_id", row_key().alias("k"), F.col("text").cast("binary").alias("text"))
    rows = rows.mapInArrow(in_batches(run), f"doc_id {kind}, k binary, set binary, n int, first array<long>, late array<long>, sketch binary, rare int")
    return settle(rows.withColumn("r", F.monotonically_increasing_id()))


def _with_value(pairs: DataFrame, values: DataFrame, side: str, names: list[str]) -> DataFrame:
    """Add the values of one side; a node of many pairs is spread over tasks."""
    often = pairs.groupBy(F.col(side).alias("node")).count().where(F.col("count") > MANY).select("node", F.lit(SALTS).alias("salts"))
    often = if_small(settle(often))
    salt = F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)).alias("salt")
    spread = values.join(often, "node", "left").select(F.col("node").alias(side), salt, *(F.col(c).alias(f"{c}_{side}") for c in names))
    salted = pairs.join(often.withColumnRenamed("node", side), side, "left")
    other = "b" if side == "a" else "a"
    salted = salted.withColumn("salt", F.pmod(F.xxhash64(other), F.coalesce("salts", F.lit(1)).cast("long")).cast("int"))
    return salted.drop("salts").join(spread, [side, "salt"]).drop("salt")


def _side_by_side(pairs: DataFrame, values: DataFrame, names: list[str]) -> DataFrame:
    """Pairs a, b with the values (node and ``names``) of both sides."""
    full = _with_value(_with_value(pairs, values, "a", names), values, "b", names)
    return full.select("a", "b", *(f"{c}_a" for c in names), *(f"{c}_b" for c in names))


def _compared(pairs: DataFrame, values: DataFrame, names: list[str], test) -> DataFrame:
    """The pairs a, b for whose batches of values ``test`` (values of a, values of b) gives true."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        check = test()
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            n = len(names)
            passed = [check(row[: 1 + n], row[1 + n :]) for row in zip(columns[0], *columns[2 : 2 + n], columns[1], *columns[2 + n :])]
            yield batch.select([0, 1]).filter(pa.array(passed, pa.bool_()))

    return settle(_side_by_side(pairs, values, names).mapInArrow(in_batches(run), "a long, b long"))


def by_sketch():
    return lambda a, b: maybe_near(*a[1:], *b[1:])


class Sets:
    """Shingle sets of nodes; those of the last texts are kept, as pairs of one text often follow each other."""

    def __init__(self):
        self.known: OrderedDict[int, np.ndarray] = OrderedDict()

    def of(self, node: int, text: bytes) -> np.ndarray:
        if node in self.known:
            self.known.move_to_end(node)
        else:
            self.known[node] = shingles(text or b"")
            if len(self.known) > REMEMBERED:
                self.known.popitem(last=False)
        return self.known[node]


def by_text():
    sets = Sets()
    return lambda a, b: near(sets.of(*a), sets.of(*b))


def _texts(docs: DataFrame, nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """node and text of all nodes of the pairs, written."""
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    wanted = settle(nodes.join(if_small(settle(wanted)), "node", "left_semi").select("node", "k"))
    texts = docs.select(row_key().alias("k"), F.col("text").cast("binary").alias("text"))
    # Rows that are repeated as a whole have one key.
    return settle(texts.join(if_small(wanted), "k").select("node", "text").groupBy("node").agg(F.first("text").alias("text")))


def _verified(docs: DataFrame, nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs whose sets are as similar as asked, over all shingles; each text moves once to a chunk of its pairs."""
    texts = _texts(docs, nodes, pairs)
    links = _compared(pairs, texts, ["text"], by_text)
    forget(texts)
    return links


def leading_differences(pivot: np.ndarray, found: np.ndarray, common: Common) -> tuple[int, np.ndarray]:
    """By how many shingles a set differs from the pivot's, and the first of these in the order of all sets of the
    pivot: common shingles last, and of others and of them first those that the pivot has not.

    Sets of n and m shingles that differ from the pivot by x and y are near if and only if they share
    (9 (x + y) - n - m) / 18 of these differences, all the 9 being OF + NUMBER. Of two near sets in different groups
    one at least is not near the pivot. So a set that is near it finds all its partners by its first
    x - (9 x - n + p + 1) / 18 + 1 differences, p being the size of the pivot, and any other by
    x - (9 x - n - p) / 18 + 1.
    """
    own, missing = np.setdiff1d(found, pivot, assume_unique=True), np.setdiff1d(pivot, found, assume_unique=True)
    whole, n, p = OF + NUMBER, len(found), len(pivot)
    x = len(own) + len(missing)
    least = whole * x - n + (p + 1 if whole * x <= (OF - NUMBER) * (n + p) else -p)
    length = x - max(1, -(-least // (2 * whole))) + 1
    late = [common(part) for part in (own, missing)]
    ordered = [own[~late[0]], missing[~late[1]], own[late[0]], missing[late[1]]]
    return x, np.concatenate(ordered)[: max(0, length)]


def _differences(docs: DataFrame, nodes: DataFrame, members: DataFrame, common: Common) -> DataFrame:
    """pivot, node, differ and the leading differences of pairs of a pivot and a node, those of nodes that differ from it
    by less than half of the shingles of both; written."""
    pairs = settle(members.select(F.col("pivot").alias("a"), F.col("node").alias("b")))
    texts = _texts(docs, nodes, pairs)
    shared = docs.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = Sets()
        for batch in batches:
            pivots, own, differ, first = batch.column(0), batch.column(1), [], []
            for a, b, x, y in zip(*(c.to_pylist() for c in batch.columns)):
                pivot, found = sets.of(a, x), sets.of(b, y)
                n, leads = leading_differences(pivot, found, shared.value)
                differ.append(n)
                first.append((leads if 2 * n <= len(pivot) + len(found) else leads[:0]).view(np.int64))
            yield pa.RecordBatch.from_arrays([pivots, own, pa.array(differ, pa.int32()), pa.array(first, pa.list_(pa.int64()))], ["pivot", "node", "differ", "leads"])

    found = settle(_side_by_side(pairs, texts, ["text"]).mapInArrow(in_batches(run), "pivot long, node long, differ int, leads array<long>"))
    forget(texts)
    return found


def _buckets(nodes: DataFrame) -> DataFrame:
    """Nodes that share a leading shingle: ``bucket, node, n, least`` (the node of the bucket with the fewest rare
    shingles) and ``rows``.

    Most shingles stand alone; one shuffle brings the others together. Shingles that the same nodes have, as those of a
    copied passage, are one bucket. A common shingle is dealt to SALTS tasks.
    """
    kept = [F.col(c) for c in ("rare", "node", "n")]
    one = lambda c: F.transform(c, lambda s: F.struct(s.alias("s"), F.lit(c == "late").alias("hot")))
    lead = nodes.select(*kept, F.inline(F.concat(one("first"), one("late"))))
    salt = F.when(F.col("hot"), F.pmod("node", F.lit(SALTS))).otherwise(0).cast("int")
    lead = lead.select("s", salt.alias("salt"), "hot", *kept).repartition("s", "salt")
    met = lead.groupBy("s", "salt", "hot").agg(F.sort_array(F.collect_list(F.struct("rare", "node", "n"))).alias("all"))
    met = met.where(F.col("hot") | (F.size("all") > 1))
    by_nodes = F.struct(F.xxhash64("all").alias("x"), F.xxhash64(F.lit(SEED), "all").alias("y"))
    by_shingle = F.struct(F.col("s").alias("x"), F.lit(None).cast("long").alias("y"))
    met = settle(met.select("hot", "salt", F.when(F.col("hot"), by_shingle).otherwise(by_nodes).alias("bucket"), "all"))
    met = settle(met.groupBy("bucket", "hot", "salt").agg(F.first("all").alias("all")))
    rows = met.select("bucket", "hot", F.size("all").alias("rows"), F.element_at("all", 1).alias("least"), F.inline("all"))
    of_hot = met.where("hot").groupBy("bucket").agg(F.min(F.element_at("all", 1)).alias("first"), F.sum(F.size("all")).cast("int").alias("times"))
    rows = rows.join(if_small(settle(of_hot)), "bucket", "left")
    return rows.select("bucket", "node", "n", F.coalesce("first", "least").alias("least"), F.coalesce("times", "rows").alias("rows")).where("rows > 1")


def near_nodes(docs: DataFrame, nodes: DataFrame, common: Common) -> DataFrame:
    """Links a, b that join all distinct shingle sets of similarity 0.8 or more, directly or through others.

    ``nodes`` has node, k, n, first, late, sketch and rare. Sets are near only if they share a leading shingle. Sets that share
    one are compared with one of them, the pivot, and joined to groups. What is left are near sets of
    different groups. Up to MANY sets that share a shingle are compared pair by pair if their sketches allow it. Of
    more, those that are not far from their pivot meet by their leading differences from it, as sets that are made
    from one text in different ways share none; only sets far from it, which have just a passage in common, are
    looked at pair by pair. Near sets differ by a ninth of their shingles, so those that differ from the pivot by a
    quarter or less have no partner that differs by more than a half: every pair is in one of the two.
    """
    shared = settle(_buckets(nodes))
    sketches = nodes.select("node", "n", "sketch")
    ratio = lambda x, y: F.least(x, y) * OF >= F.greatest(x, y) * NUMBER
    stars = shared.where((F.col("node") != F.col("least.node")) & ratio(F.col("n"), F.col("least.n")))
    stars = settle(stars.select(F.col("least.node").alias("a"), F.col("node").alias("b")).distinct())
    links = _verified(docs, nodes, _compared(stars, sketches, ["n", "sketch"], by_sketch))

    groups = representatives(links)
    rest = shared.where("rows > 2").select("bucket", "node", "n", "rows", F.col("least.node").alias("pivot"), F.col("least.n").alias("p"))
    rest = rest.join(groups, "node", "left").withColumn("of", F.coalesce("label", "node")).drop("label")
    rest = settle(rest)
    several = rest.groupBy("bucket").agg(F.min("of").alias("x"), F.max("of").alias("y")).where("x != y").select("bucket")
    rest = settle(rest.join(if_small(settle(several)), "bucket", "left_semi"))
    members = settle(rest.where(F.col("rows") > MANY).select("pivot", "p", "node", "n", "of").distinct())
    apart = (F.col("node_a") < F.col("node_b")) & (F.col("of_a") != F.col("of_b")) & ratio(F.col("n_a"), F.col("n_b"))

    def sides(rows: DataFrame, keys: list[str], others: list[str]) -> list[DataFrame]:
        return [rows.select(*keys, *(F.col(c).alias(f"{c}_{x}") for c in others)) for x in "ab"]

    differences = _differences(docs, nodes, members, common)
    leads = members.join(differences.where(F.size("leads") > 0), ["pivot", "node"])
    leads = settle(leads.select("pivot", "node", "n", "of", "differ", F.posexplode("leads").alias("at", "s")))
    x, y = sides(leads, ["pivot", "s"], ["node", "n", "of", "differ", "at"])
    left = F.least(F.col("differ_a") - F.col("at_a"), F.col("differ_b") - F.col("at_b"))
    enough = 2 * (OF + NUMBER) * left >= (OF + NUMBER) * (F.col("differ_a") + F.col("differ_b")) - (OF - NUMBER) * (F.col("n_a") + F.col("n_b"))
    close = x.join(y, ["pivot", "s"]).where(apart & enough).select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))

    far = differences.join(members, ["pivot", "node"]).where(4 * F.col("differ") > F.col("n") + F.col("p")).select("pivot", "node")
    distant = rest.where(F.col("rows") > MANY).join(if_small(settle(far)), ["pivot", "node"], "left_semi")
    few = rest.where(F.col("rows") <= MANY).select("bucket", "node", "n", "of").union(distant.select("bucket", "node", "n", "of"))
    few = settle(few.join(sketches.select("node", "sketch"), "node"))
    x, y = sides(few, ["bucket"], ["node", "n", "of", "sketch"])
    pairs = x.join(y, "bucket").where(apart).select("node_a", "n_a", "sketch_a", "node_b", "n_b", "sketch_b")
    maybe = pairs.mapInArrow(in_batches(_by_sketches), "a long, b long")
    return links.union(_verified(docs, nodes, settle(close.union(maybe).distinct())))


def _by_sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        node_a, n, x, node_b, m, y = batch.columns
        passed = [maybe_near(*v) for v in zip(n.to_pylist(), x.to_pylist(), m.to_pylist(), y.to_pylist())]
        yield pa.RecordBatch.from_arrays([node_a, node_b], ["a", "b"]).filter(pa.array(passed, pa.bool_()))


def _linked_nodes(named: DataFrame, linked: DataFrame) -> DataFrame:
    """Links a, b between the nodes of rows that are linked by their keys; a repeated row counts once."""
    wanted = settle(linked.select("k").union(linked.select("of")).distinct())
    nodes = if_small(settle(named.select("k", "node").join(if_small(wanted), "k", "left_semi").distinct()))
    firsts = nodes.select(F.col("k").alias("of"), F.col("node").alias("b"))
    return linked.join(nodes, "k").join(firsts, "of").select(F.col("node").alias("a"), "b")


def keep_one_of_near_copies(docs: DataFrame, linked: DataFrame | None = None) -> DataFrame:
    """Of each group of near copies the row with the smallest doc_id, of those the one with the smallest key.

    Texts are near copies if the Jaccard similarity of their 5-word shingles is 0.8 or more, and groups are what such
    pairs join; with those of ``linked``, where it is given: keys of rows ``k`` and ``of``. Null, empty and blank texts are copies of each other. Rows without doc_id come last in their group;
    repeated rows stay once. Columns are those of ``docs``, whatever their names.
    """
    common = _shown(docs)
    members = _members(docs, common)
    first = settle(members.groupBy("set").agg(F.min("r").alias("node")))
    named = settle(members.select("r", "doc_id", "k", "set").join(first, "set").drop("set"))
    copies = if_small(named.where("r <> node").select("r"))
    nodes = members.join(copies, "r", "left_anti").select(F.col("r").alias("node"), "k", "n", "first", "late", "sketch", "rare")
    links = near_nodes(docs, nodes, common)
    labels = representatives(links if linked is None else links.union(_linked_nodes(named, linked)))

    grouped = named.join(labels, "node", "left").select("doc_id", "k", F.coalesce("label", "node").alias("of"))
    order = F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "k")
    kept = settle(grouped.groupBy("of").agg(F.min(order)["k"].alias("k")))
    times = named.groupBy("k").agg(F.count(F.lit(1)).alias("times"))
    # Rows are told by what befalls few of them: they go, or they are one of several repeated ones.
    fate = times.join(kept.withColumn("kept", F.lit(True)), "k", "left").where("kept IS NULL OR times > 1")
    fate = if_small(settle(fate.select("k", F.col("kept").isNull().alias("goes"))))

    names = list(docs.columns)
    own = docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)), row_key().alias("k")).join(fate, "k", "left")
    once = own.where("NOT goes").dropDuplicates(["k"])
    return own.where("goes IS NULL").union(once).select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(names)))
