"""Principal components and clusters of rows."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from fractions import Fraction
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablescout.plans.gram import DRIVER_NUMBERS, SLICE_ROWS, Gram, doubles, features, gram

#: Numbers of the rows at borders between clusters that come to the driver after a pass.
LOOSE_NUMBERS = 1 << 22
#: Rows of a block, and bytes of the blocks of a task.
BLOCK_ROWS, PART_BYTES = 512, 1 << 27


@dataclass
class Components:
    """Principal axes, strongest first: variance of the rows along each and its direction."""

    cols: list[str]
    n: int
    centre: np.ndarray
    scale: np.ndarray
    variance: np.ndarray
    axes: np.ndarray
    total: float

    def summary(self, df: DataFrame) -> DataFrame:
        """``component, variance, share, cumulative_share``."""
        share = self.variance / self.total if self.total else np.full(len(self.variance), np.nan)
        rows = zip(range(1, len(share) + 1), self.variance.tolist(), share.tolist(), np.cumsum(share).tolist())
        return df.sparkSession.createDataFrame(list(rows), "component int, variance double, share double, cumulative_share double")

    def loadings(self, df: DataFrame) -> DataFrame:
        """``component, column, loading``."""
        rows = [(i + 1, c, float(v)) for i, axis in enumerate(self.axes) for c, v in zip(self.cols, axis)]
        return df.sparkSession.createDataFrame(rows, "component int, column string, loading double")

    def alike(self) -> int:
        """Place of the axis along which the columns rise together: that with the largest sum of loadings, of equal ones the first.

        Of columns that hardly correlate the variances of the axes are nearly equal, and their order is chance.
        """
        return int(np.argmax(self.axes.sum(axis=1)))

    def project(self, df: DataFrame, cols, count: int, prefix: str = "pc", first: int = 0) -> DataFrame:
        """Add ``pc1, pc2, ...``: where each row stands on ``count`` axes from place ``first``; null where a column is missing."""
        values = list(features(df, cols).values())
        apart = [(v.cast("double") - float(m)) / float(s) for v, m, s in zip(values, self.centre, self.scale)]
        dot = lambda axis: sum((x * float(w) for x, w in zip(apart, axis)), F.lit(0.0))
        return df.withColumns({f"{prefix}{i + 1}": dot(self.axes[first + i]) for i in range(count)})


def principal_components(df: DataFrame, cols, standardize: bool = True, found: Gram | None = None) -> Components:
    """Principal components over rows complete in ``cols`` (numbers or arrays of numbers): one scan, then the
    eigenvectors of one small matrix on the driver.

    ``standardize`` takes the columns in units of their deviation. Constant columns have no part in any component.
    Each axis points to where its largest loading is positive, so that it does not depend on the solver.
    """
    found = found or gram(df, cols)
    matrix = np.nan_to_num(found.covariance)
    scale = np.ones(len(found.cols))
    if standardize:
        usable = ~np.isnan(np.diag(found.correlation))
        scale = np.where(usable, np.sqrt(np.diag(matrix)), 1.0)
        matrix = np.nan_to_num(found.correlation)
    values, vectors = np.linalg.eigh(matrix)
    order = np.argsort(-values, kind="stable")
    axes = vectors[:, order].T
    largest = np.take_along_axis(axes, np.abs(axes).argmax(axis=1)[:, None], axis=1)
    axes = axes * np.where(largest < 0, -1.0, 1.0)
    return Components(found.cols, found.n, found.mean, scale, np.maximum(values[order], 0), axes, float(np.trace(matrix)))


@dataclass
class Clusters:
    """Centres of clusters, the rows of each, and the sum of squared distances after every round."""

    centres: np.ndarray
    sizes: list[int]
    inertia: list[float] = field(default_factory=list)

    def assign(self, df: DataFrame, cols, name: str = "cluster") -> DataFrame:
        """Add the number of the nearest centre, from 0; null where a column is missing."""
        named, centres = features(df, cols), self.centres

        @F.pandas_udf(T.IntegerType())
        def nearest(values: pd.DataFrame) -> pd.Series:
            points = values.to_numpy(dtype=float)
            missing = np.isnan(points).any(axis=1)
            out = pd.Series(_nearest(np.nan_to_num(points), centres)[0], dtype="Int32")
            return out.mask(missing)

        return df.withColumn(name, nearest(F.struct(*(c.cast("double").alias(f"x{i}") for i, c in enumerate(named.values())))))


def _nearest(points: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number and squared distance of the nearest centre, of equal ones the first; each row by itself, so the same in any batch."""
    return _apart(points, centres)[:2]


def _apart(points: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Number and squared distance of the nearest centre; squared distances to all, and by how much these may be wrong.

    One product of matrices tells the nearest; where its rounding could, each centre is compared by differences.
    """
    at = np.arange(len(points))
    with np.errstate(over="ignore", invalid="ignore"):
        size, own = np.square(points).sum(axis=1), np.square(centres).sum(axis=1)
        about = size[:, None] - 2.0 * (points @ centres.T) + own
        wrong = 8 * (centres.shape[1] + 4) * np.finfo(float).eps * (size + own.max())
        best = about.argmin(axis=1)
        least = np.square(points - centres[best]).sum(axis=1)
        others = about.copy()
        others[at, best] = np.inf
        doubt = np.flatnonzero(~(others.min(axis=1) - about[at, best] > wrong))
    best[doubt], least[doubt] = _compared(points[doubt], centres)
    return best, least, about, wrong


def _compared(points: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    best, least = np.zeros(len(points), np.int64), np.full(len(points), np.inf)
    for i, centre in enumerate(centres):
        apart = np.square(points - centre).sum(axis=1)
        closer = apart < least
        best[closer], least[closer] = i, apart[closer]
    return best, least


def _gaps(points: np.ndarray, centres: np.ndarray, way: np.ndarray, far: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number and squared distance of the nearest centre, and by how much it is nearer than any other one, at least.

    The last holds for centres that each go up to ``far`` times along their ``way``, too.
    """
    at, (best, least, about, wrong) = np.arange(len(points)), _apart(points, centres)
    with np.errstate(over="ignore", invalid="ignore"):
        most, low = least, about
        if far > 0:
            size = np.square(way).sum(axis=1)
            along = points @ way.T - (centres * way).sum(axis=1)
            wrong = 2 * wrong + 16 * (centres.shape[1] + 4) * np.finfo(float).eps * far * far * size.max()
            turn = np.clip(along / np.where(size > 0, size, 1.0), 0.0, far)
            low = about + turn * (turn * size - 2.0 * along)
            most = least + np.maximum(far * (far * size[best] - 2.0 * along[at, best]), 0.0) + wrong
        low[at, best] = np.inf
        gaps = np.sqrt(np.maximum(low.min(axis=1) - wrong, 0.0)) - np.sqrt(most)
    return best, least, np.nan_to_num(gaps, nan=-np.inf, posinf=np.inf, neginf=-np.inf)


@dataclass
class _Scale:
    """Numbers as integers, whose sums are exact and so the same in any order."""

    largest: float
    rows: int

    @property
    def unit(self) -> float:
        """A power of two with which the sum of all rows stays below 2 ** 62."""
        bits = min(52, 61 - int(self.rows).bit_length())
        return 2.0 ** (int(np.ceil(np.log2(self.largest))) - bits) if self.largest > 0 else 1.0

    def whole(self, values: np.ndarray) -> np.ndarray:
        return np.rint(values / self.unit).astype(np.int64)


def _exact(values: np.ndarray) -> tuple[list[int], int]:
    """Numbers as integers and the power of two that all of them are multiplied with."""
    part, power = np.frexp(values.ravel())
    power = np.where(part == 0, 0, power - 53)
    least = int(power.min(initial=0))
    return [x << int(e) for x, e in zip((part * 2.0**53).astype(np.int64).tolist(), power - least)], least


def _square_sum(whole: np.ndarray) -> int:
    """Sum of the squares of integers of up to 53 bits, without loss."""
    low, middle, high = whole & 0x3FFFF, (whole >> 18) & 0x3FFFF, whole >> 36
    dot = lambda a, b: int((a * b).sum())
    return (dot(high, high) << 72) + (dot(high, middle) << 55) + ((dot(middle, middle) + 2 * dot(high, low)) << 36) + (dot(middle, low) << 19) + dot(low, low)


class _Border:
    """A pass over all rows at some centres, and the rows at the borders between them.

    The other rows do not change sides as long as no two centres leave ``far`` times their ``way`` by ``band`` together.
    So the sums of the next rounds follow from the rows at hand alone, whole numbers as a pass over all rows gives them.
    """

    def __init__(self, centres: np.ndarray, way: np.ndarray, far: float, counts: np.ndarray, sums: np.ndarray, points: np.ndarray, band: float, run: _Run):
        self.centres, self.way, self.far, self.band, self.scale, self.reach = centres, way, far, band, run.scale, run.reach
        self.counts, self.whole, self.last, self.walked, self.rounds = counts.copy(), sums.copy(), centres, 0.0, 1
        self.points = points
        # A row is looked at again when the centres have walked so far that it can have changed sides.
        self.best, _, self.free = _gaps(points, centres, way, 0.0)

    def _room(self, moved: np.ndarray) -> float:
        """By how much the distances to two centres come closer at most, with room for rounding."""
        return float(np.sort(np.sqrt(np.square(moved).sum(axis=1)))[-2:].sum()) * (1 + 1e-9) + 1e-12 * self.reach

    def follow(self, centres: np.ndarray) -> bool:
        """Go on to these centres; false where the rows at hand do not tell."""
        moved, size = centres - self.centres, np.square(self.way).sum(axis=1)
        along = np.clip((moved * self.way).sum(axis=1) / np.where(size > 0, size, 1.0), 0.0, self.far)
        if not self._room(moved - along[:, None] * self.way) < self.band:
            return False
        self.walked += self._room(centres - self.last)
        self.last, self.rounds = centres, self.rounds + 1
        some = np.flatnonzero(self.free <= self.walked)
        points, was = self.points[some], self.best[some]
        now, _, gaps = _gaps(points, centres, self.way, 0.0)
        self.best[some], self.free[some] = now, gaps + self.walked
        over = np.flatnonzero(now != was)
        whole = self.scale.whole(points[over])
        for side, sign in ((was[over], -1), (now[over], 1)):
            np.add.at(self.counts, side, sign)
            np.add.at(self.whole, side, sign * whole)
        return True


@dataclass
class _Rows:
    """Blocks as matrices of rows and of their hashes."""

    width: int
    salts: int

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        joined = lambda column, kind, width: np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS // BLOCK_ROWS):
                points, keys = batch.slice(at, SLICE_ROWS // BLOCK_ROWS).columns
                yield joined(points, float, self.width), joined(keys, np.uint64, self.salts or 1)


class _Run:
    """Passes over the rows; what comes back from each is bounded by clusters and columns, and by LOOSE_NUMBERS.

    Rows are kept as blocks of numbers, with a hash of each row for every one of ``salts``.
    """

    def __init__(self, df: DataFrame, cols, salts: list[tuple] = ()):
        rows = doubles(df, features(df, cols))
        names = rows.columns
        rows = rows.dropna().where(~F.greatest(F.lit(False), *(F.isnan(c) for c in names)))
        self.width = width = len(names)
        hashes = (F.xxhash64(*names, *map(F.lit, salt)).alias(f"h{i}") for i, salt in enumerate(salts))

        def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, BLOCK_ROWS):
                    columns = [c.to_numpy(zero_copy_only=False) for c in batch.slice(at, BLOCK_ROWS).columns]
                    points = np.column_stack(columns[:width]).astype(float) + 0.0
                    keys = np.column_stack(columns[width:]).tobytes() if columns[width:] else b""
                    row = [len(points), float(np.abs(points).max()), points.tobytes(), keys]
                    yield pa.RecordBatch.from_arrays([pa.array([x]) for x in row], ["n", "largest", "points", "keys"])

        self.salts, self.session = len(salts), df.sparkSession
        self.blocks = rows.select(*names, *hashes).mapInArrow(blocks, "n long, largest double, points binary, keys binary").persist()
        parts = self.blocks.groupBy(F.spark_partition_id().alias("part")).agg(F.sum("n").alias("n"), F.max("largest").alias("largest")).collect()
        self.n = sum(r["n"] for r in parts)
        largest = max((r["largest"] for r in parts), default=0.0)
        self.scale, self.far = _Scale(largest, self.n), _Scale(4.0 * self.width * largest * largest, self.n)
        self.reach, self.most, self.parts = 2.0 * self.width**0.5 * largest, LOOSE_NUMBERS // max(1, self.width), len(parts)
        self.border, self.squares, self.before = None, None, None
        if self.n > self.most:
            self._even([r["n"] for r in parts])

    def _even(self, parts: list[int]) -> None:
        """Deal the blocks anew where files make a few large tasks of them or many small ones."""
        wanted = max(self.session.sparkContext.defaultParallelism, -(-self.n * self.width * 8 // PART_BYTES))
        if 2 * max(parts) * wanted > 3 * self.n or len(parts) > 4 * wanted:
            old, self.blocks = self.blocks, self.blocks.repartition(wanted).persist()
            self.blocks.count()
            self.parts = wanted
            old.unpersist()

    def close(self) -> None:
        self.blocks.unpersist()

    def _mapped(self, run, schema: str) -> DataFrame:
        """``run`` over matrices of rows and of their hashes."""
        rows = _Rows(self.width, self.salts)
        return self.blocks.select("points", "keys").mapInArrow(lambda batches: run(rows(batches)), schema)

    def sums(self, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """Rows of each centre, the sums of their coordinates, and the sum of squared distances."""
        total, _, _ = self._pass(centres, np.zeros_like(centres), 0.0, 0)
        return total[:, 0], total[:, 2:] * self.scale.unit, float(total[:, 1].sum()) * self.far.unit

    def next_sums(self, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """``sums`` for centres near those of the last call: from the rows at borders alone, as long as these tell.

        The sum of squared distances is that of the rows as whole numbers, without rounding, so it does not depend on
        when the last pass was.
        """
        if not (self.border and self.border.follow(centres)):
            way = centres - self.before if self.before is not None else np.zeros_like(centres)
            # About as many rounds on the way as the last pass was good for, and some.
            far = 1.5 * self.border.rounds if self.border else 0.0
            total, points, band = self._pass(centres, way, far, -(-self.most // self.parts))
            self.border = _Border(centres, way, far, total[:, 0], total[:, 2:], points, band, self)
        self.before = centres
        counts, whole = self.border.counts, self.border.whole
        exact, power = _exact(centres)
        own = sum(n * sum(x * x for x in exact[i * self.width : (i + 1) * self.width]) for i, n in enumerate(counts.tolist()))
        both = sum(x * y for x, y in zip(exact, whole.ravel().tolist()))
        unit, scale = Fraction(self.scale.unit), Fraction(2) ** power
        return counts.copy(), whole * self.scale.unit, float(unit * unit * self.squares - 2 * unit * scale * both + scale * scale * own)

    def _pass(self, centres: np.ndarray, way: np.ndarray, along: float, most: int) -> tuple[np.ndarray, np.ndarray, float]:
        """Rows, squared distances and coordinates of each centre as whole numbers; of each task the ``most`` rows nearest to a border, and the gap that no other row is below."""
        width, scale, far, squared = self.width, self.scale, self.far, self.squares is None and most > 0
        size = len(centres) * (width + 2)

        def run(rows: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
            total, squares = np.zeros((len(centres), width + 2), np.int64), 0
            near, gaps, least = np.zeros((0, width)), np.zeros(0), np.inf
            for points, _ in rows:
                if most:
                    best, apart, gap = _gaps(points, centres, way, along)
                    some = gap < least
                    near, gaps = np.concatenate([near, points[some]]), np.concatenate([gaps, gap[some]])
                    if len(gaps) > most:
                        order = np.argpartition(gaps, most)
                        least, kept = float(gaps[order[most]]), order[:most]
                        near, gaps = near[kept], gaps[kept]
                else:
                    best, apart = _nearest(points, centres)
                apart, points = far.whole(apart), scale.whole(points)
                if squared:
                    squares += _square_sum(points)
                for i in np.unique(best):
                    mine = best == i
                    total[i, 0] += mine.sum()
                    total[i, 1] += apart[mine].sum()
                    total[i, 2:] += points[mine].sum(axis=0)
            at = np.flatnonzero(total)
            row = [pa.array([*at, -1]), pa.array([*total.ravel()[at], 0]), pa.array([None] * len(at) + [least])]
            row += [pa.array([None] * len(at) + [x], pa.binary()) for x in (near.tobytes(), str(squares).encode())]
            yield pa.RecordBatch.from_arrays(row, ["at", "v", "least", "points", "squares"])

        found = self._mapped(run, "at long, v long, least double, points binary, squares binary")
        if self.parts * size > DRIVER_NUMBERS:
            lists = [F.collect_list(c).alias(c) for c in ("points", "squares")]
            found = found.groupBy("at").agg(F.sum("v").alias("v"), F.min("least").alias("least"), *lists)
        found = found.toArrow()
        total, at = np.zeros(size, np.int64), found["at"].to_numpy()
        np.add.at(total, at[at >= 0], found["v"].to_numpy()[at >= 0])
        others = found.filter(pa.array(at < 0)).to_pydict()
        flat = lambda name: [y for x in others[name] for y in (x if isinstance(x, list) else [x])]
        if squared:
            self.squares = sum(map(int, flat("squares")))
        return total.reshape(len(centres), width + 2), np.frombuffer(b"".join(flat("points")), float).reshape(-1, width), min(others["least"], default=np.inf)

    def first(self) -> np.ndarray:
        """The row with the smallest first hash."""

        def run(rows: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
            least = None
            for points, keys in rows:
                own = keys[:, 0].view(np.int64)
                least = min([(int(own.min()), x.tobytes()) for x in np.unique(points[own == own.min()], axis=0)] + [least] * (least is not None))
            if least:
                yield pa.RecordBatch.from_arrays([pa.array([x]) for x in least], ["h", "points"])

        row = self._mapped(run, "h long, points binary").agg(F.min(F.struct("h", "points")).alias("row")).first()["row"]
        return np.frombuffer(bytes(row["points"]), float).reshape(1, self.width)

    def drawn(self, centres: np.ndarray, cost: float, wanted: float, salt: int) -> np.ndarray:
        """Different rows drawn with a chance in proportion to their squared distance, by a hash of the row."""

        def run(rows: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
            for points, keys in rows:
                chance = wanted * _nearest(points, centres)[1] / cost
                u = (keys[:, salt] >> np.uint64(11)) / float(1 << 53)
                some = [x.tobytes() for x in np.unique(points[u < chance], axis=0)]
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.binary())], ["points"])

        rows = self._mapped(run, "points binary").distinct().collect()
        return np.frombuffer(b"".join(bytes(r["points"]) for r in rows), float).reshape(-1, self.width)


def _seeds(run: _Run, k: int, seed: int, rounds: int, over: float) -> np.ndarray:
    """k starting centres: rounds of draws far from what is there, then a choice among those by their weight."""
    candidates = run.first()
    for turn in range(rounds):
        _, _, cost = run.sums(candidates)
        if cost <= 0:
            break
        candidates = np.unique(np.concatenate([candidates, run.drawn(candidates, cost, over * k, turn + 1)]), axis=0)
    weight, _, _ = run.sums(candidates)
    random, chosen = np.random.default_rng(seed), [int(np.argmax(weight))]
    while len(chosen) < min(k, len(candidates)):
        apart = weight * _nearest(candidates, candidates[chosen])[1]
        if apart.sum() <= 0:
            break
        chosen.append(int(random.choice(len(candidates), p=apart / apart.sum())))
    return candidates[chosen]


def kmeans(
    df: DataFrame, cols, k: int, start=None, rounds: int | None = None, tolerance: float = 0.0, seed: int = 42, seed_rounds: int = 4, over: float = 2.0
) -> Clusters:
    """``k`` clusters of the rows complete in ``cols`` (numbers or arrays of numbers), by distance to the mean.

    Without ``start`` (a list of centres) centres are drawn in ``seed_rounds`` passes, about ``over * k`` rows each, and
    ``k`` of those chosen. Then every pass assigns and averages, until no centre moves by more than ``tolerance``, or for
    ``rounds`` if given. A pass sends the centres out and gets k sums back, and the rows nearest to a border between
    clusters. Where centres have moved so little since that no other row can have changed sides, the driver takes the
    next round from these rows, with the same result. Sums are taken over whole numbers, so the result does not depend
    on how rows are dealt to tasks. A cluster that loses all rows keeps its centre; there are
    fewer than ``k`` clusters if there are fewer different rows.
    """
    run = _Run(df, cols, [(seed,), *((seed, turn) for turn in range(seed_rounds))] if start is None else [])
    try:
        return _settled(run, k, start, rounds, tolerance, seed, seed_rounds, over)
    finally:
        run.close()


def _settled(run: _Run, k: int, start, rounds: int | None, tolerance: float, seed: int, seed_rounds: int, over: float) -> Clusters:
    if not run.n:
        return Clusters(np.zeros((0, run.width)), [])
    centres = np.array(start, float) if start is not None else _seeds(run, k, seed, seed_rounds, over)
    found, seen = Clusters(centres, []), set()
    for _ in range(rounds) if rounds is not None else count():
        # Centres that come back, which rounded sums could make them do, would do so for ever.
        if rounds is None and found.centres.tobytes() in seen:
            break
        seen.add(found.centres.tobytes())
        counts, sums, inertia = run.next_sums(found.centres)
        found.inertia.append(inertia)
        found.sizes = counts.tolist()
        moved = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], found.centres)
        shift = float(np.abs(moved - found.centres).max())
        if shift <= tolerance:
            break
        found.centres = moved
    else:
        counts, _, inertia = run.next_sums(found.centres)
        found.inertia.append(inertia)
        found.sizes = counts.tolist()
    return found
