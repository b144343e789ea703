"""Operator 11: whitening of embeddings, the leading eigenvectors of their covariance found by spectrum slicing.

Spark makes the list of distinct vectors, their exact sums and the centred covariance; what reaches the driver is one square
matrix as wide as a vector, however many rows there are. There, the inertia of LDLᵀ factors of the shifted matrix counts the
eigenvalues below any shift (Sylvester's law), so bisection encloses each leading eigenvalue alone, Rayleigh quotient iteration
finds it, and two more counts certify its number.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepwell.llm.common import stored

#: Vectors are multiples of 1 / STEPS, rounded down; an entry whose multiple needs more than 62 bits counts as not finite.
STEPS, LARGEST = 256, 2.0**62
_WIDTHS = (np.dtype("<i2"), np.dtype("<i4"), np.dtype("<i8"))
_EPS = float(np.finfo(float).eps)
_PIVOT = (1 + 17**0.5) / 8


# ---- spectrum slicing ---------------------------------------------------------------------------
def count_below(matrix: np.ndarray, shift: float) -> int:
    """How many eigenvalues of a symmetric matrix are less than `shift`: the negative pivots of LDLᵀ of the shifted matrix.

    Pivots are single entries or blocks of two, chosen so that factors don't grow. A block of two always has one negative
    eigenvalue. Pivots of exactly zero are eigenvalues equal to the shift and don't count.
    """
    m = matrix - shift * np.eye(len(matrix))
    negative, at, size = 0, 0, len(m)

    def swap(i: int, j: int) -> None:
        if i != j:
            m[[i, j], at:] = m[[j, i], at:]
            m[at:, [i, j]] = m[at:, [j, i]]

    while at < size:
        column = np.abs(m[at + 1:, at])
        row = at + 1 + int(column.argmax()) if len(column) else at
        largest = column.max() if len(column) else 0.0
        pair = False
        if abs(m[at, at]) < _PIVOT * largest:
            others = np.abs(m[row, at:])
            others[row - at] = 0.0
            rest = others.max()
            if abs(m[at, at]) * rest >= _PIVOT * largest**2:
                pass
            elif abs(m[row, row]) >= _PIVOT * rest:
                swap(at, row)
            else:
                swap(at + 1, row)
                pair = True
        if pair:
            block, below = m[at:at + 2, at:at + 2], m[at + 2:, at:at + 2].copy()
            negative += 1
            m[at + 2:, at + 2:] -= below @ np.linalg.solve(block, below.T)
            at += 2
        else:
            pivot = m[at, at]
            if pivot != 0:
                negative += int(pivot < 0)
                below = m[at + 1:, at].copy()
                m[at + 1:, at + 1:] -= np.outer(below, below / pivot)
            at += 1
    return negative


class Spectrum:
    """The leading eigenvalues and eigenvectors of a symmetric matrix without negative eigenvalues."""

    def __init__(self, matrix: np.ndarray):
        self.matrix, self.size = matrix, len(matrix)
        self.scale = float(np.abs(matrix).sum(axis=1).max()) if self.size else 0.0
        self.narrow = 8 * _EPS * self.size * self.scale
        self.counts = {-self.scale - 1.0: 0, 2 * self.scale + 1.0: self.size}

    def below(self, shift: float) -> int:
        if shift not in self.counts:
            self.counts[shift] = count_below(self.matrix, shift)
        return self.counts[shift]

    def isolate(self, number: int, low: float | None = None, high: float | None = None) -> tuple[float, float, bool]:
        """Shifts around the eigenvalue `number` (0 is the largest), and whether it is the only one between them.

        Bisection goes on until it is alone, or until the shifts are as close as rounding allows: then it is a multiple one.
        """
        rank = self.size - 1 - number  # this many eigenvalues are smaller
        low = max(s for s, n in self.counts.items() if n <= rank) if low is None else low
        high = min(s for s, n in self.counts.items() if n > rank) if high is None else high
        while self.below(high) - self.below(low) > 1 and high - low > self.narrow:
            middle = (low + high) / 2
            if self.below(middle) <= rank:
                low = middle
            else:
                high = middle
        return low, high, self.below(high) - self.below(low) == 1

    def halve(self, number: int, low: float, high: float) -> tuple[float, float]:
        middle = (low + high) / 2
        return (middle, high) if self.below(middle) <= self.size - 1 - number else (low, middle)

    def _solve(self, shift: float, vector: np.ndarray) -> np.ndarray:
        """One step of inverse iteration, of length 1."""
        for nudge in (0.0, 2.0, 64.0):
            try:
                out = np.linalg.solve(self.matrix - (shift + nudge * _EPS * self.scale) * np.eye(self.size), vector)
            except np.linalg.LinAlgError:
                continue
            length = np.linalg.norm(out)
            if np.isfinite(length) and length > 0:
                return out / length
        return vector

    def pair(self, number: int, earlier: np.ndarray) -> tuple[float, np.ndarray]:
        """The eigenvalue `number` and its unit vector; `earlier` are the rows found before it."""
        low, high, alone = self.isolate(number)
        vector = np.random.RandomState(number).standard_normal(self.size)
        for _ in range(80):
            value = (low + high) / 2
            vector = _away_from(earlier, vector)
            for _ in range(3):  # inverse iteration from the middle, then the quotient steps in
                vector = _away_from(earlier, self._solve(value, vector))
            for _ in range(8):
                value = float(vector @ self.matrix @ vector)
                if not low <= value <= high:
                    break
                if np.linalg.norm(self.matrix @ vector - value * vector) <= 4 * _EPS * self.scale:
                    break
                vector = _away_from(earlier, self._solve(value, vector))
            value = float(vector @ self.matrix @ vector)
            if self.certified(number, value, low, high, alone):
                return value, vector
            if high - low <= self.narrow:
                return value, vector  # enclosed as closely as doubles allow
            low, high = self.halve(number, low, high)
        raise ArithmeticError(f"Eigenvalue {number + 1} was not enclosed.")

    def certified(self, number: int, value: float, low: float, high: float, alone: bool) -> bool:
        """Whether counts just beside the value say that it is number `number`."""
        if not low - self.narrow <= value <= high + self.narrow:
            return False
        rank = self.size - 1 - number
        under, over = self.below(value - self.narrow), self.below(value + self.narrow)
        return under <= rank < over and (not alone or over - under == 1 or high - low <= 4 * self.narrow)

    def leading(self, wanted: int) -> tuple[np.ndarray, np.ndarray]:
        """The `wanted` largest eigenvalues, falling, and their unit vectors as rows."""
        values, vectors = np.zeros(wanted), np.eye(wanted, self.size)
        if self.scale == 0:
            return values, vectors
        for number in range(wanted):
            values[number], vectors[number] = self.pair(number, vectors[:number])
        return values, vectors


def _away_from(rows: np.ndarray, vector: np.ndarray) -> np.ndarray:
    """The vector of length 1 without its part along the rows, which are orthogonal unit vectors."""
    for _ in range(2):
        vector = vector - rows.T @ (rows @ vector)
    length = np.linalg.norm(vector)
    return vector / length if length > 0 else vector


# ---- the list of distinct vectors ---------------------------------------------------------------
def whole_steps(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length of vector in the column: the rows that have it and are usable, and their whole multiples.

    A vector is usable if it is not null and all its entries are present, finite and not too large.
    """
    sizes = np.array([-1 if n is None else n for n in pa.compute.list_value_length(column).to_pylist()], np.int64)
    for size in np.unique(sizes[sizes >= 0]):
        rows = np.flatnonzero(sizes == size)
        flat = column.take(pa.array(rows)).flatten().cast(pa.float64())
        steps = np.floor(flat.to_numpy(zero_copy_only=False).reshape(len(rows), size) * STEPS) + 0.0
        good = (np.abs(steps) < LARGEST).all(axis=1)
        yield rows[good], steps[good].astype(np.int64)


def packed(steps: np.ndarray) -> list[bytes]:
    """A short name for every row: equal rows and only those have equal names."""
    out = []
    for row in steps:
        largest = int(np.abs(row).max()) if len(row) else 0
        width = next(w for w in _WIDTHS if largest <= np.iinfo(w).max)
        out.append(bytes([width.itemsize]) + row.astype(width).tobytes())
    return out


def unpacked(names: list[bytes], size: int) -> np.ndarray:
    if not names:
        return np.zeros((0, size), np.int64)
    return np.stack([np.frombuffer(n, f"<i{n[0]}", offset=1) for n in names]).astype(np.int64)


def fit_list(embeddings: DataFrame, column: str) -> DataFrame:
    """(size, name) of every distinct usable vector, stored. Copies are dropped before the shuffle, so a hot one is one row."""

    def run(batches):
        for batch in batches:
            for _, steps in whole_steps(batch.column(0)):
                names = packed(steps)
                yield pa.record_batch([pa.array(np.full(len(names), steps.shape[1], np.int32)), pa.array(names, pa.binary())],
                                      ["size", "name"])

    found = embeddings.select(column).mapInArrow(run, "size int, name binary").distinct()
    return stored(found, "whitening-vectors")


def sums(vectors: DataFrame, size: int) -> list[int]:
    """The exact sum of every component."""

    def run(batches):
        total = np.zeros((2, size), dtype=object)
        for batch in batches:
            steps = unpacked(batch.column(0).to_pylist(), size)
            # halves of the bits are summed apart, so that no sum overflows
            total[0] += (steps >> 31).sum(axis=0).astype(object)
            total[1] += (steps & ((1 << 31) - 1)).sum(axis=0).astype(object)
        whole = [Decimal(int(high * (1 << 31) + low)) for high, low in total.T]
        yield pa.record_batch([pa.array(np.arange(size, dtype=np.int32)), pa.array(whole, pa.decimal128(38, 0))],
                              ["place", "total"])

    found = vectors.select("name").mapInArrow(run, "place int, total decimal(38,0)").groupBy("place").agg(F.sum("total").alias("total"))
    by_place = {r["place"]: int(r["total"]) for r in found.collect()}
    return [by_place.get(k, 0) for k in range(size)]


def covariance(vectors: DataFrame, size: int, rows: int, total: list[int]) -> np.ndarray:
    """The covariance with divisor `rows`. Vectors are centred, then multiplied; each task adds up one matrix."""
    mean = np.array([float(Fraction(t, rows)) for t in total])

    def run(batches):
        gram = np.zeros((size, size))
        for batch in batches:
            centred = unpacked(batch.column(0).to_pylist(), size) - mean
            gram += centred.T @ centred
        yield pa.record_batch([pa.array(np.arange(size, dtype=np.int32)), pa.array(list(gram), pa.list_(pa.float64()))],
                              ["place", "products"])

    def added(parts: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"place": parts["place"].iloc[:1], "products": [np.stack(parts["products"]).sum(axis=0)]})

    schema = "place int, products array<double>"
    found = vectors.select("name").mapInArrow(run, schema).groupBy("place").applyInPandas(added, schema)
    matrix = np.zeros((size, size))
    for place, products in found.collect():
        matrix[place] = products
    return (matrix + matrix.T) / (2.0 * rows)


# ---- whitening ----------------------------------------------------------------------------------
@dataclass
class Whitening:
    """What whitening a row needs: as large as `components` vectors."""

    rows: int
    total: list[int]
    values: np.ndarray
    vectors: np.ndarray
    explained: list[float | None]
    identity_error: float | None = None

    @property
    def scales(self) -> np.ndarray:
        """1 / sqrt of the eigenvalues; NaN where an eigenvalue is zero but for rounding."""
        floor = 16 * _EPS * len(self.total) * max(self.values.max(initial=0.0), 0.0)
        return np.array([v**-0.5 if v > floor else np.nan for v in self.values])

    def offsets(self, steps: np.ndarray) -> np.ndarray:
        """rows * x - total, as whole numbers without rounding."""
        reach = max([0, *map(abs, self.total)]) + self.rows * int(np.abs(steps).max(initial=0))
        if reach >= 2**63:
            return steps.astype(object) * self.rows - np.array(self.total, dtype=object)
        return steps * self.rows - np.array(self.total, np.int64)

    def whitened(self, offsets: np.ndarray) -> np.ndarray:
        return (offsets.astype(float) / self.rows) @ self.vectors.T * self.scales


def fit(embeddings: DataFrame, components: int = 4, column: str = "embedding") -> Whitening | None:
    """Learns from every distinct usable vector of the length that most of them have (of equally many, the longer).

    None if there is no usable vector.
    """
    vectors = fit_list(embeddings, column)
    lengths = vectors.groupBy("size").count().orderBy(F.desc("count"), F.desc("size")).limit(1).collect()
    if not lengths:
        return None
    size, rows = lengths[0]
    vectors = vectors.where(F.col("size") == size)
    total = sums(vectors, size)
    matrix = covariance(vectors, size, rows, total)
    spectrum = Spectrum(matrix)
    values, directions = spectrum.leading(min(components, size))
    trace = float(np.trace(matrix))
    model = Whitening(rows, total, values, directions, [float(v) / trace if trace > 0 else None for v in values])
    model.identity_error = identity_error(vectors, model)
    return model


def identity_error(vectors: DataFrame, model: Whitening) -> float | None:
    """How far the covariance of the whitened distinct vectors is from the identity, at most, in any entry."""
    known = [k for k, s in enumerate(model.scales) if np.isfinite(s)]
    if not known:
        return None
    size = len(model.total)

    def run(batches):
        for batch in batches:
            values = model.whitened(model.offsets(unpacked(batch.column(0).to_pylist(), size)))
            yield pa.record_batch([pa.array(values[:, k]) for k in known], [f"w{k}" for k in known])

    table = vectors.select("name").mapInArrow(run, ", ".join(f"w{k} double" for k in known))
    pairs = [(a, b) for a in known for b in known if a <= b]
    found = table.agg(*[F.covar_pop(f"w{a}", f"w{b}").alias(f"c{a}_{b}") for a, b in pairs]).first()
    return max(abs(found[f"c{a}_{b}"] - (a == b)) for a, b in pairs)


def whiten(embeddings: DataFrame, components: int = 4, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each usable row and component.

    Vectors that are null or hold null, non-finite or too large entries are dropped, and so are those of another length than
    the commonest one. Equal vectors are one vector of the fit but keep a row each, also when ids are null or repeated. Where
    an eigenvalue is zero (fewer distinct vectors than components, say) `whitened` is NULL; `explained` is NULL if all are.
    `deviation` is NULL if it needs more than 63 bits. Multiple eigenvalues give some orthonormal vectors of their space. An
    empty table gives no rows; other columns are ignored. Reads the table twice and the distinct vectors four times.
    """
    schema = (f"`{key}` {embeddings.schema[key].dataType.simpleString()}, component int, n long, deviation long, "
              "whitened double, explained double, identity_error double")
    rows = embeddings.select(key, column)
    model = fit(embeddings, components, column)

    def run(batches):
        for batch in batches:
            for place, steps in whole_steps(batch.column(1)):
                if model is None or steps.shape[1] != len(model.total) or not len(place):
                    continue
                offsets, k = model.offsets(steps), len(model.values)
                values = model.whitened(offsets).ravel()
                m = len(place)
                yield pa.record_batch([
                    batch.column(0).take(pa.array(np.repeat(place, k))),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, model.rows, np.int64)),
                    pa.array([d for d in squares(offsets) for _ in range(k)], pa.int64()),
                    pa.array(values, mask=np.isnan(values)),
                    pa.array(model.explained * m, pa.float64()),
                    pa.array([model.identity_error] * (m * k), pa.float64())],
                    [key, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, schema)


def squares(offsets: np.ndarray) -> list[int | None]:
    """The sum of the squares of every row, exact; None beyond 63 bits."""
    if offsets.dtype == object or int(np.abs(offsets).max(initial=0)) ** 2 * offsets.shape[1] >= 2**63:
        exact = [sum(int(v) ** 2 for v in row) for row in offsets]
        return [v if v < 2**63 else None for v in exact]
    return (offsets * offsets).sum(axis=1).tolist()
