"""Whitening of embeddings along the leading principal components, found by spectrum slicing.

Entries become whole numbers, each distinct vector counts once. Spark sums the covariance; what the driver gets has
the size of the dimension squared, whatever the number of rows. There an LDL^T factorization of the covariance
less a shift counts the eigenvalues above the shift (the inertia). Bisection on the counts isolates each
leading eigenvalue; Rayleigh quotient iteration, which converges cubically, finds it inside its interval, and
counts on both sides of what was found certify its number. Eigenvalues that no shift tells apart share an
interval: inverse iteration on a block spans their space.

Defined cases: rows whose vector is null, or holds a null, a value that is not finite or one of 2**46 or more, are
left out; so are empty vectors and those of another length than the longest. Components end where the
eigenvalue is zero to working precision (one distinct vector has none, and then no rows come out). Repeated rows
count once in the fit and are all returned; null ids are kept; an empty table gives no rows. Sums of squares
that no long holds raise an error.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import stored

SCALE, OFFSET, MOST = 64, 1_000_000, 2.0**46
COMPONENTS = 16
#: A part of the matrix's norm under which a pivot, an eigenvalue or a gap counts as none.
EPS = float(np.finfo(float).eps)


def ldl_pivots(a: np.ndarray) -> list[np.ndarray]:
    """The diagonal blocks (one by one or two by two) of an LDL^T factorization of a symmetric matrix.

    The pivot is the largest entry left: a diagonal one, unless one off the diagonal is much larger.
    """
    a, out = np.array(a, dtype=float), []
    bound = (1 + 17**0.5) / 8
    while len(a):
        n = len(a)
        diagonal = np.abs(np.diagonal(a))
        i = int(diagonal.argmax())
        off = np.abs(a - np.diag(np.diagonal(a)))
        p, q = divmod(int(off.argmax()), n)
        picked = [i] if diagonal[i] >= bound * off[p, q] else [p, q]
        rest = np.setdiff1d(np.arange(n), picked)
        block, side = a[np.ix_(picked, picked)], a[np.ix_(rest, picked)]
        out.append(block)
        if not len(rest):
            break
        if len(picked) == 1 and not block[0, 0]:
            out += [np.zeros((1, 1))] * len(rest)  # nothing is left
            break
        left = a[np.ix_(rest, rest)] - side @ np.linalg.solve(block, side.T)
        a = (left + left.T) / 2
    return out


def above(a: np.ndarray, shift: float) -> int:
    """How many eigenvalues of a lie above shift: the positive ones among the pivots of a - shift."""
    count = 0
    for block in ldl_pivots(a - shift * np.eye(len(a))):
        if len(block) == 1:
            count += int(block[0, 0] > 0)
        else:  # by determinant and trace
            det, trace = block[0, 0] * block[1, 1] - block[0, 1] ** 2, block[0, 0] + block[1, 1]
            count += 1 if det < 0 else 2 if trace > 0 else 0
    return count


def _isolated(a: np.ndarray, k: int, low: float, high: float, known: dict[float, int], least: float) -> tuple[float, float, int, int]:
    """An interval with eigenvalue k (from 1, falling) and as few others as shifts `least` apart can leave: low, high, counts above each."""

    def count(x: float) -> int:
        if x not in known:
            known[x] = above(a, x)
        return known[x]

    for x, n in sorted(known.items()):
        if n >= k and x > low:
            low = x
        if n < k and x < high:
            high = x
    while count(low) - count(high) > 1 and high - low > least:
        mid = (low + high) / 2
        low, high = (mid, high) if count(mid) >= k else (low, mid)
    return low, high, count(low), count(high)


def _solved(a: np.ndarray, shift: float, right: np.ndarray) -> np.ndarray:
    """(a - shift)^-1 right, with the shift moved off an eigenvalue where it hits one."""
    norm = np.abs(a).sum(axis=1).max()
    for step in (0.0, 1.0, -2.0, 8.0):
        try:
            found = np.linalg.solve(a - (shift + step * EPS * norm) * np.eye(len(a)), right)
        except np.linalg.LinAlgError:
            continue
        if np.isfinite(found).all():
            return found
    raise ArithmeticError("no shift near an eigenvalue can be solved for")


def _rayleigh(a: np.ndarray, low: float, high: float, others: np.ndarray) -> tuple[float, np.ndarray] | None:
    """The eigenpair inside [low, high] by Rayleigh quotient iteration; None if it leaves the interval."""
    norm = np.abs(a).sum(axis=1).max()
    v = np.random.default_rng(len(a)).standard_normal(len(a))
    shift = (low + high) / 2
    for step in range(60):
        v = v - others @ (others.T @ v)
        v = _solved(a, shift, v / np.linalg.norm(v))
        v -= others @ (others.T @ v)
        v /= np.linalg.norm(v)
        value = float(v @ a @ v)
        if np.linalg.norm(a @ v - value * v) <= 8 * EPS * norm * len(a) ** 0.5:
            break
        # The first steps keep the interval's middle, until the quotient is inside.
        shift = value if step >= 2 and low <= value <= high else (low + high) / 2
    else:
        return None
    return (value, v) if low - 4 * EPS * norm <= value <= high + 4 * EPS * norm else None


def leading_eigenpairs(a: np.ndarray, most: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues of a symmetric matrix without negative ones, falling, and unit eigenvectors as rows; those that are zero to working precision are left out.

    The largest entry of a vector is positive.
    """
    d = len(a)
    norm = float(np.abs(a).sum(axis=1).max()) if d else 0.0
    if not norm:
        return np.zeros(0), np.zeros((0, d))
    floor, top = 16 * d * EPS * norm, norm * (1 + 1e-9)
    least = max(64, 4 * d) * EPS * norm
    known = {top: 0, floor: above(a, floor)}
    values, vectors = [], np.zeros((d, 0))
    while len(values) < min(most, known[floor]):
        k = len(values) + 1
        low, high, n_low, n_high = _isolated(a, k, floor, top, known, least)
        if n_low - n_high == 1:
            found = _rayleigh(a, low, high, vectors)
            while found is None and high - low > least:  # narrower, until the iteration stays inside
                mid = (low + high) / 2
                known[mid] = above(a, mid)
                low, high = (mid, high) if known[mid] >= k else (low, mid)
                found = _rayleigh(a, low, high, vectors)
            found = [found or ((low + high) / 2, _block(a, (low + high) / 2, 1, vectors)[:, 0])]
        else:
            basis = _block(a, (low + high) / 2, n_low - n_high, vectors)
            found = sorted(((float(v @ a @ v), v) for v in basis.T), key=lambda p: -p[0])
        for value, v in found:
            values.append(value)
            vectors = np.column_stack([vectors, v])
        certify(a, values, len(values) - len(found), least)
    values, vectors = np.array(values[:most]), vectors.T[: len(values[:most])]
    largest = np.abs(vectors).argmax(axis=1)
    return values, vectors * np.sign(vectors[np.arange(len(vectors)), largest])[:, None]


def _block(a: np.ndarray, shift: float, n: int, others: np.ndarray) -> np.ndarray:
    """An orthonormal basis of the n eigenvectors nearest to shift, by inverse iteration; turned so that a is diagonal in it."""
    x = np.random.default_rng(n).standard_normal((len(a), n))
    for _ in range(8):
        x = x - others @ (others.T @ x)
        x = np.linalg.qr(_solved(a, shift, np.linalg.qr(x)[0]))[0]
    return x @ np.linalg.eigh(x.T @ a @ x)[1]


def certify(a: np.ndarray, values: list[float], first: int, slack: float) -> None:
    """The values from place `first` on are numbered right: so many eigenvalues lie above them and below their end."""
    up, down = above(a, max(values[first:]) + slack), above(a, min(values[first:]) - slack)
    if not (up <= first and down >= len(values)):
        raise ArithmeticError(f"counts do not certify eigenvalues {first + 1} to {len(values)}: {up} above, {down} with them")


@dataclass
class Whitening:
    """What a fit found; its size depends on the dimension alone."""

    n: int
    sums: np.ndarray  # of whole numbers, exact
    trace: float
    values: np.ndarray
    vectors: np.ndarray

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whitened coordinates of rows of whole numbers."""
        return centred(x, self.n, self.sums) @ (self.vectors / np.sqrt(self.values)[:, None]).T


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x - sums / n with one rounding: whole means are taken off as whole numbers."""
    whole = sums // n
    return (x - whole) - (sums - whole * n) / n


def whole_numbers(vector: Column) -> Column:
    return F.transform(vector, lambda c: F.floor(SCALE * c.cast("double")).cast("long") + OFFSET)


def usable(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """rows with x in place of the vector; rows without a usable one are left out."""
    number = lambda c: c.cast("double")
    good = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(number(c)) & (F.abs(number(c)) < MOST))
    kept = rows.filter(F.col(vector).isNotNull() & (F.size(vector) > 0) & F.coalesce(good, F.lit(False)))
    longest = kept.agg(F.max(F.size(vector))).first()[0] or 0
    return kept.filter(F.size(vector) == longest).withColumn("x", whole_numbers(F.col(vector)))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.int64)


def _products(x: DataFrame, d: int, rows_of) -> np.ndarray:
    """Sum of r r^T over r = rows_of(x): each task adds its own up, and tasks' sums are added entry by entry."""

    def add(batches):
        total = None
        for pdf in batches:
            if len(pdf):
                r = rows_of(_matrix(pdf["x"]))
                total = r.T @ r if total is None else total + r.T @ r
        if total is not None:
            yield pd.DataFrame({"i": np.arange(total.size), "v": total.ravel()})

    sums = x.select("x").mapInPandas(add, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).toPandas()  # d * d rows
    out = np.zeros(d * d)
    out[sums["i"].to_numpy()] = sums["v"].to_numpy()
    return out.reshape(d, d)


def fit_whitening(rows: DataFrame, components: int = COMPONENTS) -> tuple[Whitening | None, float]:
    """The whitening of the distinct x of rows, and the largest distance of the whitened covariance from the identity."""
    x = stored(rows.select("x").distinct())
    first = x.select(F.size("x")).first()
    if first is None:
        return None, 0.0
    d = first[0]
    sums = x.agg(F.count("*"), *[F.sum(F.col("x")[i]) for i in range(d)]).first()
    n, sums = int(sums[0]), np.array(sums[1:], dtype=np.int64)
    covariance = _products(x, d, lambda v: centred(v, n, sums)) / n
    values, vectors = leading_eigenpairs(covariance, components)
    found = Whitening(n, sums, float(np.trace(covariance)), values, vectors)
    k = len(values)
    whitened = _products(x, k, found.project) / n if k else np.zeros((0, 0))
    return found, float(np.abs(whitened - np.eye(k)).max(initial=0.0))


def whiten(rows: DataFrame, fit: Whitening) -> DataFrame:
    """rows (with x) and whitened: array<double>, one entry for each component."""

    @F.pandas_udf("array<double>")
    def project(x: pd.Series) -> pd.Series:
        return pd.Series(list(fit.project(_matrix(x)))) if len(x) else pd.Series([], dtype=object)

    return rows.withColumn("whitened", project("x"))


def deviation(x: Column, fit: Whitening) -> Column:
    """Sum over dimensions of (n * x - sum)^2, in longs."""
    sums = F.array(*[F.lit(int(s)) for s in fit.sums])
    return F.aggregate(F.zip_with(x, sums, lambda c, s: (fit.n * c - s) * (fit.n * c - s)), F.lit(0).cast("long"), lambda total, y: total + y)


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = usable(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")).select("vec_id", "x")
    fit, error = fit_whitening(rows)
    if fit is None or not len(fit.values):
        return spark.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    explained = F.array(*[F.lit(float(e / fit.trace)) for e in fit.values])
    each = whiten(rows.withColumn("deviation", deviation(F.col("x"), fit)), fit).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return each.select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(fit.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(explained, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"),
    )
