"""Whitening of embeddings by the exact characteristic polynomial of their integer scatter.

Vectors become integers, so the scatter matrix n * sum(x x') - S S' is one of exact integers. Its
characteristic polynomial is found modulo many primes by Hessenberg reduction and put together by
the Chinese remainder theorem. All its roots are real, so the sign changes of a shifted polynomial
count the roots beyond a point exactly; bisection isolates each root to 160 bits. Components are
null vectors of scatter - root * I by inverse iteration in fixed-point integers.

What the driver holds is bounded by the dimension d: d * d sums, the polynomial, and d numbers for
each component. Rows are read three times: for the sums, for the covariance of the whitened values,
and for the result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction
from math import comb, gcd, isqrt, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pagewright.llm.common import slices, widened

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 32
#: Bits of a root behind its leading one, and of the fixed-point numbers of the null-space solver.
ROOT_BITS, SOLVE_BITS = 160, 320
#: Integers beyond this are held to it: such entries are not told apart.
_LARGEST = 1 << 61
_LIMB = 40


# exact sums


def integers(flat: np.ndarray) -> np.ndarray:
    """floor(64 c) of every entry c; SHIFT, which cancels in all that is centred, is left out."""
    return np.clip(np.floor(SCALE * flat.astype(np.float64)), -float(_LARGEST), float(_LARGEST)).astype(np.int64)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return integers(column.flatten().to_numpy(zero_copy_only=False)).reshape(-1, dim)


def gram(x: np.ndarray) -> np.ndarray:
    """x'x in exact integers: products of limbs so small that doubles hold their sums exactly."""
    out = np.zeros((x.shape[1], x.shape[1]), object)
    most = int(np.abs(x).max(initial=0))
    bits = 26 if most < 1 << 26 else 20
    rows = max(1, (1 << 53) // max(1, min(most, 1 << bits) ** 2))
    for k in range(0, len(x), rows):
        limbs, rest = [], x[k : k + rows]
        while True:
            limbs.append((rest & ((1 << bits) - 1) if most >= 1 << bits else rest).astype(np.float64))
            rest = rest >> bits
            if most < 1 << bits or not rest.any():
                break
            if (rest == -1).all() or np.abs(rest).max() < 1 << (bits - 1):
                limbs.append(rest.astype(np.float64))
                break
        for i, a in enumerate(limbs):
            for j, b in enumerate(limbs):
                out += (a.T @ b).astype(np.int64).astype(object) << (bits * (i + j))
    return out


def _limbs(v: int) -> tuple[int, int, int]:
    low = (1 << _LIMB) - 1
    return v & low, (v >> _LIMB) & low, v >> (2 * _LIMB)


def finite(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """Rows whose vector is there and has finite entries alone."""
    return vectors.where(F.col(column).isNotNull() & F.forall(column, lambda c: c.isNotNull() & F.coalesce(F.abs(c.cast("double")) < float("inf"), F.lit(False))))


def _dimension(rows: DataFrame, column: str) -> int:
    sizes = rows.groupBy(F.size(column).alias("d")).agg(F.count("*").alias("n")).where("d > 0")
    first = sizes.orderBy(F.col("n").desc(), F.col("d").desc()).first()
    return first["d"] if first else 0


def _sums(rows: DataFrame, dim: int) -> tuple[int, list[int], np.ndarray]:
    """Number of vectors, sums of each dimension and the matrix of products, exact. Each task gives
    one row for each pair of dimensions, in three limbs that Spark sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, g = 0, np.zeros(dim, object), np.zeros((dim, dim), object)
        for b in slices(batches, 4096):
            x = _matrix(b.column(0), dim)
            n, s, g = n + len(x), s + np.array([sum(c.tolist()) for c in x.T], object), g + gram(x)
        if n:
            cells = [(-1, -1, *_limbs(n)), *((i, -1, *_limbs(int(s[i]))) for i in range(dim)), *((i, j, *_limbs(int(g[i, j]))) for i in range(dim) for j in range(i, dim))]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*cells), (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=["i", "j", "a", "b", "c"])

    cells = rows.mapInArrow(run, "i int, j int, a long, b long, c long").groupBy("i", "j").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum(F.col("c").cast("decimal(38,0)")).alias("c"))
    n, s, g = 0, [0] * dim, np.zeros((dim, dim), object)
    for i, j, a, b, c in cells.collect():  # d * (d + 3) / 2 + 1 rows
        v = a + (b << _LIMB) + (int(c) << (2 * _LIMB))
        if i < 0:
            n = v
        elif j < 0:
            s[i] = v
        else:
            g[i, j] = g[j, i] = v
    return n, s, g


# characteristic polynomial


def primes(bits: int) -> list[int]:
    """The largest primes under 2^31 whose product has so many bits, and one more."""
    out, p, have = [], (1 << 31) - 1, 0
    while have <= bits or not out:
        # these bases decide every number of 32 bits
        odd, twos = p - 1, 0
        while odd % 2 == 0:
            odd, twos = odd // 2, twos + 1
        if all(_passes(p, a, odd, twos) for a in (2, 3, 5, 7)):
            out.append(p)
            have += p.bit_length() - 1
        p -= 2
    while not all(_passes(p, a, *_split(p - 1)) for a in (2, 3, 5, 7)):
        p -= 2
    return [*out, p]


def _split(v: int) -> tuple[int, int]:
    twos = (v & -v).bit_length() - 1
    return v >> twos, twos


def _passes(p: int, base: int, odd: int, twos: int) -> bool:
    x = pow(base, odd, p)
    return x in (1, p - 1) or any((x := x * x % p) == p - 1 for _ in range(twos - 1))


def charpoly_mod(a: np.ndarray, p: int) -> np.ndarray:
    """Coefficients, from the constant one up, of det(xI - a) modulo p < 2^31."""
    h, d = (a % p).astype(np.int64), len(a)
    for k in range(d - 2):
        below = np.flatnonzero(h[k + 1 :, k])
        if not len(below):
            continue
        r = k + 1 + int(below[0])
        if r != k + 1:
            h[[k + 1, r]] = h[[r, k + 1]]
            h[:, [k + 1, r]] = h[:, [r, k + 1]]
        u = h[k + 2 :, k] * pow(int(h[k + 1, k]), -1, p) % p
        h[k + 2 :] = (h[k + 2 :] - u[:, None] * h[k + 1] % p) % p
        h[:, k + 1] = (h[:, k + 1] + (h[:, k + 2 :] * u % p).sum(axis=1)) % p
    polys = np.zeros((d + 1, d + 1), np.int64)
    polys[0, 0] = 1
    for k in range(d):
        # p_k+1 = (x - h_kk) p_k - sum over i of h_ik times the subdiagonal from i to k, times p_i
        q = (np.concatenate(([0], polys[k, :-1])) - h[k, k] * polys[k]) % p
        if k:
            down = np.ones(k, np.int64)
            t = 1
            for i in range(k - 1, -1, -1):
                t = t * int(h[i + 1, i]) % p
                down[i] = t
            c = h[:k, k] * down % p
            q = (q - (c[:, None] * polys[:k] % p).sum(axis=0)) % p
        polys[k + 1] = q
    return polys[d]


def charpoly(spark: SparkSession, a: np.ndarray) -> list[int]:
    """Coefficients of det(xI - a) for a symmetric matrix of integers without negative roots, from
    the constant one up. Primes are dealt out to tasks; one more than needed confirms the result."""
    d = len(a)
    trace = sum(int(a[i, i]) for i in range(d))
    # the k-th elementary symmetric function of roots >= 0 is greatest when all are equal
    bound = max((comb(d, k) * trace**k // d**k).bit_length() for k in range(d + 1)) + 2
    ps = primes(bound)
    held = spark.sparkContext.broadcast(a)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p in b.column(0).to_pylist():
                yield pa.record_batch([pa.array([p], pa.int64()), pa.array([charpoly_mod(held.value, p).tolist()], pa.list_(pa.int64()))], names=["p", "c"])

    tasks = min(len(ps), max(1, spark.sparkContext.defaultParallelism))
    rows = spark.createDataFrame([(p,) for p in ps], "p long").repartition(tasks).mapInArrow(run, "p long, c array<long>").collect()
    residues = {r["p"]: r["c"] for r in rows}
    check, used = ps[-1], ps[:-1]
    modulus = 1
    for p in used:
        modulus *= p
    shares = [(m := modulus // p) * pow(m, -1, p) for p in used]
    out = []
    for k in range(d + 1):
        v = sum(residues[p][k] * s for p, s in zip(used, shares)) % modulus
        v = v - modulus if v > modulus // 2 else v
        if v % check != residues[check][k]:
            raise ArithmeticError("residues of the characteristic polynomial disagree")
        out.append(v)
    return out


# roots


def beyond(poly: list[int], at: int, bits: int) -> int:
    """How many roots of a polynomial with real roots alone exceed at / 2^bits: the sign changes of
    the polynomial shifted there."""
    d = len(poly) - 1
    c = [v << (bits * (d - i)) for i, v in enumerate(poly)]
    for i in range(d):
        for j in range(d - 1, i - 1, -1):
            c[j] += at * c[j + 1]
    signs = [v > 0 for v in c if v]
    return sum(x != y for x, y in zip(signs, signs[1:]))


def _sign(poly: list[int], at: int, bits: int) -> int:
    v, d = 0, len(poly) - 1
    for i in range(d, -1, -1):
        v = v * at + (poly[i] << (bits * (d - i)))
    return (v > 0) - (v < 0)


def root(poly: list[int], place: int, top: int) -> tuple[int, int]:
    """The place-th largest root as at, bits: it lies in (at - 1, at] / 2^bits. poly has no root 0 or
    below, and none above top. Roots that agree in ROOT_BITS bits count as one."""
    lo, hi, bits = 0, top, 0
    above_lo, above_hi = len(poly) - 1, 0
    while above_lo - above_hi > 1 or lo == 0:
        if hi - lo == 1:
            if lo and lo.bit_length() > ROOT_BITS:
                return hi, bits
            lo, hi, bits = 2 * lo, 2 * hi, bits + 1
        mid = (lo + hi) // 2
        n = beyond(poly, mid, bits)
        if n >= place:
            lo, above_lo = mid, n
        else:
            hi, above_hi = mid, n
    right = _sign(poly, hi, bits)
    while hi - lo > 1 or lo.bit_length() <= ROOT_BITS:
        if right == 0:
            return (hi << ROOT_BITS, bits + ROOT_BITS)
        if hi - lo == 1:
            lo, hi, bits = 2 * lo, 2 * hi, bits + 1
        mid = (lo + hi) // 2
        s = _sign(poly, mid, bits)
        if s == right or s == 0:
            hi, right = mid, s
        else:
            lo = mid
    return hi, bits


# components


def null_vectors(a: np.ndarray, at: int, bits: int, many: int) -> list[list[float]]:
    """many orthogonal unit vectors v with a v = at / 2^bits v, by inverse iteration in fixed point."""
    d, unit = len(a), 1 << SOLVE_BITS
    size = max(1, max(abs(int(v)) for v in a.flat)).bit_length()
    m = (a.astype(object) << SOLVE_BITS) >> size
    shift = (at << SOLVE_BITS) >> (bits + size)
    for i in range(d):
        m[i, i] -= shift
    order, factors = list(range(d)), []
    for k in range(d):
        r = k + max(range(d - k), key=lambda i: abs(m[k + i, k]))
        if r != k:
            m[[k, r]] = m[[r, k]]
        if m[k, k] == 0:
            m[k, k] = 1
        f = np.array([(v << SOLVE_BITS) // m[k, k] for v in m[k + 1 :, k]], object)
        if len(f):
            m[k + 1 :, k:] -= (f[:, None] * m[k, k:]) >> SOLVE_BITS
        factors.append((r, f))
    found: list[np.ndarray] = []
    for v in range(many):
        x = np.array([unit // 2 + ((i * 40_503 + v * 30_011 + 12_345) * 2_654_435_761 % (1 << 32) << (SOLVE_BITS - 32)) for i in range(d)], object)
        for _ in range(3):
            for k, (r, f) in enumerate(factors):
                if r != k:
                    x[[k, r]] = x[[r, k]]
                if len(f):
                    x[k + 1 :] -= (f * x[k]) >> SOLVE_BITS
            for k in range(d - 1, -1, -1):
                rest = int((m[k, k + 1 :] * x[k + 1 :]).sum()) >> SOLVE_BITS if k + 1 < d else 0
                x[k] = ((x[k] - rest) << SOLVE_BITS) // m[k, k]
            for _ in range(2):
                x = _scaled(x, unit)
                for y in found:
                    x = x - ((y * (int((x * y).sum()) >> SOLVE_BITS)) >> SOLVE_BITS)
            x = _scaled(x, unit)
        found.append(x)
    out = []
    for x in found:
        first = max(x, key=abs)
        norm = isqrt(int((x * x).sum())) * (1 if first > 0 else -1)
        out.append([int(v) / norm for v in x])
    return out


def _scaled(x: np.ndarray, unit: int) -> np.ndarray:
    """x to length 1 in fixed point."""
    norm = isqrt(int((x * x).sum())) or 1
    return np.array([v * unit // norm for v in x], object)


@dataclass(frozen=True)
class Whitening:
    """n vectors of the fit list, sums of their integers (without SHIFT), components as rows from the
    largest variance down, variances, and their shares of all variance."""

    n: int
    sums: list[int]
    components: list[list[float]]
    variances: list[float]
    explained: list[float]

    @property
    def dim(self) -> int:
        return len(self.sums)

    def values(self, x: np.ndarray) -> np.ndarray:
        """Whitened values of integer vectors."""
        away = self.deviations(x)
        scale = np.array([[c / sqrt(e) for c in row] for row, e in zip(self.components, self.variances)])
        return (away / self.n).astype(np.float64) @ scale.T.reshape(self.dim, -1)

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exact: 64-bit integers if those hold them, else Python's."""
        most = self.n * int(np.abs(x).max(initial=0)) + max(map(abs, self.sums), default=0)
        return x * self.n - np.array(self.sums, np.int64) if most < 1 << 62 else x.astype(object) * self.n - np.array(self.sums, object)


def fit(vectors: DataFrame, column: str = "embedding", components: int = COMPONENTS) -> Whitening | None:
    """Whitening of all rows with a vector of finite entries; None if there is none. Vectors have one
    length, that of most rows (of the longest, if several lengths tie); others have no part in it.
    Components of no variance are left out, so there are as many as the scatter's rank at most."""
    rows = finite(vectors, column).select(F.col(column).cast("array<double>").alias("v"))
    dim = _dimension(rows, "v")
    if not dim:
        return None
    spark = vectors.sparkSession
    n, sums, products = _sums(rows.where(F.size("v") == dim), dim)
    scatter = n * products - np.outer(np.array(sums, object), np.array(sums, object))
    trace = sum(int(scatter[i, i]) for i in range(dim))
    if not trace:
        return Whitening(n, sums, [], [], [])
    common = gcd(*(int(v) for v in scatter.flat))
    scatter = scatter // common
    poly = charpoly(spark, scatter)
    zeros = next(i for i, v in enumerate(poly) if v)
    poly, top = poly[zeros:], trace // common + 1
    many = min(components, len(poly) - 1)
    held = spark.sparkContext.broadcast((scatter, poly, top))

    def isolate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in b.column(0).to_pylist():
                at, bits = root(held.value[1], k, held.value[2])
                yield pa.record_batch([pa.array([k], pa.int32()), pa.array([str(at)]), pa.array([bits], pa.int32())], names=["component", "at", "bits"])

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, many, at, bits in zip(*(c.to_pylist() for c in b.columns)):
                found = null_vectors(held.value[0], int(at), bits, many)
                yield pa.record_batch([pa.array(range(first, first + many), pa.int32()), pa.array(found, pa.list_(pa.float64()))], names=["component", "vector"])

    places = spark.createDataFrame([(k,) for k in range(1, many + 1)], "component int").repartition(many)
    roots = {r["component"]: (int(r["at"]), r["bits"]) for r in places.mapInArrow(isolate, "component int, at string, bits int").collect()}
    groups: list[list[int]] = []
    for k in range(1, many + 1):
        if groups and roots[groups[-1][0]] == roots[k]:
            groups[-1].append(k)
        else:
            groups.append([k])
    wanted = spark.createDataFrame([(g[0], len(g), str(roots[g[0]][0]), roots[g[0]][1]) for g in groups], "component int, many int, at string, bits int").repartition(len(groups))
    found = {r["component"]: r["vector"] for r in wanted.mapInArrow(solve, "component int, vector array<double>").collect()}
    values = [Fraction(roots[k][0] * common, 1 << roots[k][1]) for k in range(1, many + 1)]
    return Whitening(n, sums, [list(found[k]) for k in range(1, many + 1)], [float(v / n**2) for v in values], [float(v / trace) for v in values])


def _fitting(vectors: DataFrame, column: str, model: Whitening) -> DataFrame:
    return finite(vectors, column).where(F.size(column) == model.dim)


def identity_error(vectors: DataFrame, model: Whitening, column: str = "embedding") -> float:
    """Largest absolute entry of the whitened values' covariance minus the identity."""
    k = len(model.components)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k))
        for b in slices(batches, 4096):
            z = model.values(_matrix(b.column(0), model.dim))
            total[0] += z.sum(axis=0)
            total[1:] += z.T @ z
        cells = [(i - 1, j, float(total[i, j])) for i in range(k + 1) for j in range(k)]
        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*cells), (pa.int32(), pa.int32(), pa.float64()))], names=["i", "j", "s"])

    if not k:
        return 0.0
    rows = _fitting(vectors, column, model).select(F.col(column).cast("array<double>"))
    cells = rows.mapInArrow(run, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect()  # k * (k + 1) rows
    total = np.zeros((k + 1, k))
    for i, j, s in cells:
        total[i + 1, j] = s
    mean = total[0] / model.n  # of centred values: zero but for rounding
    return float(np.abs(total[1:] / model.n - np.outer(mean, mean) - np.eye(k)).max())


def whiten(vectors: DataFrame, model: Whitening, column: str = "embedding") -> DataFrame:
    """Rows with a fitting vector, with deviation (null beyond 64 bits) and whitened (one value for
    each component). Columns that clash with the new ones are replaced; repeated rows get equal ones."""
    rows = _fitting(vectors.drop("deviation", "whitened"), column, model).withColumn("pagewright_v", F.col(column).cast("array<double>"))
    kept = vectors.drop("deviation", "whitened").columns
    schema: StructType = widened(rows.select(*kept), "deviation long, whitened array<double>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 4096):
            x = _matrix(b.columns[-1], model.dim)
            away = model.deviations(x)
            if away.dtype == np.int64 and int(np.abs(away).max(initial=0)) ** 2 * model.dim < 1 << 63:
                deviation = (away * away).sum(axis=1).tolist()
            else:
                deviation = [v if v < 1 << 63 else None for v in (sum(int(c) ** 2 for c in row) for row in away)]
            yield pa.record_batch([*b.columns[:-1], pa.array(deviation, pa.int64()), pa.array(list(model.values(x)), pa.list_(pa.float64()))], names=schema.names)

    return rows.mapInArrow(run, schema)


def report(vectors: DataFrame) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error of every row with a
    vector of finite entries and every component of some variance, up to 32. Rows without such a
    vector, and tables without any, give no rows; null ids stay null."""
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    model = fit(rows)
    if model is None:
        return vectors.sparkSession.createDataFrame([], schema)
    error = identity_error(rows, model)
    shares = F.array(*map(F.lit, model.explained)) if model.explained else F.array().cast("array<double>")
    out = whiten(rows, model).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return out.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", F.get(shares, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"))
