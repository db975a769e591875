"""KMeans distance outliers and PCA concept drift on numeric plant columns.

KMeans is seeded by k-means|| with draws from row hashes and refined by Lloyd steps, each one aggregate.  Standardised values
are whole numbers of 1e-9 and all sums over rows are sums of whole numbers, so the clusters do
not hang on how rows are partitioned.  The rows are read some thirty times, so they are stored as blocks of ``BLOCK_ROWS``
rows, a block's columns as one binary value, which a pass reads without turning rows into columns again.  PCA
drift needs only the d x d covariance of each half: one pass in which every task sums up its rows' counts, means and
products (2 rows a task, d <= a few dozen columns), then the eigenvalues of that small matrix on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millwright.functions.common import ensure_parallel
from millwright.functions.quantiles import exact_quantiles
from millwright.session import written

SEED = 42
UNIT = 1e-9
SEED_ROUNDS, LLOYD_ROUNDS = 4, 20
BLOCK_ROWS = 1 << 11
CONSTANT_SD = 1e-12  # a column whose sd is below this share of its mean counts as constant


def standardize(df: DataFrame, cols: list[str]) -> DataFrame:
    """(x - mean) / population sd per column; constant columns become 0 (as StandardScaler)."""
    st = df.select(F.struct(*[F.struct(F.avg(c).alias("m"), F.stddev_pop(c).alias("s")).alias(f"c{i}")
                              for i, c in enumerate(cols)])).scalar()
    out = {}
    for i, c in enumerate(cols):
        s = st.getField(f"c{i}")
        sd = s.getField("s")
        out[c] = F.when(sd > 0, (F.col(c).cast("double") - s.getField("m")) / sd).otherwise(F.lit(0.0))
    return df.withColumns(out)


def _units(df: DataFrame, cols: list[str]) -> DataFrame:
    """(c0, c1, ..., _id): standardised values as whole numbers of UNIT, and a hash of the row.

    Mean and deviation are read to 12 digits, below which the order of a sum shows.
    """
    st = df.agg(*[f(F.col(c)).alias(f"{n}{i}") for i, c in enumerate(cols) for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    digits = lambda v: float(f"{v:.12g}")
    out = []
    for i, c in enumerate(cols):
        mean, sd = digits(st[f"m{i}"]), digits(st[f"s{i}"])
        flat = sd <= CONSTANT_SD * abs(mean)
        out.append((F.lit(0) if flat else F.round((F.col(c) - F.lit(mean)) / F.lit(sd) / UNIT)).cast("long").alias(f"c{i}"))
    z = df.select(*out)
    return z.withColumn("_id", F.xxhash64(*z.columns))


def _distances(x: np.ndarray, centers: list[list[int]]) -> np.ndarray:
    """(center, row): squared standardised distances, column by column, so that a row's value hangs on nothing else."""
    out = np.zeros((len(centers), len(x)))
    for j, center in enumerate(centers):
        for i, v in enumerate(center):
            gap = (x[:, i] - v) * UNIT
            out[j] += gap * gap
    return out


def _blocks(z: DataFrame, d: int, seed: int = SEED) -> DataFrame:
    """(x, h, u): rows of ``_units`` as blocks: column by column their d values, hashes, and a number in [0, 1) for each seeding round."""
    if "x" in z.columns:
        return z
    u = [F.pmod(F.xxhash64(F.lit(seed + 1 + step), "_id"), F.lit(1 << 52)) / float(1 << 52) for step in range(SEED_ROUNDS)]
    rows = z.select(*[f"c{i}" for i in range(d)], F.xxhash64(F.lit(seed), "_id").alias("h"), *[v.alias(f"u{s}") for s, v in enumerate(u)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                cols = [c.to_numpy().tobytes() for c in batch.slice(at, BLOCK_ROWS).columns]
                yield pa.RecordBatch.from_arrays([pa.array([b"".join(part)], pa.binary()) for part in (cols[:d], cols[d : d + 1], cols[d + 1 :])], ["x", "h", "u"])

    return rows.mapInArrow(run, "x binary, h binary, u binary")


def _values(column: pa.Array, kind: type = np.int64, d: int = 1) -> Iterator[np.ndarray]:
    """(value, row) arrays of a column of blocks."""
    for block in column:
        yield np.frombuffer(block.as_buffer(), kind).reshape(d, -1)


def _passed(z: DataFrame, d: int, partial) -> dict[tuple[int, int], int]:
    """One pass over the rows: ``partial(x)`` gives {(a, b): whole number} of a batch; their sums over all batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], int] = {}
        for batch in batches:
            for x in _values(batch.column(0), d=d):
                for key, v in partial(x.T).items():
                    total[key] = total.get(key, 0) + int(v)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in total], pa.int32()), pa.array([k[1] for k in total], pa.int32()), pa.array([str(v) for v in total.values()], pa.string())], ["a", "b", "v"])

    parts = _blocks(z, d).select("x").mapInArrow(run, "a int, b int, v string")
    rows = parts.groupBy("a", "b").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect()
    return {(r["a"], r["b"]): int(r["v"]) for r in rows}


def _units_of(x: np.ndarray) -> int:
    """A sum of whole UNITs, which no order changes."""
    units = np.rint(x / UNIT).astype(np.int64)
    return sum(units.tolist()) if len(x) and x.max() * len(x) > 1e9 else int(units.sum())


def seed_centers(z: DataFrame, d: int, k: int, seed: int = SEED) -> list[list[int]]:
    """k-means||: each round takes every row with probability 2 k times its share of the squared distances; the candidates, weighted
    by the rows nearest to them, are thinned to k by taking the one farthest from those taken, by weight, again and again."""
    names, z = [f"c{i}" for i in range(d)], _blocks(z, d, seed)
    schema = ", ".join(f"{c} long" for c in names)
    rows_of = lambda x: pa.RecordBatch.from_arrays([pa.array(v) for v in x], names)

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = None
        for batch in batches:
            for x, h in zip(_values(batch.column(0), d=d), _values(batch.column(1))):
                best = min(best or (np.inf,), *((h.min(), *map(int, row)) for row in x[:, h[0] == h.min()].T))
        if best is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], pa.int64()) for v in best], ["h", *names])

    first = z.select("x", "h").mapInArrow(least, f"h long, {schema}").orderBy("h", *names).first()
    centers = [[first[c] for c in names]]
    for step in range(SEED_ROUNDS):
        held = list(centers)
        total = _passed(z, d, lambda x, c=held: {(0, 0): _units_of(_distances(x, c).min(axis=0))}).get((0, 0), 0)
        if not total:
            break
        factor = 2.0 * k / (total * UNIT)

        def drawn(batches: Iterator[pa.RecordBatch], c=held, factor=factor, step=step) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for x, u in zip(_values(batch.column(0), d=d), _values(batch.column(1), np.float64, SEED_ROUNDS)):
                    yield rows_of(x[:, u[step] < _distances(x.T, c).min(axis=0) * factor])

        rows = z.select("x", "u").mapInArrow(drawn, schema).distinct()  # about 2 k of them
        centers += sorted([r[c] for c in names] for r in rows.collect())
    weight = _passed(z, d, lambda x: {(int(j), 0): n for j, n in zip(*np.unique(_distances(x, centers).argmin(axis=0), return_counts=True))})
    far = lambda a, b: sum(((x - y) * UNIT) ** 2 for x, y in zip(a, b))
    taken = [max(range(len(centers)), key=lambda j: (weight.get((j, 0), 0), -j))]
    while len(taken) < min(k, len(centers)):
        taken.append(max(range(len(centers)), key=lambda j: (weight.get((j, 0), 0) * min(far(centers[j], centers[t]) for t in taken), -j)))
    return [centers[t] for t in taken]


def lloyd(z: DataFrame, d: int, centers: list[list[int]]) -> list[list[int]]:
    """Centers moved to the mean of their rows until they stay (LLOYD_ROUNDS at most); one without rows stays."""

    def sums(x: np.ndarray) -> dict[tuple[int, int], int]:
        nearest, out = _distances(x, centers).argmin(axis=0), {}
        for j in range(len(centers)):
            mine = x.T[:, nearest == j]
            large = mine.size and max(mine.max(), -mine.min()) > 1 << 40
            out |= {(j, i): v for i, v in enumerate(mine.astype(object).sum(axis=1) if large else mine.sum(axis=1))} | {(j, d): mine.shape[1]}
        return out

    z = _blocks(z, d)
    for _ in range(LLOYD_ROUNDS):
        found = _passed(z, d, sums)
        moved = [[round(found[j, i] / found[j, d]) for i in range(d)] if found.get((j, d)) else old for j, old in enumerate(centers)]
        if moved == centers:
            break
        centers = moved
    return centers


def kmeans_far(df: DataFrame, cols: list[str], seed: int = SEED) -> DataFrame:
    """V9: KMeans (k = min(3, max(2, n // 5))) on standardised rows; count rows farther than mean + 2 sd."""
    num = df.select(*[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(cols)]).dropna()
    n = num.count()
    if len(cols) < 2 or n < 20:
        return df.sparkSession.createDataFrame([(n, None, None, False)], "rows bigint, k int, far_from_cluster bigint, ok boolean")
    k = min(3, max(2, n // 5))
    # every round reads the rows again: computed once, as a table in the shared checkpoint folder
    z = written(_blocks(ensure_parallel(_units(num, [f"x{i}" for i in range(len(cols))])), len(cols), seed), "kmeans-rows")
    centers = lloyd(z, len(cols), seed_centers(z, len(cols), k, seed))

    def moments(x: np.ndarray) -> dict[tuple[int, int], int]:
        square = _distances(x, centers).min(axis=0)
        return {(0, 0): _units_of(np.sqrt(square)), (0, 1): _units_of(square)}

    st = _passed(z, len(cols), moments)
    mean = st[0, 0] * UNIT / n
    cut = mean + 2.0 * max(0.0, st[0, 1] * UNIT / n - mean * mean) ** 0.5
    far = _passed(z, len(cols), lambda x: {(0, 0): (np.sqrt(_distances(x, centers).min(axis=0)) > cut).sum()})
    return df.sparkSession.createDataFrame([(n, k, far[0, 0], True)], "rows bigint, k int, far_from_cluster bigint, ok boolean")


def _joined(a: tuple[int, np.ndarray, np.ndarray], b: tuple[int, np.ndarray, np.ndarray]) -> tuple[int, np.ndarray, np.ndarray]:
    """(rows, means, sums of products of differences from the means) of two sets of rows as one."""
    n, gap = a[0] + b[0], b[1] - a[1]
    return n, a[1] + gap * (b[0] / n), a[2] + b[2] + np.outer(gap, gap) * (a[0] * b[0] / n)


def _moments(df: DataFrame, cols: list[str]) -> dict[int, tuple[int, np.ndarray, np.ndarray]]:
    """{_half: (rows, means, products)} of complete rows; a task hands over one row for each half."""
    d = len(cols)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, tuple[int, np.ndarray, np.ndarray]] = {}
        for batch in batches:
            x = np.stack([batch.column(c).to_numpy() for c in cols])
            half = batch.column("_half").to_numpy(zero_copy_only=False)
            for h in (0, 1):
                mine = x[:, half == h]
                if mine.shape[1]:
                    mean = mine.mean(axis=1)
                    off = mine - mean[:, None]
                    part = (mine.shape[1], mean, off @ off.T)
                    seen[h] = _joined(seen[h], part) if h in seen else part
        for h, (n, mean, products) in seen.items():
            yield pa.RecordBatch.from_pydict({"half": pa.array([h], pa.int32()), "n": pa.array([n], pa.int64()), "m": pa.array([mean.tolist()]), "p": pa.array([products.ravel().tolist()])})

    out: dict[int, tuple[int, np.ndarray, np.ndarray]] = {}
    parts = df.mapInArrow(run, "half int, n long, m array<double>, p array<double>").collect()
    for r in sorted(parts, key=lambda r: (r["half"], r["n"], r["m"], r["p"])):
        part = (r["n"], np.array(r["m"]), np.array(r["p"]).reshape(d, d))
        out[r["half"]] = _joined(out[r["half"]], part) if r["half"] in out else part
    return out


def pca_drift(df: DataFrame, cols: list[str], order_col: str, n_comp: int = 3, threshold: float = 0.15) -> DataFrame:
    """Explained variance of the top components, early half vs late half; drift > 0.15 flags.

    Halves split at the median of ``order_col`` (rows on the median value go early).
    """
    num = df.select(F.col(order_col).alias("_o"), *[F.col(c).cast("double").alias(c) for c in cols]).dropna()
    spark = df.sparkSession
    nothing = spark.createDataFrame([(None, None, None, None, False)],
                                    "pca_var_early double, pca_var_late double, drift_score double, concept_drift boolean, ok boolean")
    if len(cols) < 2:
        return nothing
    dt = num.schema["_o"].dataType
    if isinstance(dt, T.DateType):
        okey = F.datediff(F.col("_o"), F.lit("1970-01-01").cast("date")).cast("double")
    elif isinstance(dt, (T.TimestampType, T.TimestampNTZType)):
        okey = F.unix_timestamp(F.col("_o").cast("timestamp")).cast("double")
    else:
        okey = F.col("_o").cast("double")
    num = num.withColumn("_k", okey)
    med = exact_quantiles(num, {"k": F.col("_k")}, [0.5])["k"][0]
    mom = _moments(num.select((F.col("_k") > F.lit(med)).cast("int").alias("_half"), *cols), cols)
    if sum(n for n, _, _ in mom.values()) < 30:
        return nothing
    ratios = []
    d = len(cols)
    for h in (0, 1):
        n, m, products = mom.get(h, (0, None, None))
        if n < 2:
            ratios.append(None)
            continue
        cov = products / n
        sd = np.sqrt(np.clip(np.diag(cov), 0, None))
        flat = sd <= CONSTANT_SD * np.abs(m)
        scale = np.where(flat, 1.0, sd)
        corr = cov / np.outer(scale, scale)
        corr[flat, :] = 0.0
        corr[:, flat] = 0.0
        ev = np.sort(np.clip(np.linalg.eigvalsh(corr), 0, None))[::-1]
        tot = ev.sum()
        ratios.append(float(ev[: min(n_comp, d)].sum() / tot) if tot > 0 else None)
    early, late = ratios
    drift = abs(early - late) if early is not None and late is not None else None
    return spark.createDataFrame(
        [(early, late, drift, (drift is not None and drift > threshold), early is not None and late is not None)],
        "pca_var_early double, pca_var_late double, drift_score double, concept_drift boolean, ok boolean",
    )
