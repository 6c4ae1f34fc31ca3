"""Dataset-level statistics and exploratory factors: aggregates run on executors, p x p algebra on the driver."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import taxonomy


def missing_rates(df: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, missing_rate) in one aggregate."""
    row = df.agg(*[F.avg(F.col(c).isNull().cast("int")).alias(c) for c in columns])
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("missing_rate")) for c in columns])).alias("x")).select("x.*")


def kept_features(df: DataFrame, columns: list[str], threshold: float = 0.3) -> list[str]:
    """Columns whose share of nulls is under the threshold, strictly."""
    rates = {x.feature: x.missing_rate for x in missing_rates(df, columns).collect()}
    return [c for c in columns if rates[c] is not None and rates[c] < threshold]


def kept(df: DataFrame) -> DataFrame:
    """df, written to the executors' disks when first computed: statistics and what they are applied to are one computation."""
    return df if df.is_cached else df.persist(StorageLevel.DISK_ONLY)


#: Most distinct values of a column that medians() looks at on the driver.
BRACKET = 50_000


def _quantiles(c: str, lo: float, hi: float):
    return F.percentile_approx(c, [min(1.0, max(0.0, x)) for x in (lo, hi)], 1000)


def medians(df: DataFrame, columns: list[str], brackets: dict[str, tuple[int, list]] | None = None, most: int = BRACKET) -> dict[str, float | None]:
    """Exact medians without any task that sees a column's values whole: approximate quantiles bracket the middle, the values
    below a bracket are counted and only those inside it are looked at. A bracket that holds over `most` values is narrowed
    in the same way, one that misses the middle is widened. df is read several times: let it be kept().

    brackets: of each column how many values it has, and a first bracket, if they are known."""
    out: dict[str, float | None] = {}
    if brackets is None:
        df = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
        row = df.agg(*[f.alias(f"{k}{i}") for i, c in enumerate(columns) for k, f in (("n", F.count(c)), ("q", _quantiles(c, 0.498, 0.502)))]).first()
        brackets = {c: (row[f"n{i}"], row[f"q{i}"]) for i, c in enumerate(columns)}
    out |= {c: None for c, (n, _) in brackets.items() if not n}
    open_ = {c: (n, *map(float, q)) for c, (n, q) in brackets.items() if n}
    while open_:
        names = list(open_)
        x = lambda c: F.col(c).cast("double")
        inside = lambda c: (x(c) >= F.lit(open_[c][1])) & (x(c) <= F.lit(open_[c][2]))
        row = df.agg(*[F.count_if(e).alias(f"{k}{i}") for i, c in enumerate(names) for k, e in (("b", x(c) < F.lit(open_[c][1])), ("i", inside(c)))]).first()
        ready, narrow = {}, {}
        for i, c in enumerate(names):
            n, lo, hi = open_[c]
            below, held, ranks = row[f"b{i}"], row[f"i{i}"], ((n - 1) // 2, n // 2)
            if ranks[0] < below:
                open_[c] = n, -math.inf, hi
            elif ranks[1] >= below + held:
                open_[c] = n, lo, math.nan  # Spark's greatest
            elif lo == hi:
                out[c] = lo
                del open_[c]
            elif held > most:
                # the sketch is right to a thousandth
                narrow[c] = below, (ranks[0] - below) / held - 0.002, (ranks[1] - below + 1) / held + 0.002
            else:
                ready[c] = tuple(r - below for r in ranks)
        if narrow:
            row = df.agg(*[_quantiles(F.when(inside(c), x(c)), *q).alias(f"q{i}") for i, (c, (_, *q)) in enumerate(narrow.items())]).first()
            for i, (c, (below, *_)) in enumerate(narrow.items()):
                (n, *old), new = open_[c], list(map(float, row[f"q{i}"]))
                if np.array_equal(old, new, equal_nan=True):
                    # a few values that are there many times each hold the bracket open: they are looked at by their numbers
                    ready[c] = (n - 1) // 2 - below, n // 2 - below
                else:
                    open_[c] = n, *new
        if ready:
            each = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.when(inside(c), x(c)).alias("x")) for c in ready])).alias("e")
            found: dict[str, list] = {c: [] for c in ready}
            for r in df.select(each).select("e.*").where("x IS NOT NULL").groupBy("c", "x").count().collect():
                found[r[0]].append((r[1], r[2]))
            for c, (a, b) in ready.items():
                values = sorted(found[c], key=lambda v: (math.isnan(v[0]), v[0]))
                ends = np.cumsum([v[1] for v in values])
                lower, upper = (values[int(np.searchsorted(ends, r, side="right"))][0] for r in (a, b))
                out[c] = lower if lower == upper else 0.5 * lower + 0.5 * upper
                del open_[c]
    return out


def impute(df: DataFrame, columns: list[str]) -> DataFrame:
    """Nulls become the column's exact median; an all-null column stays null. df is kept()."""
    df = kept(df)
    med = medians(df, columns)
    return df.select(*[c for c in df.columns if c not in columns], *[F.coalesce(F.col(c), F.lit(med[c])).cast("double").alias(c) for c in columns])


def moments(df: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    row = df.agg(*[f(c).alias(f"{k}_{i}") for i, c in enumerate(columns) for k, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    return {c: (row[f"m_{i}"], row[f"s_{i}"] or 1.0) for i, c in enumerate(columns)}


def scale(df: DataFrame, columns: list[str], fitted: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """(x - mean) / population deviation; a constant column is only centred."""
    m = fitted or moments(df, columns)
    return df.select(*[c for c in df.columns if c not in columns], *[((F.col(c) - F.lit(m[c][0])) / F.lit(m[c][1])).alias(c) for c in columns])


@dataclass(frozen=True)
class Statistic:
    """Of one column: its share of nulls, its median, and mean and deviation once nulls are its median."""

    missing: float
    median: float | None
    mean: float | None
    scale: float


def statistics(df: DataFrame, columns: list[str]) -> dict[str, Statistic]:
    """Every column's Statistic: one aggregate, from which the moments after imputation follow, and the medians. df is kept()."""
    df = kept(df)
    facts = {"n": lambda c: F.count(c), "k": lambda c: F.sum(F.col(c).isNull().cast("long")), "q": lambda c: _quantiles(F.col(c).cast("double"), 0.498, 0.502), "avg": F.avg, "var": F.var_pop}
    row = df.agg(*[f(c).alias(f"{k}{i}") for i, c in enumerate(columns) for k, f in facts.items()]).first()
    out, middle = {}, medians(df, columns, {c: (row[f"n{i}"], row[f"q{i}"]) for i, c in enumerate(columns)})
    for i, c in enumerate(columns):
        n, k, _, avg, var = (row[f"{x}{i}"] for x in facts)
        med = middle[c]
        if not n:
            out[c] = Statistic(1.0 if k else 0.0, None, None, 1.0)
            continue
        mean = (n * avg + k * med) / (n + k)
        spread = (n * (var + (avg - mean) ** 2) + k * (med - mean) ** 2) / (n + k)
        # a constant column is only centred; sums of equal numbers may be off by rounding
        out[c] = Statistic(k / (n + k), float(med), mean, math.sqrt(spread) if spread > 1e-24 * max(1.0, mean * mean) else 1.0)
    return out


def transform(df: DataFrame, stats: dict[str, Statistic]) -> DataFrame:
    """Nulls become the median, then (x - mean) / deviation: one projection. An all-null column stays null."""
    done = [((F.coalesce(F.col(c), F.lit(s.median)) - F.lit(s.mean)) / F.lit(s.scale)).cast("double").alias(c) for c, s in stats.items()]
    return df.select(*[c for c in df.columns if c not in stats], *done)


def prepare(df: DataFrame, keys: list[str], leave_out=taxonomy.LEFT_OUT, missing: float = 0.3) -> tuple[DataFrame, dict[str, Statistic]]:
    """(df of the keys and the scaled features, their statistics): the taxonomy's features without those to leave out and
    without columns of which `missing` or more are null."""
    stats = {c: s for c, s in statistics(df, list(taxonomy.select_features(df.columns, leave_out))).items() if s.missing < missing and s.median is not None}
    return transform(df.select(*keys, *stats), stats), stats


def fit_factors(df: DataFrame, keys: list[str], k: int, **options) -> dict:
    """What fit() gives, for the features that prepare() keeps, with: stats; loadings (feature, category, F1..Fk; by category,
    then feature) and variance (factor, SS_loadings, pct_var, cumulative_pct) as tables; scores (keys, F1..Fk) of df."""
    scaled, stats = prepare(df, keys, **options)
    columns = list(stats)
    model = fit(correlation_matrix(scaled, columns)[0], columns, k)
    spark, names = df.sparkSession, [f"F{j + 1}" for j in range(k)]
    rows = sorted((c, taxonomy.CATEGORY[c], *map(float, model["pattern"][i])) for i, c in enumerate(columns))
    rows.sort(key=lambda x: x[1])
    loadings = spark.createDataFrame(rows, "feature string, category string" + "".join(f", {f} double" for f in names))
    variance = spark.createDataFrame([(f, *(float(model[x][j]) for x in ("ss_loadings", "pct_var", "cumulative_pct"))) for j, f in enumerate(names)], "factor string, SS_loadings double, pct_var double, cumulative_pct double")
    return model | {"stats": stats, "loadings": loadings, "variance": variance, "scores": scores(scaled, columns, model["weights"], keys)}


def apply_factors(df: DataFrame, model: dict, keys: list[str], impute: str = "new") -> DataFrame:
    """keys and F1..Fk of new documents under a fitted model: its means, deviations and weights; nulls become the new data's
    medians or, with impute "train", the model's. A column that is null throughout stays null under "new"."""
    if impute not in ("new", "train"):
        raise ValueError(f"impute is new or train, not {impute!r}")
    stats = model["stats"]
    if impute == "new":
        df = kept(df)
        middle = medians(df, list(stats))
        stats = {c: replace(s, median=middle[c]) for c, s in stats.items()}
    return scores(transform(df.select(*keys, *stats), stats), model["columns"], model["weights"], keys)


def described_loadings(model: dict, n: int = 6) -> DataFrame:
    """factor, feature, loading, rank, category and the factor's variance columns: each factor's n largest loadings."""
    names = model["variance"].select("factor")
    k = names.count()
    long = model["loadings"].select("feature", "category", F.inline(F.array(*[F.struct(F.lit(f"F{j + 1}").alias("factor"), F.col(f"F{j + 1}").alias("loading")) for j in range(k)])))
    return top_loadings(long, n).join(F.broadcast(model["variance"]), "factor")


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, r) of every pair in the order of columns; null where one of them is constant."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    row = df.agg(*[F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    return row.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{i}").alias("r")) for i, (a, b) in enumerate(pairs)])).alias("x")).select("x.*")


def correlation_matrix(df: DataFrame, columns: list[str]) -> tuple[np.ndarray, int]:
    """(correlations, rows) from sums of products per task: one matrix of p x p for each reaches the driver by a tree of
    sums. Columns must be about centred and scaled, as transform() leaves them, and without nulls."""
    import pyarrow as pa

    p = len(columns)

    def run(batches):
        total = np.zeros((p + 1, p + 1))
        for b in batches:
            x = np.column_stack([*(c.to_numpy(zero_copy_only=False) for c in b.columns), np.ones(b.num_rows)])
            total += x.T @ x
        yield pa.record_batch([pa.array(np.arange((p + 1) ** 2), pa.int32()), pa.array(total.ravel())], names=["at", "x"])

    sums = df.select(*[F.col(c).cast("double") for c in columns]).mapInArrow(run, "at int, x double").groupBy("at").agg(F.sum("x").alias("x"))
    g = np.zeros((p + 1) ** 2)
    for x in sums.collect():
        g[x["at"]] = x["x"]
    g = g.reshape(p + 1, p + 1)
    n = g[p, p]
    if not n:
        return np.eye(p), 0
    mean = g[:p, p] / n
    cov = g[:p, :p] / n - np.outer(mean, mean)
    d = np.sqrt(np.maximum(np.diag(cov), 0))
    with np.errstate(invalid="ignore", divide="ignore"):
        r = np.where(np.outer(d, d) > 0, cov / np.outer(d, d), np.nan)
    np.fill_diagonal(r, 1.0)
    return r, int(n)


def chi2_tail(x: float, df: float) -> float:
    """Upper tail of chi-square: the regularised incomplete gamma by series, or by Lentz's continued fraction."""
    a, x = df / 2, x / 2
    if x <= 0:
        return 1.0
    front = math.exp(max(-745.0, a * math.log(x) - x - math.lgamma(a)))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while term > total * 1e-15:
            k += 1
            term *= x / k
            total += term
        return 1 - front * total
    b, c, d = x + 1 - a, 1e300, 1 / (x + 1 - a)
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * h


def adequacy(r: np.ndarray, n: int) -> dict[str, float]:
    """Kaiser-Meyer-Olkin measure and Bartlett's test of sphericity."""
    p = len(r)
    inverse = np.linalg.pinv(r)
    d = np.sqrt(np.diag(inverse))
    partial = -inverse / np.outer(d, d)
    off = ~np.eye(p, dtype=bool)
    a, b = (r[off] ** 2).sum(), (partial[off] ** 2).sum()
    chi2 = -(n - 1 - (2 * p + 5) / 6) * np.linalg.slogdet(r)[1]
    return {"kmo": float(a / (a + b)), "bartlett_chi2": float(chi2), "bartlett_p": float(chi2_tail(float(chi2), p * (p - 1) / 2))}


def random_correlations(n: int, p: int, seed, rows: int = 65_536) -> np.ndarray:
    """Correlations of n rows of p independent normal numbers, of which `rows` rows are drawn at once: the generator goes on, so
    the numbers do not depend on it. They are centred and scaled already, so sums of products lose nothing."""
    rng, total, products = np.random.default_rng(seed), np.zeros(p), np.zeros((p, p))
    for at in range(0, n, rows):
        x = rng.standard_normal((min(rows, n - at), p))
        total += x.sum(0)
        products += x.T @ x
    with np.errstate(invalid="ignore", divide="ignore"):
        cov = products - np.outer(total, total) / n
        d = np.sqrt(np.diag(cov))
        return cov / np.outer(d, d)


def parallel_analysis(spark: SparkSession, r: np.ndarray, n: int, draws: int = 500, percentile: float = 95, seed: int = 2001) -> DataFrame:
    """(factor, eigenvalue, pa_threshold, retained): eigenvalues against those of random normal data.

    Draws are independent tasks, each seeded by its own number, so the result does not depend on partitions."""
    import pyarrow as pa

    p = len(r)

    def run(batches):
        for b in batches:
            rank, value = [], []
            for i in b.column(0).to_pylist():
                value += sorted(np.linalg.eigvalsh(random_correlations(n, p, [seed, i])).tolist(), reverse=True)
                rank += range(1, p + 1)
            yield pa.record_batch([pa.array(rank, pa.int32()), pa.array(value, pa.float64())], names=["factor", "value"])

    thresholds = spark.range(draws).mapInArrow(run, "factor int, value double").groupBy("factor").agg(F.percentile("value", percentile / 100).alias("pa_threshold"))
    eig = spark.createDataFrame([(i + 1, float(v)) for i, v in enumerate(sorted(np.linalg.eigvalsh(r), reverse=True))], "factor int, eigenvalue double")
    return eig.join(F.broadcast(thresholds), "factor").withColumn("retained", F.col("eigenvalue") > F.col("pa_threshold"))


def minres(r: np.ndarray, k: int, rounds: int = 500, tolerance: float = 1e-9) -> np.ndarray:
    """Loadings by iterated principal axes, which reach the minimum-residual solution."""
    h = 1 - 1 / np.diag(np.linalg.pinv(r))
    for _ in range(rounds):
        reduced = r.copy()
        np.fill_diagonal(reduced, h)
        value, vector = np.linalg.eigh(reduced)
        top = np.argsort(value)[::-1][:k]
        load = vector[:, top] * np.sqrt(np.maximum(value[top], 0))
        new = np.clip((load**2).sum(1), 0, 0.999)
        if np.abs(new - h).max() < tolerance:
            break
        h = new
    return load


def oblimin(a: np.ndarray, rounds: int = 2000, tolerance: float = 1e-6) -> tuple[np.ndarray, np.ndarray]:
    """Direct quartimin by gradient projection over oblique rotations, Kaiser-normalised: (pattern, factor correlations)."""
    p, k = a.shape
    if k == 1:
        return a, np.eye(1)
    weight = np.sqrt(np.maximum((a**2).sum(1), 1e-12))[:, None]
    a = a / weight
    others = np.ones((k, k)) - np.eye(k)

    def criterion(load):
        sq = load**2
        return (sq * (sq @ others)).sum() / 4, load * (sq @ others)

    t, step = np.eye(k), 1.0
    load = a @ np.linalg.inv(t).T
    f, g = criterion(load)
    for _ in range(rounds):
        grad = -(load.T @ g @ np.linalg.inv(t)).T
        flat = grad - t * (t * grad).sum(0)
        size = np.linalg.norm(flat)
        if size < tolerance:
            break
        step *= 2
        for _ in range(20):
            x = t - step * flat
            x = x / np.sqrt((x**2).sum(0))
            new = a @ np.linalg.inv(x).T
            value, slope = criterion(new)
            if value < f - 0.5 * size**2 * step:
                break
            step /= 2
        t, load, f, g = x, new, value, slope
    return load * weight, t.T @ t


def fit(r: np.ndarray, columns: list[str], k: int) -> dict:
    """pattern, phi, weights (regression scores), variance by factor; signs and order are fixed by size."""
    if k < 1:
        raise ValueError("no factor to fit: k must be 1 or more")
    pattern, phi = oblimin(minres(r, k))
    order = np.argsort(-(pattern**2).sum(0), kind="stable")
    pattern, phi = pattern[:, order], phi[np.ix_(order, order)]
    sign = np.sign(pattern[np.abs(pattern).argmax(0), np.arange(k)])
    sign[sign == 0] = 1
    pattern, phi = pattern * sign, phi * np.outer(sign, sign)
    ss = (pattern**2).sum(0)
    return {"columns": columns, "pattern": pattern, "phi": phi, "weights": np.linalg.pinv(r) @ pattern @ phi, "ss_loadings": ss, "pct_var": 100 * ss / len(columns), "cumulative_pct": 100 * np.cumsum(ss) / len(columns)}


def scores(df: DataFrame, columns: list[str], weights: np.ndarray, keys: list[str]) -> DataFrame:
    """F1.. as sums of weighted scaled columns: expressions that are compiled with the scan, without join or UDF."""
    out = []
    for j in range(weights.shape[1]):
        total = F.lit(0.0)
        for c, w in zip(columns, weights[:, j]):
            total = total + F.col(c) * F.lit(float(w))
        out.append(total.alias(f"F{j + 1}"))
    return df.select(*keys, *out)


def top_loadings(loadings: DataFrame, n: int = 6) -> DataFrame:
    """Per factor the n features of the largest absolute loading, the signed value kept; ties by name."""
    from pyspark.sql import Window

    over = Window.partitionBy("factor").orderBy(F.desc(F.abs("loading")), "feature")
    return loadings.withColumn("rank", F.row_number().over(over)).where(F.col("rank") <= n)
