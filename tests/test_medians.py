"""Exact medians in parts, and random correlations by blocks, against the plain ways."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from docstyle.operators import factor


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(5)
    n = 5001
    columns = {
        "normal": rng.standard_normal(n), "skewed": np.exp(8 * rng.standard_normal(n)), "ties": rng.integers(0, 3, n).astype(float), "zeros": np.where(rng.random(n) < 0.9, 0.0, rng.random(n)),
        "halves": np.where(np.arange(n) % 2 == 0, -1.0, 1.0), "same": np.full(n, 0.1),
    }
    rows = [tuple(None if (i + j) % 7 == 0 else float(v[i]) for j, v in enumerate(columns.values())) for i in range(n)]
    rows = [(*r, None, None if i else 2.5, i) for i, r in enumerate(rows)]
    return spark.createDataFrame(rows, ", ".join(f"{c} double" for c in [*columns, "nothing", "one"]) + ", whole int").repartition(4)


@pytest.mark.parametrize("most", [50_000, 3])
def test_medians(table, most):
    want = table.agg(*[F.median(c).alias(c) for c in table.columns]).first().asDict()
    got = factor.medians(table, table.columns, most=most)
    assert got.pop("nothing") is want.pop("nothing") is None and got == pytest.approx(want, rel=1e-15)
    # brackets that miss the middle are widened
    n = table.where("normal IS NOT NULL").count()
    for bracket in ([-9.0, -8.0], [8.0, 9.0], [0.0, 0.0]):
        assert factor.medians(table, ["normal"], {"normal": (n, bracket)}, most=most)["normal"] == want["normal"]


def test_statistics_read_the_input_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    df = spark.range(100).selectExpr("cast(id as double) x").mapInArrow(run, "x double")
    got = factor.transform(df, factor.statistics(df, ["x"])).collect()
    assert len(got) == 100 and seen.value == 100
    df.unpersist()


def test_random_correlations_by_blocks():
    x = np.random.default_rng([2001, 7]).standard_normal((1000, 5))
    for rows in (1, 64, 1000, 65_536):
        assert factor.random_correlations(1000, 5, [2001, 7], rows) == pytest.approx(np.corrcoef(x, rowvar=False), abs=1e-12)
