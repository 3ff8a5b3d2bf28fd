import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlab.operators.ordered import BUCKET, class_rank, exact_quantiles, first_share, running_totals, with_buckets


def skewed(n=4000, seed=3):
    """A third of the rows share one value; the rest spread very unevenly."""
    rng = np.random.default_rng(seed)
    x = np.round(rng.lognormal(0, 3, n), 4)
    x[: n // 3] = 0.25
    return x


@pytest.mark.parametrize("bits", [1, 4, 7])
@pytest.mark.parametrize("descending", [True, False])
def test_running_totals_equal_a_plain_loop(spark, bits, descending):
    x = skewed()
    y = (np.arange(len(x)) % 5 == 0).astype(int)
    df = spark.createDataFrame(list(zip(x.tolist(), y.tolist())), "v double, y int")
    counts = df.groupBy("v").agg(F.sum("y").alias("a"), F.count("*").alias("b"))
    got = {r.v: r for r in running_totals(counts, "v", ["a", "b"], descending=descending, bits=bits).collect()}
    order = sorted(set(x.tolist()), reverse=descending)
    ca = cb = 0
    sums = {v: (int(y[x == v].sum()), int((x == v).sum())) for v in order}
    for i, v in enumerate(order):
        ca, cb = ca + sums[v][0], cb + sums[v][1]
        following = sums[order[i + 1]] if i + 1 < len(order) else (None, None)
        r = got[v]
        assert (r.cum_a, r.cum_b, r.total_a, r.total_b) == (ca, cb, int(y.sum()), len(x))
        assert (r.next_a, r.next_b) == following
    assert len(got) == len(order)


def test_running_totals_by_group(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 2.0), ("b", 1.5)], "g string, v double")
    counts = df.groupBy("g", "v").agg(F.count("*").alias("n"))
    got = {(r.g, r.v): (r.cum_n, r.total_n, r.next_n)
           for r in running_totals(counts, "v", ["n"], by=["g"]).collect()}
    assert got == {("a", 2.0): (2, 3, 1), ("a", 1.0): (3, 3, None), ("b", 1.5): (1, 1, None)}


def test_no_bucket_holds_much_more_than_its_share(spark):
    x = skewed(8000)
    df = spark.createDataFrame([(v,) for v in x.tolist()], "v double")
    distinct = df.distinct()
    sizes = [r["count"] for r in with_buckets(distinct, "v", df, 5).groupBy(BUCKET).count().collect()]
    assert max(sizes) <= 3 * len(x) / 2**5
    assert sum(sizes) == distinct.count()


@pytest.mark.parametrize("n", [1, 2, 7, 1000])
def test_quantiles_equal_linear_interpolation(spark, n):
    x = skewed(n)
    shares = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "v double")
    r = exact_quantiles(df, "v", shares).first()
    assert r.n == n
    assert np.allclose(r["quantiles"], np.quantile(x, shares), atol=1e-12)


def test_quantiles_per_group_and_without_values(spark):
    rows = [("a", float(i)) for i in range(10)] + [("b", 5.0)] * 4 + [("c", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: r["quantiles"][0] for r in exact_quantiles(df, "v", [0.5], by=["g"], groups=3).collect()}
    assert got == {"a": 4.5, "b": 5.0}


def test_class_rank_is_a_permutation_per_class(spark):
    df = spark.range(3000).selectExpr("id", "id % 3 = 0 AS y")
    rows = class_rank(df, "y", "id", 42, digits=2).collect()
    for y in (True, False):
        ranks = sorted(r.class_rank for r in rows if r.y == y)
        assert ranks == list(range(1, len(ranks) + 1))
        assert {r.class_size for r in rows if r.y == y} == {len(ranks)}
    again = class_rank(df.repartition(5), "y", "id", 42, digits=3)
    assert {r.id: r.class_rank for r in rows} == {r.id: r.class_rank for r in again.collect()}


@pytest.mark.parametrize("share,digits", [(0.2, 1), (0.2, 3), (0.0, 2), (1.0, 2), (0.001, 2), (0.5, 2)])
def test_first_share_is_the_first_ranks(spark, share, digits):
    df = spark.sql("SELECT id, CASE WHEN id % 7 = 0 THEN 1 WHEN id % 11 = 0 THEN NULL ELSE 0 END AS y, id % 3 > 0 AS use FROM range(500)")
    ranked = class_rank(df.where("use"), "y", "id", 42).where(f"class_rank <= floor({share}D * class_size + 0.5D)")
    out = first_share(df, "y", "id", 42, share, "chosen", among="use", digits=digits)
    assert out.columns == ["id", "y", "use", "chosen"] and out.count() == 500
    assert {r.id for r in out.where("chosen").collect()} == {r.id for r in ranked.collect()}


def test_first_share_of_odd_rows(spark):
    none = spark.createDataFrame([], "id int, y int")
    assert first_share(none, "y", "id", 42, 0.2, "chosen").count() == 0
    rows = spark.createDataFrame([(None, 0), (None, 0), (1, 0), (1, 0), (2, None)], "id int, y int")
    out = first_share(rows, "y", "id", 42, 0.5, "chosen").collect()
    assert len(out) == 5 and len({(r.id, r.y, r.chosen) for r in out}) == 3  # repeats of a key are on one side


def test_first_share_shuffles_no_rows(spark):
    df = spark.range(1000).selectExpr("id", "id % 2 AS y")
    plan = first_share(df, "y", "id", 42, 0.2, "chosen")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "Window" not in plan
