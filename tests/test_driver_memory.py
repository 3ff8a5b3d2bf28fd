"""What must not pass through the driver, query by query."""

import re

import pytest

from cohortlab.plans import catalog
from cohortlab.session import Written

STAYS = [
    "attributions",
    "batch_score_bands",
    "bp_features",
    "class_balance",
    "cohort",
    "cohort_one_stay",
    "complete_vitals",
    "cuff_coverage",
    "dataset_scale",
    "demo_model",
    "demographics_overview",
    "describe_hr_readings",
    "describe_vitals",
    "discover_gcs",
    "discover_temperature",
    "extreme_bmi",
    "extreme_reasons",
    "feature_coverage",
]


class FirstWritten(Exception):
    """The plan of the first table that a query writes."""


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def first_plan(query, spark, folder):
    """The plan of the first table that the query writes, else that of its result."""
    try:
        return plan(query(spark, folder))
    except FirstWritten as first:
        return str(first)


def below(text, node):
    """The subtrees under each such node of a plan's text, the node's line included."""
    lines = text.split("\n")

    def depth(line):
        return len(line) - len(line.lstrip(" :+-"))

    for i, line in enumerate(lines):
        if re.match(rf"[ :+-]*{node}\b", line):
            end = next((j for j in range(i + 1, len(lines)) if depth(lines[j]) <= depth(line)), len(lines))
            yield "\n".join(lines[i:end])


@pytest.fixture(scope="module")
def star(spark, tmp_path_factory):
    """The tables that the stays and their readings are made from, customers the smaller side."""
    folder = str(tmp_path_factory.mktemp("star"))
    rows = {
        "region": "cast(id % 3 AS int) AS r_regionkey, 'north' AS r_name",
        "nation": "cast(id AS int) AS n_nationkey, cast(id % 3 AS int) AS n_regionkey",
        "customer": "id AS c_custkey, cast(id % 20 AS int) AS c_nationkey, cast(3000 + id AS double) AS c_acctbal",
        "orders": "id AS o_orderkey, id % 1500 AS o_custkey, 'F' AS o_orderstatus, 250000D AS o_totalprice, 'LOW' AS o_orderpriority",
        "lineitem": "id AS l_orderkey, id AS l_partkey, id AS l_suppkey, 1 AS l_linenumber, 10D AS l_quantity, 40000D AS l_extendedprice,"
                    " 0.05D AS l_discount, 'N' AS l_returnflag, 'O' AS l_linestatus",
        "events": "id % 2000 AS user_id, id AS event_id, 'view' AS event_type, 12D AS value, '{}' AS props",
    }
    sizes = {"region": 3, "nation": 20, "customer": 2_000}
    for name, cells in rows.items():
        spark.range(sizes.get(name, 20_000)).selectExpr(*cells.split(", ")).write.parquet(f"{folder}/{name}.parquet")
    return folder


@pytest.mark.parametrize("name", STAYS)
def test_customers_are_not_broadcast(spark, star, monkeypatch, name):
    """Customers grow with the data and their file says little of their size: whatever the
    threshold, no broadcast holds them, or the stays, before they are added up."""
    def first(cls, df, *args, **options):
        raise FirstWritten(plan(df))

    monkeypatch.setattr(Written, "of", classmethod(first))
    monkeypatch.setattr(catalog, "_STUDIES", {})
    text = first_plan(catalog.QUERIES[name], spark, star)
    assert "customer.parquet" in text
    broadcast = [x for x in below(text, "BroadcastExchange") if "customer.parquet" in x]
    assert not [x for x in broadcast if "Aggregate" not in x.split("Join")[0]]
