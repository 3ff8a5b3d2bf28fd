import pytest

from cohortlab import session
from cohortlab.sources import readers, schemas, sinks, standin


def test_jdbc_options():
    o = readers.jdbc_options("jdbc:postgresql://h/db", "vitalperiodic", (1, 1000), 64, user="u", password="p")
    assert o["partitionColumn"] == "patientunitstayid" and o["numPartitions"] == "64"
    assert (o["lowerBound"], o["upperBound"], o["dbtable"]) == ("1", "1000", "vitalperiodic")
    assert "user" not in readers.jdbc_options("jdbc:x", "lab", (0, 1), 1)
    with pytest.raises(ValueError):
        readers.jdbc_options("jdbc:x", "lab", (5, 5), 4)


def test_parquet_tables_round_trip(spark, small):
    folder = session.fresh_path(spark, "tables")
    t = standin.tables(spark, small)
    for name in schemas.TABLES:
        getattr(t, name).write.parquet(f"{folder}/{name}.parquet")
    again = readers.read_parquet_tables(spark, folder)
    for name, schema in schemas.TABLES.items():
        schemas.assert_schema(getattr(again, name).schema, schema)
        assert getattr(again, name).count() == getattr(t, name).count()
    again.register()
    assert spark.sql("SELECT count(*) AS n FROM hospital").first().n == 25


def test_window_filter_is_pushed_to_the_scan(spark, small):
    from cohortlab.operators.readings import first_day

    path = session.fresh_path(spark, "vitals")
    standin.tables(spark, small).vitalperiodic.write.parquet(path)
    df = first_day(readers.read_parquet(spark, path, "vitalperiodic"), "observationoffset").select("heartrate")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(observationoffset,0)" in plan and "LessThanOrEqual(observationoffset,1440)" in plan
    assert "sao2" not in plan.split("FileScan")[1]


def test_defaults_document(spark):
    rows = [("age", "67.0"), ("unittype", "Med \"A\""), ("none", None)]
    path = session.fresh_path(spark, "defaults")
    sinks.write_defaults(spark.createDataFrame(rows, "feature string, default_value string"), path)
    got = {r.feature: r.default_value for r in readers.read_defaults(spark, path).collect()}
    assert got == {"age": "67.0", "unittype": 'Med "A"'}


def test_nested_config_document(spark, tmp_path):
    path = tmp_path / "config.json"
    path.write_text('{\n "features": ["age", "bmi"],\n "medians": {"age": 67.0, "bmi": 27.5}\n}')
    medians = {r.feature: float(r.default_value) for r in readers.read_defaults(spark, str(path), "medians").collect()}
    assert medians == {"age": 67.0, "bmi": 27.5}
    names = readers.read_feature_list(spark, str(path)).orderBy("position").collect()
    assert [r.feature for r in names] == ["age", "bmi"]


def test_reload_check_and_attribution_sink(spark):
    df = spark.createDataFrame([(1, "a", 0.5), (1, "b", 0.1), (2, "a", 0.2)], "id long, feature string, phi double")
    path = session.fresh_path(spark, "phi")
    sinks.write_table(df, path)
    r = sinks.reload_check(df, path).first()
    assert (r.n_written, r.n_reloaded, r.columns_written, r.columns_reloaded) == (3, 3, 3, 3)
    path = session.fresh_path(spark, "phi")
    sinks.write_attributions(df, path)
    one = spark.read.parquet(path).where("feature = 'a'")
    assert one.count() == 2 and "PartitionFilters: [isnotnull(feature" in one._jdf.queryExecution().executedPlan().toString()


def test_schema_mismatch_is_refused(spark):
    df = spark.createDataFrame([(1, 2)], "id int, p int")
    with pytest.raises(ValueError):
        sinks.write_table(df, session.fresh_path(spark, "bad"), schemas.SCORES)


def test_named_checkpoint_folder_wins(spark, monkeypatch, tmp_path):
    class Conf:
        def get(self, key, default=None):
            return str(tmp_path) + "/" if key == session.CHECKPOINT_KEY else default

    class Fake:
        conf = Conf()

    assert session.shared_folder(Fake()) == str(tmp_path)


def test_cluster_without_a_folder_is_refused():
    class Context:
        master = "yarn"

        def getCheckpointDir(self):
            return None

    class Fake:
        class conf:
            @staticmethod
            def get(key, default=None):
                return default
        sparkContext = Context()

    with pytest.raises(ValueError):
        session.shared_folder(Fake())


def stays_folder(spark, folder):
    """400 orders, a third of them of customer 0; a customer that comes twice, keys that are null or unmatched."""
    spark.range(400).selectExpr(
        "id AS o_orderkey", "CASE WHEN id % 3 = 0 THEN 0 WHEN id = 1 THEN NULL WHEN id = 2 THEN 999 ELSE id % 40 END AS o_custkey",
        "'F' AS o_orderstatus", "100000D AS o_totalprice", "'LOW' AS o_orderpriority").write.parquet(f"{folder}/orders.parquet")
    spark.range(40).selectExpr("CASE WHEN id = 7 THEN NULL WHEN id = 39 THEN 5 ELSE id END AS c_custkey", "cast(id % 25 AS int) AS c_nationkey",
                               "cast(id AS double) AS c_acctbal").write.parquet(f"{folder}/customer.parquet")
    return standin.tables(spark, folder).patient


def nodes(plan, kind):
    """The nodes of a kind in the plan that ran, those of finished stages included."""
    name = plan.getClass().getSimpleName()
    inner = [plan.executedPlan()] if name == "AdaptiveSparkPlanExec" else [plan.plan()] if name.endswith("QueryStageExec") else []
    inner += [plan.children().apply(i) for i in range(plan.children().size())]
    return [plan] * (name == kind) + [x for p in inner for x in nodes(p, kind)]


def test_customers_meet_their_orders_once(spark, tmp_path):
    """No customer is repeated on its way to the join, and none passes through the driver, however small the table."""
    patient = stays_folder(spark, str(tmp_path))
    got = sorted((r.patientunitstayid, r.patienthealthsystemstayid, r.hospitalid) for r in patient.collect())
    own = {}
    for i in range(40):
        own.setdefault(None if i == 7 else 5 if i == 39 else i, []).append(i % 25)
    keys = [(i, 0 if i % 3 == 0 else None if i == 1 else 999 if i == 2 else i % 40) for i in range(400)]
    assert got == sorted((i, c, n) for i, c in keys if c is not None for n in own.get(c, []))
    ran = patient._jdf.queryExecution().executedPlan()
    assert not nodes(ran, "BroadcastExchangeExec")
    dealt = sorted(x.metrics().apply("shuffleRecordsWritten").value() for x in nodes(ran, "ShuffleExchangeExec"))
    assert dealt == [39, 399]  # one of each has no key


def test_a_busy_customer_is_split_under_an_aggregate(spark, tmp_path):
    """The partition of a customer with a third of all orders is read by several tasks,
    though rows are next collected by customer."""
    folder = str(tmp_path)
    stays_folder(spark, folder)
    small = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "100k",
             "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "100k"}
    spark.range(0, 300_000, 1, 12).selectExpr(
        "id AS o_orderkey", "CASE WHEN id % 3 = 0 THEN 0 ELSE id % 40 END AS o_custkey", "'F' AS o_orderstatus",
        "100000D AS o_totalprice", "md5(cast(id AS string)) AS o_orderpriority").write.mode("overwrite").parquet(f"{folder}/orders.parquet")
    before = {c: spark.conf.get(c, None) for c in small}
    try:
        for c, x in small.items():
            spark.conf.set(c, x)
        patient = standin.tables(spark, folder).patient
        busy = patient.groupBy("patienthealthsystemstayid").agg({"unittype": "max"})
        rows = busy.collect()
        joins = nodes(busy._jdf.queryExecution().executedPlan(), "SortMergeJoinExec")
    finally:
        for c, x in before.items():
            spark.conf.unset(c) if x is None else spark.conf.set(c, x)
    assert len(rows) == 38 and [x.isSkewJoin() for x in joins] == [True]
