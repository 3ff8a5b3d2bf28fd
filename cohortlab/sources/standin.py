"""Stand-in clinical tables over the star-schema test data (see FIXTURES.md).

The cells below are fixed values: each expression parses in Spark SQL and in
DuckDB, so a query and its check start from the same rows.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from cohortlab.functions.columns import nan_to_null

_STAY_OF_EVENT = "user_id * 10 + event_id % 10"

CELLS = {
    "patient": {
        "from": "orders join customer on o_custkey = c_custkey",
        "patientunitstayid": "o_orderkey",
        "patienthealthsystemstayid": "o_custkey",
        "hospitalid": "cast(c_nationkey as bigint)",
        "hospitaladmitoffset": "cast(-(o_orderkey * 13 % 400) as int)",
        "age": "case when o_orderkey % 97 = 0 then '' when floor(o_totalprice / 5000) > 89 then '> 89'"
               " else cast(cast(floor(o_totalprice / 5000) as int) as string) end",
        "gender": "case when o_orderkey % 40 = 0 then null when o_orderkey % 41 = 0 then 'Unknown'"
                  " when o_orderkey % 5 < 3 then 'Male' else 'Female' end",
        "admissionheight": "case when o_orderkey % 53 = 0 then null when o_orderkey % 59 = 0"
                           " then cast(0 as double) else cast(150 + o_orderkey % 50 as double) end",
        "admissionweight": "case when o_orderkey % 47 = 0 then null else c_acctbal / 50 end",
        "unittype": "case when o_orderkey % 43 = 0 then null else o_orderpriority end",
        "hospitaldischargestatus": "case when o_orderkey % 71 = 0 then '' when o_orderkey % 73 = 0 then null"
                                   " when o_orderstatus = 'F' and o_orderkey % 3 = 0 then 'Expired'"
                                   " else 'Alive' end",
        "unitdischargeoffset": "cast((o_orderkey * 37) % 5000 as int)",
    },
    "hospital": {
        "from": "nation join region on n_regionkey = r_regionkey",
        "hospitalid": "cast(n_nationkey as bigint)",
        "numbedscategory": "case n_nationkey % 5 when 0 then '<100' when 1 then '100 - 249'"
                           " when 2 then '250 - 499' when 3 then '>= 500' end",
        "teachingstatus": "case when n_nationkey % 13 = 5 then null else n_nationkey % 7 = 0 end",
        "region": "case when n_nationkey % 11 = 0 then null else r_name end",
    },
    "apachepatientresult": {
        "from": "(select o_orderkey, 'IV' as ver from orders union all"
                " select o_orderkey, 'IVa' as ver from orders) o where o_orderkey % 6 <> 0",
        "patientunitstayid": "o_orderkey",
        "apacheversion": "ver",
        "apachescore": "case when ver = 'IVa' and o_orderkey % 29 = 0 then null when ver = 'IVa'"
                       " then cast((o_orderkey * 7) % 130 as int)"
                       " else cast((o_orderkey * 11) % 130 as int) end",
    },
    "vitalperiodic": {
        "from": "lineitem",
        "patientunitstayid": "l_orderkey",
        "observationoffset": "cast((l_partkey * 13 + l_linenumber * 97) % 2000 - 200 as int)",
        "heartrate": "case when l_partkey % 31 = 0 then null else l_quantity * 7 end",
        "systemicsystolic": "l_extendedprice / 350",
        "systemicdiastolic": "case when l_returnflag = 'N' then null else l_extendedprice / 600 end",
        "systemicmean": "l_extendedprice / 450",
        "respiration": "l_quantity * 1.4",
        "sao2": "45 + l_quantity * 1.15",
        "temperature": "case when l_linestatus = 'F' then null else 25 + l_discount * 200 end",
    },
    "vitalaperiodic": {
        "from": "lineitem where l_returnflag <> 'A'",
        "patientunitstayid": "l_orderkey",
        "observationoffset": "cast((l_suppkey * 17 + l_linenumber * 131) % 2000 - 200 as int)",
        "noninvasivesystolic": "l_quantity * 6.5",
        "noninvasivediastolic": "case when l_partkey % 4 = 0 then null else l_quantity * 4 end",
        "noninvasivemean": "l_quantity * 5",
    },
    "nursecharting": {
        "from": "events",
        "patientunitstayid": _STAY_OF_EVENT,
        "nursingchartoffset": "cast((event_id * 29) % 2000 - 200 as int)",
        "nursingchartcelltypevallabel": "case when event_type in ('click', 'error') then 'Temperature'"
                                        " when event_type in ('view', 'signup') then 'Glasgow coma score'"
                                        " else 'Vital Signs' end",
        "nursingchartcelltypevalname": "case event_type when 'click' then 'Temperature (C)'"
                                       " when 'error' then 'Temperature (F)' when 'view' then 'GCS Total'"
                                       " when 'signup' then 'GCS Motor' else 'O2 Saturation' end",
        "nursingchartvalue": "case when event_id % 17 = 0 then 'unable to assess' when event_type = 'click'"
                             " then concat(cast(26 + event_id % 20 as string), '.',"
                             " cast(event_id % 10 as string)) when event_type = 'view'"
                             " then cast(1 + event_id % 16 as string)"
                             " else regexp_extract(props, '[0-9]+', 0) end",
    },
    "lab": {
        "from": "events",
        "patientunitstayid": _STAY_OF_EVENT,
        "labresultoffset": "cast((event_id * 31) % 2000 - 200 as int)",
        "labname": "case concat(event_type, cast(event_id % 2 as string)) when 'click0' then 'sodium'"
                   " when 'click1' then 'potassium' when 'error0' then 'glucose'"
                   " when 'error1' then 'creatinine' when 'purchase0' then 'BUN'"
                   " when 'purchase1' then 'Hgb' when 'signup0' then 'WBC x 1000'"
                   " when 'signup1' then 'platelets x 1000' when 'view0' then 'bicarbonate'"
                   " else case when event_id % 3 = 0 then 'magnesium' else 'total bilirubin' end end",
        "labresult": "case when event_id % 37 = 0 then null else value end",
    },
    "scores": {
        "from": "events",
        "id": "event_id",
        "y_true": "case when event_type = 'purchase' or (value > 90 and event_id % 3 = 0) then 1 else 0 end",
        "p": "round(value / (value + 50), 3)",
    },
}

# The columns of the test tables that the cells read.
_SOURCES = {
    "nation": "n_nationkey int, n_regionkey int",
    "region": "r_regionkey int, r_name string",
    "customer": "c_custkey bigint, c_nationkey int, c_acctbal double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double,"
              " o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int,"
                " l_quantity double, l_extendedprice double, l_discount double,"
                " l_returnflag string, l_linestatus string",
    "events": "user_id bigint, event_id bigint, event_type string, value double, props string",
}


def select_text(table: str) -> str:
    """The SELECT that builds one stand-in table from the test tables."""
    cells = CELLS[table]
    columns = ", ".join(f"{text} as {name}" for name, text in cells.items() if name != "from")
    return f"select {columns} from {cells['from']}"


class StandinTables:
    """The input tables over one folder of test tables; each is built on first use."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self._spark = spark
        self._dir = sf_dir

    def source(self, name: str) -> DataFrame:
        return self._spark.read.schema(_SOURCES[name]).parquet(f"{self._dir}/{name}.parquet")

    def _select(self, table: str, rows: DataFrame) -> DataFrame:
        cells = [f"{text} as {name}" for name, text in CELLS[table].items() if name != "from"]
        return nan_to_null(rows.selectExpr(*cells))

    @cached_property
    def patient(self) -> DataFrame:
        """Orders with their customer, each read once.

        The join is a sort-merge by hint: customers grow with the data, their file unpacks
        to twenty times its size and more, and a broadcast would pass it all through the
        driver. One customer may hold a third of all orders: the hash beside the key says
        no more than the key, but the rows are then not laid out by the customer alone, so
        an aggregate on the customer shuffles again and Spark may split a large partition.
        """
        customer = self.source("customer").hint("merge")
        same = F.expr("o_custkey = c_custkey AND hash(o_custkey) = hash(c_custkey)")
        return self._select("patient", self.source("orders").join(customer, same))

    @cached_property
    def hospital(self) -> DataFrame:
        nation, region = self.source("nation"), self.source("region")
        return self._select("hospital", nation.join(region, F.expr("n_regionkey = r_regionkey")))

    @cached_property
    def apachepatientresult(self) -> DataFrame:
        scored = self.source("orders").where("o_orderkey % 6 <> 0")
        versions = F.explode(F.array(F.lit("IV"), F.lit("IVa"))).alias("ver")
        return self._select("apachepatientresult", scored.select("o_orderkey", versions))

    @cached_property
    def vitalperiodic(self) -> DataFrame:
        return self._select("vitalperiodic", self.source("lineitem"))

    @cached_property
    def vitalaperiodic(self) -> DataFrame:
        return self._select("vitalaperiodic", self.source("lineitem").where("l_returnflag <> 'A'"))

    @cached_property
    def nursecharting(self) -> DataFrame:
        return self._select("nursecharting", self.source("events"))

    @cached_property
    def lab(self) -> DataFrame:
        return self._select("lab", self.source("events"))

    @cached_property
    def scores(self) -> DataFrame:
        """Scored rows ``(id, y_true, p)`` for the metric queries."""
        return self._select("scores", self.source("events"))


def tables(spark: SparkSession, sf_dir: str) -> StandinTables:
    return StandinTables(spark, sf_dir)


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return StandinTables(spark, sf_dir).scores
