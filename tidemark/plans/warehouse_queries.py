"""Queries of the cube, federation, guarded SQL and expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.expressions import compile_expression
from tidemark.operators import federate as fe
from tidemark.operators import olap
from tidemark.registry import Registry
from tidemark.session import table
from tidemark.sources import warehouse as wh

REG = Registry()

SALES = """sales AS (SELECT r_name AS region, n_name AS nation, c_mktsegment AS segment, o_orderdate, o_orderpriority AS priority, o_totalprice::DECIMAL(18,2) AS price, o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def sales(spark: SparkSession, d: str) -> DataFrame:
    """Orders with customer, nation and region; dimension tables are joined by their keys, as small as statistics allow."""
    o, c, n, r = (table(spark, d, t) for t in ("orders", "customer", "nation", "region"))
    joined = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return joined.select(F.col("r_name").alias("region"), F.col("n_name").alias("nation"), F.col("c_mktsegment").alias("segment"), "o_orderdate", F.col("o_orderpriority").alias("priority"), F.col("o_totalprice").cast("decimal(18,2)").alias("price"), "o_orderkey")


CUBE = olap.Cube(
    (
        olap.Dimension("place", "nation", levels=(("region", "region"), ("nation", "nation"))), olap.Dimension("region", "region"), olap.Dimension("segment", "segment"), olap.Dimension("priority", "priority"),
        olap.Dimension("date", "o_orderdate", "temporal", (("year", "year(o_orderdate)"), ("quarter", "date_format(o_orderdate, 'yyyy')||'-Q'||quarter(o_orderdate)"), ("month", "date_format(o_orderdate, 'yyyy-MM')"))),
    ),
    (olap.Measure("revenue", "price"), olap.Measure("orders", "o_orderkey", "COUNT"), olap.Measure("customers", "nation", "COUNT_DISTINCT"), olap.Measure("lowest", "price", "MIN"), olap.Measure("highest", "price", "MAX"), olap.Measure("spread", "price", "STDDEV"), olap.Measure("variance", "price", "VARIANCE"), olap.Measure("mean_price", "price", "AVG")),
)
BASE = olap.CubeQuery((("region", None), ("segment", None)), ("revenue", "orders"))
_REV = "sum(price)::DECIMAL(28,2) AS revenue, count(o_orderkey) AS orders"


@REG.query(f"""WITH {SALES} SELECT region, segment, {_REV}, count(DISTINCT nation) AS customers, min(price) AS lowest, max(price) AS highest, round(stddev_samp(price::DOUBLE), 2) AS spread, round(var_samp(price::DOUBLE) / 1000, 0) AS variance, round(avg(price::DOUBLE), 2) AS mean_price FROM sales GROUP BY 1, 2""")
def agg_cube(spark: SparkSession, d: str) -> DataFrame:
    q = olap.CubeQuery((("region", None), ("segment", None)), ("revenue", "orders", "customers", "lowest", "highest", "spread", "variance", "mean_price"))
    return olap.execute(sales(spark, d), CUBE, q).withColumns({"spread": F.round("spread", 2), "variance": F.round(F.col("variance") / 1000, 0), "mean_price": F.round(F.col("mean_price").cast("double"), 2)})


@REG.query(f"WITH {SALES}, c AS (SELECT region, segment, {_REV} FROM sales GROUP BY 1, 2) SELECT count(revenue) AS count, sum(revenue)::DECIMAL(38,2) AS sum, min(revenue) AS min, max(revenue) AS max, round(avg(revenue::DOUBLE), 2) AS avg FROM c")
def agg_cube_summary(spark: SparkSession, d: str) -> DataFrame:
    return olap.summary(olap.execute(sales(spark, d), CUBE, BASE), "revenue").withColumn("avg", F.round(F.col("avg").cast("double"), 2))


@REG.query(f"WITH {SALES} SELECT segment, {_REV} FROM sales WHERE region IN ('AFRICA', 'ASIA') AND priority = '1-URGENT' GROUP BY 1 HAVING sum(price) > 1000")
def flt_cube(spark: SparkSession, d: str) -> DataFrame:
    return olap.execute(sales(spark, d), CUBE, olap.CubeQuery((("segment", None),), ("revenue", "orders"), {"region": ["AFRICA", "ASIA"], "priority": "1-URGENT"}, {"revenue": (">", 1000)}))


def _olap(name: str, sql: str, *operations: olap.Operation, base: olap.CubeQuery = BASE) -> None:
    REG.query(f"WITH {SALES} {sql}", name=name)(lambda spark, d: olap.execute(sales(spark, d), CUBE, base, *operations))


_olap("olap_slice", f"SELECT segment, {_REV} FROM sales WHERE region = 'ASIA' GROUP BY 1", olap.slice_("region", "ASIA"))
_olap("olap_dice", f"SELECT region, segment, {_REV} FROM sales WHERE region IN ('ASIA', 'EUROPE') AND segment = 'MACHINERY' GROUP BY 1, 2", olap.dice(region=["ASIA", "EUROPE"], segment="MACHINERY"))
_olap("olap_filter", f"SELECT region, segment, {_REV} FROM sales WHERE priority = '2-HIGH' GROUP BY 1, 2", olap.dice(priority="2-HIGH"))
_olap("olap_drilldown", f"SELECT segment, region AS place_region, year(o_orderdate)::INTEGER AS date_year, {_REV} FROM sales GROUP BY 1, 2, 3", olap.roll_up("region"), olap.drill_down("place"), olap.drill_down("date"))
_olap("olap_drillup", f"SELECT segment, concat(year(o_orderdate), '-Q', quarter(o_orderdate)) AS date_quarter, {_REV} FROM sales GROUP BY 1, 2", olap.drill_up("date"), base=olap.CubeQuery((("segment", None), ("date", "month")), ("revenue", "orders")))
_olap("olap_pivot", f"SELECT segment, priority, {_REV} FROM sales GROUP BY 1, 2", olap.pivot(("segment",), ("priority",)))
_olap("olap_rollup", f"SELECT segment, {_REV} FROM sales GROUP BY 1", olap.roll_up("region"))
_olap("olap_topn", "SELECT nation AS place, sum(price)::DECIMAL(28,2) AS revenue FROM sales GROUP BY 1 ORDER BY revenue DESC, place LIMIT 7", olap.top_n("revenue", 7), base=olap.CubeQuery((("place", None),), ()))
_olap("olap_composite", "SELECT segment, sum(price)::DECIMAL(28,2) AS revenue FROM sales WHERE region = 'ASIA' AND priority IN ('1-URGENT', '2-HIGH') GROUP BY 1 ORDER BY revenue, segment LIMIT 3", olap.composite(olap.slice_("region", "ASIA"), olap.dice(priority=["1-URGENT", "2-HIGH"]), olap.top_n("revenue", 3, ascending=True)), base=olap.CubeQuery((("region", None), ("segment", None)), ("revenue",)))


@REG.query(f"WITH {SALES} SELECT segment, sum(price) FILTER (WHERE priority = '1-URGENT')::DECIMAL(28,2) AS \"1-URGENT\", sum(price) FILTER (WHERE priority = '2-HIGH')::DECIMAL(28,2) AS \"2-HIGH\" FROM sales GROUP BY 1")
def olap_pivot_wide(spark: SparkSession, d: str) -> DataFrame:
    long = olap.execute(sales(spark, d), CUBE, olap.CubeQuery((("segment", None), ("priority", None)), ("revenue",)))
    return olap.spread(long, "priority", "revenue", ["1-URGENT", "2-HIGH"])


@REG.query(f"WITH {SALES} SELECT region, segment, grouping_id(region, segment) AS grouping_id, {_REV} FROM sales GROUP BY CUBE (region, segment)")
def olap_cube_all(spark: SparkSession, d: str) -> DataFrame:
    return olap.cube_all(sales(spark, d), CUBE, ("region", "segment"), ("revenue", "orders"))


@REG.query(f"WITH {SALES} SELECT region, segment, grouping_id(region, segment) AS grouping_id, {_REV} FROM sales GROUP BY ROLLUP (region, segment)")
def olap_rollup_all(spark: SparkSession, d: str) -> DataFrame:
    return olap.cube_all(sales(spark, d), CUBE, ("region", "segment"), ("revenue", "orders"), rollup=True)


@REG.query("SELECT * FROM (VALUES ('dimension', 'o_orderkey', 'numerical'), ('dimension', 'o_custkey', 'numerical'), ('dimension', 'o_orderstatus', 'categorical'), ('measure', 'o_totalprice', 'SUM'), ('dimension', 'o_orderdate', 'temporal'), ('dimension', 'o_orderpriority', 'categorical')) t(part, name, kind)")
def olap_discover(spark: SparkSession, d: str) -> DataFrame:
    cube = olap.discover(table(spark, d, "orders"))
    rows = [("dimension", x.name, x.kind) for x in cube.dimensions] + [("measure", m.name, m.aggregate) for m in cube.measures]
    return spark.createDataFrame(rows, "part string, name string, kind string")


@REG.query()
def olap_metadata(spark: SparkSession, d: str) -> DataFrame:
    about = CUBE.describe()
    return spark.createDataFrame([(k, x["name"], x["column"]) for k in about for x in about[k]], "part string, name string, source string")


# ---------------------------------------------------------------- federation


def _sources(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    c, n, s = (table(spark, d, t) for t in ("customer", "nation", "supplier"))
    region = lambda k: F.when(k % 5 != 0, k % 5)  # noqa: E731  (some keys are null)
    shops = c.groupBy(region(F.col("c_nationkey")).alias("region"), F.col("c_mktsegment").alias("segment")).agg(F.count(F.lit(1)).alias("customers"), F.max("c_custkey").alias("ord"))
    nations = n.select(region(F.col("n_regionkey")).alias("region"), F.col("n_name").alias("nation"))
    return {"shops": shops, "nations": nations, "suppliers": s.select(F.col("s_suppkey").alias("supplier"), region(F.col("s_nationkey")).alias("region"))}


_FED = """shops AS (SELECT nullif(c_nationkey % 5, 0) AS region, c_mktsegment AS segment, count(*) AS customers, max(c_custkey) AS ord FROM customer GROUP BY 1, 2),
nations AS (SELECT nullif(n_regionkey % 5, 0) AS region, n_name AS nation FROM nation)"""


@REG.query(f"WITH {_FED}, l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY region ORDER BY ord DESC) AS k FROM shops) WHERE k = 1) SELECT l.region, segment, customers, ord, nation FROM l JOIN nations ON l.region IS NOT DISTINCT FROM nations.region")
def jn_federated(spark: SparkSession, d: str) -> DataFrame:
    s = _sources(spark, d)
    return fe.federated_join({k: s[k] for k in ("shops", "nations")}, ["region"])


@REG.query(f"WITH {_FED} SELECT region, segment, customers FROM shops UNION ALL SELECT region, NULL, NULL FROM nations UNION ALL SELECT nullif(s_nationkey % 5, 0), NULL, NULL FROM supplier")
def set_union_all(spark: SparkSession, d: str) -> DataFrame:
    s = _sources(spark, d)
    return fe.federated_union([s["shops"].drop("ord"), s["nations"], s["suppliers"]])


@REG.query(f"WITH {_FED} SELECT region, sum(customers)::BIGINT AS customers FROM (SELECT region, customers FROM shops UNION ALL SELECT region, NULL FROM nations) GROUP BY 1")
def set_merge(spark: SparkSession, d: str) -> DataFrame:
    s = _sources(spark, d)
    return fe.federated_merge([s["shops"].select("region", "customers"), s["nations"]], ["region"], {"customers": F.sum})


@REG.query("SELECT n_regionkey AS region, count(*) AS n FROM nation GROUP BY 1")
def federated_driver(spark: SparkSession, d: str) -> DataFrame:
    q = fe.FederatedQuery({"good": (1, lambda: table(spark, d, "nation").select(F.col("n_regionkey").alias("region"))), "bad": (2, lambda: table(spark, d, "no_such_table"))}, retries=1, wait=0.01)
    return fe.federated_union(list(q.fetch().values())).groupBy("region").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- sources as queries


@REG.query("SELECT c_mktsegment, count(*) AS n, max(c_custkey) AS top FROM customer WHERE c_acctbal > 100.0 AND c_mktsegment <> 'MACHINERY' GROUP BY 1")
def src_query(spark: SparkSession, d: str) -> DataFrame:
    catalog = wh.Catalog(spark, {"customer": f"{d}/customer.parquet"})
    return catalog.query("SELECT c_mktsegment, count(*) AS n, max(c_custkey) AS top FROM customer WHERE c_acctbal > :low AND c_mktsegment <> :not GROUP BY 1", {"low": 100.0, "not": "MACHINERY"})


@REG.query()
def src_schema(spark: SparkSession, d: str) -> DataFrame:
    return wh.Catalog(spark, {t: f"{d}/{t}.parquet" for t in ("customer", "orders", "nation")}).schema_info()


@REG.query()
def src_table_sample(spark: SparkSession, d: str) -> DataFrame:
    return wh.Catalog(spark, {"customer": f"{d}/customer.parquet"}).sample("customer", 100)


@REG.query("SELECT c_custkey, (c_acctbal + 10) * 2 - c_custkey / 4 AS a, floor(c_acctbal / 7.0) AS b, c_acctbal - floor(c_acctbal / -3.0) * -3.0 AS c, greatest(abs(c_acctbal), 500.0) AS d, round_even(c_acctbal / 10, 0) + 0.0 AS e, power(c_custkey % 7, 2)::DOUBLE AS f FROM customer".replace("c_custkey % 7", "(c_custkey - floor(c_custkey / 7.0) * 7)"))
def prj_expr(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "customer").select("c_custkey", "c_acctbal")
    texts = {"a": "(c_acctbal + 10) * 2 - c_custkey / 4", "b": "c_acctbal // 7", "c": "c_acctbal % -3", "d": "max(abs(c_acctbal), 500.0)", "e": "round(c_acctbal / 10)", "f": "(c_custkey % 7) ** 2"}
    return df.select("c_custkey", *[compile_expression(t, df.columns).alias(k) for k, t in texts.items()])
