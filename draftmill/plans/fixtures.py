"""Input relations derived from the sales tables, and the same as DuckDB SQL for the oracles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from draftmill.sources.workdir import shared

AS_OF = "1998-08-02"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df in as many partitions as there are cores at least: a small table may be one file, and all that follows one task."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


#: Rows of a task whose work on each is dear.
TASK_ROWS = 1 << 16


def dealt(df: DataFrame, key: str, rows: int) -> DataFrame:
    """df in tasks of some TASK_ROWS, by a unique key: a shuffle that is cut by bytes alone leaves as many tasks as there are cores, which grow with the input."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // TASK_ROWS)), key)


def checks_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a submission: each order, and each twentieth once more."""
    orders = spread(table(spark, sf_dir, "orders")).select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderpriority")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
    nation = F.broadcast(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"))  # 25 rows
    k = F.col("k")
    df = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey")).withColumnRenamed("o_orderkey", "k")
    df = df.select("*", F.explode(F.when(k % 20 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("sub_no"))
    p8 = (F.lit(12_100_000) + F.col("c_nationkey") * 137).cast("string")

    def d(i: int) -> Column:
        return F.substring("p8", i, 1).cast("int")

    df = df.withColumn("p8", p8)
    good = (10 - (3 * (d(1) + d(4) + d(7)) + 7 * (d(2) + d(5) + d(8)) + (d(3) + d(6))) % 10) % 10
    routing = F.when(k % 97 == 0, None).when(k % 31 == 0, F.col("p8")).otherwise(F.concat("p8", F.when(k % 10 == 7, (good + 1) % 10).otherwise(good).cast("string")))
    return df.select(
        (2 * k + F.col("sub_no")).alias("rid"),
        routing.alias("routing_number"),
        F.when(k % 41 == 0, None).when(k % 43 == 0, "12").otherwise((F.lit(10_000_000) + F.col("o_custkey")).cast("string")).alias("account_number"),
        F.when(k % 53 == 0, None).otherwise((1001 + k).cast("string")).alias("check_number"),
        F.when(k % 59 != 0, F.col("o_totalprice").cast("decimal(12,2)")).alias("amount"),
        F.when(k % 61 == 0, None).when(k % 67 == 0, "illegible").when(k % 13 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(F.date_format("o_orderdate", "MM/dd/yyyy")).alias("check_date"),
        (50 + (7 * k) % 51).cast("int").alias("confidence"),
        F.when(k % 11 == 0, None).when(k % 17 == 0, False).otherwise(True).alias("amounts_match"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "poor").when(F.col("o_orderpriority") == "2-HIGH", "fair").when(F.col("o_orderpriority") == "3-MEDIUM", "good").otherwise("excellent").alias("check_condition"),
        (F.col("o_orderdate").cast("date") + (k % 5 + 30 * F.col("sub_no")).cast("int")).alias("received_on"),
        F.when(k % 71 == 0, F.lit("unreadable response")).alias("error"),
        F.col("c_name").alias("customer_name"),
        F.col("n_name").alias("state"),
        F.when(k % 6 == 0, F.concat(F.lit("order "), k.cast("string"))).alias("memo"),
        F.when(k % 29 != 0, 45 + (11 * k) % 56).cast("int").alias("payee_confidence"),
        F.expr("k div 8").alias("file"),
        (k % 3).alias("page"),
    )


def clashing(raw: DataFrame) -> DataFrame:
    """raw with the boundary of account and check number moved in every other row: other keys, but the same text of the id."""
    move = F.col("rid") % 2 == 1
    account = F.concat("account_number", F.left("check_number", F.lit(1)))
    return raw.withColumns({"account_number": F.when(move, account).otherwise(F.col("account_number")), "check_number": F.when(move, F.expr("substring(check_number, 2)")).otherwise(F.col("check_number"))})


CLASHING_SQL = """
clashing AS (
  SELECT * REPLACE (CASE WHEN rid % 2 = 1 THEN account_number || left(check_number, 1) ELSE account_number END AS account_number,
                    CASE WHEN rid % 2 = 1 THEN check_number[2:] ELSE check_number END AS check_number) FROM checks_raw)"""


def stored(df: DataFrame, label: str) -> DataFrame:
    """df as a stored table: a relation that several branches of a plan read is derived once, and a lost executor never makes it run again."""
    path = shared(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


CHECKS_RAW_SQL = """
o AS (
  SELECT o_orderkey AS k, o_custkey, o_totalprice, CAST(o_orderdate AS DATE) AS d, o_orderpriority, c_name, c_nationkey, n_name,
         unnest(CASE WHEN o_orderkey % 20 = 0 THEN [0, 1] ELSE [0] END) AS sub_no
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
p AS (SELECT *, CAST(12100000 + c_nationkey * 137 AS VARCHAR) AS p8 FROM o),
q AS (SELECT *, (10 - (3 * (CAST(p8[1] AS INT) + CAST(p8[4] AS INT) + CAST(p8[7] AS INT)) + 7 * (CAST(p8[2] AS INT) + CAST(p8[5] AS INT) + CAST(p8[8] AS INT))
       + CAST(p8[3] AS INT) + CAST(p8[6] AS INT)) % 10) % 10 AS good FROM p),
checks_raw AS (
  SELECT 2 * k + sub_no AS rid,
    CASE WHEN k % 97 = 0 THEN NULL WHEN k % 31 = 0 THEN p8 WHEN k % 10 = 7 THEN p8 || CAST((good + 1) % 10 AS VARCHAR) ELSE p8 || CAST(good AS VARCHAR) END AS routing_number,
    CASE WHEN k % 41 = 0 THEN NULL WHEN k % 43 = 0 THEN '12' ELSE CAST(10000000 + o_custkey AS VARCHAR) END AS account_number,
    CASE WHEN k % 53 = 0 THEN NULL ELSE CAST(1001 + k AS VARCHAR) END AS check_number,
    CASE WHEN k % 59 <> 0 THEN CAST(o_totalprice AS DECIMAL(12, 2)) END AS amount,
    CASE WHEN k % 61 = 0 THEN NULL WHEN k % 67 = 0 THEN 'illegible' WHEN k % 13 = 0 THEN strftime(d, '%Y-%m-%d') ELSE strftime(d, '%m/%d/%Y') END AS check_date,
    CAST(50 + (7 * k) % 51 AS INT) AS confidence,
    CASE WHEN k % 11 = 0 THEN NULL WHEN k % 17 = 0 THEN false ELSE true END AS amounts_match,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'poor' WHEN '2-HIGH' THEN 'fair' WHEN '3-MEDIUM' THEN 'good' ELSE 'excellent' END AS check_condition,
    d + CAST(k % 5 + 30 * sub_no AS INT) AS received_on,
    CASE WHEN k % 71 = 0 THEN 'unreadable response' END AS error,
    c_name AS customer_name, n_name AS state,
    CASE WHEN k % 6 = 0 THEN 'order ' || CAST(k AS VARCHAR) END AS memo,
    CASE WHEN k % 29 <> 0 THEN CAST(45 + (11 * k) % 56 AS INT) END AS payee_confidence,
    k // 8 AS file, k % 3 AS page
  FROM q)"""


def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connected components of scanned pages, one a line item."""
    li = spread(table(spark, sf_dir, "lineitem"))
    page = F.expr("l_orderkey div 8")
    w = Window.partitionBy(page).orderBy(*li.columns)
    q, pk, sk, ln = F.col("l_quantity").cast("int"), F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber")
    y = F.when(F.col("page") % 5 == 0, 100 + (ln % 2) * 520 + pk % 480).otherwise(
        100 + (ln % (1 + F.col("page") % 4)) * 1300 + F.when((F.col("page") % 3 == 0) & (ln == 7), 900).when(pk % 29 == 0, 250).otherwise(pk % 100)
    )
    df = li.withColumn("label", F.row_number().over(w)).withColumn("page", page)
    df = df.select("page", "label", F.when(pk % 200 == 0, 0).otherwise(100 + (sk * 17) % 2000).cast("long").alias("x"), y.cast("long").alias("y"), (5 + q).cast("long").alias("w"), (5 + pk % 40).cast("long").alias("h"))
    return df.withColumns({"area": F.col("w") * F.col("h"), "cx": F.col("x") + F.col("w") / 2.0, "cy": F.col("y") + F.col("h") / 2.0})


COMPONENTS_SQL = """
comp0 AS (
  SELECT l_orderkey // 8 AS page, row_number() OVER (PARTITION BY l_orderkey // 8 ORDER BY l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity,
         l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS label,
         CASE WHEN l_partkey % 200 = 0 THEN 0 ELSE 100 + (l_suppkey * 17) % 2000 END AS x, l_partkey AS pk, l_linenumber AS ln, CAST(l_quantity AS INT) AS q FROM lineitem),
components AS (
  SELECT page, label, x,
         CASE WHEN page % 5 = 0 THEN 100 + (ln % 2) * 520 + pk % 480
              ELSE 100 + (ln % (1 + page % 4)) * 1300 + CASE WHEN page % 3 = 0 AND ln = 7 THEN 900 WHEN pk % 29 = 0 THEN 250 ELSE pk % 100 END END AS y,
         5 + q AS w, 5 + pk % 40 AS h FROM comp0)"""
