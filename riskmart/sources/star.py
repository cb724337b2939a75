"""Reading and writing the star schema as Parquet."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskmart.sources import schema as S

#: table name -> (attribute of ``Star``, schema)
TABLES = {
    "fact_transactions": ("fact", S.FACT_TRANSACTIONS),
    "dim_customer": ("customer", S.DIM_CUSTOMER),
    "dim_account": ("account", S.DIM_ACCOUNT),
    "dim_merchant": ("merchant", S.DIM_MERCHANT),
    "dim_location": ("location", S.DIM_LOCATION),
    "dim_date": ("date", S.DIM_DATE),
}


@dataclass(frozen=True)
class Star:
    """The six tables every operator works on.

    ``load`` turns a table name into a DataFrame; a table that no query names is
    never loaded.
    """

    load: Callable[[str], DataFrame]

    @cached_property
    def fact(self) -> DataFrame:
        return self.load("fact_transactions")

    @cached_property
    def customer(self) -> DataFrame:
        return self.load("dim_customer")

    @cached_property
    def account(self) -> DataFrame:
        return self.load("dim_account")

    @cached_property
    def merchant(self) -> DataFrame:
        return self.load("dim_merchant")

    @cached_property
    def location(self) -> DataFrame:
        return self.load("dim_location")

    @cached_property
    def date(self) -> DataFrame:
        return self.load("dim_date")


#: the folders the stored fact is split into
MONTH = "transaction_month"


def read_star(
    spark: SparkSession, path: str, months: tuple[str, str] | None = None
) -> Star:
    """The star stored below ``path``, one Parquet folder per table.

    ``months`` (first and last, as "2024-01") limits the fact to whole months by its
    folders; others are not listed as input at all. Rows without a date are then out.
    """

    def load(table: str) -> DataFrame:
        schema = TABLES[table][1]
        if table != "fact_transactions" or months is None:
            return conform(spark.read.schema(schema).parquet(f"{path}/{table}"), schema)
        split = T.StructType([*schema, T.StructField(MONTH, T.StringType())])
        fact = spark.read.schema(split).parquet(f"{path}/{table}")
        return conform(fact.filter(F.col(MONTH).between(*months)), schema)

    return Star(load)


def write_star(
    star: Star, path: str, mode: str = "errorifexists", partitions: int | None = None,
    rows_per_file: int = 10_000_000,
) -> None:
    """Store the star so that later scans can skip most of it.

    ``partitions`` is the number of tasks that sort the fact (by default that of any
    shuffle); at 100 TB choose it for about a gigabyte each.

    The fact is split by month and ordered by customer and time within a month.
    The range exchange cuts on the time as well, so the rows of one very busy
    customer are spread over many tasks and files instead of filling one.
    """
    for table, (attribute, schema) in TABLES.items():
        frame = conform(getattr(star, attribute), schema)
        writer = frame.write
        if table == "fact_transactions":
            order = (MONTH, "customer_key", "transaction_datetime")
            frame = frame.withColumn(MONTH, F.date_format("transaction_date", "yyyy-MM"))
            dealt = (frame.repartitionByRange(*order) if partitions is None
                     else frame.repartitionByRange(partitions, *order))
            writer = (dealt.sortWithinPartitions(*order)
                      .write.option("maxRecordsPerFile", rows_per_file).partitionBy(MONTH))
        writer.mode(mode).parquet(f"{path}/{table}")


#: what a clustered copy of the fact is dealt by
CLUSTER_KEY, CLUSTER_ORDER = "customer_key", ("customer_key", "transaction_datetime")
CLUSTERED, LAYOUT = "fact_clustered", "fact_clustered_layout"


def write_clustered(
    star: Star, path: str, buckets: int, max_skew: float = 4.0, mode: str = "errorifexists"
) -> bool:
    """Store a copy of the fact in ``buckets`` by customer beside the star at ``path``.

    Grouping this copy by customer, alone or with other columns, needs no shuffle: a task
    reads the sorted files of one bucket. That holds while buckets are of like size, so
    rows are counted per bucket first (one partial sum per bucket and task). If the
    largest has more than ``max_skew`` times its share, as when one customer holds a
    third of all rows, nothing is stored but that finding, and readers take the star's
    own fact, whose rows are dealt out evenly. Returns whether the copy was made.
    """
    spark = star.fact.sparkSession
    fact = conform(star.fact, S.FACT_TRANSACTIONS)
    sizes = fact.groupBy(F.pmod(F.hash(CLUSTER_KEY), F.lit(buckets)).alias("bucket")).count().agg(
        F.max("count").alias("most"), F.sum("count").alias("rows")).head()
    even = sizes.rows is None or sizes.most * buckets <= max_skew * sizes.rows or sizes.most <= buckets
    if even:
        name = _table_name(path)
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        # one task a bucket, so that a bucket is few files
        (fact.repartition(buckets, CLUSTER_KEY).write.mode(mode).format("parquet")
         .bucketBy(buckets, CLUSTER_KEY).sortBy(*CLUSTER_ORDER)
         .option("path", f"{path}/{CLUSTERED}").saveAsTable(name))
        spark.sql(f"DROP TABLE {name}")  # the files stay: the table is external
    spark.range(1).select(F.lit(buckets if even else 0).alias("buckets")).write.mode(mode).parquet(
        f"{path}/{LAYOUT}")
    return even


def read_clustered(spark: SparkSession, path: str) -> Star:
    """The star at ``path`` with the fact from its copy by customer, where one was made."""
    plain = read_star(spark, path)
    buckets = spark.read.parquet(f"{path}/{LAYOUT}").head().buckets

    def load(table: str) -> DataFrame:
        if table != "fact_transactions" or not buckets:
            return plain.load(table)
        name = _table_name(path)
        columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in S.FACT_TRANSACTIONS)
        # Spark learns of buckets from its catalog only; the entry names files and owns none
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({CLUSTER_KEY}) "
                  f"SORTED BY ({', '.join(CLUSTER_ORDER)}) INTO {buckets} BUCKETS "
                  f"LOCATION '{path}/{CLUSTERED}'")
        return conform(spark.table(name), S.FACT_TRANSACTIONS)

    return Star(load)


def _table_name(path: str) -> str:
    return "riskmart_fact_" + hashlib.md5(path.encode()).hexdigest()


def conform(frame: DataFrame, schema: T.StructType) -> DataFrame:
    """Columns of ``frame`` in the order and types of ``schema``."""
    return frame.select(
        *(F.col(field.name).cast(field.dataType) for field in schema))
