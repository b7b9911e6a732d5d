"""SQL-database sources over Spark's JDBC reader.

MySQL, PostgreSQL, SQLite and ClickHouse share one reader; only the URL and
driver class differ. A bounded numeric ``partition_column`` splits the scan
into ``num_partitions`` parallel range queries (only possible with a table,
not a free-form query)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

DRIVERS = {
    "mysql": "com.mysql.cj.jdbc.Driver",
    "postgresql": "org.postgresql.Driver",
    "sqlite": "org.sqlite.JDBC",
    "clickhouse": "com.clickhouse.jdbc.ClickHouseDriver",
    "derby": "org.apache.derby.iapi.jdbc.AutoloadedDriver",
}
DEFAULT_PORTS = {"mysql": 3306, "postgresql": 5432, "clickhouse": 8123}


def jdbc_url(kind: str, params: dict) -> str:
    kind = kind.lower()
    if kind == "sqlite":
        return f"jdbc:sqlite:{params['path']}"
    if kind == "derby":
        return f"jdbc:derby:{params['path']}"
    if kind not in DEFAULT_PORTS:
        raise ValueError(f"unsupported database type: {kind}")
    host = params.get("host", "localhost")
    port = params.get("port", DEFAULT_PORTS[kind])
    return f"jdbc:{kind}://{host}:{port}/{params.get('database', '')}"


def jdbc_options(kind: str, params: dict, query: str | None = None, table: str | None = None,
                 partition_column: str | None = None, lower: int | None = None, upper: int | None = None,
                 num_partitions: int | None = None, fetch_size: int = 10_000) -> dict:
    """Options for ``spark.read.format('jdbc')``; exactly one of query/table."""
    if (query is None) == (table is None):
        raise ValueError("give exactly one of query or table")
    opts = {"url": jdbc_url(kind, params), "driver": DRIVERS[kind.lower()], "fetchsize": str(fetch_size)}
    if params.get("user"):
        opts["user"] = params["user"]
    if params.get("password"):
        opts["password"] = params["password"]
    if query is not None:
        opts["query"] = query
    else:
        opts["dbtable"] = table
        if partition_column:
            if lower is None or upper is None or not num_partitions:
                raise ValueError("partitioned reads need lower, upper and num_partitions")
            opts.update(partitionColumn=partition_column, lowerBound=str(lower), upperBound=str(upper),
                        numPartitions=str(num_partitions))
    return opts


def read_jdbc(spark: SparkSession, kind: str, params: dict, query: str | None = None, table: str | None = None,
              **kw) -> DataFrame:
    """One SQL result as a DataFrame (filters on it are pushed to the database)."""
    return spark.read.format("jdbc").options(**jdbc_options(kind, params, query, table, **kw)).load()


def import_sql(spark: SparkSession, kind: str, params: dict, query: str, out_path: str) -> DataFrame:
    """Run the query, refuse an empty result, persist it as Parquet and
    return the persisted table."""
    df = read_jdbc(spark, kind, params, query=query)
    if df.isEmpty():
        raise ValueError("the SQL query returned no rows")
    df.write.mode("overwrite").parquet(out_path)
    return spark.read.parquet(out_path)
