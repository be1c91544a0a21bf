"""Tables of allow-listed databases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spindrift.plans.guard import allow_listed


def tables(spark: SparkSession, databases: list[str] | None = None) -> DataFrame:
    """table, columns array<string> (`name:type`), rows long of every table of the databases.

    Row counts come from the catalog's statistics where it has some (ANALYZE TABLE makes them, a write drops them), else from a
    count, which of Parquet and ORC files reads the footers only.
    """
    known = spark._jsparkSession.sessionState().catalog()
    identifier = spark.sparkContext._jvm.org.apache.spark.sql.catalyst.TableIdentifier
    out = []
    for database in databases or allow_listed():
        for t in spark.catalog.listTables(database):
            if t.isTemporary:
                continue
            name = f"{t.catalog or 'spark_catalog'}.{database.split('.')[-1]}.{t.name}"
            df = spark.table(name)
            rows = None
            if not t.catalog or t.catalog == "spark_catalog":
                stats = known.getTableMetadata(identifier(t.name, spark.sparkContext._jvm.scala.Option.apply(database.split(".")[-1]))).stats()
                rows = int(str(stats.get().rowCount().get())) if stats.isDefined() and stats.get().rowCount().isDefined() else None
            out.append((name, [f"{f.name}:{f.dataType.simpleString()}" for f in df.schema.fields], df.count() if rows is None else rows))
    return spark.createDataFrame(out, "table string, columns array<string>, rows long")
