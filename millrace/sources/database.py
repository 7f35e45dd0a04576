"""SQL facade: query text in, lazy DataFrames out; and a fluent SELECT."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import number


@dataclass
class TableProfile:
    name: str
    n_rows: int
    columns: list[str]
    dtypes: dict[str, str] = field(default_factory=dict)


class QueryBuilder:
    """SELECT over one table. Conditions are joined by AND, the last ORDER BY counts, an offset comes before the limit."""

    def __init__(self, table: str) -> None:
        self.table, self.columns, self.conditions, self.order, self.n, self.skip = table, ("*",), [], None, None, None

    def select(self, *columns: str) -> "QueryBuilder":
        self.columns = columns or self.columns
        return self

    def where(self, condition: str) -> "QueryBuilder":
        self.conditions.append(condition)
        return self

    def order_by(self, expression: str) -> "QueryBuilder":
        self.order = expression
        return self

    def limit(self, n: int) -> "QueryBuilder":
        self.n = int(n)
        return self

    def offset(self, n: int) -> "QueryBuilder":
        self.skip = int(n)
        return self

    def build(self) -> str:
        parts = [f"SELECT {', '.join(self.columns)} FROM {self.table}"]
        if self.conditions:
            parts.append("WHERE " + " AND ".join(f"({c})" for c in self.conditions))
        parts += [f"{word} {x}" for word, x in (("ORDER BY", self.order), ("LIMIT", self.n), ("OFFSET", self.skip)) if x is not None]
        return " ".join(parts) + ";"

    def to_df(self, spark: SparkSession) -> DataFrame:
        return spark.sql(self.build())


class Database:
    """Tables of a Spark catalog, or those behind a JDBC address (its driver must be on the class path)."""

    def __init__(self, spark: SparkSession, uri: str | None = None, **options: str) -> None:
        self.spark, self.uri, self.options, self.views = spark, uri, options, []

    @classmethod
    def memory(cls, spark: SparkSession) -> "Database":
        return cls(spark)

    @classmethod
    def from_uri(cls, spark: SparkSession, uri: str, **options: str) -> "Database":
        """``jdbc:`` addresses read tables remotely; a folder registers each of its Parquet tables as a view."""
        db = cls(spark, uri if uri.startswith("jdbc:") else None, **options)
        if not uri.startswith("jdbc:"):
            db.register_folder(uri)
        return db

    def register_folder(self, path: str) -> list[str]:
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        at = jvm.org.apache.hadoop.fs.Path(path)
        names = []
        for s in at.getFileSystem(conf).listStatus(at):
            name = s.getPath().getName()
            if name.endswith(".parquet"):
                self.spark.read.parquet(s.getPath().toString()).createOrReplaceTempView(name[:-8])
                names.append(name[:-8])
        self.views += names
        return sorted(names)

    def table(self, name: str) -> DataFrame:
        if self.uri:
            return self.spark.read.format("jdbc").options(url=self.uri, dbtable=name, **self.options).load()
        return self.spark.table(name)

    def query(self, sql: str, params: Sequence | dict | None = None) -> DataFrame:
        """Any SQL; ``?`` and ``:name`` take parameters. Nothing runs before an action."""
        if self.uri:
            if params:
                raise ValueError("queries sent to a JDBC address take no parameters: filter the result, or write the values into the query")
            return self.spark.read.format("jdbc").options(url=self.uri, query=sql.rstrip("; "), **self.options).load()
        return self.spark.sql(sql, args=params) if params else self.spark.sql(sql)

    read_sql = query

    def execute(self, sql: str, params: Sequence | dict | None = None) -> DataFrame:
        return self.query(sql, params)

    def executemany(self, table: str, rows: Iterable[Sequence]) -> None:
        """Rows appended in one write, by position."""
        schema = self.table(table).schema
        self.spark.createDataFrame([tuple(r) for r in rows], schema).write.insertInto(table)

    def to_sql(self, table: str, df: DataFrame, if_exists: str = "append") -> None:
        mode = {"append": "append", "replace": "overwrite", "fail": "errorifexists"}[if_exists]
        if self.uri:
            df.write.format("jdbc").mode(mode).options(url=self.uri, dbtable=table, **self.options).save()
        else:
            df.write.mode(mode).saveAsTable(table)

    def read_parquet(self, path: str, sql_filter: str = "") -> DataFrame:
        df = self.spark.read.parquet(path)
        return df.where(sql_filter) if sql_filter else df

    def list_tables(self) -> list[str]:
        return sorted(t.name for t in self.spark.catalog.listTables())

    def table_info(self, table: str) -> DataFrame:
        """cid, name, type, notnull, default, pk."""
        rows = [(i, f.name, f.dataType.simpleString(), int(not f.nullable), None, 0) for i, f in enumerate(self.table(table).schema.fields)]
        return self.spark.createDataFrame(rows, "cid int, name string, type string, notnull int, dflt_value string, pk int")

    def count(self, table: str, where: str = "") -> int:
        df = self.table(table)
        return (df.where(where) if where else df).count()

    def profile(self, table: str) -> TableProfile:
        df = self.table(table)
        return TableProfile(table, df.count(), df.columns, dict(df.dtypes))

    def load_X_y(self, sql: str, target: str, drop: Sequence[str] = ()) -> tuple[DataFrame, list[str]]:
        return numeric_matrix(self.query(sql), target, drop)

    def train_test_from_sql(self, sql: str, target: str, order_by: Sequence[str], test_size: float | int = 0.25) -> tuple[DataFrame, DataFrame]:
        from ..operators.split import train_test_split

        return train_test_split(self.load_X_y(sql, target)[0], order_by=order_by, test_size=test_size)

    def train_sql(self, sql: str, target: str, estimator=None):
        """Fit a model (by default a forest of 100 trees) on a query's result."""
        from ..operators.trees import RandomForestClassifier

        df, names = self.load_X_y(sql, target)
        return (estimator or RandomForestClassifier(n_estimators=100)).fit(df, names, target)

    def close(self) -> None:
        """Drop the temporary views that this database registered."""
        while self.views:
            self.spark.catalog.dropTempView(self.views.pop())


def numeric_matrix(df: DataFrame, target: str | None, drop: Sequence[str] = ()) -> tuple[DataFrame, list[str]]:
    """Every column but the target and dropped ones as a double, 0 where it is no number; the target as it is."""
    names = [c for c in df.columns if c != target and c not in set(drop)]
    cols = [number(F.col(f"`{c}`")).alias(c) for c in names]
    return df.select(*cols, *([F.col(f"`{target}`")] if target else [])), names


def translate(sql: str) -> str:
    """Statements of other dialects that Spark spells differently."""
    sql = re.sub(r"(?i)\bread_parquet\(\s*'([^']+)'\s*\)", r"parquet.`\1`", sql)
    sql = re.sub(r"(?i)^\s*pragma\s+table_info\(\s*'?(\w+)'?\s*\)\s*;?\s*$", r"DESCRIBE TABLE \1", sql)
    return sql
