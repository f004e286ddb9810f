"""Data products: one query over gold, published as a view or a stored table.

A view is its text, stored in the lake: whoever reads it, in whatever session, reads the gold
tables of that moment. Only queries are accepted: the text is compiled as a subquery, where
nothing else parses.
"""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starmill.sources.files import delete_path, list_names, read_text, write_text
from starmill.sources.lake import Lake

STATUS_SCHEMA = (
    "id string, status string, target string, object_kind string, row_count long, error string"
)


class Products:
    """Builds and reads the products of a lake."""

    def __init__(self, lake: Lake):
        self.lake = lake
        self._definitions = f"{lake.root}/products/_views"

    def use_gold(self) -> None:
        """Make gold tables resolvable by bare name (their stored schemas open them)."""
        for table in self.lake.tables("gold"):
            self.lake.read("gold", table).createOrReplaceTempView(table)

    def query(self, text: str) -> DataFrame:
        """The frame of a query over the present gold tables."""
        self.use_gold()
        return self.lake.spark.sql(f"SELECT * FROM (\n{text}\n)")

    def build(self, product: Mapping[str, Any]) -> dict[str, Any]:
        """``{id, status, target, object_kind, row_count, error}``; a bad query or an incomplete
        definition is a failed status, not an exception."""
        name = product.get("id") or ""
        sql = (product.get("sql") or "").strip().rstrip(";")
        kind = "TABLE" if (product.get("product_type") or "view").strip().lower() == "table" else "VIEW"
        status = {"id": name, "status": "failed", "target": None, "object_kind": None,
                  "row_count": None, "error": ""}
        if not name or not sql:
            return {**status, "error": "definition lacks 'id' or 'sql'"}
        status["object_kind"] = kind
        try:
            rows = self._publish(name, kind, sql)
        except PySparkException as problem:
            return {**status, "error": str(problem).strip().splitlines()[0]}
        return {**status, "status": "built", "target": f"products.{name}", "row_count": rows}

    def _publish(self, name: str, kind: str, sql: str) -> int:
        found = self.query(sql)
        definition = f"{self._definitions}/{name}.sql"
        if kind == "TABLE":
            self.lake.overwrite(found, "products", name)
            delete_path(self.lake.spark, definition)
            return self.lake.read("products", name).count()
        rows = found.count()  # needs no column of the result
        write_text(self.lake.spark, definition, sql)
        return rows

    def views(self) -> list[str]:
        names = list_names(self.lake.spark, self._definitions)
        return [n.removesuffix(".sql") for n in names if n.endswith(".sql")]

    def frame(self, name: str) -> DataFrame:
        """A view's query over the gold tables as they are now, or the stored table."""
        if name in self.views():
            return self.query(read_text(self.lake.spark, f"{self._definitions}/{name}.sql"))
        return self.lake.read("products", name)

    def listing(self) -> DataFrame:
        """``(table, rows)`` of everything published, by any session."""
        counts = self.lake.spark.createDataFrame([], "table string, rows long")
        for name in sorted({*self.views(), *self.lake.tables("products")}):
            rows = self.frame(name).agg(F.count(F.lit(1)).alias("rows"))
            counts = counts.unionByName(rows.select(F.lit(name).alias("table"), "rows"))
        return counts
