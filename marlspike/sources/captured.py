"""A Spark data source over captured responses in JSON lines, one partition a file.

    spark.dataSource.register(CapturedResponses)
    spark.read.format("captured").load("/folder")
"""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class CapturedResponses(DataSource):
    """Lines that are no JSON object come as rows with `error`, never as failures."""

    @classmethod
    def name(cls) -> str:
        return "captured"

    def schema(self) -> str:
        return "source string, request_url string, query string, status int, body string, error string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(str(p)) for p in sorted(Path(self.path).glob("*.jsonl"))] or [InputPartition("")]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        import json

        if not partition.value:
            return
        with open(partition.value, encoding="utf-8", errors="replace") as lines:
            for line in lines:
                if not line.strip():
                    continue
                try:
                    row = json.loads(line)
                    status = row.get("status")
                    yield row.get("source"), row.get("request_url"), row.get("query"), status if isinstance(status, int) else None, row.get("body"), None
                except (ValueError, AttributeError) as e:
                    yield None, None, None, None, None, f"{type(e).__name__}: {e}"[:200]
