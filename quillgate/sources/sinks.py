"""Where records go: audit and trace lines."""

from __future__ import annotations

import json
import threading
from dataclasses import asdict, is_dataclass
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame


class JsonLines:
    """Appends one JSON object a line; may be called from several threads."""

    def __init__(self, path: str | Path) -> None:
        self.path = Path(path)
        self._lock = threading.Lock()

    def __call__(self, record: Any) -> None:
        data = asdict(record) if is_dataclass(record) else dict(record)
        with self._lock, self.path.open("a", encoding="utf-8") as f:
            f.write(json.dumps(data, ensure_ascii=False, default=str) + "\n")


def append_rows(df: DataFrame, path: str, kind: str = "parquet", by: tuple[str, ...] = ()) -> None:
    """Adds rows to a table of files, partitioned by ``by``."""
    writer = df.write.mode("append").format(kind)
    (writer.partitionBy(*by) if by else writer).save(path)
