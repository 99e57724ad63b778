"""Landing folders as a Spark data source: ``spark.read.format("landed_payloads")``.

A landing folder holds Parquet files, or files with one JSON object per line, that some collector
writes. The source gives payload rows for ``parse_payloads``; as a stream it follows the folder.

Options: ``path`` (a file or folder, or the URI of one on HDFS, S3 or GCS), ``url``, ``body`` and
``seq`` (their column names; without ``seq`` rows have no number), ``tags`` (comma-separated), ``language``,
``fetched_at`` (ISO time) and ``metadata`` (a JSON object) for all rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.json as pajson
import pyarrow.parquet as pq
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from feedlens.schemas import PAYLOAD

BATCH_ROWS = 500

_SHAPE = pa.schema(
    [
        ("source_url", pa.string()),
        ("body", pa.string()),
        ("config_tags", pa.list_(pa.string())),
        ("config_language", pa.string()),
        ("config_metadata", pa.map_(pa.string(), pa.string())),
        ("fetched_at", pa.timestamp("us")),
        ("payload_seq", pa.int64()),
    ]
)


@dataclass
class Piece(InputPartition):
    """A row group of a Parquet file, or (-1) a whole file of JSON lines."""

    path: str
    group: int


class _Landing:
    """Files of the folder and how a piece of one becomes payload rows."""

    def __init__(self, options: dict[str, str]) -> None:
        if not options.get("path"):
            raise ValueError("landed_payloads needs a path")
        self.options = dict(options)

    def _open(self) -> tuple[pafs.FileSystem, str]:
        path = self.options["path"]
        return pafs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (pafs.LocalFileSystem(), path)

    def files(self) -> list[tuple[int, str]]:
        """(time of change, path) of the landed files, oldest first; hidden and unfinished files are left out."""
        system, path = self._open()
        info = system.get_file_info(path)
        if info.type == pafs.FileType.NotFound:
            raise FileNotFoundError(f"no landing folder {self.options['path']}")
        found = [info] if info.is_file else system.get_file_info(pafs.FileSelector(path, recursive=True))
        shown = [f for f in found if f.is_file and f.size and not any(part.startswith((".", "_")) for part in f.path[len(path) :].split("/"))]
        return sorted((f.mtime_ns or 0, f.path) for f in shown)

    def pieces(self, files: list[str]) -> list[Piece]:
        system, _ = self._open()
        out = []
        for path in files:
            if path.endswith(".parquet"):
                with system.open_input_file(path) as file:
                    out += [Piece(path, g) for g in range(pq.ParquetFile(file).num_row_groups)]
            else:
                out.append(Piece(path, -1))
        return out

    def rows(self, piece: Piece) -> Iterator[pa.RecordBatch]:
        system, _ = self._open()
        names = {"source_url": self.options.get("url", "url"), "body": self.options.get("body", "body")}
        if self.options.get("seq"):
            names["payload_seq"] = self.options["seq"]
        with system.open_input_file(piece.path) as file:
            if piece.group >= 0:
                parts = pq.ParquetFile(file).iter_batches(BATCH_ROWS, [piece.group], list(names.values()))
            else:
                parts = pajson.open_json(file)
            for part in parts:
                for at in range(0, part.num_rows, BATCH_ROWS):
                    yield self._payloads(part.slice(at, BATCH_ROWS), names)

    def _payloads(self, part: pa.RecordBatch, names: dict[str, str]) -> pa.RecordBatch:
        n, o = part.num_rows, self.options
        when = datetime.fromisoformat(o["fetched_at"]) if o.get("fetched_at") else None
        fixed = {
            "config_tags": [t for t in o.get("tags", "").split(",") if t],
            "config_language": o.get("language", ""),
            "config_metadata": list(json.loads(o.get("metadata") or "{}").items()),
            "fetched_at": when,
            "payload_seq": None,
        }
        columns = []
        for field in _SHAPE:
            if field.name in names:
                columns.append(part.column(names[field.name]).cast(field.type))
            else:
                columns.append(pa.array([fixed[field.name]] * n, field.type))
        return pa.RecordBatch.from_arrays(columns, schema=_SHAPE)


class LandedReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.landing = _Landing(options)

    def partitions(self) -> list[Piece]:
        return self.landing.pieces([path for _, path in self.landing.files()])

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        return self.landing.rows(partition)


class LandedStreamReader(DataSourceStreamReader):
    """Follows the folder; the offset is the newest file seen, by time of change and path."""

    def __init__(self, options: dict[str, str]) -> None:
        self.landing = _Landing(options)

    def initialOffset(self) -> dict:  # noqa: N802 - Spark's name
        return {"mtime": -1, "path": ""}

    def latestOffset(self) -> dict:  # noqa: N802
        files = self.landing.files()
        return {"mtime": files[-1][0], "path": files[-1][1]} if files else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        after, upto = ((o["mtime"], o["path"]) for o in (start, end))
        return self.landing.pieces([f[1] for f in self.landing.files() if after < f <= upto])

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        return self.landing.rows(partition)


class LandedPayloads(DataSource):
    @classmethod
    def name(cls) -> str:
        return "landed_payloads"

    def schema(self) -> StructType:
        return PAYLOAD

    def reader(self, schema: StructType) -> LandedReader:
        return LandedReader(self.options)

    def streamReader(self, schema: StructType) -> LandedStreamReader:  # noqa: N802
        return LandedStreamReader(self.options)

