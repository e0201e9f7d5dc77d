"""A streaming source that polls timelines by cursor: the greatest numeric id seen of each instance and tag is its offset."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

SCHEMA = "instance string, tag string, id bigint, account string"
_COLUMNS = ("id", "account")


@dataclass
class Part(InputPartition):
    """The posts of one file of a timeline whose id lies in (after, upto]."""

    instance: str
    tag: str
    file: str
    after: int
    upto: int


class Timelines(DataSource):
    """Posts in Parquet files under path/instance=.../tag=.../, ids growing within each timeline.

    A post comes once: a run goes on from the cursors that the checkpoint holds, and files that appear between planning and reading
    add nothing to a batch that was planned. As with any such poll, a post that appears with an id under its cursor is not seen.
    """

    @classmethod
    def name(cls) -> str:
        return "timelines"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return TimelineReader(self.options["path"])


class TimelineReader(DataSourceStreamReader):
    def __init__(self, path: str):
        self.path = path
        self.known: dict[str, tuple[int, int] | None] = {}  # least and greatest id of each file, which never change

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        """The greatest id of each timeline, by the footers of its files alone."""
        cursors: dict[str, int] = {}
        for instance, tag, file in self._files():
            ends = self._ends(file)
            if ends:
                key = f"{instance}|{tag}"
                cursors[key] = max(cursors.get(key, ends[1]), ends[1])
        return cursors

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        parts = []
        for instance, tag, file in self._files():
            key, ends = f"{instance}|{tag}", self._ends(file)
            after, upto = start.get(key, -(1 << 63)), end.get(key, -(1 << 63))
            if ends and ends[1] > after and ends[0] <= upto:
                parts.append(Part(instance, tag, file, after, upto))
        return parts

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        system, _ = fs.FileSystem.from_uri(self.path)
        with system.open_input_file(partition.file) as source:
            for batch in pq.ParquetFile(source).iter_batches(columns=list(_COLUMNS)):
                id_ = batch.column("id")
                new = batch.filter(pc.and_(pc.greater(id_, partition.after), pc.less_equal(id_, partition.upto)))
                same = lambda value, n=new.num_rows: pa.array([value] * n, pa.string())
                yield pa.RecordBatch.from_arrays([same(partition.instance), same(partition.tag), *(new.column(c) for c in _COLUMNS)], names=["instance", "tag", *_COLUMNS])

    def commit(self, end: dict) -> None:
        pass

    def _files(self) -> list[tuple[str, str, str]]:
        system, root = fs.FileSystem.from_uri(self.path)
        out = []
        for found in system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)):
            named = dict(p.split("=", 1) for p in found.path[len(root) :].strip("/").split("/")[:-1] if "=" in p)
            if found.is_file and found.path.endswith(".parquet") and named.keys() >= {"instance", "tag"}:
                out.append((unquote(named["instance"]), unquote(named["tag"]), found.path))
        return sorted(out)

    def _ends(self, file: str) -> tuple[int, int] | None:
        if file not in self.known:
            system, _ = fs.FileSystem.from_uri(self.path)
            with system.open_input_file(file) as source:
                about = pq.ParquetFile(source).metadata
            at = next(i for i in range(about.num_columns) if about.schema.column(i).name == "id")
            stats = [about.row_group(g).column(at).statistics for g in range(about.num_row_groups)]
            stats = [s for s in stats if s is not None and s.has_min_max]
            self.known[file] = (min(s.min for s in stats), max(s.max for s in stats)) if stats else None
        return self.known[file]
