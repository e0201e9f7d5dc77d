"""Size-tiered shards: small immutable arrivals, merged into target-sized files under a versioned manifest."""

from __future__ import annotations

import json
import re
import time
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Bytes aimed at in a merged file, the size of the lowest tier, the ratio of tiers, and how many shards of a tier call for a merge.
TARGET, LOWEST, RATIO, FANOUT = 64 << 20, 256 << 10, 4, 4


#: Times that a commit is tried again after other writers' commits, and seconds after which a file that no version names is an orphan.
RETRIES, ORPHAN_AGE = 20, 7 * 86400


class Conflict(RuntimeError):
    """Another writer committed this version first; read the new manifest and try again."""


def free_name(name: str, columns: list[str]) -> str:
    """The name, with as many underscores behind it as it takes to differ from all columns."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def same_form(uri: str) -> str:
    """A file URI as it is compared: local ones have one slash after the scheme."""
    return re.sub("^file:/+", "file:/", uri)


@dataclass(frozen=True)
class Shard:
    path: str
    size: int


def tier(size: int, lowest: int = LOWEST, ratio: int = RATIO) -> int:
    """0 up to the lowest size, then one more for each factor of `ratio`."""
    n = 0
    while size > lowest:
        size, n = size // ratio, n + 1
    return n


def merges(shards: list[Shard], target: int = TARGET, fanout: int = FANOUT) -> list[list[Shard]]:
    """Groups to merge: of each tier below the target with `fanout` shards or more, runs of two or more that near the target."""
    tiers: dict[int, list[Shard]] = {}
    for s in sorted(shards, key=lambda s: (s.size, s.path)):
        if s.size < target // 2:
            tiers.setdefault(tier(s.size), []).append(s)
    out = []
    for members in tiers.values():
        if len(members) < fanout:
            continue
        run: list[Shard] = []
        for s in members:
            if run and sum(x.size for x in run) + s.size > target:
                out.append(run)
                run = []
            run.append(s)
        out.append(run)
    return [run for run in out if len(run) > 1]


class ShardStore:
    """A table of immutable Parquet shards in a folder. A version is one manifest file, committed by a rename that never overwrites.

    The folder's name may hold any characters but those of Hadoop's globs. Writers may run side by side: a commit that comes
    second is tried again on the newer version. This rests on a rename that is atomic, as on HDFS and local disks; stores of objects
    that copy and delete instead give no such promise.
    """

    def __init__(self, spark: SparkSession, folder: str, schema, target: int = TARGET, fanout: int = FANOUT) -> None:
        self.spark, self.folder, self.schema, self.target, self.fanout = spark, folder.rstrip("/"), schema, target, fanout
        if set(self.folder) & set("*?[]{}\\"):
            raise ValueError("the folder's name must not hold glob characters")
        self._jvm = spark._jvm
        self._path = self._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(f"{self.folder}/manifests"))

    def versions(self) -> list[int]:
        names = [x.getPath().getName() for x in self._fs.listStatus(self._path(f"{self.folder}/manifests"))]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def shards(self, version: int | None = None) -> list[Shard]:
        """The shards of a version, the newest by default."""
        known = self.versions()
        if not known:
            return []
        source = self._fs.open(self._path(self._manifest(known[-1] if version is None else version)))
        try:
            body = self._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8")
        finally:
            source.close()
        return [Shard(x["path"], x["size"]) for x in json.loads(body)]

    def _manifest(self, version: int) -> str:
        return f"{self.folder}/manifests/v{version:08d}.json"

    def commit(self, shards: list[Shard], version: int) -> None:
        """Make the shards the given version, or raise Conflict if that version exists."""
        temporary = self._path(f"{self.folder}/manifests/.{uuid.uuid4().hex}")
        out = self._fs.create(temporary, False)
        out.write(bytearray(json.dumps([{"path": s.path, "size": s.size} for s in shards]).encode()))
        out.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(temporary, self._path(self._manifest(version)), none)
        except Exception as error:
            self._fs.delete(temporary, False)
            if self._fs.exists(self._path(self._manifest(version))):
                raise Conflict(f"version {version} exists") from error
            raise  # anything else is no other writer's doing

    def _written(self, folder: str) -> list[Shard]:
        out, files = [], self._fs.listFiles(self._path(folder), True)
        while files.hasNext():
            status = files.next()
            name = status.getPath().toString()
            if name.endswith(".parquet"):
                out.append(Shard(name, status.getLen()))
        return sorted(out, key=lambda s: s.path)

    def _swap(self, gone: set[str], new: list[Shard]) -> int | None:
        """Commit the newest version without the shards `gone` and with the new ones; None if another writer took one of those away."""
        for _ in range(RETRIES):
            version = (self.versions() or [0])[-1]
            live = self.shards(version) if version else []
            if gone - {s.path for s in live}:
                return None
            try:
                self.commit([s for s in live if s.path not in gone] + new, version + 1)
                return version + 1
            except Conflict:
                continue
        raise Conflict(f"no commit within {RETRIES} tries")

    def append(self, rows: DataFrame) -> int:
        """Add rows as new small shards, one for each of their partitions; return the version."""
        folder = f"{self.folder}/data/{uuid.uuid4().hex}"
        rows.write.parquet(folder)
        return self._swap(set(), self._written(folder))

    def _rows(self, paths: list[str]) -> int:
        return self.spark.read.schema(self.schema).parquet(*paths).count() if paths else 0

    def compact(self) -> int:
        """Merge until no tier calls for it; each round is one Spark job and one version. Return the newest version.

        A merged run becomes one file, written by one task that reads at most about `target` bytes. Nothing is committed unless
        the merged files have as many rows as the files that they replace.
        """
        run, file = free_name("__run", self.schema.names), free_name("__file", self.schema.names)
        while groups := merges(self.shards(), self.target, self.fanout):
            folder = f"{self.folder}/data/{uuid.uuid4().hex}"
            gone = [s.path for group in groups for s in group]
            named = [(same_form(self._path(s.path).toUri().toString()), i) for i, group in enumerate(groups) for s in group]
            runs = self.spark.createDataFrame(named, f"{file} string, {run} int")
            found = self.spark.read.schema(self.schema).parquet(*gone)
            rows = found.withColumn(file, F.regexp_replace(found.metadataColumn("_metadata")["file_path"], "^file:/+", "file:/"))
            rows.join(runs, file).drop(file).repartitionById(len(groups), F.col(run)).write.partitionBy(run).parquet(folder)
            new = self._written(folder)
            before, after = self._rows(gone), self._rows([s.path for s in new])
            if before != after:
                self._fs.delete(self._path(folder), True)
                raise RuntimeError(f"merging would keep {after} of {before} rows")
            if self._swap(set(gone), new) is None:
                self._fs.delete(self._path(folder), True)
        return (self.versions() or [0])[-1]

    def sweep(self, older_than: float = ORPHAN_AGE) -> int:
        """Delete data files that no version names and that were written over `older_than` seconds ago, as failed writers leave; return how many."""
        live = {same_form(s.path) for v in self.versions() for s in self.shards(v)}
        data = self._path(f"{self.folder}/data")
        if not self._fs.exists(data):
            return 0
        gone, files, edge = [], self._fs.listFiles(data, True), (time.time() - older_than) * 1000
        while files.hasNext():
            status = files.next()
            if same_form(status.getPath().toString()) not in live and status.getModificationTime() < edge:
                gone.append(status.getPath())
        for path in gone:
            self._fs.delete(path, False)
        return len(gone)

    def vacuum(self, keep: int = 1, older_than: float = ORPHAN_AGE) -> int:
        """Delete the manifests before the newest `keep` that were followed by another over `older_than` seconds ago, and the shards that no
        version left names; return how many shards went. Readers and merges that began on a younger version keep their files."""
        known, edge = self.versions(), (time.time() - older_than) * 1000
        since = lambda v: self._fs.getFileStatus(self._path(self._manifest(v))).getModificationTime()
        old = [v for v, after in zip(known, known[1:], strict=False) if v in known[:-keep] and since(after) <= edge]
        live = {s.path for v in known if v not in old for s in self.shards(v)}
        gone = {s.path for v in old for s in self.shards(v)} - live
        for path in gone:
            self._fs.delete(self._path(path), False)
        for v in old:
            self._fs.delete(self._path(self._manifest(v)), False)
        return len(gone)

    def read(self, version: int | None = None, shard: str = "shard") -> DataFrame:
        """The rows of a version, the newest by default, and the name of the file that holds each.

        That column is named `shard`; if the rows have such a column, theirs stays and this one gets underscores behind its name.
        """
        shard = free_name(shard, self.schema.names)
        paths = [s.path for s in self.shards(version)]
        if not paths:
            return self.spark.createDataFrame([], self.schema).withColumn(shard, F.lit(""))
        rows = self.spark.read.schema(self.schema).parquet(*paths)
        return rows.withColumn(shard, F.element_at(F.split(rows.metadataColumn("_metadata")["file_path"], "/"), -1))


def arrive(documents: DataFrame, folder: str | None = None, arrivals: int = 6, target: int = TARGET) -> ShardStore:
    """A store filled by `arrivals` appends (documents dealt by a hash of all their columns), compacted after every third and at the end.

    Rows of any content are kept as they are, nulls and repeats too, and columns of any name; superseded files are deleted once a
    compaction is committed. An empty table gives a store without rows.
    """
    store = ShardStore(documents.sparkSession, folder or common.new_path(documents.sparkSession, "shards"), documents.schema, target)
    for k in range(arrivals):
        store.append(documents.where(F.pmod(F.xxhash64(*documents.columns), F.lit(arrivals)) == k))
        if k % 3 == 2 or k == arrivals - 1:
            store.compact()
            store.vacuum(older_than=0)  # nobody else knows the store yet
    return store
