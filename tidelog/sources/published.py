"""Tables whose new state appears all at once.

Data goes to folders that no reader knows yet; one small pointer file, replaced last by a rename, names the folders that make up each table.
A job that dies before the rename leaves the old state whole, and its folders are unknown to readers. Several tables can change in one step.
A partition that does not change keeps its folder, so a new version costs only what it replaces. The pointer holds one line per partition.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

POINTER = "_current.json"


class Published:
    """Named tables below ``root``. One writer at a time."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark._jvm
        self._path = self._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def state(self) -> dict[str, dict[str, str]]:
        """table -> partition ('' for a table without) -> folder below the root."""
        at = self._path(f"{self.root}/{POINTER}")
        if not self._fs.exists(at):
            return {}
        stream = self._fs.open(at)
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))["tables"]
        finally:
            stream.close()

    def read(self, table: str) -> DataFrame | None:
        """The table as last committed, or None; the partition column comes from the folders."""
        folders = sorted(self.state().get(table, {}).values())
        if not folders:
            return None
        return self.spark.read.option("basePath", f"{self.root}/{table}").parquet(*[f"{self.root}/{f}" for f in folders]).drop("_version")

    def stage(self, df: DataFrame, table: str, by: str | None = None) -> dict[str, str]:
        """Write df where nobody reads it yet; returns its folders by partition, to be committed."""
        version = uuid.uuid4().hex[:12]
        if by is None:
            folder = f"{table}/_version={version}"
            df.write.parquet(f"{self.root}/{folder}")
            return {"": folder}
        home = f"{table}/_staged={version}"
        df.write.partitionBy(by).parquet(f"{self.root}/{home}")
        out = {}
        for status in self._fs.listStatus(self._path(f"{self.root}/{home}")):
            name = status.getPath().getName()
            if "=" in name:
                out[name] = f"{table}/{name}/_version={version}"
                target = self._path(f"{self.root}/{out[name]}")
                self._fs.mkdirs(target.getParent())
                self._fs.rename(status.getPath(), target)
        self._fs.delete(self._path(f"{self.root}/{home}"), True)
        return out

    def commit(self, changes: dict[str, dict[str, str | None]]) -> None:
        """Make staged folders current, all tables at once; a partition with None leaves its table. Other partitions stay."""
        tables = self.state()
        for table, parts in changes.items():
            now = tables.setdefault(table, {})
            for part, folder in parts.items():
                if folder is None:
                    now.pop(part, None)
                else:
                    now[part] = folder
        self._swap(json.dumps({"tables": tables}, indent=0, sort_keys=True))

    def _swap(self, text: str) -> None:
        """Write the pointer beside the old one and rename it over it, one atomic step on file systems with an atomic rename."""
        fs = self._jvm.org.apache.hadoop.fs
        fresh = self._path(f"{self.root}/_next-{uuid.uuid4().hex[:12]}.json")
        stream = self._fs.create(fresh, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        context = fs.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(fs.Options.Rename, 1)
        options[0] = fs.Options.Rename.OVERWRITE
        context.rename(fresh, self._path(f"{self.root}/{POINTER}"), options)

    def replace(self, df: DataFrame, table: str, by: str | None = None) -> None:
        """Replace the partitions present in df (or the whole table) in one step."""
        self.commit({table: self.stage(df, table, by)})

    def vacuum(self, older_than_ms: int = 86_400_000) -> int:
        """Delete folders that the pointer does not name and that were last changed before the given age; returns how many."""
        now = self._jvm.java.lang.System.currentTimeMillis()
        named = {f for parts in self.state().values() for f in parts.values()}
        gone, todo = 0, [self._path(self.root)]
        while todo:
            for status in self._fs.listStatus(todo.pop()):
                path = status.getPath()
                if not status.isDirectory():
                    continue
                where = path.toString().split(f"{self.root.split(':')[-1]}/", 1)[-1]
                if path.getName().startswith(("_version=", "_staged=")):
                    if where not in named and now - status.getModificationTime() > older_than_ms:
                        self._fs.delete(path, True)
                        gone += 1
                else:
                    todo.append(path)
        return gone
