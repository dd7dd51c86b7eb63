"""Tables written by batches, of which readers see whole batches only.

A batch stages its tables in folders of its own and is then committed by one rename: of a manifest that names the
folders, to the batch's number. Where a job fails before the rename, what it staged is never read, and the batch runs
again; where it fails after it, the batch is found committed and left alone. Small batches are compacted by rewriting them
into one folder and renaming a manifest that replaces theirs.

    data/<table>/<batch>-<try>/    files of a try
    commits/<batch>.json           manifest of a batch
    commits/upto-<batch>.json      manifest of all batches up to one, after compaction

Paths are those of Spark's file systems. The rename must be atomic there, as on HDFS and local or shared disks.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class CommitLog:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _names(self) -> list[str]:
        fs, p = self._fs(f"{self.path}/commits")
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def _read(self, names: list[str]) -> list[dict]:
        """Manifests by name. They are small: a line each, and compaction bounds their number."""
        out = []
        for n in names:
            fs, p = self._fs(f"{self.path}/commits/{n}")
            stream = fs.open(p)
            try:
                out.append(json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
            finally:
                stream.close()
        return out

    def _publish(self, name: str, manifest: dict) -> bool:
        """Makes a manifest visible whole, or not at all; False if one of that name is there."""
        fs, temporary = self._fs(f"{self.path}/commits-staged/{uuid.uuid4().hex}")
        out = fs.create(temporary)
        try:
            out.write(bytearray(json.dumps(manifest).encode()))
        finally:
            out.close()
        _, target = self._fs(f"{self.path}/commits/{name}")
        fs.mkdirs(target.getParent())
        return not fs.exists(target) and fs.rename(temporary, target)

    def manifests(self) -> list[dict]:
        """The manifests that hold: the last compaction and the batches after it."""
        names = [n for n in self._names() if n.endswith(".json")]
        upto = max((n for n in names if n.startswith("upto-")), default=None)
        last = int(upto[5:-5]) if upto else -1
        return self._read(([upto] if upto else []) + [n for n in names if not n.startswith("upto-") and int(n[:-5]) > last])

    def has(self, batch: int) -> bool:
        return any(m["batch"] == batch if "upto" not in m else m["upto"] >= batch for m in self.manifests())

    def stage(self, batch: int, table: str, df: DataFrame) -> str:
        """Writes a table of a batch; returns its folder, which nothing reads before it is committed."""
        folder = f"data/{table}/{batch:012d}-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{folder}")
        return folder

    def commit(self, batch: int, folders: dict[str, str]) -> bool:
        """Commits staged folders by table; False if the batch has been committed already."""
        return not self.has(batch) and self._publish(f"{batch:012d}.json", {"batch": batch, "tables": {t: [f] for t, f in folders.items()}})

    def write(self, batch: int, tables: dict[str, DataFrame] | Callable[[], dict[str, DataFrame]]) -> bool:
        """Stages and commits all tables of a batch; does nothing where it has been committed."""
        if self.has(batch):
            return False
        tables = tables() if callable(tables) else tables
        return self.commit(batch, {t: self.stage(batch, t, df) for t, df in tables.items()})

    def read(self, table: str, schema, batch: int | None = None) -> DataFrame:
        """A table's rows of committed batches, or of one of those not compacted yet."""
        found = [m for m in self.manifests() if batch is None or m.get("batch") == batch]
        folders = [f"{self.path}/{f}" for m in found for f in m["tables"].get(table, [])]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def compact(self, schemas: dict, files: int = 8, least: int = 2) -> bool:
        """Rewrites the committed batches into one folder a table, where there are so many at least. Readers that hold
        the old manifests still find the old folders; ``clean`` removes those later."""
        held = self.manifests()
        if len(held) < least:
            return False
        last = max(m.get("upto", m.get("batch")) for m in held)
        tables = {t: [self.stage(last, t, self.read(t, s).coalesce(files))] for t, s in schemas.items()}
        return self._publish(f"upto-{last:012d}.json", {"upto": last, "tables": tables})

    def clean(self) -> int:
        """Removes folders that no manifest names, and manifests that a compaction has replaced. Only while no batch is
        being written and no reader holds an old list. Returns the number of folders removed."""
        held = self.manifests()
        used, last, n = {f for m in held for fs in m["tables"].values() for f in fs}, max((m["upto"] for m in held if "upto" in m), default=-1), 0
        for name in self._names():
            if name.endswith(".json") and (int(name[5:-5]) < last if name.startswith("upto-") else int(name[:-5]) <= last):
                fs, p = self._fs(f"{self.path}/commits/{name}")
                fs.delete(p, False)
        fs, data = self._fs(f"{self.path}/data")
        for table in fs.listStatus(data) if fs.exists(data) else []:
            for f in fs.listStatus(table.getPath()):
                if f"data/{table.getPath().getName()}/{f.getPath().getName()}" not in used:
                    fs.delete(f.getPath(), True)
                    n += 1
        return n
