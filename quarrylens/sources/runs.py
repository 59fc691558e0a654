"""Runs of several relations saved together or not at all.

A run's relations are written to a folder of their own under `staged`. The run exists from the moment that its manifest
is renamed into `runs`: one rename of one small file, which the store makes whole or not at all. Readers go by manifests
only, so what a killed job or a roll-back leaves behind is never seen; `sweep` deletes it.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylens.sources.sinks import cut_to_width


class Overflow(Exception):
    pass


@dataclass(frozen=True)
class Run:
    run_id: str
    folder: str
    relations: dict[str, int]


class RunStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def save(self, run_id: str, relations: dict[str, DataFrame], widths: dict[str, dict[str, int]] | None = None, most_rows: int | None = None) -> Run:
        """Writes all relations, texts cut to the widths of their columns, and makes the run visible; on any failure, a relation of
        more than most_rows rows or an id that is taken, nothing of it stays."""
        if not run_id or "/" in run_id or run_id.startswith((".", "_")):
            raise ValueError("a run id is a file name")
        folder = f"{self.root}/staged/{uuid.uuid4().hex}"
        try:
            sizes = {}
            for name, df in relations.items():
                cut_to_width(df, (widths or {}).get(name, {})).write.parquet(f"{folder}/{name}")
                sizes[name] = self.spark.read.parquet(f"{folder}/{name}").count()  # from footers
                if most_rows is not None and sizes[name] > most_rows:
                    raise Overflow(f"{name} has {sizes[name]} rows")
            self._publish(run_id, {"folder": folder, "relations": sizes})
        except BaseException:
            self._fs.delete(self._path(folder), True)
            raise
        return Run(run_id, folder, sizes)

    def _publish(self, run_id: str, manifest: dict) -> None:
        draft, final = self._path(f"{manifest['folder']}/manifest.json"), self._path(f"{self.root}/runs/{run_id}.json")
        if self._fs.exists(final):
            raise FileExistsError(run_id)
        out = self._fs.create(draft, False)
        try:
            out.write(bytearray(json.dumps(manifest).encode()))
        finally:
            out.close()
        self._fs.mkdirs(final.getParent())
        if not self._fs.rename(draft, final):
            raise FileExistsError(run_id)

    def runs(self) -> list[Run]:
        """All runs that are whole, by id."""
        if not self._fs.exists(self._path(f"{self.root}/runs")):
            return []
        texts = self.spark.read.text(f"{self.root}/runs/*.json", wholetext=True).select(F.col("_metadata.file_name").alias("name"), "value")
        found = [(r.name.removesuffix(".json"), json.loads(r.value)) for r in texts.collect()]  # a row for each run
        return sorted((Run(i, m["folder"], m["relations"]) for i, m in found), key=lambda r: r.run_id)

    def read(self, run_id: str, relation: str) -> DataFrame:
        run = next((r for r in self.runs() if r.run_id == run_id), None)
        if run is None or relation not in run.relations:
            raise KeyError(f"{run_id}/{relation}")
        return self.spark.read.parquet(f"{run.folder}/{relation}")

    def remove(self, run_id: str) -> None:
        """The run is gone as soon as its manifest is; its folder follows."""
        run = next(r for r in self.runs() if r.run_id == run_id)
        self._fs.delete(self._path(f"{self.root}/runs/{run_id}.json"), False)
        self._fs.delete(self._path(run.folder), True)

    def sweep(self, older_than: float = 86400.0) -> int:
        """Deletes staged folders that no run names and that were last changed more than so many seconds ago; returns how many."""
        staged = self._path(f"{self.root}/staged")
        if not self._fs.exists(staged):
            return 0
        named, n = {r.folder.rsplit("/", 1)[-1] for r in self.runs()}, 0
        for status in self._fs.listStatus(staged):
            if status.getPath().getName() not in named and status.getModificationTime() / 1000 < time.time() - older_than:
                n += bool(self._fs.delete(status.getPath(), True))
        return n
