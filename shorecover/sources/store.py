"""A folder of results that batches are upserted into, safe to replay and to restart."""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEY = "image_name"


@dataclass(frozen=True)
class Commit:
    """A record of one saved batch. whole: its folder holds all that came before as well."""

    version: int
    stream: str
    batch: int
    folder: str
    whole: bool = False


class ResultStore:
    """Rows of one image_name each; of rows of one name that of the newest version counts.

    A batch is written to a folder of its own and counts once its commit record is there; the
    record takes its name by a rename, so it is whole or absent. A batch that has a record is not
    saved again, and the folder of an attempt without one is never read. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _at(self, *parts: str):
        """(file system, path) below the folder of the store."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.path, *parts)))
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _put(self, value: dict, *parts: str) -> bool:
        """Writes a small JSON file unless it is there; whether it did."""
        files, draft = self._at("drafts", uuid.uuid4().hex)
        out = files.create(draft, True)
        out.write(bytearray(json.dumps(value).encode()))
        out.close()
        _, path = self._at(*parts)
        files.mkdirs(path.getParent())
        if not files.exists(path) and files.rename(draft, path):
            return True
        files.delete(draft, False)
        return False

    def commits(self) -> list[Commit]:
        """What counts, oldest first: the last record of all rows and those after it. compact() keeps them few."""
        files, path = self._at("commits")
        if not files.exists(path):
            return []
        schema = "version long, stream string, batch long, folder string, whole boolean"
        rows = self.spark.read.schema(schema).json(f"{self.path}/commits").where("folder is not null").collect()
        found = sorted((Commit(**r.asDict()) for r in rows), key=lambda c: c.version)
        last = max((k for k, c in enumerate(found) if c.whole), default=0)
        return found[last:]

    def has(self, stream: str, batch: int) -> bool:
        """Whether the batch is saved, as itself or within all rows."""
        files, path = self._at("batches", f"{stream}-{batch}")
        return files.exists(path)

    def _commit(self, stream: str, batch: int, folder: str, whole: bool = False) -> None:
        version = max([0, *(c.version for c in self.commits())]) + 1
        if not self._put(asdict(Commit(version, stream, batch, folder, whole)), "commits", f"{version:012d}.json"):
            raise RuntimeError(f"another writer saved version {version} of {self.path}")

    def save(self, rows: DataFrame, stream: str, batch: int) -> None:
        """Upserts rows (image_name, error and others; one row a name) as batch `batch` of a stream, once."""
        if self.has(stream, batch) or any((c.stream, c.batch) == (stream, batch) for c in self.commits()):
            return
        folder = f"rows/{stream}-{batch}-{uuid.uuid4().hex}"
        rows = rows.withColumn("error", F.col("error").cast("string"))
        rows.write.parquet(f"{self.path}/{folder}")
        self._commit(stream, batch, folder)
        self._put({}, "batches", f"{stream}-{batch}")

    def read(self) -> DataFrame | None:
        """The newest row of each name with its version, or None while nothing is saved. One shuffle, on the name; versions come from the few commit records."""
        commits = self.commits()
        if not commits:
            return None
        rows = self.spark.read.option("mergeSchema", True).parquet(*[f"{self.path}/{c.folder}" for c in commits])
        versions = F.create_map(*[F.lit(x) for c in commits for x in (c.folder, c.version)])
        folder = F.regexp_extract(F.col("_metadata.file_path"), r"(rows/[^/]+)/[^/]+$", 1)
        own = F.element_at(versions, folder)
        if "version" in rows.columns:  # rows that compact() moved keep theirs
            own = F.coalesce("version", own)
        rows = rows.withColumn("__v", own)
        others = [c for c in rows.columns if c not in (KEY, "version", "__v")]
        newest = rows.groupBy(KEY).agg(F.max_by(F.struct(*others), "__v").alias("r"), F.max("__v").alias("version"))
        return newest.select(KEY, *[F.col(f"r.{c}").alias(c) for c in others], "version")

    def compact(self) -> None:
        """All rows as one folder and record; older records go, and the folders that only they name."""
        old = self.commits()
        if len(old) < 2:
            return
        for c in old:  # records go, so that each batch needs its mark
            self._put({}, "batches", f"{c.stream}-{c.batch}")
        folder = f"rows/all-{uuid.uuid4().hex}"
        self.read().write.parquet(f"{self.path}/{folder}")
        self._commit("all", old[-1].version, folder, True)
        for c in old:
            for parts in (("commits", f"{c.version:012d}.json"), (c.folder,)):
                files, path = self._at(*parts)
                files.delete(path, True)

    def first_run(self, command: str, run_args: dict[str, str]) -> tuple[str, dict[str, str]]:
        """The command and arguments of the first run on this store; those given if it is this one."""
        self._put({"command": command, "run_args": run_args}, "run", "first.json")
        r = self.spark.read.schema("command string, run_args map<string, string>").json(f"{self.path}/run").first()
        return r["command"], r["run_args"]
