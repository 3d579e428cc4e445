"""A lake of versioned tables with all-or-nothing commits over several tables.

A commit writes new directories for what it changes and then puts one manifest in place, by a creation that only
one writer can win. Readers look the manifest up once and see one version of everything. The tables in KEYED are
cut into buckets by a hash of their address; a merge reads and rewrites the buckets of the addresses it touches and
no others, and a read by address opens one bucket. All files are reached through the Hadoop file system of the root.
"""

from __future__ import annotations

import json
import os
import re
import time
import uuid
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.schema import TABLES

#: The column whose address a row belongs to, of tables that are cut into buckets.
KEYED = {"document": "document_url", "section": "document_url", "chunk": "document_url", "links_to": "src_url", "mentions": "document_url", "crawl_url": "url", "embedding": "chunk_id"}
BUCKETS = 64
NUMBERED = re.compile(r"^(.*)-(\d+)$")


class Conflict(Exception):
    """Another writer committed first."""


def bucket(source: Column, key: Column) -> Column:
    return F.pmod(F.xxhash64(source, key), F.lit(BUCKETS)).cast("int")


class Lake:
    """Tables below root, a folder that the driver and all executors reach by the same address."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        #: Where the root is on this machine; creation is then left to the operating system, which makes it atomic.
        self._local = self._fs.makeQualified(self._path("")).toUri().getPath() if self._fs.getScheme() == "file" else None
        self._fs.mkdirs(self._path("manifests"))

    def _path(self, below: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{below}" if below else self.root)

    def version(self) -> int:
        found = [s.getPath().getName() for s in self._fs.listStatus(self._path("manifests"))]
        return max((int(n.split(".")[0]) for n in found if re.fullmatch(r"\d+\.json", n)), default=0)

    def manifest(self, version: int | None = None) -> dict:
        v = self.version() if version is None else version
        if v == 0:
            return {"version": 0, "tables": {}, "batches": {}}
        stream = self._fs.open(self._path(f"manifests/{v:012d}.json"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def read(self, name: str, manifest: dict | None = None, source_id: str | None = None, key: str | None = None, buckets: list[int] | None = None) -> DataFrame:
        """The table at one version; an empty one of its schema if nothing was written yet. Of a keyed table, only the
        bucket of one address, or only some buckets."""
        if key is not None and name in KEYED:
            row = self.spark.range(1).select(bucket(F.lit(source_id), F.lit(key))).first()
            buckets = [row[0]]
        held = (manifest or self.manifest())["tables"].get(name, {})
        paths = [p for b, found in sorted(held.items()) if buckets is None or b == "*" or int(b) in buckets for p in found]
        if paths:
            return self.spark.read.schema(TABLES[name]).parquet(*[f"{self.root}/{p}" for p in paths])
        return self.spark.createDataFrame([], TABLES[name])

    def _write(self, name: str, df: DataFrame) -> dict[str, list[str]]:
        """The directories that rows were written to, by bucket ('*' for a table without)."""
        path = f"data/{name}/{uuid.uuid4().hex}"
        rows = _conform(df, name)
        if name not in KEYED:
            rows.write.parquet(f"{self.root}/{path}")
            return {"*": [path]}
        rows = rows.withColumn("bucket", bucket(F.col("source_id"), F.col(KEYED[name])))
        rows.repartition("bucket").write.partitionBy("bucket").parquet(f"{self.root}/{path}")
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(path)) if s.isDirectory()]
        return {n.split("=")[1]: [f"{path}/{n}"] for n in names if n.startswith("bucket=")}

    def commit(
        self, replace: dict[str, DataFrame] | None = None, append: dict[str, DataFrame] | None = None,
        merge: dict[str, tuple[DataFrame, DataFrame, list[str]]] | None = None, base: dict | None = None, batch: str | None = None,
    ) -> int:
        """Write tables whole, add rows to them, or merge: (fresh rows, rows whose keys are touched, keys) puts the fresh
        rows in place of all rows with a touched key, in the buckets of these alone.

        A batch that was committed before changes nothing. Raises Conflict if the lake has moved on from base.
        """
        base = base or self.manifest()
        stream, number = NUMBERED.match(batch).groups() if batch and NUMBERED.match(batch) else (batch, "0")
        if batch is not None and base["batches"].get(stream, -1) >= int(number):
            return base["version"]
        tables = {n: dict(b) for n, b in base["tables"].items()}
        for name, df in (replace or {}).items():
            tables[name] = self._write(name, df)
        for name, df in (append or {}).items():
            held = tables.setdefault(name, {})
            for b, paths in self._write(name, df).items():
                held[b] = [*held.get(b, []), *paths]
        for name, (fresh, touched, keys) in (merge or {}).items():
            held = tables.setdefault(name, {})
            key = KEYED[name]
            known = touched.select(*keys).distinct()
            if "source_id" in keys and key in keys:
                # At most BUCKETS rows.
                hit = [r[0] for r in known.select(bucket(F.col("source_id"), F.col(key)).alias("b")).distinct().collect()]
            else:
                hit = list(range(BUCKETS))
            kept = self.read(name, base, buckets=hit).join(known, keys, "left_anti")
            written = self._write(name, kept.unionByName(_conform(fresh, name)))
            for b in map(str, hit):
                held.pop(b, None)
            held.update({b: [*held.get(b, []), *paths] for b, paths in written.items()})
        version = base["version"] + 1
        batches = dict(base["batches"]) | ({stream: int(number)} if batch else {})
        self._publish(f"manifests/{version:012d}.json", json.dumps({"version": version, "tables": tables, "batches": batches, "at": time.time()}))
        return version

    def _publish(self, name: str, body: str) -> None:
        """Put a file in place whole, unless one is there."""
        draft = f"manifests/draft-{uuid.uuid4().hex}"
        out = self._fs.create(self._path(draft))
        out.write(body.encode())
        out.close()
        try:
            if self._local is not None:
                os.link(f"{self._local}/{draft}", f"{self._local}/{name}")
            elif self._fs.exists(self._path(name)) or not self._fs.rename(self._path(draft), self._path(name)):
                raise FileExistsError
        except FileExistsError:
            raise Conflict(f"{name} was written by another") from None
        finally:
            self._fs.delete(self._path(draft), False)

    def transact(self, change: Callable[[dict], dict], attempts: int = 5) -> int:
        """Commit what change(manifest) returns as arguments, again from the new state after a conflict."""
        for n in range(attempts):
            base = self.manifest()
            try:
                return self.commit(**change(base), base=base)
            except Conflict:
                if n + 1 == attempts:
                    raise
                time.sleep(0.025 * 2**n)
        raise AssertionError

    @contextmanager
    def exclusive(self):
        """One process at a time."""
        if self._local is not None:
            try:
                os.close(os.open(f"{self._local}/lock", os.O_CREAT | os.O_EXCL))
            except FileExistsError:
                raise Conflict("the lake is in use") from None
        elif not self._fs.createNewFile(self._path("lock")):
            raise Conflict("the lake is in use")
        try:
            yield self
        finally:
            self._fs.delete(self._path("lock"), False)


def _conform(df: DataFrame, name: str) -> DataFrame:
    """df with exactly the table's columns; those it lacks are null."""
    from pyspark.sql.types import _parse_datatype_string

    fields = _parse_datatype_string(TABLES[name]).fields
    have = {c.lower() for c in df.columns}
    return df.select(*[(F.col(f.name) if f.name.lower() in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields])


def unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """df, whose reading fails if two rows share their keys."""
    twice = df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").limit(1).count()
    if twice:
        raise ValueError(f"rows share {', '.join(keys)}")
    return df
