"""Where a run keeps its chunks, batches, results and state.

A Store is a folder that all executors share, of Parquet tables and two JSON
files; a MemoryStore is one that goes with its driver. What is saved at once is
one folder, whatever the number of its batches, named by its number and the
range of its batches: of a batch that was saved again the last one counts, and
what has to be looked at for that is read off folder names.
"""

from __future__ import annotations

import atexit
import json
import re
import uuid
from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import StoreError


def shared_folder(spark: SparkSession, what: str) -> str:
    """A new folder name in the place that the cluster names for shared files; below the warehouse where a session of one machine names none."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise StoreError("spark.checkpoint.dir isn't set: a cluster needs a folder that all executors share")
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
    return f"{base.rstrip('/')}/loomwork-{what}-{uuid.uuid4().hex}"


def differences(a: Any, b: Any, path: str = "") -> list[str]:
    """Dotted paths at which two configurations differ."""
    if isinstance(a, Mapping) and isinstance(b, Mapping):
        return [d for k in sorted({*a, *b}, key=str) for d in differences(a.get(k), b.get(k), f"{path}.{k}" if path else str(k))]
    return [] if a == b else [path]


class Store:
    """A run in a folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _at(self, *parts: str):  # noqa: ANN202
        p = self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.path, *parts)))
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _exists(self, *parts: str) -> bool:
        p, fs = self._at(*parts)
        return fs.exists(p)

    def _delete(self, *parts: str) -> bool:
        p, fs = self._at(*parts)
        return fs.delete(p, True)

    def _write_json(self, name: str, value: Any) -> None:
        p, fs = self._at(name)
        out = fs.create(p, True)
        try:
            out.write(bytearray(json.dumps(value, ensure_ascii=False, sort_keys=True).encode()))
        finally:
            out.close()

    def _read_json(self, name: str) -> Any:
        return json.loads(self.spark.read.text(f"{self.path}/{name}", wholetext=True).first()[0]) if self._exists(name) else None

    # the run

    def initialise(self, config: Mapping[str, Any], spec: Mapping[str, Any], overwrite: bool = False, resume: bool = False) -> None:
        """Makes the folder ready. One that exists is an error, unless it is overwritten, or resumed: then it must not be completed, and config and spec must be what they were."""
        if overwrite and resume:
            raise StoreError("a run is either overwritten or resumed")
        if self._exists():
            if overwrite:
                self._delete()
            elif resume:
                if self.is_completed():
                    raise StoreError(f"{self.path} is completed", path=self.path)
                before = self._read_json("run.json") or {}
                changed = differences(before, {"config": dict(config), "spec": dict(spec)})
                if changed:
                    raise StoreError(f"{self.path} was made with another {', '.join(changed)}", path=self.path, changed=changed)
                return
            else:
                raise StoreError(f"{self.path} exists; overwrite or resume it", path=self.path)
        self._write_json("run.json", {"config": dict(config), "spec": dict(spec)})

    def is_completed(self, name: str = "results") -> bool:
        return self._exists(name, "_SUCCESS")

    # tables

    def _save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.path}/{name}")
        return self._load(name)

    def _load(self, name: str) -> DataFrame:
        if not self._exists(name):
            raise StoreError(f"no {name} in {self.path}", path=self.path, table=name)
        return self.spark.read.parquet(f"{self.path}/{name}")

    def keep(self, df: DataFrame, by: str | None = None) -> DataFrame:
        """df, written once under a name of its own and read back; where `by` names a column, with a folder for each of its values."""
        name = f"kept/{uuid.uuid4().hex}"
        if by is None:
            return self._save(df, name)
        df.repartition(by).write.option("compression", "zstd").partitionBy(by).parquet(f"{self.path}/{name}")
        return self._load(name)

    def save_chunks(self, chunks: DataFrame) -> DataFrame:
        return self._save(chunks, "chunks")

    def load_chunks(self) -> DataFrame:
        return self._load("chunks")

    def save_results(self, results: DataFrame, name: str = "results") -> DataFrame:
        return self._save(results, name)

    def results(self, name: str = "results") -> DataFrame:
        return self._load(name)

    # batches

    def save_batches(self, rows: DataFrame) -> None:
        """Rows with batch_id; each batch that they have is replaced. They are there as a whole or not at all."""
        made, fs = self._at("batches", f"_writing-{uuid.uuid4().hex}")
        rows.write.option("compression", "zstd").parquet(str(made))
        lo, hi = self.spark.read.schema(rows.schema).parquet(str(made)).agg(F.min("batch_id"), F.max("batch_id")).first()
        if lo is None:
            fs.delete(made, True)
            return
        fs.rename(made, self._at("batches", f"save-{self._next()}-{lo}-{hi}")[0])

    def _names(self, what: str) -> list[tuple[int, ...]]:
        """Numbers in the names of the folders of a kind; names of others are passed over."""
        p, fs = self._at("batches")
        found = [re.fullmatch(what + r"-(\d+)-(-?\d+)(?:-(-?\d+))?", s.getPath().getName()) for s in fs.listStatus(p)] if fs.exists(p) else []
        return sorted(tuple(int(g) for g in m.groups() if g is not None) for m in found if m)

    def _next(self) -> int:
        return 1 + max((n for n, *_ in [*self._names("save"), *self._names("gone")]), default=0)

    def has_batches(self) -> bool:
        saves = self._names("save")
        return bool(saves) and (not self._names("gone") or not self._rows(saves).isEmpty())

    def batch_ids(self) -> list[int]:
        """Ids of the batches there are, in order."""
        saves = self._names("save")
        return sorted(r[0] for r in self._rows(saves).select("batch_id").distinct().collect()) if saves else []

    def batches(self) -> DataFrame:
        """All batches as one table."""
        if not self.has_batches():
            raise StoreError(f"no batch in {self.path}", path=self.path)
        return self._rows(self._names("save"))

    def _rows(self, saves: list[tuple[int, ...]]) -> DataFrame:
        rows = self.spark.read.parquet(*[f"{self.path}/batches/save-{n}-{lo}-{hi}" for n, lo, hi in saves]).withColumn("batch_id", F.col("batch_id").cast("bigint"))
        gone, spans = self._names("gone"), sorted((lo, hi) for _, lo, hi in saves)
        if not gone and all(a[1] < b[0] for a, b in zip(spans, spans[1:], strict=False)):
            return rows
        columns = rows.columns
        rows = rows.withColumn("_save", F.regexp_extract(F.col("_metadata.file_path"), r"/save-(\d+)-[^/]*/[^/]*$", 1).cast("bigint"))
        rows = rows.join(rows.groupBy("batch_id").agg(F.max("_save").alias("_save")), ["batch_id", "_save"], "left_semi")
        if gone:  # as many as were deleted one by one
            deleted = self.spark.createDataFrame(gone, "_gone bigint, batch_id bigint").groupBy("batch_id").agg(F.max("_gone").alias("_gone"))
            rows = rows.join(F.broadcast(deleted), "batch_id", "left").where(F.col("_gone").isNull() | (F.col("_save") > F.col("_gone")))
        return rows.select(columns)

    def load_batch(self, batch_id: int) -> DataFrame:
        if not self._has(batch_id):
            raise StoreError(f"no batch {batch_id} in {self.path}", path=self.path, batch_id=batch_id)
        return self.batches().where(F.col("batch_id") == batch_id)

    def _has(self, batch_id: int) -> bool:
        saves = [s for s in self._names("save") if s[1] <= batch_id <= s[2]]
        return bool(saves) and not self._rows(saves).where(F.col("batch_id") == batch_id).isEmpty()

    def delete_batch(self, batch_id: int) -> bool:
        if not self._has(batch_id):
            return False
        p, fs = self._at("batches", f"gone-{self._next()}-{batch_id}")
        return fs.mkdirs(p)

    def cleanup(self) -> bool:
        """Deletes the batches; the state stays."""
        self._delete("kept")
        return self._delete("batches")

    # state

    def save_state(self, state: Mapping[str, Any]) -> None:
        self._write_json("state.json", dict(state))

    def state(self) -> dict[str, Any] | None:
        return self._read_json("state.json")


class MemoryStore(Store):
    """A run that leaves nothing behind: a Store in a folder of its own below the shared one, which goes when the driver ends. It can be neither overwritten nor resumed.

    Tables aren't held by executors alone, since what was asked and paid for would be asked again for those that are lost.
    """

    def __init__(self, spark: SparkSession):
        super().__init__(spark, shared_folder(spark, "memory"))
        atexit.register(self.close)

    def initialise(self, config: Mapping[str, Any], spec: Mapping[str, Any], overwrite: bool = False, resume: bool = False) -> None:
        if overwrite or resume:
            raise StoreError("a run in memory can be neither overwritten nor resumed")
        super().initialise(config, spec)

    def close(self) -> None:
        """Deletes the folder, if the session is still there."""
        try:
            self._delete()
        except Exception:  # noqa: BLE001 - it has ended
            return
