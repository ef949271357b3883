"""Files, folders and tables as DataFrames of records.

Readers are kept by suffix in one registry. All but the listing of a folder is
done by tasks: what Spark has no reader for is read as binary files, one row
a file, and taken apart in Arrow batches. In a folder, a file that can't be
read is left out (and logged by the task); read alone, it is an error.
"""

from __future__ import annotations

import io
import logging
import re
import zipfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyarrow import feather as arrow_feather
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_schema

from ..errors import MissingDependency, SourceError
from ..functions.markup import docx_to_text, html_to_text
from ..operators.chunks import dense_ids, need_column

FILE_NAME, RAW_TEXT, RECORD_ID = "file_name", "raw_text", "record_id"
log = logging.getLogger(__name__)
Read = Callable[[SparkSession, str, bool], DataFrame]


@dataclass(frozen=True)
class Loader:
    """A reader (spark, path, is the path a folder) and whether its tables need a target column to be named."""

    read: Read
    needs_target: bool = False


def _glob(suffix: str) -> str:
    """Pattern of names with the suffix, whatever the case."""
    return "*" + "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in suffix)


def _reader(spark: SparkSession, path: str, folder: bool, suffix: str):  # noqa: ANN202
    r = spark.read
    return r.option("recursiveFileLookup", True).option("pathGlobFilter", _glob(suffix)) if folder else r


def _suffix_of(path: str) -> str:
    name = path.rstrip("/").rsplit("/", 1)[-1]
    return "." + name.rsplit(".", 1)[1].lower() if "." in name else ""


def suffixes(spark: SparkSession, path: str) -> tuple[set[str], bool]:
    """(suffixes of the files, is the path a folder of files). Hidden files and those that systems leave behind don't count; a folder named as a table is a table."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(p):
        raise SourceError(f"{path} doesn't exist", path=path)
    if fs.getFileStatus(p).isFile() or _suffix_of(path) in LOADERS:
        return {_suffix_of(path)}, False
    found, files = set(), fs.listFiles(p, True)
    while files.hasNext():
        name = files.next().getPath().getName()
        if not name.startswith((".", "_")):
            found.add(_suffix_of(name))
    return found, True


# texts


def _whole(suffix: str) -> Read:
    def read(spark: SparkSession, path: str, folder: bool) -> DataFrame:
        rows = _reader(spark, path, folder, suffix).text(path, wholetext=True)
        return rows.select(F.col("_metadata.file_name").alias(FILE_NAME), F.col("value").alias(RAW_TEXT))

    return read


def _converted(suffix: str, convert: Callable[[bytes], str]) -> Read:
    """Whole files through a function bytes -> text, in tasks."""

    def read(spark: SparkSession, path: str, folder: bool) -> DataFrame:
        @F.pandas_udf(T.StringType())
        def text(content: pd.Series) -> pd.Series:
            def one(raw: bytes) -> str | None:
                try:
                    return convert(raw)
                except MissingDependency:
                    raise
                except Exception:
                    if not folder:
                        raise
                    log.exception("a file was left out")
                    return None

            return content.map(one)

        rows = _reader(spark, path, folder, suffix).format("binaryFile").load(path)
        return rows.select(F.col("_metadata.file_name").alias(FILE_NAME), text("content").alias(RAW_TEXT)).where(F.col(RAW_TEXT).isNotNull())

    return read


def _no_pdf(raw: bytes) -> str:
    raise MissingDependency("reading .pdf needs a converter: register_converter('.pdf', function from bytes to text)")


# tables


def _csv(spark: SparkSession, path: str, folder: bool) -> DataFrame:
    """With a header row; quotes may hold line ends. Nothing is null, "" an empty text. Files of a folder may have different columns: those with one header are read together."""
    # Spark takes what equals nullValue for null, which is "" if not told otherwise
    how = {"header": True, "inferSchema": True, "multiLine": True, "escape": '"', "nullValue": "\x00null\x00"}
    if not folder:
        return spark.read.csv(path, **how)
    lines = _reader(spark, path, folder, ".csv").text(path)
    heads = (
        lines.select(F.col("_metadata.file_path").alias("path"), F.struct(F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("i"), "value").alias("x"))
        .groupBy("path")
        .agg(F.min("x")["value"].alias("head"))
        .groupBy("head")
        .agg(F.collect_list("path").alias("paths"))
        .orderBy("head")
    )
    tables = [spark.read.csv(sorted(h["paths"]), **how) for h in heads.collect()]  # one row for each distinct header
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def _parquet(spark: SparkSession, path: str, folder: bool) -> DataFrame:
    return _reader(spark, path, folder, ".parquet").option("mergeSchema", folder).parquet(path)


def _feather(spark: SparkSession, path: str, folder: bool) -> DataFrame:
    files = _reader(spark, path, folder, ".feather").format("binaryFile").load(path).select("content")

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        for batch in batches:
            for raw in batch.column(0):
                try:
                    yield arrow_feather.read_table(pa.BufferReader(raw.as_buffer()))
                except Exception:
                    if not folder:
                        raise
                    log.exception("a file was left out")

    def kinds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in tables(batches):
            yield pa.RecordBatch.from_arrays([pa.array([t.schema.remove_metadata().serialize().to_pybytes()], pa.binary())], names=["schema"])

    found = [pa.ipc.read_schema(pa.py_buffer(bytes(r[0]))) for r in files.mapInArrow(kinds, "schema binary").distinct().orderBy("schema").collect()]
    if not found:
        raise SourceError(f"no file of {path} can be read", path=path)
    schema = pa.unify_schemas(found, promote_options="permissive")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in tables(batches):
            columns = [t.column(f.name).cast(f.type) if f.name in t.column_names else pa.nulls(t.num_rows, f.type) for f in schema]
            yield from pa.Table.from_arrays(columns, schema=schema).to_batches(max_chunksize=10_000)

    return files.mapInArrow(rows, from_arrow_schema(schema))


_SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def sheet_rows(raw: bytes) -> list[dict[str, str]]:
    """Rows of the first sheet of a workbook, by the names in its first row; empty cells are left out. Dates are the numbers they are stored as."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        part = lambda n: ElementTree.fromstring(z.read(n))
        text = lambda e: "".join(t.text or "" for t in e.iter(_SHEET + "t"))
        shared = [text(e) for e in part("xl/sharedStrings.xml").findall(_SHEET + "si")] if "xl/sharedStrings.xml" in z.namelist() else []
        first = part("xl/workbook.xml").find(f"{_SHEET}sheets/{_SHEET}sheet").get(_REL)
        target = next(r.get("Target") for r in part("xl/_rels/workbook.xml.rels") if r.get("Id") == first)
        sheet = part(target.lstrip("/") if target.startswith("/") else "xl/" + target)
    grid = []
    for row in sheet.iter(_SHEET + "row"):
        cells: dict[int, str] = {}
        for n, c in enumerate(row.findall(_SHEET + "c")):
            at = n
            if m := re.match(r"[A-Z]+", c.get("r", "")):
                at = reduce(lambda a, ch: a * 26 + ord(ch) - 64, m.group(), 0) - 1
            kind, v = c.get("t", "n"), c.find(_SHEET + "v")
            value = text(c) if kind == "inlineStr" else None if v is None else v.text
            if value is not None:
                cells[at] = shared[int(value)] if kind == "s" else {"1": "true", "0": "false"}[value] if kind == "b" else value
        grid.append(cells)
    if not grid:
        return []
    names = grid[0]
    return [{names[i]: v for i, v in cells.items() if i in names} for cells in grid[1:]]


def _excel(spark: SparkSession, path: str, folder: bool) -> DataFrame:
    files = _reader(spark, path, folder, ".xlsx").format("binaryFile").load(path).select("content")
    kind = pa.map_(pa.string(), pa.string())

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                try:
                    found = sheet_rows(raw)
                except Exception:
                    if not folder:
                        raise
                    log.exception("a file was left out")
                    continue
                yield pa.RecordBatch.from_arrays([pa.array([list(r.items()) for r in found], kind)], names=["cells"])

    cells = files.mapInArrow(rows, "cells map<string,string>")
    names = cells.select(F.posexplode(F.map_keys("cells")).alias("at", "name")).groupBy("name").agg(F.min("at").alias("at"), F.count("*").alias("n")).orderBy("at", F.desc("n"), "name").collect()
    if not names:
        raise SourceError(f"no row in {path}", path=path)
    value = lambda n: F.try_element_at("cells", F.lit(n))
    fits = lambda n, t: F.coalesce(F.bool_and(value(n).try_cast(t).isNotNull() | value(n).isNull()), F.lit(True))
    order = ("bigint", "double", "boolean")
    told = cells.agg(*[fits(r["name"], t).alias(f"{i}_{t}") for i, r in enumerate(names) for t in order]).first()
    types = [next((t for t in order if told[f"{i}_{t}"]), "string") for i in range(len(names))]
    return cells.select(*[value(r["name"]).try_cast(t).alias(r["name"]) for r, t in zip(names, types, strict=True)])


LOADERS: dict[str, Loader] = {
    ".txt": Loader(_whole(".txt")),
    ".md": Loader(_whole(".md")),
    ".html": Loader(_converted(".html", lambda raw: html_to_text(raw.decode("utf-8", "replace")))),
    ".htm": Loader(_converted(".htm", lambda raw: html_to_text(raw.decode("utf-8", "replace")))),
    ".docx": Loader(_converted(".docx", docx_to_text)),
    ".pdf": Loader(_converted(".pdf", _no_pdf)),
    ".csv": Loader(_csv, needs_target=True),
    ".parquet": Loader(_parquet, needs_target=True),
    ".feather": Loader(_feather, needs_target=True),
    ".xlsx": Loader(_excel, needs_target=True),
}


def register(suffix: str, read: Read, needs_target: bool = False) -> None:
    """Adds or replaces the reader of a suffix."""
    LOADERS[suffix.lower()] = Loader(read, needs_target)


def register_converter(suffix: str, convert: Callable[[bytes], str]) -> None:
    """A function from a file's bytes to its text as the reader of a suffix."""
    register(suffix, _converted(suffix.lower(), convert))


def supported() -> list[str]:
    return sorted(LOADERS)


def needs_target(suffix: str) -> bool:
    return loader(suffix).needs_target


def loader(suffix: str) -> Loader:
    got = LOADERS.get(suffix.lower())
    if got is None:
        raise SourceError(f"no reader for {suffix!r}; there are {', '.join(supported())}", suffix=suffix)
    return got


def with_record_ids(df: DataFrame, name: str = RECORD_ID) -> DataFrame:
    """df with ids 0, 1, 2 ... in the order in which its partitions hold the rows: by partition and place, with one offset a partition, no global sort."""
    if name in df.columns:
        return df
    # the upper bits of the running number are the partition, so a block is a partition
    return dense_ids(df.withColumn("_place", F.monotonically_increasing_id()), name, "_place", block=1 << 33).drop("_place")


def load(spark: SparkSession, source: DataFrame | str, target: str | None = None) -> DataFrame:
    """Records with record_id, from a DataFrame, a file or a folder of files of one kind; tables have to have the target column."""
    if isinstance(source, DataFrame):
        need_column(source, target)
        return with_record_ids(source)
    found, folder = suffixes(spark, source)
    if not found:
        raise SourceError(f"no file in {source}", path=source)
    if len(found) > 1:
        raise SourceError(f"files of several kinds in {source}: {', '.join(sorted(found))}", path=source, suffixes=sorted(found))
    one = loader(found.pop())
    rows = one.read(spark, source, folder)
    if one.needs_target:
        need_column(rows, target)
    elif target and target != RAW_TEXT:
        rows = rows.withColumnRenamed(RAW_TEXT, target)
    if FILE_NAME in rows.columns and not one.needs_target:
        rows = rows.repartitionByRange(FILE_NAME).sortWithinPartitions(FILE_NAME) if folder else rows
    return with_record_ids(rows)
