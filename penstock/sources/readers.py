"""Readers and writers in the shapes that utility data comes in.

Whole files (archives, workbooks, statistics files) are one task each: a file is what Spark can deal. What is in them
comes out as plain rows, so that all further work is DataFrame work.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows after which a reader hands on a batch.
ROWS = 10_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and checkpointed in the folder that executors share: ``spark.checkpoint.dir``, or a temporary one in local mode."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(base or tempfile.mkdtemp(prefix="penstock-"))
    return df.checkpoint()


def read_text_csv(spark: SparkSession, path: str, columns: list[str] | None = None, sep: str = ",", multiline: bool = False) -> DataFrame:
    """A CSV as text columns; only ``columns`` are parsed. Cells with line ends need ``multiline``, which takes a file whole."""
    df = spark.read.csv(path, header=True, inferSchema=False, sep=sep, multiLine=multiline, escape='"')
    return df.select(*columns) if columns else df


def read_table_file(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Text columns of a .csv, .tsv or .dta file, by its ending; a column that the file lacks is null."""
    if path.endswith(".dta"):
        df = _from_files(spark, path, _stata(columns), ", ".join(f"`{c}` string" for c in columns))
    else:
        df = read_text_csv(spark, path, sep="\t" if path.endswith((".tsv", ".txt")) else ",")
    return df.select(*[F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns])


def _from_files(spark: SparkSession, path: str, fn, schema: str) -> DataFrame:
    """Rows that ``fn`` makes of each file's bytes, a file at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                yield from fn(name, content.as_py())

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, schema)


def _batches(rows: Iterator[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    for row in rows:
        held.append(row)
        if len(held) >= ROWS:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _stata(columns: list[str]):
    schema = pa.schema([(c, pa.string()) for c in columns])

    def rows(_, content: bytes) -> Iterator[pa.RecordBatch]:
        import io

        import pandas as pd

        for part in pd.read_stata(io.BytesIO(content), chunksize=ROWS):
            made = [pa.array([None if pd.isna(x) else str(x) for x in part[c]], pa.string()) if c in part else pa.nulls(len(part), pa.string()) for c in columns]
            yield pa.RecordBatch.from_arrays(made, schema=schema)

    return rows


def read_zip_csv(spark: SparkSession, path: str, member: str, columns: list[str]) -> DataFrame:
    """Text columns of the CSV in each ZIP whose name fits the pattern ``member``; a column that it lacks is null."""
    schema = pa.schema([(c, pa.string()) for c in columns])

    def rows(_, content: bytes) -> Iterator[pa.RecordBatch]:
        import csv
        import io
        import re
        import zipfile

        with zipfile.ZipFile(io.BytesIO(content)) as archive:
            for name in archive.namelist():
                if re.search(member, name, re.IGNORECASE):
                    with archive.open(name) as f:
                        lines = csv.DictReader(io.TextIOWrapper(f, "utf-8-sig", newline=""))
                        yield from _batches(({c: line.get(c) for c in columns} for line in lines), schema)

    return _from_files(spark, path, rows, ", ".join(f"`{c}` string" for c in columns))


_CELLS = pa.schema([("file", pa.string()), ("sheet", pa.string()), ("row", pa.int32()), ("cells", pa.map_(pa.string(), pa.string()))])


def read_workbook(spark: SparkSession, path: str) -> DataFrame:
    """(file, sheet, row, cells: column letters to text) of the sheets of .xlsx files."""

    def rows(path: str, content: bytes) -> Iterator[pa.RecordBatch]:
        import io
        import zipfile
        from xml.etree import ElementTree as E

        tag = lambda e: e.tag.rpartition("}")[2]
        with zipfile.ZipFile(io.BytesIO(content)) as book:
            names, words = book.namelist(), []
            if "xl/sharedStrings.xml" in names:
                words = ["".join(t.text or "" for t in item.iter() if tag(t) == "t") for item in E.fromstring(book.read("xl/sharedStrings.xml"))]
            links = {r.get("Id"): r.get("Target") for r in E.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
            sheets = [s for s in E.fromstring(book.read("xl/workbook.xml")).iter() if tag(s) == "sheet"]

            def cells() -> Iterator[dict]:
                for sheet in sheets:
                    target = links[next(v for k, v in sheet.attrib.items() if k.endswith("}id"))].lstrip("/")
                    with book.open(target if target.startswith("xl/") else f"xl/{target}") as f:
                        for _, row in E.iterparse(f):
                            if tag(row) != "row":
                                continue
                            made = []
                            for c in row:
                                text = "".join(x.text or "" for x in c.iter() if tag(x) in ("v", "t"))
                                if text:
                                    made.append(("".join(x for x in c.get("r", "") if x.isalpha()), words[int(text)] if c.get("t") == "s" else text))
                            yield {"file": path, "sheet": sheet.get("name"), "row": int(row.get("r")), "cells": made}
                            row.clear()

            yield from _batches(cells(), _CELLS)

    return _from_files(spark, path, rows, "file string, sheet string, row int, cells map<string,string>")


def by_header(cells: DataFrame, columns: list[str], header_row: int = 1) -> DataFrame:
    """Rows below a sheet's header as text columns (file, sheet, row, ...); headers are found by name wherever they stand."""
    wanted = cells.filter(F.col("row") == header_row).select(F.col("file").alias("__f"), F.col("sheet").alias("__s"), F.map_from_entries(F.transform(F.map_entries("cells"), lambda e: F.struct(F.trim(e["value"]).alias("k"), e["key"].alias("v")))).alias("__h"))
    rows = cells.filter(F.col("row") > header_row).join(wanted, (F.col("file") == F.col("__f")) & (F.col("sheet") == F.col("__s")))
    return rows.select("file", "sheet", "row", *[F.try_element_at("cells", F.try_element_at("__h", F.lit(c))).alias(c) for c in columns])


def filled_down(df: DataFrame, label: Column, by: list[str], order: str, name: str = "label") -> DataFrame:
    """``df`` with the last non-null label at or before each row."""
    return df.withColumn(name, F.last(label, ignorenulls=True).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))


def with_context(df: DataFrame, by: list[str], order: str, text: str, before: int, name: str = "context") -> DataFrame:
    """``df`` with the texts of the ``before`` rows before each row and its own, in order."""
    return df.withColumn(name, F.collect_list(text).over(Window.partitionBy(*by).orderBy(order).rowsBetween(-before, 0)))


def read_pages(spark: SparkSession, path: str, records: str, schema: str, key: str | None = None) -> DataFrame:
    """Records of landed JSON pages, a page a file: ``records`` is the field with their array; one record a ``key`` where pages overlap."""
    field, *rest = records.split(".")
    kind = f"array<struct<{schema}>>"
    for name in reversed(rest):
        kind = f"struct<{name}:{kind}>"
    df = spark.read.json(path, schema=f"`{field}` {kind}", multiLine=True).select(F.explode(records).alias("r")).select("r.*")
    return df.dropDuplicates([key]) if key else df


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """A row per feature of collections: properties as map, geometry as text. Lines of single features are read in parallel by read_geojson_lines."""
    return read_pages(spark, path, "features", "properties:map<string,string>,geometry:string")


def read_geojson_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, schema="properties map<string,string>, geometry string")


def read_curves(spark: SparkSession, path: str) -> DataFrame:
    """(file, frequency, curve: map of gallons to bill) of landed JSON objects, one a file."""
    return spark.read.json(path, schema="rate_id string, frequency string, bill_water map<string,string>", multiLine=True)


def read_config(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A small configuration of JSON lines."""
    return spark.read.json(path, schema=schema)


def html_tables(df: DataFrame, key: str, html: str) -> DataFrame:
    """(key, table, row, cells) of the tables in an HTML column; of nested tables each has its own number."""
    kind = df.schema[key].dataType.simpleString()

    def rows(text: str | None) -> list[tuple[int, int, list[str]]]:
        from html.parser import HTMLParser

        class Tables(HTMLParser):
            def __init__(self):
                super().__init__()
                self.count, self.stack, self.out = 0, [], []

            def handle_starttag(self, tag, attrs):
                if tag == "table":
                    self.stack.append([self.count, -1, False])
                    self.count += 1
                elif self.stack and tag == "tr":
                    self.stack[-1][1:] = [self.stack[-1][1] + 1, False]
                    self.out.append((self.stack[-1][0], self.stack[-1][1], []))
                elif self.stack and tag in ("td", "th") and self.out:
                    self.stack[-1][2] = True
                    self.out[-1][2].append("")

            def handle_endtag(self, tag):
                if self.stack and tag == "table":
                    self.stack.pop()
                elif self.stack and tag in ("td", "th", "tr"):
                    self.stack[-1][2] = False

            def handle_data(self, data):
                if self.stack and self.stack[-1][2] and self.out[-1][2]:
                    self.out[-1][2][-1] += data

        found = Tables()
        found.feed(text or "")
        found.close()
        return [(t, r, [" ".join(c.split()) for c in cells]) for t, r, cells in found.out if cells]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [(k, *row) for k in range(batch.num_rows) for row in rows(batch.column(1)[k].as_py())]
            if made:
                owner, tables, numbers, cells = zip(*made)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner)), pa.array(tables, pa.int32()), pa.array(numbers, pa.int32()), pa.array(cells, pa.list_(pa.string()))], names=["key", "table", "row", "cells"])

    return df.select(F.col(key).alias("key"), F.col(html).alias("html")).mapInArrow(run, f"key {kind}, table int, row int, cells array<string>").withColumnRenamed("key", key)


def repaired_json(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, json): the first whole object of a text, else the text with missing commas, else with what is open closed; null where none parses."""
    kind = df.schema[key].dataType.simpleString()

    def mended(raw: str | None) -> str | None:
        import json
        import re

        def parsed(candidate: str) -> str | None:
            try:
                return json.dumps(json.loads(candidate), sort_keys=True)
            except ValueError:
                return None

        raw, depth = raw or "", 0
        for k, c in enumerate(raw):
            depth += (c == "{") - (c == "}")
            if c == "}" and not depth:
                if out := parsed(raw[: k + 1]):
                    return out
                break
        if out := parsed(re.sub(r'(?<=[}\]"\d])\s*\n(\s*")', r",\n\1", raw)):
            return out
        closed = raw.rstrip() + '"' * (raw.count('"') % 2)
        return parsed(closed + "]" * max(0, closed.count("[") - closed.count("]")) + "}" * max(0, closed.count("{") - closed.count("}")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([mended(x.as_py()) for x in batch.column(1)], pa.string())], names=["key", "json"])

    return df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, json string").withColumnRenamed("key", key)


def write_table(df: DataFrame, path: str) -> None:
    """Replace a table."""
    df.write.mode("overwrite").parquet(path)


def write_partition(df: DataFrame, path: str, by: str) -> None:
    """Replace only the partitions that ``df`` has."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def write_csv(df: DataFrame, path: str, columns: list[str], compress: bool = False) -> None:
    df.select(*columns).write.mode("overwrite").csv(path, header=True, compression="gzip" if compress else "none")


def write_features(features: DataFrame, path: str) -> None:
    """Lines of single features (column feature); a collection is their concatenation between brackets, which a client can stream."""
    features.select("feature").write.mode("overwrite").text(path)


def snapshot(df: DataFrame, folder: str, name: str, day: str, omit: list[str], keep_days: int = 30) -> list[str]:
    """Write a gzip CSV snapshot of a day without the columns ``omit``, delete those older than ``keep_days``; the days that are left."""
    import datetime

    spark = df.sparkSession
    df.drop(*omit).write.mode("overwrite").csv(f"{folder}/{name}/{day}", header=True, compression="gzip")
    jvm = spark._jvm.org.apache.hadoop.fs
    path = jvm.Path(f"{folder}/{name}")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    days = sorted(s.getPath().getName() for s in fs.listStatus(path) if s.isDirectory())
    last = datetime.date.fromisoformat(day) - datetime.timedelta(days=keep_days)
    old = [d for d in days if datetime.date.fromisoformat(d) < last]
    for d in old:
        fs.delete(jvm.Path(f"{folder}/{name}/{d}"), True)
    return [d for d in days if d not in old]
