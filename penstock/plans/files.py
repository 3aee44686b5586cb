"""Readers and sinks as queries: tables are written to the shared work folder in the form of a source and read back."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F

from ..operators import tables
from ..sources import plans as P
from ..sources import readers as R
from ..sources import writers as W
from ..sources.readers import table


def _folder(spark, name):
    """A fresh folder in ``spark.checkpoint.dir``, which all executors share; a temporary one in local mode if that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="penstock-")
    path = spark._jvm.org.apache.hadoop.fs.Path(base)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/") + f"/{name}-{uuid.uuid4().hex}"


def _write_groups(df, by, folder, content, end):
    """Write a file for each group, made by ``content`` of its rows, under a name of its own."""

    def put(rows):
        import pandas as pd

        system, at = P._fs(folder)
        system.create_dir(at)
        name = f"{at}/{rows[by].iloc[0]}.{end}"
        with system.open_output_stream(name) as f:
            f.write(content(rows))
        return pd.DataFrame({"n": [len(rows)]})

    return df.groupBy(by).applyInPandas(put, "n long").agg(F.sum("n")).first()[0]


def csv_columns(spark, d):
    """SINK-10, SRC-2: a CSV of some columns, and some of these read back."""
    at = _folder(spark, "csv")
    R.write_csv(table(spark, d, "customer"), at, ["c_custkey", "c_name", "c_mktsegment", "c_acctbal"])
    return R.read_text_csv(spark, at, ["c_custkey", "c_acctbal", "c_name"]).select(F.col("c_custkey").cast("long").alias("c_custkey"), "c_name", F.col("c_acctbal").cast("double").alias("c_acctbal"))


def tab_columns(spark, d):
    """SRC-3: a table with tabs, read by its ending, with a column that it lacks."""
    at = _folder(spark, "tabs") + "/t.tsv"
    table(spark, d, "supplier").select("s_suppkey", "s_name").write.csv(at, header=True, sep="\t")
    return R.read_table_file(spark, at, ["s_suppkey", "s_name", "none"]).withColumn("s_suppkey", F.col("s_suppkey").cast("long"))


def zipped_csv(spark, d):
    """SRC-1: the CSV of each ZIP that fits a name, cells as text, also with line ends in them."""

    def content(rows):
        import csv
        import io
        import zipfile

        text, out = io.StringIO(), io.BytesIO()
        lines = csv.writer(text)
        lines.writerow(["key", "name", "note"])
        lines.writerows([k, n, f"one\ntwo, {k}"] for k, n in zip(rows["s_suppkey"], rows["s_name"]))
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("readme.csv", "key\n0\n")
            z.writestr("Pub_Systems.CSV", text.getvalue())
        return out.getvalue()

    at = _folder(spark, "zips")
    _write_groups(table(spark, d, "supplier").select("s_nationkey", "s_suppkey", "s_name"), "s_nationkey", at, content, "zip")
    return R.read_zip_csv(spark, at, r"pub.*\.csv$", ["key", "name", "note", "gone"])


def json_pages(spark, d):
    """SRC-7, SRC-8: landed pages with a field of records, pages that overlap counted once."""
    at = _folder(spark, "pages")
    c = table(spark, d, "customer").select("c_custkey", "c_name", F.floor(F.col("c_custkey") / 100).alias("page"))
    both = c.unionByName(c.filter("c_custkey % 100 = 0").withColumn("page", F.col("page") - 1))
    pages = both.groupBy("page").agg(F.to_json(F.struct(F.struct(F.collect_list(F.struct("c_custkey", "c_name")).alias("records")).alias("result"))).alias("value"))
    pages.repartition("page").write.partitionBy("page").text(at)
    return R.read_pages(spark, f"{at}/*", "result.records", "c_custkey:long,c_name:string", "c_custkey")


def geojson_features(spark, d):
    """SRC-4, SINK-11: collections of features, and features by line."""
    s = table(spark, d, "supplier").select("s_nationkey", F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct("s_suppkey", "s_name").alias("properties"), F.struct(F.lit("Point").alias("type"), F.array(F.col("s_suppkey") % 90, F.lit(1)).alias("coordinates")).alias("geometry"))).alias("feature"))
    at, lines = _folder(spark, "collections"), _folder(spark, "lines")
    whole = s.groupBy("s_nationkey").agg(F.concat(F.lit('{"type":"FeatureCollection","features":['), F.concat_ws(",", F.collect_list("feature")), F.lit("]}")).alias("value"))
    whole.repartition("s_nationkey").write.partitionBy("s_nationkey").text(at)
    R.write_features(s, lines)
    take = lambda df, kind: df.select(F.lit(kind).alias("kind"), F.col("properties")["s_suppkey"].cast("long").alias("s_suppkey"), F.get_json_object("geometry", "$.coordinates[0]").cast("int").alias("x"))
    return take(R.read_geojson(spark, f"{at}/*"), "collection").unionByName(take(R.read_geojson_lines(spark, lines), "line"))


def workbook_rows(spark, d):
    """SRC-9, SRC-10: workbooks of two sheets by windows of rows, columns found by their header, rows grouped by key."""

    def content(rows):
        meta = [["Key", "Segment"]] + [[int(k), s] for k, s in sorted(set(zip(rows["o_custkey"], rows["o_orderpriority"].str[:1])))]
        rates = [["Price", None, "Key", "Line"]] + [[float(p), None, int(k), int(o)] for k, o, p in zip(rows["o_custkey"], rows["o_orderkey"], rows["o_totalprice"])]
        return W.workbook_bytes({"Meta": meta, "Rates": rates})

    at = _folder(spark, "books")
    # books grow in number, not in size: a sheet has 1,048,576 rows at most
    o = table(spark, d, "orders").withColumn("book", F.floor(F.col("o_custkey") / 2000))
    _write_groups(o.select("book", "o_custkey", "o_orderkey", "o_totalprice", "o_orderpriority"), "book", at, content, "xlsx")
    rates = R.by_header(P.read_sheets(spark, at, rows=500, sheets=["Rates"]), ["Key", "Line", "Price"]).select(F.col("Key").alias("key"), F.col("Line").cast("long").alias("line"), F.col("Price").cast("double").alias("price"))
    heads = R.by_header(P.read_sheets(spark, at, rows=500, sheets=["Meta"]), ["Key", "Segment"]).select(F.col("Key").alias("key"), F.col("Segment").alias("segment"))
    made = P.grouped_rows(heads, rates, "key", "line")
    return made.select(F.col("key").cast("long").alias("key"), F.col("head.segment").alias("segment"), F.size("rows").alias("n"), F.array_join(F.transform("rows", lambda r: r["line"].cast("string")), ",").alias("lines"))


def shape_archives(spark, d):
    """SRC-6: shapefiles in archives, pruned attributes, shifted to the other datum."""

    def content(rows):
        shapes, names = [], []
        for k, n in zip(rows["s_suppkey"], rows["s_name"]):
            x, y = float(k % 90), float(k % 40)
            square, hole = [(x, y), (x, y + 4), (x + 4, y + 4), (x + 4, y), (x, y)], [(x + 1, y + 1), (x + 2, y + 1), (x + 2, y + 2), (x + 1, y + 1)]
            shapes.append(None if k % 5 == 0 else (x, y) if k % 5 == 1 else [hole, square])
            names.append({"NAME": n, "GEOID": str(k), "OTHER": "x"})
        return W.shapefile_bytes("counties", shapes, names)

    at = _folder(spark, "shapes")
    _write_groups(table(spark, d, "supplier").select("s_nationkey", "s_suppkey", "s_name"), "s_nationkey", at, content, "zip")
    g = P.read_shapefile(spark, at, ["GEOID", "NAME"], records=16).withColumn("geom", P.reprojected(F.col("geom")))
    first = F.col("geom")[0][0][0]
    return g.select(F.col("GEOID").cast("long").alias("s_suppkey"), F.col("NAME").alias("s_name"), F.size(F.col("geom")[0]).alias("rings"), F.round(first["x"], 6).alias("x"), F.round(first["y"], 6).alias("y"))


def service_pages(spark, d):
    """SRC-7, SRC-8, SRC-13: a paged service over the suppliers, asked for two fields, its pages kept in the work folder."""
    path = f"{d}/supplier.parquet"

    def fetch(ask):
        import pyarrow.parquet as pq

        system, at = P._fs(path)
        return {"records": pq.read_table(at, columns=ask["fields"], filesystem=system).slice(ask["offset"], ask["limit"]).to_pylist()}

    def total():
        import pyarrow.parquet as pq

        system, at = P._fs(path)
        with system.open_input_file(at) as f:
            return pq.ParquetFile(f).metadata.num_rows

    return P.paged(spark, "supplier_service", fetch, "s_suppkey long, s_name string", total=total, cache=_folder(spark, "service"), page=30)


def replaced_partitions(spark, d):
    """SINK-1, SINK-2, SINK-14: a table replaced, then one of its partitions, and the audit rows of both."""
    at = _folder(spark, "parts")
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    R.write_table(o.limit(0), f"{at}/t")
    R.write_partition(o, f"{at}/p", "o_orderstatus")
    tables.append_run(o, f"{at}/runs", "load", "2024-01-01")
    again = o.filter("o_orderstatus = 'F'").withColumn("o_totalprice", -F.col("o_totalprice"))
    R.write_partition(again, f"{at}/p", "o_orderstatus")
    tables.append_run(again, f"{at}/runs", "replace", "2024-01-02")
    kept = spark.read.parquet(f"{at}/p").groupBy(F.col("o_orderstatus").alias("name")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_totalprice") < 0).alias("negative"))
    runs = spark.read.parquet(f"{at}/runs").select(F.col("step").alias("name"), F.col("n_rows").alias("n"), F.lit(0).cast("long").alias("negative"))
    return kept.unionByName(runs)


def kept_snapshots(spark, d):
    """SINK-13: a compressed snapshot a day without some columns; what is older than thirty days goes."""
    at, n = _folder(spark, "snapshots"), table(spark, d, "nation")
    for day in ("2024-01-01", "2024-01-20"):
        R.snapshot(n, at, "nation", day, ["n_name"])
    days = R.snapshot(n.filter("n_nationkey < 10"), at, "nation", "2024-02-10", [])
    out = [spark.read.csv(f"{at}/nation/{day}", header=True).select(F.lit(day).alias("day"), F.col("n_nationkey").cast("long").alias("n_nationkey"), F.col("n_regionkey").cast("long").alias("n_regionkey")) for day in days]
    return out[0].unionByName(out[1])


QUERIES = {f.__name__: f for f in (csv_columns, tab_columns, zipped_csv, json_pages, geojson_features, workbook_rows, shape_archives, service_pages, replaced_partitions, kept_snapshots)}

ORACLE = {
    "csv_columns": "select c_custkey, c_name, c_acctbal from customer",
    "tab_columns": "select s_suppkey, s_name, null::varchar as \"none\" from supplier",
    "zipped_csv": "select s_suppkey::varchar \"key\", s_name \"name\", 'one' || chr(10) || 'two, ' || s_suppkey note, null::varchar gone from supplier",
    "json_pages": "select c_custkey, c_name from customer",
    "geojson_features": "select k.kind, s_suppkey, (s_suppkey % 90)::int x from supplier, (values ('collection'), ('line')) k(kind)",
    "workbook_rows": "select o_custkey \"key\", min(left(o_orderpriority, 1)) segment, count(*)::int n, string_agg(o_orderkey, ',' order by o_orderkey) lines from orders group by 1",
    "shape_archives": "select s_suppkey, s_name, case when s_suppkey % 5 = 0 then null when s_suppkey % 5 = 1 then 1 else 2 end::int rings, case when s_suppkey % 5 > 0 then s_suppkey % 90 end::double x, case when s_suppkey % 5 > 0 then s_suppkey % 40 end::double y from supplier",
    "service_pages": "select s_suppkey, s_name from supplier",
    "replaced_partitions": "select o_orderstatus \"name\", count(*) n, case when o_orderstatus = 'F' then count(*) else 0 end negative from orders group by 1 union all select 'load', count(*), 0 from orders union all select 'replace', count(*) filter (o_orderstatus = 'F'), 0 from orders",
    "kept_snapshots": "select '2024-01-20' \"day\", n_nationkey, n_regionkey from nation union all select '2024-02-10', n_nationkey, n_regionkey from nation where n_nationkey < 10",
}
