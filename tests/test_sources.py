"""Planned data sources: services that fail, shapefiles and workbooks that the tests write."""

import json
import math
import os
import random
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from penstock.functions import sections
from penstock.sources import plans as P


def test_pages_are_retried_and_cached(spark, tmp_path):
    calls, rows = tmp_path / "calls", 25
    calls.mkdir()

    def fetch(ask):
        name = f"{calls}/{ask['offset']}"
        n = len([f for f in os.listdir(calls) if f.startswith(f"{ask['offset']}.")])
        open(f"{name}.{n}", "w").close()
        if ask["offset"] == 10 and n < 2:
            raise OSError("service is busy")
        assert ask["fields"] == ["id", "name"]
        full = [{"id": k, "name": f"n{k}", "more": "x"} for k in range(ask["offset"], min(ask["offset"] + ask["limit"], rows))]
        return {"records": [{f: r[f] for f in ask["fields"] if not (f == "name" and r["id"] == 3)} for r in full]}

    read = lambda: P.paged(spark, "service_pages", fetch, "id long, name string", total=lambda: rows, cache=f"{tmp_path}/cache", page=10, pause=0.01)
    assert read().rdd.getNumPartitions() == 3
    want = [(k, None if k == 3 else f"n{k}") for k in range(rows)]
    assert sorted(map(tuple, read().collect())) == want
    assert sorted(os.listdir(calls)) == ["0.0", "10.0", "10.1", "10.2", "20.0"]
    # a page that is lost is fetched again, the others are not
    os.remove(next(f"{tmp_path}/cache/{f}" for f in os.listdir(f"{tmp_path}/cache") if f.startswith("service_pages-20-")))
    assert sorted(map(tuple, read().collect())) == want and sorted(os.listdir(calls))[-1] == "20.1" and len(os.listdir(calls)) == 6
    broken = P.paged(spark, "service_broken", lambda ask: 1 / 0, "id long", total=lambda: 1, tries=2, pause=0.01)
    with pytest.raises(Exception, match="ZeroDivisionError"):
        broken.collect()
    assert P.paged(spark, "service_empty", lambda ask: {"records": []}, "id long", total=lambda: 0).count() == 0


def shapefile(path, stem, shapes, rows, stored=False):
    """A ZIP of a shapefile: shapes are lists of rings, a point or None; rows are dicts of text."""
    records, index, at = b"", b"", 50
    for k, s in enumerate(shapes):
        if s is None:
            body = struct.pack("<i", 0)
        elif isinstance(s, tuple):
            body = struct.pack("<i2d", 1, *s)
        else:
            points = [p for r in s for p in r]
            begins = [sum(map(len, s[:j])) for j in range(len(s))]
            body = struct.pack("<i4d2i", 5, *[f(p[c] for p in points) for f in (min, max) for c in (0, 1)], len(s), len(points)) + struct.pack(f"<{len(s)}i", *begins) + b"".join(struct.pack("<2d", *p) for p in points)
        records += struct.pack(">2i", k + 1, len(body) // 2) + body
        index += struct.pack(">2i", at, len(body) // 2)
        at += 4 + len(body) // 2
    head = struct.pack(">7i", 9994, 0, 0, 0, 0, 0, at) + struct.pack("<2i8d", 1000, 5, *[0.0] * 8)
    names = list(rows[0])
    width = 12
    dbf = struct.pack("<4BIHH20x", 3, 24, 1, 1, len(rows), 33 + 32 * len(names), 1 + width * len(names)) + b"".join(n.encode().ljust(11, b"\0") + b"C" + b"\0" * 4 + bytes([width, 0]) + b"\0" * 14 for n in names) + b"\r"
    dbf += b"".join(b" " + b"".join(r[n].encode().ljust(width) for n in names) for r in rows)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_STORED if stored else zipfile.ZIP_DEFLATED) as z:
        for end, data in (("shp", head + records), ("shx", head + index), ("dbf", dbf)):
            z.writestr(f"{stem}.{end}", data)


@pytest.mark.parametrize("stored", [False, True])
def test_shapefile_in_archive(spark, tmp_path, stored):
    square = [(0.0, 0.0), (0.0, 4.0), (4.0, 4.0), (4.0, 0.0), (0.0, 0.0)]  # clockwise
    hole = [(1.0, 1.0), (2.0, 1.0), (2.0, 2.0), (1.0, 2.0), (1.0, 1.0)]
    island = [(9.0, 9.0), (9.0, 10.0), (10.0, 10.0), (9.0, 9.0)]
    shapes = [[square, hole, island], None, (5.5, -3.25), [island, square, hole]] * 6
    rows = [{"NAME": f"n{k}é"[:6], "CODE": str(k), "LEFT": ""} for k in range(len(shapes))]
    shapefile(f"{tmp_path}/a.zip", "Counties", shapes, rows, stored)
    df = P.read_shapefile(spark, f"{tmp_path}/a.zip", ["CODE", "LEFT", "none"], records=5)
    assert df.rdd.getNumPartitions() == 5 and df.columns == ["file", "record", "geom", "CODE", "LEFT", "none"]
    got = {r["record"]: r for r in df.collect()}
    plain = lambda g: None if g is None else [[[tuple(q) for q in ring] for ring in p] for p in g]
    assert sorted(got) == list(range(24)) and all(r["CODE"] == str(k) and r["LEFT"] is None and r["none"] is None for k, r in got.items())
    assert sorted(plain(got[0]["geom"]), key=len) == [[island], [square, hole]] == sorted(plain(got[3]["geom"]), key=len)
    assert got[1]["geom"] is None and plain(got[2]["geom"]) == [[[(5.5, -3.25)]]]
    moved = df.filter("record = 0").select(P.reprojected(F.col("geom")).alias("g")).first()["g"]
    assert all(abs(a["x"] - b["x"]) < 1e-9 and abs(a["y"] - b["y"]) < 2e-9 for p, q in zip(moved, got[0]["geom"]) for r, s in zip(p, q) for a, b in zip(r, s))


def test_datum_shift(spark):
    # the published example of a shift by seven parameters (WGS 72 to WGS 84): 0, 0, 4.5 m; 0, 0, 0.554 seconds; 0.219 ppm
    lat, lng = 55.0, 4.0
    wgs72 = (6378135.0, 1 / 298.26)
    got = spark.range(1).select(P.shifted(F.lit(lng), F.lit(lat), wgs72, P.WGS84, move=(0.0, 0.0, 4.5), turn=(0.0, 0.0, 0.554), scale=0.219).alias("p")).first()["p"]
    a, f = wgs72
    e, phi, lam = f * (2 - f), math.radians(lat), math.radians(lng)
    n = a / math.sqrt(1 - e * math.sin(phi) ** 2)
    x, y, z = n * math.cos(phi) * math.cos(lam), n * math.cos(phi) * math.sin(lam), n * (1 - e) * math.sin(phi)
    m, r = 1 + 0.219e-6, math.radians(0.554 / 3600)
    X, Y, Z = m * (x - r * y), m * (r * x + y), m * z + 4.5
    b, g = P.WGS84
    h, t = g * (2 - g), math.atan2(Z, math.hypot(X, Y) * (1 - g * (2 - g)))
    for _ in range(50):
        t = math.atan2(Z + h * b * math.sin(t) / math.sqrt(1 - h * math.sin(t) ** 2), math.hypot(X, Y))
    assert abs(got["x"] - math.degrees(math.atan2(Y, X))) < 1e-12 and abs(got["y"] - math.degrees(t)) < 1e-11


def workbook(path, sheets):
    with zipfile.ZipFile(path, "w") as z:
        main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name="{n}" sheetId="{k}" r:id="r{k}"/>' for k, n in enumerate(sheets)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="r{k}" Target="worksheets/s{k}.xml"/>' for k in range(len(sheets))) + "</Relationships>")
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}"><si><t>id</t></si><si><r><t>val</t></r><r><t>ue</t></r></si></sst>')
        for k, (stated, rows) in enumerate(sheets.values()):
            extent = f'<dimension ref="A1:B{stated}"/>' if stated else ""
            z.writestr(f"xl/worksheets/s{k}.xml", f'<worksheet xmlns="{main}">{extent}<sheetData>' + "".join(f'<row r="{i}">' + "".join(f'<c r="{c}{i}" {kind}><v>{v}</v></c>' for c, kind, v in cells) + "</row>" for i, cells in rows) + "</sheetData></worksheet>")


def test_workbook_by_windows(spark, tmp_path):
    data = lambda n: [(1, [("A", 't="s"', 0), ("B", 't="s"', 1)])] + [(i, [("A", "", i % 4), ("B", "", i / 2)]) for i in range(2, n + 1)]
    workbook(f"{tmp_path}/w.xlsx", {"Meta": (5, data(5)), "Rates": (30, data(33)), "Notes": (None, data(4))})
    df = P.read_sheets(spark, f"{tmp_path}/w.xlsx", rows=10)
    assert df.rdd.getNumPartitions() == 1 + 3 + 1
    got = {(r["sheet"], r["row"]): r["cells"] for r in df.collect()}
    assert len(got) == 5 + 33 + 4 and got["Rates", 1] == {"A": "id", "B": "value"} and got["Rates", 33] == {"A": "1", "B": "16.5"}
    assert P.read_sheets(spark, f"{tmp_path}/w.xlsx", sheets=["Meta"]).count() == 5
    heads, rows = (df.filter((F.col("sheet") == s) & (F.col("row") > 1)).select(F.col("cells")["A"].alias("key"), "row", F.col("cells")["B"].alias("v")) for s in ("Meta", "Rates"))
    made = {r["key"]: r for r in P.grouped_rows(heads, rows, "key", "row").collect()}
    assert sorted(made) == ["0", "1", "2", "3"] and [x["row"] for x in made["1"]["rows"]] == list(range(5, 34, 4)) and made["2"]["head"]["row"] == 2


def test_long_sheets_have_few_windows(spark, tmp_path):
    data = [(1, [("A", 't="s"', 0)])] + [(i, [("A", "", i)]) for i in range(2, 402)]
    workbook(f"{tmp_path}/w.xlsx", {"Rates": (401, data)})
    df = P.read_sheets(spark, f"{tmp_path}/w.xlsx", rows=10)
    assert df.rdd.getNumPartitions() == 4 and sorted(r["row"] for r in df.collect()) == list(range(1, 402))


def test_sections_of_service_areas(spark):
    name, pad = "NJ AMERICAN WATER - SHORT HILLS", "Charges per thousand gallons.\n" * 100
    general, other, own = f"RATE SCHEDULE A-1\n{pad}", f"\n  Rate Schedule B-2  \nCoastal North\n{pad}", f"RATE SCHEDULE C-3\nShort Hills service\n{pad}as shown on Rate Schedule A-1 above\n"
    head = f"[Extracted rate schedule section for: {name}]\n[From multi-service-area tariff document]\n\n"
    got = lambda text, name=name: spark.createDataFrame([(text, name)], "t string, n string").select(sections.area_section(F.col("t"), F.col("n"))).first()[0]
    assert got("Tariff\n" + general + other + own) == head + general + "\n\n---\n\n" + own
    assert got("Tariff\n" + own + other) == head + own
    assert got("Tariff\n" + general + other, "X WATER - NOWHERE") == "[Default rate schedule (A-1) extracted for: X WATER - NOWHERE]\n[From multi-service-area tariff — no specific area match found]\n\n" + general
    assert got("Tariff\n" + general + own[:60]) is None and got(general + pad) is None and got("Tariff\n" + general + own, "SHORT HILLS WATER") is None and got(None) is None and got("") is None
    assert len(got("Tariff\n" + own + pad * 20 + general)) == 45_000


def simulated(lines, kind):
    """Records by walking the lines one by one."""
    out, i = [], 0
    while i < len(lines):
        if kind(lines[i]) != "o":
            i += 1
            continue
        names, j, place = [lines[i]], i + 1, None
        while j < min(len(lines), i + 5):
            k = kind(lines[j])
            if k == "c":
                place = lines[j]
                j += 1
                break
            if k not in "so":
                break
            if k == "o":
                names.append(lines[j])
            j += 1
        if place is None:
            i += 1
            continue
        amount = None
        while j < min(len(lines), i + 10):
            k = kind(lines[j])
            if k in "au":
                amount = float(lines[j].replace("$", "").replace(",", "")) if k == "a" else None
                break
            j += 1
        out.append((" ".join(names), place, amount))
        i = j + 1
    return out


def test_survey_records_like_a_walk(spark):
    kinds = {"c": ["Taos", "de baca"], "s": ["Page 1", "TOTAL x"], "a": ["$1,204.50", "$3.00"], "u": ["N/A"], "n": ["12", "x"], "o": ["Alpha Water", "of Bend"]}
    of = {x: k for k, xs in kinds.items() for x in xs}
    rng = random.Random(5)
    texts = [[rng.choice(kinds[rng.choice("ccsaunooo")]) for _ in range(rng.randrange(40))] for _ in range(300)]
    df = spark.createDataFrame([(k, "\n".join(f" {x} " for x in t) + "\n\n") for k, t in enumerate(texts)], "k int, t string")
    got = df.select("k", sections.survey_records(F.col("t"), [r"Page \d", "TOTAL"], ["TAOS", "De Baca"]).alias("r")).collect()
    assert {r["k"]: [tuple(x) for x in r["r"]] for r in got} == {k: simulated(t, of.__getitem__) for k, t in enumerate(texts)}
    assert json.dumps(spark.createDataFrame([(None,), ("",)], "t string").select(sections.survey_records(F.col("t"), ["x"], ["y"])).collect()) == "[[null], [[]]]"
