"""Archives of shapes and workbooks as sinks: a file a group, written by the tasks that hold the groups."""

from __future__ import annotations

import io
import struct
import zipfile
from xml.sax.saxutils import escape


def shapefile_bytes(stem: str, shapes: list, rows: list[dict[str, str]], width: int = 24) -> bytes:
    """A ZIP with the three parts of a shapefile: shapes are polygons as lists of rings, points as (x, y) or None; attributes are text of ``width`` bytes at most."""
    records, index, at = io.BytesIO(), io.BytesIO(), 50
    for k, shape in enumerate(shapes, 1):
        if shape is None:
            body = struct.pack("<i", 0)
        elif isinstance(shape, tuple):
            body = struct.pack("<i2d", 1, *shape)
        else:
            points, begins = [p for r in shape for p in r], [0]
            for r in shape[:-1]:
                begins.append(begins[-1] + len(r))
            box = [f(p[c] for p in points) for f in (min, max) for c in (0, 1)]
            body = struct.pack("<i4d2i", 5, *box, len(shape), len(points)) + struct.pack(f"<{len(shape)}i", *begins) + b"".join(struct.pack("<2d", *p) for p in points)
        records.write(struct.pack(">2i", k, len(body) // 2) + body)
        index.write(struct.pack(">2i", at, len(body) // 2))
        at += 4 + len(body) // 2
    head = lambda words: struct.pack(">7i", 9994, 0, 0, 0, 0, 0, words) + struct.pack("<2i8d", 1000, 5, *[0.0] * 8)
    names = list(rows[0]) if rows else []
    described = b"".join(n.encode("ascii").ljust(11, b"\0") + b"C" + bytes(4) + bytes([width, 0]) + bytes(14) for n in names)
    table = struct.pack("<4BIHH20x", 3, 24, 1, 1, len(rows), 33 + 32 * len(names), 1 + width * len(names)) + described + b"\r"
    table += b"".join(b" " + b"".join(r[n].encode()[:width].ljust(width) for n in names) for r in rows)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(f"{stem}.shp", head(at) + records.getvalue())
        z.writestr(f"{stem}.shx", head(50 + 4 * len(shapes)) + index.getvalue())
        z.writestr(f"{stem}.dbf", table)
    return out.getvalue()


def _letters(k: int) -> str:
    out = ""
    while k >= 0:
        k, r = divmod(k, 26)
        out, k = chr(65 + r) + out, k - 1
    return out


def workbook_bytes(sheets: dict[str, list[list]]) -> bytes:
    """An .xlsx file of sheets by name, each a list of rows of numbers, texts (shared) and empty cells (None)."""
    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    shared: dict[str, int] = {}
    parts = []
    for rows in sheets.values():
        lines = []
        for i, row in enumerate(rows, 1):
            made = []
            for k, value in enumerate(row):
                if isinstance(value, str):
                    made.append(f'<c r="{_letters(k)}{i}" t="s"><v>{shared.setdefault(value, len(shared))}</v></c>')
                elif value is not None:
                    made.append(f'<c r="{_letters(k)}{i}"><v>{value}</v></c>')
            lines.append(f'<row r="{i}">{"".join(made)}</row>')
        extent = f'<dimension ref="A1:{_letters(max(map(len, rows), default=1) - 1)}{max(len(rows), 1)}"/>'
        parts.append(f'<worksheet xmlns="{main}">{extent}<sheetData>{"".join(lines)}</sheetData></worksheet>')
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name="{escape(n)}" sheetId="{k}" r:id="r{k}"/>' for k, n in enumerate(sheets, 1)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="r{k}" Type="{rel}/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in range(1, len(sheets) + 1)) + "</Relationships>")
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}">' + "".join(f"<si><t>{escape(t)}</t></si>" for t in shared) + "</sst>")
        for k, part in enumerate(parts, 1):
            z.writestr(f"xl/worksheets/sheet{k}.xml", part)
    return out.getvalue()
