"""Plain text of HTML pages for parsing: the main content, tables as Markdown."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements whose contents are left out, elements without an end, and the length kept.
LEFT_OUT = frozenset("script style nav header footer noscript iframe button input select textarea svg img video audio".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
KEPT = 15_000
_region = re.compile("content|main", re.I)
_class = re.compile("content|main|body", re.I)


class Page(HTMLParser):
    """Text pieces in order, each with the numbers of the regions around it: main, article, and what is named like content."""

    def __init__(self):
        super().__init__()
        self.open: list[tuple[str, int | None]] = []
        self.regions: list[str] = []
        self.pieces: list[tuple[str, frozenset[int]]] = []
        self.skip, self.tables = 0, []

    def around(self) -> frozenset[int]:
        return frozenset(n for _, n in self.open if n is not None)

    def handle_starttag(self, tag, attrs):
        if tag in LEFT_OUT and tag not in VOID:
            self.skip += 1
        values, number = dict(attrs), None
        if tag in ("main", "article") or _region.search(values.get("id") or "") or _class.search(values.get("class") or ""):
            number = len(self.regions)
            self.regions.append(tag if tag in ("main", "article") else "named")
        if not self.skip and tag == "table":
            self.tables.append([])
        elif not self.skip and self.tables and tag == "tr":
            self.tables[-1].append([])
        elif not self.skip and self.tables and tag in ("td", "th") and self.tables[-1]:
            self.tables[-1][-1].append("")
        if tag not in VOID:
            self.open.append((tag, number))

    def handle_endtag(self, tag):
        if not any(t == tag for t, _ in self.open):
            return
        while self.open:
            last, _ = self.open[-1]
            if last == "table" and self.tables and not self.skip:
                self.end_table()
            self.open.pop()
            if last in LEFT_OUT:
                self.skip -= 1
            if last == tag:
                return

    def end_table(self) -> None:
        rows = [r for r in self.tables.pop() if r]
        wide = max(map(len, rows), default=0)
        lines = ["| " + " | ".join([*(" ".join(c.split()) for c in r), *[""] * (wide - len(r))]) + " |" for r in rows]
        text = "\n".join(lines[:1] + ["| " + " | ".join(["---"] * wide) + " |"] + lines[1:]) if rows else ""
        if self.tables and self.tables[-1] and self.tables[-1][-1]:  # a table within a cell
            self.tables[-1][-1][-1] += " " + text
        elif text:
            self.pieces.append((text, self.around()))

    def handle_data(self, data):
        if self.skip or not data.strip():
            return
        if self.tables and self.tables[-1] and self.tables[-1][-1]:
            self.tables[-1][-1][-1] += data
        else:
            self.pieces.append((data.strip(), self.around()))

    def text(self) -> str:
        while self.tables:
            self.end_table()
        pick = next((k for kind in ("main", "article") for k, r in enumerate(self.regions) if r == kind), None)
        if pick is None and self.regions:
            sizes = [sum(len(t) for t, around in self.pieces if k in around) for k in range(len(self.regions))]
            pick = sizes.index(max(sizes))
        whole = "\n".join(t for t, around in self.pieces if pick is None or pick in around)
        lines = [re.sub(r"[ \t]{2,}", " ", x).strip() for x in whole.split("\n")]
        whole = "\n".join(x for x in lines if len(x) > 3 or not x or "$" in x)
        whole = re.sub(r"\n{3,}", "\n\n", whole)
        return (whole[:KEPT] + "\n\n[TRUNCATED — page exceeded 15,000 chars]" if len(whole) > KEPT else whole).strip()


def page_text(html: str | None) -> str:
    page = Page()
    page.feed(html or "")
    page.close()
    return page.text()


def clean_text(df: DataFrame, key: str, html: str) -> DataFrame:
    """(key, text): the clean text of each page, an Arrow pass, as no built-in walks tags."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([page_text(x.as_py()) for x in batch.column(1)], pa.string())], names=["key", "text"])

    return df.select(F.col(key).alias("key"), F.col(html).alias("html")).mapInArrow(run, f"key {kind}, text string").withColumnRenamed("key", key)
