"""HTML pages: segments by tag, and tables as grids with row and column spans."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows and cells of markup that no parser takes as a table.
_ROW = re.compile(r"<tr\b[^>]*>(.*?)(?=<tr\b|</tr\b|</table\b|$)", re.I | re.S)
_CELL = re.compile(r"<t[dh]\b[^>]*>(.*?)(?=<t[dh]\b|</t[dh]\b|$)", re.I | re.S)

#: Markup of bare tags and text alone, and its pieces.
_BARE = re.compile(r"(?:</?(?:table|thead|tbody|tfoot|tr|td|th|b|i|u|em|strong|sub|sup|p|div|span|br)>|[^<&]++)*+", re.I)
_TABLE_TAGS = frozenset(("table", "tr", "td", "th"))
_PIECE = re.compile(r"<(/?)(\w+)>|([^<]+)")

GRID = "page_id long, table_index int, matrix array<array<string>>, cells array<struct<row:int,col:int,row_span:int,col_span:int,text:string,is_header:boolean>>, n_merged int"


def page_segments(pages: DataFrame) -> DataFrame:
    """page_id, pos (from 1), level (headings only) and label of headings and paragraphs, in order."""
    items = F.regexp_extract_all("html", F.lit(r"(?is)<h[1-6][^>]*>.*?</h[1-6]>|<p>.*?</p>"), F.lit(0))
    rows = pages.select("page_id", F.posexplode(items).alias("_p", "raw"))
    label = F.trim(F.regexp_replace(F.regexp_replace("raw", r"(?s)<[^>]*>", " "), r"\s+", " "))
    return rows.select("page_id", (F.col("_p") + 1).alias("pos"), F.nullif(F.regexp_extract("raw", r"^<[hH]([1-6])", 1), F.lit("")).cast("int").alias("level"), label.alias("label"))


class _Pieces(HTMLParser):
    """Pieces of a page: (end, tag, text, attributes), end is "/" for tags that close."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found: list[tuple] = []

    def handle_starttag(self, tag, attrs):
        self.found.append(("", tag, "", dict(attrs)))

    def handle_data(self, data):
        self.found.append(("", "", data))

    def handle_endtag(self, tag):
        self.found.append(("/", tag, ""))


def _pieces(html: str) -> list[tuple]:
    """By the parser, or, where a page is bare tags and text, by the tags alone, which gives the same in less time."""
    if _BARE.fullmatch(html):
        return _PIECE.findall(html)
    parser = _Pieces()
    parser.feed(html)
    parser.close()
    return parser.found


def _tables(html: str | None, last: bool = False) -> list[list[list[tuple]]]:
    """Cells of every table of a page, by rows, as (text, row span, column span, is header).

    last: whether a cell counts that is still open at the end of the page.
    """
    tables: list[list[list[tuple]]] = []
    depth: list[int] = []
    open_cells: dict[int, list] = {}

    def close(t: int) -> None:
        if cell := open_cells.pop(t, None):
            tables[t][-1].append((" ".join(" ".join(cell[0]).split()), *cell[1:]))

    for piece in _pieces(html or ""):
        end, tag, data = piece[:3]
        if data:
            if depth and (cell := open_cells.get(depth[-1])):
                cell[0].append(data)
            continue
        if tag not in _TABLE_TAGS and (tag := tag.lower()) not in _TABLE_TAGS:
            continue
        if not end and tag == "table":
            tables.append([])
            depth.append(len(tables) - 1)
            continue
        if not depth:
            continue
        t = depth[-1]
        close(t)
        if end:
            if tag == "table":
                depth.pop()
        elif tag == "tr":
            tables[t].append([])
        else:
            if not tables[t]:
                tables[t].append([])
            said = piece[3] if len(piece) > 3 else {}
            span = [int(v) if (v := said.get(k) or "1").isdigit() and int(v) > 0 else 1 for k in ("rowspan", "colspan")] if said else (1, 1)
            open_cells[t] = [[], *span, tag == "th"]
    if last:
        for t in range(len(tables)):
            close(t)
    return tables


def grid(rows: list[list[tuple]]) -> tuple[list[list[str]], list[dict]]:
    """(matrix, cells): a spanning cell's text stands in every place it covers."""
    taken: dict[tuple[int, int], str] = {}
    cells = []
    for r, row in enumerate(rows):
        c = 0
        for text, down, across, header in row:
            while (r, c) in taken:
                c += 1
            down = min(down, len(rows) - r)
            taken.update({(r + i, c + j): text for i in range(down) for j in range(across)})
            cells.append({"row": r, "col": c, "row_span": down, "col_span": across, "text": text, "is_header": header or r == 0})
            c += across
    width = max((c for _, c in taken), default=-1) + 1
    return [[taken.get((r, c), "") for c in range(width)] for r in range(len(rows))], cells


def parse_tables(html: str | None) -> list[tuple[list[list[str]], list[dict]]]:
    return [grid(t) for t in _tables(html) if any(t)]


def table_rows(html: str | None) -> list[list[str]]:
    """Texts of the cells of all rows, without spans; rows without cells are left out.

    By the parser, which closes what is left open; markup that it finds no cell in (rows outside of
    a table, tags cut off) is read by its row and cell tags alone.
    """
    rows = [[cell[0] for cell in row] for table in _tables(html, last=True) for row in table if row]
    if not rows:
        plain = lambda cell: " ".join(unescape(re.sub(r"<[^>]*>?", " ", cell)).split())
        rows = [cells for row in _ROW.findall(html or "") if (cells := [plain(c) for c in _CELL.findall(row)])]
    return rows


def _rows_of(html: pd.Series) -> pd.Series:
    return html.map(table_rows, na_action="ignore")


def table_matrix(html: Column) -> Column:
    """The rows of a table's HTML as array<array<string>>; null stays null."""
    return F.pandas_udf(_rows_of, "array<array<string>>")(html)


def page_tables(pages: DataFrame) -> DataFrame:
    """A row a table: grid, cells and number of merged cells. Pages without tables give none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(p, i, m, c, sum(x["row_span"] * x["col_span"] > 1 for x in c)) for p, h in zip(pdf["page_id"], pdf["html"]) for i, (m, c) in enumerate(parse_tables(h))]
            yield pd.DataFrame(rows, columns=["page_id", "table_index", "matrix", "cells", "n_merged"])

    return pages.where(F.contains(F.lower("html"), F.lit("<table"))).select("page_id", "html").mapInPandas(run, GRID)
