"""Files as DataFrames: texts in unknown encodings, images, ZIP archives of extraction results, slides."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.functions.text import clean, file_type, paragraphs, title_from_filename
from corvane.operators.blocks import filled_blocks, flat_blocks, page_blocks

# Encodings tried in this order.
ENCODINGS = ("utf-8-sig", "utf-8", "utf-16", "utf-16-le", "utf-16-be", "cp1252", "latin-1")


def binary(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, name, content and file_type of every file below a path. The reader gives no row for an empty file."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.withColumn("name", F.regexp_extract("path", "([^/]+)$", 1)).withColumn("file_type", file_type(F.col("name"), F.lit("")))


def decode_bytes(data: bytes | None) -> str | None:
    """Text by the first encoding of the list that fits; UTF-8 with marks for bad bytes, if none does."""
    if data is None:
        return None
    for name in ENCODINGS:
        try:
            return data.decode(name)
        except UnicodeDecodeError:
            continue
    return data.decode("utf-8", "replace")


def _decode(column: pd.Series) -> pd.Series:
    return column.map(decode_bytes)


def texts(files: DataFrame) -> DataFrame:
    """path and text of text files."""
    return files.where("file_type = 'text'").select("path", F.pandas_udf(_decode, T.StringType())("content").alias("text"))


def text_segments(texts_: DataFrame) -> DataFrame:
    """A row a paragraph: path, paragraph_index (from 1), text."""
    rows = texts_.select("path", F.posexplode(paragraphs(F.col("text"))).alias("_p", "text"))
    return rows.select("path", (F.col("_p") + 1).alias("paragraph_index"), "text")


def images(files: DataFrame) -> DataFrame:
    """One asset an image: SHA-256 of its bytes, and a caption from its name."""
    return files.where("file_type = 'image'").select("path", F.sha2("content", 256).alias("content_hash"), F.length("content").alias("n_bytes"), title_from_filename(F.col("name")).alias("caption"))


def unique_assets(assets: DataFrame) -> DataFrame:
    """The first path of each content, and all paths that have it."""
    return assets.groupBy("content_hash").agg(F.min("path").alias("path"), F.array_sort(F.collect_set("path")).alias("paths"))


MEMBERS = "path string, member string, content binary"


def zip_members(files: DataFrame, largest: int = 1 << 30) -> DataFrame:
    """A row a file of each ZIP archive; members of more than `largest` bytes are an error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for info in z.infolist():
                        if info.is_dir():
                            continue
                        if info.file_size > largest:
                            raise ValueError(f"{path}: {info.filename} has {info.file_size} bytes")
                        yield pd.DataFrame({"path": [path], "member": [info.filename], "content": [z.read(info)]})

    return files.select("path", "content").mapInPandas(run, MEMBERS)


def manifest(members: DataFrame) -> DataFrame:
    """Which members of an archive hold pages, flat items, layout, text and images."""
    m = F.lower("member")
    kind = (
        F.when(F.endswith(m, F.lit("content_list_v2.json")), "pages")
        .when(F.endswith(m, F.lit("content_list.json")), "flat")
        .when(F.endswith(m, F.lit("layout.json")) | F.endswith(m, F.lit("middle.json")), "layout")
        .when(F.endswith(m, F.lit("model.json")), "model")
        .when(F.endswith(m, F.lit(".md")), "markdown")
        .when(F.rlike(m, F.lit(r"\.(png|jpe?g|webp)$")), "image")
    )
    return members.withColumn("kind", kind).where("kind IS NOT NULL")


def intermediate_blocks(kinds: DataFrame) -> DataFrame:
    """Blocks of each archive with page and order: nested pages, else flat items, else markdown.

    Paragraphs of nested pages without text take it from the flat items of the archive.
    """
    text = lambda kind: kinds.where(F.col("kind") == kind).select("path", F.decode("content", "UTF-8").alias("content"))
    flat = flat_blocks(text("flat"))
    pages = filled_blocks(page_blocks(text("pages")), flat)
    prose = markdown_blocks(text("markdown").withColumnRenamed("content", "text"))
    every = pages.withColumn("_rank", F.lit(1)).unionByName(flat.withColumn("_rank", F.lit(2))).unionByName(prose.withColumn("_rank", F.lit(3)), allowMissingColumns=True)
    best = every.groupBy("path").agg(F.min("_rank").alias("_rank"))
    return every.join(best, ["path", "_rank"]).drop("_rank")


def markdown_blocks(docs: DataFrame) -> DataFrame:
    """Headings and paragraphs of markdown texts, as blocks of one page."""
    parts = F.filter(F.transform(F.split("text", "\n{2,}"), lambda s: F.trim(s)), lambda s: s != "")
    rows = docs.select("path", F.posexplode(parts).alias("order_index", "raw"))
    marks = F.regexp_extract("raw", r"^(#{1,6})\s", 1)
    return rows.select("path", F.lit(0).alias("page_index"), "order_index", F.when(marks != "", "heading").otherwise("paragraph").alias("block_type"), clean(F.regexp_replace("raw", r"^#{1,6}\s+", "")).alias("text"), F.when(marks != "", F.length(marks)).alias("text_level"))


_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"


def slide_texts(content: bytes) -> list[tuple[int, int, str, bool]]:
    """(slide, paragraph, text, is_note) of a presentation, slides by number, notes last."""
    out = []
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        for folder, note in (("slides/slide", False), ("notesSlides/notesSlide", True)):
            found = [(int(m[1]), n) for n in z.namelist() if (m := re.fullmatch(rf"ppt/{folder}(\d+)\.xml", n))]
            for number, name in sorted(found):
                for i, p in enumerate(ElementTree.fromstring(z.read(name)).iter(f"{_A}p"), 1):
                    if text := "".join(t.text or "" for t in p.iter(f"{_A}t")).strip():
                        out.append((number, i, text, note))
    return sorted(out, key=lambda r: (r[0], r[3], r[1]))


def slides(files: DataFrame) -> DataFrame:
    """Paragraphs of presentations, by slide."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                yield pd.DataFrame([(path, *r) for r in slide_texts(content)], columns=["path", "slide", "paragraph", "text", "is_note"])

    return files.where("file_type = 'pptx'").select("path", "content").mapInPandas(run, "path string, slide int, paragraph int, text string, is_note boolean")

