"""Archives as a data source whose partitions are members, and parsers as table functions for SQL.

    spark.dataSource.register(ArchiveSource)
    spark.read.format("archive").option("path", "hdfs://store/*.zip").load()

    register(spark)
    SELECT t.* FROM files, LATERAL parse_file(path, content, 'html') t
"""

from __future__ import annotations

import fnmatch
import io
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, IntegerType, LongType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

#: Bytes of packed members that a task reads, where the option bytesPerTask says nothing.
BYTES_PER_TASK = 64 << 20


@dataclass
class Members(InputPartition):
    """Members of one archive that a task reads."""

    path: str
    names: list[str]


class _File(io.RawIOBase):
    """An Arrow file as zipfile expects one: a seek before its start is an OSError."""

    def __init__(self, path: str):
        store, inside = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
        self.inner = store.open_input_file(inside)

    def seekable(self) -> bool:
        return True

    def tell(self) -> int:
        return self.inner.tell()

    def seek(self, to: int, whence: int = 0) -> int:
        at = to + (0, self.inner.tell(), self.inner.size())[whence]
        if at < 0:
            raise OSError("before the start of the file")
        return self.inner.seek(at)

    def read(self, size: int = -1) -> bytes:
        return self.inner.read(None if size is None or size < 0 else size)

    def close(self) -> None:
        self.inner.close()
        super().close()


def _archives(pattern: str) -> list[str]:
    """Paths that a pattern in the last part names, or the path itself, in order."""
    folder, _, last = pattern.rpartition("/")
    if not any(c in last for c in "*?["):
        return [pattern]
    uri = folder if "://" in folder else f"file://{folder}"
    store, inside = fs.FileSystem.from_uri(uri)
    head = uri[: len(uri) - len(inside)] if uri.endswith(inside) else ""
    found = store.get_file_info(fs.FileSelector(inside))
    return sorted(head + f.path for f in found if f.is_file and fnmatch.fnmatchcase(f.base_name, last))


class ArchiveSource(DataSource):
    """A row a member of ZIP archives: path, member, size, content.

    Options: path (a pattern in its last part is allowed) and bytesPerTask. Only the directories of
    archives are read to plan; a task opens its archive and reads its members alone, so a large
    archive is many tasks. Stores are those that Arrow opens (file, hdfs, s3, gs). Folders are
    left out; a broken archive is an error that names it.
    """

    @classmethod
    def name(cls) -> str:
        return "archive"

    def schema(self) -> str:
        return "path string, member string, size long, content binary"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        if not options.get("path"):
            raise ValueError("the option path names the archives")
        self.pattern, self.most = options["path"], int(options.get("bytesPerTask", BYTES_PER_TASK))

    def partitions(self) -> list[Members]:
        out = []
        for path in _archives(self.pattern):
            try:
                with _File(path) as f, zipfile.ZipFile(f) as z:
                    found = [i for i in z.infolist() if not i.is_dir()]
            except zipfile.BadZipFile as e:
                raise ValueError(f"{path}: {e}") from e
            names, size = [], 0
            for info in found:
                if names and size + info.compress_size > self.most:
                    out.append(Members(path, names))
                    names, size = [], 0
                names.append(info.filename)
                size += info.compress_size
            if names:
                out.append(Members(path, names))
        return out

    def read(self, partition: Members) -> Iterator[tuple]:
        if not partition:  # no archive at all
            return
        with _File(partition.path) as f, zipfile.ZipFile(f) as z:
            for name in partition.names:
                yield partition.path, name, z.getinfo(name).file_size, z.read(name)


def _zip(path: str, content: bytes) -> Iterator[tuple]:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        for info in z.infolist():
            if not info.is_dir():
                yield path, info.filename, info.file_size, z.read(info)


def _slides(path: str, content: bytes) -> Iterator[tuple]:
    from corvane.sources.files import slide_texts

    for row in slide_texts(content):
        yield path, *row


def _html(path: str, content: bytes) -> Iterator[tuple]:
    from corvane.operators.html import table_rows
    from corvane.sources.files import decode_bytes

    for i, cells in enumerate(table_rows(decode_bytes(content))):
        yield path, i, cells


#: Each parser with the columns of its rows.
PARSERS = {
    "zip": (_zip, StructType().add("path", StringType()).add("member", StringType()).add("size", LongType()).add("content", BinaryType())),
    "slides": (_slides, StructType().add("path", StringType()).add("slide", IntegerType()).add("paragraph", IntegerType()).add("text", StringType()).add("is_note", BooleanType())),
    "html": (_html, StructType().add("path", StringType()).add("row", IntegerType()).add("cells", ArrayType(StringType()))),
}


class ParseFile:
    """parse_file(path, content, parser): the rows of a file; the parser, a constant, says which columns.

    A null content, or one that is no archive or presentation, has no rows.
    """

    @staticmethod
    def analyze(path: AnalyzeArgument, content: AnalyzeArgument, parser: AnalyzeArgument) -> AnalyzeResult:
        if not parser.isConstantExpression or parser.value not in PARSERS:
            raise ValueError(f"the parser is a constant, one of {sorted(PARSERS)}")
        return AnalyzeResult(PARSERS[parser.value][1])

    def eval(self, path: str, content: bytes, parser: str):
        if content is not None:
            try:
                yield from PARSERS[parser][0](path, bytes(content))
            except zipfile.BadZipFile:
                return


class ArchiveKinds:
    """archive_kinds(TABLE(members) PARTITION BY path): what the blocks of each archive come from.

    members: path, member. Rows: path, source (pages, flat, markdown or none), members, images.
    """

    def __init__(self):
        self.path, self.members, self.images, self.found = None, 0, 0, set()

    @staticmethod
    def analyze(members: AnalyzeArgument) -> AnalyzeResult:
        return AnalyzeResult(StructType().add("path", StringType()).add("source", StringType()).add("members", IntegerType()).add("images", IntegerType()))

    def eval(self, row):
        name = (row["member"] or "").lower()
        self.path, self.members = row["path"], self.members + 1
        self.images += name.endswith((".png", ".jpg", ".jpeg", ".webp"))
        for kind, end in (("pages", "content_list_v2.json"), ("flat", "content_list.json"), ("markdown", ".md")):
            if name.endswith(end):
                self.found.add(kind)
                break

    def terminate(self):
        source = next((k for k in ("pages", "flat", "markdown") if k in self.found), "none")
        yield self.path, source, self.members, self.images


def register(spark: SparkSession) -> None:
    """Make the data source and the table functions known to a session."""
    from pyspark.sql.functions import udtf

    spark.dataSource.register(ArchiveSource)
    spark.udtf.register("parse_file", udtf(ParseFile))
    spark.udtf.register("archive_kinds", udtf(ArchiveKinds))
