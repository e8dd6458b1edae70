"""Archives as a data source, table functions, and HTML tables that were left open."""

from __future__ import annotations

import io
import random
import zipfile

import pytest

from corvane.operators import html
from corvane.sources import archives, files


def packed(members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in members:
            z.writestr(name, text)
    return out.getvalue()


def test_members_are_partitions(spark, tmp_path):
    """A large archive is read by several tasks, each opening its own members; folders and empty archives give none."""
    big = [(f"m{i:03d}.txt", random.Random(i).randbytes(5000)) for i in range(40)] + [("folder/", b""), ("empty", b"")]
    (tmp_path / "big.zip").write_bytes(packed(big))
    (tmp_path / "none.zip").write_bytes(packed([]))
    (tmp_path / "other.txt").write_bytes(b"x")
    archives.register(spark)
    got = spark.read.format("archive").option("path", f"{tmp_path}/*.zip").option("bytesPerTask", 8000).load()
    assert got.rdd.getNumPartitions() > 4
    rows = {r["member"]: (r["path"].rsplit("/", 1)[1], r["size"], bytes(r["content"])) for r in got.collect()}
    assert rows == {n: ("big.zip", len(c), c) for n, c in big if n != "folder/"}
    one = spark.read.format("archive").option("path", f"file://{tmp_path}/big.zip").load()
    assert one.rdd.getNumPartitions() == 1 and one.count() == 41
    assert spark.read.format("archive").option("path", f"{tmp_path}/no*.zip").load().count() == 0
    blocks = files.manifest(one.select("path", "member", "content"))
    assert blocks.count() == 0
    with pytest.raises(Exception, match="names the archives"):
        spark.read.format("archive").load().count()
    (tmp_path / "bad.zip").write_bytes(b"no archive")
    with pytest.raises(Exception, match=r"bad\.zip"):
        spark.read.format("archive").option("path", f"{tmp_path}/bad.zip").load().count()


def test_table_functions_equal_dataframes(spark, tmp_path):
    slide = '<r xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"><a:p><a:r><a:t>Hi</a:t></a:r></a:p></r>'
    (tmp_path / "a.pptx").write_bytes(packed([("ppt/slides/slide2.xml", slide), ("ppt/slides/slide1.xml", slide), ("ppt/notesSlides/notesSlide1.xml", slide)]))
    (tmp_path / "b.zip").write_bytes(packed([("x/full.md", "# T"), ("x/a.png", "p")]))
    archives.register(spark)
    held = files.binary(spark, str(tmp_path)).cache()
    by_sql = lambda parser, kind: spark.sql(f"SELECT t.* FROM {{held}} h, LATERAL parse_file(h.path, h.content, '{parser}') t WHERE h.name LIKE '%{kind}'", held=held)
    assert sorted(map(tuple, by_sql("slides", ".pptx").collect())) == sorted(map(tuple, files.slides(held).collect()))
    members = files.zip_members(held.where("name = 'b.zip'"))
    assert sorted((r["member"], bytes(r["content"])) for r in by_sql("zip", ".zip").collect()) == sorted((r["member"], bytes(r["content"])) for r in members.collect())
    kinds = spark.sql("SELECT source, members, images FROM archive_kinds(TABLE(SELECT path, member FROM {m}) PARTITION BY path)", m=members).collect()
    assert [tuple(r) for r in kinds] == [("markdown", 2, 1)]
    odd = spark.createDataFrame([("n", None), ("e", b""), ("t", b"text")], "path string, content binary")
    assert spark.sql("SELECT t.* FROM {odd} o, LATERAL parse_file(o.path, o.content, 'zip') t", odd=odd).count() == 0
    with pytest.raises(Exception, match="constant"):
        spark.sql("SELECT t.* FROM {odd} o, LATERAL parse_file(o.path, o.content, o.path) t", odd=odd).count()


@pytest.mark.parametrize(
    "markup, rows",
    [
        ("<table><tr><th>a<th>b<tr><td>1<td>2</table>", [["a", "b"], ["1", "2"]]),
        ("<tr><td>x</td><td> y  z</td></tr><tr><td>1", [["x", "y z"], ["1"]]),
        ("<TABLE><TR><TD>a&amp;b<br>c</TD></TR>", [["a&b c"]]),
        ("<td>lost", []),
        ("text <b>only</b>", []),
        ("", []),
        (None, []),
        ("<table><tr></tr><tr><td></td></tr></table>", [[""]]),
    ],
)
def test_tables_left_open(markup, rows):
    assert html.table_rows(markup) == rows
