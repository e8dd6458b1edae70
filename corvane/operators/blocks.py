"""From page items to segments and typed blocks, with pages, anchors and the edges between blocks."""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.functions.geometry import center_distance
from corvane.functions.scopes import strip
from corvane.operators.html import table_rows

# Kinds of page items that are no content, and the fields that hold an item's text.
SUPPRESSED = ("page_header", "page_footer", "page_number")
TEXT_FIELDS = ("text", "title_content", "paragraph_content", "page_header_content", "page_footer_content", "page_number_content", "image_caption", "image_footnote", "item_content")

BLOCKS = "path string, page_index int, order_index int, block_type string, text string, text_level int, list_items array<string>, image_path string, caption string, footnotes array<string>, table_html string, table_rows array<array<string>>, bbox array<double>"


def said(value) -> str:
    """The text of a nested value: strings, lists, and the text fields of objects, joined by blanks."""
    if isinstance(value, str):
        return value.strip()
    if isinstance(value, dict):
        own = value.get("content")
        parts = [own] if isinstance(own, str) else []
        parts += [value[f] for f in TEXT_FIELDS if f in value]
    else:
        parts = value if isinstance(value, list) else []
    return " ".join(filter(None, map(said, parts)))


def nested_html(value) -> str:
    """The first text below a key that ends in html, depth first."""
    if isinstance(value, dict):
        for key, inner in value.items():
            if str(key).lower().endswith("html") and isinstance(inner, str) and inner.strip():
                return inner
            if found := nested_html(inner):
                return found
    elif isinstance(value, list):
        return next(filter(None, map(nested_html, value)), "")
    return ""


def _whole(value, default: int) -> int:
    text = str(value).strip()
    return int(text) if text.lstrip("-").isdigit() else default


def _texts(value) -> list[str]:
    """The texts of a list's members, or of a single value."""
    return [t for v in (value if isinstance(value, list) else [value]) if (t := said(v))]


def _table_text(caption: str, rows: list[list[str]], footnotes: list[str]) -> str:
    """Caption, the rows as T.markdown_table writes them, and footnotes, a line each."""
    n = max(map(len, rows))
    full = [[*map(str.strip, r), *[""] * (n - len(r))] for r in rows]
    widths = [max(3, *map(len, column)) for column in zip(*full)]
    lines = ["| " + " | ".join(map(str.ljust, r, widths)) + " |" for r in full]
    lines.insert(1, "|" + "|".join("-" * (w + 2) for w in widths) + "|")
    return "\n".join([*([caption] if caption else []), *lines, *footnotes])


def _table(of: dict) -> dict:
    body = of.get("table_body")
    html = body.strip() if isinstance(body, str) and "<table" in body.lower() else nested_html(of)
    rows = table_rows(html) if html else []
    caption, notes = said(of.get("table_caption")), _texts(of.get("table_footnote"))
    text = _table_text(caption, rows, notes) if rows else caption or said(of.get("table_content")) or said(of.get("table_text")) or said(list(of.values()))
    return {"table_html": html, "table_rows": rows, "caption": caption, "footnotes": notes, "text": text}


def _list(of: dict) -> dict:
    items = of.get("list_items")
    own = [said(i.get("item_content")) for i in (items if isinstance(items, list) else []) if isinstance(i, dict)]
    refs = str(of.get("list_type") or "").strip().lower() == "reference_list"
    return {"block_type": "reference_list" if refs else "list", "list_items": [i for i in own if i]}


def _image(of: dict) -> dict:
    source = of.get("image_source")
    path = source.get("path") if isinstance(source, dict) else ""
    return {"image_path": path if isinstance(path, str) else "", "caption": said(of.get("image_caption")), "footnotes": _texts(said(of.get("image_footnote")))}


#: What the content of an item of each kind gives a block; the type is the first, unless the reader says another.
_PAGE_KINDS = {
    "title": ("heading", lambda of: {"text": said(of.get("title_content")), "text_level": _whole(of.get("level"), 1) or 1}),
    "paragraph": ("paragraph", lambda of: {"text": said(of.get("paragraph_content"))}),
    "list": ("list", _list),
    "image": ("image", _image),
    "table": ("table", _table),
}
#: The same for items of flat lists: they hold their fields themselves.
_FLAT_KINDS = {
    "title": ("heading", lambda of: {"text": said(of.get("text")), "text_level": _whole(of.get("text_level"), 1) or 1}),
    **dict.fromkeys(("text", "paragraph", "ref_text"), ("paragraph", lambda of: {"text": said(of.get("text"))})),
    **dict.fromkeys(("image", "figure"), ("image", lambda of: {"image_path": of["img_path"] if isinstance(of.get("img_path"), str) else "", "caption": said(of.get("text"))})),
    "table": ("table", _table),
    **{k: (f"page_{k.removeprefix('page_')}", lambda of: {"text": said(of.get("text"))}) for k in ("header", "footer", "page_number")},
}


def _box(value) -> list[float] | None:
    if isinstance(value, list) and len(value) == 4 and {int, float}.issuperset(map(type, value)) and all(map(math.isfinite, value)):
        return list(map(float, value))
    return None


def _block(item, kinds: dict, nested: bool) -> dict | None:
    """Fields of a block from an item; None for what is no object, and for unknown kinds without text."""
    if not isinstance(item, dict):
        return None
    kind, content = str(item.get("type") or "").strip().lower(), item.get("content") if nested else item
    of = content if isinstance(content, dict) else {}
    if kind in kinds:
        block_type, read = kinds[kind]
        return {"block_type": block_type, **read(of), "bbox": _box(item.get("bbox"))}
    text = said(list(of.values()) if nested and of else content if nested else item.get("text"))
    if kind in SUPPRESSED or text:
        return {"block_type": kind if kind in SUPPRESSED else "paragraph", "text": text, "bbox": _box(item.get("bbox"))}
    return None


def _paged(found) -> Iterator[tuple[int, int, dict]]:
    for p, page in enumerate(found):
        for o, item in enumerate(page if isinstance(page, list) else []):
            if block := _block(item, _PAGE_KINDS, True):
                yield p, o, block


def _flat(found) -> Iterator[tuple[int, int, dict]]:
    for o, item in enumerate(found):
        if block := _block(item, _FLAT_KINDS, False):
            page = item.get("page_index")
            yield (page - 1 if isinstance(page, int) and page > 0 else max(0, _whole(item.get("page_idx"), 0))), o, block


def _tables(found) -> Iterator[tuple[int, int, dict]]:
    """The tables of a page list, without a look at what else it holds."""
    for p, page in enumerate(found):
        for o, item in enumerate(page if isinstance(page, list) else []):
            if isinstance(item, dict) and str(item.get("type") or "").strip().lower() == "table":
                yield p, o, _block(item, _PAGE_KINDS, True)


def _distance(a: list[float], b: list[float]) -> tuple[bool, float]:
    """As geometry.center_distance orders: what is no number comes last."""
    d = abs((a[0] + a[2]) / 2 - (b[0] + b[2]) / 2) + abs((a[1] + a[3]) / 2 - (b[1] + b[3]) / 2)
    return d != d, d


def _filled(found, flat) -> Iterator[tuple[int, int, dict]]:
    near: dict[int, list[tuple[list[float], str]]] = {}
    for p, _, block in _flat(flat):
        if block["block_type"] == "paragraph" and block["text"] and block["bbox"]:
            near.setdefault(p, []).append((block["bbox"], block["text"]))
    for p, o, block in _paged(found):
        if block["block_type"] == "paragraph" and not block["text"] and block["bbox"] and p in near:
            block["text"] = min(near[p], key=lambda n: _distance(block["bbox"], n[0]))[1]
        yield p, o, block


def _loaded(content: str | None) -> list | None:
    """The list that a JSON text holds, an empty one for another value; None where it is no JSON."""
    try:
        found = json.loads(content or "[]")
    except (ValueError, RecursionError):
        return None
    return found if isinstance(found, list) else []


def _read(rows: DataFrame, items: Callable, *contents: str, wanted: tuple[str, ...] = ()) -> DataFrame:
    """Blocks that `items` finds in the lists of the first of `contents`; later ones that are no JSON count as empty.

    wanted: the columns to make, all if none is named.
    """
    contents = contents or ("content",)
    # A table's rows, as its text lays them out, are not cleaned.
    fields = [f for f in (f.split(" ", 1) for f in BLOCKS.split(", ")) if not wanted or f[0] in wanted] + [["_rows", "boolean"]]
    strings = pa.list_(pa.string())
    kinds = {"boolean": pa.bool_(), "int": pa.int32(), "string": pa.string(), "array<string>": strings, "array<array<string>>": pa.list_(strings), "array<double>": pa.list_(pa.float64())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {n: [] for n, _ in fields}
            for path, first, *others in zip(batch.column("path").to_pylist(), *[batch.column(c).to_pylist() for c in contents]):
                if (found := _loaded(first)) is not None:
                    for p, o, block in items(found, *[_loaded(c) or [] for c in others]):
                        block.update(path=path, page_index=p, order_index=o, _rows=bool(block.get("table_rows")))
                        for n, values in out.items():
                            values.append(block.get(n))
            yield pa.RecordBatch.from_arrays([pa.array(out[n], kinds[t]) for n, t in fields], [n for n, _ in fields])

    read = rows.select("path", *[F.col(c).cast("string").alias(c) for c in contents]).mapInArrow(run, ", ".join(map(" ".join, fields)))
    return read.select(*[F.when(F.col("_rows"), F.col(n)).otherwise(T.clean(F.col(n))).alias(n) if n == "text" else F.col(n) for n, _ in fields[:-1]])


def page_blocks(pages: DataFrame) -> DataFrame:
    """Blocks of nested page lists: path, content (JSON: a list of pages, each a list of items).

    The kinds of items that page lists know become blocks; others do if they have text. A table's
    text is its caption, its rows as markdown and its footnotes. A row that is no JSON list, and
    items or fields of an unexpected shape, give no block, text or box. Order and page count from 0.
    """
    return _read(pages, _paged)


def page_tables(pages: DataFrame) -> DataFrame:
    """The tables among page_blocks(pages); other items are not made."""
    return _read(pages, _tables)


def archive_blocks(archives: DataFrame, *wanted: str) -> DataFrame:
    """filled_blocks of archives that hold both lists in one row: path, pages and flat (JSON); the wanted columns, or all.

    The nearest text is found while an archive is read, so that no block is shuffled.
    """
    return _read(archives, _filled, "pages", "flat", wanted=wanted)


def flat_blocks(items: DataFrame) -> DataFrame:
    """Blocks of flat lists: path, content (JSON: a list of items that name their page, page_idx from 0)."""
    return _read(items, _flat)


def filled_blocks(blocks: DataFrame, flat: DataFrame) -> DataFrame:
    """Paragraphs without text take that of the nearest flat paragraph of their page that has a box.

    Nearest by the distance of centres (L1), the first of equals. The texts of one page meet in one row.
    """
    boxed = flat.where((F.col("block_type") == "paragraph") & (F.col("text") != "") & F.col("bbox").isNotNull())
    texts = boxed.groupBy("path", "page_index").agg(F.array_sort(F.collect_list(F.struct("order_index", "bbox", "text"))).alias("_near"))
    blank = (F.col("block_type") == "paragraph") & (F.coalesce("text", F.lit("")) == "") & F.col("bbox").isNotNull()
    ranked = F.transform("_near", lambda n: F.struct(center_distance(F.col("bbox"), n["bbox"]).alias("d"), n["order_index"].alias("order_index"), n["text"].alias("text")))
    filled = F.when(blank & F.col("_near").isNotNull(), F.array_min(ranked)["text"]).otherwise(F.col("text"))
    return blocks.join(texts, ["path", "page_index"], "left").withColumn("text", filled).select(*blocks.columns)


def anchor_key(source: Column, page: Column, order: Column) -> Column:
    return F.concat_ws(":", source, page.cast("string"), order.cast("string"))


def segments(blocks: DataFrame) -> DataFrame:
    """Segments of blocks in page order; headers, footers and page numbers are left out.

    Headings, paragraphs and captions give one segment, lists one for each item (numbered from 1).
    Blank texts give none. A text may be merged with its neighbours only if it is a paragraph.
    """
    items = F.when(F.col("block_type").isin("list", "reference_list"), F.col("list_items")).when(F.col("block_type").isin("image", "table"), F.array("caption")).otherwise(F.array("text"))
    role = F.when(F.col("block_type") == "reference_list", "reference_item").when(F.col("block_type") == "list", "list_item").otherwise(F.col("block_type"))
    rows = blocks.where(~F.col("block_type").isin(*SUPPRESSED)).select("*", role.alias("role"), F.posexplode(items).alias("item", "said"))
    rows = rows.withColumn("said", T.clean(F.col("said"))).where("said <> ''")
    name = F.concat_ws("-", F.lit("page"), F.col("page_index").cast("string"), F.lit("block"), F.col("order_index").cast("string"), "role", (F.col("item") + 1).cast("string"))
    return rows.select("path", name.alias("segment_id"), "page_index", F.col("order_index").alias("block_index"), (F.col("item") + 1).alias("paragraph_index"), "role", F.col("said").alias("text"), F.when(F.col("role") == "heading", F.coalesce("text_level", F.lit(1))).alias("heading_level"), (F.col("role") == "paragraph").alias("can_merge"))


def suppressed_counts(blocks: DataFrame) -> DataFrame:
    """How many headers, footers and page numbers of each path were left out."""
    return blocks.groupBy("path").agg(*[F.count_if(F.col("block_type") == k).alias(k) for k in SUPPRESSED])


def table_parts(raw: Column) -> Column:
    """struct<caption, rows, footnotes> of the raw text of a table: lines with a bar are its rows.

    The first other line is the caption, the ones after it are footnotes.
    """
    lines = F.filter(F.transform(F.split(F.coalesce(raw, F.lit("")), "\n"), strip), lambda s: s != "")
    has = lambda s: F.contains(s, F.lit("|"))
    others = F.filter(lines, lambda s: ~has(s))
    return F.struct(F.get(others, F.lit(0)).alias("caption"), F.filter(lines, has).alias("rows"), F.slice(others, 2, F.greatest(F.lit(0), F.size(others) - 1)).alias("footnotes"))


def markdown(rows: DataFrame, key: str, order: list[str], kind: str = "role", text: str = "text", level: str = "heading_level") -> DataFrame:
    """One markdown text a key: headings with their marks, list items with a dash, blocks apart by an empty line."""
    line = F.when(F.col(kind) == "heading", F.concat(F.repeat(F.lit("#"), F.least(F.lit(6), F.coalesce(level, F.lit(1)))), F.lit(" "), F.col(text))).when(F.col(kind).isin("list_item", "reference_item"), F.concat(F.lit("- "), F.col(text))).otherwise(F.col(text))
    parts = F.array_sort(F.collect_list(F.struct(*order, line.alias("line"))))
    return rows.groupBy(key).agg(F.array_join(F.transform(parts, lambda p: p["line"]), "\n\n").alias("markdown"))


def typed_blocks(rows: DataFrame) -> DataFrame:
    """Add kind (text, table, diagram) and retrieval_text to segments: role, text, path_of_headings."""
    kind = F.when(F.col("role") == "table", "table").when(F.col("role").isin("image", "figure", "chart"), "diagram").otherwise("text")
    body = T.retrieval_text(F.col("path_of_headings"), F.col("role"), F.col("text"))
    return rows.select("*", kind.alias("kind"), F.when(kind == "text", body).otherwise(F.col("text")).alias("retrieval_text"))


def block_edges(edges: DataFrame, segments_of: DataFrame, assets_of: DataFrame) -> DataFrame:
    """Distinct (from_block, to_block) of edges (source_id, target_id) between segments and assets.

    segments_of: segment_id, block_id; assets_of: asset_id, block_id. An end is looked up among the
    segments, then among the assets. Edges with an unknown end, or within a block, are left out.
    """

    def end(rows: DataFrame, name: str, out: str) -> DataFrame:
        s = segments_of.select(F.col("segment_id").alias(name), F.col("block_id").alias("_s"))
        a = assets_of.select(F.col("asset_id").alias(name), F.col("block_id").alias("_a"))
        return rows.join(s, name, "left").join(a, name, "left").withColumn(out, F.coalesce("_s", "_a")).drop("_s", "_a")

    both = end(end(edges, "source_id", "from_block"), "target_id", "to_block")
    return both.where("from_block <> to_block").select("from_block", "to_block").distinct()


def anchor_registry(items: DataFrame) -> DataFrame:
    """anchor_key and rects, the boxes of all items of an anchor in order: anchor_key, position, bbox."""
    return items.where(F.size("bbox") == 4).groupBy("anchor_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "bbox"))), lambda s: s["bbox"]).alias("rects"))


def with_rects(blocks: DataFrame, registry: DataFrame) -> DataFrame:
    """Add the rects of each block's anchor, else its own box (if it has one), else none."""
    own = F.when(F.size("bbox") == 4, F.array("bbox")).otherwise(F.array().cast("array<array<double>>"))
    return blocks.join(registry, "anchor_key", "left").withColumn("rects", F.coalesce("rects", own))


def page_extents(points: DataFrame, *page: str) -> DataFrame:
    """Largest x and y of the points of each page."""
    return points.groupBy(*page).agg(F.max("x").alias("width"), F.max("y").alias("height"))


def page_dimensions(pages: DataFrame, sources: list[DataFrame], *page: str) -> DataFrame:
    """width and height of each page by the first source that has them, in the order of the sources."""
    out = pages.select(*page).distinct()
    for k, s in enumerate(sources):
        out = out.join(s.select(*page, F.struct("width", "height").alias(f"_d{k}")).where(F.col(f"_d{k}.width").isNotNull() & F.col(f"_d{k}.height").isNotNull()), list(page), "left")
    best = F.coalesce(*[F.col(f"_d{k}") for k in range(len(sources))])
    return out.select(*page, best["width"].alias("width"), best["height"].alias("height"))


def image_ratio(images: DataFrame, *page: str) -> DataFrame:
    """Share of each page (page_width, page_height) that its images (width, height) cover, at most 1."""
    area = F.sum(F.col("width") * F.col("height")) / F.max(F.col("page_width") * F.col("page_height"))
    return images.groupBy(*page).agg(F.least(F.lit(1.0), area).alias("ratio"))


def page_excerpt(rows: DataFrame, key: str, order: str, pages: Column, most: int = 80, fallback: int = 40, chars: int = 24_000) -> DataFrame:
    """excerpt of each key: lines (page, text) of the wanted pages, at most `most`, cut to `chars`.

    Lines of unknown page always belong to it. Where no line of a wanted page is among them, the
    first `fallback` lines are taken. Lines bear their page's number.
    """
    wanted = F.array_contains(pages, F.col("page"))
    kept = rows.withColumn("text", strip("text")).where(F.col("text") != "").where(F.col("page").isNull() | (F.size(pages) == 0) | wanted)
    kept = kept.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(order))).where(F.col("_n") <= most)
    line = F.when(F.col("page").isNull(), F.col("text")).otherwise(F.concat(F.lit("[Page "), F.col("page").cast("string"), F.lit("] "), F.col("text")))
    got = kept.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_n", line.alias("line")))).alias("lines"), F.count_if(wanted).alias("hits"))
    lines = F.when((F.col("hits") > 0) | (F.size(pages) == 0), F.col("lines")).otherwise(F.slice("lines", 1, fallback))
    return got.select(key, F.left(F.array_join(F.transform(lines, lambda s: s["line"]), "\n\n"), F.lit(chars)).alias("excerpt"))


def summary_inputs(blocks: DataFrame) -> DataFrame:
    """block_id and text of the blocks that a summary reads: prepared for retrieval, with any text.

    retrieval_text, or else display_text; state and texts are read without white space round them.
    """
    text = F.coalesce(F.nullif(strip(F.coalesce("retrieval_text", F.lit(""))), F.lit("")), strip(F.coalesce("display_text", F.lit(""))))
    ready = F.lower(strip(F.coalesce("processing_status", F.lit("")))) == "retrieval_prepared"
    return blocks.where(ready).withColumn("text", text).where("text <> ''")


def _last(column: str, value: int) -> Column:
    return F.coalesce(column, F.lit(value))


def _rank(column: str, kinds: tuple[str, ...], other: int) -> Column:
    out = F.lit(other)
    for k, kind in reversed(list(enumerate(kinds))):
        out = F.when(F.col(column) == kind, k).otherwise(out)
    return out


def normaliser_order() -> list[Column]:
    """unit, order (none: last), text first, id."""
    return [F.col("unit"), _last("reading_order", 999_999), F.when(F.col("kind") == "text", 0).otherwise(1), F.col("id")]


def review_order() -> list[Column]:
    """unit, order (none: last), text, table, diagram, others, id."""
    return [F.col("unit"), _last("reading_order", 1_000_000), _rank("kind", ("text", "table", "diagram"), 9), F.col("id")]


def segment_order() -> list[Column]:
    """rank of the source's type, unit, block, paragraph, id."""
    return [_rank("source_type", ("page", "slide", "paragraph", "table", "formula", "image"), 99), F.col("unit"), F.col("block_index"), F.col("paragraph_index"), F.col("id")]


#: The four ways to list sources: newest, oldest, by name, by name backwards.
SOURCE_SORTS = ("upload_desc", "upload_asc", "name_asc", "name_desc")


def find_sources(rows: DataFrame, needle: str, mode: str, k: int) -> DataFrame:
    """The first k sources (id, title, uploaded_at) whose title holds the needle in any case, in one of SOURCE_SORTS; rank from 1."""
    title = F.lower(strip("title"))
    order = {"upload_desc": [F.desc("uploaded_at"), title], "upload_asc": [F.asc("uploaded_at"), title], "name_asc": [title, F.desc("uploaded_at")], "name_desc": [title.desc(), F.desc("uploaded_at")]}[mode]
    found = rows.where(F.contains(title, F.lit(needle.strip().lower()))).orderBy(*order, "id").limit(k)
    return found.withColumn("rank", F.row_number().over(Window.orderBy(*order, "id")))


def usable_tokens(rows: DataFrame, now: Column, purpose: str) -> DataFrame:
    """Tokens of a purpose that are neither used nor expired."""
    return rows.where(F.col("used_at").isNull() & (F.col("expires_at") > now) & (F.col("purpose") == purpose))


def apply_changes(rows: DataFrame, changes: DataFrame, key: str = "document_id") -> DataFrame:
    """Rename and soft-delete: rows (key, name, deleted) with what changes (key, new_name, gone) says."""
    met = rows.join(changes.select(key, "new_name", "gone"), key, "left")
    name = F.coalesce(F.nullif(strip("new_name"), F.lit("")), F.col("name"))
    return met.select(*[name.alias("name") if c == "name" else (F.col("deleted") | F.coalesce("gone", F.lit(False))).alias("deleted") if c == "deleted" else F.col(c) for c in rows.columns])


def merge_across_pages(rows: DataFrame, key: str, word_end: str = r"\b") -> DataFrame:
    """Join the last paragraph of a page with the first of the next where the text goes on.

    rows: key, page, first and last (texts of the page's ends). Pairs don't chain: a page that took
    part as the second does not start another. Gives key, page, merged (null where none).
    word_end: the pattern for the end of a connecting word.
    """
    w = Window.partitionBy(key).orderBy("page")
    after, gap = F.lead("first").over(w), F.lead("page").over(w) - F.col("page")
    may = rows.withColumns({"_next": after, "_goes": F.coalesce((gap == 1) & T.ends_open(F.col("last")) & T.starts_like_continuation(after, word_end), F.lit(False))})
    # Of a run of pages that go on, every other one starts a pair.
    run = F.sum((~F.col("_goes")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    may = may.withColumn("_run", run).withColumn("_at", F.row_number().over(Window.partitionBy(key, "_run", "_goes").orderBy("page")))
    joined = F.concat(F.regexp_replace("last", r"-\s*$", ""), F.when(F.endswith("last", F.lit("-")), "").otherwise(" "), F.col("_next"))
    return may.select(key, "page", F.when(F.col("_goes") & (F.col("_at") % 2 == 1), joined).alias("merged"))


def payload(results: DataFrame, key: str, k: int) -> DataFrame:
    """One JSON payload a query: status, counts and its k best results (rank, block_id, document_id, score)."""
    ranked = results.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "block_id"))).where(F.col("rank") <= k)
    one = F.struct("rank", "block_id", "document_id", "score")
    got = ranked.groupBy(key).agg(F.array_sort(F.collect_list(one)).alias("results"))
    documents = F.size(F.array_distinct(F.array_compact(F.transform("results", lambda r: r["document_id"])))).cast("long")
    return got.select(key, F.to_json(F.struct(F.lit("ok").alias("status"), F.size("results").alias("result_count"), documents.alias("documents_covered"), "results")).alias("payload"))


def _nothing() -> Column:
    return F.to_json(F.struct(F.lit("empty").alias("status"), F.lit(0).alias("result_count"), F.lit(0).alias("documents_covered"), F.array().cast("array<string>").alias("results")))


def empty_payload(keys: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """The payload of the queries that found nothing."""
    return keys.join(found, key, "left_anti").select(key, _nothing().alias("payload"))


def payloads(keys: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """The payload of every key, found or empty; what was found is computed once."""
    return keys.join(found, key, "left").select(key, F.coalesce("payload", _nothing()).alias("payload"))


def persisted_payload(answers: DataFrame) -> DataFrame:
    """answer_id and what is kept of an answer: number of citations, prompt profile, confidence, whether it is grounded."""
    some = F.size("citation_block_ids") > 0
    return answers.select("answer_id", F.size("citation_block_ids").alias("n_citations"), F.coalesce(F.nullif(F.col("prompt_profile"), F.lit("")), F.lit("default")).alias("prompt_profile"), F.coalesce(F.nullif(F.col("confidence"), F.lit("")), F.lit("insufficient")).alias("confidence"), F.when(some, "grounded").otherwise("insufficient_evidence").alias("grounding_status"))
