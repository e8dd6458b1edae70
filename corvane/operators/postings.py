"""A positional inverted index, and many keyword queries over it in one job.

The index has a row for each term and block, with the places of the term. A query asks for blocks
that have all of its terms: its rarest term names the candidates, the other terms are looked up by
(term, block), so the work follows the rarest terms and no posting list is gathered anywhere.
Queries of the same terms are answered once.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from corvane.operators.joins import positions
from corvane.operators.retrieval import cover_density, tokens
from corvane.shared import folder, written


def build(blocks: DataFrame, words: Column | None = None, key: str = "block_id", text: str = "text") -> DataFrame:
    """(term, block_id, positions from 0): one row for each distinct word of a block.

    words: the array of words of a row, where they are not the tokens of its text (stems, say).
    Blocks without words have no rows; blocks of one key stay apart. Nothing is shuffled.
    """
    kind = blocks.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("words")
            coded = lists.flatten().dictionary_encode()
            sizes = np.diff(np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy())]))
            row = np.repeat(np.arange(len(sizes)), sizes)
            place = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            code = coded.indices.to_numpy(zero_copy_only=False)
            # Words by block and term, in order: as one number each where they fit, which sorts at a fraction of the cost.
            wide, deep = (int(x.max(initial=0)).bit_length() for x in (code, place))
            if len(sizes).bit_length() + wide + deep < 64:
                whole = np.sort((row << (wide + deep)) | (code.astype(np.int64) << deep) | place)
                row, code, place = whole >> (wide + deep), (whole >> deep) & ((1 << wide) - 1), whole & ((1 << deep) - 1)
            else:
                order = np.lexsort((code, row))
                row, code, place = row[order], code[order], place[order]
            first = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (code[1:] != code[:-1])]) if len(row) else np.zeros(0, bool))
            held = pa.ListArray.from_arrays(pa.array(np.append(first, len(row)), pa.int32()), pa.array(place, pa.int32()))
            yield pa.RecordBatch.from_arrays([coded.dictionary.take(pa.array(code[first])), batch.column("key").take(pa.array(row[first])), held], ["term", "block_id", "positions"])

    own = tokens(F.col(text)) if words is None else words
    return blocks.select(F.col(key).alias("key"), own.alias("words")).mapInArrow(run, f"term string, block_id {kind}, positions array<int>")


def frequencies(index: DataFrame) -> DataFrame:
    """(term, blocks): in how many blocks each term stands."""
    return index.groupBy("term").agg(F.count("*").alias("blocks"))


def widest(words: DataFrame, index: DataFrame, n: int) -> DataFrame:
    """The n words of each query (query_id, term) that stand in the most blocks; unknown words are left out."""
    known = words.distinct().join(frequencies(index), "term")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("blocks"), "term"))
    return known.withColumn("_n", rank).where(F.col("_n") <= n).select("query_id", "term")


def matches(index: DataFrame, terms: DataFrame) -> DataFrame:
    """(query_id, block_id, keyword_score) of all blocks with every term of a query (query_id, term).

    The score is that of keyword_matches: cover density, at most 1. Repeated terms count once, null
    terms not at all; a query with a term that no block has matches nothing.
    """
    asked = terms.where("term IS NOT NULL AND query_id IS NOT NULL").groupBy("query_id").agg(F.array_sort(F.collect_set("term")).alias("terms"))
    # The same terms are asked once, under the smallest of their queries.
    members = written(asked)
    classes = written(members.groupBy("terms").agg(F.min("query_id").alias("class")))
    need = classes.select("class", F.size("terms").alias("n"), F.posexplode("terms").alias("no", "term"))
    held = written(index.join(need.select("term").distinct(), "term", "left_semi"))
    ranked = need.join(frequencies(held), "term")
    own = Window.partitionBy("class")
    ranked = written(ranked.withColumn("known", F.count("*").over(own)).where(F.col("known") == F.col("n")).withColumn("nth", F.row_number().over(own.orderBy("blocks", "term"))).drop("known", "blocks"))
    first = ranked.where("nth = 1").join(held, "term").select("class", "block_id", "n", "no", "positions")
    rest = first.where("n > 1").select("class", "block_id").join(ranked.where("nth > 1"), "class").join(held, ["term", "block_id"]).select("class", "block_id", "n", "no", "positions")
    found = first.union(rest).groupBy("class", "block_id", "n").agg(F.collect_list(F.struct("no", "positions")).alias("hits")).where(F.size("hits") == F.col("n"))
    places = F.array_sort(F.flatten(F.transform("hits", lambda h: F.transform(h["positions"], lambda p: p * F.col("n") + h["no"]))))
    scored = found.select("class", "block_id", cover_density(places, F.col("n")).alias("keyword_score"))
    return members.join(classes, "terms").select("query_id", "class").join(scored, "class").select("query_id", "block_id", "keyword_score")


#: Blocks in a tile, most parts that a tile's classes are cut into, and blocks that are scored first.
TILE, PARTS, FIRST = 16384, 16, 256


def _rounded(x: np.ndarray) -> np.ndarray:
    """At nine places, halves up by the decimal form, as round() gives it."""
    y = x * 1e9
    whole = np.floor(y + 0.5)
    for i in np.flatnonzero(np.abs(y - np.floor(y) - 0.5) < 1e-4):
        whole[i] = int(Decimal(repr(float(x[i]))).scaleb(9).quantize(Decimal(1), ROUND_HALF_UP))
    return whole / 1e9


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a block that follow each other (block_id, tid, positions) as one; a block may come in several."""
    for batch in batches:
        if not len(batch):
            continue
        code = batch.column("block_id").dictionary_encode().indices.to_numpy(zero_copy_only=False)
        first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
        cut = np.append(first, len(code)).astype(np.int32)
        lists = batch.column("positions")
        sizes = lists.value_lengths()
        ends = np.concatenate([[0], np.cumsum(sizes.to_numpy())]).astype(np.int32)
        parts = [pa.ListArray.from_arrays(pa.array(cut), c) for c in (batch.column("tid"), sizes)]
        yield pa.RecordBatch.from_arrays([batch.column("block_id").take(pa.array(first)), *parts, pa.ListArray.from_arrays(pa.array(ends[cut]), lists.flatten())], ["block_id", "tids", "sizes", "places"])


def _best(k: int, kind: pa.DataType, group: pa.DataType):
    def run(key: tuple[pa.Scalar, ...], held: pa.Table, asked: pa.Table) -> pa.Table:
        rows = []
        if len(held) and len(asked):
            column = lambda c: held[c].combine_chunks().flatten().to_numpy()
            tid, size, place = column("tids"), column("sizes"), column("places")
            start = np.cumsum(size, dtype=np.int64) - size
            block = np.repeat(held["ord"].to_numpy(), held["tids"].combine_chunks().value_lengths().to_numpy())
            del held
            order = np.lexsort((block, tid))
            tid, size, start, block = tid[order], size[order], start[order], block[order]
            once = np.concatenate([[True], (tid[1:] != tid[:-1]) | (block[1:] != block[:-1])])
            tid, size, start, block = tid[once], size[once].astype(np.int64), start[once], block[once]
            base = int(block.min())
            block = block - base
            width = int(block.max()) + 1
            # Blocks stand behind each other: a block's places count on from where it begins, those of a term are in order.
            long = np.zeros(width, np.int64)
            np.maximum.at(long, block, place[start + size - 1].astype(np.int64) + 1)
            begin = np.concatenate([[0], np.cumsum(long)])
            begin = begin.astype(np.int32 if begin[-1] < np.iinfo(np.int32).max else np.int64)
            ends = np.cumsum(size)
            place = place[np.repeat(start - (ends - size), size) + np.arange(ends[-1])].astype(begin.dtype) + np.repeat(begin[block], size)
            start = ends - size
            names, first = np.unique(tid, return_index=True)
            most = np.maximum.reduceat(size, first)
            first = np.append(first, len(tid))
            rows_of: dict[int, np.ndarray] = {}
            closed: dict[int, np.ndarray] = {}

            def found(t: int, docs: np.ndarray) -> np.ndarray:
                """The row of term t in each of docs, -1 where it has none; terms of many blocks are looked up in a table."""
                low, high = first[t], first[t + 1]
                if (high - low) * 16 > width:
                    if t not in rows_of:
                        rows_of[t] = np.full(width, -1, np.int32)
                        rows_of[t][block[low:high]] = np.arange(low, high)
                    return rows_of[t][docs]
                row = low + np.minimum(np.searchsorted(block[low:high], docs), high - low - 1)
                return np.where(block[row] == docs, row, -1)

            def places(row: np.ndarray) -> np.ndarray:
                many = size[row]
                return place[np.repeat(start[row] - (np.cumsum(many) - many), many) + np.arange(many.sum())]

            def around(t: int, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
                """The places of term t before and behind each x."""
                if t not in closed:
                    there = place[start[first[t]] : ends[first[t + 1] - 1]]
                    closed[t] = np.concatenate([np.full(1, -1, place.dtype), there, begin[-1:]])
                at = np.searchsorted(closed[t][1:-1], x)
                return closed[t][at], closed[t][at + 1]

            def near(own: list[int], rows: list[np.ndarray], reached: float) -> tuple[np.ndarray, np.ndarray]:
                """(blocks, scores) for up to three terms, from the rarest term's places; blocks below reached may be left out.

                A cover holds each of its ends' terms once. It counts with its last place of the rarest
                term: it begins or ends there, or goes from one term before it to the other behind it.
                """
                n = len(own)
                if n == 1:
                    return block[rows[0]], 0.1 * size[rows[0]]
                order = np.argsort([size[r].sum() for r in rows])
                row, others = rows[order[0]], [own[no] for no in order[1:]]
                many, docs, at = size[row], block[row], places(row)
                p, q = around(others[0], at)
                if n == 3 and reached > 0:
                    # At most three covers a place, each as far as the second term at least.
                    some = np.add.reduceat(0.3 / np.maximum(np.minimum(at - p, q - at) - 1, 1), np.cumsum(many) - many) >= reached - 1e-8
                    if not some.any():
                        return docs[:0], np.zeros(0)
                    each = np.repeat(some, many)
                    many, docs, at, p, q = many[some], docs[some], at[each], p[each], q[each]
                low, high = np.repeat(begin[docs], many), np.repeat(begin[docs + 1], many)
                earlier, later = np.append(begin[:1] - 1, at[:-1]), np.append(at[1:], begin[-1:])
                weight = lambda good, far: good / np.where(good, far + (2 - n), 1)
                if n == 2:
                    total = weight((p >= low) & (earlier < p), at - p) + weight((q < high) & (later > q), q - at)
                else:
                    p2, q2 = around(others[1], at)
                    a, z, left, right = np.minimum(p, p2), np.maximum(q, q2), p < p2, q < q2
                    total = weight((a >= low) & (earlier < a), at - a) + weight((z < high) & (later > z), z - at)
                    # Where it begins before and ends behind: with the later of the places before, and the other term's place behind if that is the nearer.
                    begins, stops = np.maximum(p, p2), np.minimum(q, q2)
                    total += weight((left == right) & (begins >= low) & (stops < high) & (later > stops), stops - begins)
                return docs, 0.1 * np.add.reduceat(total, np.cumsum(many) - many)

            def scores(own: list[np.ndarray]) -> np.ndarray:
                """Scores of blocks (rows of each term) for any number of terms, from all of their places."""
                n, docs = len(own), block[own[0]]
                bits = (n - 1).bit_length()
                hits = np.concatenate([(places(row).astype(np.int64) << bits) | no for no, row in enumerate(own)])
                hits.sort()
                no, at = hits & ((1 << bits) - 1), hits >> bits
                doc = np.searchsorted(begin, at, "right") - 1
                p = at
                for t in range(n):
                    p = np.minimum(p, np.maximum.accumulate(np.where(no == t, at, -1)))
                # A cover where the least of the last places moves, within the block.
                cover = np.flatnonzero((p >= begin[doc]) & (p != np.concatenate([[-1], p[:-1]])))
                return np.bincount(doc[cover], 0.1 / (at[cover] - p[cover] + 2 - n), width)[docs]

            lists = asked["tids"].combine_chunks()
            sizes, wanted = lists.value_lengths().to_numpy(), lists.flatten().to_numpy()
            cut = np.concatenate([[0], np.cumsum(sizes)])
            reached = asked["reached"].to_numpy()
            # Between two places of the rarest term the least last place moves once a term at most.
            least = np.maximum(1, np.ceil((reached - 1e-8) / (0.1 * sizes))).astype(np.int64)
            terms = np.minimum(np.searchsorted(names, wanted), len(names) - 1)
            able = (names[terms] == wanted) & (most[terms] >= np.repeat(least, sizes))
            for i in np.flatnonzero(np.logical_and.reduceat(able, cut[:-1])):
                own = sorted(terms[cut[i] : cut[i + 1]].tolist(), key=lambda t: first[t + 1] - first[t])
                held_by = [np.arange(first[own[0]], first[own[0] + 1])]
                if least[i] > 1:
                    held_by = [held_by[0][size[held_by[0]] >= least[i]]]
                for t in own[1:]:
                    row = found(t, block[held_by[0]])
                    good = row >= 0
                    if least[i] > 1:
                        good &= size[row] >= least[i]
                    held_by = [r[good] for r in (*held_by, row)]
                if not len(held_by[0]):
                    continue
                docs = block[held_by[0]]
                if len(own) <= 3:
                    top, score = near(own, held_by, reached[i])
                    good = np.flatnonzero(score >= reached[i] - 1e-8)
                    top, score = top[good], _rounded(np.minimum(1.0, score[good]))
                else:
                    # The highest bounds first, then by order: k blocks of score 1 leave only those before them.
                    bound = np.minimum(1.0, 0.1 * len(own) * np.minimum.reduce([size[r] for r in held_by]))
                    todo = np.argsort(-bound, kind="stable")
                    top, score, step = docs[:0], bound[:0], max(k, FIRST)
                    while len(todo):
                        now, todo = todo[:step], todo[step:]
                        top, score = np.append(top, docs[now]), np.append(score, _rounded(np.minimum(1.0, scores([r[now] for r in held_by]))))
                        kept = np.lexsort((top, -score))[:k]
                        top, score = top[kept], score[kept]
                        if len(top) == k:
                            todo = todo[docs[todo] < top[-1]] if score[-1] >= 1 else todo
                            todo = todo[bound[todo] >= score[-1] - 1e-8]
                        step *= 2
                higher = np.flatnonzero(score > reached[i])
                higher = higher[np.lexsort((top[higher], -score[higher]))[:k]]
                rows.append((np.full(len(higher), i), top[higher] + base, score[higher]))
        i, docs, score = (np.concatenate(c) for c in zip(*rows)) if rows else (np.zeros(0, np.int64), np.zeros(0), np.zeros(0))
        return pa.table([asked["class"].take(pa.array(i)).combine_chunks().cast(kind), pa.array([key[0].as_py()] * len(i), group), pa.array(docs.astype(np.int32)), score], names=["class", "_g", "ord", "keyword_score"])

    return run


def best(index: DataFrame, terms: DataFrame, blocks: DataFrame, order: list[Column], k: int, scope: DataFrame | None = None, rank: str = "sparse_rank") -> DataFrame:
    """(query_id, block_id, keyword_score, rank): of the blocks that matches finds, the k best of each query.

    By score (nine places), then by the order of blocks: block_id, document_id and what the order
    reads. scope (query_id, document_id): a query sees those documents alone. Tiles of blocks meet
    classes of equal terms, and leave k rows a class: no match is shuffled. Tiles go in waves, by
    the order, each four times what came before it: a class with k blocks of the highest score
    needs none after them, and what the others have reached leaves out blocks of lower bounds.
    """
    spark = index.sparkSession
    members = written(terms.where("term IS NOT NULL AND query_id IS NOT NULL").groupBy("query_id").agg(F.array_sort(F.collect_set("term")).alias("terms")))
    classes = written(members.groupBy("terms").agg(F.min("query_id").alias("class")))
    of = members.join(classes, "terms").select("query_id", "class")
    placed = positions(blocks.where("block_id IS NOT NULL"), order, "ord")
    # Places count from the first block of a group.
    if scope is None:
        placed = placed.select("block_id", F.lit(0).alias("_g"), "ord", F.col("ord").alias("_at"))
    else:
        placed = written(placed.where("document_id IS NOT NULL").select("block_id", F.col("document_id").alias("_g"), "ord"))
        placed = placed.join(placed.groupBy("_g").agg(F.min("ord").alias("_from")), "_g").select("block_id", "_g", "ord", (F.col("ord") - F.col("_from")).alias("_at"))
    small = TILE // 4
    tile = F.when(F.col("_at") < TILE, F.floor(F.col("_at") / small)).otherwise(F.floor(F.col("_at") / TILE) + 4).cast("int")
    wave = F.when(F.col("_at") < small, 0).when(F.col("_at") < TILE, 1)
    for w in range(2, 14):
        wave = wave.when(F.col("_at") < TILE * 4 ** (w - 1), w)
    placed = written(placed.select("block_id", "_g", "ord", tile.alias("_tile"), wave.cast("int").alias("_wave")))
    tiles = written(placed.groupBy("_g", "_tile", "_wave").count())
    sees = of.withColumn("_g", F.lit(0)) if scope is None else of.join(scope.select("query_id", F.col("document_id").alias("_g")), "query_id")
    need = classes.select("class", F.explode("terms").alias("term"))
    words = written(positions(need.select("term").distinct(), [F.col("term")], "tid"))
    known = need.join(words, "term").groupBy("class").agg(F.array_sort(F.collect_list("tid")).alias("tids"))
    pairs = written(sees.select("class", "_g").distinct().join(known, "class").withColumn("_hash", F.abs(F.xxhash64("class") % 1_000_003).cast("int")))
    # Rows of the index that classes ask for, a block's in one row and by waves: they are read once a wave.
    kind = index.schema["block_id"].dataType.simpleString()
    rows = index.join(words, "term").select("block_id", "tid", "positions").mapInArrow(_packed, f"block_id {kind}, tids array<int>, sizes array<int>, places array<int>")
    rows = rows.join(placed, "block_id").select("_g", "_tile", "ord", "tids", "sizes", "places", "_wave")
    path = folder(spark)
    rows.write.partitionBy("_wave").parquet(path)
    held = spark.read.schema(rows.schema).parquet(path)

    kinds = [(classes.schema["class"].dataType), placed.schema["_g"].dataType]
    out = f"class {kinds[0].simpleString()}, _g {kinds[1].simpleString()}, ord int, keyword_score double"
    nth = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("keyword_score"), "ord"))
    top = spark.createDataFrame([], out)
    for w, n in sorted(tuple(r) for r in tiles.groupBy("_wave").count().collect()):
        reached = top.groupBy("class", "_g").agg(F.count("*").alias("_n"), F.min("keyword_score").alias("reached")).where(F.col("_n") >= k).drop("_n")
        left = pairs.join(reached, ["class", "_g"], "left").fillna(-1.0, ["reached"]).where("reached < 1")
        # A wave of few tiles is cut by classes, so that it has work for all.
        parts = max(1, min(PARTS, -(-2 * spark.sparkContext.defaultParallelism // n)))
        keys, many = ["_g", "_tile", "_part"], min(1024, 2 * n * parts)
        asked = left.join(tiles.where(F.col("_wave") == w).select("_g", "_tile"), "_g").select("class", "tids", "reached", "_g", "_tile", (F.col("_hash") % parts).alias("_part"))
        own = held.where(F.col("_wave") == w).select("_g", "_tile", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("_part"), "ord", "tids", "sizes", "places")
        found = own.repartition(many, *keys).groupBy(*keys).cogroup(asked.repartition(many, *keys).groupBy(*keys)).applyInArrow(_best(k, *map(to_arrow_type, kinds)), out)
        top = written(top.union(found).withColumn("_n", nth("class", "_g")).where(F.col("_n") <= k).drop("_n"))
    top = top.join(placed.select("ord", "block_id"), "ord")
    if scope is None:
        return of.join(top.withColumn(rank, nth("class")), "class").select("query_id", "block_id", "keyword_score", rank)
    return sees.join(top, ["class", "_g"]).withColumn(rank, nth("query_id")).where(F.col(rank) <= k).select("query_id", "block_id", "keyword_score", rank)


def topk(scored: DataFrame, k: int, order: list[Column], rank: str = "sparse_rank") -> DataFrame:
    """The k first rows of each query, with their rank."""
    return scored.withColumn(rank, F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col(rank) <= k)
