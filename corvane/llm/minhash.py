"""MinHash near-dedup: banding, signature and full-set verification, connected components.

Plan, in terms of texts with different shingle sets ("classes"; exact copies share one):

1. One pass over the documents gives each row's set size, a 128-bit set fingerprint, band keys
   and a one-bit sketch from many universal hash minima.
2. Classes by fingerprint; each sends its band keys. Inside a bucket of equal keys, sorted and
   streamed, a class goes to the first leader that its sketch puts well above the threshold. A
   bucket of more than SLICE classes is dealt to slices that find leaders of their own; only
   these leaders meet in the next round.
3. These leader pairs are confirmed on full sets, and components formed of the links.
4. A second pass over the buckets finds clusters of texts in different components that sizes and
   sketches cannot rule out. Buckets and clusters are cut into chunks, and pairs of chunks are
   tiles of bounded size; chunks of one large component never meet. Clusters are compared exactly.
   The components of all links are final; copies take that of their class.

So a group of n copies that link to each other costs about n pairs, not n squared; only copies
that hover below the threshold meet the rest of their cluster. No link is lost to a cap.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm._common import ASCII_LOWER, WORD, expand, materialize, shuffle_partitions, squeeze
from corvane.llm.components import Forest, connected_components

#: Minima for the bands, and further ones that only sharpen the sketch.
BANDS, ROWS, EXTRA = 32, 5, 32
HASHES = BANDS * ROWS + EXTRA
SEED = 20240
#: Words whose hash a task remembers: beyond the frequent ones, hashing costs what a look-up does.
MEMORY = 1 << 16
#: Standard deviations that a sketch may fall below the threshold before it rules a pair out.
MARGIN = 4.5
#: Classes of a bucket that meet in one group.
SLICE = 2048
#: Slices' leaders meet in a further round while it leaves at most this share of them.
SHRINK = 0.5


def _family(n: int, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 1 << 31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 1 << 32, n, dtype=np.uint32)


class Shingler:
    """Sorted distinct 64-bit hashes of a text's word shingles; words are hashed once each."""

    def __init__(self, words: int):
        self.words, self.find, self.known = words, re.compile(WORD).findall, {}

    def __call__(self, text: str | None) -> np.ndarray:
        tokens = self.find(text.translate(ASCII_LOWER)) if text else []
        known = self.known
        if len(known) > MEMORY:
            known.clear()
        out = []
        for t in tokens:
            if (h := known.get(t)) is None:
                h = known[t] = xxhash.xxh64_intdigest(t)
            out.append(h)
        h = np.array(out, np.uint64)
        if not len(h):
            return h
        n = min(self.words, len(h))
        shingle = h[: len(h) - n + 1] + np.uint64(n)
        for k in range(1, n):
            shingle = _mix(shingle) + h[k : len(h) - n + 1 + k]
        return np.unique(_mix(shingle))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _minima(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest value of each hash a*x + b (mod 2**32) over the shingles."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(a), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 512):
        np.minimum(least, (x[at : at + 512, None] * a + b).min(axis=0), out=least)
    return least


def _values(column: pa.Array) -> Iterator:
    """Python values one at a time: all of a batch's texts at once would take its memory twice."""
    return (v.as_py() for v in column)


def _signer(words: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, (a, b) = Shingler(words), _family(HASHES)
        for batch in batches:
            sizes, high, low, bands, sketches = [], [], [], [], []
            for text in _values(batch.column("text")):
                s = shingle(text)
                sizes.append(len(s))
                if not len(s):
                    for column in (high, low, bands, sketches):
                        column.append(None)
                    continue
                mark = xxhash.xxh128_digest(s.tobytes())
                high.append(int.from_bytes(mark[:8], "little", signed=True))
                low.append(int.from_bytes(mark[8:], "little", signed=True))
                least = _minima(s, a, b)
                rows = least[: BANDS * ROWS].reshape(BANDS, ROWS).astype(np.uint64)
                key = np.arange(1, BANDS + 1, dtype=np.uint64)
                for k in range(ROWS):
                    key = _mix(key + rows[:, k])
                bands.append(key.astype(np.int64))
                bit = (_mix(least.astype(np.uint64)) >> np.uint64(17)).astype(np.uint8) & np.uint8(1)
                sketches.append(np.packbits(bit).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(high, pa.int64()), pa.array(low, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(sketches, pa.binary())],
                ["doc_id", "n_shingles", "f1", "f2", "bands", "sketch"],
            )

    return sign


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n_shingles, fingerprint (f1, f2), bands and sketch of every row; null without words."""
    return docs.mapInArrow(_signer(words), "doc_id long, n_shingles long, f1 long, f2 long, bands array<long>, sketch binary")


def _bits(batch: pa.RecordBatch) -> np.ndarray:
    flat = batch.column("sketch").combine_chunks() if isinstance(batch.column("sketch"), pa.ChunkedArray) else batch.column("sketch")
    return np.frombuffer(b"".join(flat.to_pylist()), np.uint8).reshape(len(batch), -1).copy().view(np.uint64)


def _groups(batches: Iterator[pa.RecordBatch], *more: str, alone: str | None = None) -> Iterator[list[np.ndarray]]:
    """Runs of equal (key, part) in sorted batches: key, part, ids, sizes, bits and further columns.

    Runs of one row are left out, but where the column `alone` says that they count.
    """
    held: list[list[np.ndarray]] = []
    names = ("key", "part", "id", "size", *more)

    def whole():
        run = held[0] if len(held) == 1 else [np.concatenate(c) for c in zip(*held)]
        if len(run[0]) > 1 or alone and run[-1][0]:
            yield run

    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in names]
        columns.insert(4, _bits(batch))
        if alone:
            columns.append(batch.column(alone).to_numpy(zero_copy_only=False))
        key, part = columns[:2]
        cuts = np.concatenate([[0], np.flatnonzero((key[1:] != key[:-1]) | (part[1:] != part[:-1])) + 1, [len(key)]])
        # The first and last run may go on in other batches.
        wanted = np.diff(cuts) > 1
        wanted[[0, -1]] = True
        if alone:
            wanted |= columns[-1][cuts[:-1]]
        for k in np.flatnonzero(wanted).tolist():
            i, j = cuts[k], cuts[k + 1]
            if held and (held[0][0][0], held[0][1][0]) != (key[i], part[i]):
                yield from whole()
                held = []
            held.append([c[i:j] for c in columns])
    if held:
        yield from whole()


def _limits(percent: int) -> tuple[int, int]:
    """Bits in which sketches differ: most that a pair at the threshold shows, and most for a leader."""
    p = (1 - percent / 100) / 2
    return int(HASHES * p + MARGIN * (HASHES * p * (1 - p)) ** 0.5), int(HASHES * p * 0.8)


_FOUND = "a long, b long, key long, size long, sketch binary, leads boolean"


def _leader_pairs(percent: int):
    """First pass over slices of buckets.

    Gives pairs (a, b), and the members of buckets of three and more once again (key, id as a,
    size, sketch, and whether they lead), for the second pass to look at what the leaders leave open.
    """

    def run(batches):
        most, near = _limits(percent)
        out = _Out()
        for key, _, ids, size, bits, sliced in _groups(batches, alone="sliced"):
            if len(ids) < 3 and not sliced[0]:
                if 100 * size.min() >= percent * size.max() and _apart(bits[0], bits[1]) <= most:
                    out.pair(ids[:1], ids[1:])
                continue
            leads = np.zeros(len(ids), bool)
            left = np.arange(len(ids))
            while len(left):
                k, left = left[0], left[1:]
                leads[k] = True
                fits = (_apart(bits[left], bits[k]) <= near) & (100 * np.minimum(size[left], size[k]) >= percent * np.maximum(size[left], size[k]))
                if fits.any():
                    out.pair(np.full(int(fits.sum()), ids[k]), ids[left[fits]])
                    left = left[~fits]
            out.members.append((ids, key, size, bits, leads))
            out.rows += len(ids)
            if out.rows > 4096:
                yield from out.flush()
        yield from out.flush()

    return run


class _Out:
    """Pairs and members that wait to be sent together."""

    def __init__(self):
        self.a, self.b, self.members, self.rows = [], [], [], 0

    def pair(self, a: np.ndarray, b: np.ndarray) -> None:
        self.a.append(a)
        self.b.append(b)
        self.rows += len(a)

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.a:
            yield _pairs(self.a, self.b)
        if self.members:
            ids, key, size, bits, leads = map(np.concatenate, zip(*self.members))
            yield _found(ids, np.full(len(ids), None), key, size, [x.tobytes() for x in bits], leads)
        self.__init__()


def _found(a, b, key, size, sketch, leads) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.bool_())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip((a, b, key, size, sketch, leads), kinds)], ["a", "b", "key", "size", "sketch", "leads"])


def _apart(bits: np.ndarray, own: np.ndarray) -> np.ndarray:
    return np.bitwise_count(bits ^ own).sum(axis=-1, dtype=np.int64)


def _open_forest(percent: int):
    """Second pass over tiles: a spanning forest of the pairs in different components that may link.

    Two members of a bucket may link if their components differ and sizes and sketches cannot
    rule them out. Only which members hang together is emitted, at most one row a member.
    """

    def run(batches):
        most, _ = _limits(percent)
        for _, _, ids, size, bits, comp, side in _groups(batches, "component", "side"):
            left = np.flatnonzero(side == 0)
            right = np.flatnonzero(side == 1) if (side == 1).any() else left
            forest = Forest(len(ids))
            for at in range(0, len(left), 256):
                own = left[at : at + 256, None]
                fits = (comp[own] != comp[right]) & (100 * np.minimum(size[own], size[right]) >= percent * np.maximum(size[own], size[right]))
                i, j = np.nonzero(fits)
                i, j = left[at + i], right[j]
                may = np.concatenate([_apart(bits[i[k : k + (1 << 18)]], bits[j[k : k + (1 << 18)]]) <= most for k in range(0, len(i), 1 << 18)] or [np.zeros(0, bool)])
                forest.link(i[may], j[may])
            member, root = forest.edges()
            if len(member):
                yield _pairs([ids[member]], [ids[root]])

    return run


def _pairs(a: list[np.ndarray], b: list[np.ndarray]) -> pa.RecordBatch:
    """Distinct pairs, the smaller id first."""
    x, y = np.concatenate(a), np.concatenate(b)
    pairs = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)]), axis=1)
    none = np.full(pairs.shape[1], None)
    return _found(pairs[0], pairs[1], none, none, none, none)


def _in_groups(rows: DataFrame, body) -> DataFrame:
    """Apply body to rows (key, part, id, size, sketch, ...), dealt and sorted by key and part."""
    parts = shuffle_partitions(rows.sparkSession)
    return rows.repartition(parts, "key", "part").sortWithinPartitions("key", "part", "id").mapInArrow(body, _FOUND)


def _led(rows: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """(pairs of leader and member, members of buckets of three and more) of rows (key, id, size, sketch)."""
    crowded = lambda df: materialize(df.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > SLICE))
    large = crowded(rows)
    some = large.count()
    none = [F.lit(0).cast("long").alias("part"), F.lit(False).alias("sliced")]
    # Few buckets are large: those rows alone are dealt to slices.
    here = rows.join(large, "key", "left_anti") if some else rows
    dealt = here.select("key", *none, "id", "size", "sketch")
    if some:
        dealt = dealt.union(_sliced(rows, large, 0))
    found = materialize(_in_groups(dealt, _leader_pairs(percent)))
    pairs, members, last = found.where("key IS NULL").select("a", "b"), found.where("key IS NOT NULL"), found
    turn = 0
    while some:
        turn += 1
        # Leaders of slices meet again, as long as that leaves clearly fewer of them.
        leaders = last.where("leads").join(large.select("key"), "key", "left_semi").select("key", F.col("a").alias("id"), "size", "sketch")
        before = large.withColumnRenamed("n", "before")
        counts = materialize(leaders.groupBy("key").agg(F.count("*").alias("n")).join(before, "key").where(F.col("n") <= SHRINK * F.col("before")).select("key", "n"))
        some = counts.count()
        if some:
            leaders = leaders.join(counts.select("key"), "key", "left_semi")
            last = materialize(_in_groups(_sliced(leaders, counts, turn), _leader_pairs(percent)))
            pairs = pairs.union(last.where("key IS NULL").select("a", "b"))
            large = counts.where(F.col("n") > SLICE)
            some = large.count()
    return pairs, members


def _sliced(rows: DataFrame, counts: DataFrame, turn: int) -> DataFrame:
    slices = F.ceil(F.col("n") / SLICE)
    return rows.join(counts, "key").select("key", F.pmod(F.xxhash64("id", F.lit(turn)), slices).alias("part"), (slices > 1).alias("sliced"), "id", "size", "sketch")


def _compressor(batches):
    for batch in batches:
        texts = [squeeze((t or "").encode()) for t in _values(batch.column("text"))]
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(texts, pa.binary())], ["id", "packed"])


def _verifier(words: int, percent: int):
    def run(batches):
        shingle, last, own = Shingler(words), None, np.zeros(0, np.uint64)
        for batch in batches:
            a, b = [], []
            for x, y, left, right in zip(*(_values(batch.column(c)) for c in ("a", "b", "left", "right"))):
                if left != last:
                    last, own = left, shingle(expand(left).decode())
                other = shingle(expand(right).decode())
                common = len(np.intersect1d(own, other, assume_unique=True))
                if 100 * common >= percent * (len(own) + len(other) - common):
                    a.append(x)
                    b.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def _confirm(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Pairs whose full sets are similar enough. Texts travel compressed; a's set is built once a run of a."""
    left = pairs.join(texts.select(F.col("id").alias("b"), F.col("packed").alias("right")).hint("merge"), "b")
    both = left.join(texts.select(F.col("id").alias("a"), F.col("packed").alias("left")).hint("merge"), "a")
    return both.select("a", "b", "left", "right").sortWithinPartitions("a").mapInArrow(_verifier(words, percent), "a long, b long")


#: Documents of a cluster that meet in one half of a tile.
TILE = 128
#: Shingles laid out at a time while a tile counts what its documents share.
COLUMNS = 1 << 15


def _tile_links(words: int, percent: int):
    """Links between documents of different components in a tile, by exact counts of shared shingles."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        shingle = Shingler(words)
        side, comp, ids = table["side"].to_numpy(), table["component"].to_numpy(), table["id"].to_numpy()
        sets = [shingle(expand(t).decode()) for t in table["packed"].to_pylist()]
        left = np.flatnonzero(side == 0)
        right = np.flatnonzero(side == 1) if (side == 1).any() else left
        sizes = np.array([len(x) for x in sets])
        names, where = np.unique(np.concatenate(sets), return_inverse=True)
        owner = np.repeat(np.arange(len(sets)), sizes)
        order = np.argsort(where, kind="stable")
        where, owner = where[order], owner[order]
        common = np.zeros((len(left), len(right)), np.float64)
        for low in range(0, len(names), COLUMNS):
            i, j = np.searchsorted(where, [low, low + COLUMNS])
            has = np.zeros((len(sets), min(COLUMNS, len(names) - low)), np.float32)
            has[owner[i:j], where[i:j] - low] = 1
            common += has[left] @ has[right].T
        union = sizes[left, None] + sizes[right][None, :] - common
        x, y = np.nonzero((100 * common >= percent * union) & (comp[left, None] != comp[right][None, :]))
        return pa.table({"a": pa.array(ids[left[x]], pa.int64()), "b": pa.array(ids[right[y]], pa.int64())})

    return run


def _tiles(rows: DataFrame, group: str, chunk: int) -> DataFrame:
    """rows (group, id, component, ...) by tile: the columns key (the tile), side and those of rows.

    Rows of a group are cut into chunks of about `chunk`: of one component, where that has as many,
    or of several small ones. Each pair of chunks is a tile, with side 0 and 1, and a chunk of
    several components is one with itself; two chunks of the same component make none, and a group
    of one component none at all. A row comes once for each tile of its chunk.
    """
    sizes = rows.groupBy(group, "component").agg(F.count("*").alias("n"))
    large = F.col("n") >= chunk
    small = F.sum(F.when(large, 0).otherwise(F.col("n")))
    pooled = sizes.groupBy(group).agg(F.greatest(F.lit(1), F.ceil(small / chunk)).alias("pool"), (F.min("component") < F.max("component")).alias("mixed")).where("mixed")
    plan = sizes.join(pooled.select(group, "pool"), group).select(group, "component", large.alias("own"), F.when(large, F.ceil(F.col("n") / chunk)).otherwise(F.col("pool")).alias("parts"))
    plan = plan.withColumn("home", F.when(F.col("own"), F.col("component")).otherwise(F.lit(0)))
    chunks = plan.select(group, "own", "home", "parts").distinct().withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("parts")
    names = ("own", "home", "part")
    a, b = (chunks.select(group, *[F.col(c).alias(f"{c}{k}") for c in names]) for k in (1, 2))
    order = [F.struct(*[F.col(f"{c}{k}") for c in names]) for k in (1, 2)]
    apart = ~(F.col("own1") & F.col("own2") & (F.col("home1") == F.col("home2")))
    met = materialize(a.join(b, group).where((order[0] <= order[1]) & apart).withColumn("key", F.monotonically_increasing_id()))
    salt = F.when(F.col("own"), F.xxhash64("id")).otherwise(F.xxhash64("component"))
    placed = rows.join(plan, [group, "component"]).withColumn("part", F.pmod(salt, F.col("parts")))
    sides = []
    for k in (1, 2):
        tiles = met.where(order[0] < order[1]) if k == 2 else met
        sides.append(placed.join(tiles.select(group, "key", *[F.col(f"{c}{k}").alias(c) for c in names]), [group, *names]).select("key", F.lit(k - 1).alias("side"), *[c for c in rows.columns if c != group]))
    return sides[0].union(sides[1])


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row.

    Words are runs of non-white-space, A-Z lower-cased; shingles are `words` words, or the whole
    sequence of a shorter text. Documents with 100 * intersection >= percent * union are linked.
    Rows without text or words have n_shingles 0 and are their own component. Rows that share an
    id are one node. A null id links with nothing: its component is null and kept is true. Ids are
    integers; other columns are ignored, whatever their names.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = materialize(signatures(source, words))
    worded = rows.where("n_shingles > 0 AND doc_id IS NOT NULL")
    # A class is named by the smallest id that has its set. Two sets of one id can be two classes of one name.
    classes = materialize(worded.groupBy("f1", "f2").agg(F.min("doc_id").alias("id"), F.min("n_shingles").alias("size"), F.min_by("bands", "doc_id").alias("bands"), F.min_by("sketch", "doc_id").alias("sketch")))
    # Copies take the component of their class; classes that hold texts of one id are linked by it.
    several = worded.groupBy("doc_id").agg(*[f(c).alias(f"{n}{c}") for c in ("f1", "f2") for n, f in (("low", F.min), ("high", F.max))]).where("lowf1 < highf1 OR lowf2 < highf2")
    member = worded.join(several.select("doc_id"), "doc_id", "left_semi").join(classes.select("f1", "f2", "id"), ["f1", "f2"])
    same = member.groupBy("doc_id").agg(F.min("id").alias("low")).join(member.select("doc_id", "id"), "doc_id").where("id > low").select(F.col("id").alias("a"), F.col("low").alias("b"))

    led, open_rows = _led(classes.select(F.explode("bands").alias("key"), "id", "size", "sketch"), percent)
    first = materialize(led.distinct())
    texts = _texts(source, _ends(first))
    links = materialize(_confirm(first, texts, words, percent))
    labels = materialize(connected_components(links.union(same)))

    known = open_rows.select("key", F.col("a").alias("id"), "size", "sketch").join(labels.withColumnRenamed("node", "id"), "id", "left")
    known = materialize(known.withColumn("component", F.coalesce("component", "id")).withColumnRenamed("key", "bucket"))
    tiles = _tiles(known, "bucket", SLICE).withColumn("part", F.lit(0).cast("long"))
    forest = _in_groups(tiles, _open_forest(percent)).select("a", "b").distinct()
    clusters = connected_components(forest).toDF("id", "cluster").join(labels.withColumnRenamed("node", "id"), "id", "left")
    clusters = materialize(clusters.withColumn("component", F.coalesce("component", "id")))
    texts = texts.union(_texts(source, clusters.select("id").join(_ends(first), "id", "left_anti")))
    tiles = _tiles(clusters, "cluster", TILE).join(texts.hint("merge"), "id").groupBy("key")
    more = materialize(tiles.applyInArrow(_tile_links(words, percent), "a long, b long"))
    final = connected_components(labels.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b")).union(more))
    # One class a row: by the fingerprint, or by the id for rows without words whose id has texts.
    named = classes.select("f1", "f2", "id").join(final.withColumnRenamed("node", "id"), "id", "left").select("f1", "f2", F.coalesce("component", "id").alias("component"))
    some = rows.where("n_shingles > 0 AND doc_id IS NOT NULL").join(named, ["f1", "f2"]).select("doc_id", "n_shingles", "component")
    bare = rows.where("n_shingles = 0 OR doc_id IS NULL").select("doc_id", "n_shingles")
    bare = bare.join(some.groupBy("doc_id").agg(F.min("component").alias("component")), "doc_id", "left")
    component = F.coalesce("component", "doc_id")
    out = some.union(bare.select("doc_id", "n_shingles", "component"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()


def _texts(source: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, packed): the compressed texts of documents that are in a pair, written once."""
    # Always by a shuffle: the ids grow with the corpus.
    return materialize(source.join(ids.hint("merge"), source["doc_id"] == ids["id"], "left_semi").select(F.col("doc_id").alias("id"), "text").mapInArrow(_compressor, "id long, packed binary"))
