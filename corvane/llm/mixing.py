"""Mixing sources to target weights by min-cost flow.

Documents may belong to several sources. They are summed by membership pattern (the set of
sources) and by a seeded hash bucket; the flow routes the capacity of patterns to the quotas of
sources, where each further repetition of a pattern costs more (convex), so that the mix repeats
as little as it can. Only these sums reach the driver: their number depends on the patterns, not
on the documents, and is checked (MAX_PATTERNS). Documents are then taken whole. The long ones of a
pattern are taken where their hash falls in the share that is wanted; the short ones then fill up
in seeded order what is missing, so the mix misses a target by half a short document. Which are
short follows from the sums by length: as few as can still make up for the long ones (_walk). Only the
bucket at the cut is sorted, so a source with a third of all rows meets in no single task.
"""

from __future__ import annotations

import json
from collections import deque

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm._common import materialize, packed_row

#: Times that a document can be taken at most.
MAX_REPEATS = 3
#: Weights of the sources in order of their code points, null last; repeated as often as needed.
WEIGHTS = (1, 2, 3)
#: Hex digits of the seeded hash that name a bucket: 4,096 buckets a pattern.
BUCKET_DIGITS = 3
BUCKETS = 16**BUCKET_DIGITS
#: Bits of the longest document's size.
LONGEST = 62
#: The plan has a row a pattern; up to so many it is sent to all tasks, so that no pattern is a hot key.
BROADCAST_PATTERNS = 20_000
#: Patterns that the flow takes; more are an error, as the driver holds one sum for each.
MAX_PATTERNS = 1_000_000


def targets(sizes: dict[str | None, int], weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS, total: int | None = None) -> dict[str | None, float]:
    """Share of all words that each source should get.

    Shares follow the weights; a target stops at max_repeats times its source's size, and the
    excess goes to the others by weight until none is above. Empty sources get 0. total: all
    words, where documents belong to several sources; else the sum of the sizes.
    """
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode("utf-32-be")) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    cap = {s: max_repeats * sizes[s] for s in names}
    total, free, full = sum(sizes.values()) if total is None else total, list(names), []
    while free:
        level = (total - sum(cap[s] for s in full)) / sum(weight[s] for s in free)
        above = [s for s in free if level * weight[s] > cap[s]]
        if not above:
            return {s: float(cap[s]) for s in full} | {s: level * weight[s] for s in free}
        full += above
        free = [s for s in free if s not in above]
    return {s: float(cap[s]) for s in full}


class _Net:
    """Arcs in pairs (i, i ^ 1): an arc and its way back."""

    def __init__(self, nodes: int):
        self.out: list[list[int]] = [[] for _ in range(nodes)]
        self.to: list[int] = []
        self.room: list[int] = []

    def join(self, a: int, b: int, room: int) -> int:
        self.out[a].append(len(self.to))
        self.out[b].append(len(self.to) + 1)
        self.to += [b, a]
        self.room += [room, 0]
        return len(self.to) - 2

    def _levels(self, sink: int) -> list[int]:
        level = [-1] * len(self.out)
        level[0] = 0
        queue = deque([0])
        while queue:
            u = queue.popleft()
            for e in self.out[u]:
                if self.room[e] and level[self.to[e]] < 0:
                    level[self.to[e]] = level[u] + 1
                    queue.append(self.to[e])
        return level if level[sink] >= 0 else []

    def fill(self, sink: int) -> None:
        """Push as much as fits from node 0 to the sink, shortest paths first."""
        while level := self._levels(sink):
            tried = [0] * len(self.out)
            path: list[int] = []
            u = 0
            while True:
                if u == sink:
                    step = min(self.room[e] for e in path)
                    for e in path:
                        self.room[e] -= step
                        self.room[e ^ 1] += step
                    # Go back to before the first arc that is full now.
                    full = next(i for i, e in enumerate(path) if not self.room[e])
                    u = self.to[path[full] ^ 1]
                    del path[full:]
                    continue
                while tried[u] < len(self.out[u]):
                    e = self.out[u][tried[u]]
                    if self.room[e] and level[self.to[e]] == level[u] + 1:
                        break
                    tried[u] += 1
                else:
                    if not path:
                        break
                    u = self.to[path.pop() ^ 1]
                    tried[u] += 1
                    continue
                path.append(e)
                u = self.to[e]


def route(patterns: list[tuple[tuple[str | None, ...], int]], quotas: dict[str | None, int], max_repeats: int = MAX_REPEATS) -> list[dict[str | None, int]]:
    """Words of each pattern that go to each source, at least cost; one dict a pattern.

    The k-th taking of a pattern costs 2k - 2 a word, so a pattern is repeated only once all others
    that can help have been used as often. Only the arc into a pattern costs anything, so a
    cheapest path is one whose pattern has been taken least: the flow is filled up one taking at a
    time, and no filled arc is ever given back.
    """
    sources = list(quotas)
    node = {s: 1 + len(patterns) + i for i, s in enumerate(sources)}
    sink = 1 + len(patterns) + len(sources)
    net = _Net(sink + 1)
    entry = [net.join(0, 1 + i, 0) for i in range(len(patterns))]
    way = [{s: net.join(1 + i, node[s], max_repeats * size) for s in members} for i, (members, size) in enumerate(patterns)]
    for s in sources:
        net.join(node[s], sink, quotas[s])
    for _ in range(max_repeats):
        for e, (_, size) in zip(entry, patterns):
            net.room[e] += size
        net.fill(sink)
    return [{s: net.room[e ^ 1] for s, e in own.items()} for own in way]


def _walk(lengths: dict[int, int], share: dict[int, int], rest: int) -> tuple[int, int, int, int]:
    """Which documents make up rest words: (short, left, in the share, all), by bits of their size.

    lengths and share: words of each length, of all documents and of those in the share. From the
    longest down, a length gives its share, nothing or all, as long as the shorter ones can give
    what is then missing. Where none of these will do, its documents and the shorter ones are
    short: they give the words left in order of the hash. A length of few documents may also give
    nothing or all if that misses by less than a quarter of its documents' size.
    """
    in_share = whole = 0
    below = sum(lengths.values())
    for bits in range(LONGEST, -1, -1):
        words, part = lengths.get(bits, 0), share.get(bits, 0)
        below -= words
        if 0 <= rest - part <= below:
            in_share |= 1 << bits
            rest -= part
        elif rest <= below:
            pass
        elif rest >= words:
            whole |= 1 << bits
            rest -= words
        elif rest - below <= words - rest and 4 * (rest - below) <= 1 << bits:
            rest = below
        elif 4 * (words - rest) <= 1 << bits:
            whole |= 1 << bits
            rest = 0
        else:
            return bits, rest, in_share, whole
    return -1, 0, in_share, whole


#: Columns that mix() adds.
ADDED = ("_size", "_source_size", "_target", "_repeats", "_taken")


def mix(docs: DataFrame, members: Column, size: Column, key: str = "doc_id", seed: str = "mix", weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS, tie: Column | None = None) -> DataFrame:
    """Add to each document how often the mix takes it: _size, _source_size, _target, _repeats, _taken.

    members: array<string> of the sources of a row; a null or empty array counts as the null
    source. size: its words (null: 0). _source_size and _target sum over its sources. Rows of size
    0 take part but carry no words. Repeated rows are separate documents. Reruns agree: the order
    hangs on the seed, the key and the size alone, then on tie (none), which says which of several
    rows of one key and size comes first. The sums are written to the shared folder. Every row comes out once; input columns
    of the five names are replaced, all others may bear any name. Keys may be of any type.
    """
    spark = docs.sparkSession
    own = F.array_sort(F.array_distinct(F.when(F.coalesce(F.size(members), F.lit(0)) > 0, members).otherwise(F.array(F.lit(None).cast("string")))))
    # Null keys and null members must meet in joins, so a pattern is named by its JSON.
    named = docs.select(
        packed_row(docs, ADDED),
        F.coalesce(size, F.lit(0)).cast("long").alias("_size"),
        F.to_json(F.struct(own.alias("p")), {"ignoreNullFields": "false"}).alias("pattern"),
        F.col(key).alias("key"),
        (F.lit(0) if tie is None else tie).alias("tie"),
        F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col(key).cast("string"), F.lit("null")), F.coalesce(size, F.lit(0)).cast("long").cast("string"))).alias("hash"),
    )
    # Documents by length: the bits of their size, 0 for empty ones.
    bits = F.when(F.col("_size") > 0, F.length(F.bin("_size"))).otherwise(0)
    bucket = F.conv(F.substring("hash", 1, BUCKET_DIGITS), 16, 10).cast("int")
    named = named.withColumns({"bits": bits, "bucket": bucket})
    # A sum for each pattern, length and bucket: all that is planned reads these.
    sums = materialize(named.groupBy("pattern", "bits", "bucket").agg(F.sum("_size").alias("words")), spark)
    if (found := sums.select("pattern").distinct().limit(MAX_PATTERNS + 1).count()) > MAX_PATTERNS:
        raise ValueError(f"{found} patterns of sources or more; the flow takes {MAX_PATTERNS}")
    lengths: dict[str, dict[int, int]] = {}
    for r in sums.groupBy("pattern", "bits").agg(F.sum("words").alias("words")).collect():
        lengths.setdefault(r["pattern"], {})[r["bits"]] = r["words"]
    names = sorted(lengths)
    patterns = [(tuple(json.loads(p)["p"]), sum(lengths[p].values())) for p in names]
    sizes: dict[str | None, int] = {}
    for own_sources, words in patterns:
        for s in own_sources:
            sizes[s] = sizes.get(s, 0) + words
    scale = targets(sizes, weights, max_repeats, sum(words for _, words in patterns))
    flows = route(patterns, {s: int(t + 0.5) for s, t in scale.items()}, max_repeats)
    whole, rest = {}, {}
    for p, (_, words), flow in zip(names, patterns, flows):
        taken = sum(flow.values())
        whole[p] = min(max_repeats, taken // words) if words else 0
        rest[p] = taken - whole[p] * words
    share = {p: rest[p] * BUCKETS // words if words else 0 for p, (_, words) in zip(names, patterns)}

    def planned(rows: list[tuple], columns: str) -> DataFrame:
        made = spark.createDataFrame(rows, columns)
        return F.broadcast(made) if len(rows) <= BROADCAST_PATTERNS else made

    shares = planned([*share.items()], "pattern string, share int")
    long: dict[str, dict[int, int]] = {}
    for r in sums.join(shares, "pattern").where(F.col("bucket") < F.col("share")).groupBy("pattern", "bits").agg(F.sum("words").alias("words")).collect():
        long.setdefault(r["pattern"], {})[r["bits"]] = r["words"]
    plan = []
    for p, (own_sources, _) in zip(names, patterns):
        plan.append((p, sum(sizes[s] for s in own_sources), float(sum(scale[s] for s in own_sources)), whole[p], share[p], *_walk(lengths[p], long.get(p, {}), rest[p])))
    columns = "pattern string, _source_size long, _target double, whole int, share int, short int, left long, in_share long, every long"
    order = Window.partitionBy("pattern").orderBy("bucket")
    cuts = (
        sums.join(planned([(r[0], r[5], r[6]) for r in plan], "pattern string, short int, left long"), "pattern")
        .where(F.col("bits") <= F.col("short"))
        .groupBy("pattern", "bucket", "left")
        .agg(F.sum("words").alias("words"))
        .withColumn("before", F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("words"))
        .where((F.col("before") <= F.col("left")) & (F.col("left") > 0))
        .groupBy("pattern")
        .agg(F.max(F.struct("bucket", (F.col("left") - F.col("before")).alias("left"))).alias("cut"))
    )
    plan_df = spark.createDataFrame(plan, columns).drop("left").join(cuts, "pattern", "left").select("*", F.col("cut.bucket").alias("edge"), F.col("cut.left").alias("left")).drop("cut")
    placed = named.join(F.broadcast(plan_df) if len(plan) <= BROADCAST_PATTERNS else plan_df, "pattern")
    inside = (F.col("bits") <= F.col("short")) & F.coalesce(F.col("bucket") == F.col("edge"), F.lit(False))
    at_edge = placed.where(inside)
    before = F.sum("_size").over(Window.partitionBy("pattern").orderBy("hash", "key", "_size", "tie").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_size")
    long_ones = (F.getbit("every", F.col("bits")) == 1) | ((F.getbit("in_share", F.col("bits")) == 1) & (F.col("bucket") < F.col("share")))
    more = F.when(F.col("bits") > F.col("short"), long_ones).otherwise(F.coalesce(F.col("bucket") < F.col("edge"), F.lit(False)))
    chosen = placed.where(~inside).withColumn("more", more)
    # The document at the cut is taken if that brings the source nearer to its target.
    chosen = chosen.unionByName(at_edge.withColumn("more", 2 * before + F.col("_size") <= 2 * F.col("left")))
    repeats = F.col("whole") + F.col("more").cast("int")
    return chosen.select("row.*", "_size", "_source_size", "_target", repeats.alias("_repeats"), (repeats * F.col("_size")).alias("_taken"))
