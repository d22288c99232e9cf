"""N-gram Jaccard join as a join in a metric space: Voronoi regions around pivots, windows of the triangle inequality.

The distance of two documents is 1 - Jaccard similarity of their sets of word shingles. Unrelated documents are at
distance 1 from any document, so the first level takes sets of one shingle as pivots: the region of a pivot holds the
documents with that shingle. A document's pivots stand in one global order (by the number of documents that have them,
rare ones first) and it is replicated to the regions of its first ones only: a partner at distance 0.2 or less misses
at most a fifth of the shingles, so it is in one of these regions too, and its size is within a fifth. A shingle of a
single document has an empty region besides, so documents with a fifth of such shingles leave at once. Regions that
share documents are joined to one. Inside, documents are pivots of balls of radius 0.2; a document at distance d > 0.2
from a pivot can only be linked with members of that ball at distance d - 0.2 or more, and with none if d > 0.4.

A region too large for one task is split again and again until its regions fit, see split_by_documents (Voronoi regions
of pivots that are documents, whose dense cores are linked at once) and split_by_shingles (pivots of one shingle more,
for regions whose documents are so far from each other that no document is near a pivot).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop, keeps, mix, parts, settle, span_hashes, stored, tidy, tune, utf8

#: Words of a shingle; similarity in percent.
SHINGLE, PERCENT = 5, 80
#: Sets that a task remembers as seen; blocks of documents for each shuffle partition.
MOST_SEEN, BLOCKS = 200_000, 4

#: Sets and bytes of a region that one task joins; larger ones are split. Pivots that are documents, in a split.
REGION_SETS, REGION_BYTES, PIVOTS = 20_000, 64 << 20, 8
#: Documents beyond this distance from all pivots have a region of their own.
FAR = 0.4
#: Bytes that are hashed at once.
SLICE = 512 << 10

_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_STEP = [np.uint64(x) for x in (0x9FB21C651E98DF25, 0xD6E8FEB86659FD93)]


def shingle_sets(data: np.ndarray, off: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the distinct shingles of each text, with the offsets of the texts; ascending in each text.

    Words are runs of bytes outside space and 9 to 13, A-Z lower-cased. With fewer words than k the whole sequence is
    the one shingle; without words there is none.
    """
    n = len(off) - 1
    word = ~_BLANK[data]
    starts, ends = word.copy(), word.copy()
    starts[1:] &= ~word[:-1]
    ends[:-1] &= ~word[1:]
    inner = off[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    starts[inner] |= word[inner]
    ends[inner - 1] |= word[inner - 1]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    h = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):  # in slices, so that a long text needs no more memory than many short ones
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + SLICE, side="right")))
        a, b = starts[i], ends[j - 1]
        h[i:j] = span_hashes(_LOWER[data[a:b]], starts[i:j] - a, ends[i:j] - a)
        i = j
    doc = np.searchsorted(off, starts, side="right") - 1
    per_doc = np.bincount(doc, minlength=n)
    first = np.concatenate([[0], np.cumsum(per_doc)[:-1]])
    x = h.copy()
    for j in range(1, min(k, len(h))):
        x[: len(h) - j] = mix(x[: len(h) - j] * _STEP[0] + h[j:] + np.uint64(j))
    full = np.flatnonzero(doc[: len(h) - k + 1] == doc[k - 1 :]) if len(h) >= k else np.zeros(0, np.int64)
    owner, value = doc[full], x[full]
    short = np.flatnonzero((per_doc > 0) & (per_doc < k))
    if len(short):
        y = h[first[short]] * _STEP[1]
        for j in range(1, k - 1):
            more = per_doc[short] > j
            y[more] = mix(y[more] * _STEP[1] + h[first[short[more]] + j] + np.uint64(j))
        owner, value = np.concatenate([owner, short]), np.concatenate([value, mix(y + per_doc[short].astype(np.uint64))])
    order = np.argsort(value)
    order = order[np.argsort(owner[order].astype(np.uint16 if n < 1 << 16 else np.int64), kind="stable")]
    owner, value = owner[order], value[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    sizes = np.bincount(owner[new], minlength=n)
    return value[new], np.concatenate([[0], np.cumsum(sizes)])


def signatures(values: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits for each set, as two signed longs."""
    out = []
    for salt in (0x8EBC6AF09C88C6E3, 0x589965CC75374CC3):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(values * np.uint64(salt) + np.uint64(salt >> 7)))])
        out.append(mix(sums[off[1:]] - sums[off[:-1]] + np.diff(off).astype(np.uint64) * np.uint64(salt)).view(np.int64))
    return out[0], out[1]


def overlap_size(n: np.ndarray | int, percent: int = PERCENT):
    """So many shingles at least has a set of n in common with any at the similarity or above."""
    return (n * percent + 99) // 100


def prefix_size(n: np.ndarray | int, percent: int = PERCENT):
    """So many first pivots of a set of n shingles hold one of any set at the similarity or above."""
    return n - overlap_size(n, percent) + 1


def in_order(values: np.ndarray, off: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Where each set's shingles stand in the global order: by rank, then by hash."""
    owner = np.repeat(np.arange(len(off) - 1), np.diff(off))
    return np.argsort(owner * 256 + rank, kind="stable")


def to_blob(hashes: np.ndarray, beside: bytes = b"") -> bytes:
    """Ascending 32-bit numbers as differences of two bytes (four if one is larger), and what goes beside them."""
    step = np.diff(hashes.astype(np.int64), prepend=hashes[:1].astype(np.int64))
    wide = len(step) and int(step.max()) > 0xFFFF
    head = np.array([len(hashes), hashes[0] if len(hashes) else 0, bool(wide)], "<u4").tobytes()
    return head + step.astype("<u4" if wide else "<u2").tobytes() + beside


def from_blob(blob: bytes) -> tuple[np.ndarray, bytes]:
    n, first, wide = np.frombuffer(blob, "<u4", 3)
    kind = np.dtype("<u4" if wide else "<u2")
    step = np.frombuffer(blob, kind, n, 12)
    return (np.cumsum(step, dtype=np.int64) + first).astype(np.uint32), blob[12 + int(n) * kind.itemsize :]


def to_counts(hashes: np.ndarray) -> bytes:
    """Ascending numbers, repeated ones as one with its count: places and counts of those go beside the numbers."""
    found, n = np.unique(hashes, return_counts=True)
    more = np.flatnonzero(n > 1)
    return to_blob(found, np.stack([more, n[more]]).astype("<u4").tobytes())


def from_counts(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    found, beside = from_blob(blob)
    at, n = np.frombuffer(beside, "<u4").reshape(2, -1)
    counts = np.ones(len(found), np.int64)
    counts[at] = n
    return found, counts


def ranks_of(short: np.ndarray, known: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """Ranks of shingles by the upper half of their hashes; 0: in one set only."""
    if not len(known) or not len(short):
        return np.zeros(len(short), np.int64)
    at = np.minimum(np.searchsorted(known, short), len(known) - 1)
    return np.where(known[at] == short, ranks[at], 0).astype(np.int64)


def stars(pairs: dict) -> dict[int, int]:
    """Links (keys of pairs) to node: least node of its component, for all nodes but these."""
    up: dict[int, int] = {}

    def find(x: int) -> int:
        while (y := up.setdefault(x, x)) != x:
            up[x] = x = up.setdefault(y, y)
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return {x: r for x in list(up) if (r := find(x)) != x}


def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's links (a, b) as stars, each node once. The memory goes with the task's distinct nodes."""
    met: dict[tuple[int, int], None] = {}
    most = 500_000
    for b in batches:
        met.update(dict.fromkeys(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)))
        if len(met) > most:
            met = dict.fromkeys(stars(met).items())
            most = max(most, 2 * len(met))
    out = stars(met)
    yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.int64()), pa.array(list(out.values()), pa.int64())], names=["a", "b"])
    tidy()


def components(edges: DataFrame) -> DataFrame:
    """(a, b) links to (node, root), root the least node of its component; nodes without a link have no row.

    Each task contracts its links to stars first, so a hub has few links left. Then in rounds: a node keeps the least
    node that it is linked with, its other ones are linked with that one instead (a pre-aggregated minimum for each
    node), and each node goes on to what its own least one keeps. That last join has the stars of hubs on one side and
    each node once on the other, both plain stored tables, so adaptive execution splits a hub over tasks. Each round
    is written to the shared folder; nothing but counts comes to the driver.
    """
    spark = edges.sparkSession
    ordered = edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    now, path = stored(ordered.mapInArrow(contract, "a long, b long").distinct(), "links")
    while True:
        kept, kept_path = stored(now.groupBy("a").agg(F.min("b").alias("least"), F.count(F.lit(1)).alias("n")), "kept")
        several, on = kept.where("n > 1"), kept.select(F.col("a").alias("least"), F.col("least").alias("next"))
        jumped, jumped_path = stored(kept.select("a", "least").join(on, "least", "left").select("a", F.coalesce("next", "least").alias("b"), F.col("next").isNotNull().alias("moved")), "jumped")
        open_ = several.limit(1).count() or jumped.where("moved").limit(1).count()
        if not open_:
            drop(spark, path, kept_path)
            break
        hooked = now.join(several.select("a", "least"), "a").where("b != least").select(F.greatest("b", "least").alias("a"), F.least("b", "least").alias("b"))
        both = jumped.select("a", "b").unionByName(hooked).mapInArrow(contract, "a long, b long").distinct()
        after, after_path = stored(both, "links")
        drop(spark, path, kept_path, jumped_path)
        now, path = after, after_path
    return jumped.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(jumped.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


class Union:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.find(i), self.find(j)
        if i != j:
            self.up[max(i, j)] = min(i, j)


def shared(pivot: np.ndarray, values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """How many of the pivot's shingles each of the sets has."""
    if not len(values):
        return np.zeros(len(off) - 1, np.int64)
    hit = pivot[np.minimum(np.searchsorted(pivot, values), len(pivot) - 1)] == values
    return np.add.reduceat(hit, off[:-1], dtype=np.int64)


def join_region(sets: list[np.ndarray], pivots: list[np.ndarray], percent: int = PERCENT) -> list[int]:
    """Component numbers of sorted, distinct, non-empty sets whose first pivots are given; exact.

    The first set of a ball is its pivot. A set meets those balls that hold one of its first pivots: within the
    radius it joins the first and links to all; within twice the radius it is compared with the ball's members in the
    window of the triangle inequality until one links; beyond that none can.
    """
    radius = 1 - percent / 100
    union = Union(len(sets))
    balls: list[tuple[int, list[int], list[float]]] = []  # pivot, members, their distances from it
    of_shingle: dict[int, int | list[int]] = {}  # a ball, or several
    for y in sorted(range(len(sets)), key=lambda i: (len(sets[i]), i)):
        met: set[int] = set()
        own = pivots[y].tolist()
        for s in own:
            known = of_shingle.get(s)
            if type(known) is int:
                met.add(known)
            elif known:
                met.update(known)
        home = None
        for k in sorted(met):
            p, members, distance = balls[k]
            n = int(shared(sets[p], sets[y], np.array([0, len(sets[y])]))[0])
            both = len(sets[p]) + len(sets[y]) - n
            d = 1 - n / both
            if 100 * n >= percent * both:
                union.join(p, y)
                if home is None:
                    home = k
                    members.append(y)
                    distance.append(d)
            elif d <= 2 * radius + 1e-9 and union.find(p) != union.find(y):
                near = [x for x, e in zip(members, distance, strict=True) if e >= d - radius - 1e-9 and 100 * len(sets[x]) >= percent * len(sets[y])]
                for i in range(0, len(near), 256):
                    some = near[i : i + 256]
                    sizes = np.array([len(sets[x]) for x in some])
                    n = shared(sets[y], np.concatenate([sets[x] for x in some]), np.concatenate([[0], np.cumsum(sizes)]))
                    if (100 * n >= percent * (sizes + len(sets[y]) - n)).any():
                        union.join(p, y)
                        break
        if home is None:
            home = len(balls)
            balls.append((y, [y], [0.0]))
        for s in own:
            known = of_shingle.setdefault(s, home)
            if type(known) is list:
                if home not in known:
                    known.append(home)
            elif known != home:
                of_shingle[s] = [known, home]
    return [union.find(i) for i in range(len(sets))]


def solve(percent: int):
    """A function for mapInArrow over rows (region, id, set, low, depth) by region: links (a, b) of each id with the least
    one of its component in the region."""

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solved(group: list) -> pa.RecordBatch:
            ordered = [np.frombuffer(r[2], np.uint64) for r in group]
            pivots = [x[r[3] : len(x) - overlap_size(len(x), percent) + r[4]] for x, r in zip(ordered, group, strict=True)]
            # sets that may have nothing in common but the region's own shingles meet by the region itself
            pivots = [np.append(p, np.uint64(0)) if r[4] > overlap_size(len(x), percent) else p for p, x, r in zip(pivots, ordered, group, strict=True)]
            comp = join_region([np.sort(x) for x in ordered], pivots, percent)
            least: dict[int, int] = {}
            for c, r in zip(comp, group, strict=True):
                least[c] = min(least.get(c, r[1]), r[1])
            out = [(r[1], least[c]) for c, r in zip(comp, group, strict=True) if r[1] != least[c]]
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in range(2)], names=["a", "b"])

        group: list = []
        for b in batches:
            for r in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                if group and group[0][0] != r[0]:
                    if len(group) > 1:
                        yield solved(group)
                    group = []
                group.append(r)
        if len(group) > 1:
            yield solved(group)
        del group
        tidy()

    return links


MEMBERS = "region long, id long, set binary, low int, depth int"


def split_by_documents(rows: DataFrame, turn: int, percent: int = PERCENT) -> tuple[DataFrame, DataFrame, list[str]]:
    """Voronoi regions of PIVOTS documents for each region of rows; (parts with column `outside`, links, paths made).

    Every document is measured against the pivots of its region, in slices of it. With r = 0.2 the radius of links, d
    the distance from a pivot and n that from the nearest one: a document is at home with its nearest pivot, or in the
    far region if n > FAR. It is replicated to the regions of pivots at d <= min(n + 2r, FAR + r) and to the far region
    if n > FAR - r; by the triangle inequality two linked documents then meet in the home of one of them. Documents
    at d <= r are a pivot's core: they are linked with it and need not meet each other. Of a core only what may be
    linked with others goes on: its members at d >= m - r, m being the least distance of a document outside the core.
    So tight groups of any size vanish.
    """
    spark = rows.sparkSession
    n_parts, r, eps, slack = parts(spark), 1 - percent / 100, 1e-9, 1e-8
    order = Window.partitionBy("region").orderBy(F.desc("outside"), F.xxhash64("id", F.lit(turn)), "id")
    first = rows.groupBy("region").agg(F.max("parts").alias("parts")).join(
        # the pivots: few rows for each task and region go to the window
        rows.groupBy("region", F.pmod(F.xxhash64("id", F.lit(turn)), F.lit(64 * PIVOTS)).alias("_s")).agg(F.max(F.struct("outside", "id")).alias("_m")).select("region", "_m.outside", "_m.id").withColumn("k", F.row_number().over(order)).where(F.col("k") <= PIVOTS),
        "region",
    )
    pivots, pivots_path = stored(rows.select("region", "id", "set").join(first, ["region", "id"]), "pivots")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Slices come with their pivots first (kind 0, in order), then their members: the distances of each."""
        at, own = None, []
        for b in batches:
            region, part, kind = (b.column(i).to_pylist() for i in range(3))
            distances, taken = [], []
            for i in range(b.num_rows):
                if (region[i], part[i]) != at:
                    at, own = (region[i], part[i]), []
                x = np.sort(np.frombuffer(b.column(4)[i].as_py(), np.uint64))
                if kind[i] == 0:
                    own.append(x)
                    continue
                n = [int(shared(p, x, np.array([0, len(x)]))[0]) for p in own]
                both = [len(p) + len(x) - k for p, k in zip(own, n, strict=True)]
                # links are told in whole numbers: what is linked is within the radius also after rounding
                distances.append([min(1 - k / m, r) if 100 * k >= percent * m else max(1 - k / m, r + eps) for k, m in zip(n, both, strict=True)])
                taken.append(i)
            if taken:
                take = pa.array(taken)
                yield pa.RecordBatch.from_arrays([b.column(0).take(take), *(b.column(i).take(take) for i in (3, 4, 5, 6)), pa.array(distances, pa.list_(pa.float64()))], names=["region", "id", "set", "low", "depth", "d"])
        tidy()

    sent = pivots.select("region", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("kind"), "id", "set", F.lit(0).alias("low"), F.lit(0).alias("depth"), "k")
    asked = rows.select("region", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("kind"), "id", "set", "low", "depth", F.lit(0).alias("k"))
    both = sent.unionByName(asked).repartition(n_parts, "region", "part").sortWithinPartitions("region", "part", "kind", "k")
    measured, measured_path = stored(both.drop("k").mapInArrow(measure, f"{MEMBERS}, d array<double>"), "measured")
    core = measured.select("region", "id", F.posexplode("d").alias("k", "x")).where(F.col("x") <= r).withColumn("k", F.col("k") + 1)
    links = core.join(pivots.select("region", "k", F.col("id").alias("pivot")), ["region", "k"]).where("id != pivot").select(F.col("id").alias("a"), F.col("pivot").alias("b"))
    nearest = measured.groupBy("region").agg(F.array(*[F.min(F.when(F.get("d", F.lit(k)) > r, F.get("d", F.lit(k)))) for k in range(PIVOTS)]).alias("others"))
    placed = measured.join(nearest, "region").withColumn("near", F.array_min("d")).where("near > 0")  # pivots have met all
    homes = F.expr(
        f"array_append(filter(transform(d, (x, k) -> if(x <= least(near + {2 * r + slack}D, {FAR + r + slack}D)"
        f" and (x > {r}D or coalesce(x >= others[k] - {r + slack}D, false)), k, null)), k -> k is not null), if(near > {FAR - r - slack}D, -1, null))"
    )
    parts_of = placed.select("region", "id", "set", "low", "depth", "near", F.explode(homes).alias("home")).where("home is not null")
    out = parts_of.select(F.xxhash64("region", "home", F.lit(turn)).alias("region"), "id", "set", "low", "depth", (F.col("near") > r).alias("outside"), F.col("region").alias("of"))
    return out, links, [pivots_path, measured_path]


def split_by_shingles(rows: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Regions of one shingle more: of two linked sets the first k common shingles, in the global order, stand among the
    first n - overlap + k of each (n its size, overlap the least number of common ones). So a set whose region has
    pivots of k shingles already goes to a region for each later one of its first n - overlap + k + 1. Sets whose k
    shingles may be all that they have in common with another meet in one region more."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            region, ids, sets, low, depth = (b.column(i).to_pylist() for i in range(5))
            for i in range(b.num_rows):
                x = np.frombuffer(sets[i], np.uint64)
                at = np.arange(low[i], min(len(x), len(x) - overlap_size(len(x), percent) + depth[i]))
                own = mix(np.array([region[i]], np.int64).view(np.uint64))
                new, after, deeper = mix(x[at] ^ own).view(np.int64), at + 1, np.full(len(at), depth[i] + 1)
                if depth[i] > overlap_size(len(x), percent):
                    new, after, deeper = np.append(new, own.view(np.int64)), np.append(after, low[i]), np.append(deeper, depth[i])
                for j in range(0, len(new), 256):
                    m = slice(j, j + 256)
                    k = len(new[m])
                    yield pa.RecordBatch.from_arrays([pa.array(new[m]), pa.array([ids[i]] * k, pa.int64()), pa.array([sets[i]] * k, pa.binary()), pa.array(after[m].astype(np.int32)), pa.array(deeper[m].astype(np.int32))], names=["region", "id", "set", "low", "depth"])

    return rows.select("region", "id", "set", "low", "depth").mapInArrow(each, MEMBERS).select("*", F.lit(True).alias("outside"), F.lit(None).cast("long").alias("of"))


def region_links(members: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(a, b) links between ids that connect the components of each region. members: (region, id, set, low), stored.

    A region that fits one task is joined there. Larger ones are split by documents; what is still more than half of
    the region that it came from is split by shingles next, and so on in turn until all regions fit. Both splits are
    exact: each linked pair is linked at once, or meets in one region at least. Every split by documents takes its
    pivots out, every split by shingles goes one shingle on, so it ends.
    """
    spark = members.sparkSession
    n_parts = parts(spark)
    columns = ["region", "id", "set", "low", "depth"]
    left = members.select("region", "id", "set", "low", F.lit(1).alias("depth"), F.lit(True).alias("outside"), F.lit(None).cast("long").alias("of"))
    links: DataFrame | None = None
    made: list[str] = []
    earlier: DataFrame | None = None
    turn = 0
    while True:
        sizes = left.groupBy("region").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("set")).alias("bytes"), F.min("of").alias("of"))
        large = sizes.where((F.col("n") > 1) & ((F.col("n") > REGION_SETS) | (F.col("bytes") > REGION_BYTES)))
        need = F.ceil(F.greatest(F.col("n") / (REGION_SETS / 4), F.col("bytes") / (REGION_BYTES / 4))).cast("int")
        if earlier is None:
            stuck = F.lit(False)
        else:
            large = large.join(earlier, "of", "left")
            stuck = F.coalesce(2 * F.col("n") > F.col("n_of"), F.lit(False))
        large, path = stored(large.select("region", "n", F.least(need, F.col("n")).cast("int").alias("parts"), stuck.alias("stuck")), "large")
        made.append(path)
        here = left.join(large.select("region"), "region", "left_anti").select(*columns).repartition(n_parts, "region").sortWithinPartitions("region", "id")
        found, _ = stored(here.mapInArrow(solve(percent), "a long, b long"), "region-links")
        links = found if links is None else links.unionByName(found)
        kinds = {r[0] for r in large.select("stuck").distinct().collect()}
        if not kinds:
            break
        rest, after = left.join(large.select("region", "parts", "stuck"), "region"), None
        if False in kinds:
            after, near, paths = split_by_documents(rest.where("not stuck"), turn, percent)
            near, _ = stored(near, "region-links")
            made += paths
            links = links.unionByName(near)
        if True in kinds:
            by_shingle = split_by_shingles(rest.where("stuck"), percent)
            after = by_shingle if after is None else after.unionByName(by_shingle)
        earlier = large.select(F.col("region").alias("of"), F.col("n").alias("n_of"))
        left, path = stored(after, "left")
        made.append(path)
        turn += 1
    drop(spark, *made)
    return links


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, k: int = SHINGLE) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id (the smallest id that it reaches over links).

    Texts with equal sets count as one (128-bit signature of the set); links between different sets are found exactly,
    all of them up to what the components need. Null or empty texts and those without words have no shingles and are
    linked with nothing: component_id is their own id. Null ids are ignored for the smallest id unless a component has
    no other. Other columns are ignored. An empty table gives no rows.
    What travels: texts twice (one of a task's equal sets) to blocks by the signature of their sets; two bytes for each
    distinct shingle of a block, to be counted by ranges of hashes, and three back for each that others have too; then the sets,
    and few pivots each, of texts four fifths of whose shingles occur elsewhere.
    """
    spark = tune(docs.sparkSession)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    n_parts = parts(spark)
    n_blocks = BLOCKS * n_parts

    def sets_of(b: pa.RecordBatch, column: int):
        values, off = shingle_sets(*utf8(b.column(column)), k)
        return values, off, *signatures(values, off)

    def to_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A block for each set; the text stays with the first of a task's equal sets only."""
        keeps()
        seen: set[tuple[int, int]] = set()
        for b in batches:
            values, off, s1, s2 = sets_of(b, 1)
            n = np.diff(off)
            if len(seen) > MOST_SEEN:
                seen.clear()
            new = np.array([size > 0 and x not in seen and not seen.add(x) for size, x in zip(n.tolist(), zip(s1.tolist(), s2.tolist(), strict=True), strict=True)], bool)
            text = pc.if_else(pa.array(new), b.column(1), pa.nulls(len(n), b.column(1).type))
            yield pa.RecordBatch.from_arrays([pa.array((s1.view(np.uint64) % np.uint64(n_blocks)).astype(np.int32)), b.column(0), pa.array(n.astype(np.int32)), pa.array(s1), pa.array(s2), text], names=["block", "doc_id", "n", "s1", "s2", "text"])
        tidy()

    placed = base.mapInArrow(to_blocks, "block int, doc_id long, n int, s1 long, s2 long, text string")

    def share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Passes the light rows on, and for each range of hashes the upper halves of the block's shingles and their counts."""
        names = ["doc_id", "n", "s1", "s2", "range", "block", "blob"]

        def blobs(block: int, found: list[np.ndarray]) -> pa.RecordBatch:
            h = np.sort(np.concatenate(found))
            edges = np.searchsorted(h, (np.arange(n_parts + 1) * (1 << 32) // n_parts).astype(np.uint64))
            out = [(i, to_counts(h[x:y])) for i, (x, y) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if y > x]
            none = pa.nulls(len(out), pa.int64())
            return pa.RecordBatch.from_arrays([none, pa.nulls(len(out), pa.int32()), none, none, pa.array([i for i, _ in out], pa.int32()), pa.array([block] * len(out), pa.int32()), pa.array([x for _, x in out], pa.binary())], names=names)

        block, found, seen = None, [], set()
        for b in batches:
            blocks = b.column(0).to_numpy()
            no = pa.nulls(b.num_rows, pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), b.column(3), b.column(4), no, no, pa.nulls(b.num_rows, pa.binary())], names=names)
            values, off, s1, s2 = sets_of(b, 5)
            short = (values >> np.uint64(32)).astype(np.uint32)
            for i in np.flatnonzero(np.diff(off)).tolist():
                if blocks[i] != block:
                    if found:
                        yield blobs(block, found)
                    block, found, seen = int(blocks[i]), [], set()
                if (x := (s1[i], s2[i])) not in seen:
                    seen.add(x)
                    found.append(short[off[i] : off[i + 1]])
        if found:
            yield blobs(block, found)
        tidy()

    # rows without their text only pass through, so they may go anywhere
    to = F.when(F.col("text").isNull(), F.xxhash64("doc_id", "s1")).otherwise(F.xxhash64("block"))
    sorted_blocks = placed.repartition(n_parts, to).sortWithinPartitions("block")
    told, told_path = stored(sorted_blocks.mapInArrow(share, "doc_id long, n int, s1 long, s2 long, range int, block int, blob binary"), "shares")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Counts the shingles of a range over all blocks and answers each block with its repeated ones and their ranks."""

        def answers(got: list[tuple[int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
            every = np.concatenate([x for _, x, _ in got])
            order = np.argsort(every)
            every = every[order]
            first = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
            n = np.add.reduceat(np.concatenate([c for *_, c in got])[order], first)
            h, rank = every[first][n > 1], np.minimum(255, 1 + (4 * np.log2(n[n > 1])).astype(np.int64))
            del every, order
            out = []
            for block, x, _ in got:
                r = ranks_of(x, h, rank)
                if r.any():
                    out.append((block, to_blob(x[r > 0], r[r > 0].astype(np.uint8).tobytes())))
            return pa.RecordBatch.from_arrays([pa.array([i for i, _ in out], pa.int32()), pa.array([x for _, x in out], pa.binary())], names=["block", "blob"])

        last, got = None, []
        for b in batches:
            for part, block, blob in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if part != last:
                    if got:
                        yield answers(got)
                    last, got = part, []
                got.append((block, *from_counts(blob)))
        if got:
            yield answers(got)
            del got
        tidy()

    shares = told.where("range is not null").select("range", "block", "blob").repartition(n_parts, "range").sortWithinPartitions("range")
    answered, answered_path = stored(shares.mapInArrow(count, "block int, blob binary"), "ranks")
    light, _ = stored(told.where("range is null").select("doc_id", "n", "s1", "s2"), "sets")
    del shares, told, sorted_blocks
    drop(spark, told_path)
    settle(spark)

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks come with their ranks first, then their texts: sets one of whose first pivots others have too, in the
        global order, and how many shingles at their begin nobody else has."""
        block, blobs, known, ranks, seen = None, [], None, None, set()
        for b in batches:
            blocks, is_text = b.column(0).to_numpy(), b.column(1).to_numpy()
            values, off, s1, s2 = sets_of(b, 3)
            rows = []
            cuts = [0, *(np.flatnonzero(blocks[1:] != blocks[:-1]) + 1).tolist(), len(blocks)]
            for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                if blocks[x] != block:
                    block, blobs, known, seen = int(blocks[x]), [], None, set()
                first_text = x + int(np.searchsorted(is_text[x:y], 1))
                if first_text > x:
                    blobs += b.column(4).slice(x, first_text - x).to_pylist()
                if first_text == y:
                    continue
                if known is None:
                    parts_ = sorted((from_blob(z) for z in blobs), key=lambda z: int(z[0][0]))
                    known = np.concatenate([z[0] for z in parts_]) if parts_ else np.zeros(0, np.uint32)
                    ranks = np.frombuffer(b"".join(z[1] for z in parts_), np.uint8)
                    blobs = []
                v, o = values[off[first_text] : off[y]], off[first_text : y + 1] - off[first_text]
                rank = ranks_of((v >> np.uint64(32)).astype(np.uint32), known, ranks)
                order = in_order(v, o, rank)
                size = np.diff(o)
                in_prefix = np.arange(len(v)) - np.repeat(o[:-1], size) < np.repeat(prefix_size(size, percent), size)
                alone = rank[order] == 0
                owner = np.repeat(np.arange(len(size)), size)
                low = np.bincount(owner[alone], minlength=len(size))
                for i in np.flatnonzero(np.bincount(owner[in_prefix & ~alone], minlength=len(size))).tolist():
                    j = first_text + i
                    if (z := (int(s1[j]), int(s2[j]))) not in seen:
                        seen.add(z)
                        rows.append((*z, v[order[o[i] : o[i + 1]]].tobytes(), int(low[i])))
            if rows:
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:2]), pa.array(cols[2], pa.binary()), pa.array(cols[3], pa.int32())], names=["s1", "s2", "set", "low"])
        tidy()

    texts = placed.where("text is not null").select("block", F.lit(1).alias("kind"), "doc_id", "text", F.lit(None).cast("binary").alias("blob"))
    ranked = answered.select("block", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"), "blob")
    both = texts.unionByName(ranked).repartition(n_parts, "block").sortWithinPartitions("block", "kind")
    made, made_path = stored(both.mapInArrow(candidates, "s1 long, s2 long, set binary, low int"), "candidates")
    del both, texts, ranked, placed, answered
    drop(spark, answered_path)
    settle(spark)

    def chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A task's rows of a pivot in order of size, as long as the next size is in reach, are linked here already; the
        regions then get one row for each such chain, with its sizes. Links travel beside, each by itself."""
        rows: list[tuple[np.ndarray, ...]] = []
        n = 0

        def packed():
            pivot, size, node = (np.concatenate(x) for x in zip(*rows, strict=True))
            order = np.lexsort((node, size, pivot))
            pivot, size, node = pivot[order], size[order], node[order]
            start = np.ones(len(pivot), bool)
            start[1:] = (pivot[1:] != pivot[:-1]) | (100 * size[:-1] < percent * size[1:])
            first = np.flatnonzero(start)
            head = node[first][np.cumsum(start) - 1]
            links = np.unique(np.stack([node, head], 1)[node != head], axis=0)
            last = np.append(first[1:] - 1, len(pivot) - 1)
            by = mix(links[:, 0].copy().view(np.uint64)).view(np.int64) if len(links) else np.zeros(0, np.int64)
            zero = np.zeros(len(links), np.int64)
            cols = [np.concatenate(x) for x in ((pivot[first], by), (size[first], zero), (size[last], zero), (node[first], links[:, 0]))]
            other = pa.concat_arrays([pa.nulls(len(first), pa.int64()), pa.array(links[:, 1], pa.int64())])
            return pa.RecordBatch.from_arrays([*map(pa.array, cols), other], names=["pivot", "low", "high", "node", "head"])

        for b in batches:
            sets = [np.frombuffer(x.as_buffer(), np.int64) for x in b.column(1)]
            first = [x[i : prefix_size(len(x), percent)] for x, i in zip(sets, b.column(2).to_pylist(), strict=True)]
            k = np.array([len(x) for x in first])
            rows.append((np.concatenate(first), np.repeat([len(x) for x in sets], k), np.repeat(b.column(0).to_numpy(), k)))
            n += int(k.sum())
            if n > 2_000_000:
                yield packed()
                rows, n = [], 0
        if n:
            yield packed()
        rows = []
        tidy()

    def overlapping(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows by pivot, then size: a region falls apart where the next size is out of reach; each part is a star."""
        last, head = None, None
        found: dict[tuple[int, int], None] = {}
        most = 500_000
        for b in batches:
            for pivot, low, high, node, to in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                if to is not None:
                    found[node, to] = None
                    continue
                if last is not None and last[0] == pivot and 100 * last[1] >= percent * low:
                    if node != head:
                        found[node, head] = None
                    high = max(high, last[1])
                else:
                    head = node
                last = pivot, high
            if len(found) > most:
                found = dict.fromkeys(stars(found).items())
                most = max(most, 2 * len(found))
        out = stars(found)
        yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.int64()), pa.array(list(out.values()), pa.int64())], names=["a", "b"])
        tidy()

    # texts of several blocks' tasks may bring an equal set twice
    sets = light.groupBy("s1", "s2").agg(F.min("doc_id").alias("least"), F.first("n").alias("n"))
    rows = made.select("s1", "set", "low").mapInArrow(chains, "pivot long, low long, high long, node long, head long")
    rows = rows.repartition(n_parts, "pivot").sortWithinPartitions("pivot", "low", "node")
    links, links_path = stored(rows.mapInArrow(overlapping, "a long, b long"), "links")
    regions, regions_path = stored(components(links), "regions")
    drop(spark, links_path)
    least = sets.select(F.col("s1").alias("_a"), F.col("s2").alias("_b"), "least")
    in_region = made.join(regions, made["s1"] == regions["node"]).join(least, (F.col("s1") == F.col("_a")) & (F.col("s2") == F.col("_b")))
    in_region = in_region.select(F.col("root").alias("region"), F.monotonically_increasing_id().alias("id"), "s1", "s2", F.col("least").alias("doc_id"), "set", "low")
    members, members_path = stored(in_region, "members")
    drop(spark, regions_path, made_path)
    settle(spark)
    joined, _ = stored(components(region_links(members, percent)), "components")
    named = members.select("id", "s1", "s2", "doc_id").join(joined.select(F.col("node").alias("id"), "root"), "id")
    smallest = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    joined, _ = stored(named.join(smallest, "root").select("s1", "s2", "component_id").dropDuplicates(["s1", "s2"]), "members")
    drop(spark, members_path)
    settle(spark)
    every = sets.select("s1", "s2", "least").join(joined, ["s1", "s2"], "left").select("s1", "s2", F.coalesce("component_id", "least").alias("component_id"))
    every, _ = stored(every, "classes")  # so that the join below is one of two plain shuffles, whose hot keys Spark splits
    out = light.join(every, ["s1", "s2"])
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
