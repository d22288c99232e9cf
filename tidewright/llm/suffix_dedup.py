"""Removal of byte strings that occur before: transforms of shards over sampled suffixes, merged by interleave refinement.

A suffix is sampled where the window of 100 bytes that begins in front of it has its minimizer: of the 80 substrings of
21 bytes of a window the one of least hash, the first of equal ones. Equal windows have it at the same place, so equal
windows meet at equal anchors, and one suffix in forty is enough to find all of them. An anchor that occurs once can't be
in a repeated interval and ends there.

The shards are a task's chunks of the other suffixes. A shard sorts its own: their order, the common prefix of each with
the one before, and the bytes in front of each (what a Burrows-Wheeler transform has one of, here up to 79) are its
transform. Transforms are merged for ranges of anchors, all shards of a range at once: the interleave begins with one
interval for each anchor, in which the shards follow each other, and is refined by eight bytes at a round. Only
intervals that hold several shards are refined, and in them each shard's part is in order already, so shards are merged
and no suffix is sorted anew; inside an interval of one shard, order and common prefixes are those of the shard. The
round in which neighbours of two shards part gives their common prefix. Then the intervals are refined backwards, by
the symbol in front, one at a round; rows alone in their interval leave. A window of a bytes in front of the anchor and
100 - a from it on is repeated where two rows share the interval of a symbols and that of a common prefix of 100 - a.

An anchor with too many surroundings for one task is split, see halves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BYTE_CODES, _powers, binary, drop, keeps, mix, parts, settle, stored, tidy, tune, utf8

#: Bytes of a match, of an anchor, and anchors of a window.
LENGTH, ANCHOR = 100, 21
WINDOW = LENGTH - ANCHOR + 1
#: Rows that are merged together at most; anchors with more are split. Suffixes of a shard.
TOGETHER, SHARD = 100_000, 20_000
#: Bytes in which anchors are looked for at once.
SLICE = 512 << 10
_INDEX_BITS = np.uint64(28)
#: Bits of a place's two distances that say that the anchor is repeated for sure, or stands for its task's others.
SURE, SENT = 1 << 7, 1 << 15
#: Anchors and surroundings that a task remembers; beyond it starts anew, which only moves more rows.
MOST_KNOWN = 200_000


def anchors(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
    """anchors_of in slices: a long text needs no more memory than many short ones. A minimizer whose windows begin in
    two slices gives two rows."""
    if len(data) <= SLICE:
        return anchors_of(data, off)
    out = []
    for a in range(0, len(data), SLICE):
        b = min(len(data), a + SLICE + LENGTH - 1)
        first, last = int(np.searchsorted(off, a, side="right")) - 1, int(np.searchsorted(off, b, side="left"))
        inner = np.clip(off[first : last + 1], a, b) - a
        text, pos, h, near, far = anchors_of(data[a:b], inner)
        out.append((text + first, pos + np.maximum(a - off[text + first], 0), h, near, far))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def anchors_of(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of texts in one buffer: text, position in it, hash, least and greatest distance of the windows that begin before.

    Windows of one minimizer begin at consecutive positions, so two distances name them.
    """
    n = len(data)
    none = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.uint64, np.int64, np.int64))
    if n < LENGTH:
        return none
    up, down = _powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(BYTE_CODES[data] * up[:n], out=sums[1:])
    h = mix((sums[ANCHOR:] - sums[:-ANCHOR]) * down[: n - ANCHOR + 1])
    lengths = np.diff(off)
    # windows that lie in one text
    begins = np.arange(n - LENGTH + 1)
    left = np.repeat(off[1:], lengths)[: n - LENGTH + 1] - begins
    begins = begins[left >= LENGTH]
    if not len(begins):
        return none
    index = np.uint64((1 << int(_INDEX_BITS)) - 1)
    m = (h & ~index) | np.arange(len(h), dtype=np.uint64)
    step = 1
    while 2 * step <= WINDOW:
        m = np.minimum(m[:-step], m[step:])
        step *= 2
    if WINDOW > step:
        m = np.minimum(m[: len(m) - (WINDOW - step)], m[WINDOW - step :])
    at = (m[begins] & index).astype(np.int64)
    change = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    last = np.concatenate([change[1:] - 1, [len(at) - 1]])
    pos, low, high = at[change], begins[change], begins[last]
    text = np.searchsorted(off, low, side="right") - 1
    return text, pos - off[text], h[pos], pos - high, pos - low


def slices(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """data[start:end] of all, one after the other, and their offsets."""
    n = ends - starts
    off = np.concatenate([[0], np.cumsum(n)])
    return data[np.arange(off[-1]) + np.repeat(starts - off[:-1], n)], off


def common_prefixes(block: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the rows by block, then bytes (big-endian words), and the common prefix of each with the one before
    (-1 at the first row of a block). Rounds of one word refine only blocks that still hold several rows."""
    n = len(block)
    order = np.argsort(block, kind="stable")
    lcp = np.full(n, words.shape[1] * 8, np.int64)
    lcp[0] = -1
    lcp[1:][block[order][1:] != block[order][:-1]] = -1
    for k in range(words.shape[1]):
        start = lcp < words.shape[1] * 8
        ident = np.cumsum(start)
        several = np.bincount(ident)[ident] > 1
        active = np.flatnonzero(several)
        if not len(active):
            break
        w = words[order[active], k]
        inner = np.lexsort((w, ident[active]))
        order[active] = order[active][inner]
        w, b = w[inner], ident[active]
        split = np.flatnonzero((b[1:] == b[:-1]) & (w[1:] != w[:-1]))
        differ = w[split + 1] ^ w[split]
        lead = np.zeros(len(differ), np.int64)
        for byte in range(8):
            lead += (differ >> np.uint64(8 * (7 - byte))) == 0
        lcp[active[split + 1]] = 8 * k + lead
    return order, lcp


def right_words(context: np.ndarray, off: np.ndarray, near: np.ndarray, far: np.ndarray) -> np.ndarray:
    """Of each row the bytes from its anchor to its nearest window's end, as big-endian words, zeros behind."""
    padded = np.concatenate([context, np.zeros(LENGTH + 8, np.uint8)])
    width = -(-LENGTH // 8) * 8
    right = padded[(off[:-1] + far)[:, None] + np.arange(width)]
    right[np.arange(width) >= (LENGTH - near)[:, None]] = 0
    return right.view(">u8").astype(np.uint64)


def interleave(group: np.ndarray, words: np.ndarray, shard: np.ndarray, nth: np.ndarray, shard_lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merges shards: the order of all rows by group, then words, and the common prefix of each with the one before (-1
    at the first row of a group). nth and shard_lcp are a row's place in its shard and its common prefix with the row
    before it there."""
    n, most = len(group), words.shape[1] * 8
    order = np.lexsort((nth, shard, group))
    lcp = np.full(n, most, np.int64)
    lcp[0] = -1
    lcp[1:][group[order][1:] != group[order][:-1]] = -1
    for k in range(words.shape[1] + 1):
        start = lcp < most
        ident = np.cumsum(start) - 1
        of = shard[order]
        mixed = np.zeros(int(ident[-1]) + 1, bool)
        mixed[ident[1:][(ident[1:] == ident[:-1]) & (of[1:] != of[:-1])]] = True
        mixed = mixed[ident]
        alone = np.flatnonzero(~mixed & ~start)
        lcp[alone] = shard_lcp[order[alone]]
        active = np.flatnonzero(mixed)
        if not len(active) or k == words.shape[1]:
            break
        w = words[order[active], k]
        inner = np.lexsort((w, ident[active]))  # stable, so that the parts of a shard stay in order
        order[active] = order[active][inner]
        w, b = w[inner], ident[active]
        split = np.flatnonzero((b[1:] == b[:-1]) & (w[1:] != w[:-1]))
        differ = w[split + 1] ^ w[split]
        lead = np.zeros(len(differ), np.int64)
        for byte in range(8):
            lead += (differ >> np.uint64(8 * (7 - byte))) == 0
        lcp[active[split + 1]] = 8 * k + lead
    return order, lcp


def repeated(group: np.ndarray, context: np.ndarray, off: np.ndarray, near: np.ndarray, far: np.ndarray, shard: np.ndarray, nth: np.ndarray, shard_lcp: np.ndarray) -> np.ndarray:
    """rows x WINDOW: whether the window that begins a bytes before the anchor occurs in an earlier row.

    Rows are in the order of the texts. context holds each row's bytes from its farthest window's begin to its nearest
    window's end.
    """
    n = len(group)
    out = np.zeros((n, WINDOW), bool)
    if n < 2:
        return out
    order, lcp = interleave(group, right_words(context, off, near, far), shard, nth, shard_lcp)
    at = off[:-1] + far
    # symbols in front, one at a round
    block_of = np.unique(group, return_inverse=True)[1].astype(np.int64)
    active = np.arange(n)
    right_class = np.empty(n, np.int64)
    for a in range(WINDOW):
        if a:
            active = active[far[active] >= a]
            if not len(active):
                break
            _, new, count = np.unique(block_of[active] * 256 + context[at[active] - a], return_inverse=True, return_counts=True)
            several = count[new] > 1
            active = active[several]
            block_of[active] = new[several]
        rows = active[near[active] <= a]
        if len(rows) < 2:
            continue
        right_class[order] = np.cumsum(lcp < LENGTH - a)
        key = right_class[rows] * (n + 1) + block_of[rows]
        sort = np.argsort(key, kind="stable")
        key = key[sort]
        out[rows[sort[1:][key[1:] == key[:-1]]], a] = True
    return out


ROW = "h long, ord long, at long, context binary, shard long, nth int, lcp int"


def halves(rows: DataFrame) -> DataFrame:
    """Splits anchors: rows with (low, high), the windows that meet at h, to rows of their lower and their upper half.

    All windows that begin low to high bytes before an anchor hold the low bytes in front of it and 100 - high from it
    on; so the halves of equal windows meet at the hash of those, which tell more surroundings apart than the anchor
    does. A row goes to both halves at most, with what its windows there need. In the end a window meets only equal ones.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for h, ord_, at, context, low, high in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
                near, far, pos, middle = at >> 8 & 255, at & 255, at >> 16, (low + high) // 2
                for first, last in ((low, middle), (middle + 1, high)):
                    n, f = max(near, first), min(far, last)
                    if n <= f:
                        part = context[far - f : far - n + LENGTH]
                        key = hashlib.blake2b(h.to_bytes(8, "little", signed=True) + bytes((first, last)) + part[f - first : f + LENGTH - last], digest_size=8).digest()
                        out.append((int.from_bytes(key, "little", signed=True), ord_, pos << 16 | n << 8 | f, part, first, last))
            if out:
                cols = list(zip(*out, strict=True))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["h", "ord", "at", "context", "low", "high"])

    return rows.select("h", "ord", "at", "context", "low", "high").mapInArrow(each, "h long, ord long, at long, context binary, low int, high int")


def split_hot(found: DataFrame) -> tuple[DataFrame, DataFrame | None, list[str]]:
    """Rows whose anchors fit a task, and the covers (ord, a, b) of windows that have been split to the end."""
    spark = found.sparkSession
    rows = found.withColumn("low", F.lit(0)).withColumn("high", F.lit(WINDOW - 1))
    # after a split the rows of a shard are not neighbours any more: each is a shard of its own
    alone = {"shard": F.monotonically_increasing_id(), "nth": F.lit(0), "lcp": F.lit(-1)}
    small: DataFrame | None = None
    covers: DataFrame | None = None
    made: list[str] = []
    while True:
        rows, path = stored(rows, "halves")
        made.append(path)
        large, path = stored(rows.where("context is not null").groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("high") - F.col("low")).alias("width")).where(F.col("n") > TOGETHER), "hot")
        made.append(path)
        fitting = rows.join(large.select("h"), "h", "left_anti")
        fitting = fitting.select("h", "ord", "at", "context", "shard", "nth", "lcp")
        small = fitting if small is None else small.unionByName(fitting)
        # windows that are all equal: each but the earliest is repeated
        equal = rows.where("context is not null").join(large.where("width = 0").select("h"), "h").select("h", "ord", (F.shiftright("at", 16) - F.col("low")).alias("a"))
        first = equal.groupBy("h").agg(F.min(F.struct("ord", "a")).alias("first"))
        later = equal.join(first, "h").where(F.struct("ord", "a") > F.col("first")).select("ord", "a", (F.col("a") + LENGTH).alias("b"))
        covers = later if covers is None else covers.unionByName(later)
        if not large.where("width > 0").limit(1).count():
            return small, covers, made
        rows = halves(rows.where("context is not null").join(large.where("width > 0").select("h"), "h"))
        rows = rows.withColumns(alone).select("h", "ord", "at", "context", "shard", "nth", "lcp", "low", "high")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and spans (removed, from and to byte).

    Removed is each byte that a string of 100 bytes covers which also begins earlier: in a text of smaller id, or
    earlier in the same one. Texts count as UTF-8, null as empty; matches don't cross texts; a text of fewer bytes
    keeps all. If ids repeat or are null, texts are ordered by id (null first), then by content, and repeated rows stay
    rows of their own. Other columns are ignored. An empty table gives no rows.
    What travels: 24 bytes for one byte in 40, the texts twice to be matched with places, and up to 179 bytes around
    each anchor that occurs more than once. Anchors and surroundings that repeat inside a task are taken together before
    they travel, so copies and common passages don't pile up at one anchor; an anchor that still has more than TOGETHER
    places is split by its surroundings.
    """
    spark = tune(docs.sparkSession)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ties = base.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or doc_id is null")
    if ties.limit(1).count():
        rows = base.withColumn("tie", F.md5("text")).repartitionByRange(parts(spark), F.col("doc_id").asc_nulls_first(), "tie")
        base, _ = stored(rows.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "tie").select(F.monotonically_increasing_id().alias("ord"), "doc_id", "text"), "ordered")
    else:
        base = base.select(F.col("doc_id").alias("ord"), "doc_id", "text")

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Anchors that a task has met before are repeated for sure: they are marked and needn't meet any others. One
        of each goes to those of the other tasks."""
        keeps()
        known = np.zeros(0, np.uint64)
        for b in batches:
            text, pos, h, near, far = anchors(*utf8(b.column(1)))
            ords, at = b.column(0).to_numpy(), pos << 16 | near << 8 | far
            order = np.argsort(h, kind="stable")
            again = np.zeros(len(h), bool)
            again[order[1:]] = h[order[1:]] == h[order[:-1]]
            met = np.unique(h[again])
            if len(known):
                again |= known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h
            first = ~again & np.isin(h, met)
            at[again] |= SURE
            at[first] |= SENT
            known = np.union1d(known if len(known) < MOST_KNOWN else known[:0], met)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(ords[text]), pa.array(at)], names=["h", "ord", "at"])
        tidy()

    def several(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by h; those whose h stands alone go."""
        held: list[np.ndarray] | None = None  # the last row, which was not given yet
        before = None
        for b in batches:
            cols = [b.column(i).to_numpy() for i in range(3)]
            h = cols[0]
            if not len(h):
                continue
            keep = cols[2] & (SURE | SENT) != 0
            same = h[1:] == h[:-1]
            keep[1:] |= same
            keep[:-1] |= same
            if before is not None and h[0] == before:
                keep[0] = True
                if held is not None:
                    cols, keep = [np.concatenate(x) for x in zip(held, cols, strict=True)], np.concatenate([[True], keep])
            before = h[-1]
            held = None if keep[-1] else [c[-1:] for c in cols]
            if keep.any():
                yield pa.RecordBatch.from_arrays([pa.array(cols[0][keep]), pa.array(cols[1][keep]), pa.array(cols[2][keep] & ~(SURE | SENT))], names=["h", "ord", "at"])
        tidy()

    sampled = base.select("ord", "text").mapInArrow(sample, "h long, ord long, at long")
    alone = F.when(F.col("at").bitwiseAND(SURE) != 0, F.xxhash64("ord", "at")).otherwise(F.col("h"))
    sampled = sampled.repartition(parts(spark), alone).sortWithinPartitions("h").mapInArrow(several, "h long, ord long, at long")
    places, _ = stored(sampled.groupBy("ord").agg(F.collect_list(F.struct("h", "at")).alias("places")), "anchors", free=True)
    del sampled
    settle(spark)  # the shuffles of what is stored now are not needed any more
    hot = places.select(F.explode("places.h").alias("h")).groupBy("h").count().where(F.col("count") > TOGETHER).limit(1).count()

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The transforms of the task's shards: what is around each anchor, by anchor and the bytes from it on. Texts come
        in order, so of equal surroundings in a task the first is the earliest: all windows of the others are repeated,
        and they leave as places (a, b) instead, without surroundings."""
        keeps()
        seen: set[tuple[int, bytes]] = set()
        shard = TaskContext.get().partitionId() << 32
        for b in batches:
            data, off = utf8(b.column(1))
            lists = b.column(2)
            n = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten()
            h, at = flat.field(0).to_numpy(), flat.field(1).to_numpy()
            text = np.repeat(np.arange(len(n)), n)
            order = np.lexsort((at, text))
            h, at, text = h[order], at[order], text[order]
            ords = b.column(0).to_numpy()[text]
            pos = (at >> 16) + off[text]
            for i in range(0, len(at), SHARD):
                k = slice(i, i + SHARD)
                begin, end = pos[k] - (at[k] & 255), pos[k] - (at[k] >> 8 & 255) + LENGTH
                bytes_, o = slices(data, begin, end)
                whole, edges = bytes_.tobytes(), o.tolist()
                if len(seen) > MOST_KNOWN:
                    seen.clear()
                keys = zip((at[k] & 0xFFFF).tolist(), (whole[x:y] for x, y in zip(edges, edges[1:], strict=False)), strict=True)
                new = np.array([x not in seen and not seen.add(x) for x in keys], bool)
                bytes_, o = slices(bytes_, o[:-1][new], o[1:][new])
                if new.any():
                    mine, places_ = h[k][new], at[k][new]
                    sort, lcp = common_prefixes(mine, right_words(bytes_, o, places_ >> 8 & 255, places_ & 255))
                    bytes_, o = slices(bytes_, o[:-1][sort], o[1:][sort])
                    ctx = binary(bytes_, o)
                    yield pa.RecordBatch.from_arrays([pa.array(mine[sort]), pa.array(ords[k][new][sort]), pa.array(places_[sort]), ctx, pa.array(np.full(len(sort), shard)), pa.array(np.arange(len(sort), dtype=np.int32)), pa.array(lcp.astype(np.int32))], names=names)
                    shard += 1
                if not new.all():
                    t, x, y, r = text[k][~new], (begin - off[text[k]])[~new], (end - off[text[k]])[~new], ords[k][~new]
                    # runs of places that touch, each text for itself
                    starts = np.concatenate([[True], (t[1:] != t[:-1]) | (x[1:] > np.maximum.accumulate(y + t * (1 << 40))[:-1] - t[1:] * (1 << 40))])
                    x, r, y = x[starts], r[starts], np.maximum.reduceat(y, np.flatnonzero(starts))
                    yield pa.RecordBatch.from_arrays([pa.array(mix((r * 31 + x).view(np.uint64)).view(np.int64)), pa.array(r), pa.array(x << 31 | y), pa.nulls(len(r), pa.binary()), *(pa.nulls(len(r), t) for t in (pa.int64(), pa.int32(), pa.int32()))], names=names)
        tidy()

    names = ["h", "ord", "at", "context", "shard", "nth", "lcp"]
    near_text = base.select("ord", "text").join(places, "ord").sortWithinPartitions("ord")
    found, split, made = near_text.mapInArrow(contexts, ROW), None, []
    if hot:
        found, split, made = split_hot(found)
    found = found.repartition(parts(spark), "h").sortWithinPartitions("h", "shard", "nth")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solved(t: pa.Table) -> pa.RecordBatch:
            t = t.combine_chunks()
            t = t.take(pa.array(np.lexsort((t.column("at").to_numpy(), t.column("ord").to_numpy(), t.column("h").to_numpy()))))
            at = t.column("at").to_numpy()
            near, far, pos = at >> 8 & 255, at & 255, at >> 16
            rem = repeated(t.column("h").to_numpy(), *utf8(t.column("context")), near, far, *(t.column(c).to_numpy() for c in ("shard", "nth", "lcp")))
            edge = np.diff(np.pad(rem, ((0, 0), (1, 1))).astype(np.int8), axis=1)
            row, low = np.nonzero(edge == 1)
            _, high = np.nonzero(edge == -1)
            return pa.RecordBatch.from_arrays([pa.array(t.column("ord").to_numpy()[row]), pa.array(pos[row] - (high - 1)), pa.array(pos[row] - low + LENGTH)], names=["ord", "a", "b"])

        waiting: list[pa.RecordBatch] = []
        n = 0
        for b in batches:
            if b.column(3).null_count:
                at = b.column(2).to_numpy()
                place = b.column(3).is_null().to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([pa.array(b.column(1).to_numpy()[place]), pa.array(at[place] >> 31), pa.array(at[place] & ((1 << 31) - 1))], names=["ord", "a", "b"])
                b = b.filter(pa.array(~place))
            waiting.append(b)
            n += b.num_rows
            if n >= TOGETHER:
                t = pa.Table.from_batches(waiting)
                h = t.column("h").to_numpy()
                cut = int(np.searchsorted(h, h[-1]))
                if cut:
                    yield solved(t.slice(0, cut))
                    waiting, n = t.slice(cut).to_batches(), len(h) - cut
        if n:
            yield solved(pa.Table.from_batches(waiting))
        waiting = []
        tidy()

    merged = found.mapInArrow(merge, "ord long, a long, b long")
    if split is not None:
        merged = merged.unionByName(split)
    covers, _ = stored(merged.groupBy("ord").agg(F.collect_list(F.struct("a", "b")).alias("covers")), "repeats", free=True)
    drop(spark, *made)
    del found, merged, split, near_text
    settle(spark)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("spans", pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())])))])
        for b in batches:
            data, off = utf8(b.column(1))
            data = data.tobytes()
            rows = []
            for i, (doc_id, pairs) in enumerate(zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True)):
                text = data[off[i] : off[i + 1]]
                spans: list[list[int]] = []
                for s, e in sorted((p["a"], p["b"]) for p in pairs or ()):
                    if spans and s <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], e)
                    else:
                        spans.append([s, e])
                h, last = hashlib.sha256(), 0
                for s, e in spans:
                    h.update(text[last:s])
                    last = e
                h.update(text[last:])
                rows.append((doc_id, len(text), sum(e - s for s, e in spans), len(spans), h.hexdigest(), [{"from": s, "to": e} for s, e in spans]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), out, strict=True)], schema=out)

    whole = base.join(covers, "ord", "left").select("doc_id", "text", "covers")
    return whole.mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<from:bigint,to:bigint>>")
