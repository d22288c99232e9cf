"""Best-fit packing of token sequences into bins of several permitted lengths."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keeps, tidy, tune
from .tokens import encoder_of

#: Permitted sequence lengths in tokens; cost of a bin beside its length; pieces that are packed together.
SIZES, OVERHEAD, WINDOW = (512, 1024, 2048, 4096), 64, 32_768


def classes(sizes: tuple[int, ...]) -> list[int]:
    """Upper ends of the classes of lengths that open bins of one size: each permitted size and its middle to the one below."""
    return sorted({x for low, s in zip((0, *sizes), sizes, strict=False) for x in ((low + s) // 2, s) if x > low})


def best_fit(lengths: list[int], sizes: tuple[int, ...], opening: dict[int, int]) -> tuple[list[int], list[int], list[int], list[int]]:
    """Packs pieces of 1 to max(sizes) tokens: bin and offset of each piece, then final size and used tokens of each bin.

    Longest first (ties in order), each piece goes to the open bin with the least room that holds it, else to a new bin
    of the size that opening has for its class. At the end each bin shrinks to the smallest permitted size that holds
    its contents.
    """
    ends = sorted(opening)
    bins, offsets = [0] * len(lengths), [0] * len(lengths)
    room: dict[int, list[int]] = {}
    mask, used = 0, []  # bit r of mask: some bin has room r
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        n = lengths[i]
        fitting = mask >> n
        if fitting:
            left = n + (fitting & -fitting).bit_length() - 1
            k = room[left].pop()
            if not room[left]:
                mask ^= 1 << left
        else:
            k, left = len(used), opening[ends[bisect_left(ends, n)]]
            used.append(0)
        bins[i], offsets[i] = k, used[k]
        used[k] += n
        if left > n:
            room.setdefault(left - n, []).append(k)
            mask |= 1 << (left - n)
    return bins, offsets, [min(s for s in sizes if s >= u) for u in used], used


def cost_of(ordered: list[int], sizes: tuple[int, ...], opening: dict[int, int], overhead: int) -> int:
    """What best_fit's bins cost, lengths in descending order: overhead and final size of each bin."""
    ends = sorted(opening)
    room: dict[int, list[int]] = {}  # by room, the opening sizes of the bins that have it
    mask, cost = 0, 0
    for n in ordered:
        fitting = mask >> n
        if fitting:
            left = n + (fitting & -fitting).bit_length() - 1
            size = room[left].pop()
            if not room[left]:
                mask ^= 1 << left
        else:
            size = left = opening[ends[bisect_left(ends, n)]]
        if left > n:
            room.setdefault(left - n, []).append(size)
            mask |= 1 << (left - n)
        else:
            cost += overhead + size
    for left, opened in room.items():
        for size in opened:
            cost += overhead + sizes[bisect_left(sizes, size - left)]
    return cost


def opening_sizes(lengths: list[int], sizes: tuple[int, ...] = SIZES, overhead: int = OVERHEAD) -> dict[int, int]:
    """The size that a new bin gets, for each class of lengths, chosen for all classes together.

    The cost is that of the whole packing of these lengths. From the better of two plans (always the largest size; the
    smallest that fits) on, one class at a time takes the size that makes the packing cheapest, until none changes. So
    no plan of one class exchanged is cheaper, and neither of the two is.
    """
    ordered, every = sorted(lengths, reverse=True), classes(sizes)
    ends = sorted({every[bisect_left(every, n)] for n in lengths})
    known: dict[tuple[int, ...], int] = {}

    def cost(plan: tuple[int, ...]) -> int:
        if plan not in known:
            known[plan] = cost_of(ordered, sizes, dict(zip(ends, plan, strict=True)), overhead)
        return known[plan]

    plan = min((tuple(sizes[-1] for _ in ends), tuple(sizes[bisect_left(sizes, e)] for e in ends)), key=cost)
    while True:
        before = plan
        for i, e in enumerate(ends):
            plan = min(((*plan[:i], s, *plan[i + 1 :]) for s in sizes if s >= e), key=lambda p: (cost(p), p != plan))
        if plan == before:
            return dict(zip(ends, plan, strict=True))


def pack(docs: DataFrame, tokenizer: str, sizes: tuple[int, ...] = SIZES, overhead: int = OVERHEAD, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per piece: bin_id, bin_size, bin_used, bin_offset, doc_id, piece, piece_start, n_tokens.

    A document's tokens (end id included) are cut into pieces of the largest size and one rest. The pieces are packed,
    and the sizes that bins open with chosen for all lengths together (opening_sizes), in windows of consecutive rows of a partition, whose order is that of the input: no shuffle, no hot key, memory for
    one window of lengths. Bins are numbered along that order: by partition, window and their first piece; inside a
    window a bin may also hold later pieces. A window is the same when its task is run again, and so are its bin ids. Every token of
    every row is in exactly one piece; null and empty texts have one token, the end id; long texts have many pieces;
    repeated rows and ids are packed each. Other columns are ignored. An empty table gives no rows.
    """
    if not sizes or min(sizes) < 1:
        raise ValueError("sizes are whole numbers of 1 or more")
    tune(docs.sparkSession)
    largest, permitted = max(sizes), tuple(sorted(set(sizes)))
    fields = [("bin_id", pa.int64()), ("bin_size", pa.int32()), ("bin_used", pa.int32()), ("bin_offset", pa.int32()), ("doc_id", pa.int64()), ("piece", pa.int32()), ("piece_start", pa.int64()), ("n_tokens", pa.int32())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keeps("tokens")
        encoder, first = encoder_of(tokenizer), TaskContext.get().partitionId() << 40
        width, pieces = encoder.width.itemsize, []

        def packed(pieces):
            nonlocal first
            lengths = [p[3] for p in pieces]
            bins, offsets, final, used = best_fit(lengths, permitted, opening_sizes(lengths, permitted, overhead))
            nth = {k: i for i, k in enumerate(dict.fromkeys(bins))}
            rows = sorted(((first + nth[k], final[k], used[k], o, *p) for k, o, p in zip(bins, offsets, pieces, strict=True)), key=lambda r: (r[0], r[3]))
            first += len(final)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), fields, strict=True)], schema=pa.schema(fields))

        for b in batches:
            for doc_id, ids in zip(b.column(0).to_pylist(), encoder.encode(b.column(1).to_pylist()), strict=True):
                n = len(ids) // width + 1
                for k, start in enumerate(range(0, n, largest)):
                    pieces.append((doc_id, k, start, min(largest, n - start)))
                    if len(pieces) == window:
                        yield packed(pieces)
                        pieces = []
        if pieces:
            yield packed(pieces)
        del pieces
        tidy()

    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col))
    return rows.mapInArrow(run, "bin_id long, bin_size int, bin_used int, bin_offset int, doc_id long, piece int, piece_start long, n_tokens int")
