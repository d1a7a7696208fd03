"""Variable-capacity best-fit packing of documents into training sequences."""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections import Counter

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from uipatterns.llm.common import by_value, n_words, spare

by_value(__name__)

CAPACITIES = (512, 1024, 2048, 4096)
#: What a sequence costs besides its length, in words: its share of batching and masks.
OPENING = 128
#: The length at which attention, which grows with the square of a sequence, costs as much as the rest of its words.
ATTENTION = 8192


def bin_costs(capacities: tuple[int, ...], opening: int, attention: int) -> dict[int, float]:
    return {c: c + opening + c * c / attention for c in sorted(capacities)}


def fill_of(room: int, values: list[int], counts: list[int]) -> int:
    """Words that go into ``room`` when the longest length that still fits is taken again and again.

    ``values`` are distinct lengths above 0, ascending, ``counts`` how many of
    each are left.  Distinct lengths that fit together are few, so this takes
    a number of steps in proportion to the root of ``room`` at most.
    """
    taken, upto = 0, len(values)
    while room > 0 and (upto := bisect_right(values, room, 0, upto)):
        upto -= 1
        words = min(counts[upto], room // values[upto]) * values[upto]
        taken += words
        room -= words
    return taken


def cheapest_size(need: int, values: list[int], counts: list[int], costs: dict[int, float]) -> int:
    """The size to open for an item of ``need`` when the lengths ``values`` (``counts`` of each) are still to be placed.

    Each size that holds the item is filled up with those lengths in thought
    and then shrunk to what it holds; the least cost per word wins, ties go to
    the smaller size.
    """
    sizes = sorted(costs)

    def rate(c: int) -> float:
        words = need + fill_of(c - need, values, counts)
        return costs[sizes[bisect_left(sizes, words)]] / max(words, 1)

    return min((c for c in sizes if c >= need), key=lambda c: (rate(c), c))


def best_fit(lengths: list[int], costs: dict[int, float]) -> list[tuple[int, int, int]]:
    """(bin, offset, capacity) of each item, in the order given.

    Items go in by falling length, each into the open bin that it leaves with
    the least room; if none holds it, the least-cost size is opened, judged by
    the lengths that are left.  At the end each bin takes the smallest
    permitted size that holds its contents.  Items of length 0 share the first
    bin that is open or make one.
    """
    order = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    sizes, tally = sorted(costs), Counter(lengths)
    values = sorted(tally.keys() - {0})
    counts = [tally[v] for v in values]
    rooms: list[tuple[int, int]] = []  # (room, bin), sorted
    filled: list[int] = []
    place: list[tuple[int, int]] = [(0, 0)] * len(lengths)
    for i in order:
        n = lengths[i]
        # The longest are placed first, so what is left are the lengths up to this one.
        while values and (values[-1] > n or not counts[-1]):
            values.pop()
            counts.pop()
        if values and values[-1] == n:
            counts[-1] -= 1
        at = bisect_left(rooms, (n, -1))
        if at < len(rooms):
            room, b = rooms.pop(at)
        else:
            b, room = len(filled), cheapest_size(n, values, counts, costs)
            filled.append(0)
        place[i] = (b, filled[b])
        filled[b] += n
        insort(rooms, (room - n, b))
    final = [sizes[bisect_left(sizes, f)] for f in filled]
    return [(b, at, final[b]) for b, at in place]


def _pack_batches(batches, costs: dict[int, float], block: int, schema: pa.Schema, length: str, names: list[str]):
    """Pack the rows of one partition in blocks; full pieces of long rows are bins of their own."""
    part, bins, top = TaskContext.get().partitionId(), 0, max(costs)
    held: list[pa.RecordBatch] = []

    def flush():
        nonlocal bins, held
        table = pa.Table.from_batches(held)
        held = []
        n = [x or 0 for x in table[length].to_pylist()]
        rest = [x % top or (top if x else 0) for x in n]
        row, piece, start, size, number, offset, capacity = [], [], [], [], [], [], []
        packed = best_fit(rest, costs)
        first = bins + 1 + max((p[0] for p in packed), default=-1)
        for i, total in enumerate(n):
            whole = (total - rest[i]) // top
            for k in range(whole + 1):
                last = k == whole
                row.append(i)
                piece.append(k)
                start.append(k * top)
                size.append(rest[i] if last else top)
                number.append(bins + packed[i][0] if last else first)
                offset.append(packed[i][1] if last else 0)
                capacity.append(packed[i][2] if last else top)
                first += not last
        bins = first
        kept = table.drop_columns([length]).take(pa.array(row, pa.int64()))
        made = dict(zip(names, (piece, start, size, [f"{part}-{x}" for x in number], offset, capacity)))
        cols = [kept[f.name] if f.name in kept.column_names else pa.array(made[f.name], f.type) for f in schema]
        yield from pa.Table.from_arrays([c.cast(f.type) for c, f in zip(cols, schema)], schema=schema).to_batches(max_chunksize=20_000)

    for batch in batches:
        for at in range(0, batch.num_rows, block):
            part_rows = batch.slice(at, block)
            if held and sum(b.num_rows for b in held) + part_rows.num_rows > block:
                yield from flush()
            held.append(part_rows)
    if held:
        yield from flush()


def pack(
    docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text",
    capacities: tuple[int, ...] = CAPACITIES, opening: int = OPENING, attention: int = ATTENTION,
    block: int = 50_000, least: int = 5_000, spread: int = 64,
) -> DataFrame:
    """Places of all words of ``docs`` in sequences of the permitted lengths.

    Returns, for each piece of a row, the columns ``keep`` and: piece (from
    0), piece_start (its first word in the row), piece_words, bin, bin_offset,
    bin_capacity.  Rows longer than the largest capacity are cut into pieces;
    full pieces are bins of their own.  The other pieces, one per row, are
    packed by best fit in blocks of up to ``block`` rows.  The rows (kept
    columns and lengths, no text) are dealt in turn into blocks of even size,
    of ``least`` rows or more, so small partitions of the input are packed
    together: up to ``spread`` blocks, beyond that as few as blocks of
    ``block`` rows allow.  Their number follows from the rows alone.  There is
    no hot key, and a task holds one block of lengths.  Bins are not shared between blocks: a block wastes a few sequences of the
    thousands it fills.

    A sequence of c words costs c + ``opening`` + c² / ``attention``.  So long
    sequences are dear by their attention and short ones by their opening, and
    each bin that has to be opened takes the size that the lengths still to be
    placed fill at the least cost per word.

    A null or empty text is one piece of 0 words in some bin.  Repeated rows
    are packed each.  Nulls in kept columns stay.  An empty table gives none.
    A kept column that has a new column's name keeps it; the new one gets an underscore.
    """
    narrow = docs.select(*keep)
    names = spare(narrow, "piece", "piece_start", "piece_words", "bin", "bin_offset", "bin_capacity")
    length = spare(narrow, "_length", *names)[0]
    kinds = [T.LongType(), T.LongType(), T.LongType(), T.StringType(), T.LongType(), T.LongType()]
    out = T.StructType([*narrow.schema.fields, *[T.StructField(n, k) for n, k in zip(names, kinds)]])
    costs = bin_costs(capacities, opening, attention)

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        return _pack_batches(batches, costs, block, to_arrow_schema(out), length, names)

    rows = docs.count()
    # A tenth of a block is left free, since dealing in turn is even to a row of each partition dealt from.
    blocks = max(-(-rows * 10 // (block * 9)), min(rows // least, spread), 1)
    return docs.select(*[F.col(c) for c in keep], n_words(text_col).alias(length)).repartition(blocks).mapInArrow(run, out)
