import random
from bisect import bisect_left
from collections import defaultdict

from hypothesis import given
from hypothesis import strategies as st

from uipatterns.llm.packing import ATTENTION, CAPACITIES, OPENING, best_fit, bin_costs, cheapest_size, fill_of, pack


@given(st.lists(st.integers(0, 64), max_size=60))
def test_bins_hold_their_items_without_overlap(lengths):
    placed = best_fit(lengths, bin_costs((16, 32, 64), 4, 128))
    bins = defaultdict(list)
    for n, (b, at, size) in zip(lengths, placed):
        bins[b].append((at, n, size))
    for items in bins.values():
        end, size = 0, items[0][2]
        for at, n, s in sorted(items):
            assert at == end and s == size
            end += n
        assert end <= size and not any(end <= c < size for c in (16, 32, 64))


def test_the_size_is_chosen_from_the_lengths_still_to_be_placed():
    costs = bin_costs((16, 32, 64), 8, 128)
    assert fill_of(50, [3, 20], [2, 4]) == 46 and fill_of(0, [3], [1]) == 0 and fill_of(9, [], []) == 0
    # alone an item takes the smallest size; many short ones fill the size of least cost per word
    assert cheapest_size(10, [], [], costs) == 16 and cheapest_size(40, [1], [100], costs) == 64
    assert cheapest_size(10, [1], [100], costs) == 32
    # three of 20 fill 64 to 60, one fills 32 to 20 only; with fillers 32 is full and cheaper
    assert cheapest_size(20, [20], [5], costs) == 64 and cheapest_size(20, [1, 20], [50, 5], costs) == 32
    assert [x[2] for x in best_fit([60, 30, 30, 9], costs)] == [64, 32, 32, 16]


def total(lengths, costs):
    return sum(costs[c] for c in {b: c for b, _, c in best_fit(lengths, costs)}.values())


def least_cost(lengths, costs):
    """By trying every way to divide the items into bins."""
    sizes, full = sorted(costs), (1 << len(lengths)) - 1
    words = [sum(n for i, n in enumerate(lengths) if m >> i & 1) for m in range(full + 1)]
    out = [0.0] * (full + 1)
    for m in range(1, full + 1):
        low, ways = m & -m, []
        rest = s = m ^ low
        while True:
            if words[s | low] <= sizes[-1]:
                ways.append(costs[sizes[bisect_left(sizes, words[s | low])]] + out[rest ^ s])
            if not s:
                break
            s = (s - 1) & rest
        out[m] = min(ways)
    return out[full]


def test_total_cost_is_near_the_optimum():
    rng = random.Random(1)
    for capacities, opening, attention in ((CAPACITIES, OPENING, ATTENTION), ((10, 24, 50), 3, 100), ((16, 32, 64), 0, 10**9)):
        costs, top, ratios = bin_costs(capacities, opening, attention), capacities[-1], []
        for _ in range(100):
            lengths = [rng.randint(1, rng.choice([top // 8, top // 2, top])) for _ in range(rng.randint(1, 8))]
            ratios.append(total(lengths, costs) / least_cost(lengths, costs))
        assert min(ratios) > 1 - 1e-9 and max(ratios) < 1.4 and sum(ratios) / len(ratios) < 1.02


def test_several_sizes_cost_less_than_one():
    rng, costs = random.Random(2), bin_costs(CAPACITIES, OPENING, ATTENTION)
    lengths = [int(rng.lognormvariate(5.5, 1.2)) % 4096 + 1 for _ in range(3000)]
    placed = best_fit(lengths, costs)
    assert len({c for _, _, c in placed}) >= 3
    only_largest = best_fit(lengths, {CAPACITIES[-1]: costs[CAPACITIES[-1]]})
    shrunk = defaultdict(int)
    for n, (b, _, _) in zip(lengths, only_largest):
        shrunk[b] += n
    assert total(lengths, costs) < 0.95 * sum(costs[CAPACITIES[bisect_left(CAPACITIES, w)]] for w in shrunk.values())


def test_the_number_of_blocks_follows_from_the_rows(spark):
    df = spark.createDataFrame([(i, "w " * 30) for i in range(40)], "doc_id long, text string").repartition(5)
    blocks = lambda: len({r["bin"].split("-")[0] for r in pack(df, capacities=(64, 128), least=10).collect()})
    was = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        got = [blocks()]
        spark.conf.set("spark.sql.shuffle.partitions", "2")
        got.append(blocks())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    assert got == [4, 4]


def test_every_word_has_one_place(spark):
    texts = ["w " * n for n in (0, 1, 5, 100, 1000, 37)] + [None]
    df = spark.createDataFrame([(i % 5, t, "q") for i, t in enumerate(texts * 3)], "doc_id long, text string, bin string")
    got = pack(df, keep=("doc_id", "bin"), capacities=(16, 64), block=8).collect()
    assert got[0]["bin"] == "q"
    assert sum(r["piece_words"] for r in got) == 3 * (1 + 5 + 100 + 1000 + 37)
    used = defaultdict(list)
    for r in got:
        used[r["bin_"]].append((r["bin_offset"], r["piece_words"], r["bin_capacity"]))
    for items in used.values():
        end = 0
        for at, n, size in sorted(items):
            assert at >= end or n == 0
            end = max(end, at + n)
            assert end <= size
    assert sum(1 for r in got if r["piece_words"] == 0) == 6
    assert pack(df.limit(0)).count() == 0


def test_small_partitions_are_packed_together(spark):
    df = spark.createDataFrame([(i, "w " * 30) for i in range(60)], "doc_id long, text string").repartition(30, "doc_id")
    got = pack(df, capacities=(64, 128, 256)).collect()
    assert len({r["bin"] for r in got}) == 8 and sum(r["piece_words"] for r in got) == 60 * 30
