import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from uipatterns.llm.substring import Ranges, _batch_words, anchor_windows, cut_words, remove_repeats


def brute(docs, window):
    """docs: (id, text) with distinct ids; kept words of each."""
    first, out = {}, {}
    parts = {d: (t or "").encode().split() for d, t in docs}
    for d in sorted(parts, key=lambda d: (d is not None, d)):
        for p in range(len(parts[d]) - window + 1):
            first.setdefault(tuple(parts[d][p:p + window]), (d, p))
    for d, w in parts.items():
        gone = set()
        for p in range(len(w) - window + 1):
            if first[tuple(w[p:p + window])] != (d, p):
                gone |= set(range(p, p + window))
        out[d] = [x.decode() for i, x in enumerate(w) if i not in gone]
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abcd"), max_size=60), min_size=1, max_size=6), st.integers(2, 24), st.integers(1, 6))
def test_equal_windows_have_equal_keys(docs, window, rounds):
    words, edges = _batch_words([" ".join(d).encode() for d in docs])
    if not edges[-1]:
        return
    key, a, b = anchor_windows(Ranges(words), edges, window, rounds)
    seen, n = {}, 0
    for k, x, y in zip(key, a, b):
        for p in range(x, y):
            n += 1
            assert seen.setdefault(words[p:p + window].tobytes(), k) == k
    assert n == sum(max(0, len(d) - window + 1) for d in docs)


def test_anchors_are_sparse():
    rng = np.random.default_rng(0)
    words, edges = _batch_words([" ".join(map(str, rng.integers(0, 5000, 20_000))).encode()])
    assert len(anchor_windows(Ranges(words), edges, 20, 2)[0]) < 20_000 / 5


def test_removal_equals_brute_force_with_odd_rows(spark):
    rng = np.random.default_rng(5)
    text = lambda n: " ".join(rng.choice(["u", "v", "w", "x", "yy"], n))
    shared, run = text(40), "la " * 90
    docs = [(i, text(int(rng.integers(0, 80)))) for i in range(40)]
    docs += [(50 + i, f"{text(9)}\n{shared}\t {text(9)}") for i in range(6)] + [(70, run), (71, run + "end"), (72, None), (73, ""), (74, " \n"), (None, shared)]
    docs += [(80, docs[2][1]), (81, docs[2][1]), (90, text(3000))]
    df = spark.createDataFrame([(d, t, "q") for d, t in docs], "doc_id long, text string, n_words string").repartition(3)
    got = remove_repeats(df, window=12).collect()
    want = brute(docs, 12)
    assert {r["doc_id"]: (r["text"] or "").split() for r in got} == want
    assert all(r["n_words"] == "q" and r["n_words_"] - r["n_removed"] == len(want[r["doc_id"]]) for r in got)
    assert all(sum(s["stop"] - s["start"] for s in r["removed_spans"]) == r["n_removed"] for r in got)
    assert [r["text"] for r in got if r["doc_id"] == 72] == [None]


def test_repeated_rows_are_one_document_and_empty_table(spark):
    words = " ".join(f"w{i}" for i in range(30))
    df = spark.createDataFrame([(1, words), (1, words), (2, words)], "doc_id long, text string")
    got = sorted((r["doc_id"], r["n_removed"], r["text"]) for r in remove_repeats(df, window=20).collect())
    assert got == [(1, 0, words), (1, 0, words), (2, 30, "")]
    assert remove_repeats(df.limit(0)).count() == 0


def test_rows_of_one_id_have_candidates_of_their_own(spark, tmp_path):
    shared = " ".join(f"p{i}" for i in range(30))
    rows = [(None, " ".join(f"d{d}w{i}" for i in range(d)) + " " + shared) for d in range(1, 40)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = {(r["text"], r["n_removed"]) for r in remove_repeats(df, window=20, folder=str(tmp_path)).collect()}
    lists = [len(r["segments"]) for r in spark.read.parquet(f"{tmp_path}/wanted").collect()]
    assert len(lists) == 39 and max(lists) <= 30
    assert got == {(rows[0][1], 0)} | {(" ".join(t.split()[:-30]), 30) for _, t in rows[1:39]}


def test_windows_within_a_shared_passage_are_not_named(spark, tmp_path):
    shared = " ".join(f"p{i}" for i in range(400))
    rows = [(d, " ".join(f"d{d}w{i}" for i in range(5)) + " " + shared + f" end{d}") for d in range(1, 41)]
    rows += [(100 + d, " ".join(f"p{i}" for i in range(150 + d, 250))) for d in range(4)] + [(None, rows[0][1]), (200, rows[3][1]), (200, rows[3][1])]
    for parts in (1, 8):
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        got = [(r["doc_id"], (r["text"] or "").split()) for r in remove_repeats(df, window=20, folder=f"{tmp_path}/{parts}").collect()]
        want = brute(rows, 20)
        assert len(got) == len(rows) and all(w == want[d] for d, w in got)
        # 381 windows of each of the 40 texts lie in the passage; only those at its ends differ between the texts.
        assert spark.read.parquet(f"{tmp_path}/{parts}/windows").count() < 40 * 381 / 4


def test_a_passage_at_one_place_of_two_texts_of_one_id_stays_once(spark):
    shared = " ".join(f"p{i}" for i in range(30))
    for spread in (1, 4):
        df = spark.createDataFrame([(d, f"{shared} {d}{x} end") for d in (None, 3) for x in "abcd"], "doc_id long, text string").repartition(spread)
        assert sorted(r["n_removed"] for r in remove_repeats(df, window=30).collect()) == [0] + [30] * 7


def test_untouched_spaces_stay():
    assert cut_words(b" a  b\nc\td e", [(1, 3)]) == b" a  d e"
    assert cut_words(b"a b c ", [(1, 3)]) == b"a"
    assert cut_words(b" a b", [(0, 2)]) == b""
