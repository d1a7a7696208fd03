"""Registered queries against their SQL, brute force or a second reading, on the smallest tables."""

import os
import pathlib
import sys

import numpy as np
import pytest

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[2] / "tools"))


@pytest.mark.parametrize("name", ["op1_exact_top_k", "op2_substring_dedup", "op3_mixing", "op6_chat_format", "op7_warc",
                                  "op11_ranked_search", "op12_source_divergence"])
def test_query_equals_its_sql(spark, name):
    import duckdb
    from check_oracles import norm

    from uipatterns.llm.queries import ORACLES, QUERIES

    con = duckdb.connect()
    for f in pathlib.Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    df = QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    mine = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    cur = con.execute(ORACLES[name])
    names = [d[0] for d in cur.description]
    theirs = sorted((tuple(norm(dict(zip(names, r))[c]) for c in cols) for r in cur.fetchall()), key=repr)
    assert mine and mine == theirs


def test_every_operator_has_a_query():
    import __spark_entry__ as contract

    names = set(contract.queries())
    assert {n.split("_")[0] for n in names if n.startswith("op")} >= {f"op{i}" for i in range(1, 14)} and "pipeline" in names


def test_token_ids_equal_those_of_whole_texts(spark):
    P = pytest.importorskip("public_tokenizers")
    import zlib

    from tokenizers import Tokenizer

    from uipatterns.llm.queries import QUERIES

    tok, at = Tokenizer.from_file(P.path("byte_bpe_50k.json")), 0
    got = {r["doc_id"]: r for r in QUERIES["op4_token_output"](spark, DATA).collect()}
    for d, text in sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()):
        ids = np.array([*tok.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        r = got.pop(d)
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert not got


def test_token_ids_of_a_literal_control_string(spark, tmp_path):
    P = pytest.importorskip("public_tokenizers")
    import zlib

    from tokenizers import Tokenizer

    from uipatterns.llm.queries import QUERIES

    says = ["a <|endoftext|> b", "<|endoftext|>", " <|endoftext|><|endoftext|>x  <|endoftext|>\n", "it's  <|endoftext|>'s", "plain", "<|endoftext", "é<|endoftext|> "]
    spark.createDataFrame(list(enumerate(says)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    tok, at = Tokenizer.from_file(P.path("byte_bpe_50k.json")), 0
    got = {r["doc_id"]: r for r in QUERIES["op4_token_output"](spark, str(tmp_path)).collect()}
    for d, text in enumerate(says):
        plain = tok.encode(text, add_special_tokens=False).ids
        ids = np.array([*plain, 0], "<u4")
        assert (50256 in plain) == ("<|endoftext|>" in text)
        assert (got[d]["start"], got[d]["n_tokens"], got[d]["ids_crc32"]) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_search_recall(spark):
    from uipatterns.llm.queries import QUERIES

    rows = spark.read.parquet(f"{DATA}/embeddings.parquet").toPandas()
    v, ids = np.stack(rows["embedding"].to_numpy()).astype(float), rows["vec_id"].to_numpy()
    got = {}
    for r in QUERIES["op8_ann_search"](spark, DATA).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = []
    for i in np.flatnonzero(ids % 20 == 0):
        s = v @ v[i]
        s[i] = -np.inf
        best = ids[np.lexsort((ids, -s))[:20]]
        assert len(got[ids[i]]) == 20
        hits.append(len(set(best) & got[ids[i]]) / 20)
    assert np.mean(hits) >= 0.9


def test_near_duplicates_equal_brute_force(spark):
    from test_neardup import brute

    from uipatterns.llm.queries import QUERIES

    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in QUERIES["op9_minhash_near_dedup"](spark, DATA).collect()}
    assert got == brute(docs, 3, 85)


def test_packing_places_every_word(spark):
    from uipatterns.llm.queries import QUERIES

    got = QUERIES["op10_best_fit_packing"](spark, DATA).toPandas()
    docs = spark.read.parquet(f"{DATA}/documents.parquet").collect()
    want = {r["doc_id"]: len((r["text"] or "").encode().split()) for r in docs}
    assert got.groupby("doc_id")["piece_words"].sum().to_dict() == want
    bins = got.groupby("bin").agg(words=("piece_words", "sum"), size=("bin_capacity", "first"), end=("bin_offset", "max"))
    assert (bins["words"] <= bins["size"]).all() and bins["words"].sum() / bins["size"].sum() > 0.9
