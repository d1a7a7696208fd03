import json
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from uipatterns.llm import tokens

P = pytest.importorskip("public_tokenizers")
PATH = P.path("byte_bpe_50k.json")


def whole(text):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return t.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from([*"ab'sS1.,!é  \n\t\u00a0\u0301\u2003स", " the", "  ", "<|endoftext|>", " \n"]), max_size=30).map("".join))
def test_pieces_give_the_ids_of_the_whole_text(text):
    raw = tokens.encoder(PATH).encode([text])[0]
    assert np.frombuffer(raw, "<u4").tolist() == whole(text)


def test_round_trip_with_odd_rows(spark, tmp_path):
    rng = np.random.default_rng(0)
    word = lambda: "".join(rng.choice(list("abcdefgh"), int(rng.integers(1, 9))))
    rows = [(int(i), " ".join(word() for _ in range(int(rng.integers(1, 80))))) for i in rng.permutation(300)]
    rows += [(1000, None), (1001, ""), (None, "no id"), (7, "again"), (1002, "x" * 50_000), (1003, "a  b\n\n c " * 2_000)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, ids int")
    folder = f"file://{tmp_path}/out"
    manifest = tokens.write_tokens(df, folder, PATH, end=0, shards=3)
    assert manifest.count() == 3
    got = sorted(tokens.read_tokens(spark, folder).collect(), key=lambda r: r["start"])
    at = 0
    for r, (d, t) in zip(got, sorted(rows, key=lambda r: (r[0] is not None, r[0], r[1] or ""))):
        ids = [*whole(t), 0]
        raw = np.array(ids, "<u4").tobytes()
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"], bytes(r["ids"])) == (d, at, len(ids), zlib.crc32(raw), raw)
        at += len(ids)
    assert len(got) == len(rows)
    assert tokens.read_document(folder, 1002) == [*whole("x" * 50_000), 0] and tokens.read_document(folder, -5) is None
    made = json.loads((tmp_path / "out" / "manifest.json").read_text())
    assert made["dictionary"] and made["dictionary_hash"] == tokens.dictionary_hash(bytes.fromhex(made["dictionary"])).hex()
    shard = tmp_path / "out" / "shard-000001.tokz"
    shard.write_bytes(shard.read_bytes()[:-3])
    with pytest.raises(Exception, match="not a whole shard|unpack"):
        tokens.read_tokens(spark, folder).count()


def test_empty_table(spark, tmp_path):
    df = spark.createDataFrame([], "doc_id long, text string")
    folder = f"file://{tmp_path}/none"
    tokens.write_tokens(df, folder, PATH)
    assert tokens.read_tokens(spark, folder).count() == 0
