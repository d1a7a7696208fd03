import gzip
import hashlib
import json

import pytest

from uipatterns.llm import warc


def brute(rows):
    top = {}
    for i, _, h in rows:
        if i is not None and len((h or "").encode()) >= 1000:
            top[h] = max(i, top.get(h, i))
    out = []
    for i, u, h in rows:
        p = (h or "").encode()
        ref = top.get(h) if len(p) >= 1000 and top.get(h) != i else None
        out.append((i, u, len(p), hashlib.sha1(p).hexdigest(), "revisit" if ref is not None else "response", ref))
    return sorted(out, key=repr)


def test_write_and_read_back_with_odd_rows(spark, tmp_path):
    rows = [(i, f"http://x/{i}", f"<p>é{i}</p>" * (1 + 150 * (i % 2))) for i in range(60)]
    rows += [(100 + i, None, "same " * 300) for i in range(30)] + [(200, "u", None), (201, "u\r\nEvil: 1", ""), (None, "u", "same " * 300), (129, "z", "same " * 300)]
    rows += [(300, "a", "short"), (301, "a", "short"), (302, "a", "y" * 300_000), (100, None, "other " * 400)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, digest int").repartition(4)
    folder = f"file://{tmp_path}/w"
    files = warc.write_warc(df, folder, roll=6_000, shards=3)
    assert files.count() > 3
    got = warc.read_warc(spark, folder, payloads=True).collect()
    want = brute([(i, u.replace("\r", " ").replace("\n", " ") if u else u, h) for i, u, h in rows])
    assert sorted(((r["page_id"], r["url"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got), key=repr) == want
    assert all(hashlib.sha1(bytes(r["payload"])).hexdigest() == r["payload_digest"] for r in got if r["record_type"] == "response")
    made = json.loads((tmp_path / "w" / "manifest.json").read_text())["files"]
    for f in made:
        raw = (tmp_path / "w" / f["path"].rsplit("/", 1)[1]).read_bytes()
        assert (len(raw), hashlib.sha1(raw).hexdigest()) == (f["bytes"], f["sha1"]) and gzip.decompress(raw).startswith(b"WARC/1.1\r\nWARC-Type: warcinfo")
    again = warc.write_warc(df.repartition(2), f"file://{tmp_path}/w2", roll=6_000, shards=3)
    assert [(r["sha1"], r["records"]) for r in again.orderBy("path").collect()] == [(f["sha1"], f["records"]) for f in made]
    broken = tmp_path / "w" / made[0]["path"].rsplit("/", 1)[1]
    broken.write_bytes(broken.read_bytes()[:-20])
    with pytest.raises(Exception, match="ends within a record"):
        warc.read_warc(spark, folder).count()


def test_empty_table(spark, tmp_path):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.write_warc(df, f"file://{tmp_path}/e").count() == 0 and warc.read_warc(spark, f"file://{tmp_path}/e").count() == 0
