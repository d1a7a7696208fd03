"""WARC archives of pages: deterministic shards, revisits of equal payloads, read back whole."""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from uipatterns.llm.common import by_value, shared_folder, written
from uipatterns.llm.tokens import place_of

by_value(__name__)

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2020-01-01T00:00:00Z"  # a fixed date keeps reruns equal, byte for byte; pass your own
FILE = "path string, records long, bytes long, sha1 string"


def record_uri(page_id: int | None, digest: str) -> str:
    """The record's id follows from page and payload, so a rerun writes it again."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def sha1_field(digest: bytes) -> str:
    return "sha1:" + base64.b32encode(digest).decode()


def _lines(fields: list[tuple[str, str]]) -> bytes:
    return b"WARC/1.1\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in fields) + b"\r\n"


def _clean(value: str) -> str:
    return value.replace("\r", " ").replace("\n", " ")


def page_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """A response with the payload, or a revisit with its HTTP header alone; all headers and digests are made here."""
    digest = hashlib.sha1(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_uri(page_id, digest.hexdigest())), ("WARC-Date", date)]
    if url is not None:
        fields.append(("WARC-Target-URI", _clean(url)))
    if page_id is not None:
        fields.append(("WARC-Page-ID", str(page_id)))
    fields += [("WARC-Payload-Digest", sha1_field(digest.digest())), ("WARC-Block-Digest", sha1_field(hashlib.sha1(block).digest()))]
    if revisit:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_uri(refers_to, digest.hexdigest())), ("WARC-Refers-To-Page-ID", str(refers_to))]
    fields += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    return _lines(fields) + block + b"\r\n\r\n"


def info_record(name: str, date: str) -> bytes:
    block = b"software: uipatterns\r\nformat: WARC File Format 1.1\r\n"
    return _lines([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"), ("WARC-Date", date),
                   ("WARC-Filename", name), ("Content-Type", "application/warc-fields"), ("Content-Length", str(len(block)))]) + block + b"\r\n\r\n"


def member(record: bytes) -> bytes:
    """One gzip member, without time stamp."""
    press = zlib.compressobj(6, zlib.DEFLATED, 31)
    return press.compress(record) + press.flush()


class _File:
    """An archive under a temporary name; it gets its own name when whole."""

    def __init__(self, fs, root: str, name: str, date: str):
        self.fs, self.final, self.temporary = fs, f"{root}/{name}", f"{root}/_writing-{name}-{uuid.uuid4().hex}"
        self.out, self.sha1, self.bytes, self.records = fs.open_output_stream(self.temporary, compression=None, buffer_size=1 << 20), hashlib.sha1(), 0, 0
        self.add(info_record(name, date))

    def add(self, record: bytes) -> None:
        raw = member(record)
        self.out.write(raw)
        self.sha1.update(raw)
        self.bytes += len(raw)
        self.records += 1

    def close(self) -> None:
        self.out.close()
        self.fs.move(self.temporary, self.final)


def _write_partition(batches, folder: str, roll: int, date: str):
    fs, root = place_of(folder)
    part, turn, file, marks, at = TaskContext.get().partitionId(), 0, None, {}, None

    def done():
        file.close()
        return pa.RecordBatch.from_pydict({"path": [f"{folder}/{file.final.rsplit('/', 1)[1]}"], "records": pa.array([file.records]),
                                           "bytes": pa.array([file.bytes]), "sha1": [file.sha1.hexdigest()]})

    for batch in batches:
        for page_id, mark, url, html, digest, refers_to in zip(*(batch.column(c) for c in ("page_id", "mark", "url", "html", "digest", "refers_to"))):
            page_id = page_id.as_py()
            if at != (page_id,):
                at, marks = (page_id,), {}
            if mark.as_py() == 0:
                marks[digest.as_py()] = refers_to.as_py()
                continue
            payload = (html.as_py() or "").encode("utf-8", "surrogatepass")
            sha1 = hashlib.sha1(payload).hexdigest()
            if file is None:
                file = _File(fs, root, f"pages-{part:06d}-{turn:04d}.warc.gz", date)
            file.add(page_record(page_id, url.as_py(), payload, marks.get(sha1), sha1 in marks, date))
            if file.bytes >= roll:
                yield done()
                file, turn = None, turn + 1
    if file is not None:
        yield done()


def write_warc(
    pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
    least: int = 1_000, roll: int = 256 * 2 ** 20, shards: int | None = None, date: str = DATE,
) -> DataFrame:
    """Write one record per row; returns the manifest's files.

    Of rows with equal payloads of ``least`` bytes or more, the one with the
    largest id is the response; the others are revisits that refer to it.
    Digests are grouped with map-side combine, and a revisit travels as a
    small row of its own, sorted in front of its page, so payloads are
    shuffled once, for the range sort by id, and a payload that a third of
    all rows share loads no task.  Each partition rolls its file when its
    compressed size reaches ``roll``.  Files get their names when whole, a
    task run again writes the same bytes, and manifest.json, written last,
    names the files that count, with sizes and digests.

    Null payload: empty.  Null url: no target header.  Null id: no page
    header, sorts first, never referred to.  Repeated rows of the largest id
    are all responses.  Empty table: a manifest without files.
    """
    given = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                         F.coalesce(F.col(payload_col).cast("string"), F.lit("")).alias("html"))
    spark = pages.sparkSession
    fs, root = place_of(folder)
    fs.create_dir(root, recursive=True)
    # Two equal digests of equal length are one payload.
    digests = written(given.select("page_id", F.sha1(F.encode("html", "UTF-8")).alias("digest"), F.octet_length("html").alias("n")).filter(F.col("n") >= least), folder, "_digests")
    top = digests.groupBy("digest", "n").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("rows")).filter("rows > 1 and refers_to is not null")
    revisits = digests.join(top, ["digest", "n"]).filter(~F.col("page_id").eqNullSafe(F.col("refers_to"))).select("page_id", "digest", "refers_to").distinct()
    marks = revisits.select("page_id", F.lit(0).alias("mark"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"), "digest", "refers_to")
    rows = given.select("page_id", F.lit(1).alias("mark"), "url", "html", F.lit(None).cast("string").alias("digest"), F.lit(None).cast("long").alias("refers_to"))
    count = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.unionByName(marks).repartitionByRange(count, "page_id").sortWithinPartitions("page_id", "mark", "url", "html")
    made = written(ordered.mapInArrow(lambda b: _write_partition(b, folder, roll, date), FILE), folder, "_files").orderBy("path").collect()  # one row per file
    with fs.open_output_stream(f"{root}/_manifest") as out:
        out.write(json.dumps({"version": 1, "files": [r.asDict() for r in made]}).encode())
    fs.move(f"{root}/_manifest", f"{root}/manifest.json")
    return spark.createDataFrame(made, FILE)


def records(stream, size: int = 1 << 20):
    """(header, block) of each record of a stream of gzip members; an error if the stream ends within one."""
    raw = b""
    while True:
        raw = raw or stream.read(size)
        if not raw:
            return
        unpress, parts = zlib.decompressobj(31), []
        while not unpress.eof:
            raw = raw or stream.read(size)
            if not raw:
                raise ValueError("the archive ends within a record")
            parts.append(unpress.decompress(raw))
            raw = unpress.unused_data
        head, _, rest = b"".join(parts).partition(b"\r\n\r\n")
        fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        yield fields, rest[:int(fields["Content-Length"])]


READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def _read_files(batches, payloads: bool):
    def batch_of(rows):
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
        names = ("page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload")
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    for batch in batches:
        for uri in batch.column("path").to_pylist():
            fs, path = place_of(uri)
            rows, held = [], 0
            with fs.open_input_stream(path, compression=None) as stream:
                for fields, block in records(stream):
                    if fields["WARC-Type"] not in ("response", "revisit"):
                        continue
                    http, _, payload = block.partition(b"\r\n\r\n")
                    said = dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])
                    digest = base64.b32decode(fields["WARC-Payload-Digest"][5:])
                    if sha1_field(hashlib.sha1(block).digest()) != fields["WARC-Block-Digest"]:
                        raise ValueError(f"{path}: {fields['WARC-Record-ID']} is damaged")
                    response = fields["WARC-Type"] == "response"
                    if response and hashlib.sha1(payload).digest() != digest:
                        raise ValueError(f"{path}: {fields['WARC-Record-ID']} has another payload")
                    page, ref = fields.get("WARC-Page-ID"), fields.get("WARC-Refers-To-Page-ID")
                    rows.append((page and int(page), fields.get("WARC-Target-URI"), int(said["Content-Length"]), digest.hex(), fields["WARC-Type"],
                                 ref and int(ref), payload if payloads and response else None))
                    held += len(block) if payloads else 200
                    if held > 4_000_000 or len(rows) >= 5_000:
                        yield batch_of(rows)
                        rows, held = [], 0
            if rows:
                yield batch_of(rows)


def read_warc(spark: SparkSession, folder: str, payloads: bool = False) -> DataFrame:
    """The page records of all files of the manifest, each checked against its digests; ``payloads`` adds those of responses."""
    fs, root = place_of(folder)
    with fs.open_input_stream(f"{root}/manifest.json") as f:
        files = json.loads(f.read())["files"]
    listed = spark.createDataFrame([(f["path"],) for f in files], "path string").repartition(max(1, len(files)), "path")
    return listed.mapInArrow(lambda b: _read_files(b, payloads), READ)


def round_trip(pages: DataFrame, **options) -> DataFrame:
    """Write ``pages`` below the shared folder and read the archives back."""
    folder = shared_folder(pages.sparkSession, "warc")
    write_warc(pages, folder, **options)
    return read_warc(pages.sparkSession, folder)
