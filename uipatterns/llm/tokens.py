"""Token ids of documents in binary shards with a shared zstandard dictionary."""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from uipatterns.llm.common import by_value, hash_sample, shared_folder, written

by_value(__name__)

# The shard format (fixed values): magic, then little-endian 64-bit numbers.
#   head:  MAGIC, 16-byte hash of the dictionary
#   body:  one zstandard frame per document, of its ids as little-endian 32-bit numbers
#   index: per document its id (or MISSING), the frame's place and length, its number of ids
#   tail:  place of the index, number of documents, MAGIC
MAGIC, MISSING = b"TOKZ0001", -(2 ** 63)
_ROW, _TAIL = "<qqqq", "<qq8s"

_SPLIT = re.compile(r"(?<=\S) (?=\S)")
_DOUBLE = re.compile(r"\s\s")


class Encoder:
    """Byte-level BPE of whole texts that remembers the ids of common pieces.

    A byte-level pre-tokenizer always cuts before a single space between two
    other characters, so a text's ids are those of its pieces (cut there, the
    space leading) one after the other.  Short pieces are remembered, up to a
    bound; each is encoded by the tokenizers library once.  ``escape`` makes
    the control strings in a text ordinary text; without it each is its one
    added id, as in the library's plain call (they must hold no spaces).
    """

    def __init__(self, path: str, remembered: int = 1_000_000, escape: bool = True):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = escape  # control strings in a text are text
        self.remembered = remembered
        self.known: dict[str, bytes] = {}

    @staticmethod
    def pieces(text: str) -> list[str]:
        parts = _SPLIT.split(text) if _DOUBLE.search(text) else text.split(" ")
        if len(parts) > 1 and (not parts[0] or not parts[-1]):  # a space at either end is not between two characters
            parts = _SPLIT.split(text)
        return [parts[0], *[" " + p for p in parts[1:]]]

    def encode(self, texts: list[str]) -> list[bytes]:
        cut = [self.pieces(t) for t in texts]
        known = self.known
        new = list({p for parts in cut for p in parts if p not in known})
        for at in range(0, len(new), 20_000):
            part = new[at:at + 20_000]
            for piece, e in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False)):
                known[piece] = np.array(e.ids, "<u4").tobytes()
        out = [b"".join(map(known.__getitem__, parts)) for parts in cut]
        full = len(known) > self.remembered  # what came first, and so is common, stays
        for piece in new:
            if full or len(piece) > 100:  # hardly seen again, and of any size
                del known[piece]
        return out


def encoder(path: str, escape: bool = True) -> Encoder:
    """The process's encoder of a vocabulary; kept with the library's module, so the next task of a worker finds it."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core per task
    import tokenizers

    kept = tokenizers.__dict__.setdefault("_kept_encoders", {})
    if (path, escape) not in kept:
        kept[path, escape] = Encoder(path, escape=escape)
    return kept[path, escape]


def _encoded(texts: list[str | None], path: str, end: int, escape: bool = True) -> list[bytes]:
    tail = np.array([end], "<u4").tobytes()
    return [ids + tail for ids in encoder(path, escape).encode([t or "" for t in texts])]


def _groups(batch, column: str = "text", limit: int = 4_000_000):
    sizes = [len(x) if x is not None else 0 for x in batch.column(column).to_pylist()]
    begin, size = 0, 0
    for i, n in enumerate(sizes):
        if size and size + n > limit:
            yield batch.slice(begin, i - begin)
            begin, size = i, 0
        size += n
    if len(sizes) > begin:
        yield batch.slice(begin)


def train_dictionary(docs: DataFrame, path: str, end: int, sample: int = 2_000, size: int = 64_000, escape: bool = True) -> bytes:
    """A zstandard dictionary from the ids of a bounded sample: about ``sample`` documents of smallest hash.

    Texts of up to 20,000 characters count, so the sample has at most 20,000 x
    ``sample`` characters at any corpus size.  Too little to train on gives an
    empty dictionary.
    """
    few = hash_sample(docs, sample, "doc_id").filter(F.length("text").between(1, 20_000)).select("text").distinct()
    texts = [r["text"] for r in few.orderBy(F.xxhash64("text"), "text").limit(sample).collect()]
    samples = _encoded(texts, path, end, escape)
    try:
        return zstandard.train_dictionary(size, samples).as_bytes() if len(samples) >= 50 else b""
    except zstandard.ZstdError:
        return b""


def dictionary_hash(dictionary: bytes) -> bytes:
    return xxhash.xxh3_128_digest(dictionary)


def _compressor(dictionary: bytes):
    given = {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}
    return zstandard.ZstdCompressor(level=3, write_content_size=True, **given)


def _decompressor(dictionary: bytes):
    return zstandard.ZstdDecompressor(**({"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}))


def place_of(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder, whatever store Arrow knows it to be in."""
    return pafs.FileSystem.from_uri(uri if "://" in uri else f"file://{os.path.abspath(uri)}" if not uri.startswith("file:") else "file://" + uri[5:])


SHARD = "shard long, path string, docs long, tokens long, bytes long"


def _write_shard(batches, folder: str, path: str, end: int, dictionary: bytes, escape: bool):
    """One partition's documents, in order, as one shard: a temporary name first, renamed when whole."""
    fs, root = place_of(folder)
    shard = TaskContext.get().partitionId()
    temporary, name = f"{root}/_writing-{shard}-{uuid.uuid4().hex}", f"shard-{shard:06d}.tokz"
    press, index, tokens, out, at = _compressor(dictionary), [], 0, None, 0
    for batch in batches:
        for part in _groups(batch):
            if out is None:
                out = fs.open_output_stream(temporary, buffer_size=1 << 20)
                at = out.write(MAGIC + dictionary_hash(dictionary))
            for d, ids in zip(part.column("doc_id").to_pylist(), _encoded(part.column("text").to_pylist(), path, end, escape)):
                frame = press.compress(ids)
                index.append((MISSING if d is None else d, at, len(frame), len(ids) // 4))
                tokens += len(ids) // 4
                at += out.write(frame)
    if out is None:
        return
    out.write(b"".join(struct.pack(_ROW, *r) for r in index) + struct.pack(_TAIL, at, len(index), MAGIC))
    out.close()
    fs.move(temporary, f"{root}/{name}")
    total = at + struct.calcsize(_ROW) * len(index) + struct.calcsize(_TAIL)
    yield pa.RecordBatch.from_pydict({"shard": pa.array([shard]), "path": [f"{folder}/{name}"], "docs": pa.array([len(index)]),
                                      "tokens": pa.array([tokens]), "bytes": pa.array([total])})


def write_tokens(
    docs: DataFrame, folder: str, tokenizer_path: str, end: int = 0, id_col: str = "doc_id", text_col: str = "text",
    shards: int | None = None, sample: int = 2_000, escape: bool = True,
) -> DataFrame:
    """Encode every whole text, append ``end``, and write shards in ascending id order; returns the manifest.

    Rows are range-partitioned by id and sorted, so shard s holds smaller ids
    than shard s + 1.  Each document is a frame of its own, compressed with the
    shared dictionary; the index at the end of a shard finds any document with
    two reads.  A task writes under a temporary name and renames, and a task
    run again writes the same bytes; manifest.json, written last, lists the
    shards with the running number of ids before each, the dictionary and its hash.

    Control strings in a text (``<|endoftext|>``) are ordinary text; without
    ``escape`` each is its added id, as in the library's plain call.
    Null text: encoded as empty, so only the end id.  Null id: sorts first.
    Repeated ids: each row is a document; texts decide their order.  Empty
    table: a manifest without shards.  Extra columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    dictionary = train_dictionary(rows, tokenizer_path, end, sample, escape=escape)
    fs, root = place_of(folder)
    fs.create_dir(root, recursive=True)
    spark = docs.sparkSession
    count = shards or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = rows.repartitionByRange(count, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    made = written(ordered.mapInArrow(lambda b: _write_shard(b, folder, tokenizer_path, end, dictionary, escape), SHARD), folder, "_shards").orderBy("shard").collect()
    start, listed = 0, []
    for r in made:  # one row per shard
        listed.append({"path": r["path"], "docs": r["docs"], "tokens": r["tokens"], "bytes": r["bytes"], "start": start})
        start += r["tokens"]
    manifest = {"version": 1, "end": end, "dictionary": dictionary.hex(), "dictionary_hash": dictionary_hash(dictionary).hex(), "shards": listed}
    with fs.open_output_stream(f"{root}/_manifest") as out:
        out.write(json.dumps(manifest).encode())
    fs.move(f"{root}/_manifest", f"{root}/manifest.json")
    schema = "path string, docs long, tokens long, bytes long, start long"
    return spark.createDataFrame([tuple(x[c] for c in ("path", "docs", "tokens", "bytes", "start")) for x in listed], schema)


def read_index(fs: pafs.FileSystem, path: str, expected: bytes) -> list[tuple[int, int, int, int]]:
    """The index rows of a shard; an error if the shard is not whole or needs another dictionary."""
    with fs.open_input_file(path) as f:
        head = f.read(24)
        f.seek(f.size() - struct.calcsize(_TAIL))
        at, n, magic = struct.unpack(_TAIL, f.read(struct.calcsize(_TAIL)))
        if head[:8] != MAGIC or magic != MAGIC or head[8:] != expected:
            raise ValueError(f"{path} is not a whole shard of this dictionary")
        f.seek(at)
        return list(struct.iter_unpack(_ROW, f.read(struct.calcsize(_ROW) * n)))


def _read_shards(batches, dictionary: bytes):
    unpress = _decompressor(dictionary)
    for batch in batches:
        for uri, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist()):
            fs, path = place_of(uri)
            index = read_index(fs, path, dictionary_hash(dictionary))
            with fs.open_input_stream(path, buffer_size=1 << 20) as f:
                f.read(24)
                for at in range(0, len(index), 1_000):
                    ids, starts, counts, sums, raws = [], [], [], [], []
                    for d, _, length, n in index[at:at + 1_000]:
                        raw = unpress.decompress(f.read(length))
                        if len(raw) != 4 * n:
                            raise ValueError(f"{path}: a document has {len(raw) // 4} ids instead of {n}")
                        ids.append(None if d == MISSING else d)
                        starts.append(start)
                        counts.append(n)
                        sums.append(zlib.crc32(raw))
                        raws.append(raw)
                        start += n
                    yield pa.RecordBatch.from_pydict({
                        "doc_id": pa.array(ids, pa.int64()), "start": pa.array(starts, pa.int64()), "n_tokens": pa.array(counts, pa.int64()),
                        "ids_crc32": pa.array(sums, pa.int64()), "ids": pa.array(raws, pa.binary())})


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """Every document of the shards that the manifest lists: doc_id, start, n_tokens, ids_crc32, ids (little-endian 32-bit)."""
    fs, root = place_of(folder)
    with fs.open_input_stream(f"{root}/manifest.json") as f:
        manifest = json.loads(f.read())
    dictionary = bytes.fromhex(manifest["dictionary"])
    if dictionary_hash(dictionary).hex() != manifest["dictionary_hash"]:
        raise ValueError("the manifest's dictionary and its hash differ")
    shards = spark.createDataFrame([(s["path"], s["start"]) for s in manifest["shards"]], "path string, start long")
    one_each = shards.repartition(max(1, len(manifest["shards"])), "path")
    return one_each.mapInArrow(lambda b: _read_shards(b, dictionary), "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")


def read_document(folder: str, doc_id: int) -> list[int] | None:
    """The ids of one document, by the index alone."""
    fs, root = place_of(folder)
    with fs.open_input_stream(f"{root}/manifest.json") as f:
        manifest = json.loads(f.read())
    dictionary = bytes.fromhex(manifest["dictionary"])
    for shard in manifest["shards"]:
        inner, path = place_of(shard["path"])
        for d, at, length, _ in read_index(inner, path, dictionary_hash(dictionary)):
            if d == doc_id:
                with inner.open_input_file(path) as f:
                    f.seek(at)
                    return np.frombuffer(_decompressor(dictionary).decompress(f.read(length)), "<u4").tolist()
    return None


def round_trip(docs: DataFrame, tokenizer_path: str, **options) -> DataFrame:
    """Write ``docs`` below the shared folder and read them back."""
    folder = shared_folder(docs.sparkSession, "tokens")
    write_tokens(docs, folder, tokenizer_path, **options)
    return read_tokens(docs.sparkSession, folder)
