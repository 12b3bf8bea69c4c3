"""Deterministic sharded WARC writer and its reader.

* Shard bounds come from the ids whose hash is 0 modulo m (the same sample
  however the input is partitioned); shards are ranges of the id, records are
  sorted inside them.  The number of shards, and with it what the driver sees of
  the ids, is bounded by ``max_shards``.
* Equal payloads (length and SHA-256) of at least ``revisit_bytes`` are one
  response, the largest id, and revisits of it.  Who refers to whom is settled
  on ids and digests alone, so every payload is shuffled once, to its shard.
* A task streams its shard: each record is a gzip member with regenerated
  headers and digests; a file is closed when it has ``roll_bytes`` compressed.
* Commit: tasks write under names of their own in ``_tmp``; the rows that
  describe the files pass through Spark's write commit, so only one attempt of
  a task counts; a second job renames the files and can be repeated; the
  manifest table, written last, makes the archive visible.

The bytes of all files depend only on the rows and the parameters.

Defined cases: null payload is empty; a null url has no target header and is
read back as null; line breaks in a url are percent-encoded.  Null ids sort
first; they refer to the largest id of their payload, and are responses where
all its ids are null.  Repeated rows of the largest id are all responses.  An
empty table makes an empty manifest.  Other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import os
import posixpath
import uuid
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SHARD_BYTES = 32 << 20       # payload bytes aimed at per shard
MAX_SHARDS = 20_000          # more data makes shards larger
ROLL_BYTES = 256 << 20       # compressed bytes after which a file is closed
SAMPLES_PER_SHARD = 64
NO_ID = -(1 << 63)

# Fixed values of the format.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAMESPACE = uuid.NAMESPACE_URL


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """The store of a path or URI, reachable from every executor."""
    if "://" in path or path.startswith("file:"):
        if path.startswith("file:/") and not path.startswith("file://"):
            path = "file://" + path.removeprefix("file:")
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), os.path.abspath(path)


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(ident, key: bytes) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{ident}:{key.hex()}')}>"


def _member(headers: list[tuple[str, str]], block: bytes, level: int) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in headers)
    raw = b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"
    return zlib.compress(raw, level, wbits=31)


def info_member(name: str, date: str, level: int) -> bytes:
    block = b"format: WARC File Format 1.1\r\n"
    return _member([("WARC-Type", "warcinfo"), ("WARC-Date", date), ("WARC-Filename", name),
                    ("WARC-Record-ID", record_id(name, b"")),
                    ("Content-Type", "application/warc-fields"),
                    ("Content-Length", str(len(block)))], block, level)


def page_member(ident, url, payload: bytes, key: bytes, refers_to, revisit: bool,
                date: str, level: int) -> bytes:
    http = ("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
            f"Content-Length: {len(payload)}\r\n\r\n").encode()
    block = http if revisit else http + payload
    headers = [("WARC-Type", "revisit" if revisit else "response"),
               ("WARC-Record-ID", record_id(ident, key)), ("WARC-Date", date)]
    if ident is not None:
        headers.append(("X-Page-ID", str(ident)))
    if url is not None:
        headers.append(("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")))
    if revisit:
        headers += [("WARC-Profile", REVISIT_PROFILE),
                    ("WARC-Refers-To", record_id(refers_to, key)),
                    ("X-Refers-To-Page-ID", str(refers_to))]
    headers += [("WARC-Payload-Digest", f"sha1:{base32_sha1(payload)}"),
                ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}"),
                ("Content-Type", "application/http; msgtype=response"),
                ("Content-Length", str(len(block)))]
    return _member(headers, block, level)


class _Files:
    """The files of one task: opens, rolls and describes them."""

    def __init__(self, out_dir: str, roll_bytes: int, date: str, level: int):
        self.store, root = file_system(out_dir)
        self.tmp = posixpath.join(root, "_tmp", uuid.uuid4().hex)
        self.roll, self.date, self.level = roll_bytes, date, level
        self.shard, self.seq, self.file, self.done = None, 0, None, []

    def _open(self) -> None:
        self.name = f"shard-{self.shard:06d}-{self.seq:05d}.warc.gz"
        self.store.create_dir(self.tmp, recursive=True)
        self.path = posixpath.join(self.tmp, self.name)
        self.file = self.store.open_output_stream(self.path, compression=None)
        self.size, self.n, self.sha = 0, 0, hashlib.sha256()
        self._put(info_member(self.name, self.date, self.level))

    def _put(self, member: bytes) -> None:
        self.file.write(member)
        self.sha.update(member)
        self.size += len(member)

    def close(self) -> None:
        if self.file is not None:
            self.file.close()
            self.done.append({"shard": self.shard, "seq": self.seq, "name": self.name,
                              "tmp": self.path, "bytes": self.size, "records": self.n,
                              "sha256": self.sha.hexdigest()})
            self.file = None

    def add(self, shard: int, member: bytes) -> None:
        if shard != self.shard:
            self.close()
            self.shard, self.seq = shard, 0
        elif self.file is not None and self.size >= self.roll:
            self.close()
            self.seq += 1
        if self.file is None:
            self._open()
        self._put(member)
        self.n += 1


MANIFEST = ("shard long, seq long, name string, tmp string, bytes long, records long, "
            "sha256 string")
MANIFEST_ARROW = pa.schema([("shard", pa.int64()), ("seq", pa.int64()), ("name", pa.string()),
                            ("tmp", pa.string()), ("bytes", pa.int64()),
                            ("records", pa.int64()), ("sha256", pa.string())])


def shard_bounds(rows: DataFrame, n: int, shards: int) -> list[int]:
    """First ids of the shards after the first, from a sample set by hash alone:
    at most SAMPLES_PER_SHARD * shards ids on average reach the driver, each once
    however often it is repeated."""
    if shards < 2:
        return []
    m = max(1, n // shards // SAMPLES_PER_SHARD)
    sample = rows.select("id").where("id is not null") \
        .where(F.pmod(F.xxhash64("id"), F.lit(m)) == 0).distinct().orderBy("id")
    ids = np.array([r.id for r in sample.collect()], np.int64)
    step = max(1, len(ids) // shards)
    return sorted({int(x) for x in ids[step::step]})


def shard_of(bounds: list[int]):
    at = np.array(bounds, np.int64)

    @F.pandas_udf("int")
    def found(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(at, ids.to_numpy(np.int64), side="right"), dtype="int32")

    return lambda c: found(F.coalesce(c, F.lit(NO_ID)))


def write_archives(df: DataFrame, out_dir: str, id_col: str = "page_id", url_col: str = "url",
                   payload_col: str = "html", revisit_bytes: int = 0,
                   shard_bytes: int = SHARD_BYTES, max_shards: int = MAX_SHARDS,
                   roll_bytes: int = ROLL_BYTES, date: str = "1970-01-01T00:00:00Z",
                   level: int = 6) -> DataFrame:
    """Writes ``out_dir`` and returns its manifest: shard, seq, name, bytes,
    records, sha256.  Ids are integers."""
    spark = df.sparkSession
    pages = df.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"),
                      F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload"))
    pages = pages.withColumn("key", F.unhex(F.sha2("payload", 256)))
    size = F.octet_length("payload")
    total = pages.agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("b")).first()
    shards = min(max_shards, max(1, -(-(total.b or 0) // shard_bytes)))
    shard = shard_of(shard_bounds(pages, total.n, shards))

    ids = pages.where(size >= revisit_bytes).select("id", "key")
    groups = ids.groupBy("key").agg(F.max("id").alias("response"),
                                    F.count(F.lit(1)).alias("n")).where("n > 1")
    revisits = ids.join(groups, "key").where("response is not null") \
        .where(~F.col("id").eqNullSafe(F.col("response")))
    none = F.lit(None)
    both = pages.select("id", "key", F.lit(1).alias("kind"), "url", "payload",
                        none.cast("long").alias("response")) \
        .unionByName(revisits.select("id", "key", F.lit(0).alias("kind"),
                                     none.cast("string").alias("url"),
                                     none.cast("binary").alias("payload"), "response"))

    def write(batches):
        files, told = _Files(out_dir, roll_bytes, date, level), None
        for b in batches:
            for s, ident, key, kind, url, payload, response in zip(
                    *(b.column(i).to_pylist() for i in range(b.num_columns))):
                if kind == 0:
                    told = (ident, key, response)
                    continue
                revisit = told is not None and told[:2] == (ident, key)
                files.add(s, page_member(ident, url, payload, key,
                                         told[2] if revisit else None, revisit, date, level))
        files.close()
        yield pa.RecordBatch.from_pylist(files.done, schema=MANIFEST_ARROW)

    staged = f"{out_dir}/_staged"
    placed = both.withColumn("shard", shard(F.col("id"))) \
        .select("shard", "id", "key", "kind", "url", "payload", "response") \
        .repartitionById(int(shards), F.col("shard")) \
        .sortWithinPartitions("shard", "id", "key", "kind", "url")
    placed.mapInArrow(write, MANIFEST).write.mode("overwrite").parquet(staged)

    def rename(batches):
        store, root = file_system(out_dir)
        for b in batches:
            for tmp, name in zip(b.column("tmp").to_pylist(), b.column("name").to_pylist()):
                final = posixpath.join(root, name)
                if store.get_file_info(tmp).type != pafs.FileType.NotFound:
                    store.move(tmp, final)
                elif store.get_file_info(final).type == pafs.FileType.NotFound:
                    raise FileNotFoundError(final)
            yield b

    files = spark.read.schema(MANIFEST).parquet(staged)
    files.mapInArrow(rename, MANIFEST).drop("tmp") \
        .write.mode("overwrite").parquet(f"{out_dir}/manifest")
    store, root = file_system(out_dir)  # what lost attempts have left
    if store.get_file_info(posixpath.join(root, "_tmp")).type != pafs.FileType.NotFound:
        store.delete_dir(posixpath.join(root, "_tmp"))
    return spark.read.parquet(f"{out_dir}/manifest")


def members(stream, chunk: int = 1 << 20):
    """The decompressed gzip members of a stream, one at a time."""
    unzip, out, data = zlib.decompressobj(31), [], stream.read(chunk)
    while data:
        out.append(unzip.decompress(data))
        if unzip.eof:
            yield b"".join(out)
            data, unzip, out = unzip.unused_data, zlib.decompressobj(31), []
            if data:
                continue
        data = stream.read(chunk)
    if any(out):
        raise ValueError("the archive ends inside a record")


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    headers = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[:int(headers["Content-Length"])]
    if lines[0] != "WARC/1.1" or rest[len(block):] != b"\r\n\r\n":
        raise ValueError("not a WARC record")
    return headers, block


RECORDS = ("id long, url string, payload_bytes long, payload_digest string, "
           "record_type string, refers_to long, payload binary")
RECORDS_ARROW = pa.schema([("id", pa.int64()), ("url", pa.string()),
                           ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                           ("record_type", pa.string()), ("refers_to", pa.int64()),
                           ("payload", pa.binary())])


def _page(headers: dict[str, str], block: bytes) -> dict:
    if headers["WARC-Block-Digest"] != f"sha1:{base32_sha1(block)}":
        raise ValueError(f"block digest of {headers['WARC-Record-ID']}")
    http, _, payload = block.partition(b"\r\n\r\n")
    revisit = headers["WARC-Type"] == "revisit"
    digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
    if not revisit and digest != base32_sha1(payload):
        raise ValueError(f"payload digest of {headers['WARC-Record-ID']}")
    length = next(int(x.split(b":")[1]) for x in http.split(b"\r\n")
                  if x.lower().startswith(b"content-length:"))
    number = lambda k: int(headers[k]) if k in headers else None
    return {"id": number("X-Page-ID"), "url": headers.get("WARC-Target-URI"),
            "payload_bytes": length, "payload_digest": digest,
            "record_type": headers["WARC-Type"], "refers_to": number("X-Refers-To-Page-ID"),
            "payload": None if revisit else payload}


def read_archives(spark: SparkSession, out_dir: str, payloads: bool = True,
                  batch_bytes: int = 8 << 20) -> DataFrame:
    """One row per page record of the files in the manifest, digests checked."""
    files = spark.read.parquet(f"{out_dir}/manifest").select("name")
    files = files.repartition(max(1, files.count()))

    def read(batches):
        store, root = file_system(out_dir)
        for b in batches:
            for name in b.column(0).to_pylist():
                rows, size = [], 0
                with store.open_input_stream(posixpath.join(root, name), compression=None) as f:
                    for raw in members(f):
                        headers, block = parse_record(raw)
                        if headers["WARC-Type"] == "warcinfo":
                            continue
                        rows.append(_page(headers, block))
                        if not payloads:
                            rows[-1]["payload"] = None
                        size += len(raw)
                        if size >= batch_bytes:
                            yield pa.RecordBatch.from_pylist(rows, schema=RECORDS_ARROW)
                            rows, size = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema=RECORDS_ARROW)

    return files.mapInArrow(read, RECORDS)
