"""WARC archives of pages: a deterministic sharded writer with revisit records, and the reader."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prefspark.session import settle, work_path

#: Payload bytes of a shard, which one task writes.
SHARD_BYTES = 32 * 2**20
#: A file is closed once it holds this many compressed bytes.
ROLL_BYTES = 4 * 2**20
#: Keys that the driver holds to cut shards: so many, or so many a shard where that is more.
CUT_KEYS, CUT_KEYS_PER_SHARD = 20_000, 8
DATE = "1970-01-01T00:00:00Z"
LEVEL = 6
CHUNK = 2**20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "shard int, seq int, temporary string, path string, records bigint, bytes bigint, sha256 string"
_NAMESPACE = uuid.UUID("5a3e9c5e-6c5b-5d0f-9b1e-0d6f7c1f4a10")


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode("ascii")


def record_id(page_id: int | None, digest: str, copy: int = 0) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'{page_id}:{digest}:{copy}')}>"


def _line(text: str) -> str:
    """A header value: control characters are percent-encoded, so it stays one line."""
    return "".join(c if c >= " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in text)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, copy: int = 0) -> bytes:
    """One WARC record with its headers and digests; a revisit carries the HTTP header alone."""
    digest = payload_digest(payload)
    block = (
        f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    ).encode("ascii")
    headers = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", record_id(page_id, digest, copy)),
        ("WARC-Date", DATE),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
    ]
    if url is not None:
        headers.append(("WARC-Target-URI", _line(url)))
    if page_id is not None:
        headers.append(("X-Page-Id", str(page_id)))
    if refers_to is None:
        block += payload
    else:
        headers += [
            ("WARC-Profile", PROFILE),
            ("WARC-Refers-To", record_id(refers_to, digest)),
            ("X-Refers-To-Page", str(refers_to)),
        ]
    headers += [
        ("WARC-Block-Digest", f"sha1:{payload_digest(block)}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + "\r\n"
    return head.encode("utf-8") + block + b"\r\n\r\n"


class _RollingFile:
    """Files of one shard: each is written under a temporary name and described by a manifest row."""

    def __init__(self, root: str, shard: int, roll_bytes: int):
        self.filesystem, self.base = fs.FileSystem.from_uri(root)
        self.shard, self.roll_bytes, self.seq, self.stream = shard, roll_bytes, 0, None

    def write(self, data: bytes) -> Iterator[dict]:
        if self.stream is None:
            self.temporary = f"{self.base}/_temporary/{uuid.uuid4().hex}.part"
            self.stream = self.filesystem.open_output_stream(self.temporary, compression=None)
            self.records, self.bytes, self.sha = 0, 0, hashlib.sha256()
        packed = zlib.compress(data, LEVEL, wbits=31)
        self.stream.write(packed)
        self.sha.update(packed)
        self.records += 1
        self.bytes += len(packed)
        if self.bytes >= self.roll_bytes:
            yield from self.close()

    def close(self) -> Iterator[dict]:
        if self.stream is not None:
            self.stream.close()
            self.stream = None
            yield {
                "shard": self.shard,
                "seq": self.seq,
                "temporary": self.temporary,
                "path": f"{self.base}/pages-{self.shard:05d}-{self.seq:05d}.warc.gz",
                "records": self.records,
                "bytes": self.bytes,
                "sha256": self.sha.hexdigest(),
            }
            self.seq += 1


def _place(page_id: Column, key: Column) -> Column:
    """Position of a record as text that sorts like (id, digest of the payload), without an id first."""
    shifted = (page_id.cast("decimal(20,0)") + F.lit(str(2**63)).cast("decimal(20,0)")).cast("string")
    return F.concat(F.coalesce(F.lpad(shifted, 20, "0"), F.lit("")), key)


def _cuts(keyed: DataFrame, shard_bytes: int) -> list[str]:
    """Places at which all shards but the first begin, from a hash-ordered sample: the same on every run, even in bytes."""
    held = keyed.agg(F.sum("payload_bytes").alias("bytes"), F.count(F.lit(1)).alias("rows")).first()
    shards = max(1, -(-(held.bytes or 0) // shard_bytes))
    wanted = max(CUT_KEYS, CUT_KEYS_PER_SHARD * shards)
    drawn = keyed.select(_place(F.col("page_id"), F.col("key")).alias("place"), "payload_bytes").withColumn("h", F.xxhash64("place"))
    if held.rows > 2 * wanted:
        # About twice the sample passes, so that not every task sends that many rows to the driver.
        drawn = drawn.where(F.col("h") < -(2**63) + int(2**64 * (2 * wanted / held.rows)))
    sample = sorted((r.place, r.payload_bytes) for r in drawn.orderBy("h", "place").limit(wanted).collect())
    # A record weighs at least one byte, so that empty payloads are dealt as well.
    weights = np.cumsum([max(size, 1) for _, size in sample])
    ends = {int(i) for i in np.searchsorted(weights, [weights[-1] * n / shards for n in range(1, shards)])} if sample else set()
    return sorted({sample[i][0] for i in ends} - {place for place, _ in sample[:1]})


def _shard_of(place: Column, cuts: list[str]) -> Column:
    """Number of cuts at or before a place, by binary search."""
    if not cuts:
        return F.lit(0)
    known = np.array(cuts, dtype="S84")

    def search(places: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(known, places.to_numpy().astype("S84"), side="right").astype(np.int32))

    return F.pandas_udf(search, "int")(place)


def _committed(manifest: DataFrame, root: str) -> DataFrame:
    """Give every file its final name; a repeated task finds the work done."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, _ = fs.FileSystem.from_uri(root)
        for batch in batches:
            for row in batch.to_pylist():
                if filesystem.get_file_info(row["temporary"]).type == fs.FileType.File:
                    filesystem.move(row["temporary"], row["path"])
                if filesystem.get_file_info(row["path"]).size != row["bytes"]:
                    raise OSError(f"{row['path']} is not the file of its manifest row")
            yield batch

    return settle(manifest.mapInArrow(run, MANIFEST), "warc_manifest")


def write_archives(
    df: DataFrame,
    root: str | None = None,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    min_bytes: int = 0,
    shard_bytes: int = SHARD_BYTES,
    roll_bytes: int = ROLL_BYTES,
) -> DataFrame:
    """Write a record for every row below ``root`` (a folder that executors share) and return the manifest.

    Of rows with equal payloads of at least ``min_bytes`` bytes that with the largest id holds the payload, the others
    are revisits of it. Equality goes by SHA-256, combined inside each task before the shuffle. Shards are ranges of
    (id, digest) of about ``shard_bytes`` payload bytes each, however many there are, so rows without an id or of one id are dealt
    by their payloads; only rows equal in both meet in one task. Rows are range-sorted, and a row's reference travels as a row of its
    own that sorts just before it, so payloads are shuffled once. A task streams one record at a time and remembers one digest.

    The driver holds eight keys of about 100 bytes a shard: for 100 TB pass ``shard_bytes`` and ``roll_bytes`` of a GiB or so.

    Files are named by shard and number. They are written under temporary names; Spark's own commit of the manifest
    decides which attempt of a task counts, and only its files get their names. Attempts that were lost leave temporary
    files only, and these are removed at the end. The same rows give the same bytes in the same files.

    Null payload is empty; null url gives no URI; null ids go to the first shards and are revisits where another row has
    an id. Rows that repeat the id and payload of a response are responses too. No rows in, no files. Other columns are
    ignored.
    """
    spark = df.sparkSession
    root = root or work_path(spark, "warc")
    filesystem, base = fs.FileSystem.from_uri(root)
    filesystem.create_dir(f"{base}/_temporary", recursive=True)
    pages = df.select(
        F.col(id_col).cast("long").alias("page_id"),
        F.col(url_col).cast("string").alias("url"),
        F.coalesce(F.col(payload_col), F.lit("")).cast("binary").alias("payload"),
    )
    keyed = settle(
        pages.select(
            "page_id", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("key")
        ),
        "warc_keys",
    )
    keepers = settle(
        keyed.where(F.col("payload_bytes") >= min_bytes)
        .groupBy("key")
        .agg(F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .select("key", "keeper"),
        "warc_keepers",
    )
    cuts = _cuts(keyed, shard_bytes)
    references = (
        keyed.join(keepers, "key")
        .where(~F.col("page_id").eqNullSafe(F.col("keeper")))
        .select("page_id", "key", "keeper")
        .distinct()
    )
    rows = pages.select(
        "page_id",
        F.lit(1).alias("role"),
        "url",
        "payload",
        F.sha2("payload", 256).alias("key"),
        F.lit(None).cast("long").alias("keeper"),
    ).unionByName(references.withColumn("role", F.lit(0)), allowMissingColumns=True)
    ordered = (
        rows.withColumn("shard", _shard_of(_place(F.col("page_id"), F.col("key")), cuts))
        .repartitionById(len(cuts) + 1, F.col("shard"))
        .sortWithinPartitions("shard", "page_id", "key", "role", "url")
        .select("shard", "page_id", "role", "url", "payload", "key", "keeper")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, current, refers_to, copy = None, None, None, -1
        done: list[dict] = []
        for batch in batches:
            for shard, page_id, role, url, payload, key, keeper in zip(*(c for c in batch.columns)):
                shard, page_id = shard.as_py(), page_id.as_py()
                if out is None or out.shard != shard:
                    done.extend(out.close() if out else ())
                    out = _RollingFile(root, shard, roll_bytes)
                if (page_id, key.as_py()) != current:
                    current, refers_to, copy = (page_id, key.as_py()), None, -1
                if role.as_py() == 0:
                    refers_to = keeper.as_py()
                    continue
                copy += 1
                data = record(page_id, url.as_py(), payload.as_py(), refers_to, copy)
                done.extend(out.write(data))
        done.extend(out.close() if out else ())
        fields = [f.split(" ")[0] for f in MANIFEST.split(", ")]
        types = [pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        columns = [pa.array([row[f] for row in done], t) for f, t in zip(fields, types)]
        yield pa.RecordBatch.from_arrays(columns, names=fields)

    written = settle(ordered.mapInArrow(run, MANIFEST), "warc_written")
    manifest = _committed(written, root)
    filesystem.delete_dir(f"{base}/_temporary")
    return manifest


def _members(stream) -> Iterator[bytes]:
    """Uncompressed gzip members of a file, one at a time."""
    unpack, parts, rest = zlib.decompressobj(wbits=31), [], b""
    while True:
        data = rest or stream.read(CHUNK)
        if not data:
            if parts:
                raise ValueError("the archive ends inside a record")
            return
        parts.append(unpack.decompress(data))
        rest = unpack.unused_data
        if unpack.eof:
            yield b"".join(parts)
            unpack, parts = zlib.decompressobj(wbits=31), []


def parse(data: bytes) -> dict:
    """Fields of a record; raises where a payload does not have the digest of its header."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    headers = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(headers["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in http.decode("ascii").split("\r\n")[1:])
    digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
    response = headers["WARC-Type"] == "response"
    if response and payload_digest(payload) != digest:
        raise ValueError(f"payload of {headers['WARC-Record-ID']} does not match its digest")
    number = lambda name: int(headers[name]) if name in headers else None
    return {
        "page_id": number("X-Page-Id"),
        "url": headers.get("WARC-Target-URI"),
        "payload_bytes": int(fields["Content-Length"]),
        "payload_digest": digest,
        "record_type": headers["WARC-Type"],
        "refers_to": number("X-Refers-To-Page"),
        "payload": payload if response else None,
    }


def read_archives(spark: SparkSession, manifest: DataFrame, root: str, with_payload: bool = True) -> DataFrame:
    """Records of the files in a manifest: ids, digests, kinds, references and, on request, the payloads of responses.

    One row of the manifest is one file; tasks stream files member by member and check every payload's digest.
    """
    types = {
        "page_id": (pa.int64(), "bigint"),
        "url": (pa.string(), "string"),
        "payload_bytes": (pa.int64(), "bigint"),
        "payload_digest": (pa.string(), "string"),
        "record_type": (pa.string(), "string"),
        "refers_to": (pa.int64(), "bigint"),
    } | ({"payload": (pa.binary(), "binary")} if with_payload else {})
    schema = pa.schema([(name, kind) for name, (kind, _) in types.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, _ = fs.FileSystem.from_uri(root)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                held, size = [], 0
                with filesystem.open_input_stream(path, compression=None) as stream:
                    for data in _members(stream):
                        held.append(parse(data))
                        size += len(data)
                        if size >= 8 * CHUNK or len(held) >= 5_000:
                            yield pa.RecordBatch.from_pylist(held, schema)
                            held, size = [], 0
                yield pa.RecordBatch.from_pylist(held, schema)

    files = max(1, manifest.count())
    paths = manifest.select("path").repartition(min(files, 10_000), "path")
    return paths.mapInArrow(run, ", ".join(f"{name} {sql}" for name, (_, sql) in types.items()))
