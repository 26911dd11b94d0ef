"""WARC archives compressed with Zstandard: a writer, and the archive reader.

An archive starts with a skippable frame (magic 0x184D2A5D) that holds the dictionary, itself compressed or
plain. Then every record is one Zstandard frame made with that dictionary. The reader loads the dictionary from the
leading frame, decodes one frame at a time from a stream, and checks each record: version line, mandatory headers,
block length against ``Content-Length``, the closing blank lines, and payload and header digests.

Writing: each task writes its rows to archives of its own, named by partition and task attempt, and returns one manifest row
per archive. The manifest is stored through Spark's commit, so a lost or repeated attempt leaves files that no manifest
names. Archives are cut at ``max_archive_bytes`` of payload. A task trains its dictionary on the first
``sample_bytes`` of what it writes (a bounded sample; only the compression rate depends on it).

Equal payloads: the record with the smallest id is the response, the others are revisits of it (payloads under
``min_revisit_bytes`` are always responses). Hot payloads spread: the smallest id is a partial aggregate, and the join
back is one that Spark can split by rows.

Defined results: a null payload is the empty payload; a null id sorts after all others and is written as ``null``; rows that
repeat both the smallest id and its payload are all responses; line breaks in a URL become blanks; a null URL leaves
the header out. An empty table gives no archives and no records. A record that breaks a check becomes a row
whose ``error`` says why; what follows a broken frame in its archive cannot be located and is reported as one such row.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from articleflow.session import materialize

DICT_MAGIC = 0x184D2A5D  # fixed by the format
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ID_PREFIX, ID_SUFFIX = "<urn:page:", ">"
RECORD_SCHEMA = ("archive string, position long, record_type string, record_id string, target_uri string, "
                 "payload_bytes long, payload_digest string, refers_to string, error string, payload binary")


def _digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _clean(value: str) -> str:
    return " ".join(value.split("\r")).replace("\n", " ")


def record_bytes(kind: str, rid: str | None, date: str, url: str | None, payload: bytes, refers_to: str | None) -> bytes:
    """One WARC record; a revisit carries the HTTP header block only."""
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
            f"Content-Length: {len(payload)}\r\n\r\n").encode()
    block = http + payload if kind == "response" else http
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {ID_PREFIX}{rid}{ID_SUFFIX}", f"WARC-Date: {date}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_clean(url)}")
    if kind == "revisit":
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {ID_PREFIX}{refers_to}{ID_SUFFIX}"]
    head += [f"WARC-Payload-Digest: sha1:{_digest(payload)}", f"WARC-Block-Digest: sha1:{_digest(block)}",
             "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class _Archive:
    """One archive file: the dictionary frame, then a frame per record."""

    def __init__(self, folder: str, name: str, sample: list[bytes], level: int, dict_bytes: int):
        import zstandard as zstd
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        self.path, self.records, self.payload, self.size = f"{folder.rstrip('/')}/{name}", 0, 0, 0
        self.out = store.open_output_stream(f"{root.rstrip('/')}/{name}", compression=None)
        try:
            dictionary = zstd.train_dictionary(dict_bytes, sample)
        except zstd.ZstdError:  # too little to learn from: an archive without a dictionary
            dictionary = None
        if dictionary is not None:
            packed = zstd.ZstdCompressor(level=level).compress(dictionary.as_bytes())
            self._put(struct.pack("<II", DICT_MAGIC, len(packed)) + packed)
        self.codec = zstd.ZstdCompressor(level=level, dict_data=dictionary, write_checksum=True)

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def add(self, record: bytes) -> None:
        self._put(self.codec.compress(record))
        self.records += 1
        self.payload += len(record)

    def close(self) -> tuple[str, int, int]:
        self.out.close()
        return self.path, self.records, self.size


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url",
                   payload_col: str = "html", min_revisit_bytes: int = 0, date: str = "2024-01-01T00:00:00Z",
                   level: int = 3, dict_bytes: int = 16 << 10, sample_bytes: int = 1 << 19,
                   max_archive_bytes: int = 128 << 20) -> DataFrame:
    """Writes ``pages`` as archives under ``folder`` (a URI that all executors reach) and returns the stored manifest
    (archive, records, bytes)."""
    p = pages.select(F.col(id_col).alias("_id"), F.col(url_col).cast("string").alias("_url"),
                     F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary").alias("_payload"))
    p = p.withColumn("_sha", F.sha1("_payload")).withColumn("_len", F.octet_length("_payload"))
    copies = (p.groupBy("_sha", "_len").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
              .filter(F.col("_n") > 1).select("_sha", "_len", "_first"))
    joined = p.join(copies, ["_sha", "_len"], "left")
    again = F.col("_first").isNotNull() & ~F.col("_id").eqNullSafe(F.col("_first")) \
        & (F.col("_len") >= F.lit(min_revisit_bytes))
    rows = joined.select(F.col("_id").cast("string").alias("id"), F.col("_url").alias("url"),
                         F.col("_payload").alias("payload"),
                         F.when(again, F.col("_first").cast("string")).alias("first"), again.alias("again"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        tag, made = f"part-{task.partitionId():06d}-{task.taskAttemptId()}", 0
        archive: _Archive | None = None
        waiting: list[bytes] = []
        held, done = 0, []

        def start() -> _Archive:
            nonlocal made
            made += 1
            a = _Archive(folder, f"{tag}-{made:04d}.warc.zst", waiting, level, dict_bytes)
            for record in waiting:
                a.add(record)
            waiting.clear()
            return a

        for batch in batches:
            for i in range(batch.num_rows):  # one row at a time: a batch of long payloads is not held twice
                rid, url, payload, first, revisit = (batch.column(c)[i].as_py() for c in range(5))
                record = record_bytes("revisit" if revisit else "response", rid if rid is not None else "null", date, url,
                                      payload, first)
                if archive is None:
                    waiting.append(record)
                    held += len(record)
                    if held < sample_bytes:
                        continue
                    archive, held = start(), 0
                else:
                    archive.add(record)
                if archive.payload >= max_archive_bytes:
                    done.append(archive.close())
                    archive = None
        if archive is None and waiting:
            archive = start()
        if archive is not None:
            done.append(archive.close())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()),
                                              pa.array([d[1] for d in done], pa.int64()),
                                              pa.array([d[2] for d in done], pa.int64())],
                                             names=["archive", "records", "bytes"])

    return materialize(rows.mapInArrow(write, "archive string, records long, bytes long"), "warc-manifest")


class _Source:
    """Sequential bytes of an archive, refilled in blocks."""

    def __init__(self, stream, block: int = 1 << 20):
        self.stream, self.block, self.buf, self.at, self.base = stream, block, b"", 0, 0

    @property
    def position(self) -> int:
        return self.base + self.at

    def peek(self, n: int) -> bytes:
        while len(self.buf) - self.at < n:
            more = self.stream.read(max(self.block, n))
            if not more:
                break
            self.base += self.at
            self.buf, self.at = self.buf[self.at:] + more, 0
        return self.buf[self.at:self.at + n]

    def skip(self, n: int) -> None:
        self.at += n


def frames(stream) -> Iterator[tuple[int, bytes]]:
    """(position, decoded frame) of an archive, one frame per record; the dictionary comes from the leading frame."""
    import zstandard as zstd

    src, dictionary, first = _Source(stream), None, True
    while head := src.peek(8):
        if len(head) < 5:
            raise ValueError(f"truncated frame header at {src.position}")
        magic = struct.unpack("<I", head[:4])[0]
        if magic & 0xFFFFFFF0 == 0x184D2A50:  # a skippable frame
            if len(head) < 8:
                raise ValueError(f"truncated skippable frame at {src.position}")
            size = struct.unpack("<I", head[4:])[0]
            data = src.peek(8 + size)[8:]
            if len(data) < size:
                raise ValueError(f"truncated skippable frame at {src.position}")
            if magic == DICT_MAGIC and first:
                plain = zstd.ZstdDecompressor().decompressobj().decompress(data) if data[:4] == b"\x28\xb5\x2f\xfd" \
                    else data
                dictionary = zstd.ZstdCompressionDict(plain)
            src.skip(8 + size)
            first = False
            continue
        first, start, decoded = False, src.position, []
        codec = zstd.ZstdDecompressor(dict_data=dictionary).decompressobj()
        while not codec.eof:
            piece = src.peek(1 << 15)
            if not piece:
                raise ValueError(f"truncated frame at {start}")
            decoded.append(codec.decompress(piece))
            src.skip(len(piece) - len(codec.unused_data if codec.eof else b""))
        yield start, b"".join(decoded)


def parse_record(data: bytes) -> dict:
    """Headers and block of one record; raises ValueError where a check fails."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not gap or lines[0] not in (b"WARC/1.0", b"WARC/1.1"):
        raise ValueError("no WARC version line or header end")
    headers = {}
    for line in lines[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise ValueError("header line without a colon")
        headers[name.strip().lower().decode()] = value.strip().decode()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in headers:
            raise ValueError(f"missing header {name}")
    if not headers["content-length"].isdigit():
        raise ValueError("Content-Length is no number")
    length = int(headers["content-length"])
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise ValueError(f"block length differs from Content-Length {length}")
    block = rest[:length]
    if (d := headers.get("warc-block-digest")) and d != f"sha1:{_digest(block)}":
        raise ValueError("block digest differs")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next((int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), None)
    out = {"type": headers["warc-type"], "id": headers["warc-record-id"], "uri": headers.get("warc-target-uri"),
           "refers_to": headers.get("warc-refers-to"), "payload": payload, "bytes": len(payload),
           "digest": headers.get("warc-payload-digest", "").removeprefix("sha1:")}
    if out["type"] == "revisit":
        if out["refers_to"] is None:
            raise ValueError("revisit without WARC-Refers-To")
        return out | {"payload": None, "bytes": size}
    if size is not None and size != len(payload):
        raise ValueError("payload length differs from the HTTP header")
    if out["digest"] != _digest(payload):
        raise ValueError("payload digest differs")
    return out


def archive_paths(spark: SparkSession, folder: str) -> DataFrame:
    """(archive) of every archive under a folder; contents are not read."""
    return (spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst")
            .option("recursiveFileLookup", "true").load(folder).select(F.col("path").alias("archive")))


def read_archives(archives: DataFrame, with_payload: bool = True) -> DataFrame:
    """One row per record of the archives named by the column ``archive``."""
    names = [f.split()[0] for f in RECORD_SCHEMA.split(", ")]
    types = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    kinds = [types[f.split()[1]] for f in RECORD_SCHEMA.split(", ")]

    def pack(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard as zstd
        from pyarrow import fs

        rows: list[tuple] = []
        held = 0
        for path in (p for b in batches for p in b.column(0).to_pylist()):
            store, at = fs.FileSystem.from_uri(path)
            with store.open_input_stream(at, compression=None) as stream:
                position = 0
                try:
                    for position, data in frames(stream):
                        try:
                            r = parse_record(data)
                            rows.append((path, position, r["type"], r["id"], r["uri"], r["bytes"], r["digest"],
                                         r["refers_to"], None, r["payload"] if with_payload else None))
                        except ValueError as e:
                            rows.append((path, position, None, None, None, None, None, None, str(e), None))
                        held += len(data) if with_payload else 256
                        if held > 4 << 20:
                            yield pack(rows)
                            rows, held = [], 0
                # a frame that cannot be decoded ends its archive; a failed read fails the task, which Spark repeats
                except (zstd.ZstdError, ValueError, struct.error) as e:
                    rows.append((path, position, None, None, None, None, None, None, f"{type(e).__name__}: {e}", None))
        if rows:
            yield pack(rows)

    return archives.select(F.col("archive").cast("string")).mapInArrow(run, RECORD_SCHEMA)


def id_of(col: str, kind: str):
    """The id inside a record id, in its own type; null ids come back null."""
    text = F.substring(F.col(col), len(ID_PREFIX) + 1, 1 << 30)
    bare = F.expr(f"substring({col}, {len(ID_PREFIX) + 1}, length({col}) - {len(ID_PREFIX) + len(ID_SUFFIX)})")
    return F.when(text.isNotNull() & (bare != "null"), bare).cast(kind)
