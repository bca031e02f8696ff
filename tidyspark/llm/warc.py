"""WARC archives with a two-level capture index.

Writing: each task writes one archive of gzip members, one a record; of records with equal payloads (of at least
``min_revisit_bytes``) the one with the smallest id is a response and the others are revisits that name it.

Index: capture keys (reversed-host URL, then id) are range-sorted; each partition packs its lines into compressed
blocks in one shard file and writes a sparse directory (first key, offset and length of each block).  A shard list
(first key of each shard) is the upper level.

Lookup: keys are sorted, found by binary search in the shard list, in the shard's directory and in the block, which is
one range read; the records are then range-read archive by archive in offset order.

Files go to the folder in ``spark.checkpoint.dir`` through pyarrow file systems (local, HDFS, object stores).  A task
that is run again writes files of another name and only the files of the attempt that committed are in the index, which
is a written table; so lost executors cost a retry and no wrong answer.

Defined cases: a null html is an empty payload; a null or schemeless URL is its own text (or empty) as key; pages equal
in id and payload to the response are responses as well (repeated rows are all kept); a null id never is the smallest
unless all are null; other columns aren't read; an empty table gives empty archives and no rows.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import io
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, col, join_hot, new_folder, read

BLOCK_LINES = 3000
#: Neighbouring records are fetched by one range read of at most this many bytes.
READ_BYTES = 4 << 20
#: Compressed bytes of records that one task reads back.
FETCH_BYTES = 32 << 20
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"


def surt(url: str | None) -> str:
    """Reversed-host key: ``http://www.a.com:80/p?q`` becomes ``com,a,www:80)/p?q``."""
    m = re.match(r"[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)([^#]*)", url or "")
    if not m:
        return url or ""
    host, _, port = m[1].rpartition("@")[2].lower().partition(":")
    return ",".join(reversed(host.split("."))) + (f":{port}" if port else "") + ")" + (m[2] or "/")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _open(root: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(root if "://" in root else f"file://{root}")


def _gzip(data: bytes) -> bytes:
    c = zlib.compressobj(6, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def _gunzip(data: bytes) -> tuple[bytes, int]:
    """First gzip member and its compressed length."""
    d = zlib.decompressobj(31)
    return d.decompress(data), len(data) - len(d.unused_data)


def _record(url: str, page_id: str, payload: bytes, sha: str, refers: str | None) -> bytes:
    """One WARC/1.1 record; a revisit carries the HTTP head only, whose Content-Length is the payload's."""
    clean = re.sub(r"[\r\n]+", "%0A", url)
    body = _HTTP % len(payload) + (payload if refers is None else b"")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers is None else 'revisit'}", f"WARC-Target-URI: {clean}", f"WARC-Date: {DATE}", f"WARC-Record-ID: <urn:capture:{page_id}>", f"WARC-Payload-Digest: sha1:{sha}"]
    if refers is not None:
        head += [f"WARC-Refers-To: <urn:capture:{refers}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """Record type, id, digest, reference, payload (None for a revisit) and payload length."""
    head, _, body = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    http, _, payload = body[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    name = lambda x: x and x[len("<urn:capture:") : -1]
    revisit = fields["WARC-Type"] == "revisit"
    return {"type": fields["WARC-Type"], "id": name(fields["WARC-Record-ID"]), "digest": fields["WARC-Payload-Digest"].removeprefix("sha1:"), "refers": name(fields.get("WARC-Refers-To")), "payload": None if revisit else payload, "size": size, "url": fields["WARC-Target-URI"]}


def revisits(pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """(page_id, url, html): adds ``refers_to``, the id of the response a page revisits, or null."""
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    keyed = pages.withColumn("sha", F.sha1(body)).withColumn("long_enough", F.octet_length(body) >= min_revisit_bytes)
    first = keyed.filter("long_enough").groupBy("sha").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
    # payloads seen once need no partner; the others are few next to the pages
    first = first.filter("n > 1")
    joined = join_hot(keyed, checkpoint(first), ["sha"], F.xxhash64("page_id", "url"), "n")
    refers = F.when(F.col("long_enough") & ~F.col("first_id").eqNullSafe(F.col("page_id")), F.col("first_id"))
    return joined.select("page_id", "url", "html", refers.alias("refers_to"))


@dataclass
class Archive:
    """Where an archive set lies: ``root`` with warc/ and index/, and the shard list."""

    root: str
    shards: list[tuple[tuple[str, str], str]]  # (first key, shard name), sorted

    def locate(self, fs: pafs.FileSystem, base: str, keys: Iterator[tuple[int, tuple[str, str]]]) -> Iterator[tuple[int, str, int, int]]:
        """(tag, archive, offset, length) of every capture of each key; keys come sorted, so each block is read once."""
        firsts = [k for k, _ in self.shards]
        shard, directory, starts, held, lines, names = None, [], [], None, [], []
        for tag, key in keys:
            at = max(0, bisect.bisect_left(firsts, key) - 1)
            for s in range(at, len(firsts)):
                if firsts[s] > key:
                    break
                if shard != s:
                    with fs.open_input_stream(f"{base}/index/{self.shards[s][1]}.dir") as f:
                        directory = [json.loads(x) for x in f.read().decode("utf-8", "surrogatepass").splitlines()]
                    starts, shard, held = [(d[0], d[1]) for d in directory], s, None
                b = max(0, bisect.bisect_left(starts, key) - 1)
                for k in range(b, len(directory)):
                    if starts[k] > key:
                        break
                    if held != (s, k):
                        with fs.open_input_file(f"{base}/index/{self.shards[s][1]}.blocks") as f:
                            raw = f.read_at(directory[k][3], directory[k][2])
                        lines = [json.loads(x) for x in _gunzip(raw)[0].decode("utf-8", "surrogatepass").splitlines()]
                        names, held = [(x[0], x[1]) for x in lines], (s, k)
                    for i in range(bisect.bisect_left(names, key), len(names)):
                        if names[i] != key:
                            break
                        yield tag, lines[i][2], lines[i][3], lines[i][4]


def _id_text(v) -> str:
    return "" if v is None else str(v)


def write_archive(pages: DataFrame, block_lines: int = BLOCK_LINES, min_revisit_bytes: int = 0) -> Archive:
    """Write (page_id, url, html, ...) as WARC with its capture index."""
    spark = pages.sparkSession
    root = new_folder(spark, "warc")
    rows = revisits(pages.select(col("page_id"), col("url").cast("string").alias("url"), col("html").cast("string").alias("html")), min_revisit_bytes)
    has = F.col("refers_to").isNotNull()
    rows = rows.select(F.col("page_id").cast("string").alias("page_id"), "url", "html", F.when(has, F.col("refers_to").cast("string")).alias("refers_to"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _open(root)
        fs.create_dir(f"{base}/warc", recursive=True)
        name = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
        at = 0
        with fs.open_output_stream(f"{base}/warc/{name}", compression=None) as out:
            for batch in batches:
                lines = []
                for pid, url, html, ref in zip(*(batch.column(i) for i in range(4))):
                    payload = (html.as_py() or "").encode("utf-8", "surrogatepass")
                    raw = _gzip(_record(url.as_py() or "", _id_text(pid.as_py()), payload, digest(payload), ref.as_py()))
                    out.write(raw)
                    lines.append((surt(url.as_py()), _id_text(pid.as_py()), name, at, len(raw)))
                    at += len(raw)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*lines) if lines else [[]] * 5, (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()))], names=["k", "id", "file", "at", "length"])

    lines = checkpoint(rows.mapInArrow(write, "k string, id string, file string, at bigint, length bigint"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _open(root)
        fs.create_dir(f"{base}/index", recursive=True)
        name = f"shard-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"
        directory, block, at, first = [], [], 0, None
        with fs.open_output_stream(f"{base}/index/{name}.blocks", compression=None) as out:

            def flush() -> int:
                raw = _gzip("".join(json.dumps(x) + "\n" for x in block).encode())
                out.write(raw)
                directory.append([block[0][0], block[0][1], at, len(raw)])
                block.clear()
                return at + len(raw)

            for batch in batches:
                for row in zip(*(batch.column(i).to_pylist() for i in range(5))):
                    first = first or row[:2]
                    block.append(row)
                    if len(block) == block_lines:
                        at = flush()
            if block:
                at = flush()
        with fs.open_output_stream(f"{base}/index/{name}.dir", compression=None) as out:
            out.write("".join(json.dumps(x) + "\n" for x in directory).encode())
        if first is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.string()) for x in (first[0], first[1], name)], names=["k", "id", "shard"])

    # UTF-8 order and Python's order of strings are both by code point
    shards = lines.repartitionByRange("k", "id").sortWithinPartitions("k", "id").mapInArrow(pack, "k string, id string, shard string")
    found = sorted(((r.k, r.id), r.shard) for r in checkpoint(shards).collect())  # one row a shard
    return Archive(root, found)


def read_captures(archive: Archive, keys: DataFrame, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """Records of the captures with the keys' (URL, id): page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload.

    Each distinct key is looked up once and gives all its captures.
    """
    spark, kind = keys.sparkSession, keys.schema[page_id].dataType.simpleString()

    def key_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([surt(u) for u in batch.column(1).to_pylist()], pa.string()), pa.array([_id_text(i) for i in batch.column(0).to_pylist()], pa.string())], names=["k", "id"])

    wanted = keys.select(col(page_id).cast("string").alias("i"), col(url).cast("string").alias("u")).mapInArrow(key_rows, "k string, id string").distinct()

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _open(archive.root)
        for batch in batches:
            got = list(archive.locate(fs, base, enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))))
            yield pa.RecordBatch.from_arrays([pa.array([g[j] for g in got], t) for j, t in ((1, pa.string()), (2, pa.int64()), (3, pa.int64()))], names=["file", "at", "length"])

    places = wanted.repartitionByRange("k", "id").sortWithinPartitions("k", "id").mapInArrow(find, "file string, at bigint, length bigint")

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _open(archive.root)
        name, f = None, None
        for batch in batches:
            todo = list(zip(*(batch.column(i).to_pylist() for i in range(3))))
            i = 0
            while i < len(todo):
                j = i + 1  # neighbours of one archive, up to READ_BYTES
                while j < len(todo) and todo[j][0] == todo[i][0] and todo[j][1] <= todo[j - 1][1] + todo[j - 1][2] and todo[j][1] + todo[j][2] - todo[i][1] <= READ_BYTES:
                    j += 1
                if name != todo[i][0]:
                    name, f = todo[i][0], fs.open_input_file(f"{base}/warc/{todo[i][0]}")
                raw = f.read_at(todo[j - 1][1] + todo[j - 1][2] - todo[i][1], todo[i][1])
                records = [parse_record(_gunzip(raw[o - todo[i][1] : o - todo[i][1] + n])[0]) for _, o, n in todo[i:j]]
                for r in records:
                    if r["payload"] is not None and (digest(r["payload"]) != r["digest"] or len(r["payload"]) != r["size"]):
                        raise OSError(f"damaged record {r['id']} in {name}")
                cols = [[r[k] for r in records] for k in ("id", "url", "size", "digest", "type", "refers", "payload")]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary()))], names=["id", "url", "payload_bytes", "payload_digest", "record_type", "refers", "payload"])
                i = j

    # as many parts as the records' bytes ask for: the index rows are too small to tell
    places = checkpoint(places)
    n, total = places.agg(F.count(F.lit(1)), F.sum("length")).first()
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    got = places.repartitionByRange(max(1, min(n, max(least, (total or 0) // FETCH_BYTES + 1))), "file", "at").sortWithinPartitions("file", "at").mapInArrow(fetch, "id string, url string, payload_bytes bigint, payload_digest string, record_type string, refers string, payload binary")
    back = lambda c: F.when(F.col(c) != "", F.col(c)).cast(kind)
    return got.select(back("id").alias("page_id"), "url", "payload_bytes", "payload_digest", "record_type", back("refers").alias("refers_to"), "payload")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    archive = write_archive(pages)
    return read_captures(archive, pages).drop("payload", "url")


#: base32 by arithmetic on the hex digest: 32 digits of 5 bits
ORACLE = """with p as (select page_id, encode(coalesce(html, '')) as b from pages),
h as (select page_id, octet_length(b) as n, sha1(b) as hex from p),
d as (select page_id, n, array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(hex || '0', 1 + (5 * i) // 4, 3))::bigint >> (12 - 5 - (5 * i) % 4)) & 31)::int, 1) for i in range(32)], '') as dg from h),
m as (select dg, min(page_id) as first_id from d group by dg)
select page_id, n::bigint as payload_bytes, dg as payload_digest, case when page_id = first_id then 'response' else 'revisit' end as record_type,
  case when page_id <> first_id then first_id end as refers_to from d join m using (dg)"""
