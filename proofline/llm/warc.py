"""Operator 3: WARC archives, written with an index and read back through it.

Method. Payload digests are grouped first, so that of equal payloads (of at least `min_bytes`) the one with the largest
page_id is written as a response and the others as revisits of it; only rows' digests and counts are grouped, payloads are not. Every worker writes one archive of gzip members and
gives an index row per record: path, offset, length, URL and digest. Reading sorts the selected index rows by path and
offset, coalesces near ranges into one read each, and parses the members.

Defined cases: a null html is an empty payload; a null url leaves WARC-Target-URI out; a null page_id ranks below any
other and is read back as null; of rows that repeat both page_id and payload one is the response, the others revisit it;
an empty table gives no archive.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofline.llm._common import Out, buckets, materialise, new_path, rows_of
from proofline.llm.sstable import file_system
from proofline.operators import skew

INDEX = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("url", pa.string()), ("payload_digest", pa.string()), ("page_id", pa.int64()), ("record_type", pa.string())])
RECORD = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("payload", pa.binary())])
GAP, READ_BYTES, REPEATS = 1 << 16, 4 << 20, 100_000


def record_id(page_id: int | None, digest: str, place: str = "") -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(f'{page_id} {digest} {place}'.encode()).digest())}>"


def record(page_id: int | None, url: str | None, payload: bytes | None, size: int, digest: str, refers: tuple[int | None] | None, place: str, date: str) -> bytes:
    """One WARC record; refers holds the response's page_id for a revisit, place what tells it from records of equal page_id and payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if refers else http + payload
    head = [("WARC-Type", "revisit" if refers else "response"), ("WARC-Record-ID", record_id(page_id, digest, place)), ("WARC-Date", date), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(block)), ("WARC-Payload-Digest", f"sha1:{digest}")]
    if url is not None:
        head.append(("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")))
    if page_id is not None:
        head.append(("X-Page-Id", page_id))
    if refers:
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(refers[0], digest))]
        if refers[0] is not None:
            head.append(("X-Refers-To-Page-Id", refers[0]))
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode("utf-8", "surrogatepass") + b"\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers and payload of a record."""

    def split(block: bytes) -> tuple[dict[str, str], bytes]:
        head, _, rest = block.partition(b"\r\n\r\n")
        lines = head.decode("utf-8", "surrogatepass").split("\r\n")[1:]
        return dict(x.split(": ", 1) for x in lines), rest

    head, rest = split(data)
    http, payload = split(rest[: int(head["Content-Length"])])
    return head, http, payload


def groups_of(base: DataFrame, min_bytes: int) -> DataFrame:
    """Per payload of at least `min_bytes`: its rows, the response's page_id (keeper) and url (its hash), and how many rows have both."""
    each = base.where(F.col("size") >= min_bytes).groupBy("sha", "page_id", "url_sha").agg(F.count("*").alias("n"))
    order = F.struct(F.col("page_id").isNull(), F.bitwise_not("page_id"), "url_sha")  # the largest page_id first, null last
    best = each.groupBy("sha").agg(F.sum("n").alias("rows"), F.min_by(F.struct("page_id", "url_sha", "n"), order).alias("best"))
    return best.select("sha", "rows", F.col("best.page_id").alias("keeper"), F.col("best.url_sha").alias("keeper_url"), F.col("best.n").alias("alike"))


def decided(base: DataFrame, min_bytes: int) -> DataFrame:
    """Rows of `base` as they are written: page_id, url, payload (null for revisits), size, sha, first, revisits, refers_to.

    Payloads with many rows are joined with their decision by a broadcast of fixed size, so no task gets all rows of one.
    Rows that equal a response in page_id, url and payload are counted before they are shuffled, and dealt out again.
    """
    groups = materialise(groups_of(base, min_bytes), "warc-groups")
    total, ties = groups.agg(F.coalesce(F.sum("rows"), F.lit(0)), F.coalesce(F.max("alike"), F.lit(0))).first()
    hot = groups.where(F.col("rows") >= max(skew.LEAST, -(-total // skew.MOST)))  # at most skew.MOST rows
    if hot.isEmpty():
        joined = base.join(groups, "sha", "left")
    else:
        usual = base.join(F.broadcast(hot.select("sha")), "sha", "left_anti").join(groups, "sha", "left")
        joined = base.join(F.broadcast(hot), "sha").unionByName(usual)
    first = F.col("alike").isNotNull() & F.col("page_id").eqNullSafe(F.col("keeper")) & F.col("url_sha").eqNullSafe(F.col("keeper_url"))
    joined = joined.withColumns({"first": first, "revisits": F.col("alike").isNotNull() & ~first})
    columns = ["page_id", "url", F.when(~F.col("revisits"), F.col("payload")).alias("payload"), "size", "sha", "first", "revisits", F.col("keeper").alias("refers_to")]
    if ties <= 1:
        return joined.select(*columns)
    same = joined.where("first and alike > 1").groupBy("sha", "page_id", "url", "keeper", "size", "alike")
    one = same.agg(F.first("payload").alias("payload")).withColumns({"first": F.lit(True), "revisits": F.lit(False)})
    parts = same.agg(F.lit(0)).withColumn("part", F.explode(F.sequence(F.lit(0), F.floor((F.col("alike") - 2) / REPEATS)))).repartition(buckets(base.sparkSession))
    others = parts.withColumn("i", F.explode(F.sequence(F.lit(1), F.least(F.lit(REPEATS), F.col("alike") - 1 - F.col("part") * REPEATS))))
    others = others.withColumns({"payload": F.lit(None).cast("binary"), "first": F.lit(False), "revisits": F.lit(True)})
    return joined.where("not (first and alike > 1)").select(*columns).unionByName(one.select(*columns)).unionByName(others.select(*columns))


def write(pages: DataFrame, path: str | None = None, min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write `pages(page_id, url, html)` as archives; returns their index, written and read back."""
    path = path or new_path(pages.sparkSession, "warc")
    html = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    base = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), html.alias("payload"))
    rows = decided(base.withColumns({"sha": F.sha1("payload"), "size": F.length("payload"), "url_sha": F.sha1(F.col("url").cast("binary"))}), min_bytes)

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, folder = file_system(path)
        sink, at, out = None, 0, Out(INDEX)
        for page_id, url, payload, size, sha, first, revisits, refers_to in rows_of(batches, "page_id", "url", "payload", "size", "sha", "first", "revisits", "refers_to"):
            if sink is None:
                files.create_dir(folder, recursive=True)
                name = f"{path}/{uuid.uuid4().hex}.warc.gz"
                sink = files.open_output_stream(f"{folder}/{name.rpartition('/')[2]}", compression=None)
            digest = base64.b32encode(bytes.fromhex(sha)).decode()
            squeeze = zlib.compressobj(1, zlib.DEFLATED, 31)
            data = squeeze.compress(record(page_id, url, payload, size, digest, (refers_to,) if revisits else None, "" if first else f"{name} {at}", date)) + squeeze.flush()
            sink.write(data)
            out.add(name, at, len(data), url, digest, page_id, "revisit" if revisits else "response")
            at += len(data)
            yield from out.ready()
        if sink:
            sink.close()
        yield from out.ready(force=True)

    return materialise(rows.mapInArrow(save, "path string, offset long, length long, url string, payload_digest string, page_id long, record_type string"), "warc-index")


def ranges(places: Iterable[tuple[int, int]], gap: int = GAP, most: int = READ_BYTES) -> Iterator[tuple[int, int, list[tuple[int, int]]]]:
    """Sorted (offset, length) as reads: start, end and the places in each."""
    held: list[tuple[int, int]] = []
    for offset, length in places:
        if held and (offset - (held[-1][0] + held[-1][1]) > gap or offset + length - held[0][0] > most):
            yield held[0][0], held[-1][0] + held[-1][1], held
            held = []
        held.append((offset, length))
    if held:
        yield held[0][0], held[-1][0] + held[-1][1], held


def read(index: DataFrame, keep_payload: bool = False) -> DataFrame:
    """The records that rows of an index point to. index(path, offset, length)."""
    chosen = index.select("path", "offset", "length").repartition(buckets(index.sparkSession), "path").sortWithinPartitions("path", "offset")

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Out(RECORD, 256 if keep_payload else 4096)
        for path, rows in groupby(rows_of(batches, "path", "offset", "length"), key=lambda r: r[0]):
            files, at = file_system(path)
            with files.open_input_file(at) as source:
                for start, end, places in ranges((r[1], r[2]) for r in rows):
                    source.seek(start)
                    data = source.read(end - start)
                    for offset, length in places:
                        head, http, payload = parse(zlib.decompress(data[offset - start : offset - start + length], 31))
                        digest, kind = head["WARC-Payload-Digest"].removeprefix("sha1:"), head["WARC-Type"]
                        if kind == "response" and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                            raise ValueError(f"{path}: the record at {offset} is damaged")
                        whole = {k: int(head[k]) if k in head else None for k in ("X-Page-Id", "X-Refers-To-Page-Id")}
                        out.add(whole["X-Page-Id"], int(http["Content-Length"]), digest, kind, whole["X-Refers-To-Page-Id"], head.get("WARC-Target-URI"), payload if keep_payload and kind == "response" else None)
                    yield from out.ready()
        yield from out.ready(force=True)

    return chosen.mapInArrow(load, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary")
