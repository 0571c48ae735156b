"""A deterministic sharded WARC writer, and its reader.

Records are range-partitioned by identifier and sorted; each task rolls to a new file when the compressed size is reached,
regenerates headers and digests, writes under a temporary name and renames when the file is whole. The manifest is
written last, by Spark's own committer; readers take only files that it lists. A task that runs twice writes the same bytes
under the same names. Ranges begin where the exact sum of all smaller identifiers' bytes reaches a multiple of a part's, so they depend
on the data only, whatever the identifiers are.

Of records with equal payloads the one with the smallest identifier is the response. Which rows are revisits is found on
digests alone, pre-aggregated, and travels to the writer as marker rows through the same range partitioning, so payloads
are shuffled once.

Defined results: null payloads are empty; null URLs give no target header. Null identifiers sort first, and are a
response only if no other row has the payload. Of repeated rows of one identifier and payload, one is the response
and the others are revisits of that identifier. Very long payloads are written whole, each in the memory of one task; many rows of one
identifier are one part of several files. An empty table gives an empty archive. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from urllib.parse import quote

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import offsets, remove, ship, staged, text_of

#: Parts at most; bounds the list of where they begin.
PARTS = 50_000
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_NAMESPACE = uuid.UUID("5b0e7f3c-52a4-5d1c-9c1b-0d6a4c9a8e11")


def sha1_32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id, digest: str, again: int = 0) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'{page_id}/{digest}/{again}')}>"


def record(kind: str, page_id, url: str | None, payload: bytes, digest: str, date: str, again: int = 0, refers=None) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if kind == "revisit" else http + payload
    head = [("WARC-Type", kind), ("WARC-Record-ID", record_id(page_id, digest, again)), ("WARC-Date", date)]
    if url is not None:
        head.append(("WARC-Target-URI", quote(url, safe="!#$%&'()*+,/:;=?@[]~")))
    head += [("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Block-Digest", f"sha1:{sha1_32(block)}")]
    if page_id is not None:
        head.append(("X-Page-ID", str(page_id)))
    if kind == "revisit":
        head += [("WARC-Profile", _PROFILE), ("WARC-Refers-To", record_id(refers, digest))]
        if refers is not None:
            head.append(("X-Refers-To-Page-ID", str(refers)))
    head += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def info(name: str, date: str) -> bytes:
    block = b"software: helixspark\r\nformat: WARC File Format 1.1\r\n"
    head = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: {record_id(name, 'info')}\r\nWARC-Date: {date}\r\nWARC-Filename: {name}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(block)}\r\n\r\n"
    return head.encode() + block + b"\r\n\r\n"


def member(data: bytes, level: int) -> bytes:
    """A gzip member without name and time."""
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _qualified(spark: SparkSession, path: str) -> str:
    """The path with the scheme that Spark itself would take for it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    uri = p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toString()
    return f"file://{uri.removeprefix('file:')}" if uri.startswith("file:/") and not uri.startswith("file://") else uri


def _store(uri: str):
    """File system and path of a URI, for the stores that Arrow opens."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


MANIFEST = "file string, part int, roll int, n_records long, n_bytes long, sha256 string"


def _begins(slim: DataFrame, part_bytes: int) -> list[int]:
    """The smallest identifier of each part, PARTS at most. slim: id, n.

    Identifiers are sorted by ranges, of which each has its sum; a range then only needs the sum of those before it.
    """
    spark = slim.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sizes = slim.filter("id IS NOT NULL").groupBy("id").agg(F.sum(F.col("n") + 512).alias("size"))
    sizes = staged(sizes.repartitionByRange(ranges, "id").withColumn("range", F.spark_partition_id().cast("long")), "warc-sizes")
    totals = sizes.groupBy("range").agg(F.sum("size").alias("sum"))
    part_bytes = max(part_bytes, (totals.agg(F.sum("sum")).first()[0] or 0) // PARTS)
    before = offsets(totals, "range", "sum", "before").select("range", "before")
    own = Window.partitionBy("range").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("own", F.coalesce(F.sum("size").over(own), F.lit(0))).join(before, "range")
    part = F.floor((F.col("before") + F.col("own")) / part_bytes)
    found = sizes.groupBy(part.alias("part")).agg(F.min("id").alias("id")).collect()
    return sorted(r.id for r in found)


def write_archives(
    pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", file_bytes: int = 256 << 20, part_bytes: int = 16 << 20, least_revisit: int = 0, date: str = "2024-01-01T00:00:00Z", level: int = 6
) -> DataFrame:
    """Write path/*.warc.gz and path/_manifest, which is returned. least_revisit: bytes of payload from which copies are revisits."""
    spark = pages.sparkSession
    ship(spark)
    path = _qualified(spark, path)
    payload = F.encode(text_of(payload_col), "UTF-8")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    slim = rows.select("id", F.unhex(F.sha1("payload")).alias("digest"), F.octet_length("payload").alias("n"), F.pmod(F.xxhash64("id"), F.lit(16)).alias("salt"))
    entries = slim.filter(F.col("n") >= least_revisit).groupBy("salt", "digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    total = entries.groupBy("digest").agg(F.min("first").alias("first"), F.sum("n").alias("n")).filter("n > 1").drop("n")
    copies = entries.select("salt", "digest").join(total, "digest")
    marks = slim.join(copies, ["salt", "digest"]).filter("id > first OR (id IS NULL AND first IS NOT NULL)").select("id", "digest", "first").distinct()

    starts = np.array(_begins(slim, part_bytes), dtype=np.int64)

    @F.pandas_udf("int")
    def part_of(ids: pd.Series) -> pd.Series:
        known = ids.notna().to_numpy()
        out = np.zeros(len(ids), dtype=np.int32)
        out[known] = np.maximum(np.searchsorted(starts, ids[known].astype("int64").to_numpy(), "right") - 1, 0)
        return pd.Series(out)

    both = rows.withColumn("kind", F.lit(1)).withColumn("first", F.lit(None).cast("long")).withColumn("digest", F.lit(None).cast("binary"))
    both = both.unionByName(marks.withColumn("kind", F.lit(0)), allowMissingColumns=True)
    both = both.withColumn("part", part_of(F.col("id").cast("string")))  # as text, for null makes numbers of pandas inexact
    both = both.repartitionById(max(1, len(starts)), F.col("part")).sortWithinPartitions("part", "id", "kind", "url", "digest", F.sha1("payload"))

    def write(batches):
        store, root = _store(path)
        attempt = TaskContext.get().taskAttemptId()
        store.create_dir(f"{root}/_temporary", recursive=True)
        out = None
        rolls: dict[int, int] = {}
        page, marks, seen = object(), {}, {}

        def closed():
            nonlocal out
            done, out = out, None
            done["stream"].close()
            store.move(done["temp"], f"{root}/{done['file']}")
            return pa.RecordBatch.from_pylist([{k: done[k] for k in ("file", "part", "roll", "n_records", "n_bytes")} | {"sha256": done["sha"].hexdigest()}], schema=_arrow(MANIFEST))

        def put(data: bytes):
            data = member(data, level)
            out["stream"].write(data)
            out["sha"].update(data)
            out["n_bytes"] += len(data)

        for batch in batches:
            for x in batch.to_pylist():
                if x["id"] != page:
                    page, marks, seen = x["id"], {}, {}
                if x["kind"] == 0:
                    marks[sha_text(x["digest"])] = x["first"]
                    continue
                if out and (out["part"] != x["part"] or out["n_bytes"] >= file_bytes):
                    yield closed()
                if out is None:
                    roll = rolls[x["part"]] = rolls.get(x["part"], -1) + 1
                    file = f"part-{x['part']:06d}-{roll:05d}.warc.gz"
                    temp = f"{root}/_temporary/{file}.{attempt}"
                    out = {"file": file, "part": x["part"], "roll": roll, "n_records": 0, "n_bytes": 0, "sha": hashlib.sha256(), "temp": temp, "stream": store.open_output_stream(temp, compression=None)}
                    put(info(file, date))
                digest = sha1_32(x["payload"])
                again = seen.get(digest, 0)
                seen[digest] = again + 1
                long = len(x["payload"]) >= least_revisit
                kind, refers = ("revisit", marks[digest]) if digest in marks else ("revisit", x["id"]) if again and long else ("response", None)
                put(record(kind, x["id"], x["url"], x["payload"], digest, date, again, refers))
                out["n_records"] += 1
        if out:
            yield closed()

    both.mapInArrow(write, MANIFEST).write.parquet(f"{path}/_manifest")
    remove(spark, f"{path}/_temporary")
    return spark.read.parquet(f"{path}/_manifest")


def sha_text(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    return pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in ddl.split(","))])


def members(stream):
    """The gzip members of a stream, one by one, each decompressed."""
    z, out, rest = None, [], b""
    while True:
        data = rest or stream.read(1 << 20)
        rest = b""
        if not data:
            if z is not None:
                raise ValueError("the archive ends within a record")
            return
        if z is None:
            z, out = zlib.decompressobj(31), []
        out.append(z.decompress(data))
        if z.eof:
            yield b"".join(out)
            rest, z = z.unused_data, None


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers, by lower-case name, and the block of a record; digests are verified."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    block = rest[: int(headers["content-length"])]
    if "warc-block-digest" in headers and headers["warc-block-digest"] != f"sha1:{sha1_32(block)}":
        raise ValueError(f"digest of {headers['warc-record-id']} doesn't match its block")
    return headers, block


_FIELDS = {"page_id": "long", "url": "string", "payload": "binary", "payload_bytes": "long", "payload_digest": "string", "record_type": "string", "refers_to": "long"}


def read_archives(spark: SparkSession, path: str, columns: tuple[str, ...] = tuple(_FIELDS)) -> DataFrame:
    """A row per response and revisit of the files in the manifest; payload is null for revisits."""
    ship(spark)
    path = _qualified(spark, path)
    schema = ", ".join(f"{c} {_FIELDS[c]}" for c in columns)
    files = spark.read.parquet(f"{path}/_manifest").select("file", "n_records")
    n = max(1, min(files.count(), 10_000))

    def read(batches):
        store, root = _store(path)
        form = _arrow(schema)
        for batch in batches:
            for x in batch.to_pylist():
                rows, size, count = [], 0, 0
                with store.open_input_stream(f"{root}/{x['file']}", compression=None) as stream:
                    for data in members(stream):
                        headers, block = parse(data)
                        if headers["warc-type"] not in ("response", "revisit"):
                            continue
                        http, _, payload = block.partition(b"\r\n\r\n")
                        length = int(next(v for k, _, v in (h.partition(":") for h in http.decode("latin-1").split("\r\n")) if k.lower() == "content-length"))
                        digest = headers["warc-payload-digest"].removeprefix("sha1:")
                        if headers["warc-type"] == "response" and (len(payload) != length or sha1_32(payload) != digest):
                            raise ValueError(f"payload of {headers['warc-record-id']} is damaged")
                        row = {
                            "page_id": int(headers["x-page-id"]) if "x-page-id" in headers else None, "url": headers.get("warc-target-uri"), "payload": payload if headers["warc-type"] == "response" else None,
                            "payload_bytes": length, "payload_digest": digest, "record_type": headers["warc-type"], "refers_to": int(headers["x-refers-to-page-id"]) if "x-refers-to-page-id" in headers else None,
                        }
                        rows.append({c: row[c] for c in columns})
                        size += len(payload) if "payload" in columns else 0
                        count += 1
                        if len(rows) >= 1000 or size > 8 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema=form)
                            rows, size = [], 0
                if count != x["n_records"]:
                    raise ValueError(f"{x['file']} has {count} records, the manifest says {x['n_records']}")
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=form)

    return files.repartition(n, "file").mapInArrow(read, schema)
