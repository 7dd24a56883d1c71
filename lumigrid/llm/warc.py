"""A deterministic sharded WARC writer and its reader.

Records are sorted by ``page_id`` (nulls first, equal ids by payload digest).  A shard is a range of
ids of fixed width, worked out from the table's totals, so the same table always gives the same shards,
whatever the cluster; a shard's records go to files that roll over by compressed size, one gzip member
per record.  Headers and digests are made anew from the payload.

Of records with equal payloads (of at least ``MIN_BYTES`` bytes) those of the least id are responses,
the others revisits that refer to it.  Who revisits whom is settled on narrow rows (id and digest);
only the decisions travel with the payloads into the one shuffle that the payloads take.

A task writes files of a name of its own and reports them; only reported files are renamed to their
final names, and the manifest, written last, lists them with size and SHA-256.  A task that is lost or
run twice therefore leaves nothing but files that nobody reads, which are removed at the end.

Null payloads and urls count as empty.  Repeated rows are records of their own: rows that repeat the
least id of their payload are all responses.  A null ``page_id`` sorts first and stays null; only if no
record of a payload has an id, all of these are responses.  Empty tables give an empty manifest.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumigrid.llm.common import scratch, written

MIN_BYTES = 0
#: Payload bytes of a shard, on average, and compressed bytes after which a file rolls over.
SHARD_BYTES = 32 << 20
ROLL_BYTES = 32 << 20
LEVEL = 4
#: A fixed date: the tables have none, and the same input must give the same bytes.
DATE = "2000-01-01T00:00:00Z"
#: Bytes that are unpacked at a time when reading.
_PIECE = 1 << 14

_FILES = "shard string, part long, seq int, temporary string, name string, records int, bytes long, sha256 string"
_RECORDS = ("page_id long, url string, payload_bytes long, payload_digest string, record_type string, "
            "refers_to long, file string, offset long")


def _schema(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string
    return to_arrow_schema(_parse_datatype_string(ddl))


def digest_text(sha1_hex: str) -> str:
    return base64.b32encode(bytes.fromhex(sha1_hex)).decode()


# --- records -------------------------------------------------------------------------------------

def record(place: str, page_id: int | None, url: str, payload: bytes, sha1_hex: str,
           refers_to: int | None) -> bytes:
    """One WARC record as a gzip member: a response with the payload, or a revisit without it.

    ``place`` (file and number in it) makes the record's id.
    """
    digest = digest_text(sha1_hex)
    revisit = refers_to is not None
    body = b"" if revisit else payload
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
            ).encode()
    block = http + body
    block_digest = base64.b32encode(hashlib.sha1(block).digest()).decode()
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"{place}\n{page_id}\n{url}\n{digest}")
    clean = "".join(c for c in url if c > " " and c != "\x7f") or "about:blank"
    lines = [f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:uuid:{name}>",
             f"WARC-Date: {DATE}", f"WARC-Target-URI: {clean}", f"WARC-Page-ID: {'' if page_id is None else page_id}",
             f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{block_digest}",
             f"WARC-Payload-Length: {len(payload)}"]
    if revisit:
        lines += [f"WARC-Refers-To-Page-ID: {refers_to}", "WARC-Profile: "
                  "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    head = ("WARC/1.1\r\n" + "\r\n".join(lines) + "\r\n\r\n").encode()
    return gzip.compress(head + block + b"\r\n\r\n", LEVEL, mtime=0)


def records(blob: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, headers, block) of every record of a file; raises ValueError where one is damaged."""
    view, at = memoryview(blob), 0
    while at < len(blob):
        member, parts, end = zlib.decompressobj(31), [], at
        while not member.eof:
            piece = view[end:end + _PIECE]
            if not piece:
                raise ValueError(f"record at {at} is cut off")
            try:
                parts.append(member.decompress(piece))
            except zlib.error as e:
                raise ValueError(f"record at {at} is damaged: {e}") from e
            end += len(piece)
        end -= len(member.unused_data)
        data = b"".join(parts)
        head, _, rest = data.partition(b"\r\n\r\n")
        first, *lines = head.decode().split("\r\n")
        headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines)
        length = int(headers.get("Content-Length", -1))
        block = rest[:length]
        if not first.startswith("WARC/") or len(rest) != length + 4:
            raise ValueError(f"record at {at} is malformed")
        want = headers["WARC-Block-Digest"].removeprefix("sha1:")
        if base64.b32encode(hashlib.sha1(block).digest()).decode() != want:
            raise ValueError(f"record at {at} does not match its digest")
        yield at, headers, block
        at = end


# --- writing -------------------------------------------------------------------------------------

def _narrow(pages: DataFrame) -> DataFrame:
    payload = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"),
                        payload.alias("payload"), F.sha1(payload).alias("sha1"))


def _revisits(rows: DataFrame, min_bytes: int) -> DataFrame:
    """(page_id, sha1, refers_to): pairs of id and payload that are revisits."""
    keyed = (rows.filter(F.octet_length("payload") >= min_bytes).select("page_id", "sha1").distinct())
    first = (keyed.groupBy("sha1").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("_n"))
             .filter("_n > 1 and refers_to is not null").drop("_n"))
    return keyed.join(first, "sha1").filter(F.col("page_id").isNull() | (F.col("page_id") != F.col("refers_to")))


def opened(folder: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a URI and the path in it."""
    if folder.startswith("file:"):
        return pyarrow.fs.LocalFileSystem(), "/" + folder.removeprefix("file:").lstrip("/")
    return pyarrow.fs.FileSystem.from_uri(folder)


def _files_of(folder: str, roll: int):
    schema = _schema(_FILES)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, root = opened(folder)
        own = f"{root}/temporary/{uuid.uuid4().hex}"
        out: dict = {"shard": None}

        def close() -> Iterator[pa.RecordBatch]:
            if out.get("stream") is not None:
                out["stream"].close()
                yield pa.RecordBatch.from_pylist([{
                    "shard": out["name"], "part": out["shard"], "seq": out["seq"], "temporary": out["at"],
                    "name": f"{out['name']}-{out['seq']:05d}.warc.gz", "records": out["records"],
                    "bytes": out["bytes"], "sha256": out["sha"].hexdigest()}], schema=schema)
                out["stream"] = None

        def begin(shard: int, seq: int) -> None:
            name = f"shard-{shard:08d}" if shard >= 0 else "shard-without-id"
            filesystem.create_dir(own, recursive=True)
            at = f"{own}/{name}-{seq:05d}"
            out.update(shard=shard, seq=seq, name=name, at=at, records=0, bytes=0, sha=hashlib.sha256(),
                       stream=filesystem.open_output_stream(at, compression=None))

        decision: tuple = (None, None, None)
        for batch in batches:
            for i in range(batch.num_rows):
                r = {n: c[i].as_py() for n, c in zip(batch.schema.names, batch.columns, strict=True)}
                if r["payload"] is None:  # it comes before the records that it speaks of
                    decision = r["page_id"], r["sha1"], r["refers_to"]
                    continue
                refers = decision[2] if decision[:2] == (r["page_id"], r["sha1"]) else None
                if out["shard"] != r["shard"]:
                    yield from close()
                    begin(r["shard"], 0)
                elif out["bytes"] >= roll:
                    yield from close()
                    begin(r["shard"], out["seq"] + 1)
                place = f"{out['name']}-{out['seq']:05d}/{out['records']}"
                data = record(place, r["page_id"], r["url"], r["payload"], r["sha1"], refers)
                out["stream"].write(data)
                out["sha"].update(data)
                out["records"] += 1
                out["bytes"] += len(data)
        yield from close()

    return write


def _committed(folder: str):
    """Renames reported files; a file that has been renamed before counts as done."""
    schema = _schema(_FILES)

    def commit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, root = opened(folder)
        for batch in batches:
            for r in batch.to_pylist():
                final = f"{root}/{r['name']}"
                if filesystem.get_file_info(r["temporary"]).type != pyarrow.fs.FileType.NotFound:
                    filesystem.move(r["temporary"], final)
                info = filesystem.get_file_info(final)
                if info.type == pyarrow.fs.FileType.NotFound or info.size != r["bytes"]:
                    raise OSError(f"{final} is missing or incomplete")
            yield pa.RecordBatch.from_pylist(batch.to_pylist(), schema=schema)

    return commit


def write(pages: DataFrame, folder: str, min_bytes: int = MIN_BYTES, shard_bytes: int = SHARD_BYTES,
          roll: int = ROLL_BYTES) -> str:
    """Write ``pages`` (page_id, url, html) below ``folder``, a URI that all executors reach."""
    rows = _narrow(pages)
    totals = rows.agg(F.min("page_id").alias("low"), F.max("page_id").alias("high"),
                      F.sum(F.octet_length("payload")).alias("bytes")).first()
    low, span = totals["low"] or 0, (totals["high"] or 0) - (totals["low"] or 0) + 1
    shards = max(1, -(-(totals["bytes"] or 0) // shard_bytes))
    width = -(-span // shards)
    shard: Column = F.coalesce(F.floor((F.col("page_id") - F.lit(low)) / F.lit(width)).cast("long"), F.lit(-1))
    decisions = _revisits(rows, min_bytes).select("page_id", "sha1", "refers_to")
    both = rows.withColumn("refers_to", F.lit(None).cast("long")).unionByName(decisions, allowMissingColumns=True)
    placed = both.withColumn("shard", shard)
    order = ["shard", "page_id", "sha1", F.col("payload").isNotNull(), "url"]
    files = written(placed.repartitionByRange(shards, "shard").sortWithinPartitions(*order)
                    .select("page_id", "url", "payload", "sha1", "refers_to", "shard")
                    .mapInArrow(_files_of(folder, roll), _FILES), "warc-files")
    done = files.mapInArrow(_committed(folder), _FILES)
    (done.select("name", "records", "bytes", "sha256").orderBy("name")
     .write.option("compression", "zstd").parquet(f"{folder}/manifest"))
    filesystem, root = opened(folder)
    if filesystem.get_file_info(f"{root}/temporary").type != pyarrow.fs.FileType.NotFound:
        filesystem.delete_dir(f"{root}/temporary")
    return folder


# --- reading -------------------------------------------------------------------------------------

def manifest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema("name string, records int, bytes long, sha256 string").parquet(f"{folder}/manifest")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """Every record of the files that the manifest lists; each file is checked against it."""
    schema = _schema(_RECORDS)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, root = opened(folder)
        for batch in batches:
            for f in batch.to_pylist():
                with filesystem.open_input_stream(f"{root}/{f['name']}", compression=None) as s:
                    blob = s.read()
                if hashlib.sha256(blob).hexdigest() != f["sha256"]:
                    raise ValueError(f"{f['name']} is not the file of the manifest")
                rows = []
                for at, headers, block in records(blob):
                    refers = headers.get("WARC-Refers-To-Page-ID")
                    page = headers["WARC-Page-ID"]
                    rows.append({"page_id": int(page) if page else None, "url": headers["WARC-Target-URI"],
                                 "payload_bytes": int(headers["WARC-Payload-Length"]),
                                 "payload_digest": headers["WARC-Payload-Digest"].removeprefix("sha1:"),
                                 "record_type": headers["WARC-Type"], "refers_to": int(refers) if refers else None,
                                 "file": f["name"], "offset": at})
                    if headers["WARC-Type"] == "response":
                        payload = block.partition(b"\r\n\r\n")[2]
                        seen = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                        if seen != rows[-1]["payload_digest"] or len(payload) != rows[-1]["payload_bytes"]:
                            raise ValueError(f"payload of page {page} does not match its digest")
                if len(rows) != f["records"]:
                    raise ValueError(f"{f['name']} has {len(rows)} records, not {f['records']}")
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    files = manifest(spark, folder)
    return files.repartition(max(1, files.count()), "name").mapInArrow(parse, _RECORDS)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write ``pages`` and describe each record read back from the files."""
    spark = pages.sparkSession
    return read(spark, write(pages, scratch(spark, "warc"))).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "file", "offset")
