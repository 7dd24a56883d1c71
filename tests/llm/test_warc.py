"""WARC files: exact round trips, revisits, the same bytes each time, damage, lost tasks."""

import base64
import gzip
import hashlib
from pathlib import Path

import pytest

from lumigrid.llm import queries, warc

SCHEMA = "page_id long, url string, html string, refers_to int, payload string"


def digest(payload):
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def plain(rows):
    """(page_id, bytes, digest, type, refers_to) by the rule; each row is a record."""
    least = {}
    for page, _, html in rows:
        if page is not None:
            least[html or ""] = min(page, least.get(html or "", page))
    out = []
    for page, _, html in rows:
        first = least.get(html or "")
        revisit = first is not None and page != first
        raw = (html or "").encode()
        out.append((page, len(raw), digest(raw), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=str)


ROWS = [(5, "http://a/ü", "<p>one</p>"), (3, "http://b", "<p>one</p>"), (9, None, "<p>one</p>"), (1, "", None),
        (2, "http://c", ""), (None, "http://d", "<p>one</p>"), (None, "x y\r\nz", "no id"), (7, "http://e", "two"),
        (7, "http://e", "two"), (8, "http://f", "two"), (4, "http://g", "é\r\n\r\n🙂" * 9000), (6, "WARC/1.1", "WARC/1.1\r\n\r\n"),
        (10 ** 15, "far", "far away")]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "p") for r in rows], SCHEMA)


def contents(folder):
    return {p.name: p.read_bytes() for p in Path(folder).glob("*.warc.gz")}


@pytest.mark.parametrize("shard,roll", [(warc.SHARD_BYTES, warc.ROLL_BYTES), (2000, 300)])
def test_odd_rows(spark, tmp_path, shard, roll):
    folder = warc.write(frame(spark, ROWS), f"file://{tmp_path}/w", shard_bytes=shard, roll=roll)
    found = warc.read(spark, folder)
    got = found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(tuple, got), key=str) == plain(ROWS)
    files = contents(tmp_path / "w")
    assert not (tmp_path / "w/temporary").exists()
    assert {r["name"]: r["sha256"] for r in warc.manifest(spark, folder).collect()} == {
        n: hashlib.sha256(b).hexdigest() for n, b in files.items()}
    if roll == 300:
        assert len(files) > 3
    stored = {h["WARC-Page-ID"]: b for f in files.values() for _, h, b in warc.records(f) if h["WARC-Type"] == "response"}
    assert stored["4"].partition(b"\r\n\r\n")[2].decode() == "é\r\n\r\n🙂" * 9000
    order = [(h["WARC-Page-ID"] != "", int(h["WARC-Page-ID"] or 0)) for n in sorted(files, key=lambda n: ("without" not in n, n))
             for _, h, _ in warc.records(files[n])]
    assert order == sorted(order)


def test_same_bytes_from_any_order(spark, tmp_path):
    a = warc.write(frame(spark, ROWS), f"file://{tmp_path}/a", shard_bytes=2000, roll=300)
    b = warc.write(frame(spark, ROWS[::-1]).repartition(5), f"file://{tmp_path}/b", shard_bytes=2000, roll=300)
    assert a != b and contents(tmp_path / "a") == contents(tmp_path / "b")


def test_small_payloads_are_responses(spark, tmp_path):
    folder = warc.write(frame(spark, ROWS), f"file://{tmp_path}/w", min_bytes=5)
    kinds = {(r["page_id"], r["record_type"]) for r in warc.read(spark, folder).collect()}
    assert (8, "response") in kinds and (5, "revisit") in kinds


def test_leftovers_and_second_commit(spark, tmp_path):
    """Files of a lost task are not read, and committing twice changes nothing."""
    (tmp_path / "w/temporary/lost").mkdir(parents=True)
    (tmp_path / "w/temporary/lost/shard-00000000-00000").write_bytes(b"half a rec")
    folder = warc.write(frame(spark, ROWS), f"file://{tmp_path}/w")
    assert warc.read(spark, folder).count() == len(ROWS)
    name, = contents(tmp_path / "w").keys() - {"shard-without-id-00000.warc.gz"}
    size = (tmp_path / "w" / name).stat().st_size
    row = {"shard": "s", "part": 0, "seq": 0, "temporary": str(tmp_path / "gone"), "name": name, "records": 1,
           "bytes": size, "sha256": ""}
    import pyarrow as pa
    batch = pa.RecordBatch.from_pylist([row], schema=warc._schema(warc._FILES))
    assert next(warc._committed(folder)(iter([batch]))).num_rows == 1


def test_damage_is_found(spark, tmp_path):
    folder = warc.write(frame(spark, ROWS), f"file://{tmp_path}/w")
    path = next((tmp_path / "w").glob("shard-0*.warc.gz"))
    blob = path.read_bytes()
    with pytest.raises(ValueError):
        list(warc.records(blob[:-3]))
    first = gzip.decompress(blob[:next(at for at, *_ in list(warc.records(blob))[1:])])
    with pytest.raises(ValueError):
        list(warc.records(gzip.compress(first.replace(b"HTTP/1.1 200", b"HTTP/1.1 201"))))
    path.write_bytes(blob[:-1] + b"x")
    with pytest.raises(Exception, match="not the file"):
        warc.read(spark, folder).collect()


def test_empty(spark):
    assert warc.round_trip(frame(spark, [])).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html").collect()]
    got = queries.op5_warc_shards(spark, sf).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert sorted(map(tuple, got.collect()), key=str) == plain(rows)
