import base64
import hashlib
from pathlib import Path

import pytest
import zstandard

from tessera.llm.warc import op4_warc, parse, read, write


def sha1(b):
    return base64.b32encode(hashlib.sha1(b).digest()).decode()


def brute(rows):
    """rows: (page_id, html). The query's rows."""
    first = {}
    for i, h in rows:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    for i, h in rows:
        b, top = (h or "").encode(), first.get(h or "")
        again = top is not None and i != top
        yield i, len(b), sha1(b), "revisit" if again else "response", top if again else None


def same(got, want):
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_query_matches_brute_force(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    same(op4_warc(spark, sf).collect(), brute([(p.page_id, p.html) for p in pages]))


ROWS = [(5, "http://a/\r\nx: y", "same"), (2, None, "same"), (9, "", "same"), (9, "", "same"), (1, "u", None), (3, "u", ""), (None, "n", "same"), (None, "n", "only null"), (4, "u", "é漢\x00\n" * 9), (7, "u", "x" * 3_000_000), (8, "u", "WARC/1.1\r\n\r\n")]


def test_odd_payloads_and_files(spark, tmp_path):
    df = spark.createDataFrame([(*r, 1) for r in ROWS], "page_id long, url string, html string, payload long")
    path = f"file://{tmp_path}/archives"
    write(df, path)
    got = read(spark, path).collect()
    same([(r.id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got], brute([(i, h) for i, _, h in ROWS]))
    texts = {i: h or "" for i, _, h in ROWS if i is not None}
    assert all(r.payload.decode() == texts[r.id] for r in got if r.record_type == "response" and r.id is not None)


def test_archives_are_plain_zstandard_with_a_dictionary(spark, sf, tmp_path):
    write(spark.read.parquet(f"{sf}/pages.parquet"), f"file://{tmp_path}/archives")
    data = next(Path(tmp_path, "archives").glob("part-*")).read_bytes()
    assert data[:4] == bytes.fromhex("5d2a4d18")
    size = int.from_bytes(data[4:8], "little")
    assert size > 1000
    with_it = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8 : 8 + size]))
    frame = data[8 + size + 8 :]
    assert with_it.decompressobj().decompress(frame).startswith(b"WARC/1.1\r\n")
    with pytest.raises(ValueError, match="cut short"):
        list(parse(data[:-30]))


def test_no_pages(spark, sf, tmp_path):
    write(spark.read.parquet(f"{sf}/pages.parquet").where("false"), f"file://{tmp_path}/archives")
    assert read(spark, f"file://{tmp_path}/archives").count() == 0
