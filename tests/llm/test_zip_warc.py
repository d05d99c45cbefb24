"""Packages of WARC records: round trips, Python's zipfile as the other reader and writer."""

import collections
import glob
import gzip
import hashlib
import io
import json
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from tickforge.llm import zip_warc
from tickforge.session import scratch_path

PAGES = "page_id long, url string, html string, digest string, payload string, refers_to long"


def brute(rows):
    first = {}
    for i, _, html in rows:
        if i is not None and len((html or "").encode()) >= 100:
            first[html] = min(i, first.get(html, i))
    out = []
    for i, _, html in rows:
        data = (html or "").encode()
        f = first.get(html) if len(data) >= 100 else None
        refers = f if f is not None and (i is None or i > f) else None
        out.append((i, len(data), hashlib.sha256(data).hexdigest(), "response" if refers is None else "revisit", refers))
    return collections.Counter(out)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(6)
    texts = [None, "", "x" * 99, "x" * 100, "é" * 50, "WARC/1.1\r\n\r\nPK\x05\x06 PK\x01\x02 \x00\x01" * 9, "\r\n\r\n" * 40, "日本" * 400, "long " * 200_000]
    out = [(i, rng.choice([None, "", "http://a/b?c=1 d", "http://é/\r\nX-Page-ID: 7", "x://" + "y" * 3000]),
            rng.choice([*texts, "hot " * 50, "hot " * 50])) for i in range(150)]
    return [*out, out[3], out[3], out[90], (None, "http://n/", "hot " * 50), (None, None, None), (-5, "u", "y" * 100), (None, "u", "z" * 200)]


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(*r, "d", "p", 1) for r in rows], PAGES).repartition(parts)


def found(df):
    return collections.Counter(tuple(r) for r in df.select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect())


@pytest.mark.parametrize("broadcast", [True, False])
def test_round_trip(spark, rows, monkeypatch, broadcast):
    if not broadcast:  # the hot payload by broadcast, the others by a shuffle
        monkeypatch.setattr(zip_warc, "BROADCAST_BYTES", 0)
        monkeypatch.setattr(zip_warc, "HOT_COPIES", 8)
    got = zip_warc.round_trip(frame(spark, rows))
    assert found(got) == brute(rows)
    assert [t for _, t in got.dtypes] == ["bigint", "string", "bigint", "string", "string", "bigint"]


def test_payloads_and_urls_come_back(spark, rows):
    got = zip_warc.round_trip(frame(spark, rows), payloads=True).collect()
    want = collections.Counter((h or "").encode() for _, _, h in rows)
    have = collections.Counter(bytes(r.payload) for r in got if r.record_type == "response")
    assert all(have[k] <= want[k] for k in have) and set(have) == set(want)
    assert sum(r.url is None for r in got) == sum(u is None for _, u, _ in rows)
    assert all("\n" not in (r.url or "") for r in got)


@pytest.mark.parametrize("wide", [False, True])
def test_other_reader_takes_the_packages(spark, rows, wide):
    """zipfile reads every member, checksums included; members hold whole records; several members a package."""
    path = scratch_path(spark, "t")
    zip_warc.write(zip_warc.identify(frame(spark, rows, 2)), path, member_records=20, wide=wide)
    files, records = glob.glob(f"{path.removeprefix('file:')}/part-*"), 0
    assert files
    for name in files:
        with zipfile.ZipFile(name) as z:
            assert z.testzip() is None
            archives = [i for i in z.infolist() if i.filename.endswith(".warc")]
            assert len(archives) > 1 and all(i.compress_type == zipfile.ZIP_STORED for i in z.infolist())
            for i in archives:
                data = z.read(i)
                index = z.read(i.filename.replace("archive", "indexes").replace(".warc", ".cdxj"))
                at = 0
                for x in map(json.loads, index.decode().strip().splitlines()):
                    assert x["offset"] == at and data[at:at + x["length"]].endswith(b"\r\n\r\n")
                    assert data[at:].startswith(b"WARC/1.1\r\n")
                    at += x["length"]
                    records += 1
                assert at == len(data)
    assert records == len(rows)
    assert found(zip_warc.read(spark, path)) == brute(rows)


def package(path, wide, index, zipped, comment=b""):
    """A package by zipfile with two archives; returns what it holds."""
    want = collections.Counter()
    with zipfile.ZipFile(path, "w") as z:
        z.comment = comment
        z.writestr("datapackage.json", "{}", zipfile.ZIP_DEFLATED)
        for a in range(2):
            data, lines = b"", []
            for i in range(30):
                html = (f"page {a} {i} " * i).encode()
                digest = hashlib.sha256(html).hexdigest()
                r = zip_warc.record(a * 100 + i, "http://x/", html, digest, None) + b"\r\n\r\n"
                r = gzip.compress(r) if zipped else r
                lines.append(f"x,) 2024 " + json.dumps({"offset": str(len(data)), "length": len(r), "filename": f"f{a}.warc" + ".gz" * zipped}))
                data += r
                want[a * 100 + i, len(html), digest, "response", None] += 1
            with z.open(zipfile.ZipInfo(f"archive/f{a}.warc" + ".gz" * zipped), "w", force_zip64=wide) as f:
                f.write(data)
            text = "\n".join(["!meta line", *lines]).encode()
            if index == "gz":
                z.writestr(f"indexes/f{a}.cdx.gz", gzip.compress(text[:70]) + gzip.compress(text[70:]))
            elif index:
                z.writestr(f"indexes/f{a}.cdxj", text, zipfile.ZIP_DEFLATED if index == "deflated" else zipfile.ZIP_STORED)
    return want


@pytest.mark.parametrize("index", ["stored", "deflated", "gz", None])
@pytest.mark.parametrize("zipped", [False, True])
def test_packages_of_another_writer(spark, monkeypatch, index, zipped):
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 500)  # its directory then has ZIP64 records
    path = scratch_path(spark, "t").removeprefix("file:")
    spark.range(1).select(F.lit("").alias("value")).write.text(path)  # makes the folder, with a file of one line
    want = package(f"{path}/a.wacz", True, index, zipped, b"PK\x05\x06 a comment")
    assert b"PK\x06\x06" in open(f"{path}/a.wacz", "rb").read()
    assert found(zip_warc.read(spark, f"{path}/a.wacz", payloads=True)) == want


def test_directory_entries():
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for i in range(5):
            z.writestr(f"n{i}", b"x" * i)
    n = data.tell()
    got = zip_warc.directory(data, n)
    assert [(e.name, e.size) for e in got] == [(f"n{i}", i) for i in range(5)]
    assert all(data.getvalue()[zip_warc.data_start(data, e):][:e.size] == b"x" * e.size for e in got)
    with pytest.raises(ValueError, match="end of central"):
        zip_warc.directory(io.BytesIO(b"x" * 100), 100)
    with pytest.raises(ValueError):
        zip_warc.directory(io.BytesIO(data.getvalue()[30:]), n - 30)


def test_compressed_archives_and_damage_are_errors():
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("archive/a.warc", b"x" * 100)
    with pytest.raises(ValueError, match="not stored"):
        list(zip_warc.locate(data, data.tell()))
    whole = zip_warc.record(1, "u", b"abc", hashlib.sha256(b"abc").hexdigest(), None)
    assert zip_warc.parse(whole)[2] == 3
    with pytest.raises(ValueError, match="damaged"):
        zip_warc.parse(whole[:-1] + b"X")


def test_many_small_reads(spark, rows, monkeypatch):
    """Blocks smaller than a record."""
    monkeypatch.setattr(zip_warc, "BLOCK", 512)
    path = scratch_path(spark, "t")
    zip_warc.write(zip_warc.identify(frame(spark, rows)), path)
    assert found(zip_warc.read(spark, path)) == brute(rows)


def test_empty_table(spark):
    assert zip_warc.round_trip(spark.createDataFrame([], PAGES)).count() == 0
