"""Digests of files that are hashed in rounds."""

import hashlib
import random

import pytest

from tidemark.functions import sha256
from tidemark.operators import clean

noise = random.Random(4).randbytes
FILES = {
    "noise.bin": noise(700_001), "end.bin": noise(300_000).rstrip(b"\n") + b"\n", "no end.txt": b"x\r\ny\rz\n\n" * 30_000 + b"last",
    "one line.txt": b"q" * 200_000, "feeds.txt": b"\n" * 150_000, "mark.txt": b"\xef\xbb\xbf" + b"a,b\n" * 60_000, "mark no end.txt": b"\xef\xbb\xbf" + b"a,b\n" * 60_000 + b"c",
    "small.bin": noise(900), "edge.bin": noise(64 << 10), "packed.gz": noise(200_000), "inner/deep.bin": noise(260_000),
}


@pytest.fixture
def folder(spark, tmp_path):
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(32 << 10))
    (tmp_path / "inner").mkdir()
    for name, data in FILES.items():
        (tmp_path / name).write_bytes(data)
    yield str(tmp_path)
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def want():
    return {n.split("/")[-1]: (len(d), hashlib.sha256(d).hexdigest()) for n, d in FILES.items()}


def got(df):
    return {r["path"].split("/")[-1].replace("%20", " "): (r["bytes"], r["sha256"]) for r in df.collect()}


@pytest.mark.parametrize("span", [64 << 10, 256 << 10, 1 << 30])
def test_rounds_give_the_digest_of_the_file(spark, folder, span):
    df = clean.file_hashes(spark, folder, whole=64 << 10, span=span)
    assert got(df) == want() == got(clean.file_hashes(spark, folder))
    assert {r["path"] for r in df.collect()} == {r["path"] for r in clean.file_hashes(spark, folder).collect()}


def test_without_states_one_round_does(spark, folder, monkeypatch):
    monkeypatch.setattr(clean.sha256, "resumes", lambda: False)
    assert got(clean.file_hashes(spark, folder, whole=64 << 10, span=64 << 10)) == want()


def test_a_state_goes_on_after_any_byte():
    data = noise(300)
    assert sha256.resumes()
    for at in range(0, 300, 7):
        first = sha256.Resumable()
        first.update(data[:at])
        second = sha256.Resumable(first.state())
        second.update(data[at:])
        assert second.hexdigest() == hashlib.sha256(data).hexdigest()


def test_no_task_reads_a_large_file_whole(spark, folder, monkeypatch):
    """Content is asked for only up to a length, or of packed files."""
    df = clean.file_hashes(spark, folder, whole=64 << 10, span=64 << 10)
    # Spark fails on content beyond this length, as it does beyond 2 GB
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", str(200_000))
    try:
        assert got(df) == want()
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
