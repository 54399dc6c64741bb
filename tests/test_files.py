"""Hashes of files of any size, and bundles."""

import hashlib
import os
import tracemalloc
import zipfile

import pyarrow as pa
import pytest

from veldspar.operators import integrity
from veldspar.sources import writers

LARGE = 3 << 30


def streamed(path):
    h = hashlib.sha256()
    with open(path, "rb") as f:
        while x := f.read(1 << 22):
            h.update(x)
    return h.hexdigest()


def test_a_file_of_three_gigabytes(spark, tmp_path):
    big = tmp_path / "in" / "big.bin"
    big.parent.mkdir()
    with big.open("wb") as f:
        f.write(b"begin")
        f.truncate(LARGE)
    os.makedirs(tmp_path / "in/odd name, 100%/é")
    (tmp_path / "in/odd name, 100%/é/a b#c?.txt").write_bytes(b"small")
    (tmp_path / "in/empty").write_bytes(b"")
    got = {r.file: (r.bytes, r.sha256) for r in integrity.hash_manifest(spark, str(tmp_path / "in")).collect()}
    small, empty = hashlib.sha256(b"small").hexdigest(), hashlib.sha256().hexdigest()
    assert got == {"big.bin": (LARGE, streamed(big)), "odd name, 100%/é/a b#c?.txt": (5, small), "empty": (0, empty)}
    integrity.assert_no_drift(spark, str(big), got["big.bin"][1])
    with pytest.raises(integrity.IntegrityError):
        integrity.assert_no_drift(spark, str(big), small)


def test_memory_is_a_chunk(tmp_path):
    path = tmp_path / "f"
    with path.open("wb") as f:
        f.truncate(200 << 20)
    batch = pa.RecordBatch.from_arrays([pa.array([f"file:{path}"])], names=["path"])
    tracemalloc.start()
    before = pa.total_allocated_bytes()
    (out,) = integrity.file_digests(iter([batch]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert out.column(2).to_pylist() == [streamed(path)] and peak < 8 << 20 and pa.total_allocated_bytes() - before < 1 << 20


def test_bundle_tells_files_of_one_name_apart(tmp_path):
    for name in ("a/x/f.txt", "b/x/f.txt", "g.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(name)
    files = [tmp_path / n for n in ("g.txt", "b/x/f.txt", "a/x/f.txt")]
    writers.zip_bundle(files, tmp_path / "z.zip")
    writers.zip_bundle(files[::-1], tmp_path / "again.zip")
    with zipfile.ZipFile(tmp_path / "z.zip") as z:
        assert z.namelist() == ["a/x/f.txt", "b/x/f.txt", "g.txt"] and z.read("b/x/f.txt") == b"b/x/f.txt"
    assert (tmp_path / "z.zip").read_bytes() == (tmp_path / "again.zip").read_bytes()
    with pytest.raises(ValueError):
        writers.zip_bundle([files[0], files[0]], tmp_path / "no.zip")
