"""File scans against hashlib."""

import hashlib

from tidemark.sources import store


def test_files_beyond_one_record_are_hashed_whole(spark, tmp_path):
    content = {"a.txt": b"small", "b c%20.md": bytes(range(256)) * 9000, "d.bin": b"\0" * 3000, "f.mp4": b"x" * 3_000_000}
    for name, data in content.items():
        (tmp_path / name).write_bytes(data)
    digest = {k: hashlib.sha256(v).hexdigest() for k, v in content.items()}
    got = {r["length"]: (r["verdict"], r["sha256"]) for r in store.scan_files(spark, f"{tmp_path}/*", max_bytes=2_500_000, record_bytes=1000).collect()}
    want = {"a.txt": "ok", "b c%20.md": "ok", "d.bin": "unsupported extension"}
    assert got == {len(content[k]): (v, digest[k]) for k, v in want.items()} | {3_000_000: ("too large", None)}
    path = next(r["path"] for r in spark.read.format("binaryFile").load(f"{tmp_path}/b*").select("path").collect())
    assert store._digest_by_hadoop(spark, path) == digest["b c%20.md"]
    less = {r["length"]: r["verdict"] for r in store.scan_files(spark, f"{tmp_path}/*.m*", max_hashed=1000).collect()}
    assert less == {len(content["b c%20.md"]): "not hashed", 3_000_000: "not hashed"}


def test_every_accepted_size_is_hashed_by_default(spark, tmp_path):
    data = b"0123456789abcdef" * 6_300_000  # just over 100 MB
    (tmp_path / "long.txt").write_bytes(data)
    (row,) = store.scan_files(spark, f"{tmp_path}/*.txt").collect()
    assert (row["verdict"], row["sha256"]) == ("ok", hashlib.sha256(data).hexdigest())
