"""Digests of files that no task holds whole."""

import gzip
import hashlib
import os
import random

from verbatlas.sources import load as S


def test_digests_do_not_hold_files(spark, tmp_path):
    rng = random.Random(4)
    big = bytes(rng.choices(range(256), k=300_000))
    made = {
        "big": big, "feed": big + b"\n", "one": b"\n", "bare": b"x", "marked": b"\xef\xbb\xbf" + big, "mark": b"\xef\xbb\xbf", "ends": b"\r\n\r\n\xff\n\n", "a b%20": b"q\nr", "packed.gz": gzip.compress(big[:200_000]), "more": big,
    }
    for name, data in made.items():
        (tmp_path / name).write_bytes(data)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40000")  # several splits a file
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "299000")  # as 2 GB would be
    try:
        got = {os.path.basename(r.source): (r.sha256, r.bytes, r.rows, r.step) for r in S.provenance(spark, "s", [str(tmp_path)], spark.range(3)).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
    assert got == {name: (hashlib.sha256(data).hexdigest(), len(data), 3, "s") for name, data in made.items()}
