"""What identifies a file: the digest of its bytes, or, where no bytes are read, of its path and size."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F


def content_hash(data: Column) -> Column:
    return F.sha2(data, 256)


def meta_hash(path: Column, size: Column) -> Column:
    return F.sha2(F.concat(path, F.lit("\n"), size.cast("string")), 256)


def meta_hash_of(path: str, size: int) -> str:
    return hashlib.sha256(f"{path}\n{size}".encode()).hexdigest()
