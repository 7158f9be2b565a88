"""Deterministic identifiers (UUID version 5) as column expressions."""

from __future__ import annotations

import hashlib
from pathlib import Path

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import NAMESPACE_HEX


def uuid5(name: Column, namespace_hex: str = NAMESPACE_HEX) -> Column:
    """UUIDv5 of a name, lowercase with hyphens."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace_hex)), F.encode(name, "UTF-8")))
    variant = F.translate(F.substring(digest, 17, 1), "0123456789abcdef", "89ab" * 4)  # the digit's upper two bits become 10
    return F.concat_ws("-", F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.concat(F.lit("5"), F.substring(digest, 14, 3)), F.concat(variant, F.substring(digest, 18, 3)), F.substring(digest, 21, 12))


def transaction_id(artifact_sha256: Column, row_number: Column) -> Column:
    return uuid5(F.concat_ws(":", artifact_sha256, row_number.cast("string")))


def code_identity() -> str:
    """SHA-256 of this package's modules, their names and lengths: results made by other code can be told apart."""
    package, digest = Path(__file__).resolve().parents[1], hashlib.sha256()
    for path in sorted(package.rglob("*.py")):
        text = path.read_bytes()
        digest.update(f"{path.relative_to(package).as_posix()}\0{len(text)}\0".encode() + text)
    return digest.hexdigest()
