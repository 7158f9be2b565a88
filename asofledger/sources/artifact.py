"""Verified sources and atomic sinks.

An artifact is known by the SHA-256 of its bytes. Files of a folder are hashed in parallel, whole files as rows; a file beyond WHOLE_BYTES is hashed as a stream in a task of its own, in memory of one block. The digest and the store's own listing
(name, length and modification time of each file) are compared before and after use, so a source that changed meanwhile is refused, and both are held against a contract where one is given.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..durable import exists, filesystem, in_order, rename
from ..operators.integrity import IntegrityError, difference
from ..schema import MONEY_COLUMNS, SOURCE_COLUMNS


#: Files up to this size are hashed as rows, larger ones as streams, BLOCK bytes at a time.
WHOLE_BYTES, BLOCK = 1 << 28, 1 << 23
#: Tasks that stream large files, at most; each takes several files where there are more.
STREAM_TASKS = 10_000


@dataclass(frozen=True)
class Fingerprint:
    files: tuple[tuple[str, int, int], ...]
    digest: str

    @property
    def size(self) -> int:
        return sum(length for _, length, _ in self.files)


@dataclass(frozen=True)
class ArtifactContract:
    """What an approved artifact must be: its file's name, size and SHA-256, and what its rows add up to. None is not asked for."""

    filename: str | None = None
    byte_size: int | None = None
    sha256: str | None = None
    row_count: int | None = None
    legitimate_count: int | None = None
    fraud_count: int | None = None
    transaction_type_counts: dict[str, int] | None = None
    step_min: int | None = None
    step_max: int | None = None
    partitions: dict[str, int] | None = None

    def differences(self, **observed) -> dict[str, tuple]:
        """Expected and observed value of each named field that differs."""
        return {k: (getattr(self, k), v) for k, v in observed.items() if getattr(self, k) is not None and getattr(self, k) != v}

    def require(self, **observed) -> None:
        if wrong := self.differences(**observed):
            raise IntegrityError("; ".join(f"{k}: expected {a}, observed {b}" for k, (a, b) in sorted(wrong.items())))


def listing(spark: SparkSession, path: str) -> tuple[tuple[str, int, int], ...]:
    """Name, length and modification time of each file of a path."""
    fs, where = filesystem(spark, path)
    return tuple(sorted((s.getPath().getName(), s.getLen(), s.getModificationTime()) for s in fs.listStatus(where) if s.isFile() and s.getPath().getName()[0] not in "._"))


def _streamed(batches):
    """uri and SHA-256 of files by Arrow's own file systems; null for one that these can't open or read to its end."""
    import pyarrow as pa
    from pyarrow import fs

    for batch in batches:
        for uri, length in zip(*(c.to_pylist() for c in batch.columns)):
            digest, seen = hashlib.sha256(), 0
            try:
                store, path = fs.FileSystem.from_uri(uri)
                with store.open_input_stream(path, compression=None) as stream:
                    while block := stream.read(BLOCK):
                        digest.update(block)
                        seen += len(block)
            except (OSError, pa.ArrowException):
                seen = -1
            yield pa.RecordBatch.from_pydict({"uri": [uri], "sha256": [digest.hexdigest() if seen == length else None]}, schema=pa.schema([("uri", pa.string()), ("sha256", pa.string())]))


def _driver_digest(spark: SparkSession, path: str) -> str:
    fs, where = filesystem(spark, path)
    jvm = spark._jvm
    digest = jvm.java.security.MessageDigest.getInstance("SHA-256")
    stream = jvm.java.security.DigestInputStream(fs.open(where), digest)
    try:
        stream.transferTo(jvm.java.io.OutputStream.nullOutputStream())
    finally:
        stream.close()
    return bytes(digest.digest()).hex()


def stream_digests(spark: SparkSession, files: dict[str, tuple[str, int]]) -> dict[str, str]:
    """Name and SHA-256 of large files, given by name as (qualified path, length). Tasks stream them side by side; only a file of a store that the tasks can't open (Arrow knows local files, HDFS, S3 and GCS) is streamed by the driver."""
    if not files:
        return {}
    given = spark.createDataFrame(sorted(files.values()), "uri string, length long").repartition(min(len(files), STREAM_TASKS))
    found = dict(map(tuple, given.mapInArrow(_streamed, "uri string, sha256 string").collect()))  # a short row per file
    return {name: found[uri] or _driver_digest(spark, spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(uri)).toString()) for name, (uri, _) in files.items()}


def file_digests(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    """Name and SHA-256 of each file of a path: a short row per file goes to the driver."""
    fs, where = filesystem(spark, path)
    large = {s.getPath().getName(): (_uri(s.getPath()), s.getLen()) for s in fs.listStatus(where) if s.isFile() and s.getPath().getName()[0] not in "._" and s.getLen() > WHOLE_BYTES}
    if large and fs.getFileStatus(where).isFile():
        return list(stream_digests(spark, large).items())
    small = spark.read.format("binaryFile").load(path).where(F.col("length") <= WHOLE_BYTES).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("sha256"))
    if fs.getFileStatus(where).isFile():
        return [(where.getName(), small.first()["sha256"])]
    return sorted([*stream_digests(spark, large).items(), *map(tuple, small.collect())])


def _uri(where) -> str:
    """A path with its characters escaped as in a URI, with file:// for a local one."""
    text = where.toUri().toASCIIString()
    return "file://" + text.removeprefix("file:") if text.startswith("file:/") and not text.startswith("file://") else text


def fingerprint(spark: SparkSession, path: str) -> Fingerprint:
    """The SHA-256 of a file; of several files that of the lines `sha256  name`, in the order of names."""
    found = file_digests(spark, path)
    digest = found[0][1] if len(found) == 1 else hashlib.sha256("".join(f"{sha}  {name}\n" for name, sha in found).encode()).hexdigest()
    return Fingerprint(listing(spark, path), digest)


class verified_source:  # noqa: N801
    """Context of a source that must meet a contract or an expected digest (if one is given) and not change while it is used."""

    def __init__(self, spark: SparkSession, path: str, digest: str | None = None, contract: ArtifactContract | None = None):
        self.spark, self.path, self.contract = spark, path, contract or ArtifactContract(sha256=digest)

    def __enter__(self) -> Fingerprint:
        self.before = fingerprint(self.spark, self.path)
        self.contract.require(filename=self.path.rstrip("/").rpartition("/")[2], byte_size=self.before.size, sha256=self.before.digest)
        return self.before

    def __exit__(self, kind, error, trace) -> None:
        if kind is None and fingerprint(self.spark, self.path) != self.before:
            raise IntegrityError(f"{self.path} changed while it was read")


def require_apart(spark: SparkSession, source: str, target: str) -> None:
    """Raise if target is the source, holds it, or lies in the source or in the source's folder."""
    def whole(path: str) -> str:
        fs, where = filesystem(spark, path.rstrip("/"))
        return fs.makeQualified(where).toString()

    a, b = whole(source), whole(target)
    if a == b or a.startswith(f"{b}/") or b.startswith(f"{a}/") or b.startswith(f"{a.rpartition('/')[0]}/"):
        raise ValueError(f"{target} must not be, hold or lie beside {source}")


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A new small file; an existing one is never overwritten."""
    fs, where = filesystem(spark, path)
    out = fs.create(where, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str:
    return "\n".join(r[0] for r in spark.read.text(path).collect())


def stable_json(value, default: Callable | None = None) -> str:
    return json.dumps(value, sort_keys=True, indent=2, allow_nan=False, ensure_ascii=False, default=default) + "\n"


def source_rows(rows: DataFrame) -> DataFrame:
    """Canonical rows back in the source's columns, with money as it was spelt."""
    names = dict(zip(SOURCE_COLUMNS, ["step", "transaction_type", "amount", "initiator_id", "oldBalInitiator", "newBalInitiator", "recipient_id", "oldBalRecipient", "newBalRecipient", "is_fraud"]))
    return rows.select(*[F.col(f"{c}_literal" if c in MONEY_COLUMNS else names[c]).cast("string").alias(c) for c in SOURCE_COLUMNS])


def write_csv(rows: DataFrame, path: str, order: str | list[str] = "source_row_number", spell: Callable[[DataFrame], DataFrame] | None = None, late: dict[str, Column] | None = None) -> None:
    """Source columns as CSV, range-partitioned in source order, minimal quoting; the folder must not exist. spell makes wide columns of the rows once they are in order, so that these are not shuffled; late makes columns of order, as in in_order()."""
    order = [order] if isinstance(order, str) else order
    ordered = in_order(rows, order, late)
    if spell is not None:
        ordered = spell(ordered)
    source_rows(ordered).write.csv(path, header=True, escape='"', mode="errorifexists", emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def publish(spark: SparkSession, target: str, produce: Callable[[str], dict]) -> dict:
    """Give produce a staging folder, write its facts as manifest.json there, and rename the folder to target.

    An existing target is refused. If produce raises, the staging folder stays with failure.json and nothing is published.
    """
    target = target.rstrip("/")
    if exists(spark, target):
        raise FileExistsError(target)
    parent, _, name = target.rpartition("/")
    staging = f"{parent}/.{name}.incomplete-{uuid.uuid4().hex[:12]}"
    fs, where = filesystem(spark, staging)
    fs.mkdirs(where)
    try:
        facts = produce(staging)
        write_text(spark, f"{staging}/manifest.json", stable_json(facts))
    except Exception as error:
        write_text(spark, f"{staging}/failure.json", stable_json({"error": type(error).__name__, "message": str(error)[:2000]}))
        raise
    if exists(spark, target):
        raise FileExistsError(target)
    rename(spark, staging, target)
    return facts


def row_sums(row: Column) -> list[Column]:
    """A count and two independent sums of hashes of rows (structs), which the same rows share in any order. Each sum is three of 21 or 22 bits a row, which a long holds for 2**41 rows."""
    hashes = {"x": F.xxhash64(row), "y": F.xxhash64(F.lit("again"), row)}  # y is begun with another seed
    limbs = lambda h: [F.shiftright(h, 42), F.shiftright(h, 21).bitwiseAND(F.lit((1 << 21) - 1)), h.bitwiseAND(F.lit((1 << 21) - 1))]
    return [F.count(F.lit(1)).alias("n"), *[F.coalesce(F.sum(limb), F.lit(0)).alias(f"{name}{i}") for name, h in hashes.items() for i, limb in enumerate(limbs(h))]]


def verify_read_back(written: DataFrame, expected: DataFrame) -> None:
    """Raise unless both hold the same rows as often: counts and two independent sums of row hashes are compared, and rows only where these differ."""
    sums = lambda df: tuple(df.agg(*row_sums(F.struct(*[f"`{c}`" for c in sorted(df.columns)]))).first())
    if sums(written) != sums(expected):
        raise IntegrityError(f"rows read back differ from the rows written, as in {difference(written, expected).limit(1).collect()}")


def as_facts(found: Fingerprint) -> dict:
    return {k: (list(map(list, v)) if k == "files" else v) for k, v in asdict(found).items()}
