"""Sinks: JSON lines in canonical form, CSV with fixed columns, one-row JSON, content hashes and write-once locks."""

from __future__ import annotations

import hashlib
import json
import re
import shutil
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callmetrics.functions.jsontext import canonical, canonical_json


class LockError(RuntimeError):
    """A lock that exists with other content, or whose content hash is wrong."""


def write_json_lines(frame: DataFrame, path: str, order: list[str] | None = None) -> None:
    """One canonical JSON object per row; range-sorted if an order is given, nulls as null."""
    held = frame.orderBy(*order) if order else frame
    held.select(canonical_json()(F.to_json(F.struct(*frame.columns), {"ignoreNullFields": "false"})).alias("value")).write.mode("overwrite").text(path)


def write_csv(frame: DataFrame, path: str, fields: list[str]) -> None:
    """The named columns with a header; missing ones are empty, others are left out."""
    columns = [F.col(f) if f in frame.columns else F.lit(None).cast("string").alias(f) for f in fields]
    frame.select(*columns).write.mode("overwrite").option("header", "true").csv(path)


def append_samples(frame: DataFrame, path: str) -> None:
    """Add telemetry rows to what is there."""
    frame.write.mode("append").json(path)


def append_csv(frame: DataFrame, path: str, fields: list[str]) -> None:
    """Add rows under the named columns, missing ones empty, to a folder of CSV files that each have a header."""
    columns = [F.col(f) if f in frame.columns else F.lit(None).cast("string").alias(f) for f in fields]
    frame.select(*columns).write.mode("append").option("header", "true").csv(path)


def finite(frame: DataFrame) -> DataFrame:
    """``frame``, which fails when a number that is not finite is read."""
    numbers = [f.name for f in frame.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    bad = lambda c: F.isnan(c) | (F.abs(F.col(c)) == float("inf"))
    return frame.withColumns({c: F.when(bad(c), F.raise_error(F.lit(f"{c} is not finite")).cast("double")).otherwise(F.col(c)) for c in numbers}) if numbers else frame


def write_document(frame: DataFrame, path: str) -> dict[str, Any]:
    """A one-row frame as a JSON document with sorted keys; numbers must be finite."""
    rows = finite(frame).limit(2).collect()
    if len(rows) != 1:
        raise ValueError("a document is exactly one row")
    value = json.loads(json.dumps(rows[0].asDict(recursive=True), default=str, allow_nan=False))
    with open(path, "w", encoding="utf-8") as file:
        file.write(json.dumps(value, indent=2, sort_keys=True, ensure_ascii=False) + "\n")
    return value


def content_hash(document: dict[str, Any], field: str = "content_sha256") -> str:
    """Digest of a document without the field that holds it."""
    return hashlib.sha256(canonical({k: v for k, v in document.items() if k != field}).encode()).hexdigest()


def write_sidecar(path: str) -> str:
    """Write the SHA-256 of a file beside it, on any file system, as ``<path>.sha256``; the digest."""
    from callmetrics.sources import locks

    digest = _file_digest(path)
    locks.put(f"{path}.sha256", f"{digest}  {path.rsplit('/', 1)[-1]}\n".encode())
    return digest


def check_sidecar(path: str) -> None:
    """LockError if a file's sidecar is missing or names another digest."""
    from callmetrics.sources import locks

    stored = (locks.get(f"{path}.sha256") or b"").decode().split()[:1]
    if stored != [_file_digest(path)]:
        raise LockError(f"{path.rsplit('/', 1)[-1]} does not match its sidecar")


def _file_digest(path: str) -> str:
    """The digest of a file: of a local one here, of any other by the executor that reads it."""
    from callmetrics.sources import locks

    local = locks.local_path(path)
    if local is not None:
        with open(local, "rb") as file:
            return hashlib.file_digest(file, "sha256").hexdigest()
    files = SparkSession.active().read.format("binaryFile").load(path)
    return files.select(F.sha2("content", 256)).first()[0]


def write_lock(path: str, document: dict[str, Any]) -> dict[str, Any]:
    """Write a document with its content hash once, on any file system; writing the same again is allowed."""
    from callmetrics.sources import locks

    return locks.write_lock(path, document)


def read_lock(path: str) -> dict[str, Any]:
    """A locked document, its content hash checked."""
    from callmetrics.sources import locks

    return locks.read_lock(path)


#: Sections of a run's manifest that updates add to instead of replacing them.
GROWING = ("hashes", "counts", "bytes", "requirements")


def merged_manifest(manifest: dict[str, Any], updates: dict[str, Any]) -> dict[str, Any]:
    """A manifest with updates, private values of the updates redacted: the growing sections take new entries beside their
    old ones, all else is replaced."""
    from callmetrics.operators.privacy import redact

    adds = lambda name, value: name in GROWING and isinstance(value, dict)
    clean = redact(updates)
    return manifest | {name: manifest.get(name, {}) | value if adds(name, value) else value for name, value in clean.items()}


def require_space(folder: str, floor_gib: float = 30.0, needed_gib: float = 0.0) -> None:
    """OSError unless the disk of ``folder`` keeps ``floor_gib`` free after ``needed_gib`` are written."""
    left = shutil.disk_usage(folder).free / 2**30 - needed_gib
    if left < floor_gib:
        raise OSError(f"{left:.2f} GiB would stay free, {floor_gib:.2f} GiB are required")


def dataset_descriptor(version: str, seed: int, counts: dict[str, int], hashes: dict[str, str]) -> dict[str, Any]:
    """The portable description of a prepared dataset: no rows, only counts and content hashes."""
    made = {"manifest_version": 2, "version": version, "seed": seed, "token_tiers": {"short": 512, "long": 2048}, "counts": counts, "split_hashes": hashes}
    return {**made, "content_sha256": content_hash(made)}


def check_descriptor(value: dict[str, Any]) -> None:
    """ValueError for a descriptor with missing fields, odd counts, bad digests or a wrong content hash."""
    missing = sorted({"manifest_version", "version", "seed", "token_tiers", "counts", "split_hashes", "content_sha256"} - value.keys())
    if missing:
        raise ValueError(f"descriptor lacks {missing[0]}")
    if value["manifest_version"] != 2 or value["token_tiers"] != {"short": 512, "long": 2048}:
        raise ValueError("descriptor is of another version")
    if not all(isinstance(n, int) and not isinstance(n, bool) and n >= 0 for n in value["counts"].values()):
        raise ValueError("counts must be whole numbers")
    digits = set("0123456789abcdef")
    if not all(len(h) == 64 and set(h) <= digits for h in [*value["split_hashes"].values(), value["content_sha256"]]):
        raise ValueError("hashes must have 64 hex digits")
    if value["content_sha256"] != content_hash(value):
        raise ValueError("content hash does not match")


# Versions, tiers and fields of a dataset's manifest.
MANIFEST_VERSION, FILTER_VERSION, SPLIT_VERSION = 2, 2, 2
TIERS = {"short": 512, "long": 2048}
ELIGIBILITY = ("eligible_512", "eligible_2048")
SOURCE_FIELDS = ("dataset", "revision", "kind", "sha256")
MANIFEST_FIELDS = ("version", "seed", "filter_version", "split_version", "prompt_contract_version", "token_tiers", "eligibility_counts", "sources", "split_locks", "content_sha256")


def _whole(value: Any, least: int = 0) -> bool:
    return isinstance(value, int) and not isinstance(value, bool) and value >= least


def _named(value: Any, names: tuple[str, ...]) -> bool:
    return isinstance(value, dict) and set(value) == set(names)


#: (field, whether its value will do, what is said if not).
MANIFEST_RULES = (
    ("prompt_contract_version", lambda v: _whole(v, 1), "prompt_contract_version must be positive"),
    ("token_tiers", lambda v: v == TIERS, "dataset manifest token tiers do not match the locked contract"),
    ("eligibility_counts", lambda v: _named(v, ELIGIBILITY) and all(map(_whole, v.values())), "dataset manifest eligibility counts are invalid"),
    ("sources", lambda v: isinstance(v, list) and all(isinstance(s, dict) and set(s) <= set(SOURCE_FIELDS) for s in v), "source descriptors may contain only dataset, revision, kind, and sha256"),
    ("sources", lambda v: not any(str(x).startswith("/") for s in v for x in s.values()), "source descriptors must not contain absolute paths"),
    ("split_locks", lambda v: isinstance(v, dict) and len(v) > 0 and all(isinstance(s, dict) for s in v.values()), "dataset manifest split locks are invalid"),
    ("split_locks", lambda v: all(_whole(s.get("count")) for s in v.values()), "dataset manifest split lock count is invalid"),
    ("split_locks", lambda v: all(re.fullmatch("[0-9a-f]{64}", str(s.get("id_hash"))) for s in v.values()), "dataset manifest split lock hash is invalid"),
)


def manifest_problems(manifest: dict[str, Any]) -> list[str]:
    """What is wrong with a dataset's manifest, in the order of the rules; nothing if it will do."""
    if manifest.get("dataset_manifest_version") != MANIFEST_VERSION:
        return ["unsupported dataset manifest version"]
    missing = sorted(set(MANIFEST_FIELDS) - manifest.keys())
    if missing:
        return ["dataset manifest is missing required fields: " + ", ".join(missing)]
    found = []
    for field, holds, message in MANIFEST_RULES:
        if not any(f == field for f, _ in found) and not holds(manifest[field]):
            found.append((field, message))
    stale = [] if found or manifest["content_sha256"] == content_hash(manifest) else ["dataset manifest content hash does not match"]
    return [message for _, message in found] + stale


def dataset_manifest(splits: DataFrame, row_id: str, version: str, eligibility: dict[str, int], sources: list[dict[str, str]], prompt_contract: int, seed: int = 42) -> dict[str, Any]:
    """The manifest of a prepared dataset, without records or machine paths: split sizes and id-list hashes come from
    ``splits`` (row_id, split), hashed where the rows are."""
    from callmetrics.operators.splits import list_hash

    held = list_hash(splits, row_id, row_id, ("split",)).collect()  # a row for each split
    made = {
        "dataset_manifest_version": MANIFEST_VERSION, "version": version, "seed": seed, "filter_version": FILTER_VERSION, "split_version": SPLIT_VERSION,
        "prompt_contract_version": prompt_contract, "token_tiers": TIERS, "eligibility_counts": dict(eligibility),
        "sources": sorted(({k: str(v) for k, v in s.items()} for s in sources), key=canonical),
        "split_locks": {r["split"]: {"count": r["n"], "id_hash": r["content_hash"]} for r in held},
    }
    made["content_sha256"] = content_hash(made)
    problems = manifest_problems(made)
    if problems:
        raise ValueError(problems[0])
    return made


def check_dataset_manifest(manifest: dict[str, Any]) -> None:
    """ValueError with the first problem of a manifest."""
    problems = manifest_problems(manifest)
    if problems:
        raise ValueError(problems[0])
