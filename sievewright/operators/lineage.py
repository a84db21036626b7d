"""Content hashes and contracts that guard cached stages."""

from __future__ import annotations

import hashlib
import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievewright import storage


def sha256_file(path: str | Path) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def sha256_json(value: object) -> str:
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":")).encode("utf-8")).hexdigest()


def sha256_tree(root: str | Path, pattern: str = "*.py") -> str:
    """Hash of the names and contents of a folder's files in the order of their names."""
    total = hashlib.sha256()
    for p in sorted(Path(root).rglob(pattern)):
        total.update(f"{p.relative_to(root).as_posix()}\0{sha256_file(p)}\n".encode())
    return total.hexdigest()


def content_hash(df: DataFrame) -> DataFrame:
    """One row (rows, content): a hash that does not depend on order or partitions, pre-aggregated in each task."""
    row = F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns)]), {"ignoreNullFields": "false"}), 256)
    parts = [F.sum(F.conv(F.substring("_h", 1 + 8 * i, 8), 16, 10).cast("decimal(30,0)")) for i in range(8)]
    summed = df.select(row.alias("_h")).agg(F.count("*").alias("rows"), F.sha2(F.concat_ws(":", *[F.coalesce(p, F.lit(0)).cast("string") for p in parts]), 256).alias("content"))
    return summed


def contract(**parts: object) -> dict[str, object]:
    return {"parts": parts, "sha256": sha256_json(parts)}


def check_contract(spark: SparkSession, path: str | Path, wanted: dict[str, object]) -> dict[str, object]:
    """The stored contract; one that differs is an error, never a silent rebuild."""
    found = json.loads(storage.read_text(spark, str(path)))
    if found.get("sha256") != wanted["sha256"]:
        changed = sorted(k for k in {*found["parts"], *wanted["parts"]} if found["parts"].get(k) != wanted["parts"].get(k))
        raise ValueError(f"stale stage: {', '.join(changed)} changed")
    return found


def write_contract(spark: SparkSession, path: str | Path, wanted: dict[str, object], **more: object) -> None:
    """`more` is kept beside the contract, such as the hash of what it guards."""
    storage.write_text(spark, str(path), json.dumps({**wanted, **more}, indent=2, sort_keys=True) + "\n")


def run_fingerprint(seed: int, dataset: dict[str, object], vocabulary: str, model: object = None, training: object = None, quality_model: str | None = None, source: str | None = None) -> dict[str, object]:
    """What a run stands on, and a hash of it: content hashes of the splits, vocabulary and quality model, the model's
    and the training's settings, the seed and the source."""
    parts = {"dataset": dataset, "tokenizer_sha256": sha256_json(vocabulary), "quality_model_sha256": None if quality_model is None else sha256_json(quality_model), "model_config": model, "training_config": training, "seed": seed, "source_sha256": source}
    return {"format_version": 1, "fingerprint_id": sha256_json(parts), "contract": parts}
