"""Sinks: documents, texts, review sheets, token caches and manifests."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievewright import storage
from sievewright.functions.text import SPACE, excerpt, preview
from sievewright.operators.lineage import content_hash, write_contract


def write_documents(df: DataFrame, path: str, ord_col: str = "ord") -> None:
    """JSON lines with keys in order, globally range-sorted by `ord_col`."""
    names = sorted(c for c in df.columns if c != ord_col)
    df.orderBy(ord_col).select(*names).write.mode("errorifexists").option("ignoreNullFields", False).json(path)


def write_texts(df: DataFrame, path: str, text_col: str = "text", ord_col: str = "ord") -> None:
    """Blank-line separated texts in order."""
    df.orderBy(ord_col).select(F.concat(F.col(text_col), F.lit("\n")).alias("value")).write.mode("errorifexists").text(path)


def text_manifest(df: DataFrame, text_col: str = "text", ord_col: str = "ord", by: tuple[str, ...] = ()) -> DataFrame:
    """corpus_counts by `by` with a content hash of the rows (ord, text), which holds however they are partitioned."""
    counts = corpus_counts(df, text_col, by)
    rows = df.select(*by, F.sha2(F.concat_ws(":", F.col(ord_col).cast("string"), F.sha2(F.coalesce(text_col, F.lit("")), 256)), 256).alias("_h"))
    parts = [F.sum(F.conv(F.substring("_h", 1 + 8 * i, 8), 16, 10).cast("decimal(30,0)")).cast("string") for i in range(8)]
    hashes = rows.groupBy(*by).agg(F.sha2(F.concat_ws(":", *parts), 256).alias("sha256"))
    return counts.join(hashes, list(by)) if by else counts.join(hashes)


def corpus_counts(df: DataFrame, text_col: str, by: tuple[str, ...] = ()) -> DataFrame:
    """By `by`: documents, characters, words (runs without white space) and bytes; null texts count as documents."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    words = F.size(F.regexp_extract_all(t, F.lit(f"[^{SPACE}]+"), 0))
    return df.groupBy(*by).agg(F.count("*").alias("documents"), F.sum(F.length(t)).alias("characters"), F.sum(words).alias("words"), F.sum(F.octet_length(t)).alias("bytes"))


def write_review(df: DataFrame, path: str, id_col: str, text_col: str, order_col: str = "draw") -> None:
    """A blinded sheet (id, text_preview, human_label) in draw order; an existing sheet must hold the same ids."""
    sheet = df.orderBy(order_col).select(F.col(id_col).cast("string").alias("doc_id"), preview(F.col(text_col)).alias("text_preview"), F.lit("").alias("human_label"))
    if storage.exists(df.sparkSession, path):
        found = df.sparkSession.read.option("header", True).option("escape", '"').csv(path).select("doc_id")
        ids = sheet.select("doc_id")
        if found.exceptAll(ids).limit(1).count() or ids.exceptAll(found).limit(1).count():
            raise ValueError("the existing review sheet has other documents")
        return
    sheet.coalesce(1).write.option("header", True).option("escape", '"').csv(path)


def review_excerpts(df: DataFrame, id_col: str, text_col: str, width: int = 380) -> DataFrame:
    """(id, excerpt_start, excerpt_middle, excerpt_end, human_label, reason)."""
    t, n = F.col(text_col), F.length(text_col)
    middle, tail = F.greatest(F.lit(0), F.floor((n - width) / 2).cast("int")), F.greatest(F.lit(0), n - width)
    return df.select(id_col, excerpt(t, 0, width).alias("excerpt_start"), excerpt(t, middle, width).alias("excerpt_middle"), excerpt(t, tail, width).alias("excerpt_end"), F.lit("").alias("human_label"), F.lit("").alias("reason"))


def write_tokens(df: DataFrame, folder: str, contract: dict) -> None:
    """Token spans as parquet with the contract that guards them."""
    df.write.mode("errorifexists").parquet(f"{folder}/spans")
    seal_tokens(df.sparkSession, folder, contract)


def seal_tokens(spark: SparkSession, folder: str, contract: dict, **more: object) -> str:
    """Writes the contract of the token cache in `folder` with the content hash of its rows, which it gives back."""
    content = content_hash(spark.read.parquet(f"{folder}/spans")).first()["content"]
    write_contract(spark, f"{folder}/contract.json", contract, cache_content=content, **more)
    return content


def write_once(df: DataFrame, path: str) -> None:
    """Writes parquet; an existing table must be equal."""
    if storage.exists(df.sparkSession, path):
        old = df.sparkSession.read.parquet(path)
        if old.exceptAll(df).limit(1).count() or df.exceptAll(old).limit(1).count():
            raise ValueError(f"{path} exists with other rows")
        return
    df.write.parquet(path)


def write_manifest(row: DataFrame, path: str, **more: object) -> dict:
    """A one-row report as JSON."""
    value = json.loads(row.toJSON().first()) | more
    storage.write_text(row.sparkSession, path, json.dumps(value, indent=2, ensure_ascii=False, sort_keys=True) + "\n")
    return value


def append_metrics(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def dataset_card(name: str, counts: dict[str, dict], seed: int) -> str:
    """Markdown that describes a split."""
    lines = [f"# {name}", "", f"Split by a seeded hash of the text (seed {seed}); exact copies removed first.", "", "| split | documents | words |", "|---|---|---|"]
    return "\n".join(lines + [f"| {k} | {v['documents']} | {v['words']} |" for k, v in counts.items()]) + "\n"
