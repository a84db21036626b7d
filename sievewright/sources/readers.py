"""Corpora, articles, delimited stories, documents, labels and reports as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievewright import schema
from sievewright.functions.text import SPACE
from sievewright.operators.ordered import prefix_sum

DELIMITER = "<|endoftext|>"
# A top heading, and the artifacts of tokenised article text and what they stand for, in order.
HEADING = r"^=\s*([^=]+?)\s*=$"
ARTIFACTS = (
    (r"\s*@-@\s*", "-"),
    (r"(?<=\d)\s*@,@\s*(?=\d)", ","),
    (r"\s*@,@\s*", ", "),
    (r"(?<=\d)\s*@\.@\s*(?=\d)", "."),
    (r"\s*@\.@\s*", ". "),
)
MAX_FILE_BYTES = 1 << 30


def lines_of(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, line_no, line) of texts, line by line; null texts have none."""
    return df.select(id_col, F.posexplode(F.split(text_col, "\n")).alias("line_no", "line"))


def paragraphs(lines: DataFrame, by: list[str]) -> DataFrame:
    """(by, island, text): runs of lines between blank lines, joined and stripped; only islands with text.

    The running count of blank lines is by `by`, so its groups should be documents or file splits.
    """
    blank = F.regexp_replace("line", f"[{SPACE}]+", "") == ""
    from pyspark.sql import Window

    running = Window.partitionBy(*by).orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = lines.withColumn("island", F.sum(blank.cast("bigint")).over(running)).filter(~blank)
    ordered = F.array_sort(F.collect_list(F.struct("line_no", "line")))
    joined = F.array_join(F.transform(ordered, lambda x: x["line"]), "\n")
    return marked.groupBy(*by, "island").agg(F.regexp_replace(joined, f"^[{SPACE}]+|[{SPACE}]+$", "").alias("text"))


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """(ord, text, source): blank-line separated documents of the text files under `path`, in file and line order.

    Each file is split on its own; a file of more than MAX_FILE_BYTES is an error, larger corpora should be many files.
    """
    files = spark.read.format("binaryFile").load(path)
    content = F.when(F.col("length") <= MAX_FILE_BYTES, F.col("content")).otherwise(F.raise_error(F.lit("a text file is too large; split it")).cast("binary"))
    text = F.regexp_replace(F.decode(content, "UTF-8"), "\r\n?", "\n")
    parts = files.select(F.substring_index("path", "/", -1).alias("source"), "path", F.posexplode(F.split(text, f"\n(?:[{SPACE}&&[^\n]]*\n)+")).alias("_n", "text"))
    parts = parts.withColumn("text", F.regexp_replace("text", f"^[{SPACE}]+|[{SPACE}]+$", "")).filter(F.col("text") != "")
    return prefix_sum(parts, ["path", "_n"], F.lit(1).cast("bigint"), "ord").select("ord", "text", "source")


def clean_article_line(line: Column) -> Column:
    """Title text of headings, artifacts resolved, white space collapsed."""
    heading = F.regexp_extract(line, HEADING, 1)
    sub = F.regexp_replace(line, r"^[= ]+|[= ]+$", "")
    out = F.when(line.rlike(HEADING), F.trim(heading)).when(line.startswith("=") & line.endswith("="), sub).otherwise(line)
    for pattern, value in ARTIFACTS:
        out = F.regexp_replace(out, pattern, value)
    return F.trim(F.regexp_replace(out, f"[{SPACE}]+", " "))


def articles(lines: DataFrame, by: list[str]) -> DataFrame:
    """(by, article, text): lines from one top heading to the next, as one line of text; sub-headings are text."""
    from pyspark.sql import Window

    stripped = lines.withColumn("line", F.regexp_replace("line", f"^[{SPACE}]+|[{SPACE}]+$", ""))
    running = Window.partitionBy(*by).orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = stripped.withColumn("article", F.sum(F.col("line").rlike(HEADING).cast("bigint")).over(running))
    cleaned = marked.withColumn("line", clean_article_line(F.col("line"))).filter(F.col("line") != "")
    ordered = F.array_sort(F.collect_list(F.struct("line_no", "line")))
    return cleaned.groupBy(*by, "article").agg(F.array_join(F.transform(ordered, lambda x: x["line"]), " ").alias("text"))


def delimited(text: Column, delimiter: str = DELIMITER, drop_first: bool = True) -> Column:
    """Array of struct(at, segment): a first fragment is dropped if asked for, and always the last, empty or partial."""
    parts = F.split(text, rf"\Q{delimiter}\E")
    whole = F.slice(parts, 2 if drop_first else 1, F.greatest(F.size(parts) - (2 if drop_first else 1), F.lit(0)))
    return F.transform(whole, lambda x, i: F.struct(i.alias("at"), x.alias("segment")))


def numbered(spark: SparkSession, path: str, separator: str | None = None) -> DataFrame:
    """(file, line_no, line, last): the pieces of text files between separators (line ends), in file order, and whether a
    piece has no separator behind it. Files are split and read in parallel; numbers come from range sums."""
    reader = spark.read.option("lineSep", separator) if separator else spark.read
    meta = F.col("_metadata")
    rows = reader.text(path).select(meta["file_path"].alias("file"), meta["file_size"].alias("size"), meta["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"))
    rows = prefix_sum(rows, ["block", "at"], F.lit(1).cast("bigint"), "line_no", ("file",))
    ends = rows.groupBy("file").agg(F.max("line_no").alias("end"), (F.sum(F.octet_length("line")) + F.count("*") * len((separator or "\n").encode()) == F.max("size")).alias("closed"))
    return rows.join(ends, "file").select("file", "line_no", "line", ((F.col("line_no") == F.col("end")) & ~F.col("closed")).alias("last"))


def read_delimited(spark: SparkSession, path: str, delimiter: str = DELIMITER, drop_first: bool = True) -> DataFrame:
    """(ord, file, segment): segments of text files between delimiters, in file order, without the first fragment of each
    file if asked for and always without its last, which is empty or partial."""
    rows = numbered(spark, path, delimiter)
    return prefix_sum(rows.filter(~F.col("last") & ((F.col("line_no") > 0) | F.lit(not drop_first))), ["file", "line_no"], F.lit(1).cast("bigint"), "ord").select("ord", "file", F.col("line").alias("segment"))


def read_articles(spark: SparkSession, path: str) -> DataFrame:
    """(ord, file, text): articles of the text files under `path`, in file order; none goes beyond its file.

    The number of headings before a line comes from range sums, so a file is no single task; an article is a row.
    """
    lines = numbered(spark, path).withColumn("line", F.regexp_replace("line", f"^[{SPACE}]+|[{SPACE}]+$", ""))
    heads = prefix_sum(lines.withColumn("_h", F.col("line").rlike(HEADING).cast("bigint")), ["line_no"], "_h", "_before", ("file",))
    cleaned = heads.withColumn("article", F.col("_before") + F.col("_h")).withColumn("line", clean_article_line(F.col("line"))).filter(F.col("line") != "")
    ordered = F.array_sort(F.collect_list(F.struct("line_no", "line")))
    joined = cleaned.groupBy("file", "article").agg(F.array_join(F.transform(ordered, lambda x: x["line"]), " ").alias("text"))
    return prefix_sum(joined, ["file", "article"], F.lit(1).cast("bigint"), "ord").select("ord", "file", "text")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Documents from JSON lines; blank lines are skipped and malformed ones are an error."""
    return spark.read.schema(schema.DOCUMENT).option("mode", "FAILFAST").json(path)


def read_examples(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schema.QUALITY_EXAMPLE).option("mode", "FAILFAST").json(path)


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Review sheets with a header; cells stay text."""
    return spark.read.option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True).csv(path)


def read_reports(spark: SparkSession, path: str, kind: T.StructType | None = None) -> DataFrame:
    """Whole-file JSON reports."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(kind) if kind else reader).json(path)


def read_tokens(spark: SparkSession, folder: str, contract: dict) -> DataFrame:
    """A token cache, if its contract is the wanted one and its rows are those that were written; else an error."""
    from sievewright.operators.lineage import check_contract, content_hash

    stored = check_contract(spark, f"{folder}/contract.json", contract)
    found = spark.read.parquet(f"{folder}/spans")
    if stored.get("cache_content") != content_hash(found).first()["content"]:
        raise ValueError("the token cache was changed after it was written")
    return found


def take_characters(df: DataFrame, order: list[str], text_col: str, budget: int) -> tuple[DataFrame, DataFrame]:
    """(rows, manifest): whole rows in order until their characters reach `budget`, and one row (rows, characters,
    content). A source with fewer characters is an error."""
    from sievewright.operators.lineage import content_hash
    from sievewright.operators.ordered import budget_prefix
    from sievewright.session import cut

    kept = cut(budget_prefix(df, order, F.length(text_col), budget))
    characters = kept.agg(F.coalesce(F.sum(F.length(text_col)), F.lit(0)).alias("characters"))
    if characters.first()[0] < budget:
        raise ValueError("the source ends before the budget")
    return kept, content_hash(kept).join(characters)
