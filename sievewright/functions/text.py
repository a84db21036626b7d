"""Text functions: native expressions, and Arrow UDFs where Spark has no counterpart (NFKC, case folding, blake2b)."""

from __future__ import annotations

import hashlib
import re
import unicodedata

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from sievewright.functions.units import CJK_RANGES, distinct_by_document, normalized_words, sequence_hashes, shingle_sets, unit_blocks

# What Python's re counts as white space, in the syntax of Java and of RE2.
SPACE = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
WORD = r"\p{L}\p{N}_"
CJK_CLASS = "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in CJK_RANGES) + "]"
# The patterns of the masking rules and their placeholders.
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"
PHONE = r"(?<!\w)(?:\+?1[-.\s]?)?(?:\(?\d{3}\)?[-.\s]?)\d{3}[-.\s]?\d{4}(?!\w)"
IPV4 = r"(?<!\d)(?:\d{1,3}\.){3}\d{1,3}(?!\d)"
EMAIL_MASK, PHONE_MASK, IPV4_MASK = "|||EMAIL_ADDRESS|||", "|||PHONE_NUMBER|||", "|||IP_ADDRESS|||"
PII_KEYS = ("email", "phone", "ipv4")


NON_ASCII = r"[^\x00-\x7F]"
_W = f"[{WORD}]"
_EDGE = f"(?:(?<={_W})(?!{_W})|(?<!{_W})(?={_W}))"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"
# The same patterns for Java: word characters of all scripts, an edge where Python has \b, and white space as above.
EMAIL_JAVA = EMAIL.replace(r"\b", _EDGE)
PHONE_JAVA = PHONE.replace(r"\s", SPACE).replace(r"\w", _W).replace(r"\d", r"\p{Nd}")
IPV4_JAVA = IPV4.replace(r"\d", r"\p{Nd}")
#: What every phone number and IPv4 candidate holds; texts without it skip the whole pattern.
_PHONE_CORE, _IPV4_CORE = rf"\p{{Nd}}{{3}}[-.{SPACE}]?\p{{Nd}}{{4}}", r"\p{Nd}\.\p{Nd}{1,3}\.\p{Nd}"
#: Marks around an IPv4 candidate while its octets are checked; normalised text has no NUL.
_VALID_JAVA = rf"\x00({_OCTET}(?:\.{_OCTET}){{3}})\x00"


def normalize_value(text: str | None) -> str | None:
    if text is None:
        return None
    return " ".join(unicodedata.normalize("NFKC", text).replace("\x00", " ").split())


def mask_value(text: str) -> tuple[str, int, int, int]:
    """(text, email, phone, ipv4) of one text, for tests: items masked one kind after another."""
    text, n_email = re.subn(EMAIL, EMAIL_MASK, text)
    text, n_phone = re.subn(PHONE, PHONE_MASK, text)
    valid = lambda m: max(map(int, m[0].split("."))) <= 255
    n_ipv4 = sum(valid(m) for m in re.finditer(IPV4, text))
    return re.sub(IPV4, lambda m: IPV4_MASK if valid(m) else m[0], text), n_email, n_phone, n_ipv4


@F.pandas_udf(T.StringType())
def _nfkc(values: pd.Series) -> pd.Series:
    return values.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def nfkc(c: Column) -> Column:
    """NFKC. Only texts with other than ASCII characters are sent to Python; of the others a null is."""
    return F.coalesce(_nfkc(F.when(c.rlike(NON_ASCII), c)), c)


def collapse_space(c: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(c, f"[{SPACE}]+", " "))


def normalize_text(c: Column) -> Column:
    """Compatibility forms unified, NUL and white space as single blanks."""
    return collapse_space(F.regexp_replace(nfkc(c), "\x00", " "))


def with_masked(df: DataFrame, text_col: str, out: str = "text") -> DataFrame:
    """Adds `out` and the counts email, phone, ipv4 of normalised text: items replaced one kind after another, by native
    expressions. Null stays null with zero counts. An IPv4 candidate is taken as a whole, then its octets are checked;
    only ASCII digits are octets.
    """
    t = F.col(text_col)
    has = lambda c, sign, then: F.when(c.contains(sign), then).otherwise(c)
    df = df.withColumn("_m1", has(t, "@", F.regexp_replace(t, EMAIL_JAVA, EMAIL_MASK)))
    df = df.withColumn("_m2", F.when(F.col("_m1").rlike(_PHONE_CORE), F.regexp_replace("_m1", PHONE_JAVA, PHONE_MASK)).otherwise(F.col("_m1")))
    df = df.withColumn("_m3", F.when(F.col("_m2").rlike(_IPV4_CORE), F.regexp_replace("_m2", IPV4_JAVA, "\x00$0\x00")).otherwise(F.col("_m2")))
    count = lambda c, when, pattern: F.coalesce(F.when(when, F.regexp_count(c, F.lit(pattern))), F.lit(0)).cast("bigint")
    df = df.withColumns({
        "_n1": count(t, t.contains("@"), EMAIL_JAVA),
        "_n2": count(F.col("_m1"), F.col("_m1") != F.col("_m2"), PHONE_JAVA),
        "_n3": count(F.col("_m3"), F.col("_m3").contains("\x00"), _VALID_JAVA),
        "_m4": has(F.col("_m3"), "\x00", F.regexp_replace(F.regexp_replace("_m3", _VALID_JAVA, IPV4_MASK), "\x00", "")),
    })
    return df.withColumns({out: F.col("_m4"), **{k: F.col(f"_n{i + 1}") for i, k in enumerate(PII_KEYS)}}).drop("_m1", "_m2", "_m3", "_m4", "_n1", "_n2", "_n3")


def pii_map() -> Column:
    """The counts that with_masked adds, as a map."""
    return F.create_map(*[x for k in PII_KEYS for x in (F.lit(k), F.col(k))])


@F.pandas_udf(T.ArrayType(T.StringType()))
def words(values: pd.Series) -> pd.Series:
    """Dedup units; null gives an empty list."""
    return values.map(normalized_words)


def _digest(size: int):
    @F.pandas_udf(T.StringType())
    def digest(values: pd.Series) -> pd.Series:
        return values.map(lambda t: None if t is None else hashlib.blake2b(t.encode("utf-8"), digest_size=size).hexdigest())

    return digest


digest6, digest8, digest12 = _digest(6), _digest(8), _digest(12)


PROFILE = T.StructType([T.StructField("n_units", T.IntegerType()), T.StructField("n_distinct", T.IntegerType()), T.StructField("h1", T.LongType()), T.StructField("h2", T.LongType()), T.StructField("shingles", T.ArrayType(T.LongType()))])


def unit_profile(n: int):
    """Arrow UDF from text to its number of units and of distinct ones, two hashes of their sequence, and the hashes
    of its distinct n-unit shingles; null is as empty text. No strings of units leave the worker."""

    def profile(texts: pa.Array) -> pa.Array:
        parts = []
        for low, high, units in unit_blocks(texts.to_pylist()):
            parts.append(pa.StructArray.from_arrays([*_counted(units, high - low), _shingled(units, n)], names=[f.name for f in PROFILE]))
        if not parts:
            return pa.array([], to_arrow_type(PROFILE))
        return pa.concat_arrays(parts)

    return F.arrow_udf(profile, PROFILE)


COUNTS = T.StructType([f for f in PROFILE if f.name != "shingles"])


def _counted(units, n: int) -> list[pa.Array]:
    distinct = np.diff(distinct_by_document(units.hashes, units.doc, n)[1])
    h1, h2 = sequence_hashes(units)
    return [pa.array(units.counts, pa.int32()), pa.array(distinct, pa.int32()), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64))]


def _shingled(units, n: int) -> pa.Array:
    flat, offsets = shingle_sets(units, n)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat.view(np.int64)))


def unit_counts():
    """Arrow UDF from text to its number of units and of distinct ones and two hashes of their sequence; null is as
    empty text. No strings of units leave the worker."""

    def count(texts: pa.Array) -> pa.Array:
        parts = [pa.StructArray.from_arrays(_counted(u, high - low), names=[f.name for f in COUNTS]) for low, high, u in unit_blocks(texts.to_pylist())]
        return pa.concat_arrays(parts) if parts else pa.array([], to_arrow_type(COUNTS))

    return F.arrow_udf(count, COUNTS)


def shingle_hashes(n: int):
    """Arrow UDF from text to the hashes of its distinct n-unit shingles; null and empty texts have none."""

    def shingles(texts: pa.Array) -> pa.Array:
        parts = [_shingled(u, n) for _, _, u in unit_blocks(texts.to_pylist())]
        return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.int64()))

    return F.arrow_udf(shingles, T.ArrayType(T.LongType()))


def canonical_key(profile: Column, text: Column) -> Column:
    """What exact duplicates share: the sequence of units, or where there are none the folded text."""
    units = F.concat_ws(":", profile["h1"].cast("string"), profile["h2"].cast("string"))
    return F.when(profile["n_units"] > 0, units).otherwise(F.concat(F.lit("t"), F.sha2(F.lower(F.coalesce(text, F.lit(""))), 256)))


def canonical_units(units: Column, text: Column) -> Column:
    """Text that exact duplicates share: the units, or where there are none the folded text."""
    return F.when(F.size(units) > 0, F.array_join(units, " ")).otherwise(F.lower(text))


def word_ngrams(units: Column, n: int) -> Column:
    """Distinct n-word shingles; fewer words give one shingle, none an empty array."""
    size = F.size(units)
    many = F.array_distinct(F.transform(F.sequence(F.lit(1), size - (n - 1)), lambda i: F.array_join(F.slice(units, i, n), " ")))
    return F.when(size == 0, F.array().cast("array<string>")).when(size < n, F.array(F.array_join(units, " "))).otherwise(many)


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays without repeats; two empty ones are equal."""
    shared = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - shared
    return F.when(union == 0, F.lit(1.0)).otherwise(shared / union)


def is_cjk(c: Column) -> Column:
    return c.rlike(CJK_CLASS)


def pretokens(c: Column) -> Column:
    """Lossless pieces: runs of white space, of word characters, of others."""
    return F.regexp_extract_all(c, F.lit(f"[{SPACE}]+|[{WORD}]+|[^{SPACE}{WORD}]+"), 0)


def canonical_story(c: Column) -> Column:
    """NFKC, outer white space off, blank lines inside removed."""
    stripped = F.regexp_replace(nfkc(c), f"^[{SPACE}]+|[{SPACE}]+$", "")
    return F.regexp_replace(stripped, r"\n[ \t]*\n+", "\n")


def order_key(seed: int, c: Column) -> Column:
    """Seeded SHA-256 order key."""
    return F.sha2(F.concat(F.lit(str(seed)), F.lit("\x00"), c), 256)


def excerpt(c: Column, start: Column | int, width: int = 380) -> Column:
    """`width` characters from the 0-based `start`, white space collapsed."""
    first = (start if isinstance(start, Column) else F.lit(start)) + 1
    return collapse_space(F.substring(c, first, F.lit(width)))


def preview(c: Column, width: int = 500) -> Column:
    return F.regexp_replace(F.substring(c, 1, width), "\n", " ")


def sigmoid(c: Column) -> Column:
    return 1 / (1 + F.exp(-F.least(F.greatest(c, F.lit(-30.0)), F.lit(30.0))))


def chat_prompt(system: str, turns: Column) -> Column:
    """Prompt from an ordered array of struct(user, assistant); a turn without an answer is left open for one."""
    line = lambda t: F.concat(F.lit("User: "), F.trim(t["user"]), F.lit("\nAssistant:"), F.coalesce(F.concat(F.lit(" "), F.trim(t["assistant"])), F.lit("")))
    return F.concat_ws("\n\n", F.lit(system.strip()), F.array_join(F.transform(turns, line), "\n\n"))


def cut_reply(c: Column) -> Column:
    """A reply up to where the next turn would begin."""
    return F.substring_index(F.substring_index(c, "\n\nUser:", 1), "\nUser:", 1)
