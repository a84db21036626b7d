"""The text functions in DuckDB's SQL, for the checks of the queries: compatibility forms, white space, masking, units.

Every function gives CTEs to be put behind WITH. Spark and DuckDB share no code here: DuckDB has no NFKC and no case
folding, so both are made from tables of single characters that Python's unicodedata gives, then NFC of DuckDB.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

from sievewright.functions.text import CJK_CLASS, EMAIL, EMAIL_MASK, IPV4_MASK, PHONE_MASK, SPACE, WORD

_MARK, _FENCE = "chr(983040)", "chr(983041)"
_M = r"\x{F0000}"


def _values(pairs: list[tuple[int, str]]) -> str:
    return ", ".join(f"({code}, {' || '.join(f'chr({ord(c)})' for c in text) or chr(39) * 2})" for code, text in pairs)


@lru_cache(maxsize=1)
def compatibility_table() -> str:
    """Rows (code, text) of the characters whose compatibility form is not their canonical one."""
    codes = (c for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000)
    return _values([(c, unicodedata.normalize("NFKD", chr(c))) for c in codes if unicodedata.normalize("NFKC", chr(c)) != unicodedata.normalize("NFC", chr(c))])


@lru_cache(maxsize=1)
def folding_table() -> str:
    """Rows (code, text) of the characters that case folding does not just lower."""
    codes = (c for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000)
    return _values([(c, chr(c).casefold()) for c in codes if chr(c).casefold() != chr(c).lower() or len(chr(c).lower()) > 1])


def mapped(source: str, out: str, table: str, tail: str) -> str:
    """CTE `out` (id, t): texts of `source` (id, t) with the characters of `table` replaced, then the expression `tail` of t."""
    return rf"""{out}_c AS (SELECT id, unnest(regexp_extract_all(t, '(?s).')) AS c, generate_subscripts(regexp_extract_all(t, '(?s).'), 1) AS i FROM {source} WHERE regexp_matches(t, '[^\x00-\x7F]')),
{out}_m AS (SELECT id, string_agg(coalesce(r, c), '' ORDER BY i) AS t FROM {out}_c LEFT JOIN (VALUES {table}) AS m(code, r) ON unicode(c) = code GROUP BY id),
{out} AS (SELECT id, {tail} AS t FROM (SELECT s.id, coalesce(m.t, s.t) AS t FROM {source} s LEFT JOIN {out}_m m USING (id)))"""


def compatible(source: str, out: str) -> str:
    """CTE `out`: NFKC."""
    return mapped(source, out, compatibility_table(), "nfc_normalize(t)")


def squeezed(t: str) -> str:
    return rf"regexp_replace(regexp_replace(t, '[{SPACE}\x00]+', ' ', 'g'), '^ +| +$', '', 'g')".replace("(t,", f"({t},")


def normalized(source: str, out: str) -> str:
    """CTE `out`: texts as the curation normalises them."""
    return compatible(source, f"{out}_k") + f", {out} AS (SELECT id, {squeezed('t')} AS t FROM {out}_k)"


def masked(source: str, out: str) -> str:
    """CTE `out` (id, t, email, phone, ipv4) of normalised texts. RE2 has no lookaround: a mark behind every character
    that ends a word, or is no digit, stands for it, so that two items may share the character between them."""
    octet = "(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"
    sep = rf"(?:[-. ]{_M})?"
    phone = rf"(^|{_M})(?:(?:\+{_M})?1{sep})?(?:\(?{_M}?[0-9]{{3}}\)?{_M}?{sep})[0-9]{{3}}{sep}[0-9]{{4}}($|[^{WORD}])".replace(rf"\(?{_M}?", rf"(?:\({_M})?").replace(rf"\)?{_M}?", rf"(?:\){_M})?")
    fenced = rf"(^|{_M})((?:[0-9]{{1,3}}\.{_M}){{3}}[0-9]{{1,3}})($|[^0-9])"
    valid = rf"\x{{F0001}}{octet}(?:\.{_M}{octet}){{3}}\x{{F0001}}"
    return rf"""{out}_1 AS (SELECT id, len(regexp_extract_all(t, '{EMAIL}')) AS email, regexp_replace(regexp_replace(t, '{EMAIL}', '{EMAIL_MASK}', 'g'), '([^{WORD}])', '\1' || {_MARK}, 'g') AS t FROM {source}),
{out}_2 AS (SELECT id, email, len(regexp_extract_all(t, '{phone}')) AS phone, regexp_replace(replace(regexp_replace(t, '{phone}', '\1{PHONE_MASK}\2', 'g'), {_MARK}, ''), '([^0-9])', '\1' || {_MARK}, 'g') AS t FROM {out}_1),
{out}_3 AS (SELECT id, email, phone, regexp_replace(t, '{fenced}', '\1' || {_FENCE} || '\2' || {_FENCE} || '\3', 'g') AS t FROM {out}_2),
{out} AS (SELECT id, email, phone, len(regexp_extract_all(t, '{valid}')) AS ipv4, replace(replace(regexp_replace(t, '{valid}', '{IPV4_MASK}', 'g'), {_MARK}, ''), {_FENCE}, '') AS t FROM {out}_3)"""


def units(source: str, out: str) -> str:
    """CTE `out` (id, w): the dedup units of texts."""
    cjk = CJK_CLASS
    return (
        compatible(source, f"{out}_k")
        + ", "
        + mapped(f"{out}_k", f"{out}_f", folding_table(), "lower(t)")
        + rf""", {out} AS (SELECT id, CASE WHEN regexp_matches(t, '{cjk}') THEN regexp_extract_all(regexp_replace(t, '({cjk})', ' \1 ', 'g'), '[\p{{L}}\p{{N}}\p{{M}}]+') ELSE regexp_extract_all(t, '[\p{{L}}\p{{N}}]+') END AS w FROM {out}_f)"""
    )


def run(w: str, i: str, k: int) -> str:
    """The k units of list `w` from place i on, as one text."""
    return f"array_to_string({w}[{i}:{i} + {k - 1}], ' ')"


def run_rows(source: str, out: str, k: int, short: bool = False) -> str:
    """CTE `out` (id, h): the distinct k-runs of unit lists (id, w), a row for each; with `short` fewer units are one run."""
    whole = f" UNION ALL SELECT id, array_to_string(w, ' ') FROM {source} WHERE len(w) BETWEEN 1 AND {k - 1}" if short else ""
    return f"{out} AS (SELECT DISTINCT id, h FROM (SELECT id, {run('w', 'i', k)} AS h FROM (SELECT id, w, unnest(range(1, len(w) - {k - 2})) AS i FROM {source} WHERE len(w) >= {k}){whole}))"


def reason(t: str, w: str, min_words: int, min_alpha: float) -> str:
    """The first drop rule that a text `t` with units `w` breaks, or null."""
    visible, alpha = f"length(regexp_replace({t}, '[{SPACE}]+', '', 'g'))", rf"length(regexp_replace({t}, '[^\p{{L}}]+', '', 'g'))"
    return f"CASE WHEN len({w}) < {min_words} THEN 'too_few_words' WHEN {alpha} / greatest({visible}, 1) < {min_alpha} THEN 'low_alpha_ratio' WHEN len({w}) > 4 AND len(list_distinct({w})) = 1 THEN 'repetitive_text' END"


def components(edges: str, out: str) -> str:
    """CTE `out` (id, root) of an edge table (a, b); goes behind WITH RECURSIVE."""
    both = f"{out}_e AS (SELECT a AS x, b AS y FROM {edges} UNION SELECT b, a FROM {edges})"
    return f"{both}, {out}_r AS (SELECT DISTINCT x AS id, x AS root FROM {out}_e UNION SELECT e.y, r.root FROM {out}_r r JOIN {out}_e e ON e.x = r.id), {out} AS (SELECT id, min(root) AS root FROM {out}_r GROUP BY id)"
