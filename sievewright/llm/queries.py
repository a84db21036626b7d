"""The pN_ queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievewright import sql
from sievewright.functions.text import SPACE
from sievewright.llm import encoding, leakage, mixing, nearcopies, overlaps, packing, pii, prose, repetition, sampling
from sievewright.session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prose.not_prose(table(spark, sf_dir, "documents"))


def p1_quality_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prose.text_quality(table(spark, sf_dir, "documents"))


def p1_rule_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prose.rule_counts(p1_quality_stats(spark, sf_dir))


def p2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_spans(table(spark, sf_dir, "document_spans"))


def p2_window_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.window_fill(p2_packing(spark, sf_dir))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p3_leak_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leak_report(p3_found(spark, sf_dir), table(spark, sf_dir, "eval_items"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.found_kinds(table(spark, sf_dir, "documents"))


def p4_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_information(table(spark, sf_dir, "documents"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearcopies.near_pairs(table(spark, sf_dir, "documents"))


def p5_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearcopies.groups(table(spark, sf_dir, "documents"))


def p6_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.block_sample(table(spark, sf_dir, "documents").select("doc_id"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = overlaps.overlaps(table(spark, sf_dir, "prepared_docs"))
    return found.select(F.least("train", "held").alias("doc_id_a"), F.greatest("train", "held").alias("doc_id_b"))


def p7_overlap_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlaps.overlap_report(table(spark, sf_dir, "prepared_docs"))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.encode(table(spark, sf_dir, "documents"))


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "source_targets"))[0]


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "source_targets"))[1]


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.repetitive(table(spark, sf_dir, "documents"))


def p10_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.repetition_stats(table(spark, sf_dir, "documents"))


def p10_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.line_frequency(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name[0] == "p" and name[1:2].isdigit()}


_DOCS = f"WITH RECURSIVE d0 AS (SELECT doc_id AS id, text AS t FROM documents WHERE text IS NOT NULL), {sql.units('d0', 'd')}"
_LEAKS = f"""{_DOCS}, e0 AS (SELECT item_id AS id, text AS t FROM eval_items WHERE text IS NOT NULL), {sql.units("e0", "e")}, {sql.run_rows("d", "dr", 10)}, {sql.run_rows("e", "er", 10)},
own AS (SELECT h, min(id) AS item_id FROM er GROUP BY h HAVING count(*) = 1), found AS (SELECT DISTINCT id AS doc_id, item_id FROM dr JOIN own USING (h))"""
_ALIKE = "count(*) >= 0.6 * (p.n + q.n - count(*))"
_LONG = f"""l AS (SELECT id, w FROM d WHERE len(w) >= 20), {sql.run_rows("l", "r", 3)}, n AS (SELECT id, count(*) AS n FROM r GROUP BY id)"""
_CLASSES = f"""{_DOCS}, l0 AS (SELECT id, w, min(id) OVER (PARTITION BY array_to_string(w, ' ')) AS rep, count(*) OVER (PARTITION BY array_to_string(w, ' ')) AS copies FROM d WHERE len(w) >= 20),
l AS (SELECT id, w FROM l0 WHERE id = rep), {sql.run_rows("l", "r", 3)}, n AS (SELECT id, count(*) AS n FROM r GROUP BY id),
pairs AS (SELECT x.id AS a, y.id AS b FROM r x JOIN r y ON x.h = y.h AND x.id < y.id JOIN n p ON p.id = x.id JOIN n q ON q.id = y.id GROUP BY x.id, y.id, p.n, q.n HAVING {_ALIKE}),
links AS (SELECT a, b FROM pairs UNION SELECT rep, rep FROM l0 WHERE copies > 1), {sql.components("links", "roots")}, met AS (SELECT id, count(*) AS links FROM (SELECT a AS id FROM pairs UNION ALL SELECT b FROM pairs) GROUP BY id)"""
_PREPARED = f"WITH RECURSIVE last AS (SELECT doc_id AS id, text AS t, source, row_number() OVER (PARTITION BY doc_id ORDER BY loaded_at DESC NULLS LAST, text DESC NULLS LAST) AS k FROM prepared_docs WHERE split_part(doc_id, '-', 1) IN ('train', 'validation', 'test')), d0 AS (SELECT id, t FROM last WHERE k = 1 AND t IS NOT NULL), {sql.units('d0', 'd')}, {_LONG}, cross_pairs AS (SELECT x.id AS a, y.id AS b, count(*) / (p.n + q.n - count(*)) AS similarity FROM r x JOIN r y ON x.h = y.h AND starts_with(x.id, 'train-') AND NOT starts_with(y.id, 'train-') JOIN n p ON p.id = x.id JOIN n q ON q.id = y.id GROUP BY x.id, y.id, p.n, q.n HAVING {_ALIKE})"
_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
_REPEATS = f"""{_DOCS}, g AS (SELECT id, count(*) AS n_runs, count(*) - count(DISTINCT h) AS repeated_runs FROM (SELECT id, {sql.run("w", "i", 5)} AS h FROM (SELECT id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)) GROUP BY id),
parts AS (SELECT id, unnest(regexp_split_to_array(t, '{_BREAK}')) AS part FROM d0), lines AS (SELECT id, regexp_replace(part, '^[{SPACE}]+|[{SPACE}]+$', '', 'g') AS line FROM parts),
k AS (SELECT id, sum(n * length(line)) AS total, sum(length(line)) AS once FROM (SELECT id, line, count(*) AS n FROM lines WHERE line <> '' GROUP BY id, line) GROUP BY id),
stats AS (SELECT doc_id, coalesce(len(w), 0)::BIGINT AS n_words, coalesce(n_runs, 0) AS n_runs, coalesce(repeated_runs, 0) AS repeated_runs, coalesce((total - once) / total, 0.0) AS line_share FROM documents LEFT JOIN d ON d.id = doc_id LEFT JOIN g ON g.id = doc_id LEFT JOIN k ON k.id = doc_id)"""


def oracle_sql() -> dict[str, str]:
    return {
        "p3_found": _LEAKS + " SELECT * FROM found",
        "p3_leak_report": _LEAKS + " SELECT count(DISTINCT doc_id) AS decontaminated_documents_dropped, count(DISTINCT item_id) AS leaked_items, count(*) AS pairs, (SELECT count(DISTINCT item_id) FROM eval_items WHERE item_id NOT IN (SELECT item_id FROM own)) AS items_without_own_run FROM found",
        "p5_found": f"{_DOCS}, {_LONG} SELECT x.id AS doc_id_a, y.id AS doc_id_b FROM r x JOIN r y ON x.h = y.h AND x.id < y.id JOIN n p ON p.id = x.id JOIN n q ON q.id = y.id GROUP BY x.id, y.id, p.n, q.n HAVING {_ALIKE}",
        "p5_groups": _CLASSES + ' SELECT l0.id AS doc_id, root AS "group", copies, coalesce(links, 0) AS links FROM l0 JOIN roots ON roots.id = rep LEFT JOIN met ON met.id = rep',
        "p6_sample": sampling.sample_sql(),
        "p7_found": _PREPARED + " SELECT least(a, b) AS doc_id_a, greatest(a, b) AS doc_id_b FROM cross_pairs",
        "p7_overlap_report": _PREPARED + ", f AS (SELECT b AS id, max(similarity) >= 1 AS exact FROM cross_pairs GROUP BY b) SELECT split_part(s.id, '-', 1) AS split, s.source AS source, count(*) AS records, count(exact) AS overlapping, count(*) FILTER (exact) AS exact FROM (SELECT doc_id AS id, max(o)['source'] AS source FROM (SELECT doc_id, {'at': loaded_at, 'source': source} AS o FROM prepared_docs WHERE split_part(doc_id, '-', 1) IN ('validation', 'test')) GROUP BY doc_id) s LEFT JOIN f USING (id) GROUP BY 1, s.source",
        "p10_found": _REPEATS + " SELECT doc_id FROM stats WHERE n_words >= 20 AND repeated_runs >= 0.30 * n_runs",
        "p10_repetition": _REPEATS + " SELECT doc_id, n_words, n_runs, repeated_runs, repeated_runs / greatest(n_runs, 1) AS repeated_share, line_share FROM stats",
        "p10_line_frequency": repetition.line_frequency_sql(),
    }
