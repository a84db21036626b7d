"""Queries of the corpus operators over the test tables, each with the SQL that checks it where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievewright import sql
from sievewright.config import CurationConfig
from sievewright.functions import text as tx
from sievewright.functions.quality import drop_reason, prose_features
from sievewright.operators import bpe, likelihood, reports, spans, splits
from sievewright.operators.classifier import QualityClassifier, class_weights, train_classifier
from sievewright.operators.decontam import max_similarity
from sievewright.operators.dedup import exact_dedup, near_duplicates
from sievewright.operators.lineage import content_hash
from sievewright.operators.ordered import budget_prefix
from sievewright.plans import audit
from sievewright.plans.curation import ablate, curate
from sievewright.session import cut, table
from sievewright.sources.readers import articles, lines_of, paragraphs
from sievewright.sources.writers import corpus_counts, review_excerpts

SEQ_LEN = 256
STRIDE = 128
#: The measured profile of the near-duplicate and decontamination stages.
PROFILE = CurationConfig(min_alpha_ratio=0.55, near_dedup_threshold=0.82, num_bands=16, decontamination_threshold=0.8)

_FOUND: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        _FOUND[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select(F.col("doc_id").alias("ord"), "text", F.coalesce("source", F.lit("")).alias("source"))


def unit_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", tx.normalize_text(F.coalesce("text", F.lit(""))).alias("text"))


def held_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "eval_items").select(F.col("item_id").alias("ord"), "text", F.col("suite").alias("source"))


_DOCS = "d0 AS (SELECT doc_id AS id, coalesce(text, '') AS t FROM documents)"
_NORMAL = f"WITH RECURSIVE {_DOCS}, {sql.normalized('d0', 'd1')}"
_UNITS = f"{_NORMAL}, {sql.units('d1', 'd2')}"
# --- text ---

_P = PROFILE
_FUNNEL = f"""{_NORMAL}, {sql.masked("d1", "dm")}, {sql.units("dm", "du")},
e0 AS (SELECT item_id AS id, coalesce(text, '') AS t FROM eval_items), {sql.normalized("e0", "e1")}, {sql.masked("e1", "em")}, {sql.units("em", "eu")}, {sql.run_rows("eu", "er", 5, True)},
judged AS (SELECT id, t, w, {sql.reason("t", "w", _P.min_words, _P.min_alpha_ratio)} AS reason FROM dm JOIN du USING (id)),
firsts AS (SELECT min(id) AS id FROM judged WHERE reason IS NULL GROUP BY CASE WHEN len(w) > 0 THEN 'u' || array_to_string(w, ' ') ELSE 't' || lower(t) END),
fw AS (SELECT id, w FROM du JOIN firsts USING (id)), {sql.run_rows("fw", "fr", 5, True)}, fn AS (SELECT id, count(*) AS n FROM fr GROUP BY id), en AS (SELECT id, count(*) AS n FROM er GROUP BY id),
links AS (SELECT x.id AS a, y.id AS b FROM fr x JOIN fr y ON x.h = y.h AND x.id < y.id JOIN fn p ON p.id = x.id JOIN fn q ON q.id = y.id GROUP BY x.id, y.id, p.n, q.n HAVING count(*) / (p.n + q.n - count(*)) >= {_P.near_dedup_threshold}),
{sql.components("links", "roots")},
alone AS (SELECT id FROM firsts WHERE id NOT IN (SELECT id FROM roots WHERE id <> root)),
dirty AS (SELECT DISTINCT x.id AS id FROM fr x JOIN er y ON x.h = y.h JOIN fn p ON p.id = x.id JOIN en q ON q.id = y.id GROUP BY x.id, y.id, p.n, q.n HAVING count(*) / (p.n + q.n - count(*)) >= {_P.decontamination_threshold}),
kept AS (SELECT id FROM alone WHERE id NOT IN (SELECT id FROM dirty))"""
_REASONS = ("too_few_words", "low_alpha_ratio", "repetitive_text")


@query(_FUNNEL + " SELECT id AS ord, 'train-source-' || printf('%06d', id) AS prefix, t AS text, coalesce(source, '') AS source, email, phone, ipv4 FROM kept JOIN dm USING (id) JOIN documents ON doc_id = id")
def curated_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: the curated training part. The digest at the end of a doc_id is left out, as SQL has none."""
    rows = curate(corpus(spark, sf_dir), PROFILE, held_out(spark, sf_dir)).train
    return rows.select("ord", F.substring_index("doc_id", "-", 3).alias("prefix"), "text", "source", *[F.col("pii_replacements")[k].alias(k) for k in tx.PII_KEYS])


@query(
    _FUNNEL
    + f""", n AS (SELECT (SELECT count(*) FROM d0) AS raw_train_documents, (SELECT count(*) FROM e0) AS validation_documents, (SELECT count(*) FROM judged WHERE reason IS NOT NULL) AS quality_dropped, (SELECT count(*) FROM firsts) AS f, (SELECT count(*) FROM alone) AS a, (SELECT count(*) FROM kept) AS train_documents)
SELECT raw_train_documents + validation_documents AS raw_documents, raw_train_documents, quality_dropped, raw_train_documents - quality_dropped - f AS exact_duplicates_dropped, f - a AS near_duplicates_dropped, a - train_documents AS decontaminated_documents_dropped, train_documents + validation_documents AS kept_documents, train_documents, validation_documents,
{", ".join(f"(SELECT count(*) FROM judged WHERE reason = '{r}') AS {r}" for r in _REASONS)}, {", ".join(f"((SELECT sum({k}) FROM dm) + (SELECT sum({k}) FROM em))::BIGINT AS {k}" for k in tx.PII_KEYS)} FROM n"""
)
def curation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = curate(corpus(spark, sf_dir), PROFILE, held_out(spark, sf_dir)).report
    counts = ("raw_documents", "raw_train_documents", "quality_dropped", "exact_duplicates_dropped", "near_duplicates_dropped", "decontaminated_documents_dropped", "kept_documents", "train_documents", "validation_documents")
    return found.select(*counts, *[F.coalesce(F.col("quality_drop_reasons")[r], F.lit(0)).alias(r) for r in _REASONS], *[F.col("pii_replacements")[k].alias(k) for k in tx.PII_KEYS])


def quality_model(spark: SparkSession, sf_dir: str) -> QualityClassifier:
    """A model of the label 2 against the others, fitted on the labelled documents."""
    return train_classifier(labelled(spark, sf_dir), 512, 30)[0]


@query()
def ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All four variants; the last filters by a model of quality_labels."""
    return ablate(corpus(spark, sf_dir), PROFILE, held_out(spark, sf_dir), model=quality_model(spark, sf_dir))


@query(_NORMAL.replace("coalesce(text, '')", "text") + " SELECT id AS doc_id, t AS text FROM d1")
def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", tx.normalize_text(F.col("text")).alias("text"))


@query(_NORMAL.replace("coalesce(text, '')", "text") + f", {sql.masked('d1', 'dm')} SELECT id AS doc_id, t AS text, {', '.join(f'coalesce({k}, 0) AS {k}' for k in tx.PII_KEYS)} FROM dm")
def pii_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tx.with_masked(normalize_text(spark, sf_dir), "text")


@query(f"{_UNITS} SELECT id AS doc_id, {sql.reason('t', 'w', 20, 0.55)} AS reason FROM d1 JOIN d2 USING (id)")
def quality_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unit_table(spark, sf_dir).select("doc_id", drop_reason(F.col("text"), tx.unit_counts()("text"), 20, 0.55).alias("reason"))


@query(f"{_UNITS} SELECT reason, count(*) AS documents FROM (SELECT {sql.reason('t', 'w', 20, 0.55)} AS reason FROM d1 JOIN d2 USING (id)) WHERE reason IS NOT NULL GROUP BY reason")
def quality_drop_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = reports.histogram_map(quality_reason(spark, sf_dir), "reason", "quality_drop_reasons")
    return found.select(F.explode("quality_drop_reasons").alias("reason", "documents"))


@query(f"{_UNITS} SELECT min(id) AS doc_id FROM d1 JOIN d2 USING (id) GROUP BY CASE WHEN len(w) > 0 THEN 'u' || array_to_string(w, ' ') ELSE 't' || lower(t) END")
def exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(unit_table(spark, sf_dir).withColumn("profile", tx.unit_counts()("text")), "text", "profile", ["doc_id"]).select("doc_id")


_NEAR = f"""{_UNITS}, {sql.run_rows("d2", "r", 5, True)}, s AS (SELECT id, count(*) AS n, string_agg(h, chr(1) ORDER BY h) AS whole FROM r GROUP BY id),
heads AS (SELECT id, n, min(id) OVER (PARTITION BY whole) AS head FROM s),
hr AS (SELECT id, h, n FROM r JOIN heads USING (id) WHERE id = head),
links AS (SELECT x.id AS a, y.id AS b FROM hr x JOIN hr y ON x.h = y.h AND x.id < y.id GROUP BY x.id, y.id, x.n, y.n HAVING count(*) / (x.n + y.n - count(*)) >= 0.82 UNION ALL SELECT head, id FROM heads WHERE id <> head),
{sql.components("links", "roots")}"""


@query(_NEAR + " SELECT z.id AS doc_id, z.root AS root, count(*) AS links FROM roots z JOIN (SELECT a AS id FROM links UNION ALL SELECT b FROM links) e ON e.id = z.id GROUP BY z.id, z.root")
def near_duplicate_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = cut(unit_table(spark, sf_dir).select("doc_id", tx.shingle_hashes(5)("text").alias("shingles")))
    return near_duplicates(sets, "shingles", "doc_id", 0.82, 64, 16)


_BEST_SQL = f"""{_UNITS}, {sql.run_rows("d2", "r", 5, True)}, e0 AS (SELECT item_id AS id, coalesce(text, '') AS t FROM eval_items), {sql.normalized("e0", "e1")}, {sql.units("e1", "e2")}, {sql.run_rows("e2", "q", 5, True)},
rn AS (SELECT id, count(*) AS n FROM r GROUP BY id), qn AS (SELECT id, count(*) AS n FROM q GROUP BY id),
o AS (SELECT r.id AS a, q.id AS b, count(*) AS o FROM r JOIN q ON r.h = q.h GROUP BY r.id, q.id),
best AS (SELECT a AS id, max(o / (rn.n + qn.n - o)) AS best FROM o JOIN rn ON rn.id = a JOIN qn ON qn.id = b GROUP BY a)
SELECT d2.id AS doc_id, coalesce(best, CASE WHEN len(w) = 0 AND EXISTS (SELECT 1 FROM e2 WHERE len(e2.w) = 0) THEN 1.0 ELSE 0.0 END) AS best FROM d2 LEFT JOIN best USING (id)"""


@query(_BEST_SQL)
def decontaminate_max_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    shingles = tx.shingle_hashes(5)("text").alias("shingles")
    items = table(spark, sf_dir, "eval_items").select("item_id", tx.normalize_text(F.coalesce("text", F.lit(""))).alias("text")).select("item_id", shingles)
    return max_similarity(cut(unit_table(spark, sf_dir).select("doc_id", shingles)), items, "doc_id", "item_id", "shingles")


_SPACE = tx.SPACE
_PROSE_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_transform(regexp_extract_all(t, '[\\p{{L}}\\p{{Nl}}\\p{{No}}]+(?:[''’][\\p{{L}}\\p{{Nl}}\\p{{No}}]+)?'), lambda x: replace(lower(x), 'ß', 'ss')) AS w,
  length(regexp_replace(t, '[{_SPACE}]+', '', 'g')) AS vis, length(regexp_replace(t, '[^\\p{{L}}]+', '', 'g')) AS alpha, length(regexp_replace(t, '[^.!?]+', '', 'g')) AS marks FROM d),
s AS (SELECT *, len(w) AS n, CASE WHEN len(w) <= 256 THEN [1] ELSE [1, (len(w) - 256) // 2 + 1, len(w) - 255] END AS starts FROM w),
p AS (SELECT doc_id, n, strlen(t) AS b, alpha / greatest(vis, 1) AS ar, n / greatest(marks, 1) AS wps,
  list_avg(list_transform(starts, lambda a: len(list_distinct(w[a:a+255])) / greatest(len(w[a:a+255]), 1)::DOUBLE)) AS u,
  list_avg(list_transform(starts, lambda a: len(list_distinct(list_transform(range(a, least(a + 256, n + 1) - 2), lambda i: array_to_string(w[i:i+2], ' ')))) / greatest(least(256, n) - 2, 1)::DOUBLE)) AS g FROM s)
SELECT doc_id, n AS word_count, b AS utf8_bytes, round(least(1.0, n / 256.0), 8) AS length_score,
  round(least(1.0, greatest(0.0, (ar - 0.55) / 0.40)), 8) AS alphabetic_score, round(1 / (1 + abs(ln(greatest(wps, 1.0) / 25.0))), 8) AS sentence_density,
  round(u, 8) AS unique_word_ratio, round(g, 8) AS trigram_uniqueness,
  round(0.15 * least(1.0, n / 256.0) + 0.15 * least(1.0, greatest(0.0, (ar - 0.55) / 0.40)) + 0.25 / (1 + abs(ln(greatest(wps, 1.0) / 25.0))) + 0.30 * u + 0.15 * g, 8) AS score
FROM p"""


@query(_PROSE_SQL)
def prose_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = documents(spark, sf_dir).select("doc_id", *[c.alias(k) for k, c in prose_features(F.coalesce("text", F.lit("")), None).items()])
    return found.select("doc_id", "word_count", "utf8_bytes", *[F.round(c, 8).alias(c) for c in (*reports.FEATURES, "score")])


@query(
    rf"""
SELECT piece, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[{_SPACE}]+|[\p{{L}}\p{{N}}_]+|[^{_SPACE}\p{{L}}\p{{N}}_]+')) AS piece FROM documents WHERE text IS NOT NULL) GROUP BY piece"""
)
def pretoken_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.piece_counts(documents(spark, sf_dir), "text")


@query(
    rf"""
WITH c AS (SELECT piece, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[{_SPACE}]+|[\p{{L}}\p{{N}}_]+|[^{_SPACE}\p{{L}}\p{{N}}_]+')) AS piece FROM documents WHERE text IS NOT NULL) GROUP BY piece),
p AS (SELECT hex(encode(piece)) AS h, n, unnest(range(1, strlen(piece))) AS i FROM c),
q AS (SELECT ('0x' || substr(h, 2*i-1, 2))::INT AS "left", ('0x' || substr(h, 2*i+1, 2))::INT AS "right", sum(n)::BIGINT AS n FROM p GROUP BY ALL)
SELECT * FROM q ORDER BY n DESC, "left", "right" LIMIT 1"""
)
def bpe_top_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.top_pair(bpe.byte_pair_counts(bpe.piece_counts(documents(spark, sf_dir), "text")))


@query()
def bpe_vocabulary_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.vocabulary_sweep(documents(spark, sf_dir).filter(F.col("text").isNotNull()), "text", [258, 320, 384])


@query(
    rf"""
SELECT lower(regexp_replace(coalesce(source, ''), '^[{_SPACE}]+|[{_SPACE}]+$', '', 'g')) AS host, count(*) AS documents, sum(length(coalesce(text, '')))::BIGINT AS characters,
  sum(len(regexp_extract_all(coalesce(text, ''), '[^{_SPACE}]+')))::BIGINT AS words, sum(strlen(coalesce(text, '')))::BIGINT AS bytes FROM documents GROUP BY host"""
)
def corpus_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    host = F.lower(F.regexp_replace(F.coalesce("source", F.lit("")), f"^[{_SPACE}]+|[{_SPACE}]+$", ""))
    return corpus_counts(documents(spark, sf_dir).withColumn("host", host), "text", ("host",))


@query(
    rf"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents WHERE text IS NOT NULL),
b AS (SELECT *, regexp_replace(line, '[{_SPACE}]+', '', 'g') = '' AS blank FROM l),
i AS (SELECT *, sum(blank::INT) OVER (PARTITION BY doc_id ORDER BY line_no) AS island FROM b)
SELECT doc_id, island::BIGINT AS island, regexp_replace(string_agg(line, chr(10) ORDER BY line_no), '^[{_SPACE}]+|[{_SPACE}]+$', '', 'g') AS text FROM i WHERE NOT blank GROUP BY doc_id, island"""
)
def raw_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraphs(lines_of(documents(spark, sf_dir), "doc_id", "text"), ["doc_id"])


_ARTICLE_LINES = rf"""
WITH l AS (SELECT doc_id, regexp_replace(unnest(string_split(text, chr(10))), '^[{_SPACE}]+|[{_SPACE}]+$', '', 'g') AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents WHERE text IS NOT NULL),
h AS (SELECT *, regexp_matches(line, '^=\s*[^=]+\s*=$') AS head FROM l),
n AS (SELECT *, sum(head::INT) OVER (PARTITION BY doc_id ORDER BY line_no) AS article FROM h),
c AS (SELECT doc_id, article, line_no, CASE WHEN head THEN trim(regexp_extract(line, '^=\s*([^=]+?)\s*=$', 1)) WHEN line LIKE '=%=' OR line = '=' THEN regexp_replace(line, '^[= ]+|[= ]+$', '', 'g') ELSE line END AS line FROM n),
"""
_ARTIFACT = "line"
for _from, _to in ((r"\s*@-@\s*", "-"), *[x for _ in range(2) for x in [(r"([0-9])\s*@,@\s*([0-9])", r"\1,\2")]], (r"\s*@,@\s*", ", "), *[x for _ in range(2) for x in [(r"([0-9])\s*@\.@\s*([0-9])", r"\1.\2")]], (r"\s*@\.@\s*", ". ")):
    _ARTIFACT = f"regexp_replace({_ARTIFACT}, '{_from}', '{_to}', 'g')"


@query(_ARTICLE_LINES + rf"a AS (SELECT doc_id, article, line_no, regexp_replace(regexp_replace({_ARTIFACT}, '[{_SPACE}]+', ' ', 'g'), '^ +| +$', '', 'g') AS line FROM c) SELECT doc_id, article::BIGINT AS article, string_agg(line, ' ' ORDER BY line_no) AS text FROM a WHERE line <> '' GROUP BY doc_id, article")
def article_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return articles(lines_of(documents(spark, sf_dir), "doc_id", "text"), ["doc_id"])


@query(
    rf"""
SELECT doc_id, {", ".join(f"regexp_replace(regexp_replace(substr(t, {s} + 1, 380), '[{_SPACE}]+', ' ', 'g'), '^ +| +$', '', 'g') AS {n}" for n, s in (("excerpt_start", "0"), ("excerpt_middle", "greatest(0, (length(t) - 380) // 2)"), ("excerpt_end", "greatest(0, length(t) - 380)")))},
  '' AS human_label, '' AS reason FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)"""
)
def review_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review_excerpts(documents(spark, sf_dir).withColumn("text", F.coalesce("text", F.lit(""))), "doc_id", "text")


@query(
    """
SELECT doc_id, substr(t, 1, greatest(0, 400000 - before)) AS text FROM (SELECT doc_id, coalesce(text, '') AS t, coalesce(sum(length(coalesce(text, ''))) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM documents) WHERE before < 400000"""
)
def char_budget_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return budget_prefix(rows, ["doc_id"], F.length("text"), 400_000, "text")


# --- splits and samples ---

_ORDER_SQL = """
WITH f AS (SELECT doc_id, text FROM (SELECT doc_id, text, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS k FROM documents WHERE text <> '') WHERE k = 1),
n AS (SELECT count(*) AS n FROM f), o AS (SELECT doc_id, row_number() OVER (ORDER BY sha256('42' || chr(0) || text), doc_id) - 1 AS r FROM f)
SELECT doc_id, CASE WHEN r < greatest(1, round_even(n * 0.05, 0)) THEN 'test' WHEN r < 2 * greatest(1, round_even(n * 0.05, 0)) THEN 'validation' ELSE 'train' END AS split FROM o, n"""


@query(_ORDER_SQL)
def split_three_way(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.three_way(documents(spark, sf_dir).select("doc_id", "text"), "text", "doc_id").select("doc_id", "split")


_STORIES = rf"WITH d0 AS (SELECT doc_id AS id, coalesce(text, '') AS t FROM documents), {sql.compatible('d0', 'd1')}, told AS (SELECT id AS doc_id, regexp_replace(regexp_replace(t, '^[{_SPACE}]+|[{_SPACE}]+$', '', 'g'), '\n[ \t]*\n+', chr(10), 'g') AS text FROM d1), "


@query(_STORIES + _ORDER_SQL.replace("WITH", "").replace("FROM documents", "FROM told"))
def split_stories(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = documents(spark, sf_dir).select("doc_id", tx.canonical_story(F.coalesce("text", F.lit(""))).alias("text"))
    return splits.three_way(told, "text", "doc_id").select("doc_id", "split")


@query()
def split_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = table(spark, sf_dir, "prepared_docs").select("doc_id").distinct()
    return splits.hold_out(named, "doc_id", 0.1)


@query(
    """
WITH d AS (SELECT split_part(doc_id, '-', 1) AS s, text FROM prepared_docs WHERE text <> ''),
g AS (SELECT text, max((s = 'train')::INT) AS tr, max((s = 'validation')::INT) AS va, max((s = 'test')::INT) AS te FROM d GROUP BY text)
SELECT coalesce(sum(tr * te), 0)::BIGINT AS train_test, coalesce(sum(tr * va), 0)::BIGINT AS train_validation, coalesce(sum(va * te), 0)::BIGINT AS validation_test FROM g"""
)
def split_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "prepared_docs").filter(F.col("text") != "").select(F.substring_index("doc_id", "-", 1).alias("s"), "text")
    return splits.split_overlap(rows, "s", F.sha2("text", 256))


_SPANS = """WITH c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY span_id ORDER BY loaded_at DESC) AS k FROM document_spans) WHERE k = 1 AND span_start IS NOT NULL AND span_end IS NOT NULL),
s AS (SELECT span_id, cache_name, ord, doc_id, CASE WHEN isnan(score) THEN NULL ELSE score END AS score, abs(span_end - span_start)::BIGINT AS n_tokens FROM c)"""
_TIER = "CASE WHEN m <= 1.0/3 THEN 0 WHEN m <= 2.0/3 THEN 1 ELSE 2 END"
_TIERS = (
    _SPANS
    + f""", e AS (SELECT *, n_tokens - {SEQ_LEN} AS w FROM s WHERE n_tokens > {SEQ_LEN}),
t AS (SELECT *, (coalesce(sum(w) OVER (PARTITION BY cache_name ORDER BY coalesce(score, -1), span_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + w / 2) / sum(w) OVER (PARTITION BY cache_name) AS m FROM e),
tiered AS (SELECT span_id, cache_name, doc_id, score, n_tokens, w, {_TIER} AS tier FROM t UNION ALL SELECT span_id, cache_name, doc_id, score, n_tokens, 0, -1 FROM s WHERE n_tokens <= {SEQ_LEN})"""
)
_BALANCED = f""",
r AS (SELECT *, ((row_number() OVER (PARTITION BY cache_name ORDER BY n_tokens, span_id) - 1) * 4 // count(*) OVER (PARTITION BY cache_name))::INT AS length_stratum FROM e),
t2 AS (SELECT *, (coalesce(sum(w) OVER (PARTITION BY cache_name, length_stratum ORDER BY coalesce(score, -1), span_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + w / 2) / sum(w) OVER (PARTITION BY cache_name, length_stratum) AS m FROM r),
balanced AS (SELECT *, {_TIER} AS tier FROM t2)"""
_STRATA = _SPANS + f", e AS (SELECT *, n_tokens - {SEQ_LEN} AS w FROM s WHERE n_tokens > {SEQ_LEN})" + _BALANCED


def span_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.latest_spans(table(spark, sf_dir, "document_spans")).withColumn("score", F.nanvl("score", F.lit(None).cast("double")))


def tiered(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spans.quality_tiers(span_table(spark, sf_dir), "n_tokens", "score", "span_id", SEQ_LEN, ("cache_name",))
    return found.withColumn("w", spans.valid_starts(F.col("n_tokens"), SEQ_LEN))


def balanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spans.length_balanced_tiers(span_table(spark, sf_dir), "n_tokens", "score", "span_id", SEQ_LEN, 4, ("cache_name",))
    return found.withColumn("w", spans.valid_starts(F.col("n_tokens"), SEQ_LEN))


@query(_TIERS + " SELECT span_id, tier FROM tiered")
def quality_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiered(spark, sf_dir).select("span_id", "tier")


@query(_STRATA + " SELECT span_id, length_stratum, tier FROM balanced")
def quality_tiers_length_balanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balanced(spark, sf_dir).filter("w > 0").select("span_id", "length_stratum", "tier")


@query(_TIERS + " SELECT cache_name, tier, count(*) AS documents, sum(w)::BIGINT AS eligible_windows, round(avg(score), 6) AS mean_score, round(median(score), 6) AS median_score, round(avg(n_tokens), 6) AS mean_tokens, round(sum(w) / sum(sum(w)) OVER (PARTITION BY cache_name), 8) AS window_fraction FROM tiered WHERE tier >= 0 GROUP BY cache_name, tier")
def tier_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = reports.tier_statistics(tiered(spark, sf_dir), "tier", "w", "score", {"tokens": F.col("n_tokens")}, ("cache_name",))
    return found.select("cache_name", "tier", "documents", "eligible_windows", F.round("mean_score", 6).alias("mean_score"), F.round("median_score", 6).alias("median_score"), F.round("mean_tokens", 6).alias("mean_tokens"), F.round("window_fraction", 8).alias("window_fraction"))


_SHARES = ", ".join([f"round(avg((tier = {k})::INT), 8) AS tier{k}_documents" for k in range(3)] + [f"round(sum(CASE WHEN tier = {k} THEN w ELSE 0 END) / sum(w), 8) AS tier{k}_windows" for k in range(3)])


@query(_STRATA + f" SELECT length_stratum, count(*) AS documents, round(avg(n_tokens), 6) AS mean_tokens, {_SHARES} FROM balanced GROUP BY length_stratum")
def tier_length_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = reports.length_table(balanced(spark, sf_dir), "length_stratum", "tier", "n_tokens", "w")
    return found.select("length_stratum", "documents", F.round("mean_tokens", 6).alias("mean_tokens"), *[F.round(f"tier{k}_{x}", 8).alias(f"tier{k}_{x}") for x in ("documents", "windows") for k in range(3)])


@query(
    _TIERS
    + _BALANCED
    + """, p AS (SELECT span_id, 'current_tier' AS policy, tier FROM tiered UNION ALL SELECT span_id, 'candidate_tier', tier FROM balanced)
SELECT cache_name, policy, p.tier AS tier, count(*) AS documents, sum(w)::BIGINT AS valid_windows, round(sum(w) / sum(sum(w)) OVER (PARTITION BY cache_name, policy), 8) AS window_fraction, round(avg(strlen(coalesce(text, ''))), 6) AS mean_utf8_bytes, round(avg(coalesce(score, 0)), 6) AS mean_score
FROM p JOIN e USING (span_id) JOIN documents ON documents.doc_id = e.doc_id WHERE p.tier >= 0 GROUP BY cache_name, policy, p.tier"""
)
def length_balanced_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = documents(spark, sf_dir).select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).alias("utf8_bytes"))
    rows = tiered(spark, sf_dir).select(F.col("span_id").alias("ord"), "cache_name", "doc_id", "n_tokens", "score", "tier").join(sizes, "doc_id")
    found = audit.length_balanced_audit(rows, SEQ_LEN, 1, 5, by=("cache_name",))["tiers"]
    return found.select("cache_name", "policy", "tier", "documents", "valid_windows", *[F.round(c, d).alias(c) for c, d in (("window_fraction", 8), ("mean_utf8_bytes", 6), ("mean_score", 6))])


@query("WITH r AS (SELECT row_number() OVER (ORDER BY CASE WHEN isnan(quality_score) THEN -1 ELSE coalesce(quality_score, -1) END, doc_id) AS a, row_number() OVER (ORDER BY coalesce(n_chars, 0), doc_id) AS b FROM documents) SELECT round(corr(a, b), 8) AS rank_correlation FROM r")
def rank_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = reports.rank_correlation(documents(spark, sf_dir).select("doc_id", "quality_score", "n_chars"), F.coalesce(F.nanvl("quality_score", F.lit(-1.0)), F.lit(-1.0)), F.coalesce("n_chars", F.lit(0)), "doc_id")
    return found.select(F.round("rank_correlation", 8).alias("rank_correlation"))


@query(_TIERS + ", k AS (SELECT cache_name, max(CASE WHEN tier = 0 THEN score END) AS c0, max(CASE WHEN tier = 1 THEN score END) AS c1 FROM tiered GROUP BY cache_name) SELECT cache_name, count(*) FILTER (quality_score <= c0) AS low, count(*) FILTER (quality_score > c0 AND quality_score <= c1) AS medium, count(*) FILTER (quality_score > c1) AS high FROM prepared_docs, k WHERE NOT isnan(quality_score) GROUP BY cache_name")
def score_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    other = table(spark, sf_dir, "prepared_docs").filter(~F.isnan("quality_score"))
    return reports.score_bands(tiered(spark, sf_dir), other.withColumnRenamed("quality_score", "score"), "tier", "score", "cache_name")


@query(
    _TIERS
    + """, best AS (SELECT doc_id, max(tier) AS tier FROM tiered WHERE tier >= 0 GROUP BY doc_id),
l AS (SELECT doc_id, arg_max(trim(human_label)::INT, (labelled_at, trim(human_label)::INT)) AS label FROM quality_labels WHERE trim(human_label) IN ('0', '1', '2') GROUP BY doc_id)
SELECT 'tier' AS policy, t.tier AS tier, count(l.label) AS labeled, round(avg(l.label), 8) AS mean_label FROM (SELECT unnest([0, 1, 2]) AS tier) t LEFT JOIN best b ON b.tier = t.tier LEFT JOIN l ON l.doc_id = b.doc_id GROUP BY t.tier"""
)
def label_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = tiered(spark, sf_dir).filter("tier >= 0").groupBy("doc_id").agg(F.max("tier").alias("tier"))
    labels = reports.clean_labels(table(spark, sf_dir, "quality_labels"), "doc_id", "human_label", ["labelled_at"])
    return reports.label_means(spark, best, labels, "doc_id", ["tier"]).withColumn("mean_label", F.round("mean_label", 8))


@query(_SPANS + " SELECT span_id, (sum(n_tokens) OVER (PARTITION BY cache_name ORDER BY ord, span_id) - n_tokens)::BIGINT AS span_start, (sum(n_tokens) OVER (PARTITION BY cache_name ORDER BY ord, span_id))::BIGINT AS span_end FROM s")
def span_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.span_offsets(span_table(spark, sf_dir), "n_tokens", ["ord", "span_id"], ("cache_name",)).select("span_id", "span_start", "span_end")


@query(_SPANS + f", r AS (SELECT span_id, n_tokens, unnest(range(0, n_tokens, {STRIDE})) AS target_start FROM s WHERE n_tokens > 0) SELECT span_id, greatest(0, least(n_tokens, target_start + {STRIDE}) - {SEQ_LEN}) AS context_start, target_start, least(n_tokens, target_start + {STRIDE}) AS target_end FROM r")
def rolling_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.rolling_windows(span_table(spark, sf_dir), "n_tokens", SEQ_LEN, STRIDE).select("span_id", "context_start", "target_start", "target_end")


def _u(part: str) -> str:
    return f"(('0x' || substr(md5('7:{part}:' || draw), 1, 8))::BIGINT / 4294967296.0)"


@query(
    _TIERS
    + f""", x AS (SELECT span_id, tier, w, coalesce(sum(w) OVER (PARTITION BY tier ORDER BY span_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b, sum(w) OVER (PARTITION BY tier) AS total FROM tiered WHERE tier >= 0),
u AS (SELECT draw, {_u("tier")} AS u0, {_u("span")} AS u, {_u("start")} AS v FROM (SELECT unnest(range(0, 5000)) AS draw)),
z AS (SELECT *, CASE WHEN u0 < 0.2 THEN 0 WHEN u0 < 0.5 THEN 1 ELSE 2 END AS t FROM u)
SELECT draw, x.tier AS tier, span_id, floor(v * w)::BIGINT AS window_start FROM z JOIN x ON z.t = x.tier AND u >= b / total::DOUBLE AND u < (b + w) / total::DOUBLE"""
)
def sampled_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.sample_windows(tiered(spark, sf_dir).drop("w"), "span_id", "n_tokens", "tier", "span_id", 5000, SEQ_LEN, (0.2, 0.3, 0.5), 7)


@query(_SPANS + ", z AS (SELECT sum(n_tokens) AS total FROM s) SELECT draw, floor(u * (total - 256))::BIGINT AS window_start FROM (SELECT draw, " + _u("start") + " AS u FROM (SELECT unnest(range(0, 5000)) AS draw)), z")
def sampled_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = span_table(spark, sf_dir).agg(F.sum("n_tokens")).first()[0]
    return spans.stream_windows(spark, total, SEQ_LEN, 5000, 7)


@query("SELECT doc_id, source, draw FROM (SELECT doc_id, source, sha256('11' || chr(0) || doc_id) AS draw, row_number() OVER (PARTITION BY source ORDER BY sha256('11' || chr(0) || doc_id), doc_id) AS k FROM documents) WHERE k <= 3")
def sample_per_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.sample_per_group(documents(spark, sf_dir).select("doc_id", "source"), ["source"], "doc_id", 3, 11)


# --- learning ---


@query("WITH l AS (SELECT CASE WHEN trim(human_label) = '2' THEN 1 ELSE 0 END AS label FROM quality_labels WHERE trim(human_label) IN ('0', '1', '2')) SELECT label, count(*) AS examples, round(sum(count(*)) OVER () / (2.0 * count(*)), 8) AS weight FROM l GROUP BY label")
def quality_class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "quality_labels").filter(F.trim("human_label").isin("0", "1", "2")).select((F.trim("human_label") == "2").cast("int").alias("label"))
    return class_weights(labels, "label").withColumn("weight", F.round("weight", 8))


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text, label) of all labelled documents with text: the last usable label, 1 for 2 and 0 for the others."""
    labels = reports.clean_labels(table(spark, sf_dir, "quality_labels"), "doc_id", "human_label", ["labelled_at"])
    return cut(documents(spark, sf_dir).filter(F.trim("text") != "").join(labels, "doc_id").select("doc_id", "text", (F.col("label") == 2).cast("int").alias("label")))


@query()
def quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics over the held-out quarter of all labelled documents, which the model has not seen."""
    return spark.createDataFrame([train_classifier(labelled(spark, sf_dir), 512, 30)[1]], "train_examples bigint, validation_examples bigint, accuracy double, precision double, recall double")


_LOSS = rf"""WITH p AS (SELECT doc_id, unnest(regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+')) AS w FROM documents WHERE text IS NOT NULL),
c AS (SELECT w, count(*) AS n, sum(count(*)) OVER () AS total FROM p GROUP BY w),
d AS (SELECT doc_id, count(*) AS tokens, sum(-ln(n / total)) AS loss, sum(strlen(p.w)) AS bytes FROM p JOIN c USING (w) GROUP BY doc_id)"""


def unigram_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, tokens, loss, bytes) by the corpus's own unigram frequencies, the plainest pluggable scorer."""
    words = documents(spark, sf_dir).select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(rf"[{tx.WORD}]+"), 0)).alias("w"))
    counts = words.groupBy("w").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    per = words.groupBy("doc_id", "w").agg(F.count("*").alias("k"))
    scored = per.join(counts, "w").join(F.broadcast(total))
    return scored.groupBy("doc_id").agg(F.sum("k").alias("tokens"), F.sum(F.col("k") * -F.ln(F.col("n") / F.col("total"))).alias("loss"), F.sum(F.col("k") * F.octet_length("w")).alias("bytes"))


@query(_LOSS + " SELECT sum(tokens)::BIGINT AS tokens, round(sum(loss) / sum(tokens), 6) AS loss, round(exp(least(sum(loss) / sum(tokens), 20)), 3) AS perplexity, round(sum(loss) / (ln(2) * sum(bytes)), 6) AS bits_per_byte FROM d")
def corpus_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = reports.corpus_loss(unigram_losses(spark, sf_dir), "loss", "tokens", "bytes")
    return found.select("tokens", F.round("loss", 6).alias("loss"), F.round("perplexity", 3).alias("perplexity"), F.round("bits_per_byte", 6).alias("bits_per_byte"))


@query(_LOSS + ", e AS (SELECT doc_id, tokens, -loss AS a, -tokens * 8.0 AS b, greatest(-loss, -tokens * 8.0) + ln(1 + exp(-abs(-loss + tokens * 8.0))) - ln(2) AS m FROM d) SELECT count(*) AS documents, round(-sum(a) / sum(tokens), 6) AS a_loss, round(-sum(b) / sum(tokens), 6) AS b_loss, round(-sum(m) / sum(tokens), 6) AS mixed_loss, round(least(-sum(a) / sum(tokens), -sum(b) / sum(tokens)), 6) AS best_single_loss, count(*) FILTER (m > greatest(a, b)) AS improved_documents FROM e")
def ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = unigram_losses(spark, sf_dir).select("doc_id", "tokens", (-F.col("loss")).alias("a"), (F.col("tokens") * -8.0).alias("b"))
    found = reports.ensemble_summary(rows.withColumn("mixed", reports.mixture(F.col("a"), F.col("b"))), "doc_id", ["a", "b"], "tokens")
    return found.select("documents", *[F.round(c, 6).alias(c) for c in ("a_loss", "b_loss", "mixed_loss", "best_single_loss")], "improved_documents")


def token_table(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[tuple[int, int]]]:
    """(doc_id, split, text, tokens) of the latest row with text of each id, and the merges of the train split."""
    rows = table(spark, sf_dir, "prepared_docs").filter(F.trim("text") != "").groupBy("doc_id").agg(F.max(F.struct("loaded_at", "text")).alias("last"))
    rows = rows.select("doc_id", F.substring_index("doc_id", "-", 1).alias("split"), F.col("last.text").alias("text"))
    merges = bpe.train(rows.filter("split = 'train'"), "text", 320)
    return cut(bpe.encode(rows, "text", merges, "tokens", add_eos=True)), merges


@query()
def held_out_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for the validation and one for the test split."""
    rows, merges = token_table(spark, sf_dir)
    model = likelihood.fit_ngrams(rows.filter("split = 'train'"), "tokens", 258 + len(merges))
    return likelihood.evaluate(rows.filter("split in ('validation', 'test')"), "doc_id", "text", "tokens", model, SEQ_LEN, STRIDE, by=("split",))


@query()
def held_out_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, merges = token_table(spark, sf_dir)
    model = likelihood.fit_ngrams(rows.filter("split = 'train'"), "tokens", 258 + len(merges))
    flat = likelihood.NgramScorer(model.uni, {}, model.size)
    return likelihood.evaluate_ensemble(rows.filter("split in ('validation', 'test')"), "doc_id", "tokens", {"bigram": model, "unigram": flat}, SEQ_LEN, STRIDE, by=("split",))


_FALL = "{low} + 0.5 * ({rate} - {low}) * (1 + cos(pi() * least(1.0, greatest(0.0, {p}))))"


@query(
    f"""
SELECT step, round(CASE WHEN step < 50 THEN 0.001 * (step + 1) / 50 ELSE {_FALL.format(low=0.0001, rate=0.001, p="(step - 50) / 949.0")} END, 12) AS cosine,
  round(CASE WHEN step < 50 THEN 0.001 * (step + 1) / 50 WHEN step < 800 THEN 0.001 ELSE {_FALL.format(low=0.0001, rate=0.001, p="(step - 800) / 199.0")} END, 12) AS wsd FROM (SELECT unnest(range(0, 1000)) AS step)"""
)
def lr_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    step = F.col("id")
    return spark.range(1000).select(step.alias("step"), F.round(reports.cosine_rate(step, 1000, 0.001, 50, 0.1), 12).alias("cosine"), F.round(reports.wsd_rate(step, 1000, 0.001, 50, 200, 0.1), 12).alias("wsd"))


# --- reports ---

_RUNS = "WITH r AS (SELECT DISTINCT run_id, config_name, raw_documents, kept_documents, kept_documents / raw_documents - 1.0 AS change, train_documents, validation_documents, test_documents FROM pipeline_reports WHERE raw_documents > 0 AND kept_documents IS NOT NULL)"


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pipeline_reports").filter("raw_documents > 0 and kept_documents is not null")
    return rows.select("run_id", "config_name", "raw_documents", "kept_documents", (F.col("kept_documents") / F.col("raw_documents") - 1.0).alias("change"), "train_documents", "validation_documents", "test_documents").distinct()


@query(_RUNS + " SELECT config_name, count(change) AS runs, round(avg(change), 8) AS mean_change, round(median(change), 8) AS median_change, round(stddev_samp(change), 8) AS sample_std_change, round(min(change), 8) AS min_change, round(max(change), 8) AS max_change, count(*) FILTER (change < 0) AS improved_runs FROM r GROUP BY config_name")
def seed_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = reports.seed_summary(runs(spark, sf_dir), "change", ("config_name",))
    return found.select("config_name", "runs", *[F.round(f"{c}_change", 8).alias(f"{c}_change") for c in ("mean", "median", "sample_std", "min", "max")], "improved_runs")


@query(_RUNS + " SELECT count(*) AS runs, count(*) FILTER (train_documents + validation_documents + test_documents = kept_documents) AS consistent, sum(raw_documents)::BIGINT AS raw_documents, sum(kept_documents)::BIGINT AS kept_documents FROM r")
def funnel_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs(spark, sf_dir).agg(F.count("*").alias("runs"), F.count_if(F.col("train_documents") + F.col("validation_documents") + F.col("test_documents") == F.col("kept_documents")).alias("consistent"), F.sum("raw_documents").alias("raw_documents"), F.sum("kept_documents").alias("kept_documents"))


@query("WITH e AS (SELECT unnest(map_entries(pii_replacements)) AS x FROM prepared_docs) SELECT x.key AS kind, sum(x.value)::BIGINT AS replacements, count(*) AS documents FROM e GROUP BY x.key")
def pii_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "prepared_docs").select(F.explode("pii_replacements").alias("kind", "n"))
    return rows.groupBy("kind").agg(F.sum("n").alias("replacements"), F.count("*").alias("documents"))


@query("SELECT source, count(*) AS manifests, count(*) FILTER (abs(fractions.train + fractions.validation + fractions.test - 1) <= 1e-9) AS valid_fractions, sum(exact_cross_split_overlap.train_test)::BIGINT AS claimed_train_test FROM split_manifests GROUP BY source")
def manifest_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = F.col("fractions")
    whole = F.abs(f["train"] + f["validation"] + f["test"] - 1) <= 1e-9
    return table(spark, sf_dir, "split_manifests").groupBy("source").agg(F.count("*").alias("manifests"), F.count_if(whole).alias("valid_fractions"), F.sum("exact_cross_split_overlap.train_test").alias("claimed_train_test"))


_BEST = "WITH r AS (SELECT p_size::DOUBLE * 1e6 AS c, p_retailprice AS p, round(abs(p_retailprice - 900 - 20 * p_size), 2) + 1 AS l FROM part), b AS (SELECT c, min((l, p)) AS m FROM r GROUP BY c), f AS (SELECT c, m[2] AS p, m[1] AS l FROM (SELECT c, [min(l), arg_min(p, (l, p))] AS m FROM r GROUP BY c))"


def scaling_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    loss = F.round(F.abs(F.col("p_retailprice") - 900 - 20 * F.col("p_size")), 2) + 1
    return table(spark, sf_dir, "part").select((F.col("p_size").cast("double") * 1e6).alias("compute_budget"), F.col("p_retailprice").alias("parameters"), loss.alias("final_loss"))


@query(_BEST.replace("b AS (SELECT c, min((l, p)) AS m FROM r GROUP BY c), ", "") + " SELECT c AS compute_budget, p AS parameters, l AS final_loss, round(c / (6 * p), 6) AS tokens FROM f")
def scaling_best_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.best_runs(scaling_runs(spark, sf_dir)).withColumn("tokens", F.round("tokens", 6))


@query(
    _BEST.replace("b AS (SELECT c, min((l, p)) AS m FROM r GROUP BY c), ", "")
    + """, g AS (SELECT ln(c) AS x, ln(p) AS y, ln(c / (6 * p)) AS z FROM f), s AS (SELECT regr_slope(y, x) AS ps, regr_intercept(y, x) AS pi, regr_slope(z, x) AS ts, regr_intercept(z, x) AS ti FROM g)
SELECT round(exp(any_value(pi)), 4) AS parameter_coefficient, round(any_value(ps), 6) AS parameter_exponent, round(sqrt(avg(pow(y - pi - ps * x, 2))), 6) AS parameter_log_rmse, round(any_value(ts), 6) AS token_exponent, round(sqrt(avg(pow(z - ti - ts * x, 2))), 6) AS token_log_rmse FROM g, s"""
)
def scaling_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = reports.scaling_fit(scaling_runs(spark, sf_dir))
    return found.select(F.round("parameter_coefficient", 4).alias("parameter_coefficient"), *[F.round(c, 6).alias(c) for c in ("parameter_exponent", "parameter_log_rmse", "token_exponent", "token_log_rmse")])


@query("SELECT event_type, count(value) AS n, round(median(value), 8) AS median, round(quantile_disc(value, 0.95), 8) AS p95 FROM events GROUP BY event_type")
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = reports.latency(table(spark, sf_dir, "events"), "value", ("event_type",))
    return found.select("event_type", "n", F.round("median", 8).alias("median"), F.round("p95", 8).alias("p95"))


@query("SELECT user_id, 'Be brief.' || chr(10) || chr(10) || string_agg('User: ' || event_type || chr(10) || 'Assistant: ' || props, chr(10) || chr(10) ORDER BY ts, event_id) AS prompt FROM events GROUP BY user_id")
def chat_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", F.col("event_type").alias("user"), F.col("props").alias("assistant")))), lambda t: F.struct(t["user"].alias("user"), t["assistant"].alias("assistant")))
    return table(spark, sf_dir, "events").groupBy("user_id").agg(turns.alias("turns")).select("user_id", tx.chat_prompt("Be brief.", F.col("turns")).alias("prompt"))


_HASHED = """WITH h AS (SELECT sha256('{"doc_id":' || doc_id || ',"text":' || coalesce(to_json(text)::VARCHAR, 'null') || '}') AS h FROM documents)
SELECT count(*) AS rows, sha256(""" + " || ':' || ".join(f"sum(('0x' || substr(h, {1 + 8 * i}, 8))::BIGINT)::VARCHAR" for i in range(8)) + ") AS content FROM h"


@query(_HASHED)
def corpus_content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content_hash(documents(spark, sf_dir).select("doc_id", "text"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_FOUND)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


