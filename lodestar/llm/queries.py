"""The registered queries of this subpackage and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm import (
    bpe,
    fingerprint,
    html_text,
    line_dedup,
    packing,
    pii,
    quality,
    resampling,
    sharding,
    simhash,
    spellings,
    substring,
    suffix_arrays,
)

Query = Callable[[SparkSession, str], DataFrame]

SHARDS = 24


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return _table(spark, folder, "documents")


def op1_imatch(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    return fingerprint.fingerprint_report(docs, fingerprint.build_lexicon(docs))


def op2_bounded_ring(spark: SparkSession, folder: str) -> DataFrame:
    rows = documents(spark, folder).select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("bigint").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
    )
    placed = sharding.assign_shards(rows, "doc_id", SHARDS, tie_break=[F.col("text_crc32"), F.col("size")])
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op3_pii_tagger(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    return pii.pii_report(docs, pii.fit(docs))


def op4_html_layout(spark: SparkSession, folder: str) -> DataFrame:
    pages = html_text.page_text(_table(spark, folder, "pages"))
    return pages.select("page_id", "url", "page_text")


def op5_line_crf(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    return quality.quality_report(docs, quality.train_line_model(docs, _table(spark, folder, "labels")))


def op6_cost_packing(spark: SparkSession, folder: str) -> DataFrame:
    ranks, special = (public_tokenizers.path(f"byte_bpe_50k.{kind}") for kind in ("tiktoken", "json"))
    return packing.pack_documents(documents(spark, folder), ranks, special=special)


def op7_simhash_trie(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, folder))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_repeated_windows(spark: SparkSession, folder: str) -> DataFrame:
    return substring.substring_report(documents(spark, folder))


def op9_site_lines(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder).select("doc_id", "source", "text")
    kept = line_dedup.drop_boilerplate(docs, dropped="n_dropped", total="n_lines")
    return kept.select("doc_id", "source", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP9_SQL = rf"""
WITH pages AS (SELECT row_number() OVER () AS page, * FROM documents),
lines AS (
  SELECT page, doc_id, source, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) AS place
  FROM pages WHERE text IS NOT NULL
),
hosts AS (SELECT source, count(*) AS host_pages FROM pages GROUP BY source),
bad AS (
  SELECT l.source, l.line
  FROM lines l JOIN hosts h ON l.source IS NOT DISTINCT FROM h.source
  WHERE regexp_matches(l.line, '[^\x00-\x20]')
  GROUP BY l.source, l.line, h.host_pages
  HAVING count(DISTINCT page) >= {line_dedup.MIN_PAGES}
     AND count(DISTINCT page) > {line_dedup.BOILERPLATE_RATIO}::DOUBLE * h.host_pages
),
marked AS (
  SELECT l.*, b.line IS NOT NULL AS dropped
  FROM lines l LEFT JOIN bad b ON l.source IS NOT DISTINCT FROM b.source AND l.line = b.line
),
kept AS (
  SELECT page, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
         coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT dropped), '') AS text
  FROM marked GROUP BY page
)
SELECT p.doc_id, p.source, coalesce(k.n_lines, 0) AS n_lines, coalesce(k.n_dropped, 0) AS n_dropped,
       sha256(k.text) AS kept_sha256
FROM pages p LEFT JOIN kept k USING (page)
"""


def op10_duckdb_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.bpe_report(documents(spark, folder), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def op11_suffix_arrays(spark: SparkSession, folder: str) -> DataFrame:
    found = suffix_arrays.contamination(documents(spark, folder), _table(spark, folder, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda total, s: total + s["end"] - s["first"])
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


# Words of op11 and op12: A-Z lower-cased, runs of letters, digits and characters beyond ASCII.
_SQL_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SQL_WORDS = rf"regexp_extract_all({_SQL_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
# The word at a place and the next ones, as far as they exist, for every window length.
_SQL_RUNS = ", ".join(
    f"word || {' || '.join(f'{chr(39)} {chr(39)} || lead(word, {k}) OVER w' for k in range(1, n))} AS run_{n}"
    for n in range(2, suffix_arrays.WINDOW + 1)
)
_SQL_ALL_RUNS = " UNION ALL ".join(
    f"SELECT row, place, {n} AS n, run_{n} AS run FROM doc_runs WHERE run_{n} IS NOT NULL AND {n} IN (SELECT n FROM windows)"
    for n in range(1, suffix_arrays.WINDOW + 1)
)

OP11_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS row, doc_id, {_SQL_WORDS} AS words FROM documents),
items AS (SELECT coalesce(item_id::VARCHAR, 'null') AS item, {_SQL_WORDS} AS words FROM benchmark),
sized AS (SELECT item, words, least(len(words), {suffix_arrays.WINDOW}) AS n FROM items WHERE len(words) > 0),
starts AS (SELECT item, words, n, unnest(range(1, len(words) - n + 2)) AS spot FROM sized),
windows AS (SELECT DISTINCT item, n, array_to_string(list_slice(words, spot, spot + n - 1), ' ') AS run FROM starts),
doc_words AS (
  SELECT row, unnest(words) AS word, generate_subscripts(words, 1) AS place FROM docs
),
doc_runs AS (
  SELECT row, place, word AS run_1, {_SQL_RUNS} FROM doc_words WINDOW w AS (PARTITION BY row ORDER BY place)
),
runs AS ({_SQL_ALL_RUNS}),
hits AS (SELECT r.row, r.place, w.n, w.item FROM runs r JOIN windows w ON r.n = w.n AND r.run = w.run),
covered AS (
  SELECT row, count(DISTINCT word_place) AS n_hit
  FROM (SELECT row, unnest(range(place, place + n)) AS word_place FROM (SELECT DISTINCT row, place, n FROM hits))
  GROUP BY row
),
named AS (
  SELECT row, count(*) AS n_items, string_agg(item, ',' ORDER BY item COLLATE "C") AS items
  FROM (SELECT DISTINCT row, item FROM hits) GROUP BY row
)
SELECT d.doc_id, len(d.words)::BIGINT AS n_words, coalesce(c.n_hit, 0)::BIGINT AS n_hit,
       coalesce(m.n_items, 0)::BIGINT AS n_items, sha256(coalesce(m.items, '')) AS items_sha256,
       c.n_hit IS NOT NULL AS contaminated
FROM docs d LEFT JOIN covered c USING (row) LEFT JOIN named m USING (row)
"""


def op12_importance_draw(spark: SparkSession, folder: str) -> DataFrame:
    report = resampling.resampling_report(documents(spark, folder), _table(spark, folder, "benchmark"))
    return report.select("doc_id", "n_features", "weight", "score", "rank")


# CRC-32 of a text column: the table of 256 entries by its rule, then one step per byte of the UTF-8 text.
_SQL_CRC_TABLE = """
SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
  lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS crc_table
"""


def _sql_crc(text: str) -> str:
    data = f"hex(encode({text}))"
    return f"""xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(
      range(length({data}) // 2), lambda i: ('0x' || substr({data}, (2 * i + 1)::BIGINT, 2))::BIGINT)),
      lambda c, b: xor(c // 256, crc_table[xor(c % 256, b) + 1])))"""


OP12_SQL = f"""
WITH crc AS ({_SQL_CRC_TABLE}),
docs AS (SELECT row_number() OVER () AS row, doc_id, {_SQL_WORDS} AS words FROM documents),
doc_words AS (SELECT row, unnest(words) AS word FROM docs),
target_words AS (SELECT unnest({_SQL_WORDS}) AS word FROM benchmark),
buckets AS (
  SELECT word, {_sql_crc("word")} % {resampling.BUCKETS} AS bucket
  FROM (SELECT word FROM doc_words UNION SELECT word FROM target_words), crc
),
s AS (SELECT bucket, count(*) AS n FROM doc_words JOIN buckets USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM target_words JOIN buckets USING (word) GROUP BY bucket),
sums AS (SELECT (SELECT coalesce(sum(n), 0) FROM s)::DOUBLE AS s, (SELECT coalesce(sum(n), 0) FROM t)::DOUBLE AS t),
gains AS (
  SELECT s.bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * (sums.s + {resampling.BUCKETS})
    / ((s.n + 1)::DOUBLE * (sums.t + {resampling.BUCKETS}))))::BIGINT AS gain
  FROM s LEFT JOIN t USING (bucket), sums
),
weights AS (
  SELECT row, count(*) AS n, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight
  FROM doc_words JOIN buckets USING (word) JOIN gains USING (bucket) GROUP BY row
),
noise AS (
  SELECT row, ('0x' || substr(sha256('{resampling.SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h FROM docs
),
scored AS (
  SELECT doc_id, coalesce(n, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
         (coalesce(weight, 0) + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))))::BIGINT AS score
  FROM docs JOIN noise USING (row) LEFT JOIN weights USING (row)
),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY n_features >= {resampling.LEAST_WORDS} ORDER BY score DESC, doc_id NULLS LAST) AS place,
         count(*) FILTER (n_features >= {resampling.LEAST_WORDS}) OVER () AS n
  FROM scored
)
SELECT doc_id, n_features, weight, score,
       CASE WHEN n_features >= {resampling.LEAST_WORDS} AND place <= {resampling.PERCENT} * n // 100 THEN place END AS rank
FROM ranked
"""


def op13_pivotal_grams(spark: SparkSession, folder: str) -> DataFrame:
    report = spellings.spelling_report(documents(spark, folder))
    return report.select("word", "form", "root", "n", "n_near", "form_n")


# Near words by what is left when one code point is taken out: of one of them (an insertion), or of both at one place.
OP13_SQL = rf"""
WITH RECURSIVE crc AS ({_SQL_CRC_TABLE}),
runs AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS name,
         unnest(regexp_extract_all({_SQL_LOWER}, '[a-z\x{{00C0}}-\x{{00FF}}]+')) AS run
  FROM documents
),
counted AS (SELECT name, run, count(*) AS n FROM runs GROUP BY name, run),
hashed AS (SELECT run, n, {_sql_crc("name || ':' || run")} AS h FROM counted, crc),
edited AS (
  SELECT n, CASE WHEN h % {spellings.DELETE_EVERY} = 0
    THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word
  FROM hashed
),
words AS (
  SELECT word, sum(n)::BIGINT AS n FROM edited WHERE length(word) >= {spellings.LEAST_LENGTH}
  GROUP BY word HAVING sum(n) >= {spellings.LEAST_COUNT}
),
places AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS spot FROM words),
rests AS (SELECT word, n, spot, substr(word, 1, spot - 1) || substr(word, spot + 1) AS rest FROM places),
pairs AS (
  SELECT DISTINCT r.word AS a, r.n AS n_a, w.word AS b, w.n AS n_b FROM rests r JOIN words w ON r.rest = w.word
  UNION
  SELECT DISTINCT w.word, w.n, r.word, r.n FROM rests r JOIN words w ON r.rest = w.word
  UNION
  SELECT x.word, x.n, y.word, y.n FROM rests x JOIN rests y ON x.rest = y.rest AND x.spot = y.spot AND x.word <> y.word
),
near AS (
  SELECT a AS word, count(*) AS n_near, max(n_b) AS top_n, arg_min(b, (-n_b, encode(b))) AS top FROM pairs GROUP BY a
),
report AS (
  SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near,
         CASE WHEN top_n >= {spellings.RATIO} * w.n THEN top END AS form,
         CASE WHEN top_n >= {spellings.RATIO} * w.n THEN top_n END AS form_n
  FROM words w LEFT JOIN near USING (word)
),
chain AS (
  SELECT word, word AS root, 0 AS step FROM report
  UNION ALL
  SELECT c.word, r.form, c.step + 1 FROM chain c JOIN report r ON c.root = r.word WHERE r.form IS NOT NULL
),
roots AS (SELECT word, arg_max(root, step) AS root FROM chain GROUP BY word)
SELECT word, form, root, n, n_near, form_n FROM report JOIN roots USING (word)
"""


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_imatch,
        op2_bounded_ring,
        op3_pii_tagger,
        op4_html_layout,
        op5_line_crf,
        op6_cost_packing,
        op7_simhash_trie,
        op8_repeated_windows,
        op9_site_lines,
        op10_duckdb_bpe,
        op11_suffix_arrays,
        op12_importance_draw,
        op13_pivotal_grams,
    )
}

ORACLES: dict[str, str] = {
    "op9_site_lines": OP9_SQL,
    "op11_suffix_arrays": OP11_SQL,
    "op12_importance_draw": OP12_SQL,
    "op13_pivotal_grams": OP13_SQL,
}
