"""The queries of the ten operators and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doseweave.llm import (
    decontamination, html_extraction, language, licences, minhash, mixing, phrase_mining, quality, ranked_search, secrets, suffix_dedup, token_files,
    toxicity,
)
from doseweave.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return register


MIX_SQL = r"""
WITH RECURSIVE texts AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '') || '|' || coalesce(text, '')) AS prio
  FROM documents
), sized AS (
  SELECT doc_id, source, size, prio || lpad((row_number() OVER (PARTITION BY source, prio))::VARCHAR, 15, '0') AS place FROM texts
), sizes AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS turn
  FROM sized GROUP BY source
), weighted AS (
  SELECT *, CASE (turn - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, 2 * source_size AS stop FROM sizes
), levels AS (
  SELECT *, ((sum(source_size) OVER ())::DOUBLE * 1.5
             - coalesce(sum(stop) OVER before, 0)::DOUBLE)
            / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0))::DOUBLE AS level
  FROM weighted
  WINDOW before AS (ORDER BY stop / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), targets AS (
  SELECT source, source_size,
         least(stop::DOUBLE, max(level) OVER () * weight) AS target
  FROM levels
), queue AS (
  SELECT s.source, s.place, s.size, t.target, r.round,
         r.round * t.source_size + sum(s.size) OVER (PARTITION BY s.source, r.round ORDER BY s.place) AS words
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source, (VALUES (0), (1)) r(round)
), early AS (
  SELECT source, place, size, round FROM queue WHERE target > 0 AND words::DOUBLE / target <= 1
), late AS (
  SELECT *, (words - size::DOUBLE / 2) / target AS half FROM queue
  WHERE target > 0 AND words::DOUBLE / target > 1 AND (words - size::DOUBLE / 2) / target <= 1
), line AS (
  SELECT *, row_number() OVER (ORDER BY half, source NULLS LAST, round, place) AS i FROM late
), walk AS (
  SELECT 0::BIGINT AS i, ((SELECT floor(sum(size) * 1.5) FROM sized) - (SELECT coalesce(sum(size), 0) FROM early))::BIGINT AS room,
         false AS fits, NULL::VARCHAR AS source, 0 AS round, '' AS place
  UNION ALL
  SELECT l.i, CASE WHEN l.size <= w.room THEN w.room - l.size ELSE w.room END, l.size <= w.room, l.source, l.round, l.place
  FROM walk w JOIN line l ON l.i = w.i + 1
), picked AS (
  SELECT source, round, max(place) AS cut FROM (
    SELECT source, round, place FROM early UNION ALL SELECT source, round, place FROM walk WHERE fits
  ) GROUP BY source, round
)
SELECT s.doc_id, s.size, t.source_size, t.target,
       (s.size * (SELECT count(*) FROM picked p WHERE p.source IS NOT DISTINCT FROM s.source AND s.place <= p.cut))::BIGINT AS taken
FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
"""


@query(MIX_SQL)
def op10_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix_sizes(table(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", "taken")


DECONTAMINATION_SQL = r"""
WITH bw AS (
  SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), wins AS (
  SELECT DISTINCT item, list_slice(w, i, i + least(13, len(w)) - 1) AS win
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS i FROM bw WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT len(win) AS n FROM wins
), dw AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents
), places AS (
  SELECT doc_id, i, n, list_slice(w, i, i + n - 1) AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, sizes WHERE len(w) >= n)
), hits AS (SELECT p.doc_id, p.i, p.n, x.item FROM places p JOIN wins x ON p.win = x.win
), words AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS at FROM hits) GROUP BY doc_id
), items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM dw d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""


@query(DECONTAMINATION_SQL)
def op5_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    hits = decontamination.benchmark_hits(table(spark, folder, "documents"), table(spark, folder, "benchmark"), ["doc_id"])
    return hits.select(
        "doc_id", "n_words", "n_hit", F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "hit_items"), 256).alias("items_sha256"), decontamination.is_contaminated().alias("contaminated"),
    )


def token_file_rows(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Writes ``docs`` as token files and reads them back."""
    import public_tokenizers

    folder = token_files.scratch_folder(spark)
    token_files.write_token_files(docs, folder, public_tokenizers.path("word_bpe_49k.json"))
    return token_files.read_token_files(spark, folder)


@query()
def op8_token_files(spark: SparkSession, folder: str) -> DataFrame:
    return token_file_rows(spark, table(spark, folder, "documents"))


@query()
def op4_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = language.fit(docs.filter(~language.held_out()))
    named = language.identified(docs, model, keep=["doc_id"])
    return named.select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score", "lang_rejected")


NEAR_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w
  FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, list_slice(w, i, i + least(4, len(w)) - 1) AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 0) + 2)) AS i FROM words WHERE len(w) > 0)
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id
  JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))
), reach AS (
  SELECT doc_id, doc_id AS root FROM documents
  UNION SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.doc_id WHERE r.root < l.b
), low AS (SELECT doc_id, min(root) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN low USING (doc_id) LEFT JOIN sizes USING (doc_id)
"""


@query(NEAR_SQL)
def op9_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, folder, "documents"))


@query()
def op6_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality.judged(table(spark, folder, "documents"), keep=["doc_id"])


@query()
def op1_licence_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licences.scanned(table(spark, folder, "documents"), keep=["doc_id"])


SECRET_SQL = r"""
WITH kinds(number, kind, pattern) AS (VALUES
  (0, 'assign', '(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+'),
  (1, 'access', 'AKIA[A-Z0-9]+'), (2, 'hex', '[0-9a-f]+'), (3, 'run', '[A-Za-z0-9+/_=-]{20,}')
), hits AS (
  SELECT doc_id, text, number, kind, unnest(m) AS hit, generate_subscripts(m, 1) AS k, g
  FROM (SELECT doc_id, text, number, kind,
               CASE number WHEN 0 THEN regexp_extract_all(text, '(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+')
                           WHEN 1 THEN regexp_extract_all(text, 'AKIA[A-Z0-9]+') WHEN 2 THEN regexp_extract_all(text, '[0-9a-f]+')
                           ELSE regexp_extract_all(text, '[A-Za-z0-9+/_=-]{20,}') END AS m,
               CASE number WHEN 0 THEN string_split_regex(text, '(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+')
                           WHEN 1 THEN string_split_regex(text, 'AKIA[A-Z0-9]+') WHEN 2 THEN string_split_regex(text, '[0-9a-f]+')
                           ELSE string_split_regex(text, '[A-Za-z0-9+/_=-]{20,}') END AS g
        FROM documents, kinds)
), placed AS (
  SELECT doc_id, number, kind, hit,
         sum(length(g[k]) + length(hit)) OVER (PARTITION BY doc_id, number ORDER BY k) - length(hit) AS s
  FROM hits
), base AS (
  SELECT doc_id, number, kind, s, s + length(hit) AS e FROM placed
  WHERE (number = 0 AND length(regexp_extract(hit, '["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)$', 1)) >= 6)
     OR (number = 1 AND length(hit) >= 20) OR (number = 2 AND length(hit) >= 24)
), runs AS (
  SELECT doc_id, hit, s, CASE
    WHEN regexp_matches(hit, '[0-9]') AND regexp_matches(hit, '[a-fA-F]') AND regexp_full_match(hit, '[0-9a-fA-F]+') THEN 3
    WHEN regexp_matches(hit, '[0-9]') AND regexp_matches(hit, '[A-Za-z]') AND regexp_full_match(hit, '[A-Za-z0-9]+') THEN 4
    WHEN regexp_matches(hit, '[0-9]') AND regexp_matches(hit, '[a-z]') AND regexp_matches(hit, '[A-Z]') THEN 5 END AS number
  FROM placed
  WHERE number = 3 AND NOT regexp_matches(hit, '^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$|^[0-9-]+$|(?i:example|sample|placeholder|changeme|dummy|xxxx)')
    AND NOT (hit LIKE '%/%/%' AND coalesce(list_sum(list_transform(list_filter(string_split(hit, '/'), lambda x: regexp_full_match(x,
      '([A-Z]*|[A-Z]?[a-z]+([A-Z][a-z]+)*[0-9]*|[A-Za-z]{0,4}[0-9]+)([_=+-]([A-Z]*|[A-Z]?[a-z]+([A-Z][a-z]+)*[0-9]*|[A-Za-z]{0,4}[0-9]+))*')), lambda x: length(x))), 0)
      >= 0.8 * (length(hit) - len(string_split(hit, '/')) + 1))
), windows AS (
  SELECT doc_id, s, number, i, list_entropy(string_split(substr(hit, i + 1, 20), '')) AS h
  FROM (SELECT *, unnest(range(0, length(hit) - 19)) AS i FROM runs WHERE number IS NOT NULL)
), added AS (
  SELECT doc_id, number, CASE number WHEN 3 THEN 'entropy_hex' WHEN 4 THEN 'entropy_alnum' ELSE 'entropy_base64' END AS kind,
         s + min(i) AS s, s + max(i) + 20 AS e
  FROM windows WHERE h >= CASE number WHEN 3 THEN 3.05 WHEN 4 THEN 3.65 ELSE 3.85 END GROUP BY doc_id, number, windows.s
), every AS (SELECT *, true AS is_base FROM base UNION ALL SELECT doc_id, number, kind, s, e, false FROM added
), joined AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS a, count(*) FILTER (kind = 'access') AS b, count(*) FILTER (kind = 'hex') AS c,
         string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, number) FILTER (is_base) AS base_text,
         string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, number) AS all_text
  FROM every GROUP BY doc_id
)
SELECT d.doc_id, coalesce(a, 0)::BIGINT AS n_assign, coalesce(b, 0)::BIGINT AS n_access, coalesce(c, 0)::BIGINT AS n_hex,
       sha256(coalesce(base_text, '')) AS base_sha256, coalesce(all_text, '') AS spans
FROM documents d LEFT JOIN joined USING (doc_id)
"""


@query(SECRET_SQL)
def op7_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = secrets.found_secrets(table(spark, folder, "documents").select("doc_id", "text"))
    counts = [secrets.span_count(F.col("base_spans"), kind).alias(f"n_{kind}") for kind in ("assign", "access", "hex")]
    return found.select("doc_id", *counts, F.sha2(secrets.span_text(F.col("base_spans")), 256).alias("base_sha256"), secrets.span_text(F.col("spans")).alias("spans"))


@query()
def op3_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    clean = suffix_dedup.deduplicated_bytes(table(spark, folder, "documents"))
    return clean.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query()
def op2_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return html_extraction.extracted(table(spark, folder, "pages"), keep=["page_id", "url"])


COLLOCATION_SQL = r"""
WITH pieces AS (
  SELECT row_number() OVER () AS p, lang, piece FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents WHERE text IS NOT NULL)
), split AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM split GROUP BY lang
), grams AS (
  SELECT lang, size, array_to_string(list_slice(w, i, i + size - 1), ' ') AS phrase
  FROM (SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM split, (VALUES (1), (2), (3), (4)) s(size) WHERE len(w) >= size)
), f AS MATERIALIZED (SELECT lang, size, phrase, count(*)::BIGINT AS a FROM grams GROUP BY ALL HAVING count(*) >= 30
), cand AS (SELECT lang, size, phrase, a, string_split(phrase, ' ') AS w FROM f WHERE size > 1
), cuts AS (
  SELECT c.lang, c.size, c.phrase, c.a, k, x.a AS l, y.a AS r, ((2000000::HUGEINT * c.a) // (x.a + y.a))::BIGINT AS score
  FROM (SELECT *, unnest(range(1, size)) AS k FROM cand) c
  JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(list_slice(c.w, 1, k), ' ')
  JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(list_slice(c.w, k + 1, c.size), ' ')
), best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), inside AS (
  SELECT lang, array_to_string(list_slice(w, i, i + s - 1), ' ') AS phrase, max(a) AS above
  FROM (SELECT lang, w, a, s, unnest(range(1, size - s + 2)) AS i FROM cand, (VALUES (2), (3)) q(s) WHERE s < size) GROUP BY 1, 2
)
SELECT lang, rank, phrase, a, l, r, n, score FROM (
  SELECT b.*, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase)::BIGINT AS rank
  FROM best b LEFT JOIN inside i USING (lang, phrase) WHERE above IS NULL OR 100 * above < 80 * a
) JOIN totals USING (lang) WHERE rank <= 2000
"""


@query(COLLOCATION_SQL)
def op12_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return phrase_mining.collocations(table(spark, folder, "documents"))


SEARCH_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), []) AS w
  FROM documents
), q AS (
  SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t
  FROM benchmark
), whole AS (SELECT count(*) FILTER (len(w) > 0) AS docs, sum(len(w))::BIGINT AS terms FROM d
), m AS (SELECT doc_id, (25 + (75 * len(w) * docs) // terms)::BIGINT AS m FROM d, whole WHERE terms > 0
), tf AS (SELECT doc_id, t, count(*)::BIGINT AS tf FROM (SELECT doc_id, unnest(w) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY ALL
), weight AS (SELECT t, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)))::BIGINT AS wt FROM tf, whole GROUP BY t, docs
), part AS (SELECT doc_id, t, wt * ((1000000000 * tf) // (1000 * tf + 8 * m)) AS s FROM tf JOIN m USING (doc_id) JOIN weight USING (t)
), scores AS (
  SELECT item_id, doc_id, sum(s)::BIGINT AS score
  FROM (SELECT item_id, t, count(*) AS times FROM q GROUP BY ALL) JOIN (SELECT doc_id, t, s FROM part) USING (t), generate_series(1, times) g
  GROUP BY ALL
)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
FROM scores WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 10
"""


@query(SEARCH_SQL)
def op13_ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    return ranked_search.ranked(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query()
def op11_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = toxicity.fit(docs, table(spark, folder, "labels"))
    return toxicity.scored(docs, model, keep=["doc_id"]).select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted")
