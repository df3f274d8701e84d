"""Queries of the training-data operators: ``name -> f(spark, sf_dir)``, with
production parameters over whole tables, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimwise.llm import classifier, jaccard, language_model, lexical, line_rules, merkle, mixing, neighbours, packing, substrings, token_files, urls, warc


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_read(spark, sf_dir, "documents"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(_read(spark, sf_dir, "documents"), texts=False)


def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(_read(spark, sf_dir, "pages"), URL_RULES)


def op5_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = line_rules.quality_rules(_read(spark, sf_dir, "documents"))
    return judged.select("doc_id", *line_rules.COUNTS, "n_frequent_words", "base_failed", "kept")


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.read_token_files(token_files.write_token_files(_read(spark, sf_dir, "documents")))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifier.classify(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


# Target weights of the mixing query; other values weigh 1.
DOMAINS = ["web", "news", "books", "forum"]  # by the number in the source's name
MIX_LEVELS = ["domain", "lang", "source"]
MIX_WEIGHTS = {"domain": {"web": 4, "news": 3, "books": 2, "forum": 1}, "lang": {"en": 5, "de": 2, "fr": 2, "es": 1}}
MIX_SHARE, MIX_EPOCHS, MIX_SEED = 0.8, 4, 17


def domain(source: str) -> Column:
    number = F.expr(f"try_cast(regexp_extract({source}, '([0-9]+)$', 1) as bigint)")
    return F.get(F.array(*map(F.lit, DOMAINS)), F.coalesce(number % len(DOMAINS), F.lit(0)).cast("int"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", domain("source").alias("domain"))
    small, plan = mixing.plan_mix(docs, MIX_LEVELS, MIX_WEIGHTS, share=MIX_SHARE, max_epochs=MIX_EPOCHS, seed=MIX_SEED)
    rows = mixing.select_mix(small, plan, MIX_LEVELS, seed=MIX_SEED)
    return rows.select("doc_id", *MIX_LEVELS, "epoch", "n_tokens")


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.train_and_score(_read(spark, sf_dir, "documents")).drop("perplexity")


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = jaccard.jaccard_join(_read(spark, sf_dir, "documents"))
    return rows.select("doc_id", "class_id", "copy_of", "n_links", "n_grams")


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(lexical.build_index(_read(spark, sf_dir, "documents")), _read(spark, sf_dir, "benchmark"))


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived_pages(warc.write_warc(_read(spark, sf_dir, "pages")))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(_read(spark, sf_dir, "documents")).drop("n_levels")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_packing": op1_packing,
        "op2_substring_dedup": op2_substring_dedup,
        "op3_neighbours": op3_neighbours,
        "op4_url_filters": op4_url_filters,
        "op5_line_rules": op5_line_rules,
        "op6_token_files": op6_token_files,
        "op7_quality_classifier": op7_quality_classifier,
        "op8_mixing": op8_mixing,
        "op9_lm_scoring": op9_lm_scoring,
        "op10_jaccard_join": op10_jaccard_join,
        "op11_lexical_search": op11_lexical_search,
        "op12_warc": op12_warc,
        "op13_merkle_manifest": op13_merkle_manifest,
    }


def _mix_sql() -> str:
    pick = lambda n: "CASE " + " ".join(f"WHEN {n} = '{v}' THEN {k}" for v, k in MIX_WEIGHTS.get(n, {}).items()) + " ELSE 1 END" if n in MIX_WEIGHTS else "1"
    steps, up = [], []
    for i, n in enumerate(MIX_LEVELS):
        own = MIX_LEVELS[: i + 1]
        part = f"PARTITION BY {', '.join(up)}" if up else ""
        on = " AND ".join(f"c.{x} IS NOT DISTINCT FROM p.{x}" for x in up) or "true"
        steps.append(f"""
n{i} AS (SELECT c.*, p.given FROM (SELECT {', '.join(own)}, sum(cap)::BIGINT AS cap, {pick(n)} AS weight FROM leaves GROUP BY {', '.join(own)}) c JOIN g{i} p ON {on}),
l{i} AS (SELECT *, (given - coalesce(sum(cap) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
    / (sum(weight) OVER ({part}) - coalesce(sum(weight) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE AS lvl
  FROM n{i} WINDOW w AS ({part} ORDER BY cap::DOUBLE / weight, {n} NULLS FIRST)),
g{i + 1} AS (SELECT {', '.join(own)}, CASE WHEN cap <= lvl * weight THEN cap::DOUBLE
    ELSE greatest(0::DOUBLE, max(CASE WHEN NOT cap <= lvl * weight THEN lvl END) OVER ({part})) * weight END AS given FROM l{i})""")
        up.append(n)
    lv = ", ".join(MIX_LEVELS)
    on = " AND ".join(f"d.{x} IS NOT DISTINCT FROM b.{x}" for x in MIX_LEVELS)
    number = "try_cast(regexp_extract(source, '([0-9]+)$', 1) AS BIGINT)"
    return f"""
WITH d AS (SELECT doc_id, lang, source, {DOMAINS!r}[coalesce({number} % {len(DOMAINS)}, 0) + 1] AS domain,
    coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS n_tokens FROM documents),
leaves AS (SELECT {lv}, sum(n_tokens)::BIGINT AS tokens, sum(n_tokens)::BIGINT * {MIX_EPOCHS} AS cap FROM d GROUP BY {lv}),
g0 AS (SELECT floor(sum(tokens)::DOUBLE * {MIX_SHARE}::DOUBLE) AS given FROM leaves),{','.join(steps)},
b AS (SELECT l.*, floor(g.given)::BIGINT AS budget, CASE WHEN tokens > 0 THEN floor(floor(g.given) / tokens)::BIGINT ELSE 0 END AS epochs
  FROM leaves l JOIN g{len(MIX_LEVELS)} g ON {" AND ".join(f"l.{x} IS NOT DISTINCT FROM g.{x}" for x in MIX_LEVELS)}),
e AS (SELECT d.*, b.budget - b.epochs * b.tokens AS remaining, b.epochs, unnest(range(0, b.epochs + 1)) AS epoch FROM d JOIN b ON {on}),
o AS (SELECT *, sum(n_tokens) OVER (PARTITION BY {lv}, epoch ORDER BY md5('{MIX_SEED}-' || epoch || '-' || coalesce(doc_id::VARCHAR, 'null'))) AS upto FROM e)
SELECT doc_id, {lv}, epoch::BIGINT AS epoch, n_tokens::BIGINT AS n_tokens FROM o WHERE epoch < epochs OR (remaining > 0 AND upto <= remaining)"""


REPEATS_SQL = r"""
WITH w AS (
  SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos
  FROM (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM documents)),
g AS (
  SELECT doc_id, pos, word, string_agg(word, ' ') OVER v AS seq, count(*) OVER v AS n
  FROM w WINDOW v AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)),
f AS (SELECT doc_id, pos, word, n = 20 AND row_number() OVER (PARTITION BY md5(seq), n ORDER BY doc_id, pos) > 1 AS repeat FROM g),
c AS (
  SELECT doc_id, pos, word, bool_or(repeat) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone
  FROM f),
k AS (
  SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed,
    sha256(coalesce(string_agg(word, ' ' ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
  FROM c GROUP BY doc_id)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, coalesce(kept_sha256, sha256('')) AS kept_sha256
FROM documents LEFT JOIN k USING (doc_id)"""


JACCARD_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (
  SELECT DISTINCT doc_id, md5(array_to_string(ws[i:i + 4], ' ')) AS gram
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(2, len(ws) - 3))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n, md5(string_agg(gram, '' ORDER BY gram)) AS same FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM g a JOIN g b USING (gram) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE common >= 0.8 * (x.n + y.n - common)),
r AS (SELECT doc_id AS node, doc_id AS root FROM documents UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.node),
c AS (SELECT node AS doc_id, min(root) AS class_id FROM r GROUP BY node),
k AS (SELECT a AS doc_id, count(*) AS n_links FROM l GROUP BY a)
SELECT doc_id, class_id, CASE WHEN n.n IS NULL THEN doc_id ELSE min(doc_id) OVER (PARTITION BY same) END AS copy_of,
  coalesce(n_links, 0) AS n_links, coalesce(n.n, 0) AS n_grams
FROM c LEFT JOIN k USING (doc_id) LEFT JOIN n USING (doc_id)"""


LINES_SQL = rf"""
WITH t AS (SELECT doc_id, source AS host, coalesce(text, '') AS text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM documents),
l AS (SELECT doc_id, host, text, line, i, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS lw
  FROM (SELECT *, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM t)),
q AS (SELECT doc_id, host, text, len(lw) AS n, row_number() OVER (PARTITION BY doc_id, line ORDER BY i) > 1 AS again,
    translate(array_to_string(lw, ' '), '{urls.UPPER}', '{urls.LOWER}') AS norm FROM l WHERE len(lw) > 0),
h AS (SELECT host, count(DISTINCT text) AS docs FROM t GROUP BY host),
f AS (SELECT q.host, norm FROM q JOIN h ON q.host IS NOT DISTINCT FROM h.host GROUP BY q.host, norm, docs
  HAVING count(DISTINCT text) > {line_rules.MIN_DOCS} AND count(DISTINCT text) > docs * {line_rules.SHARE}::DOUBLE),
d AS (SELECT doc_id, count(*) FILTER (again) AS n_dup_lines, coalesce(sum(n) FILTER (f.norm IS NOT NULL), 0)::BIGINT AS n_frequent_words
  FROM q LEFT JOIN f ON q.norm = f.norm AND q.host IS NOT DISTINCT FROM f.host GROUP BY doc_id),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, ws[i], ws[i + 1], ws[i + 2]) > 1 AND i <= len(ws) - 2 AS twice
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM t)),
r AS (SELECT doc_id, count(*) FILTER (hit) AS n_repeat_words
  FROM (SELECT doc_id, bool_or(twice) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS hit FROM g) GROUP BY doc_id),
a AS (SELECT doc_id, len(ws) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
    length(regexp_replace(text, '[^{line_rules.SYMBOLS}]+', '', 'g')) AS n_symbols FROM t),
b AS (SELECT doc_id, n_words, word_chars, n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
    coalesce(n_frequent_words, 0) AS n_frequent_words FROM a LEFT JOIN d USING (doc_id) LEFT JOIN r USING (doc_id))
SELECT *, n_words < {line_rules.LEAST_WORDS} OR 100 * n_repeat_words > {line_rules.MOST_REPEATED} * n_words AS base_failed,
  NOT (n_words < {line_rules.LEAST_WORDS} OR 100 * n_repeat_words > {line_rules.MOST_REPEATED} * n_words)
    AND n_frequent_words <= n_words * {line_rules.DEPLETED}::DOUBLE AS kept FROM b"""


LEXICAL_SQL = rf"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, '{urls.UPPER}', '{urls.LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
f AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(ws) AS term FROM t) GROUP BY ALL),
d AS (SELECT r, doc_id, len(ws) AS n FROM t WHERE len(ws) > 0),
g AS (SELECT count(*) AS docs, sum(n)::BIGINT AS total FROM d),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, '{urls.UPPER}', '{urls.LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
x AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM f, g GROUP BY term),
s AS (SELECT q.item_id, f.r, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * docs) // total))))::BIGINT AS score
  FROM q JOIN x USING (term) JOIN f USING (term) JOIN d USING (r), g GROUP BY q.item_id, f.r)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank, doc_id, score
FROM s JOIN d USING (r) WHERE score > 0 QUALIFY rank <= 10"""


WARC_SQL = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, CASE WHEN payload_bytes >= {warc.MIN_BYTES} THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first IS NULL OR page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to FROM f"""


def _merkle_sql() -> str:
    field = lambda c, v: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({v}::VARCHAR) || ':' || {v}::VARCHAR END"
    own = " || ".join(field(c, c) for c in merkle.FIELDS)
    other = " || ".join(field(c, f"translate(text, '{urls.UPPER}', '{urls.LOWER}')" if c == "text" else c) for c in merkle.FIELDS)
    table = [_crc_entry(i) for i in range(256)]
    k = merkle.FANOUT
    return f"""
WITH RECURSIVE
b AS (SELECT row_number() OVER () AS r, *, CASE WHEN doc_id IS NULL THEN false ELSE
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
      lambda a, c: xor(a >> 8, {table}[(xor(a, c) & 255) + 1])), 4294967295::BIGINT) % 5 = 0 END AS picked FROM documents),
l AS (SELECT r, doc_id, source, sha256({own}) AS leaf, CASE WHEN picked THEN sha256({other}) END AS changed FROM b),
p AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n,
    dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS g FROM l),
t AS (SELECT g, 0 AS lv, pos, n, leaf AS h FROM p
  UNION ALL SELECT g, lv + 1, pos // {k}, (max(n) + {k - 1}) // {k}, sha256(string_agg(h, '' ORDER BY pos)) FROM t WHERE n > 1 GROUP BY g, lv, pos // {k}),
s AS (SELECT g, h FROM t WHERE n = 1),
u AS (SELECT 0 AS lv, g AS pos, (SELECT count(*) FROM s) AS n, h FROM s
  UNION ALL SELECT lv + 1, pos // {k}, (max(n) + {k - 1}) // {k}, sha256(string_agg(h, '' ORDER BY pos)) FROM u WHERE n > 1 GROUP BY lv, pos // {k}),
a AS (SELECT g, lv, pos // {k} AS up, n, list(h ORDER BY pos) AS run FROM t WHERE n > 1 GROUP BY g, lv, pos // {k}, n
  UNION ALL SELECT -1, lv, pos // {k}, n, list(h ORDER BY pos) FROM u WHERE n > 1 GROUP BY lv, pos // {k}, n),
w AS (SELECT r, g, g AS home, 0 AS lv, pos, n, coalesce(changed, leaf) AS cur, '' AS proof FROM p
  UNION ALL
  SELECT r, CASE WHEN w.n > 1 THEN w.g ELSE -1 END, home, CASE WHEN w.n > 1 THEN w.lv + 1 ELSE 0 END, CASE WHEN w.n > 1 THEN w.pos // {k} ELSE home END,
    CASE WHEN w.n > 1 THEN (w.n + {k - 1}) // {k} ELSE (SELECT count(*) FROM s) END,
    CASE WHEN w.n > 1 THEN sha256(array_to_string(run[:w.pos % {k}], '') || cur || array_to_string(run[w.pos % {k} + 2:], '')) ELSE cur END,
    CASE WHEN w.n > 1 THEN proof || array_to_string(run[:w.pos % {k}], '') || array_to_string(run[w.pos % {k} + 2:], '') ELSE proof END
  FROM w LEFT JOIN a ON a.g = w.g AND a.lv = w.lv AND a.up = w.pos // {k} WHERE w.n > 1 OR w.g >= 0)
SELECT doc_id, leaf, s.h AS subroot, u.h AS root, sha256(proof) AS proof_sha256, cur AS folded_root, cur = u.h AS verified
FROM p JOIN w USING (r) JOIN s ON s.g = p.g JOIN u ON u.n = 1 WHERE w.g = -1 AND w.n = 1"""


def _crc_entry(i: int) -> int:
    for _ in range(8):
        i = (i >> 1) ^ (0xEDB88320 if i & 1 else 0)
    return i


def oracle_sql() -> dict[str, str]:
    return {
        "op5_line_rules": LINES_SQL,
        "op10_jaccard_join": JACCARD_SQL,
        "op2_substring_dedup": REPEATS_SQL,
        "op4_url_filters": urls.judge_sql(URL_RULES),
        "op8_mixing": _mix_sql(),
        "op11_lexical_search": LEXICAL_SQL,
        "op12_warc": WARC_SQL,
        "op13_merkle_manifest": _merkle_sql(),
    }
