"""The corpus operators as registered queries over the given tables, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fingerprints import fingerprints_with_edits

    return fingerprints_with_edits(_table(spark, sf_dir, "documents"))


def op2_knn_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .knn_quality import fit, score

    docs = _table(spark, sf_dir, "documents")
    return score(docs, fit(docs, _table(spark, sf_dir, "labels")))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix_counts

    return mix_counts(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import fit, score

    docs = _table(spark, sf_dir, "documents")
    return score(docs, fit(docs, _table(spark, sf_dir, "labels")))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard_join import join

    return join(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .bpe import digests

    return digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op7_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_extract import extract

    return extract(_table(spark, sf_dir, "pages"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .token_counts import count_tokens

    return count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import digests

    return digests(_table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import fit, judge

    docs = _table(spark, sf_dir, "documents")
    return judge(docs, fit(docs, _table(spark, sf_dir, "labels")))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ranked_search import search

    return search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .license_scan import labelled

    return labelled(_table(spark, sf_dir, "documents"))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .conversation_trie import nodes

    return nodes(_table(spark, sf_dir, "conversations"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


OP3_SQL = r"""
WITH sizes AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), per AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sizes GROUP BY source
), weighed AS (
  SELECT *, (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS weight FROM per
), running AS (
  SELECT *, CAST(sum(source_size) OVER () AS BIGINT) AS total, CAST(sum(weight) OVER () AS BIGINT) AS weights,
    CAST(coalesce(sum(source_size) OVER up, 0) AS BIGINT) AS size_before, CAST(coalesce(sum(weight) OVER up, 0) AS BIGINT) AS weight_before
  FROM weighed
  WINDOW up AS (ORDER BY source_size::DOUBLE / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), capped AS (
  SELECT *, 3 * source_size * (weights - weight_before) <= (total - 3 * size_before) * weight AS is_full FROM running
), level AS (
  SELECT *, CAST(sum(CASE WHEN is_full THEN source_size ELSE 0 END) OVER () AS BIGINT) AS full_size,
    CAST(sum(CASE WHEN is_full THEN weight ELSE 0 END) OVER () AS BIGINT) AS full_weight FROM capped
), rates AS (
  SELECT source, source_size,
    CASE WHEN is_full THEN (3 * source_size)::DOUBLE ELSE ((total - 3 * full_size) * weight)::DOUBLE / (weights - full_weight)::DOUBLE END AS target
  FROM level
), rated AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate FROM rates
), tried AS (
  SELECT r.source, r.source_size, r.target, r.rate, k.seed,
    abs(floor(r.rate) * r.source_size + sum(CASE WHEN CAST('0x' || substr(md5(k.seed::VARCHAR || ':' || coalesce(d.doc_id::VARCHAR, '')), 1, 12) AS BIGINT)::DOUBLE / 281474976710656.0 < r.rate - floor(r.rate) THEN d.size ELSE 0 END) - r.target) AS off
  FROM sizes d JOIN rated r ON d.source IS NOT DISTINCT FROM r.source, (SELECT unnest(range(32)) AS seed) k
  GROUP BY r.source, r.source_size, r.target, r.rate, k.seed
), best AS (
  SELECT source, source_size, target, rate, arg_min(seed, struct_pack(o := off, s := seed)) AS seed FROM tried GROUP BY source, source_size, target, rate
)
SELECT d.doc_id, d.size, b.source_size, b.target,
  CAST(d.size * (floor(b.rate) + CASE WHEN CAST('0x' || substr(md5(b.seed::VARCHAR || ':' || coalesce(d.doc_id::VARCHAR, '')), 1, 12) AS BIGINT)::DOUBLE / 281474976710656.0 < b.rate - floor(b.rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM sizes d JOIN best b ON d.source IS NOT DISTINCT FROM b.source
"""

OP11_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS row, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents
), sized AS (
  SELECT row, doc_id, CAST(len(terms) AS BIGINT) AS n FROM docs WHERE len(terms) > 0
), totals AS (
  SELECT CAST(count(*) AS BIGINT) AS nn, CAST(sum(n) AS BIGINT) AS ll FROM sized
), held AS (
  SELECT row, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT row, unnest(terms) AS term FROM docs) GROUP BY row, term
), weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * df + 1)::DOUBLE)) AS BIGINT) AS w
  FROM (SELECT term, count(*) AS df FROM held GROUP BY term), totals
), asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark
), scored AS (
  SELECT item_id, row, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * nn) // ll)))) AS BIGINT) AS score
  FROM asked JOIN weights USING (term) JOIN held USING (term) JOIN sized USING (row), totals
  GROUP BY item_id, row, doc_id
), ranked AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id ASC NULLS LAST) AS INTEGER) AS rank, doc_id, score FROM scored WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""

OP13_SQL = r"""
WITH turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn ASC NULLS FIRST) AS rank FROM conversations
), convs AS (
  SELECT conv_id, conv_id - conv_id % 20 AS base,
    xor(4294967295::BIGINT, list_reduce(
      list_prepend(4294967295::BIGINT, list_transform(range(8 * length(conv_id::VARCHAR)), lambda i: CASE WHEN i % 8 = 0 THEN ascii(substr(conv_id::VARCHAR, CAST(i // 8 + 1 AS INTEGER), 1)) ELSE 0 END)),
      lambda crc, x: CASE WHEN xor(crc, x) & 1 = 1 THEN xor(3988292384::BIGINT, xor(crc, x) >> 1) ELSE xor(crc, x) >> 1 END)) % 4 AS h
  FROM (SELECT DISTINCT conv_id FROM conversations)
), pieces AS (
  SELECT c.conv_id, 0 AS own, t.rank, t.role, t.text FROM convs c JOIN turns t ON t.conv_id = c.base AND t.rank <= c.h
  UNION ALL
  SELECT c.conv_id, 1 AS own, t.rank, t.role, t.text FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.rank > c.h
), rebuilt AS (
  SELECT conv_id, list(md5(length(role) || ':' || role || text) ORDER BY own, rank) AS said,
    list(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) ORDER BY own, rank) AS words
  FROM pieces GROUP BY conv_id
), whole AS (
  SELECT conv_id, coalesce(said, []) AS said, coalesce(words, []) AS words FROM convs LEFT JOIN rebuilt USING (conv_id)
), paths AS (
  SELECT conv_id, d, said[1:d] AS key, said[1:d - 1] AS above, words[d] AS words, d = len(said) AS ends FROM (SELECT *, unnest(range(len(said) + 1)) AS d FROM whole)
), nodes AS (
  SELECT CAST(d AS BIGINT) AS depth, key, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * coalesce(min(words), 0) AS saved, any_value(above) AS above,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256
  FROM paths GROUP BY d, key
), children AS (
  SELECT depth - 1 AS depth, above AS key, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY ALL
), counted AS (
  SELECT x.*, coalesce(c.n, 0) AS n_children FROM nodes x LEFT JOIN children c USING (depth, key)
), ancestors AS (
  SELECT key[1:a] AS key, a AS depth, saved, (n_children = 0)::BIGINT AS leaf FROM (SELECT *, unnest(range(depth + 1)) AS a FROM counted)
), sums AS (
  SELECT depth, key, sum(saved) AS saved_tokens, sum(leaf) AS n_leaves FROM ancestors GROUP BY depth, key
)
SELECT x.conv_id, x.depth, p.conv_id AS parent_conv_id, x.n_convs, CAST(x.n_children AS BIGINT) AS n_children, CAST(s.n_leaves AS BIGINT) AS n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, x.ends_sha256
FROM counted x JOIN sums s USING (depth, key) LEFT JOIN nodes p ON x.depth > 0 AND p.depth = x.depth - 1 AND p.key = x.above
"""


def op12_sql() -> str:
    """Every template at every place, from the fixed templates and phrases."""
    from .license_scan import PHRASES, SHARE, SLACK, TEMPLATES, split

    value = lambda x: str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"
    values = lambda rows: ", ".join("(" + ", ".join(map(value, r)) + ")" for r in rows)
    words = [(t, p, w) for t, x in enumerate(TEMPLATES) for p, w in enumerate(split(x[1]))]
    keys = [(t, " ".join(split(k))) for t, x in enumerate(TEMPLATES) for k in x[2]]
    labels = [(t, x[0]) for t, x in enumerate(TEMPLATES)]
    base = [(label, " ".join(split(p)), len(split(p))) for p, label in PHRASES.items()]
    return rf"""
WITH tw AS (SELECT * FROM (VALUES {values(words)}) v(t, p, w)), tk AS (SELECT * FROM (VALUES {values(keys)}) v(t, phrase)),
tl AS (SELECT * FROM (VALUES {values(labels)}) v(t, label)), tb AS (SELECT * FROM (VALUES {values(base)}) v(label, phrase, size)),
docs AS (
  SELECT row_number() OVER () AS row, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM documents
), placed AS (
  SELECT row, unnest(words) AS w, unnest(range(len(words))) AS place FROM docs
), weights AS (
  SELECT w, greatest(1, CAST(floor(1000 * ln((2 * n + 2)::DOUBLE / (2 * df + 1)::DOUBLE)) AS BIGINT)) AS weight
  FROM (SELECT k.w, count(DISTINCT d.row) AS df FROM (SELECT DISTINCT w FROM tw) k LEFT JOIN placed d USING (w) GROUP BY k.w), (SELECT count(*) AS n FROM docs WHERE len(words) > 0)
), passages AS (
  SELECT t, p, w, weight, sum(weight) OVER (PARTITION BY t) AS total, count(*) OVER (PARTITION BY t) AS size FROM tw JOIN weights USING (w)
), hits AS (
  SELECT DISTINCT d.row, t, p, weight, total, size, d.place - p - x.off AS o FROM placed d JOIN passages USING (w), (SELECT unnest(range(-{SLACK}, {SLACK} + 1)) AS off) x
), near AS (
  SELECT row, t, o, any_value(total) AS total, any_value(size) AS size, sum(weight) AS found FROM hits GROUP BY row, t, o HAVING 100 * sum(weight) >= {SHARE} * any_value(total)
), seen AS (
  SELECT n.row, n.t, n.o, n.found::DOUBLE / n.total::DOUBLE AS share, ' ' || array_to_string(list_slice(words, greatest(o - {SLACK}, 0) + 1, o + size + {SLACK}), ' ') || ' ' AS part FROM near n JOIN docs USING (row)
), matched AS (
  SELECT s.row, s.t, s.o, any_value(share) AS share FROM seen s JOIN tk USING (t) GROUP BY s.row, s.t, s.o HAVING bool_and(contains(part, ' ' || phrase || ' '))
), based AS (
  SELECT row, label, place FROM (SELECT row, place, w, w || ' ' || lead(w) OVER u AS two, w || ' ' || lead(w) OVER u || ' ' || lead(w, 2) OVER u AS three FROM placed WINDOW u AS (PARTITION BY row ORDER BY place)) x
  JOIN tb ON phrase = CASE size WHEN 1 THEN w WHEN 2 THEN two ELSE three END
), told AS (
  SELECT row, label, share FROM matched JOIN tl USING (t) UNION ALL SELECT row, label, 1.0 FROM based
)
SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(b.n, 0) AS BIGINT) AS n_base, CAST(b.low AS BIGINT) AS first_word, CAST(b.high AS BIGINT) AS last_word,
  coalesce(b.labels, '') AS base_labels, coalesce(m.labels, '') AS labels, coalesce(m.score, 0.0)::DOUBLE AS score
FROM docs d LEFT JOIN (SELECT row, count(*) AS n, min(place) AS low, max(place) AS high, array_to_string(list_sort(list(DISTINCT label)), ',') AS labels FROM based GROUP BY row) b USING (row)
LEFT JOIN (SELECT row, array_to_string(list_sort(list(DISTINCT label)), ',') AS labels, max(share) AS score FROM told GROUP BY row) m USING (row)
"""


def queries() -> dict:
    named = {k: f for k, f in globals().items() if k.startswith("op") and callable(f) and not k.endswith("_sql")}
    return dict(sorted(named.items(), key=lambda x: int(x[0][2:].split("_")[0]))) | {"pipeline": pipeline}


def oracle_sql() -> dict[str, str]:
    return {"op3_mixing": OP3_SQL, "op11_ranked_search": OP11_SQL, "op12_license_scan": op12_sql(), "op13_conversation_trie": OP13_SQL}
