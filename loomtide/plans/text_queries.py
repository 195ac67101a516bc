"""Registered queries of word-level encoding and decoding and of the text pipeline, with their SQL."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import tokens
from ..operators.text import WordLevel, word_counts
from ..operators.tokenizer_file import TokenizerFile
from .queries import _WORDS_SQL, register, table, weighed, weighed_sql

# the 996 commonest words after four special tokens
_VOCABULARY_SQL = f"""w AS (SELECT unnest({_WORDS_SQL}) AS token FROM documents),
v AS (SELECT token, CAST(row_number() OVER (ORDER BY n DESC, token) + 3 AS INTEGER) AS id FROM (SELECT token, count(*) AS n FROM w GROUP BY token ORDER BY n DESC, token LIMIT 996))"""


def _words_of(text: str) -> str:
    return _WORDS_SQL.replace("text", text)


def tokenizer(spark: SparkSession, sf_dir: str) -> WordLevel:
    common = word_counts(table(spark, sf_dir, "documents")).orderBy(F.desc("n"), "token").limit(996)
    vocabulary = common.select("token", (F.row_number().over(Window.orderBy(F.desc("n"), "token")) + 3).cast("int").alias("id"))
    special = spark.createDataFrame([("[PAD]", 0), ("[UNK]", 1), ("[CLS]", 2), ("[SEP]", 3)], "token string, id int")
    return WordLevel(vocabulary.union(special))


_IDS = "SELECT {key}, list(coalesce(v.id, 1) ORDER BY place) AS ids FROM (SELECT {key}, unnest({words}) AS token, unnest(range(len({words}))) AS place FROM {rows}) x LEFT JOIN v USING (token) GROUP BY {key}"


@register(
    "text_wordlevel_encode",
    f"""WITH {_VOCABULARY_SQL}, i AS ({_IDS.format(key='doc_id', words=_WORDS_SQL, rows='documents')}),
e AS (SELECT d.doc_id, list_concat(list_concat([2], coalesce(ids[1:62], [])), [3]) AS ids FROM documents d LEFT JOIN i USING (doc_id))
SELECT doc_id, CAST(len(ids) AS BIGINT) AS n, {weighed_sql('ids')} AS ids FROM e""",
)
def text_wordlevel_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document between its special tokens, 64 ids at most."""
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("pos"), "text")
    out = tokenizer(spark, sf_dir).encode(rows, max_length=64)
    return out.select(F.col("pos").alias("doc_id"), F.size("input_ids").cast("long").alias("n"), weighed(F.col("input_ids")).alias("ids"))


@register(
    "text_wordlevel_decode",
    f"""WITH {_VOCABULARY_SQL}, t AS (SELECT doc_id, unnest({_WORDS_SQL}) AS token, unnest(range(len({_WORDS_SQL}))) AS place FROM documents),
k AS (SELECT doc_id, string_agg(token, ' ' ORDER BY place) AS text FROM t JOIN v USING (token) GROUP BY doc_id)
SELECT d.doc_id, md5(coalesce(k.text, '')) AS digest, CAST(length(coalesce(k.text, '')) AS BIGINT) AS n_chars FROM documents d LEFT JOIN k USING (doc_id)""",
)
def text_wordlevel_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded whole and decoded again: what the vocabulary does not know is gone."""
    rows, t = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("pos"), "text"), tokenizer(spark, sf_dir)
    return t.decode(t.encode(rows)).select(F.col("pos").alias("doc_id"), F.md5("text").alias("digest"), F.length("text").cast("long").alias("n_chars"))


_PAIRS_SQL = "SELECT a.conv_id * 1000 + a.turn AS pos, a.text AS one, b.text AS two FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1"
_KEPT = "CASE WHEN la + lb <= 29 THEN la WHEN lb <= 14 THEN 29 - lb WHEN la <= 15 THEN la ELSE 15 END"


@register(
    "text_wordlevel_pairs",
    f"""WITH {_VOCABULARY_SQL}, p AS ({_PAIRS_SQL}), a AS ({_IDS.format(key='pos', words=_words_of('one'), rows='p')}), b AS ({_IDS.format(key='pos', words=_words_of('two'), rows='p')}),
e AS (SELECT p.pos, coalesce(a.ids, []) AS x, coalesce(b.ids, []) AS y, len(coalesce(a.ids, [])) AS la, len(coalesce(b.ids, [])) AS lb FROM p LEFT JOIN a USING (pos) LEFT JOIN b USING (pos)),
c AS (SELECT pos, x[1:ka] AS x, y[1:least(lb, 29 - least(la, ka))] AS y FROM (SELECT *, {_KEPT} AS ka FROM e))
SELECT pos, {weighed_sql('list_concat(list_concat(list_concat([2], x), [3]), list_concat(y, [3]))')} AS ids, CAST(len(x) + 2 AS BIGINT) AS n_first, CAST(len(y) + 1 AS BIGINT) AS n_second FROM c""",
)
def text_wordlevel_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn with the next one as a pair of 32 ids at most."""
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    after = t.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("text_pair"))
    pairs = t.join(after, ["conv_id", "turn"]).select((F.col("conv_id") * 1000 + F.col("turn")).alias("pos"), "text", "text_pair")
    out = tokenizer(spark, sf_dir).encode(pairs, pair=True, max_length=32)
    second = F.aggregate("token_type_ids", F.lit(0).cast("long"), lambda s, x: s + x)
    return out.select("pos", weighed(F.col("input_ids")).alias("ids"), (F.size("input_ids") - second).alias("n_first"), second.alias("n_second"))


_PIECES_SQL = f"""w AS (SELECT token, count(*) AS n FROM (SELECT unnest({_WORDS_SQL}) AS token FROM documents) GROUP BY token),
s AS (SELECT piece, sum(n) AS n FROM (SELECT substr(token, 1, k) AS piece, n FROM w, (SELECT unnest(range(1, 5)) AS k) WHERE k <= length(token)) GROUP BY piece ORDER BY n DESC, piece LIMIT 400),
m AS (SELECT piece, sum(n) AS n FROM (SELECT substr(token, st, k) AS piece, n, st, k, length(token) AS size FROM (SELECT token, n, unnest(range(2, length(token) + 1)) AS st FROM w), (SELECT unnest(range(1, 4)) AS k)) WHERE st + k - 1 <= size GROUP BY piece ORDER BY n DESC, piece LIMIT 600),
v AS (SELECT piece, 0 AS later, CAST(row_number() OVER (ORDER BY n DESC, piece) AS INTEGER) AS id FROM s UNION ALL SELECT piece, 1, CAST(row_number() OVER (ORDER BY n DESC, piece) AS INTEGER) + 400 FROM m)"""


def _pieces_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(token, id): the 400 commonest beginnings of words and the 600 commonest pieces behind them."""
    token, size = F.col("token"), F.length("token")
    piece = lambda later, at, k: F.struct(F.lit(later).alias("later"), F.substring(token, at, k).alias("piece"))
    heads = F.transform(F.sequence(F.lit(1), F.least(F.lit(4), size)), lambda k: piece(False, F.lit(1), k))
    inner = lambda at: F.transform(F.sequence(F.lit(1), F.least(F.lit(3), size - at + 1)), lambda k: piece(True, at, k))
    behind = F.when(size > 1, F.flatten(F.transform(F.sequence(F.lit(2), F.greatest(F.lit(2), size)), inner))).otherwise(F.slice(heads, 1, 0))
    # words are counted once for both kinds
    found = word_counts(table(spark, sf_dir, "documents")).select(F.explode(F.concat(heads, behind)).alias("p"), "n").groupBy("p.later", "p.piece").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("later").orderBy(F.desc("n"), "piece"))
    common = found.withColumn("rank", rank).where(F.col("rank") <= 600).where(F.col("later") | (F.col("rank") <= 400))
    return common.select(F.concat(F.when(F.col("later"), "##").otherwise(""), "piece").alias("token"), (F.col("rank") + F.when(F.col("later"), 400).otherwise(0)).cast("int").alias("id"))


@register(
    "text_wordpiece_encode",
    f"""WITH RECURSIVE {_PIECES_SQL},
g AS (SELECT token, 1 AS st, [] :: INTEGER[] AS ids, true AS good FROM w
UNION ALL
SELECT token, CASE WHEN p.id IS NULL THEN length(token) + 1 ELSE st + p.size END, CASE WHEN p.id IS NULL THEN [0] ELSE list_append(ids, p.id) END, p.id IS NOT NULL
FROM g LEFT JOIN LATERAL (
  SELECT v.id, length(v.piece) AS size FROM v WHERE v.later = CAST(g.st > 1 AS INTEGER) AND substr(g.token, g.st, length(v.piece)) = v.piece ORDER BY length(v.piece) DESC LIMIT 1
) p ON true WHERE g.st <= length(g.token)),
k AS (SELECT token, CASE WHEN length(token) > 100 THEN [0] ELSE ids END AS ids FROM g WHERE st > length(token)),
d AS (SELECT doc_id, unnest({_WORDS_SQL}) AS token, unnest(range(len({_WORDS_SQL}))) AS place FROM documents),
e AS (SELECT doc_id, flatten(list(k.ids ORDER BY place)) AS ids FROM d JOIN k USING (token) GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(len(ids), 0) AS BIGINT) AS n, CAST(coalesce(list_sum(list_transform(ids, lambda x: CAST(x = 0 AS INTEGER))), 0) AS BIGINT) AS n_unknown, {weighed_sql('coalesce(ids, [])')} AS ids FROM documents d LEFT JOIN e USING (doc_id)""",
)
def text_wordpiece_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document whole by word pieces from a tokenizer file made of the documents' own words."""
    vocabulary = {"[UNK]": 0} | {r["token"]: r["id"] for r in _pieces_table(spark, sf_dir).collect()}  # 1,000 rows
    file = {
        "version": "1.0", "normalizer": {"type": "Lowercase"}, "pre_tokenizer": {"type": "WhitespaceSplit"}, "post_processor": None, "decoder": {"type": "WordPiece"},
        "model": {"type": "WordPiece", "unk_token": "[UNK]", "continuing_subword_prefix": "##", "max_input_chars_per_word": 100, "vocab": vocabulary},
    }
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("pos"), "text")
    out = TokenizerFile(json.dumps(file)).encode(rows)
    unknown = F.size(F.filter("input_ids", lambda x: x == 0)).cast("long")
    return out.select(F.col("pos").alias("doc_id"), F.size("input_ids").cast("long").alias("n"), unknown.alias("n_unknown"), weighed(F.col("input_ids")).alias("ids"))
