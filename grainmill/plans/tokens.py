"""Queries over token streams, mixes and decoding filters. A word's token is its length, so that SQL can make the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import decoding as D
from ..operators import packing as P
from ..operators import shuffling as H
from .base import query, table

TOKENS = "tok AS (SELECT doc_id, lang, list_transform(regexp_extract_all(text, '[^ \\n]+'), lambda w: CAST(length(w) AS INT)) AS ids FROM documents)"


def tokens(spark, d):
    words = F.regexp_extract_all("text", F.lit(r"[^ \n]+"), 0)
    return table(spark, d, "documents").select("doc_id", "lang", F.transform(words, F.length).alias("ids"))


@query("token_split", f"""WITH {TOKENS}, c AS (SELECT doc_id, len(ids) AS n, CASE WHEN len(ids) <= 1 THEN len(ids) ELSE least(greatest(CAST(trunc(CAST(0.9 AS DOUBLE) * len(ids)) AS BIGINT), 1), len(ids) - 1) END AS k, ids FROM tok)
SELECT doc_id, CAST(k AS INT) AS n_train, CAST(n - k AS INT) AS n_val, CAST(list_sum(ids[1:k]) AS BIGINT) AS sum_train, CAST(coalesce(list_sum(ids[k+1:]), 0) AS BIGINT) AS sum_val FROM c""")
def token_split(spark, d):
    total = lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda a, x: a + x)
    s = P.split_tokens(tokens(spark, d))
    return s.select("doc_id", F.size("train_ids").alias("n_train"), F.size("val_ids").alias("n_val"), total("train_ids").alias("sum_train"), total("val_ids").alias("sum_val"))


def _offset(spark, d):
    return P.offsets(tokens(spark, d).withColumn("n_tokens", F.size("ids").cast("bigint")), ["doc_id"])


@query("token_offsets", f"WITH {TOKENS} SELECT doc_id, len(ids) AS n_tokens, CAST(coalesce(sum(len(ids)) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM tok")
def token_offsets(spark, d):
    return _offset(spark, d).select("doc_id", "n_tokens", "before")


STREAM = f"{TOKENS}, st AS (SELECT id, row_number() OVER (ORDER BY doc_id, i) - 1 AS p FROM (SELECT doc_id, unnest(ids) AS id, unnest(range(len(ids))) AS i FROM tok)), bl AS (SELECT p // 1024 AS block_id, list(id ORDER BY p) AS ids FROM st GROUP BY 1)"


@query("pack_blocks", f"WITH {STREAM} SELECT CAST(block_id AS BIGINT) AS block_id, array_to_string(ids, ' ') AS ids FROM bl WHERE len(ids) = 1024")
def pack_blocks(spark, d):
    return P.pack(_offset(spark, d), 1024).select("block_id", F.array_join(F.transform("ids", lambda x: x.cast("string")), " ").alias("ids"))


def token_blocks(spark, d):
    return P.pack(_offset(spark, d), 1024)


@query("pack_blocks_padded", f"WITH {STREAM} SELECT CAST(block_id AS BIGINT) AS block_id, CAST(list_sum(ids) AS BIGINT) AS total, 1024 AS n FROM bl WHERE len(ids) > 1")
def pack_blocks_padded(spark, d):
    b = P.pack(_offset(spark, d), 1024, pad=0)
    return b.select("block_id", F.aggregate("ids", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("total"), F.size("ids").alias("n"))


@query("shifted_pairs", f"WITH {STREAM} SELECT CAST(block_id AS BIGINT) AS block_id, 1023 AS nx, ids[1] AS first_x, ids[2] AS first_y, ids[1023] AS last_x, ids[1024] AS last_y FROM bl WHERE len(ids) = 1024")
def shifted_pairs(spark, d):
    s = P.shifted(P.pack(_offset(spark, d), 1024))
    return s.select("block_id", F.size("x").alias("nx"), F.get("x", F.lit(0)).alias("first_x"), F.get("y", F.lit(0)).alias("first_y"), F.get("x", F.lit(1022)).alias("last_x"), F.get("y", F.lit(1022)).alias("last_y"))


@query("collate_batches", f"WITH {TOKENS} SELECT doc_id, CAST(max(len(ids)) OVER (PARTITION BY doc_id // 8) AS INT) AS n, CAST(list_sum(ids) AS BIGINT) AS total FROM tok")
def collate_batches(spark, d):
    c = P.collate(tokens(spark, d).withColumn("batch", F.expr("doc_id div 8")), "batch")
    return c.select("doc_id", F.size("ids").alias("n"), F.aggregate("ids", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("total"))


@query("doc_split", "WITH k AS (SELECT doc_id, row_number() OVER (ORDER BY sha256(concat('42|', doc_id))) AS r, count(*) OVER () AS n FROM documents) SELECT doc_id, CASE WHEN r <= least(greatest(1, round_even(n * CAST(0.05 AS DOUBLE), 0)), n - 1) THEN 'val' ELSE 'train' END AS split FROM k")
def doc_split(spark, d):
    return P.split_documents(table(spark, d, "documents").select("doc_id"), F.col("doc_id"))


@query("group_chunks", f"""WITH {TOKENS}, st AS (SELECT doc_id // 100 AS g, id, row_number() OVER (PARTITION BY doc_id // 100 ORDER BY doc_id, i) - 1 AS p FROM (SELECT doc_id, unnest(ids) AS id, unnest(range(len(ids))) AS i FROM tok))
SELECT CAST(g AS BIGINT) AS g, CAST(p // 512 AS BIGINT) AS block_id, CAST(sum(id) AS BIGINT) AS total FROM st GROUP BY g, p // 512 HAVING count(*) = 512""")
def group_chunks(spark, d):
    b = P.pack_groups(tokens(spark, d).withColumn("g", F.expr("doc_id div 100")), "g", ["doc_id"], 512)
    return b.select("g", "block_id", F.aggregate("ids", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("total"))


MIX = "{0} AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS r, count(*) OVER () // {1} * {1} AS n FROM documents WHERE lang = '{2}')"


@query("mix_batches", f"""WITH {MIX.format('a', 6, 'en')}, {MIX.format('b', 2, 'de')}
SELECT s.s AS step, CAST(k.k AS INT) AS slot, 'main' AS corpus, a.doc_id AS block_id FROM range(200) s(s), range(6) k(k), a WHERE a.r = (s.s * 6 + k.k) % a.n
UNION ALL SELECT s.s, CAST(k.k + 6 AS INT), 'extra', b.doc_id FROM range(200) s(s), range(2) k(k), b WHERE b.r = (s.s * 2 + k.k) % b.n""")
def mix_batches(spark, d):
    docs = table(spark, d, "documents")
    return P.mix_batches(docs.where("lang = 'en'").select("doc_id"), docs.where("lang = 'de'").select("doc_id"), "doc_id", 8, 0.8, 200)


@query("replicate", "SELECT item_id, CAST(c.c AS INT) AS copy FROM benchmark, range(1, 6) c(c)")
def replicate(spark, d):
    return P.replicate(table(spark, d, "benchmark").select("item_id"), 5, 7, F.col("item_id"))


@query("lr_schedule", """SELECT s AS step, round(CASE WHEN s < 100 THEN CAST(0.0003 AS DOUBLE) * s / 100 WHEN s >= 1000 THEN CAST(0.00003 AS DOUBLE)
  ELSE CAST(0.00003 AS DOUBLE) + 0.5 * (1 + cos(pi() * ((CAST(s AS DOUBLE) - 100) / 900))) * (CAST(0.0003 AS DOUBLE) - CAST(0.00003 AS DOUBLE)) END, 12) AS lr FROM (SELECT DISTINCT event_id % 1200 AS s FROM events)""")
def lr_schedule(spark, d):
    steps = table(spark, d, "events").select((F.col("event_id") % 1200).alias("step")).distinct()
    return steps.select("step", F.round(P.learning_rate(F.col("step"), 3e-4, 3e-5, 100, 1000), 12).alias("lr"))


@query("shuffle_order", "SELECT doc_id, sha256(concat('1337|', doc_id)) AS shuffle_key FROM documents")
def shuffle_order(spark, d):
    return P.shuffled_positions(table(spark, d, "documents").select("doc_id"), F.col("doc_id"))


@query("shuffle_places", """WITH RECURSIVE size AS (SELECT count(*) AS n, CAST(floor(sqrt(count(*) - 1)) AS BIGINT) + 1 AS a FROM documents),
k AS (SELECT n, a, CAST(ceil(n / a) AS BIGINT) AS b FROM size),
num AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS number FROM documents),
walk AS (
  SELECT doc_id, number // b AS l, number % b AS r, 0 AS step, false AS done FROM num, k
  UNION ALL
  SELECT doc_id,
         CASE WHEN step % 2 = 0 THEN (l + CAST(concat('0x', substr(md5(concat('1337|', step % 4, '|', r)), 1, 15)) AS BIGINT) % a) % a ELSE l END,
         CASE WHEN step % 2 = 1 THEN (r + CAST(concat('0x', substr(md5(concat('1337|', step % 4, '|', l)), 1, 15)) AS BIGINT) % b) % b ELSE r END,
         step + 1,
         step % 4 = 3 AND l * b + (r + CAST(concat('0x', substr(md5(concat('1337|', step % 4, '|', l)), 1, 15)) AS BIGINT) % b) % b < n
  FROM walk, k WHERE NOT done AND step < 256)
SELECT doc_id, CAST(l * b + r AS BIGINT) AS place FROM walk, k WHERE done""")
def shuffle_places(spark, d):
    """The place of each document in the seeded shuffle, from its number alone."""
    docs = table(spark, d, "documents").select("doc_id")
    numbered = P.offsets(docs.withColumn("n_tokens", F.lit(1).cast("bigint")), ["doc_id"])
    return numbered.select("doc_id", H.place_of(F.col("before"), docs.count()).alias("place"))


@query("bpe_vocab")
def bpe_vocab(spark, d):
    vocab, _ = P.train_vocabulary(table(spark, d, "documents"), "text")
    return spark.createDataFrame(sorted(vocab.items(), key=lambda x: x[1]), "piece string, id int")


@query("bpe_encode")
def bpe_encode(spark, d):
    docs = table(spark, d, "documents")
    vocab, merges = P.train_vocabulary(docs, "text")
    return P.encode(docs.select("doc_id", "text"), "text", vocab, merges).select("doc_id", F.size("ids").alias("n_tokens"))


@query("bundle_blocks", """WITH n AS (SELECT 2 + octet_length(encode(trim(text, ' '))) AS n FROM documents), k AS (SELECT n, least(greatest(CAST(trunc(CAST(0.9 AS DOUBLE) * n) AS BIGINT), 1), n - 1) AS k FROM n)
SELECT 'train' AS part, CAST(sum(k) // 512 AS BIGINT) AS blocks, CAST(sum(k) // 512 * 512 AS BIGINT) AS tokens FROM k UNION ALL SELECT 'val', CAST(sum(n - k) // 512 AS BIGINT), CAST(sum(n - k) // 512 * 512 AS BIGINT) FROM k""")
def bundle_blocks(spark, d):
    """Documents to training and validation blocks, with a vocabulary of bytes alone."""
    vocab = {s: i for i, s in enumerate([*P.SPECIALS, *map(chr, range(256))])}
    parts = P.dataset_bundle(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text", vocab, [], length=512)
    rows = [b.select(F.lit(k).alias("part"), F.size("ids").alias("n")) for k, b in parts.items()]
    return rows[0].union(rows[1]).groupBy("part").agg(F.count("*").alias("blocks"), F.sum("n").alias("tokens"))


@query("cache_names", "SELECT n_nationkey, concat('corpus_', n_nationkey, '+general-v2') AS name FROM nation")
def cache_names(spark, d):
    keys = [r.n_nationkey for r in table(spark, d, "nation").select("n_nationkey").collect()]  # 25 rows
    return spark.createDataFrame([(k, P.cache_name(["data/general/", f"data/corpus_{k}"], "v2")) for k in keys], "n_nationkey int, name string")


LOGITS = "lg AS (SELECT vec_id AS sample, CAST(unnest(range(len(embedding))) AS INT) AS token, round(CAST(unnest(embedding) AS DOUBLE) * 8, 1) + 0.0 AS logit FROM embeddings)"


def _logits(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("sample"), F.posexplode("embedding").alias("token", "x"))
    return e.select("sample", "token", F.round(F.col("x").cast("double") * 8, 1).alias("logit"))


@query("topk_ties", f"WITH {LOGITS} SELECT sample, token, logit FROM (SELECT *, rank() OVER (PARTITION BY sample ORDER BY logit DESC) AS r FROM lg) WHERE r <= 5")
def topk_ties(spark, d):
    return D.top_k(_logits(spark, d), "sample", 5)


@query("nucleus_cut", f"""WITH {LOGITS}, p AS (SELECT *, exp(logit - max(logit) OVER (PARTITION BY sample)) AS e FROM lg), q AS (SELECT sample, token, e / sum(e) OVER (PARTITION BY sample) AS prob FROM p),
r AS (SELECT *, coalesce(sum(prob) OVER (PARTITION BY sample ORDER BY prob DESC, token ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM q) SELECT sample, count(*) AS n, min(token) AS first_token FROM r WHERE b <= 0.9 GROUP BY sample""")
def nucleus_cut(spark, d):
    return D.nucleus(D.softmax(_logits(spark, d), "sample"), "sample", 0.9).groupBy("sample").agg(F.count("*").alias("n"), F.min("token").alias("first_token"))


@query("repetition_penalty", f"WITH {LOGITS} SELECT sample, token, round(CASE WHEN token % 3 = 0 THEN CASE WHEN logit > 0 THEN logit / 1.2 ELSE logit * 1.2 END ELSE logit END, 6) + 0.0 AS logit FROM lg")
def repetition_penalty(spark, d):
    g = _logits(spark, d).withColumn("seen", F.when(F.col("token") % 3 == 0, F.array("token")).otherwise(F.array(F.lit(-1))))
    return D.repetition_penalty(g, "seen", 1.2).select("sample", "token", F.round("logit", 6).alias("logit"))


LAST_TWO = f"{TOKENS}, g AS (SELECT doc_id, i, id AS a, lead(id) OVER w AS b, lead(id, 2) OVER w AS c FROM (SELECT doc_id, unnest(ids) AS id, unnest(range(1, len(ids) + 1)) AS i FROM tok) WINDOW w AS (PARTITION BY doc_id ORDER BY i))"


@query("ngram_bans", f"""WITH {LAST_TWO}
SELECT t.doc_id, coalesce(array_to_string(list_sort(list(DISTINCT c) FILTER (c IS NOT NULL)), ' '), '') AS banned
FROM tok t LEFT JOIN g ON g.doc_id = t.doc_id AND len(t.ids) >= 3 AND g.a = t.ids[len(t.ids) - 1] AND g.b = t.ids[len(t.ids)] GROUP BY t.doc_id""")
def ngram_bans(spark, d):
    return tokens(spark, d).select("doc_id", F.array_join(F.transform(D.banned_tokens(F.col("ids"), 3), lambda x: x.cast("string")), " ").alias("banned"))


@query("repeated_ngram", f"""WITH {LAST_TWO}
SELECT t.doc_id, count(g.i) > 0 AS repeats
FROM tok t LEFT JOIN g ON g.doc_id = t.doc_id AND g.i < len(t.ids) - 1 AND g.a = t.ids[len(t.ids) - 1] AND g.b = t.ids[len(t.ids)] GROUP BY t.doc_id""")
def repeated_ngram(spark, d):
    return tokens(spark, d).select("doc_id", D.repeats_last(F.col("ids"), 2).alias("repeats"))


@query("decode_step")
def decode_step(spark, d):
    g = _logits(spark, d).withColumn("seen", F.array(F.lit(1), F.lit(2), F.lit(3)))
    return D.decode_step(g, "sample", "seen", temperature=0.8, penalty=1.1, ngram=3, k=20, p=0.95, seed=5)
