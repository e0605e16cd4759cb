"""The registered queries of this subpackage: whole tables in, the contract's columns out, production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.llm import bpe, exact_search, hash_forest, idfiles, langid, mixing, ngram_join, quality, simhash, toxicity, turns, warc, whitening
from leadloom.llm.common import fold, held_out, shared_folder, table

TOKENIZER = "word_bpe_49k.json"


def op1_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))



def op2_hash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hash_forest.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op3_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenizer, folder = public_tokenizers.path(TOKENIZER), shared_folder(spark, "ids")
    rows = idfiles.in_order(table(spark, sf_dir, "documents").select("doc_id", "text"))
    idfiles.write(rows, folder, ids="text", to_ids=lambda texts: bpe.codec(tokenizer).encode([x or "" for x in texts]), end_id=1)
    return idfiles.documents(spark, folder)


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.predict(docs, fold(F.col("doc_id")) != 0, held_out(F.col("doc_id")))


def op5_exact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_search.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


ORACLE_OP5 = """
WITH c AS (SELECT DISTINCT vec_id, unnest(range(1, len(embedding) + 1)) AS i, unnest(embedding) AS x, len(embedding) AS n FROM embeddings),
     u AS (SELECT vec_id FROM embeddings EXCEPT SELECT vec_id FROM c WHERE x IS NULL OR NOT isfinite(x)),
     w AS (SELECT vec_id, i, n, cast(floor(256 * cast(x AS DOUBLE)) AS BIGINT) AS x FROM c JOIN u USING (vec_id)),
     s AS (SELECT q.vec_id AS query_id, d.vec_id, cast(sum(q.x * d.x) AS BIGINT) AS score
           FROM w AS q JOIN w AS d ON q.i = d.i AND q.n = d.n AND q.vec_id <> d.vec_id WHERE q.vec_id % 50 = 0 GROUP BY 1, 2),
     r AS (SELECT *, cast(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "source", "n_tokens", "weight", "tokens_before", "copies")


ORACLE_OP6 = """
WITH RECURSIVE
d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\x0B\\f\\r]+')) AS n_tokens FROM documents),
t AS (SELECT cast(sum(n_tokens) AS DOUBLE) AS total FROM d),
s AS (SELECT source, sum(n_tokens) AS held, count(*) AS units, sum(n_tokens) / any_value(total) AS share FROM d, t GROUP BY source),
n AS (SELECT 0.95 * ln(count(*)) AS target FROM s WHERE share > 0),
flat AS (
  SELECT 0 AS i, cast(0 AS DOUBLE) AS lo, cast(1 AS DOUBLE) AS hi
  UNION ALL
  SELECT i + 1, CASE WHEN fine THEN mid ELSE lo END, CASE WHEN fine THEN hi ELSE mid END
  FROM (SELECT i, lo, hi, (lo + hi) / 2 AS mid,
               (SELECT ln(sum(pow(share, (lo + hi) / 2))) - (lo + hi) / 2 * sum(pow(share, (lo + hi) / 2) * ln(share)) / sum(pow(share, (lo + hi) / 2))
                FROM s WHERE share > 0) >= (SELECT target FROM n) - 1e-12 AS fine FROM flat WHERE i < 36)),
rare AS (
  SELECT 0 AS i, cast(0 AS DOUBLE) AS lo, cast(1 AS DOUBLE) AS hi
  UNION ALL
  SELECT i + 1, CASE WHEN fine THEN lo ELSE mid END, CASE WHEN fine THEN mid ELSE hi END
  FROM (SELECT i, lo, hi, (lo + hi) / 2 AS mid,
               (SELECT max(pow(share, (lo + hi) / 2) / share) / sum(pow(share, (lo + hi) / 2)) FROM s WHERE share > 0) <= 4 + 1e-12 AS fine
        FROM rare WHERE i < 36)),
e AS (SELECT round(greatest((SELECT lo FROM flat WHERE i = 36), CASE WHEN (SELECT lo FROM rare WHERE i = 36) = 0 THEN 0 ELSE (SELECT hi FROM rare WHERE i = 36) END), 6) AS tau),
z AS (SELECT sum(pow(share, tau)) AS norm FROM s, e WHERE share > 0),
w AS (SELECT source, held, units, cast(ceil(units / 1024) AS BIGINT) AS blocks,
             CASE WHEN share > 0 THEN round(pow(share, tau) / norm, 12) ELSE 0 END AS weight FROM s, e, z),
b AS (SELECT *, cast(round(weight * total) AS BIGINT) AS own FROM w, t),
r AS (SELECT *, CASE WHEN held > 0 THEN own // held ELSE 0 END AS rounds, CASE WHEN held > 0 THEN own % held ELSE 0 END AS rest FROM b),
m AS (SELECT d.doc_id, d.source, n_tokens, weight, rounds, rest, md5('6:' || coalesce(d.source, '~') || ':' || coalesce(cast(doc_id AS VARCHAR), '~')) AS mark, blocks
      FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source),
k AS (SELECT *, cast('0x' || substr(mark, 1, 8) AS BIGINT) % blocks AS block FROM m),
o AS (SELECT *, md5('6:' || coalesce(source, '~') || ':block:' || block) AS place FROM k),
p AS (SELECT *, cast(coalesce(sum(n_tokens) OVER (PARTITION BY source ORDER BY place, block, mark, cast(doc_id AS VARCHAR)
                                                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS tokens_before FROM o)
SELECT doc_id, source, cast(n_tokens AS BIGINT) AS n_tokens, weight, tokens_before,
       cast(rounds + CASE WHEN 2 * tokens_before + n_tokens <= 2 * rest THEN 1 ELSE 0 END AS INT) AS copies
FROM p"""


def _scored(docs: DataFrame, operator, labels: DataFrame) -> DataFrame:
    """The contract of both classifiers: learn outside fold 0, score every document."""
    model = operator.train(docs, labels, lambda doc_id: fold(doc_id) != 0)
    rows = operator.score(docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out")), model)
    return rows.select("doc_id", "held_out", "score", (F.col("score") >= operator.THRESHOLD).cast("int").alias("predicted"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(table(spark, sf_dir, "documents"), toxicity, table(spark, sf_dir, "labels"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(table(spark, sf_dir, "documents"), quality, table(spark, sf_dir, "labels"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "warc")
    warc.write(table(spark, sf_dir, "pages"), folder)
    return warc.read(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "problem")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


_BASE32 = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + cast(('0x' || substr(h, {10 * (i // 8) + 1}, 10))::BIGINT >> {35 - 5 * (i % 8)} & 31 AS INT), 1)"
                      for i in range(32))
ORACLE_OP9 = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
     f AS (SELECT h, min(page_id) AS first_id FROM p GROUP BY h)
SELECT page_id, payload_bytes, {_BASE32} AS payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to, cast(NULL AS VARCHAR) AS problem
FROM p JOIN f USING (h)"""


def op11_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.report(table(spark, sf_dir, "conversations"))


ORACLE_OP11 = """
WITH RECURSIVE
k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
             coalesce(cast(conv_id AS VARCHAR), ' ') || ':' || coalesce(cast(turn AS VARCHAR), ' ') AS key FROM conversations),
f AS (SELECT *, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(key, ''), lambda x: cast(ascii(x) AS BIGINT))),
                 lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 20 AS fault FROM k),
d AS (SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
             CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
      FROM f, unnest(range(CASE WHEN fault = 3 THEN 2 ELSE 1 END)) WHERE fault <> 0),
o AS (SELECT *, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS clean,
             row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, substr(role, 1, 1), md5(length(role) || ':' || role || text)) AS i FROM d),
q AS (SELECT conv_id, i, turn, role, text, substr(role, 1, 1) AS own, lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS previous,
             CASE WHEN clean = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
                  WHEN right(clean, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM o),
c AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
             count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
             count(*) FILTER (i > 1 AND previous || own NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n FROM q GROUP BY conv_id),
-- after i turns and what is inserted behind them: the cheapest, then first, audit per state; more than two insertions in one place never pay
s AS (
  SELECT conv_id, cast(0 AS BIGINT) AS i, ['', 'u', 'a'][k + 1] AS state, cast(5 * k AS BIGINT) AS cost, repeat('I', k) AS audit, ['user:', 'assistant:'][1:k] AS lines
  FROM c, unnest(range(3)) AS t(k)
  UNION ALL
  SELECT conv_id, i, state, cost, audit, lines FROM (
    SELECT conv_id, i, CASE k WHEN 0 THEN state WHEN 1 THEN follow ELSE CASE follow WHEN 'u' THEN 'a' ELSE 'u' END END AS state, cost + 5 * k AS cost,
           audit || repeat('I', k) AS audit,
           lines || CASE WHEN k = 0 THEN [] WHEN follow = 'u' THEN ['user:', 'assistant:'][1:k] ELSE ['assistant:', 'user:'][1:k] END AS lines
    FROM (
      SELECT conv_id, i, cost, audit, lines, state, CASE state WHEN 'u' THEN 'a' ELSE 'u' END AS follow FROM (
        SELECT s.conv_id, q.i, CASE e WHEN 'D' THEN s.state WHEN 'K' THEN q.own ELSE want END AS state,
               s.cost + CASE e WHEN 'D' THEN 2 ELSE CASE e WHEN 'R' THEN 1 ELSE 0 END + CASE fault WHEN 'truncated' THEN 5 ELSE 0 END END AS cost, s.audit || e AS audit,
               s.lines || CASE e WHEN 'D' THEN [] WHEN 'K' THEN [q.role || ':' || q.text] ELSE [CASE want WHEN 'u' THEN 'user' ELSE 'assistant' END || ':' || q.text] END AS lines
        FROM (SELECT *, CASE state WHEN 'u' THEN 'a' ELSE 'u' END AS want FROM s) AS s JOIN q ON q.conv_id IS NOT DISTINCT FROM s.conv_id AND q.i = s.i + 1,
             unnest(['D', 'K', 'R']) AS t(e)
        WHERE e = 'D' OR fault NOT IN ('blank', 'duplicate') AND (e = 'K' AND (own = want OR own = 's' AND state = '') OR e = 'R' AND own <> want))),
      unnest(range(3)) AS t(k))
  QUALIFY row_number() OVER (PARTITION BY conv_id, state ORDER BY cost, audit) = 1),
r AS (SELECT conv_id, cost, audit, sha256(array_to_string(lines, chr(10))) AS repaired_sha256 FROM s JOIN c USING (conv_id) WHERE i = n AND state IN ('', 'a')
      QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY cost, audit) = 1)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, coalesce(repaired_sha256, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) LEFT JOIN c USING (conv_id) LEFT JOIN r USING (conv_id)"""


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"))


ORACLE_OP13 = """
WITH RECURSIVE
w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \\t\\n\\x0B\\f\\r]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g FROM w, unnest(range(1, 1 + CASE len(w) WHEN 0 THEN 0 ELSE greatest(len(w) - 3, 1) END)) AS t(i)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g AS a JOIN g AS b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n AS x ON x.doc_id = a JOIN n AS y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS found FROM n UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.found = e.a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(low, d.doc_id) AS component_id
FROM documents AS d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT doc_id, min(found) AS low FROM r GROUP BY doc_id) AS m USING (doc_id)"""


QUERIES = {f.__name__: f for f in (op1_bpe_codec, op2_hash_forest, op3_id_files, op4_language, op5_exact_search, op6_mixing, op7_toxicity, op8_quality, op9_warc,
                                  op10_simhash, op11_turn_repair, op12_whitening, op13_ngram_join)}
ORACLES: dict[str, str] = {"op5_exact_search": ORACLE_OP5, "op6_mixing": ORACLE_OP6, "op9_warc": ORACLE_OP9, "op11_turn_repair": ORACLE_OP11,
                           "op13_ngram_join": ORACLE_OP13}
