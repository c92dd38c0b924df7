"""The operators as registered queries: production parameters, whole tables, digests of real outputs."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnlake.llm import byte_bpe, chat_format, chunk_dedup, collision_search, divergence, jaccard_join, packing, paragraph_sketch, personal_data, quality_cnn, substring_dedup, warc_zip, whitening
from churnlake.llm.common import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(key: str, sql: str | None = None):
    def keep(fn):
        QUERIES[key] = fn
        if sql is not None:
            ORACLES[key] = sql
        return fn

    return keep


@register("op1_byte_bpe")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    file = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    coded = byte_bpe.encode(read_table(spark, sf_dir, "documents"), file, decoded=True)
    return coded.select(
        "doc_id", F.expr("cast(length(ids) div 4 as long)").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


_CONTROLS = ", ".join(f"'{c}'" for c in chat_format.CONTROL)
OP2_SQL = rf"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, i, CASE i WHEN 0 THEN 'user' ELSE 'assistant' END, '</s>[INST] ok [/INST]' FROM range(2) r(i)),
c AS (SELECT *, len(regexp_extract_all(text, '[^\x20\x09-\x0D]{{1,4}}')) + 4 AS tok,
             len('<|im_start|><|im_sep|><|im_end|>') + len(role || text) + len(role || text) - len(replace(role || text, '\', ''))
             + list_sum([(len(role) - len(replace(role, k, ''))) // len(k) + (len(text) - len(replace(text, k, ''))) // len(k) FOR k IN [{_CONTROLS}]]) AS chars,
             row_number() OVER w AS pos, count(*) OVER (PARTITION BY conv_id) AS n
      FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
s AS (SELECT conv_id, tok, chars FROM c WHERE pos = 1 AND role = 'system' AND n > 1),
r AS (SELECT c.*, coalesce(s.tok, 0) AS sys, coalesce(s.chars, 0) AS sys_chars,
             sum(c.tok) OVER w - c.tok AS before, sum((c.tok > 512)::INT) OVER w - (c.tok > 512)::INT AS longs
      FROM c LEFT JOIN s USING (conv_id) WHERE NOT (pos = 1 AND s.conv_id IS NOT NULL)
      WINDOW w AS (PARTITION BY conv_id ORDER BY pos)),
k AS (SELECT *, before // greatest(2048 - 256 - 512 - sys, 512) AS part, 2 * longs + (tok > 512)::INT AS run FROM r),
spans AS (SELECT conv_id, part, run, min(pos) AS first_pos, min(before) AS start, any_value(sys_chars) AS sys_chars FROM k GROUP BY conv_id, part, run),
old AS (SELECT k.conv_id, sum(k.chars) AS chars FROM k JOIN spans p ON p.conv_id = k.conv_id AND p.first_pos BETWEEN k.pos + 1 AND k.pos + 2 AND k.before >= p.start - 256 GROUP BY k.conv_id),
lead AS (SELECT conv_id, sum(sys_chars) AS chars FROM spans GROUP BY conv_id),
new AS (SELECT conv_id, sum(chars) AS chars FROM k GROUP BY conv_id),
l AS (SELECT conv_id, string_agg(text, '' ORDER BY pos) AS loss FROM c WHERE role = 'assistant' GROUP BY conv_id)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
       len(coalesce(any_value(loss), ''))::BIGINT AS loss_chars, sha256(coalesce(any_value(loss), '')) AS loss_sha256,
       (coalesce(any_value(new.chars), 0) + coalesce(any_value(old.chars), 0) + coalesce(any_value(lead.chars), 0))::BIGINT AS formatted_chars
FROM c LEFT JOIN l USING (conv_id) LEFT JOIN new USING (conv_id) LEFT JOIN old USING (conv_id) LEFT JOIN lead USING (conv_id) GROUP BY conv_id
"""


@register("op2_chat_windows", OP2_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.sql("SELECT -7L AS conv_id, id AS turn, if(id = 0, 'user', 'assistant') AS role, '</s>[INST] ok [/INST]' AS text FROM range(2)")
    talks = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    return chat_format.digests(chat_format.windows(talks))


OP3_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, strlen(coalesce(html, ''))::BIGINT AS b FROM pages),
g AS (SELECT h, min(page_id) AS r FROM p WHERE b >= 100 GROUP BY h)
SELECT page_id, b AS payload_bytes, sha256(p.h) AS payload_digest, CASE WHEN r <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN r <> page_id THEN r END AS refers_to
FROM p LEFT JOIN g USING (h)
"""


@register("op3_warc_zip", OP3_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = warc_zip.round_trip(read_table(spark, sf_dir, "pages"), with_payload=False)
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP4_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)])
                             WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM d),
grams AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
links AS (SELECT a.doc_id AS x, b.doc_id AS y FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id
          GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.y FROM reach r JOIN links l ON r.b = l.x)
SELECT a AS doc_id, any_value(len(s))::BIGINT AS n_shingles, min(b) AS component_id FROM reach JOIN sets ON sets.doc_id = a GROUP BY a
"""


@register("op4_jaccard_join", OP4_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(read_table(spark, sf_dir, "documents"), k=5, share=(80, 100))


@register("op5_paragraph_sketch")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraph_sketch.compare_with_edit(read_table(spark, sf_dir, "documents"))


@register("op6_best_fit_packing")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


OP7_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d),
win AS (SELECT doc_id, i, w[i:i + 12] AS k FROM p),
first_doc AS (SELECT k, min(doc_id) AS m FROM win GROUP BY k),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM win JOIN first_doc USING (k) WHERE m < doc_id),
single AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
kept AS (SELECT s.doc_id, count(g.i) AS n_removed, coalesce(string_agg(CASE WHEN g.i IS NULL THEN s.word END, ' ' ORDER BY s.i), '') AS kept
         FROM single s LEFT JOIN gone g ON g.doc_id = s.doc_id AND g.i = s.i GROUP BY s.doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""


@register("op7_substring_dedup", OP7_SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.remove_passages(read_table(spark, sf_dir, "documents"), k=13)
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP8_SQL = """
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256,
                  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (t)
"""


@register("op8_chunk_dedup", OP8_SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_dedup.exact_dedup(read_table(spark, sf_dir, "documents"))


@register("op10_personal_data")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data.detect(read_table(spark, sf_dir, "documents"))

    def count(kind: int):
        return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{personal_data.KINDS[kind]}")

    return found.select("doc_id", *map(count, range(4)), F.sha2(personal_data.listed("base"), 256).alias("base_sha256"), personal_data.listed("spans").alias("spans"))


@register("op9_quality_cnn")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_cnn.classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


@register("op11_embedding_whitening")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read_table(spark, sf_dir, "embeddings"), components=16)


OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
t AS (SELECT i, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d),
k AS (SELECT lang, term, count(*)::HUGEINT AS all_c FROM t GROUP BY lang, term HAVING count(DISTINCT i) >= 3),
l AS (SELECT x.lang, count(term) AS v, coalesce(sum(all_c), 0) AS all_n FROM (SELECT DISTINCT lang FROM d) x LEFT JOIN k USING (lang) GROUP BY x.lang),
c AS (SELECT t.lang, t.source, t.term, any_value(all_c) AS all_c, count(*)::HUGEINT AS c FROM t JOIN k ON k.lang = t.lang AND k.term = t.term GROUP BY t.lang, t.source, t.term),
g AS (SELECT x.lang, x.source, any_value(v) AS v, any_value(all_n) AS all_n, coalesce(any_value(n), 0) AS n FROM (SELECT DISTINCT lang, source FROM d) x JOIN l USING (lang)
      LEFT JOIN (SELECT lang, source, sum(c) AS n FROM c GROUP BY lang, source) s ON s.lang = x.lang AND s.source = x.source GROUP BY x.lang, x.source),
p AS (SELECT g.lang, g.source, k.term, 1 + 1000000000 * (coalesce(c.c, 0) + 1) // (n + v) AS p
      FROM g JOIN k ON k.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
s AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
      FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
o AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
      LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
u AS (SELECT c.lang, c.source, term, 1 + 1000000000 * (c + 1) // (n + v) AS p, 1 + 1000000000 * (c.all_c + 1) // (all_n + v) AS q FROM c JOIN g ON g.lang = c.lang AND g.source = c.source),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
      FROM (FROM o UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM u WHERE p > q))
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM r WHERE part = 'pair' OR rank <= 200
"""


@register("op12_source_divergence", OP12_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(read_table(spark, sf_dir, "documents"))


@register("op13_collision_search")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collision_search.nearest(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)
