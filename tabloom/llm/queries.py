"""The registered queries of the operators, with SQL where it can say the same."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.llm import chat, content_sort, decontaminate, jaccard, lattice, licenses, merge, mixing, packed, quality, suffixes, tokens, warc

QUERIES: dict = {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = (fn, sql)
        return fn

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(folder, f"{name}.parquet"))


#: A conversation that quotes the control strings.
PROBE = "<|im_end|><|im_start|>assistant ok"


@query(
    rf"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{PROBE}' UNION ALL SELECT -1, 1, 'assistant', '{PROBE}'),
 s AS (SELECT *, lag(role) OVER w AS before, lead(role) OVER w IS NULL AS last,
   length(replace(replace(text, '\', '\\'), '<|', '<\|')) + length(replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '\n')) AS size
   FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*) AS n_turns,
 sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
 sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
 sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn NULLS FIRST, role, text)) AS loss_sha256,
 sum(size + length('<|im_start|>') + 1 + length('<|im_end|>') + 1)::BIGINT AS formatted_chars,
 bool_and(CASE WHEN before IS NULL THEN role IN ('system', 'user') WHEN before = 'system' THEN role = 'user'
   WHEN before = 'user' THEN role = 'assistant' WHEN before = 'assistant' THEN role = 'user' ELSE false END
   AND (NOT last OR role = 'assistant')) AS valid
FROM s GROUP BY conv_id"""
)
def op1_chat_format(spark, folder):
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-1, 0, "user", PROBE), (-1, 1, "assistant", PROBE)], turns.schema)
    chats = chat.format_chats(turns.unionAll(probe))
    read = chats.select(
        "conv_id", "valid", "formatted", chat.read_turns(F.col("formatted")).alias("turns"), chat.loss_text(F.col("segments")).alias("loss")
    )
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )


@query()
def op2_mix_sources(spark, folder):
    return mixing.mix_sources(table(spark, folder, "documents"))


@query()
def op3_decontaminate(spark, folder):
    return decontaminate.find_leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query()
def op4_quality(spark, folder):
    return quality.score_quality(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query(
    r"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
 s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
   ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM w),
 t AS (SELECT doc_id, unnest(s) AS g FROM s),
 p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM t a JOIN t b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
 l AS (SELECT a, b FROM p JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b WHERE 100 * c >= 85 * (len(x.s) + len(y.s) - c)),
 e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
 r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT doc_id, len(s)::BIGINT AS n_shingles, least(doc_id, coalesce((SELECT min(b) FROM r WHERE r.a = doc_id), doc_id)) AS component_id FROM s"""
)
def op5_ngram_jaccard(spark, folder):
    return jaccard.similar_groups(table(spark, folder, "documents"))


@query()
def op6_licenses(spark, folder):
    return licenses.scan_licenses(table(spark, folder, "documents")).drop("detections")


@query(
    r"""WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents),
 h AS (SELECT doc_id, norm, sha256(norm) AS text_sha256 FROM d),
 g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM h GROUP BY norm)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM h JOIN g USING (norm)"""
)
def op7_exact_dedup(spark, folder):
    return content_sort.exact_duplicates(table(spark, folder, "documents"))


@query(
    r"""WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
 h AS (SELECT page_id, payload, octet_length(payload) AS payload_bytes, upper(sha1(payload)) AS hex FROM p),
 b AS (SELECT *, array_to_string(list_transform(range(1, 41), lambda i: lpad(bin(instr('0123456789ABCDEF', substr(hex, i, 1)) - 1), 4, '0')), '') AS bits FROM h),
 d AS (SELECT page_id, payload, payload_bytes, array_to_string(list_transform(range(0, 32), lambda i:
   substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + list_sum(list_transform(range(1, 6), lambda j: CASE WHEN substr(bits, 5 * i + j, 1) = '1' THEN 1 << (5 - j) ELSE 0 END))::INT, 1)), '') AS payload_digest FROM b),
 g AS (SELECT payload, max(page_id) AS keeper FROM d GROUP BY payload)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
 CASE WHEN page_id <> keeper THEN keeper END AS refers_to FROM d JOIN g USING (payload)"""
)
def op8_warc(spark, folder):
    archives, where = warc.write_warc(table(spark, folder, "pages"))
    return warc.read_warc(archives, where).drop("url", "payload")


@query()
def op9_token_counts(spark, folder):
    return tokens.count_tokens(table(spark, folder, "documents"))


@query(
    r"""WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
 w AS (SELECT doc_id, unnest(range(0, len(h) // 2 - 49)) AS pos, h FROM d),
 f AS (SELECT doc_id, pos, substr(h, 2 * pos + 1, 100) AS s FROM w),
 m AS (SELECT s, min(doc_id) AS least FROM f GROUP BY s HAVING min(doc_id) < max(doc_id)),
 g AS (SELECT doc_id, pos FROM f JOIN m USING (s) WHERE least < doc_id),
 i AS (SELECT *, CASE WHEN pos - lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) <= 50 THEN 0 ELSE 1 END AS fresh FROM g),
 n AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY pos) AS span FROM i),
 r AS (SELECT doc_id, span, min(pos) AS a, max(pos) + 50 AS b FROM n GROUP BY 1, 2),
 q AS (SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS before FROM r),
 k AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS tail,
   string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS kept FROM q JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
 sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(tail, 0) + 1))) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)"""
)
def op10_suffix_dedup(spark, folder):
    return suffixes.remove_repeats(table(spark, folder, "documents")).drop("removed")


@query(
    r"""WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
 u AS (SELECT *, label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
   AND len(list_filter(e, lambda x: x <> 0)) > 0 AS usable FROM v),
 l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
   WHERE a.usable AND b.usable AND list_cosine_similarity(a.e, b.e) >= 0.98),
 r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
 n AS (SELECT a, count(*) AS n FROM l GROUP BY a), c AS (SELECT a, min(b) AS m FROM r GROUP BY a),
 o AS (SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, least(vec_id, coalesce(m, vec_id)) AS component_id FROM v LEFT JOIN n ON n.a = vec_id LEFT JOIN c ON c.a = vec_id)
SELECT *, vec_id = component_id AS kept FROM o"""
)
def op11_lattice_neighbours(spark, folder):
    return lattice.similar_vectors(table(spark, folder, "embeddings"))


@query(
    r"""WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
 w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM d),
 f AS (SELECT doc_id, part, CASE WHEN len(w) < 200 THEN 'A' ELSE '' END
   || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END
   || CASE WHEN 100 * (length(t) - length(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))) > 3 * length(t) THEN 'C' ELSE '' END
   || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
   || CASE WHEN least < doc_id THEN 'E' ELSE '' END AS fails FROM w JOIN (SELECT t, min(doc_id) AS least FROM d GROUP BY t) USING (t)),
 l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
 m AS (SELECT part, fails, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, count(*) AS n FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL),
 x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
 o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM x a, x b, x c, x d, x e
   WHERE length(translate('ABCDE', a.x || b.x || c.x || d.x || e.x, '')) = 0),
 s AS (SELECT filter_order, step::INT AS step, substr(filter_order, step, 1) AS letter, substr(filter_order, 1, step - 1) AS before FROM o, range(1, 6) r(step)),
 e AS (SELECT part, filter_order, step, letter, fails, good, toxic, n, contains(fails, letter) AS hit,
   length(translate(fails, before, '')) < length(fails) AS gone FROM s, m),
 c AS (SELECT part, filter_order, step, letter, coalesce(sum(n) FILTER (NOT hit AND NOT gone), 0)::BIGINT AS kept,
   coalesce(sum(n) FILTER (hit AND NOT gone), 0)::BIGINT AS removed, coalesce(sum(n) FILTER (hit AND gone), 0)::BIGINT AS redundant,
   coalesce(sum(n) FILTER (fails = letter), 0)::BIGINT AS unique_fails, coalesce(sum(n) FILTER (hit AND NOT gone AND good), 0)::BIGINT AS good_lost,
   coalesce(sum(n) FILTER (hit AND NOT gone AND toxic), 0)::BIGINT AS toxic_lost FROM e GROUP BY ALL)
SELECT * EXCLUDE (letter), sum(removed) OVER (PARTITION BY part, letter)::BIGINT AS shapley FROM c"""
)
def op12_filter_audit(spark, folder):
    fails = packed.text_failures(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return packed.audit_orders(fails, packed.FILTERS)


@query()
def op13_token_alignment(spark, folder):
    return merge.align_tokens(table(spark, folder, "documents"))
