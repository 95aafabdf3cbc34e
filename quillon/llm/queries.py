"""The registered queries of this subpackage, each over its whole table, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import annlinks, convtrie, language, lexscan, licenses, lm, mixing, neardup, pieces, quality, substring, topk, warc
from quillon.llm.common import Shelf, remainder
from quillon.runtime import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


DOCUMENT = ["doc_id", "text", "lang", "source", "n_chars"]


@query("op1_mix_sources", mixing.mix_sql("SELECT * FROM documents", DOCUMENT))
def op1(spark, sf):
    return mixing.mix(table(spark, sf, "documents"))


@query(
    "op3_exact_topk",
    """
    WITH v AS (
      SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS w FROM embeddings
      WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    scored AS (
      SELECT q.vec_id AS query_id, d.vec_id, list_inner_product(q.w, d.w)::BIGINT AS score
      FROM v q JOIN v d ON q.vec_id <> d.vec_id WHERE q.vec_id % 50 = 0),
    ranked AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS "rank", vec_id, score FROM scored)
    SELECT * FROM ranked WHERE "rank" <= 5
    """,
)
def op3(spark, sf):
    return topk.search(table(spark, sf, "embeddings"), F.col("vec_id") % 50 == 0)


@query("op4_substring_dedup")
def op4(spark, sf):
    cleaned = substring.deduplicate(table(spark, sf, "documents"))
    return cleaned.select("doc_id", "text", "n_removed", "removed", "repeats_of")


@query(
    "op5_warc_normalise",
    """
    WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
    d AS (SELECT page_id, strlen(h) AS n, sha1(h) AS s FROM p),
    f AS (SELECT *, min(page_id) OVER (PARTITION BY s, n) AS first FROM d),
    -- base32: five hexadecimal digits are four letters
    b AS (SELECT *, list_transform(range(8), lambda i: ('0x' || substr(s, (1 + 5 * i)::INTEGER, 5))::BIGINT) AS w FROM f)
    SELECT page_id, n AS payload_bytes,
      list_aggregate(list_transform(w, lambda x: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (x // 32768 + 1)::INTEGER, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (x // 1024 % 32 + 1)::INTEGER, 1)
        || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (x // 32 % 32 + 1)::INTEGER, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (x % 32 + 1)::INTEGER, 1)), 'string_agg', '') AS payload_digest,
      CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
    FROM b
    """,
)
def op5(spark, sf):
    index = warc.archive_pages(table(spark, sf, "pages"))
    return warc.read_records(index, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op6_quality_rules")
def op6(spark, sf):
    docs = table(spark, sf, "documents").withColumn("held_out", remainder("doc_id", 4) == 2)
    model = quality.learn(docs, table(spark, sf, "labels"), ~F.col("held_out"))
    return quality.score(docs, model, ["doc_id", "held_out"]).withColumn("predicted", F.when(F.col("score") >= 0.7, 1).otherwise(0).cast("int"))


@query("op8_language_id")
def op8(spark, sf):
    docs = table(spark, sf, "documents").withColumn("held_out", remainder("doc_id", 5) == 0)
    model = language.learn(docs, ~F.col("held_out"))
    return language.identify(docs, model, ["doc_id", "held_out"])


@query(
    "op10_near_duplicates",
    r"""
    WITH RECURSIVE w AS (
      SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
    s AS (
      SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i : i + 4], ' ') END AS x
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM w WHERE len(w) > 0)),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
    c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2),
    links AS (SELECT a, b FROM c JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 75 * (na.n + nb.n - c)),
    reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
    least AS (SELECT a, min(b) AS b FROM reach GROUP BY a),
    out AS (SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(l.b, d.doc_id)) AS component_id FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN least l ON l.a = d.doc_id)
    SELECT *, doc_id = component_id AS kept FROM out
    """,
)
def op10(spark, sf):
    return neardup.near_duplicates(table(spark, sf, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


@query("op7_sentencepiece_sample")
def op7(spark, sf):
    return pieces.encode(table(spark, sf, "documents"), ["doc_id"])


@query("op9_lm_scores")
def op9(spark, sf):
    return lm.score(table(spark, sf, "documents"), remainder("doc_id", 5) == 1)


@query(
    "op2_near_vectors",
    """
    WITH RECURSIVE v AS (
      SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
      WHERE embedding IS NOT NULL AND label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
    links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
    reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
    least AS (SELECT a, min(b) AS b FROM reach GROUP BY a),
    counted AS (SELECT a, count(*) AS n FROM links GROUP BY a),
    out AS (SELECT e.vec_id, coalesce(c.n, 0) AS n_links, least(e.vec_id, coalesce(l.b, e.vec_id)) AS component_id
      FROM embeddings e LEFT JOIN counted c ON c.a = e.vec_id LEFT JOIN least l ON l.a = e.vec_id)
    SELECT *, vec_id = component_id AS kept FROM out
    """,
)
def op2(spark, sf):
    return annlinks.near_vectors(table(spark, sf, "embeddings")).select("vec_id", "n_links", "component_id", "kept")


@query(
    "op11_conversation_trie",
    """
    WITH t AS (
      SELECT conv_id AS c, turn, coalesce(role, '') AS role, coalesce("text", '') AS x FROM conversations WHERE conv_id IS NOT NULL),
    o AS (
      SELECT c, sha256(length(role) || ':' || role || x) AS k, length(x) AS size,
        row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, substr(sha256(length(role) || ':' || role || x), 1, 30)) AS i FROM t),
    -- crc32, a byte and then a bit at a time
    p AS (
      SELECT c, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda d: ord(d)::BIGINT)),
        lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda v, j: xor(v >> 1, (v & 1) * 3988292384))), 4294967295) % 6 AS h
      FROM (SELECT DISTINCT c FROM o)),
    r AS (
      SELECT p.c, o.i, o.k, o.size FROM p JOIN o ON o.c = p.c - p.c % 100 AND o.i <= p.h
      UNION ALL SELECT p.c, o.i, o.k, o.size FROM p JOIN o ON o.c = p.c AND o.i > p.h),
    s AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY i) AS d, k, size FROM r),
    m AS (
      SELECT c, d, size, string_agg(k, '/') OVER (PARTITION BY c ORDER BY d) AS path, coalesce(lag(d) OVER (PARTITION BY c ORDER BY d), 0) AS up FROM s
      UNION ALL SELECT c, 0, 0, '', NULL FROM p),
    m2 AS (SELECT m.*, u.path AS above, coalesce(n.d, 0) = m.d AS ends FROM m LEFT JOIN m u ON u.c = m.c AND u.d = m.d - 1 LEFT JOIN (SELECT c, max(d) AS d FROM s GROUP BY c) n ON n.c = m.c),
    n AS (
      SELECT d, path, min(c) AS c, any_value(above) AS above, count(*) AS n, (count(*) - 1) * any_value(size) AS saved,
        sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE ends), '')) AS e FROM m2 GROUP BY d, path),
    kids AS (SELECT above, d - 1 AS d, count(*) AS n FROM n WHERE d > 0 GROUP BY 1, 2),
    f AS (SELECT n.*, coalesce(kids.n, 0) AS kids, u.c AS parent FROM n LEFT JOIN kids ON kids.above = n.path AND kids.d = n.d LEFT JOIN n u ON u.path = n.above AND u.d = n.d - 1),
    below AS (
      SELECT m.path, m.d, sum(CASE WHEN f.kids = 0 THEN 1 ELSE 0 END) AS leaves, sum(f.saved) AS saved
      FROM f JOIN m ON m.c = f.c AND m.d <= f.d GROUP BY 1, 2)
    SELECT f.c AS conv_id, f.d AS depth, f.parent AS parent_conv_id, f.n AS n_convs, f.kids AS n_children, below.leaves::BIGINT AS n_leaves, below.saved::BIGINT AS saved_tokens, f.e AS ends_sha256
    FROM f JOIN below ON below.path = f.path AND below.d = f.d
    """,
)
def op11(spark, sf):
    shelf = Shelf(spark)
    placed = convtrie.number_turns(table(spark, sf, "conversations"), shelf)
    return convtrie.prefix_trie(*convtrie.with_shared_heads(placed, shelf), shelf)


@query(
    "op12_lexical_search",
    r"""
    WITH d AS (
      SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce("text", ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
    s AS (SELECT count(*) AS n, sum(len(w))::BIGINT AS l FROM d WHERE len(w) > 0),
    q AS (
      SELECT item_id, t, count(*) AS repeats FROM (
        SELECT item_id, unnest(regexp_extract_all(translate(coalesce("text", ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark)
      GROUP BY 1, 2),
    tf AS (SELECT r, doc_id, n, t, count(*) AS tf FROM (SELECT r, doc_id, len(w) AS n, unnest(w) AS t FROM d) SEMI JOIN q USING (t) GROUP BY 1, 2, 3, 4),
    wt AS (SELECT t, floor(1000 * ln((2 * s.n + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tf, s GROUP BY t, s.n),
    sc AS (
      SELECT item_id, r, doc_id, sum(repeats * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * tf.n * s.n) // s.l))))::BIGINT AS score
      FROM tf JOIN wt USING (t) JOIN q USING (t), s GROUP BY 1, 2, 3),
    k AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS "rank", doc_id, score FROM sc WHERE score > 0)
    SELECT * FROM k WHERE "rank" <= 10
    """,
)
def op12(spark, sf):
    return lexscan.search(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query("op13_license_scan", licenses.scan_sql())
def op13(spark, sf):
    return licenses.scan(table(spark, sf, "documents"))
