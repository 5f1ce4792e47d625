"""The registered queries of this subpackage: thin calls of its operators with production parameters."""

from __future__ import annotations

import importlib.util
import os
import secrets

from .base import read

# Fixed value: the pattern that the rank files of the public vocabularies go with.
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def tokenizer_path(name: str) -> str:
    """Place of a public vocabulary file: $TOKENIZER_DIR, or the installed package of vocabularies."""
    if folder := os.environ.get("TOKENIZER_DIR"):
        return f"{folder}/{name}"
    spec = importlib.util.find_spec("public_tokenizers")
    if spec is None:
        return f"/opt/tokenizers/{name}"
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_bpe(spark, sf_dir):
    from . import bpe

    return bpe.digests(read(spark, sf_dir), tokenizer_path("word_bpe_49k.json"))


def op2_toxicity(spark, sf_dir):
    from . import toxicity

    return toxicity.classify(read(spark, sf_dir), read(spark, sf_dir, "labels"))


def op3_suffix_dedup(spark, sf_dir):
    from . import suffix_dedup

    return suffix_dedup.dedup(read(spark, sf_dir))


def op4_pii(spark, sf_dir):
    from . import pii

    key = spark.conf.get("spark.tidemark.pii.key", None)
    if not key:  # nobody has chosen one: a random one for this session, so what it makes can't be undone afterwards
        spark.conf.set("spark.tidemark.pii.key", key := secrets.token_hex(32))
    return pii.pseudonymise(read(spark, sf_dir), key)


def op5_phrase_dedup(spark, sf_dir):
    from . import phrase_dedup

    return phrase_dedup.dedup(read(spark, sf_dir))


def op6_exact_dedup(spark, sf_dir):
    from . import exact_dedup

    return exact_dedup.classes(read(spark, sf_dir), keep="most")


def op7_mixing(spark, sf_dir):
    from . import mixing

    return mixing.taken_by_document(read(spark, sf_dir))


def op8_jaccard_join(spark, sf_dir):
    from . import jaccard

    return jaccard.classes(read(spark, sf_dir))


def op9_token_counts(spark, sf_dir):
    from . import token_counts

    return token_counts.counts(read(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"), limit=1024)


def op10_media(spark, sf_dir):
    from . import media

    return media.digests(media.store(read(spark, sf_dir)))


def op11_hard_negatives(spark, sf_dir):
    from . import hard_negatives

    return hard_negatives.mine(read(spark, sf_dir, "embeddings"))


def op12_filter_audit(spark, sf_dir):
    from . import filter_audit

    return filter_audit.audit(filter_audit.counted(filter_audit.flagged(read(spark, sf_dir), read(spark, sf_dir, "labels"))))


def op13_byte_bpe(spark, sf_dir):
    from . import byte_bpe

    return byte_bpe.digests(read(spark, sf_dir), tokenizer_path("byte_bpe_multi_50k.tiktoken"), BYTE_LEVEL_PATTERN)


QUERIES = {
    f.__name__: f
    for f in (
        op1_bpe, op2_toxicity, op3_suffix_dedup, op4_pii, op5_phrase_dedup, op6_exact_dedup, op7_mixing, op8_jaccard_join, op9_token_counts, op10_media,
        op11_hard_negatives, op12_filter_audit, op13_byte_bpe,
    )
}

ORACLES = {
    "op3_suffix_dedup": """
        WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
        p AS (SELECT doc_id, h, len(h) // 2 AS n, unnest(range(1, len(h) // 2 + 1)) AS i FROM d),
        x AS (SELECT doc_id, i, substr(h, 2 * i - 1, 2) AS byte, CASE WHEN i + 49 <= n THEN substr(h, 2 * i - 1, 100) END AS win FROM p),
        f AS (SELECT doc_id, i, byte, CASE WHEN win IS NOT NULL AND min(doc_id) OVER (PARTITION BY win) < doc_id THEN 1 ELSE 0 END AS dup FROM x),
        r AS (SELECT doc_id, i, byte, max(dup) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone FROM f),
        s AS (SELECT *, CASE WHEN gone = 1 AND coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), 0) = 0 THEN 1 ELSE 0 END AS rise FROM r),
        g AS (SELECT doc_id, CAST(sum(gone) AS BIGINT) AS n_removed, CAST(sum(rise) AS BIGINT) AS n_spans, string_agg(byte, '' ORDER BY i) FILTER (WHERE gone = 0) AS kept FROM s GROUP BY doc_id)
        SELECT d.doc_id, len(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
        FROM d LEFT JOIN g USING (doc_id)
    """,
    "op5_phrase_dedup": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        p AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d),
        x AS (SELECT doc_id, i, w[i] AS word, CASE WHEN i + 19 <= len(w) THEN array_to_string(w[i:i + 19], ' ') END AS win FROM p),
        f AS (SELECT doc_id, i, word, CASE WHEN win IS NOT NULL AND row_number() OVER (PARTITION BY win ORDER BY doc_id, i) > 1 THEN 1 ELSE 0 END AS dup FROM x),
        r AS (SELECT doc_id, i, word, max(dup) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone FROM f),
        g AS (SELECT doc_id, CAST(sum(gone) AS BIGINT) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE gone = 0) AS kept FROM r GROUP BY doc_id)
        SELECT d.doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN g USING (doc_id)
    """,
    "op8_jaccard_join": r"""
        WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        n AS (SELECT array_to_string(w, ' ') AS t, min(doc_id) AS doc, count(*) AS copies, any_value(w) AS w FROM d WHERE len(w) > 0 GROUP BY 1),
        s AS (SELECT DISTINCT doc, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM n) AS z),
        c AS (SELECT doc, count(*) AS size FROM s GROUP BY doc),
        b AS (SELECT x.doc AS a, y.doc AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc <> y.doc GROUP BY 1, 2),
        e AS (SELECT a, b FROM b JOIN c p ON p.doc = a JOIN c q ON q.doc = b WHERE k >= 0.8 * (p.size + q.size - k)),
        r AS (SELECT doc AS origin, doc AS node FROM n UNION SELECT origin, e.b FROM r JOIN e ON e.a = r.node),
        m AS (SELECT origin AS doc, min(node) AS class_id FROM r GROUP BY origin),
        l AS (SELECT e.a AS doc, CAST(sum(n.copies) AS BIGINT) AS links FROM e JOIN n ON n.doc = e.b GROUP BY e.a)
        SELECT d.doc_id, coalesce(m.class_id, d.doc_id) AS class_id, CASE WHEN n.doc IS NULL THEN 0 ELSE coalesce(l.links, 0) + n.copies - 1 END AS n_links, coalesce(n.copies, 1) AS copies
        FROM d LEFT JOIN n ON n.t = array_to_string(d.w, ' ') AND len(d.w) > 0 LEFT JOIN m ON m.doc = n.doc LEFT JOIN l ON l.doc = n.doc
    """,
    "op11_hard_negatives": """
        WITH e AS (
            SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
            FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
        p AS (
            SELECT a.r, a.vec_id AS anchor_id, a.label, a.v, b.r AS q, b.vec_id AS positive_id, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS positive_score
            FROM e a JOIN e b ON a.vec_id % 50 = 0 AND a.label = b.label AND a.r <> b.r
            QUALIFY row_number() OVER (PARTITION BY a.r ORDER BY positive_score DESC, b.vec_id NULLS LAST) <= 5),
        n AS (
            SELECT p.r, q, anchor_id, positive_id, positive_score, e.vec_id AS negative_id, CAST(list_dot_product(p.v, e.v) AS BIGINT) AS negative_score FROM p JOIN e ON p.label <> e.label),
        x AS (
            SELECT *, row_number() OVER (PARTITION BY r, q ORDER BY negative_score DESC, negative_id NULLS LAST) AS rank FROM n
            WHERE 50 * positive_score <= 100 * negative_score AND 100 * negative_score <= 95 * positive_score)
        SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM x WHERE rank <= 3
    """,
    "op12_filter_audit": r"""
        WITH RECURSIVE d AS (
            SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        f AS (
            SELECT part, doc_id, CASE WHEN len(w) < 50 THEN 1 ELSE 0 END
                + CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 2 ELSE 0 END
                + CASE WHEN 100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * len(t) THEN 4 ELSE 0 END
                + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
                + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS mask FROM d),
        c AS (
            SELECT part, mask, count(*) AS n, count(*) FILTER (WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)) AS good,
                count(*) FILTER (WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)) AS toxic FROM f GROUP BY part, mask),
        o(filter_order, step, before, bit) AS (
            SELECT '', 0, 0, 0 UNION ALL
            SELECT filter_order || l, step + 1, before + bit, b FROM o, (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS z(l, b) WHERE NOT contains(filter_order, l)),
        s AS (
            SELECT e.filter_order, p.step, p.before, p.bit FROM (SELECT filter_order FROM o WHERE step = 5) AS e
            JOIN o AS p ON p.step > 0 AND starts_with(e.filter_order, p.filter_order)),
        r AS (
            SELECT part, filter_order, step, bit,
                CAST(coalesce(sum(n) FILTER (WHERE mask & (before + bit) = 0), 0) AS BIGINT) AS kept,
                CAST(coalesce(sum(n) FILTER (WHERE mask & before = 0 AND mask & bit <> 0), 0) AS BIGINT) AS removed,
                CAST(coalesce(sum(n) FILTER (WHERE mask & before <> 0 AND mask & bit <> 0), 0) AS BIGINT) AS redundant,
                CAST(coalesce(sum(n) FILTER (WHERE mask = bit), 0) AS BIGINT) AS unique_fails,
                CAST(coalesce(sum(good) FILTER (WHERE mask & before = 0 AND mask & bit <> 0), 0) AS BIGINT) AS good_lost,
                CAST(coalesce(sum(toxic) FILTER (WHERE mask & before = 0 AND mask & bit <> 0), 0) AS BIGINT) AS toxic_lost
            FROM c, s GROUP BY part, filter_order, step, bit)
        SELECT part, filter_order, CAST(step AS INTEGER) AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
            CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM r
    """,
    "op6_exact_dedup": """
        WITH t AS (
            SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS h FROM documents
        ), g AS (SELECT h, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY h)
        SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, t.h AS text_sha256 FROM t JOIN g USING (h)
    """,
}


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(ORACLES)
