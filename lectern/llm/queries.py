"""One query for each operator over its whole table, with production parameters, and SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import decontamination, hard_negatives, html_text, license_scan, line_dedup, mixing, ngram_join, quality, spelling, token_counts, token_files, topk_search, toxicity
from .common import table

VOCABULARY = "byte_bpe_50k.json"


def vocabulary() -> str:
    """The path of the vocabulary, which is installed beside the tokenizers' libraries."""
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def op1_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.search_digest(table(spark, sf_dir, "embeddings"))


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extracted(table(spark, sf_dir, "pages"))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"), k=4, percent=85)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_digest(table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination_digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), vocabulary())


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_digest(table(spark, sf_dir, "documents"), vocabulary())


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_digest(table(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.negatives_digest(table(spark, sf_dir, "embeddings"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_digest(table(spark, sf_dir, "documents"))


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scanned(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_topk_search": op1_topk_search,
    "op2_html_text": op2_html_text,
    "op3_ngram_join": op3_ngram_join,
    "op4_quality": op4_quality,
    "op5_mixing": op5_mixing,
    "op6_decontamination": op6_decontamination,
    "op7_toxicity": op7_toxicity,
    "op8_token_counts": op8_token_counts,
    "op9_token_files": op9_token_files,
    "op10_line_dedup": op10_line_dedup,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_spelling": op12_spelling,
    "op13_license_scan": op13_license_scan,
}

ORACLE_SQL: dict[str, str] = {
    "op1_topk_search": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.e, v.e)::BIGINT AS score
            FROM v AS q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0
        ), r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op5_mixing": """
        WITH RECURSIVE d AS (
            SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size FROM documents
        ), s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM d GROUP BY source
        ), c AS (
            SELECT source, source_size, ([5.0, 2.0, 1.0])[1 + (place - 1) % 3]::DOUBLE AS weight, 2.0::DOUBLE * source_size AS cap FROM s
        ), f AS (
            SELECT *, sum(source_size) OVER () * 1.5::DOUBLE AS words, sum(weight) OVER () AS all_weight,
                coalesce(sum(cap) OVER b, 0) AS used, coalesce(sum(weight) OVER b, 0) AS gone
            FROM c WINDOW b AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
        ), l AS (SELECT *, (words - used) / (all_weight - gone) AS level FROM f
        ), t AS (
            SELECT source, source_size, CASE WHEN level * weight >= cap THEN cap ELSE
                least(cap, weight * max(CASE WHEN level * weight < cap THEN level END) OVER ()) END AS target FROM l
        ), p AS (
            SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM t
        ), o AS (SELECT *, target - whole * source_size AS open, CASE WHEN source_size > 0 THEN (target - whole * source_size) / source_size ELSE 0 END AS p FROM p
        ), u AS (
            SELECT d.*, o.source_size, o.target, o.whole, o.open, o.p,
                (('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, 'null')), 1, 12))::BIGINT + 0.5::DOUBLE) / 281474976710656.0::DOUBLE AS u
            FROM d JOIN o ON d.source IS NOT DISTINCT FROM o.source
        ), q AS (SELECT *, CASE WHEN p > 0 THEN u / (1 - u) * (1 - p) / p END AS q FROM u
        ), r AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY q, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto FROM q)
        SELECT doc_id, size::BIGINT AS size, source_size, target,
            (size * (whole + CASE WHEN p > 0 AND (upto <= open OR open > upto - size AND upto - open < open - (upto - size)) THEN 1 ELSE 0 END))::BIGINT AS taken
        FROM r""",
    "op6_decontamination": """
        WITH i AS (
            SELECT DISTINCT item_id::VARCHAR AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
            FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL
        ), s AS (SELECT item, w, least(10, len(w)) AS m FROM i WHERE len(w) > 0
        ), p AS (SELECT DISTINCT item, m, array_to_string(list_slice(w, k, k + m - 1), ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - m + 2)) AS k FROM s)
        ), d AS (
            SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
            FROM documents
        ), g AS (
            SELECT r, m, k, array_to_string(list_slice(w, k, k + m - 1), ' ') AS g
            FROM (SELECT r, w, m, unnest(range(1, len(w) - m + 2)) AS k FROM d, (SELECT DISTINCT m FROM p) WHERE len(w) >= m)
        ), o AS (SELECT g.r, g.m, g.k, p.item FROM g JOIN p ON g.m = p.m AND g.g = p.g
        ), h AS (SELECT r, count(DISTINCT x) AS n_hit FROM (SELECT r, unnest(range(k, k + m)) AS x FROM o) GROUP BY r
        ), t AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT r, item FROM o) GROUP BY r)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
            sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN h USING (r) LEFT JOIN t USING (r)""",
    "op11_hard_negatives": """
        WITH v AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
            WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT a.vec_id AS anchor_id, a.label = v.label AS same, v.vec_id, list_inner_product(a.e, v.e)::BIGINT AS score
            FROM v AS a JOIN v ON a.vec_id <> v.vec_id WHERE a.vec_id % 100 = 0
        ), p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
        ), n AS (
            SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id AS negative_id, positive_score, score AS negative_score
            FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
        )
        SELECT * FROM n WHERE rank <= 10""",
    "op12_spelling": """
        WITH RECURSIVE t AS (
            SELECT list_transform(range(256), lambda i: list_reduce([i, 1, 2, 3, 4, 5, 6, 7, 8], lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END)) AS crc
        ), r AS (
            SELECT coalesce(doc_id::VARCHAR, 'null') AS id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents
        ), d AS (SELECT id, run, count(*) AS k, hex(id || ':' || run) AS x FROM r GROUP BY id, run
        ), h AS (
            SELECT run, k, xor(4294967295, list_reduce(
                list_prepend(4294967295, list_transform(range(len(x) // 2), lambda j: ('0x' || x[2 * j + 1 : 2 * j + 2])::BIGINT)),
                lambda a, b: xor(a // 256, crc[1 + (xor(a, b) & 255)]))) AS h FROM d, t
        ), w AS (
            SELECT CASE WHEN h % 97 = 0 THEN run[1 : h % length(run)] || run[h % length(run) + 2 : ] ELSE run END AS word, k FROM h
        ), v AS (SELECT word, sum(k)::BIGINT AS n FROM w WHERE length(word) >= 5 GROUP BY word HAVING sum(k) >= 3
        ), c AS (SELECT word, n, i, word[1 : i - 1] || word[i + 1 : ] AS cut FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)
        ), p AS (
            SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM c AS a JOIN c AS b ON a.i = b.i AND a.cut = b.cut AND a.word <> b.word
            UNION SELECT c.word, c.n, v.word, v.n FROM c JOIN v ON c.cut = v.word
            UNION SELECT v.word, v.n, c.word, c.n FROM c JOIN v ON c.cut = v.word
        ), b AS (
            SELECT word, n, near, near_n, count(*) OVER (PARTITION BY word) AS n_near FROM p QUALIFY row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) = 1
        ), f AS (
            SELECT v.word, v.n, coalesce(b.n_near, 0)::BIGINT AS n_near, CASE WHEN near_n >= 2 * v.n THEN near END AS form, CASE WHEN near_n >= 2 * v.n THEN near_n END AS form_n
            FROM v LEFT JOIN b ON v.word = b.word
        ), s AS (
            SELECT word, word AS root, form AS next FROM f
            UNION ALL SELECT s.word, f.word, f.form FROM s JOIN f ON s.next = f.word
        )
        SELECT f.word, f.form, s.root, f.n, f.n_near, f.form_n FROM f JOIN s ON f.word = s.word WHERE s.next IS NULL""",
    "op13_license_scan": license_scan.oracle_sql(),
}
