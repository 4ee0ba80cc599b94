"""The queries of the training-data operators, with their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from effectforge.llm.common import read_tables
from effectforge.llm.decontaminate import contamination
from effectforge.llm.divergence import source_divergence
from effectforge.llm.html_text import extract_text
from effectforge.llm.infill import fill_in_middle, restored
from effectforge.llm.license_templates import TEMPLATES
from effectforge.llm.licenses import scan_licenses
from effectforge.llm.lines import line_dedup
from effectforge.llm.mixing import mix_sources
from effectforge.llm.quality import quality_rules
from effectforge.llm.simhash import near_duplicates
from effectforge.llm.substring_dedup import substring_dedup
from effectforge.llm.suffix_dedup import suffix_dedup
from effectforge.llm.url_filter import filter_urls
from effectforge.llm.warc import round_trip


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_tables(spark, sf_dir, "documents", "labels")
    return quality_rules(docs, labels)


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    (docs,) = read_tables(spark, sf_dir, "documents")
    return mix_sources(docs)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    (pages,) = read_tables(spark, sf_dir, "pages")
    return round_trip(pages).drop("target_uri")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = read_tables(spark, sf_dir, "documents", "benchmark")
    return contamination(docs, benchmark).drop("item_ids")


#: The rules of the URL query.
URL_RULES = [
    ("block", "com/en/"),
    ("allow", "example.com/en/7"),
    ("allow", "net/de/"),
    ("block", "example.net/de/8"),
    ("block", "org/es/"),
]


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    (pages,) = read_tables(spark, sf_dir, "pages")
    return filter_urls(pages, URL_RULES)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    (docs,) = read_tables(spark, sf_dir, "documents")
    return substring_dedup(docs).drop("spans")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    (docs,) = read_tables(spark, sf_dir, "documents")
    return line_dedup(docs)


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    (docs,) = read_tables(spark, sf_dir, "documents")
    return suffix_dedup(docs).drop("spans")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    (docs,) = read_tables(spark, sf_dir, "documents")
    return near_duplicates(docs)


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    (pages,) = read_tables(spark, sf_dir, "pages")
    return extract_text(pages)


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    (docs,) = read_tables(spark, sf_dir, "documents")
    return source_divergence(docs)


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    (docs,) = read_tables(spark, sf_dir, "documents")
    return fill_in_middle(docs).select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    (docs,) = read_tables(spark, sf_dir, "documents")
    return scan_licenses(docs).drop("spans")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_source_mix": op2_source_mix,
    "op3_warc": op3_warc,
    "op4_decontaminate": op4_decontaminate,
    "op5_url_filter": op5_url_filter,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_line_dedup": op7_line_dedup,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_simhash": op9_simhash,
    "op10_html_text": op10_html_text,
    "op11_source_divergence": op11_source_divergence,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_license_scan": op13_license_scan,
}

_QUOTED = [(label, text.replace("'", "''")) for label, text in TEMPLATES]
_TEMPLATE_ROWS = ", ".join(f"({n}, '{label}', '{text}')" for n, (label, text) in enumerate(_QUOTED))

ORACLE_SQL: dict[str, str] = {
    "op3_warc": """
        WITH p AS (
            SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest
            FROM pages
        ), m AS (
            SELECT *, payload_bytes >= 1000 AND page_id IS DISTINCT FROM max(page_id) OVER (PARTITION BY payload_digest)
                AND max(page_id) OVER (PARTITION BY payload_digest) IS NOT NULL AS again,
                max(page_id) OVER (PARTITION BY payload_digest) AS first_id
            FROM p
        )
        SELECT page_id, payload_bytes, payload_digest,
            CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
            CASE WHEN again THEN first_id END AS refers_to
        FROM m
    """,
    "op4_decontaminate": r"""
        WITH d AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
            FROM documents
        ), b AS (
            SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
            FROM benchmark
        ), bk AS (
            SELECT item_id, ws, least(10, len(ws)) AS n, unnest(range(1, greatest(1, len(ws) - 9) + 1)) AS k
            FROM b WHERE len(ws) > 0
        ), iw AS (
            SELECT DISTINCT item_id, n, array_to_string(ws[k:k + n - 1], ' ') AS w FROM bk
        ), dk AS (
            SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM iw)
        ), hit AS (
            SELECT doc_id, k, n, item_id FROM (SELECT doc_id, n, k, array_to_string(ws[k:k + n - 1], ' ') AS w FROM dk)
            JOIN iw USING (n, w)
        ), words AS (
            SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM hit) GROUP BY 1
        ), items AS (
            SELECT doc_id, count(DISTINCT item_id) AS n_items,
                array_to_string(list_sort(list(DISTINCT item_id::VARCHAR)), ',') AS ids
            FROM hit GROUP BY 1
        )
        SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
            sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
    """,
    "op6_substring_dedup": r"""
        WITH d AS (
            SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
        ), dk AS (
            SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS k FROM d
        ), again AS (
            SELECT doc_id, k FROM dk
            QUALIFY row_number() OVER (PARTITION BY array_to_string(ws[k:k + 19], ' ') ORDER BY doc_id, k) > 1
        ), gone AS (
            SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(k, k + 20)) AS p FROM again)
        ), words AS (
            SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM d
        ), kept AS (
            SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS rest
            FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id
        )
        SELECT doc_id, len(ws) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(rest, '')) AS kept_sha256
        FROM d LEFT JOIN kept USING (doc_id)
    """,
    "op7_line_dedup": r"""
        WITH l AS (
            SELECT doc_id, coalesce(source, '') AS site, unnest(string_split(text, chr(10))) AS line,
                generate_subscripts(string_split(text, chr(10)), 1) AS pos
            FROM documents
        ), spread AS (
            SELECT line, min(doc_id) AS first_id FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
            GROUP BY line HAVING count(DISTINCT site) >= 10
        ), marked AS (
            SELECT doc_id, pos, l.line, spread.line IS NOT NULL AND (doc_id IS DISTINCT FROM first_id
                OR row_number() OVER (PARTITION BY doc_id, l.line ORDER BY pos) > 1) AS gone
            FROM l LEFT JOIN spread USING (line)
        ), kept AS (
            SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed,
                coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS text
            FROM marked GROUP BY doc_id
        )
        SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed,
            CASE WHEN d.text IS NOT NULL THEN kept.text END AS text
        FROM documents d LEFT JOIN kept USING (doc_id)
    """,
    "op11_source_divergence": r"""
        WITH d AS (
            SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                    '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ws
            FROM documents
        ), w AS (
            SELECT r, lang, source, unnest(ws) AS term FROM d
        ), kept AS (
            SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 10
        ), size AS (
            SELECT lang, count(*) AS v FROM kept GROUP BY lang
        ), groups AS (
            SELECT lang, source, coalesce(v, 0) AS v FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN size USING (lang)
        ), c AS (
            SELECT lang, source, term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY ALL
        ), dense AS (
            SELECT g.lang, g.source, term, g.v, coalesce(n, 0) AS n
            FROM groups g JOIN kept USING (lang) LEFT JOIN c USING (lang, source, term)
        ), p AS (
            SELECT lang, source, term, n, (1 + 1000000000::HUGEINT * (n + 2) // (sum(n) OVER (PARTITION BY lang, source) + 2 * v))::BIGINT AS p
            FROM dense
        ), q AS (
            SELECT lang, term, (1 + 1000000000::HUGEINT * (sum(n) + 2) // (sum(sum(n)) OVER (PARTITION BY lang) + 2 * any_value(v)))::BIGINT AS q
            FROM dense GROUP BY lang, term
        ), pair AS (
            SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
            FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
        ), pairs AS (
            SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
            FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
            LEFT JOIN pair x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
        ), terms AS (
            SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // (p + q) AS value
            FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q
        ), ranked AS (
            SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank
            FROM (FROM pairs UNION ALL FROM terms)
        )
        SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 10
    """,
    "op12_fill_in_middle": r"""
        WITH d AS (
            SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n,
                sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS x
            FROM documents
        ), h AS (
            SELECT *, ('0x' || substr(x, 1, 8))::BIGINT % (n + 1) AS c1, ('0x' || substr(x, 9, 8))::BIGINT % (n + 1) AS c2,
                ('0x' || substr(x, 17, 8))::BIGINT % 100 AS h3, ('0x' || substr(x, 25, 8))::BIGINT % 100 AS h4
            FROM d
        ), f AS (
            SELECT *, least(c1, c2) AS a, greatest(c1, c2) AS b,
                CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 >= 90 THEN 'plain'
                    WHEN h4 < 20 THEN 'spm' ELSE 'psm' END AS form
            FROM h
        ), cut AS (
            SELECT *, substring(t, 1, a) AS p, substring(t, a + 1, b - a) AS m, substring(t, b + 1) AS s FROM f
        )
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars,
            CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
            sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
                ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
            sha256(t) AS restored_sha256
        FROM cut
    """,
    "op13_license_scan": r"""
        WITH t AS (
            SELECT template, label, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
            FROM (VALUES __TEMPLATES__) v(template, label, text)
        ), tg AS (
            SELECT template, label, len(ws) - 4 AS n_grams, p AS t_at, array_to_string(ws[p + 1:p + 5], ' ') AS gram
            FROM (SELECT *, unnest(range(len(ws) - 4)) AS p FROM t)
        ), d AS (
            SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
            FROM documents
        ), w AS (
            SELECT r, unnest(range(len(ws))) AS p, ws FROM d
        ), base AS (
            SELECT r, p, unnest(list_filter([CASE WHEN ws[p + 1:p + 2] = ['mit', 'license'] THEN 'mit' END,
                CASE WHEN ws[p + 1:p + 2] = ['apache', 'license'] THEN 'apache' END,
                CASE WHEN ws[p + 1:p + 3] = ['general', 'public', 'license'] THEN 'gpl' END], lambda x: x IS NOT NULL)) AS label
            FROM w
        ), bases AS (
            SELECT r, count(*) AS n_base, min(p) AS first_word, max(p) AS last_word, list(DISTINCT label) AS own FROM base GROUP BY r
        ), lines AS (
            SELECT r, template, label, n_grams, p - t_at AS diagonal, list(DISTINCT t_at) AS places
            FROM (SELECT r, p, array_to_string(ws[p + 1:p + 5], ' ') AS gram FROM w WHERE p + 5 <= len(ws)) JOIN tg USING (gram)
            GROUP BY ALL
        ), near AS (
            SELECT * REPLACE (list_filter(near, lambda x: abs(x.diagonal - diagonal) <= least(8, n_grams // 10)) AS near)
            FROM (SELECT *, list({'diagonal': diagonal, 'places': places}) OVER (PARTITION BY r, template ORDER BY diagonal
                RANGE BETWEEN 8 PRECEDING AND 8 FOLLOWING) AS near FROM lines)
        ), top AS (
            SELECT *, list_distinct(flatten(list_transform(near, lambda x: list_transform(x.places, lambda p: p + x.diagonal)))) AS merged,
                len(list_distinct(flatten(list_transform(near, lambda x: x.places)))) AS covered
            FROM near WHERE len(list_filter(near, lambda x: len(x.places) > len(places)
                OR (len(x.places) = len(places) AND x.diagonal < diagonal))) = 0
        ), span AS (
            SELECT r, label, greatest(
                len(places)::DOUBLE / (list_max(places) - list_min(places) + 1 + n_grams - len(places)),
                least(covered, len(merged))::DOUBLE / (list_max(merged) - list_min(merged) + 1 + n_grams - least(covered, len(merged)))) AS s
            FROM top
        ), found AS (
            SELECT r, max(s) AS score, list(DISTINCT label) FILTER (s >= 0.8) AS more FROM span GROUP BY r
        )
        SELECT doc_id, len(ws) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
            coalesce(array_to_string(list_sort(own), ','), '') AS base_labels,
            array_to_string(list_sort(list_distinct(list_concat(coalesce(own, []), coalesce(more, [])))), ',') AS labels,
            coalesce(score, 0) AS score
        FROM d LEFT JOIN bases USING (r) LEFT JOIN found USING (r)
    """.replace("__TEMPLATES__", _TEMPLATE_ROWS),
}
