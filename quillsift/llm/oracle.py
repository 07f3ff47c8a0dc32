"""DuckDB SQL for those queries of this subpackage that SQL can express. The others are held against
plain versions in tests/llm."""

from __future__ import annotations

from quillsift.llm import decontaminate, divergence, jaccard, quality, suffixes, warc

WORD = r"[^\x20\x09-\x0D]+"
LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ROWS = "d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, {low} AS low FROM documents)".format(low=LOWERED)


def words(text: str) -> str:
    return f"w AS MATERIALIZED (SELECT rid, doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS pos, len(ws) AS n FROM (SELECT rid, doc_id, regexp_extract_all({text}, '{WORD}') AS ws FROM d))"


def grams(n: int, more: str = "") -> str:
    frame = f"OVER (PARTITION BY rid ORDER BY pos ROWS BETWEEN CURRENT ROW AND {n - 1} FOLLOWING)"
    return f"SELECT rid, doc_id, pos, string_agg(w, ' ') {frame} AS g, count(*) {frame} AS k, n{more} FROM w"


def quality_sql() -> str:
    parts = [ROWS, words("t")]
    for n in quality.COVERAGE_LIMITS:
        parts += [
            f"g{n} AS MATERIALIZED (SELECT rid, pos, count(*) OVER (PARTITION BY rid, g) > 1 AS twice FROM ({grams(n)}) WHERE k = {n})",
            f"c{n} AS MATERIALIZED (SELECT w.rid, length(w.w) AS c, coalesce(bool_or(twice) OVER (PARTITION BY w.rid ORDER BY w.pos ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW), false) AS inside FROM w LEFT JOIN g{n} g ON g.rid = w.rid AND g.pos = w.pos)",
            f"s{n} AS (SELECT rid, sum(c) FILTER (WHERE inside) AS chars, count(*) FILTER (WHERE inside) AS words FROM c{n} GROUP BY rid)",
        ]
    parts += [
        "l AS (SELECT rid, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM (SELECT rid, string_split(t, chr(10)) AS ls FROM d))",
        r"dup AS (SELECT rid, count(*) AS lines, sum(length(regexp_replace(line, '[\x20\x09-\x0D]+', '', 'g'))) AS chars FROM (SELECT *, row_number() OVER (PARTITION BY rid, line ORDER BY i) AS r FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')) WHERE r > 1 GROUP BY rid)",
        "base AS (SELECT rid, count(*) AS n, sum(length(w)) AS c FROM w GROUP BY rid)",
    ]
    names = ", ".join(f"coalesce(s{n}.chars, 0) AS c{n}" for n in quality.COVERAGE_LIMITS)
    joins = " ".join(f"LEFT JOIN s{n} ON s{n}.rid = d.rid" for n in quality.COVERAGE_LIMITS)
    parts.append(
        "m AS (SELECT d.doc_id, coalesce(b.n, 0)::BIGINT AS n_words, coalesce(b.c, 0)::BIGINT AS word_chars, (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, coalesce(dup.lines, 0)::BIGINT AS n_dup_lines, "
        f"coalesce(s5.words, 0)::BIGINT AS n_repeat_words, coalesce(dup.chars, 0) AS dup_chars, {names} FROM d LEFT JOIN base b ON b.rid = d.rid LEFT JOIN dup ON dup.rid = d.rid {joins})"
    )
    good = " AND ".join(f"c{n} / word_chars::DOUBLE <= {most}::DOUBLE" for n, most in quality.COVERAGE_LIMITS.items())
    failed = "(n_words < 10 OR 100 * n_repeat_words > 20 * n_words)"
    verdict = f"{good} AND dup_chars / word_chars::DOUBLE <= {quality.LINE_LIMIT}::DOUBLE AND n_symbols <= {quality.SYMBOL_LIMIT}::DOUBLE * word_chars"
    return "WITH " + ",\n".join(parts) + f"\nSELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, {failed} AS base_failed, CASE WHEN {failed} THEN false ELSE {verdict} END AS kept FROM m"


def jaccard_sql() -> str:
    n = jaccard.SHINGLE
    parts = [
        ROWS,
        words("low"),
        f"s AS MATERIALIZED (SELECT DISTINCT rid, doc_id, g FROM ({grams(n)}) WHERE k = least(n, {n}) AND (n >= {n} OR pos = 1))",
        "z AS MATERIALIZED (SELECT rid, any_value(doc_id) AS doc_id, count(*) AS z FROM s GROUP BY rid)",
        "i AS (SELECT x.rid AS a, y.rid AS b, count(*) AS i FROM s x JOIN s y ON x.g = y.g AND x.rid <> y.rid GROUP BY ALL)",
        "e AS MATERIALIZED (SELECT a, b FROM i JOIN z x ON x.rid = a JOIN z y ON y.rid = b WHERE 100 * i >= 75 * (x.z + y.z - i))",
        "reach AS (SELECT rid AS a, rid AS b FROM d UNION SELECT reach.a, e.b FROM reach JOIN e ON e.a = reach.b)",
    ]
    return (
        "WITH RECURSIVE " + ",\n".join(parts) + "\nSELECT d.doc_id, coalesce(any_value(z.z), 0)::BIGINT AS n_shingles, min(o.doc_id) AS component_id FROM d JOIN reach ON reach.a = d.rid JOIN d o ON o.rid = reach.b LEFT JOIN z ON z.rid = d.rid GROUP BY d.rid, d.doc_id"
    )


def repeats_sql() -> str:
    n = suffixes.LEAST
    parts = [
        ROWS,
        words("t"),
        f"g AS MATERIALIZED (SELECT doc_id, pos - 1 AS p, md5(g) AS g FROM ({grams(n)}) WHERE k = {n})",
        "f AS MATERIALIZED (SELECT doc_id, p, first_value(doc_id) OVER o AS fd, first_value(p) OVER o AS fp, count(*) OVER (PARTITION BY g) AS c FROM g WINDOW o AS (PARTITION BY g ORDER BY doc_id, p))",
        "m AS (SELECT doc_id, p, fd, (doc_id <> fd OR p <> fp) AS is_copy FROM f WHERE c > 1)",
        f"b AS (SELECT *, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id, is_copy ORDER BY p) + {n} THEN 0 ELSE 1 END AS fresh FROM m)",
        "r AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, is_copy ORDER BY p) AS r FROM b)",
    ]
    return "WITH " + ",\n".join(parts) + f"\nSELECT doc_id, min(p)::BIGINT AS start_word, (max(p) + {n} - min(p))::BIGINT AS n_words, is_copy, min(fd) AS first_doc_id FROM r GROUP BY doc_id, is_copy, r"


def archive_sql() -> str:
    return (
        f"WITH p AS (SELECT page_id, url, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages), m AS (SELECT *, CASE WHEN payload_bytes >= {warc.LEAST_REVISIT} THEN max(page_id) OVER (PARTITION BY payload_digest) END AS keeper FROM p) "
        "SELECT page_id, payload_bytes, payload_digest, CASE WHEN keeper > page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN keeper > page_id THEN keeper END AS refers_to, url FROM m"
    )


def decontamination_sql() -> str:
    n, word = decontaminate.WINDOW, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    of = lambda ws: f"regexp_extract_all({LOWERED}, '{word}') AS {ws}"
    parts = [
        f"d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, {of('ws')} FROM documents)",
        f"i AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {of('ws')} FROM benchmark)",
        f"iw AS MATERIALIZED (SELECT DISTINCT item, k, array_to_string(ws[s:s + k - 1], ' ') AS g FROM (SELECT item, ws, least(len(ws), {n}) AS k, unnest(range(1, greatest(len(ws) - {n}, 0) + 2)) AS s FROM i WHERE len(ws) > 0))",
        "dw AS MATERIALIZED (SELECT rid, s, k, array_to_string(ws[s:s + k - 1], ' ') AS g FROM (SELECT rid, ws, k, unnest(range(1, len(ws) - k + 2)) AS s FROM d, (SELECT DISTINCT k FROM iw)))",
        "found AS MATERIALIZED (SELECT rid, s, k, item FROM dw JOIN iw USING (k, g))",
        "hit AS (SELECT rid, count(DISTINCT place) AS n FROM (SELECT rid, unnest(range(s, s + k)) AS place FROM (SELECT DISTINCT rid, s, k FROM found)) GROUP BY rid)",
        "item AS (SELECT rid, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM found) GROUP BY rid)",
    ]
    return "WITH " + ",\n".join(parts) + "\nSELECT doc_id, len(ws) AS n_words, coalesce(hit.n, 0) AS n_hit, coalesce(item.n, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated FROM d LEFT JOIN hit USING (rid) LEFT JOIN item USING (rid)"


def divergence_sql() -> str:
    """Every pair of sources over every kept term, in 128-bit numbers."""
    term = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
    p = f"1 + ({divergence.SCALE}::HUGEINT * (coalesce({{n}}, 0) + 1)) // ({{of}})"
    parts = [
        f"d AS MATERIALIZED (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all({LOWERED}, '{term}') AS ws FROM documents)",
        "t AS MATERIALIZED (SELECT rid, lang, source, unnest(ws) AS term FROM d)",
        f"kept AS MATERIALIZED (SELECT lang, term FROM t GROUP BY ALL HAVING count(DISTINCT rid) >= {divergence.LEAST_DOCS})",
        "n AS MATERIALIZED (SELECT lang, source, term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY ALL)",
        "v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang)",
        "g AS MATERIALIZED (SELECT lang, source, coalesce(sum(n.n), 0)::HUGEINT + coalesce(any_value(v), 0) AS of FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN v USING (lang) LEFT JOIN n USING (lang, source) GROUP BY lang, source)",
        f"p AS MATERIALIZED (SELECT lang, g.source, term, n.n, {p.format(n='n.n', of='g.of')} AS p FROM g JOIN kept USING (lang) LEFT JOIN n USING (lang, source, term))",
        f"q AS MATERIALIZED (SELECT lang, term, {p.format(n='n', of='(SELECT sum(n) FROM n WHERE n.lang = a.lang) + v')} AS q FROM (SELECT lang, term, sum(n)::HUGEINT AS n FROM n GROUP BY lang, term) a JOIN v USING (lang))",
        "sums AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL)",
        "pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source)",
        "terms AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // q)::BIGINT AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)",
        "ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))",
    ]
    return "WITH " + ",\n".join(parts) + f"\nSELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= {divergence.TERM_RANKS}"


def oracle_sql() -> dict[str, str]:
    return {
        "op3_quality_rules": quality_sql(),
        "op4_ngram_jaccard_join": jaccard_sql(),
        "op6_suffix_dedup": repeats_sql(),
        "op9_warc_round_trip": archive_sql(),
        "op11_benchmark_decontamination": decontamination_sql(),
        "op12_source_divergence": divergence_sql(),
    }
