"""The registered queries as DuckDB SQL over the raw tables, from tokens on: an independent engine's
answer to each. A query is the fragments that it needs, as common table expressions."""

from __future__ import annotations

import re

from quillsift.functions import weighting
from quillsift.functions.stemming import stem_ctes
from quillsift.functions.text import STOPWORDS
from quillsift.operators.rank import BOOST, BOOST_POOL, SDM_POOL, SDM_WEIGHTS
from quillsift.sources.collections import TITLE
from quillsift.plans.queries import COMMON, PAIRS, PARTS, PHRASES, QUERIES, SCHEMES

STOP = ", ".join(f"'{w}'" for w in STOPWORDS)


def words(text: str) -> str:
    return f"list_filter(list_transform(regexp_extract_all({text}, '[a-zA-Z0-9]+'), lambda x: lower(x)), lambda x: x NOT IN ({STOP}))"


def values(rows: dict[int, str]) -> str:
    return "SELECT * FROM (VALUES " + ", ".join(f"({k}, '{v}')" for k, v in rows.items()) + ") v(qid, text)"


FULL = "title || '. ' || text"
FRAGMENTS = {
    "docs": "SELECT doc_id AS docid, coalesce(source, '') AS category, regexp_extract(coalesce(text, ''), '" + TITLE + "', 1) AS title, coalesce(text, '') AS text FROM documents",
    "queries": values(QUERIES),
    "raw_tokens": f"SELECT docid, unnest(ws) AS raw, generate_subscripts(ws, 1) - 1 AS pos FROM (SELECT docid, {words(FULL)} AS ws FROM docs)",
    "raw_titles": f"SELECT docid, unnest({words("title || ' ' || category")}) AS raw FROM docs",
    "raw_queries": f"SELECT qid, unnest(ws) AS raw, generate_subscripts(ws, 1) - 1 AS off FROM (SELECT qid, {words('text')} AS ws FROM queries)",
    "raw_words": "SELECT raw FROM raw_tokens UNION ALL SELECT raw FROM raw_titles UNION ALL SELECT raw FROM raw_queries",
    "stems": "",
    "tokens": "SELECT docid, pos, term FROM raw_tokens JOIN stems USING (raw)",
    "postings": "SELECT term, docid, count(*) AS tf, list(pos ORDER BY pos) AS positions FROM tokens GROUP BY ALL",
    "terms": "SELECT term, count(*) AS df FROM postings GROUP BY term",
    "title_postings": "SELECT term, docid, count(*) AS tf FROM raw_titles JOIN stems USING (raw) GROUP BY ALL",
    "stats": "SELECT docid, sum(tf)::BIGINT AS dl, max(tf) AS max_tf, avg(tf) AS avg_tf, count(*) AS n_unique FROM postings GROUP BY docid",
    "doc_stats": "SELECT docid, coalesce(dl, 0) AS dl, coalesce(max_tf, 0) AS max_tf, coalesce(avg_tf, 0.0::DOUBLE) AS avg_tf, coalesce(n_unique, 0) AS n_unique, length(title) + 1 + length(text) AS char_len FROM docs LEFT JOIN stats USING (docid)",
    "coll": "SELECT count(*) AS n, sum(dl) / greatest(count(*), 1)::DOUBLE AS avgdl FROM doc_stats",
    "doc_w": "SELECT term, docid, (1 + log10(tf)) / sqrt(sum((1 + log10(tf)) * (1 + log10(tf))) OVER (PARTITION BY docid)) AS lnc FROM postings",
    "q": "SELECT qid, off, term FROM raw_queries JOIN stems USING (raw)",
    "q_terms": "SELECT DISTINCT qid, term FROM q",
    "query_raw": "SELECT qid, term, CASE WHEN df IS NULL OR df >= n THEN 0.0::DOUBLE ELSE (1 + log10(qtf)) * log10(n / df::DOUBLE) END AS raw FROM (SELECT qid, term, count(*) AS qtf FROM q GROUP BY ALL) LEFT JOIN terms USING (term), coll",
    "query_w": "SELECT qid, term, raw / coalesce(nullif(sqrt(sum(raw * raw) OVER (PARTITION BY qid)), 0), 1) AS w FROM query_raw",
    "vsm_scores": "SELECT qid, docid, sum(w * lnc) AS score FROM query_w JOIN doc_w USING (term) WHERE w <> 0 GROUP BY ALL",
    "bm25_scores": f"SELECT qid, docid, sum(ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1) * tf * {weighting.K1 + 1}::DOUBLE / (tf + {weighting.K1}::DOUBLE * (1 - {weighting.B}::DOUBLE + {weighting.B}::DOUBLE * dl / avgdl))) AS score FROM q_terms JOIN terms USING (term) JOIN postings USING (term) JOIN doc_stats USING (docid), coll GROUP BY ALL",
    "bigrams": "SELECT * FROM (SELECT qid, term AS ta, lead(term) OVER (PARTITION BY qid ORDER BY off) AS tb FROM (SELECT qid, term, min(off) AS off FROM q GROUP BY ALL)) WHERE ta IN (SELECT term FROM terms) AND tb IN (SELECT term FROM terms)",
    "gram_docs": "SELECT b.qid, x.docid, b.ta, b.tb FROM bigrams b JOIN postings x ON x.term = b.ta JOIN postings y ON y.term = b.tb AND y.docid = x.docid",
    "gram_pairs": "SELECT g.qid, g.docid, g.ta, g.tb, y.pos - x.pos AS d FROM gram_docs g JOIN tokens x ON x.docid = g.docid AND x.term = g.ta JOIN tokens y ON y.docid = g.docid AND y.term = g.tb AND y.pos BETWEEN x.pos - 4 AND x.pos + 4",
    "evidence": "SELECT g.qid, g.docid, count(*) FILTER (WHERE d BETWEEN 1 AND 2) AS ordered, count(*) FILTER (WHERE d IS NOT NULL AND d <> 0) AS unordered FROM gram_docs g LEFT JOIN gram_pairs p ON p.qid = g.qid AND p.docid = g.docid AND p.ta = g.ta AND p.tb = g.tb GROUP BY ALL",
    "wanted": "SELECT qid, count(*) AS wanted FROM q GROUP BY qid",
    "candidates": "SELECT qid, docid FROM q_terms JOIN postings USING (term) GROUP BY qid, docid HAVING count(*) = (SELECT count(*) FROM q_terms t WHERE t.qid = q_terms.qid)",
    "phrase_hits": "SELECT qid, docid, pos - off AS start FROM q JOIN tokens USING (term) JOIN wanted USING (qid) GROUP BY qid, docid, pos - off, wanted HAVING count(*) = wanted",
    "phrase_ranked": "SELECT *, row_number() OVER (PARTITION BY qid ORDER BY n_hits DESC, docid) AS rank FROM (SELECT qid, docid, count(*) AS n_hits FROM phrase_hits GROUP BY ALL)",
    "smart_terms": "SELECT qid, term, count(*) AS qtf FROM q GROUP BY ALL",
    "pairs": "SELECT * FROM (VALUES " + ", ".join(f"({i}, '{a}', '{b}', {k})" for i, a, b, k in PAIRS) + ") v(qid, a, b, k)",
    "pair_raw": f"SELECT qid, k, {words('a')}[1] AS ra, {words('b')}[1] AS rb FROM pairs",
    "pair_terms": "SELECT qid, k, x.term AS a, y.term AS b FROM pair_raw JOIN stems x ON x.raw = ra JOIN stems y ON y.raw = rb",
    "pair_hits": "SELECT p.qid, x.docid, x.pos AS pa, y.pos AS pb FROM pair_terms p JOIN tokens x ON x.term = p.a JOIN tokens y ON y.term = p.b AND y.docid = x.docid AND y.pos BETWEEN x.pos - p.k AND x.pos + p.k AND y.pos <> x.pos",
    "oov": "SELECT DISTINCT term FROM q WHERE term NOT IN (SELECT term FROM terms)",
    "suggested": "SELECT term, suggestion, distance FROM (SELECT o.term, t.term AS suggestion, levenshtein(o.term, t.term) AS distance, row_number() OVER (PARTITION BY o.term ORDER BY levenshtein(o.term, t.term), t.term) AS r FROM oov o JOIN terms t ON abs(length(o.term) - length(t.term)) <= 2 WHERE levenshtein(o.term, t.term) <= 2) WHERE r = 1",
    "corrected": "SELECT qid, string_agg(coalesce(suggestion, term), ' ' ORDER BY off) AS text FROM q LEFT JOIN suggested USING (term) GROUP BY qid",
}
MATERIALIZED = {"raw_tokens", "raw_words", "tokens", "postings", "terms", "doc_w", "doc_stats", "q"}


def ranked(name: str, scores: str) -> dict[str, str]:
    return {name: f"SELECT qid, docid, score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 10) DESC, docid) AS rank FROM {scores}"}


def boosted(base: str) -> str:
    hits = "SELECT qid, docid, count(*) AS hits FROM q_terms JOIN title_postings USING (term) GROUP BY ALL"
    return f"SELECT qid, docid, score * pow({BOOST}::DOUBLE, coalesce(hits, 0)) AS score FROM {base} LEFT JOIN ({hits}) USING (qid, docid) WHERE rank <= {BOOST_POOL}"


def sdm(base: str) -> str:
    a, b, c = SDM_WEIGHTS
    over = "OVER (PARTITION BY qid)"
    share = lambda x: f"{x} / coalesce(nullif(max({x}) {over}, 0), 1)::DOUBLE"
    every = f"SELECT qid, docid, sum(ft) AS ft, sum(fo) AS fo, sum(fu) AS fu FROM (SELECT qid, docid, score AS ft, 0 AS fo, 0 AS fu FROM {base} WHERE rank <= {SDM_POOL} UNION ALL SELECT qid, docid, 0, ordered, unordered FROM evidence) GROUP BY ALL"
    return f"SELECT qid, docid, {a}::DOUBLE * ({share('ft')}) + {b}::DOUBLE * ({share('fo')}) + {c}::DOUBLE * ({share('fu')}) AS score FROM ({every})"


def smart(doc: str, query: str) -> str:
    def tf(code: str, x: str, most: str, mean: str) -> str:
        return {"n": f"{x}::DOUBLE", "l": f"(1 + log10({x}))", "a": f"(0.5::DOUBLE + 0.5::DOUBLE * {x} / {most})", "b": "1.0::DOUBLE", "L": f"((1 + log10({x})) / (1 + log10({mean})))"}[code]

    def df(code: str) -> str:
        return {"n": "1.0::DOUBLE", "t": "CASE WHEN coalesce(df, 0) = 0 THEN 0 ELSE log10(n / df::DOUBLE) END", "p": "CASE WHEN coalesce(df, 0) = 0 OR n - df <= df THEN 0 ELSE log10((n - df) / df::DOUBLE) END"}[code]

    def by(code: str, key: str, unique: str, chars: str) -> str:
        return {"n": "1", "c": f"coalesce(nullif(sqrt(sum(raw * raw) OVER (PARTITION BY {key})), 0), 1)", "u": f"coalesce(nullif({unique}, 0), 1)", "b": f"pow(coalesce(nullif({chars}, 0), 1), {weighting.BYTE_POWER}::DOUBLE)"}[code]

    dw = f"SELECT term, docid, raw / {by(doc[2], 'docid', 'n_unique', 'char_len')} AS dw FROM (SELECT *, {tf(doc[0], 'tf', 'max_tf', 'avg_tf')} * ({df(doc[1])}) AS raw FROM postings JOIN terms USING (term) JOIN doc_stats USING (docid), coll)"
    qs = "SELECT *, max(qtf) OVER (PARTITION BY qid) AS mq, avg(qtf) OVER (PARTITION BY qid) AS aq FROM smart_terms"
    qw = f"SELECT qid, term, raw / {by(query[2], 'qid', 'chars', 'chars')} AS qw FROM (SELECT x.qid, term, length(text) AS chars, {tf(query[0], 'qtf', 'mq', 'aq')} * ({df(query[1])}) AS raw FROM ({qs}) x LEFT JOIN terms USING (term) JOIN queries y ON y.qid = x.qid, coll)"
    return f"SELECT qid, docid, sum(qw * dw) AS score FROM ({qw}) JOIN ({dw}) USING (term) WHERE qw <> 0 GROUP BY ALL HAVING sum(qw * dw) <> 0"


FRAGMENTS |= ranked("vsm", "vsm_scores") | ranked("bm25", "bm25_scores")
FRAGMENTS |= {"fielded_scores": boosted("vsm"), "sdm_scores": sdm("vsm"), "sdm_bm25_scores": sdm("bm25"), "custom_scores": smart("lnc", "ltc")}
FRAGMENTS |= ranked("fielded", "fielded_scores") | ranked("sdm", "sdm_scores") | ranked("sdm_bm25", "sdm_bm25_scores") | ranked("custom", "custom_scores")
LISTS = {"VSM (lnc.ltc)": "vsm", "BM25": "bm25", "SDM": "sdm", "Title-boosted VSM": "fielded", "Custom (lnc.ltc)": "custom"}
FRAGMENTS |= {
    "lists": " UNION ALL ".join(f"SELECT '{name}' AS ranker, qid, rank, docid FROM {t} WHERE rank <= 10" for name, t in LISTS.items()),
    "pool": "SELECT DISTINCT qid, docid FROM lists",
    "held": "SELECT qid, docid, count(*) AS held FROM q_terms JOIN postings USING (term) GROUP BY ALL",
    "graded_pool": "SELECT p.qid, p.docid, CASE WHEN f.docid IS NOT NULL THEN 3 WHEN held = (SELECT count(*) FROM q_terms t WHERE t.qid = p.qid) THEN 2 WHEN held > 0 THEN 1 ELSE 0 END AS grade FROM pool p LEFT JOIN held h ON h.qid = p.qid AND h.docid = p.docid LEFT JOIN (SELECT * FROM phrase_ranked WHERE rank <= 100) f ON f.qid = p.qid AND f.docid = p.docid",
    "graded": "SELECT ranker, qid, rank, docid, grade, row_number() OVER (PARTITION BY ranker, qid ORDER BY grade DESC, rank) AS ideal FROM lists JOIN graded_pool USING (qid, docid)",
    "snippet_hits": "SELECT qid, docid FROM vsm WHERE rank <= 10",
}
FRAGMENTS |= {
    "seg": f"SELECT docid, unnest(s) AS raw, generate_subscripts(s, 1) AS seg FROM (SELECT docid, regexp_extract_all({FULL}, '[a-zA-Z0-9]+|[^a-zA-Z0-9]+') AS s FROM docs)",
    "seg_at": 'SELECT docid, seg, raw, sum(length(raw)) OVER (PARTITION BY docid ORDER BY seg)::BIGINT AS "end" FROM seg',
    "word_spans": f'SELECT s.docid, row_number() OVER (PARTITION BY s.docid ORDER BY seg) - 1 AS i, s.raw, "end" - length(s.raw) AS start, "end", t.term FROM seg_at s JOIN stems t ON t.raw = lower(s.raw) WHERE regexp_matches(s.raw, \'^[a-zA-Z0-9]\') AND lower(s.raw) NOT IN ({STOP})',
}


def snippet_of(hits: str) -> str:
    words_ = f'SELECT h.qid, s.docid, s.i, s.start, s."end", count(t.term) AS hit FROM {hits} h JOIN word_spans s USING (docid) LEFT JOIN q_terms t ON t.qid = h.qid AND t.term = s.term GROUP BY ALL'
    over = "OVER (PARTITION BY qid, docid ORDER BY i ROWS BETWEEN CURRENT ROW AND 15 FOLLOWING)"
    wins = f'SELECT *, sum(hit) {over} AS hits, max("end") {over} AS stop, count(*) OVER (PARTITION BY qid, docid) AS n FROM ws'
    best = "SELECT qid, docid, i AS w0, greatest(start - 3, 0) AS low, stop FROM (SELECT *, row_number() OVER (PARTITION BY qid, docid ORDER BY hits DESC, i) AS r FROM wins WHERE i = 0 OR i + 16 <= n) WHERE r = 1"
    framed = f"SELECT h.qid, h.docid, {FULL} AS f, w0, low, least(stop + 3, length({FULL})) AS high FROM {hits} h JOIN docs USING (docid) LEFT JOIN best USING (qid, docid)"
    marked = 'SELECT qid, docid, string_agg(substr(f, prev + 1, start - prev) || \'**\' || substr(f, start + 1, "end" - start) || \'**\', \'\' ORDER BY start) AS told, max("end") AS till FROM (SELECT fr.qid, fr.docid, f, start, "end", coalesce(lag("end") OVER (PARTITION BY fr.qid, fr.docid ORDER BY start), low) AS prev FROM framed fr JOIN ws ON ws.qid = fr.qid AND ws.docid = fr.docid AND hit > 0 AND i >= w0 AND i < w0 + 16) GROUP BY ALL'
    text = "CASE WHEN w0 IS NULL THEN substr(f, 1, 140) ELSE CASE WHEN low > 0 THEN '…' ELSE '' END || coalesce(told, '') || substr(f, coalesce(till, low) + 1, high - coalesce(till, low)) || CASE WHEN high < length(f) THEN '…' ELSE '' END END"
    return f"SELECT qid, docid, {text} AS snippet FROM (WITH ws AS ({words_}), wins AS ({wins}), best AS ({best}), framed AS ({framed}), marked AS ({marked}) SELECT * FROM framed LEFT JOIN marked USING (qid, docid))"


def sql(select: str, **changed: str) -> str:
    """The select with the fragments that it and they name."""
    own = FRAGMENTS | changed
    need: list[str] = []

    def visit(text: str) -> None:
        for name in own:
            if name not in need and re.search(rf"(?<![\w.']){name}(?![\w(])", text):
                if name == "stems":
                    visit("raw_words")
                else:
                    visit_body(name)
                if name not in need:
                    need.append(name)

    busy: set[str] = set()

    def visit_body(name: str) -> None:
        if name not in busy:
            busy.add(name)
            visit(re.sub(rf"(?<!\w){name}(?!\w)", " ", own[name]))

    visit(select)
    parts = [stem_ctes("raw_words", "stems") if n == "stems" else f"{n} AS {'MATERIALIZED ' if n in MATERIALIZED else ''}({own[n]})" for n in need]
    return "WITH " + ",\n".join(parts) + "\n" + select


def shown(table: str, k: int = 10) -> str:
    return f"SELECT qid, rank, docid, round(score, 6) AS score FROM {table} WHERE rank <= {k}"


def badges(table: str) -> str:
    return (
        "SELECT r.qid, r.docid, r.rank, n_hits, coalesce(v.rank, 0) AS vsm_rank, CASE WHEN v.rank IS NULL THEN 'NEW' WHEN v.rank = r.rank THEN '=' WHEN v.rank > r.rank THEN '^' || (v.rank - r.rank) ELSE 'v' || (r.rank - v.rank) END AS rank_shift "
        f"FROM {table} r LEFT JOIN (SELECT qid, docid, rank FROM vsm WHERE rank <= 100) v ON v.qid = r.qid AND v.docid = r.docid WHERE r.rank <= 10"
    )


def gain(rank: str, k: int) -> str:
    return f"sum(CASE WHEN {rank} <= {k} THEN (pow(2, grade) - 1) / log2({rank} + 1) ELSE 0 END)"


SETS = (
    "SELECT qid, docid, max(v)::BIGINT AS in_vsm, max(p)::BIGINT AS in_phrase, max(s)::BIGINT AS in_sdm FROM (SELECT qid, docid, 1 AS v, 0 AS p, 0 AS s FROM vsm WHERE rank <= 10 "
    "UNION ALL SELECT qid, docid, 0, 1, 0 FROM phrase_ranked WHERE rank <= 10 UNION ALL SELECT qid, docid, 0, 0, 1 FROM sdm WHERE rank <= 10) GROUP BY ALL"
)
PART_DOCS = "SELECT p_partkey AS docid, p_type AS category, p_name AS title, p_brand AS text FROM part"


def oracle_sql() -> dict[str, str]:
    phrases = {"queries": values(PHRASES)}
    trim = lambda c: f"regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"
    out = {
        "tagged_source": sql(f"SELECT docid::VARCHAR AS docid, {trim('category')} AS category, {trim('title')} AS title, {trim('text')} AS text FROM docs"),
        "tokenize": sql(f"SELECT token, count(*) AS n, count(DISTINCT docid) AS n_docs FROM (SELECT docid, lower(unnest(regexp_extract_all({FULL}, '[a-zA-Z0-9]+'))) AS token FROM docs) GROUP BY token"),
        "stopwords": sql(f"SELECT docid, len(regexp_extract_all({FULL}, '[a-zA-Z0-9]+')) AS n_tokens, len({words(FULL)}) AS n_words FROM docs"),
        "porter_stem": sql("SELECT raw, term FROM stems WHERE raw IN (SELECT raw FROM raw_tokens)"),
        "spans": sql('SELECT docid, i, raw, start, "end", term FROM word_spans'),
        "positional_index": sql("SELECT term, docid, tf, array_to_string(positions, ',') AS positions FROM postings"),
        "inverted_index": sql("SELECT term, docid, tf FROM postings"),
        "title_index": sql("SELECT term, docid, tf FROM title_postings"),
        "vocabulary": sql("SELECT term, df FROM terms"),
        "doc_lengths": sql("SELECT docid, dl FROM doc_stats"),
        "collection_stats": sql("SELECT n, round(avgdl, 6) AS avgdl FROM coll"),
        "tf_stats": sql("SELECT docid, max_tf, round(avg_tf, 6) AS avg_tf, n_unique, char_len FROM doc_stats"),
        "doc_vectors_lnc": sql("SELECT term, docid, round(lnc, 6) AS w FROM doc_w"),
        "idf_vsm": sql("SELECT term, df, round(log10(n / df::DOUBLE), 6) AS idf FROM terms, coll"),
        "idf_bm25": sql("SELECT term, df, round(ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1), 6) AS idf FROM terms, coll"),
        "query_vector_ltc": sql("SELECT qid, term, round(w, 6) AS w FROM query_w"),
        "oov_terms": sql("SELECT qid, term FROM q_terms WHERE term NOT IN (SELECT term FROM terms)"),
        "search_vsm": sql(shown("vsm")),
        "search_bm25": sql(shown("bm25")),
        "search_fielded": sql(shown("fielded")),
        "search_sdm_vsm": sql(shown("sdm")),
        "search_sdm_bm25": sql(shown("sdm_bm25")),
        "sdm_evidence": sql("SELECT qid, docid, ordered, unordered FROM evidence"),
        "candidate_docs": sql("SELECT qid, docid FROM candidates", **phrases),
        "phrase": sql("SELECT qid, docid, start FROM phrase_hits", **phrases),
        "rank_shift": sql(badges("phrase_ranked"), **phrases),
        "levenshtein": sql("SELECT term, levenshtein(term, 'attion') AS distance FROM terms"),
        "suggest_correction": sql("SELECT term, suggestion, distance FROM suggested"),
        "corrected_query": sql("SELECT qid, text FROM corrected"),
        "snippet": sql(snippet_of("snippet_hits")),
        "dcg": sql(f"SELECT qid, round({gain('rank', 10)}, 6) AS dcg FROM (SELECT qid, rank, coalesce(quality, 0) AS grade FROM vsm LEFT JOIN labels ON doc_id = docid WHERE rank <= 10) GROUP BY qid"),
        "judgments_rule": sql("SELECT qid, docid, grade::BIGINT AS grade FROM graded_pool"),
        "ndcg_report": sql(
            "SELECT ranker, qid, " + ", ".join(f"round(CASE WHEN {gain('ideal', k)} > 0 THEN {gain('rank', k)} / {gain('ideal', k)} ELSE 0 END, 6) AS ndcg_at_{k}" for k in (10, 5)) + ", string_agg(docid::VARCHAR, ',' ORDER BY rank) AS ranked_docids FROM graded GROUP BY ALL"
        ),
        "result_sets": sql(SETS, **phrases),
        "result_sets_common_term": sql(SETS, docs=PART_DOCS, queries=values(COMMON)),
        "markdown_report": sql("SELECT line, value FROM (SELECT 0::BIGINT AS line, '| qid | rank | docid |' AS value UNION ALL SELECT 1, '|---|---|---|' UNION ALL SELECT 1 + row_number() OVER (ORDER BY qid, rank), '| ' || qid || ' | ' || rank || ' | ' || docid || ' |' FROM vsm WHERE rank <= 10)"),
        "index_dump_inverted": sql("SELECT term, rpad(term, greatest(15, length(term))::INTEGER, ' ') || ' df=' || rpad(count(*)::VARCHAR, greatest(4, length(count(*)::VARCHAR))::INTEGER, ' ') || ' -> [' || string_agg('(' || docid || ',' || tf || ')', ', ' ORDER BY docid) || ']' AS value FROM postings GROUP BY term"),
        "index_dump_positional": sql("SELECT term, rpad(term, greatest(15, length(term))::INTEGER, ' ') || ' df=' || rpad(count(*)::VARCHAR, greatest(4, length(count(*)::VARCHAR))::INTEGER, ' ') || ' ->' || chr(10) || '    [' || string_agg('(' || docid || ',' || tf || ',[' || array_to_string(positions, ', ') || '])', ',' || chr(10) || '     ' ORDER BY docid) || ']' || chr(10) AS value FROM postings GROUP BY term"),
        "batch_search_vsm": sql(shown("vsm"), queries="SELECT item_id AS qid, text FROM benchmark"),
        "batch_search_bm25": sql(shown("bm25"), queries="SELECT item_id AS qid, text FROM benchmark"),
        "part_search_vsm": sql(shown("vsm"), queries=values(PARTS), docs=PART_DOCS),
    }
    out["batch_suggest_correction"] = sql("SELECT term, suggestion, distance FROM suggested", queries="SELECT item_id AS qid, regexp_replace(text, '([a-z]{3})[a-z]', '\\1', 'g') AS text FROM benchmark")
    # an index that grew finds what one built at once finds
    out |= {f"grown_{name}": out[name] for name in ("vocabulary", "tf_stats", "search_vsm", "search_bm25", "sdm_evidence", "candidate_docs")}
    for d, q in SCHEMES:
        own = {"smart_scores": smart(d, q)} | ranked("smart_list", "smart_scores")
        out[f"smart_{d}_{q}"] = sql(shown("smart_list"), **own)
    # words of the pairs are stemmed with the others
    more = {"raw_words": FRAGMENTS["raw_words"] + " UNION ALL SELECT ra FROM pair_raw UNION ALL SELECT rb FROM pair_raw", "queries": "SELECT qid, a || ' ' || b AS text FROM pairs"}
    out["proximity_ordered"] = sql("SELECT qid, docid, pa, pb FROM pair_hits WHERE pb > pa", **more)
    out["proximity_unordered"] = sql("SELECT qid, docid, pa, pb FROM pair_hits", **more)
    pair_ranked = "SELECT *, row_number() OVER (PARTITION BY qid ORDER BY n_hits DESC, docid) AS rank FROM (SELECT qid, docid, count(*) AS n_hits FROM pair_hits WHERE pb > pa GROUP BY ALL)"
    out["rank_shift_proximity"] = sql(badges("pair_ranked"), pair_ranked=pair_ranked, **more)
    # the corrected stems are analyzed again
    again = {
        "raw_again": f"SELECT qid, unnest({words('text')}) AS raw FROM corrected",
        "vocabulary_again": "SELECT DISTINCT raw FROM raw_again",
        "again_terms": "SELECT qid, term, count(*) AS qtf FROM raw_again JOIN stems_again USING (raw) GROUP BY ALL",
        "again_raw": "SELECT qid, term, CASE WHEN df IS NULL OR df >= n THEN 0.0::DOUBLE ELSE (1 + log10(qtf)) * log10(n / df::DOUBLE) END AS raw FROM again_terms LEFT JOIN terms USING (term), coll",
        "again_w": "SELECT qid, term, raw / coalesce(nullif(sqrt(sum(raw * raw) OVER (PARTITION BY qid)), 0), 1) AS w FROM again_raw",
        "again_scores": "SELECT qid, docid, sum(w * lnc) AS score FROM again_w JOIN doc_w USING (term) WHERE w <> 0 GROUP BY ALL",
    } | ranked("again", "again_scores")
    base = sql("SELECT 1 FROM corrected, terms, coll, doc_w, vocabulary_again", **{k: again[k] for k in ("raw_again", "vocabulary_again")}).rsplit("\n", 1)[0]
    rest = ",\n".join(f"{k} AS ({again[k]})" for k in ("again_terms", "again_raw", "again_w", "again_scores", "again"))
    out["typo_search"] = f"{base},\n{stem_ctes('vocabulary_again', 'stems_again')},\n{rest}\n{shown('again')}"
    first = "coalesce(min(v.rank), 1000)"
    out["rank_divergence"] = sql(
        "SELECT x.qid, x.docid, x.moved, coalesce(e.ordered, 0) AS ordered_hits FROM moved_docs x LEFT JOIN evidence e ON e.qid = x.qid AND e.docid = x.docid",
        parting=f"SELECT v.qid, {first} AS first FROM vsm v JOIN sdm s ON s.qid = v.qid AND s.rank = v.rank AND s.docid <> v.docid WHERE v.rank <= 10 GROUP BY v.qid",
        near_v="SELECT v.qid, docid FROM vsm v JOIN parting d ON d.qid = v.qid WHERE rank <= 10 AND rank < first + 3",
        near_s="SELECT s.qid, docid FROM sdm s JOIN parting d ON d.qid = s.qid WHERE rank <= 10 AND rank < first + 3",
        moved_docs="SELECT qid, docid, 'promoted' AS moved FROM (SELECT * FROM near_s EXCEPT SELECT * FROM near_v) UNION ALL SELECT qid, docid, 'demoted' FROM (SELECT * FROM near_v EXCEPT SELECT * FROM near_s)",
    )
    out["formatted_results"] = sql(
        "SELECT b.qid, b.rank, b.docid, title, category, round(score, 4) AS score, snippet FROM bm25 b JOIN docs USING (docid) JOIN shown_snippets s ON s.qid = b.qid AND s.docid = b.docid WHERE rank <= 5",
        shown_hits="SELECT qid, docid FROM bm25 WHERE rank <= 5",
        shown_snippets=snippet_of("shown_hits"),
    )
    return out
