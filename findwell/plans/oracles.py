"""The queries in DuckDB's SQL, written against the tables and not derived from Spark plans."""

from __future__ import annotations

from findwell.config import TAG_WEIGHTS
from findwell.functions.stemming import stem_ctes
from findwell.functions.text import prepare_query
from findwell.plans.queries import BATCH, FLAGSHIP, PREPARED, QUERY_TEXTS
from findwell.sources.pages import META_NAMES, VOID_TAGS

SPLIT = "[^a-zA-Z0-9]+"


def words(text: str) -> str:
    return f"list_transform(list_filter(string_split_regex({text}, '{SPLIT}'), lambda w: w <> ''), lambda w: lower(w))"


TOKS = f"""toks AS (SELECT doc_id, 'http://' || source || '/' || doc_id AS url, {words("coalesce(text, '')")} AS ws FROM documents),
occ AS (SELECT doc_id, r.i - 1 AS pos, ws[r.i] AS token FROM toks, unnest(range(1, len(ws) + 1)) AS r(i))"""
DOCS = "docs AS (SELECT doc_id, url, len(ws) AS doc_len, md5(array_to_string(list_transform(ws, lambda w: 'p:' || w), ' ')) AS content_hash FROM toks)"
POSTS = "posts AS (SELECT token, o.doc_id, d.url, count(*)::DOUBLE / d.doc_len AS frequency, 10.0::DOUBLE AS tag, count(*) AS n, string_agg(pos::VARCHAR, ',' ORDER BY pos) AS positions FROM occ o JOIN docs d ON o.doc_id = d.doc_id GROUP BY token, o.doc_id, d.url, d.doc_len)"
DFS = "dfs AS (SELECT token, count(DISTINCT doc_id) AS df FROM occ GROUP BY token)"
REPS = """groups AS (SELECT content_hash, count(*) AS n_docs, arg_min(url, (length(url), url)) AS rep_url FROM docs GROUP BY content_hash),
aliases AS (SELECT DISTINCT url, rep_url FROM docs JOIN groups USING (content_hash)),
kept AS (SELECT min(doc_id) AS doc_id, rep_url AS url FROM docs JOIN groups USING (content_hash) GROUP BY rep_url)"""
KEPT_POSTS = "posts AS (SELECT token, o.doc_id, k.url, count(*)::DOUBLE / d.doc_len AS frequency, 10.0::DOUBLE AS tag FROM occ o JOIN kept k ON o.doc_id = k.doc_id JOIN docs d ON o.doc_id = d.doc_id GROUP BY token, o.doc_id, k.url, d.doc_len)"
PARTS = "len(string_split(regexp_extract(url, '^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1), '/'))"
TAGS = "CASE t " + " ".join(f"WHEN '{t}' THEN {w}::DOUBLE" for t, w in TAG_WEIGHTS.items()) + " ELSE 0.0::DOUBLE END"

_VOID = ", ".join(f"'{t}'" for t in VOID_TAGS)
_NAMES = ", ".join(f"'{t}'" for t in META_NAMES)
_CLEAN = "regexp_replace(regexp_replace(regexp_replace(html, '<!--.*?-->', '<!>', 'gs'), '<script[^>]*>.*?</script>', '<!>', 'gis'), '<style[^>]*>.*?</style>', '<!>', 'gis')"
_RUN = "<([a-zA-Z][a-zA-Z0-9]*)[^>]*>([^<]*)"
_PLAIN = "regexp_replace(txt, '&([a-zA-Z][a-zA-Z0-9]*;|amp|quot|lt|gt|apos|copy|middot|nbsp)', ' ', 'g')"


def _attr(name: str) -> str:
    return f"concat(regexp_extract(m, '(?i)[\\s\"'']{name}\\s*=\\s*\"([^\"]*)\"', 1), regexp_extract(m, '(?i)[\\s\"'']{name}\\s*=\\s*''([^'']*)''', 1))"


def metas(html: str) -> str:
    return f"metas AS (SELECT page_id, i, concat({_attr('content')}, ' ', {_attr('value')}, ' ') AS txt FROM (SELECT page_id, i, ms[i] AS m FROM (SELECT page_id, regexp_extract_all({html}, '(?i)<meta[^>]*>') AS ms FROM pages) x, unnest(range(1, len(ms) + 1)) AS r(i)) y WHERE {_attr('name')} IN ({_NAMES}))"


SEGS = f"""{metas("html")},
lexed AS (SELECT page_id, regexp_extract_all(h, '{_RUN}', 1) AS tags, regexp_extract_all(h, '{_RUN}', 2) AS txts FROM (SELECT page_id, {_CLEAN} AS h FROM pages) x),
runs AS (SELECT page_id, 1 AS part, i, lower(tags[i]) AS tag, txts[i] AS txt FROM lexed, unnest(range(1, len(tags) + 1)) AS r(i)),
segs AS (SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY part, i) - 1 AS seg, tag, {_PLAIN} AS txt FROM (SELECT * FROM runs WHERE tag NOT IN ({_VOID}) UNION ALL SELECT page_id, 0, i, 'meta', txt FROM metas) x)"""
PAGE_OCC = f"""{SEGS},
pw AS (SELECT page_id, seg, tag, {words("txt")} AS ws FROM segs),
pocc AS (SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY seg, j) - 1 AS pos, tag, ws[j] AS token FROM pw, unnest(range(1, len(ws) + 1)) AS r(j))"""
# of one occurrence table: tags in the order of first use, at most 100
TAGGED = f"""firsts AS (SELECT doc_id, token, tag, min(pos) AS first_pos FROM occ GROUP BY doc_id, token, tag),
tagged AS (SELECT doc_id, token, 10.0::DOUBLE * (1.0::DOUBLE + list_sum(list_transform(list_slice(list(tag ORDER BY first_pos), 1, 100), lambda t: {TAGS}))) AS tag FROM firsts GROUP BY doc_id, token)"""


def rank_ctes(queries: list[tuple[int, list[str], int]], mode: str, size: str, most_postings: int = -1, compat: bool = False) -> str:
    """From posts (token, doc_id, url, frequency, tag), occ (doc_id, pos, token) to ranked (qid, rank, doc_id, url, score)."""
    values = ", ".join(f"({q}, {k}, '{t}', {tol})" for q, terms, tol in queries for k, t in enumerate(terms))
    both = "HAVING count(*) = max(found)" if mode == "and" else ""
    times = "greatest(found - 1, 1)" if mode == "and" else "n"
    first = f"QUALIFY row_number() OVER (PARTITION BY qid, k ORDER BY p.doc_id) <= {most_postings}" if most_postings >= 0 else ""
    return f"""qt(qid, k, term, tolerance) AS (VALUES {values}),
qdf AS (SELECT token, count(*) AS df FROM posts GROUP BY token),
known AS (SELECT qt.*, df, count(*) OVER (PARTITION BY qid) AS found FROM qt JOIN qdf ON term = token),
hits AS (SELECT qid, k, term, tolerance, found, p.doc_id, p.url, 50.0::DOUBLE * p.frequency * log10(({size})::DOUBLE / df) + p.tag AS base, 5.0::DOUBLE / {PARTS} AS depth FROM posts p JOIN known ON p.token = known.term {first}),
per AS (SELECT qid, doc_id, url, sum(base) AS base, count(*) AS n, max(found) AS found, max(depth) AS depth FROM hits GROUP BY qid, doc_id, url {both}),
places AS (SELECT h.qid, h.doc_id, h.k, h.tolerance, o.pos FROM hits h JOIN occ o ON o.doc_id = h.doc_id AND o.token = h.term WHERE h.found > 1),
gaps AS (SELECT *, lag(pos) OVER (PARTITION BY qid, doc_id ORDER BY pos, k) AS before FROM places),
labelled AS (SELECT *, sum(CASE WHEN before IS NOT NULL AND before <> 0 AND pos - before > tolerance THEN 1 ELSE 0 END) OVER (PARTITION BY qid, doc_id ORDER BY pos, k ROWS UNBOUNDED PRECEDING)::BIGINT AS run FROM gaps),
prun AS (SELECT qid, doc_id, run, count(DISTINCT k) AS n_terms FROM labelled GROUP BY qid, doc_id, run),
boosts AS (SELECT r.qid, r.doc_id, count(*) * 10.0::DOUBLE AS boost FROM prun r JOIN (SELECT DISTINCT qid, found FROM known) f ON r.qid = f.qid WHERE n_terms >= found {"AND found < 3" if compat else ""} GROUP BY r.qid, r.doc_id),
scored AS (SELECT per.qid, per.doc_id, url, round(base + {times} * depth + coalesce(boost, 0.0), 6) AS score FROM per LEFT JOIN boosts ON per.qid = boosts.qid AND per.doc_id = boosts.doc_id),
ranked AS (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank, doc_id, url, score FROM scored QUALIFY rank <= 250)"""


N_DOCS = "SELECT count(*) FROM documents"
BASE = f"WITH {TOKS}, {DOCS}"


def one(name: str, mode: str, tail: str = "SELECT rank, doc_id, score FROM ranked", **more) -> str:
    return f"{BASE}, {POSTS}, {rank_ctes([(0, *PREPARED[name])], mode, N_DOCS, **more)} {tail}"


def _prepared_rows() -> str:
    """Query preparation in SQL: split, lower, stem, stop, order, tolerance."""
    texts = ", ".join(f"({q}, '{t}')" for q, t in QUERY_TEXTS.items())
    from findwell.functions.text import STOP_WORDS

    stops = ", ".join(f"('{w}')" for w in STOP_WORDS)
    return f"""WITH q(qid, txt) AS (VALUES {texts}),
qw AS (SELECT qid, {words("txt")} AS ws FROM q),
raw AS (SELECT qid, i, ws[i] AS word FROM qw, unnest(range(1, len(ws) + 1)) AS r(i)),
stop(word) AS (VALUES {stops}),
allw AS (SELECT word FROM raw UNION SELECT word FROM stop),
{stem_ctes("allw")},
terms AS (SELECT qid, i, stem AS term, stem IN (SELECT stem FROM stems JOIN stop USING (word)) AS stopped FROM raw JOIN stems USING (word)),
kept AS (SELECT *, bool_and(stopped) OVER (PARTITION BY qid) AS only_stops FROM terms),
tol AS (SELECT qid, 1 + count(*) FILTER (stopped AND NOT only_stops) AS tolerance FROM kept GROUP BY qid),
firsts AS (SELECT qid, term, min(i) AS i FROM kept WHERE only_stops OR NOT stopped GROUP BY qid, term)
SELECT qid::BIGINT AS qid, row_number() OVER (PARTITION BY qid ORDER BY i) - 1 AS k, term, tolerance FROM firsts JOIN tol USING (qid)"""


_flag_terms, _flag_tol = prepare_query(FLAGSHIP)
FULL_PAGES = f"""WITH {PAGE_OCC},
hashes AS (SELECT page_id, md5(array_to_string(list(tag || ':' || token ORDER BY pos), ' ')) AS content_hash, count(*) AS doc_len FROM pocc GROUP BY page_id),
docs AS (SELECT p.page_id AS doc_id, url, coalesce(doc_len, 0) AS doc_len, coalesce(content_hash, md5('')) AS content_hash FROM pages p LEFT JOIN hashes h ON p.page_id = h.page_id),
{REPS},
{stem_ctes("pocc", "token")},
occ AS (SELECT k.doc_id, pos, tag, stem AS token FROM pocc JOIN stems ON token = word JOIN kept k ON k.doc_id = page_id WHERE stem IN ({", ".join(f"'{t}'" for t in _flag_terms)})),
{TAGGED},
posts AS (SELECT o.token, o.doc_id, k.url, count(*)::DOUBLE / d.doc_len AS frequency, any_value(t.tag) AS tag FROM occ o JOIN kept k ON k.doc_id = o.doc_id JOIN docs d ON d.doc_id = o.doc_id JOIN tagged t ON t.doc_id = o.doc_id AND t.token = o.token GROUP BY o.token, o.doc_id, k.url, d.doc_len),
{rank_ctes([(0, _flag_terms, _flag_tol)], "and", "SELECT count(*) FROM pages")}
SELECT rank, doc_id AS page_id, url, score FROM ranked"""

_AND2 = f"{BASE}, {POSTS}, {rank_ctes([(0, *PREPARED['and2'])], 'or', N_DOCS)}"
_A, _B = PREPARED["and2"][0]

ORACLE_SQL = {
    "tokenize_documents": f"WITH {TOKS} SELECT doc_id, pos, token FROM occ",
    "tokenize_pages": f"WITH {PAGE_OCC} SELECT page_id, pos, tag, token FROM pocc",
    "page_segments": f"WITH {SEGS} SELECT page_id, seg, tag, txt FROM segs",
    "meta_segments": "WITH " + metas("'<meta name=\"keywords\" content=\"' || url || '\">' || html") + " SELECT page_id, txt FROM metas",
    "stem_vocab": f"WITH {TOKS}, {stem_ctes('occ', 'token')} SELECT word, stem FROM stems",
    "doc_lengths": f"{BASE} SELECT doc_id, doc_len FROM docs",
    "corpus_size": "SELECT count(*) AS corpus_size FROM documents",
    "index_meta": "SELECT 'documents' AS index_name, count(*) AS corpus_size FROM documents",
    "postings": f"{BASE}, {POSTS} SELECT token, doc_id, url, round(frequency, 9) AS frequency, 'p' AS tags, positions FROM posts",
    "vocab_df": f"WITH {TOKS}, {DFS} SELECT token, df FROM dfs",
    "vocab_stats": f"WITH {TOKS} SELECT count(DISTINCT token) AS n_tokens, count(DISTINCT token) FILTER (NOT regexp_full_match(token, '[0-9]+')) AS n_not_numeric FROM occ",
    "vocab_ceiling": f"WITH {TOKS}, p(probe) AS (VALUES ('a'), ('heeb'), ('thz'), ('zzzzzz')) SELECT probe, (SELECT min(token) FROM occ WHERE token >= probe) AS token FROM p",
    "doc_successor": f"WITH {TOKS}, d AS (SELECT DISTINCT token, doc_id FROM occ) SELECT token, doc_id, lead(doc_id) OVER (PARTITION BY token ORDER BY doc_id) AS next_doc FROM d",
    "term_postings": f"{BASE}, {POSTS} SELECT doc_id, url, round(frequency, 9) AS frequency, n FROM posts WHERE token = 'heed'",
    "duplicate_groups": f"{BASE}, {REPS} SELECT content_hash, n_docs, rep_url FROM groups",
    "alias_map": f"{BASE}, {REPS} SELECT url, rep_url FROM aliases",
    "alias_conflicts": f"{BASE}, {REPS} SELECT url, count(*) AS n FROM aliases GROUP BY url HAVING count(*) > 1",
    "dedup_postings": f"{BASE}, {REPS} SELECT token, o.doc_id, k.url, round(count(*)::DOUBLE / doc_len, 9) AS frequency FROM occ o JOIN kept k ON o.doc_id = k.doc_id JOIN docs d ON d.doc_id = o.doc_id GROUP BY token, o.doc_id, k.url, doc_len",
    "df_after_dedup": f"{BASE}, {REPS} SELECT token, count(DISTINCT o.doc_id) AS df FROM occ o JOIN kept k ON o.doc_id = k.doc_id GROUP BY token",
    "url_depth": f"SELECT page_id, {PARTS} AS parts, round(5.0::DOUBLE / {PARTS}, 6) AS depth_score FROM pages",
    "tag_scores": f"WITH {PAGE_OCC}, occ AS (SELECT page_id AS doc_id, pos, tag, token FROM pocc), {TAGGED} SELECT token, doc_id AS page_id, round(tag, 6) AS tag_score FROM tagged",
    "idf": f"WITH {TOKS}, {DFS} SELECT token, round(log10(({N_DOCS})::DOUBLE / df), 6) AS idf FROM dfs",
    "tfidf": f"{BASE}, {POSTS}, {DFS} SELECT token, doc_id, round(50.0::DOUBLE * frequency * log10(({N_DOCS})::DOUBLE / df), 6) AS tfidf FROM posts JOIN dfs USING (token)",
    "query_prepare": _prepared_rows(),
    "search_single": one("single", "or"),
    "search_or": one("or", "or"),
    "search_and2": one("and2", "and"),
    "search_and3": one("and3", "and"),
    "search_and_missing_term": one("missing", "and"),
    "search_all_stopwords": one("stop", "and"),
    "candidate_difference": f"WITH {TOKS} SELECT DISTINCT doc_id FROM occ WHERE token = '{_A}' AND doc_id NOT IN (SELECT doc_id FROM occ WHERE token = '{_B}')",
    "max_postings_or": one("or", "or", most_postings=20),
    "phrase_runs": f"{_AND2} SELECT doc_id, run, n_terms FROM prun",
    "ngram_boost": f"{_AND2} SELECT doc_id, count(*) * 10.0::DOUBLE AS boost FROM prun WHERE n_terms >= 2 GROUP BY doc_id",
    "ngram_boost_compat": one("and3", "and", compat=True),
    "bigram_boost": f"{_AND2} SELECT doc_id, CASE WHEN bool_or(coalesce(pos - before <= 1, false)) THEN 10.0::DOUBLE ELSE 0.0::DOUBLE END AS boost FROM gaps GROUP BY doc_id",
    "search_full_pages": FULL_PAGES,
    "result_page_2": one("and3", "or", "SELECT rank, doc_id, score FROM ranked WHERE rank BETWEEN 16 AND 30"),
    "result_count": one("and3", "and", "SELECT count(*) AS n_results FROM ranked"),
    "index_merge": f"WITH {TOKS}, {DFS} SELECT token, df FROM dfs",
    "batch_search": f"{BASE}, {POSTS}, {rank_ctes([(q, *prepare_query(t, stemmed=False)) for q, t in BATCH.items()], 'and', N_DOCS)} SELECT qid::BIGINT AS qid, rank, doc_id, score FROM ranked",
    "skip_sample": f"WITH {TOKS}, p AS (SELECT DISTINCT token, doc_id FROM occ) SELECT token, doc_id FROM p WHERE ('0x' || substr(md5('0:' || token || ':' || doc_id), 1, 13))::BIGINT < {int(0.05 * (1 << 52))}",
    "result_page_label": one("and3", "or", "SELECT concat(CASE WHEN least(30, count(*)) > 0 THEN 16 ELSE 0 END, ' to ', least(30, count(*))) AS label, true AS has_previous, count(*) > 30 AS has_next FROM ranked"),
    "index_order": "SELECT 'postings' AS part, 0::BIGINT AS n_wrong UNION ALL SELECT 'vocab', 0::BIGINT",
    "corpus_read": "SELECT url, 'utf-8' AS encoding, md5(html) AS content_md5 FROM pages",
    "index_search": f"{BASE}, {REPS}, {KEPT_POSTS}, {rank_ctes([(q, *prepare_query(t, stemmed=False)) for q, t in BATCH.items()], 'and', N_DOCS)} SELECT qid::BIGINT AS qid, rank, doc_id, url, score FROM ranked",
}
ORACLE_SQL["postings_json"] = ORACLE_SQL["postings"]
ORACLE_SQL["index_stored"] = ORACLE_SQL["dedup_postings"]
ORACLE_SQL["index_merge_distinct"] = ORACLE_SQL["df_after_dedup"]
