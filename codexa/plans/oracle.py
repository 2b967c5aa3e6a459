"""For each query the same result in SQL for DuckDB, on the same adapter."""

from __future__ import annotations

from codexa.operators.sync import RELATIONS
from codexa.plans.queries import ABOUT, AS_OF, BASE_URL, FIRST_CLOSE, FORMATS, IMPORTED, LANGUAGE, LATE, LATEST, LEAST, LEFT, MESSAGES, NOW, PAGES_A_FILE, PRIOR_BEFORE
from codexa.sources.tables import CONTENT, DDL, SQL

_CHAPTERS = "SELECT DISTINCT v.translation, v.book_number, v.chapter_number FROM translation_verses v WHERE EXISTS (SELECT 1 FROM translation_books b WHERE b.translation = v.translation AND b.book_number = v.book_number)"
_INFO = "SELECT tb.translation, tb.code, tb.book_number, tb.name, bb.code1 AS alias, bb.code2, bb.code3, bb.code4, bb.code5, bb.short_name_en, bb.short_name_ru, (SELECT max(chapter_number) FROM translation_verses x WHERE x.book_number = tb.book_number) AS chapters_count FROM translation_books tb LEFT JOIN bible_books bb ON bb.number = tb.book_number"
_LOG = """SELECT CASE WHEN path LIKE '/api/audio/_%' THEN '/api/audio/*' WHEN regexp_matches(path, '^/api/translations/[0-9]+/books') THEN '/api/translations/*/books' ELSE path END AS endpoint, method, status_code,
    CAST(trunc(elapsed_s * 1000) AS INT) AS response_time_ms, CASE WHEN forwarded <> '' THEN trim(split_part(forwarded, ',', 1)) ELSE coalesce(peer, 'unknown') END AS client_ip, left(coalesce(user_agent, ''), 512) AS user_agent, created_at
    FROM raw_requests WHERE path LIKE '/api/%' AND status_code NOT IN (403, 404)"""


def _stats(source: str) -> str:
    measures = "count(*) AS request_count, count(DISTINCT client_ip) AS unique_ips, round(avg(response_time_ms)) AS avg_response_time_ms, CAST(sum(CASE WHEN status_code >= 400 THEN 1 ELSE 0 END) AS BIGINT) AS error_count"
    return f"SELECT CAST(created_at AS DATE) AS date, endpoint, {measures} FROM {source} GROUP BY 1, 2 UNION ALL SELECT CAST(created_at AS DATE), '_total_', {measures} FROM {source} GROUP BY 1"


_REQUESTS = """SELECT code AS request_id, translation, CASE WHEN code % 3 = 0 THEN code % 100 END AS voice,
    CASE code % 5 WHEN 0 THEN p WHEN 1 THEN 'X' || p || ':1-3; bk2 1' WHEN 2 THEN p || ':' || verse_number WHEN 3 THEN p || ':2-0' ELSE CASE WHEN code % 2 = 0 THEN 'no part' ELSE 'zz9 1, ' || p END END AS excerpt
    FROM (SELECT *, 'b' || book_number || ' ' || chapter_number AS p FROM translation_verses)"""
_R = "([0-9a-z]+) ([0-9]+)(:([0-9]+)(?:-([0-9]+))?)?"
_PARTS = f"""SELECT request_id, translation, voice, excerpt, i - 1 AS part_index, regexp_extract(m, '{_R}', 1) AS book, CAST(regexp_extract(m, '{_R}', 2) AS INT) AS chapter_number, nullif(regexp_extract(m, '{_R}', 4), '') AS s, nullif(regexp_extract(m, '{_R}', 5), '') AS e
    FROM (SELECT *, unnest(regexp_extract_all(excerpt, '{_R}')) AS m, generate_subscripts(regexp_extract_all(excerpt, '{_R}'), 1) AS i FROM requests)"""
_LABELLED = """SELECT request_id, translation, voice, excerpt, part_index, book, chapter_number, CAST(s AS INT) AS start_verse, coalesce(nullif(CAST(e AS INT), 0), CAST(s AS INT)) AS end_verse,
    book || ' ' || chapter_number || CASE WHEN s IS NULL THEN '' WHEN e IS NULL OR e = s THEN ':' || s ELSE ':' || s || '-' || e END AS label FROM parts0"""
_PREV = """SELECT c.translation, c.book_number, c.chapter_number,
    CASE WHEN c.chapter_number > 1 THEN i.alias || ' ' || (c.chapter_number - 1) WHEN c.book_number = 1 THEN '' WHEN b.number IS NULL THEN NULL WHEN p.code IS NULL THEN '' ELSE b.code1 || ' ' || coalesce(CAST(p.chapters_count AS VARCHAR), 'None') END AS prev_excerpt,
    CASE WHEN c.chapter_number = 1 AND c.book_number <> 1 AND b.number IS NULL THEN 'Book ''' || (c.book_number - 1) || ''' not found.' END AS error
    FROM chapters c JOIN info i ON i.translation = c.translation AND i.book_number = c.book_number LEFT JOIN bible_books b ON b.number = c.book_number - 1 LEFT JOIN info p ON p.translation = c.translation AND p.book_number = c.book_number - 1"""
_NEXT = """SELECT c.translation, c.book_number, c.chapter_number,
    CASE WHEN c.chapter_number < i.chapters_count THEN i.alias || ' ' || (c.chapter_number + 1) WHEN c.book_number = 66 THEN '' ELSE b.code1 || ' 1' END AS next_excerpt,
    CASE WHEN NOT c.chapter_number < i.chapters_count AND c.book_number <> 66 AND b.number IS NULL THEN 'Book ''' || (c.book_number + 1) || ''' not found.' END AS error
    FROM chapters c JOIN info i ON i.translation = c.translation AND i.book_number = c.book_number LEFT JOIN bible_books b ON b.number = c.book_number + 1"""
_VERSES = """SELECT r.*, v.code, v.verse_number, CASE WHEN a."begin" IS NULL OR a."end" IS NULL THEN 0.0::DOUBLE ELSE a."begin" END AS b0, CASE WHEN a."begin" IS NULL OR a."end" IS NULL THEN 0.0::DOUBLE ELSE a."end" END AS e0, v.text, v.start_paragraph
    FROM {0} r JOIN translation_verses v ON v.translation = r.translation AND v.book_number = r.book_number AND v.chapter_number = r.chapter_number AND (r.start_verse IS NULL OR v.verse_number BETWEEN r.start_verse AND r.end_verse)
    LEFT JOIN voice_alignments a ON a.voice = r.voice AND a.book_number = r.book_number AND a.chapter_number = r.chapter_number AND a.verse_number = v.verse_number"""
_MATCHED = """SELECT p.*, i.code AS book_code, i.book_number, i.name AS book_name, i.alias, t.alias AS translation_alias, s.alias AS voice_alias,
    CASE WHEN p.voice <> 0 AND s.alias IS NULL THEN 'Voice ' || p.voice || ' not found for translation ' || p.translation || '.' END AS voice_error
    FROM (SELECT r.request_id, r.translation, r.voice, r.excerpt, x.part_index, x.book, x.chapter_number, x.start_verse, x.end_verse, x.label FROM requests r LEFT JOIN parts x ON x.request_id = r.request_id) p
    LEFT JOIN info i ON i.translation = p.translation AND p.book IN (i.alias, i.code2, i.code3, i.code4, i.code5, i.short_name_en, i.short_name_ru)
    LEFT JOIN translations t ON t.code = p.translation AND t.active = 1 LEFT JOIN voices s ON s.code = p.voice AND s.active = 1 AND p.voice <> 0 AND s.translation = t.code"""
_JUDGED = """SELECT m.*, coalesce(n.n, 0) AS n_verses, pe.prev_excerpt, ne.next_excerpt, n.verse_codes, n.seconds,
    CASE WHEN translation_alias IS NULL THEN 'Translation ' || m.translation || ' not found.' WHEN voice_error IS NOT NULL THEN voice_error WHEN m.part_index IS NULL THEN 'Invalid excerpt format (' || m.excerpt || ').'
    WHEN m.book_number IS NULL THEN 'Book with alias ''' || m.book || ''' not found for translation ' || m.translation || '.' WHEN n.n IS NULL THEN 'No verses found for ' || m.label || '.' ELSE coalesce(pe.error, ne.error) END AS part_error
    FROM matched m LEFT JOIN (SELECT request_id, part_index, count(*) AS n, string_agg(CAST(code AS VARCHAR), ',' ORDER BY verse_number, code) AS verse_codes, sum(e0 - b0) AS seconds FROM hit GROUP BY 1, 2) n ON n.request_id = m.request_id AND n.part_index = m.part_index
    LEFT JOIN prevs pe ON pe.translation = m.translation AND pe.book_number = m.book_number AND pe.chapter_number = m.chapter_number LEFT JOIN nexts ne ON ne.translation = m.translation AND ne.book_number = m.book_number AND ne.chapter_number = m.chapter_number"""
_TITLED = """SELECT request_id, count(part_index) AS n_parts, arg_min(part_error, coalesce(part_index, -1)) FILTER (part_error IS NOT NULL) AS error, max(CASE WHEN start_verse IS NULL THEN 0 ELSE 1 END) AS ranged, any_value(excerpt) AS excerpt, arg_min(book_name || ' ' || chapter_number, part_index) AS one FROM judged GROUP BY request_id"""
_SURVIVORS = f"""SELECT 'voice_alignments' AS "table", count(*) AS rows FROM voice_alignments WHERE voice NOT IN (SELECT code FROM voices WHERE translation = {IMPORTED})
    UNION ALL SELECT 'voices', count(*) FROM voices WHERE translation <> {IMPORTED} UNION ALL SELECT 'translation_verses', count(*) FROM translation_verses WHERE translation <> {IMPORTED}
    UNION ALL SELECT 'translation_books', count(*) FROM translation_books WHERE translation <> {IMPORTED} UNION ALL SELECT 'translations', count(*) FROM translations WHERE code <> {IMPORTED}
    UNION ALL SELECT 'languages', count(*) FROM languages UNION ALL SELECT 'bible_books', count(*) FROM bible_books
    UNION ALL SELECT 'translation_titles', count(*) FROM translation_titles WHERE before_translation_verse NOT IN (SELECT code FROM translation_verses WHERE translation = {IMPORTED})
    UNION ALL SELECT 'translation_notes', count(*) FROM translation_notes n WHERE NOT EXISTS (SELECT 1 FROM translation_verses v WHERE v.code = n.translation_verse AND v.translation = {IMPORTED}) AND NOT EXISTS (SELECT 1 FROM translation_titles t JOIN translation_verses v ON v.code = t.before_translation_verse WHERE t.code = n.translation_title AND v.translation = {IMPORTED})"""
_COUNTS = " UNION ALL ".join(f"SELECT '{t}' AS \"table\", count(*) AS rows FROM {t}" for t in CONTENT)
_EXTRA = {
    "chapters": _CHAPTERS, "info": _INFO, "log": _LOG, "requests": _REQUESTS, "parts0": _PARTS, "parts": _LABELLED, "prevs": _PREV, "nexts": _NEXT, "matched": _MATCHED, "hit": _VERSES.format("matched"), "judged": _JUDGED, "titled": _TITLED, "survivors": _SURVIVORS, "counts": _COUNTS,
    "prior": _stats(f"(SELECT * FROM log WHERE created_at < TIMESTAMP '{PRIOR_BEFORE}')"),
}


def with_tables(query: str) -> str:
    return "WITH " + ", ".join(f"{k} AS ({v})" for k, v in {**SQL, **_EXTRA}.items()) + f" {query}"


def _expand(book: str, chapter: str) -> str:
    """The template s.link_template filled by plain replacements."""
    z = lambda x, n: f"CASE WHEN length(CAST({x} AS VARCHAR)) < {n} THEN lpad(CAST({x} AS VARCHAR), {n}, '0') ELSE CAST({x} AS VARCHAR) END"
    out = "s.link_template"
    for name, value in (("book_zerofill", z(book, 2)), ("chapter_zerofill", z(chapter, 2)), ("chapter_zerofill3", z(chapter, 3)), ("chapter_zerofill_ps3", f"CASE WHEN {book} = 19 THEN {z(chapter, 3)} ELSE {z(chapter, 2)} END"), ("book", f"CAST({book} AS VARCHAR)"), ("chapter", f"CAST({chapter} AS VARCHAR)"), ("book_alias", "c.code1"), ("book_alias_upper", "upper(c.code1)"), ("book_code2", "coalesce(c.code2, '')"), ("book_code3", "coalesce(c.code3, '')")):
        out = f"replace({out}, '{{{name}}}', {value})"
    return out


def overview(counted: str = "log", as_of: str = AS_OF, now: str = NOW) -> str:
    """Stats of closed days by the rows that counted, and how many rows of the log are young enough to be there."""
    young = f"FROM log WHERE created_at >= TIMESTAMP '{now}' - INTERVAL 14 DAY GROUP BY ALL"
    return f""", s AS (SELECT * FROM ({_stats(counted)}) WHERE date < DATE '{as_of}'),
            k AS (SELECT CAST(created_at AS DATE) AS date, endpoint, count(*) AS requests_kept {young} UNION ALL SELECT CAST(created_at AS DATE), '_total_', count(*) {young})
            SELECT coalesce(s.date, k.date) AS date, coalesce(s.endpoint, k.endpoint) AS endpoint, request_count, unique_ips, avg_response_time_ms, error_count, coalesce(requests_kept, 0) AS requests_kept
            FROM s FULL JOIN k ON s.date = k.date AND s.endpoint = k.endpoint"""


#: What each of FORMATS gives, by DuckDB's own formatting; null stands for an error.
_FORMATTED = (
    "'{' || format('{:03d}', b.book) || '}/' || lpad(CAST(n.chapter AS VARCHAR), 5, ' ')", "format('{:*^9}', c.code1) || '|' || left(upper(c.code1), 2)",
    "format('{:#06x}', n.chapter) || format('-{:+d}', n.chapter) || '-' || rpad(CAST(b.book AS VARCHAR), 4, ' ') || '|'", "NULL", "NULL", "rpad(coalesce(c.code2, ''), 6, '_') || '{}' || left(c.code1, 1)",
    "lpad(format('{:02d}', b.book), n.chapter, ' ')", "NULL",
)


def _formats() -> str:
    cases = " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(_FORMATTED))
    return f"""SELECT s.code, b.book, n.chapter, CASE WHEN c.number IS NULL THEN '' ELSE coalesce(CASE s.code % {len(FORMATS)} {cases} END, '') END AS url
        FROM voices s CROSS JOIN (SELECT unnest(range(1, 71)) AS book) b CROSS JOIN (SELECT unnest([5, 119])::INT AS chapter) n LEFT JOIN bible_books c ON c.number = b.book"""


def _audited() -> str:
    tables = ", ".join(f"left_{t} AS (SELECT * FROM {t} WHERE {LEFT.get(t, 'true')})" for t in CONTENT)
    missing = [(child, c, *parent.split(".")) for child, columns in RELATIONS.items() for c, parent in columns.items()]
    return f", {tables} " + " UNION ALL ".join(
        f"SELECT '{child}.{c}' AS relation, '{parent}.{key}' AS parent, count(DISTINCT x.{c}) AS missing_keys, count(*) AS orphan_rows FROM left_{child} x WHERE x.{c} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM left_{parent} p WHERE p.{key} = x.{c}) HAVING count(*) > 0"
        for child, c, parent, key in missing
    )


def _imported() -> str:
    """All rows of the content tables, as text, after import_end_to_end."""
    new = {
        "languages": {"name_en": "name_en || ' (last)'", "name_national": "upper(alias)"},
        "bible_books": {"code9": "CASE WHEN number >= 10 THEN code9 WHEN number % 2 = 0 THEN 'last' ELSE 'first' END"},
        "translation_verses": {"text": f"text || CASE WHEN translation = {IMPORTED} THEN ' (new)' ELSE '' END", "verse_number_join": f"CASE WHEN translation <> {IMPORTED} THEN verse_number_join END"},
    }
    row = lambda t: " || '|' || ".join(f"coalesce(CAST({new.get(t, {}).get(c.split()[0], chr(34) + c.split()[0] + chr(34))} AS VARCHAR), '-')" for c in DDL[t].split(", "))
    return " UNION ALL ".join(f"SELECT '{t}' AS \"table\", {row(t)} AS row FROM {t}" for t in CONTENT)


def oracle_sql() -> dict[str, str]:
    array = lambda x: f"string_agg(CAST({x} AS VARCHAR), ',' ORDER BY {x})"
    least, latest = ([int(x) for x in v.split(".")] for v in (LEAST, LATEST))
    version = "CAST(string_split(app_version, '.') AS INT[])"
    kind = f"CASE WHEN {version} < {least} THEN 'hard' WHEN {version} < {latest} THEN 'soft' ELSE 'none' END"
    queries = {
        "languages": "SELECT alias, name_en, name_national FROM languages",
        "translations_nested": "SELECT t.code, t.alias, t.name, t.language, true AS active, count(CASE WHEN v.code <> 0 THEN 1 END) AS n_voices, coalesce(string_agg(CASE WHEN v.code <> 0 THEN v.code || ':' || v.alias || ':' || v.is_music END, ',' ORDER BY v.code), '') AS voices FROM translations t LEFT JOIN voices v ON v.translation = t.code WHERE t.active = 1 AND (v.active = 1 OR v.active IS NULL) GROUP BY ALL",
        "translations_flat_filtered": f"SELECT t.code, t.alias, t.language, v.code AS voice_code, v.alias AS voice_alias, v.is_music AS voice_is_music, v.active AS voice_active FROM translations t LEFT JOIN voices v ON v.translation = t.code WHERE t.active = 1 AND (v.active = 1 OR v.active IS NULL) AND t.language = '{LANGUAGE}'",
        "chapters_by_book": f"SELECT translation, book_number, {array('chapter_number')} AS chapters FROM chapters GROUP BY 1, 2",
        "translation_books_overview": f"""SELECT i.translation, i.code, i.book_number, i.name, i.alias, i.chapters_count, coalesce((SELECT {array('n')} FROM generate_series(1, coalesce(i.chapters_count, 0)) g(n) WHERE NOT EXISTS (SELECT 1 FROM chapters c WHERE c.translation = i.translation AND c.book_number = i.book_number AND c.chapter_number = n)), '') AS chapters_without_text
            FROM info i WHERE i.translation IN (SELECT code FROM translations WHERE active = 1)""",
        "chapters_without_audio": f"""SELECT a.translation, a.voice, b.book_number, coalesce(g.chapters, '') AS chapters_without_audio
            FROM (SELECT translation, code AS voice FROM voices UNION SELECT 2, code FROM voices WHERE code % 10 = 1) a JOIN voices s ON s.code = a.voice JOIN translations t ON t.code = a.translation AND t.active = 1 JOIN translation_books b ON b.translation = a.translation
            LEFT JOIN (SELECT c.translation, v.code AS voice, c.book_number, {array('c.chapter_number')} AS chapters FROM chapters c JOIN translations t ON t.code = c.translation CROSS JOIN voices v LEFT JOIN audio_files f ON f.translation_alias = t.alias AND f.voice_alias = v.alias AND f.book = c.book_number AND f.chapter = c.chapter_number WHERE f.book IS NULL GROUP BY 1, 2, 3) g
            ON g.translation = a.translation AND g.voice = a.voice AND g.book_number = b.book_number WHERE a.voice <> 0""",
        "books_info": "SELECT translation, code, book_number, name, alias, code2, code3, chapters_count, coalesce('bk5' IN (alias, code2, code3, code4, code5, short_name_en, short_name_ru), false) AS is_bk5, coalesce('B7' IN (alias, code2, code3, code4, code5, short_name_en, short_name_ru), false) AS is_b7 FROM info",
        "prev_excerpt": "SELECT * FROM prevs",
        "next_excerpt": "SELECT * FROM nexts",
        "translation_lookup": "SELECT CAST(r AS INT) AS translation, t.name, CASE WHEN t.name IS NULL THEN 'Translation ' || r || ' not found.' END AS error FROM range(0, 30) x(r) LEFT JOIN translations t ON t.code = r AND t.active = 1",
        "voice_info": """SELECT a.voice, a.translation, v.alias AS voice_alias, v.link_template, v.translation_alias, CASE WHEN v.alias IS NULL THEN 'Voice ' || a.voice || ' not found for translation ' || a.translation || '.' END AS error
            FROM (SELECT code AS voice, translation FROM voices UNION ALL SELECT code, translation + 1 FROM voices) a LEFT JOIN (SELECT s.*, t.alias AS translation_alias FROM voices s JOIN translations t ON t.code = s.translation WHERE s.active = 1 AND t.active = 1) v ON v.code = a.voice AND v.translation = a.translation""",
        "book_lookup": "SELECT 'b' || r AS alias, CAST(c.number AS VARCHAR) AS number, CASE WHEN c.number IS NULL THEN 'Book ''b' || r || ''' not found.' END AS error FROM range(0, 70) x(r) LEFT JOIN bible_books c ON c.code1 = 'b' || r",
        "voice_link_template": "SELECT t.alias AS translation_alias, s.alias AS voice_alias, CASE WHEN s.active = 1 AND t.active = 1 THEN coalesce(s.link_template, '') ELSE '' END AS link_template FROM voices s JOIN translations t ON t.code = s.translation",
        "localized_document": "SELECT * FROM (VALUES " + ", ".join(f"('{part}', '{lang}', '{text}')" for part, texts in ABOUT.items() for lang, text in texts.items()) + ") AS d(part, language, text)",
        "cache_roundtrip": "SELECT a.step, a.translation, c.books, c.chapters, 4 AS made, 2 AS dropped FROM (VALUES (0, 1), (1, 1), (2, 2), (3, 3), (4, 2), (5, 1)) AS a(step, translation) JOIN (SELECT translation, count(*) AS books, CAST(sum(n) AS BIGINT) AS chapters FROM (SELECT translation, book_number, max(chapter_number) AS n FROM translation_verses GROUP BY 1, 2) GROUP BY 1) c ON c.translation = a.translation",
        "audio_url": f"SELECT s.code, b.book, n.chapter, CASE WHEN c.number IS NULL OR {_expand('b.book', 'n.chapter')} LIKE '%{{%' THEN '' ELSE {_expand('b.book', 'n.chapter')} END AS url FROM voices s CROSS JOIN (SELECT unnest(range(1, 71)) AS book) b CROSS JOIN (SELECT unnest([5, 50, 119]) AS chapter) n LEFT JOIN bible_books c ON c.number = b.book WHERE s.link_template IS NOT NULL",
        "audio_url_formats": _formats(),
        "book_lookup_nocase": "SELECT a.alias, CAST(c.number AS VARCHAR) AS number, CASE WHEN c.number IS NULL THEN 'Book ''' || a.alias || ''' not found.' END AS error FROM (SELECT DISTINCT CASE WHEN p_partkey % 2 = 0 THEN 'B' ELSE 'b' END || (p_partkey % 80) AS alias FROM part) a LEFT JOIN bible_books c ON c.code1 = a.alias COLLATE NOCASE",
        "books_by_alias_nocase": """SELECT a.translation, a.asked, i.code, i.book_number, i.alias FROM (SELECT translation, ['BK', 'bX', 'B', 'zz'][code % 4 + 1] || book_number AS asked FROM translation_books) a
            LEFT JOIN info i ON i.translation = a.translation AND lower(a.asked) IN (lower(i.alias), lower(i.code2), lower(i.code3), lower(i.code4), lower(i.code5), lower(i.short_name_en), lower(i.short_name_ru))""",
        "daily_stats_merged": _stats("log"),
        "monthly_stats_merged": "SELECT strftime(created_at, '%Y-%m') AS month, endpoint, count(*) AS request_count, count(DISTINCT client_ip) AS unique_ips, round(avg(response_time_ms)) AS avg_response_time_ms, CAST(sum(CASE WHEN status_code >= 400 THEN 1 ELSE 0 END) AS BIGINT) AS error_count FROM log GROUP BY 1, 2",
        "referential_audit": _audited(),
        "excerpt_refs": "SELECT request_id, part_index, book, chapter_number, start_verse, end_verse, label FROM parts",
        "chapter_verses": ", w AS (SELECT DISTINCT v.translation, v.book_number, v.chapter_number, s.code AS voice, CASE WHEN v.chapter_number % 2 = 0 THEN 2 END AS start_verse, CASE WHEN v.chapter_number % 2 = 0 THEN 4 END AS end_verse FROM translation_verses v LEFT JOIN voices s ON s.translation = v.translation) " + f'SELECT translation, voice, book_number, chapter_number, verse_number, code, text, b0 AS "begin", e0 AS "end", start_paragraph FROM ({_VERSES.format("w")})',
        "chapter_titles": "SELECT code, text, before_translation_verse, reference, subtitle FROM translation_titles WHERE before_translation_verse IN (SELECT code FROM translation_verses)",
        "chapter_notes": "SELECT code, note_number, text, translation_verse, translation_title FROM translation_notes WHERE translation_verse IN (SELECT code FROM translation_verses) OR translation_title IN (SELECT t.code FROM translation_titles t JOIN translation_verses v ON v.code = t.before_translation_verse)",
        "excerpt_requests": "SELECT request_id, n_parts, CASE WHEN error IS NULL THEN CASE WHEN n_parts = 1 THEN one ELSE 'Excerpt ' || excerpt END END AS title, CASE WHEN error IS NULL THEN n_parts = 1 AND ranged = 0 END AS is_single_chapter, error FROM titled",
        "excerpt_parts": f"""SELECT j.request_id, j.part_index, j.book_code, j.alias, j.chapter_number, j.prev_excerpt, j.next_excerpt,
            CASE WHEN f.book IS NOT NULL THEN '{BASE_URL}/audio/' || j.translation_alias || '/' || j.voice_alias || '/' || lpad(CAST(j.book_number AS VARCHAR), 2, '0') || '/' || CASE WHEN j.chapter_number < 10 THEN '0' ELSE '' END || j.chapter_number || '.mp3' ELSE '' END AS audio_link,
            j.n_verses, (SELECT count(DISTINCT t.code) FROM hit h JOIN translation_titles t ON t.before_translation_verse = h.code WHERE h.request_id = j.request_id AND h.part_index = j.part_index) AS n_titles,
            (SELECT count(DISTINCT n.code) FROM hit h LEFT JOIN translation_titles t ON t.before_translation_verse = h.code JOIN translation_notes n ON n.translation_verse = h.code OR n.translation_title = t.code WHERE h.request_id = j.request_id AND h.part_index = j.part_index) AS n_notes, j.verse_codes, j.seconds
            FROM judged j LEFT JOIN audio_files f ON f.translation_alias = j.translation_alias AND f.voice_alias = j.voice_alias AND f.book = j.book_number AND f.chapter = j.chapter_number WHERE j.request_id IN (SELECT request_id FROM titled WHERE error IS NULL)""",
        "request_log_clean": "SELECT * FROM log",
        "daily_backfill_dates": f"SELECT DISTINCT CAST(created_at AS DATE) AS d FROM log WHERE CAST(created_at AS DATE) < DATE '{AS_OF}' AND CAST(created_at AS DATE) NOT IN (SELECT date FROM prior WHERE endpoint = '_total_')",
        "daily_stats": _stats("log"),
        "daily_stats_upsert": f", s AS ({_stats('log')}) SELECT s.date, s.endpoint, s.request_count + CASE WHEN s.date >= DATE '2024-01-03' AND s.date < DATE '{PRIOR_BEFORE}' THEN 1 ELSE 0 END AS request_count, s.unique_ips, s.avg_response_time_ms, s.error_count FROM s WHERE s.date < DATE '{AS_OF}'",
        "purge_retention": f"SELECT endpoint, status_code, client_ip, created_at FROM log WHERE created_at >= TIMESTAMP '{NOW}' - INTERVAL 14 DAY OR created_at IS NULL",
        "import_full_report": "SELECT * FROM counts",
        "import_end_to_end": _imported(),
        "import_partial_report": "SELECT c.\"table\", CASE c.\"table\" WHEN 'languages' THEN c.rows WHEN 'bible_books' THEN (SELECT count(*) FROM bible_books WHERE number < 10) ELSE c.rows - s.rows END AS rows FROM counts c JOIN survivors s ON s.\"table\" = c.\"table\"",
        "cascade_survivors": "SELECT * FROM survivors",
        "import_partial_tables": "SELECT * FROM counts",
        "reference_upsert": "SELECT alias, CASE WHEN alias < 'b' THEN name_en || ' (new)' ELSE name_en END AS name_en, name_national FROM languages UNION ALL SELECT 'zz', 'Z', 'Z'",
        "byte_ranges": """, f AS (SELECT event_id, k, CASE k % 8 WHEN 0 THEN 'bytes=0-' || k WHEN 1 THEN 'bytes=-' || k WHEN 2 THEN 'bytes=' || k || '-' WHEN 3 THEN 'bytes=' || k || '-5' WHEN 4 THEN 'bytes=1-' || k || ',200-300' WHEN 5 THEN 'items=0-' || k WHEN 6 THEN 'bytes=a-b' END AS header, k * 2 - 10 AS size FROM (SELECT event_id, CAST(props ->> '$.k' AS BIGINT) AS k FROM events)),
            g AS (SELECT *, CASE k % 8 WHEN 2 THEN k WHEN 3 THEN k WHEN 4 THEN 1 ELSE 0 END AS s, least(size - 1, CASE k % 8 WHEN 2 THEN size - 1 WHEN 3 THEN 5 ELSE k END) AS e FROM f WHERE size >= 0),
            h AS (SELECT *, k % 8 < 5 AND s <= e AS good FROM g)
            SELECT event_id, header, size, CASE WHEN header IS NULL THEN 200 WHEN good THEN 206 ELSE 416 END AS status, CASE WHEN good THEN CAST(s AS BIGINT) END AS first_byte, CASE WHEN good THEN e END AS last_byte,
            CASE WHEN header IS NULL THEN NULL WHEN good THEN 'bytes ' || s || '-' || e || '/' || size ELSE 'bytes */' || size END AS content_range, CASE WHEN header IS NULL THEN size WHEN good THEN e - s + 1 END AS content_length FROM h""",
        "ranges_of_files": f""", p AS (SELECT page_id, page_id // {PAGES_A_FILE} AS file, coalesce(html, '') AS html FROM pages),
            f AS (SELECT *, octet_length(encode(html)) AS n, sum(octet_length(encode(html))) OVER (PARTITION BY file ORDER BY page_id) AS through, 1 + sum(octet_length(encode(html))) OVER (PARTITION BY file) AS size,
                string_agg(html, '') OVER (PARTITION BY file ORDER BY page_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) || chr(10) AS rest FROM p),
            g AS (SELECT page_id, size, through - n AS first, CASE WHEN page_id % 4 = 1 THEN size ELSE through END - 1 AS last, CASE WHEN page_id % 4 = 1 THEN rest ELSE html END AS body, page_id % 4 = 1 OR page_id % 4 <> 3 AND n > 0 AS good FROM f)
            SELECT page_id, CASE WHEN good THEN 206 ELSE 416 END AS status, CASE WHEN good THEN 'bytes ' || first || '-' || last || '/' || size ELSE 'bytes */' || size END AS content_range,
            CAST(CASE WHEN good THEN last - first + 1 END AS BIGINT) AS content_length, CASE WHEN good THEN sha256(body) END AS body_sha256, good AS tagged FROM g""",
        "path_validation": """, a AS (SELECT page_id, split_part(url, '/', 3) AS t, CASE WHEN page_id % 3 = 0 THEN url ELSE split_part(url, '/', 4) END AS v, CASE WHEN page_id % 5 = 0 THEN '..' ELSE '01' END AS b, CASE WHEN page_id % 7 = 0 THEN 'a\\b' ELSE '02' END AS c FROM pages),
            u AS (SELECT *, CASE WHEN regexp_matches(t, '[.][.]|[/\\\\]') THEN 'translation' WHEN regexp_matches(v, '[.][.]|[/\\\\]') THEN 'voice' WHEN b = '..' THEN 'book' WHEN c LIKE '%\\%' THEN 'chapter' END AS unsafe FROM a)
            SELECT page_id, unsafe, CASE WHEN unsafe IS NULL THEN t || '/' || v || '/mp3/' || b || '/' || c || '.mp3' END AS path FROM u""",
        "version_check": f""", v AS (SELECT DISTINCT l_linenumber || '.' || (l_partkey % 10) || CASE WHEN l_orderkey % 3 = 0 THEN '.' || (l_suppkey % 12) ELSE '' END AS app_version FROM lineitem)
            SELECT app_version, {kind} AS update_type, '{LATEST}' AS latest_version, CASE {kind} WHEN 'soft' THEN '{MESSAGES['soft']}' WHEN 'hard' THEN '{MESSAGES['hard']}' END AS message FROM v""",
        "request_stream_daily": overview(f"(SELECT * FROM log WHERE created_at >= TIMESTAMP '{FIRST_CLOSE}' OR NOT ({LATE.replace('peer', 'client_ip')}))"),
    }
    return {k: with_tables(q) for k, q in queries.items()}
