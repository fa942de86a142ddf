"""The queries of queries.py in DuckDB's SQL, put together from named common table expressions."""

from __future__ import annotations

import re

from .. import constants as C
from ..functions import porter
from ..functions.text import CHUNK_ID
from .queries import EARLY, NOW, ROUND_WORD, SEGMENT_TOKENS


def _list(words) -> str:
    return "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in sorted(words)) + ")"


VALID = f"length(w) <= {C.WORD_MOST} AND (length(w) >= {C.WORD_LEAST} OR (length(w) = 2 AND w IN {_list(C.SHORT_WORDS)})) AND w NOT IN {_list(C.STOP_WORDS)}"


def tokens(text: str) -> str:
    return f"list_filter(list_transform(regexp_extract_all(coalesce({text}, ''), '[A-Za-z0-9]+'), lambda w: lower(w)), lambda w: {VALID})"


def json_safe(c: str) -> str:
    c = f"regexp_replace({c}, '[^\\x00-\\x7E]', ' ', 'g')"
    c = f"""replace(replace(replace(replace(replace({c}, '\\', '\\\\'), '"', '\\"'), chr(10), '\\n'), chr(13), '\\r'), chr(9), '\\t')"""
    return f"regexp_replace({c}, '[\\x00-\\x1F]', '', 'g')"


def summary(c: str) -> str:
    return f"left({json_safe(f'left({c}, 150)')}, 100) || CASE WHEN length({c}) > 100 THEN '...' ELSE '' END"


def code(name: str) -> str:
    base = f"regexp_replace({name}, '\\.[^.]*$', '')"
    d, a = f"length(regexp_replace({base}, '[^0-9]', '', 'g'))", f"length(regexp_replace({base}, '[^A-Za-z]', '', 'g'))"
    x = f"lower(CASE WHEN {d} > {a} THEN regexp_replace({base}, '[^A-Za-z0-9]', '', 'g') ELSE regexp_replace({base}, '[^A-Za-z0-9]|[aeiouAEIOU]', '', 'g') END)"
    return f"left(CASE WHEN {x} = '' THEN 'unk' ELSE {x} END, 8)"


SIZE = "strlen(p) + CASE WHEN rn < total THEN 2 ELSE 0 END"
NL2 = "chr(10) || chr(10)"


def _pack(limit: int) -> str:
    fits = f"p.cfin - p.cbeg + l.size <= {limit}"
    return f"""SELECT file, k, rn, 1 AS n, beg AS cbeg, fin AS cfin FROM live WHERE k = 1 UNION ALL
        SELECT l.file, l.k, l.rn, CASE WHEN {fits} THEN p.n ELSE p.n + 1 END, CASE WHEN {fits} THEN p.cbeg ELSE l.beg END, l.fin FROM {{name}} p JOIN live l ON l.file = p.file AND l.k = p.k + 1"""


BASE: dict[str, str] = {
    "par": f"SELECT source || '.txt' AS file, doc_id, generate_subscripts(parts, 1) AS idx, unnest(parts) AS p FROM (SELECT source, doc_id, string_split(coalesce(text, ''), {NL2}) AS parts FROM documents)",
    "num": "SELECT *, row_number() OVER (PARTITION BY file ORDER BY doc_id, idx) AS rn, count(*) OVER (PARTITION BY file) AS total FROM par",
    "sized": f"SELECT *, {SIZE} AS size, sum({SIZE}) OVER (PARTITION BY file ORDER BY rn) AS fin FROM num",
    "live": "SELECT *, fin - size AS beg, row_number() OVER (PARTITION BY file ORDER BY rn) AS k FROM sized WHERE regexp_replace(p, '[\\n \\t]', '', 'g') <> ''",
    "pack_big": _pack(C.CHUNK_BYTES).format(name="pack_big"),
    "pack_small": _pack(C.DYNAMIC_CHUNK_BYTES).format(name="pack_small"),
    "cut_big": f"SELECT file, n, string_agg(p || CASE WHEN rn < total THEN {NL2} ELSE '' END, '' ORDER BY rn) AS text FROM num JOIN pack_big USING (file, rn) GROUP BY file, n",
    "cut_small": f"SELECT file, n, string_agg(p || CASE WHEN rn < total THEN {NL2} ELSE '' END, '' ORDER BY rn) AS text FROM num JOIN pack_small USING (file, rn) GROUP BY file, n",
    "fsize": "SELECT file, max(fin) AS file_size FROM sized GROUP BY file",
    "codes": f"SELECT file, CASE WHEN k = 1 THEN base ELSE base || k END AS chapter_code FROM (SELECT file, {code('file')} AS base, row_number() OVER (PARTITION BY {code('file')} ORDER BY file_size, file) AS k FROM fsize)",
    "base_chunks": f"""SELECT row_number() OVER (ORDER BY file_size, file, n) - 1 AS chunk_idx, chapter_code || '_' || printf('%03d', n) AS chunk_id, file AS source_file, chapter_code, n,
        lag(chapter_code || '_' || printf('%03d', n)) OVER (PARTITION BY file ORDER BY n) AS prev_chunk_id, lead(chapter_code || '_' || printf('%03d', n)) OVER (PARTITION BY file ORDER BY n) AS next_chunk_id,
        sum(strlen(text) // 4) OVER (ORDER BY file_size, file, n) - strlen(text) // 4 AS token_start, sum(strlen(text) // 4) OVER (ORDER BY file_size, file, n) AS token_end, {summary("text")} AS summary, text
        FROM cut_big JOIN codes USING (file) JOIN fsize USING (file)""",
    "chunks_0": "SELECT *, 0 AS segment_id FROM base_chunks",
    "chunks_1": f"SELECT *, (token_start // {SEGMENT_TOKENS})::BIGINT AS segment_id FROM base_chunks",
    "doc_chunks": "SELECT doc_id AS chunk_idx, text FROM documents",
    "qwords": f"SELECT DISTINCT item_id AS query_id, unnest({tokens('text')}) AS term FROM benchmark",
}


def _chain(s: int) -> dict[str, str]:
    order = "CASE WHEN origin = 'prev' THEN 0 ELSE 1 END"
    return {
        f"toks_{s}": f"SELECT segment_id, chunk_idx, {tokens('text')} AS t FROM chunks_{s}",
        f"words_{s}": f"SELECT segment_id, chunk_idx, unnest(list_concat(t, CASE WHEN len(t) > 1 THEN list_filter(list_transform(range(1, len(t)), lambda i: t[i] || '_' || t[i + 1]), lambda b: length(b) <= {C.BIGRAM_MOST_LENGTH}) ELSE [] END)) AS keyword FROM toks_{s}",
        f"tfs_{s}": f"SELECT segment_id, chunk_idx, keyword, least(count(*), {C.TF_MOST}) AS tf FROM words_{s} GROUP BY ALL",
        f"ckw_{s}": f"SELECT segment_id, chunk_idx, keyword, tf, row_number() OVER (PARTITION BY chunk_idx ORDER BY tf DESC, keyword) AS pos FROM (SELECT *, row_number() OVER (PARTITION BY chunk_idx, contains(keyword, '_') ORDER BY tf DESC, keyword) AS r FROM tfs_{s}) WHERE NOT contains(keyword, '_') OR r <= {C.BIGRAMS_PER_CHUNK}",
        f"cdf_{s}": f"SELECT segment_id, keyword, count(*) AS df FROM ckw_{s} GROUP BY ALL",
        f"top5_{s}": f"SELECT * FROM (SELECT k.segment_id, chunk_idx, source_file, keyword, row_number() OVER (PARTITION BY chunk_idx ORDER BY df, keyword) AS r FROM ckw_{s} k JOIN cdf_{s} USING (segment_id, keyword) JOIN chunks_{s} USING (segment_id, chunk_idx) WHERE NOT contains(keyword, '_')) WHERE r <= {C.NEIGHBOUR_KEYWORDS}",
        f"moved_{s}": f"SELECT segment_id, chunk_idx + 1 AS chunk_idx, source_file, keyword, 'prev' AS origin, r FROM top5_{s} UNION ALL SELECT segment_id, chunk_idx - 1, source_file, keyword, 'next', r FROM top5_{s}",
        f"fresh_{s}": f"SELECT segment_id, chunk_idx, keyword, arg_min(origin, {order}) AS origin, arg_min(r, {order}) AS r FROM moved_{s} m SEMI JOIN chunks_{s} c USING (segment_id, chunk_idx, source_file) ANTI JOIN ckw_{s} k USING (segment_id, chunk_idx, keyword) GROUP BY segment_id, chunk_idx, keyword",
        f"owns_{s}": f"SELECT chunk_idx, max(pos) AS own FROM ckw_{s} GROUP BY chunk_idx",
        f"dk_{s}": f"SELECT segment_id, chunk_idx, keyword, tf, pos, 'own' AS origin FROM ckw_{s} UNION ALL SELECT segment_id, chunk_idx, keyword, 1, coalesce(own, 0) + row_number() OVER (PARTITION BY chunk_idx ORDER BY {order}, r, keyword), origin FROM fresh_{s} LEFT JOIN owns_{s} USING (chunk_idx)",
        f"ddf_{s}": f"SELECT segment_id, keyword, count(*) AS df FROM dk_{s} GROUP BY ALL",
        f"dks_{s}": f"SELECT d.*, stem FROM dk_{s} d JOIN porter ON word = keyword",
        f"post_{s}": f"SELECT DISTINCT segment_id, stem, chunk_idx FROM dks_{s} JOIN ddf_{s} USING (segment_id, keyword) WHERE NOT (df <= 1 AND contains(keyword, '_'))",
        f"sst_{s}": f"SELECT segment_id, stem, count(*) AS df FROM post_{s} GROUP BY ALL",
        f"dst_{s}": f"SELECT segment_id, chunk_idx, count(*) AS dl FROM dk_{s} GROUP BY ALL",
        f"seg_{s}": f"SELECT segment_id, count(*) AS n, avg(coalesce(dl, 0)) AS avgdl FROM chunks_{s} LEFT JOIN dst_{s} USING (segment_id, chunk_idx) GROUP BY segment_id",
        f"bm_{s}": f"SELECT query_id, segment_id, chunk_idx, round(sum({_bm('n', 'df', '1.0::DOUBLE', 'dl', 'avgdl')}), 9) AS score FROM (SELECT DISTINCT query_id, stem FROM qstems) JOIN post_{s} USING (stem) JOIN sst_{s} USING (segment_id, stem) JOIN dst_{s} USING (segment_id, chunk_idx) JOIN seg_{s} USING (segment_id) GROUP BY ALL",
    }


def _bm(n: str, df: str, tf: str, dl: str, avgdl: str) -> str:
    return f"ln((greatest({n} - {df}, 0)::DOUBLE + 0.5::DOUBLE) / ({df}::DOUBLE + 0.5::DOUBLE) + 1.0::DOUBLE) * ({tf} * 2.5::DOUBLE / ({tf} + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * {dl}::DOUBLE / {avgdl})))"


def _rescored(candidates: str, s: int) -> str:
    """candidates with score, coverage, exact after the second phase."""
    return f"""SELECT c.query_id, c.segment_id, c.chunk_idx, c.score AS first_score, coalesce(covered, 0)::DOUBLE / n_stems AS coverage, coalesce(exact, 0) AS exact,
        round(c.score * ((1.0::DOUBLE + 0.8::DOUBLE * (coalesce(covered, 0)::DOUBLE / n_stems) * (coalesce(covered, 0)::DOUBLE / n_stems)) * (1.0::DOUBLE + least(coalesce(exact, 0) * 0.25::DOUBLE, 0.75::DOUBLE))), 9) AS score
        FROM {candidates} c JOIN (SELECT query_id, count(DISTINCT stem) AS n_stems FROM qstems GROUP BY query_id) USING (query_id)
        LEFT JOIN (SELECT query_id, segment_id, chunk_idx, count(DISTINCT stem) AS covered, count(*) FILTER (WHERE keyword = term) AS exact FROM (SELECT query_id, segment_id, chunk_idx FROM {candidates}) JOIN qstems USING (query_id) JOIN dks_{s} USING (segment_id, chunk_idx, stem) GROUP BY ALL) USING (query_id, segment_id, chunk_idx)"""


def _rank(source: str, by: str = "query_id", extra: str = "") -> str:
    return f"SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY score DESC, segment_id, chunk_idx) AS rank{extra} FROM {source}"


def _coherent(hits: str) -> str:
    boosted = f"SELECT query_id, h.segment_id, chunk_idx, round(score * (CASE WHEN coalesce(source_file, '') <> '' THEN 1.0::DOUBLE + least((count(*) OVER (PARTITION BY query_id, source_file) - 1) * 0.05::DOUBLE, 0.3::DOUBLE) ELSE 1.0 END), 9) AS score FROM {hits} h JOIN base_chunks USING (chunk_idx)"
    return _rank(f"({boosted})")


BASE |= _chain(0) | _chain(1)
BASE |= {
    "qstems": "SELECT query_id, term, stem FROM qwords JOIN porter ON word = term",
    "rank_0": _rank("bm_0"),
    "cand_0": f"SELECT *, count(*) OVER (PARTITION BY query_id) AS n_candidates FROM rank_0 WHERE rank <= {max(C.OVERSAMPLE * C.TOP_K, C.OVERSAMPLE_LEAST)}",
    "second_0": _rescored("cand_0", 0),
    "two_all": f"SELECT query_id, segment_id, chunk_idx, CASE WHEN n_candidates <= {C.TOP_K} THEN s.first_score ELSE s.score END AS score FROM second_0 s JOIN (SELECT query_id, segment_id, chunk_idx, n_candidates FROM cand_0) USING (query_id, segment_id, chunk_idx)",
    "two_ranked": _rank("two_all"),
    "two": f"SELECT * FROM two_ranked WHERE rank <= {C.TOP_K}",
    "two20_ranked": _rank("(SELECT query_id, segment_id, chunk_idx, CASE WHEN n_candidates <= 20 THEN s.first_score ELSE s.score END AS score FROM second_20 s JOIN (SELECT query_id, segment_id, chunk_idx, n_candidates FROM cand_20) USING (query_id, segment_id, chunk_idx))"),
    "cand_20": "SELECT *, count(*) OVER (PARTITION BY query_id) AS n_candidates FROM rank_0 WHERE rank <= 640",
    "second_20": _rescored("cand_20", 0),
    "two20": "SELECT * FROM two20_ranked WHERE rank <= 20",
    "seg_top": f"SELECT * FROM ({_rank('bm_1', 'query_id, segment_id')}) WHERE rank <= {C.SEGMENT_LEAST}",
    "seg_second": _rescored("seg_top", 1),
    "multi": f"SELECT * FROM ({_rank('(SELECT query_id, segment_id, chunk_idx, score FROM seg_second)')}) WHERE rank <= {C.TOP_K}",
    "doc_words": f"SELECT DISTINCT doc_id AS chunk_idx, unnest({tokens('text')}) AS keyword FROM documents",
    "tfk": f"SELECT * FROM dks_0 WHERE origin = 'own' AND pos <= {C.KEYWORD_CAP}",
    "first_8": "SELECT * FROM rank_0 WHERE rank <= 8",
    "first8_second": _rescored("first_8", 0),
    "coherent_8": _coherent("two"),
    "coherent_20": _coherent("two20"),
    "two3_second": _rescored("cand_0", 0),
    "two3_ranked": _rank("(SELECT query_id, segment_id, chunk_idx, CASE WHEN n_candidates <= 3 THEN s.first_score ELSE s.score END AS score FROM two3_second s JOIN (SELECT query_id, segment_id, chunk_idx, n_candidates FROM cand_0) USING (query_id, segment_id, chunk_idx))"),
    "two3": "SELECT * FROM two3_ranked WHERE rank <= 3",
    "turn": """SELECT conv_id, turn, 'CH' || number AS chunk_id, number, 1700000000 + number * 3600 AS ts, 'User: ' || user_message || chr(10) || chr(10) || 'Assistant: ' || system_response AS text, user_message, system_response
        FROM (SELECT *, row_number() OVER (ORDER BY conv_id, turn) AS number FROM (SELECT conv_id, turn, role, text AS user_message, CASE WHEN lead(role) OVER w = 'assistant' THEN lead(text) OVER w ELSE '' END AS system_response FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user')""",
    "chat": f"SELECT * FROM (SELECT chunk_id, keyword, tf, row_number() OVER (PARTITION BY chunk_id ORDER BY tf DESC, keyword) AS rank FROM (SELECT chunk_id, keyword, count(*) AS tf FROM (SELECT chunk_id, unnest(list_transform(list_concat(string_split_regex(trim(user_message), '\\s+'), string_split_regex(trim(system_response), '\\s+')), lambda x: lower(regexp_replace(x, '[^A-Za-z0-9]', '', 'g')))) AS keyword FROM turn) WHERE length(keyword) BETWEEN 3 AND 20 AND keyword NOT IN {_list(C.STOP_WORDS)} GROUP BY ALL)) WHERE rank <= {C.CHAT_KEYWORDS}",
    "conv": f"SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, number) AS rank FROM (SELECT DISTINCT query_id, chunk_id, number, round(15.0::DOUBLE + CASE WHEN ts > 0 THEN 10.0::DOUBLE * exp(-(({NOW} - ts)::DOUBLE / 3600.0::DOUBLE) / 24.0::DOUBLE) ELSE 0.0 END, 6) AS score FROM chat JOIN turn USING (chunk_id) JOIN (SELECT item_id AS query_id, lower(trim(text)) AS q FROM benchmark) ON q <> '' AND (instr(q, keyword) > 0 OR instr(keyword, q) > 0))",
    "refs": "SELECT chunk_id, number, ts, list_transform([0, 1, 5], lambda x: 'src' || (number + x) % 20 || '_001') AS source_refs FROM turn",
}

_SECOND_ROUND = {n: f"{n}_r" for n in ("qwords", "qstems", "bm_0", "rank_0", "cand_0", "second_0", "two_all", "two_ranked", "two")}
BASE |= {r: re.sub(r"\w+", lambda m: _SECOND_ROUND.get(m[0], m[0]), BASE[n]) for n, r in _SECOND_ROUND.items()}
BASE["qwords_r"] = f"SELECT DISTINCT item_id AS query_id, unnest({tokens('words')}) AS term FROM (SELECT item_id, array_to_string(list_filter(string_split(text, ' '), lambda w: length(w) >= {ROUND_WORD}), ' ') AS words FROM benchmark)"
BASE["merged"] = _rank("(SELECT query_id, segment_id, chunk_idx, max(score) AS score FROM (SELECT query_id, segment_id, chunk_idx, score FROM two UNION ALL SELECT query_id, segment_id, chunk_idx, score FROM two_r) GROUP BY ALL)")
_REFINED = {n: f"{n}_f" for n in _SECOND_ROUND} | {"porter": "porter_f"}
BASE |= {r: re.sub(r"\w+", lambda m: _REFINED.get(m[0], m[0]), BASE[n]) for n, r in _REFINED.items() if n in BASE}
BASE["qwords_f"] = f"SELECT DISTINCT query_id, unnest({tokens('words')}) AS term FROM (SELECT query_id, 'of the ' || left(arg_min(text, chunk_idx), {C.JUDGE_CHARS}) AS words FROM two JOIN base_chunks USING (chunk_idx) GROUP BY query_id)"
BASE["porter_f"] = f"WITH {porter.sql('SELECT term AS word FROM qwords_f')} SELECT word, stem FROM porter"
BASE["refined"] = _rank("(SELECT query_id, segment_id, chunk_idx, max(score) AS score FROM (SELECT query_id, segment_id, chunk_idx, score FROM two UNION ALL SELECT query_id, segment_id, chunk_idx, score FROM two_f) GROUP BY ALL)")
BASE["seg_all"] = "SELECT query_id, segment_id, chunk_idx, score FROM seg_second"
BASE["seg_most"] = "SELECT *, max(most) OVER (PARTITION BY query_id ORDER BY segment_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM (SELECT query_id, segment_id, max(score) AS most FROM seg_all GROUP BY ALL)"
BASE["seg_early"] = _rank(f"(SELECT a.* FROM seg_all a JOIN seg_most USING (query_id, segment_id) WHERE coalesce(before, 0) < {EARLY})")

PORTER = {
    0: porter.sql("SELECT keyword AS word FROM dk_0 UNION SELECT term FROM qwords"),
    1: porter.sql("SELECT keyword AS word FROM dk_1 UNION SELECT term FROM qwords"),
    2: porter.sql("SELECT term AS word FROM qwords"),
    3: porter.sql(f"SELECT DISTINCT unnest({tokens('text')}) AS word FROM documents"),
}


def put(final: str, stems: int = 0) -> str:
    """The query with the expressions that it needs, each once and in order; porter comes from PORTER[stems]."""
    done: list[str] = []
    parts: list[str] = []

    def need(sql: str) -> None:
        for name in re.findall(r"\w+", sql):
            if name in done:
                continue
            if name == "porter":
                done.append(name)
                need(PORTER[stems].split(")", 1)[0] + PORTER[stems].split("p1 AS", 1)[0])
                parts.append(PORTER[stems])
            elif name in BASE:
                done.append(name)
                need(BASE[name])
                parts.append(f"{name} AS {'' if name.startswith('pack_') else 'MATERIALIZED '}({BASE[name]})")

    need(final)
    return f"WITH RECURSIVE {', '.join(parts)}\n{final}" if parts else final


HITS = "query_id, chunk_idx::BIGINT AS chunk_idx, rank, round(score, 6) AS score"


def _ords(n: int) -> str:
    return f"list_sum(list_transform(string_split(left(text, {n}), ''), lambda c: unicode(c)))"


PHRASES = "[" + ", ".join("'" + p.replace("'", "''") + "'" for p in C.SELF_PHRASES) + "]"
NAME = "source || CASE WHEN doc_id % 3 = 0 THEN '.py' ELSE '_2024.txt' END"
IDENT = "CASE WHEN doc_id % 5 = 0 THEN 'CH' || doc_id ELSE source || '_CODE_1' END"
REFS = "'see ' || source || '_DOC_' || doc_id || ', CH' || doc_id || ' and CH7, notes.' || n_chars || ' or CH7'"
TIERS = " ".join(f"WHEN n_chunks >= {a} THEN {k}" for a, k in reversed(C.TIERS))

SQL: dict[str, str] = {
    "token_counts": "SELECT doc_id, strlen(text) // 4 AS n_tokens FROM documents",
    "tokenize_tf": f"SELECT doc_id, keyword, count(*) AS tf FROM (SELECT doc_id, unnest({tokens('text')}) AS keyword FROM documents) GROUP BY ALL",
    "query_terms": put("SELECT query_id, term, stem FROM qstems", 2),
    "porter_dictionary": put("SELECT word, stem FROM porter", 3),
    "text_projections": f"""SELECT doc_id, CASE WHEN length(text) <= 200 THEN text ELSE left(text, CASE WHEN contains(head, ' ') AND length(head) - instr(reverse(head), ' ') >= 100 THEN length(head) - instr(reverse(head), ' ') ELSE 200 END) || '...' END AS snippet,
        regexp_replace(regexp_replace(text, '[\\n\\r\\t]', ' ', 'g'), '[^\\x20-\\x7E]', '', 'g') AS printable, {json_safe("text")} AS json_safe, {summary("text")} AS summary FROM (SELECT *, left(text, 201) AS head FROM documents)""",
    "chunk_id_references": f"SELECT doc_id, array_to_string(ids, '|') AS ids, round(strlen(text)::DOUBLE / greatest(list_sum(list_transform(ids, lambda x: length(x) + 2)), 1), 6) AS ratio FROM (SELECT doc_id, text, list_filter(l, lambda x, i: list_position(l, x) = i) AS ids FROM (SELECT doc_id, text, regexp_extract_all({REFS}, '{CHUNK_ID}') AS l FROM documents))",
    "self_reference": f"SELECT conv_id, turn, len(list_filter({PHRASES}, lambda p: instr(q, p) > 0 AND (instr(q, p) = 1 OR NOT regexp_matches(substr(q, instr(q, p) - 1, 1), '[a-z]')))) > 0 AS is_self FROM (SELECT conv_id, turn, lower(CASE WHEN turn % 4 = 0 THEN 'what is my ' || text ELSE text END) AS q FROM conversations)",
    "type_and_code": f"SELECT doc_id, CASE WHEN regexp_matches(name, '\\.(cpp|py|js|ts|go|rs)') THEN 'CODE' ELSE 'DOC' END AS content_type, {code('name')} AS code, CASE WHEN starts_with(ident, 'CH') THEN 'CHAT' WHEN contains(ident, '_CODE_') THEN 'CODE' WHEN contains(ident, '_FIX_') THEN 'FIX' WHEN contains(ident, '_FEAT_') THEN 'FEAT' ELSE 'DOC' END AS id_type FROM (SELECT doc_id, {NAME} AS name, {IDENT} AS ident FROM documents)",
    "answers_with_sources": f"""SELECT doc_id, lang || CASE WHEN doc_id % 2 = 0 THEN {NL2} || 'Sources: ' || source || '_1, ' || lang ELSE '' END || CASE WHEN doc_id % 3 = 0 THEN {NL2} || 'Response ID: CH' || doc_id ELSE '' END AS answer,
        doc_id % 4 <> 1 AS found, CASE WHEN doc_id % 4 = 1 THEN 'more ' || lang ELSE '' END AS terms,
        CASE WHEN length(text) <= 500 THEN text ELSE CASE WHEN contains(left(text, 500), '.') AND 500 - instr(reverse(left(text, 500)), '.') > 400 THEN left(text, 501 - instr(reverse(left(text, 500)), '.')) ELSE left(text, 500) END || ' ...' END AS context FROM documents""",
    "named_entities": f"""WITH t AS (SELECT doc_id, unnest(l) AS tok, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9]+(?:[-''][A-Za-z][A-Za-z0-9]*)*') AS l FROM documents)),
        n AS (SELECT *, regexp_full_match(tok, '[A-Z](?:[A-Za-z0-9''-]*[a-z][A-Za-z0-9''-]*)?') AND lower(tok) NOT IN {_list(C.NO_NAMES)} AS name FROM t),
        j AS (SELECT *, name OR (lower(tok) IN {_list(C.NAME_CONNECTORS)} AND coalesce(lag(name) OVER w, false) AND coalesce(lead(name) OVER w, false)) AS inside FROM n WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
        g AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, inside ORDER BY i) AS island FROM j),
        m AS (SELECT doc_id, min(i) AS place, string_agg(tok, ' ' ORDER BY i) AS entity, count(*) AS n FROM g WHERE inside GROUP BY doc_id, island HAVING count(*) > 1),
        k AS (SELECT doc_id, 0 AS part, place, entity, trim(regexp_replace(regexp_replace(lower(entity), '[ ''-]+', '_', 'g'), '[^a-z0-9_]', '', 'g'), '_') AS normalized, n FROM m
            UNION ALL SELECT doc_id, 1, i, tok, lower(regexp_replace(tok, '[^A-Z]', '', 'g')), 1 FROM t WHERE regexp_full_match(tok, '[A-Z.-]{{2,10}}')),
        f AS (SELECT *, row_number() OVER (PARTITION BY doc_id, normalized ORDER BY part, place) AS r FROM k WHERE length(normalized) >= 3 - part)
        SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY part, place) - 1)::INTEGER AS ordinal, entity, normalized, n::INTEGER AS token_count FROM f WHERE r = 1""",
    "paragraph_chunks": put("SELECT chunk_idx, n::BIGINT AS n, token_start::BIGINT AS token_start, token_end::BIGINT AS token_end, chunk_id, source_file, chapter_code, prev_chunk_id, next_chunk_id, summary, strlen(text)::INTEGER AS size, md5(text) AS digest FROM base_chunks"),
    "dynamic_chunks": put("SELECT file, n::BIGINT AS n, md5(text) AS digest FROM cut_small"),
    "segment_ranges": put("SELECT chunk_id, segment_id::INTEGER AS segment_id FROM chunks_1"),
    "token_range_overlap": put(f"SELECT chunk_idx, chunk_id FROM base_chunks WHERE token_end > {SEGMENT_TOKENS // 2} AND token_start < {SEGMENT_TOKENS // 2 + SEGMENT_TOKENS}"),
    "chunk_keywords": put("SELECT chunk_idx, tf, pos, keyword FROM ckw_0"),
    "neighbour_propagation": put("SELECT chunk_idx, tf::BIGINT AS tf, pos, keyword, origin FROM dk_0 WHERE origin <> 'own'"),
    "postings_df": put("SELECT stem, df FROM sst_0"),
    "posting_lists": put("SELECT stem, md5(string_agg(chunk_idx::VARCHAR, ',' ORDER BY chunk_idx)) AS digest, count(*) AS df FROM post_0 GROUP BY stem"),
    "dictionary_stems": put("SELECT stem, count(*) AS n_keywords, min(keyword) AS first FROM (SELECT DISTINCT keyword, stem FROM dks_0) GROUP BY stem"),
    "tf2idf_cap": put(f"SELECT chunk_idx, kw_rank, keyword, round(s, 6) AS tf2idf FROM (SELECT *, row_number() OVER (PARTITION BY chunk_idx ORDER BY round(s, 9) DESC, pos) AS kw_rank FROM (SELECT chunk_idx, keyword, pos, (tf * tf)::DOUBLE * (ln((SELECT count(*) FROM base_chunks)::DOUBLE) - ln(1.0::DOUBLE + df)) AS s FROM dk_0 JOIN ddf_0 USING (segment_id, keyword))) WHERE kw_rank <= {C.KEYWORD_CAP}"),
    "hapax_filter": put("SELECT chunk_idx, count(*) AS n FROM dk_0 JOIN ddf_0 USING (segment_id, keyword) WHERE NOT (df <= 1 AND contains(keyword, '_')) GROUP BY chunk_idx"),
    "doc_lengths": put("SELECT chunk_idx, dl, round(avgdl, 6) AS avgdl FROM dst_0, seg_0"),
    "chapter_signature": put(f"""SELECT chapter_code, source_file, chunk_count, first_chunk, last_chunk, signature FROM (SELECT chapter_code, source_file, count(*) AS chunk_count, min(chunk_idx) AS first_chunk, max(chunk_idx) AS last_chunk FROM base_chunks GROUP BY ALL)
        JOIN (SELECT chapter_code, string_agg(keyword, ' ' ORDER BY r) AS signature FROM (SELECT chapter_code, keyword, row_number() OVER (PARTITION BY chapter_code ORDER BY count(*) DESC, keyword) AS r FROM ckw_0 JOIN base_chunks USING (chunk_idx) WHERE NOT contains(keyword, '_') GROUP BY chapter_code, keyword) WHERE r <= {C.SIGNATURE_SIZE} GROUP BY chapter_code) USING (chapter_code)"""),
    "bm25_top20": put(f"SELECT {HITS} FROM rank_0 WHERE rank <= 20"),
    "bm25_exact_words": put(f"""SELECT {HITS} FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_idx) AS rank FROM (
        SELECT query_id, chunk_idx, round(sum({_bm("n", "df", "1.0::DOUBLE", "dl", "avgdl")}), 9) AS score FROM qwords JOIN w ON keyword = term JOIN (SELECT keyword, count(*) AS df FROM w GROUP BY keyword) USING (keyword) JOIN (SELECT chunk_idx, count(*) AS dl FROM w GROUP BY chunk_idx) USING (chunk_idx),
        (SELECT (SELECT count(*) FROM documents) AS n, (SELECT count(*) FROM w)::DOUBLE / (SELECT count(*) FROM documents) AS avgdl) GROUP BY query_id, chunk_idx)) WHERE rank <= 20""".replace("JOIN w ON", "JOIN doc_words ON").replace("FROM w", "FROM doc_words")),
    "two_phase_top8": put(f"SELECT {HITS} FROM two"),
    "bm25_term_frequency": put(f"""SELECT {HITS} FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_idx) AS rank FROM (
        SELECT query_id, chunk_idx, round(sum({_bm("n", "df", "tf::DOUBLE", "dl", "avgdl")}), 9) AS score FROM (SELECT DISTINCT query_id, stem FROM qstems) JOIN tfk USING (stem) JOIN (SELECT stem, count(*) AS df FROM tfk GROUP BY stem) USING (stem) JOIN (SELECT chunk_idx, count(*) AS dl FROM tfk GROUP BY chunk_idx) USING (chunk_idx),
        (SELECT count(*) AS n, avg(token_end - token_start)::DOUBLE AS avgdl FROM base_chunks) GROUP BY query_id, chunk_idx)) WHERE rank <= {C.TOP_K}"""),
    "coverage_and_exact": put("SELECT query_id, chunk_idx, exact, round(coverage, 6) AS coverage, round(score, 6) AS score FROM first8_second"),
    "segment_bm25_top8": put("SELECT query_id, segment_id, chunk_idx, rank, round(score, 6) AS score FROM seg_top", 1),
    "multi_segment_top8": put("SELECT query_id, segment_id, chunk_idx, rank, round(score, 6) AS score FROM multi", 1),
    "sequential_segments_top8": put("SELECT query_id, segment_id, chunk_idx, rank, round(score, 6) AS score FROM multi", 1),
    "sequential_segments_early": put(f"SELECT query_id, segment_id, chunk_idx, rank, round(score, 6) AS score FROM seg_early WHERE rank <= {C.TOP_K}", 1),
    "merged_rounds": put(f"SELECT {HITS} FROM merged WHERE rank <= {C.TOP_K}"),
    "refined_search": put(f"SELECT {HITS} FROM refined WHERE rank <= {C.TOP_K}"),
    "source_coherence": put(f"SELECT {HITS} FROM coherent_8"),
    "score_threshold": put(f"SELECT {HITS} FROM (SELECT *, max(score) FILTER (WHERE rank = 1) OVER (PARTITION BY query_id) AS top FROM coherent_20) WHERE score >= top * 0.5::DOUBLE"),
    "dynamic_top_k": put(f"SELECT n_chunks, (CASE WHEN n_chunks = 0 THEN 8 {TIERS} END)::BIGINT AS top_k FROM (SELECT count(*) AS n_chunks FROM base_chunks)"),
    "reranked": put(f"SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY {_ords(C.RERANK_CHARS)} DESC, rank)::BIGINT AS rank, chunk_id, {_ords(C.RERANK_CHARS)}::DOUBLE AS score FROM two20 JOIN base_chunks USING (chunk_idx)"),
    "scanned": put(f"SELECT query_id, rank, chunk_id FROM (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM (SELECT *, {_ords(C.SCANNER_CHARS)} % 2 = 0 AS yes, bool_or({_ords(C.SCANNER_CHARS)} % 2 = 0) OVER (PARTITION BY query_id) AS any_yes FROM two20 JOIN base_chunks USING (chunk_idx)) WHERE yes OR NOT any_yes) WHERE rank <= {C.SCANNER_KEEP}"),
    "recall_at_8": put("SELECT count(*) AS n_items, count(hit) AS n_found FROM (SELECT query_id, max(CASE WHEN t.chunk_idx IS NOT NULL THEN 1 END) AS hit FROM (SELECT item_id AS query_id, chunk_idx FROM benchmark b, base_chunks c WHERE contains(lower(c.text), lower(b.text))) LEFT JOIN two t USING (query_id, chunk_idx) GROUP BY query_id)"),
    "adjacent_chunks": put("SELECT a.chunk_id, b.chunk_id AS near_id, b.n - a.n AS distance, md5(b.text) AS digest FROM base_chunks a JOIN base_chunks b ON a.source_file = b.source_file AND b.n BETWEEN a.n - 2 AND a.n + 2"),
    "assembled_context": put("SELECT query_id, length(c)::INTEGER AS size, md5(c) AS digest FROM (SELECT query_id, CASE WHEN length(c) <= 32000 THEN c ELSE CASE WHEN contains(left(c, 32000), '.') AND 32000 - instr(reverse(left(c, 32000)), '.') > 25600 THEN left(c, 32001 - instr(reverse(left(c, 32000)), '.')) ELSE left(c, 32000) END || chr(10) || chr(10) || '[Context truncated due to size limit]' END AS c FROM (SELECT query_id, string_agg(text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS c FROM two3 JOIN base_chunks USING (chunk_idx) GROUP BY query_id))"),
    "reconstructed": put("SELECT source_file AS request_id, md5(string_agg('[' || chunk_id || ']' || chr(10) || text, chr(10) || chr(10) ORDER BY chunk_id DESC)) AS digest, round(strlen(string_agg('[' || chunk_id || ']' || chr(10) || text, chr(10) || chr(10) ORDER BY chunk_id DESC))::DOUBLE / (sum(length(chunk_id) + 2) + 8), 6) AS ratio FROM base_chunks GROUP BY source_file"),
    "chunk_lookup": put("SELECT chunk_id, chunk_idx, md5(text) AS digest FROM base_chunks"),
    "conversation_turns": put("SELECT conv_id, turn, chunk_id, ts, md5(text) AS digest FROM turn"),
    "chat_keywords": put("SELECT chunk_id, keyword, tf, rank FROM chat"),
    "conversation_search": put("SELECT query_id, rank, chunk_id, score FROM conv WHERE rank <= 3"),
    "conversation_boost": put(f"SELECT {HITS} FROM (SELECT query_id, chunk_idx, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_idx) AS rank FROM (SELECT query_id, chunk_idx, CASE WHEN chunk_idx % 3 = 0 THEN score * 1.5::DOUBLE ELSE score END AS score FROM two))"),
    "self_query_blend": put(f"SELECT query_id, rank, chunk_id, round(score, 6) AS score FROM (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY part, rank) AS rank FROM (SELECT query_id, chunk_id, score, rank, 0 AS part FROM conv WHERE rank <= 3 UNION ALL SELECT query_id, chunk_id, score, rank, 1 FROM two JOIN base_chunks USING (chunk_idx) WHERE rank <= 5)) WHERE rank <= {C.TOP_K}"),
    "code_discussions": put("SELECT chunk_id FROM refs WHERE list_contains(source_refs, 'src3_001')"),
    "turn_sources": put("SELECT chunk_id, unnest([0, 1, 2])::BIGINT AS pos, unnest(source_refs) AS ref FROM refs"),
    "follow_up_context": put("SELECT chunk_id, length(CASE WHEN length(c) <= 32000 THEN c ELSE CASE WHEN contains(left(c, 32000), '.') AND 32000 - instr(reverse(left(c, 32000)), '.') > 25600 THEN left(c, 32001 - instr(reverse(left(c, 32000)), '.')) ELSE left(c, 32000) END || chr(10) || chr(10) || '[Context truncated due to size limit]' END)::INTEGER AS size FROM (SELECT r.chunk_id, string_agg(text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY pos) AS c FROM (SELECT chunk_id, unnest([0, 1, 2]) AS pos, unnest(source_refs) AS ref FROM refs) r JOIN base_chunks b ON b.chunk_id = ref GROUP BY r.chunk_id)"),
    "guide_last100": put(f"SELECT chunk_id, ts FROM turn ORDER BY ts DESC LIMIT {C.GUIDE_SUMMARIES}"),
    "conversation_rollup": put(f"SELECT (SELECT count(*) FROM turn) AS count, count(*) AS n_summaries, md5(string_agg(chunk_id || '|' || left(user_message, 100) || '|' || array_to_string(source_refs, ','), ';' ORDER BY ts)) AS digest FROM (SELECT t.chunk_id, t.ts, t.user_message, r.source_refs FROM turn t JOIN refs r USING (chunk_id) ORDER BY t.ts DESC LIMIT {C.GUIDE_SUMMARIES})"),
    "max_conversation": put("SELECT max(number) AS max_number FROM turn"),
    "cleared_conversations": put("SELECT chunk_id FROM base_chunks"),
    "lru_turns": f"SELECT *, row_number() OVER (ORDER BY last_access DESC, key) AS rank FROM (SELECT user_id AS key, max(event_id) AS last_access FROM events GROUP BY user_id ORDER BY 2 DESC, 1 LIMIT {C.LRU_TURNS})",
    "catalog_types": put("SELECT 'DOC' AS type, count(*) AS n FROM base_chunks UNION ALL SELECT 'CHAT', count(*) FROM turn"),
    "catalog_sources": put("SELECT source_file, count(*) AS n FROM base_chunks GROUP BY source_file"),
    "catalog_page": put("SELECT chunk_idx, chunk_id FROM base_chunks ORDER BY chunk_idx LIMIT 50 OFFSET 50"),
    "corpus_stats": put(f"SELECT n_chunks, n_files, n_tokens::BIGINT AS n_tokens, (CASE WHEN n_chunks = 0 THEN 8 {TIERS} END)::BIGINT AS top_k, avgdl FROM (SELECT count(*) AS n_chunks, count(DISTINCT source_file) AS n_files, sum(token_end - token_start) AS n_tokens FROM base_chunks), (SELECT round(avg(dl), 6) AS avgdl FROM dst_0)"),
    "fixes_for_file": put("SELECT DISTINCT 'fix' || a.chunk_idx AS fix_id FROM base_chunks a JOIN base_chunks b ON b.chunk_id IN (a.chunk_id, a.next_chunk_id) WHERE contains(b.source_file, 'rc1')"),
    "feature_lookup": put("SELECT chunk_id || '_feature' AS feature_id, source_file FROM base_chunks WHERE contains(chunk_id || '_feature', '17_0') ORDER BY 1 LIMIT 1"),
    "originals_attached": put("SELECT chunk_id, CASE WHEN source_file <> 'src3.txt' THEN source_file END AS file_id, CASE WHEN source_file <> 'src3.txt' THEN upper(source_file) END AS original_name, CASE WHEN source_file <> 'src3.txt' THEN 'text/plain' ELSE 'application/octet-stream' END AS mime FROM base_chunks"),
    "segments_not_loaded": put("SELECT DISTINCT segment_id, 'seg' || segment_id AS dir FROM chunks_1 WHERE segment_id % 2 <> 0"),
    "segment_of_chunk": put("SELECT chunk_idx AS number, segment_id, chunk_idx - min(chunk_idx) OVER (PARTITION BY segment_id) AS chunk_idx FROM chunks_1"),
    "rate_limited_events": """WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts)::DOUBLE / 6e8::DOUBLE AS sec, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts)::DOUBLE / 6e8::DOUBLE, event_id) AS k FROM events),
        s AS (SELECT user_id, event_id, sec, k, 1.0::DOUBLE AS tokens, true AS allowed FROM e WHERE k = 1 UNION ALL
        SELECT user_id, event_id, sec, k, CASE WHEN have >= 1.0 THEN have - 1.0::DOUBLE ELSE have END, have >= 1.0 FROM (SELECT e.*, least(2.0::DOUBLE, s.tokens + greatest(0.0::DOUBLE, e.sec - s.sec) * 2.0::DOUBLE / 60.0::DOUBLE) AS have FROM s JOIN e ON e.user_id = s.user_id AND e.k = s.k + 1))
        SELECT user_id AS key, event_id, allowed FROM s""",
}
