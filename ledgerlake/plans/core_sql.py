"""DuckDB SQL that the registered queries are checked by. RE2 has no lookaround and its own names for classes, so no pattern is shared."""

from __future__ import annotations

WS = r"[\s\x0B\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def words(x: str) -> str:
    return rf"regexp_extract_all(lower({x}), '[\p{{L}}\p{{N}}_]+')"


def sentences(x: str) -> str:
    split = rf"string_split(regexp_replace({x}, '([.!?]){WS}+([A-ZÅÄÖ0-9])', '\1' || chr(1) || '\2', 'g'), chr(1))"
    return f"list_filter(list_transform({split}, lambda s: {strip('s')}), lambda s: s <> '')"


EMPTY = "{'out': []::VARCHAR[], 'cur': '', 'n': 0::BIGINT}"


def oversized(x: str) -> str:
    flush = "(a.n > 0 AND a.n + length(l) + 1 > 1400)"
    slices = "list_transform(range(0, CAST(ceil(length(l) / 1400.0) AS BIGINT)), lambda k: substring(l, CAST(k * 1400 + 1 AS BIGINT), 1400))"
    step = f"""CASE WHEN length(l) > 1400 THEN {{'out': list_concat(CASE WHEN a.n > 0 THEN list_append(a.out, a.cur) ELSE a.out END, {slices}), 'cur': '', 'n': 0::BIGINT}}
        ELSE {{'out': CASE WHEN {flush} THEN list_append(a.out, a.cur) ELSE a.out END, 'cur': CASE WHEN {flush} OR a.n = 0 THEN l ELSE a.cur || chr(10) || l END,
        'n': CAST(CASE WHEN {flush} THEN 0 ELSE a.n END + length(l) + 1 AS BIGINT)}} END"""
    packed = f"list_reduce(list_filter(string_split({x}, chr(10)), lambda l: {strip('l')} <> ''), lambda a, l: {step}, {EMPTY})"
    return f"CASE WHEN length({x}) <= 1400 THEN [{x}] ELSE (SELECT CASE WHEN r.n > 0 THEN list_append(r.out, r.cur) ELSE r.out END FROM (SELECT {packed} AS r)) END"


def packed(units: str) -> str:
    flush = "(a.n > 0 AND a.n + length(u) + 1 > 1400)"
    cur = f"CASE WHEN {flush} OR a.n = 0 THEN u ELSE a.cur || ' ' || u END"
    out = f"CASE WHEN {flush} THEN list_append(a.out, a.cur) ELSE a.out END"
    n = f"CAST(CASE WHEN {flush} THEN 0 ELSE a.n END + length(u) + 1 AS BIGINT)"
    return f"list_reduce({units}, lambda a, u: CASE WHEN {n} >= 1000 THEN {{'out': list_append({out}, {cur}), 'cur': '', 'n': 0::BIGINT}} ELSE {{'out': {out}, 'cur': {cur}, 'n': {n}}} END, {EMPTY})"


def numbered(inner: str, key: str, value: str) -> str:
    """One row per element with its place from 0."""
    return f"SELECT {key}, CAST(i - 1 AS INTEGER) AS seq, list[i] AS {value} FROM (SELECT {key}, list, unnest(range(1, len(list) + 1)) AS i FROM ({inner}))"


# the pieces of each unit are joined again in order; a unit of at most 1,400 characters is its own piece
_PIECES = f"""
sent AS (SELECT id, unnest(list) AS unit, generate_subscripts(list, 1) AS place FROM (SELECT id, {sentences('text')} AS list FROM source WHERE text IS NOT NULL)),
cut AS (SELECT id, place, {oversized('unit')} AS pieces FROM sent),
units AS (SELECT id, flatten(list(pieces ORDER BY place)) AS units FROM cut GROUP BY id),
done AS (SELECT id, {packed('units')} AS r FROM units),
packed AS (SELECT id, CASE WHEN r.n > 0 THEN list_append(r.out, r.cur) ELSE r.out END AS list FROM done)"""

_BYTES = """WITH source AS (SELECT CAST(doc_id AS VARCHAR) AS id, text FROM documents WHERE text IS NOT NULL),
pieces AS (SELECT id, list_transform(string_split(text, '. '), lambda s, i: CASE WHEN i = len(string_split(text, '. ')) THEN s ELSE s || '. ' END) AS p FROM source WHERE strlen(text) > 15000),
folded AS (SELECT id, list_reduce(p, lambda a, x: CASE WHEN a.cur <> '' AND strlen(a.cur) + strlen(x) > 15000 THEN {'out': list_append(a.out, a.cur), 'cur': x} ELSE {'out': a.out, 'cur': a.cur || x} END, {'out': []::VARCHAR[], 'cur': ''}) AS r FROM pieces),
lists AS (SELECT id, CASE WHEN r.cur <> '' THEN list_append(r.out, r.cur) ELSE r.out END AS list FROM folded),
parts AS (SELECT id || '::del' || i AS chunk_id, list[i] AS text FROM (SELECT id, list, unnest(range(1, len(list) + 1)) AS i FROM lists) UNION ALL SELECT id, text FROM source WHERE strlen(text) <= 15000)"""

_LATEST_PAGES = "latest AS (SELECT * FROM page_texts QUALIFY row_number() OVER (PARTITION BY document, page_number ORDER BY extracted_at DESC NULLS LAST, page_id DESC) = 1)"
_LATEST_FILINGS = "heads AS (SELECT * FROM filings QUALIFY row_number() OVER (PARTITION BY document ORDER BY received_at DESC NULLS LAST, company DESC NULLS LAST) = 1)"
_LISTED = """entries AS (SELECT document, unnest(map_entries(statement_pages)) AS e FROM heads),
listed AS (SELECT document, e.key AS section, unnest(e.value) AS page, generate_subscripts(e.value, 1) - 1 AS place FROM entries)"""
_TEXT_PAGES = f"prose AS (SELECT l.* FROM latest l ANTI JOIN listed ON l.document = listed.document AND l.page_number = listed.page WHERE length({strip('l.text')}) >= 30)"

_PAIRS = "list_filter(list_zip(row_columns, row_values), lambda p: p[1] IS NOT NULL AND p[2] IS NOT NULL)"
_VALUES = f"""CASE WHEN len({_PAIRS}) > 0 THEN array_to_string(list_transform({_PAIRS}, lambda p: p[2] || ' (' || {strip("regexp_replace(p[1], '^[−– -]+', '')")} || ')'), ', ') ELSE 'inget värde angivet' END"""
_ROWS = f"""{_LATEST_FILINGS}, {_LISTED},
names AS (SELECT h.document, coalesce(c.display_name, upper(substring(h.company, 1, 1)) || substring(h.company, 2)) AS display, h.company, h.fiscal_year FROM heads h LEFT JOIN company_years c USING (company)),
stated AS (SELECT r.row_id, r.document, r.page, l.section, n.display, n.company, n.fiscal_year,
    n.display || ' ' || l.section || ' ' || n.fiscal_year || ': ' || r.label || ' var ' || {_VALUES} || '.' AS sentence,
    row_number() OVER (PARTITION BY r.document, l.section ORDER BY l.place, r.row_id) - 1 AS place_no
    FROM financial_rows r JOIN listed l ON r.document = l.document AND r.page = l.page JOIN names n ON n.document = r.document WHERE r.label IS NOT NULL)"""

_QUESTIONS = r"""asked AS (SELECT row_id AS query, label || ' ' || replace(regexp_replace(document, '_\d+\.pdf$', ''), '_', ' ') AS text, document, label
    FROM financial_rows WHERE row_id % 20 = 0 AND label IS NOT NULL AND document IS NOT NULL)"""


def bm25(corpus: str, asked: str) -> str:
    """CTEs ending in `scores` (query, doc, score) over the relations corpus (doc, text) and asked (query, text)."""
    return f"""
spoken AS (SELECT doc, {words('text')} AS w FROM {corpus}),
shape AS (SELECT count(*) AS n, avg(coalesce(len(w), 0)) AS mean FROM spoken),
tf AS (SELECT doc, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT doc, unnest(w) AS term, len(w) AS dl FROM spoken WHERE w IS NOT NULL) GROUP BY doc, term),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
raw AS (SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM df, shape),
idf AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw),
qt AS (SELECT query, term, count(*) AS qtf FROM (SELECT query, unnest({words('text')}) AS term FROM {asked}) GROUP BY query, term),
scores AS (SELECT query, doc, score FROM (SELECT query, doc, round(sum(qtf * idf * (tf * 2.5) / (tf + 1.5 * (0.25 + 0.75 * dl / mean))), 6) AS score
    FROM tf JOIN qt USING (term) JOIN idf USING (term), shape GROUP BY query, doc) WHERE score > 0)"""


_BM25_CHUNKS = f"corpus AS (SELECT chunk_no AS doc, text FROM chunks), {_QUESTIONS}, {bm25('corpus', 'asked')}"
_TOP = "top AS (SELECT query, doc, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM scores QUALIFY rank <= 10)"
_TOP_FACTS = "top AS (SELECT query, doc, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM scores SEMI JOIN (SELECT chunk_no AS doc FROM chunks WHERE chunk_type = 'fact') USING (doc) QUALIFY rank <= 10)"
_LABEL = "CASE WHEN len(pages) > 0 THEN 's. ' || array_to_string(pages, ', ') ELSE 'sida okänd' END"
_RANKS = """facts AS (SELECT chunk_no AS doc, document, text AS fact FROM chunks WHERE chunk_type = 'fact'),
accepted AS (SELECT DISTINCT query, doc FROM asked JOIN facts USING (document) WHERE contains(fact, ': ' || label || ' var ')),
ranks AS (SELECT q.query, min(t.rank) AS rank FROM (SELECT DISTINCT query FROM accepted) q LEFT JOIN accepted a USING (query) LEFT JOIN top t ON t.query = a.query AND t.doc = a.doc GROUP BY q.query)"""

_COSINE = "round(list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))), 6)"


def nearest(extra: str, k: int) -> str:
    return f"""WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings),
near AS (SELECT a.vec_id AS query, b.vec_id AS doc, {_COSINE} AS similarity FROM e a JOIN e b ON a.vec_id % 20 = 0 {extra})
SELECT query, doc, similarity, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, doc) AS rank FROM near QUALIFY rank <= {k}"""


_TWO = f"""docs AS (SELECT doc_id AS doc, text, company FROM documents),
held AS (SELECT vec_id AS doc, CAST(embedding AS DOUBLE[]) AS v, company FROM embeddings LEFT JOIN docs ON vec_id = doc),
asked AS (SELECT d.doc AS query, text, d.company, v FROM docs d LEFT JOIN held USING (doc) WHERE d.doc % 20 = 0), {bm25('docs', 'asked')},
near AS (SELECT a.query, b.doc, {_COSINE} AS similarity FROM asked a JOIN held b ON a.v IS NOT NULL)"""


def ranked(source: str, score: str, name: str) -> str:
    return f"{name} AS (SELECT query, doc, row_number() OVER (PARTITION BY query ORDER BY {score} DESC, doc) AS rank FROM {source} QUALIFY rank <= 100)"


def traced(vector: str, lexical: str) -> str:
    return f"""joined AS (SELECT query, doc, a.rank AS vector_rank, b.rank AS bm25_rank FROM {vector} a FULL JOIN {lexical} b USING (query, doc)),
summed AS (SELECT *, round(coalesce(1.0::DOUBLE / (5 + vector_rank), 0) + coalesce(1.0::DOUBLE / (5 + bm25_rank), 0), 12) AS rrf_score FROM joined),
fused AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY rrf_score DESC, doc) AS fused_rank FROM summed)"""


_FILING_QUESTIONS = r"""f AS (SELECT DISTINCT document, company, fiscal_year, substring(fiscal_year, 1, 4) AS y, upper(substring(company, 1, 1)) || substring(company, 2) AS named FROM filings WHERE company IS NOT NULL AND fiscal_year IS NOT NULL),
forms AS (SELECT document, unnest([
    'Vad var ' || named || 's nettoomsättning ' || fiscal_year || '?', 'Hur har soliditeten i ' || company || ' utvecklats ' || CAST(CAST(y AS INT) - 1 AS VARCHAR) || '-' || y || '?',
    named || 'koncernens rörelsemarginal och ROE ' || y, 'Summa tillgångar ' || replace(fiscal_year, '-', '/') || ' hos ' || upper(company),
    'Fritt kassaflöde från ' || y || ' till ' || CAST(CAST(y AS INT) + 1 AS VARCHAR) || ', alla bolag']) AS text, unnest([0, 1, 2, 3, 4]) AS form FROM f),
questions AS (SELECT document || '#' || form AS query_id, text FROM forms)"""
_RANGE = r"((?:19|20)[0-9]{2})[\s]*[/\-–][\s]*([0-9]{4}|[0-9]{2})"
_BROKEN = "CAST(CAST({y} AS INT) - 1 AS VARCHAR) || '-' || substring(CAST({y} AS VARCHAR), 3, 2)"

_EXPANSIONS = """(VALUES (1, 'bruttomarginal', ['bruttovinst', 'nettoomsättning', 'omsättning']), (2, 'rörelsemarginal', ['rörelseresultat', 'nettoomsättning', 'omsättning']),
(3, 'vinstmarginal', ['nettoresultat', 'årets resultat', 'nettoomsättning', 'omsättning']), (4, 'soliditet', ['eget kapital', 'summa tillgångar']), (5, 'skuldsättningsgrad', ['summa skulder', 'eget kapital']),
(6, 'kassalikviditet', ['omsättningstillgångar', 'varulager', 'kortfristiga skulder']), (7, 'roe', ['nettoresultat', 'eget kapital']), (8, 'avkastning på eget kapital', ['nettoresultat', 'eget kapital']),
(9, 'roa', ['nettoresultat', 'summa tillgångar']), (10, 'avkastning på totalt kapital', ['nettoresultat', 'summa tillgångar']), (11, 'fritt kassaflöde', ['kassaflöde från den löpande verksamheten', 'investeringar']),
(12, 'ebitda', ['rörelseresultat', 'avskrivningar'])) e(place, name, items)"""

_HEADINGS = {
    "koncern": {"resultaträkning": ["koncernens resultaträkning", "koncernens rapport över rörelseresultat", "koncernens rapport över totalresultat"], "balansräkning": ["koncernens balansräkning", "rapport över finansiell ställning för koncernen"], "kassaflödesanalys": ["koncernens kassaflödesanalys", "koncernens rapport över kassaflöden", "rapport över kassaflöden för koncernen"]},
    "moderbolag": {"resultaträkning": ["resultaträkning för moderbolaget", "moderbolagets resultaträkning", "moderföretagets resultaträkning"], "balansräkning": ["balansräkning för moderbolaget", "moderbolagets balansräkning", "moderföretagets balansräkning"], "kassaflödesanalys": ["kassaflödesanalys för moderbolaget", "moderbolagets kassaflödesanalys", "moderföretagets kassaflödesanalys", "moderbolagets rapport över kassaflöden", "moderföretagets rapport över kassaflöden"]},
}


def _section(level: str) -> str:
    whens = " ".join(f"WHEN {' OR '.join(f'starts_with(low, {p!r})' for p in phrases)} THEN '{name}'" for name, phrases in _HEADINGS[level].items())
    return f"CASE {whens} END"




def integer(v: str) -> str:
    return f"TRY_CAST(regexp_replace(regexp_replace({v}, '^[−–-]', '-'), '[.,]|{WS}', '', 'g') AS BIGINT)"


_BOXES = """boxes AS (SELECT l_orderkey AS page, CAST((l_linenumber * 100000 + l_partkey) * 1000 + l_quantity AS BIGINT) AS ord, p_name AS text, CAST(l_partkey * 7 % 560 AS DOUBLE) AS x0, l_partkey * 7 % 560 + l_quantity AS x1, l_suppkey % 40 * 1.25::DOUBLE AS top FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def islands(source: str, key: str, start: str, end: str, gap: float) -> str:
    """Adds `island` from 0: a row joins the one before it if it starts at most `gap` after its end."""
    return f"""marked AS (SELECT *, coalesce(CAST({start} - lag({end}) OVER (PARTITION BY {key} ORDER BY {start}, ord) > {gap} AS INT), 0) AS apart FROM {source}),
chained AS (SELECT *, CAST(sum(apart) OVER (PARTITION BY {key} ORDER BY {start}, ord ROWS UNBOUNDED PRECEDING) AS INTEGER) AS island FROM marked)"""


_MERGE = """reach AS (SELECT *, coalesce(CAST(x0 > max(x1) OVER (PARTITION BY page ORDER BY x0, x1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS INT), 0) AS fresh FROM spans),
numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY page ORDER BY x0, x1 ROWS UNBOUNDED PRECEDING) AS island FROM reach),
merged AS (SELECT page, min(x0) AS x0, max(x1) AS x1 FROM numbered GROUP BY page, island)"""

_PARSED = f"""named AS (SELECT q.query_id, any_value(q.text) AS text, min(c.company) AS company FROM questions q LEFT JOIN company_years c ON contains(lower(q.text), c.company) GROUP BY q.query_id),
spans AS (SELECT query_id, text, company, regexp_extract_all(text, '{_RANGE}', 1) AS a, regexp_extract_all(text, '{_RANGE}', 2) AS b, regexp_extract_all(regexp_replace(text, '{_RANGE}', '~', 'g'), '(?:19|20)[0-9]{{2}}') AS alone FROM named),
one AS (SELECT query_id, text, company, alone, unnest(list_zip(a, b)) AS p FROM spans),
cand AS (
    SELECT query_id, p[1] || '-' || p[2] AS y FROM one WHERE length(p[2]) = 2
    UNION ALL SELECT query_id, unnest([CAST(y AS VARCHAR), {_BROKEN.format(y='y')}]) FROM (SELECT query_id, unnest(range(CAST(p[1] AS INT), CAST(p[2] AS INT) + 1)) AS y FROM one WHERE length(p[2]) = 4)
    UNION ALL SELECT query_id, unnest([y, {_BROKEN.format(y='y')}]) FROM (SELECT query_id, unnest(alone) AS y FROM spans)),
valid AS (SELECT DISTINCT company, unnest(fiscal_years) AS y FROM company_years),
kept AS (SELECT n.query_id, list_sort(list(DISTINCT c.y)) AS years FROM named n JOIN cand c USING (query_id) JOIN valid v ON v.y = c.y AND (n.company IS NULL OR v.company = n.company) GROUP BY n.query_id)"""
_FILTERED = """SELECT n.query_id, n.text, n.company, coalesce(k.years, []::VARCHAR[]) AS years FROM named n LEFT JOIN kept k USING (query_id)"""
_ADDED = f"""named_items AS (SELECT query_id, place, unnest(items) AS item, generate_subscripts(items, 1) AS k FROM questions JOIN {_EXPANSIONS} ON contains(lower(text), name)),
firsts AS (SELECT query_id, item, min(place * 100 + k) AS nth FROM named_items GROUP BY query_id, item), added AS (SELECT query_id, string_agg(item, ' ' ORDER BY nth) AS extra FROM firsts GROUP BY query_id)"""
_EXPANDED = """SELECT query_id, CASE WHEN extra IS NULL THEN text ELSE text || ' ' || extra END AS text FROM questions LEFT JOIN added USING (query_id)"""


def hashed(source: str, key: str) -> str:
    """CTEs ending in `{key}_vec` (key, place, x): the hashed vectors of unit length over the relation (key, text), by place."""
    return f"""{key}_words AS (SELECT {key}, unnest({words('text')}) AS word FROM {source}),
{key}_places AS (SELECT {key}, CAST('0x' || substring(md5(word), 1, 8) AS BIGINT) AS h FROM {key}_words),
{key}_sums AS (SELECT {key}, (h // 2) % 64 AS place, sum(1 - 2 * (h % 2))::DOUBLE AS x FROM {key}_places GROUP BY ALL),
{key}_vec AS (SELECT {key}, place, x / sqrt(sum(x * x) OVER (PARTITION BY {key})) AS x FROM {key}_sums)"""


def prefixed(prefix: str, key: str, source: str) -> str:
    return f"(SELECT {key}, '{prefix}' || text AS text FROM {source} WHERE text <> '')"


_PASSAGES = prefixed("passage: ", "doc", "corpus")
_HYBRID = f"""corpus AS (SELECT chunk_no AS doc, text, company, fiscal_year FROM chunks), {_QUESTIONS},
questions AS (SELECT query AS query_id, text FROM asked), {_PARSED}, {_ADDED},
limits AS ({_FILTERED}), longer AS ({_EXPANDED}),
want AS (SELECT l.query_id AS query, e.text, l.company, l.years, l.company IS NOT NULL OR len(l.years) > 0 AS filtered FROM limits l JOIN longer e USING (query_id)),
{bm25('corpus', 'want')}, {hashed(_PASSAGES, 'doc')}, {hashed(prefixed('query: ', 'query', 'want'), 'query')},
cosines AS (SELECT query, doc, round(sum(a.x * b.x), 6) AS similarity FROM query_vec a JOIN doc_vec b USING (place) GROUP BY query, doc),
near AS (SELECT query, doc, coalesce(similarity, 0) AS similarity FROM (SELECT query, doc FROM (SELECT DISTINCT query FROM query_vec), (SELECT DISTINCT doc FROM doc_vec)) LEFT JOIN cosines USING (query, doc)),
near_own AS (SELECT n.* FROM near n JOIN want w USING (query) JOIN corpus c USING (doc) WHERE (w.company IS NULL OR w.company = c.company) AND (len(w.years) = 0 OR list_contains(w.years, c.fiscal_year))),
score_own AS (SELECT n.* FROM scores n JOIN want w USING (query) JOIN corpus c USING (doc) WHERE (w.company IS NULL OR w.company = c.company) AND (len(w.years) = 0 OR list_contains(w.years, c.fiscal_year))),
{ranked('near', 'similarity', 'va')}, {ranked('scores', 'score', 'le')}, {ranked('near_own', 'similarity', 'vo')}, {ranked('score_own', 'score', 'lo')},
hits AS (SELECT query, count(*) AS n FROM (SELECT query FROM vo UNION ALL SELECT query FROM lo) GROUP BY query),
wide AS (SELECT a.query, NOT filtered OR coalesce(n, 0) < 3 AS up FROM want a LEFT JOIN hits USING (query)),
vf AS (SELECT vo.* FROM vo JOIN wide USING (query) WHERE NOT up UNION ALL SELECT va.* FROM va JOIN wide USING (query) WHERE up),
lf AS (SELECT lo.* FROM lo JOIN wide USING (query) WHERE NOT up UNION ALL SELECT le.* FROM le JOIN wide USING (query) WHERE up), {traced('vf', 'lf')}"""


def assigned(centres: str, n: int | str) -> str:
    """A fold of the list `n` of numbers (at, text) on centres: the texts that the columns hold."""
    far = f"list_transform({centres}, lambda c: abs(x.at - c))"
    best = f"list_position({far}, list_min({far}))"
    own = f"{{'text': x.text, 'far': list_min({far})}}"
    nearer = f"(list_min({far}) < a[{best}].far)"
    put = lambda held, place, v: f"list_transform({held}, lambda o, k: CASE WHEN k = {place} THEN {v} ELSE o END)"
    free = lambda test, pick: f"{pick}(list_filter(range(1, {n} + 1), lambda i: a[i].text IS NULL AND i {test} {best}))"
    right, left = free(">", "list_min"), free("<", "list_max")
    to = f"CASE WHEN x.at >= {centres}[{best}] THEN coalesce({right}, {left}) ELSE coalesce({left}, {right}) END"
    moved = f"{{'text': CASE WHEN {nearer} THEN a[{best}].text ELSE x.text END, 'far': 'inf'::DOUBLE}}"
    kept = f"CASE WHEN {nearer} THEN {put('a', best, own)} ELSE a END"
    step = f"CASE WHEN a[{best}].text IS NULL THEN {put('a', best, own)} WHEN {to} IS NULL THEN {kept} ELSE {put(kept, to, moved)} END"
    empty = f"list_transform({centres}, lambda c: {{'text': NULL::VARCHAR, 'far': 'inf'::DOUBLE}})"
    return f"list_transform(list_reduce(n, lambda a, x: {step}, {empty}), lambda h: h.text)"


_LIFTED = """shown AS (SELECT query, doc, vector_rank, bm25_rank, rrf_score, fused_rank FROM fused WHERE fused_rank <= 8),
lifted AS (SELECT *, round(rrf_score / max(rrf_score) OVER (PARTITION BY query), 6) AS bar,
    CASE WHEN (vector_rank IS NULL OR vector_rank > 10) AND bm25_rank <= 10 THEN 'text' WHEN (bm25_rank IS NULL OR bm25_rank > 10) AND vector_rank <= 10 THEN 'vector' END AS lift FROM shown)"""
_HYBRID_VECTORS = f"""corpus AS (SELECT chunk_no AS doc, text FROM chunks), {_QUESTIONS}, {hashed(_PASSAGES, 'doc')}, {hashed(prefixed('query: ', 'query', 'asked'), 'query')},
cosines AS (SELECT query, doc, round(sum(a.x * b.x), 6) AS similarity FROM query_vec a JOIN doc_vec b USING (place) GROUP BY query, doc),
near AS (SELECT query, doc, coalesce(similarity, 0) AS similarity FROM (SELECT query, doc FROM (SELECT DISTINCT query FROM query_vec), (SELECT DISTINCT doc FROM doc_vec)) LEFT JOIN cosines USING (query, doc))"""

#: Line numbers (from 0) of the list w of words by top: a word belongs to a line if its top is near that of the line's first word.
_LINE_FOLD = """list_reduce(w, lambda a, x: {'lines': list_append(a.lines, CAST(CASE WHEN a.anchor IS NOT NULL AND abs(x.top - a.anchor) <= 2 THEN a.n ELSE a.n + 1 END AS INTEGER)),
    'n': CAST(CASE WHEN a.anchor IS NOT NULL AND abs(x.top - a.anchor) <= 2 THEN a.n ELSE a.n + 1 END AS INTEGER), 'anchor': CASE WHEN a.anchor IS NOT NULL AND abs(x.top - a.anchor) <= 2 THEN a.anchor ELSE x.top END},
    {'lines': []::INTEGER[], 'n': -1::INTEGER, 'anchor': NULL::DOUBLE}).lines"""

SQL: dict[str, str] = {
    "bm25_topk": f"WITH {_BM25_CHUNKS}, {_TOP} SELECT query, doc, score, rank FROM top",
    "bm25_filtered_topk": f"WITH {_BM25_CHUNKS}, {_TOP_FACTS} SELECT query, doc, score, rank FROM top",
    "idf_table": f"WITH corpus AS (SELECT chunk_no AS doc, text FROM chunks), asked AS (SELECT 0 AS query, '' AS text), {bm25('corpus', 'asked')} SELECT term, df, round(idf, 6) AS idf FROM idf",
    "vector_topk": nearest("", 10),
    "vector_topk_filtered": nearest("AND a.label = b.label", 10),
    "rrf_fuse": f"WITH {_TWO}, {ranked('near', 'similarity', 'va')}, {ranked('scores', 'score', 'le')}, {traced('va', 'le')} SELECT query, doc, rrf_score, fused_rank FROM fused WHERE fused_rank <= 10",
    "hybrid_trace": f"WITH {_TWO}, {ranked('near', 'similarity', 'va')}, {ranked('scores', 'score', 'le')}, {traced('va', 'le')} SELECT query, doc, vector_rank, bm25_rank, rrf_score, fused_rank FROM fused",
    "hybrid_fallback": f"""WITH {_TWO}, {ranked('near', 'similarity', 'va')}, {ranked('scores', 'score', 'le')},
near_own AS (SELECT n.* FROM near n JOIN asked a ON a.query = n.query JOIN held b ON b.doc = n.doc WHERE a.company = b.company),
score_own AS (SELECT s.* FROM scores s JOIN asked a ON a.query = s.query JOIN docs b ON b.doc = s.doc WHERE a.company = b.company),
{ranked('near_own', 'similarity', 'vo')}, {ranked('score_own', 'score', 'lo')},
hits AS (SELECT query, count(*) AS n FROM (SELECT query FROM vo UNION ALL SELECT query FROM lo) GROUP BY query),
wide AS (SELECT a.query, a.company IS NULL OR coalesce(n, 0) < 3 AS up FROM asked a LEFT JOIN hits USING (query)),
vf AS (SELECT vo.* FROM vo JOIN wide USING (query) WHERE NOT up UNION ALL SELECT va.* FROM va JOIN wide USING (query) WHERE up),
lf AS (SELECT lo.* FROM lo JOIN wide USING (query) WHERE NOT up UNION ALL SELECT le.* FROM le JOIN wide USING (query) WHERE up), {traced('vf', 'lf')}
SELECT query, doc, vector_rank, bm25_rank, rrf_score, fused_rank FROM fused WHERE fused_rank <= 10""",
    "question_contexts": f"""WITH {_BM25_CHUNKS}, {_TOP} SELECT query, string_agg('[' || rank || '] (' || document || ', ' || {_LABEL} || ')' || CASE WHEN coalesce(section, '') <> '' THEN ' | ' || section ELSE '' END || chr(10) || {strip('text')}, chr(10) || chr(10) ORDER BY rank) AS context
FROM top JOIN chunks ON doc = chunk_no WHERE rank <= 3 GROUP BY query""",
    "source_summary": f"WITH {_BM25_CHUNKS}, {_TOP} SELECT query, document, list_sort(list(DISTINCT page)) AS pages FROM (SELECT query, document, unnest(pages) AS page FROM top JOIN chunks ON doc = chunk_no) GROUP BY query, document",
    "result_lines": f"""WITH {_BM25_CHUNKS}, {_TOP} SELECT query, rank, '[' || rank || '] ' || document || ' s.' || array_to_string(pages, ', ') || ' - ' || chunk_type || CASE WHEN coalesce(section, '') <> '' THEN ' (' || section || ')' ELSE '' END || chr(10)
|| CASE WHEN length(text) <= 300 THEN text ELSE substring(text, 1, 300) || '...' END AS line FROM top JOIN chunks ON doc = chunk_no""",
    "no_answer_flag": f"SELECT doc_id, starts_with({strip('text')}, 'Jag hittar inte svaret i underlaget.') AS is_no_answer FROM documents WHERE text IS NOT NULL",
    "recall_mrr": f"""WITH {_BM25_CHUNKS}, {_TOP_FACTS}, {_RANKS} SELECT count(*) AS queries, round(avg(CASE WHEN rank <= 1 THEN 1.0::DOUBLE ELSE 0 END), 6) AS recall_1, round(avg(CASE WHEN rank <= 3 THEN 1.0::DOUBLE ELSE 0 END), 6) AS recall_3,
round(avg(CASE WHEN rank <= 5 THEN 1.0::DOUBLE ELSE 0 END), 6) AS recall_5, round(avg(coalesce(1.0::DOUBLE / rank, 0)), 6) AS mrr FROM ranks""",
    "outcome_pivot": f"""WITH {_BM25_CHUNKS}, {_TOP_FACTS}, {_RANKS} SELECT CASE WHEN contains(label, 'per aktie') THEN 'per aktie' ELSE 'post' END AS type, count(*) FILTER (rank = 1) AS "right", count(*) FILTER (rank > 1) AS partial, count(*) FILTER (rank IS NULL) AS wrong
FROM ranks JOIN asked USING (query) GROUP BY 1""",
    "parse_filters": f"WITH {_FILING_QUESTIONS},\n{_PARSED}\n{_FILTERED}",
    "expand_query": f"WITH {_FILING_QUESTIONS}, {_ADDED}\n{_EXPANDED}",
    "hybrid_questions": f"WITH {_HYBRID} SELECT query, doc, vector_rank, bm25_rank, rrf_score, fused_rank FROM fused WHERE fused_rank <= 8",
    "ranking_lift": f"WITH {_HYBRID}, {_LIFTED} SELECT * FROM lifted",
    "trace_summary": f"WITH {_HYBRID}, {_LIFTED} SELECT query, count(*) AS shown, max(rrf_score) AS best, count(*) FILTER (lift = 'text') AS lifted_by_text, count(*) FILTER (lift = 'vector') AS lifted_by_vector FROM lifted GROUP BY query",
    "vector_results": f"WITH {_HYBRID_VECTORS} SELECT query, rank, doc, document, pages, section, chunk_type, round(1 - similarity, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, doc) AS rank FROM near QUALIFY rank <= 5) JOIN chunks ON doc = chunk_no",
    "company_years": "SELECT company, list_sort(list(DISTINCT fiscal_year) FILTER (fiscal_year IS NOT NULL)) AS fiscal_years FROM filings WHERE company IS NOT NULL GROUP BY company",
    "sentence_split": numbered(f"SELECT doc_id, {sentences('text')} AS list FROM documents WHERE text IS NOT NULL", "doc_id", "sentence"),
    "chunk_pack": f"WITH source AS (SELECT doc_id AS id, text FROM documents), {_PIECES} {numbered('SELECT id AS doc_id, list FROM packed', 'doc_id', 'piece')}",
    "oversize_split": numbered(f"SELECT doc_id, {oversized('text')} AS list FROM documents WHERE text IS NOT NULL", "doc_id", "piece"),
    "byte_split": f"{_BYTES} SELECT chunk_id, text FROM parts",
    "base_ids": rf"{_BYTES} SELECT chunk_id, regexp_replace(chunk_id, '::del[0-9]+$', '') AS base FROM parts",
    "latest_pages": f"WITH {_LATEST_PAGES} SELECT document, page_number, page_id FROM latest",
    "text_pages_anti": f"WITH {_LATEST_PAGES}, {_LATEST_FILINGS}, {_LISTED}, {_TEXT_PAGES} SELECT document, page_number, page_id FROM prose",
    "text_chunks": f"""WITH {_LATEST_PAGES}, {_LATEST_FILINGS}, {_LISTED}, {_TEXT_PAGES}, source AS (SELECT page_id AS id, {strip('text')} AS text FROM prose), {_PIECES},
pieces AS (SELECT id, CAST(i - 1 AS INTEGER) AS piece, list[i] AS text FROM (SELECT id, list, unnest(range(1, len(list) + 1)) AS i FROM (SELECT id, list_filter(list, lambda p: length({strip('p')}) >= 30) AS list FROM packed)))
SELECT document, page_number, piece, pieces.text FROM pieces JOIN prose ON id = page_id QUALIFY row_number() OVER (PARTITION BY document, {strip('pieces.text')} ORDER BY page_number, piece) = 1""",
    "fact_chunks": f"WITH {_ROWS} SELECT document || '::' || section || '::rad' || place_no AS chunk_id, document, company, fiscal_year, 'fact' AS chunk_type, section, [page] AS pages, sentence AS text FROM stated",
    "table_chunks": f"""WITH {_ROWS}, whole AS (SELECT document, section, display, company, fiscal_year, string_agg(sentence, ' ' ORDER BY place_no) AS body FROM stated GROUP BY ALL),
pages AS (SELECT document, section, list_sort(list(page)) AS pages FROM listed GROUP BY ALL)
SELECT document || '::' || section AS chunk_id, document, company, fiscal_year, 'table' AS chunk_type, section, pages, display || ' ' || section || ' ' || fiscal_year || '. ' || body AS text FROM whole JOIN pages USING (document, section)""",
    "locate_headings": f"""WITH {_LATEST_FILINGS}, lines AS (SELECT page_id, p.document, page_number, statement_level, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM page_texts p LEFT JOIN heads h USING (document) WHERE text IS NOT NULL),
low AS (SELECT *, lower({strip('line')}) AS low FROM lines WHERE length({strip('line')}) <= 55),
named AS (SELECT page_id, document, page_number, CAST(line_no AS INTEGER) AS line_no, CASE WHEN statement_level = 'moderbolag' THEN {_section('moderbolag')} ELSE {_section('koncern')} END AS section FROM low)
SELECT * FROM named WHERE section IS NOT NULL""",
    "page_sections": f"""WITH {_LATEST_FILINGS}, {_LISTED}, last AS (SELECT document, page, arg_max(section, CASE section WHEN 'resultaträkning' THEN 0 WHEN 'balansräkning' THEN 1 WHEN 'kassaflödesanalys' THEN 2 END) AS section FROM listed GROUP BY document, page)
SELECT page_id, p.document, page_number, section FROM page_texts p LEFT JOIN last l ON l.document = p.document AND l.page = p.page_number""",
    "balance_check": f"""WITH firsts AS (SELECT document, row_id, label, {integer("list_filter(row_values, lambda v: v IS NOT NULL)[1]")} AS amount FROM financial_rows WHERE len(list_filter(row_values, lambda v: v IS NOT NULL)) > 0),
sums AS (SELECT document, arg_max_null(amount, row_id) FILTER (label = 'Summa tillgångar') AS assets, arg_max_null(amount, row_id) FILTER (label = 'Summa eget kapital och skulder') AS liabilities FROM firsts GROUP BY document)
SELECT *, assets = liabilities AS balances FROM sums WHERE assets IS NOT NULL AND liabilities IS NOT NULL""",
    "plain_integers": f"SELECT * FROM (SELECT row_id, CAST(place - 1 AS INTEGER) AS place, {integer('value')} AS number FROM (SELECT row_id, unnest(row_values) AS value, generate_subscripts(row_values, 1) AS place FROM financial_rows)) WHERE number IS NOT NULL",
    "row_violations": r"""WITH held AS (SELECT *, list_filter(row_values, lambda v: v IS NOT NULL) AS present FROM financial_rows)
SELECT row_id, 'label length' AS violation FROM held WHERE label IS NULL OR length(label) NOT BETWEEN 2 AND 120
UNION ALL SELECT row_id, 'label without letters' FROM held WHERE label IS NOT NULL AND NOT regexp_matches(label, '\p{L}')
UNION ALL SELECT row_id, 'no value' FROM held WHERE coalesce(len(present), 0) = 0
UNION ALL SELECT row_id, 'arity' FROM held WHERE len(row_values) <> len(row_columns)
UNION ALL SELECT row_id, 'not a number' FROM held WHERE len(list_filter(present, lambda v: NOT regexp_matches(v, '^[−\-–]?[0-9][0-9\s\x0B.,]*$'))) > 0""",
    "chunk_violations": """SELECT chunk_no, 'section' AS violation FROM chunks WHERE (chunk_type = 'text') <> (section IS NULL)
UNION ALL SELECT chunk_no, 'no page' FROM chunks WHERE coalesce(len(pages), 0) = 0 UNION ALL SELECT chunk_no, 'fact pages' FROM chunks WHERE chunk_type = 'fact' AND coalesce(len(pages), 0) <> 1
UNION ALL SELECT chunk_no, 'text length' FROM chunks WHERE chunk_type = 'text' AND length(text) > 3000 UNION ALL SELECT chunk_no, 'no document' FROM chunks WHERE coalesce(document, '') = ''""",
    "repeated_ids": "SELECT chunk_id, count(*) AS copies FROM chunks GROUP BY chunk_id HAVING copies > 1",
    "repeated_texts": f"SELECT document, chunk_type, md5({strip('text')}) AS text_md5, count(*) AS copies FROM chunks WHERE text IS NOT NULL GROUP BY ALL HAVING copies > 1",
    "metadata_export": "SELECT chunk_id AS id, text, document, company, fiscal_year, chunk_type, coalesce(section, '') AS section, array_to_string(pages, ',') AS pages FROM chunks",
    "metadata_import": "SELECT chunk_id, document, company, fiscal_year, chunk_type, section, coalesce(pages, []::INT[]) AS pages, text FROM chunks",
    "document_overview": f"""WITH {_LATEST_FILINGS}, held AS (SELECT document, count(DISTINCT page_number) AS pages_held, CAST(sum(coalesce(len({words('text')}), 0)) AS BIGINT) AS words FROM page_texts GROUP BY document)
SELECT h.document, company, fiscal_year, n_pages, pages_held, words FROM heads h LEFT JOIN held USING (document)""",
    "line_groups": f"""WITH {_BOXES}, pages AS (SELECT page, list({{'top': top, 'ord': ord}} ORDER BY top, ord) AS w FROM boxes GROUP BY page),
folded AS (SELECT page, w, {_LINE_FOLD} AS lines FROM pages)
SELECT page, w[i].ord AS ord, lines[i] AS line FROM (SELECT page, w, lines, unnest(range(1, len(w) + 1)) AS i FROM folded)""",
    "phrases": f"WITH {_BOXES}, {islands('boxes', 'page', 'x0', 'x1', 8)} SELECT page, island AS phrase, string_agg(text, ' ' ORDER BY x0, ord) AS text, min(x0) AS x0, list(x1 ORDER BY x0, ord)[-1] AS x1 FROM chained GROUP BY page, island",
    "year_clusters": f"WITH centred AS (SELECT l_orderkey AS page, l_linenumber AS ord, CAST(l_partkey * 7 % 560 AS DOUBLE) + 12 AS centre FROM lineitem), {islands('centred', 'page', 'centre', 'centre', 150)} SELECT page, ord, island AS cluster FROM chained",
    "interval_merge": f"WITH {_BOXES}, spans AS (SELECT page, x0, x1 FROM boxes), {_MERGE} SELECT page, x0, x1 FROM merged",
    "column_assign": f"WITH {_BOXES}, pages AS (SELECT page, list({{'at': x0, 'text': text}} ORDER BY x0, ord) AS n FROM boxes GROUP BY page) SELECT page, {assigned('[100.0::DOUBLE, 200, 300, 400, 500]', 5)} AS held FROM pages",
    "number_merge": """WITH v AS (SELECT row_id, unnest(row_values) AS value, generate_subscripts(row_values, 1) - 1 AS place FROM financial_rows),
w AS (SELECT row_id, place, unnest(string_split(value, ' ')) AS text, generate_subscripts(string_split(value, ' '), 1) - 1 AS ord, string_split(value, ' ') AS ws FROM v WHERE value IS NOT NULL),
b AS (SELECT row_id, place, ord, text, 5.0 * (length(array_to_string(ws[1:ord], ' ')) + CAST(ord > 0 AS INT)) AS x0 FROM w),
l AS (SELECT *, lag(text) OVER o AS before, coalesce(x0 - lag(x0 + 5.0 * length(text)) OVER o <= 6, false) AS near FROM b WINDOW o AS (PARTITION BY row_id, place ORDER BY x0, ord)),
g AS (SELECT *, CASE WHEN near AND regexp_full_match(before, '[−–-]') AND regexp_full_match(text, '[0-9]+') THEN '' WHEN near AND regexp_full_match(before, '[−–-]?[0-9][0-9.,]*') AND regexp_full_match(text, '[0-9]{3}') THEN ' ' END AS glue FROM l),
t AS (SELECT *, CAST(sum(CAST(glue IS NULL AS INT)) OVER (PARTITION BY row_id, place ORDER BY x0, ord ROWS UNBOUNDED PRECEDING) - 1 AS INTEGER) AS token FROM g),
j AS (SELECT row_id, CAST(place AS INTEGER) AS place, token, string_agg(coalesce(glue, '') || text, '' ORDER BY x0, ord) AS text FROM t GROUP BY ALL)
SELECT *, CASE WHEN regexp_full_match(text, '[−–-]') THEN 'dash' WHEN regexp_full_match(text, '[−–-]?[0-9][0-9., ]*') THEN 'number' ELSE 'word' END AS kind FROM j""",
    "gutter_detect": f"""WITH {_BOXES}, spans AS (SELECT page, greatest(x0, 180) AS x0, least(x1, 420) AS x1 FROM boxes WHERE x1 > 180 AND x0 < 420), {_MERGE},
gaps AS (SELECT page, coalesce(lag(x1) OVER (PARTITION BY page ORDER BY x0), 180) AS a, x0 AS b FROM merged UNION ALL SELECT page, max(x1), 420 FROM merged GROUP BY page),
best AS (SELECT page, a, b FROM gaps WHERE b > a QUALIFY row_number() OVER (PARTITION BY page ORDER BY b - a DESC, a) = 1) SELECT page, (a + b) / 2 AS gutter FROM best WHERE b - a >= 10""",
}

SQL["split_report"] = f"SELECT count(*) AS chunks, count(*) FILTER (n > 1) AS split, coalesce(sum(n), 0) AS parts FROM (SELECT regexp_replace(chunk_id, '::del[0-9]+$', '') AS base, count(*) AS n FROM ({SQL['byte_split']}) GROUP BY base)"
SQL["all_chunks"] = f"""WITH {_LATEST_FILINGS} SELECT chunk_id, document, company, fiscal_year, chunk_type, section, pages, text FROM ({SQL['table_chunks']})
UNION ALL SELECT chunk_id, document, company, fiscal_year, chunk_type, section, pages, text FROM ({SQL['fact_chunks']})
UNION ALL SELECT document || '::p' || page_number || '::' || piece, document, company, fiscal_year, 'text', NULL, [page_number], text FROM ({SQL['text_chunks']}) JOIN heads USING (document)"""
SQL["column_text"] = f"""WITH {_BOXES}, gut AS ({SQL['gutter_detect']}),
placed AS (SELECT b.*, gutter, CASE WHEN (x0 + x1) / 2 < gutter THEN 0 ELSE 1 END AS half FROM boxes b LEFT JOIN gut USING (page)),
sided AS (SELECT page, ord, text, x0, top, CASE WHEN gutter IS NULL OR count(DISTINCT half) OVER (PARTITION BY page) < 2 THEN 0 ELSE half END AS side FROM placed),
pages AS (SELECT page, side, list({{'top': top, 'ord': ord, 'x0': x0, 'text': text}} ORDER BY top, ord) AS w FROM sided GROUP BY page, side),
folded AS (SELECT page, side, w, {_LINE_FOLD} AS lines FROM pages),
told AS (SELECT page, side, lines[i] AS line, w[i] AS x FROM (SELECT page, side, w, lines, unnest(range(1, len(w) + 1)) AS i FROM folded)),
lined AS (SELECT page, side, line, string_agg(x.text, ' ' ORDER BY x.x0, x.top, x.ord) AS t FROM told GROUP BY page, side, line),
halves AS (SELECT page, side, string_agg(t, chr(10) ORDER BY line) AS t FROM lined GROUP BY page, side)
SELECT 'orders' AS document, page, string_agg(t, chr(10) ORDER BY side) AS text FROM halves GROUP BY page"""
_AREA = "document, page, head, region"
SQL["extract_rows"] = f"""WITH {_LATEST_PAGES},
lines AS (SELECT document, page_number AS page, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS ln0 FROM latest WHERE text IS NOT NULL AND document IS NOT NULL AND page_number IS NOT NULL),
cells AS (SELECT document, page, ln0, unnest(c) AS t, generate_subscripts(c, 1) - 1 AS cell FROM (SELECT *, regexp_split_to_array(regexp_replace(line, '^ +| +$', '', 'g'), ' {{2,}}') AS c FROM lines)),
parts AS (SELECT document, page, ln0, cell, length(t) AS n, unnest(ws) AS text, generate_subscripts(ws, 1) - 1 AS k, ws FROM (SELECT *, string_split(t, ' ') AS ws FROM cells WHERE t <> '')),
begun AS (SELECT document, page, ln0 * 100000 + cell * 1000 + k AS ord, text, ln0 * 12.0::DOUBLE AS top, CASE WHEN cell = 0 THEN 40.0::DOUBLE ELSE 300.0 + 90.0 * cell - 5.0 * n END + 5.0 * (length(array_to_string(ws[1:k], ' ')) + CASE WHEN k > 0 THEN 1 ELSE 0 END) AS x0 FROM parts WHERE text <> ''),
w AS (SELECT *, x0 + 5.0 * length(text) AS x1, length(text) <= 14 AND regexp_matches(text, '(19|20)[0-9]{{2}}') AS year, dense_rank() OVER (PARTITION BY document, page ORDER BY top) - 1 AS ln FROM begun),
h AS (SELECT *, sum(CAST(year AS INT)) OVER l >= 2 OR sum(CAST(year AS INT)) OVER l >= 1 AND bool_or(lower(regexp_replace(text, '^:+|:+$', '', 'g')) IN ('mkr', 'msek', 'tsek', 'tkr', 'ksek', 'sek')) OVER l AS header FROM w WINDOW l AS (PARTITION BY document, page, ln)),
g AS (SELECT *, max(CASE WHEN header THEN ln END) OVER (PARTITION BY document, page ORDER BY ln) AS head FROM h),
y AS (SELECT *, (x0 + x1) / 2 AS centre FROM g WHERE header AND year),
ya AS (SELECT *, coalesce(CAST(centre - lag(centre) OVER (PARTITION BY document, page, ln ORDER BY centre, ord) > 150 AS INT), 0) AS apart FROM y),
yc AS (SELECT *, sum(apart) OVER (PARTITION BY document, page, ln ORDER BY centre, ord ROWS UNBOUNDED PRECEDING) AS region FROM ya),
cl AS (SELECT document, page, ln AS head, region, any_value(top) AS line_top, min(x0) AS anchor, list(centre ORDER BY centre, ord) AS centres, list(trim(text) ORDER BY centre, ord) AS labels FROM yc GROUP BY document, page, ln, region),
cn AS (SELECT *, lag(anchor) OVER o AS before, lead(anchor) OVER o IS NULL AS last, count(*) OVER (PARTITION BY document, page, head) AS n FROM cl WINDOW o AS (PARTITION BY document, page, head ORDER BY region)),
own AS (SELECT c.document, c.page, c.head, c.region, min(g.x0) AS lo FROM cn c JOIN g ON g.document = c.document AND g.page = c.page AND g.ln = c.head
    WHERE NOT g.year AND (g.x1 <= anchor OR last) AND (before IS NULL OR g.x1 > before) AND (n = 1 OR anchor - g.x1 <= 400) GROUP BY ALL),
lefts AS (SELECT cn.*, least(anchor, lo) AS "left" FROM cn LEFT JOIN own USING ({_AREA})),
reg AS (SELECT *, coalesce(lead("left") OVER (PARTITION BY document, page, head ORDER BY region), 'inf'::DOUBLE) AS "right" FROM lefts),
pa AS (SELECT *, coalesce(CAST(x0 - lag(x1) OVER (PARTITION BY document, page, ln ORDER BY x0, ord) > 8 AS INT), 0) AS apart FROM g WHERE NOT year),
pc AS (SELECT *, sum(apart) OVER (PARTITION BY document, page, ln ORDER BY x0, ord ROWS UNBOUNDED PRECEDING) AS phrase FROM pa),
pn AS (SELECT document, page, ln, any_value(top) AS top, phrase, string_agg(text, ' ' ORDER BY x0, ord) AS name, (min(x0) + arg_max(x1, (x0, ord))) / 2 AS middle FROM pc GROUP BY document, page, ln, phrase),
pl AS (SELECT document, page, ln, any_value(top) AS top, list(name ORDER BY phrase) AS every, list(middle ORDER BY phrase) AS middles FROM pn WHERE regexp_matches(name, '\\p{{L}}') GROUP BY document, page, ln),
cand AS (SELECT r.document, r.page, r.head, r.region, p.ln, every, len(centres) AS n, list_transform(centres, lambda c: every[list_position(list_transform(middles, lambda m: abs(c - m)), list_min(list_transform(middles, lambda m: abs(c - m))))]) AS names
    FROM reg r JOIN pl p ON p.document = r.document AND p.page = r.page AND p.ln BETWEEN r.head - 4 AND r.head - 1 AND r.line_top - p.top > 0 AND r.line_top - p.top <= 45 WHERE len(list_distinct(labels)) < len(labels)),
seg AS (SELECT {_AREA}, arg_max(names, ln) AS names FROM cand WHERE len(every) >= 2 AND len(every) < n AND n % len(every) = 0
    AND len(list_filter(every, lambda e: len(list_filter(names, lambda x: x = e)) * len(every) <> n)) = 0 GROUP BY ALL),
named AS (SELECT reg.* EXCLUDE (labels), CASE WHEN names IS NULL THEN labels ELSE list_transform(list_zip(names, labels), lambda z: z[1] || ' ' || z[2]) END AS labels FROM reg LEFT JOIN seg USING ({_AREA})),
ins AS (SELECT g.document, g.page, g.head, r.region, r.centres, r.labels, g.ln, g.top, g.ord, g.text, g.x0, g.x1 FROM g JOIN named r ON r.document = g.document AND r.page = g.page AND r.head = g.head
    WHERE NOT header AND g.x0 >= r."left" - 5 AND g.x0 < least(r."right", list_max(r.centres) + 25)),
il AS (SELECT *, lag(text) OVER o AS prior, coalesce(x0 - lag(x1) OVER o <= 6, false) AS near FROM ins WINDOW o AS (PARTITION BY {_AREA}, ln ORDER BY x0, ord)),
ig AS (SELECT *, CASE WHEN near AND regexp_full_match(prior, '[−–-]') AND regexp_full_match(text, '[0-9]+') THEN '' WHEN near AND regexp_full_match(prior, '[−–-]?[0-9][0-9.,]*') AND regexp_full_match(text, '[0-9]{{3}}') THEN ' ' END AS glue FROM il),
it AS (SELECT *, sum(CAST(glue IS NULL AS INT)) OVER (PARTITION BY {_AREA}, ln ORDER BY x0, ord ROWS UNBOUNDED PRECEDING) AS token FROM ig),
tok AS (SELECT {_AREA}, ln, any_value(top) AS top, any_value(centres) AS centres, any_value(labels) AS labels, token, string_agg(coalesce(glue, '') || text, '' ORDER BY x0, ord) AS text, (min(x0) + arg_max(x1, (x0, ord))) / 2 AS mid FROM it GROUP BY {_AREA}, ln, token),
kinds AS (SELECT *, regexp_full_match(text, '[−–-]') AS dash, regexp_full_match(text, '[−–-]?[0-9][0-9., ]*') AND list_min(list_transform(centres, lambda c: abs(mid - c))) <= 25 AS value FROM tok),
ll AS (SELECT {_AREA}, ln, any_value(top) AS top, any_value(centres) AS centres, any_value(labels) AS labels, coalesce(list({{'at': mid, 'text': text}} ORDER BY mid, token) FILTER (value), []) AS n, coalesce(string_agg(text, ' ' ORDER BY token) FILTER (NOT value AND NOT dash), '') AS said FROM kinds GROUP BY {_AREA}, ln),
lp AS (SELECT *, coalesce(sum(CAST(len(n) > 0 AS INT)) OVER (PARTITION BY {_AREA} ORDER BY ln ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS part FROM ll),
lb AS (SELECT *, trim(array_to_string(list_filter(list(said) OVER (PARTITION BY {_AREA}, part ORDER BY ln ROWS UNBOUNDED PRECEDING), lambda x: x <> ''), ' ')) AS label FROM lp),
lr AS (SELECT *, CAST(len(n) > 0 AND length(label) BETWEEN 2 AND 120 AS INT) AS is_row FROM lb),
lg AS (SELECT *, coalesce(CAST(top - lag(top) OVER (PARTITION BY {_AREA} ORDER BY ln) > 36 AND sum(is_row) OVER (PARTITION BY {_AREA} ORDER BY ln ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 0 AS INT), 0) AS apart FROM lr),
le AS (SELECT *, max(apart) OVER (PARTITION BY {_AREA} ORDER BY ln ROWS UNBOUNDED PRECEDING) AS ended FROM lg)
SELECT document, page, CAST(row_number() OVER (PARTITION BY document, page ORDER BY ln, region) AS INTEGER) AS row_no, label, {assigned('centres', 'len(centres)')} AS row_values, labels AS row_columns FROM le WHERE is_row = 1 AND ended = 0"""
