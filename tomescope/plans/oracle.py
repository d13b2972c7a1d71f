"""Independent SQL (DuckDB dialect) for every registered query.

The SQL is written from the semantics, not generated from the Spark plan: CTE fragments
for the catalogue view, the query table, the hashed encoder, BM25 and MMR are composed
per key. Rules that make two engines agree: vectors are float32 values summed in
double, scores are rounded to 6 decimals, and every ranking breaks ties by the smaller id.
"""

from __future__ import annotations

from html.entities import html5

from tomescope.functions.text import (
    EXPANSION_SEPARATOR,
    FALLBACK_COVER,
    HOOK_MAX_CHARS,
    PY_WS,
    QUERY_EXPANSIONS,
    RATING_WORDS_GOOD,
    RATING_WORDS_HIGH,
    SEARCH_URL,
    STAR_EMPTY,
    STAR_FULL,
)
from tomescope.operators.encode import LetterModel
from tomescope.operators.rank import RUN_TOKENS
from tomescope.plans.catalog import CHUNKS, IVFPQ, SMALL, P
from tomescope.sources.tables import CONV_QUERY_BASE, ERAS

DIM = P.dim


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^{PY_WS}+', ''), '{PY_WS}+$', '')"


def tokens(x: str) -> str:
    return f"regexp_extract_all(lower(coalesce({x}, '')), '([\\p{{L}}\\p{{N}}]+)', 1)"


def bucket(t: str, dim: int = DIM) -> str:
    return f"(CAST(('0x' || substr(md5({t}), 1, 8)) AS BIGINT) % {dim})"


def terms(s: str) -> str:
    parts = ", ".join(f"CASE WHEN contains(lower({s}), {q(kw)}) THEN {q(t)} END" for kw, t in QUERY_EXPANSIONS)
    return f"concat_ws(' ', {parts})"


def rating_text(r: str) -> str:
    return f"CASE WHEN {r} >= 4.2 THEN {q(RATING_WORDS_HIGH)} WHEN {r} >= 3.8 THEN {q(RATING_WORDS_GOOD)} ELSE '' END"


BOOKS = """books_v AS (
  SELECT doc_id AS Id,
    CASE WHEN doc_id % 97 = 0 THEN NULL
      WHEN doc_id % 11 = 3 THEN split_part(text, '.', 1) || ' (Vol. ' || CAST(doc_id % 5 AS VARCHAR) || ')'
      WHEN doc_id % 13 = 5 THEN '"' || split_part(text, '.', 1) || '" <no. ' || CAST(doc_id AS VARCHAR) || '>'
      ELSE split_part(text, '.', 1) END AS Name,
    CASE WHEN doc_id % 53 = 0 THEN NULL
      WHEN doc_id % 17 = 2 THEN '"' || source || '-' || CAST(doc_id % 7 AS VARCHAR) || '" <ed>'
      ELSE source || '-' || CAST(doc_id % 7 AS VARCHAR) END AS Authors,
    CAST(20 + floor(CAST(n_chars AS DOUBLE) / 10) AS INTEGER) AS Pages,
    CAST(1850 + (doc_id * 37) % 175 AS INTEGER) AS PublishYear,
    CASE WHEN doc_id % 41 = 0 THEN NULL ELSE CAST(25 + (doc_id * 7919) % 26 AS DOUBLE) / 10 END AS Rating,
    CASE WHEN doc_id % 89 = 0 THEN NULL WHEN doc_id % 19 = 4 THEN '<i>Note</i> A <b>first</b> line. ' || text ELSE text END AS Description
  FROM documents)"""

_eras = ", ".join(q(e) for e in ERAS)
_keywords = ", ".join(q(kw) for kw, _ in QUERY_EXPANSIONS)
QUERIES = f"""qraw AS (
  SELECT item_id AS query_id, text AS query_text FROM benchmark
  UNION ALL
  SELECT {CONV_QUERY_BASE} + conv_id * 1000 + turn AS query_id, text AS query_text FROM conversations WHERE role = 'user'),
qset AS (
  SELECT query_id,
    CASE WHEN query_id % 29 = 3 THEN ' ab '
      WHEN query_id % 7 = 1 THEN 'A ' || upper(([{_keywords}])[CAST(query_id % 10 AS INTEGER) + 1]) || ' tale'
      WHEN query_id % 7 = 2 THEN chr(9) || '  ' || query_text || '  ' || chr(10)
      ELSE query_text END AS query_text,
    ([{_eras}])[CAST(query_id % 4 AS INTEGER) + 1] AS era,
    CAST(CASE WHEN query_id % 31 = 0 THEN 1 ELSE 100 + 50 * ((query_id * 7) % 39) END AS INTEGER) AS max_pages,
    (query_id % 3 = 0) AS acclaimed,
    CAST(511301 + 93107 * (query_id % 6) AS DOUBLE) / 1000000 AS "lambda"
  FROM qraw),
qs1 AS (SELECT *, {strip('query_text')} AS stripped FROM qset),
qs2 AS (SELECT *, coalesce(length(stripped) > 3, false) AS valid,
    len(list_filter(regexp_split_to_array(stripped, '{PY_WS}+'), lambda x: x <> '')) AS n_words,
    {terms('stripped')} AS terms
  FROM qs1),
qprep AS (SELECT *, CASE WHEN n_words < 6 AND terms <> '' THEN stripped || {q(EXPANSION_SEPARATOR)} || terms ELSE stripped END AS expanded FROM qs2),
qvalid AS (SELECT * FROM qprep WHERE valid)"""

STITCHED = f"""s_text AS (
  SELECT Id, concat('Title: ', coalesce(Name, 'Unknown'), '. Author: ', coalesce(Authors, 'Unknown'), '. ',
    {rating_text('Rating')}, 'Summary: ', coalesce(Description, '')) AS text
  FROM books_v)"""


def term_freq(name: str, src: str, id_col: str, text_col: str) -> str:
    return f"""{name}_tok AS (SELECT {id_col} AS id, unnest({tokens(text_col)}) AS token FROM {src}),
{name}_tf AS (SELECT id, token, count(*) AS tf FROM {name}_tok GROUP BY id, token)"""


def doc_freq(name: str, corpus: str) -> str:
    return f"""{name}_df AS (SELECT token, count(*) AS df FROM {name}_tf GROUP BY token),
{name}_n AS (SELECT count(*) AS n FROM {corpus})"""


def cells(name: str, tf: str, stats: str | None, dim: int = DIM) -> str:
    """Unnormalised cells (id, bucket, value) plus per-id norms."""
    if stats:
        w = f"t.tf * ln(1 + CAST((SELECT n FROM {stats}_n) AS DOUBLE) / CAST(coalesce(d.df, 1) AS DOUBLE))"
        src = f"{tf}_tf t LEFT JOIN {stats}_df d ON d.token = t.token"
    else:
        w = "CAST(t.tf AS DOUBLE)"
        src = f"{tf}_tf t"
    return f"""{name}_cell AS (SELECT t.id, {bucket('t.token', dim)} AS bucket, sum({w}) AS value FROM {src} GROUP BY ALL),
{name}_norm AS (SELECT id, CASE WHEN sqrt(sum(value * value)) = 0 THEN 1e-9 ELSE sqrt(sum(value * value)) END AS norm FROM {name}_cell GROUP BY id),
{name}_unit AS (SELECT c.id, c.bucket, CAST(CAST(c.value / n.norm AS FLOAT) AS DOUBLE) AS value FROM {name}_cell c JOIN {name}_norm n USING (id))"""


def dense(name: str, ids_sql: str, dim: int = DIM) -> str:
    return f"""{name}_dense AS (
  SELECT i.id, list(coalesce(u.value, 0.0) ORDER BY g.b) AS vec
  FROM ({ids_sql}) i CROSS JOIN range({dim}) g(b)
  LEFT JOIN {name}_unit u ON u.id = i.id AND u.bucket = g.b
  GROUP BY i.id)"""


def chunked(name: str, src: str, id_col: str, text_col: str, size: int) -> str:
    """Chunks of ``size`` tokens as texts (cid, text); cid is a struct of the id and the chunk's number."""
    return f"""{name}_words AS (SELECT {id_col} AS id, regexp_extract_all(coalesce({text_col}, ''), '([\\p{{L}}\\p{{N}}]+[^\\p{{L}}\\p{{N}}]*)', 1) AS w FROM {src}),
{name} AS (SELECT struct_pack(Id := id, chunk := CAST(k AS INTEGER)) AS cid, array_to_string(list_slice(w, k * {size} + 1, k * {size} + {size}), '') AS text
  FROM (SELECT id, w, unnest(range(greatest(CAST(ceil(len(w) / {size}.0) AS BIGINT), 1))) AS k FROM {name}_words))"""


def best_rows(name: str, scores: str, k: int) -> str:
    return f"""{name} AS (SELECT query_id, Id, score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, Id) AS rank FROM ({scores})) WHERE rank <= {k})"""


def dots(queries: str, items: str, item_id: str) -> str:
    return f"SELECT a.id AS query_id, {item_id} AS Id, max(round(list_dot_product(a.vec, b.vec), 6)) AS score FROM {queries}_dense a CROSS JOIN {items}_dense b GROUP BY ALL"


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


# --- the retrieval chain ---------------------------------------------------------

RETRIEVAL = [
    BOOKS,
    QUERIES,
    STITCHED,
    term_freq("s", "s_text", "Id", "text"),
    doc_freq("s", "books_v"),
    cells("sv", "s", "s"),
    dense("sv", "SELECT Id AS id FROM books_v"),
    term_freq("qt", "qvalid", "query_id", "expanded"),
    cells("qv", "qt", "s"),
    dense("qv", "SELECT query_id AS id FROM qvalid"),
    """scores AS (
  SELECT qd.id AS query_id, sd.id AS Id, round(list_dot_product(qd.vec, sd.vec), 6) AS score
  FROM qv_dense qd CROSS JOIN sv_dense sd)""",
]


def hits(k: int) -> str:
    return f"""hits AS (
  SELECT query_id, Id, retrieval_score, retrieval_rank FROM (
    SELECT query_id, Id, score AS retrieval_score,
      row_number() OVER (PARTITION BY query_id ORDER BY score DESC, Id) AS retrieval_rank
    FROM scores) WHERE retrieval_rank <= {k})"""


FILTERED = f"""filtered AS (
  SELECT h.query_id, h.Id, h.retrieval_score, h.retrieval_rank, b.Rating, q."lambda"
  FROM hits h JOIN books_v b ON b.Id = h.Id JOIN qvalid q ON q.query_id = h.query_id
  WHERE b.Pages IS NOT NULL AND b.Rating IS NOT NULL AND b.Rating >= {min(P.floor_default, P.floor_acclaimed)}
    AND (CASE WHEN q.era = 'Pre-1900' THEN b.PublishYear < 1900
              WHEN q.era = '20th century' THEN b.PublishYear >= 1900 AND b.PublishYear <= 2000
              WHEN q.era = 'Contemporary' THEN b.PublishYear > 2000
              ELSE true END)
    AND b.Pages <= coalesce(q.max_pages, {P.max_pages_default})
    AND b.Rating >= CASE WHEN coalesce(q.acclaimed, false) THEN {P.floor_acclaimed} ELSE {P.floor_default} END)"""

def cut(k: int) -> str:
    return f"""cut AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY retrieval_score DESC, Id) AS cut_rank FROM filtered)
  WHERE cut_rank <= {k})"""


K1, B = P.bm25_k1, P.bm25_b
BM25_STATS = [
    term_freq("d", "books_v", "Id", "Description"),
    doc_freq("d", "books_v"),
    """d_len AS (SELECT id, sum(tf) AS dl FROM d_tf GROUP BY id),
d_avg AS (SELECT CAST((SELECT sum(tf) FROM d_tf) AS DOUBLE) / (SELECT n FROM d_n) AS avgdl)""",
    """q_tok AS (SELECT DISTINCT query_id, token FROM (SELECT query_id, unnest(""" + tokens("query_text") + """) AS token FROM qvalid)),
q_w AS (SELECT q.query_id, q.token,
    ln(1 + (CAST((SELECT n FROM d_n) AS DOUBLE) - CAST(coalesce(d.df, 0) AS DOUBLE) + 0.5) / (CAST(coalesce(d.df, 0) AS DOUBLE) + 0.5)) AS idf
  FROM q_tok q LEFT JOIN d_df d ON d.token = q.token)""",
]


def bm25_term(tf: str, dl: str) -> str:
    return f"(w.idf * CAST({tf} AS DOUBLE) * {K1 + 1} / (CAST({tf} AS DOUBLE) + {K1} * ({1 - B} + {B} * CAST({dl} AS DOUBLE) / (SELECT avgdl FROM d_avg))))"


PAIR_BM25 = f"""pair_bm25 AS (
  SELECT c.query_id, c.Id, round(coalesce(sum({bm25_term('t.tf', 'coalesce(l.dl, 0)')}), 0), 6) AS semantic
  FROM cut c
  LEFT JOIN q_w w ON w.query_id = c.query_id
  LEFT JOIN d_tf t ON t.id = c.Id AND t.token = w.token
  LEFT JOIN d_len l ON l.id = c.Id
  GROUP BY c.query_id, c.Id)"""

BLEND = f"""blend AS (
  SELECT p.query_id, p.Id, p.semantic, c.Rating, c."lambda",
    round(coalesce((p.semantic - min(p.semantic) OVER w) / nullif(max(p.semantic) OVER w - min(p.semantic) OVER w, 0), 0) * {P.w_semantic}
        + coalesce((c.Rating - min(c.Rating) OVER w) / nullif(max(c.Rating) OVER w - min(c.Rating) OVER w, 0), 0) * {P.w_rating}, 6) AS cross_score
  FROM pair_bm25 p JOIN cut c ON c.query_id = p.query_id AND c.Id = p.Id
  WINDOW w AS (PARTITION BY p.query_id))"""

DEDUP = f"""rr AS (
  SELECT m.*, b.Authors, row_number() OVER (PARTITION BY m.query_id ORDER BY m.cross_score DESC, m.Id) AS rerank_rank
  FROM blend m JOIN books_v b ON b.Id = m.Id),
top50 AS (SELECT * FROM rr WHERE rerank_rank <= {P.k_rerank}),
by_author AS (SELECT *, row_number() OVER (PARTITION BY query_id, Authors ORDER BY cross_score DESC, Id) AS ar FROM top50),
dedup AS (
  SELECT * FROM (
    SELECT query_id, Id, Authors, cross_score, "lambda",
      row_number() OVER (PARTITION BY query_id ORDER BY cross_score DESC, Id) AS dedup_rank
    FROM by_author WHERE ar = 1)
  WHERE dedup_rank <= {P.k_dedup})"""


def mmr_ctes(n_picks: int = P.k_final) -> list[str]:
    out = [
        cells("dv", "d", "d"),
        """dv_cand AS (SELECT c.query_id, c.Id, u.bucket, u.value FROM dedup c JOIN dv_unit u ON u.id = c.Id),
dv_cnorm AS (SELECT c.query_id, c.Id,
    CASE WHEN sqrt(coalesce(sum(u.value * u.value), 0)) = 0 THEN 1e-9 ELSE sqrt(sum(u.value * u.value)) END AS nrm
  FROM dedup c LEFT JOIN dv_unit u ON u.id = c.Id GROUP BY c.query_id, c.Id),
sim AS (
  SELECT a.query_id, a.Id AS a_id, b.Id AS b_id, sum(a.value * b.value) / (na.nrm * nb.nrm) AS sim
  FROM dv_cand a JOIN dv_cand b ON a.query_id = b.query_id AND a.bucket = b.bucket
  JOIN dv_cnorm na ON na.query_id = a.query_id AND na.Id = a.Id
  JOIN dv_cnorm nb ON nb.query_id = b.query_id AND nb.Id = b.Id
  GROUP BY a.query_id, a.Id, b.Id, na.nrm, nb.nrm)""",
        """c0 AS (SELECT query_id, Id, cross_score AS rel, "lambda",
    row_number() OVER (PARTITION BY query_id ORDER BY cross_score DESC, Id) AS pos FROM dedup)""",
        """p1 AS (SELECT query_id, Id AS p1, round("lambda" * rel, 6) AS v1 FROM c0 WHERE pos = 1)""",
    ]
    for i in range(2, n_picks + 1):
        joins = " ".join(f"JOIN p{j} USING (query_id)" for j in range(1, i))
        sims = ", ".join(
            f"coalesce((SELECT s.sim FROM sim s WHERE s.query_id = c.query_id AND s.a_id = c.Id AND s.b_id = p{j}.p{j}), 0)"
            for j in range(1, i)
        )
        maxsim = f"greatest({sims})" if i > 2 else sims
        notin = " AND ".join(f"c.Id <> p{j}.p{j}" for j in range(1, i))
        out.append(
            f"""s{i} AS (
  SELECT c.query_id, c.Id, c.pos, round(c."lambda" * c.rel - (1 - c."lambda") * {maxsim}, 6) AS v
  FROM c0 c {joins} WHERE {notin}),
p{i} AS (
  SELECT query_id, Id AS p{i}, v AS v{i} FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY v DESC, pos) AS r FROM s{i}) WHERE r = 1)"""
        )
    union = "\n  UNION ALL ".join(f"SELECT query_id, p{i} AS Id, {i} AS mmr_rank, v{i} AS mmr_score FROM p{i}" for i in range(1, n_picks + 1))
    out.append(f"picks AS (\n  {union})")
    return out


def hook(d: str) -> str:
    sentences = f"string_split(regexp_replace(coalesce({d}, ''), '([.!?]) +', '\\1' || chr(1), 'g'), chr(1))"
    h = f"array_to_string(list_slice({sentences}, 1, 3), ' ')"
    cut = f"CASE WHEN length({h}) > {HOOK_MAX_CHARS} THEN substr({h}, 1, {HOOK_MAX_CHARS}) || '...' ELSE {h} END"
    return f"replace(replace({cut}, '<', '&lt;'), '>', '&gt;')"


def escape_name(x: str) -> str:
    return f"replace(replace({x}, '\"', '&quot;'), '<', '&lt;')"


def stars(r: str) -> str:
    n = f"CAST(floor(round({r}, 1)) AS INTEGER)"
    return f"repeat({q(STAR_FULL)}, {n}) || repeat({q(STAR_EMPTY)}, 5 - {n})"


def search_link(t: str, a: str) -> str:
    return f"{q(SEARCH_URL)} || replace(url_encode(concat_ws(' ', {t}, {a})), '%2F', '/')"


def clean_title(t: str) -> str:
    return strip(f"regexp_replace({t}, '\\(.*?\\)', '', 'g')")


COVERS = f"""covers_v AS (
  SELECT page_id AS cover_id, lower({clean_title("regexp_extract(html, '<title>(.*?)</title>', 1)")}) AS clean_title, NULL AS author, url AS cover_url
  FROM pages
  UNION ALL
  SELECT Id, lower({clean_title("Name")}), Authors, 'https://covers.example.org/' || CAST(Id AS VARCHAR) || '.jpg'
  FROM books_v WHERE Id % 3 = 0 AND Name IS NOT NULL AND Authors IS NOT NULL),
cover1 AS (SELECT clean_title, arg_min(cover_url, cover_id) AS url1 FROM covers_v WHERE clean_title <> '' AND author IS NULL GROUP BY clean_title),
cover2 AS (SELECT clean_title, author, arg_min(cover_url, cover_id) AS url2 FROM covers_v WHERE clean_title <> '' AND author IS NOT NULL GROUP BY clean_title, author)"""
COVER_JOIN = f"""LEFT JOIN cover1 c1 ON c1.clean_title = lower({clean_title("b.Name")})
LEFT JOIN cover2 c2 ON c2.clean_title = lower({clean_title("b.Name")}) AND c2.author = b.Authors"""
COVER_URL = f"coalesce(c2.url2, c1.url1, {q(FALLBACK_COVER)}) AS cover_url"


def entity_map() -> str:
    """Named character references as a map literal, built from Python's table."""
    names = [n for n in html5 if n.endswith(";")]
    return "MAP([" + ", ".join(q("&" + n) for n in names) + "], [" + ", ".join(q(html5[n]) for n in names) + "])"


def card_select(alias: str = "b") -> str:
    t = f"coalesce({alias}.Name, 'Unknown')"
    a = f"coalesce({alias}.Authors, 'Unknown')"
    return f"""{escape_name(t)} AS title, {escape_name(a)} AS author, {hook(alias + '.Description')} AS hook,
    round({alias}.Rating, 1) AS rating, {stars(alias + '.Rating')} AS stars,
    CAST({alias}.Pages AS INTEGER) AS pages, CAST({alias}.PublishYear AS INTEGER) AS year,
    {search_link(t, a)} AS search_link"""


def _sql() -> dict[str, str]:
    s: dict[str, str] = {}
    s["scan_books"] = with_(BOOKS) + (
        f"SELECT Id, Name, Authors, Pages, PublishYear, Rating, Description FROM books_v "
        f"WHERE Pages <= {P.max_pages_default} AND Rating >= {P.floor_default}"
    )
    s["index_roundtrip"] = (
        "SELECT vec_id AS Id, len(embedding) AS n_dims, round(list_sum(CAST(embedding AS DOUBLE[])), 6) AS vsum FROM embeddings"
    )
    s["csv_zstd_roundtrip"] = with_(BOOKS) + "SELECT * FROM books_v"
    stripped = "regexp_replace(html, '<[^>]+>', ' ', 'g')"
    pattern = "&(#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);"
    number = "CASE WHEN lower(substr(r, 3, 1)) = 'x' THEN CAST('0x' || substr(r, 4, length(r) - 4) AS INTEGER) ELSE CAST(substr(r, 3, length(r) - 3) AS INTEGER) END"
    named = f"SELECT page_id, html, {stripped} AS stripped, regexp_extract_all({stripped}, '{pattern}') AS refs, regexp_split_to_array({stripped}, '{pattern}') AS parts FROM pages"
    one = f"CASE WHEN substr(r, 2, 1) = '#' THEN chr({number}) ELSE coalesce(m.m[r], r) END"
    decoded_cte = f"""WITH m AS MATERIALIZED (SELECT {entity_map()} AS m), s AS ({named}),
d AS (SELECT page_id, stripped, array_to_string(list_transform(range(1, len(parts) + 1), lambda i:
    parts[i] || coalesce(list_transform(refs[i:i], lambda r: {one})[1], '')), '') AS decoded FROM s, m)
"""
    decoded = "decoded"
    clean_text = strip(f"regexp_replace({decoded}, '{PY_WS}+', ' ', 'g')")
    s["strip_html"] = decoded_cte + f"SELECT page_id, stripped, decoded, {clean_text} AS clean_text FROM d"
    s["iqr_filter"] = with_(BOOKS) + """SELECT b.Id, b.shelf, b.Pages, q1 - 1.5 * (q3 - q1) AS low, q3 + 1.5 * (q3 - q1) AS high
FROM (SELECT *, CASE WHEN instr(Authors, '-') = 0 THEN Authors ELSE split_part(Authors, '-', 1) END AS shelf FROM books_v) b
JOIN (SELECT CASE WHEN instr(Authors, '-') = 0 THEN Authors ELSE split_part(Authors, '-', 1) END AS shelf,
  CAST(quantile_disc(Pages, 0.25) AS DOUBLE) AS q1, CAST(quantile_disc(Pages, 0.75) AS DOUBLE) AS q3 FROM books_v WHERE Pages IS NOT NULL GROUP BY 1) g
ON b.shelf IS NOT DISTINCT FROM g.shelf WHERE b.Pages BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)"""
    s["expand_by_table"] = with_(QUERIES, """w AS (SELECT doc_id, lower(regexp_extract(text, '^\\W*([A-Za-z]+)\\W+([A-Za-z]+)', 1)) AS keyword,
  lower(regexp_extract(text, '^\\W*([A-Za-z]+)\\W+([A-Za-z]+)', 2)) AS terms FROM documents),
terms AS (SELECT keyword, min(doc_id) AS ord, arg_min(terms, doc_id) AS terms FROM w WHERE length(keyword) >= 4 GROUP BY keyword)""") + (
        f"SELECT query_id, terms_found, CASE WHEN terms_found <> '' THEN stripped || {q(EXPANSION_SEPARATOR)} || terms_found ELSE stripped END AS expanded FROM ("
        "SELECT q.query_id, any_value(q.stripped) AS stripped, coalesce(string_agg(t.terms, ' ' ORDER BY t.ord), '') AS terms_found "
        "FROM qprep q LEFT JOIN terms t ON contains(lower(q.stripped), t.keyword) GROUP BY q.query_id)"
    )
    s["outlier_filter"] = with_(BOOKS) + "SELECT * FROM books_v WHERE Pages BETWEEN 1 AND 2000"
    s["dedup_books"] = with_(BOOKS) + (
        "SELECT Id, Name, Authors, Rating FROM ("
        f"SELECT *, row_number() OVER (PARTITION BY lower({strip('Name')}), Authors ORDER BY Rating DESC NULLS LAST, Id) AS rn "
        "FROM books_v) WHERE rn = 1"
    )
    s["rating_text"] = with_(BOOKS) + f"SELECT Id, Rating, {rating_text('Rating')} AS rating_text FROM books_v"
    s["stitch_text"] = with_(BOOKS, STITCHED) + "SELECT Id, text AS stitched_text FROM s_text"
    s["expand_queries"] = with_(QUERIES) + (
        "SELECT query_id, stripped, n_words, expanded, expanded <> stripped AS was_expanded FROM qprep"
    )
    s["valid_queries"] = with_(QUERIES) + "SELECT query_id, stripped FROM qvalid"
    s["rejected_queries"] = with_(QUERIES) + "SELECT query_id, query_text FROM qprep WHERE NOT valid"
    s["hooks"] = with_(BOOKS) + f"SELECT Id, {hook('Description')} AS hook FROM books_v"
    s["escaped_titles"] = with_(BOOKS) + (
        f"SELECT Id, {escape_name('coalesce(Name, ' + q('Unknown') + ')')} AS title, "
        f"{escape_name('coalesce(Authors, ' + q('Unknown') + ')')} AS author FROM books_v"
    )
    s["stars"] = with_(BOOKS) + f"SELECT Id, round(Rating, 1) AS rating, {stars('Rating')} AS stars FROM books_v"
    s["search_links"] = with_(BOOKS) + (
        f"SELECT Id, {search_link('coalesce(Name, ' + q('Unknown') + ')', 'coalesce(Authors, ' + q('Unknown') + ')')} AS search_link FROM books_v"
    )
    s["part_links"] = f"SELECT p_partkey, {search_link('p_name', 'p_brand')} AS search_link FROM part"
    s["clean_titles"] = with_(BOOKS) + f"SELECT Id, {clean_title('Name')} AS clean_title FROM books_v"
    s["cover_join"] = with_(BOOKS, COVERS) + f"SELECT b.Id, {COVER_URL} FROM books_v b {COVER_JOIN}"
    enc_base = [BOOKS, STITCHED, term_freq("s", "s_text", "Id", "text"), doc_freq("s", "books_v")]
    s["encode_hashed"] = with_(*enc_base, cells("e", "s", None)) + (
        "SELECT c.id AS Id, c.bucket, round(c.value / n.norm, 6) AS value FROM e_cell c JOIN e_norm n USING (id)"
    )
    s["encode_hashed_idf"] = with_(*enc_base, cells("e", "s", "s")) + (
        "SELECT c.id AS Id, c.bucket, round(c.value / n.norm, 6) AS value FROM e_cell c JOIN e_norm n USING (id)"
    )
    s["knn_exact_top10"] = (
        "SELECT query_id, Id, score, rank FROM ("
        "SELECT a.vec_id AS query_id, b.vec_id AS Id, "
        "round(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS score, "
        "row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) DESC, b.vec_id) AS rank "
        "FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id) WHERE rank <= 10"
    )
    s["knn_books_top10"] = with_(*RETRIEVAL) + (
        "SELECT query_id, Id, score, rank FROM ("
        "SELECT query_id, Id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, Id) AS rank FROM scores) "
        "WHERE rank <= 10"
    )
    size = CHUNKS.chunk_tokens
    pieces = [chunked("c_text", "s_text", "Id", "text", size), term_freq("c", "c_text", "cid", "text"), cells("cv", "c", "s"), dense("cv", "SELECT cid AS id FROM c_text")]
    s["encode_chunks"] = with_(*enc_base, *pieces) + "SELECT id.Id AS Id, id.chunk AS chunk, bucket, round(value, 6) AS value FROM cv_unit WHERE value <> 0"
    s["knn_chunks_top10"] = with_(*RETRIEVAL, *pieces, best_rows("found", dots("qv", "cv", "b.id.Id"), 10)) + "SELECT query_id, Id, score, rank FROM found"
    s["chunk_retrieval"] = with_(
        term_freq("w", "documents", "doc_id", "text"), doc_freq("w", "documents"), cells("wv", "w", "w"), dense("wv", "SELECT doc_id AS id FROM documents"),
        term_freq("p", "benchmark", "item_id", "text"), cells("pv", "p", "w"), dense("pv", "SELECT item_id AS id FROM benchmark"),
        chunked("c_text", "documents", "doc_id", "text", size), term_freq("c", "c_text", "cid", "text"), cells("cv", "c", "w"), dense("cv", "SELECT cid AS id FROM c_text"),
        best_rows("by_text", dots("pv", "wv", "b.id"), 10), best_rows("by_chunk", dots("pv", "cv", "b.id.Id"), 10),
        f"dn AS (SELECT doc_id AS id, ' ' || array_to_string({tokens('text')}, ' ') || ' ' AS words FROM documents)",
        f"pn AS (SELECT item_id AS id, ' ' || array_to_string({tokens('text')}, ' ') || ' ' AS words FROM benchmark WHERE len({tokens('text')}) >= {RUN_TOKENS})",
        "held AS (SELECT p.id AS query_id, d.id AS Id FROM pn p JOIN dn d ON contains(d.words, p.words))",
    ) + (
        "SELECT h.query_id, count(*) AS holders, min(t.rank) AS whole_rank, min(c.rank) AS chunk_rank FROM held h "
        "LEFT JOIN by_text t ON t.query_id = h.query_id AND t.Id = h.Id LEFT JOIN by_chunk c ON c.query_id = h.query_id AND c.Id = h.Id GROUP BY h.query_id"
    )
    chain = RETRIEVAL + [hits(P.k_retrieve), FILTERED, cut(P.k_filtered)]
    small = RETRIEVAL + [hits(SMALL.k_retrieve), FILTERED, cut(SMALL.k_filtered)]
    s["candidates_filtered"] = with_(*chain) + "SELECT query_id, Id, retrieval_score, retrieval_rank FROM filtered"
    s["candidates_cut300"] = with_(*chain) + "SELECT query_id, Id, retrieval_score, cut_rank FROM cut"
    s["candidates_cut100"] = with_(*small) + "SELECT query_id, Id, retrieval_score, cut_rank FROM cut"
    s["no_match_queries"] = with_(*chain) + "SELECT query_id FROM qvalid WHERE query_id NOT IN (SELECT query_id FROM cut)"
    s["rejected_results"] = s["rejected_queries"]
    s["bm25_scores"] = with_(BOOKS, QUERIES, *BM25_STATS) + (
        "SELECT query_id, Id, bm25, bm25_rank FROM ("
        "SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY bm25 DESC, Id) AS bm25_rank FROM ("
        f"SELECT w.query_id, t.id AS Id, round(sum({bm25_term('t.tf', 'l.dl')}), 6) AS bm25 "
        "FROM q_w w JOIN d_tf t ON t.token = w.token JOIN d_len l ON l.id = t.id GROUP BY w.query_id, t.id)) "
        "WHERE bm25_rank <= 20"
    )
    rer = BM25_STATS + [PAIR_BM25, BLEND]
    s["minmax_blend"] = with_(*chain, *rer) + "SELECT query_id, Id, semantic, cross_score FROM blend"
    s["author_dedup"] = with_(*chain, *rer, DEDUP) + "SELECT query_id, Id, Authors, cross_score, dedup_rank FROM dedup"
    full = rer + [DEDUP] + mmr_ctes()
    s["mmr_top5"] = with_(*chain, *full) + "SELECT query_id, Id, mmr_rank, mmr_score FROM picks"
    card_rows = (
        f"SELECT p.query_id, p.mmr_rank AS rank, p.Id, {card_select('b')}, {COVER_URL}, d.cross_score, p.mmr_score "
        f"FROM picks p JOIN dedup d ON d.query_id = p.query_id AND d.Id = p.Id JOIN books_v b ON b.Id = p.Id {COVER_JOIN}"
    )
    s["result_cards"] = with_(*chain, *full, COVERS) + card_rows
    s["result_cards_small"] = with_(*small, *full, COVERS) + card_rows
    from tomescope.plans import ann_oracle

    coded = RETRIEVAL[:-1] + [
        "ev AS (SELECT id AS Id, vec FROM sv_dense),\nev_rows AS MATERIALIZED (SELECT Id, unnest(range(len(vec))) AS p, unnest(vec) AS x FROM ev)",
        "eq AS (SELECT id AS Id, vec FROM qv_dense),\neq_rows AS MATERIALIZED (SELECT Id, unnest(range(len(vec))) AS p, unnest(vec) AS x FROM eq)",
        ann_oracle.kmeans("ev", "ev_rows", IVFPQ.nlist, IVFPQ.kmeans_iter),
        ann_oracle.product_quantiser("ev", "ev_rows", IVFPQ.pq_m, 1 << IVFPQ.pq_bits, IVFPQ.kmeans_iter),
        ann_oracle.pq_scores("eq", "eq_rows", IVFPQ.nprobe, IVFPQ.k_retrieve * IVFPQ.refine, False),
        ann_oracle.refined("eq", "ev", "best", IVFPQ.k_retrieve),
        "hits AS (SELECT query_id, Id, score AS retrieval_score, rank AS retrieval_rank FROM best)",
        FILTERED,
        cut(IVFPQ.k_filtered),
    ]
    s["result_cards_ivfpq"] = with_(*coded, *full, COVERS) + card_rows
    letters = [f"CAST(length(t) - length(replace(t, {q(c)}, '')) AS DOUBLE)" for c in LetterModel.LETTERS]

    def letter_vectors(name: str, src: str, id_col: str, text: str) -> str:
        return f"""{name}_l AS (SELECT id, [{", ".join(letters)}] AS v FROM (SELECT {id_col} AS id, coalesce({text}, '') AS t FROM {src})),
{name}_dense AS (SELECT id, list_transform(v, lambda x: CAST(CAST(x / CASE WHEN n = 0 THEN 1e-9 ELSE n END AS FLOAT) AS DOUBLE)) AS vec
  FROM (SELECT id, v, sqrt(list_dot_product(v, v)) AS n FROM {name}_l))"""

    base = [BOOKS, STITCHED, letter_vectors("sv", "s_text", "Id", "text")]
    s["encode_model"] = with_(*base) + (
        f"SELECT id AS Id, CAST(unnest(range({len(letters)})) AS INTEGER) AS p, round(unnest(vec), 6) AS x FROM sv_dense"
    )
    model = [BOOKS, QUERIES, STITCHED, *base[2:], letter_vectors("qv", "qvalid", "query_id", "expanded"), RETRIEVAL[-1]]
    s["model_recommend"] = with_(*model, hits(SMALL.k_retrieve), FILTERED, cut(SMALL.k_filtered)) + (
        "SELECT c.query_id, c.Id, c.retrieval_score, "
        "round(CAST(least(length(qv.query_text), length(coalesce(b.Description, ''))) AS DOUBLE) / greatest(length(qv.query_text), length(coalesce(b.Description, '')), 1), 6) AS semantic "
        "FROM cut c JOIN qvalid qv USING (query_id) JOIN books_v b ON b.Id = c.Id"
    )
    from tomescope.plans import ann_oracle

    s.update(ann_oracle.sql())
    return s


def oracle_sql() -> dict[str, str]:
    return _sql()
