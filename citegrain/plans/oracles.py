"""SQL restatements of the queries, for an independent engine on the same tables.

Written from the rules, not from the Spark plans; texts are cut by a recursive query and
patterns avoid look-around. Table names are the driver's.
"""

from __future__ import annotations

TOKEN = "[가-힣]+|[A-Za-z0-9]+(?:[-_./][A-Za-z0-9]+)*"


def tokens(text: str) -> str:
    return (
        f"flatten(list_transform(regexp_extract_all(lower({text}), '{TOKEN}'), lambda x: "
        "CASE WHEN regexp_matches(x, '[-_./]') THEN list_concat([x], "
        "regexp_extract_all(x, '[A-Za-z0-9]+')) ELSE [x] END))"
    )


def plain(text: str) -> str:
    return f"regexp_extract_all(lower({text}), '[가-힣]+|[A-Za-z0-9]+')"


def clean(text: str) -> str:
    return (
        f"trim(regexp_replace(regexp_replace(replace({text}, chr(173), ''), '-\\s*\\n', '', 'g'), "
        "'\\s+', ' ', 'g'))"
    )


def padded(number: str) -> str:
    return f"CASE WHEN {number} < 1000 THEN lpad(({number})::VARCHAR, 3, '0') ELSE ({number})::VARCHAR END"


def chunk_ctes(source: str, prefix: str = "") -> str:
    """CTEs ending in ``{prefix}chunk(paper_id, page, chunk_id, chunk_index, text)``.

    ``source`` selects paper_id, page and text; texts hold no headings.
    """
    p = prefix
    return f"""
{p}base AS (SELECT paper_id, page, {clean('text')} AS t FROM ({source})),
{p}cut(paper_id, page, t, n, s, e, k) AS (
  SELECT paper_id, page, t, length(t), 0::BIGINT, 0::BIGINT, 0 FROM {p}base WHERE t <> ''
  UNION ALL
  SELECT paper_id, page, t, n, ns,
         CASE WHEN n - ns <= 1200 THEN n
              WHEN bl >= 600 THEN ns + bl
              WHEN sp > 600 THEN ns + sp
              ELSE ns + 1200 END, k + 1
  FROM (SELECT *,
          length(regexp_extract(w, '(?s)^(.*[.!?]["”'')\\]]?)(?:\\s|$)', 1)) AS bl,
          length(regexp_extract(w, '(?s)^(.*) ', 1)) AS sp
        FROM (SELECT *, substr(t, ns + 1, 1200) AS w
              FROM (SELECT *, CASE WHEN k = 0 THEN 0 ELSE least(e,
                      CASE WHEN raw < e AND substr(t, raw, 1) <> ' '
                             AND instr(substr(t, raw + 1, e - raw), ' ') > 0
                           THEN raw + instr(substr(t, raw + 1, e - raw), ' ')
                           ELSE raw END) END AS ns
                    FROM (SELECT *, greatest(s + 1, e - 200) AS raw FROM {p}cut
                          WHERE k = 0 OR e < n))))
),
{p}chunk AS (
  SELECT paper_id, page, text, idx AS chunk_index,
         paper_id || '-p' || ({padded('page')}) || '-c' || ({padded('idx')}) AS chunk_id
  FROM (SELECT paper_id, page, trim(substr(t, s + 1, e - s)) AS text,
               row_number() OVER (PARTITION BY paper_id, page ORDER BY k) AS idx
        FROM {p}cut WHERE k > 0 AND trim(substr(t, s + 1, e - s)) <> '')
)"""


DOCUMENTS = "SELECT source AS paper_id, doc_id + 1 AS page, text FROM documents"
CONVERSATIONS = (
    "SELECT 'conv-' || conv_id AS paper_id, turn + 1 AS page, text FROM conversations "
    "WHERE role <> 'user'"
)
BENCHMARK = "SELECT item_id AS query_id, 'collection' AS paper_id, text AS question FROM benchmark"
USER_TURNS = (
    "SELECT conv_id || ':' || turn AS query_id, 'conv-' || conv_id AS paper_id, text AS question "
    "FROM conversations u WHERE role = 'user'"
)
COLLECTION = (
    "WITH RECURSIVE " + chunk_ctes(DOCUMENTS, "d_")
    + ", chunk AS (SELECT 'collection' AS paper_id, page, chunk_id, chunk_index, text, "
    "paper_id AS source_paper FROM d_chunk), ask AS (" + BENCHMARK + ")"
)
PER_CONVERSATION = (
    "WITH RECURSIVE " + chunk_ctes(CONVERSATIONS) + ", ask AS (" + USER_TURNS + ")"
)


def bm25_ctes() -> str:
    """CTEs ending in ``bm25(query_id, paper_id, chunk_id, score)`` for every pair of a
    question and a chunk of its paper."""
    return f"""
tok AS (SELECT paper_id, chunk_id, {tokens('text')} AS words FROM chunk),
tf AS (SELECT paper_id, chunk_id, term, count(*) AS tf
       FROM (SELECT paper_id, chunk_id, unnest(words) AS term FROM tok) GROUP BY ALL),
len AS (SELECT paper_id, chunk_id, len(words) AS length FROM tok),
paper AS (SELECT paper_id, count(*) AS n, avg(length) AS avgdl FROM len GROUP BY 1),
df AS (SELECT paper_id, term, count(*) AS df FROM tf GROUP BY ALL),
raw AS (SELECT paper_id, term, df, ln(n - df + 0.5) - ln(df + 0.5) AS r FROM df JOIN paper USING (paper_id)),
idf AS (SELECT paper_id, term, df, CASE WHEN r < 0 THEN 0.25 * avg(r) OVER (PARTITION BY paper_id)
        ELSE r END AS idf FROM raw),
qtf AS (SELECT query_id, paper_id, term, count(*) AS qtf
        FROM (SELECT query_id, paper_id, unnest({tokens('question')}) AS term FROM ask) GROUP BY ALL),
hit AS (SELECT query_id, q.paper_id, tf.chunk_id,
               sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / avgdl))) AS score
        FROM qtf q JOIN idf USING (paper_id, term) JOIN tf USING (paper_id, term)
        JOIN len ON len.paper_id = tf.paper_id AND len.chunk_id = tf.chunk_id
        JOIN paper ON paper.paper_id = tf.paper_id GROUP BY ALL),
bm25 AS (SELECT a.query_id, a.paper_id, c.chunk_id, coalesce(score, 0) AS score
         FROM ask a JOIN chunk c ON a.paper_id = c.paper_id
         LEFT JOIN hit h ON h.query_id = a.query_id AND h.paper_id = a.paper_id
           AND h.chunk_id = c.chunk_id)"""


def dense_ctes() -> str:
    """CTEs ending in ``dense(query_id, paper_id, chunk_id, score)``: hashed token counts
    of length one, compared by inner product."""
    return f"""
slots AS (
  SELECT 'c' AS side, paper_id, chunk_id AS id,
         unnest({tokens("'passage: ' || text")}) AS term FROM chunk
  UNION ALL
  SELECT 'q', paper_id, query_id::VARCHAR, unnest({tokens("'query: ' || question")}) FROM ask),
counts AS (SELECT side, paper_id, id, ('0x' || substr(md5(term), 1, 4))::INT % 64 AS slot,
                  count(*)::DOUBLE AS c FROM slots GROUP BY ALL),
unit AS (SELECT *, (c / sqrt(sum(c * c) OVER (PARTITION BY side, paper_id, id)))::FLOAT::DOUBLE AS w
         FROM counts),
dense AS (SELECT a.query_id, a.paper_id, p.id AS chunk_id, sum(q.w * p.w) AS score
          FROM ask a
          JOIN unit q ON q.side = 'q' AND q.paper_id = a.paper_id AND q.id = a.query_id::VARCHAR
          JOIN unit p ON p.side = 'c' AND p.paper_id = a.paper_id AND p.slot = q.slot
          GROUP BY ALL)"""


def top(source: str, k: int = 20, order: str = "round(score, 9) DESC, chunk_id") -> str:
    return (
        f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, paper_id ORDER BY "
        f"{order}) AS rank FROM {source}) WHERE rank <= {k}"
    )


def pool_ctes() -> str:
    """CTEs ending in ``fused``: the union of both top-20 lists, ranked."""
    return (
        bm25_ctes() + "," + dense_ctes() + f""",
b20 AS ({top('bm25')}), v20 AS ({top('dense')}),
fused AS (
  SELECT *, row_number() OVER (PARTITION BY query_id, paper_id ORDER BY round(score, 9) DESC, chunk_id) AS rank
  FROM (SELECT query_id, paper_id, chunk_id, sum(1.0::DOUBLE / (60 + rank)) AS score,
               max(CASE WHEN source = 'bm25' THEN rank END) AS bm25_rank,
               max(CASE WHEN source = 'dense' THEN rank END) AS dense_rank
        FROM (SELECT 'bm25' AS source, * FROM b20 UNION ALL SELECT 'dense', * FROM v20)
        GROUP BY query_id, paper_id, chunk_id))"""
    )


def guarded_ctes(page: str = "c.page", k: int = 20) -> str:
    """CTEs ending in ``guarded``: page 1 keeps one of the ``k`` slots when it is in reach."""
    return pool_ctes() + f""",
paged AS (SELECT f.*, {page} AS page FROM fused f JOIN chunk c USING (paper_id, chunk_id)),
flag AS (SELECT *, max((page = 1 AND rank <= {k})::INT) OVER w AS present,
                min(CASE WHEN page = 1 THEN rank END) OVER w AS best
         FROM paged WINDOW w AS (PARTITION BY query_id, paper_id)),
guarded AS (SELECT query_id, paper_id, chunk_id, page, score, injected,
                   row_number() OVER (PARTITION BY query_id, paper_id ORDER BY rank) AS rank
            FROM (SELECT *, coalesce(present = 0 AND rank = best, false) AS injected FROM flag)
            WHERE injected OR rank <= CASE WHEN present = 0 AND best IS NOT NULL THEN {k - 1} ELSE {k} END)"""


def reranked_ctes() -> str:
    return guarded_ctes() + f""",
pair AS (SELECT g.*, c.text, list_distinct({tokens('a.question')}) AS asked, {tokens('c.text')} AS words
         FROM guarded g JOIN chunk c USING (paper_id, chunk_id) JOIN ask a USING (query_id, paper_id)),
odds AS (SELECT *, len(list_filter(asked, lambda x: list_contains(words, x))) AS hits FROM pair),
reranked AS (SELECT *, row_number() OVER (PARTITION BY query_id, paper_id
                       ORDER BY round(rerank_score, 9) DESC, chunk_id) AS new_rank
             FROM (SELECT *, ln((hits + 0.5) / (len(asked) - hits + 0.5)) AS rerank_score FROM odds))"""


_DOUBLED = "regexp_replace({t}, '([^\\pL\\pN_-])', '\\1\\1', 'g')"
_EDGE_L, _EDGE_R = "(?:^|[^\\pL\\pN_])", "(?:$|[^\\pL\\pN_])"


def facts(text: str) -> str:
    """Sorted distinct facts of a text; word borders are spelled out and separators doubled
    so that neighbours do not share one."""
    doubled = _DOUBLED.format(t=text)
    identifier = (
        "[A-Z]{2,}[A-Za-z0-9_-]*|[A-Za-z]+[-_]\\d+[A-Za-z0-9_-]*"
        "|[A-Z][A-Za-z0-9]*[-_][A-Z0-9][A-Za-z0-9_-]*|[A-Z][a-z]+(?:[A-Z][A-Za-z0-9]*)+"
    )
    qualifier = (
        "not|never|only|except|without|higher|lower|increase[\\pL\\pN_]*|decrease[\\pL\\pN_]*"
        "|improve[\\pL\\pN_]*|worse|more|less|up  to|at  least|at  most"
    )
    units = "ms|seconds?|secs?|minutes?|mins?|hours?|GB|MB|GiB|MiB|Hz|GHz|MHz|밀리초|초|분"
    return (
        "list_sort(list_distinct(list_concat("
        f"regexp_extract_all({text}, '[-+]?\\d+(?:[.,]\\d+)*(?:%|[x×])?'), "
        f"list_transform(regexp_extract_all({text}, '([-+]?\\d+(?:[.,]\\d+)*\\s*(?:{units}))(?:[^A-Za-z]|$)', 1), "
        "lambda v: lower(regexp_replace(v, '\\s+', '', 'g'))), "
        f"regexp_extract_all({doubled}, '{_EDGE_L}({identifier}){_EDGE_R}', 1), "
        f"list_transform(regexp_extract_all(lower({doubled}), '{_EDGE_L}({qualifier}){_EDGE_R}', 1), "
        "lambda v: replace(v, '  ', ' ')))))"
    )


def shingles(words: str) -> str:
    return (
        f"CASE WHEN len({words}) < 3 THEN list_distinct({words}) ELSE list_distinct(list_transform("
        f"range(1, len({words}) - 1), lambda i: array_to_string({words}[i:i+2], ' '))) END"
    )


def selection_ctes(page: str = "page", near: float = 0.85) -> str:
    """CTEs ending in ``chosen``: the greedy scan, one candidate per recursive step. Holds
    for questions without a recognised kind or aspect, which the driver's texts are."""
    return reranked_ctes() + f""",
item AS (SELECT query_id, paper_id, chunk_id, {page} AS page, new_rank AS r, plain, {facts('text')} AS facts,
                {shingles('plain')} AS sh
         FROM (SELECT *, {plain('text')} AS plain FROM reranked WHERE new_rank <= 20)),
near AS (SELECT b.query_id, b.paper_id, b.r,
           list(a.r) FILTER (WHERE a.facts = b.facts AND a.plain = b.plain) AS same_text,
           list(a.r) FILTER (WHERE a.facts = b.facts AND len(list_intersect(a.sh, b.sh))::DOUBLE /
             greatest(1, len(a.sh) + len(b.sh) - len(list_intersect(a.sh, b.sh))) >= {near}) AS near_text,
           list(a.r) FILTER (WHERE a.page = b.page) AS same_page
         FROM item b LEFT JOIN item a ON a.query_id = b.query_id AND a.paper_id = b.paper_id AND a.r < b.r
         GROUP BY ALL),
scan(query_id, paper_id, r, sel, dup_text, near_dup, capped) AS (
  SELECT query_id, paper_id, 0::BIGINT, []::BIGINT[], 0, 0, 0 FROM ask
  UNION ALL
  SELECT s.query_id, s.paper_id, n.r,
         CASE WHEN v = 'pick' THEN list_append(sel, n.r) ELSE sel END,
         dup_text + (v = 'text')::INT, near_dup + (v = 'near')::INT, capped + (v = 'page')::INT
  FROM (SELECT s.*, n.r AS nr, CASE
          WHEN list_has_any(sel, coalesce(same_text, [])) THEN 'text'
          WHEN list_has_any(sel, coalesce(near_text, [])) THEN 'near'
          WHEN len(list_intersect(sel, coalesce(same_page, []))) >= 2 THEN 'page' ELSE 'pick' END AS v
        FROM scan s JOIN near n ON n.query_id = s.query_id AND n.paper_id = s.paper_id AND n.r = s.r + 1
        WHERE len(sel) < 5) s
  JOIN near n ON n.query_id = s.query_id AND n.paper_id = s.paper_id AND n.r = s.nr
),
chosen AS (SELECT * FROM scan QUALIFY row_number() OVER (PARTITION BY query_id, paper_id ORDER BY r DESC) = 1)"""
