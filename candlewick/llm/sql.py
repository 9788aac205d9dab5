"""DuckDB SQL of the operators that SQL can express, over whole tables.

Runs of words or bytes are built by doubling: a row's run of 2n joins its run of n with that of the row n further on.
A row is covered if the last start of a repeated run is close enough before it.
"""

WORD = r"[^\x20\x09-\x0D]+"


def _runs(length: int, unit: str, gap: str) -> tuple[str, str]:
    """CTEs over ``unit`` (doc_id, p, x) that end in runs of ``length`` units; the run is null where the document ends before."""
    ctes, have, last = [], {1: "x"}, unit
    n = 1
    while 2 * n <= length:
        column = f"x{2 * n}"
        ctes.append(f"{unit}{2 * n} AS (SELECT *, {have[n]} || {gap} || lead({have[n]}, {n}) OVER (PARTITION BY doc_id ORDER BY p) AS {column} FROM {last})")
        n, last = 2 * n, f"{unit}{2 * n}"
        have[n] = column
    pieces, done = [], 0
    for size in sorted(have, reverse=True):
        if done + size <= length:
            pieces.append(f"lead({have[size]}, {done}) OVER (PARTITION BY doc_id ORDER BY p)" if done else have[size])
            done += size
    ctes.append(f"runs AS (SELECT doc_id, p, x, {f' || {gap} || '.join(pieces)} AS run FROM {last})")
    return ", ".join(ctes), "runs"


def _components(nodes: str, links: str, key: str) -> str:
    """CTEs ``reach`` and ``component`` (key, c): the smallest key that is reachable by ``links`` (a, b), both ways, or the key itself."""
    return f"""reach AS (SELECT {key} AS node, {key} AS c FROM {nodes} WHERE {key} IN (SELECT a FROM {links}) UNION SELECT l.b, r.c FROM reach r JOIN {links} l ON l.a = r.node WHERE r.c < l.b),
component AS (SELECT node, min(c) AS c FROM reach GROUP BY 1)"""


OP1 = f"""WITH bytes AS (SELECT doc_id, unnest(regexp_extract_all(hex(coalesce(text, '')), '..')) AS x, generate_subscripts(regexp_extract_all(hex(coalesce(text, '')), '..'), 1) AS p FROM documents),
{_runs(50, 'bytes', "''")[0]},
first AS (SELECT run, min(doc_id) AS d FROM runs WHERE run IS NOT NULL GROUP BY 1),
marked AS (SELECT r.doc_id, r.p, r.x, CASE WHEN f.d < r.doc_id THEN r.p END AS s FROM runs r LEFT JOIN first f ON f.run = r.run),
covered AS (SELECT doc_id, p, x, coalesce(max(s) OVER (PARTITION BY doc_id ORDER BY p ROWS UNBOUNDED PRECEDING) > p - 50, false) AS gone FROM marked),
edges AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY p), false) AS opens FROM covered),
out AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, count(*) FILTER (opens) AS n_spans, string_agg(x, '' ORDER BY p) FILTER (NOT gone) AS kept FROM edges GROUP BY 1)
SELECT d.doc_id, strlen(coalesce(d.text, '')) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM documents d LEFT JOIN out USING (doc_id)"""

OP5 = f"""WITH RECURSIVE vectors AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
valid AS (SELECT * FROM vectors WHERE len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM valid a JOIN valid b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= 0.9),
{_components('vectors', 'links', 'vec_id')},
counts AS (SELECT a, count(*) AS n FROM links GROUP BY 1)
SELECT e.vec_id, coalesce(n, 0) AS n_links, coalesce(c, e.vec_id) AS component_id, coalesce(c, e.vec_id) = e.vec_id AS kept
FROM vectors e LEFT JOIN component ON node = e.vec_id LEFT JOIN counts ON a = e.vec_id"""

OP8 = f"""WITH RECURSIVE texts AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w FROM documents),
words AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM texts),
{_runs(5, 'words', "' '")[0]},
shingles AS (SELECT DISTINCT doc_id, run AS s FROM runs WHERE run IS NOT NULL UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM texts WHERE len(w) BETWEEN 1 AND 4),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common c JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c.n >= 85 * (x.n + y.n - c.n)),
{_components('texts', 'links', 'doc_id')}
SELECT t.doc_id, coalesce(n, 0) AS n_shingles, coalesce(c, t.doc_id) AS component_id, coalesce(c, t.doc_id) = t.doc_id AS kept
FROM texts t LEFT JOIN sizes USING (doc_id) LEFT JOIN component ON node = t.doc_id"""

OP10 = f"""WITH texts AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
words AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM texts),
{_runs(20, 'words', "' '")[0]},
starts AS (SELECT doc_id, p, row_number() OVER (PARTITION BY run ORDER BY doc_id, p) AS k FROM runs WHERE run IS NOT NULL),
marked AS (SELECT r.doc_id, r.p, r.x, CASE WHEN k > 1 THEN r.p END AS s FROM runs r LEFT JOIN starts USING (doc_id, p)),
covered AS (SELECT doc_id, p, x, coalesce(max(s) OVER (PARTITION BY doc_id ORDER BY p ROWS UNBOUNDED PRECEDING) > p - 20, false) AS gone FROM marked),
out AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(x, ' ' ORDER BY p) FILTER (NOT gone) AS kept FROM covered GROUP BY 1)
SELECT t.doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM texts t LEFT JOIN out USING (doc_id)"""

OP12 = f"""WITH RECURSIVE orders AS (SELECT '' AS filter_order, 0 AS step UNION ALL SELECT filter_order || f, step + 1 FROM orders, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f) WHERE step < 5 AND NOT contains(filter_order, f)),
steps AS (SELECT filter_order, s::INTEGER AS step, substr(filter_order, s, 1) AS f, substr(filter_order, 1, s - 1) AS before FROM (SELECT filter_order, unnest(range(1, 6)) AS s FROM orders WHERE step = 5)),
texts AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
marks AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY 1),
tests AS (SELECT part, doc_id, (CASE WHEN len(w) < 100 THEN 'A' ELSE '' END) || (CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 'B' ELSE '' END)
  || (CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) THEN 'C' ELSE '' END) || (CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END)
  || (CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 'E' ELSE '' END) AS fails FROM texts),
counted AS (SELECT part, fails, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM tests LEFT JOIN marks USING (doc_id) GROUP BY 1, 2),
out AS (SELECT part, filter_order, step, f, sum(n) FILTER (fails = '' OR translate(fails, before || f, '') = fails) AS kept, sum(n) FILTER (contains(fails, f) AND translate(fails, before, '') = fails) AS removed,
  sum(n) FILTER (contains(fails, f) AND translate(fails, before, '') <> fails) AS redundant, sum(n) FILTER (fails = f) AS unique_fails,
  sum(good) FILTER (contains(fails, f) AND translate(fails, before, '') = fails) AS good_lost, sum(toxic) FILTER (contains(fails, f) AND translate(fails, before, '') = fails) AS toxic_lost
  FROM counted, steps GROUP BY 1, 2, 3, 4)
SELECT part, filter_order, step, {', '.join(f'coalesce({c}, 0)::BIGINT AS {c}' for c in ('kept', 'removed', 'redundant', 'unique_fails', 'good_lost', 'toxic_lost'))},
  coalesce(sum(removed) OVER (PARTITION BY part, f), 0)::BIGINT AS shapley FROM out"""

OP11 = r"""WITH RECURSIVE crc AS (SELECT i AS x, i, 0 AS k FROM (SELECT unnest(range(0, 256)) AS i) UNION ALL SELECT CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, i, k + 1 FROM crc WHERE k < 8),
table_ AS (SELECT list(x ORDER BY i) AS t FROM crc WHERE k = 8),
found AS (SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{C0}-\x{FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
runs AS (SELECT doc_id, run, count(*) AS n FROM found WHERE length(run) >= 6 GROUP BY 1, 2),
coded AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(doc_id || ':' || run), '..'), lambda b: (16 * (instr('0123456789ABCDEF', b[1]) - 1) + instr('0123456789ABCDEF', b[2]) - 1)::BIGINT)),
  lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM runs, table_),
words AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, sum(n)::BIGINT AS n FROM coded GROUP BY 1 HAVING length(word) >= 6 AND sum(n) >= 5),
places AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS p FROM words),
cuts AS (SELECT word, n, p, substr(word, 1, p - 1) AS a, substr(word, p + 1) AS b FROM places),
replaced AS (SELECT x.word AS word, y.word AS near, y.n AS near_n FROM cuts x JOIN cuts y ON x.a = y.a AND x.b = y.b WHERE x.word <> y.word),
deleted AS (SELECT DISTINCT c.word AS long, c.n AS long_n, w.word AS short, w.n AS short_n FROM cuts c JOIN words w ON w.word = c.a || c.b),
near AS (SELECT * FROM replaced UNION ALL SELECT long, short, short_n FROM deleted UNION ALL SELECT short, long, long_n FROM deleted),
best AS (SELECT word, count(*) AS n_near, min({'n': -near_n, 'w': near}) AS b FROM near GROUP BY 1),
forms AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -b.n >= 5 * w.n THEN b.w END AS form, CASE WHEN -b.n >= 5 * w.n THEN -b.n END AS form_n FROM words w LEFT JOIN best USING (word)),
path AS (SELECT word, word AS last FROM forms UNION ALL SELECT path.word, form FROM path JOIN forms ON forms.word = path.last WHERE form IS NOT NULL),
roots AS (SELECT path.word, path.last AS root FROM path JOIN forms ON forms.word = path.last WHERE form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN roots USING (word)"""

ORACLE = {"op1_suffix_array_dedup": OP1, "op5_embedding_near_dedup": OP5, "op8_minhash_near_dedup": OP8, "op10_recompression_dedup": OP10, "op11_spelling_variants": OP11, "op12_filter_audit": OP12}
