"""DuckDB SQL of the queries that SQL can express over whole tables."""

from __future__ import annotations

from .licenses import BASE_PHRASES, TEMPLATES, parse

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


def _pattern(nodes: list[tuple]) -> str:
    """A template as a regular expression over words that each end with a blank."""
    out = ""
    for kind, what in nodes:
        if kind == "optional":
            out += f"(?:{_pattern(what)})?"
        elif kind == "any":
            out += f"(?:[^ ]+ ){{0,{what}}}"
        else:
            words = "|".join(sorted(w.decode() for w in what))
            out += f"(?:{words}) " if len(what) > 1 else f"{words} "
    return out


def license_sql() -> str:
    base, places = [], []
    for phrase, label in BASE_PHRASES.items():
        want = phrase.split()
        places.append(f"list_filter(range(0, len(w)), lambda i: w[i+1:i+{len(want)}] = [{', '.join(repr(x) for x in want)}])")
        base.append(f"CASE WHEN len({places[-1]}) > 0 THEN '{label}' END")
    hit = {}
    for label, markup in TEMPLATES:
        hit.setdefault(label, []).append(f"regexp_matches(t, ' {_pattern(parse(markup))}')")
    own = [f"CASE WHEN {' OR '.join(tests)} THEN '{label}' END" for label, tests in hit.items()]
    text = lambda items: f"array_to_string(list_sort(list_distinct(list_filter([{', '.join(items)}], lambda x: x IS NOT NULL))), ',')"
    return f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), t AS (SELECT *, ' ' || array_to_string(w, ' ') || ' ' AS t FROM d),
 p AS (SELECT *, flatten([{', '.join(places)}]) AS pl FROM t)
SELECT doc_id, len(w) AS n_words, len(pl) AS n_base, list_min(pl) AS first_word, list_max(pl) AS last_word, {text(base)} AS base_labels, {text(base + own)} AS labels,
 CAST(CASE WHEN {' OR '.join(x for tests in hit.values() for x in tests)} THEN 1 WHEN len(pl) > 0 THEN 0.5 ELSE 0 END AS DOUBLE) AS score FROM p"""


LINE_DEDUP = f"""
WITH l AS (SELECT doc_id, generate_subscripts(ls, 1) AS i, unnest(ls) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)),
 u AS (SELECT *, row_number() OVER o AS p, sum(n) OVER o AS c FROM (
   SELECT doc_id, i, array_to_string(ws, ' ') AS k, len(ws) AS n FROM (
     SELECT doc_id, i, list_filter(regexp_split_to_array(translate(line, '{_UP}', '{_LOW}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM l)
   WHERE len(ws) > 0) WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
 d AS (SELECT doc_id, list(k ORDER BY p) AS ks FROM u GROUP BY doc_id),
 w AS (SELECT a.doc_id, a.p AS s, b.p AS e FROM u a JOIN u b ON a.doc_id = b.doc_id AND b.p >= a.p AND b.c - a.c + a.n >= 50 AND (b.c - a.c + a.n - b.n < 50 OR b.c - a.c < 50)),
 x AS (SELECT doc_id, s, e, array_to_string(ks[s:e], chr(10)) AS k FROM w JOIN d USING (doc_id)),
 f AS (SELECT k, arg_min(doc_id, {{'d': doc_id, 's': s}}) AS fd, arg_min(s, {{'d': doc_id, 's': s}}) AS fs FROM x GROUP BY k),
 g AS (SELECT DISTINCT doc_id, unnest(range(s, e + 1)) AS p FROM x JOIN f USING (k) WHERE doc_id > fd OR (doc_id = fd AND s > fs)),
 gone AS (SELECT u.doc_id, u.i FROM u JOIN g ON u.doc_id = g.doc_id AND u.p = g.p),
 kept AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS t FROM l ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id),
 n AS (SELECT doc_id, count(*) AS n FROM u GROUP BY doc_id), nd AS (SELECT doc_id, count(*) AS nd FROM gone GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_lines, coalesce(nd, 0) AS n_deleted, sha256(coalesce(t, '')) AS kept_sha256, coalesce(nd, 0) > 0 AS changed
FROM (SELECT doc_id FROM documents) LEFT JOIN n USING (doc_id) LEFT JOIN nd USING (doc_id) LEFT JOIN kept USING (doc_id)"""


DECONTAMINATION = f"""
WITH b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
 win AS (SELECT DISTINCT item_id, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS k, least(10, len(w)) AS size
         FROM (SELECT *, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
 d AS (SELECT doc_id, {_WORDS} AS w FROM documents), sizes AS (SELECT DISTINCT size FROM win),
 dw AS (SELECT doc_id, i, size, array_to_string(w[i:i + size - 1], ' ') AS k FROM (SELECT *, unnest(range(1, len(w) - size + 2)) AS i FROM d, sizes WHERE len(w) >= size)),
 hit AS (SELECT doc_id, i, dw.size, item_id FROM dw JOIN win ON dw.k = win.k AND dw.size = win.size),
 places AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM hit) GROUP BY doc_id),
 items AS (SELECT doc_id, count(DISTINCT item_id) AS n, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids FROM hit GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(p.n, 0) AS n_hit, coalesce(t.n, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(p.n, 0) > 0 AS contaminated
FROM d LEFT JOIN places p USING (doc_id) LEFT JOIN items t USING (doc_id)"""


def url_filter_sql(epoch: str, events: list[tuple[str, str, int]]) -> str:
    rows = ", ".join(f"('{e.partition('/')[0]}', '{e.partition('/')[2]}', '{a}', {n})" for e, a, n in events)
    return f"""
WITH ev(host, path, action, day) AS (VALUES {rows}),
 span AS (SELECT * FROM (SELECT *, lead(day) OVER (PARTITION BY host, path ORDER BY day) AS until FROM ev) WHERE action = 'add'),
 c AS (SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)) AS host, regexp_extract(url, '^[a-z]+://[^/?#]*/([^?#]*)', 1) AS path, page_id % 366 AS day FROM pages),
 m AS (SELECT page_id, s.host AS eh, s.path AS ep, s.day AS since FROM c JOIN span s ON (c.host = s.host OR ends_with(c.host, '.' || s.host))
       AND (s.path = '' OR c.path = s.path OR starts_with(c.path, s.path || '/')) AND s.day <= c.day AND (s.until IS NULL OR c.day < s.until)),
 best AS (SELECT page_id, count(*) AS n, arg_max(eh || CASE WHEN ep = '' THEN '' ELSE '/' || ep END, {{'a': len(string_split(eh, '.')), 'b': CASE WHEN ep = '' THEN 0 ELSE len(string_split(ep, '/')) END, 'e': eh || '/' || ep}}) AS entry,
          arg_max(since, {{'a': len(string_split(eh, '.')), 'b': CASE WHEN ep = '' THEN 0 ELSE len(string_split(ep, '/')) END, 'e': eh || '/' || ep}}) AS since FROM m GROUP BY page_id)
SELECT c.page_id, host, strftime(DATE '{epoch}' + CAST(day AS INTEGER), '%Y-%m-%d') AS fetched, coalesce(n, 0) AS n_active, entry,
 strftime(DATE '{epoch}' + CAST(since AS INTEGER), '%Y-%m-%d') AS since, n IS NOT NULL AS blocked FROM c LEFT JOIN best USING (page_id)"""


_FINITE = "len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"

HARD_NEGATIVES = f"""
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS p
           FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND {_FINITE}),
 s AS (SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id AS id,
       CAST(list_sum(list_transform(list_zip(a.p, b.p), lambda z: z[1] * z[2])) AS BIGINT) AS score
       FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
 pos AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
         QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, id AS negative_id, positive_score, score AS negative_score
FROM pos JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) QUALIFY row_number() OVER w <= 3"""


def zone_clusters_sql(k: int = 8, rounds: int = 10) -> str:
    """One pair of tables a round: v's nearest centroids, and the centroids' new components."""
    far = "list_sum(list_transform(list_zip(p, cp), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    parts = [f"""v AS MATERIALIZED (SELECT row_number() OVER () AS i, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS p
 FROM embeddings WHERE len(embedding) = 64 AND {_FINITE})""",
             f"""c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS c, p AS cp FROM v WHERE vec_id IS NOT NULL
 QUALIFY row_number() OVER (ORDER BY sha256('3:' || vec_id)) <= {k})"""]  # fmt: skip
    for r in range(rounds + 1):
        parts.append(f"""a{r} AS MATERIALIZED (SELECT i, arg_min(c, {{'d': d, 'c': c}}) AS c, min(d) AS d FROM (SELECT i, c, CAST({far} AS BIGINT) AS d FROM v, c{r}) GROUP BY i)""")
        if r < rounds:
            parts.append(f"""c{r + 1} AS MATERIALIZED (SELECT o.c, coalesce(n.cp, o.cp) AS cp FROM c{r} o LEFT JOIN (
 SELECT c, list(m ORDER BY j) AS cp FROM (SELECT c, j, CAST(floor(sum(x) / count(*)) AS BIGINT) - CASE WHEN floor(sum(x) / count(*)) * count(*) > sum(x) THEN 1 ELSE 0 END AS m
  FROM (SELECT c, unnest(p) AS x, generate_subscripts(p, 1) AS j FROM v JOIN a{r} USING (i)) GROUP BY c, j) GROUP BY c) n ON n.c = o.c)""")
    return f"""WITH {', '.join(parts)}, t AS (SELECT c, sum(d) AS s FROM a{rounds} GROUP BY c)
SELECT vec_id, CAST(c AS INTEGER) AS cluster, d AS distance, CAST(s AS BIGINT) AS cluster_inertia, CAST((SELECT sum(s) FROM t) AS BIGINT) AS inertia,
 sha256(array_to_string(cp, ',')) AS centroid_sha256 FROM v JOIN a{rounds} USING (i) JOIN t USING (c) JOIN c{rounds} USING (c)"""
