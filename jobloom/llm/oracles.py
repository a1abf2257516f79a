"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from jobloom.llm import url_filter as uf

_ABC = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_FOLD = f"translate({{}}, '{_ABC}', '{_ABC.lower()}')"

OP1 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""

OP3 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
h AS (SELECT page_id, strlen(payload) AS payload_bytes, sha1(payload) AS h, min(page_id) OVER (PARTITION BY payload) AS first_id FROM p)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    ((('0x' || substr(h, (k // 8)::INTEGER * 10 + 1, 10))::BIGINT >> (35 - 5 * (k % 8))::INTEGER) & 31)::INTEGER + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM h
"""

_WORDS = r"regexp_extract_all(" + _FOLD.format("coalesce(text, '')") + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP5 = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item, {_WORDS} AS w, least(10, len({_WORDS})) AS k FROM benchmark),
iw AS (SELECT DISTINCT item, k, array_to_string(w[i:i + k - 1], ' ') AS t FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM b WHERE k > 0)),
ks AS (SELECT DISTINCT k FROM iw),
dw AS (SELECT rid, k, i, array_to_string(w[i:i + k - 1], ' ') AS t FROM (SELECT rid, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k)),
hit AS (SELECT DISTINCT dw.rid, dw.i, dw.k, iw.item FROM dw JOIN iw ON dw.k = iw.k AND dw.t = iw.t),
pos AS (SELECT rid, count(*) AS n_hit FROM (SELECT DISTINCT rid, unnest(range(i, i + k)) AS p FROM hit) GROUP BY rid),
its AS (SELECT rid, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hit GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (rid) LEFT JOIN its USING (rid)
"""

OP9 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_FOLD.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS t FROM (SELECT *, unnest(range(1, greatest(1, len(w) - 2) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT t FROM s GROUP BY t HAVING count(*) > 1),
pair AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM (SELECT * FROM s SEMI JOIN common USING (t)) a JOIN s b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM pair JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 90 * (x.n + y.n - i)),
both_ways AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT DISTINCT a AS doc_id, a AS r FROM both_ways UNION SELECT reach.doc_id, both_ways.b FROM reach JOIN both_ways ON reach.r = both_ways.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(m.r, d.doc_id)) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT doc_id, min(r) AS r FROM reach GROUP BY doc_id) m USING (doc_id)
"""


def op2(rules: list[tuple[str, str, str]], levels: int = 6) -> str:
    """The template trees of paths of up to ``levels`` segments, level by level."""
    ordered = sorted(rules, key=lambda r: (-len(r[0]) - len(r[1]), r))
    fits = lambda h, p: f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
    case = lambda f: "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{f(h, p, v)}'" for h, p, v in ordered) + " END"

    def chi(size: str, *kinds: str) -> str:
        c, p = f"c{size}::DOUBLE", f"p{size}::DOUBLE"
        term = lambda k: (f"(({k.replace('#', 'c')}) * {p} - ({k.replace('#', 'p')}) * {c})", f"({c} * ({p} - {c}) * ({k.replace('#', 'p')}))")
        return " + ".join(f"CASE WHEN {s} <> 0 THEN {x} * {x} / {s} ELSE 0 END" for x, s in map(term, kinds))

    sql = f"""
WITH u AS (SELECT page_id, coalesce(CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END, '') AS rest FROM pages),
h AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM u),
p AS (SELECT page_id, {_FOLD.format("raw")} AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
g AS (SELECT *, {case(lambda h, p, v: h + p)} AS rule, {case(lambda h, p, v: v)} AS verdict,
  array_to_string(list_transform(list_filter(string_split(path, '/'), lambda x: x <> ''),
    lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '*' WHEN x = '*' THEN '%2A' ELSE x END), '/') AS shape FROM p),
x0 AS (SELECT host, shape, count(*) AS n, count(verdict) AS l, count(*) FILTER (verdict = 'block') AS b, '' AS pre,
  CASE WHEN shape = '' THEN [] ELSE string_split(shape, '/') END AS below FROM g GROUP BY ALL)"""
    for i in range(1, levels + 1):
        sums = lambda to, of="": ", ".join(f"sum({of}{c})::BIGINT AS {to}{c}" for c in uf._SUMS)
        sql += f""",
r{i} AS (SELECT *, below[1] AS seg, CASE WHEN len(below) = 1 THEN n ELSE 0 END AS e, CASE WHEN below[2] = '*' THEN n ELSE 0 END AS v FROM x{i - 1} WHERE len(below) > 0),
c{i} AS (SELECT host, pre, seg, {sums("c")}, count(*) AS shapes FROM r{i} GROUP BY ALL),
q{i} AS (SELECT host, pre, {sums("p", "c")}, count(*) AS branches FROM c{i} GROUP BY ALL),
k{i} AS (SELECT host, pre, seg, shapes, CASE WHEN seg = '*' OR (branches > {uf.MANY} AND cn < {uf.FEW}) OR (branches > 1 AND
    CASE WHEN cl >= {uf.LEAST} AND pl - cl >= {uf.LEAST} THEN {chi("l", "#b", "#l - #b")} <= {uf.SIMILAR} ELSE {chi("n", "#e", "#v", "#n - #e - #v")} <= {uf.ALIKE} END)
  THEN '*' ELSE seg END AS step FROM c{i} JOIN q{i} USING (host, pre)),
o{i} AS (SELECT *, shapes = 1 AND step <> '*' AND len(below) > 1 AS own FROM r{i} JOIN k{i} USING (host, pre, seg)),
x{i} AS (SELECT host, shape, n, l, b, concat_ws('/', pre, step, CASE WHEN own THEN array_to_string(below[2:], '/') END) AS pre, CASE WHEN own THEN [] ELSE below[2:] END AS below FROM o{i}
  UNION ALL SELECT host, shape, n, l, b, pre, below FROM x{i - 1} WHERE len(below) = 0)"""
    return sql + f""",
z AS (SELECT host, shape, l, b, CASE WHEN pre = '' THEN '/' ELSE pre END AS template FROM x{levels}),
share AS (SELECT coalesce(sum(b) / nullif(sum(l), 0), 0) AS share FROM z),
tot AS (SELECT host, template, sum(l) AS tl, sum(b) AS tb FROM z GROUP BY ALL),
hosts AS (SELECT host, sum(tl) AS hl, sum(tb) AS hb FROM tot GROUP BY ALL),
y AS (SELECT host, template, CASE WHEN tl >= {uf.LEAST} AND (tb + {uf.PRIOR}::DOUBLE * ((hb + {uf.PRIOR}::DOUBLE * share) / (hl + {uf.PRIOR}::DOUBLE))) / (tl + {uf.PRIOR}::DOUBLE) >= {uf.PURITY}
  THEN 'block' ELSE 'allow' END AS learned FROM tot JOIN hosts USING (host), share)
SELECT page_id, g.host, path, rule, coalesce(verdict, learned) AS verdict, template, learned
FROM g JOIN z USING (host, shape) JOIN y USING (host, template)
"""
