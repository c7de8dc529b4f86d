"""SQL that must give the rows of the operators' queries, where SQL can express them."""

LINES = r"""
WITH l AS (
  SELECT doc_id, unnest(range(0, len(ls))) AS line, unnest(ls) AS txt FROM (SELECT doc_id, string_split(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), chr(10)) AS ls FROM documents)
), s AS (
  SELECT doc_id, line, list_sort(list_distinct(list_filter(string_split_regex(txt, '[\x20\x09-\x0D]+'), lambda x: x <> ''))) AS ws FROM l
), f AS (SELECT * FROM s WHERE len(ws) > 0),
k AS (SELECT ws, min({'d': doc_id, 'l': line}) AS plc FROM f GROUP BY 1),
c AS (SELECT ws, plc, len(ws) AS n, row_number() OVER (ORDER BY plc) AS id FROM k),
t AS (SELECT id, n, unnest(ws) AS w FROM c),
freq AS (SELECT w, count(*) AS f FROM t GROUP BY 1),
p AS (SELECT id, n, t.w, row_number() OVER (PARTITION BY id ORDER BY f, t.w) AS pos FROM t JOIN freq USING (w)),
q AS (SELECT * FROM p WHERE pos <= n - ceil(0.8 * n - 1e-9) + 1),
cand AS (SELECT DISTINCT a.id AS a, b.id AS b FROM q a JOIN q b ON a.w = b.w AND a.id < b.id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)),
hit AS (SELECT DISTINCT b FROM cand JOIN c x ON x.id = a JOIN c y ON y.id = b WHERE 180 * len(list_intersect(x.ws, y.ws)) >= 80 * (x.n + y.n)),
j AS (SELECT f.doc_id, f.line, hit.b IS NOT NULL AS linked, hit.b IS NOT NULL OR {'d': f.doc_id, 'l': f.line} <> c.plc AS gone FROM f JOIN c ON c.ws = f.ws LEFT JOIN hit ON hit.b = c.id)
SELECT d.doc_id, count(j.line) AS n_lines, count(CASE WHEN linked THEN 1 END) AS n_links, count(CASE WHEN gone THEN 1 END) AS n_removed, coalesce(string_agg(CAST(j.line AS VARCHAR), ',' ORDER BY j.line) FILTER (WHERE gone), '') AS removed
FROM documents d LEFT JOIN j ON j.doc_id = d.doc_id GROUP BY 1
"""

MINHASH = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 4 THEN list_transform(range(1, len(ws) - 2), lambda i: ws[i:i + 3]) WHEN len(ws) > 0 THEN [ws] ELSE [] END) AS g FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)
), both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(a, b) AS (SELECT a, b FROM both_ways UNION SELECT reach.a, both_ways.b FROM reach JOIN both_ways ON both_ways.a = reach.b)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, least(w.doc_id, coalesce(r.b, w.doc_id)) AS component_id, w.doc_id = least(w.doc_id, coalesce(r.b, w.doc_id)) AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN (SELECT a, min(b) AS b FROM reach GROUP BY 1) r ON r.a = w.doc_id
"""

FILTERS = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY 1),
m AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    CASE WHEN len(ws) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 'B' ELSE '' END
    || CASE WHEN 100 * (length(t) - length(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))) > 3 * length(t) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN min(d.doc_id) OVER (PARTITION BY t) < d.doc_id THEN 'E' ELSE '' END AS fails
  FROM d LEFT JOIN l ON l.doc_id = d.doc_id
), g AS (SELECT part, good, toxic, fails, count(*) AS n FROM m GROUP BY ALL),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
o AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM f a, f b, f c, f d, f e
  WHERE a.f NOT IN (b.f, c.f, d.f, e.f) AND b.f NOT IN (c.f, d.f, e.f) AND c.f NOT IN (d.f, e.f) AND d.f <> e.f
), s AS (SELECT filter_order, step, substr(filter_order, step, 1) AS f, substr(filter_order, 1, step - 1) AS earlier FROM o, (SELECT unnest(range(1, 6)) AS step)),
x AS (SELECT g.*, s.*, contains(fails, f) AS bad, length(translate(fails, earlier, '')) < length(fails) AS gone FROM g, s),
r AS (
  SELECT part, filter_order, CAST(step AS INTEGER) AS step, any_value(f) AS f, CAST(sum(CASE WHEN NOT bad AND NOT gone THEN n ELSE 0 END) AS BIGINT) AS kept, CAST(sum(CASE WHEN bad AND NOT gone THEN n ELSE 0 END) AS BIGINT) AS removed,
    CAST(sum(CASE WHEN bad AND gone THEN n ELSE 0 END) AS BIGINT) AS redundant, CAST(sum(CASE WHEN fails = f THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
    CAST(sum(CASE WHEN bad AND NOT gone THEN n * good ELSE 0 END) AS BIGINT) AS good_lost, CAST(sum(CASE WHEN bad AND NOT gone THEN n * toxic ELSE 0 END) AS BIGINT) AS toxic_lost
  FROM x GROUP BY part, filter_order, step
)
SELECT * EXCLUDE (f), CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM r
"""


def centroids(k: int = 8, rounds: int = 10, dims: int = 64) -> str:
    """Each round as two tables: the nearest centroids, and the floors of the means."""
    nearest = "SELECT vec_id, v, c, d FROM (SELECT p.*, t.c, d.d, row_number() OVER (PARTITION BY p.row ORDER BY d.d, t.c) AS place FROM p, c{r} t, LATERAL (SELECT CAST(list_sum(list_transform(range(1, %d), lambda i: (p.v[i] - t.w[i]) * (p.v[i] - t.w[i]))) AS BIGINT) AS d) d) WHERE place = 1" % (dims + 1)
    mean = (
        "SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS w FROM (SELECT c, i, CAST(sum(v[i]) AS BIGINT) AS s, count(*) AS n FROM a{r}, (SELECT unnest(range(1, {last})) AS i) GROUP BY 1, 2) GROUP BY 1 "
        "UNION ALL SELECT c, w FROM c{r} WHERE c NOT IN (SELECT c FROM a{r})"
    ).replace("{last}", str(dims + 1))
    parts = [
        f"p AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: isfinite(CAST(x AS DOUBLE)))) = {dims})",
        f"c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY h, v) - 1 AS INTEGER) AS c, v AS w FROM (SELECT sha256('3:' || CAST(vec_id AS VARCHAR)) AS h, v FROM p ORDER BY h, v LIMIT {k}))",
    ]
    for r in range(rounds):
        parts += [f"a{r} AS MATERIALIZED ({nearest.format(r=r)})", f"c{r + 1} AS MATERIALIZED ({mean.format(r=r)})"]
    parts.append(f"a{rounds} AS MATERIALIZED ({nearest.format(r=rounds)})")
    return (
        f"WITH {', '.join(parts)} SELECT vec_id, a.c AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, "
        f"sha256(array_to_string(w, ',')) AS centroid_sha256 FROM a{rounds} a JOIN c{rounds} t ON t.c = a.c"
    )


ORACLES = {"op3_lines": LINES, "op9_minhash": MINHASH, "op12_filters": FILTERS, "op13_centroids": centroids()}
