"""DuckDB SQL for the numbered queries that SQL can express on whole tables."""

_COMPONENTS = """
reach(node, c) AS (SELECT id, id FROM node UNION SELECT l.b, r.c FROM reach r JOIN link l ON l.a = r.node),
low AS (SELECT node, min(c) AS c FROM reach GROUP BY 1)
"""

NEAR_VECTORS = f"""
WITH RECURSIVE v AS (SELECT vec_id AS id, cast(embedding AS double[]) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
u AS (SELECT id, e, sqrt(list_dot_product(e, e)) AS norm FROM v),
node AS (SELECT vec_id AS id FROM embeddings),
link AS (SELECT a.id AS a, b.id AS b FROM u a JOIN u b ON a.id <> b.id AND len(a.e) = len(b.e) AND list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.95e0),
{_COMPONENTS}
SELECT id AS vec_id, (SELECT count(*) FROM link WHERE a = id) AS n_links, c AS component_id, id = c AS kept FROM node JOIN low ON low.node = id
"""

WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, html, strlen(html) AS n, cast(cast(unhex(sha1(html)) AS bit) AS varchar) AS bits FROM p),
best AS (SELECT html, max(page_id) AS response FROM p GROUP BY 1)
SELECT page_id, n AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', cast(1 + 16 * cast(substr(bits, 5 * i + 1, 1) AS int) + 8 * cast(substr(bits, 5 * i + 2, 1) AS int)
    + 4 * cast(substr(bits, 5 * i + 3, 1) AS int) + 2 * cast(substr(bits, 5 * i + 4, 1) AS int) + cast(substr(bits, 5 * i + 5, 1) AS int) AS int), 1)), '') AS payload_digest,
  CASE WHEN response = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN response <> page_id THEN response END AS refers_to
FROM d JOIN best USING (html)
"""

MINHASH = f"""
WITH RECURSIVE w AS (SELECT doc_id AS id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(len(w) - 2), lambda i: w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3]) WHEN len(w) > 0 THEN [array_to_string(w, ' ') || ' #'] ELSE [] END) AS g FROM w),
n AS (SELECT id, count(*) AS n FROM s GROUP BY 1),
both_ AS (SELECT a.id AS a, b.id AS b, count(*) AS m FROM s a JOIN s b ON a.g = b.g AND a.id <> b.id GROUP BY 1, 2),
link AS (SELECT a, b FROM both_ JOIN n x ON x.id = a JOIN n y ON y.id = b WHERE 100 * m >= 85 * (x.n + y.n - m)),
node AS (SELECT id FROM w),
{_COMPONENTS}
SELECT node.id AS doc_id, coalesce(n.n, 0) AS n_shingles, c AS component_id, node.id = c AS kept FROM node JOIN low ON low.node = node.id LEFT JOIN n ON n.id = node.id
"""

CHAT = """
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
x AS (SELECT *, role || text AS both_ FROM t),
f AS (SELECT *, length(both_) + length(both_) - length(replace(both_, '\\', '')) + 2 * (len(regexp_extract_all(both_, '<(\\||/?s>|<SYS>>|</SYS>>|bos>|eos>|start_of_turn>|end_of_turn>)'))
  + len(regexp_extract_all(both_, '\\|>')) + len(regexp_extract_all(both_, '\\[/?INST\\]'))) + 13 AS size FROM x)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  cast(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS bigint) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256, cast(sum(size) AS bigint) AS formatted_chars
FROM f GROUP BY conv_id
"""


def _lloyd(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """The rounds written out: each assigns all parts and replaces the entries that have some."""
    out = f"""WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: cast(floor(4096 * cast(x AS double)) AS bigint)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT vec_id, u.part, e[u.part * (len(e) // {parts}) + 1 : (u.part + 1) * (len(e) // {parts})] AS e FROM v, (SELECT unnest(range({parts})) AS part) u),
c0 AS (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, e FROM p WHERE vec_id IN (SELECT vec_id FROM v ORDER BY vec_id LIMIT {entries})),
"""
    far = "list_sum(list_transform(list_zip(p.e, c.e), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    for r in range(rounds + 1):
        out += f"""a{r} AS MATERIALIZED (SELECT vec_id, part, min({{'d': d, 'entry': entry}}) AS best FROM (SELECT p.vec_id, p.part, c.entry, {far} AS d FROM p JOIN c{r} c ON c.part = p.part) GROUP BY 1, 2),
"""
        if r < rounds:
            out += f"""m{r} AS (SELECT part, entry, list(cast(floor(s / n) AS bigint) ORDER BY i) AS e FROM (
  SELECT a.part, a.best.entry AS entry, i, cast(sum(p.e[i]) AS double) AS s, count(*) AS n FROM a{r} a JOIN p ON p.vec_id = a.vec_id AND p.part = a.part, unnest(range(1, len(p.e) + 1)) t(i) GROUP BY 1, 2, 3) GROUP BY 1, 2),
c{r + 1} AS MATERIALIZED (SELECT c.part, c.entry, coalesce(m.e, c.e) AS e FROM c{r} c LEFT JOIN m{r} m ON m.part = c.part AND m.entry = c.entry),
"""
    return out + f"""coded AS (SELECT vec_id, string_agg(printf('%02x', best.entry), '' ORDER BY part) AS code, cast(sum(best.d) AS bigint) AS error FROM a{rounds} GROUP BY 1),
books AS (SELECT sha256(string_agg(array_to_string(e, ','), ',' ORDER BY part, entry)) AS h FROM c{rounds}),
by_label AS (SELECT label, cast(sum(error) AS bigint) AS label_error FROM coded JOIN v USING (vec_id) GROUP BY 1)
SELECT vec_id, code, error, label_error, h AS codebooks_sha256 FROM coded JOIN v USING (vec_id) JOIN by_label b ON b.label IS NOT DISTINCT FROM v.label, books
"""


LLOYD = _lloyd()

LINES = """
WITH l AS (SELECT doc_id, i, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
 FROM (SELECT doc_id, unnest(parts) AS line, unnest(range(len(parts))) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents))),
r AS (SELECT key, max(doc_id) AS keeper FROM l WHERE length(key) >= 20 GROUP BY 1 HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT l.doc_id, l.i, l.line, coalesce(l.doc_id < r.keeper, false) AS gone FROM l LEFT JOIN r ON r.key = l.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256 FROM m GROUP BY 1
"""


def _merkle(fanout: int = 3, levels: int = 12) -> str:
    """Both trees level by level: ``levels`` of each are enough for fanout ** levels nodes; a level above a tree's root repeats it."""
    field = lambda c: f"coalesce(strlen(cast({c} AS varchar)) || ':' || cast({c} AS varchar), '-')"
    leaf = lambda text: "sha256(" + " || ".join(field(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    crc = """WITH RECURSIVE bits AS (SELECT b, 0 AS i, b AS c FROM range(256) t(b) UNION ALL SELECT b, i + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE i < 8),
crc_of AS (SELECT list(c ORDER BY b) AS t FROM bits WHERE i = 8),
d AS (SELECT *, xor(list_reduce(list_prepend(cast(4294967295 AS bigint), list_transform(range(1, length(cast(doc_id AS varchar)) + 1), lambda k: cast(ascii(substr(cast(doc_id AS varchar), k, 1)) AS bigint))),
  lambda h, x: xor(h >> 8, t[cast(xor(h, x) & 255 AS int) + 1])), 4294967295) % 2 = 0 AS tampered FROM documents, crc_of),
"""
    out = crc + f"""leaf AS MATERIALIZED (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i, {leaf("text")} AS leaf, CASE WHEN tampered THEN {leaf("replace(text, chr(10), '')")} ELSE {leaf("text")} END AS now FROM d),
s0 AS (SELECT source, i, leaf AS h FROM leaf),
"""
    up = lambda a, b: f"{b} AS MATERIALIZED (SELECT source, i // {fanout} AS i, CASE WHEN any_value(n) = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h FROM (SELECT *, count(*) OVER (PARTITION BY source) AS n FROM {a}) GROUP BY source, i // {fanout}),\n"
    for k in range(levels):
        out += up(f"s{k}", f"s{k + 1}")
    out += f"t0 AS MATERIALIZED (SELECT source AS of_, NULL AS source, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i, h FROM s{levels}),\n"
    for k in range(levels):
        out += up(f"t{k}", f"t{k + 1}")
    out += "f0 AS (SELECT l.doc_id, l.source, l.i, t.i AS j, l.leaf, l.now AS h, '' AS proof FROM leaf l JOIN t0 t ON t.of_ IS NOT DISTINCT FROM l.source),\n"
    step = 0
    for tree, own, keep in (("s", "i", "j"), ("t", "j", "i")):
        for k in range(levels):
            match = "n.source IS NOT DISTINCT FROM f.source" if tree == "s" else "true"
            out += (
                f"f{step + 1} AS MATERIALIZED (SELECT f.doc_id, f.source, f.{own} // {fanout} AS {own}, f.{keep}, f.leaf, "
                f"CASE WHEN any_value(n.n) = 1 THEN any_value(f.h) ELSE sha256(string_agg(CASE WHEN n.i = f.{own} THEN f.h ELSE n.h END, '' ORDER BY n.i)) END AS h, "
                f"f.proof || coalesce(string_agg(n.h, '' ORDER BY n.i) FILTER (WHERE n.i <> f.{own}), '') AS proof "
                f"FROM f{step} f JOIN (SELECT *, count(*) OVER (PARTITION BY source) AS n FROM {tree}{k}) n ON n.i // {fanout} = f.{own} // {fanout} AND {match} GROUP BY f.doc_id, f.source, f.i, f.j, f.leaf, f.proof),\n"
            )
            step += 1
    return out + f"""root AS (SELECT h FROM t{levels})
SELECT f.doc_id, f.leaf, s.h AS subroot, r.h AS root, sha256(f.proof) AS proof_sha256, f.h AS folded_root, f.h = r.h AS verified
FROM f{step} f JOIN s{levels} s ON s.source IS NOT DISTINCT FROM f.source, root r
"""


MERKLE = _merkle()
