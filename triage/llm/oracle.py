"""The queries of this package as SQL, where SQL can express them on whole tables."""

from __future__ import annotations

#: Unsigned CRC-32 of the text {x}, bit by bit (reflected polynomial 0xEDB88320).
_CRC32 = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length({x}) + 1), lambda i: ascii(substr({x}, i, 1))::BIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda r, k: CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384::BIGINT) ELSE r >> 1 END)),
    4294967295::BIGINT)"""

FILL_MIDDLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u,
                  sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS s FROM documents),
h AS (SELECT *, len(u) AS n, ('0x' || s[1:8])::BIGINT AS h1, ('0x' || s[9:16])::BIGINT AS h2, ('0x' || s[17:24])::BIGINT AS h3,
             ('0x' || s[25:32])::BIGINT AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
             CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain'
                  WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, array_to_string(u[1:a], '') AS prefix, array_to_string(u[a + 1:b], '') AS middle, array_to_string(u[b + 1:n], '') AS suffix FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END::BIGINT AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(middle) END::BIGINT AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
              ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(t) AS restored_sha256 FROM p
"""

PREFIX_TRIE = r"""
WITH t AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
                  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
                      sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS n
           FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT c, CRC % 4 AS h FROM (SELECT DISTINCT c FROM t)),
rows AS (SELECT convs.c, 0 AS part, t.n, t.role, t.text FROM convs JOIN t ON t.c = convs.c - convs.c % 20 AND t.n <= convs.h
         UNION ALL SELECT convs.c, 1, t.n, t.role, t.text FROM convs JOIN t ON t.c = convs.c AND t.n > convs.h),
seqs AS (SELECT c, coalesce(list(struct_pack(role := role, text := text) ORDER BY part, n) FILTER (n IS NOT NULL), []) AS s
         FROM convs LEFT JOIN rows USING (c) GROUP BY c),
pre AS (SELECT c, d, s[1:d] AS p, d = len(s) AS ends FROM (SELECT c, s, unnest(range(len(s) + 1)) AS d FROM seqs)),
nodes AS (SELECT d, p, min(c) AS conv_id, count(*) AS n_convs, list(c ORDER BY c) FILTER (ends) AS ends FROM pre GROUP BY d, p),
valued AS (SELECT *, CASE WHEN d = 0 THEN 0 ELSE (n_convs - 1) * len(regexp_extract_all(p[d].text, '[^\x20\x09-\x0D]+')) END AS v,
                  (SELECT count(*) FROM nodes k WHERE k.d = nodes.d + 1 AND k.p[1:nodes.d] = nodes.p) AS n_children FROM nodes),
below AS (SELECT a.d, a.p, sum(b.v) AS saved, count(*) FILTER (b.n_children = 0) AS n_leaves
          FROM valued a JOIN valued b ON b.d >= a.d AND b.p[1:a.d] = a.p GROUP BY a.d, a.p)
SELECT v.conv_id, v.d::BIGINT AS depth, up.conv_id AS parent_conv_id, v.n_convs::BIGINT AS n_convs, v.n_children::BIGINT AS n_children,
       below.n_leaves::BIGINT AS n_leaves, below.saved::BIGINT AS saved_tokens, sha256(coalesce(array_to_string(v.ends, ','), '')) AS ends_sha256
FROM valued v JOIN below ON below.d = v.d AND below.p = v.p LEFT JOIN nodes up ON up.d = v.d - 1 AND up.p = v.p[1:v.d - 1]
""".replace("CRC", _CRC32.format(x="c::VARCHAR"))

EXACT_DEDUP = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS k FROM documents),
g AS (SELECT k, first(doc_id ORDER BY n DESC, doc_id NULLS LAST) AS keep_id, max(n) AS n, count(*) AS group_size FROM d GROUP BY k)
SELECT d.doc_id, g.keep_id, g.group_size::BIGINT AS group_size, d.n = g.n AND d.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, sha256(d.k) AS text_sha256
FROM d JOIN g USING (k)
"""

SQL: dict[str, str] = {"op11_fill_middle": FILL_MIDDLE, "op12_prefix_trie": PREFIX_TRIE, "op13_exact_dedup": EXACT_DEDUP}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(text: str, pattern: str) -> str:
    return f"regexp_extract_all(translate(coalesce({text}, ''), '{_UPPER}', '{_LOWER}'), '{pattern}')"


def _components(ids: str, links: str) -> str:
    """CTEs: reach (a, b) of all pairs in either order that links connect, and comp (id, component_id)."""
    return f"""both_ways AS (SELECT a, b FROM {links} UNION SELECT b, a FROM {links}),
reach AS (SELECT a, b FROM both_ways UNION SELECT r.a, l.b FROM reach r JOIN both_ways l ON l.a = r.b),
comp AS (SELECT i.id, least(i.id, coalesce(min(reach.b), i.id)) AS component_id FROM {ids} i LEFT JOIN reach ON reach.a = i.id GROUP BY i.id)"""


EMBEDDING_JOIN = f"""
WITH RECURSIVE v AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS x FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding::DOUBLE[], lambda z: z IS NULL OR NOT isfinite(z))) = 0 AND len(list_filter(embedding::DOUBLE[], lambda z: z <> 0)) > 0),
links AS (SELECT a.id AS a, b.id AS b FROM v a JOIN v b ON a.label = b.label AND a.id < b.id AND len(a.x) = len(b.x)
    AND list_cosine_similarity(a.x, b.x) >= 0.93),
ids AS (SELECT DISTINCT vec_id AS id FROM embeddings),
{_components("ids", "links")},
n AS (SELECT id, count(*) AS n_links FROM (SELECT a AS id FROM links UNION ALL SELECT b FROM links) GROUP BY id)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings e JOIN comp ON comp.id = e.vec_id LEFT JOIN n ON n.id = e.vec_id
"""

NGRAM_JOIN = rf"""
WITH RECURSIVE w AS (SELECT doc_id AS id, {_words("text", r"[^\x20\x09-\x0D]+")} AS ws FROM documents),
g AS (SELECT DISTINCT id, ws[i:i + least(4, len(ws)) - 1] AS s FROM (SELECT id, ws, unnest(range(1, len(ws) - least(4, len(ws)) + 2)) AS i FROM w WHERE len(ws) > 0)),
size AS (SELECT w.id, count(g.id) AS n FROM w LEFT JOIN g USING (id) GROUP BY w.id),
common AS (SELECT a.id AS a, b.id AS b, count(*) AS c FROM g a JOIN g b ON a.s = b.s AND a.id < b.id GROUP BY a.id, b.id),
links AS (SELECT a, b FROM common JOIN size x ON x.id = a JOIN size y ON y.id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
ids AS (SELECT id FROM size),
{_components("ids", "links")},
n AS (SELECT id, count(*) AS n_links FROM (SELECT a AS id FROM links UNION ALL SELECT b FROM links) GROUP BY id)
SELECT size.id AS doc_id, size.n::BIGINT AS n_shingles, component_id, coalesce(n_links, 0)::BIGINT AS n_links
FROM size JOIN comp USING (id) LEFT JOIN n USING (id)
"""

SUFFIX_DEDUP = """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS x, strlen(coalesce(text, '')) AS n FROM documents),
win AS (SELECT doc_id, i, x[i:i + 49] AS s FROM (SELECT doc_id, x, unnest(range(1, n - 48)) AS i FROM d WHERE n >= 50)),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS first FROM win) WHERE first < doc_id),
runs AS (SELECT doc_id, min(i) AS lo, max(i) AS hi FROM (SELECT doc_id, i, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS r FROM gone) GROUP BY doc_id, r),
edges AS (SELECT doc_id, lo, hi FROM runs UNION ALL SELECT doc_id, n + 1, n + 1 FROM d),
kept AS (SELECT doc_id, lag(hi, 1, 0) OVER (PARTITION BY doc_id ORDER BY lo) + 1 AS a, lo - 1 AS b FROM edges),
text AS (SELECT doc_id, string_agg(CASE WHEN a <= b THEN hex(x[a:b]) ELSE '' END, '' ORDER BY a) AS t FROM kept JOIN d USING (doc_id) GROUP BY doc_id),
sums AS (SELECT doc_id, sum(hi - lo + 1) AS n_removed, count(*) AS n_spans FROM runs GROUP BY doc_id)
SELECT d.doc_id, d.n::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(t)) AS kept_sha256
FROM d JOIN text USING (doc_id) LEFT JOIN sums USING (doc_id)
"""

DECONTAMINATION = rf"""
WITH w AS (SELECT doc_id, {_words("text", r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")} AS ws FROM documents),
iw AS (SELECT item_id, {_words("text", r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")} AS ws FROM benchmark),
win AS (SELECT DISTINCT item_id, ws[i:i + least(10, len(ws)) - 1] AS g FROM (
    SELECT item_id, ws, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS i FROM iw WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT len(g) AS l FROM win),
dw AS (SELECT doc_id, i, l, ws[i:i + l - 1] AS g FROM (SELECT doc_id, ws, l, unnest(range(1, len(ws) - l + 2)) AS i FROM w JOIN sizes ON len(ws) >= l)),
hit AS (SELECT doc_id, i, l, item_id FROM dw JOIN win USING (g)),
covered AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + l)) AS j FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, list_sort(list(DISTINCT item_id::VARCHAR)) AS ids FROM hit GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(len(ids), 0)::BIGINT AS n_items,
       sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""

SQL |= {"op5_embedding_join": EMBEDDING_JOIN, "op6_ngram_join": NGRAM_JOIN, "op7_suffix_dedup": SUFFIX_DEDUP, "op8_decontamination": DECONTAMINATION}
