"""DuckDB SQL of op11 to op13, written from their contracts without the operators' code."""
from __future__ import annotations

FILTER_AUDIT = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents
), m AS (
  SELECT doc_id, part, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY t) AS least FROM d
), marks AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id
), f AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    (CASE WHEN len(w) < 200 THEN 'A' ELSE '' END)
    || (CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END)
    || (CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) THEN 'C' ELSE '' END)
    || (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END)
    || (CASE WHEN coalesce(least < doc_id, FALSE) THEN 'E' ELSE '' END) AS fails
  FROM m LEFT JOIN marks USING (doc_id)
), c AS (
  SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, fails
), letters AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l
), orders AS (
  SELECT a.l || b.l || c.l || d.l || e.l AS o FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5
), steps AS (
  SELECT o, s, o[s] AS l, substr(o, 1, s - 1) AS before FROM orders, (SELECT unnest(range(1, 6)) AS s)
), x AS (
  SELECT part, o, s, l, n, good, toxic, fails,
    contains(fails, l) AS own, len(list_intersect(string_split(fails, ''), string_split(before, ''))) > 0 AND fails <> '' AND before <> '' AS gone
  FROM c, steps
), r AS (
  SELECT part, o, s, l,
    sum(CASE WHEN NOT own AND NOT gone THEN n ELSE 0 END) AS kept, sum(CASE WHEN own AND NOT gone THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN own AND gone THEN n ELSE 0 END) AS redundant, sum(CASE WHEN fails = l THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN own AND NOT gone THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN own AND NOT gone THEN toxic ELSE 0 END) AS toxic_lost
  FROM x GROUP BY part, o, s, l
)
SELECT part, o AS filter_order, CAST(s AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
  CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
  CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, l) AS BIGINT) AS shapley
FROM r
"""


def _field(column: str) -> str:
    return f"coalesce(CAST(octet_length(encode(CAST({column} AS VARCHAR))) AS VARCHAR) || ':' || CAST({column} AS VARCHAR), '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


def _tree(name: str, leaves: str) -> str:
    """CTEs <name> (lvl, tree, i, digest, n) and <name>_sides (with the digests left and right in the run) above `leaves`."""
    return f"""{name} AS (
  SELECT 0 AS lvl, tree, i, digest, n FROM {leaves}
  UNION ALL
  SELECT lvl + 1, tree, i // 8, sha256(string_agg(digest, '' ORDER BY i)), (max(n) + 7) // 8 FROM {name} WHERE n > 1 GROUP BY lvl, tree, i // 8
), {name}_sides AS (
  SELECT a.lvl, a.tree, a.i, coalesce(string_agg(b.digest, '' ORDER BY b.i) FILTER (WHERE b.i < a.i), '') AS l, coalesce(string_agg(b.digest, '' ORDER BY b.i) FILTER (WHERE b.i > a.i), '') AS r
  FROM {name} a JOIN {name} b ON a.lvl = b.lvl AND a.tree = b.tree AND a.i // 8 = b.i // 8 WHERE a.n > 1 GROUP BY a.lvl, a.tree, a.i
)"""


#: crc32 of the decimal doc_id: the reflected polynomial, bit by bit.
_CRC = """xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
    lambda a, b: list_reduce(list_prepend(xor(a, b), [CAST(0 AS BIGINT), 0, 0, 0, 0, 0, 0, 0]), lambda x, k: xor(x >> 1, (x & 1) * 3988292384))), 4294967295)"""

MERKLE_MANIFEST = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, {_leaf("text")} AS leaf, {_leaf("lowered")} AS other, {_CRC} % 3 = 0 AS tampered, CASE WHEN lang IS NULL THEN '' ELSE 'x' || lang END AS tree
  FROM (SELECT *, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lowered FROM documents)
), leaves AS (
  SELECT doc_id, CASE WHEN coalesce(tampered, FALSE) THEN other ELSE leaf END AS given, leaf AS digest, tree,
    row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY tree) AS n
  FROM d
), {_tree("inner_nodes", "leaves")}, subroots AS (
  SELECT tree AS name, '' AS tree, digest, row_number() OVER (ORDER BY encode(tree)) - 1 AS i, count(*) OVER () AS n FROM inner_nodes WHERE n = 1
), {_tree("upper_nodes", "subroots")}, folds AS (
  SELECT doc_id, tree, digest AS leaf, 0 AS lvl, i, given AS folded, '' AS proof FROM leaves
  UNION ALL
  SELECT doc_id, f.tree, leaf, f.lvl + 1, f.i // 8, sha256(l || folded || r), proof || l || r FROM folds f JOIN inner_nodes_sides s ON f.lvl = s.lvl AND f.tree = s.tree AND f.i = s.i
), at_subroot AS (
  SELECT f.*, s.digest AS subroot, s.i AS place FROM folds f JOIN inner_nodes t ON t.n = 1 AND t.tree = f.tree AND t.lvl = f.lvl JOIN subroots s ON s.name = f.tree
), upper_folds AS (
  SELECT doc_id, leaf, subroot, 0 AS lvl, place AS i, folded, proof FROM at_subroot
  UNION ALL
  SELECT doc_id, leaf, subroot, f.lvl + 1, f.i // 8, sha256(l || folded || r), proof || l || r FROM upper_folds f JOIN upper_nodes_sides s ON f.lvl = s.lvl AND f.i = s.i
)
SELECT doc_id, leaf, subroot, u.digest AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = u.digest AS verified
FROM upper_folds f JOIN upper_nodes u ON u.n = 1 AND u.lvl = f.lvl
"""

_KEY = "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
_ASSIGN = _KEY + r"""["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
#: (kind, place, pattern, condition on a match m)
_KINDS = [
    ("assign", 0, _ASSIGN, f"length(regexp_extract(m, '{_ASSIGN}', 2)) >= 6"),
    ("access", 1, "AKIA[A-Z0-9]+", "length(m) >= 20"),
    ("hex", 2, "[0-9a-f]+", "length(m) >= 24"),
    ("private_key", 3, "-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----", "TRUE"),
    ("forge_token", 4, "gh[opsu]_[A-Za-z0-9]{36,}", "TRUE"),
    ("chat_token", 5, "xox[abprs]-[A-Za-z0-9-]{10,}", "TRUE"),
]

#: All runs of hexadecimal digits would make a long list; those too short hold no longer ones, so they are left out at once.
_LISTED = {"hex": "[0-9a-f]{24,}"}

BLOB_LEDGER = f"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS t FROM documents
), listed AS (
  {" UNION ALL ".join(f"SELECT row, t, '{kind}' AS kind, {place} AS place, regexp_extract_all(t, '{_LISTED.get(kind, pattern)}') AS ms FROM d" for kind, place, pattern, _ in _KINDS)}
), walk AS (
  SELECT row, t, kind, place, ms, 0 AS k, '' AS m, CAST(0 AS BIGINT) AS s, CAST(0 AS BIGINT) AS e FROM listed WHERE len(ms) > 0
  UNION ALL
  SELECT row, t, kind, place, ms, k + 1, ms[k + 1], e + strpos(substr(t, e + 1), ms[k + 1]) - 1, e + strpos(substr(t, e + 1), ms[k + 1]) - 1 + length(ms[k + 1]) FROM walk WHERE k < len(ms)
), spans AS (
  SELECT row, kind, place, s, kind || ':' || s || ':' || e AS span FROM walk
  WHERE k > 0 AND CASE kind {" ".join(f"WHEN '{kind}' THEN {condition}" for kind, _, _, condition in _KINDS)} END
), g AS (
  SELECT row, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access, count(*) FILTER (WHERE kind = 'hex') AS n_hex,
    string_agg(span, ',' ORDER BY s, place) FILTER (WHERE place < 3) AS base, string_agg(span, ',' ORDER BY s, place) AS spans
  FROM spans GROUP BY row
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (row)
"""
