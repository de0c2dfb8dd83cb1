"""SQL, for DuckDB, that is made from a rule: checksums, secret spans, a tree of digests."""

from __future__ import annotations

#: Levels of the tree in SQL: up to 8^7 rows a group, 8^3 groups.
GROUP_LEVELS, TOP_LEVELS = 7, 3


def crc32(codes: str) -> str:
    """CRC-32 of a list of byte values."""
    byte = "list_reduce(list_prepend(xor(c, b), [CAST(0 AS BIGINT), 0, 0, 0, 0, 0, 0, 0]), lambda s, k: xor(s >> 1, (s & 1) * 3988292384))"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {codes}), lambda c, b: {byte}), 4294967295)"


def codes(text: str) -> str:
    """Code points of an ASCII string."""
    return f"list_transform(range(length({text})), lambda x: CAST(ascii(substr({text}, CAST(x + 1 AS BIGINT), 1)) AS BIGINT))"


def secrets() -> str:
    assign = "(?:" + "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c + "?" for c in w) for w in ("password", "passwd", "secret", "token", "api_key")) + ")"
    value = """["'']?\\x20*[:=]\\x20*["'']?[A-Za-z0-9+/_.=-]+"""
    value_alone = value.replace("[A-Za-z0-9+/_.=-]+", "([A-Za-z0-9+/_.=-]+)")
    base_62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
    digits = f"list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(range(6), lambda x: CAST(strpos('{base_62}', substr(body, CAST(31 + x AS BIGINT), 1)) - 1 AS BIGINT))), lambda s, d: s * 62 + d)"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
cut AS (
  SELECT doc_id, 0 AS n, regexp_extract_all(text, '(?s:{assign}{value}|[^PpSsTtAa]+|.)') AS p FROM d
  UNION ALL SELECT doc_id, 1, regexp_extract_all(text, '(?s:AKIA[A-Z0-9]+|[^A]+|.)') FROM d
  UNION ALL SELECT doc_id, 2, regexp_extract_all(text, '[0-9a-f]+|[^0-9a-f]+') FROM d
  UNION ALL SELECT doc_id, 3, regexp_extract_all(text, '[A-Za-z0-9]+|[^A-Za-z0-9]+') FROM d),
pieces AS (SELECT doc_id, n, unnest(p) AS piece, generate_subscripts(p, 1) AS i FROM cut),
placed AS (
  SELECT *, CAST(sum(length(piece)) OVER w - length(piece) AS BIGINT) AS first, lead(piece) OVER w AS sep, lead(piece, 2) OVER w AS body
  FROM pieces WINDOW w AS (PARTITION BY doc_id, n ORDER BY i)),
spans AS (
  SELECT doc_id, n, first, first + length(piece) AS stop, ['assign', 'access', 'hex'][n + 1] AS kind FROM placed
  WHERE (n = 0 AND regexp_full_match(piece, '{assign}{value}') AND length(regexp_extract(piece, '{assign}{value_alone}', 1)) >= 8)
     OR (n = 1 AND starts_with(piece, 'AKIA') AND length(piece) >= 16) OR (n = 2 AND length(piece) >= 32 AND regexp_full_match(piece, '[0-9a-f]+'))
  UNION ALL
  SELECT doc_id, CASE WHEN piece = 'npm' THEN 4 ELSE 3 END, first, first + 40, CASE WHEN piece = 'npm' THEN 'npm' ELSE 'github' END FROM placed
  WHERE n = 3 AND piece IN ('ghp', 'gho', 'ghu', 'ghs', 'ghr', 'npm') AND sep = '_' AND length(body) = 36 AND {digits} = {crc32(codes("substr(body, 1, 30)"))}),
lists AS (
  SELECT doc_id, count(*) FILTER (n = 0) AS n_assign, count(*) FILTER (n = 1) AS n_access, count(*) FILTER (n = 2) AS n_hex,
    string_agg(kind || ':' || first || ':' || stop, ',' ORDER BY first, n) FILTER (n < 3) AS base, string_agg(kind || ':' || first || ':' || stop, ',' ORDER BY first, n) AS spans
  FROM spans GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN lists ON lists.doc_id = d.doc_id
"""


def _climb(name: str, leaves: str, levels: int) -> str:
    """For ``leaves`` (grp, i, n, node): the joined runs of each level, and the node at the top of each group."""
    parts = [f"{name}_0 AS (SELECT grp, i, n, node FROM {leaves})"]
    for k in range(levels):
        parts.append(f"{name}_run_{k} AS (SELECT grp, i // 8 AS i, any_value(n) AS n, string_agg(node, '' ORDER BY i) AS run FROM {name}_{k} WHERE n > {8**k} GROUP BY grp, i // 8)")
        parts.append(f"{name}_{k + 1} AS (SELECT grp, i, n, sha256(run) AS node FROM {name}_run_{k})")
    tops = " UNION ALL ".join(f"SELECT grp, node FROM {name}_{k} WHERE n <= {8**k} AND n > {8 ** (k - 1) if k else 0}" for k in range(levels + 1))
    return ",\n".join([*parts, f"{name}_top AS ({tops})"])


def _proof(rows: str, name: str, levels: int, grp: str, at: str, n: str) -> str:
    """Add the siblings of each level to ``proof``, and fold ``folded`` with them."""
    parts = []
    for k in range(levels):
        here, run = f"{name}_proof_{k}", f"{name}_run_{k}"
        left, right = f"substr(run, 1, CAST(64 * (s.{at} // {8**k} % 8) AS BIGINT))", f"substr(run, CAST(64 * (s.{at} // {8**k} % 8) + 65 AS BIGINT))"
        parts.append(
            f"{here} AS (SELECT s.* REPLACE (CASE WHEN run IS NULL THEN proof ELSE proof || {left} || {right} END AS proof, CASE WHEN run IS NULL THEN folded ELSE sha256({left} || folded || {right}) END AS folded) "
            f"FROM {rows} s LEFT JOIN {run} r ON r.grp = s.{grp} AND r.i = s.{at} // {8 ** (k + 1)} AND s.{n} > {8**k})"
        )
        rows = here
    return ",\n".join(parts)


def merkle() -> str:
    def leaf(text: str) -> str:
        values = ("CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text)
        return "sha256(" + " || ".join(f"coalesce(strlen({v}) || ':' || {v}, '-')" for v in values) + ")"

    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    tampered = f"coalesce({crc32(codes('CAST(doc_id AS VARCHAR)'))} % 3 = 0, false)"
    return f"""
WITH leaves AS (SELECT doc_id, coalesce('=' || lang, '') AS lang_key, {leaf("text")} AS leaf, CASE WHEN {tampered} THEN {leaf(lowered)} ELSE {leaf("text")} END AS folded, '' AS proof FROM documents),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang_key ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang_key) AS n FROM leaves),
nodes AS (SELECT lang_key AS grp, i, n, leaf AS node FROM ranked),
{_climb("low", "nodes", GROUP_LEVELS)},
subroots AS (SELECT 0 AS grp, grp AS lang_key, row_number() OVER (ORDER BY grp) - 1 AS i, count(*) OVER () AS n, node FROM low_top),
{_climb("high", "subroots", TOP_LEVELS)},
rows_0 AS (SELECT r.*, 0 AS whole, s.i AS lang_i, s.n AS lang_n, s.node AS subroot FROM ranked r JOIN subroots s ON s.lang_key = r.lang_key),
{_proof("rows_0", "low", GROUP_LEVELS, "lang_key", "i", "n")},
{_proof(f"low_proof_{GROUP_LEVELS - 1}", "high", TOP_LEVELS, "whole", "lang_i", "lang_n")}
SELECT doc_id, leaf, subroot, t.node AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = t.node AS verified
FROM high_proof_{TOP_LEVELS - 1} CROSS JOIN high_top t
"""


def url_rules(listed: list[tuple[str, str]], min_confidence: float = 0.6, min_rows: int = 8, error: float = 0.01, widest: int = 8) -> str:
    """Listed rules, and all combinations of up to ``widest`` tokens of each bad URL, one by one."""
    longest = sorted(listed, key=lambda r: -len(r[1]))
    fits = [(v, r, f"(host = '{r.split('/')[0]}' OR ends_with(host, '.{r.split('/')[0]}')) AND starts_with(path, '/{r.partition('/')[2]}')") for v, r in longest]
    rule = "CASE " + " ".join(f"WHEN {test} THEN '{r}'" for _, r, test in fits) + " END"
    verdict = "CASE " + " ".join(f"WHEN {test} THEN '{v}'" for v, _, test in fits) + " END"
    pattern = "(?s)^(.*?)://([^/?#]*)([^?#]*)(?:\\?([^#]*))?(?:#(.*))?$"
    part = lambda i: f"coalesce(regexp_extract(url, '{pattern}', {i}), '')"
    each = lambda name, values, made: f"list_transform(list_filter({values}, lambda x: x <> ''), lambda x: '{name}:' || {made})"
    segment = "regexp_replace(regexp_replace(lower(x), '\\.[a-z0-9]{1,5}$', ''), '^[0-9]+$', '#')"
    kl = "(h / r) * ln((h / r) / share) + CASE WHEN h < r THEN (1 - h / r) * ln((1 - h / r) / (1 - share)) ELSE 0 END"
    return f"""
WITH cut AS (SELECT page_id, url, {part(1)} AS scheme, translate({part(2)}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, {part(3)} AS path, {part(4)} AS query, {part(5)} AS fragment FROM pages),
split AS (
  SELECT *, CASE WHEN contains(url, '://') THEN list_sort(list_distinct(list_filter(list_concat(
      ['scheme:' || lower(scheme), 'host:' || host, 'fragment:' || fragment, 'ending:' || lower(regexp_extract(path, '\\.([A-Za-z0-9]{{1,5}})$', 1))],
      {each("word", "regexp_split_to_array(host, '[.-]')", "x")}, {each("path", "string_split(path, '/')", segment)}, {each("query", "string_split(query, '&')", "lower(x)")}),
      lambda x: NOT ends_with(x, ':')))) ELSE [] END AS items
  FROM cut),
marks AS (SELECT doc_id, bool_or(coalesce(quality = 0, false) OR coalesce(toxic = 1, false)) AS bad FROM labels WHERE doc_id IS NOT NULL AND (quality IS NOT NULL OR toxic IS NOT NULL) GROUP BY doc_id),
known AS (SELECT s.page_id AS id, s.items, m.bad FROM split s JOIN marks m ON m.doc_id = try_cast(nullif(regexp_extract(s.path, '([0-9]+)[^0-9]*$', 1), '') AS BIGINT) WHERE len(s.items) > 0),
totals AS (SELECT count(*) FILTER (bad) / count(*) AS share, count(*) FILTER (bad) AS n_bad, count(*) AS n FROM known),
token_hits AS (SELECT token, count(*) AS freq FROM (SELECT unnest(items) AS token FROM known WHERE bad) GROUP BY token HAVING count(*) >= {min_rows}),
needed AS (SELECT greatest({min_rows}, ceil(ln(greatest((SELECT count(*) FROM token_hits), 1) / {error}) / -ln(share))) AS least, share FROM totals WHERE n_bad > 0 AND n_bad < n),
chosen AS (
  SELECT id, list(token ORDER BY freq, token)[1:{widest}] AS tokens
  FROM (SELECT id, unnest(items) AS token FROM known WHERE bad) JOIN token_hits USING (token) JOIN needed ON freq >= least GROUP BY id),
masks AS (SELECT id, tokens, unnest(range(1, 1 << len(tokens))) AS mask FROM chosen),
combos AS (SELECT list_sort(list_filter(tokens, lambda t, i: (mask >> CAST(i - 1 AS BIGINT)) & 1 = 1)) AS c FROM masks),
itemsets AS (SELECT c FROM combos, needed GROUP BY c, least HAVING count(*) >= least),
cover AS (SELECT c, count(*) AS r, count(*) FILTER (bad) AS h FROM itemsets JOIN known ON list_has_all(items, c) GROUP BY c),
mined AS (SELECT c FROM cover, needed WHERE h / r >= {min_confidence} AND h / r > share AND r * ({kl}) >= ln(greatest((SELECT count(*) FROM itemsets), 1) / {error})),
blocked AS (SELECT DISTINCT page_id FROM split JOIN mined ON list_has_all(items, c)),
judged AS (SELECT page_id, host, path, {rule} AS rule, {verdict} AS verdict FROM cut)
SELECT j.page_id, host, path, rule, coalesce(verdict, CASE WHEN b.page_id IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict FROM judged j LEFT JOIN blocked b ON b.page_id = j.page_id
"""
