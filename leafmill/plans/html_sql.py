"""SQL, for DuckDB, of the readable blocks of pages: a walk over the tokens of all pages, one token a step."""

from __future__ import annotations

from leafmill.functions.text import ENTITIES
from leafmill.sources.html import BLOCKS, HEAD_PARTS, HEADINGS, HIDDEN

_SPACE = r"[\t-\r\x{85}\pZ]"
_INSIDE = rf"""(?:[^>="'']|["'']|(?:={_SPACE}*)+(?:"[^"]*"|''[^'']*''|[^>="''\t-\r\x{{85}}\pZ]))*(?:={_SPACE}*)*"""
_CODE = "|".join(rf"<(?i:{n})(?:(?:/|{_SPACE}){_INSIDE})?>(?s:.*?)</(?i:{n})[^>]*>|<(?i:{n})(?:(?:/|{_SPACE}){_INSIDE})?>(?s:.*)" for n in ("script", "style"))
_EMPTY = rf"<(?i:script|style)(?:(?:/|{_SPACE}){_INSIDE})?/{_SPACE}*>"
_TOKEN = rf"<!--(?:>|->|(?s:.*?)-->)|<!--(?s:.*)|({_EMPTY})|{_CODE}|(<[A-Za-z/!?]{_INSIDE}>)|([^<]+|<)"


def _names(names) -> str:
    return "(" + ", ".join(f"'{n}'" for n in sorted(names)) + ")"


_LISTS = _names(("li", "ul", "ol"))
_DECODED = ", ".join(f"'{k}': {v}" for k, v in ENTITIES.items())

BLOCKS_SQL = rf"""
cut AS (SELECT page_id, regexp_extract_all(html, '{_TOKEN}') AS ts FROM pages WHERE html IS NOT NULL),
tokens AS (SELECT page_id, unnest(ts) AS token, generate_subscripts(ts, 1) AS i FROM cut),
dead AS (SELECT page_id, min(i) AS first FROM (SELECT *, lead(token) OVER (PARTITION BY page_id ORDER BY i) AS after FROM tokens) WHERE token = '<' AND regexp_matches(after, '^[A-Za-z/!?]') GROUP BY page_id),
living AS (SELECT t.page_id, t.i, t.token FROM tokens t LEFT JOIN dead d ON d.page_id = t.page_id WHERE d.first IS NULL OR t.i < d.first),
code AS (SELECT *, starts_with(token, '<!--') OR (regexp_matches(token, '^<(?i:script|style)(?:[/>]|{_SPACE})') AND NOT regexp_full_match(token, '{_EMPTY}')) AS passed,
  CASE WHEN regexp_matches(token, '^<[A-Za-z/!?]') THEN lower(regexp_extract(token, '^</*([A-Za-z0-9]+)(?:[/>]|{_SPACE})', 1)) END AS name,
  starts_with(token, '</') AS closing, regexp_matches(token, '/{_SPACE}*>$') AS empty FROM living),
numbered AS (SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY i) AS i, token, name, closing, empty FROM code WHERE NOT passed),
ended AS (SELECT * FROM numbered UNION ALL SELECT c.page_id, coalesce(max(n.i), 0) + 1, '</p>', 'p', true, false FROM cut c LEFT JOIN numbered n ON n.page_id = c.page_id GROUP BY c.page_id),
last_one AS (SELECT page_id, max(i) AS last FROM ended GROUP BY page_id),
walk AS (
  SELECT page_id, CAST(0 AS BIGINT) AS i, '' AS token, '' AS name, false AS closing, '' AS inside, false AS shown, 0 AS pre, 0 AS pre_before, false AS in_item, false AS in_item_before FROM cut
  UNION ALL
  SELECT page_id, i, token, name, closing,
    CASE WHEN here <> '' AND closing AND name = here THEN '' WHEN here = '' AND name IN {_names(HIDDEN)} AND NOT closing AND NOT empty THEN name ELSE here END AS inside,
    visible AS shown,
    CASE WHEN visible AND name = 'pre' THEN CASE WHEN closing THEN greatest(pre - 1, 0) ELSE pre + 1 END ELSE pre END AS pre, pre AS pre_before,
    CASE WHEN visible AND name = 'li' THEN NOT closing WHEN visible AND name IN {_LISTS} THEN false ELSE in_item END AS in_item, in_item AS in_item_before
  FROM (SELECT *, here = '' AND NOT (coalesce(name IN {_names(HIDDEN)}, false) AND NOT closing AND NOT empty) OR is_end AS visible
    FROM (SELECT e.*, w.pre, w.in_item, e.i = o.last AS is_end,
        CASE WHEN e.i = o.last OR (w.inside = 'head' AND e.name IS NOT NULL AND NOT e.closing AND e.name NOT IN {_names(HEAD_PARTS)}) THEN '' ELSE w.inside END AS here
      FROM walk w JOIN ended e ON e.page_id = w.page_id AND e.i = w.i + 1 JOIN last_one o ON o.page_id = w.page_id))),
roles AS (
  SELECT page_id, i, token, name, closing, pre_before > 0 AS pre,
    CASE WHEN name IN {_names(HEADINGS)} THEN name WHEN in_item_before AND name IN {_LISTS} THEN 'li' WHEN name IN {_names(BLOCKS)} THEN CASE WHEN pre_before > 0 THEN 'pre' ELSE 'p' END END AS kind
  FROM walk WHERE shown AND i > 0),
pieces AS (
  SELECT *, CASE WHEN name IS NULL THEN CASE WHEN pre THEN replace(token, chr(13), '') ELSE regexp_replace(token, '{_SPACE}+', ' ', 'g') END
      WHEN name = 'br' THEN chr(13) || 'b' WHEN name IN ('td', 'th') AND closing THEN chr(13) || 'c' END AS piece,
    count(kind) OVER (PARTITION BY page_id ORDER BY i) - CASE WHEN kind IS NULL THEN 0 ELSE 1 END AS block
  FROM roles),
joined AS (SELECT page_id, block, max(kind) AS kind, bool_or(pre) FILTER (kind IS NOT NULL) AS pre, coalesce(string_agg(piece, '' ORDER BY i), '') AS t FROM pieces GROUP BY page_id, block),
spaced AS (
  SELECT page_id, block, kind, CASE WHEN pre THEN
      replace(regexp_replace(regexp_replace(regexp_replace(t, '(?:\rc)+\rb', chr(13) || 'b', 'g'), ' ?\rb', chr(10), 'g'), '([^ \n])(?:\rc)+', '\1 ', 'g'), chr(13) || 'c', '')
    ELSE regexp_replace(regexp_replace(replace(t, chr(13) || 'c', ' '), ' +', ' ', 'g'), ' ?\rb ?', chr(10), 'g') END AS t
  FROM joined),
parts AS (SELECT page_id, block, unnest(list_prepend('', regexp_extract_all(t, '(?s)&[^;&]{{0,32}};|&|[^&]+'))) AS part, generate_subscripts(list_prepend('', regexp_extract_all(t, '(?s)&[^;&]{{0,32}};|&|[^&]+')), 1) AS n FROM spaced),
decoded AS (
  SELECT page_id, block, string_agg(CASE WHEN starts_with(part, '&') THEN coalesce(
      CASE WHEN regexp_matches(part, '^&#[0-9]{{1,7}};$') THEN chr(CAST(substr(part, 3, length(part) - 3) AS INT)) END,
      CASE WHEN regexp_matches(part, '^&#[xX][0-9a-fA-F]{{1,6}};$') THEN chr(CAST('0x' || substr(part, 4, length(part) - 4) AS INT)) END,
      chr(CAST(MAP {{{_DECODED}}}[regexp_extract(part, '(?s)^&(.*);$', 1)] AS INT)), part) ELSE part END, '' ORDER BY n) AS t
  FROM parts GROUP BY page_id, block),
trimmed AS (
  SELECT s.page_id, s.block, s.kind, d.t AS whole, regexp_replace(regexp_replace(d.t, '^{_SPACE}+', ''), '{_SPACE}+$', '') AS bare FROM spaced s JOIN decoded d ON d.page_id = s.page_id AND d.block = s.block),
blocks AS (SELECT page_id, block, kind, CASE WHEN kind <> 'pre' OR bare = '' THEN bare ELSE regexp_replace(regexp_replace(whole, '^\n+', ''), '{_SPACE}+$', '') END AS text FROM trimmed)"""

_MARKS = "CASE kind WHEN 'li' THEN '- ' " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in HEADINGS.items()) + " ELSE '' END"
HTML_BLOCKS = f"WITH RECURSIVE {BLOCKS_SQL} SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY block) AS INT) AS block, kind, text FROM blocks WHERE text <> ''"
HTML_TEXT = f"""WITH RECURSIVE {BLOCKS_SQL},
texts AS (SELECT page_id, string_agg({_MARKS} || text || CASE kind WHEN 'li' THEN chr(10) ELSE chr(10) || chr(10) END, '' ORDER BY block) AS text FROM blocks WHERE text <> '' GROUP BY page_id)
SELECT p.page_id, CASE WHEN p.html IS NULL THEN NULL ELSE coalesce(t.text, '') END AS text, CAST(length(CASE WHEN p.html IS NULL THEN NULL ELSE coalesce(t.text, '') END) AS INT) AS n_chars,
  coalesce(length(regexp_replace(t.text, '[\\s\\pZ]', '', 'g')) >= 100, false) AS has_text FROM pages p LEFT JOIN texts t ON t.page_id = p.page_id"""
