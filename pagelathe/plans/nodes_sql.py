"""Nodes of pages in DuckDB SQL: a parser of its own, to hold the library's against."""

from __future__ import annotations

#: Tokens of the bodies, then one step a token of all pages at once: what is open, and the node that a start tag makes.
DECODED = "replace(replace(replace(replace(replace(replace(txt, '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&copy;', '©'), '&middot;', '·'), '&amp;', '&')"
NODES = r"""tok AS (SELECT page_id, unnest(range(1, len(t) + 1)) AS i, unnest(t) AS t FROM (SELECT page_id, regexp_extract_all(substr(html, strpos(html, '<body')), '</?[a-z][a-z0-9]*[^>]*>?[^<]*') AS t FROM pages)),
walk AS (
  SELECT page_id, 0::BIGINT AS i, []::INT[] AS ids, []::VARCHAR[] AS tags, 0 AS n, NULL::INT AS node_id, NULL::INT AS parent_id, NULL::INT[] AS path, '' AS tag, '' AS cls, '' AS href, '' AS txt FROM (SELECT DISTINCT page_id FROM tok)
  UNION ALL
  SELECT page_id, i, CASE WHEN ends THEN list_slice(ids, 1, keep) WHEN tag = 'br' THEN own ELSE list_append(own, n) END, CASE WHEN ends THEN list_slice(tags, 1, keep) WHEN tag = 'br' THEN list_slice(tags, 1, len(own)) ELSE list_append(list_slice(tags, 1, len(own)), tag) END,
    n + (NOT ends)::INT, CASE WHEN NOT ends THEN n END, CASE WHEN NOT ends THEN own[-1] END, CASE WHEN NOT ends THEN list_append(own, n) END, tag, cls, href, txt
  FROM (
    SELECT w.page_id, tok.i, ids, tags, n, starts_with(t, '</') AS ends, regexp_extract(t, '^</?([a-z0-9]+)', 1) AS tag, regexp_extract(t, '^<[^>]* class="([^" ]*)', 1) AS cls, regexp_extract(t, ' href="([^">]*)"[^>]*>', 1) AS href, regexp_extract(t, '^[^>]*>(.*)$', 1, 's') AS txt,
      CASE WHEN list_contains(tags, regexp_extract(t, '^</?([a-z0-9]+)', 1)) THEN len(tags) - list_position(list_reverse(tags), regexp_extract(t, '^</?([a-z0-9]+)', 1)) ELSE len(tags) END AS keep,
      CASE WHEN regexp_extract(t, '^<([a-z0-9]+)', 1) IN ('p', 'li') AND tags[-1] = regexp_extract(t, '^<([a-z0-9]+)', 1) THEN list_slice(ids, 1, len(ids) - 1) ELSE ids END AS own
    FROM walk w JOIN tok ON tok.page_id = w.page_id AND tok.i = w.i + 1)
),
one AS (SELECT page_id, node_id, parent_id, path, len(path) AS depth, tag, href, tag || CASE WHEN cls <> '' THEN '.' || cls ELSE '' END AS selector, row_number() OVER (PARTITION BY page_id, parent_id ORDER BY node_id) - 1 AS sibling_idx,
  '/' || tag || CASE WHEN tag = 'body' THEN '' ELSE '[' || row_number() OVER (PARTITION BY page_id, parent_id, tag ORDER BY node_id) || ']' END AS seg FROM walk WHERE node_id IS NOT NULL),
ups AS (SELECT page_id, node_id AS below, unnest(path) AS node_id FROM one),
spans AS (SELECT page_id, node_id, max(below) AS subtree_end FROM ups GROUP BY page_id, node_id),
xpaths AS (SELECT u.page_id, u.below AS node_id, string_agg(o.seg, '' ORDER BY o.node_id) AS xpath FROM ups u JOIN one o ON u.page_id = o.page_id AND u.node_id = o.node_id GROUP BY u.page_id, u.below),
said AS (SELECT page_id, ids[-1] AS node_id, left(trim(regexp_replace(DECODED, '\s+', ' ', 'g')), 200) AS text FROM (SELECT page_id, ids, string_agg(txt, '' ORDER BY i) AS txt FROM (SELECT page_id, ids[-1:] AS ids, i, txt FROM walk WHERE len(ids) > 0) GROUP BY page_id, ids)),
nodes AS (SELECT o.*, s.subtree_end, x.xpath FROM one o JOIN spans s ON o.page_id = s.page_id AND o.node_id = s.node_id JOIN xpaths x ON o.page_id = x.page_id AND o.node_id = x.node_id)""".replace("DECODED", DECODED)

LANDMARKS = "'header', 'nav', 'main', 'section', 'article', 'aside', 'footer'"


def over_nodes(select: str) -> str:
    """A query over the table `nodes`."""
    return f"WITH RECURSIVE {NODES} {select}"


ELEMENTS = over_nodes("SELECT page_id, node_id, parent_id, depth, sibling_idx, subtree_end, xpath, tag, selector, subtree_end - node_id + 1 AS element_count FROM nodes")
PAGE_STATS = over_nodes("SELECT page_id, count(*) AS total_elements, max(depth) AS max_depth, count(*) FILTER (tag = 'a') AS interactive FROM nodes GROUP BY page_id")
SEMANTIC_SECTIONS = over_nodes(f"SELECT page_id, node_id, tag, xpath FROM nodes n WHERE tag IN ({LANDMARKS}) AND NOT EXISTS (SELECT 1 FROM ups u JOIN one o ON u.page_id = o.page_id AND u.node_id = o.node_id WHERE u.page_id = n.page_id AND u.below = n.node_id AND o.node_id <> n.node_id AND o.tag IN ({LANDMARKS}))")
ANCESTORS = over_nodes("SELECT DISTINCT n.page_id, n.node_id, n.tag, n.tag = 'a' AS matched FROM nodes n JOIN ups u ON u.page_id = n.page_id AND u.node_id = n.node_id JOIN one o ON o.page_id = u.page_id AND o.node_id = u.below WHERE o.tag = 'a'")
FIRST_LANDMARKS = over_nodes(f"SELECT page_id, tag, min(node_id) AS node_id, arg_min(selector, node_id) AS selector FROM nodes WHERE tag IN ({LANDMARKS}) GROUP BY page_id, tag")
#: Tags that the layout shows; a node goes where one of those around it isn't shown.
SHOWN = f"{LANDMARKS}, 'body', 'div', 'ul', 'li', 'p', 'h1', 'h2', 'h3'"
LAYOUT = over_nodes(
    f"SELECT page_id, count(*) AS nodes, max(depth) - 1 AS max_depth, array_to_string(list(repeat('  ', depth - 1) || selector ORDER BY node_id)[1:300], chr(10)) AS tree FROM nodes n WHERE depth <= 15 "
    f"AND NOT EXISTS (SELECT 1 FROM ups u JOIN one o ON u.page_id = o.page_id AND u.node_id = o.node_id WHERE u.page_id = n.page_id AND u.below = n.node_id AND o.tag NOT IN ({SHOWN})) GROUP BY page_id"
)
#: The pages' own sheet has one rule; its text, and what a larger sheet around it makes of it.
SHEET = r"(SELECT page_id, regexp_extract(s, '^([^{]*)\{', 1) AS selector, regexp_extract(s, '\{([^}]*)\}', 1) AS body FROM (SELECT page_id, regexp_extract(html, '<style>([^<]*)</style>', 1) AS s FROM pages) WHERE s <> '')"
CSS = f"SELECT page_id, 0 AS rule_no, 'rule' AS kind, selector, '' AS conditions, body AS declarations FROM {SHEET}"
CSS_NESTED = f"""SELECT page_id, unnest(range(9)) AS rule_no, unnest(['import', 'media', 'rule', 'supports', 'pseudo', 'keyframes', 'step', 'variables', 'rule']) AS kind,
  unnest(['@import "a;b.css"', '@media (min-width: ' || page_id || 'px)', selector, '@supports (display: grid)', '.x::before', '@keyframes k', '50%', ':root', selector || ' .in & > b']) AS selector,
  unnest(['', '', '@media (min-width: ' || page_id || 'px)', '@media (min-width: ' || page_id || 'px)', '@media (min-width: ' || page_id || 'px) / @supports (display: grid)', '', '@keyframes k', '', '']) AS conditions,
  unnest(['', '', body, '', 'content="}}' || page_id || '{{"', '', 'top=' || page_id || 'px', '--a=url(data:x;y)', 'margin=0']) AS declarations FROM (SELECT page_id, selector, replace(body, ':', '=') AS body FROM {SHEET})"""


def _between(tag: str) -> str:
    """A page's first element of a tag without others of the same tag in it, as it stands, or '': up to its end tag, or the body's, or the page's."""
    rest = f"substr(html, strpos(html, '<{tag}'))"
    return f"CASE WHEN strpos(html, '<{tag}') = 0 THEN '' WHEN strpos({rest}, '</{tag}>') > 0 THEN left({rest}, strpos({rest}, '</{tag}>') + {len(tag) + 2}) WHEN strpos({rest}, '</body>') > 0 THEN left({rest}, strpos({rest}, '</body>') - 1) ELSE {rest} END"


PLAIN = "replace(replace(replace(replace(replace(regexp_replace(raw, '^<[^>]*>|</[a-z]*>$', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&')"
SECTIONS = over_nodes(
    "SELECT page_id, sibling_idx AS index, tag, selector, CASE tag WHEN 'nav' THEN 'navigation' WHEN 'footer' THEN 'footer' ELSE 'section_' || sibling_idx END AS name, CASE tag WHEN 'nav' THEN 'navigation' WHEN 'footer' THEN 'footer' ELSE 'section_' || sibling_idx END AS type, "
    "CASE WHEN length(text) >= 200 THEN left(text, 200) || '...' ELSE text END AS text, element_count, length(raw) AS raw_html_length "
    f"FROM (SELECT *, CASE WHEN tag IN ('div', 'footer') THEN trim(regexp_replace({PLAIN}, '\\s+', ' ', 'g')) ELSE '' END AS text FROM (SELECT n.page_id, sibling_idx, n.tag, selector, subtree_end - node_id + 1 AS element_count, CASE n.tag WHEN 'nav' THEN {_between('nav')} WHEN 'div' THEN {_between('div')} WHEN 'article' THEN {_between('article')} ELSE {_between('footer')} END AS raw FROM nodes n JOIN pages p ON n.page_id = p.page_id WHERE depth = 2))"
)
MAIN = over_nodes(f"SELECT n.page_id, max(n.node_id) AS node_id, max_by(n.tag, n.node_id) AS tag FROM nodes n JOIN pages p ON n.page_id = p.page_id WHERE n.tag = 'body' OR (n.depth = 2 AND n.tag = 'div' AND length({_between('div')}) >= 0.9 * length({_between('body')})) GROUP BY n.page_id")
TEXTS = "SELECT n.page_id, n.node_id, n.parent_id, n.depth, n.tag, n.selector, n.href, coalesce(s.text, '') AS text FROM nodes n LEFT JOIN said s ON n.page_id = s.page_id AND n.node_id = s.node_id"
VISIBLE = over_nodes(f"SELECT page_id, elements, text, elements > 5 OR length(text) > 50 AS has_content FROM (SELECT page_id, count(*) AS elements, coalesce(left(string_agg(text, ' ' ORDER BY node_id) FILTER (length(text) > 2), 1000), '') AS text FROM ({TEXTS}) GROUP BY page_id)")
REPEATED = over_nodes(f"SELECT page_id, parent_id, selector AS shape, count(*) AS items, array_to_string(list(text ORDER BY node_id)[1:3], '|') AS examples FROM ({TEXTS}) WHERE parent_id IS NOT NULL GROUP BY page_id, parent_id, selector HAVING count(*) >= 3")
HREF = DECODED.replace("txt", "href")
SNAPSHOT = over_nodes(f"SELECT page_id, node_id, tag, CASE WHEN href = '' THEN '' WHEN length({HREF}) > 100 THEN 'href=' || left({HREF}, 100) || '...' ELSE 'href=' || {HREF} END AS attributes, text FROM ({TEXTS}) WHERE depth <= 6 AND tag NOT IN ('script', 'style', 'noscript')")

#: Where each node's inner HTML ends: at the first token after which it is no longer open, or at the page's end.
SPANNED = r"""placed AS (SELECT page_id, i, t, strpos(html, '<body') + coalesce(sum(length(t)) OVER (PARTITION BY page_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos, length(html) + 1 AS over FROM tok JOIN pages USING (page_id)),
inner_of AS (SELECT m.page_id, m.node_id, m.parent_id, m.tag, greatest(0, coalesce(e.pos, s.over) - s.pos - length(regexp_extract(s.t, '^<[^>]*>?'))) AS inner_html_length
  FROM (SELECT page_id, i, node_id, parent_id, tag FROM walk WHERE node_id IS NOT NULL) m JOIN placed s ON s.page_id = m.page_id AND s.i = m.i
  JOIN (SELECT page_id, node_id, max(i) AS last FROM (SELECT page_id, i, unnest(ids) AS node_id FROM walk UNION ALL SELECT page_id, i - 1, node_id FROM walk WHERE tag = 'br' AND node_id IS NOT NULL) GROUP BY 1, 2) o ON o.page_id = m.page_id AND o.node_id = m.node_id LEFT JOIN placed e ON e.page_id = m.page_id AND e.i = o.last + 1)"""
SKIP = "'script', 'style', 'head', 'meta', 'link', 'noscript', 'svg', 'path', 'br', 'hr'"
SPLIT = f"""WITH RECURSIVE {NODES}, {SPANNED},
sized AS (SELECT n.page_id, n.node_id, n.parent_id, n.tag, n.depth, CAST(s.inner_html_length // 4 AS BIGINT) AS tokens, (n.node_id * 37 + n.page_id * 11) % 1700 + CASE WHEN n.depth < 3 THEN 1000 ELSE 0 END AS w, (n.node_id * 53 + n.page_id * 7) % 400 + CASE WHEN n.depth < 3 THEN 300 ELSE 0 END AS h,
  (SELECT count(*) FROM one k WHERE k.page_id = n.page_id AND k.parent_id = n.node_id) AS children FROM nodes n JOIN inner_of s ON s.page_id = n.page_id AND s.node_id = n.node_id),
-- 0: through wrappers, 1: within the content, 2: a section; nothing below a section or a skipped tag is looked at
down AS (
  SELECT sized.*, 0 AS state FROM sized WHERE parent_id IS NULL
  UNION ALL
  SELECT c.*, CASE WHEN down.state = 0 AND c.tag = 'div' AND c.children > 0 AND c.w >= 1620 AND c.h >= 450 THEN 0 WHEN c.h >= 50 AND (c.w >= 360 OR c.tokens >= 60) THEN 2 ELSE 1 END
  FROM down JOIN sized c ON c.page_id = down.page_id AND c.parent_id = down.node_id WHERE down.state < 2 AND c.tag NOT IN ({SKIP})),
fit AS (SELECT * FROM sized WHERE tag NOT IN ({SKIP}) AND tokens >= 5 AND (h >= 50 OR tokens >= 60)),
part AS (
  SELECT page_id, node_id, tokens, 0 AS level FROM down WHERE state = 2 AND tokens >= 5
  UNION ALL
  SELECT f.page_id, f.node_id, f.tokens, level + 1 FROM part JOIN fit f ON f.page_id = part.page_id AND f.parent_id = part.node_id WHERE part.tokens > 100 AND level < 15)
SELECT page_id, node_id, tokens, level FROM part p WHERE tokens <= 100 OR level = 15 OR NOT EXISTS (SELECT 1 FROM fit f WHERE f.page_id = p.page_id AND f.parent_id = p.node_id)"""

#: Addresses of all kinds, put at the end of each page's body.
ADDRESSES = """concat('<img SRC=\\'../a/./b.png?x=1/../2\\' srcset="/s.png 1x, ,img/t.png 300w,https://z.y/u.png"><video poster="//c.d/p.jpg" data-src=\\'v', page_id, '.mp4\\'></video><p style="background:url(\\'../../../../up.png\\') , url(i/j.png)"><a href="#top" HREF="mailto:a@b"></p></body>')"""
# Pages lie at /<language>/<number>, which counts as a folder.
ABSOLUTE = """SELECT page_id, md5(html) AS md5, length(html) AS n FROM (SELECT page_id, replace(regexp_replace(html, 'href="/', 'href="' || o || '/', 'g'), '</body>', '<img SRC=''' || o || '/' || lang || '/a/b.png?x=1/../2'' srcset="' || o || '/s.png 1x, ' || here || '/img/t.png 300w, https://z.y/u.png"><video poster="https://c.d/p.jpg" data-src=''' || here || '/v' || page_id || '.mp4''></video><p style="background:url(''' || o || '/up.png'') , url(' || here || '/i/j.png)"><a href="#top" HREF="mailto:a@b"></p></body>') AS html
FROM (SELECT page_id, html, regexp_extract(url, '^(https?://[^/?#]+)', 1) AS o, regexp_extract(url, '^https?://[^/]+/([^/]*)/', 1) AS lang, rtrim(regexp_extract(url, '^([^?#]*)', 1), '/') AS here FROM pages))"""
