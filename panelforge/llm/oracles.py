"""DuckDB SQL of the operators that SQL can express."""

from __future__ import annotations

_CASES = """CASE WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/7') THEN 'example.com/en/7'
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/de/8') THEN 'example.net/de/8'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/en/') THEN 'com/en/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/de/') THEN 'net/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/es/') THEN 'org/es/' END"""
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _alias(url: str) -> str:
    """SQL of a URL's canonical form."""
    bare = f"regexp_replace(regexp_replace({url}, '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '#.*$', '')"
    host = f"regexp_replace({_LOWER.format(f"regexp_extract({bare}, '^[^/?]*')")}, '^(?:www|m)\\.', '')"
    path = f"regexp_replace(regexp_replace(regexp_extract({bare}, '^[^/?]*([^?]*)', 1), '/index\\.html?$', '/'), '(?:\\.html?|/)$', '')"
    query = rf"regexp_replace(regexp_replace(regexp_replace(regexp_extract({bare}, '\?(.*)$', 1), '(^|&)(?:utm_[a-z]+|ref|fbclid|gclid)=[^&]*', '', 'g'), '&+', '&', 'g'), '^&|&$', '', 'g')"
    return f"concat({host}, {path}, CASE WHEN {query} != '' THEN concat('?', {query}) ELSE '' END)"


_TAGS = r"""list_concat(
    list_transform(regexp_extract_all(html, '(?i)<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*>'), lambda x: regexp_extract(x, '(?i)\bhref\s*=\s*["'']?([^"''\s>]+)', 1)),
    list_transform(regexp_extract_all(html, '(?i)<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*>'), lambda x: regexp_extract(x, '(?i)\burl\s*=\s*["'']?([^"''\s>]+)', 1)))"""

OP1 = rf"""
WITH RECURSIVE r AS (SELECT page_id, html, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, html, url, {_LOWER.format("regexp_extract(rest, '^[^/?#]*')")} AS host, regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM r),
k AS (SELECT page_id, html, host, path, {_CASES} AS rule, CASE WHEN strpos(url, '://') > 0 THEN {_alias("url")} END AS key FROM p),
t AS (SELECT key, host, unnest({_TAGS}) AS t FROM k WHERE key IS NOT NULL AND regexp_matches(html, '(?i)canonical|http-equiv')),
u AS (SELECT key, CASE WHEN regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN t WHEN starts_with(t, '//') THEN concat('http:', t) WHEN starts_with(t, '/') THEN concat('http://', host, t) END AS target FROM t),
e AS (SELECT DISTINCT key AS a, {_alias("target")} AS b FROM u WHERE target IS NOT NULL),
ends_ AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach AS (SELECT a AS key, a AS alias FROM ends_ UNION SELECT reach.key, ends_.b FROM reach JOIN ends_ ON reach.alias = ends_.a),
aliases AS (SELECT key, alias FROM reach UNION SELECT key, key FROM k WHERE key IS NOT NULL),
said AS (SELECT key AS alias, bool_or(rule = 'example.com/en/7') AS allowed FROM k WHERE rule IS NOT NULL AND key IS NOT NULL GROUP BY key),
d AS (SELECT key, bool_or(allowed) AS allowed FROM aliases JOIN said USING (alias) GROUP BY key)
SELECT page_id, host, path, rule, CASE WHEN rule = 'example.com/en/7' THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN allowed THEN 'allow' WHEN NOT allowed THEN 'block' ELSE 'allow' END AS verdict FROM k LEFT JOIN d USING (key)
"""


def _level(name: str, above: str, keys: list[str]) -> str:
    parent = keys[:-1]
    part = f"PARTITION BY {', '.join(parent)}" if parent else ""
    join = f"JOIN {above} b USING ({', '.join(parent)})" if parent else f"CROSS JOIN {above} b"
    k = ", ".join(keys)
    return f"""
{name}_n AS (SELECT {", ".join(f"n.{c}" for c in keys)}, n.tokens, n.tokens * 4 AS cap, pow(n.tokens::DOUBLE, 0.5) AS weight, b.budget FROM (SELECT {k}, sum(tokens)::BIGINT AS tokens FROM leaves GROUP BY {k}) n {join}),
{name}_r AS (SELECT *, cap / weight AS ratio FROM {name}_n),
{name}_f AS (SELECT *, coalesce(sum(cap) OVER w, 0) + ratio * (sum(weight) OVER ({part}) - coalesce(sum(weight) OVER w, 0)) <= budget AS filled FROM {name}_r WINDOW w AS ({part} ORDER BY ratio, {keys[-1]} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
{name} AS (SELECT {k}, tokens, CASE WHEN filled THEN cap::DOUBLE ELSE (budget - sum(CASE WHEN filled THEN cap ELSE 0 END) OVER ({part})) * weight / sum(CASE WHEN filled THEN 0 ELSE weight END) OVER ({part}) END AS budget FROM {name}_f)"""


OP3 = f"""
WITH docs AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    CASE WHEN length(text) > 0 THEN length(text) - length(replace(replace(text, ' ', ''), chr(10), '')) + 1 ELSE 0 END AS tokens FROM documents),
rows_ AS (SELECT doc_id, CASE WHEN regexp_extract(source, '([0-9])$', 1) != '' THEN concat('d', CAST(regexp_extract(source, '([0-9])$', 1) AS BIGINT) % 5) ELSE substr(source, 1, 1) END AS domain, lang, source, tokens FROM docs WHERE tokens > 0),
leaves AS (SELECT domain, lang, source, sum(tokens)::BIGINT AS tokens FROM rows_ GROUP BY ALL),
total AS (SELECT sum(tokens)::DOUBLE AS budget FROM leaves),
{_level("l1", "total", ["domain"])},
{_level("l2", "l1", ["domain", "lang"])},
{_level("l3", "l2", ["domain", "lang", "source"])},
plan AS (SELECT domain, lang, source, tokens AS leaf_tokens, floor(budget + 0.5)::BIGINT AS budget FROM l3),
taken AS (SELECT r.*, e.epoch, budget - e.epoch * leaf_tokens AS remaining FROM rows_ r JOIN plan USING (domain, lang, source) CROSS JOIN (SELECT unnest(range(0, 4))::INT AS epoch) e WHERE budget > 0 AND budget - e.epoch * leaf_tokens > 0),
prefix AS (SELECT *, coalesce(sum(tokens) OVER (PARTITION BY domain, lang, source, epoch ORDER BY md5(concat('42:', epoch, ':', doc_id)), doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM taken)
SELECT doc_id, domain, lang, source, epoch, tokens FROM prefix WHERE ahead < remaining
"""

#: crc32 by the table of its polynomial, over the bytes of each distinct word.
_WORDS = f"""regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"""
OP11 = f"""
WITH crc AS (SELECT list(list_reduce(list_prepend(i, range(0, 8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(0, 256) r(i)),
d AS (SELECT row_number() OVER () AS n, doc_id, {_WORDS} AS words FROM documents),
g AS (SELECT {_WORDS} AS words FROM benchmark),
dw AS (SELECT n, unnest(words) AS w FROM d), gw AS (SELECT unnest(words) AS w FROM g),
h AS (SELECT w, hex(encode(w)) AS x FROM (SELECT w FROM dw UNION SELECT w FROM gw)),
b AS (SELECT w, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, length(x) // 2), lambda k: ('0x' || substr(x, 2 * k + 1, 2))::BIGINT)), lambda c, y: xor(c >> 8, t[(xor(c, y) & 255) + 1])), 4294967295::BIGINT) % 10000 AS bucket FROM h, crc),
s AS (SELECT bucket, count(*) AS s FROM dw JOIN b USING (w) GROUP BY bucket), t AS (SELECT bucket, count(*) AS t FROM gw JOIN b USING (w) GROUP BY bucket),
gain AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM dw) + 10000)::DOUBLE / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT count(*) FROM gw) + 10000)::DOUBLE)))::BIGINT AS gain FROM s FULL JOIN t USING (bucket)),
w AS (SELECT n, sum(gain)::BIGINT AS weight FROM dw JOIN b USING (w) JOIN gain USING (bucket) GROUP BY n),
scored AS (SELECT doc_id, len(words)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256(concat('2024:', doc_id)), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM d LEFT JOIN w USING (n)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS r, count(*) FILTER (n_features >= 20) OVER () * 10 // 100 AS most FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND r <= most THEN r END AS rank FROM ranked
"""

ORACLES = {"op1_url_filter": OP1, "op3_mixing": OP3, "op11_resampling": OP11}
