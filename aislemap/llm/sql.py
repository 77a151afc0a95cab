"""DuckDB twins of the queries, where SQL can say them."""

_SPACES = r"[\x20\x09-\x0D]"
_TERMS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

EXACT_DEDUP = f"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '{_SPACES}', '', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER w = 1 AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id NULLS LAST)
"""


def sharding(shards: int, seed: str) -> str:
    return f"""
WITH d AS (
  SELECT doc_id, source, octet_length(encode(coalesce(text, ''))) + 16 AS size, coalesce(text, '') AS text,
         (('0x' || substr(md5('{seed}|' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT) * 4 AS h
  FROM documents
),
crc AS (
  SELECT *, xor(4294967295, list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: ('0x' || x)::BIGINT)),
    lambda acc, b: list_reduce([xor(acc, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: xor(c >> 1, 3988292384 * (c & 1))))) AS text_crc32
  FROM d
),
r AS (
  SELECT *, (row_number() OVER (PARTITION BY source ORDER BY h, doc_id) - 1 + 0.5::DOUBLE) / (count(*) OVER (PARTITION BY source))::DOUBLE AS part FROM crc
),
g AS (SELECT *, row_number() OVER (ORDER BY part, source NULLS LAST, h, doc_id) - 1 AS place, count(*) OVER () AS n FROM r)
SELECT doc_id, size, text_crc32, 'rows' AS law, ((place * {shards}) // n)::INTEGER AS shard,
       (place - (((place * {shards}) // n) * n + {shards - 1}) // {shards})::BIGINT AS slot, NULL::INTEGER AS grown_shard
FROM g
"""


def license_scan(base, notices, near: int, coverage: float) -> str:
    rows = ", ".join(f"({i}, '{text}', '{label}', {exact})" for i, (text, label, exact) in enumerate([(*b, True) for b in base] + [(*n, False) for n in notices]))
    return f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOW}, '{_TERMS}') AS w FROM documents),
t AS (SELECT template, label, exact, len(w) - 2 AS grams, w FROM (SELECT *, string_split(words, ' ') AS w FROM (VALUES {rows}) v(template, words, label, exact))),
tg AS (SELECT template, label, exact, grams, slot, w[slot + 1] || ' ' || w[slot + 2] || ' ' || w[slot + 3] AS run FROM (SELECT *, unnest(range(len(w) - 2)) AS slot FROM t)),
dg AS (SELECT doc_id, pos, w[pos + 1] || ' ' || w[pos + 2] || ' ' || w[pos + 3] AS run FROM (SELECT *, unnest(range(len(w) - 2)) AS pos FROM d)),
hit AS (SELECT doc_id, template, label, exact, grams, pos, slot, pos - slot AS diagonal FROM dg JOIN tg USING (run)),
exact_span AS (SELECT doc_id, label, true AS exact, diagonal AS first, 1.0::DOUBLE AS coverage FROM hit WHERE exact GROUP BY doc_id, template, label, grams, diagonal HAVING count(*) = grams),
gap AS (SELECT *, diagonal - lag(diagonal) OVER (PARTITION BY doc_id, template ORDER BY diagonal, pos, slot) AS gap FROM hit WHERE NOT exact),
grp AS (SELECT *, sum(CASE WHEN gap <= {near} THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, template ORDER BY diagonal, pos, slot ROWS UNBOUNDED PRECEDING) AS grp FROM gap),
loose_span AS (SELECT doc_id, label, false AS exact, NULL AS first, count(DISTINCT slot)::DOUBLE / any_value(grams)::DOUBLE AS coverage FROM grp GROUP BY doc_id, template, label, grp
  HAVING count(DISTINCT slot)::DOUBLE / any_value(grams)::DOUBLE >= {coverage}),
span AS (SELECT * FROM exact_span UNION ALL SELECT * FROM loose_span),
per AS (SELECT doc_id, count(first) AS n_base, min(first) AS first_word, max(first) AS last_word,
  array_to_string(list_sort(list(DISTINCT label) FILTER (exact)), ',') AS base_labels, array_to_string(list_sort(list(DISTINCT label)), ',') AS labels, max(coverage) AS score
  FROM span GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
FROM d LEFT JOIN per USING (doc_id)
"""


def decontamination(window: int) -> str:
    return f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOW}, '{_TERMS}') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all({_LOW}, '{_TERMS}') AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(len(w), {window}) AS size, array_to_string(w[place + 1 : place + least(len(w), {window})], ' ') AS run
  FROM (SELECT *, unnest(range(greatest(len(w) - {window}, 0) + 1)) AS place FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM iw),
dw AS (SELECT doc_id, size, place, array_to_string(w[place + 1 : place + size], ' ') AS run
  FROM (SELECT doc_id, w, size, unnest(range(len(w) - size + 1)) AS place FROM d, sizes WHERE len(w) >= size)),
hit AS (SELECT doc_id, place, size, item_id FROM dw JOIN iw USING (size, run)),
words AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, place + unnest(range(size)) FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, sha256(string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR)) AS items_sha256 FROM hit GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def _crc32(text: str) -> str:
    return f"""xor(4294967295, list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: ('0x' || x)::BIGINT)),
    lambda acc, b: list_reduce([xor(acc, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: xor(c >> 1, 3988292384 * (c & 1)))))"""


CONVERSATION_TRIE = f"""
WITH s AS (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL),
t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, r, left(x, 64), sha256(octet_length(encode(r)) || ':' || r || x)) AS pos FROM s),
c AS (SELECT *, {_crc32("conv_id::VARCHAR")} % 9 AS h FROM (SELECT DISTINCT conv_id, conv_id - conv_id % 5 AS head FROM s)),
hl AS (SELECT c.conv_id, c.head, c.h, count(t.pos) AS nh FROM c LEFT JOIN t ON t.conv_id = c.head AND t.pos <= c.h GROUP BY ALL),
b AS (SELECT hl.conv_id, t.pos, r, x FROM hl JOIN t ON t.conv_id = hl.head AND t.pos <= hl.h
  UNION ALL SELECT hl.conv_id, t.pos - hl.h + hl.nh, r, x FROM hl JOIN t ON t.conv_id = hl.conv_id AND t.pos > hl.h),
size AS (SELECT c.conv_id, count(b.pos) AS len FROM c LEFT JOIN b USING (conv_id) GROUP BY 1),
p AS (SELECT conv_id, pos AS depth, octet_length(encode(x)) AS bytes,
    sha256(string_agg(octet_length(encode(r)) || ':' || octet_length(encode(x)) || ':' || r || x, '') OVER (PARTITION BY conv_id ORDER BY pos)) AS path FROM b
  UNION ALL SELECT conv_id, 0, 0, '' FROM c),
v AS (SELECT *, min(conv_id) OVER (PARTITION BY depth, path) AS node FROM p),
n AS (SELECT node, depth, count(*) AS n_convs, any_value(bytes) AS bytes FROM v GROUP BY 1, 2),
np AS (SELECT n.*, q.node AS parent FROM n LEFT JOIN v q ON q.conv_id = n.node AND q.depth = n.depth - 1),
kids AS (SELECT parent AS node, depth - 1 AS depth, count(*) AS kids FROM np WHERE depth > 0 GROUP BY 1, 2),
nk AS (SELECT np.*, coalesce(kids, 0) AS kids FROM np LEFT JOIN kids USING (node, depth)),
sub AS (SELECT q.node, q.depth, sum((nk.n_convs - 1) * nk.bytes) AS saved, count(*) FILTER (nk.kids = 0) AS leaves
  FROM nk JOIN v q ON q.conv_id = nk.node AND q.depth <= nk.depth GROUP BY 1, 2),
ends AS (SELECT node, depth, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS ends FROM v JOIN size USING (conv_id) WHERE depth = len GROUP BY 1, 2)
SELECT node AS conv_id, depth, parent AS parent_conv_id, n_convs, kids AS n_children, leaves AS n_leaves, saved::BIGINT AS saved_tokens, coalesce(ends, sha256('')) AS ends_sha256
FROM nk JOIN sub USING (node, depth) LEFT JOIN ends USING (node, depth)
"""


def collocations(longest: int, least: int, best: int, percent: int) -> str:
    return rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOW}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
total AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY 1),
g AS (SELECT lang, k, w[i : i + k - 1] AS g FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, range(1, {longest + 1}) r(k) WHERE len(w) >= k)),
f AS (SELECT lang, k, g, count(*) AS n FROM g GROUP BY ALL HAVING count(*) >= {least}),
longer AS (SELECT lang, g, max(n) AS n FROM (SELECT lang, unnest([g[2:], g[:-2]]) AS g, n FROM f WHERE k >= 3) GROUP BY 1, 2),
kept AS (SELECT f.* FROM f LEFT JOIN longer USING (lang, g) WHERE f.k >= 2 AND (longer.n IS NULL OR 100 * longer.n < {percent} * f.n)),
cut AS (SELECT *, unnest(range(1, k)) AS c FROM kept),
scored AS (SELECT cut.lang, cut.g, cut.n AS a, c, x.n AS l, y.n AS r, total.n, ((1000::HUGEINT * cut.n * total.n) // (x.n::HUGEINT * y.n))::BIGINT AS score
  FROM cut JOIN f x ON x.lang = cut.lang AND x.g = cut.g[:c] JOIN f y ON y.lang = cut.lang AND y.g = cut.g[c + 1:] JOIN total ON total.lang = cut.lang),
weakest AS (SELECT *, row_number() OVER (PARTITION BY lang, g ORDER BY score, c) AS place FROM scored),
spelt AS (SELECT *, array_to_string(g, ' ') AS phrase FROM weakest WHERE place = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM spelt)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= {best}
"""
