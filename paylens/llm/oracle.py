"""SQL counterparts, for DuckDB, of the queries that SQL can express.

The others are held to brute-force versions, exact round trips or held-out
accuracy in tests: signatures, tokenizers, parsers and learnt models have no SQL.
"""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(table: str, key: str, pattern: str) -> str:
    low = f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')"
    return f"SELECT {key}, regexp_extract_all({low}, '{pattern}') AS w FROM {table}"


_LETTERS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

DECONTAMINATION = f"""
WITH d AS ({_words('documents', 'doc_id', _LETTERS)}),
i AS ({_words('benchmark', 'item_id', _LETTERS)}),
windows AS (
    SELECT DISTINCT item_id, m, array_to_string(w[k : k + m - 1], ' ') AS win
    FROM (SELECT *, unnest(range(1, len(w) - m + 2)) AS k
          FROM (SELECT *, least(10, len(w)) AS m FROM i WHERE len(w) > 0))),
placed AS (
    SELECT doc_id, k, m, array_to_string(w[k : k + m - 1], ' ') AS win
    FROM (SELECT d.*, m, unnest(range(1, len(w) - m + 2)) AS k
          FROM d JOIN (SELECT DISTINCT m FROM windows) ON len(w) >= m)),
met AS (SELECT doc_id, k, m, item_id FROM placed JOIN windows USING (m, win)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(k, k + m)) AS p FROM met) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
    FROM (SELECT DISTINCT doc_id, item_id FROM met) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(hit.n, 0) AS BIGINT) AS n_hit,
    CAST(coalesce(named.n, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
    hit.n IS NOT NULL AS contaminated
FROM d LEFT JOIN hit ON hit.doc_id = d.doc_id LEFT JOIN named ON named.doc_id = d.doc_id"""

NEAR_DEDUP = f"""
WITH RECURSIVE d AS ({_words('documents', 'doc_id', r'[^\x20\x09-\x0D]+')}),
s AS (
    SELECT DISTINCT doc_id, CASE WHEN len(w) = 1 THEN w[1] ELSE w[k] || ' ' || w[k + 1] END AS g
    FROM (SELECT *, unnest(range(1, greatest(len(w) - 1, 1) + 1)) AS k FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n_both
    FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (
    SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
    WHERE 100 * n_both >= 80 * (x.n + y.n - n_both)),
reach AS (
    SELECT a AS node, b AS other FROM links
    UNION SELECT node, b FROM reach JOIN links ON other = a),
least AS (SELECT node, min(other) AS low FROM reach GROUP BY node)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles,
    least(d.doc_id, coalesce(low, d.doc_id)) AS component_id,
    d.doc_id = least(d.doc_id, coalesce(low, d.doc_id)) AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN least ON node = d.doc_id"""

_HOST = f"translate(coalesce(regexp_extract({{0}}, '(?s)^.*?://([^/?#]*)', 1), ''), '{_UPPER}', '{_LOWER}')"
_PATH = "coalesce(regexp_extract({0}, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '')"
_BY_LENGTH = (
    ("block", "example.org", "/en/1"), ("block", "example.org", "/es/"), ("allow", "com", "/fr/"),
    ("block", "com", "/de/"), ("allow", "org", "/"),
)


def _rule(column: int) -> str:
    """The rule (0: verdict, 1: host and path) that fits host and path."""
    cases = " ".join(
        f"WHEN (host = '{h}' OR suffix(host, '.{h}')) AND prefix(path, '{p}') THEN '{(v, h + p)[column]}'"
        for v, h, p in _BY_LENGTH
    )
    return f"CASE {cases} END"


_TAGS = "list_filter(regexp_extract_all(html, '(?is)<{0}\\b[^>]*>'), lambda t: regexp_matches(t, '(?is){1}'))[1]"
_CANONICAL = "regexp_extract(" + _TAGS.format("link", "\\brel\\s*=\\s*[\"'']?canonical\\b") + ", '(?is)\\bhref\\s*=\\s*[\"'']?([^\"''>\\s]+)', 1)"
_REFRESH = "regexp_extract(" + _TAGS.format("meta", "\\bhttp-equiv\\s*=\\s*[\"'']?refresh\\b") + ", '(?is)url\\s*=\\s*[\"'']?([^\"''>\\s]+)', 1)"

_QUERY = "coalesce(regexp_extract({0}, '(?s)^.*?://[^/?#]*[^?#]*(\\?[^#]*)', 1), '')"
_READ = "regexp_replace(html, '(?is)<!--.*?(?:-->|\\z)|<script\\b.*?(?:</script\\s*>|\\z)|<style\\b.*?(?:</style\\s*>|\\z)', '', 'g')"
_KEPT = """list_reduce(
        list_prepend(CAST([] AS VARCHAR[]), list_transform(
            string_split(path, '/')[2:] || CASE WHEN regexp_matches(path, '/\\.\\.?\\z') THEN [''] ELSE CAST([] AS VARCHAR[]) END, lambda s: [s])),
        lambda a, b: CASE WHEN b[1] = '..' THEN a[1 : greatest(len(a) - 1, 0)] WHEN b[1] = '.' THEN a ELSE a || b END)"""
_KEY = f"""host || CASE WHEN path = '' THEN '/' WHEN contains(path, '/.') THEN '/' || array_to_string({_KEPT}, '/') ELSE path END || query"""
_NAMED = "replace(replace(replace(replace(link, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&apos;', chr(39))"
_CODE = "CAST(CASE WHEN lower(r)[1:3] = '&#x' THEN '0x' || regexp_extract(r, '([0-9a-fA-F]+);', 1) ELSE regexp_extract(r, '([0-9]+);', 1) END AS INTEGER)"
_UNESCAPED = f"""regexp_replace(list_reduce(
        list_prepend({_NAMED}, regexp_extract_all({_NAMED}, '&#(?:0*[0-9]{{1,3}}|[xX]0*[0-9a-fA-F]{{1,2}});')),
        lambda t, r: CASE WHEN {_CODE} BETWEEN 1 AND 127 AND {_CODE} <> 38 THEN replace(t, r, chr({_CODE})) ELSE t END),
    '&(?:amp|#0*38|#[xX]0*26);', '&', 'g')"""

URL_FILTER = f"""
WITH RECURSIVE p AS (
    SELECT page_id, {_READ} AS html, {_HOST.format('url')} AS host, {_PATH.format('url')} AS path, {_QUERY.format('url')} AS query
    FROM pages),
keyed AS (SELECT *, CASE WHEN host <> '' THEN {_KEY} END AS key FROM p),
found AS (
    SELECT key, host, path, unnest([{_CANONICAL}, {_REFRESH}]) AS link FROM keyed WHERE host <> ''),
linked AS (SELECT key, host, path, trim({_UNESCAPED}, ' ') AS link FROM found WHERE link <> ''),
targets AS (
    SELECT key AS a, CASE WHEN regexp_matches(link, '^[a-zA-Z][a-zA-Z0-9+.-]*://') THEN link
        WHEN regexp_matches(link, '^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN NULL
        WHEN prefix(link, '//') THEN 'x:' || link
        WHEN prefix(link, '/') THEN 'x://' || host || link
        WHEN prefix(link, '?') THEN 'x://' || host || path || link
        ELSE 'x://' || host || coalesce(nullif(regexp_extract(path, '(?s)^.*/'), ''), '/') || link END AS url
    FROM linked WHERE link <> '' AND NOT prefix(link, '#')),
ends AS (SELECT a, {_HOST.format('url')} AS host, {_PATH.format('url')} AS path, {_QUERY.format('url')} AS query FROM targets),
edges AS (SELECT a, {_KEY} AS b FROM ends WHERE host <> ''),
both_ways AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
reach AS (SELECT a AS node, b AS other FROM both_ways
    UNION SELECT node, b FROM reach JOIN both_ways ON other = a),
told AS (
    SELECT node, {_rule(0)} AS verdict
    FROM (SELECT node, split_part(other, '/', 1) AS host, regexp_extract(other, '(?s)^[^/]*(/[^?]*)', 1) AS path FROM reach)),
classes AS (SELECT node, bool_or(verdict = 'allow') AS allowed, bool_or(verdict = 'block') AS blocked FROM told GROUP BY node)
SELECT page_id, host, path, {_rule(1)} AS rule,
    coalesce({_rule(0)}, CASE WHEN allowed THEN 'allow' WHEN blocked THEN 'block' ELSE 'allow' END) AS verdict
FROM keyed LEFT JOIN classes ON node = key"""

#: One row: the 256 remainders of CRC-32, by its rule.
_CRC_TABLE = """
    SELECT list(r ORDER BY i) AS remainders FROM (
        SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b:
            CASE WHEN a & 1 = 1 THEN xor(a >> 1, CAST(3988292384 AS BIGINT)) ELSE a >> 1 END) AS r
        FROM (SELECT unnest(range(256)) AS i))"""


def _crc32(text: str) -> str:
    """CRC-32 of the UTF-8 of a text, where ``remainders`` is in scope."""
    digits = f"hex(encode({text}))"
    octets = f"list_transform(range(0, CAST(length({digits}) / 2 AS BIGINT)), lambda k: CAST('0x' || substr({digits}, 2 * k + 1, 2) AS BIGINT))"
    step = "lambda a, b: xor(remainders[(xor(a, b) & 255) + 1], a >> 8)"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {octets}), {step}), CAST(4294967295 AS BIGINT))"


CONVERSATION_TRIE = f"""
WITH crc AS ({_CRC_TABLE}),
t AS (
    SELECT conv_id, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS token,
        len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS words, turn
    FROM conversations WHERE conv_id IS NOT NULL),
own AS (
    SELECT conv_id, list({{'token': token, 'words': words}} ORDER BY turn NULLS FIRST, token) AS l FROM t GROUP BY conv_id),
rebuilt AS (
    SELECT o.conv_id, coalesce(b.l, [])[1 : h] || o.l[h + 1 :] AS l
    FROM (SELECT own.*, {_crc32('CAST(conv_id AS VARCHAR)')} % 4 AS h FROM own, crc) o
    LEFT JOIN own b ON b.conv_id = o.conv_id - o.conv_id % 20),
path AS (
    SELECT conv_id, depth, len(l) AS whole, list_transform(l[1 : depth], lambda x: x.token) AS node,
        CASE WHEN depth = 0 THEN 0 ELSE l[depth].words END AS words
    FROM (SELECT *, unnest(range(0, len(l) + 1)) AS depth FROM rebuilt)),
node AS (
    SELECT node, any_value(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words,
        sha256(coalesce(string_agg(CASE WHEN depth = whole THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id), '')) AS ends
    FROM path GROUP BY node),
child AS (SELECT node[1 : depth - 1] AS node, count(*) AS n FROM node WHERE depth > 0 GROUP BY 1),
known AS (SELECT node.*, coalesce(child.n, 0) AS n_children FROM node LEFT JOIN child USING (node)),
under AS (
    SELECT node[1 : k] AS node, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS leaves, sum((n_convs - 1) * words) AS saved
    FROM (SELECT *, unnest(range(0, depth + 1)) AS k FROM known) GROUP BY 1)
SELECT k.conv_id, CAST(k.depth AS BIGINT) AS depth, above.conv_id AS parent_conv_id, k.n_convs, CAST(k.n_children AS BIGINT) AS n_children,
    CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, k.ends AS ends_sha256
FROM known k JOIN under USING (node) LEFT JOIN known above ON k.depth > 0 AND above.node = k.node[1 : k.depth - 1]"""

EXACT_TOP_K = """
WITH v AS (
    SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS z
    FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
met AS (
    SELECT q.r, q.vec_id AS query_id, c.vec_id,
        CAST(list_sum(list_transform(list_zip(q.z, c.z), lambda p: p[1] * p[2])) AS BIGINT) AS score
    FROM v q JOIN v c ON q.r <> c.r AND len(q.z) = len(c.z) WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST) AS INTEGER) AS rank, vec_id, score
FROM met QUALIFY row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST) <= 10"""

SPELLING_VARIANTS = f"""
WITH RECURSIVE crc AS ({_CRC_TABLE}),
run AS (
    SELECT doc_id, run, count(*) AS n
    FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[a-z\\x{{C0}}-\\x{{FF}}]+')) AS run FROM documents)
    GROUP BY doc_id, run),
hashed AS (
    SELECT run, n, {_crc32("coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run")} AS h FROM run, crc WHERE len(run) >= 7),
made AS (
    SELECT CASE WHEN h % 31 = 0 THEN left(run, h % len(run)) || substr(run, h % len(run) + 2) ELSE run END AS word, n FROM hashed),
v AS (
    SELECT word, CAST(sum(n) AS BIGINT) AS n FROM made WHERE len(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
cut AS (
    SELECT word, p, left(word, p - 1) || substr(word, p + 1) AS rest FROM (SELECT word, unnest(range(1, len(word) + 1)) AS p FROM v)),
near AS (
    SELECT word, rest AS other FROM cut SEMI JOIN v ON v.word = cut.rest
    UNION SELECT rest, word FROM cut SEMI JOIN v ON v.word = cut.rest
    UNION SELECT a.word, b.word FROM cut a JOIN cut b ON a.p = b.p AND a.rest = b.rest AND a.word <> b.word),
best AS (
    SELECT near.word, count(*) OVER (PARTITION BY near.word) AS n_near, other AS form, v.n AS form_n
    FROM near JOIN v ON v.word = other
    QUALIFY row_number() OVER (PARTITION BY near.word ORDER BY v.n DESC, other) = 1),
formed AS (
    SELECT v.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 10 * n THEN form END AS form,
        CASE WHEN form_n >= 10 * n THEN form_n END AS form_n
    FROM v LEFT JOIN best USING (word)),
chain AS (
    SELECT word, word AS root, 0 AS steps FROM formed
    UNION ALL SELECT chain.word, formed.form, steps + 1 FROM chain JOIN formed ON formed.word = chain.root WHERE formed.form IS NOT NULL)
SELECT word, form, max_by(root, steps) AS root, any_value(n) AS n, CAST(any_value(n_near) AS BIGINT) AS n_near, any_value(form_n) AS form_n
FROM chain JOIN formed USING (word) GROUP BY word, form"""

ORACLES: dict[str, str] = {
    "op2_decontamination": DECONTAMINATION,
    "op3_near_dedup": NEAR_DEDUP,
    "op5_url_filter": URL_FILTER,
    "op11_conversation_trie": CONVERSATION_TRIE,
    "op12_exact_top_k": EXACT_TOP_K,
    "op13_spelling_variants": SPELLING_VARIANTS,
}
