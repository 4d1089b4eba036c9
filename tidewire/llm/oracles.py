"""The queries of this subpackage in DuckDB SQL, written from their contracts."""

from __future__ import annotations

from tidewire.llm import quality_rules as rules

BLANK = r"[\x20\x09-\x0D]+"
WORDS = rf"list_filter(regexp_split_to_array(coalesce(text, ''), '{BLANK}'), lambda w: w <> '')"

SUFFIX_DEDUP = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
spots AS (SELECT doc_id, h, unnest(generate_series(0, length(h) // 2 - 50)) AS p FROM d WHERE length(h) >= 100),
least AS (SELECT substr(h, 2 * p + 1, 100) AS s, min(doc_id) AS m FROM spots GROUP BY ALL),
bad AS (SELECT a.doc_id, a.p FROM spots a JOIN least ON substr(a.h, 2 * a.p + 1, 100) = s AND m < a.doc_id),
runs AS (SELECT *, p - coalesce(lag(p) OVER (PARTITION BY doc_id ORDER BY p), -1000) > 50 AS fresh FROM bad),
numbered AS (SELECT *, sum(fresh::int) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM runs),
spans AS (SELECT doc_id, run, min(p) AS a, max(p) + 50 AS b FROM numbered GROUP BY ALL),
cuts AS (SELECT doc_id, list(a ORDER BY a) AS s, list(b ORDER BY a) AS e, sum(b - a) AS gone, count(*) AS n FROM spans GROUP BY ALL)
SELECT d.doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(n, 0)::BIGINT AS n_spans,
  sha256(unhex(CASE WHEN n IS NULL THEN h ELSE array_to_string(list_transform(generate_series(1, n + 1),
    lambda i: substr(h, 2 * CASE WHEN i = 1 THEN 0 ELSE e[i - 1] END + 1, 2 * (CASE WHEN i > n THEN length(h) // 2 ELSE s[i] END - CASE WHEN i = 1 THEN 0 ELSE e[i - 1] END))), '') END)) AS kept_sha256
FROM d LEFT JOIN cuts USING (doc_id)
"""

SUBSTRING_DEDUP = f"""
WITH d AS (SELECT doc_id, {WORDS} AS ws FROM documents),
spots AS (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 49)) AS p FROM d WHERE len(ws) >= 50),
win AS (SELECT doc_id, p, md5(array_to_string(ws[p:p + 49], ' ')) AS s FROM spots),
least AS (SELECT s, min(doc_id) AS m FROM win GROUP BY ALL),
bad AS (SELECT DISTINCT doc_id, unnest(generate_series(p, p + 49)) AS p FROM win JOIN least USING (s) WHERE m < doc_id),
gone AS (SELECT doc_id, list(p ORDER BY p) AS g, count(*) AS n FROM bad GROUP BY ALL),
kept AS (SELECT d.doc_id, string_agg(w, ' ' ORDER BY i) AS k FROM (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM d) d ANTI JOIN bad ON d.doc_id = bad.doc_id AND d.i = bad.p GROUP BY ALL)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(k, '')) AS kept_sha256
FROM d LEFT JOIN gone USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

JACCARD_JOIN = f"""
WITH RECURSIVE d AS (SELECT doc_id, {WORDS.replace("coalesce(text, '')", "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(ws[p:p + 4], ' ')) AS t FROM (SELECT doc_id, ws, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [1] ELSE generate_series(1, len(ws) - 4) END) AS p FROM d)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY ALL),
links AS (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.t = y.t AND x.doc_id <> y.doc_id GROUP BY ALL) JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b
  WHERE 100 * c >= 80 * (na.n + nb.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, m AS component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS m FROM reach GROUP BY ALL) USING (doc_id)
"""

_ITEM_WORDS = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"

DECONTAMINATION = f"""
WITH b AS (SELECT item_id, {_ITEM_WORDS} AS ws FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(10, len(ws)) AS n, array_to_string(ws[p:p + least(10, len(ws)) - 1], ' ') AS s FROM (SELECT *, unnest(generate_series(1, len(ws) - least(10, len(ws)) + 1)) AS p FROM b WHERE len(ws) > 0)),
d AS (SELECT doc_id, {_ITEM_WORDS} AS ws FROM documents),
spots AS (SELECT doc_id, ws, n, unnest(generate_series(1, len(ws) - n + 1)) AS p FROM d, (SELECT DISTINCT n FROM bw) WHERE len(ws) >= n),
hit AS (SELECT doc_id, p, n, item_id FROM (SELECT doc_id, p, n, array_to_string(ws[p:p + n - 1], ' ') AS s FROM spots) JOIN bw USING (n, s)),
covered AS (SELECT doc_id, count(DISTINCT w) AS n_hit FROM (SELECT doc_id, unnest(generate_series(p, p + n - 1)) AS w FROM hit) GROUP BY ALL),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM hit WHERE item_id IS NOT NULL) GROUP BY ALL)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def _quality() -> str:
    bins = ", ".join(f"'{w}'" for w in rules.BINS)
    names = list(rules.CLASSES)
    steps, left = [], "t"
    for name in names:
        pattern = rules.CLASSES[name].replace("'", "''")
        steps.append(f"regexp_replace({left}, '{pattern}', '', 'g') AS no_{name}")
        left = f"no_{name}"
    before = ["t", *[f"no_{n}" for n in names]]
    sizes = [f"length({a}) - length({b})" for a, b in zip(before, before[1:], strict=False)] + [f"length({before[-1]})"]
    commons = ", ".join(f"len(list_filter(hits, lambda w: w = '{w}'))" for w in rules.BINS)
    langs = ", ".join(f"'{x}'" for x in rules.LANGUAGES)
    sums = lambda c, n: "[" + ", ".join(f"sum({c}[{k + 1}])" for k in range(n)) + "]"

    def distance(own: str, ref: str) -> str:
        part = "CASE WHEN {0} > 0 THEN {0} * ln({0} / (({1} + {2}) / 2)) ELSE 0 END"
        x, y = f"({own}[i] / list_sum({own})::DOUBLE)", f"({ref}[i] / list_sum({ref})::DOUBLE)"
        return f"CASE WHEN list_sum({own}) > 0 AND list_sum({ref}) > 0 THEN sqrt(greatest(0, list_sum(list_transform(range(1, len({own}) + 1), lambda i: {part.format(x, x, y)} + {part.format(y, x, y)})) / (2 * ln(2)))) END"

    return f"""
WITH a AS (SELECT doc_id, lang, coalesce(text, '') AS t, {WORDS} AS ws FROM documents),
b AS (SELECT *, {', '.join(steps)}, list_filter(ws, lambda w: w IN ({bins})) AS hits, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM a),
w AS (SELECT doc_id, p, ws[p:p + 2] AS s FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 2)) AS p FROM a WHERE len(ws) > 2)),
twice AS (SELECT doc_id, s FROM w GROUP BY ALL HAVING count(*) > 1),
again AS (SELECT doc_id, count(DISTINCT i) AS n FROM (SELECT doc_id, unnest([p, p + 1, p + 2]) AS i FROM w JOIN twice USING (doc_id, s)) GROUP BY ALL),
m AS (SELECT doc_id, lang, len(ws)::BIGINT AS n_words, [{', '.join(sizes)}] AS chars, [{commons}, len(ws) - len(hits)] AS commons,
  (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words FROM b LEFT JOIN again USING (doc_id)),
r AS (SELECT lang AS l, {sums('chars', len(names) + 1)} AS rc, {sums('commons', len(rules.BINS) + 1)} AS rw FROM m WHERE lang IN ({langs}) GROUP BY lang),
x AS (SELECT doc_id, min({distance('chars', 'rc')}) AS dc, min({distance('commons', 'rw')}) AS dw FROM m JOIN r ON m.lang IS NULL OR m.lang = r.l GROUP BY ALL),
v AS (SELECT m.*, list_sum(chars) - chars[{names.index('space') + 1}] AS wc, n_words < {rules.MIN_WORDS} OR 100 * n_repeat_words > {rules.MAX_REPEAT_PERCENT} * n_words AS base_failed, dc, dw FROM m LEFT JOIN x USING (doc_id))
SELECT doc_id, n_words, wc::BIGINT AS word_chars, chars[{names.index('symbol') + 1}]::BIGINT AS n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND (wc < {rules.CHAR_GUARD} OR coalesce(dc <= {rules.MAX_CHAR_DISTANCE}, true)) AND (n_words < {rules.WORD_GUARD} OR coalesce(dw <= {rules.MAX_WORD_DISTANCE}, true)) AS kept
FROM v
"""


URL_RULES = r"""
WITH p AS (SELECT page_id, url, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
u AS (SELECT DISTINCT url, list_distinct(list_concat(
    list_transform(string_split(host, '.'), lambda w: 'label:' || w),
    list_transform(generate_series(1, len(string_split(host, '.'))), lambda i: 'host:' || array_to_string(string_split(host, '.')[i:], '.')),
    list_transform(list_filter(regexp_split_to_array(path, '[^\p{L}]+'), lambda w: w <> ''), lambda w: 'path:' || lower(w)))) AS tokens FROM p WHERE host <> ''),
s AS (SELECT url, array_to_string(list_sort(list_filter(tokens, lambda t, i: (mask >> (i - 1)) & 1 = 1)), ' ') AS items FROM (SELECT url, tokens, unnest(generate_series(1, (1 << len(tokens)) - 1)) AS mask FROM u)),
taught AS (SELECT p.url, l.quality = 0 OR l.toxic = 1 AS bad FROM p JOIN labels l ON l.doc_id = p.page_id WHERE p.host <> '' AND (l.quality = 0 OR l.toxic = 1) IS NOT NULL),
counted AS (SELECT items, count(*) AS n, count_if(bad) AS n_bad FROM taught JOIN s USING (url) GROUP BY ALL),
rules AS (SELECT items FROM counted WHERE n_bad >= ceil(0.002 * (SELECT count(*) FROM taught)) AND n_bad > 0 AND n_bad / n >= 0.5),
mined AS (SELECT DISTINCT url FROM s JOIN rules USING (items)),
g AS (SELECT * FROM (VALUES ('example.net/en/', 'example.net', '/en/', 'allow', 1), ('example.com/de/', 'example.com', '/de/', 'block', 1), ('org/fr/', 'org', '/fr/', 'allow', 2), ('net/', 'net', '/', 'block', 3)) t(rule, rule_host, rule_path, rule_verdict, o)),
f AS (SELECT page_id, url, arg_min(rule, o) AS rule, arg_min(rule_verdict, o) AS rule_verdict FROM p JOIN g ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY ALL)
SELECT p.page_id, host, path, rule, coalesce(rule_verdict, CASE WHEN mined.url IS NULL THEN 'allow' ELSE 'block' END) AS verdict
FROM p LEFT JOIN f ON p.page_id = f.page_id AND p.url = f.url LEFT JOIN mined ON mined.url = p.url
"""

SHARDS = """
WITH steps AS (SELECT list(v ORDER BY b) AS crc FROM (SELECT b, list_reduce(list_concat([b], generate_series(1, 8)), lambda a, _: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS v FROM (SELECT unnest(generate_series(0, 255))::BIGINT AS b))),
d AS (SELECT doc_id, source, octet_length(encode(coalesce(text, '')))::BIGINT + 1 AS size, hex(encode(coalesce(text, ''))) AS h FROM documents),
c AS (SELECT doc_id, source, size, xor(list_reduce(list_concat([4294967295], list_transform(generate_series(1, size - 1), lambda i: ('0x' || substr(h, 2 * i - 1, 2))::BIGINT)), lambda a, x: xor(a >> 8, crc[(xor(a, x) & 255) + 1])), 4294967295)::BIGINT AS text_crc32 FROM d, steps),
k AS (SELECT *, md5('0:' || coalesce(doc_id::VARCHAR, 'null')) AS mixed FROM c),
r AS (SELECT *, (2 * row_number() OVER (PARTITION BY source ORDER BY mixed, size, text_crc32) - 1) / (2 * count(*) OVER (PARTITION BY source)) AS share FROM k),
p AS (SELECT *, row_number() OVER (ORDER BY share, mixed, source NULLS FIRST, size, text_crc32) - 1 AS pos, count(*) OVER () AS total FROM r)
SELECT doc_id, size, text_crc32, 'rows' AS law, (pos * 16 // total)::INT AS shard, (pos - ((pos * 16 // total) * total + 15) // 16)::BIGINT AS slot, NULL::INT AS grown_shard FROM p
"""

CHAT_FORMAT = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]'))),
e AS (SELECT *, length(text) + len(regexp_extract_all(text, '<\\*/?s>|\[\\*/?(?:INST|ROLE)\]')) AS n, length(role) + len(regexp_extract_all(role, '<\\*/?s>|\[\\*/?(?:INST|ROLE)\]')) AS n_role FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(CASE role WHEN 'user' THEN n + 18 WHEN 'assistant' THEN n + 6 ELSE n + n_role + 22 END)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""

SPELLING_VARIANTS = r"""
WITH RECURSIVE steps AS (SELECT list(v ORDER BY b) AS crc FROM (SELECT b, list_reduce(list_concat([b], generate_series(1, 8)), lambda a, _: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS v FROM (SELECT unnest(generate_series(0, 255))::BIGINT AS b))),
runs AS (SELECT doc_id, run, count(*) AS c FROM (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{00C0}-\x{00FF}]+')) AS run FROM documents) GROUP BY ALL),
h AS (SELECT run, c, hex(encode(coalesce(doc_id::VARCHAR, 'null') || ':' || run)) AS h FROM runs WHERE length(run) >= 7),
m AS (SELECT run, c, xor(list_reduce(list_concat([4294967295], list_transform(generate_series(1, length(h) // 2), lambda i: ('0x' || substr(h, 2 * i - 1, 2))::BIGINT)), lambda a, x: xor(a >> 8, crc[(xor(a, x) & 255) + 1])), 4294967295) AS mark FROM h, steps),
w AS (SELECT CASE WHEN mark % 31 = 0 THEN substr(run, 1, (mark % length(run))::INT) || substr(run, (mark % length(run))::INT + 2) ELSE run END AS word, c FROM m),
v AS MATERIALIZED (SELECT word, sum(c)::BIGINT AS n FROM w WHERE length(word) >= 7 GROUP BY word HAVING sum(c) >= 2),
cuts AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS d FROM (SELECT word, n, unnest(generate_series(1, length(word))) AS i FROM v)),
less AS (SELECT DISTINCT c.word AS a, v.word AS b FROM cuts c JOIN v ON c.d = v.word),
pairs AS (SELECT a, b FROM less UNION ALL SELECT b, a FROM less UNION ALL SELECT x.word, y.word FROM cuts x JOIN cuts y ON x.d = y.d AND x.i = y.i AND x.word <> y.word),
best AS (SELECT a, count(*) AS n_near, min({'m': -n, 'w': b}) AS m FROM pairs JOIN v ON v.word = b GROUP BY a),
forms AS MATERIALIZED (SELECT word, n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN -m.m >= 10 * n THEN m.w END AS form, CASE WHEN -m.m >= 10 * n THEN -m.m END AS form_n FROM v LEFT JOIN best ON a = word),
walk AS (SELECT word, word AS here FROM forms UNION ALL SELECT walk.word, form FROM walk JOIN forms ON forms.word = here WHERE form IS NOT NULL),
ends AS (SELECT walk.word, here AS root FROM walk JOIN forms ON forms.word = here WHERE form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN ends USING (word)
"""


def _vector_codes(rounds: int = 2) -> str:
    """Two rounds of nearest entries and floored means, then the codes."""
    nearest = "SELECT x.vec, x.part, arg_min({'e': e.entry, 'd': d}, {'d': d, 'e': e.entry}) AS own FROM (SELECT x.vec, x.part, e.entry, list_sum(list_transform(range(1, len(x.p) + 1), lambda i: (x.p[i] - e.p[i]) * (x.p[i] - e.p[i])))::BIGINT AS d FROM parts x JOIN b%d e USING (part)) e JOIN parts x USING (vec, part) GROUP BY ALL"
    steps = []
    for k in range(rounds + 1):
        steps.append(f"a{k} AS MATERIALIZED ({nearest % k})")
        if k < rounds:
            steps.append(
                f"m{k} AS (SELECT part, entry, list((s - ((s % n) + n) % n) // n ORDER BY i) AS p FROM (SELECT part, own.e AS entry, i, sum(p[i])::BIGINT AS s, count(*) AS n FROM a{k} JOIN parts USING (vec, part), (SELECT unnest(range(1, (SELECT max(len(p)) FROM parts) + 1)) AS i) GROUP BY ALL) GROUP BY ALL),\n"
                f"b{k + 1} AS MATERIALIZED (SELECT part, entry, coalesce(m.p, b.p) AS p FROM b{k} b LEFT JOIN m{k} m USING (part, entry))"
            )
    joined = ",\n".join(steps)
    return f"""
WITH kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)::BIGINT) AS q, row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) - 1 AS vec
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT vec, part, q[part * (len(q) // 16) + 1 : (part + 1) * (len(q) // 16)] AS p FROM kept, (SELECT unnest(range(16)) AS part)),
b0 AS (SELECT part, vec AS entry, p FROM parts WHERE vec < 64),
{joined},
books AS (SELECT sha256(string_agg(array_to_string(p, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{rounds}),
codes AS (SELECT vec, string_agg(printf('%02x', own.e), '' ORDER BY part) AS code, sum(own.d)::BIGINT AS error FROM a{rounds} GROUP BY vec)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM kept JOIN codes USING (vec), books
"""


ORACLES = {
    "op2_suffix_dedup": SUFFIX_DEDUP,
    "op4_quality_rules": _quality(),
    "op5_jaccard_join": JACCARD_JOIN,
    "op6_substring_dedup": SUBSTRING_DEDUP,
    "op7_url_rules": URL_RULES,
    "op9_decontamination": DECONTAMINATION,
    "op10_interleaved_shards": SHARDS,
    "op11_vector_codes": _vector_codes(),
    "op12_spelling_variants": SPELLING_VARIANTS,
    "op13_chat_format": CHAT_FORMAT,
}
