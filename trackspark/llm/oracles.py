"""DuckDB forms of the queries that SQL can express."""

from __future__ import annotations

from .common import UPPER
from .quality_rules import SIGNALS
from .secret_scan import RULES

SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def lower_ascii(text: str) -> str:
    return f"translate({text}, '{UPPER}', '{UPPER.lower()}')"


OP10 = f"""
WITH d AS (SELECT doc_id, {lower_ascii("coalesce(text, '')")} AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
  doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256 FROM d
"""


def op3(fence: float = 3.0, prior_rows: int = 100) -> str:
    duck = {s: (e.replace(" div ", " // ").replace("1L", "1").replace("__upper", "n_upper").replace("__lines", "n_lines"), two, n) for s, (e, two, n) in SIGNALS.items()}
    signals = " UNION ALL ".join(f"SELECT rid, lang, source, '{s}' AS signal, {n} AS least, {two} AS two, {e} AS v FROM counts WHERE NOT base_failed" for s, (e, two, n) in duck.items())
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '{WORD}') AS ws, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
tri AS (SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS t FROM w, unnest(range(1, len(ws) - 1)) u(i)),
dup AS (SELECT rid, i FROM tri QUALIFY count(*) OVER (PARTITION BY rid, t) > 1),
cov AS (SELECT rid, CAST(sum(n) AS BIGINT) AS n_repeat_words FROM (SELECT rid, least(3, coalesce(lead(i) OVER (PARTITION BY rid ORDER BY i) - i, 3)) AS n FROM dup) GROUP BY rid),
base AS (SELECT rid, doc_id, lang, source, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper, len(ls) AS n_lines,
  CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words FROM w LEFT JOIN cov USING (rid)),
counts AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base),
vals AS ({signals}),
sk AS (SELECT lang, source, signal, least, two, (v >> greatest(length(bin(v)) - 7, 0)) << greatest(length(bin(v)) - 7, 0) AS b, count(*) AS n FROM vals GROUP BY ALL),
lv AS (SELECT 2 AS lev, lang, source, signal, least, two, b, n FROM sk UNION ALL SELECT 1, lang, NULL, signal, least, two, b, sum(n) FROM sk GROUP BY ALL UNION ALL SELECT 0, NULL, NULL, signal, least, two, b, sum(n) FROM sk GROUP BY ALL),
cum AS (SELECT *, sum(n) OVER (PARTITION BY lev, lang, source, signal) AS total, sum(n) OVER (PARTITION BY lev, lang, source, signal ORDER BY b) AS upto FROM lv),
q AS (SELECT lev, lang, source, signal, least, two, max(total) AS total, min(b) FILTER (upto * 4 >= total) AS q1, min(b) FILTER (upto * 4 >= total * 3) AS q3 FROM cum GROUP BY ALL),
f AS (SELECT lev, lang, source, signal, total, CASE WHEN two THEN q1 - greatest(q3 - q1, least) * {fence}::DOUBLE END AS lo, q3 + greatest(q3 - q1, least) * {fence}::DOUBLE AS hi FROM q),
g AS (SELECT l.lang, l.signal, (l.lo * l.total + a.lo * {prior_rows}) / (l.total + {prior_rows}) AS lo, (l.hi * l.total + a.hi * {prior_rows}) / (l.total + {prior_rows}) AS hi
  FROM f l JOIN f a ON a.lev = 0 AND a.signal = l.signal WHERE l.lev = 1),
chosen AS (SELECT o.lang, o.source, o.signal, (o.lo * o.total + g.lo * {prior_rows}) / (o.total + {prior_rows}) AS lo, (o.hi * o.total + g.hi * {prior_rows}) / (o.total + {prior_rows}) AS hi
  FROM f o JOIN g ON g.lang IS NOT DISTINCT FROM o.lang AND g.signal = o.signal WHERE o.lev = 2),
bad AS (SELECT DISTINCT rid FROM vals v JOIN chosen c ON c.lang IS NOT DISTINCT FROM v.lang AND c.source IS NOT DISTINCT FROM v.source AND c.signal = v.signal WHERE v.v > c.hi OR v.v < c.lo)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND rid NOT IN (SELECT rid FROM bad) AS kept FROM counts
"""


OP4 = f"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS size,
  CAST('0x' || substr(md5('17:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || md5(coalesce(text, ''))), 1, 8) AS BIGINT) AS k FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [5.0, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS w FROM d GROUP BY source),
r AS (SELECT *, source_size * 3.0::DOUBLE AS cap, (sum(source_size) OVER () - coalesce(sum(source_size * 3.0::DOUBLE) OVER o, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER o, 0)) AS rate
  FROM s WINDOW o AS (ORDER BY source_size * 3.0::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT min_by(rate, cap / w) AS common FROM r WHERE rate * w <= cap),
t AS (SELECT source, source_size, CAST(least(cap, coalesce(common, 0) * w) AS DOUBLE) AS target FROM r, c),
p AS (SELECT d.*, source_size, target, CAST(coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
  FROM d JOIN t ON t.source IS NOT DISTINCT FROM d.source)
SELECT doc_id, size, source_size, round(target, 6) AS target, CASE WHEN source_size = 0 THEN 0 ELSE CAST(floor(target) AS BIGINT) // source_size * size
  + greatest(0, least(size, CAST(floor(target) AS BIGINT) % source_size - before)) END AS taken FROM p
"""


def op7() -> str:
    def pattern(p: str) -> str:
        for word in ("password", "passwd", "secret", "token", "api_?key"):
            p = p.replace(word, "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word))
        return p.replace("(?i:", "(?:").replace("'", "''")

    found = " UNION ALL ".join(
        f"SELECT rid, {k} AS rank, '{r.kind}' AS kind, list_sum(list_transform(b[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS s, length(m[i]) AS n, length(g[i]) AS gl "
        f"FROM (SELECT rid, string_split_regex(t, '{pattern(r.pattern)}') AS b, regexp_extract_all(t, '{pattern(r.pattern)}', 0) AS m, regexp_extract_all(t, '{pattern(r.pattern)}', {r.group}) AS g FROM d), unnest(range(1, len(m) + 1)) u(i) WHERE length(g[i]) >= {r.least}"
        for k, r in enumerate(RULES)
    )
    listed = "string_agg(kind || ':' || CAST(s AS BIGINT) || ':' || CAST(s + n AS BIGINT), ',' ORDER BY s, rank)"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents), f AS ({found}),
a AS (SELECT rid, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  {listed} FILTER (rank < 3) AS base, {listed} AS spans FROM f GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN a USING (rid)
"""


#: Main text by the pages table's own rule: its pages have one article and no part inside it that isn't content.
OP5 = r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '<article>(.*)</article>', 1, 's') AS t FROM pages),
b AS (SELECT page_id, url, regexp_replace(regexp_replace(t, '</?b>', '', 'g'), '<[^>]*>', ' ', 'g') AS t FROM a),
c AS (SELECT page_id, url, replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '&amp', '&') AS t FROM b)
SELECT page_id, url, trim(regexp_replace(t, '\s+', ' ', 'g')) AS text, CAST(length(trim(regexp_replace(t, '\s+', ' ', 'g'))) AS BIGINT) AS n_chars FROM c
"""

_ESCAPED = r"length(regexp_replace(replace({0}, '\', '\\'), '(<|\[)(\||/?s>|/?INST\]|<SYS>>|</SYS>>)', '\1\\\2', 'g'))"
OP8 = f"""
WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
a AS (SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '') AS loss, CAST(sum({len("<|turn|><|text|><|end|>")} + {_ESCAPED.format("role")} + {_ESCAPED.format("text")}) AS BIGINT) AS formatted_chars FROM r GROUP BY conv_id)
SELECT conv_id, n_turns, turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM a
"""


def _crc_table() -> list[int]:
    table = []
    for i in range(256):
        for _ in range(8):
            i = i >> 1 ^ (0xEDB88320 if i & 1 else 0)
        table.append(i)
    return table


def op9(shards: int = 8, bits: int = 8) -> str:
    """The curve as one projection per step, after the tables of cells."""

    def cell(order: str) -> str:  # the middle of a value's rows, of all rows
        return f"CAST((2 * sum(n) OVER (ORDER BY {order}) - n) * {1 << bits} // (2 * sum(n) OVER ()) AS BIGINT)"

    cells = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, encode(coalesce(text, '')) AS b FROM documents),
s AS (SELECT rid, doc_id, lang, source, CAST(octet_length(b) + 1 AS BIGINT) AS size, hex(b) AS h FROM d),
x AS (SELECT rid, doc_id, lang, source, size, CAST(xor(list_reduce(list_transform(range(0, size - 1), lambda i: CAST('0x' || substr(h, CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT)),
  lambda a, y: xor([{", ".join(map(str, _crc_table()))}][xor(a, y) % 256 + 1], a >> 8), CAST(4294967295 AS BIGINT)), 4294967295) AS BIGINT) AS text_crc32 FROM s),
l AS (SELECT lang AS v, {cell("lang NULLS FIRST")} AS c FROM (SELECT lang, count(*) AS n FROM d GROUP BY lang)),
o AS (SELECT source AS v, {cell("source NULLS FIRST")} AS c FROM (SELECT source, count(*) AS n FROM d GROUP BY source)),
e AS (SELECT *, (size >> greatest(length(bin(size)) - 7, 0)) << greatest(length(bin(size)) - 7, 0) AS b FROM s),
m AS (SELECT b AS v, {cell("b")} AS c FROM (SELECT b, count(*) AS n FROM e GROUP BY b)),
z AS (SELECT rid, o.c AS x0, l.c AS x1, m.c AS x2 FROM e JOIN m ON m.v = b JOIN l ON l.v IS NOT DISTINCT FROM lang JOIN o ON o.v IS NOT DISTINCT FROM source)"""
    last, k = "z", 0
    for b in range(bits - 1, 0, -1):
        for i in range(3):
            change = f"CASE WHEN x{i} & {1 << b} <> 0 THEN {(1 << b) - 1} ELSE xor(x0, x{i}) & {(1 << b) - 1} END"
            new = [f"xor(x0, {change}) AS x0" if j == 0 else f"CASE WHEN x{i} & {1 << b} <> 0 THEN x{j} ELSE xor(x{j}, {change}) END AS x{j}" if j == i else f"x{j}" for j in range(3)]
            cells += f",\nz{k} AS (SELECT rid, {', '.join(new)} FROM {last})"
            last, k = f"z{k}", k + 1
    flip = "0"
    for b in range(1, bits):
        flip = f"xor({flip}, CASE WHEN y2 & {1 << b} <> 0 THEN {(1 << b) - 1} ELSE 0 END)"
    terms = [f"(((xor(y{i}, f) >> {b}) & 1) << {3 * b + 2 - i})" for b in range(bits) for i in range(3)]
    return f"""{cells},
g AS (SELECT rid, x0 AS y0, xor(x1, x0) AS y1, xor(x2, xor(x1, x0)) AS y2 FROM {last}), h AS (SELECT *, {flip} AS f FROM g), c AS (SELECT rid, {" + ".join(terms)} AS curve FROM h),
n AS (SELECT x.*, row_number() OVER (ORDER BY curve, doc_id NULLS FIRST, size, text_crc32) - 1 AS k, count(*) OVER () AS n FROM x JOIN c USING (rid))
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(k * {shards} // n AS INTEGER) AS shard, k - ((k * {shards} // n) * n + {shards - 1}) // {shards} AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM n
"""


def op13(parts: int = 16, entries: int = 64, rounds: int = 2, width: int = 4) -> str:
    d = range(width)
    cols = ", ".join(f"v{i}" for i in d)
    gap = " + ".join(f"(x.v{i} - b.v{i}) * (x.v{i} - b.v{i})" for i in d)
    steps = f"""
WITH k AS (SELECT row_number() OVER () AS rid, vec_id, label, list_transform(embedding, lambda v: CAST(floor(CAST(v AS DOUBLE) * 256) AS BIGINT)) AS x
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0),
x AS (SELECT rid, p, {", ".join(f"x[p * {width} + {i + 1}] AS v{i}" for i in d)} FROM k, range({parts}) r(p)),
f AS (SELECT rid, row_number() OVER (ORDER BY vec_id, x) - 1 AS e FROM k QUALIFY row_number() OVER (ORDER BY vec_id, x) <= {entries}),
b0 AS (SELECT p, e, {cols} FROM f JOIN x USING (rid))"""
    for r in range(rounds + 1):
        steps += f""",
n{r} AS (SELECT rid, x.p, e, {gap} AS g, {", ".join(f"x.v{i}" for i in d)} FROM x JOIN b{r} b ON b.p = x.p QUALIFY row_number() OVER (PARTITION BY rid, x.p ORDER BY g, e) = 1)"""
        if r < rounds:
            steps += f""",
m{r} AS (SELECT p, e, {", ".join(f"CAST(floor(CAST(sum(v{i}) AS DOUBLE) / count(*)) AS BIGINT) AS v{i}" for i in d)} FROM n{r} GROUP BY p, e),
b{r + 1} AS (SELECT p, e, {", ".join(f"coalesce(m.v{i}, b.v{i}) AS v{i}" for i in d)} FROM b{r} b LEFT JOIN m{r} m USING (p, e))"""
    flat = " || ',' || ".join(f"v{i}" for i in d)
    return f"""{steps},
c AS (SELECT rid, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(g) AS BIGINT) AS error FROM n{rounds} GROUP BY rid)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg({flat}, ',' ORDER BY p, e)) FROM b{rounds}) AS codebooks_sha256 FROM c JOIN k USING (rid)
"""


ORACLES = {
    "op3_quality_rules": op3(),
    "op4_mixing": OP4,
    "op5_html_extract": OP5,
    "op7_secret_scan": op7(),
    "op8_chat_format": OP8,
    "op9_sharding": op9(),
    "op10_exact_dedup": OP10,
    "op13_vector_codes": op13(),
}
