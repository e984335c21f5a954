"""DuckDB SQL for the queries that SQL can express. SimHash by XXH64, learnt models, token files and chaining are tested against brute force instead."""

from __future__ import annotations

from .common import LOWER, SPACE, UPPER, WORD
from .license_scan import SHINGLE, TEMPLATES
from .line_dedup import BLOCKS, REFERENCES, SILENT
from .mixing import BLOCK, SLOTS

NORMAL_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def normal(text: str) -> str:
    return f"regexp_extract_all(translate(coalesce({text}, ''), '{UPPER}', '{LOWER}'), '{NORMAL_WORD}')"


def page_lines() -> str:
    t = "regexp_replace(coalesce(html, ''), '(?s)<!--.*?-->', '', 'g')"
    for name in SILENT.split("|"):
        t = rf"regexp_replace({t}, '(?is)<{name}\b.*?</{name}\s*>', '', 'g')"
    t = rf"regexp_replace({t}, '[\r\n]+', ' ', 'g')"
    t = rf"regexp_replace({t}, '(?i)</?(?:{BLOCKS})\b[^>]*>', chr(10), 'g')"
    t = f"regexp_replace({t}, '<[^>]*>', '', 'g')"
    for ref, character in REFERENCES:
        t = "replace({}, '{}', '{}')".format(t, ref, character.replace("'", "''"))
    return f"list_filter(list_transform(string_split({t}, chr(10)), lambda x: trim(regexp_replace(x, '{SPACE}+', ' ', 'g'))), lambda x: x <> '')"


LINE_DEDUP = rf"""WITH p AS (SELECT page_id, lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)) AS host, {page_lines()} AS lines FROM pages),
totals AS (SELECT host, count(*) AS n FROM p GROUP BY host),
often AS (SELECT host, line FROM (SELECT host, unnest(list_distinct(lines)) AS line FROM p) JOIN totals USING (host) GROUP BY host, line, n HAVING count(*) >= 3 AND count(*) >= n * 0.1),
gone AS (SELECT host, list(line) AS boiler FROM often GROUP BY host),
kept AS (SELECT page_id, p.host, lines, list_filter(lines, lambda x: NOT list_contains(coalesce(boiler, []), x)) AS kept FROM p LEFT JOIN gone ON p.host = gone.host)
SELECT page_id, host, CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(kept) AS BIGINT) AS n_dropped, coalesce(array_to_string(kept, chr(10)), '') AS text FROM kept"""

MIXING = f"""WITH d AS (SELECT doc_id, source, text, CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS size, md5(concat(CAST(doc_id AS VARCHAR), ':mix')) AS h FROM documents),
s AS (SELECT source, sum(size) AS n, [5.0::DOUBLE, 2.0, 1.0][1 + ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)] AS w, row_number() OVER (ORDER BY source NULLS LAST) AS i FROM d GROUP BY source),
o AS (SELECT *, row_number() OVER (ORDER BY 2.0::DOUBLE * n / w, i) AS k FROM s),
l AS (SELECT *, (1.5::DOUBLE * sum(n) OVER () - coalesce(sum(2.0::DOUBLE * n) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / (sum(w) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS level FROM o),
f AS (SELECT min(k) AS k FROM l WHERE 2.0::DOUBLE * n > level * w),
g AS (SELECT l.source, CAST(n AS BIGINT) AS n, CASE WHEN l.k >= f.k THEN (SELECT x.level FROM l AS x, f AS y WHERE x.k = y.k) * w ELSE 2.0::DOUBLE * n END AS target FROM l, f),
p AS (SELECT total, block, CAST(floor(total / block + 0.5) AS BIGINT) AS slots FROM (SELECT total, CAST(greatest(1, least({BLOCK}, ceil(total / {SLOTS}))) AS BIGINT) AS block FROM (SELECT 1.5::DOUBLE * sum(n) AS total FROM g))),
b AS (SELECT *, length(bin(slots - 1)) AS bits FROM p),
r AS (SELECT source, n, target, lag(z, 1, 0) OVER (ORDER BY source NULLS LAST) AS a, z FROM (SELECT g.*, CAST(ceil(sum(target) OVER (ORDER BY source NULLS LAST ROWS UNBOUNDED PRECEDING) / total * pow(2, bits) - 0.000001) AS BIGINT) AS z FROM g, b)),
x AS (SELECT slot, CAST(list_sum(list_transform(range(bits), lambda k: ((slot >> k) & 1) << (bits - 1 - k))) AS BIGINT) AS point FROM (SELECT unnest(range(slots)) AS slot, bits FROM b)),
y AS (SELECT slot, source, row_number() OVER (PARTITION BY source ORDER BY slot) - 1 AS rank FROM x JOIN r ON x.point >= r.a AND x.point < r.z),
e AS (SELECT d.*, r.n, r.target, least((SELECT count(*) FROM y WHERE y.source IS NOT DISTINCT FROM r.source) * block, 2 * r.n) AS quota, block, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY h, size, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source, b)
SELECT doc_id, size, e.n AS source_size, target, CAST(least(size, greatest(0, quota - start)) + least(size, greatest(0, quota - e.n - start)) AS BIGINT) AS taken, CASE WHEN size > 0 AND start < quota THEN y.slot END AS first_slot FROM e LEFT JOIN y ON e.source IS NOT DISTINCT FROM y.source AND e.start // block = y.rank"""

LICENSES = f"""WITH tpl AS (SELECT * FROM (VALUES {", ".join(f"({i}, '{n}', '{t}')" for i, (n, t) in enumerate(TEMPLATES))}) AS v(i, license, text)),
tw AS (SELECT i, license, {normal("text")} AS w FROM tpl),
ts AS (SELECT i, license, list_distinct(CASE WHEN len(w) >= {SHINGLE} THEN list_transform(range(1, len(w) - {SHINGLE - 2}), lambda k: array_to_string(w[k:k + {SHINGLE - 1}], ' ')) ELSE [array_to_string(w, ' ')] END) AS t FROM tw),
tt AS (SELECT i, license, len(t) AS n, CAST(pow(2, ceil(log2(len(t)))) AS BIGINT) AS half, unnest(t) AS s FROM ts),
dw AS (SELECT doc_id, row_number() OVER () AS r, {normal("text")} AS w FROM documents),
ds AS (SELECT doc_id, r, unnest(range(0, greatest(1, len(w) - {SHINGLE - 1}))) AS pos, w FROM dw WHERE len(w) > 0),
dx AS (SELECT doc_id, r, pos, CASE WHEN len(w) >= {SHINGLE} THEN array_to_string(w[pos + 1:pos + {SHINGLE}], ' ') ELSE array_to_string(w, ' ') END AS s FROM ds),
m AS (SELECT doc_id, r, i, license, n, half, pos, tt.s AS s, unnest([pos // half * half, pos // half * half - half]) AS start FROM dx JOIN tt ON dx.s = tt.s),
c AS (SELECT doc_id, r, i, license, n, start, count(DISTINCT s) AS hits, min(pos) AS a, max(pos) AS b FROM m WHERE start >= 0 GROUP BY ALL HAVING count(DISTINCT s) >= n * 0.8),
x AS (SELECT *, row_number() OVER (PARTITION BY r, i ORDER BY hits DESC, start) AS k FROM c)
SELECT doc_id, license, CAST(n AS BIGINT) AS n_shingles, CAST(hits AS DOUBLE) / n AS containment, a AS first_word, b + {SHINGLE - 1} AS last_word FROM x WHERE k = 1"""

SHARDING = """WITH k AS (SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n)) AS t),
b AS (SELECT doc_id, text, strlen(coalesce(text, '')) AS bytes, hex(encode(coalesce(text, ''))) AS x, row_number() OVER () AS r FROM documents),
crc AS (SELECT doc_id, text, r, bytes, CASE WHEN bytes = 0 THEN 0 ELSE xor(4294967295, list_reduce(list_transform(range(bytes), lambda i: CAST(concat('0x', x[2 * i + 1:2 * i + 2]) AS BIGINT)), lambda c, y: xor(t[1 + (xor(c, y) & 255)], c >> 8), 4294967295)) END AS crc FROM b, k),
u AS (SELECT r, i, -1.0 / ln((CAST(concat('0x', substr(md5(concat('shard:', CAST(doc_id AS VARCHAR), ':', CAST(i // 2 AS VARCHAR))), CASE WHEN i % 2 = 0 THEN 1 ELSE 17 END, 13)) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496) AS score FROM b, (SELECT unnest(range(25)) AS i)),
s AS (SELECT r, arg_max(i, score) FILTER (i < 24) AS shard, arg_max(i, score) AS grown FROM u GROUP BY r)
SELECT doc_id, CAST(bytes + 8 AS BIGINT) AS size, CAST(crc AS BIGINT) AS text_crc32, 'key' AS law, CAST(shard AS INTEGER) AS shard, row_number() OVER (PARTITION BY shard ORDER BY md5(CAST(doc_id AS VARCHAR)), crc, bytes) - 1 AS slot, CAST(grown AS INTEGER) AS grown_shard FROM crc JOIN s USING (r)"""

DECONTAMINATION = f"""WITH iw AS (SELECT CAST(item_id AS VARCHAR) AS item, {normal("text")} AS w FROM benchmark),
win AS (SELECT DISTINCT item, least(13, len(w)) AS n, unnest(list_transform(range(1, len(w) - least(13, len(w)) + 2), lambda k: array_to_string(w[k:k + least(13, len(w)) - 1], ' '))) AS s FROM iw WHERE len(w) > 0),
dw AS (SELECT doc_id, row_number() OVER () AS r, {normal("text")} AS w FROM documents),
dp AS (SELECT r, n, w, unnest(range(1, len(w) - n + 2)) AS p FROM dw, (SELECT DISTINCT n FROM win) WHERE len(w) >= n),
hit AS (SELECT r, dp.n, p, item FROM dp JOIN win ON dp.n = win.n AND array_to_string(w[p:p + dp.n - 1], ' ') = win.s),
words AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS q FROM hit) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT r, item FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated FROM dw LEFT JOIN words USING (r) LEFT JOIN items USING (r)"""

ORACLES: dict[str, str] = {
    "op1_line_dedup": LINE_DEDUP,
    "op4_mixing": MIXING,
    "op6_license_scan": LICENSES,
    "op7_sharding": SHARDING,
    "op9_decontamination": DECONTAMINATION,
}
