"""DuckDB SQL for the queries of this subpackage that SQL can express."""

_EXACT = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
  FROM documents
), g AS (
  SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256
FROM d JOIN g USING (text_sha256)
"""

_MIXING = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(text, '')) AS key
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CAST([5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS weight
  FROM d GROUP BY source
), c AS (
  SELECT *, source_size * 3.0::DOUBLE AS cap, row_number() OVER (ORDER BY source_size * 3.0::DOUBLE / weight, source NULLS LAST) AS nth FROM s
), levels AS (
  SELECT nth, cap / weight AS ratio,
         ((SELECT CAST(sum(source_size) AS DOUBLE) FROM s) - coalesce(sum(cap) OVER (ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / ((SELECT sum(weight) FROM s) - coalesce(sum(weight) OVER (ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
  FROM c
), t AS (
  SELECT source, source_size, least(cap, weight * (SELECT level FROM levels WHERE level <= ratio ORDER BY nth LIMIT 1)) AS target FROM c
), p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, CAST(floor(t.target + 0.5) AS BIGINT) AS budget,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       CAST(CASE WHEN source_size = 0 THEN 0
            ELSE (budget // source_size) * size + greatest(0, least(size, budget % source_size - before)) END AS BIGINT) AS taken
FROM p
"""

#: The first 128 bytes of an NPY file of 16 x 16 bytes.
_NPY_HEAD = (b"\x93NUMPY\x01\x00\x76\x00" + b"{'descr': '|u1', 'fortran_order': False, 'shape': (16, 16), }".ljust(117) + b"\n").hex()


def _cells(name: str, high: int, wide: int) -> str:
    """Area means (n, i, j, mean) of ``high`` x ``wide`` cells, in whole numbers."""
    return f"""
{name}_x AS (
  SELECT x, j, least({wide} * (x + 1), 64 * (j + 1)) - greatest({wide} * x, 64 * j) AS part FROM (SELECT unnest(range(64)) AS x), (SELECT unnest(range({wide})) AS j)
), {name}_rows AS (
  SELECT n, height, y, j, sum(v * part) AS s FROM pixels JOIN {name}_x USING (x) WHERE part > 0 GROUP BY ALL
), {name}_y AS (
  SELECT n, height, i, j, s * (least({high} * (y + 1), height * (i + 1)) - greatest({high} * y, height * i)) AS s
  FROM {name}_rows JOIN (SELECT unnest(range({high})) AS i) ON {high} * (y + 1) > height * i AND {high} * y < height * (i + 1)
), {name} AS (
  SELECT n, i, j, CAST((2 * sum(s) + 64 * height) // (128 * height) AS BIGINT) AS mean FROM {name}_y GROUP BY n, height, i, j
)"""


_MEDIA = f"""
WITH RECURSIVE bits AS (
  SELECT CAST(range AS BIGINT) AS byte, CAST(range AS BIGINT) AS c, 0 AS step FROM range(256)
  UNION ALL SELECT byte, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, step + 1 FROM bits WHERE step < 8
), crc AS MATERIALIZED (
  SELECT byte, c AS rest FROM bits WHERE step = 8
), raw AS (
  SELECT row_number() OVER () AS n, doc_id, encode(coalesce(text, '')) AS raw FROM documents
), sized AS (
  SELECT n, doc_id, octet_length(raw) AS n_bytes, CAST(greatest(1, ceil(octet_length(raw) / 64.0)) AS BIGINT) AS height, lower(hex(raw)) AS digits FROM raw
), packed AS (
  SELECT n, doc_id, n_bytes, height, rpad(digits, CAST(height * 128 AS INTEGER), '0') AS digits FROM sized
), lines AS (
  SELECT n, height, y, substr(digits, 128 * y + 1, 128) AS digits FROM (SELECT n, height, digits, unnest(range(height)) AS y FROM packed)
), pixels AS MATERIALIZED (
  SELECT n, height, y, x, CAST('0x' || substr(digits, 2 * x + 1, 2) AS BIGINT) AS v FROM (SELECT *, unnest(range(64)) AS x FROM lines)
), tails AS MATERIALIZED (
  SELECT n, x, v FROM pixels WHERE y = height - 1
), walk AS (
  SELECT n, 0 AS x, CAST(4294967295 AS BIGINT) AS c FROM packed
  UNION ALL SELECT n, walk.x + 1, xor(c // 256, rest) FROM walk JOIN tails USING (n) JOIN crc ON byte = xor(c % 256, v) WHERE walk.x = tails.x
), sums AS (
  SELECT n, xor(c, 4294967295) AS tail_crc32 FROM walk WHERE x = 64
), {_cells("hash", 8, 9)}, {_cells("tile", 16, 16)}, risen AS (
  SELECT a.n, a.i, a.j, a.mean > b.mean AS up FROM hash a JOIN hash b ON a.n = b.n AND a.i = b.i AND a.j = b.j + 1
), marks AS (
  SELECT n, lower(string_agg(printf('%02x', v), '' ORDER BY i)) AS feature FROM (SELECT n, i, CAST(sum(CASE WHEN up THEN 1 << (8 - j) ELSE 0 END) AS INTEGER) AS v FROM risen GROUP BY n, i) GROUP BY n
), tiles AS (
  SELECT n, sha256(unhex('{_NPY_HEAD}' || string_agg(printf('%02x', CAST(mean AS INTEGER)), '' ORDER BY i, j))) AS tile_sha256 FROM tile GROUP BY n
), stored AS (
  SELECT *, lower(hex(encode('P5' || chr(10) || '64 ' || height || chr(10) || '255' || chr(10)))) || digits AS media FROM packed
)
SELECT doc_id, n_bytes, height * 64 AS payload_bytes, sha256(unhex(digits)) AS payload_sha256, tail_crc32, length(media) // 2 AS media_bytes, sha256(unhex(media)) AS media_sha256,
       feature, CAST(64 AS BIGINT) AS width, height, tile_sha256
FROM stored JOIN sums USING (n) JOIN marks USING (n) JOIN tiles USING (n)
"""

_PARTS = r"""
WITH conv AS (
  SELECT conv_id AS pair, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL
), last AS (
  SELECT pair, max(turn) AS until FROM conv WHERE role = 'assistant' GROUP BY pair
), answer AS (
  SELECT pair, until, max(text) AS answer FROM conv JOIN last USING (pair) WHERE turn = until AND role = 'assistant' GROUP BY pair, until
), ranked AS (
  SELECT *, row_number() OVER (ORDER BY sha256(answer), md5(CAST(pair AS VARCHAR)), pair) - 1 AS place, count(*) OVER () AS n, count(*) OVER (PARTITION BY answer) AS alike FROM answer
), given AS (
  SELECT pair, until, (first + alike + (place - first) % (n - alike)) % n AS place FROM (SELECT *, min(place) OVER (PARTITION BY answer) AS first FROM ranked) WHERE alike < n
), t AS (
  SELECT pair, 'chosen' AS side, turn, role, text FROM conv JOIN given USING (pair) WHERE turn <= until
  UNION ALL SELECT pair, 'rejected', turn, role, text FROM conv JOIN given USING (pair) WHERE turn < until
  UNION ALL SELECT a.pair, 'rejected', a.until, 'assistant', b.answer FROM given a JOIN ranked b ON b.place = a.place
), b AS (
  SELECT pair, turn,
         coalesce(list_sort(list(role || chr(0) || text) FILTER (side = 'chosen')), []) AS c,
         coalesce(list_sort(list(role || chr(0) || text) FILTER (side = 'rejected')), []) AS r
  FROM t GROUP BY pair, turn
), s AS (
  SELECT pair, min(turn) FILTER (c <> r) AS split, sum(len(c)) > 0 AND sum(len(r)) > 0 AS complete FROM b GROUP BY pair
), p AS (
  SELECT t.*, split IS NULL OR turn < split AS prompt, complete FROM t JOIN s USING (pair)
), q AS (
  SELECT pair, CASE WHEN prompt THEN 'prompt' ELSE side END AS part, turn, role,
         '<|' || role || '|>' || chr(10) || text || chr(10) || '<|end|>' || chr(10) AS rendered,
         CASE WHEN NOT prompt AND role = 'assistant' THEN 1 ELSE 0 END AS loss, complete
  FROM p WHERE NOT prompt OR side = 'chosen'
), parts AS (
  SELECT *, CAST(sum(length(rendered)) OVER (PARTITION BY pair, part ORDER BY turn, role, rendered ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS stop FROM q
), parts_at AS (
  SELECT pair, part, turn, role, rendered, loss, stop - length(rendered) AS start, stop, complete FROM parts
)
"""

_PREFERENCE = _PARTS + "SELECT * FROM parts_at"


def _part(part: str) -> str:
    return f"""count(*) FILTER (part = '{part}') AS {part}_turns, coalesce(max(stop) FILTER (part = '{part}'), 0) AS {part}_chars,
       sha256(unhex(coalesce(string_agg(sha256(rendered), '' ORDER BY start) FILTER (part = '{part}'), ''))) AS {part}_sha256"""


def _mask(part: str) -> str:
    return f"coalesce(string_agg(start || ':' || stop, ',' ORDER BY start) FILTER (part = '{part}' AND loss = 1), '') AS {part}_mask"


_PAIRS = _PARTS + f"SELECT pair, first(complete) AS complete, {_part('prompt')}, {_part('chosen')}, {_part('rejected')}, {_mask('chosen')}, {_mask('rejected')} FROM parts_at GROUP BY pair"

_NEAR = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(words) < 2 THEN words ELSE list_distinct(list_transform(range(1, len(words)), lambda i : words[i] || ' ' || words[i + 1])) END AS shingles FROM w
), u AS MATERIALIZED (
  SELECT doc_id, len(shingles) AS n, unnest(shingles) AS shingle FROM s
), pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS common FROM u a JOIN u b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL
), links AS MATERIALIZED (
  SELECT a, b FROM pairs WHERE 100 * common >= 80 * (na + nb - common) UNION ALL SELECT b, a FROM pairs WHERE 100 * common >= 80 * (na + nb - common)
), reach AS (
  SELECT doc_id, doc_id AS low FROM s UNION SELECT links.b, reach.low FROM reach JOIN links ON links.a = reach.doc_id
), c AS (
  SELECT doc_id, min(low) AS component_id FROM reach GROUP BY doc_id
)
SELECT doc_id, CAST(len(shingles) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN c USING (doc_id)
"""

_INFILL = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), u AS (
  SELECT *, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS units,
         CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2, CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4
  FROM t
), c AS (
  SELECT *, len(units) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS a, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM u
), p AS (
  SELECT *, coalesce(array_to_string(units[1:a], ''), '') AS prefix, coalesce(array_to_string(units[a + 1:b], ''), '') AS middle, coalesce(array_to_string(units[b + 1:], ''), '') AS suffix FROM c
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""

def _shifted(x: str) -> str:
    """A CRC register after 2 ** k more zero bytes, by the tables t0 to t3 of its four bytes."""
    return f"xor(xor(t0[{x} % 256 + 1], t1[{x} // 256 % 256 + 1]), xor(t2[{x} // 65536 % 256 + 1], t3[{x} // 16777216 + 1]))"


#: Bytes of a text are folded pairwise, 2 ** k of them at step k, into its CRC-32; groups are packed one by one,
#: at capacities of a gallop and a bisection as the operator tries them.
_SHARDS = f"""
WITH RECURSIVE bits AS (
  SELECT CAST(range AS BIGINT) AS byte, CAST(range AS BIGINT) AS c, 0 AS step FROM range(256)
  UNION ALL SELECT byte, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, step + 1 FROM bits WHERE step < 8
), crc AS MATERIALIZED (
  SELECT list(c ORDER BY byte) AS t FROM bits WHERE step = 8
), shifts AS (
  SELECT 0 AS k, t AS t0, list_transform(range(256), lambda v: v) AS t1, list_transform(range(256), lambda v: v * 256) AS t2, list_transform(range(256), lambda v: v * 65536) AS t3 FROM crc
  UNION ALL SELECT k + 1, {', '.join(f"list_transform(t{i}, lambda x: {_shifted('x')})" for i in range(4))} FROM shifts WHERE k < 24
), d AS (
  SELECT doc_id, coalesce(text, '') AS text, CAST(strlen(coalesce(text, '')) + 1 AS BIGINT) AS size FROM documents
), g AS MATERIALIZED (
  SELECT text, sum(size) AS bytes, row_number() OVER (ORDER BY sum(size) DESC, sha256(text)) AS nth FROM d GROUP BY text
), pairs AS (
  SELECT nth, regexp_extract_all(hex(encode(text)), '..') AS pairs FROM g
), bytes AS (
  SELECT nth, len(pairs) - i AS j, t[CAST('0x' || p AS INTEGER) + 1] AS v FROM (SELECT nth, pairs, unnest(pairs) AS p, generate_subscripts(pairs, 1) AS i FROM pairs), crc
  UNION ALL SELECT nth, len(pairs), 4294967295 FROM pairs
), folded AS (
  SELECT 0 AS k, nth, CAST(j AS BIGINT) AS j, CAST(v AS BIGINT) AS v FROM bytes
  UNION ALL SELECT any_value(k) + 1, nth, j // 2, bit_xor(CASE WHEN j % 2 = 1 THEN {_shifted('v')} ELSE v END) FROM folded JOIN shifts USING (k) WHERE k < 24 GROUP BY nth, j // 2
), c AS MATERIALIZED (
  SELECT list(CAST(bytes AS BIGINT) ORDER BY nth) AS sizes, CAST(greatest(ceil(sum(bytes) / 8), max(bytes)) AS BIGINT) AS low FROM g
), walk AS (
  SELECT low, CAST(0 AS BIGINT) AS step, CAST(NULL AS BIGINT) AS high, low AS tried, 1 AS pos, CAST([] AS BIGINT[]) AS rooms, CAST([] AS INTEGER[]) AS homes, CAST([] AS INTEGER[]) AS best, FALSE AS failed, FALSE AS done FROM c
  UNION ALL
  SELECT CASE WHEN failed THEN tried + 1 ELSE low END,
    CASE WHEN failed AND high IS NULL THEN greatest(1, 2 * step) ELSE step END,
    CASE WHEN placed THEN tried ELSE high END,
    CASE WHEN failed AND high IS NULL THEN tried + 1 + greatest(1, 2 * step) WHEN failed THEN (tried + 1 + high) // 2 WHEN placed THEN (low + tried) // 2 ELSE tried END,
    CASE WHEN failed OR placed THEN 1 ELSE pos + 1 END,
    CASE WHEN failed OR placed THEN CAST([] AS BIGINT[]) WHEN fit IS NULL THEN list_append(rooms, tried - s) ELSE list_transform(rooms, lambda r, i: CASE WHEN i = home THEN r - s ELSE r END) END,
    CASE WHEN failed OR placed THEN CAST([] AS INTEGER[]) ELSE list_append(homes, home) END,
    CASE WHEN placed THEN homes ELSE best END,
    NOT (failed OR placed) AND home > 8,
    (placed AND low >= tried) OR (failed AND high IS NOT NULL AND tried + 1 >= high)
  FROM (SELECT *, pos > len(sizes) AND NOT failed AS placed, CAST(coalesce(list_position(rooms, fit), len(rooms) + 1) AS INTEGER) AS home FROM (
    SELECT walk.*, sizes, sizes[pos] AS s, list_min(list_filter(rooms, lambda r: r >= sizes[pos])) AS fit FROM walk, c WHERE NOT done))
), homes AS (
  SELECT unnest(best) - 1 AS shard, generate_subscripts(best, 1) AS nth FROM walk WHERE done
), placed AS (
  SELECT doc_id, text, size, xor(v, 4294967295) AS text_crc32, CAST(shard AS INTEGER) AS shard FROM d JOIN g USING (text) JOIN homes USING (nth) JOIN folded USING (nth) WHERE k = 24
)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS LAST, sha256(text)) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM placed
"""

ORACLE_SQL: dict[str, str] = {"op1_media": _MEDIA, "op5_mixing": _MIXING, "op7_exact_dedup": _EXACT, "op9_near_dedup": _NEAR, "op10_preference": _PREFERENCE, "op10_preference_pairs": _PAIRS, "op11_infill": _INFILL, "op13_sharding": _SHARDS}
