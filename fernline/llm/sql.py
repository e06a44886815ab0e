"""SQL (DuckDB) for the queries that SQL can express: URL filters, decontamination, mixing, sharding."""

from __future__ import annotations

_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

URL_FILTERS = rf"""
WITH parts AS (
  SELECT page_id, {_LOWER.format(r"regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1)")} AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path
  FROM pages),
rules(r_host, r_path, r_verdict) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
best AS (
  SELECT host, path, arg_max(r_host || r_path, length(r_host || r_path)) AS rule, arg_max(r_verdict, length(r_host || r_path)) AS verdict
  FROM (SELECT DISTINCT host, path FROM parts) JOIN rules ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path)
  GROUP BY host, path)
SELECT page_id, p.host, p.path, rule, coalesce(verdict, 'allow') AS verdict
FROM parts p LEFT JOIN best b ON p.host = b.host AND p.path = b.path
"""

_TERMS = rf"regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

DECONTAMINATE = rf"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, {_TERMS} AS ws FROM documents),
items AS (SELECT coalesce(cast(item_id AS varchar), '') AS item, {_TERMS} AS ws FROM benchmark),
windows AS (
  SELECT DISTINCT item, list_slice(ws, i, i + 9) AS words
  FROM (SELECT item, ws, unnest(range(1, greatest(1, len(ws) - 9) + 1)) AS i FROM items WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT len(words) AS n FROM windows),
places AS (
  SELECT rid, n, i, list_slice(ws, i, i + n - 1) AS words
  FROM (SELECT rid, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM docs, sizes WHERE len(ws) >= n)),
found AS (SELECT rid, n, i, item FROM places JOIN windows USING (words)),
hits AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT rid, n, i FROM found)) GROUP BY rid),
named AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed FROM (SELECT DISTINCT rid, item FROM found) GROUP BY rid)
SELECT doc_id, cast(len(ws) AS bigint) AS n_words, cast(coalesce(n_hit, 0) AS bigint) AS n_hit, cast(coalesce(n_items, 0) AS bigint) AS n_items,
       sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hits USING (rid) LEFT JOIN named USING (rid)
"""

_UNIT = "(('0x' || substr(md5({0}), 1, 8))::bigint::double / 4294967296.0)"

MIX_SOURCES = rf"""
WITH sized AS (
  SELECT source, doc_id, cast(coalesce(len(regexp_extract_all(text, '[^ \t\n\x0B\f\r]+')), 0) AS bigint) AS size FROM documents),
per AS (
  SELECT source, cast(sum(size) AS bigint) AS source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::double WHEN 1 THEN 2.0::double ELSE 1.0::double END AS weight
  FROM sized GROUP BY source),
filled AS (SELECT *, source_size * 3.0::double AS cap, source_size * 3.0::double / weight AS fill FROM per),
shared AS (
  SELECT *, ((sum(source_size) OVER ())::double - coalesce(sum(cap) OVER w, 0.0)) / ((sum(weight) OVER ()) - coalesce(sum(weight) OVER w, 0.0)) AS share
  FROM filled WINDOW w AS (ORDER BY fill, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (
  SELECT source, source_size, least(cap, coalesce(min_by(share, fill) FILTER (WHERE share <= fill) OVER (), 0.0) * weight) AS target FROM shared),
ranked AS (
  SELECT s.*, row_number() OVER (
    PARTITION BY source
    ORDER BY lpad(length(size::varchar)::varchar, 2, '0') || substr(size::varchar, 1, 2) || substr(md5(coalesce(doc_id::varchar, '')), 1, 2), size, doc_id NULLS FIRST) - 1 AS pos
  FROM sized s),
placed AS (
  SELECT r.doc_id, r.size, r.pos, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate, {_UNIT.format("'mix:' || coalesce(r.source, '')")} AS u
  FROM ranked r JOIN targets t ON r.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, copies * size AS taken, copies
FROM (SELECT *, cast(floor(rate * (pos + 1) + u) - floor(rate * pos + u) AS bigint) AS copies FROM placed)
"""


#: CRC-32 byte by byte, with the table of its polynomial.
_CRC = """
steps AS (SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, k: xor(c >> 1, 3988292384 * (c & 1)), n)) AS step),
spelled AS (SELECT DISTINCT text, hex(encode(text)) AS digits FROM documents WHERE text IS NOT NULL),
spelled_bytes AS (SELECT text, list_transform(range(len(digits) // 2), lambda i: ('0x' || substr(digits, 2 * i + 1, 2))::bigint) AS bytes FROM spelled),
crcs AS (SELECT text, xor(list_reduce(bytes, lambda c, b: xor(c >> 8, step[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) AS crc FROM spelled_bytes, steps)"""


def _descend(level: str, parent: str, nodes: list[tuple[str, str, float]]) -> str:
    values = ", ".join(f"('{p}', '{c}', {w}::double)" for p, c, w in nodes)
    return f"""
{level} AS (
  SELECT key, arg_min(child, struct_pack(draw := -ln({_UNIT.format("key || '|' || child")} + 1.1641532182693481e-10) / weight, child := child)) AS node
  FROM {parent} JOIN (VALUES {values}) AS t(parent, child, weight) ON node = parent GROUP BY key)"""


def _tree(name: str, grown: int) -> str:
    from .sharding import shard_tree

    tree = shard_tree(grown=grown)
    racks = [(r, k, sum(shards.values())) for r, inside in tree.items() for k, shards in inside.items()]
    regions = [("", r, sum(w for p, _, w in racks if p == r)) for r in tree]
    leaves = [(k, f"s{s}", w) for inside in tree.values() for k, shards in inside.items() for s, w in shards.items()]
    return ",".join([_descend(f"{name}_region", "roots", regions), _descend(f"{name}_rack", f"{name}_region", racks), _descend(f"{name}_shard", f"{name}_rack", leaves)])


def shard_sql() -> str:
    return f"""
WITH {_CRC.lstrip()},
docs AS (
  SELECT doc_id, coalesce(doc_id::varchar, '') AS key, cast(coalesce(strlen(text), 0) + 8 AS bigint) AS size, cast(coalesce(crc, 0) AS bigint) AS text_crc32
  FROM documents LEFT JOIN crcs USING (text)),
roots AS (SELECT DISTINCT key, '' AS node FROM docs),
{_tree("now", 0)},
{_tree("grown", 1)}
SELECT doc_id, size, text_crc32, 'key' AS law, cast(substr(n.node, 2) AS int) AS shard,
       row_number() OVER (PARTITION BY n.node ORDER BY substr(md5(key), 1, 3), doc_id NULLS FIRST, size, text_crc32) - 1 AS slot,
       cast(substr(g.node, 2) AS int) AS grown_shard
FROM docs JOIN now_shard n USING (key) JOIN grown_shard g USING (key)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_url_filters": URL_FILTERS, "op4_decontaminate": DECONTAMINATE, "op8_mix_sources": MIX_SOURCES, "op10_shard_tree": shard_sql()}
