"""DuckDB SQL for the queries that SQL can express over whole tables."""

from __future__ import annotations

from borespark.llm.secret_scan import BASE, KINDS, SCOPE, WEAK

ORACLES: dict[str, str] = {}
_WORDS = r"regexp_extract_all(COALESCE(text, ''), '[^\x20\x09-\x0D]+')"
_LOWER = _WORDS.replace("COALESCE(text, '')", "translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")


def _shingles(words: str) -> str:
    """A list of the distinct 5-word windows of a list of words; fewer words form one."""
    return f"CASE WHEN LEN({words}) = 0 THEN [] WHEN LEN({words}) < 5 THEN [array_to_string({words}, ' ')] ELSE list_distinct(list_transform(range(1, LEN({words}) - 3), lambda i: array_to_string({words}[i:i + 4], ' '))) END"


ORACLES["op3_near_duplicates"] = f"""
WITH RECURSIVE nodes AS (SELECT COALESCE(text, '') AS text, MIN(doc_id) AS node, COUNT(*) AS copies FROM documents GROUP BY 1),
 w AS (SELECT node, {_WORDS} AS w FROM nodes), s AS (SELECT node, UNNEST({_shingles('w')}) AS g FROM w), n AS (SELECT node, COUNT(*) AS n FROM s GROUP BY 1),
 c AS (SELECT a.node AS a, b.node AS b, COUNT(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.node < b.node GROUP BY 1, 2),
 e AS (SELECT a, b FROM c JOIN n x ON x.node = a JOIN n y ON y.node = b WHERE shared >= 0.8 * (x.n + y.n - shared) - 1e-9),
 both_ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
 r(node, root) AS (SELECT node, node FROM nodes UNION SELECT b.b, r.root FROM r JOIN both_ways b ON b.a = r.node),
 l AS (SELECT node, MIN(root) AS class_id FROM r GROUP BY 1), z AS (SELECT class_id, SUM(copies) AS class_size FROM l JOIN nodes USING (node) GROUP BY 1)
SELECT d.doc_id, class_id, CAST(class_size AS BIGINT) AS class_size FROM documents d JOIN nodes ON nodes.text = COALESCE(d.text, '') JOIN l USING (node) JOIN z USING (class_id)"""

ORACLES["op6_decontamination"] = f"""
WITH i AS (SELECT item_id, {_LOWER} AS w FROM benchmark), d AS (SELECT doc_id, {_LOWER} AS w FROM documents),
 s AS (SELECT item_id, UNNEST({_shingles('w')}) AS g FROM i), n AS (SELECT item_id, COUNT(*) AS item_shingles FROM s GROUP BY 1), g AS (SELECT doc_id, UNNEST({_shingles('w')}) AS g FROM d WHERE LEN(w) >= 5),
 c AS (SELECT doc_id, item_id, COUNT(*) AS shared FROM g JOIN s USING (g) GROUP BY 1, 2)
SELECT doc_id, item_id, shared, item_shingles, shared / item_shingles AS containment FROM c JOIN n USING (item_id) WHERE shared >= 0.8 * item_shingles - 1e-9"""


def _sql(pattern: str) -> str:
    return pattern.replace("'", "''")


def _parts(kind: str, number: int, pattern: str, group: int, least: int) -> str:
    """Rows (id, s, k, e) of one kind: places from the lengths of the pieces between the matches."""
    counted = f"regexp_extract_all(text, '{_sql(pattern)}', {group})"
    keep = "LENGTH(c[i]) >= " + str(least)
    if kind == "opaque":
        keep += " AND regexp_matches(m[i], '[0-9]') AND regexp_matches(m[i], '[a-z]') AND regexp_matches(m[i], '[A-Z]')"
    return f"""SELECT id, s, {number} AS k, e FROM (SELECT id, i, m, c, COALESCE(list_sum(list_transform(p[1:i], lambda x: LENGTH(x))), 0) + COALESCE(list_sum(list_transform(m[1:i - 1], lambda x: LENGTH(x))), 0) AS s, s + LENGTH(m[i]) AS e
 FROM (SELECT id, m, c, p, UNNEST(range(1, LEN(m) + 1)) AS i FROM (SELECT id, regexp_extract_all(text, '{_sql(pattern)}', 0) AS m, {counted} AS c, string_split_regex(text, '{_sql(pattern)}') AS p FROM t))) WHERE {keep}"""


_ALL = [(kind, n, *spec) for n, (kind, spec) in enumerate((BASE | WEAK).items())]
_NAMES = "[" + ", ".join(f"'{k}'" for k in KINDS) + "]"
_ROLES = "['secret', 'id', 'secret', 'id', 'secret', 'place']"
ORACLES["op4_secret_scan"] = f"""
WITH t AS (SELECT doc_id AS id, COALESCE(text, '') AS text FROM documents), base AS ({" UNION ALL ".join(_parts(*x) for x in _ALL[: len(BASE)])}), maybe AS ({" UNION ALL ".join(_parts(*x) for x in _ALL[len(BASE) :])}),
 weak AS (SELECT * FROM maybe w WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.id = w.id AND b.s < w.e AND w.s < b.e)), every AS (SELECT *, {_ROLES}[k + 1] AS role FROM (SELECT * FROM base UNION ALL SELECT * FROM weak)),
 linked AS (SELECT DISTINCT w.id, w.s, w.k, w.e FROM every w JOIN every o ON o.id = w.id AND o.s BETWEEN w.s - {SCOPE} AND w.e + {SCOPE} AND CASE w.role WHEN 'id' THEN o.role = 'secret' WHEN 'place' THEN o.role = 'secret' ELSE o.role <> 'secret' END WHERE w.k >= {len(BASE)}),
 b AS (SELECT id, string_agg({_NAMES}[k + 1] || ':' || s || ':' || e, ',' ORDER BY s, k) AS spans, COUNT(*) FILTER (k = 0) AS n0, COUNT(*) FILTER (k = 1) AS n1, COUNT(*) FILTER (k = 2) AS n2 FROM base GROUP BY id),
 a AS (SELECT id, string_agg({_NAMES}[k + 1] || ':' || s || ':' || e, ',' ORDER BY s, k) AS spans, COUNT(*) FILTER (k >= {len(BASE)}) AS n FROM (SELECT * FROM base UNION ALL SELECT * FROM linked) GROUP BY id)
SELECT t.id AS doc_id, COALESCE(n0, 0) AS n_assign, COALESCE(n1, 0) AS n_access, COALESCE(n2, 0) AS n_hex, sha256(COALESCE(b.spans, '')) AS base_sha256, COALESCE(a.spans, '') AS spans, COALESCE(a.n, 0) AS n_linked FROM t LEFT JOIN b ON b.id = t.id LEFT JOIN a ON a.id = t.id"""


def _fill(level: int) -> str:
    """The water-filling of one level of the tree over the children of each parent."""
    path = ["domain", "lang", "source"][:level]
    own, parents = ", ".join(path), ", ".join(path[:-1])
    by = f"PARTITION BY {parents}" if parents else ""
    weight = {1: "CASE domain WHEN 'domain0' THEN 2 ELSE 1 END", 2: "CASE lang WHEN 'en' THEN 3 WHEN 'de' THEN 2 ELSE 1 END", 3: "1"}[level]
    source = f"(SELECT {own}, SUM(tokens) * 4 AS cap, {weight} AS w FROM leaves GROUP BY {own})"
    budget = f"{source} JOIN b{level - 1} USING ({parents})" if parents else f"{source}, (SELECT SUM(tokens) AS budget FROM leaves)"
    return f"""c{level} AS (SELECT *, COALESCE(SUM(cap) OVER (r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c, SUM(w) OVER (r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ws FROM (SELECT * FROM {budget}) WINDOW r AS ({by} ORDER BY cap / w, {path[-1]})),
 d{level} AS (SELECT *, cap * ws <= w * (budget - c) AS dry FROM c{level}),
 f{level} AS (SELECT *, budget - COALESCE(SUM(CASE WHEN dry THEN cap END) OVER ({by}), 0) AS rest, SUM(CASE WHEN NOT dry THEN w END) OVER ({by}) AS wet, SUM(CASE WHEN dry THEN 0 ELSE w END) OVER ({by} ORDER BY {path[-1]} ROWS UNBOUNDED PRECEDING) AS run FROM d{level}),
 b{level} AS (SELECT {own}, CAST(CASE WHEN dry THEN cap ELSE (run * rest) // wet - ((run - w) * rest) // wet END AS HUGEINT) AS budget FROM f{level})"""


ORACLES["op7_source_mix"] = f"""
WITH k AS (SELECT doc_id, COALESCE(lang, '') AS lang, COALESCE(source, '') AS source, LEN({_WORDS}) AS n_tokens, 'domain' || (COALESCE(TRY_CAST(NULLIF(regexp_extract(source, '([0-9]+)$', 1), '') AS INT), 0) % 4) AS domain FROM documents),
 leaves AS (SELECT domain, lang, source, CAST(SUM(n_tokens) AS HUGEINT) AS tokens FROM k GROUP BY 1, 2, 3), {_fill(1)}, {_fill(2)}, {_fill(3)},
 p AS (SELECT domain, lang, source, CASE WHEN tokens > 0 THEN budget // tokens ELSE 0 END AS epochs, budget - (CASE WHEN tokens > 0 THEN budget // tokens ELSE 0 END) * tokens AS rest FROM leaves JOIN b3 USING (domain, lang, source)),
 o AS (SELECT k.*, epochs, rest, SUM(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5('7:' || epochs || ':' || COALESCE(CAST(doc_id AS VARCHAR), '')), doc_id, n_tokens ROWS UNBOUNDED PRECEDING) - n_tokens AS prior FROM k JOIN p USING (domain, lang, source))
SELECT doc_id, domain, lang, source, n_tokens, CAST(epochs AS BIGINT) AS epochs, CAST(GREATEST(0, LEAST(n_tokens, rest - prior)) AS BIGINT) AS part FROM o"""

_CRC_TABLE = "list_transform(range(256), lambda n: list_reduce(range(8), lambda c, z: xor(c >> 1, 3988292384 * (c & 1)), n))"
ORACLES["op10_sharding"] = f"""
WITH t AS (SELECT {_CRC_TABLE} AS tab), h AS (SELECT doc_id, hex(COALESCE(text, '')) AS h FROM documents),
 y AS (SELECT doc_id, LEN(h) // 2 AS n, list_transform(range(1, LEN(h), 2), lambda i: (instr('0123456789ABCDEF', h[i]) - 1) * 16 + instr('0123456789ABCDEF', h[i + 1]) - 1) AS b FROM h),
 c AS (SELECT doc_id, CAST(n + 1 AS BIGINT) AS size, CAST(xor(CASE WHEN n = 0 THEN 4294967295 ELSE list_reduce(b, lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1]), CAST(4294967295 AS BIGINT)) END, 4294967295) AS BIGINT) AS text_crc32 FROM y, t),
 p AS (SELECT *, SUM(size) OVER (o ROWS UNBOUNDED PRECEDING) - size AS prior, SUM(size) OVER () AS total, ROW_NUMBER() OVER o AS n FROM c WINDOW o AS (ORDER BY doc_id NULLS FIRST, text_crc32, size)),
 s AS (SELECT *, CAST(LEAST(15, prior * 16 // total) AS INT) AS shard FROM p)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, CAST(n - MIN(n) OVER (PARTITION BY shard) AS BIGINT) AS slot, CAST(NULL AS INT) AS grown_shard FROM s"""
