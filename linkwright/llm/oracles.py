"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from itertools import permutations

from linkwright.llm import licenses, mixing, secrets, sharding


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def license_scan() -> str:
    form = "replace(concat(' ', regexp_replace(lower(replace(x, '&', ' and ')), '[^\\p{L}\\p{N}]+', ' ', 'g'), ' '), ' ', '  ')"
    for old, new in licenses.SPELLINGS:
        form = f"replace({form}, {_quoted(old)}, {_quoted(new)})"
    form = f"trim(replace({form}, '  ', ' '))"
    form = f"trim(regexp_replace({form}, {_quoted(licenses.STATEMENT)}, '\\1', 'g'))"
    copyright_line = _quoted(licenses.COPYRIGHT_LINE)
    forms = f"list_filter(list_transform(list_transform(string_split(%s, chr(10)), lambda x: {form}), lambda f: CASE WHEN regexp_matches(f, {copyright_line}) THEN '' ELSE f END), lambda f: f <> '')"
    rows = [(k, t) for k, ts in licenses.TEXTS.items() for t in ts] + [(k, g.format(n)) for k, names in licenses.NAMES.items() for n in names for g in licenses.GRANTS]
    known = ", ".join(f"({_quoted(k)}, {_quoted(t)})" for k, t in rows)
    return f"""WITH k AS (SELECT md5(array_to_string({forms % 't'}, ' ')) AS digest, min(l) AS license FROM (VALUES {known}) v(l, t) GROUP BY 1),
 d AS (SELECT row_number() OVER () AS r, doc_id, {forms % "coalesce(text, '')"} AS forms FROM documents), w AS (SELECT r, doc_id, md5(array_to_string(forms, ' ')) AS text_digest FROM d),
 n AS (SELECT r, list_sort(list(DISTINCT license)) AS ids FROM (SELECT r, md5(unnest(forms)) AS digest FROM d) JOIN k USING (digest) GROUP BY r)
 SELECT doc_id, text_digest, license AS text_license, coalesce(array_to_string(ids, ','), '') AS notice_licenses, coalesce(len(ids), 0)::BIGINT AS n_notices FROM w LEFT JOIN k ON text_digest = digest LEFT JOIN n USING (r)"""


def shards(n: int = 40) -> str:
    state = f"((k * {sharding.JUMP_FACTOR}::HUGEINT + 1) % 18446744073709551616::HUGEINT)"
    jump = "floor((b + 1) * (2147483648.0::DOUBLE / ((s // 8589934592::HUGEINT) + 1)::DOUBLE))::BIGINT"
    walk = f"""{{name}} AS (SELECT doc_id, doc_id::HUGEINT AS k, -1::BIGINT AS b, 0::BIGINT AS j FROM (SELECT DISTINCT doc_id FROM documents) UNION ALL
 SELECT doc_id, s, j, {jump.replace('(b + 1)', '(j + 1)')} FROM (SELECT doc_id, j, {state} AS s FROM {{name}} WHERE j < {{n}}))"""
    last = "SELECT doc_id, max(b)::INT AS {out} FROM {name} GROUP BY doc_id"
    return f"""WITH RECURSIVE {walk.format(name='wa', n=n)}, {walk.format(name='wb', n=n + 1)},
 poly AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i::BIGINT)) AS p),
 d AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) + {sharding.OVERHEAD_BYTES} AS size, hex(encode(coalesce(text, ''))) AS h FROM documents),
 c AS (SELECT doc_id, size, xor(list_reduce(list_transform(range(length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT), lambda a, x: xor(p[(xor(a, x) & 255) + 1], a >> 8), 4294967295::BIGINT), 4294967295::BIGINT) AS text_crc32 FROM d, poly),
 r AS (SELECT c.*, a.shard, b.grown_shard FROM c JOIN ({last.format(name='wa', out='shard')}) a USING (doc_id) JOIN ({last.format(name='wb', out='grown_shard')}) b USING (doc_id))
 SELECT doc_id, size::BIGINT AS size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY substr(md5(concat_ws(':', doc_id, size, text_crc32)), 1, 3), doc_id, size, text_crc32) - 1 AS slot, grown_shard FROM r"""


def jaccard(size: int = 5, percent: int = 80) -> str:
    return f"""WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
 s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {size} THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - {size} + 2), lambda i: array_to_string(w[i:i + {size - 1}], ' ')) END) AS g FROM t),
 n AS (SELECT doc_id, len(g) AS n FROM s), e AS (SELECT doc_id, unnest(g) AS g FROM s), often AS (SELECT g FROM e GROUP BY g HAVING count(*) > 1), k AS (SELECT e.* FROM e JOIN often USING (g)),
 p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM k a JOIN k b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
 l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= {percent} * (x.n + y.n - i)), u AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
 reach AS (SELECT doc_id AS root, doc_id FROM n UNION SELECT root, u.b FROM reach JOIN u ON u.a = reach.doc_id)
 SELECT n.doc_id, n.n::BIGINT AS n_shingles, min(root) AS component_id FROM n JOIN reach USING (doc_id) GROUP BY 1, 2"""


def mix(weights: tuple[int, ...] = (1, 2, 3), blocks: int = 20000, seed: str = "mix-1") -> str:
    most = mixing.MOST_REPEATS
    return f"""WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size, md5(concat_ws(':', '{seed}', doc_id, size)) AS o FROM documents),
 s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source), w AS (SELECT *, {list(weights)}[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(weights)} + 1)::INT] AS weight, sum(source_size) OVER () AS total, {most} * source_size AS cap FROM s),
 c AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY cap / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS share FROM w),
 v AS (SELECT *, cap <= weight * share AS capped, max(CASE WHEN cap > weight * share THEN share END) OVER () AS level FROM c),
 t AS (SELECT source, source_size, total, least(CASE WHEN capped THEN cap::DOUBLE ELSE weight * level END, cap::DOUBLE)::DOUBLE AS target, greatest(1, ceil(total / {blocks}.0))::BIGINT AS block FROM v),
 k AS (SELECT source, target, source_size, block, ceil(total / block::DOUBLE) AS house, unnest(range(0, (1 + least(ceil(target / block), {most} * ceil(source_size / block::DOUBLE) - 1))::BIGINT)) AS k FROM t WHERE target > 0),
 seats AS (SELECT source, block, house, row_number() OVER (ORDER BY target / (2 * k + 1) DESC, source NULLS LAST, k) - 1 AS seat FROM k),
 q AS (SELECT source, count(*) * max(block) AS words FROM seats WHERE seat < house GROUP BY source),
 plan AS (SELECT t.*, least(coalesce(words, 0), {most} * source_size) AS words FROM t LEFT JOIN q ON t.source IS NOT DISTINCT FROM q.source),
 r AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY o, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM d)
 SELECT r.doc_id, r.size, p.source_size, p.target, (CASE WHEN p.source_size > 0 THEN (words // p.source_size) * r.size + least(r.size, greatest(0, words % p.source_size - r.start)) ELSE 0 END)::BIGINT AS taken FROM r JOIN plan p ON r.source IS NOT DISTINCT FROM p.source"""


def secret_scan() -> str:
    """Base spans, and the weak ones beside their complements."""
    part = "SELECT doc_id, r, '{k}' AS kind, {o} AS o, pieces, found, vals FROM (SELECT doc_id, r, regexp_split_to_array(t, {p}) AS pieces, regexp_extract_all(t, {p}) AS found, regexp_extract_all(t, {p}, 1) AS vals FROM d WHERE regexp_matches(t, {p}))"
    every = " UNION ALL ".join(part.format(k=k, o=i, p=_quoted(p)) for i, (k, p) in enumerate({**secrets.BASE, **secrets.WEAK}.items()))
    base = len(secrets.BASE)
    return f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents), m AS ({every}),
 i AS (SELECT *, unnest(range(1, len(found) + 1)) AS i FROM m),
 x AS (SELECT doc_id, r, kind, o, (list_sum(list_transform(pieces[1:i], lambda z: length(z))) + coalesce(list_sum(list_transform(found[1:i - 1], lambda z: length(z))), 0))::BIGINT AS s, length(found[i]) AS n, length(vals[i]) AS v FROM i),
 a AS (SELECT r, kind, o, s, s + n AS e, CASE WHEN kind IN ('access', 'user') THEN 'id' WHEN kind = 'endpoint' THEN 'endpoint' ELSE 'secret' END AS role FROM x WHERE kind <> 'assign' OR v >= {secrets.LEAST_VALUE}),
 b AS (SELECT * FROM a WHERE o < {base}), w AS (SELECT * FROM a WHERE o >= {base} AND NOT EXISTS (SELECT 1 FROM b WHERE b.r = a.r AND a.s < b.e AND b.s < a.e)), y AS (SELECT * FROM b UNION ALL SELECT * FROM w),
 near AS (SELECT w.r, w.kind, w.o, w.s, w.e, w.role, bool_or(y.role = 'id') AS ids, bool_or(y.role = 'secret') AS secrets FROM w JOIN y ON w.r = y.r AND abs(w.s - y.s) <= {secrets.SCOPE} AND w.role <> y.role AND y.role <> 'endpoint' AND (w.e <= y.s OR y.e <= w.s) GROUP BY ALL),
 z AS (SELECT r, kind, o, s, e FROM b UNION ALL SELECT r, kind, o, s, e FROM near WHERE (role <> 'endpoint' AND (ids OR secrets)) OR (ids AND secrets)),
 g AS (SELECT r, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex, coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, o, e) FILTER (o < {base}), '') AS base, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, o, e) AS spans FROM z GROUP BY r)
 SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (r)"""


def lexical_search() -> str:
    terms = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
    return f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {terms} AS w FROM documents), n AS (SELECT r, doc_id, len(w)::BIGINT AS n FROM d WHERE len(w) > 0),
 s AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS total FROM n), e AS (SELECT r, unnest(w) AS t FROM d), tf AS (SELECT r, t, count(*)::BIGINT AS tf FROM e GROUP BY ALL), df AS (SELECT t, count(*)::BIGINT AS df FROM tf GROUP BY t),
 q AS (SELECT DISTINCT item_id, unnest({terms}) AS t FROM benchmark), g AS (SELECT item_id, t, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM q JOIN df USING (t), s),
 x AS (SELECT item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * docs) // total))))::BIGINT AS score FROM g JOIN tf USING (t) JOIN n USING (r), s GROUP BY ALL)
 SELECT item_id, rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank FROM x WHERE score > 0) WHERE rank <= 10"""


def exact_search() -> str:
    return """WITH u AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 d AS (SELECT len(v) AS d FROM u GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1), v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(v, lambda x: floor(256 * x)) AS v FROM u WHERE len(v) = (FROM d)),
 p AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score FROM v q JOIN v c ON q.r <> c.r WHERE q.vec_id % 50 = 0)
 SELECT query_id, rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id)::INT AS rank FROM p) WHERE rank <= 5"""


def filter_audit() -> str:
    """Filters applied one after another to each kind of document, for each order."""
    orders = ", ".join(f"('{''.join(p)}')" for p in permutations("ABCDE"))
    return f"""WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents), w AS (SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w, min(doc_id) OVER (PARTITION BY t) AS first FROM t),
 l AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id),
 f AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, concat(CASE WHEN len(w) < 200 THEN 'A' ELSE '' END, CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END, CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) THEN 'C' ELSE '' END,
  CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END, CASE WHEN w.doc_id > first THEN 'E' ELSE '' END) AS fails FROM w LEFT JOIN l USING (doc_id)),
 k AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY 1, 2),
 s AS (SELECT filter_order, unnest(range(1, 6)) AS step FROM (VALUES {orders}) v(filter_order)), o AS (SELECT *, filter_order[step] AS letter, CASE WHEN step > 1 THEN filter_order[1:step - 1] ELSE '' END AS before FROM s),
 a AS (SELECT k.*, o.*, contains(fails, letter) AS own, len(list_filter(string_split(before, ''), lambda x: x <> '' AND contains(fails, x))) > 0 AS gone FROM k, o),
 r AS (SELECT part, filter_order, step, letter, coalesce(sum(n) FILTER (NOT own AND NOT gone), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (own AND NOT gone), 0)::BIGINT AS removed, coalesce(sum(n) FILTER (own AND gone), 0)::BIGINT AS redundant,
  coalesce(sum(n) FILTER (fails = letter), 0)::BIGINT AS unique_fails, coalesce(sum(good) FILTER (own AND NOT gone), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (own AND NOT gone), 0)::BIGINT AS toxic_lost FROM a GROUP BY 1, 2, 3, 4)
 SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley FROM r"""


def oracle_sql() -> dict[str, str]:
    return {"op3_license_scan": license_scan(), "op4_sharding": shards(), "op5_jaccard_join": jaccard(), "op6_mixing": mix(), "op9_secret_scan": secret_scan(), "op11_lexical_search": lexical_search(), "op12_exact_search": exact_search(), "op13_filter_audit": filter_audit()}


