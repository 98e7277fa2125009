"""SQL twins (DuckDB) of the queries that SQL can express."""

from __future__ import annotations

from cohortry.llm import fingerprints, licenses, quality

WORD = r"[^\x20\x09-\x0D]+"


def _op1() -> str:
    rules = {**{m: rule[0] for m, rule in quality.METRICS.items()}, **{c: c for c in quality.SIZES}}
    metrics = " UNION ALL ".join(f"SELECT doc_id, l, s, '{m}' AS metric, {e.replace(' div ', ' // ')} AS v FROM counts" for m, e in rules.items())
    sizes = ", ".join(f"('{m}', '{size}', {parts * events})" for m, (_, size, parts, events) in quality.METRICS.items())

    def fences(least: int, *keys: str) -> str:
        by = ", ".join([*keys, "metric"])
        using = ", ".join([*keys, "size"])
        return f"""SELECT {", ".join(["q." + k for k in keys] + ["q.metric"])}, CASE WHEN q.total >= {least}
            THEN q.mid + {quality.SPREADS} * (q.mid - q.low) + room.n // greatest(z.mid, 1) END AS f
          FROM (SELECT {by}, MAX(total) AS total, MIN(CASE WHEN below * 100 >= total * 50 THEN top END) AS mid, MIN(CASE WHEN below * 100 >= total * 10 THEN top END) AS low
            FROM (SELECT {by}, top, SUM(COUNT(*)) OVER (PARTITION BY {by}) AS total, SUM(COUNT(*)) OVER (PARTITION BY {by} ORDER BY top) AS below
              FROM sketched GROUP BY {by}, top) GROUP BY {by}) q
          JOIN (VALUES {sizes}) room(metric, size, n) USING (metric)
          JOIN (SELECT {by.replace("metric", "metric AS size")}, MIN(CASE WHEN below * 100 >= total * 50 THEN top END) AS mid
            FROM (SELECT {by}, top, SUM(COUNT(*)) OVER (PARTITION BY {by}) AS total, SUM(COUNT(*)) OVER (PARTITION BY {by} ORDER BY top) AS below
              FROM sketched GROUP BY {by}, top) GROUP BY {by}) z USING ({using})"""

    return rf"""WITH d AS (SELECT doc_id, COALESCE(lang, '') AS l, COALESCE(source, '') AS s, COALESCE(text, '') AS t FROM documents),
    w AS (SELECT doc_id, l, s, t, regexp_extract_all(t, '{WORD}') AS words,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS lines FROM d),
    spot AS (SELECT doc_id, generate_subscripts(words, 1) AS i, unnest(words) AS a FROM w),
    five AS (SELECT doc_id, i, a || ' ' || lead(a, 1) OVER o || ' ' || lead(a, 2) OVER o || ' ' || lead(a, 3) OVER o || ' ' || lead(a, 4) OVER o AS g
        FROM spot WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
    win AS (SELECT doc_id, i, COUNT(*) OVER (PARTITION BY doc_id, g) AS n FROM five WHERE g IS NOT NULL),
    rep AS (SELECT doc_id, COUNT(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM win WHERE n > 1) GROUP BY ALL),
    counts AS MATERIALIZED (SELECT w.doc_id, l, s, len(words)::BIGINT AS n_words, COALESCE(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
        length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
        COALESCE(rep.n, 0)::BIGINT AS n_repeat_words, len(lines)::BIGINT AS n_lines, length(regexp_replace(t, '[^A-Z]', '', 'g'))::BIGINT AS n_upper,
        length(regexp_replace(t, '[^!]', '', 'g'))::BIGINT AS n_bangs FROM w LEFT JOIN rep ON rep.doc_id = w.doc_id),
    judged AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM counts),
    v AS MATERIALIZED ({metrics}),
    e AS (SELECT v.*, greatest(length(bin(v.v)) - 6, 0) AS p FROM v JOIN judged j ON j.doc_id = v.doc_id WHERE NOT base_failed),
    sketched AS MATERIALIZED (SELECT l, s, metric, (((v >> p) + 1) << p) - 1 AS top FROM e),
    own AS ({fences(quality.LEAST_DOCUMENTS, "l", "s")}), tongue AS ({fences(quality.LEAST_DOCUMENTS, "l")}), overall AS ({fences(1)}),
    limits AS (SELECT own.l, own.s, own.metric, COALESCE(own.f, tongue.f, overall.f) AS f FROM own
        JOIN tongue ON tongue.l = own.l AND tongue.metric = own.metric JOIN overall ON overall.metric = own.metric),
    broken AS (SELECT DISTINCT v.doc_id FROM v JOIN limits ON limits.l = v.l AND limits.s = v.s AND limits.metric = v.metric WHERE v.v > f)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
      NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM broken) AS kept FROM judged"""


OP4 = rf"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
      'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS words FROM documents),
  tok AS (SELECT doc_id, len(words) AS n, generate_subscripts(words, 1) AS i, unnest(words) AS a FROM w),
  three AS (SELECT doc_id, n, i, a || COALESCE(' ' || lead(a, 1) OVER o, '') || COALESCE(' ' || lead(a, 2) OVER o, '') AS g
      FROM tok WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
  x AS MATERIALIZED (SELECT DISTINCT doc_id, g FROM three WHERE i <= greatest(n - 2, 1)),
  size AS MATERIALIZED (SELECT w.doc_id, COUNT(g) AS n FROM w LEFT JOIN x ON x.doc_id = w.doc_id GROUP BY ALL),
  pair AS (SELECT a.doc_id AS a, b.doc_id AS b, COUNT(*) AS c FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
  link AS (SELECT a, b FROM pair JOIN size p ON p.doc_id = a JOIN size q ON q.doc_id = b WHERE 100 * c >= 85 * (p.n + q.n - c)),
  edge AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
  reach AS (SELECT doc_id AS a, doc_id AS r FROM size UNION SELECT edge.b, reach.r FROM reach JOIN edge ON edge.a = reach.a)
  SELECT size.doc_id, n AS n_shingles, MIN(r) AS component_id, MIN(r) = size.doc_id AS kept
  FROM size JOIN reach ON reach.a = size.doc_id GROUP BY size.doc_id, n"""

OP5 = """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
  s AS (SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.e, b.e) AS score FROM v a JOIN v b
      ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE a.vec_id % 20 = 0),
  r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s)
  SELECT query_id, n::INT AS rank, vec_id, score FROM r WHERE n <= 20"""

_DIGIT = " + ".join(f"substr(bits, 5 * i + {k + 1}, 1)::INT * {16 >> k}" for k in range(5))
OP6 = f"""WITH p AS (SELECT page_id, octet_length(encode(COALESCE(html, '')))::BIGINT AS payload_bytes,
      unhex(sha1(COALESCE(html, '')))::BIT::VARCHAR AS bits FROM pages),
  q AS (SELECT page_id, payload_bytes, array_to_string(list_transform(range(32),
      lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + {_DIGIT}, 1)), '') AS payload_digest FROM p),
  f AS (SELECT *, MIN(page_id) OVER (PARTITION BY payload_digest) AS first FROM q)
  SELECT page_id, payload_bytes, payload_digest, CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN first <> page_id THEN first END AS refers_to FROM f"""


def _op10() -> str:
    rows = ", ".join(
        f"({k}, '{name}', {licenses.bigrams_of(text)!r})" for k, (name, text) in enumerate(licenses.TEMPLATES.items())
    )
    return f"""WITH t(k, name, g) AS (VALUES {rows}),
  d AS (SELECT doc_id, translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x FROM documents),
  u AS (SELECT doc_id, 0 AS part, x FROM d WHERE contains(x, chr(10)) UNION ALL
      SELECT doc_id, unnest(range(1, len(lines) + 1)), unnest(lines) FROM (SELECT doc_id, string_split(x, chr(10)) AS lines FROM d)),
  w AS (SELECT doc_id, part, regexp_extract_all(x, '[a-z0-9]+') AS words FROM u),
  g AS (SELECT doc_id, part, list_distinct(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) AS g FROM w WHERE len(words) > 1),
  s AS (SELECT doc_id, part, k, name, 2.0::DOUBLE * len(list_intersect(g.g, t.g)) / (len(g.g) + len(t.g)) AS dice
      FROM g JOIN t ON len(g.g) BETWEEN 1 AND 500),
  hit AS (SELECT doc_id, part, arg_max(name, [dice, -k]) AS name, MAX(dice) AS dice FROM s WHERE dice >= {licenses.LEAST} GROUP BY ALL)
  SELECT d.doc_id, COALESCE(string_agg(DISTINCT name, ',' ORDER BY name), '') AS licenses, COUNT(name) AS n_units,
    COALESCE(ROUND(MAX(dice), 6), 0.0::DOUBLE) AS best FROM d LEFT JOIN hit ON hit.doc_id = d.doc_id GROUP BY d.doc_id"""


def _op13() -> str:
    def sketch(text: str) -> str:
        words = f"regexp_extract_all(translate({text}, '{fingerprints.UPPER}', '{fingerprints.LOWER}'), '{WORD}')"
        grams = f"""list_transform(range(1, greatest(len(w) - {fingerprints.WIDTH - 1}, 1) + 1),
          lambda i: md5(array_to_string(w[i:i + {fingerprints.WIDTH - 1}], ' '))[1:{fingerprints.DIGITS}])"""
        return f"(SELECT CASE WHEN len(w) = 0 THEN [] ELSE list_sort(list_distinct({grams}))[1:{fingerprints.SIZE}] END FROM (SELECT {words} AS w))"

    def near(a: str, b: str) -> str:
        return f"""(SELECT CASE WHEN len(u) = 0 THEN 1.0::DOUBLE ELSE len(list_filter(u, lambda x: list_contains({a}, x) AND list_contains({b}, x)))
          / len(u)::DOUBLE END FROM (SELECT list_sort(list_distinct(list_concat({a}, {b})))[1:{fingerprints.SIZE}] AS u))"""

    return f"""WITH d AS (SELECT doc_id, COALESCE(text, '') AS t FROM documents),
  n AS (SELECT *, COALESCE(lead(t) OVER o, first_value(t) OVER o) AS following FROM d WINDOW o AS (ORDER BY doc_id NULLS FIRST, t)),
  e AS (SELECT doc_id, t, following, left(t, length(t) - length(t) // 2) || left(following, length(t) // 2) AS edited FROM n),
  k AS MATERIALIZED (SELECT doc_id, length(t)::BIGINT AS n_chars, sha256(edited) AS edited_sha256, {sketch("t")} AS a, {sketch("edited")} AS b,
      {sketch("following")} AS c FROM e)
  SELECT doc_id, n_chars, edited_sha256, array_to_string(a, '') AS fingerprint, array_to_string(b, '') AS edited_fingerprint,
    {near("a", "b")} AS near_edited, {near("a", "c")} AS near_next FROM k"""


def _op12() -> str:
    def field(x: str) -> str:
        return f"COALESCE(octet_length(encode({x}::VARCHAR))::VARCHAR || ':' || {x}::VARCHAR, '-')"

    def leaf(text: str) -> str:
        return f"sha256({' || '.join(map(field, ['doc_id', 'source', 'lang', 'n_chars', text]))})"

    bits = "list_reduce(list_prepend(xor(c, x), range(8)), lambda b, k: CASE WHEN b & 1 = 1 THEN xor(b >> 1, 3988292384) ELSE b >> 1 END)"
    codes = "list_transform(string_split(doc_id::VARCHAR, ''), lambda d: ascii(d)::BIGINT)"
    crc = f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda c, x: {bits}), 4294967295)"

    def tree(name: str, start: str) -> str:
        return f"""{name} AS ({start} UNION ALL SELECT s, level + 1, i // 3, (any_value(n) + 2) // 3, sha256(string_agg(h, '' ORDER BY i))
          FROM {name} WHERE n > 1 GROUP BY s, level, i // 3)"""

    def steps(offset: int, i: str, nodes: str, same: str) -> str:
        return f"""SELECT doc_id, x.level + {offset} AS step, x.i AS pos, x.h, x.i = l.{i} // (3 ** x.level)::BIGINT AS mine, x.i < l.{i} // (3 ** x.level)::BIGINT AS left_one
          FROM l JOIN {nodes} x ON {same} AND x.n > 1 AND x.i // 3 = l.{i} // (3 ** (x.level + 1))::BIGINT"""

    return f"""WITH RECURSIVE leafs AS (SELECT doc_id, source AS s, row_number() OVER o - 1 AS i, COUNT(*) OVER (PARTITION BY source) AS n, {leaf("text")} AS leaf,
      CASE WHEN {crc} % 2 = 0 THEN {leaf("replace(text, chr(10), '')")} ELSE {leaf("text")} END AS other
      FROM documents WINDOW o AS (PARTITION BY source ORDER BY doc_id)),
  {tree("one", "SELECT s, 0 AS level, i, n, leaf AS h FROM leafs")},
  subs AS (SELECT s AS source, h AS subroot, row_number() OVER (ORDER BY s NULLS FIRST) - 1 AS place, COUNT(*) OVER () AS n FROM one WHERE n = 1),
  {tree("two", "SELECT NULL::VARCHAR AS s, 0 AS level, place AS i, n, subroot AS h FROM subs")},
  l AS MATERIALIZED (SELECT leafs.*, subroot, place FROM leafs JOIN subs ON s IS NOT DISTINCT FROM source),
  steps AS MATERIALIZED ({steps(0, "i", "one", "x.s IS NOT DISTINCT FROM l.s")} UNION ALL {steps(100, "place", "two", "true")}),
  sides AS MATERIALIZED (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY step) AS k,
      COALESCE(string_agg(h, '' ORDER BY pos) FILTER (WHERE left_one), '') AS a, COALESCE(string_agg(h, '' ORDER BY pos) FILTER (WHERE NOT left_one AND NOT mine), '') AS b
      FROM steps GROUP BY doc_id, step),
  folds AS (SELECT doc_id, 0::BIGINT AS k, other AS h FROM l UNION ALL
      SELECT folds.doc_id, folds.k + 1, sha256(a || h || b) FROM folds JOIN sides ON sides.doc_id = folds.doc_id AND sides.k = folds.k + 1),
  folded AS (SELECT doc_id, arg_max(h, k) AS folded_root FROM folds GROUP BY doc_id),
  proofs AS (SELECT doc_id, sha256(string_agg(a || b, '' ORDER BY k)) AS proof_sha256 FROM sides GROUP BY doc_id)
  SELECT l.doc_id, leaf, subroot, h AS root, COALESCE(proof_sha256, sha256('')) AS proof_sha256, folded_root, folded_root = h AS verified
  FROM l JOIN folded ON folded.doc_id = l.doc_id LEFT JOIN proofs ON proofs.doc_id = l.doc_id, (SELECT h FROM two WHERE n = 1)"""


TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_TERMS = f"""unnest(regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM}'))"""
OP11 = f"""WITH p AS (SELECT doc_id, t, COUNT(*) AS tf FROM (SELECT doc_id, {_TERMS} AS t FROM documents) GROUP BY ALL),
  d AS (SELECT doc_id, SUM(tf)::BIGINT AS n FROM p GROUP BY ALL), c AS (SELECT COUNT(*) AS n, SUM(n)::BIGINT AS l FROM d),
  w AS (SELECT t, floor(1000 * ln((2 * c.n + 2)::DOUBLE / (2 * COUNT(*) + 1)::DOUBLE))::BIGINT AS w FROM p, c GROUP BY t, c.n),
  q AS (SELECT item_id, t, COUNT(*) AS times FROM (SELECT item_id, {_TERMS} AS t FROM benchmark) GROUP BY ALL),
  s AS (SELECT item_id, p.doc_id, SUM(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * d.n * c.n) // c.l))))::BIGINT AS score
    FROM q JOIN w ON w.t = q.t JOIN p ON p.t = q.t JOIN d ON d.doc_id = p.doc_id, c GROUP BY ALL),
  r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS n FROM s WHERE score > 0)
  SELECT item_id, n::INT AS rank, doc_id, score FROM r WHERE n <= 10"""


ORACLES = {
    "op1_quality_rules": _op1(),
    "op4_bottom_k_duplicates": OP4,
    "op5_vantage_point_trees": OP5,
    "op6_warc_revisits": OP6,
    "op10_license_scan": _op10(),
    "op11_ranked_search": OP11,
    "op12_merkle_manifest": _op12(),
    "op13_fingerprints": _op13(),
}
