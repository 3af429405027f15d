"""SQL twins (DuckDB) of those operator queries that SQL can express."""

from __future__ import annotations

from . import secret_scan

WORD = r"[^\x20\x09-\x0D]+"


def ngram_components(n: int, num: int, den: int) -> str:
    """Components of n-word shingle sets at similarity num / den."""
    return rf"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w FROM documents),
      s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {n} THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - {n - 2}), lambda i: array_to_string(list_slice(w, i, i + {n - 1}), ' ')) END) AS g FROM w),
      n AS (SELECT w.doc_id, count(g) AS n FROM w LEFT JOIN s ON s.doc_id = w.doc_id GROUP BY w.doc_id),
      p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
      l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE {den} * shared >= {num} * (x.n + y.n - shared)),
      r AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
      SELECT n.doc_id, any_value(n.n) AS n_shingles, min(r.b) AS component_id FROM n JOIN r ON r.a = n.doc_id GROUP BY n.doc_id"""


def secret_spans() -> str:
    """Spans of all rules: the pieces between matches give the positions."""
    parts = []
    for order, rule in enumerate(secret_scan.BASE + secret_scan.MORE):
        pattern = rule.pattern.replace("'", "''")
        parts.append(
            f"""SELECT doc_id, {order} AS ord, '{rule.kind}' AS kind, i,
              list_sum(list_transform(list_slice(gaps, 1, i), lambda x: length(x))) + coalesce(list_sum(list_transform(list_slice(m, 1, i - 1), lambda x: length(x))), 0) AS start, length(m[i]) AS n, length(g[i]) AS gn
              FROM (SELECT doc_id, m, g, gaps, unnest(range(1, len(m) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(t, '{pattern}') AS m, regexp_extract_all(t, '{pattern}', {rule.group}) AS g, string_split_regex(t, '{pattern}') AS gaps FROM d))
              WHERE length(g[i]) >= {rule.least}"""
        )
    base = len(secret_scan.BASE)
    counts = ", ".join(f"count(*) FILTER (WHERE kind = '{r.kind}') AS n_{r.kind}" for r in secret_scan.BASE)
    span = "concat(kind, ':', CAST(start AS BIGINT), ':', CAST(start + n AS BIGINT))"
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), s AS ({" UNION ALL ".join(parts)})
      SELECT d.doc_id, {counts}, sha256(coalesce(string_agg({span}, ',' ORDER BY start, ord) FILTER (WHERE ord < {base}), '')) AS base_sha256,
        coalesce(string_agg({span}, ',' ORDER BY start, ord) FILTER (WHERE kind IS NOT NULL), '') AS spans
      FROM d LEFT JOIN s ON s.doc_id = d.doc_id GROUP BY d.doc_id"""


def host_verdicts() -> str:
    """Counts, the beta prior of each rule, the factors of the soft limits, and verdicts."""
    word = r"[^\x20\x09-\x0D]+"
    rules = ("symbols", "long_words", "short_words", "lines")
    sums = ", ".join(f"count(*) FILTER (WHERE b_{r}) AS k_{r}" for r in (*rules, "any"))
    moments = ", ".join(f"sum(k_{r}) / sum(hd) AS m_{r}, coalesce(var_samp(k_{r} / hd), 0) AS v_{r}" for r in (*rules, "any"))
    weights = ", ".join(f"greatest(2, least(1e6, m_{r} * (1 - m_{r}) / greatest(v_{r} - m_{r} * (1 - m_{r}) * i, 1e-9) - 1)) AS s_{r}" for r in (*rules, "any"))
    rates = ", ".join(f"(k_{r} + m_{r} * s_{r}) / (hd + s_{r}) AS p_{r}" for r in (*rules, "any"))
    factors = ", ".join(f"round(CASE WHEN m_{r} > 0 AND m_{r} < 1 THEN greatest(0.5, least(2, m_{r} / (1 - m_{r}) * (1 - p_{r}) / p_{r})) ELSE 1 END, 6) AS f_{r}" for r in rules)
    return rf"""WITH d AS (SELECT doc_id, source AS host, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{word}') AS w FROM documents),
      ln AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d), lc AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM ln WHERE regexp_matches(line, '{word}') GROUP BY doc_id),
      g AS (SELECT doc_id, i, concat(w[i], ' ', w[i + 1], ' ', w[i + 2]) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
      h AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1), k AS (SELECT doc_id, count(DISTINCT i + o) AS n_repeat_words FROM h, range(0, 3) t(o) GROUP BY doc_id),
      c AS (SELECT d.doc_id, host, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
        coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words FROM d LEFT JOIN lc ON lc.doc_id = d.doc_id LEFT JOIN k ON k.doc_id = d.doc_id),
      x AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, n_symbols / greatest(n_words, 1) AS x_symbols, word_chars / greatest(n_words, 1) AS x_long_words,
        n_words / greatest(word_chars, 1) AS x_short_words, n_dup_lines / greatest(n_lines, 1) AS x_lines FROM c),
      f AS (SELECT *, base_failed OR b_symbols OR b_long_words OR b_short_words OR b_lines AS b_any
        FROM (SELECT *, x_symbols > 0.1e0 AS b_symbols, x_long_words > 20 AS b_long_words, x_short_words > 0.55e0 AS b_short_words, x_lines > 0.5e0 AS b_lines FROM x)),
      o AS (SELECT host, count(*) AS hd, {sums} FROM f GROUP BY host), q AS (SELECT avg(1 / hd) AS i, {moments} FROM o), p AS (SELECT *, {weights} FROM q),
      r AS (SELECT *, {rates} FROM o, p), z AS (SELECT host, p_any, {factors} FROM r),
      y AS (SELECT *, CASE WHEN p_any >= 0.95 THEN 'banned' WHEN least(f_symbols, f_long_words, f_short_words, f_lines) < 0.8 THEN 'strict'
        WHEN greatest(f_symbols, f_long_words, f_short_words, f_lines) > 1.25 THEN 'lenient' ELSE 'keep' END AS host_verdict FROM z)
      SELECT doc_id, n_words, CAST(word_chars AS BIGINT) AS word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, host_verdict,
        NOT (base_failed OR host_verdict = 'banned' OR x_symbols > 0.1e0 * f_symbols OR x_long_words > 20 * f_long_words OR x_short_words > 0.55e0 * f_short_words OR x_lines > 0.5e0 * f_lines) AS kept
      FROM f JOIN y ON f.host IS NOT DISTINCT FROM y.host"""


def crc32(text: str) -> str:
    """Unsigned CRC-32 of an ASCII text, bit by bit."""
    step = "list_reduce([{x}, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: xor(a >> 1, 3988292384 * (a & 1)))"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({text}, ''), lambda s: ascii(s)::BIGINT)), lambda c, y: {step.format(x='xor(c, y)')}), 4294967295)"


def repaired_conversations() -> str:
    """A dynamic programme over rows: for every row and grammar state the least (cost, audit), insertions after each row."""
    space = r"[^\x20\x09-\x0D]"
    kept = "(0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)"
    inserts = "(0, 0, ''), (0, 2, 'I'), (0, 3, 'II'), (1, 1, ''), (1, 2, 'I'), (1, 3, 'II'), (2, 2, ''), (2, 3, 'I'), (3, 3, ''), (3, 2, 'I')"
    return rf"""WITH RECURSIVE d AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
        {crc32("concat(coalesce(CAST(conv_id AS VARCHAR), ' '), ':', coalesce(CAST(turn AS VARCHAR), ' '))")} % 20 AS k FROM conversations),
      f AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
        FROM d, range(CASE k WHEN 3 THEN 2 WHEN 0 THEN 0 ELSE 1 END) c(i)),
      o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, role[1] AS ini FROM f),
      x AS (SELECT *, CASE WHEN NOT regexp_matches(text, '{space}') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
          WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' ELSE '' END AS fault,
        NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') AS cut, concat(lag(ini) OVER (PARTITION BY conv_id ORDER BY i), ini) NOT IN ('su', 'ua', 'au') AND i > 1 AS bad FROM o),
      ins AS (SELECT * FROM (VALUES {inserts}) v(s, s2, a)), keep AS (SELECT * FROM (VALUES {kept}) v(s, ini, s2)),
      ed AS (SELECT 'D' AS e, s, NULL AS ini, s AS s2, 2 AS c FROM range(4) t(s) UNION ALL SELECT 'K', s, ini, s2, 0 FROM keep UNION ALL SELECT 'R', s, NULL, CASE s WHEN 2 THEN 3 ELSE 2 END, 1 FROM range(4) t(s)),
      ids AS (SELECT DISTINCT conv_id FROM conversations),
      r AS (SELECT conv_id, 0::BIGINT AS i, s2 AS s, {{'c': 5 * len(a), 'a': a}} AS b FROM ids, ins WHERE s = 0
        UNION ALL SELECT r.conv_id, x.i, ins.s2, min({{'c': r.b.c + ed.c + 5 * len(ins.a) + CASE WHEN ed.e <> 'D' AND cut THEN 5 ELSE 0 END, 'a': concat(r.b.a, ed.e, ins.a)}})
          FROM r JOIN x ON r.conv_id IS NOT DISTINCT FROM x.conv_id AND x.i = r.i + 1 JOIN ed ON ed.s = r.s AND (ed.ini IS NULL OR ed.ini = x.ini) AND (ed.e = 'D' OR x.fault NOT IN ('blank', 'duplicate')) JOIN ins ON ins.s = ed.s2
          GROUP BY r.conv_id, x.i, ins.s2),
      n AS (SELECT ids.conv_id, count(x.i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank,
        count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated, count(*) FILTER (WHERE bad) AS illegal
        FROM ids LEFT JOIN x ON x.conv_id IS NOT DISTINCT FROM ids.conv_id GROUP BY ids.conv_id),
      w AS (SELECT n.conv_id, min(r.b) AS b FROM n JOIN r ON r.conv_id IS NOT DISTINCT FROM n.conv_id AND r.i = n.n AND r.s IN (0, 3) GROUP BY n.conv_id),
      l AS (SELECT conv_id, j, b.a[j] AS e, len(replace(b.a[1:j], 'I', '')) AS i, len(replace(b.a[1:j], 'D', '')) AS p FROM (SELECT conv_id, b, unnest(range(1, len(b.a) + 1)) AS j FROM w)),
      m AS (SELECT l.*, x.role, CASE WHEN e = 'I' THEN '' ELSE x.text END AS text, max(CASE WHEN p = 1 AND e = 'K' AND x.ini = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY l.conv_id) AS sys
        FROM l LEFT JOIN x ON x.conv_id IS NOT DISTINCT FROM l.conv_id AND x.i = l.i WHERE e <> 'D'),
      t AS (SELECT conv_id, string_agg(concat(CASE WHEN e = 'K' THEN role WHEN (p - sys) % 2 = 1 THEN 'user' ELSE 'assistant' END, ':', text), chr(10) ORDER BY j) AS t FROM m GROUP BY conv_id)
      SELECT n.conv_id, gaps, blank, duplicate, truncated, illegal, CAST(w.b.c AS BIGINT) AS cost, w.b.a AS audit, sha256(coalesce(t.t, '')) AS repaired_sha256
      FROM n JOIN w ON w.conv_id IS NOT DISTINCT FROM n.conv_id LEFT JOIN t ON t.conv_id IS NOT DISTINCT FROM n.conv_id"""


def merkle_manifest() -> str:
    """Levels by recursion, siblings by joins, and the fold over them."""
    field = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE concat(strlen(CAST({c} AS VARCHAR)), ':', CAST({c} AS VARCHAR)) END"
    leaf = lambda n: f"sha256(concat({', '.join(map(field, ('doc_id', 'source', 'lang', n, 'text')))}))"
    return f"""WITH RECURSIVE a AS (SELECT row_number() OVER () AS rid, doc_id, lang, {leaf("n_chars")} AS leaf,
        CASE WHEN {crc32("CAST(doc_id AS VARCHAR)")} % 7 = 0 THEN {leaf("(n_chars + 1)")} END AS tampered FROM documents),
      d AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf, rid) - 1 AS i FROM a),
      t AS (SELECT lang, 0 AS lvl, i, leaf AS h, count(*) OVER (PARTITION BY lang) AS n FROM d
        UNION ALL SELECT lang, lvl + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), any_value((n + 1) // 2) FROM t WHERE n > 1 GROUP BY lang, lvl, i // 2),
      g AS (SELECT lang, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i FROM t WHERE n = 1),
      u AS (SELECT 0 AS lvl, i, subroot AS h, count(*) OVER () AS n FROM g UNION ALL SELECT lvl + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), any_value((n + 1) // 2) FROM u WHERE n > 1 GROUP BY lvl, i // 2),
      p AS (SELECT rid, l.lvl AS s, (d.i >> l.lvl) & 1 AS odd, t.h FROM d JOIN (SELECT DISTINCT lang, lvl FROM t WHERE n > 1) l ON l.lang IS NOT DISTINCT FROM d.lang
          LEFT JOIN t ON t.lang IS NOT DISTINCT FROM d.lang AND t.lvl = l.lvl AND t.i = xor(d.i >> l.lvl, 1)
        UNION ALL SELECT rid, 1000 + l.lvl, (g.i >> l.lvl) & 1, u.h FROM d JOIN g ON g.lang IS NOT DISTINCT FROM d.lang CROSS JOIN (SELECT DISTINCT lvl FROM u WHERE n > 1) l LEFT JOIN u ON u.lvl = l.lvl AND u.i = xor(g.i >> l.lvl, 1)),
      q AS (SELECT rid, string_agg(h, '' ORDER BY s) AS proof, list(CASE WHEN h IS NULL THEN 'N' WHEN odd = 1 THEN concat('L', h) ELSE concat('R', h) END ORDER BY s) AS steps FROM p GROUP BY rid),
      e AS (SELECT doc_id, leaf, subroot, (SELECT h FROM u WHERE n = 1) AS root, sha256(coalesce(proof, '')) AS proof_sha256,
        list_reduce(list_prepend(coalesce(tampered, leaf), coalesce(steps, [])), lambda x, y: sha256(CASE y[1] WHEN 'L' THEN concat(y[2:], x) WHEN 'R' THEN concat(x, y[2:]) ELSE x END)) AS folded_root
        FROM d JOIN g ON g.lang IS NOT DISTINCT FROM d.lang LEFT JOIN q ON q.rid = d.rid)
      SELECT *, folded_root = root AS verified FROM e"""
