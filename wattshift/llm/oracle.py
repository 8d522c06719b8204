"""SQL counterparts of the queries that SQL can express."""

from __future__ import annotations

from wattshift.llm.line_dedup import MIN_PAGES, RATIO
from wattshift.llm.quality_rules import RULES, RiskParams, settings

_RISK = RiskParams()
_STEPS = ",\n".join(f"({i}, " + ", ".join(f"{c}::DOUBLE" for c in step) + ")" for i, step in enumerate(settings()))
_MAX = ", ".join(f"max_{rule}" for rule in RULES)
_FAILS = " OR ".join(f"{measure} > max_{rule}" for rule, (measure, _) in RULES.items())


def _tail(k: str, n: str) -> str:
    return f"""CASE WHEN {k} < {n} * q THEN list_sum(list_transform(range(0, {k} + 1), lambda j: exp(lgamma({n} + 1)
      - (CASE WHEN j = 0 THEN 0 ELSE lgamma(j + 1) END) - lgamma({n} - j + 1) + j * ln(q) + ({n} - j) * ln(1 - q)))) ELSE 1 END"""


OP3 = rf"""
WITH t AS (SELECT doc_id, coalesce(lang, '?') AS stratum, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, stratum, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM t),
grams AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, unnest(list_transform(range(1, len(w) - 1),
            lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g FROM w WHERE len(w) >= 3),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM grams) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM twice, (VALUES (0), (1), (2)) AS x(o) GROUP BY doc_id),
m AS (SELECT w.doc_id, stratum, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
        (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
        (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')))::BIGINT AS n_upper,
        len(l) AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words
      FROM w LEFT JOIN rep USING (doc_id)),
s AS (SELECT *, CASE WHEN n_words > 0 THEN n_symbols / n_words ELSE 0 END AS symbol_ratio,
        CASE WHEN word_chars > 0 THEN n_upper / word_chars ELSE 0 END AS upper_ratio,
        CASE WHEN n_words > 0 THEN n_repeat_words / n_words ELSE 0 END AS repeat_ratio,
        CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines ELSE 0 END AS dup_line_ratio,
        (n_words < {_RISK.min_words} OR 100 * n_repeat_words > {_RISK.max_repeat} * n_words) AS base_failed FROM m),
steps(i, {_MAX}) AS (VALUES {_STEPS}),
good AS (SELECT doc_id FROM labels GROUP BY doc_id HAVING min(quality) = 1),
hold AS (SELECT * FROM s WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM good)),
tests AS (SELECT a.stratum, i, count(h.doc_id) AS n, count(h.doc_id) FILTER (WHERE {_FAILS}) AS k
          FROM (SELECT DISTINCT stratum FROM s) a CROSS JOIN steps LEFT JOIN hold h ON h.stratum = a.stratum GROUP BY ALL),
pool AS (SELECT i, sum(n)::BIGINT AS all_n, sum(k)::BIGINT AS all_k, count(*) FILTER (WHERE n > 0) AS strata FROM tests GROUP BY i),
p AS (SELECT *, {_RISK.risk}::DOUBLE AS q, {_RISK.error}::DOUBLE / (strata + 1) AS level FROM tests JOIN pool USING (i)),
tail AS (SELECT *, {_tail('k', 'n')} <= level AS own, {_tail('all_k', 'all_n')} <= level AND k <= q * n AS pooled FROM p),
held AS (SELECT stratum, i, min(own::INT) OVER w AS own, min(pooled::INT) OVER w AS pooled FROM tail WINDOW w AS (PARTITION BY stratum ORDER BY i)),
cuts AS (SELECT stratum, {_MAX} FROM steps JOIN (SELECT stratum, coalesce(max(i) FILTER (WHERE own = 1), max(i) FILTER (WHERE pooled = 1)) AS i
           FROM held GROUP BY stratum) USING (i)),
j AS (SELECT s.*, {', '.join(f"coalesce({m} > max_{r}, false) AS f_{r}" for r, (m, _) in RULES.items())} FROM s LEFT JOIN cuts USING (stratum))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR {' OR '.join(f'f_{r}' for r in RULES)}) AS kept,
  concat_ws(',', {', '.join(f"CASE WHEN f_{r} THEN '{r}' END" for r in RULES)}) AS rejected_by
FROM j
"""

OP4 = rf"""
WITH lines AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line,
                 unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents),
keyed AS (SELECT doc_id, source, pos, line, trim(regexp_replace(line, '[\t\x0B\f\r]', ' ', 'g')) AS k,
            regexp_matches(line, '[^ \t\x0B\f\r]') AS full_line FROM lines),
host AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
common AS (SELECT source, k FROM keyed JOIN host USING (source) WHERE full_line
           GROUP BY source, k, n HAVING count(DISTINCT doc_id) > {RATIO}::DOUBLE * n AND n >= {MIN_PAGES}),
marked AS (SELECT keyed.*, common.k IS NOT NULL AS gone FROM keyed LEFT JOIN common
           ON keyed.source = common.source AND keyed.k = common.k AND keyed.full_line),
kept AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
           coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS text FROM marked GROUP BY doc_id)
SELECT doc_id, n_lines, n_dropped, length(text)::BIGINT AS n_chars_kept, sha256(text) AS kept_sha256 FROM kept
"""

# CRC-32 of the decimal id: per byte one step that mixes it in (1000 and more), then eight shifts.
_CRC = """xor(list_reduce(flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [1000 + ord(c), 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[])),
  lambda a, x: CASE WHEN x >= 1000 THEN xor(a, x - 1000) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, 4294967295::BIGINT), 4294967295)"""
_FIELD = "coalesce(strlen({0}::VARCHAR)::VARCHAR || ':' || {0}::VARCHAR, '-')"


def _leaf(**other: str) -> str:
    return "sha256(" + " || ".join(_FIELD.format(other.get(c, c)) for c in ("doc_id", "source", "lang", "n_chars", "text")) + ")"


OP12 = f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, coalesce('=' || lang, '') AS tree, {_leaf()} AS leaf, {_leaf(n_chars='(n_chars + 1)')} AS other, {_CRC} % 7 = 0 AS hit,
    row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS idx, count(*) OVER (PARTITION BY lang) AS n FROM documents),
nodes AS (
  SELECT tree, 0 AS level, idx, n, leaf AS h FROM leaves
  UNION ALL
  SELECT tree, level + 1, idx // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY idx)) FROM nodes WHERE n > 1 GROUP BY tree, level, n, idx // 2),
subs AS (SELECT tree, h AS subroot, row_number() OVER (ORDER BY tree) - 1 AS idx, count(*) OVER () AS n FROM nodes WHERE n = 1),
tops AS (
  SELECT 0 AS level, idx, n, subroot AS h FROM subs
  UNION ALL
  SELECT level + 1, idx // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY idx)) FROM tops WHERE n > 1 GROUP BY level, n, idx // 2),
depth AS (SELECT tree, max(level) AS d FROM nodes GROUP BY tree),
steps AS (
  SELECT doc_id, l.tree, s.level AS lv, (l.idx >> s.level::INT) & 1 AS own, b.h FROM leaves l JOIN depth USING (tree), LATERAL (SELECT unnest(range(d)) AS level) s
    LEFT JOIN nodes b ON b.tree = l.tree AND b.level = s.level AND b.idx = xor(l.idx >> s.level::INT, 1)
  UNION ALL
  SELECT doc_id, l.tree, 1000 + s.level, (subs.idx >> s.level::INT) & 1, b.h FROM leaves l JOIN subs USING (tree),
    LATERAL (SELECT unnest(range((SELECT max(level) FROM tops))) AS level) s
    LEFT JOIN tops b ON b.level = s.level AND b.idx = xor(subs.idx >> s.level::INT, 1)),
paths AS (SELECT doc_id, string_agg(coalesce(h, ''), '' ORDER BY lv) AS siblings, list(own::VARCHAR || coalesce(h, '') ORDER BY lv) AS path FROM steps GROUP BY doc_id),
done AS (
  SELECT doc_id, leaf, subroot, (SELECT h FROM tops WHERE n = 1) AS root, sha256(coalesce(siblings, '')) AS proof_sha256,
    list_reduce(coalesce(path, []), lambda a, x: sha256(CASE WHEN x[1] = '1' THEN x[2:] || a ELSE a || x[2:] END),
                CASE WHEN hit AND n_chars IS NOT NULL THEN other ELSE leaf END) AS folded_root
  FROM leaves JOIN subs USING (tree) JOIN (SELECT doc_id, n_chars FROM documents) USING (doc_id) LEFT JOIN paths USING (doc_id))
SELECT *, folded_root = root AS verified FROM done
"""

ORACLE = {"op3_quality_rules": OP3, "op4_line_dedup": OP4, "op12_merkle_manifest": OP12}
