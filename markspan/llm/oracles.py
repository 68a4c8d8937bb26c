"""DuckDB SQL for the operators that SQL can express over whole tables."""

from __future__ import annotations

from markspan.llm.url_filter import LOWER, RULES, TIE, UPPER

_RULE_ROWS = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)


def _ranks(name: str, seed: str, edges: str, steps: int = 400, damping: float = 0.85) -> str:
    """CTEs of a personalised PageRank as the sum of the masses after 0, 1, 2, ... links; 0.85^400 is below 1e-28."""
    return f"""{name}_share AS (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS part FROM {edges}),
{name}_mass(k, host, mass) AS (
  SELECT 0, host, {1 - damping} * {seed} / sum({seed}) OVER () FROM hosts WHERE {seed} > 0
  UNION ALL
  SELECT k + 1, dst, sum({damping} * mass * part) FROM {name}_mass JOIN {name}_share ON src = host WHERE k < {steps} GROUP BY k, dst
),
{name} AS (SELECT host, sum(mass) AS score FROM {name}_mass GROUP BY host)"""


_REST = "CASE WHEN instr({u}, '://') > 0 THEN substr({u}, instr({u}, '://') + 3) ELSE '' END"
_HOST = f"coalesce(translate(regexp_extract({_REST}, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}'), '')"
_PATH = f"coalesce(regexp_extract({_REST}, '^[^/?#]*([^?#]*)', 1), '')"

OP2 = f"""
WITH RECURSIVE rules(rule_verdict, domain, prefix) AS (VALUES {_RULE_ROWS}),
p AS (SELECT row_number() OVER () AS rid, page_id, html, {_HOST.format(u="url")} AS host, {_PATH.format(u="url")} AS path FROM pages),
fits AS (
  SELECT rid, domain || prefix AS rule, rule_verdict,
         row_number() OVER (PARTITION BY rid ORDER BY length(domain || prefix) DESC) AS k
  FROM p JOIN rules ON (host = domain OR ends_with(host, '.' || domain)) AND starts_with(path, prefix)
),
judged AS (SELECT p.*, rule, rule_verdict FROM p LEFT JOIN fits ON p.rid = fits.rid AND k = 1),
hosts AS (
  SELECT host,
         CASE WHEN 2 * count(*) FILTER (rule_verdict = 'allow') > count(*) THEN count(*) FILTER (rule_verdict = 'allow') ELSE 0 END::DOUBLE AS good,
         CASE WHEN 2 * count(*) FILTER (rule_verdict = 'block') > count(*) THEN count(*) FILTER (rule_verdict = 'block') ELSE 0 END::DOUBLE AS bad
  FROM judged WHERE host <> '' GROUP BY host
),
links AS (
  SELECT host AS src, unnest(regexp_extract_all(html, '(?i)href\\s*=\\s*["'']?\\s*((?:https?:)?//[^"''\\s>]+)', 1)) AS url FROM p
),
linked AS (SELECT src, {_HOST.format(u="(CASE WHEN starts_with(url, '//') THEN 'http:' || url ELSE url END)")} AS dst FROM links),
edges AS (SELECT src, dst, count(*)::DOUBLE AS w FROM linked WHERE src <> dst AND src <> '' AND dst <> '' GROUP BY src, dst),
back AS (SELECT dst AS src, src AS dst, w FROM edges),
{_ranks("trust", "good", "edges")},
{_ranks("distrust", "bad", "back")},
blocked AS (SELECT d.host FROM distrust d LEFT JOIN trust t ON d.host = t.host WHERE d.score > coalesce(t.score, 0) + {TIE} * greatest(d.score, coalesce(t.score, 0)))
SELECT page_id, judged.host, path, rule, coalesce(rule_verdict, CASE WHEN blocked.host IS NOT NULL THEN 'block' END, 'allow') AS verdict
FROM judged LEFT JOIN blocked ON judged.host = blocked.host
"""

_BLANK = "[\\x20\\x09-\\x0D]+"

OP3 = f"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, '=' || source AS host, coalesce(text, '') AS text,
         list_filter(regexp_split_to_array(coalesce(text, ''), '{_BLANK}'), lambda w: w <> '') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS full_lines
  FROM documents
),
windows AS (
  SELECT rid, i, w FROM (
    SELECT rid, unnest(range(1, len(words) - 6)) AS i, unnest(list_transform(range(1, len(words) - 6), lambda i: list_slice(words, i, i + 7))) AS w FROM d WHERE len(words) > 8)
),
again AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, w) AS n FROM windows) WHERE n > 1),
covered AS (SELECT rid, count(DISTINCT i + k) AS n FROM again, range(8) AS t(k) GROUP BY rid),
base AS (
  SELECT d.rid, doc_id, coalesce(host, '') AS host, text, len(words)::BIGINT AS n_words,
         length(regexp_replace(text, '{_BLANK}', '', 'g'))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
         (len(full_lines) - len(list_distinct(full_lines)))::BIGINT AS n_dup_lines,
         coalesce(n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN covered ON d.rid = covered.rid
),
lines AS (
  SELECT rid, doc_id, host, text, line, len(string_split(line, ' '))::BIGINT AS n FROM (
    SELECT rid, doc_id, host, text,
           regexp_replace(trim(regexp_replace(lower(unnest(string_split(text, chr(10)))), '{_BLANK}', ' ', 'g'), ' '), '[0-9]+', '0', 'g') AS line
    FROM base) WHERE line <> ''
),
common AS (
  SELECT host, line, arg_min(text, {{'a': doc_id IS NULL, 'b': doc_id, 'c': text}}) AS first
  FROM lines GROUP BY host, line HAVING count(DISTINCT rid) > 10
),
removed AS (SELECT rid, sum(n)::BIGINT AS r FROM lines JOIN common USING (host, line) WHERE text <> first GROUP BY rid),
judged AS (
  SELECT base.*, coalesce(r, 0)::BIGINT AS removed_words, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed
  FROM base LEFT JOIN removed USING (rid)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND (removed_words = 0 OR (n_words - removed_words >= 10 AND n_words - removed_words >= 0.25 * n_words)) AS kept, removed_words
FROM judged
"""

OP4 = """
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS rid, vec_id, embedding::DOUBLE[] AS e FROM embeddings
),
fine AS (
  SELECT rid, vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM v
  WHERE vec_id IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NOT NULL AND isfinite(x))) = len(e) AND len(list_filter(e, lambda x: x <> 0)) > 0
),
pairs AS (
  SELECT a.rid AS a, b.rid AS b, a.vec_id AS av, b.vec_id AS bv FROM fine a JOIN fine b ON a.rid <> b.rid AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.9
),
reach(node, vec) AS (SELECT rid, vec_id FROM v UNION SELECT pairs.b, reach.vec FROM reach JOIN pairs ON reach.node = pairs.a),
least AS (SELECT node, min(vec) AS component_id FROM reach GROUP BY node),
counts AS (SELECT a, count(*) AS n FROM pairs GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept
FROM v JOIN least ON rid = node LEFT JOIN counts ON rid = a
"""

ORACLES = {"op2_link_trust_urls": OP2, "op3_line_frequency_quality": OP3, "op4_pca_tiled_links": OP4}
