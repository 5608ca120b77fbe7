"""Registered queries of the training-data operators and their DuckDB twins.

op2, op3, op5, op7, op9, op10, op12, op13 and the pipeline have no twin: SQL cannot express
them, or not on whole tables in reasonable time.  Their tests compare them with
brute force, exact round trips or held-out labels.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kestrel.llm import (bag_minhash, bottom_k, filter_audit, hyperplanes, language_mixture, mixing, packing, personal_data, reply_trees,
                         rule_ensemble, secret_ledger, suffix_dedup, token_alignment)
from kestrel.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_ledger": lambda s, d: secret_ledger.digest(table(s, d, "documents")),
    "op2_language_mixture": lambda s, d: language_mixture.digest(table(s, d, "documents")),
    "op3_bag_minhash": lambda s, d: bag_minhash.digest(table(s, d, "documents")),
    "op4_mix_sources": lambda s, d: mixing.digest(table(s, d, "documents")),
    "op5_suffix_dedup": lambda s, d: suffix_dedup.digest(table(s, d, "documents")),
    "op6_reply_trees": lambda s, d: reply_trees.digest(table(s, d, "conversations")),
    "op7_rule_ensemble": lambda s, d: rule_ensemble.digest(table(s, d, "documents"), table(s, d, "labels")),
    "op8_hyperplane_dedup": lambda s, d: hyperplanes.digest(table(s, d, "embeddings")),
    "op9_bottom_k": lambda s, d: bottom_k.digest(table(s, d, "documents")),
    "op10_bin_completion": lambda s, d: packing.digest(table(s, d, "documents")),
    "op11_filter_audit": lambda s, d: filter_audit.digest(table(s, d, "documents"), table(s, d, "labels")),
    "op12_personal_data": lambda s, d: personal_data.digest(table(s, d, "documents")),
    "op13_token_alignment": lambda s, d: token_alignment.digest(table(s, d, "documents")),
}


def _spans_sql(no: int, rule: secret_ledger.Rule) -> str:
    pattern, tail = rule.pattern.replace("'", "''"), (rule.tail or "").replace("'", "''")
    more = f"length(regexp_extract(gaps[i + 1], '{tail}'))" if tail else "0"
    return f"""SELECT doc_id, {no} AS kind_no, '{rule.name}' AS kind, unnest(list_filter(list_transform(range(1, len(hits) + 1),
      lambda i: {{'start': list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda h: length(h))), 0),
             'hit': hits[i], 'more': {more}}}),
      lambda x: length(regexp_extract(x.hit, '{pattern}', {rule.group})) >= {rule.least})) AS s
    FROM (SELECT doc_id, regexp_extract_all(t, '{pattern}', 0) AS hits, string_split_regex(t, '{pattern}') AS gaps FROM d)"""


ORACLE: dict[str, str] = {
    "op1_secret_ledger": f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
f AS ({" UNION ALL ".join(_spans_sql(i, r) for i, r in enumerate(secret_ledger.RULES))}),
g AS (SELECT doc_id, kind_no, kind, s.start AS b, s.start + length(s.hit) + s.more AS e FROM f),
a AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
        count(*) FILTER (kind = 'hex') AS n_hex,
        string_agg(concat_ws(':', kind, b::BIGINT, e::BIGINT), ',' ORDER BY b, kind_no) FILTER (kind_no < 3) AS base,
        string_agg(concat_ws(':', kind, b::BIGINT, e::BIGINT), ',' ORDER BY b, kind_no) AS spans FROM g GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, sha256(t) AS blob
FROM d LEFT JOIN a USING (doc_id)""",
    "op4_mix_sources": r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight, source_size * 3.0::DOUBLE AS cap FROM s),
l AS (SELECT *, (sum(source_size) OVER ()::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT source, source_size, least(cap, weight * max(level) OVER ()) AS target FROM l),
r AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM t)
SELECT doc_id, size, source_size, target,
  size * (floor(rate)::BIGINT + CASE WHEN ('0x' || substr(md5('mix-1:' || doc_id), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE
                                          < rate - floor(rate) THEN 1 ELSE 0 END) AS taken
FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source""",
    "op6_reply_trees": r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
x AS (SELECT *, length(text) + length(text) - length(replace(text, '\', ''))
    + len(regexp_extract_all(text, '<s>|</s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>|\[ROLE\]|\[TEXT\]|\[/ROLE\]'))
    + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 6 WHEN 'system' THEN 17 ELSE 23 + length(role) END AS shown FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (3 + sum(shown))::BIGINT AS formatted_chars
FROM x GROUP BY conv_id""",
    "op8_hyperplane_dedup": """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  AND len(a.e) = len(b.e) AND list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.98),
r(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a),
m AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, m.component_id, e.vec_id = m.component_id AS kept
FROM embeddings e JOIN m ON m.a = e.vec_id LEFT JOIN n ON n.a = e.vec_id""",
    "op11_filter_audit": r"""
WITH w AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT w.doc_id, part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    [len(ws) < 200, 100 * len(list_distinct(ws)) < 50 * len(ws), 100 * len(regexp_extract_all(t, '[A-Z]')) > 3 * length(t),
     regexp_matches(t, '[#$%&*|]'), doc_id > min(doc_id) OVER (PARTITION BY t)] AS fails
  FROM w LEFT JOIN l USING (doc_id)),
c AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, fails),
x AS (SELECT unnest(range(1, 6)) AS i),
o AS (SELECT [a.i, b.i, c.i, d.i, e.i] AS way FROM x a, x b, x c, x d, x e
  WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
s AS (SELECT way, step.i AS step, way[step.i] AS own, way[1:step.i - 1] AS before FROM o, x step),
r AS (SELECT part, way, step, own, c.n, c.good, c.toxic, fails[own] AS hit,
    len(list_filter(before, lambda i: fails[i])) > 0 AS gone, len(list_filter(fails, lambda b: b)) AS many FROM s, c),
a AS (SELECT part, way, step, own, coalesce(sum(n) FILTER (NOT gone AND NOT hit), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER (NOT gone AND hit), 0)::BIGINT AS removed, coalesce(sum(n) FILTER (gone AND hit), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (hit AND many = 1), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (NOT gone AND hit), 0)::BIGINT AS good_lost,
    coalesce(sum(toxic) FILTER (NOT gone AND hit), 0)::BIGINT AS toxic_lost FROM r GROUP BY part, way, step, own)
SELECT part, array_to_string(list_transform(way, lambda i: chr((64 + i)::INT)), '') AS filter_order, step::INT AS step, kept, removed,
  redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM a""",
}
