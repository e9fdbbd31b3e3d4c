"""DuckDB SQL for the queries of plans.run_queries."""

from __future__ import annotations

from ..functions.net import CLOSED_V4
from ..functions.text import ENTITIES
from .oracles import _ACCESS, _EVIDENCE, _ORDERS, _READING, _REPORTS, _SCANNED, _VERDICTS, _overlap, _standing, _terms


def _joined(names):
    """Sorted, distinct and joined: SQL of a list whose nulls don't count."""
    return f"array_to_string(list_sort(list_distinct(list_filter({names}, lambda x: x IS NOT NULL))), ',')"


def _nets():
    for net in CLOSED_V4:
        base, bits = net.split("/")
        low = sum(int(x) << (24 - 8 * i) for i, x in enumerate(base.split(".")))
        yield f"n BETWEEN {low} AND {low + 2 ** (32 - int(bits)) - 1}"


def _stripped(x):
    out = f"regexp_replace({x}, '<[^>]+>', ' ', 'g')"
    for entity, char in ENTITIES.items():
        out = "replace({}, '{}', '{}')".format(out, entity, char.replace("'", "''"))
    return f"trim(regexp_replace({out}, '\\s+', ' ', 'g'))"


_PASSAGE = """o2 AS (SELECT c AS run_id, k, 'S' || row_number() OVER (PARTITION BY c ORDER BY k) AS source_id, row_number() OVER (PARTITION BY c ORDER BY k) AS rank, CASE WHEN k % 5 = 0 THEN repeat(source, 30) ELSE source END AS source FROM o JOIN e ON e.run_id = k AND e.source_id = 'S1')"""
_CANDIDATES = "c AS (SELECT user_id AS query_id, event_id AS chunk_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS INTEGER) AS rank, value AS score FROM events QUALIFY rank <= 20)"
_ENTAILED = f"""{_VERDICTS}, q AS (SELECT *, CASE run_id % 6 WHEN 2 THEN TRUE ELSE FALSE END AS odd FROM v WHERE verdict = 'supported'),
j AS (SELECT run_id, CASE WHEN run_id % 4 = 3 THEN 'neutral' WHEN odd THEN 'neutral' WHEN run_id % 4 = 0 THEN 'entailed' WHEN run_id % 4 = 1 THEN 'contradicted' ELSE 'neutral' END AS label, odd AND run_id % 4 <> 3 AS unverifiable FROM q)"""
_CASES = """e AS (SELECT event_id AS i, CASE event_id % 4 WHEN 0 THEN 'abstained' WHEN 1 THEN 'partial' ELSE 'answered' END AS outcome, event_id % 17 = 0 AS failed, event_id % 3 <> 0 AS audited,
  CASE WHEN event_id % 11 = 0 THEN 'hybrid' WHEN event_id % 2 = 0 THEN 'local' ELSE 'web' END AS route, CASE event_id % 3 WHEN 0 THEN 'local' WHEN 1 THEN 'web' ELSE '' END AS expect_route, CASE event_id % 5 WHEN 0 THEN 'abstained' WHEN 1 THEN 'answered' END AS expected FROM events),
f AS (SELECT *, outcome <> 'abstained' AS answer, outcome <> 'abstained' AND audited AS checked FROM e),
k AS (SELECT *, CASE WHEN failed THEN [] ELSE list_filter([
  CASE WHEN expect_route <> '' THEN {'k': 'route', 'v': route = expect_route} END, CASE WHEN i % 6 = 0 THEN {'k': 'ran_rounds', 'v': i % 3 >= 2} END,
  CASE WHEN i % 5 = 0 THEN {'k': 'outcome', 'v': outcome = 'abstained'} WHEN i % 5 = 1 THEN {'k': 'outcome', 'v': answer} END, CASE WHEN i % 8 = 0 THEN {'k': 'injection_detected', 'v': i % 16 > 0} END,
  CASE WHEN answer AND i % 2 > 0 THEN {'k': 'grounded', 'v': (i % 10) / 10 >= 0.6} END, CASE WHEN checked THEN {'k': 'no_fabricated_citations', 'v': i % 13 <> 0} END,
  CASE WHEN checked AND i % 5 > 0 THEN {'k': 'answer_citations_supported', 'v': (i % 5) / 5 >= 0.8} END, CASE WHEN checked AND i % 9 = 0 THEN {'k': 'clean_audit', 'v': i % 2 = 0 AND i % 6 > 0} END,
  CASE WHEN i % 2 = 0 THEN {'k': 'cites:Total', 'v': TRUE} END, {'k': 'excludes:forbidden', 'v': i % 7 <> 0}], lambda x: x IS NOT NULL) END AS checks FROM f),
r AS (SELECT *, len(checks) > 0 AND len(list_filter(checks, lambda x: NOT x.v)) = 0 AS passed FROM k)"""
_SUMMARY = f"""{_CASES}, s AS (SELECT count(*) AS cases, count(*) FILTER (passed) AS passed, round(avg(CASE WHEN passed THEN 1.0 ELSE 0 END), 3) AS pass_rate,
  round(avg(CASE WHEN route = expect_route THEN 1.0 ELSE 0 END) FILTER (expect_route <> ''), 3) AS route_accuracy, round(avg(CASE WHEN route = 'hybrid' THEN 1.0 ELSE 0 END) FILTER (expect_route <> ''), 3) AS route_over_retrieval,
  round(avg((i % 5) / 5) FILTER (checked AND i % 5 > 0), 3) AS answer_citation_validity, count(*) FILTER (answer AND (NOT audited OR i % 6 = 0)) AS answers_with_no_citations, count(*) FILTER (checked AND i % 13 = 0) AS fabricated_citation_cases,
  round(avg(CASE WHEN outcome = 'abstained' THEN 1.0 ELSE 0 END) FILTER (expected = 'abstained'), 3) AS abstain_precision, round(avg(CASE WHEN outcome = 'abstained' THEN 1.0 ELSE 0 END) FILTER (expected = 'answered'), 3) AS false_abstention,
  round(avg(CASE WHEN i % 16 > 0 THEN 1.0 ELSE 0 END) FILTER (i % 8 = 0 AND NOT failed), 3) AS injection_detection, round(sum(round((i % 10) / 10, 3)) / count(*), 3) AS mean_support_rate, round(sum(i % 3) / count(*), 2) AS mean_rounds,
  round(sum(0.25::DOUBLE), 4) AS total_cost_usd, round(sum(i % 4) / count(*), 2) AS mean_latency_s, count(*) FILTER (failed) AS errors FROM r)"""
_LABELS = """l AS (SELECT 'a' AS annotator, doc_id AS item_id, quality AS y FROM labels UNION ALL SELECT 'b', doc_id, 1 - toxic FROM labels UNION ALL SELECT 'c', doc_id, doc_id % 2 FROM labels WHERE doc_id % 10 <> 0),
lb AS (SELECT annotator, item_id, CASE WHEN y = 1 THEN 'supported' ELSE 'unsupported' END AS label FROM l)"""
_DISAGREE = f"""{_REPORTS}, p AS (SELECT a.s AS source_a, b.s AS source_b, a.v AS va, b.v AS vb, a.text AS ta, b.text AS tb, {_standing('a')} AS score_a, {_standing('b')} AS score_b FROM r a JOIN r b ON a.s < b.s AND a.v <> b.v WHERE {_overlap('a.text', 'b.text')} >= 0.22)"""
_FIRM = "CASE WHEN contains({t}, 'estimated') THEN '' ELSE 'states a precise figure' END"

ORACLES = {
    "structured_answer": f"""WITH {_VERDICTS}, x AS (SELECT run_id, kind, verdict, verdict = 'supported' AS ok, run_id % 3 <> 0 AS says, p + CASE WHEN kind = 1 THEN 1 ELSE 0 END AS amount, c FROM v),
g AS (SELECT run_id, CAST(CASE WHEN ok THEN 1 ELSE 0 END AS BIGINT) AS verified, CAST(CASE WHEN ok THEN 0 ELSE 1 END + CASE WHEN says THEN 0 ELSE 1 END AS BIGINT) AS unverified, CAST(CASE WHEN says THEN 1 ELSE 0 END AS BIGINT) AS disclosures,
  {_joined("[CASE WHEN kind = 3 THEN '[w9]' END, CASE WHEN NOT says THEN 'Z1' END]")} AS fabricated_ids, CASE WHEN verdict = 'dropped' THEN 'S1' ELSE '' END AS unsupported_ids,
  trim(CASE WHEN ok THEN '- Order ' || run_id || ' of customer ' || c || ' has a total of $' || amount || '. [S1]' ELSE '' END || CASE WHEN says THEN CASE WHEN ok THEN chr(10) || chr(10) ELSE '' END || '**What this doesn''t cover**' || chr(10) || chr(10) || '- The sources name no delivery date for order ' || run_id || '. [S1]' ELSE '' END) AS answer FROM x)
SELECT *, CASE WHEN verified + unverified > 0 THEN round(verified / (verified + unverified), 6) ELSE 0.0 END AS verified_rate, unverified = 0 AND fabricated_ids = '' AND unsupported_ids = '' AND verified + disclosures > 0 AS is_clean FROM g""",
    "claim_citations": f"""WITH {_VERDICTS}, m AS (SELECT run_id, kind, kind IN (0, 1, 2) AS cites, kind = 3 AS fake, p, c,
  CASE WHEN kind = 2 THEN FALSE WHEN kind = 1 THEN verdict = 'supported' ELSE TRUE END AS holds FROM v)
SELECT run_id, holds AS supported, CASE WHEN holds THEN 'S1' ELSE '' END AS kept, CASE WHEN fake THEN '[w9]' ELSE '' END AS hallucinated, {_joined("['S2', CASE WHEN NOT holds THEN 'S1' END]")} AS dropped FROM m""",
    "annotated_answer": f"""WITH {_VERDICTS}, t AS (SELECT run_id, verdict, 'Order ' || run_id || ' of customer ' || c || ' has a total of ' || CASE WHEN kind = 2 THEN '€' ELSE '$' END || (p + CASE WHEN kind = 1 THEN 1 ELSE 0 END) AS claim FROM v)
SELECT run_id, claim || CASE WHEN verdict <> 'supported' THEN ' _[unverified]_' ELSE '' END || '. The end.' AS answer FROM t""",
    "cited_sources": f"WITH {_VERDICTS} SELECT run_id, 'S1' AS source_id FROM v WHERE verdict = 'supported'",
    "evidence_packing": f"""WITH {_ORDERS}, {_EVIDENCE}, {_PASSAGE},
h AS (SELECT *, length(source_id || ' orders ') // 4 + 24 AS header, length(source) // 4 AS n FROM o2), w AS (SELECT *, sum(n + header) OVER (PARTITION BY run_id ORDER BY rank) AS upto FROM h),
x AS (SELECT *, sum(CASE WHEN upto > 400 THEN 1 ELSE 0 END) OVER (PARTITION BY run_id ORDER BY rank) AS over, 400 - (upto - n - header) - header AS rest FROM w),
y AS (SELECT run_id, rank, source_id, CAST(CASE WHEN over = 1 THEN rest ELSE n END AS BIGINT) AS tokens, over = 1 AS cut, '│││ BEGIN UNTRUSTED SOURCE ' || source_id || ' | orders' || chr(10) || CASE WHEN over = 1 THEN substr(source, 1, CAST(4 * rest AS BIGINT)) || ' […truncated]' ELSE source END || chr(10) || '│││ END UNTRUSTED SOURCE ' || source_id AS block FROM x WHERE over = 0 OR (over = 1 AND rest > 120)),
z AS (SELECT run_id, sha1(string_agg(block, chr(10) || chr(10) ORDER BY rank)) AS prompt_sha1 FROM y GROUP BY 1) SELECT run_id, source_id, tokens, cut, prompt_sha1 FROM y JOIN z USING (run_id)""",
    "web_evidence": """WITH r AS (SELECT page_id, page_id % 50 AS run_id, url, row_number() OVER (PARTITION BY page_id % 50 ORDER BY page_id) AS n FROM pages),
s AS (SELECT run_id, 'W' || n AS source_id, CASE WHEN page_id % 4 = 0 THEN url ELSE 'Page ' || page_id END || ' [' || regexp_replace(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)', 1), '^www\\.', '') || ']' AS label,
  CASE WHEN page_id % 2 = 0 THEN substr(repeat(url, 200), 1, 5120) WHEN page_id % 3 <> 0 THEN '(search snippet only, page not retrieved) a snippet' END AS source FROM r)
SELECT run_id, source_id, label, sha1(source) AS source_sha1, CAST(length(source) AS BIGINT) AS n_chars FROM s WHERE source IS NOT NULL""",
    "evidence_gather": """WITH n AS (SELECT n_nationkey AS k FROM nation), x AS (SELECT k, k % 3 <> 2 AS local, k % 3 <> 0 AND k % 5 <> 0 AS web, k % 3 = 1 AND k % 2 = 0 AS held, k % 4 <> 0 AS first FROM n),
y AS (SELECT k, list_concat(CASE WHEN first THEN CASE WHEN local THEN ['H1'] ELSE ['H1', 'S1'] END ELSE [] END, CASE WHEN local THEN ['S1', 'S2', 'S3'] ELSE [] END, CASE WHEN NOT web THEN [] WHEN held THEN ['P1', 'P2'] ELSE ['W1', 'W2'] END) AS ids FROM x)
SELECT k AS run_id, array_to_string(ids, ',') AS ids FROM y WHERE len(ids) > 0""",
    "evidence_ranking": """SELECT page_id % 20 AS run_id, page_id AS source_id, CAST(row_number() OVER (PARTITION BY page_id % 20 ORDER BY page_id % 3 <> 0, CASE WHEN page_id % 3 <> 0 THEN -CASE WHEN page_id % 5 <> 0 THEN (page_id % 4) / 4 ELSE 0 END END, CASE WHEN page_id % 3 <> 0 THEN -(page_id % 7) END, page_id) AS INTEGER) AS rank FROM pages""",
    "text_limits": """WITH d AS (SELECT doc_id, replace(coalesce(text, ''), chr(10), chr(10) || chr(10)) AS t FROM documents), x AS (SELECT *, length(t) AS n, substr(t, 451, 50) AS tail FROM d),
y AS (SELECT *, instr(reverse(tail), chr(10) || chr(10)) AS back FROM x), z AS (SELECT *, CASE WHEN n <= 500 THEN n WHEN back > 0 THEN 450 + length(tail) - back - 1 ELSE 500 END AS cut FROM y)
SELECT doc_id, CAST(cut AS BIGINT) AS kept, CAST(n AS BIGINT) AS total, n > 500 AS truncated, sha1(substr(t, 1, cut)) AS text_sha1, sha1(substr(t, 1, 200)) AS tokens_sha1, CASE WHEN n = 0 THEN 0 ELSE greatest(1, n // 4) END + 20 <= 300 AS fits FROM z""",
    "html_fragments": f"SELECT page_id, sha1({_stripped('html')}) AS text_sha1 FROM pages",
    "salient_terms": "SELECT n_nationkey, 'Market of Region|Nation_' || n_nationkey || '|12%|Audit Office|Region|3 million' AS terms FROM nation",
    "unsafe_urls": f"""WITH a AS (SELECT o_orderkey AS k, (CASE WHEN o_orderkey % 3 = 0 THEN 167772160 ELSE o_orderkey * 2654435761 END) % 4294967296 AS n FROM orders)
SELECT k AS o_orderkey, CASE WHEN k % 11 = 0 THEN 'scheme' WHEN {' OR '.join(_nets())} THEN 'address' ELSE '' END AS reason FROM a""",
    "json_objects": """SELECT event_id, CASE event_id % 4 WHEN 3 THEN NULL WHEN 2 THEN '{"items":[{"k":' || json_extract_string(props, '$.k') || '}]}' ELSE '{"k":' || json_extract_string(props, '$.k') || '}' END AS object FROM events""",
    "rerank_scores": f"""WITH {_CANDIDATES}, s AS (SELECT *, CASE WHEN chunk_id % 3 <> 0 AND query_id % 7 <> 0 THEN CASE WHEN query_id % 5 = 0 THEN 0.1 ELSE (chunk_id % 10) / 10 END END AS given FROM c WHERE query_id % 5 <> 0 OR chunk_id % 3 <> 0),
g AS (SELECT *, coalesce(given, 0.5) AS rel, max(given IS NOT NULL) OVER (PARTITION BY query_id) AS ran FROM s), a AS (SELECT *, max(ran AND rel >= 0.3) OVER (PARTITION BY query_id) AS any_good FROM g),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN any_good THEN -rel END, rank) AS INTEGER) AS r FROM a WHERE rel >= 0.3 AND ran OR NOT any_good)
SELECT query_id, chunk_id, r AS rank, round(CASE WHEN any_good THEN rel ELSE score END, 6) AS score, CASE WHEN any_good THEN 'bm25,llm-rerank' ELSE 'bm25' END AS retrievers FROM r WHERE r <= 5""",
    "rerank_cross_encoder": f"""WITH {_CANDIDATES}, g AS (SELECT *, query_id % 7 <> 0 AS ran, CASE WHEN query_id % 7 <> 0 THEN 1 / (1 + exp(-(chunk_id % 13 - 6))) ELSE 0.0 END AS rel FROM c), a AS (SELECT *, max(ran AND rel >= 0.2) OVER (PARTITION BY query_id) AS any_good FROM g),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN any_good THEN -rel END, rank) AS INTEGER) AS r FROM a WHERE rel >= 0.2 AND ran OR NOT any_good)
SELECT query_id, chunk_id, r AS rank, round(CASE WHEN any_good THEN rel ELSE score END, 6) AS score, CASE WHEN any_good THEN 'bm25,cross-encoder' ELSE 'bm25' END AS retrievers FROM r WHERE r <= 5""",
    "entailment_fold": f"WITH {_ENTAILED} SELECT run_id, label, unverifiable, label = 'entailed' AS stands FROM j",
    "entailment_counts": f"WITH {_ENTAILED} SELECT run_id, CAST(CASE WHEN label = 'entailed' THEN 1 ELSE 0 END AS BIGINT) AS entailed, CAST(CASE WHEN label = 'contradicted' THEN 1 ELSE 0 END AS BIGINT) AS contradicted, CAST(CASE WHEN label = 'neutral' THEN 1 ELSE 0 END AS BIGINT) AS neutral, CAST(CASE WHEN unverifiable THEN 1 ELSE 0 END AS BIGINT) AS unverifiable, CASE WHEN label = 'entailed' THEN 1.0 ELSE 0.0 END AS entailment_rate FROM j",
    "audit_chain": """WITH RECURSIVE e AS (SELECT user_id, event_id, CAST(json_object('user_id', user_id, 'event_id', event_id, 'props', props) AS VARCHAR) AS payload, row_number() OVER (PARTITION BY user_id ORDER BY event_id % 2000 >= 1000, event_id) AS i FROM events),
b AS (SELECT user_id, CAST(0 AS BIGINT) AS i, CAST(-1 AS BIGINT) AS event_id, '' AS prev_hash, '' AS record_hash FROM (SELECT DISTINCT user_id FROM e)
  UNION ALL SELECT e.user_id, e.i, e.event_id, b.record_hash, sha256(b.record_hash || chr(1) || e.payload) FROM b JOIN e ON e.user_id = b.user_id AND e.i = b.i + 1)
SELECT event_id, prev_hash, record_hash FROM b WHERE i > 0""",
    "audit_events": f"""WITH {_ORDERS}, q AS (SELECT k, left(sha256('What of order ' || k), 16) AS h, length('What of order ' || k) AS n FROM o),
r AS (SELECT 'query' AS event, '{{"question_hash":"' || h || '","question_chars":' || n || '}}' AS d FROM q UNION ALL SELECT 'access_granted', '{{"question_hash":"' || h || '","documents":["a"]}}' FROM q WHERE k % 2 = 0
  UNION ALL SELECT 'access_denied', '{{"question_hash":"' || h || '","documents":["b"]}}' FROM q WHERE k % 3 = 0 UNION ALL SELECT 'injection', '{{"question_hash":"' || h || '","kinds":["x"]}}' FROM q WHERE k % 5 = 0
  UNION ALL SELECT 'contradiction', '{{"question_hash":"' || h || '","count":' || k % 4 || '}}' FROM q WHERE k % 4 > 0
  UNION ALL SELECT CASE WHEN k % 7 = 0 THEN 'abstained' ELSE 'answered' END, '{{"question_hash":"' || h || '","outcome":"' || CASE WHEN k % 7 = 0 THEN 'abstained' ELSE 'answered' END || '","confidence":"high","cited":[]}}' FROM q)
SELECT event, count(*) AS n, min(d) AS first_detail FROM r GROUP BY 1""",
    "ledger_report": f"WITH {_VERDICTS} SELECT run_id, CAST(2 AS BIGINT) AS sources, CAST(1 AS BIGINT) AS edges, CAST(CASE WHEN verdict = 'supported' THEN 1 ELSE 0 END AS BIGINT) AS supported, CAST(CASE WHEN verdict = 'dropped' THEN 1 ELSE 0 END AS BIGINT) AS dropped, CAST(CASE WHEN verdict = 'fabricated' THEN 1 ELSE 0 END AS BIGINT) AS fabricated, CAST(CASE WHEN run_id % 9 = 0 THEN 2 ELSE 0 END AS BIGINT) AS modified FROM v",
    "ledger_integrity": "SELECT o_orderkey AS run_id, s AS source_id, CASE WHEN o_orderkey % 150 = 0 THEN 'raw,sanitized' WHEN o_orderkey % 50 = 0 THEN 'raw' ELSE 'sanitized' END AS broken FROM orders, (VALUES ('S1'), ('S2')) AS x(s) WHERE o_orderkey % 50 = 0 OR o_orderkey % 75 = 0",
    "annotation_items": f"""WITH {_VERDICTS}, t AS (SELECT *, 'Order ' || run_id || ' of customer ' || c || ' has a total of ' || CASE WHEN kind = 2 THEN '€' ELSE '$' END || (p + CASE WHEN kind = 1 THEN 1 ELSE 0 END) AS claim FROM v WHERE kind < 3)
SELECT left(sha1(concat_ws(chr(0), claim, 'S1', source)), 16) AS item_id, 'What of order ' || run_id AS question, 'S1' AS source_id, CASE WHEN verdict = 'supported' THEN 'accepted' ELSE 'rejected' END AS pipeline_verdict FROM t""",
    "cache_hits": "WITH k AS (SELECT doc_id, left(sha256(coalesce(text, '')), 24) AS text_key FROM documents), n AS (SELECT count(*) FILTER (text_key IN (SELECT text_key FROM k WHERE doc_id % 3 = 0)) AS hits, count(*) AS n FROM k) SELECT hits, n - hits AS misses, round(hits / n, 3) AS hit_rate FROM n",
    "embed_cached": "SELECT doc_id, CASE WHEN text IN (SELECT text FROM documents WHERE doc_id % 3 = 0) THEN 0.0 ELSE CAST(CAST(length(text) AS FLOAT) AS DOUBLE) END AS x FROM documents",
    "eval_checks": f"WITH {_CASES} SELECT i AS id, passed, array_to_string(list_sort(list_transform(list_filter(checks, lambda x: NOT x.v), lambda x: x.k)), ',') AS failed, CAST(len(checks) AS BIGINT) AS n_checks FROM r",
    "eval_summary": f"WITH {_SUMMARY} SELECT * FROM s",
    "eval_regressions": f"""WITH {_SUMMARY} SELECT metric, CASE WHEN metric IN ('pass_rate', 'errors') THEN 'regressed' ELSE 'ok' END AS verdict FROM (SELECT unnest(['passed', 'pass_rate', 'route_accuracy', 'route_over_retrieval', 'answer_citation_validity', 'answers_with_no_citations', 'fabricated_citation_cases', 'abstain_precision', 'false_abstention', 'injection_detection', 'mean_support_rate', 'mean_rounds', 'total_cost_usd', 'mean_latency_s', 'errors']) AS metric FROM s)""",
    "annotator_agreement": f"""WITH {_LABELS}, s AS (SELECT item_id, list(label) AS ls FROM lb GROUP BY 1 HAVING count(*) = 3), u AS (SELECT item_id, unnest(ls) AS label FROM s), c AS (SELECT item_id, label, count(*) AS c FROM u GROUP BY ALL),
i AS (SELECT sum(c * (c - 1)) / 6.0 AS p FROM c GROUP BY item_id), x AS (SELECT sum(y * y) AS e FROM (SELECT sum(c) / (SELECT CAST(count(*) AS DOUBLE) FROM u) AS y FROM c GROUP BY label))
SELECT 'fleiss' AS method, round((avg(p) - max(e)) / (1 - max(e)), 3) AS kappa, count(*) AS items, CAST(3 AS BIGINT) AS annotators FROM i, x""",
    "retest_report": f"""WITH p AS (SELECT quality AS a, 1 - toxic AS b FROM labels WHERE doc_id % 2 = 0), s AS (SELECT count(*) AS items, count(*) FILTER (a <> b) AS changed, avg(CASE WHEN a = b THEN 1.0 ELSE 0 END) AS o, avg(a) AS pa, avg(b) AS pb FROM p),
t AS (SELECT *, pa * pb + (1 - pa) * (1 - pb) AS e FROM s), u AS (SELECT *, CASE WHEN e = 1 THEN CASE WHEN o = 1 THEN 1.0 ELSE 0.0 END ELSE (o - e) / (1 - e) END AS k FROM t)
SELECT items, changed, round(1 - changed / items, 3) AS stability, round(k, 3) AS kappa, {_READING} AS reading, items >= 40 AS reliable FROM u""",
    "majority_labels": f"WITH {_LABELS}, n AS (SELECT item_id, label, count(*) AS c FROM lb GROUP BY ALL) SELECT item_id, first(label ORDER BY c DESC, label) AS label, round(max(c) / sum(c), 3) AS share, CAST(sum(c) AS BIGINT) AS n FROM n GROUP BY 1",
    "gold_scores": f"""WITH {_LABELS}, s AS (SELECT item_id, min(label) AS lo, max(label) AS hi FROM lb GROUP BY 1 HAVING count(*) = 3), g AS (SELECT item_id, CASE WHEN lo = hi THEN lo ELSE 'partial' END AS label, lo <> hi AS adjudicated FROM s WHERE lo = hi OR item_id % 4 = 0),
m AS (SELECT label <> 'unsupported' AS g, item_id % 3 <> 0 AS p FROM g), c AS (SELECT count(*) FILTER (g AND p) AS tp, count(*) FILTER (NOT g AND p) AS fp, count(*) FILTER (g AND NOT p) AS fn, count(*) FILTER (NOT g AND NOT p) AS tn FROM m)
SELECT *, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1, (SELECT round(avg(CASE WHEN adjudicated THEN 1.0 ELSE 0 END), 3) FROM g) AS adjudicated_share FROM c""",
    "labelling_order": "SELECT doc_id AS item_id, sha256('ann' || chr(0) || doc_id) AS order_key FROM labels WHERE doc_id % 5 <> 0",
    "conflict_report": f"WITH {_DISAGREE}, x AS (SELECT *, array_to_string(list_sort(list_intersect({_terms('ta')}, {_terms('tb')}))[1:5], ', ') AS what FROM p) SELECT source_a, source_b, '[' || source_a || '] and [' || source_b || '] give different money values for ' || what || ': ' || va || ' USD vs ' || vb || ' USD.' AS description FROM x",
    "conflict_summary": f"WITH {_DISAGREE} SELECT count(*) AS contradictions, count(*) AS pairs FROM p",
    "resolution_report": f"WITH {_DISAGREE} SELECT source_a, source_b, {_FIRM.format(t='ta')} AS reasons_a, {_FIRM.format(t='tb')} AS reasons_b, abs(score_a - score_b) < 0.15 AS open FROM p",
    "injection_summary": f"WITH {_SCANNED} SELECT CAST(conv_id AS VARCHAR) AS conv_id, array_to_string(list_sort(list_distinct(list(kind))), ', ') AS kinds, count(*) AS matches FROM c JOIN m ON m.i = c.turn % 8 WHERE kind <> '' GROUP BY 1",
    "quality_report": r"""WITH h AS (SELECT page_id, page_id % 30 AS run_id, array_to_string(string_split(regexp_replace(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)', 1), '^www\.', ''), '.')[-2:], '.') AS domain FROM pages),
g AS (SELECT run_id, count(*) AS sources, 0.45 AS mean_authority, count(DISTINCT domain) AS domains, string_agg(DISTINCT domain, ', ' ORDER BY domain) AS names, count(*) FILTER (page_id % 2 = 0) AS stale FROM h GROUP BY 1),
w AS (SELECT *, list_filter([CASE WHEN domains < 2 AND sources > 1 THEN sources || ' web sources come from ' || domains || ' domain(s) (' || names || '); corroboration is limited' END,
  CASE WHEN stale > 0 THEN 'current information is asked for, but ' || stale || ' source(s) seem to date from 2019 or earlier' END], lambda x: x IS NOT NULL) AS ws FROM g)
SELECT run_id, sources, mean_authority, domains, round(domains / sources, 3) AS diversity, CAST(len(ws) AS BIGINT) AS n_warnings, array_to_string(ws, '; ') AS warnings FROM w""",
    "time_sensitive": "SELECT n_nationkey, n_nationkey % 3 < 2 AS sensitive FROM nation",
    "access_denials": f"WITH {_ACCESS} SELECT CAST(o_orderkey AS VARCHAR) AS doc_name, count(*) AS withheld FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM acl WHERE c_nationkey = 3) GROUP BY 1",
    "table_index": """WITH o AS (SELECT o_custkey AS c, o_orderkey AS k, CAST(round(o_totalprice) AS BIGINT) AS p, o_orderstatus AS s, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders),
pg AS (SELECT unnest([1, 2]) AS page),
rows AS (SELECT c, page, 0 AS part, i, 0 AS table_id, i - 1 AS row_index, 'Orders of the customer' AS caption, 'Orders of the customer — Order: ' || k || ' | Total: ' || p || ' | Status: ' || s AS text FROM o, pg WHERE n >= 2),
prose AS (SELECT c, page, 1 AS part, 1 AS i, NULL AS table_id, NULL AS row_index, '' AS caption, 'Orders of the customer' || chr(10) || chr(10) || CASE WHEN n >= 2 THEN 'End.' ELSE 'Order | Total | Status' || chr(10) || '--- | --- | ---' || chr(10) || k || ' | ' || p || ' | ' || s || chr(10) || 'End.' END AS text FROM o, pg WHERE i = 1)
SELECT CAST(c AS VARCHAR) AS doc_name, CAST(row_number() OVER (PARTITION BY c ORDER BY page, part, i) AS INTEGER) AS ordinal, page, CAST(table_id AS INTEGER) AS table_id, CAST(row_index AS INTEGER) AS row_index, caption, text FROM (SELECT * FROM rows UNION ALL SELECT * FROM prose)""",
}
