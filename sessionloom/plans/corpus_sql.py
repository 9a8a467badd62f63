"""SQL the corpus queries are checked against."""

from __future__ import annotations

_SEGMENT = """CASE WHEN trim({0}) = {1} THEN {1} ELSE {1} || '--' || substr(sha256(trim({0})), 1, 8) END"""


def _safe(value: str) -> str:
    cleaned = f"coalesce(nullif(trim(regexp_replace(trim({value}), '[^A-Za-z0-9._-]', '-', 'g'), '-'), ''), 'unknown')"
    return _SEGMENT.format(value, cleaned)


_DIRECTORY = """CASE WHEN n % 4 = 1 AND doc_id % 2 = 0 THEN '/srv/' || source
    WHEN n % 4 = 2 AND doc_id % 3 = 0 THEN '/srv/' || source || '/' || (doc_id % 2)
    WHEN n % 4 = 3 THEN '/srv/' || source END"""

_STATUS = """
  refs AS (SELECT doc_id, source AS label, 'label:' || source AS project, 'mts-trans/me/' || source || '/codex--' || doc_id || '.zip' AS key FROM documents),
  s AS (SELECT *, CASE WHEN doc_id % 5 = 0 THEN 'not_uploaded' WHEN doc_id % 23 = 1 THEN 'error'
          WHEN doc_id % 5 IN (1, 4) THEN 'current' ELSE 'changed' END AS state,
          CASE WHEN doc_id % 5 <> 0 AND doc_id % 23 = 1 THEN 'OSError: gone' END AS error FROM refs)"""

_CACHED = """CASE WHEN doc_id % 4 IN (0, 1) AND doc_id % 9 IN (0, 6, 7) THEN CASE doc_id % 4 WHEN 0 THEN 'current' ELSE 'changed' END END"""

_PROMPT = "trim(regexp_replace(text, '\\s+', ' ', 'g'))"

_ASSIGNMENTS = r"""len(regexp_extract_all(text, '(?i)(?:password|passwd|secret|token|api_key|apikey|access_key)\s*[=:]\s*["''][^"'']{8,}["'']'))"""
_EMAILS = r"""len(regexp_extract_all(text, '(^|[^A-Za-z0-9._%+\-\\@])([A-Za-z0-9][A-Za-z0-9._%+\-]*@[A-Za-z0-9.\-]+\.[A-Za-z]{2,24})'))"""

ORACLES = {
    "project_merge": f"""
  WITH d AS (SELECT *, regexp_extract(source, '(\\d+)$', 1)::INTEGER AS n FROM documents),
  r AS (SELECT *, {_DIRECTORY} AS dir FROM d),
  l AS (SELECT source, min(dir) AS only FROM r WHERE dir IS NOT NULL GROUP BY 1 HAVING count(DISTINCT dir) = 1),
  f AS (SELECT r.*, coalesce(r.dir, l.only) AS directory FROM r LEFT JOIN l USING (source))
  SELECT CASE WHEN directory IS NULL THEN 'unresolved:' || source ELSE 'directory:' || directory END AS identity,
    arg_min(source, doc_id) AS label, any_value(directory) AS directory, count(*) AS session_count,
    max(n_chars) * 60 + 1600000000 AS latest
  FROM f GROUP BY 1""",
    "project_rollup": """
  SELECT user_id::VARCHAR AS project_id, event_type AS source, count(*) AS session_count, epoch_us(max(ts)) AS latest
  FROM events GROUP BY 1, 2""",
    "repository_roots": r"""
  WITH p AS (SELECT p_partkey, p_size, string_split(p_name, ' ') AS w, replace(p_name, ' ', '/') AS tail, p_partkey % 10 AS u, p_partkey % 5 AS shape FROM part),
  have AS (SELECT DISTINCT s_suppkey % 10 AS u FROM supplier WHERE s_suppkey % 2 = 0),
  q AS (SELECT p.*, h.u IS NOT NULL AS repo,
    CASE shape WHEN 0 THEN '/srv/u' || p.u || '/' || tail WHEN 1 THEN '/srv/u' || p.u || '/deep/' || tail || '/'
      WHEN 2 THEN '/srv/u' || p.u || '/x/.claude/worktrees/' || tail
      WHEN 3 THEN '/h/.codex/worktrees/' || p_size || '/' || w[1] || '/y' ELSE '/other/' || tail END AS path
    FROM p LEFT JOIN have h ON h.u = p.u),
  d AS (SELECT *, CASE shape
      WHEN 0 THEN CASE WHEN repo THEN '/srv/u' || u ELSE path END
      WHEN 1 THEN CASE WHEN repo THEN '/srv/u' || u || '/main' ELSE rtrim(path, '/') END
      WHEN 2 THEN '/srv/u' || u || '/x' WHEN 3 THEN NULL ELSE path END AS directory FROM q),
  known AS (SELECT DISTINCT p_size FROM part WHERE p_size % 2 = 0),
  i AS (SELECT d.*, coalesce(directory, CASE WHEN k.p_size IS NOT NULL AND w[1] = 'red' THEN '/srv/known' ELSE 'stale:/h/.codex/worktrees/' || d.p_size || '/' || w[1] END) AS identity,
      CASE WHEN directory IS NOT NULL THEN list_last(string_split(directory, '/'))
           WHEN k.p_size IS NOT NULL AND w[1] = 'red' THEN 'known' ELSE w[1] END AS label
    FROM d LEFT JOIN known k ON k.p_size = d.p_size)
  SELECT p_partkey, path, directory, label, identity, '_project-' || label || '-' || substr(sha256(identity), 1, 12) AS project_key FROM i""",
    "child_links": """
  WITH t AS (SELECT DISTINCT conv_id FROM conversations),
  l AS (SELECT (conv_id - conv_id % 3)::VARCHAR AS parent, (conv_id // 2)::VARCHAR AS child_id FROM t WHERE conv_id % 3 <> 0)
  SELECT parent, child_id, count(*) OVER (PARTITION BY parent) AS children,
    (SELECT count(DISTINCT child_id) FROM l x WHERE x.parent = l.parent) AS distinct_children FROM l""",
    "attach_pointers": """
  SELECT conv_id, turn, x.kind, CASE x.n WHEN 1 THEN '/p/tool-results/' || conv_id || '-' || turn || '.txt'
      WHEN 2 THEN '/p/tool-results/a' WHEN 3 THEN '/p/tool-results/a/tool-results/b'
      WHEN 4 THEN '/q/tasks/' || conv_id || '-' || turn || '.output'
      WHEN 5 THEN '/e/terminals/' || conv_id || '-' || turn || '.txt' ELSE '/e/agent-tools/x' END AS pointer
  FROM conversations, (VALUES (1, 'tool-results'), (2, 'tool-results'), (3, 'tool-results'), (4, 'task-outputs'),
    (5, 'terminals'), (6, 'agent-tools')) x(n, kind)""",
    "attach_budget": """
  WITH RECURSIVE f AS (SELECT l_orderkey, l_returnflag AS kind,
      printf('/f/%010d-%010d-%010d-%d', l_partkey, l_orderkey, l_suppkey, l_linenumber) AS path, max(l_quantity)::BIGINT AS size
    FROM lineitem GROUP BY ALL),
  o AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY kind, path) AS n FROM f),
  g AS (SELECT *, size <= 60 AS kept, CASE WHEN size <= 60 THEN size ELSE 0 END AS spent FROM o WHERE n = 1
    UNION ALL
    SELECT o.*, g.spent + o.size <= 60, g.spent + CASE WHEN g.spent + o.size <= 60 THEN o.size ELSE 0 END
    FROM g JOIN o ON o.l_orderkey = g.l_orderkey AND o.n = g.n + 1)
  SELECT l_orderkey, kind, path, size, kept FROM g""",
    "arcname_collisions": """
  WITH p AS (SELECT p_partkey, p_brand, replace(p_name, ' ', '_') AS name, printf('/r/%08d/', p_partkey) || replace(p_name, ' ', '_') || '.txt' AS path FROM part),
  n AS (SELECT *, row_number() OVER (PARTITION BY p_brand, name ORDER BY path) AS rn FROM p)
  SELECT p_partkey, path, 'tool-results/' || name || CASE WHEN rn > 1 THEN '-' || substr(sha256(path), 1, 8) ELSE '' END || '.txt' AS arcname FROM n""",
    "attachment_outcomes": """
  WITH RECURSIVE l AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem WHERE l_partkey % 11 <> 0),
  j AS (SELECT l.*, p_size, p_partkey IS NULL OR p_partkey % 7 = 0 AS gone, p_partkey % 5 = 0 AS away FROM l LEFT JOIN part ON p_partkey = l_partkey),
  f AS (SELECT l_orderkey, '/real/' || l_partkey AS path, p_size::BIGINT AS size FROM j WHERE NOT gone AND NOT away),
  o AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY path) AS n FROM f),
  g AS (SELECT *, size <= 60 AS kept, CASE WHEN size <= 60 THEN size ELSE 0 END AS spent FROM o WHERE n = 1
    UNION ALL
    SELECT o.*, g.spent + o.size <= 60, g.spent + CASE WHEN g.spent + o.size <= 60 THEN o.size ELSE 0 END
    FROM g JOIN o ON o.l_orderkey = g.l_orderkey AND o.n = g.n + 1),
  a AS (SELECT l_orderkey, CASE WHEN kept THEN size ELSE 0 END AS b, kept::INTEGER AS f, 0 AS m, (NOT kept)::INTEGER AS s FROM g
    UNION ALL SELECT l_orderkey, 0, 0, 1, 0 FROM j WHERE gone)
  SELECT l_orderkey::VARCHAR AS l_orderkey, sum(b)::BIGINT AS total_bytes, sum(f)::BIGINT AS files, sum(m)::BIGINT AS missing, sum(s)::BIGINT AS skipped
  FROM a GROUP BY 1""",
    "content_hash": """
  WITH d AS (SELECT doc_id, sha256(encode('source-v5') || unhex('00') || encode(text)) AS h FROM documents),
  e AS (SELECT page_id * 2 AS doc_id, kind, url, prefix || 'tool-results/' || page_id || '.html' AS arcname, sha256(encode(html)) AS digest
        FROM pages, (VALUES ('tool-results', ''), ('task-outputs', 't/')) k(kind, prefix)),
  a AS (SELECT doc_id, string_agg(hex(encode(arcname)) || '00' || digest || '00', '' ORDER BY kind, url) AS tail FROM e GROUP BY 1),
  w AS (SELECT d.doc_id, CASE WHEN tail IS NULL THEN h ELSE sha256(encode('attachments-v1') || unhex('00') || encode(h) || unhex(tail)) END AS h
        FROM d LEFT JOIN a USING (doc_id)),
  c AS (SELECT doc_id, string_agg(hex(encode(child)) || '00', '' ORDER BY child) AS tail
        FROM (SELECT DISTINCT conv_id * 3 AS doc_id, 'k' || turn AS child FROM conversations) GROUP BY 1)
  SELECT w.doc_id, CASE WHEN tail IS NULL THEN h ELSE sha256(encode('subagent-links-v1') || unhex('00') || encode(h) || unhex(tail)) END AS source_hash
  FROM w LEFT JOIN c USING (doc_id)""",
    "storage_keys": f"""
  WITH d AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN source WHEN 1 THEN '' WHEN 2 THEN 'a%b/c\\d' ELSE 'my repo' END AS label,
      'codex--' || CASE doc_id % 3 WHEN 0 THEN doc_id::VARCHAR WHEN 1 THEN 'a b/' || doc_id ELSE ' -x- ' END AS tid,
      CASE WHEN doc_id % 2 = 0 THEN 'Jane-Doe' ELSE 'anonymous' END AS contributor FROM documents)
  SELECT doc_id, contributor, tid AS transcript_id, 'mts-trans/' || {_safe('contributor')} || '/'
    || CASE WHEN label = '' THEN '%00' ELSE replace(replace(replace(label, '%', '%25'), '/', '%2F'), '\\', '%5C') END
    || '/' || {_safe('tid')} || '.zip' AS key FROM d""",
    "upload_status": f"WITH {_STATUS} SELECT doc_id, key, state, error FROM s",
    "status_in_order": f"""
  WITH {_STATUS}
  SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN state ELSE 'current' END AS state, doc_id % 2 <> 0 AS cached,
    row_number() OVER (ORDER BY reverse(doc_id::VARCHAR), doc_id::VARCHAR) - 1 AS position
  FROM s WHERE doc_id % 2 = 0 OR doc_id % 3 <> 0""",
    "project_order": """
  WITH p AS (SELECT o_custkey, count(*) AS session_count, max(o_orderdate) AS latest FROM orders GROUP BY 1)
  SELECT 'Label-' || o_custkey AS label, session_count, row_number() OVER (ORDER BY latest DESC, 'label-' || o_custkey) - 1 AS position FROM p""",
    "status_summary": f"""
  WITH {_STATUS}
  SELECT count(*) AS total, count(*) FILTER (WHERE doc_id % 4 <> 0) AS checked, count(*) FILTER (WHERE doc_id % 4 = 0) AS cached,
    count(*) FILTER (WHERE doc_id % 4 <> 0 AND state IN ('current', 'changed')) AS changed, count(error) AS errors, 'partial' AS status FROM s""",
    "state_counts": f"""
  WITH {_STATUS}
  SELECT project AS project_id, count(*) FILTER (WHERE state = 'not_uploaded') AS not_uploaded,
    count(*) FILTER (WHERE state = 'changed') AS changed, count(*) FILTER (WHERE state = 'current') AS current,
    count(*) FILTER (WHERE state = 'error') AS failed FROM s GROUP BY 1""",
    "state_reuse": f"""
  SELECT doc_id, {_CACHED} AS cached_state,
    CASE WHEN doc_id % 9 <> 8 AND doc_id % 4 = 2 THEN 'candidate' WHEN {_CACHED} = 'changed' THEN 'candidate'
      WHEN {_CACHED} IS NULL THEN 'stale' ELSE 'none' END AS decision FROM documents""",
    "state_merge": f"""
  WITH {_STATUS},
  h AS (SELECT s.*, CASE WHEN state IN ('current', 'changed') THEN CASE WHEN doc_id % 23 <> 1 THEN
      sha256(encode('source-v5') || unhex('00') || encode(d.text)) END END AS h FROM s JOIN documents d USING (doc_id))
  SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'current' WHEN doc_id % 2 = 0 THEN state ELSE 'changed' END AS state,
    CASE WHEN doc_id % 3 = 0 THEN 'new' ELSE h END AS source_hash,
    CASE WHEN doc_id % 3 = 0 OR h IS NOT NULL THEN 5 END AS source_hash_version,
    CASE WHEN doc_id % 3 <> 0 THEN error END AS error FROM h""",
    "selection_resolve": """
  WITH p AS (SELECT DISTINCT 'label:src' || (l_partkey % 20) AS project, CASE WHEN l_partkey % 2 = 0 THEN 'p' END AS parent, l_partkey AS id FROM lineitem)
  SELECT doc_id, 'label:' || source AS project_id, CASE WHEN doc_id % 10 = 0 THEN 'p' END AS parent FROM documents d
  WHERE EXISTS (SELECT 1 FROM p WHERE p.id = d.doc_id AND p.project = 'label:' || d.source
    AND p.parent IS NOT DISTINCT FROM CASE WHEN doc_id % 10 = 0 THEN 'p' END)""",
    "consent_filter": """
  WITH found AS (SELECT doc_id, source FROM documents WHERE doc_id % 5 <> 0),
  saved AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1),
  removed AS (SELECT doc_id FROM labels WHERE doc_id % 3 = 0),
  wanted AS (SELECT DISTINCT doc_id FROM labels WHERE toxic = 0 AND doc_id % 5 <> 0 AND doc_id % 3 <> 0)
  SELECT 'updated' AS part, doc_id::VARCHAR AS identity, source AS label FROM wanted JOIN found USING (doc_id)
  UNION ALL SELECT 'updated', doc_id::VARCHAR, 'saved' FROM saved WHERE doc_id NOT IN (FROM removed) AND doc_id NOT IN (SELECT doc_id FROM found)
  UNION ALL SELECT 'frozen', doc_id::VARCHAR, 'saved' FROM saved WHERE doc_id NOT IN (FROM removed)
  UNION ALL SELECT 'reported', doc_id::VARCHAR, coalesce(source, 'saved') FROM saved LEFT JOIN found USING (doc_id)
  UNION ALL SELECT 'invalid', doc_id::VARCHAR, '' FROM (SELECT doc_id FROM wanted UNION SELECT doc_id FROM saved WHERE doc_id NOT IN (FROM removed))
    WHERE doc_id NOT IN (SELECT doc_id FROM found)
  UNION ALL SELECT 'allowed', doc_id::VARCHAR, n_chars::VARCHAR FROM documents WHERE doc_id % 5 <> 0 AND doc_id IN (SELECT doc_id FROM saved)""",
    "manifest_json": f"""
  SELECT doc_id, '7' AS manifest_version, 'codex--' || doc_id AS manifest_id, 'codex-rollout-jsonl' AS format, 'codex' AS source_type,
    source AS project_name, ({_ASSIGNMENTS} + {_EMAILS})::VARCHAR AS redactions,
    CASE WHEN doc_id % 2 = 0 THEN 'human' ELSE 'unknown' END AS launch_kind,
    CASE WHEN doc_id % 10 = 0 THEN 'codex--p' END AS parent_id, CASE WHEN doc_id % 10 = 0 THEN 8 ELSE 7 END AS metadata_fields,
    sha256(encode('source-v5') || unhex('00') || encode(text)) AS source_hash FROM documents""",
    "key_listing": """
  WITH o AS (SELECT regexp_replace(url, '^https?://', '') || CASE WHEN page_id % 3 = 0 THEN '.txt' ELSE '.zip' END AS rest, page_id,
      strftime(make_timestamp((1700000000 + page_id * 3600) * 1000000), '%Y-%m-%d %H:%M:%S UTC') AS stamp FROM pages)
  SELECT split_part(rest, '/', 1) AS name, 'top/' || split_part(rest, '/', 1) || '/' AS key, true AS is_folder, split_part(rest, '/', 1) AS label
  FROM o WHERE contains(rest, '/') AND split_part(rest, '/', 1) <> '' GROUP BY ALL
  UNION ALL SELECT rest, 'top/' || rest, false, rest || '  ' || max(stamp) FROM o WHERE NOT contains(rest, '/') AND rest LIKE '%.zip' GROUP BY rest
  UNION ALL SELECT replace(rest, '/', '-'), 'top/' || replace(rest, '/', '-'), false, replace(rest, '/', '-') || '  ' || max(stamp) FROM o WHERE rest LIKE '%.zip' GROUP BY 1
  UNION ALL SELECT 'top', 'top/', true, 'top'""",
    "preview_page": """
  WITH n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS position, count(*) OVER (PARTITION BY conv_id) AS total,
      text || ' mail [EMAIL] ' || repeat('x', 1500) AS t FROM conversations)
  SELECT conv_id, position::INTEGER AS position, role, CASE WHEN length(t) > 2000 THEN substr(t, 1, 2000) || '...' ELSE t END AS text,
    1 AS redaction_count, total AS total_messages, least(4, total)::BIGINT AS next_offset, total > 4 AS has_more
  FROM n WHERE position BETWEEN 1 AND 3""",
    "preview_deep": """
  WITH m AS (SELECT l_returnflag || l_linestatus AS session, l_orderkey * 8 + l_linenumber AS seq,
      CASE WHEN l_linenumber % 2 = 1 THEN 'user' ELSE 'assistant' END AS role, 'order ' || l_orderkey || ' of [EMAIL]' AS text FROM lineitem),
  n AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY seq, role, text) - 1 AS position, count(*) OVER (PARTITION BY session) AS total FROM m),
  t AS (SELECT session, max(total) AS total FROM n GROUP BY session), a AS (SELECT unnest([5000, 1000000000]) AS asked)
  SELECT session, asked::INTEGER AS asked, position::BIGINT AS position, role, text, CASE WHEN role IS NOT NULL THEN 1 END AS redaction_count,
    total AS total_messages, least(asked + 100, total)::BIGINT AS next_offset, total > asked + 100 AS has_more
  FROM (SELECT n.session, asked, position, role, text, total FROM n, a WHERE position >= asked AND position < asked + 100
        UNION ALL SELECT session, asked, NULL, NULL, NULL, total FROM t, a WHERE total <= asked)""",
    "origin_join": f"""
  WITH e AS (SELECT conv_id, turn, {_PROMPT} AS prompt, CASE WHEN conv_id % 3 = 0 THEN 'human' END AS o,
      CASE WHEN turn % 4 = 0 THEN 'typed' END AS p, CASE WHEN conv_id % 2 = 0 THEN 'cli' END AS c FROM conversations WHERE role = 'user'),
  f AS (SELECT *, row_number() OVER (PARTITION BY conv_id, prompt ORDER BY turn) AS rn FROM e
        WHERE prompt <> '' AND (o IS NOT NULL OR p IS NOT NULL OR c IS NOT NULL))
  SELECT s.conv_id, s.turn, s.role AS source, f.o AS origin_kind, f.p AS prompt_source, f.c AS entrypoint
  FROM conversations s LEFT JOIN f ON s.role = 'user' AND f.rn = 1 AND f.conv_id = s.conv_id AND f.prompt = {_PROMPT.replace('text', 's.text')}""",
    "child_refs": """
  WITH t AS (SELECT conv_id, turn, conv_id || 'x' || turn AS short FROM conversations WHERE turn % 6 IN (0, 1, 2, 4) AND conv_id % 5 <> 0)
  SELECT conv_id, turn, 'claude_code--agent-' || short AS trajectory_id, 'agent-' || short AS session_id,
    'claude_code--agent-' || short || '.zip' AS trajectory_path FROM t""",
    "mention_filter": """
  SELECT 'reference' AS part, (conv_id % 50)::BIGINT AS session, conv_id, turn::BIGINT AS turn,
    'agent-' || conv_id || CASE WHEN turn % 9 = 4 THEN '/' ELSE 'x' END || turn AS session_id
  FROM conversations WHERE turn % 3 = 1
  UNION ALL SELECT 'filter', NULL, NULL, NULL, 'few'""",
    "child_ids_deep": """
  SELECT conv_id, turn, 'child' || conv_id || '-' || turn AS session_id FROM conversations WHERE turn % 2 = 0 OR turn % 3 = 0""",
    "codex_cwd_depth": "SELECT conv_id, turn, '/w/' || conv_id || '/' || turn AS cwd FROM conversations",
}
ORACLES |= {"attach_budget_phased": ORACLES["attach_budget"], "content_hash_streamed": ORACLES["content_hash"]}
