"""SQL counterparts of the named queries, for DuckDB on the given tables.

Lists are joined to text and ordered logs are replayed with recursive queries,
so that the results do not share their method with the Spark side.
"""

from __future__ import annotations

import re
from functools import cache

from recordloom import constants as K


def _list(values: tuple[str, ...]) -> str:
    return "[" + ", ".join(_q(v) for v in values) + "]"


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _in(values: tuple[str, ...]) -> str:
    return "(" + ", ".join(_q(v) for v in values) + ")"


def _iso(expr: str) -> str:
    return f"strftime({expr}, '%Y-%m-%dT%H:%M:%SZ')"


def _json(expr: str) -> str:
    return f"coalesce(CAST(to_json({expr}) AS VARCHAR), 'null')"


_CREATED = "o_orderdate"
_UPDATED = (
    "(o_orderdate + to_days(CAST(CASE WHEN o_orderkey % 89 = 0 THEN -1 ELSE o_orderkey % 30 END AS INTEGER)))"
)
_STATUS = f"{_list(K.THREAD_STATUSES)}[o_orderkey % 8 + 1]"
_REL14 = _list(K.RELATION_TYPES + ("REQUIRES", "CONCERNS"))
_BOOL = "CASE WHEN {} THEN 'true' ELSE 'false' END"

TRANSITION = " OR ".join(
    f"({{0}} = {_q(a)} AND {{1}} IN {_in(b)})" for a, b in K.THREAD_TRANSITIONS.items() if b
)

BASE = {
    "thr": f"""
        SELECT 'thread-' || o_orderkey AS thread_id,
          CASE WHEN o_orderkey % 97 = 0 THEN '  '
               ELSE o_orderpriority || CASE WHEN o_orderkey % 7 = 0 THEN ' Straße ' ELSE ' topic ' END
                    || (o_orderkey % 1000) END AS title,
          'Settle order ' || o_orderkey AS objective,
          {_STATUS} AS status,
          CAST(CASE WHEN o_orderkey % 101 = 0 THEN 0 ELSE o_orderkey % 5 + 1 END AS INTEGER) AS revision,
          '{{"price":' || CAST(floor(o_totalprice) AS BIGINT) || '}}' AS context,
          {_iso(_CREATED)} AS created_at,
          {_iso(_UPDATED)} AS updated_at,
          CASE WHEN {_STATUS} NOT IN ('PROPOSED', 'VALIDATED') THEN {_iso("(o_orderdate + to_days(1))")} END AS started_at,
          CASE WHEN (o_orderkey % 103 = 0) <> ({_STATUS} = 'COMPLETED') THEN {_iso(_UPDATED)} END AS completed_at,
          'desk-' || (o_custkey % 25) AS desk, o_orderstatus AS state, o_custkey % 5 AS rnk,
          replace(lower(CASE WHEN o_orderkey % 97 = 0 THEN '  '
               ELSE o_orderpriority || CASE WHEN o_orderkey % 7 = 0 THEN ' Straße ' ELSE ' topic ' END
                    || (o_orderkey % 1000) END), 'ß', 'ss') AS folded
        FROM orders""",
    "act": f"""
        SELECT 'thread-' || l_orderkey AS thread_id, l_linenumber AS pos,
          CASE WHEN l_partkey % 307 = 0 THEN '' WHEN l_partkey % 101 = 0 THEN 'action-1' ELSE 'action-' || l_linenumber END AS action_id,
          CASE WHEN l_partkey % 211 = 0 THEN ' ' ELSE 'part ' || l_partkey || ' from ' || l_suppkey END AS description,
          {_list(K.ACTION_STATUSES)}[l_partkey % 5 + 1] AS status,
          '{{"quantity":' || CAST(l_quantity AS INTEGER) || '}}' AS metadata
        FROM lineitem""",
    "rel": f"""
        SELECT 'thread-' || o_orderkey AS thread_id, 0 AS pos, {_list(K.RELATION_TYPES)}[o_custkey % 10 + 1] AS type,
          'thread-' || o_orderkey AS source_id, 'thread-' || (o_orderkey + 1) AS target_id FROM orders
        UNION ALL
        SELECT 'thread-' || o_orderkey, 1, {_list(K.RELATION_TYPES)}[o_orderkey % 10 + 1],
          'thread-' || o_orderkey, 'thread-' || o_custkey FROM orders""",
    "cmd": f"""
        SELECT 'thread-' || user_id AS thread_id, event_id AS seq, {_iso("ts")} AS moment, kind,
          CASE WHEN kind = 'SET_STATUS' THEN
            CASE WHEN event_id % 37 = 0 THEN 'CANCELLED' WHEN event_id % 31 = 0 THEN 'COMPLETED'
                 WHEN event_id % 41 = 0 THEN 'ARCHIVED'
                 ELSE ['VALIDATED', 'IMPLEMENTATION', 'TESTING', 'PAUSED', 'BLOCKED'][event_id % 5 + 1] END
            ELSE {_list(K.ACTION_STATUSES)}[event_id % 5 + 1] END AS status,
          CASE WHEN kind = 'ADD_ACTION' AND event_id % 29 = 0 THEN ''
               WHEN kind <> 'SET_STATUS' THEN 'action-' || (event_id % 40) END AS action_id,
          CASE WHEN kind = 'ADD_ACTION' THEN 'value ' || CAST(trunc(value) AS INTEGER) END AS description
        FROM (SELECT *, CASE event_type WHEN 'purchase' THEN 'ADD_ACTION' WHEN 'error' THEN 'SET_ACTION_STATUS'
                        ELSE 'SET_STATUS' END AS kind FROM events)""",
    "mem": """
        SELECT 'info-' || doc_id AS information_id, CAST(doc_id % 4 + 1 AS INTEGER) AS revision,
          text AS content, lang, source, n_chars,
          lower('{"content":' || CAST(to_json(text) AS VARCHAR) || ',"id":"info-' || doc_id
            || '","metadata":{"lang":"' || lang || '","size":' || n_chars || ',"source":"' || source
            || '"},"provenance":{"source":"' || source || '"},"relations":[],"temporal":{},"verification":{}}') AS hay
        FROM documents""",
    "arr": """
        SELECT conv_id * 1000 + turn AS seq,
          CASE role WHEN 'system' THEN 'chat ' || conv_id WHEN 'user' THEN 'info-' || (conv_id * 40 + turn)
               ELSE 'chat-' || conv_id END AS information_id,
          CASE WHEN length(text) % 11 = 0 THEN 0 ELSE 1 END AS revision, text AS content
        FROM conversations""",
    "upd": """
        SELECT event_id AS seq, 'info-' || k AS information_id,
          'info-' || CASE WHEN event_id % 47 = 0 THEN user_id + 1 ELSE k END AS new_information_id,
          event_type || ' ' || event_id AS content,
          CAST(trunc(value) AS INTEGER) % 6 + 1 AS previous_revision
        FROM (SELECT *, CASE WHEN event_id % 53 = 0 THEN user_id + 1000000 ELSE user_id END AS k FROM events)""",
    "delc": """
        SELECT doc_id * 2 + r AS seq,
          'info-' || CASE WHEN toxic = 1 THEN doc_id + 1000000 ELSE doc_id END AS information_id,
          ['quality', 'toxic'][r + 1] AS reason,
          CAST(CASE WHEN r = 0 THEN doc_id % 4 + 1 ELSE doc_id % 3 + 1 END AS INTEGER) AS revision,
          'op-' || doc_id || '-' || r AS operation_id
        FROM labels, (VALUES (0), (1)) v(r)""",
    "deld": """
        SELECT doc_id * 2 + r AS seq, 'info-' || doc_id AS information_id,
          'op-' || doc_id || '-' || CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END AS operation_id,
          CASE WHEN (doc_id + r) % 3 = 0 THEN 'CANCEL' ELSE 'APPROVE' END AS decision
        FROM documents, (VALUES (0), (1)) v(r)""",
    "delo": """
        SELECT c.*, CASE WHEN m.revision IS NULL THEN 'NOT_FOUND'
          WHEN m.revision <> c.revision THEN 'REVISION_CONFLICT' ELSE 'PENDING_DELETE' END AS outcome
        FROM delc c LEFT JOIN mem m USING (information_id)""",
    "delp": """
        SELECT information_id, 'curator' AS requested_by, reason, revision, operation_id, 'PENDING_DELETE' AS status
        FROM (SELECT *, row_number() OVER (PARTITION BY information_id ORDER BY seq DESC) AS rn
              FROM delo WHERE outcome = 'PENDING_DELETE') WHERE rn = 1""",
    "delx": """
        SELECT d.*, CASE WHEN p.operation_id IS NULL THEN 'REQUEST_NOT_FOUND'
          WHEN p.operation_id <> d.operation_id THEN 'OPERATION_CONFLICT'
          WHEN d.decision = 'APPROVE' THEN 'DELETED' ELSE 'CANCELLED' END AS outcome
        FROM deld d LEFT JOIN delp p USING (information_id)""",
    "fact": f"""
        SELECT doc_id AS k, 'info-' || doc_id AS id, CAST(doc_id % 4 + 1 AS INTEGER) AS number,
          doc_id % 3 = 0 AS structured, doc_id % 3 = 0 AND doc_id % 5 <> 0 AS is_revision,
          CAST(CASE WHEN doc_id % 3 = 0 AND doc_id % 12 <> 0 THEN doc_id % 4 END AS INTEGER) AS previous,
          CASE WHEN doc_id % 23 = 0 THEN 'MEASUREMENT' ELSE {_list(K.INFORMATION_TYPES)}[doc_id % 12 + 1] END AS type,
          CASE WHEN quality IS NULL THEN 'UNVERIFIED' WHEN quality = 1 AND toxic = 0 THEN 'CONFIRMED'
               WHEN quality = 1 THEN 'CONFLICTED' WHEN toxic = 0 THEN 'REFUTED' ELSE 'DOUBTFUL' END AS epistemic_status,
          CASE WHEN n_chars % 50 = 0 THEN 'LOST' ELSE {_list(K.OPERATIONAL_STATES)}[doc_id % 6 + 1] END AS operational_state,
          source, lang, quality,
          CASE WHEN doc_id % 19 = 0 THEN 'RUMOUR' ELSE {_list(K.SOURCE_TYPES)}[doc_id % 10 + 1] END AS source_type,
          {_iso("(TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST(doc_id % 700 AS INTEGER)))")} AS created_at,
          CASE WHEN doc_id % 14 < 12 THEN {_REL14}[doc_id % 14 + 1] END AS relation_type,
          'info-' || (doc_id + 1) AS relation_target, doc_id % 17 <> 0 AS has_retention, text
        FROM documents LEFT JOIN labels USING (doc_id)""",
    "txt": """
        SELECT *, 'working/' || id || '.md' AS path, '---' || chr(10) || front || '---' || chr(10) || chr(10) || content AS body
        FROM (SELECT *, '# Information' || chr(10) || chr(10) || text || chr(10) AS content,
          replace('id: ' || id || '|revision:' ||
            CASE WHEN structured THEN '|  number: ' || number || '|  is_revision: ' || CASE WHEN is_revision THEN 'true' ELSE 'false' END
                 || '|  previous_revision: ' || coalesce(CAST(previous AS VARCHAR), 'null')
                 ELSE ' ' || number END
            || '|type: ' || type || '|epistemic_status: ' || epistemic_status || '|operational_state: ' || operational_state
            || '|confidence: LOW|importance: NORMAL||context:|  mode: ANALYSIS|  project: "' || source
            || '"|  domain:|    - GENERAL||provenance:|  source_type: ' || source_type || '|  source: "' || source
            || '"||evidence:|  supporting: []|  contradicting: []||time:|  created_at: "' || created_at || '"||relations:'
            || CASE WHEN relation_type IS NULL THEN ' []' ELSE '|  - type: ' || relation_type || '|    target: ' || relation_target END
            || '|triggers: []|' || CASE WHEN has_retention THEN '|retention: NORMAL|' ELSE '' END, '|', chr(10)) AS front
          FROM fact)""",
    "err": f"""
        SELECT *, concat_ws('; ',
          CASE WHEN NOT has_retention THEN 'champs absents : retention' END,
          CASE WHEN type NOT IN {_in(K.INFORMATION_TYPES)} THEN 'type invalide : ' || type END,
          CASE WHEN epistemic_status NOT IN {_in(K.EPISTEMIC_STATUSES)} THEN 'epistemic_status invalide : ' || epistemic_status END,
          CASE WHEN operational_state NOT IN {_in(K.OPERATIONAL_STATES)} THEN 'operational_state invalide : ' || operational_state END
          ) AS errors FROM fact""",
    "iarr": f"""
        SELECT *, upper(raw_type) AS type FROM (
          SELECT 'info-c' || conv_id || '-' || turn AS id, role, text,
            CASE WHEN (length(text) + turn) % 13 = 0 THEN 'rumour'
                 ELSE lower({_list(K.INFORMATION_TYPES)}[(length(text) + turn) % 12 + 1]) END AS raw_type
          FROM conversations)""",
    "man": f"""
        SELECT event_id AS seq, 'info-' || user_id AS id,
          CASE WHEN event_id % 43 = 0 THEN 'MAYBE' WHEN event_id % 3 = 0 THEN {_list(K.EPISTEMIC_STATUSES)}[event_id % 6 + 1]
               WHEN event_id % 3 = 1 THEN '' END AS e,
          CASE WHEN event_id % 59 = 0 THEN 'ASLEEP' WHEN event_id % 4 = 0 THEN {_list(K.OPERATIONAL_STATES)}[event_id % 6 + 1] END AS o,
          CASE WHEN event_id % 5 = 0 THEN 'HIGH' END AS c, CASE WHEN event_id % 7 = 0 THEN 'CRITICAL' END AS i,
          'event ' || event_type AS reason
        FROM events""",
    "mano": """
        SELECT m.*, row_number() OVER (PARTITION BY m.id ORDER BY m.seq) AS n FROM man m JOIN err f ON f.id = m.id""",
    "mans": f"""
        SELECT id, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS seq, number AS revision, epistemic_status AS e, operational_state AS o,
          'LOW' AS c, 'NORMAL' AS i, '' AS be, '' AS bo, '' AS bi, CAST(NULL AS VARCHAR) AS outcome, CAST(NULL AS VARCHAR) AS reason,
          errors = '' AS ok, structured
        FROM err
        UNION ALL
        SELECT id, n, seq, CASE WHEN outcome = 'UPDATED' THEN revision + 1 ELSE revision END,
          CASE WHEN outcome = 'UPDATED' THEN coalesce(nullif(ue, ''), e) ELSE e END,
          CASE WHEN outcome = 'UPDATED' THEN coalesce(nullif(uo, ''), o) ELSE o END,
          CASE WHEN outcome = 'UPDATED' THEN coalesce(uc, c) ELSE c END,
          CASE WHEN outcome = 'UPDATED' THEN coalesce(ui, i) ELSE i END, e, o, i, outcome, reason, ok, structured
        FROM (SELECT s.id, s.revision, s.e, s.o, s.c, s.i, s.ok, s.structured, u.n, u.seq, u.e AS ue, u.o AS uo, u.c AS uc, u.i AS ui, u.reason,
          CASE WHEN NOT s.ok THEN 'INVALID_INFORMATION' WHEN s.structured THEN 'INVALID_REVISION'
               WHEN coalesce(nullif(u.e, ''), s.e) NOT IN {_in(K.EPISTEMIC_STATUSES)} THEN 'INVALID_EPISTEMIC_STATUS'
               WHEN coalesce(nullif(u.o, ''), s.o) NOT IN {_in(K.OPERATIONAL_STATES)} THEN 'INVALID_OPERATIONAL_STATE'
               ELSE 'UPDATED' END AS outcome
          FROM mans s JOIN mano u ON u.id = s.id AND u.n = s.n + 1)""",
    "rev": """
        SELECT 'review-' || doc_id AS review_id,
          CASE WHEN doc_id % 29 = 0 THEN 'info-' || (doc_id + 1000000) WHEN doc_id % 30 = 0 THEN ''
               ELSE 'info-' || (doc_id // 2) END AS information_id,
          CASE WHEN lang = 'de' THEN 'RESOLVED' ELSE 'PENDING_REVIEW' END AS status
        FROM documents""",
    "dec": """
        SELECT doc_id AS seq, 'review-' || CASE WHEN doc_id % 37 = 0 THEN doc_id + 1000000 ELSE doc_id END AS review_id,
          ['CONFIRMED', 'REFUTED', 'CONFLICTED', 'MAYBE'][n_chars % 4 + 1] AS decision, 'from ' || source AS reason
        FROM documents""",
    "deci": """
        SELECT d.*, r.information_id, f.number, f.operational_state,
          CASE WHEN d.decision = 'MAYBE' THEN 'INVALID_DECISION' WHEN r.review_id IS NULL THEN 'REVIEW_NOT_FOUND'
               WHEN r.status <> 'PENDING_REVIEW' THEN 'REVIEW_NOT_PENDING' WHEN r.information_id = '' THEN 'INFORMATION_ID_MISSING'
               WHEN f.id IS NULL THEN 'INFORMATION_NOT_FOUND' WHEN f.errors <> '' THEN 'INFORMATION_INVALID'
               WHEN f.epistemic_status <> 'UNVERIFIED' THEN 'NOT_UNVERIFIED' WHEN f.structured THEN 'INVALID_REVISION'
               WHEN f.k % 13 = 0 THEN 'INVALID_OPERATIONAL_STATE' END AS problem
        FROM dec d LEFT JOIN rev r USING (review_id) LEFT JOIN err f ON f.id = r.information_id""",
    "deco": """
        SELECT *, CASE WHEN problem IS NOT NULL THEN problem
          WHEN row_number() OVER (PARTITION BY information_id, problem IS NULL ORDER BY seq) = 1 THEN 'RESOLVED'
          ELSE 'NOT_UNVERIFIED' END AS outcome FROM deci""",
    "sup": """
        SELECT DISTINCT id, nxt FROM (
            SELECT 'info-' || doc_id AS id, 'info-' || CASE WHEN doc_id % 7 < 5 THEN doc_id + 1 WHEN doc_id % 70 = 68 THEN doc_id - 2
                WHEN doc_id % 91 = 6 THEN doc_id + 1000000 END AS nxt FROM documents
            UNION ALL SELECT 'info-' || doc_id, 'info-' || (doc_id + 3) FROM documents WHERE doc_id % 7 = 2
            UNION ALL SELECT target_id, source_id FROM irel WHERE type = 'SUPERSEDES'
        ) WHERE nxt IS NOT NULL""",
    "reach": "SELECT id, nxt FROM sup UNION SELECT r.id, s.nxt FROM reach r JOIN sup s ON s.id = r.nxt",
    "irel": f"""
        SELECT 'info-' || doc_id AS source_id, 0 AS pos, {_REL14}[doc_id % 14 + 1] AS type, 'info-' || (doc_id + 1) AS target_id
        FROM documents WHERE doc_id % 14 < 12""",
    "prop": f"""
        SELECT doc_id * 4 + i AS seq, 'info-' || doc_id AS source_id,
          CASE WHEN i = 3 AND doc_id % 8 = 0 THEN 'LIKES' WHEN i = 0 THEN {_list(K.RELATION_TYPES)}[least(doc_id % 14, 9) + 1]
               WHEN i = 1 THEN ['SUPERSEDES', 'CONTRADICTS'][doc_id % 2 + 1] ELSE {_list(K.RELATION_TYPES)}[doc_id % 10 + 1] END AS type,
          CASE WHEN i = 1 AND doc_id % 31 = 0 THEN '' WHEN i = 2 AND doc_id % 16 = 3 THEN 'memo-' || (doc_id // 38 * 19) ELSE 'info-' || CASE WHEN i = 0 THEN doc_id + 1
               WHEN i = 1 THEN CASE WHEN doc_id % 6 = 0 THEN doc_id ELSE doc_id + 2 END
               WHEN i = 2 THEN doc_id // 2 ELSE CASE WHEN doc_id % 9 = 0 THEN doc_id + 1000000 ELSE doc_id // 2 END END END AS target_id,
          i % 2 = 1 AS review
        FROM documents, (VALUES (0), (1), (2), (3)) v(i)""",
    "chk": f"""
        SELECT p.*, s.number, s.structured,
          CASE WHEN p.type NOT IN {_in(K.RELATION_TYPES)} THEN 'relation invalide: ' || p.type
            ELSE concat_ws('; ', CASE WHEN p.target_id = '' THEN 'ID cible absent' END,
              CASE WHEN p.target_id = p.source_id THEN 'relation réflexive interdite pour cette opération' END,
              CASE WHEN t.id IS NULL THEN 'information cible introuvable: ' || p.target_id END,
              CASE WHEN t.id IS NOT NULL AND s.epistemic_status = 'DOUBTFUL' THEN 'état épistémique source invalide: DOUBTFUL' END,
              CASE WHEN t.id IS NOT NULL AND t.epistemic_status = 'DOUBTFUL' THEN 'état épistémique cible invalide: DOUBTFUL' END) END AS errors,
          CASE WHEN t.id IS NULL OR p.type <> 'SUPERSEDES' THEN '' ELSE concat_ws('; ',
              CASE WHEN s.epistemic_status = 'REFUTED' THEN 'source REFUTED : vérifier la pertinence de la supersession' END,
              CASE WHEN t.epistemic_status = 'CONFIRMED' THEN {_q(K.RELATION_WARNINGS["SUPERSEDES_TO_CONFIRMED"])} END) END AS warnings
        FROM prop p JOIN fact s ON s.id = p.source_id LEFT JOIN (
          SELECT id, epistemic_status FROM fact UNION ALL SELECT 'memo-' || k, epistemic_status FROM fact WHERE k % 19 = 0) t ON t.id = p.target_id""",
    "relo": """
        SELECT c.*, CASE WHEN errors <> '' THEN 'REFUSED' WHEN structured THEN 'REVISION_ABSENT'
          WHEN x.source_id IS NOT NULL OR row_number() OVER (PARTITION BY c.source_id, c.type, c.target_id, errors = '' AND NOT structured ORDER BY seq) > 1
          THEN 'ALREADY_PRESENT' ELSE 'ADDED' END AS outcome
        FROM chk c LEFT JOIN irel x ON x.source_id = c.source_id AND x.type = c.type AND x.target_id = c.target_id""",
    "rela": """
        SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY seq) AS n,
          CASE WHEN review AND type IN ('CONTRADICTS', 'SUPERSEDES') THEN 'review-' || sha256(source_id || '|' || type || '|' || target_id) END AS review_id
        FROM relo WHERE outcome = 'ADDED'""",
    "mech": f"""
        SELECT *,
          CASE WHEN type IN {_in(K.EPISODIC_TYPES)} THEN 'YES' ELSE 'POSSIBLE' END AS episodic,
          CASE WHEN relation_type IN ('SUPPORTS', 'CONTRADICTS', 'DERIVED_FROM', 'DEPENDS_ON', 'SUPERSEDES', 'REQUIRES', 'CONCERNS')
               THEN 'YES' ELSE 'POSSIBLE' END AS associative,
          CASE WHEN type = 'PROCEDURE' THEN 'YES' ELSE 'NO' END AS procedural,
          CASE WHEN type IN {_in(K.EPISODIC_TYPES)} THEN 'type ' || type || ' compatible avec une expérience ou un événement.'
               ELSE {_q(K.EPISODIC_POSSIBLE_REASON)} END AS episodic_reason,
          CASE WHEN type NOT IN {_in(K.SEMANTIC_TYPES)} THEN {_q(K.SEMANTIC_OTHER_REASON)}
               WHEN epistemic_status = 'CONFIRMED' THEN {_q(K.SEMANTIC_CONFIRMED_REASON)} ELSE {_q(K.SEMANTIC_UNCONFIRMED_REASON)} END AS semantic_reason,
          CASE WHEN relation_type IN ('SUPPORTS', 'CONTRADICTS', 'DERIVED_FROM', 'DEPENDS_ON', 'SUPERSEDES', 'REQUIRES', 'CONCERNS')
               THEN {_q(K.ASSOCIATIVE_YES_REASON)} ELSE {_q(K.ASSOCIATIVE_POSSIBLE_REASON)} END AS associative_reason,
          CASE WHEN type = 'PROCEDURE' THEN {_q(K.PROCEDURAL_YES_REASON)} ELSE {_q(K.PROCEDURAL_NO_REASON)} END AS procedural_reason
        FROM txt""",
    "rte": f"""
        SELECT *, confirmed <> '' AS idx, CASE WHEN confirmed <> '' THEN {_q(K.INDEX_YES_REASON)} ELSE {_q(K.INDEX_NO_REASON)} END AS index_reason,
          CASE WHEN is_revision THEN {_q(K.UPDATE_YES_REASON)} ELSE {_q(K.UPDATE_NO_REASON)} END AS update_reason,
          '{{"is_revision":' || {_BOOL.format("is_revision")} || ',"number":' || number || ',"previous_revision":' || coalesce(CAST(previous AS VARCHAR), 'null') || '}}' AS rev_json,
          '{{"confirmed":' || {{arr:confirmed}} || ',"possible":' || {{arr:possible}} || ',"rejected":' || {{arr:rejected}} || '}}' AS mech_json
        FROM (SELECT *,
          concat_ws('; ', CASE WHEN episodic = 'YES' THEN 'EPISODIC' END, CASE WHEN associative = 'YES' THEN 'ASSOCIATIVE' END,
            CASE WHEN procedural = 'YES' THEN 'PROCEDURAL' END) AS confirmed,
          concat_ws('; ', CASE WHEN episodic = 'POSSIBLE' THEN 'EPISODIC' END, 'SEMANTIC', CASE WHEN associative = 'POSSIBLE' THEN 'ASSOCIATIVE' END) AS possible,
          concat_ws('; ', CASE WHEN procedural = 'NO' THEN 'PROCEDURAL' END, 'PROSPECTIVE') AS rejected FROM mech)""",
    "pln": f"""
        SELECT *, 'op-' || sha256(
          '{{"classification":{{"ASSOCIATIVE":{{"reason":' || {_json("associative_reason")} || ',"status":"' || associative
          || '"}},"EPISODIC":{{"reason":' || {_json("episodic_reason")} || ',"status":"' || episodic
          || '"}},"PROCEDURAL":{{"reason":' || {_json("procedural_reason")} || ',"status":"' || procedural
          || '"}},"PROSPECTIVE":{{"reason":' || {_json(_q(K.PROSPECTIVE_REASON))} || ',"status":"NO"}},"SEMANTIC":{{"reason":' || {_json("semantic_reason")}
          || ',"status":"POSSIBLE"}},"WORKING":{{"reason":' || {_json(_q(K.WORKING_REASON))} || ',"status":"YES"}}}},"information":{{"classification":{{"confidence":"LOW","epistemic_status":"'
          || epistemic_status || '","importance":"NORMAL","operational_state":"' || operational_state || '","type":"' || type
          || '"}},"content":' || {_json("content")} || ',"context":{{"domain":["GENERAL"],"mode":"ANALYSIS","project":"' || source
          || '"}},"evidence":{{"contradicting":[],"supporting":[]}},"identity":{{"id":"' || id || '","revision":' || rev_json
          || '}},"provenance":{{"source":"' || source || '","source_type":"' || source_type || '"}},"relations":'
          || CASE WHEN relation_type IS NULL THEN '[]' ELSE '[{{"target":"' || relation_target || '","type":"' || relation_type || '"}}]' END
          || ',"retention":' || CASE WHEN has_retention THEN '"NORMAL"' ELSE 'null' END
          || ',"source":{{"content":' || {_json("content")} || ',"front_matter":' || {_json("front")} || ',"path":"' || path
          || '"}},"time":{{"created_at":"' || created_at || '"}},"triggers":[]}},"mechanisms":' || mech_json
          || ',"operations":{{"IGNORE":{{"reason":' || {_json(_q(K.IGNORE_REASON))} || ',"required":false}},"INDEX":{{"reason":' || {_json("index_reason")}
          || ',"required":' || {_BOOL.format("idx")} || '}},"STORE":{{"reason":' || {_json(_q(K.STORE_REASON))} || ',"required":' || {_BOOL.format("NOT is_revision")}
          || '}},"UPDATE":{{"reason":' || {_json("update_reason")} || ',"required":' || {_BOOL.format("is_revision")}
          || '}}}},"safety":{{"embedding_generated":false,"llm_used":false,"qdrant_used":false,"writes_performed":false}},"schema_version":"0.2"}}') AS operation_id,
          CASE WHEN is_revision THEN 'NOT_REQUESTED' ELSE 'READY' END AS store_status,
          CASE WHEN NOT is_revision THEN 'NOT_REQUESTED' WHEN previous IS NULL THEN 'BLOCKED' ELSE 'READY' END AS update_status,
          CASE WHEN idx THEN 'PENDING' ELSE 'NOT_REQUESTED' END AS index_status,
          CASE WHEN is_revision AND previous IS NULL THEN {_q(K.UPDATE_WITHOUT_PREVIOUS)} ELSE update_reason END AS update_text
        FROM rte""",
    "exe": f"""
        SELECT *, sha256('{{"executor":{{"component":"memory-executor","mode":"DRY-RUN","version":"0.3"}},"input":{{"information_id":"' || id
          || '","mechanisms":' || mech_json || ',"memory_plan_schema":"0.2","revision":' || rev_json || ',"source_path":"' || path
          || '"}},"operation_id":"' || operation_id || '","operations":{{"IGNORE":{{"reason":' || {_json(_q(K.IGNORE_REASON))}
          || ',"required":false,"status":"NOT_REQUESTED"}},"INDEX":{{"reason":' || {_json("index_reason")} || ',"required":' || {_BOOL.format("idx")}
          || ',"status":"' || index_status || '"}},"STORE":{{"reason":' || {_json(_q(K.STORE_REASON))} || ',"required":' || {_BOOL.format("NOT is_revision")}
          || ',"status":"' || store_status || '"}},"UPDATE":{{"reason":' || {_json("update_text")} || ',"required":' || {_BOOL.format("is_revision")}
          || ',"status":"' || update_status || '"}}}},"safety":{{"embedding_generated":false,"llm_used":false,"qdrant_used":false,"source_file_read":false,"writes_performed":false}},"schema_version":"0.3"}}') AS execution_plan_hash
        FROM pln""",
    "dcs": """
        SELECT *, CASE WHEN lang = 'de' THEN 'CONFLICT' WHEN lang = 'fr' THEN 'ALREADY_EXECUTED'
          WHEN is_revision AND there AND p_number = number AND previous IS NOT NULL THEN 'PARTIAL'
          WHEN is_revision AND previous IS NULL THEN 'UPDATE_NO_PREVIOUS' WHEN is_revision AND NOT there THEN 'UPDATE_ABSENT'
          WHEN is_revision THEN 'UPDATE_ALLOWED' WHEN there THEN 'STORE_EXISTS' ELSE 'STORE_ALLOWED' END AS rule
        FROM (SELECT x.*, x.quality IS NOT NULL AS there, CASE WHEN x.structured AND k % 4 <> 2 THEN k % 4 ELSE x.number END AS p_number,
                e.errors AS problems FROM exe x JOIN err e USING (k))""",
    "app": """
        SELECT *, CASE WHEN code IN ('STORE', 'UPDATE', 'INDEX') THEN code WHEN code = 'ALREADY_EXECUTED' THEN 'NO-OP'
               WHEN code = 'INDEX_REFUSED' THEN 'BLOCK' ELSE 'BLOCK' END AS result
        FROM (SELECT *, CASE
          WHEN rule NOT IN ('PARTIAL', 'UPDATE_ALLOWED', 'STORE_ALLOWED') THEN rule
          WHEN rule = 'STORE_ALLOWED' THEN CASE WHEN problems <> '' THEN 'SOURCE_INVALID' ELSE 'STORE' END
          WHEN problems <> '' THEN CASE WHEN rule = 'PARTIAL' THEN 'PERSISTENT_INVALID' ELSE 'SOURCE_INVALID' END
          WHEN rule = 'UPDATE_ALLOWED' AND p_number <> previous THEN 'PERSISTENT_REVISION_DIFFERS'
          WHEN idx THEN 'INDEX' ELSE 'UPDATE' END AS code FROM dcs)""",
    "val": """
        SELECT t.*, concat_ws('; ', CASE WHEN trim(title) = '' THEN 'title is required' END,
          CASE WHEN revision < 1 THEN 'revision must be >= 1' END,
          CASE WHEN completed_at IS NOT NULL AND status <> 'COMPLETED' THEN 'completed_at must be empty unless status is COMPLETED' END,
          CASE WHEN completed_at IS NULL AND status = 'COMPLETED' THEN 'completed_at is required for COMPLETED Thread' END,
          CASE WHEN noid THEN 'action_id is required' END,
          CASE WHEN blank THEN 'action description is required' END, CASE WHEN dup THEN 'duplicate action_id' END) AS errors,
          CASE WHEN trim(title) = '' OR revision < 1 OR (completed_at IS NOT NULL) <> (status = 'COMPLETED') THEN split_part(errors, '; ', 1)
               ELSE fault END AS error
        FROM thr t LEFT JOIN (
          SELECT thread_id, bool_or(action_id = '') AS noid, bool_or(action_id <> '' AND trim(description) = '') AS blank,
            bool_or(action_id <> '' AND use = 2) AS dup, arg_min(fault, printf('%09d', CAST(pos AS BIGINT)) || CASE WHEN action_id = '' THEN 0 WHEN trim(description) = '' THEN 1 ELSE 2 END || fault) FILTER (fault IS NOT NULL) AS fault
          FROM (SELECT *, CASE WHEN action_id = '' THEN 'action_id is required' WHEN trim(description) = '' THEN 'action description is required: ' || action_id
                               WHEN use > 1 THEN 'duplicate action_id: ' || action_id END AS fault
                FROM (SELECT *, row_number() OVER (PARTITION BY thread_id, action_id ORDER BY pos) AS use FROM act))
          GROUP BY thread_id) a USING (thread_id)""",
    "cmdo": """
        SELECT c.*, row_number() OVER (PARTITION BY c.thread_id ORDER BY seq) AS n FROM cmd c JOIN val v USING (thread_id) WHERE v.errors = ''""",
    "sim": f"""
        SELECT v.thread_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS seq, v.status AS status, v.revision AS revision,
          coalesce(a.ids, []) AS acts, v.started_at AS started_at, v.completed_at AS completed_at, v.updated_at AS updated_at,
          CAST(NULL AS VARCHAR) AS before_status, CAST(NULL AS VARCHAR) AS outcome
        FROM val v LEFT JOIN (SELECT thread_id, list(DISTINCT action_id) AS ids FROM act GROUP BY thread_id) a USING (thread_id) WHERE v.errors = ''
        UNION ALL
        SELECT thread_id, n, seq, CASE WHEN ok AND moves THEN target ELSE status END, CASE WHEN ok THEN revision + 1 ELSE revision END,
          CASE WHEN ok AND kind = 'ADD_ACTION' THEN list_append(acts, action_id) ELSE acts END,
          CASE WHEN ok AND moves AND target = 'IMPLEMENTATION' AND started_at IS NULL THEN moment ELSE started_at END,
          CASE WHEN ok AND moves AND target = 'COMPLETED' THEN moment ELSE completed_at END,
          CASE WHEN ok THEN moment ELSE updated_at END,
          CASE WHEN moves THEN status END, outcome
        FROM (SELECT *, outcome = 'OK' AS ok, kind = 'SET_STATUS' AS moves FROM (
          SELECT s.thread_id, c.n, c.seq, c.moment, c.kind, c.status AS target, c.action_id, s.status, s.revision, s.acts, s.started_at, s.completed_at, s.updated_at,
            CASE WHEN c.kind = 'SET_STATUS' THEN
                CASE WHEN c.status NOT IN {_in(K.THREAD_STATUSES)} THEN 'INVALID_STATUS' WHEN c.status = s.status THEN 'SAME_STATUS'
                     WHEN {TRANSITION.format("s.status", "c.status")} THEN 'OK' ELSE 'INVALID_TRANSITION' END
              WHEN s.status IN ('COMPLETED', 'CANCELLED') THEN 'CLOSED_THREAD'
              WHEN c.kind = 'ADD_ACTION' THEN CASE WHEN list_contains(s.acts, c.action_id) THEN 'DUPLICATE_ACTION'
                     WHEN c.action_id = '' THEN 'INVALID_ACTION' ELSE 'OK' END
              WHEN list_contains(s.acts, c.action_id) THEN 'OK' ELSE 'ACTION_NOT_FOUND' END AS outcome
          FROM sim s JOIN cmdo c ON c.thread_id = s.thread_id AND c.n = s.n + 1))""",
    "last": """
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY thread_id ORDER BY n DESC) AS rn FROM sim) WHERE rn = 1""",
    "updo": """
        SELECT u.*, row_number() OVER (PARTITION BY information_id ORDER BY seq) AS n FROM upd u""",
    "usim": """
        SELECT information_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS seq, revision, content, CAST(NULL AS VARCHAR) AS outcome,
          CAST(NULL AS INTEGER) AS previous_revision FROM mem
        UNION ALL
        SELECT information_id, n, seq, CASE WHEN outcome = 'UPDATED' THEN revision + 1 ELSE revision END,
          CASE WHEN outcome = 'UPDATED' THEN new_content ELSE content END, outcome, previous_revision
        FROM (SELECT s.information_id, u.n, u.seq, s.revision, s.content, u.content AS new_content, u.previous_revision,
            CASE WHEN u.previous_revision <> s.revision THEN 'REVISION_CONFLICT'
                 WHEN u.new_information_id <> u.information_id THEN 'ID_MISMATCH' ELSE 'UPDATED' END AS outcome
          FROM usim s JOIN updo u ON u.information_id = s.information_id AND u.n = s.n + 1)""",
    "chg": """
        SELECT event_id AS seq, CASE WHEN event_id % 61 = 0 THEN 'thread ' ELSE 'thread-' END
            || CASE WHEN event_id % 3 = 0 THEN user_id + 10000000 ELSE user_id END AS thread_id,
          CASE event_type WHEN 'signup' THEN 'CREATE' WHEN 'error' THEN 'DELETE' ELSE 'UPDATE' END AS change,
          event_type || ' ' || event_id AS title, CAST(event_id % 9 + 1 AS INTEGER) AS revision
        FROM events""",
    "chgo": """
        SELECT *, row_number() OVER (PARTITION BY thread_id ORDER BY seq) AS n FROM chg""",
    "csim": """
        SELECT c.thread_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS seq, t.thread_id IS NOT NULL AS taken, t.title AS title, t.revision AS revision,
          CAST(NULL AS VARCHAR) AS outcome, CAST(NULL AS VARCHAR) AS change
        FROM (SELECT DISTINCT thread_id FROM chg) c LEFT JOIN thr t USING (thread_id)
        UNION ALL
        SELECT thread_id, n, seq, CASE WHEN outcome = 'OK' THEN change <> 'DELETE' ELSE taken END,
          CASE WHEN outcome = 'OK' AND change <> 'DELETE' THEN new_title ELSE title END,
          CASE WHEN outcome = 'OK' AND change <> 'DELETE' THEN new_revision ELSE revision END, outcome, change
        FROM (SELECT s.thread_id, c.n, c.seq, s.taken, s.title, s.revision, c.title AS new_title, c.revision AS new_revision, c.change,
            CASE WHEN contains(s.thread_id, ' ') THEN 'INVALID_ID' WHEN c.change = 'CREATE' AND s.taken THEN 'ALREADY_EXISTS'
                 WHEN c.change <> 'CREATE' AND NOT s.taken THEN 'NOT_FOUND' ELSE 'OK' END AS outcome
          FROM csim s JOIN chgo c ON c.thread_id = s.thread_id AND c.n = s.n + 1)""",
    "hst": f"""
        SELECT *, coalesce(information_id, thread_id) AS entity FROM (
        SELECT 'event-' || event_id AS event_id, CASE WHEN user_id % 2 = 0 THEN 'info-' || user_id WHEN event_id % 71 = 0 THEN 'info-0' END AS information_id,
          CASE WHEN user_id % 2 = 1 AND event_id % 73 <> 0 THEN 'thread-' || user_id END AS thread_id, event_id AS revision,
          CASE WHEN user_id % 2 = 0 THEN {_list(K.EPISTEMIC_STATUSES)}[event_id % 6 + 1] ELSE {_list(K.THREAD_STATUSES)}[event_id % 8 + 1] END AS before,
          CASE WHEN user_id % 2 = 0 THEN {_list(K.EPISTEMIC_STATUSES)}[event_id // 7 % 6 + 1] ELSE {_list(K.THREAD_STATUSES)}[event_id // 3 % 8 + 1] END AS after
        FROM events)""",
    "pld": """
        SELECT doc_id AS k, doc_id % 20 AS kind, doc_id % 3 > 0 AS is_revision, doc_id % 4 = 0 AS no_previous, doc_id % 2 = 0 AS s,
          doc_id % 2 = 1 AS u, doc_id % 3 = 0 AS x, doc_id % 7 = 0 AS g FROM documents""",
    "reqs": """
        SELECT c_custkey AS k, c_custkey % 28 AS v, 'thread-' || c_custkey AS tid FROM customer""",
    "near": """
        SELECT k, v, thread_id FROM reqs JOIN rel ON rel.source_id = tid WHERE v BETWEEN 1 AND 6
        UNION SELECT k, v, thread_id FROM reqs JOIN rel ON rel.target_id = tid WHERE v BETWEEN 1 AND 6""",
    "hits": """
        SELECT k, row_number() OVER (PARTITION BY k ORDER BY folded, thread_id || '.md') AS rank, t.thread_id, CAST(NULL AS VARCHAR) AS action_id,
            CAST(NULL AS VARCHAR) AS description, CAST(NULL AS VARCHAR) AS action_status, CAST(NULL AS VARCHAR) AS metadata, 0 AS off, 20 AS lim
          FROM near JOIN thr t USING (thread_id) WHERE v = 1
        UNION ALL SELECT k, row_number() OVER (PARTITION BY k ORDER BY updated_at DESC, thread_id || '.md'), t.thread_id, NULL, NULL, NULL, NULL, 0, 3
          FROM near JOIN thr t USING (thread_id) WHERE v = 2 AND status NOT IN ('COMPLETED', 'CANCELLED')
        UNION ALL SELECT k, row_number() OVER (PARTITION BY k ORDER BY t.revision DESC, thread_id || '.md'), t.thread_id, NULL, NULL, NULL, NULL, 0, 20
          FROM near JOIN thr t USING (thread_id) WHERE v = 3 AND status IN ('TESTING', 'PAUSED')
        UNION ALL SELECT k, row_number() OVER (PARTITION BY k ORDER BY thread_id || '.md', pos, action_id, description, metadata), a.thread_id, action_id, description, a.status, metadata, 1, 5
          FROM near JOIN thr USING (thread_id) JOIN (SELECT * FROM act WHERE status IN ('PLANNED', 'IN_PROGRESS', 'BLOCKED')) a USING (thread_id) WHERE v = 4
        UNION ALL SELECT k, row_number() OVER (PARTITION BY k ORDER BY updated_at DESC, thread_id || '.md'), t.thread_id, NULL, NULL, NULL, NULL, 1, 2
          FROM near JOIN thr t USING (thread_id) WHERE v = 5 AND created_at > '1995'
        UNION ALL SELECT k, row_number() OVER (PARTITION BY k ORDER BY thread_id || '.md', pos, action_id, description, metadata), a.thread_id, action_id, description, a.status, metadata, 0, 20
          FROM near JOIN thr USING (thread_id) JOIN (SELECT * FROM act WHERE status = 'PLANNED') a USING (thread_id) WHERE v = 6
        UNION ALL SELECT k, 1, thread_id, NULL, NULL, NULL, NULL, 0, 1 FROM reqs JOIN thr ON thread_id = tid WHERE v = 0""",
    "page": """
        SELECT k AS request_id, CAST(rank - off AS INTEGER) AS rank, thread_id, action_id, description, action_status, metadata
        FROM hits WHERE rank > off AND rank <= off + lim""",
    "tjs": f"""
        SELECT thread_id, '{{"completed_at":' || {_json("completed_at")} || ',"context":' || context || ',"created_at":"' || created_at
          || '","objective":"' || objective || '","provenance":{{"desk":"' || desk || '","rank":' || rnk || ',"state":"' || state
          || '"}},"revision":' || revision || ',"started_at":' || {_json("started_at")} || ',"status":"' || status || '","thread_id":"' || thread_id
          || '","title":' || {_json("title")} || ',"updated_at":"' || updated_at || '"}}' AS data FROM thr""",
}
_ARR = (
    "CASE WHEN {0} = '' THEN '[]' ELSE '[\"' || replace({0}, '; ', '\",\"') || '\"]' END"
)
BASE["rte"] = re.sub(r"\{arr:(\w+)\}", lambda m: _ARR.format(m.group(1)), BASE["rte"])

_HEAD = "thread_id, title, status, revision, updated_at"


def _page(columns: str, where: str, order: str, limit: int, offset: int = 0) -> str:
    return (
        f"SELECT {columns} FROM thr WHERE {where} ORDER BY {order}, thread_id || '.md' LIMIT {limit} OFFSET {offset}"
    )


def _state_json(e: str, o: str) -> str:
    return f"""'{{"epistemic_status":"' || {e} || '","operational_state":"' || {o} || '"}}'"""


_TERMS = ["content", "straße", "the", "of", "der", "que", "of"]
_SUM = " + ".join(f"CASE WHEN contains(hay, {_q(t)}) THEN 1 ELSE 0 END" for t in _TERMS)
_SORTED = "thread_id, title, status, revision, started_at"
_NOW = "2025-01-01T00:00:00Z"


def _batch_search(queries: str, limit: int) -> str:
    return f"""
      SELECT query_id, CAST(rank AS INTEGER) AS rank, information_id, score FROM (
        SELECT query_id, information_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, information_id || '.md') AS rank
        FROM (SELECT query_id, information_id, found / n AS score FROM (
          SELECT q.query_id, m.information_id, len(q.terms) AS n, len(list_filter(q.terms, lambda t: contains(m.hay, t))) AS found
          FROM ({queries}) q, mem m) WHERE found > 0)) WHERE rank <= {limit}"""


BODY = {
    "list_open_threads": _page(_HEAD, "status NOT IN ('COMPLETED', 'CANCELLED')", "updated_at DESC", 20),
    "list_threads": _page(_HEAD + ", created_at", "true", "created_at", 100, 25),
    "threads_by_status": _page(_HEAD, "status IN ('TESTING', 'PAUSED')", "updated_at DESC", 500),
    "get_thread": f"SELECT {_HEAD}, context, objective FROM thr WHERE thread_id = 'thread-42'",
    "threads_title_eq": f"SELECT {_HEAD} FROM thr WHERE title = '1-URGENT topic 500'",
    "threads_title_contains": f"SELECT {_HEAD} FROM thr WHERE contains(folded, 'low strasse 1')",
    "threads_by_relation": "SELECT thread_id, status FROM thr WHERE thread_id IN (SELECT thread_id FROM rel WHERE type = 'SUPERSEDES')",
    "threads_related_to": """SELECT thread_id, status FROM thr WHERE thread_id IN (SELECT thread_id FROM rel WHERE type = 'PART_OF')
        AND thread_id IN (SELECT thread_id FROM rel WHERE source_id = 'thread-50' OR target_id = 'thread-50')""",
    "threads_by_provenance": "SELECT thread_id, title, '\"' || desk || '\"' AS desk FROM thr WHERE state = 'F' AND rnk = 3",
    "threads_created_between": "SELECT thread_id, created_at FROM thr WHERE created_at > '1995-03-01' AND created_at < '1995-06-01T00:00:00Z'",
    "threads_updated_between": "SELECT thread_id, updated_at FROM thr WHERE updated_at > '1996-12-24' AND updated_at < '1997'",
    "threads_started_between": """SELECT thread_id, started_at FROM thr
        WHERE strptime(started_at, '%Y-%m-%dT%H:%M:%SZ') > TIMESTAMP '1998-01-31 22:00:00' AND strptime(started_at, '%Y-%m-%dT%H:%M:%SZ') < TIMESTAMP '1998-03-01 00:00:00'""",
    "open_actions": """SELECT thread_id, t.title AS thread_title, action_id, description, a.status FROM act a JOIN thr t USING (thread_id)
        WHERE a.status IN ('PLANNED', 'IN_PROGRESS', 'BLOCKED') AND updated_at > '1996'
        ORDER BY thread_id || '.md', pos, action_id, description, metadata LIMIT 300 OFFSET 10""",
    "thread_actions_by_status": """SELECT thread_id, t.status AS thread_status, action_id, description, a.status FROM act a JOIN thr t USING (thread_id)
        WHERE a.status IN ('BLOCKED', 'CANCELLED') AND action_id = 'action-3'
        ORDER BY thread_id || '.md', pos, action_id, description, metadata LIMIT 1000""",
    "threads_sorted_title": _page(_SORTED, "true", "folded", 200, 5),
    "threads_sorted_revision": _page(_SORTED, "true", "revision DESC", 200, 5),
    "threads_sorted_status": _page(_SORTED, "true", "status DESC", 200, 5),
    "threads_sorted_started_at": _page(_SORTED, "true", "coalesce(started_at, '')", 200, 5),
    "threads_deep_page": """SELECT rank, thread_id, title, status FROM (
            SELECT *, row_number() OVER (ORDER BY folded, thread_id || '.md') - 1 AS rank, count(*) OVER () AS n FROM thr)
        WHERE rank >= n * 4 // 5 AND rank < n * 4 // 5 + 300""",
    "thread_json_rows": "SELECT thread_id, data FROM tjs",
    "thread_action_json_rows": f"""SELECT thread_id, action_id, sha256('{{"action":{{"action_id":"' || action_id || '","description":' || {_json("description")}
        || ',"metadata":' || metadata || ',"status":"' || status || '"}},"thread":' || data || '}}') AS data_sha FROM act JOIN tjs USING (thread_id)""",
    "request_rejects": """SELECT k AS request_id, CASE v WHEN 7 THEN 'INVALID_JSON' WHEN 8 THEN 'NOT_AN_OBJECT' WHEN 9 THEN 'REQUEST_MISSING'
          WHEN 10 THEN 'REQUEST_NOT_AN_OBJECT' WHEN 11 THEN 'FIELDS_MISSING: schema_version, intent' WHEN 12 THEN 'FILTERS_NOT_AN_OBJECT'
          WHEN 13 THEN 'UNSUPPORTED_SCHEMA' WHEN 14 THEN 'DOMAIN_EMPTY' WHEN 15 THEN 'INTENT_EMPTY' WHEN 16 THEN 'UNSUPPORTED_DOMAIN'
          WHEN 17 THEN 'UNSUPPORTED_INTENT' WHEN 18 THEN 'THREAD_ID_REQUIRED' WHEN 19 THEN 'LIMIT_TOO_SMALL' WHEN 20 THEN 'LIMIT_TOO_LARGE'
          WHEN 21 THEN 'OFFSET_NEGATIVE' WHEN 22 THEN 'TITLE_EMPTY' WHEN 23 THEN 'TITLE_CONTAINS_EMPTY' WHEN 24 THEN 'STATUS_REQUIRED'
          WHEN 25 THEN 'THREAD_ID_REQUIRED_WITH_ACTION_ID' WHEN 26 THEN 'UNKNOWN_FILTER' ELSE 'UNKNOWN_SORT' END AS error FROM reqs WHERE v >= 7""",
    "request_results": "SELECT request_id, rank, thread_id, action_id FROM page",
    "request_results_broad": " UNION ALL ".join(
        f"""SELECT CAST(n AS BIGINT) AS request_id, CAST(rank - off AS INTEGER) AS rank, thread_id FROM (
          SELECT n, n * 3 AS off, n + 1 AS lim, thread_id, row_number() OVER (PARTITION BY n ORDER BY {key} {way} NULLS LAST, thread_id || '.md') AS rank
          FROM (SELECT CAST(n_nationkey AS BIGINT) AS n FROM nation) JOIN thr ON CASE WHEN n < 8 THEN n <> 5 OR created_at < '1996'
            WHEN n < 16 THEN status NOT IN ('COMPLETED', 'CANCELLED') ELSE status = 'TESTING' END
          WHERE n % 6 = {i} AND (n % 4 < 2) = {way == "ASC"}) WHERE rank > off AND rank <= off + lim"""
        for i, key in enumerate(("created_at", "updated_at", "coalesce(started_at, '')", "folded", "status", "revision"))
        for way in ("ASC", "DESC")
    ),
    "request_responses": f"""SELECT r.k AS request_id, '{{"response":{{"data":[' || coalesce(items, '') || '],"domain":"THREAD","intent":"'
          || ['GET_THREAD', 'LIST_THREADS', 'LIST_OPEN_THREADS', 'LIST_THREADS_BY_STATUS', 'LIST_OPEN_ACTIONS', 'LIST_THREADS', 'LIST_THREAD_ACTIONS'][v + 1]
          || '","schema_version":"0.1","status":"OK"}}}}' AS response
        FROM reqs r LEFT JOIN (SELECT request_id, string_agg(CASE WHEN action_id IS NULL THEN data ELSE '{{"action":{{"action_id":"' || action_id || '","description":' || {_json("description")}
          || ',"metadata":' || metadata || ',"status":"' || action_status || '"}},"thread":' || data || '}}' END, ',' ORDER BY rank) AS items
          FROM page JOIN tjs USING (thread_id) GROUP BY request_id) p ON p.request_id = r.k WHERE v < 7""",
    "memories_filtered": """SELECT information_id, revision, CAST(length(content) AS INTEGER) AS length FROM mem WHERE lang = 'en' AND source = 'src3'
        ORDER BY information_id || '.md' LIMIT 100 OFFSET 3""",
    "memory_lookup": "SELECT information_id, m.revision, m.revision IS NOT NULL AS found FROM (SELECT DISTINCT information_id FROM arr) k LEFT JOIN mem m USING (information_id)",
    "existing_memories": "SELECT seq, information_id FROM arr WHERE information_id IN (SELECT information_id FROM mem)",
    "invalid_ids": "SELECT seq, information_id FROM arr WHERE NOT regexp_full_match(information_id, '[A-Za-z0-9._-]+')",
    "term_search": f"""SELECT information_id, CAST(matches AS INTEGER) AS matches, matches / 7.0::DOUBLE AS score FROM (SELECT *, {_SUM} AS matches FROM mem)
        WHERE matches > 0 ORDER BY matches DESC, information_id || '.md' LIMIT 50""",
    "term_search_batch": _batch_search(
        "SELECT DISTINCT p_name AS query_id, regexp_extract_all(lower(p_name), '[\\p{L}\\p{N}_]+') AS terms FROM part", 25
    ),
    "term_search_passages": _batch_search(
        "SELECT item_id AS query_id, list_transform(regexp_extract_all(text, '[\\p{L}\\p{N}_]+'), lambda w: lower(w)) AS terms FROM benchmark", 10
    ),
    "memory_store": """SELECT seq, information_id, revision, CASE WHEN contains(information_id, ' ') THEN 'INVALID_ID' WHEN revision < 1 THEN 'INVALID_REVISION'
          WHEN information_id IN (SELECT information_id FROM mem) OR row_number() OVER (PARTITION BY information_id, revision >= 1 ORDER BY seq) > 1
          THEN 'ALREADY_EXISTS' ELSE 'STORED' END AS outcome FROM arr""",
    "memory_store_snapshot": """SELECT information_id, revision, sha256(content) AS content_sha FROM mem UNION ALL
        SELECT information_id, revision, sha256(content) FROM (SELECT *, row_number() OVER (PARTITION BY information_id ORDER BY seq) AS rn FROM arr
          WHERE NOT contains(information_id, ' ') AND revision >= 1 AND information_id NOT IN (SELECT information_id FROM mem)) WHERE rn = 1""",
    "memory_update": """SELECT seq, information_id, previous_revision, CASE WHEN outcome = 'UPDATED' THEN revision END AS revision, outcome FROM usim WHERE n > 0
        UNION ALL SELECT seq, information_id, previous_revision, NULL, 'NOT_FOUND' FROM upd WHERE information_id NOT IN (SELECT information_id FROM mem)""",
    "memory_update_snapshot": """SELECT information_id, revision, sha256(content) AS content_sha FROM (
          SELECT *, row_number() OVER (PARTITION BY information_id ORDER BY n DESC) AS rn FROM usim) WHERE rn = 1""",
    "delete_requests": "SELECT seq, information_id, operation_id, outcome FROM delo",
    "delete_requests_on_file": "SELECT * FROM delp",
    "delete_decisions": "SELECT seq, information_id, operation_id, decision, outcome FROM delx",
    "memories_after_deletes": "SELECT information_id, revision FROM mem WHERE information_id NOT IN (SELECT information_id FROM delx WHERE outcome = 'DELETED')",
    "invalid_threads": "SELECT thread_id, error, errors FROM val WHERE errors <> ''",
    "duplicate_actions": "SELECT thread_id, action_id, count(*) AS uses FROM act GROUP BY ALL HAVING count(*) > 1",
    "illegal_transitions": f"""SELECT * FROM (SELECT seq, thread_id, t.status AS from_status, c.status AS to_status,
          CASE WHEN c.status NOT IN {_in(K.THREAD_STATUSES)} THEN 'INVALID_STATUS' WHEN c.status = t.status THEN 'SAME_STATUS'
               WHEN NOT ({TRANSITION.format("t.status", "c.status")}) THEN 'INVALID_TRANSITION' END AS error
        FROM cmd c JOIN thr t USING (thread_id) WHERE kind = 'SET_STATUS') WHERE error IS NOT NULL""",
    "command_outcomes": """SELECT c.seq, c.thread_id, c.kind, s.before_status, coalesce(s.outcome, CASE WHEN t.thread_id IS NULL THEN 'THREAD_NOT_FOUND' ELSE 'INVALID_THREAD' END) AS outcome,
          coalesce(s.revision, t.revision) AS revision FROM cmd c LEFT JOIN thr t USING (thread_id) LEFT JOIN (SELECT * FROM sim WHERE n > 0) s ON s.seq = c.seq""",
    "thread_snapshot_after_log": """SELECT t.thread_id, coalesce(l.status, t.status) AS status, coalesce(l.revision, t.revision) AS revision,
          coalesce(l.updated_at, t.updated_at) AS updated_at, coalesce(l.started_at, t.started_at) AS started_at, coalesce(l.completed_at, t.completed_at) AS completed_at
        FROM thr t LEFT JOIN last l USING (thread_id)""",
    "thread_actions_after_log": """SELECT b.thread_id, b.pos, b.action_id, b.description, coalesce(u.status, b.status) AS status FROM (
          SELECT thread_id, pos, action_id, description, status FROM act UNION ALL
          SELECT c.thread_id, CAST(coalesce(m.top, 0) + row_number() OVER (PARTITION BY c.thread_id ORDER BY c.seq) AS INTEGER), action_id, description, c.status
          FROM cmd c JOIN sim s ON s.seq = c.seq AND s.outcome = 'OK' LEFT JOIN (SELECT thread_id, max(pos) AS top FROM act GROUP BY 1) m ON m.thread_id = c.thread_id
          WHERE c.kind = 'ADD_ACTION') b
        LEFT JOIN (SELECT c.thread_id, c.action_id, arg_max(c.status, c.seq) AS status FROM cmd c JOIN sim s ON s.seq = c.seq AND s.outcome = 'OK'
          WHERE c.kind = 'SET_ACTION_STATUS' GROUP BY 1, 2) u ON u.thread_id = b.thread_id AND u.action_id = b.action_id""",
    "status_change_events": """SELECT 'event-' || sha256(c.thread_id || '|' || c.seq) AS event_id, c.thread_id, s.revision, 'STATUS_CHANGED' AS event_type,
          s.before_status AS before, c.status AS after, c.moment AS timestamp FROM cmd c JOIN sim s ON s.seq = c.seq AND s.outcome = 'OK' WHERE c.kind = 'SET_STATUS'""",
    "thread_upserts": "SELECT seq, thread_id, change, outcome FROM csim WHERE n > 0",
    "threads_after_upserts": """SELECT thread_id, title, revision FROM thr WHERE thread_id NOT IN (SELECT thread_id FROM chg) UNION ALL
        SELECT thread_id, title, revision FROM (SELECT *, row_number() OVER (PARTITION BY thread_id ORDER BY n DESC) AS rn FROM csim) WHERE rn = 1 AND taken""",
    "early_updates": "SELECT thread_id, created_at, updated_at FROM thr WHERE updated_at < created_at",
    "reopened_actions": """SELECT seq, thread_id, action_id FROM (SELECT c.seq, c.thread_id, c.action_id, c.status,
          lag(c.status) OVER (PARTITION BY c.thread_id, c.action_id ORDER BY c.seq) AS previous FROM cmd c JOIN sim s ON s.seq = c.seq AND s.outcome = 'OK'
          WHERE c.kind <> 'SET_STATUS') WHERE previous = 'COMPLETED' AND status = 'PLANNED'""",
    "invalid_information": "SELECT 'working/' || id || '.md' AS path, id, errors FROM err WHERE errors <> ''",
    "missing_fields": "SELECT 'retention' AS field, count(*) AS records FROM err WHERE NOT has_retention HAVING count(*) > 0",
    "semantic_report": f"""SELECT 'working/' || id || '.md' AS path, concat_ws('; ',
          CASE WHEN epistemic_status NOT IN {_in(K.EPISTEMIC_STATUSES)} THEN 'epistemic_status invalide: ' || epistemic_status END,
          CASE WHEN operational_state NOT IN {_in(K.OPERATIONAL_STATES)} THEN 'operational_state invalide: ' || operational_state END,
          CASE WHEN relation_type NOT IN {_in(K.RELATION_TYPES)} THEN 'relation invalide: ' || relation_type END,
          CASE WHEN source_type = 'RUMOUR' THEN 'source_type invalide: RUMOUR' END) AS errors, '' AS warnings FROM fact""",
    "semantic_error_counts": f"""SELECT error, count(*) AS records FROM (
          SELECT 'epistemic_status invalide: ' || epistemic_status AS error FROM fact WHERE epistemic_status NOT IN {_in(K.EPISTEMIC_STATUSES)}
          UNION ALL SELECT 'operational_state invalide: ' || operational_state FROM fact WHERE operational_state NOT IN {_in(K.OPERATIONAL_STATES)}
          UNION ALL SELECT 'relation invalide: ' || relation_type FROM fact WHERE relation_type NOT IN {_in(K.RELATION_TYPES)}
          UNION ALL SELECT 'source_type invalide: RUMOUR' FROM fact WHERE source_type = 'RUMOUR') GROUP BY error""",
    "information_front_matter": """SELECT id, number, is_revision, previous AS previous_revision, type, epistemic_status, source AS project, source_type, created_at,
          relation_type, CASE WHEN has_retention THEN 'NORMAL' END AS retention, sha256(content) AS content_sha FROM txt""",
    "ingested_information": f"""SELECT id, type, 'UNVERIFIED' AS epistemic_status, 'ACTIVE' AS operational_state, 'ANALYSIS' AS mode,
          CASE WHEN role = 'user' THEN 'USER_STATEMENT' ELSE 'MODEL_OUTPUT' END AS source_type, sha256(text) AS content_sha FROM iarr WHERE type IN {_in(K.INFORMATION_TYPES)}""",
    "created_events": f"""SELECT 'event-' || sha256(id || '|CREATED') AS event_id, id AS information_id, 1 AS revision, 'CREATED' AS event_type,
          '{{"epistemic_status":"UNVERIFIED","operational_state":"ACTIVE"}}' AS after, {_q(K.CREATED_DESCRIPTION)} AS description FROM iarr WHERE type IN {_in(K.INFORMATION_TYPES)}""",
    "ingest_reviews": f"""SELECT 'review-' || sha256(id) AS review_id, id AS information_id, 'PENDING_REVIEW' AS status, {_q(K.DECISION_REVIEW_REASON)} AS reason,
          '{_NOW}' AS created_at FROM iarr WHERE type = 'DECISION'""",
    "ingest_rejects": f"SELECT id, type, 'type invalide : ' || type AS error FROM iarr WHERE type NOT IN {_in(K.INFORMATION_TYPES)}",
    "manual_updates": """SELECT m.seq, m.id, coalesce(s.outcome, 'NOT_FOUND') AS outcome, CASE WHEN s.outcome = 'UPDATED' THEN s.revision END AS revision
        FROM man m LEFT JOIN (SELECT * FROM mans WHERE n > 0) s ON s.seq = m.seq""",
    "manual_update_events": """SELECT id AS information_id, revision, be AS before_epistemic_status, e AS after_epistemic_status, bo AS before_operational_state, o AS after_operational_state,
          bi AS before_importance, i AS after_importance, reason AS description FROM mans WHERE outcome = 'UPDATED'""",
    "information_after_updates": """SELECT id, revision AS number, e AS epistemic_status, o AS operational_state, c AS confidence, i AS importance FROM (
          SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC) AS rn FROM mans) WHERE rn = 1""",
    "review_outcomes": "SELECT seq, review_id, decision, outcome FROM deco",
    "resolved_reviews": """SELECT r.review_id, r.information_id, CASE WHEN d.seq IS NOT NULL THEN 'RESOLVED' ELSE r.status END AS status, d.decision,
          CASE WHEN d.seq IS NOT NULL THEN 'human' END AS resolver FROM rev r LEFT JOIN (SELECT * FROM deco WHERE outcome = 'RESOLVED') d USING (review_id)""",
    "review_events": f"""SELECT information_id, CAST(number + 1 AS INTEGER) AS revision, 'REVIEW_RESOLVED' AS event_type, {_state_json("'UNVERIFIED'", "operational_state")} AS before,
          {_state_json("decision", "operational_state")} AS after, reason AS description FROM deco WHERE outcome = 'RESOLVED'""",
    "pending_reviews": "SELECT review_id, information_id FROM rev WHERE status = 'PENDING_REVIEW'",
    "relation_checks": "SELECT seq, source_id, type, target_id, errors, warnings FROM chk",
    "relation_outcomes": "SELECT seq, source_id, type, target_id, outcome FROM relo",
    "applied_relations": """SELECT source_id, pos, type, target_id FROM irel UNION ALL
        SELECT a.source_id, CAST(coalesce(i.pos, -1) + n AS INTEGER), a.type, a.target_id FROM rela a LEFT JOIN irel i ON i.source_id = a.source_id""",
    "relation_events": """SELECT 'event-' || sha256(source_id || '|' || type || '|' || target_id) AS event_id, source_id AS information_id, CAST(number + n AS INTEGER) AS revision,
          CAST(number + n - 1 AS INTEGER) AS before_revision, 'Relation ' || type || ' ajoutée vers ' || target_id || '.' AS description FROM rela""",
    "relation_reviews": """SELECT review_id, source_id AS information_id, target_id AS target_information_id, type AS relation_type, 'PENDING_REVIEW' AS status
        FROM rela WHERE review_id IS NOT NULL""",
    "information_after_relations": "SELECT f.id, CAST(f.number + coalesce(max(n), 0) AS INTEGER) AS number FROM fact f LEFT JOIN rela a ON a.source_id = f.id GROUP BY f.id, f.number UNION ALL SELECT 'memo-' || k, number FROM fact WHERE k % 19 = 0",
    "mechanism_classes": """SELECT id, type, 'YES' AS working, episodic, 'POSSIBLE' AS semantic, associative, procedural, 'NO' AS prospective FROM mech""",
    "mechanism_long": f"""SELECT id, 'WORKING' AS mechanism, 'YES' AS status, {_q(K.WORKING_REASON)} AS reason FROM mech
        UNION ALL SELECT id, 'EPISODIC', episodic, episodic_reason FROM mech UNION ALL SELECT id, 'SEMANTIC', 'POSSIBLE', semantic_reason FROM mech
        UNION ALL SELECT id, 'ASSOCIATIVE', associative, associative_reason FROM mech UNION ALL SELECT id, 'PROCEDURAL', procedural, procedural_reason FROM mech
        UNION ALL SELECT id, 'PROSPECTIVE', 'NO', {_q(K.PROSPECTIVE_REASON)} FROM mech""",
    "revision_normalised": "SELECT path, number, is_revision, previous AS previous_revision FROM txt",
    "routing": """SELECT id AS information_id, confirmed, possible, rejected, NOT is_revision AS store_required, is_revision AS update_required, idx AS index_required,
          false AS ignore_required, index_reason FROM rte""",
    "plan_rejects": """SELECT k AS plan_id, CASE kind WHEN 0 THEN 'Memory Plan JSON invalide' WHEN 1 THEN 'Champ memory_plan absent.' WHEN 2 THEN 'memory_plan doit être un objet.'
          WHEN 3 THEN 'Schema non supporté : ''0.1''. Version attendue : 0.2.' WHEN 4 THEN 'Schema non supporté : 2. Version attendue : 0.2.'
          WHEN 5 THEN 'Champ information absent ou invalide.' WHEN 6 THEN 'Information incomplète. Champs manquants : retention'
          WHEN 7 THEN 'information.identity invalide.' WHEN 8 THEN 'information.identity.id absent.' WHEN 9 THEN 'information.identity.revision invalide.'
          WHEN 10 THEN 'information.identity.revision.number absent.' WHEN 11 THEN 'information.classification invalide.'
          WHEN 12 THEN 'Champ operations absent ou invalide.' WHEN 13 THEN 'Opération STORE absente.' WHEN 14 THEN 'Opération UPDATE invalide.'
          WHEN 15 THEN 'Opération INDEX : champ required absent.' ELSE 'Opération IGNORE : champ reason absent.' END AS error FROM pld WHERE kind <= 16""",
    "execution_plan_rejects": """SELECT doc_id AS plan_id, CASE doc_id % 12 WHEN 0 THEN 'Execution Plan invalide : objet JSON attendu.' WHEN 1 THEN 'Champ execution_plan absent ou invalide.'
          WHEN 2 THEN 'Execution Plan schema non supporté : None. Version attendue : 0.3.' WHEN 3 THEN 'Execution Plan : operation_id absent ou invalide.'
          WHEN 4 THEN 'Execution Plan : input absent ou invalide.' WHEN 5 THEN 'Execution Plan : information_id absent ou invalide.'
          WHEN 6 THEN 'Execution Plan : revision absente ou invalide.' WHEN 7 THEN 'Execution Plan : operations absentes ou invalides.'
          WHEN 8 THEN 'Execution Plan : opération INDEX absente.' ELSE 'Execution Plan : opération IGNORE absente.' END AS error FROM documents WHERE doc_id % 12 <= 9""",
    "prepared_operations": f"""SELECT k AS plan_id, CASE WHEN s THEN 'READY' ELSE 'NOT_REQUESTED' END AS store_status,
          CASE WHEN NOT u THEN 'NOT_REQUESTED' WHEN NOT is_revision OR no_previous THEN 'BLOCKED' ELSE 'READY' END AS update_status,
          CASE WHEN x THEN 'PENDING' ELSE 'NOT_REQUESTED' END AS index_status, CASE WHEN g THEN 'IGNORED' ELSE 'NOT_REQUESTED' END AS ignore_status,
          CASE WHEN u AND NOT is_revision THEN {_q(K.UPDATE_WITHOUT_FLAG)} WHEN u AND no_previous THEN {_q(K.UPDATE_WITHOUT_PREVIOUS)} ELSE 'update' END AS update_reason
        FROM pld WHERE kind > 16""",
    "contradictory_plans": "SELECT k AS plan_id, s AS store_required, u AS update_required, x AS index_required FROM pld WHERE kind > 16 AND g AND (s OR u OR x)",
    "operation_ids": "SELECT id AS information_id, operation_id FROM pln",
    "execution_plans": "SELECT id AS information_id, operation_id, store_status, update_status, index_status, execution_plan_hash FROM exe",
    "idempotency_states": "SELECT id AS information_id, CASE lang WHEN 'fr' THEN 'ALREADY_EXECUTED' WHEN 'de' THEN 'CONFLICT' ELSE 'NEW' END AS idempotency FROM fact",
    "plan_decisions": f"""SELECT id AS information_id, CASE WHEN rule IN ('CONFLICT', 'ALREADY_EXECUTED', 'PARTIAL') THEN rule ELSE 'NEW' END AS idempotency,
          CASE rule WHEN 'ALREADY_EXECUTED' THEN 'NO-OP' WHEN 'PARTIAL' THEN 'ALLOW' WHEN 'UPDATE_ALLOWED' THEN 'ALLOW' WHEN 'STORE_ALLOWED' THEN 'ALLOW' ELSE 'BLOCK' END AS decision,
          CASE rule {" ".join(f"WHEN {_q(a)} THEN {_q(b)}" for a, b in K.DECISION_REASONS.items())} END AS decision_reason FROM dcs""",
    "applied_plans": "SELECT k AS seq, id AS information_id, result, code FROM app",
    "plan_events": f"""SELECT id AS information_id, number AS revision, CASE WHEN code = 'STORE' THEN 'STORED' ELSE 'UPDATED' END AS event_type,
          {_state_json("epistemic_status", "operational_state")} AS after, CASE WHEN code = 'STORE' THEN 'MEMORY_OPERATION' ELSE 'NEW_INFORMATION' END AS cause_type,
          CASE WHEN code = 'STORE' THEN {_q(K.STORED_DESCRIPTION)} ELSE {_q(K.UPDATED_DESCRIPTION)} END AS description FROM app WHERE code IN ('STORE', 'UPDATE', 'INDEX', 'INDEX_REFUSED')""",
    "ledger_rows": """SELECT id AS information_id, CASE WHEN code = 'STORE' THEN 'STORE' ELSE 'UPDATE' END AS result, 'EXECUTED' AS status, operation_id, execution_plan_hash
        FROM app WHERE code IN ('STORE', 'UPDATE', 'INDEX', 'INDEX_REFUSED')""",
    "ledger_written": """SELECT id AS information_id, CASE WHEN code = 'STORE' THEN 'STORE' ELSE 'UPDATE' END AS result, 'EXECUTED' AS status, operation_id, execution_plan_hash
        FROM app WHERE code IN ('STORE', 'UPDATE', 'INDEX', 'INDEX_REFUSED')""",
    "events_written": f"""SELECT id AS information_id, number AS revision, CASE WHEN code = 'STORE' THEN 'STORED' ELSE 'UPDATED' END AS event_type,
          {_state_json("epistemic_status", "operational_state")} AS after, CASE WHEN code = 'STORE' THEN 'MEMORY_OPERATION' ELSE 'NEW_INFORMATION' END AS cause_type,
          CASE WHEN code = 'STORE' THEN {_q(K.STORED_DESCRIPTION)} ELSE {_q(K.UPDATED_DESCRIPTION)} END AS description FROM app WHERE code IN ('STORE', 'UPDATE', 'INDEX', 'INDEX_REFUSED')""",
    "ledger_scan": """SELECT 'op-' || c_custkey || '.json' AS file, CASE WHEN error IS NULL THEN 'info-' || c_custkey END AS information_id,
          CASE WHEN error IS NULL THEN CASE WHEN c_custkey % 2 = 0 THEN 'STORE' ELSE 'UPDATE' END END AS result, CASE WHEN error IS NULL THEN sha256(c_name) END AS execution_plan_hash, error
        FROM (SELECT *, CASE c_custkey % 11 WHEN 3 THEN 'ID_CONFLICT' WHEN 5 THEN 'INVALID_JSON' WHEN 7 THEN 'NOT_AN_OBJECT' END AS error FROM customer)""",
    "stream_ingest": """SELECT 'info-' || doc_id AS information_id, CAST(doc_id % 4 + 1 AS INTEGER) AS revision, sha256(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS content_sha
        FROM documents WHERE doc_id % 13 NOT IN (5, 6)
        UNION ALL SELECT CASE doc_id % 13 WHEN 5 THEN 'missing identity information' ELSE 'invalid JSON in section ''Provenance''' END, CAST(count(*) AS INTEGER), NULL
        FROM documents WHERE doc_id % 13 IN (5, 6) GROUP BY 1""",
    "persistent_after_plans": """SELECT 'persistent/' || id || '.md' AS path, sha256(CASE WHEN there AND NOT (rule = 'UPDATE_ALLOWED' AND code IN ('UPDATE', 'INDEX')) AND structured
          THEN replace(body, 'revision:' || chr(10) || '  number: ' || number || chr(10), 'revision:' || chr(10) || '  number: ' || p_number || chr(10)) ELSE body END) AS text_sha
        FROM app WHERE there OR code = 'STORE'""",
    "index_outcomes": """SELECT k AS seq, id AS information_id, CASE code WHEN 'INDEX' THEN 'READY' ELSE 'REFUSED' END AS index_status FROM app WHERE code IN ('INDEX', 'INDEX_REFUSED')""",
    "corpus_threads": f"""SELECT 'threads/' || thread_id || '.md' AS path,
          CASE kind WHEN 5 THEN 'missing Thread identity information' WHEN 6 THEN 'invalid Thread status: ASLEEP' WHEN 4 THEN 'invalid JSON in section ''Actions'''
               WHEN 1 THEN 'Actions must contain a JSON array' WHEN 2 THEN 'invalid action entry' WHEN 3 THEN 'invalid Thread action' END AS parse_error,
          thread_id, CASE WHEN trim(title) = '' THEN 'status: ' || CASE kind WHEN 6 THEN 'ASLEEP' ELSE status END ELSE title END AS title, objective,
          CASE kind WHEN 6 THEN 'ASLEEP' ELSE status END AS status, CASE WHEN kind <> 5 THEN revision END AS revision,
          CASE kind WHEN 7 THEN '{{}}' ELSE context END AS context,
          CASE kind WHEN 1 THEN NULL WHEN 2 THEN '' WHEN 3 THEN '' WHEN 4 THEN NULL ELSE {_list(K.ACTION_STATUSES)}[k % 5 + 1] || ',PLANNED' END AS action_statuses,
          'thread-' || o_custkey AS targets, CASE kind WHEN 8 THEN 'None' ELSE created_at END AS created_at, started_at, '"import"' AS source
        FROM (SELECT t.*, o_orderkey AS k, o_orderkey % 17 AS kind, o_custkey FROM thr t JOIN orders ON thread_id = 'thread-' || o_orderkey)""",
    "corpus_memories": """SELECT 'memories/info-' || doc_id || '.md' AS path,
          CASE doc_id % 13 WHEN 5 THEN 'missing identity information' WHEN 6 THEN 'invalid JSON in section ''Provenance''' END AS parse_error,
          'info-' || doc_id AS information_id, CASE WHEN doc_id % 13 <> 5 THEN CAST(doc_id % 4 + 1 AS INTEGER) END AS revision,
          sha256(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS content_sha, '{"lang":"' || lang || '","source":"' || source || '"}' AS metadata,
          '[]' AS relations, '{}' AS verification FROM documents""",
    "stream_idempotency": """SELECT operation_id, execution_plan_hash, CASE WHEN known THEN CASE WHEN execution_plan_hash = sha256('click') THEN 'ALREADY_EXECUTED' ELSE 'CONFLICT' END
          WHEN row_number() OVER (PARTITION BY operation_id ORDER BY seq) = 1 THEN 'NEW' ELSE 'CONFLICT' END AS idempotency
        FROM (SELECT 'op-' || (event_id % 700) AS operation_id, sha256(event_type) AS execution_plan_hash, min(event_id) AS seq,
            event_id % 700 % 7 = 0 AND event_id % 700 // 7 IN (SELECT c_custkey FROM customer) AS known FROM events GROUP BY ALL)""",
    "valid_at": """SELECT id, type FROM fact WHERE (k % 5 = 0 OR strptime(created_at, '%Y-%m-%dT%H:%M:%SZ') <= TIMESTAMP '2025-03-01 12:00:00')
        AND (k % 7 = 0 OR strptime(created_at, '%Y-%m-%dT%H:%M:%SZ') + to_days(CAST(k % 900 - 100 AS INTEGER)) >= TIMESTAMP '2025-03-01 12:00:00')""",
    "stale": f"""SELECT id, valid_until FROM (SELECT id, k, strptime(created_at, '%Y-%m-%dT%H:%M:%SZ') + to_days(CAST(k % 900 - 100 AS INTEGER)) AS until,
          {_iso("(strptime(created_at, '%Y-%m-%dT%H:%M:%SZ') + to_days(CAST(k % 900 - 100 AS INTEGER)))")} AS valid_until FROM fact WHERE k % 7 <> 0) WHERE until < TIMESTAMP '2025-01-01 00:00:00'""",
    "superseded_view": "SELECT id, epistemic_status, id IN (SELECT target_id FROM irel WHERE type = 'SUPERSEDES') AS superseded FROM fact",
    "valid_at_moments": """
        SELECT strftime(m, '%Y-%m-%d %H:%M') AS moment, id
        FROM (SELECT DISTINCT TIMESTAMP '2023-06-01 12:00:00' + to_days(CAST(c_custkey % 97 * 9 AS INTEGER)) AS m FROM customer)
        JOIN fact ON (k % 5 = 0 OR strptime(created_at, '%Y-%m-%dT%H:%M:%SZ') <= m)
            AND (k % 7 = 0 OR strptime(created_at, '%Y-%m-%dT%H:%M:%SZ') + to_days(CAST(k % 900 - 100 AS INTEGER)) >= m)""",
    "active_successors": """
        SELECT id, nxt AS successor_id, count(*) OVER (PARTITION BY id) > 1 AS forked,
               CASE WHEN nxt NOT IN (SELECT id FROM fact) THEN 'MISSING' END AS problem
        FROM reach WHERE nxt NOT IN (SELECT id FROM sup)
        UNION ALL
        SELECT id, NULL, coalesce((SELECT count(*) FROM reach e WHERE e.id = c.id AND e.nxt NOT IN (SELECT id FROM sup)) > 1, false), 'CYCLE'
        FROM (SELECT DISTINCT r.id FROM reach r WHERE r.nxt IN (SELECT id FROM reach WHERE id = nxt)
              UNION SELECT id FROM reach WHERE id = nxt) c""",
    "open_contradictions": """SELECT source_id, target_id, s.epistemic_status AS source_status, t.epistemic_status AS target_status FROM irel
          JOIN fact s ON s.id = source_id JOIN fact t ON t.id = target_id WHERE irel.type = 'CONTRADICTS' AND s.epistemic_status <> 'REFUTED' AND t.epistemic_status <> 'REFUTED'""",
    "history_gaps": f"""SELECT event_id, revision, before, after, previous, problem FROM (SELECT *, CASE WHEN (information_id IS NULL) = (thread_id IS NULL) THEN 'ENTITY'
          WHEN previous <> before THEN 'BROKEN_CHAIN' WHEN thread_id IS NOT NULL AND NOT ({TRANSITION.format("before", "after")}) THEN 'ILLEGAL_TRANSITION' END AS problem
        FROM (SELECT *, CASE WHEN entity IS NOT NULL THEN lag(after) OVER (PARTITION BY entity ORDER BY revision) END AS previous FROM hst)) WHERE problem IS NOT NULL""",
    "states_at_moments": """
        SELECT * FROM (WITH told AS (SELECT coalesce(information_id, thread_id) AS entity_id, h.revision, h.before, h.after, h.event_id, e.ts
              FROM hst h JOIN events e ON 'event-' || e.event_id = h.event_id WHERE (information_id IS NULL) <> (thread_id IS NULL)),
            latest AS (SELECT * FROM told QUALIFY row_number() OVER (PARTITION BY entity_id, ts ORDER BY revision DESC) = 1),
            earliest AS (SELECT entity_id, before FROM told QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY ts, revision) = 1),
            asked AS (SELECT DISTINCT CASE WHEN event_id % 101 = 0 THEN 'info-none-' || (event_id % 5) WHEN user_id % 2 = 0 THEN 'info-' || user_id ELSE 'thread-' || user_id END AS entity_id,
              ts + to_hours(CAST(event_id % 97 * 8 - 600 AS INTEGER)) AS m FROM events)
        SELECT a.entity_id, strftime(m, '%Y-%m-%d %H:%M:%S.%f') AS moment, CASE WHEN l.event_id IS NULL THEN f.before ELSE l.after END AS status, l.revision, l.event_id
        FROM asked a ASOF LEFT JOIN latest l ON a.entity_id = l.entity_id AND a.m >= l.ts LEFT JOIN earliest f ON f.entity_id = a.entity_id)""",
    "revision_gaps": """SELECT m.information_id AS entity_id, m.revision, h.event_revision FROM mem m JOIN (SELECT entity, max(revision) AS event_revision FROM hst WHERE entity IS NOT NULL GROUP BY entity) h
          ON h.entity = m.information_id WHERE m.revision <> h.event_revision""",
    "epistemic_gaps": """SELECT event_id, information_id, before, after FROM hst WHERE information_id IS NOT NULL AND thread_id IS NULL AND before <> after
        AND before || '>' || after NOT IN ('UNKNOWN>UNVERIFIED', 'UNVERIFIED>CONFIRMED', 'UNVERIFIED>REFUTED', 'UNVERIFIED>CONFLICTED', 'CONFIRMED>SUPERSEDED',
          'REFUTED>SUPERSEDED', 'CONFLICTED>CONFIRMED', 'CONFLICTED>REFUTED')""",
    "evidence_links": """SELECT f.id, count(*) FILTER (kind = 's') AS supporting, count(*) FILTER (kind = 'c') AS contradicting,
          count(*) FILTER (kind IS NOT NULL AND d.doc_id IS NULL) AS dangling
        FROM fact f LEFT JOIN (SELECT doc_id AS k, 's' AS kind, doc_id + i AS ref FROM documents, (VALUES (0), (1), (2)) v(i) WHERE i <= doc_id % 3
            UNION ALL SELECT doc_id, 'c', doc_id + 7 FROM documents WHERE doc_id % 4 = 0) e ON e.k = f.k LEFT JOIN documents d ON d.doc_id = e.ref GROUP BY f.id""",
}


# The stream applies the same log in micro-batches.
BODY["stream_command_outcomes"] = BODY["command_outcomes"]
BODY["stream_shuffled_commands"] = BODY["command_outcomes"]

# Stored snapshots hold what the batch operators return.
BODY["memory_store_by_parts"] = BODY["memory_store_snapshot"]
BODY["memory_update_by_parts"] = BODY["memory_update_snapshot"]
BODY["memory_deletes_by_parts"] = BODY["memories_after_deletes"]


@cache
def _needs(text: str) -> set[str]:
    return {n for n in BASE if re.search(rf"\b(FROM|JOIN|,)\s+{n}\b", text)}


def _with(body: str) -> str:
    """Prefix a query with the tables it needs, dependencies first."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in ordered:
            return
        for other in BASE:
            if other != name and other in _needs(BASE[name]):
                visit(other)
        ordered.append(name)

    for name in BASE:
        if name in _needs(body):
            visit(name)
    if not ordered:
        return body
    tables = ",\n".join(f"{n} AS ({BASE[n]})" for n in ordered)
    return f"WITH RECURSIVE {tables}\n{body}"


ORACLE: dict[str, str] = {name: _with(body) for name, body in BODY.items()}
