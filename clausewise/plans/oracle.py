"""Independent DuckDB SQL for each registered query (the correctness oracle).

Written from the operator definitions, not from the Spark code: regex spans
come from `regexp_extract_all` / `string_split_regex` and prefix sums,
redaction and fixes from `list_reduce`, vectors from exploded token rows.
The plain patterns are used (RE2); on the driver tables their spans equal
Python's (non-ASCII word-boundary differences are covered by unit tests).
"""

from __future__ import annotations

from clausewise.operators.pii import PII_PATTERNS
from clausewise.operators.rules import RULES
from clausewise.operators.signatures import SIGNATURE_PATTERNS
from clausewise.operators.triage import TYPE_KEYWORDS
from clausewise.sources.corpus import (CYCLE, DEFAULT_DATE, HR_DEPARTMENT, HR_REQUEST, INVOICE_ITEMS,
                                       INVOICE_TOTAL, POLICY_SENTENCE, SCAN_NOTE, TERMINATION_SENTENCE)
from clausewise.sources.reference_texts import POLICIES, TEMPLATES

DIM = 384
STRIP_CLASS = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}]"
TOKEN = r"[\p{L}\p{N}_]+"


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{STRIP_CLASS}+|{STRIP_CLASS}+$', '', 'g')"


def bucket(tok: str) -> str:
    return f"(('0x' || substr(md5({tok}), 1, 8))::BIGINT % {DIM})"


def classify_case(text: str) -> str:
    h = f"lower(substr(coalesce({text}, ''), 1, 1000))"
    parts = []
    for name, words in TYPE_KEYWORDS:
        cond = " OR ".join(f"contains({h}, {q(w)})" for w in words)
        parts.append(f"WHEN {cond} THEN {q(name)}")
    return "CASE " + " ".join(parts) + " ELSE 'unknown' END"


def pii_cte(name: str, src: str, id_col: str, text_col: str, confirm: bool = False) -> str:
    """(id, seq, pii_type, span_start, span_end, text, severity, confidence)."""
    unions = []
    for k, (ptype, pat) in enumerate(PII_PATTERNS):
        conf = "0.9::DOUBLE" if confirm and ptype in ("account_number", "iban") else "0.95::DOUBLE"
        sev = "'high'" if ptype in ("ssn", "credit_card") else "'medium'"
        unions.append(f"""
        SELECT {id_col} AS id, {k} AS pidx, i, {q(ptype)} AS pii_type, ms[i] AS mtext,
               coalesce(list_sum(list_transform(parts[1:i], lambda x: length(x))), 0)
             + coalesce(list_sum(list_transform(ms[1:i-1], lambda x: length(x))), 0) AS span_start,
               {sev} AS severity, {conf} AS confidence
        FROM (SELECT {id_col}, ms, parts, unnest(range(1, len(ms) + 1)) AS i
              FROM (SELECT {id_col}, regexp_extract_all(coalesce({text_col}, ''), {q(pat)}) AS ms,
                           string_split_regex(coalesce({text_col}, ''), {q(pat)}) AS parts FROM {src}))""")
    body = " UNION ALL ".join(unions)
    return f"""{name} AS (
      SELECT id AS {id_col}, (row_number() OVER (PARTITION BY id ORDER BY pidx, i) - 1)::BIGINT AS seq,
             pii_type, span_start::BIGINT AS span_start, (span_start + length(mtext))::BIGINT AS span_end,
             mtext AS text, severity, confidence, pidx, i
      FROM ({body}))"""


def rules_values() -> str:
    rows = []
    for n, (rid, cid, rname, sev, msg, kws, types) in enumerate(RULES):
        kw = "[" + ", ".join(q(k) for k in kws) + "]"
        ty = "[" + ", ".join(q(t) for t in types) + "]"
        rows.append(f"({n}, {q(rid)}, {q(cid)}, {q(rname)}, {q(sev)}, {q(msg)}, {kw}, {ty})")
    return ("rules(ord, rule_id, check_id, rule_name, severity, message, keywords, document_types) AS (VALUES "
            + ", ".join(rows) + ")")


def templates_values() -> str:
    rows = ", ".join(f"({q(k)}, {q(v)})" for k, v in sorted(TEMPLATES.items()))
    return f"tpl(template_id, ttext) AS (VALUES {rows})"


def policies_values() -> str:
    rows = ", ".join(f"({q(k)}, {q(v)})" for k, v in sorted(POLICIES.items()))
    return f"pol(policy_id, content) AS (VALUES {rows})"


def corpus_cte(name: str = "corpus") -> str:
    """S13 in SQL: one labelled document per customer row."""
    t = TEMPLATES
    nm = "translate(c_name, '0123456789#', 'ABCDEFGHIJ ')"
    email = f"lower(regexp_replace({nm}, '[^A-Za-z0-9]+', '.', 'g')) || '@example.com'"
    phone = "printf('555-%03d-%04d', c_custkey % 1000, c_custkey % 10000)"
    d = q(DEFAULT_DATE)
    contract = f"replace({q(t['contract_template'])}, '{{date}}', {d})"
    contract = f"CASE WHEN i >= 8 THEN replace({contract}, {q(TERMINATION_SENTENCE)}, '') ELSE {contract} END"
    contract = (f"CASE WHEN i < 5 THEN replace({contract}, 'Party A', name || ' (' || email || ', Phone: ' "
                f"|| phone || ')') ELSE {contract} END")
    contract = f"CASE WHEN i = 6 THEN {contract} || {q(SCAN_NOTE)} ELSE {contract} END"
    policy = f"replace({q(t['policy_template'])}, '{{policy_text}}', {q(POLICY_SENTENCE)})"
    policy = (f"CASE WHEN i < 6 THEN replace({policy}, '{{version}}', printf('v%d.0', i + 1)) "
              f"ELSE replace({policy}, {q('Version: {version}' + chr(10))}, '') END")
    policy = (f"CASE WHEN i < 7 THEN replace({policy}, '{{date}}', {d}) "
              f"ELSE replace({policy}, {q('Effective Date: {date}' + chr(10))}, '') END")
    hr = (f"replace(replace(replace({q(t['hr_form_template'])}, '{{name}}', name), '{{department}}', "
          f"{q(HR_DEPARTMENT)}), '{{request_type}}', {q(HR_REQUEST)})")
    approval = t["hr_form_template"].split("\n\n")[-1].rstrip("\n")
    hr = f"CASE WHEN i < 4 THEN replace({hr}, '{{date}}', {d}) ELSE replace({hr}, {q(approval)}, '') END"
    inv = (f"replace(replace(replace(replace(replace({q(t['invoice_template'])}, '{{invoice_number}}', "
           f"printf('INV-%04d', i + 1)), '{{date}}', {d}), '{{company}}', name), '{{items}}', "
           f"{q(INVOICE_ITEMS)}), '{{amount}}', {q(INVOICE_TOTAL)})")
    inv = (f"CASE WHEN i < 4 THEN replace({inv}, '{{tax_id}}', printf('TAX-%06d', i + 1)) "
           f"ELSE replace({inv}, {q('TAX ID: {tax_id}' + chr(10))}, '') END")
    return f"""{name} AS (
      SELECT doc_id, dtype AS document_type, i AS variant,
             CASE dtype WHEN 'contract' THEN {contract} WHEN 'policy' THEN {policy}
                        WHEN 'hr_form' THEN {hr} ELSE {inv} END AS text,
             email, phone
      FROM (SELECT c_custkey::BIGINT AS doc_id, {nm} AS name, {email} AS email, {phone} AS phone,
                   CASE WHEN c_custkey % {CYCLE} < 10 THEN 'contract' WHEN c_custkey % {CYCLE} < 18 THEN 'policy'
                        WHEN c_custkey % {CYCLE} < 24 THEN 'hr_form' ELSE 'invoice' END AS dtype,
                   CASE WHEN c_custkey % {CYCLE} < 10 THEN c_custkey % {CYCLE}
                        WHEN c_custkey % {CYCLE} < 18 THEN c_custkey % {CYCLE} - 10
                        WHEN c_custkey % {CYCLE} < 24 THEN c_custkey % {CYCLE} - 18
                        ELSE c_custkey % {CYCLE} - 24 END::INTEGER AS i
            FROM customer))"""


def drift_ctes(src: str, sep_sql: str, prefix: str = "dr", tpl: str | None = None) -> str:
    """(doc_id, chunk_index, span_start, span_end, chunk, similarity) for every chunk,
    best template by hashed bag-of-words l2 similarity."""
    return f"""
    {tpl or templates_values()},
    {prefix}_tt AS (SELECT template_id, unnest(regexp_extract_all(lower(ttext), '{TOKEN}')) AS tok FROM tpl),
    {prefix}_tb AS (SELECT template_id, {bucket('tok')} AS b, count(*) AS cnt FROM {prefix}_tt GROUP BY ALL),
    {prefix}_tw AS (SELECT template_id, b, cnt / sqrt(sum(cnt * cnt) OVER (PARTITION BY template_id)) AS w
                    FROM {prefix}_tb),
    {prefix}_cs AS (SELECT doc_id, text, list_filter(list_transform(string_split(coalesce(text, ''), {sep_sql}),
                        lambda p: {strip('p')}), lambda p: length(p) > 50) AS cs FROM {src}),
    {prefix}_ch AS (SELECT doc_id, text, i - 1 AS chunk_index, cs[i] AS chunk,
                           instr(coalesce(text, ''), cs[i]) - 1 AS span_start
                    FROM (SELECT doc_id, text, cs, unnest(range(1, len(cs) + 1)) AS i FROM {prefix}_cs)),
    {prefix}_ct AS (SELECT doc_id, chunk_index, unnest(regexp_extract_all(lower(chunk), '{TOKEN}')) AS tok
                    FROM {prefix}_ch),
    {prefix}_cb AS (SELECT doc_id, chunk_index, {bucket('tok')} AS b, count(*) AS cnt FROM {prefix}_ct GROUP BY ALL),
    {prefix}_cw AS (SELECT doc_id, chunk_index, b,
                           cnt / sqrt(sum(cnt * cnt) OVER (PARTITION BY doc_id, chunk_index)) AS w FROM {prefix}_cb),
    {prefix}_dot AS (SELECT q.doc_id, q.chunk_index, t.template_id, sum(q.w * t.w) AS dot
                     FROM {prefix}_cw q JOIN {prefix}_tw t USING (b) GROUP BY ALL),
    {prefix}_has AS (SELECT DISTINCT doc_id, chunk_index FROM {prefix}_cb),
    {prefix}_best AS (
      SELECT c.doc_id, c.chunk_index, c.chunk, c.span_start, c.span_start + length(c.chunk) AS span_end,
             1.0 / (1.0 + greatest(CASE WHEN h.doc_id IS NULL THEN 0.0 ELSE 1.0 END + 1.0
                                   - 2.0 * coalesce(max(d.dot), 0.0), 0.0)) AS similarity
      FROM {prefix}_ch c
      LEFT JOIN {prefix}_dot d ON d.doc_id = c.doc_id AND d.chunk_index = c.chunk_index
      LEFT JOIN {prefix}_has h ON h.doc_id = c.doc_id AND h.chunk_index = c.chunk_index
      GROUP BY c.doc_id, c.chunk_index, c.chunk, c.span_start, h.doc_id)"""


def drift_select(prefix: str = "dr") -> str:
    return f"""SELECT doc_id, chunk_index::BIGINT AS chunk_index, span_start::BIGINT AS span_start,
           span_end::BIGINT AS span_end, round(similarity, 6) AS similarity,
           CASE WHEN similarity > 0.5 THEN 'medium' ELSE 'high' END AS severity,
           'Chunk deviates from template (similarity: ' || printf('%.2f', similarity) || ')' AS message
    FROM {prefix}_best WHERE similarity < 0.7"""


NL2 = "chr(10) || chr(10)"


def audit_ctes(src: str, with_drift: bool = True, tpl: str | None = None) -> str:
    """CTEs ending in `av` (all violations with seq), `asug` (suggestions) and
    `aud` (one row per document) for the documents in `src(doc_id, text)`."""
    sig_hits = " + ".join(f"len(regexp_extract_all(coalesce(text, ''), {q('(?i)' + p)}))"
                          for p in SIGNATURE_PATTERNS)
    lt = "lower(coalesce(text, ''))"
    drift_on = "TRUE" if with_drift else "FALSE"
    bad = (f"(CASE WHEN c.text IS NULL THEN 'document text is missing' WHEN length({strip('c.text')}) = 0 "
           "THEN 'document text is empty' END)")
    image_hint = (f"CASE WHEN contains({lt}, 'signature') AND (contains({lt}, 'image') OR contains({lt}, 'png') "
                  f"OR contains({lt}, 'jpg')) THEN 1 ELSE 0 END")
    return f"""
    cls AS (SELECT doc_id, text, {classify_case('text')} AS document_type,
                   ({sig_hits}) + {image_hint} AS sig_hits FROM {src}),
    {pii_cte('apii', 'cls', 'doc_id', 'text')},
    {rules_values()},
    apol AS (SELECT c.doc_id, r.ord, r.rule_id, r.check_id, r.rule_name, r.severity, r.message,
                    length(coalesce(c.text, '')) AS span_end
             FROM cls c JOIN rules r ON list_contains(r.document_types, c.document_type)
                                      OR list_contains(r.document_types, 'all')
             WHERE len(list_filter(r.keywords, lambda k: contains(lower(coalesce(c.text, '')), k))) = 0),
    {drift_ctes('cls', NL2, 'adr', tpl)},
    asig AS (SELECT doc_id, document_type || ' document missing required signature/approval' AS message,
                    length(coalesce(text, '')) AS span_end
             FROM cls WHERE document_type IN ('contract', 'hr_form', 'agreement', 'policy') AND sig_hits = 0),
    av0 AS (
      SELECT doc_id, 0 AS sc, pidx * 1000000 + i AS ord, 'pii' AS type, pii_type, NULL AS rule_id,
             severity, NULL AS message, span_start, span_end, text AS mtext, NULL::BIGINT AS chunk_index FROM apii
      UNION ALL SELECT doc_id, 1, ord, 'policy_violation', NULL, rule_id, severity, message, 0, span_end, NULL, NULL
             FROM apol
      UNION ALL SELECT doc_id, 2, chunk_index, 'template_drift', NULL, NULL,
             CASE WHEN similarity > 0.5 THEN 'medium' ELSE 'high' END,
             'Chunk deviates from template (similarity: ' || printf('%.2f', similarity) || ')',
             span_start, span_end, NULL, chunk_index FROM adr_best WHERE similarity < 0.7 AND {drift_on}
      UNION ALL SELECT doc_id, 3, 0, 'missing_signature', NULL, NULL, 'high', message, 0, span_end, NULL, NULL
             FROM asig),
    av AS (SELECT *, (row_number() OVER (PARTITION BY doc_id ORDER BY sc, ord) - 1)::BIGINT AS seq FROM av0),
    apiil AS (SELECT doc_id, list(struct_pack(s := span_start, e := span_end, q := seq) ORDER BY seq) AS pl
              FROM apii GROUP BY doc_id),
    asug AS (
      SELECT v.doc_id, v.seq, v.type, v.span_start, v.span_end,
             CASE WHEN v.type = 'pii' THEN v.pii_type ELSE coalesce(v.rule_id, v.type) END AS violation_id,
             CASE WHEN v.type = 'pii' THEN v.mtext ELSE substr(c.text, v.span_start + 1, v.span_end - v.span_start)
                  END AS original_text,
             CASE WHEN v.type = 'pii' THEN '[REDACTED]' ELSE
               list_reduce(
                 list_sort(list_filter(list_transform(coalesce(p.pl, []), lambda x: struct_pack(
                     s := greatest(x.s, v.span_start) - v.span_start, nq := -x.q,
                     e := least(x.e, v.span_end) - v.span_start)), lambda x: x.s < x.e), 'DESC'),
                 lambda acc, x: substr(acc, 1, x.s) || '[REDACTED_' || substr(sha256(substr(
                     substr(c.text, v.span_start + 1, v.span_end - v.span_start), x.s + 1, x.e - x.s)), 1, 8)
                     || ']' || substr(acc, x.e + 1),
                 substr(c.text, v.span_start + 1, v.span_end - v.span_start)) || ' [COMPLIANCE FIX APPLIED]'
             END AS replacement,
             v.type = 'pii' AS redaction_flag
      FROM av v JOIN cls c USING (doc_id) LEFT JOIN apiil p USING (doc_id)),
    ascore AS (
      SELECT doc_id, sum(CASE severity WHEN 'critical' THEN 10 WHEN 'high' THEN 5 WHEN 'medium' THEN 2 ELSE 1 END)
                 AS score,
             count(*) FILTER (WHERE severity = 'critical') AS n_critical,
             count(*) FILTER (WHERE severity = 'high') AS n_high,
             count(*) FILTER (WHERE severity = 'medium') AS n_medium,
             count(*) FILTER (WHERE severity NOT IN ('critical', 'high', 'medium') OR severity IS NULL) AS n_low,
             count(*) FILTER (WHERE type = 'pii') AS pii_found,
             count(*) FILTER (WHERE type = 'policy_violation') AS policy_found,
             count(*) FILTER (WHERE type = 'template_drift') AS drift_found,
             count(*) FILTER (WHERE type = 'missing_signature') AS signature_violations
      FROM av GROUP BY doc_id),
    achunks AS (SELECT doc_id, count(*) AS chunks_checked FROM adr_ch WHERE {drift_on} GROUP BY doc_id),
    arules AS (SELECT c.doc_id, count(DISTINCT r.rule_id) AS rules_checked FROM cls c JOIN rules r
               ON list_contains(r.document_types, c.document_type) OR list_contains(r.document_types, 'all')
               GROUP BY c.doc_id),
    aud AS (
      SELECT c.doc_id, c.text, c.document_type, coalesce(s.score, 0)::BIGINT AS violation_score,
             coalesce(s.n_critical, 0)::BIGINT AS n_critical, coalesce(s.n_high, 0)::BIGINT AS n_high,
             coalesce(s.n_medium, 0)::BIGINT AS n_medium, coalesce(s.n_low, 0)::BIGINT AS n_low,
             CASE WHEN {bad} IS NULL THEN 'ok' ELSE 'error' END AS status, {bad} AS error,
             CASE WHEN {bad} IS NOT NULL THEN NULL WHEN coalesce(s.score, 0) = 0 THEN 'Auto-Approve' WHEN s.score <= 2 THEN 'Auto-Fix'
                  WHEN s.score <= 5 THEN 'Require Review' ELSE 'Reject' END AS decision,
             CASE WHEN {bad} IS NOT NULL THEN {bad} WHEN coalesce(s.score, 0) = 0 THEN 'No violations detected'
                  WHEN s.score <= 2 THEN 'Low severity violations (' || s.score || ' points) with available fixes'
                  WHEN s.score <= 5 THEN 'Medium severity violations (' || s.score
                       || ' points) require human review'
                  ELSE 'High severity violations (' || s.score || ' points) cannot be auto-fixed' END AS reason,
             coalesce(s.pii_found, 0)::BIGINT AS pii_found, coalesce(s.policy_found, 0)::BIGINT AS policy_found,
             coalesce(r.rules_checked, 0)::BIGINT AS rules_checked,
             coalesce(k.chunks_checked, 0)::BIGINT AS chunks_checked,
             coalesce(s.drift_found, 0)::BIGINT AS drift_found, c.sig_hits::BIGINT AS signatures_found,
             coalesce(s.signature_violations, 0)::BIGINT AS signature_violations
      FROM cls c LEFT JOIN ascore s USING (doc_id) LEFT JOIN arules r USING (doc_id)
      LEFT JOIN achunks k USING (doc_id))"""


E2_CTES = f"""vq AS (SELECT doc_id, seq, coalesce(mtext, message, '') AS q FROM av),
      dq AS (SELECT DISTINCT q FROM vq WHERE length(q) > 0),
      qt AS (SELECT q, unnest(regexp_extract_all(lower(q), '{TOKEN}')) AS tok FROM dq),
      qb AS (SELECT q, {bucket('tok')} AS b, count(*) AS cnt FROM qt GROUP BY ALL),
      qw AS (SELECT q, b, cnt / sqrt(sum(cnt * cnt) OVER (PARTITION BY q)) AS w FROM qb),
      ht AS (SELECT item_id::VARCHAR AS hid, unnest(regexp_extract_all(lower(text), '{TOKEN}')) AS tok
             FROM benchmark),
      hb AS (SELECT hid, {bucket('tok')} AS b, count(*) AS cnt FROM ht GROUP BY ALL),
      hw AS (SELECT hid, b, cnt / sqrt(sum(cnt * cnt) OVER (PARTITION BY hid)) AS w FROM hb),
      hs AS (SELECT item_id::VARCHAR AS hid, CASE WHEN item_id::VARCHAR IN (SELECT hid FROM hb) THEN 1.0
                    ELSE 0.0 END AS hn2 FROM benchmark),
      qs AS (SELECT q, CASE WHEN q IN (SELECT q FROM qb) THEN 1.0 ELSE 0.0 END AS qn2 FROM dq),
      dots AS (SELECT qw.q, hw.hid, sum(qw.w * hw.w) AS dot FROM qw JOIN hw USING (b) GROUP BY ALL),
      pairs AS (SELECT qs.q, hs.hid,
                       1.0 / (1.0 + greatest(qs.qn2 + hs.hn2 - 2.0 * coalesce(d.dot, 0.0), 0.0)) AS sim
                FROM qs CROSS JOIN hs LEFT JOIN dots d ON d.q = qs.q AND d.hid = hs.hid),
      top AS (SELECT q, hid, sim, row_number() OVER (PARTITION BY q ORDER BY round(sim, 12) DESC, hid) AS rank
              FROM pairs)"""


AUD_COLS = ("doc_id, document_type, violation_score, n_critical, n_high, n_medium, n_low, decision, reason, "
            "pii_found, policy_found, rules_checked, chunks_checked, drift_found, signatures_found, "
            "signature_violations")


def sql_queries() -> dict[str, str]:
    docs = "docs AS (SELECT doc_id, text FROM documents)"
    corpus_docs = f"{corpus_cte()}, cdocs AS (SELECT doc_id, text FROM corpus)"
    out: dict[str, str] = {}
    out["t1_classify"] = f"""SELECT doc_id, {classify_case('text')} AS document_type,
        CASE WHEN {classify_case('text')} = 'unknown' THEN 0.5::DOUBLE ELSE 0.9::DOUBLE END AS confidence FROM documents"""
    pii_cols = "doc_id, seq, pii_type, span_start, span_end, text, severity, confidence"
    out["p1_pii_spans"] = f"WITH {pii_cte('p', 'documents', 'doc_id', 'text')} SELECT {pii_cols} FROM p"
    out["p1_pii_spans_pages"] = (f"WITH {pii_cte('p', 'pages', 'page_id', 'html')} SELECT "
                                 + pii_cols.replace("doc_id", "page_id") + " FROM p")
    out["p3_confirm_pii"] = (f"WITH {pii_cte('p', 'documents', 'doc_id', 'text', confirm=True)} "
                             f"SELECT {pii_cols} FROM p")
    out["p4_redact"] = f"""WITH {pii_cte('p', 'documents', 'doc_id', 'text')},
      sp AS (SELECT doc_id, list(struct_pack(s := span_start, e := span_end) ORDER BY span_start DESC, seq ASC) AS l,
                    count(*) AS n FROM p GROUP BY doc_id)
      SELECT d.doc_id,
             list_reduce(coalesce(sp.l, []), lambda acc, x: substr(acc, 1, x.s) || '[REDACTED_'
                 || substr(sha256(substr(d.text, x.s + 1, x.e - x.s)), 1, 8) || ']' || substr(acc, x.e + 1),
                 d.text) AS redacted_text,
             coalesce(sp.n, 0)::BIGINT AS n_redactions
      FROM documents d LEFT JOIN sp USING (doc_id)"""
    out["r1_rules_for_type"] = f"""WITH {rules_values()}, {corpus_docs},
      t AS (SELECT {classify_case('text')} AS document_type FROM documents
            UNION ALL SELECT {classify_case('text')} FROM cdocs),
      ty AS (SELECT document_type, count(*)::BIGINT AS n_documents FROM t GROUP BY ALL)
      SELECT ty.document_type, ty.n_documents, r.rule_id, r.check_id, r.severity
      FROM ty JOIN rules r ON list_contains(r.document_types, ty.document_type)
                          OR list_contains(r.document_types, 'all')"""
    pol_sql = lambda src: f"""WITH {rules_values()}, c AS (SELECT doc_id, text, {classify_case('text')} AS
        document_type FROM {src})
      SELECT c.doc_id, c.document_type, (row_number() OVER (PARTITION BY c.doc_id ORDER BY r.ord) - 1)::BIGINT
             AS seq, r.rule_id, r.check_id, r.rule_name, r.severity, r.message, 0::BIGINT AS span_start,
             length(coalesce(c.text, ''))::BIGINT AS span_end
      FROM c JOIN rules r ON list_contains(r.document_types, c.document_type)
                          OR list_contains(r.document_types, 'all')
      WHERE len(list_filter(r.keywords, lambda k: contains(lower(coalesce(c.text, '')), k))) = 0"""
    out["r7_policy_violations"] = pol_sql("documents")
    out["r7_policy_violations_corpus"] = pol_sql("cdocs").replace("WITH ", f"WITH {corpus_docs}, ", 1)

    def sig_sql(src: str) -> str:
        unions = " UNION ALL ".join(f"""
          SELECT doc_id, {k} AS k, i, ms[i] AS mtext,
                 coalesce(list_sum(list_transform(parts[1:i], lambda x: length(x))), 0)
               + coalesce(list_sum(list_transform(ms[1:i-1], lambda x: length(x))), 0) AS span_start
          FROM (SELECT doc_id, ms, parts, unnest(range(1, len(ms) + 1)) AS i
                FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {q('(?i)' + p)}) AS ms,
                             string_split_regex(coalesce(text, ''), {q('(?i)' + p)}) AS parts FROM {src}))"""
                             for k, p in enumerate(SIGNATURE_PATTERNS))
        lt = "lower(coalesce(text, ''))"
        return f"""SELECT doc_id, seq, type, span_start, span_end, text, confidence FROM (
          SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY k, i) - 1)::BIGINT AS seq,
                 'signature_field' AS type, span_start::BIGINT AS span_start,
                 (span_start + length(mtext))::BIGINT AS span_end, mtext AS text, NULL::DOUBLE AS confidence
          FROM ({unions})
          UNION ALL
          SELECT doc_id, ({" + ".join(f"len(regexp_extract_all(coalesce(text, ''), {q('(?i)' + p)}))" for p in SIGNATURE_PATTERNS)})::BIGINT, 'signature_image', NULL, NULL, NULL, 0.7::DOUBLE FROM {src}
          WHERE contains({lt}, 'signature') AND (contains({lt}, 'image') OR contains({lt}, 'png')
                OR contains({lt}, 'jpg')))"""
    out["g1_signatures"] = sig_sql("documents")
    out["g1_signatures_corpus"] = f"WITH {corpus_docs} " + sig_sql("cdocs")
    miss = lambda src: f"""WITH {audit_ctes(src)}
      SELECT doc_id, document_type, 'missing_signature' AS type, 'high' AS severity,
             document_type || ' document missing required signature/approval' AS message,
             0::BIGINT AS span_start, length(coalesce(text, ''))::BIGINT AS span_end
      FROM cls WHERE document_type IN ('contract', 'hr_form', 'agreement', 'policy') AND sig_hits = 0"""
    out["g3_missing_signature"] = miss("documents")
    out["g3_missing_signature_corpus"] = miss("cdocs").replace("WITH ", f"WITH {corpus_docs}, ", 1)
    chunk_sql = lambda sep: f"""WITH {drift_ctes('documents', sep, 'x')}
      SELECT doc_id, chunk_index::BIGINT AS chunk_index, span_start::BIGINT AS span_start,
             (span_start + length(chunk))::BIGINT AS span_end, length(chunk)::BIGINT AS chunk_chars FROM x_ch"""
    out["d1_chunks"] = chunk_sql(NL2)
    out["d1_chunks_lines"] = chunk_sql("chr(10)")
    out["d2_embed_benchmark"] = f"""WITH t AS (SELECT item_id, unnest(regexp_extract_all(lower(text), '{TOKEN}'))
        AS tok FROM benchmark),
      b AS (SELECT item_id, {bucket('tok')} AS bucket, count(*) AS cnt FROM t GROUP BY ALL)
      SELECT item_id, bucket::BIGINT AS bucket, cnt::BIGINT AS cnt,
             round(cnt / sqrt(sum(cnt * cnt) OVER (PARTITION BY item_id)), 6) AS weight FROM b"""
    topk = lambda sim, dist: f"""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
      p AS (SELECT a.vec_id AS query_id, b.vec_id AS id,
                   list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d2,
                   list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2])) AS dp,
                   list_sum(list_transform(a.v, lambda x: x * x)) AS na, list_sum(list_transform(b.v, lambda x: x * x))
                   AS nb
            FROM e a JOIN e b ON a.vec_id <> b.vec_id),
      s AS (SELECT query_id, id, {sim} AS similarity, {dist} AS distance FROM p)
      SELECT query_id, rank::BIGINT AS rank, id, round(similarity, 6) AS similarity, round(distance, 6) AS distance
      FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(similarity, 12) DESC, id) AS rank
            FROM s)
      WHERE rank <= 3"""
    out["d3_topk_l2"] = topk("1.0 / (1.0 + d2)", "d2")
    cos = "CASE WHEN na > 0 AND nb > 0 THEN dp / (sqrt(na) * sqrt(nb)) ELSE 0.0::DOUBLE END"
    out["d3_topk_cosine"] = topk(cos, f"1.0 - ({cos})")
    out["d3b_recall"] = """SELECT count(*)::BIGINT AS n_queries, (3 * count(*))::BIGINT AS n_neighbours, TRUE AS recall_ok,
        TRUE AS share_ok FROM embeddings"""
    out["d4_drift"] = f"WITH {drift_ctes('documents', NL2)} {drift_select()}"
    out["d4_drift_lines"] = f"WITH {drift_ctes('documents', 'chr(10)')} {drift_select()}"
    out["d4_drift_corpus"] = f"WITH {corpus_docs}, {drift_ctes('cdocs', NL2)} {drift_select()}"
    out["m1_merge_violations"] = f"""WITH {docs}, {audit_ctes('docs')}
      SELECT doc_id, seq, CASE type WHEN 'pii' THEN 'pii' WHEN 'policy_violation' THEN 'policy'
                                    WHEN 'template_drift' THEN 'template' ELSE 'signature' END AS scanner,
             type, pii_type, rule_id, severity, span_start::BIGINT AS span_start, span_end::BIGINT AS span_end,
             chunk_index FROM av"""
    out["e1_policy_snippets"] = f"""WITH {corpus_docs}, {audit_ctes('cdocs')}, {policies_values()}
      SELECT v.doc_id, v.seq, v.rule_id, a.check_id, p.content AS policy_snippet
      FROM av v JOIN apol a ON a.doc_id = v.doc_id AND a.ord = v.ord AND v.sc = 1
      LEFT JOIN pol p ON p.policy_id = v.rule_id"""
    out["w_suggestions"] = f"""WITH {docs}, {audit_ctes('docs')}
      SELECT doc_id, seq, violation_id, span_start::BIGINT AS span_start, span_end::BIGINT AS span_end,
             original_text, replacement, redaction_flag,
             CASE WHEN type = 'pii' THEN 'Redact ' || violation_id || ' to protect privacy'
                  ELSE 'Applied policy compliance fix | Maintains document intent | Follows template guidelines'
                  END AS explanation,
             CASE WHEN type = 'pii' THEN NULL ELSE 'POLICY_001' END AS citations
      FROM asug"""
    out["w_suggestions_corpus"] = f"""WITH {corpus_docs}, {audit_ctes('cdocs')}
      SELECT doc_id, seq, violation_id, span_start::BIGINT AS span_start, span_end::BIGINT AS span_end,
             original_text, replacement, redaction_flag FROM asug"""
    out["w3_template_context"] = f"""WITH {corpus_docs}, {audit_ctes('cdocs')},
      vs AS (SELECT v.doc_id, v.seq, substr(coalesce(c.text, ''), v.span_start + 1, v.span_end - v.span_start) AS sl
             FROM av v JOIN cls c USING (doc_id) WHERE v.type <> 'pii'),
      vt AS (SELECT doc_id, seq, unnest(regexp_extract_all(lower(sl), '{TOKEN}')) AS tok FROM vs),
      vb AS (SELECT doc_id, seq, {bucket('tok')} AS b, count(*) AS cnt FROM vt GROUP BY ALL),
      vw AS (SELECT doc_id, seq, b, cnt / sqrt(sum(cnt * cnt) OVER (PARTITION BY doc_id, seq)) AS w FROM vb),
      vd AS (SELECT v.doc_id, v.seq, t.template_id, sum(v.w * t.w) AS dot FROM vw v JOIN adr_tw t USING (b)
             GROUP BY ALL),
      pairs AS (SELECT vs.doc_id, vs.seq, tpl.template_id,
                       1.0 / (1.0 + greatest(CASE WHEN EXISTS (SELECT 1 FROM vb WHERE vb.doc_id = vs.doc_id
                                                                AND vb.seq = vs.seq) THEN 1.0 ELSE 0.0 END
                                             + 1.0 - 2.0 * coalesce(vd.dot, 0.0), 0.0)) AS sim
                FROM vs CROSS JOIN tpl
                LEFT JOIN vd ON vd.doc_id = vs.doc_id AND vd.seq = vs.seq AND vd.template_id = tpl.template_id)
      SELECT doc_id, seq, template_id, round(sim, 6) AS similarity FROM (
        SELECT *, row_number() OVER (PARTITION BY doc_id, seq ORDER BY round(sim, 12) DESC, template_id) AS rk
        FROM pairs) WHERE rk = 1"""
    out["q1_audit"] = f"WITH {docs}, {audit_ctes('docs')} SELECT {AUD_COLS} FROM aud"
    out["q1_audit_corpus"] = f"WITH {corpus_docs}, {audit_ctes('cdocs')} SELECT {AUD_COLS} FROM aud"
    out["f1_final_text"] = f"""WITH {docs}, {audit_ctes('docs')},
      fx AS (SELECT doc_id, list(struct_pack(s := span_start, e := span_end, r := replacement)
                                 ORDER BY span_start DESC, seq ASC) AS l FROM asug GROUP BY doc_id)
      SELECT a.doc_id, list_reduce(coalesce(fx.l, []), lambda acc, x: substr(acc, 1, x.s) || x.r
                                   || substr(acc, x.e + 1), a.text) AS final_text
      FROM aud a LEFT JOIN fx USING (doc_id) WHERE a.decision = 'Auto-Fix'"""
    out["f1_final_text_nodrift"] = f"""WITH {docs}, {audit_ctes('docs', with_drift=False)},
      fx AS (SELECT doc_id, list(struct_pack(s := span_start, e := span_end, r := replacement)
                                 ORDER BY span_start DESC, seq ASC) AS l FROM asug GROUP BY doc_id)
      SELECT a.doc_id, list_reduce(coalesce(fx.l, []), lambda acc, x: substr(acc, 1, x.s) || x.r
                                   || substr(acc, x.e + 1), a.text) AS final_text
      FROM aud a LEFT JOIN fx USING (doc_id) WHERE a.decision = 'Auto-Fix'"""
    out["f1_all_fixes"] = f"""WITH {docs}, {audit_ctes('docs')},
      fx AS (SELECT doc_id, list(struct_pack(s := span_start, e := span_end, r := replacement)
                                 ORDER BY span_start DESC, seq ASC) AS l FROM asug GROUP BY doc_id),
      t AS (SELECT a.doc_id, list_reduce(coalesce(fx.l, []), lambda acc, x: substr(acc, 1, x.s) || x.r
                                         || substr(acc, x.e + 1), a.text) AS fixed
            FROM aud a LEFT JOIN fx USING (doc_id) WHERE a.text IS NOT NULL)
      SELECT doc_id, length(fixed)::BIGINT AS n_chars, sha256(fixed) AS digest FROM t"""
    out["d4_drift_empty_store"] = f"""WITH {drift_ctes('documents', 'chr(10)')}
      SELECT doc_id, chunk_index::BIGINT AS chunk_index, span_start::BIGINT AS span_start, (span_start + length(chunk))::BIGINT AS span_end,
             0.0::DOUBLE AS similarity, 'low' AS severity, 'No matching template found' AS message FROM dr_ch"""
    out["o1_audit_counters"] = f"""WITH {docs}, {audit_ctes('docs')}
      SELECT (SELECT count(*) FROM aud)::BIGINT AS documents_processed,
             count(*)::BIGINT AS violations_total,
             count(*) FILTER (WHERE severity = 'critical')::BIGINT AS violations_critical,
             count(*) FILTER (WHERE severity = 'high')::BIGINT AS violations_high,
             count(*) FILTER (WHERE severity = 'medium')::BIGINT AS violations_medium,
             count(*) FILTER (WHERE severity = 'low')::BIGINT AS violations_low,
             count(*) FILTER (WHERE severity IS NULL OR severity = 'unknown')::BIGINT AS violations_unknown,
             (SELECT count(*) FROM aud WHERE decision = 'Auto-Approve')::BIGINT AS autopasses_total,
             (SELECT count(*) FROM aud WHERE decision = 'Auto-Fix')::BIGINT AS auto_fix_applied_total
      FROM av"""
    out["o2_duration_histogram"] = """SELECT count(*) FILTER (WHERE value <= 1)::BIGINT AS le_1,
        count(*) FILTER (WHERE value <= 5)::BIGINT AS le_5, count(*) FILTER (WHERE value <= 10)::BIGINT AS le_10,
        count(*) FILTER (WHERE value <= 30)::BIGINT AS le_30, count(*) FILTER (WHERE value <= 60)::BIGINT AS le_60,
        count(value)::BIGINT AS le_inf, round(sum(value), 6) AS sum, count(value)::BIGINT AS count FROM events"""
    tickets = f"""{docs}, {audit_ctes('docs')},
      tk AS (
        SELECT substr(sha256(a.doc_id::VARCHAR || '|run-0001'), 1, 32) AS ticket_id, a.doc_id::VARCHAR AS document_id,
               'run-0001' AS processing_id, 'open' AS status,
               (SELECT count(*) FROM av v WHERE v.doc_id = a.doc_id) || ' violation(s): ' ||
               (SELECT string_agg(DISTINCT type, ', ' ORDER BY type) FROM av v WHERE v.doc_id = a.doc_id)
                 AS violation_summary,
               (SELECT arg_max(severity, (CASE severity WHEN 'critical' THEN 10 WHEN 'high' THEN 5
                         WHEN 'medium' THEN 2 ELSE 1 END) * 1000000 - seq) FROM av v WHERE v.doc_id = a.doc_id)
                 AS severity,
               d.source AS department
        FROM aud a JOIN documents d ON d.doc_id = a.doc_id WHERE a.decision = 'Require Review'),
      upd AS (SELECT event_id, ts, substr(sha256(user_id::VARCHAR || '|run-0001'), 1, 32) AS ticket_id,
                     CASE event_type WHEN 'view' THEN 'in_review' WHEN 'click' THEN 'assigned'
                          WHEN 'purchase' THEN 'resolved' WHEN 'error' THEN 'reopened' ELSE 'open' END AS status
              FROM events)"""
    out["k1_review_queue"] = f"""WITH {tickets} SELECT ticket_id, document_id, processing_id, status,
        violation_summary, severity, department FROM tk"""
    out["k3_ticket_status"] = f"""WITH {tickets},
      last AS (SELECT ticket_id, arg_max(status, (ts, event_id)) AS st, count(*)::BIGINT AS n FROM upd GROUP BY 1)
      SELECT tk.ticket_id, tk.document_id, coalesce(last.st, tk.status) AS status,
             coalesce(last.n, 0)::BIGINT AS n_updates FROM tk LEFT JOIN last USING (ticket_id)"""
    out["k2_open_tickets"] = f"""WITH {tickets},
      last AS (SELECT ticket_id, arg_max(status, (ts, event_id)) AS st, count(*)::BIGINT AS n FROM upd GROUP BY 1)
      SELECT ticket_id, document_id, status, n_updates FROM (
        SELECT tk.ticket_id, tk.document_id, coalesce(last.st, tk.status) AS status,
               coalesce(last.n, 0)::BIGINT AS n_updates FROM tk LEFT JOIN last USING (ticket_id))
      WHERE status = 'open'"""
    out["s11_write_audit"] = f"""WITH {docs}, {audit_ctes('docs')}
      SELECT a.doc_id, 'run-0001' AS run_id, a.decision, a.violation_score,
             (SELECT count(*) FROM av v WHERE v.doc_id = a.doc_id)::BIGINT AS n_violation_rows FROM aud a"""
    out["k3_ticket_status_stream"] = """SELECT substr(sha256(user_id::VARCHAR || '|run-0001'), 1, 32) AS ticket_id,
        arg_max(CASE event_type WHEN 'view' THEN 'in_review' WHEN 'click' THEN 'assigned'
                WHEN 'purchase' THEN 'resolved' WHEN 'error' THEN 'reopened' ELSE 'open' END, (ts, event_id)) AS status,
        count(*)::BIGINT AS n_updates FROM events GROUP BY 1"""
    out["k3_rejected_updates"] = f"""WITH {tickets}
      SELECT status, count(*)::BIGINT AS n_rejected FROM upd WHERE ticket_id NOT IN (SELECT ticket_id FROM tk)
      GROUP BY status"""
    out["v1_evaluate_pii"] = f"""WITH {corpus_docs}, {pii_cte('p', 'cdocs', 'doc_id', 'text')},
      gt AS (SELECT doc_id, email AS g FROM corpus WHERE document_type = 'contract' AND variant < 5
             UNION ALL SELECT doc_id, phone FROM corpus WHERE document_type = 'contract' AND variant < 5),
      tpfn AS (SELECT gt.doc_id, EXISTS (SELECT 1 FROM p WHERE p.doc_id = gt.doc_id AND contains(p.text, gt.g))
                      AS hit FROM gt),
      fp AS (SELECT count(*) AS n FROM p WHERE NOT EXISTS (SELECT 1 FROM gt WHERE gt.doc_id = p.doc_id
                                                          AND contains(p.text, gt.g))),
      c AS (SELECT count(*) FILTER (WHERE hit)::BIGINT AS tp, (SELECT n FROM fp)::BIGINT AS fp,
                   count(*) FILTER (WHERE NOT hit)::BIGINT AS fn FROM tpfn),
      m AS (SELECT tp, fp, fn, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0::DOUBLE END AS pr,
                   CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0::DOUBLE END AS rc FROM c)
      SELECT tp, fp, fn, round(pr, 6) AS precision, round(rc, 6) AS recall,
             round(CASE WHEN pr + rc > 0 THEN 2 * pr * rc / (pr + rc) ELSE 0.0::DOUBLE END, 6) AS f1 FROM m"""
    out["v1_evaluate_audit"] = out["v1_evaluate_pii"]
    out["s2_labels_join"] = """SELECT d.doc_id, length(d.text)::BIGINT AS n_chars, l.quality::BIGINT AS quality,
        l.toxic::BIGINT AS toxic, l.doc_id IS NOT NULL AS has_label
      FROM documents d LEFT JOIN labels l USING (doc_id)"""
    bare = ("CASE WHEN regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN regexp_replace(regexp_replace(url, "
            "'(?s)[?#].*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://[^/]*', '') ELSE url END")
    sfx = f"lower(regexp_extract(regexp_extract({bare}, '([^/]*)$', 1), '^.+(\\.[^.]+)$', 1))"
    ft = ("CASE WHEN s = '.pdf' THEN 'pdf' WHEN s IN ('.docx', '.doc') THEN 'docx' "
          "WHEN s IN ('.png', '.jpg', '.jpeg', '.gif', '.bmp') THEN 'image' WHEN s = '.txt' THEN 'text' "
          "ELSE 'unsupported' END")
    out["s4_route_file_type"] = f"""SELECT page_id, s AS suffix, {ft} AS file_type,
        CASE WHEN {ft} = 'unsupported' THEN 'error' ELSE 'accepted' END AS status,
        CASE WHEN {ft} = 'unsupported' THEN 'Unsupported file type: ' || s END AS error
      FROM (SELECT page_id, {sfx} AS s FROM pages)"""
    out["s5_extract_blocks"] = f"""WITH b AS (
        SELECT conv_id::VARCHAR || ':' || turn::VARCHAR AS doc_id,
               list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda p: {strip('p')}),
                           lambda p: length(p) > 0) AS bl FROM conversations)
      SELECT doc_id, 1::BIGINT AS page, 'page_1_block_' || (i - 1) AS block_id, bl[i] AS text,
             'paragraph' AS block_type
      FROM (SELECT doc_id, bl, unnest(range(1, len(bl) + 1)) AS i FROM b)"""
    out["s7_assemble_documents"] = """SELECT conv_id AS doc_id, string_agg(text, chr(10) || chr(10) ORDER BY turn)
        AS full_text, 1::BIGINT AS total_pages,
        coalesce((SELECT string_agg(t, ' | ' ORDER BY tn) FROM (SELECT c2.text AS t, c2.turn AS tn FROM conversations c2
                  WHERE c2.conv_id = c.conv_id AND c2.role = 'system' ORDER BY c2.turn LIMIT 5)), '') AS headers,
        count(*)::BIGINT AS n_blocks
      FROM conversations c GROUP BY conv_id"""
    # start tags become chr(1) name chr(2), closing tags chr(3): a paragraph is what
    # stands between chr(2) and the next chr(1) or chr(3), inner tags taken out
    opened = r"(?is)<(h[1-6]|p)(?:\s[^>]*)?>"
    closed = (r"(?is)</(?:h[1-6]|p|article|section|div|main|header|footer|aside|nav|td|li|ul|ol|table|form|body|html)\s*>")
    skipped = r"(?is)<(?:script|style)\b.*?</(?:script|style)\s*>|<!--.*?-->"
    out["s8_heading_tagging"] = f"""WITH m AS (
        SELECT page_id, regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), {q(skipped)}, '', 'g'),
               {q(opened)}, chr(1) || '\\1' || chr(2), 'g'), {q(closed)}, chr(3), 'g') AS t FROM pages),
      z AS (SELECT page_id, unnest(string_split(t, chr(1))[2:]) AS x FROM m),
      y AS (SELECT page_id, lower(split_part(x, chr(2), 1)) AS tag,
                   {strip("regexp_replace(split_part(split_part(x, chr(2), 2), chr(3), 1), '<[^>]*>', '', 'g')")} AS text FROM z),
      p AS (SELECT page_id, CASE WHEN tag LIKE 'h%' THEN 'header' ELSE 'paragraph' END AS block_type, text
            FROM y WHERE length(text) > 0)
      SELECT page_id, block_type, count(*)::BIGINT AS n_blocks, sum(length(text))::BIGINT AS n_chars
      FROM p GROUP BY ALL"""
    out["s9_pseudonymise"] = """SELECT coalesce(c_custkey::VARCHAR, uuid()::VARCHAR) AS processing_id,
        substr(sha256(coalesce(c_name, 'anonymous')), 1, 16) AS uploader_id,
        coalesce(c_mktsegment, 'unknown') AS department FROM customer"""
    out["s10_upsert_vectors"] = """SELECT label::BIGINT AS id, max(vec_id)::BIGINT AS vec_id,
        round(list_sum(arg_max(embedding, vec_id)::DOUBLE[]), 6) AS sum_embedding FROM embeddings GROUP BY label"""
    out["s12_error_rows"] = f"""SELECT doc_id, CASE WHEN text IS NULL OR length({strip('text')}) = 0 THEN 'error'
        ELSE 'ok' END AS status, CASE WHEN text IS NULL THEN 'document text is missing'
        WHEN length({strip('text')}) = 0 THEN 'document text is empty' END AS error FROM documents"""
    out["s13_generate_corpus"] = f"""WITH {corpus_docs}
      SELECT doc_id, printf('%s_%02d_%d', document_type, variant + 1, doc_id) AS doc_name, document_type,
             variant::BIGINT AS variant, text,
             (CASE WHEN document_type = 'contract' AND variant < 5 THEN 2 ELSE 0 END)::BIGINT AS n_pii_labels,
             ((CASE WHEN document_type = 'contract' AND variant >= 8 THEN 1 ELSE 0 END)
              + (CASE WHEN document_type = 'policy' AND variant >= 6 THEN 1 ELSE 0 END)
              + (CASE WHEN document_type = 'policy' AND variant >= 7 THEN 1 ELSE 0 END)
              + (CASE WHEN document_type IN ('hr_form', 'invoice') AND variant >= 4 THEN 1 ELSE 0 END))::BIGINT
               AS n_violation_labels
      FROM corpus"""
    out["q2_audit_lookup"] = f"""WITH {docs}, {audit_ctes('docs')},
      req AS (SELECT doc_id FROM labels UNION ALL SELECT doc_id + 1000000000 FROM labels)
      SELECT r.doc_id, a.decision, a.violation_score,
             CASE WHEN a.doc_id IS NULL THEN 'not_found' ELSE 'completed' END AS status
      FROM req r LEFT JOIN aud a USING (doc_id)"""
    out["e2_similar_violations"] = f"""WITH {docs}, {audit_ctes('docs')}, {E2_CTES}
      SELECT vq.doc_id, vq.seq, top.rank::BIGINT AS rank, top.hid AS history_id, round(top.sim, 6) AS similarity
      FROM vq JOIN top ON top.q = vq.q WHERE top.rank <= 3"""
    talk = "tpl AS (SELECT conv_id::VARCHAR || ':' || turn::VARCHAR AS template_id, text AS ttext FROM conversations WHERE text IS NOT NULL)"
    out["q3_audit_stream_history"] = f"""WITH {docs}, {audit_ctes('docs', tpl=talk)}, {E2_CTES}
      SELECT a.doc_id, a.decision, a.violation_score, a.drift_found, v.seq, v.severity, top.rank::BIGINT AS rank, top.hid AS history_id,
             round(top.sim, 6) AS similarity
      FROM aud a JOIN av v USING (doc_id) JOIN vq ON vq.doc_id = v.doc_id AND vq.seq = v.seq JOIN top ON top.q = vq.q WHERE top.rank <= 3"""
    out["s10_violation_history"] = f"""WITH {docs}, {audit_ctes('docs')}
      SELECT type, severity, count(*)::BIGINT AS n_records, count(DISTINCT coalesce(mtext, message, ''))::BIGINT AS n_texts FROM av GROUP BY ALL"""
    out["s10_vector_table"] = """WITH w AS (SELECT label::VARCHAR AS id, vec_id, embedding::DOUBLE[] AS e, vec_id % 3 AS v FROM embeddings)
      SELECT id, arg_max(vec_id, v * 1000000000 + vec_id)::BIGINT AS vec_id,
             round(list_sum(arg_max(e, v * 1000000000 + vec_id)), 6) AS sum_embedding FROM w GROUP BY id"""
    out["d4_drift_vectors"] = """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
      s AS (SELECT a.vec_id, max(1.0 / (1.0 + list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))))) AS sim
            FROM e a JOIN e b ON b.vec_id % 25 = 0 GROUP BY a.vec_id)
      SELECT (vec_id // 4)::BIGINT AS doc_id, (vec_id % 4)::BIGINT AS chunk_index, round(sim, 6) AS similarity,
             CASE WHEN sim > 0.5 THEN 'medium' ELSE 'high' END AS severity FROM s WHERE sim < 0.7"""
    paragraphs = f"list_filter(list_transform(string_split(coalesce(text, ''), {NL2}), lambda p: {strip('p')}), lambda p: length(p) > 0)"
    out["q1_audit_files"] = f"""WITH files AS (
        SELECT doc_id, text, CASE WHEN doc_id % 10 = 7 THEN '.zip' WHEN doc_id % 10 = 8 THEN '' WHEN doc_id % 2 = 0 THEN '.TXT' ELSE '.txt' END AS suffix,
               {paragraphs} AS ps FROM documents WHERE text IS NOT NULL),
      docs AS (SELECT doc_id, array_to_string(ps, {NL2}) AS text FROM files WHERE lower(suffix) = '.txt' AND len(ps) > 0), {audit_ctes('docs')}
      SELECT 'doc' || f.doc_id || f.suffix AS name, 'doc' || f.doc_id AS doc_id,
             CASE WHEN f.doc_id % 3 = 0 THEN 'run-1' ELSE 'run-2' END AS run_id,
             CASE WHEN a.doc_id IS NULL THEN 'error' ELSE a.status END AS status,
             CASE WHEN lower(f.suffix) <> '.txt' THEN 'Unsupported file type: ' || f.suffix WHEN a.doc_id IS NULL THEN 'document text is empty'
                  ELSE a.error END AS error,
             a.decision, a.violation_score, CASE WHEN a.doc_id IS NOT NULL THEN len(f.ps)::BIGINT END AS n_blocks,
             substr(sha256('user' || (f.doc_id % 5)), 1, 16) AS uploader_id,
             CASE WHEN f.doc_id % 4 = 0 THEN 'unknown' ELSE 'dep' || (f.doc_id % 4) END AS department
      FROM files f LEFT JOIN aud a USING (doc_id)"""
    out["s1_read_corpus"] = """SELECT 'doc' || doc_id AS doc_id, length(text)::BIGINT AS n_chars, sha256(text) AS digest
        FROM documents WHERE text IS NOT NULL AND doc_id % 10 NOT IN (7, 8)"""
    out["s3_reference_texts"] = """SELECT 'notes.v' || item_id || CASE WHEN item_id % 4 = 3 THEN '.md' ELSE '' END AS id, sha256(text) AS digest
        FROM benchmark WHERE text IS NOT NULL AND item_id % 4 <> 2"""
    # F1's text by the sequential rule, then: edits before the first one that meets
    # its successor stand alone, the others are one region
    out["f2_change_segments"] = f"""WITH {corpus_docs}, {audit_ctes('cdocs')},
      sg AS (SELECT doc_id, list(struct_pack(s := span_start, e := span_end, r := replacement)
                                 ORDER BY span_start, seq) AS l,
                    list(struct_pack(s := span_start, e := span_end, r := replacement)
                         ORDER BY span_start DESC, seq) AS dl FROM asug GROUP BY doc_id),
      d AS (SELECT c.doc_id, coalesce(c.text, '') AS t, coalesce(sg.l, []) AS l,
                   list_reduce(coalesce(sg.dl, []), lambda acc, x: substr(acc, 1, x.s) || x.r || substr(acc, x.e + 1),
                               coalesce(c.text, '')) AS final
            FROM cdocs c LEFT JOIN sg USING (doc_id)),
      f AS (SELECT *, coalesce(list_min(list_filter(range(1, len(l)), lambda k: l[k + 1].s < l[k].e OR l[k + 1].s = l[k].s)),
                               len(l) + 1) AS k0 FROM d),
      g AS (SELECT *, l[1:k0 - 1] AS alone, l[k0:] AS reg FROM f),
      h AS (SELECT *, coalesce(alone[len(alone)].e, 0) AS last,
                   CASE WHEN len(reg) > 0 THEN reg[1].s ELSE length(t) END AS rs,
                   CASE WHEN len(reg) > 0 THEN list_max(list_transform(reg, lambda x: x.e)) ELSE length(t) END AS re,
                   flatten(list_transform(range(1, len(alone) + 1), lambda k: [
                     struct_pack(op := 'equal', t := substr(t, (CASE WHEN k = 1 THEN 0 ELSE alone[k - 1].e END) + 1,
                         greatest(alone[k].s - (CASE WHEN k = 1 THEN 0 ELSE alone[k - 1].e END), 0))),
                     struct_pack(op := 'delete', t := substr(t, alone[k].s + 1, greatest(alone[k].e - alone[k].s, 0))),
                     struct_pack(op := 'insert', t := alone[k].r)])) AS head FROM g),
      i AS (SELECT *, substr(t, last + 1, greatest(rs - last, 0)) AS btw, substr(t, re + 1) AS behind0 FROM h),
      j AS (SELECT *, substr(final, 1 + length(btw) + coalesce(list_sum(list_transform(list_filter(head,
                      lambda p: p.op <> 'delete'), lambda p: length(p.t))), 0)::BIGINT) AS rest FROM i),
      k AS (SELECT *, ends_with(rest, behind0) AS clean FROM j),
      q AS (SELECT doc_id, list_filter(list_concat(head, [
                     struct_pack(op := 'equal', t := btw),
                     struct_pack(op := 'delete', t := CASE WHEN len(reg) = 0 THEN '' WHEN clean THEN substr(t, rs + 1, re - rs)
                                                           ELSE substr(t, rs + 1) END),
                     struct_pack(op := 'insert', t := CASE WHEN len(reg) = 0 THEN '' WHEN clean
                                                           THEN substr(rest, 1, length(rest) - length(behind0)) ELSE rest END),
                     struct_pack(op := 'equal', t := CASE WHEN len(reg) > 0 AND clean THEN behind0 ELSE '' END)]),
                   lambda x: length(x.t) > 0) AS segs FROM k)
      SELECT doc_id, i::BIGINT AS seg, segs[i + 1].op AS op, segs[i + 1].t AS text
      FROM (SELECT doc_id, segs, unnest(range(0, len(segs))) AS i FROM q)"""
    notes = """notes AS (SELECT c_custkey::BIGINT AS doc_id, 'Account ' || lpad(c_custkey::VARCHAR, 9, '7') || ', IBAN GB'
        || lpad((c_custkey % 100)::VARCHAR, 2, '0') || 'NWBK' || lpad(c_custkey::VARCHAR, 14, '6') || ', SSN '
        || lpad((c_custkey % 1000)::VARCHAR, 3, '4') || '-55-' || lpad((c_custkey % 10000)::VARCHAR, 4, '1') || '.' AS text
        FROM customer)"""
    out["p3_confirm_pii_notes"] = f"WITH {notes}, {pii_cte('p', 'notes', 'doc_id', 'text', confirm=True)} SELECT {pii_cols} FROM p"
    out["s4_route_files_orders"] = """WITH n AS (SELECT o_orderkey, o_orderkey % 10 AS i FROM orders),
      s AS (SELECT o_orderkey, ['.pdf', '.docx', '.doc', '.png', '.txt', '.zip', '', '.jpeg', '.gif', '.bmp'][i + 1] AS suffix FROM n),
      f AS (SELECT *, CASE suffix WHEN '.pdf' THEN 'pdf' WHEN '.docx' THEN 'docx' WHEN '.doc' THEN 'docx' WHEN '.txt' THEN 'text'
                           WHEN '.zip' THEN 'unsupported' WHEN '' THEN 'unsupported' ELSE 'image' END AS file_type FROM s)
      SELECT o_orderkey, suffix, file_type, CASE file_type WHEN 'unsupported' THEN 'error' ELSE 'accepted' END AS status,
             CASE file_type WHEN 'unsupported' THEN 'Unsupported file type: ' || suffix END AS error FROM f"""
    out["s12_error_rows_requested"] = """WITH req AS (SELECT doc_id FROM labels UNION ALL SELECT doc_id + 1000000000 FROM labels)
      SELECT r.doc_id, CASE WHEN d.doc_id IS NULL THEN 'error' ELSE 'ok' END AS status,
             CASE WHEN d.doc_id IS NULL THEN 'document text is missing' END AS error
      FROM req r LEFT JOIN documents d USING (doc_id)"""
    out["q4_stream_metrics"] = """SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS window_start,
        strftime(date_trunc('day', ts) + INTERVAL 1 DAY, '%Y-%m-%d') AS window_end, event_type,
        count(*)::BIGINT AS n_events, round(sum(value), 6) AS total_value FROM events GROUP BY ALL"""
    out["t1_classify_whole"] = """SELECT document_type, count(*)::BIGINT AS n_documents FROM (
        SELECT """ + classify_case("text").replace("substr(coalesce(text, ''), 1, 1000)", "coalesce(text, '')") + """ AS document_type
        FROM documents) GROUP BY 1"""
    out["s6_ocr_blocks"] = """SELECT conv_id AS doc_id, 'ocr_block_' || turn AS block_id, text,
        turn::DOUBLE AS x1, (turn + 1)::DOUBLE AS y2 FROM conversations
        WHERE ((conv_id * 7 + turn * 13) % 10) / 10.0::DOUBLE > 0.5"""
    out["q1_audit_requested"] = f"""WITH req AS (SELECT doc_id FROM labels UNION ALL SELECT doc_id + 1000000000 FROM labels),
      docs AS (SELECT r.doc_id, d.text FROM req r LEFT JOIN documents d USING (doc_id)), {audit_ctes('docs')}
      SELECT doc_id, status, error, decision, reason, violation_score FROM aud"""
    out["q4_severity_stream"] = f"""WITH {docs}, {audit_ctes('docs')}
      SELECT coalesce(severity, 'unknown') AS severity, count(*)::BIGINT AS violations FROM av GROUP BY 1"""
    out["q3_audit_stream"] = f"""WITH {docs}, {audit_ctes('docs')}
      SELECT a.doc_id, a.document_type, a.violation_score, a.decision, a.reason,
             (SELECT count(*) FROM av v WHERE v.doc_id = a.doc_id)::BIGINT AS n_violations,
             (SELECT count(*) FROM av v WHERE v.doc_id = a.doc_id)::BIGINT AS n_suggestions FROM aud a"""
    return out
