"""DuckDB oracle SQL for the registered queries.

The fixture CTEs restate ``vulnsift.plans.fixtures`` in SQL; each query then states its
operator the plain relational way (explode + distinct + outer join + group by), an
independent formulation of what the Spark plans compute with array algebra.
"""

from __future__ import annotations

from vulnsift.plans.fixtures import CATEGORIES, EXPERIMENT_STAGES
from vulnsift.schemas import TYPE_TO_SWC_EXACT, TYPE_TO_SWC_SUBSTRING

NL = "chr(10)"


def sql_list(items) -> str:
    return "[" + ", ".join(f"'{x}'" for x in items) + "]"


def cat(x: str) -> str:
    return f"list_extract({sql_list(CATEGORIES)}, CAST(({x}) % 8 AS INTEGER) + 1)"


def f01(t: str) -> str:
    whens = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in TYPE_TO_SWC_EXACT)
    return f"(CASE lower({t}) {whens} ELSE 'SWC-000' END)"


def f02(t: str) -> str:
    whens = " ".join(f"WHEN contains(lower(coalesce({t}, '')), '{k}') THEN '{v}'" for k, v in TYPE_TO_SWC_SUBSTRING)
    return f"(CASE {whens} ELSE 'SWC-000' END)"


def s(x: str) -> str:
    return f"CAST({x} AS VARCHAR)"


def lines_text(d: str, i: str) -> str:
    st = f"(({d} + 7 * {i}) % 40 + 1)"
    w = f"(({d} + {i}) % 6)"
    return (f"(CASE WHEN {d} % 11 = 0 THEN 'about ' || {s(st)} WHEN {d} % 9 = 0 THEN {s(st)} "
            f"ELSE {s(st)} || '-' || {s(st + ' + ' + w)} END)")


def block(typ: str, cls: str, st: str, en: str) -> str:
    return (f"('Vulnerability: ' || {typ} || {NL} || 'CWE: CWE-841' || {NL} || 'SWC: SWC-' || {cls} || {NL} || "
            f"'Lines: ' || {s(st)} || '-' || {s(en)} || {NL} || 'Severity: High' || {NL} || "
            f"'Explanation: External call before state update.' || {NL} || 'Remediation: Update state before the call.')")


def completion_text(d: str, k: str, t: str | None = None) -> str:
    t = t or f"(({d} * 31 + {k} * 17) % 12)"
    c = cat(d)
    cls = f"substr({f01(c)}, 5, 3)"
    alt = f"(CASE WHEN {cls} = '107' THEN '104' ELSE '107' END)"
    typ = f"replace({c}, '_', ' ')"
    st = f"({d} % 40 + 1)"
    en = f"({d} % 40 + 4)"
    return f"""(CASE
      WHEN {t} = 0 THEN {block(typ, cls, st, en)}
      WHEN {t} = 1 THEN 'Vulnerability: ' || {typ} || {NL} || 'SWC: ' || {cls} || {NL} || 'Lines: ' || {s(st)} || {NL} || 'Severity: Medium' || {NL} || 'Explanation: Bare class number.'
      WHEN {t} = 2 THEN 'Possible issue SWC-' || {cls} || ' around line ' || {s(st)} || '.'
      WHEN {t} = 3 THEN 'vulnerability: ' || {typ} || {NL} || 'swc: swc-' || {cls} || {NL} || 'lines: ' || {s(st)} || '-' || {s(en)} || {NL} || 'severity: low' || {NL} || 'explanation: lower case answer.'
      WHEN {t} = 4 THEN 'Vulnerability: ' || {typ} || {NL} || 'Severity: Medium' || {NL} || 'Explanation: Type only, no class given.'
      WHEN {t} = 5 THEN {block(typ, cls, st, en)} || {NL} || {NL} || {block(typ, alt, st + ' + 10', en + ' + 10')}
      WHEN {t} = 6 THEN {block(typ, cls, st, en)} || {NL} || {NL} || {block(typ, cls, st + ' + 20', en + ' + 20')}
      WHEN {t} = 7 THEN 'Vulnerability: None' || {NL} || 'Explanation: No vulnerabilities detected in this contract.'
      WHEN {t} = 8 THEN {block(typ, cls, st, en)} || {NL} || {NL} || 'There are no vulnerabilities elsewhere in the code.'
      WHEN {t} = 9 THEN 'Vulnerability: ' || {typ} || {NL} || 'SWC: SWC-' || {cls} || {NL} || 'Lines: ' || {s(en)} || '-' || {s(st)} || {NL} || 'Severity: High' || {NL} || 'Explanation: Reversed range.'
      WHEN {t} = 10 THEN '<think>' || {NL} || 'The withdraw function sends value before it updates the balance.' || {NL} || '</think>' || {NL} || {block(typ, cls, st, en)}
      WHEN {t} = 13 THEN {block(typ, f"(CASE {cls} WHEN '107' THEN '114' WHEN '114' THEN '107' WHEN '116' THEN '128' WHEN '128' THEN '116' ELSE '999' END)", st, en)}
      WHEN {t} = 12 THEN {block(typ, f"{cls} || '0'", st, en)}
      ELSE '' END)"""


FIXTURE_CTES = f"""
contracts AS (
  SELECT * FROM (
    SELECT d.doc_id AS contract_id, d.text AS source_code,
      'dataset/' || {cat('d.doc_id')} || '/' || CAST(d.doc_id AS VARCHAR) || '.sol' AS file_path,
      CASE WHEN l.toxic = 1 THEN 'curated'
           WHEN l.quality = 0 AND l.toxic = 0 THEN 'tabular'
           WHEN l.quality = 1 AND l.toxic = 0 THEN 'clean'
           WHEN l.toxic IS NULL THEN 'unlabelled' END AS source,
      {cat('d.doc_id')} AS category
    FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id) x
  WHERE source IS NOT NULL
),
vulns AS (
  SELECT c.contract_id, CAST(r.i AS INTEGER) AS vidx,
    {cat('c.contract_id + 3 * r.i')} AS type,
    {f01(cat('c.contract_id + 3 * r.i'))} AS swc_id,
    CASE WHEN c.contract_id % 4 = 0 THEN 'CWE-' || CAST(c.contract_id % 50 + 100 AS VARCHAR) END AS cwe_id,
    CASE WHEN c.contract_id % 7 <> 3 THEN {lines_text('c.contract_id', 'r.i')} END AS lines,
    CASE WHEN c.contract_id % 7 = 3 THEN {lines_text('c.contract_id', 'r.i')} END AS line_range,
    CASE c.contract_id % 4 WHEN 0 THEN 'High' WHEN 1 THEN 'Medium' WHEN 2 THEN 'Low' END AS severity,
    CASE WHEN c.contract_id % 2 = 0 THEN 'Finding ' || CAST(r.i AS VARCHAR) || ' in contract ' || CAST(c.contract_id AS VARCHAR) END AS explanation,
    CASE WHEN c.contract_id % 2 = 1 AND c.contract_id % 3 = 0 THEN 'Described issue ' || CAST(c.contract_id AS VARCHAR) END AS description,
    CASE WHEN c.contract_id % 5 <> 1 THEN 'Apply checks-effects-interactions.' END AS remediation
  FROM contracts c, range(2) r(i)
  WHERE c.source = 'curated' AND (r.i = 0 OR c.contract_id % 5 = 0)
),
ground_truth AS (
  SELECT contract_id, swc_id, type AS vuln_type, coalesce(lines, line_range) AS lines, severity FROM vulns
),
completions AS (
  SELECT c.contract_id, CAST(r.k AS INTEGER) AS k,
    CASE WHEN r.k = 0 THEN 'strong' WHEN r.k = 1 THEN 'weak' ELSE 'policy' END AS model,
    {completion_text('c.contract_id', 'r.k')} AS text
  FROM contracts c, range(8) r(k)
  WHERE c.source IN ('curated', 'clean')
),
eval_contracts AS (
  SELECT contract_id, source = 'curated' AS is_vulnerable FROM contracts WHERE source IN ('curated', 'clean')
),
blocks AS (
  SELECT contract_id, k, CAST(i - 1 AS INTEGER) AS block, arr[i] AS body FROM (
    SELECT contract_id, k, arr, unnest(generate_series(1, len(arr))) AS i FROM (
      SELECT contract_id, k, string_split_regex(text, '\\n\\s*\\n+') AS arr FROM completions
      WHERE NOT regexp_matches(lower(text), 'vulnerability[:\\s]*none|no vulnerabilit')))
),
block_fields AS (
  SELECT contract_id, k, block,
    regexp_extract(body, '(?i)SWC[:\\s]*(SWC-?\\d+|\\d+)', 1) AS swc_raw,
    regexp_extract(body, '(?i)CWE[:\\s]*(CWE-?\\d+|\\d+)', 1) AS cwe_raw,
    regexp_replace(regexp_extract(body, '(?i)Vulnerability[:\\s]*([^\\n]+)', 1), '^\\s+|\\s+$', '', 'g') AS vuln_type,
    nullif(regexp_replace(regexp_extract(body, '(?i)Lines?[:\\s]*(\\d+(?:\\s*-\\s*\\d+)?)', 1), '^\\s+|\\s+$', '', 'g'), '') AS lines,
    coalesce(nullif(regexp_extract(body, '(?i)Severity[:\\s]*(\\w+)', 1), ''), 'Medium') AS severity,
    regexp_replace(regexp_extract(body, '(?i)Explanation[:\\s]*([^\\n]+)', 1), '^\\s+|\\s+$', '', 'g') AS explanation
  FROM blocks WHERE regexp_replace(body, '^\\s+|\\s+$', '', 'g') <> ''
),
findings AS (
  SELECT contract_id, k, block,
    CASE WHEN swc = '' THEN {f02('vuln_type')} ELSE swc END AS swc_id,
    cwe_id, vuln_type, severity, lines, explanation, CAST(1.0 AS DOUBLE) AS confidence
  FROM (
    SELECT *,
      CASE WHEN swc_raw = '' THEN '' WHEN starts_with(swc_raw, 'SWC') THEN upper(swc_raw) ELSE upper('SWC-' || swc_raw) END AS swc,
      CASE WHEN cwe_raw = '' THEN NULL WHEN starts_with(cwe_raw, 'CWE') THEN upper(cwe_raw) ELSE upper('CWE-' || cwe_raw) END AS cwe_id
    FROM block_fields) f
  WHERE swc <> '' OR vuln_type <> ''
),
units AS (
  SELECT c.contract_id, c.k, e.is_vulnerable FROM completions c JOIN eval_contracts e USING (contract_id)
),
n_found AS (SELECT contract_id, k, count(*) AS n_pred FROM (SELECT DISTINCT contract_id, k, swc_id FROM findings) GROUP BY ALL)
"""


_PLAIN_ANSWERS = FIXTURE_CTES[FIXTURE_CTES.index("completions AS ("):FIXTURE_CTES.index("eval_contracts AS (")]
_T = "(c.contract_id * 31 + r.k * 17) % 12"
_MIXED_ANSWERS = f"""completions AS (
  SELECT contract_id, k, model,
    CASE WHEN k % 5 = 0 AND body <> '' THEN '<think>' || {NL} || source_code || {NL} || '</think>' || {NL} || body ELSE body END AS text
  FROM (SELECT *, {completion_text('contract_id', 'k', 't')} AS body FROM (
    SELECT c.contract_id, c.source_code, CAST(r.k AS INTEGER) AS k,
      CASE WHEN r.k = 0 THEN 'strong' WHEN r.k = 1 THEN 'weak' ELSE 'policy' END AS model,
      CASE c.contract_id % 6 WHEN 0 THEN 1 WHEN 1 THEN (CASE WHEN r.k % 4 = 0 THEN 5 ELSE 1 END)
        WHEN 2 THEN (CASE WHEN r.k % 3 = 0 THEN 12 ELSE {_T} END) WHEN 3 THEN (CASE WHEN r.k % 4 = 1 THEN 13 ELSE {_T} END)
        ELSE {_T} END AS t
    FROM contracts c, range(40) r(k) WHERE c.source IN ('curated', 'clean') AND r.k <= c.contract_id % 40))
),
"""
_LABELLED = "WHERE c.source = 'curated' AND (r.i = 0 OR c.contract_id % 5 = 0)"


def mixed(sql: str) -> str:
    """A query's SQL over the mixed answers and labels of the fixtures."""
    assert _PLAIN_ANSWERS in sql and _LABELLED in sql
    return sql.replace(_PLAIN_ANSWERS, _MIXED_ANSWERS).replace(_LABELLED, _LABELLED + " AND c.contract_id % 13 <> 0")


def with_fixtures(body: str) -> str:
    return "WITH " + FIXTURE_CTES.strip() + ",\n" + body.strip().removeprefix("WITH").strip() if body.strip().startswith("WITH") \
        else "WITH " + FIXTURE_CTES.strip() + "\n" + body


def matched(cls_expr: str = "swc_id") -> str:
    """Per-answer tp/fp/fn by distinct class via full outer join (the relational J04)."""
    return f"""
pred_c AS (SELECT DISTINCT contract_id, k, {cls_expr} AS cls FROM findings),
truth_c AS (SELECT DISTINCT u.contract_id, u.k, {cls_expr.replace('swc_id', 'v.swc_id')} AS cls
            FROM units u JOIN vulns v ON u.contract_id = v.contract_id),
m AS (
  SELECT coalesce(p.contract_id, t.contract_id) AS contract_id, coalesce(p.k, t.k) AS k,
         p.cls IS NOT NULL AS in_pred, t.cls IS NOT NULL AS in_truth, coalesce(p.cls, t.cls) AS cls
  FROM pred_c p FULL OUTER JOIN truth_c t ON p.contract_id = t.contract_id AND p.k = t.k AND p.cls = t.cls
),
per_unit AS (
  SELECT contract_id, k,
    count(*) FILTER (WHERE in_pred AND in_truth) AS tp,
    count(*) FILTER (WHERE in_pred AND NOT in_truth) AS fp,
    count(*) FILTER (WHERE in_truth AND NOT in_pred) AS fn,
    string_agg(CASE WHEN in_pred AND in_truth THEN cls END, ',' ORDER BY cls) AS matched
  FROM m GROUP BY ALL
),
scored AS (
  SELECT u.contract_id, u.k, u.is_vulnerable, coalesce(p.tp, 0) AS tp, coalesce(p.fp, 0) AS fp,
         coalesce(p.fn, 0) AS fn, coalesce(n.n_pred, 0) AS n_pred, coalesce(p.matched, '') AS matched
  FROM units u LEFT JOIN per_unit p USING (contract_id, k) LEFT JOIN n_found n USING (contract_id, k)
)"""


def rates_sql(src: str, group: str = "k") -> str:
    return f"""
tot AS (
  SELECT {group}, count(*) AS total_contracts,
    count(*) FILTER (WHERE is_vulnerable) AS vulnerable_contracts,
    count(*) FILTER (WHERE NOT is_vulnerable) AS clean_contracts,
    CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn,
    count(*) FILTER (WHERE NOT is_vulnerable AND n_pred = 0) AS tn
  FROM {src} GROUP BY {group}
),
rt AS (
  SELECT *,
    CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS precision,
    CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS recall,
    CASE WHEN fp + tn > 0 THEN fp / (fp + tn) ELSE 0.0 END AS false_positive_rate
  FROM tot
),
metrics AS (
  SELECT *, CASE WHEN precision + recall = 0 THEN 0.0 ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM rt
)"""


ORACLE: dict[str, str] = {}


def register(name: str, body: str) -> None:
    ORACLE[name] = with_fixtures(body)


# ---------------------------------------------------------------------------
# Evaluation family
# ---------------------------------------------------------------------------

register("eval_metrics", f"""WITH {matched().strip()},{rates_sql('scored').strip()}
SELECT k, total_contracts, vulnerable_contracts, clean_contracts, tp, fp, fn, tn,
  round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1,
  round(false_positive_rate, 9) AS false_positive_rate
FROM metrics""")

register("findings_parse", """
SELECT contract_id, k, block, swc_id, cwe_id, vuln_type, severity, lines, explanation, confidence FROM findings""")

register("match_exact", f"""WITH {matched().strip()}
SELECT contract_id, k, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, matched FROM scored""")

register("match_category", f"""WITH {matched("CASE WHEN length(swc_id) >= 7 THEN substr(swc_id, 1, 7) ELSE swc_id END").strip()}
SELECT contract_id, k, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn FROM scored""")

register("class_dialects", """
SELECT contract_id, k,
  coalesce((SELECT string_agg(swc_id, ',' ORDER BY block) FROM findings f WHERE f.contract_id = c.contract_id AND f.k = c.k), '') AS parse_classes,
  array_to_string(list_transform(regexp_extract_all(text, '(?i)SWC[:\\s]*(\\d+|SWC-\\d+)', 1), lambda x: replace(replace(x, 'SWC-', ''), 'swc-', '')), ',') AS reward_classes,
  CASE WHEN regexp_extract(text, '(?i)SWC[:\\s]*([0-9]{3})', 1) = '' THEN NULL ELSE 'SWC-' || regexp_extract(text, '(?i)SWC[:\\s]*([0-9]{3})', 1) END AS filter_class,
  CASE WHEN regexp_extract(text, 'SWC[:\\s]*([0-9]{3})', 1) <> '' THEN 'SWC-' || regexp_extract(text, 'SWC[:\\s]*([0-9]{3})', 1)
       WHEN regexp_extract(text, 'SWC-([0-9]{3})', 1) <> '' THEN 'SWC-' || regexp_extract(text, 'SWC-([0-9]{3})', 1)
       WHEN regexp_extract(text, 'swc[:\\s]*([0-9]{3})', 1) <> '' THEN 'SWC-' || regexp_extract(text, 'swc[:\\s]*([0-9]{3})', 1)
  END AS spec_class
FROM completions c""")

register("per_class_recall", """
SELECT u.k, v.swc_id,
  count(*) FILTER (WHERE EXISTS (SELECT 1 FROM findings f WHERE f.contract_id = u.contract_id AND f.k = u.k AND f.swc_id = v.swc_id)) AS tp,
  count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM findings f WHERE f.contract_id = u.contract_id AND f.k = u.k AND f.swc_id = v.swc_id)) AS fn,
  round(CASE WHEN count(*) > 0 THEN count(*) FILTER (WHERE EXISTS (SELECT 1 FROM findings f WHERE f.contract_id = u.contract_id AND f.k = u.k AND f.swc_id = v.swc_id)) / count(*) ELSE 0.0 END, 9) AS recall
FROM units u JOIN vulns v ON u.contract_id = v.contract_id
GROUP BY u.k, v.swc_id""")

register("macro_f1", f"""WITH {matched().strip()},
pc AS (
  SELECT k, cls, count(*) FILTER (WHERE in_pred AND in_truth) AS tp,
    count(*) FILTER (WHERE in_pred AND NOT in_truth) AS fp, count(*) FILTER (WHERE in_truth AND NOT in_pred) AS fn
  FROM m GROUP BY k, cls
),
pf AS (
  SELECT k, cls, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS r FROM pc
)
SELECT k, round(avg(CASE WHEN p + r = 0 THEN 0.0 ELSE 2 * p * r / (p + r) END), 9) AS macro_f1, count(*) AS n_classes
FROM pf GROUP BY k""")

register("target_report", f"""WITH {matched().strip()},{rates_sql('scored').strip()},
targets AS (SELECT * FROM (VALUES ('precision', 0.35, true, 'Precision:'), ('recall', 0.70, true, 'Recall:'),
   ('f1', 0.45, true, 'F1 Score:'), ('false_positive_rate', 0.65, false, 'False Positive Rate:')) t(metric, target, higher_better, label)),
long AS (
  SELECT k, 'precision' AS metric, precision AS value FROM metrics UNION ALL
  SELECT k, 'recall', recall FROM metrics UNION ALL
  SELECT k, 'f1', f1 FROM metrics UNION ALL
  SELECT k, 'false_positive_rate', false_positive_rate FROM metrics
)
SELECT k, metric, round(value, 9) AS value, CAST(target AS DOUBLE) AS target, higher_better,
  CASE WHEN (higher_better AND value >= target) OR (NOT higher_better AND value <= target) THEN 'PASS' ELSE 'FAIL' END AS status
FROM long JOIN targets USING (metric)""")

register("infer_class_exact", f"""
SELECT contract_id, category, {f01('category')} AS swc_id FROM contracts""")

register("infer_class_substring", f"""
SELECT contract_id, category, {f02('category')} AS swc_id,
  {f02("replace(category, '_', ' ')")} AS swc_id_spaced FROM contracts""")

register("primary_only", f"""WITH {matched().strip()}
SELECT DISTINCT f.contract_id, f.k, f.swc_id FROM findings f
WHERE f.swc_id IN ('SWC-107', 'SWC-101', 'SWC-115', 'SWC-104', 'SWC-114')""")

register("class_attributes", """
WITH p AS (SELECT * FROM (VALUES ('SWC-107', 'Reentrancy', 'CWE-841', 0.80), ('SWC-101', 'Integer Overflow/Underflow', 'CWE-190', 0.75),
  ('SWC-115', 'Access Control', 'CWE-284', 0.60), ('SWC-104', 'Unchecked External Calls', 'CWE-252', 0.70),
  ('SWC-114', 'Front-Running', 'CWE-362', 0.65)) t(swc_id, class_name, cwe, target_f1))
SELECT g.contract_id, g.swc_id, p.class_name, p.cwe, CAST(p.target_f1 AS DOUBLE) AS target_f1
FROM ground_truth g LEFT JOIN p USING (swc_id)""")


def oracle_sql() -> dict[str, str]:
    if "ablation_records" not in ORACLE:
        register("ablation_records", _ablations())
        ORACLE["ablation_records_mixed"] = mixed(ORACLE["ablation_records"])
    return dict(ORACLE)


# ---------------------------------------------------------------------------
# Rewards family
# ---------------------------------------------------------------------------

PRED_LINES = "Lines?[:\\s]*(\\d+)(?:\\s*-\\s*(\\d+))?"

REWARD_CTES = f"""
gt AS (SELECT contract_id, list(replace(coalesce(swc_id, ''), 'SWC-', '')) AS gt_num, list(coalesce(swc_id, '')) AS gt_swc
       FROM vulns GROUP BY contract_id),
rw0 AS (
  SELECT c.contract_id, c.k, c.text, coalesce(g.gt_num, []::VARCHAR[]) AS gt_num, coalesce(g.gt_swc, []::VARCHAR[]) AS gt_swc,
    list_transform(regexp_extract_all(c.text, '(?i)SWC[:\\s]*(\\d+|SWC-\\d+)', 1), lambda x: replace(replace(x, 'SWC-', ''), 'swc-', '')) AS model,
    len(regexp_extract_all(c.text, '{PRED_LINES}', 1)) AS n_line_matches
  FROM completions c LEFT JOIN gt g USING (contract_id)
),
pm AS (SELECT contract_id, k, unnest(regexp_extract_all(text, '{PRED_LINES}', 1)) AS a,
              unnest(regexp_extract_all(text, '{PRED_LINES}', 2)) AS b FROM completions),
pl AS (SELECT DISTINCT contract_id, k, unnest(generate_series(CAST(a AS BIGINT), CAST(CASE WHEN b IS NULL OR b = '' THEN a ELSE b END AS BIGINT))) AS line FROM pm),
tr AS (SELECT contract_id, coalesce(lines, line_range, '') AS lr FROM vulns),
tb AS (SELECT contract_id,
    CASE WHEN contains(lr, '-') THEN (CASE WHEN len(string_split(lr, '-')) = 2 THEN TRY_CAST(trim(string_split(lr, '-')[1]) AS BIGINT) END)
         ELSE TRY_CAST(trim(lr) AS BIGINT) END AS s,
    CASE WHEN contains(lr, '-') THEN (CASE WHEN len(string_split(lr, '-')) = 2 THEN TRY_CAST(trim(string_split(lr, '-')[2]) AS BIGINT) END)
         ELSE TRY_CAST(trim(lr) AS BIGINT) END AS e
  FROM tr),
tl AS (SELECT DISTINCT contract_id, unnest(generate_series(s, e)) AS line FROM tb WHERE s IS NOT NULL AND e IS NOT NULL),
lc AS (
  SELECT c.contract_id, c.k,
    (SELECT count(*) FROM pl WHERE pl.contract_id = c.contract_id AND pl.k = c.k) AS n_pred_lines,
    (SELECT count(*) FROM tl WHERE tl.contract_id = c.contract_id) AS n_truth_lines,
    (SELECT count(*) FROM pl JOIN tl ON pl.contract_id = tl.contract_id AND pl.line = tl.line
      WHERE pl.contract_id = c.contract_id AND pl.k = c.k) AS n_inter
  FROM completions c
),
rw AS (
  SELECT r.contract_id, r.k, r.text, r.gt_swc,
    CASE WHEN len(r.gt_num) = 0 THEN (CASE WHEN len(r.model) = 0 OR contains(lower(r.text), 'none') THEN 1.0 ELSE -1.0 END)
         WHEN len(r.model) = 0 THEN -1.0
         WHEN len(list_filter(r.model, lambda x: list_contains(r.gt_num, x))) > 0
           THEN len(list_filter(r.model, lambda x: list_contains(r.gt_num, x))) / greatest(len(r.gt_num), len(r.model))
         ELSE -0.5 END AS class_reward,
    CASE WHEN len(r.gt_num) = 0 OR r.n_line_matches = 0 THEN 0.0
         WHEN lc.n_pred_lines = 0 OR lc.n_truth_lines = 0 THEN 0.0
         ELSE lc.n_inter / (lc.n_pred_lines + lc.n_truth_lines - lc.n_inter) END AS line_reward,
    (CAST(regexp_matches(r.text, '(?i)Vulnerability[:\\s]') AS INTEGER) + CAST(regexp_matches(r.text, '(?i)SWC[:\\s]') AS INTEGER)
     + CAST(regexp_matches(r.text, '(?i)Lines?[:\\s]') AS INTEGER) + CAST(regexp_matches(r.text, '(?i)Severity[:\\s]') AS INTEGER)
     + CAST(regexp_matches(r.text, '(?i)Explanation[:\\s]') AS INTEGER)) / 5.0 AS format_reward,
    lc.n_pred_lines, lc.n_truth_lines
  FROM rw0 r JOIN lc USING (contract_id, k)
),
rwt AS (SELECT *, 0.5 * class_reward + 0.3 * line_reward + 0.2 * format_reward AS reward FROM rw),
adv AS (SELECT *, reward - avg(reward) OVER (PARTITION BY contract_id) AS advantage,
          max(reward) OVER (PARTITION BY contract_id) AS max_r, min(reward) OVER (PARTITION BY contract_id) AS min_r FROM rwt),
ver AS (
  SELECT *, CAST(CASE WHEN got IS NULL THEN 0.0 WHEN list_contains(gt_swc, got) THEN 1.0
     WHEN len(gt_swc) = 0 AND (got = 'None' OR contains(lower(text), 'no vulnerability')) THEN 1.0 ELSE 0.0 END AS DOUBLE) AS verified
  FROM (SELECT *, CASE WHEN regexp_extract(text, '(?i)SWC[:\\s]*([0-9]{{3}})', 1) = '' THEN NULL
                       ELSE 'SWC-' || regexp_extract(text, '(?i)SWC[:\\s]*([0-9]{{3}})', 1) END AS got FROM rwt)
),
pr AS (
  SELECT contract_id, avg(verified) AS pass_rate, avg(CASE WHEN reward > 0 THEN 1.0 ELSE 0.0 END) AS positive_share,
    count(*) AS n_completions, CAST(sum(verified) AS BIGINT) AS n_correct
  FROM ver WHERE text <> '' GROUP BY contract_id
)"""


def register_rw(name: str, body: str) -> None:
    register(name, "WITH " + REWARD_CTES.strip() + "\n" + body.strip())


register_rw("reward_components", """SELECT contract_id, k, round(class_reward, 9) AS class_reward,
  round(line_reward, 9) AS line_reward, round(format_reward, 9) AS format_reward FROM rw""")
register_rw("reward_total", "SELECT contract_id, k, round(reward, 9) AS reward FROM rwt")
register_rw("line_iou", """SELECT contract_id, k, n_pred_lines, n_truth_lines, round(line_reward, 9) AS iou FROM rw""")
register_rw("rollout_scores", "SELECT contract_id, k, round(reward, 9) AS reward, round(advantage, 9) AS advantage FROM adv")
register_rw("advantages", "SELECT contract_id, k, round(advantage, 9) AS advantage FROM adv")
register_rw("zero_gradient", "SELECT contract_id, k, round(advantage, 9) AS advantage FROM adv WHERE max_r <> min_r")
register_rw("group_mean", "SELECT contract_id, round(avg(reward), 9) AS mean_reward, count(*) AS n FROM rwt GROUP BY contract_id")
register_rw("joined_truth", """SELECT c.contract_id, c.k, CAST(count(v.contract_id) AS BIGINT) AS n_truth,
  coalesce(string_agg(v.swc_id, ',' ORDER BY v.vidx), '') AS truth_classes
  FROM completions c LEFT JOIN vulns v USING (contract_id) GROUP BY c.contract_id, c.k""")
register_rw("filter_verifier", "SELECT contract_id, k, verified FROM ver")
register_rw("pass_rate", """SELECT contract_id, round(pass_rate, 9) AS pass_rate, round(positive_share, 9) AS positive_share,
  n_completions FROM pr""")
register_rw("difficulty_filter", "SELECT contract_id, round(pass_rate, 9) AS pass_rate FROM pr WHERE pass_rate <= 0.625")
register_rw("hard_only", "SELECT contract_id, round(pass_rate, 9) AS pass_rate FROM pr WHERE pass_rate = 0")
register_rw("pass_at_k", """SELECT contract_id, n_completions AS n, n_correct AS c,
  round(1 - (CASE WHEN n_completions - n_correct < 1 THEN 0.0 ELSE list_aggregate(list_transform(range(1), lambda i: (n_completions - n_correct - i) / (n_completions - i)), 'product') END), 9) AS pass_at_1,
  CASE WHEN n_completions < 8 THEN NULL ELSE round(1 - (CASE WHEN n_completions - n_correct < 8 THEN 0.0 ELSE list_aggregate(list_transform(range(8), lambda i: (n_completions - n_correct - i) / (n_completions - i)), 'product') END), 9) END AS pass_at_8,
  CAST(NULL AS DOUBLE) AS pass_at_32
  FROM pr""")
register("self_consistency", """
SELECT contract_id, round(max(cnt) / sum(cnt), 9) AS consistency, count(*) AS n_answers FROM (
  SELECT contract_id, answer, count(*) AS cnt FROM (
    SELECT contract_id, CASE WHEN regexp_extract(text, '(?i)SWC[:\\s]*([0-9]{3})', 1) = '' THEN 'NONE'
           ELSE 'SWC-' || regexp_extract(text, '(?i)SWC[:\\s]*([0-9]{3})', 1) END AS answer
    FROM completions WHERE text <> '') GROUP BY ALL) GROUP BY contract_id""")


# ---------------------------------------------------------------------------
# Training-set construction family
# ---------------------------------------------------------------------------

from vulnsift.schemas import (
    CLASS_PARENTS,  # noqa: E402
    DPO_FALSE_FINDING, INSTRUCTION, NO_VULNERABILITY_OUTPUT, RL_ZERO_PROMPT, SFT_DEFAULTS, SYSTEM_PROMPT, TRACE_PROMPT,
)


def q(text: str) -> str:
    """A SQL string expression equal to `text` (newlines via chr(10))."""
    return "(" + f" || {NL} || ".join("'" + p.replace("'", "''") + "'" for p in text.split("\n")) + ")"


def fill(template: str, **slots: str) -> str:
    out, rest = [], template
    while rest:
        i = rest.find("{")
        if i < 0:
            out.append(q(rest))
            break
        j = rest.index("}", i)
        name = rest[i + 1:j]
        if name in slots:
            if i:
                out.append(q(rest[:i]))
            out.append(slots[name])
        else:
            out.append(q(rest[:j + 1]))
        rest = rest[j + 1:]
    return "(" + " || ".join(out) + ")"


POOL_RANK_SQL = "(CASE source WHEN 'curated' THEN 0 WHEN 'tabular' THEN 1 WHEN 'unlabelled' THEN 2 WHEN 'clean' THEN 3 END)"
FENCE = lambda instr, code: f"({instr} || {NL} || {NL} || '```solidity' || {NL} || {code} || {NL} || '```')"
SFT_INSTR = q(f"{SYSTEM_PROMPT}\n\n{INSTRUCTION}")
D = SFT_DEFAULTS

BUILD_CTES = f"""
sft_blocks AS (
  SELECT contract_id, string_agg('Vulnerability: ' || coalesce(type, '{D['vuln_type']}') || {NL} || 'CWE: ' || coalesce(cwe_id, '{D['cwe_id']}')
    || {NL} || 'SWC: ' || coalesce(swc_id, '{D['swc_id']}') || {NL} || 'Lines: ' || coalesce(lines, line_range, '{D['lines']}')
    || {NL} || 'Severity: ' || coalesce(severity, '{D['severity']}') || {NL} || 'Explanation: ' || coalesce(explanation, description, '{D['explanation']}')
    || {NL} || 'Remediation: ' || coalesce(remediation, '{D['remediation']}'), {NL} || {NL} ORDER BY vidx) AS body
  FROM vulns GROUP BY contract_id
),
dpo_blocks AS (
  SELECT contract_id, count(*) AS nv, string_agg('Vulnerability: ' || coalesce(type, 'Unknown') || {NL} || 'CWE: ' || coalesce(cwe_id, 'CWE-Unknown')
    || {NL} || 'SWC: ' || coalesce(swc_id, 'SWC-Unknown') || {NL} || 'Lines: ' || coalesce(lines, 'Unknown')
    || {NL} || 'Severity: ' || coalesce(severity, 'Medium') || {NL} || 'Explanation: ' || coalesce(explanation, '')
    || {NL} || 'Remediation: ' || coalesce(remediation, ''), {NL} || {NL} ORDER BY vidx) AS body
  FROM vulns GROUP BY contract_id
),
ranked AS (
  SELECT contract_id, source, {POOL_RANK_SQL} AS source_rank,
    row_number() OVER (PARTITION BY source IN ('curated', 'tabular') ORDER BY {POOL_RANK_SQL}, contract_id) AS vrank,
    row_number() OVER (PARTITION BY source ORDER BY contract_id) AS prank
  FROM contracts
),
sft_sel AS (
  SELECT contract_id, source, true AS as_vul FROM ranked WHERE source IN ('curated', 'tabular') AND vrank <= {int(500 * 0.40)}
  UNION ALL
  SELECT contract_id, source, false AS as_vul FROM ranked WHERE source = 'unlabelled' AND prank <= {int(500 * 0.20)}
),
sft_split AS (
  SELECT *, CASE WHEN rank <= floor(n * CAST(0.9 AS DOUBLE)) THEN 'train' ELSE 'validation' END AS split FROM (
    SELECT *, row_number() OVER (ORDER BY md5('42:' || CAST(contract_id AS VARCHAR)), contract_id) AS rank, count(*) OVER () AS n FROM sft_sel)
),
sft_out AS (
  SELECT s.contract_id, s.split, s.rank, s.as_vul, c.source_code,
    {FENCE(SFT_INSTR, 'c.source_code')} AS user_content,
    CASE WHEN s.as_vul AND b.body IS NOT NULL THEN b.body ELSE {q(NO_VULNERABILITY_OUTPUT)} END AS assistant_content,
    CASE WHEN s.as_vul THEN coalesce(d.nv, 0) ELSE 0 END AS num_vulns
  FROM sft_split s JOIN contracts c USING (contract_id) LEFT JOIN sft_blocks b USING (contract_id) LEFT JOIN dpo_blocks d USING (contract_id)
)"""


def register_b(name: str, body: str) -> None:
    register(name, "WITH " + BUILD_CTES.strip() + "\n" + body.strip())


register_b("sft_build", "SELECT contract_id, split, rank, user_content, assistant_content FROM sft_out")
register_b("sft_alpaca", f"""SELECT contract_id, split, {SFT_INSTR} AS instruction, source_code AS input,
  assistant_content AS output, as_vul AS is_vulnerable, CAST(num_vulns AS BIGINT) AS num_vulns FROM sft_out""")
register_b("default_fields", f"""SELECT c.contract_id, b.body AS output FROM contracts c JOIN sft_blocks b USING (contract_id)
  WHERE c.source = 'curated'""")
register_b("chat_records", f"""SELECT c.contract_id, {FENCE(SFT_INSTR, 'c.source_code')} AS user_content,
  CASE WHEN c.source = 'curated' AND b.body IS NOT NULL THEN b.body ELSE {q(NO_VULNERABILITY_OUTPUT)} END AS assistant_content
  FROM contracts c LEFT JOIN sft_blocks b USING (contract_id) WHERE c.source IN ('curated', 'tabular')""")
register_b("class_balance", "SELECT split, as_vul AS is_vulnerable, count(*) AS n FROM sft_out GROUP BY ALL")
register_b("quota_fill", "SELECT contract_id, source, as_vul AS as_vulnerable FROM sft_sel")

FF = DPO_FALSE_FINDING
FALSE_BLOCK = q(f"Vulnerability: {FF['type']}\nCWE: {FF['cwe_id']}\nSWC: {FF['swc_id']}\nLines: {FF['lines']}\n"
                f"Severity: {FF['severity']}\nExplanation: {FF['explanation']}\nRemediation: {FF['remediation']}")


def dpo_sel_sql(n: int | None) -> str:
    cap = f"AND prank <= {n}" if n else ""
    nn = n or 1000
    early = f"CASE WHEN n_vuln >= {n} THEN 0 ELSE " if n else "CASE WHEN false THEN 0 ELSE "
    return f"""
  SELECT contract_id, 'missed' AS pair_kind FROM ranked WHERE source = 'curated' {cap}
  UNION ALL
  SELECT contract_id, 'false_positive' FROM ranked, (SELECT count(*) AS n_vuln FROM ranked WHERE source = 'curated' {cap}) nv,
    (SELECT count(*) AS supply FROM contracts WHERE source = 'unlabelled') sp
  WHERE source = 'unlabelled' AND prank <= least(supply, {early} greatest(1, ceil(CAST({nn} AS DOUBLE) * CAST(0.3 AS DOUBLE) - n_vuln)) END)"""


register_b("dpo_build", f""",
dpo_sel AS ({dpo_sel_sql(200)}),
dpo_split AS (
  SELECT *, CASE WHEN rank <= floor(n * CAST(0.9 AS DOUBLE)) THEN 'train' ELSE 'validation' END AS split FROM (
    SELECT *, row_number() OVER (ORDER BY md5('42:' || CAST(contract_id AS VARCHAR)), contract_id) AS rank, count(*) OVER () AS n FROM dpo_sel))
SELECT s.contract_id, s.split, s.rank, s.pair_kind, {FENCE(q(INSTRUCTION), 'c.source_code')} AS prompt,
  CASE WHEN s.pair_kind = 'missed' THEN b.body ELSE {q(NO_VULNERABILITY_OUTPUT)} END AS chosen,
  CASE WHEN s.pair_kind = 'missed' THEN {q(NO_VULNERABILITY_OUTPUT)} ELSE {FALSE_BLOCK} END AS rejected,
  CAST(CASE WHEN s.pair_kind = 'missed' THEN b.nv ELSE 0 END AS BIGINT) AS correct_vuln_count,
  CAST(CASE WHEN s.pair_kind = 'missed' THEN 0 ELSE 1 END AS BIGINT) AS incorrect_vuln_count
FROM dpo_split s JOIN contracts c USING (contract_id) LEFT JOIN dpo_blocks b USING (contract_id)""".replace("\n,", "", 1)
           .replace("WITH " + BUILD_CTES.strip() + "\n", "", 0))

register_b("dpo_cap", f""",
a AS ({dpo_sel_sql(None)}),
b AS ({dpo_sel_sql(20)})
SELECT 0 AS n_param, pair_kind, count(*) AS n FROM a GROUP BY pair_kind
UNION ALL SELECT 20, pair_kind, count(*) FROM b GROUP BY pair_kind""")

RL_SEL = f"""
rl_sel AS (
  SELECT contract_id, source FROM ranked WHERE source = 'curated' AND prank <= 300
  UNION ALL
  SELECT contract_id, source FROM ranked, (SELECT count(*) AS nl FROM ranked WHERE source = 'curated' AND prank <= 300) x
  WHERE source = 'unlabelled' AND prank <= greatest(300 - nl, 0)
),
rl_sh AS (SELECT *, row_number() OVER (ORDER BY md5('42:' || CAST(contract_id AS VARCHAR)), contract_id) AS rank FROM rl_sel)"""
register_b("rl_prompts", f""", {RL_SEL}
SELECT s.contract_id, s.rank, {FENCE(q(INSTRUCTION), 'c.source_code')} AS prompt, s.source = 'curated' AS has_vulnerability,
  CAST(CASE WHEN s.source = 'curated' THEN (SELECT count(*) FROM vulns v WHERE v.contract_id = s.contract_id) ELSE 0 END AS BIGINT) AS n_truth
FROM rl_sh s JOIN contracts c USING (contract_id) WHERE s.rank <= 300""")
register_b("rl_fill", f""", {RL_SEL}
SELECT contract_id, source = 'curated' AS has_vulnerability FROM rl_sh WHERE rank <= 300""")

register("cpt_budget", """
WITH cand AS (
  SELECT 0 AS source_rank, contract_id AS item_id, 'solidity' AS source, length(source_code) // 4 AS tokens, source_code AS text FROM contracts WHERE source = 'unlabelled'
  UNION ALL SELECT 1, page_id, 'audit_report', length(html) // 4, html FROM pages),
r AS (SELECT *, coalesce(sum(tokens) OVER (ORDER BY source_rank, item_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
        row_number() OVER (ORDER BY source_rank, item_id) AS rank FROM cand)
SELECT source, item_id, CAST(tokens AS BIGINT) AS tokens, CAST(before AS BIGINT) AS tokens_before, rank, text FROM r WHERE before < 500000""")

register("cpt_records", """
SELECT 'solidity' AS source, contract_id AS item_id, '// Source: solidity' || chr(10) || source_code AS text,
  CAST(length('// Source: solidity' || chr(10) || source_code) AS BIGINT) AS length,
  CAST(length('// Source: solidity' || chr(10) || source_code) // 4 AS BIGINT) AS tokens
FROM contracts WHERE source = 'unlabelled'
UNION ALL
SELECT 'audit_report', page_id, html, CAST(length(html) AS BIGINT), CAST(length(html) // 4 AS BIGINT) FROM pages""")

register("split_shuffle", """
SELECT doc_id, rank, CASE WHEN rank <= floor(n * CAST(0.9 AS DOUBLE)) THEN 'train' ELSE 'validation' END AS split FROM (
  SELECT doc_id, row_number() OVER (ORDER BY md5('42:' || CAST(doc_id AS VARCHAR)), doc_id) AS rank, count(*) OVER () AS n FROM documents)""")

register("split_disjoint", """
SELECT split, count(*) AS n, CAST(0 AS BIGINT) AS shared, CAST(0 AS BIGINT) AS missing FROM (
  SELECT CASE WHEN rank <= floor(n * CAST(0.9 AS DOUBLE)) THEN 'train' ELSE 'validation' END AS split FROM (
    SELECT row_number() OVER (ORDER BY md5('7:' || CAST(doc_id AS VARCHAR)), doc_id) AS rank, count(*) OVER () AS n FROM documents))
GROUP BY split""")

register("token_budget", """
WITH d AS (SELECT doc_id, CAST(regexp_extract(source, '(\\d+)$', 1) AS INTEGER) AS src, length(text) // 4 AS tokens FROM documents),
r AS (SELECT *, coalesce(sum(tokens) OVER (ORDER BY src, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d)
SELECT doc_id, CAST(tokens AS BIGINT) AS tokens, CAST(before AS BIGINT) AS tokens_before FROM r WHERE before < 300000""")

register("first_n", "SELECT contract_id, category FROM contracts WHERE source = 'curated' ORDER BY contract_id LIMIT 10")
register("union_limit", f"""SELECT contract_id, source FROM contracts WHERE source IN ('curated', 'tabular', 'unlabelled')
  ORDER BY {POOL_RANK_SQL}, contract_id LIMIT 100""")
register("pool_union", """SELECT c.contract_id, c.source, c.source IN ('curated', 'tabular') AS is_vulnerable,
  CAST((SELECT count(*) FROM vulns v WHERE v.contract_id = c.contract_id) AS BIGINT) AS n_vulns FROM contracts c""")
register("zero_shot_prompts", f"SELECT contract_id, {FENCE(q(INSTRUCTION), 'source_code')} AS prompt FROM contracts")
register("rl_zero_prompts", f"SELECT contract_id, {fill(RL_ZERO_PROMPT, contract_code='source_code')} AS prompt FROM contracts")

VJSON = """('[' || string_agg('{' || concat_ws(', ', '"type": "' || type || '"', '"swc_id": "' || swc_id || '"',
  '"cwe_id": "' || cwe_id || '"', '"lines": "' || lines || '"', '"line_range": "' || line_range || '"',
  '"severity": "' || severity || '"', '"explanation": "' || explanation || '"', '"description": "' || description || '"',
  '"remediation": "' || remediation || '"') || '}', ', ' ORDER BY vidx) || ']')"""
register("trace_prompts", f"""
WITH j AS (SELECT contract_id, {VJSON} AS gt FROM vulns GROUP BY contract_id)
SELECT c.contract_id, CAST(t.i AS INTEGER) AS trace_id, {fill(TRACE_PROMPT, contract_code='c.source_code', ground_truth='j.gt')} AS prompt
FROM contracts c JOIN j USING (contract_id), range(2) t(i) WHERE c.source = 'curated'""")

register("trace_build", f"""
SELECT p.contract_id, p.k AS trace_id, {q(INSTRUCTION)} AS instruction, p.text AS output, c.source, c.file_path
FROM completions p JOIN contracts c USING (contract_id) WHERE contains(p.text, '<think>')""")

DELTA = """
WITH s AS (SELECT contract_id, text AS chosen FROM completions WHERE model = 'strong'),
w AS (SELECT contract_id, text AS rejected FROM completions WHERE model = 'weak'),
p AS (SELECT s.contract_id, chosen, rejected, len(regexp_extract_all(chosen, '\\S+')) AS words_chosen,
        len(regexp_extract_all(rejected, '\\S+')) AS words_rejected
      FROM s JOIN w USING (contract_id) JOIN contracts c USING (contract_id)
      WHERE chosen <> '' AND rejected <> '' AND length(c.source_code) > 0)"""
register("delta_pairs", DELTA + """
SELECT contract_id, chosen, rejected, CAST(words_chosen AS BIGINT) AS words_chosen, CAST(words_rejected AS BIGINT) AS words_rejected
FROM p WHERE abs(words_chosen - words_rejected) <= 100""")
register("delta_signed", DELTA + """
SELECT contract_id, CAST(words_chosen AS BIGINT) AS words_chosen, CAST(words_rejected AS BIGINT) AS words_rejected
FROM p WHERE length(chosen) // 4 - length(rejected) // 4 <= 10""")

register("truncate_text", "SELECT doc_id, substr(text, 1, 2048) AS text, CAST(length(substr(text, 1, 2048)) AS BIGINT) AS length FROM documents")

register_rw("rl_format", """SELECT contract_id, k, text AS response, round(reward, 9) AS reward,
  count(*) OVER (PARTITION BY contract_id) AS num_responses FROM rwt""")

register("mixture_sample", f"""
WITH q AS (SELECT * FROM (VALUES ('labeled_vulns', 'curated'), ('labeled_vulns', 'tabular'), ('clean_contracts', 'unlabelled'),
   ('clean_contracts', 'clean')) t(component, source)),
m AS (SELECT * FROM (VALUES ('labeled_vulns', 0.40), ('synthetic_vulns', 0.25), ('clean_contracts', 0.20),
   ('general_instructions', 0.10), ('security_docs', 0.05)) t(component, ratio)),
r AS (SELECT q.component, c.contract_id, floor(CAST(400 AS DOUBLE) * CAST(m.ratio AS DOUBLE)) AS quota,
        row_number() OVER (PARTITION BY q.component ORDER BY {POOL_RANK_SQL.replace('source', 'c.source')}, c.contract_id) AS rank
      FROM contracts c JOIN q ON c.source = q.source JOIN m ON m.component = q.component)
SELECT component, contract_id, rank FROM r WHERE rank <= quota""")

register("size_sweep", """
WITH r AS (SELECT doc_id, length(text) // 4 AS tokens, row_number() OVER (ORDER BY md5('42:' || CAST(doc_id AS VARCHAR)), doc_id) AS rank FROM documents),
s AS (SELECT * FROM (VALUES (500), (1000), (1500), (2000)) t(size))
SELECT s.size, count(*) AS n, CAST(sum(tokens) AS BIGINT) AS tokens FROM r JOIN s ON r.rank <= s.size GROUP BY s.size""")

register("sweep_grid", """
WITH q AS (SELECT * FROM (VALUES ('labeled_vulns', 'curated'), ('labeled_vulns', 'tabular'), ('clean_contracts', 'unlabelled'),
   ('clean_contracts', 'clean')) t(component, source)),
pc AS (SELECT q.component, count(*) AS rows, CAST(sum(length(c.source_code) // 4) AS BIGINT) AS tokens
       FROM contracts c JOIN q ON c.source = q.source GROUP BY q.component),
lr AS (SELECT * FROM (VALUES (1e-5), (5e-5), (1e-4), (5e-4)) t(learning_rate))
SELECT pc.component, CAST(lr.learning_rate AS DOUBLE) AS learning_rate, CAST(pc.rows AS BIGINT) AS rows, pc.tokens FROM pc, lr""")


# ---------------------------------------------------------------------------
# Filters, decontamination, conversations
# ---------------------------------------------------------------------------

NGRAM_RATIO = """(CASE WHEN len({w}) >= 3 THEN
  1.0 - len(list_distinct(list_transform(range(1, len({w}) - 1), lambda i: array_to_string({w}[i:i + 2], ' '))))
      / (len({w}) - 2) ELSE 0.0 END)"""
COMPLETE = """(contains({t}, '<think>') AND contains({t}, '</think>') AND regexp_matches({t}, '(?i)SWC[:\\s-]*\\d{{3}}')
  AND regexp_matches({t}, '(?i)Lines?[:\\s]*\\d+'))"""
WORDS = "regexp_extract_all(text, '\\S+')"


def ratio(w):
    return NGRAM_RATIO.format(w=w)


register("trace_accept", "SELECT contract_id, k FROM completions WHERE contains(text, '<think>')")
register("trace_quality", f"""
SELECT contract_id, k, {COMPLETE.format(t='text')} AS complete, round(r, 9) AS repeat_ratio,
  CAST(length(text) // 4 AS BIGINT) AS tokens,
  {COMPLETE.format(t='text')} AND r <= 0.30 AND length(text) // 4 BETWEEN 500 AND 32000 AS all_pass
FROM (SELECT *, {ratio('w')} AS r FROM (SELECT *, {WORDS} AS w FROM completions))""")
register("quality_steps", f"""
SELECT doc_id, {COMPLETE.format(t='text')} AS complete, round(r, 9) AS repeat_ratio, CAST(length(text) // 4 AS BIGINT) AS tokens,
  r <= 0.30 AS repetition_ok, length(text) // 4 BETWEEN 500 AND 32000 AS length_ok
FROM (SELECT *, {ratio('w')} AS r FROM (SELECT *, {WORDS} AS w FROM documents))""")
register("repetition", f"""
SELECT doc_id, round(r, 9) AS repeat_ratio, r <= 0.30 AS kept FROM (
  SELECT doc_id, {ratio('w')} AS r FROM (SELECT doc_id, {WORDS} AS w FROM documents))""")
register("strip_think", """
SELECT contract_id, k, regexp_replace(regexp_replace(text, '(?s)<think>.*?</think>', '', 'g'), '^\\s+|\\s+$', '', 'g') AS answer
FROM completions WHERE contains(text, '<think>')""")
register("concise_filter", "SELECT doc_id, CAST(length(text) // 4 AS BIGINT) AS tokens FROM documents WHERE length(text) // 4 <= 512")
register("confidence_filter", "SELECT contract_id, k, block, swc_id, round(confidence, 9) AS confidence FROM findings WHERE confidence >= 0.5")

DECON = """
WITH dw AS (SELECT doc_id, regexp_extract_all(lower(text), '\\S+') AS w FROM documents),
dg AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 12], ' ') AS g FROM (
        SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM dw WHERE len(w) >= 13)),
bw AS (SELECT regexp_extract_all(lower(text), '\\S+') AS w FROM benchmark),
bg AS (SELECT DISTINCT array_to_string(w[i:i + 12], ' ') AS g FROM (SELECT w, unnest(range(1, len(w) - 11)) AS i FROM bw WHERE len(w) >= 13)),
norm_b AS (SELECT DISTINCT regexp_replace(regexp_replace(lower(text), '\\s+', ' ', 'g'), '^\\s+|\\s+$', '', 'g') AS nt FROM benchmark),
hit AS (SELECT DISTINCT doc_id FROM dg JOIN bg USING (g)
        UNION SELECT doc_id FROM documents WHERE regexp_replace(regexp_replace(lower(text), '\\s+', ' ', 'g'), '^\\s+|\\s+$', '', 'g') IN (SELECT nt FROM norm_b))"""
register("decontaminate", DECON + "\nSELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM hit)")
register("contaminated", DECON + "\nSELECT doc_id FROM hit")

register("instruct_set", """
SELECT contract_id, k, answer FROM (
  SELECT contract_id, k, regexp_replace(regexp_replace(text, '(?s)<think>.*?</think>', '', 'g'), '^\\s+|\\s+$', '', 'g') AS answer
  FROM completions WHERE contains(text, '<think>'))
WHERE answer <> '' AND length(answer) // 4 <= 512""")

TURN = f"""(CASE role WHEN 'system' THEN '<|system|>' || {NL} || text || {NL} WHEN 'user' THEN '<|user|>' || {NL} || text || {NL}
  WHEN 'assistant' THEN '<|assistant|>' || {NL} || text || {NL} END)"""
register("chat_render", f"""
SELECT conv_id, string_agg({TURN}, '' ORDER BY turn) || '<|assistant|>' || {NL} AS rendered, count({TURN}) AS n_turns
FROM conversations GROUP BY conv_id""")
register("multi_turn_pref", f"""
WITH l AS (SELECT conv_id, max(turn) AS turn, arg_max(text, turn) AS chosen FROM conversations WHERE role = 'assistant' GROUP BY conv_id),
x AS (SELECT t.conv_id, string_agg({TURN.replace('role', 't.role').replace('text', 't.text')}, '' ORDER BY t.turn) AS context
      FROM conversations t JOIN l USING (conv_id) WHERE t.turn < l.turn GROUP BY t.conv_id)
SELECT l.conv_id, l.turn AS answer_turn, x.context, l.chosen, substr(l.chosen, 1, CAST(floor(length(l.chosen) / 3) AS INTEGER)) AS rejected
FROM l JOIN x USING (conv_id)""")
register_b("tool_call_record", f"""
SELECT c.contract_id, {FENCE(q(INSTRUCTION), 'c.source_code')} AS turn0,
  '<tool_call>{{"name": "static_analyzer", "arguments": {{"contract_id": ' || CAST(c.contract_id AS VARCHAR) || '}}}}</tool_call>' AS turn1,
  'findings: ' || (SELECT string_agg(swc_id, ', ' ORDER BY vidx) FROM vulns v WHERE v.contract_id = c.contract_id) AS turn2,
  b.body AS turn3
FROM contracts c JOIN sft_blocks b USING (contract_id) WHERE c.source = 'curated'""")


# ---------------------------------------------------------------------------
# Runs, trajectories, comparisons, reports
# ---------------------------------------------------------------------------

RUN_CTES = f"""
runs AS (
  SELECT event_type AS experiment, list_extract({sql_list(EXPERIMENT_STAGES)}, CAST(event_id % 3 AS INTEGER) + 1) AS stage,
    CAST(day(ts) AS INTEGER) AS step, event_id AS run_row, (value % 50) / 100 AS precision, (value % 70) / 100 AS recall,
    (value % 60) / 100 AS f1, value * 10 AS mean_length, value * 3 + 20 AS latency_ms, ts
  FROM events
),
log AS (
  SELECT experiment, stage, step, avg(precision) AS precision, avg(recall) AS recall, avg(f1) AS f1,
    avg(mean_length) AS mean_length, avg(latency_ms) AS latency_ms, count(*) AS n_rows
  FROM runs GROUP BY experiment, stage, step
),
prio AS (SELECT *, CASE stage WHEN 'rlvr' THEN 0 WHEN 'dpo' THEN 1 WHEN 'sft' THEN 2 ELSE 3 END AS p FROM log),
best AS (SELECT experiment, arg_min(stage, p) AS best_stage FROM prio GROUP BY experiment),
fin AS (SELECT experiment, stage, max(step) AS final_step, arg_max(precision, step) AS precision, arg_max(recall, step) AS recall,
          arg_max(f1, step) AS f1 FROM log GROUP BY experiment, stage),
cmp AS (SELECT f.experiment, b.best_stage, f.f1, f.precision, f.recall FROM fin f JOIN best b ON f.experiment = b.experiment AND f.stage = b.best_stage),
traj AS (
  SELECT user_id AS prompt_id, event_id AS traj_id, event_id % 7 <> 0 AS compiled, event_id % 3 = 0 AS fixed,
    CAST(event_id % 4 AS INTEGER) AS new_findings, CAST(CASE WHEN event_id % 5 = 0 THEN 1 ELSE 0 END AS INTEGER) AS tool_errors,
    CAST((event_id // 10) % 3 AS INTEGER) AS format_violations
  FROM events
),
tscore AS (SELECT *, CAST(compiled AS DOUBLE) + CAST(fixed AS DOUBLE) - 0.5 * (new_findings + tool_errors + format_violations) AS score FROM traj),
bw AS (SELECT prompt_id, arg_max(traj_id, (score, -traj_id)) AS best_id, max(score) AS best_score,
         arg_min(traj_id, (score, traj_id)) AS worst_id, min(score) AS worst_score, count(*) AS n FROM tscore GROUP BY prompt_id)"""


def register_r(name: str, body: str) -> None:
    register(name, "WITH " + RUN_CTES.strip() + "\n" + body.strip())


register_r("run_compare", "SELECT experiment, best_stage, round(f1, 9) AS f1, round(precision, 9) AS precision, round(recall, 9) AS recall FROM cmp")
register_r("best_stage", "SELECT experiment, best_stage FROM best")
register_r("variant_compare", """SELECT experiment, best_stage, round(f1, 9) AS f1, round(precision, 9) AS precision, round(recall, 9) AS recall,
  round(f1 - (SELECT f1 FROM cmp WHERE experiment = 'view'), 9) AS delta_f1,
  round(precision - (SELECT precision FROM cmp WHERE experiment = 'view'), 9) AS delta_precision,
  round(recall - (SELECT recall FROM cmp WHERE experiment = 'view'), 9) AS delta_recall FROM cmp""")
register_r("run_summary", """SELECT stage, count(*) AS total, count(*) FILTER (WHERE f1 >= 0.20) AS successful,
  count(*) FILTER (WHERE f1 < 0.20) AS failed FROM log GROUP BY stage""")
register_r("early_stop", """, x AS (
  SELECT *, max(f1) OVER (PARTITION BY experiment, stage ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_max FROM log),
y AS (SELECT *, prev_max IS NULL OR f1 > prev_max AS improved FROM x),
z AS (SELECT *, max(CASE WHEN improved THEN step END) OVER (PARTITION BY experiment, stage ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS li FROM y),
w AS (SELECT *, sum(CASE WHEN improved THEN 0 ELSE 1 END) OVER (PARTITION BY experiment, stage, li ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS since FROM z)
SELECT experiment, stage, min(step) AS stop_step FROM w WHERE since >= 3 GROUP BY experiment, stage""")
register_r("length_explosion", """, s AS (SELECT experiment, stage, arg_min(mean_length, step) AS start_length FROM log GROUP BY ALL)
SELECT l.experiment, l.stage, l.step, round(l.mean_length, 9) AS mean_length, round(s.start_length, 9) AS start_length
FROM log l JOIN s USING (experiment, stage) WHERE l.mean_length > 1.5 * s.start_length""")
register_r("stage_gain", """, g AS (SELECT experiment, stage, f1, f1 - lag(f1) OVER (PARTITION BY experiment ORDER BY
    -(CASE stage WHEN 'rlvr' THEN 0 WHEN 'dpo' THEN 1 WHEN 'sft' THEN 2 ELSE 3 END)) AS gain FROM fin)
SELECT experiment, stage, round(f1, 9) AS f1, round(gain, 9) AS gain, gain > 0.02 AS meets_gain FROM g""")
register_r("top_checkpoints", """SELECT experiment, stage, step, round(f1, 9) AS f1, pos FROM (
  SELECT *, row_number() OVER (PARTITION BY experiment, stage ORDER BY f1 DESC, step ASC) AS pos FROM log) WHERE pos <= 3""")
register_r("run_variance", """SELECT r.experiment, round(r.v, 9) AS var_rows, round(f.v, 9) AS var_final FROM
  (SELECT experiment, var_samp(f1) AS v FROM runs GROUP BY experiment) r JOIN (SELECT experiment, var_samp(f1) AS v FROM fin GROUP BY experiment) f USING (experiment)""")
register_r("steps_to_target", """, x AS (SELECT *, coalesce(sum(n_rows) OVER (PARTITION BY experiment, stage ORDER BY step
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rows_before FROM log)
SELECT experiment, stage, min(step) AS first_step, CAST(arg_min(rows_before, step) AS BIGINT) AS examples_before FROM x WHERE f1 >= 0.30 GROUP BY ALL""")
register_r("latency", """SELECT experiment, round(min(latency_ms), 9) AS min_ms, round(avg(latency_ms), 9) AS mean_ms, round(max(latency_ms), 9) AS max_ms,
  round(quantile_disc(latency_ms, 0.5), 9) AS p50_ms, round(quantile_disc(latency_ms, 0.9), 9) AS p90_ms FROM runs GROUP BY experiment""")
register_r("trajectory_pairs", "SELECT prompt_id, best_id, round(best_score, 9) AS best_score, worst_id, round(worst_score, 9) AS worst_score, n FROM bw")
register_r("trajectory_set", """SELECT prompt_id, best_id AS chosen_id, worst_id AS rejected_id, round(best_score - worst_score, 9) AS margin
  FROM bw WHERE best_score > worst_score""")
PAIRED = """pool AS (SELECT prompt_id, traj_id, compiled AND fixed AND new_findings = 0 AS good,
    CASE WHEN NOT compiled THEN 'compile_failure' WHEN new_findings > 0 THEN 'new_findings' ELSE 'wrong_vulnerability' END AS reason FROM traj),
nth AS (SELECT *, row_number() OVER (PARTITION BY prompt_id, good ORDER BY traj_id) AS i FROM pool),
paired AS (SELECT c.prompt_id, c.i, c.traj_id AS chosen_id, r.traj_id AS rejected_id, r.reason FROM nth c JOIN nth r
  ON c.prompt_id = r.prompt_id AND c.i = r.i WHERE c.good AND NOT r.good)"""
register_r("outcome_pairs", f""", {PAIRED}
SELECT prompt_id, i, chosen_id, rejected_id, reason FROM paired""")
register_r("test_reward", """SELECT traj_id, round(CASE WHEN NOT compiled THEN -1.0 WHEN 4 - new_findings = 4 THEN 1.0
  ELSE (4 - new_findings) / 4.0 * 2 - 1 END, 9) AS reward FROM traj""")
register("judge_scale", "SELECT event_id, round((floor(value) % 10) / 10 * 2 - 1, 9) AS scaled FROM events")
register("judge_mean", "SELECT user_id, round(avg(floor(value) % 10), 9) AS mean_score FROM events GROUP BY user_id")
register_r("tool_success", "SELECT prompt_id, round(avg(CASE WHEN tool_errors = 0 THEN 1.0 ELSE 0.0 END), 9) AS success_rate FROM traj GROUP BY prompt_id")

register_r("sweep_best", f""", s AS (SELECT experiment, list_extract([1e-5, 5e-5, 1e-4, 5e-4], step % 4 + 1) AS learning_rate, avg(f1) AS f1 FROM runs GROUP BY ALL)
SELECT experiment, CAST(arg_max(learning_rate, (f1, -learning_rate)) AS DOUBLE) AS best_learning_rate, round(max(f1), 9) AS best_f1 FROM s GROUP BY experiment""")

register("holdout", """SELECT item_id, CASE WHEN rank <= floor(n * CAST(0.5 AS DOUBLE)) THEN 'dev' ELSE 'test' END AS split FROM (
  SELECT item_id, row_number() OVER (ORDER BY md5('11:' || CAST(item_id AS VARCHAR)), item_id) AS rank, count(*) OVER () AS n FROM benchmark)""")
register_rw("active_batch", """, a AS (SELECT DISTINCT contract_id FROM adv WHERE max_r <> min_r)
SELECT contract_id, rank FROM (SELECT contract_id, row_number() OVER (ORDER BY md5('3:' || CAST(contract_id AS VARCHAR)), contract_id) AS rank FROM a)
WHERE rank <= 64""")

register("eval_report", f"""WITH {matched().strip()},{rates_sql('scored').strip()},
g AS (SELECT * FROM (VALUES ('day_25', '360M', 0.20), ('day_40', '1.5B', 0.35), ('day_55', '3B', 0.45)) t(checkpoint, model, min_f1))
SELECT k, round(f1, 9) AS f1, checkpoint, model, CAST(min_f1 AS DOUBLE) AS min_f1, f1 >= min_f1 AS passed FROM metrics, g""")
register("report_lines", f"""WITH {matched().strip()},{rates_sql('scored').strip()},
targets AS (SELECT * FROM (VALUES ('precision', 0.35, true, 'Precision:'), ('recall', 0.70, true, 'Recall:'),
   ('f1', 0.45, true, 'F1 Score:'), ('false_positive_rate', 0.65, false, 'False Positive Rate:')) t(metric, target, higher_better, label)),
long AS (SELECT k, 'precision' AS metric, precision AS value FROM metrics UNION ALL SELECT k, 'recall', recall FROM metrics
  UNION ALL SELECT k, 'f1', f1 FROM metrics UNION ALL SELECT k, 'false_positive_rate', false_positive_rate FROM metrics)
SELECT k, metric, printf('  %-20s %6.1f%% (target: %5.1f%%) [%s]', label, value * 100, CAST(target AS DOUBLE) * 100,
  CASE WHEN (higher_better AND value >= target) OR (NOT higher_better AND value <= target) THEN 'PASS' ELSE 'FAIL' END) AS line
FROM long JOIN targets USING (metric)""")
register("class_hits", """
SELECT u.contract_id, u.k, v.swc_id, EXISTS (SELECT 1 FROM findings f WHERE f.contract_id = u.contract_id AND f.k = u.k AND f.swc_id = v.swc_id) AS hit,
  count(*) AS n
FROM units u JOIN vulns v ON u.contract_id = v.contract_id GROUP BY ALL""")
register("ordered_report", """
SELECT swc_id, tp, fn, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END, 9) AS recall, row_number() OVER (ORDER BY swc_id) AS position FROM (
  SELECT v.swc_id,
    count(*) FILTER (WHERE EXISTS (SELECT 1 FROM findings f WHERE f.contract_id = u.contract_id AND f.k = u.k AND f.swc_id = v.swc_id)) AS tp,
    count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM findings f WHERE f.contract_id = u.contract_id AND f.k = u.k AND f.swc_id = v.swc_id)) AS fn
  FROM units u JOIN vulns v ON u.contract_id = v.contract_id WHERE u.k = 0 GROUP BY v.swc_id)""")

register_rw("spec_reward", f""", v0 AS (SELECT contract_id, swc_id AS t_swc, coalesce(lines, line_range) AS t_lines, severity AS t_sev FROM vulns WHERE vidx = 0),
sp AS (SELECT c.contract_id, c.k, c.text, v0.t_swc, v0.t_lines, v0.t_sev,
   CASE WHEN regexp_extract(c.text, 'SWC[:\\s]*([0-9]{{3}})', 1) <> '' THEN 'SWC-' || regexp_extract(c.text, 'SWC[:\\s]*([0-9]{{3}})', 1)
        WHEN regexp_extract(c.text, 'SWC-([0-9]{{3}})', 1) <> '' THEN 'SWC-' || regexp_extract(c.text, 'SWC-([0-9]{{3}})', 1)
        WHEN regexp_extract(c.text, 'swc[:\\s]*([0-9]{{3}})', 1) <> '' THEN 'SWC-' || regexp_extract(c.text, 'swc[:\\s]*([0-9]{{3}})', 1) END AS got,
   nullif(regexp_extract(c.text, '(?i)Severity[:\\s]*(\\w+)', 1), '') AS sev_got
  FROM completions c LEFT JOIN v0 USING (contract_id)),
tb0 AS (SELECT contract_id,
    CASE WHEN contains(t_lines, '-') THEN (CASE WHEN len(string_split(t_lines, '-')) = 2 THEN TRY_CAST(trim(string_split(t_lines, '-')[1]) AS BIGINT) END)
         ELSE TRY_CAST(trim(t_lines) AS BIGINT) END AS s,
    CASE WHEN contains(t_lines, '-') THEN (CASE WHEN len(string_split(t_lines, '-')) = 2 THEN TRY_CAST(trim(string_split(t_lines, '-')[2]) AS BIGINT) END)
         ELSE TRY_CAST(trim(t_lines) AS BIGINT) END AS e
  FROM (SELECT DISTINCT contract_id, t_lines FROM sp WHERE t_lines IS NOT NULL)),
tl0 AS (SELECT DISTINCT contract_id, unnest(generate_series(s, e)) AS line FROM tb0 WHERE s IS NOT NULL AND e IS NOT NULL),
li AS (SELECT c.contract_id, c.k,
    (SELECT count(*) FROM pl WHERE pl.contract_id = c.contract_id AND pl.k = c.k) AS np,
    (SELECT count(*) FROM tl0 WHERE tl0.contract_id = c.contract_id) AS nt,
    (SELECT count(*) FROM pl JOIN tl0 ON pl.contract_id = tl0.contract_id AND pl.line = tl0.line WHERE pl.contract_id = c.contract_id AND pl.k = c.k) AS ni,
    len(regexp_extract_all(c.text, '{PRED_LINES}', 1)) AS nm,
    (SELECT count(*) FROM tb0 WHERE tb0.contract_id = c.contract_id AND s IS NOT NULL AND e IS NOT NULL) AS ntr
  FROM completions c),
parts AS (SELECT sp.contract_id, sp.k,
    CASE WHEN got IS NOT DISTINCT FROM t_swc THEN 1.0 ELSE -1.0 END AS p_cls,
    CASE WHEN li.nm > 0 AND li.ntr > 0 THEN (CASE WHEN li.np = 0 OR li.nt = 0 THEN 0.0 ELSE li.ni / (li.np + li.nt - li.ni) END) * 2 - 1 END AS p_line,
    CASE WHEN sev_got IS NOT DISTINCT FROM t_sev THEN 0.5 ELSE -0.25 END AS p_sev,
    CASE WHEN t_swc IS NULL THEN (CASE WHEN got IS NULL OR got = 'None' THEN 0.5 ELSE -1.0 END) END AS p_clean
  FROM sp JOIN li USING (contract_id, k))
SELECT contract_id, k, round((p_cls + coalesce(p_line, 0) + p_sev + coalesce(p_clean, 0))
   / (2 + CASE WHEN p_line IS NULL THEN 0 ELSE 1 END + CASE WHEN p_clean IS NULL THEN 0 ELSE 1 END), 9) AS reward FROM parts""")

register_rw("tokens_per_hit", f""", {matched().strip()},
tk AS (SELECT s.k, sum(length(c.text) // 4) AS tokens, sum(s.tp) AS tp FROM scored s JOIN completions c USING (contract_id, k) GROUP BY s.k)
SELECT k, CAST(tokens AS BIGINT) AS tokens, CAST(tp AS BIGINT) AS tp, round(CASE WHEN tp > 0 THEN tokens / tp ELSE 0.0 END, 9) AS tokens_per_hit FROM tk""")
register("trace_length", """SELECT model, round(avg(length(text) // 4), 9) AS mean_tokens, count(*) AS n FROM completions
  WHERE contains(text, '<think>') GROUP BY model""")
register("length_buckets", """SELECT contract_id, k, CAST(length(text) // 4 AS BIGINT) AS tokens,
  CAST(ntile(3) OVER (ORDER BY length(text) // 4, contract_id * 8 + k) AS INTEGER) AS bucket FROM completions""")
register("quality_gate", f"""
SELECT model, round(avg(CASE WHEN ok THEN 1.0 ELSE 0.0 END), 9) AS pass_share, avg(CASE WHEN ok THEN 1.0 ELSE 0.0 END) > 0.90 AS gate_passed FROM (
  SELECT model, {COMPLETE.format(t='text')} AND {ratio('w')} <= 0.30 AND length(text) // 4 BETWEEN 500 AND 32000 AS ok
  FROM (SELECT *, {WORDS} AS w FROM completions)) GROUP BY model""")
register_rw("concise_pairs", """, ok AS (SELECT contract_id, k, length(text) // 4 AS tokens FROM ver WHERE verified = 1.0)
SELECT contract_id, arg_min(k, (tokens, k)) AS chosen_k, arg_max(k, (tokens, -k)) AS rejected_k, count(*) AS n_correct
FROM ok GROUP BY contract_id HAVING count(*) >= 2""")
register_rw("rl_zero_set", f"""SELECT c.contract_id, {fill(RL_ZERO_PROMPT, contract_code='c.source_code')} AS prompt
FROM contracts c WHERE c.contract_id IN (SELECT contract_id FROM pr WHERE pass_rate = 0)""")
register("data_ablation", """
WITH sup AS (SELECT (SELECT count(*) FROM completions WHERE contains(text, '<think>')) AS n_synth,
                    (SELECT count(*) FROM contracts WHERE source IN ('curated', 'tabular')) AS n_lab),
sh AS (SELECT * FROM (VALUES (0.0), (0.25), (0.5), (0.75)) t(s))
SELECT CAST(s AS DOUBLE) AS synthetic_share, CAST(least(floor(200.0 * s), n_synth) AS BIGINT) AS synthetic_rows,
  CAST(least(200 - floor(200.0 * s), n_lab) AS BIGINT) AS labelled_rows FROM sup, sh""")

register("instruct_dpo", f"""WITH {REWARD_CTES.strip()},
{RUN_CTES.strip()},
think AS (SELECT s.contract_id FROM completions s JOIN completions w ON s.contract_id = w.contract_id JOIN contracts c ON c.contract_id = s.contract_id
  WHERE s.model = 'strong' AND w.model = 'weak' AND s.text <> '' AND w.text <> '' AND length(c.source_code) > 0
    AND length(s.text) // 4 - length(w.text) // 4 <= 100),
{PAIRED},
tool AS (SELECT prompt_id FROM paired),
conc AS (SELECT contract_id FROM ver WHERE verified = 1.0 GROUP BY contract_id HAVING count(*) >= 2)
SELECT * FROM (SELECT 'think' AS kind, count(*) AS n FROM think UNION ALL SELECT 'tool_use', count(*) FROM tool
UNION ALL SELECT 'concise', count(*) FROM conc) WHERE n > 0""")

register_b("variant_sets", f""",
dpo_sel AS ({dpo_sel_sql(200)}),
dpo_n AS (SELECT count(*) AS n FROM dpo_sel),
rl_sel AS (
  SELECT contract_id FROM ranked WHERE source = 'curated' AND prank <= 300
  UNION ALL
  SELECT contract_id FROM ranked, (SELECT count(*) AS nl FROM ranked WHERE source = 'curated' AND prank <= 300) x
  WHERE source = 'unlabelled' AND prank <= greatest(300 - nl, 0)),
sets AS (
  SELECT 'sft' AS kind, split, count(*) AS n FROM sft_out GROUP BY split
  UNION ALL SELECT 'dpo', 'train', CAST(floor(n * CAST(0.9 AS DOUBLE)) AS BIGINT) FROM dpo_n
  UNION ALL SELECT 'dpo', 'validation', n - CAST(floor(n * CAST(0.9 AS DOUBLE)) AS BIGINT) FROM dpo_n
  UNION ALL SELECT 'rl', 'all', least(count(*), 300) FROM rl_sel),
v AS (SELECT * FROM (VALUES ('THINK'), ('INSTRUCT'), ('RL-ZERO')) t(variant))
SELECT variant, kind, split, n FROM v, sets WHERE n > 0 AND NOT (variant = 'RL-ZERO' AND kind = 'sft')""")


# ---------------------------------------------------------------------------
# Sources, sinks, catalogue
# ---------------------------------------------------------------------------

register("source_counts", """
WITH names AS (SELECT * FROM (VALUES ('curated'), ('tabular'), ('unlabelled'), ('clean'), ('exploits'), ('reports')) t(source))
SELECT n.source, coalesce(c.n_rows, 0) AS n_rows FROM names n LEFT JOIN (SELECT source, count(*) AS n_rows FROM contracts GROUP BY source) c USING (source)""")
register("side_file_join", """
SELECT CAST(doc_id AS VARCHAR) AS address,
  CASE WHEN doc_id % 3 <> 0 THEN '// file' || chr(10) || text ELSE coalesce(text, '') END AS source_code,
  'side/' || CAST(doc_id AS VARCHAR) || '.sol' AS file_path FROM documents""")
register("path_parts", """
SELECT doc_id, path, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE CAST(2018 + doc_id % 6 AS VARCHAR) END AS year,
  'case_' || CAST(doc_id AS VARCHAR) || '.t' AS stem FROM (
  SELECT doc_id, 'exploits/src/test/' || CASE WHEN doc_id % 4 = 0 THEN 'misc' ELSE CAST(2018 + doc_id % 6 AS VARCHAR) END
    || '/' || lang || '/case_' || CAST(doc_id AS VARCHAR) || '.t.sol' AS path FROM documents)""")
register_b("dataset_roundtrip", "SELECT contract_id, assistant_content AS output, as_vul AS is_vulnerable FROM sft_out WHERE split = 'train'")


# ---------------------------------------------------------------------------
# Streaming (batch equivalents)
# ---------------------------------------------------------------------------

register("stream_append", "SELECT DISTINCT contract_id, k FROM completions WHERE contains(text, '<think>')")
register("stream_monitor", """
SELECT strftime(ws, '%Y-%m-%d %H:%M:%S') AS window_start, event_type, round(avg(value), 9) AS mean_value, count(*) AS n FROM (
  SELECT time_bucket(INTERVAL 1 DAY, ts) AS ws, event_type, value FROM events)
WHERE ws + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 2 DAY
GROUP BY ALL""")

register("user_hooks", """
WITH g AS (SELECT contract_id, 'Vulnerability: demo' || chr(10) || 'SWC: ' || CAST(100 + contract_id % 30 AS VARCHAR) || chr(10)
             || 'Lines: ' || CAST(contract_id % 40 + 1 AS VARCHAR) || chr(10) || chr(10) || 'SWC: ' || CAST(100 + contract_id % 7 AS VARCHAR) AS text
           FROM contracts WHERE source = 'curated'),
gt AS (SELECT contract_id, list(replace(swc_id, 'SWC-', '')) AS gt FROM vulns GROUP BY contract_id),
r AS (SELECT g.contract_id, g.text, ['' || (100 + g.contract_id % 30), '' || (100 + g.contract_id % 7)] AS model, gt.gt FROM g JOIN gt USING (contract_id)),
cr AS (SELECT contract_id, text, CASE WHEN len(list_filter(model, lambda x: list_contains(gt, x))) > 0
          THEN len(list_filter(model, lambda x: list_contains(gt, x))) / greatest(len(gt), len(model)) ELSE -0.5 END AS base FROM r)
SELECT contract_id, CAST(len(regexp_extract_all(text, '\\S+')) AS BIGINT) AS n_tokens,
  round(0.5 * base + 0.5 * (CASE WHEN base > 0 THEN 1.0 ELSE 0.0 END), 9) AS reward, CAST(2 AS BIGINT) AS n_findings FROM cr""")

register_rw("rl_filter_set", f"""SELECT p.contract_id, {FENCE(q(INSTRUCTION), 'c.source_code')} AS prompt, round(p.pass_rate, 9) AS pass_rate,
  CAST((SELECT count(*) FROM vulns v WHERE v.contract_id = p.contract_id) AS BIGINT) AS n_truth
FROM pr p JOIN contracts c USING (contract_id) WHERE p.pass_rate <= 0.625""")
register("severity_match", """
SELECT f.contract_id, f.k, f.block, v.vidx AS truth_row, f.swc_id, f.severity AS predicted, v.severity AS truth, f.severity = v.severity AS match
FROM findings f JOIN vulns v ON f.contract_id = v.contract_id AND f.swc_id = coalesce(v.swc_id, 'SWC-000')""")

# Files staged from the tables: what each loader must give. Files without bytes are not listed by Spark.
STAGED = """staged AS (
  SELECT 'smartbugs' AS source, 0 AS source_rank, 'curated/' || file_path AS contract_id, source_code AS code, NULL AS year, 1 AS num_vulns
  FROM contracts WHERE source = 'curated' AND length(source_code) > 0
  UNION ALL SELECT 'kaggle_tdm', 1, 'tranduongminhdai/' || CAST(contract_id AS VARCHAR), source_code, NULL, 0 FROM contracts WHERE source = 'tabular'
  UNION ALL SELECT 'kaggle_bccc_vuln', 2, 'bccc/Vulnerable_SourceCodes/' || CAST(contract_id AS VARCHAR) || '.sol',
    CASE WHEN contract_id % 3 <> 0 AND length(source_code) > 0 THEN source_code ELSE 'csv code' END, NULL, 0 FROM contracts WHERE source = 'tabular'
  UNION ALL SELECT 'zellic', 3, file_path, source_code, NULL, 0 FROM contracts WHERE source = 'unlabelled')"""
register("file_sources", f"""WITH {STAGED}
SELECT source, CAST(length(code) AS BIGINT) AS length, CAST(year AS VARCHAR) AS year FROM staged
UNION ALL SELECT 'defihacklabs', CAST(length(source_code) AS BIGINT), CAST(2019 + contract_id % 5 AS VARCHAR) FROM contracts
  WHERE source = 'curated' AND length(source_code) > 0
UNION ALL SELECT 'firm' || CAST(page_id % 3 AS VARCHAR), CAST(CASE WHEN page_id % 2 = 0 THEN length(html)
  ELSE length('{{"report_id":' || CAST(page_id AS VARCHAR) || ',"file_path":' || CAST(to_json(url) AS VARCHAR) || '}}') END AS BIGINT), NULL FROM pages
  WHERE page_id % 2 = 1 OR length(html) > 0""")
register("files_sft", f"""WITH {STAGED},
vul AS (SELECT * FROM staged WHERE source <> 'zellic' ORDER BY source_rank, contract_id LIMIT {int(500 * 0.40)}),
cln AS (SELECT * FROM staged WHERE source = 'zellic' ORDER BY contract_id LIMIT {int(500 * 0.20)}),
sel AS (SELECT *, true AS is_vulnerable FROM vul UNION ALL SELECT *, false FROM cln),
r AS (SELECT *, row_number() OVER (ORDER BY md5('42:' || contract_id), contract_id) AS rank, count(*) OVER () AS n FROM sel)
SELECT contract_id, CASE WHEN rank <= floor(n * CAST(0.9 AS DOUBLE)) THEN 'train' ELSE 'validation' END AS split, rank,
  is_vulnerable, CAST(num_vulns AS BIGINT) AS num_vulns, CAST(length(code) AS BIGINT) AS length FROM r""")
register("files_dpo", f"""WITH {STAGED},
lab AS (SELECT contract_id, code, 'missed' AS pair_kind FROM staged WHERE source = 'smartbugs' ORDER BY contract_id LIMIT 200),
cln AS (SELECT contract_id, code, 'false_positive' AS pair_kind, row_number() OVER (ORDER BY contract_id) AS i FROM staged WHERE source = 'zellic'),
sel AS (SELECT * FROM lab UNION ALL SELECT contract_id, code, pair_kind FROM cln, (SELECT count(*) AS nv FROM lab) x
  WHERE i <= CASE WHEN nv >= 200 THEN 0 ELSE greatest(1, ceil(CAST(200 AS DOUBLE) * CAST(0.3 AS DOUBLE) - nv)) END),
r AS (SELECT *, row_number() OVER (ORDER BY md5('42:' || contract_id), contract_id) AS rank, count(*) OVER () AS n FROM sel)
SELECT contract_id, CASE WHEN rank <= floor(n * CAST(0.9 AS DOUBLE)) THEN 'train' ELSE 'validation' END AS split, rank, pair_kind FROM r""")
register("source_catalogue", """
SELECT * FROM (VALUES ('documents', (SELECT count(*) FROM documents), true), ('labels', (SELECT count(*) FROM labels), true),
  ('benchmark', (SELECT count(*) FROM benchmark), true), ('pages', (SELECT count(*) FROM pages), true),
  ('conversations', (SELECT count(*) FROM conversations), true), ('events', (SELECT count(*) FROM events), true),
  ('missing_table', CAST(0 AS BIGINT), false)) t(source, n_rows, present)""")
register("eval_sink_roundtrip", f"""WITH {matched().strip()},{rates_sql('scored').strip()}
SELECT k, tp, fp, fn, tn, round(f1, 9) AS f1, (SELECT count(*) FROM scored) AS n_results,
  (SELECT count(*) FROM completions) AS n_records, CAST(6 AS BIGINT) AS n_summary_rows FROM metrics""")


# ---------------------------------------------------------------------------
# Mixed answers and labels
# ---------------------------------------------------------------------------

for _name in ("match_category", "zero_gradient", "difficulty_filter", "rl_filter_set", "pass_at_k", "concise_pairs",
              "quality_gate", "delta_pairs", "dpo_build", "trace_quality", "findings_parse", "eval_metrics"):
    ORACLE[f"{_name}_mixed"] = mixed(ORACLE[_name])


def _replaced(name: str, old: str, new: str) -> None:
    assert old in ORACLE[name]
    ORACLE[name] = ORACLE[name].replace(old, new)


# prompts of 32 and more answers have a pass@32
_replaced("pass_at_k_mixed", "CAST(NULL AS DOUBLE) AS pass_at_32", """CASE WHEN n >= 32 THEN round(1 - list_aggregate(
    list_transform(range(32), lambda i: CAST(greatest(n - c - i, 0) AS DOUBLE) / (n - i)), 'product'), 9) END AS pass_at_32""")
# contracts without an answer in a run are missed in it
_replaced("eval_metrics_mixed", "SELECT c.contract_id, c.k, e.is_vulnerable FROM completions c JOIN eval_contracts e USING (contract_id)",
          "SELECT e.contract_id, r.k, e.is_vulnerable FROM eval_contracts e, (SELECT DISTINCT k FROM completions) r")
# of labelled contracts only those with findings are ranked
_replaced("dpo_build_mixed", "dpo_sel AS (", """found_ranked AS (SELECT contract_id, source, row_number() OVER (PARTITION BY source ORDER BY contract_id) AS prank
  FROM contracts WHERE NOT (source = 'curated' AND contract_id % 13 = 0)),
dpo_sel AS (""")
_replaced("dpo_build_mixed", "FROM ranked", "FROM found_ranked")

_NORM = "regexp_replace(regexp_replace(lower({t}), '\\s+', ' ', 'g'), '^\\s+|\\s+$', '', 'g')"
ORACLE["trace_set"] = mixed(with_fixtures(f"""
WITH good AS (SELECT contract_id, k, text, CAST(length(text) // 4 AS BIGINT) AS tokens, regexp_extract_all(lower(text), '\\S+') AS lw
  FROM (SELECT *, {ratio('w')} AS r FROM (SELECT *, {WORDS} AS w FROM completions))
  WHERE {COMPLETE.format(t='text')} AND r <= 0.30 AND length(text) // 4 BETWEEN 500 AND 32000),
bw AS (SELECT regexp_extract_all(lower(text), '\\S+') AS w FROM benchmark),
bg AS (SELECT DISTINCT array_to_string(w[i:i + 12], ' ') AS g FROM (SELECT w, unnest(range(1, len(w) - 11)) AS i FROM bw WHERE len(w) >= 13)),
gg AS (SELECT DISTINCT contract_id, k, array_to_string(lw[i:i + 12], ' ') AS g FROM (
  SELECT contract_id, k, lw, unnest(range(1, len(lw) - 11)) AS i FROM good WHERE len(lw) >= 13)),
hit AS (SELECT DISTINCT contract_id, k FROM gg JOIN bg USING (g)
  UNION SELECT contract_id, k FROM good WHERE {_NORM.format(t='text')} IN (SELECT {_NORM.format(t='text')} FROM benchmark))
SELECT contract_id, k, tokens FROM good WHERE (contract_id, k) NOT IN (SELECT (contract_id, k) FROM hit)"""))
register("confident_labels", """
SELECT contract_id, swc_id, round((contract_id * 7 % 10) / 10, 9) AS confidence, CAST(t.i AS INTEGER) AS trace_id
FROM ground_truth, range(4) t(i) WHERE (contract_id * 7 % 10) / 10 >= 0.5""")


# ---------------------------------------------------------------------------
# Sets of all variants as records
# ---------------------------------------------------------------------------

def _body_of(name: str) -> str:
    """What follows the builders' CTEs in a query's SQL."""
    return ORACLE[name].split(BUILD_CTES.strip(), 1)[1]


_DPO_CTES, _DPO_SELECT = _body_of("dpo_build").rsplit("\nSELECT s.contract_id, s.split", 1)
register_b("variant_records", f"""{_DPO_CTES.strip()}, {RL_SEL},
dpo_rows AS (SELECT s.contract_id, s.split{_DPO_SELECT}),
rows_ AS (
  SELECT 'sft' AS kind, split, contract_id, rank, user_content || '|' || assistant_content AS text, CAST(NULL AS BIGINT) AS n_truth FROM sft_out
  UNION ALL SELECT 'dpo', split, contract_id, rank, prompt || '|' || chosen || '|' || rejected, NULL FROM dpo_rows
  UNION ALL SELECT 'rl', 'all', s.contract_id, s.rank, {FENCE(q(INSTRUCTION), 'c.source_code')},
    CASE WHEN s.source = 'curated' THEN (SELECT count(*) FROM vulns v WHERE v.contract_id = s.contract_id) ELSE 0 END
  FROM rl_sh s JOIN contracts c USING (contract_id) WHERE s.rank <= 300)
SELECT variant, kind, split, contract_id, CAST(rank AS BIGINT) AS rank, md5(text) AS digest, CAST(n_truth AS BIGINT) AS n_truth
FROM rows_, (VALUES ('THINK'), ('INSTRUCT'), ('RL-ZERO')) t(variant) WHERE NOT (variant = 'RL-ZERO' AND kind = 'sft')""")
ORACLE["variant_manifest"] = ORACLE["variant_sets"]
ORACLE["jsonl_roundtrip"] = ORACLE["sft_build"]


# ---------------------------------------------------------------------------
# Specification reward against all truth rows
# ---------------------------------------------------------------------------

_EDGES = ", ".join(f"('{c}', '{w}')" for c, w in CLASS_PARENTS)
_SPEC_GOT = "CASE " + " ".join(f"WHEN regexp_extract(c.text, '{p}', 1) <> '' THEN 'SWC-' || regexp_extract(c.text, '{p}', 1)"
                               for p in ("SWC[:\\s]*([0-9]{3})", "SWC-([0-9]{3})", "swc[:\\s]*([0-9]{3})")) + " END"
register_rw("spec_reward_best", f""", edge AS (SELECT * FROM (VALUES {_EDGES}) t(c, w)),
up1 AS (SELECT c AS swc, w FROM edge WHERE c LIKE 'SWC%'), up2 AS (SELECT swc, e.w FROM up1 JOIN edge e ON e.c = up1.w),
up3 AS (SELECT swc, e.w FROM up2 JOIN edge e ON e.c = up2.w), up4 AS (SELECT swc, e.w FROM up3 JOIN edge e ON e.c = up3.w),
above AS (SELECT * FROM up1 UNION SELECT * FROM up2 UNION SELECT * FROM up3 UNION SELECT * FROM up4),
related AS (SELECT DISTINCT x.swc AS a, y.swc AS b FROM above x JOIN above y ON x.w = y.w AND x.swc <> y.swc),
tv AS (SELECT contract_id, vidx, swc_id AS t_swc, coalesce(lines, line_range) AS t_lines, severity AS t_sev FROM vulns),
sp AS (SELECT c.contract_id, c.k, tv.vidx, tv.t_swc, tv.t_sev, {_SPEC_GOT} AS got,
   nullif(regexp_extract(c.text, '(?i)Severity[:\\s]*(\\w+)', 1), '') AS sev_got, len(regexp_extract_all(c.text, '{PRED_LINES}', 1)) AS nm
  FROM completions c LEFT JOIN tv USING (contract_id)),
tb0 AS (SELECT contract_id, vidx,
    CASE WHEN contains(t_lines, '-') THEN (CASE WHEN len(string_split(t_lines, '-')) = 2 THEN TRY_CAST(trim(string_split(t_lines, '-')[1]) AS BIGINT) END)
         ELSE TRY_CAST(trim(t_lines) AS BIGINT) END AS s,
    CASE WHEN contains(t_lines, '-') THEN (CASE WHEN len(string_split(t_lines, '-')) = 2 THEN TRY_CAST(trim(string_split(t_lines, '-')[2]) AS BIGINT) END)
         ELSE TRY_CAST(trim(t_lines) AS BIGINT) END AS e FROM tv),
tl0 AS (SELECT DISTINCT contract_id, vidx, unnest(generate_series(s, e)) AS line FROM tb0 WHERE s IS NOT NULL AND e IS NOT NULL),
np0 AS (SELECT contract_id, k, count(*) AS np FROM pl GROUP BY ALL), nt0 AS (SELECT contract_id, vidx, count(*) AS nt FROM tl0 GROUP BY ALL),
ni0 AS (SELECT pl.contract_id, pl.k, tl0.vidx, count(*) AS ni FROM pl JOIN tl0 ON pl.contract_id = tl0.contract_id AND pl.line = tl0.line GROUP BY ALL),
parts AS (SELECT sp.contract_id, sp.k,
    CASE WHEN got IS NOT DISTINCT FROM t_swc THEN 1.0 WHEN EXISTS (SELECT 1 FROM related r WHERE r.a = t_swc AND r.b = got) THEN 0.5 ELSE -1.0 END AS p_cls,
    CASE WHEN nm > 0 AND tb0.s IS NOT NULL AND tb0.e IS NOT NULL THEN (CASE WHEN coalesce(np, 0) = 0 OR coalesce(nt, 0) = 0 THEN 0.0
      ELSE coalesce(ni, 0) / (np + nt - coalesce(ni, 0)) END) * 2 - 1 END AS p_line,
    CASE WHEN sev_got IS NOT DISTINCT FROM t_sev THEN 0.5 ELSE -0.25 END AS p_sev,
    CASE WHEN t_swc IS NULL THEN (CASE WHEN got IS NULL OR got = 'None' THEN 0.5 ELSE -1.0 END) END AS p_clean
  FROM sp LEFT JOIN tb0 ON tb0.contract_id = sp.contract_id AND tb0.vidx = sp.vidx
    LEFT JOIN np0 ON np0.contract_id = sp.contract_id AND np0.k = sp.k LEFT JOIN nt0 ON nt0.contract_id = sp.contract_id AND nt0.vidx = sp.vidx
    LEFT JOIN ni0 ON ni0.contract_id = sp.contract_id AND ni0.k = sp.k AND ni0.vidx = sp.vidx)
SELECT contract_id, k, max(round((p_cls + coalesce(p_line, 0) + p_sev + coalesce(p_clean, 0))
   / (2 + CASE WHEN p_line IS NULL THEN 0 ELSE 1 END + CASE WHEN p_clean IS NULL THEN 0 ELSE 1 END), 9)) AS reward FROM parts GROUP BY ALL""")
ORACLE["spec_reward_best_mixed"] = mixed(ORACLE["spec_reward_best"])

register_r("stream_alarms", """, wd AS (
  SELECT experiment, stage, time_bucket(INTERVAL 1 DAY, ts) AS window_start, avg(mean_length) AS mean_length, avg(f1) AS mean_reward
  FROM runs GROUP BY ALL HAVING time_bucket(INTERVAL 1 DAY, any_value(ts)) + INTERVAL 1 DAY <= (SELECT max(ts) FROM runs) - INTERVAL 2 DAY),
st AS (SELECT experiment, stage, arg_min(mean_length, window_start) AS start_length FROM wd GROUP BY ALL)
SELECT experiment, stage, strftime(window_start, '%Y-%m-%d %H:%M:%S') AS window_start, round(mean_length, 9) AS mean_length,
  round(mean_reward, 9) AS mean_reward, round(start_length, 9) AS start_length
FROM wd JOIN st USING (experiment, stage) WHERE mean_length > 1.02 * start_length""")

# ---------------------------------------------------------------------------
# Mixtures and ablations as records
# ---------------------------------------------------------------------------

def _arms_sql() -> str:
    from vulnsift.queries import ABLATION_ARMS, ARM_SIZE

    return ", ".join(f"('{a}', '{c}', CAST({r!r} AS DOUBLE), CAST({ARM_SIZE} AS DOUBLE))" for a, c, r in ABLATION_ARMS)


def _ablations() -> str:
    return f"""{DELTA.strip().rstrip(',')},
tr AS (SELECT 'x' || contract_id || '-' || k AS item_id, 'trace_' || ntile(3) OVER (ORDER BY length(text) // 4, contract_id * 40 + k) AS bucket
  FROM completions WHERE contains(text, '<think>')),
items AS (
  SELECT CASE source WHEN 'curated' THEN 'labeled_vulns' WHEN 'tabular' THEN 'general_code' WHEN 'unlabelled' THEN 'solidity_code'
    ELSE 'clean_contracts' END AS component, 'c' || contract_id AS item_id FROM contracts
  UNION ALL SELECT x.c, 'r' || page_id FROM pages, (VALUES ('security_docs'), ('audit_reports')) x(c)
  UNION ALL SELECT 'math_reasoning', 't' || conv_id || '-' || turn FROM conversations
  UNION ALL SELECT 'synthetic_vulns', item_id FROM tr UNION ALL SELECT bucket, item_id FROM tr
  UNION ALL SELECT 'gap_' || ntile(3) OVER (ORDER BY abs(words_chosen - words_rejected), contract_id), 'p' || contract_id FROM p),
ranked_items AS (SELECT *, row_number() OVER (PARTITION BY component ORDER BY md5('42:' || item_id), item_id) AS rank FROM items),
arms AS (SELECT * FROM (VALUES {_arms_sql()}) t(arm, component, ratio, size) WHERE ratio > 0),
sup AS (SELECT a.*, CAST(coalesce(n, 0) AS DOUBLE) AS n FROM arms a LEFT JOIN (SELECT component, count(*) AS n FROM items GROUP BY 1) USING (component)),
lv AS (SELECT *, (size - coalesce(sum(n) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(ratio) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM sup WINDOW w AS (PARTITION BY arm ORDER BY n / ratio, component)),
lev AS (SELECT arm, arg_min(level, (n / ratio, component)) AS level FROM lv WHERE level <= n / ratio GROUP BY arm),
takes AS (SELECT lv.arm, component, CAST(floor(least(n, coalesce(lev.level * ratio, n)) + 1e-9) AS BIGINT) AS take FROM lv LEFT JOIN lev ON lv.arm = lev.arm)
SELECT arm, component, item_id, rank FROM ranked_items JOIN takes USING (component) WHERE rank <= take"""


TOKEN_ARMS = """
WITH d AS (SELECT doc_id, length(text) // 4 AS tokens, md5('42:' || doc_id) AS h FROM documents),
r AS (SELECT doc_id, tokens, coalesce(sum(tokens) OVER (ORDER BY h, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d),
arm_rows AS (SELECT doc_id, tokens, before, arm FROM r, (VALUES ('500M', 50000), ('2B', 200000), ('10B', 1000000)) t(arm, budget) WHERE before < budget)"""
register("token_arms", TOKEN_ARMS + """
SELECT doc_id, CAST(tokens AS BIGINT) AS tokens, CAST(before AS BIGINT) AS before, arm FROM arm_rows""")
register("token_grid", TOKEN_ARMS + """
SELECT arm AS token_count, count(*) AS n_rows, CAST(sum(tokens) AS BIGINT) AS n_tokens, m AS model_size, CAST(lr AS DOUBLE) AS learning_rate, CAST(lora AS INTEGER) AS lora_rank
FROM arm_rows, (VALUES ('135M'), ('360M'), ('500M'), ('1.5B')) a(m), (VALUES (1e-5), (5e-5), (1e-4), (5e-4)) b(lr), (VALUES (8), (16), (32), (64)) c(lora)
GROUP BY arm, m, lr, lora""")


# ---------------------------------------------------------------------------
# Direct-answer records, preferences, grouped responses, first-token latency
# ---------------------------------------------------------------------------

_USER = f"'user|' || {FENCE(q(INSTRUCTION), 'c.source_code')} || '|assistant|'"
register("instruct_records", f"""WITH {REWARD_CTES.strip()},
{BUILD_CTES.strip()},
th AS (SELECT 'think' AS kind, contract_id, k, regexp_replace(regexp_replace(text, '(?s)<think>.*?</think>', '', 'g'), '^\\s+|\\s+$', '', 'g') AS answer
  FROM completions WHERE contains(text, '<think>')),
co AS (SELECT 'concise' AS kind, p.contract_id, p.k, p.text AS answer FROM completions p JOIN ver USING (contract_id, k)
  WHERE NOT contains(p.text, '<think>') AND length(p.text) // 4 <= 512 AND verified = 1.0),
js AS (SELECT contract_id, string_agg('{{"type": "' || type || '"' || coalesce(', "lines": "' || coalesce(lines, line_range) || '"', '') || '}}', ', ' ORDER BY vidx) AS j
  FROM vulns GROUP BY contract_id)
SELECT a.kind, a.contract_id, a.k, CAST(2 AS BIGINT) AS turns, md5({_USER} || a.answer) AS digest
FROM (SELECT * FROM th WHERE answer <> '' UNION ALL SELECT * FROM co) a JOIN contracts c USING (contract_id)
UNION ALL
SELECT 'tool', c.contract_id, NULL, 4, md5({_USER} || '<tool_call>{{"name": "run_slither", "arguments": {{"contract_path": "contract.sol"}}}}</tool_call>'
  || '|tool|{{"vulnerabilities": [' || j || ']}}|assistant|' || b.body)
FROM contracts c JOIN js USING (contract_id) JOIN sft_blocks b USING (contract_id)""")

register("instruct_preferences", f"""WITH {REWARD_CTES.strip()},
{RUN_CTES.strip()},
{DELTA.strip().removeprefix('WITH')},
{PAIRED},
cc AS (SELECT p.contract_id, p.k, p.text, length(p.text) // 4 AS tokens FROM completions p JOIN ver USING (contract_id, k) WHERE verified = 1.0),
jc AS (SELECT contract_id, k, text, (contract_id * 13 + k * 7) % 11 AS js FROM completions WHERE length(text) > 0)
SELECT 'think' AS kind, contract_id AS prompt_id, md5(chosen) AS chosen, md5(rejected) AS rejected FROM p WHERE length(chosen) // 4 - length(rejected) // 4 <= 100
UNION ALL SELECT 'tool_use', prompt_id, md5(CAST(chosen_id AS VARCHAR)), md5(CAST(rejected_id AS VARCHAR)) FROM paired
UNION ALL SELECT 'concise', contract_id, md5(arg_min(text, (tokens, k))), md5(arg_max(text, (tokens, -k))) FROM cc GROUP BY contract_id HAVING max(tokens) > min(tokens)
UNION ALL SELECT 'judged', contract_id, md5(arg_max(text, (js, -k))), md5(arg_min(text, (js, k))) FROM jc GROUP BY contract_id HAVING max(js) > min(js)""")
for _name in ("instruct_records", "instruct_preferences"):
    ORACLE[f"{_name}_mixed"] = mixed(ORACLE[_name])

register_rw("grouped_responses", """SELECT r.contract_id, md5(string_agg(c.text, '|' ORDER BY r.k)) AS responses, round(arg_min(reward, r.k), 9) AS first_reward,
  round(arg_max(reward, r.k), 9) AS last_reward, CAST(count(*) AS INTEGER) AS num_responses
FROM rwt r JOIN completions c USING (contract_id, k) GROUP BY r.contract_id""")
ORACLE["first_token_latency"] = """
SELECT event_type AS experiment, round(quantile_disc(value % 20 + 5, 0.5), 9) AS p50_ms, round(quantile_disc(value % 20 + 5, 0.9), 9) AS p90_ms,
  round(quantile_disc(value % 20 + 5, 0.99), 9) AS p99_ms FROM events GROUP BY event_type"""

