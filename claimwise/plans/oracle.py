"""Independent DuckDB SQL for every registered query (the correctness gate).

The claims star over the driver's tables is written a second time here in
plain SQL (``BASE``), so the Spark DataFrame code and these statements share
no code. Helper templates keep the rounding identical on both engines:
ratios in double as ``(100 * a) / b``, rounding through DECIMAL(38,6),
division by zero -> NULL.
"""

from __future__ import annotations

from claimwise.config import DRIVER as C


def P(a: str, b: str) -> str:
    """100 * a / b in double; NULL when b is 0."""
    return f"((CAST({a} AS DOUBLE) * 100.0) / NULLIF(CAST({b} AS DOUBLE), 0))"


def RATIO(a: str, b: str) -> str:
    return f"(CAST({a} AS DOUBLE) / NULLIF(CAST({b} AS DOUBLE), 0))"


def R(x: str, k: int = 1) -> str:
    return f"CAST(ROUND(CAST({x} AS DECIMAL(38,6)), {k}) AS DOUBLE)"


def M(x: str, k: int = 0) -> str:
    return f"CAST(ROUND({x}, {k}) AS DOUBLE)"


def CNT(pred: str) -> str:
    return f"CAST(COALESCE(SUM(CASE WHEN {pred} THEN 1 ELSE 0 END), 0) AS BIGINT)"


def AVG(x: str, pred: str | None = None) -> str:
    v = x if pred is None else f"CASE WHEN {pred} THEN {x} END"
    return RATIO(f"SUM({v})", f"COUNT({v})")


DENIED = "claim_status = 'Denied'"
DECIDED = "claim_status <> 'Pending'"
PAID = "claim_status = 'Paid'"
A, B = C.base_year, C.compare_year
CUTOFF = C.cutoff_date

BASE = f"""
providers_v AS (
  SELECT s_suppkey AS provider_id, s_name AS provider_name, n_name AS specialty, n_name AS state,
         CASE WHEN s_acctbal >= 5000 THEN 'In-Network' ELSE 'Out-of-Network' END AS network_status,
         r_name AS claim_type
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
patients_v AS (
  SELECT c_custkey AS patient_id,
         CASE WHEN c_custkey % 2 = 0 THEN 'Female' ELSE 'Male' END AS gender,
         DATE '1930-01-01' + CAST((c_custkey * 37) % 23000 AS INTEGER) AS date_of_birth,
         n_name AS state, c_mktsegment AS plan_type,
         DATE '2010-01-01' + CAST((c_custkey * 11) % 3650 AS INTEGER) AS enrollment_date
  FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey),
fact0 AS (
  SELECT l.*, o.*,
         CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN 'Denied'
              WHEN l_returnflag = 'N' AND l_linestatus = 'F' THEN 'Pending' ELSE 'Paid' END AS claim_status,
         CAST(o_orderdate AS DATE) AS service_date,
         CAST(l_extendedprice AS DECIMAL(18,2)) AS billed_amount
  FROM lineitem l JOIN orders o ON l_orderkey = o_orderkey),
fact1 AS (
  SELECT *,
         service_date + CAST(l_quantity AS INTEGER) * (CASE WHEN l_linenumber = 7 THEN 3 ELSE 1 END) AS submission_date,
         CASE WHEN claim_status = 'Denied' THEN CAST(0 AS DECIMAL(18,2))
              ELSE CAST(ROUND(billed_amount * (1 - CAST(l_discount AS DECIMAL(4,2))), 2) AS DECIMAL(18,2)) END AS allowed_amount
  FROM fact0),
claims_v AS (
  SELECT concat_ws('-', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR), CAST(l_partkey AS VARCHAR),
                   CAST(l_suppkey AS VARCHAR), CAST(CAST(l_shipdate AS DATE) AS VARCHAR)) AS claim_id,
         o_custkey AS patient_id, l_suppkey AS provider_id, service_date, submission_date,
         CASE WHEN claim_status <> 'Pending' THEN submission_date + CAST(l_partkey % 60 AS INTEGER) + 1 END AS processed_date,
         pr.claim_type, l_partkey AS _partkey,
         billed_amount, allowed_amount,
         CASE WHEN claim_status = 'Paid'
              THEN CAST(ROUND(allowed_amount * (1 - CAST(l_tax AS DECIMAL(4,2))), 2) AS DECIMAL(18,2))
              ELSE CAST(0 AS DECIMAL(18,2)) END AS paid_amount,
         claim_status,
         CASE WHEN claim_status = 'Denied' THEN o_orderpriority ELSE 'Not Applicable' END AS denial_reason,
         FALSE AS billed_imputed
  FROM fact1 LEFT JOIN providers_v pr ON l_suppkey = pr.provider_id),
wide_v AS (
  SELECT c.*, pr.specialty, pr.network_status, pr.provider_name, pa.plan_type,
         strftime(c.service_date, '%Y-%m') AS service_month,
         CAST(year(c.service_date) AS INTEGER) AS service_year,
         date_diff('day', c.service_date, c.submission_date) AS days_to_submit,
         date_diff('day', c.submission_date, c.processed_date) AS days_to_process,
         CASE WHEN c.claim_status = 'Denied' THEN 1 ELSE 0 END AS is_denied,
         CAST(floor(date_diff('day', pa.date_of_birth, c.service_date) / 365.25) AS INTEGER) AS age_at_service
  FROM claims_v c
  LEFT JOIN providers_v pr ON c.provider_id = pr.provider_id
  LEFT JOIN patients_v pa ON c.patient_id = pa.patient_id)"""


def q(body: str, ctes: str = "") -> str:
    extra = f",\n{ctes}" if ctes else ""
    return f"WITH {BASE}{extra}\n{body}"


def _band_age(col: str) -> str:
    return (f"CASE WHEN {col} < 18 THEN '0-17' WHEN {col} < 35 THEN '18-34' WHEN {col} < 50 THEN '35-49' "
            f"WHEN {col} < 65 THEN '50-64' ELSE '65+' END")


def _band_lag(col: str) -> str:
    return (f"CASE WHEN {col} <= 7 THEN '1) 0-7 days' WHEN {col} <= 30 THEN '2) 8-30 days' "
            f"WHEN {col} <= 90 THEN '3) 31-90 days' ELSE '4) 90+ days' END")


PROVIDER_STATS = f"""
ps0 AS (
  SELECT provider_id, {CNT(DECIDED)} AS decided_claims, {CNT(DENIED)} AS denials,
         COALESCE(SUM(CASE WHEN {DENIED} THEN billed_amount END), 0) AS denied_billed,
         SUM(paid_amount) AS paid, COUNT(*) AS claims,
         MIN(claim_type) AS claim_type, MIN(network_status) AS network_status, MIN(specialty) AS specialty
  FROM {{src}} GROUP BY provider_id),
ps AS (
  SELECT ps0.*, pr.provider_name,
         {RATIO('denials', 'decided_claims')} AS denial_rate,
         {RATIO('SUM(denials) OVER (PARTITION BY ps0.claim_type, ps0.network_status)',
                'SUM(decided_claims) OVER (PARTITION BY ps0.claim_type, ps0.network_status)')} AS peer_rate
  FROM ps0 LEFT JOIN providers_v pr ON ps0.provider_id = pr.provider_id)"""


def provider_stats(src: str) -> str:
    return PROVIDER_STATS.replace("{src}", src)


Q06 = f"""
  SELECT provider_id, provider_name, specialty, network_status, decided_claims,
         {R('denial_rate * 100.0')} AS denial_rate_pct, {R('peer_rate * 100.0')} AS peer_rate_pct,
         {R('(denial_rate - peer_rate) * 100.0')} AS excess_pts
  FROM ps WHERE decided_claims >= {{min_decided}}
  ORDER BY excess_pts DESC NULLS LAST, provider_id LIMIT {{k}}"""

TYPES = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")


def _slug(v: str) -> str:
    return "".join(ch if ch.isalnum() else "_" for ch in v).strip("_").lower()


def business() -> dict[str, str]:
    s: dict[str, str] = {}
    s["q01_headline_kpis"] = q(f"""
SELECT COUNT(*) AS total_claims, COUNT(DISTINCT patient_id) AS unique_patients,
       {M('SUM(billed_amount)')} AS total_billed, {M('SUM(paid_amount)')} AS total_paid,
       {R(P('SUM(paid_amount)', 'SUM(billed_amount)'))} AS paid_to_billed_pct,
       {R(P(CNT(DENIED), CNT(DECIDED)))} AS denial_rate_pct,
       {M(f'SUM(CASE WHEN {DENIED} THEN billed_amount END)')} AS denied_billed
FROM claims_v""")
    s["q02_monthly_trend"] = q(f"""
SELECT month, claims,
       {R(P('claims - LAG(claims) OVER (ORDER BY month)', 'LAG(claims) OVER (ORDER BY month)'))} AS claims_mom_pct,
       {M('paid')} AS paid,
       {M('SUM(paid) OVER (PARTITION BY substr(month, 1, 4) ORDER BY month)')} AS paid_ytd,
       {R(RATIO('d', 'n') + ' * 100.0')} AS denial_rate_pct
FROM m ORDER BY month""", f"""
m AS (SELECT strftime(service_date, '%Y-%m') AS month, COUNT(*) AS claims, SUM(paid_amount) AS paid,
             {CNT(DENIED)} AS d, {CNT(DECIDED)} AS n FROM claims_v GROUP BY 1)""")
    s["q03_denial_reasons"] = q(f"""
SELECT denial_reason, COUNT(*) AS denied_claims, {M('SUM(billed_amount)')} AS denied_billed,
       {R(P('SUM(billed_amount)', 'SUM(SUM(billed_amount)) OVER ()'))} AS share_of_denied_pct
FROM claims_v WHERE {DENIED} GROUP BY denial_reason ORDER BY denied_billed DESC""")
    s["q04_yoy_by_reason"] = q(f"""
SELECT denial_reason, a AS denials_{A}, b AS denials_{B}, {R(P('b - a', 'a'))} AS yoy_change_pct
FROM (SELECT denial_reason, {CNT(f'year(service_date) = {A}')} AS a, {CNT(f'year(service_date) = {B}')} AS b
      FROM claims_v WHERE {DENIED} GROUP BY denial_reason)
ORDER BY yoy_change_pct DESC""")
    s["q05_plan_network"] = q(f"""
SELECT p.plan_type, pr.network_status, COUNT(*) AS decided_claims,
       {R(P(CNT('c.' + DENIED), 'COUNT(*)'))} AS denial_rate_pct
FROM claims_v c JOIN patients_v p ON p.patient_id = c.patient_id
JOIN providers_v pr ON pr.provider_id = c.provider_id
WHERE c.{DECIDED} GROUP BY 1, 2 ORDER BY 1, 2""")
    s["q06_provider_outliers"] = q(
        Q06.format(min_decided=C.min_decided, k=C.top_k),
        provider_stats(f"(SELECT * FROM wide_v WHERE {DECIDED})"),
    )
    s["q07_top_reasons_flagged"] = q("""
SELECT provider_name, denial_reason, denials FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY provider_name ORDER BY denials DESC, denial_reason) AS rn FROM g)
WHERE rn <= 2 ORDER BY provider_name, denials DESC""",
        provider_stats(f"(SELECT * FROM wide_v WHERE {DECIDED})") + f""",
top AS ({Q06.format(min_decided=C.min_decided, k=3)}),
fl AS (SELECT provider_id, provider_name FROM providers_v WHERE provider_name IN (SELECT provider_name FROM top)),
g AS (SELECT fl.provider_name, c.denial_reason, COUNT(*) AS denials
      FROM claims_v c JOIN fl ON c.provider_id = fl.provider_id WHERE c.{DENIED} GROUP BY 1, 2)""")
    s["q08_top3_per_specialty"] = q(f"""
SELECT specialty, rnk, provider_name, {M('b')} AS denied_billed FROM (
  SELECT *, CAST(DENSE_RANK() OVER (PARTITION BY specialty ORDER BY b DESC) AS BIGINT) AS rnk FROM g)
WHERE rnk <= 3 ORDER BY specialty, rnk""", f"""
pp AS (SELECT provider_id, SUM(billed_amount) AS b FROM claims_v WHERE {DENIED} GROUP BY 1),
g AS (SELECT pr.specialty, pr.provider_name, SUM(pp.b) AS b FROM pp JOIN providers_v pr USING (provider_id) GROUP BY 1, 2)""")
    s["q09_cost_by_specialty"] = q(f"""
SELECT pr.specialty, COUNT(*) AS claims,
       {R(P('COUNT(*)', 'SUM(COUNT(*)) OVER ()'))} AS share_of_claims_pct,
       {M('SUM(c.paid_amount)')} AS paid,
       {R(P('SUM(c.paid_amount)', 'SUM(SUM(c.paid_amount)) OVER ()'))} AS share_of_paid_pct,
       {R(AVG('c.paid_amount', 'c.' + PAID), 0)} AS avg_paid_per_paid_claim
FROM claims_v c JOIN providers_v pr ON pr.provider_id = c.provider_id
GROUP BY pr.specialty ORDER BY paid DESC""")
    s["q10_spend_concentration"] = q(f"""
SELECT CASE WHEN bk = 1 THEN 'Top 1%' WHEN bk <= 5 THEN 'Top 2-5%' WHEN bk <= 20 THEN 'Top 6-20%'
            ELSE 'Bottom 80%' END AS member_group,
       COUNT(*) AS members, {M('SUM(paid)')} AS paid,
       {R(P('SUM(paid)', '(SELECT SUM(paid) FROM ms)'))} AS share_of_paid_pct
FROM b GROUP BY 1 ORDER BY MIN(bk)""", """
ms AS (SELECT patient_id, SUM(paid_amount) AS paid FROM claims_v GROUP BY patient_id),
b AS (SELECT *, NTILE(100) OVER (ORDER BY paid DESC, patient_id) AS bk FROM ms)""")
    s["q11_submission_lag"] = q(f"""
SELECT {_band_lag("date_diff('day', service_date, submission_date)")} AS submission_lag,
       COUNT(*) AS decided_claims, {R(P(CNT(DENIED), 'COUNT(*)'))} AS denial_rate_pct
FROM claims_v WHERE {DECIDED} GROUP BY 1 ORDER BY 1""")
    s["q12_processing_time"] = q(f"""
SELECT claim_status, COUNT(*) AS claims, {R(AVG('days'))} AS avg_days,
       CAST(median(days) AS DOUBLE) AS median_days, CAST(MAX(days) AS BIGINT) AS max_days
FROM (SELECT claim_status, date_diff('day', submission_date, processed_date) AS days FROM claims_v WHERE {DECIDED})
GROUP BY claim_status ORDER BY claim_status""")
    s["q13_age_group"] = q(f"""
SELECT {_band_age('age_at_service')} AS age_group, COUNT(*) AS claims,
       {R(P(CNT(DENIED), CNT(DECIDED)))} AS denial_rate_pct,
       {R(AVG('paid_amount', PAID), 0)} AS avg_paid
FROM wide_v WHERE age_at_service IS NOT NULL GROUP BY 1 ORDER BY 1""")
    return s


def exploratory() -> dict[str, str]:
    s: dict[str, str] = {}
    s["e01_kpis"] = q(f"""
SELECT COUNT(*) AS total_claims, {M('SUM(billed_amount)')} AS total_billed, {M('SUM(paid_amount)')} AS total_paid,
       {R(RATIO(CNT(DENIED), CNT(DECIDED)), 3)} AS denial_rate,
       {M(f'SUM(CASE WHEN {DENIED} THEN billed_amount END)')} AS denied_billed,
       {R(AVG('days_to_process'))} AS avg_days_to_process, COUNT(DISTINCT patient_id) AS unique_patients
FROM wide_v""")
    s["e02_monthly_volume"] = q("""
SELECT month, claims, paid, month = (SELECT month FROM m ORDER BY claims DESC, month LIMIT 1) AS is_peak
FROM (SELECT month, claims, CAST(ROUND(p, 2) AS DOUBLE) AS paid FROM m) ORDER BY month""", """
m AS (SELECT strftime(service_date, '%Y-%m') AS month, COUNT(claim_id) AS claims, SUM(paid_amount) AS p
      FROM claims_v GROUP BY 1)""")
    cols = ",\n       ".join(
        f"{R(RATIO(CNT(f'claim_type = {chr(39)}{t}{chr(39)} AND {DENIED}'), f'SUM(CASE WHEN claim_type = {chr(39)}{t}{chr(39)} THEN 1 END)'), 4)} AS {_slug(t)}"
        for t in TYPES
    )
    s["e03_trend_by_type"] = q(f"""
SELECT strftime(service_date, '%Y-%m') AS month,
       {cols}
FROM wide_v WHERE {DECIDED} AND service_date < DATE '{CUTOFF}' GROUP BY 1 ORDER BY 1""")
    s["e04_reason_share"] = q(f"""
SELECT denial_reason, COUNT(claim_id) AS claims, {M('SUM(billed_amount)', 2)} AS billed,
       {R(RATIO('SUM(billed_amount)', 'SUM(SUM(billed_amount)) OVER ()'), 3)} AS share
FROM claims_v WHERE {DENIED} GROUP BY 1 ORDER BY billed DESC""")
    s["e05_reason_year_pivot"] = q(f"""
SELECT denial_reason, a AS y{A}, b AS y{B}, {R(f"({RATIO('b', 'a')} - 1.0) * 100.0")} AS change_pct
FROM (SELECT denial_reason,
             CAST(SUM(CASE WHEN year(service_date) = {A} THEN 1 END) AS BIGINT) AS a,
             CAST(SUM(CASE WHEN year(service_date) = {B} THEN 1 END) AS BIGINT) AS b
      FROM claims_v WHERE {DENIED} AND year(service_date) IN ({A}, {B}) GROUP BY 1)
ORDER BY change_pct DESC NULLS LAST""")
    order = ", ".join(f"'{p}'" for p in C.plan_order)
    s["e06_plan_network_matrix"] = q(f"""
SELECT plan_type,
       {R(RATIO(CNT(f"{DENIED} AND network_status = 'In-Network'"), CNT("network_status = 'In-Network'")), 3)} AS in_network,
       {R(RATIO(CNT(f"{DENIED} AND network_status = 'Out-of-Network'"), CNT("network_status = 'Out-of-Network'")), 3)} AS out_of_network
FROM wide_v WHERE {DECIDED} AND plan_type IN ({order}) GROUP BY plan_type""")
    s["e07_provider_scorecard"] = q(f"""
SELECT provider_id, provider_name, specialty, network_status, decided_claims AS claims,
       {R('denial_rate', 4)} AS denial_rate, {R('peer_rate', 4)} AS expected_rate,
       {R('denial_rate - peer_rate', 4)} AS excess, {M('denied_billed', 2)} AS denied_billed,
       (denial_rate - peer_rate) > 0.1 AS is_flagged
FROM ps WHERE decided_claims >= {C.min_decided}
ORDER BY denial_rate - peer_rate DESC NULLS LAST, provider_id LIMIT {C.top_k}""",
        provider_stats(f"(SELECT * FROM wide_v WHERE {DECIDED})"))
    s["e08_paid_by_specialty"] = q(f"""
SELECT specialty, {M('SUM(paid_amount)', 2)} AS paid, COUNT(claim_id) AS claims, {R(AVG('paid_amount'), 2)} AS avg_paid,
       {R(RATIO('SUM(paid_amount)', 'SUM(SUM(paid_amount)) OVER ()'), 3)} AS share_of_paid
FROM wide_v GROUP BY specialty ORDER BY paid DESC""")
    s["e09_processing_histogram"] = q(f"""
SELECT h.claim_status, bin * 2 AS bin_start, (bin + 1) * 2 AS bin_end, claims,
       {R('CAST(claims AS DOUBLE) / (CAST(SUM(claims) OVER (PARTITION BY h.claim_status) AS DOUBLE) * 2.0)', 6)} AS density,
       md.median_days
FROM (SELECT claim_status, CAST(least(floor(days / 2), 39) AS INTEGER) AS bin, COUNT(*) AS claims
      FROM d WHERE days BETWEEN 0 AND 80 GROUP BY 1, 2) h
LEFT JOIN (SELECT claim_status, CAST(median(days) AS DOUBLE) AS median_days FROM d GROUP BY 1) md
  ON h.claim_status = md.claim_status
ORDER BY 1, 2""", f"""
d AS (SELECT claim_status, date_diff('day', submission_date, processed_date) AS days FROM claims_v
      WHERE claim_status IN ('Paid', 'Denied') AND processed_date IS NOT NULL)""")
    return s


def spreadsheet() -> dict[str, str]:
    s: dict[str, str] = {}
    mk = "(year(service_date) * 100 + month(service_date))"
    s["x01_monthly"] = q(f"""
SELECT month_key, strftime(make_date(CAST(month_key // 100 AS INTEGER), CAST(month_key % 100 AS INTEGER), 1), '%b %Y') AS month,
       claims, denied, pending,
       COALESCE({R(RATIO('denied', 'claims - pending'), 4)}, 0.0) AS denial_rate,
       {M('b', 2)} AS billed, {M('p', 2)} AS paid,
       {M('SUM(p) OVER (PARTITION BY month_key // 100 ORDER BY month_key)', 2)} AS paid_ytd
FROM (SELECT CAST({mk} AS INTEGER) AS month_key, COUNT(*) AS claims, {CNT(DENIED)} AS denied,
             {CNT("claim_status = 'Pending'")} AS pending, SUM(billed_amount) AS b, SUM(paid_amount) AS p
      FROM claims_v GROUP BY 1)
ORDER BY month_key""")
    s["x02_reasons"] = q(f"""
SELECT denial_reason, denied_claims, {M('b', 2)} AS denied_billed,
       {R(RATIO('b', 'SUM(b) OVER ()'), 4)} AS share_of_denied, denials_base, denials_compare,
       COALESCE({R(f"{RATIO('denials_compare', 'denials_base')} - 1.0", 4)}, 0.0) AS yoy_change
FROM (SELECT denial_reason, COUNT(*) AS denied_claims, SUM(billed_amount) AS b,
             {CNT(f'{mk} BETWEEN {A}01 AND {A}12')} AS denials_base,
             {CNT(f'{mk} BETWEEN {B}01 AND {B}12')} AS denials_compare
      FROM claims_v WHERE {DENIED} GROUP BY 1)
ORDER BY denied_billed DESC""")
    i_rate = RATIO(CNT(f"{DENIED} AND network_status = 'In-Network'"), CNT("network_status = 'In-Network'"))
    o_rate = RATIO(CNT(f"{DENIED} AND network_status = 'Out-of-Network'"), CNT("network_status = 'Out-of-Network'"))
    s["x03_plan_network_gap"] = q(f"""
SELECT plan_type, {R(i_rate, 4)} AS in_network_rate, {R(o_rate, 4)} AS out_network_rate,
       {R(f'({o_rate} - {i_rate}) * 100.0', 1)} AS gap_pts
FROM wide_v WHERE {DECIDED} GROUP BY plan_type ORDER BY plan_type""")
    s["x04_scorecard"] = q(f"""
SELECT provider_id, provider_name, specialty, network_status, claim_type, decided_claims,
       denials AS denied_claims, {R('COALESCE(denial_rate, 0.0)', 4)} AS denial_rate, {R('peer_rate', 4)} AS peer_rate,
       {R('(COALESCE(denial_rate, 0.0) - peer_rate) * 100.0', 2)} AS excess_pts,
       {M('denied_billed', 2)} AS denied_billed, {M('paid', 2)} AS paid
FROM ps WHERE decided_claims > 0
ORDER BY (COALESCE(denial_rate, 0.0) - peer_rate) * 100.0 DESC NULLS LAST, provider_id""",
        provider_stats("wide_v"))
    s["x05_kpis"] = q(f"""
SELECT COUNT(claim_id) AS total_claims, {M('SUM(billed_amount)', 2)} AS total_billed,
       {M('SUM(paid_amount)', 2)} AS total_paid, {R(RATIO(CNT(DENIED), CNT(DECIDED)), 4)} AS denial_rate,
       {M(f'SUM(CASE WHEN {DENIED} THEN billed_amount END)', 2)} AS denied_billed,
       {R(AVG('days_to_process'), 2)} AS avg_days_to_process
FROM wide_v""")
    return s


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    out.update(business())
    out.update(exploratory())
    out.update(spreadsheet())
    out.update(quality())
    out.update(reports())
    out.update(features())
    out.update(faulty())
    out.update(exports())
    out["reconcile_figures"] = _reconciled(out)
    out["sink_query_results"] = _all_results(out)
    return out


# ---------------------------------------------------------------- raw exports, cleaning, checks

def TITLE(x: str) -> str:
    """Strip, then capitalise each space-separated word."""
    return (f"array_to_string(list_transform(string_split(lower({STRIP(x)}), ' '), "
            f"lambda w: upper(substr(w, 1, 1)) || substr(w, 2)), ' ')")


def STRIP(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def MIXED(x: str) -> str:
    t = f"trim({x})"
    return (f"CASE WHEN regexp_full_match({t}, '\\d{{4}}-\\d{{2}}-\\d{{2}}') THEN CAST(try_strptime({t}, '%Y-%m-%d') AS DATE) "
            f"WHEN regexp_full_match({t}, '\\d{{2}}/\\d{{2}}/\\d{{4}}') THEN CAST(try_strptime({t}, '%m/%d/%Y') AS DATE) END")


RAW = """
raw0 AS (
  SELECT concat_ws('-', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR), CAST(l_partkey AS VARCHAR),
                   CAST(l_suppkey AS VARCHAR), CAST(CAST(l_shipdate AS DATE) AS VARCHAR)) AS claim_id,
         o_custkey AS patient_id, l_suppkey AS provider_id,
         CASE WHEN l_partkey % 20 = 0 THEN strftime(x.service_date, '%m/%d/%Y') ELSE strftime(x.service_date, '%Y-%m-%d') END AS service_date,
         strftime(x.submission_date, '%Y-%m-%d') AS submission_date,
         strftime(CASE WHEN x.claim_status <> 'Pending' THEN x.submission_date + CAST(l_partkey % 60 AS INTEGER) + 1 END, '%Y-%m-%d') AS processed_date,
         pr.claim_type, p_type AS diagnosis_category, p_brand AS cpt_code,
         CASE WHEN l_partkey % 400 = 7 THEN NULL WHEN l_partkey % 1000 = 11 THEN -x.billed_amount ELSE x.billed_amount END AS billed_amount,
         x.allowed_amount,
         CASE WHEN x.claim_status = 'Paid'
              THEN CAST(ROUND(x.allowed_amount * (1 - CAST(l_tax AS DECIMAL(4,2))), 2) AS DECIMAL(18,2))
              ELSE CAST(0 AS DECIMAL(18,2)) END AS paid_amount,
         CASE WHEN l_linenumber = 3 THEN upper(x.claim_status)
              WHEN l_linenumber = 5 THEN ' ' || lower(x.claim_status) || ' ' ELSE x.claim_status END AS claim_status,
         CASE WHEN x.claim_status = 'Denied' THEN o_orderpriority END AS denial_reason,
         l_suppkey AS _supp
  FROM fact1 x JOIN part ON l_partkey = p_partkey LEFT JOIN providers_v pr ON l_suppkey = pr.provider_id),
raw_claims AS (
  SELECT * EXCLUDE (_supp) FROM raw0 UNION ALL SELECT * EXCLUDE (_supp) FROM raw0 WHERE _supp % 67 = 0),
raw_patients AS (
  SELECT c_custkey AS patient_id, ['F', 'M', 'Female', 'female', ' f', 'M '][CAST(c_custkey % 6 + 1 AS INTEGER)] AS gender,
         strftime(DATE '1930-01-01' + CAST((c_custkey * 37) % 23000 AS INTEGER), '%Y-%m-%d') AS date_of_birth,
         CASE WHEN c_custkey % 100 = 0 THEN NULL ELSE n_name END AS state, c_mktsegment AS plan_type,
         strftime(DATE '2010-01-01' + CAST((c_custkey * 11) % 3650 AS INTEGER), '%Y-%m-%d') AS enrollment_date
  FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey),
raw_providers AS (
  SELECT provider_id, provider_name,
         CASE WHEN provider_id % 8 = 0 THEN ' ' || specialty || ' ' ELSE specialty END AS specialty, state, network_status
  FROM providers_v)"""

CLEAN = f"""
clean_patients_v AS (
  SELECT patient_id,
         CASE upper(substr({STRIP('gender')}, 1, 1)) WHEN 'F' THEN 'Female' WHEN 'M' THEN 'Male' END AS gender,
         CAST(try_strptime(date_of_birth, '%Y-%m-%d') AS DATE) AS date_of_birth, COALESCE(state, 'Unknown') AS state,
         plan_type, CAST(try_strptime(enrollment_date, '%Y-%m-%d') AS DATE) AS enrollment_date
  FROM raw_patients),
clean_providers_v AS (
  SELECT provider_id, provider_name, {TITLE('specialty')} AS specialty, state, network_status FROM raw_providers),
dd AS (SELECT DISTINCT * FROM raw_claims),
pc AS (
  SELECT claim_id, patient_id, provider_id,
         {MIXED('service_date')} AS service_date, {MIXED('submission_date')} AS submission_date,
         {MIXED('processed_date')} AS processed_date,
         (service_date IS NOT NULL AND {MIXED('service_date')} IS NULL)
           OR (submission_date IS NOT NULL AND {MIXED('submission_date')} IS NULL)
           OR (processed_date IS NOT NULL AND {MIXED('processed_date')} IS NULL) AS _bad,
         claim_type, diagnosis_category, cpt_code, abs(billed_amount) AS billed_amount, allowed_amount, paid_amount,
         {TITLE('claim_status')} AS claim_status, COALESCE(denial_reason, 'Not Applicable') AS denial_reason,
         billed_amount IS NULL AS billed_imputed
  FROM dd),
med AS (
  SELECT cpt_code, CASE WHEN COUNT(*) = 2 THEN CAST(SUM(billed_amount) AS DECIMAL(38,6)) * 0.5
                        ELSE CAST(SUM(billed_amount) AS DECIMAL(38,6)) END AS med
  FROM (SELECT cpt_code, billed_amount,
               ROW_NUMBER() OVER (PARTITION BY cpt_code ORDER BY billed_amount) - 1 AS pos,
               COUNT(*) OVER (PARTITION BY cpt_code) AS n
        FROM pc WHERE billed_amount IS NOT NULL)
  WHERE pos = (n - 1) // 2 OR pos = n // 2
  GROUP BY cpt_code),
clean_all AS (
  SELECT pc.* EXCLUDE (billed_amount),
         CAST(COALESCE(ROUND(pc.billed_amount, 2),
                       CASE WHEN med.med IS NOT NULL THEN ROUND(GREATEST(med.med, pc.allowed_amount), 2) END)
              AS DECIMAL(18,2)) AS billed_amount
  FROM pc LEFT JOIN med ON pc.cpt_code IS NOT DISTINCT FROM med.cpt_code),
clean_claims_v AS (SELECT * EXCLUDE (_bad) FROM clean_all WHERE NOT _bad),
clean_wide AS (
  SELECT c.*, pa.plan_type, pr.specialty, pr.network_status
  FROM clean_claims_v c LEFT JOIN clean_patients_v pa ON c.patient_id = pa.patient_id
  LEFT JOIN clean_providers_v pr ON c.provider_id = pr.provider_id)"""


def qc(body: str, ctes: str = "") -> str:
    """Query over the raw exports and the cleaned tables."""
    extra = f",\n{ctes}" if ctes else ""
    return q(body, RAW.strip() + "," + CLEAN + extra)


RAW_CLAIM_COLS = ["claim_id", "patient_id", "provider_id", "service_date", "submission_date", "processed_date",
                  "claim_type", "diagnosis_category", "cpt_code", "billed_amount", "allowed_amount", "paid_amount",
                  "claim_status", "denial_reason"]
RAW_CLAIM_TYPES = ["string", "bigint", "bigint", "string", "string", "string", "string", "string", "string",
                   "decimal(18,2)", "decimal(18,2)", "decimal(18,2)", "string", "string"]


def _checks_sql(table: str, checks: list[tuple[str, str]]) -> str:
    parts = [f"SELECT '{n}' AS check_name, CAST({e} AS BIGINT) AS violations FROM {table}" for n, e in checks]
    return "SELECT check_name, violations, violations = 0 AS passed FROM (" + " UNION ALL ".join(parts) + ")"


STATUS_DOMAIN = (
    CNT("NOT COALESCE(claim_status IN ('Paid', 'Denied', 'Pending'), FALSE)") + " + "
    + " + ".join("CASE WHEN " + CNT("claim_status = '" + v + "'") + " = 0 THEN 1 ELSE 0 END"
                 for v in ("Paid", "Denied", "Pending"))
)


def quality() -> dict[str, str]:
    s: dict[str, str] = {}
    prof = " UNION ALL ".join(
        f"SELECT {i} AS position, '{c}' AS \"column\", '{t}' AS dtype, {CNT(c + ' IS NULL')} AS nulls, "
        f"{R(P(CNT(c + ' IS NULL'), 'COUNT(*)'), 2)} AS null_pct, COUNT(DISTINCT {c}) AS \"unique\" FROM raw_claims"
        for i, (c, t) in enumerate(zip(RAW_CLAIM_COLS, RAW_CLAIM_TYPES))
    )
    s["profile_raw_claims"] = qc(f"SELECT CAST(position AS INTEGER) AS position, \"column\", dtype, nulls, null_pct, \"unique\" FROM ({prof})")
    s["dup_rows"] = qc("SELECT CAST((SELECT COUNT(*) FROM raw_claims) - (SELECT COUNT(*) FROM dd) AS BIGINT) AS duplicate_rows")
    s["dup_keys"] = qc("SELECT CAST(COUNT(*) - COUNT(DISTINCT claim_id) AS BIGINT) AS duplicate_keys FROM raw_claims")
    s["value_counts_status"] = qc(
        'SELECT claim_status, COUNT(*) AS "count" FROM raw_claims WHERE claim_status IS NOT NULL GROUP BY 1')
    s["value_counts_gender"] = qc('SELECT gender, COUNT(*) AS "count" FROM raw_patients WHERE gender IS NOT NULL GROUP BY 1')
    s["neg_count"] = qc(f"SELECT {CNT('billed_amount < 0')} AS negative_rows FROM raw_claims")
    s["sample_values"] = qc("SELECT service_date FROM raw_claims ORDER BY md5(claim_id || '-1'), service_date LIMIT 8")
    s["clean_patients"] = qc("SELECT * FROM clean_patients_v")
    s["clean_providers"] = qc("SELECT * FROM clean_providers_v")
    s["clean_claims"] = qc("SELECT * FROM clean_claims_v")
    bad = " OR ".join(f"({c} IS NOT NULL AND {MIXED(c)} IS NULL)" for c in ("service_date", "submission_date", "processed_date"))
    s["claim_rejects"] = qc(f"SELECT *, 'unparseable date' AS reject_reason FROM dd WHERE {bad}")
    tol = "0.01"
    s["chk_claims"] = qc(_checks_sql("clean_wide", [
        ("chk_claim_id_unique", "COUNT(*) - COUNT(DISTINCT claim_id)"),
        ("chk_billed_present", CNT("billed_amount IS NULL")),
        ("chk_non_negative", CNT("NOT COALESCE(billed_amount >= 0 AND allowed_amount >= 0 AND paid_amount >= 0, FALSE)")),
        ("chk_money_order", CNT(f"NOT COALESCE(paid_amount <= allowed_amount + {tol} AND allowed_amount <= billed_amount + {tol}, FALSE)")),
        ("chk_submit_after_service", CNT("NOT COALESCE(date_diff('day', service_date, submission_date) >= 0, FALSE)")),
        ("chk_status_domain", STATUS_DOMAIN),
        ("chk_denied_reason", CNT("claim_status = 'Denied' AND denial_reason = 'Not Applicable'")),
        ("chk_pending_no_date", CNT("claim_status = 'Pending' AND processed_date IS NOT NULL")),
        ("chk_patient_match", CNT("plan_type IS NULL")),
        ("chk_provider_match", CNT("specialty IS NULL")),
    ]))
    s["chk_patients"] = qc(_checks_sql("clean_patients_v", [
        ("chk_gender_mapped", CNT("gender IS NULL")),
        ("chk_patient_id_unique", "COUNT(*) - COUNT(DISTINCT patient_id)"),
    ]))
    s["chk_providers"] = qc(_checks_sql("clean_providers_v", [
        ("chk_provider_id_unique", "COUNT(*) - COUNT(DISTINCT provider_id)"),
    ]))
    plans = ", ".join(f"'{p}'" for p in C.plan_order)
    s["con_patients"] = qc(_checks_sql("clean_patients_v", [
        ("con_primary_key.patient_id", "COUNT(*) - COUNT(DISTINCT patient_id)"),
        *[(f"con_not_null.{c}", CNT(f"{c} IS NULL")) for c in ("gender", "date_of_birth", "state", "plan_type", "enrollment_date")],
        ("con_in_list.gender", CNT("gender IS NOT NULL AND gender NOT IN ('Female', 'Male')")),
        ("con_in_list.plan_type", CNT(f"plan_type IS NOT NULL AND plan_type NOT IN ({plans})")),
    ]))
    s["con_providers"] = qc(_checks_sql("clean_providers_v", [
        ("con_primary_key.provider_id", "COUNT(*) - COUNT(DISTINCT provider_id)"),
        *[(f"con_not_null.{c}", CNT(f"{c} IS NULL")) for c in ("provider_name", "specialty", "state", "network_status")],
        ("con_in_list.network_status", CNT("network_status IS NOT NULL AND network_status NOT IN ('In-Network', 'Out-of-Network')")),
    ]))
    s["con_claims"] = qc(_checks_sql("clean_claims_v", [
        ("con_primary_key.claim_id", "COUNT(*) - COUNT(DISTINCT claim_id)"),
        *[(f"con_not_null.{c}", CNT(f"{c} IS NULL")) for c in (
            "patient_id", "provider_id", "service_date", "submission_date", "claim_type", "diagnosis_category",
            "cpt_code", "billed_amount", "allowed_amount", "paid_amount", "claim_status", "denial_reason",
            "billed_imputed")],
        ("con_in_list.claim_status", CNT("claim_status IS NOT NULL AND claim_status NOT IN ('Paid', 'Denied', 'Pending')")),
        *[(f"con_non_negative.{c}", CNT(f"{c} < 0")) for c in ("billed_amount", "allowed_amount", "paid_amount")],
    ]))
    s["con_foreign_keys"] = qc("""
SELECT (SELECT COUNT(*) FROM clean_claims_v c WHERE NOT EXISTS (SELECT 1 FROM clean_patients_v p WHERE p.patient_id = c.patient_id)) AS claim_patient_fk,
       (SELECT COUNT(*) FROM clean_claims_v c WHERE NOT EXISTS (SELECT 1 FROM clean_providers_v p WHERE p.provider_id = c.provider_id)) AS claim_provider_fk""")
    s["dq1_row_counts"] = q("""
SELECT 'patients' AS table_name, COUNT(*) AS row_count FROM patients_v
UNION ALL SELECT 'providers', COUNT(*) FROM providers_v
UNION ALL SELECT 'claims', COUNT(*) FROM claims_v""")
    s["dq2_orphans"] = q("""
SELECT (SELECT COUNT(*) FROM claims_v c WHERE c.patient_id IS NULL OR c.patient_id NOT IN (SELECT patient_id FROM patients_v WHERE patient_id IS NOT NULL)) AS orphan_patient_rows,
       (SELECT COUNT(*) FROM claims_v c WHERE c.provider_id IS NULL OR c.provider_id NOT IN (SELECT provider_id FROM providers_v WHERE provider_id IS NOT NULL)) AS orphan_provider_rows""")
    s["dq3_financial"] = q(f"""
SELECT {CNT('paid_amount > allowed_amount + 0.01')} AS paid_gt_allowed,
       {CNT('allowed_amount > billed_amount + 0.01')} AS allowed_gt_billed,
       {CNT("claim_status = 'Denied' AND paid_amount > 0")} AS denied_but_paid FROM claims_v""")
    s["dq4_dates"] = q(f"""
SELECT {CNT('submission_date < service_date')} AS submitted_before_service,
       {CNT('processed_date < submission_date')} AS processed_before_submitted,
       {CNT("claim_status = 'Pending' AND processed_date IS NOT NULL")} AS pending_with_decision,
       {CNT("claim_status <> 'Pending' AND processed_date IS NULL")} AS decided_without_date FROM claims_v""")
    s["dq5_denied_no_reason"] = q(f"""
SELECT {CNT("claim_status = 'Denied' AND denial_reason = 'Not Applicable'")} AS denied_without_reason FROM claims_v""")
    s["dq6_imputed_share"] = qc(f"""
SELECT CAST(SUM(CAST(billed_imputed AS INTEGER)) AS BIGINT) AS imputed_rows,
       {R(P('SUM(CAST(billed_imputed AS INTEGER))', 'COUNT(*)'), 2)} AS imputed_pct FROM clean_claims_v""")
    return s


# ---------------------------------------------------------------- measure catalog and report visuals

MODEL = """
mw AS (
  SELECT *, CAST(year(service_date) AS INTEGER) AS year,
         CAST(year(service_date) * 10 + quarter(service_date) AS INTEGER) AS quarter_sort,
         CAST(year(service_date) AS VARCHAR) || ' Q' || CAST(quarter(service_date) AS VARCHAR) AS quarter_label,
         CAST(year(service_date) * 100 + month(service_date) AS INTEGER) AS month_sort,
         strftime(service_date, '%b %Y') AS month
  FROM wide_v)"""


def CN(pred: str) -> str:
    """Count that is NULL (blank) when no row qualifies."""
    return f"CAST(SUM(CASE WHEN {pred} THEN 1 END) AS BIGINT)"


def DIFF(a: str, b: str) -> str:
    return f"(CASE WHEN {a} IS NULL AND {b} IS NULL THEN NULL ELSE COALESCE({a}, 0) - COALESCE({b}, 0) END)"


def PCTTXT(x: str, k: int) -> str:
    return f"COALESCE(printf('%.{k}f', {R(f'{x} * 100.0', k)}) || '%', '')"


def INTTXT(x: str) -> str:
    return f"COALESCE(format('{{:,}}', {x}), '')"


FOCUS = f"denial_reason = '{C.focus_reason}'"
BEFORE = f"service_date < DATE '{C.cutoff_date}'"


def qm(body: str, ctes: str = "") -> str:
    return q(body, MODEL.strip() + ("," + ctes if ctes else ""))


PROVIDER_EXCESS = f"""
pv AS (
  SELECT provider_name, {CN(DENIED)} AS den, {CN(DECIDED)} AS dec,
         CASE WHEN MIN(claim_type) = MAX(claim_type) THEN MIN(claim_type) END AS t,
         CASE WHEN MIN(network_status) = MAX(network_status) THEN MIN(network_status) END AS nw,
         SUM(CASE WHEN {DENIED} THEN billed_amount END) AS den_billed,
         {CN(DENIED + " AND denial_reason IN ('" + "', '".join(C.coding_reasons) + "')")} AS coding
  FROM mw GROUP BY provider_name),
peer AS (SELECT claim_type, network_status, {RATIO(CN(DENIED), CN(DECIDED))} AS peer FROM mw GROUP BY 1, 2),
px AS (
  SELECT pv.*, peer.peer, {RATIO('den', 'dec')} AS rate,
         CASE WHEN {RATIO('den', 'dec')} IS NOT NULL THEN ({RATIO('den', 'dec')} - peer.peer) * 100.0 END AS excess
  FROM pv LEFT JOIN peer ON pv.t IS NOT DISTINCT FROM peer.claim_type AND pv.nw IS NOT DISTINCT FROM peer.network_status)"""


def reports() -> dict[str, str]:
    s: dict[str, str] = {}
    s["r01_quarterly_rate"] = qm(f"""
SELECT * FROM (SELECT quarter_label, quarter_sort,
       {R(RATIO(CN(DENIED + ' AND ' + BEFORE), CN(DECIDED + ' AND ' + BEFORE)), 4)} AS denial_rate_complete
FROM mw GROUP BY 1, 2) WHERE denial_rate_complete IS NOT NULL""")
    s["r02_reason_dollars"] = qm(f"""
SELECT * FROM (SELECT denial_reason, {M(f'SUM(CASE WHEN {DENIED} THEN billed_amount END)', 2)} AS denied_billed,
       {FOCUS} AS is_focus_reason FROM mw GROUP BY 1) WHERE denied_billed IS NOT NULL""")
    s["r03_status_share"] = qm(f"""
SELECT claim_status, COUNT(*) AS total_claims, {R(RATIO('COUNT(*)', 'SUM(COUNT(*)) OVER ()'), 4)} AS share_of_total
FROM mw GROUP BY 1""")
    s["r04_prior_auth_quarters"] = qm(f"""
SELECT * FROM (SELECT quarter_label, quarter_sort, {CN(DENIED + ' AND ' + FOCUS)} AS prior_auth_denials
FROM mw GROUP BY 1, 2) WHERE prior_auth_denials IS NOT NULL""")
    s["r05_plan_network_rate"] = qm(f"""
SELECT * FROM (SELECT plan_type, network_status, {R(RATIO(CN(DENIED), CN(DECIDED)), 4)} AS denial_rate
FROM mw GROUP BY 1, 2) WHERE denial_rate IS NOT NULL""")
    table = f"""
SELECT * FROM (SELECT COALESCE(m.denial_reason, y.denial_reason) AS denial_reason, y.a AS denials_base, y.b AS denials_compare,
       {R(RATIO(DIFF('y.b', 'y.a'), 'y.a'), 4)} AS denials_yoy, {M('m.db', 2)} AS denied_billed
FROM (SELECT denial_reason, SUM(CASE WHEN {DENIED} THEN billed_amount END) AS db FROM mw {{where}} GROUP BY 1) m
FULL JOIN (SELECT denial_reason, {CN(f'{DENIED} AND year = {A}')} AS a, {CN(f'{DENIED} AND year = {B}')} AS b
           FROM mw GROUP BY 1) y ON m.denial_reason IS NOT DISTINCT FROM y.denial_reason)
WHERE denials_base IS NOT NULL OR denials_compare IS NOT NULL OR denials_yoy IS NOT NULL OR denied_billed IS NOT NULL"""
    s["r06_reason_table"] = qm(table.replace("{where}", ""))
    s["r09_slicer"] = qm(table.replace("{where}", f"WHERE year = {B}"))
    s["r07_top_providers"] = qm(f"""
SELECT provider_name, CASE WHEN rnk <= 10 THEN {R('excess', 2)} END AS top10_excess_pts, excess >= {C.flag_pts} AS is_flagged
FROM (SELECT *, RANK() OVER (ORDER BY COALESCE(excess, 0.0) DESC) AS rnk FROM px)
WHERE rnk <= 10 AND excess IS NOT NULL""", PROVIDER_EXCESS)
    s["r08_provider_table"] = qm(f"""
SELECT * FROM (
  SELECT provider_name, specialty, {R(RATIO(CN(DENIED), CN(DECIDED)), 4)} AS denial_rate,
         {R('MIN(peer.peer)', 4)} AS peer_denial_rate,
         {R(f"CASE WHEN {RATIO(CN(DENIED), CN(DECIDED))} IS NOT NULL THEN ({RATIO(CN(DENIED), CN(DECIDED))} - MIN(peer.peer)) * 100.0 END", 2)} AS excess_pts
  FROM (SELECT mw.*, CASE WHEN MIN(claim_type) OVER w = MAX(claim_type) OVER w THEN MIN(claim_type) OVER w END AS t,
               CASE WHEN MIN(network_status) OVER w = MAX(network_status) OVER w THEN MIN(network_status) OVER w END AS nw
        FROM mw WINDOW w AS (PARTITION BY provider_name, specialty)) x
  LEFT JOIN peer ON x.t IS NOT DISTINCT FROM peer.claim_type AND x.nw IS NOT DISTINCT FROM peer.network_status
  GROUP BY provider_name, specialty)
WHERE denial_rate IS NOT NULL OR peer_denial_rate IS NOT NULL OR excess_pts IS NOT NULL""",
        f"peer AS (SELECT claim_type, network_status, {RATIO(CN(DENIED), CN(DECIDED))} AS peer FROM mw GROUP BY 1, 2)")
    den_rate = RATIO(CN(DENIED), CN(DECIDED))
    s["r10_kpi_overview"] = qm(f"""
SELECT COUNT(*) AS total_claims, {M('SUM(paid_amount)', 2)} AS total_paid, {R(den_rate, 4)} AS denial_rate,
       {M(f'SUM(CASE WHEN {DENIED} THEN billed_amount END)', 2)} AS denied_billed,
       {R(RATIO('SUM(days_to_process)', 'COUNT(days_to_process)'), 2)} AS avg_days_to_process,
       {INTTXT('COUNT(DISTINCT patient_id)')} || ' patients' AS kpi_claims_context,
       {PCTTXT(RATIO('SUM(paid_amount)', 'SUM(billed_amount)'), 0)} || ' of billed charges' AS kpi_paid_context,
       {INTTXT(CN(DENIED))} || ' of ' || {INTTXT(CN(DECIDED))} || ' decided' AS kpi_denial_context,
       {PCTTXT(RATIO(f'SUM(CASE WHEN {DENIED} THEN billed_amount END)', 'SUM(billed_amount)'), 1)} || ' of all billed charges' AS kpi_denied_context,
       'denied: ' || COALESCE(printf('%.0f', {R(AVG('days_to_process', DENIED), 0)}), '') || ' days  ·  paid: '
         || COALESCE(printf('%.0f', {R(AVG('days_to_process', PAID), 0)}), '') AS kpi_days_context
FROM mw""")
    s["r10_kpi_denials"] = qm(f"""
SELECT {CN(f'{DENIED} AND {FOCUS} AND year = {B}')} AS prior_auth_denials_compare,
       {R(RATIO(DIFF(CN(f'{DENIED} AND {FOCUS} AND year = {B}'), CN(f'{DENIED} AND {FOCUS} AND year = {A}')), CN(f'{DENIED} AND {FOCUS} AND year = {A}')), 4)} AS prior_auth_yoy,
       {R(RATIO(CN(f"{DENIED} AND network_status = 'Out-of-Network'"), CN(f"{DECIDED} AND network_status = 'Out-of-Network'")), 4)} AS out_network_denial_rate,
       {M(f'SUM(CASE WHEN {DENIED} THEN billed_amount END)', 2)} AS denied_billed,
       'vs ' || {INTTXT(CN(f'{DENIED} AND {FOCUS} AND year = {A}'))} || ' in {A}' AS kpi_prior_auth_context,
       'vs ' || {PCTTXT(RATIO(CN(f"{DENIED} AND network_status = 'In-Network'"), CN(f"{DECIDED} AND network_status = 'In-Network'")), 1)} || ' in-network' AS kpi_network_context,
       {PCTTXT(RATIO(f'SUM(CASE WHEN {DENIED} THEN billed_amount END)', 'SUM(billed_amount)'), 1)} || ' of all billed charges' AS kpi_denied_context
FROM mw""")
    s["r10_kpi_providers"] = qm(f"""
SELECT NULLIF(COUNT(*), 0) AS flagged_providers, {M('SUM(den_billed)', 2)} AS flagged_denied_billed,
       {R(RATIO('SUM(coding)', 'SUM(den)'), 4)} AS flagged_coding_share,
       {PCTTXT(RATIO('SUM(den_billed)', f'(SELECT SUM(CASE WHEN {DENIED} THEN billed_amount END) FROM mw)'), 1)} || ' of all denied charges' AS kpi_flagged_context
FROM px WHERE excess >= {C.flag_pts}""", PROVIDER_EXCESS)
    yb = f"year = {B}"
    s["m_plan_year"] = qm(f"""
SELECT * FROM (
  SELECT a.plan_type, {CN(yb)} AS total_claims,
         {R(RATIO(CN(f'{DENIED} AND {yb}'), CN(f'{DECIDED} AND {yb}')), 4)} AS denial_rate,
         {M('MIN(y.ytd)', 2)} AS paid_ytd,
         CASE WHEN DATE '{B}-12-31' < DATE '{C.cutoff_date}'
              THEN {R(RATIO(CN(f'{DENIED} AND {yb}'), CN(f'{DECIDED} AND {yb}')), 4)} END AS denial_rate_trend,
         {CN(f'{DENIED} AND {FOCUS} AND year = {A}')} AS prior_auth_denials_base,
         {R(RATIO(CN(f"{DENIED} AND network_status = 'In-Network' AND {yb}"), CN(f"{DECIDED} AND network_status = 'In-Network' AND {yb}")), 4)} AS in_network_denial_rate
  FROM mw a
  LEFT JOIN (SELECT plan_type, SUM(paid_amount) AS ytd FROM mw
             WHERE service_date BETWEEN DATE '{B}-01-01' AND DATE '{B}-12-31' GROUP BY 1) y ON a.plan_type = y.plan_type
  GROUP BY a.plan_type)
WHERE total_claims IS NOT NULL OR denial_rate IS NOT NULL OR paid_ytd IS NOT NULL OR denial_rate_trend IS NOT NULL
   OR prior_auth_denials_base IS NOT NULL OR in_network_denial_rate IS NOT NULL""")
    s["m_provider_rank"] = qm(f"""
SELECT provider_name, {R('excess', 2)} AS excess_pts,
       CAST(RANK() OVER (ORDER BY COALESCE(excess, 0.0) DESC) AS BIGINT) AS excess_rank,
       excess >= {C.flag_pts} AS is_flagged
FROM px WHERE excess IS NOT NULL""", PROVIDER_EXCESS)
    excess_by_year = (PROVIDER_EXCESS.replace("SELECT provider_name,", "SELECT year, provider_name,")
                      .replace("GROUP BY provider_name", "GROUP BY year, provider_name")
                      .replace("SELECT claim_type, network_status,", "SELECT year, claim_type, network_status,")
                      .replace("GROUP BY 1, 2)", "GROUP BY 1, 2, 3)")
                      .replace("LEFT JOIN peer ON", "LEFT JOIN peer ON pv.year = peer.year AND"))
    s["m_rank_by_year"] = qm(f"""
SELECT year, provider_name, {R('excess', 2)} AS excess_pts,
       CAST(RANK() OVER (PARTITION BY year ORDER BY COALESCE(excess, 0.0) DESC) AS BIGINT) AS excess_rank
FROM px""", excess_by_year)
    sliced = f"""FROM (SELECT * FROM mw WHERE year IN ({A}, {B}) AND plan_type IN ('{"', '".join(C.plan_order[:2])}')) mw"""
    for key, base in (("r01_sliced", "r01_quarterly_rate"), ("r05_sliced", "r05_plan_network_rate"), ("r10_sliced", "r10_kpi_overview")):
        head, body = s[base].rsplit("FROM mw", 1)
        s[key] = head + sliced + body
    s["r05_sliced_to_nothing"] = s["r05_plan_network_rate"].replace("FROM mw\nGROUP", "FROM mw WHERE plan_type = 'NONE'\nGROUP").replace("FROM mw GROUP", "FROM mw WHERE plan_type = 'NONE' GROUP")
    s["m_plan_cards"] = qm(f"""
SELECT plan_type, {CN(DECIDED)} AS decided_claims, {CN(DENIED)} AS denied_claims,
       COUNT(DISTINCT patient_id) AS unique_patients, {M('SUM(billed_amount)', 2)} AS total_billed,
       {R(RATIO('SUM(paid_amount)', 'SUM(billed_amount)'), 4)} AS paid_to_billed,
       {R(RATIO(f'SUM(CASE WHEN {DENIED} THEN billed_amount END)', 'SUM(billed_amount)'), 4)} AS denied_share_of_billed,
       {R(RATIO('SUM(days_to_process)', 'COUNT(days_to_process)'), 2)} AS avg_days_to_process,
       {CN(DENIED + ' AND ' + FOCUS)} AS prior_auth_denials,
       {DIFF(CN(DENIED), CN(DENIED + ' AND ' + FOCUS))} AS other_denials,
       {R(RATIO(CN(f"{DENIED} AND network_status = 'Out-of-Network'"), CN(f"{DECIDED} AND network_status = 'Out-of-Network'")), 4)} AS out_network_denial_rate,
       {R(RATIO(CN(DENIED + ' AND ' + BEFORE), CN(DECIDED + ' AND ' + BEFORE)), 4)} AS denial_rate_complete
FROM mw GROUP BY plan_type""")
    totals = f"""
g AS (
  SELECT specialty, network_status, GROUPING(specialty, network_status) AS level, COUNT(*) AS n, {CN(DENIED)} AS den, {CN(DECIDED)} AS dec,
         COUNT(DISTINCT patient_id) AS pats, SUM(paid_amount) AS paid,
         SUM(CASE WHEN year = (SELECT MAX(year) FROM mw) THEN paid_amount END) AS ytd,
         {CN(f'{DENIED} AND year = {A}')} AS a, {CN(f'{DENIED} AND year = {B}')} AS b,
         CASE WHEN MIN(claim_type) = MAX(claim_type) THEN MIN(claim_type) END AS t,
         CASE WHEN MIN(network_status) = MAX(network_status) THEN MIN(network_status) END AS nw
  FROM mw GROUP BY GROUPING SETS ((specialty, network_status), (specialty), (network_status), ())),
peer AS (SELECT claim_type, network_status AS pn, {RATIO(CN(DENIED), CN(DECIDED))} AS peer FROM mw GROUP BY 1, 2)"""
    peer_join = "FROM g LEFT JOIN peer ON g.t = peer.claim_type AND g.nw = peer.pn"
    g_rate = RATIO("den", "dec")
    s["m_totals"] = qm(f"""
SELECT specialty, network_status, level, n AS total_claims, den AS denied_claims, pats AS unique_patients, {M('paid', 2)} AS total_paid,
       {M('ytd', 2)} AS paid_ytd, {R(g_rate, 4)} AS denial_rate, {R('peer', 4)} AS peer_denial_rate,
       {R(f'({g_rate} - peer) * 100.0', 2)} AS excess_pts, {R(RATIO(DIFF('b', 'a'), 'a'), 4)} AS denials_yoy
{peer_join}""", totals)
    s["m_one_scan"] = qm(f"""
SELECT specialty, network_status, pats AS unique_patients, {R('peer', 4)} AS peer_denial_rate, {M('ytd', 2)} AS paid_ytd
{peer_join} WHERE level = 0""", totals)
    in_rate = RATIO(CN(f"{DENIED} AND network_status = 'In-Network' AND y"), CN(f"{DECIDED} AND network_status = 'In-Network' AND y"))
    s["m_year_totals"] = qm(f"""
SELECT g.year, g.plan_type, g.level, n AS total_claims, pats AS unique_patients, {M('ytd', 2)} AS paid_ytd, den AS denials_compare, {R('inr', 4)} AS in_network_denial_rate
FROM (SELECT year, plan_type, GROUPING(year, plan_type) AS level, {CN('y')} AS n, COUNT(DISTINCT CASE WHEN y THEN patient_id END) AS pats,
             CASE WHEN GROUPING(year) = 1 THEN SUM(CASE WHEN year = {B} THEN paid_amount END) ELSE SUM(CASE WHEN y THEN paid_amount END) END AS ytd, {in_rate} AS inr
      FROM (SELECT *, year IN ({A}, {B}) AS y FROM mw)
      GROUP BY GROUPING SETS ((year, plan_type), (year), ())) g
LEFT JOIN (SELECT plan_type, GROUPING(plan_type) AS all_plans, {CN(f'{DENIED} AND year = {B}')} AS den FROM mw GROUP BY GROUPING SETS ((plan_type), ())) d
  ON g.plan_type IS NOT DISTINCT FROM d.plan_type AND (g.level % 2) = d.all_plans
WHERE g.year IS NULL OR g.year IN ({A}, {B})""")
    s["r10_all_cards"] = f"""
SELECT * FROM ({s['r10_kpi_overview']}) CROSS JOIN (SELECT * EXCLUDE (denied_billed, kpi_denied_context) FROM ({s['r10_kpi_denials']}))
CROSS JOIN ({s['r10_kpi_providers']})"""
    s["m_monthly_ytd"] = qm(f"""
SELECT month_sort, month, {M('paid', 2)} AS total_paid,
       {M('SUM(paid) OVER (PARTITION BY month_sort // 100 ORDER BY month_sort)', 2)} AS paid_ytd,
       CASE WHEN last_day(make_date(CAST(month_sort // 100 AS INTEGER), CAST(month_sort % 100 AS INTEGER), 1)) < DATE '{C.cutoff_date}'
            THEN {R('rate', 4)} END AS denial_rate_trend
FROM (SELECT month_sort, month, SUM(paid_amount) AS paid, {den_rate} AS rate FROM mw GROUP BY 1, 2)""")
    return s


# ---------------------------------------------------------------- features, calendar, projections, extract

WIDE_FULL = """
wf AS (
  SELECT c.claim_id, c.patient_id, c.provider_id, c.service_date, c.submission_date, c.processed_date,
         c.billed_amount, c.allowed_amount, c.paid_amount, c.claim_status, c.denial_reason, c.billed_imputed,
         pr.claim_type, pr.specialty, pr.network_status, pa.plan_type,
         strftime(c.service_date, '%Y-%m') AS service_month, CAST(year(c.service_date) AS INTEGER) AS service_year,
         CAST(date_diff('day', c.service_date, c.submission_date) AS INTEGER) AS days_to_submit,
         CAST(date_diff('day', c.submission_date, c.processed_date) AS INTEGER) AS days_to_process,
         CAST(CASE WHEN c.claim_status = 'Denied' THEN 1 ELSE 0 END AS INTEGER) AS is_denied,
         CAST(CASE WHEN c.claim_status = 'Paid' THEN c.allowed_amount - c.paid_amount ELSE 0 END AS DECIMAL(18,2)) AS member_responsibility,
         CAST(floor(date_diff('day', pa.date_of_birth, c.service_date) / 365.25) AS INTEGER) AS age_at_service,
         p.p_type AS diagnosis_category, p.p_brand AS cpt_code, pr.provider_name
  FROM claims_v c
  JOIN part p ON c._partkey = p.p_partkey
  LEFT JOIN providers_v pr ON c.provider_id = pr.provider_id
  LEFT JOIN patients_v pa ON c.patient_id = pa.patient_id),
wf2 AS (
  SELECT *, CASE WHEN age_at_service BETWEEN 0 AND 200 THEN
           CASE WHEN age_at_service < 18 THEN '0-17' WHEN age_at_service < 35 THEN '18-34' WHEN age_at_service < 50 THEN '35-49'
                WHEN age_at_service < 65 THEN '50-64' ELSE '65+' END END AS age_group
  FROM wf)"""


def features() -> dict[str, str]:
    s: dict[str, str] = {}
    s["feat_wide_claims"] = q("SELECT * EXCLUDE (diagnosis_category, cpt_code, provider_name) FROM wf2", WIDE_FULL.strip())
    s["dim_date"] = q("""
SELECT date, CAST(year(date) AS INTEGER) AS year, CAST(month(date) AS INTEGER) AS month_number,
       strftime(date, '%b %Y') AS month, CAST(year(date) * 100 + month(date) AS INTEGER) AS month_sort,
       'Q' || CAST(quarter(date) AS VARCHAR) AS quarter,
       CAST(year(date) AS VARCHAR) || ' Q' || CAST(quarter(date) AS VARCHAR) AS quarter_label,
       CAST(year(date) * 10 + quarter(date) AS INTEGER) AS quarter_sort
FROM (SELECT CAST(unnest(generate_series(make_date(CAST(year(MIN(service_date)) AS INTEGER), 1, 1),
                                         make_date(CAST(year(MAX(service_date)) AS INTEGER), 12, 31), INTERVAL 1 DAY)) AS DATE) AS date
      FROM claims_v)""")
    s["fact_projection"] = q("""
SELECT claim_id, patient_id, provider_id, service_date, submission_date, processed_date, claim_type,
       diagnosis_category, cpt_code, billed_amount, allowed_amount, paid_amount, claim_status, denial_reason,
       CAST(billed_imputed AS INTEGER) AS billed_imputed FROM wf2""", WIDE_FULL.strip())
    s["model_projection"] = q("""
SELECT * EXCLUDE (diagnosis_category, cpt_code, provider_name, service_month, service_year, plan_type, specialty, network_status)
FROM wf2""", WIDE_FULL.strip())
    s["sink_extract"] = q("""
SELECT claim_id, CAST(year(service_date) * 100 + month(service_date) AS INTEGER) AS month_key, service_date, w.plan_type,
       w.provider_id, p.provider_name, w.specialty, w.network_status, w.claim_type, diagnosis_category, billed_amount,
       allowed_amount, paid_amount, claim_status, denial_reason, days_to_process, age_group
FROM wf2 w JOIN providers_v p ON w.provider_id = p.provider_id
ORDER BY service_date, claim_id""", WIDE_FULL.strip())
    return s


# ---------------------------------------------------------------- faulty star, CSV exports

def _fault_ctes() -> str:
    from claimwise.sources import faults as f

    def view(name, columns, rules, source, fault, twice):
        items = ", ".join(f.projection(columns, rules))
        return (f"{name}_f AS (SELECT *, {fault} AS f FROM {source}),\n"
                f"{name} AS (SELECT {items} FROM {name}_f UNION ALL SELECT {items} FROM {name}_f WHERE f = {twice})")

    pa = ["patient_id", "gender", "date_of_birth", "state", "plan_type", "enrollment_date"]
    pr = ["provider_id", "provider_name", "specialty", "state", "network_status"]
    coded = "(SELECT c.*, p_type AS diagnosis_category, p_brand AS cpt_code FROM claims_v c JOIN part ON _partkey = p_partkey)"
    return ",\n".join([
        view("faulty_claims", f.CLAIM_COLUMNS, f.CLAIM_RULES, coded, f.CLAIM_FAULT, 1),
        view("faulty_patients", pa, f.PATIENT_RULES, "patients_v", "patient_id % 101", 2),
        view("faulty_providers", pr, f.PROVIDER_RULES, "providers_v", "provider_id % 13", 1),
        """faulty_wide AS (
  SELECT c.*, pa.plan_type, pr.specialty, pr.network_status FROM faulty_claims c
  LEFT JOIN faulty_patients pa ON c.patient_id = pa.patient_id LEFT JOIN faulty_providers pr ON c.provider_id = pr.provider_id)""",
    ])


def faulty() -> dict[str, str]:
    """The statements of the same checks, reading the faulty views."""
    from claimwise.sources import faults as f

    ctes = _fault_ctes()
    names = [("clean_wide", "faulty_wide"), ("clean_claims_v", "faulty_claims"), ("clean_patients_v", "faulty_patients"),
             ("clean_providers_v", "faulty_providers"), ("claims_v", "faulty_claims"), ("patients_v", "faulty_patients"),
             ("providers_v", "faulty_providers")]
    out: dict[str, str] = {}
    for key, sql in quality().items():
        if key.split("_")[0] in ("chk", "con", "dq1", "dq2", "dq3", "dq4", "dq5"):
            body = sql[len(qc("")):] if sql.startswith(qc("")) else sql[len(q("")):]
            for a, b in names:
                body = body.replace(a, b)
            out[f"faulty_{key}"] = q(body, ctes)
    rules = [
        ("chk_claim_id_unique", "claim_id IS NULL OR COUNT(*) OVER (PARTITION BY claim_id) > 1"),
        ("chk_billed_present", "billed_amount IS NULL"),
        ("chk_non_negative", "NOT COALESCE(billed_amount >= 0 AND allowed_amount >= 0 AND paid_amount >= 0, FALSE)"),
        ("chk_money_order", "NOT COALESCE(paid_amount <= allowed_amount + 0.01 AND allowed_amount <= billed_amount + 0.01, FALSE)"),
        ("chk_submit_after_service", "NOT COALESCE(submission_date >= service_date, FALSE)"),
        ("chk_status_domain", "NOT COALESCE(claim_status IN ('Paid', 'Denied', 'Pending'), FALSE)"),
        ("chk_denied_reason", "claim_status = 'Denied' AND denial_reason = 'Not Applicable'"),
        ("chk_pending_no_date", "claim_status = 'Pending' AND processed_date IS NOT NULL"),
        ("chk_patient_match", "plan_type IS NULL"),
        ("chk_provider_match", "specialty IS NULL"),
    ]
    cases = ", ".join(f"CASE WHEN {e} THEN '{n}' END" for n, e in rules)
    told = f"{ctes},\ntold AS (SELECT {', '.join(f.CLAIM_COLUMNS)}, concat_ws(',', {cases}) AS reject_reasons FROM faulty_wide)"
    out["quarantine_claims"] = q("SELECT * FROM told WHERE reject_reasons <> ''", told)
    out["quarantine_good"] = q("SELECT * EXCLUDE (reject_reasons) FROM told WHERE reject_reasons = ''", told)
    out["quarantine_counts"] = q("SELECT check_name, violations, violations = 0 AS passed FROM (" + " UNION ALL ".join(
        f"SELECT '{n}' AS check_name, {CNT(f'list_contains(string_split(reject_reasons, {chr(39)},{chr(39)}), {chr(39)}{n}{chr(39)})')} AS violations FROM told"
        for n, _ in rules) + ")", told)
    num = f.CLAIM_FAULT
    typed = RAW.strip() + f""",
csv_good AS (
  SELECT * REPLACE (CASE WHEN {num} = 31 THEN NULL ELSE billed_amount END AS billed_amount)
  FROM raw_claims WHERE {num} NOT IN (30, 32, 33)),""" + CLEAN.replace("raw_claims", "csv_good")
    out["csv_clean_claims"] = q("SELECT * FROM clean_claims_v", typed)
    out["csv_claim_rejects"] = q(f"""
SELECT DISTINCT claim_id, CASE WHEN f = 30 THEN '05-03-2024' ELSE service_date END AS service_date,
       CASE f WHEN 31 THEN NULL WHEN 32 THEN '12,50 USD' ELSE CAST(billed_amount AS VARCHAR) END AS billed_amount,
       CASE f WHEN 33 THEN 'abc' ELSE CAST(allowed_amount AS VARCHAR) END AS allowed_amount,
       CASE WHEN f = 30 THEN 'unparseable date' ELSE 'unparseable amount' END AS reject_reason
FROM (SELECT *, {num} AS f FROM raw_claims) WHERE f IN (30, 32, 33)""", RAW.strip())
    return out


def _joined(extra: str = "", more: str = "") -> str:
    return q(f"""
SELECT c.* EXCLUDE (_partkey){extra}, pr.provider_name, pr.specialty, pr.state AS provider_state, pr.network_status,
       pa.gender, pa.date_of_birth, pa.state, pa.plan_type, pa.enrollment_date
FROM claims_v c {more} LEFT JOIN providers_v pr ON c.provider_id = pr.provider_id LEFT JOIN patients_v pa ON c.patient_id = pa.patient_id""")


def _cells() -> str:
    text = f"""
t AS (SELECT k, patient_id AS id, CASE k WHEN 3 THEN 'P-' || patient_id ELSE CAST(patient_id AS VARCHAR) END AS patient_id,
    CASE k WHEN 7 THEN 'NA' ELSE gender END AS gender,
    CASE k WHEN 2 THEN '1990-13-45' WHEN 4 THEN 'unknown' WHEN 8 THEN '' ELSE CAST(date_of_birth AS VARCHAR) END AS date_of_birth,
    state, plan_type, CASE k WHEN 4 THEN '05-03-2024' ELSE CAST(enrollment_date AS VARCHAR) END AS enrollment_date
  FROM (SELECT *, patient_id % 53 AS k FROM patients_v)),
u AS (SELECT *, CASE k WHEN 5 THEN concat_ws(',', patient_id, gender, date_of_birth, state, plan_type, enrollment_date) || ',surplus'
                       WHEN 6 THEN concat_ws(',', patient_id, gender) END AS line FROM t)"""
    return q("""
SELECT CASE WHEN k <> 3 THEN id END AS patient_id, CASE WHEN k <> 7 THEN gender END AS gender,
  CASE WHEN k NOT IN (2, 4, 6, 8) THEN CAST(date_of_birth AS DATE) END AS date_of_birth, CASE WHEN k <> 6 THEN state END AS state,
  CASE WHEN k <> 6 THEN plan_type END AS plan_type, CASE WHEN k NOT IN (4, 6) THEN CAST(enrollment_date AS DATE) END AS enrollment_date,
  concat_ws('; ', CASE WHEN line IS NOT NULL THEN line || ': too many or too few fields' END,
    CASE WHEN k = 3 THEN 'patient_id: ' || patient_id || ': not a bigint' END, CASE WHEN k = 7 THEN 'gender: -: missing' END,
    CASE WHEN k IN (2, 4) THEN 'date_of_birth: ' || date_of_birth || ': not a date' WHEN k IN (6, 8) THEN 'date_of_birth: -: missing' END,
    CASE WHEN k = 6 THEN 'state: -: missing' END, CASE WHEN k = 6 THEN 'plan_type: -: missing' END,
    CASE WHEN k = 4 THEN 'enrollment_date: ' || enrollment_date || ': not a date' WHEN k = 6 THEN 'enrollment_date: -: missing' END) AS cell_errors
FROM u""", text.strip())


def _reconciled(sql: dict[str, str]) -> str:
    from claimwise.operators.reconcile import HEADLINE, SLACK

    focus = f"denial_reason = '{C.focus_reason}'"
    ctes = {
        "sql": sql["q01_headline_kpis"], "sheet": sql["x05_kpis"],
        "cards": f"SELECT * FROM ({sql['r10_kpi_overview']}) CROSS JOIN (SELECT * EXCLUDE (denied_billed, kpi_denied_context) FROM ({sql['r10_kpi_denials']}))",
        "reasons": f"SELECT denials_{B} AS focus_compare, yoy_change_pct AS focus_yoy FROM ({sql['q04_yoy_by_reason']}) WHERE {focus}",
        "sheet_reasons": f"SELECT denials_compare AS focus_compare, yoy_change AS focus_yoy FROM ({sql['x02_reasons']}) WHERE {focus}",
        "outliers": f"SELECT provider_id, provider_name, excess_pts FROM ({sql['q06_provider_outliers']}) ORDER BY excess_pts DESC, provider_id LIMIT 1",
        "sheet_scorecard": f"SELECT excess_pts FROM ({sql['x04_scorecard']}) WHERE provider_id = (SELECT provider_id FROM outliers)",
        "measures": f"SELECT excess_pts FROM ({sql['m_provider_rank']}) WHERE provider_name = (SELECT provider_name FROM outliers)",
    }
    rows = []
    for figure, (first, *others) in HEADLINE.items():
        for f in others:
            of = lambda x: f"CAST({x.route}.{x.column} AS DOUBLE) * {x.scale}"
            room = 0.5 * 10.0**-first.digits + 0.5 * 10.0**-f.digits + SLACK
            rows.append(f"""SELECT '{figure}' AS figure, '{f.route}' AS route, {of(f)} AS value, '{first.route}' AS against, {of(first)} AS expected,
  {R(f'({of(f)} - {of(first)})', 4)} AS difference,
  ({of(f)} IS NULL AND {of(first)} IS NULL) OR COALESCE(abs({of(f)} - {of(first)}) <= {room!r}, FALSE) AS equal FROM {f.route}, {first.route}""")
    return "WITH " + ",\n".join(f"{n} AS ({body})" for n, body in ctes.items()) + "\n" + "\nUNION ALL ".join(rows)


def exports() -> dict[str, str]:
    return {
        "src_csv_raw": qc("SELECT CAST(provider_id AS VARCHAR) AS provider_id, provider_name, specialty, state, network_status FROM raw_providers"),
        "src_csv_typed": qc("SELECT * REPLACE (CAST(provider_id AS VARCHAR) AS provider_id) FROM clean_providers_v"),
        "src_csv_cells": _cells(),
        "src_csv_dates": qc("SELECT * REPLACE (CAST(patient_id AS VARCHAR) AS patient_id) FROM clean_patients_v"),
        "sink_clean": _joined(),
        "sink_star": _joined(", p_type AS diagnosis_category, p_brand AS cpt_code, CAST(year(service_date) AS INTEGER) AS service_year", "JOIN part ON _partkey = p_partkey"),
        "con_default": qc("SELECT patient_id, COALESCE(state, 'Unknown') AS state FROM raw_patients"),
        "x06_ifs": q(f"""
SELECT network_status, {CNT(DENIED + ' AND billed_amount > 20000')} AS denied_large,
       CAST(COALESCE(SUM(CASE WHEN {DENIED} AND billed_amount > 20000 THEN billed_amount END), 0) AS DECIMAL(38,2)) AS denied_large_billed,
       MAX(CASE WHEN NOT {DENIED} THEN paid_amount END) AS largest_paid,
       ROUND({AVG('billed_amount', 'billed_amount > 20000')}, 4) AS large_mean
FROM wide_v GROUP BY network_status"""),
        "build_wide": features()["feat_wide_claims"],
    }


def _all_results(sql: dict[str, str]) -> str:
    """Rows of every other query."""
    from claimwise.plans.results import title

    return "\nUNION ALL ".join(
        f"SELECT '{k}' AS query, '{title(k)}' AS title, (SELECT COUNT(*) FROM ({body})) AS row_count, CAST(NULL AS VARCHAR) AS error" for k, body in sql.items())
