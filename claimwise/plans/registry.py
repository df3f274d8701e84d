"""Named queries over the driver's tables: ``name -> f(spark, sf_dir)``.

Each entry builds only the joins it needs from ``claimwise.sources.tpch``
(the patient join is skipped when no patient attribute is used, the part
join unless procedure codes are used) and hands the result to a library
operator with the driver's parameters (``claimwise.config.DRIVER``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimwise.config import DRIVER as C
from claimwise.operators import kpis, members, providers, reasons, timing, trends
from claimwise.session import Prepared, PreparedForMany, prepared
from claimwise.sources import tpch

Query = Callable[[SparkSession, str], DataFrame]

TYPES = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]


def _fact(spark, d):
    return tpch.wide(spark, d, with_patients=False, with_providers=False)


def _wp(spark, d):
    return tpch.wide(spark, d, with_patients=False)


def _wide(spark, d):
    return tpch.wide(spark, d)


def _prov(spark, d):
    return tpch.providers(spark, d)


def business() -> dict[str, Query]:
    return {
        "q01_headline_kpis": lambda s, d: kpis.headline_kpis(_fact(s, d), C),
        "q02_monthly_trend": lambda s, d: trends.monthly_trend(_fact(s, d), C),
        "q03_denial_reasons": lambda s, d: reasons.reason_dollars(_fact(s, d), C),
        "q04_yoy_by_reason": lambda s, d: reasons.reason_yoy(_fact(s, d), C),
        "q05_plan_network": lambda s, d: kpis.plan_network(_wide(s, d), C),
        "q06_provider_outliers": lambda s, d: providers.provider_outliers(_wp(s, d), _prov(s, d), C),
        "q07_top_reasons_flagged": lambda s, d: providers.top_reasons_flagged(_wp(s, d), _prov(s, d), C),
        "q08_top3_per_specialty": lambda s, d: providers.top_per_specialty(_fact(s, d), _prov(s, d), C),
        "q09_cost_by_specialty": lambda s, d: providers.cost_by_specialty(_fact(s, d), _prov(s, d), C),
        "q10_spend_concentration": lambda s, d: members.spend_concentration(_fact(s, d), C),
        "q11_submission_lag": lambda s, d: timing.submission_lag(_fact(s, d), C),
        "q12_processing_time": lambda s, d: timing.processing_time(_fact(s, d), C),
        "q13_age_group": lambda s, d: members.age_groups(_wide(s, d), C),
    }


def exploratory() -> dict[str, Query]:
    return {
        "e01_kpis": lambda s, d: kpis.explore_kpis(_fact(s, d), C),
        "e02_monthly_volume": lambda s, d: trends.monthly_volume(_fact(s, d), C),
        "e03_trend_by_type": lambda s, d: trends.trend_by_type(_wp(s, d), C, TYPES),
        "e04_reason_share": lambda s, d: reasons.reason_share(_fact(s, d), C),
        "e05_reason_year_pivot": lambda s, d: reasons.reason_year_pivot(_fact(s, d), C),
        "e06_plan_network_matrix": lambda s, d: kpis.plan_network_matrix(_wide(s, d), C),
        "e07_provider_scorecard": lambda s, d: providers.explore_scorecard(_wp(s, d), _prov(s, d), C),
        "e08_paid_by_specialty": lambda s, d: providers.paid_by_specialty(_wp(s, d), C),
        "e09_processing_histogram": lambda s, d: timing.processing_histogram(_fact(s, d), C),
    }


def spreadsheet() -> dict[str, Query]:
    return {
        "x01_monthly": lambda s, d: trends.sheet_monthly(_fact(s, d), C),
        "x02_reasons": lambda s, d: reasons.sheet_reasons(_fact(s, d), C),
        "x03_plan_network_gap": lambda s, d: kpis.plan_network_gap(_wide(s, d), C),
        "x04_scorecard": lambda s, d: providers.sheet_scorecard(_wp(s, d), _prov(s, d), C),
        "x05_kpis": lambda s, d: kpis.sheet_kpis(_fact(s, d), C),
    }


def queries() -> dict[str, Query]:
    out: dict[str, Query] = {}
    out.update(business())
    out.update(exploratory())
    out.update(spreadsheet())
    out.update(quality())
    out.update(reports())
    out.update(features())
    out.update(faulty())
    out.update(exports())
    return out


# ---------------------------------------------------------------- raw exports, cleaning, checks

def _claims(spark, d, t=None):
    from claimwise.operators import clean

    return prepared(d, "clean claims", lambda: clean.fill_claims(_typed(spark, d, t), C))


def _typed(spark, d, t=None):
    """Deduplicated claims, nothing filled: enough for keys and flags."""
    from claimwise.operators import clean

    def typed():
        raw = tpch.raw_claims(spark, d, t)
        return clean.typed_claims(raw, C, parsed=_parsed(d, "raw claims", raw))

    return prepared(d, "typed claims", typed)


def _parsed(d, name, raw):
    """The raw claims parsed, where cleaning and rejects of one run both read them."""
    from claimwise.operators import clean

    return prepared(d, f"{name}, parsed", lambda: clean.parsed_claims(raw, C), write=False) if isinstance(d, PreparedForMany) else None


def _patients(spark, d, t=None):
    from claimwise.operators import clean

    return clean.clean_patients(tpch.raw_patients(spark, d, t), C)


def _providers(spark, d, t=None):
    from claimwise.operators import clean

    return clean.clean_providers(tpch.raw_providers(spark, d, t), C)


def _enriched(c, pa, pr, t):
    from claimwise.operators.features import enrich_patients, enrich_providers

    return enrich_providers(enrich_patients(c, pa, C, t["customer"]), pr, C, t["supplier"])


def _chk_claims(spark, d):
    from claimwise.operators import checks, clean

    t = tpch.Tables(spark, d)
    typed = _typed(spark, d, t)  # has the keys, read back from a table
    c = prepared(d, "clean claims", lambda: clean.fill_claims(typed, C))
    wide = _enriched(c, _patients(spark, d, t), _providers(spark, d, t), t)
    return checks.run_checks(wide, checks.claim_checks(C), keys=typed, stored=True)


def _con_fk(spark, d):
    t = tpch.Tables(spark, d)
    return _fk(_typed(spark, d, t), _patients(spark, d, t), _providers(spark, d, t))


def _dq_star(spark, d):
    m = tpch.model(spark, d, with_providers=True)
    return m.claims, m.patients, m.providers


def _constraints(table, df):
    from claimwise.operators import checks

    in_list = dict(checks.IN_LIST.get(table, {}))
    if "plan_type" in in_list:
        in_list["plan_type"] = C.plan_order
    return checks.run_checks(df, checks.constraint_checks(table, df.columns, in_list=in_list))


def _fk(c, pa, pr):
    from claimwise.operators.checks import foreign_key_violations

    a = foreign_key_violations(c, pa, "patient_id", "patient_id", "claim_patient_fk")
    b = foreign_key_violations(c, pr, "provider_id", "provider_id", "claim_provider_fk")
    return a.crossJoin(F.broadcast(b))  # one row each


def quality() -> dict[str, Query]:
    from claimwise.operators import checks, clean, profile

    return {
        "profile_raw_claims": lambda s, d: profile.profile(tpch.raw_claims(s, d)),
        "dup_rows": lambda s, d: profile.count_duplicate_rows(tpch.raw_claims(s, d)),
        "dup_keys": lambda s, d: profile.count_duplicate_keys(tpch.raw_claims(s, d), "claim_id"),
        "value_counts_status": lambda s, d: profile.value_counts(tpch.raw_claims(s, d), "claim_status"),
        "value_counts_gender": lambda s, d: profile.value_counts(tpch.raw_patients(s, d), "gender"),
        "neg_count": lambda s, d: profile.count_negative(tpch.raw_claims(s, d), "billed_amount"),
        "sample_values": lambda s, d: profile.sample_values(tpch.raw_claims(s, d), "service_date", 8, 1, key="claim_id"),
        "clean_patients": lambda s, d: clean.clean_patients(tpch.raw_patients(s, d), C),
        "clean_providers": lambda s, d: clean.clean_providers(tpch.raw_providers(s, d), C),
        "clean_claims": _claims,
        "claim_rejects": lambda s, d: clean.claim_rejects(raw := tpch.raw_claims(s, d), C, _parsed(d, "raw claims", raw)),
        "chk_claims": _chk_claims,
        "chk_patients": lambda s, d: checks.run_checks(_patients(s, d), checks.patient_checks(C)),
        "chk_providers": lambda s, d: checks.run_checks(_providers(s, d), checks.provider_checks(C)),
        "con_patients": lambda s, d: _constraints("patients", _patients(s, d)),
        "con_providers": lambda s, d: _constraints("providers", _providers(s, d)),
        "con_claims": lambda s, d: _constraints("claims", _claims(s, d)),
        "con_foreign_keys": _con_fk,
        "dq1_row_counts": lambda s, d: checks.dq_row_counts(*_dq_star(s, d)),
        "dq2_orphans": lambda s, d: checks.dq_orphans(*_dq_star(s, d), C),
        "dq3_financial": lambda s, d: checks.dq_financial(_dq_star(s, d)[0], C),
        "dq4_dates": lambda s, d: checks.dq_dates(_dq_star(s, d)[0], C),
        "dq5_denied_no_reason": lambda s, d: checks.dq_denied_without_reason(_dq_star(s, d)[0], C),
        "dq6_imputed_share": lambda s, d: checks.dq_imputed_share(_typed(s, d), C),
    }


# ---------------------------------------------------------------- measure catalog and report visuals

def _model(spark, d):
    from claimwise.sources.calendar import with_calendar

    return with_calendar(tpch.wide(spark, d, keep_name=True), "service_date")


def reports() -> dict[str, Query]:
    from claimwise.operators import reports as r
    from claimwise.operators.measures import evaluate

    year_slicer = [("year", [C.compare_year])]
    both = [("year", [C.base_year, C.compare_year]), ("plan_type", list(C.plan_order[:2]))]
    return {
        "r01_quarterly_rate": lambda s, d: r.quarterly_rate(_model(s, d), C),
        "r02_reason_dollars": lambda s, d: r.reason_dollars(_model(s, d), C),
        "r03_status_share": lambda s, d: r.status_share(_model(s, d), C),
        "r04_prior_auth_quarters": lambda s, d: r.prior_auth_quarters(_model(s, d), C),
        "r05_plan_network_rate": lambda s, d: r.plan_network_rate(_model(s, d), C),
        "r06_reason_table": lambda s, d: r.reason_table(_model(s, d), C),
        "r07_top_providers": lambda s, d: r.top_providers(_model(s, d), C),
        "r08_provider_table": lambda s, d: r.provider_table(_model(s, d), C),
        "r09_slicer": lambda s, d: r.reason_table(_model(s, d), C, filters=year_slicer),
        "r01_sliced": lambda s, d: r.quarterly_rate(_model(s, d), C, filters=both),
        "r05_sliced": lambda s, d: r.plan_network_rate(_model(s, d), C, filters=both),
        "r10_sliced": lambda s, d: r.kpi_cards(_model(s, d), "overview", C, filters=both),
        "r05_sliced_to_nothing": lambda s, d: r.plan_network_rate(_model(s, d), C, filters=[("plan_type", ["NONE"])]),
        "m_rank_by_year": lambda s, d: evaluate(
            _model(s, d), ["Excess Denial (pts)", "Excess Rank"], ["year", "provider_name"], [], C),
        "r10_kpi_overview": lambda s, d: r.kpi_cards(_model(s, d), "overview", C),
        "r10_kpi_denials": lambda s, d: r.kpi_cards(_model(s, d), "denials", C),
        "r10_kpi_providers": lambda s, d: r.kpi_cards(_model(s, d), "providers", C),
        "m_plan_year": lambda s, d: evaluate(
            _model(s, d), ["Total Claims", "Denial Rate", "Paid YTD", "Denial Rate (trend)", "Prior Auth Denials Base",
                           "In-Network Denial Rate"], ["plan_type"], year_slicer, C),
        "m_monthly_ytd": lambda s, d: evaluate(
            _model(s, d), ["Total Paid", "Paid YTD", "Denial Rate (trend)"], ["month_sort", "month"], [], C),
        "m_provider_rank": lambda s, d: evaluate(
            _model(s, d), ["Excess Denial (pts)", "Excess Rank", "Excess Flag"], ["provider_name"], [], C),
        "r10_all_cards": lambda s, d: r.all_cards(_model(s, d), C),
        "m_totals": lambda s, d: evaluate(
            _model(s, d), ["Total Claims", "Denied Claims", "Unique Patients", "Total Paid", "Paid YTD", "Denial Rate",
                           "Peer Denial Rate", "Excess Denial (pts)", "Denials YoY %"], ["specialty", "network_status"], [], C,
            totals=[("specialty", "network_status"), ("specialty",), ("network_status",), ()]),
        "m_year_totals": lambda s, d: evaluate(
            _model(s, d), ["Total Claims", "Unique Patients", "Paid YTD", "Denials Compare", "In-Network Denial Rate"],
            ["year", "plan_type"], [("year", [C.base_year, C.compare_year])], C, totals=[("year", "plan_type"), ("year",), ()]),
        "m_one_scan": lambda s, d: evaluate(
            _model(s, d), ["Unique Patients", "Peer Denial Rate", "Paid YTD"], ["specialty", "network_status"], [], C),
        "m_plan_cards": lambda s, d: evaluate(
            _model(s, d), ["Decided Claims", "Denied Claims", "Unique Patients", "Total Billed", "Paid to Billed %",
                           "Denied Share of Billed", "Avg Days to Process", "Prior Auth Denials", "Other Denials",
                           "Out-of-Network Denial Rate", "Denial Rate (complete)"], ["plan_type"], [], C),
    }


# ---------------------------------------------------------------- features, calendar, projections, extract

def features() -> dict[str, Query]:
    from claimwise.sources import files
    from claimwise.sources.calendar import dim_date_for

    return {
        "feat_wide_claims": lambda s, d: tpch.wide(s, d),
        "dim_date": lambda s, d: dim_date_for(tpch.claims(s, d, claim_type=False), "service_date"),
        "fact_projection": lambda s, d: files.fact_columns(tpch.wide(s, d, codes=True)),
        "model_projection": lambda s, d: files.drop_convenience(tpch.wide(s, d)),
        "sink_extract": lambda s, d: files.claims_extract(tpch.wide(s, d, codes=True, keep_name=True)),
    }


# ---------------------------------------------------------------- the same checks over a faulty star

def faulty() -> dict[str, Query]:
    from claimwise.operators import checks, clean
    from claimwise.sources import faults as f

    def star(s, d):
        return f.claims(s, d), f.patients(s, d), f.providers(s, d)

    def wide(s, d):
        return _enriched(*star(s, d), tpch.Tables(s, d))

    def told_apart(s, d):
        return prepared(d, "quarantine", lambda: checks.quarantine(wide(s, d), checks.claim_rules(C)), write=False)

    def rejected(s, d):
        """Claims that break a rule, with all the rules they break."""
        q = told_apart(s, d)
        return q.rejected.select(*f.CLAIM_COLUMNS, F.array_join("reject_reasons", ",").alias("reject_reasons"))

    def accepted(s, d):
        q = told_apart(s, d)
        return q.good.select(*f.CLAIM_COLUMNS)

    return {
        "faulty_chk_claims": lambda s, d: checks.run_checks(wide(s, d), checks.claim_checks(C)),
        "quarantine_claims": rejected,
        "quarantine_good": accepted,
        "quarantine_counts": lambda s, d: told_apart(s, d).counts,
        "faulty_chk_patients": lambda s, d: checks.run_checks(f.patients(s, d), checks.patient_checks(C)),
        "faulty_chk_providers": lambda s, d: checks.run_checks(f.providers(s, d), checks.provider_checks(C)),
        "faulty_con_patients": lambda s, d: _constraints("patients", f.patients(s, d)),
        "faulty_con_providers": lambda s, d: _constraints("providers", f.providers(s, d)),
        "faulty_con_claims": lambda s, d: _constraints("claims", f.claims(s, d)),
        "faulty_con_foreign_keys": lambda s, d: _fk(*star(s, d)),
        "faulty_dq1_row_counts": lambda s, d: checks.dq_row_counts(*star(s, d)),
        "faulty_dq2_orphans": lambda s, d: checks.dq_orphans(*star(s, d), C),
        "faulty_dq3_financial": lambda s, d: checks.dq_financial(f.claims(s, d), C),
        "faulty_dq4_dates": lambda s, d: checks.dq_dates(f.claims(s, d), C),
        "faulty_dq5_denied_no_reason": lambda s, d: checks.dq_denied_without_reason(f.claims(s, d), C),
        "csv_clean_claims": lambda s, d: f.typed(clean.clean_claims(raw := f.claims_csv(s, d), C, parsed=_parsed(d, "csv claims", raw))),
        "csv_claim_rejects": lambda s, d: clean.claim_rejects(raw := f.claims_csv(s, d), C, _parsed(d, "csv claims", raw)).select("claim_id", "service_date", "billed_amount", "allowed_amount", "reject_reason"),
    }


# ---------------------------------------------------------------- readers, writers and helpers, through files

def star_lists(cfg) -> dict:
    """Value lists of the star's CHECK constraints with this data's plan types."""
    from claimwise.operators import checks

    return checks.IN_LIST | {"patients": checks.IN_LIST["patients"] | {"plan_type": cfg.plan_order}}


def routes(spark, d) -> dict[str, DataFrame]:
    """The headline figures by each route, one row each. All routes start from the claims,
    which are made once."""
    from claimwise.operators.measures import evaluate
    from claimwise.operators.reports import KPI_PAGES

    q = queries()
    d = d if isinstance(d, Prepared) else Prepared(d)
    focus = F.col(C.reason) == C.focus_reason
    cards = list(dict.fromkeys([*KPI_PAGES["overview"], *KPI_PAGES["denials"]]))
    worst = q["q06_provider_outliers"](spark, d).orderBy(F.desc("excess_pts"), "provider_id").limit(1)
    name = worst.select(F.col("provider_id").alias("_id"), F.col("provider_name").alias("_name"))
    only = lambda df, on: df.join(F.broadcast(name), on, "left_semi").select("excess_pts")  # noqa: E731  one row
    m = _model(spark, d)
    return {
        "sql": q["q01_headline_kpis"](spark, d), "sheet": q["x05_kpis"](spark, d),
        "cards": evaluate(m, cards, [], [], C, drop_blank=False),
        "reasons": q["q04_yoy_by_reason"](spark, d).where(focus).select(F.col(f"denials_{C.compare_year}").alias("focus_compare"), F.col("yoy_change_pct").alias("focus_yoy")),
        "sheet_reasons": q["x02_reasons"](spark, d).where(focus).select(F.col("denials_compare").alias("focus_compare"), F.col("yoy_change").alias("focus_yoy")),
        "outliers": worst.select("excess_pts"),
        "sheet_scorecard": only(q["x04_scorecard"](spark, d), F.col("provider_id") == F.col("_id")),
        "measures": only(evaluate(m, ["Excess Denial (pts)"], ["provider_name"], [], C), F.col("provider_name") == F.col("_name")),
    }


def exports() -> dict[str, Query]:
    """Each writes below the scratch folder and returns what it reads back."""
    from claimwise.functions import agg_if
    from claimwise.operators import checks, reconcile
    from claimwise.operators.features import build_wide
    from claimwise.plans import results
    from claimwise.schema import PATIENTS, PROVIDERS, RAW_PROVIDERS
    from claimwise.sources import files, star
    from claimwise.session import scratch
    from claimwise.sources.faults import patients_csv

    def raw_csv(s, d):
        path = scratch(s, "raw")
        text = tpch.raw_providers(s, d).select(*[F.col(c).cast("string").alias(c) for c in RAW_PROVIDERS.names])
        text.write.option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
        return files.split_corrupt(files.read_raw(s, path, RAW_PROVIDERS))[0]

    def typed_csv(s, d, name, table, schema):
        path = scratch(s, "typed")
        files.write_clean({name: table(s, d)}, path, fmt="csv")
        return files.read_clean(s, f"{path}/{name}", schema)

    def typed_cells(s, d):
        schema = T.StructType([T.StructField("patient_id", T.LongType(), False), *PATIENTS.fields[1:]])
        rows = files.read_typed(s, patients_csv(s, d), schema, header=False)
        told = F.transform("cell_errors", lambda e: F.concat_ws(": ", e["column"], F.coalesce(e["text"], F.lit("-")), e["problem"]))
        return rows.withColumn("cell_errors", F.array_join(told, "; "))

    def joined(claims, patients, providers):
        """What the star's three tables say of each claim."""
        rows = claims.join(providers.withColumnsRenamed({"provider_id": "_r", "state": "provider_state"}), F.col("provider_id") == F.col("_r"), "left")
        rows = rows.join(patients.withColumnsRenamed({"patient_id": "_a"}), F.col("patient_id") == F.col("_a"), "left")
        return rows.drop("_r", "_a")

    def sink_clean(s, d):
        path, m = scratch(s, "clean"), tpch.model(s, d)
        files.write_clean({"claims": m.claims, "patients": m.patients, "providers": m.providers}, path)
        return joined(*[s.read.parquet(f"{path}/{n}") for n in ("claims", "patients", "providers")])

    def sink_star(s, d):
        path, m = scratch(s, "star"), tpch.model(s, d, codes=True)
        fact = m.claims.withColumn("service_year", F.year("service_date"))
        names = star.load_star(s, {"claims": fact, "patients": m.patients, "providers": m.providers}, prefix=f"star_{path.rsplit('-', 1)[1]}_",
                               path=path, in_list=star_lists(C))
        where = {n: s.sql(f"DESCRIBE FORMATTED {t}").where("col_name = 'Location'").first()["data_type"] for n, t in names.items()}
        star.drop_star(s, names, files=False)  # the files are read below, the catalog keeps nothing
        return joined(*[s.read.parquet(where[n]) for n in ("claims", "patients", "providers")])

    def sink_results(s, d):
        """All other queries, four at a time; the tables they have in common (claims, raw,
        parsed, typed, clean, faulty and wide claims) are made once."""
        own = {n: q for n, q in queries().items() if n != "sink_query_results"}
        done = results.run_all(s, own, PreparedForMany(d), scratch(s, "results"))
        return done.select("query", "title", "row_count", "error")

    def reconciled(s, d):
        return reconcile.reconcile(routes(s, d), reconcile.HEADLINE)

    def sheet_ifs(s, d):
        is_denied, large = F.col(C.status) == C.status_denied, F.col(C.billed) > 20000
        return _wp(s, d).groupBy(C.network).agg(
            agg_if("count", C.billed, is_denied, large).alias("denied_large"),
            agg_if("sum", C.billed, is_denied, large).cast("decimal(38,2)").alias("denied_large_billed"),
            agg_if("max", C.paid, ~is_denied).alias("largest_paid"),
            F.round(agg_if("avg", C.billed, large), 4).alias("large_mean"),
        )

    def wide_claims(s, d):
        m = tpch.model(s, d)
        return build_wide(m.claims, m.patients, m.providers, C, m.tables["customer"], m.tables["supplier"])

    return {
        "src_csv_raw": raw_csv,
        "src_csv_typed": lambda s, d: typed_csv(s, d, "providers", _providers, PROVIDERS),
        "src_csv_cells": typed_cells,
        "src_csv_dates": lambda s, d: typed_csv(s, d, "patients", _patients, PATIENTS),
        "sink_clean": sink_clean,
        "sink_star": sink_star,
        "sink_query_results": sink_results,
        "reconcile_figures": reconciled,
        "con_default": lambda s, d: checks.with_default(tpch.raw_patients(s, d), "state", "Unknown").select("patient_id", "state"),
        "x06_ifs": sheet_ifs,
        "build_wide": wide_claims,
    }
