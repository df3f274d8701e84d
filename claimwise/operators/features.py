"""Feature derivation (wide claims): joins to both dimensions plus the
derived columns of the reference's clean claims file."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimwise.config import DEFAULT, ClaimsConfig
from claimwise.functions import age_at, age_band, days_between, month_label, year_of
from claimwise.sources.joins import checked_broadcast


def enrich_patients(claims: DataFrame, patients: DataFrame, cfg: ClaimsConfig = DEFAULT, base: DataFrame | None = None) -> DataFrame:
    """Left join date_of_birth and plan_type on patient_id. ``base``: the table that
    a dimension made by joins starts from, whose size then decides on the broadcast."""
    p = checked_broadcast(patients.select(F.col(cfg.patient_id).alias("_pk"), cfg.date_of_birth, cfg.plan_type), base)
    return claims.join(p, claims[cfg.patient_id] == p["_pk"], "left").drop("_pk")


def enrich_providers(claims: DataFrame, providers: DataFrame, cfg: ClaimsConfig = DEFAULT, base: DataFrame | None = None) -> DataFrame:
    """Left join specialty and network_status on provider_id (``base`` as above)."""
    p = checked_broadcast(providers.select(F.col(cfg.provider_id).alias("_pk"), cfg.specialty, cfg.network), base)
    return claims.join(p, claims[cfg.provider_id] == p["_pk"], "left").drop("_pk")


def is_denied(cfg: ClaimsConfig = DEFAULT):
    return (F.col(cfg.status) == F.lit(cfg.status_denied)).cast("int")


def member_responsibility(cfg: ClaimsConfig = DEFAULT):
    """allowed - paid on Paid claims, else 0 (decimal, 2 dp)."""
    return F.when(
        F.col(cfg.status) == F.lit(cfg.status_paid), F.col(cfg.allowed) - F.col(cfg.paid)
    ).otherwise(F.lit(0)).cast("decimal(18,2)")


def feature_age_group(age):
    """Right-closed bins (-1,17] ... (64,200]; outside them -> null."""
    return F.when((age >= 0) & (age <= 200), age_band(age))


def derive_features(df: DataFrame, cfg: ClaimsConfig = DEFAULT, has_patients: bool = True) -> DataFrame:
    """service_month, service_year, days_to_submit, days_to_process,
    is_denied, member_responsibility (+ age_at_service, age_group with the
    patient join), then drop date_of_birth - one projection."""
    derived = {
        "service_month": month_label(cfg.service_date),
        "service_year": year_of(cfg.service_date),
        "days_to_submit": days_between(cfg.submission_date, cfg.service_date),
        "days_to_process": days_between(cfg.processed_date, cfg.submission_date),
        "is_denied": is_denied(cfg),
        "member_responsibility": member_responsibility(cfg),
    }
    if has_patients:
        age = age_at(cfg.service_date, cfg.date_of_birth)
        derived["age_at_service"] = age
        derived["age_group"] = feature_age_group(age)
    keep = [c for c in df.columns if c not in derived and not (has_patients and c == cfg.date_of_birth)]
    return df.select(*keep, *[v.alias(k) for k, v in derived.items()])


def build_wide(claims: DataFrame, patients: DataFrame, providers: DataFrame, cfg: ClaimsConfig = DEFAULT,
               patients_base: DataFrame | None = None, providers_base: DataFrame | None = None) -> DataFrame:
    """Wide claims = claims + patient and provider attributes + features."""
    w = enrich_providers(enrich_patients(claims, patients, cfg, patients_base), providers, cfg, providers_base)
    return derive_features(w, cfg)
