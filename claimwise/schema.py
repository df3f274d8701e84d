"""Declared schemas of the raw exports and of the clean star tables."""

from __future__ import annotations

from pyspark.sql import types as T

MONEY = T.DecimalType(18, 2)


def _strings(names: list[str]) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType(), True) for n in names])


# Raw exports are read as text only: no inference (a CPT code must never
# turn into an integer), typed afterwards by the cleaning operators.
RAW_PATIENTS = _strings(["patient_id", "gender", "date_of_birth", "state", "plan_type", "enrollment_date"])
RAW_PROVIDERS = _strings(["provider_id", "provider_name", "specialty", "state", "network_status"])
RAW_CLAIMS = _strings([
    "claim_id", "patient_id", "provider_id", "service_date", "submission_date", "processed_date", "claim_type",
    "diagnosis_category", "cpt_code", "billed_amount", "allowed_amount", "paid_amount", "claim_status", "denial_reason",
])

PATIENTS = T.StructType([
    T.StructField("patient_id", T.StringType(), False),
    T.StructField("gender", T.StringType(), False),
    T.StructField("date_of_birth", T.DateType(), False),
    T.StructField("state", T.StringType(), False),
    T.StructField("plan_type", T.StringType(), False),
    T.StructField("enrollment_date", T.DateType(), False),
])
PROVIDERS = T.StructType([
    T.StructField("provider_id", T.StringType(), False),
    T.StructField("provider_name", T.StringType(), False),
    T.StructField("specialty", T.StringType(), False),
    T.StructField("state", T.StringType(), False),
    T.StructField("network_status", T.StringType(), False),
])
CLAIMS = T.StructType([
    T.StructField("claim_id", T.StringType(), False),
    T.StructField("patient_id", T.StringType(), False),
    T.StructField("provider_id", T.StringType(), False),
    T.StructField("service_date", T.DateType(), False),
    T.StructField("submission_date", T.DateType(), False),
    T.StructField("processed_date", T.DateType(), True),
    T.StructField("claim_type", T.StringType(), False),
    T.StructField("diagnosis_category", T.StringType(), False),
    T.StructField("cpt_code", T.StringType(), False),
    T.StructField("billed_amount", MONEY, False),
    T.StructField("allowed_amount", MONEY, False),
    T.StructField("paid_amount", MONEY, False),
    T.StructField("claim_status", T.StringType(), False),
    T.StructField("denial_reason", T.StringType(), False),
    T.StructField("billed_imputed", T.BooleanType(), False),
])

FACT_COLUMNS = [f.name for f in CLAIMS.fields]
# convenience columns of the wide file that the dimensions already supply
CONVENIENCE = ["service_month", "service_year", "plan_type", "specialty", "network_status"]
