"""Column names and business parameters shared by every operator.

Operators never hard-code a column: they read it from a ``ClaimsConfig``.
The defaults follow the reference's claims model; ``DRIVER`` holds the
values used when the same operators run over the driver's TPC-H-like
tables (see ``claimwise.sources.tpch``).
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace


@dataclass(frozen=True)
class ClaimsConfig:
    # fact columns
    claim_id: str = "claim_id"
    patient_id: str = "patient_id"
    provider_id: str = "provider_id"
    service_date: str = "service_date"
    submission_date: str = "submission_date"
    processed_date: str = "processed_date"
    claim_type: str = "claim_type"
    diagnosis: str = "diagnosis_category"
    cpt_code: str = "cpt_code"
    billed: str = "billed_amount"
    allowed: str = "allowed_amount"
    paid: str = "paid_amount"
    status: str = "claim_status"
    reason: str = "denial_reason"
    billed_imputed: str = "billed_imputed"
    # dimension columns
    gender: str = "gender"
    date_of_birth: str = "date_of_birth"
    state: str = "state"
    plan_type: str = "plan_type"
    enrollment_date: str = "enrollment_date"
    provider_name: str = "provider_name"
    specialty: str = "specialty"
    network: str = "network_status"

    # Fixed values of the reference's data model.
    status_paid: str = "Paid"
    status_denied: str = "Denied"
    status_pending: str = "Pending"
    no_reason: str = "Not Applicable"
    in_network: str = "In-Network"
    out_network: str = "Out-of-Network"
    focus_reason: str = "Missing prior authorization"
    coding_reasons: tuple = ("Coding error", "Duplicate claim")
    plan_order: tuple = ("Commercial", "Medicare", "Medicaid")

    # analysis parameters
    base_year: int = 2024
    compare_year: int = 2025
    cutoff_date: str = "2025-12-01"     # "complete" trend stops before this date
    min_decided: int = 100              # volume floor of the SQL/pandas outlier lists
    top_k: int = 10
    flag_pts: float = 10.0              # excess points that flag a provider
    flagged_providers: tuple = field(default=("Silver Partners", "Unity Clinic", "Pinecrest Group"))

    def with_(self, **kw) -> "ClaimsConfig":
        return replace(self, **kw)

    @property
    def statuses(self) -> tuple:
        return (self.status_paid, self.status_denied, self.status_pending)


DEFAULT = ClaimsConfig()

# Parameters for the driver's tables: order priorities play the denial
# reasons, market segments the plan types, the data span 1995-01..2001-08.
DRIVER = DEFAULT.with_(
    focus_reason="1-URGENT",
    coding_reasons=("2-HIGH", "3-MEDIUM"),
    plan_order=("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"),
    base_year=1999,
    compare_year=2000,
    cutoff_date="2001-08-01",
    flag_pts=1.0,
    flagged_providers=(),
)
