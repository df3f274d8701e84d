"""Claims star schema derived from the driver's TPC-H-like parquet tables.

The claims fact is ``lineitem JOIN orders`` (plus ``part`` for procedure and
diagnosis codes when a query asks for them); patients come from
``customer``, providers from ``supplier -> nation -> region``. Every column
is a deterministic built-in expression, so the same view is written in
DuckDB SQL by ``claimwise.plans.oracle``. Fact joins carry no blind hints: AQE decides between broadcast and shuffle joins at run
time, which keeps the plan valid when the dimensions are themselves large;
dimensions are broadcast only if their files are small enough
(``claimwise.sources.joins``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimwise.session import PreparedForMany, materialize, prepared
from claimwise.sources.joins import checked_broadcast

MONEY = "decimal(18,2)"
RATE = "decimal(4,2)"

BIRTH_ORIGIN = "1930-01-01"
ENROLL_ORIGIN = "2010-01-01"
NETWORK_ACCTBAL = 5000.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A base table; every call lists its files anew, so rows that were added
    are seen."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Tables:
    """The base tables of one query: each is listed once, when it is first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self._read = spark, sf_dir, {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._read:
            self._read[name] = table(self.spark, self.sf_dir, name)
        return self._read[name]


def status_expr(returnflag, linestatus):
    return (
        F.when((returnflag == "R") & (linestatus == "F"), F.lit("Denied"))
        .when((returnflag == "N") & (linestatus == "F"), F.lit("Pending"))
        .otherwise(F.lit("Paid"))
    )


def providers(spark: SparkSession, sf_dir: str, t: Tables | None = None) -> DataFrame:
    """provider_id, provider_name, specialty, state, network_status, claim_type."""
    t = t or Tables(spark, sf_dir)
    s = t["supplier"].select("s_suppkey", "s_name", "s_nationkey", "s_acctbal")
    n = t["nation"].select("n_nationkey", "n_name", "n_regionkey")
    r = t["region"].select("r_regionkey", "r_name")
    geo = n.join(checked_broadcast(r, t["region"]), n.n_regionkey == r.r_regionkey)
    geo = checked_broadcast(geo, t["nation"])
    return s.join(geo, s.s_nationkey == geo.n_nationkey).select(
        F.col("s_suppkey").alias("provider_id"),
        F.col("s_name").alias("provider_name"),
        F.col("n_name").alias("specialty"),
        F.col("n_name").alias("state"),
        F.when(F.col("s_acctbal") >= NETWORK_ACCTBAL, F.lit("In-Network"))
        .otherwise(F.lit("Out-of-Network"))
        .alias("network_status"),
        F.col("r_name").alias("claim_type"),
    )


def patients(spark: SparkSession, sf_dir: str, t: Tables | None = None) -> DataFrame:
    """patient_id, gender, date_of_birth, state, plan_type, enrollment_date."""
    t = t or Tables(spark, sf_dir)
    c = t["customer"].select("c_custkey", "c_nationkey", "c_mktsegment")
    n = checked_broadcast(t["nation"].select("n_nationkey", "n_name"), t["nation"])
    k = F.col("c_custkey")
    return c.join(n, c.c_nationkey == n.n_nationkey, "left").select(
        k.alias("patient_id"),
        F.when(k % 2 == 0, F.lit("Female")).otherwise(F.lit("Male")).alias("gender"),
        F.date_add(F.lit(BIRTH_ORIGIN).cast("date"), ((k * 37) % 23000).cast("int")).alias("date_of_birth"),
        F.col("n_name").alias("state"),
        F.col("c_mktsegment").alias("plan_type"),
        F.date_add(F.lit(ENROLL_ORIGIN).cast("date"), ((k * 11) % 3650).cast("int")).alias("enrollment_date"),
    )


def _raw_fact(t: Tables, codes: bool) -> DataFrame:
    li = t["lineitem"].select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
        "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
    )
    o = t["orders"].select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    f = li.join(o, li.l_orderkey == o.o_orderkey)
    if codes:
        p = checked_broadcast(t["part"].select("p_partkey", "p_brand", "p_type"))
        f = f.join(p, f.l_partkey == p.p_partkey)
    return f


def _figures(f: DataFrame) -> DataFrame:
    """Add what several columns need: status, service and submission day, billed and
    allowed amount. As columns of their own they are computed once a row; inlined, the
    branches of each CASE would convert the same doubles to decimals again."""
    f = f.withColumns({
        "_status": status_expr(F.col("l_returnflag"), F.col("l_linestatus")),
        "_service": F.col("o_orderdate").cast("date"),
        "_billed": F.col("l_extendedprice").cast(MONEY),
    })
    mult = F.when(F.col("l_linenumber") == 7, F.lit(3)).otherwise(F.lit(1))
    kept = F.lit(1).cast(RATE) - F.col("l_discount").cast(RATE)
    zero = F.lit(0).cast(MONEY)
    return f.withColumns({
        "_submission": F.date_add("_service", F.col("l_quantity").cast("int") * mult),
        "_allowed": F.when(F.col("_status") == "Denied", zero).otherwise(F.round(F.col("_billed") * kept, 2).cast(MONEY)),
    })


def _claim_id() -> Column:
    return F.concat_ws(
        "-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"),
        F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"),
        F.col("l_shipdate").cast("date").cast("string"),
    )


def _processed() -> Column:
    return F.when(F.col("_status") != "Pending", F.date_add("_submission", (F.col("l_partkey") % 60).cast("int") + 1))


def _paid() -> Column:
    kept = F.lit(1).cast(RATE) - F.col("l_tax").cast(RATE)
    return F.when(F.col("_status") == "Paid", F.round(F.col("_allowed") * kept, 2).cast(MONEY)).otherwise(F.lit(0).cast(MONEY))


def fact_exprs(codes: bool) -> dict:
    """The fact columns as expressions over lineitem x orders (x part) with ``_figures``."""
    out = {
        "claim_id": _claim_id(),
        "patient_id": F.col("o_custkey"),
        "provider_id": F.col("l_suppkey"),
        "service_date": F.col("_service"),
        "submission_date": F.col("_submission"),
        "processed_date": _processed(),
    }
    if codes:
        out["diagnosis_category"] = F.col("p_type")
        out["cpt_code"] = F.col("p_brand")
    out.update({
        "billed_amount": F.col("_billed"),
        "allowed_amount": F.col("_allowed"),
        "paid_amount": _paid(),
        "claim_status": F.col("_status"),
        "denial_reason": F.when(F.col("_status") == "Denied", F.col("o_orderpriority")).otherwise(F.lit("Not Applicable")),
        "billed_imputed": F.lit(False),
    })
    return out


def claims(spark: SparkSession, sf_dir: str, codes: bool = False, claim_type: bool = True, t: Tables | None = None) -> DataFrame:
    """The claims fact (15 columns of the reference's fact table, minus
    ``cpt_code``/``diagnosis_category`` unless ``codes``; ``claim_type``
    comes from the provider and needs the provider join)."""
    t = t or Tables(spark, sf_dir)

    def fact():
        return _figures(_raw_fact(t, codes)).select(*[v.alias(k) for k, v in fact_exprs(codes).items()])

    f = prepared(sf_dir, f"claims, codes {codes}", fact)
    if not claim_type:
        return f
    pr = checked_broadcast(providers(spark, sf_dir, t).select(F.col("provider_id").alias("_pid"), "claim_type"), t["supplier"])
    after = f.columns.index("processed_date") + 1
    return f.join(pr, f.provider_id == pr._pid, "left").select(*f.columns[:after], "claim_type", *f.columns[after:])


def model(spark: SparkSession, sf_dir: str, codes: bool = False, with_patients: bool = True,
          with_providers: bool = True) -> "Star":
    t = Tables(spark, sf_dir)
    return Star(
        claims=claims(spark, sf_dir, codes=codes, claim_type=with_providers, t=t),
        patients=patients(spark, sf_dir, t) if with_patients else None,
        providers=providers(spark, sf_dir, t).drop("claim_type") if with_providers else None,
        tables=t,
    )


def wide(spark: SparkSession, sf_dir: str, codes: bool = False, with_patients: bool = True,
         with_providers: bool = True, keep_name: bool = False, t: Tables | None = None) -> DataFrame:
    """Wide claims in one pass: the provider join that supplies ``claim_type``
    also supplies specialty/network (and the name when ``keep_name``), so the
    fact meets the supplier dimension once. In a run of many queries all of it is joined
    once, and each query reads the columns that it asks for."""
    t = t or Tables(spark, sf_dir)
    if isinstance(sf_dir, PreparedForMany) and not codes:
        stored = prepared(sf_dir, "wide claims", lambda: _stored_wide(spark, sf_dir, t), write=False)
        if stored is not None:
            unasked = [] if with_providers else ["claim_type", "specialty", "network_status"]
            unasked += [] if with_providers and keep_name else ["provider_name"]
            unasked += [] if with_patients else ["plan_type", "age_at_service", "age_group"]
            return stored.drop(*unasked)
    return _joined(spark, sf_dir, codes, with_patients, with_providers, keep_name, t)


def _stored_wide(spark: SparkSession, sf_dir: str, t: Tables) -> DataFrame | None:
    """Claims with all columns that ``wide`` may be asked for, as a table; none if a claim is
    in it more than once (a key of a dimension repeats), since a query that does not ask
    for that dimension has each claim once. A left join loses no claim, so counts tell."""
    stored = materialize(_joined(spark, sf_dir, False, True, True, True, t))
    return stored if stored.count() == claims(spark, sf_dir, claim_type=False, t=t).count() else None


def _joined(spark: SparkSession, sf_dir: str, codes: bool, with_patients: bool, with_providers: bool, keep_name: bool, t: Tables) -> DataFrame:
    f = claims(spark, sf_dir, codes=codes, claim_type=False, t=t)
    if with_providers:
        pr = providers(spark, sf_dir, t)
        keep = ["claim_type", "specialty", "network_status"] + (["provider_name"] if keep_name else [])
        pr = checked_broadcast(pr.select(F.col("provider_id").alias("_pid"), *keep), t["supplier"])
        f = f.join(pr, f.provider_id == pr._pid, "left").drop("_pid")
    if with_patients:
        pa = patients(spark, sf_dir, t).select(F.col("patient_id").alias("_cid"), "date_of_birth", "plan_type")
        pa = checked_broadcast(pa, t["customer"].select("c_custkey", "c_mktsegment"))
        f = f.join(pa, f.patient_id == pa._cid, "left").drop("_cid")
    from claimwise.operators.features import derive_features

    return derive_features(f, has_patients=with_patients)


class Star:
    """Fact plus the two dimensions, and the tables they are made from."""

    def __init__(self, claims: DataFrame, patients: DataFrame | None, providers: DataFrame | None, tables: Tables | None = None):
        self.claims = claims
        self.patients = patients
        self.providers = providers
        self.tables = tables


# ---------------------------------------------------------------- raw (dirty) exports
# A deterministic "messy export" of the same star, with the fault kinds of the
# reference's raw files (FIXTURES.md section 4): mixed date spellings, status
# casing, missing/negative billed amounts, blank reasons, exact duplicate rows,
# coded genders, missing states and padded upper-case specialties. Dates are
# text, as a CSV export would carry them.

def raw_claims(spark: SparkSession, sf_dir: str, t: Tables | None = None) -> DataFrame:
    return prepared(sf_dir, "raw claims", lambda: _raw_claims(spark, sf_dir, t or Tables(spark, sf_dir)))


def _raw_claims(spark: SparkSession, sf_dir: str, t: Tables) -> DataFrame:
    f = _raw_fact(t, codes=True)
    pr = checked_broadcast(providers(spark, sf_dir, t).select(F.col("provider_id").alias("_pid"), "claim_type"), t["supplier"])
    f = f.join(pr, f.l_suppkey == pr._pid, "left")
    f = _figures(f)
    status, service, billed = F.col("_status"), F.col("_service"), F.col("_billed")
    pk = F.col("l_partkey")
    raw_status = (
        F.when(F.col("l_linenumber") == 3, F.upper(status))
        .when(F.col("l_linenumber") == 5, F.concat(F.lit(" "), F.lower(status), F.lit(" ")))
        .otherwise(status)
    )
    raw_service = F.when(pk % 20 == 0, F.date_format(service, "MM/dd/yyyy")).otherwise(service.cast("string"))  # ISO, as all casts of dates
    raw_billed = F.when(pk % 400 == 7, F.lit(None).cast(MONEY)).when(pk % 1000 == 11, (-billed).cast(MONEY)).otherwise(billed)
    out = f.select(
        _claim_id().alias("claim_id"),
        F.col("o_custkey").alias("patient_id"),
        F.col("l_suppkey").alias("provider_id"),
        raw_service.alias("service_date"),
        F.col("_submission").cast("string").alias("submission_date"),
        _processed().cast("string").alias("processed_date"),
        F.col("claim_type"),
        F.col("p_type").alias("diagnosis_category"),
        F.col("p_brand").alias("cpt_code"),
        raw_billed.alias("billed_amount"),
        F.col("_allowed").alias("allowed_amount"),
        _paid().alias("paid_amount"),
        raw_status.alias("claim_status"),
        F.when(status == "Denied", F.col("o_orderpriority")).alias("denial_reason"),
        # every row once, rows of every 67th supplier twice (exact duplicates)
        F.explode(F.when(F.col("l_suppkey") % 67 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("_copy"),
    )
    return out.drop("_copy")


def raw_patients(spark: SparkSession, sf_dir: str, t: Tables | None = None) -> DataFrame:
    t = t or Tables(spark, sf_dir)
    c = t["customer"].select("c_custkey", "c_nationkey", "c_mktsegment")
    n = t["nation"].select("n_nationkey", "n_name")
    k = F.col("c_custkey")
    codes = F.array(*[F.lit(v) for v in ("F", "M", "Female", "female", " f", "M ")])
    n = checked_broadcast(n)
    return c.join(n, c.c_nationkey == n.n_nationkey, "left").select(
        k.alias("patient_id"),
        F.element_at(codes, (k % 6 + 1).cast("int")).alias("gender"),
        F.date_format(F.date_add(F.lit(BIRTH_ORIGIN).cast("date"), ((k * 37) % 23000).cast("int")), "yyyy-MM-dd").alias("date_of_birth"),
        F.when(k % 100 == 0, F.lit(None).cast("string")).otherwise(F.col("n_name")).alias("state"),
        F.col("c_mktsegment").alias("plan_type"),
        F.date_format(F.date_add(F.lit(ENROLL_ORIGIN).cast("date"), ((k * 11) % 3650).cast("int")), "yyyy-MM-dd").alias("enrollment_date"),
    )


def raw_providers(spark: SparkSession, sf_dir: str, t: Tables | None = None) -> DataFrame:
    p = providers(spark, sf_dir, t)
    padded = F.when(F.col("provider_id") % 8 == 0, F.concat(F.lit(" "), F.col("specialty"), F.lit(" "))).otherwise(F.col("specialty"))
    return p.select("provider_id", "provider_name", padded.alias("specialty"), "state", "network_status")
