"""Measure catalog: named measures evaluated under a filter context.

``evaluate(model, measures, group_by, filters)`` returns one row per group
with one column per measure. ``model`` is the wide claims frame (fact with
provider/patient attributes, ``provider_name`` and the calendar attributes
of ``service_date``). The filter context is the report slicers
(``filters``: list of (column, values)) plus the group-by row.

Compilation, in the spirit of a tabular engine but with plain DataFrame
operators:

* measures that only narrow the context (status, reason, date cut-off) are
  conditional aggregates in ONE ``groupBy().agg`` over the filtered fact;
* measures that *replace* a filter (a fixed year, a fixed network) are a
  second aggregate over the context without that column, joined back on
  the remaining group keys - folded into the main aggregate when the
  column is neither grouped nor filtered;
* peer rates drop every provider filter, aggregate by (claim type,
  network) and join back;
* the excess rank is distributed (``ranking.global_index``), never a
  window without a partition;
* year-to-date and the trend cut-off read the last calendar date of each
  row's context from the date dimension (bounded by the calendar span).

Measures that need different grains (peers: claim type and network; flagged
providers: the provider; year-to-date: the day; unique patients: the patient), and
subtotals and totals (``totals``), come from ONE scan of the model: ``GROUPING
SETS`` aggregate it at every grain needed, the result is written once as a table,
and all rows are rolled up from that. Unique patients roll up through bitmaps of
patient numbers, which can be merged where counts cannot.

A blank measure (aggregate over no rows) is null; rows whose measures are
all null vanish, as in a report visual.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimwise.config import DEFAULT, ClaimsConfig
from claimwise.functions import money, ratio, round_half_up
from claimwise.operators.ranking import global_index, same_keys
from claimwise.session import materialize
from claimwise.sources.calendar import DATE_COLS, dim_date_for


def provider_cols(cfg: ClaimsConfig) -> tuple[str, ...]:
    """The provider dimension's columns in the model; removing its filters
    drops them all. Its state is there only under a name of its own, as
    ``state`` is a column of patients too."""
    return (cfg.provider_id, cfg.provider_name, cfg.specialty, cfg.network, f"provider_{cfg.state}")


FLAGGED_MS = {"Flagged Providers", "Flagged Denied $", "Flagged Coding Share", "KPI Flagged $ Context"}
YEAR_MS = {"Prior Auth Denials Base", "Prior Auth Denials Compare", "Prior Auth YoY %", "Denials Base",
           "Denials Compare", "Denials YoY %", "KPI Prior Auth Context"}
NETWORK_MS = {"In-Network Denial Rate", "Out-of-Network Denial Rate", "KPI Network Context"}
RANK_MS = {"Excess Rank", "Top 10 Excess (pts)"}
PEER_MS = {"Peer Denial Rate", "Excess Denial (pts)", "Excess Flag"} | RANK_MS
PATIENT_MS = {"Unique Patients", "KPI Claims Context"}
DAY_MS = {"Paid YTD", "Denial Rate (trend)"}

# The catalog's measure names and their output columns.
MEASURES = {
    "Total Claims": "total_claims",
    "Decided Claims": "decided_claims",
    "Denied Claims": "denied_claims",
    "Unique Patients": "unique_patients",
    "Total Billed": "total_billed",
    "Total Paid": "total_paid",
    "Denied Billed $": "denied_billed",
    "Paid to Billed %": "paid_to_billed",
    "Paid YTD": "paid_ytd",
    "Denial Rate": "denial_rate",
    "Denial Rate (trend)": "denial_rate_trend",
    "Peer Denial Rate": "peer_denial_rate",
    "Excess Denial (pts)": "excess_pts",
    "Excess Rank": "excess_rank",
    "Top 10 Excess (pts)": "top10_excess_pts",
    "Excess Flag": "is_flagged",
    "Avg Days to Process": "avg_days_to_process",
    "Prior Auth Denials": "prior_auth_denials",
    "Other Denials": "other_denials",
    "Prior Auth Denials Base": "prior_auth_denials_base",
    "Prior Auth Denials Compare": "prior_auth_denials_compare",
    "Prior Auth YoY %": "prior_auth_yoy",
    "Denial Rate (complete)": "denial_rate_complete",
    "Denied Share of Billed": "denied_share_of_billed",
    "Reason Flag": "is_focus_reason",
    "In-Network Denial Rate": "in_network_denial_rate",
    "Out-of-Network Denial Rate": "out_network_denial_rate",
    "Denials Base": "denials_base",
    "Denials Compare": "denials_compare",
    "Denials YoY %": "denials_yoy",
    "Flagged Providers": "flagged_providers",
    "Flagged Denied $": "flagged_denied_billed",
    "Flagged Coding Share": "flagged_coding_share",
    "KPI Claims Context": "kpi_claims_context",
    "KPI Paid Context": "kpi_paid_context",
    "KPI Denial Context": "kpi_denial_context",
    "KPI Denied Context": "kpi_denied_context",
    "KPI Days Context": "kpi_days_context",
    "KPI Prior Auth Context": "kpi_prior_auth_context",
    "KPI Network Context": "kpi_network_context",
    "KPI Flagged $ Context": "kpi_flagged_context",
}


@dataclass(frozen=True)
class Context:
    group_by: tuple
    filters: tuple  # ((column, values), ...)

    def without(self, cols) -> "Context":
        cols = set(cols)
        return Context(tuple(g for g in self.group_by if g not in cols), tuple(f for f in self.filters if f[0] not in cols))

    def apply(self, df: DataFrame) -> DataFrame:
        for col, values in self.filters:
            df = df.where(F.col(col).isin(*values))
        return df


def _cnt(pred: Column) -> Column:
    """COUNTROWS over the rows where pred holds: blank (null) when none."""
    return F.sum(F.when(pred, F.lit(1))).cast("bigint")


def _join_back(main: DataFrame, other: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Attach a per-key aggregate (one row per key combination) to the
    result rows; with no keys both sides are one row. ``how="full"`` also
    keeps key combinations that only ``other`` has (a measure whose filter
    was replaced can be non-blank where the slicer leaves no rows)."""
    if keys:
        other = other.select(*[F.col(k).alias(f"_o_{k}") for k in keys], *[c for c in other.columns if c not in keys])
        cond = None
        for k in keys:
            c = main[k].eqNullSafe(other[f"_o_{k}"])
            cond = c if cond is None else cond & c
        out = main.join(other, cond, how)
        if how == "full":
            rest = [c for c in out.columns if c not in keys and not c.startswith("_o_")]
            return out.select(*[F.coalesce(main[k], F.col(f"_o_{k}")).alias(k) for k in keys], *rest)
        return out.drop(*[f"_o_{k}" for k in keys])
    return main.withColumn("_one", F.lit(1)).join(other.withColumn("_one", F.lit(1)), "_one", "left").drop("_one")


def _named(pairs) -> dict[str, Column]:
    """Aggregates given as (name, expression) pairs or already aliased via
    ``_as`` - kept as a name -> column mapping so they can be rolled up."""
    return dict(pairs)


def _as(col: Column, name: str):
    return name, col.alias(name)


def _grouped(df: DataFrame, keys: list[str], *aggs: Column) -> DataFrame:
    return df.groupBy(*keys).agg(*aggs) if keys else df.agg(*aggs)


class _Compiler:
    """``scope``: a slicer folded into the aggregates as a predicate (the
    rows outside it still reach the grouping, for measures that replace that
    slicer), instead of a filter on the input."""

    def __init__(self, model: DataFrame, ctx: Context, cfg: ClaimsConfig, scope: Column | None = None):
        self.model, self.ctx, self.cfg, self.scope = model, ctx, cfg, scope
        self.keys = list(ctx.group_by)
        c = cfg
        self.denied = self._s(F.col(c.status) == F.lit(c.status_denied))
        self.decided = self._s(F.col(c.status) != F.lit(c.status_pending))
        self.focus = F.col(c.reason) == F.lit(c.focus_reason)
        self.before_cut = F.col(c.service_date) < F.lit(c.cutoff_date).cast("date")

    def _s(self, pred: Column) -> Column:
        return pred if self.scope is None else self.scope & pred

    def _w(self, x) -> Column:
        x = F.col(x) if isinstance(x, str) else x
        return x if self.scope is None else F.when(self.scope, x)

    # base aggregates over the row context
    def base_aggs(self, distinct: bool = False) -> dict[str, Column]:
        """``distinct``: also count distinct patients (costs a distinct
        aggregation, so only when a measure needs it)."""
        c = self.cfg
        w = self._w
        rows = F.count(F.lit(1)) if self.scope is None else _cnt(self.scope)
        paid_status = F.col(c.status) == F.lit(c.status_paid)
        return _named([
            _as(rows, "_n"),
            _as(_cnt(self.decided), "_dec"),
            _as(_cnt(self.denied), "_den"),
            _as((F.countDistinct(w(c.patient_id)) if distinct else F.lit(None).cast("bigint")), "_pat"),
            _as(F.sum(w(c.billed)), "_billed"),
            _as(F.sum(w(c.paid)), "_paid"),
            _as(F.sum(F.when(self.denied, F.col(c.billed))), "_den_billed"),
            _as(F.sum(w("days_to_process")), "_days_sum"),
            _as(F.count(w("days_to_process")), "_days_n"),
            _as(F.sum(F.when(self.denied, F.col("days_to_process"))), "_days_den_sum"),
            _as(F.count(F.when(self.denied, F.col("days_to_process"))), "_days_den_n"),
            _as(F.sum(F.when(self._s(paid_status), F.col("days_to_process"))), "_days_paid_sum"),
            _as(F.count(F.when(self._s(paid_status), F.col("days_to_process"))), "_days_paid_n"),
            _as(_cnt(self.denied & self.focus), "_pa"),
            _as(_cnt(self.denied & self.before_cut), "_den_cut"),
            _as(_cnt(self.decided & self.before_cut), "_dec_cut"),
            _as(F.when(F.min(w(c.claim_type)) == F.max(w(c.claim_type)), F.min(w(c.claim_type))), "_type"),
            _as(F.when(F.min(w(c.network)) == F.max(w(c.network)), F.min(w(c.network))), "_net"),
        ])

    def replaced(self, column: str, aggs: dict[str, Column]) -> tuple[DataFrame | None, dict[str, Column]]:
        """Aggregates that replace the filter on ``column``: folded into the
        main aggregate when the column is free, else a separate aggregate."""
        if column not in self.ctx.group_by and all(f[0] != column for f in self.ctx.filters):
            return None, aggs
        sub = self.ctx.without([column])
        return _grouped(sub.apply(self.model), list(sub.group_by), *aggs.values()), {}

    def year_aggs(self) -> dict[str, Column]:
        c, y = self.cfg, F.col("year")
        a, b = F.lit(self.cfg.base_year), F.lit(self.cfg.compare_year)
        return _named([
            _as(_cnt(self.denied & self.focus & (y == a)), "_pa_a"),
            _as(_cnt(self.denied & self.focus & (y == b)), "_pa_b"),
            _as(_cnt(self.denied & (y == a)), "_den_a"),
            _as(_cnt(self.denied & (y == b)), "_den_b"),
        ])

    def network_aggs(self) -> dict[str, Column]:
        c = self.cfg
        inn = F.col(c.network) == F.lit(c.in_network)
        out = F.col(c.network) == F.lit(c.out_network)
        return _named([
            _as(_cnt(self.denied & inn), "_den_in"), _as(_cnt(self.decided & inn), "_dec_in"),
            _as(_cnt(self.denied & out), "_den_out"), _as(_cnt(self.decided & out), "_dec_out"),
        ])

    def peer(self, main: DataFrame, fine: DataFrame | None = None) -> DataFrame:
        """Denial rate of every provider sharing the row's claim type and
        network, under the context without provider filters. ``fine`` (the
        context aggregated by keys, claim type and network, when no provider
        filter is in force) is rolled up instead of scanning the fact again."""
        c = self.cfg
        sub = self.ctx.without(provider_cols(c) + (c.claim_type,))
        keys = list(sub.group_by)
        if fine is not None:
            p = fine.groupBy(*keys, c.claim_type, c.network).agg(F.sum("_den").alias("_pd"), F.sum("_dec").alias("_pn"))
        else:
            p = _grouped(sub.apply(self.model), keys + [c.claim_type, c.network],
                         _cnt(self.denied).alias("_pd"), _cnt(self.decided).alias("_pn"))
        p = p.select(*[F.col(k).alias(f"_p_{k}") for k in keys], F.col(c.claim_type).alias("_p_type"),
                     F.col(c.network).alias("_p_net"), ratio("_pd", "_pn").alias("_peer"))
        cond = main["_type"].eqNullSafe(p["_p_type"]) & main["_net"].eqNullSafe(p["_p_net"])
        for k in keys:
            cond = cond & main[k].eqNullSafe(p[f"_p_{k}"])
        return main.join(p, cond, "left").drop("_p_type", "_p_net", *[f"_p_{k}" for k in keys])

    def last_dates(self, main: DataFrame, days: DataFrame | None = None) -> DataFrame:
        """Last calendar date of each row's context (date filters and date
        group keys applied to the date dimension). ``days``: the service dates of all
        claims, if some aggregate has them already."""
        c = self.cfg
        cal = dim_date_for(self.model if days is None else days, c.service_date)  # every claim's year is in it
        for col, values in self.ctx.filters:
            if col in DATE_COLS:
                cal = cal.where(F.col(col).isin(*values))
        dkeys = [k for k in self.keys if k in DATE_COLS]
        lastd = _grouped(cal, dkeys, F.max("date").alias("_last"))
        return _join_back(main, lastd, dkeys)

    def ytd(self, main: DataFrame, per_day: DataFrame | None = None) -> DataFrame:
        """TOTALYTD(Total Paid): paid from 1 January of the year of the
        context's last date up to that date; date filters are replaced.
        ``per_day`` (non-date keys, service date, paid) may be supplied."""
        c = self.cfg
        sub = self.ctx.without(DATE_COLS)
        nkeys = list(sub.group_by)
        if per_day is None:
            per_day = _grouped(sub.apply(self.model), nkeys + [c.service_date], F.sum(c.paid).alias("_dp"))
        # days and rows in one running sum per (keys, year): at most 366 days each
        days = per_day.select(*nkeys, F.col(c.service_date).alias("_d"), "_dp", F.lit(False).alias("_row"))
        rows = main.select(*self.keys, F.col("_last").alias("_d"), F.lit(True).alias("_row")).distinct()
        upto = Window.partitionBy(*nkeys, F.year("_d")).orderBy("_d")
        ytd = days.unionByName(rows, allowMissingColumns=True).withColumn("_ytd", F.sum("_dp").over(upto))
        return _join_back(main, ytd.where("_row").select(*self.keys, "_ytd"), self.keys)

    def coding(self) -> Column:
        c = self.cfg
        return _cnt(self.denied & F.col(c.reason).isin(*c.coding_reasons)).alias("_coding")

    def flagged(self, main: DataFrame, flag_pts: float, fine: DataFrame | None = None) -> DataFrame:
        """Providers (by name) in each row's context whose excess over peers
        is >= ``flag_pts``: count, their denied billed, coding share. ``fine`` (the
        context by keys, provider, claim type and network) is rolled up twice; where a
        provider filter is in force, peers need a pass without it."""
        c = self.cfg
        pk = self.keys + [c.provider_name]
        sub = Context(tuple(pk), self.ctx.filters)
        inner = _Compiler(self.model, sub, c)
        if fine is None:
            prov = inner.peer(_grouped(sub.apply(self.model), pk, *{**inner.base_aggs(), "_coding": inner.coding()}.values()))
        else:
            prov = inner.peer(_rolled(fine, pk, ["_den", "_dec", "_den_billed", "_coding"], c), fine)
        rate = ratio("_den", "_dec")
        ex = F.when(rate.isNotNull(), (rate - F.col("_peer")) * F.lit(100.0))
        fl = prov.where(ex >= F.lit(flag_pts))
        agg = _grouped(fl, self.keys, F.count(F.lit(1)).alias("_fl_n"), F.sum("_den_billed").alias("_fl_billed"),
                       F.sum("_coding").alias("_fl_coding"), F.sum("_den").alias("_fl_den"))
        return _join_back(main, agg, self.keys)


def _rolled(fine: DataFrame, keys: list[str], sums: list[str], cfg: ClaimsConfig) -> DataFrame:
    """Additive columns of a finer aggregate rolled up to ``keys``; claim type and
    network of the row where it has just one."""
    one = [F.when(F.min(c) == F.max(c), F.min(c)).alias(n) if c in fine.columns else F.lit(None).cast("string").alias(n)
           for c, n in ((cfg.claim_type, "_type"), (cfg.network, "_net"))]
    return _grouped(fine, keys, *[F.sum(n).alias(n) for n in sums], *one)


class _Scan:
    """One pass over the model at every grain that the measures need.

    ``rows``: group keys (with claim type and network for peers, and the provider for
    flags); ``days``: keys that are no dates, and the service day; ``members``: keys and
    patient. A slicer that some measure replaces is a predicate inside the
    aggregates of the others instead of a filter; so are date slicers if a
    measure looks at days. ``names``: the additive columns of ``rows``."""

    def __init__(self, model: DataFrame, ctx: Context, ms: set[str], cfg: ClaimsConfig):
        self.model, self.ctx, self.cfg = model, ctx, cfg
        self.families = [(col, fam, builder) for col, fam, builder in (("year", YEAR_MS, "year_aggs"), (cfg.network, NETWORK_MS, "network_aggs")) if ms & fam]
        replaced = {col for col, _, _ in self.families} | (set(DATE_COLS) if ms & DAY_MS else set())
        self.fold = [col for col, _ in ctx.filters if col in replaced]
        compiled = lambda scope: _Compiler(model, ctx, cfg, scope=scope)
        own = compiled(self._scope())
        aggs = {n: a for n, a in own.base_aggs().items() if n not in ("_type", "_net", "_pat")}
        self.of_family = {}
        for col, _, builder in self.families:
            more = getattr(compiled(self._scope(lambda c, col=col: c != col)), builder)()
            self.of_family[col] = list(more)
            aggs |= more
        keys = list(ctx.group_by)
        grain = keys + [k for k in (cfg.claim_type, cfg.network) if ms & (PEER_MS | FLAGGED_MS) and k not in keys]
        if ms & FLAGGED_MS:
            aggs["_coding"] = own.coding()
            grain += [cfg.provider_name] if cfg.provider_name not in grain else []
        self.names = list(aggs)
        sets = {"rows": grain}
        if ms & DAY_MS:
            sets["days"] = [k for k in keys if k not in DATE_COLS] + [cfg.service_date]
            other = self._scope(lambda c: c not in DATE_COLS)
            aggs["_dp"] = F.sum(F.col(cfg.paid) if other is None else F.when(other, F.col(cfg.paid))).alias("_dp")
        if ms & PATIENT_MS:
            sets["members"] = keys + [cfg.patient_id]
        got = self._aggregate(ctx.without(self.fold).apply(model), sets, list(aggs.values()))
        self.rows = got["rows"].select(*sets["rows"], *self.names)
        self.days = got["days"].select(*sets["days"], "_dp") if "days" in got else None
        self.members = None
        if "members" in got:
            seen = got["members"].where(F.col(cfg.patient_id).isNotNull() & (F.col("_n") > 0))
            self.members = seen.select(*sets["members"])
        self.bits: DataFrame | None = None
        self.span: DataFrame | None = None

    def _scope(self, keep=lambda col: True) -> Column | None:
        pred = None
        for col, values in self.ctx.filters:
            if col in self.fold and keep(col):
                p = F.col(col).isin(*values)
                pred = p if pred is None else pred & p
        return pred

    @staticmethod
    def _aggregate(rows: DataFrame, sets: dict[str, list[str]], aggs: list[Column]) -> dict[str, DataFrame]:
        """Each grain's rows of one table. A grain's id has a bit for each column
        that it leaves out, the first column's bit the highest."""
        columns = list(dict.fromkeys(c for keys in sets.values() for c in keys))
        if len(sets) == 1:
            return {n: materialize(_grouped(rows, keys, *aggs)) for n, keys in sets.items()}
        table = materialize(rows.groupingSets(list(sets.values()), *columns).agg(F.grouping_id().alias("_grain"), *aggs))
        return {n: table.where(F.col("_grain") == _level(columns, keys)) for n, keys in sets.items()}

    def main(self, keys: list[str]) -> DataFrame:
        """The rows of one set of keys."""
        main = _rolled(self.rows, keys, self.names, self.cfg)
        for col, values in self.ctx.filters:
            if col in self.fold and col in keys:  # rows of values beyond the slicer
                main = main.where(F.col(col).isin(*values))
        for col, names in self.of_family.items():
            if col in keys:  # the measure replaces the row's own value
                others = [k for k in keys if k != col]
                main = _join_back(main.drop(*names), _grouped(self.rows, others, *[F.sum(n).alias(n) for n in names]), others)
        main = main.withColumn("_pat", F.lit(None).cast("bigint")) if self.members is None else self._with_patients(main, keys)
        return main

    def _with_patients(self, main: DataFrame, keys: list[str]) -> DataFrame:
        if keys == list(self.ctx.group_by):
            return _join_back(main, _grouped(self.members, keys, F.count(F.lit(1)).alias("_pat")), keys)
        if self.bits is None:
            self.bits = patient_bitmaps(self.members, list(self.ctx.group_by), self.cfg.patient_id)
        merged = self.bits.groupBy(*keys, "_bucket").agg(F.bitmap_count(F.bitmap_or_agg("_bits")).alias("_pat"))
        return _join_back(main, _grouped(merged, keys, F.sum("_pat").alias("_pat")), keys)

    def all_days(self) -> DataFrame:
        """Service dates with the first and the last of all claims: the days of the scan,
        or where a filter has left out claims, two rows from a pass of its own."""
        if self.span is None:
            whole = self.days is not None and all(col in self.fold for col, _ in self.ctx.filters)
            c = self.cfg.service_date
            self.span = self.days if whole else materialize(self.model.agg(F.array(F.min(c), F.max(c)).alias("a")).select(F.explode("a").alias(c)))
        return self.span

    def per_day(self, keys: list[str]) -> DataFrame | None:
        return None if self.days is None else _grouped(self.days, [k for k in keys if k not in DATE_COLS] + [self.cfg.service_date], F.sum("_dp").alias("_dp"))


def _level(columns: list[str], keys) -> int:
    return sum(1 << (len(columns) - 1 - i) for i, c in enumerate(columns) if c not in keys)


DENSE = 64  # numbers a bitmap spans for each member in it, at most


def patient_bitmaps(members: DataFrame, keys: list[str], patient: str) -> DataFrame:
    """Distinct (keys, patient) as mergeable sets: keys, ``_bucket`` and a bitmap of the
    patient numbers in it. Integer ids that lie close together are their own numbers;
    other ids (texts, or integers far apart) are numbered by a dictionary of the
    distinct ids, so each bitmap of 4 KB is well filled."""
    integral = isinstance(members.schema[patient].dataType, T.IntegralType)
    span = None
    if integral:
        low, high, n = members.agg(F.min(patient), F.max(patient), F.count(F.lit(1))).first()
        span = int(high) - int(low) if n else 0
    if span is not None and span <= DENSE * max(n, 1):
        numbered = members.withColumn("_number", F.col(patient).cast("long"))
    else:
        ids = global_index(members.select(F.col(patient).alias("_id")).distinct(), [F.asc("_id")], "_number")
        numbered = members.join(ids, members[patient] == ids["_id"]).drop("_id")
    bucket = F.bitmap_bucket_number("_number").alias("_bucket")
    return materialize(numbered.groupBy(*keys, bucket).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_number")).alias("_bits")))


def evaluate(model: DataFrame, measures: list[str], group_by: list[str] | tuple = (),
             filters: list | tuple = (), cfg: ClaimsConfig = DEFAULT, drop_blank: bool = True,
             flag_pts: float | None = None, totals: list | None = None) -> DataFrame:
    """Evaluate named measures per group under the slicer ``filters``.

    ``totals``: the sets of group keys to give rows for, such as ``[("a", "b"),
    ("a",), ()]`` for rows, subtotals by ``a`` and the grand total. A key that a row's set
    leaves out is null there, and ``level`` is its ``grouping_id`` (a bit for each
    key left out, the first key's the highest). Each row is what ``evaluate`` gives for
    those keys alone; a peer rate is blank where a row spans several peer groups."""
    unknown = [m for m in measures if m not in MEASURES]
    if unknown:
        raise KeyError(f"unknown measures: {unknown}")
    flag_pts = cfg.flag_pts if flag_pts is None else flag_pts
    ctx = Context(tuple(group_by), tuple((col, tuple(v)) for col, v in filters))
    ms = set(measures)
    provider_filtered = any(f[0] in provider_cols(cfg) + (cfg.claim_type,) for f in ctx.filters)
    if totals is None and "Paid YTD" not in ms and (provider_filtered or not ms & (PEER_MS | FLAGGED_MS)):
        main, comp = _one_grain(model, ctx, ms, cfg)
        return _finish(main, comp, measures, cfg, drop_blank, flag_pts)
    scan = _Scan(model, ctx, ms, cfg)
    fine = None if provider_filtered else scan.rows
    if totals is None:
        comp = _Compiler(model, ctx, cfg)
        return _finish(scan.main(comp.keys), comp, measures, cfg, drop_blank, flag_pts, fine, scan)
    out = None
    for keys in totals:
        if not set(keys) <= set(group_by):
            raise ValueError(f"{keys} has keys that are not grouped by")
        comp = _Compiler(model, Context(tuple(k for k in group_by if k in keys), ctx.filters), cfg)
        part = _finish(scan.main(comp.keys), comp, measures, cfg, drop_blank, flag_pts, fine, scan)
        given = [F.col(k) if k in comp.keys else F.lit(None).cast(model.schema[k].dataType).alias(k) for k in group_by]
        part = part.select(*given, F.lit(_level(list(group_by), comp.keys)).cast("bigint").alias("level"), *[c for c in part.columns if c not in group_by])
        out = part if out is None else out.unionByName(part)
    return out


def _one_grain(model: DataFrame, ctx: Context, ms: set[str], cfg: ClaimsConfig) -> tuple[DataFrame, _Compiler]:
    """Measures that all live at the grain of the keys: one plain aggregate, and one
    more for each grouped column that a measure replaces."""
    keys = list(ctx.group_by)
    # a slicer on a column that some requested measure replaces, and that is
    # not grouped: fold it into the other aggregates as a predicate, so one
    # pass over the unsliced context serves both kinds of measure
    families = [(col, builder) for col, fam, builder in (("year", YEAR_MS, "year_aggs"), (cfg.network, NETWORK_MS, "network_aggs")) if ms & fam]
    fold = [col for col, _ in families if col not in keys and any(f[0] == col for f in ctx.filters)]

    def scope(exclude=None):
        pred = None
        for col, values in ctx.filters:
            if col in fold and col != exclude:
                p = F.col(col).isin(*values)
                pred = p if pred is None else pred & p
        return pred

    comp = _Compiler(model, ctx, cfg, scope=scope())
    aggs = comp.base_aggs(distinct=bool(ms & PATIENT_MS))  # name -> column
    extra = []
    for col, builder in families:
        if col in fold:
            aggs.update(getattr(_Compiler(model, ctx, cfg, scope=scope(exclude=col)), builder)())
        else:
            sep, folded = comp.replaced(col, getattr(comp, builder)())
            aggs.update(folded)
            if sep is not None:
                extra.append((sep, [k for k in keys if k != col]))
    main = _grouped(ctx.without(fold).apply(model), keys, *aggs.values())
    for sep, k in extra:
        # the replaced column is grouped, so its value is fixed by the row
        main = _join_back(main, sep, k, "full" if len(k) == len(keys) else "left")
    return main, comp


def _finish(main: DataFrame, comp: _Compiler, measures: list[str], cfg: ClaimsConfig, drop_blank: bool, flag_pts: float,
            fine: DataFrame | None = None, scan: _Scan | None = None) -> DataFrame:
    """The measures of aggregated rows; ``fine`` and ``scan`` are what peers, flags and
    dates may be rolled up from."""
    ms, keys = set(measures), comp.keys
    if ms & PEER_MS:
        main = comp.peer(main, fine)
    if ms & DAY_MS:
        main = comp.last_dates(main, scan and scan.all_days())
    if "Paid YTD" in ms:
        main = comp.ytd(main, scan and scan.per_day(comp.keys))
    if ms & FLAGGED_MS:
        main = comp.flagged(main, flag_pts, fine)

    rate = ratio("_den", "_dec")
    excess = F.when(rate.isNotNull(), (rate - F.col("_peer")) * F.lit(100.0))
    if ms & RANK_MS:
        main = _rank(main.withColumn("_excess", excess), cfg, keys)

    def diff(a, b):
        return F.when(F.col(a).isNull() & F.col(b).isNull(), F.lit(None)).otherwise(
            F.coalesce(F.col(a), F.lit(0)) - F.coalesce(F.col(b), F.lit(0))
        )

    def pct_text(x, k):
        v = round_half_up(x * F.lit(100.0), k)
        return F.coalesce(F.concat(F.format_string(f"%.{k}f", v), F.lit("%")), F.lit(""))

    def int_text(x):
        return F.coalesce(F.format_number(x, 0), F.lit(""))

    days = lambda s, n: ratio(s, n)
    yoy_pa = ratio(diff("_pa_b", "_pa_a"), "_pa_a") if ms & YEAR_MS else None
    yoy_den = ratio(diff("_den_b", "_den_a"), "_den_a") if ms & YEAR_MS else None
    exprs = {
        "Total Claims": F.col("_n"),
        "Decided Claims": F.col("_dec"),
        "Denied Claims": F.col("_den"),
        "Unique Patients": F.col("_pat"),
        "Total Billed": money("_billed", 2),
        "Total Paid": money("_paid", 2),
        "Denied Billed $": money("_den_billed", 2),
        "Paid to Billed %": round_half_up(ratio("_paid", "_billed"), 4),
        "Denial Rate": round_half_up(rate, 4),
        "Avg Days to Process": round_half_up(days("_days_sum", "_days_n"), 2),
        "Prior Auth Denials": F.col("_pa"),
        "Other Denials": diff("_den", "_pa"),
        "Denial Rate (complete)": round_half_up(ratio("_den_cut", "_dec_cut"), 4),
        "Denied Share of Billed": round_half_up(ratio("_den_billed", "_billed"), 4),
        "KPI Claims Context": F.concat(int_text(F.col("_pat")), F.lit(" patients")),
        "KPI Paid Context": F.concat(pct_text(ratio("_paid", "_billed"), 0), F.lit(" of billed charges")),
        "KPI Denial Context": F.concat(int_text(F.col("_den")), F.lit(" of "), int_text(F.col("_dec")), F.lit(" decided")),
        "KPI Denied Context": F.concat(pct_text(ratio("_den_billed", "_billed"), 1), F.lit(" of all billed charges")),
        "KPI Days Context": F.concat(
            F.lit("denied: "), F.coalesce(F.format_string("%.0f", round_half_up(days("_days_den_sum", "_days_den_n"), 0)), F.lit("")),
            F.lit(" days  ·  paid: "),
            F.coalesce(F.format_string("%.0f", round_half_up(days("_days_paid_sum", "_days_paid_n"), 0)), F.lit("")),
        ),
    }
    if ms & YEAR_MS:
        exprs.update({
            "Prior Auth Denials Base": F.col("_pa_a"),
            "Prior Auth Denials Compare": F.col("_pa_b"),
            "Prior Auth YoY %": round_half_up(yoy_pa, 4),
            "Denials Base": F.col("_den_a"),
            "Denials Compare": F.col("_den_b"),
            "Denials YoY %": round_half_up(yoy_den, 4),
            "KPI Prior Auth Context": F.concat(F.lit("vs "), int_text(F.col("_pa_a")), F.lit(f" in {cfg.base_year}")),
        })
    if ms & NETWORK_MS:
        exprs.update({
            "In-Network Denial Rate": round_half_up(ratio("_den_in", "_dec_in"), 4),
            "Out-of-Network Denial Rate": round_half_up(ratio("_den_out", "_dec_out"), 4),
            "KPI Network Context": F.concat(F.lit("vs "), pct_text(ratio("_den_in", "_dec_in"), 1), F.lit(" in-network")),
        })
    if ms & PEER_MS:
        exprs.update({
            "Peer Denial Rate": round_half_up(F.col("_peer"), 4),
            "Excess Denial (pts)": round_half_up(excess, 2),
            "Excess Flag": excess >= F.lit(flag_pts),
        })
    if ms & RANK_MS:
        exprs["Excess Rank"] = F.col("_rank")
        exprs["Top 10 Excess (pts)"] = F.when(F.col("_rank") <= 10, round_half_up(excess, 2))
    if "Paid YTD" in ms:
        exprs["Paid YTD"] = money("_ytd", 2)
    if "Denial Rate (trend)" in ms:
        exprs["Denial Rate (trend)"] = F.when(F.col("_last") < F.lit(cfg.cutoff_date).cast("date"), round_half_up(rate, 4))
    if cfg.reason in keys:
        exprs["Reason Flag"] = F.col(cfg.reason) == F.lit(cfg.focus_reason)
    if ms & FLAGGED_MS:
        exprs.update({
            "Flagged Providers": F.when(F.col("_fl_n") > 0, F.col("_fl_n")),
            "Flagged Denied $": money("_fl_billed", 2),
            "Flagged Coding Share": round_half_up(ratio("_fl_coding", "_fl_den"), 4),
            "KPI Flagged $ Context": F.concat(pct_text(ratio("_fl_billed", "_den_billed"), 1), F.lit(" of all denied charges")),
        })
    missing = [m for m in measures if m not in exprs]
    if missing:
        raise ValueError(f"measures need another grouping: {missing}")
    out = main.select(*keys, *[exprs[m].alias(MEASURES[m]) for m in measures])
    if drop_blank and measures:
        flags = {"Reason Flag", "Excess Flag"}
        value_cols = [MEASURES[m] for m in measures if m not in flags]
        if value_cols:
            cond = None
            for col in value_cols:
                cnd = F.col(col).isNotNull()
                cond = cnd if cond is None else cond | cnd
            out = out.where(cond)
    return out


def _rank(main: DataFrame, cfg: ClaimsConfig, keys: list[str]) -> DataFrame:
    """RANKX over the providers by excess desc (blank = 0) within the rest of
    the row's context, so ranks start anew for each value of the other keys;
    ties share a rank and the next rank is skipped. Distributed: a global
    sort gives positions; a value's rank is its first position less the
    first of its context. Without a provider per row the rank is blank."""
    if cfg.provider_name not in keys:
        return main.withColumn("_rank", F.lit(None).cast("bigint"))
    other = [k for k in keys if k != cfg.provider_name]
    main = main.withColumn("_rv", F.coalesce(F.col("_excess"), F.lit(0.0)))
    order = [*(F.col(k).asc_nulls_first() for k in other), F.col("_rv").desc(), F.col(cfg.provider_name).asc()]
    ranked = global_index(main, order, "_pos")
    first = ranked.groupBy(*other, "_rv").agg(F.min("_pos").alias("_first"))
    start = first.groupBy(*other).agg(F.min("_first").alias("_start"))
    out = same_keys(same_keys(ranked, first, [*other, "_rv"]), start, other)
    return out.withColumn("_rank", F.col("_first") - F.col("_start") + 1).drop("_rv", "_pos", "_first", "_start")
