"""Readers and writers: raw CSV stays text, clean tables round-trip,
the star loads as tables, query results are written per key."""

from claimwise.schema import RAW_PROVIDERS
from claimwise.sources import files, tpch
from conftest import SF_SMALL


def test_raw_csv_keeps_text_and_cleans(spark, tmp_path):
    raw = tpch.raw_providers(spark, SF_SMALL).selectExpr("cast(provider_id as string) provider_id", "provider_name",
                                                        "specialty", "state", "network_status")
    path = str(tmp_path / "providers_csv")
    raw.write.option("header", True).csv(path)
    back, lost = files.split_corrupt(files.read_raw(spark, path, RAW_PROVIDERS))
    assert lost.count() == 0
    assert [f.dataType.simpleString() for f in back.schema.fields] == ["string"] * 5
    assert back.count() == raw.count()


def test_write_clean(spark, tmp_path):
    m = tpch.model(spark, SF_SMALL)
    tables = {"patients": m.patients, "providers": m.providers}
    files.write_clean(tables, str(tmp_path / "clean"))
    assert spark.read.parquet(str(tmp_path / "clean" / "patients")).count() == m.patients.count()
    files.write_clean({"providers": m.providers}, str(tmp_path / "csv"), fmt="csv")


def test_claims_csv_end_to_end(spark, tmp_path):
    """Surplus and missing fields, missing-value tokens, text that is no
    amount or date; the rest is cleaned."""
    from claimwise.operators import clean
    from claimwise.schema import RAW_CLAIMS

    row = "C{},P1,R1,{},2024-03-09,,Outpatient,X,{},{},{},40.00, paid ,{}"
    lines = [
        ",".join(RAW_CLAIMS.names),
        row.format(1, "2024-03-05", "0071", "-100.50", "80.00", "NA"),
        row.format(2, "03/05/2024", "0071", "N/A", "80.00", "null"),
        row.format(3, "05-03-2024", "0071", "10", "5", "x"),
        row.format(4, "2024-03-05", "0071", "ten", "5", "x"),
        row.format(5, "2024-03-05", "0071", "300.00", "abc", "x"),
        row.format(6, "2024-03-05", "0071", "300.00", "80.00", "x,surplus"),
        "C7,P1",
        row.format(8, "\t2024-03-05 ", "0071", "300.50", "80.00", "x"),
    ]
    path = tmp_path / "claims.csv"
    path.write_text("\n".join(lines) + "\n")
    raw, lost = files.split_corrupt(files.read_raw(spark, str(path), RAW_CLAIMS))
    assert sorted(r.line[:2] for r in lost.collect()) == ["C6", "C7"]
    got = {r.claim_id: r for r in clean.clean_claims(raw).collect()}
    assert sorted(got) == ["C1", "C2", "C8"]
    assert str(got["C1"].billed_amount) == "100.50" and got["C1"].cpt_code == "0071" and got["C1"].claim_status == "Paid"
    assert str(got["C2"].billed_amount) == "200.50" and got["C2"].billed_imputed and got["C2"].denial_reason == "Not Applicable"
    assert got["C8"].service_date == got["C2"].service_date
    assert {r.claim_id: r.reject_reason for r in clean.claim_rejects(raw).collect()} == {
        "C3": "unparseable date", "C4": "unparseable amount", "C5": "unparseable amount"}


def test_bad_patient_dates_are_rejected(spark):
    from claimwise.operators import clean
    from claimwise.schema import RAW_PATIENTS

    df = spark.createDataFrame([("1", "f", "1990-01-02", None, "A", "2020-01-01"), ("2", "M", "1990-13-02", "X", "A", None)], RAW_PATIENTS)
    assert [r.patient_id for r in clean.clean_patients(df).collect()] == ["1"]
    assert [(r.patient_id, r.date_of_birth) for r in clean.patient_rejects(df).collect()] == [("2", "1990-13-02")]


def test_tables_see_added_rows(spark, tmp_path):
    """Nothing is kept between calls."""
    import os
    import shutil

    import __spark_entry__ as E

    copy = str(tmp_path / "sf")
    os.mkdir(copy)  # not copytree, which would copy the read-only mode of the folder too
    for name in os.listdir(SF_SMALL):
        shutil.copyfile(f"{SF_SMALL}/{name}", f"{copy}/{name}")
    before = {r.table_name: r.row_count for r in E.queries()["dq1_row_counts"](spark, copy).collect()}
    spark.read.parquet(f"{SF_SMALL}/lineitem.parquet").limit(500).write.parquet(f"{copy}/more")
    both = spark.read.parquet(f"{copy}/lineitem.parquet", f"{copy}/more")
    both.write.parquet(f"{copy}/all")
    (tmp_path / "sf" / "lineitem.parquet").unlink()
    (tmp_path / "sf" / "all").rename(tmp_path / "sf" / "lineitem.parquet")
    after = {r.table_name: r.row_count for r in E.queries()["dq1_row_counts"](spark, copy).collect()}
    assert after["claims"] == before["claims"] + 500


def test_csv_export_is_packed_in_files_of_bounded_rows(spark, monkeypatch):
    from claimwise.sources import faults, tpch

    monkeypatch.setattr(faults, "CSV_ROWS", 2000)
    back = faults.claims_csv(spark, SF_SMALL)
    assert back.count() == tpch.raw_claims(spark, SF_SMALL).count()
    files_of = [p for p in back.inputFiles() if p.endswith(".csv.gz")]
    assert len(files_of) == len(back.inputFiles()) and len(files_of) >= back.count() / 2000
