"""Rows that cannot be read are set apart, counted and stored once; the good rows are stored."""

from __future__ import annotations

from conftest import panel_row

from holdfast import schemas
from holdfast.plans.pipeline import RetentionJob
from holdfast.sources import files, rejects, tables

HEADER = ",".join(schemas.ENGAGEMENT.fieldNames())
GOOD = "A,2024-01,5,100,2.5,3,4,0,61.5,0"


def written(path, header, *lines):
    path.write_text("\n".join([header, *lines]) + "\n")


def test_every_kind_of_bad_row_is_counted_and_the_good_ones_stored(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    written(source / "1.csv", HEADER, GOOD, "B,2024-01,abc,100,2.5,3,4,0,61.5,0", "C,2024-01,5", f"{GOOD},9",
            ",2024-01,5,100,2.5,3,4,0,61.5,0", "D,2024-01,,,,,,,,", '"E, x",2024-01,5,100,2.5,3,4,0,61.5,0')
    turned = "extra," + ",".join(reversed(schemas.ENGAGEMENT.fieldNames()))
    line = ",".join(reversed("F,2024-01,5,100,2.5,3,4,0,61.5,0".split(",")))
    written(source / "2.csv", turned, f"x,{line}", line, "x," + line.replace("2.5", "two"), "x," + line + ",y,z")
    job = RetentionJob(spark, str(tmp_path / "job"), buckets=2)
    wanted = {"good": 4, files.UNREADABLE: 2, files.RAGGED: 4, rejects.NO_KEY: 1}
    for _ in range(2):  # a repeated ingestion counts the same and stores nothing twice
        assert job.ingest(str(source)) == wanted
        stored = job.engagement().collect()
        assert sorted(r["customer_id"] for r in stored) == ["A", "D", "E, x", "F"]
        apart = job.read("rejected").collect()
        assert len(apart) == 7
    reasons = {r["raw"].split(",")[0]: r["reason"] for r in apart if r["file"].endswith("1.csv")}
    assert reasons["B"] == files.UNREADABLE and reasons["C"] == files.RAGGED
    assert next(r for r in stored if r["customer_id"] == "F")["logins_per_day"] == 2.5


def test_the_first_good_row_of_a_key_wins(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    written(source / "1.csv", HEADER, GOOD.replace(",100,", ",many,"), GOOD.replace(",100,", ",7,"), GOOD)
    job = RetentionJob(spark, str(tmp_path / "job"), buckets=2)
    assert job.ingest(str(source)) == {"good": 2, files.UNREADABLE: 1}
    assert [r["api_calls"] for r in job.engagement().collect()] == [7]


def test_files_with_types(spark, tmp_path):
    path = str(tmp_path / "parquet")
    row = panel_row()
    names = schemas.ENGAGEMENT.fieldNames()
    texts = spark.createDataFrame(
        [tuple(str(row[n]) for n in names), ("B", "2024-01", "none", *["1"] * 7), (None, "2024-01", *["1"] * 8)],
        ", ".join(f"{n} string" for n in names),
    )
    texts.write.parquet(path)
    rows = rejects.checked(spark, path, schemas.ENGAGEMENT, tables.PANEL_KEY, "parquet")
    assert rejects.counts(rows) == {"good": 1, files.UNREADABLE: 1, rejects.NO_KEY: 1}
    assert {r["reason"]: '"B"' in r["raw"] for r in rejects.rejected(rows).collect()} == {
        files.UNREADABLE: True, rejects.NO_KEY: False}
    assert rejects.good(rows).first()["api_calls"] == 100


def test_many_headers_are_read_at_a_time(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    for i in range(70):
        written(source / f"{i:02d}.csv", HEADER, f"C{i},2024-01,{i},100,2.5,3,4,0,61.5,0")
    found = tables.read_engagement(spark, str(source)).collect()
    assert {r["customer_id"]: r["active_users"] for r in found} == {f"C{i}": i for i in range(70)}


def test_customers_that_cannot_be_read_are_set_apart(spark, tmp_path):
    path = tmp_path / "c.csv"
    written(path, ",".join(schemas.CUSTOMERS.fieldNames()), "A,Acme,small,SaaS,Starter,500,2023-05-01,12",
            "B,Bee,small,SaaS,Starter,much,2023-05-01,12", "C,Sea,small,SaaS,Starter,500,someday,12", ",No,small,SaaS,Starter,1,,1")
    job = RetentionJob(spark, str(tmp_path / "job"), buckets=2)
    assert job.ingest_customers(str(path)) == {"good": 1, files.UNREADABLE: 2, rejects.NO_KEY: 1}
    assert [r["customer_id"] for r in job.read("customers").collect()] == ["A"]
    assert job.read("rejected").count() == 3
