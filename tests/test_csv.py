"""CSV with and without line breaks in fields."""

import csv

from threadtide.sources import files

SCHEMA = "id long, text string, n long"


def write(path, rows):
    with open(path, "w", newline="") as f:
        out = csv.writer(f, quoting=csv.QUOTE_NONNUMERIC)
        out.writerow(["id", "text", "n"])
        out.writerows(rows)


def test_fields_with_line_breaks_are_whole(spark, tmp_path):
    plain = [(i, f'say "{i}", twice ""', i * 2) for i in range(3000)]
    broken = [(10_000, 'one\ntwo "x"\n\n, three', 1), (10_001, '"', 2), (10_002, '"\n"', 3), (10_003, "", 4)]
    write(tmp_path / "plain.csv", plain)
    write(tmp_path / "broken.csv", broken)
    whole, other = files.broken_files(spark, str(tmp_path))
    assert [p.rsplit("/", 1)[1] for p in whole + other] == ["plain.csv", "broken.csv"]
    got = sorted((r["id"], r["text"] or "", r["n"]) for r in files.read_csv(spark, str(tmp_path), SCHEMA).collect())
    assert got == sorted(plain + broken)
    assert files.read_csv(spark, str(tmp_path), SCHEMA, ["n"]).columns == ["n"]


def test_a_file_without_broken_fields_is_read_by_many_tasks(spark, tmp_path):
    rows = [(i, f'a "quoted" field, number {i}', i) for i in range(20_000)]
    write(tmp_path / "large.csv", rows)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        df = files.read_csv(spark, str(tmp_path / "large.csv"), SCHEMA)
        parts = df.selectExpr("spark_partition_id() p").distinct().count()
        assert parts > 5
        assert sorted(map(tuple, df.collect())) == rows
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
