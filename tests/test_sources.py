"""Readers, writers, the customer store and its stream."""

import csv

import pytest
from pyspark.sql import functions as F

from keepwell.domain import CUSTOMER_SCHEMA
from keepwell.session import new_path
from keepwell.operators.portfolio import with_health
from keepwell.plans import renewal
from keepwell.sources import csv_records, customers, tables
from keepwell.streaming.ingest import stream_customers, streamed_customers

CUSTOMER = "name string, usage double, tickets int, nps int, renewal_status string"
GOOD = [("Ann", 50.0, 1, 9, "Likely"), (" Bo ", 0.0, 0, 0, "Unknown")]
BAD = [("", 50.0, 1, 9, "Likely"), ("Cy", 101.0, 1, 9, "Likely"), ("Di", 1.0, -1, 9, "Likely"),
       ("Ed", 1.0, 1, 11, "Likely"), ("Flo", 1.0, 1, 1, "Perhaps")]


@pytest.fixture
def text_file(tmp_path):
    def write(name, text):
        path = tmp_path / name
        path.write_text(text)
        return str(path)

    return write


def test_csv_missing_texts_and_quotes(spark, text_file):
    path = text_file("a.CSV", 'id,note,n\n1,"say ""hi"", ok",NA\n2, padded ,\n3,null,1d\n')
    rows = tables.read_table(spark, path).orderBy("id").collect()
    assert [tuple(r) for r in rows] == [("1", 'say "hi", ok', None), ("2", " padded ", None), ("3", None, "1d")]


def test_unknown_extension_and_absent_file(spark, tmp_path):
    with pytest.raises(ValueError, match="No reader"):
        tables.read_table(spark, str(tmp_path / "a.xls"))
    with pytest.raises(ValueError, match="Could not read"):
        tables.read_table(spark, str(tmp_path / "gone.csv"))


def test_unreadable_lines_are_quarantined(spark, text_file):
    path = text_file("b.csv", "a,b\n1,2\n3\n4,5,6\n")
    good, bad = tables.read_csv_quarantined(spark, path, ["a", "b"])
    assert [tuple(r) for r in good.collect()] == [("1", "2")]
    assert sorted(r["_corrupt_record"] for r in bad.collect()) == ["3", "4,5,6"]
    assert good.select("a").count() == 1


@pytest.mark.parametrize("line, inside, after", [
    ("a,b", False, False), ('a,"b', False, True), ('b",c', True, False), ('b"",c', True, True), ('"a""b"', False, False),
    ('"a"b",c', False, False), ('a"b,c', False, False), ('x,""', False, False), ('x,"', False, True), ('"', True, False),
    ('""', True, True), ('"","', False, True), ('a",",b', True, True), ("", True, True)])
def test_quotes_that_go_over_a_line(line, inside, after):
    assert csv_records.ends_inside(line, inside, ",") == after


MESSY = [["id", "note, long", "n"], ["1", "two\nlines", "x"], ["2", 'say ""hi""\n\n"bye"', ""], ["3", "a\r\nb,c\n" * 40, "y"],
         ["4", "", "NA"], ["5", '"', "\n"], ["6", "ü\n日本", "z"]]


def messy_file(path, rows, end="\n"):
    with open(path, "w", newline="", encoding="utf-8") as out:
        csv.writer(out, lineterminator=end).writerows(rows)


@pytest.mark.parametrize("split_bytes", [1 << 20, 64, 7])
def test_records_across_lines_and_splits(spark, tmp_path, split_bytes):
    folder = tmp_path / "messy.csv"
    folder.mkdir()
    header, *rows = MESSY
    messy_file(folder / "a.csv", [header, *rows])
    messy_file(folder / "b.csv", [header, *[[f"b{r[0]}", *r[1:]] for r in rows]], "\r\n")
    want = [[None if v in ("", "NA") else v for v in [first + r[0], *r[1:]]] for first in ("", "b") for r in rows]
    spark.conf.set("spark.sql.files.maxPartitionBytes", split_bytes)
    spark.conf.set("spark.sql.files.openCostInBytes", 1)
    try:
        table = tables.read_table(spark, str(folder))
        assert table.columns == header
        assert sorted([list(r) for r in table.collect()], key=str) == sorted(want, key=str)
        assert table.select("id").count() == len(want)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_both_csv_readers_agree(spark, text_file):
    path = text_file("e.csv", 'a,b\n1,"x, y"\n\n  \n2,\n"3","say ""hi"""\n')
    plain, found = (sorted(tuple(r) for r in tables.read_table(spark, path, multiline=m).collect()) for m in (False, True))
    assert plain == found == [("1", "x, y"), ("2", None), ("3", 'say "hi"')]


@pytest.mark.parametrize("multiline", [False, True])
def test_wide_rows_are_refused_and_short_ones_filled(spark, text_file, multiline):
    short = text_file("f.csv", 'a,b\n1,"x"\n2\n')
    assert [tuple(r) for r in tables.read_table(spark, short, multiline=multiline).orderBy("a").collect()] == [("1", "x"), ("2", None)]
    wide = text_file("g.csv", 'a,b\n1,2\n3,"a,b"\n3,"a,b",\n')
    with pytest.raises(Exception, match="more values than the header"):
        tables.read_table(spark, wide, multiline=multiline).collect()
    with pytest.raises(Exception, match="more values than the header"):
        tables.read_table(spark, wide, multiline=multiline).select("a").collect()
    good, bad = tables.read_csv_quarantined(spark, wide, multiline=multiline)
    assert good.count() == 2 and [r["_corrupt_record"] for r in bad.collect()] == ['3,"a,b",']


def test_empty_table_is_refused(spark):
    with pytest.raises(ValueError, match="contains no rows"):
        tables.require_nonempty(spark.createDataFrame([], "a int"))


def test_importance_report(spark, text_file, tmp_path):
    path = text_file("c.csv", "Feature,Importance\na,0.25\nb,oops\nc,0.75\n")
    assert [tuple(r) for r in tables.read_importance(spark, path).collect()] == [("c", 0.75), ("a", 0.25)]
    assert tables.read_importance(spark, str(tmp_path / "none.csv")).count() == 0
    assert tables.read_importance(spark, text_file("d.csv", "x,y\n1,2\n")).count() == 0


def test_append_gives_new_ids_and_returns_rejects(spark):
    path = new_path(spark, "store")
    new = spark.createDataFrame(GOOD + BAD, CUSTOMER)
    assert customers.next_id(spark, path) == 1
    rejected = customers.append_customers(new, path)
    assert rejected.count() == len(BAD) and all(len(r["reasons"]) == 1 for r in rejected.collect())
    customers.append_customers(new, path)
    ids = [r["id"] for r in customers.load_customers(spark, path).collect()]
    assert len(ids) == len(set(ids)) == 2 * len(GOOD) and min(ids) >= 1


def test_stream_stores_once(spark):
    base = new_path(spark, "stream")
    records = spark.createDataFrame(GOOD + BAD, CUSTOMER)

    def run():
        stream_customers(spark, f"{base}/in", f"{base}/out", f"{base}/checkpoint").awaitTermination()
        accepted, rejected = streamed_customers(spark, f"{base}/out")
        return accepted.select(CUSTOMER_SCHEMA.fieldNames()).collect(), rejected.count()

    records.write.mode("append").json(f"{base}/in")
    first = run()
    assert sorted(r["name"] for r in first[0]) == ["Ann", "Bo"] and first[1] == len(BAD)
    assert run() == first  # a restart from the checkpoint adds nothing
    records.write.mode("append").json(f"{base}/in")
    accepted, rejected = run()
    assert len(accepted) == 2 * len(GOOD) and rejected == 2 * len(BAD)


def test_stream_and_appends_share_one_store(spark):
    base = new_path(spark, "one-store")
    path = f"{base}/store"
    whole = spark.createDataFrame([(7, "Zoe", 60.0, 0, 8, "Likely")], "id long, " + CUSTOMER)
    customers.save_customers(whole, path)
    records = spark.createDataFrame(GOOD + BAD, CUSTOMER)
    records.write.json(f"{base}/in")
    stream_customers(spark, f"{base}/in", path, f"{base}/checkpoint").awaitTermination()
    customers.append_customers(records, path)
    stored = customers.load_customers(spark, path)
    ids = [r["id"] for r in stored.collect()]
    assert len(set(ids)) == len(ids) == 1 + 2 * len(GOOD) and min(ids) == 7
    assert customers.rejected_customers(spark, path).count() == 2 * len(BAD)
    assert with_health(stored).where("health_score is null").count() == 0
    model = renewal.train_renewal(renewal.with_renewal_label(stored), trees=2, depth=2)
    assert renewal.score_renewal(stored, model).where("renewal_probability is not null").count() == len(ids)
    customers.save_customers(whole, path)
    assert [r["id"] for r in customers.load_customers(spark, path).collect()] == [7]
    assert customers.next_id(spark, path) == 8


def test_an_unfinished_batch_is_unseen_and_replaced(spark):
    path = f"{new_path(spark, 'unfinished')}/store"
    records = spark.createDataFrame(GOOD + BAD, CUSTOMER)
    customers.append_customers(records, path, "first")
    # a driver that was lost after the records and before the log
    spark.read.parquet(f"{path}/records/outcome=accepted/batch=first").write.parquet(f"{path}/records/outcome=accepted/batch=second")
    assert customers.load_customers(spark, path).count() == len(GOOD)
    customers.append_customers(records, path, "second")
    ids = [r["id"] for r in customers.load_customers(spark, path).collect()]
    assert len(set(ids)) == len(ids) == 2 * len(GOOD)
    customers.append_customers(records, path, "second")  # a replay
    assert sorted(r["id"] for r in customers.load_customers(spark, path).collect()) == sorted(ids)


def test_appends_evaluate_their_input_once(spark):
    """A source that says something else each time still gives every record one outcome."""
    path = f"{new_path(spark, 'once')}/store"
    usage = F.when(F.rand() < 0.5, 50.0).otherwise(500.0)
    records = spark.range(400).select(F.concat(F.lit("n"), "id").alias("name"), usage.alias("usage"), F.lit(1).alias("tickets"),
                                      F.lit(5).alias("nps"), F.lit("Likely").alias("renewal_status"))
    rejected = customers.append_customers(records, path)
    names = [r["name"] for r in customers.load_customers(spark, path).union(rejected.select(
        F.lit(0).alias("id"), *CUSTOMER_SCHEMA.fieldNames())).collect()]
    assert len(names) == len(set(names)) == 400
