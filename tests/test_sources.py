import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import sinks
from tallyspark.plans import surface
from tallyspark.sources import mapping, readers
from tallyspark.streaming import ledger as stream


def test_text_detection(spark, tmp_path):
    p = tmp_path / "gl.csv"
    p.write_bytes("전표번호;차변;대변;적요\nJ1;1.234,5;0;\"a;b\"\nJ2;x\n".encode("cp949"))
    head = readers.inspect(spark, str(p)).head
    assert readers.detect_encoding(head) == "MS949" and readers.detect_separator(head.decode("cp949")) == ";"
    rows = readers.read_file(spark, str(p)).collect()
    assert rows[0]["적요"] == "a;b" and rows[0]["_corrupt_record"] is None and rows[1]["_corrupt_record"] is not None
    with pytest.raises(readers.BadFile):
        readers.inspect(spark, str(tmp_path / "none.csv"))
    (tmp_path / "x.parquet").write_bytes(b"nope nope")
    with pytest.raises(readers.BadFile):
        readers.inspect(spark, str(tmp_path / "x.parquet"))


def test_header_and_mapping():
    rows = [["Report", "", ""], ["Document Number", "Debit", "Credit"], ["J1", "1", "2"]]
    assert readers.detect_header(rows, {"debit", "credit"})[0] == 1
    got = mapping.map_columns(["BELNR", "Posting Date", "debit", "credit_amonut", "zzz"])
    assert got == {"document_id": "BELNR", "posting_date": "Posting Date", "debit_amount": "debit", "credit_amount": "credit_amonut"}
    assert mapping.fingerprint(["b", "A"]) == mapping.fingerprint(["a ", "B"])


def test_typing(spark):
    df = spark.createDataFrame([("1000.0", "₩1,234.5", "(5)", "2024.02.03", "45300"), ("x", "-", "7-", "nope", None)], "gl_account string, debit_amount string, credit_amount string, posting_date string, document_date string")
    a, b = mapping.typed(df).select("gl_account", "debit_amount", "credit_amount", "posting_date", "document_date", "currency").collect()
    assert tuple(a) == ("1000", 1234.5, -5.0, dt.datetime(2024, 2, 3), dt.datetime(2024, 1, 9), None)
    assert tuple(b) == ("x", None, -7.0, None, None, None)
    one = mapping.unify_sides(spark.createDataFrame([("5", "S"), ("-3", "H")], "amount string, dc_indicator string")).collect()
    assert [(r["debit_amount"], r["credit_amount"]) for r in one] == [(5.0, 0.0), (0.0, 3.0)]
    signed = mapping.unify_sides(spark.createDataFrame([("5",), ("-3",)], "amount string")).collect()
    assert [(r["debit_amount"], r["credit_amount"]) for r in signed] == [(5.0, 0.0), (0.0, 3.0)]


def test_nested_documents(spark, tmp_path):
    (tmp_path / "po.json").write_text('[{"header":{"document_id":"P1","status":"open"},"items":[{"line":1,"amount":5},{"line":2,"amount":6}]},{"header":{"document_id":"P2","status":null},"items":[]}]')
    h, lines, refs = readers.flow_tables(readers.read_file(spark, str(tmp_path / "po.json")))
    assert h.count() == 2 and {(r["document_id"], r["line"]) for r in lines.collect()} == {("P1", 1), ("P1", 2)} and refs.count() == 0


def test_loads_are_replaced(spark, tmp_path):
    path = str(tmp_path / "t")
    mk = lambda rows: spark.createDataFrame(rows, "k string, upload_batch_id string")
    sinks.save_load(mk([("a", "1"), ("b", "2")]), path)
    sinks.save_load(mk([("c", "2")]), path)
    assert sorted(r["k"] for r in spark.read.parquet(path).collect()) == ["a", "c"]
    assert sinks.drop_load(spark, path, "1") and [r["k"] for r in spark.read.parquet(path).collect()] == ["c"]
    log = str(tmp_path / "log")
    sinks.append_new(mk([("a", "1"), ("a", "1")]), log, "k")
    sinks.append_new(mk([("a", "9"), ("b", "1")]), log, "k")
    assert sorted(r["k"] for r in spark.read.parquet(log).collect()) == ["a", "b"]


def test_masking(spark):
    df = spark.createDataFrame([("abcdef", None), ("x", "")], "a string, b string")
    r = df.select(sinks.masked(F.col("a")).alias("m"), sinks.hashed(F.col("a"), "s").alias("h"), sinks.content_id("c_", "a", "b").alias("i"), sinks.hashed(F.col("b"), "s").alias("hb")).collect()
    assert r[0]["m"] == "ab****" and r[1]["m"] == "x" and len(r[0]["h"]) == 16 and r[0]["hb"] is None and r[0]["i"] != r[1]["i"]


def test_guard(spark, small):
    surface.views(spark, small)
    ok = surface.guarded(spark, "WITH x AS (SELECT * FROM general_ledger WHERE upload_batch_id = 'UB-0000-01') SELECT count(*) AS n FROM x WHERE line_text <> 'drop table x'")
    assert ok.count() == 1
    for bad in ("DROP TABLE general_ledger", "SELECT * FROM secrets WHERE upload_batch_id = '1'", "SELECT * FROM general_ledger", "SELECT 1; SELECT 2", "INSERT INTO general_ledger SELECT * FROM general_ledger WHERE upload_batch_id = '1'", "SELECT * FROM general_ledger WHERE upload_batch_id IN (SELECT v FROM hidden)"):
        with pytest.raises(surface.Rejected):
            surface.guarded(spark, bad)
    g = "SELECT * FROM general_ledger"
    for bad in (f"{g} WHERE 'upload_batch_id' = 'upload_batch_id'", f"{g} WHERE upload_batch_id = upload_batch_id OR true", f"{g} WHERE upload_batch_id = 'a' OR row_id > 0", f"{g} WHERE NOT upload_batch_id = 'a'", f"{g} WHERE upload_batch_id = 'a' UNION ALL {g}", "SELECT 1 FROM general_ledger a JOIN general_ledger b ON a.row_id = b.row_id WHERE a.upload_batch_id = 'x'", f"SELECT * FROM ({g}) WHERE upload_batch_id = 'x'", f"SELECT * FROM employees WHERE upload_batch_id = 'x' AND user_id IN (SELECT created_by FROM general_ledger)", f"WITH general_ledger AS ({g}) {g} WHERE upload_batch_id = 'x'"):
        with pytest.raises(surface.Rejected):
            surface.guarded(spark, bad)
    for good in (f"{g} WHERE upload_batch_id = 'a' AND row_id > 0", f"{g} g WHERE 'a' = g.upload_batch_id", f"SELECT count(*) FROM general_ledger WHERE upload_batch_id IN ('a', 'b') GROUP BY gl_account HAVING count(*) > 1", "SELECT * FROM payment_allocations", "SELECT 1 FROM general_ledger a JOIN general_ledger b ON a.row_id = b.row_id WHERE a.upload_batch_id = 'x' AND b.upload_batch_id = 'x'"):
        surface.guarded(spark, good)
    assert spark.table("general_ledger").filter(surface.where(companies=["C0001"], least=1000.0)).count() > 0


def test_streams(spark, small, tmp_path):
    gl = spark.read.parquet(f"{small}/general_ledger.parquet").select("row_id", "created_by", "gl_account", F.col("posting_date").cast("timestamp").alias("at"))
    src = str(tmp_path / "in")
    gl.repartition(3).write.parquet(src)

    def run(make):
        s = spark.readStream.schema(gl.schema).parquet(src)
        q = make(s).writeStream.outputMode("append").format("memory").queryName("out").option("checkpointLocation", str(tmp_path / make.__name__)).start()
        q.processAllAvailable()
        q.stop()
        return spark.table("out").count()

    def daily(s):
        return stream.daily_counts(s, "at", ["gl_account"])

    def once(s):
        return stream.without_repeats(s, "at", ["row_id"], "1000 days")

    def bursts(s):
        return stream.sessions(s, "at", "created_by")

    def trailing(s):
        return stream.trailing_counts(s, "at", ["created_by"])

    def same_second(s):
        return stream.simultaneous(s, "at", 2)

    assert run(daily) > 100 and run(once) == gl.count() and run(bursts) > 10 and run(trailing) > 100 and run(same_second) >= 1


def test_records_over_lines_and_splits(spark, tmp_path):
    from tallyspark.sources import text

    rows = [f'{k},"a ""q"" {k}",x' if k % 3 else f'{k},"one\n\ntwo, {k}",x' for k in range(2000)]
    (tmp_path / "f.csv").write_text("id,text,z\n" + "\n".join(rows) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        got = [r["record"] for r in text.records(text.lines_of(spark, str(tmp_path / "f.csv"))).orderBy("rec").collect()]
        assert got == ["id,text,z", *rows]
        df = readers.read_text(spark, str(tmp_path / "f.csv"))
        assert df.count() == 2000 and df.filter("id = '3'").first()["text"] == "one\n\ntwo, 3"
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_repairs(spark, tmp_path):
    from tallyspark.sources import text

    lines = ["a,b,c", "1,2,3", "4;5;6", "7,8,text", "that goes on", "and on", '9,"open,x', "10,11,12", "", "13\t14\t15", "16,17,18,19"]
    (tmp_path / "f.csv").write_text("\n".join(lines))
    r = text.records(text.lines_of(spark, str(tmp_path / "f.csv")), most=2)  # the quote that never closes would take six lines
    assert r.count() == 10
    got = {x["a"]: (x["b"], x["c"], x["_more"]) for x in _repaired(spark, str(tmp_path / "f.csv"), text)}
    assert got["4"] == ("5", "6", None) and got["7"] == ("8", "text\nthat goes on\nand on", None) and got["13"] == ("14", "15", None) and got["16"] == ("17", "18", ["19"]) and got["9"] == ("open", "x", None)
    assert text.read_repaired(spark, str(tmp_path / "f.csv"), ["a", "b", "c"]).count() > 0


def _repaired(spark, path, text):
    r = text.records(text.lines_of(spark, path), most=2)
    x = text.rejoined(text.remixed(r.withColumn("cells", text.tidy_cells(text.cells(F.col("record")))), "cells", 3), "cells", "file", ["rec", "part"])
    return x.selectExpr("get(cells, 0) a", "get(cells, 1) b", "get(cells, 2) c", "if(size(cells) > 3, slice(cells, 4, 9), null) _more").collect()


def test_code_pages_of_large_files(spark, tmp_path):
    big = "전표번호,적요\n" + "\n".join(f"{k},감사 전표 {k}" for k in range(60_000))
    (tmp_path / "f.csv").write_bytes(big.encode("cp949"))
    assert readers.detect_encoding(readers.inspect(spark, str(tmp_path / "f.csv")).head) == "MS949"
    assert readers.read_text(spark, str(tmp_path / "f.csv")).filter("`적요` = '감사 전표 59999'").count() == 1
