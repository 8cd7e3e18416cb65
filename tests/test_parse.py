from tallyspark.operators import parse


def reasons(spark, lines):
    df = spark.createDataFrame([(i, x, "z") for i, x in enumerate(lines)], "record_id long, raw_line string, reason string")
    p = parse.parsed(df, "record_id", "raw_line")
    out = {}
    for r in parse.errors(p).collect():
        out.setdefault(r["record_id"], []).append(r["reason"])
    return {k: sorted(v) for k, v in out.items()}, p


def line(period="3", posted="2024-02-29", debit="1", credit="", text="x"):
    return f"D,C,2024,{period},{posted},2024-01-01,AA,100000,{debit},{credit},{text}"


def test_reasons(spark):
    cases = [
        (None, ["column_count"]), ("", ["column_count"]), ("   ", ["column_count"]), ("a,b", ["column_count"]), (line(), []), (line(text='"a,b"'), []), (line(text='"a ""q"" b"'), []),
        (line(text='"a\nb"'), []), (line(text='"open'), ["quoting"]), (line(text='a"b'), ["quoting"]), (line(text='"a"b'), ["quoting"]), (line(text=' "a"'), ["quoting"]), (line(text='""'), []), (line(text='""""'), []), (line(text='"""'), ["quoting"]),
        (line(period="0"), ["fiscal_period"]), (line(period="16"), []), (line(period="17"), ["fiscal_period"]), (line(period=" 007 "), []), (line(period="٣"), ["fiscal_period"]), (line(period=""), ["fiscal_period"]),
        (line(posted="2023-02-29"), ["posting_date"]), (line(posted="1899-12-31"), ["posting_date"]), (line(posted="1900-01-01 23:59:59"), []), (line(posted="2024-01-01 24:00:00"), ["posting_date"]), (line(posted="2024-1-1"), ["posting_date"]), (line(posted="2024-13-01"), ["posting_date"]),
        (line(debit='"1,234.50"'), []), (line(debit='"12,34"'), ["debit_amount"]), (line(debit="(5)"), []), (line(debit="(-5)"), ["debit_amount"]), (line(debit="+5"), []), (line(debit="5-"), ["debit_amount"]), (line(debit="1e3"), ["debit_amount"]), (line(debit="1 2", credit="x"), ["credit_amount", "debit_amount"]),
        (line(text="a\nb"), []), (line(text="a\r\nb", debit="x"), ["debit_amount"]), ("D;C\nE;F", ["column_count"]), (line(debit="−5", credit="-5"), []), (line(debit="5."), ["debit_amount"]), (line(debit=".5"), ["debit_amount"]),
        (line(text="\x01s\x01e"), []), (line(text="z" * 100_000), []), (line(text='"' + '""' * 20_000 + '"'), []),
    ]
    got, _ = reasons(spark, [c[0] for c in cases])
    assert [got.get(i, []) for i in range(len(cases))] == [c[1] for c in cases]


def test_typed_values(spark):
    lines = [line(debit='"1,234.50"', credit="(7)", period="007", text='"a ""q"", b"'), line(debit="bad"), line(debit="", credit="−3", posted="2024-02-29 10:11:12", text="\x01s")]
    _, p = reasons(spark, lines)
    v = {r["record_id"]: r for r in parse.valid_rows(p, parse.errors(p)).collect()}
    assert set(v) == {0, 2}
    assert (v[0]["debit_amount"], v[0]["credit_amount"], v[0]["fiscal_period"], v[0]["header_text"]) == (1234.5, -7.0, 7, 'a "q", b')
    assert (v[2]["debit_amount"], v[2]["credit_amount"], str(v[2]["posting_date"]), v[2]["header_text"]) == (None, -3.0, "2024-02-29 10:11:12", "\x01s")


def test_empty_table(spark):
    got, p = reasons(spark, [])
    assert got == {} and parse.valid_rows(p, parse.errors(p)).count() == 0
