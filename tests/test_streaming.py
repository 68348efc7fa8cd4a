import json

from ledgerlake.streaming.filings import keep_current


def test_records_follow_the_index(spark, tmp_path):
    landing, tables = tmp_path / "landing", tmp_path / "tables"
    landing.mkdir()
    companies = spark.createDataFrame([(0, "1301", "A", "x", "化学"), (1, "1302", "B", "x", "化学"), (2, "1303", "C", "x", "化学"), (3, "130A", "D", "x", "化学")], "seq long, code string, name string, market string, industry string")
    state = {"n": 0}
    spark.createDataFrame([("1301", "OLD", "2024-04-01 09:00", None)], "code string, document_id string, filed_at string, policy string").write.parquet(f"{tables}/0")

    def write(df):
        df.write.parquet(f"{tables}/{state['n'] + 1}")
        state["n"] += 1

    def land(name, day, *docs):
        row = {"fetch_day": day, "results": [{"docID": d, "secCode": c + "0", "docTypeCode": k, "submitDateTime": t} for d, c, k, t in docs]}
        (landing / name).write_text(json.dumps(row) + "\n")

    def run():
        keep_current(spark, str(landing), str(tmp_path / "cp"), companies, lambda: spark.read.parquet(f"{tables}/{state['n']}"), write, as_of="2024-05-03").awaitTermination()
        return {r.code: r.document_id for r in spark.read.parquet(f"{tables}/{state['n']}").collect()}

    land("a.json", "2024-05-01", ("N1", "1301", "120", "2024-05-01 10:00"), ("Q", "1302", "140", "2024-05-01 11:00"))
    assert run() == {"1301": "N1"}
    land("b.json", "2024-05-02", ("N0", "1301", "120", "2024-04-30 10:00"), ("M1", "1302", "120", "2024-05-02 10:00"))
    assert run() == {"1301": "N1", "1302": "M1"}
    # a file of an old day that lands late is old: it is read for companies without a record alone
    land("c.json", "2024-01-02", ("L1", "1301", "120", "2024-06-01 10:00"), ("L3", "1303", "120", "2024-01-02 10:00"), ("L4", "130A", "120", "2024-01-02 10:00"))
    assert run() == {"1301": "N1", "1302": "M1", "1303": "L3"}
