from lettermill.streaming.mail import arriving, gated, streamed_keys

MAIL = "id int, message_id string, subject string, body string, sent_at timestamp"


def messages(spark, path, rows):
    spark.createDataFrame(rows, MAIL.replace("timestamp", "string")).selectExpr("id", "message_id", "subject", "body",
        "cast(sent_at as timestamp) sent_at").write.mode("append").parquet(path)
    return spark.read.parquet(path).schema


def test_streamed_keys_and_gate(spark, tmp_path):
    source = str(tmp_path / "in")
    schema = messages(spark, source, [(1, "m", "100.113/26 100.114/26", None, "2026-01-01 00:00:00"), (2, "m", "100.113/26", None, "2026-01-01 00:00:00")])
    query = streamed_keys(arriving(spark, source, schema)).writeStream.format("memory").queryName("streamed_keys").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(r.value for r in spark.sql("select * from streamed_keys").collect()) == ["842.113/26", "842.114/26"]
    path = str(tmp_path / "att")
    spark.createDataFrame([("payslip.pdf", "s", "x"), ("note.pdf", "s", "x")], "filename string, subject string, sender string").write.parquet(path)
    query = gated(arriving(spark, path, spark.read.parquet(path).schema)).writeStream.format("memory").queryName("gated").trigger(availableNow=True).start()
    query.awaitTermination()
    assert [r.filename for r in spark.sql("select * from gated").collect()] == ["note.pdf"]


def test_nameless_attachments_pass_neither_gate(spark, tmp_path):
    path = str(tmp_path / "att")
    spark.createDataFrame([(None, "s", "x"), ("", "s", "x"), ("note.pdf", "s", "x")], "filename string, subject string, sender string").write.parquet(path)
    query = gated(arriving(spark, path, spark.read.parquet(path).schema)).writeStream.format("memory").queryName("named").trigger(availableNow=True).start()
    query.awaitTermination()
    assert [r.filename for r in spark.sql("select * from named").collect()] == ["note.pdf"]
