"""Readers, sinks and streams."""

from __future__ import annotations

import hashlib
import hmac

import pytest
from pyspark.sql import functions as F

from tallyspark.sources import files, sessions, usage, webhooks
from tallyspark.streaming import jobs


def test_hierarchy_is_taken_whole_or_not_at_all(spark, tmp_path):
    good, header, twice = (tmp_path / n for n in ("good.csv", "header.csv", "twice.csv"))
    good.write_text("developer,team,division,org\nann,t,d,o\nbob,t,,o\n")
    header.write_text("name,team\nann,t\n")
    twice.write_text("developer,team,division,org\nann,t,d,o\nann,u,d,o\n")
    assert files.read_hierarchy(spark, str(good)).count() == 2
    for bad in (header, twice):
        with pytest.raises(ValueError):
            files.read_hierarchy(spark, str(bad))


def test_prices_refuse_unknown_fields(spark, tmp_path):
    (tmp_path / "p.json").write_text('{"models": {"m": {"provider": "x", "input_per_m": 1.0, "output_per_m": 2.0, "colour": 1}}}')
    with pytest.raises(ValueError, match="colour"):
        files.read_prices(spark, str(tmp_path / "p.json"))


def test_a_month_written_again_is_replaced(spark, tmp_path):
    df = spark.sql("SELECT TIMESTAMP_NTZ '2024-01-05' AS ts, 1 AS id UNION ALL SELECT TIMESTAMP_NTZ '2024-02-05', 2")
    files.write_events(df, str(tmp_path / "e"))
    files.write_events(df.where("id = 2").withColumn("id", F.lit(3)), str(tmp_path / "e"))
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "e")).collect()) == [1, 3]


def test_cells_that_look_like_formulas(spark, tmp_path):
    files.export_csv(spark.createDataFrame([("=1+1", -1), ("@x", 2), ("plain", 3), (None, 4)], "a string, b int"), str(tmp_path / "c"))
    assert {r.a for r in spark.read.option("header", True).csv(str(tmp_path / "c")).collect()} == {"'=1+1", "'@x", "plain", None}


def test_session_lines(spark):
    lines = ['{"type":"assistant","sessionId":"s","timestamp":"2024-01-01T00:00:00Z","message":{"id":"m","model":"x","usage":{"input_tokens":5,"output_tokens":1}}}', '{"type":"assistant","sessionId":"s","timestamp":"2024-01-01T00:00:05Z","message":{"id":"m","model":"x","usage":{"input_tokens":5,"output_tokens":9,"cache_creation":{"ephemeral_1h_input_tokens":3}}}}', "not json", "{}", None]
    row = sessions.folded(sessions.parsed(spark.createDataFrame([(x,) for x in lines], "value string"))).collect()
    assert [(r.session, r.message_id, r.input_tok, r.output_tok, r.cache_write_1h, r.lines) for r in row] == [("s", "m", 5, 9, 3, 2)]


def test_responses_without_usage_are_left_out(spark):
    rows = [("anthropic", '{"model":"m","usage":{"input_tokens":3,"output_tokens":2,"cache_read_input_tokens":4}}'), ("openai", '{"model":"m","usage":{"prompt_tokens":10,"completion_tokens":1,"prompt_tokens_details":{"cached_tokens":4}}}'), ("openai", "oops"), ("openai", '{"model":"m"}')]
    got = usage.responses(spark.createDataFrame(rows, "provider string, body string")).collect()
    assert sorted((r.provider, r.input_tok, r.output_tok, r.cache_read) for r in got) == [("anthropic", 3, 2, 4), ("openai", 6, 1, 4)]


def test_signatures(spark):
    sign = lambda b: "sha256=" + hmac.new(b"key", b.encode(), hashlib.sha256).hexdigest()
    df = spark.createDataFrame([("a", sign("a")), ("b", sign("a")), ("c", None)], "body string, signature string")
    assert [r.body for r in webhooks.signed(df, "key").collect()] == ["a"]


def test_deliveries_seen_before_are_dropped(spark, tmp_path):
    rows = spark.sql("SELECT id % 5 AS delivery_id, TIMESTAMP '2024-01-01' + make_dt_interval(0, 0, 0, id) AS ts FROM range(20)")
    rows.write.parquet(str(tmp_path / "in"))
    stream = jobs.latest_deliveries(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")))
    stream.writeStream.format("memory").queryName("deliveries").option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.delivery_id for r in spark.table("deliveries").collect()) == [0, 1, 2, 3, 4]
