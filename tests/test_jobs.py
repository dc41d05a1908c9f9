"""The jobs over growing copies of their input: what is new is taken, what is old stays, a second run changes nothing."""

import json
import logging

import pytest
from pyspark.sql import functions as F

from jobs import cli, passage_index, unit_quality
from lamina.operators import text

DOCS = "doc_id bigint, text string, lang string, source string"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s") for i, t, lang in rows], DOCS).coalesce(1)


def everything(spark, output):
    return {name: sorted(map(tuple, passage_index.opened(spark, output, name).collect()), key=str) for name in passage_index.TABLES}


def test_index_follows_a_growing_folder(spark, tmp_path, caplog):
    source, out, state, asked = (str(tmp_path / x) for x in ("docs", "index", "state", "asked"))
    spark.createDataFrame([(1, "red fox fox"), (2, "blue"), (3, None), (None, "red"), (4, "nothing here")], "item_id bigint, text string").write.parquet(asked)
    run = lambda: sorted(map(tuple, passage_index.run(spark, source, out, state, asked, size=20, buckets=3, k=2, files_per_batch=1).collect()))
    first = [(1, "The red fox met a blue bird and a red bird", "en"), (2, "", "en"), (3, None, None), (None, "red red red", "en"), (4, "Blue blue", "")]
    docs_of(spark, first).write.parquet(source)
    with caplog.at_level(logging.INFO):
        one = run()
    assert "4 new documents, 4 passages" in caplog.text and "wrote" in caplog.text
    before = everything(spark, out)
    assert run() == one and everything(spark, out) == before
    # the same file again, a known id with another text, and two new documents, one of them twice
    docs_of(spark, first).write.mode("append").parquet(source)
    docs_of(spark, [(1, "red red red", "en"), (5, "a red fox", "fr"), (6, "fox a", "fr"), (6, "fox", "en")]).write.mode("append").parquet(source)
    two = run()
    after = everything(spark, out)
    assert run() == two and everything(spark, out) == after
    assert all(set(before[t]) <= set(after[t]) for t in before)
    assert sorted(r[0] for r in after["documents"]) == [1, 2, 3, 4, 5, 6]
    assert {r[0]: (r[2], r[4]) for r in after["passages"] if r[0] > 3} == {4: ("Blue blue", "none"), 5: ("a red fox", "fr"), 6: ("fox a", "fr")}
    # the index equals one of all documents at once
    final = docs_of(spark, [(1, first[0][1], "en"), (4, "Blue blue", ""), (5, "a red fox", "fr"), (6, "fox a", "fr")])
    p = text.chunk(final, 20)
    assert sorted(r[:5] for r in after["postings"]) == sorted(map(tuple, text.postings(p).collect()))
    plain = text.bm25(p.select(F.concat_ws("#", "doc_id", "chunk").alias("doc_id"), "text"), spark.read.parquet(asked).where("item_id is not null").withColumnRenamed("item_id", "query_id"), 2)
    assert [(q, f"{d}#{c}", r, pytest.approx(s)) for q, d, c, s, r in two] == sorted((r["query_id"], r["doc_id"], r["rank"], r["score"]) for r in plain.collect())


def test_a_batch_that_is_run_again_writes_the_same(spark, tmp_path):
    out = str(tmp_path / "index")
    passage_index.take_batch(docs_of(spark, [(1, "one two", "en")]), 0, out, 1200, 2)
    again = docs_of(spark, [(1, "one two", "en"), (2, "two three", "en")])
    passage_index.take_batch(again, 1, out, 1200, 2)
    found = everything(spark, out)
    passage_index.take_batch(again, 1, out, 1200, 2)
    assert everything(spark, out) == found and [r[:2] for r in found["documents"]] == [(1, 1), (2, 1)]


def test_an_empty_folder_has_no_answers(spark, tmp_path):
    source, asked = str(tmp_path / "docs"), str(tmp_path / "asked")
    docs_of(spark, []).write.parquet(source)
    spark.createDataFrame([(1, "red")], "item_id bigint, text string").write.parquet(asked)
    assert passage_index.run(spark, source, str(tmp_path / "out"), str(tmp_path / "state"), asked).count() == 0
    assert passage_index.run(spark, source, str(tmp_path / "out"), str(tmp_path / "state")).columns == ["term", "df", "n"]


EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, value double"


def events_of(spark, rows):
    return spark.sql("SELECT * FROM VALUES " + ", ".join(f"({i}L, TIMESTAMP_NTZ'{t}', {u})" for i, t, u in rows) + " AS t(event_id, ts, user_id)").withColumn("user_id", F.col("user_id").cast("bigint"))


@pytest.mark.parametrize("kind", ["parquet", "json", "csv", "orc"])
def test_quality_takes_new_and_changed_sessions(spark, tmp_path, caplog, kind):
    source, out = str(tmp_path / "events"), str(tmp_path / "quality")
    save = lambda rows: events_of(spark, rows).coalesce(1).write.mode("append").format(kind).option("header", True).save(source)
    run = lambda: unit_quality.run(spark, source, out, kind, refractory=1.0, burst=2.0, least_spikes=3, most_refractory=0.5)
    save([(i, f"2024-01-0{d} 10:00:{s:02d}", u) for i, (d, s, u) in enumerate([(1, 0, 7), (1, 3, 7), (1, 9, 7), (1, 5, 8), (2, 1, 7), (2, 1, 7)])] + [(99, "2024-01-01 10:00:00", "NULL")])
    with caplog.at_level(logging.INFO):
        one = sorted(map(tuple, run().collect()), key=str)
    assert "2 sessions are new or have changed, with 6 events" in caplog.text
    assert [(str(r[-1]), r[0], r[1], r[-2]) for r in one] == [("2024-01-02", 7, 2, False), ("2024-01-01", 7, 3, True), ("2024-01-01", 8, 1, False)]
    caplog.clear()
    with caplog.at_level(logging.INFO):
        assert sorted(map(tuple, run().collect()), key=str) == one
    assert "0 sessions are new" in caplog.text
    files = sorted(str(p) for p in (tmp_path / "quality/units/session=2024-01-01").glob("*.parquet"))
    save([(100, "2024-01-02 10:00:30", 7), (101, "2024-01-03 00:00:00", 9)])
    caplog.clear()
    with caplog.at_level(logging.INFO):
        two = {(str(r["session"]), r["unit"]): r["n_spikes"] for r in run().collect()}
    assert "2 sessions are new or have changed, with 4 events" in caplog.text
    assert two == {("2024-01-01", 7): 3, ("2024-01-01", 8): 1, ("2024-01-02", 7): 3, ("2024-01-03", 9): 1}
    assert sorted(str(p) for p in (tmp_path / "quality/units/session=2024-01-01").glob("*.parquet")) == files
    counts = {str(r["session"]): (r["n_units"], r["n_passed"], r["n_spikes"]) for r in unit_quality.opened(spark, out, "sessions").collect()}
    assert counts == {"2024-01-01": (2, 1, 4), "2024-01-02": (1, 1, 3), "2024-01-03": (1, 0, 1)}


def test_quality_of_no_events(spark, tmp_path):
    spark.createDataFrame([], EVENTS).write.parquet(str(tmp_path / "events"))
    assert unit_quality.run(spark, str(tmp_path / "events"), str(tmp_path / "out")).count() == 0


def test_settings_of_the_command_line(tmp_path):
    config = tmp_path / "c.json"
    config.write_text(json.dumps({"events": "a", "output": "b", "burst": 1}))
    assert cli.settings(unit_quality.run, [str(config), "burst=0.5", "output=/x", "--master", "local[2]"]) == ("local[2]", {"events": "a", "output": "/x", "burst": 0.5})
    with pytest.raises(SystemExit):
        cli.settings(unit_quality.run, [str(config), "nonsense=1"])
    for job, name in ((passage_index, "passage_index"), (unit_quality, "unit_quality")):
        assert cli.settings(job.run, [f"{cli.__file__.rsplit('/', 1)[0]}/{name}.json"])[1]


def test_words_are_counted_and_scored_where_their_passage_is(spark, capsys):
    p = spark.createDataFrame([(1, 0, "red red fox"), (1, 1, "fox")], "doc_id bigint, chunk bigint, text string")
    posted = text.postings(p)
    assert sorted(map(tuple, posted.collect())) == [("fox", 1, 0, 1, 3), ("fox", 1, 1, 1, 1), ("red", 1, 0, 2, 3)]
    q = spark.sql("SELECT * FROM VALUES (7L, 'fox', 1L), (8L, 'fox', 1L), (8L, 'red', 1L) AS t(query_id, term, times)")  # of known size, as a file is
    found = posted.withColumn("df", F.lit(1)).repartition("doc_id", "chunk")
    best = text.search(found, q, spark.sql("SELECT 2L AS N, 2D AS avg"), ["term"], 1)
    assert {(r["query_id"], r["doc_id"], r["chunk"]) for r in best.collect()} == {(7, 1, 1), (8, 1, 0)}
    capsys.readouterr()
    posted.explain()
    best.explain()
    shown = capsys.readouterr().out
    # neither counting nor scoring deals rows out by word or by question and passage
    assert "hashpartitioning(term" not in shown and "hashpartitioning(query_id#" in shown
    assert not [x for x in shown.splitlines() if "hashpartitioning(query_id" in x and "doc_id" in x]
