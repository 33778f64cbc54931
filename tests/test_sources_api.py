import json
import random
import sqlite3
import zipfile

import pytest
from pyspark.sql import functions as F

from sparktide import __main__ as cli
from sparktide import api
from sparktide.sources import readers, writers
from sparktide.streaming import topics as stream


def test_delimited_files_keep_quotes_and_line_breaks(spark, tmp_path):
    (tmp_path / "a.csv").write_text('text;n\n"two\nlines; and ""quotes""";1\nplain;2\n', encoding="utf-8")
    rows = readers.read_table(spark, str(tmp_path / "a.csv"), ";").collect()
    assert [(r.text, r.n) for r in rows] == [('two\nlines; and "quotes"', "1"), ("plain", "2")]
    with pytest.raises(ValueError):
        readers.read_table(spark, "x.unknown")


def test_workbook(spark, tmp_path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(tmp_path / "a.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>text</t></si><si><r><t>he</t></r><r><t>llo</t></r></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>n</t></is></c></row><row><c r="A2" t="s"><v>1</v></c><c r="C2"><v>7</v></c></row></sheetData></worksheet>')
    d = readers.read_table(spark, str(tmp_path / "a.xlsx"))
    assert d.columns == ["text", "_c1", "n"] and d.collect()[0].asDict() == {"text": "hello", "_c1": None, "n": "7"}


def test_sqlite_round_trip(spark, tmp_path):
    d = spark.createDataFrame([(1, "a", 1.5, None), (2, None, None, True)], "i bigint, `te\"xt` string, x double, b boolean")
    path = str(tmp_path / "a.db")
    assert readers.write_sqlite(d, path, "t") == 2
    back = readers.read_table(spark, path)
    assert [tuple(r) for r in back.orderBy("i").collect()] == [(1, "a", 1.5, None), (2, None, None, 1)]
    assert readers.write_sqlite(d, path, "t", append=True) == 2
    assert sqlite3.connect(path).execute("SELECT count(*) FROM t").fetchone() == (4,)
    assert readers.persisted(d, path, "u").count() == 2 and readers.persisted(d, path, "v", save=False) is d


def test_citation_export(spark, tmp_path):
    (tmp_path / "x.txt").write_text("\nPMID- 1\nTI  - A title\n      goes on\nAB  - Words.\nFAU - One, A\nFAU - Two, B\nDP  - 2020 Mar 4\nAID - 10.1/x [doi]\nJT  - Journal\n\nPMID- 2\nTI  - Other\nDP  - 2021\n", encoding="utf-8")
    a, b = readers.read_citations(spark, str(tmp_path / "x.txt")).orderBy("pmid").collect()
    assert a.asDict() == {"pmid": "1", "title": "A title goes on", "abstract": "Words.", "authors": "One, A; Two, B", "journal": "Journal", "year": 2020, "month": "Mar", "doi": "10.1/x"}
    assert (b.pmid, b.title, b.abstract, b.year, b.month) == ("2", "Other", None, 2021, None)


def texts(n=60):
    rng = random.Random(0)
    groups = (["ocean", "whale", "ship", "wave", "harbor"], ["engine", "wheel", "motor", "brake", "gear"])
    return [(i, " ".join(rng.choices(groups[i % 2], k=12)), f"20{10 + i % 3}-02-03", float(i)) for i in range(n)]


SCHEMA = "id bigint, body string, day string, rank double"


def test_analysis_separates_two_groups_and_saves(spark, tmp_path):
    df = spark.createDataFrame([*texts(), (500, None, None, None)], SCHEMA)
    r = api.run_topic_analysis(spark, dataframe=df, column="body", topics=2, words_per_topic=5, id_col="id", datetime_col="day", weight_col="rank", rounds=50)
    words = {}
    for x in r.words.collect():
        words.setdefault(x.topic_id, set()).add(x.term)
    assert sorted(map(sorted, words.values())) == [["brake", "engine", "gear", "motor", "wheel"], ["harbor", "ocean", "ship", "wave", "whale"]]
    best = {x.doc_id: x.topic_id for x in r.dominant.collect()}
    assert len({best[i] for i in range(0, 60, 2)}) == 1 and best[0] != best[1]
    assert r.periods.count() == 3
    paths = r.save(str(tmp_path), "a")
    assert set(json.load(open(paths["words"]))) == {"Topic 01", "Topic 02"}
    writers.save_model(r.factors.h, str(tmp_path / "model"))
    assert writers.load_model(spark, str(tmp_path / "model")).count() == r.factors.h.where("weight > 0").count()


def test_methods_merges_and_bad_options(spark):
    df = spark.createDataFrame(texts(30), SCHEMA)
    r = api.run_topic_analysis(spark, dataframe=df, column="body", topics=2, ngrams="bpe", merges=2, method="nmtf", rounds=20)
    assert len(r.merges) == 2 and r.factors.s is not None
    for bad in ({"topics": 0}, {"language": "XX"}, {"method": "none"}):
        with pytest.raises(ValueError):
            api.run_topic_analysis(spark, dataframe=df, column="body", **bad)
    with pytest.raises(ValueError):
        api.run_topic_analysis(spark, dataframe=df, column="absent")
    with pytest.raises(ValueError):
        api.run_topic_analysis(spark, column="body")


def test_command_line_arguments():
    a = cli.parser().parse_args(["analyze", "x.csv", "--column", "text", "--topics", "3", "--language", "tr"])
    assert (a.topics, a.language, a.column) == (3, "TR", "text")


def test_stream_scores_as_a_table_does_and_windows_close(spark, tmp_path):
    h = spark.createDataFrame([(1, "whale", 1.0), (1, "ship", 0.5), (2, "motor", 2.0)], "topic_id int, term string, weight double")
    rows = [(1, "Whale and ship", "2024-01-01 00:10:00"), (2, "motor", "2024-01-01 00:20:00"), (3, "none known", "2024-01-01 05:00:00"), (4, None, "2024-01-01 09:00:00")]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, at string").withColumn("at", F.col("at").cast("timestamp"))
    d.coalesce(1).write.parquet(str(tmp_path / "in"))
    table = {r.doc_id: r.topic_id for r in stream.score_stream(d, h).collect()}
    assert table == {1: 1, 2: 2, 3: -1, 4: -1}
    live = stream.windowed_shares(stream.score_stream(spark.readStream.schema(d.schema).parquet(str(tmp_path / "in")), h), "at", late="1 hour")
    q = live.writeStream.format("memory").queryName("shares").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(120)
    got = {(r.start.hour, r.topic_id): r.n for r in spark.table("shares").collect()}
    assert got[(0, 1)] == 1 and got[(0, 2)] == 1 and got[(5, -1)] == 1


def test_online_topics_take_in_batches_and_repeat_safely(spark, tmp_path):
    rows = [(i, w, 1.0) for i, t, _, _ in texts(40) for w in sorted(set(t.split()))]
    model = stream.OnlineTopics(spark, str(tmp_path), [r[1] for r in rows], 2)
    first = spark.createDataFrame([r for r in rows if r[0] < 20], "doc_id bigint, term string, w double")
    model(first, 0)
    again = spark.createDataFrame([r for r in rows if r[0] >= 20], first.schema)
    model(again, 1)
    h = model.states[1][0].copy()
    model(again, 1)
    assert (h == model.states[1][0]).all()
    w = spark.read.parquet(f"{tmp_path}/w").groupBy("doc_id").agg(F.max_by("topic_id", "weight").alias("t"))
    best = {r.doc_id: r.t for r in w.collect()}
    assert len({best[i] for i in range(0, 40, 2)}) == 1 and best[0] != best[1]
