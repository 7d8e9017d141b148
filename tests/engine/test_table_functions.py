"""Table functions called from SQL against the operators."""

import random

import pytest

from plotloom.operators import subtitles, table_functions


def test_clips(spark):
    rng = random.Random(3)
    rows = [(f"v{i % 5}", i, s := round(rng.uniform(0, 300), 3), s + rng.choice([0.0, 0.4, 7.0, 90.0]), rng.choice([" a ", "b\nc", ""]), i) for i in range(80)]
    cues = spark.createDataFrame(rows, "video_id string, pos long, start_s double, end_s double, text string, other int")
    table_functions.register(spark)
    for length in (80.0, 7.5):
        got = spark.sql(f"SELECT video_id, file, vtt FROM clips(TABLE({{c}}) PARTITION BY (video_id), {length}D)", c=cues)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, subtitles.clip_files(cues, length).collect()))
    with pytest.raises(Exception, match="column text"):
        spark.sql("SELECT * FROM clips(TABLE({c}) PARTITION BY (video_id), 1.0D)", c=cues.drop("text")).collect()
    with pytest.raises(Exception, match="above 0"):
        spark.sql("SELECT * FROM clips(TABLE({c}) PARTITION BY (video_id), 0)", c=cues).collect()


def test_html_rows_without_python(spark):
    table_functions.register(spark)
    df = spark.sql("SELECT * FROM html_rows('<p class=\"x\">One <b>two</b></p><p> </p><pre>no</pre><p>3\n4</p>')")
    assert [tuple(r) for r in df.collect()] == [(0, "One two"), (1, "3 4")]
    assert "Python" not in df._jdf.queryExecution().toString()
