"""DataFrame operators, sources and streams."""

import pytest

from spanloom import PatternError
from spanloom.operators import frames
from spanloom.sources import corpus
from spanloom.streaming import grep as stream


@pytest.fixture
def docs(spark):
    return spark.createDataFrame([(1, "en", "One fish\ntwo FISH\n"), (2, "de", "kein Fisch é42"), (3, "en", None), (4, None, "")], "id int, lang string, text string")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_explode_and_grep(docs):
    assert rows(frames.explode_matches(docs, "text", "[0-9]+")) == [(2, "de", 0, 13, 15, "42")]
    assert rows(frames.explode_matches(docs, "text", "[0-9]+", chars=True)) == [(2, "de", 0, 12, 14, "42")]
    assert rows(frames.explode_texts(docs.select("id", "text"), "text", "fish|FISH")) == [(1, 0, "fish"), (1, 1, "FISH")]
    assert rows(frames.explode_lines(docs.select("id", "text"), "text")) == [(1, 1, "One fish"), (1, 2, "two FISH"), (2, 1, "kein Fisch é42")]
    assert rows(frames.grep(docs.select("id", "text"), "text", "fish", ignore_case=True, word=True)) == [(1, 1, "One fish"), (1, 2, "two FISH")]
    assert rows(frames.grep(docs.select("id", "text"), "text", "fish", invert=True)) == [(1, 2, "two FISH"), (2, 1, "kein Fisch é42")]
    assert rows(frames.grep_captures(docs.select("id", "text"), "text", "(?P<n>[A-Za-z]+) (?P<what>fish)")) == [(1, 1, "One", "fish")]
    with pytest.raises(PatternError):
        frames.explode_texts(docs, "text", "a*")


def test_reducers(docs):
    got = rows(frames.reduce_by(docs, ["lang"], "text", "(?i)fi[a-z]+"))
    assert got == [("de", 1, 1, 1, 5), ("en", 2, 1, 2, 8), (None, 1, 0, 0, 0)]
    assert rows(frames.pattern_counts(docs, "text", ["fish", "[0-9]"])) == [(0, 1, 1), (1, 2, 1)]
    assert rows(frames.operations(docs.select("id", "text"), "text", {"n": ("count", "i"), "has": ("search", "x")}).select("id", "n", "has")) == [(1, 1, False), (2, 2, False), (3, None, None), (4, 0, False)]
    with pytest.raises(PatternError):
        frames.operations(docs, "text", {"n": ("sum", "i")})


def test_pattern_tables(spark, docs):
    table = spark.createDataFrame([(0, "fish"), (1, "[0-9]+"), (1, "[0-9]+"), (2, None)], "pid int, pattern string")
    joined = frames.join_patterns(docs.select("id", "text"), "text", table)
    assert rows(joined.select("id", "pid")) == [(1, 0), (2, 1), (2, 1)]
    assert rows(frames.join_patterns(docs.select("id", "text"), "text", table, how="leftsemi").select("id")) == [(1,), (2,)]
    assert rows(frames.join_patterns(docs.select("id", "text"), "text", table, how="leftanti").select("id")) == [(3,), (4,)]
    with pytest.raises(PatternError):
        frames.join_patterns(docs, "text", spark.createDataFrame([("(a|bc)*d",)], "pattern string"))


def test_redux(spark):
    df = spark.createDataFrame([(">x y\nacgt\nacga\n",)], "text string")
    r = frames.regex_redux(df, "text", ["ac", "t|a"], [("gt", "<>"), ("a", "")]).first()
    assert (r.original_bytes, r.clean_bytes, r.variant_0, r.variant_1, r.final_bytes) == (15, 8, 2, 4, 5)


def test_empty_table(spark):
    none = spark.createDataFrame([], "id int, text string")
    assert frames.grep(none, "text", "a").count() == 0
    assert frames.explode_matches(none, "text", "a").count() == 0
    assert frames.reduce_by(none, ["id"], "text", "a").count() == 0


def test_sources_and_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_bytes(b"one fish\r\ntwo\n")
    (tmp_path / "in" / "b.txt").write_bytes("drei é".encode())
    (tmp_path / "in" / ".hidden").mkdir()
    (tmp_path / "in" / ".hidden" / "c.txt").write_text("fish")
    path = str(tmp_path / "in")
    assert sorted(r.text for r in corpus.texts(spark, path).collect()) == ["drei é", "one fish\r\ntwo\n"]
    assert sorted(r.line for r in corpus.lines(spark, path).collect()) == ["drei é", "one fish", "two"]
    assert corpus.files(spark, path).count() == 2
    found = frames.grep(corpus.texts(spark, path), "text", "fish")
    corpus.write_text(corpus.grep_lines(found), str(tmp_path / "out"))
    assert [r.value.rsplit("/", 1)[1] for r in spark.read.text(str(tmp_path / "out")).collect()] == ["a.txt:1:one fish"]
    q = stream.grep_stream(stream.line_stream(spark, path), "fish").writeStream.format("memory").queryName("found").start()
    q.processAllAvailable()
    q.stop()
    assert "one fish" in [r.line for r in spark.sql("SELECT * FROM found").collect()]
