"""The lazy automata, exact windows, literal sets, capped spans and captures of all matches; and values of the queries that have no SQL."""

import itertools
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from spanloom import OrderedMany, PatternError, Regex
from spanloom.functions.engine import Engine, Offsets
from spanloom.functions.pattern import Options
from spanloom.functions.sets import LiteralSet
from spanloom.operators import frames
from spanloom.plans.automaton import Scanner
from spanloom.plans.translate import plan
from spanloom.queries import rx_captures_iter, rx_steps

PATTERNS = [
    "a|ab", "(?:a|ab)(?:c|bcd)*", "(a|b)*c", "(?:aa|ab)*?b", r"\b(?:a|b)+\b", "(?m)^(?:a|bc)+$", r"(?:a?b?)*c\z", "(?:a+b)+", "a+a+b", r"(?:\w+ )+a", "(?R)(?m)^(?:a|b)*$", r"(?:a|b|)+", r"\B(?:ab|a)+", "(?:x{0,2}y){1,3}z", "(?i)(?:é|ab)+",
    "[ab]+a", "[ab]+?a[bc]*", "a*a", "(ab)+a", "[a-b]+[b-c]+c", "(?:ab|cd){2,}", "a[ab]*b$",
]


def test_scanner_is_the_machine():
    """Spans, windows and earliest ends by tables against the pattern step by step."""
    rnd = random.Random(7)
    texts = ["".join(x) for n in range(5) for x in itertools.product("abc", repeat=n)] + ["".join(rnd.choice("aabbc \n\ré_xyz") for _ in range(rnd.randrange(1, 14))) for _ in range(150)]
    for p in PATTERNS:
        e = Engine(p, Options())
        s = Scanner(e.plan.root, e.groups)
        for t in texts:
            for a in {0, len(t) // 2}:
                for b in {len(t), len(t) - len(t) // 3}:
                    if a <= b:
                        assert s.search(t, a, b) == e.machine.search(t, a, b), (p, t, a, b)
                        one, two = s.search(t, a, b, earliest=True), e.machine.search(t, a, b, earliest=True)
                        assert (one and one[1]) == (two and two[1]), (p, t, a, b)


def test_safe_patterns_run_alike_everywhere(spark):
    """Possessive repeats and skipped starts change no answer: the regex module, Java, and the pattern step by step."""
    rnd = random.Random(8)
    texts = ["".join(rnd.choice("aabbc1. \n@é") for _ in range(rnd.randrange(0, 25))) for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for p in ["[ab]+c", "[ab]+b", "a+?b", "(?m)[abc]+$", "[ab]{2,}a", "([ab]+)(c?)1", "[a-c]+ ?[0-9]", "a+|b+c", "(?:ab)+a", r"[ab]+\b", "a*b", "[ab]+1[ab]", "[ab]+(?:1|c)", "[ab]+(?:a1)?b", "[abc]+?ab", "[ab]+$", "(?s).+c"]:
        r = Regex(p)
        assert not r.plan.unsafe, p
        e = Engine(p, Options())
        rows = df.select("i", r.count("t").alias("n"), r.span_sum("t").alias("bytes"), r.is_match("t").alias("m"), r.find("t", chars=True).alias("s"), r.find_text("t").alias("x"), r.replace("t", "<>").alias("one"), r.match_stats("t").alias("st")).collect()
        for row in rows:
            t = texts[row.i]
            spans, at, last = [], 0, -1
            while at <= len(t) and (m := e.machine.search(t, at)):
                if m[0] == m[1] == last:
                    at += 1
                    last = -1
                    continue
                spans.append((m[0], m[1]))
                at = last = m[1]
            assert [tuple(x) for x in e.spans(t)] == spans, (p, t)
            size = sum(len(t[a:b].encode()) for a, b in spans)
            assert (row.n, row.bytes, row.m, tuple(row.st)) == (len(spans), size, bool(spans), (len(spans), size)), (p, t)
            assert (row.s and tuple(row.s)) == (spans[0] if spans else None)
            assert (row.x and row.x.text) == (t[slice(*spans[0])] if spans else None)
            assert row.one == (t[:spans[0][0]] + "<>" + t[spans[0][1]:] if spans else t)


def test_no_pattern_hangs(spark):
    text = "a" * 100_000
    for p in ("[a-z]+[a-z]+[a-z]+1", "(?:[a-z]{1,16}){1,16}1", "[a-z]+1", "(?:a|aa)+b", "(a*)*b", "a+a+a+a+b", r"(?:\w+\s?)+!"):
        began = time.process_time()
        assert Engine(p, Options()).at(text, 0) is None
        assert time.process_time() - began < 3, p
    began = time.time()
    assert [r[0] for r in spark.createDataFrame([(text,)], "t string").select(Regex("[a-z]+1").is_match("t") | Regex("[a-z]+[a-z]+[a-z]+1").is_match("t")).collect()] == [False]
    assert time.time() - began < 20
    assert plan("[a-z]+[a-z]+1").unsafe and plan("(?:[a-z]{1,16}){1,16}1").unsafe and not plan("[a-z]+@[a-z]+[.][a-z]+").unsafe


def test_offsets_of_long_texts():
    text = "é日a" * 50_000
    o, began = Offsets(text), time.process_time()
    for k in range(0, len(text), 3):
        assert o.chars(o.bytes(k)) == k
    assert o.bytes(len(text)) == len(text.encode()) and time.process_time() - began < 5


def test_exact_windows_and_caps(spark):
    df = spark.createDataFrame([("xabab", 1, 5), ("xabab", 1, 3), ("aab", 0, 2), ("é ab", 3, 5), ("é", 1, 2), (None, 0, 0), ("ab", 5, 6)], "t string, a int, b int")
    got = [r[0] for r in df.select(Regex("(a)(b)?(ab)?").captures_exact_window("t", F.col("a"), F.col("b"))).collect()]
    plain = [None if g is None else [x and tuple(x) for x in g] for g in got]
    assert plain == [[(1, 5), (1, 2), (2, 3), (3, 5)], [(1, 3), (1, 2), (2, 3), None], None, [(3, 5), (3, 4), (4, 5), None], None, None, None]
    got = df.where("t = 'xabab'").limit(1).select(Regex("[ab]").find_capped("t", 3).alias("f"), OrderedMany(["a", "b"]).spans("t", cap=2).alias("s"), OrderedMany(["a", "b"]).total("t").alias("n")).first()
    assert (len(got.f.spans), got.f.total, len(got.s), got.n) == (3, 4, 2, 4)
    assert [r[0] and (r[0].start, r[0].text) for r in df.select(Regex("b").find_text_at("t", 3)).collect()][:2] == [(4, "b"), (4, "b")]


def test_literal_sets(spark):
    texts = ["he", "she", "his", "hers", "he", "é"]
    df = spark.createDataFrame([(1, "ushers é"), (2, "hi"), (3, None), (4, "")], "i int, t string")
    many = LiteralSet(texts)
    assert [tuple(r) for r in df.select(many.matches("t"), many.count("t"), many.is_match("t")).collect()] == [([0, 1, 3, 4, 5], 5, True), ([], 0, False), (None, None, None), ([], 0, False)]
    assert [r[0] for r in df.select(LiteralSet([]).matches("t")).collect()] == [[], [], None, []]
    thousands = [f"word{i}x" for i in range(20_000)]
    assert df.select(LiteralSet(thousands).matches(F.lit("a word77x and word19999x"))).first()[0] == [77, 19999]
    table = spark.createDataFrame([(0, "he", 5), (1, "zz", 6), (2, None, 7), (3, "", 8), (4, "he", 9)], "k int, w string, _found int")
    joined = frames.join_literals(df, "t", table, "w")
    assert sorted((r.i, r.k, r._found) for r in joined.collect()) == [(1, 0, 5), (1, 4, 9)]
    assert frames.join_literals(df.limit(0), "t", table, "w").count() == 0 and frames.join_literals(df, "t", table.limit(0), "w").count() == 0
    with pytest.raises(PatternError):
        frames.join_patterns(df, "t", spark.createDataFrame([("a",)], "pattern string"), how="outer")


def test_alternatives_reach_the_reader(spark, tmp_path):
    spark.createDataFrame([("x",)], "t string").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t")).where(Regex("abc|def").is_match("t"))
    assert "StringContains(t,abc)" in (text := df._jdf.queryExecution().executedPlan().toString()) and "StringContains(t,def)" in text


def test_captures_of_all_matches_of_lines(spark):
    df = spark.createDataFrame([(1, "a1 b\nb2\n\na3a"), (2, None), (3, "")], "i int, t string")
    r = Regex("(a)|(b)([0-9])?")
    assert [x[0] for x in df.select(r.grep_captures_count("t")).collect()] == [2 + 2 + 3 + 2 + 2, None, 0]
    assert [x[0] for x in df.select(Regex("([ab])([0-9])").grep_captures_count("t")).collect()] == [9, None, 0]
    rows = [(x.i, x.line_no, x.match_no, x.groups) for x in frames.grep_all_captures(df, "t", r).collect()]
    assert rows == [(1, 1, 0, ["a", "a", None, None]), (1, 1, 1, ["b", None, "b", None]), (1, 2, 0, ["b2", None, "b", "2"]), (1, 4, 0, ["a", "a", None, None]), (1, 4, 1, ["a", "a", None, None])]


def test_queries_without_sql(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in rx_captures_iter(spark, sf_dir).collect():
        t = texts[r.doc_id]
        byte = lambda i: len(t[:i].encode())  # noqa: E731, B023
        want = [[None if m.start(k) < 0 else (byte(m.start(k)), byte(m.end(k))) for k in range(3)] for m in re.finditer(r"([a-z]+)@(?:([a-z0-9]+)\.)?", t)]
        assert [[g and tuple(g) for g in m] for m in r.groups] == want
        assert (r.first and [g and tuple(g) for g in r.first]) == (want[0] if want else None) and r.part == (want and [g is not None for g in want[0]] or None)
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    for r in rx_steps(spark, sf_dir).collect():
        t, want, at = urls[r.page_id], [], 0
        assert t.isascii()
        for m in re.finditer("[0-9]*", t):
            if m.start() == m.end() == at and want and want[-1][0] == "M" and want[-1][2] == at:
                continue  # empty, right after a match
            want += [("R", at, m.start())] if m.start() > at else []
            want.append(("M", *m.span()))
            at = m.end()
        assert [tuple(s) for s in r.steps] == want + ([("R", at, len(t))] if at < len(t) else [])
