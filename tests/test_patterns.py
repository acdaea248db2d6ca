"""Facts about single patterns: spans, reducers, replacing, splitting, lines, options, refusals."""

import itertools

import pytest
from pyspark.sql import functions as F

from spanloom import LimitError, OrderedMany, PatternError, Regex, RegexSet, UnsupportedPattern, check_rewrite, escape, quote_meta
from spanloom.functions.engine import Engine
from spanloom.functions.pattern import Options, lines, template_parts
from spanloom.plans.syntax import Alt, Cat, Chars, Empty, Group, Look, Repeat, parse, utf8_sequences


def spans(pattern, text, **options):
    return [(m[0], m[1]) for m in Engine(pattern, Options(**options)).each(text)]


def fetch(spark, texts, *columns, kind="string"):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], f"i int, t {kind}")
    rows = df.select("i", *columns).orderBy("i").collect()
    return [row[1] if len(row) == 2 else tuple(row)[1:] for row in rows]


@pytest.mark.parametrize(
    ("pattern", "text", "expected"),
    [
        (r"\A|a\z", "ba", [(0, 0), (1, 2)]),
        (r"\d*", "a1bbb2", [(0, 0), (1, 2), (3, 3), (4, 4), (5, 6)]),
        ("a|(?:)", "a", [(0, 1)]),
        ("a*?", "baab", [(0, 0), (1, 1), (2, 2), (3, 3), (4, 4)]),
        ("a*", "aaaa", [(0, 4)]),
        ("(?:|ab)", "ab", [(0, 0), (1, 1), (2, 2)]),
        ("(?:ab|)", "ab", [(0, 2)]),
        ("(?m)^", "a\nb\n", [(0, 0), (2, 2), (4, 4)]),
        ("(?m)$", "a\nb\n", [(1, 1), (3, 3), (4, 4)]),
        ("a$", "a\n", []),
        ("(?i)k", "K", [(0, 1)]),
        (r"\b\w{13}\b", "Retroactively relinquishing remunerations is reprehensible.", [(0, 13), (14, 27), (28, 41), (45, 58)]),
        (r"(?x) a \s b # c", "a b", [(0, 3)]),
        ("[a-z--[aeiou]]+", "hello", [(0, 1), (2, 4)]),
        ("[a-f~~d-z]+", "abcdefgh", [(0, 3), (6, 8)]),
        ("(?U)a+", "aa", [(0, 1), (1, 2)]),
        (r"\bé\b", "é", [(0, 1)]),
        (r"(?R)(?m)^b$", "a\r\nb\r\n", [(3, 4)]),
        (r"\b{start}a", "ba a", [(3, 4)]),
    ],
)
def test_spans(pattern, text, expected):
    assert spans(pattern, text) == expected


def test_ascii_mode_and_octal():
    assert spans(r"\bé\b", "é", unicode=False) == []
    assert spans(r"\w+", "naïve", unicode=False) == [(0, 2), (3, 5)]
    assert spans(r"\141", "xa", octal=True) == [(1, 2)]


def test_window_sees_the_whole_text():
    assert Engine(r"\Aa", Options()).at("za", 1) is None
    e = Engine(r"\bab\b", Options())
    assert e.window("xab c", 1, 3) is None and e.window(" ab c", 1, 3)[:2] == [1, 3]
    assert Engine("a+", Options()).window("aaaa", 1, 3)[:2] == [1, 3]


def test_unmatched_is_not_empty():
    assert Engine("(a*)*", Options()).at("x", 0) == [0, 0, 0, 0]
    assert Engine("(a)|(b*)", Options()).at("x", 0) == [0, 0, None, None, 0, 0]


def brute(node, text, at):
    """Ends of all matches from at, in order of priority, by plain backtracking."""
    if isinstance(node, Empty):
        yield at
    elif isinstance(node, Chars):
        if at < len(text) and any(a <= ord(text[at]) <= b for a, b in node.ranges):
            yield at + 1
    elif isinstance(node, Look):
        if (node.kind == "start" and at == 0) or (node.kind == "end" and at == len(text)):
            yield at
    elif isinstance(node, Group):
        yield from brute(node.part, text, at)
    elif isinstance(node, Alt):
        for p in node.parts:
            yield from brute(p, text, at)
    elif isinstance(node, Cat):
        if not node.parts:
            yield at
        else:
            for mid in brute(node.parts[0], text, at):
                yield from brute(Cat(node.parts[1:]), text, mid)
    elif isinstance(node, Repeat):
        more = node.high is None or node.high > 0

        def deeper():
            if more:
                for mid in brute(node.part, text, at):
                    if mid > at or node.high is not None:
                        yield from brute(Repeat(node.part, max(0, node.low - 1), None if node.high is None else node.high - 1, node.greedy), text, mid)

        if node.low > 0:
            yield from deeper()
        elif node.greedy:
            yield from deeper()
            yield at
        else:
            yield at
            yield from deeper()


def test_small_grammar_against_backtracking():
    atoms = ["", "a", "b", "[a-b]", r"\A", r"\z"]
    pairs = [f"(?:{x}){y}" for x in atoms for y in atoms] + [f"(?:{x}|{y})" for x in atoms for y in atoms]
    patterns = atoms + pairs + [f"(?:{p})?" for p in pairs[::3]] + [f"(?:{p})??" for p in pairs[::5]] + [f"(?:{x})*" for x in ("a", "ab", "[ab]", "a|b", "ab|b")] + ["(?:a|ab)(?:c|b)*?", "a{2}b{0,2}"]
    texts = ["".join(x) for n in range(5) for x in itertools.product("ab", repeat=n)]
    for p in patterns:
        root, e = parse(p).root, Engine(p, Options())
        for t in texts:
            first = next(((i, end) for i in range(len(t) + 1) for end in itertools.islice(brute(root, t, i), 1)), None)
            got = e.machine.search(t)
            assert (None if got is None else (got[0], got[1])) == first, (p, t)
            at = e.at(t, 0)
            assert (None if at is None else (at[0], at[1])) == first, (p, t)


def test_bytes(spark):
    raw = [bytes.fromhex("e29883ff"), b"\xff\x61\xc3\x61", "aé".encode()]
    empty = Regex("", bytes_mode=True)
    assert fetch(spark, raw, F.size(empty.find_iter("t")), kind="binary") == [5, 5, 4]
    assert fetch(spark, raw, Regex("(?-u)[^a]", bytes_mode=True).count("t"), kind="binary") == [4, 2, 2]
    assert fetch(spark, raw, Regex("é", bytes_mode=True).find("t")["start"], kind="binary") == [None, None, 1]
    assert [bytes(x) for x in fetch(spark, [raw[0]], empty.split("t"), kind="binary")[0]] == [b"", b"\xe2", b"\x98", b"\x83", b"\xff", b""]
    with pytest.raises(UnsupportedPattern):
        Regex(r"\b", bytes_mode=True)


def test_utf8_sequences_cover_each_character_once():
    for low, high in ((0, 0x10FFFF), (0x80, 0x7FF), (0x3B1, 0x3C9), (0xFFF0, 0x10010)):
        seqs = list(utf8_sequences(low, high))
        for c in {low, high, 0x41, 0xE9, 0x3B1, 0x800, 0xD7FF, 0xE000, 0xFFFF, 0x10000, 0x10FFFF}:
            n = sum(len(s) == len(b) and all(x <= v <= y for (x, y), v in zip(s, b)) for s in seqs for b in [chr(c).encode()])
            assert n == (low <= c <= high), hex(c)


def test_reducers_agree(spark):
    texts = ["", "a", "aaaa", "baab", "xyz aab ab b", "é aé\nab", "marks a", None]
    for p in ("a", "a+", "a*", "a*?", "(?:|ab)", "[ab]+b", r"\ba", "(a|b)*", "(a)|(b)", "a|ab", r"(?:a|ab)*\z"):
        r = Regex(p)
        rows = fetch(spark, texts, r.count("t"), r.span_sum("t"), r.is_match("t"), r.match_stats("t"), F.transform(r.find_iter("t"), lambda s: s["end"] - s["start"]), r.count_captures("t"), r.steps("t"))
        for text, (count, total, found, stats, lengths, groups, steps) in zip(texts, rows):
            if text is None:
                assert (count, total, found, stats, lengths) == (None,) * 5
                continue
            assert count == len(lengths) == stats["count"], (p, text)
            assert total == sum(lengths) == stats["span_sum"], (p, text)
            assert found == (count > 0), (p, text)
            assert groups >= count
            assert steps == [] or (steps[0]["start"] == 0 and steps[-1]["end"] == len(text.encode()) and all(a["end"] == b["start"] for a, b in zip(steps, steps[1:])))


def test_replace(spark):
    assert fetch(spark, ["age: 26"], Regex("[0-9]").replace("t", "Z"), Regex("[0-9]").replace_all("t", "Z")) == [("age: Z6", "age: ZZ")]
    assert fetch(spark, [" \t  trim me\t   \t"], Regex(r"^[ \t]+|[ \t]+$").replace_all("t", "")) == ["trim me"]
    assert fetch(spark, ["w1 w2"], Regex("([^ ]+)[ ]+([^ ]+)").replace_all("t", "$2 $1"), Regex("([^ ]+)[ ]+([^ ]+)").expand("t", "$2 $1")) == [("$2 $1", "w2 w1")]
    assert fetch(spark, ["b"], Regex("(.)").expand("t", "${1}a $1a")) == ["ba "]
    assert fetch(spark, ["b"], Regex("(?P<x>.)").expand("t", "$$1 $x1 ${x}1$9")) == ["$1  b1"]
    assert fetch(spark, ["abaab"], Regex("a*").replace_all("t", "-"), Regex("a*").replacen("t", 2, "-")) == [("-b-b-", "-b-b")]
    assert fetch(spark, ["a1"], Regex("(a)|(1)").expand("t", "<$1$2>")) == ["<a><1>"]
    assert template_parts("$$") == [("", None), ("$", None), ("", None)]


def test_split(spark):
    assert fetch(spark, ["XXXXaXXbXc"], Regex("X").split("t")) == [["", "", "", "", "a", "", "b", "c"]]
    assert fetch(spark, ["lionXXtigerXleopard"], Regex("X").splitn("t", 3)) == [["lion", "", "tigerXleopard"]]
    assert fetch(spark, ["abcXdef", None], Regex("X").splitn("t", 1)) == [["abcXdef"], None]
    assert fetch(spark, ["abcXdef", None], Regex("X").splitn("t", 0)) == [[], None]
    assert fetch(spark, ["☃"], Regex("").split("t")) == [["", "☃", ""]]
    assert fetch(spark, ["aXb"], Regex("X*").splitn("t", 2)) == [["", "aXb"]]


def test_lines_and_grep(spark):
    text = "xxab\r\nno\nab\rstill\nab"
    assert fetch(spark, [text, "", "a\r", "a\r\n"], lines("t")) == [["xxab", "no", "ab\rstill", "ab"], [], ["a\r"], ["a"]]
    assert fetch(spark, [text], Regex("ab").grep_count("t")) == [3]
    words = "aa x\r\n!\r\nbbb\ncc\rdd\nz\n"
    assert fetch(spark, [words], F.size(lines("t")), Regex("[a-z]{2,}").grep_count("t")) == [(5, 3)]
    assert fetch(spark, ["a;b;"], lines("t", ";")) == [["a", "b"]]
    assert fetch(spark, ["a\rb\r\nc"], lines("t", "crlf")) == [["a", "b", "c"]]


def test_sets(spark):
    s = RegexSet(["a", "b+", "a"])
    assert fetch(spark, ["ab", "c", None], s.matches("t")) == [[0, 1, 2], [], None]
    assert fetch(spark, ["ab", "c"], s.is_match("t"), s.matched_all(s.matches("t")), s.matched_count(s.matches("t"))) == [(True, True, 3), (False, False, 0)]
    assert fetch(spark, ["ab"], s.matches_at("t", 1), s.matches_added(F.array(F.lit(2)), "t")) == [([1], [0, 1, 2])]
    assert fetch(spark, ["ab", None], RegexSet([]).matches("t")) == [[], None]
    with pytest.raises(PatternError, match="pattern 1"):
        RegexSet(["a", "("])
    with pytest.raises(LimitError):
        RegexSet(["a"] * 5, max_patterns=4)


@pytest.mark.parametrize(("patterns", "text", "count", "total", "groups"), [(["a+", "a"], "aa", 1, 2, 1), (["a", "a+"], "aa", 2, 2, 2), (["ab", "a"], "ab", 1, 2, 1), (["a", "ab"], "ab", 1, 1, 1), (["(a+)", "(a)"], "aa", 1, 2, 2), (["(a)", "(a+)"], "aa", 2, 2, 4)])
def test_ordered_many(spark, patterns, text, count, total, groups):
    o = OrderedMany(patterns)
    assert fetch(spark, [text], o.count("t"), o.span_sum("t"), o.count_captures("t")) == [(count, total, groups)]


def test_ordered_many_ids(spark):
    got = fetch(spark, ["b1a"], OrderedMany(["(?P<x>[a-z])", "(?P<x>[0-9])"], ids=[7, 7]).spans("t"))[0]
    assert [tuple(x) for x in got] == [(7, 0, 0, 1), (7, 1, 1, 2), (7, 0, 2, 3)]


def test_metadata_and_refusals():
    r = Regex(r"(?P<y>\d{4})-(\d\d)?")
    assert r.capture_names() == [None, "y", None] and r.captures_len() == 3 and r.static_captures_len() is None and r.as_str() == r.source
    assert Regex("(a)|(b)").static_captures_len() == 2
    for bad in ("(", ")", "[a", "a{2,1}", r"\1", "(?=a)", "(?<!a)", "*a", "(?P<x>a)(?P<x>b)", r"\p{Nope}", r"\q", "[z-a]", "a{1001}", "(?i"):
        with pytest.raises(PatternError):
            Regex(bad)
    with pytest.raises(LimitError):
        Regex("(" * 300 + ")" * 300)
    with pytest.raises(LimitError):
        Regex("(?:(?:a{900}){900})")
    assert escape("a.b*") == r"a\.b\*" and quote_meta("a.b\0") == r"a\.b\x00"
    assert check_rewrite(r"\1", 1) is None and check_rewrite(r"\2", 1) and check_rewrite("\\", 1) and check_rewrite(r"\x", 1)


def test_limit_fails_closed(spark):
    with pytest.raises(Exception, match="more than 2 matches"):
        fetch(spark, ["aaa"], Regex("a").find_iter("t", limit=2))


def test_long_texts_that_would_overflow_a_backtracking_matcher(spark):
    texts = ["a" * 10_000, "ab" * 5_000 + "c"]
    assert fetch(spark, texts, Regex("(a|b)*c").is_match("t"), Regex("(?:aa|ab)*c").is_match("t")) == [(False, False), (True, True)]


def test_plans_push_down(spark, tmp_path):
    spark.createDataFrame([("x",)], "t string").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    plan = lambda c: df.where(c)._jdf.queryExecution().executedPlan().toString()
    assert "StringContains(t,abc)" in plan(Regex("abc").is_match("t"))
    assert "StringStartsWith(t,abc)" in plan(Regex("^abc[0-9]").is_match("t"))
    assert "StringContains(t,abc)" in plan(Regex("[0-9]abc[0-9]").is_match("t"))
