"""Queries without SQL against brute force, over every row and the whole of each text."""

import re

import regex

from spanloom.functions.pattern import Regex
from spanloom.functions.sets import RegexSet
from spanloom.queries import rx_linear_time, rx_window


def written(spark, tmp_path, texts) -> tuple[str, dict]:
    """A folder with these documents, and their texts by id."""
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path), dict(enumerate(texts))


def texts_of(spark, sf_dir) -> dict:
    return {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}


# --- rx_linear_time ----------------------------------------------------------------------------------------------------------------


def naive_linear(text):
    """Each start and end in turn, rather than one pass."""
    if text is None:
        return None
    return any(text.startswith("qq!", i) for i in range(len(text)))  # the repeated part may be left out


def test_linear_time_reads_whole_texts(spark, sf_dir, tmp_path):
    made, texts = written(spark, tmp_path, ["x" * 5000 + "qq!", "word " * 900 + "qq! more", "é" * 400 + "qq!", "qq" * 3000, "qq ! " * 500, "", None, "qq!"])
    got = {r.doc_id: r.found for r in rx_linear_time(spark, made).collect()}
    assert got == {i: naive_linear(x) for i, x in texts.items()} == {0: True, 1: True, 2: True, 3: False, 4: False, 5: False, 6: None, 7: True}
    assert {r.doc_id: r.found for r in rx_linear_time(spark, sf_dir).collect()} == {i: naive_linear(x) for i, x in texts_of(spark, sf_dir).items()}


def test_literal_test_before_the_automaton_is_exact(spark):
    texts = ["aaabz", "az", "z", "z a b", "bcxz", "zzzz", "ab ab yz", "ab yz b", "", None, "AXZ"]  # short: the matcher of re retries without bound
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, t string")
    for p in (r"^(?:a|bc)*(?:x|y|b)z", r"(?:[a-c]+ ?)*[xy]z$", r"(?i)(?:a|bc)*xz", r"(?:ab ?)*yz\b"):
        r = Regex(p)
        assert r.plan.unsafe and (r.plan.required or "(?i)" in p)
        assert {x.i: x.f for x in df.select("i", r.is_match("t").alias("f")).collect()} == {i: None if x is None else re.search(p, x) is not None for i, x in enumerate(texts)}, p


# --- windows -----------------------------------------------------------------------------------------------------------------------

#: Offsets 5, 30 and 40 lie within characters, at ends of texts and beyond them.
AWKWARD = [
    "", None, "short", "abcdé fghi", "abcd" + "é" * 40, "é" * 30, "日本語 words here and there on lines", "a" * 39, "a" * 40, "ab cd " * 6 + "abcd", "ab cd " * 6 + "abc", "é word x" * 9, "\U0001f600 some words \U0001f600 in between \U0001f600 of them",
    "x" * 28 + "日 tail words", "x" * 38 + "é and more", "mid\u0301 words\u0301 with marks of all the kinds there are", "ONLY CAPITALS AND 12345 NUMBERS 67890 IN HERE", "k" * 29 + "é", "abcde fghij klmno pqrst uvwxy z 12 é",
]
_WORD_RUN = regex.compile(r"[\p{Alphabetic}\p{M}\p{Nd}\p{Pc}\p{Join_Control}]+")


def boundaries(text) -> dict:
    """Byte offset of each character's start, and of the end, to its number."""
    return {len(text[:i].encode()): i for i in range(len(text) + 1)}


def naive_words(text, start, end=None):
    """Byte spans of the words of a to z alone that lie between two byte offsets; None where no character starts there."""
    if text is None:
        return None
    at = boundaries(text)
    if start not in at or (end is not None and end not in at):
        return None
    byte = {i: b for b, i in at.items()}
    words = [(byte[m.start()], byte[m.end()]) for m in _WORD_RUN.finditer(text) if re.fullmatch("[a-z]+", m.group())]
    return [(a, b) for a, b in words if a >= start and (end is None or b <= end)]


def naive_window(text):
    within, later = naive_words(text, 5, 40), naive_words(text, 30)
    return (None if within is None else bool(within), within[0] if within else None, within, None if later is None else bool(later))


def test_window_has_a_row_for_every_document(spark, sf_dir, tmp_path):
    for folder, texts in (written(spark, tmp_path, AWKWARD), (sf_dir, texts_of(spark, sf_dir))):
        got = {r.doc_id: (r.found, r.span and tuple(r.span), r["all"] if r["all"] is None else [tuple(g[0]) for g in r["all"]], r.later) for r in rx_window(spark, folder).collect()}
        assert got == {i: naive_window(x) for i, x in texts.items()}


def test_offsets_of_all_rows(spark, sf_dir, tmp_path):
    """find_at and its kin without the filter that rx_find_at's SQL has."""
    r = Regex("th")

    def naive_at(text, start):
        if text is None or start not in (at := boundaries(text)):
            return None
        i = text.find("th", at[start])
        return None if i < 0 else len(text[:i].encode())

    made = written(spark, tmp_path, [*AWKWARD, "123456789é th", "12345678é th", "é" * 5 + "th"])
    for folder, texts in (made, (sf_dir, texts_of(spark, sf_dir))):
        df = spark.read.parquet(f"{folder}/documents.parquet")
        got = df.select("doc_id", *[r.find_at("text", k)["start"].alias(f"at{k}") for k in (10, 0, -1)], r.find_at("text", 30, chars=True)["start"].alias("chars")).collect()
        for x in got:
            text = texts[x.doc_id]
            assert (x.at10, x.at0, x["at-1"]) == (naive_at(text, 10), naive_at(text, 0), None), text
            assert x.chars == (None if text is None or text.find("th", 30) < 0 else text.find("th", 30)), text
    df = spark.createDataFrame([(b"a" * 5,), (b"\xc3\xa9th",)], "t binary")
    assert [x[0] for x in df.select(Regex("th", bytes_mode=True).find_at("t", 4)).collect()] == [None, None]
    assert [x[0] for x in df.select(Regex("", bytes_mode=True).is_match_at("t", 5)).collect()] == [True, None]
    df = spark.createDataFrame([("éab",), ("b",), ("xxb",), (None,)], "t string")
    assert [x[0] for x in df.select(RegexSet(["a", "b"]).matches_at("t", 1)).collect()] == [None, [], [1], None]
    assert [x[0] for x in df.select(RegexSet([]).matches_at("t", 0)).collect()] == [[], [], [], None]
