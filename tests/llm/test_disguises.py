"""Disguises of personal data and shapes of secrets."""

import pytest

pytest.importorskip("public_tokenizers")

from spanloom.llm import pii, secrets  # noqa: E402


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ("to john.smith at example dot com today", ["john.smith at example dot com"]),
        ("write to jan at firma dot cz, or", ["jan at firma dot cz"]),
        ("john at gmail.com", ["john at gmail.com"]),
        ("jan dot novak at mail.firma dot cz", ["jan dot novak at mail.firma dot cz"]),
        ("a dot b dot c dot d dot e dot f at x dot com", ["a dot b dot c dot d dot e dot f at x dot com"]),
        ("ana arroba correo punto mx", ["ana arroba correo punto mx"]),
        ("john@example dot com", ["john@example dot com"]),
        ("x at y dot com dot he said", ["x at y dot com"]),
        ("a at b dot org c at d dot xyz", ["a at b dot org", "c at d dot xyz"]),
        ("a at b dot c at d dot org", ["b dot c at d dot org"]),
        ("ring +1 555 one two three 4567 now", ["+1 555 one two three 4567"]),
        ("card 4111 1111 one one one one 1111", ["4111 1111 one one one one 1111"]),
        ("host 192 dot 168 dot 1 dot 1", ["192 dot 168 dot 1 dot 1"]),
        ("look at this point we agree, at v dot 2", []),
        ("chapter 2 one, two 3", []),
        ("call plus one double five five one two three four five six seven now", ["plus one double five five one two three four five six seven"]),
        ("call +1 914 triple five 0199 now", ["+1 914 triple five 0199"]),
        ("\U0001d423ane@example.com", ["\U0001d423ane@example.com"]),
        ("to \u24d9ane@ex\u24d0mple.com", ["\u24d9ane@ex\u24d0mple.com"]),
        ("jane at example dot xyz", ["jane at example dot xyz"]),
    ],
)
def test_spelled_addresses_and_numbers(text, found):
    assert [text[i:j] for i, _, j in pii.added_spans(text, pii.base_spans(text))] == found


@pytest.mark.parametrize("unit", ["a at b dot c ", "a dot ", "a at ", "1 dot ", "1.", "one 1 ", "at x.", "a dot a@", "@a dot b ", "plus 1 "])
def test_spelled_forms_take_linear_time(unit):
    text = unit * (300_000 // len(unit))
    pii.added_spans(text, pii.base_spans(text))


def test_hex_secrets_behind_separators(spark):
    value = "9F86D081884C7D659A2FEAA0C55AD015A3BF4F1B"
    texts = [f"sig={value}", f"path/{value}", f"_{value}", f"a-{value}-b", value, f"/example/{value}", value[:20], f"x {value[:23]} y", value[:19], "A1" * 20, f"token={value}"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r.doc_id: [(s["start"], s["end"]) for s in r.secrets if s["kind"] == "entropy"] for r in secrets.scan(df).collect()}
    for i, x in enumerate(texts[:8]):
        assert any(a <= x.index(value[:20]) and x.index(value[:20]) + 20 <= b for a, b in got[i]), (x, got[i])
    assert [got[i] for i in (8, 9, 10)] == [[], [], []]


def test_tracing_is_small():
    """A text of two million characters with one typographic quote."""
    import tracemalloc

    text = "some words \u2019 " + "plain words go on " * 120_000 + "jo\u24d9@example.com"
    tracemalloc.start()
    (span,) = pii.added_spans(text, pii.base_spans(text))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert text[span[0]:span[2]] == "jo\u24d9@example.com" and peak < 40 * len(text)
