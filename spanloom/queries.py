"""The registered queries of the pattern engine, each over whole tables, with the SQL that says the same where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions.pattern import Regex, escape, lines
from spanloom.functions.sets import LiteralSet, OrderedMany, RegexSet
from spanloom.operators import frames
from spanloom.sources.corpus import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name."""

    def add(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLE_SQL[function.__name__] = sql
        return function

    return add


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


ING = "[A-Za-z]+ing"
EMAIL = r"[A-Za-z0-9._]+@[A-Za-z0-9-]+\.[A-Za-z]+"
TERMS = ["[Ll]icensed", "token|secret", r"[0-9]+\.[0-9]+\.[0-9]+", "ing\\b", "qqq", "the", "[A-Z]{4,}"]
#: The same patterns for RE2, whose word boundary is ASCII too; in ours it is asked for.
ASCII_TERMS = [t.replace("\\b", "(?-u:\\b)") for t in TERMS]


# --- search ------------------------------------------------------------------------------------------------------------------------


@query(rf"SELECT doc_id, regexp_matches(text, '{ING}') AS found, contains(text, 'License') AS literal, regexp_matches(text, '[0-9]+ ?License') AS needs FROM documents")
def rx_exists_docs(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", Regex(ING).is_match("text").alias("found"), Regex("License").is_match("text").alias("literal"), Regex("[0-9]+ ?License").is_match("text").alias("needs"))


@query("SELECT page_id, url FROM pages WHERE regexp_matches(url, '^https://[a-z.]+example[.](com|org)/')")
def rx_filter_url(spark, sf_dir):
    return frames.filter_matches(table(spark, sf_dir, "pages").select("page_id", "url"), "url", "^https://[a-z.]+example[.](com|org)/")


@query("SELECT page_id, starts_with(url, 'https://') AS secure, suffix(url, '#top') AS top, url = 'http://example.com' AS exact, regexp_matches(html, '</html>\\s*\\z') AS closed FROM pages".replace("\\\\", "\\"))
def rx_anchored(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", Regex("^https://").is_match("url").alias("secure"), Regex("#top$").is_match("url").alias("top"), Regex(r"^http://example\.com$").is_match("url").alias("exact"), Regex(r"</html>[\t\n\f\r ]*\z").is_match("html").alias("closed"))


@query(r"""SELECT doc_id, CASE WHEN m THEN strlen(pre)::BIGINT END AS start, CASE WHEN m THEN (strlen(pre) + strlen(hit))::BIGINT END AS "end", CASE WHEN m THEN hit END AS hit
FROM (SELECT doc_id, regexp_matches(text, '[0-9]{2,}') AS m, regexp_extract(text, '^((?s:.*?))[0-9]{2,}', 1) AS pre, regexp_extract(text, '[0-9]{2,}') AS hit FROM documents)""")
def rx_first_match(spark, sf_dir):
    found = docs(spark, sf_dir).select("doc_id", Regex("[0-9]{2,}").find_text("text").alias("m"))
    return found.select("doc_id", "m.start", "m.end", F.col("m.text").alias("hit"))


@query(r"""WITH k AS (SELECT doc_id, text, list_filter(range(2, 11), lambda k: strlen(left(text, k::INT)) = 10)[1] AS k FROM documents)
SELECT doc_id, CASE WHEN k IS NOT NULL AND contains(substr(text, k::INT + 1), 'th') THEN (10 + strlen(regexp_extract(substr(text, k::INT + 1), '^((?s:.*?))th', 1)))::BIGINT END AS start FROM k""")
def rx_find_at(spark, sf_dir):
    """A row for every document; null where the offset lies within a character or outside the text."""
    return docs(spark, sf_dir).select("doc_id", Regex("th").find_at("text", 10)["start"].alias("start"))


@query()
def rx_window(spark, sf_dir):
    """Bounded windows with the context of the whole text, a row for every document: null where the text ends before an offset or a character spans it."""
    w = Regex(r"\b[a-z]+\b")
    return docs(spark, sf_dir).select("doc_id", w.is_match_window("text", 5, 40).alias("found"), w.find_window("text", 5, 40).alias("span"), w.captures_iter_window("text", 5, 40).alias("all"), w.is_match_at("text", 30).alias("later"))


@query(r"""SELECT doc_id, CASE WHEN m THEN (strlen(pre) + 1)::BIGINT END AS established, CASE WHEN m THEN (strlen(pre) + strlen(hit))::BIGINT END AS selected_end
FROM (SELECT doc_id, regexp_matches(text, '[0-9]') AS m, regexp_extract(text, '^([^0-9]*)', 1) AS pre, regexp_extract(text, '[0-9]+') AS hit FROM documents)""")
def rx_shortest(spark, sf_dir):
    r = Regex("[0-9]+")
    return docs(spark, sf_dir).select("doc_id", r.shortest_match("text").alias("established"), r.selected_end("text").alias("selected_end"))


@query(rf"""WITH s AS (SELECT doc_id, regexp_extract_all(text, '{EMAIL}') AS m, string_split_regex(text, '{EMAIL}') AS g FROM documents WHERE regexp_matches(text, '{EMAIL}')),
u AS (SELECT doc_id, unnest(m) AS t, unnest(g[:len(m)]) AS gap, generate_subscripts(m, 1) AS i FROM s)
SELECT doc_id, (i - 1)::INT AS match_no, (sum(strlen(gap) + strlen(t)) OVER (PARTITION BY doc_id ORDER BY i) - strlen(t))::BIGINT AS start, (sum(strlen(gap) + strlen(t)) OVER (PARTITION BY doc_id ORDER BY i))::BIGINT AS "end", t AS match_text FROM u""")
def rx_explode_matches(spark, sf_dir):
    return frames.explode_matches(docs(spark, sf_dir).select("doc_id", "text"), "text", EMAIL)


@query(r"SELECT doc_id, (generate_subscripts(m, 1) - 1)::INT AS match_no, unnest(m) AS match_text FROM (SELECT doc_id, regexp_extract_all(text, '[0-9]+') AS m FROM documents)")
def rx_explode_texts(spark, sf_dir):
    return frames.explode_texts(docs(spark, sf_dir).select("doc_id", "text"), "text", "[0-9]+")


@query(r"SELECT doc_id, len(regexp_extract_all(text, '(?i)the'))::BIGINT AS folded, len(regexp_extract_all(text, '(?m)^[A-Z][a-z]+ '))::BIGINT AS starts, len(regexp_extract_all(text, '(?m)[a-z]+[.]$'))::BIGINT AS ends, len(regexp_extract_all(text, '(?s)[.].[A-Z]'))::BIGINT AS dots, len(regexp_extract_all(text, '(?U)a.+e'))::BIGINT AS lazy FROM documents")
def rx_options(spark, sf_dir):
    c = lambda p, **o: Regex(p, **o).count("text")
    return docs(spark, sf_dir).select(
        "doc_id", c("the", case_insensitive=True, unicode=False).alias("folded"), c("^[A-Z][a-z]+ ", multi_line=True).alias("starts"), c("[a-z]+[.]$", multi_line=True).alias("ends"),
        c("[.].[A-Z]", dot_matches_new_line=True).alias("dots"), c("a.+e", swap_greed=True).alias("lazy"),
    )


@query(r"""SELECT doc_id, len(list_filter(regexp_extract_all(text, '[\p{L}\p{Nl}\p{M}\p{Nd}\p{Pc}]+'), lambda x: length(x) = 13))::BIGINT AS words, len(regexp_extract_all(text, '[Éé]'))::BIGINT AS folded,
len(regexp_extract_all(text, '\p{Lu}\p{Ll}+'))::BIGINT AS names FROM documents""")
def rx_unicode(spark, sf_dir):
    """Unicode words and case; the SQL spells the classes out."""
    d = docs(spark, sf_dir)
    return d.select("doc_id", Regex(r"\b\w{13}\b").count("text").alias("words"), Regex("É", case_insensitive=True).count("text").alias("folded"), Regex(r"\p{Lu}\p{Ll}+").count("text").alias("names"))


@query("SELECT doc_id, len(regexp_extract_all(text, '\\bth\\w*\\b'))::BIGINT AS words FROM documents".replace("\\\\", "\\"))
def rx_ascii_words(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", Regex(r"\bth\w*\b", unicode=False).count("text").alias("words"))


# --- reducers ----------------------------------------------------------------------------------------------------------------------

_STATS = "SELECT {k}, count(*) AS docs, sum(regexp_matches(text, '{p}')::BIGINT)::BIGINT AS matching_docs, sum(len(regexp_extract_all(text, '{p}')))::BIGINT AS matches, sum(coalesce(list_sum(list_transform(regexp_extract_all(text, '{p}'), lambda x: strlen(x))), 0))::BIGINT AS matched_bytes FROM documents GROUP BY {k}"


@query(_STATS.format(k="lang", p=ING))
def rx_count_by_lang(spark, sf_dir):
    return frames.reduce_by(docs(spark, sf_dir), ["lang"], "text", ING)


@query(_STATS.format(k="source", p="[0-9]+"))
def rx_span_sum_by_source(spark, sf_dir):
    return frames.reduce_by(docs(spark, sf_dir), ["source"], "text", "[0-9]+")


@query("SELECT role, sum((length(text) - length(replace(text, 'the', ''))) // 3)::BIGINT AS n, sum(regexp_matches(text, '[?!]')::BIGINT)::BIGINT AS asks FROM conversations GROUP BY role")
def rx_literal_count(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("role", Regex("the").count("text").alias("n"), Regex("[?!]").is_match("text").alias("asks"))
    return c.groupBy("role").agg(F.sum("n").alias("n"), F.sum(F.col("asks").cast("bigint")).alias("asks"))


@query(r"SELECT doc_id, (3 * len(regexp_extract_all(text, '([A-Za-z]+)@([A-Za-z]+)')))::BIGINT AS n FROM documents")
def rx_count_captures(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", Regex("([A-Za-z]+)@([A-Za-z]+)").count_captures("text").alias("n"))


@query("SELECT doc_id, (length(regexp_replace(text, '[0-9]', '', 'g')) + 1)::BIGINT AS n, (strlen(text) - strlen(regexp_replace(text, '[0-9]', '', 'g')))::BIGINT AS bytes FROM documents")
def rx_nullable_count(spark, sf_dir):
    """Empty matches: none right after another match."""
    r = Regex("[0-9]*")
    return docs(spark, sf_dir).select("doc_id", r.count("text").alias("n"), r.span_sum("text").alias("bytes"))


@query(r"""SELECT doc_id, regexp_matches(text, '[A-Za-z]+ing') AS has, len(regexp_extract_all(text, '[0-9]+'))::BIGINT AS numbers, coalesce(list_sum(list_transform(regexp_extract_all(text, '[0-9]+'), lambda x: strlen(x))), 0)::BIGINT AS digits,
len(list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[0-9]+')))::BIGINT AS lines, (2 * len(regexp_extract_all(text, '([a-z]+)[.]')))::BIGINT AS groups FROM documents""")
def rx_operations(spark, sf_dir):
    """Several reducers in one scan."""
    members = {"has": ("search", ING), "numbers": ("count", "[0-9]+"), "digits": ("span_sum", "[0-9]+"), "lines": ("grep_count", "[0-9]+"), "groups": ("count_captures", "([a-z]+)[.]")}
    return frames.operations(docs(spark, sf_dir).select("doc_id", "text"), "text", members).drop("text")


@query(r"SELECT match_text, count(*)::BIGINT AS n FROM (SELECT unnest(regexp_extract_all(text, '[A-Z][a-z]{5,}')) AS match_text FROM documents) GROUP BY 1 ORDER BY n DESC, match_text LIMIT 20")
def rx_top_matches(spark, sf_dir):
    return frames.top_matches(docs(spark, sf_dir), "text", "[A-Z][a-z]{5,}", 20)


@query(r"SELECT quality, toxic, count(*) AS docs, sum(len(regexp_extract_all(text, '[*$%&#]{3}')))::BIGINT AS marks FROM documents JOIN labels USING (doc_id) GROUP BY quality, toxic")
def rx_label_features(spark, sf_dir):
    counted = docs(spark, sf_dir).select("doc_id", Regex("[*$%&#]{3}").count("text").alias("marks"))
    return counted.join(table(spark, sf_dir, "labels"), "doc_id").groupBy("quality", "toxic").agg(F.count(F.lit(1)).alias("docs"), F.sum("marks").alias("marks"))


@query(r"SELECT p_brand, count(*) AS parts, sum(len(regexp_extract_all(p_name, '[aeiou]+')))::BIGINT AS vowels FROM part WHERE regexp_matches(p_type, '(STEEL|BRASS|TIN)$') OR regexp_matches(p_name, '^[A-Za-z]+') GROUP BY p_brand")
def rx_parts(spark, sf_dir):
    p = table(spark, sf_dir, "part").where(Regex("(STEEL|BRASS|TIN)$").is_match("p_type") | Regex("^[A-Za-z]+").is_match("p_name"))
    return p.groupBy("p_brand").agg(F.count(F.lit(1)).alias("parts"), F.sum(Regex("[aeiou]+").count("p_name")).alias("vowels"))


# --- captures ----------------------------------------------------------------------------------------------------------------------

_URL = r"^(https?)://([^/?#]+)([^?#]*)"


@query(rf"SELECT page_id, regexp_extract(url, '{_URL}', 1) AS scheme, regexp_extract(url, '{_URL}', 2) AS host, regexp_extract(url, '{_URL}', 3) AS path FROM pages WHERE regexp_matches(url, '{_URL}')")
def rx_url_parts(spark, sf_dir):
    r = Regex(r"^(?P<scheme>https?)://(?P<host>[^/?#]+)(?P<path>[^?#]*)")
    return table(spark, sf_dir, "pages").where(r.is_match("url")).select("page_id", r.captures_struct("url").alias("u")).select("page_id", "u.*")


@query("""SELECT event_id, regexp_extract(props, '"([a-z_]+)": *"?([^",}]*)', 1) AS k, regexp_extract(props, '"([a-z_]+)": *"?([^",}]*)', 2) AS v FROM events WHERE regexp_matches(props, '"([a-z_]+)": *"?([^",}]*)')""")
def rx_json_k(spark, sf_dir):
    r = Regex(r'"(?P<k>[a-z_]+)": *"?(?P<v>[^",}]*)')
    return table(spark, sf_dir, "events").where(r.is_match("props")).select("event_id", r.captures_struct("props").alias("c")).select("event_id", "c.*")


@query(r"""SELECT page_id, CASE WHEN contains(url, '?') THEN regexp_extract(url, '[?]([^#]*)', 1) END AS query, CASE WHEN contains(url, '#') THEN regexp_extract(url, '#(.*)', 1) END AS fragment FROM pages""")
def rx_captures_optional(spark, sf_dir):
    """Groups that take no part are null, not empty."""
    r = Regex(r"^[^?#]*(?:\?(?P<query>[^#]*))?(?:#(?P<fragment>.*))?$")
    return table(spark, sf_dir, "pages").select("page_id", r.captures_struct("url").alias("c")).select("page_id", "c.*")


@query()
def rx_captures_iter(spark, sf_dir):
    r = Regex(r"([a-z]+)@(?:([a-z0-9]+)\.)?")
    return docs(spark, sf_dir).select("doc_id", r.captures_iter("text").alias("groups"), r.captures("text").alias("first"), r.participation("text").alias("part"))


# --- lines -------------------------------------------------------------------------------------------------------------------------

_LINES = "(SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents)"


@query("SELECT doc_id, (len(string_split(text, chr(10))) - CASE WHEN text = '' OR suffix(text, chr(10)) THEN 1 ELSE 0 END)::BIGINT AS n FROM documents")
def rx_lines(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.size(lines("text")).cast("bigint").alias("n"))


@query("SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[Ll]icen[cs]e')))::BIGINT AS n FROM documents")
def rx_grep_count(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", Regex("[Ll]icen[cs]e").grep_count("text").alias("n"))


@query(f"SELECT doc_id, line_no, line FROM {_LINES} WHERE regexp_matches(line, '(?i)\\b(?:licensed|copyright)\\b')")
def rx_grep_lines(spark, sf_dir):
    return frames.grep(docs(spark, sf_dir).select("doc_id", "text"), "text", "licensed|copyright", ignore_case=True, word=True)


@query(f"SELECT doc_id, line_no, regexp_extract(line, '([a-z0-9.]+)@([a-z0-9.-]+)', 1) AS who, regexp_extract(line, '([a-z0-9.]+)@([a-z0-9.-]+)', 2) AS host FROM {_LINES} WHERE regexp_matches(line, '([a-z0-9.]+)@([a-z0-9.-]+)')")
def rx_grep_captures(spark, sf_dir):
    return frames.grep_captures(docs(spark, sf_dir).select("doc_id", "text"), "text", "(?P<who>[a-z0-9.]+)@(?P<host>[a-z0-9.-]+)")


_AT = "([a-z0-9.]+)@([a-z0-9.-]+)"


@query(rf"""SELECT doc_id, line_no, (generate_subscripts(m, 1) - 1)::INT AS match_no, regexp_extract(unnest(m), '{_AT}', 1) AS who, regexp_extract(unnest(m), '{_AT}', 2) AS host
FROM (SELECT doc_id, line_no, regexp_extract_all(line, '{_AT}') AS m FROM {_LINES})""")
def rx_grep_all_captures(spark, sf_dir):
    """The groups of all matches of each line."""
    found = frames.grep_all_captures(docs(spark, sf_dir).select("doc_id", "text"), "text", _AT)
    return found.select("doc_id", "line_no", "match_no", F.col("groups")[1].alias("who"), F.col("groups")[2].alias("host"))


@query(rf"""SELECT doc_id, coalesce(3 * list_sum(list_transform(string_split(text, chr(10)), lambda l: len(regexp_extract_all(l, '{_AT}')))), 0)::BIGINT AS static,
coalesce(list_sum(list_transform(string_split(text, chr(10)), lambda l: 2 * len(regexp_extract_all(l, 'q|z')) + len(regexp_extract_all(l, 'zu')))), 0)::BIGINT AS varying FROM documents""")
def rx_grep_captures_count(spark, sf_dir):
    """Groups that take part, over all matches of each line."""
    return docs(spark, sf_dir).select("doc_id", Regex(_AT).grep_captures_count("text").alias("static"), Regex("(q)|(z(u)?)").grep_captures_count("text").alias("varying"))


@query(r"SELECT doc_id, (2 * len(regexp_extract_all(text, 'q|z')) + len(regexp_extract_all(text, 'zu')))::BIGINT AS n FROM documents")
def rx_count_captures_varying(spark, sf_dir):
    """As many groups take part as each match has."""
    return docs(spark, sf_dir).select("doc_id", Regex("(q)|(z(u)?)").count_captures("text").alias("n"))


@query(rf"""SELECT doc_id, CASE WHEN m THEN strlen(pre)::BIGINT END AS start, CASE WHEN m THEN (strlen(pre) + strlen(who))::BIGINT END AS who_end, CASE WHEN m THEN (strlen(pre) + strlen(who) + 1 + strlen(host))::BIGINT END AS host_end
FROM (SELECT doc_id, regexp_matches(text, '{_AT}') AS m, regexp_extract(text, '^((?s:.*?)){_AT}', 1) AS pre, regexp_extract(text, '{_AT}', 1) AS who, regexp_extract(text, '{_AT}', 2) AS host FROM documents)""")
def rx_captures_exact(spark, sf_dir):
    """The groups of a match whose span is known."""
    r = Regex(_AT)
    d = docs(spark, sf_dir).select("doc_id", "text", r.find("text").alias("s"))
    groups = r.captures_exact_window("text", F.col("s.start"), F.col("s.end"))
    return d.select("doc_id", groups.alias("g")).select("doc_id", F.col("g")[0]["start"].alias("start"), F.col("g")[1]["end"].alias("who_end"), F.col("g")[2]["end"].alias("host_end"))


# --- many patterns -----------------------------------------------------------------------------------------------------------------


def _values(patterns) -> str:
    return "(VALUES " + ", ".join(f"({i}, '{p}')" for i, p in enumerate(patterns)) + ") p(pattern_id, pattern)"


@query("SELECT doc_id, list_filter([" + ", ".join(f"CASE WHEN regexp_matches(text, '{p}') THEN {i} END" for i, p in enumerate(TERMS)) + "], lambda x: x IS NOT NULL)::VARCHAR AS ids, " + " OR ".join(f"regexp_matches(text, '{p}')" for p in TERMS[:3]) + " AS any_of_three FROM documents")
def rx_set_ids(spark, sf_dir):
    s, three = RegexSet(ASCII_TERMS), RegexSet(ASCII_TERMS[:3])
    shown = F.concat(F.lit("["), F.array_join(s.matches("text").cast("array<string>"), ", "), F.lit("]"))
    return docs(spark, sf_dir).select("doc_id", shown.alias("ids"), three.is_match("text").alias("any_of_three"))


def _table(spark, patterns) -> DataFrame:
    return spark.createDataFrame(list(enumerate(patterns)), "pattern_id int, pattern string")


@query(f"SELECT doc_id, pattern_id FROM documents JOIN {_values(TERMS)} ON regexp_matches(text, pattern)")
def rx_set_join(spark, sf_dir):
    return frames.join_patterns(docs(spark, sf_dir).select("doc_id", "text"), "text", _table(spark, ASCII_TERMS)).select("doc_id", "pattern_id")


@query(f"SELECT doc_id FROM documents WHERE NOT EXISTS (SELECT 1 FROM {_values(TERMS[:5])} WHERE regexp_matches(text, pattern))")
def rx_set_none(spark, sf_dir):
    return frames.join_patterns(docs(spark, sf_dir).select("doc_id", "text"), "text", _table(spark, ASCII_TERMS[:5]), how="leftanti").select("doc_id")


@query(f"SELECT lang, pattern_id, sum(len(regexp_extract_all(text, pattern)))::BIGINT AS matches, sum(regexp_matches(text, pattern)::BIGINT)::BIGINT AS matching_docs FROM documents, {_values(TERMS)} GROUP BY lang, pattern_id")
def rx_set_counts(spark, sf_dir):
    return frames.pattern_counts(docs(spark, sf_dir), "text", ASCII_TERMS, ["lang"])


@query("SELECT item_id, count(d.doc_id) AS docs FROM benchmark b LEFT JOIN documents d ON contains(d.text, b.text) GROUP BY item_id")
def rx_contamination(spark, sf_dir):
    """Documents that hold a benchmark item's whole text: all items in one pass over each document."""
    items = table(spark, sf_dir, "benchmark")
    found = frames.join_literals(docs(spark, sf_dir).select("doc_id", "text"), "text", items.select("item_id", F.col("text").alias("item")), "item")
    hits = found.groupBy("item_id").agg(F.count("doc_id").alias("n"))
    return items.select("item_id").join(hits, "item_id", "left").select("item_id", F.coalesce("n", F.lit(0)).alias("docs"))


@query(f"SELECT doc_id FROM documents WHERE EXISTS (SELECT 1 FROM {_values(TERMS[:3])} WHERE regexp_matches(text, pattern))")
def rx_set_some(spark, sf_dir):
    return frames.join_patterns(docs(spark, sf_dir).select("doc_id", "text"), "text", _table(spark, ASCII_TERMS[:3]), how="leftsemi").select("doc_id")


_WORDS = ["license", "house", "token", "secret", "the", "he", "them", "password", "qqq"]


@query("SELECT doc_id, list_filter([" + ", ".join(f"CASE WHEN contains(text, '{w}') THEN {i} END" for i, w in enumerate(_WORDS)) + "], lambda x: x IS NOT NULL)::VARCHAR AS ids, " + " OR ".join(f"contains(text, '{w}')" for w in _WORDS[:4]) + " AS some, " + " OR ".join(f"contains(text, '{w}')" for w in _WORDS[2:4]) + " AS choice FROM documents")
def rx_literal_set(spark, sf_dir):
    """Plain texts by a trie, and a choice of texts as string functions."""
    shown = F.concat(F.lit("["), F.array_join(LiteralSet(_WORDS).matches("text").cast("array<string>"), ", "), F.lit("]"))
    return docs(spark, sf_dir).select("doc_id", shown.alias("ids"), LiteralSet(_WORDS[:4]).is_match("text").alias("some"), Regex("token|secret").is_match("text").alias("choice"))


_MANY = ["[A-Z][a-z]+", "[A-Za-z]+ing", "[0-9]+"]


@query("SELECT doc_id, len(m)::BIGINT AS n, coalesce(list_sum(list_transform(m, lambda x: strlen(x))), 0)::BIGINT AS bytes FROM (SELECT doc_id, regexp_extract_all(text, '[A-Z][a-z]+|[A-Za-z]+ing|[0-9]+') AS m FROM documents)")
def rx_ordered_stats(spark, sf_dir):
    o = OrderedMany(_MANY)
    stats = docs(spark, sf_dir).select("doc_id", o.match_stats("text").alias("s"))
    return stats.select("doc_id", F.col("s.count").alias("n"), F.col("s.span_sum").alias("bytes"))


@query(r"""SELECT doc_id, (CASE WHEN regexp_matches(m, '^[0-9]+$') THEN 30 WHEN regexp_matches(m, '^[A-Z][a-z]+$') THEN 10 ELSE 20 END)::BIGINT AS pattern_id, count(*) AS n
FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Z][a-z]+|[A-Za-z]+ing|[0-9]+')) AS m FROM documents) GROUP BY 1, 2""")
def rx_ordered_many(spark, sf_dir):
    spans = OrderedMany(_MANY, ids=[10, 20, 30]).spans("text")
    return docs(spark, sf_dir).select("doc_id", F.explode(spans).alias("s")).groupBy("doc_id", F.col("s.pattern_id").alias("pattern_id")).agg(F.count(F.lit(1)).alias("n"))


# --- replacing and splitting -------------------------------------------------------------------------------------------------------


@query(rf"SELECT doc_id, regexp_replace(regexp_replace(text, '{EMAIL}', '<EMAIL $1>', 'g'), '[0-9]', '#', 'g') AS text FROM documents")
def rx_redact(spark, sf_dir):
    d = docs(spark, sf_dir).select("doc_id", Regex(EMAIL).replace_all("text", "<EMAIL $1>").alias("text"))
    return d.select("doc_id", Regex("[0-9]").replace_all("text", "#").alias("text"))


@query(r"SELECT page_id, regexp_replace(url, '^(https?)://([^/?#]+)', '\2 over \1', 'g') AS url FROM pages")
def rx_template(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", Regex("^(?P<scheme>https?)://(?P<host>[^/?#]+)").expand("url", "$host over ${scheme}").alias("url"))


@query(r"SELECT doc_id, regexp_replace(text, '[A-Za-z]+ing', '<>') AS text FROM documents")
def rx_replace_first(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", Regex(ING).replace("text", "<>").alias("text"))


@query(r"""SELECT doc_id, concat(array_to_string(list_transform(range(1, len(m) + 1), lambda i: concat(g[i], strlen(m[i])::VARCHAR)), ''), g[len(g)]) AS text
FROM (SELECT doc_id, regexp_extract_all(text, '[0-9]+') AS m, string_split_regex(text, '[0-9]+') AS g FROM documents)""")
def rx_replace_with(spark, sf_dir):
    """A function of each match, here its length."""
    return docs(spark, sf_dir).select("doc_id", Regex("[0-9]+").replace_with("text", lambda text, span: str(span[1] - span[0])).alias("text"))


@query(r"SELECT page_id, (generate_subscripts(f, 1) - 1)::INT AS n, unnest(f) AS field FROM (SELECT page_id, string_split_regex(url, '[/?&#]+') AS f FROM pages)")
def rx_split_explode(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.posexplode(Regex("[/?&#]+").split("url")).alias("n", "field"))


@query(r"SELECT page_id, regexp_extract(url, '^[^:/]*') AS first, regexp_extract(url, '^[^:/]*[:/]+([^:/]*)', 1) AS second, regexp_extract(url, '^[^:/]*[:/]+[^:/]*[:/]+(.*)$', 1) AS rest FROM pages")
def rx_splitn(spark, sf_dir):
    f = Regex("[:/]+").splitn("url", 3)
    return table(spark, sf_dir, "pages").select("page_id", F.get(f, 0).alias("first"), F.coalesce(F.get(f, 1), F.lit("")).alias("second"), F.coalesce(F.get(f, 2), F.lit("")).alias("rest"))


@query()
def rx_steps(spark, sf_dir):
    """Matches and the gaps between them, covering each text."""
    return table(spark, sf_dir, "pages").select("page_id", Regex(r"\d*").steps("url").alias("steps"))


@query(r"""SELECT doc_id, strlen(text)::BIGINT AS original_bytes, strlen(replace(text, chr(10), ''))::BIGINT AS clean_bytes, len(regexp_extract_all(replace(text, chr(10), ''), 'the|and'))::BIGINT AS variant_0, len(regexp_extract_all(replace(text, chr(10), ''), '[cgt]a'))::BIGINT AS variant_1,
strlen(regexp_replace(regexp_replace(replace(text, chr(10), ''), 'th[ae]', '<1>', 'g'), '[.][^.]*[.]', '|', 'g'))::BIGINT AS final_bytes FROM documents""")
def rx_redux(spark, sf_dir):
    d = docs(spark, sf_dir).select("doc_id", "text")
    return frames.regex_redux(d, "text", ["the|and", "[cgt]a"], [("th[ae]", "<1>"), ("[.][^.]*[.]", "|")], clean="\n").drop("text")


@query(r"SELECT doc_id, least(len(m), 3)::INT AS shown, len(m)::BIGINT AS total, CASE WHEN len(m) > 0 THEN strlen(m[1])::BIGINT END AS first_bytes FROM (SELECT doc_id, regexp_extract_all(text, '[0-9]+') AS m FROM documents)")
def rx_capped(spark, sf_dir):
    """The first spans, and how many there are."""
    d = docs(spark, sf_dir).select("doc_id", Regex("[0-9]+").find_capped("text", 3).alias("f"))
    first = F.get(F.col("f.spans"), F.lit(0))
    return d.select("doc_id", F.size("f.spans").alias("shown"), "f.total", (first["end"] - first["start"]).alias("first_bytes"))


@query("SELECT doc_id, strlen(text)::BIGINT AS bytes, 1::BIGINT AS matches FROM documents")
def rx_cover(spark, sf_dir):
    """Any text is one match."""
    return docs(spark, sf_dir).select("doc_id", Regex("(?s).*").span_sum("text").alias("bytes"), Regex("(?s).*").count("text").alias("matches"))


# --- bytes, limits, metadata -------------------------------------------------------------------------------------------------------


@query(r"SELECT doc_id, len(regexp_extract_all(text, '[\x{80}-\x{10FFFF}]'))::BIGINT AS chars, sum(strlen(text) - length(text)) OVER (PARTITION BY doc_id)::BIGINT AS more FROM documents".replace("sum(strlen(text) - length(text)) OVER (PARTITION BY doc_id)", "(strlen(text) - length(text))"))
def rx_bytes(spark, sf_dir):
    raw = docs(spark, sf_dir).withColumn("raw", F.col("text").cast("binary"))
    return raw.select("doc_id", Regex(r"[\x{80}-\x{10FFFF}]", bytes_mode=True).count("raw").alias("chars"), Regex(r"(?-u)[\x80-\xBF]", bytes_mode=True).count("raw").alias("more"))


@query(r"""SELECT * FROM (VALUES
('[A-Za-z]+ing', 1, 1, [''], 'ing', 4, NULL), ('[A-Za-z0-9._]+@[A-Za-z0-9-]+\.[A-Za-z]+', 1, 1, [''], '@', 5, NULL), ('(?P<y>\d{4})-(?P<m>\d\d)', 3, 3, ['', 'y', 'm'], '-', 7, 7),
('(a)|b', 2, NULL, ['', ''], '', 1, 1), ('(a)|(b)', 3, 2, ['', '', ''], '', 1, 1), ('a\.b', 1, 1, [''], 'a.b', 3, 3)) t(pattern, captures_len, static_captures_len, names, required, least, most)""")
def rx_metadata(spark, sf_dir):
    rows = []
    for p in (ING, EMAIL, r"(?P<y>\d{4})-(?P<m>\d\d)", "(a)|b", "(a)|(b)", escape("a.b")):
        r = Regex(p)
        rows.append((p, r.captures_len(), r.static_captures_len(), [n or "" for n in r.capture_names()], r.plan.required, r.plan.least, r.plan.most))
    return spark.createDataFrame(rows, "pattern string, captures_len int, static_captures_len int, names array<string>, required string, least int, most int")


@query("SELECT doc_id, contains(text, 'qq!') AS found FROM documents")
def rx_linear_time(spark, sf_dir):
    """A pattern on which backtracking would recurse once for each character goes to the automaton. (The repeated part may be left out.)"""
    return docs(spark, sf_dir).select("doc_id", Regex("(?:[a-z]+ ?)*qq!").is_match("text").alias("found"))
