"""Mixing, near-dedup, line dedup, WARC, quality and the pipeline against brute force."""

import base64
import collections
import hashlib
import math
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.llm import line_dedup, mixing, near_dup, quality, queries, sorted_ids, warc
from spanloom.llm.components import components

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


# --- mixing ------------------------------------------------------------------------------------------------------------------------


def mix_by_hand(rows, weights=(5, 2, 1), cap=3):
    """rows: (key, text, source). Targets by pouring, thresholds by sorting all hashes."""
    size = [len(WORDS.findall(t or "")) for _, t, _ in rows]
    sources = sorted({s for *_, s in rows}, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(sources)}
    total = {s: sum(n for n, (*_, x) in zip(size, rows) if x == s) for s in sources}
    left, free, target = float(sum(size)), set(sources), {}
    while free:
        level = left / sum(w[s] for s in free)
        full = {s for s in free if w[s] * level >= cap * total[s]}
        if not full:
            target |= {s: w[s] * level for s in free}
            break
        target |= {s: float(cap * total[s]) for s in full}
        left -= sum(cap * total[s] for s in full)
        free -= full
    return size, total, target


def test_mixing_query_is_its_sql(spark, sf_dir):
    got = queries.op2_mixing(spark, sf_dir)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    q = con.sql(queries.ORACLE_SQL["op2_mixing"])
    at = [q.columns.index(c) for c in got.columns]
    assert sorted(map(tuple, got.collect())) == sorted(tuple(r[i] for i in at) for r in q.fetchall())


def test_mixing_targets_and_caps(spark):
    rnd = random.Random(2)
    rows = [(i, "w " * rnd.randint(0, 60), rnd.choice(["a", "b", "b", "b", "b", "c", None])) for i in range(3000)] + [(None, "x y", "c"), (5, "again", "a"), (5, "again", "a"), (7001, None, "d"), (7002, "big " * 5000, "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"target": F.lit("clash"), "h": F.lit(1), "base": F.lit(2)})
    size, total, target = mix_by_hand(rows)
    mixed = mixing.mix(df)
    assert {"h", "base"} <= set(mixed.columns)
    got = mixed.collect()
    assert len(got) == len(rows)
    taken = collections.Counter()
    for r in got:
        assert r.size == len(WORDS.findall(r.text or "")) and 0 <= r.copies <= 3
        assert r.source_size == total[r.source] and r.target == pytest.approx(target[r.source])
        taken[r.source] += r.size * r.copies
    for s in total:
        assert abs(taken[s] - target[s]) <= max([0, *(n for n, (*_, x) in zip(size, rows) if x == s)])
    again = {(r.doc_id, r.text): r.copies for r in mixing.mix(df).collect()}
    assert all(again[r.doc_id, r.text] == r.copies for r in got)
    assert mixing.repeated(mixed).count() == sum(r.copies for r in got)
    assert mixing.mix(df.limit(0)).count() == 0


def test_mixing_beyond_the_broadcast_bound(spark, monkeypatch):
    df = spark.createDataFrame([(i, "w " * (i % 7), f"s{i % 5}" if i % 6 else None) for i in range(300)], "doc_id long, text string, source string")
    first = sorted((r.doc_id, r.copies) for r in mixing.mix(df).collect())
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 2)
    assert sorted((r.doc_id, r.copies) for r in mixing.mix(df).collect()) == first


# --- components and near copies ----------------------------------------------------------------------------------------------------


def closed(nodes, links):
    least = {n: n for n in nodes}

    def find(x):
        while least[x] != x:
            least[x] = least[least[x]]
            x = least[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        least[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rnd = random.Random(4)
    links = [(i, i + 1) for i in range(100, 160)] + [(500, 500 + i) for i in range(1, 200)] + [(rnd.randint(1000, 1300), rnd.randint(1000, 1300)) for _ in range(150)] + [(7, 7), (8, 9), (9, 8)]
    links = [(a, b) for a, b in links]
    want = closed({x for p in links if p[0] != p[1] for x in p}, [p for p in links if p[0] != p[1]])
    got = components(spark.createDataFrame(links, "u long, v long")).collect()
    assert {r.id: r.component for r in got} == want and len(got) == len(want)
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def shingle_sets(texts, n):
    out = {}
    for i, t in texts:
        w = WORDS.findall(re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        s = {tuple(w[k:k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
        out[i] = s
    return out


def linked(sets, percent):
    places = collections.defaultdict(list)
    for i, s in sets.items():
        for g in s:
            places[g].append(i)
    for i, s in sets.items():
        for j, n in collections.Counter(j for g in s for j in places[g] if j < i).items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                yield i, j


def test_near_dup_query(spark, sf_dir):
    texts = [(r.doc_id, r.text) for r in documents(spark, sf_dir).collect()]
    sets = shingle_sets(texts, 3)
    want = closed(sets, linked(sets, 85))
    for r in queries.op3_near_dup(spark, sf_dir).collect():
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), want[r.doc_id], want[r.doc_id] == r.doc_id)


def edited(rnd, words, n):
    words = list(words)
    for _ in range(n):
        words[rnd.randrange(len(words))] = f"e{rnd.randrange(10**6)}"
    return words


@pytest.mark.parametrize("block", [1024, 8])
def test_near_dup_groups(spark, monkeypatch, block):
    """Chains, hubs that come last, exact copies, groups that are alike but not enough, and short texts; with small blocks, large buckets."""
    monkeypatch.setattr(near_dup, "BLOCK", block)
    rnd = random.Random(9)
    texts, new = [], lambda n: [f"w{rnd.randrange(3000)}" for _ in range(n)]
    hub = new(200)
    texts += [" ".join(edited(rnd, hub, 8)) for _ in range(25)] + [" ".join(hub)]
    chain = new(150)
    for _ in range(12):
        texts.append(" ".join(chain))
        chain = edited(rnd, chain, 3)
    loose = new(150)
    texts += [" ".join(edited(rnd, loose, 16)) for _ in range(30)]
    texts += ["same text " * 30] * 20 + ["one", "ONE", "two words", "Two Words", "", " \n", None] + [" ".join(new(60)) for _ in range(100)]
    order = list(range(len(texts)))
    rnd.shuffle(order)
    rows = [(i, texts[k], "x") for i, k in enumerate(order)]
    sets = shingle_sets([(i, t) for i, t, _ in rows], 3)
    want = closed(sets, linked(sets, 85))
    df = spark.createDataFrame(rows, "doc_id long, text string, component string")
    got = near_dup.groups(df, words=3, percent=85).collect()
    assert {r.id: (r.n_shingles, r.component) for r in got} == {i: (len(sets[i]), want[i]) for i in sets}
    kept = near_dup.survivors(df, words=3, percent=85)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted(i for i in want if want[i] == i)


def test_near_dup_cases(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (4, "a b c d e f"), (2, None)], "doc_id long, text string")
    got = sorted(((r.id is None, r.id or 0, r.n_shingles, r.component) for r in near_dup.groups(df).collect()), key=repr)
    assert got == [(False, 1, 2, 1), (False, 1, 2, 1), (False, 2, 0, 2), (False, 4, 2, 1), (True, 0, 2, None)]
    assert near_dup.groups(df.limit(0)).count() == 0 and near_dup.survivors(df.limit(0)).count() == 0
    assert near_dup.miss_probability(0.85) < 1e-6 and near_dup.miss_probability(0.8) < 5e-4


def test_index_keys_hold_the_guarantee():
    """Whatever DISTANCE symbols differ, two signatures share a key; with every chunk hit twice they don't."""
    rnd = np.random.default_rng(1)
    a = rnd.integers(0, 1 << 16, near_dup.LENGTH).astype(np.uint16)
    for _ in range(300):
        b = a.copy()
        b[rnd.choice(near_dup.LENGTH, near_dup.DISTANCE, replace=False)] ^= 1
        x, y = near_dup.index_keys(np.stack([a, b]))
        assert (x == y).any()
    b = a.copy()
    size = near_dup.LENGTH // near_dup.CHUNKS
    b[[c * size + k for c in range(near_dup.CHUNKS) for k in (0, 1)]] ^= 1
    assert not (near_dup.index_keys(np.stack([a, b]))[0] == near_dup.index_keys(np.stack([a, b]))[1]).any()


def test_sorted_ids(spark):
    df = spark.createDataFrame([(i, "x") for i in range(0, 200, 3)] + [(None, "n")], "id long, t string")
    folder = sorted_ids.store(df.where("id % 2 = 0").unionByName(df.where("id IS NULL")), "id")
    assert sorted(r.id for r in sorted_ids.rows_with(df, "id", folder).collect()) == list(range(0, 200, 6))
    assert sorted_ids.rows_with(df, "id", folder, wanted=False).count() == df.count() - 34
    assert sorted_ids.rows_with(df, "id", sorted_ids.store(df.limit(0), "id")).count() == 0


# --- lines -------------------------------------------------------------------------------------------------------------------------


def repeats_by_hand(rows, least=50):
    """First occurrences of whole windows by content, extended to both sides."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    split = [[x.strip() for x in t.split("\n")] if t is not None else [] for _, t in rows]
    first, windows, removed = {}, [], [set() for _ in rows]
    for d, ls in enumerate(split):
        n = [len(x.split()) for x in ls]
        for a in range(len(n)):
            b, total = a, 0
            while b < len(n) and total < least:
                total += n[b]
                b += 1
            if total < least:
                break
            windows.append((tuple(ls[a:b]), d, a))
            first.setdefault(tuple(ls[a:b]), (d, a))
    for content, d, a in windows:
        e, b = first[content]
        if (e, b) == (d, a):
            continue
        x, y = a, b
        while x > 0 and y > 0 and split[d][x - 1] == split[e][y - 1]:
            x, y = x - 1, y - 1
        while x < len(split[d]) and y < len(split[e]) and split[d][x] == split[e][y]:
            removed[d].add(x)
            x, y = x + 1, y + 1
    return {r[0]: (sorted(s), None if r[1] is None else "\n".join(x for k, x in enumerate(r[1].split("\n")) if k not in s)) for r, s in zip(rows, removed)}


def test_line_dedup_query(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in documents(spark, sf_dir).collect()]
    want = repeats_by_hand(rows)
    for r in queries.op4_line_dedup(spark, sf_dir).collect():
        assert (r.removed_lines, r.text) == (",".join(map(str, want[r.doc_id][0])), want[r.doc_id][1])


def test_line_dedup_cases(spark):
    rnd = random.Random(6)
    line = lambda n: " ".join(f"v{rnd.randrange(500)}" for _ in range(n))
    passage, frequent = [line(20) for _ in range(6)], line(9)
    single = line(60)
    texts = [
        "\n".join([line(8), *passage, line(8)]), "\n".join([frequent, *passage[1:], frequent]), frequent, frequent + "\n" + frequent, "\n".join([single, line(5), single, single]), single,
        None, "", "\n\n\n", "  " + single + " \t", "\n".join(passage[:2]), "\n".join(passage[:3] + passage[:3]),
    ]
    rows = list(enumerate(texts)) + [(None, single)]
    df = spark.createDataFrame([(i, t, "c") for i, t in rows], "doc_id long, text string, removed string")
    want = repeats_by_hand(rows)
    for r in line_dedup.dedup(df.withColumn("n_lines", F.lit("clash"))).collect():
        assert (r.removed, r.text) == want[r.doc_id], texts[r.doc_id] if r.doc_id is not None else None
        assert r.n_lines == (0 if r.doc_id is not None and texts[r.doc_id] is None else len((single if r.doc_id is None else texts[r.doc_id]).split("\n")))
    assert want[1][0] == [1, 2, 3, 4, 5] and want[3][0] == [] and want[4][0] == [2, 3] and want[5][0] == [0]
    twice = spark.createDataFrame([(1, single), (1, single), (2, single)], "doc_id long, text string")
    assert sorted((r.doc_id, len(r.removed)) for r in line_dedup.dedup(twice).collect()) == [(1, 0), (1, 0), (2, 1)]
    assert line_dedup.dedup(df.limit(0)).count() == 0


def windows_by_hand(lines, least=50):
    """(gram start of the least gram, content of the window) of each window, grams compared by the operator's hashes."""
    hashes = np.array([line_dedup._hash(x.strip()) for x in lines], np.uint64).view(np.int64)
    return line_dedup.fingerprints(hashes, np.array([len(x.split()) for x in lines], np.int64), least)


def test_winnowing_selects():
    """Density of about 2 / (w + 1), every window's least gram selected, equal windows alike wherever they stand."""
    rnd = random.Random(5)
    lines = [" ".join(f"x{rnd.randrange(10**6)}" for _ in range(5)) for _ in range(5000)]  # a window of 10 lines holds 6 grams of 5
    values, places, upto, windows = windows_by_hand(lines)
    assert len(windows) == 4991 and len(places) == len(set(places.tolist())) < 1.15 * 2 / 7 * 5000
    for k in range(len(places)):
        for i in range(upto[k], upto[k + 1]):
            assert i <= places[k] <= i + 5
            for other in range(len(places)):
                assert not (i <= places[other] <= i + 5 and values[other] < values[k])
    moved = windows_by_hand(["other words " * 9] + lines[1000:1100] + ["and more " * 9])
    assert set(windows[1000:1091].tolist()) <= set(moved[3].tolist())


def test_winnowing_of_blank_lines_is_linear():
    import time

    hashes, words = np.full(1_000_000, line_dedup._hash(""), np.uint64).view(np.int64), np.zeros(1_000_000, np.int64)
    words[-3:] = 30
    began = time.process_time()
    values, places, upto, windows = line_dedup.fingerprints(hashes, words)
    assert time.process_time() - began < 10 and len(places) <= 2 and len(windows) == 999_999
    assert len(line_dedup.fingerprints(hashes, np.zeros(1_000_000, np.int64))[1]) == 0


def test_line_dedup_random_documents(spark):
    """Mosaics of few lines, blank ones among them, against windows by content; hot firsts, and names that are used within."""
    rnd = random.Random(16)
    pool = [" ".join(f"p{rnd.randrange(40)}" for _ in range(rnd.randrange(0, 30))) for _ in range(25)]
    hot = [f"hot {i} " * 12 for i in range(9)]
    texts = ["\n".join(rnd.choices(pool, k=rnd.randrange(1, 40))) for _ in range(120)] + ["\n".join([f"own {i}", *hot[rnd.randrange(3):]]) for i in range(300)]
    rows = list(enumerate(texts)) + [((1 << 63) - 1, "\n".join(hot)), (-(1 << 63), "\n".join(hot[2:]))]
    df = spark.createDataFrame([(i, t, "id", 5, 6) for i, t in rows], "doc_id long, text string, _id string, _at int, _TH int")
    want = repeats_by_hand(rows)
    got = line_dedup.dedup(df)
    assert got.columns == [*df.columns, "n_lines", "removed"]
    for r in got.collect():
        assert (r.removed, r.text) == want[r.doc_id] and (r["_id"], r["_at"], r["_TH"]) == ("id", 5, 6)


def test_line_dedup_without_a_local_disk(spark, monkeypatch):
    """As on a file system whose files can't be mapped: blocks are read."""
    from spanloom.llm import common

    texts = [f"line {i % 7} " * 30 + "\n" + f"own {i} " * 30 for i in range(40)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    found = line_dedup.Removed(line_dedup.store(line_dedup.repeats(df)))
    monkeypatch.setattr(common, "is_local", lambda _: False)
    monkeypatch.setattr(common.StoredArray, "BLOCK", 5)
    remote = line_dedup.Removed(line_dedup.store(line_dedup.repeats(df)))
    ths = {r.doc_id: r.th for r in df.select("doc_id", F.xxhash64("text").alias("th")).collect()}
    for i in range(40):
        a, b = found.get(i, ths[i]), remote.get(i, ths[i])
        assert (a is None) == (b is None) == (i < 7) and (a is None or a.tolist() == b.tolist() == [0])


def test_stored_arrays_are_searched_alike(tmp_path, monkeypatch):
    from spanloom.llm import common

    values = np.sort(np.random.default_rng(2).integers(-50, 50, 333))
    common.save_array(f"file://{tmp_path}", "part-0.npy", values)
    monkeypatch.setattr(common, "is_local", lambda _: False)
    monkeypatch.setattr(common.StoredArray, "BLOCK", 16)
    (array,) = common.stored_arrays(f"file://{tmp_path}")
    sought = np.arange(-60, 60)
    for side in ("left", "right"):
        assert (array.find(sought, side) == np.searchsorted(values, sought, side)).all()
    assert (array.rows(3, 100) == values[3:100]).all() and (array.at(np.array([0, 332, 16])) == values[[0, 332, 16]]).all() and len(array) == 333


# --- WARC --------------------------------------------------------------------------------------------------------------------------


def sha(b):
    return base64.b32encode(hashlib.sha1(b).digest()).decode()


def test_warc_query(spark, sf_dir):
    pages = {r.page_id: (r.html or "").encode() for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    best = {}
    for i, b in pages.items():
        best[b] = max(best.get(b, -1), i)
    for r in queries.op5_warc(spark, sf_dir).collect():
        b = pages[r.page_id]
        assert (r.payload_bytes, r.payload_digest) == (len(b), sha(b))
        assert (r.record_type, r.refers_to) == (("response", None) if best[b] == r.page_id else ("revisit", best[b]))


def test_warc_copies_and_ranges(spark, tmp_path):
    rows = [(i, f"http://x/{i}\r\nEvil: 1", ["same", "", None, f"page {i} é"][i % 4]) for i in range(200)] + [(None, None, "same")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    folder = f"file://{tmp_path}/w"
    index = warc.write(df, folder)
    got = {r.page_id: r for r in warc.read(spark, folder).collect()}
    best = {"same": 196, "": 198}
    for i, _, html in rows:
        text, r = html or "", got[i]
        owner = best.get(text, i)
        assert (r.record_type, r.refers_to) == (("response", None) if owner == i else ("revisit", owner)), i
        assert bytes(r.payload) == (text.encode() if owner == i else b"") and r.payload_digest == sha(text.encode()) and r.declared_bytes == len(text.encode())
    assert "Evil" not in {r.url.split(":")[0] for r in got.values() if r.url}
    few = warc.read(spark, folder, index.where("page_id in (3, 7, 150)")).collect()
    assert sorted(r.page_id for r in few) == [3, 7, 150]
    all_kept = warc.write(df, f"file://{tmp_path}/all", least_bytes=1000)
    assert all_kept.where("record_type = 'revisit'").count() == 0
    assert warc.read(spark, f"file://{tmp_path}/none", warc.write(df.limit(0), f"file://{tmp_path}/none")).count() == 0
    member = warc.record(1, "u", b"abc", sha(b"abc"), None)
    with pytest.raises(ValueError):
        warc.parse(warc.record(1, "u", b"abc", sha(b"xyz"), None))
    assert warc.parse(member)["payload"] == b"abc"


def test_warc_of_many_copies(spark, tmp_path):
    """A third of the pages share one payload and others come twice; the query against its SQL, and what a reader of revisits needs."""
    rows = [(i, f"http://x/{i}", "hot page" if i % 3 == 0 else f"twice {i // 4}" if i % 3 == 1 else None if i % 30 == 2 else f"own {i} é") for i in range(600)]
    spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, sha1 string").repartition(5).write.parquet(str(tmp_path / "pages.parquet"))
    got = queries.op5_warc(spark, str(tmp_path))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    q = con.sql(queries.ORACLE_SQL["op5_warc"])
    at = [q.columns.index(c) for c in got.columns]
    told = sorted((tuple(r) for r in got.collect()), key=repr)
    assert told == sorted((tuple(r[i] for i in at) for r in q.fetchall()), key=repr) and sum(r[3] == "revisit" for r in told) > 200
    folder = f"file://{tmp_path}/w"
    index = {r.page_id: r for r in warc.write(spark.createDataFrame(rows, "page_id long, url string, html string"), folder).collect()}
    fields = {}
    for i in (0, 597):
        with open(f"{tmp_path}/w/warc/{index[i].file}", "rb") as f:
            assert b"warcinfo" in __import__("gzip").GzipFile(fileobj=f).read(200)
            f.seek(index[i].offset)
            fields[i] = warc.parse(f.read(index[i].length))
    assert fields[0]["WARC-Refers-To"] == fields[597]["WARC-Record-ID"] and fields[0]["WARC-Refers-To-Target-URI"] == "http://x/597" and fields[0]["WARC-Refers-To-Date"] == fields[597]["WARC-Date"]
    none = [(None, f"u{i}", ["same", "other", "same"][i % 3]) for i in range(6)] + [(5, "v", "same")]
    kinds = collections.Counter((r.page_id, r.record_type) for r in warc.write(spark.createDataFrame(none, "page_id long, url string, html string"), f"{folder}2").collect())
    assert kinds == {(None, "revisit"): 4, (None, "response"): 2, (5, "response"): 1}


def test_mixing_keeps_any_column(spark):
    names = ["_h", "_s", "_P", "_base", "_threshold", "_copy", "h"]
    df = spark.createDataFrame([(i, "w " * (i % 9), "ab"[i % 2], *range(7)) for i in range(50)], ["doc_id", "text", "source", *names])
    mixed = mixing.mix(df)
    assert set(names) <= set(mixed.columns) and {tuple(r[n] for n in names) for r in mixed.collect()} == {tuple(range(7))}
    assert mixing.repeated(mixed).columns == df.columns


# --- quality -----------------------------------------------------------------------------------------------------------------------


def kneser_ney(texts, order):
    """Modified Kneser-Ney by the book: a function of (context, character)."""
    pad = quality.PAD * (order - 1)
    tables = {order: collections.Counter()}
    for t in texts:
        x = pad + t
        for i in range(len(x) - order + 1):
            tables[order][x[i:i + order]] += 1
    for k in range(order - 1, 0, -1):
        tables[k] = collections.Counter(g[1:] for g in tables[k + 1])
    discount, total, mass = {}, {}, {}
    for k, table in tables.items():
        n = [sum(c == i for c in table.values()) for i in range(5)]
        if n[1] and n[2] and n[3]:
            y = n[1] / (n[1] + 2 * n[2])
            discount[k] = [0] + [min(i - 0.1, max(0.1, i - (i + 1) * y * n[i + 1] / n[i])) for i in (1, 2, 3)]
        else:
            discount[k] = [0, 0.5, 1.0, 1.5]
        total[k], mass[k] = collections.Counter(), collections.Counter()
        for g, c in table.items():
            total[k][g[:-1]] += c
            mass[k][g[:-1]] += discount[k][min(c, 3)]
    letters = len(tables[1]) + 1

    def p(context, char):
        k = len(context) + 1
        lower = p(context[1:], char) if k > 1 else 1 / letters
        if not total[k][context]:
            return lower
        c = tables[k][context + char]
        return (c - discount[k][min(c, 3)] if c else 0) / total[k][context] + mass[k][context] / total[k][context] * lower

    return lambda t: -sum(math.log2(p((pad + t)[i:i + order - 1], (pad + t)[i + order - 1])) for i in range(len(t)))


def test_model_is_modified_kneser_ney(spark):
    rnd = random.Random(8)
    texts = [("x", "".join(rnd.choice("abcd é") for _ in range(rnd.randint(1, 200)))) for _ in range(30)] + [("y", "zzz abc"), (None, "日本語" * 5), ("x", ""), ("x", None)]
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(texts)], "doc_id long, lang string, text string")
    got = {r.doc_id: r.bits for r in quality.judge(df).collect()}
    for lang in ("x", "y", None):
        score = kneser_ney([t for x, t in texts if x == lang and t], quality.ORDER)
        for i, (x, t) in enumerate(texts):
            if x == lang and t:
                assert got[i] == pytest.approx(score(t) / len(t), rel=1e-5)
    assert got[len(texts) - 1] is None and got[len(texts) - 2] is None


def test_model_of_unseen_text(spark):
    from spanloom.llm.common import shared_dir

    df = spark.createDataFrame([("x", "abc abd abe " * 5)], "lang string, text string")
    folder = shared_dir(spark, "kn-test")
    quality.store(quality.model(quality.counts(df, "lang", "text").cache()), folder)
    m, score = quality.Model(folder), kneser_ney(["abc abd abe " * 5], quality.ORDER)
    for t in ("abc", "zq!", "ab" * 10, "é"):
        assert quality.Scorer(m).total("x", [t])[0] == pytest.approx(score(t), rel=1e-5)


def test_wide_alphabets_count_alike():
    rnd = random.Random(3)
    texts = ["".join(chr(rnd.randrange(0x4E00, 0x9FFF)) for _ in range(300)) for _ in range(30)]
    alphabet, _, _ = quality._packed(texts)
    assert len(alphabet) ** quality.ORDER >= 1 << 64
    got = collections.Counter()
    for grams, n in quality._counted(texts):
        for g, c in zip(grams, n):
            got["".join(map(chr, g))] += int(c)
    pad = quality.PAD * (quality.ORDER - 1)
    assert got == collections.Counter((pad + t)[i:i + quality.ORDER] for t in texts for i in range(len(t)))


def test_quality_query(spark, sf_dir):
    texts = {r.doc_id: r.text or "" for r in documents(spark, sf_dir).collect()}
    for r in queries.op7_quality(spark, sf_dir).collect():
        t = texts[r.doc_id]
        w = WORDS.findall(t)
        many = collections.Counter(zip(w, w[1:], w[2:]))
        repeated = {i + k for i in range(len(w) - 2) if many[tuple(w[i:i + 3])] > 1 for k in range(3)}
        seen, copies = set(), 0
        for x in t.split("\n"):
            if WORDS.search(x):
                copies += x in seen
                seen.add(x)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), copies, len(repeated))
        assert r.base_failed == (len(w) < 50 or 100 * len(repeated) > 50 * len(w))
        assert r.kept == (not r.base_failed and r.low <= r.bits_per_char <= r.high)


def test_quality_rejects_what_is_unlike_its_language(spark):
    rnd = random.Random(1)
    words = ["the", "and", "house", "river", "green", "walk", "slowly", "over"]
    plain = [" ".join(rnd.choice(words) + str(rnd.randrange(10)) for _ in range(80)) for _ in range(60)]
    noise = "".join(rnd.choice("qzxjkvw#@!?%    ") for _ in range(600))
    df = spark.createDataFrame([(i, "en", t, 1) for i, t in enumerate([*plain, noise])], "doc_id long, lang string, text string, bits int")
    got = {r.doc_id: r.kept for r in quality.judge(df).collect()}
    assert not got[60] and all(got[i] for i in range(60))
    assert quality.judge(df.limit(0)).count() == 0


# --- the pipeline ------------------------------------------------------------------------------------------------------------------


def test_pipeline_stages(spark, sf_dir):
    import corpus_pipeline as p
    from spanloom.llm.common import materialise

    docs = documents(spark, sf_dir)
    told = {}
    for name, stage in p.STAGES:
        before, docs = docs, materialise(stage(spark, docs, sf_dir), "test-stage")
        told[name] = (before, docs)
        if name != "bpe":
            assert docs.columns == before.columns and docs.dtypes == before.dtypes

    before, after = told["quality"]
    kept = {r.doc_id for r in quality.judge(before).where("kept").collect()}
    assert {r.doc_id for r in after.collect()} == kept

    before, after = told["line_dedup"]
    want = repeats_by_hand([(r.doc_id, r.text) for r in before.collect()])
    assert {r.doc_id: r.text for r in after.collect()} == {i: t for i, (gone, t) in want.items() if not gone or t.strip()}
    assert after.where("n_chars <> length(text)").count() == before.where("n_chars <> length(text)").count() == 0

    before, after = told["near_dup"]
    sets = shingle_sets([(r.doc_id, r.text) for r in before.collect()], 5)
    groups = closed(sets, linked(sets, 80))
    assert sorted(r.doc_id for r in after.collect()) == sorted(i for i in groups if groups[i] == i)

    before, after = told["mixing"]
    rows = [(r.doc_id, r.text, r.source) for r in before.collect()]
    size, total, target = mix_by_hand(rows)
    got = collections.Counter()
    for r in after.collect():
        got[r.source] += len(WORDS.findall(r.text or ""))
    for s in total:
        assert abs(got[s] - target[s]) <= max(n for n, (*_, x) in zip(size, rows) if x == s)

    before, after = told["bpe"]
    assert after.count() == before.count() and after.where("NOT exact OR n_tokens <> size(ids)").count() == 0


def test_pipeline_on_odd_tables(spark, tmp_path):
    import corpus_pipeline as p

    text = " ".join(f"word{i * 7 % 211}" for i in range(120))
    rows = [(1, text, "en", "a", len(text), "x"), (2, text + " more", None, None, None, None), (None, None, None, None, None, None), (3, "", "en", "b", 0, "y"), (1, text, "en", "a", len(text), "x")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, size string"
    for name, table in (("some", rows), ("none", [])):
        folder = str(tmp_path / name)
        spark.createDataFrame(table, schema).write.parquet(f"{folder}/documents.parquet")
        out = p.run(spark, folder)
        assert out.where("NOT exact").count() == 0
        assert (out.count() > 0) == bool(table)
