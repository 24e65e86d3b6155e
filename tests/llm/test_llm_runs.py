"""Phrase collocations, periodic runs and line dedup against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from adlens.llm import lines, periods, phrases
from adlens.llm.queries import QUERIES

SPACE = " \t\n\x0b\x0c\r"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


# -- line dedup --------------------------------------------------------------------
def _dedup(rows):
    """(id, n_lines, n_dropped, kept) by the contract; rows without an id are one last document."""
    def key(line):
        return _lower(line.strip(SPACE))

    holders = {}
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 10:
                holders.setdefault(key(line), set()).add(i)
    out = []
    for i, text in rows:
        all_lines = (text or "").split("\n")
        kept = [x for x in all_lines if len(holders.get(key(x), ())) < 2
                or i == min(h for h in holders[key(x)] if h is not None)]
        out.append((i, len(all_lines), len(all_lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("kind", ["long", "string"])
def test_line_dedup_odd_rows(spark, kind):
    rng = random.Random(5)
    pool = ["  The quick brown fox\t", "the QUICK brown fox", "short", "ÉTÉ à la plage un", "été à la plage un", "x" * 3000,
            "ends in a return\r", "ends in a return", "", " \t", "123456789", "1234567890", "\x0b1234567890"]
    rows = []
    for i in range(80):
        text = "\n".join(rng.choice([*pool, f"a line of its own {i}"]) for _ in range(rng.randrange(1, 9)))
        rows.append((rng.choice([i, i, rng.randrange(80), None]), rng.choice([text, text, text, None, ""])))
    rows += [rows[0], rows[7], (3, "\n".join(["the quick brown fox"] * 5000 + ["last"])), (200, "the quick brown fox\n" * 3000)]
    if kind == "string":
        rows = [(None if i is None else f"k{i:04d}", t) for i, t in rows]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], f"doc_id {kind}, text string, n_lines int, kept string")
    assert sorted(map(tuple, lines.dedup_lines(docs).collect()), key=repr) == _dedup(rows)
    assert lines.dedup_lines(docs.limit(0)).count() == 0


def test_line_runs_take_batches_and_compact(spark):
    runs = lines.LineRuns(spark, fanout=2)
    docs = spark.createDataFrame([(i, f"line number {i % 7} here\nline number {i} here") for i in range(40)], "doc_id long, text string")
    gone = []
    for lo in range(0, 40, 8):
        batch = docs.where((F.col("doc_id") >= lo) & (F.col("doc_id") < lo + 8))
        gone += [(r.id, r.pos) for r in runs.add(lines.line_rows(batch)).collect()]
        assert all(len(level) <= runs.fanout for level in runs.levels)
    assert len(runs.levels) > 2
    assert sorted(gone) == sorted([(i, 0) for i in range(7, 40)])
    again = runs.add(lines.line_rows(docs.where("doc_id = 9")))  # a document keeps what it owns
    assert [(r.id, r.pos) for r in again.collect()] == [(9, 0)]
    names = sum(runs.levels, [])
    runs.close()
    assert not any(spark.catalog.tableExists(n) for n in names) and runs.levels == [[]]


def test_line_runs_are_joined_without_a_shuffle_of_their_own(spark):
    runs = lines.LineRuns(spark)
    rows_ = lines.line_rows(spark.range(50).selectExpr("id as doc_id", "concat('a longer line ', id) as text"))
    runs.add(rows_)
    joined = runs._run(runs.levels[0][0]).join(runs._run(runs.levels[0][0]).withColumnRenamed("owner", "o"), ["h1", "h2"])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    runs.close()


# -- periodic runs -----------------------------------------------------------------
def _runs(words, least=6, repeats=4):
    out, seen = [], set()
    for q in range(1, len(words) // repeats + 1):
        i = 0
        while i + q < len(words):
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            n = j + q - i
            if n >= max(least, repeats * q) and (i, n) not in seen:
                seen.add((i, n))
                out.append((i, n, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def _periodic_row(i, text):
    words = WORD.findall(text or "")
    n = len(words)
    h = zlib.crc32(str(i).encode()) if i is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (k - a) % p] for k in range(a, n)]
    runs = _runs(words)
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    gone = {k for s, length, q in runs for k in range(s + q, s + length)}
    listed = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    kept = " ".join(w for k, w in enumerate(words) if k not in gone)
    return (i, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
            hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def test_transform_and_inverse():
    rng = np.random.default_rng(1)
    for n in (1, 2, 8, 64):
        a = rng.integers(0, periods.PRIME, (n, 5), dtype=np.uint64)
        assert (periods.inverse(periods.transform(a.copy())) == a).all()


def test_occurrences_are_all_found():
    rng = np.random.default_rng(2)
    for block in (1, 2, 8, 32):
        x = rng.integers(0, 2, 12 * block, dtype=np.uint64)
        got = {(int(j), int(d)) for js, ds in periods.occurrences(x, block) for j, d in zip(js, ds)}
        want = {(j, d) for j in range(10) for d in range(block, 2 * block)
                if (x[j * block:(j + 1) * block] == x[j * block + d:(j + 1) * block + d]).all()}
        assert got == want


def test_runs_match_brute_force():
    rng = random.Random(1)
    for _ in range(150):
        texts = []
        for _ in range(rng.randrange(1, 6)):
            unit = [rng.randrange(3) for _ in range(rng.randrange(1, 40))]
            texts.append(rng.choice([
                [rng.randrange(2) for _ in range(rng.randrange(120))], [0] * rng.randrange(100), [],
                unit * rng.randrange(1, 9) + unit[:rng.randrange(len(unit) + 1)] + [rng.randrange(3) for _ in range(9)],
                ([0] * rng.randrange(1, 20) + [1]) * rng.randrange(1, 20),
                sum(([rng.randrange(2)] * rng.randrange(12) for _ in range(8)), [])]))
        got = periods.find_runs([np.array(t, dtype=np.int64) for t in texts])
        assert got == [_runs(t) for t in texts]


def test_runs_of_a_very_long_text():
    unit = np.arange(30_011)
    x = np.concatenate([[10**6], np.tile(unit, 5), [7, 7, 7, 7, 7, 7, 8]])
    assert periods.find_runs([x]) == [[(1, 5 * 30_011, 30_011), (1 + 5 * 30_011, 6, 1)]]


def test_periodic_query_on_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = QUERIES["op12_periodic_runs"](spark, sf).collect()
    assert sorted(map(tuple, got)) == sorted(_periodic_row(*d) for d in docs)


def test_periodic_odd_rows(spark):
    texts = [None, "", " \n\t", "a", "a a a a a a", "A a A a A a A a", "a b a b a b a b\x0bc", "é é é é é é é", "x y " * 8]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "a a a a a a"), (4, "a a a a a a")]
    docs = spark.createDataFrame([(*r, [1]) for r in rows], "doc_id long, text string, runs array<int>")
    got = [(r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periods.periodic_runs(docs).collect()]
    want = []
    for i, t in rows:
        w = WORD.findall(t or "")
        runs = _runs(w)
        gone = {k for s, length, q in runs for k in range(s + q, s + length)}
        want.append((i, len(w), runs, " ".join(x for k, x in enumerate(w) if k not in gone)))
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert periods.periodic_runs(docs.limit(0)).count() == 0


# -- phrase collocations -------------------------------------------------------------
def _collocations(rows, max_words=3, least=10, top=2000):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\n-\r]", _lower(text or "")):
            words = tuple(re.findall(r"[^ \t]+", piece))
            n[lang] += len(words)
            for size in range(1, max_words + 1):
                f.update((lang, words[i:i + size]) for i in range(len(words) - size + 1))
    candidates = {k: v for k, v in f.items() if len(k[1]) > 1 and v >= least}
    longer = Counter()
    for (lang, w), a in candidates.items():
        for size in range(2, len(w)):
            for i in range(len(w) - size + 1):
                longer[lang, w[i:i + size]] = max(longer[lang, w[i:i + size]], a)
    scored = {}
    for (lang, w), a in candidates.items():
        if longer[lang, w] and 100 * longer[lang, w] >= 50 * a:
            continue
        score, k = min((1_000_000 * a * a // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w)))
        scored.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return sorted((lang, rank, p.decode(), -a, left, right, n[lang], -score) for lang, found in scored.items()
                  for rank, (score, a, p, left, right) in enumerate(sorted(found)[:top], 1))


def _words_table(spark, rows):
    return spark.createDataFrame([(lang, text, 5, "x") for lang, text in rows], "lang string, text string, n long, phrase string")


@pytest.mark.parametrize("max_words", [2, 3, 4])
def test_collocations_match_brute_force(spark, max_words):
    rng = random.Random(max_words)
    vocabulary = ["the", "The", "of", "é", "日本", "x" * 50, "a", "b", "new", "york", "city"]
    rows = [(rng.choice(["en", "en", None, "und", "", "de"]),
             "".join(rng.choice(vocabulary) + rng.choice([" ", " ", " ", "  ", "\t", ". ", "\n", ",", "\r"]) for _ in range(rng.randrange(60))))
            for _ in range(120)]
    rows += [("en", None), (None, None), ("en", ""), ("fr", "only a few words"), ("en", " \t. ,"), ("de", "new york city " * 3000)] + [rows[3]] * 20
    got = phrases.collocations(_words_table(spark, rows), max_words=max_words).collect()
    assert sorted(map(tuple, got)) == _collocations(rows, max_words)


def test_collocations_ties_and_top(spark):
    rows = [("en", ". ".join(["b a", "a b", "c d", "d c"] * 10))]
    got = phrases.collocations(_words_table(spark, rows), top=3).collect()
    assert sorted(map(tuple, got)) == _collocations(rows, top=3)
    assert [r.phrase for r in sorted(got, key=lambda r: r.rank)] == ["a b", "b a", "c d"]


def test_collocations_of_an_empty_table(spark):
    assert phrases.collocations(_words_table(spark, [("en", "x")]).limit(0)).count() == 0
    assert phrases.collocations(_words_table(spark, [("en", None)])).count() == 0


def test_every_phrase_belongs_to_one_chunk():
    rng = random.Random(9)
    for window in (1, 2, 5, 1000):
        text = "".join(rng.choice("abc") + rng.choice([" ", " ", " ", "\n"]) for _ in range(400)).encode()
        out, offsets, own, _ = phrases.parse(text, window, 2)
        got, want = Counter(), Counter()
        for a, z, mine in zip(offsets[:-1], offsets[1:], own):
            w = out[a:z].tobytes().split()
            for size in (1, 2, 3):
                got.update(tuple(w[i:i + size]) for i in range(min(mine, len(w) - size + 1)))
        for piece in text.split(b"\n"):
            w = piece.split()
            for size in (1, 2, 3):
                want.update(tuple(w[i:i + size]) for i in range(len(w) - size + 1))
        assert got == want


def test_a_full_bitmap_only_costs_time(spark, monkeypatch):
    rng = random.Random(11)
    rows = [("en", " ".join(rng.choice("abcdefgh") + rng.choice("xy") for _ in range(200))) for _ in range(20)]
    monkeypatch.setattr(phrases, "BITS", 64)
    assert sorted(map(tuple, phrases.collocations(_words_table(spark, rows)).collect())) == _collocations(rows)
