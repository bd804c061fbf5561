"""Substring dedup, near-duplicate join and line dedup against brute force."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from cuebase.llm import ngram_join, queries
from cuebase.llm import substring_dedup as substring_dedup_module
from cuebase.llm.line_dedup import dedup_lines
from cuebase.llm.ngram_join import keep_one, ngram_jaccard_join
from cuebase.llm.substring_dedup import anchors, gram_names, shared_passages, substring_dedup


def removed(texts: list[bytes], least: int) -> list[list[tuple[int, int]]]:
    seen = Counter(t[k : k + least] for t in texts for k in range(len(t) - least + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), dtype=bool)
        for k in range(len(t) - least + 1):
            if seen[t[k : k + least]] > 1:
                gone[k : k + least] = True
        edge = np.flatnonzero(np.diff(np.r_[0, gone.astype(int), 0]))
        out.append(list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)))
    return out


@pytest.mark.parametrize("least", [64, 400])
def test_substring_dedup_is_exact(docs, rows, least):
    texts = [(r[1] or "").encode() for r in rows]
    want = sorted((str(r[0]), len(t), tuple(s), b"".join(t[a:b] for a, b in zip([0, *(e for _, e in s)], [*(b for b, _ in s), len(t)], strict=True))) for r, t, s in zip(rows, texts, removed(texts, least), strict=True))
    got = sorted((str(r.doc_id), r.n_bytes, tuple((s.start, s.end) for s in r.spans), bytes(r.kept)) for r in substring_dedup(docs, least=least).collect())
    assert got == want


def test_substring_dedup_in_chunks(docs, rows, monkeypatch):
    """A text longer than a chunk gives the anchors of one piece."""
    t = np.frombuffer((rows[95][1] or rows[0][1]).encode() * 3, dtype=np.uint8)
    whole = anchors(gram_names(t), np.array([0, len(t)]), 400)
    starts = np.concatenate([np.arange(a, b + 1) for _, a, b in zip(*whole, strict=True)]) if len(whole[0]) else np.array([])
    assert len(starts) == max(len(t) - 399, 0) and (np.diff(starts) == 1).all()


def test_substring_dedup_empty(empty):
    assert substring_dedup(empty).count() == 0


def shingles(text: str | None) -> set:
    w = (text or "").encode().lower().split()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def groups(rows, roots: bool = False) -> list:
    sets = [shingles(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                root[find(i)] = find(j)
    members = defaultdict(list)
    for i in range(len(rows)):
        members[find(i)].append(i)
    if roots:
        return [find(i) if s else None for i, s in enumerate(sets)]
    out = []
    for i, r in enumerate(rows):
        ids = [rows[j][0] for j in members[find(i)] if rows[j][0] is not None]
        out.append((str(r[0]), len(sets[i]), str(min(ids) if sets[i] and ids else r[0])))
    return out


@pytest.mark.parametrize("frequent", [1 << 17, 0])
def test_join_equals_all_pairs(docs, rows, frequent, monkeypatch):
    monkeypatch.setattr(ngram_join, "FREQUENT", frequent)
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in ngram_jaccard_join(docs).collect())
    assert got == sorted(groups(rows))


def test_join_on_table(spark, data, duck):
    rows = duck.sql("SELECT doc_id, text FROM documents").fetchall()
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in queries.op2_ngram_jaccard(spark, data).collect())
    assert got == sorted(groups(rows))


def test_join_empty(empty):
    assert ngram_jaccard_join(empty).count() == 0


def test_keep_one(docs, rows):
    kept = [(r.doc_id, r.text) for r in keep_one(docs).collect()]
    assert len([k for k in kept if k[1] and k[1].strip()]) == len(set(groups(rows, roots=True)) - {None})
    assert keep_one(docs).columns == docs.columns


def test_ids_of_any_type_and_clashing_names(spark):
    rows = [("b", "one two three four five six", "1"), ("a", "ONE two three four five six", "2"), ("c", "other words", None), ("a", "ONE two three four five six", "2")]
    df = spark.createDataFrame([(*r, *"tuvw") for r in rows], "doc_id string, text string, x_own string, x_id string, x_name string, x_keep string, x_n string")
    got = sorted((r.doc_id, r.component_id) for r in ngram_jaccard_join(df).collect())
    assert got == [("a", "a"), ("a", "a"), ("b", "a"), ("c", "c")]
    kept = keep_one(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id, r.x_own, r.x_n) for r in kept.collect()) == [("a", "2", "w"), ("c", None, "w")]


def test_boundary_follows_cost():
    assert ngram_join.boundary({}, 2.0, 80) == 0
    few, many = ngram_join.boundary({6: 10, 12: 10}, 1.0, 80), ngram_join.boundary({6: 10, 12: 10}, 500.0, 80)
    assert few < many


def test_lines(spark):
    page = lambda *x: "<html><body>" + "".join(f"<p>{t}</p>" for t in x) + "</body></html>"
    pages = [(k, "http://A.org/x", page("menu", f"story {k}", "menu")) for k in range(6)] + [(9, "http://a.org/y", None), (10, None, page("menu")), (11, "nonsense", page("menu"))]
    df = spark.createDataFrame([(*p, "h", "l") for p in pages], "page_id int, url string, html string, host string, lines string")
    got = {r.page_id: (r.host, r.n_lines, r.n_removed, r.kept) for r in dedup_lines(df).collect()}
    assert all(got[k] == ("a.org", 3, 2, f"story {k}") for k in range(6))
    assert got[9] == ("a.org", 0, 0, "") and got[10] == ("", 1, 0, "menu") and got[11] == ("", 1, 0, "menu")
    assert dedup_lines(df.limit(0)).count() == 0


def test_lines_at_the_ratio_and_on_long_pages(spark):
    """A line on exactly the ratio of the pages stays, one page more and it goes; a page of a megabyte is cut whole."""
    long_one = "".join(f"<p>part {k}</p>" for k in range(60_000))
    rows = [(k, "http://a.org/", "<p>tie</p>" * (k < 5) + "<p>over</p>" * (k < 6) + (long_one if k == 9 else "")) for k in range(10)]
    df = spark.createDataFrame(rows, "page_id int, url string, html string")
    got = {r.page_id: (r.n_lines, r.n_removed, r.kept) for r in dedup_lines(df, ratio=0.5).collect()}
    assert all(got[k] == (2, 1, "tie") for k in range(5)) and got[5] == (1, 1, "") and got[8] == (0, 0, "")
    assert got[9] == (60_000, 0, "\n".join(f"part {k}" for k in range(60_000)))


def with_shared_windows(texts: list[str | None], least: int) -> set[str]:
    """Texts that have a run of `least` words with a different text in common, by comparing all runs."""
    seen = defaultdict(set)
    for t in {t for t in texts if t}:
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        for k in range(len(w) - least + 1):
            seen[tuple(w[k : k + least])].add(t)
    return {t for own in seen.values() if len(own) > 1 for t in own}


@pytest.mark.parametrize("sent", [3_000_000, 0])
def test_shared_passages_are_exact(spark, sent, monkeypatch):
    """Passages of 51 words and more, of 24 to 50, near copies, copies alone, a text that repeats itself; with tables sent to tasks and shuffled."""
    monkeypatch.setattr(substring_dedup_module, "SENT_MOST", sent)
    rnd = random.Random(8)
    text = lambda n: " ".join("".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    around = lambda p: f"{text(rnd.randint(0, 90))} {p} {text(rnd.randint(0, 90))}"
    texts = []
    for words_, copies in [(51, 3), (52, 2), (60, 4), (110, 3), (50, 5), (40, 4), (25, 3), (24, 2)]:
        passage = text(words_)
        texts += [around(passage) for _ in range(copies)]
    long = text(120).split()
    texts += [around(" ".join(long[k : k + 70])) for k in (0, 10, 19, 20, 50)]  # windows in common by pairs only
    near = text(200).split()
    for k in range(6):
        own = list(near)
        own[rnd.randrange(200)], own[30 * k] = "changed", f"w{k}"
        texts.append(" ".join(own))
    own = text(51)
    texts += [text(300)] * 3 + [f"{own} x {own}", None, "", "one", text(3000)] + [text(200) for _ in range(10)]
    df = spark.createDataFrame([(k, t, "x", "y") for k, t in enumerate(texts)], "doc_id int, text string, key string, run string")
    want = with_shared_windows(texts, 51)
    assert 20 < len(want) < 40
    got = sorted(r.key.hex() for r in shared_passages(df).collect())
    assert got == sorted(hashlib.md5(t.encode()).hexdigest() for t in want)
    assert shared_passages(df.limit(0)).count() == 0


def test_lines_equal_sql(same):
    same(queries.QUERIES["op3_line_dedup"], queries.ORACLES["op3_line_dedup"])


def test_long_texts_are_cut_in_chunks(docs, rows, monkeypatch):
    """Texts longer than a chunk give the same spans."""
    from cuebase.llm import substring_dedup as M

    want = sorted((str(r.doc_id), tuple((s.start, s.end) for s in r.spans)) for r in substring_dedup(docs).collect())
    first, again = M._first, M._again
    monkeypatch.setattr(M, "_first", lambda least: small(first(least)))
    monkeypatch.setattr(M, "_again", lambda least, width: small(again(least, width)))
    got = sorted((str(r.doc_id), tuple((s.start, s.end) for s in r.spans)) for r in substring_dedup(docs).collect())
    assert got == want


def small(run):
    def with_chunks(batches):
        from cuebase.llm import substring_dedup as M

        M.CHUNK = 2000
        yield from run(batches)

    return with_chunks


@pytest.mark.parametrize("light", [0, 7, 16])
def test_small_sets(spark, light, monkeypatch):
    """Many small overlapping sets: subsets prove links between the sizes that they stand for, and no others."""
    import random

    rnd = random.Random(light)
    rows = [(k, " ".join(rnd.choice("ab") for _ in range(rnd.randint(3, 24)))) for k in range(250)]
    monkeypatch.setattr(ngram_join, "boundary", lambda *a, **k: light)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in ngram_jaccard_join(df).collect())
    assert got == sorted(groups(rows))


@pytest.mark.parametrize("ranges", [1 << 12, 2])
def test_frequent_shingles_stay_within_their_bound(spark, monkeypatch, ranges):
    """A commoner step that does not fit is cut to the bound; a rarer one that would fit does not bring it back whole."""
    seen, lists = [], ngram_join._list_rows
    monkeypatch.setattr(ngram_join, "FREQUENT", 5)
    monkeypatch.setattr(ngram_join, "RANGES", ranges, raising=False)
    monkeypatch.setattr(ngram_join, "_list_rows", lambda width, percent, light, frequent: seen.append(frequent.value[0]) or lists(width, percent, light, frequent))
    often, rare = " ".join(f"a{k}" for k in range(14)), " ".join(f"b{k}" for k in range(6))
    rows = [(k, often if k < 6 else rare) for k in range(11)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in ngram_jaccard_join(df).collect())
    assert got == sorted(groups(rows)) and [len(x) for x in seen] == [5]
    data = np.frombuffer(often.encode(), dtype=np.uint8)
    assert set(seen[0].tolist()) == set(np.sort(ngram_join.shingle_sets(data, np.array([0, len(data)]), 5)[0].view(np.int64))[:5].view(np.uint64).tolist())


@pytest.mark.parametrize("most", [0, 1, 700, 5000])
def test_most_frequent(spark, most):
    df = spark.range(3000).selectExpr("xxhash64(id) AS shingle", "CASE WHEN id < 9 THEN 5000000 + id WHEN id < 600 THEN 100 + id % 20 ELSE id % 9 END AS n")
    rows = sorted((-r.n, r.shingle) for r in df.collect() if r.n >= 4)
    assert sorted((-r.n, r.shingle) for r in ngram_join.most_frequent(df, most).collect()) == rows[:most]
