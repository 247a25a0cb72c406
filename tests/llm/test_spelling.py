"""Spelling variants against brute force: words, the trie and its budget, leaves, the cut, roots."""

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from paylens.llm import spelling
from paylens.llm.queries import llm_queries

DOCS = "doc_id long, text string"


def distance_is_one(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain_words(rows, every=31):
    counts = Counter()
    for i, text, *_ in rows:
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for run in re.findall("[a-zÀ-ÿ]+", lower):
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def plain_variants(counts, times=10):
    forms, near = {}, {w: [x for x in counts if distance_is_one(w, x)] for w in counts}
    for w, found in near.items():
        best = min(found, key=lambda x: (-counts[x], x), default=None)
        forms[w] = best if best is not None and counts[best] >= times * counts[w] else None
    out = []
    for w in counts:
        root = w
        while forms[root] is not None:
            root = forms[root]
        out.append((w, forms[w], root, counts[w], len(near[w]), counts.get(forms[w])))
    return sorted(out, key=repr)


def collected(df):
    assert df.dtypes == [("word", "string"), ("form", "string"), ("root", "string"), ("n", "bigint"), ("n_near", "bigint"), ("form_n", "bigint")]
    return sorted((tuple(r) for r in df.collect()), key=repr)


def some_words(seed, n, alphabet):
    """Words and edited words, of counts over several powers of ten."""
    rng = random.Random(seed)
    found = {}
    while len(found) < n:
        word = "".join(rng.choice(alphabet) for _ in range(rng.randint(7, 9)))
        for _ in range(rng.randint(1, 6)):
            found.setdefault(word, 2 + int(10 ** rng.uniform(0, 4)))
            at = rng.randrange(len(word))
            word = rng.choice([word[:at] + word[at + 1 :], word[:at] + rng.choice(alphabet) + word[at:], word[:at] + rng.choice(alphabet) + word[at + 1 :]])
            if len(word) < 7:
                break
    return found


@pytest.mark.parametrize("alphabet", ["ab", "abcdefghijklmnopqrstuvwxyz", "aeé÷×ö", "Ààÿ"])
def test_trie_finds_all_neighbours(alphabet):
    counts = some_words(1, 400, alphabet)
    for letters in (spelling.LETTERS, spelling.LETTERS[::-1]):
        trie = spelling.Trie(letters, counts)
        # Each pair is met from one side, or from both where the counts are the same.
        met = [(word, near) for word in counts for near, _ in trie.near(word)]
        met += [(near, word) for word in counts for near, once in trie.near(word) if once]
        assert sorted(met) == sorted((a, b) for a in counts for b in counts if distance_is_one(a, b))
        assert all(spelling.one_edit(a, b) for a, b in met) and not any(spelling.one_edit(a, a) for a in counts)


@pytest.mark.parametrize("fewest, most, alphabet", [(500, 50_000, "abcdef"), (1, 3, "abcé"), (1, 1, "ab")])
def test_variants_equal_brute_force(spark, monkeypatch, fewest, most, alphabet):
    """Also where the cut goes down to leaves, and these are dealt over parts."""
    monkeypatch.setattr(spelling, "FEWEST", fewest)
    monkeypatch.setattr(spelling, "SHARD_WORDS", most)
    counts = some_words(2, 150, alphabet)
    df = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3)
    assert collected(spelling.variants(df)) == plain_variants(counts)


def test_roots_follow_long_chains(spark):
    counts = {"x" * k: 2 * 10 ** (k - 7) for k in range(7, 18)} | {"y" * 8: 5}
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = {r[0]: r[2] for r in collected(spelling.variants(df))}
    assert got == {w: "x" * 17 if w[0] == "x" else w for w in counts}


def test_ties_go_to_the_first_word(spark):
    counts = {"abcdefz": 20, "abcdefy": 20, "abcdefg": 2, "abcdefé": 20}
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert {r[0]: r[1] for r in collected(spelling.variants(df))}["abcdefg"] == "abcdefy"


def test_words_of_odd_documents(spark, monkeypatch):
    rows = [
        (1, None), (2, ""), (3, "123 ... \n"), (None, "Elephant elephants ELEPHANT"), (4, "Été É×÷ßßßßß éléphants ÉLÉPHANTS"),
        (4, "Été É×÷ßßßßß éléphants ÉLÉPHANTS"), (5, "z" * 50_000), (6, "z" * 50_000 + " " + "z" * 49_999), (7, "z" * 49_999),
        (8, "elephant-elephant_elephant1elephantĀelephant"),
    ]
    rows += [(i, " ".join(random.Random(i).choices(["balloon", "baloons", "ballons", "balloons", "ballooné"], k=30))) for i in range(100, 140)]
    df = spark.createDataFrame([(*r, 1, "w", "f") for r in rows], DOCS + ", n int, word string, `a.b` string").repartition(4)
    want = plain_words(rows)
    assert {r.word: r.n for r in spelling.words(df).collect()} == want
    assert collected(spelling.variants(spelling.words(df))) == plain_variants(want)
    monkeypatch.setattr(spelling, "GATHERED", 2)
    assert {r.word: r.n for r in spelling.words(df, every=2).collect()} == plain_words(rows, 2)
    assert collected(spelling.variants(spelling.words(spark.createDataFrame([], DOCS)))) == []


def test_many_words_of_the_same_letters(spark, monkeypatch):
    """A leaf of many words is looked up, not compared word by word."""
    rng = random.Random(3)
    counts = {}
    while len(counts) < 3000:
        word = "".join(rng.sample("abcdefgh", 8))
        counts[word] = rng.randint(2, 9)
        counts[word[:3] + word[4:]] = 200
    monkeypatch.setattr(spelling, "FEWEST", 100)
    compared = []
    plain = spelling.one_edit
    monkeypatch.setattr(spelling, "one_edit", lambda a, b: compared.append(1) or plain(a, b))
    trie = spelling.Trie(spelling.LETTERS, counts)
    whole = list(counts)[:200]
    for word in whole:
        found = [near for near, _ in trie.near(word)]
        assert len(set(found)) == len(found) and set(found) <= {x for x in counts if distance_is_one(word, x)}
    assert len(compared) < 200 * 200
    monkeypatch.setattr(spelling, "one_edit", plain)
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = {r.word: (r.n_near, r.form) for r in spelling.variants(df).collect()}
    for word in list(counts)[:60]:
        near = [x for x in counts if distance_is_one(word, x)]
        best = min(near, key=lambda x: (-counts[x], x), default=None)
        assert got[word] == (len(near), best if best and counts[best] >= 10 * counts[word] else None)


def test_query_equals_brute_force(spark, star):
    docs = spark.read.parquet(f"{star}/documents.parquet").where(F.col("doc_id") < 40)
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert {r.word: r.n for r in spelling.words(docs).collect()} == plain_words(rows)
    assert llm_queries()["op13_spelling_variants"](spark, star).columns == ["word", "form", "root", "n", "n_near", "form_n"]
