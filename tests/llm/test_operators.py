"""The operators on small tables: nulls, empty and long texts, ties, repeated rows, no rows, clashing columns."""

import hashlib
import pickle
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from paylens.llm import bpe, decontaminate, fingerprints, html_text, language, near_dedup, quality, secrets, token_count, url_filter
from paylens.llm.components import components
from paylens.llm.queries import ORACLES, RULES, llm_queries, remainder_is

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
STAR = "/root/testdata/sf0.001"
BYTE_BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def doc(i, text, lang="en"):
    return (i, text, lang, "s", None if text is None else len(text))


LONG = " ".join(f"word{i % 977}" for i in range(60_000))
ODD = [doc(1, None), doc(2, ""), doc(3, " \n\t"), doc(4, "one"), doc(4, "one"), doc(None, "no id here"), doc(7, LONG), doc(8, "one two three four five six"), doc(9, "one two three four five six")]
#: Columns of the names that operators use or return.
CLASHES = ("node", "kept", "spans", "items", "n_tokens", "fingerprint", "at", "copy", "range", "root", "label", "id", "token", "features", "held_out", "score")


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(ODD, DOCS)
    return df.withColumns({c: F.lit(f"x{c}") for c in CLASHES}).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def by_id(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def plain_next(rows):
    """(id, text, next text) by descending id, null last, ties by text."""
    order = sorted(((i, t or "") for i, t, *_ in rows), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    return [(i, t, order[(k + 1) % len(order)][1]) for k, (i, t) in enumerate(order)]


@pytest.mark.parametrize("ranges", [1, 3, 50])
def test_neighbours_follow_by_descending_id(spark, odd, none, ranges):
    got = by_id(fingerprints.neighbour_fingerprints(odd, ranges=ranges))
    sampler = fingerprints.Sampler()
    want = []
    for i, text, following in plain_next(ODD):
        changed = fingerprints.edited(text, following)
        a, b, c = (sampler.of_text(t) for t in (text, changed, following))
        want.append((i, len(text), hashlib.sha256(changed.encode()).hexdigest(), fingerprints.printed(a), fingerprints.printed(b), fingerprints.likeness(a, b), fingerprints.likeness(a, c)))
    assert got == sorted(want, key=repr)
    assert fingerprints.neighbour_fingerprints(none, ranges=ranges).count() == 0
    assert dict(by_id(fingerprints.fingerprints(odd.where("doc_id = 4").limit(1))))[4] == fingerprints.printed(sampler.of_text("one"))


def test_neighbours_over_many_ranges(spark):
    rng = random.Random(2)
    rows = [doc(rng.randint(0, 400), f"text {rng.randint(0, 50)} {k}") for k in range(300)]
    got = {(r.doc_id, r.n_chars, r.edited_sha256) for r in fingerprints.neighbour_fingerprints(spark.createDataFrame(rows, DOCS).repartition(5), ranges=23).collect()}
    want = {(i, len(t), hashlib.sha256(fingerprints.edited(t, n).encode()).hexdigest()) for i, t, n in plain_next(rows)}
    assert got == want


ITEMS = [(1, "One two, three four"), (2, None), (3, ""), (None, "five six"), (5, "word1 word2 word3 word4 word5 word6 word7 word8 word9 word10 word11"), (5, "two three")]


@pytest.mark.parametrize("block_bytes", [10**6, 30])
def test_contamination(spark, odd, none, block_bytes):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    found = decontaminate.contamination(odd, items, block_bytes=block_bytes)
    got = {(r.doc_id, r.n_words): r for r in decontaminate.digest(found).collect()}
    assert len(got) == 8 and found.count() == 9
    assert got[8, 6].n_hit == 6 and got[8, 6].n_items == 2
    assert got[8, 6].items_sha256 == hashlib.sha256(b"1,5").hexdigest() 
    assert {r.doc_id: r.longest for r in found.collect()}[8] == 4
    assert (got[1, 0].n_hit, got[1, 0].contaminated, got[1, 0].items_sha256) == (0, False, hashlib.sha256(b"").hexdigest())
    assert got[7, 60_000].n_hit == 11 * 62 and got[7, 60_000].n_items == 1
    assert decontaminate.digest(decontaminate.contamination(none, items)).count() == 0
    clean = decontaminate.digest(decontaminate.contamination(odd, items.limit(0)))
    assert clean.where("contaminated").count() == 0 and clean.count() == 9


@pytest.mark.parametrize("block_bytes", [10**6, 30])
def test_decontaminated_documents(spark, odd, block_bytes):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    rest = decontaminate.decontaminated(odd, items, length_col="n_chars", block_bytes=block_bytes)
    assert rest.columns == odd.columns
    kept = {r.doc_id: r for r in rest.collect()}
    assert set(kept) == {1, 2, 3, 4, None, 7}
    assert kept[1].text is None and kept[1].n_chars is None and kept[4].text == "one"
    assert len(kept[7].text) == kept[7].n_chars < len(LONG) and "word5 " not in kept[7].text


@pytest.mark.parametrize("blocks", [1, 2])
def test_blocks_of_items_do_not_change_what_is_cut(spark, blocks):
    """Coverage split over blocks, overlapping items of two blocks, and a cut that joins an item of another block."""
    first, second = ([f"{c}{k}" for k in range(1, 13)] for c in "ab")
    overlapping = first[5:] + [f"c{k}" for k in range(1, 6)]
    rows = [(1, " ".join(first)), (2, " ".join(second)), (3, " ".join(overlapping))]
    other = [f"x{k}" for k in range(100)]
    texts = {
        1: first + other[:6] + second,
        2: other[:20] + first + overlapping[7:] + other[20:],
        3: other[:30] + first[:6] + second + first[6:] + other[30:],
        4: other[:30] + second[:6] + first + second[6:] + other[30:],
        5: other[:15] + ["clean"],
    }
    docs = spark.createDataFrame([doc(i, " ".join(t)) for i, t in texts.items()] + [doc(6, None), doc(7, "")], DOCS)
    docs = docs.withColumns({c: F.lit(f"x{c}") for c in (*CLASHES, "row", "total", "gone", "stays")})
    items = spark.createDataFrame(rows, "item_id long, text string")
    block_bytes = -(-sum(len(t) for _, t in rows) // blocks)
    if blocks > 1:
        halves = decontaminate.unpacked(decontaminate.automata(items, "item_id", "text", 10, block_bytes))
        parts = [{w for w in pickle.loads(packed.data).words if w in (b"a1", b"b1", b"c1")} for packed, _ in halves]
        assert {b"a1"} in parts and {b"b1", b"c1"} in parts
    rest = decontaminate.decontaminated(docs, items, length_col="n_chars", block_bytes=block_bytes)
    assert rest.schema == docs.schema
    got = {r.doc_id: (r.text, r.n_chars) for r in rest.collect()}
    cut = " ".join(other[:20]) + "  " + " ".join(other[20:])
    assert got[2] == (cut, len(cut)) and 1 not in got
    for i in (3, 4):
        assert got[i][0].split() == other and got[i][1] == len(got[i][0])
    assert got[5][0] == " ".join(texts[5]) and got[6] == (None, None) and got[7] == ("", 0)


def plain_components(rows, width=2, percent=80):
    sets = []
    for _, text, *_ in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append(frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))) if words else frozenset())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    least = {}
    for i, row in enumerate(rows):
        if row[0] is not None:
            least[find(i)] = min(row[0], least.get(find(i), row[0]))
    return sorted(((r[0], len(sets[i]), least.get(find(i)), least.get(find(i)) == r[0]) for i, r in enumerate(rows)), key=repr)


def near_copies(seed, n=160):
    """Chains and groups of near copies over a shared line, with copies and case changes."""
    rng = random.Random(seed)
    line = [f"c{i}" for i in range(8)]
    rows, base = [], []
    for i in range(n):
        kind = rng.random()
        if kind < 0.35 or not base:
            words = line[: rng.choice([0, 8])] + [f"w{rng.randint(0, 300)}" for _ in range(rng.choice([1, 3, 12, 40, 90]))]
        else:
            words = list(rng.choice(base))
            for _ in range(rng.choice([0, 0, 1, 2, 5])):
                words[rng.randrange(len(words))] = f"v{rng.randint(0, 99)}"
        base.append(words)
        text = " ".join(words)
        rows.append(doc(i * 7 % 1009, text.upper() if rng.random() < 0.1 else text))
    return rows


@pytest.mark.parametrize("seed, small_blocks", [(1, False), (2, True)])
def test_near_duplicates_equal_comparing_all(spark, monkeypatch, seed, small_blocks):
    if small_blocks:
        monkeypatch.setattr(near_dedup, "BLOCK_NODES", 4)
        monkeypatch.setattr(near_dedup, "BLOCK_SHINGLES", 200)
    rows = near_copies(seed)
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, DOCS).repartition(4), width=2).drop("node")
    assert by_id(got) == plain_components(rows)


def test_near_duplicates_of_odd_rows(spark, odd, none):
    got = by_id(near_dedup.near_duplicates(odd, width=2).drop("node"))
    want = [r if r[0] is not None else (None, r[1], None, True) for r in plain_components(ODD)]
    want = [(i, n, i, True) if n == 0 else (i, n, c, k) for i, n, c, k in want]
    assert got == sorted(want, key=repr)
    assert near_dedup.near_duplicates(none).count() == 0
    rest = near_dedup.deduplicated(odd)
    assert rest.columns == odd.columns
    assert sorted((r.doc_id for r in rest.collect()), key=repr) == sorted([1, 2, 3, 4, None, 7, 8], key=repr)
    assert near_dedup.deduplicated(none).count() == 0


def test_one_document_of_each_group_stays(spark):
    rows = near_copies(3)
    rest = near_dedup.deduplicated(spark.createDataFrame(rows, DOCS).repartition(3), width=5)
    want = sorted(i for i, _, _, kept in plain_components(rows, width=5) if kept)
    assert sorted(r.doc_id for r in rest.collect()) == want


def test_documents_keep_columns_of_any_name(spark):
    rows = [(1, "one two three four five six", 5, "a"), (2, "one two three four five six", 6, "b"), (None, None, 7, "c")]
    docs = spark.createDataFrame(rows, "`doc.id` long, `the.text` string, __node int, `__row` string")
    docs = docs.withColumns({"__id": F.lit("i"), "___Node": F.lit(1.5), "_a.b`c": F.lit(0)})
    rest = near_dedup.deduplicated(docs, "doc.id", "the.text")
    assert rest.columns == docs.columns
    assert by_id(rest) == sorted([(1, rows[0][1], 5, "a", "i", 1.5, 0), (None, None, 7, "c", "i", 1.5, 0)], key=repr)


def test_components_of_chains_loops_and_stars(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (200, 200), (5, 300), (300, 5), (None, 1)]
    got = dict(by_id(components(spark.createDataFrame(edges, "x long, y long"), "x", "y")))
    assert got == {**{i: 1 for i in range(1, 41)}, **{k: 100 for k in range(100, 160)}, 200: 200, 300: 1}
    assert components(spark.createDataFrame([], "x long, y long"), "x", "y").count() == 0


def test_pages_of_every_kind(spark):
    rows = [(1, "u", "<article><h1>T</h1><p>Text, here.</p></article><footer>f</footer>"), (1, "u", None), (None, None, ""), (4, "v", "<p>" + "long words, here. " * 20_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(5)).withColumn("n_chars", F.lit("x"))
    got = by_id(html_text.extracted(pages))
    long = ("long words, here. " * 20_000).strip()
    assert got == sorted([(1, "u", "T\n\nText, here.", 14), (1, "u", "", 0), (None, None, "", 0), (4, "v", long, len(long))], key=repr)
    assert html_text.extracted(pages.limit(0)).count() == 0


def link(url):
    return f'<head><link href="{url}" rel="canonical"></head>'


def test_repeated_items_do_not_fill_a_block(spark):
    """A third of all rows are one item, which counts once; a block's automaton may take several rows of its table."""
    many = [(f"i{k}", " ".join(f"w{k}x{j}" for j in range(20))) for k in range(200)]
    items = spark.createDataFrame(many + [many[0]] * 100 + [(None, many[1][1]), ("none", None)], "item_id string, text string").repartition(7)
    docs = spark.createDataFrame([doc(k, f"before {t} after") for k, (_, t) in enumerate(many)], DOCS)
    built = decontaminate.automata(items, "item_id", "text", 10, 10_000)
    sizes = [len(pickle.loads(packed.data).code) for packed, _ in decontaminate.unpacked(built)]
    assert len(sizes) > 1 and sum(sizes) <= len(sizes) + 20 * 201 and max(sizes) < 20 * 200 / len(sizes) * 2
    for block_bytes in (10_000, 10**6):
        found = decontaminate.contamination(docs, items, block_bytes=block_bytes).collect()
        assert all(list(r["items"]) == [f"i{r.doc_id}"] and [tuple(s) for s in r.spans] == [(1, 21)] for r in found) and len(found) == 200


def test_rules_and_aliases(spark):
    rows = [
        (1, "http://A.Example.ORG/es/1?x", None), (2, "https://example.org/en/12", ""), (3, "https://example.org/fr", ""),
        (4, "http://x.com/fr/1", ""), (5, "http://x.com/de/1", ""), (6, "http://x.net/a#b", link("http://x.com/de/1#p=2")),
        (7, "http://y.net/a", '<meta http-equiv="refresh" content="0; url=/b">'), (8, "http://y.net/b", link("http://x.net/a")),
        (9, "http://z.net/a", link("http://x.com/fr/1") + '<meta http-equiv=refresh content="1;URL=http://x.com/de/1">'),
        (10, None, link("http://x.com/de/1")), (11, "no scheme", ""), (12, "http://notexample.org", ""), (13, "http://q.net", ""),
        (13, "http://q.net", ""), (14, "http://notcom/de/", ""), (15, "http://h.net/1/2", "<link rel='canonical' href='3'>"), (16, "http://h.net/1/3", ""),
        (17, "http://r.net/x", ""),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit(1)).withColumn("n", F.lit(1))
    moved = spark.createDataFrame([("http://r.net/x", "http://h.net/1/2"), ("http://h.net/1/3", "http://m.com/de/"), (None, "x")], "source string, target string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judged(pages, RULES).collect()}
    assert got[1] == ("a.example.org", "/es/1", "example.org/es/", "block")
    assert got[2][2:] == ("example.org/en/1", "block") and got[3][2:] == ("org/", "allow")
    assert got[4][2:] == ("com/fr/", "allow") and got[5][2:] == ("com/de/", "block")
    # One class: explicit allow precedes the block for those without a rule of their own.
    assert [got[i][3] for i in (6, 7, 8, 9)] == ["allow"] * 4
    assert got[10] == ("", "", None, "allow") and got[11] == ("", "", None, "allow")
    assert got[12] == ("notexample.org", "", None, "allow")
    assert got[13] == ("q.net", "", None, "allow") and got[14] == ("notcom", "/de/", None, "allow")
    assert [got[i][3] for i in (15, 16, 17)] == ["allow"] * 3
    blocked = {r.page_id: r.verdict for r in url_filter.judged(pages.where("page_id <> 9"), RULES, redirects=moved).collect()}
    assert [blocked[i] for i in (6, 7, 8, 13, 15, 16, 17)] == ["block"] * 3 + ["allow"] + ["block"] * 3
    assert url_filter.judged(pages, RULES).count() == len(rows)
    assert url_filter.judged(pages.limit(0), RULES).count() == 0
    assert url_filter.judged(pages, []).where("verdict <> 'allow'").count() == 0
    with pytest.raises(ValueError):
        url_filter.judged(pages, [("allow", str(i), "/") for i in range(3000)])


def test_aliases_are_whole_urls(spark, tmp_path):
    block, allow = "http://x.com/de/1", "http://x.com/fr/1"
    rows = [
        (1, "http://a.net/p?id=1", link(block)), (2, "http://a.net/p?id=2", ""), (3, "http://a.net/p", ""), (4, "https://a.net/p?id=1#x", ""),
        (5, "http://b.net/1/2/3", link("../../x/./y/..")), (6, "http://b.net/x/", link(block)), (7, "http://b.net/x", ""),
        (8, "http://c.net/a", link("http://x.com/de/1?a=1&amp;b=&#50;")), (9, "http://c.net/b", link("&#x2F;&#47;x.com/de/1?a=1&#38;b=2")), (10, "http://x.com/fr/../de/1?a=1&b=2", ""),
        (11, "http://d.net/a", f"<!-- {link(block)} --><script>'{link(block)}'</script><style>{link(block)}</style>"),
        (12, "http://e.net/go", link("/to?u=http://x.com/de/1")), (13, "http://e.net/to?u=http://x.com/de/1", link(block)), (14, "http://e.net/to", ""),
        (15, "http://f.net/a?x=1", link("?y=2")), (16, "http://f.net/a?y=2", link(block)), (17, "http://g.net/a", link("mailto:x.com/de/1")),
        (18, "http://h.net/../../a", link(block)), (19, "http://h.net/a", ""), (20, "http://i.net", link(block)), (21, "http://i.net/", ""),
        (22, "http://j.net/a", link(allow)), (23, "http://j.net/b", link("a") + '<meta http-equiv="refresh" content="0; url=http://y.com/de/9">'), (24, "http://k.net/a", link("&#0;&#999;")),
        (25, None, link(block)), (26, "http://l.net/a", None), (26, "http://l.net/a", None),
    ]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    found = llm_queries()["op5_url_filter"](spark, str(tmp_path)).collect()
    verdicts = {r.page_id: r.verdict for r in found}
    assert {i for i, v in verdicts.items() if v == "block"} == {1, 4, 5, 6, 8, 9, 12, 13, 15, 16, 18, 19, 20, 21}
    views = duckdb.connect()
    views.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    names = ["page_id", "host", "path", "rule", "verdict"]
    plain = views.execute(f"SELECT {', '.join(names)} FROM ({ORACLES['op5_url_filter']})").fetchall()
    assert sorted(plain, key=str) == sorted((tuple(r[n] for n in names) for r in found), key=str)


def test_languages_of_odd_rows(spark, odd, none):
    held_out = remainder_is("doc_id", 4, 2)
    rows = {r.doc_id: r for r in language.identified(odd, held_out).collect()}
    assert {rows[i].lang_pred for i in (1, 2, 3)} == {"und"} and rows[1].score == 0.0
    assert rows[4].lang_pred == "en" and 0 < rows[4].score <= 1
    assert rows[8].held_out == (zlib.crc32(b"8") % 4 == 2) and rows[None].held_out is False
    assert language.identified(none, held_out).count() == 0
    unlabelled = odd.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in language.identified(unlabelled, held_out).collect()} == {"und"}


def test_labels_of_held_out_documents_are_not_learnt(spark):
    docs = spark.read.parquet(f"{STAR}/documents.parquet")
    held_out = remainder_is("doc_id", 4, 2)
    spoiled = docs.withColumn("lang", F.when(held_out, "xx").otherwise(F.col("lang")))
    once, again = (by_id(language.identified(d, held_out)) for d in (docs, spoiled.repartition(5)))
    assert once == again and not any(r[2] == "xx" for r in once)
    right = docs.join(language.identified(docs, held_out).where("held_out"), "doc_id").select((F.col("lang") == F.col("lang_pred")).cast("int").alias("ok"))
    assert right.agg(F.avg("ok")).first()[0] > 0.95


def test_rare_languages_are_learnt_among_many_documents(spark):
    rare = [doc(100_000 + k, " ".join(chr(0x4E00 + 50 * k + j) * 3 for j in range(12)), f"r{k}") for k in range(12)]
    many = spark.range(60_000).select(F.col("id").alias("doc_id"), F.lit("some words here").alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(15).cast("long").alias("n_chars"))
    docs = many.unionByName(spark.createDataFrame(rare, DOCS)).repartition(8)
    found = {r.doc_id: r.lang_pred for r in language.identified(docs, F.lit(False)).where("doc_id >= 100000").collect()}
    assert found == {i: lang for i, _, lang, *_ in rare}


def test_token_counts_of_odd_rows(spark, odd, none):
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    want = sorted(((i, len((t or "").encode()), len(model.encode(t or "")), len(model.encode(t or "")) > 4096) for i, t, *_ in ODD), key=repr)
    assert by_id(token_count.token_counts(odd, PIECES)) == want
    assert token_count.token_counts(none, PIECES).count() == 0


@pytest.mark.parametrize("frequent", [0, 3])
def test_token_counts_do_not_depend_on_what_is_frequent(spark, monkeypatch, frequent):
    monkeypatch.setattr(token_count, "FREQUENT", frequent)
    monkeypatch.setattr(token_count, "FREQUENT_LONG", frequent)
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    texts = [f"hot word{i % 7} x{i}  \u2581 " + "y" * (i % 90) for i in range(300)] + ["z" * 500] * 40 + [None, ""]
    docs = spark.createDataFrame([doc(i // 2, t) for i, t in enumerate(texts)], DOCS).repartition(5).checkpoint()
    want = sorted(((i // 2, len(model.encode(t or ""))) for i, t in enumerate(texts)))
    assert sorted((r.doc_id, r.n_tokens) for r in token_count.token_counts(docs, PIECES).collect()) == want


def test_quality_of_odd_rows(spark, odd, none):
    held_out = remainder_is("doc_id", 5, 0)
    labels = spark.createDataFrame([(4, 1), (4, 0), (8, 1), (9, None), (None, 1), (77, 0), (7, 1)], "doc_id long, quality int")
    for taught in (labels, labels.limit(0)):
        ranking = quality.learnt(odd, taught, held_out)
        rows = quality.scored(odd, ranking, held_out).collect()
        assert len(rows) == 9 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
        assert quality.scored(none, ranking, held_out).count() == 0
        rest = quality.accepted(odd, ranking)
        assert rest.columns == odd.columns and rest.count() == sum(r.predicted for r in rows)
    assert {r.score for r in quality.scored(odd, quality.learnt(odd, labels.limit(0), held_out), held_out).collect()} == {0.5}


def test_rare_bad_labels_and_labels_of_absent_documents(spark):
    good = [doc(i, f"This is sentence {i} of a text that reads well, and ends here.") for i in range(400)]
    bad = [doc(i, "||| ### @@@ ||| $$$ %%% ||| ###") for i in (1000, 1001)]
    docs = spark.createDataFrame(good + bad, DOCS)
    absent = [(i, 0) for i in range(5000, 5500)]
    labels = spark.createDataFrame([(i, 1) for i, *_ in good] + [(i, 0) for i, *_ in bad] + absent, "doc_id long, quality int")
    for sample in (8, 20, 10_000):
        ranking = quality.learnt(docs, labels, F.lit(False), sample=sample)
        rejected = quality.scored(docs, ranking, F.lit(False)).where("predicted = 0").collect()
        assert sorted(r.doc_id for r in rejected) == [1000, 1001], sample


def test_quality_is_learnt_from_every_labelled_document(spark):
    rng = np.random.default_rng(5)
    texts = [" ".join(rng.choice(["word", "a", "Longer", "|||", "7", "stop."], rng.integers(1, 9))) for _ in range(12_000)]
    good = [t.count("|") + 3 * t.count("7") + rng.normal() * 3 < 5 for t in texts]
    docs = spark.createDataFrame([doc(i, t) for i, t in enumerate(texts)], DOCS)
    labels = spark.createDataFrame([(i, int(g)) for i, g in enumerate(good)], "doc_id long, quality int")
    found = quality.learnt(docs, labels, F.lit(False))
    want = quality.fitted(np.array([quality.features(t) for t in texts]), np.array(good))
    assert np.allclose(found.mean, want.mean) and np.allclose(found.weights, want.weights, atol=1e-6)
    assert abs(found.threshold - want.threshold) < 1e-6


def test_quality_on_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    held_out = remainder_is("doc_id", 5, 0)
    spoiled = labels.withColumn("quality", F.when(held_out, 1 - F.col("quality")).otherwise(F.col("quality")))
    rankings = [quality.learnt(d, la.where(~held_out), held_out) for d, la in ((docs, labels), (docs.repartition(7), spoiled))]
    assert (rankings[0].weights == rankings[1].weights).all()
    found = quality.scored(docs, rankings[0], held_out).where("held_out").join(labels, "doc_id").where("quality is not null").collect()
    assert len(found) > 50 and sum(r.predicted == r.quality for r in found) / len(found) > 0.95


def test_bpe_of_odd_rows_and_back(spark, odd, none):
    library = Tokenizer.from_file(BYTE_BPE)
    ids = {t: library.encode(t or "", add_special_tokens=False).ids for _, t, *_ in ODD}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = sorted(((i, len(ids[t]), sha(",".join(map(str, ids[t]))), sha(t or "")) for i, t, *_ in ODD), key=repr)
    assert by_id(bpe.round_trip(odd, BYTE_BPE)) == want
    encoded = bpe.encoded(odd, BYTE_BPE)
    assert by_id(encoded) == sorted(((i, len(ids[t]), ids[t]) for i, t, *_ in ODD), key=repr)
    assert by_id(bpe.decoded(encoded, BYTE_BPE)) == sorted(((i, t or "") for i, t, *_ in ODD), key=repr)
    assert bpe.round_trip(none, BYTE_BPE).count() == bpe.encoded(none, BYTE_BPE).count() == 0
    nulls = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert by_id(bpe.decoded(nulls, BYTE_BPE)) == [(1, ""), (2, "")]


def test_secrets_of_odd_rows(spark, odd, none):
    more = spark.createDataFrame([doc(20, 'é token = "0123456789abcdef0123456789abcdef" end'), doc(20, None)], DOCS)
    rows = {(r.doc_id, r.n_assign): r for r in secrets.digest(secrets.secrets(odd.select(*more.columns).union(more))).collect()}
    assert rows[20, 1].spans == "assign:2:43,hex:11:43" and rows[20, 1].n_hex == 1
    assert rows[20, 1].base_sha256 == hashlib.sha256(rows[20, 1].spans.encode()).hexdigest()
    assert rows[20, 0].spans == "" and rows[7, 0].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert secrets.digest(secrets.secrets(none)).count() == 0
    clean = secrets.without_secrets(odd.unionByName(more, allowMissingColumns=True), length_col="n_chars")
    assert clean.columns == odd.columns and clean.count() == 11
    changed = clean.where("doc_id = 20 and text is not null").first()
    assert changed.text == f'é {secrets.PLACEHOLDER}" end' and changed.n_chars == len(changed.text)
    assert clean.where("doc_id = 1").first().text is None


def test_queries_and_columns(spark):
    columns = {
        "op1": ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        "op2": ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
        "op3": ["doc_id", "n_shingles", "component_id", "kept"],
        "op4": ["page_id", "url", "text", "n_chars"],
        "op5": ["page_id", "host", "path", "rule", "verdict"],
        "op6": ["doc_id", "held_out", "lang_pred", "score"],
        "op7": ["doc_id", "n_bytes", "n_tokens", "over_limit"],
        "op8": ["doc_id", "held_out", "score", "predicted"],
        "op9": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        "op10": ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
    }
    for name, query in llm_queries().items():
        df = query(spark, STAR)
        assert df.columns == columns[name.split("_")[0]]
        assert df.count() == spark.read.parquet(f"{STAR}/{'pages' if name[:3] in ('op4', 'op5') else 'documents'}.parquet").count()


def test_near_duplicates_of_the_small_table(spark):
    docs = spark.read.parquet(f"{STAR}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    assert by_id(llm_queries()["op3_near_dedup"](spark, STAR)) == plain_components(rows)


def test_fingerprint_likeness_of_the_small_table(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{STAR}/documents.parquet").collect()}
    order = sorted(texts, reverse=True)
    errors = []
    for r in llm_queries()["op1_fingerprints"](spark, STAR).collect():
        following = texts[order[(order.index(r.doc_id) + 1) % len(order)]]
        a, b = Counter(texts[r.doc_id].split()), Counter(fingerprints.edited(texts[r.doc_id], following).split())
        keys = set(a) | set(b)
        errors.append(abs(r.near_edited - sum(min(a[k], b[k]) for k in keys) / sum(max(a[k], b[k]) for k in keys)))
    assert sum(errors) / len(errors) < 0.07


def test_pipeline_equals_its_plain_version(spark):
    """Stages 2 to 5 by brute force, from what the first one keeps."""
    docs = spark.read.parquet(f"{STAR}/documents.parquet")
    held_out = remainder_is("doc_id", 5, 0)
    labels = spark.read.parquet(f"{STAR}/labels.parquet").where(~held_out)
    good = quality.scored(docs, quality.learnt(docs, labels, held_out), held_out).where("predicted = 1")
    rows = sorted(tuple(r) for r in docs.join(good.select("doc_id"), "doc_id", "left_semi").collect())
    assert 0 < len(rows) < docs.count()
    kept = {i for i, _, _, k in plain_components(rows, width=5) if k}
    items = [(str(r.item_id), decontaminate.letter_words(r.text)) for r in spark.read.parquet(f"{STAR}/benchmark.parquet").collect()]
    windows = {tuple(words[i : i + 10]) for _, words in items for i in range(max(1, len(words) - 9))}
    library, want = Tokenizer.from_file(BYTE_BPE), []
    for i, text, *_ in rows:
        if i not in kept:
            continue
        total, gone = len(decontaminate.letter_words(text)), 0
        while True:
            places = [m.span() for m in re.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text)]
            words = [text[a:b].encode().lower() for a, b in places]
            hit = sorted({k for w in {len(x) for x in windows} for s in range(len(words) - w + 1) if tuple(words[s : s + w]) in windows for k in range(s, s + w)})
            gone += len(hit)
            if not hit or gone > 0.5 * total:
                break
            cut = bytearray(len(text))
            for k in hit:
                a, b = places[k]
                end = places[k + 1][0] if k + 1 in hit else b
                cut[a:end] = b"\1" * (end - a)
            text = "".join(c for c, x in zip(text, cut) if not x)
        if gone <= 0.5 * total:
            ids = library.encode(secrets.redacted(text), add_special_tokens=False).ids
            want.append((i, len(ids), ids))
    assert by_id(corpus_pipeline.run(spark, STAR)) == sorted(want, key=repr)


@pytest.mark.parametrize("texts", [[], [None, None], [""], ["only one document here"]])
def test_stages_on_small_and_empty_tables(spark, tmp_path, texts):
    spark.createDataFrame([doc(i, t) for i, t in enumerate(texts)], DOCS).withColumn("__x", F.lit(1)).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns, name
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == list(range(len(texts)))
