"""The parts of the operators that need no session, against plain versions of them."""

import base64
import hashlib
import json
import pickle
import random
import re
import time
import tracemalloc
from collections import Counter
from functools import cache

import numpy as np
import public_tokenizers
import pytest
import regex
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from paylens.llm import bpe, decontaminate, fingerprints, html_text, language, near_dedup, quality, secrets, token_count
from paylens.llm.common import letter_words, spaced_words

WORDS = st.lists(st.sampled_from(["a", "b", "c", "dd"]), max_size=30)
TEXTS = st.text(alphabet=st.sampled_from(list("abAB 09.,\n\t'éßñ中😀  \x1c_½Ⅷ")), max_size=40)


@given(TEXTS)
def test_words_are_those_of_the_patterns(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    assert [w.decode() for w in letter_words(text)] == re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    assert [w.decode() for w in spaced_words(text)] == re.findall(r"[^\x20\x09-\x0D]+", low)


def test_signatures_agree_as_often_as_generalised_jaccard_says():
    rng = random.Random(3)
    sampler = fingerprints.Sampler(coordinates=512)
    for _ in range(6):
        a = Counter({f"w{i}".encode(): rng.randint(1, 9) for i in range(60)})
        b = Counter({w: max(1, n + rng.randint(-3, 3)) for w, n in a.items() if rng.random() < 0.8})
        b.update({f"x{i}".encode(): rng.randint(1, 5) for i in range(10)})
        keys = set(a) | set(b)
        true = sum(min(a[k], b[k]) for k in keys) / sum(max(a[k], b[k]) for k in keys)
        assert abs(fingerprints.likeness(sampler.signature(a), sampler.signature(b)) - true) < 0.08


def test_fingerprints_of_equal_empty_and_long_texts():
    sampler = fingerprints.Sampler(kept=50)
    empty, text = sampler.of_text(""), "some words and some more words"
    assert fingerprints.likeness(empty, sampler.of_text(" \n ")) == 1.0
    assert fingerprints.likeness(empty, sampler.of_text(text)) == 0.0
    first = fingerprints.printed(sampler.of_text(text))
    long = " ".join(f"w{i}" for i in range(20_000))
    again = fingerprints.Sampler(kept=10**6)
    assert (sampler.of_text(long) == again.of_text(long)).all()
    assert first == fingerprints.printed(sampler.of_text(text)) == fingerprints.printed(again.of_text(text))
    assert len(first) == 64 * 8
    one = "x" * 500 + "y" * 500
    assert 0.2 < fingerprints.likeness(sampler.of_text(one), sampler.of_text("x" * 500 + "z" * 500)) < 1.0
    assert fingerprints.edited("abcdefg", "XYZ") == "abcdeXY" and fingerprints.edited("ab", "XY") == "ab"
    assert fingerprints.edited("abcdef", "X") == "abcdX" and fingerprints.edited("", "X") == ""


def naive_hits(words, items, window):
    hit, names = set(), set()
    for name, item in items:
        width = min(window, len(item))
        for k in range(len(item) - width + 1 if width else 0):
            for i in range(len(words) - width + 1):
                if words[i : i + width] == item[k : k + width]:
                    hit.update(range(i, i + width))
                    names.add(name)
    return hit, names


@settings(max_examples=300, deadline=None)
@given(WORDS, st.lists(WORDS, max_size=5), st.integers(1, 6))
def test_automaton_finds_what_comparing_everything_finds(words, items, window):
    named = [(str(i), [w.encode() for w in item]) for i, item in enumerate(items)]
    words = [w.encode() for w in words]
    automaton = decontaminate.Automaton(named, window)
    spans, names, longest = automaton.matches(words)
    hit = {i for a, b in spans for i in range(a, b)}
    assert (hit, names) == naive_hits(words, named, window)
    assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))
    parts = {tuple(item[i:j]) for _, item in named for i in range(len(item)) for j in range(i + 1, len(item) + 1)}
    assert longest == max((j - i for i in range(len(words)) for j in range(i + 1, len(words) + 1) if tuple(words[i:j]) in parts), default=0)


def test_an_automaton_is_bounded_by_its_items():
    chosen = random.Random(1)
    words = [f"{chosen.randrange(10**6):x}".encode() for _ in range(5000)]
    items = [(str(k), chosen.choices(words, [1 / (i + 1) for i in range(len(words))], k=60)) for k in range(1000)]
    size = sum(len(w) + 1 for _, item in items for w in item)
    tracemalloc.start()
    automaton = decontaminate.Automaton(items)
    held, most = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert held < 60 * size and most < 80 * size
    again = pickle.loads(pickle.dumps(automaton))
    for name, item in items[:50]:
        assert again.matches(item) == automaton.matches(item) and automaton.matches(item)[0] == [(0, 60)] and name in automaton.matches(item)[1]


def test_spans_are_cut_until_nothing_matches():
    automaton = decontaminate.Automaton([("1", [b"a", b"b", b"c"]), ("2", [b"x", b"y", b"z"])], 3)
    text = "k l m n o p, x a b c y z; q r s t u v w"
    assert decontaminate.without_items(text, automaton, 0.5) == ("k l m n o p, ; q r s t u v w", True)
    assert decontaminate.without_items("A b. C d", automaton, 0.5) == ("A b. C d", False)
    assert decontaminate.without_items("clean a b", automaton, 0.5) == ("clean a b", True)
    assert decontaminate.without_items("", automaton, 0.5) == ("", True)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sets(st.integers(0, 12), min_size=1), min_size=2, max_size=12))
def test_trees_span_the_links_of_full_sets(sets):
    arrays = [np.array(sorted(s), np.uint64).tobytes() for s in sets]
    nodes = [bytes([i]) for i in range(len(sets))]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    want = {}
    for i in range(len(sets)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    groups = {}
    for i in range(len(sets)):
        groups.setdefault(find(i), set()).add(i)
    edges = near_dedup._trees(nodes, near_dedup.overlapping(arrays, 80))
    assert len(edges) == len(sets) - len(groups)
    parent = list(range(len(sets)))
    for a, b in edges:
        parent[find(a[0])] = find(b[0])
    got = {}
    for i in range(len(sets)):
        got.setdefault(find(i), set()).add(i)
    want = sorted(map(sorted, groups.values()))
    assert sorted(map(sorted, got.values())) == want


def test_agreements_estimate_jaccard():
    rng = random.Random(5)
    words = [f"w{rng.randint(0, 10**6)}" for _ in range(400)]
    other = [w if rng.random() > 0.05 else w + "x" for w in words]
    a, b = near_dedup.shingles(" ".join(words), 2), near_dedup.shingles(" ".join(other), 2)
    true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert abs((near_dedup.signature(a) == near_dedup.signature(b)).mean() - true) < 0.2
    assert len(near_dedup.shingles("one", 2)) == len(near_dedup.shingles("One\t", 5)) == 1
    assert len(near_dedup.shingles(" \n", 2)) == 0
    assert near_dedup.set_key(near_dedup.shingles("a b a b", 2)) == near_dedup.set_key(near_dedup.shingles("B A B A", 2))


PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var a="</p>";</script></head><body>
<header><h1>The site</h1><p>Welcome, reader, to the site.</p></header><nav><ul><li><a href=/a>Home</a></li></ul></nav>
<div class="cookie-notice"><p>We use cookies, many of them, to make this better. Please accept.</p></div>
%s<h1>Title &amp; more</h1><p>First   paragraph, <b>bold</b>&nbsp;and <a href=/x>linked</a>.<br>Next line.</p>
<ul><li>one<li>two</ul><p>Short.</p><div class="ad">Buy now, cheap.</div><!-- note --><blockquote>Quoted words, as said.</blockquote>
<form><label>Your mail</label><input></form>%s
<section id="comments"><h2>Comments</h2><p>Great article, I liked it very much, and so did all of us here.</p></section>
<aside><p>Related: many other stories, all of them good.</p></aside><footer>&copy; 2020 all rights</footer></body></html>"""
ARTICLE = "Title & more\n\nFirst paragraph, bold and linked. Next line.\n\none\n\ntwo\n\nShort.\n\nQuoted words, as said."


@pytest.mark.parametrize("ends", [("<article>", "</article>"), ("<main>", "</main>"), ('<div id="content">', "</div>"), ('<div class="x"><section>', "</section></div>")])
def test_the_article_is_extracted_from_a_page(ends):
    assert html_text.main_text(PAGE % ends) == ARTICLE


WORDY = "Some text, with words, here. And more of it, so that it is long."


@pytest.mark.parametrize("name", ["text", "x", "story"])
@pytest.mark.parametrize("around", [("<div class=page>", "</div>"), ("", ""), ("<div><div>", "</div></div>")])
def test_headings_and_leads_between_parts_of_an_article_stay(name, around):
    parts = ["<h2>First</h2>", f"<div class={name}>{WORDY}</div>", f"<p class=lead>{WORDY * 3}</p>", "<h2>Second</h2>", f"<div class={name}>{WORDY * 2}</div>"]
    page = f"<html><body><nav><a href=/>Home</a></nav>{''.join(parts).join(around)}<footer>foot</footer></body></html>"
    assert html_text.main_text(page) == "\n\n".join(re.sub("<.*?>", "", p) for p in parts)


def test_an_article_in_parts_of_several_names_comes_out_whole():
    parts = [f"<div class=a><p>{WORDY * 6}</p></div>", "<h3>Between</h3>", f"<div class=b><p>{WORDY * 4}</p></div>"]
    assert html_text.main_text(f"<body><div>{''.join(parts)}</div></body>") == f"{WORDY * 6}\n\nBetween\n\n{WORDY * 4}"
    page = f"<div id=content><h1>Title</h1><div><p>{WORDY * 6}</p></div></div><div>outside</div>"
    assert html_text.main_text(page) == f"Title\n\n{WORDY * 6}"


def test_pages_without_an_article():
    for page in (None, "", "   ", "<html><body></body></html>", "<nav><a>Home</a></nav><footer>f</footer>", "<script>if (a<b) c()</script>"):
        assert html_text.main_text(page) == ""
    assert html_text.main_text("only a text &lt;") == "only a text <"
    assert html_text.main_text("<p>a<p>b<div hidden>c</div><p>d") == "a\n\nb\n\nd"
    assert html_text.main_text("<article>" + "<p>word, word.</p>" * 5000 + "</article>").count("word, word.") == 5000
    assert html_text.main_text("<div>" * 3000 + "deep" + "</div>" * 3000) == "deep"
    assert html_text.main_text("<article><p>cut off <b") == "cut off"


BODY = f"<h1>Title</h1><p>{WORDY * 3}</p><p>{WORDY * 2}</p><h2>Part</h2><p>{WORDY * 4}</p><ul><li>one thing<li>another</ul><p>The end.</p>"
BODY_TEXT = "\n\n".join(["Title", WORDY * 3, WORDY * 2, "Part", WORDY * 4, "one thing", "another", "The end."])
CHROME = "<nav><a href=/>Home</a> <a href=/b>Blog</a></nav>"
AFTER = f"<div class=related-posts><p>Read this too. {WORDY}</p></div><div id=comments><p>{WORDY * 9}</p></div><div class='cookie-notice'>We use cookies, see.</div><footer>foot</footer>"
WRAPPERS = (
    "site has-sidebar", "content-sidebar-wrap", "layout-no-sidebar", "with-banner", "site-wrapper sticky-footer", "page more-space", "layout-form",
    "no-comments open", "social-post", "article-page promo", "promo", "sidebar-right-layout", "widget", "page", "", "hfeed site", "menu-open", "comments-closed",
    "share", "container x search-open", "tags-wrapper",
)


@pytest.mark.parametrize("inner", ["<article>%s</article>", "<main>%s</main>", "<div>%s</div>", "<section class=entry-content>%s</section>"])
@pytest.mark.parametrize("wrapper", WRAPPERS)
def test_names_of_wrappers_do_not_lose_the_article(wrapper, inner):
    for outer in (f'<div class="{wrapper}">%s</div>', f'<form><div id="{wrapper}">%s</div></form>', f'<section class="{wrapper}"><div class="{wrapper}">%s</div></section>'):
        assert html_text.main_text(f"<html><body>{CHROME}{outer % (inner % BODY)}{AFTER}</body></html>") == BODY_TEXT
        # The rest of the page may lie in the wrapper as well.
        assert html_text.main_text(f"<html><body>{outer % (CHROME + (inner % BODY) + AFTER)}</body></html>") == BODY_TEXT


@pytest.mark.parametrize("name", ["read-more-intro", "legal", "reply", "has-menu", "social text"])
def test_names_of_paragraphs_do_not_lose_them(name):
    page = f'<body>{CHROME}<article>{BODY}<p class="{name}">{WORDY}</p></article>{AFTER}</body>'
    assert html_text.main_text(page) == f"{BODY_TEXT}\n\n{WORDY}"


def test_what_is_named_for_what_it_is_goes():
    for name in ("ad", "google-ad-slot", "newsletter-signup", "post-share", "mobile-menu", "related", "post-comments", "comment-list", "left-sidebar", "promo-box"):
        inside = f'<div class="{name}"><p>{WORDY}</p></div>'
        assert html_text.main_text(f"<body>{CHROME}<article>{BODY}{inside}</article>{AFTER}</body>") == BODY_TEXT, name
        assert html_text.main_text(f"<body>{CHROME}<div>{BODY}</div>{inside}{AFTER}</body>") == BODY_TEXT, name
    # Comments are more than the article, each in an article of its own.
    comments = "".join(f"<article class=comment><p>{WORDY * 5}</p></article>" for _ in range(20))
    assert html_text.main_text(f"<body><main>{BODY}</main><section id=comments>{comments}</section></body>") == BODY_TEXT
    assert html_text.main_text(f"<body><div class=site><div>{BODY}</div><div class=comment-area>{comments}</div></div></body>") == BODY_TEXT
    assert html_text.main_text(f"<body><article>{BODY}</article><form><label>{WORDY}</label><input></form></body>") == BODY_TEXT


def test_memory_and_time_grow_with_the_page():
    for page in ("<div class=c>" * 50_000 + "deep", "<ul><li>x" * 10_000, "<div><p>y</div>" * 20_000, "<div class='a b'>z" * 20_000):
        tracemalloc.start()
        start = time.process_time()
        text = html_text.main_text(page)
        spent, most = time.process_time() - start, tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert len(text) >= 4 and spent < 20 and most < 200 * 2**20


def test_stray_quotes_do_not_swallow_text():
    for tag in ("<p title=it's>", '<p title="x"">', "<p '>", '<p title=a"b class=c>', '<p "title=x>', "<p title = 'a>b' \">", '<p title="a>b">', "<p/title='>'>"):
        assert html_text.main_text(f"<article>{tag}First, here.</p><p>Second, there's more.</p><p class=\"z\">Third.</p></article>") == "First, here.\n\nSecond, there's more.\n\nThird.", tag
    assert html_text.main_text("<article><p>a, b.</p><div title=it's hidden>no</div><p>c's</p></article>") == "a, b.\n\nc's"


@pytest.mark.parametrize("tag", sorted(html_text.MUTE))
def test_elements_that_do_not_end_swallow_no_text(tag):
    for page in ("<article><div><%s x=1></div><p>First, here.</p><p>Second.</p></article>", "<article><%s><p>First, here.</p><%s><p>Second.</p></article>", "<article><div><p>First, here.</p><%s></div><p>Second.</p><%s><b>no</b></%s></article>", "<article><p>First, here. <%s><div><i>no</i></div></%s></p><p>Second.</p><%s></article>"):
        if tag == "select":
            page = page.replace("<div><i>no</i></div>", "<option>no<option>no")
        assert html_text.main_text(page.replace("%s", tag)) == "First, here.\n\nSecond.", page
    assert html_text.main_text(f"<article><p>One <{tag}>no</{tag}>two.</p></article>") == "One two."
    assert html_text.main_text(f"<article>{f'<div><{tag}>' * 2000}<p>deep" + "</div>" * 2000) == "deep"


BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def automaton():
    return bpe.TokenAutomaton.from_file(BYTE_BPE)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(BYTE_BPE)


@settings(max_examples=300, deadline=None)
@given(text=st.one_of(TEXTS, st.text(max_size=60), st.lists(st.sampled_from(["<|endoftext|>", "the", " ", "  ", "ing", "é", "'ll", "\n", "12", "aaa"])).map("".join)))
def test_bpe_gives_the_ids_and_text_of_the_library(automaton, library, text):
    ids = library.encode(text, add_special_tokens=False).ids
    assert automaton.encode(text) == ids
    assert automaton.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_decoded_digests_are_of_what_the_ids_spell(library):
    tokens = bpe.TokenAutomaton.from_file(BYTE_BPE)
    ids = library.encode("other", add_special_tokens=False).ids
    printed = ",".join(map(str, ids))
    tokens.known["word"] = printed, tokens.decode(ids)
    assert tokens.digests("word") == (len(ids), *(hashlib.sha256(t.encode()).hexdigest() for t in (printed, "other")))
    assert tokens.printed("some <|endoftext|>é")[1] == "some <|endoftext|>é"


def test_bpe_of_a_small_vocabulary_equals_merging_by_rank():
    rng = random.Random(1)
    for _ in range(200):
        labels, merges = {i: bytes([97 + i]) for i in range(3)}, []
        for _ in range(rng.randint(0, 9)):
            u, v = rng.choice(list(labels)), rng.choice(list(labels))
            if labels[u] + labels[v] not in labels.values():
                labels[len(labels)] = labels[u] + labels[v]
                merges.append((u, v, len(labels) - 1))
        tokens = bpe.TokenAutomaton(labels, merges)
        word = bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 14)))
        ids = [b - 97 for b in word]
        for u, v, uv in merges:
            i = 0
            while i < len(ids) - 1:
                if ids[i : i + 2] == [u, v]:
                    ids[i : i + 2] = [uv]
                i += 1
        # Merging in order of rank over the whole word, left to right, as the gadgets do.
        assert tokens.encode_word(word) == ids, (labels, merges, word)


def test_bpe_of_long_words(automaton, library):
    for text in ("a" * 3000, "é" * 2000, "ab" * 3000, " " * 2000, "\n" * 500 + "x", "=-" * 2000):
        assert automaton.encode(text) == library.encode(text, add_special_tokens=False).ids


class Watched:
    """Passes on what ends where, and notes the places."""

    def __init__(self, endings):
        self.endings, self.places, self.reads = endings, [], 0

    def iter(self, text):
        self.reads += 1
        for end, found in self.endings.iter(text):
            self.places.append(end)
            yield end, found


def test_encoding_reads_each_place_once_and_goes_back_to_none(automaton, monkeypatch):
    rng = random.Random(4)
    words = ["".join(rng.choices("etaoinshrdlu", k=rng.randint(9, 40))).encode() for _ in range(300)] + [b"a" * 500, "éü".encode() * 40]
    for word in words:
        if word in automaton.by_bytes:
            continue
        watched = Watched(automaton.endings)
        monkeypatch.setattr(automaton, "endings", watched)
        ids = automaton.encode_word(word)
        monkeypatch.undo()
        assert watched.reads == 1 and watched.places == sorted(watched.places) and set(watched.places) == set(range(len(word)))
        # The path of a word goes over the paths of its beginnings.
        at = 0
        for k, token in enumerate(ids):
            at += len(automaton.labels[token])
            assert automaton.encode_word(word[:at]) == ids[: k + 1]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.characters(max_codepoint=0x2FF), max_size=50))
def test_the_fast_split_is_the_split(text):
    assert bpe.pre_split(text) == bpe.PRE_SPLIT.findall(text) == regex.findall(public_tokenizers.PATTERN, text)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "the", " ", "  ", "▁", "\n", "é", "中", "\0", "<s>", " ", "12"])).map("".join))
def test_pieces_by_pretoken_are_those_of_the_text(text):
    counter = piece_counter()
    assert counter.n_tokens(text) == len(counter.model.encode(text))


@cache
def piece_counter():
    return token_count.PieceCounter(PIECES)


@pytest.mark.parametrize(("few", "rows_at_once", "at_once"), [(64, 200_000, 4096), (2, 3, 1), (3, 1, 2)])
def test_each_pretoken_is_counted_once(monkeypatch, few, rows_at_once, at_once):
    counter, asked = piece_counter(), []
    monkeypatch.setattr(token_count, "FEW", few)
    monkeypatch.setattr(token_count, "ROWS", rows_at_once)
    monkeypatch.setattr(token_count, "AT_ONCE", at_once)
    monkeypatch.setattr(counter, "count", lambda p: asked.extend(p) or type(counter).count(counter, p), raising=False)
    texts = ["one two three four", "five six one one", "", " two  ", "one  two", "one unheardofword   "]
    rows = [(i, p, n) for i, t in enumerate(texts) for p, n in counter.frequencies(t).items()]
    found = Counter()
    for docs, pieces in token_count.joined_counts(iter(sorted(rows, key=lambda r: r[1])), counter):
        assert len(docs) == len(pieces)
        for i, n in zip(docs, pieces):
            found[i] += n
    assert sorted(asked) == sorted({p for _, p, _ in rows})
    assert {i: n for i, n in found.items() if n} == {i: n for i, t in enumerate(texts) if (n := len(counter.model.encode(t)))}


def test_frequent_pretokens_are_named_within_a_bound(monkeypatch):
    monkeypatch.setattr(token_count, "KEPT", 50)
    monkeypatch.setattr(token_count, "NAMED", 3)
    texts = (f"hot word{i} warm{i % 4}" for i in range(2000))
    found = token_count.named(texts, piece_counter())
    assert found[0] == ("hot", 2000) and len(found) <= 3


def naive_base(text):
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    out = [(m.start(), 0, m.end(), "assign") for m in assign.finditer(text) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return [(kind, a, b) for a, _, b, kind in sorted(out)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["token", "SECRET", "api_key", "apikey", "ſecret", "toKen", "=", ": ", '"', " ", "AKIA", "ABCDEFGHIJ12", "0123456789abcdef", "deadbeef", "é", "x"])).map("".join))
def test_base_spans_are_those_of_the_patterns(text):
    assert sorted(secrets.base_spans(text), key=lambda s: (s[1], secrets.KINDS.index(s[0]))) == naive_base(text)


def tlv(tag, *parts):
    data = b"".join(parts)
    size = len(data)
    return bytes([tag]) + (bytes([size]) if size < 128 else bytes([0x82]) + size.to_bytes(2, "big")) + data


def number(n):
    return tlv(2, n.to_bytes(n.bit_length() // 8 + 1, "big"))


RSA = tlv(0x30, number(0), *[number(random.Random(i).getrandbits(512)) for i in range(8)])
PKCS8 = tlv(0x30, number(0), tlv(0x30, tlv(6, b"\x2a\x86\x48"), tlv(5)), tlv(4, RSA))
SEC1 = tlv(0x30, number(1), tlv(4, bytes(range(32))), tlv(0xA0, tlv(6, b"\x2a\x86")))


def field(data):
    return len(data).to_bytes(4, "big") + data


OPENSSH = b"openssh-key-v1\0" + field(b"none") + field(b"none") + field(b"") + (1).to_bytes(4, "big") + field(b"public") + field(b"private")


def part(value):
    return base64.urlsafe_b64encode(json.dumps(value).encode()).decode().rstrip("=")


JWT = f"{part({'alg': 'HS256', 'typ': 'JWT'})}.{part({'sub': '1'})}.{base64.urlsafe_b64encode(b'signature' * 4).decode().rstrip('=')}"


def test_keys_and_tokens_are_reported_by_their_structure():
    for data in (RSA, PKCS8, SEC1, OPENSSH):
        for run in (base64.b64encode(data).decode(), base64.urlsafe_b64encode(data).decode(), data.hex().upper()):
            text = f"see {run} there"
            assert ("key", 4, 4 + len(run)) in secrets.spans_of(text), run
    body = "\n".join(re.findall(".{1,64}", base64.b64encode(PKCS8).decode()))
    pem = f"-----BEGIN PRIVATE KEY-----\n{body}\n-----END PRIVATE KEY-----"
    assert secrets.confirmed_spans(f"ü {pem} ü") == [("key", 2, 2 + len(pem))]
    assert secrets.confirmed_spans(f"({JWT})") == [("jwt", 1, 1 + len(JWT))]


DSA = tlv(0x30, number(0), *[number(random.Random(i).getrandbits(512)) for i in range(5)])


@pytest.mark.parametrize("data", [RSA, PKCS8, SEC1, OPENSSH, DSA])
def test_keys_are_found_anywhere_in_a_run(data):
    for run in (base64.b64encode(data).decode(), base64.urlsafe_b64encode(data).decode().rstrip("=")):
        for before in ("", "\\n", "key-", "/", "M", "3", "MMA", "x" * 50 + "/"):
            for after in ("", "\\n", " end"):
                start = len(before)
                found = secrets.confirmed_spans(before + run + after)
                assert found == [("key", start, start + len(run))], (before, run, after)
        bare = run.rstrip("=")
        if data != OPENSSH:
            assert secrets.confirmed_spans(f"{bare}/{bare}") == [("key", 0, len(bare)), ("key", len(bare) + 1, 2 * len(bare) + 1)]


@pytest.mark.parametrize("dumped", ['{"alg":"HS256"}', '{ "alg" : "HS256" }', '{\n  "alg": "HS256"\n}', '{\t"alg":"RS256"}', '{\r\n"alg":"none"}'])
def test_tokens_of_headers_with_white_space(dumped):
    head = base64.urlsafe_b64encode(dumped.encode()).decode().rstrip("=")
    token = ".".join([head, *JWT.split(".")[1:]])
    assert secrets.confirmed_spans(f"new, they: {token} ewe.news.example") == [("jwt", 11, 11 + len(token))]


def lines_of(data):
    return re.findall(".{1,64}", base64.b64encode(data).decode())


@pytest.mark.parametrize(("cipher", "start", "size"), [("DES-EDE3-CBC", 8, 8), ("AES-128-CBC", 16, 16)])
def test_encrypted_pem_blocks(cipher, start, size):
    rng = random.Random(size)
    head = ["-----BEGIN RSA PRIVATE KEY-----", "Proc-Type: 4,ENCRYPTED", f"DEK-Info: {cipher},{rng.randbytes(start).hex().upper()}", ""]
    for end in ("\n", "\r\n", "\\n"):
        pem = end.join([*head, *lines_of(rng.randbytes(40 * size)), "-----END RSA PRIVATE KEY-----"])
        assert secrets.confirmed_spans(f"x {pem}") == [("key", 2, 2 + len(pem))], end
        broken = end.join([*head, *lines_of(rng.randbytes(40 * size + 1)), "-----END RSA PRIVATE KEY-----"])
        plain = end.join([head[0], *lines_of(rng.randbytes(40 * size)), "-----END RSA PRIVATE KEY-----"])
        assert secrets.confirmed_spans(broken) == secrets.confirmed_spans(plain) == []


def plain_der(data):
    """A reader of DER apart from the operator's: the values of integers and the nested rest, or an error."""
    out = []
    while data:
        tag, size, head = data[0], data[1], 2
        if size >= 128:
            head += size - 128
            size = int.from_bytes(data[2:head], "big")
            assert size >= 128 and data[2]
        body, data = data[head : head + size], data[head + size :]
        assert len(body) == size
        out.append((tag, plain_der(body) if tag & 0x20 else body))
    return out


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 2**32), st.integers(0, 12), st.binary(max_size=3), st.booleans())
def test_der_keys_are_those_that_a_plain_reader_takes(seed, n, junk, cut):
    rng = random.Random(seed)
    data = tlv(0x30, number(rng.choice([0, 0, 1, 5])), *[number(rng.getrandbits(rng.choice([8, 64, 1024]))) for _ in range(n)])
    data = data[: len(data) - rng.randint(0, 2)] + junk if cut else data
    try:
        (tag, parts), = plain_der(data)
        want = tag == 0x30 and {t for t, _ in parts} == {2} and parts[0][1] in (b"\0", b"\1") and (len(parts) >= 9 or len(parts) == 6)
    except (AssertionError, IndexError, ValueError):
        want = False
    assert secrets.is_der_key(data) == want


def test_pem_blocks_in_json_and_in_base64():
    body = re.findall(".{1,64}", base64.b64encode(PKCS8).decode())
    for end in ("\n", "\\n", "\\r\\n", "\\\\n"):
        pem = end.join(["-----BEGIN PRIVATE KEY-----", *body, "-----END PRIVATE KEY-----"])
        assert secrets.confirmed_spans(f'{{"k": "{pem}{end}"}}') == [("key", 7, 7 + len(pem))]
        whole = base64.b64encode(f"{pem}{end}".encode()).decode()
        assert secrets.confirmed_spans(f"tls.key: {whole}\n")[0][:2] == ("key", 9)
        assert secrets.spans_of(secrets.redacted(f"tls.key: {whole}\n")) == []
    certificate = "-----BEGIN CERTIFICATE-----\nAAAA\n-----END CERTIFICATE-----\n"
    both = base64.b64encode((certificate + pem.replace(end, "\n") + "\n").encode()).decode()
    assert secrets.confirmed_spans(both) == [("key", len(certificate) * 4 // 3, len(both))]
    assert secrets.confirmed_spans(base64.b64encode(certificate.encode()).decode()) == []


def test_what_only_looks_like_a_secret_is_not_reported():
    broken = RSA[:-3]
    cut = bytearray(PKCS8)
    cut[3] ^= 1
    certificate = tlv(0x30, tlv(0x30, number(5)), tlv(0x30, number(6)))
    for data in (broken, bytes(cut), certificate, b"M" * 60, OPENSSH[:-1], OPENSSH + b"x"):
        assert secrets.confirmed_spans(base64.b64encode(data).decode()) == []
        assert secrets.confirmed_spans(data.hex()) == []
    for token in ("eyJhYmMi.e30.abc", f"{part({'typ': 'JWT'})}.{part({})}.abcd", f"{part({'alg': 'HS256'})}.xx.abcd", f"{part({'alg': 'HS256'})}.{part({})}."):
        assert secrets.confirmed_spans(token) == []


def test_redaction_leaves_nothing_to_find():
    text = f'é token = "{"ab" * 20}" and {JWT} or password: hunter2hunter2 AKIA{"A" * 16}'
    clean = secrets.redacted(text)
    assert secrets.spans_of(clean) == [] and clean.count(secrets.PLACEHOLDER) == 4
    assert clean.startswith("é ") and secrets.redacted("nothing here") == "nothing here"


def test_language_vectors_bind_and_bundle():
    profiles = language.Profiles(dimensions=2048)
    grams, counts = profiles.trigrams("Ab  AB!")
    assert dict(zip(grams.tolist(), counts.tolist())) == {
        32 << 42 | 97 << 21 | 98: 2, 97 << 42 | 98 << 21 | 32: 2, 98 << 42 | 32 << 21 | 97: 1,
    }
    for word in ("abc", "cab"):
        assert len(profiles.trigrams(word)[0]) == 3
    a, b = profiles.trigram(97 << 42 | 98 << 21 | 99), profiles.trigram(98 << 42 | 97 << 21 | 99)
    assert abs(float(a.astype(int) @ b.astype(int))) / 2048 < 0.1
    bundled = profiles.bundles(["abc", "", "123 .", "xyz abc"])
    want = sum(profiles.trigram(g).astype(int) * n for g, n in zip(*map(np.ndarray.tolist, profiles.trigrams("abc"))))
    assert (bundled[0] == want).all() and not bundled[1].any() and not bundled[2].any()


def test_ranking_separates_and_cuts_at_the_quantile():
    rng = np.random.default_rng(0)
    rows = rng.normal(size=(400, len(quality.FEATURES)))
    good = rows[:, 3] - rows[:, 7] + 0.1 * rng.normal(size=400) > -1.0
    ranking = quality.fitted(rows, good)
    scores = ranking.score(rows)
    assert ((scores >= 0.3) == good).mean() > 0.95
    assert abs((scores < 0.3).mean() - (~good).mean()) < 0.02
    assert ranking.weights[3] > 0 > ranking.weights[7]
    for labels in (np.ones(400, bool), np.zeros(400, bool)):
        assert (quality.fitted(rows, labels).score(rows) == 0.5).all()
    assert (quality.fitted(rows[:0], good[:0]).score(rows) == 0.5).all()
    assert not quality.features("").any() and np.isfinite(quality.features("\n")).all()


def plain_descent(rows, good, steps=4000):
    """Bradley-Terry over all pairs of a good and a bad row by gradient descent, with the same ridge."""
    scaled = (rows - rows.mean(0)) / np.where(rows.std(0) > 1e-9, rows.std(0), 1)
    differences = (scaled[good][:, None] - scaled[~good][None]).reshape(-1, rows.shape[1])
    weights = np.zeros(rows.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-differences @ weights))
        weights -= 0.3 * (differences.T @ (p - 1) / len(differences) + quality.RIDGE * weights)
    return scaled @ weights


def test_rankings_are_those_of_plain_gradient_descent():
    rng = np.random.default_rng(3)
    rows = rng.normal(size=(90, len(quality.FEATURES)))
    good = rows[:, 3] - rows[:, 7] + rng.normal(size=90) > -0.5
    plain = plain_descent(rows, good)
    ranking = quality.fitted(rows, good, pairs=400_000)
    strengths = (rows - ranking.mean) / ranking.scale @ ranking.weights
    assert np.corrcoef(strengths, plain)[0, 1] > 0.999
    threshold = np.quantile(plain, (~good).mean(), method="midpoint")
    assert ((ranking.score(rows) >= 0.3) == (plain >= threshold)).mean() > 0.97
    fewer = quality.fitted(rows, good, pairs=50)
    assert fewer.weights.any() and not np.allclose(fewer.weights, ranking.weights)


def test_bins_of_strength_stand_for_all_pairs():
    rng = np.random.default_rng(4)
    rows = rng.normal(size=(300, len(quality.FEATURES))) ** 3
    good = rows[:, 3] - rows[:, 7] + 4 * rng.normal(size=300) > -2
    ranking = quality.fitted(rows, good)
    scaled = (rows - rows.mean(0)) / rows.std(0)
    differences = (scaled[good][:, None] - scaled[~good][None]).reshape(-1, rows.shape[1])
    p = 1 / (1 + np.exp(-differences @ ranking.weights))
    # The slope of the loss over all pairs is zero, but for the width of bins. 60,000 drawn pairs leave 0.004 or so.
    assert np.abs(differences.T @ (p - 1) / len(differences) + quality.RIDGE * ranking.weights).max() < 1e-3
