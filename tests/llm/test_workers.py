"""What Python workers keep: bounded, and for one task."""

import random

import public_tokenizers
import pyarrow as pa

from paylens.llm import bpe, common, near_dedup


def test_recent_values_are_right_and_bounded():
    made = []
    kept = common.Recent(lambda k: made.append(k) or k * 2, 10, keep=lambda k: k < 1000)
    rng = random.Random(1)
    for _ in range(5000):
        k = rng.choice([rng.randint(0, 40), 2000])
        assert kept[k] == 2 * k
        assert len(kept) <= 5 and len(kept.older) <= 5 and 2000 not in kept
    made.clear()
    assert [kept[7], kept[7], kept[7]] == [14, 14, 14] and len(made) <= 1
    kept.forget()
    assert not kept and not kept.older


def test_slices_hold_all_rows_and_stores_end_with_the_task():
    batches = [pa.RecordBatch.from_pydict({"x": list(range(n))}) for n in (0, 3, 2000)]
    slices = common.sliced(iter(batches))
    near_dedup._HASHES.forget()  # other tests of this process may have filled it
    assert near_dedup._HASHES[b"word"] and len(near_dedup._HASHES) == 1
    bpe._AUTOMATA["path"] = None
    found = [b.column(0).to_pylist() for b in slices]
    assert [x for b in found for x in b] == [*range(3), *range(2000)]
    assert max(map(len, found)) <= common.SLICE
    assert not near_dedup._HASHES and not bpe._AUTOMATA


def test_arcs_stay_within_their_bound(monkeypatch):
    automaton = bpe.TokenAutomaton.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    words = ["".join(random.Random(i).choices("etaoinshrdlu", k=12)).encode() for i in range(300)]
    free = [automaton.encode_word(w) for w in words]
    monkeypatch.setattr(bpe, "ARCS", 50)
    automaton.known_arcs.clear()
    assert [automaton.encode_word(w) for w in words] == free
    assert 0 < len(automaton.known_arcs) <= 50


def test_arcs_lead_from_state_to_state_and_are_worked_out_once(monkeypatch):
    automaton = bpe.TokenAutomaton.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    words = ["".join(random.Random(i).choices("etaoinshrdlu", k=12)).encode() for i in range(300)]
    ids = [automaton.encode_word(w) for w in words]
    state = automaton.state(bpe.START)
    for token in ids[0]:
        state = state[token]
        assert state is automaton.state(token) and state.size == len(automaton.labels[token])
    monkeypatch.setattr(automaton, "_lost", lambda *_: 1 / 0)
    assert [automaton.encode_word(w) for w in words] == ids


def test_a_round_trip_keeps_its_words_once():
    automaton = bpe.worker_automaton(public_tokenizers.path("byte_bpe_50k.json"), bpe.ROUND_TRIP_KEPT)
    try:
        assert 2 * automaton.known.half == bpe.ROUND_TRIP_KEPT > bpe.KEPT
        word = "".join(["hou", "sebo", "at"])
        assert automaton.printed(word)[1] == word and automaton.known[word][1] is word
    finally:
        bpe._AUTOMATA.clear()
