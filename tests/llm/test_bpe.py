import hashlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from plumbline.llm.bpe import START, TOKENIZER, TokenAutomaton, automaton, byte_letters, encode, encode_digests

PATH = public_tokenizers.path(TOKENIZER)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def agree(library, text):
    own = np.frombuffer(automaton(PATH).encode(text), "<u4").tolist()
    assert own == library.encode(text, add_special_tokens=False).ids, text
    assert automaton(PATH).decode(automaton(PATH).encode(text)) == library.decode(own, skip_special_tokens=False)


@settings(max_examples=300, deadline=None)
@given(st.text())
def test_any_text(text):
    agree(Tokenizer.from_file(PATH) if not hasattr(test_any_text, "lib") else test_any_text.lib, text)


test_any_text.lib = Tokenizer.from_file(PATH)


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet="aehinorstEL 's\n<|>", max_size=40))
def test_dense_merges(text):
    agree(test_any_text.lib, text)


def test_shapes(library):
    for text in ["", " ", "   x", "a" * 5000, "ab" * 3000, "<|endoftext|>", "x<|endoftext|> y<|endoftext|>", "It's we'll\r\n\t é漢字́ ½²", "\x00\xa0  z", "!" * 700]:
        agree(library, text)


def built(merges):
    """The automaton with all arcs written out: label of each state, and its row of arcs by label."""
    label = {START: None} | {s: t for s, t in enumerate(sorted({x for m in merges for x in m[0] + m[1]}))}
    rows = {s: {t: q for q, t in label.items() if q != START} for s in label}
    for a, b in merges:
        for p in [s for s, t in label.items() if t == a]:
            if (q := rows[p].pop(b, None)) is not None:
                new = len(label) - 1
                label[new], rows[new] = a + b, dict(rows[q]) | ({b: q} if p == q else {})
                for row in rows.values():
                    if row.get(a) == p:
                        row[a + b] = new
    return label, rows


def merged(text, merges):
    """Plain merging: the pairs of the lowest rank first, from left to right."""
    parts = list(text)
    for a, b in merges:
        out = []
        for x in parts:
            if out and out[-1] == a and x == b:
                out[-1] = (a, b)
            else:
                out.append(x)
        parts = [a + b if x == (a, b) else x for x in out]
    return parts


@st.composite
def merge_lists(draw):
    known, out = ["a", "b", "c"], []
    for _ in range(draw(st.integers(1, 8))):
        a, b = draw(st.sampled_from(known)), draw(st.sampled_from(known))
        if a + b not in known and len(a + b) <= 12:
            known.append(a + b)
            out.append((a, b))
    return out


@settings(max_examples=300, deadline=None)
@given(merge_lists(), st.lists(st.text(alphabet="abc", min_size=1, max_size=24), max_size=6))
def test_gadgets_and_plain_merging(merges, words):
    tokens = ["a", "b", "c", *[a + b for a, b in merges]]
    spec = {"model": {"vocab": {t: i for i, t in enumerate(tokens)}, "merges": [list(m) for m in merges]}}
    own = TokenAutomaton(spec)
    label, rows = built(merges) if {"a", "b", "c"} <= {x for m in merges for x in m[0] + m[1]} else (None, None)
    if label:
        arcs = {(label[s], t) for s, row in rows.items() for t in row}
        states = own.states
        names = {START: None} | {s: tokens[t] for s, t in enumerate(states.label)}
        assert arcs == {(names[s], names[q]) for s in names for q in names if q != START and states.has(s, q)}
    for w in words:
        assert [tokens[i] for i in own.path(w.encode())] == merged(w, merges)


def test_one_transition_a_byte(library):
    """The machine over bytes is deterministic: its table has one entry for each (state, byte), and forgetting it changes nothing."""
    own = automaton(PATH)
    before = own.path(b" unbelievably")
    kept, own.transitions = own.transitions, 0
    assert own.path(b" unbelievably") == before and len(own.table) == len(" unbelievably")
    own.transitions = kept
    assert len(byte_letters()) == 256


def test_frame(spark, library):
    rows = [(1, "The thing", "en", 0), (2, None, None, None), (3, "", "x", 1), (4, "The thing", None, 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens int")
    out = {r.doc_id: r for r in encode_digests(df).collect()}
    ids = library.encode("The thing", add_special_tokens=False).ids
    assert out[1].n_tokens == len(ids) and out[1].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    assert out[2].n_tokens == out[3].n_tokens == 0 and out[2].decoded_sha256 == hashlib.sha256(b"").hexdigest()
    assert out[4].ids_sha256 == out[1].ids_sha256
    assert {r.doc_id: r.decoded for r in encode(df).collect()} == {1: "The thing", 2: "", 3: "", 4: "The thing"}
    assert encode(df, PATH).where("doc_id = 1").first().ids == ids
    assert encode_digests(df.limit(0)).count() == 0
    odd = spark.createDataFrame([(None, "The thing", 0), (4, "The thing", 0), (4, "The thing", 0)], "doc_id long, text string, decoded_sha256 int")
    assert [r.ids_sha256 for r in encode_digests(odd).collect()] == [out[1].ids_sha256] * 3


def test_arcs_are_asked_for_once(library, monkeypatch):
    """What the automaton has said about an arc is kept when pieces and transitions are forgotten."""
    own = TokenAutomaton({"model": {"vocab": {t: i for i, t in enumerate(["a", "b", "c", "ab", "bc", "abc"])}, "merges": [["a", "b"], ["b", "c"], ["ab", "c"]]}})
    words = ["abcbcab", "bcabcc", "cabbc"]
    want = [own[w] for w in words]
    monkeypatch.setattr(own.states, "has", lambda *_: pytest.fail("asked again"))
    own.clear()
    own._restart()
    assert [own[w] for w in words] == want
