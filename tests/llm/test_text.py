"""Encoding, leaks and subjects."""

import base64
import random
import sys

import numpy as np
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from spandrel.llm import encode as C
from spandrel.llm import leaks as L
from spandrel.llm import subjects as S

VOCABULARY = f"{C.TOKENIZERS}/byte_bpe_50k.tiktoken"


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list(" \n\t\r\x0b\x85\xa0\u2003\u3000\x1c'sdlab12.,é漢😀~_<|>")), max_size=40))
def test_encoding_equals_the_plain_tokenizer(text):
    e = C.encoder(VOCABULARY)
    assert e.encode(text) == e.base.encode_ordinary(text)
    assert e.base.decode(e.encode(text)) == text
    assert "".join(e.cut(text)) == text


def test_cuts_are_certain():
    with open(VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    inside = C.token_pairs(ranks)
    for left, right in [("a", " "), (".", "\n"), ("9", "\t")]:
        assert not inside[ord(left), ord(right)]
    e = C.Encoder(ranks)
    assert e.cut("ab  cd\n\nef\u00a0 g") == ["ab", "  cd", "\n\nef", "\u00a0 g"]
    assert len(e.cut("foo.bar(baz)foo.bar(baz)")) > 4 and len(e.cut("漢字仮名交じり文" * 3)) > 6  # not just at white space
    joined = dict(ranks)
    joined[b"b "] = len(joined)
    assert C.Encoder(joined).cut("ab cd ef") == ["ab cd", " ef"]


@settings(max_examples=600, deadline=None)
@given(st.text(max_size=60), st.sampled_from(["!'s a", "\t\tx", "1's", "é'll", "''t", " \u3000x", "\x1f'd", "a\u0301'm", "minified(function(){return[1]})", "漢字'sかな"]), st.text(max_size=20))
def test_any_text_is_encoded_as_by_the_plain_tokenizer(before, odd, after):
    e = C.encoder(VOCABULARY)
    text = before + odd + after
    assert e.encode(text) == e.base.encode_ordinary(text) and "".join(e.cut(text)) == text


def test_encoding_a_table(spark):
    texts = [None, "", "   ", "plain text", "<|endoftext|>", "x" * 50_000, "ab " * 30_000, "\ud83d\ude00 ".encode("utf-16", "surrogatepass").decode("utf-16")]
    docs = spark.createDataFrame([(i, t, 7, [1]) for i, t in enumerate([*texts, "plain text"])], "doc_id long, text string, n int, ids array<int>")
    plain = tiktoken.Encoding("p", pat_str=C.PATTERN, mergeable_ranks=C.encoder(VOCABULARY).base._mergeable_ranks, special_tokens={})
    got = {r.doc_id: r.ids for r in C.encode_corpus(docs).collect()}
    assert got == {i: plain.encode_ordinary(t or "") for i, t in enumerate([*texts, "plain text"])}
    assert C.encode_corpus(docs.limit(0)).count() == 0


WORDS = [f"{a}{b}" for a in ("tram", "violin", "ledger", "reactor", "syllabus", "verdict", "puck", "genome", "mutex", "pallet") for b in ("", "s", "ing", "ed", "er", "hood", "ful", "ness", "like", "ward")]


def passage(rng, n):
    return [rng.choice(WORDS) for _ in range(n)]


def test_leaks_are_found_through_noise(spark):
    rng = random.Random(8)
    shared = passage(rng, 40)
    items = {f"i{k}": passage(rng, 90) for k in range(8)}
    for k in ("i0", "i1", "i2"):
        items[k] = items[k][:50] + shared + items[k][50:]
    docs, want = [], set()

    def add(words, item=None):
        docs.append((len(docs), words if isinstance(words, str) else " ".join(words)))
        if item:
            want.add((len(docs) - 1, item))

    fill = lambda n: passage(rng, n)
    add(fill(60) + items["i3"][10:45] + fill(60), "i3")
    few = list(items["i4"][5:55])
    few[9], few[22], few[37] = "other", "words", "here"
    add(fill(30) + few + fill(10), "i4")
    add("\n".join(f"# {' '.join(items['i5'][i:i + 6]).upper()}," for i in range(0, 60, 6)), "i5")
    add("\n".join(f"[12:{i:02}] bot: {' '.join(items['i6'][i:i + 7])}." for i in range(7, 70, 7)), "i6")
    add('{"t": "' + "\\n".join(" ".join(items["i7"][i:i + 8]) for i in range(0, 64, 8)) + '"}', "i7")
    add(fill(40) + items["i3"][20:35] + fill(40))  # a short quotation
    add(fill(20) + shared + fill(20))  # shared by several items
    add(fill(3000) + items["i0"][:45] + fill(3000), "i0")  # a long text
    add(fill(500))
    docs += [(100, None), (101, ""), (102, " \n")]
    ds = spark.createDataFrame([(*d, "clash") for d in [*docs, docs[0]]], "doc_id long, text string, instance_id string")
    its = spark.createDataFrame([(k, " ".join(v), None) for k, v in items.items()] + [("none", None, None), ("i3", " ".join(items["i3"]), None)], "instance_id string, problem_statement string, patch string")
    assert {(r.doc_id, r.instance_id) for r in L.leaked(ds, its).collect()} == want
    assert L.leaked(ds.limit(0), its).count() == 0 and L.leaked(ds, its.limit(0)).count() == 0


def leaks_of(items, docs):
    return {(d, n) for d, n in L.Searcher(L.build_index([(k, [" ".join(v), None]) for k, v in items.items()])).search([" ".join(d) for d in docs])}


def test_leaks_at_the_stated_length():
    items = {f"i{k}": [f"word{k}x{i}" for i in range(60)] for k in range(3)}
    out = [f"filler{i}" for i in range(40)]
    docs, want = [], set()
    for n in (23, 24, 25, 26, 27, 28):
        docs.append(out + items["i1"][10 : 10 + n] + out)
        if n >= 25:
            want.add((len(docs) - 1, "i1"))
    for places, n in (((5, 10, 15, 20), 25), ((8, 9, 15, 17), 26), ((4, 8, 12, 16, 20), 25)):
        few = list(items["i2"][7 : 7 + n])
        for p in places:
            few[p] = "changed"
        docs.append(out + few + out)
        if len(places) <= L.EDITS:
            want.add((len(docs) - 1, "i2"))
    gap = items["i0"][3:12] + items["i0"][14:20] + ["one", "more"] + items["i0"][20:28]  # two missing, two added
    docs.append(out + gap + out)
    want.add((len(docs) - 1, "i0"))
    docs.append(out + items["i0"][10:31] + ["a", "b", "c", "d", items["i0"][35]] + out)  # 21 words and a chance word
    assert leaks_of(items, docs) == want


def test_leaks_are_told_from_the_same_phrasing():
    def say(*own):
        a, b, c, d, e = own
        return f"please check {a} again because the nightly import of every {b} has stopped and then move {c} next to the other parts before you restart {d} with all of the old settings for {e}".split()

    items = {f"i{k}": [f"intro{k}"] * 3 + say(*(f"own{k}{x}" for x in "abcde")) + [f"outro{k}"] * 3 for k in range(6)}
    near = say("own1a", "blue", "green", "grey", "own1e")
    leak = say("own2a", "own2b", "own2c", "grey", "own2e")
    ix = L.build_index([(k, [" ".join(v)]) for k, v in items.items()])
    assert (~ix.own[0]).sum() > 20
    free = [True] * len(items["i1"])
    held = lambda doc, k: any(L._held(doc, items[f"i{k}"], ix.own[k].tolist(), free, j, -3 - L.BAND // 2) for j in range(12))
    assert not held(near, 1)
    assert held(leak, 2)


def edited(rng, words, n, style):
    """``words`` with ``n`` edits inside, none at either end."""
    out = list(words)
    for at in sorted(rng.sample(range(3, len(out) - 3), n), reverse=True):
        kind = style or rng.choice("rda")
        out[at : at + (kind != "a")] = [] if kind == "d" else [f"zz{rng.randrange(9)}"]
    return out


@pytest.mark.parametrize("letters", [1, 2, 3, 6, 14])
@pytest.mark.parametrize("style", ["r", "d", "a", None])
def test_no_leak_is_lost_whatever_the_words_are(letters, style):
    rng = random.Random(letters)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxy") for _ in range(rng.randint(1, letters)))
    items = {f"i{k}": [word() for _ in range(70)] for k in range(6)}
    docs, want = [], set()
    for k in range(6):
        for n, edits, hit in ((25, 0, True), (26, 0, True), (27, 0, True), (29, 4, True), (25, 4, True), (24, 0, False), (22, 0, False)):
            a = rng.randrange(0, 70 - n)
            own = edited(rng, items[f"i{k}"][a : a + n], edits, style)
            docs.append(["q1", "q2", "q3"] * 9 + own + ["q4", "q5"] * 11)
            if hit and edits <= 4:
                want.add((len(docs) - 1, f"i{k}"))
    got = leaks_of(items, docs)
    assert not want - got  # two letters may stretch a run by chance, so more may be found
    if letters > 2:
        assert got == want


def brute(items, docs):
    """Every span of every item against every place of every document."""
    ix = L.build_index([(k, [" ".join(v), None]) for k, v in items.items()])
    out = set()
    for t, name in enumerate(ix.items):
        own, free = ix.own[t].tolist(), (~ix.shared[t]).tolist()
        for d, doc in enumerate(docs):
            if any(L._held(doc, ix.words[t], own, free, j, low) for j in range(len(ix.words[t])) for low in range(-len(ix.words[t]) - L.BAND, len(doc), L.BAND // 2)):
                out.add((d, name))
    return out


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10**9))
def test_filters_lose_nothing_against_brute_force(seed):
    rng = random.Random(seed)
    vocabulary = [f"{rng.choice('abcdef')}{rng.choice(['', 'x', 'yyyy', 'zzzzzzzzz'])}{i}" for i in range(rng.choice([12, 60]))]
    phrase = [rng.choice(vocabulary) for _ in range(9)]
    items = {f"i{k}": [w for _ in range(4) for w in (*[rng.choice(vocabulary) for _ in range(rng.randint(4, 12))], *(phrase if rng.random() < 0.5 else []))] for k in range(5)}
    docs = []
    for _ in range(6):
        own = items[f"i{rng.randrange(5)}"]
        a, n = rng.randrange(len(own)), rng.randint(20, 34)
        part = own[a : a + n]
        docs.append([rng.choice(vocabulary) for _ in range(8)] + (edited(rng, part, rng.randint(0, 5), None) if len(part) > 12 else part) + [rng.choice(vocabulary) for _ in range(8)])
    assert leaks_of(items, docs) == brute(items, docs)


def test_near_misses_are_told_together():
    item = [f"longerword{i}x" if i % 2 else f"s{i}" for i in range(60)]
    near = ["zz" if i % 4 == 0 else w for i, w in enumerate(item)]  # keeps the q-grams that 4 edits may leave, but has more edits
    ix = L.build_index([("a", [" ".join(item)])])

    def calls(n):
        texts, seen, before = [" ".join((near + ["filler"] * 30) * n), " ".join(item)], [], sys.getprofile()
        searcher = L.Searcher(ix)
        sys.setprofile(lambda frame, event, arg: seen.append(event))
        try:
            got = searcher.search(texts)
        finally:
            sys.setprofile(before)
        assert got == [(1, "a")]
        return len(seen)

    assert calls(200) < calls(2) + 200


def test_leaks_in_scripts_without_spaces():
    rng = random.Random(4)
    han = lambda n: "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(n))
    items = {"a": [han(80)], "b": [han(80)]}
    docs = [han(50) + items["a"][0][10:40] + han(50), han(50) + items["b"][0][:24] + han(50), items["b"][0]]
    assert leaks_of(items, [[d] for d in docs]) == {(0, "a"), (2, "b")}


def test_items_in_parts_are_searched_alike(spark):
    rng = random.Random(12)
    shared = passage(rng, 40)
    items = {f"i{k}": passage(rng, 30) + (shared if k % 2 else []) + passage(rng, 40) for k in range(12)}
    docs = [passage(rng, 20) + items[f"i{k}"][2:31] + passage(rng, 20) for k in range(12)] + [passage(rng, 9) + shared + passage(rng, 9)]
    ds = spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], "doc_id long, text string")
    its = spark.createDataFrame([(k, " ".join(v), None) for k, v in items.items()], "instance_id string, problem_statement string, patch string")
    rows = lambda df: sorted(map(tuple, df.collect()))
    whole = rows(L.leaked(ds, its))
    assert len(whole) == 12 and rows(L.leaked(ds, its, index_bytes=1500)) == whole


def test_canonical_text():
    assert L.canonical("> Fe\u00adE-Fi\\n\"Fo\"\n  Fum!").split() == ["fee", "fi", "fo", "fum"]
    assert L.canonical("Größe ＡＢＣ").split() == ["größe", "abc"]


def corpus(rng, n):
    areas = {"arts": "canvas sonata violin fresco orchestra mural easel libretto".split(), "energy": "turbine reactor voltage busbar boiler uranium rotor outage".split(), "law": "statute verdict plaintiff bailiff docket clause warrant counsel".split(), "sport": "goalkeeper striker referee league fixture puck scrum hurdle".split()}
    common = "row value handler option filter late early after before keeps moves returns branch message label".split()
    rows, truth = [], {}
    for i in range(n):
        own = rng.sample(sorted(areas), rng.choice([0, 1, 1, 1, 2]))
        sentences = []
        for s in range(10):
            area = own[s % len(own)] if own else None
            words = [rng.choice(common) for _ in range(6)] + [rng.choice(areas[area]) for _ in range(3) if area]
            rng.shuffle(words)
            sentences.append(" ".join(words) + ".")
        if own and rng.random() < 0.3:  # a sentence in passing
            other = rng.choice([a for a in areas if a not in own])
            sentences[-1] = f"the {rng.choice(areas[other])} keeps a {rng.choice(areas[other])}."
        rows.append((i, " ".join(sentences)))
        truth[i] = set(own)
    return rows, truth, {a: f"Projects about {', '.join(w[:4])} and {w[4]}." for a, w in areas.items()}


def test_wide_characters_of_one_text_leave_the_others_alone(monkeypatch):
    span = [f"word{i}x" for i in range(30)]
    ix = L.build_index([("a", [" ".join(span)]), ("b", ["Größe " + " ".join(f"ｗｉｄｅ{i}" for i in range(30))])])
    texts = ["plain (text), nothing else\n" * 50, None, "", "1. Say:\t" + "\n".join(span).upper(), "x\x00y " + " - ".join(span[:26]), "GRÖSSE gro\u00adße, " + " ".join(f"wide{i}" for i in range(30))]
    read = []
    real = L.unicodedata.normalize
    monkeypatch.setattr(L.unicodedata, "normalize", lambda form, text: read.append(text) or real(form, text))
    assert sorted(L.Searcher(ix).search(texts)) == [(3, "a"), (4, "a"), (5, "b")]
    assert read == texts[-1:]


def test_subjects_of_held_out_documents(spark):
    rng = random.Random(9)
    rows, truth, described = corpus(rng, 1500)
    docs = spark.createDataFrame([(*r, "clash") for r in rows] + [(9000, None, "x"), (9001, "", "x"), (9002, "  \n", "x")], "doc_id long, text string, subject string")
    subs = spark.createDataFrame(list(described.items()), "subject string, description string")
    labels = spark.createDataFrame([(i, rng.choice([s.upper(), s + " "])) for i in range(100) for s in truth[i]] + [(1, None), (2, "nonsense"), (None, "law")], "doc_id long, subject string")
    got = {i: set() for i in truth}
    for r in S.main_subjects(docs, subs, labels).collect():
        got[r.doc_id].add(r.subject)
    held = [i for i in truth if i >= 100]
    assert np.mean([got[i] == truth[i] for i in held]) > 0.93
    assert S.main_subjects(docs.limit(0), subs, labels).count() == 0 and S.main_subjects(docs, subs.limit(0), labels).count() == 0


def test_terms():
    assert S.terms("getAxisLimits_batches") == ["get", "axis" if S.stem("axis") == "axis" else S.stem("axis"), "limit", S.stem("batches")]
    reader = S.Reader()
    ids, sizes, bag = reader.read("One two. Two!\n\nthree")
    assert sizes.reshape(-1, 2)[:, 0].tolist() == [2, 1, 1] and bag[:, 1].sum() == len(ids) == 4
