"""The ten operators against brute force, and on awkward tables: nulls, empty and long texts, ties, repeated rows, no rows, clashing columns."""

import hashlib
import itertools
import math
import random
import re
import string
import time
import uuid
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from veldspar.llm import bpe, chat, components, decontaminate, fingerprint, licences, secrets, substring, superminhash, tokenfile, toxicity
from veldspar.llm._words import Block, blocks, hash_spans, rolling, split_words

PATH = public_tokenizers.path("word_bpe_49k.json")
TOKENIZER = Tokenizer.from_file(PATH)
BPE = bpe.WordBpe(PATH)
RND = random.Random(5)
LONG = " ".join(RND.choice(["alpha", "beta", "gamma", "delta", "Épsilon"]) + str(k % 97) for k in range(30_000))
ODD = "doc_id long, text string, words string, anchor int, _id string, start int, n int"


def odd_rows(spark):
    """Nulls, empty texts, a very long text, repeated rows and ids, and columns whose names operators use inside."""
    texts = [None, "", " \n\t ", "one", "one two three", LONG, LONG, "Straße Ünïcode　word\x01 x\x00y", "same text here for all of you to see", "same text here for all of you to see"]
    ids = [0, 1, None, 3, 4, 5, 6, 7, 8, 8]
    return spark.createDataFrame([(i, t, "w", 1, "z", 2, 3) for i, t in zip(ids, texts)], ODD).repartition(3)


def empty(spark):
    return spark.createDataFrame([], ODD)


def corpus(spark, n=60, seed=3):
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    shared = [" ".join(r.choice(vocabulary) for _ in range(30)) for _ in range(3)]
    texts = []
    for k in range(n):
        words = [r.choice(vocabulary) for _ in range(r.randint(0, 90))]
        if k % 3 == 0:
            words[len(words) // 2 : len(words) // 2] = r.choice(shared).split()
        if k % 7 == 0 and texts:
            words = r.choice(texts).split()
            if words and k % 2:
                words[r.randrange(len(words))] = "edited"
        texts.append(r.choice([" ", "\n", "  "]).join(words))
    return texts, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)


# --- shared parts ------------------------------------------------------------------------------------------------------------------------
@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab \n\té　", max_size=12), max_size=8))
def test_words_are_bytes_between_white_space(texts):
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["t"])
    got = []
    for b in blocks(iter([batch]), "t", 16):
        s, e, bounds = split_words(b)
        h = hash_spans(b.data, s, e)
        words = [b.data[x:y].tobytes() for x, y in zip(s, e)]
        assert len({(w, x) for w, x in zip(words, h.tolist())}) == len(set(words)) == len(set(h.tolist()))
        got += [words[bounds[k] : bounds[k + 1]] for k in range(len(b))]
    assert got == [t.encode().split() for t in texts]


def test_rolling_hash_depends_on_order_and_words():
    x = np.arange(1, 50, dtype=np.uint64)
    for k in (1, 2, 3, 5, 20):
        r = rolling(x, k)
        assert len(r) == len(x) - k + 1 and len(set(r.tolist())) == len(r)
        assert r[3] == rolling(x[3 : 3 + k], k)[0]


@pytest.mark.parametrize("one_task", [0, 1_000_000])
def test_components(spark, tmp_path, one_task):
    r = random.Random(1)
    edges = [(r.randrange(80), r.randrange(80)) for _ in range(50)] + [(k, k + 1) for k in range(100, 140)]
    parent = list(range(200))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    got = components.connected(spark.createDataFrame(edges, "a long, b long").repartition(5), f"file://{tmp_path}/x", one_task)
    rows = {r.node: r.comp for r in got.collect()}
    assert all(c == root(n) for n, c in rows.items()) and set(rows) == {x for e in edges if e[0] != e[1] for x in e}
    assert components.connected(spark.createDataFrame([], "a long, b long"), f"file://{tmp_path}/y", one_task).count() == 0


# --- 1: token files ----------------------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("unit", ["bit", "byte"])
def test_planes_round_trip(unit, tmp_path):
    r = np.random.default_rng(0)
    for top in (1, 200, 49_408, 1 << 31):
        for n in (1, 7, 1000):
            ids = r.integers(0, top, n).astype(np.uint32)
            assert (tokenfile.from_planes(tokenfile.to_planes(ids, unit), n, unit) == ids).all()
    path = tmp_path / "f"
    w = tokenfile.Writer(path.open("wb"), unit, 64)
    docs = [r.integers(0, 50_000, n).astype(np.uint32) for n in (0, 5, 300, 64, 1)]
    for k, x in enumerate(docs):
        w.add([k], np.array([len(x)]), x)
    w.close()
    reader = tokenfile.Reader(path.open("rb"))
    assert [(d, x.tolist()) for d, _, x in reader.documents()] == [(k, x.tolist()) for k, x in enumerate(docs)]
    assert reader.tokens(100, 150).tolist() == np.concatenate(docs)[100:250].tolist()
    with pytest.raises(ValueError):
        path.write_bytes(path.read_bytes()[:-1])
        tokenfile.Reader(path.open("rb"))


def test_words_of_letters_need_no_marks():
    """Runs whose words aren't all one piece (a dotted capital I becomes two) get marks; ids and sizes are the library's in any case."""
    encoder = tokenfile.LibraryEncoder(open(PATH, encoding="utf-8").read())
    plain = ["word", "Épsilon", "ﬁn", "x" * 700, "日本", "ß"]
    for words in (plain, [*plain, "İstanbul"], [*plain, "it's", "a\x01b", "\x01", "", "<|endoftext|>", "a</w>b"], ["İ"] * 600 + plain * 200, [""], []):
        ids, n = encoder.words([w.encode() for w in words])
        want = [TOKENIZER.encode(w, add_special_tokens=False).ids for w in words]
        assert n.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]
    assert encoder.ends is not None and encoder.ends.sum() > 256


@pytest.mark.parametrize("unit", ["bit", "byte"])
def test_token_files_in_order(spark, tmp_path, unit):
    folder = f"file://{tmp_path}/t"
    tokenfile.write_tokens(odd_rows(spark), PATH, folder, unit=unit, chunk=512)
    rows = sorted(tokenfile.read_tokens(spark, folder).collect(), key=lambda r: r.start)
    src = sorted(odd_rows(spark).collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text is not None, (r.text or "").encode()))
    at = 0
    assert [r.doc_id for r in rows] == [r.doc_id for r in src]
    for r, s in zip(rows, src):
        ids = np.array([*TOKENIZER.encode(s.text or "", add_special_tokens=False).ids, 1], "<u4")
        assert (r.start, r.n_tokens, zlib.crc32(r.ids)) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    tokenfile.write_tokens(empty(spark), PATH, f"file://{tmp_path}/e")
    assert tokenfile.read_tokens(spark, f"file://{tmp_path}/e").count() == 0


# --- 2: chats ----------------------------------------------------------------------------------------------------------------------------
@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool|>", ""]), st.text(alphabet="ab\\<>[]/INSTs|é", max_size=14)), max_size=6))
def test_escape_and_spans(turns):
    turns = [chat.Turn(*t) for t in turns]
    text, spans = chat.spans(turns)
    assert text == chat.marked(turns)
    for t, s in zip(turns, spans):
        assert chat.parse_turn(text[s.start : s.end]) == (t.role, t.text) and not s.rewrites
        assert chat.unescape(text[s.text_start : s.text_end]) == t.text
        assert not any(c in chat.escape(t.text) for c in chat.CONTROL)


def _thoughts(turns):
    """Thoughts are shown before the last assistant turn only."""
    last = max((k for k, t in enumerate(turns) if t.role == "assistant"), default=-1)
    return "".join(f"[{t.role}]" + "<think>xx</think>" * (k == last) + t.text for k, t in enumerate(turns))


def _latest(turns):
    """Older turns are dropped, beyond two."""
    return "...".join([""] * (len(turns) > 2) + ["|".join(t.text for t in turns[-2:])])


def _counted(turns):
    """The number of turns comes first, and equal texts are written once."""
    return f"{len(turns)}:" + "".join(f"<{t.text}>" for k, t in enumerate(turns) if t.text not in [x.text for x in turns[:k]])


@pytest.mark.parametrize("template", [_thoughts, _latest, _counted])
def test_spans_after_rewriting_are_those_of_texts_or_none(template):
    rng = random.Random(3)
    said = [[("user", "hello"), ("assistant", "first answer"), ("user", "again"), ("assistant", "second")]]
    said += [[(rng.choice(["user", "assistant"]), "".join(rng.choice("ab:<|.x") for _ in range(rng.randint(0, 5)))) for _ in range(rng.randint(1, 7))] for _ in range(200)]
    placed = 0
    for turns in said:
        turns = [chat.Turn(*t) for t in turns]
        text, found = chat.spans(turns, template)
        assert text == template(turns)
        for k, (t, s) in enumerate(zip(turns, found)):
            assert s.text_start == s.text_end == -1 or text[s.text_start : s.text_end] == t.text
            # where the text doesn't decide the form, a turn that stands in the output is found
            if template is not _counted:
                assert (s.text_start >= 0) == (template is _thoughts or k >= len(turns) - 2)
            placed += s.text_start >= 0 and s.rewritten
    assert placed > 20
    if template is _thoughts:
        _, found = chat.spans([chat.Turn(*t) for t in said[0]], template)
        assert [s.rewritten for s in found] == [False, True, True, False] and [s.rewrites for s in found] == [False, False, False, True]


def test_rewritten_history_is_found():
    def trims(turns):
        return "".join(f"<{t.role}>" + (t.text if k == len(turns) - 1 else t.text[:1]) for k, t in enumerate(turns))

    _, spans = chat.spans([chat.Turn("a", "long"), chat.Turn("b", "text"), chat.Turn("a", "x")], trims)
    assert [s.rewrites for s in spans] == [False, True, True]
    assert spans[1].start == len("<a>l")


def test_chat_digests(spark):
    r = random.Random(2)
    rows = [(c, k, r.choice(["user", "assistant", None]), r.choice([None, "", "hi </s> \\ there", LONG[:500]])) for c in (1, 2, None) for k in range(70 if c == 1 else 5)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("segment", F.lit(1)).repartition(3)
    formatted = chat.format_chats(df, segment=8)
    got = {x.conv_id: x for x in chat.digests(formatted).collect()}
    for c in (1, 2, None):
        mine = sorted([(k, a or "", t or "") for i, k, a, t in rows if i == c])
        learnt = "".join(t for _, a, t in mine if a == "assistant")
        x = got[c]
        assert x.n_turns == len(mine)
        assert x.turns_sha256 == hashlib.sha256("".join(f"{a}\n{t}\n" for _, a, t in mine).encode()).hexdigest()
        assert (x.loss_chars, x.loss_sha256) == (len(learnt), hashlib.sha256(learnt.encode()).hexdigest())
        assert x.formatted_chars == len(chat.marked([chat.Turn(a, t) for _, a, t in mine]))
    assert chat.digests(chat.format_chats(df.limit(0))).count() == 0


def test_long_conversations_are_rendered_from_their_first_turn(spark):
    def numbers(turns):
        return "".join(f"<{k}:{t.role}>" + (t.text if k >= len(turns) - 3 else "") for k, t in enumerate(turns))

    turns = [chat.Turn(("user", "assistant")[k % 2], f"text {k}") for k in range(70)]
    df = spark.createDataFrame([(1, k, *t) for k, t in enumerate(turns)], "conv_id long, turn long, role string, text string").repartition(3)
    row = chat.format_chats(df, numbers).collect()
    text, spans = chat.spans(turns, numbers)
    assert len(row) == 1 and row[0].formatted == text == numbers(turns)
    assert [(x.start, x.end, x.text_start, x.text_end, x.rewrites, x.rewritten) for x in row[0].spans] == [tuple(s) for s in spans]
    assert all(x.rewrites for x in row[0].spans[3:]) and chat.format_chats(df).count() == 3


# --- 3: fingerprints ---------------------------------------------------------------------------------------------------------------------
def test_equal_substrings_share_names():
    r = random.Random(4)
    text = "".join(r.choice("abcdefgh ") for _ in range(4000))
    a, b = fingerprint.sketch([text, "xyz" * 5 + text[37:]])[:, None]
    assert fingerprint.likeness(a, b)[0] > 0.85
    assert fingerprint.likeness(a, fingerprint.sketch(["".join(r.choice("abcdefgh ") for _ in range(4000))]))[0] < 0.1
    assert (fingerprint.sketch(["", text, "q", "aaaa"]) == np.concatenate([fingerprint.sketch([x]) for x in ("", text, "q", "aaaa")])).all()


def test_labels_are_locally_unequal():
    s = np.array([3, 3, 3, 9, 9, 1, 2, 1, 2, 2, 7], np.uint64)
    names, doc = fingerprint.parse_round(s, np.zeros(len(s), np.int64))
    assert 1 <= len(names) <= 6 and (doc == 0).all()


@pytest.mark.parametrize("parts", [1, 4])
def test_edits_follow_the_next_document(spark, parts):
    src = odd_rows(spark)
    got = fingerprint.compare_edits(src, parts=parts).collect()
    rows = sorted(src.collect(), key=lambda r: (-(r.doc_id if r.doc_id is not None else -(1 << 63)), (r.text or "").encode()))
    want = []
    for k, r in enumerate(rows):
        t, n = r.text or "", rows[(k + 1) % len(rows)].text or ""
        edited = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
        own, other, nxt = fingerprint.sketch([t, edited, n])[:, None]
        want.append((r.doc_id, len(t), hashlib.sha256(edited.encode()).hexdigest(), fingerprint.likeness(own, other)[0], fingerprint.likeness(own, nxt)[0]))
    key = lambda x: (x[0] is None, x[0] or 0, x[1], x[2])
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256, r.near_edited, r.near_next) for r in got), key=key) == sorted(want, key=key)
    assert fingerprint.compare_edits(empty(spark)).count() == 0
    alone = fingerprint.fingerprints(src).collect()
    assert len(alone) == len(rows) and {(r.doc_id, r.fingerprint) for r in alone} == {(r.doc_id, r.fingerprint) for r in got}


# --- 4: secrets --------------------------------------------------------------------------------------------------------------------------
def base(text):
    """The base rules as they are stated."""
    out = []
    for m in re.finditer(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text, re.I | re.A):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["token", "API_key", "secret", "=", ": ", " ", "'", "AKIA", "ABCDEFGH12", "deadbeef0123", "fade", "xyz-/.", "é", "Passwd"]), max_size=14).map("".join))
def test_base_rules(text):
    assert secrets.base_spans(text)[0] == base(text)


def test_automaton_tells_formats_apart():
    labelled = secrets.examples(80)
    models = secrets.learn({k: v[:60] for k, v in labelled.items()})
    held = [s for v in labelled.values() for s in v[60:]]
    accept = lambda s: any(m.score(secrets.symbols(s)) >= least for _, m, least in models)
    assert sum(map(accept, held)) >= 0.8 * len(held)
    plain = ["thandreableintion1", "mail5.example.com", "2024-01-01-report-final", "ordinary_long_name_2", "aaaaaaaaaaaaaaaa1"]
    assert sum(map(accept, plain)) <= 1
    assert all(m.states < 200 for _, m, _ in models)


def test_secrets_on_awkward_rows(spark):
    src = odd_rows(spark).union(spark.createDataFrame([(20, 'x token = "0123456789abcdef0123456789abcdef" y', "w", 1, "z", 2, 3)], ODD))
    rows = secrets.find_secrets(src).collect()
    assert len(rows) == 11
    one = next(r for r in rows if r.doc_id == 20)
    assert [tuple(x) for x in one.base] == base('x token = "0123456789abcdef0123456789abcdef" y')
    assert all(not r.base for r in rows if r.doc_id != 20)
    cut = secrets.cut_secrets(src)
    assert cut.columns == src.columns and cut.count() == 11
    assert cut.where("doc_id = 20").first().text == 'x [SECRET]" y'
    assert cut.where("doc_id = 5").first().text == LONG and cut.where("doc_id = 0").first().text is None
    assert secrets.find_secrets(empty(spark)).count() == 0


def test_parts_of_runs_are_scored():
    labelled = secrets.examples(80)
    models = secrets.learn_kinds({k: v[:60] for k, v in labelled.items()})
    ways = {way: way.index("{") for way in ("{}", "{}.", "{}/", "AUTH={}", "https://h.example.com/v1/x/{}/get", "id_{}.")}
    for kind in ("personal-token", "secret-key"):
        for way, at in ways.items():
            hit = 0
            for secret in labelled[kind][60:]:
                text = way.format(secret)
                base_, _, candidates = secrets.base_spans(text)
                hit += any(s <= at and at + len(secret) <= e for s, _, e in secrets.all_spans(base_, candidates, models))
            assert hit >= 17, (kind, way, hit)
    secret = labelled["personal-token"][61]
    text = f"token=abcdef12,{'0123456789abcdef' * 2}_{secret}"
    base_, _, candidates = secrets.base_spans(text)
    assert any(k == 3 and text[s:e].endswith(secret) for s, k, e in secrets.all_spans(base_, candidates, models))
    for plain in ("https://www.example.com/path/to/article123/index.html", "2024-01-01-report-final", "information", "mail5.example.com"):
        assert not secrets.all_spans([], secrets.base_spans(plain)[2], models)


def test_kinds_learn_length_and_prefix():
    r, alnum = random.Random(1), string.ascii_letters + string.digits
    word = lambda chars, n: "".join(r.choice(chars) for _ in range(n))
    more = {"a": lambda: "glpat-" + word(alnum + "-_", 20), "b": lambda: "AIza" + word(alnum + "-_", 35), "c": lambda: f"xoxb-{word('0123456789', r.randint(10, 13))}-{word('0123456789', 12)}-{word(alnum, 24)}"}
    models = secrets.learn_kinds(secrets.examples() | {k: [f() for _ in range(80)] for k, f in more.items()})
    assert all(m.outlines.states > m.short for m in models if m.short == m.long)  # a state for each place
    for kind, make in more.items():
        for way in ("{}", "key {}.", "AUTH={}", "https://h.example.com/v1/{}/get"):
            at, hit = way.index("{"), 0
            for _ in range(200):
                secret = make()
                hit += any(s <= at and at + len(secret) <= e for s, _, e in secrets.all_spans([], secrets.base_spans(way.format(secret))[2], models))
            assert hit >= 180, (kind, way, hit)
    steps = ["usr", "lib", "python3.13", "site-packages", "v2", "x86_64-linux-gnu", "report_2024", "data01"]
    plain = [str(uuid.UUID(int=r.getrandbits(128))) for _ in range(500)] + ["/" + "/".join(r.choices(steps, k=r.randint(3, 8))) for _ in range(500)]
    plain += [f"20{r.randint(10, 29)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}T{r.randint(0, 23):02}-{r.randint(0, 59):02}-00Z" for _ in range(500)]
    assert sum(bool(secrets.all_spans([], secrets.base_spans(x)[2], models)) for x in plain) < 0.01 * len(plain)


def test_automaton_scores_equal_counted_frequencies():
    strings = ["ab"] * 64 + ["ac"] * 27 + ["b"] * 9
    model = secrets.Automaton(strings, alpha=2)  # a bound of nothing: only states of equal frequencies are merged
    n = lambda p: sum(s.startswith(p) for s in strings)
    for s in ("ab", "ac", "b"):
        want = sum(math.log(n(s[: k + 1]) / (n(s[:k]) + 1)) for k in range(len(s)))
        assert abs(model.total(s) - want) < 0.02


def test_base_spans_are_taken_out_of_candidates():
    text = "/".join(f"{'0123456789abcdef' * 2}/x{k}y" + "Q" * 16 for k in range(2000))
    base_, _, candidates = secrets.base_spans(text)
    assert len(base_) == 2000 and len(candidates) == 2000 and all(e <= b[0] or b[2] <= s for b, (s, e, _) in zip(base_, candidates))


# --- 5: decontamination ------------------------------------------------------------------------------------------------------------------
def test_lcs():
    r = np.random.default_rng(1)
    for _ in range(60):
        a, b = r.integers(0, 5, r.integers(1, 30)).astype(np.uint64), r.integers(0, 5, r.integers(0, 40)).astype(np.uint64)
        t = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a)):
            for j in range(len(b)):
                t[i + 1, j + 1] = t[i, j] + 1 if a[i] == b[j] else max(t[i, j + 1], t[i + 1, j])
        assert decontaminate.lcs(a, b) == t[-1, -1]


def test_leaks_are_found_and_clean_documents_left(spark):
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(3, 7)))
    items = [" ".join(word() for _ in range(r.randint(12, 60))) for _ in range(12)]
    texts = [" ".join(word() for _ in range(r.randint(0, 200))) for _ in range(200)]
    want = set()
    for k, item in enumerate(items):
        w = texts[10 * k].split()
        put = item.split()
        if k % 3 == 2:  # a paraphrase: a fifth of the words differ
            put = [x if j % 5 or j > len(put) - 6 else word() for j, x in enumerate(put)]
        at = r.randint(0, len(w))
        texts[10 * k] = " ".join([*w[:at], *put, *w[at:]]).upper() if k % 2 else "\n".join([*w[:at], *put, *w[at:]])
        want.add((10 * k, k))
    docs = spark.createDataFrame([*enumerate(texts), (None, items[0]), (900, None), (901, "")], "doc_id long, text string").withColumn("h", F.lit(1)).repartition(3)
    bench = spark.createDataFrame([*enumerate(items), (None, "x y"), (50, None), (51, "")], "item_id long, text string")
    got = {(x.doc_id, x.item_id) for x in decontaminate.find_leaks(docs, bench).collect()}
    assert got == want | {(None, 0)}
    assert {(x.doc_id, x.item_id) for x in decontaminate.find_leaks(docs, bench, items_at_once=5).collect()} == got
    kept = decontaminate.drop_leaks(docs, bench)
    assert kept.columns == docs.columns and kept.count() == docs.count() - len(want) - 1
    assert decontaminate.find_leaks(docs.limit(0), bench).count() == 0 and decontaminate.find_leaks(docs, bench.limit(0)).count() == 0


def test_single_passages_of_long_items_are_leaks(spark):
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(3, 7)))
    items = [[word() for _ in range(n)] for n in (59, 100, 200, 400)]
    texts = [[word() for _ in range(r.randint(0, 200))] for _ in range(200)]
    want = set()
    for k, item in enumerate(items):
        starts = np.unique(np.linspace(0, len(item) - 24, -(-len(item) // 24)).astype(int))
        # a whole passage, one between two passages, 50 words in a row, and a passage with two words changed
        for j, put in enumerate([item[starts[1] : starts[1] + 24], item[starts[0] + 11 : starts[0] + 35], item[5:55], [x if i not in (5, 15) else word() for i, x in enumerate(item[starts[-1] :])]]):
            d = 40 * k + 3 * j
            at = r.randint(0, len(texts[d]))
            texts[d][at:at] = put
            want.add((d, k))
        texts[40 * k + 20][3:3] = item[:10]  # a few words are no leak
    docs = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(texts)], "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)], "item_id long, text string")
    assert {(x.doc_id, x.item_id) for x in decontaminate.find_leaks(docs, bench).collect()} == want
    assert decontaminate.drop_leaks(docs, bench).count() == len(texts) - len(want)


# --- 6: toxicity -------------------------------------------------------------------------------------------------------------------------
def test_disguised_words_are_restored(spark):
    plain = ["the idiot was here and the scum stood by the loser", "a stupid clown and a moron are worthless"] * 30
    model = toxicity.language_model(spark.createDataFrame([(x,) for x in plain], "text string"))
    said = {"1d10t": "idiot", "l0$er": "loser", "stuuuupid": "stupid", "m.o.r.o.n": "moron", "sc*um": "scum", "clown***": "clown", "the": "the", "wörter,": "wörter"}
    assert {k: toxicity.restore(k, model) for k in said} == said
    block = next(blocks(iter([pa.RecordBatch.from_arrays([pa.array(["an i d i o t here"])], names=["t"])]), "t"))
    assert "idiot" in toxicity._distinct_words(block, model)[0]


def test_held_out_accuracy(spark):
    r = random.Random(6)
    clean, bad = [f"word{k}" for k in range(150)], ["idiot", "scum", "moron"]
    rows, labels = [], []
    for k in range(500):
        words = [r.choice(clean) for _ in range(30)]
        y = int(k % 4 == 0)
        if y:
            words[r.randrange(30)] = r.choice([r.choice(bad), "1d1ot", "s.c.u.m"])
        rows.append((k, " ".join(words)))
        labels.append((k, y))
    docs = spark.createDataFrame([*rows, (None, None), (900, "")], "doc_id long, text string").withColumn("score", F.lit("x"))
    lab = spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, toxic int")
    got = toxicity.score_toxicity(docs, lab).collect()
    assert len(got) == 502 and all(0 <= x.score <= 1 for x in got)
    held = [(x.score >= 0.7, x.doc_id % 4 == 0) for x in got if x.doc_id is not None and x.doc_id < 500 and zlib.crc32(str(x.doc_id).encode()) % 3 == 1]
    assert sum(a == b for a, b in held) >= 0.97 * len(held)
    kept = toxicity.keep_clean(docs, lab)
    assert kept.columns == docs.columns and kept.where("doc_id % 4 <> 0").count() >= 370 and kept.where("doc_id is null or doc_id = 900").count() == 2
    assert toxicity.score_toxicity(docs.limit(0), lab).count() == 0
    assert len({x.score for x in toxicity.score_toxicity(docs, lab.where("toxic = 0")).collect()}) == 1


def test_disguise_of_any_length_is_restored(spark):
    plain = ["you idiot go home now", "the idiot was here and the scum stood by the loser", "a stupid clown and a moron are worthless", "le crétin est arrivé hier"] * 30
    model = toxicity.language_model(spark.createDataFrame([(x,) for x in plain], "text string"))
    words = lambda t: {w for s in toxicity._distinct_words(one_block([t]), model)[0] for w in s.split(" ")}
    long = "the scum stood by the loser and the clown was here and a stupid moron stood by you idiot"
    apart, wide = " ".join(long.replace(" ", "")), "  ".join(" ".join(w) for w in long.split())
    assert len(long.replace(" ", "")) > 48
    for t in (apart, wide):
        assert {"scum", "idiot", "moron", "stupid", "loser", "clown"} <= words(t)
    assert {"you", "idiot"} <= words("y o u i d i o t") and {"you", "idiot"} <= words("y o u  i d i o t")
    assert "crétin" in words("l e  c r é t i n  e s t")
    assert toxicity.restore("st" + "u" * 60 + "pid", model) == "stupid"
    assert {"stupid", "moron", "idiot"} <= words(long.replace(" ", "-")) and {"stupid", "moron"} <= words(long.replace(" ", "."))
    for t in ("1" * 300_000, "12" * 150_000, "a" + "-" * 300_000 + "b", "a" + "!" * 300_000, "x1y2" * 20_000, "x " * 100_000):
        toxicity._distinct_words(one_block([t]), model)


# --- 7: near duplicates ------------------------------------------------------------------------------------------------------------------
def groups_of(rows, k, percent):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[a : a + k]) for a in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and (both := len(sets[a] & sets[b])) and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in sets}


@pytest.mark.parametrize(("k", "block"), [(4, None), (5, 3)])
def test_groups_equal_brute_force(spark, monkeypatch, k, block):
    if block:  # cells of few members: groups and buckets are split
        monkeypatch.setattr(superminhash, "BLOCK", block)
        monkeypatch.setattr(superminhash, "SET_BLOCK", block)
        monkeypatch.setattr(superminhash, "APART", 2)
    r = random.Random(9)
    texts, _ = corpus(spark, 50)
    root = [f"v{r.randrange(300)}" for _ in range(80)]
    for _ in range(25):  # near copies of one text, not all linked with each other
        w = list(root)
        for _ in range(r.randint(0, 3)):
            w[r.randrange(80)] = f"u{r.randrange(99)}"
        texts.append(" ".join(w))
    rows = list(enumerate([*texts, None, "", "Ä B", "Ä b"]))
    got = superminhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), shingle=k).collect()
    want = groups_of(rows, k, 80)
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in got} == want
    assert all(x.kept == (x.component_id == x.doc_id) for x in got)


def test_near_duplicates_on_awkward_rows(spark):
    got = superminhash.near_duplicates(odd_rows(spark)).collect()
    assert len(got) == 10
    assert {(x.doc_id, x.component_id, x.kept) for x in got if x.doc_id in (5, 6, 8)} == {(5, 5, True), (6, 5, False), (8, 8, True)}
    assert [(x.component_id, x.kept) for x in got if x.doc_id is None] == [(None, True)]
    assert superminhash.near_duplicates(empty(spark)).count() == 0


def test_signatures_estimate_similarity():
    r = np.random.default_rng(3)
    err = []
    for share in (0.2, 0.5, 0.8, 0.95):
        for _ in range(40):
            x = r.integers(0, 1 << 63, 300).astype(np.uint64)
            n = int(300 * 2 * share / (1 + share))
            a, b = np.unique(x), np.unique(np.concatenate([x[:n], r.integers(0, 1 << 63, 300 - n).astype(np.uint64)]))
            true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            s = superminhash.superminhash([a, b])
            err.append((s[0] == s[1]).mean() - true)
    assert abs(np.mean(err)) < 0.01 and np.std(err) < 0.04
    sets = [np.unique(r.integers(0, 50, 20).astype(np.uint64)) for _ in range(9)]
    assert (superminhash.intersections(sets) == [[len(np.intersect1d(a, b)) if len(np.intersect1d(a, b)) else 0 for b in sets] for a in sets]).all() or all(
        superminhash.intersections(sets)[i, j] == len(np.intersect1d(sets[i], sets[j])) for i in range(9) for j in range(9) if i != j
    )


# --- 8: licences -------------------------------------------------------------------------------------------------------------------------
def test_licence_rules(spark):
    s = licences.SENTENCES
    bsd = [s[k][0] for k in ("bsd-grant", "bsd-source", "bsd-binary")]
    wrapped = lambda t: re.sub(r"(.{20,30}) ", r"\1\n", t)
    texts = {
        1: "Prose.\nReleased under the MIT License.", 2: wrapped(s["mit-grant"][0] + " " + s["as-is"][0]), 3: "\n".join(bsd), 4: "\n".join([*bsd, s["bsd-endorse"][0]]), 5: "\n".join(bsd[::-1]),
        6: "All rights reserved.", 7: "All rights reserved.\nLicensed under CC BY-NC 4.0.", 8: None, 9: "", 10: "no licence at all", 11: s["gpl-grant"][0] + "\n\n" + wrapped(s["gpl-hope"][0]),
    }
    df = spark.createDataFrame([(k, v, "x") for k, v in texts.items()], "doc_id long, text string, licence string")
    got = {r.doc_id: r.licences for r in licences.scan_licences(df).collect()}
    assert got == {1: "MIT", 2: "MIT", 3: "BSD-2-Clause", 4: "BSD-3-Clause", 5: "", 6: "proprietary", 7: "CC-BY-NC-4.0", 8: "", 9: "", 10: "", 11: "GPL-3.0"}
    assert all(any(a in x for a in licences.ANCHORS) for x in (t.lower() for all_ in s.values() for t in all_))
    assert licences.scan_licences(odd_rows(spark)).count() == 10 and licences.scan_licences(empty(spark)).count() == 0
    plan = licences.scan_licences(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


MIT_FILE = """MIT License

Copyright (c) 2024 Jane Doe

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY."""
BSD_FILE = """Copyright (c) 2024, Jane Doe
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
BSD_THIRD = """
3. Neither the name of Doe Works, Inc. nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
APACHE_HEADER = """Copyright 2024 Jane Doe

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""
GPL_HEADER = """Copyright (C) 2024 Jane Doe
This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details."""


def test_published_licence_texts(spark):
    commented = lambda t, mark: "\n".join(f"{mark} {x}".rstrip() for x in t.split("\n"))
    gpl2 = GPL_HEADER.replace("software:", "software;").replace("Foundation,", "Foundation;").replace("version 3", "version 2")
    mpl = "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at https://mozilla.org/MPL/2.0/."
    want = [
        (MIT_FILE, "MIT"), (MIT_FILE.replace("\n\n", "\n"), "MIT"), (MIT_FILE.replace("\n", "\r\n"), "MIT"), (commented(MIT_FILE, " *"), "MIT"),
        (BSD_FILE, "BSD-2-Clause"), (BSD_FILE + BSD_THIRD, "BSD-3-Clause"), (re.sub(r"(?m)^(\d)\.", r"(\1)", BSD_FILE), "BSD-2-Clause"), (re.sub(r"(?m)^\d\.", "*", BSD_FILE + BSD_THIRD), "BSD-3-Clause"),
        (APACHE_HEADER, "Apache-2.0"), (commented(APACHE_HEADER, "#"), "Apache-2.0"), (GPL_HEADER, "GPL-3.0"), (commented(GPL_HEADER, "//"), "GPL-3.0"), (gpl2, "GPL-2.0"), (mpl, "MPL-2.0"),
        ("All rights reserved.\n" + mpl, "MPL-2.0"), ("Some say this is not released under the MIT License.", ""), (f"All rights reserved.\n{GPL_HEADER[:300]}", "proprietary"),
    ]
    df = spark.createDataFrame([(k, x) for k, (x, _) in enumerate(want)], "doc_id long, text string")
    got = {r.doc_id: r.licences for r in licences.scan_licences(df).collect()}
    assert [got[k] for k in range(len(want))] == [y for _, y in want]
    assert all(any(a in x.lower() for a in licences.ANCHORS) for all_ in licences.MORE_SENTENCES.values() for x in all_ if x != licences._OBTAIN)


# --- 9: BPE ------------------------------------------------------------------------------------------------------------------------------
def by_library(text):
    ids = TOKENIZER.encode(text, add_special_tokens=False).ids
    return ids, TOKENIZER.decode(ids, skip_special_tokens=False)


def one_block(texts):
    return next(blocks(iter([pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["t"])]), "t", 1 << 40))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.characters(codec="utf-8", exclude_characters="\r"), max_size=25), min_size=1, max_size=6), st.lists(st.text("abcthe'Σé", min_size=1, max_size=6), max_size=6))
def test_ids_and_texts_equal_the_library(tmp_path_factory, texts, words):
    texts = [*texts, "Hello, don't <|endoftext|>x ΑΣ é́ ｶﾞ 12½", *words]
    path = tmp_path_factory.mktemp("lex") / "l"
    bpe.save_lexicon([w.encode() for w in words if w.split() == [w]], BPE, path)
    block = one_block(texts)
    ids, off = bpe.encode_block(block, BPE, bpe.Lexicon(str(path)))
    data, ends = BPE.decode_rows(ids, off)
    for k, t in enumerate(texts):
        assert (ids[off[k] : off[k + 1]].tolist(), data[ends[k] : ends[k + 1]].tobytes().decode()) == by_library(t)


def test_automaton_is_minimal_and_complete(tmp_path):
    words = sorted({a + b + c for a in ("", "re", "un") for b in ("do", "make", "tie") for c in ("", "s", "ing")})
    raw = [w.encode() for w in words]
    parts = bpe.compile_lexicon(raw)
    assert len(parts["final"]) < 20
    bpe.save_lexicon(raw, BPE, tmp_path / "l")
    lex = bpe.Lexicon(str(tmp_path / "l"))
    block = one_block([" ".join([*words, "redoes", "d", "unmak"])])
    s, e, _ = split_words(block)
    assert lex.find(block.data, s, e - s).tolist() == [*range(len(words)), -1, -1, -1]
    for k, w in enumerate(words):
        assert lex.ids[lex.offsets[k] : lex.offsets[k + 1]].tolist() == TOKENIZER.encode(w, add_special_tokens=False).ids
    bpe.save_lexicon([], BPE, tmp_path / "e")
    assert bpe.Lexicon(str(tmp_path / "e")).find(block.data, s, e - s).max() == -1


def test_long_words_are_merged_exactly_and_soon():
    r = random.Random(3)
    words = ["".join(r.choices(string.ascii_lowercase, k=n)) for n in (511, 512, 513, 2000, 9000)] + ["a" * 3000, "the" * 400, "é" * 600, "x1y2" * 300]
    ids, n = BPE.encode_words([w.encode() for w in words])
    ends = np.cumsum(n)
    for w, a, b in zip(words, ends - n, ends):
        assert ids[a:b].tolist() == TOKENIZER.encode(w, add_special_tokens=False).ids
    word, t = "".join(r.choices(string.ascii_lowercase, k=400_000)), time.time()
    assert BPE.encode_words([word.encode()])[0].tolist() == TOKENIZER.encode(word, add_special_tokens=False).ids
    assert time.time() - t < 20


def test_encoding_of_awkward_rows(spark):
    src = odd_rows(spark)
    got = sorted(((r.doc_id, r.ids, r.decoded) for r in bpe.encode(src, PATH).collect()), key=str)
    want = sorted(((r.doc_id, *by_library(r.text or "")) for r in src.collect()), key=str)
    assert got == want
    assert bpe.encode(empty(spark), PATH).count() == 0


# --- 10: repeated windows ----------------------------------------------------------------------------------------------------------------
def cut_windows(rows, window=20):
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda x: x[0]):
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for a in range(len(w) - window + 1):
            key = tuple(w[a : a + window])
            if key in seen:
                gone[a : a + window] = [True] * window
            seen.add(key)
        out[i] = (len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest())
    return out


@pytest.mark.parametrize("window", [20, 8])
def test_windows_equal_brute_force(spark, window):
    texts, _ = corpus(spark, 70, seed=window)
    rows = list(enumerate([*texts, None, "", "x " * 100, "a b " * 40, " ".join(f"q{k % 25}" for k in range(90))]))
    got = substring.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), window=window).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == cut_windows(rows, window)


def test_windows_of_awkward_rows(spark):
    got = substring.remove_repeats(odd_rows(spark), texts=True).collect()
    assert len(got) == 10
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert by[5][0].n_removed < by[5][0].n_words and by[6][0].n_removed == by[6][0].n_words and by[6][0].kept_text == ""
    assert all(x.n_removed == 0 for x in by[8]) and by[0][0].n_words == 0
    assert substring.remove_repeats(empty(spark)).count() == 0


def test_repeated_rows_of_long_texts_are_one_document(spark):
    text = " ".join(f"t{k}" for k in range(50))
    rows = [(1, text), (1, text), (1, text + " end"), (2, text)]
    got = substring.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    removed = sorted((r.doc_id, r.n_words, r.n_removed) for r in got)
    # the two equal rows are alike; of the two texts under id 1 one keeps its words
    assert removed in ([(1, 50, 0), (1, 50, 0), (1, 51, 50), (2, 50, 50)], [(1, 50, 50), (1, 50, 50), (1, 51, 0), (2, 50, 50)])


def test_block_holds_whole_documents():
    block = one_block(["ab", "cd"])
    assert isinstance(block, Block) and block.bytes_of(1) == b"cd"


def test_decoding_equals_all_paths():
    """The Viterbi reading has the score of the best of all paths through the lattice."""
    rng = np.random.default_rng(5)
    model = np.log(rng.dirichlet(np.ones(toxicity.SIZE), (toxicity.SIZE, toxicity.SIZE))).astype(np.float32)
    draw = random.Random(6)

    def score(path):
        a = b = 0
        total = sum(cost for _, cost in path)
        for c in "".join(text for text, _ in path):
            z = 0 if c == " " else toxicity.INDEX.get(c, toxicity.SIZE - 1)
            total, a, b = total + float(model[a, b, z]), b, z
        return total + float(model[a, b, 0])

    for _ in range(60):
        if draw.random() < 0.5:
            places = toxicity.lattice("".join(draw.choice("ab1@$0.-_!7s") for _ in range(draw.randint(1, 7))))
        else:
            n = draw.randint(2, 5)
            places = toxicity.lattice_apart([draw.choice("abs1") for _ in range(n)], [draw.random() < 0.4 for _ in range(n)])
        paths = list(itertools.product(*places))
        best = max(map(score, paths))
        said = {" ".join("".join(text for text, _ in p).split()) for p in paths if score(p) >= best - 1e-6}
        assert toxicity.decode(places, model) in said


def test_scores_are_recomputed_by_hand(spark):
    """The score is the logistic of the fitted weights over the restored words that a text has; ids of many rows are fitted once."""
    rows = [(i, "you idiot" if i % 4 == 0 else "a fine day and a walk") for i in range(40)] + [(100, "you 1d1ot today")] * 30 + [(100, "you idiot again")] * 30
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(40)] + [(100, 1)], "doc_id long, toxic int")
    model, names, evidence, weights = toxicity.fit(docs, labels)
    assert "idiot" in names
    for text in ("you idiot", "a fine day", "1d1ot", "", "idiot idiot walk"):
        counts = np.zeros((1, len(names)))
        for token in text.split():
            for word in toxicity.restore(token, model).split(" "):
                for f in toxicity.features_of(word):
                    if f in names:
                        counts[0, names[f]] += 1
        z = float((toxicity._design(counts, evidence) @ weights[:-1] + weights[-1])[0])
        got = float(toxicity._probability(one_block([text]), model, names, evidence, weights)[0])
        assert got == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-6)


def test_toxicity_learns_from_all_labelled_rows(spark):
    """More rows than any sample had: evidence and weights are those of all of them."""
    draw = random.Random(12)
    rows = []
    for k in range(21_000):
        bad = draw.random() < 0.2
        rows.append((k, " ".join(draw.choice(["grubble", "snorkle", "plain", "other"] if bad else ["plain", "other", "words", "words", "words", "snorkle"]) for _ in range(3)), int(bad)))
    learnt = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 != 1]
    assert len(learnt) > 13_000
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model, names, evidence, weights = toxicity.fit(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"))
    t = sum(r[2] for r in learnt)
    has = lambda word, y: sum(word in r[1].split() for r in learnt if r[2] == y)
    for word in ("grubble", "snorkle"):
        want = np.log(has(word, 1) / t / ((has(word, 0) + 0.5) / (len(learnt) - t)))
        assert word not in names and want < np.log(2.5) or abs(evidence[names[word]] - want) < 1e-9
    assert "grubble" in names
    counts = np.array([[sum(f in toxicity.features_of(w) for w in r[1].split()) for f in names] for r in learnt], float)
    assert np.allclose(weights, toxicity.fit_logistic(toxicity._design(counts, evidence), np.array([float(r[2]) for r in learnt])), atol=1e-6)


def test_toxicity_deals_out_labelled_texts_alone(spark):
    """Where labels are too many to be broadcast, texts without one aren't shuffled."""
    draw, plain = random.Random(14), [f"{a}{b}" for a in ("moor", "fen", "hill", "lake", "wood") for b in ("side", "land", "s", "ward", "top", "path")]
    rows = [(k, " ".join(draw.choice(plain) for _ in range(300)) + " idiot" * (k % 40 == 0)) for k in range(2_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 40 == 0)) for k in range(0, 2_000, 20)], "doc_id long, toxic int")

    def shuffled() -> int:
        time.sleep(0.5)  # the store is brought up to date every 100 ms
        executors = spark.sparkContext._jsc.sc().statusStore().executorList(True)
        return sum(executors.apply(k).totalShuffleWrite() for k in range(executors.size()))

    most = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = shuffled()
        _, names, _, _ = toxicity.fit(docs, labels)
        assert "idiot" in names
        assert shuffled() - before < sum(len(t) for _, t in rows) / 5
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", most)


@pytest.mark.parametrize("kinds", [("long", "long"), ("int", "int"), ("string", "string"), ("int", "long"), ("long", "string"), ("double", "double")])
@pytest.mark.parametrize("bits", [1 << 18, 64])
def test_labelled_texts_are_those_of_a_join(spark, monkeypatch, kinds, bits):
    """Ids that share a mark, ids of other types, repeated and null ids: the rows are those of a plain join."""
    monkeypatch.setattr(toxicity, "LEAST_BITS", bits)
    monkeypatch.setattr(toxicity, "MOST_BITS", bits)
    ids = [None, -1, 0, 1 << 30, *range(5, 400), 7, 7]
    docs = spark.createDataFrame([(k, str(n).encode()) for n, k in enumerate(ids)], "_k long, _text binary").select(F.col("_k").cast(kinds[0]).alias("_k"), "_text")
    chosen = spark.createDataFrame([(k, k % 2) for k in (-1, 0, 1 << 30, 1, 2, *range(5, 400, 9), 7)], "_k long, _y int").select(F.col("_k").cast(kinds[1]).alias("_k"), "_y")
    want = docs.join(chosen, "_k").select("_k", "_y", "_text")
    got = toxicity.labelled_texts(docs, chosen, chosen.count())
    assert got.dtypes == want.dtypes
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > 40


def test_tallies_of_given_features_equal_those_of_all(spark):
    """Counting some features alone gives the numbers that counting all gives; disguised and parted words included."""
    draw = random.Random(15)
    model = toxicity.language_model(spark.createDataFrame([("you stupid idiot walked a fine day idly by the ideal",)] * 20, "text string"))
    texts = [" ".join(draw.choice(["1d1ot", "i d i o t", "Idiot!", "idiots", "stuuupid", "a", "by", "ab", "Ünder", "idly", "day.", "s.t.u.p.i.d", "x" * 9]) for _ in range(draw.randint(0, 9))) for _ in range(300)]
    batch = pa.RecordBatch.from_pydict({"_text": pa.array([*texts, None, ""], pa.string()).cast(pa.binary())})
    counted = lambda run: {f: n for b in run(iter([batch, batch])) for f, n in zip(b["feature"].to_pylist(), b["n"].to_pylist())}
    every = counted(toxicity._tally(model))
    said = [{f for word in toxicity._distinct_words(one_block([t]), model)[0] for f in toxicity.features_of(word)} for t in texts]
    assert every == Counter(f for x in said for f in x for _ in range(2)) and {"idiot", "ab", "idio~", "stupid"} <= set(every)
    for some in (sorted(every), sorted(every)[::3], ["idiot", "none such", "by"], []):
        assert counted(toxicity._tally_of(model, some)) == {f: every[f] for f in some if f in every}


def test_secrets_count_all_labelled_strings(spark):
    """Strings beyond those that the states are inferred from change constant places, lengths, counts and thresholds; without any the result is as before."""
    draw = random.Random(13)
    strings = ["key-" + "".join(draw.choice("0123456789abcdef") for _ in range(28)) for _ in range(300)] + ["kez-" + "".join(draw.choice("GHIJKL") for _ in range(40)) for _ in range(100)]
    df = spark.createDataFrame([(s,) for s in strings], "value string")
    few = [r.value for r in df.orderBy(F.xxhash64("value"), "value").collect()]
    whole, want = secrets.learn_all("k", df, 400)[0], secrets.learn_kinds({"k": few})[0]
    assert (whole.least, whole.least_outline, whole.fixed, whole.model.table) == (want.least, want.least_outline, want.fixed, want.model.table)
    got = secrets.learn_all("k", df, 24)[0]
    assert (got.short, got.long, got.prefix, got.fixed) == (32, 44, "", {0: "k", 1: "e", 3: "-"})
    # each string that isn't held ends once
    held = sum(k % 4 == 3 for k in range(24)) + df.where(F.pmod(F.xxhash64("value"), F.lit(4)) == 3).join(spark.createDataFrame([(s,) for s in few[:24]], "value string"), "value", "left_anti").count()
    assert sum(ends for ends, _ in got.model.seen) == sum(ends for ends, _ in got.outlines.seen) == 400 - held
    assert secrets.learn_all("k", df.limit(19)) == []
