from __future__ import annotations

import random
import re
import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from moodframe.llm import secrets as S
from moodframe.llm.common import documents


def test_features_by_hand():
    transitions = np.full((256, 256), -8.0)
    text = 'token = "0123456789abcdef01" next'
    start = text.index("0123")
    got = dict(zip(S.FEATURES, S.features(text, start, start + 18, "a/test/x", transitions, frozenset({b"next"}))))
    assert got["log_length"] == np.log(18) and got["digits"] == 12 / 18 and got["lowers"] == 6 / 18
    assert got["is_hex"] == got["assigned"] == got["quoted"] == got["name_before"] == got["example_path"] == 1
    assert got["path_depth"] == 2 and got["longest_class_run"] == 10 and got["class_changes"] == 2 / 18
    assert got["transitions"] == got["worst_transition"] == -8 and got["words_near_in_dictionary"] == 0.5
    assert S.covered("abcdefgh12", frozenset({b"abcd", b"efgh"})) == 0.8


def test_dictionary_holds_every_common_word(spark):
    """More words than a fixed list holds, each in as many documents; the
    candidates' features are those of the whole dictionary."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = ["q" + "".join(letters[k // 26 ** p % 26] for p in range(3, -1, -1)) for k in range(24_000)]
    rows = [(k, " ".join(words), "p") for k in range(S.MIN_WORD_DOCS)]
    rows += [(10, "rareword " * 50, "p"), (11, f"{words[-1]} rareword key 12-{words[-1]}-{words[-2]}-34 end", "p")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    transitions, dictionary = S.corpus_statistics(docs, "text")
    assert {bytes(r.word).decode() for r in dictionary.collect()} == set(words)
    got = [r for r in S.with_dictionary(S.find_candidates(docs, transitions, "doc_id", "text", "source"), dictionary).collect()]
    assert [(r.doc_id, r.features[S.INSIDE], r.features[S.NEAR]) for r in got] == [(11, 10 / 17, 1 / 2)]
    text = rows[-1][1]
    assert got[0].features == S.features(text, got[0].start, got[0].end, "p", transitions, frozenset(w.encode() for w in words))


def test_candidates_and_decisions():
    text = "x" * 16 + " 1234567890123456 aB" + "c" * 14 + " A" + "b" * 20 + " key: 9f86d081884c7d659a2feaa0c55ad015 " + "Q" * 20
    spans = list(S.candidates(text))
    assert [text[a:b][:4] for a, b in spans] == ["1234", "aBcc", "9f86"]
    assert S.decided(text, *spans[0]) == 0
    secret = 'api_key = "9f86d081884c7d659a2feaa0c55ad015"'
    assert S.decided(secret, 11, 43) == 1 and S.decided(secret.replace("api_key = ", "commit was "), 12, 44) == -1
    for long in ("a" * 300_000, "a1" * 150_000, "a " * 100_000):
        list(S.candidates(long))


def brute_words(run, near, dictionary):
    asked = {run.lower()[a:a + n] for n in range(S.MIN_WORD, S.LONGEST_INSIDE + 1) for a in range(len(run) - n + 1)}
    return {w for w in asked | set(near) if w in dictionary}


def test_asked_words_miss_nothing_of_the_dictionary(spark, monkeypatch):
    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("abcz") for _ in range(n))
    dictionary = {word(rng.randrange(4, 24)) for _ in range(400)} | {"zzzz", "a" * 20, "a" * 21}
    table = S.word_beginnings(spark.createDataFrame([(w.encode(),) for w in dictionary], "word binary"))
    runs = ["".join(rng.choice(["1", "-", "É", "ß", word(3).upper(), *dictionary]) for _ in range(20)) for _ in range(60)]
    runs += ["", "abc", "zzzz", "ZZZZ", "a" * 50, "1" * 30, word(700)]
    for block in (S.BLOCK, 64, 7, 1):
        monkeypatch.setattr(S, "BLOCK", block)
        for run in runs:
            near = [word(5), "a" * 21]
            got = {w.decode() for w in S.asked_words(run, near, table)} & dictionary
            assert got == brute_words(run, near, dictionary), (block, run)


def brute_features(run, transitions):
    kinds = ["digit" if c.isdigit() else "upper" if c.isupper() else "lower" if c.islower() else "sign" for c in run]
    stretch, longest, changes = 0, 0, 0
    for k, kind in enumerate(kinds):
        stretch = stretch + 1 if k and kinds[k - 1] == kind else 1
        longest, changes = max(longest, stretch), changes + (k > 0 and kinds[k - 1] != kind)
    data = run.encode()
    steps = [transitions[a][b] for a, b in zip(data, data[1:])] or [0.0]
    shares = [sum(c == x for c in run) / len(run) for x in set(run)]
    return {**{f"{k}s" if k != "sign" else "symbols": kinds.count(k) / len(run) for k in ("digit", "upper", "lower", "sign")},
            "longest_class_run": longest, "class_changes": changes / len(run), "transitions": sum(steps) / len(steps),
            "worst_transition": min(steps), "entropy": -sum(p * np.log2(p) for p in shares), "distinct": len(shares) / len(run)}


def test_features_against_brute_force(monkeypatch):
    rng = random.Random(9)
    transitions = -np.random.default_rng(1).random((256, 256))
    for block in (S.BLOCK, 5, 1):
        monkeypatch.setattr(S, "BLOCK", block)
        for _ in range(100):
            run = "".join(rng.choice("aBc9É٣ß-/_=\U0001f600") for _ in range(rng.randrange(1, 40)))
            got = dict(zip(S.FEATURES, S.features(f"x {run} y", 2, 2 + len(run), "p", transitions, frozenset())))
            for name, want in brute_features(run, transitions).items():
                assert abs(got[name] - want) < 1e-9, (name, run)


def test_memory_does_not_follow_the_run():
    rng = np.random.default_rng(2)
    run = bytes(rng.choice(np.frombuffer(b"abcdefghijklmnopqrstuvwxyzABC", dtype=np.uint8), 1_000_000)).decode()
    beginnings = np.full(26 ** S.MIN_WORD, 0, dtype=np.int32)
    beginnings[::50] = (1 << 17) - 1
    transitions = np.full((256, 256), -8.0)
    tracemalloc.start()
    S.features(run, 0, len(run), "p", transitions, frozenset())
    assert sum(1 for _ in S.asked_words(run, [], beginnings)) > 200_000
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 15 * len(run)


def test_every_value_assigned_to_a_name_is_a_candidate():
    values = {'password = "Tr0ub4dor3x"': ["Tr0ub4dor3x"], "pwd: 'correct horse battery staple'": ["correct horse battery staple"],
              'db_password: p.q~r!s$t@u#v, next': ["p.q~r!s$t@u#v"], 'auth = ""': [], "token=a&password=é; x": ["a", "é"],
              'if token == "q w":': ["q w"], '{"secret": hunter2}': ["hunter2"], 'name = "Tr0ub4dor3x"': [], "secret::x != y": [],
              'token = "password = x" next': ["password = x"], 'pwd = "open end': ["open"], r'pwd = "a\"b" c': [r'a\"b'], "token:": [],
              "auth = token=abc x": ["token=abc", "abc"]}
    for text, want in values.items():
        assert [text[a:b] for a, b in S.candidates(text)] == want, text
    text = 'api_key = "ab.cd/0123456789abcdefXYZ"'  # the value, and the key run in it
    assert [text[a:b] for a, b in S.candidates(text)] == ["ab.cd/0123456789abcdefXYZ", "cd/0123456789abcdefXYZ"]
    transitions = np.full((256, 256), -8.0)
    for text, want in values.items():
        for a, b in S.candidates(text):
            assert np.isfinite(S.features(text, a, b, None, transitions, frozenset())).all()
    assert S.decided('password = "Tr0ub4dor3x"', 12, 23) == 1 and S.decided("secret: nobody knows", 8, 14) == -1
    for long in ("token=" * 50_000, 'token="' * 50_000, "token='" * 50_000 + '"', ": " * 150_000, "token" * 60_000 + "=", "pwd=" + " " * 300_000):
        list(S.candidates(long))


def test_short_secrets_are_found(spark):
    rng = random.Random(5)
    make = lambda: "".join(rng.choice("abcdefghkmnpqrstABCDEFGHKM23456789!.~@") for _ in range(11))
    rows = [(k, f'some words password = "{make()}" more words', "p") for k in range(60)]
    rows += [(100 + k, f"some words {rng.randrange(10 ** 19, 10 ** 20)} more words", "p") for k in range(60)]
    got = S.scan(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert {(r.doc_id, r.is_secret) for r in got} == {(r[0], r[0] < 100) for r in rows} and len(got) == 120
    assert all((r.start, r.end) == (23, 34) for r in got if r.doc_id < 100)


def test_labelled_findings_train_the_forest(spark):
    rng = random.Random(4)
    rows, labelled = [], []
    for k in range(300):
        secret = k % 3 == 0
        run = "".join(rng.choice("0123456789abcdef") for _ in range(32)) if secret else "".join(rng.choice("0123456789") for _ in range(20))
        rows.append((k, f"some words {run} more words", f"src/{k % 5}.py", "x"))
        if k < 200:
            labelled.append((k, 11, 11 + len(run), int(secret)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, features string")
    findings = spark.createDataFrame(labelled, "doc_id long, start int, end int, label int")
    got = {r.doc_id: r.is_secret for r in S.scan(docs, findings=findings).collect()}
    assert got == {k: k % 3 == 0 for k in range(300)}


def test_copied_findings_are_drawn_once(spark, monkeypatch):
    rows = [([1.0, 0.0], 1)] * 1_000 + [([0.0, 1.0], 0)] * 1_000 + [([0.5, float(k)], k % 2) for k in range(1_000)]
    found = spark.createDataFrame(rows, "features array<double>, label int")
    drawn = S.draw(found, "label", 100).collect()
    heavy = {tuple(r.features): r.weight for r in drawn if r.features[0] != 0.5}
    assert heavy == {(1.0, 0.0): 1_000, (0.0, 1.0): 1_000}
    light = [r.weight for r in drawn if r.features[0] == 0.5]
    assert 15 <= len(light) <= 60 and all(abs(w - 30) < 1e-9 for w in light)
    assert {r.weight for r in S.draw(found, "label", 50_000).collect()} == {1.0, 1_000.0}
    monkeypatch.setattr(S, "MAX_FINDINGS", 20)
    copies = [([1.0] * 22, 1)] * 500 + [([0.0] * 22, 0)] * 500
    model = S.train(spark.createDataFrame(copies, "features array<double>, label int"))
    got = S.judge(spark.createDataFrame(copies[:1] + copies[-1:], "features array<double>, label int"), model).collect()
    assert {(r.label, r.is_secret) for r in got} == {(1, True), (0, False)}


def test_edge_rows(spark):
    run = "9f86d081884c7d659a2feaa0c55ad015"
    rows = [(1, None, None), (2, "", "a"), (None, f'é token = "{run}"', None), (3, f'token = "{run}"', "p"), (3, f'token = "{run}"', "p"),
            (4, "1" * 300_000, "p")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = S.scan(docs).collect()
    assert sorted(((r.doc_id, r.start, r.end, r.is_secret) for r in got), key=str) == sorted(
        [(None, 11, 43, True), (3, 9, 41, True), (3, 9, 41, True), (4, 0, 300_000, False)], key=str)
    assert S.scan(docs.where("doc_id > 9")).count() == 0
    alone = S.scan(docs.where("doc_id = 3")).collect()  # nothing to learn from: nothing is removed
    assert [(r.score, r.is_secret) for r in alone] == [(1.0, True)] * 2


def test_planted_tokens_held_out(spark):
    sf = "/root/testdata/sf0.1"
    texts = {r.doc_id: r.text for r in documents(spark, sf).select("doc_id", "text").collect()}
    rows = S.query(spark, sf).collect()
    found = {(r.doc_id, r.start): r for r in rows}
    assert sum(len(list(S.candidates(t))) for t in texts.values()) == len(rows)
    planted = [(k, m.start(1)) for k, t in texts.items() for m in re.finditer(r'(?i)token = "([0-9a-f]{40})"', t)]
    assert len(planted) > 50 and all(found[p].is_secret for p in planted)
    assert any(found[p].held_out for p in planted)
    assert not any(r.is_secret for r in rows if texts[r.doc_id][r.start:r.end].isdigit())
