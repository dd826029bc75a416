from __future__ import annotations

import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from moodframe.llm.common import documents
from moodframe.llm.pii import KINDS, base_spans, find_pii, query

PATTERNS = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")


def plain(text):
    """The contract's expressions as they stand."""
    for kind, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            digits = [int(d) for d in re.findall("[0-9]", m.group())]
            even = [d * 2 - 9 * (d > 4) for d in digits[-2::-2]]
            if (kind == 0 or kind == 1 and all(int(p) <= 255 for p in m.group().split("."))
                    or kind == 2 and 13 <= len(digits) <= 19 and (sum(digits[-1::-2]) + sum(even)) % 10 == 0
                    or kind == 3 and 9 <= len(digits) <= 15):
                yield kind, *m.span()


@settings(max_examples=800, deadline=None)
@given(st.text(st.sampled_from("0123459.-+ ()@ab%é\n"), max_size=40) | st.from_regex(PATTERNS[0] + ".?" + PATTERNS[1])
       | st.from_regex(PATTERNS[2] + "|" + PATTERNS[3]))
def test_base_spans_equal_the_expressions(text):
    assert base_spans(text) == list(plain(text))


def test_long_runs_take_linear_time():
    for text in ("1" * 200_000, "a" * 200_000 + "@", "1." * 100_000, "+1" + " " * 200_000, "@" * 200_000, "1 " * 100_000):
        base_spans(text)


def test_contexts_find_unseen_identifiers(spark):
    rows = [(k, f"word{k} filler reach me at user{k}@mail.example.com please, thanks {k % 7}") for k in range(40)]
    rows += [(100 + k, f"other text reach me at user{k}(at)mail please, or not") for k in range(3)]
    rows += [(200 + k, f"see page {k}{k}0012 of the book") for k in range(9)]
    rows += [(300, "reach me at home please")]
    got = {r.doc_id: r for r in find_pii(spark.createDataFrame([(*r, "x", 3) for r in rows], "doc_id long, text string, kind string, n_ip int")).collect()}
    assert all(got[k].n_email == 1 and got[k].n_added == 0 for k in range(40))
    for k in range(3):  # one digit is enough where the context is reliable
        start = rows[40 + k][1].index("user")
        assert got[100 + k].spans == f"email:{start}:{start + 13}" and got[100 + k].n_added == 1
    rows = [(100 + k, f"other text reach me at acct-55{k}1-77 please, or not") for k in range(3)] + rows[:40] + rows[43:]
    got = {r.doc_id: r for r in find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k in range(3):
        start = rows[k][1].index("acct")
        assert got[100 + k].spans == f"email:{start}:{start + 12}" and got[100 + k].n_email == 0
    assert all(got[200 + k].spans == "" for k in range(9)) and got[300].spans == ""


def test_found_identifiers_raise_patterns_without_seeds(spark):
    """Only the first context has seeds; each later one is reliable by the
    accounts found in the one before, so that the last takes a fourth round."""
    contexts, sizes = ("reach me at", "my handle is", "now posting as", "letters signed by"), (300, 60, 12, 1)
    accounts = [[f"acct-{n}55{k:04d}" for k in range(size)] for n, size in enumerate(sizes)]
    rows = [(k, f"some words {contexts[0]} user{k}@mail.example.com please") for k in range(1500)]
    for n, context in enumerate(contexts):
        for name in accounts[n] + (accounts[n - 1] if n else []):
            rows.append((10_000 * (n + 1) + len(rows), f"some words {context} {name} please"))
    rows += [(90_000 + k, f"see page {k}{k}0012 of the book") for k in range(9)]
    got = find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    for r in got:
        assert r.n_added == (10_000 <= r.doc_id < 90_000), r
    few = find_pii(spark.createDataFrame(rows, "doc_id long, text string"), rounds=1).collect()
    assert sum(r.n_added for r in few) == 300 + 300  # the first accounts, in both of their contexts


def test_edge_rows(spark):
    mail = "İ x.y@a-b.co, 4111 1111 1111 1111 and +1 (377) 555-0271 at 10.0.0.255"
    rows = [(1, None), (2, ""), (None, mail), (3, mail), (3, mail), (4, "é" * 300_000 + " a@b.c")]
    got = find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 6
    want = ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in plain(mail))
    for r in got:
        if r.doc_id in (None, 3):
            assert r.spans == want and r.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
            assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == (1, 1, 1, 1)
        if r.doc_id in (1, 2):
            assert r.spans == "" and r.base_sha256 == hashlib.sha256(b"").hexdigest()
        if r.doc_id == 4:
            assert r.spans == "email:300001:300006"
    assert find_pii(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query_against_the_expressions(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in documents(spark, sf).collect()}
    rows = query(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = list(plain(texts[r.doc_id]))
        spans = ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in want)
        assert r.base_sha256 == hashlib.sha256(spans.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == kind for k, *_ in want) for kind in range(4)]
        assert set(filter(None, spans.split(","))) <= set(filter(None, r.spans.split(",")))
