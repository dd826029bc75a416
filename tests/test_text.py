"""Cleaning and chunking rules on edge vectors: a table of inputs and the
results that the rules define for them."""

from __future__ import annotations

from pyspark.sql import functions as F

from moodframe.functions import text as T
from moodframe.operators import scoring as S
from moodframe.sources import fixtures as fx

STEPS = ("urls", "mentions", "letters", "blanks", "all", "lower")
# What each step leaves of a text; a step that is not named leaves it as it is.
EXPECTED = {
    "hi @éabc there": {"mentions": "hi  there", "letters": "hi abc there", "all": "hi there", "lower": "hi abc there"},
    "awwwesome": {"urls": "a", "all": "a"},
    "visit www and http now": {},
    "a\x1cb\x85c d": {"blanks": "a b c d", "all": "a b c d"},
    "a,b|||c": {"letters": "abc", "all": "abc", "lower": "abc"},
    "   \t  ": {"blanks": "", "all": ""},
    "": {},
    "w" * 511 + " next": {"urls": " next", "all": "next"},
    "x @a²b y": {"mentions": "x  y", "letters": "x ab y", "all": "x y", "lower": "x ab y"},
    "a\u200bb c": {"letters": "ab c", "all": "ab c", "lower": "ab c"},
    "see https://x.y/z and www.site.com ok #tag 42 don't": {
        "urls": "see  and  ok #tag 42 don't",
        "mentions": "see https://x.y/z and www.site.com ok tag  don't",
        "letters": "see httpsxyz and wwwsitecom ok tag  dont",
        "all": "see and ok tag dont",
        "lower": "see httpsxyz and wwwsitecom ok tag  dont"},
}


def spec_chunks(text, n=512):
    """Greedy packing of whitespace words into pieces of at most ``n``
    characters; an over-long word stands alone."""
    out = []
    for w in text.split():
        if out and len(out[-1]) + 1 + len(w) <= n:
            out[-1] += " " + w
        else:
            out.append(w)
    return out


def _edge(spark):
    return fx.edge_texts(spark)


def test_each_cleaning_step(spark):
    assert set(EXPECTED) <= set(fx.EDGE_TEXTS)
    rows = _edge(spark).select(
        "text", T.strip_urls("text").alias("urls"), T.strip_mentions_hash_digits("text").alias("mentions"),
        T.strip_non_letters("text").alias("letters"), T.collapse_ws("text").alias("blanks"),
        T.clean_text("text").alias("all"), T.normalize_lower("text").alias("lower")).collect()
    assert len(rows) == len(fx.EDGE_TEXTS) + 1
    for r in rows:
        for step in STEPS:
            assert r[step] == EXPECTED.get(r["text"], {}).get(step, r["text"]), (r["text"], step)


def test_known_quirks(spark):
    df = spark.createDataFrame([("awwwesome",), ("don't a,b",), ("#tag @user x",)], "t string")
    got = [r[0] for r in df.select(T.clean_text("t")).collect()]
    assert got == ["a", "dont ab", "tag x"]


def test_chunks_on_edge_vectors(spark):
    df = _edge(spark).where(F.col("text").isNotNull()).select(
        "id", T.clean_text("text").alias("c"))
    rows = df.select("id", "c", T.chunk_text("c").alias("chunks")).collect()
    for r in rows:
        assert list(r["chunks"]) == spec_chunks(r["c"]), r["id"]
        for ch in r["chunks"]:
            assert len(ch) <= 512 or " " not in ch
        assert " ".join(r["chunks"]) == r["c"]


def test_chunks_on_documents(spark):
    from conftest import SF_SMALL
    from moodframe.session import table
    d = table(spark, SF_SMALL, "documents").select("doc_id", T.clean_text("text").alias("c"))
    rows = d.select("c", T.chunk_text("c").alias("chunks")).collect()
    assert len(rows) == 200
    for r in rows:
        assert list(r["chunks"]) == spec_chunks(r["c"])


def test_chunk_parameter(spark):
    df = spark.createDataFrame([("aa bb cc dd eeeeeeee f",)], "c string")
    got = df.select(T.chunk_text("c", 5)).first()[0]
    assert list(got) == spec_chunks("aa bb cc dd eeeeeeee f", 5)


def test_empty_text_has_no_chunk_and_default_emoji(spark):
    posts = spark.createDataFrame([(1, "#### 1234"), (2, None), (3, "and joy")],
                                  "doc_id bigint, posts string")
    out = {r["doc_id"]: r for r in S.enrich_posts(posts, S.LexiconScorer(fx.lexicon(spark)))
           .collect()}
    assert out[1]["cleaned_posts"] == "" and out[1]["emotion"] is None
    assert out[1]["emoji"] == T.DEFAULT_EMOJI
    assert out[2]["emotion"] is None
    assert out[3]["emotion"] == "joy" and out[3]["emoji"] == T.EMOJI_MAP["joy"]


def test_emoji_lookup(spark):
    df = spark.createDataFrame([("JOY",), ("disgust",), (None,), ("Love",)], "e string")
    got = [r[0] for r in df.select(T.emotion_to_emoji("e")).collect()]
    assert got == [T.EMOJI_MAP["joy"], T.DEFAULT_EMOJI, T.DEFAULT_EMOJI, T.EMOJI_MAP["love"]]


def test_stopwords_keep_duplicates_and_order(spark):
    df = spark.createDataFrame([("the cat and the cat dont",)], "t string")
    got = df.select(T.remove_stopwords(T.tokenize_words("t"), fx.spark_stop_words())).first()[0]
    assert list(got) == ["cat", "cat", "dont"]
    assert len(fx.spark_stop_words()) == 181
