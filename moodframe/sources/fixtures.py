"""Fixture views over the driver's tables (see FIXTURES.md).

Only this module and the entry file know fixture names; every operator takes
column names as parameters.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moodframe.session import local_table, table

# The 16 personality types in sorted (code) order.
TYPES = [
    "ENFJ", "ENFP", "ENTJ", "ENTP", "ESFJ", "ESFP", "ESTJ", "ESTP",
    "INFJ", "INFP", "INTJ", "INTP", "ISFJ", "ISFP", "ISTJ", "ISTP",
]

# Test lexicon (word, label); weight 1.0 each. The fixture prose is
# invented, so frequent tokens stand in for emotion words.
LEXICON = [
    ("and", "joy"), ("la", "joy"),
    ("is", "anger"), ("der", "anger"),
    ("that", "sadness"), ("die", "sadness"),
    ("for", "fear"), ("que", "fear"),
    ("it", "surprise"), ("und", "surprise"),
    ("was", "love"), ("des", "love"),
    ("of", "neutral"), ("de", "neutral"),
]

# Small lemma dictionary (form, lemma); the last three forms do
# not occur in the fixtures on purpose.
LEMMAS = [
    ("des", "de"), ("les", "le"), ("den", "der"), ("ing", "in"), ("ha", "have"),
    ("es", "e"), ("er", "e"), ("ou", "o"), ("el", "e"), ("ai", "avoir"),
    ("was", "be"), ("are", "be"), ("eau", "eaux"), ("rewh", "rew"),
    ("orantion", "orant"), ("hehely", "hehel"), ("thatin", "that"),
    ("ononst", "onon"), ("inoran", "inora"),
    ("running", "run"), ("cats", "cat"), ("geese", "goose"),
]

# Edge texts for the cleaning and chunking rules.
EDGE_TEXTS = [
    "hi @éabc there",
    "awwwesome",
    "visit www and http now",
    "a\x1cb\x85c d",
    "a,b|||c",
    "   \t  ",
    "",
    "x" * 600 + " tail words",
    "head " + "y" * 600 + " tail",
    "z" * 512 + " next",
    "w" * 511 + " next",
    " ".join(["abcd"] * 400),
    "x @a²b y",
    "a​b c",
    "see https://x.y/z and www.site.com ok #tag 42 don't",
]


# Spark's default English stop list, in its own order (the list
# ``StopWordsRemover.loadDefaultStopWords('english')`` returns).
ENGLISH_STOP_WORDS = """
    i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she
    her hers herself it its itself they them their theirs themselves what which who whom this that
    these those am is are was were be been being have has had having do does did doing a an the and
    but if or because as until while of at by for with about against between into through during
    before after above below to from up down in out on off over under again further then once here
    there when where why how all any both each few more most other some such no nor not only own
    same so than too very s t can will just don should now i'll you'll he'll she'll we'll they'll
    i'd you'd he'd she'd we'd they'd i'm you're he's she's it's we're they're i've we've you've
    they've isn't aren't wasn't weren't haven't hasn't hadn't don't doesn't didn't won't wouldn't
    shan't shouldn't mustn't can't couldn't cannot could here's how's let's ought that's there's
    what's when's where's who's why's would
""".split()


def spark_stop_words() -> list[str]:
    """Spark's default English stop list as a constant (no file or JVM access)."""
    return list(ENGLISH_STOP_WORDS)


def type_of_source(source_col: str = "source"):
    types = F.array(*[F.lit(t) for t in TYPES])
    idx = F.pmod(F.substring(F.col(source_col), 4, 100).cast("int"), F.lit(16))
    return F.get(types, idx)


def text_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A text table of the driver, in the splits that its files have."""
    return table(spark, sf_dir, name)


def posts_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents -> (doc_id, type, lang, posts, n_chars)."""
    d = text_table(spark, sf_dir, "documents")
    return d.select("doc_id", type_of_source("source").alias("type"), "lang",
                    F.col("text").alias("posts"), "n_chars")


def lexicon(spark: SparkSession) -> DataFrame:
    return local_table(spark, [(w, l, 1.0) for w, l in LEXICON],
                                 "word string, label string, weight double")


# Entries of two words: every pair of lexicon words, with the label of the first
# and twice the weight; the words alone are entries, too.
PHRASES = ([(w, l, 1.0) for w, l in LEXICON]
           + [(f"{first} {second}", l, 2.0) for first, l in LEXICON for second, _ in LEXICON])


def phrase_lexicon(spark: SparkSession) -> DataFrame:
    return local_table(spark, PHRASES, "phrase string, label string, weight double")


def lemma(spark: SparkSession) -> DataFrame:
    return local_table(spark, LEMMAS, "form string, lemma string")


def edge_texts(spark: SparkSession) -> DataFrame:
    rows = [(i, t) for i, t in enumerate(EDGE_TEXTS)] + [(len(EDGE_TEXTS), None)]
    return local_table(spark, rows, "id int, text string")
