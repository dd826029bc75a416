"""Registered queries: one callable ``(spark, sf_dir) -> DataFrame`` per
operator of the inventory, each running over the whole driver tables.

Floating results are rounded (4-8 decimals) so the SQL twins compare exactly;
arrays are emitted as joined strings or exploded rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moodframe.functions import text as T
from moodframe.operators import scoring as S
from moodframe.sources import fixtures as fx
from moodframe.session import cut_lineage, scratch_dir, stored, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register(fn):
    QUERIES[fn.__name__] = fn
    return fn


# --------------------------------------------------------------------- B text
def _docs(spark, sf):
    return fx.text_table(spark, sf, "documents").select("doc_id", "text")


@register
def strip_urls(spark, sf):
    return _docs(spark, sf).select("doc_id", T.strip_urls("text").alias("out"))


@register
def strip_mentions_hash_digits(spark, sf):
    return _docs(spark, sf).select("doc_id", T.strip_mentions_hash_digits("text").alias("out"))


@register
def strip_non_letters(spark, sf):
    return _docs(spark, sf).select("doc_id", T.strip_non_letters("text").alias("out"))


@register
def collapse_ws(spark, sf):
    return _docs(spark, sf).select("doc_id", T.collapse_ws("text").alias("out"))


@register
def clean_text(spark, sf):
    return _docs(spark, sf).select("doc_id", T.clean_text("text").alias("cleaned_posts"))


@register
def normalize_lower(spark, sf):
    return _docs(spark, sf).select("doc_id", T.normalize_lower("text").alias("out"))


@register
def tokenize_words(spark, sf):
    toks = T.tokenize_words(T.normalize_lower("text"))
    return _docs(spark, sf).select("doc_id", F.size(toks).cast("bigint").alias("n_tokens"),
                                   F.array_join(toks, "|").alias("tokens"))


@register
def remove_stopwords(spark, sf):
    kept = T.remove_stopwords(T.tokenize_words(T.normalize_lower("text")), fx.spark_stop_words())
    return _docs(spark, sf).select("doc_id", F.size(kept).cast("bigint").alias("n_kept"),
                                   F.array_join(kept, "|").alias("kept"))


@register
def lemmatize_tokens(spark, sf):
    from moodframe.operators.prep import lemmatize
    toks = _docs(spark, sf).select(
        "doc_id", T.remove_stopwords(T.tokenize_words(T.normalize_lower("text")),
                                     fx.spark_stop_words()).alias("tokens"))
    out = lemmatize(toks, fx.lemma(spark), "doc_id", "tokens", "lemmas", in_row=True)
    return out.select("doc_id", F.size("lemmas").cast("bigint").alias("n_lemmas"),
                      F.array_join("lemmas", "|").alias("lemmas"))


@register
def readme_clean(spark, sf):
    from moodframe.operators.prep import readme_clean as rc
    out = rc(_docs(spark, sf), fx.lemma(spark), fx.spark_stop_words(), "doc_id", "text", in_row=True)
    return out.select("doc_id", "cleaned")


@register
def rejoin_tokens(spark, sf):
    toks = T.tokenize_words(T.clean_text("text"))
    return _docs(spark, sf).select("doc_id", T.rejoin_tokens(toks).alias("rejoined"))


@register
def chunk_text(spark, sf):
    d = _docs(spark, sf).select("doc_id", T.clean_text("text").alias("cleaned_posts"))
    return S.explode_chunks(d).select("doc_id", "chunk_idx", "chunk",
                                      F.length("chunk").cast("bigint").alias("chunk_len"))


# ------------------------------------------------------------------ C scoring
def _scored(spark, sf):
    d = _docs(spark, sf).select("doc_id", T.clean_text("text").alias("cleaned_posts"))
    return S.LexiconScorer(fx.lexicon(spark)).score(S.explode_chunks(d))


@register
def score_chunks(spark, sf):
    return _scored(spark, sf).select("doc_id", "chunk_idx", "label",
                                     F.round("score", 8).alias("score"))


@register
def score_chunks_by_phrases(spark, sf):
    from moodframe.operators.phrases import PhraseScorer
    d = _docs(spark, sf).select("doc_id", T.clean_text("text").alias("cleaned_posts"))
    scored = PhraseScorer(fx.phrase_lexicon(spark)).score(S.explode_chunks(d))
    return scored.select("doc_id", "chunk_idx", "label", F.round("score", 8).alias("score"))


@register
def emotion_vote(spark, sf):
    return S.emotion_vote(_scored(spark, sf))


@register
def emotion_mean_scores(spark, sf):
    m = S.emotion_mean_scores(_scored(spark, sf))
    return m.select("doc_id", "label", F.round("mean_score", 8).alias("mean_score"),
                    "n_chunks", "first_idx")


@register
def assign_emotion(spark, sf):
    return S.assign_emotion(_scored(spark, sf), sorted(S.DEFAULT_PRIORS))


def enriched(spark, sf) -> DataFrame:
    return S.enrich_posts(fx.posts_v(spark, sf), S.LexiconScorer(fx.lexicon(spark), in_row=True))


@register
def enrich_posts(spark, sf):
    return enriched(spark, sf)


@register
def emotion_to_emoji(spark, sf):
    e = enriched(spark, sf)
    # upper-cased half of the labels exercises the case-insensitive lookup
    emo = F.when(F.col("doc_id") % 2 == 0, F.upper("emotion")).otherwise(F.col("emotion"))
    return e.select("doc_id", emo.alias("emotion"), T.emotion_to_emoji(emo).alias("emoji"))


# ---------------------------------------------------------------- D balancing
from moodframe.operators import balance as D  # noqa: E402


def _enr(spark, sf):
    # reused by several actions (size checks, targets) -> checkpointed once
    return cut_lineage(enriched(spark, sf).select(
        "doc_id", "type", "lang", "emotion", "emoji", F.md5("cleaned_posts").alias("text_key")))


@register
def class_counts(spark, sf):
    return D.class_counts(_enr(spark, sf), "emotion")


@register
def max_class_count(spark, sf):
    return D.max_class_count(_enr(spark, sf), ["emotion", "type"])


@register
def distinct_classes(spark, sf):
    return D.distinct_classes(_enr(spark, sf), "emotion", "doc_id")


@register
def class_filter(spark, sf):
    return D.class_filter(_enr(spark, sf), "emotion", "joy").select("doc_id", "type", "emotion")


@register
def union_classes(spark, sf):
    e = _enr(spark, sf).select("doc_id", "emotion")
    return D.union_classes([D.class_filter(e, "emotion", l) for l in sorted(S.DEFAULT_PRIORS)])


@register
def oversample_one_key(spark, sf):
    out = D.oversample(_enr(spark, sf), "type", ["doc_id"])
    return out.select("type", "draw", "doc_id", "emotion")


def _two_pass(spark, sf):
    return D.balance_two_pass(_enr(spark, sf), "emotion", "type", ["doc_id"])


@register
def balance_two_pass(spark, sf):
    return _two_pass(spark, sf).select("type", "draw2", "emotion", "draw1", "doc_id")


@register
def shuffle_reindex(spark, sf):
    out = D.shuffle_reindex(_two_pass(spark, sf), ["type", "draw2"])
    return out.select("row_idx", "type", "emotion", "doc_id")


@register
def undersample(spark, sf):
    return D.undersample(_enr(spark, sf), "type", ["doc_id"]).select("doc_id", "type", "emotion")


@register
def balance_before_after(spark, sf):
    e = _enr(spark, sf)
    return D.balance_before_after(e, D.balance_two_pass(e, "emotion", "type", ["doc_id"]), ["emotion", "type"])


@register
def class_weights(spark, sf):
    w = D.class_weights(_enr(spark, sf), "emotion")
    return w.select("emotion", "n", F.round("weight", 8).alias("weight"))


@register
def class_count_check(spark, sf):
    e = _enr(spark, sf)
    return D.class_count_check(e, "emotion", 7, D.class_weights(e, "emotion"))


# ------------------------------------------------------------- E preparation
from moodframe.operators import prep as E  # noqa: E402

HEAD_COLS = ["type", "emotion", "emoji"]
# The labels that the heads can have: training need not look for them in the texts.
HEAD_LABELS = {"type": fx.TYPES, "emotion": list(S.DEFAULT_PRIORS), "emoji": [*T.EMOJI_MAP.values(), T.DEFAULT_EMOJI]}


def _labelled(spark, sf):
    # a narrow plan over the scan: text is cleaned where it is used, never stored
    return enriched(spark, sf).select("doc_id", "cleaned_posts", *HEAD_COLS)


def _codes(df):
    return {c: E.fit_codes(df, c) for c in HEAD_COLS}


def _heads(spark, sf):
    # keys and labels only, read by several steps of a query
    return cut_lineage(_labelled(spark, sf).select("doc_id", *HEAD_COLS))


def _encoded(spark, sf):
    lab = _heads(spark, sf)
    return E.encode_labels(lab, _codes(lab))


@register
def encode_labels(spark, sf):
    return _encoded(spark, sf).select("doc_id", *[f"label_{c}" for c in HEAD_COLS])


@register
def decode_labels(spark, sf):
    lab = _heads(spark, sf)
    codes = _codes(lab)
    out = E.encode_labels(lab, codes).select("doc_id", *[f"label_{c}" for c in HEAD_COLS])
    for c in HEAD_COLS:
        out = E.decode_labels(out, f"label_{c}", codes[c], c)
    return out.select("doc_id", *HEAD_COLS)


def _split(spark, sf):
    return E.train_val_split(_encoded(spark, sf), ["doc_id"])


@register
def train_val_split(spark, sf):
    return _split(spark, sf).select("doc_id", "split")


@register
def split_leakage(spark, sf):
    bal = cut_lineage(_two_pass(spark, sf).select("type", "draw2", "text_key"))
    by_row = E.split_leakage(E.train_val_split(bal, ["type", "draw2"]), "text_key")
    by_text = E.split_leakage(E.train_val_split(bal, ["type", "draw2"], group_cols=["text_key"]),
                              "text_key")
    return (by_row.select(F.lit("row").alias("mode"), "*")
            .unionByName(by_text.select(F.lit("text_group").alias("mode"), "*")))


def _cleaned(spark, sf):
    return _docs(spark, sf).select("doc_id", T.clean_text("text").alias("cleaned_posts"))


def _vocab(spark, sf):
    return E.build_vocabulary(_cleaned(spark, sf), "cleaned_posts")


@register
def build_vocabulary(spark, sf):
    return _vocab(spark, sf)


def _tokens(spark, sf):
    return E.encode_tokens(_cleaned(spark, sf), "doc_id", "cleaned_posts", _vocab(spark, sf))


@register
def encode_tokens(spark, sf):
    t = _tokens(spark, sf)
    return t.select("doc_id",
                    F.aggregate("attention_mask", F.lit(0).cast("bigint"), lambda a, x: a + x)
                    .alias("n_real"),
                    F.size("input_ids").cast("bigint").alias("n_ids"),
                    F.array_join("input_ids", " ").alias("ids"))


@register
def training_rows(spark, sf):
    rows = E.training_rows(_tokens(spark, sf), _split(spark, sf), "doc_id",
                           [f"label_{c}" for c in HEAD_COLS])
    return rows.select("doc_id", "split", *[f"label_{c}" for c in HEAD_COLS],
                       F.aggregate("attention_mask", F.lit(0).cast("bigint"), lambda a, x: a + x)
                       .alias("n_real"))


# ------------------------------------------------------------ F models
from moodframe.operators import evaluate as G  # noqa: E402
from moodframe.operators import models as M  # noqa: E402

ALPHAS = [0.5, 1.0, 2.0]


def _split_lab(spark, sf):
    # the split is a narrow column; only the keys are read to find its threshold
    return E.train_val_split(_labelled(spark, sf), ["doc_id"])


def _nb(spark, sf, alpha=1.0, ngram=1, sp=None):
    sp = sp if sp is not None else _split_lab(spark, sf)
    model = M.train_naive_bayes(sp.where(F.col("split") == "train"), "doc_id", "cleaned_posts",
                                HEAD_COLS, alpha, ngram, labels=HEAD_LABELS)
    return sp, model


def _val_preds(spark, sf, alpha=1.0, ngram=1, sp=None, model=None, truth=False):
    if model is None:
        sp, model = _nb(spark, sf, alpha, ngram, sp)
    val = sp.where(F.col("split") == "val")
    if truth:  # the labels are asked for, too: the rows held out are cleaned and enriched once
        val = stored(val.select("doc_id", "cleaned_posts", *HEAD_COLS))
    scores = M.naive_bayes_scores(val, "doc_id", "cleaned_posts", model)
    return val, scores, M.argmax_rows(scores, ["doc_id", "head"])


def _results(val, preds):
    return M.results_table(val, preds, "doc_id", HEAD_COLS)


def _results_df(spark, sf):
    val, _, preds = _val_preds(spark, sf, truth=True)
    return cut_lineage(_results(val.select("doc_id", *HEAD_COLS), preds))


def _long(res):
    return G.results_long(res, [(f"true_{h}", f"pred_{h}") for h in HEAD_COLS], HEAD_COLS)


@register
def train_multi_head(spark, sf):
    _, m = _nb(spark, sf)
    return m.class_params.select("head", "class", F.col("n_docs").cast("bigint"), "n_tokens",
                                 F.round("log_prior", 8).alias("log_prior"),
                                 F.round("log_denom", 8).alias("log_denom"))


@register
def predict_heads(spark, sf):
    return _val_preds(spark, sf)[2]


@register
def joint_loss(spark, sf):
    val, scores, _ = _val_preds(spark, sf, truth=True)
    return M.joint_loss(scores, val, "doc_id", HEAD_COLS).select(
        "head", F.round("loss", 6).alias("loss"))


@register
def select_best_candidate(spark, sf):
    sp = _split_lab(spark, sf)
    counts = M.count_naive_bayes(sp.where(F.col("split") == "train"), "doc_id", "cleaned_posts", HEAD_COLS, labels=HEAD_LABELS)
    val = sp.where(F.col("split") == "val")
    texts = cut_lineage(val.select("doc_id", "cleaned_posts", *HEAD_COLS))  # scored by every candidate
    parts = []
    for a in ALPHAS:
        scores = M.naive_bayes_scores(texts, "doc_id", "cleaned_posts", counts.model(a))
        loss = M.joint_loss(scores, texts, "doc_id", HEAD_COLS).where(F.col("head") == "sum")
        parts.append(loss.select(F.lit(a).alias("alpha"), F.round("loss", 6).alias("loss")))
    from functools import reduce as _r
    return M.select_best_candidate(_r(DataFrame.unionByName, parts), "alpha")


def _emb(spark, sf):
    return table(spark, sf, "embeddings")


def _logits(spark, sf):
    e = _emb(spark, sf)
    head = M.class_centroids(e, "embedding", "label")
    return M.linear_head_logits(e, "vec_id", "embedding", head, "label")


@register
def logits_linear_head(spark, sf):
    lg = _logits(spark, sf)
    return lg.select("vec_id", F.inline(F.arrays_zip(F.col("labels").alias("label"),
                                                     F.col("logits").alias("logit")))) \
        .select("vec_id", F.col("label").cast("bigint").alias("label"),
                F.round("logit", 5).alias("logit"))


@register
def argmax_class(spark, sf):
    lg = _logits(spark, sf)
    return lg.select("vec_id", F.get("labels", M.argmax_array("logits").cast("int"))
                     .cast("bigint").alias("pred_label"))


@register
def predict_table(spark, sf):
    sp, model = _nb(spark, sf)
    return M.predict_table(sp.select("doc_id", *HEAD_COLS, "cleaned_posts"), model, "type", "doc_id", "cleaned_posts",
                           "predicted_type")


@register
def code_lookup_default(spark, sf):
    sp, model = _nb(spark, sf)
    val, _, preds = _val_preds(spark, sf, sp=sp, model=model, truth=True)
    # the labels of all rows: training has counted its own, the others are stored
    codes = {}
    for h in HEAD_COLS:
        trained = model.class_params.where(F.col("head") == h).select(F.col("class").alias(h))
        codes.update({h: E.fit_codes(trained.unionByName(val.select(h)), h)})
    defaults = {"type": "Unknown", "emotion": "neutral", "emoji": T.EMOJI_MAP["neutral"]}
    out = M.look_up_codes(preds, codes, defaults, "doc_id")
    return out.select("doc_id", F.col("type").alias("personality"), "emotion", "emoji")


@register
def sequence_pooling(spark, sf):
    pooled = M.sequence_pooling(_emb(spark, sf), "label", "vec_id", "embedding")
    return pooled.select(F.col("label").cast("bigint").alias("label"),
                         F.col("first.vec_id").alias("first_vec_id"),
                         F.col("last.vec_id").alias("last_vec_id"),
                         F.posexplode("mean").alias("dim", "mean")) \
        .select("label", "first_vec_id", "last_vec_id", F.col("dim").cast("bigint"),
                F.round("mean", 6).alias("mean"))


def _metrics(res):
    avg = G.report_averages(_long(res))
    # the report has an accuracy row only when every prediction is a label of
    # the truth (else "micro avg" replaces it): accuracy is null then
    acc = avg.where(F.col("avg") == "accuracy").select("head", F.col("f1").alias("accuracy"))
    mac = avg.where(F.col("avg") == "macro avg").select("head", F.col("f1").alias("macro_f1"))
    return mac.join(acc, "head", "left").select("head", F.round("accuracy", 6).alias("accuracy"),
                                        F.round("macro_f1", 6).alias("macro_f1"))


@register
def compare_models(spark, sf):
    sp = _split_lab(spark, sf)
    tables = {}
    for name, ng in [("nb_unigram", 1), ("nb_bigram", 2)]:
        val, _, preds = _val_preds(spark, sf, ngram=ng, sp=sp, truth=True)
        tables[name] = _metrics(cut_lineage(_results(val.select("doc_id", *HEAD_COLS), preds)))
    return M.compare_models(tables)


def _texts_by_key(rows):
    """The texts of ``rows`` joined with the labels by ``doc_id``. A row whose key
    is its own stays where it is; only rows of repeated keys are shuffled."""
    keyed = rows.where(F.col("doc_id").isNotNull())
    again = stored(keyed.groupBy("doc_id").count().where("count > 1").select("doc_id"))
    if not again.count():
        return keyed
    some = keyed.join(again, "doc_id", "left_semi")
    met = some.select("doc_id", "cleaned_posts").join(some.drop("cleaned_posts"), "doc_id")
    return keyed.join(again, "doc_id", "left_anti").unionByName(stored(met))


@register
def compare_models_with_logistic(spark, sf):
    """F10 with the logistic heads as a third candidate (no SQL twin)."""
    rows = stored(_split_lab(spark, sf))  # cleaned and enriched once, read by every candidate
    sp, text = rows.select("doc_id", *HEAD_COLS, "split"), _texts_by_key(rows)
    train, val = text.where(F.col("split") == "train"), text.where(F.col("split") == "val")
    truth, tables = sp.where(F.col("split") == "val"), {}
    for name, ng in [("nb_unigram", 1), ("nb_bigram", 2)]:
        model = M.train_naive_bayes(train, "doc_id", "cleaned_posts", HEAD_COLS, ngram=ng, labels=HEAD_LABELS)
        scores = M.naive_bayes_scores(val, "doc_id", "cleaned_posts", model)
        tables[name] = _metrics(cut_lineage(_results(truth, M.argmax_rows(scores, ["doc_id", "head"]))))
    models = M.train_logistic_heads(train, "cleaned_posts", HEAD_COLS)
    preds = M.predict_logistic_heads(val, "doc_id", "cleaned_posts", models)
    tables["logistic"] = _metrics(cut_lineage(_results(truth, preds)))
    return M.compare_models(tables)


@register
def train_logistic_heads(spark, sf):
    sp = _split_lab(spark, sf)
    train, val = sp.where(F.col("split") == "train"), sp.where(F.col("split") == "val")
    models = M.train_logistic_heads(train, "cleaned_posts", HEAD_COLS)
    preds = M.predict_logistic_heads(val, "doc_id", "cleaned_posts", models)
    long = _long(_results(val.select("doc_id", *HEAD_COLS), preds))
    return long.groupBy("head").agg(F.avg((F.col("y_true") == F.col("y_pred")).cast("double")).alias("accuracy"))


def _joint(spark, sf):
    """The joint heads trained on the cleaned training split, and the rows held
    out."""
    from moodframe.operators.joint import train_joint_heads as train_joint
    sp = _split_lab(spark, sf)
    held = sp.where(F.col("split") == "val")
    return held, train_joint(sp.where(F.col("split") == "train"), held, "doc_id", "cleaned_posts", HEAD_COLS)


@register
def train_joint_heads(spark, sf):
    """F1 with a shared representation, F3 over its epochs (no SQL twin)."""
    losses = _joint(spark, sf)[1].losses
    return losses.select("epoch", "head", F.round("train_loss", 4).alias("train_loss"), F.round("loss", 4).alias("loss"), "is_best")


@register
def predict_joint_heads(spark, sf):
    """F6 by the best epoch's joint heads (no SQL twin)."""
    from moodframe.operators.joint import predict_joint
    held, model = _joint(spark, sf)
    return predict_joint(held, "doc_id", "cleaned_posts", model)


@register
def model_save(spark, sf):
    sp, model = _nb(spark, sf)
    path = scratch_dir(spark, "model")
    version = model.save(path, _codes(_heads(spark, sf)))
    return spark.read.parquet(f"{version}/class_params").select(
        "head", "class", F.col("n_docs").cast("bigint"), "n_tokens",
        F.round("log_prior", 8).alias("log_prior"), F.round("log_denom", 8).alias("log_denom"))


@register
def model_load(spark, sf):
    sp, model = _nb(spark, sf)
    path = scratch_dir(spark, "model")
    model.save(path)
    loaded = M.NaiveBayesModel.load(spark, path)
    return _val_preds(spark, sf, sp=sp, model=loaded)[2]


# --------------------------------------------------------- G evaluation
@register
def results_table(spark, sf):
    return _results_df(spark, sf)


@register
def confusion_matrix(spark, sf):
    return G.confusion_matrix(_long(_results_df(spark, sf)))


def _r6(df, cols):
    return df.select(*[F.round(c, 6).alias(c) if c in cols else F.col(c) for c in df.columns])


@register
def class_report(spark, sf):
    return _r6(G.class_report(_long(_results_df(spark, sf))), ["precision", "recall", "f1"])


@register
def report_averages(spark, sf):
    return _r6(G.report_averages(_long(_results_df(spark, sf))), ["precision", "recall", "f1"])


@register
def report_long(spark, sf):
    return _r6(G.report_long(_long(_results_df(spark, sf))), ["precision", "recall", "f1"])


@register
def type_emotion_relation(spark, sf):
    rel = G.relation(_results_df(spark, sf), "pred_type", "pred_emotion")
    return rel.select("pred_type", "pred_emotion", "n", F.round("share", 8).alias("share"))


@register
def type_emoji_relation(spark, sf):
    rel = G.relation(_results_df(spark, sf), "pred_type", "pred_emoji")
    return rel.select("pred_type", "pred_emoji", "n", F.round("share", 8).alias("share"))


@register
def relation_filled(spark, sf):
    labels = sorted(S.DEFAULT_PRIORS)
    wide = G.relation_filled(_results_df(spark, sf), "pred_type", "pred_emotion", labels)
    return wide.select("pred_type", *[F.round(F.col(l), 8).alias(l) for l in labels])


@register
def class_distribution_compare(spark, sf):
    lab = _heads(spark, sf)
    labels = None
    for h in HEAD_COLS:
        t = E.fit_codes(lab, h).select(F.lit(h).alias("head"), F.col("value").alias("label"))
        labels = t if labels is None else labels.unionByName(t)
    return G.class_distribution_compare(_long(_results_df(spark, sf)), labels)


@register
def top_predictions(spark, sf):
    res = _results_df(spark, sf)
    a = G.top_predictions(res, "pred_emotion").select(
        F.lit("pred_emotion").alias("column"), F.col("pred_emotion").alias("value"), "n")
    b = G.top_predictions(res, "pred_emoji").select(
        F.lit("pred_emoji").alias("column"), F.col("pred_emoji").alias("value"), "n")
    return a.unionByName(b)


@register
def prediction_histogram(spark, sf):
    return G.categorical_histogram(_results_df(spark, sf), "pred_emotion")


@register
def numeric_histogram(spark, sf):
    h = G.numeric_histogram(table(spark, sf, "events"), "value", 20)
    return h.select("bin", F.round("lo", 8).alias("lo"), F.round("hi", 8).alias("hi"), "n")


@register
def density_curve(spark, sf):
    d = G.density_curve(table(spark, sf, "events"), "value", 64)
    return d.select("point", F.round("x", 8).alias("x"), F.round("density", 10).alias("density"))


@register
def crosstab_margins(spark, sf):
    return G.crosstab_margins(_results_df(spark, sf), "true_emotion", "pred_emotion")


@register
def crosstab_normalised(spark, sf):
    c = G.crosstab_normalised(_results_df(spark, sf), "true_emotion", "pred_emotion")
    return c.select("row", "col", F.round("share", 8).alias("share"))


@register
def error_matrix(spark, sf):
    e = G.error_matrix(G.confusion_matrix(_long(_results_df(spark, sf))))
    return e.select("head", "y_true", "y_pred", F.round("error", 8).alias("error"))


FEATURE_COLS = ["n_chars", "n_words", "n_chunks", "quality", "toxic"]


def _features(spark, sf):
    d = table(spark, sf, "documents")
    c = T.clean_text("text")
    feats = d.select("doc_id", "lang", "n_chars",
                     F.size(T.tokenize_words(c)).cast("bigint").alias("n_words"),
                     F.size(T.chunk_text(c)).cast("bigint").alias("n_chunks"))
    return feats.join(table(spark, sf, "labels"), "doc_id", "left")


@register
def correlation_matrix(spark, sf):
    c = G.correlation_matrix(_features(spark, sf), FEATURE_COLS)
    return c.select("a", "b", F.round("corr", 8).alias("corr"))


def _roc_input(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "n_chars").join(
        table(spark, sf, "labels").select("doc_id", "toxic"), "doc_id")


@register
def roc_curve(spark, sf):
    r = G.roc_curve(_roc_input(spark, sf), "n_chars", "toxic")
    return r.select("threshold", F.round("fpr", 8).alias("fpr"), F.round("tpr", 8).alias("tpr"))


@register
def roc_auc(spark, sf):
    return G.roc_auc(_roc_input(spark, sf), "n_chars", "toxic").select(
        F.round("auc", 8).alias("auc"))


@register
def pair_features_by_class(spark, sf):
    m = G.pair_moments_by_class(_features(spark, sf), "lang", ["n_chars", "n_words", "n_chunks"])
    return m.select("lang", "a", "b", "n", *[F.round(c, 4).alias(c) for c in
                                           ["mean_a", "mean_b", "std_a", "std_b", "cov"]])


@register
def pair_bins_by_class(spark, sf):
    return G.pair_bins_by_class(_features(spark, sf), "lang", "n_chars", "n_words", 10)


@register
def labels_present(spark, sf):
    return G.labels_present(_long(_results_df(spark, sf)))


# ------------------------------------------------------- H conversations
from moodframe.operators import conversation as C  # noqa: E402


def _turns(spark, sf):
    return C.conversation_turns(table(spark, sf, "conversations"))


def _kept(spark, sf):
    return C.conversation_cut(_turns(spark, sf))


@register
def conversation_turns(spark, sf):
    return _turns(spark, sf).select("conv_id", "turn", "role", "text")


@register
def exit_detect(spark, sf):
    return _turns(spark, sf).select("conv_id", "turn", "role", C.is_exit().alias("is_exit"))


@register
def conversation_cut(spark, sf):
    return _kept(spark, sf).select("conv_id", "turn", "role", "text", "ended")


@register
def conversation_text(spark, sf):
    return C.conversation_text(_kept(spark, sf))


@register
def prompt_text(spark, sf):
    return C.conversation_text(_kept(spark, sf), sep="\n").select(
        "conv_id", F.col("text").alias("prompt"))


@register
def last_turn_prompt(spark, sf):
    return C.last_turn_prompt(_kept(spark, sf))


@register
def last_three_turns_prompt(spark, sf):
    """H6 with a history of three user turns."""
    return C.last_turns(_kept(spark, sf), 3)


@register
def role_prefixed_transcript(spark, sf):
    return C.role_prefixed_transcript(_kept(spark, sf))


def _segments(spark, sf):
    return C.segment_emotions(_kept(spark, sf), S.LexiconScorer(fx.lexicon(spark)))


@register
def segment_emotions(spark, sf):
    return _segments(spark, sf).select("conv_id", "turn", "emotion", "emoji")


@register
def emotion_frequency(spark, sf):
    return C.emotion_frequency(_segments(spark, sf))


@register
def dominant_emotion(spark, sf):
    return C.dominant_emotion(C.emotion_frequency(_segments(spark, sf)))


@register
def conversation_summary(spark, sf):
    _, model = _nb(spark, sf)
    return C.conversation_summary(_kept(spark, sf), S.LexiconScorer(fx.lexicon(spark)), model)


def _land_in_batches(df, path, key_cols, n_batches=5):
    """Write a table as ``n_batches`` appends, rows scattered by a seeded hash
    of their key, so one conversation's turns arrive over several batches
    and out of turn order."""
    from moodframe.functions.hashing import md5int
    b = df.withColumn("_b", F.pmod(md5int(F.lit("batch"), *key_cols), F.lit(n_batches)))
    for i in range(n_batches):
        b.where(F.col("_b") == i).drop("_b").write.mode("append").parquet(path)


def _files_per_trigger(spark, path, micro_batches=3):
    """Files per trigger so the landed files arrive in about
    ``micro_batches`` micro-batches (a file listing, no data read)."""
    import math
    n_files = len(spark.read.parquet(path).inputFiles())
    return max(1, math.ceil(n_files / micro_batches))


@register
def stream_conversation_summary(spark, sf):
    from moodframe.streaming.conversations import run_conversation_stream
    src = scratch_dir(spark, "conv-landing")
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    _land_in_batches(turns, src, ["conv_id", "turn"])
    _, model = _nb(spark, sf)
    return run_conversation_stream(spark, src, "conv_id bigint, turn bigint, role string, text string",
                                   S.LexiconScorer(fx.lexicon(spark)), model,
                                   files_per_batch=_files_per_trigger(spark, src))


@register
def stream_enrich_posts(spark, sf):
    from moodframe.streaming.posts import run_enrich_stream
    src = scratch_dir(spark, "posts-landing")
    _land_in_batches(fx.posts_v(spark, sf), src, ["doc_id"], 4)
    from moodframe.sources.io import POSTS_SCHEMA
    return run_enrich_stream(spark, src, POSTS_SCHEMA, S.LexiconScorer(fx.lexicon(spark), in_row=True),
                             files_per_batch=_files_per_trigger(spark, src))


# ----------------------------------------------------- A sources / sinks
from moodframe.sources import io as IO  # noqa: E402


@register
def read_posts_csv(spark, sf):
    path = scratch_dir(spark, "posts-csv")
    IO.write_csv(fx.posts_v(spark, sf), path)
    return IO.read_posts_csv(spark, path)


@register
def write_enriched(spark, sf):
    e = enriched(spark, sf).select("doc_id", "type", "lang", "posts", "n_chars", "cleaned_posts",
                                   "emotion", "emoji")
    base = scratch_dir(spark, "enriched")
    IO.write_parquet(e, f"{base}/parquet")
    e = IO.read_parquet(spark, f"{base}/parquet")
    IO.write_csv(e, f"{base}/csv")
    cols = ["doc_id", "type", "emotion", "emoji", "posts", "cleaned_posts"]
    pq = IO.table_checksum(e, cols)
    cs = IO.table_checksum(IO.read_csv(spark, f"{base}/csv", IO.ENRICHED_SCHEMA), cols)
    return (pq.select(F.lit("parquet").alias("format"), "*")
            .unionByName(cs.select(F.lit("csv").alias("format"), "*")))


@register
def preview_head(spark, sf):
    # the five posts first, then only they are scored
    posts = fx.posts_v(spark, sf)
    first = IO.preview_head(posts, posts.columns, "doc_id")
    return S.enrich_posts(first, S.LexiconScorer(fx.lexicon(spark), in_row=True)).select("doc_id", "type", "emotion", "emoji")


@register
def smote(spark, sf):
    s = D.synthetic_oversample(table(spark, sf, "embeddings"), "label", ["vec_id"], "embedding")
    return s.select(F.col("label").cast("bigint").alias("label"), "k", "base_vec_id",
                    "partner_vec_id", F.round("u", 8).alias("u"),
                    F.posexplode("embedding").alias("dim", "value")) \
        .select("label", "k", "base_vec_id", "partner_vec_id", "u", F.col("dim").cast("bigint"),
                F.round("value", 6).alias("value"))
