"""DuckDB twins of the registered queries (tables are the driver's views)."""

from __future__ import annotations

from moodframe.plans import sqlparts as P

ORACLE: dict[str, str] = {}

_DOCS = "documents"

# --------------------------------------------------------------------- B text
ORACLE["strip_urls"] = f"SELECT doc_id, regexp_replace(text, {P.q(P.URL)}, '', 'g') AS out FROM {_DOCS}"
ORACLE["strip_mentions_hash_digits"] = (
    f"SELECT doc_id, regexp_replace(text, {P.q(P.MHD)}, '', 'g') AS out FROM {_DOCS}")
ORACLE["strip_non_letters"] = (
    f"SELECT doc_id, regexp_replace(text, {P.q(P.NONLET)}, '', 'g') AS out FROM {_DOCS}")
ORACLE["collapse_ws"] = (
    f"SELECT doc_id, trim(regexp_replace(text, {P.q(P.WSRUN)}, ' ', 'g')) AS out FROM {_DOCS}")
ORACLE["clean_text"] = f"SELECT doc_id, {P.clean('text')} AS cleaned_posts FROM {_DOCS}"
ORACLE["normalize_lower"] = f"SELECT doc_id, {P.normalize_lower('text')} AS out FROM {_DOCS}"
_TOK = P.tokens(P.normalize_lower("text"))
ORACLE["tokenize_words"] = (
    f"SELECT doc_id, CAST(len(t) AS BIGINT) AS n_tokens, array_to_string(t, '|') AS tokens "
    f"FROM (SELECT doc_id, {_TOK} AS t FROM {_DOCS})")

_STOP_CTE = f"stop AS {P.STOP_V}"
ORACLE["remove_stopwords"] = f"""
WITH {_STOP_CTE},
toks AS (SELECT doc_id, CAST(unnest(range(0, len(t))) AS BIGINT) AS pos, unnest(t) AS tok
         FROM (SELECT doc_id, {_TOK} AS t FROM {_DOCS})),
kept AS (SELECT doc_id, pos, tok FROM toks WHERE tok NOT IN (SELECT word FROM stop))
SELECT d.doc_id, CAST(COUNT(k.tok) AS BIGINT) AS n_kept,
       COALESCE(string_agg(k.tok, '|' ORDER BY k.pos), '') AS kept
FROM {_DOCS} d LEFT JOIN kept k USING (doc_id) GROUP BY d.doc_id
"""
_LEMMA_CTES = f"""{_STOP_CTE},
toks AS (SELECT doc_id, CAST(unnest(range(0, len(t))) AS BIGINT) AS pos, unnest(t) AS tok
         FROM (SELECT doc_id, {_TOK} AS t FROM {_DOCS})),
kept AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS pos, tok
         FROM toks WHERE tok NOT IN (SELECT word FROM stop)),
lem AS (SELECT k.doc_id, k.pos, COALESCE(l.lemma, k.tok) AS tok
        FROM kept k LEFT JOIN {P.LEMMA_V} l ON k.tok = l.form)"""
ORACLE["lemmatize_tokens"] = f"""
WITH {_LEMMA_CTES}
SELECT d.doc_id, CAST(COUNT(l.tok) AS BIGINT) AS n_lemmas,
       COALESCE(string_agg(l.tok, '|' ORDER BY l.pos), '') AS lemmas
FROM {_DOCS} d LEFT JOIN lem l USING (doc_id) GROUP BY d.doc_id
"""
ORACLE["readme_clean"] = f"""
WITH {_LEMMA_CTES}
SELECT d.doc_id, COALESCE(string_agg(l.tok, ' ' ORDER BY l.pos), '') AS cleaned
FROM {_DOCS} d LEFT JOIN lem l USING (doc_id) GROUP BY d.doc_id
"""
ORACLE["rejoin_tokens"] = (
    f"SELECT doc_id, array_to_string({P.tokens(P.clean('text'))}, ' ') AS rejoined FROM {_DOCS}")
ORACLE["chunk_text"] = f"""
WITH cl AS (SELECT doc_id, {P.chunks(P.clean('text'))} AS c FROM {_DOCS})
SELECT doc_id, CAST(unnest(range(0, len(c))) AS BIGINT) AS chunk_idx, unnest(c) AS chunk,
       CAST(length(unnest(c)) AS BIGINT) AS chunk_len FROM cl
"""

# ------------------------------------------------------------------ C scoring
_E = f"WITH {P.ENRICH_CTES}"
ORACLE["score_chunks"] = f"{_E} SELECT doc_id, chunk_idx, label, round(score, 8) AS score FROM scored"
ORACLE["score_chunks_by_phrases"] = f"""
WITH chunk_lists AS (SELECT doc_id, {P.chunks('cleaned')} AS cl FROM (SELECT doc_id, {P.clean('text')} AS cleaned FROM {_DOCS})),
chunk_words AS (SELECT doc_id, chunk_idx, string_split(lower(chunk), ' ') AS w FROM (
  SELECT doc_id, CAST(unnest(range(0, len(cl))) AS BIGINT) AS chunk_idx, unnest(cl) AS chunk FROM chunk_lists)),
runs AS (SELECT doc_id, chunk_idx, unnest(w) AS phrase FROM chunk_words
  UNION ALL SELECT doc_id, chunk_idx, a || ' ' || b AS phrase FROM (
    SELECT doc_id, chunk_idx, unnest(w[:-2]) AS a, unnest(w[2:]) AS b FROM chunk_words WHERE len(w) > 1)),
hits AS (SELECT r.doc_id, r.chunk_idx, p.label, SUM(p.weight) AS h FROM runs r JOIN {P.PHRASES_V} p USING (phrase) GROUP BY ALL),
total AS (SELECT doc_id, chunk_idx, SUM(h) AS h_total FROM hits GROUP BY ALL),
cand AS (SELECT c.doc_id, c.chunk_idx, p.label, COALESCE(h.h, 0.0) + p.prior AS v, COALESCE(t.h_total, 0.0) AS h_total
  FROM chunk_words c CROSS JOIN {P.PRIORS_V} p LEFT JOIN total t ON t.doc_id = c.doc_id AND t.chunk_idx = c.chunk_idx
  LEFT JOIN hits h ON h.doc_id = c.doc_id AND h.chunk_idx = c.chunk_idx AND h.label = p.label)
SELECT doc_id, chunk_idx, label, round(v / (h_total + {P.TOTAL_PRIOR}), 8) AS score FROM cand
QUALIFY row_number() OVER (PARTITION BY doc_id, chunk_idx ORDER BY v DESC, label) = 1
"""
ORACLE["emotion_vote"] = f"""{_E}
SELECT doc_id, label AS vote_emotion FROM (
  SELECT doc_id, label, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first_idx) AS rn
  FROM (SELECT doc_id, label, COUNT(*) AS n, MIN(chunk_idx) AS first_idx FROM scored GROUP BY 1, 2))
WHERE rn = 1
"""
ORACLE["emotion_mean_scores"] = (
    f"{_E} SELECT doc_id, label, round(mean_score, 8) AS mean_score, n_chunks, first_idx FROM means")
ORACLE["assign_emotion"] = f"{_E} SELECT doc_id, emotion FROM assigned"
ORACLE["enrich_posts"] = f"{_E} SELECT * FROM enriched"
ORACLE["emotion_to_emoji"] = f"""{_E}
SELECT doc_id, emo AS emotion, {P.emoji('emo')} AS emoji FROM (
  SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN upper(emotion) ELSE emotion END AS emo FROM enriched)
"""

# ---------------------------------------------------------------- D balancing
from moodframe.functions.hashing import md5int_sql as H  # noqa: E402

_ENR = (f"WITH {P.ENRICH_CTES}, enr AS (SELECT doc_id, type, lang, emotion, emoji, "
        f"md5(cleaned_posts) AS text_key FROM enriched)")
ORACLE["class_counts"] = (f"{_ENR} SELECT emotion, COUNT(*) AS n FROM enr "
                          f"WHERE emotion IS NOT NULL GROUP BY emotion")
ORACLE["max_class_count"] = f"""{_ENR}
SELECT 'emotion' AS column, MAX(n) AS max_n FROM (
  SELECT COUNT(*) AS n FROM enr WHERE emotion IS NOT NULL GROUP BY emotion)
UNION ALL
SELECT 'type' AS column, MAX(n) AS max_n FROM (
  SELECT COUNT(*) AS n FROM enr WHERE type IS NOT NULL GROUP BY type)
"""
ORACLE["distinct_classes"] = f"""{_ENR}
SELECT emotion, first_seen, row_number() OVER (ORDER BY first_seen, emotion) - 1 AS ordinal
FROM (SELECT emotion, MIN(doc_id) AS first_seen FROM enr WHERE emotion IS NOT NULL GROUP BY emotion)
"""
ORACLE["class_filter"] = f"{_ENR} SELECT doc_id, type, emotion FROM enr WHERE emotion = 'joy'"
ORACLE["union_classes"] = f"{_ENR} " + " UNION ALL ".join(
    f"SELECT doc_id, emotion FROM enr WHERE emotion = {P.q(l)}" for l in P.LABELS)


def _oversample_sql(src: str, cls: str, keys: list[str], target_sql: str, draw: str) -> str:
    """CTE body: bootstrap every class of ``src`` to ``target_sql`` rows."""
    kh = H("'row'", *keys)
    ks = ", ".join(keys)
    return f"""(
  WITH s AS (SELECT * FROM {src} WHERE {cls} IS NOT NULL),
  ix AS (SELECT *, row_number() OVER (PARTITION BY {cls} ORDER BY {kh}, {ks}) - 1 AS _idx FROM s),
  sz AS (SELECT {cls} AS _c, COUNT(*) AS n_c FROM s GROUP BY 1),
  dr AS (SELECT _c, n_c, unnest(range(0, CAST(({target_sql}) AS BIGINT))) AS {draw} FROM sz),
  dx AS (SELECT _c, {draw}, {H('_c', draw)} % n_c AS _idx FROM dr)
  SELECT ix.* EXCLUDE (_idx), dx.{draw} FROM dx JOIN ix ON ix.{cls} = dx._c AND ix._idx = dx._idx)"""


_MAX_OF = "SELECT MAX(n) FROM (SELECT COUNT(*) AS n FROM enr WHERE {c} IS NOT NULL GROUP BY {c})"
ORACLE["oversample_one_key"] = f"""{_ENR},
o AS {_oversample_sql('enr', 'type', ['doc_id'], _MAX_OF.format(c='type'), 'draw')}
SELECT type, draw, doc_id, emotion FROM o
"""
_TWO_PASS = f"""{_ENR},
p1 AS {_oversample_sql('enr', 'emotion', ['doc_id'], _MAX_OF.format(c='emotion'), 'draw1')},
p2 AS {_oversample_sql('p1', 'type', ['emotion', 'draw1'], _MAX_OF.format(c='type'), 'draw2')}"""
ORACLE["balance_two_pass"] = f"{_TWO_PASS} SELECT type, draw2, emotion, draw1, doc_id FROM p2"
ORACLE["shuffle_reindex"] = f"""{_TWO_PASS}
SELECT row_number() OVER (ORDER BY {H("'shuffle'", 'type', 'draw2')}, type, draw2) - 1 AS row_idx,
       type, emotion, doc_id FROM p2
"""
ORACLE["undersample"] = f"""{_ENR},
ix AS (SELECT *, row_number() OVER (PARTITION BY type ORDER BY {H("'under'", 'doc_id')}, doc_id) - 1 AS _i
       FROM enr WHERE type IS NOT NULL),
m AS (SELECT MIN(n) AS m FROM (SELECT COUNT(*) AS n FROM enr WHERE type IS NOT NULL GROUP BY type))
SELECT doc_id, type, emotion FROM ix, m WHERE _i < m.m
"""
ORACLE["balance_before_after"] = f"""{_TWO_PASS},
""" + ",\n".join(
    f"""b_{c} AS (SELECT {c} AS class, COUNT(*) AS n FROM enr WHERE {c} IS NOT NULL GROUP BY 1),
a_{c} AS (SELECT {c} AS class, COUNT(*) AS n FROM p2 WHERE {c} IS NOT NULL GROUP BY 1)"""
    for c in ["emotion", "type"]) + "\n" + " UNION ALL ".join(
    f"""SELECT '{c}' AS column, COALESCE(b.class, a.class) AS class,
       CAST(COALESCE(b.n, 0) AS BIGINT) AS n_before, CAST(COALESCE(a.n, 0) AS BIGINT) AS n_after
FROM b_{c} b FULL OUTER JOIN a_{c} a ON b.class = a.class""" for c in ["emotion", "type"])
_WEIGHTS = """w AS (SELECT emotion, n, round(SUM(n) OVER () / (COUNT(*) OVER () * n), 8) AS weight
       FROM (SELECT emotion, COUNT(*) AS n FROM enr WHERE emotion IS NOT NULL GROUP BY 1))"""
ORACLE["class_weights"] = f"{_ENR}, {_WEIGHTS} SELECT * FROM w"
ORACLE["class_count_check"] = f"""{_ENR}, {_WEIGHTS}
SELECT 'n_classes(emotion)' AS "check", CAST(7 AS BIGINT) AS expected,
       CAST(COUNT(DISTINCT emotion) AS BIGINT) AS actual, COUNT(DISTINCT emotion) = 7 AS ok FROM enr
UNION ALL
SELECT 'n_weights', CAST(7 AS BIGINT), CAST(COUNT(*) AS BIGINT), COUNT(*) = 7 FROM w
"""


# ------------------------------------------------------------- E preparation
_HEADS = ["type", "emotion", "emoji"]
_LAB = f"WITH {P.ENRICH_CTES}, lab AS (SELECT doc_id, cleaned_posts, type, emotion, emoji FROM enriched)"
_CODES = ",\n".join(
    f"""codes_{c} AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS code
    FROM (SELECT DISTINCT {c} AS value FROM lab WHERE {c} IS NOT NULL))""" for c in _HEADS)
_ENC = f"""{_LAB}, {_CODES},
enc AS (SELECT lab.*, {", ".join(f"codes_{c}.code AS label_{c}" for c in _HEADS)} FROM lab
        {" ".join(f"LEFT JOIN codes_{c} ON lab.{c} = codes_{c}.value" for c in _HEADS)})"""
ORACLE["encode_labels"] = f"{_ENC} SELECT doc_id, label_type, label_emotion, label_emoji FROM enc"
ORACLE["decode_labels"] = f"""{_ENC}
SELECT enc.doc_id, {", ".join(f"d_{c}.value AS {c}" for c in _HEADS)} FROM enc
{" ".join(f"LEFT JOIN codes_{c} d_{c} ON enc.label_{c} = d_{c}.code" for c in _HEADS)}
"""


def _split_sql(src: str, unit: list[str], frac: float = 0.2) -> str:
    u = ", ".join(unit)
    return f"""(SELECT {u}, CASE WHEN row_number() OVER (ORDER BY {H("'split'", *unit)}, {u}) - 1
                  < CAST(ceil({frac} * COUNT(*) OVER ()) AS BIGINT) THEN 'val' ELSE 'train' END AS split
  FROM (SELECT DISTINCT {u} FROM {src}))"""


_SPLIT = f"{_ENC}, sp AS (SELECT enc.*, s.split FROM enc JOIN {_split_sql('enc', ['doc_id'])} s USING (doc_id))"
ORACLE["train_val_split"] = f"{_SPLIT} SELECT doc_id, split FROM sp"


def _leak_sql(src: str, mode: str) -> str:
    return f"""SELECT '{mode}' AS mode, CAST(COUNT(*) AS BIGINT) AS n_val,
       CAST(COUNT(t.text_key) AS BIGINT) AS n_leaked
FROM (SELECT * FROM {src} WHERE split = 'val') v
LEFT JOIN (SELECT DISTINCT text_key FROM {src} WHERE split = 'train') t USING (text_key)"""


ORACLE["split_leakage"] = f"""{_TWO_PASS},
r AS (SELECT p2.*, s.split FROM p2 JOIN {_split_sql('p2', ['type', 'draw2'])} s USING (type, draw2)),
g AS (SELECT p2.*, s.split FROM p2 JOIN {_split_sql('p2', ['text_key'])} s USING (text_key))
{_leak_sql('r', 'row')} UNION ALL {_leak_sql('g', 'text_group')}
"""
_VOCAB = f"""{_LAB},
vt AS (SELECT unnest(list_filter(string_split(lower(cleaned_posts), ' '), lambda x: x <> '')) AS token FROM lab),
vc AS (SELECT token, COUNT(*) AS n FROM vt GROUP BY token),
vocab AS (SELECT * FROM (VALUES ('[PAD]', 0, 0), ('[UNK]', 1, 0), ('[CLS]', 2, 0), ('[SEP]', 3, 0))
            AS s(token, token_id, n)
          UNION ALL
          SELECT token, token_id, n FROM (
            SELECT token, row_number() OVER (ORDER BY n DESC, token) + 3 AS token_id, n FROM vc))"""
ORACLE["build_vocabulary"] = f"{_VOCAB} SELECT token, CAST(token_id AS BIGINT) AS token_id, CAST(n AS BIGINT) AS n FROM vocab"
_TOKENS = f"""{_VOCAB},
dl AS (SELECT doc_id, list_filter(string_split(lower(cleaned_posts), ' '), lambda x: x <> '') AS t FROM lab),
dt AS (SELECT doc_id, unnest(range(0, len(t))) AS pos, unnest(t) AS token FROM dl),
di AS (SELECT dt.doc_id, dt.pos, COALESCE(v.token_id, 1) AS id FROM dt LEFT JOIN vocab v USING (token)
       WHERE dt.pos < 510),
ds AS (SELECT l.doc_id, COUNT(di.id) AS n, string_agg(CAST(di.id AS VARCHAR), ' ' ORDER BY di.pos) AS s
       FROM lab l LEFT JOIN di USING (doc_id) GROUP BY l.doc_id),
tk AS (SELECT doc_id, CAST(n + 2 AS BIGINT) AS n_real, CAST(512 AS BIGINT) AS n_ids,
              '2' || COALESCE(' ' || s, '') || ' 3' || repeat(' 0', CAST(510 - n AS INTEGER)) AS ids FROM ds)"""
ORACLE["encode_tokens"] = f"{_TOKENS} SELECT * FROM tk"
ORACLE["training_rows"] = f"""{_TOKENS}, {_CODES},
enc AS (SELECT lab.*, {", ".join(f"codes_{c}.code AS label_{c}" for c in _HEADS)} FROM lab
        {" ".join(f"LEFT JOIN codes_{c} ON lab.{c} = codes_{c}.value" for c in _HEADS)}),
sp AS (SELECT enc.*, s.split FROM enc JOIN {_split_sql('enc', ['doc_id'])} s USING (doc_id))
SELECT sp.doc_id, sp.split, sp.label_type, sp.label_emotion, sp.label_emoji, tk.n_real
FROM sp JOIN tk USING (doc_id)
"""


# ------------------------------------------------------------ F models
def _feats(x: str, ngram: int) -> str:
    uni = f"list_filter(string_split(lower({x}), ' '), lambda t: t <> '')"
    if ngram == 1:
        return uni
    return (f"list_concat({uni}, list_transform(range(1, len({uni})), "
            f"lambda i: ({uni})[i] || ' ' || ({uni})[i + 1]))")


def _heads_union(src: str, extra: str) -> str:
    return " UNION ALL ".join(f"SELECT {extra}'{h}' AS head, {h} AS class FROM {src}" for h in _HEADS)


def _nb_ctes(alpha: float = 1.0, ngram: int = 1, sfx: str = "") -> str:
    """Train on the train split, score the val split (CTE names end in sfx)."""
    a = f"CAST({alpha!r} AS DOUBLE)"
    return f"""
tr_tok{sfx} AS (SELECT doc_id, type, emotion, emoji, unnest({_feats('cleaned_posts', ngram)}) AS token
           FROM sp WHERE split = 'train'),
nwc{sfx} AS (SELECT head, class, token, COUNT(*) AS n FROM ({_heads_union(f'tr_tok{sfx}', 'token, ')})
        WHERE class IS NOT NULL GROUP BY ALL),
vsize{sfx} AS (SELECT COUNT(DISTINCT token) AS v FROM tr_tok{sfx}),
ndocs{sfx} AS (SELECT head, class, COUNT(*) AS n_docs FROM (
          {_heads_union("(SELECT * FROM sp WHERE split = 'train')", '')}) WHERE class IS NOT NULL GROUP BY ALL),
ntok{sfx} AS (SELECT head, class, SUM(n) AS n_tokens FROM nwc{sfx} GROUP BY ALL),
cp{sfx} AS (SELECT d.head, d.class, d.n_docs, CAST(COALESCE(t.n_tokens, 0) AS BIGINT) AS n_tokens,
        ln(d.n_docs / SUM(d.n_docs) OVER (PARTITION BY d.head)) AS log_prior,
        ln(CAST(COALESCE(t.n_tokens, 0) AS DOUBLE) + {a} * vsize{sfx}.v) - ln({a}) AS log_denom
      FROM ndocs{sfx} d LEFT JOIN ntok{sfx} t USING (head, class) CROSS JOIN vsize{sfx}),
tp{sfx} AS (SELECT head, class, token, ln(n + {a}) - ln({a}) AS lw FROM nwc{sfx}),
va_tok{sfx} AS (SELECT doc_id, token, COUNT(*) AS cnt FROM (
           SELECT doc_id, unnest({_feats('cleaned_posts', ngram)}) AS token FROM sp WHERE split = 'val')
           GROUP BY ALL),
vlen{sfx} AS (SELECT v.doc_id, COALESCE(SUM(CASE WHEN vo.token IS NOT NULL THEN t.cnt END), 0) AS len
         FROM (SELECT doc_id FROM sp WHERE split = 'val') v
         LEFT JOIN va_tok{sfx} t USING (doc_id)
         LEFT JOIN (SELECT DISTINCT token FROM tr_tok{sfx}) vo ON t.token = vo.token GROUP BY v.doc_id),
matched{sfx} AS (SELECT t.doc_id, p.head, p.class, SUM(t.cnt * p.lw) AS m
            FROM va_tok{sfx} t JOIN tp{sfx} p USING (token) GROUP BY ALL),
scores{sfx} AS (SELECT l.doc_id, c.head, c.class,
                  c.log_prior - l.len * c.log_denom + COALESCE(m.m, 0) AS score
           FROM vlen{sfx} l CROSS JOIN cp{sfx} c
           LEFT JOIN matched{sfx} m ON m.doc_id = l.doc_id AND m.head = c.head AND m.class = c.class),
preds{sfx} AS (SELECT doc_id, head, class AS pred FROM (
            SELECT *, row_number() OVER (PARTITION BY doc_id, head ORDER BY round(score, 6) DESC, class) AS rn
            FROM scores{sfx}) WHERE rn = 1),
probs{sfx} AS (SELECT *, e / SUM(e) OVER (PARTITION BY doc_id, head) AS prob FROM (
             SELECT *, exp(score - MAX(score) OVER (PARTITION BY doc_id, head)) AS e FROM scores{sfx})),
loss{sfx} AS (SELECT t.head, AVG(-ln(greatest(COALESCE(p.prob, 0), 1e-15))) AS loss
         FROM ({_heads_union("(SELECT * FROM sp WHERE split = 'val')", 'doc_id, ')}) t LEFT JOIN probs{sfx} p
         ON p.doc_id = t.doc_id AND p.head = t.head AND p.class = t.class WHERE t.class IS NOT NULL GROUP BY t.head),
results{sfx} AS (SELECT v.doc_id, v.type AS true_type, pt.pred AS pred_type, v.emotion AS true_emotion,
                   pe.pred AS pred_emotion, v.emoji AS true_emoji, pj.pred AS pred_emoji
            FROM (SELECT * FROM sp WHERE split = 'val') v
            JOIN preds{sfx} pt ON pt.doc_id = v.doc_id AND pt.head = 'type'
            JOIN preds{sfx} pe ON pe.doc_id = v.doc_id AND pe.head = 'emotion'
            JOIN preds{sfx} pj ON pj.doc_id = v.doc_id AND pj.head = 'emoji')"""


_SPLIT_LAB = f"{_LAB}, sp AS (SELECT lab.*, s.split FROM lab JOIN {_split_sql('lab', ['doc_id'])} s USING (doc_id))"
_NB = f"{_SPLIT_LAB}, {_nb_ctes()}"
_CP_OUT = ("SELECT head, class, CAST(n_docs AS BIGINT) AS n_docs, n_tokens, round(log_prior, 8) AS log_prior, "
           "round(log_denom, 8) AS log_denom FROM cp")
ORACLE["train_multi_head"] = f"{_NB} {_CP_OUT}"
ORACLE["model_save"] = ORACLE["train_multi_head"]
ORACLE["predict_heads"] = f"{_NB} SELECT doc_id, head, pred FROM preds"
ORACLE["model_load"] = ORACLE["predict_heads"]
ORACLE["joint_loss"] = f"""{_NB}
SELECT head, round(loss, 6) AS loss FROM loss
UNION ALL SELECT 'sum', round(SUM(loss), 6) FROM loss
"""
ORACLE["select_best_candidate"] = f"""{_SPLIT_LAB}, {",".join(_nb_ctes(a, 1, f"_{i}") for i, a in enumerate([0.5, 1.0, 2.0]))},
c AS ({" UNION ALL ".join(f"SELECT CAST({a!r} AS DOUBLE) AS alpha, round(SUM(loss), 6) AS loss FROM loss_{i}"
                          for i, a in enumerate([0.5, 1.0, 2.0]))})
SELECT alpha, loss, alpha = (SELECT alpha FROM c ORDER BY loss, alpha LIMIT 1) AS is_best FROM c
"""
_HEAD_PARAMS = """
ex AS (SELECT vec_id, label, unnest(embedding) AS x, unnest(range(0, len(embedding))) AS pos FROM embeddings),
cen AS (SELECT label, pos, round(AVG(CAST(x AS DOUBLE)), 6) AS w FROM ex GROUP BY ALL),
bias AS (SELECT label, -0.5 * SUM(w * w) AS b FROM cen GROUP BY label),
logit AS (SELECT e.vec_id, c.label, SUM(CAST(e.x AS DOUBLE) * c.w) + b.b AS logit
          FROM ex e JOIN cen c USING (pos) JOIN bias b ON b.label = c.label GROUP BY e.vec_id, c.label, b.b)"""
ORACLE["logits_linear_head"] = (f"WITH {_HEAD_PARAMS} SELECT vec_id, CAST(label AS BIGINT) AS label, "
                                f"round(logit, 5) AS logit FROM logit")
ORACLE["argmax_class"] = f"""WITH {_HEAD_PARAMS}
SELECT vec_id, CAST(label AS BIGINT) AS pred_label FROM (
  SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY logit DESC, label) AS rn FROM logit) WHERE rn = 1
"""
ORACLE["predict_table"] = f"""{_SPLIT_LAB}, {_nb_ctes()},
all_tok AS (SELECT doc_id, token, COUNT(*) AS cnt FROM (
            SELECT doc_id, unnest({_feats('cleaned_posts', 1)}) AS token FROM sp) GROUP BY ALL),
alen AS (SELECT d.doc_id, COALESCE(SUM(CASE WHEN vo.token IS NOT NULL THEN t.cnt END), 0) AS len
         FROM sp d LEFT JOIN all_tok t USING (doc_id)
         LEFT JOIN (SELECT DISTINCT token FROM tr_tok) vo ON t.token = vo.token GROUP BY d.doc_id),
am AS (SELECT t.doc_id, p.class, SUM(t.cnt * p.lw) AS m FROM all_tok t
       JOIN (SELECT * FROM tp WHERE head = 'type') p USING (token) GROUP BY ALL),
asc_ AS (SELECT l.doc_id, c.class, c.log_prior - l.len * c.log_denom + COALESCE(m.m, 0) AS score
         FROM alen l CROSS JOIN (SELECT * FROM cp WHERE head = 'type') c
         LEFT JOIN am m ON m.doc_id = l.doc_id AND m.class = c.class),
ap AS (SELECT doc_id, class AS predicted_type FROM (
       SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 6) DESC, class) AS rn FROM asc_)
       WHERE rn = 1)
SELECT sp.doc_id, sp.type, sp.emotion, sp.emoji, ap.predicted_type FROM sp LEFT JOIN ap USING (doc_id)
"""
ORACLE["code_lookup_default"] = f"""{_SPLIT_LAB}, {_CODES}, {_nb_ctes()},
pc AS (SELECT p.doc_id, p.head, c.code FROM preds p
       LEFT JOIN (SELECT 'type' AS head, * FROM codes_type UNION ALL SELECT 'emotion', * FROM codes_emotion
                  UNION ALL SELECT 'emoji', * FROM codes_emoji) c ON c.head = p.head AND c.value = p.pred)
SELECT d.doc_id,
  COALESCE((SELECT value FROM codes_type WHERE code = t.code), 'Unknown') AS personality,
  COALESCE((SELECT value FROM codes_emotion WHERE code = e.code), 'neutral') AS emotion,
  COALESCE((SELECT value FROM codes_emoji WHERE code = j.code), {P.q(P.EMOJI_MAP['neutral'])}) AS emoji
FROM (SELECT DISTINCT doc_id FROM pc) d
JOIN pc t ON t.doc_id = d.doc_id AND t.head = 'type'
JOIN pc e ON e.doc_id = d.doc_id AND e.head = 'emotion'
JOIN pc j ON j.doc_id = d.doc_id AND j.head = 'emoji'
"""
ORACLE["sequence_pooling"] = """
WITH ends AS (SELECT label, MIN(vec_id) AS first_vec_id, MAX(vec_id) AS last_vec_id FROM embeddings GROUP BY label),
ex AS (SELECT label, unnest(embedding) AS x, unnest(range(0, len(embedding))) AS dim FROM embeddings),
mn AS (SELECT label, dim, AVG(CAST(x AS DOUBLE)) AS mean FROM ex GROUP BY ALL)
SELECT CAST(label AS BIGINT) AS label, first_vec_id, last_vec_id, CAST(dim AS BIGINT) AS dim,
       round(mean, 6) AS mean FROM mn JOIN ends USING (label)
"""

# --------------------------------------------------------- G evaluation
_LONG = """long AS (SELECT 'type' AS head, true_type AS y_true, pred_type AS y_pred FROM results
  UNION ALL SELECT 'emotion', true_emotion, pred_emotion FROM results
  UNION ALL SELECT 'emoji', true_emoji, pred_emoji FROM results)"""
_REPORT = f"""{_LONG},
cm_counts AS (SELECT head, y_true, y_pred, COUNT(*) AS n FROM long GROUP BY ALL),
labs AS (SELECT DISTINCT head, l FROM (SELECT head, y_true AS l FROM long UNION ALL SELECT head, y_pred FROM long)
         WHERE l IS NOT NULL),
cm AS (SELECT a.head, a.l AS y_true, b.l AS y_pred, CAST(COALESCE(c.n, 0) AS BIGINT) AS n
       FROM labs a JOIN labs b ON a.head = b.head
       LEFT JOIN cm_counts c ON c.head = a.head AND c.y_true = a.l AND c.y_pred = b.l),
pcc AS (SELECT t.head, t.label, t.tp, t.support, COALESCE(p.n_pred, 0) AS n_pred FROM
          (SELECT head, y_true AS label, COUNT(*) AS support, SUM(CASE WHEN y_true = y_pred THEN 1 ELSE 0 END) AS tp
           FROM long WHERE y_true IS NOT NULL GROUP BY ALL) t
        LEFT JOIN (SELECT head, y_pred AS label, COUNT(*) AS n_pred FROM long WHERE y_pred IS NOT NULL GROUP BY ALL) p
        USING (head, label)),
rep AS (SELECT head, label,
          CASE WHEN n_pred = 0 THEN 0.0 ELSE tp / n_pred END AS precision,
          CASE WHEN support = 0 THEN 0.0 ELSE tp / support END AS recall,
          CASE WHEN support + n_pred = 0 THEN 0.0 ELSE 2 * tp / (support + n_pred) END AS f1,
          CAST(support AS BIGINT) AS support FROM pcc),
hd AS (SELECT head, COUNT(*) AS n, SUM(CASE WHEN y_true = y_pred THEN 1 ELSE 0 END) AS n_ok,
          SUM(CASE WHEN y_pred IS NOT NULL AND y_pred NOT IN (SELECT y_true FROM long l2
              WHERE l2.head = long.head AND l2.y_true IS NOT NULL) THEN 1 ELSE 0 END) AS n_out
       FROM long GROUP BY head),
mic AS (SELECT head, SUM(tp) AS tp, SUM(n_pred) AS np, SUM(support) AS ns FROM pcc GROUP BY head),
avgs AS (
  SELECT hd.head, CASE WHEN n_out = 0 THEN 'accuracy' ELSE 'micro avg' END AS avg,
    CASE WHEN n_out = 0 THEN NULL ELSE (CASE WHEN np = 0 THEN 0.0 ELSE tp / np END) END AS precision,
    CASE WHEN n_out = 0 THEN NULL ELSE (CASE WHEN ns = 0 THEN 0.0 ELSE tp / ns END) END AS recall,
    CASE WHEN n_out = 0 THEN n_ok / n ELSE (CASE WHEN np + ns = 0 THEN 0.0 ELSE 2 * tp / (np + ns) END) END AS f1,
    CAST(ns AS BIGINT) AS support
  FROM hd JOIN mic USING (head)
  UNION ALL
  SELECT head, 'macro avg', AVG(precision), AVG(recall), AVG(f1), CAST(SUM(support) AS BIGINT) FROM rep GROUP BY head
  UNION ALL
  SELECT head, 'weighted avg', SUM(precision * support) / SUM(support), SUM(recall * support) / SUM(support),
         SUM(f1 * support) / SUM(support), CAST(SUM(support) AS BIGINT) FROM rep GROUP BY head)"""
_G = f"{_NB}, {_REPORT}"


def _r6(cols: str) -> str:
    return ", ".join(f"round({c}, 6) AS {c}" for c in cols.split(","))


ORACLE["results_table"] = f"{_NB} SELECT * FROM results"
ORACLE["confusion_matrix"] = f"{_G} SELECT * FROM cm"
ORACLE["class_report"] = f"{_G} SELECT head, label, {_r6('precision,recall,f1')}, support FROM rep"
ORACLE["report_averages"] = f"{_G} SELECT head, avg, {_r6('precision,recall,f1')}, support FROM avgs"
ORACLE["report_long"] = f"""{_G}
SELECT head, label AS row, {_r6('precision,recall,f1')}, support FROM rep
UNION ALL SELECT head, avg AS row, {_r6('precision,recall,f1')}, support FROM avgs
"""


def _relation_sql(a: str, b: str) -> str:
    return f"""rel AS (SELECT {a}, {b}, COUNT(*) AS n, COUNT(*) / SUM(COUNT(*)) OVER (PARTITION BY {a}) AS share
       FROM results WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY {a}, {b})"""


ORACLE["type_emotion_relation"] = (f"{_NB}, {_relation_sql('pred_type', 'pred_emotion')} "
                                   f"SELECT pred_type, pred_emotion, n, round(share, 8) AS share FROM rel")
ORACLE["type_emoji_relation"] = (f"{_NB}, {_relation_sql('pred_type', 'pred_emoji')} "
                                 f"SELECT pred_type, pred_emoji, n, round(share, 8) AS share FROM rel")
ORACLE["relation_filled"] = f"""{_NB}, {_relation_sql('pred_type', 'pred_emotion')}
SELECT pred_type, {", ".join(f"round(COALESCE(MAX(CASE WHEN pred_emotion = {P.q(l)} THEN share END), 0.0), 8) AS {l}"
                             for l in P.LABELS)}
FROM rel GROUP BY pred_type
"""
ORACLE["class_distribution_compare"] = f"""{_G}, {_CODES},
lt AS (SELECT 'type' AS head, value AS label FROM codes_type UNION ALL SELECT 'emotion', value FROM codes_emotion
       UNION ALL SELECT 'emoji', value FROM codes_emoji),
t AS (SELECT head, y_true AS label, COUNT(*) AS n FROM long GROUP BY ALL),
p AS (SELECT head, y_pred AS label, COUNT(*) AS n FROM long GROUP BY ALL)
SELECT lt.head, lt.label, CAST(COALESCE(t.n, 0) AS BIGINT) AS n_true, CAST(COALESCE(p.n, 0) AS BIGINT) AS n_pred
FROM lt LEFT JOIN t USING (head, label) LEFT JOIN p USING (head, label)
"""
ORACLE["top_predictions"] = f"""{_NB}
SELECT * FROM (SELECT 'pred_emotion' AS column, pred_emotion AS value, COUNT(*) AS n FROM results
               WHERE pred_emotion IS NOT NULL GROUP BY ALL ORDER BY n DESC, value LIMIT 10)
UNION ALL
SELECT * FROM (SELECT 'pred_emoji' AS column, pred_emoji AS value, COUNT(*) AS n FROM results
               WHERE pred_emoji IS NOT NULL GROUP BY ALL ORDER BY n DESC, value LIMIT 10)
"""
ORACLE["prediction_histogram"] = f"{_NB} SELECT pred_emotion, COUNT(*) AS n FROM results GROUP BY ALL"
ORACLE["numeric_histogram"] = """
WITH st AS (SELECT MIN(value) AS lo, MAX(value) AS hi, (MAX(value) - MIN(value)) / 20 AS w FROM events),
b AS (SELECT CAST(least(floor((value - st.lo) / st.w), 19) AS BIGINT) AS bin, COUNT(*) AS n
      FROM events, st WHERE value IS NOT NULL GROUP BY ALL)
SELECT g.bin, round(st.lo + g.bin * st.w, 8) AS lo, round(st.lo + (g.bin + 1) * st.w, 8) AS hi,
       CAST(COALESCE(b.n, 0) AS BIGINT) AS n
FROM (SELECT range AS bin FROM range(0, 20)) g CROSS JOIN st LEFT JOIN b USING (bin)
"""
ORACLE["density_curve"] = """
WITH st AS (SELECT MIN(value) AS lo, MAX(value) AS hi, stddev_samp(value) AS s, COUNT(value) AS n FROM events),
p AS (SELECT st.*, s * pow(n, -0.2) AS h, (hi - lo) / 63 AS step FROM st),
g AS (SELECT range AS point, p.lo + range * p.step AS x, p.h, p.n FROM range(0, 64), p)
SELECT CAST(g.point AS BIGINT) AS point, round(g.x, 8) AS x,
       round(SUM(exp(-0.5 * pow((g.x - e.value) / g.h, 2))) / (g.n * g.h * sqrt(2 * pi())), 10) AS density
FROM g, events e WHERE e.value IS NOT NULL GROUP BY g.point, g.x, g.h, g.n
"""
_CT = """ct AS (SELECT COALESCE(true_emotion, 'All') AS row, COALESCE(pred_emotion, 'All') AS col, COUNT(*) AS n
  FROM results GROUP BY CUBE (true_emotion, pred_emotion))"""
ORACLE["crosstab_margins"] = f"{_NB}, {_CT} SELECT row, col, CAST(n AS BIGINT) AS n FROM ct"
ORACLE["crosstab_normalised"] = f"""{_NB}, {_CT}
SELECT c.row, c.col, round(c.n / t.n, 8) AS share FROM ct c JOIN (SELECT row, n FROM ct WHERE col = 'All') t
USING (row) WHERE c.col <> 'All'
"""
ORACLE["error_matrix"] = f"""{_G}
SELECT head, y_true, y_pred, round(1.0 - n / NULLIF(SUM(n) OVER (PARTITION BY head, y_true), 0), 8) AS error FROM cm
"""
_FEATS = f"""feats AS (
  SELECT d.doc_id, d.lang, d.n_chars,
         CAST(len({P.tokens(P.clean('d.text'))}) AS BIGINT) AS n_words,
         CAST(len({P.chunks(P.clean('d.text'))}) AS BIGINT) AS n_chunks, l.quality, l.toxic
  FROM documents d LEFT JOIN labels l USING (doc_id))"""
_FC = ["n_chars", "n_words", "n_chunks", "quality", "toxic"]
ORACLE["correlation_matrix"] = f"WITH {_FEATS} " + " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, round(corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)), 8) AS corr FROM feats"
    for i, a in enumerate(_FC) for b in _FC[i:])
_ROC = """roc_in AS (SELECT d.n_chars AS s, l.toxic AS y FROM documents d JOIN labels l USING (doc_id)
                     WHERE d.n_chars IS NOT NULL AND l.toxic IS NOT NULL),
pts AS (SELECT CAST(s AS DOUBLE) AS threshold, SUM(CASE WHEN y = 1 THEN 1 ELSE 0 END) AS pos,
               SUM(CASE WHEN y = 1 THEN 0 ELSE 1 END) AS neg FROM roc_in GROUP BY 1),
cum AS (SELECT *, SUM(pos) OVER (ORDER BY threshold DESC) AS cum_pos,
               SUM(neg) OVER (ORDER BY threshold DESC) AS cum_neg FROM pts)"""
ORACLE["roc_curve"] = f"""WITH {_ROC}
SELECT NULL::DOUBLE AS threshold, 0.0::DOUBLE AS fpr, 0.0::DOUBLE AS tpr
UNION ALL
SELECT threshold, round(cum_neg / (SELECT SUM(neg) FROM pts), 8), round(cum_pos / (SELECT SUM(pos) FROM pts), 8)
FROM cum
"""
ORACLE["roc_auc"] = f"""WITH {_ROC}
SELECT round(SUM(neg * (cum_pos - pos + pos / 2.0)) / (SUM(pos) * SUM(neg)), 8) AS auc FROM cum
"""
_PC = ["n_chars", "n_words", "n_chunks"]
ORACLE["pair_features_by_class"] = f"WITH {_FEATS} " + " UNION ALL ".join(
    f"""SELECT lang, '{a}' AS a, '{b}' AS b, CAST(COUNT(*) AS BIGINT) AS n,
    round(AVG(CAST({a} AS DOUBLE)), 4) AS mean_a, round(AVG(CAST({b} AS DOUBLE)), 4) AS mean_b,
    round(stddev_samp(CAST({a} AS DOUBLE)), 4) AS std_a, round(stddev_samp(CAST({b} AS DOUBLE)), 4) AS std_b,
    round(covar_samp(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)), 4) AS cov
    FROM feats WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY lang"""
    for i, a in enumerate(_PC) for b in _PC[i + 1:])
ORACLE["pair_bins_by_class"] = f"""WITH {_FEATS},
st AS (SELECT MIN(n_chars) AS alo, MAX(n_chars) AS ahi, MIN(n_words) AS blo, MAX(n_words) AS bhi FROM feats)
SELECT lang, CAST(least(floor((n_chars - alo) / ((ahi - alo) / 10)), 9) AS BIGINT) AS bin_a,
       CAST(least(floor((n_words - blo) / ((bhi - blo) / 10)), 9) AS BIGINT) AS bin_b, COUNT(*) AS n
FROM feats, st WHERE n_chars IS NOT NULL AND n_words IS NOT NULL GROUP BY ALL
"""
ORACLE["labels_present"] = f"""{_NB}, {_LONG}
SELECT head, label, row_number() OVER (PARTITION BY head ORDER BY label) - 1 AS ordinal
FROM (SELECT DISTINCT head, y_true AS label FROM long WHERE y_true IS NOT NULL)
"""

ORACLE["compare_models"] = f"""{_SPLIT_LAB}, {_nb_ctes(1.0, 1, "")}, {_nb_ctes(1.0, 2, "_bi")},
""" + ",\n".join(f"""{_LONG.replace("long AS", f"long{x} AS").replace("FROM results", f"FROM results{x}")},
rep{x} AS (SELECT head, label, CASE WHEN support + n_pred = 0 THEN 0.0 ELSE 2 * tp / (support + n_pred) END AS f1
  FROM (SELECT t.head, t.label, t.tp, t.support, COALESCE(p.n_pred, 0) AS n_pred FROM
          (SELECT head, y_true AS label, COUNT(*) AS support, SUM(CASE WHEN y_true = y_pred THEN 1 ELSE 0 END) AS tp
           FROM long{x} WHERE y_true IS NOT NULL GROUP BY ALL) t
        LEFT JOIN (SELECT head, y_pred AS label, COUNT(*) AS n_pred FROM long{x} WHERE y_pred IS NOT NULL GROUP BY ALL) p
        USING (head, label))),
m{x} AS (SELECT '{name}' AS model, a.head, round(a.acc, 6) AS accuracy, round(r.mf, 6) AS macro_f1 FROM
  (SELECT head, CASE WHEN SUM(CASE WHEN y_pred IS NOT NULL AND y_pred NOT IN (SELECT y_true FROM long{x} l2
              WHERE l2.head = long{x}.head AND l2.y_true IS NOT NULL) THEN 1 ELSE 0 END) = 0
          THEN SUM(CASE WHEN y_true = y_pred THEN 1 ELSE 0 END) / COUNT(*) ELSE NULL END AS acc
   FROM long{x} GROUP BY head) a JOIN (SELECT head, AVG(f1) AS mf FROM rep{x} GROUP BY head) r USING (head))"""
    for x, name in [("", "nb_unigram"), ("_bi", "nb_bigram")]) + """
SELECT *, rank() OVER (PARTITION BY head ORDER BY macro_f1 DESC) AS rank FROM (
  SELECT * FROM m UNION ALL SELECT * FROM m_bi)
"""


# ------------------------------------------------------- H conversations
_CONV = """turns AS (SELECT * FROM conversations WHERE role IS NULL OR role <> 'system'),
flag AS (SELECT *, role = 'user' AND COALESCE(regexp_matches(lower(text), 'bye|end|quit|exit|goodbye'), false)
         AS is_exit FROM turns),
cuts AS (SELECT conv_id, MIN(CASE WHEN is_exit THEN turn END) AS cut FROM flag GROUP BY conv_id),
kept AS (SELECT f.conv_id, f.turn, f.role, f.text, c.cut IS NOT NULL AS ended
         FROM flag f JOIN cuts c USING (conv_id) WHERE c.cut IS NULL OR f.turn < c.cut)"""
ORACLE["conversation_turns"] = f"WITH {_CONV} SELECT conv_id, turn, role, text FROM turns"
ORACLE["exit_detect"] = f"WITH {_CONV} SELECT conv_id, turn, role, is_exit FROM flag"
ORACLE["conversation_cut"] = f"WITH {_CONV} SELECT * FROM kept"
ORACLE["conversation_text"] = (f"WITH {_CONV} SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS text, "
                               f"CAST(COUNT(*) AS BIGINT) AS n_turns FROM kept GROUP BY conv_id")
ORACLE["prompt_text"] = (f"WITH {_CONV} SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS prompt "
                         f"FROM kept GROUP BY conv_id")
ORACLE["last_turn_prompt"] = (f"WITH {_CONV} SELECT conv_id, MAX(turn) AS turn, arg_max(text, turn) AS prompt "
                              f"FROM kept WHERE role = 'user' GROUP BY conv_id")
ORACLE["last_three_turns_prompt"] = f"""WITH {_CONV},
u AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, text DESC) AS back
      FROM kept WHERE role = 'user' AND turn IS NOT NULL)
SELECT conv_id, CAST(COUNT(*) AS BIGINT) AS n_turns, string_agg(text, chr(10) ORDER BY back DESC) AS prompt
FROM u WHERE back <= 3 GROUP BY conv_id"""
ORACLE["role_prefixed_transcript"] = f"""WITH {_CONV}
SELECT conv_id, string_agg(CASE WHEN role = 'user' THEN 'You: ' ELSE 'Bot: ' END || COALESCE(text, ''),
                           chr(10) ORDER BY turn) AS transcript FROM kept GROUP BY conv_id
"""
_SEG = f"WITH {_CONV}, {P.score_ctes('s_', 'kept', ['conv_id', 'turn'], 'text')}"
_FREQ = """freq AS (SELECT conv_id, emotion, CAST(COUNT(*) AS BIGINT) AS n, MIN(turn) AS first_turn
         FROM s_enriched WHERE emotion IS NOT NULL GROUP BY ALL),
dom AS (SELECT conv_id, emotion AS dominant_emotion FROM (
          SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY n DESC, first_turn) AS rn FROM freq)
        WHERE rn = 1)"""
ORACLE["segment_emotions"] = f"{_SEG} SELECT conv_id, turn, emotion, emoji FROM s_enriched"
ORACLE["emotion_frequency"] = f"{_SEG}, {_FREQ} SELECT * FROM freq"
ORACLE["dominant_emotion"] = (f"{_SEG}, {_FREQ} SELECT conv_id, dominant_emotion, "
                              f"{P.emoji('dominant_emotion')} AS emoji FROM dom")
_SUMMARY = f"""{_SPLIT_LAB}, {_nb_ctes()}, {_CONV},
{P.score_ctes('s_', 'kept', ['conv_id', 'turn'], 'text')}, {_FREQ},
ctok AS (SELECT conv_id, token, COUNT(*) AS cnt FROM (
         SELECT conv_id, unnest({_feats(P.clean('text'), 1)}) AS token FROM kept) GROUP BY ALL),
clen AS (SELECT k.conv_id, COALESCE(SUM(CASE WHEN vo.token IS NOT NULL THEN t.cnt END), 0) AS len
         FROM (SELECT DISTINCT conv_id FROM kept) k LEFT JOIN ctok t USING (conv_id)
         LEFT JOIN (SELECT DISTINCT token FROM tr_tok) vo ON t.token = vo.token GROUP BY k.conv_id),
cmt AS (SELECT t.conv_id, p.class, SUM(t.cnt * p.lw) AS m FROM ctok t
        JOIN (SELECT * FROM tp WHERE head = 'type') p USING (token) GROUP BY ALL),
cs AS (SELECT l.conv_id, c.class, c.log_prior - l.len * c.log_denom + COALESCE(m.m, 0) AS score
       FROM clen l CROSS JOIN (SELECT * FROM cp WHERE head = 'type') c
       LEFT JOIN cmt m ON m.conv_id = l.conv_id AND m.class = c.class),
pers AS (SELECT conv_id, class AS personality FROM (
         SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY round(score, 6) DESC, class) AS rn FROM cs)
         WHERE rn = 1),
summary AS (SELECT pers.conv_id, pers.personality, dom.dominant_emotion,
       {P.emoji('dom.dominant_emotion')} AS emoji FROM pers LEFT JOIN dom USING (conv_id))
"""
ORACLE["conversation_summary"] = f"{_SUMMARY} SELECT * FROM summary"
ORACLE["stream_conversation_summary"] = f"""{_SUMMARY}
SELECT t.conv_id, t.n_seen, c.cut IS NOT NULL AS ended, CAST(COALESCE(k.n_kept, 0) AS BIGINT) AS n_kept,
       COALESCE(k.text, '') AS text, s.personality, s.dominant_emotion, s.emoji
FROM (SELECT conv_id, CAST(COUNT(*) AS BIGINT) AS n_seen FROM turns GROUP BY conv_id) t
JOIN cuts c USING (conv_id)
LEFT JOIN (SELECT conv_id, COUNT(*) AS n_kept, string_agg(text, ' ' ORDER BY turn) AS text
           FROM kept GROUP BY conv_id) k USING (conv_id)
LEFT JOIN summary s USING (conv_id)
"""
ORACLE["stream_enrich_posts"] = ORACLE["enrich_posts"]

# ----------------------------------------------------- A sources / sinks
ORACLE["read_posts_csv"] = P.POSTS_V


def _checksum_sql(src: str, cols: list[str]) -> str:
    key = " || '|' || ".join(f"COALESCE(CAST({c} AS VARCHAR), '∅')" for c in cols)
    return (f"SELECT CAST(COUNT(*) AS BIGINT) AS n_rows, "
            f"CAST(SUM(CAST(('0x' || substr(md5({key}), 1, 7)) AS BIGINT)) AS BIGINT) AS checksum FROM {src}")


_CK = ["doc_id", "type", "emotion", "emoji", "posts", "cleaned_posts"]
ORACLE["write_enriched"] = (f"{_E} SELECT 'parquet' AS format, * FROM ({_checksum_sql('enriched', _CK)}) "
                            f"UNION ALL SELECT 'csv', * FROM ({_checksum_sql('enriched', _CK)})")
ORACLE["preview_head"] = f"{_E} SELECT doc_id, type, emotion, emoji FROM enriched ORDER BY doc_id LIMIT 5"

# ------------------------------------------------------- D10 (re-aimed)
ORACLE["smote"] = f"""
WITH s AS (SELECT * FROM embeddings WHERE label IS NOT NULL),
ix AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {H("'row'", 'vec_id')}, vec_id) - 1 AS _idx FROM s),
sz AS (SELECT label, COUNT(*) AS n_c, MAX(COUNT(*)) OVER () - COUNT(*) AS need FROM s GROUP BY label),
dr AS (SELECT label, n_c, unnest(range(0, need)) AS k FROM sz WHERE need > 0),
nb AS (SELECT a.label, a._idx AS bi, b._idx AS pi,
              row_number() OVER (PARTITION BY a.label, a._idx
                  ORDER BY round(list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) ** 2, 9), b._idx) - 1 AS place
       FROM ix a JOIN ix b ON a.label = b.label AND a._idx <> b._idx QUALIFY place < 5),
bs AS (SELECT label, k, {H("'base'", 'label', 'k')} % n_c AS bi, {H("'partner'", 'label', 'k')} % greatest(least(n_c - 1, 5), 1) AS place,
              CAST({H("'u'", 'label', 'k')} AS DOUBLE) / {float(1 << 60)!r} AS u FROM dr),
dx AS (SELECT bs.label, bs.k, bs.bi, coalesce(nb.pi, bs.bi) AS pi, bs.u
       FROM bs LEFT JOIN nb ON nb.label = bs.label AND nb.bi = bs.bi AND nb.place = bs.place),
pairs AS (SELECT dx.label, dx.k, b.vec_id AS base_vec_id, p.vec_id AS partner_vec_id, dx.u,
                 b.embedding AS x, p.embedding AS y
          FROM dx JOIN ix b ON b.label = dx.label AND b._idx = dx.bi
                  JOIN ix p ON p.label = dx.label AND p._idx = dx.pi),
ex AS (SELECT label, k, base_vec_id, partner_vec_id, u, unnest(range(0, len(x))) AS dim,
              unnest(x) AS xv, unnest(y) AS yv FROM pairs)
SELECT CAST(label AS BIGINT) AS label, k, base_vec_id, partner_vec_id, round(u, 8) AS u, CAST(dim AS BIGINT) AS dim,
       round(CAST(xv AS DOUBLE) + u * (CAST(yv AS DOUBLE) - CAST(xv AS DOUBLE)), 6) AS value FROM ex
"""
