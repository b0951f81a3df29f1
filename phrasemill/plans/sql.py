"""The same views in SQL, for an independent engine (DuckDB)."""

from .views import EVERY, K, LENGTH, SCALE, THRESHOLD, WIDTH

PUNCT = "!\"#$%&''()*+,-./:;<=>?@[\\]^_`{|}~"
CODE = f"list_transform(embedding, lambda x: greatest(-128, least(127, round_even(x::DOUBLE * {SCALE}, 0)))::DOUBLE)"
CODED = f"coded AS (SELECT vec_id AS id, label, {CODE} AS vec FROM embeddings)"
TOKENS = f"tokens AS (SELECT vec_id // {WIDTH} AS doc_idx, vec_id % {WIDTH} AS word_idx, embedding[1]::DOUBLE AS fs, embedding[2]::DOUBLE AS fe, {CODE} AS vec FROM embeddings)"
KEPT = f"""{TOKENS}, flagged AS (SELECT *, (fs > {THRESHOLD} OR fe > {THRESHOLD}) AS p, bool_or(fs > {THRESHOLD} OR fe > {THRESHOLD}) OVER (PARTITION BY doc_idx) AS hit_any, min(word_idx) OVER (PARTITION BY doc_idx) AS f FROM tokens),
kept AS (SELECT doc_idx, word_idx, fs, fe, vec, word_idx AS f2o, row_number() OVER (PARTITION BY doc_idx ORDER BY word_idx) - 1 AS idx FROM flagged WHERE p OR (NOT hit_any AND word_idx = f))"""
Q = f"{CODED}, q AS (SELECT a.id AS qid, a.vec AS q_start, b.vec AS q_end FROM coded a JOIN coded b ON b.id = a.id + 1 WHERE a.id % {EVERY} = 0)"
DOCS = "docs AS (SELECT doc_id AS doc_idx, source AS title, array_to_string(list_filter(list_transform(string_split_regex(text, '\\n+'), lambda p: trim(p, ' ')), lambda p: p <> ''), ' [PAR] ') AS context FROM documents)"
HITS = f"""{KEPT}, {Q},
s_all AS (SELECT qid, doc_idx, idx, list_dot_product(q_start, vec) AS score, q_end AS other FROM q, kept),
s_hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_idx, idx) AS rank FROM s_all) WHERE rank <= {K}),
e_all AS (SELECT qid, doc_idx, idx, list_dot_product(q_end, vec) AS score, q_start AS other FROM q, kept),
e_hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_idx, idx) AS rank FROM e_all) WHERE rank <= {K})"""
_BAND = "SELECT h.qid, h.rank, h.doc_idx, h.idx AS own, k.idx AS partner, o.f2o AS own_f2o, k.f2o AS partner_f2o, h.score + list_dot_product(h.other, k.vec) AS total FROM {h} h JOIN kept o ON o.doc_idx = h.doc_idx AND o.idx = h.idx JOIN kept k ON k.doc_idx = h.doc_idx AND {band}"
STARTS = f"""starts AS (SELECT qid, 0 AS anchor, rank, doc_idx, own AS start_idx, partner AS end_idx, own_f2o AS start_f2o, partner_f2o AS end_f2o, total AS score FROM
(SELECT *, row_number() OVER (PARTITION BY qid, rank ORDER BY total DESC, partner) AS n FROM ({_BAND.format(h="s_hits", band=f"k.idx BETWEEN h.idx AND h.idx + {LENGTH - 1}")}) WHERE partner_f2o - own_f2o BETWEEN 0 AND {LENGTH}) WHERE n = 1)"""
ENDS = f"""ends AS (SELECT qid, 1 AS anchor, rank, doc_idx, partner AS start_idx, own AS end_idx, partner_f2o AS start_f2o, own_f2o AS end_f2o, total AS score FROM
(SELECT *, row_number() OVER (PARTITION BY qid, rank ORDER BY total DESC, partner) AS n FROM ({_BAND.format(h="e_hits", band=f"k.idx BETWEEN h.idx - {LENGTH - 1} AND h.idx")}) WHERE own_f2o - partner_f2o BETWEEN 0 AND {LENGTH}) WHERE n = 1)"""
SPANS = f"{HITS}, {STARTS}, {ENDS}, spans AS (SELECT * FROM starts UNION ALL SELECT * FROM ends)"
TEXTS = f"""{SPANS}, {DOCS},
worded AS (SELECT s.*, title, context, string_split(context, ' ') AS w FROM spans s JOIN docs USING (doc_idx)),
placed AS (SELECT *, CASE WHEN start_f2o >= len(w) THEN length(context) ELSE length(array_to_string(w[1:start_f2o], ' ')) + (start_f2o > 0)::INT END AS start_pos,
  CASE WHEN end_f2o >= len(w) THEN length(context) ELSE length(array_to_string(w[1:end_f2o], ' ')) + (end_f2o > 0)::INT + length(w[end_f2o + 1]) END AS end_pos FROM worded),
texts AS (SELECT *, substr(context, start_pos + 1, end_pos - start_pos) AS answer FROM placed)"""
_D = "' [PAR] '"
PARAGRAPHS = f"""{TEXTS},
bounds AS (SELECT *, strpos(reverse(substr(context, 1, start_pos)), reverse({_D})) AS b, strpos(substr(context, end_pos + 1), {_D}) AS a FROM texts),
cut AS (SELECT *, CASE WHEN b > 0 THEN start_pos - b + 1 ELSE 0 END AS low, CASE WHEN a > 0 THEN end_pos + a - 1 ELSE length(context) END AS high FROM bounds),
pars AS (SELECT qid, anchor, rank, doc_idx, start_idx, end_idx, score, title, answer, substr(context, low + 1, high - low) AS context, start_pos - low AS start_pos, end_pos - low AS end_pos FROM cut)"""
ORDER = "score DESC, anchor, rank, doc_idx, start_idx, end_idx"


def normal(x: str) -> str:
    """Normalised answers: words without articles."""
    return f"array_to_string({answer_words(x)}, ' ')"


def answer_words(x: str) -> str:
    return f"list_filter(string_split_regex(translate(lower({x}), '{PUNCT}', ''), '\\s+'), lambda w: w NOT IN ('', 'a', 'an', 'the'))"


def overlap(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_distinct({a}), lambda w: least(len(list_filter({a}, lambda t: t = w)), len(list_filter({b}, lambda t: t = w)))))"


def f1(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) + len({b}) > 0 THEN 2.0::DOUBLE * coalesce({overlap(a, b)}, 0) / (len({a}) + len({b})) ELSE 0 END"


ANSWERS = "answers AS (SELECT item_id AS qid, [array_to_string(w[2:], ' '), array_to_string(w, ' '), array_to_string(w[4:], ' ')] AS predictions, [array_to_string(w, ' '), array_to_string(w[2:greatest(len(w) - 2, 0)], ' ')] AS golds FROM (SELECT item_id, string_split(text, ' ') AS w FROM benchmark))"
RESULTS = "results AS (SELECT doc_id % 40 AS qid, doc_id // 40 AS place, n_chars % 7 = 0 AS hit, lang FROM documents)"
PROVENANCE = "prov AS (SELECT doc_id AS qid, [(doc_id % 7)::VARCHAR, (doc_id % 5)::VARCHAR, (doc_id % 3)::VARCHAR, (doc_id % 11)::VARCHAR] AS guess, [[(doc_id % 5)::VARCHAR, '1'], [(doc_id % 11)::VARCHAR]] AS golds, quality, toxic FROM labels)"
#: Lists without repeats in the order of first places.
ORDERED_DISTINCT = "list_filter({x}, lambda v, i: list_position({x}, v) = i)"
