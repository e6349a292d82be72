"""The reference workload in DuckDB's SQL."""

WORDS = r"regexp_extract_all(replace(lower({0}), 'ß', 'ss'), '[\p{{L}}\p{{N}}_]+')"


def _words(text: str) -> str:
    return WORDS.format(text)


_GOLD = "g AS (SELECT DISTINCT * FROM gold)"
_FACTS = """facts AS (
  SELECT example_id, i::INT AS fact_index, supporting_facts[i + 1].title AS title, supporting_facts[i + 1].sentence_id AS sentence_id
  FROM (SELECT *, unnest(range(len(supporting_facts)::BIGINT)) AS i FROM g) WHERE supporting_facts[i + 1] IS NOT NULL)"""
_PARAGRAPHS = """paragraphs AS (
  SELECT example_id, question, i::INT AS paragraph_index, context[i + 1].title AS title, context[i + 1].sentences AS sentences
  FROM (SELECT *, unnest(range(len(context)::BIGINT)) AS i FROM g) WHERE context[i + 1] IS NOT NULL)"""
_SENTENCES = """sentences AS (
  SELECT example_id, title, paragraph_index, i::INT AS sentence_index, sentences[i + 1] AS sentence
  FROM (SELECT *, unnest(range(len(sentences)::BIGINT)) AS i FROM paragraphs))"""
_RANKING = """hits AS (SELECT example_id, unnest(retrieved) AS h FROM retrieval WHERE example_id IS NOT NULL),
best AS (SELECT example_id, h.document_id AS document_id, max(h.score) AS score FROM hits
  WHERE h.document_id IS NOT NULL AND h.score IS NOT NULL AND isfinite(h.score) GROUP BY 1, 2),
ranking AS (SELECT * FROM (
  SELECT example_id, document_id, score, row_number() OVER (PARTITION BY example_id ORDER BY score DESC, document_id)::INT AS rank FROM best)
  WHERE rank <= 10)"""
_RANKS = (
    _RANKING
    + """, relevant AS (SELECT DISTINCT * FROM (SELECT example_id, unnest(gold_titles) AS document_id FROM retrieval WHERE example_id IS NOT NULL)
  WHERE document_id IS NOT NULL),
ranks AS (SELECT r.example_id, r.document_id, k.rank FROM relevant r LEFT JOIN ranking k USING (example_id, document_id))"""
)
_RECALL = (
    _RANKS
    + ", recall AS (SELECT example_id, "
    + ", ".join(
        f"count(*) FILTER (rank <= {k}) / count(*) AS recall_at_{k}, (count(*) FILTER (rank <= {k}) = count(*))::INT AS all_at_{k}" for k in (1, 2, 5, 10)
    )
    + " FROM ranks GROUP BY 1)"
)
_LATEST = """latest AS (SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY example_id, run_name ORDER BY created_at DESC NULLS LAST, prediction_id DESC) AS nth
  FROM predictions WHERE example_id IS NOT NULL) WHERE nth = 1)"""


def _normalized(x: str) -> str:
    bare = rf"regexp_replace(lower({x}), '[!-/:-@\[-`{{-~]', '', 'g')"
    return (
        f"array_to_string(list_filter(string_split_regex({bare}, '[\\s\\p{{Z}}\\x{{85}}]+'), lambda w: w NOT IN ('', 'a', 'an', 'the')), ' ')"
    )


def _score(prediction: str, gold: str, rows: str, keep: str) -> str:
    """CTEs that end in ``scored`` with em, f1, prec, recall."""
    return f"""normed AS (SELECT {keep}, {_normalized(prediction)} AS np, {_normalized(gold)} AS ng FROM {rows}),
split AS (SELECT *, CASE WHEN np = '' THEN [] ELSE string_split(np, ' ') END AS p, CASE WHEN ng = '' THEN [] ELSE string_split(ng, ' ') END AS q FROM normed),
common AS (SELECT *, coalesce(list_sum(list_transform(list_distinct(p), lambda t: least(len(list_filter(p, lambda x: x = t)), len(list_filter(q, lambda x: x = t)))))::DOUBLE, 0) AS c,
  ((np IN ('yes', 'no', 'noanswer') OR ng IN ('yes', 'no', 'noanswer')) AND np <> ng) AS veto FROM split),
pr AS (SELECT *, CASE WHEN veto OR c = 0 THEN 0.0::DOUBLE ELSE c / len(p) END AS prec, CASE WHEN veto OR c = 0 THEN 0.0::DOUBLE ELSE c / len(q) END AS recall FROM common),
scored AS (SELECT *, (np = ng)::INT::DOUBLE AS em, CASE WHEN prec + recall > 0 THEN 2 * prec * recall / (prec + recall) ELSE 0.0::DOUBLE END AS f1 FROM pr)"""


_SCORED = f"WITH {_LATEST}, answered AS (SELECT * FROM latest WHERE gold_answer IS NOT NULL), " + _score(
    "coalesce(prediction, '')", "gold_answer", "answered", "prediction_id, example_id, run_name"
)
_DIFFS = (
    _SCORED
    + """, diffs AS (SELECT example_id, max(f1) FILTER (run_name = 'reader_small') - max(f1) FILTER (run_name = 'reader_base') AS diff
  FROM scored WHERE run_name IN ('reader_base', 'reader_small') GROUP BY 1 HAVING diff IS NOT NULL)"""
)


def _bm25(k1: float, idf: str) -> str:
    return f"""
WITH docs AS (SELECT doc_id, coalesce({_words("text")}, []) AS w FROM documents),
corpus AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM docs),
tf AS (SELECT doc_id, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT doc_id, len(w) AS dl, unnest(w) AS term FROM docs) GROUP BY 1, 2),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
q AS (SELECT record_id AS query_id, unnest(list_distinct({_words("question")})) AS term FROM examples WHERE record_id % 50 = 0 AND question IS NOT NULL),
scored AS (
  SELECT query_id, doc_id, sum({idf} * tf * ({k1} + 1) / (tf + {k1} * (1 - 0.75 + 0.75 * dl / avgdl))) AS score
  FROM q JOIN tf USING (term) JOIN df USING (term), corpus GROUP BY 1, 2)
SELECT query_id, rank::INT AS rank, doc_id, round(score, 6) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM scored) WHERE rank <= 10"""


_HASH = "sha256(concat_ws('|', '{seed}', {parts}))"


def _bits(expr: str, digits: int) -> str:
    return f"('0x' || substr({expr}, 1, {digits}))::BIGINT"


def _poisson(u: str) -> str:
    steps, p, total = [], 0.36787944117144233, 0.0
    for n in range(1, 9):
        total += p
        steps.append(total)
        p /= n
    return "(" + " + ".join(f"({u} >= {s!r}::DOUBLE)::INT" for s in steps) + ")"


def _bootstrap(values: str, key: str, value: str, seed: int, draws: int) -> str:
    u = f"({_bits(f'sha256({seed}::VARCHAR || chr(124) || draw || chr(124) || {key})', 8)} / 4294967296.0::DOUBLE)"
    return f""", vals AS (SELECT {key} AS k, {value} AS v FROM {values}),
drawn AS (SELECT draw, v, {_poisson(u.replace(key, 'k'))} AS w FROM vals, (SELECT unnest(range({draws})) AS draw)),
means AS (SELECT draw, sum(round(v * 1099511627776)::BIGINT * w)::DOUBLE / 1099511627776 / sum(w) AS m FROM drawn GROUP BY 1)
SELECT (SELECT count(v) FROM vals) AS n, (SELECT round(avg(v), 9) FROM vals) AS estimate,
  round(quantile_cont(m, 0.025), 9) AS low, round(quantile_cont(m, 0.975), 9) AS high FROM means"""


_METRICS = ("em", "f1", "prec", "recall", "sp_em", "sp_f1", "sp_prec", "sp_recall", "joint_em", "joint_f1", "joint_prec", "joint_recall")
_EVALUATED = (
    f"WITH {_GOLD}, {_RANKING}, {_LATEST}, "
    + """base AS (SELECT example_id, answer, list_transform(list_filter(coalesce(supporting_facts, []), lambda f: f IS NOT NULL),
    lambda f: coalesce(f.title, chr(1)) || chr(0) || coalesce(f.sentence_id::VARCHAR, '')) AS facts FROM g),
joined AS (
  SELECT b.example_id, b.answer, list_distinct(b.facts) AS gs, a.prediction AS prediction, a.example_id IS NULL AS missing_answer,
    s.titles IS NULL AS missing_support, coalesce(s.titles, []) AS ps
  FROM base b
  LEFT JOIN (SELECT example_id, coalesce(prediction, '') AS prediction FROM latest WHERE run_name = 'reader_base') a USING (example_id)
  LEFT JOIN (SELECT example_id, list(DISTINCT document_id || chr(0) || '0') AS titles FROM ranking WHERE rank <= 2 GROUP BY 1) s USING (example_id)), """
    + _score("coalesce(prediction, '')", "coalesce(answer, '')", "joined", "*")
    + """, sup AS (
  SELECT *, len(list_intersect(ps, gs)) AS tp FROM scored),
sup2 AS (SELECT *, CASE WHEN len(ps) > 0 THEN tp / len(ps) ELSE 0.0::DOUBLE END AS sp_prec, CASE WHEN len(gs) > 0 THEN tp / len(gs) ELSE 0.0::DOUBLE END AS sp_recall,
  (tp = len(ps) AND tp = len(gs))::INT::DOUBLE AS sp_em, NOT missing_answer AND NOT missing_support AS both_there FROM sup),
sup3 AS (SELECT *, CASE WHEN sp_prec + sp_recall > 0 THEN 2 * sp_prec * sp_recall / (sp_prec + sp_recall) ELSE 0.0::DOUBLE END AS sp_f1,
  CASE WHEN both_there THEN prec * sp_prec ELSE 0.0::DOUBLE END AS joint_prec, CASE WHEN both_there THEN recall * sp_recall ELSE 0.0::DOUBLE END AS joint_recall,
  CASE WHEN both_there THEN em * sp_em ELSE 0.0::DOUBLE END AS joint_em FROM sup2),
evaluated AS (SELECT *, CASE WHEN joint_prec + joint_recall > 0 THEN 2 * joint_prec * joint_recall / (joint_prec + joint_recall) ELSE 0.0::DOUBLE END AS joint_f1 FROM sup3)"""
)

_BASE = """titles AS (SELECT example_id, title AS document_id, min(paragraph_index) AS first_at FROM paragraphs WHERE title IS NOT NULL GROUP BY 1, 2),
base AS (SELECT example_id, document_id, row_number() OVER (PARTITION BY example_id ORDER BY first_at)::INT AS place FROM titles)"""
_ASKED = "asked AS (SELECT DISTINCT identifier AS example_id FROM examples WHERE record_id % 50 = 0)"
_SEARCHED = f"""{_ASKED}, searched AS (SELECT b.* FROM base b SEMI JOIN asked USING (example_id))"""
_DISTRACTORS = """pool AS (SELECT DISTINCT document_id FROM documents WHERE document_id IS NOT NULL),
extra AS (SELECT * FROM (
  SELECT e.example_id, p.document_id,
    row_number() OVER (PARTITION BY e.example_id ORDER BY sha256('7' || chr(0) || e.example_id || chr(0) || p.document_id), p.document_id)::INT AS place
  FROM (SELECT DISTINCT example_id FROM searched) e, pool p
  WHERE NOT EXISTS (SELECT 1 FROM searched b WHERE b.example_id = e.example_id AND b.document_id = p.document_id))
  WHERE place <= 2)"""

_WS = r"[\s\p{Z}\x0B\x1C-\x1F\x{85}]"


def _strip(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^{_WS}+', ''), '{_WS}+$', '')"


def _bare(x: str) -> str:
    return _strip(f"trim({_strip(x)}, '$')")


def _unwrap(x: str, command: str) -> str:
    return f"CASE WHEN starts_with({x}, '{command}{{') AND ends_with({x}, '}}') THEN {_strip(f'{x}[{len(command) + 2}:-2]')} ELSE {x} END"


_KEPT = "string_split(string_split({0}, '<|im_end|>')[1], '<|endoftext|>')[1]"
_LINES = r"'\r\n|[\n\x0B\f\r\x1C-\x1E\x{85}\x{2028}\x{2029}]'"
_CONTROL = "regexp_replace(regexp_replace({0}, '<\\|[^>]+\\|>', ' ', 'g'), '</?think>', ' ', 'g')"
_ANSWER_START = rf"(?im)^{_WS}*(?:final{_WS}+)?answer{_WS}*:"
_DEPTH = "1 + (len(left(a, i::INT)) - len(replace(left(a, i::INT), '{', ''))) - (len(left(a, i::INT)) - len(replace(left(a, i::INT), '}', '')))"


def _boxed(x: str) -> str:
    """The CTE columns b (content of the first box of column x, or null)."""
    after = f"CASE WHEN contains({x}, '\\boxed{{') THEN substr({x}, instr({x}, '\\boxed{{') + 7) END"
    return f"""(SELECT {_strip("left(a, (list_filter(range(1, len(a) + 1), lambda i: " + _DEPTH + " = 0)[1] - 1)::INT)")} FROM (SELECT {after} AS a))"""


def _words_in(x: str) -> str:
    return f"len(list_filter(string_split_regex({x}, '{_WS}+'), lambda w: w <> ''))"


_EVIDENCE = f"""list_transform(list_filter(context, lambda p: p IS NOT NULL), lambda p, i: '[Document ' || i || '] ' || coalesce(p.title, '') || chr(10) ||
    coalesce(array_to_string(list_transform(p.sentences, lambda s, j: '(' || (j - 1) || ') ' || {_strip("coalesce(s, '')")} || chr(10)), ''), ''))"""


def _serialized(question: str, evidence: str) -> str:
    whole = f"'Question: ' || {_strip(question)} || chr(10) || chr(10) || 'Evidence:' || chr(10) || array_to_string({evidence}, chr(10))"
    return f"regexp_replace({whole}, '{_WS}+$', '')"


_PROMPTED = f"""u AS (SELECT *, list_filter(context, lambda p: coalesce(list_contains(list_transform(supporting_facts, lambda f: f.title), p.title), false)) AS e FROM g),
demo AS (SELECT *, row_number() OVER (ORDER BY example_id) AS nth FROM (
  SELECT example_id, question, answer, e AS context FROM u WHERE answer IS NOT NULL AND question IS NOT NULL AND len(e) > 0
  ORDER BY sha256('3' || chr(0) || example_id), example_id LIMIT 2)),
shown AS (SELECT nth, {_serialized("question", _EVIDENCE)} AS q, 'Answer: ' || answer AS a FROM demo),
target AS (SELECT example_id, question, list_transform(list_filter(coalesce(context, []), lambda p: p IS NOT NULL),
  lambda p: struct_pack(title := p.title, sentences := list_filter(coalesce(p.sentences, []), lambda s: s IS NOT NULL))) AS context FROM g
  WHERE example_id IS NOT NULL AND question IS NOT NULL)"""


def _prompt_counts(before: str, around: str, budget: int) -> str:
    """What fits a budget of words, by running sums: the words of a prompt add up."""
    return f"""WITH {_GOLD}, {_PROMPTED},
fixed AS (SELECT {before} AS texts FROM shown),
sized AS (SELECT example_id, question, context, (SELECT {_words_in("texts")} FROM fixed) + {_words_in("'Question: ' || question || ' Evidence: ' || " + around)} AS base,
  coalesce(list_sum(list_transform(context, lambda p: len(p.sentences))), 0)::INT AS total, {_words_in("array_to_string(" + _EVIDENCE + ", ' ')")} AS evidence FROM target),
sent AS (SELECT example_id, base, p_no, s_no, {_words_in("'(0) ' || context[p_no].sentences[s_no]")} +
    CASE WHEN s_no = 1 THEN {_words_in("'[Document 1] ' || coalesce(context[p_no].title, '')")} ELSE 0 END AS cost
  FROM (SELECT *, unnest(range(1, len(context[p_no].sentences) + 1)) AS s_no FROM (SELECT *, unnest(range(1, len(context) + 1)) AS p_no FROM sized))),
run AS (SELECT *, base + sum(cost) OVER (PARTITION BY example_id ORDER BY p_no, s_no) AS words FROM sent),
fit AS (SELECT example_id, count(*) AS kept, count(DISTINCT p_no) AS docs, max(words) AS words FROM run WHERE words <= {budget} GROUP BY 1),
j AS (SELECT z.*, base + evidence <= {budget} AS whole, coalesce(f.kept, 0) AS kept, coalesce(f.docs, 0) AS docs, f.words AS fwords FROM sized z LEFT JOIN fit f USING (example_id)),
r AS (SELECT *, CASE WHEN len(context) = 0 THEN 'no_evidence' WHEN NOT whole AND kept = 0 THEN 'no_sentence_fits' ELSE 'ok' END AS status FROM j)
SELECT example_id, CASE WHEN status <> 'ok' THEN NULL WHEN whole THEN base + evidence ELSE fwords END::INT AS input_tokens,
  CASE WHEN status <> 'ok' THEN NULL WHEN whole THEN len(context) ELSE docs END::INT AS n_documents, CASE WHEN status <> 'ok' THEN NULL WHEN whole THEN total ELSE kept END::INT AS n_sentences,
  CASE WHEN status <> 'ok' THEN NULL WHEN whole THEN 0 ELSE len(context) - docs END::INT AS dropped_documents,
  CASE WHEN status <> 'ok' THEN NULL WHEN whole THEN 0 ELSE total - kept END::INT AS dropped_sentences,
  CASE WHEN status = 'ok' THEN NOT whole END AS truncated, status FROM r"""


_DIRECT = (
    "'<|im_start|><|object_ref_start|>Answer each question using only its evidence. Return only the shortest answer after \"Answer:\". ' || "
    "string_agg(q || ' ' || a, ' ')"
)
_CHAT = (
    "'<|im_start|>system Use only the provided evidence. Reason briefly and explicitly. End with exactly one final line in the form \"Answer: <shortest answer>\".<|im_end|> ' || "
    "string_agg('<|im_start|>user ' || q || '<|im_end|> <|im_start|>assistant ' || a || '<|im_end|>', ' ') || ' <|im_start|>user'"
)

_FLIP_SUM = "round(diff * 1099511627776)::BIGINT"

SQL = {
    "tokenize_stats": f"SELECT lang, count(*) AS n_docs, sum(len({_words('coalesce(text, chr(32))')}))::BIGINT AS n_tokens FROM documents GROUP BY 1",
    "term_freq_top": f"SELECT term, count(*) AS cf FROM (SELECT unnest({_words('text')}) AS term FROM documents) GROUP BY 1 ORDER BY cf DESC, term LIMIT 100",
    "doc_freq_top": f"SELECT term, count(*) AS df FROM (SELECT doc_id, unnest(list_distinct({_words('text')})) AS term FROM documents) GROUP BY 1 ORDER BY df DESC, term LIMIT 100",
    "stream_term_counts": f"""SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM (SELECT doc_id, unnest({_words('text')}) AS term FROM documents)
GROUP BY 1 ORDER BY df DESC, term LIMIT 100""",
    "bm25_corpus_topk": _bm25(1.5, "ln(1 + (n - df + 0.5) / (df + 0.5))"),
    "bm25_fts_variant_topk": _bm25(1.2, "CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df + 0.5) / (df + 0.5)) END"),
    "bm25_candidate_topk": f"""
WITH {_GOLD}, {_PARAGRAPHS},
c AS (SELECT example_id AS query_id, paragraph_index AS item, list_distinct({_words("question")}) AS q,
  {_words("trim(array_to_string(coalesce(sentences, []), ''))")} AS w FROM paragraphs),
sized AS (SELECT *, len(w) AS dl, count(*) OVER (PARTITION BY query_id) AS n, avg(len(w)) OVER (PARTITION BY query_id) AS avgdl FROM c),
terms AS (SELECT query_id, item, dl, n, avgdl, w, unnest(q) AS term FROM sized),
tf AS (SELECT *, len(list_filter(w, lambda x: x = term)) AS tf FROM terms),
hits AS (SELECT *, count(*) OVER (PARTITION BY query_id, term) AS df FROM tf WHERE tf > 0),
s AS (SELECT query_id, item, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (CASE WHEN avgdl > 0 THEN 0.25 + 0.75 * dl / avgdl ELSE 0.25 END))) AS score FROM hits GROUP BY 1, 2),
a AS (SELECT c.query_id, c.item, coalesce(s.score, 0.0) AS score FROM c LEFT JOIN s USING (query_id, item))
SELECT query_id, rank::INT AS rank, item, round(score, 6) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, item) AS rank FROM a) WHERE rank <= 5""",
    "ranking_top10": f"WITH {_RANKING} SELECT example_id, rank, document_id, round(score, 6) AS score FROM ranking",
    "recall_at_k": f"WITH {_RECALL} SELECT example_id, "
    + ", ".join(f"round(recall_at_{k}, 9) AS recall_at_{k}, all_at_{k}" for k in (1, 2, 5, 10))
    + " FROM recall",
    "recall_macro": f"WITH {_RECALL} SELECT count(*) AS n, "
    + ", ".join(f"round(avg({c}_{k}), 9) AS {c}_{k}" for k in (1, 2, 5, 10) for c in ("recall_at", "all_at"))
    + " FROM recall",
    "fact_recall_at_k": f"WITH {_GOLD}, {_FACTS}, {_RANKING} SELECT f.example_id, count(*) AS n_facts, "
    + ", ".join(f"round(count(*) FILTER (rank <= {k}) / count(*), 9) AS fact_recall_at_{k}" for k in (1, 2, 5, 10))
    + " FROM facts f LEFT JOIN ranking r ON r.example_id = f.example_id AND r.document_id = f.title GROUP BY 1",
    "outcome_histogram": f"""WITH {_RANKS}, per AS (SELECT example_id, count(rank) AS found, count(*) AS wanted FROM ranks GROUP BY 1),
named AS (SELECT CASE WHEN found = wanted THEN 'complete' WHEN found > 0 THEN 'partial' ELSE 'none' END AS outcome FROM per)
SELECT outcome, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 9) AS rate FROM named GROUP BY 1""",
    "rank_bins": f"""WITH {_RANKS}, binned AS (
  SELECT CASE WHEN rank = 1 THEN '1' WHEN rank = 2 THEN '2' WHEN rank <= 5 THEN '3-5' WHEN rank <= 10 THEN '6-10' ELSE 'missing' END AS bin FROM ranks)
SELECT f.bin, count(b.bin) AS n FROM (SELECT unnest(['1', '2', '3-5', '6-10', 'missing']) AS bin) f LEFT JOIN binned b USING (bin) GROUP BY 1""",
    "missing_gold_top20": f"WITH {_RANKS} SELECT document_id, count(*) AS n FROM ranks WHERE rank IS NULL GROUP BY 1 ORDER BY n DESC, document_id LIMIT 20",
    "recall_by_type_and_level": f"""WITH {_GOLD}, {_RECALL}, j AS (
  SELECT coalesce(question_type, 'unknown') AS question_type, coalesce(level, 'unknown') AS level, recall_at_10 FROM recall JOIN g USING (example_id))
SELECT 'question_type' AS grouping, question_type AS value_of, count(*) AS n, round(avg(recall_at_10), 9) AS mean FROM j GROUP BY 2
UNION ALL SELECT 'level', level, count(*), round(avg(recall_at_10), 9) FROM j GROUP BY 2""",
    "nested_ranking": f"WITH {_RANKING} SELECT example_id, string_agg(document_id, ' | ' ORDER BY rank) AS document_ids FROM ranking GROUP BY 1",
    "retrieval_throughput": "SELECT shard_index, count(*) AS n, round(count(*) / sum(latency_seconds), 6) AS batches_per_second FROM retrieval WHERE latency_seconds > 0 GROUP BY 1",
    "answer_norm": f"SELECT prediction_id, {_normalized('prediction')} AS normalized FROM predictions",
    "answer_f1": _SCORED + " SELECT prediction_id, " + ", ".join(f"round({m}, 9) AS {m}" for m in ("em", "f1", "prec", "recall")) + " FROM scored",
    "answer_macro": _SCORED + " SELECT run_name, count(*) AS n, " + ", ".join(f"round(avg({m}), 9) AS {m}" for m in ("em", "f1", "prec", "recall")) + " FROM scored GROUP BY 1",
    "evaluate_examples": _EVALUATED + " SELECT example_id, missing_answer, missing_support, " + ", ".join(f"round({m}, 9) AS {m}" for m in _METRICS) + " FROM evaluated",
    "evaluate_macro": _EVALUATED
    + " SELECT count(*) AS n, count(*) FILTER (missing_answer) AS missing_answers, count(*) FILTER (missing_support) AS missing_support, "
    + ", ".join(f"round(avg({m}), 9) AS {m}" for m in _METRICS)
    + " FROM evaluated",
    "hash_slice": "SELECT record_id, identifier FROM examples ORDER BY sha256('13' || chr(0) || record_id), record_id LIMIT 100",
    "two_phase_slice": "SELECT record_id, identifier FROM examples WHERE split_name IN ('train', 'validation', 'test') ORDER BY sha256('13' || chr(0) || record_id), record_id LIMIT 100",
    "systematic_sample": """WITH n AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS rowid, count(*) OVER () AS total FROM documents)
SELECT rowid, doc_id FROM n WHERE rowid IN (SELECT i * total // 100 + 1 FROM range(100) r(i), (SELECT count(*) AS total FROM documents))""",
    "distractors": f"WITH {_GOLD}, {_PARAGRAPHS}, {_BASE}, {_SEARCHED}, {_DISTRACTORS} SELECT example_id, document_id, place FROM extra",
    "append_distractors": f"""WITH {_GOLD}, {_PARAGRAPHS}, {_BASE}, {_SEARCHED}, {_DISTRACTORS},
both_ AS (SELECT example_id, place AS first_at, document_id, false AS distractor FROM searched UNION ALL SELECT example_id, place, document_id, true FROM extra)
SELECT example_id, row_number() OVER (PARTITION BY example_id ORDER BY distractor, first_at)::INT AS place, document_id, distractor FROM both_""",
    "gold_semi_join": f"""WITH {_GOLD}, kept AS (
  SELECT example_id, CASE WHEN context IS NULL OR supporting_facts IS NULL THEN NULL ELSE
    list_filter(context, lambda p: coalesce(list_contains(list_transform(supporting_facts, lambda f: f.title), p.title), false)) END AS k, context FROM g)
SELECT example_id, CASE WHEN context IS NULL THEN -1 ELSE coalesce(len(k), 0)::INT END AS n,
  CASE WHEN context IS NULL THEN NULL ELSE coalesce(array_to_string(list_transform(k, lambda p: p.title), ' | '), '') END AS titles FROM kept""",
    "anti_join_pool": f"""WITH {_GOLD}, {_PARAGRAPHS} SELECT DISTINCT document_id FROM documents
WHERE document_id IS NOT NULL AND document_id NOT IN (SELECT title FROM paragraphs WHERE title IS NOT NULL)""",
    "fact_sentence_join": f"""WITH {_GOLD}, {_FACTS}, {_PARAGRAPHS}, {_SENTENCES}
SELECT f.example_id, f.fact_index, s.paragraph_index, s.sentence FROM facts f
JOIN sentences s ON s.example_id = f.example_id AND s.title = f.title AND s.sentence_index = f.sentence_id""",
    "ref_range_issues": f"""WITH {_GOLD}, {_FACTS}, {_PARAGRAPHS}
SELECT f.example_id, f.fact_index, f.title, f.sentence_id, coalesce(len(p.sentences), 0)::INT AS n_sentences FROM facts f
JOIN paragraphs p ON p.example_id = f.example_id AND p.title = f.title WHERE f.sentence_id >= coalesce(len(p.sentences), 0)""",
    "record_violations": f"""WITH {_GOLD}, t AS (
  SELECT *, list_filter(list_transform(context, lambda p: p.title), lambda x: x IS NOT NULL) AS titles, list_filter(supporting_facts, lambda f: f IS NOT NULL) AS facts FROM g)
SELECT example_id, 'blank_id' AS rule FROM t WHERE trim(coalesce(example_id, '')) = ''
UNION ALL SELECT example_id, 'blank_question' FROM t WHERE trim(coalesce(question, '')) = ''
UNION ALL SELECT example_id, 'repeated_title' FROM t WHERE len(list_distinct(titles)) < len(titles)
UNION ALL SELECT example_id, 'negative_sentence_id' FROM t WHERE len(list_filter(facts, lambda f: f.sentence_id < 0)) > 0
UNION ALL SELECT example_id, 'unknown_title' FROM t WHERE len(list_filter(facts, lambda f: NOT coalesce(list_contains(titles, f.title), false))) > 0""",
    "ranking_violations": """WITH h AS (
  SELECT batch_id, i AS pos, retrieved[i + 1] AS h FROM (SELECT *, unnest(range(len(retrieved)::BIGINT)) AS i FROM retrieval)),
c AS (SELECT batch_id, pos, h.rank AS rank, h.score AS score, h.document_id AS document_id, coalesce(isfinite(h.score), false) AS finite,
  lag(h.score) OVER (PARTITION BY batch_id ORDER BY pos) AS before, row_number() OVER (PARTITION BY batch_id, h.document_id ORDER BY pos) AS copy FROM h),
v AS (SELECT batch_id, 'rank' AS rule FROM c WHERE rank IS NULL OR rank <> pos + 1
UNION ALL SELECT batch_id, 'not_finite' FROM c WHERE NOT finite
UNION ALL SELECT batch_id, 'rising' FROM c WHERE finite AND before < score
UNION ALL SELECT batch_id, 'no_document' FROM c WHERE document_id IS NULL
UNION ALL SELECT batch_id, 'repeated' FROM c WHERE document_id IS NOT NULL AND copy > 1)
SELECT batch_id, rule, count(*) AS n FROM v GROUP BY 1, 2""",
    "metric_compare_tol": "WITH answered AS (SELECT * FROM predictions WHERE gold_answer IS NOT NULL AND answer_score IS NOT NULL), "
    + _score("coalesce(prediction, '')", "gold_answer", "answered", "answer_score")
    + """, f AS (SELECT 'em' AS field, answer_score.exact_match AS a, em AS b FROM scored UNION ALL SELECT 'f1', answer_score.f1, f1 FROM scored
  UNION ALL SELECT 'prec', answer_score.precision, prec FROM scored UNION ALL SELECT 'recall', answer_score.recall, recall FROM scored)
SELECT field, count(*) AS n_different FROM f WHERE NOT coalesce(abs(a - b) <= 1e-12, a IS NULL AND b IS NULL) GROUP BY 1""",
    "gold_titles_in_order": """WITH t AS (SELECT batch_id, list_filter(gold_titles, lambda x: x IS NOT NULL) AS l FROM retrieval),
u AS (SELECT batch_id, list_filter(l, lambda x, i: list_position(l, x) = i) AS l FROM t)
SELECT batch_id, CASE WHEN l IS NULL THEN NULL ELSE coalesce(array_to_string(l, ' | '), '') END AS titles, CASE WHEN l IS NULL THEN -1 ELSE len(l) END::INT AS n FROM u""",
    "candidate_rerank_recall": f"""
WITH {_GOLD}, {_PARAGRAPHS}, {_FACTS},
c AS (SELECT example_id AS query_id, paragraph_index AS item, title, list_distinct({_words("question")}) AS q,
  {_words("trim(array_to_string(coalesce(sentences, []), ''))")} AS w FROM paragraphs),
sized AS (SELECT *, len(w) AS dl, count(*) OVER (PARTITION BY query_id) AS n, avg(len(w)) OVER (PARTITION BY query_id) AS avgdl FROM c),
tf AS (SELECT *, len(list_filter(w, lambda x: x = term)) AS tf FROM (SELECT query_id, item, dl, n, avgdl, w, unnest(q) AS term FROM sized)),
hits AS (SELECT *, count(*) OVER (PARTITION BY query_id, term) AS df FROM tf WHERE tf > 0),
s AS (SELECT query_id, item, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (CASE WHEN avgdl > 0 THEN 0.25 + 0.75 * dl / avgdl ELSE 0.25 END))) AS score FROM hits GROUP BY 1, 2),
a AS (SELECT c.query_id, c.item, c.title, coalesce(s.score, 0.0) AS score FROM c LEFT JOIN s USING (query_id, item)),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, item) AS rank FROM a),
t AS (SELECT query_id AS example_id, title, min(rank) AS rank FROM k WHERE title IS NOT NULL AND rank <= 10 GROUP BY 1, 2),
f AS (SELECT example_id, title FROM facts WHERE title IS NOT NULL),
per_fact AS (SELECT example_id, {", ".join(f"count(*) FILTER (rank <= {k}) / count(*) AS f_{k}" for k in (1, 2, 5, 10))} FROM f LEFT JOIN t USING (example_id, title) GROUP BY 1),
per_title AS (SELECT example_id, {", ".join(f"count(*) FILTER (rank <= {k}) / count(*) AS r_{k}" for k in (1, 2, 5, 10))} FROM (SELECT DISTINCT * FROM f) LEFT JOIN t USING (example_id, title) GROUP BY 1)
SELECT count(*) AS n, {", ".join(f"round(avg(r_{k}), 9) AS recall_at_{k}, round(avg(f_{k}), 9) AS fact_recall_at_{k}" for k in (1, 2, 5, 10))} FROM per_fact JOIN per_title USING (example_id)""",
    "ranking_equivalence": """WITH h AS (SELECT example_id, shard_index % 2 AS side, unnest(retrieved) AS h FROM retrieval WHERE example_id IS NOT NULL),
best AS (SELECT side, example_id, h.document_id AS document_id, max(h.score) AS score FROM h
  WHERE h.document_id IS NOT NULL AND h.score IS NOT NULL AND isfinite(h.score) GROUP BY 1, 2, 3),
r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY side, example_id ORDER BY score DESC, document_id) AS rank FROM best) WHERE rank <= 10),
e AS (SELECT side, example_id, rank, document_id, round(score, 9) AS score FROM r
  WHERE example_id IN (SELECT example_id FROM r WHERE side = 0) AND example_id IN (SELECT example_id FROM r WHERE side = 1)),
a AS (SELECT * EXCLUDE side FROM e WHERE side = 0), b AS (SELECT * EXCLUDE side FROM e WHERE side = 1)
SELECT 'left' AS side, count(*) AS n FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) HAVING count(*) > 0
UNION ALL SELECT 'right', count(*) FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a) HAVING count(*) > 0""",
    "incomplete_rankings": f"""WITH {_RANKING}, q AS (SELECT DISTINCT example_id FROM retrieval WHERE example_id IS NOT NULL)
SELECT q.example_id, count(rank) AS n FROM q LEFT JOIN ranking r USING (example_id) GROUP BY 1 HAVING count(rank) <> 10""",
    "revised_before_neighbour": """WITH d AS (SELECT revised_at, lag(revised_at) OVER (ORDER BY doc_id) AS before, row_number() OVER (ORDER BY doc_id) AS place FROM documents WHERE revised_at IS NOT NULL)
SELECT strftime(revised_at, '%Y-%m-%d') AS day, count(*) AS n FROM d WHERE place > 1 AND revised_at <= before GROUP BY 1""",
    "run_compare": f"""WITH {_LATEST} SELECT count(*) AS pairs, count(*) FILTER (a.prompt IS NOT DISTINCT FROM b.prompt) AS same_prompt,
  count(*) FILTER (a.raw_output IS NOT DISTINCT FROM b.raw_output) AS same_output, count(*) FILTER (a.prediction IS NOT DISTINCT FROM b.prediction) AS same_answer
FROM (SELECT * FROM latest WHERE run_name = 'reader_base') a JOIN (SELECT * FROM latest WHERE run_name = 'reader_small') b USING (example_id)""",
    "cross_input_duplicates": "SELECT identifier, count(DISTINCT split_name) AS splits, count(*) AS n FROM examples GROUP BY 1 HAVING splits > 1",
    "positional_join": f"""WITH {_LATEST},
a AS (SELECT row_number() OVER (ORDER BY example_id) AS place, example_id AS left_id FROM latest WHERE run_name = 'reader_base'),
b AS (SELECT row_number() OVER (ORDER BY example_id) AS place, example_id AS right_id FROM latest WHERE run_name = 'reader_small')
SELECT place, left_id, right_id FROM a FULL JOIN b USING (place) WHERE left_id IS DISTINCT FROM right_id""",
    "extraction_compare": "SELECT run_name, count(*) AS n, count(*) FILTER (extraction.answer IS DISTINCT FROM prediction) AS n_different FROM predictions GROUP BY 1",
    "prompt_sha256": "SELECT run_name, count(*) AS n, count(*) FILTER (sha256(prompt) = prompt_sha256) AS n_equal FROM predictions WHERE prompt IS NOT NULL GROUP BY 1",
    "shard_ledger": """WITH n AS (SELECT row_number() OVER (ORDER BY doc_id) AS rowid FROM documents)
SELECT (rowid - 1) // 128 AS shard_index, min(rowid) AS start_rowid, max(rowid) AS end_rowid, count(*) AS document_count FROM n GROUP BY 1""",
    "shard_contiguity": """WITH l AS (SELECT (doc_id - 1) // 128 AS shard_index, min(doc_id) AS start_rowid, max(doc_id) AS end_rowid, count(*) AS document_count FROM documents GROUP BY 1),
e AS (SELECT *, lag(end_rowid, 1, 0) OVER (ORDER BY shard_index) + 1 AS expected FROM l)
SELECT * FROM e WHERE start_rowid <> expected OR end_rowid - start_rowid + 1 <> document_count""",
    "shard_totals": f"""WITH n AS (SELECT row_number() OVER (ORDER BY doc_id) AS rowid, len({_words("coalesce(text, chr(32))")}) AS t FROM documents)
SELECT count(DISTINCT (rowid - 1) // 128) AS shard_count, count(*)::BIGINT AS document_count, sum(least(t, 48))::BIGINT AS tokens_processed,
  count(*) FILTER (t > 48)::BIGINT AS truncated_documents, 0.0::DOUBLE AS max_norm_error FROM n""",
    "shard_bound_issues": f"""WITH n AS (SELECT row_number() OVER (ORDER BY doc_id) AS rowid, len({_words("coalesce(text, chr(32))")}) AS t FROM documents),
l AS (SELECT (rowid - 1) // 128 AS shard_index, count(*) AS docs, sum(least(t, 48)) AS tokens FROM n GROUP BY 1)
SELECT shard_index, 'tokens' AS rule FROM l WHERE tokens < docs""",
    "first_overflow_chunk": f"""WITH n AS (SELECT doc_id, len({_words("text")}) AS t FROM documents)
SELECT doc_id, 48::BIGINT AS tokens, ceil(t / 48)::INT AS n_chunks FROM n WHERE t > 48""",
    "corpus_scan": """WITH d AS (SELECT CASE WHEN trim(coalesce(title, '')) = '' THEN 'no_title' WHEN trim(coalesce(text, '')) = '' THEN 'empty_text' ELSE 'kept' END AS outcome, text FROM documents)
SELECT outcome, count(*) AS n_documents, sum(CASE WHEN outcome = 'kept' THEN length(trim(text)) ELSE 0 END)::BIGINT AS n_characters FROM d GROUP BY 1""",
    "resumable_shards": """SELECT ceil(count(*) / 128)::BIGINT AS shard_count, count(*) AS document_count, sum(len(embedding))::BIGINT AS tokens_processed,
  0::BIGINT AS truncated_documents, true AS norms_hold FROM embeddings WHERE embedding IS NOT NULL""",
    "dense_topk": """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL),
s AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_inner_product(q.e, v.e), 6) + 0.0 AS score FROM v q, v WHERE q.vec_id % 50 = 0)
SELECT query_id, rank::INT AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10""",
    "l2_normalise_mrl": """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e, embedding[1:32]::DOUBLE[] AS h FROM embeddings)
SELECT vec_id, round(sqrt(list_inner_product(e, e)), 6) AS norm, round(sqrt(list_inner_product(h, h)), 6) AS head_norm,
  round(h[1] / sqrt(list_inner_product(h, h)), 6) AS first FROM v""",
    "cohens_dz": _DIFFS + " SELECT count(*) AS n, round(avg(diff), 9) AS mean_diff, round(avg(diff) / stddev_samp(diff), 9) AS dz FROM diffs",
    "quantile_p50_p95": """SELECT run_name, count(*) AS n, round(quantile_cont(latency_seconds, 0.5), 9) AS p50, round(quantile_cont(latency_seconds, 0.95), 9) AS p95
FROM predictions WHERE latency_seconds IS NOT NULL AND NOT isnan(latency_seconds) GROUP BY 1""",
    "signflip_exact": _DIFFS
    + f""", {_GOLD}, groups AS (SELECT coalesce(question_type, 'unknown') AS t, coalesce(level, 'unknown') AS l, round(avg(diff), 9) AS diff FROM diffs JOIN g USING (example_id) GROUP BY 1, 2),
numbered AS (SELECT row_number() OVER (ORDER BY diff) - 1 AS i, {_FLIP_SUM} AS d FROM groups),
o AS (SELECT abs(sum(d)) AS o, count(*) AS n FROM numbered),
sums AS (SELECT mask, abs(sum(CASE WHEN (mask >> i) & 1 = 1 THEN -d ELSE d END)) AS s FROM numbered, (SELECT unnest(range((1 << (SELECT n FROM o))::BIGINT)) AS mask) GROUP BY 1)
SELECT n, round(o::DOUBLE / 1099511627776 / n, 9) AS observed, count(*) FILTER (s >= o) AS extreme, count(*) AS total, round(count(*) FILTER (s >= o) / count(*), 9) AS p_value
FROM sums, o GROUP BY n, o""",
    "signflip_sampled": _DIFFS
    + f""", o AS (SELECT abs(sum({_FLIP_SUM})) AS o, count(*) AS n FROM diffs),
sums AS (SELECT draw, abs(sum(CASE WHEN {_bits("sha256('3|' || draw || '|' || example_id)", 1)} >= 8 THEN -{_FLIP_SUM} ELSE {_FLIP_SUM} END)) AS s
  FROM diffs, (SELECT unnest(range(100)) AS draw) GROUP BY 1)
SELECT n, round(o::DOUBLE / 1099511627776 / n, 9) AS observed, count(*) FILTER (s >= o) AS extreme, count(*) AS total,
  round((count(*) FILTER (s >= o) + 1) / (count(*) + 1), 9) AS p_value FROM sums, o GROUP BY n, o""",
    "bootstrap_hash": _SCORED + ", mine AS (SELECT * FROM scored WHERE run_name = 'reader_base')" + _bootstrap("mine", "example_id", "f1", 5, 100),
    "paired_bootstrap_hash": _DIFFS + _bootstrap("diffs", "example_id", "diff", 5, 100),
    "reader_summary": """SELECT run_name, count(*) AS n, sum(input_tokens)::BIGINT AS input_tokens, sum(generated_tokens)::BIGINT AS generated_tokens,
  round(avg(latency_seconds), 9) AS mean_latency, min(latency_seconds) AS least_latency, max(latency_seconds) AS most_latency,
  count(*) FILTER (budget_exhausted) AS n_exhausted, count(*) FILTER (extraction.status = 'ok') AS n_ok,
  bool_and(coalesce(extraction.status = 'ok', false) AND NOT coalesce(budget_exhausted, false)) AS gate FROM predictions GROUP BY 1""",
    "final_answer_parse": rf"""WITH k AS (SELECT prediction_id, {_strip(_KEPT.format("raw_output"))} AS kept FROM predictions),
l AS (SELECT *, regexp_extract_all(kept, '(?im)^{_WS}*(?:final{_WS}+)?answer{_WS}*:{_WS}*(.+?){_WS}*$', 1) AS lines FROM k),
u AS (SELECT *, {_bare("lines[-1]")} AS u FROM l), v AS (SELECT *, {_unwrap("u", chr(92) + "boxed")} AS v FROM u), w AS (SELECT *, {_unwrap("v", chr(92) + "text")} AS a FROM v),
s AS (SELECT *, CASE WHEN coalesce(kept, '') = '' THEN 'empty' WHEN len(lines) = 0 THEN 'missing_final_answer' WHEN a = '' THEN 'empty_final_answer' ELSE 'ok' END AS status FROM w)
SELECT prediction_id, CASE WHEN status = 'ok' THEN a END AS answer, status,
  CASE status WHEN 'ok' THEN 'last_answer_line' WHEN 'empty_final_answer' THEN 'answer_line' ELSE 'none' END AS method FROM s""",
    "short_answer_parse": rf"""WITH k AS (SELECT prediction_id, {_strip(_KEPT.format("string_split(coalesce(raw_output, ''), '<|box_end|>')[1]"))} AS kept FROM predictions),
b AS (SELECT *, {_bare(_boxed("kept"))} AS v FROM k),
c AS (SELECT *, CASE WHEN starts_with(v, '\text{{') THEN {_unwrap("v", chr(92) + "text")} WHEN starts_with(v, '\mathrm{{') THEN {_unwrap("v", chr(92) + "mathrm")} ELSE {_unwrap("v", chr(92) + "operatorname")} END AS boxed,
  list_filter(list_transform(string_split_regex(kept, {_LINES}), lambda x: {_strip("x")}), lambda x: x <> '')[1] AS line FROM b),
d AS (SELECT *, {_bare(f"regexp_replace(coalesce(line, ''), '(?i)^(?:final )?answer:{_WS}*', '')")} AS first FROM c),
e AS (SELECT prediction_id, coalesce(boxed <> '', false) AS in_box, CASE WHEN coalesce(boxed <> '', false) THEN boxed ELSE nullif(first, '') END AS answer FROM d)
SELECT prediction_id, answer, CASE WHEN answer IS NULL THEN 'empty' ELSE 'ok' END AS status,
  CASE WHEN answer IS NULL THEN 'none' WHEN in_box THEN 'latex_boxed' ELSE 'first_line' END AS method FROM e""",
    "explicit_reasoning": rf"""WITH r AS (SELECT run_name, len(list_filter(list_transform(string_split_regex({_KEPT.format("raw_output")}, {_LINES}), lambda x: {_strip("x")}),
  lambda x: x <> '' AND NOT regexp_matches(x, '(?i)^(?:final{_WS}+)?answer{_WS}*:'))) > 0 AS r FROM predictions)
SELECT run_name, count(*) AS n, count(*) FILTER (coalesce(r, false)) AS n_reasoned FROM r GROUP BY 1""",
    "reasoning_detect": "@reasoning@ SELECT prediction_id, content <> '' AS present, method, content FROM s",
    "reasoning_methods": "@reasoning@ SELECT run_name, method, content <> '' AS present, count(*) AS n FROM s GROUP BY ALL",
    "interface_gate": "@gate@",
    "boxed_parse": rf"""SELECT prediction_id, {_boxed("raw_output")} AS content FROM predictions WHERE contains(raw_output, '\boxed{{')""",
    "serialize_context": f"""WITH {_GOLD} SELECT example_id, sha256({_serialized("question", _EVIDENCE)} || chr(10)) AS prompt_sha256 FROM g WHERE question IS NOT NULL AND context IS NOT NULL""",
    "instructed_query": """SELECT record_id, sha256('Instruct: Given a web search query, retrieve relevant passages that answer the query' || chr(10) || 'Query:' || question) AS query_sha256
FROM examples WHERE trim(question) <> ''""",
    "compute_projection": """WITH r AS (SELECT run_name, count(*) AS n, sum(latency_seconds) AS s FROM predictions WHERE latency_seconds > 0 GROUP BY 1)
SELECT run_name, round(n / s, 6) AS rate, floor(5233235 / (n / s) * 1.25 / 3600 + 0.999999999)::BIGINT AS hours FROM r""",
    "example_seed": "SELECT DISTINCT identifier, (('0x' || substr(sha256('42' || chr(0) || identifier), 1, 16))::UBIGINT)::VARCHAR AS seed FROM examples WHERE identifier IS NOT NULL",
    "budget_truncation": f"""WITH {_GOLD}, {_PARAGRAPHS}, {_SENTENCES},
s AS (SELECT example_id, paragraph_index, sentence_index, len({_words("sentence")}) AS cost FROM sentences WHERE sentence IS NOT NULL),
r AS (SELECT *, sum(cost) OVER (PARTITION BY example_id ORDER BY paragraph_index, sentence_index) AS running FROM s)
SELECT example_id, count(*) AS n_sentences, count(*) FILTER (running <= 60) AS n_kept, coalesce(max(running) FILTER (running <= 60), 0)::BIGINT AS cost,
  count(*) FILTER (running <= 60) < count(*) AS truncated FROM r GROUP BY 1""",
}

_REASONING = f"""WITH k AS (SELECT prediction_id, run_name, raw_output, budget_exhausted, coalesce({_KEPT.format("raw_output")}, '') AS t FROM predictions),
m AS (SELECT *, CASE WHEN contains(t, '</think>') THEN 'closed_think_block' WHEN contains(t, '<think>') THEN 'unclosed_think_block' ELSE 'pre_answer_text' END AS method FROM k),
c AS (SELECT *, CASE method WHEN 'closed_think_block' THEN string_split(string_split(t, '</think>')[1], '<think>')[-1]
  WHEN 'unclosed_think_block' THEN string_split(t, '<think>')[-1]
  ELSE string_split_regex(t, '{_ANSWER_START}')[1] END AS c FROM m),
s AS (SELECT * EXCLUDE c, {_strip("regexp_replace(" + _CONTROL.format("c") + f", '{_WS}+', ' ', 'g')")} AS content FROM c)"""
for _name in ("reasoning_detect", "reasoning_methods"):
    SQL[_name] = SQL[_name].replace("@reasoning@", _REASONING)
SQL["interface_gate"] = (
    _REASONING
    + f""", f AS ({SQL["final_answer_parse"]}), j AS (SELECT s.run_name, f.status = 'ok' AS ok, s.content <> '' AS present, coalesce(s.budget_exhausted, false) AS exhausted FROM s JOIN f USING (prediction_id))
SELECT run_name, count(*) FILTER (ok) AS n_valid, count(*) FILTER (present) AS n_reasoning, count(*) FILTER (exhausted) AS n_exhausted, bool_and(ok AND present AND NOT exhausted) AS gate FROM j GROUP BY 1"""
)
SQL["direct_prompts"] = _prompt_counts(_DIRECT, "'Answer:<|im_end|>'", 220)
SQL["chat_prompts"] = _prompt_counts(_CHAT, "'<|im_end|> <|im_start|>assistant'", 220)
