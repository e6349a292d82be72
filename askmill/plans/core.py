"""The reference workload over the given tables: one query for each operator or closely related group."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from askmill.functions import text as T
from askmill.operators import audit, dense, evalret, lexical, prompts, qa, sampling, stats
from askmill.sources import corpus, sinks
from askmill.streaming import incremental
from askmill.tables import checkpoint_dir, cut, remove, table

CUTOFFS = (1, 2, 5, 10)
SEARCH_STEP = 50


def _questions(spark: SparkSession, d: str) -> DataFrame:
    """The stated query set of searches: every record whose id is divisible by 50."""
    rows = table(spark, d, "examples").where(f"record_id % {SEARCH_STEP} = 0 AND question IS NOT NULL")
    return rows.select(F.col("record_id").alias("query_id"), "question")


def _gold(spark: SparkSession, d: str) -> DataFrame:
    """Different records only: exact copies are delivered as well."""
    return table(spark, d, "gold").distinct()


def _facts(spark: SparkSession, d: str) -> DataFrame:
    rows = _gold(spark, d).select("example_id", F.posexplode("supporting_facts").alias("fact_index", "f"))
    return rows.where("f IS NOT NULL").select("example_id", "fact_index", "f.title", "f.sentence_id")


def _paragraphs(spark: SparkSession, d: str) -> DataFrame:
    rows = _gold(spark, d).select("example_id", "question", F.posexplode("context").alias("paragraph_index", "p"))
    return rows.where("p IS NOT NULL").select("example_id", "question", "paragraph_index", "p.title", "p.sentences")


def _ranking(spark: SparkSession, d: str) -> DataFrame:
    return evalret.rank_hits(table(spark, d, "retrieval"), max(CUTOFFS))


def _ranks(spark: SparkSession, d: str) -> DataFrame:
    batches = table(spark, d, "retrieval")
    return evalret.gold_ranks(evalret.relevant_titles(batches), evalret.rank_hits(batches, max(CUTOFFS)))


def _latest_predictions(spark: SparkSession, d: str) -> DataFrame:
    """The last delivered row of each example and run."""
    last = Window.partitionBy("example_id", "run_name").orderBy(F.desc("created_at"), F.desc("prediction_id"))
    rows = table(spark, d, "predictions").where("example_id IS NOT NULL")
    return rows.withColumn("nth", F.row_number().over(last)).where("nth = 1").drop("nth")


def _scored(spark: SparkSession, d: str) -> DataFrame:
    rows = _latest_predictions(spark, d).where("gold_answer IS NOT NULL")
    score = qa.answer_score(F.coalesce("prediction", F.lit("")), F.col("gold_answer"))
    return rows.select("prediction_id", "example_id", "run_name", "latency_seconds", score.alias("s")).select("*", "s.f1")


# lexical retrieval


def tokenize_stats(spark, d):
    docs = table(spark, d, "documents")
    n = F.greatest(F.size(T.tokens(F.coalesce("text", F.lit("")))), F.lit(0))
    return docs.groupBy("lang").agg(F.count("*").alias("n_docs"), F.sum(n).alias("n_tokens"))


def term_freq_top(spark, d):
    tf = lexical.term_frequencies(table(spark, d, "documents"))
    return tf.groupBy("term").agg(F.sum("tf").alias("cf")).orderBy(F.desc("cf"), "term").limit(100)


def doc_freq_top(spark, d):
    df = lexical.document_frequencies(lexical.term_frequencies(table(spark, d, "documents")))
    return df.orderBy(F.desc("df"), "term").limit(100)


def bm25_corpus_topk(spark, d):
    return lexical.bm25_top_k(table(spark, d, "documents"), _questions(spark, d), 10)


def bm25_fts_variant_topk(spark, d):
    return lexical.bm25_top_k(table(spark, d, "documents"), _questions(spark, d), 10, lexical.FULL_TEXT)


def bm25_candidate_topk(spark, d):
    return lexical.top_k(lexical.candidate_bm25(_candidates(spark, d).drop("title")), 5, item="item")


def _candidates(spark, d):
    return _paragraphs(spark, d).select(
        F.col("example_id").alias("query_id"), "question", F.col("paragraph_index").alias("item"), "title",
        T.paragraph_text(F.coalesce("sentences", F.array().cast("array<string>"))).alias("text"),
    )


def candidate_rerank_recall(spark, d):
    """Recall of paragraphs and of facts when each example's own paragraphs are ranked, as means over the examples."""
    candidates = _candidates(spark, d)
    ranked = lexical.top_k(lexical.candidate_bm25(candidates), max(CUTOFFS), item="item")
    named = ranked.join(candidates.select("query_id", "item", "title"), ["query_id", "item"])
    ranking = named.where("title IS NOT NULL").groupBy(F.col("query_id").alias("example_id"), F.col("title").alias("document_id")).agg(F.min("rank").alias("rank"))
    facts = _facts(spark, d).where("title IS NOT NULL").select("example_id", F.col("title").alias("document_id"))
    per_paragraph = evalret.recall_at(evalret.gold_ranks(facts.distinct(), ranking), CUTOFFS)
    per_fact = evalret.fact_recall_at(facts, ranking, CUTOFFS)
    rows = per_paragraph.join(per_fact, "example_id")
    means = [F.round(F.avg(f"{c}_{k}"), 9).alias(f"{c}_{k}") for k in CUTOFFS for c in ("recall_at", "fact_recall_at")]
    return rows.agg(F.count("*").alias("n"), *means)


# quality of rankings


def ranking_top10(spark, d):
    return _ranking(spark, d).select("example_id", "rank", "document_id", F.round("score", 6).alias("score"))


def recall_at_k(spark, d):
    rows = evalret.recall_at(_ranks(spark, d), CUTOFFS)
    return rows.select("example_id", *(F.round(f"recall_at_{k}", 9).alias(f"recall_at_{k}") for k in CUTOFFS), *(f"all_at_{k}" for k in CUTOFFS))


def recall_macro(spark, d):
    rows = evalret.recall_at(_ranks(spark, d), CUTOFFS)
    return rows.agg(F.count("*").alias("n"), *(F.round(F.avg(c), 9).alias(c) for c in rows.columns if c != "example_id"))


def gold_titles_in_order(spark, d):
    rows = table(spark, d, "retrieval").select("batch_id", F.array_distinct(F.array_compact("gold_titles")).alias("t"))
    return rows.select("batch_id", F.array_join("t", " | ").alias("titles"), F.coalesce(F.size("t"), F.lit(-1)).alias("n"))


def fact_recall_at_k(spark, d):
    facts = _facts(spark, d).select("example_id", F.col("title").alias("document_id"))
    rows = evalret.fact_recall_at(facts, _ranking(spark, d), CUTOFFS)
    return rows.select("example_id", "n_facts", *(F.round(f"fact_recall_at_{k}", 9).alias(f"fact_recall_at_{k}") for k in CUTOFFS))


def outcome_histogram(spark, d):
    return evalret.outcomes(_ranks(spark, d))


def rank_bins(spark, d):
    return evalret.rank_bins(_ranks(spark, d))


def missing_gold_top20(spark, d):
    return evalret.missing_top(_ranks(spark, d), 20)


def recall_by_type_and_level(spark, d):
    attributes = _gold(spark, d).select("example_id", "question_type", "level")
    return evalret.grouped_means(evalret.recall_at(_ranks(spark, d), (10,)), attributes, ("question_type", "level"), "recall_at_10")


def nested_ranking(spark, d):
    lists = sinks.nested_rankings(_ranking(spark, d))
    return lists.select("example_id", F.array_join(F.transform("retrieved", lambda h: h.document_id), " | ").alias("document_ids"))


def retrieval_throughput(spark, d):
    rows = table(spark, d, "retrieval").where("latency_seconds > 0")
    return rows.groupBy("shard_index").agg(F.count("*").alias("n"), F.round(F.count("*") / F.sum("latency_seconds"), 6).alias("batches_per_second"))


# answers


def answer_norm(spark, d):
    return table(spark, d, "predictions").select("prediction_id", T.normalize_answer(F.col("prediction")).alias("normalized"))


def answer_f1(spark, d):
    rows = _scored(spark, d)
    return rows.select("prediction_id", *(F.round(f"s.{m}", 9).alias(m) for m in ("em", "f1", "prec", "recall")))


def answer_macro(spark, d):
    rows = _scored(spark, d)
    return rows.groupBy("run_name").agg(F.count("*").alias("n"), *(F.round(F.avg(f"s.{m}"), 9).alias(m) for m in ("em", "f1", "prec", "recall")))


def _evaluated(spark, d):
    """Support is compared as (title, sentence_id): predicted are the first sentences of the two best documents."""
    fact = "array<struct<title:string,sentence_id:int>>"
    examples = _gold(spark, d).select("example_id", "answer", F.filter("supporting_facts", lambda f: f.isNotNull()).cast(fact).alias("facts"))
    answers = _latest_predictions(spark, d).where("run_name = 'reader_base'").select("example_id", F.coalesce("prediction", F.lit("")).alias("prediction"))
    first = F.struct(F.col("document_id").alias("title"), F.lit(0).alias("sentence_id"))
    support = _ranking(spark, d).where("rank <= 2").groupBy("example_id").agg(F.collect_set(first).cast(fact).alias("predicted"))
    return qa.evaluate(examples, answers, support)


def evaluate_examples(spark, d):
    rows = _evaluated(spark, d)
    return rows.select("example_id", "missing_answer", "missing_support", *(F.round(m, 9).alias(m) for m in qa.METRICS))


def evaluate_macro(spark, d):
    return qa.macro(_evaluated(spark, d))


# samples


def hash_slice(spark, d):
    return sampling.hash_slice(table(spark, d, "examples").select("record_id", "identifier"), "record_id", 100, 13)


def two_phase_slice(spark, d):
    rows = table(spark, d, "examples").select("record_id", "identifier", "split_name")
    parts = [rows.where(F.col("split_name") == s).drop("split_name") for s in ("train", "validation", "test")]
    return sampling.two_phase_slice(parts, "record_id", 100, 13)


def systematic_sample(spark, d):
    numbered = sampling.ordinals(table(spark, d, "documents").select("doc_id"), "doc_id")
    return sampling.systematic(numbered, 100).select("rowid", "doc_id")


def _base(spark, d):
    rows = _paragraphs(spark, d).where("title IS NOT NULL").select("example_id", "paragraph_index", F.col("title").alias("document_id"))
    first = rows.groupBy("example_id", "document_id").agg(F.min("paragraph_index").alias("at"))
    order = Window.partitionBy("example_id").orderBy("at")
    return first.withColumn("place", F.row_number().over(order)).select("example_id", "document_id", "place")


def _searched_base(spark, d):
    """The base documents of the stated query set: examples of which a record has an id divisible by 50."""
    asked = table(spark, d, "examples").where(f"record_id % {SEARCH_STEP} = 0").select(F.col("identifier").alias("example_id")).distinct()
    return _base(spark, d).join(asked, "example_id", "left_semi")


def distractors(spark, d):
    return sampling.distractors(_searched_base(spark, d).drop("place"), table(spark, d, "documents").select("document_id"), 2, 7)


def append_distractors(spark, d):
    base = cut(_searched_base(spark, d))  # read by the search and again beside its result
    extra = sampling.distractors(base.drop("place"), table(spark, d, "documents").select("document_id"), 2, 7)
    return prompts.append_distractors(base, extra)


# joins and checks


def gold_semi_join(spark, d):
    kept = prompts.gold_paragraphs(F.col("context"), F.col("supporting_facts"))
    return _gold(spark, d).select("example_id", F.coalesce(F.size(kept), F.lit(-1)).alias("n"), F.array_join(F.transform(kept, lambda p: p.title), " | ").alias("titles"))


def anti_join_pool(spark, d):
    known = _paragraphs(spark, d).select(F.col("title").alias("document_id")).distinct()
    return table(spark, d, "documents").where("document_id IS NOT NULL").select("document_id").distinct().join(known, "document_id", "left_anti")


def fact_sentence_join(spark, d):
    sentences = _paragraphs(spark, d).select("example_id", "title", "paragraph_index", F.posexplode("sentences").alias("sentence_id", "sentence"))
    joined = _facts(spark, d).join(sentences, ["example_id", "title", "sentence_id"])
    return joined.select("example_id", "fact_index", "paragraph_index", "sentence")


def ref_range_issues(spark, d):
    paragraphs = _paragraphs(spark, d).select("example_id", "title", F.greatest(F.coalesce(F.size("sentences"), F.lit(0)), F.lit(0)).alias("n_sentences"))
    return audit.reference_issues(_facts(spark, d), paragraphs).select("example_id", "fact_index", "title", "sentence_id", "n_sentences")


def record_violations(spark, d):
    return audit.record_violations(_gold(spark, d))


def ranking_violations(spark, d):
    return audit.ranking_violations(table(spark, d, "retrieval").select("batch_id", "retrieved"))


def metric_compare_tol(spark, d):
    rows = table(spark, d, "predictions").where("gold_answer IS NOT NULL AND answer_score IS NOT NULL")
    metrics = ["em", "f1", "prec", "recall"]
    again = rows.select("prediction_id", qa.answer_score(F.coalesce("prediction", F.lit("")), F.col("gold_answer")).alias("s")).select("prediction_id", "s.*")
    names = dict(zip(metrics, ("exact_match", "f1", "precision", "recall")))
    stored = rows.select("prediction_id", *(F.col(f"answer_score.{names[m]}").alias(m) for m in metrics))
    found = audit.compare_fields(stored, again, "prediction_id", metrics, 1e-12)
    return found.groupBy("field").agg(F.count("*").alias("n_different"))


def ranking_equivalence(spark, d):
    """Ordered signatures (example, rank, document, score) of the rankings of even and of odd shards, with multiplicity."""
    batches = table(spark, d, "retrieval")
    even, odd = (evalret.rank_hits(batches.where(F.col("shard_index") % 2 == k), max(CUTOFFS)) for k in (0, 1))
    both = even.select("example_id").distinct().join(odd.select("example_id").distinct(), "example_id")
    even, odd = (r.join(both, "example_id", "left_semi").withColumn("score", F.round("score", 9)) for r in (even, odd))
    return audit.set_difference(even, odd, ["example_id", "rank", "document_id", "score"]).groupBy("side").agg(F.count("*").alias("n"))


def incomplete_rankings(spark, d):
    queries = table(spark, d, "retrieval").where("example_id IS NOT NULL").select("example_id")
    return audit.incomplete_rankings(queries, _ranking(spark, d), max(CUTOFFS))


def revised_before_neighbour(spark, d):
    """Documents whose revision is not after that of the document before, counted by day."""
    rows = table(spark, d, "documents").where("revised_at IS NOT NULL").select("doc_id", "revised_at")
    return audit.not_increasing(rows, "doc_id", "revised_at").groupBy(F.to_date("revised_at").cast("string").alias("day")).agg(F.count("*").alias("n"))


def canonical_id_issues(spark, d):
    rows = table(spark, d, "documents").where("title IS NOT NULL AND document_id IS NOT NULL")
    differs = F.col("document_id") != T.canonical_title("title")
    return rows.groupBy("source").agg(F.count("*").alias("n"), F.count_if(differs).alias("n_different"))


def run_compare(spark, d):
    return audit.run_comparison(_latest_predictions(spark, d), "reader_base", "reader_small")


def cross_input_duplicates(spark, d):
    rows = table(spark, d, "examples").groupBy("identifier").agg(F.count_distinct("split_name").alias("splits"), F.count("*").alias("n"))
    return rows.where("splits > 1")


def positional_join(spark, d):
    """Two runs joined row by row, each in the order of its examples: rows whose examples differ or that stand alone."""
    runs = [_latest_predictions(spark, d).where(F.col("run_name") == r).select("example_id") for r in ("reader_base", "reader_small")]
    paired = audit.paired_by_position(*runs, "example_id", "example_id")
    return audit.position_mismatches(paired).select("place", F.col("left").alias("left_id"), F.col("right").alias("right_id"))


def extraction_compare(spark, d):
    rows = table(spark, d, "predictions")
    same = F.col("extraction.answer").eqNullSafe(F.col("prediction"))
    return rows.groupBy("run_name").agg(F.count("*").alias("n"), F.count_if(~same).alias("n_different"))


def prompt_sha256(spark, d):
    rows = table(spark, d, "predictions").where("prompt IS NOT NULL")
    same = F.coalesce(F.sha2("prompt", 256) == F.col("prompt_sha256"), F.lit(False))
    return rows.groupBy("run_name").agg(F.count("*").alias("n"), F.count_if(same).alias("n_equal"))


# shards


def shard_ledger(spark, d):
    numbered = sampling.ordinals(table(spark, d, "documents").select("doc_id"), "doc_id")
    return incremental.shard_ledger(audit.segments(numbered, 128))


def shard_contiguity(spark, d):
    ids = table(spark, d, "documents").select(F.col("doc_id").alias("rowid"))
    return audit.contiguity_issues(incremental.shard_ledger(audit.segments(ids, 128)))


CHUNK = 48


def _built_shards(spark, d):
    """The documents in shards of 128, with the tokens that a reader of ``CHUNK`` tokens sees of each."""
    numbered = sampling.ordinals(table(spark, d, "documents").select("doc_id", "text"), "doc_id")
    seen = prompts.first_chunk(T.tokens(F.coalesce("text", F.lit(""))), CHUNK)
    rows = audit.segments(numbered, 128).select("shard_index", "rowid", "doc_id", seen.alias("seen"))
    return rows.select("shard_index", "rowid", "doc_id", F.size("seen.chunk").cast("bigint").alias("tokens"), "seen.n_chunks", "seen.truncated")


def shard_totals(spark, d):
    return incremental.ledger_totals(incremental.full_ledger(_built_shards(spark, d)))


def shard_bound_issues(spark, d):
    return audit.bound_issues(incremental.full_ledger(_built_shards(spark, d)))


def first_overflow_chunk(spark, d):
    return _built_shards(spark, d).where("n_chunks > 1").select("doc_id", "tokens", "n_chunks")


# vectors


def dense_topk(spark, d):
    vectors = table(spark, d, "embeddings").where("embedding IS NOT NULL")
    queries = vectors.where(f"vec_id % {SEARCH_STEP} = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return dense.dense_top_k(vectors.select("vec_id", "embedding"), queries, 10)


def l2_normalise_mrl(spark, d):
    head = dense.shortened(F.col("embedding"), 32)
    return table(spark, d, "embeddings").select(
        "vec_id", F.round(dense.norm(F.col("embedding")), 6).alias("norm"), F.round(dense.norm(F.slice("embedding", 1, 32)), 6).alias("head_norm"),
        F.round(F.element_at(head, 1), 6).alias("first"),
    )


def norm_error_check(spark, d):
    error = dense.half_precision_error(dense.shortened(F.col("embedding"), 32))
    return table(spark, d, "embeddings").select("label", error.alias("e")).groupBy("label").agg(F.count("*").alias("n"), F.count_if(F.col("e") > 0.002).alias("n_over"))


# statistics


def _diffs(spark, d):
    return stats.paired(_scored(spark, d), "example_id", "run_name", "reader_base", "reader_small", "f1")


def cohens_dz(spark, d):
    return stats.cohens_dz(_diffs(spark, d))


def quantile_p50_p95(spark, d):
    found = stats.quantiles(table(spark, d, "predictions").select("run_name", "latency_seconds"), "run_name", "latency_seconds", (0.5, 0.95))
    return found.select("run_name", "n", F.round("q_0", 9).alias("p50"), F.round("q_1", 9).alias("p95"))


def signflip_exact(spark, d):
    attributes = _gold(spark, d).select("example_id", F.coalesce("question_type", F.lit("unknown")).alias("t"), F.coalesce("level", F.lit("unknown")).alias("l"))
    groups = _diffs(spark, d).join(attributes, "example_id").groupBy("t", "l").agg(F.round(F.avg("diff"), 9).alias("diff"))
    return stats.sign_flip_exact(groups)


def signflip_sampled(spark, d):
    return stats.sign_flip_sampled(_diffs(spark, d), "example_id", 100, 3)


def bootstrap_hash(spark, d):
    return stats.bootstrap(_scored(spark, d).where("run_name = 'reader_base'"), "example_id", "f1", 100, 5)


def paired_bootstrap_hash(spark, d):
    return stats.bootstrap(_diffs(spark, d), "example_id", "diff", 100, 5)


def bootstrap_by_level(spark, d):
    rows = _scored(spark, d).join(_gold(spark, d).select("example_id", "level"), "example_id")
    drawn = rows.select(F.coalesce("level", F.lit("unknown")).alias("level"), F.concat_ws("|", "run_name", "example_id").alias("k"), "f1")
    return stats.bootstrap(drawn, "k", "f1", 200, 11, by="level")


def reader_summary(spark, d):
    rows = table(spark, d, "predictions")
    ok = F.coalesce(F.col("extraction.status") == "ok", F.lit(False))
    exhausted = F.coalesce("budget_exhausted", F.lit(False))
    return rows.groupBy("run_name").agg(
        F.count("*").alias("n"),
        F.sum("input_tokens").alias("input_tokens"),
        F.sum("generated_tokens").alias("generated_tokens"),
        F.round(F.avg("latency_seconds"), 9).alias("mean_latency"),
        F.min("latency_seconds").alias("least_latency"),
        F.max("latency_seconds").alias("most_latency"),
        F.count_if(exhausted).alias("n_exhausted"),
        F.count_if(ok).alias("n_ok"),
        F.bool_and(ok & ~exhausted).alias("gate"),
    )


# parsing and prompts


def final_answer_parse(spark, d):
    rows = table(spark, d, "predictions").select("prediction_id", T.final_answer(F.col("raw_output")).alias("e"))
    return rows.select("prediction_id", "e.answer", "e.status", "e.method")


def short_answer_parse(spark, d):
    rows = table(spark, d, "predictions").select("prediction_id", T.short_answer(F.coalesce("raw_output", F.lit(""))).alias("e"))
    return rows.select("prediction_id", "e.answer", "e.status", "e.method")


def explicit_reasoning(spark, d):
    rows = table(spark, d, "predictions").select("run_name", T.explicit_reasoning(F.col("raw_output")).alias("r"))
    return rows.groupBy("run_name").agg(F.count("*").alias("n"), F.count_if("r").alias("n_reasoned"))


def reasoning_detect(spark, d):
    rows = table(spark, d, "predictions").select("prediction_id", T.reasoning(F.col("raw_output")).alias("r"))
    return rows.select("prediction_id", "r.present", "r.method", "r.content")


def reasoning_methods(spark, d):
    rows = table(spark, d, "predictions").select("run_name", T.reasoning(F.col("raw_output")).alias("r"))
    return rows.groupBy("run_name", "r.method", "r.present").agg(F.count("*").alias("n"))


def interface_gate(spark, d):
    """Per run: whether every output parses, reasons, and none was exhausted or has a shortened prompt."""
    rows = table(spark, d, "predictions").select(
        "run_name", T.final_answer(F.col("raw_output")).alias("e"), T.reasoning(F.col("raw_output")).alias("r"), F.coalesce("budget_exhausted", F.lit(False)).alias("exhausted")
    )
    ok, present = F.col("e.status") == "ok", F.col("r.present")
    return rows.groupBy("run_name").agg(
        F.count_if(ok).alias("n_valid"), F.count_if(present).alias("n_reasoning"), F.count_if("exhausted").alias("n_exhausted"), F.bool_and(ok & present & ~F.col("exhausted")).alias("gate")
    )


def boxed_parse(spark, d):
    rows = table(spark, d, "predictions").where(F.contains("raw_output", F.lit("\\boxed{")))
    return rows.select("prediction_id", T.boxed_content(F.col("raw_output")).alias("content"))


def serialize_context(spark, d):
    rows = _gold(spark, d).where("question IS NOT NULL AND context IS NOT NULL")
    return rows.select("example_id", F.sha2(T.serialized_context(F.col("question"), F.col("context")), 256).alias("prompt_sha256"))


def instructed_query(spark, d):
    rows = table(spark, d, "examples").where("trim(question) != ''")
    return rows.select("record_id", F.sha2(T.instructed_query(F.col("question")), 256).alias("query_sha256"))


PROMPT_BUDGET = 220


def _demonstrations(spark, d):
    """Two stated examples: the first by hash among those that have an answer and a fact in a paragraph."""
    evidence = prompts.gold_paragraphs(F.col("context"), F.col("supporting_facts"))
    usable = _gold(spark, d).where(F.col("answer").isNotNull() & F.col("question").isNotNull() & (F.size(evidence) > 0))
    return usable.orderBy(sampling.hash_key(3, F.col("example_id")), "example_id").limit(2)


def _prompts(spark, d, build):
    targets = _gold(spark, d).where("example_id IS NOT NULL AND question IS NOT NULL").select("example_id", "question", "context")
    made = build(targets, _demonstrations(spark, d), PROMPT_BUDGET)
    return made.select("example_id", "input_tokens", "n_documents", "n_sentences", "dropped_documents", "dropped_sentences", "truncated", "status")


def direct_prompts(spark, d):
    return _prompts(spark, d, prompts.direct_prompts)


def chat_prompts(spark, d):
    return _prompts(spark, d, prompts.chat_prompts)


def budget_truncation(spark, d):
    sentences = _paragraphs(spark, d).select("example_id", "paragraph_index", F.posexplode("sentences").alias("sentence_index", "sentence"))
    sentences = sentences.where("sentence IS NOT NULL")
    kept = prompts.budgeted_sentences(sentences, 60, F.greatest(F.size(T.tokens(F.col("sentence"))), F.lit(0)))
    return prompts.truncation(sentences, kept)


def example_seed(spark, d):
    rows = table(spark, d, "examples").where("identifier IS NOT NULL").select("identifier").distinct()
    return rows.select("identifier", T.example_seed(F.lit(42), F.col("identifier")).cast("string").alias("seed"))


def compute_projection(spark, d):
    rows = table(spark, d, "predictions").where("latency_seconds > 0").groupBy("run_name").agg(F.count("*").alias("n"), F.sum("latency_seconds").alias("s"))
    p = dense.compute_projection(F.col("n"), F.col("s"), F.lit(5_233_235), 1.25)
    return rows.select("run_name", F.round(p.rate, 6).alias("rate"), p.hours.cast("bigint").alias("hours"))


def unicode_title(spark, d):
    rows = table(spark, d, "documents").where("title IS NOT NULL").select("title").distinct()
    titled = rows.select("title", T.canonical_title("title").alias("canonical"))
    return titled.groupBy("canonical").agg(F.count("*").alias("n_spellings"))


def stream_term_counts(spark, d):
    folder = f"{checkpoint_dir(spark)}/term-counts-{uuid.uuid4().hex}"
    documents = table(spark, d, "documents")
    # a stream reads a folder: the table's own, or the one that the table lies in as a single file
    single = documents.inputFiles()[0].endswith("/documents.parquet")
    source, files = (d, "documents.parquet") if single else (f"{d}/documents.parquet", "*.parquet")
    incremental.stream_term_counts(spark, source, documents.schema, f"{folder}/out", f"{folder}/state", files)
    top = cut(incremental.current_term_counts(spark, f"{folder}/out").orderBy(F.desc("df"), "term").limit(100))
    remove(spark, folder)
    return top


def corpus_scan(spark, d):
    """The documents written as compressed JSON lines, their texts as a string, a list or lists of lists, and read as a corpus."""
    folder = f"{checkpoint_dir(spark)}/corpus-{uuid.uuid4().hex}"
    rows = table(spark, d, "documents").select("doc_id", "title", "text", F.to_json(F.struct(F.col("wiki_id").alias("id"), "title", "text")).alias("flat"))
    listed = F.to_json(F.struct("title", F.array("text").alias("text")))
    nested = F.to_json(F.struct("title", F.array(F.array(F.substring("text", 1, 9), F.expr("substring(text, 10)"))).alias("text")))
    kind = F.when(F.col("text").isNull(), 0).otherwise(F.col("doc_id") % 3)
    line = F.when(kind == 0, F.col("flat")).when(kind == 1, listed).otherwise(nested)
    rows.select(line.alias("value")).write.option("compression", "bzip2").text(folder)
    documents = corpus.documents_of(corpus.corpus_lines(spark, [folder]))
    kept, quarantined = corpus.kept_and_quarantined(documents)
    sizes = kept.select(F.lit("kept").alias("outcome"), F.length("text").alias("n")).unionByName(quarantined.select(F.col("problem").alias("outcome"), F.lit(0).alias("n")))
    counted = cut(sizes.groupBy("outcome").agg(F.count("*").alias("n_documents"), F.sum("n").alias("n_characters")))
    remove(spark, folder)
    return counted


def resumable_shards(spark, d):
    """The vectors built into shards of 128 in two goes, finalised, and their ledger added up."""
    folder = f"{checkpoint_dir(spark)}/shards-{uuid.uuid4().hex}"
    vectors = table(spark, d, "embeddings").where("embedding IS NOT NULL").select("vec_id", "embedding")
    numbered = cut(sampling.ordinals(vectors, "vec_id"))
    head = dense.shortened(F.col("embedding"), 32)

    def encode(rows):
        return rows.select(
            "rowid", head.alias("vector"), F.size("embedding").cast("bigint").alias("tokens"), F.lit(False).alias("truncated"), dense.half_precision_error(head).alias("norm_error")
        )

    identity = dict.fromkeys(incremental.INVARIANT, "") | {"dimension": 32, "shard_documents": 128}
    n = numbered.count()
    for most in (2, None):
        store = incremental.ShardStore(spark, folder, n, identity)
        store.open()
        store.build(numbered, 128, encode, most)
    store.finalise(n)
    totals = incremental.ledger_totals(spark.read.parquet(f"{folder}/ledger"))
    totals = cut(totals.select("shard_count", "document_count", "tokens_processed", "truncated_documents", (F.col("max_norm_error") <= 0.002).alias("norms_hold")))
    remove(spark, folder)
    return totals


NAMES = (
    "tokenize_stats term_freq_top doc_freq_top bm25_corpus_topk bm25_fts_variant_topk bm25_candidate_topk candidate_rerank_recall ranking_top10 recall_at_k gold_titles_in_order "
    "recall_macro fact_recall_at_k outcome_histogram rank_bins missing_gold_top20 recall_by_type_and_level nested_ranking retrieval_throughput "
    "answer_norm answer_f1 answer_macro evaluate_examples evaluate_macro hash_slice two_phase_slice systematic_sample distractors append_distractors "
    "gold_semi_join anti_join_pool fact_sentence_join ref_range_issues record_violations ranking_violations metric_compare_tol ranking_equivalence incomplete_rankings revised_before_neighbour canonical_id_issues "
    "run_compare cross_input_duplicates positional_join extraction_compare prompt_sha256 shard_ledger shard_contiguity shard_totals shard_bound_issues first_overflow_chunk dense_topk l2_normalise_mrl norm_error_check "
    "cohens_dz quantile_p50_p95 reader_summary signflip_exact signflip_sampled bootstrap_hash paired_bootstrap_hash bootstrap_by_level final_answer_parse short_answer_parse "
    "explicit_reasoning reasoning_detect reasoning_methods interface_gate boxed_parse serialize_context instructed_query direct_prompts chat_prompts budget_truncation example_seed compute_projection unicode_title stream_term_counts corpus_scan resumable_shards"
).split()

QUERIES = {name: globals()[name] for name in NAMES}
