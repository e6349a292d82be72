import math

import pytest
from pyspark.sql import functions as F

from askmill.operators import audit, dense, evalret, lexical, prompts, qa, sampling, stats
from askmill.plans import core
from askmill.sources import corpus, sinks
from askmill.streaming import incremental


def docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_bm25_against_definition(spark):
    texts = ["a b b c", "b c", None, "", "d d d a", "b"]
    got = {r.doc_id: r.score for r in lexical.bm25(docs(spark, texts), spark.createDataFrame([(1, "b a b")], "query_id int, question string")).collect()}
    words = [(t or "").split() for t in texts]
    n, avg = len(words), sum(map(len, words)) / len(words)
    for k, w in enumerate(words):
        score = 0
        for term in ("a", "b"):
            df, tf = sum(term in x for x in words), w.count(term)
            score += math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(w) / avg))
        assert got.get(k, 0) == pytest.approx(score)


@pytest.mark.parametrize("variant", [lexical.IN_MEMORY, lexical.FULL_TEXT])
def test_bm25_top_k_equals_the_scores_of_all_pairs(spark, monkeypatch, variant):
    import random

    draw = random.Random(3)
    texts = [" ".join(draw.choices("abcdefghijkl", range(12, 0, -1), k=draw.randrange(1, 9))) for _ in range(60)] + [None, "", "zz"]
    asked = [(i, " ".join(draw.sample("abcdefghijklm", 4))) for i in range(23)] + [(30, ""), (31, None), (32, "m"), (33, "zz")]
    queries = spark.createDataFrame(asked, "query_id int, question string")
    corpus = docs(spark, texts * 2)
    want = sorted(map(tuple, lexical.top_k(lexical.bm25(corpus, queries, variant), 4).collect()))
    for tile, columns, share, sent in (((512, 2048), 256, 0.0025, 32_768), ((3, 4), 3, 0.0, 5), ((3, 4), 0, 0.0, 50)):
        monkeypatch.setattr(lexical, "TILE", tile), monkeypatch.setattr(lexical, "COLUMNS", columns)
        monkeypatch.setattr(lexical, "COLUMN_SHARE", share), monkeypatch.setattr(lexical, "SENT_QUERIES", sent)
        got = lexical.bm25_top_k(corpus, queries, 4, variant)
        assert sorted(map(tuple, got.collect())) == want
    assert lexical.bm25_top_k(corpus.where("false"), queries, 4, variant).count() == lexical.bm25_top_k(corpus, queries.where("false"), 4, variant).count() == 0


@pytest.mark.parametrize("query", [core.bm25_corpus_topk, core.bm25_fts_variant_topk])
def test_searches_make_no_row_for_each_pair(spark, data, query):
    plan = query(spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "Aggregate" not in plan and "Join" not in plan


def test_candidates_keep_zero_scores_in_order(spark):
    rows = [("q", "nothing", i, t) for i, t in ((2, "x"), (1, "y"), (3, None))]
    scored = lexical.candidate_bm25(spark.createDataFrame(rows, "query_id string, question string, item int, text string"))
    assert [(r.item, r.score) for r in lexical.top_k(scored, 5, item="item").orderBy("rank").collect()] == [(1, 0), (2, 0), (3, 0)]


@pytest.mark.parametrize(
    ("p", "g", "expected"),
    [("capital city Paris", "Paris", (0, 0.5, 1 / 3, 1)), ("no", "yes", (0, 0, 0, 0)), ("yes", "yes", (1, 1, 1, 1)), ("", "x", (0, 0, 0, 0)), ("b b c", "b b b", (0, 2 / 3, 2 / 3, 2 / 3))],
)
def test_answer_score(spark, p, g, expected):
    got = spark.createDataFrame([(p, g)], "p string, g string").select(qa.answer_score(F.col("p"), F.col("g")).alias("s")).first().s
    assert tuple(got) == pytest.approx(expected)


FACTS = "array<struct<title:string,sentence_id:int>>"


def test_support_is_compared_by_title_and_sentence(spark):
    df = spark.createDataFrame([([("A", 0), ("C", 2)], [("A", 0), ("B", 1)]), ([("A", 0)], [("A", 1)])], f"p {FACTS}, g {FACTS}")
    got = [tuple(r.s) for r in df.select(qa.support_score(F.col("p"), F.col("g")).alias("s")).collect()]
    assert got[0] == pytest.approx((0, 0.5, 0.5, 0.5)) and got[1] == (0, 0, 0, 0)


def test_missing_answers_make_joint_zero(spark):
    examples = spark.createDataFrame([("e", "x", [("A", 0)])], f"example_id string, answer string, facts {FACTS}")
    answers = spark.createDataFrame([], "example_id string, prediction string")
    support = spark.createDataFrame([("e", [("A", 0)])], f"example_id string, predicted {FACTS}")
    row = qa.evaluate(examples, answers, support).first()
    assert row.missing_answer and row.sp_em == 1 and row.joint_em == 0 and row.joint_f1 == 0


def test_recall_counts_distinct_and_facts(spark):
    ranking = spark.createDataFrame([("e", 1, "A"), ("e", 3, "B")], "example_id string, rank int, document_id string")
    relevant = spark.createDataFrame([("e", "A"), ("e", "Z")], "example_id string, document_id string")
    ranks = evalret.gold_ranks(relevant, ranking)
    row = evalret.recall_at(ranks, (1, 5)).first()
    assert (row.recall_at_1, row.all_at_5) == (0.5, 0)
    facts = spark.createDataFrame([("e", "A"), ("e", "A"), ("e", "Z")], "example_id string, document_id string")
    assert evalret.fact_recall_at(facts, ranking, (5,)).first().fact_recall_at_5 == pytest.approx(2 / 3)
    assert {r.bin: r.n for r in evalret.rank_bins(ranks).collect()} == {"1": 1, "2": 0, "3-5": 0, "6-10": 0, "missing": 1}


def diffs(spark, values):
    return spark.createDataFrame([(str(k), float(v)) for k, v in enumerate(values)], "k string, diff double")


def test_sign_flip_exact(spark):
    row = stats.sign_flip_exact(diffs(spark, [1.0] * 10)).first()
    assert (row.extreme, row.total) == (2, 1024)
    with pytest.raises(ValueError):
        stats.sign_flip_exact(diffs(spark, [1.0] * 17))


def test_cohens_dz(spark):
    assert stats.cohens_dz(diffs(spark, [1, 1])).first().dz == math.inf
    assert stats.cohens_dz(diffs(spark, [0, 0])).first().dz == 0


def test_bootstrap_does_not_depend_on_partitions(spark):
    rows = diffs(spark, range(50))
    a = stats.bootstrap(rows, "k", "diff", 50, 1).first()
    assert a == stats.bootstrap(rows.repartition(7), "k", "diff", 50, 1).first()
    assert a.low <= a.estimate <= a.high


def test_bootstrap_by_group_equals_each_group_alone(spark):
    rows = spark.range(400).select(F.col("id").alias("k"), F.when(F.col("id") % 7 > 0, "big").when(F.col("id") % 2 > 0, "small").alias("g"), (F.col("id") % 13 / 13).alias("v"))
    got = {r.g: tuple(r)[1:] for r in stats.bootstrap(rows, "k", "v", 50, 1, by="g").collect()}
    alone = {g: tuple(stats.bootstrap(rows.where(F.col("g").eqNullSafe(F.lit(g))), "k", "v", 50, 1).first()) for g in ("big", "small", None)}
    assert got == alone


def test_bootstrap_by_group_has_no_row_cap(spark):
    rows = spark.range(100_001).select("id", F.lit("all").alias("g"), (F.col("id") % 2).cast("double").alias("v"))
    (r,) = stats.bootstrap(rows, "id", "v", 4, 1, by="g").collect()
    assert r.n == 100_001 and r.low <= r.high and abs(r.estimate - 0.5) < 0.01


def test_bootstrap_of_a_single_value(spark):
    assert tuple(stats.bootstrap(diffs(spark, [3]), "k", "diff", 50, 1).first()) == (1, 3.0, 3.0, 3.0)


def test_systematic_positions(spark):
    numbered = sampling.ordinals(spark.range(1, 101).repartition(5), "id")
    assert sorted(r.rowid for r in sampling.systematic(numbered, 8).collect()) == [1, 13, 26, 38, 51, 63, 76, 88]


def test_slices_do_not_depend_on_order(spark):
    import hashlib

    rows = spark.range(200)
    a = [r.id for r in sampling.hash_slice(rows, "id", 20, 1).collect()]
    assert a == sorted(range(200), key=lambda i: hashlib.sha256(f"1\0{i}".encode()).digest())[:20]
    assert a == [r.id for r in sampling.hash_slice(rows.repartition(9), "id", 20, 1).collect()]
    assert a == [r.id for r in sampling.two_phase_slice([rows.where("id < 50"), rows.where("id >= 50")], "id", 20, 1).collect()]


@pytest.mark.parametrize(("size", "ids"), [(0, [1, 2]), (3, [1, 2]), (1, [1, 1])])
def test_slices_that_cannot_be(spark, size, ids):
    with pytest.raises(ValueError):
        sampling.hash_slice(spark.createDataFrame([(i,) for i in ids], "id long"), "id", size, 1)


def test_distractors_are_the_smallest_hashes_of_the_whole_pool(spark):
    import hashlib

    base = spark.createDataFrame([("e", str(k)) for k in range(0, 60, 2)] + [("f", "1")], "example_id string, document_id string")
    pool = spark.range(60).select(F.col("id").cast("string").alias("document_id"))
    got = {(r.example_id, r.place): r.document_id for r in sampling.distractors(base, pool.unionByName(pool), 3, 1).collect()}
    for e, own in (("e", {str(k) for k in range(0, 60, 2)}), ("f", {"1"})):
        ranked = sorted((d for d in map(str, range(60)) if d not in own), key=lambda d: hashlib.sha256(f"1\0{e}\0{d}".encode()).digest())
        assert [got[e, k] for k in (1, 2, 3)] == ranked[:3]
    assert sampling.distractors(base, pool, 30, 1).count() == 60
    with pytest.raises(ValueError):
        sampling.distractors(base, pool, 31, 1)


def test_distractors_sort_few_pairs_and_ask_again(spark, monkeypatch):
    def pairs():  # rows that joins without keys have given so far
        store, n = spark._jsparkSession.sharedState().statusStore(), 0
        for e in range(store.executionsCount()):
            run = store.executionsList().apply(e)
            nodes, values = store.planGraph(run.executionId()).allNodes(), store.executionMetrics(run.executionId())
            for node in map(nodes.apply, range(nodes.size())):
                metrics = [node.metrics().apply(i) for i in range(node.metrics().size())]
                if node.name().startswith(("BroadcastNestedLoopJoin", "CartesianProduct")):
                    n += sum(int(values.get(m.accumulatorId()).get().replace(",", "")) for m in metrics if m.name() == "number of output rows" and values.contains(m.accumulatorId()))
        return n

    base = spark.range(20).select(F.col("id").cast("string").alias("example_id"), (F.col("id") % 7).cast("string").alias("document_id"))
    pool = spark.range(5000).select(F.col("id").cast("string").alias("document_id"))
    before = pairs()
    once = sorted(map(tuple, sampling.distractors(base, pool, 2, 7).collect()))
    assert len(once) == 40 and 40 <= pairs() - before < 20 * 5000 / 10
    monkeypatch.setattr(sampling, "BELOW", 0.5)
    monkeypatch.setattr(sampling, "SENT_EXAMPLES", 0)
    assert sorted(map(tuple, sampling.distractors(base, pool, 2, 7).collect())) == once
    assert sampling.distractors(base, pool, 0, 7).count() == 0


def test_appended_distractors_read_gold_once(spark, data):
    plan = core.append_distractors(spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert "supporting_facts" not in plan and "record_id" not in plan


def test_dense_ties_and_blocks(spark):
    vectors = spark.createDataFrame([(k, [1.0, float(k % 3)]) for k in range(30)], "vec_id long, embedding array<float>")
    queries = vectors.where("vec_id < 7").withColumnRenamed("vec_id", "query_id")
    whole = sorted(map(tuple, dense.dense_top_k(vectors, queries, 4).collect()))
    assert whole == sorted(map(tuple, dense.dense_top_k(vectors, queries, 4, block=2).collect()))
    assert [r[2] for r in whole if r[0] == 2] == [2, 5, 8, 11]
    assert dense.dense_top_k(vectors, queries.where("false"), 4).count() == 0


def test_projection(spark):
    p = spark.range(1).select(dense.compute_projection(F.lit(8192), F.lit(64.0), F.lit(5233235), 1.25).alias("p")).first().p
    assert p.seconds == pytest.approx(51105.810546875)
    assert spark.range(1).select(dense.storage_bytes(F.lit(5233235).cast("long"), 512).alias("b")).first().b == 5358832640


def test_compare_fields(spark):
    a = spark.createDataFrame([(1, 0.5, 1.0), (2, None, 1.0), (3, 1.0, 1.0)], "k int, x double, y double")
    b = spark.createDataFrame([(1, 0.5, 1.1), (2, None, 1.0)], "k int, x double, y double")
    got = {(r.k, r.field) for r in audit.compare_fields(a, b, "k", ["x", "y"], 1e-6).collect()}
    assert got == {(1, "y"), (3, "x"), (3, "y")}


def test_budget_is_a_prefix(spark):
    rows = [("e", 0, 0, "a b"), ("e", 0, 1, "c d e f"), ("e", 1, 0, "g")]
    sentences = spark.createDataFrame(rows, "example_id string, paragraph_index int, sentence_index int, sentence string")
    kept = prompts.budgeted_sentences(sentences, 5, F.size(F.split("sentence", " ")))
    assert [r.sentence for r in kept.collect()] == ["a b"]
    assert prompts.truncation(sentences, kept).first().truncated


def test_archive_of_compressed_members(spark, tmp_path):
    import bz2
    import io
    import tarfile

    path = str(tmp_path / "pages.tar.bz2")
    with tarfile.open(path, "w:bz2") as t:
        for name, payload in (
            ("a/1.bz2", bz2.compress(b'{"id": 7, "title": "A  b", "text": [["x", "y"], [" "]]}\n\n{"title": "C", "text": ""}\n')),
            ("a/2", b'not json\n{"id": "9", "title": "A b", "text": "t"}\n'),
        ):
            info = tarfile.TarInfo(name)
            info.size = len(payload)
            t.addfile(info, io.BytesIO(payload))
    documents = corpus.documents_of(corpus.corpus_lines(spark, [path]))
    kept, quarantined = corpus.kept_and_quarantined(documents)
    assert sorted((r.wiki_id, r.document_id, r.text) for r in kept.collect()) == [("7", "A b", "xy"), ("9", "A b", "t")]
    assert sorted(r.problem for r in quarantined.collect()) == ["empty_text", "not_json"]
    assert corpus.repeated_ids(kept).first().n == 2


def test_manifest_and_atomic_json(spark, tmp_path):
    out = tmp_path / "m.json"
    sinks.write_json_atomic(str(out), sinks.manifest(spark.range(3), "id", 5))
    assert '"rows": 3' in out.read_text()
    sinks.write_jsonl(spark.range(3), str(tmp_path / "rows"))
    inventory = audit.file_inventory(spark, str(tmp_path / "rows"))
    assert inventory.where("path LIKE 'part-%'").count() >= 1


def test_stream_counts_each_file_once(spark, tmp_path):
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    docs(spark, ["a a b"]).write.parquet(source)
    schema = docs(spark, []).schema
    incremental.stream_term_counts(spark, source, schema, out, state)
    docs(spark, ["b c"]).write.mode("append").parquet(source)
    incremental.stream_term_counts(spark, source, schema, out, state)
    incremental.stream_term_counts(spark, source, schema, out, state)
    assert {r.term: (r.df, r.cf) for r in incremental.current_term_counts(spark, out).collect()} == {"a": (1, 2), "b": (2, 2), "c": (1, 1)}


def encoded(df):
    return df.select("rowid", F.array(F.col("rowid").cast("double")).alias("vector"), F.lit(3).alias("tokens"), (F.col("rowid") > 9).alias("truncated"), F.lit(0.001).alias("norm_error"))


IDENTITY = dict.fromkeys(incremental.INVARIANT, "x")


def test_store_resumes_and_finalises(spark, tmp_path):
    folder, numbered = str(tmp_path / "s"), spark.range(1, 11).withColumnRenamed("id", "rowid")
    store = incremental.ShardStore(spark, folder, 10, IDENTITY)
    assert store.open() == 0 and store.build(numbered, 4, encoded, most_shards=1) == 4
    with pytest.raises(ValueError):
        incremental.ShardStore(spark, folder, 10, {**IDENTITY, "model_id": "y"}).open()
    with pytest.raises(ValueError):
        store.finalise(10)
    again = incremental.ShardStore(spark, folder, 10, IDENTITY)
    assert not again.recover() and again.open() == 4 and again.build(numbered, 4, encoded) == 6
    assert [tuple(r)[:4] for r in again.ledger().orderBy("shard_index").collect()] == [(0, 1, 4, 4), (1, 5, 8, 4), (2, 9, 10, 2)]
    with pytest.raises(ValueError):
        again.finalise(9)
    totals = again.finalise(10)["index"]
    assert totals == {"shard_count": 3, "document_count": 10, "tokens_processed": 30, "truncated_documents": 1, "max_norm_error": 0.001}
    with pytest.raises(FileExistsError):
        again.open()
    assert spark.read.parquet(folder + "/vectors").count() == 10


def test_store_clears_only_its_own_empty_beginning(spark, tmp_path):
    folder = str(tmp_path / "s")
    incremental.ShardStore(spark, folder, 10, IDENTITY).open()
    assert not incremental.ShardStore(spark, folder, 11, IDENTITY).recover()
    assert not incremental.ShardStore(spark, folder, 10, {**IDENTITY, "batch_size": "y"}).recover()
    assert incremental.ShardStore(spark, folder, 10, {**IDENTITY, "host": "other"}).recover()
    assert incremental.ShardStore(spark, folder, 10, IDENTITY).open() == 0


def test_impossible_shards(spark, tmp_path):
    rows = [(0, 4, 3, 0, 0.0), (1, 4, 4, 5, 0.0), (2, 0, 0, 0, 0.0), (3, 4, 9, 1, 0.5), (4, 4, 4, 4, 0.002), (5, 4, 4, None, 0.0)]
    df = spark.createDataFrame(rows, "shard_index int, document_count long, tokens_processed long, truncated_documents long, max_norm_error double")
    assert sorted(map(tuple, audit.bound_issues(df).collect())) == [(0, "tokens"), (1, "truncated"), (2, "no_documents"), (3, "norm_error"), (5, "truncated")]


def test_shard_issues_without_a_global_window(spark, capsys):
    rows = [(0, 1, 4, 4), (1, 5, 8, 4), (3, 13, 16, 4), (4, 17, 19, 4), (5, 20, 23, 4)]
    got = audit.contiguity_issues(spark.createDataFrame(rows, "shard_index long, start_rowid long, end_rowid long, document_count long"))
    assert sorted(map(tuple, got.collect())) == [(3, 13, 16, 4, 9), (4, 17, 19, 4, 17)]
    got.explain()
    assert "Window" not in capsys.readouterr().out


def test_positions_and_increase(spark):
    a = spark.createDataFrame([(1, "x"), (5, "y"), (7, "z")], "o int, k string")
    b = spark.createDataFrame([(2, "x"), (3, "q")], "o int, k string")
    got = audit.position_mismatches(audit.paired_by_position(a, b, "o", "k")).collect()
    assert sorted((r.place, r.left, r.right) for r in got) == [(2, "y", "q"), (3, "z", None)]
    rows = spark.createDataFrame([(1, 5), (2, 5), (3, 6), (4, None), (5, 1)], "o int, v int")
    assert sorted(r.o for r in audit.not_increasing(rows, "o", "v").collect()) == [2, 4, 5]


def test_incomplete_rankings_and_counts(spark):
    queries = spark.createDataFrame([("a",), ("b",), ("c",), ("a",)], "example_id string")
    ranking = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "example_id string, rank int")
    assert sorted(map(tuple, audit.incomplete_rankings(queries, ranking, 2).collect())) == [("b", 1), ("c", 0)]
    audit.require_counts({"read": 3}, {"read": 3})
    with pytest.raises(ValueError, match="read: 3 instead of 4"):
        audit.require_counts({"read": 3}, {"read": 4})


def test_manifest_against_files(spark, tmp_path):
    spark.range(3).coalesce(1).write.json(str(tmp_path / "d"))
    files = audit.file_inventory(spark, str(tmp_path / "d")).where("path LIKE 'part%'").select("path", "length", "sha256")
    path = files.first().path
    listed = spark.createDataFrame([(path, 1, "x"), ("gone", 1, "x")], "path string, length long, sha256 string")
    assert audit.manifest_issues(files, files).count() == 0
    assert sorted(map(tuple, audit.manifest_issues(listed, files).collect())) == [("gone", "missing"), (path, "length")]
    assert audit.manifest_issues(files.limit(0), files).first().issue == "unlisted"


EXAMPLE = "example_id string, question string, answer string, supporting_facts array<struct<title:string,sentence_id:int>>, context array<struct<title:string,sentences:array<string>>>"


def test_prompts_under_a_budget(spark):
    demos = spark.createDataFrame([("d1", "Q1?", "a1", [("T", 1)], [("T", ["x.", " y. "]), ("U", ["z."])]), ("d2", "Q2?", "a2", [("T", 0)], [("T", ["w."])])], EXAMPLE)
    targets = spark.createDataFrame([("t", "Who?", "secret", None, [("A", ["one two", "three"]), ("B", ["four", "five"])]), ("n", "Who?", None, None, [])], EXAMPLE)
    whole = {r.example_id: r for r in prompts.direct_prompts(targets, demos, 1000).collect()}
    want = (
        "<|im_start|><|object_ref_start|>Answer each question using only its evidence. Return only the shortest answer after \"Answer:\".\n\n"
        "Question: Q1?\n\nEvidence:\n[Document 1] T\n(0) x.\n(1) y.\nAnswer: a1\n\nQuestion: Q2?\n\nEvidence:\n[Document 1] T\n(0) w.\nAnswer: a2\n\n"
        "Question: Who?\n\nEvidence:\n[Document 1] A\n(0) one two\n(1) three\n\n[Document 2] B\n(0) four\n(1) five\nAnswer:<|im_end|>"
    )
    assert whole["t"].prompt == want and not whole["t"].truncated and whole["n"].status == "no_evidence" and whole["n"].prompt is None
    assert whole["t"].input_tokens == len(want.split())
    r = prompts.direct_prompts(targets.limit(1), demos, len(want.split()) - 1).first()
    assert r.prompt == want.replace("\n(1) five", "") and (r.n_sentences, r.dropped_sentences, r.n_documents, r.dropped_documents, r.truncated) == (3, 1, 2, 0, True)
    r = prompts.direct_prompts(targets.limit(1), demos, len(want.split()) - 3).first()
    assert (r.n_sentences, r.n_documents, r.dropped_documents) == (2, 1, 1)
    assert prompts.direct_prompts(targets.limit(1), demos, 5).first().status == "no_sentence_fits"
    with pytest.raises(ValueError):
        prompts.direct_prompts(targets, demos, 0)


def test_chat_prompts(spark):
    demos = spark.createDataFrame([("d1", "Q1?", "a1", [("T", 1)], [("T", ["x.", " y. "])]), ("d2", "Q2?", "a2", [("T", 0)], [("T", ["w."])])], EXAMPLE)
    targets = spark.createDataFrame([("t", "Who?", "secret", None, [("A", ["one two"])])], EXAMPLE)
    text = prompts.chat_prompts(targets, demos, 1000, rationale=True).first().prompt
    assert "Reasoning: y.\nAnswer: a1<|im_end|>" in text and "secret" not in text and text.count("<|im_start|>") == 7
    roles = prompts.chat_prompts(targets, demos, 1000, render_chat=lambda m: F.array_join(F.transform(m, lambda x: x.role), " ")).first().prompt
    assert roles == "system user assistant user assistant user"
    with pytest.raises(Exception, match="two demonstrations"):
        prompts.chat_prompts(targets, demos.limit(1), 1000).collect()
    with pytest.raises(Exception, match="no demonstration"):
        prompts.chat_prompts(targets, demos.withColumn("answer", F.lit(None).cast("string")), 1000).collect()


def test_records_written_and_read_again(spark, tmp_path):
    from askmill.sources import qa as records

    context = [("A", ['x "q"', None, "é"]), None, (None, None), ("B", [])]
    rows = [("e1", "Q?", "a", "bridge", None, [("A", 1), None, ("B", None)], context), ("e2", "R?", None, None, "hard", [], None)]
    df = spark.createDataFrame(rows, records.RECORD)
    sinks.delivered_records(df).write.text(str(tmp_path / "lines"))
    assert sorted(map(repr, records.load_records(spark, str(tmp_path / "lines")).collect())) == sorted(map(repr, df.collect()))
    df.write.parquet(str(tmp_path / "t.parquet"))
    assert records.load_records(spark, str(tmp_path / "t.parquet")).count() == 2
    whole = "[" + ",\n".join(r.payload for r in sinks.delivered_records(df).collect()) + "]"
    (tmp_path / "list.json").write_text(whole)
    assert sorted(map(repr, records.load_records(spark, str(tmp_path / "list.json")).collect())) == sorted(map(repr, df.collect()))
    (tmp_path / "p.json").write_text('{"answer": {"e": "x"}, "sp": {"e": [["A", 0], ["B", 2]]}}')
    answers, support = records.load_predictions(spark, str(tmp_path / "p.json"))
    assert tuple(answers.first()) == ("e", "x") and [tuple(f) for f in support.first().predicted] == [("A", 0), ("B", 2)]
    (tmp_path / "q.json").write_text('{"answer": {"e": "x"}}')
    with pytest.raises(ValueError):
        records.load_predictions(spark, str(tmp_path / "q.json"))


def test_lines_are_numbered_and_logs_read(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\n\nthree\n" + "x" * 50 + "\nprogress=1 examples=3/9 example_id=e7 status=complete t\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20")
    try:
        lines = corpus.corpus_lines(spark, [str(tmp_path / "a.txt")]).orderBy("line").collect()
        found = corpus.log_fields(corpus.corpus_lines(spark, [str(tmp_path / "a.txt")]), corpus.PROGRESS_LINE, ["example_id"]).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [(r.line, r.value[:3]) for r in lines] == [(1, "one"), (3, "thr"), (4, "xxx"), (5, "pro")]
    assert [(r.line, r.example_id) for r in found] == [(5, "e7")]


def test_prediction_and_placeholder_records(spark):
    df = spark.createDataFrame([("e", "Paris", "Paris"), ("f", None, None)], "example_id string, prediction string, gold_answer string")
    got = {r.example_id: r.answer_score for r in sinks.prediction_records(df).collect()}
    assert tuple(got["e"]) == (1, 1, 1, 1) and got["f"] is None
    assert {r.status for r in sinks.not_applicable(df, "no reader").collect()} == {"not_applicable"}


def test_calibration_batches(spark):
    numbered = spark.range(1, 11).withColumnRenamed("id", "rowid")
    rows = [(0, 1, 4, 4, 9, 0.1), (1, 5, 8, 4, 9, 0.2), (2, 9, 9, 1, 9, 0.0)]
    batches = spark.createDataFrame(rows, "batch_index long, first_rowid long, last_rowid long, document_count long, processed_tokens long, max_l2_norm_error_after_fp16_cast double")
    got = audit.batch_issues(batches, numbered, 4).collect()
    assert sorted((r.batch_index, r.field) for r in got) == [(2, "document_count"), (2, "last_rowid")]
    assert tuple(audit.calibration_summary(batches).first()) == (3, 9, 27, 0.2)
    assert tuple(audit.calibration_summary(batches.limit(0)).first()) == (0, 0, 0, 0.0)


@pytest.mark.parametrize(("values", "expected"), [((1, 2, 3, 4, None, None), True), ((1, 2, 3, 4, 5, 4), False), ((3, 2, 3, 4, None, None), False), ((None, 2, 3, 4, None, None), False), ((1, 2, 3, 4, None, 4), False)])
def test_resource_limits(spark, values, expected):
    df = spark.createDataFrame([values], "a int, b int, c int, d int, e int, f int")
    assert df.select(audit.within_limits(*(F.col(c) for c in "abcdef")).alias("y")).first().y is expected


def test_relative_tolerance(spark):
    a, b = (spark.createDataFrame([(1, x)], "k int, v double") for x in (1000.0, 1000.5))
    assert audit.compare_fields(a, b, "k", ["v"], 1e-3, relative=True).count() == 0
    assert audit.compare_fields(a, b, "k", ["v"], 1e-4, relative=True).count() == 1


def test_strict_pairs(spark):
    def frame(rows):
        return spark.createDataFrame(rows, "p string, g string, v double")

    good = [("a", "x", 1.0), ("a", "y", 2.0)]
    stats.require_paired(frame(good), "p", "g", "x", "y", "v")
    for bad in ([], good[:1], [*good, ("a", "x", 1.0)], [("a", "x", math.inf), good[1]], [("a", "x", None), good[1]]):
        with pytest.raises(ValueError):
            stats.require_paired(frame(bad), "p", "g", "x", "y", "v")


def test_exact_quantiles(spark):
    rows = [("a", float(v)) for v in (4, 1, 10, 2)] + [("b", 7.0), ("b", None), ("b", math.nan), (None, 3.0)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    got = {r.g: (r.n, r.q_0, r.q_1) for r in stats.quantiles(df, "g", "v", (0.5, 0.95)).collect()}
    assert got["a"] == (4, 3.0, pytest.approx(9.1)) and got["b"] == (1, 7.0, 7.0) and got[None] == (1, 3.0, 3.0)
