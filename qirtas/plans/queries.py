"""Registered queries of the core: each reads whole tables; searches ask for every question or vector whose number 20 divides."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numbers, symbols
from ..functions import text as T
from ..operators import answers, contexts, corpus, dense, fusion, metrics, paired, questions, retrieval, sampling, similarity
from ..operators.lineage import materialize, ship
from . import grammar, oracle

SALT = "qirtas-1"
PAIRS = (("en", "en-en"), ("ar", "ar-ar"))


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _chunks(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    return read(spark, folder, "chunks").select("chunk_id", *columns).dropDuplicates(["chunk_id"])


def _docs(spark: SparkSession, folder: str, lang: str, analyzer: str = "raw") -> DataFrame:
    texts = _chunks(spark, folder, lang).select(F.col("chunk_id").alias("doc"), F.col(lang).alias("text"))
    return retrieval.analyze(texts, analyzer, lang).select("doc", "text", "tokens")


def _questions(spark: SparkSession, folder: str) -> DataFrame:
    """The stated query set."""
    one = read(spark, folder, "questions").dropDuplicates(["qid"])
    return retrieval.every(one, F.regexp_extract("qid", r"(\d+)$", 1).try_cast("bigint"))


def _asked(spark: SparkSession, folder: str, lang: str, analyzer: str = "raw") -> DataFrame:
    texts = _questions(spark, folder).select("qid", F.col(f"question.{lang}").alias("text"))
    return retrieval.analyze(texts, analyzer, lang).select("qid", "text", "tokens")


def _run(spark, folder, lang, analyzer="raw", depth=20, **params) -> DataFrame:
    return retrieval.bm25(_docs(spark, folder, lang, analyzer), _asked(spark, folder, lang, analyzer), depth, **params)


def _qrels(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.judgements(_questions(spark, folder))


def _shown(run: DataFrame) -> DataFrame:
    return run.select("qid", "doc", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


# --- retrieval ---------------------------------------------------------------------------------------------------


def term_stats(spark, folder):
    stats = retrieval.term_stats(_docs(spark, folder, "en"))
    return stats.select("term", "df", "cf")


def bm25_top10(spark, folder):
    return _shown(_run(spark, folder, "en", depth=10))


def bm25_norm_ar(spark, folder):
    return _shown(_run(spark, folder, "ar", "norm", depth=10))


def bm25_light(spark, folder):
    return _shown(_run(spark, folder, "en", "light", depth=10)).withColumn("lang", F.lit("en")).unionByName(_shown(_run(spark, folder, "ar", "light", depth=10)).withColumn("lang", F.lit("ar")))


def _per_question(spark, folder) -> DataFrame:
    qrels = _qrels(spark, folder)
    parts = [metrics.question_metrics(_run(spark, folder, lang), qrels).withColumns({"config": F.lit("bm25-raw"), "pair": F.lit(pair)}) for lang, pair in PAIRS]
    return parts[0].unionByName(parts[1])


def bm25_eval(spark, folder):
    return metrics.mean_metrics(_per_question(spark, folder), ["config", "pair"])


def ladder_gap(spark, folder):
    means = bm25_eval(spark, folder).select("config", "pair", F.col("recall_5").alias("value"))
    return grammar.ladder(means)


def run_coverage(spark, folder):
    asked = _questions(spark, folder)
    run = _run(spark, folder, "en", depth=1)
    missing = metrics.missing_questions(asked, run).withColumn("missing", F.lit(True))
    return asked.select("qid").join(missing, "qid", "left").agg(F.count("*").alias("n_questions"), F.count_if(F.coalesce("missing", F.lit(False))).alias("n_missing"))


def paired_mcnemar(spark, folder):
    """Questions that only one language answers within five ranks, and the exact test of that."""
    long = paired.paired_report(_per_question(spark, folder), ["config"], "pair", "en-en", "ar-ar", ["recall_5"])
    out = paired.mcnemar(long.withColumns({"a": F.col("a") == 1, "b": F.col("b") == 1}), ["config"])
    return out.withColumn("p", F.round("p", 6))


def _intervals(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in ("mean", "low", "high")})


def paired_hash_ci(spark, folder):
    long = paired.paired_report(_per_question(spark, folder), ["config"], "pair", "en-en", "ar-ar", ["recall_5", "mrr_10"])
    return _intervals(paired.hash_bootstrap(long, ["config", "metric"]))


def paired_bootstrap_ci(spark, folder):
    long = paired.paired_report(_per_question(spark, folder), ["config"], "pair", "en-en", "ar-ar", ["recall_5", "mrr_10", "ndcg_10"])
    return _intervals(paired.bootstrap(long, ["config", "metric"]))


def length_norm_mcnemar(spark, folder):
    """Length normalisation on and off, over the same questions."""
    qrels = _qrels(spark, folder)
    sides = [metrics.question_metrics(_run(spark, folder, "en", b=b), qrels).select("qid", "recall_1").withColumn("side", F.lit(x)) for x, b in (("on", 0.75), ("off", 0.0))]
    long = paired.paired_report(sides[0].unionByName(sides[1]).withColumn("config", F.lit("bm25-raw")), ["config"], "side", "on", "off", ["recall_1"])
    return paired.mcnemar(long.withColumns({"a": F.col("a") == 1, "b": F.col("b") == 1}), ["config"]).withColumn("p", F.round("p", 6))


def rrf_hybrid(spark, folder):
    runs = [_run(spark, folder, "en", depth=fusion.DEPTH), _run(spark, folder, "en", depth=fusion.DEPTH, b=0.0)]
    return _shown(fusion.rrf(runs, 10))


def rrf_depth(spark, folder):
    runs = [_run(spark, folder, "en", depth=20), _run(spark, folder, "en", depth=20, b=0.0)]
    return _shown(fusion.rrf(runs, 20, depth=5))


def rerank_f1(spark, folder):
    """The first fifty by BM25, scored anew by the F1 of their words with the question's."""
    docs, asked = _docs(spark, folder, "en"), _asked(spark, folder, "en")
    run = retrieval.bm25(docs, asked, fusion.SHORTLIST)
    tokens = docs.select("doc", F.col("tokens").alias("text"))
    return _shown(fusion.rerank(run, asked.select("qid", F.col("tokens").alias("query")), tokens, fusion.f1_scorer, 10))


def grammar_hybrid(spark, folder):
    """A configuration by name: rerank over a hybrid of two analyzers."""
    docs = {x: _docs(spark, folder, x).select("doc", "text") for x in T.LANGS}
    asked = {x: _asked(spark, folder, x).select("qid", "text") for x in T.LANGS}
    return _shown(grammar.plan("rerank:hybrid:bm25-raw+bm25-norm", grammar.Corpus(docs, asked), "en", "en", 20))


# --- vectors -----------------------------------------------------------------------------------------------------


def _vectors(spark, folder) -> DataFrame:
    return read(spark, folder, "embeddings").dropDuplicates(["vec_id"]).select(F.col("vec_id").alias("doc"), F.col("embedding").alias("vector"), "label")


def _vector_queries(spark, folder) -> DataFrame:
    return retrieval.every(_vectors(spark, folder), F.col("doc")).withColumnRenamed("doc", "qid")


def dense_topk(spark, folder):
    return _shown(dense.exact_search(_vectors(spark, folder), _vector_queries(spark, folder), 10))


def dense_label_eval(spark, folder):
    """The vectors of a label are each other's one relevance group; a query does not find itself."""
    asked = _vector_queries(spark, folder)
    run = dense.exact_search(_vectors(spark, folder), asked, 21).filter("doc <> qid").select("qid", "doc", "score")
    run = retrieval.top_k(run, 20)
    run = materialize(run)
    # One group needs only its first hit: the run's rows are looked up, never the members of a label paired with its queries.
    label = _vectors(spark, folder).select("doc", "label")
    hits = run.select("qid", "doc").join(label, "doc").join(asked.select("qid", F.col("label").alias("wanted")), "qid").filter("label = wanted").select("qid", F.lit(0).alias("grp"), "doc")
    grouped = asked.join(label.groupBy("label").agg(F.count("*").alias("n")).filter("n > 1"), "label", "left_semi").select("qid", F.lit(0).alias("grp"), F.lit(None).cast("bigint").alias("doc"))
    return metrics.mean_metrics(metrics.question_metrics(run, hits.unionByName(grouped)).withColumn("config", F.lit("dense")), ["config"])


def dense_cross_pool(spark, folder):
    """Queries of one pool of vectors against the vectors of the other."""
    parts = []
    for name, q, d in (("even-odd", 0, 1), ("odd-even", 1, 0)):
        docs = _vectors(spark, folder).filter(F.pmod("label", F.lit(2)) == d)
        asked = _vector_queries(spark, folder).filter(F.pmod("label", F.lit(2)) == q)
        parts.append(_shown(dense.exact_search(docs, asked, 5)).withColumn("pair", F.lit(name)))
    return parts[0].unionByName(parts[1])


# --- near duplicates and corpus ----------------------------------------------------------------------------------


def neardup_groups(spark, folder):
    """The relevance group of each gold chunk: itself and the chunks whose English shingles are like its own."""
    docs = _docs(spark, folder, "en", "norm").select("doc", "tokens")
    docs = materialize(docs)
    gold = read(spark, folder, "questions").select(F.explode("gold_chunks").alias("doc")).filter("doc IS NOT NULL").distinct()
    gold = materialize(gold.join(docs.select("doc"), "doc", "left_semi"))
    groups = similarity.relevance_groups(gold, similarity.similar(docs, gold))
    return groups.select("gold", "member", F.col("place").cast("bigint").alias("place"))


def shingle_counts(spark, folder):
    docs = _docs(spark, folder, "en", "norm")
    return docs.select("doc", F.size(similarity.shingles(F.col("tokens"))).cast("bigint").alias("n_shingles"))


def _pairs(spark, folder) -> DataFrame:
    return read(spark, folder, "unpc_docs").dropDuplicates(["doc_id"])


def eligibility(spark, folder):
    kept = corpus.eligible(_pairs(spark, folder), {"min_one_to_one_links": 10, "max_one_to_one_links": 400, "min_one_to_one_ratio": 0.75})
    return kept.select("doc_id", "n_links", "n_one_to_one", F.round(corpus.ratio(), 6).alias("ratio"))


def seed_selection(spark, folder):
    return corpus.in_hash_order(_pairs(spark, folder).filter("doc_role = 'seed'"), SALT, 100)


def cited_symbols(spark, folder):
    texts = read(spark, folder, "chunks").select("doc_id", F.col("en").alias("text")).distinct()
    return corpus.cited_keys(texts)


def cited_closure(spark, folder):
    """Documents that hash-ordered seeds name: by a symbol in their text, or as what they reissue."""
    docs = read(spark, folder, "chunks").select("doc_id").distinct()
    seeds = materialize(corpus.in_hash_order(docs, SALT, 100))
    texts = corpus.keep_wanted(read(spark, folder, "chunks").select("doc_id", F.col("en").alias("text")), seeds, "doc_id")
    reissued = seeds.filter(F.col("doc_id").rlike("/rev_[0-9]+$")).select("doc_id", symbols.doc_key(F.regexp_replace("doc_id", "/rev_[0-9]+$", "")).alias("key"))
    cited = corpus.cited_keys(texts).select("doc_id", "key").unionByName(reissued)
    return corpus.cited_closure(seeds, cited, docs.select("doc_id", symbols.doc_key(F.col("doc_id")).alias("key")), SALT, 50)


def manifest_gate(spark, folder):
    """Differences between two selections under different salts, by side."""
    docs = _pairs(spark, folder)
    a = corpus.manifest(corpus.in_hash_order(docs, SALT, 50), corpus.in_hash_order(docs, "other", 10))
    b = corpus.manifest(corpus.in_hash_order(docs, SALT, 60), corpus.in_hash_order(docs, "other", 10))
    return corpus.manifest_difference(a, b)


def symbol_match(spark, folder):
    return corpus.symbol_match(_pairs(spark, folder))


def paragraph_ends(spark, folder):
    own = corpus.paragraph_ends(corpus.newest_sentences(read(spark, folder, "sentences")))
    return own.filter("last").select("doc_id", "lang", "sid")


def alignment_errors(spark, folder):
    beads = read(spark, folder, "beads").dropDuplicates(["doc_id", "bead_no"])
    return corpus.alignment_errors(beads, corpus.newest_sentences(read(spark, folder, "sentences")))


def _bead_texts(spark, folder) -> DataFrame:
    return corpus.bead_texts(read(spark, folder, "beads"), read(spark, folder, "sentences"))


def _packed(texts: DataFrame) -> DataFrame:
    sized = {f"{x}_tokens": F.size(F.regexp_extract_all(F.array_join(F.transform(x, lambda s: F.coalesce(s["text"], F.lit(""))), " "), F.lit(T.WORD), F.lit(0))) for x in T.LANGS}
    return corpus.pack(texts.withColumns(sized))


def pack_beads(spark, folder):
    return _packed(_bead_texts(spark, folder))


def made_chunks(spark, folder):
    texts = materialize(_bead_texts(spark, folder))
    made = corpus.make_chunks(texts, _packed(texts))
    return made.select("chunk_id", "doc_id", "n_beads", F.round("one_to_one_ratio", 6).alias("one_to_one_ratio"), F.length("en").cast("bigint").alias("en_chars"), F.length("ar").cast("bigint").alias("ar_chars"))


def document_paragraphs(spark, folder):
    own = corpus.paragraphs(corpus.newest_sentences(read(spark, folder, "sentences")))
    return own.groupBy("doc_id", "lang").agg(F.count("*").alias("n_paragraphs"), F.max(F.length("text")).cast("bigint").alias("longest"))


def number_audit(spark, folder):
    chunks = _chunks(spark, folder, "en", "ar").withColumn("ar_normal", T.normalized(F.col("ar"), "ar"))
    return corpus.audit_numbers(chunks)


def number_repair(spark, folder):
    fixed = corpus.repair_numbers(_chunks(spark, folder, "en", "ar"))
    return fixed.filter("numbers_corrected > 0").select("chunk_id", "ar", F.col("numbers_corrected").cast("bigint").alias("numbers_corrected"))


def truncation_breakdown(spark, folder):
    return corpus.truncation(_chunks(spark, folder, "en_tokens", "ar_tokens"), 300)


def length_percentiles(spark, folder):
    return corpus.length_percentiles(_chunks(spark, folder, "source", "ar_tokens"), ["source"], "ar_tokens")


def token_ratio(spark, folder):
    return corpus.token_ratio(_chunks(spark, folder, "source", "en_tokens", "ar_tokens"), ["source"])


def tokens_per_char(spark, folder):
    rows = _chunks(spark, folder, "source", "en", "en_tokens").filter("en IS NOT NULL AND en_tokens IS NOT NULL").withColumn("chars", F.length("en"))
    return answers.tokens_per_character(rows, ["source"], "chars", "en_tokens")


# --- sampling ----------------------------------------------------------------------------------------------------

CONTENT_RULES = {**sampling.RULES, "min_chars": 300}


def _sampled(spark, folder) -> DataFrame:
    return read(spark, folder, "chunks").select("chunk_id", "doc_id", "en", "ar", "one_to_one_ratio", "truncated_e5", "numbers_corrected", "keywords").dropDuplicates(["chunk_id"])


def content_chunks(spark, folder):
    return _sampled(spark, folder).filter(sampling.is_content(CONTENT_RULES)).select("chunk_id")


def single_candidates(spark, folder):
    return sampling.single_candidates(_sampled(spark, folder), SALT, CONTENT_RULES)


def numeric_candidates(spark, folder):
    return sampling.single_candidates(_sampled(spark, folder), SALT, CONTENT_RULES, numeric=True)


def comparison_pairs(spark, folder):
    return sampling.comparison_pairs(sampling.comparison_options(_sampled(spark, folder), 20, CONTENT_RULES), SALT)


def bridge_candidates(spark, folder):
    return sampling.bridge_candidates(_sampled(spark, folder), SALT, rules=CONTENT_RULES)


def numeric_questions(spark, folder):
    own = read(spark, folder, "questions").dropDuplicates(["qid"])
    return own.filter(F.coalesce(numbers.has_grouped(F.col("question.en")), F.lit(False)) | F.coalesce(numbers.has_grouped(F.col("answer.en")), F.lit(False))).select("qid", "kind")


# --- answers -----------------------------------------------------------------------------------------------------


def _generation(spark, folder) -> DataFrame:
    return read(spark, folder, "generation").dropDuplicates(["gen_id"]).withColumn("condition", F.substring_index("condition_spec", ":", 1))


def attribution_table(spark, folder):
    return answers.attribution(answers.judged(_generation(spark, folder)), ["model", "condition", "lang"])


def decomposition(spark, folder):
    return answers.decomposition(answers.judged(_generation(spark, folder)), ["model", "lang"])


def model_agreement(spark, folder):
    return answers.model_pairs(answers.judged(_generation(spark, folder)), ["condition", "lang"])


def language_mcnemar(spark, folder):
    pairs = answers.language_pairs(answers.judged(_generation(spark, folder)), ["model", "condition"])
    return paired.mcnemar(pairs, ["model", "condition"]).withColumn("p", F.round("p", 6))


def predicted_accuracy(spark, folder):
    rows = answers.attribution(answers.judged(_generation(spark, folder)), ["model", "lang", "condition"]).select("model", "lang", "condition", "accuracy", "retrieval_rate")
    wide = rows.groupBy("model", "lang").agg(
        F.max(F.when(F.col("condition") == "rag", F.col("retrieval_rate"))).alias("recall"), F.max(F.when(F.col("condition") == "oracle", F.col("accuracy"))).alias("oracle"),
        F.max(F.when(F.col("condition") == "closed_book", F.col("accuracy"))).alias("closed"), F.max(F.when(F.col("condition") == "rag", F.col("accuracy"))).alias("measured"),
    )
    return wide.select("model", "lang", F.round(answers.predicted_accuracy(F.col("recall"), F.col("oracle"), F.col("closed")), 6).alias("predicted"), "measured")


def _scored(spark, folder) -> DataFrame:
    given = read(spark, folder, "questions").dropDuplicates(["qid"]).select("qid", "answer.en", "answer.ar")
    rows = _generation(spark, folder).join(given, "qid").withColumn("reference", F.when(F.col("lang") == "ar", F.col("ar")).otherwise(F.col("en")))
    return rows.select("gen_id", "qid", "model", "lang", "condition", "answer", "reference", "abstained", "correct")


def answer_scores(spark, folder):
    own = answers.score(_scored(spark, folder))
    return own.groupBy("model", "condition", "lang").agg(F.count("*").alias("n"), F.count_if("exact_match").alias("n_exact"), F.round(F.avg("token_f1"), 6).alias("mean_f1"))


def difference_kinds(spark, folder):
    own = _scored(spark, folder).filter("correct")
    return answers.difference_kind(own).groupBy("lang", "kind").agg(F.count("*").alias("n"))


def match_against_judge(spark, folder):
    return answers.match_against_judge(answers.score(_scored(spark, folder)), ["model", "lang"])


def verdict_transitions(spark, folder):
    own = answers.score(_scored(spark, folder))
    state = lambda c: F.when(F.coalesce(F.col(c), F.lit(False)), "correct").otherwise("wrong")
    return questions.transitions(own.select("gen_id", state("correct").alias("status")), own.select("gen_id", state("exact_match").alias("status")), ["gen_id"])


def abstentions(spark, folder):
    own = _generation(spark, folder).withColumn("told", T.abstains(F.col("answer"), F.col("condition")))
    return own.groupBy("condition", "lang").agg(F.count_if("told").alias("n_told"), F.count_if(F.coalesce("abstained", F.lit(False))).alias("n_stored"))


def gold_positions(spark, folder):
    rows = _generation(spark, folder).select(F.col("gen_id"), F.col("qid").alias("q"), "context_ids").withColumnRenamed("gen_id", "qid")
    qrels = metrics.judgements(read(spark, folder, "questions").dropDuplicates(["qid"])).withColumnRenamed("qid", "q")
    own = rows.filter("context_ids IS NOT NULL").join(qrels, "q")
    found = contexts.gold_positions(rows.select("qid", "context_ids"), own.select("qid", "grp", "doc"))
    return found.select(F.col("qid").alias("gen_id"), F.col("grp").cast("bigint").alias("grp"), F.col("position").cast("bigint").alias("position"))


def retrieved_answers(spark, folder):
    return contexts.retrieved_all(gold_positions(spark, folder).withColumnRenamed("gen_id", "qid")).withColumnRenamed("qid", "gen_id")


def oracle_context(spark, folder):
    own = read(spark, folder, "questions").dropDuplicates(["qid"]).select("qid", "gold_chunks", "relevant_groups")
    pool = read(spark, folder, "chunks").select(F.col("chunk_id").alias("doc")).distinct()
    return contexts.oracle_context(own, pool, 5, SALT).select("qid", F.array_join("context_ids", " ").alias("context"))


def rag_context(spark, folder):
    return contexts.rag_context(_run(spark, folder, "en", depth=5)).select("qid", F.array_join("context_ids", " ").alias("context"))


def cost_estimate(spark, folder):
    asked = read(spark, folder, "questions").dropDuplicates(["qid"]).select("qid", F.col("question.en").alias("q_en"), F.col("question.ar").alias("q_ar"))
    calls = _generation(spark, folder).join(asked, "qid").select("condition", F.col("cache_key").alias("key"), F.when(F.col("lang") == "ar", F.col("q_ar")).otherwise(F.col("q_en")).alias("prompt"), "answer")
    cache = calls.filter("answer IS NOT NULL").select("key")
    return answers.cost_estimate(calls.select("condition", "key", "prompt"), cache, ["condition"])


def question_funnel(spark, folder):
    checked = questions.question_checks(read(spark, folder, "questions"), read(spark, folder, "chunks").select("chunk_id", "en"))
    return questions.funnel(checked, ["kind", "direction"])


QUERIES = {
    f.__name__: f
    for f in (
        term_stats, bm25_top10, bm25_norm_ar, bm25_light, bm25_eval, ladder_gap, run_coverage, paired_mcnemar, paired_hash_ci, paired_bootstrap_ci, length_norm_mcnemar, rrf_hybrid, rrf_depth, rerank_f1, grammar_hybrid,
        dense_topk, dense_label_eval, dense_cross_pool, neardup_groups, shingle_counts, eligibility, seed_selection, cited_symbols, cited_closure, manifest_gate, symbol_match, paragraph_ends, alignment_errors,
        pack_beads, made_chunks, document_paragraphs, number_audit, number_repair, truncation_breakdown, length_percentiles, token_ratio, tokens_per_char, content_chunks, single_candidates, numeric_candidates,
        comparison_pairs, bridge_candidates, numeric_questions, attribution_table, decomposition, model_agreement, language_mcnemar, predicted_accuracy, answer_scores, difference_kinds, match_against_judge,
        verdict_transitions, abstentions, gold_positions, retrieved_answers, oracle_context, rag_context, cost_estimate, question_funnel,
    )
}
SQL = oracle.SQL
