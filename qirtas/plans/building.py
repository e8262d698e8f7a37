"""Registered queries of building a corpus and its questions, of the stores between stages, and their DuckDB SQL.

The tables hold no financing resolutions: their paragraphs are rendered from the numbers of `unpc_docs`, in both engines.
"""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import checks, financing, stemming, symbols
from ..functions import text as T
from ..operators import answers, appropriations, contexts, corpus, dense, questions, sampling
from ..operators.lineage import materialize, shared_folder, small_or_not
from ..sources import corpora, files, stores
from ..streaming import ledger
from . import grammar, oracle
from . import sqltext as S
from .queries import SALT, _chunks, _generation, _sampled, read

# --- files and stores --------------------------------------------------------------------------------------------


def _place(spark) -> str:
    """A folder of its own in the shared folder."""
    return f"{shared_folder(spark)}/qirtas-{uuid.uuid4().hex}"


def jsonl_keyed(spark, folder):
    """Chunks written as JSON lines and read back: of one column's worth, those of the questions' gold."""
    path = _place(spark)
    files.write_jsonl(_chunks(spark, folder, "doc_id", "en", "n_beads"), path)
    wanted = read(spark, folder, "questions").select(F.explode("gold_chunks").alias("chunk_id")).filter("chunk_id IS NOT NULL")
    return files.read_keyed(spark, path, "chunk_id string, doc_id string, en string, n_beads int", "chunk_id", wanted).select("chunk_id", "doc_id", "en", "n_beads")


def jsonl_fields(spark, folder):
    path = _place(spark)
    files.write_jsonl(_chunks(spark, folder, "doc_id", "en", "n_beads"), path)
    return files.read_jsonl(spark, path, "chunk_id string, n_beads int", ["chunk_id", "n_beads"])


def tsv_pairs(spark, folder):
    path = _place(spark)
    own = read(spark, folder, "unpc_docs").select("doc_id", "doc_score", "n_links", "n_one_to_one").distinct()
    files.write_tsv(own, path)
    return files.read_pairs(spark, path)


def stored_runs(spark, folder):
    """Answers' contexts stored as rankings by corpus, configuration and language, and found again by folder."""
    root = _place(spark)
    own = _generation(spark, folder).filter("context_ids IS NOT NULL AND size(context_ids) > 0")
    run = own.select("lang", F.col("gen_id").cast("string").alias("qid"), F.posexplode("context_ids").alias("i", "doc")).filter("doc IS NOT NULL").select("lang", "qid", "doc", (1 / (F.col("i") + 60)).alias("score"), (F.col("i") + 1).alias("rank"))
    for lang in T.LANGS:
        stores.write_run(run.filter(F.col("lang") == lang), root, "unpc", "hybrid:bm25-raw+bm25-norm", f"{lang}-{lang}")
    found = stores.read_runs(spark, root)
    return found.groupBy("corpus", "config", "pair").agg(F.count("*").alias("n"), F.countDistinct("qid").alias("n_questions"), F.round(F.sum("score"), 3).alias("total"))


def cached_answers(spark, folder):
    """Requests by their content address, and the response kept under it."""
    own = read(spark, folder, "generation").select("qid", "model", "condition_spec", "answer").distinct()
    key = stores.request_key(F.lit("chat"), F.col("model"), F.col("qid"), F.col("condition_spec"))
    keyed = materialize(own.withColumn("key", key))
    cache = keyed.filter("answer IS NOT NULL").select("key", F.col("answer").alias("response"))
    return stores.look_up(keyed.select("qid", "model", "condition_spec", "key").distinct(), cache).select("qid", "model", "condition_spec", "response")


def appended_ledger(spark, folder):
    """Two appends to a ledger, and its sums by model."""
    path = _place(spark)
    own = _generation(spark, folder).select("model", "lang", F.length(F.coalesce("answer", F.lit(""))).cast("bigint").alias("chars"))
    for lang in T.LANGS:
        stores.append(own.filter(F.col("lang") == lang), path)
    return spark.read.schema("model string, lang string, chars bigint").parquet(path).groupBy("model").agg(F.count("*").alias("n"), F.sum("chars").alias("chars"))


def audit_export(spark, folder):
    """Numeric and bridge questions and every twentieth as one audit file; its lines as they stand there."""
    path = _place(spark)
    own = read(spark, folder, "questions").select("qid", "kind", "source").distinct()
    picks = [own.filter("kind = 'numeric'").withColumn("note", F.lit("numeric")), own.filter("kind IN ('bridge', 'numeric')").withColumn("note", F.lit("bridge")), own.withColumn("note", F.lit("all"))]
    files.write_audit(picks, "qid", path)
    return spark.read.text(path).select(F.regexp_replace("value", "^﻿", "").alias("line"))


def text_fingerprint(spark, folder):
    own = read(spark, folder, "documents").select("doc_id", "text")
    return dense.fingerprint(own, "doc_id", "text", "encoder-1", "passage: ")


BLOCK = 500


def xml_links(spark, folder):
    """Beads written as an alignment file, in groups of `BLOCK`, and read back for the documents with sentences in both languages."""
    beads = read(spark, folder, "beads").select("doc_id", "bead_no", "en", "ar").distinct()
    side = lambda x: F.array_join(F.col(x), " ")
    link = F.concat(F.lit('<link xtargets="'), side("ar"), F.lit(";"), side("en"), F.lit('"/>'))
    grouped = beads.groupBy("doc_id", F.floor(F.col("bead_no") / BLOCK).alias("b")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("bead_no", link.alias("x")))), lambda r: r["x"]), "").alias("links"))
    line = F.concat(F.lit('<linkGrp fromDoc="ar/'), "doc_id", F.lit('.xml.gz" toDoc="en/'), "doc_id", F.lit('.xml.gz" score="'), F.col("b").cast("string"), F.lit('">'), "links", F.lit("</linkGrp>"))
    path = _place(spark)

    def rooted(batches):
        # a file is what a partition writes: it needs one root
        yield pa.RecordBatch.from_arrays([pa.array(["<cesAlign>"])], ["value"])
        yield from batches
        yield pa.RecordBatch.from_arrays([pa.array(["</cesAlign>"])], ["value"])

    grouped.select(line.alias("value")).mapInArrow(rooted, "value string").write.text(path)
    found = corpora.read_links(spark, path, both_languages(spark, folder))
    return found.select(F.col("en_doc").alias("doc_id"), F.col("score").cast("bigint").alias("block"), F.col("place").cast("bigint").alias("place"), F.array_join("ar", " ").alias("ar"), F.array_join("en", " ").alias("en"))


def xml_documents(spark, folder):
    """Sentences written as XML documents of `BLOCK` sentences each, and parsed again."""
    own = corpus.newest_sentences(read(spark, folder, "sentences")).filter("lang = 'en' AND text IS NOT NULL")
    safe = F.regexp_replace(F.regexp_replace(F.regexp_replace("text", "&", "&amp;"), "<", "&lt;"), "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]", "")
    line = F.concat(F.lit('<p id="'), "pid", F.lit('"><s id="'), "sid", F.lit('">'), safe, F.lit("</s></p>"))
    grouped = own.groupBy("doc_id", F.floor(F.col("pos") / BLOCK).alias("b")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "sid", line.alias("x")))), lambda r: r["x"]), "").alias("body"))
    whole = F.concat(F.lit("<TEI><teiHeader><idno type=\"symbol\">"), "doc_id", F.lit("</idno><keywords><term>one</term><term> </term></keywords><p><s id=\"0\">not in the body</s></p></teiHeader><text><body>"), "body", F.lit("</body></text></TEI>"))
    parsed = corpora.parse_documents(grouped.select(F.concat_ws("#", "doc_id", F.col("b").cast("string")).alias("path"), F.encode(whole, "utf-8").alias("content")))
    return parsed.select("path", "symbol", F.size("keywords").cast("bigint").alias("n_keywords"), F.size("sentences").cast("bigint").alias("n"), F.get("sentences", F.lit(0))["sid"].alias("first"), F.col("error").isNotNull().alias("broken"))


def encoded_texts(spark, folder):
    """Vectors of the questions under their fingerprint, by an encoder that counts letters; stored, and read back."""
    own = read(spark, folder, "questions").dropDuplicates(["qid"]).select(F.col("qid").alias("id"), F.col("question.en").alias("text"))
    encode = lambda df: dense.encode(df, lambda batch: [[float(len(t)), 100.0] for t in batch], prefix="query: ")
    found = stores.vectors_of(own, _place(spark), "letters", encode)
    return found.select("id", *(F.round(F.get("vector", F.lit(i)).cast("double"), 4).alias(x) for i, x in enumerate(("x", "y"))))


def ledger_windows(spark, folder):
    """Answers as a usage ledger, added up by day by a stream that runs twice; the second run's late entry closes all days."""
    source, target, checkpoint = _place(spark), _place(spark), _place(spark)
    day = 86_400
    own = _generation(spark, folder).filter("answered_at IS NOT NULL")
    entry = own.select(F.to_timestamp(F.concat(F.col("answered_at").cast("string"), F.lit("Z"))).alias("ts"), "model", F.col("gen_id").cast("string").alias("key"), F.length(F.coalesce("answer", F.lit(""))).cast("bigint").alias("prompt_tokens"), F.lit(1).cast("bigint").alias("completion_tokens"))
    stores.append(entry, source)
    usage = lambda: ledger.run_available(ledger.usage_by_window(ledger.read_ledger(spark, source)), target, checkpoint)
    usage()
    last = spark.range(1).select(F.to_timestamp(F.lit("2999-01-01 00:00:00Z")).alias("ts"), F.lit("end").alias("model"), F.lit("end").alias("key"), F.lit(0).cast("bigint").alias("prompt_tokens"), F.lit(0).cast("bigint").alias("completion_tokens"))
    stores.append(last, source)
    usage()
    rows = spark.read.schema("start timestamp, model string, calls bigint, prompt_tokens bigint, completion_tokens bigint").parquet(f"{target}/batch=*")
    return rows.filter("model <> 'end'").select(F.floor(F.unix_seconds("start") / day).alias("day"), "model", "calls", "prompt_tokens", "completion_tokens")


# --- documents and chunks ----------------------------------------------------------------------------------------


def _links(spark, folder) -> DataFrame:
    """Beads as links; a reissued document's English side is filed under what it reissues."""
    beads = read(spark, folder, "beads").select("doc_id", "bead_no", "en", "ar").distinct()
    return beads.select(F.col("doc_id").alias("ar_doc"), F.when(F.col("bead_no") % 50 == 0, F.concat("doc_id", F.lit("/other"))).otherwise(F.col("doc_id")).alias("en_doc"), F.lit(0.5).alias("score"), "ar", "en")


def pair_index(spark, folder):
    return corpus.pair_index(_links(spark, folder)).select("doc_id", "doc_score", "n_links", "n_one_to_one")


def path_mismatches(spark, folder):
    return corpus.mismatched(_links(spark, folder))


def headed_chunks(spark, folder):
    """Chunks with text in both languages, as a prompt shows them: hashed with their headers."""
    own = corpus.both_sides(_chunks(spark, folder, "en", "ar", "header"))
    return own.select("chunk_id", F.sha2(corpus.with_header(own, "en"), 256).alias("en"), F.sha2(corpus.with_header(own, "ar"), 256).alias("ar"))


def both_languages(spark, folder):
    """Documents with sentences in both languages."""
    own = read(spark, folder, "sentences").filter("text IS NOT NULL AND text <> ''").select("doc_id", "lang").distinct()
    return corpus.keep_wanted(own.filter("lang = 'en'").select("doc_id"), own.filter("lang = 'ar'").select("doc_id"), "doc_id")


def alignment_errors_reversed(spark, folder):
    """Links numbered backwards in every document: what goes backwards, and with a sentence that is not there, what is missing."""
    beads = read(spark, folder, "beads").select("doc_id", "bead_no", "en", "ar").distinct()
    planted = beads.select("doc_id", (-F.col("bead_no")).alias("bead_no"), *(F.when(F.col("bead_no") % 7 == 0, F.concat(x, F.array(F.lit("0:0")))).otherwise(F.col(x)).alias(x) for x in T.LANGS))
    return corpus.alignment_errors(planted, corpus.newest_sentences(read(spark, folder, "sentences")))


def subject_terms(spark, folder):
    own = _sampled(spark, folder).select("doc_id", F.explode("keywords").alias("keyword")).distinct()
    return own.select("doc_id", sampling.subject_term(F.col("keyword")).alias("term")).distinct()


def _citing(spark, folder) -> DataFrame:
    """Chunks of which about every twelfth names another document: the first, by path, of those whose ids are as long."""
    own = _sampled(spark, folder)
    path = F.replace(F.upper(symbols.doc_key(F.col("doc_id"))), F.lit("_"), F.lit("."))
    named = own.groupBy(F.length("doc_id").alias("n")).agg(F.min(path).alias("path"))  # a row for each length
    at = F.conv(F.substring(F.sha2("chunk_id", 256), 1, 4), 16, 10).cast("int") % 12 == 0
    joined = own.join(small_or_not(named), F.length("doc_id") == F.col("n"))
    return joined.withColumn("en", F.when(at, F.concat("en", F.lit(" As stated in "), "path", F.lit(" before."))).otherwise(F.col("en"))).select(*own.columns)


def bridges(spark, folder):
    """Bridges of chunks in which citations of other documents are planted."""
    from .queries import CONTENT_RULES

    return sampling.bridge_candidates(_citing(spark, folder), SALT, rules=CONTENT_RULES)


# --- prompts, verdicts and questions -----------------------------------------------------------------------------

def arabic_stems(spark, folder):
    """The words of the Arabic chunks with their light stems, and how many texts hold them."""
    own = _chunks(spark, folder, "ar").select("chunk_id", T.normalized(F.coalesce("ar", F.lit("")), "ar").alias("normal"))
    words = own.select("chunk_id", F.explode(F.array_distinct(T.words(F.col("normal")))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return words.select("word", stemming.stem_arabic(F.col("word")).alias("stem"), "n")


TEMPLATE = "Passages:\n$passages\n\nQuestion ($kind): ${question}\nCost: $$1"


def rendered_prompts(spark, folder):
    """The prompt of each question with its gold passages, hashed."""
    own = read(spark, folder, "questions").dropDuplicates(["qid"]).select("qid", "kind", F.col("question.en").alias("question"), "gold_chunks")
    gold = own.select("qid", F.posexplode("gold_chunks").alias("i", "chunk_id")).join(_chunks(spark, folder, "en"), "chunk_id").filter("en IS NOT NULL")
    texts = gold.groupBy("qid").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "en"))), lambda x: x["en"]).alias("texts"))
    values = {"passages": contexts.format_passages(F.col("texts")), "kind": F.col("kind"), "question": F.coalesce("question", F.lit(""))}
    return own.join(texts, "qid").select("qid", F.sha2(contexts.render(TEMPLATE, **values), 256).alias("prompt"))


def parsed_verdicts(spark, folder):
    """Verdicts in fences and prose, as models give them, read back."""
    own = _generation(spark, folder).select("gen_id", "correct", "supported", "qid")
    said = F.concat(F.lit('Here it is:\n```json\n{"correct": "'), F.coalesce(F.col("correct").cast("string"), F.lit("unsure")), F.lit('", "supported": '), F.coalesce(F.col("supported").cast("string"), F.lit("null")), F.lit("}\n``` done"))
    text = F.when(F.col("gen_id") % 11 == 0, F.lit("no object here")).otherwise(said)
    read_back = own.withColumn("o", checks.parse_object(text, "correct string, supported string"))
    return read_back.select("gen_id", checks.truthy(F.col("o.correct")).alias("correct"), checks.truthy(F.col("o.supported")).alias("supported"), F.col("o").isNotNull().alias("parsed"))


def stub_answers(spark, folder):
    """Answers to the questions with their Arabic context by a stand-in that declines every prompt of an even length."""
    own = _generation(spark, folder).select(F.col("gen_id").cast("string").alias("qid"), "condition", "context_ids", F.col("qid").alias("q"))
    texts = contexts.passages_of(own.select("qid", "context_ids"), _chunks(spark, folder, "ar"), "ar")
    prompts = own.select("qid", "condition", "q").join(texts, "qid").withColumn("prompt", F.concat_ws("\n", "q", F.array_join("passages", "\n")))
    allowed = prompts.filter("condition <> 'closed_book' OR size(passages) = 0")
    return answers.answer_with(allowed, lambda asked: [" UNKNOWN NOT_IN_CONTEXT" if len(a) % 2 == 0 else a[:12] for a in asked]).select("qid", "answer", "abstained")


def stub_verdicts(spark, folder):
    """Verdicts by a stand-in judge that finds right what is of an even length."""
    own = _generation(spark, folder).select("gen_id", "abstained", "context_ids", F.coalesce("answer", F.lit("")).alias("correctness_prompt"), F.coalesce("qid", F.lit("")).alias("support_prompt"))
    judged = answers.judge_with(own, lambda asked: [f'{{"correct": {str(len(a) % 2 == 0).lower()}, "supported": "{str(len(a) % 3 == 0).lower()}"}}' for a in asked])
    return judged.select("gen_id", "correct", "supported")


def allowed_calls(spark, folder):
    """The calls a run may make with fifty new ones, answers of one model being in the cache."""
    own = _generation(spark, folder).select("gen_id", F.col("cache_key").alias("key"), "model")
    cache = own.filter("model = 'model-a' OR gen_id % 3 = 0").select("key")
    return answers.within_allowance(own.select("key", "gen_id"), cache, 50, SALT).select("gen_id")


def same_answers(spark, folder):
    """Which reference answers say the same in both languages, word for word."""
    rows = read(spark, folder, "questions").dropDuplicates(["qid"]).select("qid", F.col("answer.en").alias("en"), F.col("answer.ar").alias("ar"), F.lit(None).cast("string").alias("type"), "kind")
    own, t = questions.prepare(rows, {"en": "en", "ar": "ar"})
    return own.select("qid", questions.kind_of(own).alias("kind"), questions.same_answer(t["en"], t["ar"]).alias("same"))


def _question_rows(spark, folder) -> DataFrame:
    """(qid, kind, question, answer and first gold passage in both languages)."""
    own = read(spark, folder, "questions").dropDuplicates(["qid"])
    flat = own.select("qid", "kind", *(F.coalesce(F.col(f"{f}.{x}"), F.lit("")).alias(f"{f}_{x}") for f in ("question", "answer") for x in T.LANGS), F.get("gold_chunks", F.lit(0)).alias("chunk_id"))
    passages = _chunks(spark, folder, *T.LANGS).select("chunk_id", *(F.coalesce(x, F.lit("")).alias(f"passage_{x}") for x in T.LANGS))
    return flat.join(passages, "chunk_id")


def evidence_checks(spark, folder):
    """Whether the answer stands in the first gold passage: as whole words, or forgivingly."""
    rows, t = questions.prepare(_question_rows(spark, folder), {f"{f}_{x}": x for f in ("answer", "passage") for x in T.LANGS})
    out = {f"{name}_{x}": f(t[f"passage_{x}"].tokens, t[f"answer_{x}"].tokens, *more) for x in T.LANGS for name, f, more in (("span", T.contains_span, ()), ("evidence", T.contains_evidence, (x,)))}
    return rows.select("qid", *(c.alias(name) for name, c in out.items()))


def _single(rows: DataFrame) -> Column:
    """Status of stored questions taken as single-passage attempts from English, the models' steps taken as passed."""
    rows, t = questions.prepare(rows, {f"{f}_{x}": x for f in ("question", "answer", "passage") for x in T.LANGS})
    parts = {"passage": t["passage_en"], "question": t["question_en"], "answer": t["answer_en"], "evidence": t["answer_en"], "passage_t": t["passage_ar"], "question_t": t["question_ar"], "answer_t": t["answer_ar"], "span": t["answer_ar"]}
    return rows.withColumn("status", questions.single_status(parts, "en", "ar", F.lit("false"), F.lit("true"), F.lit("true")))


def single_statuses(spark, folder):
    return _single(_question_rows(spark, folder)).groupBy("kind", "status").agg(F.count("*").alias("n"))


def bridge_statuses(spark, folder):
    """The same questions taken as bridges: no document may be named, and the answer must stand in the second passage."""
    rows, t = questions.prepare(_question_rows(spark, folder), {f"{f}_{x}": x for f in ("question", "answer", "passage") for x in T.LANGS})
    parts = {"passage_a": t["passage_en"], "passage_b": t["passage_en"], "question": t["question_en"], "answer": t["answer_en"], "evidence_a": t["answer_en"], "evidence_b": t["answer_en"], "passage_b_t": t["passage_ar"], "question_t": t["question_ar"], "answer_t": t["answer_ar"], "span": t["answer_ar"]}
    status = questions.bridge_status(parts, "en", "ar", F.lit("false"), F.lit("false"), F.lit("false"), F.lit("true"), F.lit("true"))
    return rows.select("kind", status.alias("status")).groupBy("kind", "status").agg(F.count("*").alias("n"))


def comparison_statuses(spark, folder):
    """The same questions as comparisons of the English and the Arabic answer; the choice is the parity that decides the order of options."""
    rows, t = questions.prepare(_question_rows(spark, folder), {f"{f}_{x}": x for f in ("question", "answer", "passage") for x in T.LANGS})
    first = F.when(F.col("kind") == "comparison", 1).otherwise(2)
    swap = questions.swapped(F.col("question_en"), F.col("chunk_id"))
    parts = {"passage_1": t["passage_en"], "passage_2": t["passage_en"], "question": t["question_en"], "option_1": t["answer_en"], "option_2": t["answer_ar"], "evidence_1": t["answer_en"], "evidence_2": t["answer_en"], "question_t": t["question_ar"], "option_1_t": t["answer_ar"], "option_2_t": t["answer_ar"]}
    nothing = F.lit(None).cast("int")
    status = questions.comparison_status(parts, "en", "ar", F.lit("false"), first, nothing, nothing, questions.unswap(F.lit(1), swap))
    return rows.select("kind", status.alias("status")).groupBy("kind", "status").agg(F.count("*").alias("n"))


def built_questions(spark, folder):
    """Questions accepted in waves, half of them from either direction: those that pass the single-passage gates."""
    rows = materialize(_single(_question_rows(spark, folder)).select("qid", "status"))
    candidates = questions.numbered(rows, [F.sha2(F.concat_ws("|", F.lit(SALT), "qid"), 256)], 400)
    built = questions.build(candidates.drop("status"), lambda wave: wave.join(rows, "qid"), 40)
    return built.attempts.groupBy("direction", "status").agg(F.count("*").alias("n"))


def replaced_kinds(spark, folder):
    """Bridges and comparisons run anew take the place of the earlier ones."""
    own = read(spark, folder, "questions").select("qid", "kind").distinct()
    new = own.filter("kind = 'bridge'").select(F.concat("qid", F.lit("-new")).alias("qid"), "kind")
    return questions.replace_kinds(own, new, ["bridge", "comparison"])


def status_ranking(spark, folder):
    """Statuses from common to rare, with their place."""
    from pyspark.sql import Window as W

    n = single_statuses(spark, folder).groupBy("status").agg(F.sum("n").alias("n"))
    return n.withColumn("place", F.row_number().over(W.orderBy(F.desc("n"), "status")).cast("bigint"))  # a row for each status


def evaluation_report(spark, folder):
    """The evaluation as its report shows it: a line of a table for each configuration and language pair."""
    from .queries import bm25_eval

    rows = sorted((r.asDict() for r in bm25_eval(spark, folder).collect()), key=lambda r: r["pair"])  # one row for each configuration
    table = grammar.markdown(rows, ["config", "pair", "n", "recall_5", "mrr_10", "ndcg_10"])
    return spark.createDataFrame(list(enumerate(table.split("\n"))), "place int, line string")


# --- financing ---------------------------------------------------------------------------------------------------

_BODIES = {"a": "Northern Harbour", "e": "Eastern Province", "s": "Southern Delta"}


def _resolutions(spark, folder) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sentences, English paragraphs, Arabic paragraphs) of made-up resolutions, one for each aligned document."""
    own = read(spark, folder, "unpc_docs").filter("n_links IS NOT NULL").select("doc_id", "n_links").distinct().groupBy("doc_id").agg(F.max("n_links").alias("k"))
    kind = F.get(F.split("doc_id", "/"), F.lit(1))
    body = F.coalesce(*(F.when(kind == a, F.lit(b)) for a, b in _BODIES.items()), F.lit("Western Isles"))
    amount = F.format_number(F.col("k") * 123_457 + 1_000, 0)
    sum_text = F.when(F.col("k") % 5 == 0, F.concat((F.col("k") + 1).cast("string"), F.lit(" million"))).otherwise(amount)
    year = F.lit(1990) + F.col("k") % 8
    told = {
        "account": F.when(F.col("k") % 3 == 0, F.lit("Special Account for the Mission")).otherwise(F.concat(F.lit("Special Account for the United Nations Mission in the "), body)),
        "add": F.when(F.col("k") % 7 == 1, F.lit("additional ")).otherwise(F.lit("")), "sum": sum_text, "from": year.cast("string"), "to": (year + 1).cast("string"), "support": F.when(F.col("k") % 7 == 2, F.lit(" for the support account")).otherwise(F.lit("")),
        "tail": F.when(F.col("k") % 7 == 3, F.lit(", in addition to the amount of 5,000 dollars already appropriated for it")).otherwise(F.lit(", inclusive of the amount of 9,999 dollars")), "verb": F.when(F.col("k") % 11 == 0, F.lit("to apportion")).otherwise(F.lit("to appropriate")),
    }
    english = contexts.render("Decides $verb to the $account the ${add}amount of $sum dollars$support for the period from 1 July $from to 30 June $to$tail;", **told)
    title = F.concat(F.lit("Financing of the United Nations Mission in the "), body, F.lit(". The General Assembly notes it."))
    arabic = F.when(F.col("k") % 4 == 1, F.lit("لا شيء هنا")).otherwise(F.concat(F.lit("تقرر أن تخصص مبلغ "), F.when(F.col("k") % 5 == 0, F.concat((F.col("k") + 1).cast("string"), F.lit(" مليون"))).otherwise(F.translate(amount, ",", " ")), F.lit(" دولار")))
    sentences = own.select("doc_id", F.explode(F.array(F.struct(F.lit(1).alias("pos"), title.alias("text")), F.struct((F.col("k") % 60 + 2).cast("int").alias("pos"), english.alias("text")))).alias("s")).select("doc_id", "s.pos", "s.text")
    return sentences, sentences.select("doc_id", F.col("pos").alias("first"), "text"), own.select("doc_id", F.lit(1).alias("first"), arabic.alias("text"))


def _records(spark, folder) -> DataFrame:
    sentences, english, arabic = _resolutions(spark, folder)
    wanted = appropriations.financing_documents(sentences)
    return appropriations.records(english.join(wanted, "doc_id", "left_semi"), arabic)


def appropriation_records(spark, folder):
    return _records(spark, folder).select("doc_id", "status", "mission", "period", "amount", "amount_text")


def appropriation_firsts(spark, folder):
    return appropriations.first_of_period(_records(spark, folder))


def appropriation_periods(spark, folder):
    return appropriations.by_period(appropriations.first_of_period(_records(spark, folder)))


def appropriation_histogram(spark, folder):
    return appropriations.missions_per_period(appropriations.by_period(appropriations.first_of_period(_records(spark, folder))))


def appropriation_verdict(spark, folder):
    return appropriations.verdict(appropriations.first_of_period(_records(spark, folder)), 5)


def resolution_paths(spark, folder):
    own = read(spark, folder, "unpc_docs").select("doc_id").distinct()
    return own.filter(appropriations.is_resolution(F.regexp_replace("doc_id", "^([0-9]{4}/a)/", "$1/res/"))).select("doc_id", symbols.doc_key(F.col("doc_id")).alias("key"))


QUERIES = {
    f.__name__: f
    for f in (
        jsonl_keyed, jsonl_fields, tsv_pairs, stored_runs, cached_answers, appended_ledger, audit_export, text_fingerprint, xml_links, xml_documents, encoded_texts, ledger_windows, pair_index, path_mismatches, headed_chunks, both_languages, alignment_errors_reversed, subject_terms, bridges, arabic_stems,
        rendered_prompts, parsed_verdicts, stub_answers, stub_verdicts, allowed_calls, same_answers, evidence_checks, single_statuses, bridge_statuses, comparison_statuses, built_questions, replaced_kinds, status_ranking, evaluation_report,
        appropriation_records, appropriation_firsts, appropriation_periods, appropriation_histogram, appropriation_verdict, resolution_paths,
    )
}


# --- SQL ---------------------------------------------------------------------------------------------------------

CHUNKS, QUESTIONS, GENERATION = oracle.CHUNKS, oracle.QUESTIONS, oracle.GENERATION
FULL_CHUNKS = "(SELECT DISTINCT chunk_id, doc_id, en, ar, header, n_beads FROM chunks)"
LINKS = "(SELECT doc_id AS ar_doc, CASE WHEN bead_no % 50 = 0 THEN doc_id || '/other' ELSE doc_id END AS en_doc, en, ar FROM (SELECT DISTINCT doc_id, bead_no, en, ar FROM beads))"
PLANTED = "(SELECT doc_id, -bead_no AS bead_no, CASE WHEN bead_no % 7 = 0 THEN list_append(en, '0:0') ELSE en END AS en, CASE WHEN bead_no % 7 = 0 THEN list_append(ar, '0:0') ELSE ar END AS ar FROM (SELECT DISTINCT doc_id, bead_no, en, ar FROM beads))"
PLANTED_NAMED = oracle.NAMED.replace(oracle.BEADS, PLANTED)
KEPT = "(SELECT DISTINCT qid, model, condition_spec, answer FROM generation)"


def _span(hay: str, needle: str) -> str:
    return f"(len({needle}) > 0 AND contains(' ' || array_to_string({hay}, ' ') || ' ', ' ' || array_to_string({needle}, ' ') || ' '))"


def _bare(toks: str) -> str:
    first = ", ".join(S.quote(c) for c in T.CONJUNCTIONS)
    return f"list_transform({toks}, lambda t: CASE WHEN length(t) >= 3 AND substr(t, 1, 1) IN ({first}) THEN substr(t, 2) ELSE t END)"


def _evidence(hay: str, needle: str, lang: str) -> str:
    if lang == "ar":
        return f"({_span(hay, needle)} OR {_span(_bare(hay), _bare(needle))})"
    return f"({_span(hay, needle)} OR (len({needle}) >= 5 AND contains(array_to_string({hay}, ''), array_to_string({needle}, ''))))"


def _more_than_described(text: str, pattern: str, described: str) -> str:
    """Whether a pattern stands somewhere without what would describe it."""
    return f"(len(regexp_extract_all({text}, '{pattern}')) > len(regexp_extract_all({text}, '{pattern}{described}')))"


def _re2(pattern: str) -> str:
    return pattern.replace("'", "''").replace("(?!", "(?:").replace("(?<!", "(?:")


_EDGE = "(?:$|[^\\p{L}\\p{N}_])"


def _refers(raw: str, normal: str, lang: str) -> str:
    if lang == "en":
        plain = "(?i)" + "|".join(checks.CONTEXT_EN)
        return f"(regexp_matches({raw}, '{plain}') OR {_more_than_described(raw, '(?i)' + checks.DOCUMENT_EN, _re2(checks.DESCRIBED_EN))})"
    phrases = "|".join(" ".join(T.fold_arabic(p).split()) for p in checks.CONTEXT_AR)
    a, b, c = checks.DOCUMENT_AR
    described = "\\s+(?:التي|الذي|المتعلقه|المعنونه|الصادره|المقدمه|المؤرخه|بشان|عن|حول)" + _EDGE
    first = a.replace(checks.DESCRIBED_AR, "")
    second = b.replace(checks.DESCRIBED_AR, "").replace("(?![\\p{L}\\p{N}_])", "")
    third = c.replace("(?![\\p{L}\\p{N}_])", _EDGE)
    whole = f"regexp_matches({normal}, '{second}{_EDGE}') AND NOT regexp_matches({normal}, '{second}{described}')"
    return f"(regexp_matches({normal}, '{phrases}') OR {_more_than_described(normal, first, described)} OR ({whole}) OR regexp_matches({normal}, '{third}'))"


def _names_document(normal: str) -> str:
    return f"regexp_matches({normal}, '[a-z]+/[\\p{{L}}\\p{{N}}_.]*[0-9]|(^|[^\\p{{L}}\\p{{N}}_])[0-9]{{1,4}}\\s*/\\s*[0-9]{{1,4}}{_EDGE}')"


def _first_failing(gates: list[tuple[str, str]]) -> str:
    return "CASE " + " ".join(f"WHEN NOT coalesce({ok}, false) THEN '{name}'" for name, ok in gates) + " ELSE 'accepted' END"


def _text_columns(names: dict[str, str], table: str) -> str:
    """A table with the normal form n_c and tokens t_c of its text columns c."""
    inner = ", ".join(f"{S.normal(c, lang)} AS n_{c}" for c, lang in names.items())
    outer = ", ".join(f"{S.words(f'n_{c}')} AS t_{c}" for c in names)
    return f"(SELECT *, {outer} FROM (SELECT *, {inner} FROM {table}))"


SIX = {f"{f}_{x}": x for f in ("question", "answer", "passage") for x in T.LANGS}
ROWS = f"""(SELECT q.qid, q.kind, c.chunk_id, coalesce(q.question.en, '') AS question_en, coalesce(q.question.ar, '') AS question_ar, coalesce(q.answer.en, '') AS answer_en, coalesce(q.answer.ar, '') AS answer_ar,
  coalesce(c.en, '') AS passage_en, coalesce(c.ar, '') AS passage_ar FROM {QUESTIONS} q JOIN {FULL_CHUNKS} c ON c.chunk_id = q.gold_chunks[1])"""
TEXTS = _text_columns(SIX, ROWS)


def _given(*columns: str) -> str:
    return "(" + " AND ".join(f"trim({c}, ' ') <> ''" for c in columns) + ")"


SINGLE = _first_failing([
    ("missing_fields", _given("question_en", "answer_en")), ("evidence_not_in_passage", _evidence("t_passage_en", "t_answer_en", "en")), ("answer_not_in_passage", _span("t_passage_en", "t_answer_en")),
    ("context_reference", "NOT " + _refers("question_en", "n_question_en", "en")), ("translation_missing_fields", _given("question_ar", "answer_ar")), ("context_reference_translated", "NOT " + _refers("question_ar", "n_question_ar", "ar")),
    ("verified_answer_not_in_passage", _span("t_passage_ar", "t_answer_ar")),
])
BRIDGE = _first_failing([
    ("missing_fields", _given("question_en", "answer_en")), ("evidence_not_in_passage", _evidence("t_passage_en", "t_answer_en", "en")), ("answer_not_in_passage_b", _span("t_passage_en", "t_answer_en")),
    ("context_reference", "NOT " + _refers("question_en", "n_question_en", "en")), ("document_number_in_question", "NOT " + _names_document("n_question_en")), ("translation_missing_fields", _given("question_ar", "answer_ar")),
    ("context_reference_translated", "NOT " + _refers("question_ar", "n_question_ar", "ar")), ("document_number_in_question_translated", "NOT " + _names_document("n_question_ar")), ("verified_answer_not_in_passage_b", _span("t_passage_ar", "t_answer_ar")),
])
_CHOICE = "CASE WHEN CAST('0x' || right(sha256(question_en || chr(0) || chunk_id), 1) AS BIGINT) % 2 = 1 THEN 2 ELSE 1 END"
COMPARISON = _first_failing([
    ("missing_fields", _given("question_en", "answer_en", "answer_ar")), ("options_not_distinct", "n_answer_en <> n_answer_ar"), ("evidence_not_in_passage", _evidence("t_passage_en", "t_answer_en", "en")),
    ("options_not_in_question", f"{_evidence('t_question_en', 't_answer_en', 'en')} AND {_evidence('t_question_en', 't_answer_ar', 'en')}"), ("context_reference", "NOT " + _refers("question_en", "n_question_en", "en")),
    ("translation_missing_fields", _given("question_ar", "answer_ar")), ("context_reference_translated", "NOT " + _refers("question_ar", "n_question_ar", "ar")), ("verified_choice_mismatch", f"{_CHOICE} = CASE WHEN kind = 'comparison' THEN 1 ELSE 2 END"),
])

# The stored questions, re-examined by the rules that need no model.
_HELD = f"""(SELECT qid, bool_and(there) AS in_corpus, bool_or({_span('t_passage', 't_answer')}) AS held FROM {_text_columns({'passage': 'en', 'answer': 'en'}, f'''(SELECT g.qid, c.chunk_id IS NOT NULL AS there, coalesce(c.en, '') AS passage, coalesce(g.answer, '') AS answer
  FROM (SELECT qid, answer.en AS answer, unnest(gold_chunks) AS chunk_id FROM {QUESTIONS}) g LEFT JOIN {FULL_CHUNKS} c USING (chunk_id))''')} GROUP BY qid)"""
_CHECKED = _text_columns({"q_en": "en", "q_ar": "ar"}, f"(SELECT q.qid, q.kind, q.direction, coalesce(q.question.en, '') AS q_en, coalesce(q.question.ar, '') AS q_ar, coalesce(q.answer.en, '') AS a_en, coalesce(q.answer.ar, '') AS a_ar, h.in_corpus, h.held FROM {QUESTIONS} q LEFT JOIN {_HELD} h USING (qid))")
FUNNEL = f"SELECT kind, direction, status, count(*) AS n FROM (SELECT kind, direction, " + _first_failing([
    ("missing_fields", _given("q_en", "q_ar", "a_en", "a_ar")), ("context_reference_en", "NOT " + _refers("q_en", "n_q_en", "en")), ("context_reference_ar", "NOT " + _refers("q_ar", "n_q_ar", "ar")),
    ("document_number_in_question", f"kind <> 'bridge' OR NOT {_names_document('n_q_en')}"), ("not_a_grouped_number", f"kind <> 'numeric' OR regexp_matches(q_en, '{oracle.GROUPED}') OR regexp_matches(a_en, '{oracle.GROUPED}')"),
    ("gold_not_in_corpus", "in_corpus"), ("answer_not_in_passage", "kind NOT IN ('single', 'numeric') OR held"),
]) + f" AS status FROM {_CHECKED}) GROUP BY ALL"

# Waves of attempts: what each direction still wants, wave by wave.
_IN_WAVE = "s.place >= w.first AND s.place < w.first + w.l0 + w.l1"
_FORWARD = "CASE WHEN s.place - w.first < 2 * least(w.l0, w.l1) THEN (s.place - w.first) % 2 = 0 ELSE w.l0 > w.l1 END"
BUILT = f"""
WITH RECURSIVE s AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY sha256('{SALT}|' || qid)) - 1 AS place FROM (SELECT qid, {SINGLE} AS status FROM {TEXTS}) QUALIFY place < 400),
w AS (SELECT CAST(0 AS BIGINT) AS first, CAST(20 AS BIGINT) AS l0, CAST(20 AS BIGINT) AS l1
  UNION ALL SELECT any_value(w.first + w.l0 + w.l1), any_value(w.l0) - count(*) FILTER (WHERE status = 'accepted' AND {_FORWARD}), any_value(w.l1) - count(*) FILTER (WHERE status = 'accepted' AND NOT {_FORWARD})
  FROM w JOIN s ON {_IN_WAVE} HAVING count(*) > 0)
SELECT CASE WHEN {_FORWARD} THEN 'en->ar' ELSE 'ar->en' END AS direction, status, count(*) AS n FROM w JOIN s ON {_IN_WAVE} GROUP BY ALL
"""
_COLUMNS = ["config", "pair", "n", "recall_5", "mrr_10", "ndcg_10"]
REPORT = f"""
SELECT 0 AS place, '| {" | ".join(_COLUMNS)} |' AS line UNION ALL SELECT 1, '|{"---|" * len(_COLUMNS)}'
UNION ALL SELECT CAST(row_number() OVER (ORDER BY pair) + 1 AS INTEGER), '| ' || config || ' | ' || pair || ' | ' || format('{{:,}}', n) || ' | ' || {" || ' | ' || ".join(f"format('{{:.3f}}', {c})" for c in _COLUMNS[3:])} || ' |' FROM ({oracle.EVAL})
"""

# Light stems: one prefix, then every suffix, where enough letters stay.
_CUT = "CASE " + " ".join(f"WHEN starts_with(word, '{p}') AND length(word) >= {4 if len(p) == 1 else len(p) + 2} THEN substr(word, {len(p) + 1})" for p in stemming.ARABIC_PREFIXES) + " ELSE word END"
_SUFFIXES = ", ".join(S.quote(x) for x in stemming.ARABIC_SUFFIXES)
STEMS = f"""
SELECT word, list_reduce(list_concat([{_CUT}], [{_SUFFIXES}]), lambda w, x: CASE WHEN length(w) >= length(x) + 2 AND ends_with(w, x) THEN left(w, length(w) - length(x)) ELSE w END) AS stem, n
FROM (SELECT word, count(*) AS n FROM (SELECT unnest(list_distinct({S.tokens('ar', 'ar')})) AS word FROM {CHUNKS}) GROUP BY word)
"""

# A configuration by name: the hybrid of two analyzers, scored anew by the F1 of words in small letters.


def _low(expr: str) -> str:
    return S.words(f"lower(coalesce({expr}, ''))")


HYBRID = f"""
WITH p AS MATERIALIZED (SELECT r.qid, r.doc, {_low('q.question.en')} AS a, {_low('c.en')} AS b FROM {oracle.rrf([oracle.bm25('en', 20), oracle.bm25('en', 20, 'norm')], 100, 20)} r JOIN {oracle.ASKED} q USING (qid) JOIN {CHUNKS} c ON c.chunk_id = r.doc),
ca AS (SELECT qid, doc, t, count(*) AS n FROM (SELECT qid, doc, unnest(a) AS t FROM p) GROUP BY ALL), cb AS (SELECT qid, doc, t, count(*) AS n FROM (SELECT qid, doc, unnest(b) AS t FROM p) GROUP BY ALL),
o AS (SELECT qid, doc, sum(least(ca.n, cb.n)) AS both_n FROM ca JOIN cb USING (qid, doc, t) GROUP BY ALL), s AS (SELECT p.qid, p.doc, 2.0 * coalesce(both_n, 0) / (len(a) + len(b)) AS score FROM p LEFT JOIN o USING (qid, doc))
SELECT qid, doc, round(score, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc) AS rank FROM s
"""

# Numbers of the Arabic side put in order, run by run.
_RUN = f"{oracle.DIGIT}(?:(?:{oracle.DIGIT}|{oracle.BLANK})*{oracle.DIGIT})?"
_ASCII = f"translate(r, {S.quote(T.DIGITS_FROM)}, {S.quote(T.DIGITS_TO)})"
REPAIR = f"""
WITH c AS (SELECT chunk_id, ar, list_filter(list_distinct({oracle.english_numbers('en')}), lambda x: array_to_string(list_reverse(string_split(x, ',')), ',') <> x) AS xs FROM {CHUNKS} WHERE en IS NOT NULL AND ar IS NOT NULL),
t AS (SELECT chunk_id, xs, unnest(regexp_extract_all(ar, '(?s){_RUN}|[^0-9٠-٩۰-۹]+')) AS r, unnest(range(len(regexp_extract_all(ar, '(?s){_RUN}|[^0-9٠-٩۰-۹]+')))) AS i FROM c),
g AS (SELECT *, regexp_matches(r, '^{oracle.DIGIT}') AND list_contains(xs, array_to_string(list_reverse(regexp_extract_all({_ASCII}, '[0-9]+')), ',')) AS hit, regexp_extract_all(r, '{oracle.DIGIT}+') AS d, regexp_extract_all(r, '{oracle.BLANK}+') AS b FROM t),
f AS (SELECT chunk_id, i, hit, CASE WHEN hit THEN array_to_string(list_transform(range(1, len(d) + 1), lambda k: d[len(d) + 1 - k] || coalesce(b[k], '')), '') ELSE r END AS r FROM g)
SELECT chunk_id, string_agg(r, '' ORDER BY i) AS ar, count(*) FILTER (WHERE hit) AS numbers_corrected FROM f GROUP BY chunk_id HAVING count(*) FILTER (WHERE hit) > 0
"""

# Pairs of documents, taken one by one in order.
COMPARISONS = f"""
WITH RECURSIVE k AS (SELECT DISTINCT doc_id, trim(regexp_replace(split_part(kw, '--', 1), '\\s*\\([^)]*\\)', '', 'g'), ' ') AS term FROM (SELECT doc_id, unnest(keywords) AS kw FROM {CHUNKS})),
s AS (SELECT term, count(*) AS n_docs FROM k WHERE term <> '' GROUP BY term HAVING count(*) BETWEEN 2 AND 20),
o AS MATERIALIZED (SELECT s.term, s.n_docs, c.doc_id, c.chunk_id FROM (SELECT doc_id, chunk_id, {S.tokens('en', 'en')} AS t FROM {CHUNKS} WHERE chunk_id IN ({oracle.CONTENT})) c JOIN k USING (doc_id) JOIN s USING (term) WHERE {_span('c.t', S.tokens('k.term', 'en'))}),
one AS (SELECT term, n_docs, doc_id, arg_min(chunk_id, sha256('{SALT}|' || chunk_id)) AS chunk_id FROM o GROUP BY ALL),
p AS MATERIALIZED (SELECT a.term, a.doc_id AS doc_1, a.chunk_id AS chunk_1, b.doc_id AS doc_2, b.chunk_id AS chunk_2, row_number() OVER (ORDER BY a.n_docs, a.term, sha256('{SALT}|' || a.doc_id || '|' || b.doc_id)) AS i FROM one a JOIN one b ON a.term = b.term AND a.doc_id < b.doc_id),
w AS (SELECT CAST(0 AS BIGINT) AS i, CAST([] AS VARCHAR[]) AS used, false AS took
  UNION ALL SELECT p.i, CASE WHEN list_contains(used, doc_1) OR list_contains(used, doc_2) THEN used ELSE list_concat(used, [doc_1, doc_2]) END, NOT (list_contains(used, doc_1) OR list_contains(used, doc_2)) FROM w JOIN p ON p.i = w.i + 1)
SELECT term, doc_1, chunk_1, doc_2, chunk_2 FROM w JOIN p USING (i) WHERE took
"""

# The rendered resolutions.
_BODY = "CASE split_part(doc_id, '/', 2) " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in _BODIES.items()) + " ELSE 'Western Isles' END"
_GROUPED_SUM = "trim(format('{:,}', k * 123457 + 1000))"
RESOLUTIONS = f"""r AS (SELECT doc_id, k, {_BODY} AS body, CASE WHEN k % 5 = 0 THEN CAST(k + 1 AS VARCHAR) || ' million' ELSE {_GROUPED_SUM} END AS sum_text, CASE WHEN k % 5 = 0 THEN (k + 1) * 1000000 ELSE k * 123457 + 1000 END AS amount, 1990 + k % 8 AS y
  FROM (SELECT doc_id, max(n_links) AS k FROM unpc_docs WHERE n_links IS NOT NULL GROUP BY doc_id)),
f AS (SELECT doc_id, CASE WHEN k % 7 = 1 THEN 'additional' WHEN k % 7 = 2 THEN 'support_account' WHEN k % 7 = 3 THEN 'partial' WHEN k % 4 = 1 THEN 'arabic_amount_not_found' ELSE 'usable' END AS status, lower('United Nations Mission in the ' || body) AS mission,
  '1 July ' || y || ' - 30 June ' || (y + 1) AS period, CAST(amount AS BIGINT) AS amount, sum_text AS amount_text FROM r WHERE k % 11 <> 0)"""
FIRSTS = "(SELECT mission, period, min(doc_id) AS doc_id, arg_min(amount, doc_id) AS amount, count(*) - 1 AS n_repeats FROM f WHERE status = 'usable' GROUP BY ALL)"
PERIODS = f"(SELECT period, count(DISTINCT mission) AS n_missions, CAST(floor(count(DISTINCT mission) / 2) AS BIGINT) AS disjoint_pairs, CAST(count(DISTINCT mission) * (count(DISTINCT mission) - 1) / 2 AS BIGINT) AS all_pairs FROM {FIRSTS} GROUP BY period)"

_NAMING = f"(SELECT length(doc_id) AS n, min(replace(upper({oracle.doc_key('doc_id')}), '_', '.')) AS path FROM {CHUNKS} GROUP BY 1)"
CITING = f"(SELECT c.* REPLACE (CASE WHEN CAST('0x' || substr(sha256(c.chunk_id), 1, 4) AS BIGINT) % 12 = 0 THEN c.en || ' As stated in ' || f.path || ' before.' ELSE c.en END AS en) FROM {CHUNKS} c JOIN {_NAMING} f ON length(c.doc_id) = f.n)"
BRIDGES = f"""
WITH x AS MATERIALIZED (SELECT doc_id, chunk_id, en FROM {CITING} WHERE chunk_id IN ({oracle.CONTENT.replace(oracle.CHUNKS, CITING)})),
d AS (SELECT DISTINCT doc_id AS doc_b, {oracle.doc_key('doc_id')} AS key FROM x),
c AS (SELECT doc_id AS doc_a, chunk_id AS chunk_a, unnest({oracle.symbols('en')}) AS symbol FROM x),
l AS (SELECT doc_a, chunk_a, symbol, doc_b FROM (SELECT *, {oracle.symbol_key('symbol')} AS key FROM c) JOIN d USING (key) WHERE doc_a <> doc_b QUALIFY row_number() OVER (PARTITION BY doc_a ORDER BY sha256('{SALT}|' || chunk_a || '|' || symbol || '|' || doc_b), chunk_a, symbol, doc_b) = 1),
e AS (SELECT doc_id AS doc_b, chunk_id AS chunk_b FROM x QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY chunk_id) <= 5),
t AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY doc_b ORDER BY sha256('{SALT}|' || chunk_b), chunk_b) = 1)
SELECT doc_a, chunk_a, symbol, doc_b, chunk_b FROM l JOIN t USING (doc_b)
"""
_AUDIT = "SELECT DISTINCT qid, kind, source FROM questions"
SQL = {
    "jsonl_keyed": f"SELECT chunk_id, doc_id, en, n_beads FROM {FULL_CHUNKS} WHERE chunk_id IN (SELECT unnest(gold_chunks) FROM questions)",
    "jsonl_fields": f"SELECT chunk_id, n_beads FROM {FULL_CHUNKS}",
    "tsv_pairs": "SELECT DISTINCT doc_id, doc_score, n_links, n_one_to_one FROM unpc_docs",
    "stored_runs": f"SELECT 'unpc' AS corpus, 'hybrid_bm25-raw__bm25-norm' AS config, lang || '-' || lang AS pair, count(*) AS n, count(DISTINCT gen_id) AS n_questions, round(sum(round(1.0 / (60 + i), 6)), 3) AS total FROM (SELECT lang, gen_id, unnest(context_ids) AS doc, unnest(range(len(context_ids))) AS i FROM {GENERATION} WHERE len(context_ids) > 0) WHERE doc IS NOT NULL AND lang IN ('en', 'ar') GROUP BY ALL",
    "cached_answers": f"SELECT qid, model, condition_spec, min(answer) AS response FROM {KEPT} GROUP BY ALL",
    "appended_ledger": f"SELECT model, count(*) AS n, CAST(sum(length(coalesce(answer, ''))) AS BIGINT) AS chars FROM {GENERATION} WHERE lang IN ('en', 'ar') GROUP BY model",
    "audit_export": f"SELECT 'qid,kind,source,note' AS line UNION ALL SELECT qid || ',' || kind || ',' || source || ',' || CASE kind WHEN 'numeric' THEN 'numeric' WHEN 'bridge' THEN 'bridge' ELSE 'all' END FROM ({_AUDIT})",
    "text_fingerprint": "SELECT substr(sha256('encoder-1' || chr(0) || 'passage: ' || chr(0) || string_agg(h, '' ORDER BY r)), 1, 16) AS key FROM (SELECT floor(doc_id / 4096) AS r, sha256(string_agg(sha256(coalesce(text, '')), '' ORDER BY doc_id, sha256(coalesce(text, '')))) AS h FROM documents GROUP BY 1)",
    "xml_links": f"""SELECT doc_id, CAST(floor(bead_no / {BLOCK}) AS BIGINT) AS block, row_number() OVER (PARTITION BY doc_id, floor(bead_no / {BLOCK}) ORDER BY bead_no, array_to_string(ar, ' ') || ';' || array_to_string(en, ' ')) - 1 AS place,
      coalesce(array_to_string(ar, ' '), '') AS ar, coalesce(array_to_string(en, ' '), '') AS en FROM (SELECT DISTINCT doc_id, bead_no, en, ar FROM beads) WHERE doc_id IN (SELECT doc_id FROM sentences WHERE lang = 'en' AND text <> '' INTERSECT SELECT doc_id FROM sentences WHERE lang = 'ar' AND text <> '')""",
    "xml_documents": f"SELECT doc_id || '#' || CAST(floor(pos / {BLOCK}) AS BIGINT) AS path, doc_id AS symbol, CAST(1 AS BIGINT) AS n_keywords, count(*) AS n, arg_min(sid, lpad(CAST(pos AS VARCHAR), 9, '0') || sid) AS first, false AS broken FROM {oracle.NEWEST} WHERE lang = 'en' AND text IS NOT NULL GROUP BY ALL",
    "encoded_texts": f"SELECT qid AS id, round((7 + length(question.en)) / sqrt((7 + length(question.en)) ** 2 + 10000), 4) AS x, round(100 / sqrt((7 + length(question.en)) ** 2 + 10000), 4) AS y FROM {QUESTIONS}",
    "ledger_windows": f"SELECT CAST(floor(epoch(answered_at) / 86400) AS BIGINT) AS day, model, count(*) AS calls, CAST(sum(length(coalesce(answer, ''))) AS BIGINT) AS prompt_tokens, count(*) AS completion_tokens FROM {GENERATION} WHERE answered_at IS NOT NULL GROUP BY ALL",
    "stub_answers": f"""WITH c AS (SELECT g.gen_id, g.condition, g.qid, string_agg(t.ar, chr(10) ORDER BY g.i) AS p FROM (SELECT gen_id, condition, qid, unnest(context_ids) AS chunk_id, unnest(range(len(context_ids))) AS i FROM {GENERATION}) g JOIN (SELECT chunk_id, max(ar) AS ar FROM chunks GROUP BY 1) t USING (chunk_id) WHERE t.ar IS NOT NULL GROUP BY ALL),
      a AS (SELECT CAST(g.gen_id AS VARCHAR) AS qid, g.condition, g.qid || chr(10) || coalesce(c.p, '') AS prompt FROM {GENERATION} g LEFT JOIN c USING (gen_id) WHERE g.condition <> 'closed_book' OR c.p IS NULL)
      SELECT qid, CASE WHEN length(prompt) % 2 = 0 THEN 'UNKNOWN NOT_IN_CONTEXT' ELSE trim(left(prompt, 12), ' ') END AS answer, length(prompt) % 2 = 0 AS abstained FROM a""",
    "stub_verdicts": f"""SELECT gen_id, NOT coalesce(abstained, false) AND length(coalesce(answer, '')) % 2 = 0 AS correct, CASE WHEN NOT coalesce(abstained, false) AND coalesce(len(context_ids), 0) > 0 THEN length(coalesce(qid, '')) % 3 = 0 END AS supported FROM {GENERATION}""",
    "allowed_calls": f"""WITH c AS (SELECT DISTINCT cache_key AS key FROM {GENERATION} WHERE model = 'model-a' OR gen_id % 3 = 0), n AS (SELECT DISTINCT cache_key AS key FROM {GENERATION} WHERE cache_key IS NOT NULL AND cache_key NOT IN (SELECT key FROM c WHERE key IS NOT NULL)),
      f AS (SELECT key FROM n ORDER BY sha256('{SALT}|' || key), key LIMIT 50) SELECT gen_id FROM {GENERATION} WHERE cache_key IN (SELECT key FROM f UNION SELECT key FROM c)""",
    "same_answers": f"SELECT qid, kind, len(t_en) > 0 AND t_en = t_ar AS same FROM {_text_columns({'en': 'en', 'ar': 'ar'}, f'(SELECT qid, kind, answer.en AS en, answer.ar AS ar FROM {QUESTIONS})')}",
    "pair_index": f"SELECT en_doc AS doc_id, CAST(0.5 AS DOUBLE) AS doc_score, count(*) AS n_links, count(*) FILTER (WHERE len(en) = 1 AND len(ar) = 1) AS n_one_to_one FROM {LINKS} WHERE en_doc = ar_doc GROUP BY en_doc",
    "path_mismatches": f"SELECT count(*) AS n FROM (SELECT DISTINCT ar_doc, en_doc FROM {LINKS} WHERE ar_doc <> en_doc)",
    "headed_chunks": f"SELECT chunk_id, sha256(concat_ws(chr(10), header, en)) AS en, sha256(concat_ws(chr(10), header, ar)) AS ar FROM {FULL_CHUNKS} WHERE trim(coalesce(en, ''), ' ') <> '' AND trim(coalesce(ar, ''), ' ') <> ''",
    "both_languages": "SELECT doc_id FROM sentences WHERE lang = 'en' AND text <> '' INTERSECT SELECT doc_id FROM sentences WHERE lang = 'ar' AND text <> ''",
    "alignment_errors_reversed": oracle.ALIGN.replace(oracle.NAMED, PLANTED_NAMED),
    "subject_terms": f"SELECT DISTINCT doc_id, trim(regexp_replace(split_part(kw, '--', 1), '\\s*\\([^)]*\\)', '', 'g'), ' ') AS term FROM (SELECT doc_id, unnest(keywords) AS kw FROM {CHUNKS})",
    "bridges": BRIDGES,
    "rendered_prompts": f"""SELECT q.qid, sha256('Passages:' || chr(10) || p || chr(10) || chr(10) || 'Question (' || q.kind || '): ' || coalesce(q.question.en, '') || chr(10) || 'Cost: $1') AS prompt FROM {QUESTIONS} q JOIN
      (SELECT qid, string_agg('Passage ' || n || ':' || chr(10) || '<<<' || chr(10) || en || chr(10) || '>>>', chr(10) || chr(10) ORDER BY n) AS p FROM (SELECT g.qid, c.en, row_number() OVER (PARTITION BY g.qid ORDER BY g.i) AS n FROM (SELECT qid, unnest(gold_chunks) AS chunk_id, unnest(range(len(gold_chunks))) AS i FROM {QUESTIONS}) g JOIN {FULL_CHUNKS} c USING (chunk_id) WHERE c.en IS NOT NULL) GROUP BY qid) USING (qid)""",
    "parsed_verdicts": f"SELECT gen_id, gen_id % 11 <> 0 AND coalesce(correct, false) AS correct, gen_id % 11 <> 0 AND coalesce(supported, false) AS supported, gen_id % 11 <> 0 AS parsed FROM {GENERATION}",
    "evidence_checks": "SELECT qid, " + ", ".join(f"{_span(f't_passage_{x}', f't_answer_{x}')} AS span_{x}, {_evidence(f't_passage_{x}', f't_answer_{x}', x)} AS evidence_{x}" for x in T.LANGS) + f" FROM {TEXTS}",
    "single_statuses": f"SELECT kind, {SINGLE} AS status, count(*) AS n FROM {TEXTS} GROUP BY ALL",
    "bridge_statuses": f"SELECT kind, {BRIDGE} AS status, count(*) AS n FROM {TEXTS} GROUP BY ALL",
    "comparison_statuses": f"SELECT kind, {COMPARISON} AS status, count(*) AS n FROM {TEXTS} GROUP BY ALL",
    "built_questions": BUILT,
    "evaluation_report": REPORT,
    "replaced_kinds": "SELECT DISTINCT qid, kind FROM questions WHERE kind NOT IN ('bridge', 'comparison') UNION ALL SELECT DISTINCT qid || '-new', kind FROM questions WHERE kind = 'bridge'",
    "status_ranking": f"SELECT status, n, row_number() OVER (ORDER BY n DESC, status) AS place FROM (SELECT {SINGLE} AS status, count(*) AS n FROM {TEXTS} GROUP BY ALL)",
    "appropriation_records": f"WITH {RESOLUTIONS} SELECT doc_id, status, mission, period, amount, amount_text FROM f",
    "appropriation_firsts": f"WITH {RESOLUTIONS} SELECT * FROM {FIRSTS}",
    "appropriation_periods": f"WITH {RESOLUTIONS} SELECT * FROM {PERIODS}",
    "appropriation_histogram": f"WITH {RESOLUTIONS} SELECT n_missions, count(*) AS n_periods FROM {PERIODS} GROUP BY 1",
    "appropriation_verdict": f"WITH {RESOLUTIONS} SELECT (SELECT count(DISTINCT mission) FROM {FIRSTS}) AS n_missions, count(*) AS n_periods, CAST(sum(disjoint_pairs) AS BIGINT) AS disjoint_pairs, CAST(sum(all_pairs) AS BIGINT) AS all_pairs, sum(disjoint_pairs) >= 5 AS enough FROM {PERIODS}",
    "resolution_paths": "SELECT DISTINCT doc_id, regexp_replace(doc_id, '^[^/]*/', '') AS key FROM unpc_docs WHERE regexp_matches(doc_id, '^[0-9]{4}/a/')",
    "arabic_stems": STEMS,
    "grammar_hybrid": HYBRID,
    "question_funnel": FUNNEL,
    "number_repair": REPAIR,
    "comparison_pairs": COMPARISONS,
}
