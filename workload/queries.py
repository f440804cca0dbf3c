"""The registered queries: one per operator, over the driver's tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paraseg import fixed
from paraseg.fixed import DOCUMENT, SEGMENT
from paraseg.functions.ngrams import CHAR_ORDER, WORD_ORDER
from paraseg.functions.scores import bleu_signature
from paraseg.functions.text import tokens_13a
from paraseg.operators import align, compare, corpus, metrics, requests, responses, usage
from paraseg.plans.corpus import sample_corpus
from paraseg.plans.experiment import run_experiment
from paraseg.plans.merge import merge_files
from paraseg.plans.scoring import score
from paraseg.plans.translate import translate_segments
from paraseg.session import shared_dir, written
from paraseg.sources import naming, records, reports
from paraseg.sources.pairs import read_pairs
from paraseg.sources.segments import (
    read_segment_files,
    read_segment_table,
    read_segments,
    write_segment_files,
    write_segment_table,
    write_segments,
)
from workload import fixtures as fx

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
RUN = metrics.RUN
SCORED = metrics.SCORED
PUBLISHED_MODES = list(fx.REWRITES)


def query(run: Callable[[SparkSession, str], DataFrame]):
    QUERIES[run.__name__] = run
    return run


def digest(text: Column | str) -> Column:
    return F.md5(F.col(text) if isinstance(text, str) else text)


def six(column: str) -> Column:
    return F.round(column, 6).alias(column)


def scratch(spark: SparkSession) -> str:
    """A fresh folder inside the shared one."""
    return f"{shared_dir(spark)}/{uuid.uuid4().hex}"


def _stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.segment_stats(fx.aligned(spark, sf_dir), scorer=fx.length_ratio)


# Sources and sinks


@query
def s1_segments(spark, sf_dir):
    rows = fx.spaced_segments(spark, sf_dir)
    return rows.select(*SEGMENT, digest("text").alias("text_md5"))


@query
def s2_write_read(spark, sf_dir):
    """Each run as one aligned file of all its documents' lines, read back."""
    path = scratch(spark)
    order = F.col("doc_id").cast("bigint") * (1 << 32) + F.col("seg_id")
    whole_run = fx.spaced_segments(spark, sf_dir).select(
        "run_id", F.lit("corpus").alias("doc_id"), order.alias("seg_id"), "text"
    )
    write_segments(whole_run, path)
    rows = read_segments(spark, path)
    return rows.select(*SEGMENT, digest("text").alias("text_md5"))


@query
def s2_table(spark, sf_dir):
    """All documents in one table, each kept apart, read back."""
    path = scratch(spark)
    write_segment_table(fx.spaced_segments(spark, sf_dir), path)
    rows = read_segment_table(spark, path)
    return rows.select(*SEGMENT, digest("text").alias("text_md5"))


@query
def s2_files(spark, sf_dir):
    """All documents as aligned text in shared files, cut apart again by the manifest."""
    path = scratch(spark)
    write_segment_files(fx.spaced_segments(spark, sf_dir), path, file_bytes=4 << 20)
    rows = read_segment_files(spark, path)
    return rows.select(*SEGMENT, digest("text").alias("text_md5"))


@query
def s3_pairs_scan(spark, sf_dir):
    """Any two text columns can be the sides of a pair."""
    rows = read_pairs(spark, f"{sf_dir}/documents.parquet", source="source", target="text")
    return rows.select("pair_id", "src", digest("ref").alias("ref_md5"))


@query
def s4_scores_io(spark, sf_dir):
    path = scratch(spark)
    stats = written(_stats(spark, sf_dir))
    record = metrics.score_record(metrics.corpus_scores(stats))
    # Some segments have no score; the others keep their positions.
    stats = stats.filter("seg_id % 7 <> 3")
    records.write_score_records(metrics.nest_scores(record, stats.select(*SCORED, "score")), path)
    read = records.read_score_records(spark, path)
    rows = records.record_segments(read).select(*SCORED, "score")
    summary = read.groupBy(*RUN).agg(
        F.max("bleu").alias("bleu"), F.max("chrf").alias("chrf"), F.max("comet").alias("comet")
    )
    return rows.join(summary, RUN)


@query
def s5_reports_io(spark, sf_dir):
    path = scratch(spark)
    costs = usage.estimated_cost(usage.usage_counts(fx.calls(spark, sf_dir)), usage.price_table(spark))
    report = records.usage_report(usage.snapshots(costs), usage.usage_total(costs))
    records.write_reports(report, path)
    read = spark.read.schema(report.schema).json(path)
    entries = read.select("run_id", "total", F.explode("per_mode").alias("name", "snapshot"))
    return entries.select(
        "run_id",
        "name",
        "snapshot.model",
        F.col("snapshot.counts.calls").alias("calls"),
        F.col("snapshot.estimated_cost.usd").alias("usd"),
        F.col("snapshot.estimated_cost.note").alias("note"),
        F.col("total.counts.prompt_tokens").alias("total_prompt_tokens"),
        F.col("total.estimated_cost_usd").alias("total_usd"),
        F.col("total.priced").alias("priced"),
    )


@query
def s6_tag(spark, sf_dir):
    sample = sample_corpus(fx.pairs(spark, sf_dir), limit=None)
    return naming.dataset_tag(sample, "test", fixed.SAMPLE_SEED)


# Corpus preparation


@query
def c1_pair_filter(spark, sf_dir):
    kept = corpus.filter_pairs(fx.pairs(spark, sf_dir))
    return kept.select("pair_id", digest("src").alias("src_md5"), digest("ref").alias("ref_md5"))


@query
def c2_seeded_sample(spark, sf_dir):
    sample = corpus.sample_pairs(fx.pairs(spark, sf_dir), fixed.SAMPLE_LIMIT, fixed.SAMPLE_SEED)
    return sample.select("seg_id", "pair_id", digest("src").alias("src_md5"))


@query
def c2_seeded_shuffle(spark, sf_dir):
    """Without a limit: every pair gets its place in seeded order."""
    shuffled = corpus.sample_pairs(fx.pairs(spark, sf_dir), None, fixed.SAMPLE_SEED)
    return shuffled.select("seg_id", "pair_id")


@query
def c2_input_order(spark, sf_dir):
    """Without a seed: every pair gets its place in input order."""
    ordered = corpus.sample_pairs(fx.pairs(spark, sf_dir), None, None)
    return ordered.select("seg_id", "pair_id")


@query
def c3_normalise(spark, sf_dir):
    rows = corpus.normalise_pairs(fx.pairs(spark, sf_dir))
    return rows.select("pair_id", "src", "ref")


@query
def c4_head_limit(spark, sf_dir):
    rows = corpus.head(fx.segments(spark, sf_dir), 5)
    return rows.select(*SEGMENT, digest("text").alias("text_md5"))


@query
def c5_build_corpus(spark, sf_dir):
    return sample_corpus(fx.pairs(spark, sf_dir))


# Alignment


@query
def a1_align(spark, sf_dir):
    segments = fx.segments(spark, sf_dir)
    rows = align.align(segments, fx.trimmed_candidates(spark, sf_dir), segments)
    return rows.select(*SCORED, *[digest(c).alias(f"{c}_md5") for c in ("src", "cand", "ref")])


@query
def a2_alignment_check(spark, sf_dir):
    segments = fx.segments(spark, sf_dir)
    return align.check_alignment(segments, fx.trimmed_candidates(spark, sf_dir), segments)


@query
def a2_unmatched(spark, sf_dir):
    segments = fx.segments(spark, sf_dir)
    return align.unmatched_segments(segments, fx.trimmed_candidates(spark, sf_dir), segments)


# Requests and responses


@query
def t1_chunks(spark, sf_dir):
    chunks = requests.chunk_segments(fx.segments(spark, sf_dir))
    texts = F.array_join("texts", "\n")
    return chunks.select(
        *DOCUMENT, "chunk_id", "first_seg", "n_segments", digest(texts).alias("texts_md5")
    )


@query
def t2_numbered(spark, sf_dir):
    chunks = requests.chunk_segments(fx.segments(spark, sf_dir))
    return chunks.select(
        *DOCUMENT, "chunk_id", digest(requests.numbered(F.col("texts"))).alias("numbered_md5")
    )


@query
def t3_doc_context(spark, sf_dir):
    parts = requests.document_parts(requests.chunk_segments(fx.segments(spark, sf_dir)))
    return parts.select(
        *DOCUMENT, "part_id", digest("text").alias("text_md5"),
        F.length("text").cast("bigint").alias("part_chars"),
    )


@query
def t4_cache_eligible(spark, sf_dir):
    return requests.document_sizes(requests.chunk_segments(fx.segments(spark, sf_dir)))


def _prompts(asked: DataFrame) -> DataFrame:
    return asked.select(
        "request_id", "mode", *DOCUMENT, "first_seg", "n_segments", "uses_context",
        digest("prompt").alias("prompt_md5"),
    )


@query
def t5_requests(spark, sf_dir):
    """Context requests, long documents by reference."""
    chunks = requests.chunk_segments(fx.segments(spark, sf_dir))
    return _prompts(requests.context_requests(chunks, fx.TARGET))


@query
def t5_requests_inline(spark, sf_dir):
    """Without a cache every document is sent with each of its requests."""
    chunks = requests.chunk_segments(fx.segments(spark, sf_dir))
    return _prompts(requests.context_requests(chunks, fx.TARGET, cache=False))


@query
def t5_requests_blocks(spark, sf_dir):
    asked = requests.build_requests(
        fx.segments(spark, sf_dir), fx.TARGET, "English", PUBLISHED_MODES, style="blocks"
    )
    return _prompts(asked)


@query
def t5_context_texts(spark, sf_dir):
    chunks = written(requests.chunk_segments(fx.segments(spark, sf_dir)))
    styles = [
        requests.context_parts(chunks, fx.TARGET, style).withColumn("style", F.lit(style))
        for style in requests.OPENINGS
    ]
    rows = reduce(DataFrame.unionByName, styles)
    return rows.select("style", *DOCUMENT, "part_id", digest("text").alias("text_md5"))


@query
def t5_whole_texts(spark, sf_dir):
    chunks = written(requests.chunk_segments(fx.segments(spark, sf_dir)))
    rows = requests.whole_parts(chunks, fx.TARGET)
    return rows.select(*DOCUMENT, "part_id", digest("text").alias("text_md5"))


@query
def t6_blank_passthrough(spark, sf_dir):
    """Blank segments come back unchanged, the others need a request."""
    rows = fx.spaced_segments(spark, sf_dir)
    asked = requests.segment_requests(rows, fx.TARGET)
    sent = asked.select(*DOCUMENT, F.col("first_seg").alias("seg_id"), digest("prompt").alias("md5"))
    kept = requests.blank_segments(rows).select(*SEGMENT, digest("text").alias("md5"))
    return sent.withColumn("sent", F.lit(True)).unionByName(kept.withColumn("sent", F.lit(False)))


@query
def t7_modes(spark, sf_dir):
    """All three modes as one request table."""
    return _prompts(
        requests.build_requests(fx.segments(spark, sf_dir), fx.TARGET, modes=fixed.MODES)
    )


def _called(calls: requests.Calls) -> DataFrame:
    called = responses.translate(calls.requests, fx.rewriting_translator, fx.MODEL, calls.contexts)
    return called.select(
        "request_id", "mode", *DOCUMENT, "n_segments", digest("response").alias("response_md5"),
        "stop_reason", "has_usage", "prompt_tokens", "output_tokens", "thinking_tokens", "model",
    )


@query
def t8_translate(spark, sf_dir):
    return _called(requests.build_calls(fx.segments(spark, sf_dir), fx.TARGET))


@query
def t8_translate_blocks(spark, sf_dir):
    """Chunks of ten segments; in context mode the document comes first."""
    segments = fx.segments(spark, sf_dir)
    return _called(requests.build_calls(segments, fx.TARGET, style="blocks", size=10))


@query
def translate_only(spark, sf_dir):
    """Whole documents translated without a reference."""
    found = translate_segments(
        fx.segments(spark, sf_dir), fx.rewriting_translator, fx.MODEL, fx.TARGET, modes=["whole"]
    )
    return found.candidates.select(*SCORED, digest("text").alias("text_md5"))


@query
def t9_realign(spark, sf_dir):
    rows = responses.realign(responses.with_status(fx.response_log(spark, sf_dir)))
    return rows.select(*SCORED, digest("text").alias("text_md5"))


@query
def t10_status(spark, sf_dir):
    parsed = responses.with_status(fx.response_log(spark, sf_dir))
    return parsed.select("request_id", "status")


@query
def t10_failures(spark, sf_dir):
    return responses.failures(responses.with_status(fx.response_log(spark, sf_dir)))


# Metrics


@query
def m1_tok13a(spark, sf_dir):
    tokens = F.concat_ws(" ", tokens_13a(F.col("text")))
    rows = fx.segments(spark, sf_dir).withColumn("tokens", tokens)
    return rows.select(*SEGMENT, digest("tokens").alias("tokens_md5"))


@query
def m2_ngram_stats(spark, sf_dir):
    stats = metrics.segment_stats(fx.aligned(spark, sf_dir), chars=False)
    return metrics.long_stats(stats, "words", WORD_ORDER)


@query
def m3_bleu(spark, sf_dir):
    rows = metrics.corpus_scores(metrics.segment_stats(fx.aligned(spark, sf_dir), chars=False))
    return rows.select(*RUN, "n_segments", six("bleu"))


@query
def m3_bleu_by_document(spark, sf_dir):
    """Any grouping works: here every document is a corpus of its own."""
    stats = metrics.segment_stats(fx.aligned(spark, sf_dir), chars=False)
    rows = metrics.corpus_scores(stats, [*DOCUMENT, "mode"])
    return rows.select(*DOCUMENT, "mode", "n_segments", six("bleu"))


@query
def m4_signature(spark, sf_dir):
    modes = fx.candidates(spark, sf_dir).select(*RUN).distinct()
    return modes.select(*RUN, bleu_signature().alias("bleu_signature"))


@query
def m5_char_stats(spark, sf_dir):
    stats = metrics.segment_stats(fx.aligned(spark, sf_dir), words=False)
    return metrics.long_stats(stats, "chars", CHAR_ORDER)


@query
def m6_chrf(spark, sf_dir):
    rows = metrics.corpus_scores(metrics.segment_stats(fx.aligned(spark, sf_dir), words=False))
    return rows.select(*RUN, "n_segments", six("chrf"))


@query
def m7_segment_scores(spark, sf_dir):
    rows = metrics.score_segments(fx.aligned(spark, sf_dir), fx.length_ratio)
    return rows.select(*SCORED, six("score"))


@query
def m8_system_score(spark, sf_dir):
    rows = metrics.score_segments(fx.aligned(spark, sf_dir), fx.length_ratio)
    return metrics.system_scores(rows).select(*RUN, six("comet"))


def _record(spark, sf_dir) -> DataFrame:
    return metrics.score_record(metrics.corpus_scores(_stats(spark, sf_dir)))


@query
def m9_score_record(spark, sf_dir):
    return _record(spark, sf_dir)


@query
def m10_score(spark, sf_dir):
    """From three separate tables: check, align, score."""
    segments = fx.segments(spark, sf_dir)
    scored = score(segments, fx.candidates(spark, sf_dir), segments, fx.length_ratio)
    return scored.corpus.select(
        *RUN, "n_segments", six("bleu"), six("chrf"), "bleu_signature", six("comet")
    )


# Usage


def _costs(spark, sf_dir) -> DataFrame:
    counts = usage.usage_counts(fx.calls(spark, sf_dir))
    return usage.estimated_cost(counts, usage.price_table(spark))


@query
def u1_usage(spark, sf_dir):
    return usage.usage_counts(fx.calls(spark, sf_dir))


@query
def u2_total(spark, sf_dir):
    return usage.total_counts(usage.usage_counts(fx.calls(spark, sf_dir)))


@query
def u3_cost(spark, sf_dir):
    return _costs(spark, sf_dir).drop(*usage.PRICE_FIELDS)


@query
def u4_usage_report(spark, sf_dir):
    return usage.usage_total(_costs(spark, sf_dir))


@query
def u5_snapshot(spark, sf_dir):
    """The nested snapshot, taken apart again for comparison."""
    snapshot = usage.snapshots(_costs(spark, sf_dir))
    cost = "snapshot.estimated_cost"
    return snapshot.select(
        "run_id", "mode", F.col("snapshot.model").alias("model"),
        "snapshot.counts.*", f"{cost}.model_priced", f"{cost}.usd", f"{cost}.breakdown.*",
        *[F.col(f"{cost}.prices_used_per_1m_usd.{p}").alias(p) for p in usage.PRICE_FIELDS],
    )


@query
def u6_summary(spark, sf_dir):
    return usage.usage_summary(_costs(spark, sf_dir))


# Comparison and reports


@query
def r1_comparison(spark, sf_dir):
    return compare.comparison(metrics.corpus_scores(_stats(spark, sf_dir)))


@query
def r2_segment_delta(spark, sf_dir):
    scores = metrics.score_segments(fx.aligned(spark, sf_dir), fx.length_ratio)
    return compare.segment_deltas(scores)


@query
def r2_delta_counts(spark, sf_dir):
    scores = metrics.score_segments(fx.aligned(spark, sf_dir), fx.length_ratio)
    return compare.delta_counts(compare.segment_deltas(scores))


def _flat_report(report: DataFrame) -> DataFrame:
    columns = [
        F.col(f"{key}.{field}").alias(f"{key}_{field}")
        for key in ("sentence_level", "document_context")
        for field in compare.SCORE_FIELDS
    ]
    return report.select("run_id", "model", "segments", *columns)


def _with_segments(report: reports.Report) -> DataFrame:
    """The flat report with the number of segment scores of each mode and a sum over all of them and their places."""
    place = F.concat_ws("|", "doc_id", "seg_id", F.col("score").cast("decimal(10,4)").cast("string"))
    digest = F.conv(F.substring(F.md5(place), 1, 8), 16, 10).cast("bigint")
    sums = []
    for mode, key in (("sentence", "sentence_level"), ("context", "document_context")):
        own = F.when(F.col("mode") == mode, F.col("digest"))
        sums += [F.count(own).alias(f"{key}_scored"), F.sum(own).alias(f"{key}_digest")]
    segments = report.segments.withColumn("digest", digest).groupBy("run_id").agg(*sums)
    return _flat_report(report.summary).join(segments, "run_id", "left")


@query
def r3_report(spark, sf_dir):
    """The report with the scores of all segments, written and read back."""
    path = scratch(spark)
    stats = written(_stats(spark, sf_dir))
    record = metrics.score_record(metrics.corpus_scores(stats)).withColumn("model", F.lit(fx.MODEL))
    reports.write_report(record, stats.select(*SCORED, "score"), path)
    return _with_segments(reports.read_report(spark, path))


@query
def s5_report_text(spark, sf_dir):
    """The report of each run as one JSON text, put together from part files; read as the published file is."""
    path = scratch(spark)
    stats = written(_stats(spark, sf_dir))
    record = metrics.score_record(metrics.corpus_scores(stats)).withColumn("model", F.lit(fx.MODEL))
    # A document a run, so that positions are places in the array; every seventh segment has no score.
    order = F.row_number().over(Window.partitionBy(*RUN).orderBy(F.col("doc_id").cast("bigint"), "seg_id")) - 1
    scores = stats.select(*RUN, F.lit("").alias("doc_id"), order.cast("bigint").alias("seg_id"), "score").filter("seg_id % 7 <> 3")
    reports.write_report(record, scores, path)
    reports.write_report_text(reports.read_report(spark, path), f"{path}/text")
    read = records.read_report_files(spark, f"{path}/text/*", joined=True)
    one_part = read.withColumns({"part_id": F.lit(0).cast("bigint"), "doc_id": F.lit("")})
    rows = records.record_segments(one_part).join(read.select(*RUN, "model", "n_segments", "bleu", "chrf"), RUN)
    return rows.select(*RUN, "model", "n_segments", "bleu", "chrf", "seg_id", "score")


def _late_records(record: DataFrame) -> DataFrame:
    """Score records that came later: English has a value, French a null, German
    no such key, and Spanish has no record."""
    value = F.when(F.col("run_id") == "en", F.col("comet") - 0.1)
    return record.filter(F.col("run_id") != "es").select(
        *RUN, F.lit(0).cast("bigint").alias("part_id"), value.alias("comet"),
        (F.col("run_id") != "de").alias("has_comet"),
        (F.col("run_id") != "de").alias("has_comet_segments"),
    )


@query
def r4_merge(spark, sf_dir):
    record = written(_record(spark, sf_dir))
    return compare.merge_scores(record, _late_records(record))


@query
def r4_merge_segments(spark, sf_dir):
    """English segment scores are replaced by lower ones, French ones removed."""
    scores = metrics.score_segments(fx.aligned(spark, sf_dir), fx.length_ratio)
    late = _late_records(scores.groupBy(*RUN).agg(F.avg("score").alias("comet")))
    new = scores.filter(F.col("run_id") == "en").withColumn("score", F.col("score") - 0.1)
    rows = compare.merge_segment_scores(scores, late, new)
    return rows.select(*SCORED, six("score"))


@query
def r5_refresh(spark, sf_dir):
    """Comparison after the merge: from rounded scores, with missing ones."""
    record = written(_record(spark, sf_dir))
    merged = compare.merge_scores(record, _late_records(record))
    return compare.refresh(merged)[1]


@query
def r5_merge_files(spark, sf_dir):
    """Published files of each run, later records of English and French: merged into the report, twice."""
    path = scratch(spark)
    scores = written(metrics.score_segments(fx.aligned(spark, sf_dir), fx.length_ratio))
    fx.write_published(written(_record(spark, sf_dir)), scores, path)
    merge_files(spark, path, f"{path}-report")
    merged = merge_files(spark, path, f"{path}-report")
    return _with_segments(merged.report).withColumn("commit", F.lit(merged.report.commit))


@query
def r5_refreshed_report(spark, sf_dir):
    """Every run has scores of whole mode, too."""
    record = written(_record(spark, sf_dir))
    merged = compare.merge_scores(record, _late_records(record))
    whole = merged.filter("mode = 'context'").withColumn("mode", F.lit("whole"))
    return _flat_report(compare.refresh(merged.unionByName(whole))[0])


@query
def r6_experiment(spark, sf_dir):
    """Requests, calls, realignment, scores and cost of both modes."""
    segments = fx.segments(spark, sf_dir)
    result = run_experiment(
        segments, segments, fx.rewriting_translator, fx.MODEL, fx.TARGET, scorer=fx.length_ratio
    )
    costs = result.costs.select(
        *RUN, "calls", "prompt_tokens", "output_tokens", "thinking_tokens", "usd"
    )
    return result.scored.corpus.join(costs, RUN).select(
        *RUN, "n_segments", six("bleu"), six("chrf"), six("comet"),
        "calls", "prompt_tokens", "output_tokens", "thinking_tokens", "usd",
    )


@query
def r6_written(spark, sf_dir):
    """All modes, whole documents too, written below one folder; candidates, records and report as read back from it."""
    segments, path = fx.segments(spark, sf_dir), scratch(spark)
    run_experiment(
        segments, segments, fx.rewriting_translator, fx.MODEL, fx.TARGET, modes=fixed.MODES, scorer=fx.length_ratio, out_dir=path
    )
    candidates = reduce(
        DataFrame.union,
        [read_segment_table(spark, f"{path}/candidate.{mode}").withColumn("mode", F.lit(mode)) for mode in fixed.MODES],
    )
    found = records.read_score_records(spark, f"{path}/scores")
    of_run = found.groupBy(*RUN).agg(*[F.max(c).alias(c) for c in ("bleu", "chrf", "comet")])
    report = reports.read_report(spark, f"{path}/report")
    labels = report.scores.select(*RUN, "model", "n_segments")
    reported = report.segments.withColumnRenamed("score", "reported")
    return (
        candidates.join(records.record_segments(found), SCORED).join(reported, SCORED)
        .join(of_run, RUN).join(labels, RUN)
        .select(*SCORED, digest("text").alias("text_md5"), "score", "reported", "bleu", "chrf", "comet", "model", "n_segments")
    )
