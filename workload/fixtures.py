"""Inputs of the queries: translation data derived from the driver's tables.

Whole tables and whole texts. The texts are invented, so a translation is a
deterministic rewrite of the text; scores exercise the operators, not quality.
"""

from __future__ import annotations

import hashlib
import json
import re
import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paraseg.fixed import DOCUMENT
from paraseg.operators.requests import chunk_segments
from paraseg.session import spread
from paraseg.sources.segments import split_documents

# Workers need no copy of this module.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

TARGET = "Canadian French"
MODEL = "gemini-3.6-flash"
REWRITES = {"sentence": "the|que", "context": "que"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``run_id`` is the language: a run of very uneven size."""
    rows = table(spark, sf_dir, "documents").select(
        F.col("lang").alias("run_id"), F.col("doc_id").cast("string").alias("doc_id"), "source", "text"
    )
    return spread(rows, *DOCUMENT)


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_documents(documents(spark, sf_dir)).select(*DOCUMENT, "seg_id", "text")


def spaced_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a blank line after every line, mixed line ends and blank lines at the end."""
    text = F.concat(F.replace("text", F.lit("\n"), F.lit("\r\n \n")), F.lit(" \n\n\t\n"))
    return documents(spark, sf_dir).select(*DOCUMENT, text.alias("text"))


def spaced_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_documents(spaced_documents(spark, sf_dir))


def rewritten(text: Column, mode: str) -> Column:
    return F.regexp_replace(text, REWRITES[mode], "di")


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both modes of every segment; context mode changes less of the text."""
    versions = F.array(
        *[
            F.struct(F.lit(mode).alias("mode"), rewritten(F.col("text"), mode).alias("text"))
            for mode in REWRITES
        ]
    )
    return segments(spark, sf_dir).select(*DOCUMENT, "seg_id", F.inline(versions))


def trimmed_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of a translator that returns nothing for segments with a digit."""
    return candidates(spark, sf_dir).filter(
        (F.col("mode") == "context") | ~F.col("text").rlike("[0-9]")
    )


def aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``align`` gives it, with the source as reference."""
    versions = F.array(
        *[
            F.struct(F.lit(mode).alias("mode"), rewritten(F.col("text"), mode).alias("cand"))
            for mode in REWRITES
        ]
    )
    text = F.col("text")
    return segments(spark, sf_dir).select(
        *DOCUMENT, "seg_id", text.alias("src"), text.alias("ref"), F.inline(versions)
    )


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn with the next one. Users' turns are padded, system turns blank,
    and last turns have no partner."""
    turns = table(spark, sf_dir, "conversations")
    after = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("ref"))
    src = (
        F.when(F.col("role") == "user", F.concat(F.lit(" "), F.col("text"), F.lit("  ")))
        .when(F.col("role") == "system", "   ")
        .otherwise(F.col("text"))
    )
    pair_id = F.col("conv_id") * 1000 + F.col("turn")
    return turns.join(after, ["conv_id", "turn"], "left").select(
        pair_id.alias("pair_id"), src.alias("src"), "ref"
    )


# Responses that are not as asked, by document number modulo 20.
BROKEN = {
    1: '{"translations":["x"]} trailing',
    2: '{"translations":["x"]}{"translations":["y"]}',
    3: "{'translations':['x']}",
    4: '{"translations":[1]}',
    5: '{"translations":[{"k":1}]}',
    6: '{"translations":[null]}',
    7: '{"translations":"x"}',
    # Characters beyond 16 bits, as they are and escaped, and repeated keys, of which the last counts.
    11: '{"translations":["\U0001F600 \\ud83d\\ude00"]}',
    12: '{"translations":["x"],"translations":["y"]}',
    13: '{"translations":["x"],"translations":[1]}',
}


def response_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses to context chunks, most fine, some refused, broken or short; and bare replies, some blank or missing."""
    chunks = chunk_segments(segments(spark, sf_dir))
    sources = documents(spark, sf_dir).select(*DOCUMENT, "source")
    texts = F.transform("texts", lambda t: rewritten(t, "context"))
    reply = F.to_json(F.struct(texts.alias("translations")))
    short = F.to_json(
        F.struct(F.slice(texts, 1, F.size("texts") - 1).alias("translations"))
    )
    number = F.col("doc_id").cast("bigint") % 20
    response = F.when(F.col("source") == "src1", "not json").when(F.col("source") == "src2", short)
    for k, text in BROKEN.items():
        response = response.when(number == k, text)
    stop = F.when(F.col("source") == "src0", "refusal").otherwise("end")
    logged = chunks.join(sources, DOCUMENT)
    first = F.col("texts")[0]
    bare = F.when(number == 8, " \t ").when(number == 9, "").when(number != 10, F.concat(F.lit("  "), first))

    def rows_of(frame: DataFrame, mode: str, n: Column, reply_kind: str, answer: Column) -> DataFrame:
        return frame.select(
            F.concat_ws("/", F.lit(mode), *DOCUMENT, "chunk_id").alias("request_id"),
            F.lit(mode).alias("mode"),
            *DOCUMENT,
            "first_seg",
            n.alias("n_segments"),
            F.lit(reply_kind).alias("reply"),
            F.lit("line" if reply_kind == "text" else None).cast("string").alias("preview"),
            answer.alias("response"),
            stop.alias("stop_reason"),
        )

    one = F.lit(1).cast("bigint")
    return rows_of(logged, "context", F.col("n_segments"), "json", response.otherwise(reply)).unionByName(
        rows_of(logged.filter("chunk_id = 0"), "sentence", one, "text", bare)
    )


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A call log with absent usage, absent fields and a model without a price."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("user-"), "user_id").alias("run_id"),
        F.when(kind.isin("view", "purchase"), "sentence").otherwise("context").alias("mode"),
        F.when((kind == "signup") & (k >= 90), "unpriced-model").otherwise(MODEL).alias("model"),
        (kind != "error").alias("has_usage"),
        F.floor(F.col("value") * 100).cast("bigint").alias("prompt_tokens"),
        F.when(kind != "view", F.floor(F.col("value") * 125)).cast("bigint").alias("cached_tokens"),
        k.alias("output_tokens"),
        F.when(kind == "click", k * 10).alias("thinking_tokens"),
    )


def write_published(record: DataFrame, scores: DataFrame, path: str) -> None:
    """Reports and later score records as single files of each run, as they are published.

    A run's segment scores are one array there, by document and position. English has a later record of both modes with
    lower scores, French one of context mode without a model score, German one without such keys, Spanish none.
    """
    spark = record.sparkSession
    place = F.struct(F.col("doc_id").cast("bigint").alias("d"), "seg_id", F.round("score", 4).alias("score"))
    arrays = scores.groupBy("run_id", "mode").agg(F.sort_array(F.collect_list(place))["score"].alias("comet_segments"))
    rows = record.join(arrays, ["run_id", "mode"])
    fields = ["bleu", "chrf", "bleu_signature", "comet", "comet_segments"]
    of = lambda mode: F.max_by(F.struct(*fields), F.col("mode") == mode)
    report = F.struct(F.lit(MODEL).alias("model"), F.max("n_segments").alias("segments"), of("sentence").alias("sentence_level"), of("context").alias("document_context"))
    files = rows.groupBy("run_id").agg(F.to_json(report).alias("text")).select("run_id", F.lit("report.json").alias("file"), "text")
    lower = F.struct("bleu", "chrf", (F.col("comet") - 0.1).alias("comet"), F.transform("comet_segments", lambda x: F.round(x - 0.1, 4)).alias("comet_segments"))
    none = F.struct("bleu", F.lit(None).cast("double").alias("comet"), F.array().cast("array<double>").alias("comet_segments"))
    text = (
        F.when(F.col("run_id") == "en", F.to_json(lower))
        .when((F.col("run_id") == "fr") & (F.col("mode") == "context"), F.to_json(none, {"ignoreNullFields": "false"}))
        .when(F.col("run_id") == "de", F.to_json(F.struct("bleu", "chrf")))
    )
    later = rows.select("run_id", F.format_string("score.candidate.%s.json", "mode").alias("file"), text.alias("text")).filter("text is not null")
    files.unionByName(later).repartition("run_id", "file").write.partitionBy("run_id", "file").text(f"{path}-parts")
    # A part file of each run and name moves to its published place: a few names a run.
    space = spark.sparkContext._jvm.org.apache.hadoop.fs
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for row in files.unionByName(later).select("run_id", "file").collect():
        folder = space.Path(f"{path}/{row['run_id']}")
        system = folder.getFileSystem(conf)
        system.mkdirs(folder)
        [part] = [f.getPath() for f in system.globStatus(space.Path(f"{path}-parts/run_id={row['run_id']}/file={row['file']}/part-*"))]
        system.rename(part, space.Path(folder, row["file"]))


def length_ratio(batch: pd.DataFrame) -> pd.Series:
    """Stand-in for a model score: shorter over longer text, 1 when equally long."""
    mt, ref = batch["mt"].str.len(), batch["ref"].str.len()
    longer = pd.concat([mt, ref], axis=1).max(axis=1)
    shorter = pd.concat([mt, ref], axis=1).min(axis=1)
    return (shorter / longer).fillna(1.0)


def rewriting_translator(batch: pd.DataFrame) -> pd.DataFrame:
    """Stand-in for an engine: rewrites the segments it finds in the prompt.

    A JSON reply names the digest of all text it was sent, document included; so
    do the thinking tokens.
    """
    rewrites = {"sentence": "the|que", "context": "que", "whole": "que"}

    def answer(sent: str, mode: str, reply: str) -> str:
        if reply == "text":
            text = sent.split("~~~~\n", 1)[1].rsplit("\n~~~~", 1)[0]
            return re.sub(rewrites[mode], "di", text)
        listed = sent.rsplit("\n\n1. ", 1)[1].split("\n")
        texts = [listed[0], *(line.split(". ", 1)[1] for line in listed[1:])]
        translations = [re.sub(rewrites[mode], "di", text) for text in texts]
        reply = {"sent": digest(sent), "translations": translations}
        return json.dumps(reply, ensure_ascii=False, separators=(",", ":"))

    def digest(text: str) -> str:
        return hashlib.md5(text.encode()).hexdigest()

    sent = [(c or "") + p for c, p in zip(batch["context"], batch["prompt"])]
    responses = [answer(s, m, r) for s, m, r in zip(sent, batch["mode"], batch["reply"])]
    return pd.DataFrame(
        {
            "response": responses,
            "stop_reason": "end",
            "has_usage": True,
            "prompt_tokens": [len(s) for s in sent],
            "output_tokens": [len(r) for r in responses],
            "thinking_tokens": [int(digest(s)[:4], 16) for s in sent],
        }
    )
