"""The registered queries of this subpackage: thin digests of what the operators return."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orderboard.llm import (
    exact_dedup,
    html_text,
    jaccard_join,
    line_dedup,
    mixing,
    packing,
    periodic_runs,
    phrase_stripes,
    record_files,
    sampling_fingerprint,
    toxicity,
    url_reputation,
    warc_archives,
)
from orderboard.llm.tables import SPACE, read_table
from orderboard.scratch import shared_folder


def op1_html_main_text(spark: SparkSession, folder: str) -> DataFrame:
    found = html_text.extract(read_table(spark, folder, "pages"))
    return found.select("row.page_id", "row.url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op2_packing(spark: SparkSession, folder: str) -> DataFrame:
    pieces = packing.pack(read_table(spark, folder, "documents"))
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op3_source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mixing.with_copies(read_table(spark, folder, "documents"))
    taken = (F.col("size") * F.col("copies")).alias("taken")
    return mixed.select("row.doc_id", "size", "source_size", "target", taken)


def op4_token_records(spark: SparkSession, folder: str) -> DataFrame:
    out = shared_folder(spark, "token-records")
    record_files.write_records(read_table(spark, folder, "documents"), out)
    index = record_files.read_index(spark, out)
    read = record_files.read_records(record_files.in_file_order(index), out)
    before = record_files.file_starts(index)
    return read.join(before, F.col("part") == F.col("of_part")).select(
        "doc_id", (F.col("before") + F.col("first")).alias("start"), "n_tokens", F.crc32("ids").alias("ids_crc32")
    )


def op5_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = exact_dedup.memberships(read_table(spark, folder, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op6_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    left = line_dedup.drop_repeated_lines(read_table(spark, folder, "documents"))
    return left.select("row.doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op7_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = read_table(spark, folder, "documents"), read_table(spark, folder, "labels")
    model = toxicity.train(docs, labels.filter(~held_out()))
    scored = toxicity.score_documents(docs.select("doc_id", "text"), model)
    return scored.select(
        "row.doc_id",
        held_out("row.doc_id").alias("held_out"),
        "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
    )


def op8_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    found = jaccard_join.memberships(read_table(spark, folder, "documents"))
    return found.select("doc_id", "n_shingles", "component_id")


def op9_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return sampling_fingerprint.fingerprint_edits(read_table(spark, folder, "documents"))


def op10_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    judged = url_reputation.judge_urls(read_table(spark, folder, "pages").select("page_id", "url"))
    return judged.select("row.page_id", "host", "path", "rule", "verdict")


def with_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, text): every tenth document by crc32 repeats some of its words to the end."""
    mark = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    chosen = docs.select("doc_id", "text", mark.alias("mark"), F.floor(mark / 10).alias("g")).withColumn(
        "words", F.when(F.col("mark") % 10 == 0, F.array_remove(F.split("text", f"{SPACE}+"), ""))
    )
    placed = chosen.withColumn("n", F.size("words")).withColumn("a", F.expr("CASE WHEN n > 0 THEN g % n END"))
    sized = placed.withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    repeated = F.expr(
        "array_join(concat(slice(words, 1, int(a)), slice(flatten(array_repeat("
        "slice(words, int(a + 1), int(p)), int((n - a) div p + 1))), 1, int(n - a))), ' ')"
    )
    return sized.select("doc_id", F.when(F.col("a").isNotNull(), repeated).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    found = periodic_runs.find_runs(with_repeats(read_table(spark, folder, "documents")))
    longest = F.array_max(
        F.transform("runs", lambda r: F.struct(r.length.alias("length"), (-r.start).alias("s"), (-r.period).alias("p")))
    )
    lines = F.transform("runs", lambda r: F.concat_ws(",", r.start, r.length, r.period))
    joined = F.when(F.size("runs") > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise(F.lit(""))
    digested = found.select("row.doc_id", "runs", longest.alias("best"), joined.alias("lines"), "collapsed")
    return digested.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.s")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.p")).alias("period"),
        F.expr("1000 * best.length div -best.p").alias("exponent_milli"),
        F.sha2("lines", 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_warc_archives(spark: SparkSession, folder: str) -> DataFrame:
    out = shared_folder(spark, "warc")
    warc_archives.write_archives(read_table(spark, folder, "pages"), out)
    read = warc_archives.read_archives(spark, out, payloads=False)
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op13_phrase_stripes(spark: SparkSession, folder: str) -> DataFrame:
    return phrase_stripes.mine(read_table(spark, folder, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_html_main_text,
        op2_packing,
        op3_source_mixing,
        op4_token_records,
        op5_exact_dedup,
        op6_line_dedup,
        op7_toxicity,
        op8_jaccard_join,
        op9_fingerprints,
        op10_url_filter,
        op11_periodic_runs,
        op12_warc_archives,
        op13_phrase_stripes,
    )
}
