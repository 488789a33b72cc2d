"""The operators' queries on the test tables. Each reads its whole tables below ``sf_dir``."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm import (
    alignment,
    byte_bpe,
    chat_format,
    chosen_path,
    decontamination,
    langid,
    line_dedup,
    prefix_counts,
    repair,
    rp_forest,
    token_files,
    toxicity,
    url_lists,
)
from tracelake.llm.shared import fold, fold_groups, table, written

Query = Callable[[SparkSession, str], DataFrame]

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
TOKEN_LIMIT = 512
ORDER_KEY = 20_240_601
# A conversation that holds marks of common templates.
MARKS = (-7, "\\### Assistant: </turn> ok")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document; three folds of four are learnt from."""
    docs = table(spark, sf_dir, "documents")
    part = fold(F.col("doc_id"), 4)
    model = langid.fit(docs.where(part != 2), "text", "lang", ["doc_id", "text"])
    found = langid.predict(docs.select("doc_id", "text"), model)
    held_out = F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


def digests(tokens: DataFrame) -> DataFrame:
    """Token number and digest of ``token_ids``."""
    joined = F.array_join(F.col("token_ids").cast("array<string>"), ",")
    return tokens.withColumns(
        {"n_tokens": F.size("token_ids").cast("long"), "ids_sha256": F.sha2(joined.cast("binary"), 256)}
    )


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again."""
    tokens = byte_bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), RANKS).drop("text")
    decoded = byte_bpe.decode(digests(tokens), RANKS)
    return decoded.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sequences of all documents in training order, read back from their shards."""
    folder = token_files.shard_folder(spark)
    token_files.write_shards(table(spark, sf_dir, "documents"), RANKS, folder, ORDER_KEY)
    records = token_files.read_from(spark, folder)
    return records.select(
        "slot", "shard", F.col("doc").alias("doc_id"), "sequence", "n_tokens", F.sha2("record", 256).alias("record_sha256")
    )


def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors of every hundredth one."""
    return rp_forest.nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)


def op5_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each test item that a document repeats."""
    return decontamination.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tokens of every document, and how much of it fits into the limit."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = prefix_counts.count_tokens(docs, TOKENIZER, TOKEN_LIMIT)
    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes")
    over = (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit")
    return counted.select("doc_id", n_bytes, "n_tokens", over, "fitting_chars")


def captures(pages: DataFrame) -> DataFrame:
    """The pages as captures: fetched at minutes of a year that their ids name."""
    return pages.select("page_id", "url", _at(F.col("page_id") * 7919 % 525_600).alias("fetched_at"))


def _at(minutes: Column) -> Column:
    return F.timestamp_seconds(F.lit(1_704_067_200) + minutes * 60)


def list_changes(pages: DataFrame) -> DataFrame:
    """Dated changes of four lists, made from the pages' own URLs: hosts, parent domains, paths and single URLs."""
    at = F.regexp_extract("url", "^[a-z]+://([^/?#:]*)", 1)
    parent = F.regexp_extract("url", r"^[a-z]+://(?:[^/?#:]*\.)?([^/?#:.]+\.[^/?#:.]+)(?:[/?#:]|$)", 1)
    path = F.regexp_extract("url", "^[a-z]+://([^/?#:]*/[^/?#]+)", 1)
    named = pages.select("page_id", "url", at.alias("host"), parent.alias("parent"), path.alias("path"))

    def entries(column: str, kind: str, name: str, every: int, step: int) -> DataFrame:
        first = named.where(F.col(column) != "").groupBy(F.col(column).alias("pattern")).agg(F.min("page_id").alias("_m"))
        return first.where(F.col("_m") % every == 0).select(
            F.lit(name).alias("list_name"),
            F.lit(kind).alias("kind"),
            "pattern",
            F.explode(
                F.array(
                    # Listed, delisted sixty days later, and every other entry listed again after thirty more.
                    F.struct(F.lit(True).alias("listed"), (F.col("_m") * step % 400_000).alias("minute")),
                    F.struct(F.lit(False).alias("listed"), (F.col("_m") * step % 400_000 + 86_400).alias("minute")),
                    F.struct((F.col("_m") % 2 == 0).alias("listed"), (F.col("_m") * step % 400_000 + 129_600).alias("minute")),
                )
            ).alias("_c"),
        ).select("list_name", "kind", "pattern", F.col("_c.listed").alias("listed"), _at(F.col("_c.minute")).alias("at"))

    parts = [
        entries("host", "domain", "spam", 3, 31),
        entries("parent", "domain", "parked", 1, 17),
        entries("path", "path", "adult", 5, 53),
        entries("url", "url", "takedown", 11, 13),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page against the entries that held when it was fetched."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    found = url_lists.filter_captures(captures(pages), list_changes(pages), "page_id", "url", "fetched_at")
    return found.withColumn("since", F.unix_seconds("since"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every document; four folds of five of the labels are learnt from."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False))
    model = toxicity.fit(docs, labels.where(fold(F.col("doc_id"), 5) != 0))
    found = toxicity.score(docs.select("doc_id", "text"), model)
    predicted = (F.col("score") >= 0.5).cast("int").alias("predicted")
    return found.select("doc_id", held_out.alias("held_out"), "score", predicted)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that many documents hold."""
    found = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate component of every document."""
    found = chosen_path.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_shingles", "component_id", "kept")


class _Turns:
    """Digests of the turns of a conversation, and of what its loss masks cover."""

    def __init__(self) -> None:
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.formatted_chars = 0

    def add(self, role: str | None, text: str | None, trained: str | None, n_chars: int | None) -> None:
        """A turn, or an example: its reply alone."""
        if role is not None:
            self.n_turns += 1
            self.formatted_chars += n_chars
            self.turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
        if trained is not None:
            self.loss_chars += len(trained)
            self.loss.update(trained.encode("utf-8", "surrogatepass"))

    def result(self) -> tuple:
        return self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.formatted_chars


def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation formatted as training examples, written, and read back from them."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    marks = spark.createDataFrame([(MARKS[0], n, role, MARKS[1]) for n, role in enumerate(("user", "assistant"))], turns.schema)
    formatted = written(spark, chat_format.format_turns(turns.unionByName(marks)), "chat")
    made = written(spark, chat_format.examples(formatted), "chat-examples")
    # The turns come from the formatted text, and what is under the loss masks from the examples.
    read = chat_format.read_turns(formatted).drop("trained")
    replies = chat_format.read_examples(made).drop("context_chars")
    return fold_groups(
        read.unionByName(replies, allowMissingColumns=True),
        ["conv_id"],
        ["pos"],
        ["role", "text", "trained", "n_chars"],
        _Turns,
        "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long",
    )


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tokens of two tokenizers aligned in every document, with the counts of their linked ids."""
    return alignment.align(spark, table(spark, sf_dir, "documents").select("doc_id", "text"), TOKENIZER, PIECES)


def damaged(conversations: DataFrame) -> DataFrame:
    """Conversations with one row in five dropped, emptied, cut, repeated or given to the user, by a hash of its place."""
    conv, turn = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn"))
    kind = F.crc32(F.concat(conv, F.lit(":"), turn).cast("binary")) % 20
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    return (
        conversations.withColumn("_kind", kind)
        .where("_kind <> 0")
        .select(
            "conv_id",
            "turn",
            F.when(F.col("_kind") == 4, "user").otherwise(role).alias("role"),
            F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
            F.explode(F.when(F.col("_kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy"),
        )
        .drop("_copy")
    )


class _Lines:
    """The digest of rows as lines of role and text."""

    def __init__(self) -> None:
        self.digest, self.mark = hashlib.sha256(), ""

    def add(self, role: str, text: str) -> None:
        self.digest.update(f"{self.mark}{role}:{text}".encode("utf-8", "surrogatepass"))
        self.mark = "\n"

    def result(self) -> tuple:
        return (self.digest.hexdigest(),)


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The faults of every damaged conversation, and its repair at the least cost."""
    conversations = table(spark, sf_dir, "conversations")
    parsed, rows = repair.repair(spark, damaged(conversations))
    digests_of = fold_groups(rows, ["conv_id"], ["pos", "part"], ["role", "text"], _Lines, "repaired_sha256 string")
    found = parsed.select(F.col("conv_id").alias("_parsed"), *repair.COUNTS, "audit")
    lines = digests_of.select(F.col("conv_id").alias("_lines"), "repaired_sha256")
    every = conversations.select("conv_id").distinct()
    joined = every.join(found, F.col("conv_id").eqNullSafe(F.col("_parsed")), "left")
    joined = joined.join(lines, F.col("conv_id").eqNullSafe(F.col("_lines")), "left")
    return joined.select(
        "conv_id",
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in repair.COUNTS],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"),
    )


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_language_id,
        op2_byte_bpe,
        op3_training_order,
        op4_nearest,
        op5_benchmark_leaks,
        op6_token_counts,
        op7_url_filter,
        op8_toxicity,
        op9_line_dedup,
        op10_near_duplicates,
        op11_chat_format,
        op12_token_alignment,
        op13_conversation_repair,
    )
}
