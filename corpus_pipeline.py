"""From raw documents to packed batches: five stages, each an operator of ``tidemark.llm``.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame. :func:`run` writes each result as Parquet in the shared
folder and reads it back as the next stage's documents. All stages but the last return the columns of the documents, also
those that the stage does not know, whatever their names; helpers take names that are free.

In every stage a null text counts as an empty one, very long texts are taken whole, and an empty table gives an empty one.
What else a stage does with texts without words, ties and repeated rows is in its docstring.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import common, mixing, ngram_join, packing, pii, toxicity
from tidemark.llm.tokens import n_tokens


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose words are scored at one half or more go.

    Those without words (null and empty texts) stay, as do all where the labels have one class only. A score of exactly one
    half goes. Repeated rows have one score and stay or go together; a document labelled twice is toxic if either label is.
    """
    score = common.free_name(docs, "score")
    judged = common.free_name(docs, "judged", score)
    model = toxicity.train(docs, common.table(spark, sf_dir, "labels"))
    return model.score(docs, out=score, judged=judged).where(~F.col(judged) | (F.col(score) < 0.5)).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies (five words, Jaccard 0.8 or more) the document with the least id stays.

    Null and empty texts are copies of each other, so one of them stays. Rows without an id stay only if their class has no
    other. Of rows that share the least id the one with the least text hash stays, then the one with the least hash of all
    columns; of repeated rows one is left.
    """
    return ngram_join.drop_near_copies(docs)


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans are replaced by their kind, and n_chars is that of the new text; no document goes.

    A null text stays null and has 0 characters. Spans that overlap are replaced together. Repeated rows stay and are alike.
    """
    spans = common.free_name(docs, "spans")
    masked = common.free_name(docs, "masked", spans)
    done = pii.redact(pii.find_pii(docs, out=spans), "text", spans, masked)
    return done.withColumns({"text": F.col(masked), "n_chars": F.coalesce(F.char_length(masked), F.lit(0)).cast("long")}).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: every document at least once, those of small sources again.

    A null source is a source of its own; null and empty texts weigh one token. Each of several repeated rows is read as often
    as the mixture asks for. Rows are ranged and sorted by block and place, so the files written of them hold the blocks in order.
    """
    names: list[str] = []
    for x in ("epoch", "block", "place"):
        names.append(common.free_name(docs, x, *names))
    plan, _ = mixing.mix(docs, n_tokens())
    rows = mixing.mixed_rows(docs, plan, *names)
    return rows.repartitionByRange(*names[1:]).sortWithinPartitions(*names[1:]).select(*docs.columns)


def pack_batches(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each row goes: doc_id, lang, source, n_tokens (with the end id), its length bucket, batch and slot.

    Null and empty texts have the end id alone. Repeated rows have a slot each. Buckets are filled in the order of the
    table's files and of the rows in each, which is that of the mix; rows that do not come from files are filled in by a hash.
    """
    columns = ["doc_id", "lang", "source", (n_tokens() + 1).alias("n_tokens")]
    try:
        name = F.col("_metadata.file_name")
        sized = docs.select(*columns, F.regexp_extract(name, r"^part-(\d+)", 1).try_cast("long").alias("_part"), name.alias("_file"), F.col("_metadata.row_index").alias("_row"))
        sized.schema  # resolves the columns of the files
    except AnalysisException:
        return packing.pack(common.pin(docs.select(*columns), "pack-lengths"), "n_tokens", ["doc_id"])
    packed = packing.pack(common.pin(sized, "pack-lengths"), "n_tokens", ["doc_id"], place=["_part", "_file", "_row"])
    return packed.drop("_part", "_file", "_row")


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_join", drop_near_copies),
    ("pii", redact_pii),
    ("mixing", mix_sources),
    ("packing", pack_batches),
]

#: Trained models, sketches and tokenizers cannot be stated in SQL; the tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with common.temporary(spark) as scope:  # what a stage pinned goes, and then its input, once its result is written
            made = scope.keep(common.pin(stage(spark, docs, sf_dir), f"stage-{name}"))
        common.unpin(docs)
        docs = made
    return STAGES[-1][1](spark, docs, sf_dir)
