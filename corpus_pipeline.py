"""Training-data pipeline: documents in, token records out. Each stage works on all that the one before kept."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from corpusgraph.functions.tables import written
from corpusgraph.llm import labelled, minhash, mixing, records, settings, templates, toxicity
from corpusgraph.llm.registry import ready


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below the cut."""
    ready(spark)
    plain, restored = labelled.shielded(docs, ["doc_id", "text"])
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.train(plain, labels.where(labelled.fold("doc_id", 5) != 0))
    return restored(toxicity.scored(plain, model).where(F.col("score") < toxicity.CUT))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class."""
    ready(spark)
    return minhash.deduplicated(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark items."""
    ready(spark)
    return templates.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled to the target mix."""
    ready(spark)
    plain, restored = labelled.shielded(docs, ["doc_id", "text", "source", "lang"])
    return restored(mixing.mixed(plain, mixing.labelled(plain), settings.MIX, settings.KEEP).where("kept"))


def write_records(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token records; the result is read back from the files."""
    ready(spark)
    return records.read(written(records.write(docs, settings.word_bpe()), "index"))


STAGES = [("toxicity", drop_toxic), ("minhash", drop_near_duplicates), ("decontamination", drop_leaks),
          ("mixing", mix), ("records", write_records)]

#: The stages are models, hashes and files; they are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
