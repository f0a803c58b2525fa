"""Registered queries: each operator over its whole table."""

from pyspark.sql import functions as F

from corpusgraph.functions.tables import written

from . import alignment, chat, labelled, licences, minhash, mixing, quality, records, resampling, settings, suffixes, templates, toxicity, urls, vectors
from .registry import QUERIES, TWINS, query


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_quality")
def op1(spark, sf_dir):
    """Quality score of every document; labels of fold 2 of 4 are held out."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = labelled.fold("doc_id", 4) == 2
    model = quality.train(docs, labels.where(~out))
    return quality.scored(docs.select("doc_id", "text"), model).select(
        "doc_id", F.coalesce(out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= quality.CUT).cast("int").alias("predicted"))


@query("op3_mixing")
def op3(spark, sf_dir):
    """Weight, probability and decision of every document."""
    docs = table(spark, sf_dir, "documents")
    return mixing.mixed(docs, mixing.described(docs), settings.MIX, settings.KEEP)


@query("op4_toxicity")
def op4(spark, sf_dir):
    """Toxicity score of every document; labels of fold 0 of 5 are held out."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = labelled.fold("doc_id", 5) == 0
    model = toxicity.train(docs, labels.where(~out))
    return toxicity.scored(docs.select("doc_id", "text"), model).select(
        "doc_id", F.coalesce(out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= toxicity.CUT).cast("int").alias("predicted"))


@query("op2_minhash_dedup")
def op2(spark, sf_dir):
    """One row per document: its near-duplicate class."""
    return minhash.classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "kept")


@query("op5_token_records")
def op5(spark, sf_dir):
    """Ids of every document, read back from the record files."""
    return records.read(written(records.write(table(spark, sf_dir, "documents").select("doc_id", "text"), settings.word_bpe()), "index"))


@query("op6_decontamination")
def op6(spark, sf_dir):
    """Documents that hold a benchmark item, also with other numbers or names."""
    return templates.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("row")


@query("op7_suffix_dedup")
def op7(spark, sf_dir):
    """Passages of 50 words or more that documents share."""
    return suffixes.repeated(table(spark, sf_dir, "documents"))


@query("op8_vector_dedup")
def op8(spark, sf_dir):
    """One row per vector: its links at cosine 0.9 and its component."""
    return vectors.linked(table(spark, sf_dir, "embeddings"))


RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
LISTED = ["ads-track.example.com", "adult-x.example.com", "casino-win.example.net", "cheap-pills.example.net",
          "free-bets.example.net", "spam-farm.example.org"]

URL_TWIN = f"""
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
named AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{urls._UPPER}', '{urls._LOWER}') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
ruled AS (
  SELECT *, CASE
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM named)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('example.com/de/', 'net/') THEN 'block'
    WHEN rule IS NOT NULL THEN 'allow'
    WHEN {" OR ".join(f"host = '{k}' OR ends_with(host, '.{k}')" for k in LISTED)} THEN 'block'
    ELSE 'allow' END AS verdict
FROM ruled"""


@query("op9_url_cascade", URL_TWIN)
def op9(spark, sf_dir):
    """Verdict of every page's url."""
    listed = spark.range(1).select(F.explode(F.array(*[F.lit(k) for k in LISTED])).alias("key"))
    return urls.judged(table(spark, sf_dir, "pages").select("page_id", "url"), RULES, listed).drop("url")


_SAY = "<|im_end|><|im_start|>assistant ok"

CHAT_TWIN = rf"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{_SAY}' UNION ALL SELECT -1, 1, 'assistant', '{_SAY}')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(role) + length(regexp_replace(text, '<(\\*)\|', '<\1+|', 'g')) + 24) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id"""


@query("op10_chat_format", CHAT_TWIN)
def op10(spark, sf_dir):
    """Digests of all formatted conversations, read back from what was written."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    one = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(_SAY).alias("text"))
    return chat.digests(written(chat.formatted(turns.unionByName(one)), "chats")).drop("error")


@query("op11_alignment")
def op11(spark, sf_dir):
    """Two tokenizers over every document: groups of tokens with common ends, links, and how usual their pairs are."""
    rows = written(alignment.aligned(table(spark, sf_dir, "documents"), settings.byte_bpe(), settings.piece_bpe()), "aligned")
    return alignment.digests(rows, alignment.pair_counts(rows))


@query("op12_licences")
def op12(spark, sf_dir):
    """Licence phrases, tags and expressions of every document."""
    return licences.summarised(licences.scanned(table(spark, sf_dir, "documents")))


RESAMPLING_TWIN = rf"""
WITH texts AS (
  SELECT true AS source, doc_id AS id, text FROM documents UNION ALL SELECT false, item_id, text FROM benchmark),
worded AS (
  SELECT source, id, regexp_extract_all(translate(coalesce(text, ''), '{urls._UPPER}', '{urls._LOWER}'),
                                        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM texts),
runs AS (
  SELECT source, id, unnest(list_concat(words, list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]))) AS run FROM worded),
bits AS (  -- eight steps for each byte of a run: the byte comes in before the first one
  SELECT run, xor(list_reduce(flatten(list_transform(range(1, strlen(run) + 1),
      lambda i: [CAST('0x' || hex(encode(run))[2 * i - 1:2 * i] AS BIGINT), 0, 0, 0, 0, 0, 0, 0])),
      lambda c, b: xor(xor(c, b) >> 1, 3988292384 * (xor(c, b) & 1)), 4294967295), 4294967295) % 10000 AS bucket
  FROM (SELECT DISTINCT run FROM runs)),
placed AS (SELECT source, id, bucket FROM runs JOIN bits USING (run)),
sums AS (
  SELECT bucket, count(*) FILTER (source) AS s, count(*) FILTER (NOT source) AS t FROM placed GROUP BY bucket),
totals AS (SELECT sum(s) + 10000.0::DOUBLE AS s, sum(t) + 10000.0::DOUBLE AS t FROM sums),
gains AS (
  SELECT bucket, CAST(floor(1000 * ln(((sums.t + 1.0::DOUBLE) * totals.s) / ((sums.s + 1.0::DOUBLE) * totals.t))) AS BIGINT) AS gain
  FROM sums, totals),
weights AS (
  SELECT id AS doc_id, count(*) AS n, CAST(sum(gain) AS BIGINT) AS total FROM placed JOIN gains USING (bucket) WHERE source GROUP BY id),
scored AS (
  SELECT id AS doc_id, len(words) AS n_words, coalesce(n, 0) AS n_features,
    coalesce(CAST((total - ((total % n) + n) % n) // n AS BIGINT), 0) AS weight,
    CAST(floor(-1000 * ln(-ln((CAST('0x' || sha256('7:' || CAST(id AS VARCHAR))[1:8] AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS noise
  FROM worded LEFT JOIN weights ON id = weights.doc_id WHERE source),
able AS (
  SELECT doc_id, row_number() OVER (ORDER BY weight + noise DESC, doc_id) AS rank, count(*) OVER () AS n FROM scored WHERE n_words >= 20)
SELECT scored.doc_id, n_words, n_features, weight, weight + noise AS score, CASE WHEN rank <= 25 * n // 100 THEN rank END AS rank
FROM scored LEFT JOIN able ON scored.doc_id = able.doc_id"""


@query("op13_resampling", RESAMPLING_TWIN)
def op13(spark, sf_dir):
    """A quarter of the documents, drawn like the benchmark's texts; every document's weight and score."""
    return resampling.drawn(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("pipeline")
def pipeline(spark, sf_dir):
    """The stages of ``corpus_pipeline`` one after the other."""
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return dict(QUERIES)


def twins() -> dict:
    return dict(TWINS)
