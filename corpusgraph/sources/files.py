"""File scans: read a tree, drop what is ignored, name the language, fingerprint."""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import paths
from ..functions.text import lit_array, lookup
from ..rules import scan


def read_tree(spark: SparkSession, root: str, repo_id: str = "", max_kb: int = None) -> DataFrame:
    """All files below ``root``; a size limit, if given, is pushed into the file listing."""
    base = "file:" + root.rstrip("/") + "/" if root.startswith("/") else root.rstrip("/") + "/"
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return (
        within_size(raw, max_kb)
        .select(
            F.lit(repo_id).alias("repo_id"),
            F.regexp_replace("path", r"\A[a-z0-9]+:/+", "/").alias("_full"),
            "length",
            F.col("modificationTime").alias("mtime"),
            decoded(F.col("content")).alias("content"),
        )
        .withColumn("path", F.expr(f"substring(_full, {len('/' + base.split(':', 1)[-1].lstrip('/')) + 1})"))
        .drop("_full")
    )


def decoded(content) -> Column:
    """Text of raw bytes: invalid bytes dropped, line ends turned into one form."""
    text = content.cast("string")
    valid = F.when(F.is_valid_utf8(text), text).otherwise(
        F.translate(F.make_valid_utf8(text), "�", ""))
    return F.regexp_replace(valid, r"\r\n?", "\n")


def ignored(path) -> Column:
    """Fixed ignore rules, applied to every component of the path."""
    comps = paths.parts(path)
    lower_comps = paths.parts(F.lower(path))
    ends = "(?:" + "|".join(e.replace(".", r"\.") for e in scan.IGNORED_ENDINGS) + r")\z"
    return (
        F.arrays_overlap(comps, lit_array(scan.IGNORED_NAMES))
        | F.exists(lower_comps, lambda c: F.rlike(c, F.lit(ends)))
        | F.exists(F.slice(comps, 1, F.greatest(F.size(comps) - 1, F.lit(0))), lambda c: F.startswith(c, F.lit(".")))
    )


def language_of(path) -> Column:
    """Language by file name, then by name ending; null when unknown."""
    return F.coalesce(lookup(scan.LANGUAGE_NAMES, F.lower(paths.file_name(path))),
                      lookup(scan.ENDING_LANGUAGE, paths.ending(path)))


def within_size(files: DataFrame, max_kb: int = None) -> DataFrame:
    """Files up to ``max_kb`` kilobytes; all files without a limit."""
    return files if max_kb is None else files.where(F.col("length") <= max_kb * 1024)


def with_language(files: DataFrame) -> DataFrame:
    """Known languages only."""
    return files.withColumn("language", language_of(F.col("path"))).where(F.col("language").isNotNull())


def glob_regex(glob) -> Column:
    """Shell glob as an anchored regular expression; ``*`` crosses ``/``."""
    quoted = F.regexp_replace(glob, r"([.^$+{}()|\\])", r"\\$1")
    any_text = F.replace(F.replace(quoted, F.lit("*"), F.lit(".*")), F.lit("?"), F.lit("."))
    negated = F.replace(any_text, F.lit("[!"), F.lit("[^"))
    # A "[" without a closing bracket is a plain character.
    closed = F.when(F.contains(negated, F.lit("]")), negated).otherwise(F.replace(negated, F.lit("["), F.lit(r"\[")))
    return F.concat(F.lit("(?:"), closed, F.lit(")"))


def ignore_lines(ignore_files: DataFrame) -> DataFrame:
    """Globs of root ignore files ``(repo_id, content)``: blank and ``#`` lines skipped."""
    line = F.explode(F.split("content", "\n"))
    return (
        ignore_files.select("repo_id", line.alias("glob"))
        .withColumn("glob", F.trim(F.translate("glob", "\t\r", "  ")))
        .where((F.col("glob") != "") & ~F.startswith("glob", F.lit("#")))
    )


def drop_globbed(files: DataFrame, globs: DataFrame) -> DataFrame:
    """Remove files of which the path, a parent, or any name in it matches a glob.

    Globs of one repository come from one ignore file, so they fold into one pattern
    per repository; the file side is then joined N:1 and tested once per row.
    """
    clean = globs.where(F.col("glob") != "").distinct()
    name_form = F.when(F.endswith("glob", F.lit("/")), F.regexp_replace("glob", r"/+\z", ""))
    folded = clean.groupBy("repo_id").agg(
        F.concat(F.lit(r"(?s)\A(?:"), F.array_join(F.array_sort(F.collect_set(glob_regex(F.col("glob")))), "|"),
                 F.lit(r")\z")).alias("_rel"),
        F.concat(F.lit(r"(?s)\A(?:"),
                 F.array_join(F.array_sort(F.array_union(
                     F.collect_set(glob_regex(F.col("glob"))),
                     F.collect_set(glob_regex(name_form)))), "|"),
                 F.lit(r")\z")).alias("_name"),
    )
    comps = paths.parts(F.col("path"))
    prefixes = F.transform(F.sequence(F.lit(1), F.size(comps)), lambda n: F.array_join(F.slice(comps, 1, n), "/"))
    hit = F.exists(comps, lambda c: F.rlike(c, F.col("_name"))) | F.exists(prefixes, lambda p: F.rlike(p, F.col("_rel")))
    return (
        files.join(folded, "repo_id", "left")
        .where(F.col("_rel").isNull() | ~hit)
        .drop("_rel", "_name")
    )


def scan_files(files: DataFrame, globs: DataFrame = None, max_kb: int = None) -> DataFrame:
    """The whole scan: cheap path tests first, content is only carried through."""
    kept = within_size(files, max_kb).where(~ignored(F.col("path")))
    if globs is not None:
        kept = drop_globbed(kept, globs)
    return with_language(kept).withColumn("file_name", paths.file_name(F.col("path")))


def fingerprints(files: DataFrame) -> DataFrame:
    """``size:mtime`` per path; reads no content."""
    return files.select(
        "repo_id", "path",
        F.concat_ws(":", F.col("length").cast("string"),
                    F.unix_seconds(F.col("mtime").cast("timestamp")).cast("string")).alias("fp"))


def changed_paths(changes: DataFrame, ref: str = None) -> DataFrame:
    """Distinct changed paths: staged and unstaged rows, or rows since ``ref``."""
    picked = changes.where(F.col("ref") == ref) if ref else changes.where(F.col("kind").isin("staged", "unstaged"))
    return (
        picked.select("repo_id", F.trim("path").alias("path"))
        .where(F.col("path") != "")
        .distinct()
    )


def source_lines(ranges: DataFrame, files: DataFrame) -> DataFrame:
    """Numbered source lines of ``(repo_id, id, path, line_start, line_end)`` ranges."""
    text = files.select("repo_id", "path", "content")
    lines = F.split("content", "\n")
    cut = F.slice(lines, F.col("line_start"), F.greatest(F.least(F.col("line_end"), F.size(lines)) - F.col("line_start") + 1, F.lit(0)))
    return (
        ranges.where(F.col("line_start") > 0)
        .join(text, ["repo_id", "path"])
        .select("repo_id", "id", "line_start", F.posexplode(cut).alias("_i", "text"))
        .select("repo_id", "id", (F.col("line_start") + F.col("_i")).alias("line"), "text")
    )


def manifests(files: DataFrame, names: list, skipped: list) -> DataFrame:
    """Manifest files at the root or one directory below it, with their directory."""
    comps = paths.parts(F.col("path"))
    folder = F.when(F.size(comps) == 1, F.lit("")).otherwise(F.element_at(comps, 1))
    return (
        files.where(paths.file_name(F.col("path")).isin(names) & (F.size(comps) <= 2))
        .withColumn("folder", folder)
        .where((F.col("folder") == "") | (~F.startswith("folder", F.lit(".")) & ~F.col("folder").isin(skipped)))
        .withColumn("file_name", paths.file_name(F.col("path")))
    )
