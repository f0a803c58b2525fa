"""Complexity scoring: one projection over (lines, source, language)."""

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as tx
from ..rules import complexity as cx


def branches(source, language, rules=cx.DEFAULT_RULES) -> Column:
    fallback = rules.branches.get("python", cx.BRANCHES["python"])

    def count(pattern):
        return tx.count_of(source, cx.PYTHON_BRANCH_JVM if pattern == cx.BRANCHES["python"] else pattern)

    col = None
    for lang, pattern in rules.branches.items():
        col = F.when(language == lang, count(pattern)) if col is None else col.when(language == lang, count(pattern))
    return col.otherwise(count(fallback))


def nesting(source, language) -> Column:
    indents = F.transform(tx.all_of(source, r"(?m)^( +)\S", 1), lambda s: F.length(s))
    deepest = F.coalesce(F.array_max(indents), F.lit(0))
    by_indent = None
    for lang, width in cx.INDENT_LANGUAGES.items():
        value = F.floor(deepest / F.lit(width)).cast("int")
        by_indent = F.when(language == lang, value) if by_indent is None else by_indent.when(language == lang, value)
    marks = F.split(F.regexp_replace(source, r"[^{}]", ""), "")
    walked = F.aggregate(
        marks,
        F.struct(F.lit(0).alias("depth"), F.lit(0).alias("deepest")),
        lambda acc, ch: F.when(ch == "{", F.struct((acc["depth"] + 1).alias("depth"),
                                                   F.greatest(acc["deepest"], acc["depth"] + 1).alias("deepest")))
        .when(ch == "}", F.struct(F.greatest(acc["depth"] - 1, F.lit(0)).alias("depth"), acc["deepest"].alias("deepest")))
        .otherwise(acc))
    return by_indent.otherwise(walked["deepest"])


def nesting_term(depth) -> Column:
    return F.pow(depth.cast("double"), F.lit(cx.NESTING_POWER))


def size_term(lines) -> Column:
    return F.log2(F.greatest(lines, F.lit(1)).cast("double")) * cx.SIZE_WEIGHT


def recursion_term(source) -> Column:
    names = F.array_distinct(tx.all_of(source, cx.DEFINED_NAME, 1))

    def again(name):
        rest = F.substr(source, F.instr(source, name) + F.length(name))
        return F.rlike(rest, F.concat(F.lit(tx.rx(r"\b")), name, F.lit(r"\s*\(")))

    return F.when(F.exists(names, again), F.lit(cx.RECURSION)).otherwise(F.lit(0.0))


def callback_term(source, language) -> Column:
    extra = F.greatest(tx.count_of(source, cx.CALLBACK) - cx.FREE_CALLBACKS, F.lit(0))
    return F.when(language.isin("javascript", "typescript"), extra * F.lit(cx.CALLBACK_WEIGHT)).otherwise(F.lit(0.0))


def ternary_term(source) -> Column:
    return tx.count_of(source, cx.TERNARY) * F.lit(cx.TERNARY_WEIGHT)


def hinted(source, fw: str, rules=cx.DEFAULT_RULES, lower=None) -> Column:
    """Does the framework's hint match? A plain word search spares most texts the pattern.
    ``lower`` is a column that holds the lower-case text; without it, it is computed for each word."""
    test = tx.has(source, rules.hints[fw], "i")
    if rules.hints[fw] != cx.HINTS.get(fw):
        return test
    lower = F.lower(source) if lower is None else lower
    words = [F.contains(lower, F.lit(w)) for w in cx.HINT_WORDS[fw]]
    gate = words[0]
    for w in words[1:]:
        gate = gate | w
    return gate & test


def frameworks(source, rules=cx.DEFAULT_RULES) -> Column:
    """Names of the frameworks hinted at."""
    return F.array_compact(F.array(*[F.when(hinted(source, fw, rules), F.lit(fw)) for fw in rules.hints]))


def framework_term(source, rules=cx.DEFAULT_RULES, lower=None) -> Column:
    """Weighted rule hits; the rules of a framework run only where its hint does."""
    total = F.lit(0.0)
    for fw in rules.hints:
        hits = sum((tx.count_of(source, p) * F.lit(float(w)) for p, w in rules.frameworks.get(fw, [])), F.lit(0.0))
        total = total + F.when(hinted(source, fw, rules, lower), hits).otherwise(F.lit(0.0))
    return total


def max_params(source, language) -> Column:
    def widest(pattern):
        sizes = F.transform(tx.all_of(source, pattern, 1), lambda sig: F.size(F.filter(F.split(sig, ","), tx.nonblank)))
        return F.coalesce(F.array_max(sizes), F.lit(0))

    return (F.when(language == "python", widest(cx.PYTHON_SIGNATURE))
            .when(language.isin(cx.TYPED_LANGUAGES), widest(cx.TYPED_SIGNATURE))
            .otherwise(widest(cx.OTHER_SIGNATURE)))


def param_term(params) -> Column:
    return F.greatest(params - cx.FREE_PARAMS, F.lit(0)) * F.lit(cx.PARAM_WEIGHT)


def terms(source, language, lines, rules=cx.DEFAULT_RULES, lower=None) -> dict:
    return {
        "branches": branches(source, language, rules).cast("double"),
        "nesting": nesting_term(nesting(source, language)),
        "size": size_term(lines),
        "recursion": recursion_term(source),
        "callbacks": callback_term(source, language),
        "ternaries": ternary_term(source),
        "frameworks": framework_term(source, rules, lower),
        "params": param_term(max_params(source, language)),
    }


def bucket(score, source, lines) -> Column:
    by_lines = F.when(lines <= cx.LINES_SIMPLE, "simple").when(lines <= cx.LINES_MODERATE, "moderate").otherwise("complex")
    by_score = F.when(score <= cx.SCORE_SIMPLE, "simple").when(score <= cx.SCORE_MODERATE, "moderate").otherwise("complex")
    return F.when(source == "", by_lines).otherwise(by_score)


def with_complexity(df: DataFrame, source: str, language: str, lines: str, rules=cx.DEFAULT_RULES) -> DataFrame:
    """Add ``complexity``; an empty language counts as python."""
    lang = F.when(F.coalesce(F.col(language), F.lit("")) == "", F.lit("python")).otherwise(F.col(language))
    # the lower-case text has a projection of its own, so that it is computed once
    df = df.withColumn("_lower", F.lower(F.col(source)))
    parts = terms(F.col(source), lang, F.col(lines), rules, F.col("_lower"))
    score = sum(list(parts.values())[1:], list(parts.values())[0])
    return df.withColumn("_score", score).withColumn("complexity", bucket(F.col("_score"), F.col(source), F.col(lines))).drop("_score", "_lower")
