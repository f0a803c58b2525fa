"""Semantic tags as projections over files and symbols."""

import functools
import operator

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as tx
from ..functions.text import lit_array
from ..rules import semantics as sm

EFFECTS = "array<struct<type:string,confidence:double,source:string>>"


def normalized_entity(name) -> Column:
    key = F.replace(F.replace(F.lower(name), F.lit("-"), F.lit("_")), F.lit(" "), F.lit("_"))
    return F.coalesce(tx.lookup(sm.ENTITY_ALIASES, key), key)


def _service_hits(sources, services) -> Column:
    """Services named in import sources, in import order then service order."""
    return F.flatten(F.transform(sources, lambda i: F.filter(lit_array(services), lambda s: F.contains(F.lower(i), s))))


def refined_effect(effect: str, content, sources) -> Column:
    """Effect type with the entity it touches, when one can be named."""
    if effect == "external_api":
        service = F.try_element_at(_service_hits(sources, sm.API_SERVICES), F.lit(1))
        return F.when(service.isNotNull(), F.concat(F.lit(effect + ":"), service)).otherwise(F.lit(effect))
    if effect in ("db_write", "db_read"):
        first = F.when(tx.holds(content, sm.ENTITY_WORDS), F.coalesce(tx.empty_to_null(tx.group_of(content, sm.ENTITY_PATTERN, 1)),
                                                                      tx.empty_to_null(tx.group_of(content, sm.ENTITY_PATTERN, 2))))
        return F.when(first.isNotNull(), F.concat(F.lit(effect + ":"), normalized_entity(first))).otherwise(F.lit(effect))
    return F.lit(effect)


def shows(effect: str, content, lower) -> Column:
    """Does the effect's pattern match? Beyond ASCII a letter may have more than one other case, so the pattern decides alone."""
    gate = tx.holds(lower, sm.EFFECT_WORDS[effect]) | (F.octet_length(content) != F.length(content))
    return gate & tx.has(content, sm.EFFECT_PATTERNS[effect], "i")


def pattern_effects(content, sources, lower=None) -> Column:
    """``lower`` is a column that holds the lower-case text; without it, it is computed for each word."""
    lower = F.lower(content) if lower is None else lower
    confidence = F.when(F.contains(content, F.lit("->")), F.lit(0.9)).otherwise(F.lit(0.7))
    tags = [
        F.when(shows(effect, content, lower),
               F.struct(refined_effect(effect, content, sources).alias("type"), confidence.alias("confidence"),
                        F.lit("regex").alias("source")))
        for effect in sm.EFFECT_PATTERNS
    ]
    return F.array_compact(F.array(*tags)).cast(EFFECTS)


def import_effects(sources, present) -> Column:
    """External services seen only through imports."""
    missing = F.filter(F.array_distinct(_service_hits(sources, sm.IMPORT_SERVICES)),
                       lambda s: ~F.exists(present, lambda e: F.contains(e["type"], s)))
    return F.transform(missing, lambda s: F.struct(
        F.concat(F.lit("external_api:"), s).alias("type"), F.lit(0.6).alias("confidence"),
        F.lit("import_inference").alias("source"))).cast(EFFECTS)


def control_flow(content) -> Column:
    tests = {name: tx.holds(content, sm.CONTROL_WORDS[name]) & tx.has(content, pattern) if name in sm.CONTROL_WORDS else None
             for name, pattern in sm.CONTROL_PATTERNS.items()}
    tests["try_catch"] = (tx.holds(content, ["finally"]) & tx.has(content, sm.FINALLY_JVM)) | (
        tx.holds(content, ["try"]) & tx.holds(content, ["catch", "except"]) & tx.has(content, sm.TRY_CATCH_JVM))
    return F.array_compact(F.array(*[F.when(t, F.lit(n)) for n, t in tests.items()]))


def domain_scores(label, text) -> dict:
    """Score per domain family in tenths, of lower-case columns: 10 per hit in name or path, 3 per hit in the text."""
    return {
        domain: sum((F.when(F.contains(label, F.lit(w)), 10).otherwise(0)
                     + F.when(F.contains(text, F.lit(w)), 3).otherwise(0) for w in words), F.lit(0))
        for domain, words in sm.DOMAIN_KEYWORDS.items()
    }


def domain_from(scores) -> Column:
    """Best family of a score array with at least one full point; the first one on ties."""
    best = F.array_max(scores)
    place = F.array_position(scores, best).cast("int")
    return F.when(best < 10, F.lit("")).otherwise(F.element_at(lit_array(list(sm.DOMAIN_KEYWORDS)), place))


def role_of(name, path) -> Column:
    """First role that a name or path shows. In ASCII the patterns, which are lists of words, are plain searches."""
    label = F.concat_ws(" ", name, path)

    def shown(bound):
        def by_word(pattern):
            words = [F.contains(bound["lower"], F.lit(w.lower())) for w in pattern.split("|")]
            return functools.reduce(operator.or_, words)

        plain = F.coalesce(*[F.when(by_word(p), F.lit(r)) for r, p in sm.ROLE_PATTERNS.items()], F.lit(""))
        any_ = F.coalesce(*[F.when(tx.has(bound["label"], p, "i"), F.lit(r)) for r, p in sm.ROLE_PATTERNS.items()], F.lit(""))
        return F.when(F.octet_length(bound["label"]) == F.length(bound["label"]), plain).otherwise(any_)

    return tx.let(F.struct(label.alias("label"), F.lower(label).alias("lower")), shown)


def with_domain(df: DataFrame, name: str, path: str, text: str, out: str = "domain_hint") -> DataFrame:
    """Lower-case texts and scores live in projections of their own, so each is computed once."""
    staged = df.withColumns({"_label": F.lower(F.concat_ws(" ", name, path)), "_lower": F.lower(F.col(text))})
    staged = staged.withColumn("_scores", F.array(*domain_scores(F.col("_label"), F.col("_lower")).values()))
    return staged.withColumn(out, domain_from(F.col("_scores"))).drop("_scores", "_label", "_lower")


def file_semantics(ext: DataFrame) -> DataFrame:
    """``effects`` and ``control_flow`` of each extracted file, computed once per file."""
    sources = F.transform("imports", lambda i: i["source"])
    return (
        ext.withColumns({"_sources": sources, "_lower": F.lower("content")})
        .withColumn("_regex_effects", pattern_effects(F.col("content"), F.col("_sources"), F.col("_lower")))
        .withColumn("side_effects", F.concat("_regex_effects", import_effects(F.col("_sources"), F.col("_regex_effects"))))
        .withColumn("control_flow", control_flow(F.col("content")))
        .drop("_sources", "_regex_effects", "_lower")
    )


def summary_of(base, params, decorators, role, domain, effect_types) -> Column:
    head = F.when(F.size(params) > 0, F.concat(base, F.lit(" ("), F.array_join(F.slice(params, 1, 5), ", "), F.lit(")"))).otherwise(base)
    rest = F.array_compact(F.array(
        F.when(F.size(decorators) > 0, F.concat(F.lit("@"), F.array_join(F.slice(decorators, 1, 3), ","))),
        F.when(role != "", role),
        F.when(domain != "", F.concat(F.lit("["), domain, F.lit("]"))),
        F.when(F.size(effect_types) > 0, F.concat(F.lit("→ "), F.array_join(F.slice(effect_types, 1, 3), ", "))),
    ))
    return F.array_join(F.concat(F.array(head), rest), " · ")


def symbol_base(kind, methods, bases) -> Column:
    extends = F.when(F.size(bases) > 0, F.concat(F.lit(", extends "), F.array_join(bases, ", "))).otherwise(F.lit(""))
    return F.when(kind == "function", F.lit("Function")).otherwise(
        F.concat(F.lit("Class with "), F.size(methods).cast("string"), F.lit(" methods"), extends))
