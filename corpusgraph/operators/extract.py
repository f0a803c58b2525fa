"""Extraction: files in, symbol / import / export / call rows out.

Everything of one file is computed inside its row (arrays), so extraction needs no exchange. Matches, lines and block
ends come from one pass over Arrow batches (``functions/lexer.py``); the groups of the matches are taken apart here.
"""

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import lexer, text as tx
from ..functions.text import NL, rx
from ..rules import extraction as ex, scan

STRINGS = "array<string>"
FOUND = "array<struct<family:string,pos:int,indent:int,line:int,at:int,end:int,body:int,name:string,params:array<string>,decorators:array<string>,bases:array<string>>>"
SYMBOL = "array<struct<kind:string,name:string,line_start:int,line_end:int,params:array<string>,decorators:array<string>,bases:array<string>,methods:array<string>>>"
IMPORT = "array<struct<source:string,specifiers:array<string>,line:int>>"
EXPORT = "array<struct<name:string,line:int>>"

# ---- rules as data -----------------------------------------------------------


def _none(kind: str = STRINGS) -> Column:
    return F.array().cast(kind)


# Python symbols are found by the scanner itself; its imports are rules over text without strings and comments.
_IMPORT = r"(?m)^([ \t]*)import[ \t]+((?:[^\n;\\]|\\\n)+)"
_FROM = r"(?m)^([ \t]*)from[ \t]+([.\w]+)[ \t]+import[ \t]+(\([^)]*\)|(?:[^\n;\\]|\\\n)+)"


def rule_rows(extra: dict = None) -> dict:
    """Rule rows by language. ``extra`` maps a family (function, class, import, export)
    to further ``{language: [Rule]}`` entries, which replace those of the same language."""
    families = {"function": ex.FUNCTION_RULES, "class": ex.CLASS_RULES, "import": ex.IMPORT_RULES, "export": ex.EXPORT_RULES}
    rows = {"python": [
        dict(family="import", pos=0, pattern=_IMPORT, groups=2, name=1, params=0, bases=0),
        dict(family="import", pos=1, pattern=_FROM, groups=3, name=1, params=0, bases=0),
    ]}
    for family, base in families.items():
        for lang, rules in {**base, **((extra or {}).get(family) or {})}.items():
            for pos, r in enumerate(rules):
                rows.setdefault(lang, []).append(dict(
                    family=family, pos=pos, pattern=r.spark_pattern, groups=max(r.groups, r.name, r.params, r.bases),
                    name=r.name, params=r.params, bases=r.bases))
    return rows


def rule_hits(content, language, extra: dict = None) -> Column:
    """All matches of all rules of the row's language, with lines, ends and groups; only texts with rules are sent."""
    rules = rule_rows(extra)

    @F.arrow_udf(lexer.HITS)
    def scan(codes: pa.Array, languages: pa.Array) -> pa.Array:
        return lexer.scanned(codes, languages, rules)

    return scan(F.when(language.isin(list(rules)), content), language)


def _param_names(params) -> Column:
    """Last word of each parameter, and of that the text after the last colon."""
    return F.transform(F.filter(F.split(params, ","), tx.nonblank),
                       lambda p: F.regexp_extract(p, rx(r"([^\s:]*)\s*\z"), 1))


def _comma_list(col) -> Column:
    return F.filter(F.transform(F.split(col, ","), tx.strip), lambda b: b != "")


def _found(hit, at) -> Column:
    python = F.col("language") == "python"
    return F.struct(
        hit["family"].alias("family"), hit["pos"].alias("pos"), hit["indent"].alias("indent"), hit["line"].alias("line"), at.alias("at"),
        hit["end"].alias("end"), hit["body"].alias("body"), hit["name"].alias("name"),
        F.when(python, _python_params(hit["params"])).otherwise(_param_names(hit["params"])).alias("params"), hit["decorators"].alias("decorators"),
        F.when(python, _python_bases(hit["bases"])).otherwise(_comma_list(hit["bases"])).alias("bases"))


def _import(hit) -> Column:
    def build(groups):
        return F.struct(
            F.coalesce(F.try_element_at(groups, F.lit(-1)), F.lit("")).alias("source"),
            F.when(F.size(groups) > 1, _comma_list(F.element_at(groups, 1))).otherwise(_none()).alias("specifiers"),
            hit["line"].alias("line"))

    return tx.let(F.filter(hit["groups"], lambda g: g != ""), build)


def _exports_of(hit) -> Column:
    names = F.transform(F.split(F.element_at(hit["groups"], 1), ","),
                        lambda n: tx.strip(F.element_at(F.split(tx.strip(n), " as "), 1)))
    return F.transform(F.filter(names, lambda n: n != ""), lambda n: F.struct(n.alias("name"), hit["line"].alias("line")))


# ---- python ----------------------------------------------------------------


def _python_params(params) -> Column:
    """Plain positional names: none before ``/``, none from the first ``*`` on, no self."""
    items = _comma_list(params)
    slash = F.array_position(items, "/")
    star = F.array_position(F.transform(items, lambda p: F.startswith(p, F.lit("*"))), True)
    head = F.when(star > 0, F.slice(items, 1, F.greatest((star - 1).cast("int"), F.lit(0)))).otherwise(items)
    plain = F.when(slash > 0, F.slice(head, (slash + 1).cast("int"), F.size(items))).otherwise(head)
    names = F.transform(plain, lambda p: F.regexp_extract(p, rx(r"\A(\w+)"), 1))
    return F.filter(names, lambda n: (n != "self") & (n != ""))


def _python_bases(bases) -> Column:
    """Plain and dotted names; calls and subscripts hold a mark of the scanner."""
    plain = F.filter(_comma_list(bases), lambda b: F.rlike(b, F.lit(rx(r"\A\w+(?:\.\w+)*\z"))))
    return F.transform(plain, lambda b: F.element_at(F.split(b, r"\."), -1))


def _python_imports(hit) -> Column:
    """One row per module of an ``import``, one per ``from``; outer statements first."""
    indent, text = F.length(F.element_at(hit["groups"], 1)), F.element_at(hit["groups"], -1)
    plain = F.transform(
        _comma_list(F.replace(text, F.lit("\\\n"), F.lit(" "))),
        lambda p: F.struct(indent.alias("indent"), hit["line"].alias("line"),
                           F.regexp_extract(p, rx(r"\A([\w.]+)"), 1).alias("source"),
                           F.array(F.regexp_extract(p, rx(r"([\w.]+)\z"), 1)).alias("specifiers")))
    names = _comma_list(F.regexp_replace(text, r"[()]|\\\n", " "))
    from_ = F.array(F.struct(indent.alias("indent"), hit["line"].alias("line"),
                             F.regexp_replace(F.element_at(hit["groups"], 2), r"\A\.+", "").alias("source"),
                             F.transform(names, lambda n: F.regexp_extract(n, rx(r"\A([\w*]+)"), 1)).alias("specifiers")))
    return F.when(hit["pos"] == 0, plain).otherwise(from_)


# ---- the job ---------------------------------------------------------------


def extracted(files: DataFrame, extra_rules: dict = None, keep_others: bool = False) -> DataFrame:
    """Add ``symbols``, ``imports``, ``exports`` and ``call_tokens`` arrays to code files.

    ``extra_rules`` adds rule rows, also for languages that have none. ``keep_others``
    keeps files of other languages, with empty arrays.
    """
    lang, hits = F.col("language"), F.col("_hits")
    python = lang == "python"

    def family(name):
        return F.filter(hits, lambda h: h["family"] == name)

    is_code = lang.isin(scan.CODE_LANGUAGES)
    step1 = (files if keep_others else files.where(is_code)).withColumn("_hits", rule_hits(F.col("content"), lang, extra_rules))
    symbol_hits = F.filter(hits, lambda h: h["family"].isin("function", "class"))
    step2 = step1.select(
        "*", F.when(is_code, F.array_distinct(tx.all_of(F.col("content"), ex.CALL_TOKEN, 1))).otherwise(_none()).alias("call_tokens"),
        # By family, rule, then position; python orders outer definitions before nested ones.
        F.array_sort(F.transform(symbol_hits, _found).cast(FOUND)).alias("_found"),
        F.when(python, F.transform(F.array_sort(F.flatten(F.transform(family("import"), _python_imports))),
                                   lambda i: F.struct(i["source"], i["specifiers"], i["line"])).cast(IMPORT))
        .otherwise(F.transform(family("import"), _import).cast(IMPORT)).alias("imports"),
        F.flatten(F.transform(family("export"), _exports_of)).cast(EXPORT).alias("exports"),
    )
    functions = F.filter("_found", lambda f: (f["family"] == "function") & (f["name"] != "")
                         & (python | ~f["name"].isin(ex.CONTROL_WORDS)))
    step3 = step2.select("*", functions.alias("_functions"), F.filter("_found", lambda f: f["family"] == "class").alias("_classes"))

    def symbol(f):
        methods = F.when(python & (f["family"] == "class"), _direct_methods(f)).otherwise(_none())
        return F.struct(f["family"].alias("kind"), f["name"], f["line"], f["end"], f["params"], f["decorators"], f["bases"], methods)

    kept = [c for c in files.columns] + ["imports", "exports", "call_tokens"]
    return step3.select(*kept, F.transform(F.concat("_functions", "_classes"), symbol).cast(SYMBOL).alias("symbols"))


def _direct_methods(cls) -> Column:
    """Functions in a python class whose indent is that of the first line of its body."""
    picked = F.filter("_functions", lambda f: (f["line"] > cls["line"]) & (f["line"] <= cls["end"]) & (f["indent"] == cls["body"]))
    return F.transform(F.array_sort(F.transform(picked, lambda f: F.struct(f["line"], f["name"]))), lambda s: s["name"])


def rows_of(df: DataFrame, array: str, pos: str, item: str, *keep) -> DataFrame:
    """One row per array element. The outer form is used on purpose: for the plain one
    the optimizer infers a filter on the array size and computes the array twice."""
    return df.select(*keep, F.posexplode_outer(array).alias(pos, item)).where(F.col(pos).isNotNull())


def symbols(ext: DataFrame) -> DataFrame:
    """Symbol rows; ``seq`` is the order of definition within the file."""
    return rows_of(ext, "symbols", "seq", "s", "repo_id", "path", "language").select(
        "repo_id", "path", "language", "s.kind", "seq", "s.name", "s.line_start", "s.line_end",
        "s.params", "s.decorators", "s.bases", "s.methods")


def imports(ext: DataFrame) -> DataFrame:
    return rows_of(ext, "imports", "seq", "i", "repo_id", "path").select(
        "repo_id", "path", "seq", "i.source", "i.specifiers", "i.line")


def exports(ext: DataFrame) -> DataFrame:
    return rows_of(ext, "exports", "seq", "e", "repo_id", "path").select(
        "repo_id", "path", "seq", "e.name", "e.line")


def call_sites(files: DataFrame) -> DataFrame:
    """Distinct identifiers directly before ``(`` per code file."""
    tokens = F.array_distinct(tx.all_of(F.col("content"), ex.CALL_TOKEN, 1))
    code = files.where(F.col("language").isin(scan.CODE_LANGUAGES)).select("repo_id", "path", tokens.alias("_tokens"))
    return rows_of(code, "_tokens", "_pos", "token", "repo_id", "path").drop("_pos")


def line_count(content) -> Column:
    return tx.newlines(content) + 1


def sources(ext: DataFrame, *keep) -> DataFrame:
    """Symbol rows with their own lines as ``source``: a file is split once, whatever the number of its symbols, and its
    text does not travel with them. ``keep`` names further columns of the file."""
    def own(bound):
        return F.transform(bound["symbols"], lambda s: F.struct(
            s.alias("symbol"), F.array_join(tx.slice_lines(bound["lines"], s["line_start"], s["line_end"]), NL).alias("source")))

    pieces = tx.let(F.struct(tx.lines_of(F.col("content")).alias("lines"), F.col("symbols").alias("symbols")), own)
    rows = rows_of(ext.withColumn("_pieces", pieces), "_pieces", "seq", "p", "repo_id", "path", *keep)
    return rows.select("repo_id", "path", *keep, "seq", "p.symbol.*", "p.source")


def with_methods(syms: DataFrame) -> DataFrame:
    """Optional: fill ``methods`` of classes in rule-driven languages with the functions
    whose start line lies inside the class. Files bound the groups."""
    cls = syms.where((F.col("kind") == "class") & (F.col("language") != "python"))
    fns = syms.where(F.col("kind") == "function").select(
        "repo_id", "path", F.col("name").alias("_m"), F.col("line_start").alias("_l"))
    filled = (
        cls.join(fns, ["repo_id", "path"], "left")
        .groupBy("repo_id", "path", "seq")
        .agg(F.transform(F.array_sort(F.collect_list(F.when(
            (F.col("_l") >= F.col("line_start")) & (F.col("_l") <= F.col("line_end")), F.struct("_l", "_m")))),
            lambda s: s["_m"]).alias("_methods"))
    )
    return (
        syms.join(filled, ["repo_id", "path", "seq"], "left")
        .withColumn("methods", F.coalesce("_methods", "methods")).drop("_methods")
    )
