"""Version and dependency inventory of many repositories in one job.

Manifests of one directory meet in one row (at most eleven small files). Each reader
below turns that row into candidate rows; one aggregation settles precedence between
the directories of a repository.
"""

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as tx
from ..functions.text import rx
from ..rules import inventory as iv
from ..sources.files import manifests

STRS = "map<string,string>"
VERSION = "array<struct<section:string,name:string,version:string,last:boolean,sub:int>>"
PACKAGES = "array<struct<manager:string,count:int,key:array<struct<name:string,version:string>>>>"
ENTRIES = "array<struct<name:string,version:string>>"


def by_folder(files: DataFrame) -> DataFrame:
    """One row per repository and directory, one column per manifest."""
    rows = manifests(files, iv.MANIFEST_NAMES, iv.SKIPPED_DIRS)
    cols = [F.max(F.when(F.col("file_name") == n, F.col("content"))).alias(n.replace(".", "_")) for n in iv.MANIFEST_NAMES]
    return rows.groupBy("repo_id", "folder").agg(*cols)


def _version(section, name, version, last=True, sub=0) -> Column:
    """A candidate, null when it has no value. ``last``: later directories overwrite; else the first stays."""
    return F.when(version.isNotNull(), F.struct(
        F.lit(section).alias("section"), F.lit(name).alias("name"), version.alias("version"), F.lit(last).alias("last"), F.lit(sub).alias("sub")))


def _candidates(*items) -> Column:
    return F.array_compact(F.array(*items)).cast(VERSION)


def _entries(mapping) -> Column:
    return F.coalesce(F.transform(F.map_entries(mapping), lambda e: F.struct(e["key"].alias("name"), e["value"].alias("version"))), F.array().cast(ENTRIES))


def _merged(first, second) -> Column:
    """Entries of two maps in first-seen order; the second map's value wins."""
    names = F.array_distinct(F.concat(F.coalesce(F.map_keys(first), F.array().cast("array<string>")), F.coalesce(F.map_keys(second), F.array().cast("array<string>"))))
    return F.transform(names, lambda n: F.struct(n.alias("name"), F.coalesce(F.try_element_at(second, n), F.try_element_at(first, n)).alias("version")))


def _last_values(entries) -> Column:
    """Entries in first-seen order of their names; the last value of a name wins."""
    names = F.array_distinct(F.transform(entries, lambda e: e["name"]))
    return F.transform(names, lambda n: F.struct(n.alias("name"), F.element_at(F.filter(entries, lambda e: e["name"] == n), -1)["version"].alias("version")))


def _packages(manager, count, key) -> Column:
    return F.when(count > 0, F.struct(F.lit(manager).alias("manager"), count.cast("int").alias("count"), key.alias("key")))


def _first_group(col, pattern, flags="") -> Column:
    return tx.empty_to_null(F.regexp_extract(col, rx(pattern, flags), 1))


def _php(row: DataFrame) -> DataFrame:
    spec = F.from_json("composer_json", f"require {STRS}, `require-dev` {STRS}")
    df = row.withColumn("_c", spec)
    req, dev = F.col("_c.require"), F.col("_c.require-dev")
    digits = F.coalesce(_first_group(F.col("Dockerfile"), r"php(\d+)[.\-]", "i"), _first_group(F.col("develop_dockerfile"), r"php(\d+)[.\-]", "i"))
    dotted = F.when(F.length(digits) > 1, F.concat(F.substring(digits, 1, 1), F.lit("."), F.substring(digits, F.lit(2), F.length(digits)))).otherwise(digits)
    present = F.col("composer_json").isNotNull() & (req.isNotNull() | dev.isNotNull())
    pkgs = F.filter(_merged(req, dev), lambda e: (e["name"] != "php") & ~F.startswith(e["name"], F.lit("ext-")))
    return df.withColumn("php_v", _candidates(
        _version("runtime", "php", F.try_element_at(req, F.lit("php"))),
        _version("runtime", "php", F.when(present & F.try_element_at(req, F.lit("php")).isNull(), dotted), last=False),
        *[_version("frameworks", fw, F.try_element_at(req, F.lit(pkg)), sub=i) for i, (pkg, fw) in enumerate(iv.PHP_FRAMEWORKS.items())],
    )).withColumn("php_p", _packages("composer", F.size(pkgs), pkgs)).drop("_c")


def _node(row: DataFrame) -> DataFrame:
    df = row.withColumn("_p", F.from_json("package_json", f"engines {STRS}, dependencies {STRS}, devDependencies {STRS}"))
    eng, deps, dev = F.col("_p.engines"), F.col("_p.dependencies"), F.col("_p.devDependencies")
    size = lambda m: F.coalesce(F.when(m.isNotNull(), F.size(m)), F.lit(0))
    return df.withColumn("node_v", _candidates(
        _version("runtime", "node", tx.strip(F.coalesce("_node-version", "_nvmrc"))),
        _version("runtime", "node", F.try_element_at(eng, F.lit("node")), last=False),
        _version("runtime", "npm", F.try_element_at(eng, F.lit("npm"))),
        *[_version("frameworks", fw, F.coalesce(F.try_element_at(dev, F.lit(pkg)), F.try_element_at(deps, F.lit(pkg)))) for pkg, fw in iv.NODE_FRAMEWORKS.items()],
    )).withColumn("node_p", _packages("npm", size(deps) + size(dev), _entries(deps))).drop("_p")


def _python(row: DataFrame) -> DataFrame:
    raw = F.filter(F.split("requirements_txt", "\n"), lambda l: tx.nonblank(l) & ~F.startswith(l, F.lit("#")))
    lines = F.transform(raw, tx.strip)

    def entry(line):
        name = F.regexp_extract(line, r"\A([^=<>!~]*)", 1)
        rest = F.regexp_replace(F.substring(line, F.length(name) + 1, F.length(line)), r"\A[=<>!~ ]+|[=<>!~ ]+\z", "")
        return F.struct(tx.strip(name).alias("name"), F.when(name == line, F.lit("*")).otherwise(rest).alias("version"))

    return row.withColumn("python_v", _candidates(
        _version("runtime", "python", _first_group(F.col("pyproject_toml"), r"requires-python\s*=\s*[\"']([^\"']+)")),
    )).withColumn("python_p", _packages("pip", F.size(lines), _last_values(F.transform(lines, entry))))


def _go(row: DataFrame) -> DataFrame:
    pattern = r"(?m)^\t([\w./\-]+)\s+(v[\d.]+)"
    found = F.transform(tx.all_of(F.col("go_mod"), pattern, 0), lambda m: F.struct(
        F.regexp_extract(m, rx(pattern), 1).alias("name"), F.regexp_extract(m, rx(pattern), 2).alias("version")))
    return row.withColumn("go_v", _candidates(_version("runtime", "go", _first_group(F.col("go_mod"), r"(?m)^go\s+([\d.]+)")))).withColumn(
        "go_p", _packages("go", F.size(found), _last_values(found)))


def _ruby(row: DataFrame) -> DataFrame:
    pattern = r"gem\s+['\"]([^'\"]+)['\"](?:,\s*['\"]([^'\"]*)['\"])?"
    gems = F.transform(tx.all_of(F.col("Gemfile"), pattern, 0), lambda m: F.struct(
        F.regexp_extract(m, rx(pattern), 1).alias("name"), F.regexp_extract(m, rx(pattern), 2).alias("version")))

    def framework(gem):
        last = F.try_element_at(F.filter(gems, lambda g: g["name"] == gem), F.lit(-1))["version"]
        return F.when(last == "", F.lit("*")).otherwise(last)

    return row.withColumn("ruby_v", _candidates(
        _version("runtime", "ruby", tx.strip(F.col("_ruby-version"))),
        _version("runtime", "ruby", _first_group(F.col("Gemfile"), r"ruby\s+['\"]([^'\"]+)"), last=False),
        *[_version("frameworks", fw, framework(gem)) for gem, fw in iv.RUBY_FRAMEWORKS.items()],
    )).withColumn("ruby_p", _packages("gem", F.size(gems), _last_values(gems)))


def base_image(content) -> Column:
    """First ``FROM`` image that is not a variable."""
    images = tx.all_of(content, r"FROM\s+([^\s]+)", 1)
    return F.try_element_at(F.filter(images, lambda i: ~F.startswith(i, F.lit("$"))), F.lit(1))


def _docker(row: DataFrame) -> DataFrame:
    image = F.coalesce(base_image(F.col("Dockerfile")), base_image(F.col("develop_dockerfile")))
    return row.withColumn("docker_v", _candidates(_version("runtime", "docker_base", image, last=False)))


READERS = {"php": _php, "node": _node, "python": _python, "go": _go, "ruby": _ruby, "docker": _docker}


def candidates(files: DataFrame, kinds=tuple(READERS)) -> DataFrame:
    """All version candidates and package lists, per repository and directory."""
    row = by_folder(files)
    for kind in kinds:
        row = READERS[kind](row)
    versions = F.concat(*[F.coalesce(F.col(f"{k}_v"), F.array().cast(VERSION)) for k in kinds])
    packs = [F.col(f"{k}_p") for k in kinds if k != "docker"]
    packages = F.array_compact(F.array(*packs)) if packs else F.array()
    return row.select("repo_id", "folder", versions.alias("versions"), packages.cast(PACKAGES).alias("packages"))


def settled_versions(cands: DataFrame) -> DataFrame:
    """``(repo_id, section, name, version)``: overwriting candidates of the last directory win;
    without one, the first directory's gap filler stays."""
    rows = cands.select("repo_id", "folder", F.explode("versions").alias("v")).select("repo_id", "folder", "v.*")
    return rows.groupBy("repo_id", "section", "name").agg(
        F.max_by("version", F.when(F.col("last"), F.struct("folder", "sub"))).alias("_last"),
        F.min_by("version", F.when(~F.col("last"), F.struct("folder", "sub"))).alias("_first"),
    ).select("repo_id", "section", "name", F.coalesce("_last", "_first").alias("version"))


def settled_packages(cands: DataFrame) -> DataFrame:
    """``(repo_id, manager, count, key)`` of the last directory that has packages."""
    rows = cands.select("repo_id", "folder", F.explode("packages").alias("p")).select("repo_id", "folder", "p.*")
    return rows.groupBy("repo_id", "manager").agg(F.max_by(F.struct("count", "key"), "folder").alias("p")).select("repo_id", "manager", "p.count", "p.key")


def with_findings(versions: DataFrame, findings: DataFrame) -> DataFrame:
    """Fill gaps from outside findings: unknown names only, whatever their case; tools always go to runtime."""
    known = versions.select("repo_id", "section", F.lower("name").alias("_k"))
    gaps = findings.where(F.col("section").isin("runtime", "frameworks")).withColumn("_k", F.lower("name")).join(
        known, ["repo_id", "section", "_k"], "left_anti").drop("_k")
    tools = findings.where(F.col("section") == "tools").withColumn("section", F.lit("runtime"))
    base = versions.unionByName(gaps.select(*versions.columns)).join(tools.select("repo_id", "section", "name"), ["repo_id", "section", "name"], "left_anti")
    return base.select(*versions.columns).unionByName(tools.select(*versions.columns))


def digest(files: DataFrame, max_chars: int = None) -> DataFrame:
    """Config files at the repository root as text snippets, in fixed order; ``max_chars`` cuts each, if given."""
    order = tx.lookup({n: i for i, n in enumerate(iv.DIGEST_NAMES)}, F.col("path"))
    body = F.col("content")
    if max_chars is not None:
        body = F.when(F.length(body) > max_chars, F.concat(F.substring(body, 1, max_chars), F.lit("\n... (truncated)"))).otherwise(body)
    return files.where(F.col("path").isin(iv.DIGEST_NAMES)).select(
        "repo_id", order.alias("ord"), F.col("path").alias("name"), F.concat(F.lit("### "), "path", F.lit("\n```\n"), body, F.lit("\n```")).alias("snippet"))
