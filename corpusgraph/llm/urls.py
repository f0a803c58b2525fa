"""URL verdicts: prefix rules, and a Bloom filter cascade over the corpus's own host keys.

Only DataFrame functions. A cascade is a list of bit arrays: level 0 holds the listed keys, level 1
those other keys of the corpus that level 0 lets through by mistake, level 2 the listed keys that
level 1 lets through, and so on until a level makes no mistake. Over the keys it was built on,
membership is exact, and it is tested inside the scan: no join, no exchange.
"""

from pyspark.sql import Column, DataFrame, functions as F

from corpusgraph.functions.tables import written

HASHES, BITS_PER_KEY = 4, 10
#: Most listed keys whose level is kept as bits (2.5 MB); a longer list is judged by a join instead.
MAX_KEYS = 2_000_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: str) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path of a url column; both empty for null or without ``://``."""
    at = F.locate("://", F.col(url))
    rest = F.when(at > 0, F.col(url).substr(at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER), path


def matching_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest of ``rules`` (verdict, "host/path prefix") that fits, else nulls.

    A rule fits its host and all subdomains, where the path starts with the rule's.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, _, rest = text.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit("/" + rest))
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def suffixes(host: Column) -> Column:
    """The host and its parent domains: a.b.c -> [a.b.c, b.c, c]."""
    parts = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def _positions(key: Column, level: int, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(level), F.lit(i)), F.lit(bits)) for i in range(HASHES)]


def _bits(keys: DataFrame, level: int, count: int) -> bytes:
    """Bit array of one level; what reaches the driver is at most the array itself."""
    bits = max(64, count * BITS_PER_KEY)
    at = keys.select(F.explode(F.array(*_positions(F.col("key"), level, bits))).alias("p"))
    rows = at.groupBy((F.col("p") / 8).cast("long").alias("byte")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1), (F.col("p") % 8).cast("int"))).alias("value")).collect()
    out = bytearray((bits + 7) // 8)
    for r in rows:
        out[r["byte"]] = r["value"]
    return bytes(out)


def _holds(key: Column, array: bytes, level: int, count: int) -> Column:
    out = F.lit(True)
    for p in _positions(key, level, max(64, count * BITS_PER_KEY)):
        byte = F.conv(F.hex(F.substring(F.lit(array), (F.floor(p / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        out = out & (F.call_function("shiftright", byte, (p % 8).cast("int")).bitwiseAND(F.lit(1)) == 1)
    return out


def cascade(universe: DataFrame, listed: DataFrame) -> list[tuple[bytes, int]]:
    """Levels (bit array, keys in it) for ``listed`` keys within ``universe`` (both: column ``key``).

    Both sides shrink from level to level, to about one key in a hundred.
    """
    both = universe.select("key", F.lit(False).alias("in"), F.lit(True).alias("seen")).unionByName(
        listed.select("key", F.lit(True).alias("in"), F.lit(False).alias("seen")))
    marked = written(both.groupBy("key").agg(F.bool_or("in").alias("in"), F.bool_or("seen").alias("seen")).where("seen").select("key", "in"), "keys")
    levels, encoded, others = [], marked.where("in").select("key"), marked.where("not in").select("key")
    while True:
        count = encoded.count()
        if not count:
            return levels
        array = _bits(encoded, len(levels), count)
        wrong = others.where(_holds(F.col("key"), array, len(levels), count))
        levels.append((array, count))
        encoded, others = wrong, encoded


def contains(key: Column, levels: list[tuple[bytes, int]]) -> Column:
    """Whether the cascade holds ``key`` (exact for keys of its universe)."""
    out = F.lit(False)
    for level in reversed(range(len(levels))):
        array, count = levels[level]
        out = _holds(key, array, level, count) & ~out
    return out


def judged(pages: DataFrame, rules: list[tuple[str, str]], listed: DataFrame, url: str = "url") -> DataFrame:
    """``pages`` plus host, path, rule, verdict (allow or block).

    The longest fitting rule decides; without one, a page is blocked if its host or a parent domain
    is in ``listed`` (column ``key``), else allowed. Null urls have an empty host and are allowed;
    columns named like the new ones are replaced; an empty list or table is fine.
    """
    host, path = host_and_path(url)
    rows = pages.withColumns({"host": host, "path": path})
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    listed = listed.select("key").where("key is not null").distinct()
    universe = rows.select("host").distinct().select(F.explode(suffixes(F.col("host"))).alias("key")).distinct()
    if listed.limit(MAX_KEYS + 1).count() > MAX_KEYS:
        hosts = (rows.select("host").distinct().select("host", F.explode(suffixes(F.col("host"))).alias("key"))
                 .join(listed, "key", "left_semi").select("host", F.lit(True).alias("in")).distinct())
        rows, found = rows.join(hosts, "host", "left"), F.coalesce("in", F.lit(False))
    else:
        levels = cascade(universe, listed)
        found = F.exists(suffixes(F.col("host")), lambda k: contains(k, levels))
    columns = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    return rows.withColumns({"rule": rule, "verdict": F.coalesce(verdict, F.when(found, F.lit("block")).otherwise(F.lit("allow")))}).select(
        *columns, "host", "path", "rule", "verdict")
