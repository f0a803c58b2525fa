"""Path columns: components, suffixes, stems, walk order, stable ids."""

from pyspark.sql import Column, functions as F

SEP = "\x01"   # sorts before every character a path may hold


def parts(path) -> Column:
    return F.split(path, "/")


def file_name(path) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def parent(path) -> Column:
    """Directory of a path, ``.`` at the top."""
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, r"/[^/]*\z", "")).otherwise(F.lit("."))


def ending(path) -> Column:
    """Lower-case text from the last dot of the file name, empty if there is none."""
    return F.regexp_extract(F.lower(file_name(path)), r"(\.[^.]*)\z", 1)


def stem(name) -> Column:
    """File name without its last suffix; a leading dot is not a suffix."""
    return F.regexp_replace(name, r"(?s)\A(.+)\.[^.]+\z", "$1")


def without_suffix(path) -> Column:
    return F.regexp_replace(path, r"(?s)([^/])\.[^./]+\z", "$1")


def walk_key(path) -> Column:
    """String whose order is the order of a sorted depth-first walk."""
    return F.translate(path, "/", SEP)


def node_ord(path, kind_rank, seq) -> Column:
    """Position of a node: file walk order, then kind, then sequence in the file."""
    return F.concat(walk_key(path), F.lit(SEP + SEP), kind_rank.cast("string"),
                    F.lpad(seq.cast("string"), 9, "0"))


def prefix_of(path, depth) -> Column:
    """First ``depth`` components of a path."""
    return F.array_join(F.slice(parts(path), 1, depth), "/")


def node_id(path, name=None) -> Column:
    raw = path if name is None else F.when(name == "", path).otherwise(F.concat(path, F.lit("::"), name))
    return F.substring(F.md5(raw), 1, 12)


def overlaps(path, names) -> Column:
    """Does any component of the lower-case path belong to ``names``?"""
    return F.arrays_overlap(parts(F.lower(path)), F.array(*[F.lit(n) for n in names]))
