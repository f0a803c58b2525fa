"""Benchmark decontamination by template: numbers, names and units become typed placeholders.

A text's tokens are its words, lower-cased; a number (digits, also 1,234.5, or a number word), the unit
after a number, and a word with a first capital inside a sentence are placeholders that keep their value as a slot.
Windows of ``WINDOW`` template tokens are joined by hash with those of the benchmark. Along one alignment
of a document with an item the slots must agree: each of the item's values always becomes one and the same
value of the document, and different values stay different; where they do not agree throughout, the longest run
of windows in which they do counts. So a copied question is caught, and so is one with other numbers or names; a
chance match whose values do not fit is not.

Windows with few literal words are no template, and capitals decide what a name is. So each window is joined by its plain
lower-cased words too, and a verbatim copy in any case is found whatever it is made of.
"""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from corpusgraph.functions.tables import written

from .labelled import shielded
from .text import U64, WORDS, buffers, grams, small, strings, words, words_of

WINDOW = 8
#: Literal words that a window needs at least to be a template, as a share of its tokens.
LITERAL = 0.5
#: An item counts as leaked if so many of its windows are found in line, or this share of them.
RUN, SHARE = 6, 0.5
#: Size of the bit filter over benchmark windows that documents pass before the join (2 MB, fixed).
FILTER_BITS = 1 << 24

#: Sets the hashes of plain windows apart from those of templates.
PLAIN = U64(0x504C41494E000000)
NUMBER, NAME, UNIT = U64(0x4E554D), U64(0x4E414D45), U64(0x554E4954)
NUMBER_WORDS = ["one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "twenty",
                "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety", "hundred", "thousand", "million"]
UNITS = ["mm", "cm", "m", "km", "g", "kg", "mg", "lb", "lbs", "oz", "l", "ml", "mph", "kmh", "inch", "inches", "foot", "feet", "yard",
         "yards", "mile", "miles", "meter", "meters", "metre", "metres", "kilometer", "kilometers", "gram", "grams", "kilogram",
         "kilograms", "liter", "liters", "litre", "litres", "second", "seconds", "minute", "minutes", "hour", "hours", "day", "days",
         "week", "weeks", "month", "months", "year", "years", "dollar", "dollars", "euro", "euros", "cent", "cents", "percent", "degrees"]

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BREAKS = np.isin(np.arange(256), list(b".!?\n"))
_DIGIT = np.isin(np.arange(256), list(b"0123456789"))


def _hashes(listed):
    return np.sort(words(pa.array([" ".join(listed)])).hash)


_NUMBER_WORDS, _UNITS = _hashes(NUMBER_WORDS), _hashes(UNITS)


def template(texts: pa.Array):
    """(text index, template token, value, is literal) of all tokens of all texts, in order."""
    data, offsets = buffers(strings(texts, lower=False))
    low = _LOWER[data]
    # capital letters of the two-byte Latin block
    latin = np.zeros(len(data), bool)
    latin[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
    low[latin] += 0x20
    w = words_of(low, offsets, WORDS)
    if not len(w.hash):
        return np.zeros(0, np.int64), np.zeros(0, U64), np.zeros(0, U64), np.zeros(0, bool)
    of = w.text
    first = np.concatenate([[True], of[1:] != of[:-1]])
    breaks = np.concatenate([[0], np.cumsum(_BREAKS[data])])
    opens = first.copy()
    opens[1:] |= breaks[w.start[1:]] > breaks[w.end[:-1]]
    # one capital, at the start of more letters: words in capitals throughout are literal
    raised = np.concatenate([[0], np.cumsum(data != low)])
    lead = np.where(data[w.start] == 0xC3, 2, 1)
    capital = (raised[np.minimum(w.start + lead, w.end)] > raised[w.start]) & (raised[w.end] - raised[w.start] == 1) & (w.end - w.start > lead)
    digit = _DIGIT[data[w.start]]
    number = digit | np.isin(w.hash, _NUMBER_WORDS)
    # 1,234.5 is one number
    joined = np.zeros(len(of), bool)
    gap = w.start[1:] - w.end[:-1]
    joined[1:] = digit[1:] & digit[:-1] & ~first[1:] & (gap == 1) & np.isin(data[np.minimum(w.end[:-1], len(data) - 1)], list(b".,"))
    head = np.flatnonzero(~joined)
    value = np.add.reduceat(w.hash * (U64(1) + U64(2) * joined.astype(U64)), head)
    of, number, capital, opens, h = of[head], number[head], capital[head], opens[head], w.hash[head]
    unit = np.zeros(len(of), bool)
    unit[1:] = number[:-1] & (of[1:] == of[:-1]) & np.isin(h[1:], _UNITS) & ~number[1:]
    name = capital & ~opens & ~number & ~unit
    token = np.where(number, NUMBER, np.where(unit, UNIT, np.where(name, NAME, h)))
    return of, token, value, ~(number | unit | name)


def windows(texts: pa.Array, sizes: list[int], whole: bool = False):
    """(size, plain, token index, text index, place in its text, hash, function for a window's slots) of all windows, lazily.

    Each size comes twice: as templates, where enough words are literal, and ``plain``, with values for words and no slots.
    ``whole``: each text has the one size that fits it, ``WINDOW`` or all of its fewer tokens; the others
    get windows of all ``sizes``.
    """
    of, token, value, literal = template(texts)
    count = np.bincount(of, minlength=len(texts))
    first = np.concatenate([[0], np.cumsum(count)])
    held = np.concatenate([[0], np.cumsum(literal)])
    for size in sizes:
        if len(of) < size or size < 1:
            continue
        inside = of[:len(of) - size + 1] == of[size - 1:]
        if whole:
            inside &= np.minimum(count, WINDOW)[of[:len(inside)]] == size
        enough = held[size:] - held[:len(held) - size] >= np.ceil(LITERAL * size)
        for plain, tokens, salt, ok in ((False, token, U64(size), inside & enough), (True, value, PLAIN + U64(size), inside)):
            h = grams(tokens, size) ^ salt
            at = np.flatnonzero(ok)
            yield size, plain, at, of[at], at - first[of[at]], h[at], lambda i, n=size, plain=plain: [] if plain else value[i:i + n][~literal[i:i + n]].view(np.int64).tolist()


def _bench(items: DataFrame) -> DataFrame:
    schema = pa.schema([("window", pa.int64()), ("item_id", pa.int64()), ("plain", pa.bool_()), ("place", pa.int32()), ("slots", pa.list_(pa.int64())),
                        ("size", pa.int32()), ("windows", pa.int32())])

    def run(batches):
        for part in small(batches):
            for size, plain, at, of, place, h, slots in windows(part.column("text"), list(range(1, WINDOW + 1)), whole=True):
                n = np.bincount(of, minlength=part.num_rows)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), part.column("item_id").take(pa.array(of)), pa.array(np.full(len(at), plain)),
                                                  pa.array(place.astype(np.int32)), pa.array([slots(i) for i in at], pa.list_(pa.int64())),
                                                  pa.array(np.full(len(at), size, np.int32)), pa.array(n[of].astype(np.int32))], schema=schema)
    return items.select(F.col("item_id").cast("long"), "text").mapInArrow(run, "window long, item_id long, plain boolean, place int, slots array<long>, size int, windows int")


def longest_run(hits: list[dict]) -> tuple[int, bool]:
    """Most windows in line (by place) whose slots map one to one, and whether their values are the item's own.

    One pass: the run's start moves up past whatever contradicts the next window.
    """
    hits = sorted(hits, key=lambda w: w["place"])
    pairs = [list(zip(map(int, w["slots"]), map(int, w["values"]))) for w in hits]
    one_way, other_way = {}, {}
    best, same, low = 0, False, 0

    def fits(a, b):
        return one_way.get(a, (b,))[0] == b and other_way.get(b, (a,))[0] == a

    def count(a, b, by):
        for held, x, y in ((one_way, a, b), (other_way, b, a)):
            n = held.get(x, (y, 0))[1] + by
            if n:
                held[x] = (y, n)
            else:
                held.pop(x, None)

    for high, window in enumerate(pairs):
        if len({a for a, _ in window}) != len(set(window)) or len({b for _, b in window}) != len(set(window)):
            one_way, other_way, low = {}, {}, high + 1  # contradicts itself
            continue
        while not all(fits(a, b) for a, b in window):
            for a, b in pairs[low]:
                count(a, b, -1)
            low += 1
        for a, b in window:
            count(a, b, 1)
        found = len({w["place"] for w in hits[low:high + 1]})
        if found > best:
            best, same = found, all(a == held[0] for a, held in one_way.items())
    return best, same


def _longest_runs(hits: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([longest_run(h) for h in hits], columns=["found", "verbatim"])


def _probes(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (h & U64(FILTER_BITS - 1)).astype(np.int64), ((h >> U64(32)) & U64(FILTER_BITS - 1)).astype(np.int64)


def _filter(bench: DataFrame) -> np.ndarray:
    """Bits of the benchmark's windows; what reaches the driver is bounded by the filter's size."""
    w = F.col("window")
    at = F.explode(F.array(w.bitwiseAND(F.lit(FILTER_BITS - 1)), F.shiftrightunsigned(w, 32).bitwiseAND(F.lit(FILTER_BITS - 1))))
    got = bench.select(at.alias("p")).groupBy((F.col("p") / 8).cast("long").alias("b")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1), (F.col("p") % 8).cast("int"))).alias("v")).toArrow()
    out = np.zeros(FILTER_BITS // 8, np.uint8)
    out[got.column("b").to_numpy()] = got.column("v").to_numpy()
    return np.unpackbits(out, bitorder="little").view(bool)


def leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text, ...) and ``items`` (item_id, text, ...) -> row, doc_id, item_id, found, windows, kind.

    One row per document and leaked item: ``found`` of the item's ``windows`` in one alignment; ``kind`` is
    verbatim if all slots have the item's values, else reparameterised. ``row`` is xxhash64(doc_id, text), so
    rows that repeat an id are judged apart and rows repeated in full once. Null and empty texts have no windows,
    items without words cannot leak, empty tables give no rows. An item of fewer than ``WINDOW`` words is found
    wherever all of them stand. Templates and plain windows are counted apart; the larger count is shown.
    """
    bench = written(_bench(items), "bench-windows")
    sizes = sorted(r["size"] for r in bench.select("size").distinct().collect())  # at most WINDOW values
    bits = docs.sparkSession.sparkContext.broadcast(_filter(bench))
    schema = pa.schema([("window", pa.int64()), ("row", pa.int64()), ("doc_id", pa.int64()), ("at", pa.int32()), ("values", pa.list_(pa.int64()))])

    def run(batches):
        for part in small(batches):
            for _, _, at, of, place, h, slots in windows(part.column("text"), sizes):
                a, b = _probes(h)
                pick = np.flatnonzero(bits.value.take(a) & bits.value.take(b))
                of = pa.array(of[pick])
                yield pa.RecordBatch.from_arrays([pa.array(h[pick].view(np.int64)), part.column("row").take(of), part.column("doc_id").take(of),
                                                  pa.array(place[pick].astype(np.int32)), pa.array([slots(i) for i in at[pick]], pa.list_(pa.int64()))], schema=schema)
    rows = docs.select(F.xxhash64(F.col("doc_id").cast("long"), "text").alias("row"), F.col("doc_id").cast("long"), "text")
    hits = rows.mapInArrow(run, "window long, row long, doc_id long, at int, values array<long>").join(bench, "window")
    lines = hits.groupBy("row", "doc_id", "item_id", "plain", (F.col("at") - F.col("place")).alias("shift")).agg(
        F.collect_set(F.struct("place", "slots", "values")).alias("hits"), F.max("windows").alias("windows"))
    enough = lambda n: (n >= RUN) | (n >= SHARE * F.col("windows"))
    lines = lines.where(enough(F.size("hits"))).withColumn("run", F.pandas_udf(_longest_runs, "found int, verbatim boolean")("hits")).select(
        "row", "doc_id", "item_id", "windows", "run.*").where(enough(F.col("found")))
    return lines.groupBy("row", "doc_id", "item_id").agg(F.max("found").alias("found"), F.max("windows").alias("windows"),
                                                         F.when(F.max("verbatim"), "verbatim").otherwise("reparameterised").alias("kind"))


def decontaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` (any columns) without the rows that hold a benchmark item."""
    plain, restored = shielded(docs, ["doc_id", "text"])
    bad = written(leaks(plain, items).select("row").distinct(), "leaks")
    return restored(plain.withColumn("row", F.xxhash64(F.col("doc_id").cast("long"), "text")).join(bad, "row", "left_anti"))
