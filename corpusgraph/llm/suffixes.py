"""Repeated passages across documents: sparse suffix arrays over content-selected positions.

1. Anchors: in every ``LENGTH`` words in a row, the position whose ``GRAM`` words have the smallest hash
   (a minimiser). Equal passages select equal anchors, about one position in eighteen is one.
2. Only anchors whose gram occurs more than once keep a suffix: the words after it and those before it.
3. The suffixes are sorted by range partitioning, so copies of one passage spread over many tasks, and each is
   compared with its nearest neighbours of other documents: forward to the first difference, then backward. A second
   order, by the words before the anchor, finds partners that are closest backwards.
4. A match of ``LENGTH`` words or more is a repeated span; spans of a document are united.
5. What neighbours leave open is settled by equality. What the first suffix past the neighbours shares in each order
   bounds what any partner past them can show; if that could widen the span, or if the anchor stands for others of a
   chain, all windows of ``LENGTH`` words at the anchors of this gram are grouped by hash, and those of two rows are spans.

A passage of ``LENGTH`` words that two documents share holds a common anchor by construction, at most
LENGTH - GRAM words from its start, so it is found by neighbours or by the equality of its windows.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from corpusgraph.functions.tables import written

from .text import U64, grams, mix, small, strings, words

LENGTH, GRAM = 50, 16
#: Words of a suffix that are kept after and before its anchor; longer matches are united from several anchors.
AFTER, BEFORE = 64, 48
#: Suffixes of other documents that each suffix is compared with, on each side and in each order.
NEIGHBOURS = 6
#: Words of a chain of one repeated gram for which one anchor stands.
HALF = (LENGTH - GRAM + 1) // 2


def _sliding(v: np.ndarray, width: int, combine) -> np.ndarray:
    """``combine`` over each ``width`` values in a row, by doubling."""
    out, have = v, 1
    while have < width:
        step = min(have, width - have)
        out = combine(out[:len(out) - step], out[step:])
        have += step
    return out


def anchors(w) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the anchors of all texts of ``w``, and whether one stands for more in the ``HALF`` words from it
    on; texts of fewer than ``LENGTH`` words have none."""
    width = LENGTH - GRAM + 1
    h, of = w.hash, w.text
    if len(h) < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, bool)
    g = grams(h, GRAM)
    v = mix(g ^ U64(0x5EED))
    v[v == 0] = U64(1)
    inside = of[:len(v)] == of[GRAM - 1:]
    least = _sliding(v, width, np.minimum)
    fits = of[:len(least)] == of[LENGTH - 1:]
    least = np.where(fits, least, U64(0))
    padded = np.concatenate([np.zeros(width - 1, U64), least, np.zeros(width - 1, U64)])
    at = np.flatnonzero((_sliding(padded, width, np.maximum)[:len(v)] == v) & inside)
    # repeated words select the same gram over and over: of such a chain one in each half width stays
    linked = np.concatenate([[False], (v[at[1:]] == v[at[:-1]]) & (at[1:] - at[:-1] <= HALF) & (of[at[1:]] == of[at[:-1]])])[:len(at)]
    head = np.flatnonzero(~linked)
    bins = (at - np.repeat(at[head], np.diff(np.append(head, len(at))))) // HALF
    stays = ~linked | np.concatenate([[True], bins[1:] != bins[:-1]])[:len(at)]
    return at[stays], ~np.append(stays[1:], True)[:len(at)][stays]


_ANCHOR = pa.schema([("gram", pa.int64()), ("row", pa.int64()), ("place", pa.int32()), ("chain", pa.bool_())])
_CONTEXT = pa.schema([("after", pa.binary()), ("before", pa.binary()), ("row", pa.int64()), ("doc_id", pa.int64()), ("place", pa.int32()), ("words", pa.int32())])
_CONTEXT_SQL = "after binary, before binary, row long, doc_id long, place int, words int"
_MATCH = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("words", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("partner", pa.int64()),
                    ("place", pa.int32()), ("past", pa.int32())])
_MATCH_SQL = "row long, doc_id long, words int, start int, end int, partner long, place int, past int"
_WINDOW = pa.schema([("window", pa.int64()), ("row", pa.int64()), ("doc_id", pa.int64()), ("words", pa.int32()), ("starts", pa.list_(pa.int32()))])


def _found(docs: DataFrame) -> DataFrame:
    def run(batches):
        for part in small(batches):
            w = words(strings(part.column("text")))
            at, chain = anchors(w)
            of = w.text[at]
            yield pa.RecordBatch.from_arrays([pa.array(grams(w.hash, GRAM)[at].view(np.int64) if len(at) else np.zeros(0, np.int64)),
                                              part.column("row").take(pa.array(of)), pa.array((at - w.first[of]).astype(np.int32)), pa.array(chain)], schema=_ANCHOR)
    return docs.select("row", "text").mapInArrow(run, "gram long, row long, place int, chain boolean")


def _contexts(chosen: DataFrame) -> DataFrame:
    """Rows with text and ``places`` -> a suffix for each place. Words are 16-bit hashes, big-endian, so bytes sort as words do."""
    def run(batches):
        for part in small(batches):
            w = words(strings(part.column("text")))
            short = (w.hash >> U64(48)).astype(">u2")
            rows, ids = part.column("row").to_pylist(), part.column("doc_id").to_pylist()
            out = []
            for k, places in enumerate(part.column("places").to_pylist()):
                a, b = int(w.first[k]), int(w.first[k + 1])
                for p in places:
                    out.append((short[a + p:min(b, a + p + AFTER)].tobytes(), short[max(a, a + p - BEFORE):a + p][::-1].tobytes(), rows[k], ids[k], p, b - a))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(_CONTEXT)], schema=_CONTEXT)
    return chosen.mapInArrow(run, _CONTEXT_SQL)


def _matrix(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    raw = column.to_pylist()
    size = np.array([len(x) // 2 for x in raw])
    return np.frombuffer(b"".join(x.ljust(2 * width, b"\0") for x in raw), np.uint16).reshape(-1, width), size


def _prefix(m, size, i, j) -> np.ndarray:
    """Length of the common prefix of rows i and j."""
    other = m[i] != m[j]
    return np.minimum(np.where(other.any(1), other.argmax(1), m.shape[1]), np.minimum(size[i], size[j]))


def _matches(table, by: str) -> pa.RecordBatch:
    """The span of each suffix that its nearest neighbours of other rows share, for suffixes sorted by ``by``.

    All matches of a suffix hold its anchor, so their union is one span. ``past``: the most words in the order's
    direction that a suffix which was not compared can share. A suffix without a span (no partner) has its
    anchor's place as start and end, and is only given if ``past`` is not too small to matter.
    """
    n = table.num_rows
    row = table.column("row").to_numpy()
    run = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
    of = np.repeat(np.arange(len(run)), np.diff(np.append(run, n)))
    last, first = np.append(run[1:], n) - 1, run
    after, n_after = _matrix(table.column("after"), AFTER)
    before, n_before = _matrix(table.column("before"), BEFORE)
    place = table.column("place").to_numpy()
    start, end, partner = place.astype(np.int64).copy(), place.astype(np.int64).copy(), np.full(n, -1)
    key, n_key = (after, n_after) if by == "after" else (before, n_before)
    past = np.zeros(n, np.int64)

    def skipped(i, j):
        past[i] = np.maximum(past[i], _prefix(key, n_key, i, j))
    for step in range(-NEIGHBOURS - 1, NEIGHBOURS + 2):
        to = of + step
        has = (to >= 0) & (to < len(run)) & (step != 0)
        to = np.clip(to, 0, len(run) - 1)
        j = last[to] if step < 0 else first[to]
        if abs(step) > NEIGHBOURS:
            i = np.flatnonzero(has)
            skipped(i, j[i])
            continue
        i = np.flatnonzero(has & (row[j] != row) & (last[to] > first[to]))
        skipped(i, j[i] + (1 if step > 0 else -1))
        i = np.flatnonzero(has & (row[j] != row))
        j = j[i]
        forward = _prefix(after, n_after, i, j)
        backward = _prefix(before, n_before, i, j)
        ok = (forward >= GRAM) & (forward + backward >= LENGTH)
        i, j, forward, backward = i[ok], j[ok], forward[ok], backward[ok]
        start[i] = np.minimum(start[i], place[i] - backward)
        end[i] = np.maximum(end[i], place[i] + forward)
        partner[i] = j
    i = np.flatnonzero((partner >= 0) | (past >= (GRAM if by == "after" else 1)))
    take = lambda c, at: table.column(c).take(pa.array(at))
    return pa.RecordBatch.from_arrays([take("row", i), take("doc_id", i), take("words", i), pa.array(start[i].astype(np.int32)), pa.array(end[i].astype(np.int32)),
                                       table.column("doc_id").take(pa.array(partner[i], mask=partner[i] < 0)), take("place", i), pa.array(past[i].astype(np.int32))], schema=_MATCH)


def _edges(table) -> np.ndarray:
    """Rows that a border needs: those of as many documents at both ends as neighbours are compared, and one more."""
    row, n = table.column("row").to_numpy(), table.num_rows
    change = np.flatnonzero(row[1:] != row[:-1]) + 1
    if len(change) <= 2 * NEIGHBOURS:
        return np.arange(n)
    return np.concatenate([np.arange(change[NEIGHBOURS]), np.arange(change[-NEIGHBOURS - 1], n)])


def _sorted(suffixes: DataFrame, order: list[str], batch: int = 20_000) -> DataFrame:
    """Matches of neighbours when ``suffixes`` are sorted by ``order``.

    Tasks sort ranges and stream over them in batches; the few rows at the borders of batches and tasks
    are written and compared again among themselves.
    """
    def run(batches):
        held = None
        for got in batches:
            new = pa.Table.from_batches([got])
            held = new if held is None else pa.concat_tables([held, new])
            if held.num_rows >= batch:
                yield from emit(held.combine_chunks())
                held = None
        if held is not None and held.num_rows:
            yield from emit(held.combine_chunks())

    def emit(table):
        found = _matches(_one(table), order[0])
        yield _both(found, None)
        edge = _edges(_one(table))
        yield _both(None, _one(table).take(pa.array(edge)))
    ranged = suffixes.repartitionByRange(*order).sortWithinPartitions(*order)
    both = written(ranged.mapInArrow(run, f"{_MATCH_SQL.replace('end', 'stop')}, border struct<{_CONTEXT_SQL.replace(' ', ':').replace(',:', ',')}>"), "matches")
    border = both.where("border is not null").select("border.*")

    def again(batches):
        got = [b for b in batches if b.num_rows]
        if got:
            yield _matches(_one(pa.Table.from_batches(got)), order[0])
    # rows of borders only, a few for each task of the sort
    rest = border.repartition(1).sortWithinPartitions(*order).mapInArrow(again, _MATCH_SQL)
    return both.where("border is null").withColumnRenamed("stop", "end").drop("border").unionByName(rest)


def _one(table: pa.Table) -> pa.RecordBatch:
    table = table.combine_chunks()
    return pa.RecordBatch.from_arrays([c.chunk(0) if c.num_chunks else pa.array([], c.type) for c in table.columns], names=table.schema.names)


def _both(matches, border) -> pa.RecordBatch:
    n = matches.num_rows if matches is not None else border.num_rows
    cols = matches.columns if matches is not None else [pa.nulls(n, f.type) for f in _MATCH]
    kind = pa.struct(list(_CONTEXT))
    edge = pa.nulls(n, kind) if border is None else pa.StructArray.from_arrays(border.columns, fields=list(_CONTEXT))
    return pa.RecordBatch.from_arrays([*cols, edge], names=[*("stop" if c == "end" else c for c in _MATCH.names), "border"])


def _open(forward: DataFrame, backward: DataFrame) -> DataFrame:
    """row, place of the suffixes whose span a partner past the neighbours of both orders could widen."""
    both = forward.select("row", "place", "start", "end", F.col("past").alias("f"), F.lit(0).alias("b")).unionByName(
        backward.select("row", "place", "start", "end", F.lit(0).alias("f"), F.col("past").alias("b")))
    best = both.groupBy("row", "place").agg(*[F.max(c).alias(c) for c in ("f", "b", "end")], F.min("start").alias("start"))
    wider = (F.col("place") - F.col("b") < F.col("start")) | (F.col("place") + F.col("f") > F.col("end"))
    return best.where((F.col("f") >= GRAM) & (F.col("f") + F.col("b") >= LENGTH) & wider).select("row", "place")


def _windows(chosen: DataFrame) -> DataFrame:
    """Rows with text and ``places`` (place, chain) -> each different window of ``LENGTH`` words that holds one of these anchors, with its starts."""
    def run(batches):
        for part in small(batches):
            w = words(strings(part.column("text")))
            h = grams(w.hash, LENGTH) if len(w.hash) >= LENGTH else np.zeros(0, U64)
            rows, ids = part.column("row").to_pylist(), part.column("doc_id").to_pylist()
            for k, places in enumerate(part.column("places").to_pylist()):
                a, n = int(w.first[k]), int(w.first[k + 1] - w.first[k])
                p = np.array([x["place"] for x in places], np.int64)
                ends = p + np.where([x["chain"] for x in places], HALF, 1)
                change = np.zeros(n + 1, np.int64)
                np.add.at(change, np.maximum(p - (LENGTH - GRAM), 0), 1)
                np.add.at(change, np.minimum(ends, n), -1)
                at = np.flatnonzero(np.cumsum(change)[:n - LENGTH + 1] > 0)
                order = np.argsort(h[a + at], kind="stable")
                at, key = at[order], h[a + at[order]]
                cut = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])[:len(key)])
                starts = pa.ListArray.from_arrays(pa.array(np.append(cut, len(at)).astype(np.int32)), pa.array(at.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([pa.array(key[cut].view(np.int64)), pa.array([rows[k]] * len(cut), pa.int64()), pa.array([ids[k]] * len(cut), pa.int64()),
                                                  pa.array(np.full(len(cut), n, np.int32)), starts], schema=_WINDOW)
    return chosen.mapInArrow(run, "window long, row long, doc_id long, words int, starts array<int>")


def _settled(rows: DataFrame, found: DataFrame, open_: DataFrame) -> DataFrame:
    """Matches of all windows at the anchors whose gram has an open suffix or a chain."""
    needed = found.join(open_, ["row", "place"], "left_semi").select("gram").unionByName(found.where("chain").select("gram")).distinct()
    places = found.join(written(needed, "open-grams"), "gram").groupBy("row").agg(F.collect_list(F.struct("place", "chain")).alias("places"))
    held = written(_windows(rows.join(written(places, "open-places"), "row").select("row", "doc_id", "text", "places")), "windows")
    one = F.struct("row", "doc_id")
    shared = held.groupBy("window").agg(F.min(one).alias("a"), F.max(one).alias("b")).where("a.row != b.row")
    hits = held.join(shared, "window").withColumn("partner", F.when(F.col("a.row") == F.col("row"), F.col("b.doc_id")).otherwise(F.col("a.doc_id")))
    return hits.select("row", "doc_id", "words", F.explode("starts").alias("start"), "partner").withColumn("end", F.col("start") + LENGTH)


def repeated(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text, ...) -> doc_id, words, spans, repeated_words, partners for documents that share
    ``LENGTH`` words in a row or more with another row.

    ``spans``: array of (start, end) in words, united and in order; ``partners``: doc_ids of neighbours that
    showed them. Words are those of ``text.words``, case aside. Rows that repeat an id are told apart by their
    text; rows repeated in full are one. Null, empty and shorter texts give no row, nor does an empty table.
    """
    rows = docs.select(F.xxhash64(F.col("doc_id").cast("long"), "text").alias("row"), F.col("doc_id").cast("long"), "text")
    found = written(_found(rows).distinct(), "anchors")
    common = found.groupBy("gram").agg(F.min("row").alias("a"), F.max("row").alias("b")).where("a != b").select("gram")
    common = written(common, "grams")
    places = found.join(common, "gram").groupBy("row").agg(F.sort_array(F.collect_list("place")).alias("places"))
    chosen = rows.join(written(places, "places"), "row").select("row", "doc_id", "text", "places")
    suffixes = written(_contexts(chosen), "suffixes")
    forward, backward = (_sorted(suffixes, [by, "row", "place"]) for by in ("after", "before"))
    open_ = written(_open(forward, backward), "open")
    matches = forward.unionByName(backward).where("end > start").drop("place", "past").unionByName(_settled(rows, found.join(common, "gram"), open_))
    spans = matches.groupBy("row", "doc_id", "words").agg(
        F.sort_array(F.collect_set(F.struct("start", "end"))).alias("spans"), F.sort_array(F.collect_set("partner")).alias("partners"))
    united = F.aggregate("spans", F.array().cast("array<struct<start:int,end:int>>"), lambda done, s: F.when(
        (F.size(done) > 0) & (F.element_at(done, -1)["end"] >= s["start"]),
        F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(F.element_at(done, -1)["start"].alias("start"), F.greatest(F.element_at(done, -1)["end"], s["end"]).alias("end")))))
        .otherwise(F.concat(done, F.array(s))))
    return spans.withColumn("spans", united).select(
        "doc_id", "words", "spans", F.aggregate("spans", F.lit(0), lambda n, s: n + s["end"] - s["start"]).alias("repeated_words"), "partners")
