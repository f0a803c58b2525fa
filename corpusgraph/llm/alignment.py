"""Alignment of two tokenizers over the same text by galloping intersection of the byte offsets at which their tokens end.

Tokenizer A is a byte-level BPE file that sees a space and the text; tokenizer B is a piece model that sees the text and
adds that space itself. The shorter of a text's two end lists drives an exponential and then binary search into the longer
one: common ends cut the tokens into groups, and differences of the ranks give the tokens that overlap.
"""

import hashlib
import json
import os
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from corpusgraph.functions.tables import written

from .text import small

#: Characters of texts' parts whose ids a worker remembers; beyond that it starts afresh.
REMEMBERED = 4_000_000
#: Pairs of ids that are sent to every task, at most (17 bytes each with its count); the others are joined by a shuffle.
SENT = 1 << 20
#: A space between characters that neither library takes for white space: no token of either side reaches over it.
_BLANK = "\\s\\x1c-\\x1f\\x85\\u180e\\u200b\\u2028\\u2029\\u2060\\ufeff"
_BEFORE_SPACE = re.compile(f"(?<=[^{_BLANK}])(?= [^{_BLANK}])")
_ODD_SPACE = re.compile(f" [{_BLANK}]|[{_BLANK}] ")
_EDGE = re.compile(f"[{_BLANK}]")
#: Bytes of texts or ids worked on at once, and characters of parts encoded at once.
_TEXT, _WHOLE = 1 << 19, 1 << 14


def _byte_of_character() -> dict[str, int]:
    """Byte-level vocabularies show each byte as a character: printable ones as themselves, the others from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(hidden)}


class ByteLevel:
    """Ids of a byte-level BPE file, special strings inside texts as plain text, and the bytes of each id."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        split = spec["pre_tokenizer"]
        self.splits_at_spaces = spec["normalizer"] is None and split["type"] == "ByteLevel" and split["use_regex"]
        of = _byte_of_character()
        words = {i: bytes(of[c] for c in w) for w, i in spec["model"]["vocab"].items()}
        for added in spec["added_tokens"]:
            words.setdefault(added["id"], added["content"].encode())
        self.bytes = [words.get(i, b"") for i in range(max(words) + 1)]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]


class Pieces:
    """Ids of a piece model, and the bytes of each id."""

    def __init__(self, path: str):
        import sentencepiece
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        # texts may be cut before a space if no piece has one behind another character, and nothing is rewritten
        self.splits_at_spaces = (not any("▁" in p.lstrip("▁") for p in pieces)
                                 and self.model.encode("  a  Ä² ", out_type=str)[-1] == "▁"
                                 and self.model.decode(self.model.encode("  a  Ä² ")) == "  a  Ä² ")

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


class Encoders:
    """Ids of texts under both tokenizers.

    Where neither tokenizer reaches over a space between two other characters, a text's ids are the ids of its parts, and
    parts are remembered; both are checked, and whole texts are encoded otherwise. A text whose tokens do not spell a space
    and the text on both sides has no tokens.
    """

    def __init__(self, a: str, b: str):
        self.sides = ByteLevel(a), Pieces(b)
        self.sizes = [np.array([len(w) for w in side.bytes], np.int64) for side in self.sides]
        self.spellings = [pa.array(side.bytes, pa.large_binary()) for side in self.sides]
        self.by_part = all(side.splits_at_spaces for side in self.sides)
        self._forget()

    def _spelt(self, texts: list[str]) -> list:
        """[ids of A, ids of B], or None, per text; each is encoded by itself."""
        out = []
        for text, *ids in zip(texts, *(side.encode(texts) for side in self.sides)):
            want = b" " + text.encode()
            same = all(b"".join(map(side.bytes.__getitem__, i)) == want for side, i in zip(self.sides, ids))
            out.append([np.array(i, np.int32) for i in ids] if same else None)
        return out

    def _forget(self):
        """No parts: each known part has a number, by which its ids are found in one array a side."""
        self.number, self.characters = {}, 0
        self.ids = [np.zeros(0, np.int32), np.zeros(0, np.int32)]
        self.begin = [np.zeros(1, np.int64), np.zeros(1, np.int64)]
        self.broken = np.zeros(0, bool)

    def _learn(self, parts: list[str]):
        plain = [p for p in parts if p and not _EDGE.match(p[0]) and not _EDGE.match(p[-1])] if self.by_part else []
        other = list(set(parts).difference(plain))
        # libraries need many times a text's size while they encode it
        steps = np.cumsum([len(p) for p in plain]) // _WHOLE
        cuts = [0, *(np.flatnonzero(np.diff(steps)) + 1).tolist(), len(plain)] if plain else [0]
        for some, joined in [(plain[a:b], True) for a, b in zip(cuts, cuts[1:])] + [(other, False)]:
            if not some:
                continue
            got = self._spelt_parts(some) if joined else self._spelt(some)
            broken = [False] * len(some)
            if isinstance(got, list):  # one by one
                none = np.zeros(0, np.int32)
                broken = [g is None for g in got]
                pairs = [g or (none, none) for g in got]
                got = [(np.concatenate([p[s] for p in pairs]), np.cumsum([len(p[s]) for p in pairs])) for s in (0, 1)]
            for s in (0, 1):
                self.begin[s] = np.append(self.begin[s], len(self.ids[s]) + got[s][1])
                self.ids[s] = np.append(self.ids[s], got[s][0])
            self.broken = np.append(self.broken, broken)
            self.number.update(zip(some, range(len(self.number), len(self.number) + len(some))))
            self.characters += sum(map(len, some))

    def _spelt_parts(self, parts: list[str]):
        """Per side (ids, end of each part in them): parts with a space before each are encoded end to end, as both sides
        have a border before such a space. If the result does not show that, the parts are encoded one by one."""
        whole = " ".join(parts)
        want = np.frombuffer(b" " + whole.encode(), np.uint8)
        borders = np.cumsum([len(p.encode()) + 1 for p in parts])
        sides = []
        for side, spelling, sizes in zip(self.sides, self.spellings, self.sizes):
            ids = np.array(side.encode([whole])[0], np.int32)
            ends = np.cumsum(sizes[ids])
            cuts = np.searchsorted(ends, borders)
            if not len(ids) or ends[-1] != len(want) or (ends[cuts] != borders).any() or not np.array_equal(_joined(spelling, ids), want):
                return self._spelt(parts)
            sides.append((ids, cuts + 1))
        return tuple(sides)

    def _parts(self, text: str) -> list[str]:
        """The text is these parts, joined by spaces."""
        if not self.by_part:
            return [text]
        if _ODD_SPACE.search(text) or _EDGE.match(text[0]) or _EDGE.match(text[-1]):
            return [p[1:] for p in _BEFORE_SPACE.split(" " + text)]
        return text.split(" ")

    def encode(self, texts: list) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Per side: ids of all texts end to end, and how many each text has (null: none)."""
        if self.characters > REMEMBERED:
            self._forget()
        own, parts = [], []
        for text in texts:
            cut = self._parts(text) if text else []
            own.append(len(cut))
            parts += cut
        self._learn(list(set(parts).difference(self.number)))
        numbers = np.fromiter(map(self.number.__getitem__, parts), np.int64, len(parts))
        first = np.append(0, np.cumsum(own))
        bad = np.diff(np.append(0, np.cumsum(self.broken[numbers]))[first]) > 0
        ids, counts = [], []
        for s in (0, 1):
            n = np.diff(self.begin[s])[numbers]
            total = np.append(0, np.cumsum(n))
            ids.append(self.ids[s][np.repeat(self.begin[s][numbers] - total[:-1], n) + np.arange(total[-1])])
            counts.append(np.diff(total[first]))
        if bad.any():  # parts that do not spell their text: the whole text decides
            again = iter(self._spelt([texts[i] for i in np.flatnonzero(bad)]))
            none = np.zeros(0, np.int32)
            cut = [np.split(ids[s], np.cumsum(counts[s])[:-1]) for s in (0, 1)]
            whole = [(next(again) or (none, none)) if b else (cut[0][i], cut[1][i]) for i, b in enumerate(bad)]
            ids = [np.concatenate([w[s] for w in whole]) for s in (0, 1)]
            counts = [np.array([len(w[s]) for w in whole]) for s in (0, 1)]
        return ids, counts


def _joined(spelling: pa.Array, ids: np.ndarray) -> np.ndarray:
    """Bytes of the ids end to end."""
    data = spelling.take(pa.array(ids)).buffers()[2]
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)


_ENCODERS = {}


def encoders(a: str, b: str) -> Encoders:
    if (a, b) not in _ENCODERS:
        _ENCODERS[a, b] = Encoders(a, b)
    return _ENCODERS[a, b]


def galloped(keys: np.ndarray, begin: np.ndarray, end: np.ndarray, hint: np.ndarray, longer: np.ndarray) -> np.ndarray:
    """Index of the first entry of ``longer[begin:end]`` that is not below each key.

    ``longer`` ascends within each range, and its last entry is no smaller than the key. From ``hint`` the step doubles, up or
    down, until the entry is enclosed; then the enclosure is halved. All keys advance together, and only open ones.
    """
    at = np.clip(hint, begin, end - 1)
    low, high = at.copy(), at.copy()          # low: below the key or the beginning; high: not below it
    up = longer[at] < keys
    for rising in (True, False):
        open_, step = np.flatnonzero(up == rising), 1
        while len(open_):
            if rising:
                high[open_] = np.minimum(low[open_] + step, end[open_] - 1)
                more = longer[high[open_]] < keys[open_]
                low[open_] = np.where(more, high[open_], low[open_])
            else:
                low[open_] = np.maximum(high[open_] - step, begin[open_])
                more = (longer[low[open_]] >= keys[open_]) & (low[open_] > begin[open_])
                high[open_] = np.where(more, low[open_], high[open_])
            open_, step = open_[more], step * 2
    low = np.where(longer[low] >= keys, low, low + 1)
    low = np.minimum(low, high)
    open_ = np.flatnonzero(low < high)
    while len(open_):
        middle = (low[open_] + high[open_]) >> 1
        below = longer[middle] < keys[open_]
        low[open_] = np.where(below, middle + 1, low[open_])
        high[open_] = np.where(below, high[open_], middle)
        open_ = open_[low[open_] < high[open_]]
    return high


def _local(first: np.ndarray) -> np.ndarray:
    """Index within its text of each token."""
    return np.arange(first[-1]) - np.repeat(first[:-1], np.diff(first))


def intersected(ends: list[np.ndarray], firsts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Ends of both sides' tokens (bytes within the text) and each text's first token per side ->

    for each token of A the first token of B that it overlaps (index over all texts), and how many. Both sides of a text
    end at the same byte.
    """
    counts = [np.diff(f) for f in firsts]
    begin_of = np.zeros(len(ends[0]), np.int64)  # first token of B that each token of A overlaps
    end_of = np.zeros(len(ends[0]), np.int64)    # and the last
    a_short = counts[0] <= counts[1]
    for s, driven in ((0, a_short), (1, ~a_short)):
        text = np.repeat(np.arange(len(driven)), counts[s])
        mine = np.flatnonzero(driven[text])
        text = text[mine]
        if not len(mine):
            continue
        begin, end = firsts[1 - s][text], firsts[1 - s][text + 1]
        hint = begin + _local(firsts[s])[mine] * counts[1 - s][text] // counts[s][text]
        rank = galloped(ends[s][mine], begin, end, hint, ends[1 - s])
        common = ends[1 - s][rank] == ends[s][mine]
        # a token begins where the one before it ends: behind a common end, or inside the token that end falls into
        start = np.where(mine == firsts[s][text], begin, np.append(0, (rank + common)[:-1]))
        if s == 0:
            begin_of[mine], end_of[mine] = start, rank
        else:
            # ranges of the driving B tokens over A, turned round: a token of A begins in the last B token whose range
            # begins at or before it, unless that token ended there, and ends in the first whose range reaches it
            a = np.flatnonzero(~a_short[np.repeat(np.arange(len(driven)), counts[0])])
            begin_of[a] = mine[np.searchsorted(rank, a, side="left")]
            end_of[a] = mine[np.searchsorted(start, a, side="right") - 1]
    return begin_of, end_of - begin_of + 1


ROW = "row long, doc_id long, width int, a binary, b binary, overlaps binary"


def _packed(values: np.ndarray, counts: np.ndarray, kind: str) -> pa.Array:
    """Numbers of each text as one binary value."""
    data = values.astype(kind)
    offsets = np.append(0, np.cumsum(counts)) * data.itemsize
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)])


def aligned(docs: DataFrame, a: str, b: str) -> DataFrame:
    """Tokens of every row of ``docs`` (doc_id, text, ...) under two tokenizers (paths on every machine), and how they align.

    Columns: row (unique), doc_id, width (bytes of an id), a and b (ids, little endian), overlaps (two bytes for each token
    of A: twice the number of tokens of B that share a byte with it, plus 1 if it begins where a token of B begins, so that
    it opens a group). That is the whole alignment: the first token of B that a token of A overlaps is the last one that the
    token before it overlaps, or the next one where a group opens. ``arrays`` gives the same as lists.
    Null and empty texts, and texts that either side cannot spell (space and text), have no tokens; very long texts are
    aligned whole, other columns are ignored, rows that repeat are aligned each, an empty table gives no rows.
    """
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("width", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("overlaps", pa.binary())])

    def run(batches):
        both = encoders(a, b)
        width = 2 if max(map(len, both.sizes)) <= 1 << 16 else 4
        for part in small(batches, limit=_TEXT):
            ids, counts = both.encode(part.column("text").to_pylist())
            firsts = [np.append(0, np.cumsum(c)) for c in counts]
            ends = []
            for s in (0, 1):
                total = np.append(0, np.cumsum(both.sizes[s][ids[s]]))
                ends.append(total[1:] - np.repeat(total[firsts[s][:-1]], counts[s]))
            begin, overlaps = intersected(ends, firsts)
            opens = np.ones(len(begin), bool)
            opens[1:] = begin[1:] == begin[:-1] + overlaps[:-1]
            yield pa.RecordBatch.from_arrays([
                part.column("row"), part.column("doc_id"), pa.array(np.full(len(part), width, np.int32)), _packed(ids[0], counts[0], f"<u{width}"),
                _packed(ids[1], counts[1], f"<u{width}"), _packed(2 * overlaps + opens, counts[0], "<u2")], schema=schema)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(run, ROW)


def arrays(aligned: DataFrame) -> DataFrame:
    """row, doc_id, a, b, overlaps, opens of ``aligned`` as arrays."""
    def run(batches):
        for batch in batches:
            x = Aligned(batch)
            lists = lambda s, values: pa.ListArray.from_arrays(pa.array(x.first[s], pa.int32()), pa.array(values))
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), lists(0, x.ids[0].astype(np.int32)), lists(1, x.ids[1].astype(np.int32)),
                                              lists(0, x.overlaps.astype(np.int32)), lists(0, x.opens)], names=["row", "doc_id", "a", "b", "overlaps", "opens"])
    return aligned.mapInArrow(run, "row long, doc_id long, a array<int>, b array<int>, overlaps array<int>, opens array<boolean>")


class Aligned:
    """The columns of an Arrow batch of ``aligned`` as flat arrays, and all links between tokens."""

    def __init__(self, batch: pa.RecordBatch):
        width = batch.column("width")[0].as_py() if len(batch) else 2
        self.ids, self.first = zip(*(self._flat(batch.column(c), width) for c in ("a", "b")))
        steps, _ = self._flat(batch.column("overlaps"), 2)
        self.overlaps, self.opens = (steps >> 1).astype(np.int64), (steps & 1).astype(bool)
        # first token of B under each token of A
        self.begin = np.cumsum(np.append(0, self.overlaps[:-1]) - np.append(False, ~self.opens[1:])) if len(steps) else np.zeros(0, np.int64)
        self.links = np.append(0, np.cumsum(self.overlaps))

    @staticmethod
    def _flat(values: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
        """All numbers, and each row's first one."""
        offsets = np.frombuffer(values.buffers()[1], np.int32)[values.offset:values.offset + len(values) + 1].astype(np.int64)
        data = values.buffers()[2]
        whole = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data is not None else np.zeros(0, np.uint8)
        return np.frombuffer(whole.tobytes(), f"<u{width}"), (offsets - offsets[0]) // width

    @property
    def linked_a(self) -> np.ndarray:
        """A's token of each link; links are ordered by it."""
        return np.repeat(np.arange(len(self.overlaps)), self.overlaps)

    @property
    def pairs(self) -> np.ndarray:
        """A's id in the upper and B's id in the lower half, per link."""
        a = self.linked_a
        b = self.begin[a] + np.arange(len(a)) - self.links[a]
        return (self.ids[0][a].astype(np.int64) << 32) | self.ids[1][b]

    @property
    def text(self) -> np.ndarray:
        """Text of each link."""
        return np.repeat(np.arange(len(self.first[0]) - 1), self.links[self.first[0][1:]] - self.links[self.first[0][:-1]])


def _tokens(batches):
    """Parts of Arrow batches with about ``_TEXT`` bytes of ids, one text at least."""
    return small(batches, column="a", limit=_TEXT, rows=1 << 16)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """pair (A's id in the upper half), count: how many rows hold it linked; best: whether no pair of the same A id has more.

    Every task sums its own pairs before they are shuffled.
    """
    def run(batches):
        for part in _tokens(batches):
            x = Aligned(part)
            pairs, where = np.unique(x.pairs, return_inverse=True)
            # links of one pair in one text follow each other after a stable sort by pair
            order = np.argsort(where, kind="stable")
            text, pair = x.text[order], where[order]
            fresh = np.ones(len(order), bool)
            fresh[1:] = (text[1:] != text[:-1]) | (pair[1:] != pair[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(np.bincount(pair[fresh], minlength=len(pairs)))], names=["pair", "count"])
    counts = written(aligned.select("width", "a", "b", "overlaps").mapInArrow(run, "pair long, count long")
                     .groupBy("pair").agg(F.sum("count").alias("count")), "pairs")
    top = counts.groupBy(F.shiftright("pair", 32).alias("id")).agg(F.max("count").alias("top"))
    return written(counts.join(F.broadcast(top), F.shiftright("pair", 32) == top["id"])  # one row per id of A's vocabulary
                   .select("pair", "count", (F.col("count") == F.col("top")).alias("best")), "pair-counts")


def _frequent(counts: DataFrame, most: int) -> int:
    """Smallest power of two such that at most ``most`` pairs are that frequent."""
    sizes = dict(counts.groupBy(F.floor(F.log2("count")).cast("int").alias("power")).count().collect())  # 64 rows at most
    power = 64
    while power and sum(n for p, n in sizes.items() if p >= power - 1) <= most:
        power -= 1
    return power


def groups_text(x: Aligned) -> tuple[pa.Array, np.ndarray]:
    """Decimal ids of all groups as pieces of text (``a1,a2|b1;a3|b2``), and each text's first piece."""
    n, m = len(x.ids[0]), len(x.ids[1])
    opens_a = np.append(x.opens, True)
    opens_b = np.zeros(m + 1, bool)
    opens_b[np.append(x.begin[x.opens], m)] = True
    group_a, group_b = np.cumsum(opens_a[:-1]) - 1, np.cumsum(opens_b[:-1]) - 1
    before_b, after_a = np.append(np.flatnonzero(opens_b[:-1]), m), np.append(np.flatnonzero(opens_a[:-1])[1:], n)
    # tokens of both sides in the order of the text: A's of a group, then B's
    code = np.empty(n + m, np.int64)
    last_b = np.zeros(m, bool)
    last_b[x.first[1][1:][np.diff(x.first[1]) > 0] - 1] = True
    # separators: 0 none, 1 comma, 2 bar, 3 semicolon
    code[np.arange(n) + before_b[group_a]] = x.ids[0].astype(np.int64) * 4 + np.where(opens_a[1:], 2, 1)
    code[np.arange(m) + after_a[group_b]] = x.ids[1].astype(np.int64) * 4 + np.where(last_b, 0, np.where(opens_b[1:], 3, 1))
    top = int(code.max()) // 4 + 1 if len(code) else 0
    return _decimals(top).take(pa.array(code)), x.first[0] + x.first[1]


_DECIMALS = {}


def _decimals(top: int) -> pa.Array:
    """Every id below ``top`` with each separator after it."""
    if top > len(_DECIMALS.get("all", ())) // 4:
        _DECIMALS["all"] = pa.array([f"{i}{mark}" for i in range(top) for mark in ("", ",", "|", ";")], pa.large_string())
    return _DECIMALS["all"]


def digests(aligned: DataFrame, counts: DataFrame, sent: int = SENT) -> DataFrame:
    """One row per row of a written ``aligned``: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    The most frequent pairs, ``sent`` at most, go to every task with their counts; links of other pairs, none of them in
    many texts, are counted by a join. Both ways add up to the same sums, wherever the border lies.
    """
    spark = aligned.sparkSession
    least = 2 ** _frequent(counts, sent)
    often = [c.to_numpy() for c in counts.where(F.col("count") >= least).select("pair", "count", "best").toArrow().columns]
    shared = spark.sparkContext.broadcast([c[np.argsort(often[0])] for c in often])
    schema = pa.schema([(c, pa.int64()) for c in ("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")]
                       + [("groups_sha256", pa.string()), ("rest", pa.list_(pa.int64()))])

    def run(batches):
        pairs, count, best = shared.value
        for part in _tokens(batches):
            x = Aligned(part)
            got, (fa, fb) = x.pairs, x.first
            at = np.minimum(np.searchsorted(pairs, got), max(0, len(pairs) - 1))
            known = pairs[at] == got if len(pairs) else np.zeros(len(got), bool)
            links = x.links[fa]
            sums = lambda v: np.diff(np.append(0, np.cumsum(v))[links])
            n_best = sums(best[at] & known if len(pairs) else known)
            total = sums(np.where(known, count[at], 0) if len(pairs) else known)
            rest = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(~known))[links], pa.int32()), pa.array(got[~known]))
            pieces, firsts = groups_text(x)
            data, ends = memoryview(pieces.buffers()[2] or b""), np.frombuffer(pieces.buffers()[1], np.int64)
            shas = [hashlib.sha256(data[ends[i]:ends[j]]).hexdigest() if j > i else "" for i, j in zip(firsts, firsts[1:])]
            groups = np.diff(np.append(0, np.cumsum(x.opens))[fa])
            yield pa.RecordBatch.from_arrays([part.column("row"), part.column("doc_id"), *(pa.array(v) for v in (
                np.diff(fa), np.diff(fb), groups, np.diff(links), n_best.astype(np.int64), total.astype(np.int64))), pa.array(shas), rest], schema=schema)
    fields = [f"{f.name} {'string' if f.name == 'groups_sha256' else 'array<long>' if f.name == 'rest' else 'long'}" for f in schema]
    partial = aligned.mapInArrow(run, ", ".join(fields))
    if least == 1:  # all pairs were sent
        return partial.drop("row", "rest")
    partial = written(partial, "partial")
    rare = partial.select("row", F.explode("rest").alias("pair")).join(counts.where(F.col("count") < least), "pair")
    more = rare.groupBy("row").agg(F.sum(F.col("best").cast("long")).alias("_best"), F.sum("count").alias("_count"))
    return partial.join(more, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", (F.col("n_best") + F.coalesce("_best", F.lit(0))).alias("n_best"),
        (F.col("count_sum") + F.coalesce("_count", F.lit(0))).alias("count_sum"), "groups_sha256")
