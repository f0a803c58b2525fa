"""One pass over a batch of source files: matches of the language's rules, their lines and the ends of their blocks.

Strings and comments are blanked once per file, at the same length. Brackets of the whole batch are then paired at once,
as numpy arrays over the characters of all files laid end to end, to any depth; a match is a pair of offsets.
"""

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

# ---- strings and comments ------------------------------------------------------

_LINE, _BLOCK = r"//[^\n]*+", r"/\*.*?(?:\*/|\Z)"
_DOUBLE, _SINGLE = r'"(?:[^"\\\n]|\\.)*+"', r"'(?:[^'\\\n]|\\.)*+'"
_CHARACTER = r"'(?:[^'\\\n]|\\[^\n']+)'"           # so that a lone apostrophe (a lifetime) begins nothing
_TEXT_BLOCK = r'"""(?:[^\\]|\\.)*?(?:"""|\Z)'
_BACKTICK = r"`(?:[^`\\]|\\.)*+`"
_C_LIKE = [_LINE, _BLOCK, _DOUBLE, _CHARACTER]
#: Strings and comments per language; tried in this order at each place.
LEXIS = {
    "python": [r"#[^\n]*+", r'"""(?:[^"\\]|\\.|"(?!""))*+"""', r"'''(?:[^'\\]|\\.|'(?!''))*+'''", _DOUBLE, _SINGLE],
    "javascript": [_LINE, _BLOCK, _DOUBLE, _SINGLE, _BACKTICK],
    "typescript": [_LINE, _BLOCK, _DOUBLE, _SINGLE, _BACKTICK],
    "java": [_LINE, _BLOCK, _TEXT_BLOCK, _DOUBLE, _CHARACTER],
    "kotlin": [_LINE, _BLOCK, _TEXT_BLOCK, _DOUBLE, _CHARACTER],
    "swift": [_LINE, _BLOCK, _TEXT_BLOCK, _DOUBLE],
    "csharp": [_LINE, _BLOCK, _TEXT_BLOCK, r'(?:@\$?|\$@)"(?:[^"]|"")*+"', _DOUBLE, _CHARACTER],
    "go": [*_C_LIKE, r"`[^`]*+`"],
    "rust": [_LINE, _BLOCK, r'\br(?P<fence>#*)".*?"(?P=fence)', _DOUBLE, _CHARACTER],
    "php": [_LINE, r"#(?!\[)[^\n]*+", _BLOCK, r'"(?:[^"\\]|\\.)*+"', r"'(?:[^'\\]|\\.)*+'"],
}
_LEXIS = {lang: re.compile("|".join(parts), re.S) for lang, parts in LEXIS.items()}
_COMMENTS = {"python": ("#",), "php": ("//", "#", "/*")}
QUOTE = "'"


def masked(code: str, language: str) -> str:
    """``code`` with every character of a string replaced by a quote and of a comment by a space, line ends in them too."""
    if language not in _LEXIS:
        return code
    comment = _COMMENTS.get(language, ("//", "/*"))
    return _LEXIS[language].sub(lambda m: (" " if m[0].startswith(comment) else QUOTE) * len(m[0]), code)


# ---- brackets ------------------------------------------------------------------


@dataclass
class Brackets:
    """Brackets of one kind over the characters of all files, in order."""
    at: np.ndarray      # place
    opens: np.ndarray   # opening?
    pair: np.ndarray    # place of the partner, -1 without one

    def close_of(self, place: int) -> int:
        """Place of the bracket that closes the one at ``place``, or -1."""
        if self._partner is None:
            self._partner = dict(zip(self.at.tolist(), self.pair.tolist()))
        return self._partner[place]

    def __post_init__(self):
        self._partner = None
        good = self.pair >= 0
        self._paired, self._open = self.at[good], np.append(0, np.cumsum(np.where(self.opens[good], 1, -1)))

    def around(self, places: np.ndarray) -> np.ndarray:
        """How many paired brackets of this kind are open at each place."""
        return self._open[np.searchsorted(self._paired, places)]


def brackets(chars: np.ndarray, starts: np.ndarray, open_: str, close: str) -> Brackets:
    """Pair brackets within each file: a closing one with the last open one before it; without one it counts for nothing."""
    at = np.flatnonzero((chars == ord(open_)) | (chars == ord(close)))
    opens = chars[at] == ord(open_)
    file = np.searchsorted(starts, at, side="right")
    total = np.cumsum(np.where(opens, 1, -1))
    # depth never falls below zero: lift each file by the least sum seen in it so far (files lie ever deeper, so that each starts anew)
    before = np.append(0, total)[np.searchsorted(at, starts[np.maximum(file - 1, 0)])] if len(at) else total
    own = total - before
    shift = file.astype(np.int64) * (2 * len(at) + 2)
    floor = np.minimum(np.minimum.accumulate(np.minimum(own, 0) - shift) + shift, 0)
    level = own - floor                                       # after each bracket
    lowest = np.append(0, floor[:-1])
    lowest[np.append(True, file[1:] != file[:-1])] = 0
    stray = ~opens & (floor < lowest)
    depth = np.where(opens, level - 1, level)
    pair = np.full(len(at), -1, np.int64)
    order = np.flatnonzero(~stray)
    order = order[np.lexsort((order, depth[order], file[order]))]
    a, b = order[:-1], order[1:]
    match = opens[a] & ~opens[b] & (depth[a] == depth[b]) & (file[a] == file[b])
    pair[a[match]], pair[b[match]] = at[b[match]], at[a[match]]
    return Brackets(at, opens, pair)


# ---- matches -------------------------------------------------------------------

HIT = pa.struct([("family", pa.string()), ("pos", pa.int32()), ("indent", pa.int32()), ("line", pa.int32()), ("end", pa.int32()),
                 ("body", pa.int32()), ("name", pa.string()), ("params", pa.string()), ("bases", pa.string()),
                 ("decorators", pa.list_(pa.string())), ("groups", pa.list_(pa.string()))])
HITS = ("array<struct<family:string,pos:int,indent:int,line:int,end:int,body:int,name:string,params:string,bases:string,"
        "decorators:array<string>,groups:array<string>>>")

_HEAD = re.compile(r"^([ \t]*)(?:async[ \t]+)?(def|class)[ \t]+(\w+)[ \t]*", re.M)
_DECORATOR = re.compile(r"^[ \t]*@[ \t]*((?:\w+\.)*)(\w+)[ \t]*$", re.M)
_SPACE = re.compile(r"[ \t]*")
_NESTED, _HEAD_END = re.compile(r"[(\[{]"), re.compile(r"[:(\[{]")
_SYMBOLS = ("function", "class")
#: Fields of a match while it is worked on: those of ``HIT`` in its order, then places. Many short-lived matches are made, so they are lists.
(FAMILY, POS, INDENT, LINE, END, BODY, NAME, PARAMS, BASES, DECORATORS, GROUPS, AT, STOP, HEAD, ARROW) = range(15)
#: Languages whose blocks end by indentation.
INDENTED = ("python", "ruby")


class Scan:
    """A batch of files and the matches found in it; places are offsets into all files laid end to end."""

    def __init__(self, codes: list, languages: list, rules: dict):
        self.codes = [c or "" for c in codes]
        self.starts = np.append(0, np.cumsum([len(c) for c in self.codes]))
        self.masks = [masked(c, lang) for c, lang in zip(self.codes, languages)]
        self.chars = _characters(self.masks)
        self.newlines = np.flatnonzero(_characters(self.codes) == 10)
        self.round, self.square, self.curly = (brackets(self.chars, self.starts, *p) for p in ("()", "[]", "{}"))
        self.text = np.flatnonzero((self.chars != 32) & ((self.chars < 9) | (self.chars > 13)))
        self.found = [[] for _ in self.codes]
        begins = self.starts.tolist()
        compiled = {lang: [_applied(rule) for rule in rules[lang]] for lang in set(languages) if lang in rules}
        for n, lang in enumerate(languages):
            if lang not in compiled:
                continue
            if lang == "python":
                self.found[n] += self._python_hits(n, begins[n])
            # Python's rules (imports) read the masked text, others the text as it is.
            code = self.masks[n] if lang == "python" else self.codes[n]
            for applied in compiled[lang]:
                applied(code, begins[n], self.found[n])
        every = [h for own in self.found for h in own]
        for h, line in zip(every, self.line(np.array([h[AT] for h in every], np.int64)).tolist()):
            h[LINE] = h[END] = line
        self._block_ends([(n, h) for n, own in enumerate(self.found) if languages[n] not in INDENTED for h in own if h[FAMILY] in _SYMBOLS])
        self._indent_ends([(n, h) for n, own in enumerate(self.found) if languages[n] in INDENTED for h in own if h[FAMILY] in _SYMBOLS], languages)

    @property
    def hits(self) -> list:
        """Matches of each file by the names of their fields."""
        return [[dict(zip(HIT.names, h)) for h in own] for own in self.found]

    def line(self, places) -> np.ndarray:
        """Line within its file of each place, from 1."""
        file = np.searchsorted(self.starts[:-1], places, side="right") - 1
        return np.searchsorted(self.newlines, places) - np.searchsorted(self.newlines, self.starts[file]) + 1

    # -- block ends

    def _block_ends(self, some: list):
        """Ends of the symbols whose blocks have braces: the closing one, or the end of the statement if there is no block."""
        if not some:
            return
        at, stop = (np.array([h[k] for _, h in some], np.int64) for k in (AT, STOP))
        file = np.array([n for n, _ in some])
        eof = self.starts[file + 1]
        # outside the brackets that are open where the match begins
        level = self.round.around(at) + self.square.around(at)
        opening = self.curly.at[self.curly.opens]
        semis, ends = np.flatnonzero(self.chars == ord(";")), np.flatnonzero(self.chars == 10)
        after = np.append(self.text, len(self.chars))[np.searchsorted(self.text, stop)]          # first character behind the match
        arrow = np.array([h[ARROW] for _, h in some])
        # a block is the first one that opens in the symbol's first line or behind it
        own_line = np.maximum(self.starts[file], np.append(0, self.newlines + 1)[np.searchsorted(self.newlines, at)])
        open_, semi = self._first(opening, np.where(arrow, stop, own_line), level, eof), self._first(semis, at, level, eof)
        over = self._first(ends, np.where(arrow, np.minimum(after, eof), stop), level, eof)
        # the next symbol that begins behind the match, not in a comment or string
        shown = np.sort(at[self._shown(at, stop)])
        following = np.minimum(np.append(shown, len(self.chars))[np.searchsorted(shown, stop)], eof)
        block = (open_ < np.minimum(np.minimum(semi, following), eof)) & (~arrow | (open_ == after))
        close = np.full(len(at), -1, np.int64)
        close[block] = self.curly.pair[np.searchsorted(self.curly.at, open_[block])]
        last = np.where(block, np.where(close >= 0, close, eof - 1), np.minimum(np.minimum(semi, over), np.maximum(eof - 1, at)))
        # a file that ends with a line end has one more, empty line
        line = np.where(block & (close < 0), self.line(np.maximum(eof - 1, 0)) + self._ends_open(eof), self.line(last))
        for (n, h), end in zip(some, line.tolist()):
            h[END] = max(end, h[LINE])

    def _ends_open(self, eof: np.ndarray) -> np.ndarray:
        """1 where the last character of a file is a line end."""
        return np.isin(eof - 1, self.newlines).astype(np.int64)

    def _first(self, places: np.ndarray, begin: np.ndarray, level: np.ndarray, none: np.ndarray) -> np.ndarray:
        """First of ``places`` at or behind each beginning that lies in no more round and square brackets than ``level``."""
        depth = self.round.around(places) + self.square.around(places)
        out = none.copy()
        for deep in np.unique(level):
            own = places[depth <= deep]
            mine = level == deep
            out[mine] = np.minimum(np.append(own, len(self.chars))[np.searchsorted(own, begin[mine])], none[mine])
        return out

    def _shown(self, at: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Whether a match ends in code: its last character is neither blanked nor part of a string."""
        last = np.maximum(stop - 1, at)
        raw = np.array([self.codes[n][p - self.starts[n]] for n, p in zip(np.searchsorted(self.starts[:-1], last, side="right") - 1, last)])
        return raw.view(np.uint32) == self.chars[last] if len(raw) else np.zeros(0, bool)

    # -- indentation

    def _lines(self, languages: list):
        """All lines of all files: first line of each file, and per line the indentation (-1: nothing but space) and whether
        it goes on from the line before (python: inside a string, or inside brackets that are closed later)."""
        file = np.searchsorted(self.starts, self.newlines, side="right") - 1
        last = np.arange(len(self.newlines)) + file                     # line that each line end ends
        first = np.searchsorted(self.newlines, self.starts[:-1]) + np.arange(len(self.codes))
        begin, end = np.empty(len(last) + len(first), np.int64), np.empty(len(last) + len(first), np.int64)
        begin[first], begin[last + 1] = self.starts[:-1], self.newlines + 1
        end[np.append(first[1:], len(end)) - 1], end[last] = self.starts[1:], self.newlines
        text = np.append(self.text, len(self.chars))[np.searchsorted(self.text, begin)]
        goes_on = np.zeros(len(begin), bool)
        goes_on[last + 1] = self.chars[self.newlines] == ord(QUOTE)
        for kind in (self.round, self.square, self.curly):
            goes_on |= kind.around(begin) > 0
        python = np.array([lang == "python" for lang in languages])
        goes_on &= np.repeat(python, np.diff(np.append(first, len(begin))))
        goes_on[first] = False
        return first, np.where(text < end, text - begin, -1), goes_on

    def _indent_ends(self, some: list, languages: list):
        """Ends of the symbols whose blocks are indented: before the next line that is not indented deeper than the first.
        Python's blocks end with their last line that holds anything, ruby's right before that line."""
        if not some:
            return
        first, indent, goes_on = self._lines(languages)
        count = len(indent)
        stop = np.repeat(np.append(first[1:], count), np.diff(np.append(first, count)))   # of each line: end of its file
        for n in sorted({n for n, _ in some}):
            stack = []
            until = int(first[n + 1]) if n + 1 < len(first) else count
            for i, (width, on) in enumerate(zip(indent[first[n]:until].tolist(), goes_on[first[n]:until].tolist()), int(first[n])):
                if width < 0 or on:
                    continue
                while stack and width <= stack[-1][0]:
                    stop[stack.pop()[1]] = i
                stack.append((width, i))
        filled = np.maximum.accumulate(np.where(indent >= 0, np.arange(count), -1))
        following = np.append(np.flatnonzero(indent >= 0), count)
        heads = self.line(np.array([h[HEAD] for _, h in some], np.int64)).tolist()
        for (n, h), head in zip(some, heads):
            top, own = int(first[n]), int(first[n]) + h[LINE] - 1
            below, end = top + head, int(stop[own])                     # first line under the header, line behind the block
            if languages[n] == "ruby":
                h[END] = end - top
                continue
            body = int(following[np.searchsorted(following, below)])
            if body < end:
                h[BODY], h[END] = int(indent[body]), int(filled[end - 1]) - top + 1
            else:
                h[END] = head

    # -- python

    def _python_hits(self, n: int, base: int) -> Iterator[list]:
        """``def`` and ``class`` statements: brackets to any depth, decorators, indentation."""
        code = self.masks[n]
        heads = list(_HEAD.finditer(code))
        if not heads:
            return
        begins = [m.start() for m in heads]
        decorators = [[] for _ in heads]
        for m in _DECORATOR.finditer(code):
            k = bisect_left(begins, m.start())
            if k < len(heads) and (not m[1] or heads[k][2] == "def"):
                decorators[k].append(m[2])
        for m, own in zip(heads, decorators):
            at, inner = m.end(), ""
            if code[at:at + 1] == "[":
                at = self._behind(base, code, at)
                at = _SPACE.match(code, at).end() if at else 0
            if at and code[at:at + 1] == "(":
                close = self._behind(base, code, at)
                inner, at = (self._flat(base, code, at + 1, close - 1), close) if close else ("", 0)
            elif at and m[2] == "def":
                at = 0
            colon = self._colon(base, code, at) if at else 0
            if not at or (m[2] == "class" and not colon):
                continue
            is_class = m[2] == "class"
            yield ["class" if is_class else "function", 0, len(m[1]), 0, 0, -1, m[3], "" if is_class else inner, inner if is_class else "",
                   own, [], base + m.start(2), base + at, base + (colon or at - 1), False]

    def _behind(self, base: int, code: str, at: int) -> int:
        """Place in the file behind the bracket that closes the one at ``at``; 0 if nothing does."""
        close = {"(": self.round, "[": self.square, "{": self.curly}[code[at]].close_of(base + at)
        return close - base + 1 if close >= 0 else 0

    def _flat(self, base: int, code: str, at: int, end: int) -> str:
        """Masked text in which everything in inner brackets is one ``!``."""
        inner, out, done = code[at:end], [], 0
        while m := _NESTED.search(inner, done):
            behind = self._behind(base, code, at + m.start()) - at
            out += [inner[done:m.start()], "!"]
            done = behind if 0 < behind <= len(inner) else m.end()
        return "".join(out) + inner[done:]

    def _colon(self, base: int, code: str, at: int) -> int:
        """Place of the colon that ends the header, outside brackets; 0 if there is none."""
        while m := _HEAD_END.search(code, at):
            if m[0] == ":":
                return m.start()
            at = self._behind(base, code, m.start()) or m.end()
        return 0


def _characters(texts: list) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)


_PATTERNS = {}


def _compiled(pattern: str) -> re.Pattern:
    if pattern not in _PATTERNS:
        _PATTERNS[pattern] = re.compile(pattern, re.M)
    return _PATTERNS[pattern]


def _applied(rule: dict):
    """Function that adds the matches of ``rule`` in one file; what depends on the rule alone is looked up once."""
    find, family, pos, count = _compiled(rule["pattern"]).finditer, rule["family"], rule["pos"], rule["groups"]
    name, params, bases = (rule[k] for k in ("name", "params", "bases"))

    def symbols(code: str, base: int, hits: list):
        for m in find(code):
            start, stop = m.span()
            hits.append([family, pos, 0, 0, 0, -1, (m[name] or "") if name else "", (m[params] or "") if params else "", (m[bases] or "") if bases else "",
                         [], [], base + start, base + stop, base + start, code.endswith("=>", start, stop)])

    def others(code: str, base: int, hits: list):
        for m in find(code):
            start, stop = m.span()
            hits.append([family, pos, 0, 0, 0, -1, "", (m[params] or "") if params else "", (m[bases] or "") if bases else "",
                         [], [g or "" for g in m.groups()[:count]], base + start, base + stop, base + start, False])

    return symbols if family in _SYMBOLS else others


#: Characters worked on at once.
PART = 1 << 20


def scanned(codes: pa.Array, languages: pa.Array, rules: dict) -> pa.Array:
    """Matches of each file; a null text has none. Long columns are worked on in parts of about ``PART`` characters."""
    codes, languages = codes.to_pylist(), languages.to_pylist()
    out, at = [], 0
    while at < len(codes):
        to, size = at + 1, len(codes[at] or "")
        while to < len(codes) and size + len(codes[to] or "") <= PART:
            size += len(codes[to] or "")
            to += 1
        out += Scan(codes[at:to], languages[at:to], rules).found
        at = to
    flat = [h for own in out for h in own]
    columns = list(zip(*flat)) or [()] * len(HIT)
    values = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, HIT)], fields=list(HIT))
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum([len(own) for own in out])), pa.int32()), values)
