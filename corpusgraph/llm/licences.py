"""Licence statements: Aho-Corasick over notice phrases and identifier tags, a shunting-yard parser for licence expressions."""

import re

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .plainwords import plain_words
from .text import small

# Phrases as words in lower case, their labels, and how sure each makes a licence statement.
#: The base: its places are counted.
BASE = {
    "cc by": ("cc-by", 0.6),
    "general public license": ("gpl", 0.7),
    "all rights reserved": ("reserved", 0.6),
}
NOTICES = {
    "affero general public license": ("agpl", 0.8),
    "lesser general public license": ("lgpl", 0.8),
    "library general public license": ("lgpl", 0.8),
    "general public license version 2": ("gpl-2.0", 0.8),
    "general public license version 3": ("gpl-3.0", 0.8),
    "mozilla public license": ("mpl", 0.8),
    "eclipse public license": ("epl", 0.8),
    "apache license": ("apache", 0.7),
    "apache license version 2 0": ("apache-2.0", 0.9),
    "bsd license": ("bsd", 0.7),
    "boost software license": ("bsl-1.0", 0.8),
    "isc license": ("isc", 0.7),
    "mit license": ("mit", 0.7),
    "zlib license": ("zlib", 0.7),
    "the unlicense": ("unlicense", 0.6),
    "cc0 1 0": ("cc0-1.0", 0.7),
    "cc by sa": ("cc-by-sa", 0.7),
    "cc by nc": ("cc-by-nc", 0.7),
    "cc by nd": ("cc-by-nd", 0.7),
    "cc by nc sa": ("cc-by-nc-sa", 0.7),
    "cc by nc nd": ("cc-by-nc-nd", 0.7),
    "creative commons attribution": ("cc-by", 0.7),
    "creative commons attribution sharealike": ("cc-by-sa", 0.8),
    "creative commons attribution noncommercial": ("cc-by-nc", 0.8),
    "dedicated to the public domain": ("public-domain", 0.7),
    "released into the public domain": ("public-domain", 0.7),
    "permission is hereby granted free of charge to any person obtaining a copy": ("mit", 0.9),
    "permission to use copy modify and or distribute this software for any purpose": ("isc", 0.9),
    "redistribution and use in source and binary forms": ("bsd", 0.9),
    "confidential and proprietary": ("proprietary", 0.7),
    "proprietary and confidential": ("proprietary", 0.7),
}
#: Tags that an expression follows, after a colon or an equals sign.
TAGS = ["spdx license identifier", "license expression"]
TAGGED = 0.95
#: Beginnings of identifiers and what they ask for; the longest one that fits counts.
TERMS = {
    "0bsd": "permissive", "afl": "permissive", "apache": "permissive", "artistic": "permissive", "blueoak": "permissive",
    "bsd": "permissive", "bsl": "permissive", "cc-by": "permissive", "cc0": "permissive", "curl": "permissive", "isc": "permissive",
    "mit": "permissive", "ncsa": "permissive", "openssl": "permissive", "postgresql": "permissive", "public-domain": "permissive",
    "python": "permissive", "unlicense": "permissive", "upl": "permissive", "wtfpl": "permissive", "x11": "permissive", "zlib": "permissive",
    "cddl": "weak", "epl": "weak", "lgpl": "weak", "mpl": "weak", "ms-rl": "weak",
    "agpl": "strong", "cc-by-sa": "strong", "eupl": "strong", "gpl": "strong", "osl": "strong",
    "busl": "restricted", "cc-by-nc": "restricted", "cc-by-nd": "restricted", "elastic": "restricted", "proprietary": "restricted",
    "reserved": "restricted", "sspl": "restricted",
}
#: From what asks least to what asks most.
ORDER = ["permissive", "weak", "strong", "unknown", "restricted"]
PRECEDENCE = {"or": 1, "and": 2, "with": 3}

_TOKEN = re.compile(r"[ \t]*(\(|\)|[A-Za-z0-9][A-Za-z0-9.+:_-]*)")
_MARK = re.compile(r"[ \t]*[\"']?[ \t]*[:=][ \t]*[\"']?")
_PART = re.compile(r"[-.+:]")


def terms(licence: str) -> str:
    """What a licence asks for: its longest beginning in ``TERMS``, ending at a mark; none: unknown."""
    whole = licence.rstrip("+")
    cuts = [m.start() for m in _PART.finditer(whole)] + [len(whole)]
    return next((TERMS[whole[:c]] for c in reversed(cuts) if whole[:c] in TERMS), "unknown")


def _operand(token: str, exception: bool) -> bool:
    """Licence identifiers are known, or hold a digit or a hyphen, which words of prose after a tag do not."""
    return exception or terms(token) != "unknown" or any(c.isdigit() or c == "-" for c in token)


def tokens(text: str, at: int = 0) -> list[str]:
    """Tokens in lower case of the longest whole expression that begins at ``at`` (may be none)."""
    got, whole, operand, depth = [], 0, True, 0
    while m := _TOKEN.match(text, at):
        token = m[1].lower()
        after_with = bool(got) and got[-1] == "with"
        if operand:
            if token == "(":
                if after_with:
                    break
                depth += 1
            elif token == ")" or token in PRECEDENCE or not _operand(token, after_with):
                break
            else:
                operand = False
        elif token == ")":
            if not depth:
                break
            depth -= 1
        elif token in PRECEDENCE:
            operand = True
        else:
            break
        got.append(token)
        at = m.end()
        if not operand and not depth:
            whole = len(got)
    return got[:whole]


def postfix(expression: list[str]) -> list[str]:
    """Operands and operators in the order of evaluation: with before and before or, from left to right."""
    out, waiting = [], []
    for token in expression:
        if token == "(":
            waiting.append(token)
        elif token == ")":
            while waiting[-1] != "(":
                out.append(waiting.pop())
            waiting.pop()
        elif token in PRECEDENCE:
            while waiting and waiting[-1] != "(" and PRECEDENCE[waiting[-1]] >= PRECEDENCE[token]:
                out.append(waiting.pop())
            waiting.append(token)
        else:
            out.append(token)
    return out + waiting[::-1]


def evaluated(expression: list[str]) -> tuple[str | None, list[str]]:
    """(terms, licences) of an expression: ``or`` lets one choose the least, ``and`` binds to the most, and ``with`` an
    exception strong terms become weak. Exceptions are no licences. No tokens: no terms."""
    stack, licences = [], []
    for token in postfix(expression):
        if token == "with":
            stack.pop()
            licences.pop()
            asked = stack.pop()
            stack.append("weak" if asked == "strong" else asked)
        elif token in PRECEDENCE:
            pair = stack.pop(), stack.pop()
            stack.append((min if token == "or" else max)(pair, key=ORDER.index))
        else:
            stack.append(terms(token))
            licences.append(token)
    return (stack[0] if stack else None), licences


def automaton() -> ahocorasick.Automaton:
    """Phrases and tags between spaces; each entry: (words, label, base, sure), a tag has no label."""
    found = ahocorasick.Automaton()
    for table, base in ((NOTICES, False), (BASE, True)):
        for phrase, (label, sure) in table.items():
            found.add_word(f" {phrase} ", (phrase.count(" ") + 1, label, base, sure))
    for tag in TAGS:
        found.add_word(f" {tag} ", (tag.count(" ") + 1, None, False, TAGGED))
    found.make_automaton()
    return found


_FIND = pa.struct([("word", pa.int64()), ("n_words", pa.int32()), ("label", pa.string()), ("base", pa.bool_()),
                   ("expression", pa.string()), ("terms", pa.string())])
FINDS = "array<struct<word: long, n_words: int, label: string, base: boolean, expression: string, terms: string>>"


def scanned(docs: DataFrame) -> DataFrame:
    """Licence statements of every row of ``docs`` (doc_id, text, ...): doc_id, n_words, finds, score.

    Words are digits, letters and non-ASCII characters in ASCII lower case, so line breaks, hyphens and case do not hide
    a phrase; ``word`` counts from 0. A phrase gives one find at each of its places, also where phrases overlap; a tag
    gives one find per licence of its expression, with the expression and what it asks for, and none where no expression
    follows. ``score`` is 1 - the product of (1 - how sure a label is) over the distinct labels, 0 without finds. Null and
    empty texts have no words and no finds; texts are scanned whole, whatever their length; rows that repeat are scanned
    each; other columns are ignored; an empty table gives no rows.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("finds", pa.list_(_FIND)), ("score", pa.float64())])

    def run(batches):
        phrases = automaton()
        for part in small(batches):
            w = plain_words(part.column("text"))
            finds, scores = [], []
            for n, (a, b) in enumerate(zip(w.first, w.first[1:])):
                # one character a byte: places in the string are places in the buffer
                spaced, own, sure, raw = " " + w.data[w.start[a]:w.start[b]].tobytes().decode("latin-1"), [], {}, None
                for end, (size, label, base, much) in phrases.iter(spaced):
                    last = int(np.searchsorted(w.start, w.start[a] + end)) - 1
                    word = last - size + 1 - int(a)
                    if label:
                        own.append((word, size, label, base, None, terms(label)))
                        sure[label] = max(much, sure.get(label, 0))
                        continue
                    raw = raw or part.column("text")[n].as_py().encode().decode("latin-1")
                    if mark := _MARK.match(raw, int(w.raw[last] + w.start[last + 1] - 1 - w.start[last])):
                        expression = tokens(raw, mark.end())
                        asked, licences = evaluated(expression)
                        for licence in dict.fromkeys(licences):
                            own.append((word, size, licence, False, " ".join(expression), asked))
                            sure[licence] = max(much, sure.get(licence, 0))
                finds.append([dict(zip(("word", "n_words", "label", "base", "expression", "terms"), f)) for f in sorted(own, key=lambda f: f[:3])])
                scores.append(1 - float(np.prod([1 - sure[k] for k in sorted(sure)])))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(w.count), pa.array(finds, pa.list_(_FIND)), pa.array(scores, pa.float64())], schema=schema)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, f"doc_id long, n_words long, finds {FINDS}, score double")


def summarised(scans: DataFrame) -> DataFrame:
    """One row per scan: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, terms.

    The words are the starts of base phrases; label lists are distinct, sorted and joined by commas, empty without finds.
    ``terms`` is what the statements of a document ask for together: the most of any.
    """
    base = F.filter("finds", lambda f: f["base"])
    words = F.transform(base, lambda f: f["word"])
    joined = lambda finds: F.concat_ws(",", F.array_sort(F.array_distinct(F.transform(finds, lambda f: f["label"]))))
    rank = F.array(*[F.lit(t) for t in ORDER])
    most = F.array_max(F.transform("finds", lambda f: F.array_position(rank, f["terms"])))
    return scans.select("doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(words).alias("first_word"),
                        F.array_max(words).alias("last_word"), joined(base).alias("base_labels"), joined(F.col("finds")).alias("labels"),
                        "score", F.try_element_at(rank, most.cast("int")).alias("terms"))
