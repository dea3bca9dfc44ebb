"""Licence scans: tags and notices by Aho-Corasick, expressions by a shunting yard."""

from __future__ import annotations

import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.shared import WORD_BYTES, pieces, text_of, texts

# Notice phrases and their labels. The first three are the base phrases.
BASE_PHRASES = {
    "mit license": "mit",
    "apache license": "apache",
    "general public license": "gpl",
}
MORE_PHRASES = {
    "bsd license": "bsd",
    "isc license": "isc",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "boost software license": "boost",
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "creative commons": "cc",
    "licensed under cc by": "cc",
    "cc by nc": "cc-nc",
    "public domain": "public-domain",
    "all rights reserved": "reserved",
}
TAG = "spdx-license-identifier"
# Identifiers of the SPDX list in lower case, permissive ones and others.
PERMISSIVE = {
    "0bsd", "afl-3.0", "apache-1.1", "apache-2.0", "artistic-2.0", "blueoak-1.0.0", "bsd-1-clause", "bsd-2-clause", "bsd-2-clause-patent",
    "bsd-3-clause", "bsd-3-clause-clear", "bsd-4-clause", "bsl-1.0", "cc-by-3.0", "cc-by-4.0", "cc0-1.0", "curl", "ecl-2.0", "fsfap", "ftl",
    "hpnd", "icu", "ijg", "isc", "libpng-2.0", "libtiff", "mit", "mit-0", "ms-pl", "mulanpsl-2.0", "ncsa", "ofl-1.1", "openssl", "php-3.01",
    "postgresql", "psf-2.0", "python-2.0", "ruby", "tcl", "unicode-3.0", "unicode-dfs-2016", "unlicense", "upl-1.0", "vim", "w3c", "wtfpl", "x11", "zlib",
}
RESTRICTED = {
    "agpl-3.0", "agpl-3.0-only", "agpl-3.0-or-later", "apsl-2.0", "bsl-1.1", "cc-by-nc-4.0", "cc-by-nc-nd-4.0", "cc-by-nc-sa-4.0", "cc-by-nd-4.0",
    "cc-by-sa-3.0", "cc-by-sa-4.0", "cddl-1.0", "cddl-1.1", "cpl-1.0", "epl-1.0", "epl-2.0", "eupl-1.1", "eupl-1.2", "gfdl-1.3-only",
    "gfdl-1.3-or-later", "gpl-1.0-only", "gpl-2.0", "gpl-2.0-only", "gpl-2.0-or-later", "gpl-3.0", "gpl-3.0-only", "gpl-3.0-or-later", "ipl-1.0",
    "lgpl-2.0-only", "lgpl-2.0-or-later", "lgpl-2.1", "lgpl-2.1-only", "lgpl-2.1-or-later", "lgpl-3.0", "lgpl-3.0-only", "lgpl-3.0-or-later",
    "mpl-1.1", "mpl-2.0", "ms-rl", "odbl-1.0", "osl-3.0", "qpl-1.0", "sspl-1.0",
}
# Exceptions of the SPDX list in lower case.
EXCEPTIONS = {
    "autoconf-exception-2.0", "autoconf-exception-3.0", "bison-exception-2.2", "classpath-exception-2.0", "font-exception-2.0", "gcc-exception-2.0",
    "gcc-exception-3.1", "libtool-exception", "linux-syscall-note", "llvm-exception", "openjdk-assembly-exception-1.0", "qt-gpl-exception-1.0",
    "u-boot-exception-2.0", "universal-foss-exception-1.0",
}
PRECEDENCE = {"or": 1, "and": 2, "with": 3}

#: What a parsed tag, a broken tag and a notice add as evidence that a licence is stated.
WEIGHTS = {"tag": 0.9, "broken": 0.5, "notice": 0.6}

SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
    "score double, expressions string, permissive boolean"
)
EXPRESSION = re.compile(r"[ \t]*:?[ \t]*([A-Za-z0-9.+\-:() \t]*)")
TOKEN = re.compile(r"\(|\)|[A-Za-z0-9.+\-:]+|\S")


class BadExpression(ValueError):
    pass


def to_postfix(expression: str) -> list[str]:
    """Shunting yard over identifiers, parentheses, OR, AND and WITH (binding tightest)."""
    out, waiting, value_next = [], [], True
    for token in TOKEN.findall(expression):
        word = token.lower()
        if word == "(":
            if not value_next:
                raise BadExpression(expression)
            waiting.append(word)
        elif word == ")":
            if value_next:
                raise BadExpression(expression)
            while waiting and waiting[-1] != "(":
                out.append(waiting.pop())
            if not waiting:
                raise BadExpression(expression)
            waiting.pop()
        elif word in PRECEDENCE:
            if value_next:
                raise BadExpression(expression)
            while waiting and waiting[-1] != "(" and PRECEDENCE[waiting[-1]] >= PRECEDENCE[word]:
                out.append(waiting.pop())
            waiting.append(word)
            value_next = True
        else:
            if not value_next:
                raise BadExpression(expression)
            out.append(word)
            value_next = False
    if value_next or "(" in waiting:
        raise BadExpression(expression)
    return out + waiting[::-1]


def is_license(word: str) -> bool:
    """A listed identifier, also with a plus for later versions, or one of a document's own."""
    word = word.removesuffix("+")
    return word in PERMISSIVE or word in RESTRICTED or re.fullmatch(r"(documentref-[a-z0-9.\-]+:)?licenseref-[a-z0-9.\-]+", word) is not None


def read_expression(text: str) -> list[str]:
    """The longest expression that a text starts with, in postfix order.

    Identifiers must be listed, and an exception must follow WITH and nothing else. Where
    other words follow, an operator in front of them is theirs; a text that ends within an
    expression, or starts with none, is refused.
    """
    tokens, after_with, ended = [], False, True
    for token in TOKEN.findall(text):
        word = token.lower()
        if not (word in PRECEDENCE or word in ("(", ")") or (word in EXCEPTIONS if after_with else is_license(word))):
            ended = False
            break
        tokens.append(word)
        after_with = word == "with"
    for n in range(len(tokens), len(tokens) - 1 if ended else 0, -1):
        try:
            return to_postfix(" ".join(tokens[:n]))
        except BadExpression:
            continue
    raise BadExpression(text)


def evaluate(postfix: list[str]) -> tuple[frozenset[str], str, bool]:
    """Identifiers, the expression with full parentheses, and whether it can be met permissively."""
    values = []
    for token in postfix:
        if token not in PRECEDENCE:
            values.append((frozenset([token]), token, token.removesuffix("+") in PERMISSIVE))
            continue
        (b, right, q), (a, left, p) = values.pop(), values.pop()
        if token == "with":  # an exception only adds permissions
            values.append((a, f"({left} with {right})", p))
        else:
            values.append((a | b, f"({left} {token} {right})", p or q if token == "or" else p and q))
    return values[0]


def automaton(words) -> ahocorasick.Automaton:
    machine = ahocorasick.Automaton()
    for word, value in words:
        machine.add_word(word, value)
    machine.make_automaton()
    return machine


class Scanner:
    def __init__(self):
        self.base = {p: i for i, p in enumerate(BASE_PHRASES)}
        self.notices = automaton((f" {p} ", (p, label)) for p, label in {**BASE_PHRASES, **MORE_PHRASES, TAG.replace("-", " "): None}.items())
        self.tags = automaton([(TAG, len(TAG))])

    def scan(self, text: str) -> tuple:
        """The columns after doc_id; places are counted in words from 0."""
        words = text.encode().translate(WORD_BYTES).split()
        line = f" {b' '.join(words).decode()} "
        starts, base, labels, tagged = [], set(), set(), False
        for end, (phrase, label) in self.notices.iter(line):
            if label is None:
                tagged = True
                continue
            labels.add(label)
            if phrase in BASE_PHRASES:
                base.add(label)
                starts.append(end - len(phrase) - 1)
        kinds = ["notice"] * len(labels)
        expressions, free = [], []
        if tagged:
            lower = text.lower()
            for end, _ in self.tags.iter(lower):
                if len(lower) != len(text):  # lower-casing moved places: read the lowered text
                    found = EXPRESSION.match(lower, end + 1).group(1).strip()
                else:
                    found = EXPRESSION.match(text, end + 1).group(1).strip()
                try:
                    identifiers, written, permissive = evaluate(read_expression(found))
                except BadExpression:
                    kinds.append("broken")
                    continue
                kinds.append("tag")
                labels |= {f"spdx:{i}" for i in identifiers}
                expressions.append(written)
                free.append(permissive)
        miss = 1.0
        for kind in kinds:
            miss *= 1 - WEIGHTS[kind]
        places = [line.count(" ", 0, s + 1) - 1 for s in ([min(starts), max(starts)] if starts else [])]
        return (
            len(words), len(starts), *(places or [None, None]), ",".join(sorted(base)), ",".join(sorted(labels)),
            round(1 - miss, 12), "; ".join(sorted(set(expressions))), all(free) if free else None,
        )


_SCANNER: list[Scanner] = []


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Licence facts of every whole text, row by row and without a shuffle.

    Words are runs of ASCII letters in lower case, digits and non-ASCII characters. Base
    phrases are counted at all places where their words stand consecutively, overlapping
    ones too. Each tag is followed by a licence expression, the longest that its line goes on
    with, of listed identifiers and exceptions; identifiers become labels ``spdx:...``, a tag
    without an expression is broken and only raises the score. ``permissive``: all expressions can be met by permissive licences
    alone, null without one. ``score`` is one minus the product of the misses of independent
    pieces of evidence. Null and empty texts have no words, no labels and score 0; null ids
    and repeated rows are scanned as any other; other columns are not read.
    """

    def run(batches):
        if not _SCANNER:
            _SCANNER.append(Scanner())
        for piece in pieces(batches):
            rows = [_SCANNER[0].scan(t) for t in texts(piece.column(1))]
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.string(), pa.bool_()]
            names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "expressions", "permissive"]
            yield pa.RecordBatch.from_arrays([piece.column(0), *(pa.array(c, t) for c, t in zip(zip(*rows), types))], names=["doc_id", *names])

    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text_of(text_col).alias("text")).mapInArrow(run, SCHEMA)
