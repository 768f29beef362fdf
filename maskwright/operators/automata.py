"""Many strings sought in many texts in one pass, by Aho-Corasick automata.

A text is read once by an automaton of all strings, so its cost is that of its characters and hits, not that of the
strings or of how often a word occurs; nothing but hits leaves the row. Strings are told to tasks by broadcast, in
parts of at most AUTOMATON_BYTES: more strings are more automata, each run over the texts where they are.

An automaton finds candidates only: strings and texts are folded so far that whatever a case-insensitive pattern
matches stays a match, and the pattern decides.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .ranking import durable

AUTOMATON_BYTES = 16 << 20
#: What an entry's own fields need beside its strings.
OVERHEAD = 64

_GAP = re.compile(r"(?<=[0-9])[ \t\n\x0b\f\r-](?=[0-9])")
_SPACE = re.compile(r"\s+")


def fold(text: str) -> str:
    """Case, white space and what case mapping adds made one."""
    return _SPACE.sub(" ", text.upper().lower().replace("̇", "").replace("ς", "σ"))


def squeezed(text: str) -> str:
    """Without single spaces and hyphens between digits."""
    return _GAP.sub("", text)


def _is_word(c: str) -> bool:
    return c.isascii() and c.isalnum()


class Sought:
    """Entries (form, kind, scope and others) and their automata, which each worker builds once. kind: `digits` are sought
    among digits however spaced, `word` must not border on ASCII letters and digits, `text` may."""

    def __init__(self, entries: list[dict]):
        self.entries, self._built = entries, None

    def __getstate__(self):
        return {"entries": self.entries, "_built": None}

    def _automata(self) -> tuple:
        if self._built is None:
            forms: tuple[dict, dict] = ({}, {})
            for i, e in enumerate(self.entries):
                digits = e["kind"] == "digits"
                form = e["form"] if digits else fold(e["form"])
                if form:
                    forms[digits].setdefault(form, {}).setdefault(e.get("scope"), []).append(i)
            made = []
            for own in forms:
                a = ahocorasick.Automaton()
                for form, at in own.items():
                    a.add_word(form, (len(form), at))
                if own:
                    a.make_automaton()
                made.append(a if own else None)
            self._built = tuple(made)
        return self._built

    def found(self, text: str | None, scope: str | None) -> list[int]:
        """Which entries a text may hold."""
        if not text or not self.entries:
            return []
        out = {}
        scope = scope if "scope" in self.entries[0] else None  # a hit meets the entries of its scope, however many others have its form
        for automaton, read in zip(self._automata(), (fold, squeezed), strict=True):
            if automaton is None:
                continue
            whole = read(text)
            for end, (size, at) in automaton.iter(whole):
                if (own := at.get(scope)) is None:
                    continue
                free = not (end + 1 < len(whole) and _is_word(whole[end + 1]) or end >= size and _is_word(whole[end - size]))
                for i in own:
                    if free or self.entries[i]["kind"] != "word":
                        out[i] = True
        return list(out)


def total_bytes(entries: DataFrame) -> int:
    texts = [F.coalesce(F.octet_length(f.name), F.lit(0)) for f in entries.schema.fields if isinstance(f.dataType, T.StringType)]
    return entries.agg(F.coalesce(F.sum(sum(texts, F.lit(OVERHEAD)).cast("long")), F.lit(0))).first()[0]


def parts(entries: DataFrame, most: int = AUTOMATON_BYTES) -> Iterator[list[dict]]:
    """The entries in parts of about `most` bytes; no more of them are on the driver at once."""
    n = max(1, math.ceil(total_bytes(entries) / most))
    entries = durable(entries) if n > 1 else entries  # each part reads them
    for k in range(n):
        own = entries.where(F.pmod(F.xxhash64("form"), F.lit(n)) == k) if n > 1 else entries
        if rows := own.collect():
            yield [r.asDict() for r in rows]


def found_in(text: Column, entries: DataFrame, scope: Column | None = None, most: int = AUTOMATON_BYTES) -> Column:
    """array<struct> of the entries that a text may hold, each once; entries: form, kind, others that come out. With a
    scope, entries have one too and only those of the text's own count."""
    told = [f for f in entries.schema.fields if f.name not in ("form", "kind", "scope")]
    kind = T.ArrayType(T.StructType(told))
    arrow, names = to_arrow_type(kind), [f.name for f in told]
    out = F.array().cast(kind)
    for rows in parts(entries, most):
        scan = F.arrow_udf(_scan(entries.sparkSession.sparkContext.broadcast(Sought(rows)), names, arrow), kind)
        out = F.concat(out, scan(text, scope if scope is not None else F.lit(None).cast("string")))
    return out


def _scan(shared, names: list[str], arrow: pa.DataType):
    def run(texts: pa.Array, scopes: pa.Array) -> pa.Array:
        sought = shared.value
        hits = [sought.found(t, s) for t, s in zip(texts.to_pylist(), scopes.to_pylist(), strict=True)]
        return pa.array([[{n: sought.entries[i][n] for n in names} for i in h] for h in hits], arrow)

    return run
