"""Column helpers for pattern work: match spans, context windows, scans over arrays.

Everything here is a column expression, so it runs inside the scan stage: no shuffle, no Python
worker.  A document stays one row until its result rows are exploded at the very end.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# White space of Python's str.strip(); F.trim works on a set of characters.
BLANKS = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0         "
    "       　"
)

_SCAN_BLOCK = 256

# Takes the place of a match where texts are cut at matches; a text that holds it is cut by the pattern itself.
_MARK = "\ue000"

# Patterns without case take these for s, k and i; lower() does not make ASCII of the first three and adds a dot to the last.
_ODD_LETTERS, _PLAIN_LETTERS = "\u017f\u212a\u0131\u0130", "skii"


def _first_chars(nodes) -> tuple[set[str], bool]:
    """Characters that a match of a parsed pattern can begin with, and whether it can be empty; ValueError if any class is open."""
    chars: set[str] = set()
    for op, value in nodes:
        kind = str(op)
        if kind in ("AT", "ASSERT", "ASSERT_NOT"):
            continue
        if kind == "LITERAL":
            return chars | {chr(value)}, False
        if kind == "IN":
            for part, at in value:
                if str(part) not in ("LITERAL", "RANGE"):
                    raise ValueError(str(part))
                chars |= {chr(at)} if str(part) == "LITERAL" else {chr(c) for c in range(at[0], at[1] + 1)}
            return chars, False
        if kind == "BRANCH":
            found = [_first_chars(b) for b in value[1]]
        elif kind == "SUBPATTERN":
            found = [_first_chars(value[-1])]
        elif kind in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            found = [_first_chars(value[2])] + ([(set(), True)] if value[0] == 0 else [])
        else:
            raise ValueError(kind)
        chars = chars.union(*[f for f, _ in found])
        if not any(empty for _, empty in found):
            return chars, False
    return chars, True


@functools.cache
def _begin(pattern: str) -> str:
    """A look at the first character for patterns that begin with alternatives, options or a word boundary.

    These are tried at every character otherwise; a match begins with one of few characters, so nothing is lost.
    """
    try:
        nodes = list(re._parser.parse(pattern))
        chars, empty = _first_chars(nodes)
    except (re.error, ValueError):
        return ""
    if empty or len(chars) > 16 or str(nodes[0][0]) in ("LITERAL", "IN"):
        return ""
    return "(?=[" + "".join(c if c.isalnum() or ord(c) > 127 else "\\" + c for c in sorted(chars)) + "])"


def rx(pattern: str, flags: str = "i") -> str:
    """Java pattern with Unicode classes (U), newline as the only line end (d), and ``flags``."""
    return f"(?Ud{flags}){_begin(pattern)}{pattern}"


def strip(col: Column) -> Column:
    return F.trim(col, F.lit(BLANKS))


def squeeze(col: Column) -> Column:
    """White-space runs to one blank, then strip."""
    return strip(F.regexp_replace(col, rx(r"[\s\x1c-\x1f]+", ""), " "))


def folded(text: Column) -> Column:
    """Text in lower case, in which a pattern without case finds the words it finds in the text.

    A word that every match of a pattern holds is a substring of this, so a substring test is exact and costs a tenth.
    """
    odd = (F.octet_length(text) > F.length(text)) & contains_any(text, list(_ODD_LETTERS))
    return F.when(odd, F.lower(F.translate(text, _ODD_LETTERS, _PLAIN_LETTERS))).otherwise(F.lower(text))


def gated(when: Column, items: Column, ddl: str) -> Column:
    """``items`` where the cheap condition holds, else an empty array."""
    return F.when(when, items).otherwise(empty_array(ddl))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``body``; lambdas would otherwise re-evaluate it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def empty_array(ddl: str) -> Column:
    """Empty array of the given element type."""
    return F.from_json(F.lit("[]"), f"array<{ddl}>")


def scan(items: Column, start: Column, step: Callable[[Column, Column], Column], state_ddl: str) -> Column:
    """Running state after each element.

    Appending to one growing array costs n*n/2 copied references, so the fold works in blocks: the
    inner fold appends within a block, the outer one appends whole blocks.
    """

    def block(acc: Column, b: Column) -> Column:
        part = F.slice(items_ref[0], b * _SCAN_BLOCK + 1, F.lit(_SCAN_BLOCK))
        inner = F.aggregate(
            part,
            F.struct(acc["s"].alias("s"), empty_array(state_ddl).alias("o")),
            lambda a, x: let(step(a["s"], x), lambda s: F.struct(s.alias("s"), F.concat(a["o"], F.array(s)).alias("o"))),
        )
        return let(inner, lambda r: F.struct(r["s"].alias("s"), F.concat(acc["o"], F.array(r["o"])).alias("o")))

    items_ref: list[Column] = [items]

    def run(bound: Column) -> Column:
        items_ref[0] = bound
        blocks = F.sequence(F.lit(0), ((F.size(bound) - 1) / _SCAN_BLOCK).cast("int"))
        return F.aggregate(
            blocks,
            F.struct(start.cast(state_ddl).alias("s"), empty_array(f"array<{state_ddl}>").alias("o")),
            block,
            lambda a: F.flatten(a["o"]),
        )

    return F.when(F.size(items) > 0, let(items, run)).otherwise(empty_array(state_ddl))


def _span_ddl(groups: int) -> str:
    fields = ["start:int", "end:int", "hit:string"] + [f"g{i}:string" for i in range(1, groups + 1)]
    return "struct<" + ",".join(fields) + ">"


def gaps(text: Column, pattern: str) -> Column:
    """The text between matches, as ``split`` gives it.

    ``split`` compiles its pattern for every row, the replacement only once.
    """
    cut = F.split(F.regexp_replace(text, F.lit(pattern), F.lit(_MARK)), _MARK, -1)
    return F.when(text.contains(_MARK), F.split(text, pattern, -1)).otherwise(cut)


def spans(text: Column, pattern: str, groups: int = 0, when: Column | None = None) -> Column:
    """All matches with 0-based character offsets: array of (start, end, hit, g1, ..).

    There is no built-in that returns offsets.  :func:`gaps` gives the text between the matches that
    ``regexp_extract_all`` lists, so a match starts where the gaps and matches before it end.  Groups
    are read from the match itself.  A text without a match costs one scan, or none when the cheap
    condition ``when`` (some word every match holds) is false.  ``pattern`` must not match the empty
    string, and its look-arounds must not reach outside the match by more than a word boundary.
    """
    ddl = _span_ddl(groups)

    def located(hits: Column) -> Column:
        def with_gaps(between: Column) -> Column:
            sizes = F.transform(hits, lambda h, i: F.length(h) + F.length(F.get(between, i)))

            def rows(ends: Column) -> Column:
                return F.transform(hits, lambda h, i: F.struct(
                    (F.get(ends, i) - F.length(h)).alias("start"), F.get(ends, i).alias("end"), h.alias("hit"),
                    *[F.regexp_extract(h, pattern, g).alias(f"g{g}") for g in range(1, groups + 1)]))

            return let(scan(sizes, F.lit(0), lambda s, n: s + n, "int"), rows)

        return F.when(F.size(hits) > 0, let(gaps(text, pattern), with_gaps)).otherwise(empty_array(ddl))

    found = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), located)
    return found if when is None else F.when(when, found).otherwise(empty_array(ddl))


def tagged_spans(text: Column, patterns: Sequence[tuple]) -> Column:
    """Spans of several (tag, pattern, groups[, when]) in one array of (tag, start, end, hit, g1, g2)."""
    ddl = "struct<tag:int,start:int,end:int,hit:string,g1:string,g2:string>"

    def tagged(tag: int, pattern: str, groups: int, when: Column | None = None) -> Column:
        none = F.lit(None)
        return F.transform(spans(text, pattern, groups, when), lambda s: F.struct(
            F.lit(tag).alias("tag"), s["start"].alias("start"), s["end"].alias("end"), s["hit"].alias("hit"),
            (s["g1"] if groups > 0 else none).alias("g1"), (s["g2"] if groups > 1 else none).alias("g2"))).cast(f"array<{ddl}>")

    return F.concat(*[tagged(*p) for p in patterns])


def window(text: Column, start: Column, end: Column) -> Column:
    """``text[start:end]`` with 0-based offsets clamped to the text (Python slice rules)."""
    lo = F.greatest(start, F.lit(0))
    return F.substring(text, lo + 1, F.greatest(end - lo, F.lit(0)))


def around(text: Column, span: Column, before: int, after: int) -> Column:
    return window(text, span["start"] - before, span["end"] + after)


def with_context(text: Column, pattern: str, n: int = 100) -> Column:
    """Matches with the text before, after and around them."""
    return F.transform(
        spans(text, pattern),
        lambda s: F.struct(
            s["start"].alias("start"), s["end"].alias("end"), s["hit"].alias("hit"),
            window(text, s["start"] - n, s["start"]).alias("context_before"),
            window(text, s["end"], s["end"] + n).alias("context_after"),
            around(text, s, n, n).alias("full_context"),
        ),
    )


def first_group(text: Column, pattern: str, group: int = 1) -> Column:
    """First match's group, null when there is no match."""
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, group))


def first_at(text: Column, pattern: str) -> Column:
    """0-based offset of the first match, null when there is none."""
    plain = F.when(text.rlike(pattern), F.length(F.element_at(F.split(text, pattern, 2), 1)))
    marked = let(F.locate(_MARK, F.regexp_replace(text, F.lit(pattern), F.lit(_MARK))), lambda at: F.when(at > 0, at - 1))
    return F.when(text.contains(_MARK), plain).otherwise(marked)


def any_of(text: Column, patterns: Sequence[tuple]) -> Column:
    """True when one of (flags, pattern[, words]) matches.

    ``words`` lists lower-case words of which every match holds one; a substring test costs a tenth
    of a pattern, so most texts are decided without running the pattern.
    """

    def test(low: Column) -> Column:
        hit = F.lit(False)
        for flags, p, *words in patterns:
            one = text.rlike(rx(p, flags))
            hit = hit | (contains_any(low, words[0]) & one if words else one)
        return hit

    return let(F.lower(text), test)


def first_case(subject: Column, cases: Sequence[tuple[str, Column]], default: str | None) -> Column:
    """``when`` chain: label of the first true condition."""
    chain = F.when(cases[0][1], F.lit(cases[0][0]))
    for label, cond in cases[1:]:
        chain = chain.when(cond, F.lit(label))
    return chain.otherwise(F.lit(default))


def contains_any(text: Column, words: Sequence[str]) -> Column:
    hit = F.lit(False)
    for w in words:
        hit = hit | text.contains(w)
    return hit


def literal_map(entries: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in entries.items() for x in kv])


def literal_strings(words: Sequence[str]) -> Column:
    return F.array(*[F.lit(w) for w in words]) if words else empty_array("string")


def first_per_key(items: Column) -> Column:
    """Keep the first element per ``key`` by ``ord``: elements are structs that start with (key, ord, ..).

    Sorts instead of testing every pair, so it stays n log n for a document with many matches.
    """
    ordered = F.array_sort(items)
    kept = let(ordered, lambda s: F.filter(
        s, lambda x, i: (i == 0) | (x["key"] != F.get(s, i - 1)["key"])))
    return kept


def explode_rows(
    df: DataFrame, items: Column, keep: Sequence, pos: str = "pos", total: str | None = None, flat: bool = True
) -> DataFrame:
    """One row per array element with its index (and the array's length as ``total``).

    The outer form is used on purpose: for the inner form the optimizer infers a ``size(..) > 0``
    filter and would evaluate the whole array expression a second time.  The length is put into the
    elements so that the array itself does not travel with every output row.
    """
    if total:
        items = let(items, lambda a: F.transform(a, lambda x: F.struct(F.size(a).alias("n"), x.alias("x"))))
    out = df.select(*keep, F.posexplode_outer(items).alias(pos, "_x")).where(F.col(pos).isNotNull())
    kept = [c for c in out.columns if c not in (pos, "_x")]
    if total:
        return out.select(*kept, pos, F.col("_x.n").alias(total), "_x.x.*" if flat else F.col("_x.x").alias("item"))
    return out.select(*kept, pos, "_x.*" if flat else F.col("_x").alias("item"))
