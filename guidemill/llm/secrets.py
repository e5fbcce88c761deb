"""Secret scan: base patterns plus formats learned by grammar inference.

The values found by the base patterns are labelled credentials.  Per kind their prefix tree is built over
character classes, and states whose continuations are statistically compatible (Hoeffding bound) are merged into
a probabilistic automaton.  Ordinary tokens give two more automata, one for those with a digit and one for those without.  Every remaining token is scored by its
likelihood per symbol under each credential format against the ordinary ones.  Every token of eight or more characters
of the credential alphabet is such a candidate, with or without a digit and of any length.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from statistics import mean, pstdev

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from guidemill.llm.common import map_text, materialize

KINDS = ("assign", "access", "hex")
LEARNED = "learned"
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # maximal runs, as [0-9a-f]+ takes them, of enough length
TOKEN = re.compile(r"[A-Za-z0-9+/_.=-]{8,}")
DIGIT = re.compile(r"[0-9]")
ORDINARY = ("with_digit", "without_digit")
FIT_VALUES, FIT_SYMBOLS = 1000, 1 << 18  # an automaton is fitted on no more values and symbols
KNOWN_TOKENS = 200_000
_CLASSES = str.maketrans({c: sign for signs in (("h", "abcdef"), ("l", "ghijklmnopqrstuvwxyz"), ("U", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), ("d", "0123456789"))
                          for sign in signs[0] for c in signs[1]})


def base_spans(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, credential) in order of start and kind; offsets are code points, end exclusive."""
    found = [("assign", m.start(), m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [("access", m.start(), m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    found += [("hex", m.start(), m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def candidates(text: str, base: list[tuple[str, int, int, str]]) -> Iterator[tuple[int, int, str]]:
    """(start, end, token) of the tokens that no base span touches."""
    taken: list[list[int]] = []
    for _, s, e, _ in base:
        if taken and s <= taken[-1][1]:
            taken[-1][1] = max(taken[-1][1], e)
        else:
            taken.append([s, e])
    at = 0
    for m in TOKEN.finditer(text):
        while at < len(taken) and taken[at][1] <= m.start():
            at += 1
        if not (at < len(taken) and taken[at][0] < m.end()):
            yield m.start(), m.end(), m[0]


def symbols(value: str) -> str:
    """Character classes: a-f, other lower case, upper case, digit; any other character stands for itself."""
    return value.translate(_CLASSES)


class Automaton:
    """Probabilistic automaton from a multiset of symbol strings by compatible-state merging."""

    def __init__(self, strings: Counter, alpha: float = 0.01):
        self.count, self.final, self.next = [0], [0], [{}]
        for value, times in sorted(strings.items()):
            at = 0
            self.count[0] += times
            for c in value:
                if c not in self.next[at]:
                    self.next[at][c] = self._state()
                at = self.next[at][c]
                self.count[at] += times
            self.final[at] += times
        self.slack = math.sqrt(0.5 * math.log(2 / alpha))
        self._merge_states()
        self._set_steps(strings)

    def _state(self) -> int:
        self.count.append(0)
        self.final.append(0)
        self.next.append({})
        return len(self.count) - 1

    def _differs(self, f1: int, n1: int, f2: int, n2: int) -> bool:
        return abs(f1 / n1 - f2 / n2) > self.slack * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))

    def _compatible(self, p: int, q: int) -> bool:
        todo = [(p, q)]
        while todo:
            p, q = todo.pop()
            if p == q:
                continue
            if self._differs(self.final[p], self.count[p], self.final[q], self.count[q]):
                return False
            for c in self.next[p].keys() | self.next[q].keys():
                a, b = self.next[p].get(c), self.next[q].get(c)
                if self._differs(self.count[a] if a is not None else 0, self.count[p], self.count[b] if b is not None else 0, self.count[q]):
                    return False
                if a is not None and b is not None:
                    todo.append((a, b))
        return True

    def _fold(self, p: int, q: int) -> None:
        """Add the subtree at q to state p; q is still a tree, so this ends."""
        todo = [(p, q)]
        while todo:
            p, q = todo.pop()
            self.count[p] += self.count[q]
            self.final[p] += self.final[q]
            for c, child in self.next[q].items():
                if c in self.next[p]:
                    todo.append((self.next[p][c], child))
                else:
                    self.next[p][c] = child

    def _merge_states(self) -> None:
        kept, seen = [0], {0}
        while True:
            border = [(self.count[child], -child, s, c) for s in kept for c, child in self.next[s].items() if child not in seen]
            if not border:
                return
            _, child, state, c = max(border)
            child = -child
            match = next((k for k in kept if self._compatible(k, child)), None)
            if match is None:
                kept.append(child)
                seen.add(child)
            else:
                self.next[state][c] = match
                self._fold(match, child)

    def _set_steps(self, strings: Counter) -> None:
        """Step and end probabilities from sending the strings through the merged automaton."""
        self.steps: list[Counter] = [Counter() for _ in self.next]
        self.visits, self.final = [0] * len(self.next), [0] * len(self.next)
        for value, times in strings.items():
            at = 0
            for c in value:
                self.visits[at] += times
                self.steps[at][c] += times
                at = self.next[at][c]
            self.visits[at] += times
            self.final[at] += times

    def likelihood(self, value: str) -> float:
        """Mean log probability per symbol, the end included; a step never seen counts as one of a thousand."""
        rare, at, total = math.log(1e-3), 0, 0.0
        for c in value:
            if at is not None and self.steps[at][c]:
                total += max(rare, math.log(self.steps[at][c] / self.visits[at]))
                at = self.next[at][c]
            else:
                total, at = total + rare, None
        total += rare if at is None or not self.final[at] else math.log(self.final[at] / self.visits[at])
        return total / (len(value) + 1)


def infer(values: list[str]) -> Automaton:
    return Automaton(Counter(symbols(v) for v in values))


class Formats:
    """Automata of the credential kinds and of ordinary tokens, with the likelihood each kind must reach.

    A token is a credential if it lies within three deviations of the labelled values of a kind, and its whole
    likelihood exceeds the ordinary ones by ``margin`` (a natural logarithm).  Ordinary tokens may hold some unlabelled credentials.
    """

    def __init__(self, labelled: dict[str, list[str]], ordinary: list[list[str]], margin: float = 2.0):
        self.margin = margin
        self.kinds = {}
        for kind, values in labelled.items():
            if len(values) >= 10:
                automaton = infer(values)
                scores = [automaton.likelihood(symbols(v)) for v in values]
                self.kinds[kind] = (automaton, mean(scores) - 3 * pstdev(scores))
        self.ordinary = [infer(values) for values in ordinary if values]
        self.known: dict[str, bool] = {}

    def _exceeds(self, text: str) -> bool:
        likely = [s for a, floor in self.kinds.values() for s in [a.likelihood(text)] if s >= floor]
        if not likely:
            return False
        usual = max((a.likelihood(text) for a in self.ordinary), default=math.log(1 / 26))
        return (max(likely) - usual) * (len(text) + 1) >= self.margin

    def is_credential(self, value: str) -> bool:
        """The judgement of a character-class string is kept for later tokens, in bounded memory."""
        text = symbols(value)
        found = self.known.get(text)
        if found is None:
            found = self._exceeds(text)
            if len(text) <= 64:
                if len(self.known) >= KNOWN_TOKENS:
                    self.known.clear()
                self.known[text] = found
        return found

    def learned_spans(self, text: str, base: list[tuple[str, int, int, str]]) -> list[tuple[int, int]]:
        if not self.kinds or not any(map(self.is_credential, set(TOKEN.findall(text)))):
            return []
        return [(s, e) for s, e, v in candidates(text, base) if self.is_credential(v)]


class Smallest:
    """Distinct values in the order of their hash, as many as the fitting takes; the rest is let go at once.

    Values longer than a sixteenth of the symbols are left out, so that ten values can always be held.
    """

    def __init__(self, most: int = FIT_VALUES, most_symbols: int = FIT_SYMBOLS):
        self.most, self.most_symbols = most, most_symbols
        self.held: dict[str, int] = {}
        self.cut, self.size = 1 << 64, 0

    def add(self, value: str) -> None:
        rank = xxhash.xxh64_intdigest(value) >> 1
        if rank <= self.cut and value not in self.held and len(value) <= self.most_symbols // 16:
            self.held[value] = rank
            self.size += len(value)
            if len(self.held) > 2 * self.most or self.size > 2 * self.most_symbols:
                self.first()

    def first(self) -> list[tuple[int, str]]:
        """Hash and value of those taken, by hash."""
        kept, total = [], 0
        for rank, value in sorted((rank, value) for value, rank in self.held.items()):
            if len(kept) == self.most or total + len(value) > self.most_symbols:
                self.cut = rank
                break
            kept.append((rank, value))
            total += len(value)
        self.held, self.size = {value: rank for rank, value in kept}, total
        return kept


def sample_values(docs: DataFrame, text_col: str, most: int = FIT_VALUES, most_symbols: int = FIT_SYMBOLS) -> DataFrame:
    """(kind, rank, value): per task the first values by hash of each credential kind and of ordinary tokens, from all whole texts."""

    def run(batches):
        held = {k: Smallest(most, most_symbols) for k in (*KINDS, *ORDINARY)}
        for batch in batches:
            for text in batch.column(text_col).to_pylist():
                base = base_spans(text or "")
                for kind, _, _, value in base:
                    held[kind].add(value)
                for value in {v for _, _, v in candidates(text or "", base)}:
                    held[ORDINARY[0] if DIGIT.search(value) else ORDINARY[1]].add(value)
        rows = [(k, rank, value) for k, s in held.items() for rank, value in s.first()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else ((), (), ()), (pa.string(), pa.int64(), pa.string()))], names=["kind", "rank", "value"])

    return docs.select(text_col).mapInArrow(run, "kind string, rank long, value string")


def fit_formats(docs: DataFrame, text_col: str = "text", most: int = FIT_VALUES, most_symbols: int = FIT_SYMBOLS) -> Formats:
    """Infer the automata from at most ``most`` distinct values and ``most_symbols`` characters per kind, first by hash over all texts."""
    samples = materialize(sample_values(docs, text_col, most, most_symbols), "secret-values")

    def first(kind: str) -> list[str]:
        last = Smallest(most, most_symbols)
        for r in samples.where(F.col("kind") == kind).select("rank", "value").distinct().orderBy("rank", "value").limit(most).collect():
            last.add(r["value"])
        return [value for _, value in last.first()]

    return Formats({k: first(k) for k in KINDS}, [first(k) for k in ORDINARY])


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = FIT_VALUES) -> DataFrame:
    """(id, base, learned): base spans and spans of learned formats as array<struct<kind,start,end>>.

    One row per input row; a null or empty text has no spans.  Texts are read twice, to fit and to score; no token is
    stored between.  Without at least ten labelled credentials of a kind no format is learned for it.
    """
    formats = fit_formats(docs, text_col, most)
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    names = ("kind", "start", "end")

    def run(texts):
        base = [base_spans(t) for t in texts]
        learned = [formats.learned_spans(t, b) for t, b in zip(texts, base)]
        return [pa.array([[dict(zip(names, s)) for s in b] for b in base], span), pa.array([[dict(zip(names, (LEARNED, *s))) for s in found] for found in learned], span)]

    fields = "array<struct<kind:string,start:int,end:int>>"
    return map_text(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "text", f"base {fields}, learned {fields}", run)


def redact(docs: DataFrame, text_col: str = "text", most: int = FIT_VALUES, mark: str = "[secret]") -> DataFrame:
    """The documents with every span of the scan replaced by ``mark``; overlapping spans give one mark."""
    formats = fit_formats(docs, text_col, most)
    order = docs.columns

    def clean(text: str) -> str:
        base = base_spans(text)
        spans = sorted([(s, e) for _, s, e, _ in base] + formats.learned_spans(text, base))
        parts, at = [], 0
        for s, e in spans:
            if s >= at:
                parts += [text[at:s], mark]
            at = max(at, e)
        return "".join(parts) + text[at:] if spans else text

    def run(batches):
        for batch in batches:
            texts = pa.array([None if t is None else clean(t) for t in batch.column(text_col).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([texts if n == text_col else batch.column(n) for n in order], names=order)

    return docs.mapInArrow(run, docs.schema)


def digest_columns(scanned: DataFrame, id_name: str = "doc_id") -> DataFrame:
    """Counts and span digests of a scan."""
    rank = F.create_map(*[F.lit(x) for pair in zip((*KINDS, LEARNED), range(4)) for x in pair])
    line = lambda spans: F.array_join(F.transform(
        F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), rank[s["kind"]].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))),
        lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return scanned.select(
        F.col("id").alias(id_name), *[count(k).alias(f"n_{k}") for k in KINDS], F.sha2(line(F.col("base")), 256).alias("base_sha256"),
        line(F.concat("base", "learned")).alias("spans"), F.size("learned").cast("long").alias("n_learned"))

