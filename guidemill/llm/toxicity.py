"""Toxicity by weak supervision.

Many voters (word lists and patterns) look at a whole text and vote toxic, clean or not at all.  A generative label
model over the counts of vote combinations in the whole corpus estimates each voter's accuracy, and how far voters
repeat each other given the label.  Its posterior labels, not the voters, train a linear classifier.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from guidemill.llm.common import bounded_sample, map_text, materialize
from guidemill.llm.quality import isotonic

# Word lists of the lexicon voters.
LEXICONS = {
    "intellect": "idiot idiots idiotic moron morons moronic stupid stupidity dumb dumbass imbecile imbeciles cretin dimwit halfwit fool fools foolish brainless airhead dolt simpleton",
    "worth": "worthless pathetic loser losers pitiful hopeless",
    "ridicule": "clown clowns joke laughingstock buffoon freak freaks weirdo weirdos creep creeps jerk jerks",
    "filth": "trash garbage scum filth filthy vermin parasite parasites cockroach cockroaches slime sewage maggot maggots",
    "disgust": "disgusting revolting repulsive sickening nasty hideous ugly despicable loathsome",
    "profanity": "damn crap shit bullshit fuck fucking fucked fucker bitch bastard bastards ass asshole assholes prick piss slut whore cunt motherfucker",
    "hate": "hate hated hateful despise detest loathe racist bigot nazi fascist subhuman",
    "threat": "murder strangle stab lynch exterminate",
}
# Phrases of the pattern voters.
PHRASES = {
    "address": re.compile(r"\b(?:you|you're|youre|u|they|he|she) (?:are |is |r )?(?:such )?(?:an? )?(?:\w+ ){0,2}(?:idiot|moron|loser|clown|scum|trash|fool|pig|freak|disgrace)"),
    "silence": re.compile(r"\b(?:shut up|shut your|get lost|go away|drop dead|go to hell|screw you|kill yourself)\b"),
}
SPELLED = str.maketrans("0134578@$", "oieastbas")  # digits and signs that stand for letters
LETTERS = re.compile(r"[^\W\d_]+")
SHOUT_SHARE, EXCLAIM_SHARE = 0.5, 0.01
MINED = 8  # voters that share the stems learned from labels
RATE = 0.004  # hits per word from which a stem is mined from a labelled text, so that length alone mines none
STEMS = (4, 5, 6, 7, 8, 64)  # lengths of word beginnings looked at; the last is a whole word
WINDOW = 250  # words; hits count as many as any run of so many words holds, so that length neither makes nor hides evidence
VOTERS = [*LEXICONS, *(f"mined_{k}" for k in range(MINED)), *PHRASES, "disguised", "shouting", "exclaiming", "several", "no_word"]
_WORDS = {w: i for i, ws in enumerate(LEXICONS.values()) for w in ws.split()}


def plain_words(low: str) -> dict[str, str]:
    """Distinct blank-separated tokens of a lower-cased text, with the word in each."""
    return {t: t.strip(".,;:!?\"'()[]{}<>*_-|") for t in set(low.split())}


def stems_of(low: str) -> list[str]:
    """Word beginnings, and whole words marked by ``$``, that occur at ``RATE`` or more."""
    tokens = Counter(low.split())
    counts: Counter = Counter()
    for token, word in plain_words(low).items():
        if len(word) >= STEMS[0]:
            for stem in {word[:k] if len(word) > k else word + "$" for k in STEMS}:
                counts[stem] += tokens[token]
    least = RATE * sum(tokens.values())
    return sorted(s for s, n in counts.items() if n >= least)


def densest(places: list[int]) -> int:
    """Most of the ascending word positions that any ``WINDOW`` words in a row hold."""
    most = first = 0
    for last, place in enumerate(places):
        while place - places[first] >= WINDOW:
            first += 1
        most = max(most, last - first + 1)
    return most


def evidence(text: str, mined: dict[str, int]) -> list[float]:
    """Hits per voter and, last, the number of words, ``WINDOW`` at most.  ``no_word`` is 1 where no listed or mined word occurs.

    Hits of word voters, and those of ``several``, are those of the densest ``WINDOW`` words.
    ``mined`` maps stems to the number of a mined voter.
    """
    low = text.lower()
    seen: dict[str, int] = {}
    for token, word in plain_words(low).items():
        place = _WORDS.get(word)
        if place is None and mined and len(word) >= STEMS[0]:
            number = next((mined[s] for k in STEMS if (s := word[:k] if len(word) > k else word + "$") in mined), None)
            place = None if number is None else len(LEXICONS) + number
        if place is None and not token.isalpha():
            place = next((_WORDS[p] for p in LETTERS.findall(token) if p in _WORDS), None)
            if place is None and len(word) < 24 and word.translate(SPELLED) in _WORDS and any(c.isalpha() for c in word):
                place = -1
        if place is not None:
            seen[token] = place
    tokens = low.split()
    hits = [0.0] * len(VOTERS)
    found: dict[int, list[int]] = {}
    if seen:
        for k, token in enumerate(tokens):
            if token in seen:
                found.setdefault(seen[token], []).append(k)
    disguised = len(found.get(-1, ()))
    for place, positions in found.items():
        if place >= 0:
            hits[place] = float(densest(positions))
    at = len(LEXICONS) + MINED
    for k, pattern in enumerate(PHRASES.values()):
        if seen or k:
            hits[at + k] = float(sum(1 for _ in pattern.finditer(low)))
    hits[at + 2] = float(disguised)
    if seen:
        hits[at + 3] = float(sum(1 for t in text.split() if len(t) > 2 and t.isupper()) > SHOUT_SHARE * len(tokens))
        hits[at + 4] = float(text.count("!") > EXCLAIM_SHARE * len(text))
    hits[at + 5] = float(densest(sorted(k for positions in found.values() for k in positions)) >= 2)
    hits[at + 6] = float(not seen)
    return hits + [float(min(len(tokens), WINDOW))]


def mine_stems(docs: DataFrame, known: DataFrame, id_col: str, text_col: str, support: int = 5, lift: float = 10.0, most: int = 64, candidates: int = 20_000,
               cover_rows: int = 5_000) -> dict[str, int]:
    """Word stems that mark labelled toxic texts, each with the number of its voter.

    ``known`` is a bounded sample of (id, label).  A candidate occurs in ``support`` toxic texts or more and in toxic
    texts ``lift`` times as often as in others.  A greedy cover then takes the stem that explains most texts not yet
    explained, so that the words of one much-copied text do not crowd in; stems that explain fewer than ``support`` end it.
    The cover is bounded by parameters: the ``candidates`` stems of most toxic texts, ``cover_rows`` toxic texts chosen by a
    hash of their id, and ``most`` stems found.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(known), "id")  # bounded sample

    def stems(texts):
        return [pa.array([stems_of(t.lower()) for t in texts], pa.list_(pa.string()))]

    held = materialize(map_text(rows, "text", "stems array<string>", stems), "stems")
    totals = {r["label"]: r["n"] for r in held.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, clean = totals.get(1, 0), sum(n for k, n in totals.items() if k != 1)
    if not toxic:
        return {}
    counts = held.select("label", F.explode("stems").alias("stem")).groupBy("stem").agg(
        F.count_if(F.col("label") == 1).alias("t"), F.count_if(F.col("label") != 1).alias("c"))
    chosen = counts.where((F.col("t") >= support) & (F.col("t") / toxic >= lift * (F.col("c") + 0.5) / max(1, clean)))
    listed = F.broadcast(chosen.orderBy(F.desc("t"), "stem").limit(candidates).select("stem"))
    toxic_docs = held.where("label = 1").select("id", F.explode("stems").alias("stem")).join(listed, "stem").groupBy("id").agg(F.collect_set("stem").alias("stems"))
    sets = [r["stems"] for r in toxic_docs.orderBy(F.xxhash64("id")).limit(cover_rows).collect()]
    where: dict[str, set[int]] = {}
    for i, own in enumerate(sets):
        for stem in own:
            where.setdefault(stem, set()).add(i)
    mined: dict[str, int] = {}
    while where and len(mined) < most:
        stem = max(where, key=lambda w: (len(where[w]), len(w), w))
        covered = where.pop(stem)
        if len(covered) < support:
            break
        mined[stem] = len(mined) % MINED
        where = {w: rest for w, own in where.items() if (rest := own - covered)}
    return mined


def with_evidence(docs: DataFrame, mined: dict[str, int], text_col: str = "text") -> DataFrame:
    """Replace the text by ``hits array<double>``."""
    width = len(VOTERS) + 1

    def run(texts):
        flat = [x for t in texts for x in evidence(t, mined)]
        return [pa.ListArray.from_arrays(np.arange(0, len(flat) + 1, width, dtype=np.int32), pa.array(flat, pa.float64()))]

    return map_text(docs, text_col, "hits array<double>", run)


def votes(hits: np.ndarray) -> np.ndarray:
    """1 toxic, 0 no vote, -1 clean, per voter; only ``no_word`` votes for clean."""
    out = _spoken(hits).astype(np.int8)
    out[:, -1] *= -1
    return out


def _spoken(hits: np.ndarray) -> np.ndarray:
    """Voters that vote: those with a hit."""
    return hits[:, : len(VOTERS)] > 0


@dataclass
class LabelModel:
    """Class prior, vote probabilities given the label, and weights against voters that repeat each other."""

    prior: float
    table: np.ndarray  # voter x label x vote (-1, 0, 1)
    weights: np.ndarray
    correlation: np.ndarray

    def posterior(self, votes_: np.ndarray) -> np.ndarray:
        ratio = np.full(len(votes_), np.log(self.prior / (1 - self.prior)))
        for j in range(votes_.shape[1]):
            p = self.table[j][:, votes_[:, j] + 1]
            ratio += self.weights[j] * np.log(p[1] / p[0])
        return 1 / (1 + np.exp(-np.clip(ratio, -50, 50)))


def fit_label_model(combos: np.ndarray, counts: np.ndarray, rounds: int = 50) -> LabelModel:
    """Expectation-maximisation over distinct vote combinations; labels are never used."""
    voters = combos.shape[1]
    model = LabelModel(0.1, np.full((voters, 2, 3), 1 / 3), np.ones(voters), np.eye(voters))
    q = np.clip(0.02 + 0.96 * (combos.clip(0).sum(1) >= 1), 0, 1)  # start: any toxic vote
    onehot = [(combos == v).astype(float) for v in (-1, 0, 1)]
    for _ in range(rounds):
        model.prior = float(np.clip((q * counts).sum() / counts.sum(), 1e-4, 0.5))
        for label, w in ((0, (1 - q) * counts), (1, q * counts)):
            for v in range(3):
                model.table[:, label, v] = ((onehot[v] * w[:, None]).sum(0) + 0.1) / (w.sum() + 0.3)
        # Correlation of votes given the label; a voter shares its weight with those it repeats.
        spread = np.zeros((voters, voters))
        for label, w in ((0, (1 - q) * counts), (1, q * counts)):
            centred = combos - (combos * w[:, None]).sum(0) / max(w.sum(), 1e-9)
            spread += (centred * w[:, None]).T @ centred
        size = np.sqrt(np.maximum(np.diag(spread), 1e-9))
        model.correlation = spread / np.outer(size, size)
        model.weights = 1 / np.maximum(1.0, np.where(model.correlation > 0.2, model.correlation, 0).sum(1))
        new = model.posterior(combos)
        if np.abs(new - q).max() < 1e-6:
            break
        q = new
    return model


@dataclass
class LinearModel:
    weights: np.ndarray

    @staticmethod
    def features(hits: np.ndarray) -> np.ndarray:
        n = np.maximum(hits[:, -1:], 1)
        own = hits[:, : len(VOTERS)]
        return np.hstack([np.log1p(own), _spoken(hits), np.minimum(own / n * 100, 10) / 10, np.ones((len(hits), 1))])

    def score(self, hits: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.features(hits) @ self.weights, -30, 30)))


def _hits(batch) -> np.ndarray:
    return batch.column("hits").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(VOTERS) + 1)


def fit_linear(rows: DataFrame, label_model: LabelModel, newton_steps: int = 8, ridge: float = 1.0) -> LinearModel:
    """Logistic regression on the posterior labels of (hits) rows by Newton steps that partitions add up."""
    width = 3 * len(VOTERS) + 1
    model = LinearModel(np.zeros(width))

    def step(batches):
        gram, right = np.zeros((width, width)), np.zeros(width)
        for batch in batches:
            hits = _hits(batch)
            x, y = model.features(hits), label_model.posterior(votes(hits))
            p = model.score(hits)
            gram += (x * (p * (1 - p))[:, None]).T @ x
            right += x.T @ (y - p)
        yield pa.RecordBatch.from_arrays([pa.array([gram.ravel().tolist()]), pa.array([right.tolist()])], names=["gram", "target"])

    for _ in range(newton_steps):
        sums = rows.select("hits").mapInArrow(step, "gram array<double>, target array<double>").collect()
        gram = sum(np.array(r["gram"]).reshape(width, width) for r in sums) + ridge * np.eye(width)
        change = np.linalg.solve(gram, sum(np.array(r["target"]) for r in sums) - ridge * model.weights)
        model = LinearModel(model.weights + change)
        if np.abs(change).max() < 1e-4:
            break
    return model


def score_toxicity(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
                   sample_rows: int = 50_000) -> DataFrame:
    """(id, score) for every row; null and empty texts count as texts without any word.

    Texts are read once; the label model uses the vote combinations of all rows (in practice some hundred,
    whatever the number of rows).  The classifier learns from a hash-chosen sample of at most about ``sample_rows`` rows.  Labels for
    which ``learn`` holds mine word stems for some voters and check the label model: a voter whose texts are toxic less than twice
    as often as any is left out;
    they also calibrate the final score.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("label")).where(learn & F.col("id").isNotNull() & F.col("label").isNotNull())
    mined = mine_stems(docs, bounded_sample(known, "id", sample_rows), id_col, text_col)
    rows = materialize(with_evidence(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), mined), "evidence")
    width = len(VOTERS)
    vote = F.concat(*[F.when(F.col("hits")[j] > 0, "1").otherwise("0") for j in range(width)])
    patterns = rows.groupBy(vote.alias("combo")).agg(F.count(F.lit(1)).alias("n")).orderBy("combo").collect()
    checked = rows.join(known, "id").groupBy(vote.alias("combo")).agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("ones")).orderBy("combo").collect()
    decode = lambda found: np.array([[int(c) for c in r["combo"]] for r in found], np.int8).reshape(-1, width) * np.array([1] * (width - 1) + [-1], np.int8)
    if not patterns:
        return rows.select("id", F.lit(0.0).alias("score"))
    model = fit_label_model(decode(patterns), np.array([r["n"] for r in patterns], float))
    if checked:
        combos, n, ones = decode(checked), np.array([r["n"] for r in checked], float), np.array([r["ones"] for r in checked], float)
        base = ones.sum() / n.sum()
        for j in range(width):
            cast = combos[:, j] == (1 if j < width - 1 else -1)
            rate = ones[cast].sum() / n[cast].sum() if n[cast].sum() >= 20 else None
            if rate is not None and ((rate <= 2 * base) if j < width - 1 else (rate >= base)):
                model.weights[j] = 0.0
    linear = fit_linear(materialize(bounded_sample(rows.where("id IS NOT NULL"), "id", sample_rows).repartition(16, "id"), "sample"), model)

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(linear.score(_hits(batch)), pa.float64())], names=["id", "score"])

    raw = rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, score double")
    table = raw.join(known, "id").groupBy(F.round(F.col("score") * 500).alias("bin")).agg(
        F.avg("score").alias("x"), F.count(F.lit(1)).alias("w"), F.avg("label").alias("y")).orderBy("bin").collect()
    if not table:
        return raw
    knots, values = (v.tolist() for v in isotonic(*(np.array([r[c] for r in table], float) for c in ("x", "w", "y"))))

    @F.pandas_udf("double")
    def calibrated(scores: pd.Series) -> pd.Series:
        # A small share of the raw score keeps the order within a step.
        return pd.Series(np.clip(0.98 * np.interp(scores, knots, values) + 0.02 * scores, 0.0, 1.0))

    return raw.select("id", calibrated("score").alias("score"))
