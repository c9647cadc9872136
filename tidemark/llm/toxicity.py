"""Toxicity: a weighted finite-state grammar of insults, threats, targets, negation and reported speech."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import uniform
from tidemark.llm.languages import part
from tidemark.llm.transducers import Transducer, compose, machine, numbered
from tidemark.sources.shared import settle

# Word lists to begin with. What the labels say about a word counts more, and adds others.
INSULTS = "idiot moron stupid loser trash scum clown pathetic worthless disgusting dumb fool imbecile jerk vermin filth coward pig".split()
THREATS = "kill hurt destroy shoot stab beat strangle murder smash bury".split()
TARGETS = "you your yours yourself u ur he him she her they them their these those".split()
NEGATIONS = "not no never nobody nothing neither nor without isn't aren't wasn't weren't don't doesn't didn't won't can't".split()
REPORTS = "said says say saying told tells wrote writes claimed claims called calls quoted quotes reported according".split()

#: A word, or what ends a clause or opens and closes a quotation.
TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*|[.!?;:\n\"“”]")
ENDS, QUOTES = set(".!?;:\n"), set('"“”')
#: How many words a negation, a target before or after an insult, reach.
NEGATED, TARGETED, ADDRESSED = 3, 4, 3
#: Natural logs of what a match counts for: in reported speech, negated, with a target, an insult or a
#: threat with a target afterwards, a further insult of a clause, a threat without a target.
REPORTED_WEIGHT, NEGATED_WEIGHT = math.log(0.4), math.log(0.3)
TARGET_WEIGHT, ADDRESS_WEIGHT, AIMED_WEIGHT = math.log(1.5), math.log(0.5), math.log(0.9)
AGAIN_WEIGHT, AIMLESS_WEIGHT = math.log(1.2), math.log(0.3)

#: The bound on the labelled texts that words are learned from, half of them toxic where there are so many.
SAMPLE = 20_000
#: The bound on the learned words and stems, those told apart best.
LEXICON = 5_000
#: A stem is the beginning of longer words, of so many letters.
STEMS = (4, 5, 6)
LEAST_ROWS = 3
#: What a word of the lists is worth where labels say nothing, as that many toxic texts of a hundred.
PRIOR = 5.0
SPAN = 5
REMEMBERED = 200_000


def reported() -> Transducer:
    """Marks insults and threats after a verb of saying, up to the end of the clause, or in quotes."""

    def step(state, symbol):
        said, quoted = state
        if symbol == "#":
            return (False, quoted), "#", 0.0
        if symbol == "q":
            return (said, not quoted), "o", 0.0
        if symbol == "r":
            return (True, quoted), "o", 0.0
        if symbol in "it" and (said or quoted):
            return state, "r" + symbol, REPORTED_WEIGHT
        return state, symbol, 0.0

    return machine((False, False), "oityrnq#", step)


def negated() -> Transducer:
    """Marks what stands within a few words after a negation."""

    def step(left, symbol):
        if symbol == "#":
            return 0, "#", 0.0
        if symbol == "n":
            return NEGATED, "o", 0.0
        if symbol[-1] in "it" and left:
            return left - 1, "n" + symbol, NEGATED_WEIGHT
        return max(left - 1, 0), symbol, 0.0

    return machine(0, ["o", "i", "t", "y", "n", "#", "ri", "rt"], step)


def targeted() -> Transducer:
    """Marks what has a target within a few words before it. A target shortly after an insult or threat
    that has none is written as ``late`` or ``aimed``."""

    def step(state, symbol):
        before, after, waiting = state
        if symbol == "#":
            return (0, "", 0), "#", 0.0
        if symbol == "y":
            written, weight = {"i": ("late", ADDRESS_WEIGHT), "t": ("aimed", AIMED_WEIGHT), "": ("o", 0.0)}[after]
            return (TARGETED, "", 0), written, weight
        if symbol[-1] in "it":
            if before:
                return (before - 1, "", 0), "y" + symbol, TARGET_WEIGHT
            return (0, symbol, ADDRESSED) if symbol in "it" else (0, "", 0), symbol, 0.0
        waiting = max(waiting - 1, 0)
        return (max(before - 1, 0), after if waiting else "", waiting), symbol, 0.0

    return machine((0, "", 0), ["o", "y", "#", *(a + b for a in ("", "r", "n", "nr") for b in "it")], step)


def insulting() -> Transducer:
    """Writes ``insult`` for every insult, ``softened`` for one that is negated or reported; one after
    another in a clause counts for more."""

    def step(matched, symbol):
        if symbol == "#":
            return False, "#", 0.0
        if symbol == "late" or symbol[-1] == "i":
            written = "softened" if symbol != "late" and set("nr") & set(symbol) else "insult"
            return True, written, AGAIN_WEIGHT if matched and symbol != "late" else 0.0
        return matched, symbol, 0.0

    return machine(False, targeted().written, step)


def threatening() -> Transducer:
    """Writes ``threat`` for threats; one without a target counts for less."""

    def step(state, symbol):
        if symbol == "aimed":
            return state, "threat", 0.0
        if symbol[-1] == "t" and symbol != "insult":
            return state, "threat", 0.0 if symbol[0] == "y" else AIMLESS_WEIGHT
        return state, symbol, 0.0

    return machine(0, insulting().written, step)


def grammar() -> Transducer:
    """All of them composed, over the classes of words: o i t y r n q and the end of a clause, #."""
    return numbered(reduce(compose, [reported(), negated(), targeted(), insulting(), threatening()]))


@dataclass
class Model:
    """Classes and weights of words and stems, and the regression on what the grammar finds."""

    words: dict[str, tuple[str, float]] = field(default_factory=dict)
    stems: dict[str, tuple[str, float]] = field(default_factory=dict)
    regression: np.ndarray = field(default_factory=lambda: np.array([-4.0, 2.0, 2.0, 2.0, 0.5, 0.5]))

    def __post_init__(self):
        self.grammar = grammar()
        self.seen: dict[str, tuple[str, float]] = {}

    def known(self, token: str) -> tuple[str, float]:
        """A token's class and its weight: of the word itself, or else of its longest stem."""
        if token in ENDS:
            found = "#", 0.0
        elif token in QUOTES:
            found = "q", 0.0
        else:
            token = token.replace("’", "'")
            found = self.words.get(token)
            for n in reversed(STEMS):
                if found is None and len(token) > n:
                    found = self.stems.get(token[:n])
            found = found or ("o", 0.0)
        if len(self.seen) > REMEMBERED:
            self.seen.clear()
        self.seen[token] = found
        return found

    def clauses(self, text: str) -> list[tuple[float, float, float]]:
        """Insult, softened insult and threat of every clause that the grammar matches."""
        seen, found = self.seen, []
        read = [seen.get(token) or self.known(token) for token in TOKEN.findall(text.lower())]
        if not any(symbol in "it" for symbol, _ in read):
            return found
        state, sums, last = 0, {"insult": 0.0, "softened": 0.0, "threat": 0.0}, {"i": 0.0, "t": 0.0}
        for symbol, weight in read + [("#", 0.0)]:
            state, written, path = self.grammar.arcs[state, symbol]
            if symbol in last:
                last[symbol] = weight
            if written in sums:  # a target that comes late counts by what was said to it
                sums[written] += last["t" if written == "threat" else "i"] * math.exp(path)
            elif written == "#" and any(sums.values()):
                found.append(tuple(sums.values()))
                sums = dict.fromkeys(sums, 0.0)
        return found

    def features(self, text: str) -> list[float]:
        """One, and of the matched clauses: insults, softened ones and threats in all, the strongest, the number."""
        found = self.clauses(text)
        sums = [math.log1p(sum(c[k] for c in found)) for k in range(3)]
        return [1.0, *sums, max((math.log1p(sum(c)) for c in found), default=0.0), math.log1p(len(found))]

    def score(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(np.dot(self.features(text or ""), self.regression), -30, 30))))


def terms(text: str) -> tuple[list[str], int]:
    """The distinct words and stems (with a star) of a text, and its least hash of five words, equal for most near copies."""
    words = [w.replace("’", "'") for w in TOKEN.findall(text.lower()) if w[0] not in ENDS and w[0] not in QUOTES]
    found = set(words)
    stems = {f"{w[:n]}*" for w in found for n in STEMS if len(w) > n}
    shingles = {" ".join(words[i : i + SPAN]) for i in range(max(1, len(words) - SPAN + 1))}
    return sorted(found | stems), min(xxhash.xxh3_64_intdigest(s) for s in shingles) >> 1


def _terms(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for batch in texts:
        both = [terms(text) for text in batch]
        yield pd.DataFrame({"terms": [x[0] for x in both], "sketch": [x[1] for x in both]})


def labelled(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``text, toxic, part`` of at most about ``sample`` labelled texts that aren't held out.

    Each different text counts once, however many rows have it, and is drawn by its own hash, so
    neither an id nor a text repeated without end makes more of it. A text with both labels is toxic.
    """
    known = labels.filter("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    rows = docs.select("doc_id", part().alias("part"), F.xxhash64("text").alias("h")).filter("part <> 0 and text is not null")
    told = rows.join(known, "doc_id")
    totals = {bool(r["toxic"]): r["n"] for r in told.groupBy((F.col("toxic") > 0).alias("toxic")).agg(F.approx_count_distinct("h").alias("n")).collect()}
    shares = {toxic: min(1.0, sample / 2 / max(n, 1)) for toxic, n in totals.items()}
    share = F.when(F.col("toxic") > 0, shares.get(True, 1.0)).otherwise(shares.get(False, 1.0))
    drawn = told.filter(uniform(F.lit("labelled"), F.col("h")) <= share)
    chosen = settle(drawn.groupBy("h").agg(F.min("doc_id").alias("doc_id"), F.max("toxic").alias("toxic"), F.min_by("part", "doc_id").alias("part")), "drawn")
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("h")).filter("text is not null")
    # As many rows as the sample has at most: a text hash is drawn once.
    found = texts.join(F.broadcast(chosen), ["doc_id", "h"]).dropDuplicates(["h"])
    return settle(found.select("text", "toxic", "part"), "labelled")


def told_terms(rows: DataFrame) -> DataFrame:
    """``toxic, part, terms`` of texts, one row of each group of near copies, so that none speaks twice."""
    each = rows.select("toxic", "part", F.pandas_udf(_terms, "struct<terms array<string>, sketch long>")("text").alias("x"))
    return settle(each.select("toxic", "part", "x.*").dropDuplicates(["sketch", "toxic"]), "terms")


def lexicon(each: DataFrame, size: int = LEXICON) -> tuple[dict, dict]:
    """Words and stems that tell toxic texts, with the logs of their odds less half a standard error.

    A term is taken if the likelihood ratio of its counts is beyond what the best of that many terms
    would reach by chance; the lists' words are always there.
    """
    all_rows = {r["toxic"]: r["n"] for r in each.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n_toxic, n_clean = (all_rows.get(x, 0) for x in (1, 0))
    counted = each.select("toxic", F.explode("terms").alias("term")).groupBy("term").agg(
        F.count_if(F.col("toxic") > 0).alias("t"), F.count_if(F.col("toxic") == 0).alias("c")
    )
    a, b = F.col("t"), F.col("c")
    expected = (a + b) / F.lit(float(max(n_toxic + n_clean, 1)))

    def part_of(seen, rows_of):
        return F.when(seen > 0, seen * F.log(seen / (expected * max(rows_of, 1)))).otherwise(0.0)

    ratio = 2 * (part_of(a, n_toxic) + part_of(b, n_clean))
    seeds = [*INSULTS, *THREATS]
    frequent = settle(counted.filter((a >= LEAST_ROWS) | F.col("term").isin(seeds)).withColumn("ratio", ratio), "counted")
    chance = 2 * math.log(max(frequent.count(), 1)) + 2
    rising = a * max(n_clean, 1) > b * max(n_toxic, 1)
    found = frequent.filter((rising & (F.col("ratio") >= chance)) | F.col("term").isin(seeds))
    best = found.orderBy(F.col("term").isin(seeds).desc(), F.desc("ratio"), "term").limit(size + len(seeds)).collect()
    words = {w: (symbol, 0.0) for symbol, listed in zip("yrn", (TARGETS, REPORTS, NEGATIONS)) for w in listed}
    words |= {w: (symbol, 0.0) for symbol, listed in zip("it", (INSULTS, THREATS)) for w in listed}
    counts = {r["term"]: (r["t"], r["c"]) for r in best}
    stems = {}
    for term in {*counts, *seeds}:
        t, c = counts.get(term, (0, 0))
        prior = PRIOR if term in seeds else 0.0
        rows_of = 100.0 if prior else 0.0
        toxic, clean = (t + prior + 0.5) / (n_toxic + rows_of + 1), (c + 0.5) / (n_clean + rows_of + 1)
        weight = math.log(toxic / clean) - 0.5 * math.sqrt(1 / (t + prior + 0.5) + 1 / (c + 0.5))
        symbol = words.get(term, ("i", 0.0))[0]
        if weight <= 0 and term not in seeds or symbol not in "it":
            continue
        (stems if term.endswith("*") else words)[term.rstrip("*")] = (symbol, max(weight, 0.0))
    return words, stems


def regression(features: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Logistic regression by Newton's method, held to the default by a ridge."""
    default = Model().regression
    now = default.copy()
    for _ in range(25):
        chance = 1 / (1 + np.exp(-np.clip(features @ now, -30, 30)))
        slope = features.T @ (chance - toxic) + (now - default)
        bend = (features * (chance * (1 - chance))[:, None]).T @ features + np.eye(len(now))
        step = np.linalg.solve(bend, slope)
        now = now - step
        if np.abs(step).max() < 1e-6:
            break
    return now


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model learned from the texts and ``toxic`` labels of rows that aren't held out.

    The regression sees each half of the sample through the words learned on the other, so that it
    isn't told what they were chosen on; the words that stay are learned on both. What comes to the
    driver are counts, at most ``LEXICON`` terms at once and six numbers a text of the sample.
    Without labels the lists and the default stand.
    """
    rows = labelled(docs, labels, sample)
    each = told_terms(rows)
    halves, seen = [F.col("part") < 3, F.col("part") >= 3], []
    for learned, judged in (halves, halves[::-1]):
        x = _through(rows.filter(judged), Model(*lexicon(each.filter(learned)))).toArrow()
        seen += zip(x["toxic"].to_pylist(), x["x"].to_pylist())
    model = Model(*lexicon(each))
    if seen:
        seen.sort()
        toxic, features = zip(*seen)
        model.regression = regression(np.array(features), np.array(toxic, float))
    return model


def _through(rows: DataFrame, model: Model) -> DataFrame:
    """``toxic, x``: what the grammar finds in texts."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("array<double>")
    def features(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([shared.value.features(text) for text in batch])

    return rows.select("toxic", features("text").alias("x"))


def scored(docs: DataFrame, labels: DataFrame, model: Model | None = None) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row.

    A null text is an empty one; it and others without a match have the score of no evidence.
    Repeated rows are rows of their own, other columns don't matter, and no rows give none.
    """
    model = fit(docs, labels) if model is None else model
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([shared.value.score(text) for text in batch], dtype=float)

    rows = docs.select("doc_id", (part() == 0).alias("held_out"), score("text").alias("score"))
    return rows.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))
