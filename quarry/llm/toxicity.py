"""Toxicity: a weighted lexicon, matched by Aho-Corasick on folded text, normalised by length.

The lexicon is learned from labelled rows: words and word beginnings that stand in many different
contexts of toxic texts (copies of one text are one context) and are rare elsewhere; an entry's weight
is its smoothed log-odds. Words with foreign look-alike letters or digits in place of letters are
folded before matching. A hit inside an exception phrase does not count. The weights' sum and the
text's length go into a logistic curve, fitted on a histogram of the labelled rows.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows that the lexicon learns from, at most: those of the lowest hashes.
MAX_TRAINING_ROWS = 50_000
#: Entries of the lexicon, at most: those of most weight, after weights are known for all.
MAX_ENTRIES = 20_000
THRESHOLD = 0.7

# Letters that look like Latin ones, digits that stand for letters, signs likewise.
LOOK_ALIKES = "аa вb сc еe нh іi јj кk мm оo рp ѕs тt уy хx αa βb εe ηn ιi κk νv οo ρp τt υu χx"
DIGITS = "0o 1i 3e 4a 5s 7t"
SIGNS = {"@": "a", "$": "s"}
INVISIBLE = "​‌‍⁠﻿­"
# Phrases in which a listed word is harmless.
EXCEPTIONS = ("trash can", "trash bag", "trash bin", "trash collection", "clown fish", "class clown", "sore loser", "stupid question")

FOLD = {ord(x[0]): x[1] for x in f"{LOOK_ALIKES} {DIGITS}".split()} | {ord(x): None for x in INVISIBLE} | {0xFF21 + k: chr(97 + k) for k in range(26)} | {0xFF41 + k: chr(97 + k) for k in range(26)}
SIGN = re.compile(r"(?<=[^\W\d_])[@$](?=[^\W\d_])")
WORD = re.compile(r"[^\W\d_]+")
STEMS = range(3, 8)
#: A word and its beginnings, of which one is kept as a rule.
ENTRIES_OF_WORD = 1 + len(STEMS)
#: Different entries that a task counts before it passes them on.
HELD_COUNTS = 1 << 20


def fold(text: str) -> str:
    """Lower case, look-alikes and digits as the letters they stand for; numbers become odd words, which does no harm."""
    text = text.lower()
    if "@" in text or "$" in text:
        text = SIGN.sub(lambda m: SIGNS[m[0]], text)
    return text.translate(FOLD)


@dataclass
class Lexicon:
    """entries: text -> (weight, True for a whole word, False for a word's beginning)."""

    entries: dict[str, tuple[float, bool]] = field(default_factory=dict)
    exceptions: tuple[str, ...] = EXCEPTIONS
    #: Of 1, log(1 + weights of the hits), log(1 + words); no labels at all: nothing is toxic.
    curve: tuple[float, float, float] = (-20.0, 0.0, 0.0)

    def automaton(self):
        import ahocorasick

        found = ahocorasick.Automaton()
        for text, (weight, whole) in self.entries.items():
            found.add_word(text, (len(text), weight, whole, text))
        for phrase in self.exceptions:
            if phrase not in self.entries:
                found.add_word(phrase, (len(phrase), None, True, phrase))
        if len(found):
            found.make_automaton()
        return found


def hits(automaton, text: str) -> list[tuple[int, int, float, str]]:
    """(start, end, weight, entry) of the entries in a folded text, without those in exception phrases."""
    if not len(automaton):
        return []
    found, spared, size = [], [], len(text)
    for last, (length, weight, whole, entry) in automaton.iter(text):
        start = last + 1 - length
        if start and text[start - 1].isalpha() or whole and last + 1 < size and text[last + 1].isalpha():
            continue
        if weight is None:
            spared.append((start, last + 1))
        else:
            found.append((start, last + 1, weight, entry))
    if spared:
        found = [x for x in found if not any(a <= x[0] and x[1] <= b for a, b in spared)]
    return found


def _matcher(lexicon: Lexicon):
    """A UDF: the weights' sum, the hits' number and the number of words of each text; one hit for each start, the heaviest."""

    @F.pandas_udf("struct<weight double, hits int, words int>")
    def match(texts: pd.Series) -> pd.DataFrame:
        automaton = lexicon.automaton()
        out = []
        for text in texts:
            if not text:
                out.append((0.0, 0, 0))
                continue
            best: dict[int, float] = {}
            for start, _, weight, _ in hits(automaton, fold(text)):
                best[start] = max(weight, best.get(start, 0.0))
            out.append((sum(best.values()), len(best), len(text.split())))
        return pd.DataFrame(out, columns=["weight", "hits", "words"])

    return match


def held_out(doc_id: str | Column = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id) % 3 == 1, F.lit(False))


def _lowest(rows: DataFrame, most: int) -> DataFrame:
    """The rows of the `most` distinct doc_ids of lowest hash, and of few more.

    The hash's bound follows the number of ids, so that no task sorts more than it returns; among hashes
    spread evenly, ten standard deviations lie between the bound's rows and `most`.
    """
    share = (most + 10 * math.sqrt(most) + 100) / max(1, rows.select("doc_id").distinct().count())
    return rows.where(F.xxhash64("doc_id") <= min((1 << 63) - 1, int(share * (1 << 64)) - (1 << 63)))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """(text, label) of the rows to learn from: of held_out() false, at most `most`, by the lowest hashes of their ids.

    The labels kept are bounded, and so are broadcast. Of several rows of one doc_id a single text, that of
    the lowest hash, is learned; of repeated labels the largest counts.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where("doc_id is not null and label is not null")
    known = _lowest(known.where(~held_out()), most)
    known = known.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    each = texts.join(F.broadcast(known), "doc_id").groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.max("label").alias("label"))
    return each.select("text", "label")


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct (entry, context) of each text: the word before and the word after."""
    for batch in batches:
        entry, context = [], []
        for text in batch.column(0).to_pylist():
            words = ["", *WORD.findall(fold(text or "")), ""]
            seen = set()
            for k in range(1, len(words) - 1):
                word = words[k]
                if len(word) < 3:
                    continue
                around = f"{words[k - 1]} {words[k + 1]}"
                seen.add((word + ".", around))
                seen.update((word[:n], around) for n in STEMS if n < len(word))
            entry += [x for x, _ in seen]
            context += [x for _, x in seen]
        yield pa.RecordBatch.from_pydict({"entry": pa.array(entry, pa.string()), "context": pa.array(context, pa.string())})


def _present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts that hold each word (with a dot at its end) and each beginning of a word, for each label, added up within the task."""
    found: dict[tuple[str, int], int] = defaultdict(int)

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in found], pa.string()), pa.array([k[1] for k in found], pa.int32()), pa.array(list(found.values()), pa.int64())], names=["entry", "label", "n"])

    for batch in batches:
        for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            words = {w for w in WORD.findall(fold(text or "")) if len(w) >= 3}
            for entry in {w + "." for w in words} | {w[:n] for w in words for n in STEMS if n <= len(w)}:
                found[entry, label] += 1
            if len(found) >= HELD_COUNTS:
                yield out()
                found.clear()
    if found:
        yield out()


def _weighed(support: DataFrame, counts: DataFrame, toxic: int, other: int) -> DataFrame:
    """support and the texts of each label that hold an entry, as `toxic` and `other`, and its log-odds as `w`.

    An entry that is a word and a beginning counts as a beginning.
    """
    n = lambda label: F.coalesce(F.sum(F.when(F.col("label") == label, F.col("n"))), F.lit(0))
    rows = support.join(counts.groupBy("entry").agg(n(1).alias("toxic"), n(0).alias("other")), "entry")
    of_name = F.struct(F.when(~F.col("entry").endswith("."), 1).otherwise(0), "toxic", "other").alias("of")
    both = rows.withColumn("name", F.rtrim("entry", F.lit("."))).groupBy("name").agg(F.max(of_name).alias("of"), F.collect_list(F.struct("entry", "count")).alias("each"))
    rows = both.select(F.explode("each").alias("e"), "of.toxic", "of.other").select("e.*", "toxic", "other")
    return rows.withColumn("w", F.log((F.col("toxic") + 0.5) / (toxic + 1)) - F.log((F.col("other") + 0.5) / (other + 1)))


def _chosen(support: dict[str, int], counts: dict[tuple[str, int], int], least_weight: float) -> dict[str, tuple[float, bool]]:
    """Entries of weight; of those that say the same, the widest one that is as specific as its parts.

    support: different contexts of each entry, a whole word's with a dot at its end.
    """
    toxic, other = counts.get(("", 1), 0), counts.get(("", 0), 0)
    weight = {}
    for entry in support:
        name = entry.rstrip(".")
        with_it, without = counts.get((name, 1), 0), counts.get((name, 0), 0)
        w = np.log((with_it + 0.5) / (toxic + 1)) - np.log((without + 0.5) / (other + 1))
        if w >= least_weight:
            weight[entry] = float(min(w, 8.0))
    kept = dict(weight)
    for entry in sorted(weight, key=len, reverse=True):  # a beginning that adds little to a longer one or to a word goes
        name = entry.rstrip(".")
        for n in STEMS:
            if n < len(name) and (stem := name[:n]) in kept and support[stem] < 1.1 * support[entry]:
                del kept[stem]
    for entry in list(kept):  # what a kept beginning covers goes
        name = entry.rstrip(".")
        if any(name[:n] in kept for n in STEMS if n < len(name)):
            del kept[entry]
    return {entry.rstrip("."): (weight[entry], entry.endswith(".")) for entry in kept}


def _logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Newton's method on weighted rows."""
    w = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (n * (y - p)) - ridge * w
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + (ridge + 1e-9) * np.eye(len(w)), gradient)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return w


def learn_lexicon(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAINING_ROWS, least_contexts: int = 6, least_weight: float = 2.0, exceptions: tuple[str, ...] = EXCEPTIONS, most_entries: int = MAX_ENTRIES) -> Lexicon:
    """A lexicon from labels.toxic, of rows that aren't held out; empty without such labels."""
    from .common import stored

    rows = stored(training_rows(docs, labels, "toxic", most))
    contexts = rows.where("label = 1").select("text").mapInArrow(_contexts, "entry string, context string").distinct()
    support = contexts.groupBy("entry").count().where(F.col("count") >= least_contexts)
    texts = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    weighed = _weighed(support, rows.select("text", "label").mapInArrow(_present, "entry string, label int, n long"), texts.get(1, 0), texts.get(0, 0))
    heavy = weighed.where(F.col("w") >= least_weight).orderBy(F.desc("w"), F.desc("count"), "entry").limit(ENTRIES_OF_WORD * most_entries).collect()
    counts = {("", label): n for label, n in texts.items()}
    for r in heavy:
        counts[r["entry"].rstrip("."), 1], counts[r["entry"].rstrip("."), 0] = r["toxic"], r["other"]
    chosen = _chosen({r["entry"]: r["count"] for r in heavy}, counts, least_weight)
    entries = dict(sorted(chosen.items(), key=lambda x: (-x[1][0], x[0]))[:most_entries])
    lexicon = Lexicon(entries, exceptions)
    found = rows.select("label", _matcher(lexicon)("text").alias("m")).groupBy("label", F.round(F.log1p("m.weight"), 1).alias("w"), F.round(F.log1p("m.words"), 0).alias("l")).count()
    table = np.array([[r["w"], r["l"], r["label"], r["count"]] for r in found.collect()], float).reshape(-1, 4)
    if table[:, 2].any():
        x = np.column_stack([np.ones(len(table)), table[:, 0], table[:, 1]])
        lexicon.curve = tuple(_logistic(x, table[:, 2], table[:, 3]).tolist())
    return lexicon


def with_score(docs: DataFrame, lexicon: Lexicon, name: str = "score") -> DataFrame:
    """docs and a column: a struct of score (0 to 1), hits and weight."""
    a, b, c = lexicon.curve
    found = docs.withColumn(name, _matcher(lexicon)(F.col("text").cast("string")))
    x = a + b * F.log1p(f"{name}.weight") + c * F.log1p(f"{name}.words")
    return found.withColumn(name, F.struct((1 / (1 + F.exp(-x))).alias("score"), F.col(f"{name}.hits").alias("hits"), F.col(f"{name}.weight").alias("weight")))


def score_toxicity(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAINING_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted, hits) for every row of docs.

    docs: doc_id long, text string; labels: doc_id, toxic; other columns don't matter. Null and empty
    texts have no hits and get the curve's value there; of repeated labels the largest counts; without
    labels every score is near 0.
    """
    lexicon = learn_lexicon(docs, labels, most)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = with_score(rows, lexicon, "found")
    return rows.select("doc_id", held_out().alias("held_out"), F.col("found.score").alias("score"), (F.col("found.score") >= THRESHOLD).cast("int").alias("predicted"), F.col("found.hits").alias("hits"))


def without_toxic(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAINING_ROWS) -> DataFrame:
    """The rows of docs, all columns, whose score is below THRESHOLD."""
    rows = docs.select(F.struct("*").alias("row"), "text")
    found = with_score(rows, learn_lexicon(docs, labels, most), "found")
    return found.where(F.col("found.score") < THRESHOLD).select("row.*")
