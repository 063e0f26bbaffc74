"""Problem 7: missing or wrong language labels, and texts of more than one language.

A sparse multinomial logistic regression on TF-IDF weighted character n-grams (hashed to ``BUCKETS``) is fitted on at most
``TRAIN_ROWS`` rows of clean text with certain language, by follow-the-regularised-leader with elastic-net penalties; a
temperature fitted on the part held out calibrates its confidence. The model is a table of BUCKETS x languages, whatever the
corpus; it goes to the tasks with the function. Every text is cut into its sentences, every sentence is scored whole, neighbouring sentences of
one language form a segment, and the text's language is that of its sentences together.

Defined cases: null, empty and letterless texts get no language and no segment; text in an alphabet that the model has not
seen keeps a null language (confidence 0); repeated rows count once; ties go to the alphabetically first language.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .p06_visual_forms import canonical

TRAIN_ROWS = 2000
BUCKETS = 1 << 15
ORDERS = (1, 2, 3, 4)
EPOCHS = 4
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.002, 0.002
#: A whole sentence (ended as one, or of LONG words) counts for mixing from so many words and this confidence on; a label is wrong from WRONG on.
SENTENCE_WORDS = 4
LONG = 8
SURE = 0.9
WRONG = 0.9
KNOWN = 0.7

# Names of the languages in labels, after lower-casing and cutting off regions.
NAMES = {
    "ar": ["ar", "ara", "arb", "arabic"],
    "en": ["en", "eng", "english"],
    "fr": ["fr", "fra", "fre", "french"],
    "de": ["de", "deu", "ger", "german"],
    "fa": ["fa", "fas", "per", "persian", "farsi", "pes"],
}
# Codes that say that the language isn't known, or that there are several or none.
UNKNOWN = ["und", "unk", "mis", "mul", "zxx", "xx", "xxx", "na", "nan", "nil", "tbd", "qaa"]
SENTENCE_END = re.compile(r"(?<=[.!?؟…])[\s\"'”’»)\]]+|\n+")
NO_WORD = re.compile(r"\w*\d\w*|[\W_]+")
WHOLE = re.compile(r"[.!?؟…][\s\"'”’»)\]]*$")
LETTER_RUN = re.compile(r"[^\W\d_]{2,}")


def label_language(label: Column) -> Column:
    """The language that a label names in whatever spelling, or null: none, empty, or a word for unknown. A code of two or three letters beyond NAMES names a language of its own."""
    word = F.regexp_extract(F.lower(F.trim(label)), r"^([a-z]+)", 1)
    out = F.when(word.rlike("^[a-z]{2,3}$") & ~word.isin(UNKNOWN), word)
    for code, names in NAMES.items():
        out = F.when(word.isin(names), F.lit(code)).otherwise(out)
    return out


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of the words (codes with digits left out) of all texts one after the other, and the text that each belongs to. A gram never reaches into another text."""
    texts = [" " + NO_WORD.sub(" ", t.lower()).strip() + " " for t in texts]
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    out, owners = [], []
    run = np.zeros(len(codes), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for n in range(1, max(ORDERS) + 1):
            run = run[: len(codes) - n + 1] * np.uint64(1000003) + codes[n - 1 :]
            if n in ORDERS:
                h = (run + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
                keep = owner[: len(run)] == owner[n - 1 :]
                out.append((h >> np.uint64(40)).astype(np.int64)[keep] % BUCKETS)
                owners.append(owner[: len(run)][keep])
    return np.concatenate(out), np.concatenate(owners)


class Model:
    """Fitted weights by bucket and language (IDF included), intercepts, temperature and the buckets seen."""

    def __init__(self, texts: list[str], labels: list[str]) -> None:
        self.languages = sorted(set(labels))
        y = np.array([self.languages.index(x) for x in labels])
        features = [np.unique(grams([t])[0], return_counts=True) for t in texts]
        held = np.arange(len(texts)) % 5 == 4
        df = np.zeros(BUCKETS)
        for i, (ids, _) in enumerate(features):
            if not held[i]:
                df[ids] += 1
        idf = np.log((1 + (~held).sum()) / (1 + df))
        self.seen = df > 0
        k = len(self.languages)
        z, n = np.zeros((BUCKETS + 1, k)), np.zeros((BUCKETS + 1, k))
        bias = np.array([BUCKETS])

        def weights(ids: np.ndarray) -> np.ndarray:
            w = -(z[ids] - np.sign(z[ids]) * L1) / ((BETA + np.sqrt(n[ids])) / ALPHA + L2)
            return np.where(np.abs(z[ids]) <= L1, 0.0, w)

        order = np.random.default_rng(7)
        rows = np.flatnonzero(~held)
        for _ in range(EPOCHS):
            for i in order.permutation(rows):
                ids, counts = features[i]
                x = np.append(counts * idf[ids] / np.sqrt(counts.sum()), 1.0)
                ids = np.append(ids, bias)
                w = weights(ids)
                s = x @ w
                p = np.exp(s - s.max())
                p /= p.sum()
                p[y[i]] -= 1
                g = np.outer(x, p)
                sigma = (np.sqrt(n[ids] + g * g) - np.sqrt(n[ids])) / ALPHA
                z[ids] += g - sigma * w
                n[ids] += g * g
        everything = weights(np.arange(BUCKETS + 1))
        self.table = (everything[:-1] * idf[:, None]).astype(np.float32)
        self.bias = everything[-1].astype(np.float32)
        self.temperature = 1.0
        if held.any():
            scores = self.scores([t for t, h in zip(texts, held, strict=True) if h])[0]
            grid = np.geomspace(0.05, 20, 120)
            loss = [np.mean(np.log(np.exp((scores - scores.max(1, keepdims=True)) / t).sum(1)) - (scores[np.arange(len(scores)), y[held]] - scores.max(1)) / t) for t in grid]
            self.temperature = float(max(0.2, grid[int(np.argmin(loss))]))

    def scores(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Raw scores of every text, and the share of its n-grams seen in training."""
        k = len(self.languages)
        sums, count, known = np.zeros((len(texts), k)), np.zeros(len(texts)), np.zeros(len(texts))
        at = 0
        while at < len(texts):
            end, chars = at, 0
            while end < len(texts) and (end == at or chars + len(texts[end]) < 100_000):
                chars += len(texts[end])
                end += 1
            ids, owner = grams(texts[at:end])
            size = end - at
            count[at:end] = np.bincount(owner, minlength=size)
            known[at:end] = np.bincount(owner, weights=self.seen[ids], minlength=size)
            for j in range(k):
                sums[at:end, j] = np.bincount(owner, weights=self.table[:, j][ids], minlength=size)
            at = end
        count = np.maximum(count, 1)
        return sums / np.sqrt(count)[:, None] + self.bias, known / count

    def probabilities(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        s, known = self.scores(texts)
        e = np.exp((s - s.max(1, keepdims=True)) / self.temperature)
        return e / e.sum(1, keepdims=True), known


def train(samples: DataFrame, text: str = "text", lang: str = "lang", rows: int = TRAIN_ROWS) -> Model:
    """Fit on at most ``rows`` labelled rows, the same ones each time; longer texts also give their sentences one by one."""
    sample = samples.select(F.col(text).alias("text"), label_language(F.col(lang)).alias("lang")).where("text is not null and lang is not null").orderBy(F.xxhash64("text")).limit(rows).collect()
    texts, labels = [], []
    for row in sample:
        for part in dict.fromkeys([row["text"], *sentences(row["text"])]):
            if LETTER_RUN.search(NO_WORD.sub(" ", part)):
                texts.append(part)
                labels.append(row["lang"])
    if len(set(labels)) < 2:
        raise ValueError("labelled text of at least two languages is needed")
    return Model(texts, labels)


def sentences(text: str) -> list[str]:
    return [x for x in (part.strip() for part in SENTENCE_END.split(text)) if x]


SCHEMA = "lang string, confidence double, segments array<struct<lang:string, confidence:double, text:string>>, languages array<string>"


def reader(model: Model) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """For mapInPandas over (id, text): language, confidence, segments, and the languages with at least one whole sentence."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts, owner = [], []
            for i, text in enumerate(batch["text"]):
                for s in sentences(text or ""):
                    if LETTER_RUN.search(NO_WORD.sub(" ", s)):
                        parts.append(s)
                        owner.append(i)
            p, known = model.probabilities([canonical(x) for x in parts]) if parts else (np.zeros((0, len(model.languages))), np.zeros(0))
            best = p.argmax(1) if len(parts) else np.zeros(0, dtype=int)
            by: list[list[int]] = [[] for _ in range(len(batch))]
            for j, i in enumerate(owner):
                by[i].append(j)
            out = []
            for of in by:
                usable = [j for j in of if known[j] >= KNOWN]
                if not usable:
                    out.append((None, 0.0, [], []))
                    continue
                weight = np.array([len(parts[j]) for j in usable], dtype=float)
                total = (np.log(np.maximum(p[usable], 1e-6)) * np.sqrt(weight)[:, None]).sum(0) / np.sqrt(weight.sum())
                q = np.exp(total - total.max())
                q /= q.sum()
                words = {j: len(LETTER_RUN.findall(parts[j])) for j in usable}
                sure = {int(best[j]) for j in usable if p[j, best[j]] >= SURE and words[j] >= (SENTENCE_WORDS if WHOLE.search(parts[j]) else LONG)}
                segments: list[list] = []
                for j in usable:
                    code, chance = model.languages[int(best[j])], float(p[j, best[j]])
                    if segments and segments[-1][0] == code:
                        segments[-1][1] = min(segments[-1][1], chance)
                        segments[-1][2] += " " + parts[j]
                    else:
                        segments.append([code, chance, parts[j]])
                top = int(q.argmax())
                out.append((model.languages[top], float(q[top]), segments, [model.languages[j] for j in sorted(sure)]))
            yield pd.DataFrame({"id": batch["id"].to_numpy(), "lang": [x[0] for x in out], "confidence": [x[1] for x in out], "segments": [[{"lang": a, "confidence": round(b, 6), "text": c} for a, b, c in x[2]] for x in out], "languages": [x[3] for x in out]})

    return read


def identify(rows: DataFrame, model: Model, id_col: str, text: str) -> DataFrame:
    """(id, lang, confidence, segments, languages) of every distinct (id, text) with text."""
    texts = rows.select(F.col(id_col).cast("string").alias("id"), F.col(text).alias("text")).where(F.length("text") > 0).distinct()
    return texts.mapInPandas(reader(model), f"id string, {SCHEMA}")


def wanting(rows: DataFrame, model: Model, id_col: str, text: str, label: str) -> DataFrame:
    """(id, lang): texts without label, with a wrong one, or with sentences of several languages; one row per language."""
    texts = rows.select(F.col(id_col).cast("string").alias("id"), F.col(text).alias("text"), label_language(F.col(label)).alias("label")).where(F.length("text") > 0).distinct()
    keyed = texts.select(F.to_json(F.struct("id", "label")).alias("id"), "text")
    read = keyed.mapInPandas(reader(model), f"id string, {SCHEMA}").select(F.from_json("id", "id string, label string").alias("k"), "lang", "confidence", "languages").select("k.id", "k.label", "lang", "confidence", "languages")
    mixed = F.size("languages") > 1
    wrong = (F.col("label") != F.col("lang")) & (F.col("confidence") >= WRONG)
    case = F.col("lang").isNotNull() & (mixed | F.col("label").isNull() | wrong)
    named = F.when(F.size("languages") > 1, F.col("languages")).otherwise(F.array("lang"))
    return read.where(case).select("id", F.explode(named).alias("lang")).distinct()
