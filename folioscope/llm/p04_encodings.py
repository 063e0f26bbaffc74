"""Problem 4: text decoded with the wrong character encoding.

A smoothed character bigram model, with case, is counted over all clean pages by Spark; its alphabet is the ``ALPHABET`` most frequent
characters, so it has at most ALPHABET squared entries whatever the corpus. Lines with transitions that the model finds
rare are tried with every encode-decode chain, on their garbled stretches only, and again on the result (text may have been
decoded wrongly twice). Where UTF-8 and single bytes follow each other, twice the evidence is asked
for; two chains of single bytes in a row have none but likelihood and aren't tried. The likeliest candidate is accepted if it is likelier than the line by the margin and reads like clean text;
the margin is what any chain gains on clean lines held out from the model (98 in 100 of them), and some room.

Defined cases: null and empty texts and pages of kind junk are never affected; U+FFFD within a garbled sequence stays where its letter is lost; repeated rows
count once; without any clean page nothing is accepted.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator
from functools import cache
from itertools import chain, compress, islice

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .p02_scan_noise import junk

ALPHABET = 1024
ROOM = 1.0
LEAST_MARGIN = 6.0
RARE = -9.0
#: Mean log-likelihood by transition that a repaired stretch must reach: where the bytes form UTF-8, which is evidence in itself, and else, within words.
CLEAN, CLEAN_WORDS = -7.5, -4.5
#: Without UTF-8's evidence, so many characters must change, and each must gain so much.
LEAST_CHANGED, GAIN_EACH = 2, 4.0
#: Where UTF-8 and single bytes follow each other, so many times the characters must change, and gain over what one chain makes of the line.
TWOFOLD = 2
ROUNDS = 2
#: Characters of a batch up to which each pair of them has a counter, and lines that are counted together.
COUNTED, LINES_TOGETHER = 1000, 10_000
#: Words whose scores a task keeps, to look them up.
SCORES_HELD = 100_000
#: Words over this length aren't kept.
LONG_WORD = 64
#: Characters of candidates whose words are tried together, and of lines or pages that are looked at together; a longer one stands by itself.
TOGETHER, LOOKED_AT = 20_000, 200_000
#: Words whose candidates a task keeps, and pages whose words are tried together.
WORDS_HELD, PAGES_TOGETHER = 20_000, 100
#: Lines whose best repairs a task keeps.
REPAIRS_HELD = 20_000
# The encodings that text is decoded with by mistake, and those that it was written in.
WRONG = ["cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1251", "cp1256", "iso8859-15"]
RIGHT = ["cp1256", "cp1252", "iso8859-6"]
# Classes of characters, for the rules by which lines aren't clean.
LETTER, SMALL, CAPITAL, OTHER_SCRIPT = "[A-Za-z]", "[a-z]", r"[\u00c0-\u00de]", r"[\u0370-\u052f]"
NEVER = r"[\u0080-\u009f\ufffd\u2202-\u25ff]"
SIGN = r"[\u00a1-\u00b6\u00b8-\u00ba\u00bc-\u00bf\u2020-\u2022\u2030\u20ac\u2122\u2202-\u25ff]"
ACCENTED = r"[\u00a1-\u00ff\u0152-\u0192\u02c6-\u02dc\u2013-\u2122\u2202-\u25ff]"
#: Lines with these are not clean: control characters, letters of two scripts in one word, capitals or signs inside words, runs of accented Latin-1.
UNCLEAN = f"{NEVER}|{LETTER}{OTHER_SCRIPT}|{OTHER_SCRIPT}{LETTER}|{SMALL}{CAPITAL}|{LETTER}{SIGN}{LETTER}|{ACCENTED}{{3}}"
ARABIC, LATIN = re.compile("[\u0620-\u06ff]"), re.compile("[A-Za-zÀ-ɏ]")


@cache
def bytes_of(encoding: str) -> dict[str, int]:
    """Character of every byte from 0x80 on; bytes that the encoding leaves open are the control character of their number."""
    out = {}
    for b in range(0x80, 0x100):
        try:
            out[bytes([b]).decode(encoding)] = b
        except UnicodeDecodeError:
            out[chr(b)] = b
    return out


@cache
def sequences(encoding: str) -> tuple[re.Pattern, dict[str, int], dict[int, int]]:
    """UTF-8 sequences as this encoding shows them, and its bytes by character and by code point. Lost bytes are U+FFFD."""
    of = bytes_of(encoding)
    chars = lambda low, high: "".join(re.escape(c) for c, b in of.items() if low <= b <= high)
    rest = f"[{chars(0x80, 0xBF)}�]"
    return re.compile(f"((?:[{chars(0xC2, 0xDF)}]{rest}|[{chars(0xE0, 0xEF)}]{rest}{{2}}|[{chars(0xF0, 0xF4)}]{rest}{{3}})+)"), of, {10: 10} | {ord(c): b for c, b in of.items()}


@cache
def sequence_marks() -> tuple[dict[str, int], dict[str, int]]:
    """For characters that begin a UTF-8 sequence, and for those that go on one: the encodings in which they do, as bits."""
    first, others = defaultdict(int), defaultdict(int)
    for k, encoding in enumerate(WRONG):
        for c, b in bytes_of(encoding).items():
            first[c] |= (0xC2 <= b <= 0xF4) << k
            others[c] |= (b <= 0xBF) << k
    others["�"] = (1 << len(WRONG)) - 1
    return dict(first), dict(others)


@cache
def byte_chains() -> tuple[list[tuple[str, str]], dict[str, tuple[str, ...]]]:
    """(wrong, right) of the chains of single bytes, and what each of them makes of a character."""
    chains = [(wrong, right) for wrong in WRONG for right in RIGHT if right != wrong and {wrong, right} != {"cp1256", "iso8859-6"}]
    tables = [letters_of(*chain) for chain in chains]
    return chains, {c: tuple(t.get(ord(c), c) for t in tables) for c in sorted({chr(x) for t in tables for x in t})}


@cache
def mark_tables() -> tuple[np.ndarray, np.ndarray]:
    """``sequence_marks`` by code point."""
    out = np.zeros((2, 0x110000), dtype=np.uint8)
    for table, marks in zip(out, sequence_marks(), strict=True):
        table[list(map(ord, marks))] = list(marks.values())
    return out[0], out[1]


@cache
def byte_tables() -> tuple[np.ndarray, np.ndarray]:
    """Number, by code point, of each character that a chain of single bytes changes (0 for all others), and what each chain makes of it by number."""
    _, become = byte_chains()
    number = np.zeros(0x110000, dtype=np.uint16)
    number[list(map(ord, become))] = np.arange(1, len(become) + 1)
    return number, np.array([[0] * len(byte_chains()[0]), *[list(map(ord, x)) for x in become.values()]], dtype=np.uint32)


@cache
def letters_of(wrong: str, right: str) -> dict[int, str]:
    out = {}
    for c, b in bytes_of(wrong).items():
        try:
            new = bytes([b]).decode(right)
        except UnicodeDecodeError:
            continue
        if new != c and not 0x80 <= ord(new) < 0xA0 and new != " " and c != " ":
            out[ord(c)] = new
    return out


class Model:
    """Log-likelihood of character transitions: bigrams mixed with single characters, with add-one smoothing."""

    def __init__(self, pairs: pd.DataFrame) -> None:
        weight = pairs.groupby("a")["n"].sum().sort_values(ascending=False, kind="stable")
        self.ids = np.zeros(0x110000, dtype=np.int16)
        chars = np.sort(weight.index.to_numpy(dtype=np.int64)[: ALPHABET - 1])
        self.ids[chars] = np.arange(1, len(chars) + 1)
        self.ids[0x10000:] = self.ids[0xFFFF]  # counted as one
        size = len(chars) + 1
        counts = np.zeros((size, size))
        np.add.at(counts, (self.ids[pairs["a"]], self.ids[pairs["b"]]), pairs["n"])
        counts[0] = counts[:, 0] = 0
        single = (counts.sum(0) + 1) / (counts.sum() + 1000 * size)
        mixed = 0.98 * counts / np.maximum(counts.sum(1, keepdims=True), 20) + 0.02 * single
        self.logs = np.log(np.maximum(mixed, 1e-9)).astype(np.float32)
        self.logs[0, :] = self.logs[:, 0] = np.float32(-13.0)
        self.logs[0, 0] = np.float32(-13.0)
        self.rare = (self.logs <= RARE).ravel()
        self.margin = LEAST_MARGIN
        self.quick: list = []
        self.scores: dict[str, float] = {}
        self.shown: dict[str, tuple] = {}
        self.changed: dict[str, tuple] = {}
        self.repairs: dict[str, tuple[float, list[str], str]] = {}

    def codes(self, text: str) -> np.ndarray:
        return self.ids[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]

    def steps(self, text: str) -> np.ndarray:
        c = self.codes(text)
        return self.logs[c[:-1], c[1:]]

    def score(self, text: str) -> float:
        """Log-likelihood of the text between spaces; every transition lies in one word or at its ends."""
        return sum(map(self.word_score, text.split(" ")))

    def word_score(self, word: str) -> float:
        """Log-likelihood of the word between spaces: table look-ups without arrays, kept for the next time."""
        if len(word) > LONG_WORD:
            return float(self.steps(f" {word} ").sum(dtype=np.float64))
        if not self.quick:
            self.quick.append((dict(zip(map(chr, np.flatnonzero(self.ids)), self.ids[self.ids > 0].tolist(), strict=True)), self.logs.tolist()))
        ids, logs = self.quick[0]
        if word in self.scores:
            return self.scores[word]
        total, last = 0.0, ids.get(" ", 0)
        for c in word:
            this = ids.get(c, 0)
            total += logs[last][this]
            last = this
        if len(self.scores) >= SCORES_HELD:
            self.scores.clear()
        self.scores[word] = total = total + logs[last][ids.get(" ", 0)]
        return total

    def word_scores(self, texts: list[str]) -> np.ndarray:
        """Score of every word, for texts of equally many words."""
        text = " ".join(["", *texts, ""])
        spaces = np.flatnonzero(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32) == 32)
        return np.add.reduceat(self.steps(text), spaces[:-1], dtype=np.float64).reshape(len(texts), -1)

    def suspicious(self, text: str) -> set[int]:
        """Numbers (from 0) of the lines with a rare transition."""
        c = self.codes(f" {text} ".replace("\n", " ")).astype(np.int32)
        rare = np.flatnonzero(self.rare[c[:-1] * len(self.logs) + c[1:]])
        if not len(rare):
            return set()
        ends = np.cumsum([len(x) + 1 for x in text.split("\n")])
        return set(np.searchsorted(ends, rare, side="right").tolist())


def decoded(text: str, encoding: str) -> str:
    """The text with the UTF-8 sequences that this encoding shows in it decoded."""
    pattern, of, codes = sequences(encoding)

    def decode(found: str) -> str:
        if "�" not in found:
            try:
                return found.translate(codes).encode("latin-1").decode("utf-8")
            except UnicodeDecodeError:
                return found
        out, at = [], 0
        while at < len(found):
            lead = of[found[at]]
            size = 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
            one = found[at : at + size]
            try:
                out.append("�" if "�" in one else bytes(of[c] for c in one).decode("utf-8"))
            except UnicodeDecodeError:
                out.append(one)
            at += size
        return "".join(out)

    parts = pattern.split(text)  # every second one is a run of sequences
    runs = parts[1::2]
    if runs:
        # All at once; those with lost bytes, and those that may be no valid UTF-8, by themselves.
        new = "\n".join(["" if "�" in run else run for run in runs]).translate(codes).encode("latin-1").decode("utf-8", "replace").split("\n")
        parts[1::2] = [decode(run) if not text or "�" in text else text for run, text in zip(runs, new, strict=True)]
    return "".join(parts)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def by_word(values: np.ndarray, places: np.ndarray, spaces: np.ndarray) -> np.ndarray:
    """Sums by word (rows) and chain (columns) of values by chain and place; ``spaces`` are the places before the words, and the end."""
    starts = np.searchsorted(places, spaces)
    some = np.flatnonzero(starts[:-1] < starts[1:])
    out = np.zeros((len(spaces) - 1, len(values)), dtype=np.float64)
    if len(some):
        out[some] = np.add.reduceat(values, starts[some], axis=1, dtype=np.float64).T
    return out


def shown_words(words: list[str], model: Model) -> list[dict[str, tuple[str, float]]]:
    """(new, gain) by encoding, of the UTF-8 chains that change each word. No chain takes or makes a space, so that lines follow from their words."""
    raw = code_points(f" {' '.join(words)} ")
    first, others = mark_tables()
    marks = np.bitwise_or.reduceat(first[raw[:-1]] & others[raw[1:]], np.flatnonzero(raw == 32)[:-1])
    found = []
    for k, wrong in enumerate(WRONG):
        # Only words in which the encoding shows the beginning of a sequence are decoded.
        places = np.flatnonzero(marks >> k & 1).tolist()
        if places:
            new = decoded(" ".join([words[i] for i in places]), wrong).split(" ")
            found += [(i, wrong, text) for i, text in zip(places, new, strict=True) if text != words[i]]
    out: list[dict[str, tuple[str, float]]] = [{} for _ in words]
    if found:
        before, after = model.word_scores([" ".join([words[i] for i, _, _ in found]), " ".join([text for _, _, text in found])])
        for (i, wrong, text), gain in zip(found, (after - before).tolist(), strict=True):
            out[i][wrong] = (text, gain)
    return out


def changed_words(words: list[str], model: Model) -> list[tuple[list[float], list[int], tuple[int, ...], float, int]]:
    """What chains of single bytes make of each word: gains and numbers of changed characters by chain, the chains that gain, the largest gain
    and, as bits, the chains that leave the beginning of a UTF-8 sequence."""
    raw = code_points(f" {' '.join(words)} ")
    spaces = np.flatnonzero(raw == 32)
    number, letters = byte_tables()
    numbers = number[raw]
    places = np.flatnonzero(numbers)
    # Only transitions from and to these characters change.
    touched = np.zeros(len(raw), dtype=bool)
    touched[places] = touched[places - 1] = True
    steps = np.flatnonzero(touched)
    before = model.logs[model.ids[raw[steps]], model.ids[raw[steps + 1]]]
    first, others = mark_tables()
    n = letters.shape[1]
    gains, counts, left = np.zeros((len(words), n)), np.zeros((len(words), n), dtype=np.int64), np.zeros(len(words), dtype=np.int64)
    # For a long word fewer chains at once.
    some = max(1, n * TOGETHER // len(raw))
    for k in range(0, n, some):
        texts = np.repeat(raw[None], min(some, n - k), axis=0)
        texts[:, places] = letters[numbers[places], k : k + some].T
        after = model.ids[texts]
        gains[:, k : k + some] = by_word(model.logs[after[:, steps], after[:, steps + 1]].astype(np.float64) - before, steps, spaces)
        counts[:, k : k + some] = by_word(texts[:, places] != raw[places], places, spaces)
        marked = np.bitwise_or.reduceat(first[texts[:, :-1]] & others[texts[:, 1:]], spaces[:-1], axis=1).T != 0
        left |= marked @ (1 << np.arange(k, k + len(texts), dtype=np.int64))
    most = np.maximum(gains.max(axis=1), 0.0).tolist()
    return [(g, n, tuple([k for k, x in enumerate(g) if x > 0]) if m else (), m, u) for g, n, m, u in zip(gains.tolist(), counts.tolist(), most, left.tolist(), strict=True)]


def views(words: Iterable[str], held: dict, of_words: Callable, model: Model) -> dict:
    """What ``of_words`` gives for each word, looked up or taken for many words at once. The task holds up to WORDS_HELD of them."""
    out, new = {}, []
    for word in words:
        if word in held:
            out[word] = held[word]
        else:
            new.append((None, word))
    for group in together(new):
        some = [word for _, word in group]
        found = dict(zip(some, of_words(some, model), strict=True))
        out |= found
        if len(held) + len(found) > WORDS_HELD:
            held.clear()
        held.update(islice(((w, x) for w, x in found.items() if len(w) <= LONG_WORD), WORDS_HELD))
    return out


def with_words(words: list[str], places: list[int], new: list[str]) -> str:
    """The words joined, with those at ``places`` replaced by the new ones."""
    out = words.copy()
    for i, word in zip(places, new, strict=True):
        out[i] = word
    return " ".join(out)


def best_stretch(gains: list[float]) -> tuple[int, int, float]:
    """Stretch (from, to) with the largest sum of gains; an empty one if nothing gains."""
    lo = hi = start = 0
    best = gain = 0.0
    for k, more in enumerate(gains):
        if gain == 0:
            start = k
        gain = max(0.0, gain + more)
        if gain > best:
            lo, hi, best = start, k + 1, gain
    return lo, hi, best


def together(rows: list[tuple], most: int = TOGETHER) -> Iterator[list[tuple]]:
    """The rows in groups of about ``most`` characters, which the second column counts."""
    group, size = [], 0
    for row in rows:
        if group and size + len(row[1]) > most:
            yield group
            group, size = [], 0
        group.append(row)
        size += len(row[1])
    if group:
        yield group


def best_repairs(lines: Iterable[str], model: Model) -> Iterator[tuple[float, list[str], str]]:
    """``best_of`` all lines, for as many of them at once as their candidates leave room."""
    for group in together([(None, line) for line in lines], LOOKED_AT):
        yield from best_of([line for _, line in group], model)


def best_of(lines: list[str], model: Model) -> list[tuple[float, list[str], str]]:
    """(gain, chains, text) of each line's likeliest candidate that reads like clean text; a gain of 0 if none does.

    Every chain is tried on the lines, and again on the results: all chains where the first one was UTF-8, UTF-8 where it was of single bytes.
    A chain of UTF-8 decodes the whole line, one of single bytes the stretch of words that gains most; words of ASCII only count as they stand.
    The words of all lines are tried together. What can't be accepted and what no further chain can change isn't written out in the first round.
    """
    best: list[tuple[float, list[str], str]] = [(0.0, [], line) for line in lines]
    parts = [line.split(" ") for line in lines]
    places = [[i for i, w in enumerate(words) if not w.isascii()] for words in parts]
    # Of each candidate only the words that aren't ASCII, since no chain makes ASCII of them.
    rows = [(n, " ".join([parts[n][i] for i in at]), [], 0.0) for n, at in enumerate(places) if at]
    tried: dict[int, set[str]] = {n: {now} for n, now, _, _ in rows}
    for turn in range(ROUNDS):
        further, single, last = [], [gain for gain, _, _ in best], turn == ROUNDS - 1
        for group in together(rows):
            asked = [now.split(" ") for _, now, _, _ in group]
            shown = views(dict.fromkeys(chain.from_iterable(asked)), model.shown, shown_words, model)
            utf8 = [all_utf8(chains) for _, _, chains, _ in group]
            changed = views(dict.fromkeys(chain.from_iterable(compress(asked, utf8))), model.changed, changed_words, model)
            for (n, now, chains, had), words, only_utf8 in zip(group, asked, utf8, strict=True):
                # Where UTF-8 and single bytes follow each other, so much must be gained.
                mixed = single[n] + TWOFOLD * LEAST_CHANGED * GAIN_EACH
                by = [shown[w] for w in words]
                for wrong in [x for x in WRONG if any([x in y for y in by])] if any(by) else ():
                    gain = had + sum([y[wrong][1] for y in by if wrong in y])
                    if last and (gain <= best[n][0] or not only_utf8 and gain < mixed):
                        continue
                    text = " ".join([y[wrong][0] if wrong in y else w for y, w in zip(by, words, strict=True)])
                    if text in tried[n]:
                        continue
                    # Missing glyphs alone are no sequence.
                    if "�" in now and all("�" in m.group() for m in sequences(wrong)[0].finditer(now)):
                        continue
                    tried[n].add(text)
                    found = [*chains, f"utf-8 as {wrong}"]
                    if gain > best[n][0] and (only_utf8 or gain >= mixed):
                        whole = with_words(parts[n], places[n], text.split(" "))
                        if reads(lines[n], whole, model):
                            best[n] = (gain, found, whole)
                    further.append((n, text, found, gain))
                if not only_utf8:
                    continue
                of_words = [changed[w] for w in words]
                # Rounding may differ between sums.
                if last and had + sum([x[3] for x in of_words]) < best[n][0] - 1e-6:
                    continue
                least = TWOFOLD * LEAST_CHANGED if chains else LEAST_CHANGED
                # A chain that no word gains by has no stretch.
                for k in sorted(set().union(*[x[2] for x in of_words])):
                    lo, hi, more = best_stretch([x[0][k] for x in of_words])
                    gain = had + more
                    if last and gain <= best[n][0] or sum([x[1][k] for x in of_words]) < LEAST_CHANGED:
                        continue
                    count = sum([x[1][k] for x in of_words[lo:hi]])
                    able = gain > best[n][0] and count >= least and more >= GAIN_EACH * count and (not chains or gain >= mixed)
                    # In the last round a text that isn't accepted counts as tried, so that it isn't accepted the other way round, with less asked for.
                    if not able and not last and not any([x[4] >> k & 1 for x in of_words[lo:hi]]) and not any(by[:lo]) and not any(by[hi:]):
                        continue
                    wrong, right = byte_chains()[0][k]
                    letters = letters_of(wrong, right)
                    text = " ".join([*words[:lo], " ".join(words[lo:hi]).translate(letters), *words[hi:]])
                    if text in tried[n]:
                        continue
                    tried[n].add(text)
                    found = [*chains, f"{right} as {wrong}"]
                    if able and reads_in_words(now, text, more, model, least):
                        best[n] = (gain, found, with_words(parts[n], places[n], text.split(" ")))
                    further.append((n, text, found, gain))
        rows = further
    return best


def all_utf8(chains: list[str]) -> bool:
    return all(c.startswith("utf-8") for c in chains)


def reads(line: str, text: str, model: Model) -> bool:
    """Whether what changed reads like clean text, with lost letters left out."""
    low = 0
    while low < min(len(line), len(text)) and line[low] == text[low]:
        low += 1
    high = 0
    while high < min(len(line), len(text)) - low and line[-1 - high] == text[-1 - high]:
        high += 1
    part = text[max(0, low - 1) : len(text) - max(0, high - 1)]
    steps = model.steps(part.replace("�", ""))
    return len(steps) == 0 or float(steps.mean()) >= CLEAN


def reads_in_words(line: str, text: str, gain: float, model: Model, least: int) -> bool:
    """For chains of single bytes: whether enough characters changed, each to its gain, into words that read like clean text."""
    pairs = [(a, b) for a, b in zip(line.split(" "), text.split(" "), strict=False) if a != b]
    changed = sum(x != y for a, b in pairs for x, y in zip(a, b, strict=False))
    inner = [model.steps(b) for _, b in pairs if len(b) > 1]
    if changed < least or not inner or 2 * sum(map(len, inner)) < changed:
        return False
    if any(ARABIC.search(b) and (ARABIC.search(a) or LATIN.search(b)) for a, b in pairs):
        return False
    return float(np.concatenate(inner).mean()) >= CLEAN_WORDS and gain >= GAIN_EACH * changed


def repair_all(texts: list[str], model: Model) -> Iterator[tuple[str, list[str]]]:
    """``repair`` of every text; the words of many pages' suspicious lines are tried together."""
    for at in range(0, len(texts), PAGES_TOGETHER):
        pages = [text.split("\n") for text in texts[at : at + PAGES_TOGETHER]]
        used: list[dict[int, list[str]]] = [{} for _ in pages]
        open_ = []
        for k, (text, lines) in enumerate(zip(texts[at : at + PAGES_TOGETHER], pages, strict=True)):
            numbers = [i for i in sorted(model.suspicious(text)) if not lines[i].isascii() and len(lines[i]) > 1]
            if numbers and not junk(text):
                open_ += [(k, i) for i in numbers]
        for _ in range(ROUNDS):  # a line may hold stretches of several chains
            repairs = lines_repaired(dict.fromkeys(pages[k][i] for k, i in open_), model)
            again = []
            for k, i in open_:
                gain, chains, new = repairs[pages[k][i]]
                if gain >= model.margin:
                    used[k].setdefault(i, []).extend(chains)
                    pages[k][i] = new
                    if model.suspicious(new):
                        again.append((k, i))
            open_ = again
        yield from ((text, chains) for text, chains in zip(map("\n".join, pages), ([c for i in sorted(u) for c in u[i]] for u in used), strict=True))


def lines_repaired(lines: Iterable[str], model: Model) -> dict[str, tuple[float, list[str], str]]:
    """The best repair of each line. Titles and notices come again on page after page, so that the task holds up to REPAIRS_HELD of them."""
    lines = list(lines)
    out = {x: model.repairs[x] for x in lines if x in model.repairs}
    new = [x for x in lines if x not in out]
    found = dict(zip(new, best_repairs(new, model), strict=True))
    if len(model.repairs) + len(found) > REPAIRS_HELD:
        model.repairs.clear()
    model.repairs.update(islice(found.items(), REPAIRS_HELD))
    return out | found


def repair(text: str, model: Model) -> tuple[str, list[str]]:
    """The text with its garbled lines restored, and the chains used."""
    return next(repair_all([text], model))


def of_utf8(encoding: str) -> tuple[str, str]:
    """Classes of the characters as which this encoding shows the first and the second byte of two-byte UTF-8 sequences."""
    chars = lambda low, high: "".join(re.escape(c) for c, b in bytes_of(encoding).items() if low <= b <= high)
    return f"[{chars(0xC2, 0xDF)}]", f"[{chars(0x80, 0xBF)}]"


#: In these encodings UTF-8 shows as letters of a script of its own, which the rules don't tell from text: three sequences in a row aren't clean.
OWN_SCRIPT = ["cp1256", "cp1251"]


@cache
def unclean() -> re.Pattern:
    return re.compile("|".join([UNCLEAN, *("(?:" + "".join(of_utf8(encoding)) + "){3}" for encoding in OWN_SCRIPT)]))


@cache
def classes() -> np.ndarray:
    """The classes that ``unclean`` speaks of, by code point, as bits in the order in which ``are_unclean`` has them."""
    out = np.zeros(0x110000, dtype=np.uint16)
    chars = "".join(map(chr, range(0x10000)))
    for k, of_class in enumerate([NEVER, LETTER, OTHER_SCRIPT, SMALL, CAPITAL, SIGN, ACCENTED, *chain.from_iterable(map(of_utf8, OWN_SCRIPT))]):
        out[[m.start() for m in re.finditer(of_class, chars)]] |= 1 << k
    return out


def are_unclean(text: str) -> np.ndarray:
    """For each line of the text whether ``unclean`` finds anything in it. A line end is in none of the classes, so that nothing reaches over it."""
    out = np.zeros(text.count("\n") + 1, dtype=bool)
    if text.isascii():
        return out
    raw = code_points(text + "\n" * 5)
    bits = classes()[raw]
    never, letter, other, small, capital, sign, accented, *own = range(7 + 2 * len(OWN_SCRIPT))
    n = len(raw) - 5
    at = lambda k, cls: bits[k : n + k] >> cls
    hit = at(0, never) | at(0, letter) & at(1, other) | at(0, other) & at(1, letter) | at(0, small) & at(1, capital)
    hit |= at(0, letter) & at(1, sign) & at(2, letter) | at(0, accented) & at(1, accented) & at(2, accented)
    for lead, rest in zip(own[::2], own[1::2], strict=True):
        pair = bits[:-1] >> lead & bits[1:] >> rest
        hit |= pair[:n] & pair[2 : n + 2] & pair[4 : n + 4]
    out[np.searchsorted(np.flatnonzero(raw[:n] == 10), np.flatnonzero(hit & 1))] = True
    return out


def is_unclean(line: str) -> bool:
    return bool(are_unclean(line)[0])


def clean_lines(text: str) -> list[str]:
    return [x for x, bad in zip(text.split("\n"), are_unclean(text).tolist(), strict=True) if not bad and len(x) > 1]


def held_out(line: str) -> bool:
    """A twentieth of all lines, by hash."""
    return xxhash.xxh64_intdigest(line.encode("utf-8", "replace"), seed=42) % 20 == 0


def count_pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Transitions of the clean lines, summed per batch."""
    for batch in batches:
        lines = [x for some in together([(None, text) for text in batch["text"]], LOOKED_AT) for x in clean_lines("\n".join([text for _, text in some])) if not held_out(x)]
        # A slice of lines at a time, so that the arrays stay small; a space parts all lines.
        slices = [np.minimum(np.frombuffer(" ".join(["", *lines[k : k + LINES_TOGETHER], ""]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32), 0xFFFF).astype(np.uint16) for k in range(0, max(1, len(lines)), LINES_TOGETHER)]
        seen = np.zeros(0x10000, dtype=bool)
        for raw in slices:
            seen[raw] = True
        chars = np.flatnonzero(seen)
        number = np.zeros(0x10000, dtype=np.int64)
        number[chars] = np.arange(len(chars))
        each = (codes[:-1] * len(chars) + codes[1:] for codes in map(number.__getitem__, slices))
        # Few characters have a counter for each pair; else the pairs are sorted.
        if len(chars) <= COUNTED:
            counts = np.zeros(len(chars) ** 2, dtype=np.int64)
            for pairs in each:
                counts += np.bincount(pairs, minlength=len(counts))
            pairs = np.flatnonzero(counts)
            n = counts[pairs]
        else:
            pairs, n = np.unique(np.concatenate(list(each)), return_counts=True)
        yield pd.DataFrame({"a": chars[pairs // len(chars)].astype(np.int32), "b": chars[pairs % len(chars)].astype(np.int32), "n": n})


def held_gains(model: Model) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """What any chain gains on the clean lines held out, and how many lines gain it."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            held = [x for text in batch["text"] if not text.isascii() for x in text.split("\n") if len(x) > 1 and not x.isascii() and held_out(x)]
            held = [x for some in together([(None, x) for x in held], LOOKED_AT) for x in clean_lines("\n".join([x for _, x in some]))]
            # Rounded, so that the number of different gains doesn't grow with the lines.
            counts = Counter(round(gain, 3) for gain, _, _ in best_repairs(held, model))
            yield pd.DataFrame({"gain": list(counts.keys()), "n": list(counts.values())}).astype({"gain": "float64", "n": "int64"})

    return work


def train(pages: DataFrame, text: str = "raw_text") -> Model:
    """Count all clean lines but for a twentieth (by hash), which validates the margin."""
    texts = pages.select(F.col(text).alias("text")).where("text is not null")
    pairs = cut(texts.mapInPandas(count_pairs, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n")))
    alphabet = pairs.groupBy("a").agg(F.sum("n").alias("_n")).orderBy(F.desc("_n"), "a").limit(ALPHABET - 1).select("a")
    model = Model(pairs.join(F.broadcast(alphabet), "a").join(F.broadcast(alphabet.select(F.col("a").alias("b"))), "b").select("a", "b", "n").toPandas())
    gains = texts.mapInPandas(held_gains(model), "gain double, n long").groupBy("gain").agg(F.sum("n").alias("n"))
    # What the rule for clean lines lets through of garbled ones is under a hundredth of them.
    most = gains.agg(F.percentile("gain", 0.98, F.col("n"))).collect()[0][0]
    model.margin = LEAST_MARGIN if most is None else max(LEAST_MARGIN, ROOM + most)
    return model


def restore(pages: DataFrame, model: Model, ids: list[str], text: str = "raw_text") -> DataFrame:
    """(ids, restored, chains) of every affected page."""
    rows = pages.select(*ids, F.col(text).alias("_text")).where(F.col("_text").rlike(r"[^\x00-\x7f]")).dropDuplicates()
    schema = rows.select(*ids).schema

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = list(repair_all(batch["_text"].tolist(), model))
            hit = np.array([bool(c) for _, c in out], dtype=bool)
            kept = batch.loc[hit, ids].reset_index(drop=True)
            kept["restored"] = [t for t, c in out if c]
            kept["chains"] = [list(dict.fromkeys(c)) for _, c in out if c]
            if len(kept):
                yield kept

    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    return rows.mapInPandas(work, f"{columns}, restored string, chains array<string>")
