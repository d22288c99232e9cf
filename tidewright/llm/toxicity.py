"""Toxicity: obfuscated words are restored by a noisy channel (Viterbi under a character model), then scored."""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, held_out_col, keeps, parts, stored, tidy, tune

#: Labelled rows that the classifier is fitted on at most.
FIT_ROWS = 30_000
#: Least texts that a word of the lexicon is in; what cross-validation chooses from: least share of the toxic texts that
#: it is in, least log odds. Inner folds.
MIN_TEXTS, SHARES, ODDS, INNER = 3, (0.002, 0.004, 0.008), (2.0, 2.5, 3.5), 3

#: The weights of a text's learned words add up to so much at most.
MOST_WEIGHT = 60.0
#: Tokens that a worker remembers as decoded; beyond it starts anew.
MOST_SEEN = 300_000

# fixed values: letters of the character model (0 is everything else), and what a sign may stand for
LETTERS = "abcdefghijklmnopqrstuvwxyzàáâãäåæçèéêëìíîïñòóôõöùúûüÿßœ"
STANDS_FOR = {
    "0": "oóòôõö", "1": "iíìîïl", "2": "z", "3": "eéèêë", "4": "aáàâãäå", "5": "sß", "6": "gb", "7": "t", "8": "bß", "9": "g",
    "@": "aáàâãäå", "$": "sß", "!": "iíìîïl", "|": "iíìîïl", "+": "t", "(": "cç", "€": "eéèêë",
}
LOOKALIKES = {  # Cyrillic and Greek for Latin, also by their capitals
    "а": "a", "в": "b", "е": "e", "һ": "h", "н": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "о": "o", "р": "p", "с": "c",
    "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԁ": "d", "α": "a", "β": "b", "ε": "e", "η": "hn", "ι": "i", "κ": "k", "μ": "mu", "ν": "nv",
    "ο": "o", "ρ": "p", "σ": "o", "τ": "t", "υ": "uy", "χ": "x", "γ": "y", "ω": "w", "ζ": "z",
}
EDGE = ".,;:?!\"'()[]{}<>*#$%&|-_~/\\@+=^`…«»“”„’"
# end of fixed values

N = 64
_SYMBOL = {c: i + 1 for i, c in enumerate(LETTERS)}
STANDS_FOR |= LOOKALIKES
_LOOKALIKE = re.compile(f"[{''.join(LOOKALIKES)}]")
_RUNS = re.compile(r"(.)\1+", re.DOTALL)
_TWICE = re.compile(r"(.)\1", re.DOTALL)
_TRIPLE = re.compile(r"(.)\1\1")
#: Neighbours of so many characters at most, one of them a single one, may be parts of one word.
PART = 3
#: Costs (negative logs) of the channel: a sign for a letter, a sign that was put in or stood between words.
SUBSTITUTED, INSERTED, KEPT_SIGN = 1.5, 1.0, 3.0
#: Costs of (nothing, a space) for a gap beside a single character, behind a part that ends in a sign, for other gaps.
GAP_AT_SINGLE, GAP_AT_SIGN, GAP = (0.2, 0.5), (1.0, 0.1), (3.0, 0.1)


def normal(text: str | None) -> str:
    """Lower case of the compatibility form: full-width letters, ligatures and wide spaces are plain ones then."""
    text = text or ""
    return (text if text.isascii() else unicodedata.normalize("NFKC", text)).lower()


def fixed(c: str) -> bool:
    """Whether a character stands for itself only."""
    return c in _SYMBOL or c.isalpha() and c not in STANDS_FOR


@dataclass
class CharModel:
    """Interpolated trigram model over LETTERS; log_p[a, b, c]."""

    log_p: np.ndarray

    @classmethod
    def from_counts(cls, codes: np.ndarray, counts: np.ndarray) -> CharModel:
        c3 = np.zeros(N**3)
        np.add.at(c3, codes, counts)
        c3 = c3.reshape(N, N, N)
        c2, c1 = c3.sum(0), c3.sum((0, 1))
        p1 = (c1 + 1) / (c1.sum() + N)
        p2 = (c2 + 20 * p1) / (c2.sum(1, keepdims=True) + 20)
        p3 = (c3 + 10 * p2[None]) / (c3.sum(2, keepdims=True) + 10)
        return cls(np.log(p3).astype(np.float32))

    def word(self, word: str) -> float:
        s = [0, 0, *(_SYMBOL.get(c, 0) for c in word), 0]
        return float(sum(self.log_p[s[i - 2], s[i - 1], s[i]] for i in range(2, len(s))))


Columns = list[list[tuple[str, float]]]


def lattice(token: str) -> Columns:
    """Columns of (text, cost): what each run of equal characters of the token may stand for. Gaps between the parts of
    a spread word are nothing or a space."""
    columns: Columns = []
    for m in re.finditer(r"\s+|(\S)\1*", token):
        c, n = m[1], len(m[0])
        if c is None:
            before, after = m.start() < 2 or token[m.start() - 2].isspace(), m.end() + 1 >= len(token) or token[m.end() + 1].isspace()
            sign = m.start() > 1 and not before and not token[m.start() - 1].isalnum()
            joined, apart = GAP_AT_SIGN if sign else GAP_AT_SINGLE if before or after else GAP
            columns.append([("", joined), (" ", apart)])
        elif fixed(c):
            columns.append([(c, 0.0)] if n == 1 else [(c, 2.0 if n == 2 else 1.0), (c * 2, 0.0 if n == 2 else 1.5), *([(c * n, 6.0)] if n > 2 else [])])
        else:
            options = [(x, SUBSTITUTED) for x in STANDS_FOR.get(c, "")]
            if n > 1:
                options += [(x * 2, SUBSTITUTED + 1) for x in STANDS_FOR.get(c, "")]
            columns.append([*options, ("", INSERTED if not c.isalnum() else 6.0), (" ", KEPT_SIGN), *([(c, 3.0)] if c.isalpha() else [])])
    return columns


class Lexicon:
    """Words with log probabilities, as a trie that is walked along a lattice."""

    def __init__(self, log_words: dict[str, float]):
        self.log_words = log_words
        self.root: dict = {}
        for word in log_words:
            node = self.root
            for c in word:
                node = node.setdefault(c, {})
            node[""] = word

    def reach(self, columns: Columns, start: int = 0) -> Iterator[tuple[int, str, float]]:
        """(end, word, least cost) of all words that the columns from start to end hold, with a break or the lattice's
        end behind them."""
        at: dict[int, tuple[dict, float]] = {id(self.root): (self.root, 0.0)}
        for i in range(start, len(columns)):
            new: dict[int, tuple[dict, float]] = {}
            for node, cost in at.values():
                for out, c in columns[i]:
                    to = node
                    for ch in out:
                        to = to.get(ch)
                        if to is None:
                            break
                    if to is not None and cost + c < new.get(id(to), (None, math.inf))[1]:
                        new[id(to)] = to, cost + c
            if not new:
                return
            at = new
            if i + 1 == len(columns) or any(out == " " for out, _ in columns[i + 1]):
                for node, cost in at.values():
                    if "" in node:
                        yield i + 1, node[""], cost

    def touches(self, columns: Columns) -> bool:
        """Whether some word lies between two breaks of the lattice."""
        starts = [0, *(i + 1 for i, column in enumerate(columns) if len(column) > 1 and any(out == " " for out, _ in column))]
        return any(next(self.reach(columns, i), None) is not None for i in starts)


def decode(columns: Columns, model: CharModel, known: Lexicon | None = None) -> str:
    """The likeliest original of a lattice (Viterbi over pairs of letters, all of them kept; exact).

    The words between breaks are rated by the character model, or, where known holds them, by their log probability
    (the character model begins anew behind such a word). A lattice of one path gives that path. States hold their text
    as links to what came before, so the time goes with the length of the token.
    """
    if all(len(c) == 1 for c in columns):
        return "".join(c[0][0] for c in columns)
    log_p, n = model.log_p, len(columns)
    # a state is the last two symbols and whether a word may begin
    states: list[dict[tuple[int, int, bool], tuple[float, tuple | None]]] = [{} for _ in range(n + 1)]
    states[0][0, 0, True] = 0.0, None
    ends: list[tuple[float, tuple | None]] = []

    def put(i: int, key: tuple[int, int, bool], score: float, links: tuple | None) -> None:
        if key not in states[i] or score > states[i][key][0]:
            states[i][key] = score, links

    for i in range(n):
        if known is not None and (edge := [v for k, v in states[i].items() if k[2]]):
            before, links = max(edge, key=lambda v: v[0])
            for j, word, cost in known.reach(columns, i):
                score = before + known.log_words[word] - cost
                if j == n:
                    ends.append((score, (links, word)))
                else:
                    put(j + 1, (0, 0, True), score - min(c for out, c in columns[j] if out == " "), ((links, word), " "))
        for (a, b, edge), (score, links) in states[i].items():
            for out, cost in columns[i]:
                x, y, s = a, b, score - cost
                for ch in out:
                    z = _SYMBOL.get(ch, 0)
                    s += log_p[x, y, z]
                    x, y = y, z
                put(i + 1, (x, y, out == " " or edge and not out), s, (links, out) if out else links)
        states[i].clear()
    ends += [(s + log_p[a, b, 0], links) for (a, b, _), (s, links) in states[n].items()]
    best = max(s for s, _ in ends)
    return max(spelled(links) for s, links in ends if s == best)


def spelled(links: tuple | None) -> str:
    """The text of a state's links."""
    out = []
    while links:
        links, last = links
        out.append(last)
    return "".join(reversed(out))


def core(token: str) -> str:
    """A token without the signs around it; one sign before it that may stand for a letter stays."""
    inner = token.strip(EDGE)
    at = token.find(inner) if inner else 0
    return token[0] + inner if at == 1 and token[0] in "$@(" and inner else inner


def plain(inner: str) -> bool:
    """Whether only the runs of a token can be read in several ways."""
    return inner.isalpha() and (inner.isascii() or not _LOOKALIKE.search(inner))


def spread(tokens: list[str]) -> list[str]:
    """Stretches of short neighbours with single characters among them, over which a word may be spread, with one space
    for each gap."""
    runs, end = [], 0
    for i in [i for i, t in enumerate(tokens) if len(t) == 1]:
        if i < end:
            continue
        start, end = i, i + 1
        while start and len(tokens[start - 1]) <= PART:
            start -= 1
        while end < len(tokens) and len(tokens[end]) <= PART:
            end += 1
        if end - start > 1 and any(c.isalpha() for t in tokens[start:end] for c in t):
            runs.append(" ".join(tokens[start:end]))
    return runs


def restore_words(text: str | None, model: CharModel, cache: dict[str, tuple[str, ...]], known: Lexicon | None = None) -> list[str]:
    """All words of a whole text as the channel decodes them (lower case), in order: spread words, then tokens.

    A token without a letter is no word. The stretches that a word may be spread over are decoded as a whole, and their
    tokens count by themselves only where that leaves them as they are.
    """
    tokens = normal(text).split()
    words: list[str] = []
    for run in spread(tokens):
        got = cache.get(run)  # runs hold a space, tokens don't
        if got is None:
            apart = set(run.split())
            got = cache[run] = tuple(w for w in decode(lattice(run), model, known).split() if w not in apart)
        words += got
    for token in tokens:
        got = cache.get(token)
        if got is None:
            inner = core(token)
            if plain(inner) and not _TRIPLE.search(inner) and known is None:
                got = (inner,)
            elif any(c.isalpha() for c in inner):
                got = tuple(decode(lattice(inner), model, known).split())
            else:
                got = ()
            cache[token] = got
        words += got
    return words


def features_of(found: dict[str, int], weights: dict[str, float], n_tokens: int) -> tuple[float, float, float, float]:
    """What the logistic model sees of a restored text: the weights of its learned words, how many, and how dense."""
    n = sum(found.values())
    return 1.0, min(sum(weights[w] for w in found), MOST_WEIGHT), math.log1p(n), math.log1p(1000 * n / (n_tokens + 50))


@dataclass
class Scorer:
    """Learned words with their weights and the logistic model over the learned words of a restored text."""

    model: CharModel
    weights: dict[str, float]
    log_words: dict[str, float]
    coef: np.ndarray = field(default_factory=lambda: np.array([-3.0, 0.5, 0.5, 0.0]))

    def __post_init__(self) -> None:
        self.lexicon = Lexicon({w: max(p, self.model.word(w)) for w, p in self.log_words.items()})
        self.by_runs = {_RUNS.sub(r"\1", w) for w in self.weights}
        self.seen: set[str] = set()
        self.hits: dict[str, list[str]] = {}
        self.hit_tokens: set[str] = set()

    def forget(self) -> None:
        self.seen.clear()
        self.hits.clear()
        self.hit_tokens.clear()

    def learned_in(self, token: str) -> list[str]:
        """The learned words of a token's restored text. A lattice that holds no learned word between two breaks can't
        give one, so it isn't decoded; where all letters stand for themselves, that is told by its runs."""
        inner = token if token.isalpha() else core(token)
        if plain(inner):
            if _TWICE.search(inner) is None:
                return [inner] if inner in self.weights else []
            if _RUNS.sub(r"\1", inner) not in self.by_runs:
                return []
            columns = lattice(inner)
        elif any(c.isalpha() for c in inner):
            columns = lattice(inner)
            if not self.lexicon.touches(columns):
                return []
        else:
            return []
        return [w for w in decode(columns, self.model, self.lexicon).split() if w in self.weights]

    def found(self, tokens: list[str]) -> Counter:
        """The learned words of a whole text's tokens as they are restored, with their numbers."""
        unique = set(tokens)
        if len(self.seen) > MOST_SEEN:
            self.forget()
        new = unique - self.seen
        self.seen |= new
        for token in new:
            if words := self.learned_in(token):
                self.hits[token] = words
                self.hit_tokens.add(token)
        found: Counter = Counter()
        if wanted := unique & self.hit_tokens:
            for t in tokens:
                if t in wanted:
                    found.update(self.hits[t])
        for run in spread(tokens):
            if run not in self.seen:
                self.seen.add(run)  # runs hold a space, tokens don't
                if words := self.spread_in(run):
                    self.hits[run] = words
            if run in self.hits:
                found.update(self.hits[run])
        return found

    def spread_in(self, run: str) -> list[str]:
        """The learned words of a restored stretch that none of its tokens is by itself."""
        columns = lattice(run)
        if not self.lexicon.touches(columns):
            return []
        apart = set(run.split())
        return [w for w in decode(columns, self.model, self.lexicon).split() if w in self.weights and w not in apart]

    def features(self, text: str | None) -> tuple[float, float, float, float]:
        tokens = normal(text).split()
        return features_of(self.found(tokens), self.weights, len(tokens))

    def score(self, text: str | None) -> float:
        return float(1 / (1 + math.exp(-min(max(float(np.dot(self.features(text), self.coef)), -30), 30))))


def char_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(code, n) of the letter trigrams of all whole texts: at most 64 ** 3 rows, summed in each task first."""
    table = np.full(0x250, 0, np.int64)
    for c, i in _SYMBOL.items():
        table[ord(c)] = i

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keeps()
        total = np.zeros(N**3, np.int64)
        for b in batches:
            text = "  ".join(["", *(normal(t) for t in b.column(0).to_pylist() if t), ""])
            points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
            s = np.where(points < 0x250, table[np.minimum(points, 0x24F)], 0)
            total += np.bincount(s[:-2] * N * N + s[1:-1] * N + s[2:], minlength=N**3)
        code = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(total[code])], names=["code", "n"])

    return docs.select(text_col).mapInArrow(count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def log_odds(bad: np.ndarray, fine: np.ndarray, total: tuple[int, int]) -> np.ndarray:
    return np.log((bad + 0.5) / (fine + 0.5)) + math.log(total[1] + 1) - math.log(total[0] + 1)


def in_lexicon(bad: np.ndarray, odds: np.ndarray, n_bad: int, share: float, least_odds: float) -> np.ndarray:
    """Which words belong: those that stand in enough toxic texts and are likely enough there."""
    return (bad >= max(MIN_TEXTS, share * n_bad)) & (odds >= least_odds)


def choose(toxic: np.ndarray, fold: np.ndarray, tokens: np.ndarray, row: np.ndarray, word: np.ndarray, times: np.ndarray) -> tuple[float, float]:
    """Share and odds of the fewest errors, then the least loss, on inner folds that words and model were not fitted on.

    toxic, fold and tokens of each row; row, word and times: which candidate words each row has, and how often. Of equal
    ones the strictest.
    """
    n_rows, n_words = len(toxic), int(word.max()) + 1 if len(word) else 0
    result: dict[tuple[float, float], list[float]] = {(s, o): [0, 0.0] for s in sorted(SHARES, reverse=True) for o in sorted(ODDS, reverse=True)}
    for f in range(INNER):
        inside = fold == f
        if not inside.any() or len(set(toxic[~inside].tolist())) < 2:
            continue
        total = int((toxic[~inside] == 1).sum()), int((toxic[~inside] == 0).sum())
        train = ~inside[row]
        bad = np.bincount(word[train & (toxic[row] == 1)], minlength=n_words)
        odds = log_odds(bad, np.bincount(word[train & (toxic[row] == 0)], minlength=n_words), total)
        for (share, least), sums in result.items():
            mine = in_lexicon(bad, odds, total[0], share, least)[word] if n_words else np.zeros(0, bool)
            n = np.bincount(row[mine], weights=times[mine], minlength=n_rows)
            weight = np.bincount(row[mine], weights=odds[word[mine]], minlength=n_rows)
            x = np.stack([np.ones(n_rows), np.minimum(weight, MOST_WEIGHT), np.log1p(n), np.log1p(1000 * n / (tokens + 50))], axis=1)
            p = 1 / (1 + np.exp(-np.clip(x[inside] @ logistic(x[~inside], toxic[~inside].astype(float)), -30, 30)))
            sums[0] += int(((p >= 0.5) != (toxic[inside] == 1)).sum())
            sums[1] -= float(np.log(np.where(toxic[inside] == 1, p, 1 - p)).sum())
    return min(result, key=lambda k: tuple(result[k]))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.5) -> np.ndarray:
    """Logistic regression by Newton steps."""
    coef, reg = np.zeros(x.shape[1]), np.diag([1e-3, *[ridge] * (x.shape[1] - 1)])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ coef, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + reg, x.T @ (p - y) + reg @ coef)
        coef -= step
        if np.abs(step).max() < 1e-8:
            break
    return coef


def fit_scorer(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", fit_rows: int = FIT_ROWS, folds: int = 5) -> Scorer:
    """Character model from all texts, words and logistic model from at most fit_rows labelled rows (a documented bound).

    Rows whose crc32(doc_id as text) mod folds is 0 are never learned from. The rows of least crc32 are taken, a text
    that occurs in several of them once. What makes a word one of the lexicon is chosen by cross-validation among those
    rows. All words that pass belong to it: their number is bounded by the rows, not by itself.
    """
    spark = docs.sparkSession
    got = char_counts(docs, text_col).collect()
    model = CharModel.from_counts(np.array([r[0] for r in got], np.int64), np.array([r[1] for r in got], float))
    picked = labels.where("toxic is not null and doc_id is not null").where(~held_out_col("doc_id", folds)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    picked = picked.orderBy(F.crc32(F.concat(F.lit("fit"), F.col("doc_id").cast("string")).cast("binary")), "doc_id").limit(fit_rows)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text")).join(F.broadcast(picked), "doc_id").select("doc_id", "toxic", F.md5(F.coalesce("_text", F.lit(""))).alias("_h"), "_text")
    # of an id with many rows, and of a text with many ids, one text each: at most fit_rows rows from here on
    rows = rows.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min(F.struct("_h", "_text")).alias("_t"))
    rows = rows.groupBy(F.col("_t._h").alias("_h")).agg(F.max("toxic").alias("toxic"), F.first("_t._text").alias("_text"))
    rows, rows_path = stored(rows.select("toxic", "_h", "_text").repartition(parts(spark), "_h"), "fit")
    shared = spark.sparkContext.broadcast(model)

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, tuple[str, ...]] = {}
        for b in batches:
            found = [Counter(w for w in restore_words(t, shared.value, cache) if len(w) > 2) for t in b.column(2).to_pylist()]
            n = [len((t or "").split()) for t in b.column(2).to_pylist()]
            fold = [zlib.crc32(h.encode()) % INNER for h in b.column(1).to_pylist()]
            toxic = [int(t == 1) for t in b.column(0).to_pylist()]
            pairs = pa.array([list(c.items()) for c in found], pa.map_(pa.string(), pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(toxic, pa.int32()), pa.array(fold, pa.int32()), pa.array(n, pa.int32()), pairs], names=["toxic", "fold", "n", "words"])
            if len(cache) > MOST_SEEN:
                cache.clear()
        tidy()

    restored, restored_path = stored(rows.mapInArrow(words, "toxic int, fold int, n int, words map<string,int>"), "restored")
    n_bad, n_fine = (int(x or 0) for x in restored.agg(F.sum("toxic"), F.sum(1 - F.col("toxic"))).first())
    counted = restored.select("toxic", F.explode("words").alias("word", "_n")).groupBy("word").agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("fine"))
    likelier = F.log((F.col("bad") + 0.5) / (n_bad + 1)) - F.log((F.col("fine") + 0.5) / (n_fine + 1))
    # what no choice below is likely to take needn't come to the driver
    counts = {r["word"]: (r["bad"], r["fine"]) for r in counted.where((F.col("bad") >= MIN_TEXTS - 1) & (likelier >= min(ODDS) - 0.7)).collect()}
    numbers = spark.sparkContext.broadcast({w: i for i, w in enumerate(sorted(counts))})

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pairs = [[(numbers.value[w], n) for w, n in found if w in numbers.value] for found in b.column(3).to_pylist()]
            lists = [pa.array([[p[i] for p in x] for x in pairs], pa.list_(pa.int32())) for i in range(2)]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(3)), *lists], names=["toxic", "fold", "n", "words", "times"])

    seen = sorted(tuple(r) for r in restored.mapInArrow(candidates, "toxic int, fold int, n int, words array<int>, times array<int>").collect())
    drop(spark, restored_path)
    weights = {}
    if n_bad and n_fine:
        flat = [np.array([x for r in seen for x in r[i]], np.int64) for i in (3, 4)]
        share, least = choose(*(np.array([r[i] for r in seen]) for i in range(3)), np.repeat(np.arange(len(seen)), [len(r[3]) for r in seen]), *flat)
        names, (bad, fine) = sorted(counts), np.array([counts[w] for w in sorted(counts)], np.int64).reshape(-1, 2).T
        odds = log_odds(bad, fine, (n_bad, n_fine))
        weights = {names[i]: float(odds[i]) for i in np.flatnonzero(in_lexicon(bad, odds, n_bad, share, least))}
    scorer = Scorer(model, weights, {w: math.log(sum(counts[w]) / (n_bad + n_fine) / 300) for w in weights})
    sent = spark.sparkContext.broadcast(scorer)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [sent.value.features(t) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int32()), *(pa.array([r[i] for r in x], pa.float64()) for i in (1, 2, 3))], names=["toxic", "a", "b", "c"])
        sent.value.forget()
        tidy()

    seen = sorted(tuple(r) for r in rows.mapInArrow(measure, "toxic int, a double, b double, c double").collect())
    drop(spark, rows_path)
    if n_bad and n_fine:
        scorer.coef = logistic(np.array([[1.0, *r[1:]] for r in seen]), np.array([float(r[0] == 1) for r in seen]))
    return scorer


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", fit_rows: int = FIT_ROWS, folds: int = 5) -> DataFrame:
    """Per row of docs: doc_id, held_out, score (0 to 1), predicted (score of a half or more).

    A score depends on the text alone: null and empty texts get that of a text without hits; repeated rows get equal
    scores; without usable labels nothing is predicted. Whole texts are read. An empty table gives no rows. Scoring
    needs no shuffle; the model (the learned words, as many as the fitted rows give, and a 1 MB table) goes out once per executor.
    """
    spark = tune(docs.sparkSession)
    sent = spark.sparkContext.broadcast(fit_scorer(docs, labels, id_col, text_col, fit_rows, folds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keeps()
        for b in batches:
            score = [sent.value.score(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score, pa.float64()), pa.array([int(s >= 0.5) for s in score], pa.int32())], names=["doc_id", "score", "predicted"])
        sent.value.forget()
        tidy()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("_text"))
    return rows.mapInArrow(run, "doc_id long, score double, predicted int").select("doc_id", held_out_col("doc_id", folds).alias("held_out"), "score", "predicted")


def drop_toxic(docs: DataFrame, labels: DataFrame, text_col: str = "text", fit_rows: int = FIT_ROWS) -> DataFrame:
    """The rows of docs whose score is below a half, with all their columns."""
    spark = tune(docs.sparkSession)
    sent = spark.sparkContext.broadcast(fit_scorer(docs, labels, "doc_id", text_col, fit_rows))
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keeps()
        for b in batches:
            yield b.filter(pa.array([sent.value.score(t) < 0.5 for t in b.column(at).to_pylist()], pa.bool_()))
        sent.value.forget()
        tidy()

    return docs.mapInArrow(run, docs.schema)
