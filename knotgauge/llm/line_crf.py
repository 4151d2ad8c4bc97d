"""Quality rules by line sequence labelling: a linear-chain CRF marks lines as content or boilerplate.

Each line with a word is one observation with a few binary features. Viterbi decoding marks the
lines of every whole text, and the share of words on content lines decides.

Labels come by document, not by line, so the lines' labels are latent in the fit. It starts from
weights that take symbols, capitals and repeats for boilerplate, and then, in turns, labels the
lines by Viterbi decoding under the document's label - a good document is at least GOOD_SHARE
content, a bad one at most BAD_SHARE: where it is not, boilerplate's scores are shifted for that
document as little as it takes - and fits the CRF to these labels. A bad document so keeps its
content lines, and a good one may have boilerplate. Where whole documents are of one kind, their
chains would teach that labels never change; so each fit also gets SPLICES sequences of a good
document's lines with a block of a bad one's boilerplate lines put in.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sliced


CONTENT, BOILERPLATE = 0, 1
#: Bounds of the fit: so many labelled documents (the least by hash of their id), each in stretches of so many lines, of
#: which a longer document gives so many, evenly spaced over all of it.
FIT_DOCUMENTS, STRETCH, STRETCHES = 1000, 60, 8
GOOD_SHARE, BAD_SHARE, TURNS = 0.8, 0.4, 3
SPLICES, BLOCK = 400, 6
#: Least shares of content that the fit chooses from.
SHARES = (0.5, 0.55, 0.6, 0.65, 0.7)
FEATURES = ("always", "few_words", "symbols_some", "symbols_many", "capitals", "repeats_some", "repeats_many", "again", "pipes", "digits", "marks", "no_end", "long_words", "short_words")
_symbols = re.compile(r"[#*$%&|<>]").findall
_WHITE = " \t\n\r\x0b\x0c"


@dataclass
class LineCrf:
    """weights: (2 labels, features); moves: (label before, label); least_share: of words on content lines in a document that is kept.

    The defaults serve where no labels are given.
    """

    weights: np.ndarray = field(default_factory=lambda: np.array([[1.0] + [0.0] * 13, [0, 0, 1.5, 3, 2, 1.5, 3, 1, 2, 0, 2, 0, 0, 0]], float))
    moves: np.ndarray = field(default_factory=lambda: np.array([[1.0, -1.0], [-1.0, 1.0]]))
    least_share: float = 0.5

    def viterbi(self, x: np.ndarray, score: np.ndarray | None = None) -> np.ndarray:
        """The likeliest labels of lines with features x (lines, features), or with these scores; ties go to content."""
        score = x @ self.weights.T if score is None else score
        if not len(x):
            return np.zeros(0, int)
        m00, m01, m10, m11 = self.moves.ravel().tolist()
        a, b = score[0].tolist()
        back = []
        for s, t in score[1:].tolist():
            from0, from1 = a + m00 >= b + m10, a + m01 >= b + m11
            back.append((0 if from0 else 1, 0 if from1 else 1))
            a, b = s + (a + m00 if from0 else b + m10), t + (a + m01 if from1 else b + m11)
        label = 0 if a >= b else 1
        path = [label]
        for step in reversed(back):
            label = step[label]
            path.append(label)
        return np.array(path[::-1])

    def fit(self, documents: list[tuple[np.ndarray, np.ndarray]], rounds: int = 60, l2: float = 0.05) -> LineCrf:
        """Maximizes the conditional log-likelihood of labelled lines (features, labels by line) by Adam steps over all sequences at once (padded)."""
        documents = [(x, y) for x, y in documents if len(x)]
        if len({int(v) for _, y in documents for v in y}) < 2:
            return self
        n, longest = len(documents), max(len(x) for x, _ in documents)
        x, there = np.zeros((n, longest, len(FEATURES))), np.zeros((n, longest), bool)
        y = np.zeros((n, longest), int)
        for i, (rows, labels) in enumerate(documents):
            x[i, : len(rows)], y[i, : len(rows)], there[i, : len(rows)] = rows, labels, True
        each = self._weigh(y, there)
        theta = np.concatenate([self.weights.ravel(), self.moves.ravel()])
        m, v = np.zeros_like(theta), np.zeros_like(theta)
        for t in range(1, rounds + 1):
            g = self.gradient(theta, x, y, there, each)[1] - l2 * theta / 100
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            theta = theta + 0.2 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        return LineCrf(theta[:-4].reshape(2, -1), theta[-4:].reshape(2, 2), self.least_share)

    @staticmethod
    def _weigh(y: np.ndarray, there: np.ndarray) -> np.ndarray:
        """Weights of the sequences: sequences count alike, and so do those with and without a boilerplate line."""
        some = (y * there).any(1)
        share = np.array([max(1, (~some).sum()), max(1, some.sum())]) / len(y)
        return (0.5 / share)[some.astype(int)] / there.sum(1) / len(y)

    @staticmethod
    def gradient(theta: np.ndarray, x: np.ndarray, y: np.ndarray, there: np.ndarray, each: np.ndarray) -> tuple[float, np.ndarray]:
        """The weighted conditional log-likelihood and its gradient, by forward and backward sums."""
        longest = x.shape[1]
        w, moves = theta[:-4].reshape(2, -1), theta[-4:].reshape(2, 2)
        s = x @ w.T
        alpha, beta = np.zeros_like(s), np.zeros_like(s)
        alpha[:, 0] = s[:, 0]
        for k in range(1, longest):
            alpha[:, k] = np.where(there[:, k, None], s[:, k] + np.logaddexp(alpha[:, k - 1, :1] + moves[0], alpha[:, k - 1, 1:] + moves[1]), alpha[:, k - 1])
        for k in range(longest - 2, -1, -1):
            onward = s[:, k + 1] + beta[:, k + 1]
            beta[:, k] = np.where(there[:, k + 1, None], np.logaddexp(moves[:, 0] + onward[:, :1], moves[:, 1] + onward[:, 1:]), 0)
        z = np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])
        p = np.exp(np.minimum(alpha + beta - z[:, None, None], 0))
        p[~there] = 0
        gold = np.stack([(y == 0) & there, (y == 1) & there], 2).astype(float)
        g_w = np.einsum("nkl,nkf->lf", (gold - p) * each[:, None, None], x)
        pair, g_m = there[:, 1:] & there[:, :-1], np.zeros((2, 2))
        score = (s * gold).sum((1, 2))
        for a in (0, 1):
            for b in (0, 1):
                found = (y[:, :-1] == a) & (y[:, 1:] == b) & pair
                q = np.exp(np.minimum(alpha[:, :-1, a] + moves[a, b] + s[:, 1:, b] + beta[:, 1:, b] - z[:, None], 0)) * pair
                g_m[a, b] = ((found - q) * each[:, None]).sum()
                score += moves[a, b] * found.sum(1)
        return float(((score - z) * each).sum()), np.concatenate([g_w.ravel(), g_m.ravel()])

    def labels_under(self, x: np.ndarray, words: np.ndarray, good: bool) -> np.ndarray:
        """Viterbi labels with boilerplate's scores shifted as little as the document's label asks for (in steps of 1)."""
        for shift in range(12):
            moved = x @ self.weights.T + np.array([0, -shift if good else shift])
            y = self.viterbi(x, moved)
            share = words[y == CONTENT].sum() / max(1, words.sum())
            if share >= GOOD_SHARE if good else share <= BAD_SHARE:
                break
        return y

    def fit_latent(self, documents: list[tuple[np.ndarray, np.ndarray, bool]], turns: int = TURNS) -> LineCrf:
        """Fits to documents (features, words by line, good), the lines' labels latent; then sets the least share of content by them."""
        documents = [(x, words, good) for x, words, good in documents if len(x)]
        if len({good for *_, good in documents}) < 2:
            return self
        crf = self
        for _ in range(turns):
            labelled = [(x, crf.labels_under(x, words, good)) for x, words, good in documents]
            crf = crf.fit(labelled + spliced(labelled))
        share = np.array([words[crf.viterbi(x) == CONTENT].sum() / max(1, words.sum()) for x, words, _ in documents])
        good = np.array([g for *_, g in documents])
        right = lambda least: (share[good] >= least).mean() + (share[~good] < least).mean()
        return LineCrf(crf.weights, crf.moves, max(SHARES, key=lambda least: (round(right(least), 9), -least)))


def spliced(labelled: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Sequences in which a block of 1 to BLOCK boilerplate lines stands among content lines, drawn with a fixed seed."""
    rng = np.random.default_rng(0)
    content = [x[y == CONTENT] for x, y in labelled if (y == CONTENT).all()]
    blocks = [x[y == BOILERPLATE] for x, y in labelled if (y == BOILERPLATE).any()]
    out = []
    for _ in range(SPLICES if content and blocks else 0):
        x, block = content[rng.integers(len(content))], blocks[rng.integers(len(blocks))]
        size = min(len(block), int(rng.integers(1, BLOCK + 1)))
        at, from_ = int(rng.integers(len(x) + 1)), int(rng.integers(len(block) - size + 1))
        y = np.zeros(len(x) + size, int)
        y[at : at + size] = BOILERPLATE
        out.append((np.concatenate([x[:at], block[from_ : from_ + size], x[at:]]), y))
    return out


def line_features(lines: list[str], word_lists: list[list[bytes]]) -> np.ndarray:
    """Features of the lines that have a word."""
    out, seen = [], set()
    for line, words in zip(lines, word_lists):
        if not words:
            continue
        n, chars = len(words), len(line)
        symbols = len(_symbols(line))
        distinct = len(set(words)) / n
        letters = sum(map(len, words))
        again = line in seen
        seen.add(line)
        capitals = n >= 2 and line.isupper()
        digits = sum(map(line.count, "0123456789")) > 0.2 * letters
        end = line.rstrip(_WHITE)[-1:]
        out.append((1, n < 4, symbols > 0.03 * chars, symbols > 0.12 * chars, capitals, n >= 6 and distinct < 0.65, n >= 6 and distinct < 0.35, again, line.count("|") >= 2, digits, line.count("!") > max(1, 0.2 * n), end not in ".!?:;\"'", letters > 12 * n, letters < 2.2 * n))
    return np.array(out, float).reshape(-1, len(FEATURES))


def repeated_window_words(words: list[bytes], width: int = 5) -> int:
    """Words in windows of `width` words that occur twice or more in the text."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    part, span, step = ids, 1, 1
    while span < width:  # exact ids of ever longer windows
        step = min(span, width - span)
        _, part = np.unique(part[:-step] * (int(part.max()) + 1) + part[step:], return_inverse=True)
        span += step
    counts = np.bincount(part)
    covered = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(counts[part] > 1)
    np.add.at(covered, at, 1)
    np.add.at(covered, at + width, -1)
    return int((np.cumsum(covered)[:-1] > 0).sum())


def split_lines(text: str) -> tuple[list[str], list[list[bytes]]]:
    lines = text.split("\n")
    return lines, [x.encode("utf-8", "surrogatepass").split() for x in lines]


def base_counts(text: str, lines: list[str], word_lists: list[list[bytes]]) -> tuple[int, int, int, int, int]:
    words = [w for ws in word_lists for w in ws]
    seen, dup = set(), 0
    for line, ws in zip(lines, word_lists):
        if ws:
            dup += line in seen
            seen.add(line)
    return len(words), len(text) - sum(map(text.count, _WHITE)), len(_symbols(text)), dup, repeated_window_words(words)


def stretches(x: np.ndarray, words: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """A document's lines for the fit: all of them, or STRETCHES stretches of STRETCH lines from its start to its end."""
    if len(x) <= STRETCH * STRETCHES:
        starts = range(0, len(x), STRETCH)
    else:
        starts = np.linspace(0, len(x) - STRETCH, STRETCHES).astype(int).tolist()
    return [(x[a : a + STRETCH], words[a : a + STRETCH]) for a in starts]


def fit_line_crf(docs: DataFrame, labels: DataFrame) -> LineCrf:
    """Fits on at most FIT_DOCUMENTS labelled documents (one text of each id: the least by hash); without labels of both kinds, the default CRF."""
    sample = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_DOCUMENTS)
    chosen = {int(r[0]): int(r[1]) for r in sample.collect()}
    if not chosen:
        return LineCrf()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1):
            found = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                lines, words = split_lines(text)
                counts = np.array([len(w) for w in words if w], "<i8")
                found += [(doc_id, k, x.astype(np.uint8).tobytes(), n.tobytes()) for k, (x, n) in enumerate(stretches(line_features(lines, words), counts))]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.binary(), pa.binary()))], names=["doc_id", "k", "x", "n"])

    few = F.broadcast(docs.sparkSession.createDataFrame([(i,) for i in chosen], "_id long"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(few, F.col("doc_id") == F.col("_id"), "left_semi")
    # repeated rows: one text of each id, whichever rows hold it
    texts = texts.groupBy("doc_id").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    found = texts.mapInArrow(run, "doc_id long, k int, x binary, n binary").collect()
    rows = [(np.frombuffer(bytes(r.x), np.uint8).reshape(-1, len(FEATURES)).astype(float), np.frombuffer(bytes(r.n), "<i8"), chosen[r.doc_id] != 0) for r in sorted(found, key=lambda r: (r.doc_id, r.k))]
    return LineCrf().fit_latent(rows)


def judge(text: str, crf: LineCrf) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, content_words of a text."""
    lines, words = split_lines(text)
    n, chars, symbols, dup, repeat = base_counts(text, lines, words)
    failed = n < 10 or 100 * repeat > 20 * n
    labels = crf.viterbi(line_features(lines, words))
    content = sum(len(w) for w, y in zip(filter(None, words), labels) if y == CONTENT)
    return n, chars, symbols, dup, repeat, failed, not failed and content >= crf.least_share * n, content


SCORED = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, content_words long"


def quality_rules(docs: DataFrame, crf: LineCrf) -> DataFrame:
    """Counts, base rule and verdict of each document.

    Null text has no words (base rule fails); null ids and repeated rows are judged like any other;
    a text without lines with words has no content. Empty table: no rows. content_words: words on
    lines that Viterbi decoding marks as content; kept if their share is at least crf.least_share.
    """
    kinds = [pa.int64()] * 6 + [pa.bool_()] * 2 + [pa.int64()]
    names = [x.split()[0] for x in SCORED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1):
            rows = [(doc_id, *judge(text, crf)) for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=names)

    return docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit("")).alias("text")).mapInArrow(run, SCORED)


def keep_good(docs: DataFrame, crf: LineCrf) -> DataFrame:
    """The documents that quality_rules() keeps, columns as they are; null, empty and long texts, repeated rows and an empty table as there.

    One pass: the verdict is a UDF over the text, nothing is joined.
    """

    @F.pandas_udf("boolean")
    def kept(texts: pd.Series) -> pd.Series:
        return pd.Series([judge(text or "", crf)[6] for text in texts], dtype=bool)

    return docs.where(kept(F.col("text")))
