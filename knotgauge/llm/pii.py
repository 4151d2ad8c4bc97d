"""Personal data: fixed patterns, and a skip-chain CRF that labels what repeats or resembles what they find.

Nodes of a document's CRF are its words with a digit or an at sign (all others are clamped to
"nothing"). Neighbouring nodes share a chain potential; each node also shares a skip potential
with one hub per key, a hidden node for all its occurrences in the document, however distant:
links grow with the occurrences, not with their square, and each is one link from any other. The
key is the word's digits if it has seven, else the word (equal words have equal digits). A hub
with an occurrence in a pattern's span is observed, as the pattern is certain: no number of bare
occurrences outvotes it. Loopy sum-product messages, run until they settle, give marginals; a
node outside the patterns' spans that is likelier one kind than nothing becomes a span of that
kind.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sliced


#: Fixed values of the contract: kinds in their order. "secret" is found by the CRF alone.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_at = re.compile("@").finditer
_domain = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+").match
# A digit run that fails from its start fails from anywhere inside; the look-behind keeps long runs linear.
_ip = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+").finditer
_card = re.compile(r"[0-9](?:[\x20-]?[0-9])+").finditer
_phone = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]").finditer
_digits = re.compile(r"[^0-9]+")
_hint = re.compile("[0-9@]").search
_word = re.compile(r"[^\x20\x09-\x0D]+").finditer
_secret = re.compile(r"[A-Za-z0-9_\-/+]{16,}={0,2}").fullmatch
_named = re.compile(r"token|secret|passw|api[_-]?key|credential", re.I).search

#: Potentials, in log units: of words in a pattern's span, of nothing, of skip and chain links between equal labels.
IN_SPAN, NOTHING, SKIP, CHAIN = 6.0, 2.0, 2.0, 0.6
DAMPING, SETTLED = 0.3, 1e-4


def passes_luhn(digits: str) -> bool:
    total = 0
    for i, x in enumerate(map(int, reversed(digits))):
        x = x * 2 if i % 2 else x
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans (kind, start, end) of the fixed patterns by start, then kind; offsets in code points, end exclusive."""
    out, free = [], 0
    for m in _at(text):
        at = start = m.start()
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and at >= free and (d := _domain(text, at + 1)):
            out.append(("email", start, free := d.end()))
    for m in _ip(text):
        if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m.group().split(".")):
            out.append(("ip", *m.span()))
    for m in _card(text):
        if m.end() - m.start() >= 14 and 14 <= len(digits := _digits.sub("", m.group())) <= 19 and passes_luhn(digits):
            out.append(("card", *m.span()))
    for m in _phone(text):
        if 10 <= len(_digits.sub("", m.group())) <= 15:
            out.append(("phone", *m.span()))
    return sorted(out, key=lambda x: (x[1], BASE.index(x[0])))


def _unary(word: str, before: tuple[str, str]) -> list[float]:
    """Scores of nothing and of each kind for a word outside the patterns' spans."""
    core = word.strip("\"'`()[]{}<>,;:.!?#*$%&|")
    digits, letters = sum(map(core.count, "0123456789")), sum(map(str.isalpha, core))
    score = [NOTHING, 0.0, 0.0, 0.0, 0.0, 0.0]
    if "@" in core[1:-1]:
        score[1] += 1.2
    if core.count(".") == 3 and digits >= 4 and not letters:
        score[2] += 1.2
    if 14 <= digits <= 19 and not letters:
        score[3] += 1.2
    if 7 <= digits <= 15 and not letters:
        score[4] += 1.0
    if len(core) >= 16 and digits >= 4 and letters >= 4 and _secret(core):
        score[5] += 2.2 + 0.3 * (word[:1] in "\"'") + 2.0 * bool(_named(before[0]) or _named(before[1]) or _named(word.split("=")[0] if "=" in word else ""))
        score[5] += 0.8 * (len(core) >= 32)
    return score


def settle(u: np.ndarray, edges: list[tuple[int, int, float]], chains: int, most_rounds: int = 10_000) -> np.ndarray:
    """Scores of all nodes once the messages have settled; the first `chains` edges bind entities only."""
    a, b, w = (np.array(c) for c in zip(*edges))
    source, target, n = np.concatenate([a, b]), np.concatenate([b, a]), len(edges)
    bonus = np.repeat(w[:, None], u.shape[1], 1)
    bonus[:chains, 0] = 0.0
    gain = np.expm1(np.concatenate([bonus, bonus]))
    message = np.zeros((2 * n, u.shape[1]))
    back = np.concatenate([np.arange(n, 2 * n), np.arange(n)])
    for _ in range(most_rounds):
        belief = u.copy()
        np.add.at(belief, target, message)
        out = belief[source] - message[back]
        out -= out.max(1, keepdims=True)
        p = np.exp(out)
        new = np.log(p.sum(1, keepdims=True) + p * gain)
        new -= new.max(1, keepdims=True)
        if np.abs(new - message).max() < SETTLED:
            return belief
        message = DAMPING * message + (1 - DAMPING) * new
    raise RuntimeError(f"messages did not settle in {most_rounds} rounds")


def skip_chain_spans(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """The spans that the CRF adds to the patterns' spans."""
    nodes, places, unary, keys = [], [], [], []
    before, at, reach = ("", ""), 0, []  # reach: spans that begin before the word's end and reach into it
    for k, m in enumerate(_word(text)):
        word = m.group()
        if _hint(word):
            while at < len(base) and base[at][1] < m.end():
                reach.append(base[at])
                at += 1
            reach = inside = [x for x in reach if x[2] > m.start()]
            score = [NOTHING if not inside else 0.0] + [0.0] * len(KINDS) if inside else _unary(word, before)
            for kind, _, _ in inside:
                score[1 + KINDS.index(kind)] = IN_SPAN
            core = word.strip("\"'`()[]{}<>,;:.!?#*$%&|").lower()
            digits = _digits.sub("", core)
            nodes.append(k)
            places.append((m.start(), m.end(), bool(inside), core))
            unary.append(score)
            keys.append("#" + digits if len(digits) >= 7 else core if len(core) >= 6 else "")
        before = (before[1], word)
    if not nodes:
        return []
    u = np.array(unary)
    edges = [(i - 1, i, CHAIN) for i in range(1, len(nodes)) if nodes[i] == nodes[i - 1] + 1]
    chains, groups = len(edges), {}
    for i, key in enumerate(keys):
        if key:
            groups.setdefault(key, []).append(i)
    hidden = 0
    for some in groups.values():
        seen = [i for i in some if places[i][2]]
        if seen:
            p = np.exp(u[seen].max(0))
            u[[i for i in some if not places[i][2]]] += np.log1p(p / p.sum() * np.expm1(SKIP))
        elif len(some) > 1:
            edges += [(i, len(nodes) + hidden, SKIP) for i in some]
            hidden += 1
    u = np.concatenate([u, np.zeros((hidden, u.shape[1]))])
    marginal = settle(u, edges, chains) if edges else u
    found = []
    for (start, end, inside, core), row in zip(places, marginal):
        if not inside and (k := int(row.argmax())) and core:
            lead = text[start:end].lower().find(core)
            found.append((KINDS[k - 1], start + lead, start + lead + len(core)) if lead >= 0 else (KINDS[k - 1], start, end))
    return found


def all_spans(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Pattern spans, and all spans by start, then kind. Texts without a digit or an at sign have none."""
    if not _hint(text):
        return [], []
    base = base_spans(text)
    return base, sorted(base + skip_chain_spans(text, base), key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def redact(text: str | None) -> str | None:
    """The text with each span, or run of overlapping spans, replaced by its kind in brackets.

    Replacing one span can lay bare another (digits that ran on into it): repeated until none is left. Each pass takes digits or at signs away, so it ends.
    """
    while text and (spans := all_spans(text)[1]):
        out, at = [], 0
        for kind, start, end in spans:
            if start >= at:
                out += [text[at:start], f"[{kind.upper()}]"]
            at = max(at, end)
        text = "".join([*out, text[at:]])
    return text


def _join(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


FOUND = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def find_personal_data(docs: DataFrame) -> DataFrame:
    """Counts of pattern spans by kind, the digest of the pattern spans, and all spans, for each document.

    Null text counts as empty and has no spans; null ids and repeated rows are searched like any
    other. Empty table: no rows.
    """
    kinds = [pa.int64()] * 5 + [pa.string()] * 2
    names = [x.split()[0] for x in FOUND.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1):
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                base, every = all_spans(text)
                counts = [sum(k == kind for k, _, _ in base) for kind in BASE]
                rows.append((doc_id, *counts, hashlib.sha256(_join(base).encode()).hexdigest(), _join(every)))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=names)

    return docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit("")).alias("text")).mapInArrow(run, FOUND)


def redact_personal_data(docs: DataFrame) -> DataFrame:
    """The documents with their spans redacted; n_chars, where there, follows the new text.

    Null text stays null, empty text empty; null ids and repeated rows are redacted like any other.
    Other columns keep names and values. Empty table: no rows.
    """

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        return texts.map(redact, na_action="ignore")

    out = docs.withColumn("text", clean(F.col("text")))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
