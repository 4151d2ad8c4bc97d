"""Each operator against a brute-force version, and on nulls, empty and long texts, repeated rows, empty tables, extra columns."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from knotgauge.llm import chat, knn_quality, line_crf, media, mixing, packing, pii, repeats, sharding, simhash
from knotgauge.llm.queries import CAPACITY, vocabulary

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp long, key string, _kept string, size long, `a.b` string, _rate int, _copy string, row int, k int"
RNG = random.Random(11)
WORDS = ["the", "of", "Straße", "née", "ion", "#x", "a|b", "42", "+1 (555) 010-9999", "x.y@mail.example.com", "10.0.0.1", "END!"]


def text_of(n):
    return " ".join(RNG.choice(WORDS) for _ in range(n)) + RNG.choice(["", ".\n", "\n\n"])


ROWS = [(i, text_of(RNG.choice([1, 5, 40, 200])), "en", RNG.choice(["a", "b", None]), 0, 1, "k", "z", 3, "ab", 4, "c", 5, 6) for i in range(60)]
ROWS += [(60, *[None] * 13), (61, "", "en", "a", 0, 1, "k", "z", 3, "ab", 4, "c", 5, 6), (None, "loose words here", "en", "b", 0, 1, "k", "z", 3, "ab", 4, "c", 5, 6), (62, "w " * 60000, "en", "b", 0, 1, "k", "z", 3, "ab", 4, "c", 5, 6)]
ROWS += [ROWS[3], ROWS[3], (63, ROWS[3][1], "en", "a", 0, 1, "k", "z", 3, "ab", 4, "c", 5, 6), (64, " \t\r\x0b\x0c", "en", "a", 0, 1, "k", "z", 3, "ab", 4, "c", 5, 6), (65, "\x85 nul\0  x", "en", "c", 0, 1, "k", "z", 3, "ab", 4, "c", 5, 6)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS).repartition(5)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 3 % 2, 0) for i in range(60)] + [(None, 1, 0), (1, None, 0)], "doc_id long, quality int, toxic int")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# -- 1: quality by neighbours


def test_scores(spark, docs, none, labels):
    voters = knn_quality.fit_voters(docs, labels)
    got = knn_quality.quality_scores(docs, voters).collect()
    assert len(got) == len(ROWS) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert knn_quality.quality_scores(none, voters).count() == 0
    blank = knn_quality.fit_voters(docs, labels.limit(0))
    assert {r.score for r in knn_quality.quality_scores(docs, blank).collect()} == {0.5}
    again = knn_quality.quality_scores(docs.repartition(2), voters).collect()
    order = lambda rows: [x for _, x in sorted((str(r.doc_id), r.score) for r in rows)]
    assert np.allclose(order(again), order(got), atol=1e-7)


def test_blocked_votes_are_exact():
    rng = np.random.default_rng(0)
    x = np.abs(rng.normal(size=(90, 200))).astype(np.float32)
    v = knn_quality.LatentVoters.fit(x, (rng.random(90) < 0.5).astype(int), 20)
    q = np.abs(rng.normal(size=(50, 200))).astype(np.float32)
    plain = []
    for row in q:
        p = (row * v.idf) @ v.basis
        cos = v.vectors @ (p / np.linalg.norm(p))
        top = np.argsort(-cos)[: knn_quality.NEIGHBOURS]
        w = np.maximum(cos[top].astype(float), 0) ** 8 + 1e-9
        plain.append((w * v.labels[top]).sum() / w.sum())
    assert np.allclose(v.score(q, block=7), plain, atol=1e-5)


def test_equal_neighbours_count_by_their_order():
    vectors, labels = np.tile([1.0, 0.0], (400, 1)), (np.arange(400) < 15).astype(np.float32)
    v = knn_quality.LatentVoters(np.ones(2, np.float32), np.eye(2), vectors, labels, 0.5)
    assert v.score(np.array([[1.0, 0.0]], np.float32)).tolist() == [1.0]
    v.vectors[200] = [0.6, 0.8]
    assert v.score(np.array([[0.6, 0.8]], np.float32))[0] > 0


def test_held_out_rows_are_not_learned(spark, docs):
    held = {i for i in range(60) if zlib.crc32(str(i).encode()) % 5 == 0}
    a = spark.createDataFrame([(i, i % 2, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    b = spark.createDataFrame([(i, 1 - i % 2 if i in held else i % 2, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    x, y = knn_quality.fit_voters(docs, a), knn_quality.fit_voters(docs, b)
    assert np.array_equal(x.vectors, y.vectors) and np.array_equal(x.labels, y.labels) and len(x.labels) == len({r[0] for r in ROWS if r[0] is not None and r[0] < 60 and r[0] not in held})


# -- 2: line labelling


def brute_counts(text):
    text, w = text or "", words(text)
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    many = {x for x in windows if windows.count(x) > 1} if len(windows) < 3000 else set(windows)
    hit = {i + k for i, x in enumerate(windows) if x in many for k in range(5)}
    lines = [x for x in text.split("\n")]
    dup = sum(bool(words(x)) and x in lines[:i] for i, x in enumerate(lines))
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit)


def test_line_rules(docs, none):
    got = line_crf.quality_rules(docs, line_crf.LineCrf()).collect()
    assert len(got) == len(ROWS)
    want = sorted((str(r[0]), *brute_counts(r[1])) for r in ROWS)
    assert sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
    assert all(r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) and not (r.kept and r.base_failed) for r in got)
    assert line_crf.quality_rules(none, line_crf.LineCrf()).count() == 0
    kept = line_crf.keep_good(docs, line_crf.LineCrf())
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in got)


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(1)
    crf = line_crf.LineCrf(rng.normal(size=(2, len(line_crf.FEATURES))), rng.normal(size=(2, 2)))
    for n in range(1, 8):
        x = rng.normal(size=(n, len(line_crf.FEATURES)))
        s = x @ crf.weights.T
        total = lambda y: sum(s[i, y[i]] for i in range(n)) + sum(crf.moves[a, b] for a, b in zip(y, y[1:]))  # noqa: B023, E731
        assert np.isclose(total(crf.viterbi(x).tolist()), max(map(total, itertools.product((0, 1), repeat=n))))


def test_fit_separates(spark, docs, labels):
    x = np.zeros((4, len(line_crf.FEATURES)))
    x[:, 0] = 1
    junk = x.copy()
    junk[:, 3] = 1
    crf = line_crf.LineCrf(np.zeros((2, len(line_crf.FEATURES))), np.zeros((2, 2))).fit([(x, np.zeros(4, int))] * 5 + [(junk, np.ones(4, int))] * 5)
    assert crf.viterbi(x).sum() == 0 and crf.viterbi(junk).sum() == 4
    assert isinstance(line_crf.fit_line_crf(docs, labels), line_crf.LineCrf) and isinstance(line_crf.fit_line_crf(docs, labels.limit(0)), line_crf.LineCrf)


def test_likelihood_and_gradient_by_all_paths():
    rng = np.random.default_rng(3)
    n, longest, size = 4, 5, 2 * len(line_crf.FEATURES) + 4
    x, y, there, each = rng.normal(size=(n, longest, len(line_crf.FEATURES))), rng.integers(0, 2, (n, longest)), np.arange(longest) < np.array([[5], [1], [3], [4]]), rng.random(n)
    theta = rng.normal(size=size)

    def plain(theta):
        w, moves, total = theta[:-4].reshape(2, -1), theta[-4:].reshape(2, 2), 0.0
        for i in range(n):
            k = int(there[i].sum())
            score = lambda p: sum(w[p[t]] @ x[i, t] for t in range(k)) + sum(moves[a, b] for a, b in zip(p, p[1:]))  # noqa: B023, E731
            total += each[i] * (score(y[i, :k].tolist()) - np.logaddexp.reduce([score(p) for p in itertools.product((0, 1), repeat=k)]))
        return total

    value, slope = line_crf.LineCrf.gradient(theta, x, y, there, each)
    steps = np.eye(size) * 1e-5
    assert np.isclose(value, plain(theta)) and np.allclose(slope, [(plain(theta + h) - plain(theta - h)) / 2e-5 for h in steps], atol=1e-6)


@pytest.fixture(scope="module")
def fitted(spark):
    sf = "/root/testdata/sf0.01"
    return line_crf.fit_line_crf(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))


@pytest.mark.parametrize("block", [["Home | About | Shop | Cart | Login |", "Terms | Privacy | Help | Jobs | Press |"], ["BUY NOW!! CHEAP!! CLICK!! HERE!! TODAY!!"] * 3, ["win$$$ this*** now### click&&& here%%%"]])
def test_a_planted_block_is_marked_and_nothing_else(fitted, block):
    clean = [f"The {a} of the house was old and {b}, and nobody came." for a in ("roof", "door", "wall") for b in ("grey", "cold", "dark")]
    for at in (0, 4, len(clean)):
        text = "\n".join([*clean[:at], *block, *clean[at:]])
        lines, words = line_crf.split_lines(text)
        assert fitted.viterbi(line_crf.line_features(lines, words)).tolist() == [0] * at + [1] * len(block) + [0] * (len(clean) - at)
        assert line_crf.judge(text, fitted)[7] == sum(len(x.split()) for x in clean)


def test_kept_is_the_share_of_content(spark, fitted):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    mixed = judged = 0
    for r in line_crf.quality_rules(docs, fitted).join(docs.select("doc_id", "text"), "doc_id").collect():
        lines, words = line_crf.split_lines(r.text or "")
        x = line_crf.line_features(lines, words)
        y = fitted.viterbi(x)
        assert r.content_words == sum(len(w) for w, label in zip(filter(None, words), y) if label == 0)
        assert r.kept == (not r.base_failed and r.content_words >= fitted.least_share * r.n_words)
        if len(x) > 1:
            judged, mixed = judged + 1, mixed + (0 < y.sum() < len(y))
    assert mixed > 0.03 * judged


def test_long_documents_enter_the_fit():
    x, words = np.ones((10_000, 3)), np.arange(10_000)
    some = line_crf.stretches(x, words)
    assert len(some) == line_crf.STRETCHES and some[0][1][0] == 0 and some[-1][1][-1] == 9_999 and all(len(n) == line_crf.STRETCH for _, n in some)
    assert [len(n) for _, n in line_crf.stretches(x[:130], words[:130])] == [60, 60, 10] and line_crf.stretches(x[:0], words[:0]) == []


def test_repeated_rows_weigh_once_in_the_fits(spark, docs, labels):
    twice = docs.unionByName(docs.where("doc_id < 9")).unionByName(docs.where("doc_id < 9"))
    assert np.array_equal(line_crf.fit_line_crf(docs, labels).weights, line_crf.fit_line_crf(twice, labels).weights)
    one, two = knn_quality.fit_voters(docs, labels), knn_quality.fit_voters(twice, labels)
    assert np.array_equal(one.vectors, two.vectors) and np.array_equal(one.labels, two.labels)


# -- 3: packing


def test_pack(docs, none):
    from tokenizers import Tokenizer

    path = vocabulary("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    got = packing.best_fit_pack(docs, path, CAPACITY, vocabulary("byte_bpe_50k.tiktoken")).collect()
    want = []
    for row in ROWS:
        ids = tokenizer.encode(row[1] or "", add_special_tokens=False).ids + [0]
        cuts = [0, *range(len(ids) % CAPACITY or CAPACITY, len(ids), CAPACITY), len(ids)]
        want += [(str(row[0]), k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        parts.sort()
        assert [a for a, _ in parts] == [0, *np.cumsum([n for _, n in parts])[:-1]] and sum(n for _, n in parts) <= CAPACITY
    assert packing.best_fit_pack(none, path, CAPACITY).count() == 0
    special = ["x <|endoftext|>y", "²½ ªª ŉ é 中文 \x1c\x85", "I'd  \n\n 12ab3"]
    fast, slow = packing.id_encoder(path, vocabulary("byte_bpe_50k.tiktoken")), packing.id_encoder(path)
    assert all(fast(x) == slow(x) for x in special)


def best_fit_count(counts, capacity):
    gaps = []
    for x in sorted((x for x, k in counts.items() for _ in range(k)), reverse=True):
        fits = [i for i, g in enumerate(gaps) if g >= x]
        if fits:
            gaps[min(fits, key=gaps.__getitem__)] -= x
        else:
            gaps.append(capacity - x)
    return len(gaps)


def test_plans_use_up_every_length():
    rng = random.Random(2)
    for capacity in (8, 16, 64):
        for _ in range(60):
            counts = {rng.randrange(1, capacity + 1): rng.randrange(1, 30) for _ in range(rng.randrange(1, 12))}
            plan, used = packing.plan_patterns(counts, capacity), {}
            for pattern, k in plan:
                assert k > 0 and sum(pattern) <= capacity
                for x in pattern:
                    used[x] = used.get(x, 0) + k
            assert used == counts
            assert sum(k for _, k in plan) <= best_fit_count(counts, capacity)


def test_exact_phase_fills_by_every_kind_of_sum():
    for counts, pattern in (({9: 2, 1: 2}, (9, 1)), ({6: 1, 3: 1, 1: 1}, (6, 3, 1)), ({4: 1, 3: 1, 2: 1, 1: 1}, (4, 3, 2, 1)), ({5: 4}, (5, 5))):
        exact, residual, _ = packing.plan_with_reserve(counts, 10, 0)
        assert exact[0][0] == pattern and all(sum(p) == 10 for p, _ in exact)
    exact, residual, _ = packing.plan_with_reserve({9: 2, 1: 2}, 10, 2)
    assert exact == [] and sum(k for _, k in residual) == 2


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_plans_come_through_the_exact_phase(spark, sf):
    """No more sequences than best fit alone needs, most of them filled by exact combinations."""
    pieces = packing.cut_pieces(spark.read.parquet(f"/root/testdata/{sf}/documents.parquet"), vocabulary("byte_bpe_50k.json"), CAPACITY, vocabulary("byte_bpe_50k.tiktoken"))
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    chosen = min((packing.plan_with_reserve(counts, CAPACITY, CAPACITY * r // 64) for r in packing.RESERVES), key=lambda x: sum(k for _, k in x[2]))
    assert chosen[2] == packing.plan_patterns(counts, CAPACITY)
    total = sum(k for _, k in chosen[2])
    assert total <= best_fit_count(counts, CAPACITY) and sum(k for _, k in chosen[0]) > 0.6 * total


def test_hot_lengths_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANK_ROWS", 7)
    monkeypatch.setattr(packing, "RANK_LEAST", 2)
    rows = [(i % 3, "same words") for i in range(100)] + [(None, None)] * 50 + [(i, "w " * 3000) for i in range(9)]
    got = packing.best_fit_pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), vocabulary("byte_bpe_50k.json"), CAPACITY, vocabulary("byte_bpe_50k.tiktoken")).collect()
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in map(sorted, by.values()):
        assert [a for a, _ in parts] == [0, *np.cumsum([n for _, n in parts])[:-1]] and sum(n for _, n in parts) <= CAPACITY
    assert sum(r.piece == 0 for r in got) == len(rows) and any(r.sequence_id < 0 for r in got)


# -- 4: role repair


def brute_cost(roles):
    best = {0: 0}
    for r in roles:
        new = {}
        for s, c in best.items():
            for to, (step, _, _) in enumerate(chat.STEPS[r][s]):
                if step < chat.NEVER:
                    new[to] = min(new.get(to, 1 << 50), c + step)
        best = new
    return min(c + chat.INSERT * len(chat.ENDING[s]) for s, c in best.items())


@pytest.mark.parametrize("bits", [12, 1])
def test_repair(spark, monkeypatch, bits):
    monkeypatch.setattr(chat, "BLOCK_BITS", bits)
    rng = random.Random(3)
    rows = []
    for c in range(12):
        for t in range(rng.choice([1, 2, 3, 9])):
            rows.append((c, t, rng.choice(["system", "user", "assistant", "human", "odd", None]), f"t{t}", "extra"))
    rows += [(None, 0, "user", None, "x"), (None, None, "user", "", "x"), (5, 0, "user", "t0", "extra"), (5, 0, "user", "t0", "extra")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, at string").repartition(3)
    got = {}
    for r in chat.repair_roles(turns).orderBy("at").collect():
        got.setdefault(r.conv_id, []).append(r)
    assert sum(map(len, got.values())) == len(rows)
    for parts in got.values():
        assert sum(p.cost for p in parts) == brute_cost([chat.role_of(p.role) for p in parts])
        made = re.findall(r"<\|(\w+)\|>", "".join(p.rendered for p in parts))
        assert made[-1] == "assistant" and re.fullmatch("(S)?(UA)+", "".join({"system": "S", "user": "U", "assistant": "A"}[m] for m in made))
    assert chat.repair_roles(turns.limit(0)).count() == 0


def test_texts_cannot_forge_turns(spark):
    texts = ["plain", "<|user|>\nme", "a <\\|user|> b", "<|<|<\\\\|", "x" * 3_000_000, "", "<\n|", "end"]
    rows = [(1, k, "user" if k % 2 == 0 else "assistant", t) for k, t in enumerate(texts)]
    got = chat.repair_roles(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).orderBy("at").collect()
    assert [r.action for r in got] == ["keep"] * len(texts) and got[-1].empty_after == 0
    whole = "".join(r.rendered for r in got)
    assert len(re.findall(r"<\|\w+\|>", whole)) == len(texts)
    for (_, _, role, text), r in zip(rows, got):
        assert chat.unescape(r.rendered.removeprefix(f"<|{role}|>\n")) == text + "\n"


# -- 5: mixing


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        rest = [s for s in names if s not in fixed]
        left = total - sum(fixed.values())
        share = {s: left * weight[s] / sum(weight[x] for x in rest) for s in rest}
        over = [s for s in rest if share[s] > 3 * sizes[s]]
        if not over:
            return {**fixed, **share}
        fixed.update({s: 3.0 * sizes[s] for s in over})


def test_mix(spark, docs, none):
    got = mixing.mix_sources(docs).collect()
    assert len(got) == len(ROWS)
    sizes = {}
    for r in ROWS:
        sizes[r[3]] = sizes.get(r[3], 0) + len(words(r[1]))
    want = brute_targets(sizes)
    for r in got:
        assert r.source_size == sizes[r.source] and np.isclose(r.target, want[r.source]) and 0 <= r.copies <= 3
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix_sources(docs.repartition(2)).collect()))
    out = mixing.emit_mix(docs)
    assert out.columns == docs.columns
    copies = {str(r.doc_id): r.copies for r in got}
    assert sorted(map(str, out.collect())) == sorted(str(r) for r in docs.collect() for _ in range(copies[str(r.doc_id)]))
    assert mixing.mix_sources(none).count() == 0 and mixing.emit_mix(none).count() == 0
    rng = random.Random(4)
    for _ in range(5):
        some = {s: rng.randrange(0, 1000) for s in ["a", "b", "ü", "z", None][: rng.randrange(1, 6)]}
        rows = spark.createDataFrame(list(some.items()), "source string, source_size long")
        found = {r.source: r.target for r in mixing.source_targets(rows).collect()}
        assert all(np.isclose(found[s], t) for s, t in brute_targets(some).items())


def test_mix_nears_its_targets(spark):
    many = spark.range(20000).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 7)).alias("source"), F.lit("w w w").alias("text"))
    for r in mixing.mix_sources(many).groupBy("source", "target").agg(F.sum(F.col("size") * F.col("copies")).alias("taken")).collect():
        assert abs(r.taken - r.target) < 0.01 * r.target


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_no_source_misses_its_target(spark, sf):
    mixed = mixing.mix_sources(spark.read.parquet(f"/root/testdata/{sf}/documents.parquet"))
    for r in mixed.groupBy("source", "target").agg(F.sum(F.col("size") * F.col("copies")).alias("taken"), F.max(F.col("copies")).alias("most")).collect():
        assert abs(r.taken - r.target) < 0.05 * r.target and r.most <= 3


# -- 6: media


def test_media(docs, none):
    got = {}
    for r in media.media_columns(docs).collect():
        got.setdefault(str(r.doc_id), []).append(r)
    for row in ROWS:
        raw = (row[1] or "").encode()
        pay = media.padded(raw)
        r = got[str(row[0])][0]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(pay), hashlib.sha256(pay).hexdigest(), zlib.crc32(pay[-16:]))
        assert len(pay) % 192 == 0 and pay and r.media_bytes == len(r.media) and r.media_sha256 == hashlib.sha256(r.media).hexdigest() and len(r.feature) == 16 and bytes(r.hash).hex() == r.feature
    assert media.media_columns(none).count() == 0
    assert len({tuple(r)[1:] for r in got["3"] + got["63"]}) == 1


def brute_hash(image, size=32):
    """Plain sums: mean grey of the cells of a size x size grid (or the nearest sample where the image is smaller), its 64 lowest cosine sums, their signs about the median."""
    grey = image.astype(float).sum(2)
    h, w = grey.shape
    cell = lambda n, i: range(i * n // size, (i + 1) * n // size) if n >= size else [i * n // size]
    small = [[np.mean([grey[y, x] for y in cell(h, i) for x in cell(w, j)]) for j in range(size)] for i in range(size)]
    wave = [[np.cos(np.pi * k * (2 * x + 1) / (2 * size)) for x in range(size)] for k in range(8)]
    low = np.array([round(sum(small[y][x] * wave[a][y] * wave[b][x] for y in range(size) for x in range(size)), 6) for a in range(8) for b in range(8)])
    return np.packbits(low > np.median(low[1:])).tobytes()


def test_cosine_hashes_by_plain_sums():
    rng = np.random.default_rng(2)
    for rows in (1, 5, 32, 70):
        image = rng.integers(0, 256, (rows, 64, 3), np.uint8)
        assert media.cosine_hash(image) == brute_hash(image)


def test_png_checks_and_filters():
    rng = np.random.default_rng(0)
    png = media.encode_png(rng.integers(0, 256, 192 * 9, np.uint8).tobytes())
    for at in (3, 20, 60, len(png) - 3):
        broken = bytearray(png)
        broken[at] ^= 1
        with pytest.raises(media.BrokenPng):
            media.decode_png(bytes(broken))
    with pytest.raises(media.BrokenPng):
        media.decode_png(png[:-6])
    samples = rng.integers(0, 256, (12, 15), np.uint8)
    lines, before = [], np.zeros(15, int)
    for r, row in enumerate(samples.astype(int)):
        kind, out = [0, 1, 1, 2, 2, 3, 3, 4, 4, 1, 2, 0][r], []
        for i, x in enumerate(row):
            a, b, c = (row[i - 3] if i > 2 else 0), before[i], (before[i - 3] if i > 2 else 0)
            p = a + b - c
            guess = [0, a, b, (a + b) // 2, a if abs(p - a) <= abs(p - b) and abs(p - a) <= abs(p - c) else b if abs(p - b) <= abs(p - c) else c][kind]
            out.append((x - guess) & 255)
        lines.append([kind, *out])
        before = row
    assert np.array_equal(media.unfilter(np.array(lines, np.uint8), 3), samples)


# -- 7: repeats


def brute_repeats(rows):
    first = {}
    texts = [(i, (t or "").encode()) for i, t in rows]
    for i, b in texts:
        for j in range(len(b) - 49) if i is not None else ():
            first[b[j : j + 50]] = min(i, first.get(b[j : j + 50], i))
    out = []
    for i, b in texts:
        gone = np.zeros(len(b), bool)
        for j in range(len(b) - 49) if i is not None else ():
            if first[b[j : j + 50]] < i:
                gone[j : j + 50] = True
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out.append((str(i), len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("group", [5000, 3])
def test_repeats(spark, monkeypatch, none, group):
    monkeypatch.setattr(repeats, "GROUP", group)
    rng = random.Random(5)
    pieces = ["".join(rng.choice("abcé ") for _ in range(rng.randrange(10, 140))) for _ in range(20)] + ["ab" * 60, "x" * 120]
    rows = [(rng.randrange(90), "".join(rng.choice(pieces)[rng.randrange(20) :] for _ in range(rng.randrange(8)))) for _ in range(160)]
    rows += [(None, pieces[0] * 3), (None, None), (7, None), (200, "é" * 70), (201, "é" * 80), rows[5], rows[5], (202, rows[5][1])]
    table = spark.createDataFrame(rows, "doc_id long, text string").withColumn("owner", F.lit(1)).withColumn("sha", F.lit("x"))
    assert sorted((str(r.doc_id), *r[1:]) for r in repeats.remove_repeats(table.repartition(3)).collect()) == brute_repeats(rows)
    if group == 3:
        assert repeats.remove_repeats(none).count() == 0
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("knotgauge_texts")]


def test_repeats_of_an_anchor_with_very_many_contexts(spark):
    """6,000 texts share a passage between other words: anchors at its edges have as many contexts. And a text longer than a block."""
    rng = random.Random(12)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(90))
    odd = lambda n: "".join(rng.choice("ijklmnop ") for _ in range(n))
    rows = [(i, odd(27) + passage[rng.choice([0, 0, 0, 5]) :] + odd(27)) for i in range(6000)]
    long = odd(repeats.BLOCK // 2)
    rows += [(7000, long + passage + long[:100]), (7001, odd(30) + long[-4000:] + odd(9))]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted((str(r.doc_id), *r[1:]) for r in repeats.remove_repeats(table).collect()) == brute_repeats(rows)


def test_runs_of_removed_bytes():
    rng = np.random.default_rng(4)
    for _ in range(200):
        n = int(rng.integers(0, 9))
        first, mask = rng.integers(0, 400, n), rng.integers(0, 1 << 27, n) & rng.integers(0, 1 << 27, n)
        plain = np.zeros(600, int)
        for f, m in zip(first, mask):
            for s in range(27):
                if m >> s & 1:
                    plain[f + s : f + s + 50] = 1
        edges = np.flatnonzero(np.diff(np.concatenate(([0], plain, [0]))))
        b, e = repeats.removed_runs(first, mask)
        assert b.tolist() == edges[::2].tolist() and e.tolist() == edges[1::2].tolist()


def test_anchors_depend_on_the_string_alone(monkeypatch):
    rng = random.Random(6)
    text = bytes(rng.choice(b"ab") for _ in range(900))
    keys, at = repeats.anchors(text)
    for j in range(0, 850, 7):
        own = repeats.anchors(text[j : j + 50])
        assert len(own[1]) == 1 and (j + own[1][0]) in set(at.tolist())
    monkeypatch.setattr(repeats, "BLOCK", 100)
    cut = repeats.anchors(text)
    assert set(zip(*map(list, cut))) == set(zip(keys.tolist(), at.tolist()))


# -- 8: shards


def rows_of(df, columns):
    return sorted(str(tuple(r)) for r in df.select(*(f"`{c}`" for c in columns)).collect())


def test_shards(spark, docs, none, tmp_path):
    store = sharding.ShardStore(spark, str(tmp_path / "s"), target_bytes=20_000, fan_in=2, least_bytes=500)
    for k in range(3):
        assert store.append(docs.repartition(4), rows_per_shard=5) == k + 1
    before = store.manifest().count()
    last = store.compact()
    assert store.versions()[-1] == last > 3 and store.manifest().count() < before and store.compact() == last
    key = lambda df: rows_of(df, docs.columns)
    assert key(store.read()) == sorted(key(docs) * 3) and key(store.read(1)) == key(docs)
    with pytest.raises(sharding.VersionConflict):
        store.commit(store.manifest(), last)
    assert store.vacuum() > 0 and store.versions() == [last] and key(store.read()) == sorted(key(docs) * 3)
    files = [p for p in (tmp_path / "s" / "data").rglob("*.parquet")]
    assert len(files) == store.manifest().count()
    assert sharding.compact_documents(none, str(tmp_path / "e")).count() == 0


def test_of_two_writers_one_starts_again(spark, docs, tmp_path):
    """Both have seen version 1. The one that is later by whatever little gets the conflict, and the other's version stays whole."""
    one, two = (sharding.ShardStore(spark, str(tmp_path / "s")) for _ in range(2))
    one.append(docs)
    a, b = one.manifest(), two.manifest().limit(0)
    assert one.commit(a, 2) == 2
    before = sorted(p.name for p in (tmp_path / "s" / "manifest").iterdir())
    with pytest.raises(sharding.VersionConflict):
        two.commit(b, 2)
    assert sorted(p.name for p in (tmp_path / "s" / "manifest").iterdir()) == before and one.manifest(2).count() == a.count() > 0
    from concurrent.futures import ThreadPoolExecutor

    def race(k):
        try:
            return sharding.ShardStore(spark, str(tmp_path / "s")).commit(a, 3)
        except sharding.VersionConflict:
            return None

    with ThreadPoolExecutor(4) as pool:
        assert sorted(filter(None, pool.map(race, range(4)))) == [3]
    assert two.versions() == [1, 2, 3]


def test_large_shards_are_cut_and_rounds_that_run_out_are_told(spark, tmp_path):
    rng = random.Random(14)
    rows = [(i, "".join(chr(rng.randrange(33, 500)) for _ in range(4000))) for i in range(40)]
    long = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    store = sharding.ShardStore(spark, str(tmp_path / "s"), target_bytes=60_000)
    store.append(long)
    assert store.manifest().count() == 1
    with pytest.raises(RuntimeError):
        store.compact(most_rounds=1)
    store.compact()
    assert store.manifest().where("n_bytes > 60000 and n_rows > 1").count() == 0 and rows_of(store.read(), long.columns) == rows_of(long, long.columns)


def test_shards_keep_columns_of_any_name(spark, tmp_path):
    odd = spark.createDataFrame([(i, f"t{i}", i, "p", 1, "s", 2, 3, "dot") for i in range(50)], "doc_id long, text string, _run int, _path string, _n int, _shard string, _shard_bytes int, path int, `a.b` string").repartition(9)
    root = str(tmp_path / "o")
    store = sharding.ShardStore(spark, root, target_bytes=1 << 20, fan_in=2)
    store.append(odd, rows_per_shard=2)
    store.compact()
    assert store.manifest().count() == 1
    assert rows_of(store.read(), odd.columns) == rows_of(odd, odd.columns) and store.read().columns[-2:] == ["_shard_", "_shard_bytes_"]
    stored = sharding.compact_documents(odd, str(tmp_path / "q"))
    assert rows_of(stored, odd.columns) == rows_of(odd, odd.columns)


# -- 9: near duplicates


def test_large_roots_and_empty_texts(spark):
    """A hot fingerprint: very many texts without words are one node, and one component."""
    rows = [(i, None if i % 2 else " ") for i in range(400)] + [(500, "lone words are here today")]
    got = {r.doc_id: r.component_id for r in simhash.group_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(got.values()) == {0, 500} and got[500] == 500


def brute_print(text):
    import xxhash

    w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    h = [xxhash.xxh64(" ".join(w[i : i + 4]).encode(), seed=42).intdigest() for i in range(max(1, len(w) - 3))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints, bits=4):
    """doc_id by doc_id, the smallest reachable over fingerprints at most `bits` apart."""
    distinct = sorted({p for _, p in prints})
    root = {p: p for p in distinct}

    def top(p):
        while root[p] != p:
            p = root[p]
        return p

    for a, b in itertools.combinations(distinct, 2):
        if (a ^ b).bit_count() <= bits:
            root[top(a)] = top(b)
    least = {}
    for i, p in prints:
        if i is not None:
            least[top(p)] = min(i, least.get(top(p), i))
    return sorted((str(i), str(least.get(top(p)))) for i, p in prints)


def test_components_of_documents(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    got = simhash.group_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = brute_components([(i, simhash.fingerprint(t or "")) for i, t in rows])
    assert sorted((str(r.doc_id), str(r.component_id)) for r in got) == want


def test_components(spark, docs, none):
    got = simhash.group_near_duplicates(docs).collect()
    assert sorted((str(r.doc_id), str(r.component_id)) for r in got) == brute_components([(r[0], brute_print(r[1])) for r in ROWS])
    prints = [(r[0], brute_print(r[1])) for r in ROWS]
    assert sorted((str(r.doc_id), r.fp % 2**64) for r in got) == sorted((str(i), p) for i, p in prints)
    assert simhash.group_near_duplicates(none).count() == 0
    near = simhash.drop_near_duplicates(docs)
    assert near.columns == docs.columns and near.count() == len({r.root for r in got})


def test_all_links_are_found(spark):
    rng = random.Random(7)
    values = [rng.getrandbits(64) for _ in range(25)]
    for v in values[:20]:
        for _ in range(3):
            w = v
            for _ in range(rng.randrange(6)):
                w ^= 1 << rng.randrange(64)
            values.append(w)
    values = sorted(set(values))
    signed = {v: v - (1 << 64) if v >> 63 else v for v in values}
    frame = spark.createDataFrame([(s,) for s in signed.values()], "fp long")
    links = simhash.ball_links(simhash.candidates(frame))
    root = {v: v for v in values}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(values, 2):
        if (a ^ b).bit_count() <= 4:
            root[max(find(a), find(b))] = min(find(a), find(b))
    want = {frozenset(signed[v] for v in values if find(v) == r) for r in set(map(find, values))}
    from knotgauge.llm.common import Scratch

    groups = {}
    for r in simhash.components(links, Scratch(spark, "t")).collect():
        groups.setdefault(r.root, {r.root}).add(r.node)
    assert {frozenset(g) for g in groups.values()} == {g for g in want if len(g) > 1}


# -- 10: personal data


def brute_spans(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m.group())
        if 14 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0:
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return sorted(out, key=lambda x: (x[1], pii.BASE.index(x[0])))


def test_patterns():
    rng = random.Random(8)
    for _ in range(8000):
        t = "".join(rng.choice("a1@.+ -()9.0%@é2") for _ in range(rng.randrange(40)))
        assert pii.base_spans(t) == brute_spans(t), t


def test_personal_data(docs, none):
    got = {str(r.doc_id): r for r in pii.find_personal_data(docs).collect()}
    for row in ROWS:
        want = brute_spans(row[1] or "")
        r = got[str(row[0])]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for k, *_ in want) for x in pii.BASE]
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest()
        assert {f"{k}:{a}:{b}" for k, a, b in want} <= set(filter(None, r.spans.split(",")))
    assert pii.find_personal_data(none).count() == 0
    clean = pii.redact_personal_data(docs)
    assert clean.columns == docs.columns and all(not brute_spans(r.text or "") and (r.n_chars is None) == (r.text is None) for r in clean.collect())


def test_all_spans_over_a_word_count(monkeypatch):
    """More than eight spans in one word, and a long span before short ones."""
    text = ",".join(f"a{i}@b.example" for i in range(12)) + "; 1.2.3.4"
    base, every = pii.all_spans(text)
    assert len(base) == 13 and every == base
    seen = []
    monkeypatch.setattr(pii, "settle", lambda u, edges, chains: seen.append(u) or u)
    pii.skip_chain_spans("x1 y2 z3", [("email", 0, 8), ("ip", 0, 2), ("card", 1, 2), ("phone", 6, 8)])
    assert (seen[0][:, 1:5] == [[6, 6, 6, 0], [6, 0, 0, 0], [6, 0, 0, 6]]).all()


def test_messages_on_a_tree_are_exact():
    """On a chain and on a star, settled scores are the logarithms of the marginals, up to a constant for each node."""
    rng = np.random.default_rng(9)
    for edges in ([(0, 1, 0.6), (1, 2, 0.6), (2, 3, 0.6)], [(0, 3, 2.0), (1, 3, 2.0), (2, 3, 2.0)]):
        for chains in (0, 3):
            u = rng.normal(size=(4, 6))
            p = np.zeros((4, 6))
            for y in itertools.product(range(6), repeat=4):
                bonus = sum(w for k, (a, b, w) in enumerate(edges) if y[a] == y[b] and not (k < chains and y[a] == 0))
                p[np.arange(4), y] += np.exp(sum(u[i, y[i]] for i in range(4)) + bonus)
            got = np.exp(pii.settle(u, edges, chains))
            assert np.allclose(got / got.sum(1, keepdims=True), p / p.sum(1, keepdims=True), atol=1e-3)


def test_skip_links_carry_labels():
    secret = "Zk81mQ7xP2vT94LbR6aa"
    alone, linked = f"see {secret} now", f'token = "{secret}" and later, far away, {secret} again'
    assert [k for k, *_ in pii.all_spans(linked)[1]] == ["secret", "secret"]
    assert len(pii.all_spans(alone)[1]) <= 1
    assert pii.all_spans("plain words, no numbers")[1] == [] and pii.all_spans("chapter 12, page 340 of 2019")[1] == []
    assert pii.redact(None) is None and pii.redact("") == "" and pii.redact("a@b.c") == "[EMAIL]"


@pytest.mark.parametrize("repeats", [1, 3, 20, 1000])
def test_all_repeats_of_a_found_token_are_found(repeats):
    """However many there are, and wherever the found one is among them; a number that no pattern finds stays."""
    far = " and some plain words until "
    bare = far.join(["5551234567"] * repeats)
    for text in (f"call +5551234567{far}{bare}", f"{bare}{far}call +5551234567"):
        base, every = pii.all_spans(text)
        assert len(base) == 1 and [k for k, *_ in every] == ["phone"] * (repeats + 1)
    assert pii.all_spans(bare)[1] == []
    secret = "Zk81mQ7xP2vT94LbR6aa"
    assert [k for k, *_ in pii.all_spans(far.join([f"token = {secret}", *[secret] * repeats]))[1]] == ["secret"] * (repeats + 1)
