"""The corpus operators on small tables with every awkward row, against brute force."""

import hashlib
import math
import os
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from voxelith.llm import (
    chat_format, embedding_dedup, hidden_markov, line_dedup, links, mixing, ngram_join, packing, quality_classifier,
    quality_rules, shingles, warc,
)
from voxelith.llm.tokenizing import BYTE_BPE, encoder

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, __row string, words string, size string, score string"
PROSE = "the quick brown fox jumps over the lazy dog and then it runs to the river with a friend of the fox"


def prose(seed, n=80):
    rng = np.random.default_rng(seed)
    base = PROSE.split() + [f"w{i}" for i in range(40)]
    return " ".join(base[i] for i in rng.integers(0, len(base), n))


def rows():
    long = "\n".join(prose(100 + i, 60) for i in range(60))
    near = prose(1, 120).split()
    texts = [
        prose(1, 120), prose(1, 120), " ".join(near[:60] + ["changed"] + near[61:]), "", None, "   \t\n ", "one", "two words",
        long, long + "\nan extra line of words at the end", prose(2), prose(3), "a b c d e f g", "A  B\tc d e f g", "é ü ñ\n\n\né ü ñ",
        "<|endoftext|> \U0001f600 中文 text", prose(2) + "\n" + prose(3), "x" * 5000,
    ]
    out = []
    for i, text in enumerate(texts):
        source = [None, "b", "a", "ä", "B"][i % 5]
        out.append((i, text, "en", source, len(text or ""), "clash", "clash", "clash", "clash"))
    out.append((None, prose(9), None, None, None, None, None, None, None))
    out.append(out[0])  # a repeated row
    out.append(out[10])
    return out


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('docs')}/docs.parquet"
    spark.createDataFrame(rows(), SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('none')}/docs.parquet"
    spark.createDataFrame([], SCHEMA).write.parquet(path)
    return spark.read.parquet(path)


def words(text):
    return (text or "").encode().split()


# Packing -------------------------------------------------------------------------------


def test_packing(docs, empty):
    placed = packing.pack_documents(docs, packing.Capacity(tokens=256)).collect()
    exact = Tokenizer.from_file(BYTE_BPE)
    want = Counter()
    for row in rows():
        ids = np.array([*exact.encode(row[1] or "", add_special_tokens=False).ids, 0], dtype="<u4")
        first = len(ids) % 256 or 256
        starts = [0, *range(first, len(ids), 256)]
        for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)], strict=True)):
            want[(row[0], k, a, b - a, zlib.crc32(ids[a:b].tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in placed) == want
    bins = defaultdict(list)
    for r in placed:
        bins[r.sequence_id].append((r.offset, r.length))
    for spans in bins.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 256
    assert len(bins) <= math.ceil(sum(r.length for r in placed) / 256) + 1
    assert packing.pack_documents(empty).count() == 0


@pytest.mark.parametrize("score", ["norm", "dot"])
def test_every_capacity_holds(score):
    lengths = np.random.default_rng(3).integers(1, 300, 2000)
    cap = packing.Capacity(tokens=1000, documents=6, attention=200_000)
    bins, offset = packing.best_fit(lengths, cap, packing.Fit(score, (1.0, 0.2, 0.5)))
    for b in np.unique(bins):
        own = lengths[bins == b]
        assert own.sum() <= 1000 and len(own) <= 6 and (own**2).sum() <= 200_000
        assert sorted(offset[bins == b]) == [0, *np.cumsum(own[np.argsort(offset[bins == b])])[:-1]]
    with pytest.raises(ValueError):
        packing.best_fit(np.array([2000]), cap)


def test_sequences(spark, docs):
    some = docs.where("doc_id in (8, 10, 12)").dropDuplicates(["doc_id"])
    placed = packing.pack_documents(some)
    whole = packing.sequences(some, placed).collect()
    found = defaultdict(dict)
    for r in whole:
        for s in r.spans:
            found[s.doc_id][s.piece] = r.ids[s.offset : s.offset + s.length]
    for r in some.collect():
        ids = [i for k in sorted(found[r.doc_id]) for i in found[r.doc_id][k]]
        assert encoder().decode(ids[:-1]) == r.text and ids[-1] == 0


def test_encoder_agrees_with_tokenizers():
    exact = Tokenizer.from_file(BYTE_BPE)
    texts = ["it's  we'll\n\n  x", "tab\tand\r\nline", "naïve Straße — “quotes” …", "1234 5.6%", "nbsp here", "中文字 \U0001f600", "", "   ", "a\u0085b c", "don't 'S 'RE",
             "a <|endoftext|> b", "<|endoftext|><|endoftext|>", "<|endoftext", "x<|endoftext|>中"]
    for text in texts:
        assert encoder().encode(text) == exact.encode(text, add_special_tokens=False).ids
    assert encoder().encode("a <|endoftext|> b") == [64, 220, 50256, 275]
    assert encoder().decode([64, 220, 50256, 275]) == "a <|endoftext|> b"


# Language model ------------------------------------------------------------------------


def test_language_model(docs, empty):
    got = hidden_markov.language_model_scores(docs, states=3).collect()
    held = {r[0]: hidden_markov.held_out(r[0]) for r in rows()}
    count = Counter()
    for r in rows():
        if not held[r[0]]:
            count.update(words((r[1] or "").encode().lower().decode()))
            count["end"] += 1
    n, v = sum(count.values()), len(count)
    want = Counter()
    for r in rows():
        tokens = [*words((r[1] or "").encode().lower().decode()), "end"]
        base = sum(math.log10((count[t] + 1) / (n + v + 1)) for t in tokens)
        want[(r[0], held[r[0]], len(tokens), sum(count[t] > 0 for t in tokens), round(base, 6))] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 and math.isfinite(r.score) and r.train_tokens == n for r in got)
    assert hidden_markov.language_model_scores(empty).count() == 0


def brute_likelihood(chain, sequence):
    """The sum over all paths of states, by the unscaled recursion."""
    a = chain.first * chain.emits[sequence[0]]
    for o in sequence[1:]:
        a = (a @ chain.moves) * chain.emits[o]
    return a.sum()


def small_chain(k=3, seed=1):
    rng = np.random.default_rng(seed)
    norm = lambda x: x / x.sum(axis=-1, keepdims=True)
    return hidden_markov.Chain(norm(rng.random(k)), norm(rng.random((k, k))), norm(rng.random((k, hidden_markov.CLASSES))).T)


def test_forward_and_counts():
    chain = small_chain()
    rng = np.random.default_rng(2)
    sequences = [rng.integers(0, hidden_markov.CLASSES, n) for n in (1, 2, 5, 5, 9)]
    got = np.zeros(len(sequences))
    for own, table, running in hidden_markov._sheets(sequences, 3):
        got[own] = hidden_markov._forward(chain, table, running, keep=False)[0]
    assert np.allclose(got, [np.log10(brute_likelihood(chain, s)) for s in sequences])
    first, moves, emits = hidden_markov.baum_welch_counts(chain, sequences)
    # Counts by the derivative of the likelihood: E[count] = p * dL/dp / L.
    for i in range(3):
        for j in range(3):
            total = 0.0
            for s in sequences:
                up = hidden_markov.Chain(chain.first, chain.moves.copy(), chain.emits)
                up.moves[i, j] *= 1 + 1e-6
                total += (brute_likelihood(up, s) / brute_likelihood(chain, s) - 1) / 1e-6
            assert abs(total - moves[i, j]) < 1e-3
    assert abs(first.sum() - len(sequences)) < 1e-9
    assert abs(emits.sum() - sum(map(len, sequences))) < 1e-9
    assert abs(moves.sum() - sum(len(s) - 1 for s in sequences)) < 1e-9


def test_counts_in_stretches(monkeypatch):
    """Long sequences that are walked in stretches give the counts of those that are walked at once."""
    chain = small_chain(4, 9)
    rng = np.random.default_rng(8)
    sequences = [rng.integers(0, hidden_markov.CLASSES, n) for n in (1, 3, 40, 41, 700, 5000)]
    whole = hidden_markov.baum_welch_counts(chain, sequences)
    monkeypatch.setattr(hidden_markov, "CELLS", 600)
    for a, b in zip(whole, hidden_markov.baum_welch_counts(chain, sequences), strict=True):
        assert np.allclose(a, b)


def test_training_raises_likelihood(docs):
    blocks = hidden_markov.text_blocks(docs).cache()
    tokens = blocks.agg(F.sum("tokens")).first()[0]
    totals = hidden_markov.word_totals(blocks, tokens).cache()
    coded = hidden_markov.encode(blocks, totals, hidden_markov.facts(blocks, totals)).cache()
    chain = hidden_markov.initial(coded, 3)
    scores = []
    for _ in range(3):
        scores.append(hidden_markov.score(coded, chain).where("not held_out").agg(F.sum("score")).first()[0])
        chain = hidden_markov.train_pass(coded, chain)
    assert scores[2] > scores[0]


def test_first_guess_covers_every_text(spark):
    """Each text has a word of its own, which is a class; the states give all of these classes their share."""
    own = [i for i in range(2300) if not hidden_markov.held_out(i)]
    docs = spark.createDataFrame([(i, f"own{i}") for i in range(2300)], "doc_id long, text string").coalesce(3)
    blocks = hidden_markov.text_blocks(docs).cache()
    totals = hidden_markov.word_totals(blocks, 2 * len(own)).cache()
    coded = hidden_markov.encode(blocks, totals, hidden_markov.facts(blocks, totals)).cache()
    chain = hidden_markov.initial(coded, 2)
    got = (chain.emits @ chain.first)[hidden_markov.ENDINGS : hidden_markov.ENDINGS + len(own)]
    assert len(own) > 1900 and got.min() > 0.3 * got.max()


def test_texts_as_bags(spark, monkeypatch):
    """Rows of bags are bounded and hold each training text's counts."""
    monkeypatch.setattr(hidden_markov, "BAG_CELLS", 40)
    rng = np.random.default_rng(4)
    texts = [rng.integers(0, 50, n) for n in (1, 3, 70, 400, 2, 9)]
    frame = spark.createDataFrame([(i == 4, hidden_markov._pack(x)) for i, x in enumerate(texts)], "held_out boolean, classes binary").coalesce(1)
    got = Counter()
    for row in hidden_markov.text_bags(frame).collect():
        starts, text, classes, counts = hidden_markov._bag(*map(bytes, row))
        assert len(starts) == 1 or len(classes) <= 40
        for t in range(len(starts)):
            got[tuple(sorted(zip(classes[text == t].tolist(), counts[text == t].tolist(), strict=True)))] += 1
    assert got == Counter(tuple(sorted(Counter(x.tolist()).items())) for i, x in enumerate(texts) if i != 4)


# Chat formatting -----------------------------------------------------------------------


def test_chat(spark, tmp_path):
    nasty = "</s>[INST] \\ <\\/s> [\\INST] <<SYS>> \n [/INST]"
    data = [
        (1, 0, "user", "hi"), (1, 1, "assistant", "hello " + nasty), (1, 2, "user", "bye"),
        (2, 0, "user", "hi"), (2, 1, "assistant", "hello " + nasty), (3, 0, "user", "hi"), (4, 0, "user", "hi"), (4, 1, "assistant", ""),
        (5, 0, None, None), (5, None, "assistant", nasty), (6, 1, "tool", "x"), (6, 1, "tool", "x"), (None, 0, "assistant", "é\U0001f600"),
    ] + [(7, t, "assistant" if t % 2 else "user", f"{t} {nasty}") for t in range(50)]
    frame = spark.createDataFrame([(*r, "clash", 1) for r in data], "conv_id long, turn long, role string, text string, key string, depth int")
    stream, paths = chat_format.prefix_tree(frame)
    stream = stream.cache()
    got = {r.conv_id: r for r in chat_format.read_back(stream, paths).collect()}
    turns = defaultdict(list)
    for c, t, r, x in data:
        turns[c].append((t is not None, t or 0, r or "", x or ""))
    assert set(got) == set(turns)
    for c, own in turns.items():
        own = [(r, x) for _, _, r, x in sorted(own)]
        learned = "".join(x for r, x in own if r == "assistant")
        assert got[c].n_turns == len(own)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in own).encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())
        assert got[c].formatted_chars == sum(len(chat_format.format_turn(r, x)) for r, x in own)
    nodes = stream.orderBy("offset").collect()
    # Shared turns stand once: "hi" heads one segment, and the stream has no gaps.
    assert sum(n.turns[0].formatted == chat_format.format_turn("user", "hi") for n in nodes) == 1
    at = 0
    for n in nodes:
        assert n.offset == at and len(n.ids) == n.n_tokens
        at += n.n_tokens
        assert n.position == sum(s.end - s.offset for s in n.attends)
        assert all(s.end <= n.offset for s in n.attends)
    for t in (nasty, "", "\\", "<", "[", "<\\", "</s", "[INST"):
        assert chat_format.unescape(chat_format.escape(t)) == t
        assert not any(c in chat_format.escape(t) for c in chat_format.CONTROL)
    none = frame.limit(0)
    stream, paths = chat_format.prefix_tree(none)
    assert stream.count() == 0 and chat_format.read_back(stream, paths).count() == 0


# Quality -------------------------------------------------------------------------------


def repeat_words(tokens):
    grams = Counter(tuple(tokens[i : i + 3]) for i in range(len(tokens) - 2))
    hit = {j for i in range(len(tokens) - 2) if grams[tuple(tokens[i : i + 3])] > 1 for j in range(i, i + 3)}
    return len(hit)


def test_rules(docs, empty):
    got = Counter(tuple(r) for r in quality_rules.quality_rules(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect())
    want = Counter()
    for r in rows():
        text = r[1] or ""
        own = words(text)
        lines = [x for x in text.split("\n") if words(x)]
        repeats = repeat_words(own)
        want[(
            r[0], len(own), sum(len(w.decode()) for w in own), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)),
            repeats, len(own) < 50 or 100 * repeats > 50 * len(own),
        )] += 1
    assert got == want
    assert quality_rules.quality_rules(empty).count() == 0
    plan = quality_rules.quality_rules(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


def test_classifier(spark, tmp_path):
    data, marks = [], []
    for i in range(600):
        good = i % 3 > 0
        text = prose(i, 90) if good else " ".join(w.upper() + "!!" for w in prose(i, 60).split()) if i % 2 else "spam | " * 40
        data.append((i, text, "x", "y"))
        marks.append((i, int(good), 0))
    data += [(None, "words", None, None), (9_000, None, None, None), (9_001, "", None, None), (1, prose(1, 90), "x", "y")]
    marks += [(None, 1, 0), (5, None, 0), (7, 3, 0)]
    docs = spark.createDataFrame(data, "doc_id long, text string, __stats string, score string")
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    got = quality_classifier.classify(docs, labels).collect()
    assert len(got) == len(data) and all(0 <= r.score <= 1 for r in got)
    truth = {i: q for i, q, _ in marks[:600]}
    held = [(r.predicted, truth[r.doc_id]) for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 50 and np.mean([a == b for a, b in held]) > 0.97
    assert {r.doc_id for r in got if r.held_out} == {d[0] for d in data if d[0] is not None and zlib.crc32(str(d[0]).encode()) % 5 == 0}
    kept = quality_classifier.keep_good(docs, labels)
    assert kept.columns == docs.columns
    assert kept.where("doc_id < 600").count() == sum(r.predicted for r in got if r.doc_id is not None and r.doc_id < 600)
    none = quality_classifier.classify(docs.limit(0), labels)
    assert none.count() == 0
    assert {r.score for r in quality_classifier.classify(docs, labels.limit(0)).collect()} == {0.5}


def test_isotonic():
    rng = np.random.default_rng(0)
    x, n = np.sort(rng.random(60)), rng.integers(1, 9, 60).astype(float)
    y = rng.random(60) * n
    knots, values = quality_classifier.isotonic(x, y, n)
    assert (np.diff(values) > 0).all() and (np.diff(knots) > 0).all()
    # The fit by definition: at each place the largest over starts of the least over ends of the means between.
    want = [max(min(y[a : b + 1].sum() / n[a : b + 1].sum() for b in range(i, 60)) for a in range(i + 1)) for i in range(60)]
    assert np.allclose(np.unique(np.round(want, 9)), np.round(values, 9))


# Mixing --------------------------------------------------------------------------------


def fill(sizes, weights=(5, 2, 1), share=1.5, cap=2.0):
    """Targets by handing out and resharing until nothing is above."""
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    target, left, open_ = {}, share * sum(sizes.values()), set(order)
    while True:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total > cap * sizes[s]} if open_ else set()
        if not over:
            return target | {s: left * weight[s] / total for s in open_}
        for s in over:
            target[s] = cap * sizes[s]
        left -= sum(target[s] for s in over)
        open_ -= over


def test_mixing(spark, docs, empty):
    got = mixing.mix_sources(docs).collect()
    sizes = defaultdict(int)
    for r in rows():
        sizes[r[3]] += len(words(r[1]))
    want = fill(sizes)
    assert Counter((r.doc_id, r.size) for r in got) == Counter((r[0], len(words(r[1]))) for r in rows())
    taken = defaultdict(int)
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6
        assert 0 <= r.taken <= 2 * r.size and r.taken == r.copies * r.size
        taken[r.source] += r.taken
    largest = max(len(words(r[1])) for r in rows())
    assert all(abs(taken[s] - want[s]) <= largest for s in sizes)
    key = lambda r: (str(r.doc_id), r.taken, str(r.source))
    assert sorted(map(key, got)) == sorted(map(key, mixing.mix_sources(docs).collect()))
    assert mixing.mix_sources(empty).count() == 0
    mixed = mixing.apply_mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.copies for r in got)


def test_mixing_whatever_the_files(spark, tmp_path):
    """Rows in another order, in other files, and read in other splits are taken alike."""
    data = [(i, prose(i, 5 + i % 90), f"s{i % 4}") for i in range(700)] + [(3, prose(3, 8), "s3")] * 5
    seen = []
    for k, n in enumerate((1, 5)):
        path = f"file://{tmp_path}/docs{k}"
        spark.createDataFrame(data[:: 1 if k else -1], "doc_id long, text string, source string").repartition(n).write.parquet(path)
        spark.conf.set("spark.sql.files.maxPartitionBytes", 20_000 if k else 134_217_728)
        try:
            got = mixing.mix_sources(spark.read.parquet(path))
            seen.append(Counter(tuple(r) for r in got.select("doc_id", "size", "taken").collect()))
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert seen[0] == seen[1]


def test_mixing_rates(spark):
    """Rates are those of the entropy balance, by bisection on the dual of each source."""
    rng = np.random.default_rng(4)
    data = [(i, "w " * int(rng.integers(1, 150)), f"s{int(rng.integers(3))}") for i in range(900)]
    got = mixing.mix_sources(spark.createDataFrame(data, "doc_id long, text string, source string")).collect()
    for source in ("s0", "s1", "s2"):
        own = [r for r in got if r.source == source]
        size = np.array([r.size for r in own], dtype=float)
        if own[0].target >= 2 * own[0].source_size * (1 - 1e-9):
            want = np.full(len(own), 2.0)
        else:
            low, high = -50.0, 50.0
            for _ in range(200):
                mid = (low + high) / 2
                rate = np.minimum(2, np.exp(np.minimum(mid * size / size.mean(), 700)))
                low, high = (mid, high) if (rate * size).sum() < own[0].target else (low, mid)
            want = rate
        assert np.allclose([r.rate for r in own], want, rtol=1e-4)
        assert all(math.floor(r.rate) - 1 <= r.copies <= math.ceil(r.rate) + 1 for r in own)


def test_numbers_survive_a_shuffle(spark, docs):
    """What is no plain scan is written before its rows are numbered."""
    from voxelith.llm.common import numbered

    mixed = docs.select("doc_id", "text").repartition(7)
    rows_ = numbered(mixed)
    assert "/numbered-" in rows_.inputFiles()[0]
    assert rows_.select("__row").distinct().count() == docs.count()
    assert "/numbered-" not in numbered(docs.where("doc_id > 1").select("text")).inputFiles()[0]


def test_shuffles_go_with_their_write(spark):
    import time

    from voxelith.llm.common import SHUFFLE_CLEANUP, materialize

    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    blocks = lambda: {b for b in manager.getAllBlocks().mkString(" ").split() if b.startswith("shuffle_")}
    before, setting = blocks(), spark.conf.get(SHUFFLE_CLEANUP)
    frame = spark.range(1000).repartition(3, "id").groupBy("id").count()
    assert materialize(frame, "swept").count() == 1000
    assert spark.conf.get(SHUFFLE_CLEANUP) == setting
    # The shuffle of the last count has a file yet.
    left = lambda: {b.split("_")[1] for b in blocks() - before}
    end = time.time() + 10
    while len(left()) > 1 and time.time() < end:
        time.sleep(0.2)
    assert len(left()) <= 1
    # The frame itself can still be worked out.
    assert frame.count() == 1000


def test_mixing_meets_targets(spark):
    rng = np.random.default_rng(1)
    data = [(i, "w " * int(rng.integers(1, 200)), f"s{min(9, int(rng.exponential(2)))}") for i in range(4000)]
    got = mixing.mix_sources(spark.createDataFrame(data, "doc_id long, text string, source string").repartition(4).cache())
    off = got.groupBy("source").agg((F.abs(F.sum("taken") - F.first("target")) / F.first("target")).alias("e"), F.max("copies").alias("c")).collect()
    assert max(r.e for r in off) < 0.01 and max(r.c for r in off) <= 2


# Joins and duplicates ------------------------------------------------------------------


def test_shingles():
    import pyarrow as pa

    texts = ["", None, "a", "a b c d", "a b c d e", "a b c d e f", "  a\tb\nc d  e f ", "é ü a b c d"]
    found = shingles.shingled(pa.array(texts).slice(0))
    sliced = shingles.shingled(pa.array(["zzz zz", *texts]).slice(1))
    assert np.array_equal(found.values, sliced.values) and np.array_equal(found.bounds, sliced.bounds)
    own = [found.values[a:b].tolist() for a, b in zip(found.bounds[:-1], found.bounds[1:], strict=True)]
    assert [len(o) for o in own] == [0, 0, 1, 1, 1, 2, 2, 2]
    assert own[5] == own[6] and own[4][0] == own[5][0] and own[2] != own[3]
    assert found.words.tolist() == [0, 0, 1, 4, 5, 6, 6, 6]


def jaccard_truth(data):
    sets = []
    for r in data:
        w = words(r[1])
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    near = [[j for j in range(len(sets)) if j != i and sets[i] and sets[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])] for i in range(len(sets))]
    root = list(range(len(sets)))
    for _ in root:
        root = [min([root[i], *[root[j] for j in near[i]]]) for i in range(len(root))]
    order = lambda i: (data[i][0] is None, data[i][0] or 0)
    heads = {}
    for i, r in enumerate(root):
        if r not in heads or order(i) < order(heads[r]):
            heads[r] = i
    return Counter((data[i][0], data[heads[root[i]]][0], len(near[i])) for i in range(len(data))), len(set(root))


def test_ngram_join(spark, docs, empty):
    want, classes = jaccard_truth(rows())
    got = ngram_join.join(docs).collect()
    assert Counter((r.doc_id, r.class_id, r.n_links) for r in got) == want
    assert sum(r.kept for r in got) == classes
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == classes
    assert ngram_join.join(empty).count() == 0


def test_ngram_join_on_blocks(spark, monkeypatch):
    """Groups that are cut into pairs of blocks give the same links."""
    rng = np.random.default_rng(0)
    data = []
    for g in range(6):
        base = prose(g, 100).split()
        for k in range(25):
            own = list(base)
            for at in rng.integers(0, 100, k % 4):
                own[at] = f"z{rng.integers(1000)}"
            data.append((len(data), " ".join(own)))
    want, _ = jaccard_truth(data)
    frame = spark.createDataFrame(data, "doc_id long, text string").cache()
    monkeypatch.setattr(links, "BLOCK_ROWS", 7)
    got = ngram_join.join(frame).collect()
    assert Counter((r.doc_id, r.class_id, r.n_links) for r in got) == want


@pytest.mark.parametrize("leaf", [1024, 2])
def test_recall_of_runs(spark, monkeypatch, leaf):
    """Pairs at the threshold are met in some run, also where every leaf is split down to the last level."""
    monkeypatch.setattr(ngram_join, "LEAF_ROWS", leaf)
    rng = np.random.default_rng(5)
    data = []
    for g in range(250):
        base = [f"v{rng.integers(10**6)}" for _ in range(184)]
        other = list(base)
        for at in (30, 70, 110, 150):  # 160 of 200 shingles are shared: a similarity of 0.8
            other[at] = f"q{g}"
        data += [(2 * g, " ".join(base)), (2 * g + 1, " ".join(other))]
    if leaf == 2:  # copies of one text but for a word, so that leaves stay large
        base = [f"u{i}" for i in range(184)]
        data += [(500 + i, " ".join([*base[:i], "x", *base[i + 1 :]])) for i in range(30)]
    got = ngram_join.join(spark.createDataFrame(data, "doc_id long, text string").cache())
    assert got.where("doc_id < 500 and n_links = 1").count() >= 0.97 * 500
    if leaf == 2:
        assert got.where("doc_id >= 500 and n_links = 29").count() == 30


def test_runs():
    assert abs(ngram_join.survival(2) - 0.468) < 1e-3 and ngram_join.runs_for(0.99) == 13
    assert 1 - (1 - ngram_join.survival(4)) ** ngram_join.runs_for(0.99) >= 0.99


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(99, i) for i in range(50, 70)] + [(7, 7)]
    got = {r.id: r.component for r in links.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 50 for i in range(50, 70)} | {99: 50}


def test_embeddings(spark, monkeypatch):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((40, 16))
    vectors = []
    for i in range(40):
        for k in range(1 + i % 6):
            vectors.append((base[i] + 0.08 * k * rng.standard_normal(16)).tolist())
    vectors += [base[0].tolist()] * 30 + [(3 * base[1]).tolist()]
    odd = [None, [], [0.0] * 16, [float("nan")] * 16, [None] * 16, [float("inf")] + [1.0] * 15, [1.0, 2.0], [2.0, 4.0], [1.0]]
    data = [(i, v, 0, "x") for i, v in enumerate(vectors + odd)]
    good = [i for i, v in enumerate(vectors + odd) if i < len(vectors) or v in ([1.0, 2.0], [2.0, 4.0], [1.0])]
    near = defaultdict(set)
    for i in good:
        for j in good:
            a, b = np.array(data[i][1]), np.array(data[j][1])
            if i != j and len(a) == len(b) and a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= 0.95:
                near[i].add(j)
    root = list(range(len(data)))
    for _ in root:
        root = [min([root[i], *[root[j] for j in near[i]]]) for i in range(len(root))]
    frame = spark.createDataFrame(data, "vec_id long, embedding array<double>, label int, id string").cache()
    for rows_ in (1024, 5):
        monkeypatch.setattr(links, "BLOCK_ROWS", rows_)
        got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(frame).collect()}
        want = {i: (len(near[i]), root[i], root[i] == i) for i in range(len(data))}
        assert sum(got[i] != want[i] for i in want) == 0
    assert embedding_dedup.near_duplicates(frame.limit(0)).count() == 0
    assert embedding_dedup.recall(frame) >= 0.9


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_lines(spark, docs, empty):
    got = line_dedup.dedup_lines(docs).collect()
    assert len(got) == len(rows())
    seen = Counter()
    for r in got:
        for line in (r.text or "").split("\n"):
            if words(line):
                seen[b" ".join(words(line.lower()))] += 1
    assert max(seen.values()) == 1
    every = {b" ".join(words(x.lower())) for r in rows() for x in (r[1] or "").split("\n") if words(x)}
    # What went altogether has a fuzzy twin that stayed.
    for line in every - set(seen):
        assert any(edit(line, s) <= 0.2 * max(len(line), len(s)) for s in seen)
    assert sum(r.n_removed for r in got) == sum(len((r[1] or "").split("\n")) for r in rows() if r[1] is not None) - sum(
        len((r.text or "").split("\n")) if r.n_removed < r.n_lines else 0 for r in got if r.text is not None
    )
    assert [c for c in line_dedup.dedup_lines(docs).columns if c not in ("n_lines", "n_removed")] == docs.columns
    assert line_dedup.drop_lines(docs).columns == docs.columns
    assert line_dedup.dedup_lines(empty).count() == 0


def test_fuzzy_lines(spark):
    rng = np.random.default_rng(8)
    data, twins = [], 0
    for g in range(40):
        base = [f"v{rng.integers(10**6)}" for _ in range(120)]
        other = list(base)
        other[int(rng.integers(120))] = "changed"
        data += [(2 * g, " ".join(base)), (2 * g + 1, " ".join(other).upper())]
    frame = spark.createDataFrame(data, "doc_id long, text string").cache()
    got = line_dedup.dedup_lines(frame).collect()
    twins = sum(r.n_removed for r in got)
    assert all(r.n_removed == 0 for r in got if r.doc_id % 2 == 0)
    assert twins >= 0.6 * 40  # one word of 120: what SimHash blocks are made for


def test_simhash(spark):
    import xxhash

    def sim(line):
        counts = np.zeros(64, dtype=int)
        own = set(line.lower().split())
        for w in own:
            h = xxhash.xxh64_intdigest(w.encode(), seed=42)
            counts += np.array([h >> i & 1 for i in range(64)])
        value = sum(1 << i for i in range(64) if 2 * counts[i] > len(own))
        return value - 2**64 if value >= 2**63 else value

    texts = [prose(1, 30), prose(2, 300), "one two three", "A a a B", " ".join(f"k{i}" for i in range(1000)), "x"]
    frame = spark.createDataFrame([(i, i, t) for i, t in enumerate(texts)], "__row long, doc_id long, text string")
    lines = line_dedup._occurrences(frame).select("doc_id", line_dedup.word_hashes().alias("hashes"))
    got = {r.doc_id: r.sim for r in line_dedup.simhashes(lines, "doc_id").collect()}
    assert got == {i: sim(t) for i, t in enumerate(texts)}


def test_four_shared_words_meet(spark):
    """Lines that share four of their key words have a block in common, whatever the words are."""
    rng = np.random.default_rng(3)
    data = []
    for i in range(200):
        own = [int(x) for x in rng.integers(0, 2**62, 6)]
        data += [(2 * i, *own), (2 * i + 1, *sorted(own[:4] + [int(x) for x in rng.integers(0, 2**62, 2)]))]
    data = [(i, *sorted(w)) for i, *w in data]
    frame = spark.createDataFrame(data, "id long, " + ", ".join(f"w{i} long" for i in range(6)))
    keys = defaultdict(set)
    for r in line_dedup.line_blocks(frame).collect():
        keys[r.id].add(r.key)
    assert all(keys[2 * i] & keys[2 * i + 1] for i in range(200))
    assert sum(map(len, keys.values())) < 10 * len(data)


def test_distance_along_words(spark):
    """The distance along shared words is never too small, and near the least one for lines that are alike."""
    rng = np.random.default_rng(6)
    pairs = []
    for i in range(60):
        base = prose(i, 60).split()
        other = [w for w in base if rng.random() > 0.04]
        for at in rng.integers(0, len(other), 3):
            other[at] = f"z{rng.integers(1000)}"
        pairs.append((base, other if i % 3 else prose(1000 + i, 60).split()))
    pairs += [([], []), ([], ["a"]), (["a"], []), (["a", "b"], ["b"])]
    frame = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, ws array<string>, wt array<string>")
    follow = "if(size({0}) = 0, cast(array() as array<bigint>), transform(sequence(0, size({0}) - 1), i -> xxhash64({0}[i], get({0}, i + 1))))"
    frame = frame.withColumn("bs", F.expr(follow.format("ws"))).withColumn("bt", F.expr(follow.format("wt")))
    got = {r.i: r.d for r in frame.select("i", F.expr(line_dedup._aligned("1000000")).alias("d")).collect()}
    near = []
    for i, (a, b) in enumerate(pairs):
        least = edit(" ".join(a), " ".join(b))
        assert got[i] >= least
        if i < 60 and i % 3:
            near.append(got[i] <= 1.3 * least + 2)
    # A few words make these texts, so that now and then a wrong pair of words is taken for a match.
    assert np.mean(near) >= 0.9


def twin_lines(change, n=80):
    """Lines of 8 to 40 words, each with a changed copy that still has the edit similarity."""
    rng = np.random.default_rng(17)
    word = lambda: "".join("abcdefghijklmnopqrstuvwxyz"[i] for i in rng.integers(0, 26, rng.integers(2, 10)))
    vocabulary = [word() for _ in range(3000)]
    twins = []
    for i in range(n):
        base = [vocabulary[j] for j in rng.integers(0, 3000, 8 + i % 33)]
        line, other = " ".join(base), list(base)
        if change == "words":  # as many as the similarity allows
            for at in rng.permutation(len(base)):
                more = [*other[:at], vocabulary[rng.integers(3000)], *other[at + 1 :]]
                if edit(line, " ".join(more)) > 0.2 * max(len(line), len(" ".join(more))):
                    break
                other = more
            twins.append((line, " ".join(other)))
        else:  # one character in fifty
            twins.append((line, "".join("#" if c != " " and rng.random() < 0.02 else c for c in line)))
    return [(a, b) for a, b in twins if a != b]


@pytest.mark.parametrize("change", ["words", "characters"])
def test_line_recall(spark, change):
    twins = twin_lines(change)
    every = [x for pair in twins for x in pair]
    true = {(i, j) for i, a in enumerate(every) for j, b in enumerate(every[:i])
            if abs(len(a) - len(b)) <= 0.2 * max(len(a), len(b)) and len(set(a.split()) & set(b.split())) > 1
            and edit(a, b) <= 0.2 * max(len(a), len(b))}
    assert len(true) >= len(twins)
    frame = spark.createDataFrame(list(enumerate(every)), "doc_id long, text string").coalesce(2)
    gone = {r.doc_id for r in line_dedup.dedup_lines(frame).collect() if r.n_removed}
    assert gone <= {max(p) for p in true}
    assert len(gone) >= 0.95 * len({max(p) for p in true})


def test_line_recall_of_a_table(spark):
    """All pairs of a table's lines that reach the edit similarity, by brute force, share a group."""
    from voxelith.llm.common import numbered

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    occurrences, groups = line_dedup.line_groups(numbered(docs.select("doc_id", "text")))
    named = occurrences.select("norm", "h", "g").distinct().join(groups, ["h", "g"]).select("norm", F.coalesce("component", "id").alias("c"))
    group = {r.norm: r.c for r in named.collect() if len(r.norm.split(" ")) >= 5}
    lines = sorted(group)
    bags = [set(x.split(" ")) for x in lines]
    near = [
        (a, b) for i, a in enumerate(lines) for j, b in enumerate(lines[:i])
        if abs(len(a) - len(b)) <= 0.2 * max(len(a), len(b)) and len(bags[i] & bags[j]) >= 0.45 * max(len(bags[i]), len(bags[j]))
        and edit(a, b) <= 0.2 * max(len(a), len(b))
    ]
    assert len(near) > 40
    assert sum(group[a] == group[b] for a, b in near) >= 0.95 * len(near)


def scattered_twins(seed, n=20):
    """Lines of six long words and many short ones, and copies with a character of each short word changed."""
    rng = np.random.default_rng(seed)
    word = lambda size: "".join("abcdefghijklmnopqrstuvwxyz"[i] for i in rng.integers(0, 26, size))
    twins = []
    for _ in range(n):
        long, short = [word(20) for _ in range(6)], [word(3) for _ in range(30)]
        twins.append((long, short, [w[:1] + "#" + w[2:] for w in short]))
    return twins


def test_twins_of_unlike_words(spark):
    """Lines whose SimHashes differ in most words, and that yet have the edit similarity, are duplicates."""
    data = []
    for i, (long, short, other) in enumerate(scattered_twins(31)):
        data += [(2 * i, " ".join(long + short)), (2 * i + 1, " ".join(long + other))]
        assert edit(data[-1][1], data[-2][1]) <= 0.2 * len(data[-1][1])
    frame = spark.createDataFrame(data, "doc_id long, text string").coalesce(2)
    assert {r.doc_id for r in line_dedup.dedup_lines(frame).collect() if r.n_removed} == {i for i, _ in data if i % 2}


def test_twins_beside_another_head(spark, monkeypatch):
    """Twins in blocks with a head that is like neither, which share few of their words, by probes or by the last test of all."""
    data = []
    for i, (long, short, other) in enumerate(scattered_twins(32, 8)):
        head = " ".join(long + [w * 4 for w in short])
        data += [(4 * i, head), (4 * i + 1, head), (4 * i + 2, " ".join(long + short)), (4 * i + 3, " ".join(long + other))]
    frame = spark.createDataFrame(data, "doc_id long, text string").coalesce(2)
    for rounds in (2, 0):
        monkeypatch.setattr(line_dedup, "ROUNDS", rounds, raising=False)
        assert {r.doc_id for r in line_dedup.dedup_lines(frame).collect() if r.n_removed} == {i for i, _ in data if i % 2}


def test_three_shared_words_meet(spark):
    """Three of six long words kept, as where errors are scattered over a line, are enough whichever they are."""
    data = []
    for i, (long, short, _) in enumerate(scattered_twins(33, 40)):
        other = [w[:9] + "#" + w[10:] if j in [(0, 1, 2), (1, 3, 5), (0, 2, 4), (2, 4, 5)][i % 4] else w for j, w in enumerate(long)]
        data += [(2 * i, " ".join(long + short)), (2 * i + 1, " ".join(other + short))]
    frame = spark.createDataFrame(data, "doc_id long, text string").coalesce(2)
    assert {r.doc_id for r in line_dedup.dedup_lines(frame).collect() if r.n_removed} == {i for i, _ in data if i % 2}


def test_line_twins_whatever_the_table_size(spark, monkeypatch):
    rng = np.random.default_rng(23)
    data = []
    for g in range(60):
        base = [f"v{rng.integers(10**6)}" for _ in range(60)]
        data += [(2 * g, " ".join(base)), (2 * g + 1, " ".join(base[:30] + ["changed"] + base[31:]))]
    frame = spark.createDataFrame(data, "doc_id long, text string").coalesce(2)
    # As though the table had more lines than any; nothing about a pair may follow the count.
    monkeypatch.setattr(type(frame), "count", lambda self: 1 << 25)
    assert sum(r.n_removed for r in line_dedup.dedup_lines(frame).collect()) == 60


def test_unlike_lines_of_a_block_make_no_rows(spark, monkeypatch):
    """Lines that share blocks and are not alike are compared where they meet; only links become rows, each once."""
    monkeypatch.setattr(line_dedup, "PART_ROWS", 16)
    rng = np.random.default_rng(41)
    texts = ["common passage of words " + "".join("abcdefghij"[k] for k in rng.integers(0, 10, 60)) for _ in range(100)]
    texts += [t[:-1] + "#" for t in texts[:7]]
    lines = spark.createDataFrame([(i, t, len(t)) for i, t in enumerate(texts)], "id long, norm string, chars int")
    held = lines.select("id", "chars", F.col("id").alias("component"), F.lit(len(texts)).cast("long").alias("size")).withColumn(
        "key", F.explode(F.array(*[F.lit(k).cast("long") for k in (5, 6, 7)]))
    )
    got = [tuple(r) for r in line_dedup._across(held, lines).collect()]
    assert sorted(got) == [(i, 100 + i, False) for i in range(7)]


def test_intermediate_tables_go(spark):
    """What a stage leaves behind is what the frame it returns still reads."""
    sf = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{sf}/{name}.parquet") for name in ("documents", "labels"))
    folder = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    before = set(os.listdir(folder))
    for frame in (quality_classifier.keep_good(docs, labels), line_dedup.drop_lines(docs), ngram_join.keep_one(docs)):
        assert frame.count() > 0
    left = sorted(name.rsplit("-", 1)[0] for name in set(os.listdir(folder)) - before)
    assert left == ["classifier-gone", "join-rows", "line-drops"]


def test_keep_good_keeps_what_the_classifier_predicts(spark):
    sf = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{sf}/{name}.parquet") for name in ("documents", "labels"))
    want = sorted(r.doc_id for r in quality_classifier.classify(docs, labels).where("predicted = 1").collect())
    got = quality_classifier.keep_good(docs, labels)
    assert got.columns == docs.columns
    assert sorted(r.doc_id for r in got.collect()) == want and 0 < len(want) < docs.count()
    assert got.exceptAll(docs).isEmpty()


# WARC ----------------------------------------------------------------------------------


def test_warc(spark):
    long, other = "<p>é" + "x" * 2000, "y" * 1000
    data = [
        (1, "http://www.a.example/x?q=1", long), (2, "https://b.a.example/", long), (3, None, None), (4, "", ""), (5, "not a url ::", "tiny"),
        (6, "http://a.example:8080/ß b", "tiny"), (7, "http://c.example", other), (7, "http://c.example", other), (None, "http://d.example", long),
        (8, "http://e.example/\nnew", "z" * 999), (9, "http://e.example/", "z" * 999), (10, "http://b.a.example/", "\x00\r\n\r\n" + "q" * 1500),
    ]
    pages = spark.createDataFrame([(*r, "clash", "clash") for r in data], "page_id long, url string, html string, digest string, file string").repartition(3)
    archive = warc.write(pages)
    got = Counter(tuple(r) for r in warc.read_all(archive).collect())
    want = Counter()
    for page, _, html in data:
        body = (html or "").encode()
        same = [p for p, _, h in data if (h or "").encode() == body]
        head = max((p for p in same if p is not None), default=None)
        revisit = len(body) >= 1000 and page != head
        want[(page, len(body), hashlib.sha1(body).hexdigest(), "revisit" if revisit else "response", head if revisit else None)] += 1
    assert got == want
    lookup = warc.Lookup(archive)
    for page, url, _ in data:
        found = [h["X-Page-ID"] for h, _ in lookup.payloads(url)]
        assert ("" if page is None else str(page)) in found
    assert lookup.captures("http://nothing.example/") == []
    headers, payload = next(x for x in lookup.payloads("http://b.a.example/") if x[0]["X-Page-ID"] == "10")
    assert payload == ("\x00\r\n\r\n" + "q" * 1500).encode() and headers["WARC-Type"] == "response"
    none = warc.write(pages.limit(0))
    assert warc.read_all(none).count() == 0 and warc.Lookup(none).captures("http://a.example") == []


def test_surt():
    assert warc.surt("https://www.blog.example.com/a?b=c") == "com,example,blog)/a?b=c"
    assert warc.surt(None) == ")/" and warc.surt("http://h:81/") == "h:81)/"


def test_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 3)
    pages = spark.createDataFrame([(i, f"http://h{i % 7}.example/{i // 14}", f"page {i}") for i in range(200)], "page_id long, url string, html string")
    archive = warc.write(pages)
    assert archive.directory.count() >= 60
    lookup = warc.Lookup(archive)
    for i in range(0, 200, 3):
        found = {int(h["X-Page-ID"]) for h, _ in lookup.payloads(f"http://h{i % 7}.example/{i // 14}")}
        assert found == {j for j in range(200) if j % 7 == i % 7 and j // 14 == i // 14}
