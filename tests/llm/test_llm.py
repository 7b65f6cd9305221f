"""Operators for training data against brute force, on small made-up tables with awkward rows."""

import collections
import hashlib
import json
import math
import random
import re
import time
import zlib
from itertools import pairwise

import duckdb
import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from matchlens.llm import bloom, fingerprint, jaccard, langid, mixing, packing, queries, repetition, scoring, substring, toolcalls, urlfilter
from matchlens.llm.common import CLEAN_KEY, stored
from matchlens.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double"


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def ascii_lower(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


def corpus():
    """Nulls, empty and blank texts, ties, near copies, shared passages, repeats, odd letters."""
    r = random.Random(5)
    vocab = ["".join(r.choice(["th", "er", "on", "an", "ou", "é", "ß", "日", "re", "x"]) for _ in range(r.randint(1, 4))) for _ in range(400)]
    de = [w + "ung" for w in vocab]
    passage = " ".join(r.choice(vocab) for _ in range(70))
    rows = [(0, None, "en", None), (1, "", "en", "b"), (2, " \n\t ", None, "b"), (3, "one", "en", "a"), (4, "12 34 !!", "de", "a"), (5, "a" * 5000, "en", "a"), (6, "la la la " * 60, "en", "b"), (7, "Two\x1cWords <|endoftext|>  x y\r\n\n", "en", "c")]
    for i in range(8, 70):
        text = " ".join(r.choice(de if i % 3 == 0 else vocab) for _ in range(r.randint(20, 260)))
        if i % 5 == 0:
            text = f"{text}\n{passage.upper() if i % 10 == 0 else passage}, {text[:40]}"
        if i % 7 == 0 and i > 20:
            old = words_of(rows[i - 3][1])
            text = " ".join(w if r.random() > 0.01 else "EDIT" for w in old) if i % 2 else rows[i - 3][1]
        rows.append((i, text, "de" if i % 3 == 0 else "en", ("a", "b", "a", None)[i % 4]))
    rows += [rows[20], rows[20], (None, rows[30][1], None, "a")]
    return [(*x, len(x[1] or ""), 0.5) for x in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3).persist()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def shingles(text, k):
    w = words_of(ascii_lower(text))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


@pytest.mark.parametrize(("k", "num", "small"), [(3, 90, False), (5, 60, True)])
def test_jaccard(docs, empty, monkeypatch, k, num, small):
    if small:
        monkeypatch.setattr(jaccard, "BLOCK_SHINGLES", 300)
        monkeypatch.setattr(jaccard, "TILE_ROWS", 2)
        monkeypatch.setattr(jaccard, "ANCHORS", 1)
    got = [tuple(r) for r in jaccard.link(docs, k, num, 100).collect()]
    sets = {d: shingles(t, k) for d, t, *_ in corpus() if d is not None}
    to = {d: d for d in sets}

    def top(d):
        while to[d] != d:
            d = to[d]
        return d

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]) and top(a) != top(b):
                x, y = sorted((top(a), top(b)))
                to[y] = x
    assert sorted(got, key=str) == sorted(((d, len(shingles(t, k)), top(d) if d is not None else None) for d, t, *_ in corpus()), key=str)
    assert len({top(d) for d in sets}) < len(sets)
    if not small:
        assert jaccard.link(empty).count() == 0


@pytest.mark.parametrize(("k", "num"), [(3, 90), (5, 60)])
def test_jaccard_in_parts_is_the_same(docs, monkeypatch, k, num):
    """Tiles, blocks and pairs of blocks that go through one part after the other link what they link at once."""
    whole = sorted(map(str, jaccard.link(docs, k, num, 100).collect()))
    for name, value in (("BLOCK_SHINGLES", 300), ("TILE_ROWS", 2), ("ANCHORS", 1), ("PART_HASHES", 10), ("PART_SHINGLES", 10), ("PARTS", 5)):
        monkeypatch.setattr(jaccard, name, value)
    assert sorted(map(str, jaccard.link(docs, k, num, 100).collect())) == whole


def test_near_duplicates_in_parts_are_the_same(spark, docs, monkeypatch):
    import corpus_pipeline

    whole = sorted(map(str, corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()))
    for name in ("PART_HASHES", "PART_SHINGLES"):
        monkeypatch.setattr(jaccard, name, 10)
    assert sorted(map(str, corpus_pipeline.drop_near_duplicates(spark, docs, "").collect())) == whole


def _shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}


def test_stored_tables_leave_no_shuffles(spark):
    before, conf = _shuffle_files(spark), spark.conf.get(CLEAN_KEY)
    rows = stored(spark.range(20_000).select("id", F.xxhash64("id").alias("h")).repartition(4, "h"))
    deadline = time.time() + 20
    while _shuffle_files(spark) - before and time.time() < deadline:  # Spark deletes them in the background
        time.sleep(0.2)
    assert not _shuffle_files(spark) - before
    assert rows.count() == 20_000 and spark.conf.get(CLEAN_KEY) == conf


def test_components(spark):
    r = random.Random(1)
    links = [(r.randint(0, 150), r.randint(0, 150)) for _ in range(110)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5, 5)]
    to = {x: x for p in links for x in p}
    for _ in range(200):
        for a, b in links:
            to[a] = to[b] = min(to[a], to[b])
    got = {x["node"]: x["component"] for x in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: c for x, c in to.items() if any(x in p and p[0] != p[1] for p in links)}


@pytest.mark.parametrize("hot", [4000, 1])
def test_substring(docs, empty, monkeypatch, hot):
    monkeypatch.setattr(substring, "HOT", hot)
    got = collections.Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in substring.dedup(docs.select("doc_id", "text", "score")).collect())
    first = {}
    for d, t, *_ in corpus():
        w = words_of(t)
        for i in range(len(w) - 49):
            if d is not None:
                first[tuple(w[i : i + 50])] = min(d, first.get(tuple(w[i : i + 50]), d))
    want = collections.Counter()
    for d, t, *_ in corpus():
        w = words_of(t)
        gone = {j for i in range(len(w) - 49) if d is not None and first[tuple(w[i : i + 50])] < d for j in range(i, i + 50)}
        want[(d, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone))] += 1
    assert got == want and sum(n for _, _, n, _ in want) > 500
    assert substring.dedup(empty).count() == 0


def test_packing(docs, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = [r.asDict() for r in packing.pack(docs, capacity=256).collect()]
    left = collections.Counter()
    for d, text, *_ in corpus():
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        at, n = 0, (len(ids) - 1) % 256 + 1
        for piece in range(-(-len(ids) // 256)):
            left[(d, piece, at, n, zlib.crc32(np.asarray(ids[at : at + n], "<u4").tobytes()))] += 1
            at, n = at + n, 256
    assert left == collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows)
    bins = collections.defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for b in bins.values():
        b.sort()
        assert b[0][0] == 0 and all(x + n == y for (x, n), (y, _) in pairwise(b)) and sum(b[-1]) <= 256
    assert len(bins) <= 1.08 * math.ceil(sum(r["length"] for r in rows) / 256)
    assert packing.pack(empty).count() == 0


def fewest(sizes, capacity):
    """Exact, by search over the largest remaining item's partners."""
    if not sizes:
        return 0
    best = len(sizes)

    def go(left, used):
        nonlocal best
        if used + math.ceil(sum(left) / capacity) >= best:
            return
        if not left:
            best = used
            return
        head, rest = left[0], left[1:]

        def fill(i, room, chosen):
            go([x for j, x in enumerate(rest) if j not in chosen], used + 1) if not any(x <= room and j not in chosen and j >= i for j, x in enumerate(rest)) else None
            for j in range(i, len(rest)):
                if rest[j] <= room:
                    fill(j + 1, room - rest[j], chosen | {j})

        fill(0, capacity - head, frozenset())

    go(sorted(sizes, reverse=True), 0)
    return best


def test_dominance_keeps_an_optimum():
    r = random.Random(3)
    for _ in range(150):
        sizes = [r.randint(1, 20) for _ in range(r.randint(1, 9))]
        counts = [sizes.count(i) for i in range(21)]
        fixed = packing.reduce_by_dominance(counts, 20)
        rest = [i for i in range(21) for _ in range(counts[i])]
        assert sum(n for _, n in fixed) + fewest(rest, 20) == fewest(sizes, 20), sizes
        packed = fixed + packing.best_fit(counts, 20)
        assert sorted(x for s, n in packed for x in s * n) == sorted(sizes) and all(sum(s) <= 20 for s, _ in packed)


def test_encoder_equals_the_tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    r = random.Random(1)
    parts = [" ", "\n", "\t", "a", "B", "é", "'s", "'", "12", ",", ".", "\x02", " ", "日", "<|endoftext|>", "\r\n", "  ", "ß", "\x1c", "\u0085", "Ω", "ж", "​", "$"]
    for _ in range(3000):
        x = "".join(r.choice(parts) for _ in range(r.randint(0, 12)))
        assert np.frombuffer(packing.encoder(None)(x.encode()), "<u4").tolist() == t.encode(x, add_special_tokens=False).ids, repr(x)


def test_repeats_and_rules(docs, empty):
    r = np.random.default_rng(0)
    for _ in range(60):
        texts = [r.integers(0, r.integers(1, 6), r.integers(0, 30)).tolist() for _ in range(r.integers(1, 5))]
        want = []
        for x in texts:
            for i in range(len(x)):
                best = 0
                for j in range(len(x)):
                    n = 0
                    while i != j and max(i, j) + n < len(x) and x[i + n] == x[j + n]:
                        n += 1
                    best = max(best, n)
                want.append(best)
        got = repetition.repeats(np.asarray([v for x in texts for v in x], np.uint64), np.repeat(np.arange(len(texts)), [len(x) for x in texts]))
        assert got.tolist() == want
    for row in repetition.assess(docs.select("doc_id", F.col("text"), F.col("text").alias("t"))).collect():
        text = row["t"] or ""
        w = words_of(text)
        seen = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        again = {j for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
        lines = [x for x in text.split("\n") if words_of(x)]
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(again))
        assert tuple(row[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want
        covered, longest = repeated(w, 10)
        assert (row["repeat_covered"], row["longest_repeat"]) == (covered, longest)
        assert row["base_failed"] == (len(w) < 50 or 100 * len(again) > 50 * len(w))
        assert row["kept"] == (not row["base_failed"] and covered <= 0.1 * len(w) and longest < 50)
    assert repetition.assess(empty).count() == 0 and repetition.filter_repetitive(docs).columns == docs.columns


def repeated(w, least):
    """Words that repeats of so many words cover, and the longest repeat, by comparing all windows."""
    seen = collections.defaultdict(list)
    for i in range(len(w) - least + 1):
        seen[tuple(w[i : i + least])].append(i)
    covered = {j for at in seen.values() if len(at) > 1 for i in at for j in range(i, i + least)}
    longest, k = 0, 1
    while len({tuple(w[i : i + k]) for i in range(len(w) - k + 1)}) < len(w) - k + 1:
        longest, k = k, k + 1
    return len(covered), longest


def test_planted_repeats_decide(spark, monkeypatch):
    """Texts that pass the base are rejected for covered parts and for one long repeat; clean and lightly repeating ones stay."""
    r = random.Random(4)
    prose = lambda n: [f"w{r.randint(0, 10**6)}" for _ in range(n)]
    line, passage = prose(12), prose(60)
    texts = {
        "clean": prose(400), "light": prose(150) + line + prose(150) + line + prose(20), "covered": prose(60) + line + prose(60) + line + prose(20),
        "long": prose(900) + passage + prose(900) + passage, "short repeats": (prose(8) + ["and", "so", "on"]) * 1 + prose(300) + ["and", "so", "on"], "few": line * 2,
    }
    docs = spark.createDataFrame([(i, " ".join(t), k) for i, (k, t) in enumerate(texts.items())], "doc_id long, text string, kept string")
    for long_words in (repetition.LONG_WORDS, 100):
        monkeypatch.setattr(repetition, "LONG_WORDS", long_words)
        monkeypatch.setattr(repetition, "MIN_REPEAT", 10)
        h = {k: repetition.hash_words(*(lambda d: (d, *repetition.find_words(d, np.asarray([0, len(d)]))[:2]))(np.frombuffer(" ".join(t).encode(), np.uint8))) for k, t in texts.items()}
        for k, t in texts.items():
            three, cover, most = (int(x[0]) for x in repetition._counts(h[k], np.asarray([0, len(t)]), 10))
            assert (three, cover, most) == (repeated(t, 3)[0], *repeated(t, 10)), k
    assert {x["kept"] for x in repetition.filter_repetitive(docs).collect()} == {"clean", "light", "short repeats"}
    verdicts = {x["doc_id"]: x for x in repetition.assess(docs, columns=["doc_id"]).collect()}
    assert [verdicts[i]["base_failed"] for i in range(6)] == [False] * 5 + [True]


def test_language(docs, empty):
    got = {(r["doc_id"], r["held_out"]): r for r in langid.identify(docs).collect()}
    rows = {d: (t, lang) for d, t, lang, *_ in corpus()}
    for (d, held), r in got.items():
        assert held == (zlib.crc32(("" if d is None else str(d)).encode()) % 4 == 2) and 0 <= r["score"] <= 1
        assert (r["lang_pred"] == "und") == (not any(map(str.isalpha, rows[d][0] or "")))
    right = [got[d, zlib.crc32(str(d).encode()) % 4 == 2]["lang_pred"] == rows[d][1] for d in range(8, 70) if d % 7]
    assert sum(right) / len(right) > 0.95
    kept = langid.accept(docs)
    assert kept.columns == docs.columns and {0, 1, 2, 4}.isdisjoint(r["doc_id"] for r in kept.collect())
    assert langid.identify(empty).count() == 0
    assert {r["lang_pred"] for r in langid.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def bayes(rows, bits=15):
    """Multinomial naive Bayes over hashed 1- to 3-grams, one text at a time: {text: (language, posterior)}."""
    full = (1 << 64) - 1

    def spread(h):
        h = ((h ^ (h >> 30)) * 0xBF58476D1CE4E5B9) & full
        h = ((h ^ (h >> 27)) * 0x94D049BB133111EB) & full
        return h ^ (h >> 31)

    def grams(text):
        points = [ord(c) for c in text.lower()]
        for n in (1, 2, 3):
            for i in range(len(points) - n + 1):
                h = n
                for x in points[i : i + n]:
                    h = (h * 0x9E3779B97F4A7C15 + x) & full
                yield spread(h) >> (64 - bits)

    counts, texts = collections.defaultdict(collections.Counter), collections.Counter()
    for d, text, lang, *_ in rows:
        if lang is not None and zlib.crc32(("" if d is None else str(d)).encode()) % 4 != 2:
            counts[lang].update(grams(text or ""))
            texts[lang] += 1
    out = {}
    for _, text, *_ in rows:
        if not any(map(str.isalpha, text or "")):
            out[text] = ("und", 0.0)
            continue
        logs = {}
        for lang in sorted(counts):
            total = sum(counts[lang].values()) + 0.5 * (1 << bits)
            logs[lang] = math.log((texts[lang] + 1) / (sum(texts.values()) + len(texts))) + sum(math.log((counts[lang][g] + 0.5) / total) for g in grams(text))
        best = max(sorted(logs), key=logs.get)
        out[text] = (best, 1 / sum(math.exp(x - logs[best]) for x in logs.values()))
    return out


def test_language_equals_naive_bayes(docs, monkeypatch):
    want = bayes(corpus())
    for r in langid.identify(docs).join(docs.select("doc_id", "text").distinct(), "doc_id").collect():
        lang, sure = want[r["text"]]
        assert (r["lang_pred"], r["score"]) == (lang, pytest.approx(sure, abs=2e-3)), r["doc_id"]
    # A matrix with fewer cells has wider columns; every language is still learned.
    monkeypatch.setattr(langid, "MATRIX_CELLS", 1 << 11)
    monkeypatch.setattr(langid, "HELD_LANGUAGES", 0)
    want = bayes(corpus(), 10)
    names, matrix = langid.train(docs.where(~langid.held_out(4, 2)))
    assert names == ["de", "en"] and matrix.shape == ((1 << 10) + 1, 2)
    for r in langid.predict(docs.select("doc_id", "text"), names, matrix).collect():
        assert (r["lang_pred"], r["score"]) == (want[r["text"]][0], pytest.approx(want[r["text"]][1], abs=2e-3))


def test_language_stage_keeps_what_no_language_fits_best(spark):
    """Three languages fit these texts equally; where none is labelled, texts with a letter stay, too."""
    rows = [(i, "the same words", "abc"[i % 3]) for i in range(30)] + [(100, None, "a"), (101, "12 !!", "b"), (102, "", "c")]
    some = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for given in (some, some.withColumn("lang", F.lit(None).cast("string"))):
        assert sorted(r["doc_id"] for r in langid.accept(given).collect()) == list(range(30))


def test_mixing(docs, empty):
    rows = [r.asDict() for r in mixing.mix(docs).collect()]
    again = [r.asDict() for r in mixing.mix(docs.repartition(2)).collect()]
    assert sorted(map(str, rows)) == sorted(map(str, again)) and all(r["size"] == len(words_of(r["text"])) and 0 <= r["copies"] <= 3 for r in rows)
    total = collections.Counter()
    for r in rows:
        total[r["source"]] += r["size"]
    order = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, open_ = {}, set(order)
    while True:
        left = sum(total.values()) - sum(3 * total[s] for s in order if s not in open_)
        target = {s: left * weight[s] / sum(weight[x] for x in open_) if s in open_ else 3 * total[s] for s in order}
        over = {s for s in open_ if target[s] > 3 * total[s]}
        if not over:
            break
        open_ -= over
    for s in order:
        own = [r for r in rows if r["source"] == s]
        assert all(r["target"] == pytest.approx(target[s]) and r["source_size"] == total[s] for r in own)
        assert abs(sum(r["size"] * r["copies"] for r in own) - target[s]) <= 0.5 * max(r["size"] for r in own) + 1
    assert mixing.mix(empty).count() == 0
    sized = collections.Counter((r["doc_id"], r["source"], r["size"], r["source_size"], round(r["target"], 6), r["copies"]) for r in mixing.mix_sizes(docs).collect())
    assert sized == collections.Counter((r["doc_id"], r["source"], r["size"], r["source_size"], round(r["target"], 6), r["copies"]) for r in rows)


def test_mixing_comes_near_with_few_documents(spark):
    """Thirty documents a source: single copies of documents that fit close most of what rounding leaves."""
    r = random.Random(8)
    rows = [(i, "w " * r.randint(5, 900), f"s{i % 6}") for i in range(180)]
    got = mixing.mix_sizes(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    for s in {r["source"] for r in got}:
        own = [r for r in got if r["source"] == s]
        assert abs(sum(r["size"] * r["copies"] for r in own) - own[0]["target"]) <= 0.01 * own[0]["target"]
        assert all(0 <= r["copies"] <= 3 for r in own)


def test_scoring(docs, empty, monkeypatch):
    monkeypatch.setattr(scoring, "CODED_WORDS", 150)
    got = scoring.score(docs).collect()
    # In parts, a document's score is that of the whole but for where its chunks begin.
    monkeypatch.setattr(scoring, "PIECE_BYTES", 300)
    parts = {(r["doc_id"], r["n_tokens"]): r for r in scoring.score(docs).collect()}
    for r in got:
        p = parts[r["doc_id"], r["n_tokens"]]
        assert p["score"] == pytest.approx(r["score"], rel=1e-3) and (p["n_known"], p["train_tokens"], p["bits_per_byte"] > 0) == (r["n_known"], r["train_tokens"], True) and p["base_score"] == pytest.approx(r["base_score"])
    train = collections.Counter()
    for d, t, *_ in corpus():
        if zlib.crc32(("" if d is None else str(d)).encode()) % 7 != 2:
            train.update(words_of(ascii_lower(t)))
            train["\n"] += 1
    n, v = sum(train.values()), len(train)
    want = collections.Counter()
    for d, t, *_ in corpus():
        tokens = [*words_of(ascii_lower(t)), "\n"]
        want[(d, zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2, len(tokens), sum(train[x] > 0 for x in tokens), n, round(sum(math.log10((train[x] + 1) / (n + v + 1)) for x in tokens), 6))] += 1
    assert want == collections.Counter((*r[:5], round(r[5], 6)) for r in got)
    assert all(math.isfinite(r["score"]) and r["score"] < 0 and r["bits_per_byte"] > 0 for r in got)
    assert scoring.score(empty).count() == 0


def test_every_training_text_teaches_the_weights(spark, monkeypatch):
    """The decisions that the weights are fitted to are those of all training texts, not of a sample."""
    seen, learn = [], scoring._learn_weights

    def watched(sums):
        seen.append(sums.agg(F.sum("n")).first()[0])
        return learn(sums)

    monkeypatch.setattr(scoring, "_learn_weights", watched)
    rows = spark.createDataFrame([(i, "x") for i in range(64)], "doc_id long, text string")
    got = scoring.score(rows, F.col("doc_id") < 0).collect()
    # A word with a code and the end: as many decisions in each text.
    assert len(got) == 64 and seen[0] > 0 and seen[0] % 64 == 0 and seen[0] >= 2 * 64


def test_half_of_the_training_texts_teach_in_one_pass(spark, monkeypatch):
    """Words, slots and weights are learned from 64 texts by fewer than three passes over them, then they are scored."""
    read, apply = [], scoring.map_arrow

    def watched(df, run, schema):
        if "text" in df.columns:
            read.append(df.count())
        return apply(df, run, schema)

    monkeypatch.setattr(scoring, "map_arrow", watched)
    rows = spark.createDataFrame([(i, "x y") for i in range(64)], "doc_id long, text string")
    assert scoring.score(rows, F.col("doc_id") < 0).count() == 64
    assert read[0] == read[-1] == 64 and 64 < sum(read[1:-1]) < 2 * 64


def test_decisions_lie_by_depth_and_their_slots_in_fours():
    """By depth or in order of the text they are the same: the codes of the words; four of a code share 16 slots."""
    vocab = [f"w{i}" for i in range(60)]
    texts = [" ".join(vocab[: 60 - i]) for i in range(50)]
    codes, _ = model(texts)
    tried = ["w3 w17 W3", "", "w41"]
    data, offsets = np.frombuffer("".join(tried).encode(), np.uint8), np.cumsum([0, *(len(t) for t in tried)])
    piece, want, at = scoring.decisions(codes, data, offsets), "", []
    for t in tried:
        for w in [*words_of(ascii_lower(t)), None]:
            code, length = codes.end
            if w:
                h = scoring.hash_words(np.frombuffer(w.encode(), np.uint8), np.asarray([0]), np.asarray([len(w)]), lower=True)
                k = int(np.searchsorted(codes.hashes, h[0]))
                code, length = int(codes.code[k]), int(codes.length[k])
            at += [len(want) + d for d in range(0, length, 4) for _ in range(min(4, length - d))]
            want += f"{code:0{length}b}"
    assert "".join(map(str, piece.y.tolist())) == want and piece.of[-1] == len(want)
    assert all(s >> 4 == slots[i] >> 4 for slots in (v.tolist() for v in piece.slots) for s, i in zip(slots, at, strict=True))
    assert sum(piece.reach) == len(want) and piece.reach == sorted(piece.reach, reverse=True)


def test_model_grows_with_the_training_texts():
    """Every word met twice of those given has a code; slots and context words double as the tokens quadruple."""
    sizes = {}
    for words, each in ((1_000, 3), (70_000, 2), (70_000, 2_000)):
        h = scoring.mix(np.arange(1, words + 1, dtype=np.uint64))
        c = scoring.make_codes(h, np.full(words, each), 0, np.ones(256, np.int64), 10)
        assert (c.length > 0).all() and sum(2.0 ** -int(x) for x in c.length) < 1
        sizes[words, each] = (c.slot_bits, c.recent, c.before)
    assert sizes[1_000, 3] == sizes[70_000, 2] == (scoring.SLOT_BITS, scoring.RECENT, scoring.BEFORE)
    assert sizes[70_000, 2_000] == ((22, 22, 19), 512, 4096)
    assert [scoring.doublings(scoring.LEAST_TOKENS * 4**k) for k in range(6)] == list(range(6))


def test_slots_hold_counts():
    r = random.Random(6)
    zeros, ones = (np.asarray([r.choice([0, 1, 5, 64, 65, 1000, 10**6]) for _ in range(300)]) for _ in range(2))
    packed = scoring.pack_slots(zeros, ones)
    for z, o, v in zip(zeros.tolist(), ones.tolist(), packed.tolist(), strict=True):
        assert abs(scoring._ZEROS[v] - z) <= 0.1 * z and abs(scoring._ONES[v] - o) <= 0.1 * o and (z > 64 or scoring._ZEROS[v] == z)
        assert abs(scoring._LOGITS[v] - max(-8, min(8, math.log((o + 0.4) / (z + 0.4))))) < 0.2
    used = np.unique(np.asarray([0, 3, 300, 65535, *(r.randint(0, 65535) for _ in range(50))]))
    pairs = np.asarray([[r.choice([0, 1, 254, 255, 256, 10**6]), 1] for _ in used])
    at, counts = scoring._unsqueezed(scoring._squeezed(used, pairs))
    assert at.tolist() == used.tolist() and counts.tolist() == pairs.tolist()


def model(texts):
    """Codes and slots of a few texts, without Spark."""
    data, offsets = np.frombuffer("".join(texts).encode(), np.uint8), np.cumsum([0, *(len(t.encode()) for t in texts)])
    starts, ends, _ = scoring.find_words(data, offsets)
    h, n = np.unique(scoring.hash_words(data, starts, ends, lower=True), return_counts=True)
    codes = scoring.make_codes(h, n, 0, np.bincount(scoring._LOWER[data], minlength=256), len(texts))
    slots = []
    for k, s in enumerate(scoring.decisions(codes, data, offsets).slots):
        seen = np.zeros((1 << codes.slot_bits[k], 2), np.int64)
        np.add.at(seen, (s, scoring.decisions(codes, data, offsets).y), 1)
        slots.append(scoring.pack_slots(seen[:, 0], seen[:, 1]))
    return codes, slots


def test_scores_equal_a_loop_over_decisions():
    """One decision at a time: logits from counts, gate, weights, and a step by what the document decided before its chunk."""
    r = random.Random(9)
    vocab = [f"w{i}" for i in range(60)]
    texts = [" ".join(r.choice(vocab) for _ in range(r.randint(0, 120))) + ("." if i % 2 else "") for i in range(12)]
    codes, slots = model(texts)
    weights = np.random.default_rng(1).uniform(0.1, 0.6, (16, 3))
    tried = [*texts[:4], "w1 unseen w2, w3 w59 " * 9, "", "éé ü"]
    data, offsets = np.frombuffer("".join(tried).encode(), np.uint8), np.cumsum([0, *(len(t.encode()) for t in tried)])
    piece = scoring.decisions(codes, data, offsets)
    got = scoring.mixed_log10(piece, slots, weights)
    chunk = 1 << scoring.CHUNK_SHIFT
    for d in range(len(tried)):
        total, slope, bend = 0.0, np.zeros((16, 3)), np.zeros((16, 3))
        lo, hi = int(piece.of[d]), int(piece.of[d + 1])
        for begin in range(lo, hi, chunk):
            shift, late = slope / (bend + scoring.DAMPING), []
            for i in range(begin, min(begin + chunk, hi)):
                v = [int(slots[k][piece.slots[k][i]]) for k in range(3)]
                gate = 0
                for x in v[:2]:
                    seen = float(scoring._ZEROS[x] + scoring._ONES[x])
                    gate = 4 * gate + (seen > 0) + (seen >= 4) + (seen >= 32)
                x = np.asarray([max(-8, min(8, math.log((scoring._ONES[s] + 0.4) / (scoring._ZEROS[s] + 0.4)))) for s in v])
                sign = 1 if piece.y[i] else -1
                total -= math.log10(1 + math.exp(-sign * max(-8, min(8, (weights[gate] + shift[gate]) @ x))))
                wrong = 1 / (1 + math.exp(sign * (weights[gate] @ x)))
                late.append((gate, sign * wrong * x, wrong * (1 - wrong) * abs(x) * abs(x).sum()))
            for gate, g, b in late:
                slope[gate] += g
                bend[gate] += b
        assert got[d] == pytest.approx(total, rel=1e-4, abs=1e-4)


def test_codes_are_a_distribution():
    """Scores of all texts of one piece sum to one: the decisions of a code tree do."""
    code, length = scoring.huffman(np.asarray([50, 20, 20, 5, 3, 1, 1]))
    assert sum(2.0 ** -int(x) for x in length) == 1 and len({(int(c), int(n)) for c, n in zip(code, length, strict=True)}) == 7
    words = [f"{c:0{n}b}" for c, n in zip(code.tolist(), length.tolist(), strict=True)]
    assert not any(a != b and b.startswith(a) for a in words for b in words)


def test_fingerprints(docs, empty, monkeypatch):
    monkeypatch.setattr(fingerprint, "BUCKET_ROWS", 7)
    rows = [(d, t or "") for d, t, *_ in corpus() if d is not None]
    order = sorted(set(rows), key=lambda x: (-x[0], x[1]))
    got = {r["doc_id"]: r for r in fingerprint.edit_report(docs.where("doc_id is not null").dropDuplicates(["doc_id"])).collect()}
    same = collections.defaultdict(set)
    for (d, a), (_, b) in zip(order, order[1:] + order[:1], strict=True):
        half = len(a) // 2
        edited = a[: len(a) - half] + b[:half]
        r = got[d]
        assert r["n_chars"] == len(a) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        same[a].add(r["fingerprint"])
    assert all(len(x) == 1 for x in same.values())
    assert sum(got[d]["near_edited"] > got[d]["near_next"] for d in range(8, 70)) > 50
    assert fingerprint.edit_report(empty).count() == 0 and fingerprint.edit_report(docs).count() == len(corpus())


def test_signatures_are_the_two_least_of_all(spark):
    """Every seed selects from all numbered k-mers of the text, and a short text's signatures keep the order."""
    texts = ["", " \t", "one", "one two", "a b c", " ".join("a b c d".split() * 5), " ".join(f"w{i * i % 31}" for i in range(40)), "x y z x y z", " ".join(f"v{i * 7919 % 5003}" for i in range(3000))]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {r["id"]: r["fingerprint"] for r in fingerprint.fingerprints(docs).collect()}
    shift, each = fingerprint.POSITION_BITS, fingerprint.SEEDS // fingerprint.CIRCLES
    # Row by row: numbered k-mers and their hashes, without arrays.
    rows = [(i, at, *(w + [None] * 3)[:3]) for i, t in enumerate(texts) for w0 in [words_of(t)] for at in range(max(len(w0) - 2, min(len(w0), 1))) for w in [w0[at : at + 3]]]
    flat = spark.createDataFrame(rows, "id long, at int, a string, b string, c string").withColumns({x: F.when(F.col(x).isNotNull(), F.xxhash64(x)) for x in "abc"})
    flat = flat.withColumn("kmer", F.shiftright(F.xxhash64("a", "b", "c"), shift)).withColumn("nth", F.row_number().over(Window.partitionBy("id", "kmer").orderBy("at")))
    flat = flat.select("id", "at", *(F.shiftright(F.xxhash64("kmer", "nth", F.lit(r)), shift).alias(f"p{r}") for r in range(fingerprint.CIRCLES)))
    own = collections.defaultdict(list)
    for x in flat.collect():
        own[x["id"]].append(x)
    pairs, want = [], collections.defaultdict(list)
    for i, found in own.items():
        for seed in range(fingerprint.SEEDS):
            r, start = seed // each, fingerprint.starting_point(seed)
            order = sorted(found, key=lambda x: (((x[f"p{r}"] << shift | x["at"]) - start) % (1 << 64)))
            two = sorted((order * 2)[:2] if len(order) > 1 else order * 2, key=lambda x: x["at"])
            pairs.append((i, seed, two[0][f"p{r}"], two[1][f"p{r}"]))
    for x in spark.createDataFrame(pairs, "id long, seed long, x long, y long").withColumn("h", F.xxhash64("x", "y").bitwiseAND(F.lit(fingerprint.SIGNATURE))).orderBy("id", "seed").collect():
        want[x["id"]].append(x["seed"] << 24 | x["h"])
    assert got == {i: want.get(i, []) for i in range(len(texts))} and len(want) == len(texts) - 2
    # Likeness is the part of the seeds that agree.
    two = spark.createDataFrame([(got[6], got[7], got[0])], "a array<long>, b array<long>, c array<long>").select(*(fingerprint.likeness(x, y) for x, y in ("ab", "aa", "ac", "cc"))).first()
    assert tuple(two) == (len(set(got[6]) & set(got[7])) / fingerprint.SEEDS, 1.0, 0.0, 1.0)
    # Halves that change places: nearly all k-mers stay, about half of the pairs are turned round.
    r = random.Random(2)
    halves = [[" ".join(str(r.random()) for _ in range(25)) for _ in range(2)] for _ in range(60)]
    swapped = spark.createDataFrame([(f"{a} {b}", f"{b} {a}") for a, b in halves], "a string, b string")
    swapped = fingerprint.fingerprints(fingerprint.fingerprints(swapped, "a", "f"), "b", "g")
    assert 0.3 < swapped.agg(F.avg(fingerprint.likeness("f", "g"))).first()[0] < 0.6


def test_bloom(spark):
    keys = spark.range(0, 3000).select((F.col("id") * 7919).alias("k"))
    f = bloom.build(keys)
    assert f.has(np.arange(3000, dtype=np.int64) * 7919).all() and f.has(np.arange(3000, dtype=np.int64) * 7919 + 1).mean() < 0.05
    assert not bloom.build(keys.limit(0)).has(np.arange(10, dtype=np.int64)).any()
    rows = spark.createDataFrame([(i, f"r{i}") for i in range(500)] + [(None, "null"), (7919, "again")], "k long, _filtered string")
    for most in (bloom.BROADCAST_KEYS, 10):
        left = bloom.without(rows, "k", keys, most)
        assert left.columns == rows.columns and sorted(map(str, (tuple(r) for r in left.collect()))) == sorted(map(str, [(i, f"r{i}") for i in range(1, 500)] + [(None, "null")]))


def test_tool_calls(spark, tmp_path):
    calls = [
        ("c", 1, "a", "f", '{"y": 1.5, "x":"é\\"", "o":{"z":1,"b":[2,1]}}', ["b"]), ("c", 2, "b", "f", '{"x":1}', ["zz", None]), ("c", 3, "d", "g", "{}", ["a", "b"]), ("c", 4, "e", "f", "oops", ["f"]), ("c", 5, "f", "f", "[1]", ["e"]),
        (None, 6, "a", "f", None, None), ("d", 1, "a", None, '{"x":"s"}', []), ("d", 1, "a", None, '{"x":"s"}', []),
    ]
    results = [("c", "a", "ra"), ("c", "a", "rz"), ("c", "q", None), (None, "a", "n")]
    schemas = [("f", "x", "string", True), ("f", "y", "number", False), ("f", "o", "object", None)]
    got = {(r["conv_id"], r["call_id"], r["status"]): r for r in toolcalls.link(
        spark.createDataFrame(calls, "conv_id string, turn long, call_id string, name string, arguments string, depends_on array<string>"),
        spark.createDataFrame(results, "conv_id string, call_id string, content string"), spark.createDataFrame(schemas, "name string, field string, type string, required boolean")).collect()}
    assert json.loads(got["c", "a", "ok"]["json"]) == {"arguments": {"o": {"b": [2, 1], "z": 1}, "x": 'é"', "y": 1.5}, "id": "a", "name": "f", "result": "ra"}
    assert got["c", "a", "ok"]["json"].startswith('{"arguments":{"o":{"b":[2,1],"z":1},"x"') and got["c", "a", "ok"]["args_valid"] and got["c", "a", "ok"]["level"] == 1
    assert got["c", "b", "no_result"]["errors"] == "type:x" and got["c", "b", "no_result"]["level"] == 0 and got["c", "d", "no_result"]["level"] == 2 and got["c", "d", "no_result"]["errors"] == "tool"
    assert got["c", "e", "cycle"]["errors"] == "json" and ("c", "f", "cycle") in got and ("c", "q", "orphan_result") in got and (None, "a", "orphan_result") in got and (None, "a", "no_result") in got
    assert len(got) == 11 and json.loads(got["c", "f", "cycle"]["json"])["arguments"] == [1] and json.loads(got["c", "e", "cycle"]["json"])["arguments"] == "oops"
    assert ("d", "a", "repeated_call") in got and json.loads(got["c", "a", "repeated_result"]["json"])["result"] == "rz"
    twice = spark.createDataFrame([("c", 1, "a", "f", '{"x":"1","x":"2"}', None)], "conv_id string, turn long, call_id string, name string, arguments string, depends_on array<string>")
    row = toolcalls.link(twice, spark.createDataFrame([], "conv_id string, call_id string, content string"), spark.createDataFrame(schemas, "name string, field string, type string, required boolean")).first()
    assert row["errors"] == "json" and json.loads(row["json"])["arguments"] == '{"x":"1","x":"2"}'


def kahn(deps):
    """Levels by Kahn's algorithm; what lies on or behind a cycle has none."""
    deps = {x: {d for d in on if d in deps} for x, on in deps.items()}
    level, ready = {}, [x for x, on in deps.items() if not on]
    open_ = {x: set(on) for x, on in deps.items()}
    while ready:
        x = ready.pop()
        level[x] = max((level[d] + 1 for d in deps[x]), default=0)
        for y, on in open_.items():
            if x in on:
                on.remove(x)
                if not on:
                    ready.append(y)
    return {x: level.get(x) for x in deps}


def test_levels_equal_kahns(spark):
    """A long chain, a wide and a deep graph, braided chains, cycles and what hangs on them, strays and nulls, many conversations."""
    r = random.Random(11)
    graphs = {
        "chain": {i: [i - 1] for i in range(500)},
        "braid": {i: [i - 2, *([i - 4] if i % 3 == 0 else [])] for i in range(1, 260, 2)},
        "wide": {i: r.sample(range(max(1, i)), min(i, r.randint(0, 3))) for i in range(60)} | {100 + i: [5] for i in range(200)} | {400: list(range(100, 300))},
        "complete": {i: list(range(i)) for i in range(9)},
        "cycle": {0: [1], 1: [2], 2: [0], 3: [2], 4: [3, 5], 5: [], 6: [6], 7: [5, 6], 8: [4, 4], 9: [99, None]},
        "tree": {i: [(i - 1) // 2] for i in range(64)},
    }
    rows = [(c, str(x), [None if d is None else str(d) for d in on]) for c, g in graphs.items() for x, on in g.items()]
    got = {(x["conv_id"], int(x["call_id"])): x["level"] for x in toolcalls.topological_levels(spark.createDataFrame(rows, "conv_id string, call_id string, depends_on array<string>")).collect()}
    assert got == {(c, x): n for c, g in graphs.items() for x, n in kahn({x: [d for d in on if d is not None] for x, on in g.items()}).items()}
    assert toolcalls.topological_levels(spark.createDataFrame([], "conv_id string, call_id string, depends_on array<string>")).count() == 0


def test_whole_conversations(spark, tmp_path):
    """Every row's whole text is in one json, repeated rows as often as they occur."""
    long = "An answer of more than twenty characters, \"quoted\"\n\u00e9 " * 900
    rows = [(1, 0, "system", "Rules " * 9), (1, 0, "user", "Opening " * 9), (1, 1, "assistant", long * 3), (1, 2, "user", "reply"), (1, 3, "assistant", long + "b"), (1, 3, "assistant", long + "a"), (1, 3, "assistant", long + "a"),
            (1, 4, "user", "second"), (1, 4, "user", "other"), (2, 5, "user", "orphan"), (2, 6, "tool", "odd role"), (2, None, "user", "no turn"), (2, None, "assistant", "no turn"), (None, 1, "assistant", long), (None, 1, None, "no role"), (3, 1, "assistant", None)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    out = [(r["status"], json.loads(r["json"])) for r in queries.queries()["op4_chat_formatting"](spark, str(tmp_path)).collect()]
    found = collections.Counter(x for _, j in out for x in ((j.get("arguments") or {}).get("query"), j.get("result"), j.get("content")) if x is not None)
    assert found == collections.Counter(t or "" for *_, t in rows)
    assert collections.Counter(j["role"] for status, j in out if status == "message") == {"system": 1, "user": 2, "tool": 1, None: 1}
    assert collections.Counter(status for status, _ in out) == {"message": 5, "ok": 2, "repeated_call": 2, "repeated_result": 1, "orphan_result": 1, "no_result": 3}
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert toolcalls.format_conversations(empty).count() == 0


def test_url_intervals(spark):
    day = "2024-01-{:02d}".format
    entries = [("l", "block", "domain", "x.org", True, 2), ("l", "block", "domain", "x.org", True, 3), ("l", "block", "domain", "x.org", False, 5), ("l", "block", "domain", "x.org", True, 9), ("t", "allow", "host", "ok.x.org", True, 4), ("u", "block", "url", "ok.x.org/a", True, 4), ("l", "block", "domain", None, True, 1)]
    captures = [(1, "http://a.x.org/", 1), (2, "http://a.x.org/", 4), (3, "https://u@A.X.org:80/?q", 5), (4, "http://x.org", 9), (5, "http://ok.x.org/b", 9), (6, "http://ok.x.org/a/b#c", 9), (7, "http://notx.org/", 9), (8, None, 9), (9, "junk", 9), (10, "http://x.org", None)]
    e = spark.createDataFrame([(*x[:5], day(x[5])) for x in entries], "list string, verdict string, kind string, pattern string, added boolean, day string").withColumn("day", F.to_date("day"))
    c = spark.createDataFrame([(i, u, day(d) if d else None) for i, u, d in captures], "capture_id long, url string, d string").withColumn("fetched_on", F.to_date("d")).drop("d")
    for most in (urlfilter.BROADCAST_INTERVALS, 0):
        urlfilter.BROADCAST_INTERVALS, old = most, urlfilter.BROADCAST_INTERVALS
        got = {r["capture_id"]: r for r in urlfilter.judge(c, e).collect()}
        urlfilter.BROADCAST_INTERVALS = old
        assert {i for i, r in got.items() if r["blocked"]} == {2, 4, 6} and len(got) == 10
        assert got[5]["rule"] == "allow:t:host:ok.x.org" and (got[5]["n_block"], got[5]["n_allow"]) == (1, 1) and got[6]["rule"] == "block:u:url:ok.x.org/a" and got[3]["host"] == "a.x.org"


def test_queries_match_their_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("pages", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    for name, sql in queries.oracle_sql().items():
        want, got = con.sql(sql), queries.queries()[name](spark, sf)
        at = sorted(got.columns)
        assert at == sorted(want.columns)
        rows = [[str(r[want.columns.index(c)]) for c in at] for r in want.fetchall()]
        assert sorted(rows) == sorted([str(r[c]) for c in at] for r in got.collect()), name


def test_pipeline(spark, tmp_path, docs):
    import corpus_pipeline

    docs.drop("score").write.parquet(str(tmp_path / "documents.parquet"))
    seen, at = [], spark.read.parquet(str(tmp_path / "documents.parquet"))
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, at, str(tmp_path)).write.parquet(str(tmp_path / f"s{i}"))
        after = spark.read.parquet(str(tmp_path / f"s{i}"))
        seen.append((name, at, after))
        assert i == 4 or after.columns == at.columns
        at = after
    assert [x[0] for x in seen] == ["language_id", "ngram_jaccard_join", "substring_dedup", "mixing", "best_fit_packing"]
    _, before, after = seen[1]
    kept = {r["doc_id"]: shingles(r["text"], 5) for r in after.collect() if r["doc_id"] is not None}
    assert not any(a < b and 100 * len(x & y) >= 80 * len(x | y) for a, x in kept.items() for b, y in kept.items())
    assert after.where("doc_id is not null").count() == len(kept) < before.count()
    assert sum(len(words_of(r["text"])) for r in seen[2][2].collect()) < sum(len(words_of(r["text"])) for r in seen[2][1].collect())
    assert at.count() > 0 and len({(r["sequence_id"], r["offset"]) for r in at.collect()}) == at.count()


AWKWARD = ("score", "lang_pred", "n_words", "n_removed", "kept_text", "kept", "size", "copies", "target", "source_size", "_total", "_size", "_null", "_source", "_doc", "_key", "_spans", "_text_hash", "_text_bytes", "_text", "_own", "_bucket", "_packed", "host", "component_id", "n", "rep", "held_out")


def test_own_columns_stay(spark, docs):
    """No operator replaces a column of the caller's that it does not say it replaces, or stumbles over its name."""
    named = docs.where("doc_id is not null").dropDuplicates(["doc_id"]).drop("score").withColumns({c: F.concat(F.lit(f"{c}-"), F.col("doc_id")) for c in AWKWARD})
    plain = named.drop(*AWKWARD)

    def same(got, replaced=()):
        rows = got.collect()
        for row in rows:
            assert all(row[c] == f"{c}-{row['doc_id']}" for c in AWKWARD if c not in replaced)
        return collections.Counter(tuple(row[c] for c in plain.columns) for row in rows)

    for stage in (langid.accept, substring.clean, mixing.repeat, repetition.filter_repetitive):
        assert stage(named).columns == named.columns
        assert same(stage(named)) == collections.Counter(tuple(x) for x in stage(plain).select(*plain.columns).collect()), stage.__name__
    same(substring.dedup(named), ("n_words", "n_removed", "kept_text"))
    same(mixing.mix(named), ("size", "source_size", "target", "copies"))
    same(langid.predict(named, *langid.train(named)), ("lang_pred", "score"))
    same(repetition.assess(named), ("n_words", "kept"))
    same(fingerprint.fingerprints(named))
    for op in (lambda d: jaccard.link(d), lambda d: packing.pack(d), lambda d: scoring.score(d), lambda d: langid.identify(d), fingerprint.edit_report, mixing.mix_sizes):
        assert collections.Counter(map(str, op(named).drop("sequence_id", "offset").collect())) == collections.Counter(map(str, op(plain).drop("sequence_id", "offset").collect()))


def test_captures_keep_their_columns_and_repeats(spark):
    entries = spark.createDataFrame([("l", "block", "domain", "x.org", True, "2024-01-02")], "list string, verdict string, kind string, pattern string, added boolean, day string").withColumn("day", F.to_date("day"))
    rows = [(1, "http://a.x.org/", "2024-01-03", "own")] * 2 + [(1, "http://other.net/", "2024-01-03", "own"), (None, "http://x.org", "2024-01-03", "own"), (None, None, None, "own")]
    captures = spark.createDataFrame(rows, "capture_id long, url string, d string, host string").withColumn("fetched_on", F.to_date("d")).withColumns({c: F.lit(f"{c}!") for c in ("kind", "pattern", "k", "_best", "_salt", "depth", "verdict", "n")})
    got = urlfilter.judge(captures, entries).collect()
    assert len(got) == 5 and all(x[c] == f"{c}!" for x in got for c in ("kind", "pattern", "k", "_best", "_salt", "depth", "verdict", "n"))
    assert sorted((x["url"] or "", x["n_block"], x["blocked"]) for x in got) == [("", 0, False), ("http://a.x.org/", 1, True), ("http://a.x.org/", 1, True), ("http://other.net/", 0, False), ("http://x.org", 1, True)]
    assert urlfilter.judge(captures.limit(0), entries.limit(0)).count() == 0 and {x["n_block"] for x in urlfilter.judge(captures, entries.limit(0)).collect()} == {0}


def test_run_equals_brute_force(spark, tmp_path):
    """run() over documents without repeated doc_ids: who stays, what is left of the texts and every piece
    are exact; copies meet the targets, and sequences are full but for little."""
    import public_tokenizers
    from tokenizers import Tokenizer

    import corpus_pipeline

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = list({d: (d, text, lang, source, n) for d, text, lang, source, n, _ in corpus() if d is not None}.values())
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    kept = {d: (text, source) for d, text, _, source, _ in rows if any(map(str.isalpha, text or ""))}
    sets, to = {d: shingles(text, 5) for d, (text, _) in kept.items()}, {d: d for d in kept}
    for _ in sets:
        for a in sets:
            for b in sets:
                if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    to[a] = to[b] = min(to[a], to[b])
    kept = {d: x for d, x in kept.items() if to[d] == d}
    first, texts = {}, {}
    for d in sorted(kept):
        w = words_of(kept[d][0])
        for i in range(len(w) - 49):
            first.setdefault(tuple(w[i : i + 50]), d)
    for d, (text, source) in kept.items():
        w = words_of(text)
        gone = {j for i in range(len(w) - 49) if first[tuple(w[i : i + 50])] < d for j in range(i, i + 50)}
        if not gone or len(gone) < len(w):
            texts[d] = (" ".join(x for j, x in enumerate(w) if j not in gone) if gone else text, source)
    pieces = {}
    for d, (text, _) in texts.items():
        ids, at, pieces[d] = [*t.encode(text, add_special_tokens=False).ids, 2], 0, []
        n = (len(ids) - 1) % 1024 + 1
        while at < len(ids):
            pieces[d].append((len(pieces[d]), at, n, zlib.crc32(np.asarray(ids[at : at + n], "<u4").tobytes())))
            at, n = at + n, 1024
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    times = collections.Counter(r["doc_id"] for r in out if r["piece"] == 0)
    assert set(times) <= set(pieces) and max(times.values()) <= 3 and len(pieces) < len(rows)
    got = collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out)
    assert got == collections.Counter({(d, *p): n for d, n in times.items() for p in pieces[d]})
    size, total = {d: len(words_of(x)) for d, (x, _) in texts.items()}, collections.Counter()
    for d, (_, source) in texts.items():
        total[source] += size[d]
    order = sorted(total, key=lambda s: (s is None, s or ""))
    weight, open_ = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}, set(order)
    while True:
        left = sum(total.values()) - sum(3 * total[s] for s in order if s not in open_)
        target = {s: left * weight[s] / sum(weight[x] for x in open_) if s in open_ else 3 * total[s] for s in order}
        if not (over := {s for s in open_ if target[s] > 3 * total[s]}):
            break
        open_ -= over
    for s in order:
        assert abs(sum(times[d] * size[d] for d, (_, x) in texts.items() if x == s) - target[s]) <= 0.05 * target[s]
    bins = collections.defaultdict(list)
    for r in out:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for b in bins.values():
        b.sort()
        assert b[0][0] == 0 and all(x + n == y for (x, n), (y, _) in pairwise(b)) and sum(b[-1]) <= 1024
    assert len(bins) <= math.ceil(sum(r["length"] for r in out) / 1024) + 1
