"""The ten operators on small tables: hard cases, brute force, round trips and held-out accuracy."""

import os
import random
import time
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from glyphmill.llm import chat_windows, compact_windows, decontamination, fingerprints, groups, html_content, jaccard_join, language_id, queries, sentencepiece_codec, suffix_dedup, token_counts
from glyphmill.llm.arrays import WORD, Words, grams, large, sliding_min

SF = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
tokenizers = pytest.mark.skipif(not os.path.exists(sentencepiece_codec.MODEL), reason="no vocabularies")
LONG = " ".join(f"word{i % 997}" for i in range(60_000))

#: Null id, null text, empty, blank, no letter, repeated row, repeated id with another text, very long; columns with names that the operators use.
HARD = [(1, None), (None, "no id at all"), (2, ""), (3, " \n\t"), (4, "?! 12 %"), (5, "a b c d e f"), (5, "a b c d e f"), (6, "first text of six"), (6, "second text of six"), (7, LONG), (8, "é中文 \U0001f600 ▁x")]


@pytest.fixture(scope="module")
def hard(spark):
    df = spark.createDataFrame(HARD, "doc_id long, text string")
    return df.withColumns({c: F.lit(c) for c in ("key", "leader", "shard", "ids", "lang", "kept", "n", "bands", "source", "item_id")}).withColumn("n_chars", F.length("text").cast("long"))


@pytest.fixture(scope="module")
def empty(hard):
    return hard.where("false")


def words_of(text):
    import regex

    return regex.findall(WORD, text.lower())


def voc(n=400, seed=5):
    r = random.Random(seed)
    return ["".join(r.choice("bcdfgklmnprst") + r.choice("aeiou") for _ in range(r.randrange(1, 4))) for _ in range(n)]


def prose(r, n, words=voc()):
    return [r.choice(words) for _ in range(n)]


# ---- shared arrays


def test_words_agree_with_the_expression():
    texts = ["Hello, WORLD 12x", "", "é–ß naïve…end", "中文。字", "a b　c", "¡hola! \u0085x", LONG[:5000], "İstanbul ǅ"]
    for one in texts:
        w = Words(large(pa.array([one])))
        low = one.lower() if "İ" not in one else None
        got = [bytes(w.data[a:b]).decode() for a, b in zip(w.starts, w.ends)]
        if low is not None:
            assert got == words_of(one)
    together = Words(large(pa.array(texts)))
    assert len(together) == sum(len(Words(large(pa.array([t])))) for t in texts)
    assert grams(together.hashes, 3).shape[0] == len(together) - 2
    x = np.random.default_rng(0).integers(0, 99, 50)
    for k in (1, 2, 3, 7, 50):
        assert sliding_min(x, k).tolist() == [x[i : i + k].min() for i in range(len(x) - k + 1)]


def test_components(spark):
    edges = [(1, 2), (2, 3), (7, 8), (9, 8), (5, 5), (3, 1)] + [(20 + i, 21 + i) for i in range(40)]
    got = {r.doc_id: r.group_id for r in groups.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {k: v for k, v in got.items() if k < 20} in ({2: 1, 3: 1, 8: 7, 9: 7}, {1: 1, 2: 1, 3: 1, 7: 7, 8: 7, 9: 7})
    assert {v for k, v in got.items() if k >= 20} == {20}
    assert groups.components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- 1: suffix arrays


def test_suffix_array_and_common_prefixes():
    r = np.random.default_rng(1)
    for x in ([], [3], [1, 1, 1, 1], *(r.integers(0, k, 60).tolist() for k in (1, 2, 5, 50))):
        order = suffix_dedup.suffix_array(np.array(x, np.int64))
        assert order.tolist() == sorted(range(len(x)), key=lambda i: x[i:])
        if x:
            lcp = suffix_dedup.common_prefixes(np.array(x), order)
            for k in range(1, len(x)):
                a, b = x[order[k - 1] :], x[order[k] :]
                same = next((i for i, (p, q) in enumerate(zip(a, b)) if p != q), min(len(a), len(b)))
                assert lcp[k] == same


def brute_spans(docs, length):
    where = {}
    for i, t in docs:
        w = words_of(t or "")
        for k in range(len(w) - length + 1):
            where.setdefault(tuple(w[k : k + length]), []).append((i, k))
    marks = {}
    for found in where.values():
        low = min(i for i, _ in found)
        if any(i != low for i, _ in found):
            for i, k in found:
                marks.setdefault((i, i == low), set()).add(k)
    out = set()
    for (i, first), ks in marks.items():
        start = last = None
        for k in sorted(ks):
            if last is None or k > last + length:
                if last is not None:
                    out.add((i, start, last + length, first))
                start = k
            last = k
        out.add((i, start, last + length, first))
    return out


@pytest.mark.parametrize("shard_words, shard_anchors", [(suffix_dedup.SHARD_WORDS, suffix_dedup.SHARD_ANCHORS), (50, 6)])
def test_repeats_against_brute_force(spark, shard_words, shard_anchors):
    r = random.Random(2)
    shared = [prose(r, n) for n in (9, 12, 15, 30)]
    docs = []
    for i in range(60):
        t = prose(r, r.randrange(0, 20))
        for _ in range(r.randrange(3)):
            t += r.choice(shared) + prose(r, r.randrange(0, 6))
        docs.append((i, " ".join(t)))
    docs += [(60, "x y z " * 20), (61, "x y z " * 9)]
    got = suffix_dedup.repeats(spark.createDataFrame(docs, "doc_id long, text string"), 10, shard_words, shard_anchors).collect()
    assert {tuple(x) for x in got} == brute_spans(docs, 10) and len(got) == len(set(got))


def test_repeats_hard_cases(hard, empty):
    got = suffix_dedup.repeats(hard.union(hard.where("doc_id = 7").withColumn("doc_id", F.lit(70).cast("long"))), 5)
    assert {(r.doc_id, r.is_first) for r in got.collect()} == {(7, True), (70, False)}
    assert suffix_dedup.repeats(empty).count() == 0


def test_suffix_dedup_stage(spark, hard, empty):
    r = random.Random(4)
    p = " ".join(prose(r, 60))
    docs = spark.createDataFrame([(1, f"Alone. {p} Before, end."), (2, f"Another: {p}! Then more."), (3, p), (4, "short"), (5, None)], "doc_id long, text string").withColumns({"lang": F.lit("x"), "n_chars": F.length("text")})
    got = {x.doc_id: x for x in suffix_dedup.stage(spark, docs, "").collect()}
    assert set(got) == {1, 2, 4, 5}
    assert p in got[1].text and p not in got[2].text and got[2].text.startswith("Another: ") and got[2].text.endswith("Then more.") and got[2].n_chars == len(got[2].text)
    assert suffix_dedup.stage(spark, hard, "").columns == hard.columns and suffix_dedup.stage(spark, hard, "").count() == len(HARD)
    assert suffix_dedup.stage(spark, empty, "").count() == 0


# ---- 2: language


@tables
def test_language_accuracy_on_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    train, test = docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1")
    model = language_id.fit(train)
    assert set(model.families) == {"germanic", "romance"}
    rows = language_id.language_id(test, model).join(test.select("doc_id", F.col("lang").alias("truth")), "doc_id").where("kept").collect()
    assert np.mean([x.lang == x.truth for x in rows]) > 0.95
    assert all(language_id.family_of(x.lang) == x.family for x in rows)


def test_language_hard_cases(spark, hard, empty):
    train = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate([("the cat and the dog", "en"), ("der hund und die katze", "de"), ("le chat et le chien", "fr"), ("el gato y el perro", "es")] * 5)], "doc_id long, text string, lang string")
    model = language_id.fit(train)
    rows = language_id.language_id(hard, model).collect()
    assert len(rows) == len(HARD)
    by = {}
    for x in rows:
        by.setdefault(x.doc_id, []).append((x.lang, x.kept))
    assert by[1] == by[2] == by[3] == [("und", False)] and by[5][0] == by[5][1] and by[5][0][1] and by[4] == [("und", False)]
    assert language_id.language_id(train, model).where("lang = 'de'").count() == 5
    nothing = language_id.fit(empty.select("doc_id", "text", "lang"))
    assert not any(x.kept for x in language_id.language_id(hard, nothing).collect())
    assert language_id.language_id(empty, model).count() == 0
    one = language_id.fit(train.where("lang = 'en'"))
    assert {x.lang for x in language_id.language_id(train.where("lang = 'en'"), one).collect()} == {"en"}
    kept = language_id.stage(spark, hard, "")
    assert kept.columns == hard.columns


@tables
def test_texts_of_unknown_languages_are_rejected(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language_id.fit(docs)
    r = random.Random(2)
    letters = lambda alphabet: " ".join("".join(r.choice(alphabet) for _ in range(r.randrange(2, 9))) for _ in range(300))
    strange = [(1, letters("бвгджзклмнопрстаеиоу")), (2, letters("bcdfghjklmnpqrstvwxz")), (3, letters("的一是不了人我在有他"))]
    assert not any(x.kept or x.lang != "und" for x in language_id.language_id(spark.createDataFrame(strange, "doc_id long, text string"), model).collect())
    assert language_id.language_id(docs, model).where("not kept").count() <= 0.02 * docs.count()


@tables
def test_votes_and_margins_against_brute_force(spark):
    docs = pq.read_table(f"{SF}/documents.parquet").slice(0, 60)
    model = language_id.train(docs["text"], docs["lang"].to_pylist())
    x, _, trigrams = language_id.features(large(docs["text"]))
    for row, (i, text) in enumerate(zip(docs["doc_id"].to_pylist(), docs["text"].to_pylist())):
        data = "".join(" " if b < 128 and not chr(b).isalpha() else chr(b) for b in text.lower().encode()) if text.isascii() else None
        if data is None:
            continue
        padded, counts, n = f" {data} ", Counter(), 0
        for k, c in enumerate(data):
            if c != " ":
                a, b, d = (ord(z) for z in padded[k : k + 3])
                counts[((a * 961 + b) * 961 + d) * 0x9E3779B1 >> 13 & language_id.BUCKETS - 1] += 1
                n += 1
        assert trigrams[row] == n and all(abs(x[row, b] - c / n) < 1e-6 for b, c in counts.items()) and abs(x[row].sum() - 1) < 1e-4
    family, lang, margin = model.predict(x)

    def winner(level, names, row):
        score = {n: [] for n in names}
        for k, (own, a, b) in enumerate(model.pairs):
            if own == level:
                s = float(np.float32(x[row] @ model.weights[k] + model.bias[k]))
                score[a].append(s), score[b].append(-s)
        votes = {n: sum((s > 0) + np.tanh(s) * 1e-3 for s in v) for n, v in score.items()}
        best = max(names, key=lambda n: votes[n])
        return best, min(score[best], default=1e9)

    for row in range(len(x)):
        f, m = winner("", model.families, row)
        own, m2 = winner(f, model.langs[f], row)
        assert (family[row], lang[row]) == (f, own) and abs(margin[row] - min(m, m2)) < 1e-3


# ---- 3: syncmers


def test_syncmers_against_brute_force():
    texts = ["abcabcabcabcabc", "", "ab", "Ünïcode text that is long enough to have some", "aaaaaaaaaaaaaaaaaaaa", "x" * 7]
    k, s = 7, 3
    at, hashes, counts = fingerprints.syncmers(large(pa.array(texts)), k, s)
    i = 0
    for t, n in zip(texts, counts):
        low = t.lower()
        inner = [int(fingerprints.substrings(np.array([ord(c) for c in low[p : p + s]], np.uint32), s)[0]) for p in range(len(low) - s + 1)]
        want = [p for p in range(len(low) - k + 1) if min(inner[p : p + k - s + 1]) in (inner[p], inner[p + k - s])]
        assert at[i : i + n].tolist() == want
        i += n


def test_fingerprints_are_free_of_context(spark, hard, empty):
    r = random.Random(9)
    p = " ".join(prose(r, 60))
    df = spark.createDataFrame([(1, f"{' '.join(prose(r, 9))} {p} x"), (2, f"a {p} {' '.join(prose(r, 20))}"), (3, " ".join(prose(r, 50)))], "doc_id long, text string")
    prints = fingerprints.fingerprints(df)
    (match,) = fingerprints.positional_matches(prints).collect()
    text = {x.doc_id: x.text for x in df.collect()}
    assert (match.doc_a, match.doc_b) == (1, 2) and match.shift == text[1].index(p) - text[2].index(p) and match.n_anchors > 3
    rows = fingerprints.fingerprints(hard).collect()
    assert len(rows) == len(HARD) and all(len(x.positions) == len(x.anchors) for x in rows) and all(not x.anchors for x in rows if x.doc_id in (1, 2, 3, 4, 5))
    assert fingerprints.fingerprints(empty).count() == 0
    with pytest.raises(ValueError):
        fingerprints.fingerprints(df, 3, 5)


# ---- 4 and 5: tokens


@tokenizers
def test_token_counts(spark, hard, empty):
    enc = token_counts.encoding(token_counts.VOCABULARY)
    rows = token_counts.token_counts(hard, piece_chars=50, batch_bytes=1000).collect()
    got = Counter((x.doc_id, x.n_tokens) for x in rows)
    assert got == Counter((i, None if t is None else len(enc.encode_ordinary(t))) for i, t in HARD)
    assert token_counts.token_counts(empty).count() == 0
    texts = ["é" * 400, "a b" * 300, None, "", *(" ".join(prose(random.Random(k), 40)) for k in range(30))]
    assert token_counts.counted(texts, token_counts.VOCABULARY, 100, 500) == [None if t is None else len(enc.encode_ordinary(t)) for t in texts]
    r = random.Random(3)
    for _ in range(200):  # cuts change nothing
        t = "".join(r.choice(" \n\tab'sé1.\x1c\x85中") for _ in range(r.randrange(60)))
        assert sum(len(enc.encode_ordinary(p)) for p in token_counts.pieces(t, 5)) == len(enc.encode_ordinary(t)), repr(t)
        assert "".join(token_counts.pieces(t, 5)) == t


@tokenizers
def test_sentencepiece_against_the_library(spark, hard, empty):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.MODEL)
    v = sentencepiece_codec.vocabulary(sentencepiece_codec.MODEL)
    r = random.Random(7)
    letters = "ab  thein\n.éß中文字\U0001f600\0\t 1\"-"
    pieces = list(v.ids)
    texts = ["".join(r.choice(letters) for _ in range(r.randrange(40))) for _ in range(400)] + ["".join(r.choice(pieces) for _ in range(r.randrange(9))) for _ in range(400)]
    texts += [" " * k + x for k in range(40) for x in ("", "a", "中", "\n")] + ["x" * 700, "abc" * 300 + "é" * 100, " " * 9000, LONG]
    encoder = sentencepiece_codec.Encoder(sentencepiece_codec.MODEL)
    got = [np.frombuffer(x, np.int32).tolist() for x in encoder.encode(texts)]
    want = sp.encode(texts)
    assert got == want
    for t, ids in zip(texts[::7] + texts[-3:-1], want[::7] + want[-3:-1]):
        assert [i for part in sentencepiece_codec.stream(" " + t if t else "", v) for i in part] == ids
    assert sentencepiece_codec.decode(pa.array(got, pa.list_(pa.int32())), v).to_pylist() == texts
    rows = sentencepiece_codec.codec(hard).collect()
    assert Counter((x.doc_id, x.decoded) for x in rows) == Counter(HARD)
    assert [x.ids for x in rows if x.doc_id == 1] == [None] and [x.ids for x in rows if x.doc_id == 2] == [[]]
    assert sentencepiece_codec.codec(empty).count() == 0


@tokenizers
def test_sentencepiece_streams_with_a_bounded_window():
    v = sentencepiece_codec.vocabulary(sentencepiece_codec.MODEL)
    fed = 0

    def chars():
        nonlocal fed
        for c in " " + "international" * 400:
            fed += 1
            yield c

    early = []
    for ids in sentencepiece_codec.stream(chars(), v):
        early.append((fed, sum(len(v.raw[i]) for i in ids)))
    done = 0
    for at, n in early[:-1]:
        done += n
        assert at - done < 20 * v.longest
    assert len(early) > 20


@tokenizers
def test_sentencepiece_holds_a_slice_of_a_batch():
    texts = ["the and of " * 9000, None, "", "é" * 9] * 30 + ["a b " * 200_000]
    got = list(sentencepiece_codec.coded(iter([pa.array(texts), pa.array([], pa.string()), pa.array(["x"])]), sentencepiece_codec.MODEL))
    assert [t for part, _, _ in got for t in part.to_pylist()] == [t for _, _, text in got for t in text.to_pylist()] == [*texts, "x"]
    assert [x for _, ids, _ in got for x in ids.to_pylist()] == sentencepiece_codec.encode(pa.array([*texts, "x"]), sentencepiece_codec.MODEL).to_pylist()
    assert len(got) > 6 and all(len(part) == len(ids) == len(text) and (len(part) == 1 or text.nbytes < 600_000) for part, ids, text in got)


@tokenizers
def test_unknown_ids_decode_to_nothing():
    v = sentencepiece_codec.vocabulary(sentencepiece_codec.MODEL)
    assert sentencepiece_codec.decode(pa.array([[1, 2, -5, 10**6], [], None, [v.byte[0xC3]]], pa.list_(pa.int32())), v).to_pylist() == ["", "", None, "�"]


# ---- 6: decontamination


def brute_leaks(docs, items):
    out = set()
    for i, t in docs:
        a = words_of(t)
        for j, u in items:
            b = words_of(u)
            size = min(decontamination.WINDOW, len(b))
            if len(b) < decontamination.LEAST:
                continue
            for p in range(len(a) - size + 1):
                for q in range(len(b) - size + 1):
                    if sum(x == y for x, y in zip(a[p : p + size], b[q : q + size])) >= decontamination.SHARE * size:
                        out.add((i, j))
    return out


def test_decontamination_against_brute_force(spark, hard, empty):
    r = random.Random(11)
    words = voc(3000, 6)
    items = [(j, " ".join(prose(r, r.randrange(4, 40), words))) for j in range(12)] + [(90, "two words"), (91, None), (None, "x y z a b")]
    docs = []
    for i in range(80):
        t = prose(r, r.randrange(0, 60), words)
        if r.random() < 0.6:
            b = items[r.randrange(12)][1].split()
            b = [r.choice(words) if r.random() < 0.08 else w for w in b]
            t = t + b + prose(r, 10, words)
        docs.append((i, " ".join(t)))
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(x.doc_id, x.item_id) for x in decontamination.contaminated(d, b).collect()}
    want = brute_leaks(docs, [x for x in items if x[0] is not None and x[1]])
    assert len(got & want) >= 0.95 * len(want) and want
    short = {j for j, t in items[:12] if len(t.split()) < decontamination.SHORT}
    assert {x for x in want if x[1] in short} <= got and short
    shuffled = {(x.doc_id, x.item_id) for x in decontamination.contaminated(d, b, small_bytes=0, bits=1 << 10).collect()}
    assert shuffled == got  # neither the way of joining nor the filter's size changes anything
    clean = {i for i, t in docs} - {i for i, _ in got}
    assert len(clean) > 20
    assert decontamination.contaminated(empty, b).count() == 0 and decontamination.contaminated(d, b.where("false")).count() == 0
    assert decontamination.contaminated(hard, spark.createDataFrame([(1, "b c d e")], "item_id long, text string")).select("doc_id").distinct().collect()[0][0] == 5


def test_short_items_are_found_whatever_may_differ(spark):
    r = random.Random(12)
    words = voc(3000, 6)
    items, docs = [], []
    for n in (4, 5, 8, 9, 11, 12, 13):
        item = prose(r, n, words)
        items.append((n, " ".join(item)))
        for other in combinations(range(n), int(n * (1 - decontamination.SHARE))):
            docs.append((n * 10_000 + len(docs), " ".join(["x", *("y" if k in other else w for k, w in enumerate(item)), "z"])))
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(x.doc_id, x.item_id) for x in decontamination.contaminated(d, b).collect()}
    assert got >= {(i, i // 10_000) for i, _ in docs}
    assert decontamination.contaminated(d, spark.createDataFrame([(1, "x")], "item_id long, text string"), least=1).count() == len(docs)


def test_very_long_items(spark):
    items = spark.createDataFrame([(1, LONG)], "item_id long, text string")
    words = LONG.split()
    docs = spark.createDataFrame([(1, " ".join(words[500:520])), (2, " ".join(words[59_990:])), (3, "nothing of it"), (4, LONG)], "doc_id long, text string")
    got = {x.doc_id: x.overlap for x in decontamination.contaminated(docs, items).collect()}
    assert got == {1: 1.0, 4: 1.0}  # ten words of the second are fewer than a window


# ---- 7: compact windows


def test_compact_windows_against_brute_force():
    r = random.Random(1)
    n, window, hashes = 2, 6, 3
    texts = [" ".join(prose(r, k, voc(30))) for k in (40, 5, 0, 25)] + ["a b a b a b a b a b a b"]
    c = compact_windows.Compact(large(pa.array(texts)), n, window, hashes)
    factor = np.random.Generator(np.random.PCG64(11)).integers(0, 2**63, hashes, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    got = set(zip(c.text.tolist(), c.order.tolist(), c.low.tolist(), c.centre.tolist(), c.high.tolist()))
    want = set()
    for i, t in enumerate(texts):
        g = grams(Words(large(pa.array([t]))).hashes, n)
        for k, f in enumerate(factor):
            x = (g * f).tolist()
            for m in range(len(x)):
                a, b = m, m
                while a > 0 and x[a - 1] > x[m]:
                    a -= 1
                while b + 1 < len(x) and x[b + 1] >= x[m]:
                    b += 1
                if b - a + 1 >= window:
                    want.add((i, k, a, m, b))
    assert got == want


def test_near_passages_recall_and_precision(spark, hard, empty):
    r = random.Random(3)
    words = voc(3000, 8)
    bases = [prose(r, r.randrange(60, 150), words) for _ in range(12)]
    docs = []
    for i in range(60):
        t = prose(r, r.randrange(0, 80), words)
        for _ in range(r.randrange(0, 3)):
            b, rate = list(r.choice(bases)), r.choice([0, 0.02, 0.05, 0.08])
            b = [r.choice(words) if r.random() < rate else w for w in b]
            if r.random() < 0.3:
                del b[len(b) // 2]
            t = t + b + prose(r, r.randrange(0, 40), words)
        docs.append((i, " ".join(t)))
    n, size = compact_windows.N, compact_windows.WINDOW
    hashed = [grams(Words(large(pa.array([t]))).hashes, n).tolist() if len(t.split()) >= n else [] for _, t in docs]
    sets = [[frozenset(g[k : k + size]) for k in range(len(g) - size + 1)] for g in hashed]
    want = [set() for _ in docs]
    for a in range(len(docs)):
        for b in range(a):
            if set(hashed[a]) & set(hashed[b]):
                for i, s in enumerate(sets[a]):
                    for j, u in enumerate(sets[b]):
                        k = len(s & u)
                        if k and k / (len(s) + len(u) - k) >= compact_windows.THRESHOLD:
                            want[a].update(range(i, i + size + n - 1))
                            want[b].update(range(j, j + size + n - 1))
    got = [set() for _ in docs]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    rows = compact_windows.near_passages(df).collect()
    for x in rows:
        assert x.n_links > 0 and x.jaccard >= compact_windows.THRESHOLD and x.class_id == x.doc_id and x.n_copies == 1
        got[x.doc_id].update(range(x.start_word, x.end_word))
    both, all_ = sum(len(a & b) for a, b in zip(got, want)), sum(map(len, want))
    assert all_ > 500 and both >= 0.9 * all_ and both >= 0.95 * sum(map(len, got))
    assert compact_windows.near_passages(empty).count() == 0
    salted = compact_windows.near_passages(df, group_keys=9).collect()
    assert Counter(map(tuple, salted)) == Counter(map(tuple, rows))  # how a group's documents are spread changes nothing
    every = df.union(df.where("doc_id % 3 = 0").withColumn("doc_id", F.col("doc_id") + 1000))  # copies
    copied = compact_windows.near_passages(every, small_bytes=0).collect()
    assert Counter(map(tuple, copied)) == Counter(map(tuple, compact_windows.near_passages(every).collect()))
    strip = lambda x: (x.group_id, x.start_word, x.end_word, x.n_links, x.jaccard)
    for shift in (0, 1000):
        assert Counter((x.class_id, *strip(x)) for x in copied if x.n_links and (x.doc_id >= 1000) == (shift > 0)) == Counter((x.doc_id, *strip(x)) for x in rows if not shift or x.doc_id % 3 == 0)
    long_ = [i for i, t in docs if len(words_of(t)) >= 50 and i % 3 == 0]
    assert {(x.doc_id, x.class_id, x.start_word, x.end_word, x.n_copies) for x in copied if not x.n_links} == {(i + k, i, 0, len(words_of(docs[i][1])), 2) for i in long_ for k in (0, 1000)}
    twice = hard.union(hard.where("doc_id = 7").withColumn("doc_id", F.lit(70).cast("long")))
    assert {(x.doc_id, x.class_id, x.n_copies) for x in compact_windows.near_passages(twice).collect()} == {(7, 7, 2), (70, 7, 2)}


def test_links_of_passages_are_counted_as_listed(spark):
    r = random.Random(29)
    words = voc(3000, 8)
    passage, other = prose(r, 60, words), prose(r, 80, words)
    docs = [(i, " ".join(prose(r, 70, words) + passage + prose(r, 70, words) + (other if i % 2 else []) + prose(r, r.randrange(60), words))) for i in range(9)]
    docs.append((20, " ".join(passage + prose(r, 90, words) + passage)))  # what repeats in one document is no link of its own
    docs.append((21, " ".join((z := prose(r, 70, words)) + prose(r, 70, words) + z)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    rows = compact_windows.near_passages(df).collect()
    by = {}
    for x in compact_windows.near_pairs(df).collect():
        by.setdefault(x.doc_a, set()).add(x.doc_b)
    assert by == {x: set([*range(9), 20]) - {x} for x in [*range(9), 20]}
    assert {x.doc_id for x in rows} == {*range(9), 20}
    first = [x for x in rows if x.doc_id == 0 and x.start_word <= 75 <= x.end_word]
    assert len(first) == 1 and first[0].group_id == 0 and first[0].n_links == 10  # 8 documents and the two places of the other
    assert all(50 <= x.start_word <= 70 and 130 <= x.end_word <= 150 for x in first)  # of a window of 46, at least 31 are common


def test_compared_work_of_repeated_words_and_short_boilerplate(monkeypatch):
    """Links equal those of a plain comparison; runs of a repeated word are looked up as runs, and texts with too few common n-grams not at all."""
    r = random.Random(31)
    words = voc(3000, 8)
    short = prose(r, 20, words)
    looked, plain = [], compact_windows.Links.compared

    def compared(self, x, y, least, largest, first, stop):
        found = plain(self, x, y, least, largest, first, stop)
        p, got = self.p, []
        for k in range(len(x)):
            of_y = [z for z in range(len(self.one)) if self.one[z] == y[k]]
            hits = [int(p.at[i]) for i in range(first[k], stop[k]) if any(p.code[z] == p.code[i] and p.at[i] + least[k] - self.slack <= p.at[z] <= p.at[i] + largest[k] + self.slack for z in of_y)]
            looked.append((len(self.begin), len(self.one)))
            got += [(x[k], y[k], a, b, s) for _, a, b, s in zip(*self.runs(np.zeros(len(hits), np.int64), np.array(hits, np.int64)))]
        assert got == list(zip(found[0], found[1], found[2], found[3], found[5]))
        return found

    monkeypatch.setattr(compact_windows.Links, "compared", compared)

    def of(texts):
        rows = pa.table({"shard": pa.array([0] * len(texts)), "salt": pa.array([0] * len(texts), pa.int32()), "doc_id": pa.array(range(len(texts))), "at": pa.array([0] * len(texts)), "block": pa.array([0] * len(texts), pa.int32()), "text": texts})
        return compact_windows.Links(compact_windows.Parts(rows, 5, 46, 31), 46, 8, 2, 31, 8)

    a, b, c = words[:3]
    found = of([" ".join([a] * r.randrange(45, 80) + [b] * r.randrange(1, 70) + [a] * r.randrange(9) + [c] * r.randrange(45, 80)) for _ in range(9)])
    assert sum(len(x[0]) for x in found) > 30
    assert looked and all(runs * 4 < every for runs, every in looked)
    # what is not compared at all is told from how many n-grams two classes have in common
    halves = [prose(r, 40, words) for _ in range(8)]
    found = of([" ".join(halves[k] + short + halves[(k + 1) % 8] + short[:9] + halves[k + 4 & 7]) for k in range(8)])
    p, classes = found.p, found.classes
    codes = [p.code[a : a + n].tolist() for a, n in zip(p.start, p.many)]
    assert [found.common(c, c + 1)[0].tolist() for c in range(classes)] == found.common(0, classes).tolist() == [[sum(z in set(y) for z in x) for y in codes] for x in codes]


def test_near_passages_pairs_of_families(spark):
    r = random.Random(17)
    words = voc(3000, 8)
    n, size = compact_windows.N, compact_windows.WINDOW
    docs, want = [(2**60, "")], set()
    for count in (10, 30, 50):
        base = prose(r, 55, words)
        family = []
        for _ in range(count):
            t = [r.choice(words) if r.random() < 0.045 else w for w in base]
            g = grams(Words(large(pa.array([" ".join(t)]))).hashes, n).tolist()
            runs = [frozenset(g[k : k + size]) for k in range(len(g) - size + 1)]
            docs.append((2**60 + len(docs), " ".join(prose(r, 30, words) + t + prose(r, 30, words))))
            want |= {(other, docs[-1][0]) for other, before in family if any(len(a & b) >= compact_windows.THRESHOLD * len(a | b) for a in before for b in runs)}
            family.append((docs[-1][0], runs))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    pairs = compact_windows.near_pairs(df).collect()
    got = {(x.doc_a, x.doc_b) for x in pairs if x.doc_a < x.doc_b}
    assert len(want) > 400 and len(got & want) >= 0.9 * len(want)
    assert {(x.doc_a, x.doc_b) for x in compact_windows.near_pairs(df, group_keys=40).collect()} == {(x.doc_a, x.doc_b) for x in pairs}
    assert len(compact_windows.hot_keys(df, n, size, compact_windows.HASHES, 1)[0]) > 10  # nor does it change anything if values are taken for hot
    assert {(x.doc_a, x.doc_b) for x in compact_windows.near_pairs(df, sample=1).collect()} == {(x.doc_a, x.doc_b) for x in pairs}
    rows = compact_windows.near_passages(df).collect()
    assert {x.doc_id for x in rows} == {x.doc_a for x in pairs}
    # the windows tried for a class are those of its first part in a task: how a group is cut into blocks may move the ends of a few passages that barely reach the threshold
    blocks = compact_windows.near_passages(df, group_keys=40).collect()
    assert {(x.doc_id, x.group_id) for x in blocks} == {(x.doc_id, x.group_id) for x in rows}
    assert (Counter(map(tuple, blocks)) & Counter(map(tuple, rows))).total() >= 0.97 * len(rows)


def test_near_passages_at_several_places(spark):
    r = random.Random(23)
    words = voc(3000, 8)
    passage = prose(r, 70, words)
    text, places = [], []
    for _ in range(5):
        text += prose(r, 60, words)
        places.append(len(text))
        text += passage
    many = " ".join(text)
    for docs in ([(1, many), (2, " ".join(passage))], [(1, " ".join(prose(r, 9, words) + passage + prose(r, 9, words))), (2, many)], [(1, many), (2, many + " x")]):
        rows = compact_windows.near_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()
        for k, text in docs:
            if text.startswith(many):
                assert all(any(x.doc_id == k and x.start_word <= i and x.end_word >= i + 70 for x in rows) for i in places)
    loop = " ".join(["a", "b"] * 3000)
    assert {(x.doc_id, x.end_word) for x in compact_windows.near_passages(spark.createDataFrame([(1, loop), (2, "x " + loop)], "doc_id long, text string")).collect()} == {(1, 6000), (2, 6001)}


# ---- 8: pages


def test_html_content(spark):
    body = "".join(f"<p>Long sentence number {i}, with words, and marks; it goes on and on.</p>" for i in range(6))
    page = f"<html><head><title>no</title><script>var x = '<p>no</p>';</script></head><body><nav><ul>{'<li><a href=x>menu</a></li>' * 8}</ul></nav><article>{body}</article><footer>c</footer></body></html>"
    rows = [(1, page), (2, None), (3, ""), (4, "no tags at all, just text."), (5, "<p>a<p>a"), (5, "<p>a<p>a"), (None, "<b>x</b>"), (6, "<div>" * 3000 + "deep" + "</div>" * 3000), (7, "<!-- open")]
    got = html_content.html_content(spark.createDataFrame(rows, "page_id long, html string").withColumn("text", F.lit("clash"))).collect()
    by = {x.page_id: x for x in got}
    assert len(got) == len(rows)
    assert "sentence number 5" in by[1].text and "menu" not in by[1].text and "no" not in by[1].text.split() and by[1].n_content_paths == 1
    assert by[2].text is None and by[3].text == "" and by[4].text == "no tags at all, just text." and by[5].text == "a a" and by[6].text == "deep" and by[7].text == ""
    assert html_content.html_content(spark.createDataFrame([], "page_id long, html string")).count() == 0


@pytest.mark.parametrize("page", ["<a " * 350_000, '<a "x>' * 180_000, "<b>x" * 250_000, "<div>" * 200_000 + "x" + "</div>" * 200_000, "<a '\">\"" * 150_000, "<svg>text" * 100_000, "<head>x" * 100_000, "<li>x" * 200_000, "</p>" * 250_000, "<!-- x" * 150_000])
def test_html_content_of_long_pages(page):
    began = time.process_time()
    html_content.content(page)
    assert time.process_time() - began < 20


def test_unclosed_elements_keep_the_page():
    assert [t for _, t in html_content.text_nodes("<svg>a<p>b</p>")] == ["a", "b"] and html_content.text_nodes("<style>a<p>b</p>") == []
    assert [t for _, t in html_content.text_nodes("<p>a <b <i>c</i>")] == ["a", "c"] and [t for _, t in html_content.text_nodes("a < b > c <d")] == ["a < b > c <d"]
    assert [t for _, t in html_content.text_nodes("<a title='x>y'>z</a><p class=\"q>r</p>")] == ["z", "r"]


def test_ratios_against_brute_force():
    r = random.Random(4)
    for _ in range(60):
        page = "".join(r.choice(["<div>", "</div>", "<p>", "<b>", "</b>", "<ul><li>", "</ul>", "one, two. three! ", "word ", "a long run of text; it has marks, too: some. "]) for _ in range(r.randrange(40)))
        nodes = html_content.text_nodes(page)
        if not nodes:
            continue
        length, marks = {}, {}
        for p, t in nodes:
            length.setdefault(p, []).append(len(t))
            marks.setdefault(p, []).append(sum(c in ".,;:!?…。、，；：！？" for c in t))
        kernel = [np.exp(-(k * k) / 2) for k in range(-2, 3)]

        def smooth(by, i):
            ratio = [np.mean(by[p]) for p, _ in nodes]
            near = [ratio[min(max(i + k, 0), len(ratio) - 1)] for k in range(-2, 3)]
            return np.sqrt(ratio[i] * sum(a * b for a, b in zip(near, kernel)) / sum(kernel))

        fused = {}
        for i, (p, _) in enumerate(nodes):
            fused.setdefault(p, []).append(np.sqrt(smooth(length, i) * (1 + smooth(marks, i))))
        score = {p: np.mean(v) for p, v in fused.items()}
        least = min(0.75 * np.mean(list(score.values())), max(score.values()))
        if any(abs(v - least) < 1e-9 for v in score.values()) and len(score) > 1:
            continue
        kept = {p for p, v in score.items() if v >= least - 1e-12}
        text, n, n_kept = html_content.content(page)
        assert (n, n_kept) == (len(score), len(kept)) and text.split() == [w for p, t in nodes if p in kept for w in t.split()]


@tables
def test_html_content_finds_articles(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {x.page_id: x.text for x in html_content.html_content(pages).collect()}
    hit = wanted = given = 0
    for page, html in pages.select("page_id", "html").collect():
        inside = html_content.text_nodes(html[html.index("<article") : html.index("</article>")])
        want = Counter(w for _, t in inside for w in t.split())
        found = Counter(got[page].split())
        hit, wanted, given = hit + sum((want & found).values()), wanted + sum(want.values()), given + sum(found.values())
    assert hit >= 0.95 * wanted and hit >= 0.9 * given


# ---- 9: Jaccard join


def brute_pairs(docs, n, threshold):
    sets = {}
    for i, t in docs:
        w = words_of(t or "")
        if w and i is not None:
            sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)}
    ids = sorted(sets)
    return {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for k, a in enumerate(ids) for b in ids[k + 1 :] if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])}


def components_of(ids, pairs):
    root = {i: i for i in ids}
    for _ in range(50):
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    return root


def near_docs(seed=4):
    r = random.Random(seed)
    docs = []
    for g in range(12):
        base = prose(r, r.randrange(3, 60), voc(900, 3))
        for _ in range(r.randrange(1, 9)):
            rate = r.choice([0, 0, 0.05, 0.15])
            docs.append((len(docs), " ".join(r.choice(voc(900, 3)) if r.random() < rate else w for w in base)))
    return docs + [(len(docs) + k, "a b") for k in range(3)] + [(900, None), (901, ""), (902, "!")]


def test_matrix_is_exact():
    r = random.Random(8)
    sets = [np.unique(np.array([r.randrange(40) for _ in range(r.randrange(1, 30))], np.uint64)) for _ in range(150)]
    opened: list = []
    i, j, s = (np.concatenate(x) for x in zip(*jaccard_join.similar(sets, 0.4, group=16, opened_share=opened)))
    want = {(a, b) for a in range(150) for b in range(a + 1, 150) if len(np.intersect1d(sets[a], sets[b])) >= 0.4 * len(np.union1d(sets[a], sets[b]))}
    assert set(zip(i.tolist(), j.tolist())) == want and len(i) == len(want) and (s >= 0.4).all() and len(opened) == 10


def test_jaccard_join_against_brute_force(spark, hard, empty):
    docs = near_docs()
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = brute_pairs(docs, 3, 0.5)
    root = components_of([i for i, _ in docs], want)
    for shard_bytes in (jaccard_join.SHARD_BYTES, 200):  # how a leader's documents are spread changes nothing
        rows = {x.doc_id: x for x in jaccard_join.near_documents(df, shard_bytes=shard_bytes).collect()}
        assert set(rows) == {i for p in want for i in p}
        for i, x in rows.items():
            own = [v for k, v in want.items() if i in k]
            assert (x.class_id, x.n_links) == (root[i], len(own)) and abs(x.max_jaccard - max(own)) < 1e-12
    assert jaccard_join.near_documents(hard).count() == 0 and jaccard_join.near_documents(empty).count() == 0
    repeated = df.union(df.where("doc_id in (0, 1, 2, 3)")).union(spark.createDataFrame([(0, "one other text of the same id")], df.schema))
    assert {x.doc_id for x in jaccard_join.near_documents(repeated).collect()} <= set(root)


def test_matrix_opens_few_groups():
    r = random.Random(9)
    sets = []
    for _ in range(40):
        base = [r.randrange(2**60) for _ in range(100)]
        sets += [np.unique(np.array([x if r.random() > 0.1 else r.randrange(2**60) for x in base], np.uint64)) for _ in range(20)]
    r.shuffle(sets)
    opened: list = []
    found = sum(len(i) for i, _, _ in jaccard_join.similar(sets, 0.5, opened_share=opened))
    assert found == 40 * 190 and sum(a for a, _ in opened) <= 0.25 * sum(b for _, b in opened)


def test_every_document_has_one_passage(spark):
    r = random.Random(31)
    same = prose(r, 120, voc(2000, 4))
    own = lambda i, k: [f"w{i}x{k}x{n}" for n in range(10)]
    df = spark.createDataFrame([(i, " ".join(own(i, 0) + same + own(i, 1))) for i in range(300)], "doc_id long, text string")
    got = {x.doc_id: x for x in jaccard_join.near_documents(df, shard_bytes=20_000).collect()}
    assert set(got) == set(range(300)) and {x.class_id for x in got.values()} == {0} and all(x.n_links == 299 for x in got.values())
    found = suffix_dedup.repeats(df, shard_anchors=50).collect()
    assert {x.doc_id for x in found} == set(range(300)) and [x.doc_id for x in found if x.is_first] == [0]
    rows = compact_windows.near_passages(df, group_keys=500).collect()
    assert {x.doc_id for x in rows} == set(range(300)) and all(x.n_links == 299 for x in rows if x.group_id == 0)


def test_jaccard_stage_keeps_one_of_each_group(spark, hard, empty):
    docs = near_docs()
    pairs = brute_pairs(docs, 3, 0.5)
    root = components_of([i for i, _ in docs], pairs)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    kept = [x.doc_id for x in jaccard_join.stage(spark, df, "").collect()]
    assert sorted(kept) == sorted(i for i in root if root[i] == i)
    assert jaccard_join.stage(spark, hard, "").count() == len(HARD) and jaccard_join.stage(spark, empty, "").count() == 0


# ---- 10: chat


def test_chat_windows(spark):
    rows = [(1, 0, "system", "be good"), (1, 1, "user", "a b c"), (1, 2, "assistant", "d e"), (1, 3, "user", "f"), (1, 4, "assistant", "g h i j k l m n o p")]
    rows += [(2, 0, "system", "only")] + [(3, 1, None, None), (3, 2, "assistant", "x " * 500), (3, 2, "assistant", "x " * 500), (None, 1, "user", "no"), (4, None, "user", "no"), (5, 0, "user", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"window": F.lit(1), "h": F.lit(2), "sys": F.lit(3)})
    n_words = F.size(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(WORD), F.lit(0)))
    got = {}
    for x in chat_windows.chat_windows(df, budget=22, history=1, per_turn=1, tokens=n_words).collect():
        got.setdefault(x.conv_id, []).append(x)
    assert set(got) == {1, 3, 5}
    first, second = sorted(got[1], key=lambda x: x.window)
    assert (first.first_turn, first.last_turn, first.n_history, first.target) == (1, 3, 0, "0010") and (second.first_turn, second.last_turn) == (4, 4)
    assert second.n_history == 1 and second.target == "001" and second.text.startswith("<|system|>\nbe good\n<|user|>\nf") and second.n_tokens <= 22
    assert sum(x.target.count("1") for x in got[3]) == 2 and max(x.n_tokens for x in got[3]) > 22
    for x in (y for k in got for y in got[k]):
        assert x.n_target_tokens <= x.n_tokens
    assert chat_windows.chat_windows(df.where("false")).count() == 0


@tables
@tokenizers
def test_chat_windows_against_sql(spark):
    import duckdb

    enc = token_counts.encoding(token_counts.VOCABULARY)
    turns = pq.read_table(f"{SF}/conversations.parquet")
    conversations = turns.append_column("n_tokens", pa.array([len(enc.encode_ordinary(t or "")) for t in turns["text"].to_pylist()], pa.int64()))  # noqa: F841
    got = queries.queries()["op10_chat_windows"](spark, SF)
    rel = duckdb.sql(chat_windows.OP10_SQL)
    names = sorted(got.columns)
    assert sorted(rel.columns) == names
    want = rel.fetchall()
    at = [rel.columns.index(c) for c in names]
    assert len(want) > 20 and sorted(map(repr, (tuple(r[c] for c in names) for r in got.collect()))) == sorted(map(repr, (tuple(r[i] for i in at) for r in want)))
    assert max(x.n_tokens for x in got.collect()) <= chat_windows.BUDGET or len(want)


# ---- all


@tables
@tokenizers
def test_every_query_runs_and_agrees_with_its_sql(spark):
    import glob

    import duckdb

    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    sql = queries.oracle_sql()
    assert len(queries.queries()) == 10
    for name, f in queries.queries().items():
        df = f(spark, SF)
        names = sorted(df.columns)
        got = sorted(map(repr, (tuple(r[c] for c in names) for r in df.collect())))
        assert got, name
        if name in sql:
            rel = con.sql(sql[name])
            assert sorted(rel.columns) == names
            at = [rel.columns.index(c) for c in names]
            assert got == sorted(map(repr, (tuple(r[i] for i in at) for r in rel.fetchall()))), name
