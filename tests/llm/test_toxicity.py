import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from textloom.llm import toxicity as T

BAD = ["moron", "scum", "idiot", "worthless"]
SYL = ["an", "er", "tion", "the", "of", "re", "st", "and", "ing", "ble", "ou", "es"]


def corpus(n=1500, seed=2):
    r = random.Random(seed)
    word = lambda: "".join(r.choice(SYL) for _ in range(r.randint(1, 4))) + r.choice(["", "", "", ",", ".", "***", "!!", "$$$"])
    rows, labels = [], []
    for i in range(n):
        w = [word() for _ in range(r.randint(5, 120))]
        toxic = i % 7 == 0
        if toxic:
            for _ in range(r.randint(1, 4)):
                w.insert(r.randrange(len(w)), r.choice(BAD))
        rows.append((i, " ".join(w)))
        if i % 2 == 0:
            labels.append((i, int(toxic), 1))
    return rows, labels


def lm():
    total = np.zeros(28**3, np.int64)
    for w in T.words(pa.array([t for _, t in corpus()[0]]), space=T._NOT_LETTER):
        total += T.trigram_counts(w)
    return T.CharModel(total)


def brute_viterbi(model, token):
    """All readings of a short token, scored one by one."""
    best = (-1e9, "")

    def go(i, letters, a, b, s):
        nonlocal best
        if i == len(token):
            s += model.log[a][b][0]
            best = max(best, (s, letters))
            return
        ch = token[i]
        reads = [(ch, T._SAME_COST)] if ch.isalpha() else [(x, T._SIGN_COST) for x in T.SIGNS.get(ch, "")]
        for x, c in reads:
            go(i + 1, letters + x, b, T.CharModel.code(x), s - c + model.log[a][b][T.CharModel.code(x)])
        if letters and any(x == letters[-1] for x, _ in reads):
            go(i + 1, letters, a, b, s - T._REPEAT_COST)
        if not ch.isalpha():
            go(i + 1, letters, a, b, s - (T._GAP_COST if ch in T._GAPS or ch not in T.SIGNS else T._DOUBT_COST))

    go(0, "", 0, 0, 0.0)
    return best[1]


def test_viterbi_equals_all_readings():
    model = lm()
    for token in ("th3re", "1ng", "t.h.e", "b!3", "rrre", "0f", "st@1", "a$$", "hell0", "re$"):
        assert T.restore(model, token) == brute_viterbi(model, token), token


@pytest.mark.parametrize("word", ["id10t", "!diot", "i-d-i-o-t", "iiidiooot", "m0r0n", "$cum", "s c u m", "w0rthl3ss", "worthles$", "5cum", "mor0n!!", "idio7", "iddiot", "mooron", "id-iot", "mo.ron", "worthle$$", "(m0r0n)", "s*c*u*m", "mo ron", "id iot", "worth less", "wwoorrthless", "worthlless", "iiddiioott"])
def test_disguises_are_found(model, word):
    s = model.score_column(pa.array([f"the of {word} and tion ring"]), model.reader())
    assert s[0] >= 0.5, (word, s)


@pytest.fixture(scope="module")
def model(spark):
    rows, labels = corpus()
    return T.train(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int, x int"))


def test_held_out_accuracy_and_clean_texts(spark, model):
    rows, labels = corpus()
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, score int").repartition(3)
    got = T.score(df, spark.createDataFrame(labels, "doc_id long, toxic int, x int")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert r.predicted == int(r.score >= 0.5)
    wrong = sum(r.predicted != (r.doc_id % 7 == 0) for r in got if r.held_out)
    assert wrong <= 0.01 * sum(r.held_out for r in got)
    clean = pa.array(["THE!! a$$$ that*** tion$$$ 12 4.5", "x 10.0.0.1 a@b.com", "", None, "a b c d e f", "é ñ ó"])
    assert (model.score_column(clean, model.reader()) < 0.5).all()


def test_edges(spark):
    lab = spark.createDataFrame([(1, 1), (2, None), (None, 0)], "doc_id long, toxic int")
    df = spark.createDataFrame([(None, "x"), (1, None), (1, ""), (3, "w" * 5000 + "1" * 5000)], "doc_id long, text string")
    assert len(T.score(df, lab).collect()) == 4
    assert T.score(df.limit(0), lab.limit(0)).collect() == []
    kept = T.drop_toxic(spark.createDataFrame([(1, "a", "en")], "doc_id long, text string, lang string"), lab.limit(0))
    assert kept.columns == ["doc_id", "text", "lang"] and kept.count() == 1


@pytest.mark.parametrize("word", ["aasshhoole", "asshholle", "asshole", "aasshhoollee", "assshole", "as-shole", "ass hole"])
def test_words_with_doubles_of_their_own(word):
    r = random.Random(5)
    rows = [(i, " ".join(["".join(r.choice(SYL) for _ in range(3)) for _ in range(20)] + ["asshole"] * (i % 3 == 0))) for i in range(400)]
    total = np.zeros(28**3, np.int64)
    for w in T.words(pa.array([t for _, t in rows]), space=T._NOT_LETTER):
        total += T.trigram_counts(w)
    telling = T.ToxicityModel(T.CharModel(total), T.Classifier(np.array([T.hash_pieces(np.frombuffer(b"asshole", np.uint8), np.zeros(7, int), 1)[0][0]], np.uint64), np.array([9.0]), -3.0))
    assert telling.score_column(pa.array([f"the {word} of"]), telling.reader())[0] > 0.5, word


def test_gate_passes_every_reading():
    """A word passes the gate if and only if a telling word or beginning is among all ways to read its doubled letters."""
    r = random.Random(8)
    telling = {"abba", "abcab", "bacca", "aabb", "cbcbc"}
    key = lambda x: T.hash_pieces(np.frombuffer(x.encode(), np.uint8), np.zeros(len(x), int), 1)[0][0]
    classifier = T.Classifier(np.sort(np.array([key(x) for x in telling], np.uint64)), np.ones(5), 0.0)
    tokens = ["".join(r.choice("abc") * r.choice([1, 1, 2]) for _ in range(r.randint(3, 6))) for _ in range(600)]
    tokens = [t for t in tokens if not any(c * 3 in t for c in "abc")]
    w = next(T.words(pa.array(tokens)))
    got = T._plain_hits(w, np.arange(len(tokens)), classifier)

    def ways(t):
        out = {""}
        for i, c in enumerate(t):
            out = {x + c for x in out} | ({x for x in out} if i and t[i - 1] == c else set())
        return out

    for t, g in zip(tokens, got):
        doubles = sum(a == b for a, b in zip(t, t[1:]))
        want = doubles > T.SUBSETS or any(x == y or len(x) > len(y) >= 4 and x.startswith(y) for x in ways(t) for y in telling)
        assert g == want, t


def test_joined_hashes():
    parts = [("mo", "ron"), ("a", "b"), ("x" * 40, "y" * 30)]
    a, b, both = (next(T.words(pa.array([" ".join(x)]))) for x in zip(*((p, q, p + q) for p, q in parts)))
    assert (T.joined(a.hash, a.end - a.start, b.hash, b.end - b.start) == both.hash).all()


def test_thresholds_come_from_training_folds():
    r = random.Random(3)
    rows = [(i, y := int(r.random() < 0.3), sorted({*([0] if y and r.random() < 0.9 else []), *r.sample(range(1, 40), 5)})) for i in range(800)]
    odds, prior = T.choose(rows, 40)
    assert odds in T.ODDS and prior in T.PRIORS
    assert T.choose([], 0) == T.choose([(1, 0, [])], 0) == (T.ODDS[0], T.PRIORS[0])
