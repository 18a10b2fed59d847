"""Scalar expressions against known answers and row-at-a-time versions."""

import random

import pytest
from pyspark.sql import functions as F

from wordflow.functions import distance as D
from wordflow.functions import edits as E
from wordflow.functions import keyboard as K
from wordflow.functions import text as T
from wordflow.functions import vectors as V


def one(spark, values, f):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, a string").select("i", f(F.col("a")).alias("r")).collect()
    return [r.r for r in sorted(rows)]


def two(spark, pairs, f):
    rows = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string").select("i", f(F.col("a"), F.col("b")).alias("r")).collect()
    return [r.r for r in sorted(rows)]


def osa(a, b):
    if not a or not b:
        return len(a) + len(b)
    d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            if not i or not j:
                d[i][j] = i + j
                continue
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


@pytest.fixture(scope="module")
def pairs():
    r = random.Random(3)
    word = lambda: "".join(r.choice("abé") for _ in range(r.randint(0, 6)))
    return [(word(), word()) for _ in range(300)]


def test_osa_native_and_batched_agree_with_table(spark, pairs):
    want = [osa(a, b) for a, b in pairs]
    assert two(spark, pairs, D.osa_words) == want
    assert D.osa_batch(*map(list, zip(*pairs))).tolist() == want
    assert D.osa_batch([], []).tolist() == []


def test_soundex(spark):
    words = ["Robert", "Rupert", "Ashcraft", "Tymczak", "Pfister", "hello", "a", "é", ""]
    assert one(spark, words, T.soundex) == ["R163", "R163", "A261", "T520", "P236", "H400", "A000", None, None]


def test_casing_and_folds(spark):
    assert one(spark, ["foo", "Foo", "FOO", "fooBar", "FooBar"], T.captype) == ["no", "init", "all", "huh", "huhinit"]
    assert one(spark, ["á", "söße"], T.fold_units) == [["a"], ["s", "o", "ss", "e"]]
    assert one(spark, ["FOO"], T.case_variants) == [["FOO", "foo", "Foo"]]


def test_hash_known_answers(spark):
    assert [hex(x) for x in one(spark, ["hello", "h", "é", "üß"], T.fnv1a)] == ["0x4f9f2cab", "0xed0c3757", "0x3cfa68c1", "0x2bdb26dc"]
    assert one(spark, ["Hello"], T.substring_grams) == [["hel", "ell", "llo", "hell", "ello", "hello"]]


def test_similarities(spark):
    assert two(spark, [("hello", "hello"), ("helo", "hello"), ("xelo", "hello"), ("", "hello")], D.typo_similarity) == pytest.approx([1, 1, 0.6, 0])
    assert two(spark, [("q", "w"), ("q", "p"), ("a", "A"), ("q", "é")], K.distance) == [1, 9, 0, None]
    assert two(spark, [("helo", "hello"), ("teh", "the"), ("ab", "ba")], D.transposition_bonus) == [0, 200, 200]
    assert two(spark, [("helo", "hello"), ("teh", "the")], D.typo_pattern_bonus) == [330, 0]


def test_edits(spark):
    assert one(spark, ["bit"], lambda c: E.bad_char(c, "ta")) == [["btt", "tit", "bia", "bat", "ait"]]
    assert one(spark, ["te"], lambda c: E.forgotten_char(c, "a")) == [["ate", "tae", "tea"]]
    assert one(spark, ["the", ""], E.extra_char) == [["he", "te", "th"], []]
    assert one(spark, ["owudl"], E.swap_char)[0][-2:] == ["would", "ouwld"]


def test_vectors(spark):
    rows = spark.createDataFrame([([1.5, -0.5], [4.0, 0.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<float>, b array<float>")
    assert [r[0] for r in rows.select(V.cosine(F.col("a"), F.col("b"))).collect()] == pytest.approx([0.9486832980505138, 0])
    back = rows.select(V.int4_unpack(V.int4_quantize(F.col("a")), F.size("a"))).collect()
    assert [r[0] for r in back] == [[7, -2], [0, 0]]
