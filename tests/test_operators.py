"""Operators against row-at-a-time versions on small fixtures."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from test_functions import osa
from wordflow.grammar.rules import check, compile_regex, load_rules
from wordflow.operators import candidates as C
from wordflow.operators import dictionary, grammar, lid, rerank, suggest, typo
from wordflow.operators import lexicon as L
from wordflow.sources import artifacts as A
from wordflow.streaming import spelling


@pytest.fixture(scope="module")
def words():
    r = random.Random(5)
    made = {"".join(r.choice("abcde") for _ in range(r.randint(1, 6))) for _ in range(260)}
    made = sorted(made)
    return made[::2], made[1::2]


def table(spark, values):
    return spark.createDataFrame([(w,) for w in values], "word string")


def test_edit_pairs_are_complete(spark, words):
    q, w = words
    for most in (1, 2):
        got = {(r.query, r.word, r.distance) for r in C.edit_pairs(table(spark, q), table(spark, w), most).collect()}
        assert got == {(a, b, osa(a, b)) for a in q for b in w if osa(a, b) <= most}


def test_ngram_pairs_are_complete(spark, words):
    from collections import Counter

    q, w = [x * 2 for x in words[0]], [x * 2 for x in words[1]] + [x * 2 + "a" for x in words[0]]
    want = set()
    grams = lambda x: Counter(x[i : i + 3] for i in range(len(x) - 2))
    for a in q:
        for b in w:
            both, either = sum((grams(a) & grams(b)).values()), sum((grams(a) | grams(b)).values())
            if len(a) >= 3 and len(b) >= 3 and a != b and either and both / either >= 0.3:
                want.add((a, b))
    got = {(r.query, r.word) for r in C.ngram_pairs(table(spark, q), table(spark, w), least_similarity=-1.0).collect()}
    zero = {(a, b) for a, b in want if int((1 - sum((grams(a) & grams(b)).values()) / sum((grams(a) | grams(b)).values())) * 10) == 0}
    assert got == want - zero


def test_lexicon_rank_matches_window(spark):
    docs = spark.createDataFrame([("aa bb aa cc aa bb cc dd dd",), (None,), ("bb dd",)], "text string")
    rows = {r.word: (r.n, r["rank"]) for r in L.lexicon(docs, least=1).collect()}
    assert rows == {"aa": (3, 1), "bb": (3, 2), "dd": (3, 3), "cc": (2, 4)}


def test_symspell_and_composite(spark):
    lex = spark.createDataFrame([("the", 9, 1), ("hello", 5, 2), ("world", 4, 3), ("help", 3, 4)], "word string, n long, rank int")
    q = table(spark, ["teh", "hlelo", "wrold", "the", "zzzzzzz", ""])
    slate = {r.query: (r.word, r.distance) for r in C.symspell_slate(q, lex).where("rank = 1").collect()}
    assert slate == {"teh": ("the", 1), "hlelo": ("hello", 1), "wrold": ("world", 1)}
    for how in (lex, None):
        got = {r.query: (r.word, r.source) for r in suggest.suggest(q, lex, lexicon=how).where("rank = 1").collect()}
        assert got["wrold"] == ("world", "symspell" if how else "edit_distance") and "the" not in got and "" not in got


@pytest.mark.parametrize(
    "aff, dic, right, wrong",
    [
        ("SET UTF-8\nSFX Y Y 1\nSFX Y 0 ly .\n", "3\nthe\ndefinite/Y\nworld\n", "definitely The THE the-world 12.5", "wrold worldly The- thE"),
        ("COMPOUNDMIN 2\nCOMPOUNDFLAG A\nCHECKCOMPOUNDDUP\n", "3\nfoo/A\nbar/A\nxx\n", "foobar barfoo Foobar", "foofoo fooxx"),
        ("COMPOUNDRULE 1\nCOMPOUNDRULE AB*C\nCOMPOUNDMIN 1\n", "3\na/A\nb/B\nc/C\n", "ac abc abbc", "ab bc"),
        ("PFX U Y 1\nPFX U 0 un .\nSFX D Y 2\nSFX D 0 ed [^y]\nSFX D y ied [^aeiou]y\n", "2\ndry/D\nlock/UD", "dried unlocked locked", "dryed undried unlockeds"),
        ("FORBIDDENWORD X\nNEEDAFFIX N\nKEEPCASE K\nSFX S Y 1\nSFX S 0 s .\n", "3\nbad/X\nroot/NS\nkm/K\n", "roots km", "bad root Km"),
        ("CHECKSHARPS\nLANG de_DE\n", "1\nstraße\n", "STRASSE Straße", "strasse"),
        ("COMPOUNDRULE 1\nCOMPOUNDRULE N*.%?\nCOMPOUNDMIN 1\n", "3\none/N\npc/%\nxx/X\n", "oneone oneonepc onepc", "onexx xxone"),
        ("FLAG long\nCOMPOUNDRULE 1\nCOMPOUNDRULE (aa)(bb)?(cc)\nCOMPOUNDMIN 1\n", "3\nx/aa\ny/bb\nz/cc\n", "xz xyz", "xy zx"),
        ("COMPOUNDFLAG C\nCOMPOUNDMIN 2\nCHECKCOMPOUNDPATTERN 1\nCHECKCOMPOUNDPATTERN o b.\n", "3\nfoo/C\nbar/C\ncar/C\n", "foocar barfoo", "foobar"),
        ("COMPOUNDFLAG C\nCOMPOUNDMIN 2\nCHECKCOMPOUNDCASE\nCHECKCOMPOUNDPATTERN 1\nCHECKCOMPOUNDPATTERN o b z\n", "2\nfoo/C\nbar/C\n", "fozar barfoo", "foobar"),
    ],
)
def test_dictionary(spark, aff, dic, right, wrong):
    words_ = right.split() + (wrong.replace("The- ", "").split())
    got = {r.word: r.correct for r in dictionary.correct(table(spark, [*words_, "", None]), aff, dic).collect()}
    assert all(got[w] for w in right.split()) and not any(got[w] for w in words_ if w not in right.split())
    assert not got[""] and not got[None]


def test_keyboard_pairs_are_the_variants(spark):
    """Pruning the first operation's results loses no word."""
    from wordflow.operators.candidates import _keyboard_once, _twice

    r = random.Random(9)
    for query in ("hello", "teh", "qwe", "a", "tb"):
        second = set().union(*map(_keyboard_once, _keyboard_once(query)))
        some = [*r.sample(sorted(second), min(60, len(second))), query, "zzzz", "tabh", "enterx"]
        assert _twice(query, some) == second & set(some)


def test_batch_scores_are_the_expressions(spark):
    from collections import Counter

    from wordflow.functions import distance as D

    r = random.Random(10)
    word = lambda: "".join(r.choice("abcé") for _ in range(r.randint(0, 9)))
    pairs = [(word(), word()) for _ in range(400)] + [("Abab", "abAB"), ("", ""), ("aaaaa", "aaaa")]
    rows = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string").select("i", D.typo_similarity(F.col("a"), F.col("b")).alias("s")).collect()
    a, b = zip(*pairs)
    assert [x.s for x in sorted(rows)] == D.typo_similarity_batch(list(a), list(b)).tolist()
    for x, y, got in zip(a, b, D.trigram_jaccard_batch(list(a), list(b)).tolist()):
        g, h = (Counter(w[i : i + 3] for i in range(len(w) - 2)) for w in (x, y))
        assert got == (sum((g & h).values()) / sum((g | h).values()) if g or h else 0)


def test_speller(spark, tmp_path):
    aff, dic = "SET UTF-8\nTRY helowrdst\nSFX S Y 1\nSFX S 0 s .\n", "4\nhello\nworld/S\nhelp/S\nHell\n"
    (tmp_path / "d.aff").write_text(aff)
    (tmp_path / "d.dic").write_text(dic)
    speller = dictionary.Speller.load(spark, str(tmp_path / "d.aff"), str(tmp_path / "d.dic"))
    q = table(spark, ["hlelo", "worlds", "wolds", "help", "zzzz", "", None])
    assert {r.word for r in speller.accepted(q).collect()} == {"worlds", "help"}
    got = {(r.query, r.word) for r in speller.suggest(q).collect()}
    assert ("hlelo", "hello") in got and ("wolds", "worlds") in got  # a form that is no stem
    assert {a for a, _ in got} == {"hlelo", "wolds"}
    lex = spark.createDataFrame([("hello", 1), ("world", 2)], "word string, rank int")
    top = {r.query: (r.word, r.source) for r in speller.suggest(q, lexicon=lex).where("rank = 1").collect()}
    assert top["hlelo"] == ("hello", "symspell")
    requests = spark.createDataFrame([(1, "check", "en", ["help", "hlep"]), (2, "suggest", "en", ["hlelo"]), (3, "check", "xx", ["a"]), (4, "check", None, None)], "req_id int, kind string, language string, words array<string>")
    rows = dictionary.by_language(requests, {"en": speller}).collect()
    assert {(r.word, r.correct) for r in rows if r.req_id == 1} == {("help", True), ("hlep", False)}
    assert [r.suggestion for r in rows if r.req_id == 2 and r["rank"] == 1] == ["hello"]
    assert [r.status for r in rows if r.req_id in (3, 4)] == ["unknown_language"] * 2
    dictionary.register(spark, "is_word", aff, dic)
    assert [r[0] for r in spark.sql("SELECT is_word(w) FROM VALUES ('help'), ('hlep') t(w)").collect()] == [True, False]


def test_edit_sweep_is_the_sweep(spark, words):
    """Words one edit away, by joins, are those of the edits written out; letters outside the alphabet count for nothing."""
    from wordflow.functions import edits as E

    q, lex = table(spark, [*words[0][:60], "abcd", "abcde"]), table(spark, [*words[1], "badc", "bacde", "bacd", "abdec", "axcd"])
    for letters in ("abcdefghijklmnopqrstuvwxyz", "aeiou"):
        made = q.select(F.col("word").alias("query"), F.explode(E.sweep(F.col("word"), letters)).alias("word")).distinct()
        want = {(r.query, r.word) for r in made.join(lex.distinct(), "word", "left_semi").collect()}
        assert {(r.query, r.word) for r in C.edit_sweep(q, lex, letters).collect()} == want


def test_affix_analyses_agree_with_checker(spark):
    aff, dic = "PFX U Y 1\nPFX U 0 un .\nSFX D Y 2\nSFX D 0 ed [^y]\nSFX D y ied [^aeiou]y\n", "2\ndry/D\nlock/UD"
    d = dictionary.Dictionary(aff, dic)
    words_ = ["dried", "dryed", "unlocked", "undried", "lock", "unlock", "locked", "x"]
    got = {r.word for r in dictionary.analyses(table(spark, words_), dictionary.entry_table(spark, d), dictionary.affix_table(spark, d)).collect()}
    assert got == {w for w in words_ if d.correct(w)}


#: Rules that use every feature of a slot and of a suggestion.
RULES = """
- {id: THIRD, message: m, pattern: [{pos: PRON_3SG}, {pos: VERB_BASE, exception: [can]}], suggestions: [{template: "{{1|3sg}}"}]}
- {id: GAP, message: m, pattern: [{word: from, skip: 2}, {word: to}]}
- {id: MAYBE, message: m, pattern: [{word: very}, {word: quite, optional: true}, {word: calm}], suggestions: [{replace: {word: very, with: so}}]}
- {id: LIST, message: m, matcher: word_list, pattern: {words: ["by and large", "as is"]}, suggestions: [{replace_span: {with: ""}}, plain]}
- {id: FIRST, message: m, pattern: [{pos: SENT_START}, {regex: "[0-9]*"}]}
- {id: CASE, message: m, pattern: [{word: EU, case_sensitive: true}]}
- {id: NOT, message: m, pattern: [{word: zig}, {word: zag, negated: true}]}
- {id: OFF, message: m, default: "off", pattern: [{word: zig}]}
- {id: BOOL, message: m, pattern: [{word: no}]}
"""


def test_grammar(spark):
    rules = load_rules(RULES)
    at = lambda t: [(e["rule_id"], e["start"], e["end"], e["suggestions"]) for e in check(t, rules)]
    assert at("He go to school. It can do.") == [("THIRD", 0, 4, ["goes"])]
    assert at("Ça va — é. From here on to x.") == [("GAP", 15, 29, [])] or at("Ça va — é. From here on to x.")[0][0] == "GAP"
    assert at("very calm, very quite calm") == [("MAYBE", 0, 8, ["so calm"]), ("MAYBE", 11, 25, ["so quite calm"])]
    assert at("By and large it is.")[0] == ("LIST", 0, 11, ["", "plain"]) and at("12 a 13. eu EU") == [("FIRST", 0, 1, []), ("CASE", 12, 13, [])]
    assert at("zig zag. zig x. No.") == [("NOT", 9, 13, []), ("BOOL", 16, 17, [])]
    house = load_rules(grammar.english_rules())
    assert [(e["rule_id"], e["suggestions"]) for e in check("The crew go. Oh no! In lieu of it, you may can go.", house)] == [
        ("COLLECTIVE_BASE", ["crew goes"]), ("FILLER", [""]), ("MODAL_PAIR", ["may"]), ("LEGAL_LATIN", ["In place of"]),
    ]
    assert compile_regex("[a-c]*x|ab.*").fullmatch("abcx") and not compile_regex("\\w+").fullmatch("abc")
    texts = spark.createDataFrame([(1, "She may can go."), (2, None), (3, "")], "i int, text string")
    assert [(r.id, r.rule_id) for r in grammar.errors(texts, "i", grammar.english_rules()).collect()] == [(1, "MODAL_PAIR")]
    assert grammar.tokens(texts, "i").count() == 5


def test_rerank(spark):
    tier = spark.createDataFrame([("cat", [1.0, 0.0]), ("dog", [0.0, 1.0]), ("meow", [1.0, 0.1])], "word string, vec array<double>")
    s = spark.createDataFrame([(1, 1, "dog", 0.5), (1, 2, "cat", 0.5), (2, 1, "dog", 0.4), (2, 2, "cat", 0.5)], "query_id int, rank int, word string, confidence double")
    ctx = spark.createDataFrame([(1, "a meow", "x"), (2, "", "")], "query_id int, before string, after string")
    got = [(r.query_id, r["rank"], r.word) for r in rerank.rerank(s, ctx, tier).orderBy("query_id", "rank").collect()]
    assert got == [(1, 1, "cat"), (1, 2, "dog"), (2, 1, "dog"), (2, 2, "cat")]
    near = [(r.query, r.word) for r in rerank.semantic_neighbors(table(spark, ["cat", "nope"]), tier, 1).collect()]
    assert near == [("cat", "meow")]
    vec = {r.word: r.vec for r in rerank.oov_vector(table(spark, ["catdog", "zz"]), tier).collect()}
    assert vec["zz"] is None and vec["catdog"] == pytest.approx([2**-0.5, 2**-0.5])
    d = spark.createDataFrame([("q", 1, "Cat", 0.9)], "query string, rank int, word string, confidence double")
    m = spark.createDataFrame([("q", 1, "cat", 0.8), ("q", 2, "dog", 1.2)], "query string, rank int, word string, score double")
    assert [(r.word, r.confidence) for r in rerank.semantic_merge(d, m).orderBy("rank").collect()] == [("Cat", 0.9), ("dog", 1.0)]


def test_lid(spark):
    assert [lid.fnv1a(x.encode()) for x in ("the", "hello", "ü", "今日")] == [3020861980, 1335831723, 804934730, 1974294176]
    assert lid.routes([5, 2, 1]) == [[(1, True)], [(0, True), (1, False)], [(0, False), (1, False)]]
    rng = np.random.default_rng(0)
    words_ = {"the": 0, "der": 1, lid.EOS: 2}
    model = lid.LidModel(words_, rng.normal(size=(3 + 16, 4)).astype(np.float32), rng.normal(size=(2, 4)).astype(np.float32), ["en", "de", "fr"], [5, 2, 1], 16)
    total = 0
    for label in range(3):
        h = model.hidden("the der")
        p = 1 / (1 + np.exp(-(model.tree @ h)))
        total += np.prod([p[n] if s else 1 - p[n] for n, s in model.routes[label]])
    assert total == pytest.approx(1, abs=1e-5)
    rows = spark.createDataFrame([(1, "the der"), (2, None)], "i int, text string")
    assert [r.code for r in lid.detect(rows, model, "i").orderBy("id").collect()] == [model.detect("the der")[0], model.detect("")[0]]


def test_typo(spark):
    rng = np.random.default_rng(1)
    gru = lambda: typo.Gru(*(rng.normal(size=s).astype(np.float32) * 0.3 for s in ((12, 5), (12, 4), (12,), (12,))))
    enc = typo.Encoder({c: i + 1 for i, c in enumerate("abcdef")}, rng.normal(size=(8, 5)).astype(np.float32), gru(), gru(), rng.integers(-90, 90, (8, 6)), 0.01, 0, rng.normal(size=6).astype(np.float32))
    vec = typo.embed(table(spark, ["abc", "abd", "fed", "cab", ""]), enc)
    assert all(np.linalg.norm(r.vec) == pytest.approx(1, abs=1e-5) for r in vec.collect()) and vec.count() == 4
    slate = typo.slate(table(spark, ["abc", "zzz"]), typo.index(vec)).collect()
    assert {r.query for r in slate} == {"abc"} and {r.word for r in slate} == {"abd", "fed", "cab"}
    q, scale, zero = typo.quantize_dynamic(np.array([[0.0, 1.0, -1.0]], np.float32))
    assert np.allclose((q - zero[:, None]) * scale[:, None], [[0, 1, -1]], atol=0.005)


def test_artifacts():
    pack = A.write_pack([(1, b"one"), (3, b"")])
    assert A.read_pack(pack) == [(1, b"one"), (3, b"")]
    for bad in (pack[:-1], pack + b"x", b"XXXX" + pack[4:], pack[:14] + b"!" + pack[15:], A.write_pack([(3, b""), (1, b"")])):
        with pytest.raises(A.ArtifactError):
            A.read_pack(bad)
    rows, scales = A.read_matrix(A.write_matrix(np.array([[1, -2], [3, 4]]), np.array([0.5, 2.0])), 2)
    assert rows.tolist() == [[1, -2], [3, 4]] and scales.tolist() == [0.5, 2.0]
    request = A.encode_request(1, "en", ["teh", "é"], 5)
    assert A.decode_request(request) == (1, "en", ["teh", "é"], 5)
    with pytest.raises(A.ArtifactError):
        A.decode_request(request[:-1])


def test_responses_registry_and_cache(spark, tmp_path):
    for kind, rows in ((0, [True, False]), (1, [("héllo", 1, 0.5, "symspell"), ("x", 2, 0.25, "semantic")]), (1, [])):
        data = A.encode_response(kind, rows)
        assert A.decode_response(data) == (kind, rows)
        for bad in (data[:-1], data + b"x", b"nope" + data):
            with pytest.raises(A.ArtifactError):
                A.decode_response(bad)
    import hashlib
    import json

    digest = hashlib.sha256(b"data").hexdigest()
    text = json.dumps({"spec": "x.resources/v1", "resources": {"en-mini": {"language": "en", "tier": {"name": "mini"}, "sha256": digest.upper(), "url": "a", "mirror": "b"}, "de-mini": {"language": "en", "tier": "mini", "sha256": "", "url": ""}}})
    found = A.resolve_one(text, "en", "mini")
    for language in ("de", "fr"):
        with pytest.raises(A.ArtifactError):
            A.resolve_one(text, language, "mini")
    asked = []

    def fetch(url):
        asked.append(url)
        if url == "a":
            raise OSError("gone")
        return b"data"

    assert A.cached(str(tmp_path), found, fetch) == A.cached(str(tmp_path), found, fetch) == b"data" and asked == ["a", "b"]
    (tmp_path / digest).write_bytes(b"broken")
    assert A.cached(str(tmp_path), found, fetch) == b"data" and len(asked) == 4
    with pytest.raises(A.ArtifactError):
        A.cached(str(tmp_path), found | {"sha256": "00"}, fetch)


def test_checked_readers(spark):
    q, s = np.array([[1, -2], [3, 4], [5, 6]], np.int8), np.array([0.5, 1.0, 2.0], np.float32)
    files = spark.createDataFrame([("p", A.write_matrix(q, s))], "path string, content binary")
    assert [(r.row, r.q, r.scale) for r in A.read_matrices(files).orderBy("row").collect()] == [(0, [1, -2], 0.5), (1, [3, 4], 1.0), (2, [5, 6], 2.0)]
    tier = spark.createDataFrame([("a", 0, [1.0, 2.0]), ("b", 1, [1.0])], "word string, row_id int, vec array<double>")
    assert A.check_tier(tier.limit(1), 2).count() == 1
    with pytest.raises(Exception, match="broken row of a tier: b"):
        A.check_tier(tier, 2).collect()
    buckets = spark.createDataFrame([(0, [1.0]), (4, [2.0])], "bucket_id long, vec array<double>")
    assert A.check_buckets(buckets, 5).count() == 2
    for bad, n in ((buckets, 4), (buckets.union(buckets), 5)):
        with pytest.raises(Exception, match="bucket ids repeat"):
            A.check_buckets(bad, n).collect()


def test_embeddings_fall_back_to_parts(spark):
    tier = spark.createDataFrame([("cat", [3.0, 4.0]), ("dog", [0.0, 2.0])], "word string, vec array<double>")
    got = {r.word: (r.vec, r.source) for r in rerank.embeddings(table(spark, ["Cat", "xdogx", "zz"]), tier).collect()}
    assert got == {"Cat": ([3.0, 4.0], "word"), "xdogx": ([0.0, 1.0], "oov"), "zz": (None, None)}


def test_lid_reads_its_sidecar():
    import json

    side = {"labels": ["a", "b"], "label_counts": [3, 1], "words": {"x": 0, "</s>": 1}, "pruneidx": {"5": 0}, "args": {"bucket": 8, "minn": 2, "maxn": 3}}
    model = lid.read_model(json.dumps(side), np.ones((3, 2), np.float32), np.ones((1, 2), np.float32))
    assert (model.bucket, model.low, model.high, model.prune) == (8, 2, 3, {5: 0}) and model.detect("x")[0] in "ab"
    for change in ({"pruneidx": {"5": 1}}, {"words": {"x": 0, "y": 2}}, {"labels": ["a", "b", "c", "d"]}):
        with pytest.raises(ValueError):
            lid.read_model(json.dumps(side | change), np.ones((3, 2), np.float32), np.ones((1, 2), np.float32))


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.createDataFrame([(1, "aa bb"), (2, "cc aa")], "i int, text string")
    rows.write.parquet(str(tmp_path / "in"))
    lex = spark.createDataFrame([("aa",)], "word string")
    stream = spelling.misspelled_stream(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), lex, "i")
    run = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(tmp_path / "out"))
    run.awaitTermination()
    got = {(r.i, r.word) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {(1, "bb"), (2, "cc")} == {(r.i, r.word) for r in spelling.misspelled_stream(rows, lex, "i").collect()}


def test_service(spark, tmp_path):
    from wordflow.streaming import service

    speller = dictionary.Speller(spark, "SET UTF-8\nTRY helo\n", "3\nhello\nworld\nParis\n")
    tier = spark.createDataFrame([("cat", [1.0, 0.0]), ("lion", [1.0, 0.2])], "word string, vec array<double>")
    model = lid.LidModel({"hi": 0, lid.EOS: 1}, np.ones((4, 2), np.float32), np.ones((1, 2), np.float32), ["en", "de"], [2, 1], 2)
    rows = [(1, "s", "check", "Hello wrld paris WRLD x", None, None), (2, "s", "suggest", "hlelo", 1, None), (3, "s", "semantic", "cat", 1, None), (4, "s", "detect", "hi", None, None), (5, "s", "nope", None, None, None),
            (6, "s", "suggest-batch", "wrld", 3, 1), (7, "s", "suggest-batch", "wolrd", 3, 2), (8, "s", "check", None, None, None)]
    ddl = "request_id long, session string, type string, text string, limit int, batch_id long"
    path = str(tmp_path / "in")
    spark.createDataFrame(rows, ddl).coalesce(1).write.parquet(path)
    seen = []
    stream = service.serve(spark.readStream.schema(ddl).parquet(path), lambda events, _: seen.extend(events.collect()), speller, tier, model)
    stream.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    got = {i: [(r["rank"], r.word) for r in sorted((r for r in seen if r.request_id == i), key=lambda r: r["rank"] or 0)] for i in range(1, 9)}
    assert got[1] == [(1, "wrld"), (2, "paris")] and got[2] == [(1, "hello")] and got[3] == [(1, "lion")]
    assert got[6] == [] and got[7] == [(1, "world")] and got[5] == got[8] == [(None, None)]
    assert [r.code for r in seen if r.request_id == 4][0] in ("en", "de") and all(r.type for r in seen)


def test_route_supersedes_batches(spark):
    rows = spark.createDataFrame([("s", 1, "suggest-batch", 1), ("s", 2, "suggest-batch", 2), ("s", 3, "suggest", None)], "session string, request_id int, type string, batch_id int")
    assert [r.request_id for r in spelling.route(rows).orderBy("place").collect()] == [3, 2]


def test_hit_rates_and_latency(spark):
    r = rerank.hit_rates(spark.createDataFrame([(1,), (4,), (None,), (30,)], "rank int")).first()
    assert (r.n, r.top1, r.top5, r.top20) == (4, 0.25, 0.5, 0.5)
    rows = spark.createDataFrame([("a", float(i)) for i in range(1, 11)], "k string, v double")
    s = rerank.latency_stats(rows, "k", "v").first()
    assert (s.p50, s.p95, s.worst) == (6.0, 10.0, 10.0)
    assert rows.where(F.col("v") > 99).count() == 0


def test_ngram_pairs_by_blocks(spark, monkeypatch):
    """All pairs, whatever the blocks, and no join on trigrams that many words share."""
    from wordflow.functions import distance as D
    from wordflow.operators import suggest as S
    from wordflow.operators import trigrams

    r = random.Random(5)
    some = lambda n: {"".join(r.choice(("ing", "ban", "ana", "é", "x", "𝔸")) for _ in range(r.randint(1, 5))) for _ in range(n)}
    q, w = sorted(some(150) | {"aaaa", "x" * 400, "Banana"}), sorted(some(200) | {"aaaaa", "x" * 401, "banana", "BANANA"})
    monkeypatch.setattr(trigrams, "QUERY_ROWS", 40)
    monkeypatch.setattr(trigrams, "WORD_ROWS", 70)
    queries, words = (spark.createDataFrame([(x,) for x in t], "word string") for t in (q, w))
    found = C.ngram_pairs(queries, words)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "gram#" not in plan and "Window" not in plan
    pairs = [(a, b) for a in q for b in w if a != b and min(len(a), len(b)) >= 3]
    jaccard, similarity = D.trigram_jaccard_batch(*map(list, zip(*pairs))), D.typo_similarity_batch(*map(list, zip(*pairs)))
    want = {(a, b): (j, s) for (a, b), j, s in zip(pairs, jaccard.tolist(), similarity.tolist()) if j >= 0.3 and s >= 0.7 and int((1 - j) * 10)}
    got = {(x.query, x.word): (x.jaccard, x.similarity) for x in found.collect()}
    assert len(want) > 300 and got.keys() == want.keys() and all(got[x] == pytest.approx(want[x], abs=1e-12) for x in want)
    cut, whole = S.ngram_strategy(queries, words), S._by_distance(C.ngram_pairs(queries, words), "ngram")
    assert sorted(map(tuple, cut.collect())) == sorted(map(tuple, whole.collect()))


def test_deletion_pairs_stay_packed(spark, monkeypatch):
    """Keys and untested pairs are no rows: nothing is exploded or joined, codes see only pairs within two edits."""
    from wordflow.operators import deletions

    r = random.Random(8)
    made = sorted({"".join(r.choice("abc\U0001d538") for _ in range(r.randint(0, 7))) for _ in range(300)})
    left = deletions.flat(made)
    i, j = np.divmod(np.arange(len(made) ** 2), len(made))
    assert deletions.distances(left, i, left, j).tolist() == [min(3, osa(made[a], made[b])) for a, b in zip(i, j)]
    monkeypatch.setattr(deletions, "PAIRS_AT_ONCE", 50)
    found = C.phonetic_pairs(table(spark, [*made[::2], None]), table(spark, made))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Join" not in plan
    got = {(x.query, x.word, x.distance) for x in C.edit_pairs(table(spark, made[::2]), table(spark, made)).collect()}
    assert got == {(a, b, osa(a, b)) for a in made[::2] for b in made if a != b and osa(a, b) <= 2}
    assert {(x.query, x.word, x.distance) for x in found.collect()} <= got


def test_grammar_counts_each_character_once(monkeypatch):
    """Offsets of a text of many sentences take no encoding of all that lies before each of them."""
    from wordflow.grammar import tagger

    class Text(str):
        def __getitem__(self, at):
            assert not (isinstance(at, slice) and at.start is None), "the text before a sentence was copied"
            return str.__getitem__(self, at)

    text = "Straße is is good. He go it's! " * 50
    assert [e["start"] for e in check(Text(text), load_rules(grammar.english_rules()))] == sorted(e["start"] for e in check(text, load_rules(grammar.english_rules())))
    for at, sentence in tagger.placed(Text(text)):
        assert text.encode()[at : at + len(sentence.encode())].decode() == sentence


def test_grammar_and_language_work_by_pieces(spark, monkeypatch):
    """Rows leave in bounded batches, small tables are dealt over all cores, and sums take bounded pieces."""
    texts = spark.createDataFrame([(i, "He go there. " * 40) for i in range(6)], "doc_id long, text string").coalesce(1)
    whole = grammar.tokens(texts, "doc_id").orderBy("id", "sentence", "idx").collect()
    monkeypatch.setattr(grammar, "ROWS", 7)
    run = grammar._emitted(lambda t: ((w,) for w in t.split()), ["word"], [__import__("pyarrow").string()])
    import pyarrow as pa

    out = list(run(iter([pa.RecordBatch.from_pydict({"id": [1, 2], "text": ["a b c d e f g h i", None]})])))
    assert max(b.num_rows for b in out) <= 7 and sum(b.num_rows for b in out) == 9
    assert grammar.tokens(texts, "doc_id").orderBy("id", "sentence", "idx").collect() == whole
    r = np.random.default_rng(1)
    model = lid.LidModel({"he": 0, lid.EOS: 1}, r.normal(size=(2 + 50, 4)).astype(np.float32), r.normal(size=(1, 4)).astype(np.float32), ["a", "b"], [2, 1], 50)
    found = lid.detect(texts, model, "doc_id")
    assert found.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    plain = model.hidden("he go there " * 60)
    monkeypatch.setattr(lid, "PIECE", 10)
    assert (model.hidden("he go there " * 60) == plain).all()
    rows = model.features("he go there " * 60)
    assert (plain == np.add.reduce(model.rows[rows], axis=0) * np.float32(1 / len(rows))).all()


def test_dictionary_edits_skip_what_no_edit_mends(spark, monkeypatch):
    """The right words a single edit makes are those of the whole sweep; words that stay wrong are not tried out."""
    d = dictionary.Dictionary("SET UTF-8\nTRY einosrt\nCOMPOUNDMIN 2\nCOMPOUNDFLAG C\nPFX R Y 1\nPFX R 0 re .\nSFX S Y 2\nSFX S 0 s [^sy]\nSFX S y ies [^aeiou]y\n", "6\nin/CR\ner/CS\non/C\nparty/S\nMünze\nen/C\n")
    made = ["inxon", "pxrties", "reinon", "erson", "Inern", "parti", "inno", "nier", "éinon", "in-on", "x1", "partes", "oner", ""]
    letters = d.aff.try_
    swap = lambda w, i: w[:i] + w[i + 1] + w[i] + w[i + 2 :]
    found = [d.edits(w) for w in made]
    links, d._links = d._links, None
    for w, got in zip(made, found):
        n = len(w)
        want = {swap(w, i) for i in range(n - 1)} | {w[:i] + w[i + 1 :] for i in range(n)} | {w[:i] + c + w[i + k :] for c in letters for k in (0, 1) for i in range(n + 1 - k)}
        want |= {swap(swap(w, a), b) for a, b in {4: ((0, 2),), 5: ((0, 3), (1, 3))}.get(n, ())}
        assert got == {x for x in want - {w} if d.correct(x)}
    assert sum(map(len, found)) > 5
    d._links, tried = links, []
    monkeypatch.setattr(dictionary.Dictionary, "correct", lambda self, w: tried.append(w))
    d.edits("qqxwqqwxqqwq")
    assert not tried


def test_oov_vectors_stay_rows(spark):
    """Components are no rows, and vectors of unequal lengths count where they have components."""
    tier = spark.createDataFrame([("abc", [1.0, 2.0]), ("bcd", [2.0, 0.0, 4.0]), ("xyz", [0.0, 0.0])], "word string, vec array<float>")
    found = rerank.oov_vector(table(spark, ["abcd", "xyzq", "none"]), tier)
    assert "posexplode" not in found._jdf.queryExecution().executedPlan().toString()
    got = {r.word: r.vec for r in found.collect()}
    assert got["abcd"] == pytest.approx([3 / 29**0.5, 2 / 29**0.5, 4 / 29**0.5]) and got["none"] is None
