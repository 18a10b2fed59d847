"""Every query of the library by name, with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import distance as D
from .functions import edits as E
from .functions import keyboard as K
from .functions import text as T
from .functions import vectors as V
from .operators import candidates as C
from .operators import dictionary, grammar, lid, rerank, suggest, typo
from .operators import lexicon as L
from .sources import artifacts
from .streaming import spelling

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: A small affix table over whatever lexicon there is: every word may take every affix.
AFFIXES = [(0, "SFX", "S", True, "", "s", "[^sy]$"), (1, "SFX", "S", True, "y", "ies", "[^aeiou]y$"), (2, "SFX", "D", True, "", "ed", "[^ey]$"), (3, "SFX", "G", True, "e", "ing", "e$"), (4, "PFX", "R", True, "", "re", "")]

#: Shared SQL: word tokens, lexicon and words of conversations that it lacks.
W = r"[\p{L}\p{M}]+(?:[''’][\p{L}\p{M}]+)*"
BASE = f"""
    tok AS (SELECT doc_id, lang, unnest(regexp_extract_all(text, '{W}')) AS raw FROM documents),
    cnt AS (SELECT lower(raw) AS word, count(*) AS n FROM tok WHERE length(raw) >= 2 GROUP BY 1),
    lex AS (SELECT word, n, row_number() OVER (ORDER BY n DESC, word) AS rank FROM cnt WHERE n >= 3),
    ctok AS (SELECT conv_id, turn, unnest(regexp_extract_all(text, '{W}')) AS raw FROM conversations),
    q AS (SELECT DISTINCT lower(raw) AS word FROM ctok WHERE length(raw) >= 2 AND lower(raw) NOT IN (SELECT word FROM lex))"""


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _deleted(source: str) -> str:
    """SQL: every key of a (word, key) table less one character."""
    return f"SELECT DISTINCT word, key[1:i - 1] || key[i + 1:] AS key FROM (SELECT word, key, unnest(range(1, length(key) + 1)) AS i FROM {source})"


#: Conditions under which two cores (words less their common ends) are two edits apart: one edit
#: at the front, one at the end, the same between. (characters taken from x, from y, condition)
_FRONT = [(1, 1, ""), (1, 0, ""), (0, 1, ""), (2, 2, " AND x[1] = y[2] AND x[2] = y[1]")]
_BACK = [(1, 1, ""), (1, 0, ""), (0, 1, ""), (2, 2, " AND x[length(x)] = y[length(y) - 1] AND x[length(x) - 1] = y[length(y)]")]
_TWO = " OR ".join(f"(length(x) >= {i + k} AND length(y) >= {j + m} AND x[{i + 1}:length(x) - {k}] = y[{j + 1}:length(y) - {m}]{a}{b})" for i, j, a in _FRONT for k, m, b in _BACK)
#: SQL: osa(a, b, d): pairs of an unknown word and a lexicon word with their distance, 3 for more than 2.
EDIT = f"""q0 AS (SELECT word, word AS key FROM q), q1 AS ({_deleted("q0")}), q2 AS ({_deleted("q1")}),
    l0 AS (SELECT word, word AS key FROM lex), l1 AS ({_deleted("l0")}), l2 AS ({_deleted("l1")}),
    qk AS (SELECT * FROM q0 UNION SELECT * FROM q1 UNION SELECT * FROM q2), lk AS (SELECT * FROM l0 UNION SELECT * FROM l1 UNION SELECT * FROM l2),
    cand AS (SELECT DISTINCT qk.word AS a, lk.word AS b FROM qk JOIN lk USING (key) WHERE qk.word <> lk.word),
    pre AS (SELECT a, b, len(list_filter(range(1, least(length(a), length(b)) + 1), lambda i: a[1:i] = b[1:i])) AS p FROM cand),
    suf AS (SELECT a, b, p, len(list_filter(range(1, least(length(a), length(b)) - p + 1), lambda i: right(a, i) = right(b, i))) AS s FROM pre),
    core AS (SELECT a, b, a[p + 1:length(a) - s] AS x, b[p + 1:length(b) - s] AS y FROM suf),
    osa AS (SELECT a, b, CASE WHEN greatest(length(x), length(y)) = 1 OR (length(x) = 2 AND length(y) = 2 AND x[1] = y[2] AND x[2] = y[1]) THEN 1
        WHEN greatest(length(x), length(y)) = 2 OR {_TWO} THEN 2 ELSE 3 END AS d FROM core)"""


def _similarity(a: str, b: str) -> str:
    """SQL: typo similarity of two different, non-empty lower-case words."""
    ends = "len(list_filter(range(1, 5), lambda i: i <= length({a}) AND i <= length({b}) AND {f}))"
    front, back = ends.format(a=a, b=b, f=f"{a}[1:i] = {b}[1:i]"), ends.format(a=a, b=b, f=f"right({a}, i) = right({b}, i)")
    shared = f"len(list_filter(string_split({a}, ''), lambda c: contains({b}, c)))::DOUBLE"
    return f"least(1.0::DOUBLE, greatest(0.0::DOUBLE, {shared} / greatest(length({a}), length({b})) + {front} * 0.15::DOUBLE + {back} * 0.05::DOUBLE - abs(length({a}) - length({b})) * 0.1::DOUBLE))"


_COLLAPSE = "regexp_replace(" * 6 + "{x}" + "".join(f", '{d}+', '{d}', 'g')" for d in "123456")


def _soundex(source: str) -> str:
    """SQL: word, code of a table of words."""
    digits = "translate({l}, 'AEIOUYHWBFPVCGJKQSXZDTLMNR', '00000000111122222222334556')"
    runs = _COLLAPSE.format(x=f"replace({digits.format(l='l')}, '0', '')")
    return f"""SELECT word, CASE WHEN l = '' THEN NULL ELSE rpad((l[1] || CASE WHEN r[1] = c1 THEN r[2:] ELSE r END)[1:4], 4, '0') END AS code
        FROM (SELECT word, l, {digits.format(l="l[1]")} AS c1, {runs} AS r FROM (SELECT word, regexp_replace(replace(upper(word), 'ẞ', 'SS'), '[^A-Z]', '', 'g') AS l FROM {source}))"""


def rounded(column: str, digits: int = 6):
    """Rounded numbers, without negative zeros."""
    return F.round(column, digits) + F.lit(0.0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.lexicon(table(spark, sf_dir, "documents"))


def shared_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lexicon for plans that read it more than once: kept on the executors' disks, its lineage stays."""
    return docs_lexicon(spark, sf_dir).persist(StorageLevel.DISK_ONLY)


def unknown_words(spark: SparkSession, sf_dir: str, lexicon: DataFrame | None = None) -> DataFrame:
    return L.misspelled(table(spark, sf_dir, "conversations"), lexicon if lexicon is not None else docs_lexicon(spark, sf_dir))


@query(f"WITH {BASE} SELECT lang, lower(raw) AS word, count(*)::BIGINT AS n FROM tok WHERE length(raw) >= 2 GROUP BY 1, 2")
def token_counts_by_lang(spark, sf):
    return L.counts(table(spark, sf, "documents"), "lang")


@query(f"WITH {BASE} SELECT lang, word, n, row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) AS rank FROM (SELECT lang, lower(raw) AS word, count(*)::BIGINT AS n FROM tok WHERE length(raw) >= 2 GROUP BY 1, 2) WHERE n >= 3")
def lexicon_ranked(spark, sf):
    return L.lexicon(table(spark, sf, "documents"), "lang")


@query(f"WITH {BASE} SELECT word, n, rank, CASE WHEN rank <= 50 THEN 200 WHEN rank <= 200 THEN 100 WHEN rank <= 1000 THEN 50 ELSE 0 END AS bonus FROM lex")
def frequency_tier_bonus(spark, sf):
    return docs_lexicon(spark, sf).withColumn("bonus", L.tier_bonus(F.col("rank")))


@query(f"WITH {BASE} SELECT word FROM q")
def misspelled_tokens(spark, sf):
    return unknown_words(spark, sf)


@query(f"WITH {BASE} SELECT conv_id, count(DISTINCT lower(raw))::BIGINT AS misspelled FROM ctok WHERE length(raw) >= 2 AND lower(raw) IN (SELECT word FROM q) GROUP BY 1")
def misspelled_per_conversation(spark, sf):
    found = L.misspelled(table(spark, sf, "conversations"), docs_lexicon(spark, sf), "conv_id")
    return found.groupBy("conv_id").agg(F.count("*").alias("misspelled"))


@query("WITH t AS (SELECT unnest(string_split(text, ' ')) AS raw FROM documents) SELECT raw AS word, count(*)::BIGINT AS n FROM t WHERE regexp_full_match(raw, '[0-9]+(\\.[0-9]+)?') GROUP BY 1")
def number_tokens(spark, sf):
    t = table(spark, sf, "documents").select(F.explode(F.split("text", " ")).alias("word"))
    return t.where(T.is_number(F.col("word"))).groupBy("word").agg(F.count("*").alias("n"))


#: DuckDB's upper case of a sharp s is a capital sharp s, Spark's is SS.
_CAP = "CASE WHEN lower(w) = w THEN 'no' WHEN replace(upper(w), 'ẞ', 'SS') = w THEN 'all' WHEN upper(w[1]) = w[1] AND lower(w[1]) <> w[1] AND lower(w[2:]) = w[2:] THEN 'init' WHEN upper(w[1]) = w[1] AND lower(w[1]) <> w[1] THEN 'huhinit' ELSE 'huh' END"


@query(f"WITH {BASE}, d AS (SELECT DISTINCT raw AS w FROM tok) SELECT {_CAP} AS captype, count(*)::BIGINT AS n FROM d GROUP BY 1")
def capitalization_types(spark, sf):
    d = L.tokens(table(spark, sf, "documents")).distinct()
    return d.groupBy(T.captype(F.col("word")).alias("captype")).agg(F.count("*").alias("n"))


@query(f"""WITH {BASE}, d AS (SELECT DISTINCT raw AS w FROM tok), k AS (SELECT w, {_CAP} AS c FROM d),
    v AS (SELECT w, unnest(CASE c WHEN 'init' THEN [w, lower(w)] WHEN 'huhinit' THEN [w, lower(w[1]) || w[2:]] WHEN 'all' THEN [w, lower(w), upper(lower(w)[1]) || lower(w)[2:]] ELSE [w] END) AS variant FROM k)
    SELECT w AS word, variant FROM v GROUP BY 1, 2""")
def case_variants(spark, sf):
    d = L.tokens(table(spark, sf, "documents")).distinct()
    return d.select("word", F.explode(T.case_variants(F.col("word"))).alias("variant"))


@query(f"WITH {BASE} {_soundex('lex')}")
def soundex_codes(spark, sf):
    return docs_lexicon(spark, sf).select("word", T.soundex(F.col("word")).alias("code"))


@query(f"WITH {BASE} SELECT word AS query, unnest(list_transform(range(1, length(word) + 1), lambda i: word[1:i - 1] || word[i + 1:])) AS variant FROM q")
def edit_deletes(spark, sf):
    return unknown_words(spark, sf).select(F.col("word").alias("query"), F.explode(E.extra_char(F.col("word"))).alias("variant"))


@query(f"WITH {BASE} SELECT word AS query, unnest(list_transform(range(1, length(word)), lambda i: word[1:i - 1] || word[i + 1] || word[i] || word[i + 2:])) AS variant FROM q")
def edit_swaps(spark, sf):
    return unknown_words(spark, sf).select(F.col("word").alias("query"), F.explode(E.transpositions(F.col("word"))).alias("variant"))


_SWEEP = """abc AS (SELECT DISTINCT unnest(string_split(word, '')) AS c FROM lex), r AS (SELECT word, c FROM q CROSS JOIN abc),
    v AS (SELECT word, word[1:i - 1] || c || word[i + 1:] AS v FROM (SELECT word, c, unnest(range(1, length(word) + 1)) AS i FROM r)
        UNION SELECT word, word[1:i - 1] || c || word[i:] FROM (SELECT word, c, unnest(range(1, length(word) + 2)) AS i FROM r)
        UNION SELECT word, word[1:i - 1] || word[i + 1:] FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM q)
        UNION SELECT word, word[1:i - 1] || word[i + 1] || word[i] || word[i + 2:] FROM (SELECT word, unnest(range(1, length(word))) AS i FROM q)
        UNION SELECT word, word[2] || word[1] || word[4] || word[3] FROM q WHERE length(word) = 4
        UNION SELECT word, word[2] || word[1] || word[3] || word[5] || word[4] FROM q WHERE length(word) = 5
        UNION SELECT word, word[1] || word[3] || word[2] || word[5] || word[4] FROM q WHERE length(word) = 5)"""


@query(f"WITH {BASE}, {_SWEEP} SELECT word AS query, v AS word FROM v WHERE v <> word AND v IN (SELECT word FROM lex)")
def edit_sweep_hits(spark, sf):
    lex = shared_lexicon(spark, sf)
    return C.edit_sweep(unknown_words(spark, sf, lex), lex).select("query", "word")


@query(f"WITH {BASE}, {EDIT} SELECT a AS query, b AS word, d::INTEGER AS distance FROM osa WHERE d <= 2")
def edit_candidates(spark, sf):
    lex = shared_lexicon(spark, sf)
    return C.edit_pairs(unknown_words(spark, sf, lex), lex)


_DEL = "SELECT word, i, word[1:i - 1] || word[i + 1:] AS key FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM {t})"


@query(f"""WITH {BASE}, k AS ({_DEL.format(t="lex")}), p AS ({_DEL.format(t="q")}),
    s AS (SELECT word, word[1:i - 1] || word[i + 1] || word[i] || word[i + 2:] AS key FROM (SELECT word, unnest(range(1, length(word))) AS i FROM q)),
    r AS (SELECT p.word AS query, k.word FROM p JOIN k USING (i, key) WHERE length(p.word) = length(k.word)
        UNION SELECT p.word, lex.word FROM p JOIN lex ON p.key = lex.word UNION SELECT q.word, k.word FROM k JOIN q ON k.key = q.word
        UNION SELECT s.word, lex.word FROM s JOIN lex ON s.key = lex.word)
    SELECT query, word, 1 AS distance FROM r WHERE query <> word""")
def osa_within_1(spark, sf):
    lex = shared_lexicon(spark, sf)
    return C.edit_pairs(unknown_words(spark, sf, lex), lex, 1)


_SRC, _DST = T._folds()
_PLAIN = f"regexp_replace(translate(word, '{_SRC}', '{_DST}'), '{T.VOWEL_MARKS}', '', 'g')"


@query(f"""WITH {BASE}, u AS (SELECT word, list_transform(string_split({_PLAIN}, ''), lambda c: CASE WHEN c = 'ß' THEN 'ss' ELSE c END) AS f FROM lex),
    k AS (SELECT word, word[1:i - 1] || word[i + 1:] AS key FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM lex)
        UNION SELECT word, word[1:i - 1] || word[i + 1] || word[i] || word[i + 2:] FROM (SELECT word, unnest(range(1, length(word))) AS i FROM lex) WHERE word[i] <> word[i + 1]
        UNION SELECT word, array_to_string(list_concat(f[1:i - 1], f[i + 1:]), '') FROM (SELECT word, f, unnest(range(1, len(f) + 1)) AS i FROM u WHERE array_to_string(f, '') <> word))
    SELECT key, word FROM k WHERE key <> ''""")
def deletion_index(spark, sf):
    return C.deletion_index(docs_lexicon(spark, sf))


@query()
def symspell_slate(spark, sf):
    lex = shared_lexicon(spark, sf)
    return C.symspell_slate(unknown_words(spark, sf, lex), lex)


@query(f"""WITH {BASE}, {EDIT}, code AS ({_soundex("(SELECT word FROM q UNION SELECT word FROM lex)")})
    SELECT a AS query, b AS word, d::INTEGER AS distance FROM osa JOIN code x ON x.word = a JOIN code y ON y.word = b WHERE d <= 2 AND x.code IS NOT DISTINCT FROM y.code""")
def phonetic_candidates(spark, sf):
    lex = shared_lexicon(spark, sf)
    return C.phonetic_pairs(unknown_words(spark, sf, lex), lex)


_GRAMS = "SELECT word, word[i:i + 2] AS gram, count(*) AS c FROM (SELECT word, unnest(range(1, length(word) - 1)) AS i FROM {t} WHERE length(word) >= 3) GROUP BY 1, 2"


@query(f"""WITH {BASE}, g AS ({_GRAMS.format(t="q")}), h AS ({_GRAMS.format(t="lex")}),
    b AS (SELECT g.word AS a, h.word AS b, sum(least(g.c, h.c)) AS n FROM g JOIN h USING (gram) WHERE g.word <> h.word GROUP BY 1, 2),
    j AS (SELECT a, b, n::DOUBLE / (length(a) + length(b) - 4 - n) AS jaccard FROM b),
    r AS (SELECT a, b, jaccard, {_similarity("a", "b")} AS similarity, floor((1.0::DOUBLE - jaccard) * 10)::INTEGER AS distance FROM j WHERE jaccard >= 0.3::DOUBLE)
    SELECT a AS query, b AS word, round(jaccard, 6) AS jaccard, round(similarity, 6) AS similarity, distance FROM r WHERE similarity >= 0.7::DOUBLE AND distance <> 0""")
def ngram_candidates(spark, sf):
    lex = shared_lexicon(spark, sf)
    found = C.ngram_pairs(unknown_words(spark, sf, lex), lex)
    return found.withColumn("jaccard", F.round("jaccard", 6)).withColumn("similarity", F.round("similarity", 6))


@query(f"""WITH {BASE}, k AS (SELECT word, unnest(list_transform(range(1, length(word) + 1), lambda i: word[1:i - 1] || word[i + 1:])) AS key FROM lex),
    p AS (SELECT word AS query, unnest(list_transform(range(1, length(word) + 1), lambda i: word[1:i - 1] || word[i + 1:])) AS key FROM q),
    c AS (SELECT DISTINCT query, word FROM p JOIN k USING (key)),
    m AS (SELECT query, word, len(list_filter(string_split(query, ''), lambda x: contains(word, x))) AS shared,
        greatest(length(query), length(word)) AS longest, abs(length(query) - length(word)) AS gap,
        len(list_filter(range(1, 5), lambda i: i <= length(query) AND i <= length(word) AND query[1:i] = word[1:i])) AS front,
        len(list_filter(range(1, 5), lambda i: i <= length(query) AND i <= length(word) AND right(query, i) = right(word, i))) AS back FROM c)
    SELECT query, word, round(least(1.0::DOUBLE, greatest(0.0::DOUBLE, shared::DOUBLE / longest + front * 0.15::DOUBLE + back * 0.05::DOUBLE - gap * 0.1::DOUBLE)), 6) AS similarity FROM m""")
def typo_similarity(spark, sf):
    """Of the pairs that share a word less one letter."""
    lex = shared_lexicon(spark, sf)
    q = unknown_words(spark, sf, lex).select(F.col("word").alias("query"), F.explode(E.extra_char(F.col("word"))).alias("key"))
    k = lex.select("word", F.explode(E.extra_char(F.col("word"))).alias("key"))
    pairs = q.join(k, "key").select("query", "word").distinct()
    return pairs.select("query", "word", F.round(D.typo_similarity(F.col("query"), F.col("word")), 6).alias("similarity"))


_GRID = ", ".join(f"({chr(39)}{c.replace(chr(39), chr(39) * 2)}{chr(39)}, {r}, {i})" for r, keys in enumerate(K.ROWS) for i, c in enumerate(keys))


@query(f"""WITH {BASE}, g(k, r, c) AS (VALUES {_GRID}),
    b AS (SELECT raw AS word, unnest(range(1, length(raw))) AS i FROM (SELECT DISTINCT lower(raw) AS raw FROM tok)),
    p AS (SELECT DISTINCT word[i] AS a, word[i + 1] AS b FROM b)
    SELECT a, b, abs(x.r - y.r) + abs(x.c - y.c) AS distance FROM p LEFT JOIN g x ON a = x.k LEFT JOIN g y ON b = y.k""")
def keyboard_distance(spark, sf):
    """Between all letters that follow each other."""
    w = L.tokens(table(spark, sf, "documents")).select(F.lower("word").alias("word")).distinct()
    pairs = w.select(F.explode(T.grams(F.col("word"), 2)).alias("g")).select(F.left("g", F.lit(1)).alias("a"), F.right("g", F.lit(1)).alias("b")).distinct()
    return pairs.select("a", "b", K.distance(F.col("a"), F.col("b")).cast("int").alias("distance"))


_quoted = lambda x: "'" + x.replace("'", "''") + "'"
_NEAR = ", ".join(f"({_quoted(k)}, {_quoted(n)})" for k, near in K.NEIGHBOURS.items() for n in near)


@query(f"""WITH {BASE}, near(k, n) AS (VALUES {_NEAR}), p AS (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM q),
    m AS (SELECT word, i, n FROM p JOIN near ON k = lower(word[i]))
    SELECT word AS query, word[1:i - 1] || word[i + 1:] AS variant FROM m UNION SELECT word, word[1:i - 1] || n || word[i + 1:] FROM m UNION SELECT word, word[1:i - 1] || n || word[i:] FROM m
    UNION SELECT word, word[1:i - 1] || word[i + 1] || word[i] || word[i + 2:] FROM p WHERE i < length(word)""")
def keyboard_variants(spark, sf):
    """One round of keyboard mutations of every unknown word."""
    q = unknown_words(spark, sf).select(F.col("word").alias("query"), F.col("word").alias("variant"))
    return C.keyboard_round(q)


_CHARS = "SELECT a, b, unnest(range(1, length(a) + 1)) AS i FROM osa WHERE length(a) = length(b) AND d <= 2"
_DOUBLED = "length({l}) = length({s}) + 1 AND len(list_filter(range(1, length({l})), lambda i: {l}[i] = {l}[i + 1] AND {l}[1:i] || {l}[i + 2:] = {s})) > 0"


@query(f"""WITH {BASE}, {EDIT}, grid(k, r, c) AS (VALUES {_GRID}),
    pos AS ({_CHARS}),
    pen AS (SELECT a, b, sum(CASE WHEN a[i] = b[i] THEN 0 WHEN g.k IS NULL OR h.k IS NULL THEN 50 WHEN abs(g.r - h.r) + abs(g.c - h.c) = 1 THEN 10 WHEN abs(g.r - h.r) + abs(g.c - h.c) = 2 THEN 30 ELSE 100 END) AS penalty
        FROM pos LEFT JOIN grid g ON g.k = a[i] LEFT JOIN grid h ON h.k = b[i] GROUP BY 1, 2),
    later AS (SELECT a, b, i, position(a[i] IN b[i + 1:]) AS n FROM pos WHERE a[i] <> b[i]),
    cross_ AS (SELECT a, b, count(*) AS n FROM later WHERE n > 0 AND (n = 1 OR (i + n <= length(a) AND a[i + n] = b[i])) GROUP BY 1, 2),
    s AS (SELECT osa.a, osa.b, d, d::DOUBLE * 1000 - CASE WHEN rank <= 50 THEN 200 WHEN rank <= 200 THEN 100 WHEN rank <= 1000 THEN 50 ELSE 0 END + coalesce(penalty, 0)
            - CASE WHEN cross_.n = 1 THEN 200 ELSE 100 * coalesce(cross_.n, 0) END
            - CASE WHEN {_DOUBLED.format(s="osa.a", l="osa.b")} THEN 300 ELSE 0 END - CASE WHEN length(osa.b) > length(osa.a) AND starts_with(osa.a, osa.b[1:3]) THEN 30 ELSE 0 END
            + abs(length(osa.a) - length(osa.b)) * 50 AS score
        FROM osa LEFT JOIN lex ON lex.word = osa.b LEFT JOIN pen ON pen.a = osa.a AND pen.b = osa.b LEFT JOIN cross_ ON cross_.a = osa.a AND cross_.b = osa.b
        WHERE d <= 2 AND (NOT regexp_full_match(osa.a, '\\p{{L}}*') OR regexp_full_match(osa.b, '\\p{{L}}*'))),
    e AS (SELECT *, min(score) OVER (PARTITION BY a) AS low, max(score) OVER (PARTITION BY a) AS high FROM s)
    SELECT a AS query, b AS word, d::INTEGER AS distance, score, round(CASE WHEN high > low THEN 1.0::DOUBLE - (score - low) / (high - low) ELSE 1.0::DOUBLE END, 6) AS confidence, round({_similarity("a", "b")}, 6) AS similarity FROM e""")
def edit_confidence(spark, sf):
    lex = shared_lexicon(spark, sf)
    found = suggest.edit_confidence(unknown_words(spark, sf, lex), lex, lex)
    return found.withColumn("confidence", F.round("confidence", 6)).withColumn("similarity", F.round("similarity", 6))


_FORM = "SELECT word, stem, {p} AS prefix, id AS suffix FROM (SELECT word, rest[1:length(rest) - length(a_add)] || strip AS stem, id, cond{q} FROM {t} JOIN a ON kind = 'SFX' AND right(rest, length(a_add)) = a_add) WHERE (cond = '' OR regexp_matches(stem, cond))"


@query(f"""WITH {BASE}, a(id, kind, flag, cross_, strip, a_add, cond) AS (VALUES {", ".join(f"({i}, '{k}', '{f}', true, '{s}', '{d}', '{c}')" for i, k, f, _, s, d, c in AFFIXES)}),
    w AS (SELECT word, word AS rest FROM q), p AS (SELECT word, rest[length(a_add) + 1:] AS rest, id AS pid FROM w JOIN a ON kind = 'PFX' AND starts_with(rest, a_add)),
    f AS ({_FORM.format(p="NULL::INTEGER", q="", t="w")} UNION SELECT word, rest, pid, NULL FROM p UNION {_FORM.format(p="pid", q=", pid", t="p")})
    SELECT DISTINCT word, stem, prefix, suffix FROM f WHERE stem IN (SELECT word FROM lex)""")
def affix_analyses(spark, sf):
    lex = shared_lexicon(spark, sf)
    entries = lex.select(F.col("word").alias("stem"), F.array(*[F.lit(x) for x in "SDGR"]).alias("flags"))
    affixes = spark.createDataFrame([(*a, []) for a in AFFIXES], "affix_id int, kind string, flag string, crossproduct boolean, strip string, add string, cond_regex string, cont_flags array<string>")
    return dictionary.analyses(unknown_words(spark, sf, lex), entries, affixes)


#: A dictionary of invented roots with affixes, compounds and breaks.
DEMO_AFF = "SET UTF-8\nTRY esianrtolcdugmphbyfvkw\nCOMPOUNDMIN 2\nCOMPOUNDFLAG C\nCHECKCOMPOUNDDUP\nPFX R Y 1\nPFX R 0 re .\nSFX S Y 2\nSFX S 0 s [^sy]\nSFX S y ies [^aeiou]y\n"
DEMO_DIC = "8\nthe/C\nand\nin/CR\ner/CS\non/C\ntion/CS\nen/C\nre/C\n"


@query(f"""WITH {BASE}, c AS (SELECT word, unnest(range(3, length(word) - 2)) AS k FROM q)
    SELECT c.word, a.word AS head, b.word AS tail FROM c JOIN lex a ON c.word[1:k] = a.word JOIN lex b ON c.word[k + 1:] = b.word""")
def two_part_compounds(spark, sf):
    """Unknown words that two lexicon words of three letters or more make up."""
    lex = shared_lexicon(spark, sf)
    w, k = F.col("word"), F.col("k")
    cuts = unknown_words(spark, sf, lex).where("length(word) >= 6").select("word", F.explode(F.sequence(F.lit(3), F.length(w) - 3)).alias("k"))
    cuts = cuts.select("word", F.left(w, k).alias("head"), F.substring(w, k + 1, F.length(w)).alias("tail"))
    return cuts.join(lex.select(F.col("word").alias("head")), "head", "left_semi").join(lex.select(F.col("word").alias("tail")), "tail", "left_semi").select("word", "head", "tail")


@query()
def compound_check(spark, sf):
    return dictionary.correct(L.tokens(table(spark, sf, "conversations")), DEMO_AFF, DEMO_DIC)


@query(f"""WITH {BASE}, b AS (SELECT word, list_transform(range(1, strlen(word) + 1), lambda i: ('0x' || hex(word)[2 * i - 1:2 * i])::BIGINT) AS bytes FROM lex)
    SELECT word, list_reduce(list_prepend(2166136261::BIGINT, bytes), lambda h, x: (xor(h, CASE WHEN x > 127 THEN x + 4294967040 ELSE x END) * 16777619) & 4294967295) AS hash FROM b""")
def fnv_hash(spark, sf):
    return docs_lexicon(spark, sf).select("word", T.fnv1a(F.col("word")).alias("hash"))


@query(f"WITH {BASE} SELECT word, unnest(list_distinct(flatten(list_transform(range(3, 7), lambda n: list_transform(range(1, greatest(length(word) - n + 2, 1)), lambda i: word[i:i + n - 1]))))) AS gram FROM lex")
def substring_ngrams(spark, sf):
    return docs_lexicon(spark, sf).select("word", F.explode(T.substring_grams(F.col("word"))).alias("gram"))


@query()
def suggest_legacy(spark, sf):
    """The four strategies ranked together."""
    lex = shared_lexicon(spark, sf)
    return suggest.suggest(unknown_words(spark, sf, lex), lex.select("word"))


@query()
def keyboard_candidates(spark, sf):
    lex = shared_lexicon(spark, sf)
    return C.keyboard_pairs(unknown_words(spark, sf, lex), lex)


def _tier(spark, sf):
    return rerank.tier(table(spark, sf, "embeddings"), docs_lexicon(spark, sf))


#: Squares of single-precision components, summed in double, as in ``vectors.cosine``.
_COS, _NORM = "list_inner_product(a.v, b.v) / (a.norm * b.norm)", "sqrt(list_sum(list_transform(embedding, lambda x: (x * x)::DOUBLE))) AS norm"


@query(f"""WITH {BASE}, t AS (SELECT word, embedding::DOUBLE[] AS v, {_NORM} FROM lex JOIN embeddings ON rank - 1 = vec_id),
    s AS (SELECT a.word AS query, b.word, round({_COS}, 4) AS score, {_COS} AS exact FROM t a JOIN t b ON a.word <> b.word),
    r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY exact DESC, word)::INTEGER AS rank FROM s)
    SELECT query, rank, word, score FROM r WHERE rank <= 5""")
def semantic_neighbors(spark, sf):
    tier = _tier(spark, sf)
    return rerank.semantic_neighbors(tier, tier).withColumn("score", F.round("score", 4))


@query(f"""WITH {BASE}, t AS (SELECT word, rank, embedding::DOUBLE[] AS v, {_NORM} FROM lex JOIN embeddings ON rank - 1 = vec_id)
    SELECT a.word AS word, b.word AS other, round({_COS}, 6) AS similarity FROM t a JOIN t b ON b.rank = a.rank + 1""")
def word_similarity(spark, sf):
    """Of neighbours in rank."""
    lex = docs_lexicon(spark, sf)
    tier = rerank.tier(table(spark, sf, "embeddings"), lex).withColumn("vec", F.col("vec").cast("array<double>"))
    a = tier.select("word", "row_id", F.col("vec").alias("v"))
    b = tier.select(F.col("word").alias("other"), (F.col("row_id") - 1).alias("row_id"), F.col("vec").alias("u"))
    return a.join(b, "row_id").select("word", "other", F.round(V.cosine(F.col("v"), F.col("u")), 6).alias("similarity"))


_REGISTRY = '{"spec": "x.resources/v1", "resources": {"en-mini": {"language": "en", "tier": "mini", "sha256": "AB12", "url": "u"}, "de-mini": {"language": "de", "tier": "mini", "sha256": "cd", "url": "v"}}}'


@query("SELECT * FROM (VALUES ('en-mini', 'en', 'mini', 'ab12', 'u'), ('de-mini', 'de', 'mini', 'cd', 'v')) t(id, language, tier, sha256, url)")
def registry_resolve(spark, sf):
    return artifacts.resolve(spark.createDataFrame([(_REGISTRY,), ('{"spec": "other"}',)], "registry string"))


@query("""WITH s AS (SELECT vec_id, embedding::DOUBLE[] AS v, list_max(list_transform(embedding, lambda x: abs(x)))::DOUBLE / 127 AS scale FROM embeddings)
    SELECT vec_id, list_transform(v, lambda x: round(x / scale)::INTEGER) AS q, round(scale, 9) AS scale FROM s""")
def int8_quantize(spark, sf):
    e = table(spark, sf, "embeddings").withColumn("embedding", F.col("embedding").cast("array<double>"))
    return e.select("vec_id", V.int8_quantize(F.col("embedding")).alias("q"), F.round(V.int8_scale(F.col("embedding")), 9).alias("scale"))


@query("""WITH s AS (SELECT vec_id, embedding::DOUBLE[] AS v, list_max(list_transform(embedding, lambda x: abs(x)))::DOUBLE / 127 AS scale FROM embeddings),
    e AS (SELECT vec_id, list_transform(v, lambda x: abs(x - round(x / scale) * scale)) AS err, scale FROM s)
    SELECT vec_id, list_max(err) <= scale / 2 + 1e-12 AS within FROM e""")
def int8_dequantize(spark, sf):
    e = table(spark, sf, "embeddings").withColumn("v", F.col("embedding").cast("array<double>"))
    e = e.withColumn("scale", V.int8_scale(F.col("v"))).withColumn("back", V.int8_dequantize(V.int8_quantize(F.col("v")), F.col("scale")))
    worst = F.array_max(F.zip_with("v", "back", lambda x, y: F.abs(x - y)))
    return e.select("vec_id", (worst <= F.col("scale") / 2 + 1e-12).alias("within"))


def _contexts(spark, sf):
    """Each turn as query, the turns around it as context."""
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, sf, "conversations")
    return c.select("conv_id", "turn", F.lag("text").over(w).alias("before"), F.lead("text").over(w).alias("after"))


_CW = r"[\p{L}\p{N}]+(?:[''’\-][\p{L}\p{N}]+)*"
_CTX = f"""c AS (SELECT conv_id, turn, coalesce(regexp_extract_all(lag(text) OVER w, '{_CW}'), []) AS b, coalesce(regexp_extract_all(lead(text) OVER w, '{_CW}'), []) AS a
        FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
    x AS (SELECT conv_id, turn, list_transform(list_concat(b[greatest(len(b) - 2, 1):], a[1:3]), lambda s: lower(s)) AS context FROM c)"""


@query(f"WITH {_CTX} SELECT conv_id, turn, context FROM x")
def context_window_words(spark, sf):
    return _contexts(spark, sf).select("conv_id", "turn", rerank.context_words(F.col("before"), F.col("after")).alias("context"))


@query(f"""WITH {BASE}, {_CTX}, t AS (SELECT word, embedding::DOUBLE[] AS v, {_NORM} FROM lex JOIN embeddings ON rank - 1 = vec_id),
    m AS (SELECT conv_id, turn, context, lower(regexp_extract(text, '{_CW}')) AS word FROM x JOIN conversations USING (conv_id, turn)),
    e AS (SELECT conv_id, turn, word, unnest(context) AS cw FROM m),
    s AS (SELECT conv_id, turn, avg({_COS}) AS mean FROM e JOIN t a ON a.word = e.word JOIN t b ON b.word = cw GROUP BY 1, 2)
    SELECT conv_id, turn, round(coalesce(mean, 0), 6) AS mean FROM m LEFT JOIN s USING (conv_id, turn)""")
def context_score(spark, sf):
    """Mean cosine of each turn's first word with the words around the turn."""
    first = table(spark, sf, "conversations").select("conv_id", "turn", F.lower(F.regexp_extract("text", T.CONTEXT_WORD, 0)).alias("word"))
    rows = _contexts(spark, sf).select("conv_id", "turn", rerank.context_words(F.col("before"), F.col("after")).alias("context")).join(first, ["conv_id", "turn"])
    tier = _tier(spark, sf)
    tier = tier.withColumn("vec", F.col("vec").cast("array<double>"))
    return rerank.context_score(rows, tier, "word", "context", "conv_id", "turn").select("conv_id", "turn", F.round("mean", 6).alias("mean"))


@query(f"""WITH {BASE}, {_CTX}, m AS (SELECT conv_id, turn, lower(regexp_extract(text, '{_CW}')) AS word, context FROM x JOIN conversations USING (conv_id, turn))
    SELECT conv_id, count(*)::BIGINT AS n, avg(CASE WHEN list_contains(context, word) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS share FROM m GROUP BY 1""")
def first_word_in_context(spark, sf):
    """How often a turn's first word is among the words around it, by conversation."""
    first = table(spark, sf, "conversations").select("conv_id", "turn", F.lower(F.regexp_extract("text", T.CONTEXT_WORD, 0)).alias("word"))
    rows = _contexts(spark, sf).select("conv_id", "turn", rerank.context_words(F.col("before"), F.col("after")).alias("context")).join(first, ["conv_id", "turn"])
    return rows.groupBy("conv_id").agg(F.count("*").alias("n"), F.avg(F.array_contains("context", F.col("word")).cast("double")).alias("share"))


#: SQL: t (word, v, norm) is the tier; of parts (word, v) the unit sum of each word's vectors.
_TIER = f"t AS (SELECT word, rank, embedding::DOUBLE[] AS v, {_NORM} FROM lex JOIN embeddings ON rank - 1 = vec_id)"
_UNIT = """dims AS (SELECT word, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM parts), sums AS (SELECT word, i, sum(x) AS x FROM dims GROUP BY 1, 2),
    unit AS (SELECT word, sqrt(sum(x * x)) AS n, list(x ORDER BY i) AS v FROM sums GROUP BY 1)
    SELECT q.word, CASE WHEN n > 0 THEN list_transform(unit.v, lambda x: round(x / n, 6) + 0.0::DOUBLE) END AS vec FROM q LEFT JOIN unit USING (word)"""
_SUBSTRINGS = "SELECT DISTINCT word, {w}[i:i + n - 1] AS gram FROM (SELECT word, n, unnest(range(1, length({w}) - n + 2)) AS i FROM (SELECT word, unnest(range(3, 7)) AS n FROM q) WHERE length({w}) >= n)"


def _round_all(found: DataFrame) -> DataFrame:
    return found.select("word", F.transform("vec", lambda x: rounded(x)).alias("vec"))


@query(f"WITH {BASE}, {_TIER}, g AS ({_SUBSTRINGS.format(w='word')}), parts AS (SELECT g.word, t.v FROM g JOIN t ON t.word = gram), {_UNIT}")
def oov_embedding(spark, sf):
    lex = shared_lexicon(spark, sf)
    return _round_all(rerank.oov_vector(unknown_words(spark, sf, lex), rerank.tier(table(spark, sf, "embeddings"), lex)))


#: Buckets of the demonstration: as many as the smaller tables have vectors.
BUCKETS = 500
_FNV = "list_reduce(list_prepend(2166136261::BIGINT, list_transform(range(1, strlen(gram) + 1), lambda i: ('0x' || hex(gram)[2 * i - 1:2 * i])::BIGINT)), lambda h, x: (xor(h, CASE WHEN x > 127 THEN x + 4294967040 ELSE x END) * 16777619) & 4294967295)"


@query(f"""WITH {BASE}, {_TIER}, g AS ({_SUBSTRINGS.format(w="word")}), m AS ({_SUBSTRINGS.format(w="('<' || word || '>')")}),
    hashed AS (SELECT word, {_FNV} % {BUCKETS} AS id FROM m),
    parts AS (SELECT g.word, t.v FROM g JOIN t ON t.word = gram UNION ALL SELECT word, embedding::DOUBLE[] FROM hashed JOIN embeddings ON id = vec_id), {_UNIT}""")
def bucket_oov(spark, sf):
    """Vectors of unknown words from known parts and from hash buckets."""
    lex, vectors = shared_lexicon(spark, sf), table(spark, sf, "embeddings")
    buckets = vectors.select(F.col("vec_id").alias("bucket_id"), F.col("embedding").alias("vec"))
    return _round_all(rerank.oov_vector(unknown_words(spark, sf, lex), rerank.tier(vectors, lex), artifacts.check_buckets(buckets.where(F.col("bucket_id") < BUCKETS), BUCKETS), BUCKETS))


@query(f"""WITH {BASE}, {_TIER}, x AS (SELECT word, list_max(list_transform(v, lambda x: abs(x))) / 127 AS scale FROM t),
    i AS (SELECT t.word, v, norm, scale, list_transform(v, lambda x: round(x / scale)) AS q8 FROM t JOIN x USING (word)),
    s AS (SELECT a.word AS query, b.word, list_inner_product(a.q8, b.q8) * a.scale * b.scale AS dot, {_COS} AS cosine FROM i a JOIN i b ON a.word <> b.word),
    slate AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY dot DESC, word) AS place FROM s),
    r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY cosine DESC, place)::INTEGER AS rank FROM slate WHERE place <= 20)
    SELECT query, rank, word, round(cosine, 6) + 0.0::DOUBLE AS score FROM r WHERE rank <= 5""")
def typo_rescored(spark, sf):
    tier = _tier(spark, sf).withColumn("vec", F.col("vec").cast("array<double>"))
    return typo.rescore(typo.slate(tier, typo.index(tier)), tier).withColumn("score", rounded("score"))


@query()
def grammar_tokens(spark, sf):
    return grammar.tokens(table(spark, sf, "documents"), "doc_id")


@query()
def grammar_errors(spark, sf):
    return grammar.errors(table(spark, sf, "documents"), "doc_id", grammar.english_rules())


@query("WITH s AS (SELECT doc_id, unnest(regexp_extract_all(text, '[^.!?]*[.!?]|[^.!?]+$')) AS s FROM documents) SELECT doc_id, count(*)::BIGINT AS n, sum(strlen(s))::BIGINT AS bytes FROM s GROUP BY 1")
def grammar_sentences(spark, sf):
    s = table(spark, sf, "documents").select("doc_id", F.explode(T.sentences(F.col("text"))).alias("s"))
    return s.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.octet_length("s")).alias("bytes"))


@query("SELECT event_type, count(*)::BIGINT AS n, avg(value) AS avg, list_sort(list(value))[(count(*) // 2 + 1)::BIGINT] AS p50, list_sort(list(value))[ceil(count(*) * 0.95)::BIGINT] AS p95, max(value) AS worst FROM events WHERE value IS NOT NULL GROUP BY 1")
def latency_stats(spark, sf):
    return rerank.latency_stats(table(spark, sf, "events"), "event_type", "value")


@query("SELECT doc_id, sha256(text) AS digest FROM documents")
def content_digest(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*)::BIGINT AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def events_tumbling(spark, sf):
    return spelling.windowed_counts(table(spark, sf, "events")).withColumn("total", F.round("total", 4))


@query("""WITH o AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM o)
    SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*)::BIGINT AS n FROM s GROUP BY user_id, k""")
def events_sessions(spark, sf):
    return spelling.session_counts(table(spark, sf, "events"))


@query()
def suggest_ranked(spark, sf):
    """The frequency slate, filled up by the four strategies."""
    lex = shared_lexicon(spark, sf)
    return suggest.suggest(unknown_words(spark, sf, lex), lex, lexicon=lex)


_ROWS = f"{BASE}, {_TIER}, s AS (SELECT a.word AS query, a.rank AS place, b.word, {_COS} AS score FROM t a JOIN t b ON a.word <> b.word), n AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, word) AS rank FROM s)"


@query(f"""WITH {_ROWS}, g AS (SELECT a.word AS query, b.word FROM t a JOIN t b ON b.rank = a.rank + 1), h AS (SELECT CASE WHEN n.rank <= 20 THEN n.rank END AS rank FROM g JOIN n USING (query, word))
    SELECT count(*)::BIGINT AS n, avg(CASE WHEN rank <= 1 THEN 1.0::DOUBLE ELSE 0 END) AS top1, avg(CASE WHEN rank <= 5 THEN 1.0::DOUBLE ELSE 0 END) AS top5, avg(CASE WHEN rank <= 20 THEN 1.0::DOUBLE ELSE 0 END) AS top20 FROM h""")
def hit_at_k(spark, sf):
    """How often the next word in rank is among the 1, 5 and 20 nearest."""
    tier = _tier(spark, sf)
    gold = tier.select(F.col("word").alias("query"), "row_id").join(tier.select("word", (F.col("row_id") - 1).alias("row_id")), "row_id").select("query", "word")
    return rerank.hit_rates(gold.join(rerank.semantic_neighbors(tier, tier, 20), ["query", "word"], "left"))


@query(f"""WITH {_ROWS}, d AS (SELECT query, replace(upper(word), 'ẞ', 'SS') AS word FROM n WHERE rank = 2)
    SELECT query, 1 AS rank, word, 0.9::DOUBLE AS confidence FROM d
    UNION ALL SELECT query, (1 + row_number() OVER (PARTITION BY query ORDER BY rank))::INTEGER, word, round(least(greatest(score, 0.0::DOUBLE), 1.0::DOUBLE), 6) + 0.0::DOUBLE FROM n WHERE rank <= 5 AND rank <> 2""")
def semantic_merge(spark, sf):
    """The second neighbour in capitals as the dictionary's answer, then the neighbours that are not it."""
    tier = _tier(spark, sf)
    near = rerank.semantic_neighbors(tier, tier).persist(StorageLevel.DISK_ONLY)
    said = near.where("rank = 2").select("query", F.lit(1).alias("rank"), F.upper("word").alias("word"), F.lit(0.9).alias("confidence"))
    return rerank.semantic_merge(said, near).withColumn("confidence", rounded("confidence"))


@query(f"""WITH {BASE}, {_CTX}, {_TIER}, m AS (SELECT conv_id, turn, context, list_transform(regexp_extract_all(text, '{_CW}')[1:3], lambda w: lower(w)) AS found FROM x JOIN conversations USING (conv_id, turn)),
    o AS (SELECT conv_id, turn, context, unnest(found) AS word, generate_subscripts(found, 1) AS r FROM m),
    e AS (SELECT conv_id, turn, r, word, unnest(context) AS cw FROM o),
    b AS (SELECT conv_id, turn, r, sum({_COS}) AS total FROM e JOIN t a ON a.word = e.word JOIN t b ON b.word = cw GROUP BY 1, 2, 3),
    w AS (SELECT conv_id, turn, r, word, len(context) AS size, 1.0::DOUBLE - r / 10.0::DOUBLE + 0.02::DOUBLE * coalesce(total, 0) AS confidence FROM o LEFT JOIN b USING (conv_id, turn, r))
    SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, turn ORDER BY CASE WHEN size > 0 THEN round(confidence, 9) ELSE 0 END DESC, r)::INTEGER AS rank, word, round(confidence, 6) AS confidence FROM w""")
def context_rerank(spark, sf):
    """The first three words of each turn as suggestions, reranked by the turns around it."""
    c = table(spark, sf, "conversations").select(F.struct("conv_id", "turn").alias("query_id"), F.posexplode(F.slice(T.words(F.col("text"), T.CONTEXT_WORD), F.lit(1), F.lit(3))).alias("i", "word"))
    rank = (F.col("i") + 1).alias("rank")
    offered = c.select("query_id", rank, F.lower("word").alias("word"), (F.lit(1.0) - (F.col("i") + 1) / F.lit(10.0)).alias("confidence"))
    around = _contexts(spark, sf).select(F.struct("conv_id", "turn").alias("query_id"), "before", "after")
    tier = _tier(spark, sf).withColumn("vec", F.col("vec").cast("array<double>"))
    return rerank.rerank(offered, around, tier).select("query_id.conv_id", "query_id.turn", "rank", "word", F.round("confidence", 6).alias("confidence"))


#: Letters of a small dictionary's TRY line.
TRY = "esianrtolcdugmphbyfvkw"
_LETTERS = f"(SELECT unnest(string_split('{TRY}', '')) AS c)"


@query(f"""WITH {BASE}, v AS (SELECT word, word[1:i - 1] || c || word[i + 1:] AS v FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM q) CROSS JOIN {_LETTERS} WHERE c <> word[i])
    SELECT word AS query, count(DISTINCT v)::BIGINT AS n, min(v) AS first, max(v) AS last FROM v GROUP BY 1""")
def bad_char_variants(spark, sf):
    """How many words one other letter makes of each unknown word, and the first and last of them."""
    made = unknown_words(spark, sf).select(F.col("word").alias("query"), F.array_distinct(E.bad_char(F.col("word"), TRY)).alias("v"))
    return made.select("query", F.size("v").cast("long").alias("n"), F.array_min("v").alias("first"), F.array_max("v").alias("last"))


@query(f"""WITH {BASE}, v AS (SELECT word, word[1:i - 1] || c || word[i:] AS v FROM (SELECT word, unnest(range(1, length(word) + 2)) AS i FROM q) CROSS JOIN {_LETTERS})
    SELECT word AS query, count(DISTINCT v)::BIGINT AS n, min(v) AS first, max(v) AS last FROM v GROUP BY 1""")
def forgotten_char_variants(spark, sf):
    """How many words one more letter makes of each unknown word, and the first and last of them."""
    made = unknown_words(spark, sf).select(F.col("word").alias("query"), F.array_distinct(E.forgotten_char(F.col("word"), TRY)).alias("v"))
    return made.select("query", F.size("v").cast("long").alias("n"), F.array_min("v").alias("first"), F.array_max("v").alias("last"))


@query("""WITH s AS (SELECT vec_id, embedding::DOUBLE[] AS v, list_max(list_transform(embedding::DOUBLE[], lambda x: abs(x))) / 7 AS scale FROM embeddings),
    q AS (SELECT vec_id, list_transform(v, lambda x: round(x / scale)::INTEGER) AS q FROM s)
    SELECT vec_id, list_transform(range(1, len(q) + 1, 2), lambda i: (((q[i] & 15) << 4) | (q[i + 1] & 15))::INTEGER) AS packed, q AS unpacked FROM q""")
def int4_roundtrip(spark, sf):
    v = F.col("embedding").cast("array<double>")
    packed = table(spark, sf, "embeddings").select("vec_id", V.int4_quantize(v).alias("packed"), F.size("embedding").alias("n"))
    return packed.select("vec_id", "packed", V.int4_unpack(F.col("packed"), F.col("n")).alias("unpacked"))


@query(f"""WITH d AS (SELECT DISTINCT unnest(regexp_split_to_array(text, '[ \\t\\n\\r\\f\\v\\x00]+')) AS token FROM conversations),
    w AS (SELECT token, '<' || token || '>' AS w FROM d WHERE token <> ''),
    g AS (SELECT token, w[i:i + n - 1] AS gram FROM (SELECT token, w, n, unnest(range(1, length(w) - n + 2)) AS i FROM (SELECT token, w, unnest(range(2, 5)) AS n FROM w) WHERE length(w) >= n))
    SELECT token, count(*)::BIGINT AS n, sum({_FNV} % 2000000)::BIGINT AS total FROM g GROUP BY 1""")
def lid_token_buckets(spark, sf):
    """Each token's hashed n-grams: how many, and the sum of their buckets."""
    tokens = table(spark, sf, "conversations").select(F.explode(F.split("text", T.LID_SPACE)).alias("token")).where("token <> ''").distinct()
    return lid.token_features(tokens, "token", "token").groupBy("token").agg(F.count("*").alias("n"), F.sum("bucket").alias("total"))


@query()
def lid_detect(spark, sf):
    """A demonstration model: the most frequent words and the buckets take vectors, four labels a tree."""
    lex = docs_lexicon(spark, sf)
    known = [r.word for r in lex.where("rank <= 100").orderBy("rank").collect()]
    rows = np.array([r.embedding for r in table(spark, sf, "embeddings").where("vec_id < 164").orderBy("vec_id").collect()], np.float32)
    model = lid.LidModel({w: i for i, w in enumerate([*known[:99], lid.EOS])}, rows[: 100 + 61], rows[161:164], ["en", "de", "fr", "es"], [40, 30, 20, 10], 61)
    return lid.detect(table(spark, sf, "documents"), model, "doc_id").select(F.col("id").alias("doc_id"), "code", F.round(F.col("score").cast("double"), 5).alias("score"))


@query("""SELECT page_id::VARCHAR AS path, 1 AS tag, sha256(coalesce(url, '')) AS digest FROM pages UNION ALL SELECT page_id::VARCHAR, 2, sha256(coalesce(html, '')) FROM pages""")
def pack_sections(spark, sf):
    """Each page as a pack of two sections, read back."""
    pages = table(spark, sf, "pages").select(F.col("page_id").cast("string").alias("path"), *[F.coalesce(c, F.lit("")).cast("binary").alias(c) for c in ("url", "html")])

    def pack(batches):
        for batch in batches:
            content = [artifacts.write_pack([(1, u), (2, h)]) for u, h in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(content, pa.binary())], ["path", "content"])

    return artifacts.read_packs(pages.mapInArrow(pack, "path string, content binary")).select("path", "tag", "digest")


@query("""WITH s AS (SELECT vec_id, embedding::DOUBLE[] AS v, list_max(list_transform(embedding, lambda x: abs(x)))::FLOAT / 127::FLOAT AS scale FROM embeddings)
    SELECT vec_id, round(scale::DOUBLE, 7) AS scale, list_max(list_transform(v, lambda x: abs(x - round(x / scale) * scale))) <= scale / 2 + 1e-6 AS within FROM s""")
def matrix_rows(spark, sf):
    """Vectors as int8 matrices of up to 1000 rows in bytes, read back."""
    vectors = table(spark, sf, "embeddings").select("vec_id", "embedding", F.floor(F.col("vec_id") / 1000).cast("string").alias("path"))

    def pack(tab: pa.Table) -> pa.Table:
        tab = tab.sort_by("vec_id")
        x = np.array(tab.column("embedding").to_pylist(), np.float32)
        return pa.table({"path": tab.column("path")[:1], "content": pa.array([artifacts.write_matrix(*typo.quantize_rows(x))], pa.binary()), "ids": pa.array([tab.column("vec_id").to_pylist()], pa.list_(pa.int64()))})

    files = vectors.groupBy("path").applyInArrow(pack, "path string, content binary, ids array<long>")
    rows = artifacts.read_matrices(files).join(files.select("path", F.posexplode("ids").alias("row", "vec_id")), ["path", "row"])
    both = rows.join(vectors.select("vec_id", "embedding"), "vec_id")
    worst = F.array_max(F.zip_with("embedding", "q", lambda x, q: F.abs(x.cast("double") - q * F.col("scale").cast("double"))))
    within = worst <= F.col("scale").cast("double") / 2 + F.lit(1e-6)
    return both.withColumn("within", within).select("vec_id", F.round(F.col("scale").cast("double"), 7).alias("scale"), "within")


@query()
def dictionary_suggest(spark, sf):
    """Suggestions of a small dictionary for the words of conversations that it does not take."""
    return dictionary.Speller(spark, DEMO_AFF, DEMO_DIC).suggest(L.tokens(table(spark, sf, "conversations")))


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: ranked suggestions for the words of conversations that the documents' lexicon lacks."""
    return symspell_slate(spark, sf_dir)
