"""Stemmers, queries and the stored index."""

import random

from pyspark.sql import functions as F

from sluice.functions import search as s
from sluice.operators import textindex
from sluice.storage import settled


def test_stems():
    english = {"running": "run", "developers": "develop", "experience": "experi", "ponies": "poni", "ties": "tie", "generously": "generous", "hopping": "hop", "hoping": "hope", "relational": "relat", "conditional": "condit", "happy": "happi", "engineering": "engin", "agreed": "agre", "nationally": "nation"}
    german = {"berufserfahrung": "berufserfahr", "entwickler": "entwickl", "häuser": "haus", "möglichkeiten": "moglich", "aufgaben": "aufgab", "kenntnisse": "kenntnis"}
    assert {w: s.english_stem(w) for w in english} == english
    assert {w: s.german_stem(w) for w in german} == german


def test_match_and_rank(spark):
    rows = [("Junior Developer", "Acme", "You develop backend services with a team", "english"), ("Entwickler", "Nord", "Mit Berufserfahrung in der Entwicklung", "german"), (None, None, None, "english")]
    df = spark.createDataFrame(rows, "t string, c string, d string, conf string").select(s.search_vector(*[F.col(x) for x in ("t", "c", "d", "conf")]).alias("v"))

    def fits(q, conf):
        return [r.m for r in df.select(s.matches(F.col("v"), q, conf).alias("m")).collect()]

    assert fits("developers", "english") == [True, False, False]
    assert fits("berufserfahrungen", "german") == [False, True, False] and fits("berufserfahrung", "english") == [False] * 3
    assert fits('"backend services"', "english")[0] and not fits('"services backend"', "english")[0]
    assert not fits("developer -team", "english")[0] and fits("nothing or acme", "english")[0] and fits("", "english") == [False] * 3
    ranks = [r.r for r in df.select(s.rank(F.col("v"), "developer team", "english").alias("r")).collect()]
    assert ranks[0] > ranks[1] == ranks[2] == 0
    assert s.postings(df.withColumn("k", F.lit(1)), "k", "v").filter("lexeme = 'develop'").count() == 2


def test_stored_index_equals_the_scan_of_vectors(spark, tmp_path):
    rng = random.Random(4)
    english = "junior developer team backend service build run cook night running developers services teams".split()
    german = "entwickler team erfahrung berufserfahrung aufgaben häuser möglichkeiten küche nacht".split()
    rows = []
    for i in range(250):
        conf = rng.choice(["english", "german"])
        words = english if conf == "english" else german
        text = lambda n: rng.choice([None, " ".join(rng.choice(words) for _ in range(rng.randrange(n)))])
        rows.append((i, text(4), text(3), text(30), conf))
    df = spark.createDataFrame(rows, "key long, t string, c string, d string, configuration string")
    vectors = settled(df.select("key", "configuration", s.search_vector(*[F.col(x) for x in ("t", "c", "d", "configuration")]).alias("vector")), "vectors")
    index = textindex.TextIndex.create(spark, f"file://{tmp_path}/index", buckets=16)
    for k in range(3):
        index.add(vectors.filter(F.col("key") % 3 == k))

    def term(words):
        n = rng.choice([1, 1, 1, 2, 3])
        return rng.choice(["", "", "-"]) + (rng.choice(words) if n == 1 else '"' + " ".join(rng.choice(words) for _ in range(n)) + '"')

    asked = [(q, conf, " ".join(rng.choice(["", "", "", "or "]) + term(english if conf == "english" else german) for _ in range(rng.randrange(1, 4)))) for q, conf in enumerate(["english", "german"] * 25)]
    asked += [(90, "english", ""), (91, "english", None), (92, "german", "the or"), (93, "english", "unheard"), (94, "german", "-nacht"), (95, "english", "team team -team")]
    queries = spark.createDataFrame(asked, "query_id long, configuration string, query string")
    got = {(r.query_id, r.key): round(r.rank, 9) for r in index.search(queries).collect()}
    want = {}
    fits = [F.struct(s.matches(F.col("vector"), q or "", c).alias("m"), s.rank(F.col("vector"), q or "", c).alias("r")).alias(f"q{i}") for i, c, q in asked]
    for r in vectors.select("key", "configuration", *fits).collect():
        want |= {(i, r.key): round(r[f"q{i}"].r, 9) for i, c, _ in asked if c == r.configuration and r[f"q{i}"].m}
    assert got == want and len({q for q, _ in got}) > 25
    best = {}
    for (q, k), x in want.items():
        best.setdefault(q, []).append((-x, k))
    assert {(r.query_id, r.key) for r in index.search(queries, top=3).collect()} == {(q, k) for q, v in best.items() for _, k in sorted(v)[:3]}
    assert index.search(queries.limit(0)).count() == 0


def test_a_search_opens_its_lexemes_buckets_alone(spark, tmp_path):
    index = textindex.TextIndex.create(spark, f"file://{tmp_path}/index", buckets=64)
    words = [f"word{i}" for i in range(300)]
    rows = spark.createDataFrame([(k, "simple", " ".join(words[k * 10 : k * 10 + 10])) for k in range(30)], "key long, configuration string, d string")
    null = F.lit(None).cast("string")
    index.add(rows.select("key", "configuration", s.search_vector(null, null, F.col("d"), F.col("configuration")).alias("vector")))
    asked = textindex.terms(spark.createDataFrame([(1, "simple", '"word11 word12" -word7')], "query_id long, configuration string, query string"))
    opened = index.lists(asked).inputFiles()
    assert len(opened) <= 3 < 60 < len(index.entries.read().inputFiles())
    assert index.lexemes.read().count() == 300 and index.entries.read().groupBy("lexeme").count().filter("count <> 1").count() == 0
    assert [(r.query_id, r.key) for r in index.search(spark.createDataFrame([(1, "simple", '"word11 word12" -word7')], "query_id long, configuration string, query string")).collect()] == [(1, 1)]
