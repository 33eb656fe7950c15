"""Rank-order profiles against a version in plain Python, and held-out accuracy."""

from collections import Counter

from pyspark.sql import functions as F

from gridsurvey.llm import language_id, queries


def plain_profile(text, size=300):
    text = " " + " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split()) + " "
    counts = Counter(text[i : i + n] for n in (1, 2, 3) for i in range(len(text) - n + 1))
    pack = lambda g: sum(ord(c) << 21 * (len(g) - 1 - i) for i, c in enumerate(g))
    return [pack(g) for g in sorted(counts, key=lambda g: (-counts[g], pack(g)))[:size]]


def plain_prediction(text, profiles):
    own = plain_profile(text)
    far = {
        lang: sum(min(abs(p.index(g) - i), 300) if g in p else 300 for i, g in enumerate(own)) / (300 * len(own))
        for lang, p in sorted(profiles.items())
    }
    best = min(far, key=far.get)
    second = min(v for k, v in far.items() if k != best)
    return best, 1 - far[best] / second


ROWS = [
    (1, "the cat and the dog, and the end.", "en"), (2, "le chat et le chien et la fin", "fr"),
    (3, "der Hund und die Katze und das Ende", "de"), (4, None, "en"), (5, "12 + 3", None), (6, "", "fr"),
    (None, "THE DOG", None), (7, "der", None), (7, "der", None), (8, "et la " * 4000, None),
]
SCHEMA = "doc_id bigint, text string, lang string"


def test_same_as_plain_version(spark):
    docs = spark.createDataFrame([(*r, "clash") for r in ROWS], SCHEMA + ", lang_pred string")
    profiles = language_id.learn_profiles(docs)
    texts = {lang: " ".join(t for _, t, k in ROWS if k == lang and t) for lang in ("en", "fr", "de")}
    assert profiles == {lang: plain_profile(t) for lang, t in texts.items()}
    got = language_id.identify_languages(docs, docs).collect()
    assert len(got) == len(ROWS)
    found = Counter((r.doc_id, r.lang_pred, round(r.score, 12)) for r in got)
    wanted = Counter()
    for i, t, _ in ROWS:
        if t and any(c.isalpha() for c in t):
            lang, score = plain_prediction(t, profiles)
            wanted[i, lang, round(score, 12)] += 1
        else:
            wanted[i, "und", 0.0] += 1
    assert found == wanted


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "abc", None)], SCHEMA)
    assert [tuple(r) for r in language_id.identify_languages(docs, docs).collect()] == [(1, "und", 0.0)]
    assert language_id.identify_languages(docs.limit(0), docs.limit(0)).count() == 0


def test_held_out_accuracy(spark):
    path = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "lang")
    found = queries.QUERIES["op3_language_id"](spark, path).join(docs, "doc_id").filter("held_out")
    right, total = found.agg(F.sum((F.col("lang_pred") == F.col("lang")).cast("int")), F.count("*")).first()
    assert total > 200 and right / total >= 0.98
