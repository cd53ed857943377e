import random
import re
import uuid

import pytest
from pyspark.sql import functions as F

from plenaria.functions import complexity, textcounts
from plenaria.functions import scalar as S
from plenaria.functions.complexity import BASIC, METRICS, metrics_map, with_complexity

TEXTS = [
    "Das ist ein Satz. Hier steht noch einer! Und ein dritter?", "", "   ", None, "całość Über straße word1 x", "no terminator here",
    "alpha alpha alpha alpha", "alpha beta gamma delta",
]


def test_complexity_against_python(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "i int, text string")
    got = {r.i: r for r in with_complexity(df).collect()}
    for i, text in enumerate(TEXTS):
        if not text or not text.strip():
            assert all(got[i][m] is None for m in METRICS)
            continue
        tokens = [w.lower() for w in re.findall(r"\b[a-zA-ZÀ-ÿ]{2,}\b", text)]
        assert got[i].ttr == (round(len(set(tokens)) / len(tokens), 4) if tokens else 0.0)
        sizes = [len(s.split()) for s in re.split(r"[.!?]+", text) if s.strip()]
        assert got[i].avg_sentence_length == round(sum(sizes) / len(sizes), 2)
    assert got[7].ttr > got[6].ttr
    maps = {r.i: r.complexity_metrics for r in metrics_map(df).collect()}
    assert maps[1] == {} and set(maps[0]) == set(METRICS)


def test_dates(spark):
    cases = {
        "2021-09-15": "2021-09-15", "20210915": "2021-09-15", "2021-09": "2021-09-01", "2021": "2021-01-01", "2021-9-5": "2021-09-05",
        "Session_2020-03-13_x": "2020-03-13", "never": None, "": None, "2021-13-45": None,
    }
    df = spark.createDataFrame([(c,) for c in cases], "s string")
    got = {r.s: r.d and str(r.d) for r in df.select("s", S.flexible_date(F.col("s")).alias("d")).collect()}
    assert got == cases


def test_uuid_and_languages(spark):
    names = ["a", "", "doc-é", "http://x"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = {r.n: r.u for r in df.select("n", S.uuid5_url(F.col("n")).alias("u")).collect()}
    assert got == {n: str(uuid.uuid5(uuid.NAMESPACE_URL, n)) for n in names}
    tags = spark.createDataFrame([("de-AT",), ("EN",), ("xx",)], "t string")
    assert [r[0] for r in tags.select(S.language_key(F.col("t"))).collect()] == ["de", "en_US", "en_US"]


def test_word_count_of_nothing(spark):
    df = spark.createDataFrame([("",), (None,), (" a b\n",)], "t string")
    assert [r[0] for r in df.select(S.word_count(F.col("t"))).collect()] == [0, 0, 2]


def test_basic_metrics_alone(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "i int, text string")
    basic = with_complexity(df, basic=True)
    assert basic.columns == ["i", "text", *BASIC]
    whole = with_complexity(df).select("i", *BASIC).collect()
    assert sorted(map(tuple, whole)) == sorted(map(tuple, basic.select("i", *BASIC).collect()))
    assert with_complexity(df, metrics=["gunning_fog"]).columns == ["i", "text", "gunning_fog"]


BY_LANGUAGE = {
    # Syllables of each word, counted by hand.
    "en": [("table", 2), ("make", 1), ("the", 1), ("decide", 2), ("people", 2), ("law", 1)],
    "de-DE": [("Theater", 3), ("Freiheit", 2), ("Regierung", 3), ("Häuser", 2), ("Schnee", 1), ("Chaos", 2)],
    "fr": [("table", 1), ("politique", 3), ("les", 1), ("gouvernement", 4), ("lignes", 1), ("je", 1)],
    "es-ES": [("gobierno", 3), ("país", 2), ("teatro", 3), ("ciudad", 2), ("muy", 1), ("guerra", 2)],
    "xx": [("idea", 2), ("make", 2)],
}


def test_syllables_by_language(spark):
    rows = [(tag, w, n) for tag, words in BY_LANGUAGE.items() for w, n in words]
    df = spark.createDataFrame(rows, "tag string, word string, n int")
    key = F.when(F.col("tag") == "xx", "xx").otherwise(S.language_key(F.col("tag")))
    got = df.withColumn("found", complexity.syllables(F.lower("word"), key)).filter("found <> n").collect()
    assert got == []


def test_grades_by_language_by_hand(spark):
    """One sentence each, of six words: 9 syllables in English, 13 in German and Spanish, 11 in French."""
    text = {tag: " ".join(w for w, _ in words) + "." for tag, words in BY_LANGUAGE.items() if tag != "xx"}
    sizes = {tag: sum(n for _, n in words) for tag, words in BY_LANGUAGE.items()}
    assert sizes == {"en": 9, "de-DE": 13, "fr": 11, "es-ES": 13, "xx": 4}
    df = spark.createDataFrame([*text.items(), (None, text["en"]), ("en", " "), ("en", None)], "tag string, text string")
    rows = complexity.with_complexity(df, metrics=("flesch_reading_ease", "flesch_kincaid_grade", "gunning_fog"), language=F.col("tag")).collect()
    ease = {"en": (206.835, 1.015, 84.6), "de-DE": (180, 1, 58.5), "fr": (207, 1.015, 73.6), "es-ES": (206.84, 1.02, 60)}
    for r in rows[:4]:
        base, length, spoken = ease[r.tag]
        a = sizes[r.tag] / 6
        assert r.flesch_reading_ease == pytest.approx(base - length * 6 - spoken * a, abs=0.006)
        assert r.flesch_kincaid_grade == pytest.approx(0.39 * 6 + 11.8 * a - 15.59, abs=0.006)
        hard = sum(n >= 3 for _, n in BY_LANGUAGE[r.tag])
        assert r.gunning_fog == pytest.approx(0.4 * (6 + 100 * hard / 6), abs=0.006)
    assert rows[4].flesch_reading_ease == rows[0].flesch_reading_ease and rows[5].gunning_fog is None is rows[6].gunning_fog


def test_settings_from_environment_and_file(tmp_path, monkeypatch):
    from plenaria import settings

    (tmp_path / ".env").write_text("# models\nexport PLENARIA_EMBEDDER='plenaria.operators.extraction:HashingEmbedder'\nPLENARIA_TEXT_CAP=10000\nPLENARIA_LEAST_WORDS = 7\nnothing\n")
    monkeypatch.chdir(tmp_path)
    monkeypatch.setenv("PLENARIA_LEAST_WORDS", "9")
    settings.settings.cache_clear()
    try:
        found = settings.settings()
        assert (found.text_cap, found.least_words, found.entity_threshold, found.reply_backend) == (10000, 9, 0.5, "")
        assert settings.named(found.embedder).model_name == "hashing" and settings.named("") is None
    finally:
        settings.settings.cache_clear()


def test_counts_are_those_of_the_expressions(spark):
    """Metrics come from one pass over the code points; the expressions that languages with rules use give the same."""
    rnd = random.Random(5)
    letters = [*"aeiouAEbcdXYZzßÿŸÀ×÷ '-.!?\n\t_1²  ́Œœİı‍ΑΣς中Ⓐ😀ÅKẞé,;", *" " * 12, *"abcdeo" * 3]
    odd = ["", None, " ", "...", "a×b", "1××a", "ab××1 ab×", "a×× ×b", "x", "İa İb", "a-e a'e", "\x00ab cd", "a" * 5000]
    odd += ["".join(rnd.choice(letters) for _ in range(rnd.randint(1, 60))) for _ in range(2000)]
    df = spark.createDataFrame(list(enumerate(odd)), "i int, text string").repartition(3)
    made = with_complexity(df)
    assert "regexp_extract_all" not in made._jdf.queryExecution().optimizedPlan().toString()
    same = [c for c in made.columns if c != "flesch_reading_ease"]  # Dutch has other constants there, but no rules for syllables
    assert sorted(made.select(same).collect(), key=lambda r: r.i) == sorted(with_complexity(df, language=F.lit("nl")).select(same).collect(), key=lambda r: r.i)


def test_classes_are_the_jvms(spark):
    """But for characters that the JVM's edition of Unicode doesn't have."""
    c = F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32")
    rows = spark.range(0, 0x110000).filter("id NOT BETWEEN 55296 AND 57343").select("id", c.alias("c"))
    rows = rows.select("id", *(F.col("c").rlike(p).alias(n) for n, p in (("word", r"(?U)^\w$"), ("space", r"(?Us)^\s$"), ("none", r"^\p{Cn}$"))), F.lower("c").rlike(complexity.VOWELS).alias("vowel"))
    found = rows.toPandas()
    kind = textcounts._classes()[found.id.to_numpy()]
    for name, bit in (("word", textcounts._WORD), ("space", textcounts._SPACE), ("vowel", textcounts._VOWEL)):
        assert not found[(((kind & bit) > 0) != found[name]) & ~found.none].id.tolist(), name
