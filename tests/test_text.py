import unicodedata

from pyspark.sql import functions as F

from lexiloom.functions import text as T


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x")).alias("y")).first().y


def test_accents_match_unicode(spark):
    # Vowel signs of Indic scripts that part into two letters stay as they are.
    points = [chr(i) for r in (range(0xC0, 0x900), range(0x1E00, 0x2200)) for i in r if not unicodedata.category(chr(i)).startswith("C")]
    rows = spark.createDataFrame([(c,) for c in points], "x string").select("x", T.strip_accents(F.col("x")).alias("y")).collect()
    expected = {c: "".join(d for d in unicodedata.normalize("NFD", c) if unicodedata.category(d) != "Mn") for c in points}
    assert all(r.y == expected[r.x] for r in rows)


def test_canonical_forms(spark):
    c = T.canonical_word
    assert one(spark, c, "Françaises") == one(spark, c, "français")
    assert one(spark, c, "villes") == one(spark, c, "ville") == "ville"
    assert one(spark, c, "pays") == "pays"
    assert one(spark, c, "bateaux") == "bateal"  # `aux` is tried before `eaux`
    assert one(spark, c, "paris") == "paris"


def test_tokens_and_content_words(spark):
    assert one(spark, T.token_texts, "L'été, 2 x") == ["L", "'", "été", ",", " ", "2", " ", "x"]
    assert one(spark, T.content_words, "ville Paris villes le paris") == ["ville", "paris"]


def test_guesses(spark):
    for said, guess in (("MOT: France", "france"), ("MOT: françaises", "francaises"), ("MOT: cœur", "cœur"), ("<think>MOT: a", ""), ("<think>x</think> Sport", "sport")):
        assert one(spark, T.extract_guess, said) == guess
    valid = lambda c: T.is_valid_guess(c)
    assert one(spark, valid, "france") and not one(spark, valid, "think") and not one(spark, valid, "1693") and not one(spark, valid, "dans")


def test_intro_of_wikitext(spark):
    text = "{{Infobox|a={{b}}}}\n'''Paris''' est la [[capitale (ville)|capitale]] de la [[France]], une grande ville.<ref>x</ref>\n\n== Histoire ==\nLe reste"
    intro = one(spark, T.extract_intro, text)
    assert intro.startswith("Paris est la capitale de la France") and "Le reste" not in intro
    assert one(spark, lambda c: T.remove_balanced(c, F.lit("{{"), F.lit("}}")), "a }} b {{ c {{ d }} e") == "a }} b "
