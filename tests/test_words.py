"""Words of Arrow batches are those of the Column expressions."""

from pyspark.sql import functions as F

from lexiloom.functions import text as T
from lexiloom.functions import words as W


def test_forms_of_code_points(spark):
    points = [i for i in (*range(1, 0x32400), *range(0xE0000, 0xE0200)) if not 0xD800 <= i <= 0xDFFF]
    token = F.expr("decode(unhex(h), 'utf-8')")
    rows = spark.createDataFrame([("".join(chr(i) for i in points[a : a + 64]).encode().hex(),) for a in range(0, len(points), 64)], "h string").repartition(8)
    one = rows.select(F.explode(F.split(token, "")).alias("c")).select("c", T.token_texts(F.concat(F.lit("a"), "c", F.lit("b"))).alias("t"), T.normalize_word(F.col("c")).alias("alone"), T.normalize_word(F.concat(F.lit("x"), "c", F.lit("es"))).alias("norm"))
    one = one.withColumn("canon", T.canonical_of_normal(F.col("norm"))).withColumn("word", T.is_word(F.col("alone")))
    forms = W.Forms(W.letters(spark))

    def alike(r) -> bool:
        inside = forms.normal(f"x{r.c}es")  # only of what is one token
        return r.t == forms.tokens(f"a{r.c}b") and r.word == (forms[r.c] != ("", "")) and (len(r.t) > 1 or (r.norm, r.canon) == (inside, W.canonical(inside)))

    new = "\ua7cb\ua7dc"  # capitals of Unicode 16: no letters for the JVM's patterns, but Spark lowers them to letters
    wrong = [r for r in one.toLocalIterator() if r.c and r.c not in new and not alike(r)]
    assert wrong == []


def test_words_of_texts(spark):
    texts = ["ΟΔΟΣ ΣΑΣ Σ Σ' ΑΣ.Β", "L’été des Ñandúes_ __ _a_ 1ʳᵉ x̃es Åb İstanbul ǅ", "ﬁn ß ẞ ŉ K Ω 北京 ①②", "", "un　deux\x1ctrois  pays bis chevaux", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    forms = W.Forms(W.letters(spark))
    for r in df.select("t", T.token_texts(F.col("t")).alias("tokens"), T.content_words(F.col("t")).alias("words"), T.word_set(F.col("t")).alias("every")).collect():
        assert forms.tokens(r.t) == (r.tokens or [])
        assert forms.contents(r.t) == (r.words or [])
        assert forms.contents(r.t, 1) == (r.every or [])
