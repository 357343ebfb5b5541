import pytest
from pyspark.sql import functions as F

from lexiloom.functions import prompts
from lexiloom.functions import text as T
from lexiloom.operators import rows


def test_prompt_lines(spark):
    step = "array<struct<guess:string,score:int,exact:int>>"
    ask = lambda h, v: spark.createDataFrame([(h, v)], f"h {step}, v string").select(prompts.prompt(F.col("h"), F.col("v"), 10, "Mots").alias("p")).first().p
    cold = ask([], "Les États-_(4) et Saint-_(5)")
    assert "Essais restants: 10/10.\n\nPAGE (mots caches = longueur entre parentheses):\nLes États-_(4) et Saint-_(5)\n\nINDICES VISIBLES dans le texte:\n" in cold
    assert "  'États-_(4)' visible → devine 'unis' immediatement!\n  'Saint-_(5)' visible → devine la suite de ce mot compose (5 lettres)!\n\nAucun indice" in cold and cold.endswith("\n\nMOT:")
    low = ask([("a", 10, 0), ("b", 35, 0), ("c", 0, 2)], None)
    assert "   1. a                    -> ROUGE 10/100 (mauvais domaine, change)\n   2. b                    -> JAUNE 35/100 (domaine approche, continue)\n   3. c                    -> VERT (exact, 2 mot(s) revele(s))\n\nMots INTERDITS (NE PAS REPETER): a, b, c\n\n⚡ PIVOT" in low
    assert "tu etais a 90/100" in ask([("a", 90, 0), ("b", 5, 0), ("c", 5, 0), ("d", 5, 0), ("e", 5, 0)], None)
    assert "CHAUD" in ask([("a", 60, 0)] * 3, None) and "⚡" not in ask([("a", 60, 0)] * 2, None)
    df = spark.createDataFrame([("x\nMOT: a\nEssais restants: 3\nMOT:", "thinking why </think> MOT: a")], "p string, r string")
    got = df.select(prompts.training_prompt(F.col("p"), "think").alias("t"), prompts.thought_completion(F.col("r"), F.lit("a"), "$").alias("c"), prompts.prompt_parts(F.col("p")).alias("s")).first()
    assert got.t == "<|im_start|>user\nx\nMOT: a\nEssais restants: 3<|im_end|>\n<|im_start|>assistant\n" and got.c == "<think>\nwhy\n</think>\nMOT: a$"
    assert (got.s.rules, got.s.state) == ("x\nMOT: a", "\nEssais restants: 3\nMOT:")


def test_row_filters(spark):
    df = spark.createDataFrame([(i,) for i in range(5)], "k long")
    assert rows.shuffled_head(df, "k", 5, 1, strict=True).count() == 5
    with pytest.raises(ValueError):
        rows.shuffled_head(df, "k", 6, 1, strict=True)
    real = rows.real_words(spark.createDataFrame([("Été",), ("",)], "word string"))
    assert {r.word for r in real.where("word in ('ete', 'ville', '')").collect()} == {"ete", "ville"}


def test_blanks_and_rules_of_other_scripts(spark):
    from lexiloom.operators import corpus

    df = spark.createDataFrame([("a b　c",)], "x string")
    assert df.select(T.words_by_blanks(F.col("x")).alias("n"), T.token_texts(F.col("x")).alias("t")).first() == (3, ["a", " ", "b", "　", "c"])
    pages = spark.createDataFrame([(1, "t", "Ce mot est une abréviation de plus."), (2, "t", "Il peut désigner ceci."), (3, "t", "Ils peut d?signer")], "page_id long, title string, intro string")
    found = {r.page_id: set(r.issues) for r in corpus.with_issues(pages).collect()}
    assert "sigle_like" in found[1] and "homonymy_like" in found[2] and "homonymy_like" not in found[3]
