"""Masked-page games as tables.

tokens: game_id, idx, text, is_word, norm, canon, in_title.
guesses: game_id, turn, guess.
A token's reveal turn is the first turn whose guess matches it, so every state of
every game is a comparison of turns, without replaying anything.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.functions import text as T
from lexiloom.functions import words as W
from lexiloom.operators.similarity import SimilaritySource, known_pairs, scored
from lexiloom.operators.stage import staged

SEMANTIC_THRESHOLD = 0.34
# Fixed values of the reward.
REPEATED, INVALID, NON_WORD, NO_INFORMATION, STEP, SOLVED, SEMANTIC_WEIGHT, NEAR_SOLVE = -100.0, -100.0, -200.0, -30.0, -10.0, 1000.0, 0.5, 0.3
BLOCK = "█"


def page_tokens(pages: DataFrame, game_id: str = "page_id", carry: tuple[str, ...] = ()) -> DataFrame:
    """Tokens of the title, one separator, tokens of the intro; columns of the page that are named in `carry` stay.

    Pages are dealt out by game before they are cut, so what is counted by game
    later needs no shuffle of tokens.
    """
    title, intro = T.token_texts(F.col("title")), T.token_texts(F.col("intro"))
    whole = F.concat(title, F.array(F.lit("\n\n")), intro)
    rows = pages.select(F.col(game_id).alias("game_id"), "title", "intro", *carry)
    rows = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "game_id")  # a number of its own: bytes tell little of what the tokens cost
    rows = rows.select("game_id", *carry, F.size(title).alias("_n"), whole.alias("_t"))
    rows = rows.select("game_id", *carry, "_n", F.posexplode_outer("_t").alias("idx", "text")).where("idx is not null").withColumn("norm", T.normalize_word(F.col("text")))  # outer: else a filter cuts the texts a second time
    rows = rows.withColumn("norm", F.when(T.is_word(F.col("norm")), F.col("norm")).otherwise(""))
    return rows.select("game_id", "idx", "text", (F.col("norm") != "").alias("is_word"), "norm", T.canonical_of_normal(F.col("norm")).alias("canon"), (F.col("idx") < F.col("_n")).alias("in_title"), *carry)


def prepared_guesses(guesses: DataFrame) -> DataFrame:
    if "canon_guess" in guesses.columns:  # they are
        return guesses
    g = guesses.withColumn("norm_guess", T.normalize_word(F.col("guess")))
    return g.withColumn("canon_guess", T.canonical_of_normal(F.col("norm_guess")))


def reveals(tokens: DataFrame, guesses: DataFrame, by_canon: bool = True) -> DataFrame:
    """tokens with reveal_turn (null: never). by_canon: a guess matches a token whose canonical or normal form is the guess's canonical form; else the normal forms must be equal."""
    g = prepared_guesses(guesses)
    if by_canon:
        first = g.groupBy("game_id", F.col("canon_guess").alias("_f")).agg(F.min("turn").alias("t"))
        forms = tokens.where("is_word").select("game_id", "norm", "canon").distinct()
        either = forms.select("game_id", "norm", "canon", F.explode(F.array_distinct(F.array("canon", "norm"))).alias("_f"))
        found = either.join(first, ["game_id", "_f"]).groupBy("game_id", "norm", "canon").agg(F.min("t").alias("reveal_turn"))
        return tokens.join(found, ["game_id", "norm", "canon"], "left").select(*tokens.columns, "reveal_turn")
    first = g.where("norm_guess <> ''").groupBy("game_id", F.col("norm_guess").alias("norm")).agg(F.min("turn").alias("reveal_turn"))
    return tokens.join(first, ["game_id", "norm"], "left").select(*tokens.columns, "reveal_turn")


def _first_turns(guesses: DataFrame, by_canon: bool) -> DataFrame:
    """_game, _turns: the first turn of each form that a game's guesses have."""
    form = "canon_guess" if by_canon else "norm_guess"
    first = prepared_guesses(guesses).where(F.col(form) != "").groupBy("game_id", F.col(form).alias("f")).agg(F.min("turn").alias("t"))
    return first.groupBy(F.col("game_id").alias("_game")).agg(F.map_from_entries(F.collect_list(F.struct("f", "t"))).alias("_turns"))


def shown_pages(pages: DataFrame, guesses: DataFrame, by_canon: bool = True, game_id: str = "page_id") -> DataFrame:
    """A row per page: game_id, n_title, tokens (texts, in order), turns (a token that a guess shows -> its first turn). Renderings take it as they take reveals().

    A page's tokens stay in its row, and each distinct one is worked out once; texts are dealt out once, to meet their guesses.
    """
    parts = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = pages.select(F.col(game_id).alias("game_id"), "title", "intro").where("title is not null and intro is not null").repartition(parts, "game_id")
    told = texts.join(_first_turns(guesses, by_canon).hint("shuffle_hash"), F.col("game_id") == F.col("_game"), "left")
    title = T.token_texts(F.col("title"))
    rows = told.select("game_id", F.size(title).alias("n_title"), F.concat(title, F.array(F.lit("\n\n")), T.token_texts(F.col("intro"))).alias("tokens"), "_turns")

    def turn_of(norm: Column) -> Column:
        at = F.try_element_at("_turns", norm)
        return F.least(F.try_element_at("_turns", T.canonical_of_normal(norm)), at) if by_canon else at

    # A canonical form keeps its word's first three letters, and an ASCII word's normal form is its lower case: others of these can't match.
    may = lambda heads: lambda w: (F.octet_length(w) != F.length(w)) | F.array_contains(heads, F.substring(F.lower(w), 1, 3))
    heads = F.transform(F.coalesce(F.map_keys("_turns"), F.array().cast("array<string>")), lambda f: F.substring(f, 1, 3))
    like = T.once(heads, lambda h: F.filter(F.array_distinct("tokens"), may(h)))
    said = F.transform(F.filter(like, T.is_word), lambda w: F.struct(w.alias("w"), turn_of(T.normalize_word(w)).alias("t")))
    return rows.select("game_id", "n_title", "tokens", F.map_from_entries(F.filter(said, lambda s: s["t"].isNotNull())).alias("turns"))


def shown_places(shown: DataFrame) -> DataFrame:
    """game_id, idx, reveal_turn of the tokens of shown_pages() that a guess shows."""
    def found(page: Column) -> Column:
        places = F.transform(page["tokens"], lambda w, i: F.struct(i.alias("idx"), F.try_element_at(page["turns"], w).alias("reveal_turn")))
        return F.filter(places, lambda p: p["reveal_turn"].isNotNull())

    # outer: else a filter works the places out a second time
    rows = shown.select("game_id", F.explode_outer(T.once(F.struct("tokens", "turns"), found)).alias("p"))
    return rows.where("p is not null").select("game_id", "p.idx", "p.reveal_turn")


def revealed_pages(pages: DataFrame, guesses: DataFrame, by_canon: bool = True, game_id: str = "page_id") -> DataFrame:
    """reveals() of whole pages: a game's guesses travel to its page as a map, so tokens are never shuffled."""
    told = pages.join(_first_turns(guesses, by_canon), F.col(game_id) == F.col("_game"), "left")
    tokens = page_tokens(told, game_id, ("_turns",))
    at = F.try_element_at("_turns", F.col("norm"))
    turn = F.least(F.try_element_at("_turns", F.col("canon")), at) if by_canon else at
    return tokens.withColumn("reveal_turn", F.when(F.col("is_word"), turn)).drop("_turns")


def solved_at(revealed: DataFrame) -> DataFrame:
    """game_id, solved_turn: the turn that shows the last title word (null: unsolved, or no title word)."""
    title = revealed.where("in_title and is_word").groupBy("game_id").agg(F.count("*").alias("n"), F.count("reveal_turn").alias("k"), F.max("reveal_turn").alias("t"))
    return revealed.select("game_id").distinct().join(title, "game_id", "left").select("game_id", F.when(F.col("n") == F.col("k"), F.col("t")).alias("solved_turn"))


def exact_hits(revealed: DataFrame, guesses: DataFrame) -> DataFrame:
    """game_id, turn, exact, title: tokens that a turn reveals."""
    hits = revealed.where("reveal_turn is not null").groupBy("game_id", F.col("reveal_turn").alias("turn")).agg(F.count("*").alias("exact"), F.sum(F.col("in_title").cast("long")).alias("title"))
    return guesses.select("game_id", "turn").join(hits, ["game_id", "turn"], "left").fillna(0, ["exact", "title"])


def asked_words(words: DataFrame, guesses: DataFrame) -> DataFrame:
    """words(game_id, ...) with each guess of its game: turn, l (its canonical form). A game's guesses travel to its words as a list, so words aren't dealt out again."""
    g = prepared_guesses(guesses).groupBy("game_id").agg(F.collect_list(F.struct("turn", F.col("canon_guess").alias("l"))).alias("_asked"))
    told = words.join(g.hint("shuffle_hash"), "game_id")
    return told.withColumn("_a", F.explode("_asked")).select(*words.columns, "_a.turn", "_a.l")


def page_words(pages: DataFrame, wanted: DataFrame | None = None, places: bool = False, game_id: str = "page_id") -> DataFrame:
    """page_profile() of whole pages, with `again` (the canonical form folded once more): texts are cut where they lie, and only words leave them.

    wanted(game_id, forms): a game's words are those of its title and those whose normal or canonical form is among
    its forms.  places: with the list of the body's places (idx) of each word.
    """
    letters, pruned = W.letters(pages.sparkSession), wanted is not None
    texts = pages.select(F.col(game_id).alias("game_id"), "title", "intro").where("title is not null and intro is not null")
    parts = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if not pruned:
        texts = texts.repartition(parts, "game_id")
    else:
        texts = texts.join(wanted.hint("shuffle_hash"), "game_id", "left").select("game_id", "title", "intro", F.coalesce("forms", F.array().cast("array<string>")).alias("forms"))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forms = W.forms_of(letters)

        def one(title: str, intro: str, some: list[str] | None) -> Iterator[list]:
            heads, every = Counter(forms.runs(title)), forms.tokens(intro) if places else forms.runs(intro)
            bodies = Counter(every)
            asked = None if some is None else {*some, *(forms[token][0] for token in heads)}
            found: dict[str, list] = {}
            for counts, n in ((heads, 2), (bodies, 3)):
                own = zip(counts, map(forms.__getitem__, counts))
                hits = [(token, f) for token, f in own if f[0]] if asked is None else [(token, f) for token, f in own if (f[0] in asked or f[1] in asked) and f[0]]
                for token, f in hits:
                    if f[0] not in found:
                        found[f[0]] = [*f, 0, 0, W.canonical(forms.normal(f[1])), []]
                    found[f[0]][n] += counts[token]
            if places and found:
                own = {token: found[f[0]][5] for token, f in hits}
                for at, token in enumerate(every, len(forms.tokens(title)) + 1):
                    if token in own:
                        own[token].append(at)
            yield from found.values()

        for batch in batches:
            for start in range(0, len(batch), 256):
                rows = batch.slice(start, 256)
                of, out = [], []
                for i, page in enumerate(zip(*(c.to_pylist() for c in rows.columns[1:]), *([] if pruned else [[None] * len(rows)]), strict=True)):
                    had = len(out)
                    out.extend(one(*page))
                    of.extend([i] * (len(out) - had))
                columns = zip(*out, strict=True) if out else [[]] * 6
                typed = [pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int32())), strict=True)]
                yield pa.record_batch([rows.column(0).take(pa.array(of, pa.int64())), *typed][: 7 if places else 6], _WORDS[: 7 if places else 6])

    schema = f"game_id {dict(texts.dtypes)['game_id']}, norm string, canon string, n_title long, n_body long, again string" + (", places array<int>" if places else "")
    found = texts.mapInArrow(words, schema).repartition(parts, "game_id").groupBy("game_id", "norm", "canon", "again")  # pages of one game
    return found.agg(F.sum("n_title").alias("n_title"), F.sum("n_body").alias("n_body"), *([F.flatten(F.collect_list("places")).alias("places")] if places else []))


_WORDS = ["game_id", "norm", "canon", "n_title", "n_body", "again", "places"]


def wanted_forms(guesses: DataFrame, similarity: DataFrame | SimilaritySource) -> DataFrame | None:
    """game_id, forms: what a game's guesses are and what they may be like. No word of another form earns them anything. None where they may be like any word."""
    pairs = known_pairs(similarity)
    if pairs is None:
        return None
    g = prepared_guesses(guesses).select("game_id", F.explode(F.array("norm_guess", "canon_guess")).alias("l")).where("l <> ''").distinct()
    told = g.join(pairs.groupBy("l").agg(F.collect_set("r").alias("_r")), "l", "left").groupBy("game_id")
    return told.agg(F.array_union(F.collect_set("l"), F.flatten(F.collect_list("_r"))).alias("forms"))


def words_of(given: DataFrame, guesses: DataFrame | None = None, similarity: DataFrame | SimilaritySource | None = None) -> DataFrame:
    """page_profile() of tokens, or of pages (page_id, title, intro): of these without the words that no guess can touch, if guesses are given."""
    if "idx" in given.columns:
        return page_profile(given)
    return page_words(given, None if guesses is None else wanted_forms(guesses, similarity))


def semantic_hits(revealed: DataFrame, guesses: DataFrame, similarity: DataFrame | SimilaritySource, threshold: float = SEMANTIC_THRESHOLD) -> DataFrame:
    """game_id, turn, idx, percent: body words still hidden after the turn whose similarity (l, r, sim; both directions given) reaches the threshold. revealed: reveals(), or pages (page_id, title, intro)."""
    if "idx" not in revealed.columns:
        guesses = staged(prepared_guesses(guesses), "prepared")
        words = page_words(revealed, wanted_forms(guesses, similarity), places=True).where("n_body > 0")
        told = words.join(_first_turns(guesses, True).hint("shuffle_hash"), F.col("game_id") == F.col("_game"))
        turn = F.least(F.try_element_at("_turns", F.col("canon")), F.try_element_at("_turns", F.col("norm")))
        asked = asked_words(told.select("game_id", F.col("canon").alias("r"), "places", turn.alias("reveal_turn")), guesses).where(F.col("reveal_turn").isNull() | (F.col("reveal_turn") > F.col("turn")))
        hit = scored(similarity, asked).where(F.col("sim") >= threshold)
        return hit.select("game_id", "turn", F.explode("places").alias("idx"), F.rint(F.col("sim") * 100).cast("int").alias("percent"))
    hidden = revealed.where("is_word and not in_title").select("game_id", "idx", F.col("canon").alias("r"), "reveal_turn")
    asked = asked_words(hidden, guesses).where(F.col("reveal_turn").isNull() | (F.col("reveal_turn") > F.col("turn")))
    hit = scored(similarity, asked).where(F.col("sim") >= threshold)
    return hit.select("game_id", "turn", "idx", F.rint(F.col("sim") * 100).cast("int").alias("percent"))


def display_score(tokens: DataFrame | None, guesses: DataFrame, similarity: DataFrame | SimilaritySource, profile: DataFrame | None = None) -> DataFrame:
    """game_id, turn, score 0..100: the guess's best similarity to any word of the page (100 if the page has it). tokens: or pages, as words_of() takes them. profile: page_profile, where there is one already."""
    if profile is None:
        guesses = staged(prepared_guesses(guesses), "prepared")
    words = words_of(tokens, guesses, similarity) if profile is None else profile
    canons = words.select("game_id", F.col("canon").alias("r")).distinct()
    sim = F.when(F.col("l") == F.col("r"), F.greatest(F.lit(1.0), F.col("sim"))).otherwise(F.col("sim"))
    best = scored(similarity, asked_words(canons, guesses)).groupBy("game_id", "turn").agg(F.max(sim).alias("best"))
    return guesses.select("game_id", "turn").join(best, ["game_id", "turn"], "left").select("game_id", "turn", F.coalesce(F.rint(F.col("best") * 100), F.lit(0)).cast("int").alias("score"))


def _told(again: Column, idf: Column) -> Column:
    told = F.greatest(F.lit(0.0), F.least(F.lit(8.0), F.coalesce(idf, F.lit(1.0))))
    return F.when(again.isin(*T.STOPWORDS) | (F.length(again) < 3), F.lit(0.0)).otherwise(told)


def word_information(canons: DataFrame, idf: DataFrame) -> DataFrame:
    """canons(canon) -> canon, info: what a word tells. The canonical form is folded once more; the fold is 0 for stop words and short words, else its own IDF within 0..8 (1 if unknown)."""
    folded = canons.select("canon").distinct().withColumn("_again", T.canonical_word(F.col("canon")))
    known = folded.join(idf.select(F.col("word").alias("_again"), "idf"), "_again", "left")
    return known.select("canon", _told(F.col("_again"), F.col("idf")).alias("info"))


def informed(words: DataFrame, idf: DataFrame) -> DataFrame:
    """words(canon, ...) with `info`, as word_information gives it: every row looks its form up, and no row is dealt out for it."""
    again = F.col("again") if "again" in words.columns else T.canonical_word(F.col("canon"))
    known = words.withColumn("_again", again).join(idf.groupBy(F.col("word").alias("_again")).agg(F.max("idf").alias("_idf")), "_again", "left")
    return known.select(*words.columns, _told(F.col("_again"), F.col("_idf")).alias("info"))


def page_profile(tokens: DataFrame) -> DataFrame:
    """game_id, norm, canon, n_title, n_body: a page's distinct words. What a guess earns depends on nothing else."""
    t = F.col("in_title").cast("long")
    return tokens.where("is_word").groupBy("game_id", "norm", "canon").agg(F.sum(t).alias("n_title"), F.sum(1 - t).alias("n_body"))


SUMS = ["exact", "exact_info", "title_info", "title", "title_sem", "sem", "semantic", "nearest", "n_words", "k_words"]


def reward_sums(hit: Column, near: Column, title: Column, found: Column) -> list[Column]:
    """What a guess earns from rows of (word, guess), as aggregates: rows of words that it shows (hit), of hidden words that are like it by `s` (near; less `bg` it is c), and of title words (title; found: shown by then)."""
    n, c = F.col("n_title") + F.col("n_body"), F.greatest(F.lit(0.0), F.col("s") - F.col("bg"))
    body = F.when(c >= SEMANTIC_THRESHOLD, F.col("n_body")).otherwise(0)
    near = near & (F.col("s") > 0)
    of = lambda rows, value, name: F.sum(F.when(rows, value)).alias(name)
    return [
        of(hit, n, "exact"), of(hit, F.col("info") * n, "exact_info"), of(hit, F.col("info") * F.col("n_title"), "title_info"), of(hit, F.col("n_title"), "title"),
        of(near, F.col("info") * c * F.col("n_title"), "title_sem"), of(near, F.col("info") * c * body, "sem"), of(near, body, "semantic"),
        F.max(F.when(near & (F.col("n_title") > 0), F.col("s"))).alias("nearest"), of(title, F.lit(1), "n_words"), of(title & found, F.lit(1), "k_words"),
    ]


def earned(solved: Column, scale: float) -> Column:
    """The reward of a guess that counts, from its sums (no nulls) and its turn."""
    return F.round(
        F.lit(STEP) + 0.8 * F.least(F.lit(40.0), "exact_info") + SEMANTIC_WEIGHT * F.least(F.lit(80.0), "sem") + 3 * F.least(F.lit(7.0), "title_sem")
        + 25 * F.least(F.lit(30.0), "title_info") + 200 * F.least(F.lit(4), "title")
        + F.when((F.col("sem") >= 8) & (F.col("semantic") >= 4), F.least(F.lit(4.0), 0.5 * F.col("sem"))).otherwise(0.0)
        + F.when(solved, SOLVED * scale - 2 * (F.col("turn") - 1)).otherwise(0.0)
        + NEAR_SOLVE * 100 * F.col("nearest")
        + F.when((F.col("exact_info") == 0) & (F.col("sem") == 0) & (F.col("title_sem") == 0) & (F.col("title") == 0), F.lit(NO_INFORMATION)).when((F.col("exact") == 0) & (F.col("title") == 0), F.lit(-4.0)).otherwise(0.0),
        4,
    )


def guess_rewards(
    tokens: DataFrame | None, guesses: DataFrame, idf: DataFrame, similarity: DataFrame | SimilaritySource, real_words: DataFrame | None = None, background: DataFrame | None = None, scale: float = 1.0,
    profile: DataFrame | None = None,
) -> DataFrame:
    """The reward of every guess of every game, all at once: game_id, turn, guess, reward, exact, semantic, title, solved, invalid.

    tokens: or pages, as words_of() takes them;
    profile: page_profile, where there is one already; idf(word, idf);
    similarity(l, r, sim), without equal words, or a source of it; real_words(word):
    what counts as a word besides the page's own (None: everything);
    background(word, bg): how near a word is to any page, taken from its similarities.
    Every guess reveals its tokens to the turns after it, an invalid one too; only
    valid, new and real ones earn.  A turn of a game has one guess.

    A game's guesses travel to its page's distinct words as a list; a word then meets
    them in its own task, and one aggregate by game and turn gives all sums.
    """
    if profile is None:
        guesses = staged(prepared_guesses(guesses), "prepared")
    words = words_of(tokens, guesses, similarity) if profile is None else profile
    g = prepared_guesses(guesses).select("game_id", "turn", F.col("norm_guess").alias("guess"), "canon_guess")
    earlier = Window.partitionBy("game_id", "guess").orderBy("turn")
    g = g.withColumn("repeated", F.row_number().over(earlier) > 1).withColumn("valid", T.is_valid_guess(F.col("guess")))
    if real_words is None:
        g = g.withColumn("known", F.lit(True))
    else:
        known = real_words.select(F.col("word").alias("guess")).distinct().withColumn("_known", F.lit(True))
        g = g.join(known, "guess", "left").withColumn("known", F.coalesce("_known", F.lit(False))).drop("_known")
    if background is None:
        g = g.withColumn("bg", F.lit(0.0))
    else:
        g = g.join(background.groupBy(F.col("word").alias("canon_guess")).agg(F.max("bg").cast("double").alias("bg")), "canon_guess", "left").fillna(0.0, ["bg"])
    g = staged(g, "guesses")
    # A word meets: itself as a title word (0), the turn that shows it (1), guesses that leave it hidden (2).
    def meets(kind: int, turn: Column, l: Column, bg: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), turn.cast(dict(g.dtypes)["turn"]).alias("turn"), l.cast("string").alias("l"), bg.cast("double").alias("bg"))

    none = F.lit(None)
    plays = g.groupBy("game_id").agg(
        F.map_from_entries(F.collect_list(F.when(~F.col("repeated") & (F.col("guess") != ""), F.struct("guess", "turn")))).alias("_first"),
        F.collect_list(F.when(F.col("valid") & ~F.col("repeated"), meets(2, F.col("turn"), F.col("canon_guess"), F.col("bg")))).alias("_live"),
    )
    seen = informed(words.join(plays.hint("shuffle_hash"), "game_id").withColumn("t", F.try_element_at("_first", F.col("norm"))).drop("_first"), idf)
    t = F.col("t")
    own = F.array_compact(F.array(F.when(F.col("n_title") > 0, meets(0, none, none, F.lit(0.0))), F.when(t.isNotNull(), meets(1, t, none, F.lit(0.0)))))
    hidden = F.filter("_live", lambda x: t.isNull() | (t > x["turn"]))
    met = seen.select("game_id", F.col("canon").alias("r"), "n_title", "n_body", "info", "t", F.explode(F.concat(own, hidden)).alias("m")).select("game_id", "r", "n_title", "n_body", "info", "t", "m.*")
    rows = scored(similarity, met).withColumn("s", F.when(F.col("l") == F.col("r"), F.greatest(F.lit(1.0), F.col("sim"))).otherwise(F.col("sim")))
    of = lambda kind: F.col("kind") == kind
    sums = staged(rows.groupBy("game_id", of(0).alias("_own"), "turn").agg(*reward_sums(of(1), of(2), of(0), t.isNotNull()), F.max(F.when(of(0), t)).alias("last_title")), "sums")
    of_game = ["n_words", "k_words", "last_title"]
    row = g.join(sums.where("not _own").drop("_own", *of_game), ["game_id", "turn"], "left").join(sums.where("_own").select("game_id", *of_game), "game_id", "left").fillna(0, SUMS)
    real = F.col("known") | (F.col("exact") > 0)  # a new guess shows a token where it is a word of the page's own
    solved = F.coalesce((F.col("n_words") > 0) & (F.col("n_words") == F.col("k_words")) & (F.col("turn") == F.col("last_title")), F.lit(False))
    reward = F.when(~F.col("valid"), F.lit(INVALID)).when(F.col("repeated"), F.lit(REPEATED)).when(~real, F.lit(NON_WORD)).otherwise(earned(solved, scale))
    counts = F.col("valid") & ~F.col("repeated") & real
    return row.select("game_id", "turn", "guess", reward.alias("reward"), *[F.when(counts, F.col(c)).otherwise(0).cast("long").alias(c) for c in ("exact", "semantic", "title")], (solved & counts).alias("solved"), (~counts).alias("invalid"))


def feedback_steps(tokens: DataFrame, guesses: DataFrame, idf: DataFrame, similarity: DataFrame, real_words: DataFrame | None = None) -> DataFrame:
    """What a player is told after every guess: guess, score, exact, semantic, title, reward, solved, invalid, repeated. A repeated guess isn't called invalid."""
    guesses = staged(prepared_guesses(guesses), "prepared")
    words = staged(words_of(tokens, guesses, similarity), "profile")
    told = guess_rewards(None, guesses, idf, similarity, real_words, profile=words).join(display_score(None, guesses, similarity, words), ["game_id", "turn"])
    seen = F.row_number().over(Window.partitionBy("game_id", "guess").orderBy("turn")) > 1
    told = told.withColumn("repeated", seen)
    return told.select("game_id", "turn", "guess", "score", "exact", "semantic", "title", "reward", "solved", (F.col("invalid") & ~F.col("repeated")).alias("invalid"), "repeated")


def completion_rewards(tokens: DataFrame, histories: DataFrame, completions: DataFrame, idf: DataFrame, similarity: DataFrame, real_words: DataFrame | None = None, scale: float = 1.0) -> DataFrame:
    """The reward of the guess in a model's completion(game_id, completion) after the guesses of histories(game_id, turn, guess)."""
    after = histories.groupBy("game_id").agg(F.max("turn").alias("n"))
    said = completions.join(after, "game_id", "left").select("game_id", (F.coalesce("n", F.lit(0)) + 1).alias("turn"), T.extract_guess(F.col("completion")).alias("guess"))
    every = histories.select("game_id", "turn", "guess").union(said)
    return guess_rewards(tokens, every, idf, similarity, real_words, scale=scale).join(said.select("game_id", "turn"), ["game_id", "turn"], "left_semi")


def shaped_rewards(tokens: DataFrame, guesses: DataFrame, idf: DataFrame, similarity: DataFrame, weight: float) -> DataFrame:
    """guess_rewards with `shaped`: the reward and `weight` times the guess's greatest similarity to a title word still hidden before it, by normal forms; none for guesses that don't count."""
    guesses = staged(prepared_guesses(guesses), "prepared")
    words = staged(words_of(tokens, guesses, similarity), "profile")
    rewards = staged(guess_rewards(None, guesses, idf, similarity, profile=words), "rewards")
    shown = rewards.where("guess <> ''").groupBy("game_id", F.col("guess").alias("norm")).agg(F.min("turn").alias("t"))
    titles = words.where("n_title > 0").select("game_id", "norm").distinct().join(shown, ["game_id", "norm"], "left")
    live = rewards.where("not invalid").select("game_id", "turn", F.col("guess").alias("l"))
    hidden = live.join(titles.withColumnRenamed("norm", "r"), "game_id").where(F.col("t").isNull() | (F.col("t") >= F.col("turn")))
    sim = F.when(F.col("l") == F.col("r"), F.greatest(F.lit(1.0), F.col("sim"))).otherwise(F.col("sim"))
    best = scored(similarity, hidden).groupBy("game_id", "turn").agg(F.max(sim).alias("best"))
    return rewards.join(best, ["game_id", "turn"], "left").withColumn("shaped", F.col("reward") + weight * F.greatest(F.lit(0.0), F.coalesce("best", F.lit(0.0)))).drop("best")


# --- renderings: per game at the end of a turn --------------------------------------------------------------------
def _pages_of(revealed: DataFrame) -> DataFrame:
    """The rows of shown_pages() as they are, those of reveals() gathered to such."""
    if "tokens" in revealed.columns:
        return revealed
    tokens = F.transform(F.array_sort(F.collect_list(F.struct("idx", "text"))), lambda s: s["text"])
    rows = revealed.groupBy("game_id").agg(F.sum(F.col("in_title").cast("int")).cast("int").alias("n_title"), tokens.alias("tokens"))
    first = revealed.where("reveal_turn is not null").groupBy("game_id", "text").agg(F.min("reveal_turn").alias("t"))
    turns = first.groupBy("game_id").agg(F.map_from_entries(F.collect_list(F.struct("text", "t"))).alias("turns"))
    return rows.join(turns, "game_id", "left")


def _hidden(token: Column, turns: Column, turn: Column | int) -> Column:
    return T.is_word(token) & ~F.coalesce(F.try_element_at(turns, token) <= turn, F.lit(False))


def masked_text(revealed: DataFrame, turn: Column | int = 1 << 30) -> DataFrame:
    """game_id, text: hidden words as blocks of their length. revealed: shown_pages() or reveals()."""
    def text(page: Column) -> Column:
        return F.array_join(F.transform(page["tokens"], lambda w: F.when(_hidden(w, page["turns"], turn), F.repeat(F.lit(BLOCK), F.greatest(F.lit(1), F.length(w)))).otherwise(w)), "")

    return _pages_of(revealed).select("game_id", T.once(F.struct("tokens", "turns"), text).alias("text"))


def compact_text(revealed: DataFrame, turn: Column | int = 1 << 30, most: int = 240) -> DataFrame:
    """game_id, text: hidden words in a row as one `__`, blanks squeezed, the middle left out of long texts. revealed: shown_pages() or reveals()."""
    def text(page: Column) -> Column:
        hidden = F.transform(page["tokens"], lambda w: _hidden(w, page["turns"], turn))
        put = lambda h: F.transform(page["tokens"], lambda w, i: F.when(~F.get(h, i), w).when(F.coalesce(F.get(h, i - 1), F.lit(False)), F.lit("")).otherwise(F.lit("__")))
        return F.regexp_replace(F.array_join(T.once(hidden, put), ""), "[ \t]+", " ")

    whole = _pages_of(revealed).select("game_id", T.once(F.struct("tokens", "turns"), text).alias("t"))
    half = most // 2
    head = F.regexp_replace(F.substring("t", 1, half), r"(?s)^(.*) [^ ]*$", "$1")
    tail = F.regexp_replace(F.expr(f"right(t, {half})"), r"(?s)^[^ ]* (.*)$", "$1")
    cut = T.strip(F.concat(head, F.lit("\n[...]\n"), tail))
    return whole.select("game_id", F.when(F.length("t") <= most, T.strip(F.col("t"))).otherwise(cut).alias("text"))


def full_text(revealed: DataFrame, turn: Column | int = 1 << 30) -> DataFrame:
    """game_id, text: the title's line, with hidden words as ?(length), then the body, with hidden words as _(length). revealed: shown_pages() or reveals(). A page without tokens has no row."""
    blank = F.lit("\n\n")

    def text(page: Column) -> Column:
        def line(tokens: Column, sign: str) -> Column:
            part = lambda w: F.when(w == blank, F.lit("")).when(_hidden(w, page["turns"], turn), F.concat(F.lit(sign), F.length(w).cast("string"), F.lit(")"))).otherwise(w)
            return T.strip(F.regexp_replace(F.array_join(F.transform(tokens, part), ""), "[ \t]+", " "))

        n = page["n_title"]
        whole = F.concat(F.lit("TITRE: "), line(F.slice(page["tokens"], 1, n), "?("), blank, line(F.slice(page["tokens"], n + 1, F.size(page["tokens"])), "_("))
        return F.when(F.exists(page["tokens"], lambda w: w != blank), whole)

    rows = _pages_of(revealed).select("game_id", F.explode(F.array(T.once(F.struct("n_title", "tokens", "turns"), text))).alias("text"))
    return rows.where("text is not null")


# --- closed-set solver ------------------------------------------------------------------------------------------------
def candidates(page_words: DataFrame, present: list[str], absent: list[str]) -> DataFrame:
    """Pages (page_id) with all of `present` and none of `absent`; all pages if no page fits. page_words: page_id, word (distinct)."""
    every = page_words.select("page_id").distinct()
    fit = every
    if present:
        fit = page_words.where(F.col("word").isin(present)).groupBy("page_id").agg(F.count("*").alias("n")).where(F.col("n") == len(set(present))).select("page_id")
    if absent:
        fit = fit.join(page_words.where(F.col("word").isin(absent)).select("page_id").distinct(), "page_id", "left_anti")
    none = fit.limit(1).agg(F.count("*").alias("n"))
    return fit.union(every.crossJoin(F.broadcast(none)).where("n = 0").select("page_id"))


def candidate_ranking(pages: DataFrame, page_words: DataFrame, title_words: DataFrame, idf: DataFrame, present: list[str]) -> DataFrame:
    """page_id, score: IDF (1 if unknown) of the present words in the page, 2.5 times those in its title, less a hundredth of its words."""
    asked = page_words.sparkSession.createDataFrame([(w,) for w in sorted(set(present))], "word string")
    know = F.broadcast(asked.join(idf, "word", "left").select("word", F.coalesce("idf", F.lit(1.0)).alias("idf")))  # the guesses of one game
    body = page_words.join(know, "word", "left").groupBy("page_id").agg(F.sum(F.coalesce("idf", F.lit(0.0))).alias("b"), F.count("*").alias("n"))
    head = title_words.join(know, "word").groupBy("page_id").agg(F.sum("idf").alias("h"))
    return pages.select("page_id").join(body, "page_id", "left").join(head, "page_id", "left").select("page_id", (F.coalesce("b", F.lit(0.0)) + 2.5 * F.coalesce("h", F.lit(0.0)) - 0.01 * F.coalesce("n", F.lit(0))).alias("score"))


def information_words(page_words: DataFrame, title_words: DataFrame, idf: DataFrame, n: int = 50) -> DataFrame:
    """word, score: how well a word of three letters or more, no number, splits the candidate pages: p(1-p) + 0.18 p idf (1 if unknown) + 0.8 share of titles."""
    total = F.broadcast(page_words.agg(F.greatest(F.countDistinct("page_id"), F.lit(1)).alias("total")))
    counts = page_words.where((F.length("word") >= 3) & ~F.col("word").rlike(r"^\p{Nd}+$")).groupBy("word").agg(F.count("*").alias("c"))
    titles = title_words.groupBy("word").agg(F.count("*").alias("t"))
    p = F.col("c") / F.col("total")
    score = p * (1 - p) + 0.18 * p * F.coalesce("idf", F.lit(1.0)) + 0.8 * F.coalesce("t", F.lit(0)) / F.col("total")
    found = counts.join(titles, "word", "left").join(idf.select("word", "idf"), "word", "left").crossJoin(total)  # one row
    return found.select("word", F.round(score, 6).alias("score")).orderBy(F.desc("score"), "word").limit(n)
