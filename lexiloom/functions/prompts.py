"""Prompts, chat formats and completions as Column expressions.

A history is an array of structs with guess, score and exact.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What a player reads. {game} is the game's name.
RULES = [
    "Tu joues a {game}: devine le titre d'un article Wikipedia francais mot par mot.",
    "Regles:",
    "  - Propose UN seul mot francais a la fois (minuscules).",
    "  - Le titre et le texte sont masques: chaque mot cache est montre comme ?(N) ou _(N) ou N est le nombre de lettres.",
    "  - Les ?(N) dans la ligne TITRE sont les mots du titre qu'il faut deviner.",
    "  - VERT = mot exact trouve et revele dans le texte.",
    "  - score/100 = similarite avec le mot le plus proche de la page:",
    "      ROUGE  0-29: mauvais domaine",
    "      JAUNE 30-59: domaine approche",
    "      ORANGE 60+:  tres proche, affine",
    "",
    "Strategie:",
    "  - Le titre peut etre EN ANGLAIS (ex: 'Target', 'Facebook', 'Inception') ou un nom propre etranger: essaie des mots anglais si le contexte le suggere.",
    "  - Le titre peut etre un film, une serie, une chanson, une marque, un pays, une personne — pas forcement un concept francais.",
    "  - Si tu vois 'Mot-_(N)' dans le texte (ex: 'États-_(4)'), devine IMMEDIATEMENT la suite du mot compose.",
    "  - Si tes 3 derniers scores baissent ou stagnent sous 45, CHANGE de domaine completement.",
    "  - Si un score monte vers 60+, affine avec des mots plus specifiques au lieu de rester generique.",
    "",
]
DOMAINS = "sport, guerre, science, musique, cinema, art, nature, economie, religion, architecture, biologie, geographie, litterature, politique"
PIVOT = "PIVOT: tes scores restent bas. Change completement de domaine (essaie: sport, science, geographie, art, cinema, musique, politique...)."
LOST = "ATTENTION: tu etais a %d/100 mais tu t'eloignes. Reviens vers le domaine de ton meilleur score."
WARM = "Tu es CHAUD (score eleve). Affine: devine des mots plus specifiques, pas generiques."
STUB = r"([A-ZÀ-Ü][a-zà-ü]+-)\(?_\((\d+)\)"
KNOWN_STUB, ITS_END = "États-", "unis"
CHAT = ["<|im_start|>user\n", "<|im_end|>\n<|im_start|>assistant\n", "\n/no_think<|im_end|>\n<|im_start|>assistant\nMOT:"]


def score_line(score: Column, exact: Column) -> Column:
    """What a score means, in words."""
    said = lambda form: F.format_string(form, score)
    return (
        F.when(exact > 0, F.format_string("VERT (exact, %d mot(s) revele(s))", exact))
        .when(score >= 60, said("ORANGE %d/100 (domaine tres proche, affine!)"))
        .when(score >= 30, said("JAUNE %d/100 (domaine approche, continue)"))
        .otherwise(said("ROUGE %d/100 (mauvais domaine, change)"))
    )


def trend_line(history: Column) -> Column:
    """Advice from the last four scores against the best one; null if there is none."""
    missed = lambda steps: F.transform(F.filter(steps, lambda s: s["exact"] == 0), lambda s: s["score"])
    recent, best = missed(F.slice(history, F.greatest(F.lit(1), F.size(history) - 3), 4)), F.array_max(missed(history))
    mean = F.aggregate(recent, F.lit(0.0), lambda a, x: a + x) / F.size(recent)
    return (
        F.when((F.size(history) < 3) | (F.size(recent) == 0), F.lit(None).cast("string"))
        .when((mean < 45) & (best < 55), F.lit(PIVOT))
        .when((best >= 60) & (mean < best - 20), F.format_string(LOST, best))
        .when(mean >= 55, F.lit(WARM))
    )


def stub_hints(visible: Column) -> Column:
    """A line for every compound word of which only the first part is shown."""
    stubs, sizes = F.regexp_extract_all(visible, F.lit(STUB), F.lit(1)), F.regexp_extract_all(visible, F.lit(STUB), F.lit(2))

    def hint(stub: Column, n: Column) -> Column:
        begin = F.concat(F.lit("  '"), stub, F.lit("_("), n, F.lit(")' visible → devine "))
        known = F.concat(begin, F.lit(f"'{ITS_END}' immediatement!"))
        return F.when(stub == KNOWN_STUB, known).otherwise(F.concat(begin, F.lit("la suite de ce mot compose ("), n, F.lit(" lettres)!")))

    return F.zip_with(stubs, sizes, hint)


def prompt(history: Column, visible: Column | None, most_steps: int, game: str) -> Column:
    """What is asked for the guess after `history`. visible: the page as the player sees it."""
    n = F.size(history)
    head = "\n".join(RULES).replace("{game}", game) + "\nEssais restants: "
    parts = [F.concat(F.lit(head), (most_steps - n).cast("string"), F.lit(f"/{most_steps}.\n"))]
    if visible is not None:
        hints = stub_hints(visible)
        shown = F.concat(F.lit("PAGE (mots caches = longueur entre parentheses):\n"), visible, F.lit("\n"))
        parts.append(F.when(F.coalesce(visible, F.lit("")) != "", shown))
        parts.append(F.when(F.size(hints) > 0, F.concat(F.lit("INDICES VISIBLES dans le texte:\n"), F.array_join(hints, "\n"), F.lit("\n"))))
    lines = F.transform(history, lambda s, i: F.format_string("  %2d. %-20s -> %s", i + 1, s["guess"], score_line(s["score"], s["exact"])))
    banned = F.concat(F.lit("\nMots INTERDITS (NE PAS REPETER): "), F.array_join(F.transform(history, lambda s: s["guess"]), ", "))
    advice = F.concat(F.lit("\n⚡ "), trend_line(history))
    told = F.concat_ws("\n", F.lit("Historique des essais:"), F.array_join(lines, "\n"), banned, advice, F.lit("=> Choisis un mot NOUVEAU."))
    parts.append(F.when(n == 0, F.lit(f"Aucun indice encore. Commence par explorer des domaines varies:\n  {DOMAINS}")).otherwise(told))
    return F.concat_ws("\n", *parts, F.lit("\nMOT:"))


def chat_prompt(text: Column, form: str = "none") -> Column:
    """The prompt as it is ('none'), or as a chat turn with the answer begun ('answer') or open to a thought ('think')."""
    if form == "none":
        return text
    if form == "answer":
        return F.concat(F.lit(CHAT[0]), text, F.lit(CHAT[2]))
    if form == "think":
        return F.concat(F.lit(CHAT[0]), text, F.lit(CHAT[1]))
    raise ValueError(f"unknown chat form: {form!r}")


def training_prompt(text: Column, form: str = "none") -> Column:
    """chat_prompt of the prompt without its last line, as training sees it."""
    return text if form == "none" else chat_prompt(F.regexp_replace(text, r"(?s)\nMOT:(?!.*\nMOT:).*$", ""), form)


def thought_completion(raw: Column, guess: Column, end: str) -> Column:
    """The guess as a completion, after the thought of the raw answer if it has one (whose opening mark may have lost its first sign)."""
    whole = F.regexp_extract(raw, r"(?s)<think>(.*?)</think>", 1)
    has_mark = raw.rlike(r"(?s)<think>.*?</think>")
    thought = F.btrim(F.when(has_mark, whole).otherwise(F.regexp_extract(raw, r"(?s)thinking(.*?)</think>", 1)), F.lit(" \t\n\r\x0b\x0c"))
    answer = F.concat(F.lit("MOT: "), guess, F.lit(end))
    return F.when(thought != "", F.concat(F.lit("<think>\n"), thought, F.lit("\n</think>\n"), answer)).otherwise(answer)


def prompt_parts(text: Column) -> Column:
    """struct(rules, state): what is the same for all prompts, and the rest."""
    at = F.instr(text, "\nEssais restants:")
    rules = F.when(at > 0, F.substring(text, F.lit(1), at - 1)).otherwise(F.lit(""))
    return F.struct(rules.alias("rules"), F.when(at > 0, F.substring(text, at, F.length(text))).otherwise(text).alias("state"))
