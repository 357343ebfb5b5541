"""Text functions as Column expressions: accents, normal and canonical forms, tokens, word sets, guesses, markup.

Nothing here is a Python UDF except :func:`remove_balanced`, whose depth counter
no regular expression can hold.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Word characters, spelt out: Java's and Python's \w differ, these classes don't.
WORD = r"[\p{L}\p{N}_]"
#: White space as Unicode has it (fixed values: the 29 code points at which words are split), for use in a character class.
BLANK = r"\x09-\x0D\x1C-\x20\x85\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
NONBLANK = f"[^{BLANK}]+"
TOKEN = rf"[\p{{L}}\p{{N}}_]+|[{BLANK}]+|[^\p{{L}}\p{{N}}_{BLANK}]+"
LETTER_WORD = r"[\p{L}](?:[\p{L}]|['’-])*"

# Fixed values (they decide results): suffixes of the canonical form in the order in which they are tried, and reserved words.
SUFFIXES = [
    ("aux", "al"), ("eaux", "eau"), ("euses", "eur"), ("euse", "eur"), ("trices", "teur"), ("trice", "teur"), ("ives", "if"), ("ive", "if"),
    ("aises", "ais"), ("oises", "ois"), ("ees", "e"), ("ee", "e"), ("es", "e"), ("s", ""), ("x", ""),
]
THEME_SEEDS = [  # fixed values
    "personne", "ville", "pays", "france", "monde", "histoire", "politique", "guerre", "science", "art", "sport", "musique", "cinema", "europe",
    "etat", "groupe", "langue", "culture", "naissance", "mort", "siecle", "annee", "club", "universite", "religion",
]
STOPWORDS = [  # fixed values
    "afin", "ainsi", "alors", "apres", "aucun", "aussi", "autre", "aux", "avec", "avoir", "car", "ceci", "cela", "ces", "cet", "cette", "chez",
    "comme", "dans", "dan", "des", "deux", "donc", "dont", "elle", "elles", "entre", "est", "etre", "eux", "fait", "font", "hors", "ils", "les",
    "leur", "leurs", "lors", "mais", "meme", "mes", "ont", "par", "pas", "peu", "plus", "plu", "pour", "puis", "quand", "que", "quel", "qui", "quoi",
    "sans", "ses", "son", "sont", "sous", "sur", "tres", "une", "vers", "via", "janvier", "fevrier", "mars", "avril", "mai", "juin", "juillet",
    "aout", "septembre", "octobre", "novembre", "decembre", "pendant",
]
#: Words that are never guesses. The game's own name is one more; callers give it as `extra`.
RESERVED = [  # fixed values
    "mot", "mots", "motcle", "motcles", "prochain", "seul", "un", "une", "format", "cache", "cachee", "cacher", "page", "jeu", "pay", "think",
    "thinking", "thought", "reasoning", "raisonnement", "reflexion", "réflexion", "assistant", "tool", "tools", "appel", "fonction", "system",
    "user", "historique", "feedback", "exact", "proche", "titre", "solved", "visible", "texte", "reponse", "réponse",
]


def _accent_table() -> tuple[str, str]:
    """Every character of the basic plane that is one letter and combining marks (or another form of that letter), and that letter; then the marks themselves, which go."""
    source, target = [], []
    for point in range(0xC0, 0x10000):
        if 0xAC00 <= point <= 0xD7A3 or 0xD800 <= point <= 0xDFFF:
            continue
        parts = unicodedata.normalize("NFD", chr(point))
        if parts != chr(point):
            kept = [c for c in parts if unicodedata.category(c) != "Mn"]
            if len(kept) == 1:
                source.append(chr(point))
                target.append(kept[0])
    marks = [chr(point) for point in range(sys.maxunicode + 1) if unicodedata.category(chr(point)) == "Mn"]
    return "".join([*source, *marks]), "".join(target)


_SOURCE, _TARGET = _accent_table()


def strip_accents(c: Column) -> Column:
    return F.translate(c, _SOURCE, _TARGET)


_BLANKS = "".join(chr(i) for i in range(0x3001) if chr(i).isspace())


def strip(c: Column) -> Column:
    """No white space at either end."""
    return F.btrim(c, F.lit(_BLANKS))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value as a lambda's variable: it is worked out once, not at every place where it stands."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def normalize_word(c: Column) -> Column:
    """Lower case, no outer blanks, no accents, no signs at either end. Most tokens are plain words already."""
    return once(F.lower(c), lambda low: F.when(low.rlike("^[a-z0-9_]+$"), low).otherwise(F.regexp_replace(strip_accents(low), rf"^[^\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_]+$", "")))


def canonical_of_normal(norm: Column) -> Column:
    """The first suffix rule that fits a normal form."""
    return once(norm, _suffix_rules)


def _suffix_rules(word: Column) -> Column:
    size = F.length(word)
    out = F.when((size <= 3) | (word == "pays") | word.endswith("is"), word)
    for suffix, end in SUFFIXES:
        out = out.when(word.endswith(suffix) & (size - len(suffix) >= 3), F.concat(F.substring(word, F.lit(1), size - len(suffix)), F.lit(end)))
    return out.otherwise(word)


def canonical_word(c: Column) -> Column:
    return canonical_of_normal(normalize_word(c))


def token_texts(c: Column) -> Column:
    """Runs of word characters, of signs and of blanks, in order."""
    return F.regexp_extract_all(c, F.lit(TOKEN), F.lit(0))


def is_word(norm: Column) -> Column:
    return norm.rlike(r"[\p{L}\p{N}]")


def canonical_words(c: Column) -> Column:
    """Canonical forms of the word tokens, in order, with repeats."""
    norms = F.filter(F.transform(token_texts(c), normalize_word), is_word)
    return F.filter(F.transform(norms, _suffix_rules), lambda w: w != "")


def word_set(c: Column) -> Column:
    return content_words(c, 1)


def content_words(c: Column, least: int = 3) -> Column:
    """Distinct canonical forms of `least` letters or more in the order of their first use; a token is worked out once."""
    chunks = F.array_join(F.array_distinct(F.split(c, " ")), " ")  # words don't reach over blanks: repeated chunks aren't cut into tokens
    norms = F.filter(F.transform(F.array_distinct(token_texts(chunks)), normalize_word), is_word)
    return F.array_distinct(F.filter(F.transform(F.array_distinct(norms), _suffix_rules), lambda w: F.length(w) >= least))


def web_form(c: Column) -> Column:
    """ASCII letters and digits alone."""
    def form(low: Column) -> Column:
        plain = F.replace(F.replace(strip_accents(low), F.lit("œ"), F.lit("oe")), F.lit("æ"), F.lit("ae"))
        return F.when(low.rlike("^[a-z0-9]*$"), low).otherwise(F.regexp_replace(plain, "[^a-z0-9]", ""))

    return once(F.lower(c), form)


def page_word_set(c: Column) -> Column:
    forms = F.transform(F.regexp_extract_all(c, F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), web_form)
    return F.array_sort(F.array_distinct(F.filter(forms, lambda w: F.length(w) > 1)))


#: Elided heads that stand before an apostrophe.
CLITICS = ["l", "d", "qu", "n", "m", "t", "s", "j", "c", "lorsqu", "puisqu", "jusqu"]


def article_words(c: Column) -> Column:
    """Distinct web forms of white-space words cut at apostrophes, sorted; an elided head before an apostrophe is left out. Equal words are cut once, equal parts are worked out once."""
    sign = "['’ʼʹ`]"
    words = F.array_distinct(F.split(c, f"[{BLANK}]+"))

    def forms(words: Column) -> Column:
        cut = F.transform(F.filter(words, lambda w: w.rlike(sign)), lambda w: F.split(w, sign))
        heads = F.array_distinct(F.flatten(F.transform(cut, lambda x: F.slice(x, 1, F.size(x) - 1))))
        ends = F.concat(F.filter(words, lambda w: ~w.rlike(sign)), F.transform(cut, lambda x: F.element_at(x, -1)))
        return F.concat(F.filter(F.transform(heads, web_form), lambda f: ~f.isin(*CLITICS)), F.transform(F.array_distinct(ends), web_form))

    return F.array_sort(F.array_distinct(F.filter(once(words, forms), lambda w: F.length(w) > 1)))


def first_words(c: Column, n: int) -> Column:
    """The first n white-space separated words; only the head of the text that has them is cut."""
    head = F.regexp_extract(c, rf"^[{BLANK}]*+((?:[^{BLANK}]++[{BLANK}]++){{0,{n - 1}}}[^{BLANK}]*+)", 1)
    return F.filter(F.split(head, f"[{BLANK}]+"), lambda w: w != "")


def words_by_blanks(c: Column) -> Column:
    """Number of white-space separated words."""
    return F.size(F.regexp_extract_all(c, F.lit(NONBLANK), F.lit(0)))


# --- guesses ------------------------------------------------------------------------------------------
def extract_guess(c: Column) -> Column:
    """The guess in a completion: nothing if a thought isn't closed; else the word after the marker; else the first word."""
    plain = F.regexp_replace(F.regexp_replace(c, r"(?is)<think>.*?</think>", " "), r"(?i)</?think>", " ")
    marked = F.regexp_extract(plain, rf"(?i)(?:^|\b)(?:MOT|WORD)\s*:\s*({LETTER_WORD})", 1)
    first = F.regexp_extract(plain, rf"({LETTER_WORD})", 1)
    unclosed = c.rlike("(?i)<think>") & ~c.rlike("(?i)</think>")
    return F.when(unclosed, F.lit("")).otherwise(normalize_word(F.when(marked != "", marked).otherwise(first)))


def is_valid_guess(guess: Column, extra: tuple[str, ...] = ()) -> Column:
    return (F.length(guess) >= 2) & guess.rlike(r"\p{L}") & ~guess.rlike(r"\p{N}") & ~guess.isin(*STOPWORDS, *RESERVED, *extra)


def score_label(score: Column, exact: Column) -> Column:
    """Bands of the 0 to 100 similarity."""
    return F.when(exact > 0, F.lit("exact")).when(score >= 60, F.lit("hot")).when(score >= 30, F.lit("warm")).otherwise(F.lit("cold"))


# --- titles and markup ---------------------------------------------------------------------------------
#: Titles of stubs, lists, portals, homonyms, championships, seasons, elections and episodes.
BAD_TITLES = [
    r"^(Commune|Village|Canton|Arrondissement|Municipalité|Circonscription)\s+de\s+",
    r"^Liste\s+(des?|du|de\s+la|d'|de\s+)",
    r"^(Portail|Aide|Wikipédia|Discussion|Utilisateur)\s*:",
    r"\(homonymie\)",
    r"^Championnat\s+.{0,50}\d{4}$",
    r"^(Coupe|Saison|Édition)\s+.{0,50}\d{4}$",
    r"\b(19|20)\d{2}[-–]\d{2,4}\b",
    r"^Élections?\s+",
    r"(saison\s+\d+|épisode\s+\d+)",
    r"\bémission\b",
]


def is_bad_title(c: Column) -> Column:
    return c.rlike("(?iu)" + "|".join(BAD_TITLES))


def is_article_title(c: Column) -> Column:
    return (F.length(c) > 0) & ~c.contains(":") & ~c.isin("Accueil", "Main_Page", "-")


def is_excluded_page(title: Column, intro: Column) -> Column:
    t, i = F.lower(title), F.lower(intro)
    return t.startswith("liste de") | t.startswith("chronologie de") | i.rlike("peut désigner|peuvent désigner|page d['’]homonymie")


def clean_markup(c: Column) -> Column:
    # What is replaced, in this order.
    for pattern, put in (
        (r"'''?", ""), (r"\[\[([^|\]]+)\|([^\]]+)\]\]", "$2"), (r"\[\[([^\]]+)\]\]", "$1"),
        (r"\[https?://[^\s\]]+\s+([^\]]+)\]", "$1"), (r"\[https?://[^\]]+\]", " "), ("&nbsp;", " "), (r"(?U)\s+", " "),
    ):
        c = F.regexp_replace(c, pattern, put)
    return F.trim(c)


@F.pandas_udf(StringType())
def remove_balanced(texts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Text outside of opener ... closer, nested; an opener without closer takes the rest, a closer without opener stays."""
    import re

    def strip(text: str | None, opener: str, closer: str) -> str | None:
        if text is None or opener not in text:
            return text
        out, depth, at = [], 0, 0
        for m in re.finditer(f"{re.escape(opener)}|{re.escape(closer)}", text):
            if m.group() == opener:
                if depth == 0:
                    out.append(text[at : m.start()])
                depth += 1
            elif depth:
                depth -= 1
                at = m.end()
        return "".join(out) + (text[at:] if depth == 0 else "")

    for text, opener, closer in texts:
        yield pd.Series([strip(*x) for x in zip(text, opener, closer, strict=True)])


def extract_intro(c: Column, least: int = 30, enough: int = 1200) -> Column:
    """The first paragraphs of an article's wikitext, without templates, references, images and links."""
    c = F.replace(c, F.lit("\r\n"), F.lit("\n"))
    # What goes first.
    for pattern in (r"(?s)<!--.*?-->", r"(?i)<ref\b[^>/]*/>", r"(?is)<ref\b.*?</ref>", r"<[^>]+>"):
        c = F.regexp_replace(c, pattern, " ")
    c = remove_balanced(remove_balanced(c, F.lit("{{"), F.lit("}}")), F.lit("{|"), F.lit("|}"))
    c = F.regexp_replace(c, r"(?im)^\s*\[\[(?:Fichier|File|Image):.*?\]\]\s*$", " ")
    lead = F.split(c, r"\n==+\s*", 2)[0]
    cleaned = F.transform(F.split(lead, r"\n\s*\n+"), clean_markup)
    kept = F.filter(cleaned, lambda p: (F.length(p) >= least) & ~F.lower(p).rlike("^#?redirect"))
    upto = F.aggregate(kept, F.lit(""), lambda acc, p: F.when(F.length(acc) >= enough, acc).otherwise(F.concat_ws(" ", F.when(acc != "", acc), p)))
    return F.trim(upto)
