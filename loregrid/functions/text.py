"""Text functions as built-in column expressions; nothing here leaves the JVM.

Nulls give null unless a function says otherwise. Lengths called bytes are octets, all others are characters.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Stop words by language; any language but German uses the English ones.
STOPWORDS = {
    "de": "der die das und in ist von mit zum zur zu ein eine eines".split(),
    "en": "the and is in of to a with for on at this that".split(),
}

# What a crawled line may not contain, case-sensitive.
JUNK_PHRASES = [
    "Bild wird geladen", "Cookie", "cookie", "Loading...", "loading...", "Accept all", "Alle akzeptieren",
    "Alle ablehnen", "Mehr erfahren", "Read more", "JavaScript", "javascript", "Enable JavaScript",
    "Zur Hauptnavigation", "Zum Inhalt springen", "Skip to content", "Skip to main",
]

# Fixed values of the settings intent: action words, themes, colours, languages; the first hit of each counts.
ACTION_WORDS = [
    "make", "mach", "yap", "set", "change", "switch", "stelle", "ändere", "değiştir", "seite", "page", "sayfa",
    "site", "webseite", "website", "mode",
]
THEMES = [("dark", ["dark", "dunkel", "koyu"]), ("light", ["light", "hell", "açık", "bright"])]
BACKGROUND_WORDS = ["background", "hintergrund", "arka plan"]
COLOURS = [
    ("#44d7a8", ["green", "grün", "yeşil"]), ("#e05566", ["red", "rot", "kırmızı"]), ("#4488ee", ["blue", "blau", "mavi"]),
    ("#7c6ef0", ["purple", "lila", "mor"]), ("#e08844", ["orange", "turuncu"]), ("#e055aa", ["pink", "rosa", "pembe"]),
    ("#e0c844", ["yellow", "gelb", "sarı"]), ("#44c8d7", ["cyan", "türkis"]), ("#0a0a0a", ["black", "schwarz", "siyah"]),
    ("#f5f5f5", ["white", "weiß", "beyaz"]),
]
LANGUAGES = [
    ("en", ["english", "englisch", "ingilizce"]), ("de", ["german", "deutsch", "almanca"]), ("tr", ["turkish", "türkisch", "türkçe"]),
]

# Typographic ligatures and what they stand for.
LIGATURES = {"ﬁ": "fi", "ﬂ": "fl", "ﬀ": "ff", "ﬃ": "ffi", "ﬄ": "ffl"}


def _split_clean(text: Column, pattern: str) -> Column:
    return F.filter(F.split(text, pattern), lambda x: x != "")


def tokenize(text: Column) -> Column:
    """Lower-case words; everything but letters and white space is deleted, so foo-bar is one word."""
    return _split_clean(F.regexp_replace(F.lower(text), r"[^\p{IsAlphabetic}\p{IsWhite_Space}]", ""), r"[\p{IsWhite_Space}]+")


def index_tokens(text: Column) -> Column:
    """Tokens of the inverted index: split at everything but letters and digits, tokens of one byte dropped."""
    return F.filter(F.split(F.lower(text), r"[^\p{IsAlphabetic}\p{N}]+"), lambda x: F.octet_length(x) > 1)


def unique_terms(text: Column) -> Column:
    return F.array_sort(F.array_distinct(tokenize(text)))


def remove_stopwords(tokens: Column, language: Column) -> Column:
    """Copies of a word stay; a null language counts as English."""
    german = F.coalesce(F.lower(language).isin("de", "deu", "german"), F.lit(False))
    return F.when(german, F.filter(tokens, lambda t: ~t.isin(STOPWORDS["de"]))).otherwise(F.filter(tokens, lambda t: ~t.isin(STOPWORDS["en"])))


def jaccard(a: Column, b: Column) -> Column:
    """Of the sets of words; 0 where neither has a word."""
    x, y = tokenize(a), tokenize(b)
    union = F.size(F.array_union(x, y))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(x, y)) / union)


def char_ngrams(text: Column, n: int) -> Column:
    """All n-grams of characters; none of an empty text or for n = 0, the text itself if it is shorter."""
    if n <= 0:
        return F.when(text.isNotNull(), F.array().cast("array<string>"))
    size = F.char_length(text)
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), size - n + 1)), lambda i: F.substring(text, i, F.lit(n)))
    return F.when(size == 0, F.array().cast("array<string>")).when(size < n, F.array(text)).otherwise(grams)


def _share(text: Column, outside: str) -> Column:
    """The share of characters that are not `outside`."""
    return F.char_length(F.regexp_replace(text, outside, "")) / F.char_length(text)


def is_garbage(text: Column) -> Column:
    """More than 15 % replacement, private-use, control or supplementary characters, or less than 30 % readable ones; empty is not."""
    t = F.trim(text)
    garbage = _share(t, r"[^\x{FFFD}\x{E000}-\x{F8FF}\x{10000}-\x{10FFFF}\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F]")
    readable = _share(t, r"[^\p{IsAlphabetic}\p{N}\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E \t\n\r\x0C]")
    return F.when(F.char_length(t) == 0, F.lit(False)).otherwise((garbage > 0.15) | (readable < 0.30))


def is_binary(text: Column, empty: bool = True) -> Column:
    """More than 10 % odd characters or more than 10 % replacement characters; `empty` is the verdict on an empty text."""
    odd = _share(text, r"[\p{IsAlphabetic}\p{N}\p{IsWhite_Space}\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]")
    replaced = _share(text, r"[^\x{FFFD}]")
    return F.when(F.char_length(text) == 0, F.lit(empty)).otherwise((odd > 0.10) | (replaced > 0.10))


def _collapse(line: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(line, r"^[\p{IsWhite_Space}]+|[\p{IsWhite_Space}]+$", ""), r"[\p{IsWhite_Space}]+", " ")


def clean_page(text: Column) -> Column:
    """Crawled text: lines trimmed, white space collapsed, lines under 3 bytes or with a junk phrase dropped; binary text is ''."""
    lines = F.transform(F.split(text, "\r?\n"), _collapse)
    junk = "|".join(p.replace(".", r"\.") for p in JUNK_PHRASES)
    kept = F.filter(lines, lambda x: (F.octet_length(x) >= 3) & ~x.rlike(junk))
    return F.when(is_binary(text, empty=False), F.lit("")).otherwise(F.array_join(kept, "\n"))


def clean_content(text: Column) -> Column:
    """Text before pairs are made of it: lines trimmed and collapsed, blank ones dropped; binary or empty text is ''."""
    lines = F.filter(F.transform(F.split(text, "\r?\n"), _collapse), lambda x: x != "")
    return F.when(is_binary(text), F.lit("")).otherwise(F.array_join(lines, "\n"))


def clean_document(text: Column) -> Column:
    """Text of a document page that is already NFC: ligatures, controls, broken words, blanks and page-number lines."""
    t = reduce(lambda c, x: F.replace(c, F.lit(x[0]), F.lit(x[1])), LIGATURES.items(), text)
    t = F.regexp_replace(t, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F]", "")
    t = F.regexp_replace(t, r"(?U)(\w)-\s*\n\s*(\w)", "$1$2")
    t = F.replace(F.replace(t, F.lit("\t"), F.lit(" ")), F.lit("\r\n"), F.lit("\n"))
    t = F.regexp_replace(F.regexp_replace(t, r" {2,}", " "), r"\n{3,}", "\n\n")
    lines = F.filter(F.split(t, "\r?\n"), lambda x: ~x.rlike(r"(?U)^\s*-?\s*\d{1,4}\s*-?\s*$"))
    return F.regexp_replace(F.array_join(lines, "\n"), r"^[\p{IsWhite_Space}]+|[\p{IsWhite_Space}]+$", "")


def heading_question(heading: Column) -> Column:
    """The question a heading stands for, by the first rule that fits; a colon at the end goes."""
    h = F.regexp_replace(heading, r"^[\p{IsWhite_Space}]+|[\p{IsWhite_Space}]+$", "")
    low, bare = F.lower(h), F.regexp_replace(h, ":+$", "")
    starts = lambda *p: reduce(lambda a, b: a | b, [low.startswith(x) for x in p])
    # The blank after the cut word stays, hence two blanks.
    about = lambda n: F.regexp_replace(F.substring(h, F.lit(n), F.char_length(h)), ":+$", "")
    return (
        F.when(h.endswith("?"), h)
        .when(starts("über "), F.concat(F.lit("Was kann man über "), about(5), F.lit(" erfahren?")))
        .when(starts("about "), F.concat(F.lit("What is "), about(7), F.lit("?")))
        .when(starts("how to", "wie ", "warum", "why"), F.concat(bare, F.lit("?")))
        .when(starts("kontakt", "contact"), F.concat(F.lit("Wie erreicht man "), bare, F.lit("?")))
        .when(starts("faq", "häufige fragen"), F.concat(F.lit("Welche häufigen Fragen gibt es zu "), bare, F.lit("?")))
        .otherwise(F.concat(F.lit("Was ist "), bare, F.lit("?")))
    )


def sentence_question(sentence: Column) -> Column:
    edge = r"^[\p{IsWhite_Space}]+|[\p{IsWhite_Space}]+$"
    s = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(sentence, edge, ""), r"\.+$", ""), "!+$", ""), edge, "")
    named = F.lower(s).rlike(r"^(wir |unser|die |das |der )")
    return F.when(s.endswith("?") | (s == ""), s).when(named, F.concat(F.lit("Was bedeutet: "), s, F.lit("?"))).otherwise(F.concat(F.lit("Was ist "), s, F.lit("?")))


def _first(low: Column, choices: list[tuple[str, list[str]]]) -> Column:
    has = lambda words: reduce(lambda a, b: a | b, [low.contains(w) for w in words])
    return F.coalesce(*[F.when(has(words), F.lit(value)) for value, words in choices])


def settings_intent(text: Column) -> Column:
    """struct(theme, colour, target, language) of a message that asks to change settings, else null. Substrings count."""
    low = F.lower(text)
    has = lambda words: reduce(lambda a, b: a | b, [low.contains(w) for w in words])
    theme, colour, language = _first(low, THEMES), _first(low, COLOURS), _first(low, LANGUAGES)
    target = F.when(colour.isNotNull(), F.when(has(BACKGROUND_WORDS), "bg_color").otherwise("accent_color"))
    found = has(ACTION_WORDS) & F.coalesce(theme, colour, language).isNotNull()
    return F.when(found, F.struct(theme.alias("theme"), colour.alias("colour"), target.alias("target"), language.alias("language")))
