"""Broken prompt and response pairs.

Ordered rules on the answer of each pair: emptiness, copied question, refusal, unclosed delimiters and abrupt
endings, mismatch of script and, within the Latin one, of language. `pair_defects` emits every triggered defect;
`first_defect` keeps the first in that order.

The rules are built-in expressions, evaluated once: what a row alone can tell is written as flags. Only abrupt endings
look beyond their own row: how often each word ends a sentence anywhere in the data is counted over all answers with
map-side combining, and the answers in question are joined with that vocabulary.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loregrid.session import written

DEFECTS = ("empty", "copy", "refusal", "truncated", "other_language")

#: What stands for no answer, lower case, without outer punctuation.
PLACEHOLDERS = (
    "n/a na none null nil nan todo tbd tba empty unknown undefined placeholder missing "
    "keine leer vide vacío vacio aucune ninguna ninguno"
).split() + ["no answer", "no response", "keine antwort", "pas de réponse", "sin respuesta"]

#: Labels that may stand before an answer.
LABELS = r"answer|a|antwort|réponse|reponse|respuesta|response|output|you asked|your question|sie fragten|question|frage|vous avez demandé|usted preguntó"

#: Words that occur in one of the four languages only.
FUNCTION_WORDS = {
    "en": "the of and is are to with from that this which what when how many does do your you it its be by on at not no nor neither before after each every some most if there for an has have within because although while was were may can where why who one between our people",
    "de": "der die das den dem des und ist sind mit von vom zu zum zur wenn nicht oder auch ohne bis nach vor bei beim im am an auf aus für wie viele warum wo wer was welche kann ich wir sie ihre keine alle alten einen eine ein zwischen obwohl sonst erst dann seit über unter hinter neben während später genau als weder noch dürfen",
    "fr": "le les des du et est sont dans pour avec sur aux au une un qui ne pas plus chez quand mais où leur ce cette ces sans comment combien pourquoi que faire quelles quels faut il après avant seulement ni près derrière tard",
    "es": "el los las del y son está para con por una uno que cómo cuántos cuántas qué dónde pero muy más todo todos sin cuando faltan solo antes junto bajo desde entre quién puedo cerca dentro tarde casi lo ni cada",
}

#: Ways to decline, by language; the whole sentence must be one.
_POLITE = (
    r"(?:(?:i'?m |i am |we are |so )?(?:very )?sorry,?(?: but)?|regrettably,?|unfortunately,?|at this point,?|i (?:do )?apologi[sz]e[,;:]?(?: but)?|as an? [\p{L} -]{2,40},"
    r"|es tut mir leid,?(?: aber)?|tut mir leid,?(?: aber)?|leider,?|bedauerlicherweise,?|als \p{L}+,?"
    r"|désolée?,?(?: mais)?|je suis désolée?,?(?: mais)?|malheureusement,?|en tant que [\p{L}' -]{2,40},|je regrette,?(?: mais)?"
    r"|lo siento,?(?: pero)?|por desgracia,?|lamentablemente,?|desafortunadamente,?|lo lamento,?(?: pero)?|como [\p{L} -]{2,40},)?\s*"
)
_DECLINES = (
    r"(?:(?:this is something )?(?:i|we)(?:'m| am|'re| are)? (?:cannot|can't|can not|unable to|not able to|not allowed to|not permitted to|must decline to|have to decline to|decline to|won't|will not|may not|must not)\b.{0,90}"
    r"|(?:there is )?nothing (?:that )?i can (?:say|do)\b.{0,80}"
    r"|(?:that|this) is (?:something|nothing) i(?:'m| am) not .{0,60}"
    r"|(?:darf|kann|möchte|werde) ich\b.{0,30}\b(?:nicht|keine?n?)\b.{0,50}|ich (?:darf|kann|möchte|werde)\b.{0,30}\b(?:nicht|keine?n?)\b.{0,50}"
    r"|(?:es )?ist (?:es )?mir (?:leider )?(?:nicht (?:möglich|erlaubt|gestattet)|unmöglich)\b.{0,80}|muss ich (?:leider )?ablehnen.{0,40}"
    r"|(?:je )?(?:ne )?(?:peux|puis|suis|dois)\b.{0,12}\b(?:pas|refuser|décliner)\b.{0,70}|il (?:ne )?m'est (?:pas (?:possible|permis)|impossible)\b.{0,60}|je ne suis pas (?:en mesure|autorisée?)\b.{0,60}"
    r"|no (?:me es posible|puedo|estoy autorizad[oa]|estoy en condiciones|tengo permitido|se me permite)\b.{0,60}|me es imposible\b.{0,60}|debo (?:rechazar|negarme)\b.{0,60})"
)
_TOPIC = (
    r"\b(?:help|answer|respond|provide|discuss|assist|say|comment|share|disclose|do|tell"
    r"|helfen|beantworten|antworten|sagen|äußern|geben|ablehnen|mitteilen"
    r"|répondre|aider|dire|fournir|discuter|parler|refuser|décliner|communiquer"
    r"|responder|ayudar|decir|proporcionar|dar|comentar|hablar|rechazar|negarme|facilitar)\b"
)
_COURTESY = (
    r"(?:please ask .{0,40}|is there anything else.{0,20}|bitte (?:fragen|wenden) sie .{0,40}|merci de (?:demander|contacter) .{0,40}"
    r"|(?:pregunte|consulte) a .{0,40}|kann ich sonst .{0,30}|gibt es sonst noch .{0,30}|puis-je .{0,40}|y a-t-il autre .{0,20}|¿?(?:puedo|hay algo|algo) .{0,30}|i (?:hope|suggest) .{0,40})"
)

#: A question that asks for another language.
_ASKS_LANGUAGE = (
    r"(?i)\b(?:translat\w*|übersetz\w*|tradui\w*|traduc\w*|traduz\w*)\b"
    r"|\b(?:in|into|to) (?:english|german|french|spanish)\b|\b(?:auf|ins) (?:englisch\w*|deutsch\w*|französisch\w*|spanisch\w*)\b"
    r"|\ben (?:anglais|allemand|français|espagnol|inglés|alemán|francés|español)\b|\bal (?:inglés|alemán|francés|español)\b"
)

_END = r"[.!?][\"'”’»)\]*_`]*$"


def answer_text(value: Column, fmt: Column | None = None) -> Column:
    """The text of an answer: JSON answers give their answer field, anything else is text as it stands."""
    looks = F.trim(value).startswith("{")
    if fmt is not None:
        looks = looks | (F.coalesce(fmt, F.lit("")) == "Json")
    parsed = F.coalesce(*[F.get_json_object(value, f"$.{k}") for k in ("answer", "output", "text", "response")])
    return F.when(looks & F.get_json_object(value, "$").isNotNull(), F.coalesce(parsed, F.lit(""))).otherwise(value)


def _plain(text: Column) -> Column:
    """Without labels, markup, entities and outer blanks."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?s)<[^>]{0,200}>|&[a-zA-Z]{2,8};|&#\d+;", " ")
    t = F.regexp_replace(t, r"[\p{Z}\p{C}\s]+", " ")
    t = F.regexp_replace(t, rf"(?i)^[\s>*_#`\[\]|-]*(?:{LABELS})\s*[:：][\s*_>]*", "")
    return F.trim(F.regexp_replace(t, r"^[\s>*_#`|=~-]+|[\s*_#`|=~-]+$", ""))


def _tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


#: Scripts whose letters are told apart; the last one is that of East Asia.
SCRIPTS = {
    "latin": r"\p{IsLatin}", "cyrillic": r"\p{IsCyrillic}", "greek": r"\p{IsGreek}", "arabic": r"\p{IsArabic}", "hebrew": r"\p{IsHebrew}",
    "devanagari": r"\p{IsDevanagari}", "thai": r"\p{IsThai}", "hangul": r"\p{IsHangul}", "han": r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}",
}


def script(text: Column) -> Column:
    """The script most letters of a text are of, null without letters. Only texts with letters of several are counted."""
    letters = lambda k: F.length(F.regexp_replace(text, rf"[^{SCRIPTS[k]}]", ""))
    most = F.array_max(F.array(*[F.struct(letters(k).alias("n"), F.lit(k).alias("script")) for k in SCRIPTS]))
    latin = F.when(text.rlike(r"\p{IsLatin}"), F.lit("latin"))
    return F.when(text.rlike(r"[\p{L}&&[^\p{IsLatin}]]"), F.when(most["n"] > 0, most["script"])).otherwise(latin)


def _with_language(df: DataFrame, tokens: str, out: str) -> DataFrame:
    """df with the language whose function words an array of words has most of, null where none leads."""
    among = lambda words: lambda w: w.isin(*words.split())
    df = df.withColumns({f"_{k}": F.size(F.filter(F.col(tokens), among(v))) for k, v in FUNCTION_WORDS.items()})
    score = [F.col(f"_{k}") for k in FUNCTION_WORDS]
    df = df.withColumn("_best", F.greatest(*score))
    alone = sum((s == F.col("_best")).cast("int") for s in score) == 1
    leads = F.coalesce(*[F.when(F.col(f"_{k}") == F.col("_best"), F.lit(k)) for k in FUNCTION_WORDS])
    return df.withColumn(out, F.when((F.col("_best") >= 2) & alone, leads)).drop("_best", *[f"_{k}" for k in FUNCTION_WORDS])


def _sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+"), lambda s: F.trim(s)), lambda s: s != "")


def _vocabulary(answers: DataFrame) -> DataFrame:
    """word, n (uses), ends (those at the end of a sentence or line), stops (those before a full stop), stem (begins a longer known word)."""
    pieces = answers.select(F.explode(F.split(F.lower("text"), r"(?<=[.!?])\s+|:\s+|\n")).alias("piece"))
    words = F.filter(F.split("piece", r"[^\p{L}\p{N}'’-]+"), lambda w: w != "")
    spots = pieces.select(words.alias("w"), F.col("piece").rlike(r"[\p{L}\p{N}'’-][.!?]$").alias("closed"))
    spots = spots.select(F.posexplode("w").alias("i", "word"), F.size("w").alias("of"), "closed")
    end = F.col("i") == F.col("of") - 1
    known = spots.groupBy("word").agg(F.count("*").alias("n"), F.count_if(end).alias("ends"), F.count_if(end & F.col("closed")).alias("stops"))
    known = written(known, "answer-words")
    stems = known.filter("n >= 5 AND n > ends").select(
        F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("word") - 1)), lambda k: F.substring("word", F.lit(1), k))).alias("word"),
        F.length("word").alias("len"),
    )
    stems = stems.groupBy("word").agg(F.max("len").alias("longest")).filter(F.col("longest") > F.length("word"))
    return known.join(stems.select("word", F.lit(True).alias("stem")), "word", "left")


def pair_defects(pairs: DataFrame, question: str, answer: str, fmt: str | None = None) -> DataFrame:
    """pairs with the column `defects`, an array of every triggered defect in the order of DEFECTS.

    A null or blank question triggers neither copy nor other_language; a null or blank answer is empty. Whole texts
    are judged, however long. Other columns are kept, whatever their names. Rows are never dropped, copies of a row
    included; an empty table gives no rows.
    """
    q, value = F.col(question), F.col(answer)
    text = answer_text(value, F.col(fmt) if fmt else None)
    work = pairs.select(F.struct(*[F.col(c) for c in pairs.columns]).alias("row"), F.coalesce(q, F.lit("")).alias("q"), value.alias("value"), F.coalesce(text, F.lit("")).alias("text"))
    work = work.withColumn("plain", _plain(F.col("text")))
    bare = F.lower(F.regexp_replace("plain", r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))
    work = work.withColumns({"bare": bare, "q_words": _tokens(F.col("q")), "a_words": _tokens(F.col("plain"))})
    empty = F.col("value").isNull() | (F.col("bare") == "") | F.col("bare").isin(*PLACEHOLDERS) | F.col("bare").rlike(rf"^(?:{LABELS})$")
    # copy: the words of the question, but for a few, or its first or last words
    work = work.withColumns({"empty": empty, "qw": F.array_join("q_words", " "), "aw": F.array_join("a_words", " ")})
    allowed = F.greatest(F.lit(3), F.floor(F.length("qw") * 0.2)).cast("int")
    near = F.when(F.abs(F.length("qw") - F.length("aw")) <= allowed, F.levenshtein("qw", "aw"))
    long = F.size("a_words") >= 4
    prefix = long & (F.length("aw") >= 0.6 * F.length("qw")) & F.col("qw").startswith(F.col("aw"))
    suffix = long & F.col("qw").endswith(F.col("aw"))
    last_question = F.when(suffix, F.array_join(_tokens(F.element_at(_sentences(F.when(F.col("q") == "", " ").otherwise(F.col("q"))), -1)), " "))
    copy = (F.length("qw") > 0) & (F.length("aw") > 0) & (F.coalesce(near <= allowed, F.lit(False)) | prefix | F.coalesce(F.col("aw") == last_question, F.lit(False)))
    # refusal: every sentence declines or is a courtesy, and one declines; the first that does neither ends the look
    sentence = lambda s: F.regexp_replace(F.lower(s), r"[.!?\s\"'”»]+$|^[\"'“«\s]+", "")
    declines = lambda s: s.rlike(rf"^{_POLITE}{_DECLINES}$") & s.rlike(_TOPIC)
    work = work.withColumn("copied", copy).withColumn("said", F.transform(_sentences(F.regexp_replace("plain", "’", "'")), sentence))
    refusal = (F.size("said") > 0) & F.forall("said", lambda s: declines(s) | s.rlike(rf"^{_COURTESY}$")) & F.exists("said", declines)
    # truncated, as far as a row alone can tell
    t = F.rtrim(F.regexp_replace("text", r"[\p{Z}\p{C}\s]+$", ""))
    work = work.withColumns({"refused": refusal, "t": t})
    count = lambda c: F.length("t") - F.length(F.replace("t", F.lit(c), F.lit("")))
    broken_json = F.trim("value").startswith("{") & F.get_json_object("value", "$").isNull()
    fences = (F.regexp_count("t", F.lit("```")) % 2) == 1
    line = F.trim(F.regexp_replace(F.element_at(F.split("t", "\n"), -1), r"^\s*(?:[-*•#>]+|\d+[.)])\s*", ""))
    work = work.withColumns({"line": line, "open": broken_json | fences | (count("(") > count(")")) | (count("[") > count("]")) | (count("{") > count("}"))})
    listed = F.col("t").contains("\n") & F.col("t").rlike(r"(?m)^\s*(?:[-*•]|\d+[.)])\s+\S")
    code = F.col("t").endswith("```") | F.col("line").rlike(r"^(?:https?://|www\.)\S+$") | F.col("text").startswith("{")
    work = work.withColumns({"done": F.col("line").rlike(_END) | code, "n_words": F.size(F.split("line", r"\s+"))})
    work = work.withColumn("listed", ~F.col("done") & listed)
    ends_open = ~F.col("done") & F.col("line").rlike(r"[,;:(\[{…‐–—-]$") | F.col("line").rlike(r"\S\s*\.\.\.$")
    long_open = ~F.col("done") & ~F.col("listed") & (F.col("n_words") >= 6)
    unsure = ~F.col("done") & (F.col("listed") | ((F.col("n_words") < 6) & (F.col("n_words") > 1)))
    work = work.withColumns({
        "broken_off": F.col("open") | ends_open | long_open,
        "word": F.when(unsure, F.lower(F.regexp_extract("line", r"([\p{L}\p{N}'’-]+)[^\p{L}\p{N}]*$", 1))),
    })
    # other language: another script, or within one the function words of another language
    prose = F.when(F.col("plain").contains("```"), _tokens(F.regexp_replace("plain", r"(?s)```.*?(?:```|$)", " "))).otherwise(F.col("a_words"))
    work = _with_language(_with_language(work.withColumn("prose", prose), "q_words", "ask"), "prose", "reply")
    work = work.withColumns({"q_script": script(F.col("qw")), "a_script": script(F.array_join("prose", " "))})
    mixed = F.col("q_script") != F.col("a_script")
    other = F.coalesce(mixed | (F.col("ask") != F.col("reply")), mixed, F.lit(False)) & ~F.col("q").rlike(_ASKS_LANGUAGE)
    # written once, so that no rule is repeated and no filter sinks below the rules
    flags = work.withColumn("other", other).select("row", "text", "empty", "copied", "refused", "broken_off", "word", "other")
    flags = written(flags, "pair-flags")
    # abrupt endings: a word that hardly ever ends a sentence, or the beginning of a longer word
    vocabulary = flags.select("word").filter("word IS NOT NULL").distinct().join(_vocabulary(flags), "word", "left")
    n, ends = F.coalesce("n", F.lit(0)), F.coalesce("ends", F.lit(0))
    abrupt = ((n >= 20) & (ends < 0.004 * n)) | ((n - ends <= 0) & (F.coalesce("stops", F.lit(0)) == 0) & F.coalesce("stem", F.lit(False)))
    flags = flags.join(vocabulary.filter(abrupt).select("word", F.lit(True).alias("abrupt")), "word", "left")
    truncated = F.col("broken_off") | F.coalesce("abrupt", F.lit(False))
    kinds = dict(zip(DEFECTS, (F.col("empty"), F.col("copied"), F.col("refused"), truncated, F.col("other"))))
    return flags.select("row.*", F.array_compact(F.array(*[F.when(v, k) for k, v in kinds.items()])).alias("defects"))


def first_defect(pairs: DataFrame, question: str, answer: str, fmt: str | None = None) -> DataFrame:
    """The rows of pairs with a defect, with the first one as `defect`."""
    found = pair_defects(pairs, question, answer, fmt).filter(F.size("defects") > 0)
    return found.withColumn("defect", F.col("defects")[0]).drop("defects")


def defective(examples: DataFrame, approved: DataFrame) -> DataFrame:
    """(src, pair_id, defect) of both tables."""
    a = examples.select(F.lit("examples").alias("src"), F.col("idx").alias("pair_id"), "input", F.col("output.value").alias("value"), F.col("output.format").alias("fmt"))
    b = approved.select(F.lit("approved_data").alias("src"), F.col("id").alias("pair_id"), "input", F.col("output").alias("value"), F.lit(None).cast("string").alias("fmt"))
    return first_defect(a.unionByName(b), "input", "value", "fmt").select("src", "pair_id", "defect")
