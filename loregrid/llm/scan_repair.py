"""Noise in text from scanned pages.

Lines of all pages are laid out as rows. Running headers, footers and page numbers are lines at the edge of a page
that come back on other pages of the file once digits are masked and glyphs that scanners confuse are drawn together.
Words are grouped by such a skeleton over all files; a rare form beside a far more frequent one of the same skeleton
is a misreading. Where several frequent forms share the skeleton, the words before and behind decide which of them was
meant: the one that stands between such neighbours most often elsewhere, which also keeps languages apart. Words broken
at line ends are told from hyphenated compounds by what is a word elsewhere.
Lines are then reflowed into paragraphs with SQL windows over blocks of pages, so that no file lies in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loregrid.session import written

#: Lines of a page, from either end, among which a header, footer or page number may stand.
EDGE = 3
#: Uses of a form that make it a word, and the share of those that a misreading of it may reach.
KNOWN, RARE = 5, 0.02
#: Pages of one window; bounds its rows whatever the size of a file.
PAGE_BLOCK = 500

# Hyphens a broken line may end with.
HYPHENS = "-‐‑¬­"
_BROKEN = rf"[{HYPHENS}]+\s*$"
_ROMAN = r"(?=[ivxlcdm])m{0,3}(?:cm|cd|d?c{0,3})(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})"
_DIGITS = r"[\dlIO|!]{1,4}"
_NUMBER = rf"(?i)^[^\p{{L}}\p{{N}}]*(?:(?:page|seite|p|s|pág|página|pag)\.?\s*)?(?:\d{{1,4}}|{_ROMAN})(?:\s*(?:/|of|von|sur|de)\s*\d{{1,4}})?[^\p{{L}}\p{{N}}.,;:]*$|^[^\p{{L}}\p{{N}}]*(?:page|seite|página|pág)\.? +{_DIGITS}(?: +(?:/|of|von|sur|de) +{_DIGITS})?[^\p{{L}}\p{{N}}.,;:]*$|^\W*[lIO]{{2,3}}\W*$"
# a title with a page number set apart from it
_NUMBERED = rf"^\s*{_DIGITS}\s{{2,}}\p{{Lu}}.*[^.,;:]$|^\s*\p{{Lu}}.*[^.,;:]\s(?:\s+|[/|·–-] ){_DIGITS}\s*$"
_TITLE = r"^\s*(?:\d+\. )?[\p{Lu}�*|~^_][^.!?;]{2,70}$"
_BAD_NUMBER = r"^[^\p{L}\p{N}]*(?=[^ ]*[0-9|!vxiVXI])[0-9lIOoS|!vxciVX·~^*'�]{1,7}[^\p{L}\p{N}.,;:]*$"
_STRAY = r"(?<=\p{L})[·*|~^_�!¦§°¨`´](?=\p{L})|�|(?<=\s)[~^|_¦¬`´](?=\s)|(?<=\p{L})[|~^_�](?=[\s.,;]|$)|(?:^|(?<=\s))[|~^_](?=\p{L})"
_MIXED = r"(?:^|\s)(?:\d+[lIO|]+\d*|[lIO|]+\d+)(?=[\s.,;]|$)"
_CODE = r"^\p{Lu}{1,3}-?\d+$"


def skeleton(word: Column) -> Column:
    """A word with all glyphs drawn together that scanners take for each other; strays vanish."""
    s = F.regexp_replace(F.lower(word), r"[^\p{L}\p{N}|!$]", "")
    for glyph, as_ in (("d", "cl"), ("m", "rn"), ("w", "vv"), ("n", "ri")):
        s = F.replace(s, F.lit(glyph), F.lit(as_))
    pairs = {"a": "o", "0": "o", "e": "c", "1": "l", "|": "l", "!": "l", "i": "l", "h": "b", "6": "b", "y": "v", "u": "v", "5": "s", "$": "s", "9": "g", "q": "g"}
    return F.translate(s, "".join(pairs), "".join(pairs.values()))


def masked(line: Column) -> Column:
    """A line for comparison with others: digits and roman numbers masked, then its skeleton."""
    t = F.regexp_replace(F.lower(line), r"\d+", "#")
    t = F.regexp_replace(t, rf"(?:^|(?<=[\s/.·-])){_ROMAN}(?=$|[\s/.·-])", "#")
    return F.concat(skeleton(F.replace(t, F.lit("#"), F.lit(""))), F.when(t.contains("#"), "#").otherwise(""))


def lines_of(pages: DataFrame) -> DataFrame:
    """(page_id, pdf_id, page_number, line_no, text, top, bottom, n) of each line that is not blank, places counted from both ends.

    pages: page_id, pdf_id, page_number, text. Null texts have no lines. A null pdf_id is a file of its own page.
    """
    p = pages.select("page_id", F.coalesce("pdf_id", -F.col("page_id") - 1).alias("pdf_id"), F.coalesce("page_number", F.lit(0)).alias("page_number"), "text").distinct()
    # a page is one row, so places are counted before its lines become rows of their own
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.struct((i + 1).alias("line_no"), F.regexp_replace(x, "\r", " ").alias("text")))
    shown = F.filter(lines, lambda x: x["text"].rlike(r"[^\p{Z}\p{C}\s]"))
    rows = p.select("page_id", "pdf_id", "page_number", shown.alias("lines")).select("page_id", "pdf_id", "page_number", F.size("lines").alias("n"), F.posexplode("lines").alias("at", "line"))
    return rows.select("page_id", "pdf_id", "page_number", "line.line_no", "line.text", (F.col("at") + 1).alias("top"), "n", (F.col("n") - F.col("at")).alias("bottom"))


def _running(lines: DataFrame) -> DataFrame:
    """(page_id, line_no) of headers, footers and page numbers."""
    edge = lines.filter((F.col("top") <= EDGE) | (F.col("bottom") <= EDGE))
    t = F.trim("text")
    number = t.rlike(_NUMBER) | (t.rlike(_BAD_NUMBER) & (F.length(t) <= 12))
    numbered = t.rlike(_NUMBERED) & (F.least("top", "bottom") <= 2) & (F.length(t) <= 80)
    edge = edge.withColumns({"number": (number & (F.length(t) <= 24)) | numbered, "key": masked(F.col("text")), "zone": F.when(F.col("top") <= F.col("bottom"), "top").otherwise("bottom")})
    edge = written(edge, "page-edges")
    keys = edge.filter((F.length("key") >= 3) & ~F.col("number")).select("pdf_id", "zone", "key", "page_number").distinct()
    keys = keys.groupBy("pdf_id", "zone", "key").agg(F.count("*").alias("pages")).filter("pages >= 2").select("pdf_id", "zone", F.col("key").alias("header"))
    # Distinct edges are compared with the headers of their own file and zone, misread ones within a few glyphs.
    edges = edge.filter("NOT number")
    near = edges.select("pdf_id", "zone", "key").distinct().join(keys, ["pdf_id", "zone"])
    close = F.expr("length(header) >= 8 AND levenshtein(key, header, CAST(least(12, greatest(1, floor(length(header) * 0.2))) AS INT)) >= 0")
    limit = F.greatest(F.lit(1), F.floor(F.length("header") * 0.2))
    same = (F.col("key") == F.col("header")) | ((F.abs(F.length("key") - F.length("header")) <= limit) & close)
    matched = edges.join(near.filter(same).select("pdf_id", "zone", "key").distinct(), ["pdf_id", "zone", "key"], "left_semi").select("page_id", "line_no")
    out = edge.filter("number").select("page_id", "line_no").unionByName(matched)
    return out.distinct()


def _with_neighbours(text: DataFrame) -> DataFrame:
    """text with `before` and `after`: the last line of text of the page before, the first of the page after (and where it is).

    Pages of a file that have text follow each other whatever their numbers; of a page scanned twice the first scan
    counts. Windows run over blocks of pages, and one row for each block tells how it begins and ends.
    """
    ends = text.groupBy("pdf_id", "page_number").agg(
        F.min_by(F.struct("text", "page_id", "line_no"), F.struct("page_id", "line_no")).alias("head"),
        F.max_by("text", F.struct(-F.col("page_id"), F.col("line_no"))).alias("tail"),
    )
    ends = ends.withColumn("block", F.floor(F.col("page_number") / PAGE_BLOCK))
    inside = Window.partitionBy("pdf_id", "block").orderBy("page_number")
    ends = ends.withColumns({"after": F.lead("head").over(inside), "before": F.lag("tail").over(inside)})
    blocks = ends.groupBy("pdf_id", "block").agg(F.min_by("head", "page_number").alias("b_head"), F.max_by("tail", "page_number").alias("b_tail"))
    by_block = Window.partitionBy("pdf_id").orderBy("block")
    blocks = blocks.select("pdf_id", "block", F.lead("b_head").over(by_block).alias("later"), F.lag("b_tail").over(by_block).alias("earlier"))
    ends = ends.join(blocks, ["pdf_id", "block"]).select("pdf_id", "page_number", F.coalesce("after", "later").alias("_after"), F.coalesce("before", "earlier").alias("before"))
    ends = ends.withColumns({"after": F.col("_after.text"), "after_at": F.struct("_after.page_id", "_after.line_no")}).drop("_after")
    return text.join(ends, ["pdf_id", "page_number"], "left")


def _interrupting(text: DataFrame) -> DataFrame:
    """(page_id, line_no) of titles at the edge of a page in the midst of a sentence: headers that no other page repeats."""
    page = Window.partitionBy("pdf_id", "page_number", "page_id").orderBy("line_no")
    lines = text.withColumns({"up": F.lag("text").over(page), "down": F.lead("text").over(page)})
    lines = _with_neighbours(lines.filter("(up IS NULL OR down IS NULL) OR top <= 2"))
    title = F.col("text").rlike(_TITLE)
    open_ = lambda c: F.col(c).isNotNull() & ~F.col(c).rlike(r"[.!?:…][\"'»”)]*\s*$")
    goes_on = lambda c: F.col(c).rlike(r"^\s*\p{Ll}")
    top = F.col("up").isNull() & title & open_("before") & goes_on("down") & ~F.col("before").rlike(_TITLE)
    bottom = F.col("down").isNull() & title & open_("up") & goes_on("after") & ~F.col("up").rlike(_TITLE)
    return lines.filter(top | bottom).select("page_id", "line_no")


def _next_lines(text: DataFrame) -> DataFrame:
    """text with `next`, the line of text that follows it, on the same page or the next one of the file that has any."""
    page = Window.partitionBy("pdf_id", "page_number", "page_id").orderBy("line_no")
    down = F.lead(F.struct("page_id", "line_no")).over(page)
    text = _with_neighbours(text).withColumns({"next": F.coalesce(F.lead("text").over(page), "after"), "next_at": F.coalesce(down, "after_at")})
    return text.drop("after", "after_at", "before")


_OUTER = r"^[\s\"'«»“”„‚‘’(\[¿¡]+|[\s.,;:?\"«»“”‘’)\]…]+$"


def _bare(word: Column) -> Column:
    return F.lower(F.regexp_replace(word, _OUTER, ""))


def _first_word(line: Column) -> Column:
    return F.regexp_extract(line, r"^\s*(\S+)", 1)


def _last_word(line: Column) -> Column:
    return F.regexp_extract(line, r"(\S+)\s*$", 1)


def vocabulary(text: DataFrame) -> DataFrame:
    """(word, n): how often each form stands inside a line, all files together; words at line ends may be broken."""
    inner = F.slice(F.split(F.trim("text"), r"\s+"), 2, F.greatest(F.lit(0), F.size(F.split(F.trim("text"), r"\s+")) - 2))
    return text.select(F.explode(inner).alias("w")).select(_bare(F.col("w")).alias("word")).filter("word <> ''").groupBy("word").agg(F.count("*").alias("n"))


def misread_forms(words: DataFrame, others: DataFrame | None = None) -> DataFrame:
    """(word, form): each rare form, and the frequent form of the same skeleton it is a misreading of.

    Frequent forms are those of words (word, n); the forms judged are the same ones, or others (word, n).
    """
    shaped = lambda df: df.filter(~F.col("word").rlike(r"^[\d.,%+-]+$")).withColumn("shape", skeleton(F.col("word"))).filter("shape <> ''")
    shapes = shaped(words)
    plain = F.col("word").rlike(r"^\p{L}[\p{L}'’-]*$")
    best = shapes.filter(plain & (F.col("n") >= KNOWN)).groupBy("shape").agg(F.max_by("word", F.struct("n", "word")).alias("form"), F.max("n").alias("top"))
    rare = F.col("n") <= F.greatest(F.lit(1.0), RARE * F.col("top"))
    judged = shapes if others is None else shaped(others)
    return judged.join(best, "shape").filter(rare & (F.col("word") != F.col("form"))).select("word", "form")


def _stray(line: Column) -> Column:
    """Whether a line has stray characters in words, or digits mixed with what is read for them."""
    odd = F.when(line.rlike(r"[·*|~^_�!¦§°¨`´]"), line.rlike(_STRAY)).otherwise(False)
    return odd | F.when(line.rlike(r"\d[lIO|]|[lIO|]\d"), line.rlike(_MIXED)).otherwise(False)


def _words(line: str) -> Column:
    return F.split(F.trim(F.col(line)), r"\s+")


def in_context(spots: DataFrame, text: DataFrame, words: DataFrame) -> DataFrame:
    """(page_id, line_no, at, meant): for misread words that could be one of several frequent forms, the one its neighbours support.

    spots: page_id, line_no, at, word. Support is how often a form stands behind the word before or before the word
    behind, anywhere in the text; ties go to the more frequent form.
    """
    plain = F.col("word").rlike(r"^\p{L}[\p{L}'’-]*$")
    frequent = words.filter(plain & (F.col("n") >= KNOWN)).select(skeleton(F.col("word")).alias("shape"), F.col("word").alias("meant"), F.col("n").alias("uses")).filter("shape <> ''")
    several = frequent.groupBy("shape").agg(F.count("*").alias("forms")).filter("forms > 1").select("shape")
    rivals = written(frequent.join(several, "shape"), "rival-forms")
    asked = spots.select("page_id", "line_no", "at", skeleton(F.col("word")).alias("shape")).join(rivals, "shape")
    parts = _words("text")
    beside = text.join(asked.select("page_id", "line_no").distinct(), ["page_id", "line_no"]).select("page_id", "line_no", F.transform(parts, lambda w: _bare(w)).alias("w"))
    asked = asked.join(beside, ["page_id", "line_no"]).select("page_id", "line_no", "at", "meant", "uses", F.get("w", F.col("at") - 1).alias("left"), F.get("w", F.col("at") + 1).alias("right"))
    asked = written(asked, "asked-forms")
    wanted = asked.select(F.col("left").alias("a"), F.col("meant").alias("b")).unionByName(asked.select(F.col("meant").alias("a"), F.col("right").alias("b")))
    wanted = written(wanted.filter("a IS NOT NULL AND b IS NOT NULL").distinct(), "asked-pairs")
    # only pairs with a form in question are put together at all
    either = wanted.select(F.explode(F.array("a", "b")).alias("word")).join(rivals.select(F.col("meant").alias("word")).distinct(), "word", "left_semi").distinct()
    ways = text.select(F.transform(parts, lambda w: _bare(w)).alias("w")).filter(F.size("w") > 1)
    ways = ways.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda i: F.struct(F.get("w", i - 1).alias("a"), F.get("w", i).alias("b")))).alias("p")).select("p.*")
    ways = ways.join(wanted, ["a", "b"], "left_semi").groupBy("a", "b").agg(F.count("*").alias("n")) if not either.isEmpty() else wanted.limit(0).withColumn("n", F.lit(0))
    ways = written(ways, "supported-pairs")
    before = ways.select(F.col("a").alias("left"), F.col("b").alias("meant"), F.col("n").alias("before"))
    behind = ways.select(F.col("a").alias("meant"), F.col("b").alias("right"), F.col("n").alias("behind"))
    scored = asked.join(before, ["left", "meant"], "left").join(behind, ["meant", "right"], "left")
    support = F.coalesce("before", F.lit(0)) + F.coalesce("behind", F.lit(0))
    return scored.groupBy("page_id", "line_no", "at").agg(F.max_by("meant", F.struct(support, "uses", "meant")).alias("meant"))


def analysed(pages: DataFrame) -> DataFrame:
    """Each line with what was found: running, split (it ends inside a word), joined (that word), fixes (raw, fixed), misread, starts_inside."""
    lines = written(lines_of(pages), "page-lines")
    running = written(_running(lines), "running-lines")
    more = _interrupting(lines.join(running, ["page_id", "line_no"], "left_anti"))
    running = written(running.unionByName(more).distinct(), "all-running-lines")
    at = ["page_id", "line_no"]
    text = written(_next_lines(lines.join(running, at, "left_anti")).withColumn("stray", _stray(F.col("text"))), "text-lines")
    words = written(vocabulary(text), "page-words")
    forms = written(misread_forms(words), "misread-forms")
    known = words.filter((F.col("n") >= KNOWN)).select("word")
    good = known.join(forms.select("word"), "word", "left_anti").select("word", F.lit(True).alias("ok"))
    # broken words: the two halves, with and without a hyphen
    tail, head = _last_word(F.col("text")), _first_word(F.col("next"))
    hyphen = F.col("text").rlike(_BROKEN)
    left = F.lower(F.regexp_replace(F.regexp_replace(tail, _BROKEN, ""), r"^[\s\"'«»“”„‚‘’(\[¿¡]+", ""))
    right = _bare(head)
    ends = text.filter("next IS NOT NULL").select("page_id", "line_no", "next_at", hyphen.alias("hyphen"), left.alias("left"), right.alias("right"), F.regexp_extract(tail, rf"([{HYPHENS}]+)\s*$", 1).alias("mark"))
    ends = ends.filter((F.col("left").rlike(r"\p{L}$|\p{L}\P{L}$")) & F.col("right").rlike(r"^\P{L}?\p{L}"))
    ends = ends.withColumns({"whole": F.concat("left", "right"), "compound": F.concat_ws("-", "left", "right")})
    for column, flag in (("whole", "whole_ok"), ("compound", "compound_ok"), ("left", "left_ok"), ("right", "right_ok")):
        ends = ends.join(good.select(F.col("word").alias(column), F.col("ok").alias(flag)), column, "left").fillna(False, [flag])
    shaped = forms.select(F.col("word").alias("whole"), "form").groupBy("whole").agg(F.min("form").alias("whole_form"))
    ends = ends.join(shaped, "whole", "left")
    sound = F.col("whole_ok") | F.col("whole_form").isNotNull()
    strange = ~F.col("left_ok") | ~F.col("right_ok")
    split = F.when(F.col("hyphen"), ~F.col("compound_ok") & (sound | strange | (F.length("mark") > 1))).otherwise(sound & strange & ~(F.col("left_ok") & (F.length("right") > 3)) & (~F.col("left_ok") | ~F.col("right_ok")))
    ends = ends.withColumn("split", split).filter("split").select("page_id", "line_no", "next_at", F.coalesce("whole_form", "whole").alias("joined"))
    ends = written(ends, "split-lines")
    # one row for each line that ends or starts inside a word; all others have neither
    broken = ends.select("page_id", "line_no", F.lit(True).alias("split"), "joined", F.lit(False).alias("starts_inside"))
    broken = broken.unionByName(ends.select("next_at.page_id", "next_at.line_no", F.lit(False).alias("split"), F.lit(None).cast("string").alias("joined"), F.lit(True).alias("starts_inside")))
    broken = written(broken.groupBy(*at).agg(F.max("split").alias("split"), F.max("joined").alias("joined"), F.max("starts_inside").alias("starts_inside")), "broken-lines")
    text = text.join(broken, at, "left").fillna(False, ["split", "starts_inside"])
    # misread words: strays are seen at once, other forms by the vocabulary; halves of broken words are no words
    parts = _words("text")
    tokens = text.select("page_id", "line_no", F.posexplode(parts).alias("at", "raw"), F.size(parts).alias("of"), "split", "starts_inside")
    tokens = tokens.filter(~(F.col("split") & (F.col("at") == F.col("of") - 1)) & ~(F.col("starts_inside") & (F.col("at") == 0)))
    tokens = tokens.filter(~F.col("raw").rlike(_CODE)).withColumn("word", _bare(F.col("raw")))
    # forms that stand only at the ends of lines, now that halves of broken words are known; what ends in a dash, even a misread one, is a half as well
    last = F.col("at") == F.col("of") - 1
    outer = tokens.filter(((F.col("at") == 0) | last) & ~(last & F.col("raw").rlike(rf"[{HYPHENS}–—=~_]$")) & (F.col("word") != ""))
    outer = outer.groupBy("word").agg(F.count("*").alias("n"))
    outer = written(outer.join(words.select("word"), "word", "left_anti"), "outer-words")
    forms = written(forms.unionByName(misread_forms(words, outer)), "all-misread-forms")
    spots = written(tokens.join(forms, "word").select("page_id", "line_no", "at", "raw", "word", "form"), "misread-words")
    spots = spots.join(in_context(spots, text, words), [*at, "at"], "left").withColumn("form", F.coalesce("meant", "form"))
    cased = F.when(F.col("raw").rlike(r"^\P{L}*\p{Lu}"), F.initcap("form")).otherwise(F.col("form"))
    fixed = F.concat(F.regexp_extract("raw", r"^([\s\"'«»“”„‚‘’(\[¿¡]*)", 1), cased, F.regexp_extract("raw", r"([\s.,;:?\"«»“”‘’)\]…]*)$", 1))
    fixes = spots.select("page_id", "line_no", F.struct("raw", fixed.alias("fixed")).alias("fix"))
    fixes = fixes.groupBy(*at).agg(F.sort_array(F.collect_set("fix")).alias("fixes"))
    text = text.join(fixes, at, "left").withColumn("misread", F.col("stray") | F.col("fixes").isNotNull()).withColumn("running", F.lit(False))
    columns = ["page_id", "pdf_id", "page_number", "line_no", "text", "next", "running", "split", "joined", "fixes", "misread", "starts_inside"]
    rest = lines.join(running, at, "left_semi").withColumn("running", F.lit(True))
    for c, kind in (("next", "string"), ("split", "boolean"), ("joined", "string"), ("misread", "boolean"), ("starts_inside", "boolean")):
        rest = rest.withColumn(c, F.lit(False if kind == "boolean" else None).cast(kind))
    rest = rest.withColumn("fixes", F.lit(None).cast("array<struct<raw:string,fixed:string>>"))
    return text.select(*columns).unionByName(rest.select(*columns))


def found(pages: DataFrame) -> DataFrame:
    """(page_id, line_no, kind) with kinds running, split and misread; a line may have several."""
    kinds = F.array_compact(F.array(*[F.when(F.col(k), F.lit(k)) for k in ("running", "split", "misread")]))
    return analysed(pages).select("page_id", "line_no", F.explode(kinds).alias("kind"))


def repaired_lines(pages: DataFrame) -> DataFrame:
    """(page_id, pdf_id, page_number, line_no, raw, text): lines of text without running ones, words whole and put right.

    A word broken over two lines stands whole at the end of the first.
    """
    t = analysed(pages).filter("NOT running")
    fixed = F.aggregate(F.coalesce("fixes", F.array().cast("array<struct<raw:string,fixed:string>>")), F.trim("text"), lambda acc, f: F.replace(acc, f["raw"], f["fixed"]))
    fixed = F.regexp_replace(fixed, r"(?<=\p{L})[·*|~^_�](?=\p{L})|�|(?<=\s)[~^|_¦¬`´]\s", "")
    begun = F.when(F.col("starts_inside"), F.regexp_replace(fixed, r"^\S+\s*", "")).otherwise(fixed)
    tail = F.regexp_extract("text", r"(\S+)\s*$", 1)
    cased = F.when(tail.rlike(r"^\P{L}*\p{Lu}"), F.initcap("joined")).otherwise(F.col("joined"))
    signs = F.regexp_extract("next", r"^\s*\S*\p{L}([.,;:?!\"»)]+)(?:\s|$)", 1)
    whole = F.when(F.col("split"), F.concat(F.regexp_replace(begun, r"\S+\s*$", ""), cased)).otherwise(begun)
    return t.select("page_id", "pdf_id", "page_number", "line_no", F.col("text").alias("raw"), F.concat(whole, F.when(F.col("split"), signs).otherwise("")).alias("text"))


def paragraphs(pages: DataFrame) -> DataFrame:
    """(pdf_id, para_no, first_page, text): the running text of each file, numbered from 1; of pages scanned twice the first scan.

    A paragraph begins after a blank line, with an indented line, with a title and after one, and at the top of a page
    only where one of these holds. Numbers come from running sums over blocks of pages, shifted by one row for each block.
    """
    lines = written(repaired_lines(pages), "repaired-lines")
    scans = lines.groupBy("pdf_id", "page_number").agg(F.min("page_id").alias("page_id"))
    lines = lines.join(scans, ["pdf_id", "page_number", "page_id"], "left_semi").withColumn("block", F.floor(F.col("page_number") / PAGE_BLOCK))
    order = Window.partitionBy("pdf_id", "block").orderBy("page_number", "line_no")
    title = F.col("raw").rlike(_TITLE) & ~F.col("raw").rlike(r"[.,;:\-‐¬]\s*$") & (F.length(F.trim("raw")) <= 0.8 * F.max(F.length("raw")).over(Window.partitionBy("pdf_id", "page_number"))) & F.coalesce(F.lag("raw").over(order).rlike(r"[.!?:…][\"'»”)]*\s*$"), F.lit(True))
    title &= ~F.coalesce(F.lead("raw").over(order).rlike(r"^\s*\p{Ll}"), F.lit(False))
    lines = lines.withColumns({"title": title, "gap": (F.col("line_no") - F.lag("line_no").over(order) > 1) & (F.col("page_number") == F.lag("page_number").over(order)), "first": F.row_number().over(order) == 1})
    begins = F.col("title") | F.coalesce(F.lag("title").over(order), F.lit(False)) | F.coalesce("gap", F.lit(False)) | F.col("raw").rlike(r"^\s{2,}\S")
    lines = lines.withColumn("begins", begins.cast("int"))
    lines = lines.withColumn("at", F.sum("begins").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    blocks = lines.groupBy("pdf_id", "block").agg(F.max("at").alias("n"))
    before = Window.partitionBy("pdf_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("pdf_id", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    lines = lines.join(blocks, ["pdf_id", "block"]).withColumn("para", F.col("at") + F.col("offset"))
    rows = lines.filter("text <> ''").groupBy("pdf_id", "para").agg(F.min("page_number").alias("first_page"), F.sort_array(F.collect_list(F.struct("page_number", "line_no", "text"))).alias("rows"))
    return rows.select("pdf_id", (F.col("para") + 1).cast("int").alias("para_no"), "first_page", F.regexp_replace(F.array_join(F.col("rows.text"), " "), r"(?<=\p{L})- (?=\p{Ll})", "-").alias("text"))
