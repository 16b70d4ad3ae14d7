"""Text functions with state between characters, which no built-in expression has; Arrow batches, one small helper each.

A null text gives null.
"""

from __future__ import annotations

import html
import re
import unicodedata
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loregrid.functions import text as tx

# Words before a full stop that do not end a sentence, of documents and of pages.
DOCUMENT_ABBREVIATIONS = set(
    "Dr Mr Mrs Ms Prof Inc Ltd Co Jr Sr St etc vs ca Nr Abs bzw vgl sog Fig Tab Vol No Dept Gen Gov Sgt Cpl Pvt Capt Col "
    "Maj Rev Jan Feb Mar Apr Jun Jul Aug Sep Oct Nov Dec Mon Tue Wed Thu Fri Sat Sun".split()
)
PAGE_ABBREVIATIONS = tuple(
    "Dr. Mr. Mrs. Ms. Prof. Nr. St. Str. z.B. d.h. u.a. o.ä. etc. bzw. inkl. zzgl. ca. max. min. tel. Tel. Fax. Abs. e.V. i.d.R. u.U. z.T.".split()
)
# Elements whose text is not page text.
SKIPPED_TAGS = set("script style nav header footer noscript aside form button svg canvas iframe select input".split())
VOID_TAGS = set("area base br col embed hr img input link meta source track wbr".split())

_ARRAY = T.ArrayType(T.StringType())
_PAIRS = T.ArrayType(T.StructType([T.StructField("input", T.StringType()), T.StructField("output", T.StringType())]))


@F.pandas_udf(T.StringType())
def normalize(texts: pd.Series) -> pd.Series:
    """Lower case, NFKD, trimmed."""
    return texts.map(lambda t: unicodedata.normalize("NFKD", t.lower()).strip(), na_action="ignore")


@F.pandas_udf(T.StringType())
def nfc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


def clean_text(text: Column) -> Column:
    """`clean_document` after NFC; texts of plain ASCII skip the trip to Python."""
    return tx.clean_document(F.when(text.rlike(r"[^\x00-\x7F]"), nfc(text)).otherwise(text))


_NEXT = re.compile(r"[ \t]*(.?)", re.S)


def split_sentences(text: str) -> list[str]:
    """Sentences of a document: . ! ? before a capital, a line end or the end; not in brackets, numbers or abbreviations."""
    out, start, counted, deep = [], 0, 0, 0
    for m in re.finditer(r"\.\.\.|[.!?]", text):
        i, end = m.start(), m.end()
        if i < start or m.group() == "...":
            continue
        # brackets open since the sentence began, counted on from mark to mark
        deep += text.count("(", counted, end) - text.count(")", counted, end)
        counted = end
        if deep > 0:
            continue
        if m.group() == ".":
            if text[max(0, i - 1) : i].isdigit() and text[end : end + 1].isdigit():
                continue
            j = i
            while j and text[j - 1].isalpha():
                j -= 1
            word = text[j:i]
            if word in DOCUMENT_ABBREVIATIONS or (0 < len(word.encode()) <= 2 and text[end : end + 1].isalpha()):
                continue
        after = _NEXT.match(text, end)[1]
        if after == "" or after == "\n" or after.isupper():
            if s := text[start:end].strip():
                out.append(s + " ")
            start, deep = end, 0
    if rest := text[start:].strip():
        out.append(rest)
    return out


def split_segments(text: str, longest: int) -> list[str]:
    """Paragraphs, those longer than `longest` as sentences."""
    out = []
    for para in filter(None, (p.strip() for p in text.split("\n\n"))):
        parts = split_sentences(para) if len(para) > longest else []
        out += [*parts, "\n\n"] if parts else [para + "\n\n"]
    return out


def split_chunks(text: str, least: int = 50, longest: int = 1000, overlap: int = 200, by: str = "paragraph") -> list[str]:
    """Overlapping chunks of at most `longest` characters, but for the last, which keeps what one cut leaves over."""
    text = text.strip()
    if len(text) <= longest:
        return [text] if text else []
    segments = split_segments(text, longest) if by == "paragraph" else split_sentences(text) if by == "sentence" else list(text)
    out, now = [], ""
    for seg in segments:
        if len(now) + len(seg) > longest and len(now) >= least:
            out.append(now)
            now = (now[-overlap:] if len(now) > overlap else now) if overlap else ""
        now += seg
        if len(now) > longest:
            out.append(now[:longest])
            now = now[longest - overlap :]
    return [*out, now] if now and len(now) >= least else out


def chunks(text: Column, least: int = 50, longest: int = 1000, overlap: int = 200, by: str = "paragraph") -> Column:
    if overlap > longest:
        raise ValueError("overlap must not exceed the longest chunk")

    @F.pandas_udf(_ARRAY)
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: split_chunks(t, least, longest, overlap, by), na_action="ignore")

    return cut(text)


@F.pandas_udf(_ARRAY)
def sentences(texts: pd.Series) -> pd.Series:
    return texts.map(split_sentences, na_action="ignore")


def page_sentences(text: str) -> list[str]:
    """Sentences of a page: . ! ? before white space, unless an abbreviation ends there."""
    out, start = [], 0
    for m in re.finditer(r"[.!?](?=\s)", text):
        now = text[start : m.end()].strip()
        if not now.endswith(PAGE_ABBREVIATIONS):
            out.append(now)
            start = m.end()
    return [s for s in (*out, text[start:].strip()) if s]


def cut_at_sentence(text: str, longest: int) -> str:
    """At most `longest` bytes, up to the last sentence end, else the last blank and '...'; never inside a character."""
    raw = text.encode()
    if len(raw) <= longest:
        return text
    head = raw[:longest].decode(errors="ignore")
    at = max(head.rfind(e) for e in (". ", "! ", "? "))
    if at >= 0:
        return head[: at + 1]
    at = head.rfind(" ")
    return (head[:at] if at >= 0 else head) + "..."


@F.pandas_udf(T.StringType())
def truncated(texts: pd.Series, longest: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else cut_at_sentence(t, n) for t, n in zip(texts, longest)])


class _Page(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.title, self.texts, self.links, self.skip, self.in_title = None, [], [], [], False

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "a" and (href := dict(attrs).get("href")) is not None:
            self.links.append(href)
        if tag == "title" and self.title is None:
            self.title, self.in_title = "", True
        if tag in SKIPPED_TAGS and tag not in VOID_TAGS:
            self.skip.append(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag == "title":
            self.in_title = False
        if tag in self.skip:
            del self.skip[len(self.skip) - 1 - self.skip[::-1].index(tag) :]

    def handle_data(self, data: str) -> None:
        if self.in_title:
            self.title += data
        elif not self.skip and (s := data.strip()):
            self.texts.append(s)


_HTML = T.StructType([T.StructField("title", T.StringType()), T.StructField("text", T.StringType()), T.StructField("links", _ARRAY)])


@F.pandas_udf(_HTML)
def html_parts(pages: pd.Series, urls: pd.Series) -> pd.DataFrame:
    """Title, text outside skipped elements (one line for each text node), and links to the same host."""
    rows = []
    for page, url in zip(pages, urls):
        p = _Page()
        p.feed(page or "")
        p.close()
        host = urlsplit(url or "").hostname
        links = [u for u in (urljoin(url or "", h.strip()) for h in p.links) if host and urlsplit(u).hostname == host]
        rows.append((html.unescape(p.title or "").strip(), "\n".join(p.texts), links))
    return pd.DataFrame(rows, columns=["title", "text", "links"])


def _long(s: str, least: int) -> bool:
    return len(s.encode()) >= least


def pairs_by_heading(text: str, least: int) -> list[tuple[str, str]]:
    lines, i = text.split("\n"), 0
    while i < len(lines) - 1:
        h = lines[i].strip()
        if h and not _long(h, 100) and not h.endswith(".") and h[:1].isupper():
            # Pages have no blank lines left: the body is the rest of the page.
            body = cut_at_sentence(" ".join(x.strip() for x in lines[i + 1 :] if x.strip()), 500)
            return [(h, body)] if _long(h, least) and _long(body, least) else pairs_by_heading("\n".join(lines[i + 1 :]), least) if not body else []
        i += 1
    return []


def pairs_by_paragraph(text: str, least: int) -> list[tuple[str, str]]:
    out = []
    for para in filter(None, (p.strip() for p in text.split("\n\n"))):
        first = next(iter(page_sentences(para)), "")
        if _long(para, least) and _long(first, least) and len(first) < len(para):
            out.append((first, cut_at_sentence(para, 500)))
    return out


def pairs_by_sentence(text: str, least: int) -> list[tuple[str, str]]:
    s = [x for x in page_sentences(text) if _long(x, least)]
    return list(zip(s[::2], s[1::2]))


@F.pandas_udf(_PAIRS)
def _page_pairs(texts: pd.Series, strategy: pd.Series, least: pd.Series) -> pd.Series:
    by = {"heading_content": pairs_by_heading, "paragraph": pairs_by_paragraph, "sentence": pairs_by_sentence}
    return pd.Series([None if t is None else [{"input": a, "output": b} for a, b in by[s](t, n)] for t, s, n in zip(texts, strategy, least)])


def page_pairs(text: Column, strategy: str, least: int = 20) -> Column:
    """array(struct(input, output)) of a cleaned page by heading_content, paragraph or sentence; inputs as questions."""
    ask = tx.heading_question if strategy == "heading_content" else tx.sentence_question
    pairs = _page_pairs(text, F.lit(strategy), F.lit(least))
    return F.transform(pairs, lambda p: F.struct(ask(p["input"]).alias("input"), p["output"].alias("output")))


@F.pandas_udf(T.DoubleType())
def jaro_winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    def one(s: str, t: str) -> float:
        if s == t:
            return 1.0
        reach, used, hits = max(0, max(len(s), len(t)) // 2 - 1), set(), []
        for i, c in enumerate(s):
            for j in range(max(0, i - reach), min(len(t), i + reach + 1)):
                if j not in used and t[j] == c:
                    used.add(j)
                    hits.append(c)
                    break
        m = len(hits)
        if not m:
            return 0.0
        swaps = sum(x != y for x, y in zip(hits, (t[j] for j in sorted(used)))) // 2
        jaro = (m / len(s) + m / len(t) + (m - swaps) / m) / 3
        prefix = next((k for k, (x, y) in enumerate(zip(s[:4], t[:4])) if x != y), min(4, len(s), len(t)))
        return jaro + 0.1 * prefix * (1 - jaro) if jaro > 0.7 else jaro

    return pd.Series([None if x is None or y is None else one(x, y) for x, y in zip(a, b)])
