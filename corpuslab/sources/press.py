"""Press articles of an aggregator's export: one row for each <article>, with journal, date, title, subtitle and text."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslab.functions import text as T

# Classes of the export's elements, elements that hold no article text, and the form of a date.
JOURNAL_BOX, JOURNAL, DATE = "rdp__DocPublicationName", "DocPublicationName", "DocHeader"
TITLE, SUBTITLE = {"sm-margin-TopNews", "titreArticleVisu", "rdp__articletitle"}, {"sm-margin-TopNews", "rdp__subtitle"}
HEAD_BOX, FOOT, FRAME = "titreArticle", "sm-margin-bottomNews", "apd-wrapper"
OUTSIDE = ("head", "aside", "footer", "img", "a")
DATE_FORM = re.compile(r"\d{1,2} \w+ \d{4}|\w+ \d{1,2}, \d{4}")
LINK = re.compile(r"\(lien : https?://[^)]+\)")
VOID = ("br", "img", "hr", "input", "meta", "link", "source", "wbr", "area", "base", "col", "embed", "track")

MODES = ("texte", "titre", "chapeau", "titre_chapeau")


@dataclass(eq=False)
class Element:
    tag: str
    classes: frozenset
    above: tuple  # the elements that hold it, outermost first


@dataclass
class Article:
    strings: list = field(default_factory=list)  # (text, elements that hold it)

    def first(self, tag: str, classes: set) -> Element | None:
        return next((e for _, held in self.strings for e in held if e.tag == tag and classes <= e.classes), None)

    def within(self, e: Element | None) -> list[str]:
        return [s for s, held in self.strings if e is not None and any(x is e for x in held)]


class Articles(HTMLParser):
    """Collects the strings of each outermost <article>."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[Element] = []
        self.found: list[Article] = []

    def handle_starttag(self, tag, attrs):
        if tag == "article" and not any(e.tag == "article" for e in self.open):
            self.found.append(Article())
        if tag not in VOID:
            self.open.append(Element(tag, frozenset((dict(attrs).get("class") or "").split()), tuple(self.open)))

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k].tag == tag:
                del self.open[k:]
                break

    def handle_data(self, data):
        at = next((k for k, e in enumerate(self.open) if e.tag == "article"), None)
        if at is not None:
            self.found[-1].strings.append((data, tuple(self.open[at:])))


def stripped(strings: list[str]) -> list[str]:
    return [t for s in strings if (t := s.strip())]


def read(article: Article, mode: str, whole_name: bool, stop_terms: tuple[str, ...] | None, patterns: list[re.Pattern]) -> tuple[str, str, str, str, str]:
    """journal, date (as written), title, subtitle, text. Stop terms and patterns are used only if the terms are given (not None)."""
    box = article.first("div", {JOURNAL_BOX})
    name = next((e for _, held in article.strings for e in held if box is not None and e.tag == "span" and JOURNAL in e.classes and any(x is box for x in held)), None)
    names = stripped(article.within(name))
    journal = "" if not names else "".join(names) if whole_name else names[0]
    dated = article.first("span", {DATE})
    header = html.unescape("".join(article.within(dated)))
    date = m.group() if (m := DATE_FORM.search(header)) else ""
    title = "".join(stripped(article.within(article.first("p", TITLE))))
    subtitle = " ".join(stripped(article.within(article.first("p", SUBTITLE))))
    head_box = article.first("div", {HEAD_BOX})
    full: dict[Element, str] = {}
    if stop_terms is not None:
        for s, held in article.strings:
            for e in held:
                if e.tag == "div":
                    full[e] = full.get(e, "") + s.strip()

    def kept(held: tuple[Element, ...]) -> bool:
        for e in held:
            if e is box or e is dated or e.tag in OUTSIDE or (e.tag == "div" and FRAME in e.classes) or (e.tag == "p" and FOOT in e.classes):
                return False
            if stop_terms is not None and e.tag == "div" and full[e] in stop_terms:
                return False
            if stop_terms is not None and e.tag == "p" and head_box in e.above and not TITLE <= e.classes:
                return False
        return True

    if mode == "titre":
        text = title
    elif mode == "chapeau":
        text = subtitle
    elif mode == "titre_chapeau":
        text = "\n".join(x for x in (title, subtitle) if x)
    else:
        text = "\n".join(stripped([s for s, held in article.strings if kept(held)]))
    for p in patterns if stop_terms is not None else ():
        text = p.sub("", text)
    for written in (journal, date, header):
        text = text.replace(written, "") if written else text
    text = LINK.sub("", " ".join(stripped(text.splitlines())))
    if text:
        text = (text if text.endswith(".") else text + ".").strip()
    return journal, date, title, subtitle, text


def press_articles(
    pages: DataFrame, mode: str = "texte", whole_name: bool = True, stop_terms: tuple[str, ...] | None = None, patterns: tuple[str, ...] = (), key: str = "page_id", html_col: str = "html"
) -> DataFrame:
    """key, article (from 0), journal, date (null if none), title, subtitle, text of each article of each page.

    mode: what the text is ("texte", "titre", "chapeau", "titre_chapeau"). whole_name: the journal's whole text, or its first piece. With
    stop_terms, divs whose text is one of them and the paragraphs beside the title go, and patterns are removed. Adverts, links, notes and the
    lines that name journal and date are never text. Line ends become blanks, a full stop is added. A null page has no articles.
    """
    if mode not in MODES:
        raise ValueError(f"mode is one of {MODES}")
    drop = [re.compile(p) for p in patterns]
    names = [key, "article", "journal", "_date", "title", "subtitle", "text"]

    def made(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rows = []
            for k, page in zip(pdf[key], pdf[html_col], strict=True):
                parser = Articles()
                parser.feed(page or "")
                parser.close()
                rows += [(k, n, *read(a, mode, whole_name, stop_terms, drop)) for n, a in enumerate(parser.found)]
            yield pd.DataFrame(rows, columns=names)

    out = pages.select(key, html_col).mapInPandas(made, f"{key} {dict(pages.dtypes)[key]}, article int, journal string, _date string, title string, subtitle string, text string")
    return out.select(key, "article", "journal", T.date_fr("_date").alias("date"), "title", "subtitle", "text")


def header(articles: DataFrame, journal: bool = True, date: str | None = "yyyy-MM-dd", extra: str | None = None) -> Column:
    """The line of four stars of an article: source, date, month and year as variables."""
    day = F.col("date")
    parts = [F.lit("****"), F.when((F.col("journal") != "") & F.lit(journal), T.source_name("journal"))]
    if date:
        parts += [F.concat(F.lit("*date_"), F.date_format(day, date)), F.concat(F.lit("*am_"), F.date_format(day, "yyyy-MM")), F.concat(F.lit("*annee_"), F.date_format(day, "yyyy"))]
    return F.concat_ws(" ", *parts, F.lit(f"*{extra}") if extra else F.lit(None))
